"""SimHash blocks: no fingerprint within the radius is missed, candidates come from them alone, recall of the whole."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from foliospark.llm import decontam
from foliospark.llm.shingles import SEPARATORS, text_words

RNG = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(2000)]


def prose(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def similarity(a, b):
    x, y = (Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (a, b))
    common = sum((x & y).values())
    return common / (sum(x.values()) + sum(y.values()) - common)


def planted(items, n):
    for _ in range(n):
        i = RNG.randrange(len(items))
        own = list(items[i])
        for _ in range(RNG.choice([0, 1, 1, 2])):
            own[RNG.choice([0, -1, 1, RNG.randrange(len(own))])] = "zz"
        text = prose(25) + own + prose(25)
        best = max(similarity(text[s : s + len(own)], items[i]) for s in range(18, 33))
        if best >= 0.8:
            yield i, best, " ".join(text)


def test_every_fingerprint_within_the_radius_is_a_candidate():
    items = decontam.Items(list(range(200)), [" ".join(prose(30)) for _ in range(200)])
    rng = np.random.default_rng(2)
    for bits in range(items.radius + 1):
        for n in range(0, 200, 25):
            flips = rng.choice(64, bits, replace=False)
            seen = items.prints[n] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if bits else items.prints[n]
            window, item = items.candidates(np.array([seen], np.uint64))
            want = {m for m in range(200) if int(seen ^ items.prints[m]).bit_count() <= items.radius}
            assert set(item.tolist()) == want and n in want and set(window.tolist()) <= {0}


def test_recall_of_windows_by_similarity_and_no_other_way_in():
    items = [prose(RNG.randrange(8, 60)) for _ in range(150)]
    block = decontam.Items(list(range(150)), [" ".join(x) for x in items])
    rows = list(planted(items, 500))
    words = list(text_words(pa.array([t for *_, t in rows]), SEPARATORS))
    found = [i in {m[0] for m in block.matches(w)} for (i, *_), w in zip(rows, words, strict=True)]
    near = [f for f, (_, s, _) in zip(found, rows, strict=True) if s < 0.9]
    assert len(near) > 60 and sum(near) / len(near) > 0.95 and sum(found) / len(found) > 0.97
    block.first = np.zeros_like(block.first)  # the blocks are empty: nothing is a candidate
    assert not any(list(block.matches(w)) for w in words)


def test_whole_documents_shorter_than_an_item_and_very_long_ones():
    item = prose(50)
    block = decontam.Items([7], [" ".join(item)])
    cut, long = item[3:], prose(300_000) + item + prose(20)
    got = [[m[:3] for m in block.matches(w)] for w in text_words(pa.array([" ".join(cut), " ".join(long), " ".join(item * 2_000)]), SEPARATORS)]
    assert got == [[(7, 0, 47)], [(7, 300_000, 50)], [(7, 0, 50)]]
