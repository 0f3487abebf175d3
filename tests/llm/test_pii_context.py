"""Contextual extraction against a plain Python version: patterns, pairs, scores, added spans."""

import math
import random
import re
from collections import defaultdict

from foliospark.llm import pii
from tests.llm.test_text_operators import base_pii, joined

LIKELY = re.compile(r"[A-Za-z0-9._%+-]+\x20?(?:\(at\)|\[at\]|\{at\}|@)\x20?[A-Za-z0-9.-]{2,}|[+(]?[0-9](?:[\x20().\x2F-]{0,3}[0-9]){5,}")
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def context(text, spans):
    """By span the two words before it, after the match before."""
    out, last = {}, None
    for s, e in spans:
        m = re.search(r"(?<!\S)(\S+\s+\S+)\s*$", ("" if last is None else "<id>") + text[last or 0 : s])
        out[s, e] = m[1].lower() if m else ""
        last = e
    return out


def occurrences(text):
    """(kind or None, start, end, instance, pattern)."""
    base = base_pii(text)
    for kind, pattern in BASE.items():
        before = context(text, [m.span() for m in re.finditer(pattern, text)])
        for k, s, e in base:
            if k == kind:
                yield k, s, e, re.sub(r"[\s().-]", "", text[s:e]).lower(), before[s, e]
    likely = [m.span() for m in LIKELY.finditer(text)]
    before = context(text, likely)
    for s, e in likely:
        if not any(a < e and s < b for _, a, b in base):
            yield None, s, e, re.sub(r"[\s().-]", "", text[s:e]).lower(), before[s, e]


def brute(texts):
    found = [list(occurrences(t)) for t in texts]
    pairs = {(p, i, k) for occ in found for k, _, _, i, p in occ if p}
    seeds = {i: max(k for _, j, k in pairs if j == i and k) for _, i, k in pairs if k}
    held = defaultdict(set)
    for p, i, _ in pairs:
        held[p].add(i)
    held = {p: v for p, v in held.items() if len(v) >= pii.SUPPORT}
    known = {i: (k, 1.0) for i, k in seeds.items()}
    for _ in range(pii.ROUNDS):
        confidence = {}
        for p, v in held.items():
            for kind in pii.KINDS:
                own = [known[i][1] for i in v if i in known and known[i][0] == kind]
                if len(own) > 1:
                    confidence[p, kind] = sum(own) / (len(v) + 0.5)
        reached = defaultdict(float)
        for (p, kind), c in confidence.items():
            for i in held[p]:
                reached[i, kind] += math.log1p(-min(c, 0.999))
        best = {}
        for (i, kind), x in reached.items():
            best[i] = max(best.get(i, (-1.0, "")), (1 - math.exp(x), kind))
        known = {i: (k, 1.0) for i, k in seeds.items()} | {i: (k, s) for i, (s, k) in best.items() if i not in seeds}
    sure = {i: k for i, (k, s) in known.items() if i not in seeds and s >= pii.SURE}
    order = {k: n for n, k in enumerate(pii.KINDS)}
    for t, occ in zip(texts, found, strict=True):
        more = {(sure[i], s, e) for k, s, e, i, _ in occ if k is None and i in sure}
        yield joined(sorted([*base_pii(t), *more], key=lambda x: (order[x[0]], x[1], x[2]))), len(more)


def test_added_spans_equal_a_plain_version(spark):
    rng = random.Random(8)
    long = "a" * 70
    lead = ["mail me", f"{long} {'b' * 300}", "call us", "from host", "pay with", "part no", "see"]
    name = lambda: f"u{rng.randrange(400)}"
    make = [
        lambda: f"{name()}@{name()}.org", lambda: f"{name()}(at){name()}.org", lambda: f"{name()} [at] {name()}.net", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        lambda: f"+{rng.randrange(10**10, 10**11)}", lambda: f"(0{rng.randrange(100, 999)}) {rng.randrange(10**5, 10**7)}", lambda: "4111 1111 1111 1111", lambda: str(rng.randrange(10**5, 10**8)), lambda: "7" * 60 + str(rng.randrange(1000)),
    ]
    likes = {"mail me": make[:3], lead[1]: [make[0], make[0], make[1]], "call us": [make[4], make[4], make[5]], "from host": [make[3], make[7]], "pay with": make[6:9]}
    texts = []
    for _ in range(250):
        bits = []
        for _ in range(rng.randrange(1, 7)):
            at = rng.choice(lead)
            bits.append(f"{at}{rng.choice([' ', '  ', chr(10) * 12])}{rng.choice(likes.get(at, make))()}{rng.choice(['', ' or ', ', ', ' words after '])}")
            if rng.random() < 0.3:
                bits.append(rng.choice(make)())
        texts.append(" ".join(bits))
    texts += ["", "w " * 30_000 + "mail me x(at)y.zz", " ".join(f"no {i:06d}" for i in range(3_000))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, start int, pattern string")
    got = {r.doc_id: (r.spans, r.n_added) for r in pii.find(spark, df).collect()}
    want = dict(enumerate(brute(texts)))
    assert got == want
    assert sum(n for _, n in want.values()) > 60
    assert any(n and long in t and t.index(long) < t.index("(at)") for (_, n), t in zip(want.values(), texts, strict=True) if "(at)" in t)
