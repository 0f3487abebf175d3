"""PII, secrets, HTML, chat windows and decontamination against plain Python."""

import base64
import hashlib
import json
import random
import re

import pytest

from foliospark.llm import chat, decontam, html, pii, secrets

ODD = ["", None, " ", "x" * 50_000, "\n" * 10, "\U0001f600 a@b.cc \U0001f600 1.2.3.4"]


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def base_pii(t):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_pii_base_equals_plain_patterns(spark):
    rng = random.Random(3)
    bits = ["a@b.cc", "a@b.c_d@e.ff", "x.y+z@m-n.o.p", "1.2.3.4", "1.2.3.4.5", "300.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "+1.......2", "@", ".", " ", "é", "12", "@@a@b", "\n", "4532015112830366", "%"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "-"]) for _ in range(rng.randrange(1, 14))) for _ in range(400)] + ODD + ["1" * 20_000, "a." * 20_000 + "@b.c", "+" + "1 " * 9_000]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, h string, id int, base string")
    got = {r.doc_id: r for r in pii.find(spark, df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base_pii(t or "")
        assert got[i].base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest(), t
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == x for x, _, _ in want) for k in pii.KINDS)
        assert not want or set(joined(want).split(",")) <= set(got[i].spans.split(","))


def test_pii_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"please mail me u{i}@host.example.com today") for i in range(8)] + [(100, "please mail me anna(at)host.example.com today"), (101, "serial 99887766 of part"), (None, "please mail me anna(at)host.example.com today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(spark, df).collect()}
    assert got[100].spans == "email:15:39" and got[100].n_added == 1 and got[None].n_added == 1 and got[101].spans == ""
    assert pii.find(spark, df.limit(0)).collect() == []


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def test_secrets(spark):
    rng = random.Random(1)
    key = der(0x30, b"".join(der(2, b) for b in [b"\0", *(rng.randbytes(40) for _ in range(8))]))
    url = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': 'someone', 'iat': 1})}.c2lnbmF0dXJl"
    good = base64.b64encode(key).decode()
    texts = ["Password: hunter2x api-key=short, APIKEY='abcdef'", "AKIA" + "A" * 16 + " AKIA12", "f" * 24 + " " + "f" * 23, f"a {good} b", f"a {good[:-8]} b", f"t {token}.", "t " + token.replace("eyJ", "eyK"), *ODD]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(spark, df).collect()}
    assert got[0].spans == "assign:0:18,assign:34:48" and got[1].spans == "access:0:20" and got[2].spans == "hex:0:24"
    assert got[3].spans == f"pkcs1:2:{2 + len(good)}" and got[4].n_confirmed == 0
    assert got[5].n_confirmed == 1 and got[5].spans.startswith("jwt:2:") and got[6].n_confirmed == 0
    assert all(got[i].base_sha256 == hashlib.sha256(b"").hexdigest() for i in range(7, 7 + 5))


def test_html(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">ok?</div>'
        '<article><header><p>Site</p></header><h1>A &amp; B&lt;</h1><p>One  <b>two</b>three<br>four<p>five<script>var t="</p>";</script><div class=ad>buy</div><!-- c --><form>f</form>'
        '<section id="comments"><p>nice</p></section></article><aside>side</aside><footer>&copy; x</footer></body></html>'
    )
    box = "<div><span>follow us</span> <i>now</i></div>"
    rows = [(1, "http://a.example/x", page), (2, None, None), (3, "http://a.example/y", ""), (4, "x", "a &amp b <p>c"), (5, "x", "<" * 1000), (6, "x", "<div>" * 3000 + "deep")]
    rows += [(10 + i, f"https://u@B.example:80/{i}", f"<html><body>{box}<p>own {i}</p><p>tail {i}</div>") for i in range(8)]
    rows += [(30 + i, f"http://c.example/{i}", f"<article><p>same line</p>{box}<p>own {i}</p></article>") for i in range(8)]
    rows += [(50 + i, f"http://d.example/{i}", "<div>mirrored page</div>") for i in range(8)]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html.main_text(spark, df).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert got[1].text == "A & B< One twothree four five" and got[2].text == got[3].text == "" and got[4].text == "a & b c" and got[6].text == "deep"
    assert [got[10 + i].text for i in range(8)] == [f"own {i} tail {i}" for i in range(8)]
    assert [got[30 + i].text for i in range(8)] == [f"same line own {i}" for i in range(8)]
    assert got[50].text == "mirrored page"
    assert html.main_text(spark, df.limit(0)).collect() == []


def test_chat_windows_read_back(spark):
    rng = random.Random(2)
    odd = ["", None, "<|im_end|><|im_start|>assistant ok", "<\\|x", "\\<|\\\\", "a\nb", "w " * 700, "\\n", "é\U0001f600"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "sys\ntem", "<|", None]) if t else rng.choice(["system", "user"]), rng.choice(odd) if rng.random() < 0.5 else "w " * rng.randrange(90)) for c in range(30) for t in range(rng.randrange(1, 12))]
    rows += [(None, 0, "user", "x"), (5, None, "assistant", "null turn"), (6, 1, "user", "tie"), (6, 1, "user", "tie")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n int")
    out = chat.windows(df, 256)
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    seen = out.collect()
    assert max(r.window for r in seen) > 1 and any(not t.first for r in seen for t in r.turns)
    assert chat.windows(df.limit(0)).collect() == []


@pytest.mark.parametrize("percent", [80, 60])
def test_decontamination_equals_brute_force(spark, percent):
    rng = random.Random(percent)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(6))
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 4, 5, 9, 20, 40])))) for i in range(25)] + [(90, None), (91, ""), (92, "...")]
    docs = []
    for d in range(80):
        words = [word() for _ in range(rng.randrange(0, 120))]
        for _, t in rng.sample(items[:25], rng.randrange(3)):
            copy = t.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = word()
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if d % 3 == 0 else w + "," for w in copy]
        docs.append((d, "  ".join(words) if d % 2 else " ".join(words)))
    docs += [(None, items[4][1]), (200, None), (200, items[5][1])]

    def words_of(t):
        return re.findall(r"[^\s!-/:-@\[-`{-~]+", (t or "").lower())

    def bag(words, k):
        out: dict = {}
        for i in range(max(1, len(words) - k + 1) if words else 0):
            out[tuple(words[i : i + k])] = out.get(tuple(words[i : i + k]), 0) + 1
        return out

    want = set()
    for d, t in docs:
        dw = words_of(t)
        for i, x in items:
            iw = words_of(x)
            k = min(5, len(iw))
            if not iw or len(dw) < k:
                continue
            a, size = bag(iw, k), min(len(iw), len(dw))
            for s in range(len(dw) - size + 1):
                b = bag(dw[s : s + size], k)
                common = sum(min(a[w], b.get(w, 0)) for w in a)
                if common and 100 * common >= percent * (sum(a.values()) + sum(b.values()) - common):
                    want.add((d, i))
                    break
    df = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(spark, df, bench, percent).collect()}
    assert got == want and len(want) > 20
    left = decontam.clean(spark, df, bench, percent)
    gone = {d for d, _ in want} - {200}  # of the two rows 200 one stays
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, t in docs if d not in gone and not (d == 200 and t))
    assert decontam.matches(spark, df.limit(0), bench).collect() == [] == decontam.matches(spark, df, bench.limit(0)).collect()
