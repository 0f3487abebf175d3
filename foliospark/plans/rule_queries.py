"""Every validation rule over strings and papers made of the rows of a table, beside the codes that SQL expects.

Each row of the table gets one of the samples below, with a number of its own in it; the rules see it
whole, and every issue is returned. So the SQL, which knows the samples' codes, fails on one too many as on
one too few.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from foliospark.operators import validate
from foliospark.plans.page_queries import framed
from foliospark.plans.queries import query
from foliospark.session import spread
from foliospark.sources.papers import data_uri

E, W, I = "error", "warning", "info"  # noqa: E741
#: Strings (# stands for the row's number) and the issues that they have.
STRINGS = [
    ("plain words #", []), ("let $x^{#}$ be", []), ("$$\\frac{#}{2}$$", []), ("$\\left(#\\right)$", []), ("a\nb #", []), ("$\\begin{cases}#\\end{cases}$", [(W, "environment-used")]),
    ("  ", [(E, "empty")]), ("a\ufffd#", [(E, "replacement-char")]), ("a\t#\t", [(E, "control-char"), (E, "control-char")]), ("a\ue000#", [(E, "private-char")]), ("a\u200b#", [(E, "invisible-char")]), ("Ã© #", [(W, "mojibake")]),
    ("$\\\\frac{#}{2}$", [(E, "double-backslash")]), ("$$a\\\\ #$$", [(W, "latex-linebreak")]), ("one\\n#", [(E, "literal-backslash-n")]), ("$x \\r #$", [(W, "unknown-command")]), ("$a \neq #$", [(E, "eaten-backslash-n"), (W, "newline-in-inline-math")]),
    ("cost $#", [(E, "dollar-balance")]), ("$$#$ $$", [(E, "dollar-balance")]), ("a $$ $$ #", [(E, "dollar-balance")]), ("\\alpha #", [(E, "command-outside-math")]), ("frac #", [(E, "bare-command")]), ("a { #", [(W, "text-braces")]),
    ("$\\mystery{#}$", [(E, "katex-unsupported")]), ("$\\frac{#}{2}}$", [(E, "brace-balance")]), ("$\\left(#$", [(E, "left-right")]), ("$\\begin{cases}#\\end{array}$", [(E, "environment"), (W, "environment-used")]), ("$sqrt{#} + pm$", [(E, "bare-command"), (E, "bare-command")]), ("$sin # + cos #$", [(W, "bare-function"), (W, "bare-function")]),
    ("$#\n$", [(W, "newline-in-inline-math")]), ("$\\text{sin frac #}$", []), (None, [(E, "type")]),
]
#: Commands of the renderer, for the samples.
SUPPORTED = "frac left right begin end alpha text r".split()


def _expected(samples: list, key: str, table: str) -> str:
    """SQL: the table's keys with the issues of their sample."""
    rows = ", ".join(f"({i}, '{level}', '{code}')" for i, (_, found) in enumerate(samples) for level, code in found)
    return f"SELECT {key}, level, code FROM {table} JOIN (VALUES {rows}) AS v(i, level, code) ON {key} % {len(samples)} = i"


def _sample(samples: list, key: str):
    texts = F.array(*[F.lit(text) for text, _ in samples])
    return F.replace(F.element_at(texts, (F.col(key) % len(samples) + 1).cast("int")), F.lit("#"), F.col(key).cast("string"))


@query(_expected(STRINGS, "p_partkey", "part"))
def string_rules(t):
    rows = t("part").select("p_partkey", _sample(STRINGS, "p_partkey").alias("s"))
    return validate.string_issues(rows, ["p_partkey"], "s", supported=SUPPORTED).select("p_partkey", "level", "code")


def _question(n: int = 1, **change) -> dict:
    return {"number": n, "stem": "What is # ?", "options": [{"label": "A", "content": "#"}, {"label": "B", "content": "2 #"}], "images": [], "sourcePage": 2, "needsReview": False} | change


def _paper(**change) -> str:
    paper = {"formatVersion": 1, "id": "set-#", "title": "Set #", "paper": "Paper 1", "year": "2001", "durationMinutes": 75, "questions": [_question(), _question(2)]} | change
    return json.dumps({k: v for k, v in paper.items() if v is not ...})


def _first(**change) -> str:
    return _paper(questions=[_question(**change), _question(2)])


def _without(key: str) -> str:
    q = _question()
    del q[key]
    return _paper(questions=[q, _question(2)])


def _image(**change) -> str:
    return _first(images=[{"src": "data:image/png;base64,!", "alt": "a drawn line"} | change])


_OPTION = lambda label, content="x": {"label": label, "content": content}
#: Papers and the issues that they have; two questions and 75 minutes are expected.
PAPERS = [
    (_paper(), []), ("[#]", [(E, "root")]), ("no JSON #", [(E, "root")]), (None, [(E, "root")]), (_paper(year=...), [(E, "missing-keys"), (E, "type")]), (_paper(other="#"), [(E, "extra-keys")]), (_paper(solution="#"), [(E, "extra-keys"), (E, "answer-leak")]),
    (_first(hint=1), [(E, "answer-leak"), (E, "question-keys")]), (_paper(formatVersion=2), [(E, "format-version")]), (_paper(formatVersion=True), [(E, "format-version")]), (_paper(id="set #"), [(W, "id-format")]), (_paper(durationMinutes="75"), [(E, "duration")]),
    (_paper(durationMinutes=60), [(E, "duration-mismatch")]), (_paper(questions=[]), [(E, "questions")]), (_paper(questions="#"), [(E, "questions")]), (_paper(questions=[_question()]), [(E, "question-count")]), (_paper(questions=[1, _question(2)]), [(E, "question-type")]),
    (_paper(questions=[_question(2), _question(1)]), [(E, "numbering"), (E, "numbering")]), (_without("images"), [(E, "question-keys"), (E, "images")]), (_first(options=[]), [(E, "options")]), (_first(options=[1, _OPTION("B")]), [(E, "option-type")]),
    (_first(options=[_OPTION("A") | {"x": 1}, _OPTION("B", "#")]), [(E, "option-keys")]), (_first(options=[_OPTION("B"), _OPTION("A", "#")]), [(E, "option-label"), (E, "option-label")]),
    (_first(options=[_OPTION("A", "x #"), _OPTION("B", "x#"), _OPTION("C"), _OPTION("D", "x\n#"), _OPTION("E", " x")]), [(W, "duplicate-option")] * 3), (_first(options=[_OPTION("A", ""), _OPTION("B", " ")]), [(E, "empty"), (E, "empty")]), (_first(images="#"), [(E, "images")]),
    (_first(stem="The diagram # shows"), [(W, "figure-missing")]), (_first(options=[_OPTION("A", "Graph A"), _OPTION("B", "Graph B")]), [(E, "graph-options-missing")]), (_first(sourcePage=0), [(E, "source-page")]), (_first(sourcePage="2"), [(E, "source-page")]), (_first(needsReview="no"), [(E, "needs-review")]),
    (_first(needsReview=True), [(I, "needs-review")]), (_first(stem=5), [(E, "type")]), (_image(), [(E, "image-decode")]), (_image(src="http://a/#.png"), [(E, "image-src")]), (_image(alt="short"), [(E, "image-alt"), (E, "image-decode")]), (_image(more=1), [(E, "image-keys"), (E, "image-decode")]), (_first(images=["#"]), [(E, "image-type")]),
]


@query(_expected(PAPERS, "s_suppkey", "supplier"))
def paper_rules(t):
    rows = t("supplier").select("s_suppkey", _sample(PAPERS, "s_suppkey").alias("json"))
    return validate.paper_issues(rows, "s_suppkey", expected_questions=2, expected_duration=75).select("s_suppkey", "level", "code")


_SIZES = "SELECT c_custkey, 20 + c_custkey % 50 AS w, CASE WHEN c_custkey % 11 = 0 THEN 1500 ELSE 60 END AS h, (20 + c_custkey % 50) * (c_custkey % 5) // 4 AS a, CASE WHEN c_custkey % 7 = 0 THEN 12 WHEN c_custkey % 11 = 0 THEN 1500 ELSE 60 END AS b FROM customer"


@query(f"""SELECT c_custkey, level, code FROM (SELECT c_custkey, unnest([CASE WHEN least(w, h) < 40 THEN {{'level': 'error', 'code': 'image-size'}} END, CASE WHEN a = 0 THEN {{'level': 'error', 'code': 'image-blank'}} END,
  CASE WHEN a > 0 AND a * b / (w * h)::DOUBLE < 0.45 THEN {{'level': 'warning', 'code': 'image-whitespace'}} END, CASE WHEN a > 0 AND h > 842 * 0.55 * 220 / 72 THEN {{'level': 'warning', 'code': 'image-tall'}} END], recursive := true)
  FROM ({_SIZES})) WHERE code IS NOT NULL""")
def picture_papers(t):
    """Papers with a drawn picture each: it is encoded, decoded from its paper and checked."""
    n = F.col("c_custkey")
    w, h = (n % 50 + 20).cast("int"), F.when(n % 11 == 0, 1500).otherwise(60)
    png = framed(w, h, F.floor(w * (n % 5) / 4).cast("int"), F.when(n % 7 == 0, 12).otherwise(h))
    src = F.replace(F.lit(_image(src="@@", alt="a black rectangle")), F.lit("@@"), data_uri(png))
    rows = spread(t("customer").select("c_custkey"), "c_custkey").select("c_custkey", src.alias("json"))
    return validate.image_issues(rows, "c_custkey").select("c_custkey", "level", "code")


@query("""WITH q AS (SELECT conv_id, turn + 1 AS number, text, turn % 4 + 1 AS said FROM conversations), p AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id)
  SELECT conv_id, number AS question, 'error' AS level, CASE WHEN said > n THEN 'beyond' ELSE 'other page' END AS why FROM q JOIN p USING (conv_id) WHERE said > n OR said <> number""")
def source_pages(t):
    """Turns as questions, each printed on the page of its own number, said to be on one of the first four."""
    c = t("conversations")
    number = (F.col("turn") + 1).cast("int")
    questions = c.select("conv_id", number.alias("number"), F.col("text").alias("stem"), (F.col("turn") % 4 + 1).cast("int").alias("sourcePage"))
    found = validate.source_page_issues(questions, c.select("conv_id", number.alias("page"), "text"), c.select("conv_id", number.alias("number"), number.alias("page")), "conv_id")
    return found.select("conv_id", F.col("question").cast("long").alias("question"), "level", F.when(F.col("message").startswith("beyond"), "beyond").otherwise("other page").alias("why"))


@query("""SELECT o_custkey, 'error' AS level, 'katex' AS code, string_agg('line ' || o_orderkey, '; ' ORDER BY 'line ' || o_orderkey) AS message, (o_orderkey % 3)::INT AS question FROM orders GROUP BY o_custkey, o_orderkey % 3""")
def renderer_errors(t):
    """Orders as errors of a renderer in three questions of a customer's paper."""
    o = t("orders").select("o_custkey", (F.col("o_orderkey") % 3).cast("int").alias("question"), F.lit("stem").alias("field"), F.concat(F.lit("line "), F.col("o_orderkey").cast("string")).alias("message"))
    return validate.render_issues(t("customer").select(F.col("c_custkey").alias("o_custkey")), o, "o_custkey").drop("field")


@query("""SELECT o_orderkey, coalesce(reasons, '') AS reasons, reasons IS NOT NULL AS needs_review FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(code, ';' ORDER BY first_, code) AS reasons
  FROM (SELECT l_orderkey, 'c' || l_suppkey % 5 AS code, min(l_linenumber) AS first_ FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL) GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def flagged(t):
    """Line items as issues of their order, those returned or accepted being errors."""
    from foliospark.operators import assemble

    code = F.concat(F.lit("c"), (F.col("l_suppkey") % 5).cast("string"))
    issues = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") != "N", "error").otherwise("warning").alias("level"), code.alias("code"), F.col("l_linenumber").alias("ord"))
    rows = assemble.flag(t("orders").select("o_orderkey"), issues, ["o_orderkey"])
    return rows.select("o_orderkey", F.array_join("review_reasons", ";").alias("reasons"), "needs_review")


@query("""SELECT event_id, unnest(['outer', 'list'] || list_transform(json_keys(props), lambda k: k) || list_transform(json_keys(props), lambda k: k)) AS key,
  unnest(['outer', 'list'] || list_transform(json_keys(props), lambda k: 'outer.' || k) || list_transform(json_keys(props), lambda k: 'list[1][0].' || k)) AS path FROM events""")
def keys_walk(t):
    """All keys of nested JSON made of an event's properties, with their paths."""
    nested = F.concat(F.lit('{"outer": '), "props", F.lit(', "list": [1, ['), "props", F.lit("]]}"))
    return t("events").select("event_id", F.inline(validate.walk_keys(nested)))
