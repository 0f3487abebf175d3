"""Validation rules as column expressions that make issue rows.

``string_issues`` runs all rules over one string column in one pass: each rule makes an array of issues,
one per occurrence where the position counts. ``paper_issues`` checks untrusted JSON papers as VARIANT,
so that wrong types and unknown keys are seen, and runs the string and picture rules over what they hold.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import latex, pixels
from foliospark.functions.text import brace_problem, long_words, short
from foliospark.sources.papers import decode_data_uri

# Text decoded with a wrong code page; words that must have a backslash in maths (error,
# warning) and in text; commands that begin with n; ends of such commands after a newline ate their
# first letter; commands whose argument is prose; words of a stem that speak of a picture.
MOJIBAKE = r"Ã.|â€|Â[^A-Za-z0-9\s]"
BARE_ERROR = (
    "frac dfrac tfrac sqrt binom dbinom infty times cdot leq geq neq mathrm lfloor rfloor lceil rceil ldots cdots rightarrow Rightarrow"
    " approx equiv alpha beta gamma delta theta lambda sigma omega varepsilon epsilon circ pm"
).split()
BARE_WARNING = "sin cos tan sec cosec csc cot log ln exp lim sum int prod pi left right le ge ne max min".split()
BARE_TEXT = "frac dfrac sqrt binom infty leq geq neq mathrm".split()
N_COMMANDS = (
    "nu neq ne nleq ngeq nless ngtr nsubseteq notin ni nmid nparallel neg nabla nexists nearrow nwarrow not negthinspace negmedspace"
    " negthickspace nobreakspace nleqslant ngeqslant ncong nsim"
).split()
EATEN = r"\n(?:eq|e|u|abla|ot|otin|eg|mid|i|leq|geq|subseteq|parallel|less|gtr)(?![A-Za-z])"
TEXT_ARGUMENT = "text textrm textit textbf textsf texttt textnormal mbox hbox operatorname mathrm mathit mathbf mathsf mathtt begin end color textcolor".split()
FIGURE_WORDS = r"(?i)\b(?:diagram|figure|graph|graphs|shown|sketch|table below|following table|shaded)\b"
# The keys of a paper, a question and an image, and keys that give answers away.
PAPER_KEYS = ["formatVersion", "id", "title", "paper", "year", "durationMinutes", "questions"]
QUESTION_KEYS = ["number", "stem", "options", "images", "sourcePage", "needsReview"]
FORBIDDEN = [
    "correctanswer", "correct_answer", "answer", "answers", "answerkey", "answer_key", "correct", "solution", "solutions", "explanation",
    "explanations", "marks", "mark", "reasoning", "workedsolution", "hint", "hints",
]
# Least side of a picture in pixels, least share of its ink box, tallest in pixels.
LEAST_SIDE, LEAST_INK, TALLEST = 40, 0.45, 842 * 0.55 * 220 / 72

_ISSUES = "array<struct<level:string,code:string,message:string>>"
_ODD = r"[\ufffd\p{Cc}\p{Co}\p{Cs}\p{Cf}&&[^\n]]"


def _none() -> Column:
    return F.expr(f"cast(array() as {_ISSUES})")


def _issue(level: str, code: str, message: Column | str) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _rule(level: str, code: str, found: Column, message: Column | str) -> Column:
    return F.when(found, F.array(_issue(level, code, message))).otherwise(_none())


def _kept(issues: Column) -> Column:
    return F.filter(issues, lambda x: x.isNotNull())


def _bare(words: list[str]) -> str:
    return r"(?<![A-Za-z\\])(" + "|".join(words) + r")(?![A-Za-z])"


def character_issues(s: Column) -> Column:
    """One issue for each character that has no place in a paper, with its offset in code points."""
    def one(c: Column, i: Column) -> Column:
        at = F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"), F.lit(" at offset "), i.cast("string"))
        found = (
            F.when(c == "\ufffd", _issue("error", "replacement-char", at)).when(c.rlike(r"\p{Cc}"), _issue("error", "control-char", at))
            .when(c.rlike(r"[\p{Co}\p{Cs}]"), _issue("error", "private-char", at)).otherwise(_issue("error", "invisible-char", at))
        )
        return F.when(~c.between(" ", "~") & c.rlike(_ODD), found)  # the comparison spares most patterns

    return F.when(s.rlike(_ODD), _kept(F.transform(F.split(s, ""), one))).otherwise(_none())


def command_issues(s: Column, known: Iterable[str] | None) -> Column:
    def one(c: Column) -> Column:
        name, letters = c["name"], c["name"].rlike("^[A-Za-z]")
        newline = (name == "n") | (letters & name.startswith("n") & ~name.isin(N_COMMANDS))
        strange = name.isin("t", "r") | (letters & ~name.isin(sorted(known)) if known is not None else F.lit(False))
        return (
            F.when((c["backslashes"] > 1) & letters, _issue("error", "double-backslash", name)).when(c["backslashes"] > 1, _issue("warning", "latex-linebreak", name))
            .when(newline, _issue("error", "literal-backslash-n", F.left(name, F.lit(12)))).when(strange, _issue("warning", "unknown-command", name))
        )

    return F.when(F.contains(s, F.lit("\\")), _kept(F.transform(latex.command_runs(s), one))).otherwise(_none())


def segment_issues(seg: Column, supported: Iterable[str] | None) -> Column:
    """Issues of one part of a string, text or maths."""
    t, is_text = seg["text"], seg["kind"] == "text"
    runs = latex.command_runs(t)
    letters = lambda c: c["name"].rlike("^[A-Za-z]")
    outside = F.filter(runs, lambda c: letters(c) & ~(c["name"].startswith("n") & ~c["name"].isin(N_COMMANDS)))
    first = F.regexp_extract(t, _bare(BARE_TEXT), 1)
    text = F.concat(
        F.transform(outside, lambda c: _issue("error", "command-outside-math", c["name"])),
        _rule("error", "bare-command", first != "", first),
        _rule("warning", "text-braces", brace_problem(t), "braces in text do not balance"),
    )
    plain = F.regexp_replace(t, r"\\(?:" + "|".join(TEXT_ARGUMENT) + r")(?![A-Za-z])\s*\{[^{}]*\}", " ")
    hits = lambda words: F.regexp_extract_all(plain, F.lit(_bare(words)), F.lit(1))
    count = lambda side: F.size(F.filter(runs, lambda c: (c["backslashes"] == 1) & (c["name"] == side)))
    where = short(F.replace(t, F.lit("\n"), F.lit(" ")))
    unsupported = F.filter(runs, lambda c: (c["backslashes"] == 1) & letters(c) & ~c["name"].isin(sorted(supported))) if supported else None
    maths = F.concat(
        _rule("error", "eaten-backslash-n", t.rlike(EATEN), where),
        *([F.transform(unsupported, lambda c: _issue("error", "katex-unsupported", c["name"]))] if supported else []),
        _rule("error", "brace-balance", brace_problem(t), where),
        _rule("error", "left-right", count("left") != count("right"), where),
        _rule("error", "environment", ~latex.environments_balance(t), where),
        F.transform(hits(BARE_ERROR), lambda w: _issue("error", "bare-command", w)),
        F.transform(hits(BARE_WARNING), lambda w: _issue("warning", "bare-function", w)),
        _rule("warning", "newline-in-inline-math", (seg["kind"] == "inline") & F.contains(t, F.lit("\n")), where),
        _rule("warning", "environment-used", t.rlike(r"\\begin\s*\{"), where),
    )
    return F.when(is_text, text).otherwise(maths)


def string_issues(rows: DataFrame, keys: list[str], text: str, known: Iterable[str] | None = None, supported: Iterable[str] | None = None) -> DataFrame:
    """keys, ord, level, code, message. A blank string has that issue alone; a null has type.

    known: commands that are no misspelling; without it only those that lost a letter to an escape are
    unknown. supported: commands of the renderer; without it that rule is skipped.
    """
    s = F.col("_s")
    held = rows.select(*keys, F.col(text).alias("_s"))
    maths = F.contains(s, F.lit("$"))
    only_text = F.array(F.struct(F.lit("text").alias("kind"), s.alias("text"), F.lit(0).alias("offset")))
    seen = F.when(maths, s)  # Python gets only strings with maths
    held = held.withColumn("_m", latex.math_parts(seen))
    held = held.select("*", F.when(maths, F.col("_m.segments")).otherwise(only_text).alias("_segs"), F.when(maths, F.col("_m.problems")).alias("_problems"))
    found = F.concat(
        character_issues(s),
        _rule("warning", "mojibake", s.rlike(MOJIBAKE), "looks like text in a wrong code page"),
        command_issues(s, known),
        F.coalesce(F.transform("_problems", lambda p: _issue("error", "dollar-balance", F.concat(p["problem"], F.lit(" at offset "), p["offset"].cast("string")))), _none()),
        F.flatten(F.transform("_segs", lambda seg: segment_issues(seg, supported))),
    )
    found = F.when(s.isNull(), F.array(_issue("error", "type", "not a string"))).when(s.rlike(r"^\s*\z"), F.array(_issue("error", "empty", "the string is empty"))).otherwise(found)
    return held.select(*keys, F.posexplode(found).alias("ord", "i")).select(*keys, "ord", "i.*")


def summary(issues: DataFrame, keys: list[str]) -> DataFrame:
    by = issues.groupBy(*keys).agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    return by.withColumn("ok", F.col("errors") == 0)


def picture_rules(width: Column, height: Column, ink: Column) -> Column:
    """Issues of a decoded picture, from its size and the area of its ink box (null without ink)."""
    return F.concat(
        _rule("error", "image-size", F.least(width, height) < LEAST_SIDE, F.concat_ws("x", width.cast("string"), height.cast("string"))),
        F.when(ink.isNull(), F.array(_issue("error", "image-blank", "the picture is blank"))).otherwise(
            F.concat(
                _rule("warning", "image-whitespace", ink / (width.cast("double") * height) < LEAST_INK, "mostly white space"),
                _rule("warning", "image-tall", height > TALLEST, "taller than half a page"),
            )
        ),
    )


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _list(name: str, path: str) -> Column:
    return F.coalesce(F.try_variant_get(name, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))


def _string(name: str, path: str) -> Column:
    v = F.try_variant_get(name, path, "variant")
    return F.when(_kind(v) == "STRING", F.try_variant_get(name, path, "string"))


def _keys(v: Column) -> Column:
    return F.json_object_keys(F.to_json(v))


def keys_of(x, path: str = "") -> Iterator[tuple[str, str]]:
    """(key, path) of every object in a parsed JSON value, in its order; paths are written a.b[0].c."""
    todo = [(x, path)]
    while todo:
        x, path = todo.pop()
        if isinstance(x, dict):
            inner = [(k, f"{path}.{k}" if path else k, v) for k, v in x.items()]
            yield from ((k, at) for k, at, _ in inner)
            todo += [(v, at) for _, at, v in reversed(inner)]
        elif isinstance(x, list):
            todo += [(v, f"{path}[{i}]") for i, v in reversed([*enumerate(x)])]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("path", T.StringType())])))
def walk_keys(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The keys of JSON texts at any depth, with their paths; null for a text that is no JSON."""

    def walk(s: str | None) -> list[dict] | None:
        try:
            return [{"key": k, "path": p} for k, p in keys_of(json.loads(s))]
        except (TypeError, ValueError, RecursionError):
            return None

    for x in text:
        yield x.map(walk)


def _names(names: list[str]) -> Column:
    return F.array(*map(F.lit, names))


def _questions(papers: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, question, q: the questions of papers that are objects with a list of them."""
    rows = papers.select(key, F.try_parse_json(F.col(text)).alias("v"))
    # No filter on v, which would be pushed below and parse the text, and make it, again: null has no rows.
    q = rows.select(key, F.posexplode(F.try_variant_get("v", "$.questions", "array<variant>")).alias("pos", "q"))
    whole = _kind(F.try_variant_get("q", "$.number", "variant")) == "BIGINT"
    return q.withColumn("question", F.when(whole, F.try_variant_get("q", "$.number", "int")).otherwise(F.col("pos") + 1))


def paper_strings(papers: DataFrame, key: str = "paper_id", text: str = "json") -> DataFrame:
    """key, pos, question, field, place, s: every string that the string rules check; s is null where the
    paper holds something else. pos is -1 for the paper's own."""
    rows = papers.select(key, F.try_parse_json(F.col(text)).alias("v")).where(_kind(F.col("v")).startswith("OBJECT"))
    own = F.array(*[F.struct(F.lit(k).alias("field"), F.lit(i).alias("place"), _string("v", f"$.{k}").alias("s")) for i, k in enumerate(PAPER_KEYS[1:5])])
    top = rows.select(key, F.lit(-1).alias("pos"), F.lit(None).cast("int").alias("question"), F.inline(own))
    q = _questions(papers, key, text).where(_kind(F.col("q")).startswith("OBJECT"))
    stem = q.select(key, "pos", "question", F.lit("stem").alias("field"), F.lit(0).alias("place"), _string("q", "$.stem").alias("s"))
    o = q.select(key, "pos", "question", F.posexplode(_list("q", "$.options")).alias("i", "o")).where(_kind(F.col("o")).startswith("OBJECT"))
    field = F.concat(F.lit("option "), F.coalesce(_string("o", "$.label"), (F.col("i") + 1).cast("string")))
    options = o.select(key, "pos", "question", field.alias("field"), (F.col("i") + 1).alias("place"), _string("o", "$.content").alias("s"))
    return top.unionByName(stem).unionByName(options)


def image_issues(papers: DataFrame, key: str = "paper_id", text: str = "json") -> DataFrame:
    """key, pos, question, field, level, code, message for the pictures of questions, at any size that
    decodes (see pixels.MAX_PIXELS)."""
    q = _questions(papers, key, text).where(_kind(F.col("q")).startswith("OBJECT"))
    rows = q.select(key, "pos", "question", F.posexplode(_list("q", "$.images")).alias("i", "p")).withColumn("is", _kind(F.col("p")).startswith("OBJECT"))
    rows = rows.withColumns({"src": F.when(F.col("is"), _string("p", "$.src")), "alt": F.when(F.col("is"), _string("p", "$.alt"))})
    is_png = F.coalesce(F.col("src").startswith("data:image/png;base64,"), F.lit(False))
    rows = rows.withColumn("is_png", is_png).withColumn("m", pixels.measures(decode_data_uri(F.col("src"))))
    ink = (F.col("m.ink_x1") - F.col("m.ink_x0")).cast("double") * (F.col("m.ink_y1") - F.col("m.ink_y0"))
    pixel = F.when(F.col("m.width").isNull(), F.array(_issue("error", "image-decode", "does not decode as PNG"))).otherwise(picture_rules(F.col("m.width"), F.col("m.height"), ink))
    found = F.concat(
        _rule("error", "image-keys", F.size(F.array_except(_keys(F.col("p")), _names(["src", "alt"]))) > 0, "unexpected keys"),
        _rule("error", "image-alt", F.coalesce(F.length(F.regexp_replace("alt", r"^\s+|\s+\z", "")) < 8, F.lit(True)), "the description is missing or too short"),
        F.when(F.col("is_png"), pixel).otherwise(F.array(_issue("error", "image-src", "no PNG data URI"))),
    )
    found = F.when(F.col("is"), found).otherwise(F.array(_issue("error", "image-type", "not an object")))
    return rows.select(key, "pos", "question", F.concat(F.lit("images["), F.col("i").cast("string"), F.lit("]")).alias("field"), (F.col("i") * 10).alias("base"), F.posexplode(found).alias("k", "x")).select(
        key, "pos", "question", "field", (F.col("base") + F.col("k")).alias("k"), "x.*"
    )


def paper_issues(
    papers: DataFrame, key: str = "paper_id", text: str = "json", expected_questions: int | None = None, expected_duration: int | None = None,
    known: Iterable[str] | None = None, supported: Iterable[str] | None = None,
) -> DataFrame:
    """key, ord, level, code, message, question, field for JSON papers in a text column.

    Text that is no JSON object, or that repeats a key, has the issue root alone; questions that are no
    list end a paper's checks. A question with a number that is no integer goes by its position. ord
    follows the order of the checks: the paper, then each question's own, strings, options, pictures.
    """
    rows = papers.select(key, F.col(text).alias("_t"), F.try_parse_json(F.col(text)).alias("v")).withColumn("keys", F.json_object_keys("_t"))
    is_root = F.coalesce(_kind(F.col("v")).startswith("OBJECT") & F.col("keys").isNotNull(), F.lit(False))
    get = lambda path, t: F.try_variant_get("v", path, t)
    text_keys = F.regexp_extract_all(F.lower("_t"), F.lit(r'"([a-z_-]+)"\s*:'), F.lit(1))
    leaks = F.filter(text_keys, lambda k: F.replace(k, F.lit("-"), F.lit("")).isin(FORBIDDEN))
    is_list = _kind(get("$.questions", "variant")).startswith("ARRAY")
    n = F.size(_list("v", "$.questions"))
    minutes = _kind(get("$.durationMinutes", "variant")) == "BIGINT"
    positive = minutes & F.coalesce(get("$.durationMinutes", "int") > 0, F.lit(False))
    missing, extra = F.array_except(_names(PAPER_KEYS), "keys"), F.array_except("keys", _names(PAPER_KEYS))
    listed = lambda a: F.array_join(a, ", ")
    top_rules = F.concat(
        _rule("error", "missing-keys", F.size(missing) > 0, listed(missing)),
        _rule("error", "extra-keys", F.size(extra) > 0, listed(extra)),
        F.transform(leaks, lambda k: _issue("error", "answer-leak", k)),
        _rule("error", "format-version", ~((_kind(get("$.formatVersion", "variant")) == "BIGINT") & F.coalesce(get("$.formatVersion", "int") == 1, F.lit(False))), "not the integer 1"),
        _rule("warning", "id-format", _string("v", "$.id").rlike(r"\s"), "white space in the id"),
        _rule("error", "duration", ~positive, "no positive integer"),
        _rule("error", "duration-mismatch", positive & (get("$.durationMinutes", "int") != F.lit(expected_duration)), "not as printed"),
        _rule("error", "questions", ~(is_list & (n > 0)), "no list of questions"),
        _rule("error", "question-count", is_list & (n > 0) & (n != F.lit(expected_questions)), "not as many as printed"),
    )
    top = rows.select(key, F.posexplode(F.when(is_root, top_rules).otherwise(F.array(_issue("error", "root", "no JSON object")))).alias("k", "i"))
    no_int = F.lit(None).cast("int")
    top = top.select(key, F.lit(-1).alias("pos"), F.lit(0).alias("part"), "k", no_int.alias("question"), F.lit(None).cast("string").alias("field"), "i.*")

    usable = papers.where(F.json_object_keys(text).isNotNull())
    q = _questions(usable, key, text)
    qget = lambda path, t: F.try_variant_get("q", path, t)
    qkind = lambda path: _kind(qget(path, "variant"))
    is_object = _kind(F.col("q")).startswith("OBJECT")
    qkeys = _keys(F.col("q"))
    q_missing, q_extra = F.array_except(_names(QUESTION_KEYS), qkeys), F.array_except(qkeys, _names(QUESTION_KEYS))
    options = _list("q", "$.options")

    def option_rules(o: Column, i: Column) -> Column:
        label, keys = F.try_variant_get(o, "$.label", "string"), _keys(o)
        odd_keys = (F.size(F.array_except(keys, _names(["label", "content"]))) > 0) | (F.size(keys) != 2)
        rules = F.concat(_rule("error", "option-keys", odd_keys, listed(keys)), _rule("error", "option-label", ~label.eqNullSafe(F.char(i + 65)), F.coalesce(label, F.lit("none"))))
        return F.when(_kind(o).startswith("OBJECT"), rules).otherwise(F.array(_issue("error", "option-type", "not an object")))

    contents = F.transform(options, lambda o: F.coalesce(F.regexp_replace(F.try_variant_get(o, "$.content", "string"), r"\s+", ""), F.lit("")))
    named = F.transform(options, lambda o: F.coalesce(F.try_variant_get(o, "$.label", "string"), F.lit("none")))

    def repeat(c: Column, i: Column) -> Column:  # an option that says what an earlier one says
        first_at = F.array_position(contents, c)
        holder = F.concat(F.lit("options "), F.get(named, (first_at - 1).cast("int")), F.lit(" and "), F.get(named, i), F.lit(" are equal"))
        return F.when((c != "") & (first_at <= i), _issue("warning", "duplicate-option", holder))

    stem, spoken = F.coalesce(_string("q", "$.stem"), F.lit("")), F.array_join(F.transform(options, lambda o: F.try_variant_get(o, "$.content", "string")), " ")
    no_images = F.size(_list("q", "$.images")) == 0
    first = F.concat(
        _rule("error", "numbering", ~((qkind("$.number") == "BIGINT") & F.coalesce(qget("$.number", "int") == F.col("pos") + 1, F.lit(False))), "numbers must follow on"),
        _rule("error", "question-keys", F.size(q_missing) > 0, listed(q_missing)),
        _rule("error", "question-keys", F.size(q_extra) > 0, listed(q_extra)),
    )
    last = F.concat(
        _rule("error", "options", ~(qkind("$.options").startswith("ARRAY") & (F.size(options) > 0)), "no options"),
        F.flatten(F.transform(options, option_rules)),
        _kept(F.transform(contents, repeat)),
        _rule("error", "images", ~qkind("$.images").startswith("ARRAY"), "no list"),
        _rule("warning", "figure-missing", no_images & stem.rlike(FIGURE_WORDS), "the stem speaks of a picture"),
        _rule("error", "graph-options-missing", no_images & spoken.rlike(r"(?i)\bgraph\s*\(?[A-H]\)?"), "the options speak of graphs"),
        _rule("error", "source-page", ~((qkind("$.sourcePage") == "BIGINT") & F.coalesce(qget("$.sourcePage", "int") >= 1, F.lit(False))), "no positive integer"),
        _rule("error", "needs-review", qkind("$.needsReview") != "BOOLEAN", "neither true nor false"),
        _rule("info", "needs-review", (qkind("$.needsReview") == "BOOLEAN") & qget("$.needsReview", "boolean"), "flagged for review"),
    )
    none = _none()
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.when(is_object, first).otherwise(F.array(_issue("error", "question-type", "not an object"))).alias("i")),
        F.struct(F.lit(2).alias("part"), F.when(is_object, last).otherwise(none).alias("i")),
    )
    per = q.select(key, "pos", "question", F.inline(parts)).select(key, "pos", "part", "question", F.posexplode("i").alias("k", "x"))
    per = per.select(key, "pos", "part", "k", F.when(F.col("x.code") == "question-type", no_int).otherwise(F.col("question")).alias("question"), F.lit(None).cast("string").alias("field"), "x.*")
    strings = string_issues(paper_strings(usable, key, text), [key, "pos", "question", "field", "place"], "s", known, supported)
    strings = strings.select(key, "pos", F.lit(1).alias("part"), (F.col("place") * 100_000 + F.col("ord")).alias("k"), "question", "field", "level", "code", "message")
    images = image_issues(usable, key, text).select(key, "pos", F.lit(3).alias("part"), "k", "question", "field", "level", "code", "message")
    every = top.unionByName(per).unionByName(strings).unionByName(images)
    ord_ = ((F.col("pos") + 1).cast("long") * 4 + F.col("part")) * F.lit(10_000_000_000) + F.col("k")
    return every.select(key, ord_.alias("ord"), "level", "code", "message", "question", "field")


def source_page_issues(questions: DataFrame, pages: DataFrame, anchors: DataFrame, key: str = "paper_id") -> DataFrame:
    """key, level, code, message, question: questions(key, number, stem, sourcePage) against the print,
    pages(key, page, text) and anchors(key, number, page). Papers without pages are not checked."""
    count = pages.groupBy(key).agg(F.max("page").alias("n_pages"), F.max((F.trim("text") != "").cast("int")).alias("has_text"))
    rows = questions.where("sourcePage >= 1").join(count, key).join(anchors.select(key, "number", F.col("page").alias("anchor")), [key, "number"], "left")
    rows = rows.join(pages.select(key, F.col("page").alias("sourcePage"), F.col("text").alias("printed")), [key, "sourcePage"], "left")
    words = long_words(F.col("stem"))
    share = F.size(F.array_intersect(words, long_words(F.coalesce("printed", F.lit(""))))) / F.nullif(F.size(words), F.lit(0))
    found = (
        F.when(F.col("sourcePage") > F.col("n_pages"), _issue("error", "source-page", "beyond the last page"))
        .when(F.col("anchor").isNotNull(), F.when(F.col("anchor") != F.col("sourcePage"), _issue("error", "source-page", "the number is printed on another page")))
        .when((F.col("has_text") == 1) & (share < 0.5), _issue("warning", "source-page", "under half of the stem's words are on the page"))
    )
    return rows.select(key, F.col("number").alias("question"), found.alias("i")).where("i is not null").select(key, "i.*", "question")


def render_issues(papers: DataFrame, errors: DataFrame | None, key: str = "paper_id") -> DataFrame:
    """key, level, code, message, question, field from a renderer's errors(key, question, field, message),
    messages of one field joined; without a renderer each paper has katex-skipped."""
    if errors is None:
        return papers.select(key, F.lit("info").alias("level"), F.lit("katex-skipped").alias("code"), F.lit("no renderer").alias("message"), F.lit(None).cast("int").alias("question"), F.lit(None).cast("string").alias("field"))
    by = errors.groupBy(key, "question", "field").agg(F.array_join(F.array_sort(F.collect_list("message")), "; ").alias("message"))
    return papers.select(key).join(by, key).select(key, F.lit("error").alias("level"), F.lit("katex").alias("code"), "message", "question", "field")
