"""Text scalars of the engine as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number words that the engine reads, and code points without width.
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())} | {"twenty-five": 25, "thirty": 30, "thirty-five": 35, "forty": 40, "fifty": 50}
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
_NUMBER = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))


def clean_text(s: Column) -> Column:
    return F.translate(s, ZERO_WIDTH, "")


def words_to_int(w: Column) -> Column:
    """A number written in digits or as a word, else null."""
    w = F.lower(F.trim(w))
    names = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    return F.coalesce(F.when(w.rlike(r"^[0-9]{1,9}\z"), w.try_cast("int")), names[w])


def parse_duration(s: Column) -> Column:
    """Minutes: hours with minutes, then minutes, then hours, of which words count up to three."""
    t = F.lower(s)
    hour = r"([0-9]+(?:\.[0-9]+)?|one|two|three)\s*-?\s*h(?:ou)?rs?"
    value = lambda g: F.coalesce(F.when(g == "one", 1.0).when(g == "two", 2.0).when(g == "three", 3.0), F.when(g.rlike(r"^[0-9.]+\z"), g.try_cast("double")))
    both_h, both_m = F.regexp_extract(t, hour + r"(?:\s*(?:and|,))?\s*([0-9]+)\s*min", 1), F.regexp_extract(t, hour + r"(?:\s*(?:and|,))?\s*([0-9]+)\s*min", 2)
    minutes, hours = F.regexp_extract(t, r"([0-9]+)\s*-?\s*min", 1), F.regexp_extract(t, hour, 1)
    return F.coalesce(
        F.when(both_h != "", F.bround(value(both_h) * 60).cast("int") + both_m.try_cast("int")),
        F.when(minutes != "", minutes.try_cast("int")),
        F.when(hours != "", F.bround(value(hours) * 60).cast("int")),
    )


def parse_question_count(s: Column) -> Column:
    """The first number, in digits or as a word, before "[multiple-choice] questions"."""
    found = F.regexp_extract_all(F.lower(s), F.lit(rf"\b([0-9]+|{_NUMBER}|[a-z]+)\s+(?:multiple[- ]choice\s+)?questions\b"), F.lit(1))
    return F.get(F.filter(F.transform(found, words_to_int), lambda n: n.isNotNull()), F.lit(0))


def furniture_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(s)), "[0-9]", "#")


def numeric_as_maths(s: Column) -> Column:
    t = F.trim(s)
    number = r"-?[0-9]+(?:\.[0-9]+)?"
    return F.when(t.rlike(rf"^(?:{number}|[0-9]+!|\(\s*{number}\s*,\s*{number}\s*\))\z"), F.concat(F.lit("$"), t, F.lit("$"))).otherwise(s)


def short(s: Column, n: int = 40) -> Column:
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.left(s, F.lit(n - 1)), F.lit("…")))


def long_words(s: Column) -> Column:
    """Distinct words of four or more letters, outside of maths, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(s, r"(?s)\$\$.*?\$\$|\$.*?\$", " ")), F.lit("[a-z]{4,}"), F.lit(0)))


def safe_name(s: Column) -> Column:
    base = F.element_at(F.split(s, r"[\\/]"), -1)
    kept = F.left(F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""), F.lit(120))
    return F.when(kept == "", "file").otherwise(kept)


@F.pandas_udf(T.StringType())
def nfkd_ascii(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in s:
        yield x.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


@F.pandas_udf(T.StringType())
def nfkc(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in s:
        yield x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def name_words(title: Column, paper: Column) -> Column:
    """The words of a title, and of the paper's name unless the title holds it, spaces and case aside."""
    words = F.regexp_extract_all(title, F.lit("[A-Za-z0-9]+"), F.lit(0))
    more = F.regexp_extract_all(F.coalesce(paper, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    bare = lambda s: F.replace(F.lower(s), F.lit(" "), F.lit(""))
    return F.when(F.contains(bare(title), bare(F.coalesce(paper, F.lit("")))), words).otherwise(F.concat(words, more))


def paper_id(title: Column, paper: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.array_join(name_words(title, paper), "-")), F.lit("")), F.lit("paper"))


def paper_filename(title: Column, paper: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(F.array_join(name_words(title, paper), "_"), F.lit("")), F.lit("paper")), F.lit(".json"))


def brace_problem(s: Column) -> Column:
    """True if braces do not balance: escapes are skipped, and a closing brace needs an open one."""
    marks = F.regexp_extract_all(F.regexp_replace(s, r"(?s)\\.", ""), F.lit("[{}]"), F.lit(0))
    depth = F.aggregate(marks, F.lit(0), lambda a, x: F.when(a < 0, a).when(x == "{", a + 1).otherwise(a - 1))
    return depth != 0
