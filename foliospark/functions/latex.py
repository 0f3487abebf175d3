"""LaTeX-in-text scalars: maths segments, commands, balances."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


_PARTS = T.StructType([
    T.StructField("segments", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("offset", T.IntegerType())]))),
    T.StructField("problems", T.ArrayType(T.StructType([T.StructField("problem", T.StringType()), T.StructField("offset", T.IntegerType())]))),
])
_MARK = re.compile(r"[\\${}]")


def segments(s: str | None) -> tuple[list[tuple[str, str, int]], list[tuple[str, int]]]:
    """(kind, text, offset) of text, inline and display parts, offset being that of text, and (problem, offset
    of the dollar sign).

    One fold over backslashes, dollar signs and braces. In text only a dollar sign counts, escaped or not:
    it opens maths, display maths if doubled. In maths a backslash hides the character after it, braces are
    counted, and the same mark with no brace open closes; so an open brace can hide it, and what is not
    closed is text. Problems: such maths, an escaped dollar sign that opens, a single one in display maths,
    maths without content.
    """
    s = s or ""
    parts, problems = [], []
    done = upto = 0  # what is in parts already, and where marks count again
    mark, begun, depth = "", 0, 0  # the open maths, if mark
    for m in _MARK.finditer(s):
        at, c = m.start(), m[0]
        if at < upto:
            continue
        if not mark:
            if c == "$":
                mark, begun, depth = s[at : at + 2] if s[at + 1 : at + 2] == "$" else c, at, 0
                upto = at + len(mark)
        elif c == "\\":
            upto = at + 2
        elif c != "$":
            depth += 1 if c == "{" else -1
        elif depth <= 0 and s.startswith(mark, at):
            inner = begun + len(mark)
            parts += [("text", s[done:begun], done)] * (done < begun) + [("display" if mark == "$$" else "inline", s[inner:at], inner)]
            flaws = {"escaped-dollar": s[:begun].endswith("\\"), "single-dollar": mark == "$$" and re.search(r"(?<!\\)\$", s[inner:at]), "empty": not s[inner:at].strip()}
            problems += [(name, begun) for name, found in flaws.items() if found]
            done = upto = at + len(mark)
            mark = ""
    if mark:
        problems.append(("unclosed", begun))
    return parts + [("text", s[done:], done)] * (done < len(s)), problems


@F.pandas_udf(_PARTS)
def math_parts(s: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Both results of segments, from one reading of each string."""
    for x in s:
        found = [segments(t) for t in x]
        yield pd.DataFrame({
            "segments": [[{"kind": k, "text": b, "offset": o} for k, b, o in parts] for parts, _ in found],
            "problems": [[{"problem": p, "offset": o} for p, o in flaws] for _, flaws in found],
        })


def commands(s: Column) -> Column:
    """Names of commands with one backslash."""
    return F.regexp_extract_all(s, F.lit(r"(?<!\\)\\([A-Za-z]+)"), F.lit(1))


def command_runs(s: Column) -> Column:
    """Array of (backslashes, name): every run of backslashes with the letters, or the one sign, after it."""
    run = r"(?s)(\\+)([A-Za-z]+|[^A-Za-z\\]?)"
    part = lambda n: F.regexp_extract_all(s, F.lit(run), F.lit(n))
    return F.zip_with(part(1), part(2), lambda b, name: F.struct(F.length(b).alias("backslashes"), name.alias("name")))


def environments_balance(m: Column) -> Column:
    """Whether begin and end nest: a fold with a stack of names."""
    marks = F.regexp_extract_all(m, F.lit(r"\\(?:begin|end)\{[^{}]*\}"), F.lit(0))
    start = F.struct(F.lit(True).alias("ok"), F.expr("cast(array() as array<string>)").alias("open"))

    def step(a: Column, x: Column) -> Column:
        name = F.regexp_extract(x, r"\{([^{}]*)\}", 1)
        fits = (F.size(a["open"]) > 0) & F.coalesce(F.get(a["open"], F.size(a["open"]) - 1) == name, F.lit(False))
        shorter = F.slice(a["open"], F.lit(1), F.greatest(F.size(a["open"]) - 1, F.lit(0)))
        return F.when(x.startswith("\\begin"), F.struct(a["ok"].alias("ok"), F.concat(a["open"], F.array(name)).alias("open"))).otherwise(F.struct((a["ok"] & fits).alias("ok"), shorter.alias("open")))

    return F.aggregate(marks, start, step, lambda a: a["ok"] & (F.size(a["open"]) == 0))
