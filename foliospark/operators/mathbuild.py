"""Two-dimensional maths to LaTeX in text, from glyph and rule tables.

One group is one question. A question's glyphs form a small tree: rules claim what stands over and
under them (a fraction, a root or a bar), the widest last, so that inner fractions are built first;
what is left on a line is read from left to right, where smaller glyphs off the base line are
superscripts and subscripts. Runs with maths in them are put in dollar signs. Each line of a question
is at most a few hundred glyphs, so a group is small; groups are dealt by (paper, question).
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of the layout, as shares of the body size.
SCRIPT_SIZE, WORD_GAP, LINE_STEP, RAISED, LOWERED = 0.86, 0.17, 0.35, 0.18, 0.08
# Characters that have a command.
COMMANDS = {
    "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "θ": r"\theta", "λ": r"\lambda", "μ": r"\mu", "π": r"\pi", "σ": r"\sigma", "φ": r"\phi", "ω": r"\omega", "Σ": r"\Sigma", "Δ": r"\Delta",
    "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "×": r"\times", "÷": r"\div", "±": r"\pm", "·": r"\cdot", "∞": r"\infty", "∈": r"\in", "→": r"\to", "∑": r"\sum", "∫": r"\int", "∏": r"\prod", "−": "-",
}
# Function words, and those of them that have no command.
FUNCTIONS = frozenset("arcsin arccos arctan sinh cosh tanh sin cos tan sec cosec csc cot log ln exp lim max min det gcd lcm hcf deg arg".split())
NO_COMMAND = frozenset(["lcm", "hcf"])
# Operators with limits above and below; how a numbered statement begins.
BIG = {"∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∮": r"\oint", "⋃": r"\bigcup", "⋂": r"\bigcap"}
STATEMENT = re.compile(r"(?:(?:I{1,3}|IV|VI{0,3}|IX|X)\.?|\((?:[a-h]|i{1,3}|iv|vi{0,3}|\d{1,2})\)|(?:[a-h]|i{1,3}|iv)\)|\d{1,2}[.)]|[PQRS]:)(?=\s)")
_SIGNS = set("+-=<>/^|!") | set(COMMANDS)


@dataclass
class Piece:
    """A glyph, or something built: its box, base line, size, LaTeX, and whether it is maths."""

    x0: float
    y0: float
    x1: float
    y1: float
    base: float
    size: float
    tex: str
    maths: bool
    space: bool = False
    text: bool = False
    page: int = 1
    up: list = field(default_factory=list)
    down: list = field(default_factory=list)


def _built(parts: list[Piece], tex: str, base: float, rule=None) -> Piece:
    xs = [rule.x0, rule.x1] if rule else []
    return Piece(min([p.x0 for p in parts] + xs), min(p.y0 for p in parts), max([p.x1 for p in parts] + xs), max(p.y1 for p in parts), base, max(p.size for p in parts), tex, True, parts[0].space, page=parts[0].page)


def _braced(tex: str) -> str:
    return "{" + tex + "}"


def read_row(parts: list[Piece]) -> list[Piece]:
    """Pieces of one line from left to right, scripts attached to what they follow."""
    row: list[Piece] = []
    parts = sorted(parts, key=lambda p: (p.x0, p.x1))
    body = max((p.size for p in parts), default=1.0)
    full = [p.base for p in parts if p.size >= SCRIPT_SIZE * body]
    base = median(full) if full else 0.0
    for p in parts:
        small, rise = p.size < SCRIPT_SIZE * body, (base - p.base) / body
        if row and small and rise > RAISED:
            row[-1].up.append(p)
        elif row and small and rise < -LOWERED:
            row[-1].down.append(p)
        else:
            row.append(p)
    return row


def function_words(row: list[Piece]) -> list[Piece]:
    """row with upright letters that make a function word as one piece with its command. A word is a run of
    letters side by side, with scripts at its end at most; part of a longer word is none."""
    letter = lambda p: not p.maths and len(p.tex) == 1 and p.tex.isascii() and p.tex.isalpha()
    ends = [not (letter(a) and letter(b)) or b.x0 - a.x1 > WORD_GAP * b.size or b.space or bool(a.up or a.down) for a, b in itertools.pairwise(row)]
    word_of = list(itertools.accumulate(ends, initial=0)) if row else []
    out: list[Piece] = []
    for _, group in itertools.groupby(zip(word_of, row, strict=True), key=lambda x: x[0]):
        word = [p for _, p in group]
        name = "".join(p.tex for p in word)
        if len(word) > 1 and name in FUNCTIONS:
            new = _built(word, "\\operatorname{" + name + "}" if name in NO_COMMAND else "\\" + name, word[0].base)
            new.up, new.down = word[-1].up, word[-1].down
            word = [new]
        out += word
    return out


def row_tex(parts: list[Piece]) -> str:
    out = ""
    for p in function_words(read_row(parts)):
        tex = _with_scripts(p)
        out += " " + tex if tex[:1].isalpha() and re.search(r"\\[A-Za-z]+\Z", out) else tex
    return out


def _with_scripts(p: Piece) -> str:
    tex = p.tex
    if p.down:
        tex += "_" + _script(p.down)
    if p.up:
        tex += "^" + _script(p.up)
    return tex


def _script(parts: list[Piece]) -> str:
    tex = row_tex(parts)
    return tex if len(tex) == 1 else _braced(tex)


def big_operators(pieces: list[Piece], body: float) -> list[Piece]:
    """pieces with each big operator and the limits over and under it as one piece. What runs on to the
    right of the sign is no limit: those are scripts, which reading a row attaches."""
    for op in [p for p in pieces if p.tex in BIG.values()]:
        middle, high = (op.y0 + op.y1) / 2, op.y1 - op.y0
        small = [p for p in pieces if p is not op and p.page == op.page and p.size < SCRIPT_SIZE * max(op.size, body)]
        column = [p for p in small if p.x0 >= op.x0 - 2 and p.x1 <= op.x1 + 2]
        sides = [
            [p for p in column if (p.y0 + p.y1) / 2 < middle - 0.25 * high and p.y1 >= op.y0 - 1.1 * body],
            [p for p in column if (p.y0 + p.y1) / 2 > middle + 0.25 * high and p.y0 <= op.y1 + 1.1 * body],
        ]
        right = [p for p in small if p.x0 > op.x1 - 0.5]
        over, under = ([] if any(abs(r.base - p.base) < 0.2 * body and 0 <= r.x0 - p.x1 < 0.3 * body for r in right if r not in side for p in side) else side for side in sides)
        tex = op.tex + ("_" + _script(under) if under else "") + ("^" + _script(over) if over else "")
        base = middle + 0.25 * body if high > 1.2 * body else op.base
        new = _built([op, *over, *under], tex, base)
        new.size = max(op.size, body)
        pieces = [p for p in pieces if p is not op and p not in over and p not in under] + [new]
    return pieces


def underlines(pieces: list[Piece], rule, body: float) -> bool:
    """Whether a rule is a line under text: just below the base line of pieces of body size, which go on
    past one of its ends."""
    plain = [p for p in pieces if abs(p.size - body) < 0.15 * body]
    over = [p.base for p in plain if p.x0 >= rule.x0 - 1 and p.x1 <= rule.x1 + 1 and 0 <= rule.y - p.base < 0.25 * body]
    if not over:
        return False
    base = median(over)
    return any(abs(p.base - base) < 0.1 * body and (0 <= rule.x0 - p.x1 < 1.5 * body or 0 <= p.x0 - rule.x1 < 1.5 * body) for p in plain)


def apply_rule(pieces: list[Piece], rule, problems: list[str]) -> list[Piece]:
    """pieces with what the rule claims replaced by a fraction, a root or a bar."""
    inside = [p for p in pieces if p.x0 >= rule.x0 - 1 and p.x1 <= rule.x1 + 1]
    size = max((p.size for p in inside), default=1.0)
    over = [p for p in inside if p.y1 <= rule.y + 0.3 * size and rule.y - p.y1 < 1.2 * size]
    under = [p for p in inside if p not in over and p.y0 >= rule.y - 0.3 * size and p.y0 - rule.y < 1.2 * size]
    signs = [p for p in pieces if p.tex == "√" and abs(p.x1 - rule.x0) <= 0.35 * p.size and p.y0 <= rule.y + 0.5 * p.size <= p.y1 + p.size]
    if signs and under:
        new = _built([signs[0], *under], r"\sqrt" + _braced(row_tex(under)), max(p.base for p in under))
        return [p for p in pieces if p is not signs[0] and p not in under] + [new]
    if over and under:
        middle = rule.y + 0.25 * size
        new = _built([*over, *under], r"\frac" + _braced(row_tex(over)) + _braced(row_tex(under)), middle, rule)
        return [p for p in pieces if p not in over and p not in under] + [new]
    if under:
        new = _built(under, r"\overline" + _braced(row_tex(under)), max(p.base for p in under))
        problems.append("a bar over maths was read as an overline")
        return [p for p in pieces if p not in under] + [new]
    return pieces


def tidy(tex: str) -> str:
    """One space on either side of a binary sign; none after a sign that opens, and none in braces."""
    out, depth = "", 0
    for i, c in enumerate(tex):
        depth += {"{": 1, "}": -1}.get(c, 0)
        before = out.rstrip()
        if depth == 0 and c in "+-=<>" and before and (before[-1].isalnum() or before[-1] in ")}]!|") and i + 1 < len(tex):
            out = f"{before} {c} "
        elif not (c == " " and out.endswith(" ")):
            out += c
    return out


def line_parts(parts: list[Piece], body: float) -> list[tuple[str, bool]]:
    """A line as parts from left to right: (LaTeX or text, whether it is maths)."""
    words: list[list[Piece]] = []
    last = None
    for p in read_row(parts):
        if last is None or p.space or p.x0 - last.x1 > WORD_GAP * body:
            words.append([])
        words[-1].append(p)
        last = p
    out: list[tuple[str, bool]] = []
    for w in words:
        w = function_words(w)
        maths = any(p.maths or p.up or p.down for p in w) or len(w) == 1 and w[0].tex in _SIGNS
        tail = ""
        while maths and len(w) > 1 and w[-1].tex in ".,;:?" and not w[-1].up:
            tail, w = w[-1].tex + tail, w[:-1]
        tex = functools.reduce(lambda a, b: a + " " + b if b[:1].isalpha() and re.search(r"\\[A-Za-z]+\Z", a) else a + b, map(_with_scripts, w), "")
        if maths and out and out[-1][1]:
            out[-1] = (out[-1][0] + " " + tex, True)
        else:
            out.append((tex, maths))
        if tail:
            out.append((tail, False))
    return out


def parts_text(parts: list[tuple[str, bool]], mark: str = "$") -> str:
    text = ""
    for tex, maths in parts:
        piece = f"{mark}{tidy(tex)}{mark}" if maths else tex
        text += piece if not text or tex in (".", ",", ";", ":", "?") else " " + piece
    return text


@dataclass
class Line:
    x0: float
    y0: float
    x1: float
    y1: float
    page: int
    inline: str
    display: str | None


def set_lines(lines: list[list[Piece]], body: float) -> list[Line]:
    """Lines as text. One that is maths alone, and centred in the column or well indented, is display
    maths, if it is not the only one."""
    left, right = min(p.x0 for line in lines for p in line), max(p.x1 for line in lines for p in line)
    out = []
    for line in lines:
        parts = line_parts(line, body)
        x0, x1 = min(p.x0 for p in line), max(p.x1 for p in line)
        apart = x0 - left > 2.5 * body or abs((x0 + x1) / 2 - (left + right) / 2) < 0.12 * (right - left)
        alone = len(lines) > 1 and apart and any(m for _, m in parts) and all(m or tex in (",", ".", ";") for tex, m in parts)
        stops = "".join(tex for tex, m in parts if not m)
        shown = "$$" + tidy(" ".join(tex for tex, m in parts if m)) + stops + "$$" if alone else None
        out.append(Line(x0, min(p.y0 for p in line), x1, max(p.y1 for p in line), line[0].page, parts_text(parts), shown))
    return out


def paragraphs(lines: list[Line], body: float) -> str:
    """Lines as paragraphs, a blank line between them. A paragraph begins at display maths and after it,
    at more space than is usual, at an indented line, at a numbered statement, and at a line back at the
    margin after one. The second line of a statement, further in than its number, belongs to it.

    What can be said of a line and the one before is a table of columns; the line that each is headed by is
    then folded from the breaks, as two conditions need the head.
    """
    t = pd.DataFrame([(x.page, x.x0, x.y0, x.y1, x.display, x.inline) for x in lines if x.display or x.inline], columns=["page", "x0", "y0", "y1", "display", "inline"])
    if t.empty:
        return ""
    t["text"] = t["display"].where(t["display"].notna(), t["inline"])
    t["shown"], t["numbered"] = t["display"].notna(), t["text"].map(lambda s: bool(STATEMENT.match(s)))
    before = t.shift(1)
    same_page = t["page"] == before["page"]
    space, step = (t["y0"] - before["y1"]).where(same_page), (t["x0"] - before["x0"]) / body
    plain = space[~t["shown"] & ~before["shown"].eq(True)].dropna()
    usual = plain.median() if len(plain) else 0.3 * body
    space = space.fillna(usual)
    wide = space > min(max(0.7 * body, usual + 0.45 * body), body)
    breaks = (t["shown"] | wide | (step > 0.8) | t["numbered"]).tolist()
    goes_on, x0, numbered, shown, back = ((same_page & (space <= body) & ~t["numbered"]).tolist(), *(t[c].tolist() for c in ("x0", "numbered", "shown")), (step < -0.8).tolist())

    def head_of(state: tuple[int, bool], i: int) -> tuple[int, bool]:
        """(head of line i, whether i goes on a statement) from those of the line before."""
        head, went_on = state
        if numbered[head] and goes_on[i] and x0[i] > x0[head] + 0.8 * body:
            return head, True
        after_shown = shown[i - 1] and not went_on
        return (i if breaks[i] or after_shown or (numbered[head] and back[i]) else head), False

    states = list(itertools.accumulate(range(1, len(t)), head_of, initial=(0, False)))
    t["head"] = [head for head, _ in states]
    t["said"] = t["inline"].where(pd.Series([on for _, on in states]), t["text"])
    glued = lambda part: functools.reduce(lambda a, b: a + ("" if a.endswith("-") else " ") + b, part)
    return "\n\n".join(p for p in t.groupby("head")["said"].agg(glued).str.strip() if p)


def clusters(values: list[float], step: float) -> list[list[int]]:
    """Places of the values, which ascend, in groups: one ends where the next value is step or more above its
    median."""
    out: list[list[int]] = []
    for i, v in enumerate(values):
        if out and v - median(values[j] for j in out[-1]) < step:
            out[-1].append(i)
        else:
            out.append([i])
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def cluster_sizes(values: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The sizes of the clusters of an array of numbers, sorted first."""
    for vs, steps in values:
        yield pd.Series([[len(c) for c in clusters(sorted(v), s)] for v, s in zip(vs, steps, strict=True)])


def question_text(glyphs: list[dict], rules: list) -> tuple[str, list[str]]:
    """The text of one question and what could not be read with certainty."""
    problems: list[str] = []
    pieces = [Piece(g["x0"], g["y0"], g["x1"], g["y1"], g["base"], g["size"], BIG.get(g["ch"]) or COMMANDS.get(g["ch"], g["ch"]), bool(g["math_font"] or g["ch"] in COMMANDS or g["ch"] in BIG), bool(g["space_before"]), page=int(g["page"])) for g in glyphs]
    sizes: dict[float, int] = {}
    for p in pieces:
        sizes[round(p.size, 1)] = sizes.get(round(p.size, 1), 0) + 1
    body = max(sizes, key=lambda s: sizes[s]) if sizes else 10.0
    pieces = big_operators(pieces, body)
    for rule in sorted(rules, key=lambda r: (r.x1 - r.x0, r.x0, r.y)):
        here = [p for p in pieces if p.page == rule.page]
        if not underlines(here, rule, body):
            pieces = [p for p in pieces if p.page != rule.page] + apply_rule(here, rule, problems)
    problems += ["a root sign has no bar" for p in pieces if p.tex == "√"]
    lines: list[list[Piece]] = []
    full = sorted((p for p in pieces if p.size >= SCRIPT_SIZE * body), key=lambda p: (p.page, p.base, p.x0))
    for _, group in itertools.groupby(full, key=lambda p: p.page):
        on_page = list(group)
        lines += [[on_page[i] for i in places] for places in clusters([p.base for p in on_page], LINE_STEP * body)]
    for p in (p for p in pieces if p.size < SCRIPT_SIZE * body):
        if lines:
            min(lines, key=lambda line: (line[0].page != p.page, abs(line[0].base - p.base))).append(p)
        else:
            lines.append([p])
    return (paragraphs(set_lines(lines, body), body) if lines else ""), problems


_OUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("problems", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


def rebuild(glyphs: DataFrame, rules: DataFrame) -> DataFrame:
    """(paper_id, question, text, problems, error): a question that fails has its error and a null text,
    and does not stop the others."""
    keys = ["paper_id", "question"]
    glyphs, rules = (df if "page" in df.columns else df.withColumn("page", F.lit(1)) for df in (glyphs, rules))
    g = glyphs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("gid", "x0", "y0", "x1", "y1", "base", "size", "ch", "math_font", "space_before", "page"))).alias("glyphs"))
    r = rules.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rid", "x0", "x1", "y", "page"))).alias("rules"))

    @F.pandas_udf(_OUT)
    def build(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from types import SimpleNamespace

        for gs, rs in parts:
            rows = []
            for a, b in zip(gs, rs, strict=True):
                try:
                    rows.append((*question_text(list(a), [SimpleNamespace(**x) for x in (b if b is not None else [])]), None))
                except Exception as e:  # noqa: BLE001  one bad question must not stop a paper
                    rows.append((None, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["text", "problems", "error"])

    return g.join(r, keys, "left").select(*keys, build("glyphs", "rules").alias("b")).select(*keys, "b.*")
