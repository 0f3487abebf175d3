"""Set-oriented layout operators over lines, boxes and ordered rows.

Every operator takes key columns (as a rule the paper, or paper and page), so that joins keep an
equality and work is dealt by key; positions carry an explicit order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliospark.functions import geometry as g
from foliospark.functions.text import furniture_key


def lines_of(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per line: keys, ord (from 0), line."""
    return docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("ord", "line"))


def joined_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines put together again in order."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "line")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def furniture_keys(lines: DataFrame, group: str, page: str, share: float = 0.5, least: int = 3) -> DataFrame:
    """(group, key): line shapes on enough distinct pages of a group to be running headers or feet;
    numbers, question starts and option labels never are."""
    keyed = lines.withColumn("key", furniture_key(F.col("line"))).where((F.col("key") != "") & ~F.col("key").rlike(r"^#+\.?$|^question #+|^\(?[a-j][).]?$"))
    pages = lines.groupBy(group).agg(F.count_distinct(page).alias("n_pages"))
    seen = keyed.select(group, page, "key").distinct().groupBy(group, "key").agg(F.count("*").alias("n"))
    need = F.greatest(F.lit(least), F.floor(F.col("n_pages") * share + 0.5))
    return seen.join(pages, group).where((F.col("n_pages") >= 3) & (F.col("n") >= need)).select(group, "key", "n")


def content_lines(lines: DataFrame, furniture: DataFrame, group: str) -> DataFrame:
    return lines.withColumn("key", furniture_key(F.col("line"))).join(furniture.select(group, "key"), [group, "key"], "left_anti").drop("key")


def points_in(points: DataFrame, boxes: DataFrame, keys: list[str], x: str, y: str, how: str = "inner") -> DataFrame:
    """Points joined with (or, by how, kept or dropped for) boxes of the same keys that hold them."""
    b = boxes.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [g.contains_point(g.box(), F.col(x), F.col(y))]
    return points.join(b, on, how)


def band_first(rows: DataFrame, keys: list[str], order: str, low: str, high: str, left: str) -> DataFrame:
    """Rows with no other row of their keys further left that overlaps them by over half in height."""
    other = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in {order, low, high, left}])
    overlap = F.least(high, f"_{high}") - F.greatest(low, f"_{low}")
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(f"_{left}") < F.col(left), overlap > 0.5 * F.least(F.col(high) - F.col(low), F.col(f"_{high}") - F.col(f"_{low}"))]
    return rows.join(other, on, "left_anti")


def asof_owner(rows: DataFrame, keys: list[str], order: list[Column], is_owner: Column, owner: Column) -> DataFrame:
    """Each row with the last owner at or before it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("owner", F.last(F.when(is_owner, owner), ignorenulls=True).over(w))


def nearest(rows: DataFrame, others: DataFrame, keys: list[str], value: str, other: str) -> DataFrame:
    """rows with ``other`` of the row of others(keys, value, other) whose value is nearest, of equally near ones
    the least; null if a key has none. Two sorted passes over both, up and down, each with the last seen, no
    pairs: a frame that looks ahead to the end would read all that follows for every row. Null values have none."""
    best = others.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(other).alias(other))
    both = rows.select("*", F.lit(1).alias("_kind"), F.lit(None).cast(others.schema[other].dataType).alias(other)).unionByName(best.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    seen = lambda *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.when(F.col("_kind") == 0, F.struct(F.col(value).alias("v"), F.col(other).alias("o")))
    before = F.last(held, ignorenulls=True).over(seen(F.asc(value), F.asc("_kind")))
    after = F.last(held, ignorenulls=True).over(seen(F.desc(value), F.desc("_kind")))
    near = both.withColumns({"_a": before, "_b": after}).where("_kind = 1")
    side = lambda c: F.when(F.col(c).isNotNull() & F.col(value).isNotNull(), F.struct(F.abs(F.col(f"{c}.v") - F.col(value)).alias("d"), F.col(f"{c}.o").alias("o")))
    return near.withColumn(other, F.least(side("_a"), side("_b"))["o"]).select(*rows.columns, other)


def islands(rows: DataFrame, keys: list[str], order: list, value: str, gap: float) -> DataFrame:
    """Rows numbered by runs in which no step is larger than gap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("_step", step).withColumn("island", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def tail_cut(rows: DataFrame, keys: list[str], order: list, value: str, gap: float) -> DataFrame:
    """The rows before the first step larger than gap."""
    return islands(rows, keys, order, value, gap).where("island = 0").drop("island")


def number_run(rows: DataFrame, keys: list[str], order: list[str], number: str) -> DataFrame:
    """The greedy run 1, 2, 3, ... that the rows hold in order: keys, run."""
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(number).alias("_n")))), lambda r: r["_n"])
    run = F.aggregate(sorted_, F.lit(0), lambda acc, n: F.when(n == acc + 1, acc + 1).otherwise(acc))
    return rows.groupBy(*keys).agg(run.alias("run"))


def best_by(rows: DataFrame, keys: list[str], value: str, *score: Column) -> DataFrame:
    """The value of the row with the greatest score; scores must not tie."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*score)).alias("best"))


def mode_first_seen(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value; of equally frequent ones the one seen first, then the smaller."""
    by = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"), F.min(order).alias("_o"))
    return best_by(by, keys, value, F.col("_c"), -F.col("_o"), -F.col(value))


def median_step(rows: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_d", F.col(value) - F.lag(value).over(w)).where("_d is not null").groupBy(*keys).agg(F.median("_d").alias("step"))


def bag_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, missing (more in a), extra (more in b), as multisets; equal counts are left out."""
    x = a.groupBy(*keys, value).agg(F.count("*").alias("na"))
    y = b.groupBy(*keys, value).agg(F.count("*").alias("nb"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = x.join(y, [*keys, value], "full")
    return both.select(*keys, value, F.greatest(zero("na") - zero("nb"), F.lit(0)).alias("missing"), F.greatest(zero("nb") - zero("na"), F.lit(0)).alias("extra")).where("missing + extra > 0")


def densest(rows: DataFrame, keys: list[str], value: str, tol: float, least: int = 2) -> DataFrame:
    """The value with most values within tol on either side: keys, densest, n. One sorted pass, no join."""
    w = Window.partitionBy(*keys).orderBy(value).rangeBetween(-tol, tol)
    by = rows.select(*keys, value).withColumn("n", F.count("*").over(w)).groupBy(*keys, value).agg(F.max("n").alias("n"))
    top = by.groupBy(*keys).agg(F.max(F.struct("n", (-F.col(value)).alias("v"))).alias("b"))
    return top.select(*keys, (-F.col("b.v")).alias("densest"), F.col("b.n").alias("n")).where(F.col("n") >= least)


def merge_boxes(boxes: DataFrame, keys: list[str], near: float) -> DataFrame:
    """Boxes of a key merged while two are nearer than near; merged boxes grow, so the order counts:
    first by (y0, x0), then each takes in what is near until nothing is."""
    def merged(todo: list[list[float]]) -> list[dict]:
        todo, done = sorted(todo, key=lambda b: (b[1], b[0], b[3], b[2])), []
        while todo:
            cur, grown = todo.pop(0), True
            while grown:
                grown = False
                for i, o in enumerate(todo):
                    dx, dy = max(o[0] - cur[2], cur[0] - o[2], 0.0), max(o[1] - cur[3], cur[1] - o[3], 0.0)
                    if dx * dx + dy * dy < near * near:
                        cur, grown = [min(cur[0], o[0]), min(cur[1], o[1]), max(cur[2], o[2]), max(cur[3], o[3])], True
                        del todo[i]
                        break
            done.append(dict(zip(g.SIDES, cur, strict=True)))
        return done

    box_type = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in g.SIDES]))

    @F.pandas_udf(box_type)
    def merge(groups: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in groups:
            yield x.map(lambda bs: merged([[b[c] for c in g.SIDES] for b in bs]))

    held = boxes.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in g.SIDES])).alias("bs"))
    return held.select(*keys, F.explode(merge("bs")).alias("b")).select(*keys, "b.*")


def question_regions(anchors: DataFrame, pages: DataFrame, key: str = "paper_id", images: DataFrame | None = None) -> DataFrame:
    """(key, number, page, top, bottom): what each question owns, from the boxes of the numbers, anchors(key,
    number, page, box), and pages(key, page, height, blank, top, bottom) with the extent of their content
    (null where there is none).

    A question begins a little above its number, by 0.9 of its height and 6 points at least, and at the top
    of a picture(key, page, box) that stands on the number's line to its right, unless that reaches into the
    question before. It ends where the next begins. If that is on a later page, or there is none, it goes on
    to the pages up to there (the last question: to one more page), but not beyond a blank page, and not
    onto a page that begins with the next number.
    """
    w = Window.partitionBy(key).orderBy("number")
    lead = F.greatest(F.lit(6.0), 0.9 * (F.col("y1") - F.col("y0")))
    a = anchors.select(key, "number", "page", *g.SIDES, (F.col("y0") - lead).alias("begin"))
    a = a.withColumns({"next_page": F.lead("page").over(w), "floor": F.when(F.lag("page").over(w) == F.col("page"), F.lag("y1").over(w) + 2).otherwise(0.0)})
    if images is not None:
        i = images.select(F.col(key).alias("_key"), F.col("page").alias("_page"), *[F.col(s).alias(f"_{s}") for s in g.SIDES])
        beside = (F.col("_x0") >= F.col("x1") - 2) & (F.col("_y0") < F.col("y0")) & (F.col("_y1") >= F.col("y0") - 2) & (F.col("_y0") >= F.col("floor"))
        high = a.join(i, (F.col(key) == F.col("_key")) & (F.col("page") == F.col("_page")) & beside).groupBy(key, "number").agg(F.min(F.col("_y0") - 4).alias("high"))
        a = a.join(high, [key, "number"], "left").withColumn("begin", F.least("begin", "high")).drop("high")
    first = anchors.select(key, F.col("page").alias("p"), F.struct("y0", (F.col("y0") - lead).alias("limit")).alias("m")).groupBy(key, "p").agg(F.min("m.limit").alias("limit"))
    same = F.col("next_page") == F.col("page")
    a = a.withColumn("next_begin", F.when(same, F.lead(F.col("y0") - lead).over(w)))
    last = F.when(same, F.col("page")).otherwise(F.coalesce("next_page", F.col("page") + 1))
    parts = a.withColumn("p", F.explode(F.sequence("page", F.greatest("page", last)))).join(pages.select(key, F.col("page").alias("p"), "height", "blank", "top", "bottom"), [key, "p"]).join(first, [key, "p"], "left")
    own = F.col("p") == F.col("page")
    seen = Window.partitionBy(key, "number").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    stopped = F.max((F.col("blank") & ~own).cast("int")).over(seen) == 1
    end = F.coalesce(F.when(own, F.col("next_begin")).otherwise(F.col("limit")), F.col("bottom") + 4)
    starts_next = ~own & F.coalesce(F.col("top") >= F.col("limit") - 2, F.lit(False))
    rows = parts.withColumns({"stopped": stopped, "_top": F.greatest(F.lit(0.0), F.when(own, F.col("begin")).otherwise(F.col("top") - 6)), "_bottom": F.least(end, "height")})
    rows = rows.where(~F.col("stopped") & ~starts_next & F.col("top").isNotNull() & (F.col("_bottom") - F.col("_top") >= 4))
    return rows.select(key, "number", F.col("p").alias("page"), F.col("_top").alias("top"), F.col("_bottom").alias("bottom"))


def page_anchors(lines: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, number, page): pages as questions where no numbers are printed, from lines(key, page,
    text): the pages that have an "A" line, else all pages with text but the first."""
    label = F.trim("text").rlike(r"^\(?A[).]?(?:\s|\z)")
    by = lines.groupBy(key, "page").agg(F.max(label.cast("int")).alias("a"), F.max((F.trim("text") != "").cast("int")).alias("has"))
    every = Window.partitionBy(key)
    some, first = F.max("a").over(every), F.min(F.when(F.col("has") == 1, F.col("page"))).over(every)
    kept = by.withColumns({"some": some, "first": first}).where("(some = 1 and a = 1) or (some = 0 and has = 1 and page > first)")
    return kept.select(key, F.row_number().over(every.orderBy("page")).alias("number"), "page")


def label_run(lines: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, n, start): the longest run of option labels A, B, C, ... in order, the latest of equally
    long ones; labels are written A, (A), A. or A)."""
    letter = F.regexp_extract(text, r"^\s*\(?([A-J])(?:[).]|\s|\z)", 1)
    rows = lines.withColumn("_l", letter).where("_l <> ''").withColumn("_l", F.ascii("_l") - 65)
    at = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col("_l").alias("l"))))
    none = F.struct(F.lit(0).alias("n"), F.lit(-1).cast("long").alias("start"))
    start = F.struct(none.alias("best"), none.alias("cur"))

    def step(a: Column, x: Column) -> Column:
        cur = F.when(x["l"] == 0, F.struct(F.lit(1).alias("n"), x["o"].alias("start"))).when((x["l"] == a["cur"]["n"]) & (a["cur"]["n"] > 0), F.struct((a["cur"]["n"] + 1).alias("n"), a["cur"]["start"].alias("start"))).otherwise(a["cur"])
        return F.struct(F.when(cur["n"] >= a["best"]["n"], cur).otherwise(a["best"]).alias("best"), cur.alias("cur"))

    best = rows.groupBy(*keys).agg(F.aggregate(at, start, step, lambda a: a["best"]).alias("b"))
    return best.select(*keys, F.col("b.n").alias("n"), F.col("b.start").alias("start")).where("n > 0")
