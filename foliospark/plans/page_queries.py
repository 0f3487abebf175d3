"""Queries of the page layer, the pictures and the labels over the star-schema tables, beside their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import pixels as px
from foliospark.operators import anchors, pagelayer, validate
from foliospark.plans.queries import query
from foliospark.session import spread


@F.pandas_udf(T.BinaryType())
def framed(width: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """White pictures of a width and height with a black rectangle of ink_w x ink_h in the corner."""
    for w, h, a, b in width:
        out = []
        for row in zip(w, h, a, b, strict=True):
            grey = np.full((row[1], row[0]), 255, np.uint8)
            grey[: row[3], : row[2]] = 0
            out.append(px.encode(grey))
        yield pd.Series(out)


_PICTURES = "SELECT p_partkey, p_size + 20 AS w, 60 AS h, (p_size + 20) * (p_partkey % 5) // 4 AS a, CASE WHEN p_partkey % 7 = 0 THEN 12 ELSE 60 END AS b FROM part"


@query(f"""SELECT p_partkey, code FROM (SELECT p_partkey, unnest([CASE WHEN least(w, h) < 40 THEN 'image-size' END, CASE WHEN a = 0 THEN 'image-blank' END,
  CASE WHEN a > 0 AND a * b / (w * h)::DOUBLE < 0.45 THEN 'image-whitespace' END]) AS code FROM ({_PICTURES})) WHERE code IS NOT NULL""")
def picture_rules(t):
    """Pictures drawn from parts, decoded and checked."""
    w = F.col("p_size") + 20
    png = framed(w, F.lit(60), F.floor(w * (F.col("p_partkey") % 5) / 4).cast("int"), F.when(F.col("p_partkey") % 7 == 0, 12).otherwise(60))
    rows = spread(t("part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", px.measures(png).alias("m"))
    ink = (F.col("m.ink_x1") - F.col("m.ink_x0")).cast("double") * (F.col("m.ink_y1") - F.col("m.ink_y0"))
    return rows.select("p_partkey", F.explode(validate.picture_rules(F.col("m.width"), F.col("m.height"), ink)).alias("i")).select("p_partkey", "i.code")


_SHAPES = """SELECT p_partkey, p_size::DOUBLE AS x0, p_retailprice AS y0, (p_size + p_size % 7 + 1)::DOUBLE AS x1, p_retailprice + p_size % 4 AS y1 FROM part"""


@query(f"SELECT p_partkey AS page, x0, x1, (y0 + y1) / 2 AS y FROM ({_SHAPES}) WHERE y1 - y0 <= 1.6 AND x1 - x0 >= 2")
def thin_bars(t):
    p = t("part")
    rows = p.select(F.lit("p").alias("paper_id"), F.col("p_partkey").alias("page"), F.col("p_size").cast("double").alias("x0"), F.col("p_retailprice").alias("y0"), (F.col("p_size") + F.col("p_size") % 7 + 1.0).alias("x1"), (F.col("p_retailprice") + F.col("p_size") % 4).alias("y1"))
    item = F.array(F.struct(F.lit("c").alias("kind"), *[F.col(s).alias(s) for s in ("x0", "y0", "x1", "y1")]))
    line = F.array(F.struct(F.lit("l").alias("kind"), *[F.col(s).alias(s) for s in ("x0", "y0", "x1", "y1")]))
    drawings = rows.withColumn("items", F.when(F.col("y1") - F.col("y0") <= 1.6, line).otherwise(item))
    return pagelayer.bars(drawings).select("page", "x0", "x1", "y")


@query("""WITH g AS (SELECT o_custkey AS paper, o_orderkey AS page, o_totalprice / 1000 AS w FROM orders)
  SELECT page, least(w, 600.0) AS width FROM g WHERE least(w, 600.0) >= 3 AND NOT least(w, 600.0) > 552""")
def graphics_kept(t):
    o = t("orders").select(F.lit("p").alias("paper_id"), F.col("o_orderkey").alias("page"), F.lit(0.0).alias("x0"), F.lit(100.0).alias("y0"), (F.col("o_totalprice") / 1000).alias("x1"), F.lit(110.0).alias("y1"))
    pages = o.select("paper_id", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    none = o.limit(0)
    return pagelayer.graphics(pages, o, none, none, none, none).select("page", (F.col("x1") - F.col("x0")).alias("width"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN chr(57344) ELSE chr((97 + l_linenumber)::INT) END AS c FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)),
  f AS (SELECT p_partkey, chr((65 + p_size % 26)::INT) AS real FROM part WHERE p_size % 2 = 0)
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN coalesce(real, chr(65533)) ELSE c END AS c FROM c LEFT JOIN f ON l_partkey = p_partkey""")
def glyph_repair(t):
    """Broken characters looked up by place and glyph number; glyph numbers are parts."""
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    c = F.when(F.col("l_linenumber") % 3 == 0, "\ue000").otherwise(F.char(F.lit(97) + F.col("l_linenumber")))
    chars = li.select(F.lit("p").alias("paper_id"), F.col("l_orderkey").alias("page"), c.alias("c"), (F.col("l_partkey") / 4.0).alias("x"), F.col("l_linenumber").cast("double").alias("y"), "l_linenumber", "l_partkey")
    trace = chars.select("paper_id", "page", F.lit(0).alias("ord"), "x", "y", F.lit("F").alias("font"), F.col("l_partkey").alias("glyph"))
    fonts = t("part").where("p_size % 2 = 0").select(F.lit("F").alias("font"), F.col("p_partkey").alias("glyph"), F.char(F.lit(65) + F.col("p_size") % 26).alias("c"))
    return pagelayer.repaired(chars, trace, fonts).select(F.col("page").alias("l_orderkey"), "l_linenumber", "l_partkey", "c")


@query("""WITH l AS (SELECT conv_id % 20 AS paper, conv_id AS page, turn, lower(role) AS shape FROM conversations), n AS (SELECT paper, count(DISTINCT page) AS n FROM l GROUP BY paper),
  k AS (SELECT paper, shape, turn, count(DISTINCT page) AS seen FROM l GROUP BY ALL)
  SELECT l.page AS conv_id, l.turn FROM l JOIN n USING (paper) JOIN k ON k.paper = l.paper AND k.shape = l.shape AND k.turn = l.turn WHERE n.n >= 3 AND k.seen >= greatest(3, floor(n.n * 0.5 + 0.5)) GROUP BY ALL""")
def running_heads(t):
    """Turns as lines, 6 points apart, of pages: roles that recur at one height on half of the pages."""
    c = t("conversations").select((F.col("conv_id") % 20).alias("paper_id"), F.col("conv_id").alias("page"), F.col("turn").alias("n"), F.col("role").alias("text"), F.lit(100.0).alias("x0"), (F.col("turn") * 6.0).alias("y0"), F.lit(200.0).alias("x1"), (F.col("turn") * 6.0 + 5).alias("y1"))
    pages = c.select("paper_id", "page").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    return pagelayer.furniture(c, pages).select(F.col("page").alias("conv_id"), F.col("n").alias("turn"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN chr((65 + event_id % 8)::INT) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_type <> 'error', event_id ROWS UNBOUNDED PRECEDING) AS owner
  FROM events WHERE event_type <> 'error' OR TRUE QUALIFY event_type <> 'error'""")
def label_owner(t):
    """Events that are no errors under the last error, as items under a label."""
    e = t("events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("y"), F.lit(1).alias("page"))
    rows = e.where("event_type = 'error'").select("user_id", "page", F.col("y").alias("y0"), F.char(F.lit(65) + F.col("event_id") % 8).alias("label"))
    return anchors.owners(e.where("event_type <> 'error'"), rows, ["user_id"], 0.0).select("event_id", "owner")


@query()
def option_chain(t):
    """Line items as label candidates of an order: the longest run A, B, C, ..."""
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct()
    c = li.select("l_orderkey", F.col("l_partkey").alias("line"), F.col("l_suppkey").alias("k"), F.char(F.lit(64) + F.col("l_linenumber")).alias("label"), F.lit(0).alias("last"), (F.col("l_partkey") % 3 > 0).alias("strong"))
    return anchors.label_chain(c, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("label").alias("label"))


@query(r"""SELECT doc_id, i - 1 AS at, CASE WHEN ch = chr(65533) THEN 'replacement-char' WHEN regexp_matches(ch, '\p{Cc}') THEN 'control-char' WHEN regexp_matches(ch, '\p{Co}') THEN 'private-char' ELSE 'invisible-char' END AS code
  FROM (SELECT doc_id, unnest(cs) AS ch, generate_subscripts(cs, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text || repeat('ab' || chr(9) || chr(8203) || chr(57344), (doc_id % 3)::INT), '(?s).') AS cs FROM documents))
  WHERE ch = chr(65533) OR (regexp_matches(ch, '[\p{Cc}\p{Co}\p{Cf}]') AND ch <> chr(10))""")
def character_offsets(t):
    """Characters that have no place in a paper, in whole texts with some of them added at the end."""
    s = F.concat("text", F.repeat(F.lit("ab\t\u200b\ue000"), (F.col("doc_id") % 3).cast("int")))
    rows = t("documents").select("doc_id", F.explode(validate.character_issues(s)).alias("i"))
    return rows.select("doc_id", F.regexp_extract("i.message", "([0-9]+)$", 1).cast("long").alias("at"), "i.code")
