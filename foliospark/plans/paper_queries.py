"""Queries of papers, numbers, labels, metadata and names over the star-schema tables, each by the library's
operator, beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import latex
from foliospark.operators import anchors, assemble, layout, mathbuild, metadata, pagelayer, review
from foliospark.plans.queries import query
from foliospark.sources import papers as src

BOX = ("x0", "y0", "x1", "y1")


def _box(x0, y0, x1, y1):
    return [F.lit(v).cast("double").alias(s) if isinstance(v, int | float) else v.cast("double").alias(s) for s, v in zip(BOX, (x0, y0, x1, y1), strict=True)]


@query("""SELECT d.doc_id AS page, coalesce(bool_and(regexp_matches(lower(line), '\\bblank\\s+page\\b')) FILTER (line <> ''), NOT bool_or(d.doc_id % 5 = 0)) AS blank
  FROM (SELECT doc_id, unnest(string_split(CASE WHEN doc_id % 4 = 0 THEN 'This is a Blank  page' WHEN doc_id % 4 = 1 THEN '' ELSE text END, chr(10))) AS line FROM documents) d GROUP BY d.doc_id""".replace("\\\\", "\\"))
def blank_pages(t):
    """Documents as pages: a quarter says that it is blank, a quarter has no text, a fifth a drawing."""
    text = F.when(F.col("doc_id") % 4 == 0, "This is a Blank  page").when(F.col("doc_id") % 4 == 1, "").otherwise(F.col("text"))
    d = t("documents").select(F.lit("p").alias("paper_id"), F.col("doc_id").alias("page"), text.alias("text"))
    lines = layout.lines_of(d, ["paper_id", "page"]).where("line <> ''").withColumnRenamed("line", "text")
    drawn = d.where("page % 5 = 0").select("paper_id", "page", *_box(0, 0, 9, 9))
    return pagelayer.blank_pages(lines, drawn, d.select("paper_id", "page", F.lit(0.0).alias("dark"))).select("page", "blank")


@query("""WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\n]+') AS ws FROM documents))
  SELECT doc_id AS page FROM w WHERE regexp_matches(w, '[A-Za-z]{3,}') AND regexp_matches(lower(w), '[aeiouy]') AND (i // 50) * 12 + 4 <= 300 GROUP BY doc_id HAVING count(*) >= 4 AND sum(8 * length(w)) >= 0.015 * 150000""".replace("\\\\", "\\"))
def text_pictures(t):
    """Documents as pages with one picture, their words set in it, fifty a line."""
    words = t("documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).alias("i", "word"))
    x, y = F.col("i") % 50 * 6, F.floor(F.col("i") / 50) * 12
    boxes = words.select(F.lit("p").alias("paper_id"), F.col("doc_id").alias("page"), "word", x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + F.length("word")).cast("double").alias("x1"), (y + 8).cast("double").alias("y1"))
    images = t("documents").select(F.lit("p").alias("paper_id"), F.col("doc_id").alias("page"), *_box(0, 0, 500, 300))
    return pagelayer.text_pictures(images, boxes).select("page")


_MAGIC = ["25504446", "89504E47", "FFD8FFE0", "47494638", "424D3A00", "3C68746D"]


@query("SELECT page_id, ['pdf', 'png', 'jpeg', 'gif', 'bmp', NULL][(page_id % 6 + 1)::INT] AS kind FROM pages")
def file_kinds(t):
    """Pages with the first bytes of six kinds of files before them."""
    head = F.unhex(F.element_at(F.array(*map(F.lit, _MAGIC)), (F.col("page_id") % 6 + 1).cast("int")))
    return t("pages").select("page_id", src.kind_of(F.concat(head, F.encode("html", "utf-8"))).alias("kind"))


@query(r"""SELECT page_id, name, backslashes, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(s, '(?s)(\\+)([A-Za-z]+|[^A-Za-z\\]?)', 2)) AS name,
  length(unnest(regexp_extract_all(s, '(?s)(\\+)([A-Za-z]+|[^A-Za-z\\]?)', 1))) AS backslashes FROM (SELECT page_id, replace(replace(html, '</', '\\'), '<', '\') AS s FROM pages)) GROUP BY ALL""")
def command_runs(t):
    """Tags of pages as commands, end tags with two backslashes."""
    s = F.replace(F.replace("html", F.lit("</"), F.lit("\\\\")), F.lit("<"), F.lit("\\"))
    return t("pages").select("page_id", F.inline(latex.command_runs(s))).groupBy("page_id", "name", F.col("backslashes").cast("long").alias("backslashes")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, (row_number() OVER (ORDER BY n_name DESC, n_nationkey, c_custkey))::INT AS number, (SELECT sum(n_nationkey + 30) FROM nation)::BIGINT AS minutes FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def combined_papers(t):
    """Nations as papers, in reverse order of name, and their customers as questions."""
    papers = t("nation").select(F.col("n_nationkey").alias("paper_id"), F.struct((-F.ascii("n_name")).alias("a"), (-F.col("n_nationkey")).alias("b")).alias("_o"), "n_name", F.lit("Paper").alias("paper"), F.lit("2001").alias("year"), (F.col("n_nationkey") + 30).alias("durationMinutes"))
    order = F.array_sort(F.collect_list(F.struct("n_name", (-F.col("paper_id")).alias("k"))))
    papers = papers.join(papers.agg(F.reverse(order).alias("names")).select(F.posexplode("names").alias("pos", "x")).select("pos", (-F.col("x.k")).alias("paper_id")), "paper_id").drop("_o", "n_name")
    questions = t("customer").select(F.col("c_nationkey").alias("paper_id"), F.col("c_custkey").alias("number"), "c_custkey")
    head, rows = assemble.combine(questions, papers, "All")
    return rows.select("c_custkey", "number").crossJoin(F.broadcast(head.select(F.col("durationMinutes").alias("minutes"))))


@query("""SELECT p_partkey, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS file_name FROM (SELECT p_partkey, base, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k
  FROM (SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z0-9._-]+', '_', 'g') AS base FROM part))""")
def unique_names(t):
    from foliospark.functions import text as tx

    rows = t("part").select("p_partkey", tx.safe_name(F.col("p_type")).alias("base"))
    return assemble.unique_names(rows, "base", "p_partkey").select("p_partkey", "file_name")


@query("SELECT c_custkey, arg_min(s_suppkey, {'d': abs(s_acctbal - c_acctbal), 'k': s_suppkey}) AS s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY c_custkey")
def nearest_by_key(t):
    """The supplier of each customer's nation with the nearest balance, of equally near ones the first."""
    c = t("customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("v"))
    s = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("v"))
    return layout.nearest(c, s, ["nation"], "v", "s_suppkey").where("s_suppkey is not null").select("c_custkey", "s_suppkey")


@query("""WITH c AS (SELECT DISTINCT l_suppkey AS paper, l_orderkey AS page, l_linenumber AS n, l_orderkey + l_partkey % 3 AS number, l_linenumber <= 4 AS edge FROM lineitem),
  e AS (SELECT *, number - page AS off FROM c WHERE edge), b AS (SELECT paper, off, count(*) AS k, min({'p': page, 'n': n}) AS f FROM e GROUP BY paper, off),
  top AS (SELECT paper, off FROM b WHERE k >= 3 QUALIFY row_number() OVER (PARTITION BY paper ORDER BY k DESC, f) = 1 AND k = (SELECT max(k) FROM b b2 WHERE b2.paper = b.paper)), s AS (SELECT e.* FROM e JOIN top USING (paper, off)),
  o AS (SELECT DISTINCT paper, page FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.paper = c.paper AND s.page = c.page AND s.n = c.n)),
  d AS (SELECT p.paper FROM (SELECT DISTINCT paper, page FROM s) p LEFT JOIN o USING (paper, page) GROUP BY p.paper HAVING count(o.page) >= 0.5 * count(*))
  SELECT paper, page, n FROM c WHERE NOT EXISTS (SELECT 1 FROM s JOIN d USING (paper) WHERE s.paper = c.paper AND s.page = c.page AND s.n = c.n)""")
def without_page_numbers(t):
    """Line items as numbers on the pages of a supplier's paper: those that go up by one a page are its page numbers."""
    li = t("lineitem").select(F.col("l_suppkey").alias("paper_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), (F.col("l_orderkey") + F.col("l_partkey") % 3).alias("number"), (F.col("l_linenumber") <= 4).alias("edge")).distinct()
    return anchors.without_page_numbers(li).select(F.col("paper_id").alias("paper"), "page", "n")


@query("SELECT conv_id AS paper_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS number, turn + 1 AS page FROM conversations WHERE role = 'user'")
def question_anchors(t):
    """Turns as pages: what users say has the next number before it, what others say has none."""
    c = t("conversations").select(F.col("conv_id").alias("paper_id"), (F.col("turn") + 1).alias("page"), "turn", "role")
    from pyspark.sql.window import Window

    k = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("paper_id").orderBy("turn"))
    first = F.when(F.col("role") == "user", F.concat(k.cast("string"), F.lit("."))).otherwise("Words")
    lines = c.select("paper_id", "page", F.lit(1).alias("n"), F.concat(first, F.lit(" and more of them")).alias("text"), *_box(50, 100, 300, 110), first.alias("first_text"), *[F.lit(v).cast("double").alias(f"first_{s}") for s, v in zip(BOX, (50, 100, 60, 110), strict=True)], (F.col("role") == "user").alias("first_bold"))
    pages = c.select("paper_id", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    return anchors.question_anchors(lines, pages).select("paper_id", F.col("number").cast("int").alias("number"), "page")


@query("""SELECT p_partkey, s.segment AS segment, s.text AS text FROM part, LATERAL (SELECT unnest([{'segment': '', 'text': 'Find' || p_size}, {'segment': 'A', 'text': p_size::VARCHAR}, {'segment': 'B', 'text': 'two'}, {'segment': 'C', 'text': (p_size + 1)::VARCHAR}]) AS s)""")
def split_options(t):
    """Parts as questions of four lines, set glyph by glyph: a stem, then options A, (B) and C."""
    n = F.col("p_size").cast("string")
    said = F.array(F.concat(F.lit("Find "), n), F.concat(F.lit("A "), n), F.lit("B two"), F.concat(F.lit("C "), (F.col("p_size") + 1).cast("string")))
    lines = t("part").select("p_partkey", F.posexplode(said).alias("line", "s"))
    chars = lines.select("p_partkey", "line", F.posexplode(F.split("s", "")).alias("i", "ch")).where("ch <> ' '")
    from pyspark.sql.window import Window

    k = (F.row_number().over(Window.partitionBy("p_partkey", "line").orderBy("i")) - 1).alias("k")
    glyphs = chars.select("p_partkey", "line", k, "ch", (F.lit(50.0) + F.col("i") * 6).alias("x0"), (F.lit(55.0) + F.col("i") * 6).alias("x1"), *[F.lit(False).alias(c) for c in ("math_font", "bold", "ocr")])
    rows = anchors.split_options(glyphs, ["p_partkey"], F.lit(10.0)).withColumn("segment", F.coalesce("segment", F.lit("")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "k", "ch"))), lambda x: x["ch"]), "")
    return rows.groupBy("p_partkey", "segment").agg(text.alias("text"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[qQ]'))::BIGINT AS missing, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS extra FROM documents WHERE len(regexp_extract_all(text, '[qQ]')) > 0 OR doc_id % 2 = 0""")
def cross_check(t):
    """Documents against themselves without one letter, and with two that have no place there."""
    d = t("documents").select("doc_id", F.replace("text", F.lit("\\"), F.lit("")).alias("text"))
    changed = d.select("doc_id", F.concat(F.regexp_replace("text", "[qQ]", ""), F.when(F.col("doc_id") % 2 == 0, " ЖЖ").otherwise("")).alias("text"))
    return assemble.cross_check(d, changed, ["doc_id"])


@query(r"""WITH m AS (SELECT p_partkey, p_name AS title, CASE WHEN p_size % 3 > 0 THEN 'Paper ' || p_size % 3 END AS paper, CASE WHEN p_size % 2 = 0 THEN (2000 + p_size)::VARCHAR END AS year, CASE WHEN p_size % 5 > 0 THEN p_size END AS minutes, p_size + 1 AS questions FROM part),
  f AS (SELECT p_partkey, title, coalesce(paper, 'Paper 1') AS paper, coalesce(year, 'Unknown') AS year, coalesce(minutes, 75)::INT AS durationMinutes, questions::INT AS questions FROM m)
  SELECT *, lower(array_to_string(regexp_extract_all(title || ' ' || paper, '[A-Za-z0-9]+'), '-')) AS id, array_to_string(regexp_extract_all(title || ' ' || paper, '[A-Za-z0-9]+'), '_') || '.json' AS file_name FROM f""")
def paper_metadata(t):
    """Parts as covers, read and completed by defaults: a title set larger, a name, a year, a time, a number."""
    n = F.col("p_size")
    first = F.concat_ws(" ", F.when(n % 3 > 0, F.concat(F.lit("Paper "), (n % 3).cast("string"), F.lit("."))), F.when(n % 2 == 0, F.concat(F.lit("Summer "), (n + 2000).cast("string"), F.lit("."))), F.when(n % 5 > 0, F.concat(F.lit("Time: "), n.cast("string"), F.lit(" minutes."))), F.concat(F.lit("There are "), (n + 1).cast("string"), F.lit(" questions")))
    papers = t("part").select(F.col("p_partkey").alias("paper_id"), F.lit("a/b.pdf").alias("file"), first.alias("first"), F.lit(False).alias("ocr"))
    line = lambda no, text, size: F.struct(F.lit(no).alias("n"), text.alias("text"), F.lit(size).alias("size"))
    lines = t("part").select(F.col("p_partkey").alias("paper_id"), F.lit(1).alias("page"), F.inline(F.array(line(1, F.col("p_name"), 20.0), line(2, F.lit("small words"), 9.0), line(3, F.lit("75 minutes"), 20.0), line(4, F.lit("After it"), 20.0))))
    return metadata.final_metadata(metadata.read_metadata(papers, lines)).drop("notes").withColumnRenamed("paper_id", "p_partkey")


@query("""SELECT user_id, line, n FROM (WITH RECURSIVE e AS (SELECT user_id, list(value ORDER BY value) AS vs FROM events GROUP BY user_id),
  f AS (SELECT user_id, vs, 1 AS i, [vs[1]] AS cur, []::INT[] AS done FROM e UNION ALL
    SELECT user_id, vs, i + 1, CASE WHEN cut THEN [v] ELSE list_append(cur, v) END, CASE WHEN cut THEN list_append(done, len(cur)::INT) ELSE done END FROM (SELECT *, vs[i + 1] AS v, vs[i + 1] - list_aggregate(cur, 'median') >= 60 AS cut FROM f WHERE i < len(vs)))
  SELECT user_id, unnest(list_append(done, len(cur)::INT)) AS n, generate_subscripts(list_append(done, len(cur)::INT), 1)::INT - 1 AS line FROM f WHERE i = len(vs))""")
def line_clusters(t):
    """Events of a user as base lines of glyphs: a line ends where the next is 60 or more below its median."""
    held = t("events").groupBy("user_id").agg(F.collect_list(F.col("value").cast("double")).alias("vs"))
    return held.select("user_id", F.posexplode(mathbuild.cluster_sizes("vs", F.lit(60.0))).alias("line", "n"))


_SAID = "SELECT conv_id, turn, trim(regexp_replace(CASE turn % 4 WHEN 1 THEN 'A ' WHEN 2 THEN '(B) ' WHEN 3 THEN 'C. ' ELSE '' END || role || ' ' || turn, '\\s+', ' ', 'g'), ' ') AS s FROM conversations WHERE turn < 4".replace("\\\\", "\\")


@query(f"""SELECT conv_id, max(CASE WHEN turn = 0 THEN s END) AS stem, coalesce(string_agg(CASE WHEN turn > 0 THEN chr((64 + turn)::INT) || '=' || role || ' ' || turn END, ';' ORDER BY turn), '') AS options FROM ({_SAID}) JOIN conversations USING (conv_id, turn) GROUP BY conv_id""")
def plain_questions(t):
    """The first turns of conversations as lines: a stem and up to three options."""
    label = F.when(F.col("turn") == 1, "A ").when(F.col("turn") == 2, "(B) ").when(F.col("turn") == 3, "C. ").otherwise("")
    lines = t("conversations").where("turn < 4").select("conv_id", F.col("turn").alias("n"), F.concat(label, "role", F.lit(" "), F.col("turn").cast("string")).alias("text"))
    q = metadata.plain_questions(lines, ["conv_id"])
    return q.select("conv_id", "stem", F.array_join(F.transform("options", lambda o: F.concat(o["label"], F.lit("="), o["content"])), ";").alias("options"))


@query("""WITH a AS (SELECT conv_id, turn // 2 + 1 AS number, turn + 1 AS page, 50.0 + turn AS y FROM conversations WHERE turn % 2 = 0), p AS (SELECT conv_id, turn + 1 AS page, role = 'system' AS blank FROM conversations),
  n AS (SELECT a.*, lead(page) OVER w AS np, lead(y) OVER w AS ny, max(page) OVER (PARTITION BY conv_id) AS mp FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY number)),
  s AS (SELECT n.*, p.page AS p, max((p.blank AND p.page > n.page)::INT) OVER (PARTITION BY n.conv_id, n.number ORDER BY p.page ROWS UNBOUNDED PRECEDING) AS stopped
        FROM n JOIN p ON n.conv_id = p.conv_id AND p.page BETWEEN n.page AND coalesce(np, n.page + 1)),
  r AS (SELECT conv_id, number, p AS page, (CASE WHEN p = page THEN greatest(y - 9, 0) ELSE 34 END)::DOUBLE AS top, (CASE WHEN p = np THEN ny - 9 ELSE 764 END)::DOUBLE AS bottom, coalesce(p > page AND p = np AND 40 >= ny - 11, false) AS none_ FROM s WHERE stopped = 0)
  SELECT conv_id, number, page, top, bottom FROM r WHERE bottom - top >= 4 AND NOT none_""")
def question_regions(t):
    """Turns as pages with content from 40 to 760; every second has a number, 10 high, pages of the system are blank."""
    c = t("conversations")
    page, y = (F.col("turn") + 1).alias("page"), F.lit(50.0) + F.col("turn")
    marks = c.where("turn % 2 = 0").select("conv_id", (F.floor(F.col("turn") / 2) + 1).alias("number"), page, *_box(50, y, 60, y + 10))
    pages = c.select("conv_id", page, F.lit(800.0).alias("height"), (F.col("role") == "system").alias("blank"), F.lit(40.0).alias("top"), F.lit(760.0).alias("bottom"))
    return layout.question_regions(marks, pages, "conv_id")


@query(r"""SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '$', ''), '\n[^\S\n]*\n'), lambda p: regexp_replace(p, '^([^\S\n]*\n)+', '')), lambda p: regexp_matches(p, '\S')).len() + 2 AS n_paragraphs FROM documents""")
def display_paragraphs(t):
    """Paragraphs of documents, with two more at the end, one of which has a blank line in display maths."""
    s = F.concat(F.replace("text", F.lit("$"), F.lit("")), F.lit("\n\n$$a\n\nb$$ c\n \nlast"))
    return t("documents").select("doc_id", F.size(review.paragraphs(s)).cast("long").alias("n_paragraphs"))


@query("""SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM pages""")
def escaped_html(t):
    return t("pages").select("page_id", review.escaped(F.col("html")).alias("html"))


@query("""SELECT o_orderkey AS number, o_custkey AS paper_id FROM orders WHERE o_orderkey % 4 = 0 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'N')""")
def review_filter(t):
    """Orders as questions, every fourth flagged, their returned or accepted items as errors."""
    q = t("orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("number"), (F.col("o_orderkey") % 4 == 0).alias("needs_review"))
    issues = t("lineitem").select(F.col("l_orderkey").alias("number"), F.when(F.col("l_returnflag") == "N", "info").otherwise("error").alias("level"))
    return review.to_review(q, issues, ["number"]).select("number", "paper_id")
