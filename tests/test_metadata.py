"""Metadata of papers and the plain reading of questions."""

from foliospark.operators import metadata as md


def test_metadata(spark):
    lines = spark.createDataFrame(
        [("a", 1, 1, "Algebra", 20.0), ("a", 1, 2, "Mock  3", 17.0), ("a", 1, 3, "small", 9.0), ("a", 1, 4, "75 minutes", 18.0), ("a", 1, 5, "BIG AFTER", 20.0), ("a", 2, 1, "other page", 30.0), ("b", 1, 1, "xy", 10.0)],
        "paper_id string, page int, n int, text string, size double",
    )
    papers = spark.createDataFrame(
        [("a", "x/01_some_name.pdf", "Algebra Mock 3 Paper 2 of 2019. 75 minutes, 20 questions", False), ("b", "Set-4_specimen.png", "xy", True), ("c", "last.pdf", None, False)], "paper_id string, file string, first string, ocr boolean"
    )
    meta = md.read_metadata(papers, lines)
    assert [tuple(r) for r in meta.orderBy("paper_id").collect()] == [("a", "Algebra Mock 3", "Paper 2", "2019", 75, 20), ("b", "Set 4 specimen", None, "Set 4", None, None), ("c", "last", None, None, None, None)]
    final = {r.paper_id: r for r in md.final_metadata(meta).collect()}
    assert (final["a"].id, final["a"].file_name, final["a"].notes) == ("algebra-mock-3-paper-2", "Algebra_Mock_3_Paper_2.json", [])
    assert (final["c"].paper, final["c"].year, final["c"].durationMinutes, len(final["c"].notes)) == ("Paper 1", "Unknown", 75, 2)
    forced = md.final_metadata(meta, title="Tést", paper="test", minutes=60).where("paper_id = 'a'").first()
    assert (forced.title, forced.id, forced.durationMinutes, forced.year) == ("Tést", "test", 60, "2019")


def test_plain_questions(spark):
    rows = [("q", 1, "Find x."), ("q", 2, "C is a point"), ("q", 3, "A 1"), ("q", 4, "or so"), ("q", 5, "(B) 2"), ("q", 6, "D 9"), ("q", 7, "C) 3"), ("r", 1, "only a stem")]
    got = {r.q: (r.stem, [tuple(o) for o in r.options]) for r in md.plain_questions(spark.createDataFrame(rows, "q string, n int, text string"), ["q"]).collect()}
    assert got == {"q": ("Find x. C is a point", [("A", "1 or so"), ("B", "2 D 9"), ("C", "3")]), "r": ("only a stem", [])}


def test_unique_names(spark):
    import random

    from foliospark.operators.assemble import unique_names

    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a_2", "a_2_2", "b", "c_3", "c_3", "d"]), "x") for i in range(60)]
    got = {r.i: r.file_name for r in unique_names(spark.createDataFrame(rows, "i int, name string, other string"), "name", "i").collect()}
    used: set = set()
    for i, name, _ in rows:
        k, want = 2, name
        while want in used:
            want, k = f"{name}_{k}", k + 1
        used.add(want)
        assert got[i] == want, (i, name)
