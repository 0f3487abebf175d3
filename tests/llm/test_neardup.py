"""MinHash near-dedup against all pairs compared by brute force."""

import random
import re

from foliospark.llm.neardup import deduplicated, near_duplicates, rest_links


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n_base=12, copies=14):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(n_base):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 160))]
        for _ in range(rng.randrange(1, copies)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(["X", "é", "Tail."])
            rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
            i += rng.randrange(1, 4)
    return rows + [(9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9005, "ONE"), (9006, "a b"), (9007, "long " * 40000)]


def test_components_equal_brute_force(spark):
    for k, percent in ((3, 85), (5, 80)):
        rows = corpus(k)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark, df, k, percent).collect()}
        assert got == brute(rows, k, percent)


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("foliospark.llm.neardup.BLOCK", 5)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        words = list(base)
        for j in rng.sample(range(60), rng.choice([0, 1, 2, 3, 4])):
            words[j] = rng.choice(["X", "Y", f"z{i}"])
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark, df, 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_empty_null_ids_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, id long, comp long, key long")
    assert near_duplicates(spark, empty).collect() == []
    df = spark.createDataFrame([(None, "a b c", 1, 1, 1), (2, "a b c", 1, 1, 1), (2, "a b c", 1, 1, 1)], empty.schema)
    got = sorted((r.doc_id is None, r.component_id, r.kept) for r in near_duplicates(spark, df, 3, 85).collect())
    assert got == [(False, 2, True), (False, 2, True), (True, None, True)]


def test_repeated_ids_with_the_same_and_with_other_texts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(9, long)] * 40 + [(9, "other text of nine here"), (4, long + " end"), (7, "other text of nine here"), (11, None), (11, "x y z"), (12, "x y z"), (13, "alone")]
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(9, 4, False), (4, 4, True), (7, 4, False), (11, 11, True), (12, 11, False), (13, 13, True)}
    assert sorted(r.n_shingles for r in got if r.doc_id == 9) == [3] + [58] * 40


def test_blocks_of_one_centre_are_dealt_over_tasks(spark):
    diffs = spark.createDataFrame([(i, 1, 5, 5, b"\0", b"") for i in range(2, 50)], "a long, b long, n_a long, n_b long, lacks binary, adds binary")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rest_links(spark, diffs, spark.createDataFrame([], "id long, comp long"), 80)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    top = plan[plan.index("FlatMapGroupsInArrow") :]
    assert re.search(r"hashpartitioning\(b#\d+L?, i#\d+L?, j#\d+L?", top[: top.index("Union")]), plan


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, 1), (5, long, 1), (9, long, 2), (5, "other words of five", 3), (None, "x", 4), (None, "x", 4), (None, "y", 4), (None, None, 5), (None, "", 5), (8, "alone", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = deduplicated(spark, df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.row) for r in got.collect()) in ([(0, 4), (0, 4), (0, 5), (5, 1), (8, 6)], [(0, 4), (0, 4), (0, 5), (5, 3), (8, 6)])
    assert deduplicated(spark, df.limit(0)).collect() == []
    assert {r.doc_id for r in deduplicated(spark, df.where("row in (2, 6)")).collect()} == {8, 9}
