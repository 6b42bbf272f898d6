"""Steps whose work grows with the input: their plans, and their rows on data that would multiply."""

import datetime
import random
import re

from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import history, index_store, indexing, lexical, ranking, retrieval, steps, vectors
from tidemark.plans import scalar_queries
from tidemark.sources import bucketed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_joins_postings_once_for_queries_alike_and_never_broadcasts_them(spark):
    chunks = spark.createDataFrame([(f"c{n:02}", f"red_{'ab'[n % 2]} ring {n}") for n in range(40)], "id string, body string")
    index = lexical.build_inverted_index(chunks, ["body"])
    queries = spark.createDataFrame([("q1", "red ring"), ("q2", "ring, red"), ("q3", "Red rin"), ("q4", "red_a"), ("q5", "none"), ("q6", ""), ("q7", None)], "query_id string, query_text string")
    found = lexical.bm25_top_k(queries, index, 5)
    assert "SortMergeJoin [token" in plan(found) and "BroadcastHashJoin [token" not in plan(found)
    rows = {}
    for r in found.collect():
        rows.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert sorted(rows) == ["q1", "q2", "q3", "q4"]
    assert sorted(rows["q1"]) == sorted(rows["q2"]) == sorted(rows["q3"])
    assert [x[1] for x in sorted(rows["q1"])] == ["c00", "c01", "c02", "c03", "c04"] and [x[1] for x in sorted(rows["q4"])] == ["c00", "c02", "c04", "c06", "c08"]


def test_keywords_alike_are_joined_once_and_never_with_all_notes_of_a_project(spark):
    notes = spark.createDataFrame([(f"m{n}", "p", "active", n, f"Note {n}", "Red ring" if n % 2 else "blue", None) for n in range(9)], "id string, project_id string, status string, created_at int, title string, content string, facts array<string>")
    queries = spark.createDataFrame([("q1", "p", "RED"), ("q2", "p", "red"), ("q3", "p", "note 8"), ("q4", "p", None), ("q5", "x", "red"), ("q6", "p", "")], "query_id string, project_id string, keyword string")
    assert sorted((r.keyword, r.id) for r in lexical.keyword_pairs(queries.filter("keyword <> ''"), notes).collect()) == [("note 8", "m8"), *(("red", f"m{n}") for n in (1, 3, 5, 7))]
    assert {r.query_id: r.hits for r in lexical.keyword_hits(queries, notes).collect()} == {"q1": 4, "q2": 4, "q3": 1, "q6": 9}
    assert sorted((r.query_id, r["rank"], r.id) for r in lexical.keyword_top_k(queries.filter("keyword <> ''"), notes, 2).collect()) == [("q1", 0, "m1"), ("q1", 1, "m3"), ("q2", 0, "m1"), ("q2", 1, "m3"), ("q3", 0, "m8")]


def test_symbol_history_in_cells_equals_all_pairs(spark):
    rng = random.Random(5)
    lines = lambda: (s := rng.choice([0, 1, rng.randrange(60), rng.randrange(20000)]), s + rng.choice([-9, -2, -1, 0, 1, 5, 40, 9000]))
    symbols = [(f"s{n:03}", "ab"[n % 2], *lines()) for n in range(150)] + [("none", "a", None, 5)]
    hunks = [("ab"[n % 3 == 0], *lines(), f"{rng.randrange(150):040}", datetime.datetime(2024, 1, 1 + rng.randrange(9)), f"u{n % 2}", f"m{n % 3}") for n in range(400)] + [("a", 3, None, "x" * 40, datetime.datetime(2025, 1, 1), "u", "m")]
    s = spark.createDataFrame(symbols, "id string, file_path string, line_start long, line_end long")
    h = spark.createDataFrame(hunks, "path string, start long, `end` long, sha string, ts timestamp_ntz, author string, message string")
    found = history.symbol_history(s, h, 4)
    want = set()
    for i, path, low, high in symbols[:-1]:
        over = {(-x[4].day, x[3], x[6], x[5]) for x in hunks[:-1] if x[0] == path and x[1] <= high and x[2] >= low}
        want |= {(i, k, f"{sha[:7]} {m} ({u}, 2024-01-{-d:02})") for k, (d, sha, m, u) in enumerate(sorted(over)[:4])}
    got = {(r.id, r["rank"], r.text) for r in found.collect()}
    assert (sorted(got - want)[:3], sorted(want - got)[:3]) == ([], [])


def test_symbol_history_of_one_file_makes_no_pairs(spark):
    s = spark.range(2000).selectExpr("concat('s', id) AS id", "'f' AS file_path", "id AS line_start", "id + 1500 AS line_end")
    h = spark.range(4000).selectExpr("'f' AS path", "id AS start", "id + 900 AS `end`", "sha1(cast(id AS string)) AS sha", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "'u' AS author", "'m' AS message")
    found = history.symbol_history(s, h)
    assert found.count() == 16000
    joins = re.findall(r"Join \[[^]]*\]", plan(found))
    assert any("cell#" in x for x in joins), joins


def test_symbol_requests_alike_are_ranked_once(spark):
    chunks = spark.createDataFrame([(f"c{n:02}", f"f{n % 3}", "go", "A::go", n, n % 2, 0.5) for n in range(30)], "id string, file_path string, symbol_name string, qualified_name string, line_start int, churn_count int, hotspot_score double")
    asked = spark.createDataFrame([("r1", "go", None), ("r2", "go", None), ("r3", "A::go", "f1"), ("r4", "go", "f1"), ("r5", "no", None)], "request_id string, name string, file_path string")
    none = spark.createDataFrame([], "chunk_id string, commit_sha string"), spark.createDataFrame([], "sha string, message string")
    found = retrieval.get_symbol(asked, chunks, *none)
    assert re.search(r"Join \[name#\d+, (in_file|file_path)#\d+\]", plan(found))
    rows = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        rows.setdefault(r.request_id, []).append(r.id)
    assert sorted(rows) == ["r1", "r2", "r3", "r4"] and rows["r1"] == rows["r2"] == [f"c{n:02}" for n in (*range(1, 30, 2), *range(0, 10, 2))]
    assert rows["r3"] == rows["r4"] == [f"c{n:02}" for n in range(1, 30, 3)]


def test_top_k_prunes_groups_before_the_shuffle(spark):
    rows = spark.range(1000, numPartitions=4).selectExpr("id % 3 AS g", "id AS n")
    first = ranking.top_k(rows, ["g"], [F.desc("n")], 2)
    assert re.search(r"WindowGroupLimit \[g#\d+L\].*Partial", plan(first)), plan(first)
    assert sorted((r.g, r["rank"], r.n) for r in first.collect()) == [(0, 0, 999), (0, 1, 996), (1, 0, 997), (1, 1, 994), (2, 0, 998), (2, 1, 995)]


def test_searches_run_in_steps_of_small_plans(spark):
    queries = spark.createDataFrame([("q1", "p", "red", [1.0, 0.0]), ("q2", "p", "ring", [0.0, 1.0])], "query_id string, project_id string, keyword string, embedding array<double>").withColumn("query_text", F.col("keyword"))
    chunks = spark.createDataFrame([(f"c{n}", f"f{n}", "s", "s", "k", "g", "d", 1, 2, 0, 0.5, "red ring " + str(n)) for n in range(9)], "id string, file_path string, symbol_name string, qualified_name string, symbol_kind string, signature string, doc_comment string, line_start int, line_end int, churn_count int, hotspot_score double, body_preview string")
    own = spark.createDataFrame([(f"c{n}", "cur-model", [1.0, float(n)]) for n in range(9)], "chunk_id string, embed_model string, embedding array<double>")
    bridge, commits = spark.createDataFrame([("c1", "s1")], "chunk_id string, commit_sha string"), spark.createDataFrame([("s1", "fix")], "sha string, message string")
    found = retrieval.search_code(queries, chunks, own, lexical.build_inverted_index(chunks, ["body_preview"]), bridge, commits)
    assert "FlatMapCoGroups" not in plan(found) and plan(found).count("Exchange") < 12
    assert {(r.query_id, r["rank"], r.id) for r in found.collect() if r["rank"] == 0} == {("q1", 0, "c0"), ("q2", 0, "c0")}
    assert {tuple(r.related_commits) for r in found.collect() if r.id == "c1"} == {("fix",)}


def test_grams_are_counted_before_the_shuffle(spark):
    notes = spark.createDataFrame([(f"m{n}", "ab"[n % 2] if n else None, "active", n, "T", "red ring" if n < 6 else "rod", None) for n in range(9)], "id string, project_id string, status string, created_at int, title string, content string, facts array<string>").coalesce(1)
    grams = lexical.with_grams(spark.createDataFrame([("red",), ("rod",)], "t string"), "t", lexical.own_grams)
    counted = lexical.gram_counts(lexical.lowered(notes), lexical.bits_of(grams))
    of = lambda x: int.from_bytes(x.encode(), "big")
    assert {(r.project_id, r.gram): r.n for r in counted.collect()} == {("a", of("red")): 2, ("b", of("red")): 3, ("a", of("rod")): 2, ("b", of("rod")): 1}


def test_pairs_of_a_project_are_dealt_over_tasks(spark):
    queries = spark.range(6).selectExpr("concat('q', id) AS query_id", "if(id < 4, 'p', 'r') AS project_id", "'why' AS query_text")
    notes = spark.range(400).selectExpr("concat('m', id) AS id", "if(id < 390, 'p', null) AS project_id", "'decision' AS type")
    pairs = ranking.paired(queries, notes, "project_id", "id")
    sizes = [len(x) for x in pairs.rdd.glom().collect()]
    assert sum(sizes) == 4 * 390 and max(sizes) < 0.6 * sum(sizes)
    assert pairs.distinct().count() == 4 * 390 and sorted(pairs.columns) == ["id", "project_id", "query_id", "query_text", "type"]


def test_index_keeps_links_by_file_and_loads_them_for_each_chunk(spark, tmp_path):
    """A file of many chunks and commits has a row for each commit in the store, not one for each pair."""
    text = "".join(f"# h{n}\nline\n\n" for n in range(30))
    files = spark.createDataFrame([("a.md", text, "h"), ("b.md", "# b\n", "h")], "path string, text string, content_hash string")
    rows = [(f"s{n:02}", datetime.datetime(2024, 1, 1 + n), "a change worth a note", path, 60, 40) for n in range(9) for path in ("a.md", "none.md")]
    log = spark.createDataFrame(rows, "sha string, ts timestamp_ntz, message string, path string, added long, deleted long")
    root = f"file://{tmp_path}/index"
    index_store.build(spark, root, files, log.filter("sha < 's05'"), vectors.HashedWords(4), "2024-02-01", 8)
    index_store.refresh_commits(spark, root, log.filter("sha >= 's04'"), "2024-02-01")
    links = bucketed.read_tables(spark, root)["links"]
    assert sorted((r.path, r.commit_sha) for r in links.collect()) == [("a.md", f"s{n:02}") for n in range(9)]
    index = index_store.load_index(spark, root)
    assert index["bridge"].count() == 270 and index["chunks"].count() == 31 and index["commits"].count() == 9


def test_sections_are_shuffled_once(spark):
    files = spark.createDataFrame([("a.md", "# a\n# a\n"), ("a.md", "# a\n")], "path string, text string")
    found = indexing.chunks_of(files)
    sections = [line for line in plan(found).split("\n") if line.startswith("   :")]  # the first side of the union
    assert len(re.findall(r"Exchange hashpartitioning", "\n".join(sections))) == 1 and "Exchange hashpartitioning(id" not in plan(found)
    assert found.groupBy("id").count().filter("count > 1").count() == 0 and found.count() == 2


def test_cosines_of_one_label_are_many_tasks_work(spark, tmp_path):
    rows = spark.range(500).selectExpr("id AS vec_id", "1 AS label", "array(cast(id % 7 AS float), 1f, cast(id % 3 AS float)) AS embedding")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = scalar_queries.QUERIES["p21_cosine_distance"](spark, str(tmp_path))
    assert found.select("a_id", "b_id").distinct().count() == 20 * 500
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    same = rows.alias("x").join(rows.alias("y"), F.expr("x.vec_id % 25 = 3")).select(F.col("x.vec_id").alias("a_id"), F.col("y.vec_id").alias("b_id"), F.round(scalars.cosine_distance("x.embedding", "y.embedding"), 9).alias("dist"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, same.collect()))


def test_stored_chunks_hold_a_text_once_in_slices_too(spark, tmp_path, monkeypatch):
    """Names that stand in the preview are kept as places, whatever the chunk's kind; a table in slices is the same table."""
    monkeypatch.setattr(bucketed, "SLICE_BYTES", 1)
    monkeypatch.setattr(bucketed, "SLICE_BUCKETS", 2)
    long = "# é😀 " + "word " * 60
    files = spark.createDataFrame([("a.md", f"  {long}\nrest\n# two\n", "h"), ("b.py", "class A:\n    def f(self):\n        return 1\n", "h"), ("c.sql", "  \nselect 1;\n", "h")], "path string, text string, content_hash string")
    log = spark.createDataFrame([("s", datetime.datetime(2024, 1, 1), "a change worth a note", "a.md", 1, 0)], "sha string, ts timestamp_ntz, message string, path string, added long, deleted long")
    root, embedder = f"file://{tmp_path}/index", vectors.HashedWords(4)
    index_store.build(spark, root, files, log, embedder, "2024-02-01", 8)
    want = indexing.build_index(files, log, embedder, "2024-02-01")
    rows = lambda table: sorted(map(str, table.select(*sorted(table.columns)).collect()))
    index = index_store.load_index(spark, root)
    assert all(rows(index[t]) == rows(want[t]) for t in ("chunks", "vectors", "files", "bridge"))
    stored = bucketed.read_tables(spark, root)["chunks"]
    assert stored.filter("file_path <> 'b.py' and (symbol_name is not null or qualified_name is not null)").count() == 0
    assert stored.filter("file_path = 'b.py' and qualified_name = 'A.f'").count() == 1 and stored.count() == 5


def test_steps_leave_no_shuffles(spark, tmp_path):
    import glob
    import time

    there = lambda: set(glob.glob(f"{spark.sparkContext.getConf().get('spark.local.dir')}/**/shuffle_*.data", recursive=True))
    before = there()
    df = spark.range(20_000).selectExpr("id", "sha2(string(id), 256) AS text").repartition(3, "text")
    kept = steps.step(df)
    for _ in range(100):
        if not (left := there() - before):
            break
        time.sleep(0.1)
    assert not left and kept.count() == 20_000


def test_long_keywords_meet_few_memories(spark):
    """Notes of the same words in another order share every trigram, but not longer runs: a pair is a match, not a guess."""
    rng = random.Random(5)
    words = ["alder", "birch", "cedar", "drum", "elder", "fern", "grass", "holly"]
    said = [" ".join(rng.choices(words, k=60)) for _ in range(120)]
    table = spark.createDataFrame([(f"n{i:03}", "p", "active", t[:40], t, None, datetime.datetime(2024, 1, 1)) for i, t in enumerate(said)], "id string, project_id string, status string, title string, content string, facts array<string>, created_at timestamp")
    queries = spark.createDataFrame([(f"q{i:03}", "p", t[60:110]) for i, t in enumerate(said)], "query_id string, project_id string, keyword string")
    found = lexical.keyword_pairs(queries, table)
    want = sorted((t[60:110], f"n{i:03}") for t in {x[60:110]: x for x in said}.values() for i, other in enumerate(said) if t[60:110] in other)
    assert sorted((r.keyword, r.id) for r in found.collect()) == want
    grams = [lexical.own_runs(q.keyword.encode()) for q in queries.collect()]
    texts = [lexical.run_hashes(lexical.np.frombuffer(t.encode(), "uint8")) for t in said]
    assert all(len(lexical.np.intersect1d(g, t)) == len(g) for g, t in zip(grams, texts, strict=True))
    assert sum(min(sum(n in t for t in texts) for n in g) for g in grams) < len(said) ** 2 / 10
    assert list(lexical.own_runs(b"short")) == list(lexical.own_grams(b"short"))


def test_long_runs_across_windows(spark, monkeypatch):
    monkeypatch.setattr(lexical, "WINDOW", 32)
    text = bytes(random.Random(7).choices(range(97, 123), k=300))
    every = set(lexical.run_hashes(lexical.np.frombuffer(text, "uint8")).tolist())
    for keyword in (text[at : at + size] for at in range(250) for size in (16, 17, 40)):
        assert set(lexical.own_runs(keyword).tolist()) <= every
    bits = lexical.np.full(lexical.BITS // 8 + 1, 255, lexical.np.uint8)
    assert set(lexical.distinct_runs(text, bits).tolist()) == every and len(every) == 285
    assert len(lexical.distinct_runs(b"x" * 15, bits)) == 0 and len(lexical.distinct_runs(b"", bits)) == 0
