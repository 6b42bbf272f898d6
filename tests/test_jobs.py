"""Jobs on hand-written rows: contracts that the given tables don't show."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, indexing, memory, ranking, vectors
from tidemark.sources import git_log, requests, snapshots, trees

NOTE = "id string, project_id string, topic_key string, type string, title string, content string, facts array<string>, tags array<string>, importance double, access_count long, created_at timestamp, last_accessed timestamp, pinned boolean, status string, session_id string, source string, content_hash string, updated_at timestamp"
T0 = "2024-01-01 00:00:00"


def notes(spark, *rows):
    base = {"project_id": "p", "type": "fact", "title": "Title", "content": "Content", "importance": 0.5, "access_count": 0, "pinned": False, "status": "active", "source": "realtime", "content_hash": "hash", "session_id": "s"}
    names = [x.split()[0] for x in NOTE.split(", ")]
    full = [{**base, "created_at": T0, **r} for r in rows]
    raw = spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], NOTE.replace("timestamp", "string"))
    return raw.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "last_accessed", "updated_at")})


def asked(spark, *ids, project="p", **more):
    return spark.createDataFrame([(project, i, n, *more.values()) for n, i in enumerate(ids)], "project_id string, id string, ord int" + "".join(f", {k} boolean" for k in more))


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_dedup_keeps_greedily(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 20), ("c", 40), ("d", 61), ("e", 200)], "id string, s long").selectExpr("id", "timestamp_seconds(s) as created_at", "'h' as content_hash", "'x' as session_id")
    got = {r.id: (r.kept, r.dup_of) for r in memory.dedup_window(rows, window_secs=30).collect()}
    assert got == {"a": (True, None), "b": (False, "a"), "c": (True, None), "d": (False, "c"), "e": (True, None)}
    old = spark.createDataFrame([("o", 190, "h", "x"), ("z", 0, "h2", "x")], "id string, s long, content_hash string, session_id string").withColumn("created_at", F.timestamp_seconds("s"))
    assert {r.id: r.dup_of for r in memory.dedup_window(rows, old).collect()}["e"] == "o"


def test_topics_fold_and_stay_deleted(spark):
    old = notes(spark, {"id": "k", "topic_key": "t", "status": "deleted", "source": "reviewed", "access_count": 7}, {"id": "u", "topic_key": "other"})
    batch = spark.createDataFrame([(1, "n1", "t", "one", None, None), (2, "n2", "t", "two", "manual", True), (3, "n3", "t", "three", None, None), (4, "n4", None, "four", None, None)], "ord long, id string, topic_key string, content string, source string, pinned boolean")
    batch = batch.selectExpr("*", "'p' as project_id", "'decision' as type", "'T' as title", "null as session_id", "0.7 as importance", "cast(array() as array<string>) as facts", "cast(array() as array<string>) as tags")
    out = {r.id: r for r in memory.upsert_topics(old, memory.prepare_memories(batch, "2024-02-01 00:00:00")).collect()}
    assert set(out) == {"k", "u", "n4"}
    k = out["k"]
    assert (k.content, k.status, k.type, k.access_count, k.source, k.pinned, k.upserted) == ("three", "deleted", "fact", 7, "manual", True, True)
    assert str(k.created_at) == T0 and str(k.updated_at) == "2024-02-01 00:00:00" and not out["n4"].upserted and not out["u"].upserted


def test_store_gives_each_request_its_id(spark):
    table = notes(spark, {"id": "k", "topic_key": "t"})
    vec = spark.createDataFrame([("k", "hashed-words-1", [0.0] * 64)], "memory_id string, embed_model string, embedding array<float>")
    rows = [(1, "r1", None, "same", 0), (2, "r2", None, "same", 10), (3, "r3", "t", "new text", 20), (4, "r4", None, "same", 45)]
    req = spark.createDataFrame(rows, "ord long, id string, topic_key string, content string, s long").selectExpr("ord", "id", "topic_key", "content", "timestamp_seconds(1704067200 + 86400 + s) as created_at", "'p' as project_id", "'fact' as type", "'T' as title", "'s' as session_id", "null as importance", "null as source", "cast(null as boolean) as pinned", "cast(array() as array<string>) as facts", "cast(array() as array<string>) as tags")
    out = memory.store_memories(req, table, vec, vectors.HashedWords(), "2024-01-03 00:00:00")
    assert {r.ord: r.id for r in out["results"].collect()} == {1: "r1", 2: "r1", 3: "k", 4: "r4"}
    assert ids(out["memories"]) == ["k", "r1", "r4"] and ids(out["vectors"], "memory_id") == ["k", "r1", "r4"]
    assert any(out["vectors"].filter("memory_id = 'k'").first().embedding)


def test_duplicates_of_an_upsert_get_its_note_and_old_vectors_go(spark):
    """Two equal requests on a topic that has a note: both results are that note; its vectors of any model are replaced."""
    table = notes(spark, {"id": "m1", "topic_key": "t"}, {"id": "m2"})
    vec = spark.createDataFrame([("m1", "old", [1.0]), ("m1", "older", [2.0]), ("m2", "old", [3.0])], "memory_id string, embed_model string, embedding array<float>")
    rows = [(0, "n1", "t", "new text"), (1, "n2", "t", "new text"), (2, "n3", None, "plain"), (3, "n4", None, "plain")]
    req = spark.createDataFrame(rows, "ord long, id string, topic_key string, content string").selectExpr("*", "timestamp_seconds(1704153600 + ord) as created_at", "'p' as project_id", "'fact' as type", "'T' as title", "'s' as session_id", "null as importance", "null as source", "cast(null as boolean) as pinned", "cast(array() as array<string>) as facts", "cast(array() as array<string>) as tags")
    out = memory.store_memories(req, table, vec, vectors.HashedWords(), "2024-01-03 00:00:00")
    stored = {r.id: r.content for r in out["memories"].collect()}
    results = {r.ord: r.id for r in out["results"].collect()}
    assert results == {0: "m1", 1: "m1", 2: "n3", 3: "n3"} and set(results.values()) <= set(stored)
    assert stored["m1"] == "new text" and set(stored) == {"m1", "m2", "n3"}
    assert sorted((r.memory_id, r.embed_model) for r in out["vectors"].collect()) == [("m1", "hashed-words-1"), ("m2", "old"), ("n3", "hashed-words-1")]


def test_one_key_of_many_rows_is_judged_in_one_pass(spark):
    n = 30_000
    rows = spark.range(n).selectExpr("cast(id as string) as id", "'h' as content_hash", "cast(null as string) as session_id", "timestamp_seconds(id * 7) as created_at")
    got = {int(r.id): r.kept for r in memory.dedup_window(rows, window_secs=30).collect()}
    assert len(got) == n and all(got[i] == (i % 5 == 0) for i in range(n))  # every fifth row is 35 seconds on


def test_projects_are_apart_in_every_update(spark):
    table = notes(spark, {"id": "a"}, {"id": "b", "status": "deleted"})
    other = asked(spark, "a", project="q", pin=True)
    assert memory.delete_memories(table, other).filter("status = 'deleted'").count() == 1
    assert memory.pin_memories(table, other).filter("pinned").count() == 0 and memory.get_memories(other, table).first().found is False
    assert memory.touch_memories(table, other, T0).agg(F.sum("access_count")).first()[0] == 0
    both = asked(spark, "a", "b", "a", pin=True)
    assert ids(memory.pin_memories(table, both).filter("pinned")) == ["a"] and memory.delete_report(table, both).first().found == 2
    assert {r.id: r.access_count for r in memory.touch_memories(table, both, T0).collect()} == {"a": 1, "b": 1}


def test_listing_filters_tags_after_the_ceiling(spark):
    table = notes(spark, *({"id": f"n{i:03}", "created_at": f"2024-03-01 00:{i // 60:02}:{i % 60:02}"} for i in range(200)), {"id": "old", "tags": ["x"], "created_at": T0}, {"id": "new", "tags": ["x"], "created_at": "2024-04-01 00:00:00"})
    req = spark.createDataFrame([("r", "p", None, 0.0, ["x"], 5)], "request_id string, project_id string, type string, min_importance double, wanted_tags array<string>, limit int")
    assert ids(memory.list_memories(table, req, "2024-05-01 00:00:00")) == ["new"]


def test_stale_by_creation_and_eviction_spares_pins(spark):
    table = notes(spark, {"id": "weak", "importance": 0.1}, {"id": "pin", "importance": 0.1, "pinned": True}, {"id": "fresh", "importance": 0.1, "created_at": "2024-01-25 00:00:00"}, {"id": "strong", "importance": 1.0})
    vec = spark.createDataFrame([("weak", "m", [1.0]), ("pin", "m", [1.0])], "memory_id string, embed_model string, embedding array<float>")
    out = memory.evict_stale(table, vec, "2024-01-28 00:00:00")
    assert ids(out["memories"]) == ["fresh", "pin", "strong"] and ids(out["vectors"], "memory_id") == ["pin"] and out["counts"].first().evicted == 1


def test_packing_crosses_once_and_gates(spark):
    rows = spark.createDataFrame([("a", 1, 29999), ("a", 2, 5), ("a", 3, 1)], "p string, r int, n int")
    assert [r.included for r in ranking.pack_budget(rows, ["p"], [F.asc("r")], "n").orderBy("r").collect()] == [True, True, False]
    scores = spark.createDataFrame([("low", 0.0199), ("ok", 0.021), ("ok", 0.0099), ("ok", 0.010)], "q string, s double")
    assert sorted(r.s for r in ranking.apply_gates(scores, ["q"], "s").collect()) == [0.010, 0.021]


def test_vectors_rank_ties_by_id_and_take_all_of_few(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("c", [0.0, 1.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    assert [(r.id, r.dist, r.rank) for r in vectors.vector_top_k(q, v, 9).orderBy("rank").collect()] == [("a", 0.0, 0), ("b", 0.0, 1), ("c", 1.0, 2), ("n", 1.0, 3), ("z", 1.0, 4)]
    assert vectors.vector_top_k(q, v, 2).count() == 2 and vectors.vector_top_k(q, v.filter("false"), 2).count() == 0
    back = v.select("id", vectors.decode_vector(vectors.encode_vector("embedding")).alias("e")).collect()
    assert {r.id: r.e for r in back}["a"] == [2.0, 0.0] and {r.id: r.e for r in back}["n"] is None
    assert spark.createDataFrame([(bytes([0, 0, 128, 63, 9]),)], "b binary").select(vectors.decode_vector("b").alias("e")).first().e == [1.0]


def test_git_log(spark):
    sha = "a" * 40
    lines = ["1\t2\tlost", f"{sha}|1700000000|fix a|b", "3\t4\tx.rs", "-\t-\timg.png", "", f"{'b' * 40}|bad|Merge", f"{'c' * 40}|5|s", "1\t1\ty", "not a header|1|x"]
    rows = spark.createDataFrame([("r", n, x) for n, x in enumerate(lines)], "repo string, pos int, line string")
    got = [(r.sha[0], r.message, r.path, r.added, r.deleted) for r in git_log.parse_git_log(rows).orderBy("sha", "path").collect()]
    assert got == [("a", "fix a|b", "img.png", 0, 0), ("a", "fix a|b", "x.rs", 3, 4), ("c", "s", "y", 1, 1)]


def test_requests_come_native_or_as_text(spark):
    lines = ['{"title":"t","importance":"0.5","pinned":"true","tags":"[\\"a\\"]","facts":["f"]}', '{"title":"t","importance":1,"pinned":false,"tags":["b"],"project_id":"q"}', "broken", "{}"]
    got = requests.parse_store_requests(spark.createDataFrame(list(enumerate(lines)), "ord long, value string"), "home").orderBy("ord").collect()
    assert (got[0].importance, got[0].pinned, got[0].tags, got[0].facts, got[0].project_id) == (0.5, True, ["a"], ["f"], "home")
    assert (got[1].importance, got[1].pinned, got[1].tags, got[1].project_id, got[1].source) == (1.0, False, ["b"], "q", None)
    assert got[2].corrupt == "broken" and (got[3].tags, got[3].importance, got[3].corrupt) == ([], None, None)


def test_snapshots_keep_versions(spark, tmp_path):
    a, b = spark.range(3), spark.range(5)
    path = f"file://{tmp_path}/t"
    snapshots.write_table(a, path)
    snapshots.write_table(b, path)
    assert snapshots.read_table(spark, path).count() == 5 and len(snapshots.versions(spark, path)) == 2
    with pytest.raises(FileNotFoundError):
        snapshots.read_table(spark, f"{path}/none")
    old = notes(spark, {"id": "a"})
    vec = spark.createDataFrame([("a", "m", [1.0])], "memory_id string, embed_model string, embedding array<float>")
    caps = spark.createDataFrame([("c",)], "id string")
    with pytest.raises(ValueError):
        snapshots.seed_copy({}, {"memories": old})
    out = snapshots.seed_copy({"memories": notes(spark, {"id": "a", "title": "X"}, {"id": "b"}), "vectors": vec.withColumn("embedding", F.array(F.lit(2.0).cast("float"))), "captures": caps}, {"memories": old, "vectors": vec, "captures": caps}, force=True)
    assert {r.id: r.title for r in out["memories"].collect()} == {"a": "Title", "b": "Title"} and out["vectors"].first().embedding == [2.0]
    assert {r.table: r.copied for r in out["counts"].collect()} == {"memories": 1, "captures": 0, "vectors": 1}
    assert snapshots.upgrade_vectors(vec.drop("embed_model"), "cur").first().embed_model == "cur" and snapshots.upgrade_memories(old.drop("pinned"), ["id", "pinned"]).first().pinned is None


PY = 'class A:\n    def m(self, x):\n        """Doc."""\n        return x\n\n\nasync def f(a,\n            b):\n    return a\n'
RS = "/// Adds.\n#[inline]\npub fn add(a: i32, b: i32) -> i32 {\n    a + b // }\n}\n\nstruct P {\n    x: i32,\n}\n\nimpl Shape for P {\n    fn area(&self) -> i32 {\n        1\n    }\n}\n"
GO = "func (s *Server) Run(x int) error {\n\treturn nil\n}\n\ntype T struct {\n\ta int\n}\n"
TS = "export class C {\n  run(a: number): void {\n  }\n}\n\nexport const go = (x: number) => {\n  return x\n}\n"
MD = "intro\n\n# One\ntext\n\n## Two\n\nmore\n"


def files(spark, **texts):
    rows = [(k.replace("_", ".").replace("0", "/"), v) for k, v in texts.items()]
    return spark.createDataFrame(rows, "path string, text string").withColumn("content_hash", F.sha2("text", 256))


def test_symbols_and_sections(spark):
    got = {(r.path, r.qualified_name): r for r in indexing.extract_symbols(files(spark, a_py=PY, b_rs=RS, c_go=GO, d_ts=TS, e_py="def broken(:", f_txt="x")).collect()}
    assert set(got) == {("a.py", "A"), ("a.py", "A.m"), ("a.py", "f"), ("b.rs", "add"), ("b.rs", "P"), ("b.rs", "P::area"), ("c.go", "Server.Run"), ("c.go", "T"), ("d.ts", "C"), ("d.ts", "C.run"), ("d.ts", "go")}
    add, m, f = got["b.rs", "add"], got["a.py", "A.m"], got["a.py", "f"]
    assert (add.line_start, add.line_end, add.signature, add.doc_comment) == (3, 5, "pub fn add(a: i32, b: i32) -> i32", "/// Adds.")
    assert (m.symbol_kind, m.line_start, m.doc_comment, m.signature) == ("method", 2, "Doc.", "def m(self, x)") and f.signature == "async def f(a, b)" and got["b.rs", "P::area"].symbol_kind == "method"
    got = [(r.symbol_name, r.line_start, r.line_end) for r in indexing.chunk_sections(files(spark, a_md=MD)).orderBy("line_start").collect()]
    assert got == [("intro", 1, 1), ("# One", 3, 4), ("## Two", 6, 8)]


CHANGES = "sha string, ts timestamp_ntz, message string, path string, added long, deleted long"


def changes(spark, *rows):
    return spark.createDataFrame([(s, m, p) for s, m, p in rows], "sha string, message string, path string").selectExpr("sha", "timestamp_ntz'2024-01-01 00:00:00' as ts", "message", "path", "60L as added", "40L as deleted")


def test_refresh_equals_rebuild_and_touches_only_changes(spark):
    log = changes(spark, ("s1", "a change worth a note", "a.py"), ("s2", "bump the version now", "a.py"), ("s3", "another good change", "b.rs"))
    before, after = files(spark, a_py=PY, b_rs=RS, c_md=MD, target0x_py=PY), files(spark, a_py=PY + "\n\ndef g():\n    pass\n", b_rs=RS, d_md=MD)
    embedder, now = vectors.HashedWords(8), "2024-01-01 00:00:00"
    index = indexing.build_index(before, log, embedder, now)
    fresh, full = indexing.update_index(index, after, log, embedder, now), indexing.build_index(after, log, embedder, now)
    for table, keys in {"chunks": ["id", "churn_count", "hotspot_score", "line_end"], "vectors": ["chunk_id", "embed_model"], "bridge": ["chunk_id", "commit_sha"], "files": ["path", "content_hash"]}.items():
        rows = lambda df: sorted(map(tuple, df.select(*keys).collect()))  # noqa: E731, B023
        assert rows(fresh[table]) == rows(full[table]) and rows(full[table])
    a = full["chunks"].filter("file_path = 'a.py'").first()
    assert (a.churn_count, a.hotspot_score) == (1, 1.0) and full["chunks"].filter("file_path like 'target%'").count() == 0
    assert {r.path: r.change for r in indexing.diff_manifest(after, index["files"]).collect()} == {"a.py": "changed", "b.rs": "unchanged", "c.md": "deleted", "d.md": "new"}
    later = history.apply_commits(full, changes(spark, ("s4", "yet another change", "b.rs")), now)
    assert {r.file_path: r.churn_count for r in later["chunks"].collect()} == {"a.py": 1, "b.rs": 2, "d.md": 0}


def test_source_tree(spark, tmp_path):
    for name, raw in {"src/a.rs": b"fn a() {}", "src/b.min.js": b"x", "docs/c.md": b"# c", "bad.py": b"\xff\xfe", "build/d.py": b"x", "e.bin": b"x", "gen/f.py": b"y"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = trees.read_source_tree(spark, str(tmp_path), ("gen/**",)).collect()
    assert {(r.path, r.language) for r in got} == {("src/a.rs", "rust"), ("docs/c.md", "markdown")}


def test_keywords_of_every_length(spark):
    """Posting lists give what a scan of all notes gives, for keywords of any length, case and script."""
    texts = ["The quick brown Fox", "fox", "FO", "a%b_c \\ d", "tab\tand\nline", "日本語のテキスト", "ﬁn 😀😀x", "", "aaa", "aa", None]
    table = notes(spark, *({"id": f"n{i:02}", "title": t, "content": f"c {t}" if i % 2 and t is not None else "-", "facts": [t] if t and i % 3 == 0 else None} for i, t in enumerate(texts)), {"id": "gone", "title": "fox", "status": "deleted"}, {"id": "far", "title": "fox", "project_id": "other"})
    words = ["fox", "FOX", "fo", "f", "", "%b_", "\\", "b\n", "d\na", "本語", "日本語の", "😀x", "😀😀x", "aaaa", "aaa", "zzz", "c t", "k brown fox", '"fo', None, "\x01"]
    queries = spark.createDataFrame([(f"q{i:02}", "p", w) for i, w in enumerate(words)], "query_id string, project_id string, keyword string")
    from tidemark.functions.scalars import keyword_match
    from tidemark.operators import lexical

    held = table.filter("status = 'active'").withColumn("facts_json", F.to_json("facts"))
    plain = queries.join(held, "project_id").filter(keyword_match("keyword", "title", "content", "facts_json"))
    want = sorted((r.query_id, r.id) for r in plain.collect())
    for grams in (None, lexical.build_gram_index(table)):
        got = lexical.keyword_top_k(queries, table, 100, grams)
        assert sorted((r.query_id, r.id) for r in got.collect()) == want and len(want) > 25
    joins = lexical.keyword_top_k(queries, table, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert all("gram" in x or "(id#" in x or "query_id" in x for x in joins.split("\n") if "Join" in x)


def test_terms_find_their_tokens_by_equality(spark):
    from tidemark.operators import lexical

    rows = spark.createDataFrame([("a", "alpha alphabet beta"), ("b", "alp ALPHA"), ("c", "βήτα beta_2"), ("d", "")], "id string, text string")
    index = lexical.build_inverted_index(rows, ["text"])
    asked = spark.createDataFrame([("1", "alph"), ("2", "be bet"), ("3", "βή x"), ("4", "")], "query_id string, query_text string")
    got = {(r.query_id, r.id): r.score for r in lexical.bm25_top_k(asked, index, 9).collect()}
    assert set(got) == {("1", "a"), ("1", "b"), ("2", "a"), ("2", "c"), ("3", "c")}
    kept = lexical.build_prefix_dictionary(index)
    assert {(r.query_id, r.id): r.score for r in lexical.bm25_top_k(asked, index, 9, kept).collect()} == got
    assert {r.token for r in kept.filter("prefix = 'alp'").collect()} == {"alp", "alpha", "alphabet"}


def test_a_refresh_writes_its_buckets_only(spark, tmp_path):
    """Files of ten paths touch ten buckets at most; readers see whole versions; what no version names goes."""
    from tidemark.operators import index_store
    from tidemark.sources import bucketed

    embedder, root, now = vectors.HashedWords(8), f"file://{tmp_path}/index", "2024-01-01 00:00:00"
    source = lambda rows: spark.createDataFrame(sorted(rows.items()), "path string, text string").withColumn("content_hash", F.sha2("text", 256))
    tree = {f"m{i}.md": f"# {i}\ntext {i}\n" for i in range(60)}
    before = source(tree)
    log = changes(spark, *((f"s{i:02}", "a change worth a note", f"m{i}.md") for i in range(60)))
    index_store.build(spark, root, before, log, embedder, now, 32)
    old = index_store.load_index(spark, root)
    held = {t: [tuple(r) for r in old[t].collect()] for t in old}
    new = {f"m{i}.md": "# new\n\n## more\n" for i in range(8)}
    after = source({**{k: v for k, v in tree.items() if k not in ("m8.md", "m9.md")}, **new})
    dirty = spark.createDataFrame([(f"m{i}.md",) for i in range(10)], "path string")
    written = index_store.refresh_files(spark, root, dirty, lambda p: after.join(p, "path", "left_semi"), embedder, now)
    assert 0 < len(written) <= 10
    pointers = bucketed.pointer(spark, root).collect()
    fresh = {r.version for r in pointers if r.name == "chunks" and r.bucket in written}
    assert len(fresh - {None}) == 1 and not fresh & {r.version for r in pointers if r.bucket not in written}
    want = indexing.build_index(after, log, embedder, now)
    keys = {"chunks": ["id", "churn_count", "hotspot_score", "line_end"], "vectors": ["chunk_id", "embed_model"], "bridge": ["chunk_id", "commit_sha"], "files": ["path", "content_hash"]}
    rows = lambda index, t: sorted(map(tuple, index[t].select(*keys[t]).collect()))
    assert all(rows(index_store.load_index(spark, root), t) == rows(want, t) for t in keys)
    # A reader of the version before still reads all of it.
    assert all(sorted(map(str, held[t])) == sorted(str(tuple(r)) for r in old[t].collect()) for t in ("files", "chunks"))
    more = changes(spark, ("t1", "another change to see", "m3.md"), ("t2", "another change to see", "m4.md"))
    assert len(index_store.refresh_commits(spark, root, more, now)) <= 2
    index_store.refresh_commits(spark, root, more, now)  # the batch comes again
    now_there = {r.file_path: r.churn_count for r in index_store.load_index(spark, root)["chunks"].collect()}
    assert now_there["m3.md"] == 2 and now_there["m5.md"] == 1 and "m9.md" not in now_there
    kept = {f"v={r.version}"[2:] for r in bucketed.pointer(spark, root).collect() if r.version} | {r.version for p in bucketed.files_below(spark, f"{root}/pointer") for r in spark.read.schema(bucketed.POINTER).parquet(p).collect()}
    assert len(bucketed.files_below(spark, f"{root}/pointer")) == 2
    assert all(p.rsplit("/", 1)[1] in kept for p in bucketed.files_below(spark, f"{root}/chunks"))
    # A refresh that never published is not seen.
    index_store.load_index(spark, root)["chunks"].limit(1).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{root}/chunks/v=lost")
    assert rows(index_store.load_index(spark, root), "files") == rows(want, "files")


def test_histories_merge(spark):
    from tidemark.operators import ranking as r

    rows = [(f"c{i:03}", f"2024-01-{1 + i % 28:02}", "bump it up once more" if i % 3 == 0 else f"a change number {i}", f"f{i % 2}", i, 1) for i in range(120)]
    every = spark.createDataFrame(rows, "sha string, day string, message string, path string, added long, deleted long").withColumn("ts", F.col("day").cast("timestamp_ntz"))
    now, (a, b) = "2024-03-01", (every.filter("sha < 'c070'"), every.filter("sha >= 'c050'"))  # some come twice
    merged, whole = history.merged_history(history.file_history(a, 30), history.file_history(b, 30), 30), history.file_history(every, 30)
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))
    stats = history.commit_file_stats(every)
    assert sorted(map(tuple, history.history_scores(merged, now).collect())) == sorted(map(tuple, history.file_hotspots(stats, now).collect()))
    assert sorted((x.path, x.sha) for x in history.history_commits(merged, 10).collect()) == sorted((x.path, x.sha) for x in r.recent_commits(stats, 10).collect())


def test_source_tree_prunes_and_pushes(spark, tmp_path):
    rows = [(f"src/d{i % 5}/e{i % 3}/f{i}.rs", f"fn f{i}() {{}}") for i in range(200)] + [("node_modules/x/a.js", "x"), ("gen/deep/b.rs", "y"), ("src/empty.md", None)]
    trees.write_source_tree(spark.createDataFrame(rows, "path string, text string"), f"{tmp_path}/t")
    want = sorted(p for p, _ in rows[:200] + rows[202:])
    for folders in (1, 3, 64):
        assert sorted(r.path for r in trees.read_source_tree(spark, f"file://{tmp_path}/t", ("gen/",), folders).collect()) == want
    seen = []
    reader = trees.TreeReader(f"file://{tmp_path}/t", ("gen/**",), 64)
    listed = reader.listed
    reader.listed = lambda folder: (seen.append(folder), listed(folder))[1]
    rest = list(reader.pushFilters([trees.StringStartsWith(("path",), "src/d3/"), trees.EqualTo(("language",), "rust")]))
    got = sorted(r for p in reader.partitions() for b in reader.read(p) for r in b.column("path").to_pylist())
    assert got == sorted(p for p, _ in rows if p.startswith("src/d3/")) and [f.attribute for f in rest] == [("language",)]
    assert set(seen) <= {"", "src", "src/d3", "src/d3/e0", "src/d3/e1", "src/d3/e2"}
    one = trees.read_source_tree(spark, f"{tmp_path}/t").filter(F.col("path").isin("src/d1/e1/f1.rs", "none"))
    assert [r.language for r in one.collect()] == ["rust"]
    with pytest.raises(Exception, match="not a path below"):
        trees.write_source_tree(spark.createDataFrame([("../x.rs", "")], "path string, text string"), f"{tmp_path}/u")


def test_symbol_history_by_line_buckets_equals_all_pairs(spark):
    """Most changes are of one file; some are longer than a bucket, empty (they end before they start) or without lines."""
    import random

    from tidemark.operators import history

    rng = random.Random(5)
    symbols = [(f"s{n}", "hot" if n % 4 else "cold", (a := rng.randrange(3000)), a + rng.choice([0, 5, 40, 255, 256, 900])) for n in range(60)] + [("none", "hot", None, 5)]
    hunks = [("hot" if n % 10 else "cold", (a := rng.randrange(3000)), a + rng.choice([-1, 0, 3, 30, 256, 700]), f"{n:07d}", n // 3) for n in range(300)] + [("hot", 1, None, "x", 1)]
    got = history.symbol_history(
        spark.createDataFrame(symbols, "id string, file_path string, line_start int, line_end int"),
        spark.createDataFrame([(*h[:4], h[4], "me", "m") for h in hunks], "path string, start int, end int, sha string, t long, author string, message string").selectExpr("*", "timestamp_seconds(t) as ts"),
    )
    want = {}
    for i, path, first, last in symbols:
        if first is not None:
            over = [h for h in hunks if h[0] == path and h[2] is not None and h[1] <= last and h[2] >= first]
            want[i] = [h[3] for h in sorted(over, key=lambda h: (-h[4], h[3]))[:8]]
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.id, r["rank"])):
        found.setdefault(r.id, []).append(r.text[:7])
    assert found == {i: shas for i, shas in want.items() if shas}


def test_symbols_of_odd_files(spark):
    """Nulls, empty and unbalanced files, marks in the text, strings that never end, a very long file."""
    texts = [
        ("null.c", None), ("empty.go", ""), ("open.java", "class A {\n  int f() {\n"), ("shut.rs", "}}}\nfn f() {\n}\n"), ("mark.js", "function a\x01b() {}\nfunction c() { return '\x02' }\n"),
        ("string.kt", 'fun f() {\n  val s = "never ends\n}\n'), ("long.c", "int f(int a)\n{\n" + '  s = "}\\\\";\n' * 20_000 + "}\nint g(void) { }\n"), ("x.unknown", "fn f() {}"),
    ]
    got = {(r.path, r.qualified_name): (r.line_start, r.line_end) for r in indexing.extract_symbols(spark.createDataFrame(texts, "path string, text string")).collect()}
    assert got == {("open.java", "A"): (1, 2), ("open.java", "A.f"): (2, 2), ("shut.rs", "f"): (2, 3), ("mark.js", "c"): (2, 2), ("string.kt", "f"): (1, 3), ("long.c", "f"): (1, 20_003), ("long.c", "g"): (20_004, 20_004)}
    none = indexing.extract_symbols(spark.createDataFrame([], "path string, text string"))
    assert none.count() == 0


def test_the_build_query_gives_each_chunk_once_with_its_file(spark, tmp_path):
    """Chunks and vectors both name their file; a query of both has the chunk's."""
    from tidemark.plans import job_queries

    rows = [(0, "one\n\ntwo", "a"), (1, "x. y.\nz.\nrest", "a"), (2, "", "b"), (4, "only", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("SELECT 1L AS o_orderkey, timestamp_ntz'2001-01-01 00:00:00' AS o_orderdate, 'x' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 1L AS l_orderkey, 1L AS l_partkey, 2.0D AS l_quantity, 1 AS l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = job_queries.c3(spark, str(tmp_path)).collect()
    assert sorted((r.file_path, r.symbol_name, r.line_start, r.line_end) for r in found) == [
        ("a/d0.md", "#", 2, 2), ("a/d0.md", "# one", 1, 1), ("a/d0.md", "# two", 3, 3), ("a/d1.sql", "rest", 3, 3), ("a/d1.sql", "x; y;", 1, 1), ("a/d1.sql", "z;", 2, 2), ("b/d4.sql", "only", 1, 1),
    ]
    assert len({r.id for r in found}) == 7 and {r.embed_model for r in found} == {"hashed-words-1"}
