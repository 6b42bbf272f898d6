import random

from pyspark.sql import functions as F

from tidemark.functions import render as R
from tidemark.functions import scalars as S


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    return spark.createDataFrame([tuple(v for _, v in values.values()) or (1,)], schema).select(column.alias("r")).first().r


def texts(spark, f, values):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, x string").select("n", f("x").alias("r")).orderBy("n").collect()
    return [r.r for r in rows]


M = "[REDACTED]"
a = lambda n: "a1B2" * (n // 4) + "c" * (n % 4)
SECRETS = [
    ("-----BEGIN RSA KEY-----\nabc\n-----END RSA KEY-----", M), ("eyJab.cd_.e-f", M), ("AKIA" + "Z9" * 8, M), ("x sk-abcdefghij y", f"x {M} y"), ("sk_live_" + a(24), M),
    ("ghp_" + a(36), M), ("gho_" + a(36), M), ("ghu_" + a(36), M), ("ghs_" + a(36), M), ("github_pat_" + a(82), M), ("xoxb-1234567890", M), ("AIza" + a(35), M), ("GOCSPX-" + a(28), M),
    ("Cloudflare: '" + "0f" * 20 + "'", M), ("npm_" + a(36), M), ("HEROKU 01234567-89ab-cdef-0123-456789abcdef", M), ("AC" + "a1" * 16, M), ("SK" + "a1" * 16, M), ("SG." + a(22) + "." + a(43), M),
    ("PASSWORD = \"" + a(20) + "\"", 'PASSWORD = "' + M),
]
NEAR = ["-----BEGIN x-----", "eyJab.cd", "AKIA" + "Z" * 15, "sk-abcdefghi", "sk_live_" + a(23), "ghp_" + a(35), "github_pat_abc", "xoxz-1234567890", "AIza" + a(34), "npm_x", "AC" + "A1" * 16, "key = " + a(19), "plain text", "", None]


def test_each_secret_is_redacted_once_and_near_misses_stay(spark):
    assert texts(spark, S.sanitize, [x for x, _ in SECRETS]) == [y for _, y in SECRETS]
    assert texts(spark, S.sanitize, NEAR) == NEAR
    both = texts(spark, S.sanitize, ["ghp_" + a(36) + " and token=" + a(30)])
    assert both == [f"{M} and token={M}"] and texts(spark, S.sanitize, both) == both


def test_scores(spark):
    get = lambda days, access, importance, source="realtime", type_="decision": one(spark, S.retention_score("t", "i", "d", "a", "s"), t=("string", type_), i=("double", importance), d=("double", days), a=("long", access), s=("string", source))
    assert abs(get(0.0, 0, 1.0) - 0.9) < 1e-12 and abs(get(0.0, 0, 0.0, "reviewed") - 0.1) < 1e-12
    assert get(0.0, 10**6, 1.0, "reviewed") == 1.0 and abs(get(0.0, 10**6, 0.0) - 0.3) < 1e-12
    assert get(60.0, 0, 1.0) < get(7.0, 0, 1.0) < get(0.0, 0, 1.0)
    assert abs(get(0.0, 0, 1.0, type_="never heard of") - 0.5) < 1e-12


def test_days_since(spark):
    days = lambda t: one(spark, S.days_since("t", "2024-01-08 00:00:00"), t=("string", t))
    assert days("2024-01-01 00:00:00") == 7 and days(None) == 0 and days("2024-01-09 00:00:00") == -1


def test_intents_match_inside_words(spark):
    boost = lambda q, t: one(spark, S.source_boost("q", "t"), q=("string", q), t=("string", t))
    assert boost("show me", "workflow") == 1.3 and boost("WHY", "decision") == 1.3 and boost("why", "fact") == 1.0 and boost("it", "decision") == 1.0


def test_keywords_are_literal_and_fold_ascii_only(spark):
    match = lambda q, x: one(spark, S.keyword_match("q", "x"), q=("string", q), x=("string", x))
    assert match("50%_A\\b", "x 50%_a\\B y") and not match("50%", "500") and not match("É", "é") and not match("a", None)


def test_terms_and_hashes(spark):
    assert texts(spark, S.query_terms, ["a.b my_function !! ", "", "  "]) == [["ab", "my_function"], [], []]
    h = texts(spark, S.body_hash, [None, "", " a \r\nb\n", "a\nb", "a\n\nb", "a\nb\n\n"])
    assert h[0] == h[1] and h[2] == h[3] and len(set(h[1:])) == 4


def test_messages_count_bytes(spark):
    got = texts(spark, S.is_significant, ["fourteen bytes"[:14], "fifteen bytes!!", "ééééééée" + "é" * 0, "Merged the branch today", "x Merge in the middle", "chore: bump the thing"])
    assert got == [False, True, True, False, True, False]


def test_paths(spark):
    assert texts(spark, S.is_excluded, ["src/target/x.rs", "a/b.min.js", "x/package-lock.json", "Cargo.lock", "src/targets/x.rs", "a/build.rs"]) == [True] * 4 + [False] * 2
    assert texts(spark, S.language_of, ["a/b.rs", "b.tar.PY", ".rs", "x.mdx", "d.x/y", "a.b.tf"]) == ["rust", None, None, "markdown", None, "hcl"]
    glob = lambda p, x: one(spark, S.glob_match("p", "x"), p=("string", p), x=("string", x))
    assert glob("vendor/**", "vendor/a") and glob("vendor/", "vendor") and not glob("vendor/**", "vendors/a") and glob("**/foo", "a/foo") and not glob("**/foo", "afoo") and glob("a\\b", "a/b")
    assert texts(spark, S.project_slug, ["git@github.com:u/r.git", "https://x.org/u/r", "ssh://h/r.git"]) == ["github.com-u-r", "x.org-u-r", "h-r"]


def test_symbol_kinds_and_tags(spark):
    assert texts(spark, S.symbol_kind, ["method_function", "class_struct", "trait_item", "object", "x"]) == ["method", "class", "interface", "module", "symbol"]
    tags = lambda t, w: one(spark, S.has_all_tags("t", "w"), t=("array<string>", t), w=("array<string>", w))
    assert tags(["a", "b"], ["a"]) and tags(None, []) and not tags(None, ["a"])


def test_cosine(spark):
    d = lambda x, y: one(spark, S.cosine_distance("x", "y"), x=("array<float>", x), y=("array<float>", y))
    assert d([1.0, 0.0], [2.0, 0.0]) == 0 and d([0.0], [1.0]) == 1 and d(None, [1.0]) == 1 and d([1.0, 0.0], [-1.0, 0.0]) == 2


def test_truncation(spark):
    cut = lambda x, n: one(spark, R.truncate_to_budget(F.col("x"), n), x=("string", x))
    assert cut("abc", 3) == "abc" and cut("abcd", 3) == "abc" and cut("aé", 2) == "a" and cut("a\nbc\nd", 5) == f"a\nbc\n{R.NOTICE}\n"


def test_summary(spark):
    full = one(spark, R.render_summary(F.lit("x\n"), "f", "t"), f=("array<string>", ["one"]), t=("array<string>", ["a", "b"]))
    assert full == "x\n  - one\n  tags: a, b\n\n" and one(spark, R.render_summary(F.lit("x\n"), "f", "t"), f=("array<string>", None), t=("array<string>", [])) == "x\n"


def test_lengths_never_grow_past_the_budget(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice("aé€🙂\n") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    for text, got in zip(values, texts(spark, lambda c: R.truncate_to_budget(c, 17, "."), values), strict=True):
        assert len(got.encode()) <= 17 + 3 and (len(text.encode()) > 17 or got == text) and "�" not in got
