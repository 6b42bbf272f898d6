"""Column functions: redaction, hashes, scores, predicates and lookups. All of them stay in the JVM.

A null argument gives null unless a function says otherwise. `now` is always an argument.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of secrets, in the order in which they are rewritten, each with a literal that every match
# holds (lower case: looked for in the lower-cased text), so that texts without it skip the pattern.
SECRETS = [
    ("-----BEGIN ", r"-----BEGIN [A-Z ]+-----[\s\S]*?-----END [A-Z ]+-----"),
    ("eyJ", r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+"),
    ("A", r"(A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}"),
    ("sk-", r"sk-[A-Za-z0-9_\-]{10,}"),
    ("k_", r"(sk|rk)_(live|test)_[0-9a-zA-Z]{24,}"),
    ("ghp_", r"ghp_[A-Za-z0-9]{36}"),
    ("gho_", r"gho_[A-Za-z0-9]{36}"),
    ("ghu_", r"ghu_[A-Za-z0-9]{36}"),
    ("ghs_", r"ghs_[A-Za-z0-9]{36}"),
    ("github_pat_", r"github_pat_[A-Za-z0-9_]{82}"),
    ("xox", r"xox[baprs]-[A-Za-z0-9\-]{10,}"),
    ("AIza", r"AIza[0-9A-Za-z\-_]{35}"),
    ("GOCSPX-", r"GOCSPX-[A-Za-z0-9\-_]{28}"),
    ("cloudflare", r"(?i)cloudflare.{0,20}['\"][0-9a-f]{40}['\"]"),
    ("npm_", r"npm_[A-Za-z0-9]{36}"),
    ("heroku", r"(?i)heroku.{0,20}[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    ("AC", r"AC[a-z0-9]{32}"),
    ("SK", r"SK[a-z0-9]{32}"),
    ("SG.", r"SG\.[A-Za-z0-9\-_]{22}\.[A-Za-z0-9\-_]{43}"),
    ("=", r"(?i)((?:token|secret|password|key|auth|api_key)\s*=\s*['\"]?)[A-Za-z0-9_\-\.]{20,}['\"]?"),
]
MARK = "[REDACTED]"
# Weights of note types; others weigh DEFAULT_WEIGHT.
TYPE_WEIGHTS = {
    "decision": 0.90, "gotcha": 0.88, "preference": 0.85, "problem-solution": 0.82, "how-it-works": 0.75,
    "trade-off": 0.72, "workflow": 0.68, "discovery": 0.65, "what-changed": 0.60, "fact": 0.55,
}
DEFAULT_WEIGHT = 0.50
# Words in a query that favour note types.
INTENTS = [
    (("why", "reason", "decision"), ("decision", "trade-off")),
    (("how", "steps", "workflow"), ("workflow", "how-it-works")),
    (("error", "broken", "fail"), ("gotcha", "problem-solution")),
    (("changed", "update", "new"), ("what-changed",)),
]
INTENT_BOOST = 1.3
STALE_BELOW, STALE_DAYS = 0.15, 7
# How commit messages begin that say little.
NOISE = ("merge", "revert", "bump", "wip", "fixup!", "squash!", "chore: bump")
LEAST_MESSAGE = 15
# What is never indexed.
EXCLUDED_DIRECTORIES = (".git", "target", "node_modules", "dist", "build", "__pycache__", ".venv", "vendor", ".mypy_cache", ".devenv")
EXCLUDED_ENDS = (".min.js", ".min.css", ".lock", ".sum")
EXCLUDED_NAMES = ("package-lock.json", "yarn.lock")
# Languages by file extension.
EXTENSIONS = {
    "rust": "rs", "python": "py pyi", "typescript": "ts", "tsx": "tsx", "javascript": "js mjs cjs", "go": "go",
    "cpp": "cpp cc cxx", "java": "java", "c": "c h", "bash": "sh bash zsh", "ruby": "rb", "csharp": "cs", "php": "php",
    "scala": "scala sc", "swift": "swift", "elixir": "ex exs", "lua": "lua", "haskell": "hs", "nix": "nix",
    "solidity": "sol", "kotlin": "kt kts", "ocaml": "ml mli", "r": "r", "zig": "zig", "erlang": "erl hrl", "ql": "ql",
    "elm": "elm", "powershell": "ps1 psm1", "dart": "dart", "objc": "m mm", "tlaplus": "tla", "css": "css",
    "json": "json jsonc", "html": "html htm", "yaml": "yaml yml", "hcl": "hcl tf", "toml": "toml", "markdown": "md mdx",
    "embedded_template": "erb ejs", "diff": "diff patch", "xml": "xml", "sql": "sql",
}
STRUCTURAL = ("css", "json", "html", "yaml", "hcl", "toml", "markdown", "embedded_template", "diff", "xml", "sql")
# Parts of syntax-node names and the symbol kinds that they stand for, first match first.
SYMBOL_KINDS = [
    ("method", "method"), ("function", "function"), ("class", "class"), ("struct", "struct"), ("enum", "enum"),
    ("interface", "interface"), ("trait", "interface"), ("protocol", "interface"), ("type", "type"),
    ("module", "module"), ("object", "module"),
]
#: Blanks at the ends of a line.
BLANK_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def at_time(now: datetime | str | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp")


def rewriting(hint: str, pattern: str, keep: str):
    """A function that rewrites one rule's matches, if a text holds its hint."""
    folds = pattern.startswith("(?i)")
    regex = "(?id)" + pattern[4:] if folds else "(?d)" + pattern

    def rule(x: Column) -> Column:
        there = F.lower(x).contains(hint) if folds else x.contains(hint)
        return F.when(there, F.regexp_replace(x, regex, keep + MARK)).otherwise(x)

    return rule


def sanitize(c: Column | str) -> Column:
    """Secrets rewritten to a mark, rule after rule; the last rule keeps the key's name."""
    out = col(c)
    for hint, pattern in SECRETS:
        # As a list of one, so that the rules so far stand in the expression once, not three times.
        out = F.get(F.transform(F.array(out), rewriting(hint, pattern, "$1" if pattern is SECRETS[-1][1] else "")), F.lit(0))
    return out


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def type_weight(c: Column | str) -> Column:
    """Null weighs as an unknown type."""
    out = F.lit(DEFAULT_WEIGHT)
    for name, weight in TYPE_WEIGHTS.items():
        out = F.when(col(c) == name, weight).otherwise(out)
    return out


def days_since(c: Column | str, now) -> Column:
    """Whole seconds from a time to now, in days; below 0 for later times, 0 for null."""
    gap = F.unix_micros(at_time(now)) - F.unix_micros(col(c).cast("timestamp"))
    return F.coalesce(F.call_function("div", gap, F.lit(1_000_000)) / F.lit(86400.0), F.lit(0.0))


def retention_score(type_, importance, days, access, source) -> Column:
    fading = type_weight(type_) * col(importance) * F.exp(F.lit(-0.01) * col(days))
    used = F.least(F.lit(0.03) * F.log(col(access) + F.lit(1.0)), F.lit(0.3))
    return F.least(F.lit(1.0), fading + used + F.when(col(source) == "reviewed", 0.1).otherwise(0.0))


def source_boost(query, type_) -> Column:
    """The first intent whose words the query holds decides alone; the words may stand inside others."""
    low, out = F.lower(col(query)), F.lit(1.0)
    for words, types in reversed(INTENTS):
        said = F.lit(False)
        for word in words:
            said = said | low.contains(word)
        out = F.when(said & col(type_).isin(*types), INTENT_BOOST).otherwise(out)
    return out


def is_stale(pinned, retention, days) -> Column:
    """Days since the last access."""
    return ~col(pinned) & (col(retention) < STALE_BELOW) & (col(days) >= STALE_DAYS)


def lower_ascii(c: Column | str) -> Column:
    return F.translate(col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyword_match(query, *columns) -> Column:
    """The query stands literally, but for the case of ASCII letters, in one of the columns; null columns hold nothing."""
    want, out = lower_ascii(query), F.lit(False)
    for c in columns:
        out = out | F.coalesce(lower_ascii(c).contains(want), F.lit(False))
    return out


def query_terms(c: Column | str) -> Column:
    """Words, stripped of all but letters, digits and underscores; each is a prefix to look for."""
    words = F.split(col(c), r"[\s\p{Z}]+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")), lambda w: w != "")


def lines_of(c: Column | str) -> Column:
    """A text's lines: a last line break ends a line and begins none, and a carriage return before one goes."""
    return F.split(F.regexp_replace(col(c), r"\r?\n\z", ""), "\r?\n")


def body_hash(c: Column | str) -> Column:
    """Of the lines without blanks at their ends; null hashes as an empty text."""
    text = F.coalesce(col(c), F.lit(""))
    return F.sha2(F.array_join(F.transform(lines_of(text), lambda x: F.regexp_replace(x, BLANK_ENDS, "")), "\n"), 256)


def is_significant(c: Column | str) -> Column:
    low, noise = F.lower(col(c)), F.lit(False)
    for start in NOISE:
        noise = noise | low.startswith(start)
    return (F.octet_length(col(c)) >= LEAST_MESSAGE) & ~noise


def commit_weight(ts, lines, now) -> Column:
    """Half of it goes in 180 days; 100 lines count 1, 300 and more 3; commits to come are new."""
    age = F.greatest(days_since(ts, now), F.lit(0.0))
    return F.exp(-F.log(F.lit(2.0)) * age / 180) * F.least(col(lines) / F.lit(100.0), F.lit(3.0))


def is_excluded(path: Column | str) -> Column:
    def one(name: Column) -> Column:
        out = name.isin(*EXCLUDED_DIRECTORIES, *EXCLUDED_NAMES)
        for end in EXCLUDED_ENDS:
            out = out | name.endswith(end)
        return out

    return F.exists(F.split(col(path), "/"), one)


def glob_match(pattern, path) -> Column:
    """`dir/**` and `dir/` are all below dir and dir itself, `**/name` any path that ends with it, else the path."""
    p, x = F.replace(col(pattern), F.lit("\\"), F.lit("/")), F.replace(col(path), F.lit("\\"), F.lit("/"))
    folder, name = F.regexp_replace(p, r"/(\*\*)?$", ""), F.regexp_replace(p, r"^\*\*/", "")
    below = x.startswith(F.concat(folder, F.lit("/"))) | (x == folder)
    return F.when(p.endswith("/**") | p.endswith("/"), below).when(p.startswith("**/"), (x == name) | x.endswith(F.concat(F.lit("/"), name))).otherwise(x == p)


def language_of(path: Column | str) -> Column:
    """By the extension of the path's last part, case and all; null where none is known."""
    extension = F.regexp_extract(F.regexp_extract(col(path), r"([^/]*)$", 1), r"^.+\.([^.]+)$", 1)
    known = [F.lit(x) for name, ends in EXTENSIONS.items() for end in ends.split() for x in (end, name)]
    return F.try_element_at(F.create_map(*known), extension)


def chunk_strategy(language: Column | str) -> Column:
    return F.when(col(language).isin(*STRUCTURAL), "structural").when(col(language).isNotNull(), "code")


def symbol_kind(c: Column | str) -> Column:
    out = F.lit("symbol")
    for part, kind in reversed(SYMBOL_KINDS):
        out = F.when(col(c).contains(part), kind).otherwise(out)
    return out


def doc_line(doc: Column | str, marks: tuple[str, ...] = ("///", "//!", "/**")) -> Column:
    """The first line of a doc comment without its marks; null if there is none."""
    first = F.regexp_replace(F.get(lines_of(doc), F.lit(0)), BLANK_ENDS, "")
    clean = first
    for mark in marks:
        clean = F.regexp_replace(clean, "^(" + mark.replace("*", r"\*") + ")+", "")
    return F.when(first != "", F.regexp_replace(clean, BLANK_ENDS, ""))


def build_embed_text(kind, name, path, signature, doc, preview) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(col(kind), F.lit(": "), col(name)),
        F.concat(F.lit("File: "), col(path)),
        F.concat(F.lit("Signature: "), col(signature)),
        F.concat(F.lit("Doc: "), doc_line(doc)),
        col(preview),
    )


def project_slug(url: Column | str) -> Column:
    return F.translate(F.regexp_replace(F.regexp_replace(col(url), "^(git@|https://|http://|ssh://)", ""), r"\.git$", ""), "/:@", "---")


def has_all_tags(tags, wanted) -> Column:
    """Null tags are none; nothing wanted is always there."""
    none = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(col(wanted), none), F.coalesce(col(tags), none))) == 0


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_length(a) -> Column:
    a = col(a)
    return F.sqrt(_dot(a, a))


def cosine_distance(a, b, a_length=None, b_length=None) -> Column:
    """1 for null, empty or zero vectors. Where a vector is in many pairs, its length may be given."""
    a, b = col(a), col(b)
    size = (vector_length(a) if a_length is None else col(a_length)) * (vector_length(b) if b_length is None else col(b_length))
    return F.coalesce(F.when(size > 0, 1 - _dot(a, b) / size), F.lit(1.0))
