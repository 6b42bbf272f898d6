"""Commit history: lines changed, churn and hotspots of files, and their links to code chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import commit_weight, is_significant
from tidemark.operators.ranking import growing, recent_commits, top_k

LIMIT, UPDATE_LIMIT = 10, 50
#: Newest commits of a file that its history keeps: what both limits need.
KEPT = 3 * UPDATE_LIMIT
EXACT = 9
#: Lines of a bucket by which odd changes meet symbols; the highest level of cells, of 4,096 lines each.
LINES, LEVELS = 256, 12


def commit_file_stats(changes: DataFrame, repo: bool = False) -> DataFrame:
    """Lines changed of each commit and file, with the commit's time and message."""
    keys = [*(["repo"] if repo else []), "sha", "path"]
    return changes.groupBy(*keys).agg(F.sum(F.col("added") + F.col("deleted")).alias("lines"), F.min("ts").alias("ts"), F.min("message").alias("message"))


def file_hotspots(commit_files: DataFrame, now, limit: int = LIMIT) -> DataFrame:
    """(path, churn_count, hotspot_score) of files with significant commits among their newest."""
    recent = recent_commits(commit_files, limit)
    return recent.groupBy("path").agg(F.count(F.lit(1)).alias("churn_count"), F.round(F.sum(commit_weight("ts", "lines", now)), EXACT).alias("hotspot_score"))


def with_hotspots(chunks: DataFrame, hotspots: DataFrame) -> DataFrame:
    """Chunks with their file's churn and hotspot; 0 where it has none."""
    base = chunks.drop("churn_count", "hotspot_score")
    joined = base.join(hotspots.withColumnRenamed("path", "file_path"), "file_path", "left")
    return joined.withColumns({"churn_count": F.coalesce("churn_count", F.lit(0)).cast("long"), "hotspot_score": F.coalesce("hotspot_score", F.lit(0.0))})


def related_commits(chunks: DataFrame, bridge: DataFrame, commits: DataFrame, n: int) -> DataFrame:
    """(id, related_commits): messages of a chunk's first n commits by sha; [] for none."""
    links = growing(bridge).join(chunks.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id", "left_semi")
    first = top_k(links, ["chunk_id"], [F.asc("commit_sha")], n, "_r").join(growing(commits).select(F.col("sha").alias("commit_sha"), "message"), "commit_sha")
    lists = first.groupBy(F.col("chunk_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "message"))), lambda x: x["message"]).alias("related_commits"))
    return growing(chunks.select("id").distinct()).join(lists, "id", "left").withColumn("related_commits", F.coalesce("related_commits", F.array().cast("array<string>")))


def link_chunks(chunks: DataFrame, file_commits: DataFrame) -> DataFrame:
    """Distinct (chunk_id, commit_sha, file_path) of chunks and their file's commits."""
    return growing(chunks.select(F.col("id").alias("chunk_id"), "file_path")).join(file_commits.select(F.col("path").alias("file_path"), F.col("sha").alias("commit_sha")).distinct(), "file_path").select("chunk_id", "commit_sha", "file_path").distinct()


def file_links(chunks: DataFrame, file_commits: DataFrame) -> DataFrame:
    """Distinct (path, commit_sha) of files with chunks: what link_chunks gives to each chunk of a file."""
    return file_commits.select("path", F.col("sha").alias("commit_sha")).distinct().join(chunks.select(F.col("file_path").alias("path")).distinct(), "path", "left_semi")


def by_lines(rows: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """Each row once for every bucket of its lines, with its first one as `name`."""
    low, high = (F.floor(of(first, last) / LINES) for of in (F.least, F.greatest))
    lines = rows.filter(F.col(first).isNotNull() & F.col(last).isNotNull())
    return lines.withColumn(name, low).withColumn("_bucket", F.explode(F.sequence(low, high)))


def line_cells(first: Column, last: Column) -> Column:
    """The cells that make up lines first to last, an array of (level, cell); cell c of a level has the 2^level lines from
    c * 2^level on. They are few: two of each level at most, but of the highest."""
    inner = lambda n, level: (n > _cell(first - 1, level)) & (n < _cell(last + 1, level))

    def of(level: int) -> Column:
        low, end = _cell(first - 1, level) + 1, _cell(last + 1, level)
        if level == LEVELS:
            return F.when(low < end, F.sequence(low, end - 1)).otherwise(F.array().cast("array<bigint>"))
        ends = F.array_distinct(F.array(low, end - 1))
        return F.filter(ends, lambda n: (n >= low) & (n < end) & ~inner(F.shiftright(n, 1), level + 1))

    def named(level: int) -> Column:
        return F.transform(of(level), lambda n: F.struct(F.lit(level).alias("level"), n.alias("cell")))

    return F.flatten(F.array(*map(named, range(LEVELS + 1))))


def cells_of_line(line: Column) -> Column:
    """The cell of each level that holds a line."""
    return F.array(*(F.struct(F.lit(level).alias("level"), _cell(line, level).alias("cell")) for level in range(LEVELS + 1)))


def _cell(line: Column, level: int) -> Column:
    return F.shiftright(line.cast("long"), level)


def symbol_history(symbols: DataFrame, hunks: DataFrame, n: int = 8) -> DataFrame:
    """(id, rank, text): the newest n changes whose lines overlap a symbol's, `sha7 message (author, date)`. Rows without
    lines overlap nothing.

    A change overlaps a symbol if it begins on one of its lines but the first, or holds the first. So changes lie in the
    cells of the line on which they begin, and in those that make up their lines, and each cell keeps its newest n; a
    symbol looks into the cells that make up its lines, and into those of its first line. What is done grows with changes
    and symbols and not with their pairs. Changes and symbols that end more than a line before they begin meet by buckets.
    """
    who, newest = ["sha", "ts", "author", "message"], [F.desc("ts"), F.asc("sha"), F.asc("message"), F.asc("author")]
    own = symbols.select("id", F.col("file_path").alias("path"), "line_start", "line_end").filter("line_start is not null and line_end is not null")
    changed = hunks.select("path", "start", "end", *who).filter("start is not null and `end` is not null")

    def kept(rows: DataFrame, by: list[str]) -> DataFrame:
        rank = F.dense_rank().over(W.partitionBy(*by).orderBy(*newest))
        return rows.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r").dropDuplicates([*by, *who])

    begun = kept(changed.filter("`end` >= start - 1").select("path", F.col("start").cast("long").alias("start"), *who), ["path", "start"])
    begins = begun.select("path", F.lit(0).alias("kind"), F.explode(cells_of_line(F.col("start"))).alias("c"), *who)
    holds = changed.filter("`end` >= start").select("path", F.lit(1).alias("kind"), F.explode(line_cells(F.col("start"), F.col("end"))).alias("c"), *who)
    keys = ["path", "kind", "level", "cell"]
    cells = kept(begins.unionByName(holds).select("path", "kind", "c.level", "c.cell", *who), keys)
    # Symbols of the same lines are one.
    places = own.filter("line_end >= line_start").select("path", "line_start", "line_end").distinct()
    looks = [F.transform(line_cells(F.col("line_start") + 1, F.col("line_end")), lambda c: F.struct(F.lit(0).alias("kind"), c["level"].alias("level"), c["cell"].alias("cell"))),
             F.transform(cells_of_line(F.col("line_start")), lambda c: F.struct(F.lit(1).alias("kind"), c["level"].alias("level"), c["cell"].alias("cell")))]
    asked = places.select("path", "line_start", "line_end", F.explode(F.concat(*looks)).alias("c")).select("path", "line_start", "line_end", "c.kind", "c.level", "c.cell")
    near = kept(growing(cells).join(asked, keys).select("path", "line_start", "line_end", *who), ["path", "line_start", "line_end"])
    usual = growing(own.filter("line_end >= line_start")).join(near, ["path", "line_start", "line_end"]).select("id", *who)
    odd = met_by_lines(own, changed.filter("`end` < start - 1")).unionByName(met_by_lines(own.filter("line_end < line_start"), changed.filter("`end` >= start - 1")))
    over = usual.unionByName(odd.select("id", *who)).distinct()
    text = F.concat(F.substring("sha", 1, 7), F.lit(" "), F.col("message"), F.lit(" ("), F.col("author"), F.lit(", "), F.substring(F.col("ts").cast("string"), 1, 10), F.lit(")"))
    return top_k(over, ["id"], newest, n).select("id", "rank", text.alias("text"))


def met_by_lines(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """Pairs that overlap, met by path and bucket of lines, each in its first common bucket."""
    own, changed = by_lines(symbols, "line_start", "line_end", "_own"), by_lines(hunks, "start", "end", "_first")
    near = growing(changed).join(own, ["path", "_bucket"]).filter(F.col("_bucket") == F.greatest("_own", "_first"))
    return near.filter("start <= line_end and `end` >= line_start")


def file_history(changes: DataFrame, keep: int = KEPT) -> DataFrame:
    """(path, newest): each file's newest commits, an array of (age, sha, ts, message, lines) from the newest on. Such
    histories merge, so churn, hotspots and links follow from them and a batch of commits alone."""
    zone_less = dict(changes.dtypes)["ts"] == "timestamp_ntz"
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") if zone_less else F.unix_micros("ts")
    newest = top_k(commit_file_stats(changes), ["path"], [F.desc("ts"), F.asc("sha")], keep, "_r")
    entry = F.struct(F.coalesce(-micros, F.lit(2**63 - 1)).alias("age"), "sha", "ts", "message", "lines")
    return newest.groupBy("path").agg(F.array_sort(F.collect_list(entry)).alias("newest"))


def merged_history(old: DataFrame, new: DataFrame, keep: int = KEPT) -> DataFrame:
    """The history of both; a commit that comes again counts once, as in new."""
    kind = old.schema["newest"].dataType.simpleString()  # of either, written and read again or not: its fields may be null
    both = old.select("path", F.col("newest").cast(kind).alias("_old")).join(new.select("path", F.col("newest").cast(kind).alias("_new")), "path", "full_outer")
    none = F.array().cast(kind)
    fresh = F.coalesce("_new", none)
    rest = F.filter(F.coalesce("_old", none), lambda x: ~F.exists(fresh, lambda y: y["sha"] == x["sha"]))
    return both.select("path", F.slice(F.array_sort(F.concat(fresh, rest)), 1, keep).alias("newest"))


def recent_of(history: DataFrame, limit: int) -> DataFrame:
    """(path, recent): as recent_commits, the newest `limit` significant ones among the newest 3 * limit."""
    near = F.filter(F.slice("newest", 1, 3 * limit), lambda x: is_significant(x["message"]))
    return history.select("path", F.slice(near, 1, limit).alias("recent"))


def history_scores(history: DataFrame, now, limit: int = LIMIT) -> DataFrame:
    """(path, churn_count, hotspot_score) as file_hotspots has them; 0 for files without significant commits."""
    score = F.aggregate("recent", F.lit(0.0), lambda total, x: total + commit_weight(x["ts"], x["lines"], now))
    return recent_of(history, limit).select("path", F.size("recent").cast("long").alias("churn_count"), F.round(score, EXACT).alias("hotspot_score"))


def history_commits(history: DataFrame, limit: int) -> DataFrame:
    """(path, sha, message, ts) of each file's recent commits."""
    return recent_of(history, limit).select("path", F.explode("recent").alias("c")).select("path", "c.sha", "c.message", "c.ts")


def apply_commits(index: dict[str, DataFrame], changes: DataFrame, now, limit: int = UPDATE_LIMIT) -> dict[str, DataFrame]:
    """The index after new commits: files in them get churn and hotspot anew from their history merged with the batch,
    their chunks links to the files' recent commits. Nothing is parsed or embedded, and no older change is read."""
    return apply_history(index, file_history(changes), now, limit)


def apply_history(index: dict[str, DataFrame], batch: DataFrame, now, limit: int = UPDATE_LIMIT) -> dict[str, DataFrame]:
    """As apply_commits, of a batch's file_history."""
    old = index["history"]
    touched = merged_history(old.join(batch.select("path"), "path", "left_semi"), batch)
    history = old.join(batch.select("path"), "path", "left_anti").unionByName(touched)
    hit = history_scores(touched, now, limit).select(F.col("path").alias("file_path"), F.col("churn_count").alias("new_churn"), F.col("hotspot_score").alias("new_score"))
    chunks = index["chunks"].join(hit, "file_path", "left")
    chunks = chunks.withColumns({"churn_count": F.coalesce("new_churn", "churn_count"), "hotspot_score": F.coalesce("new_score", "hotspot_score")}).select(*index["chunks"].columns)
    recent = history_commits(touched, limit)
    links = {"links": index["links"].unionByName(file_links(index["chunks"], recent)).distinct()} if "links" in index else {}
    return index | links | {
        "chunks": chunks,
        "bridge": index["bridge"].unionByName(link_chunks(index["chunks"], recent)).distinct(),
        "commits": index["commits"].select("sha", "message", "ts").unionByName(recent.select("sha", "message", "ts")).dropDuplicates(["sha"]),
        "history": history,
    }


def index_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files and chunks of each repo, and of all (repo null)."""
    both = files.select("repo", F.lit(1).alias("f"), F.lit(0).alias("c")).unionByName(chunks.select("repo", F.lit(0).alias("f"), F.lit(1).alias("c")))
    return both.rollup("repo").agg(F.sum("f").alias("files"), F.sum("c").alias("chunks"))


def index_run_report(diff: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files scanned, files that gave chunks, chunks stored."""
    scanned = diff.filter("change <> 'deleted'").agg(F.count(F.lit(1)).alias("files_scanned"))
    stored = chunks.agg(F.countDistinct("file_path").alias("files_indexed"), F.count(F.lit(1)).alias("chunks_stored"))
    return scanned.crossJoin(stored)  # one row each


