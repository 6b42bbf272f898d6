"""Keyword and full-text search for tables of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.functions.scalars import lower_ascii, query_terms
from tidemark.operators.ranking import growing, top_k
from tidemark.operators.steps import step

#: Bytes of a keyword's runs, and of a text that are looked at at once.
GRAM, WINDOW = 3, 1 << 20
#: Grams after which a batch of them leaves a worker, whatever the texts of its rows.
SENT = 1 << 18
#: Grams that a worker counts at once.
COUNTED = 1 << 22
K1, B = 1.2, 0.75
#: Decimals of a score; ranks go by the rounded value, then by id.
EXACT = 9


# A gram is a number: three bytes of UTF-8, or two, or one, or none, one kind after the other.
PAIRS, ONES, NONE = 1 << 24, (1 << 24) + (1 << 16), (1 << 24) + (1 << 16) + (1 << 8)
# Then hashes of longer runs of bytes, of which long keywords have a few each: a trigram that many memories hold would
# meet them all, and pairs would grow with the square of the input.
LONG, PLACES, RUNS, HASH_BITS = 16, 4, (1 << 24) + (1 << 17), 26
BITS = RUNS + (1 << HASH_BITS)


def distinct_grams(text: bytes, among: np.ndarray | None = None) -> np.ndarray:
    """All grams of a text, once each; with `among` (a flag for each gram) those flagged."""
    raw, out = np.frombuffer(text, np.uint8), [np.array([NONE], np.int32)]
    for at in range(0, len(raw), WINDOW):
        b = raw[at : at + WINDOW + GRAM - 1].astype(np.int32)
        every = np.concatenate([b[:-2] << 16 | b[1:-1] << 8 | b[2:], PAIRS + (b[:-1] << 8 | b[1:]), ONES + b])
        out.append(np.unique(every if among is None else every[among[every]]))
    found = np.unique(np.concatenate(out))
    return found if among is None else found[among[found]]


def run_hashes(raw: np.ndarray) -> np.ndarray:
    """The gram of the run of LONG bytes that begins at each place."""
    words = np.empty(max(0, len(raw) - 7), np.uint64)
    for at in range(min(8, len(words))):
        words[at::8] = raw[at : at + (len(raw) - at) // 8 * 8].view("<u8")
    h = words[:-8] * np.uint64(0x9E3779B97F4A7C15) + words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int32) + np.int32(RUNS)


def distinct_runs(text: bytes, among: np.ndarray) -> np.ndarray:
    """Grams of a text's long runs that have a bit in `among`, once each."""
    raw, out = np.frombuffer(text, np.uint8), [np.zeros(0, np.int32)]
    for at in range(0, len(raw) - LONG + 1, WINDOW):
        every = run_hashes(raw[at : at + WINDOW + LONG - 1])
        out.append(every[(among[every >> 3] >> (every & 7).astype(np.uint8)) & 1 > 0])
    return np.unique(np.concatenate(out))


def own_runs(keyword: bytes) -> np.ndarray:
    """As own_grams; of a long keyword the runs at a few places, first and last among them."""
    if len(keyword) < LONG:
        return own_grams(keyword)
    every = run_hashes(np.frombuffer(keyword, np.uint8))
    return np.unique(every[np.linspace(0, len(every) - 1, PLACES).astype(int)])


def own_grams(keyword: bytes) -> np.ndarray:
    """Grams of which a text that holds the keyword has all: runs of three bytes, or the keyword if it is shorter."""
    every = distinct_grams(keyword)
    return every[(every < PAIRS) if len(keyword) >= GRAM else (every >= PAIRS) & (every < ONES) if len(keyword) == 2 else (every >= ONES) & (every < NONE) if keyword else every == NONE]


def with_grams(df: DataFrame, text: str, grams_of: Callable[[bytes], np.ndarray]) -> DataFrame:
    """The other columns with each gram of the text."""
    kept = [c for c in df.columns if c != text]

    def sent(batch: pa.RecordBatch, first: int, found: list[np.ndarray]) -> pa.RecordBatch:
        rows = pa.array(np.repeat(np.arange(first, first + len(found)), [len(x) for x in found]))
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in kept), pa.array(np.concatenate(found).astype(np.int32))], names=[*kept, "gram"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, found, held = 0, [], 0
            for n, value in enumerate(batch.column(text)):
                found.append(grams_of((value.as_py() or "").encode()))
                held += len(found[-1])
                if held >= SENT or n + 1 == batch.num_rows:
                    yield sent(batch, first, found)
                    first, found, held = n + 1, [], 0

    return df.mapInArrow(work, StructType([*(df.schema[c] for c in kept), StructField("gram", IntegerType())]))


def bits_of(grams: DataFrame) -> bytes:
    """The bit of every gram of a table, 10 MB whatever its size."""
    size = 4096 * 8  # what bitmap_construct_agg makes
    rows = grams.select((F.col("gram") / size).cast("int").alias("k"), (F.col("gram") % size).cast("long").alias("p")).groupBy("k").agg(F.expr("bitmap_construct_agg(p)").alias("bits")).collect()
    out = bytearray(-(-BITS // size) * 4096)
    for r in rows:
        out[r.k * 4096 : (r.k + 1) * 4096] = bytes(r.bits).ljust(4096, b"\0")
    return bytes(out)


def lowered(memories: DataFrame) -> DataFrame:
    """(project_id, id, created_at, title, content, facts_json): what the keyword match reads of active memories, in lower
    case once for all queries."""
    facts = F.to_json("facts").alias("facts_json")
    held = memories.filter("status = 'active'").select("project_id", "id", "created_at", "title", "content", facts)
    return held.withColumns({c: lower_ascii(c) for c in ("title", "content", "facts_json")})


def grams_among(among: bytes | None) -> Callable[[bytes], np.ndarray]:
    """What gives the distinct grams of a text: those with a bit in `among`, or all short ones if it isn't given."""
    made: list[tuple] = []  # once in a worker

    def grams(raw: bytes) -> np.ndarray:
        if among is None:
            return distinct_grams(raw)
        if not made:
            bits = np.frombuffer(among, np.uint8)
            made.append((bits, bits[: RUNS // 8].any(), bits[RUNS // 8 :].any(), np.unpackbits(bits[: RUNS // 8], bitorder="little").view(bool)))
        bits, short, long, flags = made[0]
        none = np.zeros(0, np.int32)
        return np.concatenate([distinct_grams(raw, flags) if short else none, distinct_runs(raw, bits) if long else none])

    return grams


def matched_text(held: DataFrame) -> DataFrame:
    return held.select("project_id", "id", F.concat_ws("\n", "title", "content", "facts_json").alias("text"))


def build_gram_index(memories: DataFrame, among: bytes | None = None) -> DataFrame:
    """(project_id, id, gram): posting lists of the grams of active memories (of some grams). A table of all may be kept
    and given to keyword_top_k."""
    return with_grams(matched_text(lowered(memories)), "text", grams_among(among))


def gram_counts(held: DataFrame, among: bytes) -> DataFrame:
    """(project_id, gram, n): how many of the lowered memories of a project hold each of some grams. Workers count before
    anything is shuffled, so a batch gives a row for each project and gram and not for each memory."""
    grams_of = grams_among(among)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            projects = batch.column("project_id").dictionary_encode()
            codes, texts, found, size = projects.indices.to_pylist(), batch.column("text"), [], 0
            for n, value in enumerate(texts):
                if codes[n] is not None:  # without a project a memory is nobody's
                    found.append(grams_of((value.as_py() or "").encode()).astype(np.int64) + codes[n] * BITS)
                    size += len(found[-1])
                if found and (size >= COUNTED or n + 1 == len(texts)):
                    keys, counts = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([projects.dictionary.take(pa.array(keys // BITS)), pa.array((keys % BITS).astype(np.int32)), pa.array(counts.astype(np.int64))], names=["project_id", "gram", "n"])
                    found, size = [], 0

    counted = matched_text(held).select("project_id", "text").mapInArrow(work, StructType([held.schema["project_id"], StructField("gram", IntegerType()), StructField("n", LongType())]))
    return counted.groupBy("project_id", "gram").agg(F.sum("n").alias("n"))


def keyword_pairs(queries: DataFrame, memories: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """(project_id, keyword, id, created_at): each keyword asked in a project, in lower case and once, with the active
    memories of the project that hold it literally.

    Memories are found by posting lists of trigrams (grams, an index kept from before, or made here, and then of longer
    runs for long keywords): how many memories of the project hold each gram of a keyword is counted, and only the list of
    its rarest one is joined (and made);
    then the match is checked on the texts, which move once, by id. Keywords of one or two bytes have lists of their own,
    and the empty keyword that of all. A null keyword finds nothing.
    """
    asked = queries.select("query_id", "project_id", lower_ascii("keyword").alias("keyword")).filter("keyword is not null").groupBy("project_id", "keyword").agg(F.min("query_id").alias("query_id"))
    parts, held = step(with_grams(asked.withColumn("_text", F.col("keyword")), "_text", own_runs if grams is None else own_grams)), step(lowered(memories))
    own = parts.select("project_id", "gram").distinct()
    if grams is None:
        lists = gram_counts(held, bits_of(parts))
    else:
        lists = grams.join(own, ["project_id", "gram"], "left_semi").groupBy("project_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    # A gram that no memory holds has no list, and then the keyword isn't found either.
    rarest = parts.join(lists, ["project_id", "gram"], "left").groupBy("query_id", "project_id", "keyword").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    rarest = step(rarest.select("query_id", "project_id", "keyword", F.col("least.gram").alias("gram")))
    index = with_grams(matched_text(held), "text", grams_among(bits_of(rarest))) if grams is None else grams
    near = growing(index).join(rarest, ["project_id", "gram"]).select("query_id", "project_id", "keyword", "id")
    text = [F.coalesce(F.col(c).contains(F.col("keyword")), F.lit(False)) for c in ("title", "content", "facts_json")]
    return growing(near).join(growing(held), ["project_id", "id"]).filter(text[0] | text[1] | text[2]).select(F.col("query_id").alias("first_query_id"), "project_id", "keyword", "id", "created_at")


def with_first(asked: DataFrame) -> DataFrame:
    """Queries with the first one of their project and keyword."""
    return asked.withColumn("first_query_id", F.min("query_id").over(W.partitionBy("project_id", "keyword")))


def keyword_top_k(queries: DataFrame, memories: DataFrame, k: int, grams: DataFrame | None = None) -> DataFrame:
    """(query_id, project_id, id, rank): active memories of the query's project that hold its keyword literally, in
    order of creation. Queries of one project and keyword are ranked once."""
    best = top_k(keyword_pairs(queries, memories, grams), ["first_query_id", "project_id", "keyword"], [F.asc("created_at"), F.asc("id")], k)
    asked = queries.select("query_id", "project_id", lower_ascii("keyword").alias("keyword"))
    return growing(with_first(asked)).join(best, ["first_query_id", "project_id", "keyword"]).select("query_id", "project_id", "id", "rank")


def keyword_hits(queries: DataFrame, memories: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """(query_id, hits): how many active memories of its project hold a query's keyword literally; no row for none."""
    hits = keyword_pairs(queries, memories, grams).groupBy("project_id", "keyword").agg(F.count(F.lit(1)).alias("hits"))
    asked = queries.select("query_id", "project_id", lower_ascii("keyword").alias("keyword"))
    return growing(asked).join(hits, ["project_id", "keyword"]).groupBy("query_id").agg(F.sum("hits").alias("hits"))


def build_inverted_index(chunks: DataFrame, cols: list[str], id_col: str = "id") -> DataFrame:
    """(token, id, tf, length): how often a token stands in a row's columns, and how many tokens the row has. Rows are
    dealt by id first, since a small file may unpack to many, and then a row's tokens are together."""
    dealt = chunks.select(F.col(id_col).alias("id"), F.lower(F.concat_ws("\n", *cols)).alias("text")).repartition("id")
    tokens = dealt.select("id", F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), 0).alias("tokens"))
    return tokens.select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("token")).groupBy("token", "id", "length").agg(F.count(F.lit(1)).alias("tf")).select("token", "id", "tf", "length")


def build_prefix_dictionary(index: DataFrame) -> DataFrame:
    """(prefix, token, df): every prefix of every token of an index, and how many rows hold the token. A term finds the
    tokens that it begins by equality; the dictionary is as large as the vocabulary's letters, whatever the number of rows."""
    words = index.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ends = F.sequence(F.lit(1), F.char_length("token"))
    return words.select(F.explode(F.transform(ends, lambda n: F.substring("token", F.lit(1), n))).alias("prefix"), "token", "df")


def bm25_top_k(queries: DataFrame, index: DataFrame, k: int, dictionary: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): rows with a token that a term of the query begins. A row's score sums BM25 over all
    pairs of a term and such a token. Terms are looked up in the prefix dictionary (one kept from before, or made here),
    by equality, so that only their own tokens' postings are joined. Queries of the same terms, and then those whose terms
    begin the same tokens, are one: postings are joined and ranked once for all of them."""
    stats = index.select("id", "length").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    asked = queries.select("query_id", F.array_sort(F.array_distinct(F.transform(query_terms("query_text"), F.lower))).alias("terms")).filter(F.size("terms") > 0)
    alike = asked.groupBy("terms").agg(F.min("query_id").alias("_ask"))
    words = build_prefix_dictionary(index) if dictionary is None else dictionary
    begun = growing(words).join(alike.select("_ask", F.explode("terms").alias("prefix")), "prefix").groupBy("_ask", "token", "df").agg(F.count(F.lit(1)).alias("times"))
    said = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "token", F.col("times").cast("string")))), ","), 256)
    sets = begun.groupBy("_ask").agg(said.alias("_said"))
    firsts = sets.groupBy("_said").agg(F.min("_ask").alias("_first"))
    hits = growing(index).join(begun.join(firsts.select(F.col("_first").alias("_ask")), "_ask"), "token").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hits.groupBy("_ask", "id").agg(F.round(F.sum(F.col("times") * idf * weight), EXACT).alias("score"))
    best = top_k(scored.withColumnRenamed("_ask", "_first"), ["_first"], [F.desc("score"), F.asc("id")], k)
    # Each query gets the rows of its like.
    members = growing(asked).join(alike, "terms").join(sets, "_ask").join(firsts, "_said").select("query_id", "_first")
    return growing(members).join(best, "_first").select("query_id", "id", "score", "rank")
