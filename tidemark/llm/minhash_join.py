"""MinHash near-duplicates by an inverted join of signature coordinates, with every link confirmed on the full sets.

1. A document's set of word shingles has a signature of K min-hashes; WIDTH neighbouring coordinates with their values
   are an item (single ones below WIDE percent). Documents with equal sets fold into their smallest id.
2. Documents are posted under their items. How long each posting list is gets counted with partial sums; items of one
   document alone can't collide and go. A document with fewer than M items left has no partner.
3. Prefix: a document orders its L items left by falling rarity and is posted under the first L - M + 1 only. Two
   documents with M common items or more share one of both prefixes, so the longest lists are never joined: a document
   of which fewer than M items are frequent isn't in a frequent list at all.
4. Merging, in lists of two documents or more: each document is first held against the smallest of its list, in tiles
   of a leader and some members; documents of a list that are not of the leader's class then meet a new leader, ROUNDS
   times; what is still apart is held against each other in tiles of bounded size. A group of copies shares many lists,
   so that happens first in one list of each document, its home (the longest), and then in the others between documents
   of different homes. A tile counts collisions coordinate by coordinate, rarest first: after K - T + 1 of them, pairs
   without a collision are skipped, and later those that can't reach T any more. Pairs of T collisions or more, whose
   overlap the bit counts of hashed bitmaps of their sets don't bound below what is asked, are candidates.
5. Candidates are confirmed on their whole sets, made again from the texts: 100 * shared >= percent * union. Where all
   pairs of a tile are asked for, the sets of its candidates meet in the tile, which gives the links that join its classes.
6. Classes are the connected components of the links. A pair is left out only if both ends are in one class by then, so
   a group of copies costs about one row for a copy, not all its pairs.

A pair of similarity s is missed if fewer than T of K coordinates collide, or fewer than M items are common, binomial
tails: at 0.8, with T = K/2 = 24, 8 in 10 million, and 2 in 100 million with M = 3 of 24. All else is exact. Meetings of crowds of short documents that share over half of their items stay
quadratic in counts inside tiles, not in rows.

Cases: null or empty texts, and those of blanks alone, have an empty set and link with nothing; fewer than k words are
one shingle; rows with a null id are left out; a repeated id stands for one document, whose text is the least of its
rows' (null before others); empty tables give empty results; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import FILTER_BITS, Scratch, filter_bit, hits_only, id_filter, in_filter, one_row_each, table, without_ids
from tidemark.llm.jaccard_join import alike, digest, in_turn, map_sets, of_tile, open_meetings, overlap_bound, with_links, with_tile_links
from tidemark.llm.shingles import mix

#: Coordinates of a signature, and how many of them have to collide for every percent of similarity asked for.
K, SHARE = 48, 0.625
#: Coordinates of an item where WIDE percent or more are asked for, and which share of the items expected in common has to be.
WIDTH, WIDE, COMMON = 2, 70, 0.2
#: Members in a tile beside its leader, and documents on a side of a tile of a meeting.
TILE, SIDE = 2000, 400
#: Rounds in which the documents of a list that are in no leader's class meet a new leader.
ROUNDS = 3
#: A bitmap's bits for each shingle, before rounding up to a power of two; and its fewest and most.
BITS_EACH, FEWEST_BITS, MOST_BITS = 2, 256, 1 << 16
#: Shingles whose hashes are made at once.
AT_ONCE = 1 << 15

_RANDOM = np.random.default_rng(20240917)
TIMES = _RANDOM.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _RANDOM.integers(0, 2**63, K, dtype=np.uint64)


def threshold(percent: int) -> int:
    return max(1, int(K * SHARE * percent / 100))


def items_asked(percent: int) -> tuple[int, int]:
    """Coordinates of an item, and how many items have to be common."""
    if percent < WIDE:
        return 1, threshold(percent)
    return WIDTH, max(1, int(K // WIDTH * (percent / 100) ** WIDTH * COMMON))


def signature(own: np.ndarray) -> np.ndarray:
    """The items of a set that isn't empty: for each coordinate the least hash, mixed with the coordinate."""
    least = np.full(K, ~np.uint64(0))
    for at in range(0, len(own), AT_ONCE):
        part = own[at : at + AT_ONCE]
        least = np.minimum(least, np.array([(part * a + b).min() for a, b in zip(TIMES, PLUS, strict=True)]))
    return mix(least ^ mix(PLUS)).view(np.int64)


def bitmap(own: np.ndarray) -> bytes:
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (BITS_EACH * len(own)).bit_length()))
    flags = np.zeros(bits, np.uint8)
    flags[(own >> np.uint64(7)).astype(np.int64) & bits - 1] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, items, bits); the last three are null for an empty set."""

    def emit(rows: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id"),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([digest(x) if len(x) else None for x in sets], pa.binary()),
                pa.array([signature(x) if len(x) else None for x in sets], pa.list_(pa.int64())),
                pa.array([bitmap(x) if len(x) else None for x in sets], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "set_key", "items", "bits"],
        )

    return map_sets(docs, emit, "doc_id long, n_shingles long, set_key binary, items array<long>, bits binary", k)


def joint(items: np.ndarray, width: int) -> np.ndarray:
    """One item for every `width` coordinates in a row."""
    parts = items.view(np.uint64).reshape(len(items), -1, width)
    out = parts[:, :, 0]
    for n in range(1, width):
        out = mix(out) + parts[:, :, n]
    return out.view(np.int64)


def posted(s: Scratch, signs: DataFrame, percent: int) -> DataFrame:
    """(sig, doc, leader): the documents of every prefix list of two or more, and the smallest of them."""
    width, least = items_asked(percent)

    def dealt(wanted: bytes | None) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                sig = joint(rows.column("items").flatten().to_numpy().reshape(rows.num_rows, K), width)
                hit = np.ones(sig.shape, bool)
                if wanted is not None:
                    hit = in_filter(wanted, sig & (FILTER_BITS - 1))
                    hit &= (hit.sum(1) >= least)[:, None]
                doc = np.repeat(rows.column("doc_id").to_numpy(), hit.sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(sig[hit]), pa.array(doc)], names=["sig", "doc"])

        return signs.select("doc_id", "items").mapInArrow(work, "sig long, doc long")

    lists = s.write(dealt(None).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lists")
    items, of = dealt(id_filter(lists, "sig", F.expr(f"sig & {FILTER_BITS - 1}"))), W.partitionBy("doc")
    left = items.join(lists, "sig").withColumns({"place": F.row_number().over(of.orderBy("n", "sig")), "left": F.count(F.lit(1)).over(of)})
    prefix = s.write(left.filter(F.col("place") <= F.col("left") - least + 1).select("sig", "doc"), "prefix")
    heads = s.write(prefix.groupBy("sig").agg(F.min("doc").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sig", "leader"), "heads")
    met = s.write(prefix.join(heads, "sig").select("sig", "doc", "leader"), "met")
    s.drop(lists, prefix, heads)
    return met


# Counting collisions in a tile


def may_link(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def rarest_first(items: np.ndarray) -> np.ndarray:
    """Coordinates by how few pairs of the rows collide in them."""
    ordered = np.sort(items, axis=0)
    return np.argsort([float((np.unique(ordered[:, c], return_counts=True)[1].astype(np.float64) ** 2).sum()) for c in range(items.shape[1])], kind="stable")


def collisions(items: np.ndarray, i: np.ndarray, j: np.ndarray, least: int, order: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows collide in `least` coordinates or more."""
    keep, count = np.arange(len(i)), np.zeros(len(i), np.int16)
    prefix = len(order) - least + 1
    for done, c in enumerate(order, 1):
        column = items[:, c]
        count += column[i[keep]] == column[j[keep]]
        if done == prefix or done > prefix and done % 4 == 0 or done == len(order):
            alive = count + (len(order) - done) >= least
            keep, count = keep[alive], count[alive]
    return keep


def within_bound(sizes: np.ndarray, bits: list[bytes], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (those of one i in a row) may be similar enough, by their bitmaps."""
    maps, keep = [np.frombuffer(b, np.uint64) for b in bits], np.zeros(len(i), bool)
    starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, int)
    for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(i)], strict=False):
        own, others = int(i[at]), j[at:end]
        same = alike([maps[own], *(maps[n] for n in others.tolist())])
        bound = overlap_bound(sizes[others], same[1:], int(sizes[own]), same[0])
        keep[at:end] = 100 * bound >= percent * (sizes[others] + sizes[own] - bound)
    return keep


def tile_pairs(items: np.ndarray, sizes: np.ndarray, kind: np.ndarray, home: np.ndarray, side: np.ndarray, within: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile's rows (in order of size) that are of different classes and homes, of different sides unless the
    tile is one side against itself, near enough in size, and collide in the first coordinates or later ones often enough."""
    least = threshold(percent)
    order = rarest_first(items)
    first = items[:, order[: K - least + 1]]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(items)):
        part = slice(i + 1, np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        hit = (first[part] == first[i]).any(1) & (kind[part] != kind[i]) & (home[part] != home[i]) & (within | (side[part] != side[i]))
        j = i + 1 + np.flatnonzero(hit)
        a.append(np.full(len(j), i))
        b.append(j)
    i, j = np.concatenate(a), np.concatenate(b)
    kept = collisions(items, i, j, least, order)
    return i[kept], j[kept]


def one_of_each(i: np.ndarray, j: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Of pairs of classes, those that would join classes not joined by earlier pairs."""
    top = {int(c): int(c) for c in np.unique(kind)}

    def root(c: int) -> int:
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    kept = []
    for n, (x, y) in enumerate(zip(kind[i].tolist(), kind[j].tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            top[max(x, y)] = min(x, y)
            kept.append(n)
    return np.array(kept, np.int64)


def with_ids(signs: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """The rows of documents that may be among ids, without a shuffle."""
    bits = id_filter(ids, id_column)
    marked = signs.withColumn("bit", filter_bit("doc_id"))
    return marked.mapInArrow(lambda batches: hits_only(batches, bits), marked.schema).drop("bit")


def matrix(rows: pa.Table, column: str = "items") -> np.ndarray:
    return rows.column(column).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, K)


def with_leaders(s: Scratch, pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """(doc, leader): pairs that collide often enough, in tiles of a leader and some of its members."""
    dealt = in_turn(s, pairs, TILE)
    own = signs.select(F.col("doc_id").alias("doc"), "n_shingles", "items", "bits")
    leaders = dealt.select(F.col("leader").alias("lead"), F.col("tile").alias("lead_tile")).distinct().join(signs.select(F.col("doc_id").alias("lead"), F.col("n_shingles").alias("lead_n_shingles"), F.col("items").alias("lead_items"), F.col("bits").alias("lead_bits")), "lead")
    least = threshold(percent)

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, leader = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            items = np.concatenate([matrix(left, "lead_items"), matrix(right)])
            sizes = np.concatenate([left.column("lead_n_shingles").to_numpy(), right.column("n_shingles").to_numpy()])
            near = np.flatnonzero(may_link(sizes[1:], sizes[0], percent)) + 1
            hits = (items[near] == items[0]).sum(0)
            near = near[collisions(items, near, np.zeros(len(near), np.int64), least, np.argsort(hits, kind="stable"))]
            bits = left.column("lead_bits").to_pylist() + right.column("bits").to_pylist()
            near = near[within_bound(sizes, bits, np.zeros(len(near), np.int64), near, percent)]
            doc = right.column("doc").to_numpy()[near - 1]
            leader = np.full(len(doc), left.column("lead")[0].as_py())
        return pa.table({"doc": pa.array(doc, pa.int64()), "leader": pa.array(leader, pa.int64())})

    return leaders.groupBy("lead", "lead_tile").cogroup(dealt.join(own, "doc").groupBy("leader", "tile")).applyInArrow(check, "doc long, leader long")


def with_each_other(met: DataFrame, signs: DataFrame, percent: int, by: str, few: bool) -> DataFrame:
    """Documents of a list, of different classes so far and of different homes, that may link: with `few` pairs (sig, doc,
    leader), only as many of a tile as would join its classes; else the rows of the tiles that are in a pair (sig, x, y,
    side, doc, class, home). A list's largest group of one `by` (class or home) is held against the others only."""
    counts = met.groupBy("sig", by).agg(F.count(F.lit(1)).alias("n"))
    sides = counts.groupBy("sig").agg(F.max(F.struct("n", by)).alias("top"), F.sum("n").alias("all"))
    sides = sides.select("sig", F.col(f"top.{by}").alias("top"), F.ceil((F.col("all") - F.col("top.n")) / SIDE).alias("others"), F.ceil(F.col("top.n") / SIDE).alias("tops"))
    zero, is_top, turn = F.lit(0).cast("long"), F.col(by) == F.col("top"), lambda n: F.pmod(F.xxhash64("doc"), F.col(n))
    dealt = met.join(sides, "sig").withColumn("side", F.when(is_top, F.col("others") + turn("tops")).otherwise(turn("others")))
    opposite = F.sequence(zero, F.when(is_top, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1)
    spread = dealt.withColumn("other", F.explode(opposite)).select("sig", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "doc", "class", "home")
    tiles = spread.join(signs.select(F.col("doc_id").alias("doc"), "n_shingles", "items", "bits"), "doc")

    def check(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_shingles", "ascending"), ("doc", "ascending")])
        doc, sizes, kind, home, side = (rows.column(c).to_numpy() for c in ("doc", "n_shingles", "class", "home", "side"))
        i, j = tile_pairs(matrix(rows), sizes, kind, home, side, rows.column("x")[0].as_py() == rows.column("y")[0].as_py(), percent)
        kept = within_bound(sizes, rows.column("bits").to_pylist(), i, j, percent)
        i, j = i[kept], j[kept]
        if not few:
            return of_tile(rows, np.concatenate([i, j]), ("class", "home"))
        kept = one_of_each(i, j, kind)
        i, j = i[kept], j[kept]
        sig = np.full(len(i), rows.column("sig")[0].as_py())
        return pa.table({"sig": pa.array(sig, pa.int64()), "doc": pa.array(np.maximum(doc[i], doc[j])), "leader": pa.array(np.minimum(doc[i], doc[j]))})

    return tiles.groupBy("sig", "x", "y").applyInArrow(check, "sig long, doc long, leader long" if few else "sig long, x long, y long, side long, doc long, class long, home long")


def confirmed_classes(s: Scratch, docs: DataFrame, signs: DataFrame, met: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of the documents that link with another one."""
    classes, pairs = None, met.filter("doc <> leader")
    for _ in range(ROUNDS):
        near = s.write(with_leaders(s, s.write(pairs.select("doc", "leader").distinct(), "pairs"), signs, percent), "near")
        classes = with_links(s, classes, near, docs, k, percent)
        met = open_meetings(s, met, classes)
        if not met.limit(1).count():
            return classes
        pairs = met.filter("doc <> leader and class <> leader_class")
    sizes = met.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    homes = s.write(met.select("sig", "doc").join(sizes, "sig").groupBy("doc").agg(F.max(F.struct("n", "sig")).alias("top")).select("doc", F.col("top.sig").alias("home")), "homes")
    lists = s.write(met.select("sig", "doc").join(homes, "doc"), "open")
    s.drop(met, homes)
    classes = settled(s, classes, lists.filter("sig = home").select("sig", "doc", F.col("doc").alias("home")), "class", docs, signs, k, percent)
    return settled(s, classes, lists, "home", docs, signs, k, percent)


def with_classes(s: Scratch, lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Lists (sig, doc, home) with each document's class so far; only those of several classes and homes, and of several
    lists of the same documents one."""
    rows = s.write(lists.join(classes.withColumnRenamed("node", "doc"), "doc", "left").select("sig", "doc", "home", F.coalesce("component", "doc").alias("class")), "classed")
    several = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(doc))").alias("who"), F.min("class").alias("c"), F.max("class").alias("d"), F.min("home").alias("h"), F.max("home").alias("i"))
    once = several.filter("c < d and h < i").groupBy("who", "n").agg(F.min("sig").alias("sig")).select("sig")
    return s.write(rows.join(once, "sig", "left_semi"), "apart")


def settled(s: Scratch, classes: DataFrame, lists: DataFrame, by: str, docs: DataFrame, signs: DataFrame, k: int, percent: int) -> DataFrame:
    """The classes after all documents of a list (sig, doc, home), of different homes, have met."""
    some = s.write(with_each_other(with_classes(s, lists, classes), signs, percent, by, True), "some")
    classes = with_links(s, classes, s.write(some.select("doc", "leader").distinct(), "near"), docs, k, percent)
    # Where a pair didn't link, its tile may have left out others that do.
    of = lambda c: classes.select(F.col("node").alias(c), F.col("component").alias(f"{c}_class"))
    apart = some.join(of("doc"), "doc", "left").join(of("leader"), "leader", "left").filter("not coalesce(doc_class, doc) = coalesce(leader_class, leader)")
    lists = lists.join(s.write(apart.select("sig").distinct(), "unsettled"), "sig", "left_semi")
    rest = with_each_other(with_classes(s, lists, classes), signs, percent, by, False)
    return with_tile_links(s, classes, s.write(rest, "near"), ("class", "home"), docs, k, percent)


def minhash_classes(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; kept is the class's smallest id."""
    with Scratch(docs.sparkSession, "minhash") as s:
        docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).filter("doc_id is not null")
        docs = one_row_each(s, docs, "doc_id", "text")
        signs = s.write(signed(docs, k), "signs")
        keys = s.write(signs.select("doc_id", "n_shingles", "set_key"), "keys")
        shared = s.write(keys.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("set_key", "first"), "shared")
        named = keys.join(shared, "set_key", "left").withColumn("node", F.coalesce("first", "doc_id"))
        copies = named.filter("node <> doc_id").select("doc_id")
        single = s.write(without_ids(signs.filter("items is not null").select("doc_id", "n_shingles", "items", "bits"), copies, "doc_id"), "single")
        s.drop(signs)
        met = posted(s, single, percent)
        own = s.write(with_ids(single, met.select("doc").distinct(), "doc"), "own")
        s.drop(single)
        classes = confirmed_classes(s, docs, own, met, k, percent)
        found = named.join(classes, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
        return s.finish(found.withColumn("kept", F.col("doc_id") == F.col("component_id")))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_classes(table(spark, sf_dir, "documents"), k=2, percent=80)


OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) WHEN len(w) > 0 THEN [w[1]] ELSE [] END AS sh FROM w
), f AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (na + nb - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS top FROM documents UNION SELECT ways.b, reach.top FROM reach JOIN ways ON ways.a = reach.node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(reach.top) AS component_id, s.doc_id = min(reach.top) AS kept FROM s JOIN reach ON reach.node = s.doc_id GROUP BY s.doc_id, s.sh
"""
