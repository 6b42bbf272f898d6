"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and the classes that they form.

The join is exact. It works in size bands and tiles:

1. Documents with equal sets fold into their smallest id.
2. A document's set is dealt into parts by hash, as many as its size band asks for: two sets that link differ in at
   most H shingles, so of H+m parts m at least are the same in both (empty parts counted only where a set leaves too
   few others). Documents meet if a part of theirs is the same, in their own band or the next. Meetings are counted with
   partial sums; then only documents of meetings of two or more are dealt out again. A document whose full parts
   outnumber H by m leaves the m - 1 most crowded of its meetings (a line that very many documents have), and all if it
   has fewer than m: whatever it links with shares m, so the first of these in order of size is left to both.
3. Where documents meet, each is held against the smallest of them. Tiles (a leader and some of its members) bound the
   overlap from above by bit counts of hashed bitmaps; pairs that the bound lets pass have their sorted arrays
   intersected.
4. A meeting whose documents all fell into one class is done. In others, those outside the leader's class meet the
   smallest among them, ROUNDS times in all. Where several classes are left, the documents of different classes are
   held against each other in tiles of bounded size, first by the bitmaps alone (the largest class's documents only
   against the others). That happens twice: first a tile gives only as many pairs as would join its classes, which go the
   way of 3; then, in meetings where one of those didn't link, a tile gives the documents of pairs that the bitmaps let
   pass, whose sets meet in the same tile again, and of the links there those that join its classes. No step writes a row
   for each pair of a group.
5. Classes are the connected components of the links.

No pair inside a class is lost to a cap: pairs are left out only if both ends are known to be in one class. That
documents meet by agreeing parts, and not each other, comes before the tiles; it leaves out no pair that links.

Cases: null or empty texts, and those of blanks alone, have an empty set and link with nothing; fewer than k words are
one shingle; rows with a null id are left out; a repeated id stands for one document, whose text is the least of its
rows' (null before others); empty tables give empty results; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import FILTER_BITS, Scratch, components, filter_bit, hits_only, id_filter, in_filter, merged_components, one_row_each, table, text_slices
from tidemark.llm.shingles import mix, shingle_sets

#: A band's largest size is at most this many times its smallest.
BAND = 1.5
#: Members in a tile beside its leader, and documents on a side of a tile of a meeting.
TILE, SIDE = 500, 400
#: Bits of a signature. Where two fall together by chance, documents meet that needn't.
SIG_BITS = 40
#: Rounds in which the documents of a meeting that are in no leader's class meet a new leader.
ROUNDS = 3
#: A bitmap's bits for each shingle, before rounding up to a power of two; and its fewest.
BITS_EACH, FEWEST_BITS = 2, 256
#: Bytes of text of which sets are made at once.
SLICE = 1 << 18


def band_of(size: int) -> int:
    return int(math.log(size) / math.log(BAND) + 1e-9)


def band_top(band: int) -> int:
    """The largest size whose band_of is this one."""
    top = int(BAND ** (band + 1)) + 1
    while top > 1 and band_of(top) > band:
        top -= 1
    return top


def differ_most(band: int, percent: int) -> int:
    """How many shingles two linked sets of at most the band's sizes can differ in: |A xor B| = |A|+|B|-2|A and B|,
    and |A and B| >= t/(1+t) (|A|+|B|)."""
    return (100 - percent) * 2 * band_top(band) // (100 + percent)


def signatures(own: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's signatures, a hash of band, part and what the part holds; and for each how many of the same band any
    linked set has at least, times two, plus one for the next band."""
    size = len(own)
    bands = [band_of(size)]
    if band_of(max(size, size * 100 // percent)) > bands[0]:
        bands.append(bands[0] + 1)
    out, needs = [], []
    value = mix(own + np.uint64(0x14057B7EF767814F))
    for k, band in enumerate(bands):
        most = differ_most(band, percent)
        parts = most + 2 + most // 8
        part = ((own >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # rises with the sorted set
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        total = np.add.reduceat(value, first)
        label, sure = part[first], len(first) - most
        if sure < 1:  # too few full parts: the empty ones count too
            whole = np.zeros(parts, np.uint64)
            whole[label] = total
            label, total, sure = np.arange(parts), whole, 1
        out.append(mix(mix(label.astype(np.uint64) + np.uint64(band << 40)) + total))
        needs.append(np.full(len(label), 2 * sure + k, np.int32))
    return (np.concatenate(out) >> np.uint64(64 - SIG_BITS)).view(np.int64), np.concatenate(needs)


def bitmap(own: np.ndarray) -> np.ndarray:
    bits = max(FEWEST_BITS, 1 << (BITS_EACH * len(own)).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[(own >> np.uint64(7)).astype(np.int64) & bits - 1] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def alike(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of one width: that of the narrowest, onto which wider ones fold."""
    width = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, width), axis=0) for m in maps])


def overlap_bound(sizes: np.ndarray, maps: np.ndarray, size: int, own: np.ndarray) -> np.ndarray:
    """From above, how many shingles each set shares with one: a bit set on one side alone is a shingle not shared."""
    alone, other = np.bitwise_count(maps & ~own).sum(1, dtype=np.int64), np.bitwise_count(own & ~maps).sum(1, dtype=np.int64)
    return np.minimum(sizes - alone, size - other)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int(np.count_nonzero(b[at] == a))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def map_sets(docs: DataFrame, emit, schema: str, k: int, bits: bytes | None = None, inside: bool = True) -> DataFrame:
    """emit(rows, sets) gives the columns of `schema` for each run of rows; with `bits`, only of documents in that
    filter, or (inside=False) only of those outside."""
    marked = docs if bits is None else docs.withColumn("bit", filter_bit("doc_id"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches if bits is None else hits_only(batches, bits, "bit", inside), "text", SLICE):
            yield emit(rows, shingle_sets(data, offsets, k))

    return marked.mapInArrow(work, schema)


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def chosen(rows: pa.RecordBatch, sets: list[np.ndarray], make) -> pa.RecordBatch:
    """(doc, size, held) of rows whose set isn't empty."""
    hit = [i for i, x in enumerate(sets) if len(x)]
    return pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(hit, pa.int64())), pa.array([len(sets[i]) for i in hit], pa.int64()), pa.array([make(sets[i]).tobytes() for i in hit], pa.binary())], names=["doc", "size", "held"])


def jaccard_classes(docs: DataFrame, k: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    with Scratch(docs.sparkSession, "jaccard") as s:
        docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).filter("doc_id is not null")
        docs = one_row_each(s, docs, "doc_id", "text")

        def emit_keys(rows, sets):
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([digest(x) if len(x) else None for x in sets], pa.binary())], names=["doc_id", "n_shingles", "set_key"])

        keys = s.write(map_sets(docs, emit_keys, "doc_id long, n_shingles long, set_key binary", k), "keys")
        shared = s.write(keys.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("set_key", "first"), "shared")
        copies = s.write(keys.join(shared, "set_key").filter("doc_id <> first").select(F.col("doc_id").alias("doc")), "copies")
        met = meetings(s, docs, copies, k, percent)
        s.drop(copies)
        classes = linked_classes(s, docs, met, k, percent)
        named = keys.join(shared, "set_key", "left").withColumn("node", F.coalesce("first", "doc_id")).join(classes, "node", "left")
        return s.finish(named.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id")))


def meetings(s: Scratch, docs: DataFrame, copies: DataFrame, k: int, percent: int) -> DataFrame:
    """(sig, doc, leader): the documents, without copies, of every meeting of two or more, and the smallest of them."""
    doubtful = id_filter(copies, "doc")

    def dealt(wanted: bytes | None) -> DataFrame:
        def emit(rows, sets):
            found = [signatures(x, percent) for x in sets if len(x)]
            doc = np.repeat(rows.column("doc_id").to_numpy()[[len(x) > 0 for x in sets]], [len(x) for x, _ in found])
            sig, need = (np.concatenate([x[n] for x in found] or [np.zeros(0, t)]) for n, t in enumerate((np.int64, np.int32)))
            if wanted is not None:
                hit = in_filter(wanted, sig & (FILTER_BITS - 1))
                sig, doc, need = sig[hit], doc[hit], need[hit]
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(doc), pa.array(need)], names=["sig", "doc", "need"])

        sure, doubt = (map_sets(docs, emit, "sig long, doc long, need int", k, doubtful, inside) for inside in (False, True))
        return sure.union(doubt.join(copies, "doc", "left_anti").select("sig", "doc", "need"))

    groups = s.write(dealt(None).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
    there = dealt(id_filter(groups, "sig", F.expr(f"sig & {FILTER_BITS - 1}"))).join(groups, "sig")
    met = s.write(rarest(there), "rarest")
    heads = s.write(met.groupBy("sig").agg(F.min("doc").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sig", "leader"), "heads")
    out = s.write(met.join(heads, "sig").select("sig", "doc", "leader"), "met")
    s.drop(groups, met, heads)
    return out


def rarest(there: DataFrame) -> DataFrame:
    """(sig, doc): of a document's meetings (sig, doc, need, n) in a band all but the most crowded, of which so many are left
    out that whatever it links with still shares one of the others, by the same order of meetings on both sides."""
    of = W.partitionBy("doc", "need")
    placed = there.withColumns({"place": F.row_number().over(of.orderBy("n", "sig")), "parts": F.count(F.lit(1)).over(of)})
    return placed.filter("place <= parts - shiftright(need, 1) + 1").select("sig", "doc")


def linked_classes(s: Scratch, docs: DataFrame, met: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of the documents that link with another one."""
    maps = s.write(map_sets(docs, lambda rows, sets: chosen(rows, sets, bitmap), "doc long, size long, held binary", k, id_filter(met.select("doc").distinct(), "doc")), "maps")
    classes, pairs = None, met.filter("doc <> leader")
    for _ in range(ROUNDS):
        pairs = s.write(pairs.select("doc", "leader").distinct(), "pairs")
        classes = with_links(s, classes, s.write(in_tiles(s, pairs, maps, percent, False), "near"), docs, k, percent)
        s.drop(pairs)
        met = open_meetings(s, met, classes)
        if not met.limit(1).count():
            return classes
        pairs = met.filter("doc <> leader and class <> leader_class")
    some = s.write(rest_pairs(met, maps, percent, True), "rest")
    classes = with_links(s, classes, s.write(some.select("doc", "leader").distinct(), "near"), docs, k, percent)
    # Where a pair didn't link, a tile may have left out others that do.
    of = lambda c: classes.select(F.col("node").alias(c), F.col("component").alias(f"{c}_class"))
    apart = some.join(of("doc"), "doc", "left").join(of("leader"), "leader", "left").filter("not coalesce(doc_class, doc) = coalesce(leader_class, leader)")
    met = open_meetings(s, met.join(apart.select("sig").distinct(), "sig", "left_semi"), classes, False)
    return with_tile_links(s, classes, s.write(rest_pairs(met, maps, percent, False), "rest"), ("class",), docs, k, percent)


def with_links(s: Scratch, classes: DataFrame | None, near: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The classes after those of the near pairs that link are joined too. The sets are made again for the documents in
    pairs only."""
    if classes is not None and not near.limit(1).count():
        return classes
    sets = whole_sets(s, near.select("doc").union(near.select("leader")), docs, k)
    links = s.write(in_tiles(s, near, sets, percent, True).toDF("a", "b"), "links")
    s.drop(sets, near)
    out = components(links, s) if classes is None else merged_components(classes, links, s) if links.limit(1).count() else classes
    s.drop(links)
    return out


def whole_sets(s: Scratch, ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(doc, size, held): the sets of documents named in `doc`, made again from the texts."""
    return s.write(map_sets(docs, lambda rows, own: chosen(rows, own, np.asarray), "doc long, size long, held binary", k, id_filter(ids.distinct(), "doc")), "sets")


def with_tile_links(s: Scratch, classes: DataFrame, near: DataFrame, apart: tuple[str, ...], docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The classes after the links in tiles (sig, x, y, side, doc and the columns of `apart`, class first) are joined too."""
    if not near.limit(1).count():
        return classes
    # Tiles of the same documents count once, before sets are dealt to them.
    who = near.groupBy("sig", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(doc))").alias("who"))
    once = who.groupBy("who", "n").agg(F.min(F.struct("sig", "x", "y")).alias("t")).select("t.*")
    near = s.write(near.join(once, ["sig", "x", "y"], "left_semi"), "near")
    sets = whole_sets(s, near.select("doc"), docs, k)
    tiles = near.join(sets, "doc").groupBy("sig", "x", "y")
    links = s.write(tiles.applyInArrow(lambda rows: joining_links(rows, apart, percent), "a long, b long"), "links")
    s.drop(sets, near)
    out = merged_components(classes, links.distinct(), s) if links.limit(1).count() else classes
    s.drop(links)
    return out


def joining_links(rows: pa.Table, apart: tuple[str, ...], percent: int) -> pa.Table:
    """(a, b): of the links between a tile's sets, those that join classes not joined by earlier ones. Pairs are of different
    values in each column of `apart`."""
    rows = rows.sort_by([("size", "ascending"), ("doc", "ascending")])
    doc, sizes, kind, *others = (rows.column(c).to_numpy() for c in ("doc", "size", *apart))
    own = [np.frombuffer(x, np.uint64) for x in rows.column("held").to_pylist()]
    maps, found = [bitmap(x) for x in own], []
    for i in range(len(doc)):
        part = slice(i + 1, np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        new = kind[part] != kind[i]
        for other in others:
            new &= other[part] != other[i]
        j = i + 1 + np.flatnonzero(new)
        if len(j):
            j = j[bounded(sizes[j], [maps[n] for n in j.tolist()], int(sizes[i]), maps[i], percent)]
        for n in j.tolist():
            if kind[n] != kind[i] and linked(own[n], own[i], percent):
                kind = np.where(kind == kind[n], kind[i], kind)
                found.append((min(doc[n], doc[i]), max(doc[n], doc[i])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def of_tile(rows: pa.Table, hit: np.ndarray, columns: tuple[str, ...]) -> pa.Table:
    """The rows of a tile at these places, each once."""
    return rows.take(pa.array(np.unique(hit), pa.int64())).select(["sig", "x", "y", "side", "doc", *columns])


def open_meetings(s: Scratch, met: DataFrame, classes: DataFrame, led: bool = True) -> DataFrame:
    """(sig, doc, class, leader, leader_class): meetings whose documents (if led, but for the leader, who has been held
    against all) are of different classes; their new leader is the smallest document outside the old one's class.
    Meetings of the same documents count once."""
    others = (F.col("doc") != F.col("leader")) | F.lit(not led)
    there = s.write(met.select("sig", "doc", "leader").join(classes.withColumnRenamed("node", "doc"), "doc", "left").select("sig", "doc", "leader", F.coalesce("component", "doc").alias("class")), "there")
    s.drop(met)
    old, rest = F.when(F.col("doc") == F.col("leader"), F.col("class")), F.when(others, F.col("class"))
    groups = there.groupBy("sig").agg(F.max(old).alias("old"), F.min(rest).alias("low"), F.max(rest).alias("high"), F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(doc))").alias("who")).filter("low < high")
    once = groups.groupBy("who", "n").agg(F.min(F.struct("sig", "old")).alias("g")).select("g.sig", "g.old")
    rows = s.write(there.filter(others).join(once, "sig").select("sig", "doc", "class", "old"), "rows")
    s.drop(there)
    new = rows.filter("class <> old").groupBy("sig").agg(F.min(F.struct("doc", "class")).alias("l")).select("sig", F.col("l.doc").alias("leader"), F.col("l.class").alias("leader_class"))
    out = s.write(rows.join(new, "sig").select("sig", "doc", "class", "leader", "leader_class"), "met")
    s.drop(rows)
    return out


def in_turn(s: Scratch, pairs: DataFrame, most: int) -> DataFrame:
    """(leader, tile, doc): a leader of many members has them in several tiles."""
    many = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / most).alias("tiles")).filter("tiles > 1")
    tile = F.coalesce(F.pmod(F.xxhash64("doc"), F.col("tiles")), F.lit(0).cast("long")).alias("tile")
    return s.write(pairs.join(many, "leader", "left").select("leader", tile, "doc"), "tiles")


def in_tiles(s: Scratch, pairs: DataFrame, held: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Pairs that pass, in tiles of a leader and some of its members."""
    dealt = in_turn(s, pairs, TILE)
    members = dealt.join(held, "doc")
    alone = held.select(F.col("doc").alias("lead"), F.col("size").alias("lead_size"), F.col("held").alias("lead_held"))
    leaders = dealt.select(F.col("leader").alias("lead"), F.col("tile").alias("lead_tile")).distinct().join(alone, "lead")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, leader = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            lead, size = np.frombuffer(left.column("lead_held")[0].as_py(), np.uint64), left.column("lead_size")[0].as_py()
            own = [np.frombuffer(x, np.uint64) for x in right.column("held").to_pylist()]
            hit = np.array([linked(x, lead, percent) for x in own]) if exact else bounded(right.column("size").to_numpy(), own, size, lead, percent)
            doc = right.column("doc").to_numpy()[hit]
            leader = np.full(len(doc), left.column("lead")[0].as_py())
        return pa.table({"doc": pa.array(doc, pa.int64()), "leader": pa.array(leader, pa.int64())})

    return leaders.groupBy("lead", "lead_tile").cogroup(members.groupBy("leader", "tile")).applyInArrow(check, "doc long, leader long")


def bounded(sizes: np.ndarray, maps: list[np.ndarray], size: int, own: np.ndarray, percent: int) -> np.ndarray:
    """Which sets may link with one, by their bitmaps."""
    same = alike([own, *maps])
    bound = overlap_bound(sizes, same[1:], size, same[0])
    return 100 * bound >= percent * (sizes + size - bound)


def rest_pairs(met: DataFrame, maps: DataFrame, percent: int, few: bool) -> DataFrame:
    """Documents that met, of different classes so far, whose bitmaps let them link: with `few` pairs (sig, doc, leader), where
    classes that one pair of a tile would join count as one in the rest of the tile; else the rows of the tiles that are in
    a pair (sig, x, y, side, doc, class). A meeting's largest class is held against the others only, not against itself."""
    counts = met.groupBy("sig", "class").agg(F.count(F.lit(1)).alias("n"))
    sides = counts.groupBy("sig").agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("all")).select("sig", F.col("top.class").alias("top"), F.ceil((F.col("all") - F.col("top.n")) / SIDE).alias("others"), F.ceil(F.col("top.n") / SIDE).alias("tops"))
    zero, is_top = F.lit(0).cast("long"), F.col("class") == F.col("top")
    dealt = met.join(sides, "sig").withColumn("side", F.when(is_top, F.col("others") + F.pmod(F.xxhash64("doc"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("doc"), F.col("others"))))
    spread = dealt.withColumn("other", F.explode(F.sequence(zero, F.when(is_top, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1)))
    tiles = spread.select("sig", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "doc", "class").join(maps, "doc")

    def check(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("size")
        doc, sizes, kind, side = (rows.column(c).to_numpy() for c in ("doc", "size", "class", "side"))
        within = rows.column("x")[0].as_py() == rows.column("y")[0].as_py()
        held = alike([np.frombuffer(x, np.uint64) for x in rows.column("held").to_pylist()])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(doc)):
            part = slice(i + 1, np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
            new = (kind[part] != kind[i]) & (within | (side[part] != side[i]))
            j = i + 1 + np.flatnonzero(new)
            bound = overlap_bound(sizes[j], held[j], sizes[i], held[i])
            j = j[100 * bound >= percent * (sizes[j] + sizes[i] - bound)]
            if few and len(j):
                j = j[np.unique(kind[j], return_index=True)[1]]  # one of each class
                kind = np.where(np.isin(kind, kind[j]), kind[i], kind)
            a.append(j)
            b.append(np.full(len(j), i))
        if not few:
            return of_tile(rows, np.concatenate(a + b), ("class",))
        left, right = doc[np.concatenate(a)], doc[np.concatenate(b)]
        sig = np.full(len(left), rows.column("sig")[0].as_py())
        return pa.table({"sig": pa.array(sig, pa.int64()), "doc": pa.array(np.maximum(left, right)), "leader": pa.array(np.minimum(left, right))})

    return tiles.groupBy("sig", "x", "y").applyInArrow(check, "sig long, doc long, leader long" if few else "sig long, x long, y long, side long, doc long, class long")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w
), f AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS top FROM documents UNION SELECT ways.b, reach.top FROM reach JOIN ways ON ways.a = reach.node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(reach.top) AS component_id FROM s JOIN reach ON reach.node = s.doc_id GROUP BY ALL
"""
