"""Substring dedup: passages of at least 50 words that come again, nearly alike, in another document.

Tokens are shingles of five words (A-Z lowered). For each of a few hash functions the Cartesian tree over a document's
token hashes gives its compact windows (l, c, r): every run of tokens from l..c to c..r has its least hash at c. Windows
too short for a passage are left out, so about 2/46 of the tokens head one. Then:

1. Documents of equal word sequences fold into the smallest id; the others are whole repeats of it.
2. Windows with the same least token meet; each is joined to the window of the group's smallest document.
3. For a document and such a source, the windows' common intervals are joined along (nearly) one diagonal: stretches that
   enough hash functions cover are candidates.
4. A candidate is verified on the tokens themselves: within it, runs of which at least 3 in 4 tokens in each passage
   length come again are cut out (where they are too unlike, those of 8 in 9), and kept if the token sets' Jaccard
   similarity is 0.8 or more.
5. The smallest document may hold a token in another context than later documents share. Windows that lie in no verified
   passage meet again by wider contexts: the words from the least token on, and those up to it, CONTEXTS tokens wide; and
   the least token together with the one APART tokens after or before it, which a fragment shorter than a passage
   can't hold. Each is joined to the smallest document (and place) of every such key, and verified as in 4.
6. Where a window of the first function still lies in no verified passage, every run of 50 words around its least token
   is hashed, in all documents with such a window and the same 28 words before or after that token, and joined to the
   smallest document with the same run. A run of 50 words has its least token in exactly one window, so this finds all
   that stand exactly as in an earlier document.

Since a source has the smaller id, the first copy of a passage is never itself the repeat of a later one. Keys are
counted with partial sums before rows meet by them, so a very common line is no single task's work.

Exact repeats of 50 words are all found. Near repeats (similarity from 0.8) are found by chance: a function agrees with
probability 0.8 at 0.8, two of three are asked for in 3, one with an unedited context in 5; tests state the recall.

Cases: null, empty and short texts have no passages; repeats inside one document don't count; rows with a null id
are left out; rows of one id fold into that with the least text; other columns aren't looked at; texts are processed
whole; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import FILTER_BITS, Scratch, filter_bit, hits_only, id_filter, in_filter, one_row_each, table, text_slices, unused
from tidemark.llm.shingles import mix, shingles_of, words_of

#: Words of a token, of a passage; hash functions, how many must agree; how far diagonals may lie apart.
K, WORDS, FUNCTIONS, ENOUGH, DRIFT = 5, 50, 3, 2, 8
SPAN = WORDS - K + 1
#: Tokens from a run's least one to its farther end, at least.
HALF = SPAN // 2 + 1
#: Tokens of the contexts by which unverified windows meet again; they serve the exact runs too.
CONTEXTS = (HALF,)
#: They meet again by pairs of tokens so far apart too, which only a document that holds (nearly) a passage's length of
#: both can share: shorter fragments can't. Neighbours let a word put in or left out between them pass.
APART = (41, 42, 45, 46)
SIMILARITY = 0.8
#: Of the tokens of every passage length in a run, how many must come again.
LOOSE, DENSE = 3 / 4, 8 / 9
#: A window is kept to this many tokens on each side of its least (10 bits); longer passages have several windows, since
#: every run of SPAN tokens has one around its own least token.
REACH = 1023
#: Bytes of a token's hash that verification compares.
TOKEN_BYTES = 5


def nearest_smaller(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Cartesian tree by its bounds: for every place the nearest one before with a hash no larger, and the nearest
    one after with a smaller hash (-1 and len(h) if there is none). Pointers skip along pointers, all at once."""
    n = len(h)
    padded = np.concatenate([h, np.zeros(1, h.dtype)])  # places -1 and n: no hash is below it
    before, after = np.arange(-1, n, dtype=np.int64), np.arange(1, n + 2, dtype=np.int64)
    before[n], after[n] = -1, n
    active = np.arange(n)
    while len(active):
        at = before[active]
        active = active[(at >= 0) & (padded[at] > h[active])]
        before[active] = before[before[active]]
    active = np.arange(n)
    while len(active):
        at = after[active]
        active = active[(at < n) & (padded[at] >= h[active])]
        after[active] = after[after[active]]
    return before[:n], after[:n]


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' words, their offsets, the token that begins at each word, and whether it lies within one text."""
    words, _, _, at = words_of(data, offsets)
    tokens = np.zeros(len(words), np.uint64)
    flat = shingles_of(words, K)
    tokens[: len(flat)] = flat
    end = np.repeat(at[1:], np.diff(at))
    return words, at, tokens, np.arange(len(words)) + K <= end


def sliding(x: np.ndarray, of) -> np.ndarray:
    """The least (of=np.minimum) or greatest of every SPAN values in a row."""
    width = 1
    while 2 * width <= SPAN:
        x, width = of(x[:-width], x[width:]), 2 * width
    return of(x[: len(x) - SPAN + width], x[SPAN - width :]) if width < SPAN else x


def compact_windows(tokens: np.ndarray, inside: np.ndarray, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, least places, first and last places of the windows long enough, for one hash function. A place heads one
    only if it is the least of some SPAN tokens; the tree is built over these places alone, since the nearest smaller
    ones of such a place are such places too (or a text's end, where h is 0)."""
    n = len(tokens)
    h = mix(tokens ^ np.uint64(0x9E3779B97F4A7C15 * (f + 1) & (1 << 64) - 1)) | np.uint64(1)
    h[~inside] = 0
    edge = np.zeros(SPAN, np.uint64)
    top = sliding(sliding(np.concatenate([edge, h, edge]), np.minimum), np.maximum)[1 : n + 1] == h
    place = np.concatenate([[-1], np.flatnonzero(top), [n]])
    heights = np.concatenate([edge[:1], h[place[1:-1]], edge[:1]])
    before, after = nearest_smaller(heights)
    low, high = place[np.maximum(before, 0)][1:-1], place[np.minimum(after, len(place) - 1)][1:-1]
    keep = (heights[1:-1] > 0) & (high - low > SPAN)
    c = place[1:-1][keep]
    return mix(h[c] + np.uint64(f)).view(np.int64), c, low[keep] + 1, high[keep] - 1


def contexts(words: np.ndarray, at: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """For each of CONTEXTS, keys of the words from a token on and up to its end; 0 where a text's end cuts them off."""
    text = np.searchsorted(at, c, "right") - 1
    out = []
    for n in CONTEXTS:
        run = shingles_of(words, n + K - 1)
        far, back = c + n + K - 1 <= at[text + 1], c - n + 1 >= at[text]
        after, before = np.zeros(len(c), np.uint64), np.zeros(len(c), np.uint64)
        after[far], before[back] = run[c[far]], mix(run[c[back] - n + 1])
        out += [after.view(np.int64), before.view(np.int64)]
    return out


def partners(tokens: np.ndarray, at: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """For each distance of APART, keys of a token with the one so far after it and before it; 0 where a text ends first."""
    text = np.searchsorted(at, c, "right") - 1
    out = []
    for n in APART:
        far, back = c + n + K <= at[text + 1], c - n >= at[text]
        after, before = np.zeros(len(c), np.uint64), np.zeros(len(c), np.uint64)
        after[far] = mix(mix(tokens[c[far]]) + tokens[c[far] + n])
        before[back] = mix(mix(tokens[c[back] - n] ^ np.uint64(1)) + tokens[c[back]])
        out += [after.view(np.int64), before.view(np.int64)]
    return out


def short(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // TOKEN_BYTES, 8), np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, TOKEN_BYTES)
    return out.view(np.uint64)[:, 0]


def sequence_key(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, source_doc_id, source_start, source_end, similarity): words [start, end) of a
    document repeat those of a source with a smaller id."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).filter("doc_id is not null")
    with Scratch(docs.sparkSession, "substring") as s:
        docs = one_row_each(s, docs, "doc_id", "text")
        copies = s.write(whole_copies(s, docs), "copies")
        met = meetings(s, docs, copies)
        pairs = met.filter("doc <> source").selectExpr("doc", "source", "window", "source_window")
        passages = s.write(verified_spots(s, docs, spots_of(pairs, ENOUGH)), "passages")
        held = passages.selectExpr("doc_id as doc", "start_word", "end_word")
        open_ = s.write(unsettled(met, held), "open")
        near = s.write(by_context(s, met, open_), "near")
        more = s.write(verified_spots(s, docs, spots_of(near, 1, SPAN)), "more")
        s.drop(near)
        held = held.union(more.selectExpr("doc_id as doc", "start_word", "end_word"))
        exact = exact_runs(s, docs, met, unsettled(open_.filter("window & 3 = 0"), held), held, copies)
        return s.finish(passages.union(more).union(exact).union(copies))


PASSAGE = "doc_id long, start_word int, end_word int, source_doc_id long, source_start int, source_end int, similarity double"


def whole_copies(s: Scratch, docs: DataFrame) -> DataFrame:
    """Documents whose words are those of one with a smaller id."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text"):
            words, _, _, at = words_of(data, offsets)
            sizes = np.diff(at)
            key = [sequence_key(words[a:b]) if b - a >= WORDS else None for a, b in zip(at[:-1], at[1:], strict=True)]
            keep = pa.array(np.flatnonzero(sizes >= WORDS))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(keep), pa.array(sizes).take(keep), pa.array(key, pa.binary()).take(keep)], names=["doc_id", "n_words", "key"])

    keyed = s.write(docs.mapInArrow(keys, "doc_id long, n_words long, key binary"), "keys")
    first = s.write(keyed.groupBy("key").agg(F.min("doc_id").alias("source"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "source"), "firsts")
    whole = keyed.join(first, "key").filter("doc_id <> source").withColumn("n_words", F.col("n_words").cast("int"))
    return whole.selectExpr("doc_id", "0 as start_word", "n_words as end_word", "source as source_doc_id", "0 as source_start", "n_words as source_end", "1.0D as similarity")


def meetings(s: Scratch, docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(sig, doc, window, keys, source, source_window): windows whose least token another document has at the head of one
    too, with the group's smallest window. window packs the least token's place, the tokens before and after it, and
    the function; keys are its contexts and its pairs with tokens further off."""
    gone = copies.select(F.col("doc_id").alias("doc")).distinct()
    doubtful = id_filter(gone, "doc")
    marked = docs.withColumn("bit", filter_bit("doc_id"))

    def dealt(wanted: bytes | None) -> DataFrame:
        def run(inside: bool):
            def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for rows, data, offsets in text_slices(hits_only(batches, doubtful, "bit", inside), "text"):
                    words, at, tokens, within = tokens_of(data, offsets)
                    found = [compact_windows(tokens, within, f) for f in range(FUNCTIONS)]
                    sig, c, low, high = (np.concatenate([x[k] for x in found]) for k in range(4))
                    f = np.repeat(np.arange(FUNCTIONS), [len(x[0]) for x in found])
                    if wanted is not None:
                        hit = in_filter(wanted, sig & (FILTER_BITS - 1))
                        sig, c, low, high, f = sig[hit], c[hit], low[hit], high[hit], f[hit]
                    text = np.searchsorted(at, c, "right") - 1
                    window = (c - at[text]) << 22 | np.minimum(c - low, REACH) << 12 | np.minimum(high - c, REACH) << 2 | f
                    columns = [rows.column("doc_id").take(pa.array(text)), pa.array(sig), pa.array(window)]
                    if wanted is not None:
                        keys = np.stack([*contexts(words, at, c), *partners(tokens, at, c)], axis=1)
                        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1))))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "sig", "window", "keys"][: len(columns)])

            return windows

        schema = "doc long, sig long, window long" + ", keys array<long>" * (wanted is not None)
        sure, doubt = (marked.mapInArrow(run(inside), schema) for inside in (False, True))
        return sure.union(doubt.join(gone, "doc", "left_anti"))

    groups = s.write(dealt(None).groupBy("sig").agg(F.min(F.struct("doc", "window")).alias("s"), F.max("doc").alias("most")).filter("s.doc < most").select("sig", F.col("s.doc").alias("source"), F.col("s.window").alias("source_window")), "groups")
    met = s.write(dealt(id_filter(groups, "sig", F.expr(f"sig & {FILTER_BITS - 1}"))).join(groups, "sig"), "met")
    s.drop(groups)
    return met


def spots_of(pairs: DataFrame, enough: int, margin: int = 0) -> DataFrame:
    """Stretches of a document and a source, from pairs of their windows (doc, source, window, source_window)."""
    left, right = (f"least(shiftright(window, {n}) & {REACH}, shiftright(source_window, {n}) & {REACH})" for n in (12, 2))
    rows = pairs.filter(f"{left} + {right} + 1 >= {SPAN}").selectExpr("doc", "source", "cast(window & 3 as int) as f", "cast(shiftright(window, 22) - shiftright(source_window, 22) as int) as shift", f"cast(shiftright(window, 22) - {left} as int) as low", f"cast(shiftright(window, 22) + {right} as int) as high")
    return rows.groupBy("doc", "source").applyInArrow(lambda x: covered(x, enough, margin), "doc long, source long, low int, high int, source_low int, source_high int")


def verified_spots(s: Scratch, docs: DataFrame, spots: DataFrame) -> DataFrame:
    """The passages in these stretches, by their tokens, which are made again for the documents in stretches only."""
    spots = s.write(spots, "spots")
    bits = id_filter(spots.select("doc").union(spots.select("source")).distinct(), "doc")

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(hits_only(batches, bits), "text"):
            _, at, tokens, _ = tokens_of(data, offsets)
            own = [short(tokens[a : max(a, b - K + 1)]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(own, pa.binary())], names=["doc", "own"])

    tokens = s.write(docs.withColumn("bit", filter_bit("doc_id")).mapInArrow(sequences, "doc long, own binary"), "tokens")
    piece = lambda a, b: F.expr(f"substring(own, {TOKEN_BYTES} * {a} + 1, {TOKEN_BYTES} * ({b} - {a} + 1))")
    mine = spots.join(tokens, "doc").withColumn("mine", piece("low", "high")).drop("own")
    both = mine.join(tokens.withColumnRenamed("doc", "source"), "source").withColumn("theirs", piece("source_low", "source_high")).drop("own")
    out = s.write(both.mapInArrow(verified, PASSAGE).distinct(), "verified")
    s.drop(spots, tokens)
    return out


def unsettled(windows: DataFrame, held: DataFrame) -> DataFrame:
    """Windows of documents other than their source of which some passage length around the least token lies in no held
    passage."""
    first, last = (f"shiftright(window, 22) {sign} least(shiftright(window, {n}) & {REACH}, {SPAN - 1})" for sign, n in (("-", 12), ("+", 2)))
    return windows.filter("doc <> source").join(held, (windows.doc == held.doc) & F.expr(f"start_word <= {first} and end_word >= {last} + {K}"), "left_anti")


def by_context(s: Scratch, met: DataFrame, open_: DataFrame) -> DataFrame:
    """(doc, source, window, source_window): open windows with the smallest window of each of their contexts, where that
    isn't one that they met before."""
    sigs = s.write(open_.select("sig").distinct(), "open-sigs")  # written, so that Spark may split the join's hot keys
    there = met.join(sigs, "sig", "left_semi").select("doc", "window", F.explode("keys").alias("key")).filter("key <> 0")
    first = s.write(there.groupBy("key").agg(F.min(F.struct("doc", "window")).alias("s"), F.max("doc").alias("most")).filter("s.doc < most").select("key", "s"), "contexts")
    asked = open_.select("doc", "window", "source", "source_window", F.explode("keys").alias("key")).filter("key <> 0")
    hits = asked.join(first, "key").filter("s.doc < doc and (s.doc <> source or s.window <> source_window)")
    return hits.select("doc", F.col("s.doc").alias("source"), "window", F.col("s.window").alias("source_window")).distinct()


def exact_runs(s: Scratch, docs: DataFrame, met: DataFrame, open_: DataFrame, held: DataFrame, copies: DataFrame) -> DataFrame:
    """Passages that stand exactly in a smaller document, from the runs of WORDS words around the least tokens of
    open windows (of the first hash function), without runs that lie in held passages."""
    sigs = s.write(open_.select("sig").distinct(), "open-sigs")
    halves = met.filter("window & 3 = 0").join(sigs, "sig", "left_semi").select("doc", F.explode(F.slice("keys", 2 * len(CONTEXTS) - 1, 2)).alias("key")).filter("key <> 0")
    shared = s.write(halves.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("key"), "halves")
    low_bits = F.lit(FILTER_BITS)
    wanted, keys = id_filter(sigs, "sig", F.pmod("sig", low_bits)), id_filter(shared, "key", F.pmod("key", low_bits))
    bits = id_filter(halves.join(shared, "key", "left_semi").select("doc").distinct(), "doc")
    s.drop(sigs, shared)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(hits_only(batches, bits), "text"):
            words, at, tokens, inside = tokens_of(data, offsets)
            sig, c, low, high = compact_windows(tokens, inside, 0)
            hit = in_filter(wanted, sig & (FILTER_BITS - 1))
            c, low, high = c[hit], low[hit], high[hit]
            after, before = (in_filter(keys, x & (FILTER_BITS - 1)) & (x != 0) for x in contexts(words, at, c)[-2:])
            begin, end = np.maximum(low, c - SPAN + 1), np.minimum(c, high - SPAN + 1) + 1
            n = end - begin
            place, least = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(c, n)
            place = place[np.where(place + SPAN - least >= HALF, np.repeat(after, n), np.repeat(before, n))]
            row = np.searchsorted(at, place, "right") - 1
            key = shingles_of(words, WORDS)[place].view(np.int64) if len(place) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row)), pa.array(key), pa.array((place - at[row]).astype(np.int32))], names=["doc", "key", "place"])

    around = s.write(docs.withColumn("bit", filter_bit("doc_id")).mapInArrow(runs, "doc long, key long, place int"), "runs")
    firsts = s.write(around.groupBy("key").agg(F.min(F.struct("doc", "place")).alias("s"), F.max("doc").alias("most")).filter("s.doc < most").select("key", "s"), "first-runs")
    asked = around.join(copies.select(F.col("doc_id").alias("doc")).distinct(), "doc", "left_anti")
    asked = s.write(asked.join(held, (asked.doc == held.doc) & F.expr(f"start_word <= place and end_word >= place + {WORDS}"), "left_anti"), "asked")
    hits = asked.join(firsts, "key").filter("doc <> s.doc").selectExpr("doc", "s.doc as source", "place - s.place as shift", "place").distinct()
    stretch = hits.withColumn("k", F.col("place") - F.row_number().over(W.partitionBy("doc", "source", "shift").orderBy("place")))
    ends = stretch.groupBy("doc", "source", "shift", "k").agg(F.min("place").alias("low"), (F.max("place") + WORDS).alias("high"))
    return ends.selectExpr("doc as doc_id", "low as start_word", "high as end_word", "source as source_doc_id", "low - shift as source_start", "high - shift as source_end", "1.0D as similarity")


def covered(rows: pa.Table, least: int, margin: int) -> pa.Table:
    """Of a document and a source: stretches along nearly one diagonal that so many hash functions at least cover,
    with a margin on both sides."""
    f, shift, low, high = (rows.column(c).to_numpy() for c in ("f", "shift", "low", "high"))
    order = np.argsort(shift, kind="stable")
    f, shift, low, high = f[order], shift[order], low[order], high[order]
    out = []
    cuts = [0, *(np.flatnonzero(np.diff(shift) > DRIFT) + 1).tolist(), len(shift)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if len(set(f[a:b].tolist())) < least:
            continue
        events = sorted([(x, 0, k) for x, k in zip(low[a:b].tolist(), f[a:b].tolist(), strict=True)] + [(x + 1, 1, k) for x, k in zip(high[a:b].tolist(), f[a:b].tolist(), strict=True)])
        depth, start = [0] * FUNCTIONS, None
        for x, ends, k in events:
            depth[k] += -1 if ends else 1
            enough = sum(d > 0 for d in depth) >= least
            if enough and start is None:
                start = x
            elif not enough and start is not None:
                if out and out[-1][2] == a and start - out[-1][1] <= DRIFT:
                    start = out.pop()[0]
                out.append((start, x, a, int(shift[a]), int(shift[b - 1])))
                start = None
    out = [(max(0, s - margin), e - 1 + margin, max(0, s - hi - margin), e - 1 - lo + margin) for s, e, _, lo, hi in out if e - s >= SPAN]
    n = len(out)
    doc, source = (rows.column(c)[0].as_py() for c in ("doc", "source"))
    columns = [pa.array(x, pa.int32()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int32())] * 4
    return pa.table([pa.array([doc] * n, pa.int64()), pa.array([source] * n, pa.int64()), *columns], names=["doc", "source", "low", "high", "source_low", "source_high"])


def passages_of(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Runs [i, j) of a's tokens that come again, nearly, as [k, m) of b's, with their sets' similarity: those of which
    LOOSE of the tokens in each passage length come again, or inside them those with DENSE of the tokens."""
    if len(a) < SPAN or len(b) < SPAN:
        return []
    order = np.argsort(b, kind="stable")
    at = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    place = order[at]
    hit = b[place] == a
    count = np.concatenate([[0], np.cumsum(hit)])
    count = count[SPAN:] - count[:-SPAN]
    out = []
    for s, e in runs_of(count >= SPAN * LOOSE):
        whole = passage(a, b, hit, place, s, e)
        if whole:
            out.append(whole)
        else:
            out += [x for i, j in runs_of(count[s:e] >= SPAN * DENSE) if (x := passage(a, b, hit, place, s + i, s + j))]
    return out


def runs_of(good: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def passage(a: np.ndarray, b: np.ndarray, hit: np.ndarray, place: np.ndarray, s: int, e: int) -> tuple | None:
    """The passage of the SPAN tokens from each of places [s, e), if its sets are alike enough."""
    matched = s + np.flatnonzero(hit[s : e + SPAN - 1])
    i, j, where = int(matched[0]), int(matched[-1]) + 1, place[matched]
    if j - i < SPAN * DENSE:
        return None
    k, m = int(where.min()), int(where.max()) + 1
    share = similarity(a[i:j], b[k:m])
    if share < SIMILARITY:
        # Repeats inside the source can stretch its side; then the part on the run's own diagonal decides.
        lag = int(np.median(where - matched))
        k, m = max(0, i + lag), min(len(b), j + lag)
        share = similarity(a[i:j], b[k:m])
    return (i, j, k, m, share) if share >= SIMILARITY else None


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        out = []
        for row in rows.to_pylist():
            for i, j, k, m, share in passages_of(long(row["mine"]), long(row["theirs"])):
                out.append((row["doc"], row["low"] + i, row["low"] + j + K - 1, row["source"], row["source_low"] + k, row["source_low"] + m + K - 1, round(share, 6)))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start_word", "end_word", "source_doc_id", "source_start", "source_end", "similarity"])


def without_passages(docs: DataFrame, passages: DataFrame, text_column: str = "text") -> DataFrame:
    """Docs (unique doc_id) with the repeated words, and the blanks after them, cut out of their texts; a document of
    which no word is left goes. Other columns stay as they are. Texts without passages aren't copied to Python."""
    spans_column, flag = unused("spans", docs), unused("bit", docs)
    spans = passages.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start_word", "end_word"))).alias(spans_column))
    bits = id_filter(passages.select("doc_id").distinct(), "doc_id")
    marked = docs.withColumn(flag, filter_bit("doc_id"))
    side = lambda inside: marked.mapInArrow(lambda batches: hits_only(batches, bits, flag, inside), marked.schema).select(*docs.columns)
    joined = side(True).join(spans, "doc_id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, text_column):
            _, starts, stops, at = words_of(data, offsets)
            texts = []
            for n, found in enumerate(rows.column(spans_column).to_pylist()):
                own, ends = starts[at[n] : at[n + 1]], np.append(starts[at[n] : at[n + 1]], offsets[n + 1])
                keep = np.ones(offsets[n + 1] - offsets[n], bool)
                left = np.ones(len(own), bool)
                for s in found:
                    keep[ends[s["start_word"]] - offsets[n] : ends[min(s["end_word"], len(own))] - offsets[n]] = False
                    left[s["start_word"] : s["end_word"]] = False
                texts.append(data[offsets[n] : offsets[n + 1]][keep].tobytes().decode().rstrip() if left.any() else None)
            columns = [pa.array(texts, pa.string()) if name == text_column else rows.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([t is not None for t in texts]))

    names = docs.columns
    whole = joined.filter(F.col(spans_column).isNull()).select(*names)
    return side(False).unionByName(whole).unionByName(joined.filter(F.col(spans_column).isNotNull()).mapInArrow(cut, docs.schema))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
