"""Crowds whose documents nearly link: what the tiles give grows with their rows, not with their pairs."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import common, jaccard_join, minhash_join
from tidemark.llm.shingles import shingle_sets

from .test_operators import documents, edited, plain_classes, plain_sets, prose

RNG = random.Random(31)


def crowd(n, edits):
    text = prose(70, RNG)
    return [edited(text, edits) for _ in range(n)]


def test_tiles_of_near_misses_give_rows_and_no_pairs(spark):
    docs = documents(spark, crowd(90, 3)).select("doc_id", "text")
    met = docs.select(F.lit(7).cast("long").alias("sig"), F.col("doc_id").alias("doc"), F.col("doc_id").alias("class"), F.col("doc_id").alias("home"))
    maps = jaccard_join.map_sets(docs, lambda rows, sets: jaccard_join.chosen(rows, sets, jaccard_join.bitmap), "doc long, size long, held binary", 4)
    near = jaccard_join.rest_pairs(met, maps, 60, False)
    assert 0 < near.count() <= 180  # two tiles; 4,005 pairs
    near = minhash_join.with_each_other(met, minhash_join.signed(docs, 2), 80, "class", False)
    assert 0 < near.count() <= 180


def test_links_of_a_tile_join_its_classes_once():
    texts = [t for _ in range(4) for t in crowd(12, 2)]
    sets = [shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 2)[0] for t in texts]
    n = len(texts)
    rows = pa.table({"sig": [1] * n, "x": [0] * n, "y": [0] * n, "side": [0] * n, "doc": list(range(n)), "class": list(range(n)), "home": list(range(n)), "size": [len(x) for x in sets], "held": [x.tobytes() for x in sets]})
    links = jaccard_join.joining_links(rows, ("class", "home"), 80).to_pylist()
    top = list(range(n))
    for link in links:
        low, high = sorted((top[link["a"]], top[link["b"]]))
        assert low < high
        top = [low if t == high else t for t in top]
    assert top == plain_classes(plain_sets(texts, 2), 80) and len(set(top)) < n
    same = rows.set_column(6, "home", pa.array([0] * n))
    assert jaccard_join.joining_links(same, ("class", "home"), 80).num_rows == 0


def test_classes_of_a_crowd_of_near_misses_equal_brute_force(spark, monkeypatch):
    for module in (jaccard_join, minhash_join):
        monkeypatch.setattr(module, "SIDE", 9)
        monkeypatch.setattr(module, "ROUNDS", 1)
    texts = crowd(40, 2) + crowd(40, 3)
    RNG.shuffle(texts)
    docs = documents(spark, texts)
    for classes, k, percent in ((jaccard_join.jaccard_classes, 4, 75), (minhash_join.minhash_classes, 2, 80)):
        got = {r.doc_id: r.component_id for r in classes(docs, k, percent).collect()}
        assert [got[i] for i in range(len(texts))] == plain_classes(plain_sets(texts, k), percent)


def test_batches_of_texts_on_their_way_to_python_are_small(spark, tmp_path):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    before = spark.conf.get(common.BATCH)
    found = common.save(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"), f"file://{tmp_path}/sizes")
    assert sorted({r.n for r in found.collect()}) == [common.BATCH_ROWS] and spark.conf.get(common.BATCH) == before


def test_documents_leave_their_most_crowded_meetings(spark):
    """Of meetings of which m are sure to be shared the m - 1 most crowded go, and all of a document that has fewer."""
    rows = [(1, sig, 2 * 3, n) for sig, n in ((10, 2), (11, 9), (12, 5), (13, 5), (14, 3))] + [(2, 10, 7, 2), (2, 11, 7, 9)] + [(2, 12, 2, 5)]
    there = spark.createDataFrame(rows, "doc long, sig long, need int, n long")
    assert sorted((r.doc, r.sig) for r in jaccard_join.rarest(there).collect()) == [(1, 10), (1, 12), (1, 14), (2, 12)]


def test_linked_sets_share_one_of_the_meetings_left():
    rng = np.random.default_rng(8)
    for size in (20, 60, 200):
        base = np.unique(rng.integers(1, 2**63, size, dtype=np.uint64))
        sets = [base] + [np.unique(np.concatenate([base[rng.permutation(len(base))[int(len(base) * 0.1) :]], rng.integers(1, 2**63, 1 + len(base) // 20, dtype=np.uint64)])) for _ in range(12)]
        posted = [list(zip(*(x.tolist() for x in jaccard_join.signatures(x, 80)), strict=True)) for x in sets]
        crowd = {s: int(rng.integers(2, 9)) for p in posted for s, _ in p}  # any order will do
        left = []
        for p in posted:
            keep = set()
            for need in {n for _, n in p}:
                own = sorted((crowd[s], s) for s, n in p if n == need)
                keep |= {s for _, s in own[: max(0, len(own) - (need >> 1) + 1)]}
            left.append(keep)
        assert max(s for p in posted for s, _ in p) < 1 << jaccard_join.SIG_BITS
        assert all(left[i] & left[j] for i in range(13) for j in range(i) if jaccard_join.linked(sets[i], sets[j], 80))
