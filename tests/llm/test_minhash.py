"""The MinHash join against classes of all pairs of sets, and its counting against plain counts."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import common, minhash_join
from tidemark.llm.shingles import shingle_sets

from .test_operators import EDGES, documents, edited, plain_classes, plain_sets, prose

RNG = random.Random(23)


@pytest.mark.parametrize(("k", "percent"), [(2, 80), (4, 90)])
def test_classes_equal_brute_force(spark, k, percent):
    base = [prose(RNG.choice([4, 12, 40, 150]), RNG) for _ in range(14)]
    texts = [*EDGES, *EDGES, *base, *base[:4]]
    for t in base * 6:
        texts.append(edited(t, RNG.choice([0, 1, 1, 2, 3, 8])))
    # A chain of copies, each with an edit more than the last, and a line that most documents hold.
    chain = prose(60, RNG)
    for _ in range(12):
        chain = edited(chain, 1)
        texts.append(chain)
    line = prose(30, RNG)
    texts += [f"{line} {prose(n, RNG)}" for n in (5, 6, 8, 10, 20, 30) * 4]
    RNG.shuffle(texts)
    sets = plain_sets(texts, k)
    got = {r.doc_id: r for r in minhash_join.minhash_classes(documents(spark, texts, True), k, percent).collect()}
    want = plain_classes(sets, percent)
    assert len(got) == len(texts)
    for i, (own, top) in enumerate(zip(sets, want, strict=True)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(own), top, top == i)


def test_crowds_without_leaders(spark, monkeypatch):
    """Many documents of one list that link in pairs only: small tiles, the rounds run out."""
    monkeypatch.setattr(minhash_join, "SIDE", 7)
    monkeypatch.setattr(minhash_join, "TILE", 5)
    line = prose(60, RNG)
    texts = []
    for _ in range(40):
        own = f"{line} {prose(24, RNG)}"
        texts += [own, own + " more"]
    RNG.shuffle(texts)
    got = {r.doc_id: r.component_id for r in minhash_join.minhash_classes(documents(spark, texts), 2, 80).collect()}
    assert [got[i] for i in range(len(texts))] == plain_classes(plain_sets(texts, 2), 80)


def test_repeated_and_missing_ids_and_empty_tables(spark):
    text = prose(50, RNG)
    df = spark.createDataFrame([(1, text), (1, "zz " + text), (2, text), (None, text), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash_join.minhash_classes(df).collect())
    assert [g[0] for g in got] == [1, 2, 3] and got[1][1] == (1 if min(text, "zz " + text) == text else got[1][1]) and got[2] == (3, 3, True)
    assert minhash_join.minhash_classes(df.limit(0)).count() == 0


def test_collisions_are_counted_exactly():
    rng = np.random.default_rng(2)
    for values in (2, 3, 6, 40):
        items = rng.integers(0, values, (60, minhash_join.K))
        sizes, kind, home, side = np.sort(rng.integers(80, 110, 60)), rng.integers(0, 50, 60), rng.integers(0, 9, 60), rng.integers(0, 2, 60)
        least = minhash_join.threshold(80)
        for within in (True, False):
            want = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * sizes[i] >= 80 * sizes[j] and kind[i] != kind[j] and home[i] != home[j] and (within or side[i] != side[j]) and (items[i] == items[j]).sum() >= least}
            i, j = minhash_join.tile_pairs(items, sizes, kind, home, side, within, 80)
            assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_bitmaps_bound_from_above():
    sets = [shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 2)[0] for base in (prose(40, RNG), prose(400, RNG)) for t in [base, *(edited(base, n) for n in (1, 2, 4, 9, 30))]]
    sizes, bits = np.array([len(x) for x in sets]), [minhash_join.bitmap(x) for x in sets]
    i, j = (np.array(x) for x in zip(*((a, b) for a in range(12) for b in range(12) if a != b), strict=True))
    near = np.array([100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    may = minhash_join.within_bound(sizes, bits, i, j, 80)
    assert (may | ~near).all() and near.any() and not may.all()


def test_signatures_estimate_similarity():
    a, b = prose(2000, RNG), None
    words = a.split(" ")
    b = " ".join(words[:1800] + [prose(200, RNG)])
    x, y = (shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 2)[0] for t in (a, b))
    near = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((minhash_join.signature(x) == minhash_join.signature(y)).mean() - near) < 0.2
    assert len(set(minhash_join.signature(x).tolist())) == minhash_join.K  # coordinates have items of their own
    assert minhash_join.threshold(80) == 24


def test_documents_of_few_common_items_are_not_posted(spark):
    """Common coordinates alone don't make documents meet: items are of several coordinates, and M of them have to be in
    other documents too."""
    rng = np.random.default_rng(5)
    items = rng.integers(1, 2**62, (40, minhash_join.K))
    items[1:20, :10] = items[0, :10]  # five items of two coordinates
    items[20:38, ::2] = items[20, ::2]  # half of the coordinates, no item
    items[38:, :4] = items[38, :4]  # two items
    signs = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(items)], "doc_id long, items array<long>")
    with common.Scratch(spark, "posted") as s:
        met = minhash_join.posted(s, signs, 80).collect()
    assert {r.doc for r in met} == set(range(20)) and {r.leader for r in met} == {0}
    assert max(Counter(r.doc for r in met).values()) == 3  # of five items, three asked for


def test_items_asked_for_lose_no_more_than_coordinates():
    def tail(n, p, t):
        return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(t))

    for percent in (70, 75, 80, 85, 90, 95):
        width, least = minhash_join.items_asked(percent)
        near = percent / 100
        assert tail(minhash_join.K // width, near**width, least) < tail(minhash_join.K, near, minhash_join.threshold(percent)) / 10
    assert minhash_join.items_asked(80) == (2, 3) and minhash_join.items_asked(50) == (1, minhash_join.threshold(50))
