"""Substring dedup against plain versions: windows, exact repeats, near repeats with misleading smaller documents."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import substring_dedup as sd

RNG = random.Random(11)
WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("l", "n", "ra", "so", "ti")]
SCHEMA = "doc_id long, text string, lang string"


def prose(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def edited(words, n):
    words = list(words)
    for at in RNG.sample(range(len(words)), n):
        words[at] = "edit" + RNG.choice(WORDS)
    return words


def covered(rows, doc, start, end):
    """The share of words [start, end) of a document that its passages cover."""
    hit = np.zeros(end - start, bool)
    for r in rows:
        if r.doc_id == doc:
            hit[max(0, r.start_word - start) : max(0, r.end_word - start)] = True
    return hit.mean()


def test_windows_equal_their_definition():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 200, 900, dtype=np.uint64)  # many ties
    inside = np.ones(900, bool)
    inside[[200, 201, 202, 203, 500, 501, 502, 503, 896, 897, 898, 899]] = False
    for f in range(sd.FUNCTIONS):
        h = sd.mix(tokens ^ np.uint64(0x9E3779B97F4A7C15 * (f + 1) & (1 << 64) - 1)) | np.uint64(1)
        h[~inside] = 0
        want = []
        for c in range(900):
            low, high = c, c
            while inside[c] and low > 0 and h[low - 1] > h[c]:
                low -= 1
            while inside[c] and high < 899 and h[high + 1] >= h[c]:
                high += 1
            if inside[c] and high - low + 1 >= sd.SPAN:
                want.append((c, low, high))
        _, *got = sd.compact_windows(tokens, inside, f)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def test_repeats_hidden_by_fragments_in_smaller_documents(spark):
    """Documents 0 and 1 hold 38-word fragments of every passage, too short to count; 7 and 9 hold the passages, 8 and 10
    near copies of others."""
    exact, near = [prose(60) for _ in range(30)], [prose(100) for _ in range(40)]
    join = lambda parts: " ".join(" ".join([*p, *prose(30)]) for p in parts)
    cut = lambda p: p[(at := RNG.randrange(len(p) - 37)) : at + 38]
    copies = [edited(p, 1 + n % 2) for n, p in enumerate(near)]
    rows = [(0, join([cut(p) for p in exact + near])), (1, join([cut(p) for p in exact + near])), (7, join(exact)), (8, join(near)), (9, join(exact)), (10, join(copies))]
    found = sd.repeated_passages(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)).collect()
    assert all(r.source_doc_id < r.doc_id for r in found)
    assert sum(covered(found, 9, 90 * n, 90 * n + 60) == 1 for n in range(30)) == 30
    assert np.mean([covered(found, 10, 130 * n, 130 * n + 100) > 0.5 for n in range(40)]) >= 0.95
    assert np.mean([covered(found, 10, 130 * n, 130 * n + 100) > 0.8 for n in range(40)]) >= 0.9
    assert not [r for r in found if r.doc_id in (1, 7, 8)]


def test_near_repeats_behind_fragments_at_every_fifth_word(spark):
    """Smaller documents hold, for every passage, each run of 44 words that begins at a fifth word: no context of the
    passage is without one. 60 passages of each kind: 70 words with an edit, 100 with two, 150 with three."""
    kinds = {70: 1, 100: 2, 150: 3}
    passages = [prose(size) for size in kinds for _ in range(60)]
    copies = []
    for p in passages:
        while True:  # edits that leave the passage similar
            q = edited(p, kinds[len(p)])
            a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (p, q))
            if len(a & b) >= 0.8 * len(a | b):
                break
        copies.append(q)
    rows = [(j, " ".join(" ".join([*p[5 * j : 5 * j + 44], *prose(30)]) for p in passages if 5 * j + 44 <= len(p))) for j in range(22)]
    rows += [(100 + n // 20, " ".join(" ".join([*p, *prose(30)]) for p in passages[n : n + 20])) for n in range(0, 180, 20)]
    rows += [(200 + n, " ".join([*prose(30), *q, *prose(30)])) for n, q in enumerate(copies)]
    found = sd.repeated_passages(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)).collect()
    for kind, size in enumerate(kinds):
        share = np.mean([covered(found, 200 + n, 30, 30 + size) > 0.8 for n in range(60 * kind, 60 * kind + 60)])
        assert share >= 0.9, (size, share)
    assert not [r for r in found if r.doc_id < 200 and r.end_word - r.start_word >= 50]


def test_near_repeats_against_brute_force(spark):
    """Pairs of passages of 50 to 120 words, edited, are judged by their token sets; of those of similarity 0.8 or more
    at least 0.9 are found, and clean documents have none."""
    rows, pairs = [], []
    for n in range(120):
        p = prose(RNG.choice([50, 60, 80, 120]))
        q = edited(p, RNG.choice([0, 1, 1, 2, 3]))
        before = RNG.randrange(60)
        rows += [(2 * n, " ".join([*prose(40), *p, *prose(40)])), (2 * n + 1, " ".join([*prose(before), *q, *prose(30)]))]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (p, q))
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((2 * n + 1, before, before + len(q)))
    rows += [(1000 + n, " ".join(prose(200))) for n in range(20)]
    found = sd.repeated_passages(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)).collect()
    assert np.mean([covered(found, d, a, b) > 0.8 for d, a, b in pairs]) >= 0.9
    assert not [r for r in found if r.doc_id >= 1000 or r.doc_id % 2 == 0]


def test_exact_repeats_equal_brute_force(spark):
    """Every place whose 50 words stand in an earlier document is covered."""
    base = [prose(70) for _ in range(6)]
    texts = []
    for _ in range(40):
        words = []
        for _ in range(4):
            start = RNG.randrange(30)
            words += [*prose(RNG.randrange(20)), *RNG.choice(base)[start : start + RNG.randrange(20, 71)]]
        texts.append(" ".join(words))
    found = sd.repeated_passages(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)).collect()
    seen = set()
    for i, t in enumerate(texts):
        words = t.split()
        runs = [tuple(words[k : k + 50]) for k in range(len(words) - 49)]
        for k, run in enumerate(runs):
            if run in seen:
                assert covered(found, i, k, k + 50) > 0.95, (i, k)
        seen.update(runs)


def test_nulls_repeated_ids_ties_and_other_columns(spark):
    p = " ".join(prose(80))
    rows = [(None, p, "a"), (1, p, "a"), (1, p, "b"), (2, "zzz", "a"), (2, p, "a"), (2, None, "c"), (3, "", "a"), (4, p.upper(), None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"bit": F.lit(1), "spans": F.lit("s"), "start_word": F.lit(2)})
    found = sd.repeated_passages(docs).collect()
    # id 2 stands for its null text, the least of its rows'.
    assert {(r.doc_id, r.source_doc_id, r.start_word, r.end_word) for r in found} == {(4, 1, 0, 80)}
    left = sd.without_passages(docs, sd.repeated_passages(docs)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == sorted((i is None, i or 0) for i, _, _ in rows if i != 4)
    assert left[0].asDict().keys() == {"doc_id", "text", "lang", "bit", "spans", "start_word"} and {r.spans for r in left} == {"s"}
