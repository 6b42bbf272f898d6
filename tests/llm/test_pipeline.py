"""The pipeline's stages, each on what the stage before kept, against plain versions."""

import os
import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def runs(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def classes(docs):
    sets, label = {i: runs(t, 5) for i, t in docs.items()}, {i: i for i in docs}
    for i in sorted(docs):
        for j in sorted(docs):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {n: a if c == b else c for n, c in label.items()}
    return label


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_each_stage_does_its_whole_job(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
        assert name == "packed" or docs.columns == DOCUMENTS
    quality, near, repeated, private, packed = seen
    before, kept = ({r.doc_id: r.text for r in x.collect()} for x in (quality, near))
    assert 0 < len(before) <= 200 and kept == {i: before[i] for i, c in classes(before).items() if i == c}
    cut = {r.doc_id: r.text for r in repeated.collect()}
    earlier = set()
    for i in sorted(cut):
        own = {x for x in runs(cut[i], 50) if len(x) == 50}
        assert not own & earlier, i
        earlier |= own
    assert all(cut[i] == kept[i] or len(words(cut[i])) < len(words(kept[i])) for i in cut)
    masked = {r.doc_id: r.text for r in private.collect()}
    mails = {m for t in cut.values() for m in re.findall(r"[\w.]+@[\w.]+\.\w+", t or "")}
    assert masked.keys() == cut.keys() and not [m for m in mails for t in masked.values() if m in (t or "")]
    assert all(len(words(masked[i])) == len(words(cut[i])) for i in cut)
    rows = packed.collect()
    assert sorted(r.doc_id for r in rows) == sorted(masked) and all(r.n_tokens <= r.bucket_len or r.n_tokens == 0 for r in rows)
    assert len({(r.bucket, r.batch_id, r.slot) for r in rows}) == len(rows)


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    text = " ".join(f"word{n}" for n in range(80))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (None, text, "en", "a", 1), (5, f"x {text} y", "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    (labels := spark.createDataFrame([], "doc_id long, quality int, toxic int")).write.parquet(f"{tmp_path}/labels.parquet")
    assert labels.count() == 0
    for stage in (corpus_pipeline.quality, corpus_pipeline.private):
        assert stage(spark, docs, str(tmp_path)).count() == len(rows)
    near = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in near) == [(0, text), (1, text), (3, ""), (4, "")]
    repeated = {r.doc_id: r.text for r in corpus_pipeline.repeated(spark, docs, str(tmp_path)).collect()}
    assert repeated == {None: text, 1: text, 3: None, 4: "", 5: "x y"}
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).count() == len(rows)
    none = docs.filter(F.lit(False))
    assert [f(spark, none, str(tmp_path)).count() for _, f in corpus_pipeline.STAGES] == [0] * 5
