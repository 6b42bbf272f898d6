"""Token counts of whole texts under a byte-level byte-pair vocabulary, by rank-synchronous merging.

A batch's distinct pre-tokens are held as ragged numpy arrays; each merges its lowest-ranked pair at the same step as
the others (rank_merge), and the symbols that survive are counted. The vocabulary is a tokenizers JSON file whose path
is a parameter.

Cases: a null or empty text has 0 tokens; a special token's string inside a text is one token, as in the library's
default; texts of any length are counted whole; null ids stay null, repeated rows are repeated, other columns are
not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, text_slices
from tidemark.llm.rank_merge import Merges

#: Pre-tokens kept with their counts in a worker; beyond that the memory starts anew.
KEPT = 400_000
# Fixed value: the pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else 256 and on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class ByteLevel:
    """A byte-level vocabulary: its merges over byte symbols, its special strings and its pre-token pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or not pre.get("use_regex", True) or model.get("ignore_merges") or model.get("unk_token"):
            raise ValueError("only plain byte-level BPE vocabularies are handled")
        vocabulary = model["vocab"]
        self.first = np.array([vocabulary[c] for c in byte_letters()], np.int32)
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        left, right = (np.array([vocabulary[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merges = Merges(left, right, np.arange(len(pairs)), np.array([vocabulary[a + b] for a, b in pairs], np.int64), max(vocabulary.values()) + 1)
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("added tokens with options aren't handled")
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words = regex.compile(PATTERN)
        self.kept: dict[str, int] = {}

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The text's pre-tokens and the number of special strings between them."""
        if self.special is None or not self.special.search(text):
            return self.words.findall(text), 0
        parts = self.special.split(text)
        return [w for part in parts for w in self.words.findall(part)], len(parts) - 1

    def learn(self, words: set[str]) -> None:
        """Counts the symbols of pre-tokens not seen before."""
        new = list(words)
        raw = [w.encode() for w in new]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        _, counts = self.merges.merge(self.first[np.frombuffer(b"".join(raw), np.uint8)], lengths)
        self.kept.update(zip(new, counts.tolist(), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        parts = [self.pretokens(t) for t in texts]
        if len(self.kept) > KEPT:
            self.kept.clear()
        new = set().union(*(x for x, _ in parts)).difference(self.kept)
        if new:
            self.learn(new)
        get = self.kept.__getitem__
        return [sum(map(get, x)) + n for x, n in parts]


@lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; the file at `path` lies on every executor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = byte_level(path)
        for rows, data, offsets in text_slices(batches, "text"):
            raw = data.tobytes()
            counts = vocabulary.counts([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            n = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(work, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_column)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
