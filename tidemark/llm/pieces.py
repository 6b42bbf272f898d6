"""SentencePiece encoding and decoding of whole texts, with every piece's place in the original bytes.

The model file is read here: pieces with scores, and the compiled character map, a double-array trie from byte strings
to replacements. Normalisation takes the longest prefix that the map knows, else one character, and notes for each
normalised character the original bytes that it stands for; pieces then project to byte spans. Merging is that of
rank_merge over a batch's distinct segments, since no piece reaches over the start of a run of spaces.

Handled: BPE models of normal, control, unknown and byte pieces. Others raise ValueError.

Cases: a null or empty text gives the end id alone; characters outside the vocabulary become byte pieces (or the
unknown id where a model has none); null ids stay null; repeated rows are repeated.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, text_slices
from tidemark.llm.rank_merge import Merges

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Segments kept with their ids in a worker; beyond that the memory starts anew.
KEPT = 300_000


def proto(data: bytes) -> list[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message, in order."""
    out, at = [], 0

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value, shift, more = value | (data[i] & 127) << shift, shift + 7, data[i] > 127
            i += 1
            if not more:
                return value, i

    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        out.append((tag >> 3, value))
    return out


class CharacterMap:
    """A compiled character map: the trie's size, its 32-bit units, then the replacements, each ended by a zero."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]
        self.known: dict[bytes, bytes] = {}

    def replacement(self, at: int) -> bytes:
        return self.texts[at : self.texts.index(b"\0", at)]

    def longest_prefix(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that data has at a place."""
        if not self.units:
            return None
        units, node, found = self.units, 0, None
        node ^= units[0] >> 10 << ((units[0] & 1 << 9) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & (1 << 31 | 255) != data[k]:
                break
            unit = units[node]
            node ^= unit >> 10 << ((unit & 1 << 9) >> 6)
            if unit >> 8 & 1:
                found = (k + 1 - at, self.replacement(units[node] & (1 << 31) - 1))
        return found


class PieceModel:
    def __init__(self, source: str | bytes):
        if isinstance(source, str):
            with open(source, "rb") as file:
                source = file.read()
        fields = proto(source)
        parts = [dict(proto(v)) for k, v in fields if k == 1]
        self.pieces = [p[1].decode() for p in parts]
        kinds = [p.get(3, NORMAL) for p in parts]
        trainer, norm = (dict(proto(next((v for k, v in fields if k == n), b""))) for n in (2, 3))
        if parts and (trainer.get(3, 1) != 2 or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}):
            raise ValueError("only BPE models without user-defined or unused pieces are handled")
        if trainer.get(24, 0) or not norm.get(5, 1):
            raise ValueError("spaces after words, or unescaped, aren't handled")
        self.map = CharacterMap(norm.get(2, b""))
        self.dummy_prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.end = int(trainer.get(42, 2))
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else 0
        self.special = {i for i, k in enumerate(kinds) if k in (CONTROL, UNKNOWN)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        letters = {c for p in normal for c in p}
        self.letter = {c: normal[c] if c in normal else len(parts) + k for k, c in enumerate(sorted(letters))}
        score = {p: struct.unpack("<f", parts[i][2])[0] if 2 in parts[i] else 0.0 for p, i in normal.items()}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        known = normal | self.letter
        pairs = [(known[p[:k]], known[p[k:]], order[score[p]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
        left, right, rank, made = np.array(pairs, np.int64).reshape(-1, 4).T
        self.symbols = len(parts) + len(letters) + 1
        self.named = [str(i) for i in range(len(parts))]
        self.code = np.full(0x110000, self.symbols - 1, np.int32)  # the symbol of every character
        for c, i in self.letter.items():
            self.code[ord(c)] = i
        self.width = np.array([len(p) for p in self.pieces] or [0], np.int64)
        self.merges = Merges(left, right, rank, made, self.symbols)
        self.kept: dict[str, tuple[str, int, str, bytes, np.ndarray | None]] = {}
        joined = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal)
        alone = "\n" if not any("\n" in p and len(p) > 1 for p in normal) else ""
        self.segments = re.compile("(?s).+" if joined else f"{alone + '|' if alone else ''}{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")

    def normalise(self, text: bytes) -> tuple[str, list[int] | None]:
        """The normalised text and where each of its characters, and its end, starts in the original bytes. None: one
        character for one after the space put before; that needs no list."""
        if not text:
            return "", [0]
        if not self.map.units and not self.squeeze:
            return (SPACE if self.dummy_prefix else "") + text.decode().replace(" ", SPACE), None
        out: list[str] = []
        starts: list[int] = []
        at = 0
        while at < len(text):
            size = 1 if text[at] < 128 else 2 if text[at] < 224 else 3 if text[at] < 240 else 4
            size, new = self.map.longest_prefix(text, at) or (size, text[at : at + size])
            for c in new.decode(errors="replace").replace(" ", SPACE):
                if not (self.squeeze and c == SPACE and (not out or out[-1] == SPACE)):
                    out.append(c)
                    starts.append(at)
            at += size
        end = at
        while self.squeeze and out and out[-1] == SPACE:
            out.pop()
            end = starts.pop()
        if out and self.dummy_prefix:
            out.insert(0, SPACE)
            starts.insert(0, starts[0])
        return "".join(out), [*starts, end]

    def surface(self, ids: list[int]) -> str:
        """What ids say before the leading space goes: pieces, byte pieces gathered and read as UTF-8."""
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(utf8(bytes(raw)))
                raw.clear()
            if i >= 0 and i not in self.special:
                out.append(self.pieces[i].replace(SPACE, " "))
            elif i == self.unknown:
                out.append(" ⁇ ")
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        said = self.surface(ids)
        return said[1:] if self.dummy_prefix and said.startswith(" ") and next((i for i in ids if i not in self.special), None) not in self.byte_of else said

    def learn(self, segments: list[str]) -> None:
        """Encodes segments not seen before, all at once."""
        codes = self.code[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        merged, counts = self.merges.merge(codes, np.fromiter(map(len, segments), np.int64, len(segments)))
        last = np.cumsum(counts)
        odd = np.logical_or.reduceat(merged >= len(self.pieces), last - counts).tolist()
        ids, raw, named = merged.tolist(), merged.astype(np.int32).tobytes(), self.named.__getitem__
        at = 0
        for text, stop, outside in zip(segments, last.tolist(), odd, strict=True):
            if outside:
                changed = self.fall_back(ids[at:stop], text)
                own = changed[0].tolist()
                self.kept[text] = (" ".join(map(named, own)) + " ", len(own), self.surface(own), changed[0].tobytes(), changed[1:])
            else:
                self.kept[text] = (" ".join(map(named, ids[at:stop])) + " ", stop - at, text.replace(SPACE, " "), raw[4 * at : 4 * stop], None)
            at = stop

    def fall_back(self, own: list[int], text: str) -> np.ndarray:
        """Byte pieces, or the unknown id, for symbols outside the vocabulary: ids, the segment's characters that each
        leaves behind, and those beyond that it stands for (a character is left behind by its last byte)."""
        out, at = [], 0
        for i in own:
            if i < len(self.pieces):
                out.append([i, len(self.pieces[i]), 0])
                at += len(self.pieces[i])
                continue
            if self.bytes:
                out += [[self.bytes[b], 0, 1] for b in text[at].encode()]
                out[-1][1:] = [1, 0]
            elif out and out[-1][0] == self.unknown:
                out[-1][1] += 1
            else:
                out.append([self.unknown, 1, 0])
            at += 1
        return np.array(out, np.int32).T

    def parts(self, texts: list[bytes]) -> list[tuple[list[str], list[int] | None, bytes]]:
        """Each text's segments, all of them learnt, its alignment and its bytes."""
        out = []
        for text in texts:
            normal, starts = self.normalise(text)
            out.append((self.segments.findall(normal), starts, text))
        if len(self.kept) > KEPT:
            self.kept.clear()
        new = set().union(*(x for x, _, _ in out)).difference(self.kept)
        if new:
            self.learn(list(new))
        return out

    def spans(self, sizes: tuple[int, ...], own: tuple[bytes, ...], odd: tuple[np.ndarray | None, ...], starts: list[int] | None, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of learnt segments (of `sizes` ids), and the original bytes [start, end) of each. `odd` has what fall_back says of
        segments with symbols outside the vocabulary. Byte pieces of one character share that character's bytes; the space put before
        a text has none."""
        if starts is None:
            heads = np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)
            place = np.concatenate([[0] * self.dummy_prefix, heads, [len(raw)]]).astype(np.int32)
        else:
            place = np.array(starts, np.int32)
        ids = np.frombuffer(b"".join(own), np.int32)
        width = self.width[ids]
        changed = [n for n, x in enumerate(odd) if x is not None]
        if not changed:
            last = np.cumsum(width)
            return ids, place[last - width], place[last]
        at, beyond = np.cumsum(sizes), np.zeros_like(width)
        for n in changed:
            width[at[n] - sizes[n] : at[n]], beyond[at[n] - sizes[n] : at[n]] = odd[n]
        last = np.cumsum(width)
        return ids, place[last - width], place[last + beyond]


def utf8(raw: bytes) -> str:
    """UTF-8, with U+FFFD for each byte that isn't part of a character."""
    out, at = "", 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out += raw[at : at + n].decode()
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out, at = out + "�", at + 1
    return out


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", end: bool = True, arrays: bool = True) -> DataFrame:
    """(id, n_tokens, ids_text, decoded, and with `arrays` ids, starts, ends) of every row: ids in decimal joined by a
    space, the text that they decode to, and every id's span in the text's UTF-8 bytes (the end id's is empty)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for rows, data, offsets in text_slices(batches, "text"):
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            out: list[tuple] = []
            lists: list[list[np.ndarray]] = [[], [], []]
            for segments, starts, text in model.parts(texts):
                ids_texts, sizes, surfaces, own, odd = zip(*map(model.kept.__getitem__, segments), strict=True) if segments else ((),) * 5
                said = "".join(surfaces)
                if model.dummy_prefix and said.startswith(" "):
                    said = said[1:]
                listed = "".join(ids_texts) + (str(model.end) if end else "")
                out.append((sum(sizes) + end, listed.rstrip(" "), said))
                if arrays:
                    for into, part, last in zip(lists, model.spans(sizes, own, odd, starts, text), (model.end, len(text), len(text)), strict=True):
                        into += [part, np.array([last] * end, np.int32)]
            made = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64(), pa.string(), pa.string()], strict=True)]
            if arrays:
                ends = pa.array(np.cumsum([0, *(n for n, _, _ in out)]), pa.int32())
                made += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int32())) for x in lists]
            yield pa.RecordBatch.from_arrays([rows.column("id"), *made], names=names)

    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_text string, decoded string" + ", ids array<int>, starts array<int>, ends array<int>" * arrays
    names = ["id", "n_tokens", "ids_text", "decoded", *["ids", "starts", "ends"] * arrays]
    return chosen.mapInArrow(work, schema).withColumnRenamed("id", id_column)


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    digests = [F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    return coded.select("doc_id", "n_tokens", *digests, F.xxhash64("starts", "ends").alias("spans_xxhash64"))
