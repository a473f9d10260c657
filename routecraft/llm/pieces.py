"""Offset-preserving SentencePiece encoding and decoding (operator 8).

The normaliser is read from the model: the longest prefix found in its compiled
character map is replaced, blanks become the word mark, and every byte of the
normalised text records the byte of the original that it came from. The pieces
of the library's model partition the normalised text, so each one projects to
a span of original bytes through that record.

Defined results: null counts as empty; an empty text has no ids, decodes to an
empty text and covers no bytes; rows are encoded one by one, so ties and
repeated rows get equal results; an empty table gives an empty result; other
columns are never read; texts of any length are encoded whole.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textnum import blocks, strings

MARK = "▁"
BATCH_CHARS = 1 << 20   # texts that the library gets at once
RESULT = "struct<ids: array<int>, begins: array<int>, ends: array<int>, decoded: string>"


class CharMap:
    """The compiled character map: a double-array trie over bytes, then the replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4) if size else np.zeros(0, np.uint32)
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes | None]:
        """(length, replacement) of the longest key that ``data`` has at ``at``."""
        found, node = (0, None), 0
        if not len(self.units):
            return found
        unit = int(self.units[0])
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = int(self.units[node])
            if unit & ((1 << 31) | 0xFF) != data[i]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                value = int(self.units[node]) & ((1 << 31) - 1)
                found = (i - at + 1, self.texts[value: self.texts.index(b"\0", value)])
        return found


def _char_bytes(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Model:
    """A model file with its own normaliser next to the library's processor."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.map, self.spec = CharMap(spec.precompiled_charsmap), spec
        self.plain = not len(self.map.units) and not spec.remove_extra_whitespaces and spec.add_dummy_prefix \
            and spec.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
        # bytes of normalised text that a piece stands for; a byte piece stands for one
        self.size = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = self.sp.unk_id()

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each of them and the end, the original byte it came from."""
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            raw = np.frombuffer(data, np.uint8)
            width = np.where(raw == 32, 3, 1)
            origin = np.concatenate([np.zeros(3, np.int64), np.repeat(np.arange(len(raw)), width), [len(raw)]])
            return (" " + text).replace(" ", MARK).encode("utf-8", "surrogatepass"), origin
        out, origin, at = bytearray(), [], 0
        blank = MARK.encode() if self.spec.escape_whitespaces else b" "
        while at < len(data):
            length, new = self.map.longest(data, at)
            if not length:
                length = _char_bytes(data[at])
                new = data[at: at + length]
            for char in new.decode("utf-8", "surrogatepass"):
                piece = blank if char == " " else char.encode("utf-8", "surrogatepass")
                if char == " " and self.spec.remove_extra_whitespaces and (not out or out.endswith(blank)):
                    continue
                out += piece
                origin += [at] * len(piece)
            at += length
        while self.spec.remove_extra_whitespaces and out.endswith(blank):
            del out[-len(blank):]
            at = origin[-len(blank)]
            del origin[-len(blank):]
        if self.spec.add_dummy_prefix and out:
            out[:0], origin[:0] = blank, [origin[0]] * len(blank)
        return bytes(out), np.array([*origin, at], np.int64)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """The library's ids and the decoded text of each text."""
        ids = self.sp.encode(texts, num_threads=1)
        return [np.array(i, np.int32) for i in ids], self.sp.decode(ids, num_threads=1) if ids else []

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The original byte span of each piece."""
        normal, origin = self.normalise(text)
        size = self.size[ids]
        if (ids == self.unknown).any():  # an unknown piece has the length that the others leave; read it from the library
            size = np.array([len(p.piece.encode()) for p in self.sp.encode(text, out_type="immutable_proto").pieces], np.int64)
        ends = np.cumsum(size)
        if (ends[-1] if len(ends) else 0) != len(normal):
            raise ValueError("the pieces do not partition the normalised text")
        return origin[ends - size].astype(np.int32), origin[ends].astype(np.int32)


_MODELS: dict[str, Model] = {}


def _model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _arrays(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def encode_column(path: str):
    def run(column: pa.Array) -> pa.Array:
        model = _model(path)
        texts = strings(column)
        ids, decoded = [], []
        for lo, hi in blocks(texts, BATCH_CHARS):
            i, d = model.encode(texts[lo:hi])
            ids += i
            decoded += d
        spans = [model.spans(t, i) for t, i in zip(texts, ids)]
        return pa.StructArray.from_arrays(
            [_arrays(ids), _arrays([s[0] for s in spans]), _arrays([s[1] for s in spans]), pa.array(decoded, pa.string())],
            ["ids", "begins", "ends", "decoded"])
    return run


def encoded(text: Column, path: str) -> Column:
    """ids, begins and ends (original bytes of each piece) and the decoded text."""
    return F.arrow_udf(encode_column(path), RESULT)(text)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, begins, ends, decoded of every row."""
    return docs.select("doc_id", encoded(F.col("text"), path).alias("e")).select("doc_id", "e.*")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and covered_bytes of encoded rows."""
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("covered_bytes"))
