"""Token ids as length-delimited binary records (operator 12).

A record file is a sequence of frames, in ascending order of document id over
all files (``part`` orders the files):

    8 bytes  length of the payload, little endian
    4 bytes  masked crc32 of those 8 bytes
    payload  1 byte: is there an id; 8 bytes: the id; 1 byte: bytes per token; the token ids
    4 bytes  masked crc32 of the payload

A separate Parquet index (``<path>/index``) has a row for each record: file,
offset, length, doc_id, n_tokens and start (tokens of all documents before it), so
that records can be read in any order. The index is written by Spark's commit
protocol and names the files that count; a file of a failed or repeated attempt
has a name of its own and is in no index.

Encoding: the tokenizer's pre-tokens never reach over a blank or a line feed, and
its normaliser never joins characters over one, so a text's ids are those of its
blank-separated pieces in order; each distinct piece of a block is encoded once at most.

Defined results: null and empty texts have the end id only; rows come in the order
of id (null first), then text hash; rows equal in both are interchangeable and are all
written; texts of any length are encoded whole; an empty table gives no file, an
empty index and an empty result; other columns are never read. A damaged file ends
the read with an error that names the file and the offset.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hand_off
from .textnum import blocks, strings

HEAD, TAIL, ENTRY = "<QI", "<I", "<?qB"   # length and its checksum; checksum; is there an id, the id, bytes per token
MEMO_PIECES, MEMO_IDS = 1 << 18, 1 << 23   # encoded pieces, and ids of them, after which a worker starts its memo anew
SIMPLE = "[a-zß-öø-ÿ]+"
CLOSING = "([A-Za-zß-öø-ÿ])([.,;:!?]+) "   # a letter and closing punctuation before a blank
END_ID = 1
BLOCK_CHARS = 1 << 22


def masked(data: bytes) -> int:
    """crc32, rotated and shifted, so that a checksum of bytes that hold checksums stays a good one."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


class Encoder:
    """The library's tokenizer behind a memo of pieces. A text's pieces are parted by blanks and
    line feeds, and by the end of a letter before closing punctuation, where pre-tokens end too."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        # a run of these letters is one pre-token that the normaliser leaves as it is, so it goes
        # to the model at once, in the letters that the library itself writes its bytes in
        letters = [chr(c) for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
        self.letters = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters})
        self.reset()

    def reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of pieces (into start and size), new ones encoded."""
        out = np.fromiter(map(self.memo.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        known, letters, tokenize = len(self.memo), self.letters, self.model.tokenize
        texts = [words[i] for i in new.tolist()]
        plain = np.fromiter(map(bool, map(re.compile(SIMPLE).fullmatch, texts)), bool, len(texts))
        ids: list = [[t.id for t in tokenize(w.translate(letters))] if p else None for w, p in zip(texts, plain.tolist())]
        other = np.flatnonzero(~plain).tolist()
        for i, e in zip(other, self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False) if other else ()):
            ids[i] = e.ids
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum()))])
        out[new] = known + np.arange(len(new))
        self.memo.update(zip(texts, range(known, known + len(new))))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text, as the library gives them without special tokens."""
        if len(self.memo) > MEMO_PIECES or len(self.flat) > MEMO_IDS:
            self.reset()
        column = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " ")
        # a special token's name is matched before the normaliser folds capitals
        column = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
        parts = pc.split_pattern(pc.replace_substring_regex(column, CLOSING, r"\1 \2 "), " ")
        words = parts.flatten().dictionary_encode()
        at = self._numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy(zero_copy_only=False)]
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return [ids[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:])]


def encoder(path: str) -> Encoder:
    """One for each worker process. Functions of this package are pickled by value, so module
    globals start afresh with every task; the library's module stays."""
    import tokenizers
    kept = tokenizers.__dict__.setdefault("_encoders_of_this_worker", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    body = struct.pack(ENTRY, doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(body))
    return length + struct.pack(TAIL, masked(length)) + body + struct.pack(TAIL, masked(body))


def read_frame(stream, where: str) -> tuple[int, int | None, np.ndarray] | None:
    """(bytes read, doc_id, ids as unsigned 32 bit) of the next frame; None at the end of the file."""
    n_head, n_tail, n_entry = map(struct.calcsize, (HEAD, TAIL, ENTRY))
    head = stream.read(n_head)
    if not head:
        return None
    if len(head) < n_head or masked(head[:8]) != struct.unpack(HEAD, head)[1]:
        raise ValueError(f"{where}: damaged length of a record")
    length = struct.unpack(HEAD, head)[0]
    body, tail = stream.read(length), stream.read(n_tail)
    if len(body) < length or len(tail) < n_tail or masked(body) != struct.unpack(TAIL, tail)[0]:
        raise ValueError(f"{where}: damaged record")
    given, doc_id, width = struct.unpack_from(ENTRY, body)
    return n_head + length + n_tail, doc_id if given else None, np.frombuffer(body, f"<u{width}", offset=n_entry).astype("<u4")


def _store(path: str):
    """File system and path within it; local paths stand as given, or with ``file:``."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


STAGED = "part int, file string, doc_id bigint, offset bigint, length bigint, n_tokens bigint, before bigint"


def _writer(path: str, tokenizer: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.rec"
        enc, out, offset, before = encoder(tokenizer), None, 0, 0
        try:
            for batch in batches:
                doc_ids, texts = batch["doc_id"].to_pylist(), strings(batch["text"])
                for lo, hi in blocks(texts, BLOCK_CHARS):
                    if out is None:
                        store, folder = _store(path)
                        store.create_dir(folder, recursive=True)
                        out = store.open_output_stream(f"{folder}/{name}", buffer_size=1 << 20)
                    rows = []
                    for doc_id, ids in zip(doc_ids[lo:hi], enc.encode(texts[lo:hi])):
                        data = frame(doc_id, np.append(ids, np.uint32(end_id)), enc.width)
                        out.write(data)
                        rows.append((part, name, doc_id, offset, len(data), len(ids) + 1, before))
                        offset, before = offset + len(data), before + len(ids) + 1
                    yield pa.RecordBatch.from_pydict(
                        {n.split()[0]: pa.array(c, pa.string() if n.endswith("string") else pa.int32() if n.endswith(" int") else pa.int64())
                         for n, c in zip(STAGED.split(", "), zip(*rows))})
        finally:
            if out is not None:
                out.close()
    return run


def _with_start(rows: DataFrame) -> DataFrame:
    """start: ``before`` (tokens of the same file before the record) and the tokens of all earlier files."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("t")) \
        .select("part", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("base"))
    # one row for each file
    return rows.join(F.broadcast(files), "part").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def write_records(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of every row, each with ``end_id``, below ``path`` (a folder that the
    driver and all executors reach); returns the index as read back."""
    row = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").select(
        "*", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "th", "row"]  # the last two split a hot id
    placed = row.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    staged = hand_off(placed.mapInArrow(_writer(f"{path}/records", tokenizer, end_id), STAGED), "records-staged")
    _with_start(staged).write.parquet(f"{path}/index")
    return docs.sparkSession.read.parquet(f"{path}/index")


DIGEST = "part int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"
FULL = "doc_id bigint, ids array<bigint>"


def _scan(path: str):
    """Frame after frame of whole files, without their index rows."""
    def run(batches):
        store, folder = _store(path)
        for batch in batches:
            for part, name in zip(batch["part"].to_pylist(), batch["file"].to_pylist()):
                at = before = 0
                rows = []
                with store.open_input_stream(f"{folder}/{name}", buffer_size=1 << 20) as stream:
                    while (got := read_frame(stream, f"{name} at {at}")) is not None:
                        size, doc_id, ids = got
                        rows.append((part, doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
                        at, before = at + size, before + len(ids)
                        if len(rows) == 4096:
                            yield _digest_batch(rows)
                            rows = []
                if rows:
                    yield _digest_batch(rows)
    return run


def _digest_batch(rows) -> pa.RecordBatch:
    part, doc_id, before, n, crc = zip(*rows)
    return pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "doc_id": pa.array(doc_id, pa.int64()),
                                       "before": pa.array(before, pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                                       "ids_crc32": pa.array(crc, pa.int64())})


def _tasks(spark: SparkSession) -> int:
    """Tasks that read files: a given number, as adaptive execution sees only the short index
    rows and would put all files into one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32 bit) of
    every record, from the files themselves; the index only tells which files count."""
    files = spark.read.parquet(f"{path}/index").select("part", "file").distinct().repartition(_tasks(spark), "part")
    rows = hand_off(files.mapInArrow(_scan(f"{path}/records"), DIGEST), "records-read")
    return _with_start(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def _seek(path: str):
    def run(batches):
        store, folder = _store(path)
        files: dict = {}
        for batch in batches:
            doc_ids, ids = [], []
            for name, offset in zip(batch["file"].to_pylist(), batch["offset"].to_pylist()):
                if name not in files:
                    if len(files) == 64:
                        files.pop(next(iter(files))).close()
                    files[name] = store.open_input_file(f"{folder}/{name}")
                files[name].seek(offset)
                got = read_frame(files[name], f"{name} at {offset}")
                if got is None:
                    raise ValueError(f"{name} at {offset}: no record")
                doc_ids.append(got[1])
                ids.append(got[2].astype(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64()))})
        for f in files.values():
            f.close()
    return run


def read_shuffled(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """doc_id and ids of every record, in an order drawn by ``seed``: the index is
    shuffled, and each record is then read at its offset."""
    index = spark.read.parquet(f"{path}/index").select("file", "offset")
    drawn = index.withColumn("r", F.xxhash64(F.lit(seed), "file", "offset")).repartitionByRange(_tasks(spark), "r").sortWithinPartitions("r")
    return drawn.select("file", "offset").mapInArrow(_seek(f"{path}/records"), FULL)
