"""Phrase collocation mining by SON partitioning (operator 11).

Texts (A-Z lower-cased) are split into pieces at [.,;:!?\\x0A-\\x0D] and those into
words [^\\x20\\x09]+; everything is counted for each language. A phrase that occurs
``support`` times in the corpus occurs ceil(support / shards) times in one of its
shards at least, whatever their sizes. So each shard is mined completely at that
local support, the locally frequent phrases of all shards are united, and one more
pass counts the united candidates over the whole corpus, exactly and by their text.

Counts go to Spark not as a row for each phrase but as arrays, one row for each bucket of
hashes, and are added up in numpy, a few buckets at a time.

Mining works on 64-bit hashes, a level at a time: a phrase is looked at only if its
words (then, for three words, both pairs) passed the level before. Filters between
passes are bitmaps whose size follows the number of candidates up to a fixed limit; a
fuller one lets more phrases through to the exact count and loses none. Equal hashes
of different phrases can only add candidates.

Defined results: null and empty texts have no words; a null language is ``und``; each
row counts, repeated ones too; equal scores are ordered by count, then by the
phrase in byte order; an empty table gives an empty result; other columns are never
read; texts of any length are read whole.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import numpy_bitmap, numpy_test
from .common import hand_off
from .textnum import _BASE2, Block, blocks, mix, prefix, runs, span_hash, strings

SUPPORT, SHARDS, LONGEST, TOP = 10, 3, 3, 2000
INSIDE_PERCENT = 50            # a longer phrase this frequent (of the shorter one) makes the shorter one go
BLOCK_CHARS = 1 << 21
HELD_KEYS = 1 << 21            # keys that a task gathers before it sends them
MERGED_BYTES = 1 << 25         # of buckets that are added up together; a larger one is by itself
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 27
HELD_PHRASES = 1 << 20         # phrases of blocks, likewise
_MIXED = mix(np.arange(1, (1 << 11) + 1, dtype=np.uint64))
_SEP = np.zeros(128, bool)
_SEP[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True


def _char_values(cp: np.ndarray) -> np.ndarray:
    """mix(cp + 1), from a table for most characters."""
    out = _MIXED[np.minimum(cp, len(_MIXED) - 1)]
    if len(rare := np.flatnonzero(cp >= len(_MIXED))):
        out[rare] = mix(cp[rare].astype(np.uint64) + np.uint64(1))
    return out


class Words:
    """The words of a block of whole texts: code point spans, 64-bit hashes with the language
    in them, and which neighbours stand in one piece."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.block = b = Block([t + "\n" for t in texts], fold=True)
        sep = _SEP[np.minimum(b.cp, 127)] & (b.cp < 128)
        self.start, self.end = runs(~sep & (b.cp != 32) & (b.cp != 9))
        piece = np.cumsum(sep, dtype=np.int32)[self.start] if len(self.start) else np.zeros(0, np.int32)
        self.doc = b.doc_of(self.start)
        names = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
        self.names = list(names)
        self.lang = np.fromiter((names[x] for x in langs), np.int32, len(langs))[self.doc]
        pre = Block([" ".join(self.names)]).char_prefix() if self.names else None
        ends = np.cumsum([len(x) + 1 for x in self.names]) - 1 if self.names else np.zeros(0, np.int64)
        code = span_hash(pre, ends - [len(x) for x in self.names], ends) if self.names else np.zeros(0, np.uint64)
        self.code, self.other, self.stream = code, None, None
        self.values = _char_values(b.cp)
        self.hash = mix(span_hash(prefix(self.values), self.start, self.end) ^ code[self.lang])
        self.same = piece[1:] == piece[:-1]  # word i and i + 1 in one piece
        self.pre = prefix(self.hash, _BASE2)

    def grams(self, n: int) -> np.ndarray:
        """Starts of the phrases of n words."""
        if n == 1:
            return np.arange(len(self.start))
        ok = self.same[: len(self.same) - n + 2].copy()
        for i in range(1, n - 1):
            ok &= self.same[i: len(self.same) - n + 2 + i]
        return np.flatnonzero(ok)

    def key(self, at: np.ndarray, n: int) -> np.ndarray:
        return span_hash(self.pre, at, at + n, _BASE2)

    def second(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the same phrases by other bases, from the characters on."""
        if self.other is None:
            chars = prefix(self.values, _BASE2)
            self.other = prefix(span_hash(chars, self.start, self.end, _BASE2) ^ mix(self.code + np.uint64(1))[self.lang])
        return span_hash(self.other, at, at + n)

    def phrases(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the phrases, a blank between words, and the length of each: slices of the bytes of all words in order."""
        if self.stream is None:
            inside = np.zeros(len(self.block.cp) + 1, np.int8)
            inside[self.start] += 1
            inside[self.end] -= 1
            keep = np.cumsum(inside[:-1]).astype(bool)
            cp = self.block.cp.copy()
            cp[self.end] = 32  # the character after a word, which is none of a word
            keep[self.end] = True
            cp = cp[keep]
            width = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
            length = self.end - self.start + 1
            ends = np.cumsum(width)[np.cumsum(length) - 1] if len(length) else np.zeros(0, np.int64)
            data = cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            self.stream = np.frombuffer(data, np.uint8), np.concatenate([[0], ends])
        data, bounds = self.stream
        size = bounds[at + n] - 1 - bounds[at]
        ends = np.cumsum(size)
        return data[np.repeat(bounds[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size

    def frequent(self, at: np.ndarray, n: int, words: np.ndarray, pairs: np.ndarray | None) -> np.ndarray:
        """Those of ``at`` whose words, and pairs of neighbours, are in the bitmaps."""
        known = numpy_test(words, self.key(np.arange(len(self.start)), 1)) if len(self.start) else np.zeros(0, bool)
        for i in range(n):
            at = at[known[at + i]]
        for i in range(n - 1 if pairs is not None else 0):
            at = at[numpy_test(pairs, self.key(at + i, 2))]
        return at


def _read(batch):
    texts, langs = strings(batch["text"]), batch["lang"].to_pylist()
    for lo, hi in blocks(texts, BLOCK_CHARS):
        yield lo, hi, Words(texts[lo:hi], langs[lo:hi])


def _unique(key: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A position and the count of each distinct key (of each distinct pair with ``other``)."""
    order = np.argsort(key)
    differs = key[order][1:] != key[order][:-1]
    if other is not None and (~differs & (other[order][1:] != other[order][:-1])).any():
        order = np.lexsort((other, key))
        differs = (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1])
    first = np.flatnonzero(np.concatenate([[True], differs])) if len(key) else np.zeros(0, np.int64)
    return order[first], np.diff(np.append(first, len(key)))


def _parts(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """values[cuts[i]:cuts[i + 1]] for each i, as binaries."""
    buffers = [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, buffers)


def _joined(parts: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(parts.to_pylist()), kind)


def _bucket_bits(docs: DataFrame) -> int:
    """Bits of a hash that say its bucket: some buckets for each shuffle partition."""
    return (2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()


def _bucket(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int32)


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows equal in all columns begin, and the end."""
    size = len(columns[0])
    differs = np.zeros(max(size - 1, 0), bool)
    for x in columns:
        differs |= x[1:] != x[:-1]
    return np.concatenate([[0], np.flatnonzero(differs) + 1, [size]]) if size else np.zeros(1, np.int64)


def _whole_buckets(batches):
    """Tables of whole buckets from the rows of a task, which come by bucket."""
    held, size, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch["bucket"].to_numpy()
        if size >= MERGED_BYTES and ids[0] != last:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        cut = _cuts(ids)[-2]  # where the last bucket begins
        if cut and size + batch.nbytes >= MERGED_BYTES:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, size, batch = [], 0, batch.slice(cut)
        held, size, last = [*held, batch], size + batch.nbytes, ids[-1]
    if held:
        yield pa.Table.from_batches(held)


def _merged(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the rows, dealt and sorted by bucket."""
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


class _Gathered:
    """Phrases of n words with their counts, gathered from the blocks of a task."""

    def __init__(self, n: int, bits: int):
        self.n, self.bits, self.size, self.langs, self.held = n, bits, 0, {}, []

    def add(self, w: Words, at: np.ndarray) -> None:
        key = w.key(at, self.n)
        # a second hash of other bases, so that two phrases never count as one
        other = w.second(at, self.n)
        first, c = _unique(key, other)
        code = np.array([self.langs.setdefault(x, len(self.langs)) for x in w.names], np.int32)
        self.held.append((key[first], other[first], c, code[w.lang[at[first]]], *w.phrases(at[first], self.n)))
        self.size += len(first)

    def packed(self):
        """A row for each language and bucket, which holds arrays of the lengths in bytes, counts and hashes and the joined texts."""
        if not self.size:
            return
        key, other, c, lang, text, size = (np.concatenate(x) for x in zip(*self.held, strict=True))
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        order = np.argsort(key)
        if (same := key[order][1:] == key[order][:-1]).any() and (same & (other[order][1:] != other[order][:-1])).any():
            order = np.lexsort((other, key))
        cuts = _cuts(key[order], other[order])
        c, i = np.add.reduceat(c[order], cuts[:-1]), order[cuts[:-1]]
        by_lang = np.argsort(lang[i].astype(np.uint16 if len(self.langs) < 1 << 16 else np.int32), kind="stable")
        c, i = c[by_lang], i[by_lang]
        key, lang, size, bucket = key[i], lang[i], size[i], _bucket(key[i], self.bits)
        cuts = _cuts(lang, bucket)
        texts = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(text)).take(pa.array(i))
        text = np.frombuffer(texts.buffers()[2], np.uint8)
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(bucket[cuts[:-1]]), "lang": pa.array(list(self.langs), pa.string()).take(pa.array(lang[cuts[:-1]])),
            "n": pa.array(np.full(len(cuts) - 1, self.n, np.int32)), "phrase": _parts(text, np.concatenate([[0], np.cumsum(size)])[cuts]),
            "size": _parts(size.astype(np.uint32), cuts), "c": _parts(c.astype(np.uint32), cuts), "h": _parts(key, cuts)})
        self.size, self.langs, self.held = 0, {}, []


def _counted(n_range, words, phrases, bits: int):
    """Rows of ``_Gathered``: phrases with their counts in some blocks."""
    def run(batches):
        gathered = [_Gathered(n, bits) for n in n_range]
        for batch in batches:
            for _, _, w in _read(batch):
                for g in gathered:
                    at = w.grams(g.n)
                    if words is not None:
                        at = w.frequent(at, g.n, words, None)
                        at = at[numpy_test(phrases, w.key(at, g.n))]
                    g.add(w, at)
                    if g.size >= HELD_PHRASES:
                        yield from g.packed()
        for g in gathered:
            yield from g.packed()
    return run


PACKED = "bucket int, lang string, n int, phrase binary, size binary, c binary, h binary"
COUNTED = "lang string, n int, phrase string, c bigint, h bigint"


def _summed(support: int):
    """(lang, n, phrase, c, h): phrases by their text with their counts, of ``support`` or more; the
    counts of the others come as a sum for each language and length, without a phrase."""
    def run(batches):
        for t in _whole_buckets(batches):
            size, h = _joined(t["size"], np.uint32), _joined(t["h"], np.int64)
            c = _joined(t["c"], np.uint32).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            text = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(_joined(t["phrase"], np.uint8)))
            of = {}
            kind = np.fromiter((of.setdefault(k, len(of)) for k in zip(t["lang"].to_pylist(), t["n"].to_pylist(), strict=True)), np.int32, t.num_rows)
            kind = np.repeat(kind, pc.binary_length(t["size"]).to_numpy() // 4)

            order = np.argsort(h)
            cuts = _cuts(h[order])
            in_order = text.take(pa.array(order))
            alike = pc.equal(in_order.slice(1), in_order.slice(0, len(h) - 1)).to_numpy(zero_copy_only=False) & (kind[order][1:] == kind[order][:-1])
            if (~alike & (h[order][1:] == h[order][:-1])).any():  # equal hashes of different phrases: by their texts
                g = pa.table({"kind": kind, "phrase": text, "c": c, "h": h}).group_by(["kind", "phrase"], use_threads=False).aggregate([("c", "sum"), ("h", "min")])
                kind, text, c, h = g["kind"].to_numpy(), g["phrase"].combine_chunks(), g["c_sum"].to_numpy(), g["h_min"].to_numpy()
                first = np.arange(len(c))
            else:
                c, first = np.add.reduceat(c[order], cuts[:-1]), order[cuts[:-1]]

            enough, rare = first[c >= support], first[c < support]
            rest = np.zeros(len(of), np.int64)
            np.add.at(rest, kind[rare], c[c < support])
            others = np.flatnonzero(rest)
            langs, lengths = zip(*of, strict=True)
            at = np.concatenate([kind[enough], others])
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array(langs, pa.string()).take(pa.array(at)), "n": pa.array(np.array(lengths, np.int32)[at]),
                "phrase": pa.concat_arrays([text.take(pa.array(enough)).cast(pa.string()), pa.nulls(len(others), pa.string())]),
                "c": pa.array(np.concatenate([c[c >= support], rest[others]])),
                "h": pa.concat_arrays([pa.array(h[enough]), pa.nulls(len(others), pa.int64())])})
    return run


def _mined(n: int, words, pairs, local: int, bits: int):
    """(bucket, shard, keys): arrays of phrases of n words that may be frequent, each as often as it
    occurs in the texts gathered, but ``local`` times at most."""
    def packed(held):
        for s, parts in held.items():
            key = np.sort(np.concatenate(parts))
            enough = np.ones(len(key), bool)
            enough[local:] = key[local:] != key[:-local]
            key = key[enough]
            cuts = _cuts(_bucket(key, bits))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(_bucket(key[cuts[:-1]], bits)),
                                              "shard": pa.array(np.full(len(cuts) - 1, s, np.int32)), "keys": _parts(key, cuts)})

    def run(batches):
        held, size = defaultdict(list), 0
        for batch in batches:
            shard_of = batch["shard"].to_numpy()
            for lo, hi, w in _read(batch):
                at = w.frequent(w.grams(n), n, words, pairs)
                key, shard = w.key(at, n), shard_of[lo:hi][w.doc[at]]
                for s in np.unique(shard):
                    held[s].append(key[shard == s])
                size += len(key)
                if size >= HELD_KEYS:
                    yield from packed(held)
                    held, size = defaultdict(list), 0
        yield from packed(held)
    return run


def _frequent(local: int):
    """h: the keys that a shard has ``local`` times or more, each once."""
    def run(batches):
        for t in _whole_buckets(batches):
            shard, found = t["shard"].to_numpy(), []
            for s in np.unique(shard):
                key = np.sort(_joined(t["keys"].filter(pa.array(shard == s)), np.uint64))
                first = key[: max(len(key) - local + 1, 0)]
                found.append(first[first == key[local - 1:]])
            yield pa.RecordBatch.from_pydict({"h": pa.array(np.unique(np.concatenate(found)).view(np.int64))})
    return run


def _filter(keys: DataFrame) -> np.ndarray:
    """A bitmap of the column h; its size follows the number of keys, up to MOST_CELLS bits."""
    cells = 1 << max(keys.count() * 16, 1).bit_length()
    return numpy_bitmap(keys, "h", min(max(cells, LEAST_CELLS), MOST_CELLS))


def phrase_counts(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, longest: int = LONGEST):
    """(counts, totals): lang, n, phrase, c of every phrase of up to ``longest`` words with c of
    ``support`` or more; lang and words (all word occurrences)."""
    if not 1 <= longest <= 3:
        raise ValueError("phrases of one to three words")
    text = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text",
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"))
    local, bits = -(-support // shards), _bucket_bits(docs)

    def counted(n_range, words, phrases, name):
        rows = text.select("lang", "text").mapInArrow(_counted(n_range, words, phrases, bits), PACKED)
        return hand_off(_merged(rows, _summed(support), COUNTED), name)

    by = ["lang", "n", "phrase"]
    single = counted([1], None, None, "words")
    totals = single.groupBy("lang").agg(F.sum("c").alias("words"))
    counts = single.where("phrase is not null")
    words, pairs, united = _filter(counts), None, None
    for n in range(2, longest + 1):
        mined = text.mapInArrow(_mined(n, words, pairs, local, bits), "bucket int, shard int, keys binary")
        mined = hand_off(_merged(mined, _frequent(local), "h bigint"), f"mined-{n}")
        pairs = _filter(mined) if n == 2 else pairs
        united = mined if united is None else united.unionByName(mined)
    if united is not None:
        rows = counted(range(2, longest + 1), words, _filter(united), "phrases").where("phrase is not null")
        return counts.select(*by, "c").unionByName(rows.select(*by, "c")), totals
    return counts.select(*by, "c"), totals


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) in decimals of up to 38 digits (counts below 10**15)."""
    a, l, r = (x.cast("decimal(15,0)") for x in (a, l, r))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), l * r)


def collocations(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    counts, totals = phrase_counts(docs, support, shards)
    phrases = counts.where("n > 1")
    words = F.split("phrase", " ")
    cut = phrases.select("lang", "phrase", F.col("n").alias("m"), F.col("c").alias("a"),
                         F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cut = cut.select("*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"),
                     F.array_join(F.slice(words, F.col("k") + 1, F.col("m")), " ").alias("rest"))
    part = counts.select("lang", F.col("phrase").alias("part"), "c")
    left = part.select("lang", F.col("part").alias("first"), F.col("c").alias("l"))
    right = part.select("lang", F.col("part").alias("rest"), F.col("c").alias("r"))
    scored = (cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
              .withColumn("score", _score(F.col("a"), F.col("l"), F.col("r"))))
    best = scored.groupBy("lang", "phrase", "m", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")) \
        .select("lang", "phrase", "m", "a", "b.l", "b.r", "b.score")

    # longer phrases: every pair inside a candidate of three words
    inner = phrases.where("n = 3").select("lang", "c", F.explode(F.array(
        F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))).alias("phrase"))
    covering = inner.groupBy("lang", "phrase").agg(F.max("c").alias("longer"))
    left_over = (best.join(covering, ["lang", "phrase"], "left")
                 .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * INSIDE_PERCENT)))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = left_over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                              F.col("words").alias("n"), "score")
