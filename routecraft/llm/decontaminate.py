"""Benchmark decontamination by a distributed positional inverted index (operator 9).

1. Test windows: every run of ``WINDOW`` consecutive words of an item (the whole
   item if it has fewer), with the hash of each term.
2. Term counts over the whole corpus tell each window's rarest terms; a window
   with a term that the corpus never has cannot occur and goes.
3. The index stores the postings (term, document, position) of the terms that
   any window is looked up by, as a table in the shared folder.
4. A document's lists of a window's rarest terms, each moved back by the term's
   offset, are intersected: equal starts give candidate phrases, starts within
   ``SLOP`` words give proximity matches.
5. Candidate phrases are verified on the document's own words, all of them.

Between the passes only bitmaps of a fixed size reach the tasks; everything
that grows with benchmark or corpus is joined by key. A hot term or passage
only adds rows that are spread by (document, window).

Defined results: null or empty texts have no words and no hits; an item without
words or without id is skipped; equal items count by their ids; rows equal in id
and text get equal results, rows that share an id only are judged apart; empty
tables give empty results or no hits; other columns are never read. Any length
is read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import numpy_bitmap, numpy_test
from .common import fresh, hand_off, row_key, settled
from .textnum import _BASE2, Block, blocks, ngrams, prefix, span_hash, strings

WINDOW = 10
PIVOTS = 2        # rarest terms of a window that are looked up in the index (two lists are intersected)
SLOP = 3          # words by which the looked-up terms may be off in a proximity match
VOCAB_CELLS = 1 << 22


def _terms(texts: list[str]):
    """A block's words: hash, document, and the first word's number of each document."""
    b = Block(texts, fold=True)
    starts, ends = b.alnum_words()
    return span_hash(b.char_prefix(), starts, ends), b.doc_of(starts), b.n


def _windows(batches):
    for batch in batches:
        for item, text in zip(batch["item_id"].to_pylist(), strings(batch["text"])):
            term, doc, _ = _terms([text])
            if item is None or not len(term):
                continue
            n = min(WINDOW, len(term))
            at, h = ngrams(term, doc, n)
            yield pa.RecordBatch.from_pydict({
                "win": h.view(np.int64), "len": np.full(len(h), n, np.int32),
                "item": pa.array([str(item)] * len(h)),
                "terms": pa.array([term[i:i + n].view(np.int64) for i in at], pa.list_(pa.int64()))})


def test_windows(benchmark: DataFrame) -> DataFrame:
    """win (hash of its words), len, item (id as text), terms: one row per window of each item."""
    return benchmark.select("item_id", "text").mapInArrow(
        _windows, "win bigint, len int, item string, terms array<bigint>")


def _count_pass(bitmap):
    def run(batches):
        for batch in batches:
            texts = strings(batch["text"])
            for lo, hi in blocks(texts):
                term, _, _ = _terms(texts[lo:hi])
                u, n = np.unique(term[numpy_test(bitmap, term)], return_counts=True)
                yield pa.RecordBatch.from_pydict({"term": u.view(np.int64), "n": n.astype(np.int64)})
    return run


def _postings_pass(bitmap):
    def run(batches):
        for batch in batches:
            texts, keys = strings(batch["text"]), batch["_key"].to_numpy()
            for lo, hi in blocks(texts):
                term, doc, n = _terms(texts[lo:hi])
                hit = np.flatnonzero(numpy_test(bitmap, term))
                first = np.searchsorted(doc, np.arange(n))
                yield pa.RecordBatch.from_pydict({
                    "term": term[hit].view(np.int64), "key": keys[lo:hi][doc[hit]],
                    "pos": (hit - first[doc[hit]]).astype(np.int32)})
    return run


def _verify(text: pa.Array, cand: pa.Array) -> pa.Array:
    """n_words, n_hit and the verified windows of each document."""
    texts, cands = strings(text), cand.to_pylist()
    n_words, n_hit, found = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
    for lo, hi in blocks(texts):
        term, doc, n = _terms(texts[lo:hi])
        count = np.bincount(doc, minlength=n)
        n_words[lo:hi] = count
        first = np.cumsum(count) - count
        rows = [(i, c["start"], c["len"], c["win"]) for i in range(n) for c in cands[lo + i] or ()]
        found.extend([] for _ in range(n))
        if not rows:
            continue
        of, start, size, win = (np.array(x, np.int64) for x in zip(*rows))
        ok = (start >= 0) & (start + size <= count[of])
        of, start, size, win = (x[ok] for x in (of, start, size, win))
        a = first[of] + start
        ok = span_hash(prefix(term, _BASE2), a, a + size, _BASE2).view(np.int64) == win
        change = np.zeros(len(term) + 1, np.int64)
        np.add.at(change, a[ok], 1)
        np.add.at(change, (a + size)[ok], -1)
        n_hit[lo:hi] = np.bincount(doc[np.cumsum(change[:-1]) > 0], minlength=n)
        for i, w in set(zip(of[ok].tolist(), win[ok].tolist())):
            found[lo + i].append(w)
    return pa.StructArray.from_arrays(
        [pa.array(n_words), pa.array(n_hit), pa.array(found, pa.list_(pa.int64()))], ["n_words", "n_hit", "wins"])


def build_index(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, pivots): the stored positional index and what each window is looked
    up by (win, len, term, offset, rank, n_pivots)."""
    text = docs.select("text")
    uses = windows.select("win", "len", F.posexplode("terms").alias("offset", "term")).distinct()
    seen = (text.mapInArrow(_count_pass(numpy_bitmap(uses, "term", VOCAB_CELLS)), "term bigint, n bigint")
            .groupBy("term").agg(F.sum("n").alias("n")))
    # per window a sorted array of its terms by rarity; a window has at most WINDOW of them
    ranked = (uses.join(seen, "term")
              .groupBy("win", "len").agg(F.array_sort(F.collect_list(F.struct("n", "term", "offset"))).alias("t"))
              .where(F.size("t") == F.col("len")))
    pivots = hand_off(ranked.select(
        "win", "len", F.least(F.lit(PIVOTS), F.col("len")).alias("n_pivots"),
        F.posexplode(F.slice("t", 1, PIVOTS)).alias("rank", "p")).select(
        "win", "len", "n_pivots", "rank", "p.term", "p.offset"), "decontaminate-pivots")
    bitmap = numpy_bitmap(pivots, "term", VOCAB_CELLS)
    postings = hand_off(docs.select(row_key().alias("_key"), "text").mapInArrow(
        _postings_pass(bitmap), "term bigint, key bigint, pos int"), "decontaminate-postings")
    return postings, pivots


def lookup(postings: DataFrame, pivots: DataFrame) -> DataFrame:
    """key, win, len, starts, near: the documents that have all looked-up terms of a
    window, with the starts at which their moved lists meet (candidate phrases) and
    whether they come within ``SLOP`` words. The lists are those of one document."""
    moved = (postings.join(pivots, "term")
             .select("key", "win", "len", "n_pivots", "rank", (F.col("pos") - F.col("offset")).alias("start")))
    lists = (moved.groupBy("key", "win", "len", "n_pivots")
             .agg(*[F.collect_list(F.when(F.col("rank") == r, F.col("start"))).alias(f"s{r}") for r in range(PIVOTS)])
             .where((F.size("s0") > 0) & ((F.col("n_pivots") == 1) | (F.size("s1") > 0))))
    widened = F.flatten(F.transform("s1", lambda s: F.sequence(s - SLOP, s + SLOP)))
    return lists.select(
        "key", "win", "len",
        F.when(F.col("n_pivots") == 1, F.array_distinct("s0")).otherwise(F.array_intersect("s0", "s1")).alias("starts"),
        ((F.col("n_pivots") > 1) & F.arrays_overlap("s0", widened)).alias("near")).where((F.size("starts") > 0) | F.col("near"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, _key, n_words, n_hit, items and near_items (sorted ids as text) of every row;
    near_items have a proximity match only."""
    windows = hand_off(test_windows(benchmark), "decontaminate-windows")
    postings, pivots = build_index(docs, windows)
    matches = hand_off(lookup(postings, pivots), "decontaminate-matches")
    per_doc = (matches.select("key", "win", "len", F.explode("starts").alias("start")).groupBy("key")
               .agg(F.collect_list(F.struct("start", "len", "win")).alias("cand")))
    checked = (docs.select("doc_id", "text", row_key().alias("_key"))
               .join(per_doc.withColumnRenamed("key", "_key"), "_key", "left")
               .select("doc_id", "_key", F.arrow_udf(_verify, "struct<n_words: bigint, n_hit: bigint, wins: array<bigint>>")(
                   "text", "cand").alias("r"))
               .select("doc_id", "_key", "r.*"))
    checked = hand_off(checked, "decontaminate-checked")
    of_win = windows.select("win", "item").distinct()
    exact = (checked.where(F.size("wins") > 0).select(F.col("_key").alias("key"), F.explode("wins").alias("win")).distinct()
             .withColumn("phrase", F.lit(True)))
    near = matches.where("near").select("key", "win").withColumn("phrase", F.lit(False))
    items = (exact.unionByName(near).join(of_win, "win")
             .groupBy("key", "item").agg(F.max("phrase").alias("phrase"))
             .groupBy("key").agg(
                 F.array_sort(F.collect_list(F.when(F.col("phrase"), F.col("item")))).alias("items"),
                 F.array_sort(F.collect_list(F.when(~F.col("phrase"), F.col("item")))).alias("near_items")))
    none = F.array().cast("array<string>")
    return (checked.drop("wins").join(items.withColumnRenamed("key", "_key"), "_key", "left")
            .select("doc_id", "_key", "n_words", "n_hit", F.coalesce("items", none).alias("items"),
                    F.coalesce("near_items", none).alias("near_items")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in which no window of the benchmark occurs, with their columns as they are."""
    hit = settled(docs.sparkSession, lambda: decontaminate(docs, benchmark).where("n_hit > 0").select("_key").distinct(), "decontaminate-hit")
    tmp = fresh(docs, "_key")
    return (docs.withColumn(tmp, row_key())
            .join(hit.withColumnRenamed("_key", tmp), tmp, "left_anti").drop(tmp).select(*docs.columns))
