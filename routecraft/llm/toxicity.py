"""Toxicity by multiple-instance learning (operator 4).

A document is a bag of sentences. A sentence's score is a logistic function of
which words and four-character parts of words it has; the document's is their
noisy-or, 1 - prod(1 - p). Weights are trained on document labels alone, so that
sentence scores tell where the offending sentences are.

The model is fitted on a bounded sample of labelled rows (``MAX_POSITIVE`` and
``MAX_NEGATIVE``, by the order of a hash of the id); every row is scored whole,
block by block in numpy.

Defined results: a text without words (null, empty) has no sentences and scores
0; several labels of one id count as their largest, null labels as none; a null
id is held out; rows equal in id and text get equal scores; without any label
all scores are 0; an empty table gives an empty result; lang, source and other
columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textnum import Block, blocks, span_hash, strings

MAX_POSITIVE, MAX_NEGATIVE = 2000, 4000
CELLS = 1 << 18         # hashed words and parts
PART = 4
MIN_DOCS, MIN_LIFT = 8, 3.0  # a feature gets a weight if so many positive sample documents have it, so many times as often as negative ones
STEPS, RATE, DECAY = 200, 0.1, 1e-4
RESULT = "struct<score: double, n_sentences: int, offending: array<struct<start: int, end: int>>>"


def sentences(texts: list[str]):
    """Feature cells, each feature's sentence (numbered through the block), each
    sentence's document, and each sentence's start and end in its text."""
    b = Block(texts, fold=True)
    starts, ends = b.alnum_words()
    pre = b.char_prefix()
    stop = (b.cp == 46) | (b.cp == 33) | (b.cp == 63) | (b.cp == 10)
    doc = b.doc_of(starts)
    place = np.cumsum(stop)[starts] + doc if len(starts) else np.zeros(0, np.int64)
    new = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]])[: len(first)] - 1
    of = doc[first]
    # parts: every position of a word from which PART characters are left in it
    room = np.maximum(ends - starts - PART + 1, 0)
    word = np.repeat(np.arange(len(starts)), room)
    at = starts[word] + np.arange(len(word)) - np.repeat(np.cumsum(room) - room, room)
    hashes = np.concatenate([span_hash(pre, starts, ends), span_hash(pre, at, at + PART) ^ np.uint64(0x5851F42D4C957F2D)])
    cell = (hashes & np.uint64(CELLS - 1)).astype(np.int64)
    return cell, np.concatenate([number, number[word]]), of, starts[first] - b.start[of], ends[last] - b.start[of]


def _present(cell, number, weighted):
    """Each weighted feature once for each sentence that has it."""
    keep = weighted[cell]
    both = np.unique(number[keep] * np.int64(CELLS) + cell[keep])
    return both % CELLS, both // CELLS


def _logistic(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], label: np.ndarray, class_weight=(1.0, 1.0)) -> np.ndarray | None:
    """Word weights and the bias (last) that maximise the noisy-or likelihood of the labels,
    a text of label c counting ``class_weight[c]`` times."""
    if not len(texts) or label.min() == label.max():
        return None
    have = np.zeros((2, CELLS), np.int64)  # negative and positive documents with the feature
    for lo, hi in blocks(texts):
        cell, number, of, _, _ = sentences(texts[lo:hi])
        pair = np.unique(of[number] * np.int64(CELLS) + cell)
        for c in (0, 1):
            have[c] += np.bincount((pair % CELLS)[label[lo:hi][pair // CELLS] == c], minlength=CELLS)
    n_pos, n_neg = (label > 0).sum(), (label == 0).sum()
    known = (have[1] >= MIN_DOCS) & (have[1] * n_neg >= MIN_LIFT * n_pos * (have[0] + 1))
    cells, numbers, ofs, base_s, base_d = [], [], [], 0, 0
    for lo, hi in blocks(texts):
        cell, number, of, _, _ = sentences(texts[lo:hi])
        cell, number = _present(cell, number, known)
        cells.append(cell), numbers.append(number + base_s), ofs.append(of + base_d)
        base_s, base_d = base_s + len(of), base_d + hi - lo
    cell, number, of = map(np.concatenate, (cells, numbers, ofs))
    y, w = label.astype(np.float64), np.zeros(CELLS + 1)
    weight = np.where(y > 0, class_weight[1], class_weight[0])
    weight /= weight.mean()
    w[-1] = -2.0
    some = np.bincount(number, minlength=base_s) > 0  # a sentence without any weighted feature scores 0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        p = _logistic(np.bincount(number, w[cell], base_s) + w[-1]) * some
        none = np.exp(np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-9)), base_d))
        bag = np.maximum(1 - none, 1e-9)
        slope = p * (weight * np.where(y > 0, -none / bag, 1.0))[of]
        g = np.append(np.bincount(cell, slope[number], CELLS), slope.sum()) / base_d
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    w[:-1][~known] = 0
    return w


def score_column(w: np.ndarray | None):
    def run(column: pa.Array) -> pa.Array:
        texts = strings(column)
        score, count, spans = np.zeros(len(texts)), np.zeros(len(texts), np.int32), []
        for lo, hi in blocks(texts):
            cell, number, of, start, end = sentences(texts[lo:hi])
            spans.extend([] for _ in range(hi - lo))
            count[lo:hi] = np.bincount(of, minlength=hi - lo)
            if w is None or not len(of):
                continue
            cell, number = _present(cell, number, w[:-1] != 0)
            p = _logistic(np.bincount(number, w[cell], len(of)) + w[-1]) * (np.bincount(number, minlength=len(of)) > 0)
            none = np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-12)), hi - lo)
            score[lo:hi] = 1 - np.exp(none)
            for i in np.flatnonzero(p >= 0.5):
                spans[lo + of[i]].append({"start": int(start[i]), "end": int(end[i])})
        return pa.StructArray.from_arrays(
            [pa.array(score), pa.array(count), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            ["score", "n_sentences", "offending"])
    return run


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
             .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y")))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # the bounded sample stands for all labelled rows: each class weighs what it has in all of them
    weight = [n.get(c, 0) / max(min(n.get(c, 0), most), 1) for c, most in ((0, MAX_NEGATIVE), (1, MAX_POSITIVE))]
    order = F.xxhash64("doc_id")
    sample = (known.where("y = 1").orderBy(order).limit(MAX_POSITIVE)
              .unionByName(known.where("y = 0").orderBy(order).limit(MAX_NEGATIVE)))
    rows = (docs.select("doc_id", "text").join(sample, "doc_id").orderBy(order, "text")
            .select("text", "y").limit(MAX_POSITIVE + MAX_NEGATIVE).toArrow())
    return fit(strings(rows["text"]), rows["y"].to_numpy(), weight)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences and offending (spans of the
    sentences with a score of 0.5 or more) of every row."""
    scored = docs.select("doc_id", F.arrow_udf(score_column(train(docs, labels)), RESULT)("text").alias("r"))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("r.score").alias("score"),
                         (F.col("r.score") >= 0.5).cast("int").alias("predicted"),
                         F.col("r.n_sentences").alias("n_sentences"), F.col("r.offending").alias("offending"))
