"""Language identification by string kernels (operator 5).

The blended-spectrum presence kernel of two texts counts the n-grams of one to
three characters that both have, normalised by their own counts; n-grams are
hashed into ``CELLS`` classes. A bounded sample of landmark texts gives the
Nyström map, one-versus-rest kernel ridge regression is fitted on a bounded
sample, and texts are scored in batches of matrix products.

Samples: at most ``PER_LANGUAGE`` training texts of each language by the order
of a hash of the text, ``LANDMARKS`` of them (spread over the languages) as
landmarks. Every row is predicted from its whole text.

Defined results: a null text, or one without letters, is ``und`` with score 0;
without training texts every row is ``und``; ties go to the first language by
name; a null id is held out; rows with equal texts get equal results; an empty
table gives an empty result; source and other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textnum import Block, mix

CELLS = 1 << 14
GRAMS = (1, 2, 3)
LANDMARKS, PER_LANGUAGE = 96, 250
RIDGE, SHARPNESS = 1e-2, 8.0
ROWS = 64               # texts of one matrix product
RESULT = "struct<lang: string, score: double>"


def presence(texts: list[str]) -> np.ndarray:
    """Rows of n-gram presences, each of unit length."""
    out = np.zeros((len(texts), CELLS), np.float32)
    flat = out.reshape(-1)
    b = Block(texts, fold=True)
    code = b.cp.astype(np.uint64)
    doc = np.repeat(np.arange(b.n), b.length + 1)
    gram = np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        gram = gram[: len(code) - n + 1] * np.uint64(0x110000) + code[n - 1:]  # up to three code points fit 63 bits
        if n in GRAMS and len(gram):
            own = doc[: len(gram)] == doc[n - 1:]
            cell = (mix(gram + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(CELLS - 1)).astype(np.int64)
            flat[(doc[: len(gram)] * CELLS + cell)[own]] = 1
    return out / np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))


def fit(texts: list[str], langs: list[str]):
    """(languages, landmark rows, weights) or None."""
    names = sorted(set(langs))
    if not names:
        return None
    x = np.concatenate([presence(texts[i:i + ROWS]) for i in range(0, len(texts), ROWS)])
    per = max(1, LANDMARKS // len(names))
    chosen = np.concatenate([[i for i, v in enumerate(langs) if v == name][:per] for name in names]).astype(int)[:max(LANDMARKS, len(names))]
    landmarks = x[chosen]
    value, vector = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    root = vector @ np.diag(np.where(value > 1e-6, 1 / np.sqrt(np.maximum(value, 1e-6)), 0)) @ vector.T
    phi = np.hstack([(x @ landmarks.T) @ root, np.ones((len(x), 1))])
    target = np.array([[1.0 if v == name else -1.0 for name in names] for v in langs])
    share = 1 / np.array([langs.count(v) for v in langs])  # languages weigh the same
    w = np.linalg.solve(phi.T @ (phi * share[:, None]) + RIDGE / len(x) * np.eye(phi.shape[1]), phi.T @ (target * share[:, None]))
    return names, landmarks, (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)


def predict_column(model):
    def run(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        lang, score = [], []
        for lo in range(0, len(texts), ROWS):
            part = [t or "" for t in texts[lo: lo + ROWS]]
            if model is None:
                lang += ["und"] * len(part)
                score += [0.0] * len(part)
                continue
            names, landmarks, weights, bias = model
            f = (presence(part) @ landmarks.T) @ weights + bias
            e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
            best = f.argmax(1)
            for t, i, p in zip(part, best, (e / e.sum(1, keepdims=True))[np.arange(len(part)), best]):
                known = any(map(str.isalpha, t))
                lang.append(names[i] if known else "und")
                score.append(float(p) if known else 0.0)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])
    return run


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))


def train(docs: DataFrame):
    """The model of a sample: first the least hashes of each language in each of 64 parts
    of the hash range, then the least of those, so that no language meets in one task."""
    known = (docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
             .select("lang", F.xxhash64("text").alias("h"), "text"))
    part = F.pmod(F.col("h"), F.lit(64))
    some = (known.select("lang", "h").distinct()
            .withColumn("r", F.row_number().over(Window.partitionBy("lang", part).orderBy("h"))).where(F.col("r") <= PER_LANGUAGE)
            .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= PER_LANGUAGE)
            .select("lang", "h"))
    rows = (known.join(some, ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).orderBy("h", "lang").toArrow())
    return fit(rows["text"].to_pylist(), rows["lang"].to_pylist())


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    r = docs.select("doc_id", F.arrow_udf(predict_column(train(docs)), RESULT)("text").alias("r"))
    return r.select("doc_id", held_out().alias("held_out"), F.col("r.lang").alias("lang_pred"), F.col("r.score").alias("score"))
