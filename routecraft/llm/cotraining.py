"""Quality by co-training (operator 1).

Two logistic classifiers see different views of a document: its text (hashed
character pairs, shares of character classes, line layout) and the page's metadata
(source, language, the given length). In each round both score all unlabelled
documents, and every one that a classifier is sure of (``SURE``) is a pseudo-label
for the other one in that round. At the end each view is calibrated on labelled rows
that it was not fitted on, and the calibrated views are combined as independent evidence.

The exchange has no limit: documents equal in all features are one row of the pool,
whatever their number, and a round adds up gradients and Hessians of its
pseudo-labels inside the tasks, so that only sums of a fixed size reach the driver.
The pseudo-labels of a class weigh together what its labelled rows weigh, which
keeps the class share; a view that is sure of one class only hands over nothing.

Bound (documented parameter): ``MAX_LABELLED`` labelled rows of each class by
the order of a hash of the id. Features of every row are computed once, from whole
texts, and written as a table; rounds and scores run over all of it.

Defined results: null text counts as empty, null source, lang and n_chars as
values of their own; several labels of one id count as their largest, null
labels as none; a null id is held out; rows equal in all inputs get equal scores;
without labels of both classes all scores are 0.5; an empty table gives an empty
result; missing metadata columns count as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hand_off
from .textnum import Block, blocks, mix, strings

PAIRS = 64              # hashed character pairs
HASHED = 16             # cells of source and of language
ROUNDS, STEPS, SURE = 3, 4, 0.95   # rounds of exchange, Newton steps in each
ADDERS = 16             # tasks that add up the partitions' sums
MAX_LABELLED = 3000
RIDGE = 1.0
FEATURES = "struct<a: array<float>, b: array<float>>"
_CLASSES = 8
_WIDE = (PAIRS + _CLASSES + 5, 2 * HASHED + 3)  # columns of the two views


def _classes(cp: np.ndarray) -> np.ndarray:
    """A character's class: lower, upper, digit, blank, line feed, sentence sign, other sign, beyond ASCII."""
    table = np.full(129, 6, np.int64)
    table[97:123], table[65:91], table[48:58], table[32], table[10], table[128] = 0, 1, 2, 3, 4, 7
    table[[ord(c) for c in ".,;:'\"-()"]] = 5
    return table[np.minimum(cp, 128)]


def text_features(texts: list[str]) -> np.ndarray:
    b = Block(texts)
    starts, ends = b.blank_words()
    doc, cls = np.repeat(np.arange(b.n), b.length + 1), _classes(b.cp)
    n = np.maximum(b.length, 1)[:, None]
    share = np.bincount(doc * _CLASSES + cls, minlength=b.n * _CLASSES).reshape(b.n, _CLASSES) / n
    inside = doc[1:] == doc[:-1]
    pair = (mix(b.cp[:-1].astype(np.uint64) << np.uint64(21) | b.cp[1:].astype(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
    pairs = np.bincount((doc[:-1] * PAIRS + pair)[inside], minlength=b.n * PAIRS).reshape(b.n, PAIRS) / n
    word_doc = b.doc_of(starts)
    words = np.bincount(word_doc, minlength=b.n)
    mean = np.bincount(word_doc, ends - starts, b.n) / np.maximum(words, 1)
    lines = np.bincount(doc[b.cp == 10], minlength=b.n) + 1
    layout = np.stack([np.log1p(lines) / 3, np.log1p(b.length / lines) / 5, b.length / lines < 40], 1)
    return np.hstack([share * 4, np.sqrt(pairs) * 2, (mean / 10)[:, None], (words == 0)[:, None], layout]).astype(np.float32)


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    import zlib
    out = np.zeros((len(lang), _WIDE[1]), np.float32)
    for i, (v, s, n) in enumerate(zip(lang, source, n_chars)):
        out[i, zlib.crc32(repr(s).encode()) % HASHED] = 1
        out[i, HASHED + zlib.crc32(repr(v).encode()) % HASHED] = 1
        size = float(n) if n is not None else 0.0
        out[i, 2 * HASHED:] = (n is None, np.log1p(max(size, 0)) / 5, size < 150)
    return out


def _features(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
    texts = strings(text)
    a = [text_features(texts[lo:hi]) for lo, hi in blocks(texts)]
    b = meta_features(lang.to_pylist(), source.to_pylist(), n_chars.to_pylist())

    def rows(m, width):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * width), pa.array(m.reshape(-1), pa.float32()))
    return pa.StructArray.from_arrays([rows(np.concatenate(a) if a else np.zeros((0, _WIDE[0]), np.float32), _WIDE[0]), rows(b, _WIDE[1])], ["a", "b"])


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression of weighted rows by Newton steps; the bias is last."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    weight = weight / weight.mean()
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + RIDGE * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - RIDGE * w)
    return w


def _sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and (negative) Hessian of the weighted log-likelihood, the bias last."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (weight * (y - p)), (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x


def _pseudo_sums(teachers, models):
    """For each view and class: the number of pseudo-labels that the other view gives, their
    gradient and Hessian under ``models``, as one row of numbers for each partition."""
    def run(batches):
        total = None
        for batch in batches:
            views = [batch[c].flatten().to_numpy().reshape(batch.num_rows, -1) for c in "ab"]
            parts = []
            for view, w in enumerate(models):
                z = _logit(views[1 - view], teachers[1 - view])
                edge = np.log(SURE / (1 - SURE))
                for y, sure in ((0.0, z <= -edge), (1.0, z >= edge)):
                    x = views[view][sure]
                    g, h = _sums(x, np.full(len(x), y), np.ones(len(x)), w)
                    parts += [[float(len(x))], g, h.ravel()]
            flat = np.concatenate(parts)
            total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total], pa.list_(pa.float64()))})
    return run


def _added(batches):
    total = None
    for batch in batches:
        for row in batch["sums"]:
            total = row.values.to_numpy() if total is None else total + row.values.to_numpy()
    if total is not None:
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total], pa.list_(pa.float64()))})


def _exchange(pool: DataFrame, own, models) -> list[np.ndarray]:
    """The models of both views after one round: Newton steps on the labelled rows (x, y,
    weight) and on all pseudo-labels that the models of the round's start give each other."""
    teachers, models = models, list(models)
    for _ in range(STEPS):
        rows = (pool.mapInArrow(_pseudo_sums(teachers, models), "sums array<double>").repartition(ADDERS)
                .mapInArrow(_added, "sums array<double>").toArrow())
        if not rows.num_rows:
            return models
        flat = np.sum([r.values.to_numpy() for r in rows["sums"]], axis=0)
        for view, (x, y, weight) in enumerate(own):
            weight, wide = weight / weight.mean(), _WIDE[view] + 1
            got, flat = flat[:2 * (1 + wide + wide * wide)].reshape(2, -1), flat[2 * (1 + wide + wide * wide):]
            g, h = _sums(x, y, weight, models[view])
            if got[:, 0].min() > 0:
                for label in (0, 1):
                    scale = weight[y == label].sum() / got[label, 0]
                    g = g + scale * got[label, 1:1 + wide]
                    h = h + scale * got[label, 1 + wide:].reshape(wide, wide)
            models[view] = models[view] + np.linalg.solve(h + RIDGE * np.eye(wide), g - RIDGE * models[view])
    return models


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _score_column(models, calibration, prior):
    """p of the text view, the metadata view and both."""
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        z = []
        for col, w, (slope, shift) in zip((a, b), models, calibration):
            x = col.flatten().to_numpy().reshape(len(col), -1) if len(col) else np.zeros((0, len(w) - 1))
            z.append(slope * _logit(x, w) + shift)
        p = [1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (*z, z[0] + z[1] - prior)]
        return pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in p], ["a", "b", "both"])
    return run


def _scored(frame: DataFrame, models, calibration=((1.0, 0.0), (1.0, 0.0)), prior=0.0) -> DataFrame:
    return frame.withColumn("p", F.arrow_udf(_score_column(models, calibration, prior), "struct<a: double, b: double, both: double>")("a", "b"))


def _matrix(table: pa.Table, column: str, wide: int) -> np.ndarray:
    return np.array(table[column].to_pylist(), np.float32).reshape(-1, wide)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def train(frame: DataFrame):
    """(models, calibration, prior) or None, from the feature table (key, y, held_out, a, b)."""
    known = frame.where("y is not null and not held_out")
    rows = known.where("y = 1").orderBy("key").limit(MAX_LABELLED).unionByName(known.where("y = 0").orderBy("key").limit(MAX_LABELLED)) \
        .select("key", "y", "a", "b").toArrow()
    y = np.array(rows["y"].to_pylist(), np.float64)
    if not len(y) or y.min() == y.max():
        return None
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # the bounded sample stands for all labelled rows: each class weighs what it has in all of them
    weight = np.where(y > 0, n[1] / (y > 0).sum(), n[0] / (y == 0).sum())
    views = [_matrix(rows, c, w) for c, w in zip("ab", _WIDE)]
    judge = np.array(rows["key"].to_pylist()) % 4 == 0  # kept for calibration
    own = [(v[~judge], y[~judge], weight[~judge]) for v in views]
    models = [fit(*o) for o in own]
    # one row for documents equal in all features: a group of copies speaks once
    pool = hand_off(frame.where("y is null").select("a", "b").distinct(), "quality-pool")
    for _ in range(ROUNDS):
        models = _exchange(pool, own, models)
    calibration = []
    for v, w in zip(views, models):
        z = _logit(v[judge], w)[:, None]
        calibration.append(tuple(fit(z, y[judge], weight[judge])) if len(set(y[judge])) == 2 else (1.0, 0.0))
    share = float(np.clip(n[1] / (n[0] + n[1]), 1e-3, 1 - 1e-3))
    return models, calibration, float(np.log(share / (1 - share)))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score (1: good) and predicted of every row."""
    have = set(docs.columns)
    col = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    made = docs.select("doc_id", F.arrow_udf(_features, FEATURES)(
        "text", col("lang", "string"), col("source", "string"), col("n_chars", "bigint")).alias("f")).select("doc_id", "f.a", "f.b")
    y = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    frame = hand_off(made.join(y, "doc_id", "left").select(
        "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("key"), (F.col("y") > 0).cast("int").alias("y"),
        held_out().alias("held_out"), "a", "b"), "quality-features")
    model = train(frame)
    if model is None:
        half = F.lit(0.5)
        return frame.select("doc_id", "held_out", half.alias("text_score"), half.alias("meta_score"), half.alias("score"), F.lit(1).alias("predicted"))
    return _scored(frame, *model).select(
        "doc_id", "held_out", F.col("p.a").alias("text_score"), F.col("p.b").alias("meta_score"), F.col("p.both").alias("score"),
        (F.col("p.both") >= 0.5).cast("int").alias("predicted"))
