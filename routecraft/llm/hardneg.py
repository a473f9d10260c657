"""Hard-negative mining over a residue number system (operator 13).

Vectors become integers (floor of ``scale`` times a component). Their inner
products are taken by matrix products modulo several small primes in float32: with
symmetric residues and slices of the components so short that no partial sum
reaches 2**24, every float32 sum is exact. Chinese remaindering (mixed radix, in
64-bit integers) gives back the exact signed score, as the product of the primes is
more than twice the largest score that the longest vector allows.

Anchors are met with all rows in blocks: rows are packed into blocks of ROWS, anchors
into blocks of ANCHORS, and a block of rows goes to every block of anchors within a
(anchor block, slot) bucket, so work and memory of a bucket are bounded at any size.
First each anchor's positives are found, then, in windows set by their scores, the
negatives. A task keeps the best few of each anchor over the blocks of a bucket;
a window over what the buckets leave selects the final ones.

Defined results: rows with a null id, label or vector, or a null or non-finite
component, take no part; of rows with the same id the least by label, then vector, counts;
vectors of unequal length are compared as if the shorter one ended in zeros, empty
vectors score 0; ties go to the smaller id; an anchor without positives, or a
positive without negatives in its window, has no rows; an empty table gives an
empty result; other columns are never read. Scores that may pass 2**58 are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hand_off

ROWS, ANCHORS, SLOT_BLOCKS = 1024, 1024, 64
# the largest primes below 2**10
PRIMES = [1021, 1019, 1013, 1009, 997, 991, 983, 977]
EXACT = 1 << 24          # float32 holds every integer up to here
NONE = -(1 << 63)
LIMIT = 1 << 58


def primes_for(bound: int) -> list[int]:
    """Primes whose product is more than twice ``bound``."""
    out, product = [], 1
    for p in PRIMES:
        if product > 2 * bound:
            break
        out.append(p)
        product *= p
    if product <= 2 * bound or bound >= LIMIT:
        raise ValueError(f"scores may reach {bound}: they have to stay below 2**58")
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Symmetric residues, -(p - 1) / 2 to (p - 1) / 2, as float32."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p of symmetric residues, in float32 slices that stay exact."""
    step = max(1, EXACT // (p // 2) ** 2)
    out = np.zeros((len(a), len(b)), np.int64)
    for lo in range(0, a.shape[1], step):
        out += (a[:, lo: lo + step] @ b[:, lo: lo + step].T).astype(np.int64)
    return out % p


def remainder(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed integers of the residues ``parts`` (mixed radix digits, exact in 64 bits)."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        d = parts[i].copy()
        for q, e in zip(primes[:i], digits):
            d = (d - e) * pow(q, -1, p) % p
        digits.append(d)
    out, weight, product = np.zeros_like(parts[0]), 1, 1
    for p, d in zip(primes, digits):
        out = out + d * np.int64(weight)
        weight *= p
        product *= p
    return np.where(out > product // 2, out - np.int64(product), out)


def scores(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """Exact a @ b.T of integer matrices."""
    return remainder([product_mod(residues(a, p), residues(b, p), p) for p in primes], primes)


def integer_vectors(rows: DataFrame, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding",
                    label: str = "label") -> DataFrame:
    """id, label and x (integer components) of the rows that take part, one for each id."""
    x = F.transform(vector, lambda v: v.cast("double"))
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))))
    good = (rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
            .where(ok).select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), whole.alias("x")))
    return good.groupBy("id").agg(F.min(F.struct("label", "x")).alias("m")).select("id", "m.label", "m.x")


def _padded(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix of ``dim`` columns, zeros at the end."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dim), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = \
        lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _pack(size: int, dim: int, prefix: str, wanted: int = 0):
    """Batches (id, label, x) as blocks of at most ``size`` rows in the order of the ids; with
    ``wanted``, each row also has ps and pi, that many scores and ids of positives."""
    def run(batches):
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            order = np.argsort(batch["id"].to_numpy(), kind="stable")
            batch = batch.take(pa.array(order))
            for lo in range(0, batch.num_rows, size):
                b = batch.slice(lo, size)
                out = {f"{prefix}b": [block], f"{prefix}id": [b["id"].to_numpy().astype("<i8").tobytes()],
                       f"{prefix}label": [b["label"].to_numpy().astype("<i8").tobytes()],
                       f"{prefix}x": [_padded(b["x"], dim).astype("<i4").tobytes()]}
                if wanted:
                    ps, pi = np.full((b.num_rows, wanted), NONE), np.zeros((b.num_rows, wanted), np.int64)
                    for i, row in enumerate(b["positives"].to_pylist()):
                        for j, q in enumerate(row):
                            ps[i, j], pi[i, j] = q["score"], q["id"]
                    out |= {"ps": [ps.astype("<i8").tobytes()], "pi": [pi.astype("<i8").tobytes()]}
                yield pa.RecordBatch.from_pydict(out)
                block += 1
    return run


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of each row by score (high first), then id; NONE marks an empty place."""
    order = np.lexsort((ids, -np.maximum(score, NONE + 1)), axis=-1)[..., :k]
    return np.take_along_axis(score, order, -1), np.take_along_axis(ids, order, -1)


def _ranked(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each row from high to low, equal ones in column (id) order, with their columns."""
    order = np.argsort(-np.maximum(score, NONE + 1), axis=1, kind="stable")
    return np.take_along_axis(score, order, 1), order


def _positives(k: int):
    def find(score, block):
        same = (block["alabel"][:, None] == block["rlabel"]) & (block["aid"][:, None] != block["rid"])
        top, column = _ranked(np.where(same, score, NONE))
        return top[:, None, :k], block["rid"][column[:, :k]][:, None]
    return find


def _negatives(k: int, low: int, high: int):
    """For each positive, the first k rows of another label with low % to high % of its score."""
    def find(score, block):
        top, column = _ranked(np.where(block["alabel"][:, None] != block["rlabel"], score, NONE))
        ps = block["ps"]
        out_s, out_i = np.full((*ps.shape, k), NONE), np.zeros((*ps.shape, k), np.int64)
        for j in range(ps.shape[1]):
            limit = ps[:, j: j + 1]
            # the first that 100 * score <= high * limit lets in, in whole numbers
            ceiling = np.where(limit == NONE, NONE, high * np.where(limit == NONE, 0, limit) // 100)
            at = (top > ceiling).sum(1)[:, None] + np.arange(k)
            inside = at < top.shape[1]
            at = np.minimum(at, top.shape[1] - 1)
            s = np.take_along_axis(top, at, 1)
            fits = inside & (s != NONE) & (limit != NONE) & (low * np.where(limit == NONE, 0, limit) <= 100 * np.where(s == NONE, 0, s))
            out_s[:, j] = np.where(fits, s, NONE)
            out_i[:, j] = block["rid"][np.take_along_axis(column, at, 1)]
        return out_s, out_i
    return find


FOUND = "anchor_id bigint, place int, positive_id bigint, positive_score bigint, id bigint, score bigint"


def _search(find, k: int, dim: int, primes: list[int], with_positives: bool):
    """Joined blocks, those of one (group, slot) bucket after each other, to the best k of
    each anchor (and positive) in the bucket."""
    def run(batches):
        now, best = None, {}  # block of anchors: its rows, scores and ids
        for batch in batches:
            for row in batch.to_pylist():
                if now != (row["group"], row["slot"]):
                    yield from (_found(*b) for b in best.values())
                    now, best = (row["group"], row["slot"]), {}
                block = {n: _ints(row[n]) for n in ("aid", "alabel", "rid", "rlabel")}
                if with_positives:
                    block |= {n: _ints(row[n]).reshape(len(block["aid"]), -1) for n in ("ps", "pi")}
                a, r = (np.frombuffer(row[f"{side}x"], "<i4").reshape(-1, dim).astype(np.int64) for side in "ar")
                s, i = find(scores(a, r, primes), block)
                if row["ab"] in best:
                    _, s0, i0 = best[row["ab"]]
                    s, i = _best(np.concatenate([s0, s], -1), np.concatenate([i0, np.broadcast_to(i, s.shape)], -1), k)
                best[row["ab"]] = block, s, np.broadcast_to(i, s.shape)
        yield from (_found(*b) for b in best.values())
    return run


def _found(block, score, ids) -> pa.RecordBatch:
    a, place, j = np.nonzero(score != NONE)
    ps = block.get("ps")
    return pa.RecordBatch.from_pydict({
        "anchor_id": block["aid"][a], "place": place.astype(np.int32),
        "positive_id": np.zeros(len(a), np.int64) if ps is None else block["pi"][a, place],
        "positive_score": np.zeros(len(a), np.int64) if ps is None else ps[a, place],
        "id": ids[a, place, j], "score": score[a, place, j]})


def _meet(row_blocks: DataFrame, anchor_blocks: DataFrame, n_rows: int) -> DataFrame:
    """Every block of rows with every block of anchors, dealt over buckets of about one
    block of anchors (group) and SLOT_BLOCKS blocks of rows (slot)."""
    groups, slots = max(1, anchor_blocks.count()), max(1, -(-n_rows // SLOT_BLOCKS))
    return (row_blocks.withColumn("slot", F.pmod(F.xxhash64("rb"), F.lit(slots)).cast("int"))
            .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
            .join(anchor_blocks.withColumn("group", F.pmod(F.xxhash64("ab"), F.lit(groups)).cast("int"))
                  .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))), ["group", "slot"]))


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, scale: float = 256.0, positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, embedding, label. For each row with ``is_anchor`` (an expression of
    ``id`` and ``label``) the first ``positives`` other rows of its label by score, and for
    each of them the first ``negatives`` rows of another label whose score is within
    ``low`` % and ``high`` % of the positive's."""
    spark = rows.sparkSession
    vectors = hand_off(integer_vectors(rows, scale), "integer-vectors")
    norm = F.aggregate(F.transform("x", lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    facts = vectors.agg(F.max(norm).alias("norm"), F.max(F.size("x")).alias("dim")).first()
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if facts["norm"] is None:
        return spark.createDataFrame([], result)
    # the score of two vectors is at most the larger squared length; a float sum is off by far less than 1 in 1000
    primes, dim = primes_for(int(facts["norm"] * 1.001) + 1), max(1, facts["dim"])

    kinds = "{0}b bigint, {0}id binary, {0}label binary, {0}x binary"
    blocks = hand_off(vectors.mapInArrow(_pack(ROWS, dim, "r"), kinds.format("r")), "row-blocks")
    n_blocks = blocks.count()
    anchors = vectors.where(is_anchor)

    def search(anchor_rows, wanted, find, k):
        kind = kinds.format("a") + (", ps binary, pi binary" if wanted else "")
        packed = hand_off(anchor_rows.mapInArrow(_pack(ANCHORS, dim, "a", wanted), kind), "anchor-blocks")
        return hand_off(_meet(blocks, packed, n_blocks).mapInArrow(_search(find, k, dim, primes, bool(wanted)), FOUND), "best")

    first = _first(search(anchors, 0, _positives(positives), positives), ["anchor_id"], positives)
    with_positives = anchors.join(first.groupBy(F.col("anchor_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "score", F.col("id").alias("id")))).alias("positives")), "id")
    found = search(with_positives, positives, _negatives(negatives, low, high), negatives)
    return _first(found, ["anchor_id", "positive_id"], negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
