"""op13 against brute force, and the residue arithmetic against Python's integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from routecraft.llm import hardneg


def brute(rows, anchors, low=80, high=100, k=5):
    """rows: id -> (label, vector of integers)."""
    def score(a, b):
        return sum(x * y for x, y in zip(a, b))
    out = set()
    for a in anchors:
        la, va = rows[a]
        ranked = sorted((-score(va, v), i, label) for i, (label, v) in rows.items() if i != a)
        for ps, p, _ in [x for x in ranked if x[2] == la][:k]:
            fits = [x for x in ranked if x[2] != la and low * -ps <= 100 * -x[0] <= high * -ps][:k]
            out |= {(a, p, r + 1, i, -ps, -s) for r, (s, i, _) in enumerate(fits)}
    return out


def run(df, is_anchor, **kw):
    return {tuple(r) for r in hardneg.hard_negatives(df, is_anchor, **kw).collect()}


def test_exact_products():
    rng = np.random.default_rng(1)
    for bits, dim in ((8, 64), (20, 300), (26, 16)):
        a, b = (rng.integers(-(1 << bits), 1 << bits, (7, dim)) for _ in range(2))
        bound = dim << (2 * bits)
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert hardneg.scores(a, b, hardneg.primes_for(bound)).tolist() == want
    with pytest.raises(ValueError):
        hardneg.primes_for(1 << 60)


def test_against_brute_force_with_ties(spark):
    rng = random.Random(3)
    rows = {i: (rng.randrange(3), [rng.randrange(-2, 3) for _ in range(6)]) for i in range(2600)}
    for i in range(0, 600, 3):  # copies: equal scores, decided by the id
        rows[2600 + i] = (rng.randrange(3), rows[i][1])
    df = spark.createDataFrame([(i, [x + 0.5 for x in v], label) for i, (label, v) in rows.items()],
                               "vec_id bigint, embedding array<float>, label int").repartition(5)
    assert run(df, F.col("id") % 100 == 0, scale=1.0) == brute(rows, [i for i in rows if i % 100 == 0])


def test_defined_cases(spark):
    nan, inf = float("nan"), math.inf
    good = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [0.9, 0.0], 2), (4, [1.1, 0.0], 2), (5, [0.1, 1.0], 2),
            (6, [], 2), (7, [-1.0, 0.0], 1), (8, [0.95], 3), (9, [0.9, 0.0, 7.0], 3)]
    bad = [(10, [nan, 1.0], 2), (11, [inf, 1.0], 2), (12, None, 2), (13, [1.0, None], 2), (14, [0.9, 0.0], None), (None, [0.9, 0.0], 2)]
    df = spark.createDataFrame(good + bad + good[:3], "vec_id bigint, embedding array<double>, label int") \
        .select("*", *[F.lit(1).alias(c) for c in ("id", "x", "score", "slot")])
    rows = {i: (label, [math.floor(256 * x) for x in v]) for i, v, label in good}
    want = brute(rows, [0])
    assert want and run(df, F.col("id") == 0) == want
    assert run(df.limit(0), F.col("id") == 0) == set()
    assert run(df.where("vec_id > 100 or label is null"), F.col("id") == 0) == set()
    assert run(df, F.col("id") == 6) == brute(rows, [6])  # an empty vector scores 0
