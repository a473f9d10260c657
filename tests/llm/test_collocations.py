"""op11 against brute force on small documents and on the given ones' counts."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from routecraft.llm import collocations

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support, top):
    f, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in (1, 2, 3):
                f.update((lang or "und", tuple(w[i:i + n])) for i in range(len(w) - n + 1))
    found = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) == 1 or a < support:
            continue
        if len(p) == 2 and any(100 * c >= 50 * a for (x, q), c in f.items() if x == lang and len(q) == 3 and c >= support and p in (q[:2], q[1:])):
            continue
        s, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found[lang].append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, total[lang], -s)
            for lang, rows in found.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])}


def got(df, **kw):
    return {tuple(r) for r in collocations.collocations(df, **kw).collect()}


def documents(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "Straße", "中文", "a b", "'"]
    for _ in range(n):
        text = []
        for _ in range(rng.randrange(30)):
            text.append(rng.choice(words) if rng.random() < 0.6 else rng.choice(["New York City", "new  York\tcity", "the the the", "in spite of"]))
            text.append(rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "! "]))
        yield "".join(text), rng.choice(["en", "en", "en", "de", None])


@pytest.mark.parametrize("support,shards,top", [(10, 4, 2000), (3, 7, 20), (12, 1, 5)])
def test_against_brute_force(spark, support, shards, top):
    rows = list(documents(400, support))
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id bigint, text string, lang string").repartition(6)
    want = brute(rows, support, top)
    assert want and got(df, support=support, shards=shards, top=top) == want


def test_defined_cases(spark):
    rows = [("hot words " * 3000, "en"), (None, "en"), ("", None), (" \t\n", "de"), ("a b. a b, a b", None), ("A B a b", "und")] + [("one two three", "en")] * 40
    df = spark.createDataFrame([(None if i % 2 else 7, t, x) for i, (t, x) in enumerate(rows)], "doc_id bigint, text string, lang string") \
        .select("*", *[F.lit(1).alias(c) for c in ("shard", "h", "c", "phrase", "n", "rank")])
    assert got(df, support=3) == brute(rows, 3, 2000)
    assert got(df.limit(0)) == set()
    assert got(df.where("text is null")) == set()


def test_full_bitmaps_lose_nothing(spark, monkeypatch):
    rows = list(documents(200, 5))
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id bigint, text string, lang string")
    monkeypatch.setattr(collocations, "LEAST_CELLS", 32)
    monkeypatch.setattr(collocations, "MOST_CELLS", 32)
    assert got(df, support=5) == brute(rows, 5, 2000)
