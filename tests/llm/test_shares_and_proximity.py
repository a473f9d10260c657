"""Class weights of the fits, and proximity matches against brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from routecraft.llm import cotraining, decontaminate, toxicity


def test_weighted_rows_count_like_repeated_ones():
    rng = np.random.default_rng(3)
    y = (rng.random(600) < 0.5).astype(float)
    x = rng.normal(size=(600, 3)) + y[:, None]
    often = np.where(y > 0, 5.0, 1.0)
    weighted = cotraining.fit(x, y, often)
    repeated = cotraining.fit(np.repeat(x, often.astype(int), axis=0), np.repeat(y, often.astype(int)), np.ones(int(often.sum())))
    p, q = (1 / (1 + np.exp(-cotraining._logit(x, w))) for w in (weighted, repeated))
    assert np.abs(p - q).max() < 0.01
    # the share itself reaches the scores: without weights the rarer class looks likelier
    assert np.mean(1 / (1 + np.exp(-cotraining._logit(x, cotraining.fit(x, y, np.ones(600)))))) < p.mean() - 0.1


def test_toxicity_fit_takes_the_share_of_all_labels():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts, label = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = [rng.choice(words) for _ in range(12)]
        if bad or rng.random() < 0.1:
            text[3] = "vile"
        texts.append(" ".join(text))
        label.append(int(bad))
    label = np.array(label)
    often = np.where(label > 0, 1, 4)
    a = toxicity.score_column(toxicity.fit(texts, label, (4.0, 1.0)))
    b = toxicity.score_column(toxicity.fit(list(np.repeat(texts, often)), np.repeat(label, often)))
    import pyarrow as pa
    p, q = (np.array(f(pa.array(texts)).field("score")) for f in (a, b))
    assert np.abs(p - q).max() < 0.01
    even = np.array(toxicity.score_column(toxicity.fit(texts, label))(pa.array(texts)).field("score"))
    assert even[label > 0].mean() > p[label > 0].mean() + 0.1


def _brute_near(texts, items):
    words = [t.split() for t in texts]
    count = Counter(w for t in words for w in t)
    code = {w: int(decontaminate._terms([w])[0].view(np.int64)[0]) for w in set(count) | {w for t in items.values() for w in t.split()}}
    out = []
    for t in words:
        exact, near = set(), set()
        for item, text in items.items():
            ws = text.split()
            n = min(decontaminate.WINDOW, len(ws))
            for at in range(len(ws) - n + 1):
                win = ws[at:at + n]
                if any(t[i:i + n] == win for i in range(len(t) - n + 1)):
                    exact.add(item)
                if n < 2 or not all(count[w] for w in win):
                    continue
                (_, _, o1, w1), (_, _, o2, w2) = sorted((count[w], code[w], o, w) for o, w in enumerate(win))[:2]
                if any(abs((i - o1) - (j - o2)) <= decontaminate.SLOP
                       for i, a in enumerate(t) if a == w1 for j, b in enumerate(t) if b == w2):
                    near.add(item)
        out.append(sorted(near - exact))
    return out


def test_proximity_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(60)]

    def text(n):
        return [rng.choice(vocabulary[:rng.choice([5, 20, 60])]) for _ in range(n)]

    items = {str(i): " ".join(text(rng.choice([1, 4, 8, 10, 14]))) for i in range(12)}
    items["absent"] = "v1 never v2 seen"
    texts = []
    for i in range(90):
        t, cut = text(25), rng.choice(list(items.values())).split()
        if i % 3 == 1 and len(cut) > 2:  # pulled apart by one to five words
            k = rng.randrange(1, len(cut))
            cut = cut[:k] + text(rng.randrange(1, 6)) + cut[k:]
        texts.append(" ".join(t[:9] + (cut if i % 3 else []) + t[9:]))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(900, None), (901, "")], "doc_id bigint, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id string, text string")
    rows = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).withColumn("near_items", F.array_sort("near_items")).collect()}
    want = _brute_near(texts, items)
    assert [rows[i].near_items for i in range(90)] == want
    assert sum(map(len, want)) > 10 and rows[900].near_items == rows[901].near_items == []
    # a repeated row gets the same matches
    twice = decontaminate.decontaminate(docs.unionByName(docs), bench)
    assert twice.groupBy("doc_id").agg(F.countDistinct("near_items").alias("c"), F.count(F.lit(1)).alias("n")).where("c <> 1 or n <> 2").isEmpty()
