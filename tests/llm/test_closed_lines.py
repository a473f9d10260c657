"""op3_line_dedup and the pipeline keep the first line of each group of matches, closed transitively."""

import random

import duckdb

import corpus_pipeline
from routecraft.llm.queries import LLM_ORACLE, op3_line_dedup


def removed(texts):
    """By brute force: (document, line) of every line but the first of its group."""
    at = [(d, i, x.lower().split()) for d, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if x.split()]
    sets = [{tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} for _, _, w in at]
    group = list(range(len(at)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if group[i] != group[j] and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return {at[i][:2] for i in range(len(at)) if group[i] != i}


def documents():
    rng = random.Random(3)
    lines = []
    for g in range(5):
        chain = [f"g{g}w{i}" for i in range(50)]
        for _ in range(12):  # each line is near the one before it, not near those further back
            chain = [*chain[2:], f"g{g}n{rng.randrange(10**6)}", f"g{g}n{rng.randrange(10**6)}"]
            lines.append(" ".join(chain))
    lines += [*lines[:4], lines[7].upper(), "two words", "Two  words", "", " "] + [f"own{i} line of six words here" for i in range(8)]
    rng.shuffle(lines)
    base = [f"w{i}" for i in range(60)]
    first, second, both = base[:55] + ["left"] * 5, ["right"] * 5 + base[5:], base
    texts = [" ".join(x) for x in (first, second, both)]
    while lines:
        n = rng.randrange(1, 4)
        texts.append("\n".join(lines[:n]))
        lines = lines[n:]
    return [*texts, None, ""]


def test_groups_are_closed_transitively(spark, tmp_path):
    texts = documents()
    want = removed(texts)
    assert {(1, 0), (2, 0)} <= want  # the second line matches only the third, which matches both
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in op3_line_dedup(spark, str(tmp_path)).collect()}
    assert {(d, int(i)) for d, _, _, ids in got for i in ids.split(",") if i} == want

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert set(con.sql(LLM_ORACLE["op3_line_dedup"]).fetchall()) == got

    left = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in want) if t else t for d, t in enumerate(texts)}
    left = {d: t for d, t in left.items() if (t or "").split() or not (texts[d] or "").split()}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, str(tmp_path)).collect()} == left
