"""Tables that a stage makes on its way go when what it keeps of them is written."""

import glob
import os
import random

import pytest

import corpus_pipeline
from routecraft.llm import lines, shingles
from routecraft.session import hand_off, settled, shared_folder

SF = "/root/testdata/sf0.001"


def tables(spark):
    return set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/routecraft/*"))


def names(paths):
    return sorted(os.path.basename(p).rsplit("-", 1)[0] for p in paths)


def test_stages_leave_their_small_results_only(spark):
    texts = [" ".join(f"t{i}w{j}" for j in range(40)) for i in range(12)]
    texts += [texts[2].replace("t2w39", "other"), texts[3], f"{texts[4]}\nits own line of six words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    left = {}
    for name, stage in corpus_pipeline.STAGES[1:4]:
        before = tables(spark)
        stage(spark, docs, SF).collect()
        left[name] = names(tables(spark) - before)
    assert left == {"line_dedup": ["line-removed"], "near_duplicates": ["repeated-rows", "shingle-components"],
                    "decontamination": ["decontaminate-hit"]}


def test_settled_removes_its_own_paths_even_if_it_fails(spark):
    kept = hand_off(spark.range(3), "kept")
    before = tables(spark)

    def inner():
        return settled(spark, lambda: hand_off(spark.range(5), "inner-step").where("id > 1"), "inner")

    def failing():
        hand_off(spark.range(5), "step")
        raise ValueError("no rows")

    got = settled(spark, lambda: inner().join(hand_off(spark.range(4), "step"), "id"), "outer")
    assert names(tables(spark) - before) == ["outer"]
    assert {r.id for r in got.collect()} == {2, 3} and kept.count() == 3
    with pytest.raises(ValueError):
        settled(spark, failing, "never")
    assert names(tables(spark) - before) == ["outer"]


def test_texts_that_stay_as_they_are_are_not_shuffled(spark, monkeypatch):
    for module in (lines, shingles):  # the filter itself is of a fixed size
        monkeypatch.setattr(module, "ROW_CELLS", 1 << 12)
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(48):x}" for _ in range(3000)) for _ in range(40)]
    texts += [texts[3], texts[4].replace(" ", " other ", 1)]  # a copy and a near copy go
    wordless = [(50, None), (51, ""), (None, "\n")]
    rows = [*enumerate(texts), (7, texts[7]), (None, "a line of its own here"), *wordless]
    docs = hand_off(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), "docs")
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffled():
        return {p: os.path.getsize(p) for d in dirs for p in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for one machine
    try:
        for name, stage in corpus_pipeline.STAGES[1:3]:
            out = stage(spark, docs, SF)
            before = shuffled()
            got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
            twice = 2 if name == "line_dedup" else 1
            assert got == sorted([*enumerate(texts[:40]), *[(7, texts[7])] * (twice - 1), *rows[-4:]], key=str), name
            assert sum(size for p, size in shuffled().items() if p not in before) < 0.25 * sum(map(len, texts)), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
