"""op11 sends its counts as arrays, a row for each bucket, and adds them up whole."""

import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame

from routecraft.llm import collocations

from .test_collocations import brute, documents, got


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id bigint, text string, lang string").repartition(parts)


def test_rare_words_do_not_travel_as_rows(spark, monkeypatch):
    # 12,000 words that occur once each among some that are frequent
    rows = [(" ".join(f"w{i}x{j} of the" for j in range(60)), "en") for i in range(200)]
    frames, mapped = [], DataFrame.mapInArrow

    def noted(self, *args, **kw):
        frames.append(mapped(self, *args, **kw))
        return frames[-1]
    monkeypatch.setattr(DataFrame, "mapInArrow", noted)
    df = frame(spark, rows)
    assert got(df) == brute(rows, 10, 2000)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # of each of four passes: some buckets for each shuffle partition, language or shard and task
    assert frames and all(f.count() <= 4 * parts * 3 * 4 * 2 for f in frames)


def test_small_buffers_give_the_same_rows(spark, monkeypatch):
    rows = list(documents(150, 9)) + [("hot words " * 500, None)] * 3
    df = frame(spark, rows)
    want = brute(rows, 4, 2000)
    for name, value in (("HELD_KEYS", 50), ("HELD_PHRASES", 50), ("MERGED_BYTES", 1), ("BLOCK_CHARS", 200)):
        monkeypatch.setattr(collocations, name, value)
    assert want and got(df, support=4) == want


def test_equal_hashes_of_different_phrases_stay_apart():
    def row(lang, texts, counts, hashes):
        data = [t.encode() for t in texts]
        parts = (b"".join(data), pa.array(map(len, data), pa.uint32()).buffers()[1].to_pybytes()[:4 * len(data)],
                 pa.array(counts, pa.uint32()).buffers()[1].to_pybytes()[:4 * len(data)], pa.array(hashes, pa.int64()).buffers()[1].to_pybytes()[:8 * len(data)])
        return {"bucket": 0, "lang": lang, "n": 2, "phrase": parts[0], "size": parts[1], "c": parts[2], "h": parts[3]}
    schema = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("n", pa.int32()), *((x, pa.binary()) for x in ("phrase", "size", "c", "h"))])
    for hashes in ([5, 5, 7], [4, 5, 7]):
        batch = pa.RecordBatch.from_pylist([row("en", ["a b", "c d", "é f"], [6, 1, 9], hashes), row("en", ["a b"], [4], hashes[:1]),
                                            row("de", ["a b", "x y"], [10, 2], [5 + hashes[0], 9])], schema)
        out = [tuple(r.values())[:4] for b in collocations._summed(10)([batch]) for r in b.to_pylist()]
        assert sorted(out, key=str) == sorted([("en", 2, "a b", 10), ("de", 2, "a b", 10), ("en", 2, None, 10), ("de", 2, None, 2)], key=str)
