"""op12: the files against the tokenizers library, their framing, index and shuffled reads."""

import glob
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from routecraft.llm import records
from routecraft.llm.queries import op12_token_records, word_model
from tests.conftest import SF001

ODD = ["", None, "  \t\n ", "Café café ̈x", "a<|endoftext|>b c", "x" * 5000, "İSTANBUL ΣΣ", "it's 12345 -- we'll",
       "tab\tand\x0bother blanks here\r\nend", "\U0001f600\U0001f600 emoji"]


def expected(texts):
    t = Tokenizer.from_file(word_model())
    return [t.encode(x or "", add_special_tokens=False).ids + [records.END_ID] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture
def odd_docs(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "Café café ̈x"), (None, "no id"), (2, "another text of one id")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *[F.lit("x").alias(c) for c in ("th", "row", "part", "before")])


def test_odd_texts_like_the_library(spark, odd_docs, tmp_path):
    index = records.write_records(odd_docs, word_model(), str(tmp_path))
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(i), crc(i)) for r, i in zip(rows, expected([r.text for r in rows])))
    got = records.read_digests(spark, str(tmp_path)).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in rows], key=lambda x: (x is not None, x or 0))
    assert {(r.doc_id, r.start, r.n_tokens) for r in index.collect()} == {(r.doc_id, r.start, r.n_tokens) for r in got}


def test_given_documents_like_the_library(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    at, want = 0, []
    for d, ids in zip(docs, expected([d.text for d in docs])):
        want.append((d.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, op12_token_records(spark, SF001).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_shuffled_reads(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    records.write_records(docs, word_model(), str(tmp_path))
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: i for r, i in zip(rows, expected([r.text for r in rows]))}
    one, again, other = ([(r.doc_id, r.ids) for r in records.read_shuffled(spark, str(tmp_path), seed).collect()] for seed in (1, 1, 2))
    assert dict(one) == dict(other) == want and len(one) == len(want)
    assert one == again != other and one != sorted(one)


def test_damage_is_found(spark, odd_docs, tmp_path):
    records.write_records(odd_docs, word_model(), str(tmp_path))
    name = max(glob.glob(f"{tmp_path}/records/*"), key=lambda n: len(open(n, "rb").read()))
    data = bytearray(open(name, "rb").read())
    for place in (3, 9, len(data) // 2, len(data) - 1):
        broken = bytearray(data)
        broken[place] ^= 1
        open(name, "wb").write(broken)
        with pytest.raises(Exception, match="damaged"):
            records.read_digests(spark, str(tmp_path)).collect()
    open(name, "wb").write(data[:-2])
    with pytest.raises(Exception, match="damaged"):
        records.read_digests(spark, str(tmp_path)).collect()


def test_empty_table(spark, odd_docs, tmp_path):
    assert records.write_records(odd_docs.limit(0), word_model(), str(tmp_path)).count() == 0
    assert records.read_digests(spark, str(tmp_path)).count() == 0
    assert records.read_shuffled(spark, str(tmp_path)).count() == 0
