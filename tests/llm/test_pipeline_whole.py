"""run() of the pipeline against the operators' SQL on DuckDB, stage by stage, and the sentencepiece library."""

import hashlib
import re

import duckdb
import sentencepiece

import corpus_pipeline
from routecraft.llm.queries import LLM_ORACLE, piece_model

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^ \t-\r]")


def expected():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{DATA}/benchmark.parquet')")
    texts = dict(con.sql(f"SELECT doc_id, text FROM read_parquet('{DATA}/documents.parquet')").fetchall())

    def rows(name, *columns):
        con.execute("CREATE OR REPLACE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", list(texts.items()))
        return con.sql(f"SELECT doc_id, {', '.join(columns)} FROM ({LLM_ORACLE[name]})").fetchall()

    sizes = [len(texts)]
    texts = {d: texts[d] for d, kept in rows("op2_repetition_rules", "kept") if kept}
    sizes.append(len(texts))
    for d, gone in rows("op3_line_dedup", "removed_lines"):
        gone = {int(x) for x in gone.split(",") if x}
        if gone:
            texts[d] = "\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in gone)
            if not WORD.search(texts[d]):
                del texts[d]
    sizes.append(len(texts))
    texts = {d: texts[d] for d, n, c in rows("op10_ngram_join", "n_shingles", "component_id") if n == 0 or c == d}
    sizes.append(len(texts))
    texts = {d: texts[d] for d, bad in rows("op9_decontaminate", "contaminated") if not bad}
    sizes.append(len(texts))
    return texts, sizes


def test_run_against_sql_and_library(spark):
    texts, sizes = expected()
    assert sizes[0] > sizes[1] > sizes[-1] > 0  # the fixture makes stages take effect
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    want = {}
    for d, t in texts.items():
        ids = sp.encode(t or "")
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want
