"""Every operator on nulls, empty and long texts, repeated rows, empty tables and
columns whose names clash with inner ones."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from routecraft.llm import cotraining, decontaminate, language, lines, pieces, pii, repetition, shingles, toxicity, urls
from routecraft.llm.queries import piece_model

BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE.replace("word59", "other")
ROWS = [(1, BASE, "en"), (2, NEAR, "en"), (3, None, "en"), (4, "", None), (5, "  \t", "de"), (5, "  \t", "de"), (None, "lone text", "en"),
        (6, "x " * 30000, "fr"), (7, BASE, "en"), (7, BASE, "en"), (8, "mail a@b.co now, ip 1.2.3.256 and 10.0.0.1", "de")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    return df.select("*", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"),
                     *[F.lit(0).alias(c) for c in ("_m", "_key", "k", "th", "win", "_id", "rid", "_rid", "removed")])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 1), (3, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"Word{i}" for i in range(20, 35))), (2, None), (None, BASE), (3, "lone"), (4, "")], "item_id bigint, text string")


def test_repetition(docs):
    got = {(r.doc_id, r.n_words): r for r in repetition.repetition_rules(docs).collect()}
    assert got[1, 60].kept and got[3, 0].base_failed and not got[6, 30000].kept
    assert repetition.keep_good(docs).columns == docs.columns
    assert repetition.keep_good(docs).count() == 4
    assert repetition.keep_good(docs.limit(0)).count() == 0


def test_near_duplicates(docs):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in shingles.near_duplicates(docs).collect()}
    assert got[1, 56] == got[2, 56] == got[7, 56] == 1
    assert got[3, 0] == 3 and got[5, 0] == 5 and got[None, 1] is None and got[6, 1] == 6
    kept = shingles.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "8", "None"]
    assert shingles.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [0, 4])  # 0: rounds of drawn leaders whatever the lists
def test_links_against_brute_force(spark, monkeypatch, crowded):
    import random

    from routecraft.llm import setjoin
    monkeypatch.setattr(setjoin, "CROWDED", crowded)
    rng = random.Random(5)
    texts = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(80)]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(80)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [{tuple(t.split()[i:i + 5]) for i in range(76)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_lines(spark, docs):
    text = "one two three four five six\nother words stand here alone now\n\none two three four five six"
    df = spark.createDataFrame([(1, text), (2, "One two three four five six"), (3, None), (4, "\n")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_lines, r.removed) for r in lines.line_dedup(df).collect()}
    assert got == {1: (4, [3]), 2: (1, [0]), 3: (0, []), 4: (2, [])}
    out = {r.doc_id: r.text for r in lines.drop_lines(df).collect()}
    assert out == {1: "one two three four five six\nother words stand here alone now\n", 3: None, 4: "\n"}
    assert lines.drop_lines(docs).columns == docs.columns
    assert lines.line_dedup(docs.limit(0)).count() == 0


def test_decontaminate(docs, bench):
    got = {(r.doc_id, r.n_words): r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got[1, 60].n_hit == 15 and got[1, 60].items == ["1"] and got[3, 0].n_hit == 0
    assert got[None, 2].items == ["3"] and got[None, 2].n_hit == 1
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    assert decontaminate.drop_contaminated(docs, bench).count() == 6
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_pieces(docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    texts = {r[0]: r[1] or "" for r in ROWS}
    for r in pieces.encode_documents(docs, piece_model()).collect():
        t = texts[r.doc_id]
        assert r.ids == sp.encode(t) and r.decoded == sp.decode(r.ids)
        assert (r.ends[-1] if r.ends else 0) == len(t.encode())
    assert pieces.encode_documents(docs.limit(0), piece_model()).count() == 0


def test_pieces_char_map_like_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = pb.NormalizerSpec()
    spec.ParseFromString(n.serialized_normalizer_spec() if callable(n.serialized_normalizer_spec) else n.serialized_normalizer_spec)
    m = pieces.Model(piece_model())
    m.map, m.spec, m.plain = pieces.CharMap(spec.precompiled_charsmap), spec, False
    for t in ("ｶﾞ① ﬁ", "  a  b ", "Ａｂｃ　ｄ", "\t\n x", "㍿", "", "  "):
        normal, origin = m.normalise(t)
        assert normal.decode() == n.normalize(t) and len(origin) == len(normal) + 1


def test_pii_against_plain_patterns(docs):
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.base] for r in pii.find_spans(docs).collect()}
    t = ROWS[-1][1]
    m, ip = re.search(r"a@b\.co", t), re.search(r"10\.0\.0\.1", t)
    assert got[8] == [("email", m.start(), m.end()), ("ip", ip.start(), ip.end())]
    assert got[3] == [] and got[1] == []
    assert pii.find_spans(docs.limit(0)).count() == 0


def test_classifiers_are_defined(docs, labels):
    for df in (docs, docs.limit(0)):
        n = df.count()
        for r in (toxicity.score_documents(df, labels), cotraining.score_documents(df, labels), cotraining.score_documents(df, labels.limit(0))):
            rows = r.collect()
            assert len(rows) == n and all(0 <= x.score <= 1 for x in rows)
    got = {x.doc_id: x.lang_pred for x in language.predict_languages(docs).collect()}
    assert got[3] == got[4] == got[5] == "und" and got[1] in ("en", "de", "fr")
    assert language.predict_languages(docs.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, "http://A.net/x"), (2, "https://m.example.net/en/1"), (3, "http://net"), (4, None), (5, "nothing"),
            (6, "http://casino-win.example.org/en/1?q=/"), (7, "http://u.example.com/de/3#f"), (8, "http://good.example.org/en/5")]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2][2:] == ("example.net/en/", "allow")
    assert got[3] == ("net", "", None, "allow") and got[4] == got[5] == ("", "", None, "allow")
    assert got[6][:3] == ("casino-win.example.org", "/en/1", None) and got[7][2:] == ("example.com/de/", "block")
    assert urls.judge(df.limit(0)).count() == 0


def _plain_spans(text):
    """The base spans of a text, by the patterns as they are given."""
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15))
    return [(k, start, end) for start, _, end, k in sorted(
        (m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m.group()))]


def test_pii_of_all_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: _plain_spans(r.text or "") for r in documents.select("doc_id", "text").collect()}
    found = {r.doc_id: r for r in pii.find_spans(documents).collect()}
    assert {k: [(s["kind"], s["start"], s["end"]) for s in r.base] for k, r in found.items()} == want
    for r in found.values():
        assert [s for s in r.spans if s in r.base] == r.base and r.spans == sorted(r.spans)
        assert all(a["end"] <= b["start"] or b["end"] <= a["start"] for a in r.spans if a not in r.base for b in r.base)


def test_pii_many_matches_in_one_text(spark):
    """Positions over many chunks and characters beyond one byte or one UTF-16 unit."""
    text = "".join(f"\u00e9\U0001F600 user{i}@mail{i % 7}.example.org, +1 212 555 {i:04d}; password={i:04d}abcd " for i in range(3000))
    r = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [(s["kind"], s["start"], s["end"]) for s in r.base] == _plain_spans(text)
    context = pii._candidates(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    assert context.selectExpr("size(spans)").first()[0] >= 9000


def test_pii_context_is_the_text_around(spark):
    text = "\u00e9" * 30 + "a@b.co,c@d.co x@y.zz" + " +4912345678901"
    df = spark.createDataFrame([(text,)], "text string")
    for kind in ("email", "phone"):
        pieces = df.select(pii._pieces(kind, F.col("text")).alias("p"))
        for s in pieces.select(F.explode(pii._located(kind, F.col("p"))).alias("s")).select("s.*").collect():
            assert s.match == text[s.start:s.end]
            assert s.before == text[max(0, s.start - pii.AROUND):s.start] and s.after == text[s.end:s.end + 1]


def test_held_out_quality(spark):
    """On the given documents: toxicity and language on rows that the models never saw."""
    d = "/root/testdata/sf0.01"
    documents, marks = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    r = language.predict_languages(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    assert r.where("lang = lang_pred").count() >= 0.98 * r.count()
    r = toxicity.score_documents(documents, marks).join(marks.select("doc_id", "toxic"), "doc_id").where("held_out")
    assert r.where("toxic = predicted").count() >= 0.9 * r.count()


def test_pipeline_stages(spark):
    import corpus_pipeline
    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d)
    texts = {r.doc_id for r in out.collect()}
    assert 0 < len(texts) <= spark.read.parquet(f"{d}/documents.parquet").count()
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "near_duplicates"
    assert hashlib.sha256(b"").hexdigest() not in {r.ids_sha256 for r in out.collect()}
