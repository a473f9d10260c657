"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (collocations, cotraining, decontaminate, hardneg, language, lines, pieces, pii, records, repetition, shingles, toxicity,
               urls)
from .common import run_path, table

LLM_REGISTRY: dict = {}
LLM_ORACLE: dict[str, str] = {}


def register(fn):
    LLM_REGISTRY[fn.__name__] = fn
    return fn


@register
def op2_repetition_rules(spark, sf_dir):
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def _op2_sql() -> str:
    lengths = sorted({repetition.BASE_N, *repetition.NGRAM_LIMITS})
    dup = ", ".join(f"coalesce(max(chars) FILTER (n = {n}), 0)::BIGINT AS dup_{n}gram_chars" for n in repetition.NGRAM_LIMITS)
    fails = " OR ".join([f"dup_line_chars > {repetition.LINE_LIMIT} * word_chars",
                         *(f"dup_{n}gram_chars > {x} * word_chars" for n, x in repetition.NGRAM_LIMITS.items())])
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
    base AS (SELECT doc_id, len(ws) AS n_words,
                    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
    line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
    seen AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth,
                    regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM line),
    lines AS (SELECT doc_id, count(*) FILTER (nth > 1) AS n_dup_lines,
                     coalesce(sum(list_sum(list_transform(ws, lambda x: length(x)))) FILTER (nth > 1), 0)::BIGINT AS dup_line_chars
              FROM seen WHERE len(ws) > 0 GROUP BY doc_id),
    wins AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
             FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
                   FROM w, (SELECT unnest({lengths}) AS n) WHERE len(ws) >= n)),
    twice AS (SELECT doc_id, n, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, win) AS c FROM wins) WHERE c > 1),
    inside AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS at FROM twice),
    per AS (SELECT x.doc_id, x.n, count(*) AS words, sum(length(w.ws[x.at])) AS chars
            FROM inside x JOIN w USING (doc_id) GROUP BY ALL),
    cover AS (SELECT doc_id, coalesce(max(words) FILTER (n = {repetition.BASE_N}), 0)::BIGINT AS n_repeat_words, {dup}
              FROM per GROUP BY doc_id),
    m AS (SELECT b.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                 coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
                 {", ".join(f"coalesce(dup_{n}gram_chars, 0)::BIGINT AS dup_{n}gram_chars" for n in repetition.NGRAM_LIMITS)}
          FROM base b LEFT JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id)),
    f AS (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words
                 AS base_failed FROM m)
    SELECT *, NOT base_failed AND NOT ({fails}) AS kept FROM f"""


LLM_ORACLE["op2_repetition_rules"] = _op2_sql()


@register
def op9_decontaminate(spark, sf_dir):
    r = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


LLM_ORACLE["op9_decontaminate"] = rf"""
    WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
             WHERE item_id IS NOT NULL),
    win AS (SELECT DISTINCT item_id::VARCHAR AS item, least(len(ws), {decontaminate.WINDOW}) AS n, array_to_string(ws[i:i + n - 1], ' ') AS win
            FROM (SELECT *, unnest(range(1, greatest(len(ws) - {decontaminate.WINDOW}, 0) + 2)) AS i FROM item WHERE len(ws) > 0)),
    hits AS (SELECT DISTINCT doc_id, i, n, item FROM
               (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
                FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
                      FROM words, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n))
             JOIN win USING (n, win)),
    covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY 1),
    items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY 1)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


@register
def op9_proximity(spark, sf_dir):
    """The proximity matches of operator 9: the items that come near in a document, none of
    whose windows occurs in it. No SQL: which terms of a window are its rarest goes, in ties, by their hashes."""
    r = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", F.size("near_items").cast("long").alias("n_near_items"), "near_items")


@register
def op10_ngram_join(spark, sf_dir):
    return shingles.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


LLM_ORACLE["op10_ngram_join"] = rf"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    sh AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' '), len(ws[i:i + 4])) AS s
           FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM words WHERE len(ws) > 0)),
    size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN size p ON a = p.doc_id JOIN size q ON b = q.doc_id WHERE 100 * c >= 75 * (p.n + q.n - c)),
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    walk AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT w.a, e.b FROM walk w JOIN edges e ON w.b = e.a)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
    FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM walk GROUP BY 1) c USING (doc_id)"""


@register
def op10_ngram_links(spark, sf_dir):
    return shingles.ngram_links(table(spark, sf_dir, "documents"))[0].select("doc_id", "n_shingles", "n_links")


LLM_ORACLE["op10_ngram_links"] = rf"""
    WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    sh AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' '), len(ws[i:i + 4])) AS s
           FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM words WHERE len(ws) > 0)),
    size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
    links AS (SELECT a, count(*) AS c FROM shared JOIN size p ON a = p.doc_id JOIN size q ON b = q.doc_id
              WHERE 100 * c >= 75 * (p.n + q.n - c) GROUP BY a)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, 0)::BIGINT AS n_links
    FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN links ON a = d.doc_id"""


@register
def op3_line_dedup(spark, sf_dir):
    r = lines.line_dedup(table(spark, sf_dir, "documents"), closed=True)
    return r.select("doc_id", "n_lines", F.size("removed").alias("n_removed"),
                    F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


# Lines of equal shingle sets are one class; classes are linked, and their lines come in document order.
LLM_ORACLE["op3_line_dedup"] = r"""
    WITH RECURSIVE split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    line AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM split),
    words AS (SELECT doc_id, line_no, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM line),
    sh AS (SELECT DISTINCT doc_id, line_no, hash(array_to_string(ws[i:i + 4], ' '), len(ws[i:i + 4])) AS s
           FROM (SELECT *, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM words WHERE len(ws) > 0)),
    sets AS (SELECT doc_id, line_no, list_sort(list(s)) AS ss FROM sh GROUP BY ALL),
    class AS (SELECT ss, len(ss) AS n, row_number() OVER () AS k FROM (SELECT DISTINCT ss FROM sets)),
    tok AS (SELECT k, n, unnest(ss) AS s FROM class),
    shared AS (SELECT x.k AS a, y.k AS b, x.n AS n1, y.n AS n2, count(*) AS c FROM tok x JOIN tok y USING (s) WHERE x.k < y.k GROUP BY ALL),
    links AS (SELECT a, b FROM shared WHERE 100 * c >= 75 * (n1 + n2 - c)),
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    walk AS (SELECT a, a AS b FROM edges UNION SELECT w.a, e.b FROM walk w JOIN edges e ON w.b = e.a),
    grp AS (SELECT k, coalesce(min(b), k) AS g FROM class LEFT JOIN walk ON a = k GROUP BY k),
    placed AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY g ORDER BY doc_id, line_no) AS nth
               FROM sets JOIN class USING (ss) JOIN grp USING (k)),
    gone AS (SELECT doc_id, count(*) AS c, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS ids FROM placed WHERE nth > 1 GROUP BY 1)
    SELECT doc_id, coalesce(len(ls), 0)::INTEGER AS n_lines, coalesce(c, 0)::INTEGER AS n_removed, coalesce(ids, '') AS removed_lines
    FROM split LEFT JOIN gone USING (doc_id)"""


def piece_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@register
def op8_sentencepiece(spark, sf_dir):
    return pieces.digests(pieces.encode_documents(table(spark, sf_dir, "documents"), piece_model()))


@register
def op4_toxicity(spark, sf_dir):
    r = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    spans = F.array_join(F.transform("offending", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return r.select("doc_id", "held_out", "score", "predicted", "n_sentences", spans.alias("offending"))


@register
def op5_language(spark, sf_dir):
    return language.predict_languages(table(spark, sf_dir, "documents"))


@register
def op7_url_ratio(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@register
def op6_pii(spark, sf_dir):
    r = pii.find_spans(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return r.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


@register
def op1_cotraining(spark, sf_dir):
    return cotraining.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


LLM_ORACLE["op11_collocations"] = rf"""
    WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM piece),
    f AS (SELECT lang, m, phrase, count(*) AS c FROM
            (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
             FROM words, (SELECT unnest([1, 2, 3]) AS m) WHERE len(ws) >= m) GROUP BY ALL),
    total AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
    cand AS (SELECT * FROM f WHERE m > 1 AND c >= {collocations.SUPPORT}),
    cut AS (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM cand),
    part AS (SELECT cut.lang, cut.phrase, cut.c AS a, m, k, array_to_string(ws[1:k], ' ') AS p1, array_to_string(ws[k + 1:], ' ') AS p2 FROM cut),
    scored AS (SELECT part.lang, part.phrase, a, part.m, k, x.c AS l, y.c AS r, (1000000::HUGEINT * a * a) // (x.c::HUGEINT * y.c) AS s
               FROM part JOIN f x ON x.lang = part.lang AND x.phrase = p1 AND x.m = k JOIN f y ON y.lang = part.lang AND y.phrase = p2 AND y.m = part.m - k),
    best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY s, k) AS nth FROM scored),
    inner_pairs AS (SELECT lang, c, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase
                    FROM cand WHERE m = 3),
    kept AS (SELECT * FROM best b WHERE nth = 1 AND NOT EXISTS
               (SELECT 1 FROM inner_pairs i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.c >= {collocations.INSIDE_PERCENT} * b.a))
    SELECT lang, rank, phrase, a, l, r, n, s::BIGINT AS score FROM
      (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang)
    WHERE rank <= {collocations.TOP}"""


def word_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@register
def op12_token_records(spark, sf_dir):
    path = run_path(spark, "token-records")
    records.write_records(table(spark, sf_dir, "documents"), word_model(), path)
    return records.read_digests(spark, path)


@register
def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardneg.hard_negatives(rows, F.col("id") % 100 == 0)


LLM_ORACLE["op13_hard_negatives"] = """
    WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
          FROM v a JOIN v b ON a.id % 100 = 0 AND b.id <> a.id),
    p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS nth FROM s WHERE same),
    n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
          FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
          WHERE nth <= 5)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
