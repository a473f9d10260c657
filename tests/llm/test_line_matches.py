"""op3 decides a line by a match of its own with an earlier line, not through other lines."""

import random

import duckdb

from routecraft.llm import lines
from routecraft.llm.queries import op3_line_dedup

SF = "/root/testdata/sf0.01"

# gone: every line after the first of its class, and the first one if a linked class begins earlier
PAIRWISE_SQL = r"""
    WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    line AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM split),
    words AS (SELECT doc_id, line_no, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM line),
    sh AS (SELECT DISTINCT doc_id, line_no, hash(array_to_string(ws[i:i + 4], ' '), len(ws[i:i + 4])) AS s
           FROM (SELECT *, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM words WHERE len(ws) > 0)),
    sets AS (SELECT doc_id, line_no, list_sort(list(s)) AS ss FROM sh GROUP BY ALL),
    class AS (SELECT ss, len(ss) AS n, row_number() OVER () AS k FROM (SELECT DISTINCT ss FROM sets)),
    tok AS (SELECT k, n, unnest(ss) AS s FROM class),
    shared AS (SELECT x.k AS a, y.k AS b, x.n AS n1, y.n AS n2, count(*) AS c FROM tok x JOIN tok y USING (s) WHERE x.k <> y.k GROUP BY ALL),
    links AS (SELECT a, b FROM shared WHERE 100 * c >= 75 * (n1 + n2 - c)),
    spot AS (SELECT k, doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) AS p FROM sets JOIN class USING (ss)),
    opening AS (SELECT k, min(p) AS p FROM spot GROUP BY k),
    early AS (SELECT b AS k, min(p) AS p FROM links JOIN opening ON opening.k = a GROUP BY b)
    SELECT doc_id, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS ids
    FROM spot JOIN opening USING (k) LEFT JOIN early USING (k) WHERE spot.p > least(opening.p, early.p) GROUP BY 1"""


def test_a_line_without_an_earlier_match_stays(spark):
    base = [f"w{i}" for i in range(60)]
    a, b, c = base[:55] + ["left"] * 5, ["right"] * 5 + base[5:], base
    texts = [" ".join(x) for x in (a, b, c)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.removed for r in lines.line_dedup(df).collect()}
    assert got == {0: [], 1: [], 2: [0]}  # c matches both, a and b do not match
    assert {r.doc_id for r in lines.drop_lines(df).collect()} == {0, 1}


def test_drifting_lines_against_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for g in range(6):
        chain = [f"g{g}w{i}" for i in range(50)]
        drift = []
        for _ in range(20):
            chain = chain[1:] + [f"g{g}n{rng.randrange(10**6)}"]
            drift.append(" ".join(chain))
        rng.shuffle(drift)
        texts += drift + drift[:2]
    rng.shuffle(texts)
    sets = [{tuple(t.split()[i:i + 5]) for i in range(46)} for t in texts]
    want = {i: [0] if any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in range(i)) else []
            for i in range(len(texts))}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.removed for r in lines.line_dedup(df).collect()} == want


def test_given_documents_against_pairwise_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = dict(con.sql(PAIRWISE_SQL).fetchall())
    got = {r.doc_id: r.removed_lines for r in op3_line_dedup(spark, SF).collect() if r.removed_lines}
    assert got == want


def test_crowded_tokens_leave_the_prefixes(spark):
    # 60 sets of eight tokens, three of which all have in common and are the first by hash
    sets = spark.createDataFrame([(k, 8, [1, 2, 3, *range(100 * k, 100 * k + 5)]) for k in range(1, 61)]
                                 + [(100, 4, [7, 8, 9, 10])], "k bigint, n int, toks array<bigint>")
    pref = {r.k: r.pref for r in lines._ranked(sets).collect()}
    assert pref == {k: [100 * k, 100 * k + 1, 100 * k + 2] for k in range(1, 61)} | {100: [7, 8]}


def test_only_lines_that_share_first_tokens_are_made_again(spark, monkeypatch):
    texts = [" ".join(f"t{i}w{j}" for j in range(40)) for i in range(30)]
    near = texts[3].replace("t3w39", "other")
    df = spark.createDataFrame([*enumerate([*texts, near, texts[5]])], "doc_id bigint, text string")
    rows, hand_off = {}, lines.hand_off

    def noted(frame, name):
        out = hand_off(frame, name)
        rows[name] = out.count()
        return out
    monkeypatch.setattr(lines, "hand_off", noted)
    assert {r.doc_id: r.removed for r in lines.line_dedup(df).collect()} == {i: [0] if i >= 30 else [] for i in range(32)}
    assert rows["line-sets"] == 32 and rows["line-open-sets"] == 3


def test_classes_that_cannot_match_are_not_made_again(spark, monkeypatch):
    # 20 lines begin with a passage that all have, ten more are five lines twice, one is a near copy of those
    passage = " ".join(f"p{j}" for j in range(9))
    texts = [f"{passage} " + " ".join(f"t{i}w{j}" for j in range(40)) for i in range(20)]
    copies = [" ".join(f"c{i % 5}w{j}" for j in range(30)) for i in range(10)]
    near = copies[2].replace("c2w29", "other")
    df = spark.createDataFrame([*enumerate([*texts, *copies, near])], "doc_id bigint, text string")
    rows, hand_off = {}, lines.hand_off

    def noted(frame, name):
        out = hand_off(frame, name)
        rows[name] = out.count()
        return out
    monkeypatch.setattr(lines, "hand_off", noted)
    assert {r.doc_id: r.removed for r in lines.line_dedup(df).collect()} == {i: [0] if i >= 25 else [] for i in range(31)}
    assert rows["line-sets"] == 31 and rows["line-open-sets"] == 6  # the lines that only begin alike were among them


def test_open_classes_hold_every_match(spark):
    rng = random.Random(11)
    sets = []
    for _ in range(60):  # tokens of a small range, so that unlike sets share some too
        base = rng.sample(range(400), rng.randrange(1, 40))
        sets.append(base)
        for _ in range(3):
            cut = rng.sample(base, max(1, len(base) - rng.randrange(0, 1 + len(base) // 4)))
            sets.append(cut + rng.sample(range(400, 800), rng.randrange(0, 1 + len(base) // 7)))
    sets = sorted({tuple(sorted(s)) for s in sets})
    prefixes = [s[: len(s) - (75 * len(s) + 99) // 100 + 1] for s in sets]
    members = spark.createDataFrame([(h, k, len(sets[k]), p[-1]) for k, p in enumerate(prefixes) for h in p],
                                    "h bigint, k bigint, n int, last bigint")
    got = {r.k for r in lines._alike(members).distinct().collect()}
    full = [set(s) for s in sets]
    want = {i for i, x in enumerate(full) for j, y in enumerate(full) if i != j and 100 * len(x & y) >= 75 * len(x | y)}
    apart = {k for k, p in enumerate(prefixes) if not any(set(p) & set(q) for i, q in enumerate(prefixes) if i != k)}
    assert want and want <= got and not got & apart and len(got) < len(sets) - len(apart)
