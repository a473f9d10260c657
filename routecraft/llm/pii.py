"""Personal data by weak supervision (operator 6), on DataFrame functions only.

Regular expressions find spans: the base kinds, which always stay when their
checks pass, and wider candidates (numbers that fail a check, national phone
numbers, secrets). Three labelers vote on each candidate: the pattern's own
check, a gazetteer, and the context around it. Expectation-maximisation over the
counts of vote patterns, kind by kind, estimates how far each labeler can be
relied on; its posteriors train a span classifier (naive Bayes over shape and
surroundings), which decides on the candidates that are not base spans.

Only counts of a fixed number of vote patterns and feature values reach the
driver; spans are found and decided where their document is.

Defined results: null counts as empty and has no spans; matches are leftmost
and non-overlapping per kind, a failing match is dropped without retry; a
candidate that overlaps a base span is not added; added spans that overlap each
other all stay, ordered by start, then kind as listed; rows are judged one by one,
so ties and repeated rows get equal spans; an empty table gives an empty result;
other columns are never read. Whole texts are searched; the patterns are
possessive where a long run could make them retry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hand_off

KINDS = ("email", "ip", "card", "phone")
# Same matches as the plain patterns: a run either matches from its start or not at all.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "contact": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?i:\b(?:password|passwd|pwd|token|api[_-]?key|secret)[ ]{0,3}[=:][ ]{0,3}[\"']?[a-z0-9_+/-]{8,64})|\bAKIA[0-9A-Z]{16}\b",
}
TRIGGERS = {"email": "@", "ip": ".", "phone": "+"}
GAZETTEER = {
    "email": r"(?i)\.(com|net|org|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|10\.|127\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-9]\.)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+(1|33|34|39|44|49|7|81|86|91)",
    "contact": r"^\(?[2-9][0-9]{2}",
    "secret": r"(?i)^(password|passwd|token|api|secret|AKIA)",
}
CONTEXT = r"(?i)(mail|contact|write|call|phone|tel|fax|mobile|card|visa|pay|host|server|address|login|user|key|auth)[^a-z]{0,3}$"
AROUND = 24             # characters of context
MIN_CARD_DIGITS = 12    # shorter digit groups are no card candidates
ACCEPT = 0.9
ROUNDS = 40


_SPAN = "struct<kind: string, start: int, end: int, match: string, before: string, after: string>"
_CHUNK = f"struct<at: int, tail: string, out: array<{_SPAN}>>"


def _last(text: Column) -> Column:
    return F.substring(text, -AROUND, AROUND)


def _chunks(items: Column) -> Column:
    """A non-empty array cut into about sqrt(n) arrays of about sqrt(n) entries. Appending inside
    an aggregate copies what is there, so n entries cost n * sqrt(n) this way instead of n * n."""
    wide = F.ceil(F.sqrt(F.size(items))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / wide).cast("int")), lambda i: F.slice(items, i * wide + 1, wide))


def _pieces(kind: str, text: Column) -> Column:
    """For each match of a pattern: the length and last characters of the text between it and the
    match before, the match, and the first characters of what follows; null without a match."""
    pattern = PATTERNS[kind]
    run = text.contains(TRIGGERS[kind]) if kind in TRIGGERS else text.rlike("[0-9]")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(
        F.length(g).alias("n"), _last(g).alias("last"), F.substring(g, 1, 1).alias("first")))
    n = F.size(found)
    return F.when(run & text.rlike(pattern), F.arrays_zip(
        F.slice(gaps, 1, n).alias("gap"), found.alias("m"), F.slice(gaps, 2, n).alias("rest"), F.slice(found, 2, n).alias("next")))


def _located(kind: str, pieces: Column) -> Column:
    """Matches as structs (kind, start, end, match, before, after), by code points. The characters
    around a match come from the pieces: by position they would be counted from the text's start."""
    def add(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]["n"]
        before = _last(F.concat(s["tail"], x["gap"]["last"]))
        after = F.substring(F.concat(x["rest"]["first"], F.coalesce(F.substring(x["next"], 1, 1), F.lit(""))), 1, 1)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["m"])).alias("end"),
                        x["m"].alias("match"), before.alias("before"), after.alias("after"))
        return F.struct((start + F.length(x["m"])).alias("at"), _last(F.concat(before, _last(x["m"]))).alias("tail"),
                        F.concat(s["out"], F.array(span)).alias("out"))

    def add_chunk(done: Column, chunk: Column) -> Column:
        end = F.get(done, F.size(done) - 1)
        first = F.struct(F.coalesce(end["at"], F.lit(0)).alias("at"), F.coalesce(end["tail"], F.lit("")).alias("tail"),
                         F.array().cast(f"array<{_SPAN}>").alias("out"))
        return F.concat(done, F.array(F.aggregate(chunk, first, add)))

    none = F.array().cast(f"array<{_SPAN}>")
    done = F.aggregate(_chunks(pieces), F.array().cast(f"array<{_CHUNK}>"), add_chunk)
    return F.coalesce(F.flatten(F.transform(done, lambda c: c["out"])), none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    last_first = F.reverse(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(
        i % 2 == 1, F.ascii(F.substring(last_first, i, F.lit(1))) - 48).otherwise(
        F.lit(2) * (F.ascii(F.substring(last_first, i, F.lit(1))) - 48)
        - F.when(F.ascii(F.substring(last_first, i, F.lit(1))) > 52, 9).otherwise(0)))
    return total % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    """Whether a match of a base kind passes its check."""
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    d = _digits(m)
    return (F.when(kind == "email", True)
            .when(kind == "ip", m.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
            .when(kind == "card", F.length(d).between(14, 19) & _luhn(d))
            .when(kind == "phone", F.length(d).between(10, 15))
            .otherwise(False))


def _vote(positive: Column, negative: Column) -> Column:
    return F.when(positive, "+").when(negative, "-").otherwise("0")


def _candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, order, start, end, base, votes, features) of every row."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the pieces are columns of their own: inside a lambda they would be made again for each entry
    raw = d.select("doc_id", *[_pieces(k, F.col("text")).alias(k) for k in PATTERNS])
    raw = raw.withColumn("found", F.concat(*[_located(k, F.col(k)) for k in PATTERNS]))
    raw = raw.withColumn("found", F.filter("found", lambda s: (s["kind"] != "card") | (F.length(_digits(s["match"])) >= MIN_CARD_DIGITS)))

    def describe(s: Column) -> Column:
        kind, m = s["kind"], s["match"]
        before = s["before"]
        left, right = F.substring(before, -1, 1), s["after"]
        known = F.coalesce(*[F.when(kind == k, m.rlike(p)) for k, p in GAZETTEER.items()])
        glued = left.rlike("[A-Za-z0-9]") | right.rlike("[A-Za-z0-9]")
        own = _valid(kind, m)
        shaped = own | (kind == "contact") | ((kind == "secret") & m.rlike("[0-9]"))
        cls = lambda c: F.when(c == "", "none").when(c.rlike("[0-9]"), "digit").when(c.rlike("[A-Za-z]"), "letter").when(c.rlike(r"\s"), "blank").otherwise("sign")
        key = lambda name, v: F.concat(kind, F.lit(f":{name}:"), v)
        return F.struct(
            kind.alias("kind"), F.array_position(F.array(*[F.lit(k) for k in PATTERNS]), kind).cast("int").alias("order"),
            s["start"].alias("start"), s["end"].alias("end"), own.alias("base"),
            F.concat(kind, F.lit(":"), _vote(shaped, ~shaped), _vote(known, ~known), _vote(before.rlike(CONTEXT), glued)).alias("votes"),
            F.array(key("left", cls(left)), key("right", cls(right)),
                    key("length", F.least(F.floor(F.length(m) / 4), F.lit(20)).cast("string")),
                    key("digits", F.least(F.length(_digits(m)), F.lit(24)).cast("string")),
                    key("own", own.cast("string"))).alias("features"))

    return raw.select("doc_id", F.transform("found", describe).alias("spans"))


def reliabilities(counts: dict[str, int]) -> dict[str, float]:
    """Posterior of each vote pattern ("kind:votes") by expectation-maximisation over
    their counts; labelers are taken as independent given the truth."""
    out = {}
    for kind in sorted({k.split(":")[0] for k in counts}):
        rows = {k.split(":")[1]: n for k, n in counts.items() if k.split(":")[0] == kind}
        post = {v: (0.5 + v.count("+")) / (1 + v.count("+") + v.count("-")) for v in rows}
        for _ in range(ROUNDS):
            pos = sum(rows[v] * post[v] for v in rows)
            neg = sum(rows[v] * (1 - post[v]) for v in rows)
            rate = {}
            for i in range(3):
                for s in "+-0":
                    # pseudo-counts say that a labeler is more often right than wrong
                    yes = sum(rows[v] * post[v] for v in rows if v[i] == s) + {"+": 4, "-": 1, "0": 1}[s]
                    no = sum(rows[v] * (1 - post[v]) for v in rows if v[i] == s) + {"+": 1, "-": 4, "0": 1}[s]
                    rate[i, s] = math.log(yes / (pos + 6)) - math.log(no / (neg + 6))
            prior = math.log((pos + 1) / (neg + 1))
            post = {v: 1 / (1 + math.exp(-max(-30.0, min(30.0, prior + sum(rate[i, s] for i, s in enumerate(v)))))) for v in rows}
        out |= {f"{kind}:{v}": p for v, p in post.items()}
    return out


def _lookup(table: dict[str, float], key: Column) -> Column:
    if not table:
        return F.lit(0.0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), key), F.lit(0.0))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (sorted arrays of structs start, order, end, kind) of every row."""
    found = hand_off(_candidates(docs), "pii-spans")
    each = found.select(F.explode("spans").alias("s"))
    votes = {r["votes"]: r["n"] for r in each.groupBy(F.col("s.votes").alias("votes")).agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior = reliabilities(votes)
    p = _lookup(posterior, F.col("s.votes"))
    sums = (each.select(p.alias("p"), F.explode(F.col("s.features")).alias("f"))
            .groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect())
    total = {}  # kind and feature: sums over its values
    for r in sums:
        k = r["f"].rpartition(":")[0]
        y, n = total.get(k, (0.0, 0.0))
        total[k] = (y + r["yes"], n + r["no"])
    weight = {r["f"]: math.log((r["yes"] + 1) / (total[r["f"].rpartition(":")[0]][0] + 2))
              - math.log((r["no"] + 1) / (total[r["f"].rpartition(":")[0]][1] + 2)) for r in sums}
    prior = {k.split(":")[0]: math.log((y + 1) / (n + 1)) for k, (y, n) in total.items()}

    def accepted(s: Column) -> Column:
        score = F.aggregate(s["features"], _lookup(prior, s["kind"]), lambda a, f: a + _lookup(weight, f))
        return score > math.log(ACCEPT / (1 - ACCEPT))

    slim = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    # base spans in order of their starts, in chunks with their reach: a candidate looks only into chunks that it touches
    base = found.withColumn("b", F.array_sort(slim(F.filter("spans", lambda s: s["base"]))))
    reach = F.transform(_chunks(F.col("b")), lambda c: F.struct(F.get(c, F.lit(0))["start"].alias("lo"), F.array_max(
        F.transform(c, lambda b: b["end"])).alias("hi"), c.alias("own")))
    base = base.withColumn("reach", F.when(F.size("b") > 0, reach))
    touches = lambda s: F.exists("reach", lambda c: (c["lo"] < s["end"]) & (s["start"] < c["hi"]) & F.exists(
        c["own"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    extra = F.filter("spans", lambda s: ~s["base"] & accepted(s) & ~F.coalesce(touches(s), F.lit(False)))
    return base.select("doc_id", F.col("b").alias("base"), F.array_sort(F.concat(F.col("b"), slim(extra))).alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
