"""URL filter by a character language-model ratio (operator 7).

Rules decide the URLs they fit. The others are judged by two variable-order
Markov models of characters (orders 0 to ``ORDER``, Witten-Bell interpolation),
one of rejected and one of accepted URLs: the difference of log-likelihoods per
character, against a calibrated threshold.

Rejected URLs to learn from: those of hosts that have a word of ``REJECT_WORDS`` or whose
URLs are all blocked by rules; a blocked path of a host with other URLs teaches nothing;
accepted ones: all others. Hosts are dealt into two folds by
a hash, and a URL is scored by models that count the other fold only, so neither
it nor any URL of its host speaks for it. The threshold is set on the URLs that a rule
allows, scored in the same way: at most ``MAX_FALSE`` of them lie above it. The
URLs being judged have no part in it. A URL counts once, however many rows have it.
Bad URLs on hosts without a word count as accepted ones in the other fold, so they
are found as long as they are few there against the rejected ones of their kind.

All URLs are counted, whole; what is gathered grows with the table. Everything is
joined and aggregated by n-gram; only the calibration histogram (``BINS`` rows)
reaches the driver.

Defined results: a null URL, or one without ``://``, has empty host and path, no
rule, and is allowed; a URL is one text, so repeated rows get equal verdicts;
if a class or the URLs allowed by a rule are empty, nothing but rules blocks; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, hand_off

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
REJECT_WORDS = ("casino", "pills", "bets", "spam", "porn", "xxx", "ads-", "adserver", "malware", "phish")
ORDER = 4
ALPHABET = 256          # the uniform model below order 0
FOLDS = 2
MAX_FALSE = 0.005       # share of the URLs allowed by a rule that the threshold may reject
BINS = 400
SPAN = 4.0              # scores beyond +-SPAN share the outer bins


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    found = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise("")
    return (fold_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        at, slash, under = r.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + under)
        rule = F.when(fits, r) if rule is None else rule.when(fits, r)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def _grams(urls: DataFrame) -> DataFrame:
    """One row per character of a URL (id, fold, rejected) with its context of ORDER characters, padded."""
    padded = F.concat(F.lit("\u0002" * ORDER), F.col("url"))
    at = F.explode_outer(F.sequence(F.lit(1), F.length("url")))
    return (urls.select("id", "fold", "rejected", padded.alias("u"), at.alias("i"))
            .select("id", "fold", "rejected", F.substring("u", F.col("i"), F.lit(ORDER + 1)).alias("g")))


# the models: a class, and the fold that is left out
_MODELS = [(rejected, fold) for rejected in (True, False) for fold in range(FOLDS)]


def _models(counts: DataFrame) -> DataFrame:
    """g, p0, p1, ...: the probability of the last character of each longest n-gram (of all URLs)
    after the ones before it, in each of ``_MODELS``, all in one pass over each order."""
    each = range(len(_MODELS))
    own = counts.groupBy("g").agg(*[
        F.sum(F.when((F.col("rejected") == rejected) & (F.col("fold") != fold), F.col("n")).otherwise(0)).alias(f"n{m}")
        for m, (rejected, fold) in enumerate(_MODELS)])
    own = hand_off(own, "url-own")
    p = own.select("g", *[F.lit(1.0 / ALPHABET).alias(f"p{m}") for m in each])
    for order in range(ORDER + 1):
        tail = lambda c: F.substring(c, ORDER + 1 - order, order + 1)  # noqa: B023, E731
        level = own.groupBy(tail(F.col("g")).alias("s")).agg(*[F.sum(f"n{m}").alias(f"c{m}") for m in each])
        context = (level.groupBy(F.substring("s", 1, order).alias("x"))
                   .agg(*[F.sum(f"c{m}").alias(f"all{m}") for m in each],
                        *[F.greatest(F.sum((F.col(f"c{m}") > 0).cast("long")), F.lit(1)).alias(f"kinds{m}") for m in each]))
        level = level.withColumn("x", F.substring("s", 1, order)).join(context, "x").drop("x")
        p = p.withColumn("s", tail(F.col("g"))).join(level, "s").select("g", *[
            ((F.col(f"c{m}") + F.col(f"kinds{m}") * F.col(f"p{m}")) / (F.col(f"all{m}") + F.col(f"kinds{m}"))).alias(f"p{m}") for m in each])
    return p


def score_urls(urls: DataFrame) -> DataFrame:
    """The distinct URLs ``urls`` (url, host, rejected: the class to learn from, and any other
    columns) with score: the difference of log-likelihoods (rejected minus accepted) per
    character, in the models of the other fold's hosts."""
    urls = urls.where(F.length("url") > 0).select(
        "*", F.xxhash64("url").alias("id"), F.pmod(F.xxhash64("host", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold"))
    grams = hand_off(_grams(urls), "url-grams")
    counts = hand_off(grams.groupBy("g", "fold", "rejected").agg(F.count(F.lit(1)).alias("n")), "url-counts")
    log = lambda rejected, fold: F.log(f"p{_MODELS.index((rejected, fold))}")
    ratio = hand_off(_models(counts).select("g", *[(log(True, f) - log(False, f)).alias(f"d{f}") for f in range(FOLDS)]), "url-model")
    # a common n-gram is joined once for each of the URL parts that it is summed up over
    spread = grams.groupBy("id", "fold", "g").agg(F.count(F.lit(1)).alias("c"))
    d = F.coalesce(*[F.when(F.col("fold") == f, F.col(f"d{f}")) for f in range(FOLDS)])
    total = (spread.join(ratio, "g").groupBy("id").agg(F.sum(d * F.col("c")).alias("s"), F.sum("c").alias("l")))
    return urls.join(total, "id").withColumn("score", F.col("s") / F.col("l")).drop("id", "fold", "s", "l")


def threshold(scored: DataFrame) -> float:
    """The least score of a bin's edge above which at most ``MAX_FALSE`` of the URLs that are
    ``trusted`` lie; infinite without any, or without a rejected URL to learn from."""
    width = 2 * SPAN / BINS
    bin_ = F.least(F.greatest(F.floor((F.col("score") + SPAN) / width), F.lit(0)), F.lit(BINS - 1)).cast("int")
    rows = scored.where("trusted or rejected").groupBy(bin_.alias("bin"), "trusted").agg(F.count(F.lit(1)).alias("n")).collect()
    trusted = {r["bin"]: r["n"] for r in rows if r["trusted"]}
    if not trusted or len(trusted) == len(rows):
        return float("inf")
    allowed, above, edge = MAX_FALSE * sum(trusted.values()), 0, BINS
    while edge > BINS // 2 and above + trusted.get(edge - 1, 0) <= allowed:  # never below a ratio of 1
        edge -= 1
        above += trusted.get(edge, 0)
    return edge * width - SPAN


def judge(pages: DataFrame, rules=RULES, reject_words=REJECT_WORDS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides or there is no URL)."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("rule", rule).withColumn("by_rule", verdict)
    bad = F.col("host").rlike("|".join(w.replace("-", r"\-") for w in reject_words)) if reject_words else F.lit(False)
    blocked = F.coalesce(F.col("by_rule") == "block", F.lit(False))
    distinct = (parts.where("host <> '' or path <> ''")
                .select("url", "host", blocked.alias("blocked"), bad.alias("bad"),
                        F.coalesce(F.col("by_rule") == "allow", F.lit(False)).alias("trusted")).distinct())
    hosts = distinct.groupBy("host").agg(F.min("blocked").alias("closed"))
    learned = (distinct.join(hosts, "host").where("bad or closed or not blocked")
               .select("url", "host", F.expr("bad or closed").alias("rejected"), F.expr("trusted and not bad").alias("trusted")))
    scored = hand_off(score_urls(learned), "url-scores")
    limit = threshold(scored)
    return (parts.join(scored.select("url", "score"), "url", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("by_rule", F.when(F.col("score") > limit, "block").otherwise("allow")).alias("verdict"),
                    F.when(F.col("rule").isNull(), F.col("score")).alias("score")))
