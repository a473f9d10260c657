"""URL models: probabilities by brute force, folds by host, bad URLs on hosts without a listed word."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from routecraft.llm import urls as u


def _brute(url, counted):
    """Log-likelihood of a URL by Witten-Bell interpolation over the counted URLs."""
    grams = Counter()
    for x in counted:
        padded = "\x02" * u.ORDER + x
        for i in range(len(x)):
            for order in range(u.ORDER + 1):
                grams[padded[i + u.ORDER - order:i + u.ORDER + 1]] += 1
    total, padded = 0.0, "\x02" * u.ORDER + url
    for i in range(len(url)):
        p = 1 / u.ALPHABET
        for order in range(u.ORDER + 1):
            s = padded[i + u.ORDER - order:i + u.ORDER + 1]
            after = [n for g, n in grams.items() if len(g) == order + 1 and g[:order] == s[:order]]
            kinds = max(len(after), 1)
            p = (grams[s] + kinds * p) / (sum(after) + kinds)
        total += math.log(p)
    return total


def test_scores_by_brute_force(spark):
    rows = [(f"http://{h}.example.org/{p}/{i}", f"{h}.example.org", h in ("badone", "badtwo", "worst"))
            for i, (h, p) in enumerate((h, p) for h in ("badone", "badtwo", "worst", "alpha", "beta", "gamma", "delta") for p in ("a", "é\U0001F600"))]
    df = spark.createDataFrame(rows, "url string, host string, rejected boolean")
    fold = {r.host: r.f for r in df.select("host", F.pmod(F.xxhash64("host", F.lit(7)), F.lit(u.FOLDS)).alias("f")).collect()}
    assert set(fold.values()) == {0, 1}
    got = {r.url: r.score for r in u.score_urls(df).collect()}
    assert len(got) == len(rows)
    for url, host, _ in rows:
        other = [(x, bad) for x, h, bad in rows if fold[h] != fold[host]]
        want = (_brute(url, [x for x, bad in other if bad]) - _brute(url, [x for x, bad in other if not bad])) / len(url)
        assert got[url] == pytest.approx(want, abs=1e-9)


def test_blocks_bad_urls_on_hosts_without_a_word(spark):
    words = ("garden", "travel", "recipes", "history", "physics", "poems", "railway", "birds")
    good = [f"http://{w}{i}.example.org/{lang}/article/{i}.html" for i in range(12) for w in words for lang in ("en", "fr")]
    kinds = ("jackpot-bonus-free-spins", "cheap-tablets-no-prescription", "live-odds-betting-tips", "hot-singles-webcam-chat")
    listed = [f"http://casino{i}.example.org/en/{k}/{i}" for i in range(12) for k in kinds]
    # a larger share than the threshold may reject of trusted URLs
    planted = [f"http://{w}s.example.org/en/{k}/77" for w, k in zip(words, kinds)]
    assert len(planted) > 2 * u.MAX_FALSE * (len(good) + len(planted))
    long = "http://garden99.example.org/en/" + "article/" * 2000
    rows = list(enumerate([*good, *listed, *planted, long, good[0], "http://", "nothing", None]))
    got = {r.page_id: r for r in u.judge(spark.createDataFrame(rows, "page_id bigint, url string").select(
        "*", F.lit(0).alias("score"), F.lit(0).alias("rejected"), F.lit("x").alias("host"))).collect()}
    verdict = {url: got[i].verdict for i, url in rows}
    assert {verdict[x] for x in planted} == {"block"}
    assert [(x, got[i].score) for i, x in rows if x in good and got[i].verdict != "allow"] == []
    assert verdict[long] == "allow"
    assert {verdict[x] for x in ("http://", "nothing", None)} == {"allow"}


def test_only_rules_block_without_trusted_urls(spark):
    rows = [(1, "http://casino.example.org/en/1"), (2, "http://casino2.example.org/en/1"), (3, "http://good.example.org/en/1"), (4, "http://x.net/1")]
    got = {r.page_id: r.verdict for r in u.judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "block"}
