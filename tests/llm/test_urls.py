import re

import pytest
from helpers import read
from signals.llm import urls

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
URLS = [None, "", "no scheme", "http://", "http://a.org", "http://a.org/", "HTTP://A.Example.ORG/es/x?q#f", "x://example.org/en/12",
        "x://notexample.org/en/12", "http://b.com/fr/1", "http://b.com/FR/1", "http://b.com?x=/fr/", "http://com/de/", "http://ÄA.com/de/",
        "http://a://b.org/", "http://x.net/" + "9" * 30_000, "http://x.net/a?b=1&c=2#d", "http://x.net/a?b=1&c=2#d"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule_of(host, path):
    fits = [(len(t), t, v) for t, v in RULES for h, p in [t.split("/", 1)]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rows = {r["page_id"]: r for r in urls.query(spark, df).collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = parts(u)
        rule, verdict = rule_of(host, path)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule)
        assert rows[i]["verdict"] in ("allow", "block") and (verdict is None or rows[i]["verdict"] == verdict)
        assert 0 <= rows[i]["score"] <= 1


def test_all_pages(spark):
    df = read(spark, "pages", "/root/testdata/sf0.01")
    rows = urls.query(spark, df).collect()
    assert len(rows) == 250
    for r, u in zip(sorted(rows, key=lambda r: r["page_id"]), [x["url"] for x in df.orderBy("page_id").collect()]):
        host, path = parts(u)
        rule, verdict = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or verdict == r["verdict"])


def test_trees_learn_from_labelled_urls(spark):
    bad = [f"http://x{i}.cheap-pills-{i}.test/{i}?a={i}&b=2&c=3&d=4" for i in range(150)]
    good = [f"https://site{i}.test/page" for i in range(150)]
    labelled = spark.createDataFrame([(u, "block") for u in bad[:100]] + [(u, "allow") for u in good[:100]], "url string, verdict string")
    pages = spark.createDataFrame([(u,) for u in bad[100:] + good[100:]], "url string")
    out = {r["url"]: r["verdict"] for r in urls.judge(pages, rules=(), labelled=labelled).collect()}
    assert sum(out[u] == "block" for u in bad[100:]) >= 48 and sum(out[u] == "allow" for u in good[100:]) >= 48


def test_entropy(spark):
    from pyspark.sql import functions as F
    r = spark.createDataFrame([("",), ("aaaa",), ("abab",), ("abcd",)], "u string").select(urls.entropy(F.col("u")).alias("e")).collect()
    assert [x["e"] for x in r] == [0.0, 0.0, 1.0, 2.0]


def test_empty_one_sided_and_clashing(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.query(spark, empty).count() == 0
    only = spark.createDataFrame([(1, "http://a.org/"), (2, "http://b.net/")], "page_id long, url string")
    assert {r["verdict"] for r in urls.query(spark, only).collect()} == {"allow"}
    blocked = spark.createDataFrame([(1, "http://a.com/de/"), (2, "http://b.net/")], "page_id long, url string")
    assert {r["verdict"] for r in urls.query(spark, blocked).collect()} == {"block"}
    clash = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr(
        "*", "'h' AS host", "1 AS verdict", "2 AS label", "3 AS depth", "4 AS probability", "5 AS features")
    out = urls.judge(clash)
    assert out.count() == len(URLS)
    assert out.columns == ["page_id", "url", "label", "depth", "probability", "features", "host", "path", "rule", "verdict", "score"]


def test_too_many_rules(spark):
    with pytest.raises(ValueError):
        urls.ruled(tuple(urls.Rule(f"h{i}/", "allow") for i in range(urls.MAX_RULES + 1)))


def test_sample_is_bounded_and_holds_both_verdicts(spark, monkeypatch):
    """One URL in nearly all rows, and a rare verdict: distinct URLs are drawn, of each verdict its share."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(urls, "TRAIN_ROWS", 200)
    hot = spark.range(20_000).select(F.lit("http://hot.test/a").alias("url"), F.lit("block").alias("verdict"))
    many = spark.range(3_000).select(F.concat(F.lit("http://n"), "id", F.lit(".test/")).alias("url"), F.lit("block").alias("verdict"))
    few = spark.range(7).select(F.concat(F.lit("http://ok"), "id", F.lit(".test/")).alias("url"), F.lit("allow").alias("verdict"))
    for seed in range(6):
        rows = urls.training_sample(hot.unionByName(many).unionByName(few), seed).collect()
        assert len({r["url"] for r in rows}) == len(rows) == 107 and sum(r["verdict"] == "allow" for r in rows) == 7
    hashes = {r["url"]: r["h"] for r in many.select("url", F.pmod(F.xxhash64("url", F.lit(3)), F.lit(1 << 40)).alias("h")).collect()}
    got = {r["url"] for r in urls.training_sample(many, 3).collect()}
    assert got == set(sorted(hashes, key=hashes.get)[:100])


def test_repeated_url_does_not_decide_the_others(spark):
    """The case of one URL in 99 % of the rows: URLs without a rule are still told apart."""
    from pyspark.sql import functions as F
    hot = spark.range(20_000).select(F.lit("http://w.example.com/de/1").alias("url"))
    block = spark.range(60).select(F.concat(F.lit("http://s"), "id", F.lit(".com/de/9?a=1&b=2&c="), "id").alias("url"))
    allow = spark.range(60).select(F.concat(F.lit("https://s"), "id", F.lit(".com/fr/x")).alias("url"))
    new = spark.createDataFrame([("http://s7.net/de/9?a=1&b=2&c=3",), ("https://s7.net/fr/x",)], "url string")
    for seed in (10, 11):
        rows = {r["url"]: r["verdict"] for r in urls.judge(hot.unionByName(block).unionByName(allow).unionByName(new), seed=seed).distinct().collect()}
        assert rows["http://s7.net/de/9?a=1&b=2&c=3"] == "block" and rows["https://s7.net/fr/x"] == "allow"
