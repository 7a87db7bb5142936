"""URL filter against plain Python, and the Bloom filter's promises."""

from pyspark.sql import functions as F

from ragframe.llm import urlfilter as UF
from ragframe.llm.catalog import ORACLES, QUERIES, URL_RULES


def slow(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h) + len(p), len(h), h, p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2] + best[3], best[4] if best else "allow"


URLS = ["http://a.org/x", "http://example.org/es/1", "https://www.EXAMPLE.org/en/17?x=/es/", "http://example.org/en/2", "http://xexample.org/es/", "http://x.com/fr/", "http://x.com/de/#a", "http://com/de/",
        "http://org", "http://org?/", "org/x", None, "", "://", "a://b://c/d", "http://ÄÖ.org/é?q", "http://a.org#/x", "http://.org/", "http://a..org/", "http://x.com:80/fr/", "http://u@x.com/fr/x\ny"]


def judged(spark, urls, rules, **kw):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    df = spark.createDataFrame(rules, "host string, path string, verdict string")
    return [(r.host, r.path, r.rule, r.verdict) for r in UF.judge_urls(pages, df, **kw).orderBy("page_id").collect()]


def test_against_plain_python(spark):
    assert judged(spark, URLS, URL_RULES) == [slow(u, URL_RULES) for u in URLS]


def test_many_rules(spark):
    rules = [(f"h{i}.net", f"/{'ab'[i % 2] * (i % 5)}", ("allow", "block")[i % 2]) for i in range(600)] + [("h3.net", "/", "block"), ("h3.net", "/", "allow"), ("", "/", "block"), ("h9.net", None, "block")]
    urls = [f"http://w.h{i}.net/{'ab'[i % 2] * (i % 7)}/z" for i in range(900)]
    clean = [(h, p or "", v) for h, p, v in rules if h]
    assert judged(spark, urls, rules) == [slow(u, clean) for u in urls]


def test_bloom_filter_passes_all_rules_and_few_others(spark):
    n = 20_000
    rules = spark.range(n).select(F.concat(F.lit("h"), "id").alias("rule_host"), F.lit("/").alias("rule_path"))
    blocks = n * UF.BITS_PER_RULE // 512 + 1
    words = UF.bloom(rules, blocks)

    def passed(keys):
        out = keys.withColumn("block", UF._block(blocks)).join(words, "block")
        for i in range(UF.PROBES):
            out = out.where(F.getbit(F.element_at("words", F.shiftright(UF._bit(i), 6) + 1), UF._bit(i).bitwiseAND(F.lit(63))) == 1)
        return out.count()
    assert passed(rules) == n
    assert passed(rules.withColumn("rule_path", F.lit("/other"))) < n * 0.01


def test_registered_query_and_odd_tables(spark):
    import duckdb
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLES['op10_url_filter']})").fetchall()
    got = [tuple(r) for r in QUERIES["op10_url_filter"](spark, sf).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, "http://a.com/" + "y" * 500_000)], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert UF.judge_urls(pages, rules).where("rule = 'org/'").count() == 2
    assert UF.judge_urls(pages, rules.limit(0), default="block").where("verdict = 'block'").count() == 3
    assert UF.judge_urls(pages.limit(0), rules).count() == 0
