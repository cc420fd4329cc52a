import pytest
from pyspark.sql import functions as F

from tallywatch.llm.queries import URL_RULES
from tallywatch.llm.url_filter import build_cascade, is_listed, judge_urls


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, key string, host string")


def test_rules_hosts_and_paths(spark):
    urls = ["http://A.Example.NET/en/1?q=/x", "http://example.net/de/", "https://b.net", "ftp://net/", "http://x.example.com/de/a#t",
            "http://notexample.com/de/", "http://y.org/fr/2", "no scheme", None, "", "http://a\nb.org/fr/x", "http://c.org?x/fr/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages(spark, urls), URL_RULES).collect()}
    assert got == {
        0: ("a.example.net", "/en/1", "example.net/en/", "allow"), 1: ("example.net", "/de/", "net/", "block"),
        2: ("b.net", "", None, "allow"), 3: ("net", "/", "net/", "block"), 4: ("x.example.com", "/de/a", "example.com/de/", "block"),
        5: ("notexample.com", "/de/", None, "allow"), 6: ("y.org", "/fr/2", "org/fr/", "allow"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("a\nb.org", "/fr/x", "org/fr/", "allow"), 11: ("c.org", "", None, "allow")}


@pytest.mark.parametrize(("inline", "shard_keys"), [(1 << 24, 1 << 16), (0, 50)])
def test_cascade_is_exact(spark, inline, shard_keys):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("n"))
    listed = universe.filter("n % 7 = 3").unionByName(universe.filter("n = 3"))
    cascade = build_cascade(listed, universe, shard_keys=shard_keys, inline_bytes=inline)
    assert len(cascade.levels) > 1
    asked = universe.unionByName(universe.filter("n < 5")).unionByName(spark.sql("select string(null) key, 0L n"))
    got = is_listed(asked, F.col("key"), cascade, "found", inline_bytes=inline).collect()
    assert len(got) == 3006
    assert all(r.found == (r.key is not None and r.n % 7 == 3) for r in got)


def test_empty_tables(spark):
    none = pages(spark, ["x"]).limit(0)
    assert judge_urls(none, URL_RULES, F.col("host") == "x").count() == 0
    assert judge_urls(pages(spark, ["http://h/a", "http://h/a", None]), [], F.col("host") == "h").filter("verdict = 'block'").count() == 2
