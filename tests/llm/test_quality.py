import fixtures
from tallywatch.llm import quality

GOOD = "The committee met on Tuesday, and the members agreed to read the second report with care before the vote number {}."
BAD = "BUY!! NOW!! CHEAP%%% pills&&& BUY!! BUY!! | NOW | {} | NOW!!"


def corpus(spark, n=120):
    rows = [(i, (BAD if i % 4 == 0 else GOOD).format(i), "spam" if i % 4 == 0 and i % 8 else "news", "en") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def labels(spark, n=80):
    rows = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(n)] + [(1, None, 0), (None, 1, 0), (9999, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    got = quality.score_quality(corpus(spark), labels(spark)).collect()
    assert len(got) == 120
    assert all(r.keep == (r.doc_id % 4 != 0) for r in got if r.doc_id >= 80)


def test_rows_are_not_broadcast_to_their_sites(spark):
    scored = quality.score_quality(corpus(spark), labels(spark))
    assert len(scored.collect()) == 120
    plan = scored._jdf.queryExecution().executedPlan().toString()  # as it ran: sizes are known only then
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan


def test_rates_shrink_towards_the_level_above(spark):
    rows = [(i, "big", 0.9 if i % 10 else 0.1) for i in range(200)] + [(1000, "tiny", 0.0)]
    sites = spark.createDataFrame([("big", 200, sum(p for _, s, p in rows if s == "big")), ("tiny", 1, 0.0)], "host string, n long, good double")
    from pyspark.sql import functions as F

    weight = quality._prior_weight(sites, F.col("good") / F.col("n"), F.lit(0.8))
    assert 1 <= weight <= quality.MAX_PRIOR_WEIGHT
    scored = {r.doc_id: r for r in quality.score_quality(corpus(spark), labels(spark)).collect()}
    spam, news = scored[4], scored[1]
    assert spam.host_rate < news.host_rate and 0 < spam.host_rate < 1


def test_site_decides_when_the_text_does_not(spark):
    """The same blank evidence ends up on either side of its site's rate."""
    from pyspark.sql import functions as F

    odds = quality._logit(F.lit(0.5)) + quality._logit(F.col("r")) - quality._logit(F.lit(0.5))
    got = [r.q for r in spark.createDataFrame([(0.2,), (0.7,)], "r double").select((1 / (1 + F.exp(-odds))).alias("q")).collect()]
    assert abs(got[0] - 0.2) < 1e-9 and abs(got[1] - 0.7) < 1e-9


def test_edges(spark):
    got = quality.score_quality(fixtures.edge(spark), labels(spark)).collect()
    assert len(got) == len(fixtures.EDGE_ROWS)
    nothing = labels(spark).limit(0)
    assert all(r.keep for r in quality.score_quality(fixtures.edge(spark), nothing).collect())
    assert quality.score_quality(fixtures.empty(spark), labels(spark)).count() == 0
    kept = quality.keep_good(fixtures.edge(spark), nothing)
    assert kept.columns == fixtures.edge(spark).columns and kept.count() == len(fixtures.EDGE_ROWS)
    assert quality.keep_good(corpus(spark), labels(spark)).filter("doc_id % 4 = 0").count() == 0
