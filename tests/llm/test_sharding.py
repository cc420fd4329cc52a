import itertools
import zlib

import pytest
from pyspark.sql import functions as F

import fixtures
from tallywatch.llm import sharding


@pytest.mark.parametrize(("dims", "bits"), [(1, 3), (2, 3), (3, 2), (4, 1)])
def test_curve_visits_each_cell_once_and_steps_to_a_neighbour(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    rows = spark.createDataFrame(cells, ", ".join(f"x{i} int" for i in range(dims)))
    place = sharding.hilbert_index([F.col(f"x{i}") for i in range(dims)], bits)
    along = {r["p"]: tuple(r)[:dims] for r in rows.withColumn("p", place).collect()}
    assert sorted(along) == list(range(len(cells)))
    for p in range(1, len(cells)):
        assert sum(abs(a - b) for a, b in zip(along[p - 1], along[p], strict=True)) == 1


def test_steps_are_shares_of_smaller_rows(spark):
    values = [None] * 3 + [5] * 6 + [1, 2, 2, 9, 40, -7, 40]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    least, number = sharding.steps(rows, "v", 3)
    got = {(r.v, r.q) for r in rows.select("v", sharding.quantised(F.col("v"), least, number).alias("q")).collect()}
    below = lambda v: sum(x is None or x < v for x in values)
    assert got == {(v, 0 if v is None else below(v) * 8 // len(values)) for v in values}


def check_rows_law(digest, rows):
    got = digest.collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(
        ((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    shards = {}
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    counts = [len(shards.get(k, [])) for k in range(8)]
    assert max(counts) - min(counts) <= 1 and set(shards) <= set(range(8))
    return got


def test_edges(spark):
    rows = fixtures.EDGE_ROWS + [(20, "same"), (20, "same"), (20, "same")]
    docs = fixtures.table(spark, rows, extra=(*fixtures.CLASHES, "shard", "slot", "curve", "position", "_at", "mark", "id"))
    check_rows_law(sharding.shard_digest(docs, ["source", "lang", "n"]), rows)
    assert sharding.shard_digest(fixtures.empty(spark), ["source", "lang"]).count() == 0


def test_runs_of_the_curve_in_order(spark):
    rows = [(i, f"t{i}", f"s{i * 7 % 11}", f"l{i % 3}", i * 13 % 101) for i in range(500)] + [
        (1000 + i, "hot", "s3", "l1", 50) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    placed = sharding.place(docs, ["source", "lang", "n_chars"], shards=8).collect()
    order = sorted(placed, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in placed)
    hot = [r for r in order if r.row.text == "hot"]
    assert len({r.curve for r in hot}) == 1 and len({r.shard for r in hot}) > 1  # a frequent cell is cut like any other


def test_filters_on_each_column_skip_shards(spark):
    rows = [(i, f"t{i}", i * 7919 % 1000, i * 104729 % 997) for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a long, b long")
    path = sharding.write_shards(docs, ["a", "b"])
    stored = sharding.read_shards(spark, path, docs)
    ranges = stored.groupBy("shard").agg(*(f(f"row.{c}").alias(f"{c}_{n}") for c in "ab" for n, f in (("low", F.min), ("high", F.max)))).collect()
    opened = lambda c, v: sum(r[f"{c}_low"] <= v <= r[f"{c}_high"] for r in ranges)
    # In any one column's order a filter on the other would open all eight.
    assert sum(opened(c, v) for c in "ab" for v in range(0, 1000, 50)) <= 4.5 * 40
    assert stored.select("row.*").exceptAll(docs).isEmpty() and stored.count() == 8000
