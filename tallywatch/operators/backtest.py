"""Rules evaluated at every step over history, with cool-down, by sweeping the points at which something changes.

A log counts at the steps from its own time to its time plus the window, so it adds one to a count at a first step
and takes one away after a last step. Between two such changes every count, and so every verdict, stays as it is.
Changes are turned into counts per question, counts into verdicts per condition, verdicts into runs of steps at
which a whole rule is met, and each stage hands on only the steps at which its own result changes. No step is
looked at where nothing happens, however fine the steps are.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.functions.timing import MICROS_PER_MINUTE, as_ntz, within
from tallywatch.operators.rules import (
    COOLDOWN_MINUTES, SPELLINGS, anomaly_onsets, facets_of_asks, facets_of_rows, parse_rules, probes_of, rule_profile,
    select_rules, total_over_sources, with_keyword_hits,
)
from tallywatch.session import materialize

_SPAN_US = 24 * 60 * MICROS_PER_MINUTE

# Verdict of a condition from the running sums of its question. A rule whose row comes several times counts its logs as
# often, and a keyword once for each pair of its rows.
_MET = """coalesce(CASE type
  WHEN 'error_count' THEN {0}.hits * copies >= threshold
  WHEN 'error_rate' THEN {0}.total > 0 AND try_divide({0}.hits, {0}.total) >= threshold
  WHEN 'log_level' THEN {0}.hits > 0
  WHEN 'keyword_match' THEN CASE WHEN match_all THEN {0}.matched * copies * copies = n_keywords ELSE {0}.matched > 0 END
  WHEN 'no_logs' THEN {0}.total = 0
  WHEN 'ai_anomaly' THEN {0}.matched > 0
END, false)"""

# Kept triggers of a rule from its sorted runs: each silences the next ``pause - 1`` steps, so a trigger depends on
# the one before it. Runs are folded in chunks, so that appending to the result copies a chunk and not all of it.
_FOLD = """
aggregate(
  transform(sequence(0, (size(runs) - 1) div chunk), i -> slice(runs, i * chunk + 1, chunk)),
  named_struct('free', 0L, 'kept', cast(array() AS array<array<struct<start: bigint, count: bigint>>>)),
  (done, part) -> aggregate(
    part,
    named_struct('free', done.free, 'kept', cast(array() AS array<struct<start: bigint, count: bigint>>)),
    (a, r) -> CASE WHEN greatest(a.free, r.first) > r.last THEN a ELSE named_struct(
      'free', greatest(a.free, r.first) + pause * ((r.last - greatest(a.free, r.first)) div pause + 1),
      'kept', concat(a.kept, array(named_struct(
        'start', greatest(a.free, r.first), 'count', (r.last - greatest(a.free, r.first)) div pause + 1)))) END,
    a -> named_struct('free', a.free, 'kept', concat(done.kept, array(a.kept)))),
  done -> flatten(done.kept))"""


def keep_outside_cooldown(runs: DataFrame) -> DataFrame:
    """Triggers ``(rule_id, step)`` left by the cool-down, from runs of steps ``(rule_id, first, last, pause)``."""
    ordered = runs.groupBy("rule_id", "pause").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
    folded = ordered.withColumn("chunk", F.ceil(F.sqrt(F.size("runs"))).cast("int")).select(
        "rule_id", "pause", F.explode(F.expr(_FOLD)).alias("k"))
    steps = F.sequence(F.col("k.start"), F.col("k.start") + F.col("pause") * (F.col("k.count") - 1), F.col("pause"))
    return folded.select("rule_id", F.explode(steps).alias("step"))


def _met_by(sums: str) -> Column:
    return F.expr(_MET.format(sums))


def _floor_div(value: str, by: int) -> Column:
    return F.expr(f"(({value}) - pmod({value}, {by}L)) div {by}L")


def _flips(rows: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """The rows at which ``flag`` changes along the steps of a key; it is false before the first."""
    along = Window.partitionBy(*keys).orderBy("step")
    marked = rows.withColumn("on", flag)
    return marked.withColumn("_was", F.coalesce(F.lag("on").over(along), F.lit(False))).filter("on <> _was").drop("_was")


def _changes(asks: DataFrame, cells: DataFrame, start: dt.datetime, end: dt.datetime, longest_us: int, grain: int,
             step_us: int, steps: int) -> DataFrame:
    """``(probe, step, d)``: by how much a question's count changes at a step.

    Cells and questions meet by scope, facet and day, so the rows of all sources together, or of one frequent
    facet, are many keys.
    """
    total_us = (end - start) // dt.timedelta(microseconds=1)
    days = F.sequence(F.lit(-longest_us // _SPAN_US), F.lit(total_us // _SPAN_US))
    asked = facets_of_asks(asks.dropDuplicates(["probe"])).select(
        "probe", F.col("scope").alias("_scope"), F.col("facet").alias("_facet"), "window_us", F.explode(days).alias("_day"))
    spanned = cells.withColumn("day", _floor_div(f"base * {grain}L", _SPAN_US))
    met = spanned.join(asked, F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("facet") == F.col("_facet")) & (F.col("day") == F.col("_day")))
    # A log's first step is the first at or after it, its last step the last one its window still reaches.
    touched = met.select(
        "probe", "n", F.greatest(F.lit(0), _floor_div(f"(base + after) * {grain}L + {step_us - 1}L", step_us)).alias("enter"),
        _floor_div(f"base * {grain}L + window_us", step_us).alias("leave"))
    both = F.array(F.struct(F.col("enter").alias("step"), F.col("n").alias("d")), F.struct((F.col("leave") + 1).alias("step"), (-F.col("n")).alias("d")))
    each = touched.filter(F.col("enter") <= F.col("leave")).select("probe", F.explode(both).alias("c")).select("probe", "c.step", "c.d")
    return each.filter(F.col("step") <= steps).groupBy("probe", "step").agg(F.sum("d").alias("d")).filter("d <> 0")


def backtest_rules(rules: DataFrame, logs: DataFrame, start: dt.datetime, end: dt.datetime,
                   step_minutes: int = 1, anomalies: DataFrame | None = None) -> DataFrame:
    """Times at which each enabled rule would have triggered: ``rule_id, step, triggered_at``.

    Rules are evaluated at ``start`` and every ``step_minutes`` up to ``end``, with their own windows and cool-downs
    (rounded up to whole steps). ``anomalies``: (source_id, type, confidence, created_at); without them no ai_anomaly
    condition is met. A rule without conditions triggers whenever its cool-down allows.
    """
    parsed = parse_rules(select_rules(rules)).select("id", "source_id", "cooldown_minutes", "conds").filter(F.col("id").isNotNull())
    # Rules of one scope, conditions and cool-down trigger alike and are swept as one. ``copies``: rows with the rule's id.
    copies = F.count("*").over(Window.partitionBy("id"))
    members = materialize(parsed.withColumn("copies", copies).withColumn("like", F.sha2(F.to_json(F.struct(
        "source_id", "cooldown_minutes", "conds", "copies")), 256)), "backtest-rules")
    chosen = materialize(members.dropDuplicates(["like"]).select(
        F.col("like").alias("id"), "source_id", "cooldown_minutes", "conds", "copies"), "backtest-alike")
    step_us = step_minutes * MICROS_PER_MINUTE
    steps = (end - start) // dt.timedelta(microseconds=step_us)
    profile = rule_profile(chosen)
    # Windows are multiples of the grain, and so is a step: whole steps, seconds, or single microseconds.
    grain = next(g for g in (step_us, MICROS_PER_MINUTE, 1_000_000, 1) if profile.grain_us % g == 0 and step_us % g == 0)

    recent = within(logs, start - dt.timedelta(microseconds=profile.longest_us), end)
    offset = F.timestamp_diff("MICROSECOND", as_ntz(start), F.col("ts"))
    # Only the grain a log falls into matters, and whether it lies after its beginning.
    placed = with_keyword_hits(recent, chosen).select(
        "source_id", facets_of_rows().alias("facets"),
        offset.alias("us")).withColumn("base", _floor_div("us", grain)).withColumn("after", F.expr(f"cast(pmod(us, {grain}L) > 0 AS int)"))
    counted = placed.select("source_id", F.explode("facets").alias("facet"), "base", "after").groupBy(
        "source_id", "facet", "base", "after").agg(F.count("*").alias("n"))
    cells = total_over_sources(counted, ["facet", "base", "after"])

    asks = probes_of(chosen)
    changes = _changes(asks, cells, start, end, profile.longest_us, grain, step_us, steps)
    series = materialize(changes.withColumn("n", F.sum("d").over(Window.partitionBy("probe").orderBy("step"))), "backtest-counts")

    # Conditions that ask the same are one question, whatever their thresholds: its sums are taken once, and a condition
    # meets them row by row, so only the steps at which its verdict changes are moved on.
    conds = chosen.select(F.col("id").alias("rule_id"), "source_id", "copies", F.explode("conds").alias("c")).select(
        "rule_id", "source_id", "copies", "c.*", F.size("c.keywords").alias("n_keywords"))
    conds = materialize(conds.withColumn("question", F.sha2(F.to_json(F.struct(
        "source_id", "type", "window_us", "levels", "keywords", "min_confidence", "anomaly_types")), 256)), "backtest-conditions")
    questions = materialize(asks.join(conds.select("rule_id", "pos", "question", "keywords"), ["rule_id", "pos"]).select(
        "question", "role", "probe", "keyword", "keywords").distinct(), "backtest-questions")
    # A keyword matters by being there at all; every other count by its changes.
    numbers = questions.filter(F.col("keyword").isNull()).select("question", "role", "probe").join(series, "probe").select(
        "question", "step", F.when(F.col("role") == "hit", F.col("d")).alias("hits"),
        F.when(F.col("role") == "total", F.col("d")).alias("total"), F.lit(None).cast("long").alias("matched"))
    worded = questions.filter(F.col("keyword").isNotNull())
    there = _flips(series.join(worded.select("probe").distinct(), "probe", "left_semi"), ["probe"], F.col("n") > 0)
    spelt = worded.select("question", "probe", F.expr(SPELLINGS).alias("weight"))
    none = F.lit(None).cast("long")
    words = spelt.join(there, "probe").select(
        "question", "step", none.alias("hits"), none.alias("total"), F.when(F.col("on"), F.col("weight")).otherwise(-F.col("weight")).alias("matched"))
    begin = conds.select("question").distinct().select(
        "question", F.lit(0).cast("long").alias("step"), none.alias("hits"), none.alias("total"), none.alias("matched"))
    moves = numbers.unionByName(words).unionByName(begin)
    if anomalies is not None:
        late = F.timestamp_diff("MICROSECOND", as_ntz(start), F.col("onset"))
        onset = anomaly_onsets(chosen, anomalies.filter(F.col("created_at") <= as_ntz(end))).withColumn("us", F.greatest(F.lit(0), late))
        asked = onset.join(conds.select("rule_id", "pos", "question"), ["rule_id", "pos"]).select("question", "us").distinct()
        moves = moves.unionByName(asked.select("question", _floor_div(f"us + {step_us - 1}L", step_us).alias("step"),
                                               none.alias("hits"), none.alias("total"), F.lit(1).cast("long").alias("matched")))
    sums = ("hits", "total", "matched")
    moves = moves.groupBy("question", "step").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))
    along = Window.partitionBy("question").orderBy("step")
    running = moves.select("question", "step", *(F.sum(c).over(along).alias(c) for c in sums))
    states = running.select("question", "step", F.struct(*sums).alias("now"), F.lag(F.struct(*sums)).over(along).alias("before"))

    judged_by = conds.withColumn("judge", F.sha2(F.to_json(F.struct("question", "threshold", "match_all", "copies")), 256))
    judges = judged_by.select("judge", "question", "type", "threshold", "match_all", "n_keywords", "copies").dropDuplicates(["judge"])
    flips = states.join(judges, "question").select("judge", "step", _met_by("now").alias("on"), F.when(
        F.col("before").isNotNull(), _met_by("before")).otherwise(False).alias("was")).filter("on <> was")
    verdicts = flips.join(judged_by.select("rule_id", "judge"), "judge").select("rule_id", "step", F.when(F.col("on"), 1).otherwise(-1).alias("d"))

    first = chosen.select(F.col("id").alias("rule_id"), F.lit(0).cast("long").alias("step"), F.lit(0).alias("d"))
    known = chosen.select(F.col("id").alias("rule_id"), F.size("conds").alias("asked"), F.greatest(F.lit(1), F.ceil(
        F.coalesce("cooldown_minutes", F.lit(COOLDOWN_MINUTES)) / step_minutes)).cast("long").alias("pause"))
    met = verdicts.unionByName(first).groupBy("rule_id", "step").agg(F.sum("d").alias("d"))
    by_rule = Window.partitionBy("rule_id").orderBy("step")
    met = met.withColumn("met", F.sum("d").over(by_rule)).join(known, "rule_id")
    turns = _flips(met, ["rule_id"], F.col("met") == F.col("asked"))
    runs = turns.withColumn("last", F.coalesce(F.lead("step").over(by_rule) - 1, F.lit(steps).cast("long"))).filter("on").select(
        "rule_id", F.col("step").alias("first"), "last", "pause")

    at = as_ntz(start) + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("step") * step_minutes).cast("int"))
    kept = keep_outside_cooldown(runs).withColumnRenamed("rule_id", "like")
    named = members.select(F.col("id").alias("rule_id"), "like").distinct()
    return kept.join(named, "like").select("rule_id", "step", at.alias("triggered_at"))
