"""Streaming jobs.

Transformations take and return streaming DataFrames. ``run_to_table`` drives one
over all available input into a Parquet table in the shared folder.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch.functions.levels import is_error
from tallywatch.functions.timing import MICROS_PER_MINUTE
from tallywatch.operators.rules import (
    ALL_ROWS, ASKS, COOLDOWN_MINUTES, cut_keywords, facets_of_asks, keywords_of, parse_rules, piece_test, pieces_of,
    probes_of, rule_profile, select_rules,
)
from tallywatch.session import materialize, shared_dir
from tallywatch.sources.ingest import map_sender_to_source, parse_raw_lines, sender_map
from tallywatch.sources.tail import SCHEMA as TAIL_SCHEMA, TailedLines
from tallywatch.streaming.verdicts import Cooldown, Silence, Verdicts

# Parts into which the rules of a scope are dealt; fixed, as a checkpoint keeps them.
RULE_PARTS = 32
# State partitions of a stream that starts before its executors have come.
LEAST_PARTITIONS = 8

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_partitions(spark: SparkSession) -> int:
    """Partitions of a new stream's state: one for each core there is, and no more than the session asks for.

    Every micro-batch opens and commits each of them once per stateful step, however little it holds.
    """
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(LEAST_PARTITIONS, spark.sparkContext.defaultParallelism))


def run_to_table(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Run an append stream over the input there is and read the written table.

    A ``folder`` given by the caller keeps table and checkpoint, so the next run goes on
    where this one ended; without one every run starts anew. A checkpoint keeps its number of state partitions.
    """
    spark = stream.sparkSession
    base = folder or shared_dir(spark, label)
    asked = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", state_partitions(spark))
    try:
        # The query takes a copy of the session's settings when it starts.
        query = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", asked)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def run_batches(stream: DataFrame, label: str, step: Callable[[DataFrame, int, str], None],
                folder: str | None = None) -> str:
    """Run ``step(batch, batch_id, folder)`` per micro-batch; returns the folder.

    Steps write under a folder named by the batch id and overwrite it, so a repeated
    batch gives the same files. With a ``folder`` given by the caller a later run
    resumes after the last finished batch.
    """
    base = folder or shared_dir(stream.sparkSession, label)
    query = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: step(batch, batch_id, base))
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return base


def _keep(rows: DataFrame, base: str, name: str, batch_id: int) -> None:
    """Write one batch's result or the state after it."""
    rows.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch_id:09d}")


def stream_ingest(lines: DataFrame) -> DataFrame:
    """Raw lines to parsed rows; rows that do not parse keep their error text."""
    return parse_raw_lines(lines)


def stream_syslog_sources(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """Stream-static join with the sender map as it is when the query starts."""
    return map_sender_to_source(messages, sender_map(sources))


def run_source_refresh(messages: DataFrame, load_sources: Callable[[], DataFrame], label: str = "source-refresh",
                       folder: str | None = None) -> DataFrame:
    """Messages with their source, the sender map being loaded anew for every micro-batch.

    ``load_sources`` must look at the files or tables again, as ``spark.read`` does.
    """
    def step(batch: DataFrame, batch_id: int, base: str) -> None:
        _keep(map_sender_to_source(batch, sender_map(load_sources())), base, "mapped", batch_id)

    base = run_batches(messages, label, step, folder)
    return messages.sparkSession.read.parquet(f"{base}/mapped").drop("batch")


def pull_lines(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """One pull: the lines (``file, at, line, line_id``) added below ``path`` since the last pull with this ``folder``.

    The cursor, a position per file, lies in the folder's checkpoint and survives restarts; all pulled lines lie in its
    ``lines``. A pull cut short is repeated by the next one, with the same rows.
    """
    spark.dataSource.register(TailedLines)
    done: list[int] = []

    def step(batch: DataFrame, batch_id: int, base: str) -> None:
        _keep(batch, base, "lines", batch_id)
        done.append(batch_id)

    run_batches(spark.readStream.format(TailedLines.name()).load(path), "pull", step, folder)
    paths = [f"{folder}/lines/batch={batch_id:09d}" for batch_id in done]
    return spark.read.schema(TAIL_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], TAIL_SCHEMA)


def stream_tumbling_counts(logs: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Volume and errors per source and closed window."""
    return (
        logs.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "source_id")
        .agg(F.count("*").alias("n"), F.count_if(is_error(F.col("level"))).alias("errors"))
        .select(F.col("w.start").alias("bucket_start"), "source_id", "n", "errors")
    )


def stream_sessions(logs: DataFrame, gap: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Closed bursts per source.

    Rows are merged into sessions inside each task before the shuffle, so a busy
    source sends sessions instead of rows.
    """
    logs.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (
        logs.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "source_id")
        .agg(F.count("*").alias("n"))
        .select("source_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")
    )


def stream_dedupe(lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop lines read again, by source and hash of the raw text."""
    return (
        lines.withColumn("raw_hash", F.sha2("raw_content", 256)).withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["source_id", "raw_hash"])
    )


def _micros(at: dt.datetime) -> int:
    """Microseconds since 1970 of a time without zone."""
    return (at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def rule_specs(parsed: DataFrame) -> DataFrame:
    """``(rule_id, part, spec, pause)``: what a rule asks and how it is judged as JSON, and its cool-down in minutes.

    Rules of one scope and spec lie in one part.
    """
    conds = F.expr("""transform(conds, c -> named_struct('pos', c.pos, 'type', c.type, 'threshold', c.threshold, 'match_all', c.match_all,
        'n_keywords', size(c.keywords), 'spelt', transform(array_distinct(c.keywords), k -> lower(k))))""")
    part = F.concat(F.pmod(F.xxhash64("spec"), F.lit(RULE_PARTS)), F.coalesce(F.concat(F.lit("="), "source_id"), F.lit("")))
    return parsed.select(
        F.col("id").alias("rule_id"), "source_id", F.to_json(F.struct(F.expr(ASKS).alias("asks"), conds.alias("conds"))).alias("spec"),
        F.greatest(F.lit(1), F.coalesce("cooldown_minutes", F.lit(COOLDOWN_MINUTES))).cast("long").alias("pause")).select(
        "rule_id", part.alias("part"), "spec", "pause")


def facet_rows(logs: DataFrame, parsed: DataFrame) -> DataFrame:
    """``(source_id, ts, facet)`` of each log: all rows, its level, and each rule keyword it holds; without state.

    Keywords are found as in batch, each under the piece that the fewest keywords share. Logs are dealt evenly first, since
    they may lie in one file and each is searched.
    """
    logs = logs.select("source_id", "ts", "level", "message").repartition(state_partitions(logs.sparkSession))
    plain = F.array_compact(F.array(F.lit(ALL_ROWS), F.concat(F.lit("level:"), F.col("level"))))
    nothing = F.lit(None).cast("string")
    facets = F.transform(plain, lambda f: F.struct(f.alias("facet"), nothing.alias("piece")))
    keywords = materialize(keywords_of(parsed), "stream-keywords")
    if keywords.isEmpty():
        return logs.select("source_id", "ts", F.explode(plain).alias("facet"))
    cut, sizes = cut_keywords(keywords)
    shared = cut.groupBy("piece").agg(F.count("*").alias("n"))
    index = materialize(cut.join(shared, "piece").groupBy("keyword").agg(F.min(F.struct("n", "piece")).alias("rarest")).select(
        "keyword", F.col("rarest.piece").alias("_piece")), "stream-index")
    may_be = piece_test(index.withColumnRenamed("_piece", "piece"))
    text = F.lower("message")
    found = F.filter(F.concat(*(F.coalesce(pieces_of(text, n), F.array().cast("array<string>")) for n in sizes)), may_be)
    each = F.explode(F.concat(facets, F.transform(found, lambda p: F.struct(nothing.alias("facet"), p.alias("piece")))))
    rows = logs.select("source_id", "ts", text.alias("text"), each.alias("f")).select("source_id", "ts", "text", "f.facet", "f.piece")
    met = rows.join(index, F.col("piece") == F.col("_piece"), "left")
    word = F.when(F.contains("text", "keyword"), F.concat(F.lit("word:"), "keyword"))
    return met.select("source_id", "ts", F.coalesce("facet", word).alias("facet")).filter(F.col("facet").isNotNull())


def _judged(logs: DataFrame, rules: DataFrame, since: dt.datetime, step_minutes: int, delay: str, runs: bool) -> DataFrame:
    """Closed counts per grain, scope and facet, handed to the parts of the rules that ask for them."""
    spark = logs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # A repeated rule counts once.
    chosen = parse_rules(select_rules(rules)).select("id", "source_id", "cooldown_minutes", "conds").dropDuplicates(["id"])
    parsed = materialize(chosen, "stream-rules")
    step_us = step_minutes * MICROS_PER_MINUTE
    grain = rule_profile(parsed).grain_us
    since_us = _micros(since)
    offset = F.unix_micros("ts") - since_us
    rows = facet_rows(logs.withWatermark("ts", delay), parsed).withColumn("after", (F.pmod(offset, F.lit(grain)) > 0).cast("int"))
    scoped = rows.withColumn("scope", F.explode(F.array_distinct(F.array(F.col("source_id"), F.lit(None).cast("string")))))
    pane = F.window("ts", f"{grain} microseconds", f"{grain} microseconds", f"{since_us % grain} microseconds")
    cells = scoped.groupBy(pane.alias("w"), "scope", "facet", "after").agg(F.count("*").alias("n"))
    specs = materialize(rule_specs(parsed), "stream-specs")
    asked = materialize(facets_of_asks(probes_of(parsed)).join(
        specs.select(F.col("rule_id").alias("_rule"), "part"), F.col("rule_id").eqNullSafe(F.col("_rule"))).select(
        "part", F.col("scope").alias("_scope"), F.col("facet").alias("_facet")).distinct(), "stream-asks")
    of_parts = cells.join(asked, F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("facet") == F.col("_facet"))).select(
        "part", "facet", F.expr(f"(unix_micros(w.start) - {since_us}L) div {grain}L").alias("base"), "after", "n")
    out = "rules string, step long, last long, pause long" if runs else "rule_id string, step long, met boolean"
    return of_parts.groupBy("part").transformWithStateInPandas(
        Verdicts(since_us, grain, step_us, runs), out, "append", "eventtime", initialState=specs.groupBy("part"))


def _at(since: dt.datetime, step_minutes: int) -> Column:
    return F.timestamp_micros(F.lit(_micros(since)) + F.col("step") * (step_minutes * MICROS_PER_MINUTE))


def stream_rules(logs: DataFrame, rules: DataFrame, since: dt.datetime, step_minutes: int = 1, delay: str = "10 minutes") -> DataFrame:
    """Verdicts of all enabled rules at ``since`` and every step of event time after it: ``rule_id, as_of, triggered``.

    A row for the first step and for each at which a verdict changes; between them it stays. Steps are judged once
    the watermark has passed them, so the rows do not depend on micro-batches. Cool-down is left to
    ``stream_cooldown``; ``ai_anomaly`` conditions are not met in a stream. Rules are those there are when the stream
    first starts. State: per different rule of a scope its counts, and the changes due while logs leave its windows.
    """
    judged = _judged(logs, rules, since, step_minutes, delay, runs=False)
    return judged.select("rule_id", _at(since, step_minutes).alias("as_of"), F.col("met").alias("triggered"))


def stream_cooldown(logs: DataFrame, rules: DataFrame, since: dt.datetime, delay: str = "10 minutes") -> DataFrame:
    """Triggers ``rule_id, triggered_at`` of all enabled rules, judged every minute by their own conditions and cool-downs.

    Three stateful steps in one query: counts per pane, verdicts per rule, cool-down per rule, or per few rules whose
    verdicts and pauses are the same. Triggers stored before the stream are not taken into account.
    """
    runs = _judged(logs, rules, since, 1, delay, runs=True)
    kept = runs.groupBy("rules").transformWithStateInPandas(Cooldown(), "rules string, step long", "append", "none")
    return kept.select(F.explode(F.from_json("rules", "array<string>")).alias("rule_id"), _at(since, 1).alias("triggered_at"))


def stream_silence(logs: DataFrame, sources: DataFrame, minutes: float, since: dt.datetime, delay: str = "10 minutes",
                   pane_minutes: int = 1) -> DataFrame:
    """When each source fell silent: ``source_id, last_ts, as_of``, ``as_of`` being ``minutes`` after its newest log ``last_ts``.

    One row per gap longer than that, told when the next log comes or, by a timer, when none has come. Known sources
    are watched from ``since`` on; one without any log has a null ``last_ts``. Rows are reduced to a first and a last
    time per source and pane before they meet the state.
    """
    spark = logs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    panes = logs.withWatermark("ts", delay).groupBy(F.window("ts", f"{pane_minutes} minutes").alias("w"), "source_id").agg(
        F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us"))
    known = materialize(sources.select(F.col("id").alias("source_id")).distinct(), "stream-sources").groupBy("source_id")
    watch = Silence(_micros(since), int(minutes * MICROS_PER_MINUTE), pane_minutes * MICROS_PER_MINUTE)
    told = panes.select("source_id", "w", "first_us", "last_us").groupBy("source_id").transformWithStateInPandas(
        watch, "source_id string, last_us long, as_us long", "append", "eventtime", initialState=known)
    return told.select("source_id", F.timestamp_micros("last_us").alias("last_ts"), F.timestamp_micros("as_us").alias("as_of"))
