"""Queries over the log table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.levels import is_error
from tallywatch.functions.timing import as_ntz, within


def level_list(levels: str | list[str]) -> list[str]:
    """Levels given as a list or a comma list, trimmed and in lower case."""
    items = levels.split(",") if isinstance(levels, str) else levels
    return [item.strip().lower() for item in items]


def message_contains(message: Column, keyword: str | Column) -> Column:
    """Case-insensitive literal search; % and _ are ordinary characters."""
    needle = F.lit(keyword.lower()) if isinstance(keyword, str) else F.lower(keyword)
    return F.contains(F.lower(message), needle)


def find_logs(logs: DataFrame, source_id: str | None = None, level: str | None = None,
              levels: str | list[str] | None = None, search: str | None = None,
              start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """Rows that meet every given condition; time bounds are inclusive."""
    df = within(logs, start, end)
    if source_id is not None:
        df = df.filter(F.col("source_id") == source_id)
    if level is not None:
        df = df.filter(F.col("level") == level.lower())
    if levels is not None:
        df = df.filter(F.col("level").isin(level_list(levels)))
    if search is not None:
        df = df.filter(message_contains(F.col("message"), search))
    return df


def count_logs(found: DataFrame) -> DataFrame:
    """The total before any page limit."""
    return found.agg(F.count("*").alias("total"))


def page_with_total(found: DataFrame, page: int = 1, limit: int = 50, sort_order: str = "DESC") -> DataFrame:
    """One page with ``total``, the number of rows before any page limit."""
    return page_logs(found, page, limit, sort_order).withColumn("total", count_logs(found).scalar())


def page_logs(found: DataFrame, page: int = 1, limit: int = 50, sort_order: str = "DESC") -> DataFrame:
    """One page by time, ties by id (a top-k plan, no full sort)."""
    key = F.desc("ts") if sort_order.upper() == "DESC" else F.asc("ts")
    return found.orderBy(key, "log_id").offset((page - 1) * limit).limit(limit)


def search_logs(logs: DataFrame, keyword: str) -> DataFrame:
    """Rows whose message contains the keyword."""
    return find_logs(logs, search=keyword)


def log_stats(logs: DataFrame) -> DataFrame:
    """Total, counts by level and by source from one scan: (kind, name, n, errors)."""
    cells = logs.groupBy("level", "source_id").agg(F.count("*").alias("n"))
    errors = F.sum(F.when(is_error(F.col("level")), F.col("n")).otherwise(0))
    sets = cells.groupingSets(
        [["level"], ["source_id"], []], "level", "source_id"
    ).agg(F.grouping_id().alias("g"), F.sum("n").alias("n"), errors.alias("errors"))
    return sets.select(
        F.when(F.col("g") == 1, "level").when(F.col("g") == 2, "source").otherwise("total").alias("kind"),
        F.when(F.col("g") == 1, F.col("level")).when(F.col("g") == 2, F.col("source_id")).alias("name"),
        "n", "errors",
    )


def lookup_logs(logs: DataFrame, requests: DataFrame) -> DataFrame:
    """Logs for the id lists ``(request_id, ids)``; unknown ids are skipped, positions kept."""
    wanted = requests.select("request_id", F.posexplode("ids").alias("pos", "log_id"))
    return wanted.join(logs, "log_id")


def mark_analyzed(ledger: DataFrame, analyses: DataFrame) -> DataFrame:
    """Ledger of analysed ids with the rows of new analyses ``(analysis_id, log_ids)`` added."""
    rows = analyses.select(F.explode("log_ids").alias("log_id"), "analysis_id")
    return ledger.unionByName(rows).distinct()


def with_analyzed_flag(logs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Logs with the flag derived from the ledger."""
    done = ledger.groupBy("log_id").agg(F.lit(True).alias("_done"))
    return logs.join(done, "log_id", "left").withColumn(
        "is_analyzed", F.coalesce("_done", F.lit(False))).drop("_done")


def unanalyzed_logs(logs: DataFrame, ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """Logs no analysis has covered yet, newest first when a limit is given."""
    open_rows = logs.join(ledger, "log_id", "left_anti")
    if limit is None:
        return open_rows
    return open_rows.orderBy(F.desc("ts"), "log_id").limit(limit)


def level_distribution(logs: DataFrame, *by: str) -> DataFrame:
    """Map from level to count, overall or per group."""
    counts = logs.groupBy(*by, "level").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("level", "n")))
    return counts.groupBy(*by).agg(F.map_from_entries(entries).alias("levels"))


def time_range(logs: DataFrame, as_of: dt.datetime, *by: str) -> DataFrame:
    """First and last time; both are the evaluation time when there is no row."""
    return logs.groupBy(*by).agg(
        F.coalesce(F.min("ts"), as_ntz(as_of)).alias("start_ts"),
        F.coalesce(F.max("ts"), as_ntz(as_of)).alias("end_ts"),
    )


def volume_timeseries(logs: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Volume and error rate per source and time bucket."""
    cells = logs.groupBy(F.window("ts", bucket).alias("w"), "source_id").agg(
        F.count("*").alias("n"), F.count_if(is_error(F.col("level"))).alias("errors"))
    return cells.select(
        F.col("w.start").alias("bucket_start"), "source_id", "n", "errors",
        (F.col("errors") / F.col("n")).alias("error_rate"))
