"""Written tables: the log table by day, and small tables with a commit log.

A small table is a folder of Parquet data and a folder of commits. Each commit names a batch and the data it added,
and only what a commit names belongs to the table. So a batch that was cut short leaves nothing behind, one that is
repeated changes nothing, and compaction swaps many pieces of data for one in a single step. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The small tables of an installation.
TABLES = ("alerts", "alert_logs", "rule_stats", "tickets", "outcomes", "analyses", "ledger")


def write_logs(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Write logs in one folder per day, sorted by source and time inside each file.

    Rows are rebalanced by day: small days share a task and a big day is split by
    size, so file sizes stay even whatever the days look like. Readers prune by day
    and skip row groups by source.
    """
    (
        logs.withColumn("dt", F.to_date("ts"))
        .hint("rebalance", "dt")
        .sortWithinPartitions("dt", "source_id", "ts")
        .write.mode(mode).partitionBy("dt").parquet(path)
    )


class Table:
    """A small table under ``path``, on any file system Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._file = lambda name: hadoop.Path(f"{path}/{name}")
        self._fs = self._file("").getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> dict[str, dict]:
        """The commits in force by batch. Of a compaction and what it replaced, only the compaction is."""
        folder = self._file("commits")
        found = {}
        if self._fs.exists(folder):
            for status in self._fs.listStatus(folder):
                name = status.getPath().getName()
                if name.endswith(".json"):
                    stream = self._fs.open(status.getPath())
                    try:
                        text = bytes(stream.readAllBytes()).decode()
                    finally:
                        stream.close()
                    found[name.removesuffix(".json")] = json.loads(text)
        gone = {old for c in found.values() for old in c["replaces"]}
        return {batch: c for batch, c in found.items() if batch not in gone}

    def batches(self) -> set[str]:
        """All batches written so far, compacted ones included."""
        return {b for batch, c in self.commits().items() for b in (c["batches"] or [batch])}

    def _commit(self, batch: str, rows: DataFrame, replaces: list[str], batches: list[str]) -> None:
        data = f"data/{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self._path}/{data}")
        note = {"data": data, "schema": rows.schema.json(), "replaces": replaces, "batches": batches}
        # The commit appears whole, by a rename, or not at all.
        draft, final = self._file(f"commits/{uuid.uuid4().hex}.draft"), self._file(f"commits/{batch}.json")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(note).encode()))
        stream.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"commit {batch} could not be written")

    def append(self, batch: str, rows: DataFrame) -> bool:
        """Add a batch's rows; false, and nothing changed, if the batch is there already."""
        if batch in self.batches():
            return False
        self._commit(batch, rows, [], [])
        return True

    def read(self, like: str | StructType | None = None) -> DataFrame:
        """All rows; ``like`` is the schema of a table nothing was written to yet."""
        return self._rows(like)

    def _rows(self, like: str | StructType | None = None, schema: str | None = None) -> DataFrame:
        """All rows as they are written, with the schema of the last commit if none is given."""
        commits = list(self.commits().values())
        if not commits:
            if like is None:
                raise ValueError(f"nothing written to {self._path} yet")
            return self._spark.createDataFrame([], like)
        return self._spark.read.schema(schema or StructType.fromJson(json.loads(commits[-1]["schema"]))).parquet(*(f"{self._path}/{c['data']}" for c in commits))

    def compact(self) -> None:
        """Put all data into one piece. Readers of the old pieces are not disturbed; ``clean`` deletes these later."""
        old = self.commits()
        if len(old) > 1:
            batches = sorted(b for batch, c in old.items() for b in (c["batches"] or [batch]))
            self._commit(f"compacted-{uuid.uuid4().hex}", self._rows().hint("rebalance"), sorted(old), batches)

    def clean(self) -> None:
        """Delete data that no commit in force names, and the commits that were replaced. No reader or writer may be at work."""
        held = self.commits()
        data = {c["data"].removeprefix("data/") for c in held.values()}
        for folder, keep in (("data", data), ("commits", {f"{b}.json" for b in held})):
            if self._fs.exists(self._file(folder)):
                for status in self._fs.listStatus(self._file(folder)):
                    if status.getPath().getName() not in keep:
                        self._fs.delete(status.getPath(), True)


class SetTable(Table):
    """Links ``(alert_id, log_id)``, where alerts with the same logs share a set and its logs are written once.

    One commit holds both kinds of rows: an alert with its set, and a set (without an alert) with one of its logs.
    A row without a set is a link by itself.
    """

    _SCHEMA = "alert_id string, match_set string, log_id string"

    def append_sets(self, batch: str, alerts: DataFrame, logs: DataFrame) -> bool:
        """Add ``alerts`` (alert_id, match_set) and ``logs`` (match_set, log_id), as ``append`` does. Names of sets differ between batches."""
        none = F.lit(None).cast("string")
        rows = alerts.select("alert_id", "match_set", none.alias("log_id")).unionByName(logs.select(none.alias("alert_id"), "match_set", "log_id"))
        return self.append(batch, rows)

    def _rows(self, like: str | StructType | None = None, schema: str | None = None) -> DataFrame:
        return super()._rows(like, schema or self._SCHEMA)

    def _parts(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Links by themselves, alerts with their sets, and logs of sets."""
        alone = F.col("match_set").isNull()
        return (rows.filter(alone).select("alert_id", "log_id"), rows.filter(~alone & F.col("alert_id").isNotNull()).select("alert_id", "match_set"),
                rows.filter(~alone & F.col("alert_id").isNull()).select("match_set", "log_id"))

    def read(self, like: str | StructType | None = None) -> DataFrame:
        """All links ``(alert_id, log_id)``, one row for each; they may be many more than the rows written."""
        if not self.commits():
            return super().read(like)
        links, alerts, logs = self._parts(self._rows())
        return links.unionByName(alerts.join(logs, "match_set").select("alert_id", "log_id"))

    def counts(self) -> DataFrame:
        """``(alert_id, n_logs)``: how many links each alert has, counted once per set."""
        links, alerts, logs = self._parts(self._rows(self._SCHEMA))
        of_sets = alerts.join(logs.groupBy("match_set").agg(F.count("*").alias("n")), "match_set").select("alert_id", "n")
        of_links = links.groupBy("alert_id").agg(F.count("*").alias("n"))
        return of_links.unionByName(of_sets).groupBy("alert_id").agg(F.sum("n").alias("n_logs"))


class Store:
    """The small tables of an installation under one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._tables = {name: (SetTable if name == "alert_logs" else Table)(spark, f"{path}/{name}") for name in TABLES}

    def __getitem__(self, name: str) -> Table:
        return self._tables[name]
