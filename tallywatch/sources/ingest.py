"""From envelopes, raw lines, pages and syslog messages to the log table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch import schemas
from tallywatch.functions.once import with_fields
from tallywatch.functions.text import split_lines, strip
from tallywatch.functions.timing import iso_to_ntz
from tallywatch.session import materialize
from tallywatch.sources.parse import parse_line, parse_syslog, resolve_format
from tallywatch.sources.tail import TailedLines

# Defaults of a pull job, provenance marks, and the tag of an unknown sender.
PULL_INTERVAL_MS = 60_000
PULL_METHOD = "ssh-tail"
PULL_PATH = "/var/log/syslog"
VIA_PULL = "scheduled-pull"
VIA_SYSLOG = "syslog-listener"
UNREGISTERED = "unregistered:"
TCP_PREFIX = "::ffff:"
BROKEN_JSON = "invalid json"
NO_ENTRIES = "no entries"
ENTRY_INCOMPLETE = "source, level or message missing"


def _entry_rows(entries: DataFrame) -> DataFrame:
    """Envelope fields stamped on each entry ``e``; a missing time becomes the arrival time."""
    return entries.select(
        F.concat("envelope_id", F.lit("-"), F.col("pos").cast("string")).alias("log_id"),
        F.col("sourceId").alias("source_id"),
        F.col("serverId").alias("server_id"),
        F.col("e.level").alias("level"),
        F.col("e.message").alias("message"),
        F.lit(None).cast("string").alias("raw_content"),
        F.lower("format").alias("format"),
        F.col("e.metadata").alias("metadata"),
        F.coalesce(iso_to_ntz(F.col("e.timestamp")), F.col("received_at")).alias("ts"),
        F.lit(False).alias("is_analyzed"),
    )


def _complete(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("sourceId").isNotNull() & F.col("e.level").isNotNull() & F.col("e.message").isNotNull())


def ingest_batches(envelopes: DataFrame) -> DataFrame:
    """Bulk envelopes ``(envelope_id, payload, received_at)`` to one row per log entry; see ``broken_batches``."""
    entries = (
        with_fields(envelopes, F.struct(F.from_json("payload", schemas.BULK_ENVELOPE).alias("b")))
        .select("envelope_id", "received_at", "b.sourceId", "b.serverId", "b.format",
                F.posexplode("b.logs").alias("pos", "e"))
    )
    return _entry_rows(_complete(entries))


def _broken(rows: DataFrame, id_column: str, fields: Column, error: Column, source: str | None = None) -> DataFrame:
    """Dead-letter rows of payloads that are no JSON or have an ``error`` over their fields ``b``."""
    read = with_fields(rows, F.struct(F.try_parse_json("payload").isNotNull().alias("_json"), fields.alias("b")))
    why = F.when(~F.coalesce(F.col("_json"), F.lit(False)), BROKEN_JSON).otherwise(error)
    source_id = F.lit(None).cast("string") if source is None else F.col(source)
    return read.withColumn("error", why).filter(F.col("error").isNotNull()).select(
        F.col(id_column).alias("log_id"), source_id.alias("source_id"), F.lit("json").alias("format"),
        F.col("payload").alias("raw_content"), "error")


def broken_batches(envelopes: DataFrame) -> DataFrame:
    """Bulk envelopes that give no rows, or rows without source, level or message, with the reason."""
    incomplete = F.col("b.sourceId").isNull() | F.exists("b.logs", lambda e: e["level"].isNull() | e["message"].isNull())
    error = F.when(F.coalesce(F.size("b.logs"), F.lit(0)) <= 0, NO_ENTRIES).when(incomplete, ENTRY_INCOMPLETE)
    return _broken(envelopes, "envelope_id", F.from_json("payload", schemas.BULK_ENVELOPE), error, "b.sourceId")


def broken_singles(envelopes: DataFrame) -> DataFrame:
    """One-entry envelopes without source, level or message, or that are no JSON."""
    b = F.col("b")
    error = F.when(b["sourceId"].isNull() | b["level"].isNull() | b["message"].isNull(), ENTRY_INCOMPLETE)
    return _broken(envelopes, "envelope_id", F.from_json("payload", schemas.SINGLE_ENVELOPE), error, "b.sourceId")


def broken_alertmanager(payloads: DataFrame) -> DataFrame:
    """Alert payloads that give no rows, with the reason."""
    error = F.when(F.coalesce(F.size("b.alerts"), F.lit(0)) <= 0, NO_ENTRIES)
    return _broken(payloads, "payload_id", F.from_json("payload", schemas.ALERTMANAGER), error)


def ingest_single(envelopes: DataFrame) -> DataFrame:
    """One-entry envelopes, with the same defaults as the bulk form; for the others see ``broken_singles``."""
    body = with_fields(envelopes, F.struct(F.from_json("payload", schemas.SINGLE_ENVELOPE).alias("b")))
    entries = body.select(
        "envelope_id", "received_at", "b.sourceId", "b.serverId", "b.format", F.lit(0).alias("pos"),
        F.struct("b.level", "b.message", "b.metadata", "b.timestamp").alias("e"))
    return _entry_rows(_complete(entries))


def stamp_provenance(metadata: Column, stamp: dict[str, Column]) -> Column:
    """Metadata with the provenance keys added; the stamp wins over a parsed key."""
    kept = F.map_filter(metadata, lambda k, _: ~k.isin(list(stamp)))
    items: list[Column] = []
    for key, value in stamp.items():
        items += [F.lit(key), value.cast("string")]
    return F.map_concat(kept, F.map_filter(F.create_map(*items), lambda _, v: v.isNotNull()))


def parse_raw_lines(lines: DataFrame) -> DataFrame:
    """Raw lines ``(line_id, source_id, server_id, line, format, received_at)`` to log rows.

    Lines are trimmed, blank ones skipped, and the parser is chosen by format.
    Column ``error`` is null on good rows (see ``split_quarantine``).
    """
    kept = (
        lines.withColumn("raw_content", strip(F.col("line")))
        .filter(F.length("raw_content") > 0)
        .select(F.col("line_id").alias("log_id"), "source_id", "server_id", "raw_content",
                resolve_format(F.col("format")).alias("format"), "received_at")
    )
    parsed = with_fields(kept, parse_line(F.col("raw_content"), F.col("format"), F.col("received_at")))
    return parsed.select(
        "log_id", "source_id", "server_id", "level", "message", "raw_content", "format", "metadata", "ts", "error")


def as_source_lines(lines: DataFrame, source_id: str, log_format: str, received_at: Column) -> DataFrame:
    """Lines of files (``sources/tail.py``) as raw lines of one source; ids are made of the file and the place in it."""
    return lines.select(
        F.concat_ws("-", F.lit(source_id), "line_id").alias("line_id"),
        F.lit(source_id).alias("source_id"),
        F.lit(None).cast("string").alias("server_id"),
        "line",
        F.lit(log_format).alias("format"),
        received_at.alias("received_at"),
    )


def read_raw_lines(spark, path: str, source_id: str, log_format: str, received_at: Column) -> DataFrame:
    """Read a text file or folder as raw lines of one source and parse them.

    A line keeps its id in every later read, whatever other files there are by then.
    """
    spark.dataSource.register(TailedLines)
    return parse_raw_lines(as_source_lines(spark.read.format(TailedLines.name()).load(path), source_id, log_format, received_at))


def split_quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and a dead-letter table of rows that did not parse."""
    good = parsed.filter(F.col("error").isNull()).drop("error")
    bad = parsed.filter(F.col("error").isNotNull()).select(
        "log_id", "source_id", "format", "raw_content", "error")
    return good, bad


def explode_http_page(bodies: DataFrame) -> DataFrame:
    """Fetched bodies ``(page_id, content_type, body)`` to raw lines.

    A JSON array gives one line per element (texts as they are, other values as
    compact JSON). Any other JSON body, also a broken one, is one line. Other
    content types are split on newline.
    """
    is_json = F.contains(F.col("content_type"), F.lit("json"))
    is_array = F.startswith(F.ltrim("body"), F.lit("["))
    items = F.when(is_array, F.from_json("body", "array<string>"))
    texts = F.transform(items, lambda v: F.coalesce(v, F.lit("null")))
    lines = F.when(is_json, F.coalesce(texts, F.array("body"))).otherwise(split_lines(F.col("body")))
    return bodies.select("page_id", F.posexplode(lines).alias("pos", "line"))


def sender_map(sources: DataFrame) -> DataFrame:
    """Sender address dimension from the syslog sources' settings.

    On a repeated address the source created last wins, and within one source the
    settings give the same row whichever key named the address.
    """
    parsed = sources.filter(F.col("type") == "syslog").withColumn(
        "c", F.from_json("config", schemas.SOURCE_CONFIG))
    addresses = F.array_compact(F.concat(
        F.array("c.syslogIp"),
        F.coalesce(F.col("c.syslogIps"), F.array().cast("array<string>")),
        F.array("c.ip"),
    ))
    rows = parsed.select(
        "created_at", F.col("id").alias("source_id"), F.col("c.serverId").alias("server_id"),
        F.explode(F.array_distinct(addresses)).alias("ip"))
    newest = F.max_by(F.struct("source_id", "server_id"), F.struct("created_at", "source_id"))
    return (
        rows.filter(F.length("ip") > 0).groupBy("ip").agg(newest.alias("s"))
        .select("ip", "s.source_id", "s.server_id")
    )


def map_sender_to_source(messages: DataFrame, senders: DataFrame) -> DataFrame:
    """Add source and server of each message's sender; unknown senders keep a marker id.

    The address prefix of mapped IPv4 peers is removed on TCP only. The dimension
    is small, so the planner broadcasts it when its measured size allows.
    """
    peer = F.when(
        F.col("transport") == "tcp", F.replace(F.col("sender_ip"), F.lit(TCP_PREFIX), F.lit(""))
    ).otherwise(F.col("sender_ip"))
    return (
        messages.withColumn("sender_ip", peer)
        .join(senders, F.col("sender_ip") == F.col("ip"), "left")
        .withColumn("source_id", F.coalesce("source_id", F.concat(F.lit(UNREGISTERED), "sender_ip")))
        .drop("ip")
    )


def ingest_syslog(messages: DataFrame, senders: DataFrame) -> DataFrame:
    """Messages ``(message_id, raw, sender_ip, transport, received_at)`` to log rows."""
    parsed = with_fields(
        map_sender_to_source(messages, senders), parse_syslog(F.col("raw"), F.col("received_at")))
    return parsed.select(
        F.col("message_id").alias("log_id"), "source_id", "server_id", "level", "message",
        F.col("raw").alias("raw_content"), F.lit("syslog").alias("format"),
        stamp_provenance(F.col("metadata"), {
            "senderIp": F.col("sender_ip"), "receivedVia": F.lit(VIA_SYSLOG),
        }).alias("metadata"),
        "ts")


def frame_lines(chunks: DataFrame, block_size: int = 1024) -> DataFrame:
    """Byte-stream chunks ``(stream_id, seq, chunk)`` to trimmed, non-empty lines ``(stream_id, line_no, line)``.

    A line may span chunks. Newlines are counted first, per block of ``block_size`` chunks, and summed over the (few)
    blocks of a stream. Then the texts are brought together by block, once, and numbered and put together there; only
    the first and the last line of a block go on to be joined with those of its neighbours. The text after a
    stream's last newline is incomplete and not emitted.
    """
    block = F.floor(F.col("seq") / block_size)
    breaks = F.length("chunk") - F.length(F.replace("chunk", F.lit("\n"), F.lit("")))
    per_block = chunks.groupBy("stream_id", block.alias("block")).agg(F.coalesce(F.sum(breaks), F.lit(0)).alias("n"))
    stream = Window.partitionBy("stream_id").orderBy("block")
    totals = materialize(per_block.select(
        F.col("stream_id").alias("_s"), F.col("block").alias("_b"), (F.sum("n").over(stream) - F.col("n")).alias("_carry"), F.col("n").alias("_n"),
        F.sum("n").over(Window.partitionBy("stream_id")).alias("_end")), "line-blocks")

    placed = chunks.withColumn("block", block).withColumn("_pieces", split_lines(F.col("chunk"))).join(
        totals, F.col("stream_id").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    inside = Window.partitionBy("stream_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("_before", F.coalesce(F.sum(F.size("_pieces") - 1).over(inside), F.lit(0)))
    pieces = numbered.select("stream_id", "block", "_carry", "_n", "_end", "seq", "_before", F.posexplode("_pieces").alias("_i", "_piece"))
    keys = ["stream_id", "block", "_carry", "_n", "_end"]

    def joined(order: str, text: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda p: p[text]), "")

    lines = pieces.groupBy(*keys, (F.col("_before") + F.col("_i")).alias("_at")).agg(joined("seq", "_piece").alias("line"))
    lines = lines.withColumn("line_no", F.col("_carry") + F.col("_at")).filter(F.col("line_no") <= F.col("_end"))
    # The first line of a block may have begun in an earlier one, the last may go on in a later one.
    shared = (F.col("_at") == 0) | (F.col("_at") == F.col("_n"))
    marked = lines.select("stream_id", "line_no", "block", "_end", shared.alias("_shared"), "line")
    whole = marked.filter(~F.col("_shared")).select("stream_id", "line_no", "line")
    edges = marked.filter("_shared").groupBy("stream_id", "line_no", "_end").agg(joined("block", "line").alias("line"))
    complete = edges.filter(F.col("line_no") < F.col("_end")).select("stream_id", "line_no", "line")
    return (
        whole.unionByName(complete)
        .select("stream_id", "line_no", strip(F.col("line")).alias("line"))
        .filter(F.length("line") > 0)
    )


def frame_datagrams(messages: DataFrame) -> DataFrame:
    """Datagrams are neither split nor trimmed: one datagram is one message."""
    return messages.select("stream_id", F.col("seq").alias("line_no"), F.col("chunk").alias("line"))


def pull_plan(sources: DataFrame, servers: DataFrame) -> DataFrame:
    """Which sources are pulled, how and how often, and why the others are skipped."""
    enabled = sources.withColumn("c", F.from_json("config", schemas.SOURCE_CONFIG)).filter(
        F.get_json_object("config", "$.pullEnabled") == "true")
    # A text "true" is not the boolean; the two differ in the raw settings only.
    strict = enabled.filter(~F.rlike("config", F.lit(r'"pullEnabled"\s*:\s*"')))
    method = F.coalesce(F.nullif("c.pullMethod", F.lit("")), F.lit(PULL_METHOD))
    interval = F.coalesce(F.nullif("c.pullIntervalMs", F.lit(0)), F.lit(PULL_INTERVAL_MS))
    joined = strict.select(
        F.col("id").alias("source_id"), method.alias("method"), interval.cast("long").alias("interval_ms"),
        F.coalesce(F.nullif("c.filePath", F.lit("")), F.lit(PULL_PATH)).alias("path"),
        F.nullif("c.httpUrl", F.lit("")).alias("url"),
        F.nullif("c.serverId", F.lit("")).alias("server_id"),
    ).join(
        servers.select(F.col("id").alias("server_id"), F.col("status").alias("server_status")),
        "server_id", "left")
    ssh, http = F.col("method") == "ssh-tail", F.col("method") == "http"
    reason = (
        F.when(ssh & F.col("server_id").isNull(), "no server id")
        .when(ssh & F.col("server_status").isNull(), "server not found")
        .when(ssh & (F.col("server_status") != "active"), F.concat(F.lit("server is "), "server_status"))
        .when(http & F.col("url").isNull(), "no url")
        .when(~ssh & ~http, "unknown method")
    )
    return joined.select(
        "source_id", "method", "interval_ms",
        F.when(ssh, F.col("path")).when(http, F.col("url")).alias("target"),
        F.when(reason.isNull(), "due").otherwise("skipped").alias("status"),
        reason.alias("skip_reason"),
    )


def ingestion_status(logs: DataFrame, senders: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per measure: logs per route, mapped addresses, pull jobs by state."""
    none = F.lit(None).cast("timestamp_ntz")
    routes = logs.groupBy(F.col("metadata")["receivedVia"].alias("name")).agg(
        F.count("*").alias("n"), F.max("ts").alias("last_ts")).select(
        F.lit("route").alias("kind"), "name", "n", "last_ts")
    mapped = senders.agg(F.count("*").alias("n")).select(
        F.lit("senders").alias("kind"), F.lit("mapped").alias("name"), "n", none.alias("last_ts"))
    jobs = plan.groupBy(F.col("status").alias("name")).agg(F.count("*").alias("n")).select(
        F.lit("pull").alias("kind"), "name", "n", none.alias("last_ts"))
    return routes.unionByName(mapped).unionByName(jobs)


def provenance_counts(logs: DataFrame) -> DataFrame:
    """Rows per route and pull method."""
    meta = F.col("metadata")
    return logs.groupBy(
        meta["receivedVia"].alias("received_via"), meta["pullMethod"].alias("pull_method")
    ).agg(F.count("*").alias("n"), F.count(meta["senderIp"]).alias("with_sender"))
