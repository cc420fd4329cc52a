"""Alert rules: conditions over trailing windows, evaluated for all rules in one pass.

Logs inside the longest window are reduced once to *cells*, keyed by source, level,
age class and the set of rule keywords the message contains. All windows are multiples
of a grain (a minute, a second or a microsecond), and a row's class is its age rounded
up to the grain, so a cell is inside a window exactly when its class is not longer.
Every log lies in one cell, so counts over any union of conditions are plain sums, and
no rule reads the logs again.

What a condition asks of the cells is a *probe* (scope, window, levels or keyword). It
asks for *facets*: one level, one keyword, or all rows. Cells and asks of one scope and
facet are sorted together by age, and an ask reads the running sum at its place. So no
ask is paired with cells, and no join has the scope alone for a key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch import schemas
from tallywatch.functions.levels import ERROR_LEVELS
from tallywatch.functions.once import with_fields
from tallywatch.functions.text import or_default
from tallywatch.functions.timing import MICROS_PER_MINUTE, age_micros, as_ntz, within
from tallywatch.session import materialize

# Default windows, default cool-down, and the texts of a rule result.
WINDOW_MINUTES = 5.0
SILENCE_MINUTES = 10.0
COOLDOWN_MINUTES = 5
IN_COOLDOWN = "In cooldown period"
ALL_MET = "All conditions met"
NOT_ALL_MET = "Not all conditions met"
TITLE_PREFIX = "Rule Triggered: "
DEFAULT_DESCRIPTION = "Alert rule conditions were met"

# Letters of the pieces by which keywords are found, and bits of the set of wanted pieces.
GRAM = 3
PIECE_BITS = 16
# Rows that one salted task gives in a join of logs with rules, and rules listed beside one selector.
ROWS_PER_SALT = 1_000_000
RULES_PER_LIST = 1_000


# --- rules and conditions ----------------------------------------------------

def select_rules(rules: DataFrame, source_id: str | None = None) -> DataFrame:
    """Enabled rules; with a source, its own rules and the global ones."""
    enabled = rules.filter(F.col("status") == "enabled")
    if source_id is None:
        return enabled
    return enabled.filter((F.col("source_id") == source_id) | F.col("source_id").isNull())


def in_cooldown(as_of: dt.datetime) -> Column:
    """True before the end of the cool-down after the last trigger; the end itself is outside."""
    minutes = F.coalesce("cooldown_minutes", F.lit(COOLDOWN_MINUTES)).cast("int")
    end = F.col("last_triggered_at") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return F.coalesce(as_ntz(as_of) < end, F.lit(False))


def cooldown_gate(rules: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Rules with the flag ``suppressed``."""
    return rules.withColumn("suppressed", in_cooldown(as_of))


def parse_rules(rules: DataFrame) -> DataFrame:
    """Rules with their JSON text conditions as an array ``conds``, defaults filled in."""
    return rules.withColumn("_c", F.from_json("conditions", schemas.CONDITIONS)).withColumn("conds", F.expr(f"""
        transform(_c, (c, i) -> named_struct(
            'pos', i,
            'type', c.type,
            'threshold', c.params.threshold,
            'window_us', cast(round({MICROS_PER_MINUTE} * coalesce(
                c.params.timeWindowMinutes, CASE c.type WHEN 'no_logs' THEN {SILENCE_MINUTES}D ELSE {WINDOW_MINUTES}D END)) AS bigint),
            'levels', array_sort(array_distinct(transform(
                CASE WHEN startswith(ltrim(c.params.levels), '[') THEN from_json(c.params.levels, 'array<string>')
                     ELSE split(c.params.levels, ',') END, v -> lower(trim(v))))),
            'keywords', filter(coalesce(c.params.keywords, cast(array() AS array<string>)), k -> k IS NOT NULL),
            'match_all', coalesce(c.params.matchAll, false),
            'min_confidence', c.params.minConfidence,
            'anomaly_types', c.params.anomalyTypes))""")).drop("_c")


def validate_rules(rules: DataFrame) -> DataFrame:
    """Add ``_error``: why a rule row is not usable, null when it is fine."""
    conds = F.from_json("conditions", schemas.CONDITIONS)
    bad_type = F.exists(conds, lambda c: ~F.coalesce(c["type"].isin(schemas.CONDITION_TYPES), F.lit(False)))
    return rules.withColumn("_error", (
        F.when(F.col("name").isNull(), "name missing")
        .when(~F.coalesce(F.col("severity").isin(schemas.ALERT_SEVERITIES), F.lit(False)), "unknown severity")
        .when(~F.coalesce(F.col("status"), F.lit("enabled")).isin(schemas.RULE_STATUSES), "unknown status")
        .when(conds.isNull(), "conditions unreadable")
        .when(bad_type, "unknown condition type")
        .when(F.col("cooldown_minutes") < 1, "cool-down below one minute")
    ))


@dataclass
class RuleProfile:
    """The longest window of a rule set, and a grain that all its windows are multiples of."""

    longest_us: int
    grain_us: int

    def class_of(self, age: str) -> Column:
        """Age (a column of microseconds) rounded up to the grain."""
        return F.expr(f"({age} + {self.grain_us - 1}L) div {self.grain_us}L * {self.grain_us}L")


def keywords_of(parsed: DataFrame) -> DataFrame:
    """Distinct lower-case keywords of parsed rules."""
    asked = F.filter("conds", lambda c: c["type"] == "keyword_match")
    return parsed.select(F.explode(F.flatten(F.transform(asked, lambda c: c["keywords"]))).alias("k")).select(
        F.lower("k").alias("keyword")).distinct()


def rule_profile(parsed: DataFrame) -> RuleProfile:
    """One row about the windows is read, however many there are."""
    windows = parsed.select(F.explode(F.transform("conds", lambda c: c["window_us"])).alias("w"))
    top, minutes, seconds = windows.agg(
        F.max("w"), F.bool_and(F.col("w") % MICROS_PER_MINUTE == 0), F.bool_and(F.col("w") % 1_000_000 == 0)).first()
    return RuleProfile(top or 0, 1 if seconds is False else 1_000_000 if minutes is False else MICROS_PER_MINUTE)


# --- keywords ----------------------------------------------------------------

def pieces_of(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` letters of a text, found in one pass."""
    if size == 0:
        return F.when(text.isNotNull(), F.array(F.lit("")))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * size}))"), F.lit(1)))


def piece_test(pieces: DataFrame) -> Callable[[Column], Column]:
    """Test: may a piece be one of the column ``piece``? A set of hash bits of fixed size, read to the driver."""
    def bit_of(piece: Column) -> Column:
        return F.pmod(F.xxhash64(piece), F.lit(1 << PIECE_BITS)).cast("int")

    words = [0] * ((1 << PIECE_BITS) // 64)
    bit = bit_of(F.col("piece"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63))
    for row in pieces.select(F.shiftright(bit, 6).alias("word"), one.alias("b")).groupBy("word").agg(F.bit_or("b").alias("bits")).collect():
        words[row["word"]] = row["bits"]
    held = F.from_json(F.lit(str(words)), "array<bigint>")
    return lambda piece: F.getbit(F.get(held, F.shiftright(bit_of(piece), 6)), bit_of(piece).bitwiseAND(63)) == 1


def cut_keywords(keywords: DataFrame) -> tuple[DataFrame, list[int]]:
    """``(keyword, piece)`` for all pieces of each keyword, and their lengths. A keyword shorter than a piece is its own."""
    size = F.least(F.length("keyword"), F.lit(GRAM))
    sizes = sorted(r[0] for r in keywords.select(size.alias("n")).distinct().collect())
    cut = F.array().cast("array<string>")
    for n in sizes:
        cut = F.when(size == n, pieces_of(F.col("keyword"), n)).otherwise(cut)
    return keywords.select("keyword", F.explode(cut).alias("piece")), sizes


def keyword_index(logs: DataFrame, keywords: DataFrame) -> tuple[DataFrame, list[int]]:
    """``(keyword, piece)``: each keyword under its rarest piece by the counted messages; and the pieces' lengths.

    A keyword with a piece that no message holds cannot occur and is left out.
    """
    cut_up, sizes = cut_keywords(keywords)
    if not sizes:
        return cut_up, sizes
    counts = message_pieces(logs, sizes, cut_up).groupBy("piece").agg(F.count("*").alias("n"))
    found = cut_up.join(counts, "piece", "left").groupBy("keyword").agg(
        F.min(F.struct("n", "piece")).alias("rarest"), F.bool_and(F.col("n").isNotNull()).alias("whole"))
    return materialize(found.filter("whole").select("keyword", "rarest.piece"), "keyword-index"), sizes


def message_pieces(logs: DataFrame, sizes: list[int], wanted: DataFrame) -> DataFrame:
    """``(log_id, piece)`` of all messages, as far as the pieces may be among the wanted ones."""
    text = F.lower("message")
    every = F.concat(*(pieces_of(text, size) for size in sizes))
    return logs.select("log_id", F.explode(every).alias("piece")).filter(piece_test(wanted)(F.col("piece")))


def with_keyword_hits(logs: DataFrame, parsed: DataFrame) -> DataFrame:
    """Add ``hits``: the sorted lower-case rule keywords each message contains.

    Keywords of any number are found through an index of rare pieces: messages and keywords meet by equal pieces,
    without texts, and each message is then searched for the few keywords that met it.
    """
    index, sizes = keyword_index(logs, keywords_of(parsed))
    if not sizes:
        return logs.withColumn("hits", F.array().cast("array<string>"))
    met = message_pieces(logs, sizes, index).join(index, "piece").groupBy("log_id").agg(F.collect_set("keyword").alias("_met"))
    joined = with_fields(logs, F.struct(F.lower("message").alias("_text"))).join(met, "log_id", "left")
    held = F.array_sort(F.filter("_met", lambda k: F.contains(F.col("_text"), k)))
    # Through a generator, so a later filter or explode does not search again.
    return with_fields(joined, F.struct(F.coalesce(held, F.array().cast("array<string>")).alias("hits"))).drop("_met", "_text")


# --- cells -------------------------------------------------------------------

def recent_logs(logs: DataFrame, rules: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Logs inside the longest window of any enabled rule, with the columns that rules look at."""
    longest = rule_profile(parse_rules(select_rules(rules))).longest_us
    return within(logs, as_of - dt.timedelta(microseconds=longest), as_of).select("log_id", "source_id", "ts", "level", "message")


def tag_logs(logs: DataFrame, parsed: DataFrame, profile: RuleProfile, as_of: dt.datetime) -> DataFrame:
    """Logs inside the longest window with their age class and keyword hits."""
    recent = within(logs, as_of - dt.timedelta(microseconds=profile.longest_us), as_of)
    aged = with_keyword_hits(recent, parsed).withColumn("age_us", age_micros(F.col("ts"), as_of))
    return aged.select("log_id", "source_id", "ts", "age_us", "level", "hits", profile.class_of("age_us").alias("class_us"))


def total_over_sources(by_source: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Counts per source with the total over all sources added under a null scope.

    The counts are repeated under both scopes and summed again, so the logs behind
    them are read once. ``more``: further aggregates over the repeated rows.
    """
    scopes = F.array_distinct(F.array(F.col("source_id"), F.lit(None).cast("string")))
    return by_source.withColumn("scope", F.explode(scopes)).groupBy("scope", *keys).agg(
        F.sum("n").alias("n"), *more)


def cells_of(tagged: DataFrame) -> DataFrame:
    """Counts per (scope, level, class, hits), each with its first row: the newest, then the lowest id."""
    keys = ["level", "class_us", "hits"]
    first = F.struct("age_us", "log_id")
    by_source = tagged.groupBy("source_id", *keys).agg(F.count("*").alias("n"), F.min(first).alias("first"))
    return total_over_sources(by_source, keys, F.min("first").alias("first"))


# --- probes ------------------------------------------------------------------

def _ask(role: str, levels: str = "cast(NULL AS array<string>)", keyword: str = "cast(NULL AS string)") -> str:
    return (f"named_struct('pos', c.pos, 'role', '{role}', 'window_us', c.window_us, "
            f"'levels', {levels}, 'keyword', {keyword})")


# What the conditions ask: role ``hit`` for their matches, ``total`` for all rows.
_ERRORS = "array(" + ", ".join(f"'{level}'" for level in ERROR_LEVELS) + ")"
ASKS = f"""
flatten(filter(transform(conds, c -> CASE c.type
    WHEN 'error_count' THEN array({_ask("hit", _ERRORS)})
    WHEN 'error_rate' THEN array({_ask("hit", _ERRORS)}, {_ask("total")})
    WHEN 'log_level' THEN array({_ask("hit", "c.levels")})
    WHEN 'keyword_match' THEN transform(array_distinct(transform(c.keywords, k -> lower(k))), k -> {_ask("hit", keyword="k")})
    WHEN 'no_logs' THEN array({_ask("total")})
  END), a -> a IS NOT NULL))"""


def probes_of(parsed: DataFrame) -> DataFrame:
    """Asks of all rules as rows; equal ``probe`` texts are answered once."""
    rows = parsed.select(
        F.col("id").alias("rule_id"), F.col("source_id").alias("scope"), F.explode(F.expr(ASKS)).alias("a"))
    rows = rows.select("rule_id", "scope", "a.pos", "a.role", "a.window_us", "a.levels", "a.keyword")
    return rows.withColumn("probe", F.to_json(F.struct("scope", "window_us", "levels", "keyword")))


# Facets of an ask, and of a cell or tagged row.
ALL_ROWS = "*"


def facets_of_asks(asks: DataFrame) -> DataFrame:
    """One row per facet an ask takes: its levels, its keyword, or all rows. An ask for no level has none."""
    facets = (
        F.when(F.col("levels").isNotNull(), F.transform("levels", lambda v: F.concat(F.lit("level:"), v)))
        .when(F.col("keyword").isNotNull(), F.array(F.concat(F.lit("word:"), "keyword"))).otherwise(F.array(F.lit(ALL_ROWS))))
    return asks.withColumn("facet", F.explode(facets))


def facets_of_rows() -> Column:
    """Facets of a row with ``level`` and ``hits``."""
    words = F.transform("hits", lambda w: F.concat(F.lit("word:"), w))
    return F.array_compact(F.concat(F.array(F.lit(ALL_ROWS), F.concat(F.lit("level:"), F.col("level"))), words))


def look_up(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """Distinct asks ``(scope, facet, window_us)`` with the count ``n`` and the ``first`` row of their facet in their window.

    Cells and asks of a scope and facet lie in one sorted list, of as many rows as there are ages and windows.
    """
    keys = ["scope", "facet"]
    held = cells.select("scope", F.explode(facets_of_rows()).alias("facet"), F.col("class_us").alias("at"), "n", "first").groupBy(
        *keys, "at").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.lit(0).alias("asks"))
    wanted = asked.select(*keys, F.col("window_us").alias("at")).distinct().select(
        *keys, "at", F.lit(0).cast("long").alias("n"), F.lit(None).cast(cells.schema["first"].dataType).alias("first"), F.lit(1).alias("asks"))
    upto = Window.partitionBy(*keys).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = held.unionByName(wanted).select(*keys, "at", "asks", F.sum("n").over(upto).alias("n"), F.min("first").over(upto).alias("first"))
    return run.filter("asks = 1").select(*keys, F.col("at").alias("window_us"), "n", "first")


def _with_found(asks: DataFrame, cells: DataFrame) -> DataFrame:
    """Asks with a facet, with ``n`` and ``first``."""
    found = look_up(asks, cells).select(F.col("scope").alias("_s"), F.col("facet").alias("_f"), F.col("window_us").alias("_w"), "n", "first")
    return asks.join(found, F.col("scope").eqNullSafe(F.col("_s")) & (F.col("facet") == F.col("_f")) & (F.col("window_us") == F.col("_w"))).drop(
        "_s", "_f", "_w")


def answer_probes(probes: DataFrame, cells: DataFrame) -> DataFrame:
    """Count per distinct probe that asks for anything; its levels are distinct, so their counts add up."""
    distinct = probes.select("probe", "scope", "window_us", "levels", "keyword").dropDuplicates(["probe"])
    return _with_found(facets_of_asks(distinct), cells).groupBy("probe").agg(F.sum("n").alias("n"))


def collect_answers(answered: DataFrame, *keys: str) -> DataFrame:
    """Answers of a rule as one array (as long as the rule has asks)."""
    return answered.groupBy(*keys).agg(
        F.collect_list(F.struct("pos", "role", "keyword", "n")).alias("answers"))


# Conditions with their counts and the flag ``met``. Unknown types, ``custom``, and
# ``ai_anomaly`` without stored anomalies are not met, and neither is a comparison
# with a missing threshold. Each distinct spelling of a keyword counts once; the
# list it is compared with keeps repeats.
# How many spellings of a condition's keywords one lower-case keyword stands for.
SPELLINGS = "cast(size(filter(array_distinct(keywords), k -> lower(k) = keyword)) AS bigint)"
NO_ANSWERS = "cast(array() AS array<struct<pos: int, role: string, keyword: string, n: bigint>>)"
JUDGED = """
transform(
  transform(conds, c -> named_struct(
    'c', c,
    'hits', aggregate(filter(answers, a -> a.pos = c.pos AND a.role = 'hit'), 0L, (s, a) -> s + a.n),
    'total', aggregate(filter(answers, a -> a.pos = c.pos AND a.role = 'total'), 0L, (s, a) -> s + a.n),
    'matched', size(filter(array_distinct(c.keywords), k -> exists(
        answers, a -> a.pos = c.pos AND a.n > 0 AND a.keyword = lower(k)))))),
  x -> named_struct(
    'pos', x.c.pos, 'type', x.c.type, 'hits', x.hits, 'total', x.total, 'keywords_matched', x.matched,
    'met', coalesce(CASE x.c.type
        WHEN 'error_count' THEN x.hits >= x.c.threshold
        WHEN 'error_rate' THEN x.total > 0 AND try_divide(x.hits, x.total) >= x.c.threshold
        WHEN 'log_level' THEN x.hits > 0
        WHEN 'keyword_match' THEN CASE WHEN x.c.match_all THEN x.matched = size(x.c.keywords) ELSE x.matched > 0 END
        WHEN 'no_logs' THEN x.total = 0
        WHEN 'ai_anomaly' THEN array_contains(anomaly_pos, x.c.pos)
      END, false)))"""


def anomaly_onsets(parsed: DataFrame, anomalies: DataFrame) -> DataFrame:
    """``(rule_id, pos, onset)``: when the first anomaly that meets an ai_anomaly condition was stored.

    ``anomalies``: (source_id, type, confidence, created_at). The earliest per source, type and confidence decides, so only
    that is kept before the join. Like silence, the condition adds no log ids.
    """
    earliest = anomalies.groupBy(F.col("source_id").alias("_scope"), F.col("type").alias("_type"), "confidence").agg(
        F.min("created_at").alias("created_at"))
    overall = earliest.groupBy("_type", "confidence").agg(F.min("created_at").alias("created_at")).withColumn(
        "_scope", F.lit(None).cast("string"))
    scoped = earliest.filter(F.col("_scope").isNotNull()).unionByName(overall)
    asked = parsed.select(F.col("id").alias("rule_id"), "source_id", F.explode(
        F.filter("conds", lambda c: c["type"] == "ai_anomaly")).alias("c")).select(
        "rule_id", "source_id", "c.pos", "c.min_confidence", F.explode(F.array_distinct("c.anomaly_types")).alias("type"))
    return (
        asked.join(scoped, F.col("source_id").eqNullSafe(F.col("_scope")) & (F.col("type") == F.col("_type"))
                   & (F.col("confidence") >= F.col("min_confidence")))
        .groupBy("rule_id", "pos").agg(F.min("created_at").alias("onset"))
    )


def anomaly_positions(parsed: DataFrame, anomalies: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Positions of ai_anomaly conditions that an anomaly stored by now meets, per rule."""
    onsets = anomaly_onsets(parsed, anomalies.filter(F.col("created_at") <= as_ntz(as_of)))
    return onsets.groupBy(F.col("rule_id").alias("id")).agg(F.collect_set("pos").alias("anomaly_pos"))


def judge_rules(parsed: DataFrame, cells: DataFrame, anomalies: DataFrame | None,
                as_of: dt.datetime) -> DataFrame:
    """Parsed rules with ``judged`` (their conditions with counts and verdicts)."""
    probes = probes_of(parsed)
    answered = probes.join(answer_probes(probes, cells), "probe", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    answers = collect_answers(answered, "rule_id")
    rows = parsed.join(answers.withColumnRenamed("rule_id", "id"), "id", "left")
    if anomalies is None:
        rows = rows.withColumn("anomaly_pos", F.expr("cast(array() AS array<int>)"))
    else:
        rows = rows.join(anomaly_positions(parsed, anomalies, as_of), "id", "left")
    known = rows.withColumn("answers", F.coalesce("answers", F.expr(NO_ANSWERS)))
    return known.withColumn("judged", F.expr(JUDGED))


def condition_results(rules: DataFrame, logs: DataFrame, as_of: dt.datetime,
                      anomalies: DataFrame | None = None) -> DataFrame:
    """One row per condition of the given rules, whatever their status or cool-down."""
    parsed = parse_rules(rules)
    tagged = tag_logs(logs, parsed, rule_profile(parsed), as_of)
    judged = judge_rules(parsed, cells_of(tagged), anomalies, as_of)
    return judged.select(F.col("id").alias("rule_id"), F.inline("judged"))


# --- matches -----------------------------------------------------------------

def with_matches(judged: DataFrame) -> DataFrame:
    """Add the first miss and two selector texts: all counted asks, and those of the first match.

    Counted are the met conditions before the first miss; rules with the same scope
    and asks share a selector.
    """
    def selector(asks: str) -> str:
        plain = f"array_sort(array_distinct(transform({asks}, a -> named_struct('window_us', a.window_us, 'levels', a.levels, 'keyword', a.keyword))))"
        return f"CASE WHEN first_hit IS NOT NULL THEN to_json(named_struct('scope', source_id, 'asks', {plain})) END"

    counted = "a.role = 'hit' AND (first_miss IS NULL OR a.pos < first_miss)"
    return (
        judged.withColumn("first_miss", F.expr("array_min(transform(filter(judged, j -> NOT j.met), j -> j.pos))"))
        .withColumn("first_hit", F.expr(f"array_min(transform(filter(answers, a -> a.n > 0 AND {counted}), a -> a.pos))"))
        .withColumn("_asks", F.expr(f"filter({ASKS}, a -> {counted})"))
        .withColumn("selector", F.expr(selector("_asks")))
        .withColumn("first_selector", F.expr(selector("filter(_asks, a -> a.pos = first_hit)")))
        .drop("_asks")
    )


SELECTOR = (
    "scope string, asks array<struct<window_us: bigint, levels: array<string>, keyword: string>>")


def _selectors(state: DataFrame, column: str) -> DataFrame:
    """Distinct selectors of the rules as (selector, scope, asks)."""
    return (
        state.select(F.col(column).alias("selector")).filter(F.col("selector").isNotNull()).distinct()
        .withColumn("_s", F.from_json("selector", SELECTOR)).select("selector", "_s.scope", "_s.asks")
    )


# Asks for levels first; and the place (from 1) of the first ask that a cell or tagged row answers.
_LEVELS_FIRST = "concat(filter(asks, a -> a.keyword IS NULL), filter(asks, a -> a.keyword IS NOT NULL))"
_FIRST_ASK = """
array_position(transform(asks, a -> class_us <= a.window_us
    AND (a.levels IS NULL OR coalesce(array_contains(a.levels, level), false))
    AND (a.keyword IS NULL OR array_contains(hits, a.keyword))), true)"""
# Of a row and an ask of one scope and facet: is the row in its window, and does no ask before it take the row?
_TAKES = f"class_us <= window_us AND (place = 1 OR {_FIRST_ASK} = place)"


def _asks_of(selectors: DataFrame, *keep: str) -> DataFrame:
    """One row per ask of a selector and facet it takes; ``place``: its place among the asks, those for levels first."""
    asks = selectors.withColumn("asks", F.expr(_LEVELS_FIRST)).select(*keep, "scope", "asks", F.posexplode("asks").alias("place", "a"))
    return facets_of_asks(asks.select(*keep, "scope", "asks", (F.col("place") + 1).alias("place"), "a.window_us", "a.levels", "a.keyword"))


def _same_facet(scope: str, facet: str) -> Column:
    return F.col("scope").eqNullSafe(F.col(scope)) & (F.col("facet") == F.col(facet))


def _rule_lists(state: DataFrame) -> DataFrame:
    """``(selector, rule_ids)``: the rules of each selector, in lists of bounded length."""
    lists = state.groupBy("selector").agg((1 + F.floor(F.count("*") / RULES_PER_LIST)).alias("lists"))
    dealt = state.join(lists, "selector").withColumn("_list", F.pmod(F.xxhash64("rule_id"), F.col("lists")))
    return dealt.groupBy("selector", "_list").agg(F.collect_list("rule_id").alias("rule_ids")).drop("_list")


def _rows_of_rules(state: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(rule_id, log_id) for every row a rule's selector takes; each pair once, from the first ask that takes the row.

    Rows meet selectors, and are then repeated for the rules of each. A row is repeated only for facets and scopes that
    some rule asks for, in a window that reaches it. The pairs of a scope and facet are counted from the cells first, and
    a salt from the row id deals them over as many tasks as they need; the small side is repeated per salt.
    """
    lists = _rule_lists(state.filter(F.col("selector").isNotNull())).withColumn("_s", F.from_json("selector", SELECTOR))
    asks = materialize(_asks_of(lists.select("rule_ids", "_s.scope", "_s.asks"), "rule_ids"), "rule-asks")
    rules_of_ask = asks.groupBy("scope", "facet", "window_us").agg(F.sum(F.size("rule_ids")).alias("rules"))
    pairs = F.sum(F.coalesce("n", F.lit(0)) * F.col("rules"))
    reach = materialize(_with_found(rules_of_ask, cells).groupBy("scope", "facet").agg(
        F.max("window_us").alias("reach"), pairs.alias("pairs")).withColumn(
        "salts", 1 + F.floor(F.col("pairs") / ROWS_PER_SALT)), "rule-reach")
    tasks = 1 + (reach.agg(F.sum("pairs")).first()[0] or 0) // ROWS_PER_SALT
    of_all = reach.filter("scope IS NULL").select(F.col("facet").alias("_f"), F.struct("reach", "salts").alias("_all"))
    of_source = reach.filter("scope IS NOT NULL").select(F.col("scope").alias("_s"), F.col("facet").alias("_g"), F.struct("reach", "salts").alias("_own"))
    faceted = rows.withColumn("_facet", F.explode(facets_of_rows())).join(of_all, F.col("_facet") == F.col("_f"), "left").join(
        of_source, (F.col("source_id") == F.col("_s")) & (F.col("_facet") == F.col("_g")), "left")
    scopes = F.array_compact(F.array(
        F.when(F.col("class_us") <= F.col("_all.reach"), F.struct(F.lit(None).cast("string").alias("scope"), F.col("_all.salts").alias("salts"))),
        F.when(F.col("class_us") <= F.col("_own.reach"), F.struct(F.col("source_id").alias("scope"), F.col("_own.salts").alias("salts")))))
    scoped = faceted.select("log_id", "level", "hits", "class_us", "_facet", F.explode(scopes).alias("_o")).select(
        "log_id", "level", "hits", "class_us", "_facet", F.col("_o.scope").alias("_scope"),
        F.pmod(F.xxhash64("log_id"), F.col("_o.salts")).alias("_row_salt"))
    of_facet = reach.select(F.col("scope").alias("_s"), F.col("facet").alias("_f"), "salts")
    salted = asks.join(of_facet, F.col("scope").eqNullSafe(F.col("_s")) & (F.col("facet") == F.col("_f"))).drop("_s", "_f").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    # Few and small rows make many pairs, so tasks are counted by pairs and not by bytes, whichever side is moved.
    dealt_rows = scoped.repartition(tasks, "_scope", "_facet", "_row_salt")
    dealt_asks = salted.repartition(tasks, "scope", "facet", "_salt")
    joined = dealt_rows.join(dealt_asks, _same_facet("_scope", "_facet") & (F.col("_salt") == F.col("_row_salt")))
    return joined.filter(F.expr(_TAKES)).select(F.explode("rule_ids").alias("rule_id"), "log_id")


def _matched_counts(selectors: DataFrame, cells: DataFrame) -> DataFrame:
    """Exact number of distinct rows per selector and the first of them, from the cells alone.

    What the asks for levels take is looked up, each level in its longest window. Rows of keywords beyond these are
    counted from the cells that hold the keyword.
    """
    asks = materialize(_asks_of(selectors, "selector"), "selector-asks")
    by_level = asks.filter(F.col("keyword").isNull()).groupBy("selector", "scope", "facet").agg(F.max("window_us").alias("window_us"))
    levels = _with_found(by_level, cells).select("selector", "n", "first")
    worded = cells.filter(F.size("hits") > 0).select(F.col("scope").alias("_scope"), F.explode("hits").alias("_w"), "level", "hits", "class_us", "n", "first")
    words = asks.filter(F.col("keyword").isNotNull()).join(worded.withColumn("_facet", F.concat(F.lit("word:"), "_w")), _same_facet("_scope", "_facet"))
    words = words.filter(F.expr(_TAKES)).select("selector", "n", "first")
    return levels.unionByName(words).groupBy("selector").agg(F.sum("n").alias("matched_count"), F.min("first").alias("first"))


def _match_state(rules: DataFrame, logs: DataFrame, as_of: dt.datetime,
                 anomalies: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Selectors ``(rule_id, selector)`` of the rules outside their cool-down, with the tagged logs and their cells."""
    parsed = parse_rules(rules.filter(~in_cooldown(as_of)))
    tagged = tag_logs(logs, parsed, rule_profile(parsed), as_of)
    cells = materialize(cells_of(tagged), "rule-cells")
    state = with_matches(judge_rules(parsed, cells, anomalies, as_of)).select(
        F.col("id").alias("rule_id"), "selector")
    return materialize(state, "rule-state"), tagged, cells


def matched_logs(rules: DataFrame, logs: DataFrame, as_of: dt.datetime,
                 anomalies: DataFrame | None = None) -> DataFrame:
    """Whole match table (rule_id, log_id): no cap, one row per pair.

    Holds the matches of met conditions before the first miss, so a rule that did
    not trigger can have rows too. Rules in cool-down have none.
    """
    return _rows_of_rules(*_match_state(rules, logs, as_of, anomalies))


def matched_sets(rules: DataFrame, logs: DataFrame, as_of: dt.datetime,
                 anomalies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``matched_logs`` in two tables: (rule_id, match_set), and (match_set, log_id).

    Rules with the same selector share a set, whose logs are listed once. Joined by set, the two are the whole match
    table. The name of a set holds the time, so sets of several evaluations can be kept side by side.
    """
    state, tagged, cells = _match_state(rules, logs, as_of, anomalies)
    name = F.concat(F.lit(as_of.strftime("%Y%m%d%H%M%S%f") + "-"), F.sha2("selector", 256))
    named = state.filter(F.col("selector").isNotNull()).withColumn("match_set", name)
    sets = named.select(F.col("match_set").alias("rule_id"), "selector").distinct()
    return named.select("rule_id", "match_set"), _rows_of_rules(sets, tagged, cells).withColumnRenamed("rule_id", "match_set")


def evaluate_rules(rules: DataFrame, logs: DataFrame, as_of: dt.datetime,
                   source_id: str | None = None, anomalies: DataFrame | None = None,
                   any_status: bool = False) -> DataFrame:
    """One row per rule: verdict, exact match count, first match, reason.

    A rule without conditions triggers. Windows are closed at both ends by ``as_of``.
    The first match (of the lowest condition position, then newest, then lowest id)
    is the log a ticket points at; all matches are rows of ``matched_logs``. The logs
    are read once, into the cells; cells and rule states are written, because several
    later steps read them.
    """
    chosen = rules if any_status else select_rules(rules, source_id)
    gated = cooldown_gate(chosen, as_of)
    parsed = parse_rules(gated.filter(~F.col("suppressed")))
    tagged = tag_logs(logs, parsed, rule_profile(parsed), as_of)
    cells = materialize(cells_of(tagged), "rule-cells")
    state = materialize(with_matches(judge_rules(parsed, cells, anomalies, as_of)).select(
        F.col("id").alias("rule_id"), "first_miss", "selector", "first_selector"), "rule-state")

    both = _selectors(state, "selector").unionByName(_selectors(state, "first_selector")).dropDuplicates(["selector"])
    found = materialize(_matched_counts(both, cells), "rule-counts")
    counts = found.select("selector", "matched_count")
    firsts = found.select(F.col("selector").alias("first_selector"), F.col("first.log_id").alias("first_log_id"))
    base = gated.select(
        F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "source_id", "severity",
        "description", "suppressed")
    out = (
        base.join(state, "rule_id", "left")
        .join(counts, "selector", "left").join(firsts, "first_selector", "left")
    )
    triggered = ~F.col("suppressed") & F.col("first_miss").isNull()
    return out.select(
        "rule_id", "rule_name", "source_id", "severity", "description",
        triggered.alias("triggered"),
        F.coalesce("matched_count", F.lit(0)).cast("long").alias("matched_count"),
        "first_log_id",
        F.when(F.col("suppressed"), IN_COOLDOWN).when(triggered, ALL_MET).otherwise(NOT_ALL_MET).alias("reason"),
    )


def test_rule(rules: DataFrame, logs: DataFrame, as_of: dt.datetime, rule_id: str | None = None,
              **options) -> DataFrame:
    """Evaluate rules in any status; cool-down still applies and nothing is stored."""
    chosen = rules if rule_id is None else rules.filter(F.col("id") == rule_id)
    return evaluate_rules(chosen, logs, as_of, any_status=True, **options)


# Not a unit test, whatever its name looks like to a collector.
test_rule.__test__ = False


def trigger_alerts(results: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One active alert per triggered rule; its logs are the rows of ``alert_logs``."""
    stamp = as_of.strftime("%Y%m%d%H%M%S%f")
    return results.filter("triggered").select(
        F.concat(F.lit("alert-"), "rule_id", F.lit("-" + stamp)).alias("id"),
        "rule_id", "source_id",
        F.concat(F.lit(TITLE_PREFIX), "rule_name").alias("title"),
        F.coalesce(F.nullif("description", F.lit("")), or_default(F.col("reason"), DEFAULT_DESCRIPTION)).alias("description"),
        "severity", F.lit("active").alias("status"),
        F.struct(
            F.col("rule_name").alias("ruleName"), F.col("reason").alias("triggerReason"),
            F.col("matched_count").alias("matchedLogCount")).alias("metadata"),
        "first_log_id", as_ntz(as_of).alias("created_at"),
    )


def alert_logs(alerts: DataFrame, matches: DataFrame, of: str = "log_id") -> DataFrame:
    """``(alert_id, log_id)``: every log behind each alert, from the match table of the same evaluation; or, of its sets, ``(alert_id, match_set)``."""
    return matches.join(alerts.select(F.col("id").alias("alert_id"), "rule_id"), "rule_id").select("alert_id", of)


def create_alerts(manual: DataFrame) -> DataFrame:
    """Manual alerts: always active, optional references kept."""
    optional = {"rule_id": "string", "source_id": "string", "analysis_id": "string", "log_ids": "array<string>"}
    for name, kind in optional.items():
        if name not in manual.columns:
            manual = manual.withColumn(name, F.lit(None).cast(kind))
    return manual.withColumn("status", F.lit("active"))


def rule_stats(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Last trigger time and trigger count per rule, stored values continued by the alerts."""
    fired = alerts.groupBy("rule_id").agg(F.max("created_at").alias("_last"), F.count("*").alias("_n"))
    return rules.join(fired, rules["id"] == fired["rule_id"], "left").select(
        rules["id"].alias("rule_id"),
        F.greatest("last_triggered_at", "_last").alias("last_triggered_at"),
        (F.coalesce("trigger_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("trigger_count"),
    )


def rule_listing(rules: DataFrame, owner_id: str | None = None) -> DataFrame:
    """Rules, newest first, optionally of one owner."""
    chosen = rules if owner_id is None else rules.filter(F.col("owner_id") == owner_id)
    return chosen.orderBy(F.desc("created_at"), "id")


def set_rule_status(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules with status changes ``(id, status)`` applied."""
    new = changes.select("id", F.col("status").alias("_new"))
    return rules.join(new, "id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
