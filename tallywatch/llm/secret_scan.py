"""Secrets in texts: fixed patterns, and credential values by the number of guesses they would take.

A value that follows a credential word is judged by dynamic programming over its segmentations into words, dates,
years, repeats, sequences, keyboard walks and single characters: the cheapest one gives the log10 of the guesses an
attacker needs. Values above a threshold are reported; placeholders such as ``password: changeme`` are not. The
words and their ranks come from counts over the distinct texts of the corpus, without such values, after a short
list of common passwords. All words count: a value that the common passwords leave strong meets those of its own
stretches that are words in a join.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallywatch.llm.common import bounded, documents, materialize, on_workers, positions

# The patterns of the contract and their least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")
_CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:password|passwd|passphrase|passcode|pwd|pass|secret|token|api[_ -]?key|access[_ -]?key|"""
    r"""credentials?|login|pin)["']?(?:\x20*(?:=>|[:=])\x20*|\x20is\x20)["']?([^\s"'<>,;]{4,})""", re.ASCII | re.IGNORECASE)
_CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "login", "pin")
# Common passwords, most common first; keyboard rows.
COMMON = (
    "password", "123456", "qwerty", "letmein", "admin", "welcome", "changeme", "secret", "dragon", "monkey", "master",
    "login", "test", "example", "sample", "default", "root", "guest", "user", "pass", "hello", "sunshine", "princess",
    "football", "baseball", "shadow", "trustno", "iloveyou", "superman", "token", "none", "null", "true", "false",
    "your", "here", "key", "abc", "placeholder", "redacted", "hidden", "xxxx")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("4@310$57!", "aaeiossti")
_WORD = re.compile(rb"[a-z\x80-\xff]{3,24}")
_REPEAT = re.compile(r"(.{1,16}?)\1+", re.DOTALL)
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._])(?:0?[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)")
_YEAR = re.compile(r"(?:19|20)\d\d")
LONGEST_WORD = 24
SEGMENT = math.log10(2)
#: Distinct texts a word must come from to count as one.
LEAST_TEXTS = 5
STRONG = 8.0
_COMMON_RANKS = {word: i for i, word in enumerate(COMMON, 1)}
_FOUND = ("doc_id long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, "
          "asked array<struct<start:int,end:int,key:binary,value:string>>")


def _neighbours() -> dict[str, set[str]]:
    """Keys next to each other on a keyboard whose rows are shifted by half a key."""
    near: dict[str, set[str]] = {}
    for y, row in enumerate(_ROWS):
        for x, key in enumerate(row):
            near.setdefault(key, set()).update(row[max(0, x - 1):x + 2])
            if y + 1 < len(_ROWS):
                for below in _ROWS[y + 1][max(0, x - 1):x + 1]:
                    near[key].add(below)
                    near.setdefault(below, set()).add(key)
    return near


_NEAR = _neighbours()
_PLACE = {key: (x, y) for y, row in enumerate(_ROWS) for x, key in enumerate(row)}


def _char_cost(char: str) -> float:
    if char.isdigit():
        return 1.0
    if char.isascii():
        return math.log10(26) if char.isalpha() else math.log10(33)
    return 2.0


def _runs(value: str, follows) -> Iterator[tuple[int, int]]:
    """Longest stretches of at least three characters in which each follows the one before."""
    start = 0
    for i in range(1, len(value) + 1):
        if i == len(value) or not follows(value, i):
            if i - start >= 3:
                yield start, i
            start = i


def _patterns(value: str) -> Iterator[tuple[int, int, float]]:
    """Dates, years, sequences, keyboard walks and repeats as ``(start, end, log10 guesses)``."""
    for m in _DATE.finditer(value):
        yield m.start(), m.end(), math.log10(365 * 100) + (0.6 if m[1] or m[2] else 0.0)
    for m in _YEAR.finditer(value):
        yield m.start(), m.end(), math.log10(120)
    for step in (1, -1):
        for a, b in _runs(value, lambda v, i, step=step: ord(v[i]) - ord(v[i - 1]) == step):
            yield a, b, math.log10(26 * (b - a))
    low = value.lower()
    for a, b in _runs(low, lambda v, i: v[i] != v[i - 1] and v[i] in _NEAR.get(v[i - 1], ())):
        places = [_PLACE[key] for key in low[a:b]]
        steps = [(x - u, y - v) for (u, v), (x, y) in zip(places, places[1:], strict=False)]
        turns = sum(s != t for s, t in zip(steps, steps[1:], strict=False))
        yield a, b, math.log10(len(_PLACE) * (b - a)) + turns * math.log10(5)
    for m in _REPEAT.finditer(value):
        yield m.start(), m.end(), sum(map(_char_cost, m[1])) + math.log10((m.end() - m.start()) // len(m[1]))


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses for a value: its cheapest segmentation. ``ranks``: dictionary words by frequency rank."""
    arcs: dict[int, list[tuple[int, float]]] = {}
    for start, end, cost in _patterns(value):
        arcs.setdefault(end, []).append((start, cost + SEGMENT))
    low = value.lower()
    plain = low.translate(_LEET)
    best = [0.0]
    for end in range(1, len(value) + 1):
        least = best[end - 1] + _char_cost(value[end - 1])
        for start, cost in arcs.get(end, ()):
            least = min(least, best[start] + cost)
        for start in range(max(0, end - LONGEST_WORD), end - 2):
            rank = ranks.get(low[start:end])
            extra = SEGMENT
            if rank is None:
                rank = ranks.get(plain[start:end])
                extra += 2 * SEGMENT
            if rank is not None:
                part = value[start:end]
                extra += 0.0 if part == low[start:end] else SEGMENT if part.istitle() or part.isupper() else 3 * SEGMENT
                least = min(least, best[start] + math.log10(rank) + extra)
        best.append(least)
    return best[-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns; leftmost and non-overlapping per kind, short matches dropped."""
    low = text.lower()
    spans = []
    if any(word in low for word in ("passw", "secret", "token", "api")):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def guess_spans(text: str, ranks: dict[str, int], strong: float = STRONG) -> list[tuple[int, int, int]]:
    """Values after credential words that take at least ``10 ** strong`` guesses."""
    low = text.lower()
    if not any(word in low for word in _CONTEXT_WORDS):
        return []
    spans = []
    for m in _CONTEXT.finditer(text):
        value = m[1].rstrip(".:!?)]}")
        if len(value) >= 4 and guess_cost(value, ranks) >= strong:
            spans.append((m.start(1), 3, m.start(1) + len(value)))
    return spans


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def without_values(text: str) -> str:
    """The text with the values after credential words blanked out."""
    low = text.lower()
    if not any(word in low for word in _CONTEXT_WORDS):
        return text
    spans = sorted([m.span(1) for m in _CONTEXT.finditer(text)] + [m.span(2) for m in _ASSIGN.finditer(text)])
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at:max(at, start)])
        at = max(at, end)
    return " ".join([*parts, text[at:]])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            seen.update(set(_WORD.findall(without_values(text.as_py()).encode("utf-8", "surrogatepass").lower())))
            if len(seen) > 400_000:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])
                seen.clear()
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])


def _distinct_texts(texts: DataFrame) -> DataFrame:
    """Each text once. Only texts whose hash comes more than once are shuffled."""
    hashed = texts.withColumn("hash", F.xxhash64("text"))
    again = bounded(hashed.groupBy("hash").count().filter("count > 1").select("hash"), "secret-copies")
    return hashed.join(again, "hash", "left_anti").select("text").unionByName(
        hashed.join(again, "hash", "left_semi").select("text").distinct())


def word_ranks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_TEXTS) -> DataFrame:
    """``word, rank`` of all corpus words of 3 to 24 letters: the more texts hold a word, the lower its rank.

    Counted over distinct texts, once in each; a word is what ``least`` texts hold, at any size of the corpus. Values after
    credential words do not count, so a leaked value does not become a word, however often it is copied. Ties go to the
    smaller word. Ranks follow those of the common passwords.
    """
    on_workers(docs.sparkSession)
    texts = _distinct_texts(documents(docs, id_col, text_col).select("text"))
    counted = texts.mapInArrow(_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rare = counted.filter(~F.col("word").isin([bytearray(word, "utf-8") for word in COMMON]))
    placed, _ = positions(rare, [F.desc("n"), F.asc("word")], "secret-words")
    return placed.select("word", (F.col("position") + len(COMMON) + 1).alias("rank"))


def _value_key(value: str) -> bytes:
    return hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _scan(strong: float):
    """Base spans of each text, and the values that the common passwords alone leave strong."""
    schema = to_arrow_schema(StructType.fromDDL(_FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                base = base_spans(text)
                asked = [{"start": a, "end": b, "key": _value_key(text[a:b]), "value": text[a:b]} for a, _, b in guess_spans(text, _COMMON_RANKS, strong)]
                rows.append((doc_id, hashlib.sha256(render(base).encode()).hexdigest(), [dict(zip(("start", "kind", "end"), s, strict=True)) for s in base], asked))
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    return run


def value_words(value: str) -> set[bytes]:
    """All stretches of letters in a value that may be dictionary words, as written and with digits read as letters."""
    low = value.lower()
    found = set()
    for text in {low, low.translate(_LEET)}:
        for m in re.finditer(r"[a-z\x80-\U0010ffff]{3,}", text):
            run = m[0]
            found.update(run[a:b] for a in range(len(run) - 2) for b in range(a + 3, min(a + LONGEST_WORD, len(run)) + 1))
    return {word.encode("utf-8", "surrogatepass") for word in found}


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = list(value_words(value))
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(words), pa.binary()), pa.array(words, pa.binary())], ["key", "word"])


def _weak(strong: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weak = []
            for row in batch.to_pylist():
                ranks = {bytes(w["word"]).decode("utf-8", "replace"): w["rank"] for w in row["words"]} | _COMMON_RANKS
                if guess_cost(row["value"], ranks) < strong:
                    weak.append(row["key"])
            yield pa.RecordBatch.from_arrays([pa.array(weak, pa.binary())], ["key"])
    return run


def weak_values(values: DataFrame, ranks: DataFrame, strong: float = STRONG) -> DataFrame:
    """``key`` of the values (``key, value``, distinct keys) that words of the corpus bring below ``10 ** strong`` guesses.

    Stretches of the values meet the ranked words in one join, so each value is judged with the words it holds and no
    dictionary is sent around.
    """
    held = values.mapInArrow(_parts, "key binary, word binary").join(ranks, "word").groupBy("key").agg(
        F.collect_list(F.struct("word", "rank")).alias("words"))
    return values.join(held, "key").select("key", "value", "words").mapInArrow(_weak(strong), "key binary")


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", strong: float = STRONG,
                 least: int = LEAST_TEXTS) -> DataFrame:
    """All rows: ``doc_id``, spans per base kind, ``n_guess``, ``base_sha256`` and ``spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, ordered by start and kind. Base spans cover the whole
    match; a ``guess`` span covers the value alone. Null texts count as empty, repeated rows are scanned each, no rows
    give no rows; other columns are ignored. Guesses go by the corpus's own ``word_ranks``.
    """
    on_workers(docs.sparkSession)
    found = documents(docs, id_col, text_col).mapInArrow(_scan(strong), _FOUND)
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    asked = found.select("row", F.explode("asked").alias("a")).select("row", "a.*")
    values = materialize(asked.groupBy("key").agg(F.first("value").alias("value")), "secret-values")
    weak = materialize(weak_values(values, word_ranks(docs, id_col, text_col, least), strong), "secret-weak")
    span = F.struct("start", F.lit(KINDS.index("guess")).alias("kind"), "end")
    guesses = asked.select("row", "key", span.alias("span")).join(weak, "key", "left_anti").groupBy("row").agg(F.collect_list("span").alias("more"))
    rows = found.join(guesses, "row", "left").withColumn("more", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    kinds = F.array(*map(F.lit, KINDS))
    text = lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return rows.select(
        "doc_id", *map(count, range(3)), F.size("more").cast("long").alias("n_guess"), "base_sha256",
        F.array_join(F.transform(F.array_sort(F.concat("base", "more")), text), ",").alias("spans"))
