"""Log level vocabulary and the expressions that map raw values onto it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level names, in rising order of severity.
LEVELS = ["debug", "info", "warn", "error", "fatal"]
ERROR_LEVELS = ["error", "fatal"]

# Shipper level names accepted for each stored level.
LEVEL_NAMES = {
    "debug": ["DEBUG", "TRACE", "VERBOSE"],
    "info": ["INFO", "NOTICE"],
    "warn": ["WARNING", "WARN"],
    "error": ["ERROR", "ERR"],
    "fatal": ["FATAL", "CRITICAL", "EMERGENCY", "ALERT"],
}

# Words looked for in free text, tested in this order.
LEVEL_WORDS = [
    ("error", ["error", "err"]),
    ("warn", ["warn"]),
    ("fatal", ["fatal", "critical"]),
    ("debug", ["debug"]),
]

# Stored level for each syslog severity.
SYSLOG_SEVERITY_LEVELS = ["fatal", "fatal", "fatal", "error", "warn", "info", "info", "debug"]


def is_error(level: Column) -> Column:
    """True for the levels that count as errors."""
    return level.isin(ERROR_LEVELS)


def normalize_level(raw: Column) -> Column:
    """Stored level for a shipper's level name; null when the name is unknown."""
    name = F.upper(F.trim(raw))
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for level, names in LEVEL_NAMES.items():
        chain = chain.when(name.isin(names), F.lit(level))
    return chain


def detect_level(message: Column, explicit: Column | None = None) -> Column:
    """Level guessed from words in the text; an explicit level wins when there is one.

    The words are tested in a fixed order, so "fatal error" counts as error and
    "interrupt" too, because it contains "err".
    """
    text = F.lower(message)
    chain = None
    for level, words in LEVEL_WORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(text, F.lit(word))
        chain = F.when(hit, F.lit(level)) if chain is None else chain.when(hit, F.lit(level))
    guessed = chain.otherwise(F.lit("info"))
    if explicit is None:
        return guessed
    return F.coalesce(F.lower(explicit), guessed)


def severity_to_level(severity: Column) -> Column:
    """Stored level for a syslog severity 0..7."""
    table = F.array(*[F.lit(level) for level in SYSLOG_SEVERITY_LEVELS])
    return F.get(table, severity.cast("int"))
