"""Text helpers: trimming, brace extraction, template masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywatch.functions.once import bind

# Characters removed by a trim of a raw line.
BLANKS = " \t\n\r\x0b\x0c\u00a0\ufeff"

# Masks that turn a message into its template, applied in this order.
TEMPLATE_MASKS = [
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<id>", "-"),
    (r"[0-9]+(\.[0-9]+){3}", "<ip>", "."),
    (r"[0-9]+", "<n>", None),
]


def strip(line: Column) -> Column:
    """Remove blanks of every kind from both ends."""
    return F.btrim(line, F.lit(BLANKS))


def split_lines(text: Column) -> Column:
    """Split on newline, keeping empty pieces."""
    return F.split(text, "\n", -1)


def brace_block(text: Column) -> Column:
    """The text from the first opening to the last closing brace; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def template_of(message: Column) -> Column:
    """Message with ids, addresses and numbers masked.

    A mask is skipped when the text lacks the character every match must have.
    """
    def masked(text: Column, pattern: str, mark: str, needs: str | None) -> Column:
        if needs is None:
            return F.regexp_replace(text, pattern, mark)
        return bind(text, lambda t: F.when(
            F.contains(t, F.lit(needs)), F.regexp_replace(t, pattern, mark)).otherwise(t))

    for pattern, mark, needs in TEMPLATE_MASKS:
        message = masked(message, pattern, mark, needs)
    return message


def or_default(value: Column, default: str) -> Column:
    """The value, or the default when it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))
