"""Display formats, rounding and input checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from studyloom.functions.text import normalized_ends

#: Fixed value: hex or HSL colours.
COLOR = r"^#[0-9A-Fa-f]{6}$|^hsl\(\d+,\s*\d+%,\s*\d+%\)$"


def round_half_up(x: Column) -> Column:
    """To the nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5).cast("long")


def size_kb(n_bytes: Column) -> Column:
    return F.format_string("%.1f KB", n_bytes / F.lit(1024.0))


def minutes_seconds(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def difficulty_label(difficulty: Column) -> Column:
    return F.upper(F.coalesce(difficulty, F.lit("N/A")))


def valid_name(name: Column) -> Column:
    return F.coalesce(F.char_length(name).between(1, 255), F.lit(False))


def valid_color(color: Column) -> Column:
    # the engine's $ also stands before a final line break, which no colour has
    return F.coalesce(color.rlike(COLOR) & F.substring(color, -1, 1).rlike("[0-9A-Fa-f)]"), F.lit(True))


def safe_file_name(name: Column) -> Column:
    """The last path part, with everything but letters, digits, dot, underscore and hyphen replaced."""
    last = F.substring_index(F.translate(name, "\\", "/"), "/", -1)
    return F.regexp_replace(F.regexp_replace(last, r"[^A-Za-z0-9._-]", "_"), r"^\.+", "_")


def trimmed(text: Column) -> Column:
    return normalized_ends(text)
