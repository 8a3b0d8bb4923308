"""Severity of a log line, and the line without its prefix. All expressions are native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Level names by code, the aliases of each, and the icons.
LEVELS = ("UNKNOWN", "TRACE", "DEBUG", "INFO", "NOTICE", "WARN", "ERROR", "CRITICAL", "FATAL")
ALIASES = {
    "TRACE": 1, "TRC": 1, "DEBUG": 2, "DBG": 2, "INFO": 3, "INFORMATION": 3, "NOTICE": 4, "WARN": 5, "WARNING": 5, "ERROR": 6, "ERR": 6,
    "CRITICAL": 7, "CRIT": 7, "ALERT": 7, "FATAL": 8, "PANIC": 8, "EMERG": 8, "EMERGENCY": 8,
}
ICONS = ("·", "·", "·", " ", " ", "⚠", "✖", "✖", "🚨")
SCAN_BYTES, SCAN_WORDS = 200, 8

_names = "|".join(sorted(ALIASES, key=len, reverse=True))
#: The earliest alias among the first words: in brackets, or bare between word edges but not after a slash or dot.
PATTERN = (
    rf"(?i)^((?:[^A-Za-z]*+[A-Za-z]++){{0,{SCAN_WORDS - 1}}}?[^A-Za-z]*?)"
    rf"(?:\[({_names})(?![A-Za-z])\]?|(?<![/.A-Za-z\[])({_names})(?![A-Za-z])(?=[: \t]|\z)):?[ \t]?"
)
#: Timestamps that may lead a line without a level: ISO, syslog, bracketed ISO.
_ISO = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
LEADING = rf"^(?:{_ISO}(?:\.\d{{1,9}})?(?:Z|[+-]\d{{2}}:?\d{{2}})?|(?:{_MONTHS}) {{1,2}}\d{{1,2}} \d{{2}}:\d{{2}}:\d{{2}}|\[{_ISO}[^\]]*\])[ \t]?"


def code_of(name: Column) -> Column:
    """Level code of an alias; 0 for other names."""
    table = F.create_map(*(F.lit(x) for item in ALIASES.items() for x in item))
    return F.coalesce(F.element_at(table, F.upper(name)), F.lit(0)).cast("byte")


def _head(raw: Column) -> Column:
    """The first bytes of a line, in which the level is looked for; a character that the cut halves is none."""
    cut = F.make_valid_utf8(F.substring(F.encode(raw, "UTF-8"), 1, SCAN_BYTES).cast("string"))
    return F.when(F.octet_length(raw) > SCAN_BYTES, cut).otherwise(raw)


def _prefix(raw: Column) -> Column:
    """The line up to the end of the level marker; empty without one. Severity and content both start from it, so it is found once."""
    return F.regexp_extract(_head(raw), PATTERN, 0)


def consumed(raw: Column) -> Column:
    """Characters up to the end of the level marker; 0 without one."""
    return F.length(_prefix(raw))


def severity(raw: Column) -> Column:
    return code_of(F.regexp_extract(_prefix(raw), r"([A-Za-z]+)\]?:?[ \t]?\z", 1))


def strip_time(raw: Column) -> Column:
    return F.regexp_replace(raw, LEADING, "")


def content(raw: Column) -> Column:
    """The line after its level marker, or else after a leading timestamp."""
    return F.when(consumed(raw) > 0, F.substring(raw, consumed(raw) + 1, F.length(raw))).otherwise(strip_time(raw))


def level_name(code: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in LEVELS)), code.cast("int"))


def rank(code: Column) -> Column:
    """Unknown ranks as INFO."""
    return F.when(code == 0, 3).otherwise(code.cast("int"))


def icon(code: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in ICONS)), code.cast("int"))


def protect_rank(name: str) -> int:
    """Rank of a threshold given by name; WARN and above only."""
    found = ALIASES.get(name.strip().upper(), 0)
    if found < ALIASES["WARN"]:
        raise ValueError(f"not a threshold of WARN or above: {name!r}")
    return found
