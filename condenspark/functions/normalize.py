"""Structural templates of log messages: variable parts become class names. All expressions are native: passes of regular expressions,
without a lambda, so they stay in generated code and a row needs no shuffle.

Whole-line classes are found first, by one alternation; identifiers and numbers are found in what is left between them, but their edges
are judged by the neighbouring characters of the line. Private-use characters mark what was found: the place of a match among
separators tells its class. They are removed from input beforehand.
"""

from __future__ import annotations

import re
from itertools import takewhile

from pyspark.sql import Column
from pyspark.sql import functions as F

W = "[0-9A-Za-z_]"
EDGE = f"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"  # an ASCII word edge
#: The classes in order of priority, with what replaces them.
CLASSES = (
    ("iso8601", r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?\b", "[TIMESTAMP]"),
    ("apachetime", r"\[\d{1,2}/(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}\]", "[TIMESTAMP]"),
    ("date", r"\b\d{4}-\d{2}-\d{2}\b", "[DATE]"),
    ("dateslash", r"\b\d{1,4}/\d{1,2}/\d{1,4}\b", "[DATE]"),
    ("clock", r"\b\d{1,2}:\d{2}:\d{2}(?:\.\d{1,9})?\b", "[TIME]"),
    ("uuid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "[UUID]"),
    ("mac", r"\b(?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}\b", "[MAC]"),
    ("ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{0,4}(?::\d{1,5})?\b", "[IPV6]"),
    ("ipv4port", r"\b(?:\d{1,3}\.){3}\d{1,3}:\d{1,5}\b", "[IP]:[PORT]"),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]"),
    ("memaddr", r"\b0x[0-9a-fA-F]{4,}\b", "[ADDR]"),
    ("percent", r"\d+(?:\.\d+)?%", "[PCT]%"),
    ("hexhash", r"\b[0-9a-fA-F]{12,64}\b", "[HASH]"),
)
#: Units of durations and sizes, and the least length of an identifier.
DURATIONS = "seconds|minutes|hours|secs|mins|hrs|sec|min|hr|ms|us|ns|s|m|h"
SIZES = "KiB|MiB|GiB|TiB|KB|MB|GB|TB|B"
MIN_ID = 6
#: A span of a class is ON, separators, the text, separators, OFF; a token is HERE, the same, OFF.
ON, OFF, SEP, HERE = "\ue000", "\ue001", "\ue002", "\ue003"


def java(pattern: str) -> str:
    """With ASCII word edges, whatever the Java version."""
    return pattern.replace(r"\b", EDGE)


def replace_class(text: Column, name: str) -> Column:
    """One class alone."""
    pattern, mark = next((p, r) for n, p, r in CLASSES if n == name)
    return F.regexp_replace(text, java(pattern), re.sub(r"([\\$])", r"\\\1", mark))


_OPEN = f"(?<!{W})(?:(?<!{OFF})|(?<!{W}{SEP}{{0,{len(CLASSES)}}}{OFF}))"  # no word character before
_CLOSED = f"(?!{W}|{ON}{SEP}*+{W})"  # nor behind
_NUMBER, _RUN = r"[0-9]++(?:\.[0-9]++)?+", "[0-9A-Za-z_-]"
_LONG = f"{_RUN}{{{MIN_ID - 1},}}+"
#: Numbers with a point and letters that are too short for an identifier.
_SHORT = rf"(?!(?:[0-9]\.[0-9][A-Za-z_-]{_RUN}?|[0-9]{{2}}\.[0-9][A-Za-z_-]|[0-9]\.[0-9]{{2}}[A-Za-z_-])(?!{_RUN}))"
#: What a token becomes, and the tokens: names and then numbers, the latter with a unit, with letters, or alone.
FOUND = (
    ("[ID]", f"((?=[A-Za-z_-]++[0-9])[A-Za-z]{_LONG}){_CLOSED}"),
    ("[DURATION]", f"({_NUMBER}(?:{DURATIONS}))(?!{W})"),
    ("[SIZE]", f"({_NUMBER}(?:(?:{SIZES})(?!{W})| (?:{SIZES}){_CLOSED}))"),
    ("[ID]", rf"((?={_NUMBER}[0-9_-]*+[A-Za-z])(?:{_SHORT}[0-9]++\.[0-9]++{_RUN}++|(?=[0-9]++[A-Za-z_-])[0-9]{_LONG})){_CLOSED}"),
    ("[NUM]", f"({_NUMBER})(?!{_RUN}){_CLOSED}"),
)
#: The tokens between spans, from left to right. The first and the last two groups stay: spans, marks and plain words, some at a time;
#: names and numbers that are none of FOUND; and those that go on from a word character.
TOKENS = "|".join(
    (
        f"((?:{ON}[^{OFF}]*+{OFF}|[^0-9A-Za-z{ON}]++|[A-Za-z]++(?!{_RUN})){{1,16}}+)",
        f"{_OPEN}(?:{'|'.join(p for _, p in FOUND)}|([A-Za-z]{_RUN}*+|{_NUMBER}{_RUN}*+))",
        f"([A-Za-z]{_RUN}*+|{_NUMBER})",
    )
)
_STAY = f"$1${len(FOUND) + 2}${len(FOUND) + 3}"


def _spans() -> str:
    """The alternation of all classes, a group each, in order. A class that begins at a word edge begins with a word character."""
    edged = [java(p.removeprefix(r"\b")) if p.startswith(r"\b") else None for _, p, _ in CLASSES]
    parts, k = [], 0
    while k < len(CLASSES):
        run = [p for p in edged[k:] if p is not None][: next((i for i, p in enumerate(edged[k:]) if p is None), len(edged))]
        parts.append(f"(?<!{W})(?:{'|'.join(f'({p})' for p in run)})" if run else f"({java(CLASSES[k][1])})")
        k += max(1, len(run))
    return r"(?=[0-9A-Fa-f\[])(?:" + "|".join(parts) + ")"


def has_any(text: Column) -> Column:
    """Has the text a part of any class? One pass."""
    return text.rlike(_spans())


def has_class(text: Column, name: str) -> Column:
    """Has the text a part of one class? One that begins at a word edge begins with a hexadecimal digit, which is soon looked for."""
    pattern = next(p for n, p, _ in CLASSES if n == name)
    return text.rlike(f"(?=[0-9A-Fa-f])(?<!{W})" + java(pattern.removeprefix(r"\b")) if pattern.startswith(r"\b") else java(pattern))


def _named(text: Column, begin: str, marks: list[str]) -> Column:
    """text with each mark in place of what was found for it. The expression names text once: it isn't to be worked out again."""
    k = 0
    while k < len(marks):
        n = len(list(takewhile(lambda m: m == marks[k], marks[k:])))  # neighbours with one mark
        text = F.regexp_replace(text, f"{begin}{SEP}{{{k},{k + n - 1}}}+[^{SEP}{OFF}]++{SEP}{{{len(marks) - k - n},}}+{OFF}", marks[k])
        k += n
    return text


def template(message: Column) -> Column:
    """The template of a message of one or more lines. One without a digit and without a class is its own: every token has a digit."""
    clean = F.translate(message, ON + OFF + SEP + HERE, "")
    spans = F.regexp_replace(clean, _spans(), ON + SEP.join(f"${k + 1}" for k in range(len(CLASSES))) + OFF)
    found = F.regexp_replace(spans, TOKENS, f"{_STAY}{HERE}{SEP.join(f'${k}' for k in range(2, len(FOUND) + 2))}{OFF}")
    found = F.replace(found, F.lit(HERE + SEP * (len(FOUND) - 1) + OFF), F.lit(""))
    named = _named(_named(found, HERE, [m for m, _ in FOUND]), ON, [m for _, _, m in CLASSES])
    return F.when(clean.rlike("[0-9]|" + _spans()), named).otherwise(clean)
