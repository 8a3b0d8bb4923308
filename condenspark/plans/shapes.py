"""Log lines made of table columns, in SQL that Spark and DuckDB both read: every class of variable part and every alias of a level."""

from __future__ import annotations

from condenspark.functions.severity import ALIASES

_H = "md5(cast(event_id as string))"
_N = lambda by, width, plus=0: f"lpad(cast(event_id % {by} + {plus} as string), {width}, '0')"
_CLOCK = f"{_N(24, 2)} || ':' || {_N(60, 2)} || ':' || {_N(59, 2)}"
_DAY = f"'2026-' || {_N(12, 2, 1)} || '-' || {_N(28, 2, 1)}"
_IP = "'10.' || cast(event_id % 256 as string) || '.7.' || cast(event_id % 100 as string)"
#: A part for each class of normalize.CLASSES, and others that only look alike.
PARTS = (
    f"{_DAY} || 'T' || {_CLOCK} || '.25Z'",
    f"'[' || {_N(28, 2, 1)} || '/Oct/2026:' || {_CLOCK} || ' +0000]'",
    _DAY,
    f"cast(event_id % 9 + 1 as string) || '/' || {_N(28, 2, 1)} || '/2026'",
    f"'at ' || {_CLOCK}",
    f"substr({_H}, 1, 8) || '-' || substr({_H}, 9, 4) || '-' || substr({_H}, 13, 4) || '-' || substr({_H}, 17, 4) || '-' || substr({_H}, 21, 12)",
    " || ':' || ".join(f"'a' || substr({_H}, {k}, 1)" for k in range(1, 7)),
    f"'fe80:' || substr({_H}, 1, 4) || ':' || substr({_H}, 5, 4) || ':1'",
    f"{_IP} || ':' || cast(1000 + event_id % 9000 as string)",
    _IP,
    f"'0x' || substr({_H}, 1, 8)",
    "cast(event_id % 100 as string) || '.5%'",
    f"'ab' || substr({_H}, 1, 20)",
    "'v1.' || cast(event_id % 10 as string) || ' x_' || cast(event_id as string)",
)
SHAPED = " || ' ' || ".join(f"({x})" for x in PARTS)

#: The alias of a row, the text before the message, and the message, in five shapes; the last has an alias that doesn't count.
_NAMES = sorted(ALIASES)
_ALIAS = "case event_id % " + str(len(_NAMES)) + "".join(f" when {i} then '{a}'" for i, a in enumerate(_NAMES)) + " end"
_SHAPE = f"cast(floor(event_id / {len(_NAMES)}) as int) % 5"
PREFIX = (
    f"case {_SHAPE} when 0 then {_DAY} || ' ' || {_CLOCK} || ' [' || {_ALIAS} || '] ' when 1 then lower({_ALIAS}) || ': ' when 2 then 'level=' || lower({_ALIAS}) || ' '"
    f" when 3 then {_DAY} || ' ' || {_CLOCK} || ' host ' || {_ALIAS} || ' ' else '' end"
)
MESSAGE = f"case {_SHAPE} when 4 then '/var/' || lower({_ALIAS}) || ' rotated ' else 'user ' end || cast(event_id as string)"
_CASES = "".join(f" when '{a}' then {code}" for a, code in ALIASES.items())
#: For DuckDB: the code of a line's level, found in the line itself.
PARSED = f"case when raw like '/%' then 0 else case upper(regexp_extract(raw, '(?i)(?:^|[^a-z/.])({'|'.join(sorted(_NAMES, key=len, reverse=True))})(?:[^a-z]|$)', 1)){_CASES} else 0 end end"
