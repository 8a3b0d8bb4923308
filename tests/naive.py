"""The log operators once more, as plain loops over characters: what the tests hold whole queries against."""

from __future__ import annotations

import re

from condenspark.functions.normalize import CLASSES, DURATIONS, SIZES
from condenspark.functions.severity import ALIASES, LEADING
from condenspark.operators import multiline

WORD = set("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")
LETTERS = {c for c in WORD if c.isalpha()}
DIGITS = set("0123456789")
RUN = WORD | {"-"}
SPAN = re.compile("|".join(f"(?:{p})" for _, p, _ in CLASSES), re.A)


def level_of(raw: str) -> tuple[int, int]:
    """The level and the bytes up to the end of its marker."""
    b, i, words = raw.encode()[:200].decode("latin-1"), 0, 0
    while i < len(b) and words < 8:
        opened = b[i] == "[" and i + 1 < len(b) and b[i + 1] in LETTERS
        if b[i] not in LETTERS and not opened:
            i += 1
            continue
        begin = end = i + opened
        while end < len(b) and b[end] in LETTERS:
            end += 1
        words += 1
        if code := ALIASES.get(b[begin:end].upper()):
            if opened:
                end += b[end : end + 1] == "]"
            elif b[begin - 1 : begin] in ("/", ".") or (end < len(b) and b[end] not in ": \t"):
                i = end
                continue
            end += b[end : end + 1] == ":"
            return code, end + (b[end : end + 1] in (" ", "\t") and end < len(b))
        i = end
    return 0, 0


def content(raw: str) -> str:
    _, end = level_of(raw)
    return raw.encode()[end:].decode("utf-8", "replace") if end else re.sub(LEADING, "", raw, count=1, flags=re.A)


def template(text: str) -> str:
    out, at = [], 0
    for m in SPAN.finditer(text):
        out.append(_between(text, at, m.start()))
        out.append(next(mark for _, p, mark in CLASSES if re.fullmatch(p, m.group(), re.A)))
        at = m.end()
    return "".join([*out, _between(text, at, len(text))])


def _between(text: str, i: int, limit: int) -> str:
    out = []
    free = lambda k: k >= len(text) or text[k] not in WORD
    while i < limit:
        c, clear = text[i], i == 0 or text[i - 1] not in WORD
        end = i
        if c in LETTERS:
            while end < limit and text[end] in RUN:
                end += 1
            out.append("[ID]" if end - i >= 6 and clear and free(end) and DIGITS & set(text[i:end]) else text[i:end])
        elif c in DIGITS:
            while end < limit and text[end] in DIGITS:
                end += 1
            if end + 1 < limit and text[end] == "." and text[end + 1] in DIGITS:
                end += 1
                while end < limit and text[end] in DIGITS:
                    end += 1
            if not clear:
                out.append(text[i:end])
            else:
                mark, end = _number(text, i, end, limit, free)
                out.append(mark or text[i:end])
        else:
            out.append(c)
            end += 1
        i = end
    return "".join(out)


def _number(text, begin, end, limit, free):
    for unit in DURATIONS.split("|"):
        if text[end:limit].startswith(unit) and free(end + len(unit)):
            return "[DURATION]", end + len(unit)
    after = end + (text[end:limit][:1] == " ")
    for unit in SIZES.split("|"):
        if text[after:limit].startswith(unit) and free(after + len(unit)):
            return "[SIZE]", after + len(unit)
    last = end
    while last < limit and text[last] in RUN:
        last += 1
    if last > end:
        named = last - begin >= 6 and free(last) and LETTERS & set(text[end:last])
        return ("[ID]" if named else None), last
    return ("[NUM]" if free(end) else None), end


def events(lines: list[str]) -> list[list[int]]:
    """The places of each event's lines."""
    told = [content(x) for x in lines]
    kinds, opens = [], []
    for raw, own in zip(lines, told, strict=True):
        hit = lambda p, s: re.search(p, s, re.A) is not None
        python, go = hit(_re(multiline.PYTHON_LINE), own), hit(_re(multiline.GO_LINE), own)
        if not own.strip(" \t\r\n\f"):
            kinds.append("B")
        elif hit(multiline.INDENTED, own) or hit(_re(multiline.ANY_KIND), own):
            kinds.append("U")
        else:
            kinds.append("X" if python and go else "P" if python else "G" if go else "H")
        opens.append("g" if raw.startswith("panic:") else "p" if hit(_re(multiline.PYTHON_OPENS), own) else "-")
    out: list[list[int]] = []
    for i, start in enumerate(multiline.flags(kinds, opens)):
        if start:
            out.append([])
        out[-1].append(i)
    return out


def _re(java: str) -> str:
    return java.replace(r"\z", r"\Z")
