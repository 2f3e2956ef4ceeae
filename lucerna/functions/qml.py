"""A lexer for QML, as far as finding ``Process { command: ... }`` needs it.

One pass cuts the text into comments, strings, names and single characters; what follows works on
those tokens, so look-alikes in comments and strings are never seen."""

from __future__ import annotations

import re
from dataclasses import dataclass

from lucerna.schemas import DYNAMIC

# A line comment ends at a line end or a semicolon, a fixed rule of the analysis.
_TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n;]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<string>\"(?:\\.|[^\"\\])*(?:\"|\\?\Z)|'(?:\\.|[^'\\])*(?:'|\\?\Z))"
    r"|(?P<name>[^\W\d]\w*)"
    r"|(?P<other>.)",
    re.S,
)
_ITEM = re.compile(r"\s*(?:(?P<comma>,)|(?P<quoted>\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?)|(?P<bare>[^,\s][^,]*))", re.S)
_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\"}
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-7]{3})|(.))", re.S)


@dataclass(frozen=True)
class Command:
    """One ``command:`` expression: its place, its text and what it is made of."""

    start: int
    end: int
    text: str
    words: list[str]
    dynamic: bool


def tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) of names, strings and other characters."""
    return [(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup != "space"]


def _partners(found: list) -> dict[int, int]:
    """The closing bracket of each opening one that has any, kinds apart, found in one pass."""
    out: dict[int, int] = {}
    waiting: dict[str, list[int]] = {"}": [], "]": []}
    for i, (kind, value, _, _) in enumerate(found):
        if kind == "other":
            if value in "{[":
                waiting["}" if value == "{" else "]"].append(i)
            elif value in "}]" and waiting[value]:
                out[waiting[value].pop()] = i
    return out


def unquote(raw: str) -> str | None:
    """The value of a quoted literal; None where it is malformed.

    Double quotes follow C-like escapes and may not hold a line end. Single quotes around one
    character or escape give that; around anything else, the text between them as it is."""
    quote, inner = raw[0], raw[1:-1] if len(raw) > 1 and raw[-1] == raw[0] else None
    if inner is None:
        return raw[1:-1] if quote == "'" and len(raw) >= 2 else None
    bad = False

    def one(m: re.Match) -> str:
        nonlocal bad
        for group, base in ((m[1], 16), (m[2], 16), (m[3], 16), (m[4], 8)):
            if group:
                value = int(group, base)
                bad |= value > 0x10FFFF or 0xD800 <= value <= 0xDFFF or base == 8 and value > 255
                return "" if bad else chr(value)
        bad |= m[5] not in _ESCAPES and m[5] != quote
        return _ESCAPES.get(m[5], m[5])

    value = _ESCAPE.sub(one, inner)
    bad |= "\n" in inner
    if quote == "'":
        return inner if bad or len(value) != 1 else value
    return None if bad else value


def array(expression: str) -> tuple[list[str], bool]:
    """(elements, whether any is dynamic) of a bracketed array; a text of another form is dynamic."""
    body = expression.strip()
    if not (body.startswith("[") and body.endswith("]")):
        return [], True
    words, dynamic = [], False
    for m in _ITEM.finditer(body[1:-1]):
        if m["comma"]:
            continue
        value = unquote(m["quoted"]) if m["quoted"] else None
        dynamic |= value is None
        words.append(DYNAMIC if value is None else value)
    return words, dynamic


def commands(text: str) -> list[Command]:
    """The ``command:`` expressions of all ``Process`` blocks; a block within a block is not sought again."""
    found, out, i = tokens(text), [], 0
    partner = _partners(found)
    while i < len(found):
        if found[i][:2] == ("name", "Process") and i + 1 < len(found) and found[i + 1][1] == "{" and (end := partner.get(i + 1)) is not None:
            out += _expressions(text, found, i + 2, end, partner)
            i = end
        i += 1
    return out


def _expressions(text: str, found: list, i: int, last: int, partner: dict[int, int]) -> list[Command]:
    out, stop = [], found[last][2]
    while i < last:
        if found[i][:2] == ("name", "command") and i + 2 < last and found[i + 1][1] == ":":
            start = found[i + 2][2]
            close = partner.get(i + 2, last) if found[i + 2][1] == "[" else last
            if close < last:
                end = found[close][3]
            else:
                ends = [k for k in (text.find(c, start, stop) for c in "\n;") if k >= 0]
                end = min(ends, default=stop)
            words, dynamic = array(text[start:end])
            out.append(Command(start, end, text[start:end], words, dynamic))
            while i < last and found[i][2] < end:
                i += 1
        else:
            i += 1
    return out


def assigns_command(text: str) -> bool:
    """Whether the text assigns to ``something.command``; a comparison does not."""
    found = tokens(text)
    for i in range(len(found) - 3):
        if found[i][0] == "name" and found[i + 1][1] == "." and found[i + 2][:2] == ("name", "command") and found[i + 3][1] == "=":
            if not (i + 4 < len(found) and found[i + 4][1] == "=" and found[i + 4][2] == found[i + 3][3]):
                return True
    return False
