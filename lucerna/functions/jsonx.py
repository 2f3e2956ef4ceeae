"""Strict JSON: decoding that refuses what other readers would pass over, and one canonical form."""

from __future__ import annotations

import json

from lucerna.schemas import LIMITS


class ReportError(ValueError):
    pass


#: Characters that are escaped on output so that a report is safe inside markup and scripts.
_ESCAPED = {ord(c): f"\\u{ord(c):04x}" for c in "<>&\u2028\u2029"}


def encode(document: dict, limit: int = LIMITS.report_bytes) -> str:
    """One line of JSON, members as they stand, ended by a line feed."""
    text = json.dumps(document, ensure_ascii=False, separators=(",", ":"), allow_nan=False).translate(_ESCAPED) + "\n"
    try:
        size = len(text.encode("utf-8"))
    except UnicodeEncodeError as e:
        raise ReportError("text is not valid Unicode") from e
    if size > limit:
        raise ReportError(f"the report is {size} bytes long; the limit is {limit}")
    return text


def encoded_size(text: str) -> int:
    """Bytes of one string in its canonical form, quotes included."""
    return len(json.dumps(text, ensure_ascii=False).translate(_ESCAPED).encode("utf-8", "surrogatepass"))


def _depth(text: str) -> int:
    depth = deepest = 0
    inside = escaped = False
    for c in text:
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
            deepest = max(deepest, depth)
        elif c in "}]":
            depth -= 1
    return deepest


def _once(pairs: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for key, value in pairs:
        if key in out:
            raise ReportError(f"duplicate member {key!r}")
        out[key] = value
    return out


def _constant(name: str) -> None:
    raise ReportError(f"{name} is not JSON")


def _lone_surrogate(value: object) -> bool:
    if isinstance(value, str):
        return any(0xD800 <= ord(c) <= 0xDFFF for c in value)
    if isinstance(value, dict):
        return any(_lone_surrogate(k) or _lone_surrogate(v) for k, v in value.items())
    return isinstance(value, list) and any(map(_lone_surrogate, value))


def _shape(value: object, members: object, at: str) -> None:
    """``members``: a dict of allowed members (exact case), a one-element list for arrays, None for
    anything, or ``...`` as the only key for maps of data."""
    if isinstance(members, list) and isinstance(value, list):
        for i, v in enumerate(value):
            _shape(v, members[0], f"{at}[{i}]")
    elif isinstance(members, dict) and isinstance(value, dict):
        for k, v in value.items():
            if ... in members:
                _shape(v, members[...], f"{at}.{k}")
            elif k not in members:
                raise ReportError(f"unknown member {at}.{k}")
            else:
                _shape(v, members[k], f"{at}.{k}")


def decode(data: bytes, members: dict | None = None, limit: int = LIMITS.report_bytes, nesting: int = LIMITS.nesting) -> dict:
    """The one JSON object in ``data``. Refused: other encodings than UTF-8, lone surrogates, duplicate
    or unknown members, deep nesting, trailing values, and documents over the limit."""
    if len(data) > limit:
        raise ReportError("the document is too long")
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ReportError("the document is not valid UTF-8") from e
    if _depth(text) > nesting:
        raise ReportError("nested too deeply")
    try:
        value = json.loads(text, object_pairs_hook=_once, parse_constant=_constant)
    except ReportError:
        raise
    except ValueError as e:
        raise ReportError(f"not one JSON value: {e}") from e
    if not isinstance(value, dict):
        raise ReportError("the document is not an object")
    if _lone_surrogate(value):
        raise ReportError("a surrogate stands alone")
    _shape(value, members, "report")
    return value
