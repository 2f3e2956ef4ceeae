"""Bytes as text, and places in a text as lines."""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import Column
from pyspark.sql import functions as F

_NEWLINE = re.compile("\n")
_SOLID = re.compile(r"\S+")


def text_of(content: Column) -> Column:
    """Any bytes as text: what isn't UTF-8 becomes U+FFFD, so that an image or a text in another
    encoding is analysed like any file and stops nothing."""
    return F.make_valid_utf8(content.cast("string"))


class Lines:
    """Line numbers by offset and lines by number of one text; its line ends are found once."""

    def __init__(self, text: str):
        self.text = text
        self.ends = [m.start() for m in _NEWLINE.finditer(text)]

    def at(self, offset: int) -> int:
        """The number, from 1, of the line that holds ``offset``."""
        return 1 + bisect_left(self.ends, offset)

    def line(self, number: int, most: int) -> str:
        """Up to ``most`` characters of a line."""
        if not 0 < number <= len(self.ends) + 1:
            return ""
        start = self.ends[number - 2] + 1 if number > 1 else 0
        stop = self.ends[number - 1] if number <= len(self.ends) else len(self.text)
        return self.text[start : min(stop, start + most)]


def flat(text: str, start: int, end: int, most: int) -> str:
    """``text[start:end]`` with each run of white space as one space, trimmed; of a longer result, ``most``
    characters and maybe some more."""
    words, size = [], 0
    for m in _SOLID.finditer(text, start, end):
        word = m[0][: most + 1]
        words.append(word)
        size += len(word) + 1
        if size > most + 1:
            break
    return " ".join(words)
