"""Tokens with their places, in the two dialects of the context detectors, and lines with theirs."""

from __future__ import annotations

import re
from functools import partial

import pyarrow as pa
from pyspark.sql import Column

from redactory.functions.arrays import batched, lists, strings

# Quoted stretches (spaces allowed) whose opening quote isn't escaped, else runs without space or quote.
PLAIN = r"""(?<!\\)"[^"]*"|(?<!\\)'[^']*'|[^\s"']+"""
# Quoted stretches without spaces, else runs of word characters, dots, slashes, at signs and hyphens.
PROXIMITY = r"""(?<!\\)"[^"\s]*"|(?<!\\)'[^'\s]*'|(?<!\\)`[^`\s]*`|[A-Za-z0-9_./@-]+"""
_PLAIN, _PROXIMITY = map(re.compile, (PLAIN, PROXIMITY))

Token = tuple[str, int, int]


def _tokens(pattern: re.Pattern, text: str) -> list[Token]:
    return [(m[0], m.start(), m.end()) for m in pattern.finditer(text)]


def plain_tokens(text: str) -> list[Token]:
    return _tokens(_PLAIN, text)


def proximity_tokens(text: str) -> list[Token]:
    return _tokens(_PROXIMITY, text)


def placed(text: Column, pattern: str) -> Column:
    """array<struct<text, start, end>> of the matches of a pattern, in code points. A text is passed over once."""
    return batched(partial(_placed, pattern), "array<struct<text:string,start:int,end:int>>", text)


def _placed(pattern: str, texts: pa.Array) -> pa.Array:
    find = re.compile(pattern)
    return lists([_tokens(find, t) for t in strings(texts)], ("text", "start", "end"), (pa.string(), pa.int32(), pa.int32()))


def lines(text: Column) -> Column:
    """array<struct<text, start>> of the lines with something on them; a line ends before its line feed and carriage return."""
    return batched(_lines, "array<struct<text:string,start:int>>", text)


def _lines(texts: pa.Array) -> pa.Array:
    return lists([line_pieces(t) for t in strings(texts)], ("text", "start"), (pa.string(), pa.int32()))


def line_pieces(text: str) -> list[tuple[str, int]]:
    """(line, start) of the lines with something on them."""
    out, at = [], 0
    rows = text.split("\n")
    for i, line in enumerate(rows):
        own = line.removesuffix("\r") if i < len(rows) - 1 else line
        if own.strip(BLANK):
            out.append((own, at))
        at += len(line) + 1
    return out


# Characters that leave a line blank.
BLANK = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
