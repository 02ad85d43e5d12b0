"""Cutting texts at places that no token of a byte-level BPE vocabulary can cross.

The pre-tokenizer of such a vocabulary is the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.  A single space between two characters
that are not white space always opens a match and never belongs to the one before, so a text may be cut before it; a single
line feed between two such characters is a match of its own, so a text may be cut on both its sides.
"""

from __future__ import annotations

import re

#: White space next to white space or to an end of the text; without one, every space and line feed is a safe place.
_UNSAFE = re.compile(r"\s(?=\s|\Z)|\A\s")
_SAFE = re.compile(r"(?<=\S)[ \n](?=\S)")


def cut(text: str) -> tuple[list[str], list[str], int]:
    """The pieces that stand as they are, those that follow a space they have lost, and the number of line feeds left out.

    The order of pieces is lost; it is the one to use where only sums are wanted.
    """
    if "\n" not in text and not _UNSAFE.search(text):
        parts = text.split(" ")
        return parts[:1], parts[1:], 0
    first: list[str] = []
    later: list[str] = []
    lines = sections(text)
    for line in lines:
        first.append(line[0])
        later += line[1:]
    return first, later, len(lines) - 1


def sections(text: str) -> list[list[str]]:
    """``text`` by safe line feeds, each section by safe spaces."""
    if not _UNSAFE.search(text):
        return [line.split(" ") for line in text.split("\n")]
    out, at = [[]], 0
    for m in _SAFE.finditer(text):
        out[-1].append(text[at : m.start()])
        if m[0] == "\n":
            out.append([])
        at = m.end()
    out[-1].append(text[at:])
    return out
