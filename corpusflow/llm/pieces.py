"""Pre-tokens of the byte-level vocabularies, looked up by blank-separated chunk."""

from __future__ import annotations

import re

import public_tokenizers
import regex

_PATTERN = regex.compile(public_tokenizers.PATTERN)
#: A blank between two white-space characters; re's \s has all of regex's and a few more.
_INSIDE_RUN = re.compile(r" \s(?<=\s \s)")


def pretokens(text: str) -> list[str]:
    """Every match of the public pattern, in order."""
    return _PATTERN.findall(text)


def chunks(text: str) -> list[str] | None:
    """The text cut before each single blank, or None where a blank has white space on both sides or is at an edge.

    A blank with another character on its left begins a run of white space; one with another
    character on its right is the last of its run, which the pattern leaves to what follows.
    Either way it is the first character of a match, so no match crosses these cuts and each
    chunk can be matched, and remembered, alone. Inside a run of white space it is not.
    """
    if "  " in text or text[:1] == " " or text[-1:] == " " or _INSIDE_RUN.search(text):
        return None
    first, *rest = text.split(" ")
    return [first, *map(" ".__add__, rest)]
