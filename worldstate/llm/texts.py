"""Small helpers for whole texts inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

CHUNK_CHARS = 1 << 16
# a break that no tokeniser pattern crosses: a blank or line feed right after a character that is not white space
_BREAK = re.compile(r"(?<=\S)[ \n]")


def chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut before white space only.

    Words are never cut, so pattern matches of the parts are those of the whole text. A run
    without white space stays whole, whatever its length.
    """
    start = 0
    while len(text) - start > size:
        found = _BREAK.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


_BLANK_RUN = re.compile(r"\s ")
_WORD_BREAK = re.compile(r"(?<=\S) ")


def blank_parts(text: str) -> list[str]:
    """Cuts a text at every blank that follows a character other than white space; those blanks go.

    All parts but the first thus began with a blank.
    """
    return _WORD_BREAK.split(text) if _BLANK_RUN.search(text) else text.split(" ")
