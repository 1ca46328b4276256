"""Counts of a text's words, read in pieces so that a very long text is never a list of all its words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np

from .textops import ALNUM_WORDS_LOWER

PIECE = 1 << 20


def translation(table: tuple[np.ndarray, np.ndarray]) -> bytes:
    """For bytes.translate: word bytes folded, all others blanks."""
    inside, fold = table
    return np.where(inside[fold], fold, 32).astype(np.uint8).tobytes()


#: Words of ASCII letters and digits and of anything beyond ASCII; A-Z lower-cased.
WORDS = translation(ALNUM_WORDS_LOWER)


def words(text: str | None, table: bytes = WORDS) -> Iterator[list[bytes]]:
    """The words of a text, in order, some `PIECE` bytes at a time."""
    data = (text or "").encode().translate(table)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        if found := data[at:end].split():
            yield found
        at = end


def counted(text: str | None, runs: int = 1, table: bytes = WORDS) -> tuple[int, Counter]:
    """(number of words, how often each run of 1 to `runs` consecutive words occurs, joined by one blank)."""
    total, found = 0, Counter()
    tail: list[bytes] = []
    for part in words(text, table):
        total += len(part)
        found.update(part)
        for n in range(2, runs + 1):
            # Runs that end in this piece; the words before it that they may begin with are at hand.
            both = [*tail[max(0, len(tail) - n + 1) :], *part]
            found.update(map(b" ".join, zip(*(both[k:] for k in range(n)), strict=False)))
        if runs > 1:
            tail = [*tail, *part][-(runs - 1) :]
    return total, found
