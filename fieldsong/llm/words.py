"""Words and word n-grams of long byte strings, a run at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of text that are cut into words at once.
RUN_BYTES = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_runs(data: bytes) -> Iterator[list[bytes]]:
    """The words of data (runs of bytes that are not ASCII white space), in lists; no word is cut."""
    start = 0
    while start < len(data):
        end = start + RUN_BYTES
        if end < len(data):
            mark = SPACE.search(data, end)
            end = mark.start() if mark else len(data)
        if words := data[start:end].split():
            yield words
        start = end


def ngram_runs(data: bytes, n: int) -> Iterator[list[bytes]]:
    """All n-word shingles, joined by spaces, in lists; fewer than n words are one shingle, none give none."""
    tail: list[bytes] = []
    full = False
    for words in word_runs(data):
        words = tail + words
        tail = words[max(0, len(words) - n + 1) :] if n > 1 else []
        if len(words) >= n:
            full = True
            yield [b" ".join(x) for x in zip(*(words[k:] for k in range(n)))]
        else:
            tail = words
    if not full and tail:
        yield [b" ".join(tail)]
