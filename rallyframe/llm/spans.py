"""Batches of texts as runs of bytes of bounded size: whole short texts together, long ones cut between words."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from rallyframe.llm.text import SLICE_BYTES

Run = tuple[list[int], list[bytes], bool]


def cut(text: bytes, between: np.ndarray, limit: int) -> Iterator[bytes]:
    """Pieces of about ``limit`` bytes that end after a byte of ``between``; a longer word stays whole."""
    at, buf = 0, np.frombuffer(text, np.uint8)
    while at < len(text):
        end = min(at + limit, len(text))
        step = 4096
        while end < len(text) and not between[buf[end - 1]]:
            found = np.flatnonzero(between[buf[end:end + step]])
            end += int(found[0]) + 1 if len(found) else min(step, len(text) - end)
            step *= 2
        yield text[at:end]
        at = end


def runs(texts: list[bytes], between: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[Run]:
    """(numbers of the texts, their bytes, whether these are whole texts), in order."""
    own, parts, size = [], [], 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield own, parts, True
            own, parts, size = [], [], 0
        if len(t) > limit:
            for piece in cut(t, between, limit):
                yield [i], [piece], False
        else:
            own.append(i)
            parts.append(t)
            size += len(t) + 1
    if own:
        yield own, parts, True
