"""Words, shingles and digests of a whole batch of texts at once, on UTF-8 bytes."""
from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
ORDER_CODE = mix(np.arange(1001, 1101, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(max(n, SLICE_BYTES), base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running hash: equal byte strings give equal ``span_hash`` wherever they stand."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODE[buf] * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def slices(texts: list[bytes], limit: int = SLICE_BYTES):
    """Cut a batch into runs of texts of about ``limit`` bytes: (first, after last)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each followed by a line feed, and where each begins (one more entry than texts)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes other than blank, tab, LF, VT, FF, CR."""
    edge = np.diff(np.concatenate([[True], SPACE[buf], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct ``width``-word shingles of each text, sorted within the text, and the
    offsets of the texts in them. A text of fewer words has its whole word sequence as one shingle, a
    text without words none. A-Z count as a-z."""
    buf, starts = joined(texts)
    buf = LOWER[buf]
    first, last = words(buf)
    h = span_hash(prefix_hash(buf), first, last)
    doc = np.searchsorted(starts, first, "right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    k = len(h) - width + 1
    keep_doc, keep = [], []
    if k > 0:
        code = np.zeros(k, np.uint64)
        for j in range(width):
            code += h[j:j + k] * ORDER_CODE[j]
        full = np.flatnonzero(doc[:k] == doc[width - 1:])
        keep_doc.append(doc[full])
        keep.append(mix(code[full]))
    for d in np.flatnonzero((n_words > 0) & (n_words < width)):
        own = h[begin[d]:begin[d] + n_words[d]]
        keep_doc.append(np.array([d]))
        keep.append(mix(np.array([(own * ORDER_CODE[:len(own)]).sum()]) + ORDER_CODE[50 + len(own)]))
    if not keep:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    doc, code = np.concatenate(keep_doc), np.concatenate(keep)
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    return code[fresh], np.concatenate([[0], np.cumsum(np.bincount(doc[fresh], minlength=len(texts)))])
