"""SentencePiece encoding and decoding by suffix-array matching.

The new words of a batch are laid out one after the other; their suffixes are sorted by prefix doubling as deep as the longest
piece; every piece of the vocabulary is looked up by binary search, which gives the range of its occurrences; each occurrence
is an edge of the text's lattice. Edges are sorted by the position where they end and relaxed in that order: the last piece of
a prefix is the one edge that byte-pair merging would leave there, that is, whose pair with the last piece before it stays a
pair when merged alone. Ids equal those of the sentencepiece library for byte-pair models with byte fallback.

A word is a run of blanks and what follows up to the next blank or line feed; no piece reaches across such a border (checked
when the model is read). Words already seen by a worker come from a table of at most ``KNOWN_WORDS``. Memory follows the
longest run without blanks, not the text.

Null texts count as empty and have no ids. Decoding gives back the text, except that U+2581 becomes a blank, as in the
library. Ids, repeated rows and other columns play no part.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, UNKNOWN = "▁", -1
KNOWN_WORDS, WORDS_AT_ONCE, CHARS_AT_ONCE = 120_000, 400_000, 2_000_000  # a known word takes about 300 bytes
ENCODED = [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
           T.StructField("round_trip", T.BooleanType())]
WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at:at + size]
            at += size


class Vocabulary:
    """Pieces of a model file: plain pieces, byte pieces, and the tables for matching."""

    def __init__(self, data: bytes):
        entries = [dict(fields(v)) for n, v in fields(data) if n == 1]
        text = [e[1].decode() for e in entries]
        kind = [e.get(3, 1) for e in entries]
        score = [np.frombuffer(e.get(2, b"\0\0\0\0"), np.float32)[0] for e in entries]
        self.text = text
        self.score = {t: float(s) for t, s, k in zip(text, score, kind, strict=True) if k == 1}
        self.id = {t: i for i, (t, k) in enumerate(zip(text, kind, strict=True)) if k == 1}
        self.byte_id = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(text, kind, strict=True)) if k == 6}
        plain = sorted(self.id.values(), key=lambda i: i)
        if any(MARK in text[i].lstrip(MARK) or "\n" in text[i] for i in plain) or len(self.byte_id) != 256:
            raise ValueError("pieces across words, or no byte fallback: not a model for this matcher")
        chars = sorted({ord(c) for i in plain for c in text[i]})
        if any(chr(c) not in self.id for c in chars):
            raise ValueError("every character of a piece must be a piece")
        self.code = np.zeros(0x110000, np.uint16)
        self.code[chars] = np.arange(1, len(chars) + 1)
        self.ids = np.array(plain)
        self.size = np.array([len(text[i]) for i in plain])
        self.depth = 4 * -(-int(self.size.max()) // 4)
        low = np.zeros((len(plain), self.depth), np.uint64)
        high = np.full((len(plain), self.depth), 0xFFFF, np.uint64)
        for row, i in enumerate(plain):
            low[row, :len(text[i])] = high[row, :len(text[i])] = self.code[[ord(c) for c in text[i]]]
        self.low, self.high = self.keys(low), self.keys(high)
        self.piece_size = np.ones(len(text) + 1, np.int64)  # the last entry is UNKNOWN's
        self.piece_size[self.ids] = self.size
        raw = [b"" if k in (2, 3) else bytes([int(t[3:5], 16)]) if k == 6 else t.replace(MARK, " ").encode() for t, k in zip(text, kind, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.pairs, self.stays = np.zeros(0, np.int64), np.zeros(0, bool)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = [np.zeros(0, np.int32)]
        self.pool_flat, self.pool_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @staticmethod
    def keys(codes: np.ndarray) -> list[np.ndarray]:
        """Four codes to a key, most significant first."""
        groups = codes.reshape(len(codes), -1, 4)
        shifts = np.array([48, 32, 16, 0], np.uint64)
        return [(groups[:, g] << shifts).sum(-1, dtype=np.uint64) for g in range(groups.shape[1])]

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of one short string, best score first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves the two pieces as they are when they stand side by side."""
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.pairs, key)
        seen = at < len(self.pairs)
        seen[seen] = self.pairs[at[seen]] == key[seen]
        if not seen.all():
            fresh = np.unique(key[~seen])
            value = np.array([self.merged(self.text[k >> 20] + self.text[k & 0xFFFFF]) == [self.text[k >> 20], self.text[k & 0xFFFFF]] for k in fresh.tolist()])
            pairs, stays = np.concatenate([self.pairs, fresh]), np.concatenate([self.stays, value])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.stays = pairs[order], stays[order]
            at = np.searchsorted(self.pairs, key)
        return self.stays[at]

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece row of every occurrence of every piece in a text of character codes."""
        n = len(codes)
        padded = np.concatenate([codes, np.zeros(self.depth, np.uint16)]).astype(np.uint64)
        four = padded[:n + self.depth - 3] << np.uint64(48) | padded[1:n + self.depth - 2] << np.uint64(32) | padded[2:n + self.depth - 1] << np.uint64(16) | padded[3:]
        # suffix array by prefix doubling: ranks by 4 characters, then by 8, 16 ... up to the longest piece
        order = np.argsort(four[:n], kind="stable")
        rank, reach = np.zeros(n + self.depth, np.int64), 4
        sorted_keys = four[order]
        rank[order] = np.cumsum(np.concatenate([[1], sorted_keys[1:] != sorted_keys[:-1]]))
        while reach < self.depth:
            key = rank[:n] << 32 | rank[reach:n + reach]
            order = np.argsort(key, kind="stable")
            sorted_keys = key[order]
            rank[order] = np.cumsum(np.concatenate([[1], sorted_keys[1:] != sorted_keys[:-1]]))
            reach *= 2
        suffix = [four[order + g] for g in range(0, self.depth, 4)]

        def first_not_below(piece_keys: list[np.ndarray], after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n)
            while (lo < hi).any():
                mid = (lo + hi) // 2
                at = np.minimum(mid, n - 1)
                below, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
                for own, piece in zip(suffix, piece_keys, strict=True):
                    v = own[at]
                    below |= equal & (v < piece)
                    equal &= v == piece
                below = (below | equal if after else below) & (lo < hi)
                lo, hi = np.where(below, mid + 1, lo), np.where(below | (lo >= hi), hi, mid)
            return lo

        begin, end = first_not_below(self.low, False), first_not_below(self.high, True)
        count = end - begin
        row = np.repeat(np.arange(len(count)), count)
        return order[np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begin[row]], row

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other and where each word's begin."""
        chars = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "replace"), np.uint32)
        codes = self.code[chars]
        sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        codes[begin + sizes] = 0
        start, row = self.occurrences(codes)
        word_at = np.repeat(begin, sizes + 1)
        lone = np.flatnonzero(codes == 0)
        lone = lone[np.isin(lone, begin + sizes, invert=True)]
        piece = np.concatenate([self.ids[row], np.full(len(lone), UNKNOWN)])
        end = np.concatenate([start + self.size[row], lone + 1])
        start = np.concatenate([start, lone])
        depth = end - word_at[start]
        by_end = np.argsort(depth, kind="stable")
        start, end, piece = start[by_end], end[by_end], piece[by_end]
        steps = np.concatenate([[0], np.cumsum(np.bincount(depth))])
        last = np.full(len(chars) + 1, -2, np.int64)  # last piece of the prefix that ends before a position
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            if a == b:
                continue
            s, e, p = start[a:b], end[a:b], piece[a:b]
            before = np.where(s == word_at[s], UNKNOWN, last[s])
            free = (before == UNKNOWN) | (p == UNKNOWN)
            ask = np.flatnonzero(~free & (before >= 0))
            free[ask] = self.stay(before[ask], p[ask])
            last[e[free]] = p[free]
        at, found = begin + sizes, []
        live = np.flatnonzero(at > begin)
        while len(live):
            p = last[at[live]]
            found.append((live, p, at[live] - 1))
            at[live] -= self.piece_size[p]
            live = live[at[live] > begin[live]]
        if not found:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        word, ids, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, word))
        word, ids, place = word[order], ids[order], place[order]
        if (ids == UNKNOWN).any():
            out_word, out = [], []
            for w, i, c in zip(word.tolist(), ids.tolist(), chars[place].tolist(), strict=True):
                new = [self.byte_id[b] for b in chr(c).encode("utf-8", "replace")] if i == UNKNOWN else [i]
                out += new
                out_word += [w] * len(new)
            word, ids = np.array(out_word), np.array(out)
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])

    def learn(self, words: list[str]) -> None:
        for i in range(0, len(words), WORDS_AT_ONCE):
            part = words[i:i + WORDS_AT_ONCE]
            ids, at = self.encode_words(part)
            first = len(self.pool_at) - 1
            self.known.update(zip(part, range(first, first + len(part)), strict=True))
            self.pool_at = np.concatenate([self.pool_at, self.pool_at[-1] + at[1:]])
            self.pool_flat = np.concatenate([self.pool_flat, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other and where each text's begin."""
        units = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        fresh = {w for u in units for w in u if w not in self.known}
        if fresh:
            self.learn(sorted(fresh))
        known = self.known
        index = np.fromiter((known[w] for u in units for w in u), np.int64)
        size = self.pool_at[index + 1] - self.pool_at[index]
        flat = self.pool_flat[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.pool_at[index], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        return flat, total[np.concatenate([[0], np.cumsum([len(u) for u in units])]).astype(np.int64)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts from ids one after the other; the blank put before each text goes."""
        size = self.raw_at[ids + 1] - self.raw_at[ids]
        raw = self.raw[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.raw_at[ids], size)].tobytes()
        cut = np.concatenate([[0], np.cumsum(size)])[at]
        return [raw[a + 1:b].decode("utf-8", "replace") if raw[a:a + 1] == b" " else raw[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]


@lru_cache(maxsize=1)
def vocabulary(data: bytes) -> Vocabulary:
    """One vocabulary per worker process."""
    return Vocabulary(data)


def model_bytes(path: str = MODEL) -> bytes:
    """The model file, read by the driver; it travels with the tasks and is bounded by the vocabulary."""
    with open(path, "rb") as f:
        return f.read()


def small_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch, of about ``CHARS_AT_ONCE`` characters."""
    first, size = 0, 0
    for i, n in enumerate(len(t or "") for t in batch.column("text").to_pylist()):
        if size and size + n > CHARS_AT_ONCE:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n
    yield batch.slice(first)


def encode_documents(docs: DataFrame, path: str = MODEL, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids, whether decoding the ids gives the text back, and the columns of ``carry``."""
    schema = T.StructType(ENCODED + [T.StructField(c, docs.schema[c].dataType) for c in carry])
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model.value)
        for b in (part for batch in batches for part in small_parts(batch)):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids, at = vocab.encode(texts)
            back = vocab.decode(ids, at)
            same = [x == y.replace(MARK, " ") for x, y in zip(back, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(same, pa.bool_()), *[b.column(f"kept_{c}") for c in carry]],
                names=["doc_id", "n_tokens", "ids", "round_trip", *carry])
    return docs.select(F.col("doc_id").cast("long"), "text", *[F.col(c).alias(f"kept_{c}") for c in carry]).mapInArrow(run, schema)


def decode_documents(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and the text of its ``ids``; null ids count as none."""
    model = tokens.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model.value)
        for b in batches:
            lists = [np.array(x or [], np.int64) for x in b.column("ids").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            back = vocab.decode(np.concatenate([np.zeros(0, np.int64), *lists]), at)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(back, pa.string())], names=["doc_id", "text"])
    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
