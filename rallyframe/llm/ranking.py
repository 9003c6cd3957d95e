"""Ranked lexical search by K2-treaps over the grid of terms and documents.

A term is a run of A-Z, a-z, 0-9 and code points from 128 on, A-Z as a-z; null texts have none. Documents are read in blocks of at most
``BLOCK_DOCS`` rows or ``BLOCK_CELLS`` (term, document) cells, in order of doc_id. A block's cells, their impact as value, form a K2-treap: the
grid is a square of side 2**depth, a node keeps a four-bit map of its quadrants that hold cells and, as the difference to its parent's, the largest
impact below it; nodes of a level lie in one array, so a child's place is the rank of its bit. The shorter side of the grid is stretched to the
square's, so that rows (or columns) are alone in their nodes as early as may be.

An item is a set of rows. Its search holds document ranges in a heap; a range carries one node for each row, the one on that row's path, and the sum of their
maxima bounds the score of every document in it. The best ranges are split, all rows descending together, until no range can beat the item's ``TOP`` best; at
single documents the bound is the score. Bounds equal to the worst kept score go on only where smaller doc_ids are, so results are exact with all ties. A
task keeps its best from block to block, and hands ``TOP`` rows an item to the final ranking.

Only cells of the items' terms are needed. Items are taken in slices of about ``SLICE_TERMS`` distinct terms, by hash, so what is broadcast (hashes, weights and the
slice's items) is bounded whatever their number; each slice is one pass over the documents. A term is known by a 64-bit hash.

Null ids of documents come last among ties. Of repeated rows each counts and ranks by itself, next to each other. Repeated items (equal id and text) are
answered once, equal ids with different texts each. Items without a term, and empty tables, give no rows. Texts longer than ``text.SLICE_BYTES`` are read in pieces
cut between terms. Other columns are not read.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.llm.spans import runs
from rallyframe.llm.stored import store
from rallyframe.llm.text import LOWER, joined, prefix_hash, span_hash

TOP = 50
BLOCK_DOCS, BLOCK_CELLS = 8192, 1_000_000
SLICE_TERMS = 1 << 18
SPLIT_AT_ONCE = 32
IN_TERM = np.zeros(256, bool)
for _first, _end in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IN_TERM[_first:_end] = True
POPULATION = np.array([bin(i).count("1") for i in range(16)], np.int64)


# --- the grid of a block ---------------------------------------------------------------------------------

def interleaved(row: np.ndarray, col: np.ndarray, depth: int) -> np.ndarray:
    out = np.zeros(len(row), np.int64)
    for i in range(depth):
        out |= ((row >> i) & 1) << (2 * i + 1) | ((col >> i) & 1) << (2 * i)
    return out


class Treap:
    """Cells (row, col, value > 0) of one block, each at most once."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n_rows: int, n_cols: int):
        high, wide = max(1, (n_rows - 1).bit_length()), max(1, (n_cols - 1).bit_length())
        self.depth = max(high, wide)
        self.row_shift, self.col_shift = self.depth - high, self.depth - wide
        key = interleaved(row << self.row_shift, col << self.col_shift, self.depth)
        order = np.argsort(key)
        key, top = key[order], value[order]
        maps, first, below = [], [], []
        for _ in range(self.depth):
            up = key >> 2
            at = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]])) if len(up) else np.zeros(0, np.int64)
            maps.append(np.bitwise_or.reduceat(1 << (key & 3), at).astype(np.uint8))
            above = np.maximum.reduceat(top, at)
            below.append(np.repeat(above, np.diff(np.append(at, len(key)))) - top)
            first.append(at)
            key, top = up[at], above
        # root first; the children of a level begin where the next level does
        sizes = [1, *[len(d) for d in reversed(below)]]
        begin = np.cumsum(sizes)
        self.maps = np.concatenate(maps[::-1])
        self.first = np.concatenate([f + b for f, b in zip(reversed(first), begin, strict=False)])
        self.below = np.concatenate([np.zeros(1, np.int64), *reversed(below)])
        self.below = self.below.astype(np.min_scalar_type(int(self.below.max())))
        self.largest = int(top[0])

    def best(self, rows: np.ndarray, k: int = TOP, worst: tuple[int, int] = (0, 0)) -> list[tuple[int, int]]:
        """(score, column) of the ``k`` columns with the largest sum over ``rows`` that come before ``worst``: a larger score, or the same and a smaller column."""
        path = rows.astype(np.int64) << self.row_shift
        score, place = worst
        kept: list[tuple[int, int]] = []
        heap = [(-self.largest * len(rows), 0, 0, np.zeros(len(rows), np.int64), np.full(len(rows), self.largest, np.int64))]
        while heap:
            group = []
            while heap and len(group) < SPLIT_AT_ONCE and (-heap[0][0] > score or -heap[0][0] == score and heap[0][1] >> self.col_shift < place):
                group.append(heapq.heappop(heap))
            if not group:
                break
            level = np.array([g[2] for g in group])
            node, held = np.stack([g[3] for g in group]), np.stack([g[4] for g in group])
            down = (self.depth - 1 - level)[:, None]
            row_bit = (path[None, :] >> down) & 1
            bits = np.where(node >= 0, self.maps[node], 0)
            for col_bit in (0, 1):
                quadrant = 2 * row_bit + col_bit
                there = (bits >> quadrant) & 1 == 1
                child = np.where(there, self.first[node] + POPULATION[bits & ((1 << quadrant) - 1)], -1)
                most = np.where(there, held - self.below[child].astype(np.int64), 0)
                bound = most.sum(axis=1)
                for g in np.flatnonzero((bound > 0) & (bound >= score)):
                    b, at = int(bound[g]), group[g][1] | (col_bit << int(down[g, 0]))
                    column = at >> self.col_shift
                    if b < score or b == score and column >= place:
                        continue
                    if level[g] + 1 < self.depth:
                        heapq.heappush(heap, (-b, at, int(level[g]) + 1, child[g], most[g]))
                        continue
                    heapq.heappush(kept, (b, -column))
                    if len(kept) > k:
                        heapq.heappop(kept)
                    if len(kept) == k:
                        score, place = max((score, -place), kept[0])
                        place = -place
        return [(s, -c) for s, c in kept]


# --- terms -----------------------------------------------------------------------------------------------

def term_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the part and hash of every term, in order."""
    buf, starts = joined(parts)
    buf = LOWER[buf]
    edge = np.diff(np.concatenate([[False], IN_TERM[buf], [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return np.searchsorted(starts, first, "right") - 1, span_hash(prefix_hash(buf), first, last)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def texts_of(b: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct items with the hashes of their distinct terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, h = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for own, parts, _ in runs(texts_of(b), ~IN_TERM):
                doc, code = term_hashes(parts)
                of.append(np.array(own)[doc])
                h.append(code)
            pair = np.unique(np.stack([np.concatenate(of), np.concatenate(h).view(np.int64)]), axis=1)
            offsets = np.searchsorted(pair[0], np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column("item_id"), lists(pair[1], offsets, pa.int64())], names=["item_id", "terms"])
    once = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return once.mapInArrow(run, "item_id long, terms array<long>").where(F.size("terms") > 0)


PACKED = "doc_id long, n long, terms array<int>, tfs array<int>"


def packed_terms(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """Per document: number of terms, and number and occurrences of those in the sorted hashes ``vocabulary``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            codes, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for own, parts, _ in runs(texts_of(b), ~IN_TERM):
                doc, h = term_hashes(parts)
                doc = np.array(own)[doc]
                n += np.bincount(doc, minlength=b.num_rows)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                code, count = np.unique(doc[hit] * len(known) + at[hit], return_counts=True)
                codes.append(code)
                times.append(count)
            code, inverse = np.unique(np.concatenate(codes), return_inverse=True)  # a long text came in several pieces
            count = np.bincount(inverse, np.concatenate(times), len(code)).astype(np.int64)
            offsets = np.searchsorted(code // len(known), np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), lists(code % len(known), offsets, pa.int32()), lists(count, offsets, pa.int32())],
                                             names=[c.split()[0] for c in PACKED.split(", ")])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PACKED)


# --- search ----------------------------------------------------------------------------------------------

Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
LAST = np.iinfo(np.int64).max


def blocks(batches: Iterator[pa.RecordBatch], most_docs: int = BLOCK_DOCS, most_cells: int = BLOCK_CELLS) -> Iterator[Block]:
    """Bounded runs of documents by doc_id: ids, which of them are null, lengths, and the cells' documents, terms and occurrences."""
    held, docs, cells = [], 0, 0

    def block() -> Block:
        t = pa.Table.from_batches(held)
        null = t.column("doc_id").is_null().to_numpy()
        ids = t.column("doc_id").fill_null(0).to_numpy()
        order = np.lexsort((ids, null))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes = np.concatenate([np.diff(b.column("terms").offsets.to_numpy()) for b in held])
        flat = lambda c: np.concatenate([b.column(c).flatten().to_numpy() for b in held]).astype(np.int64)
        return ids[order], null[order], t.column("n").to_numpy()[order], np.repeat(place, sizes), flat("terms"), flat("tfs")

    for b in batches:
        if docs and (docs + b.num_rows > most_docs or cells + len(b.column("terms").flatten()) > most_cells):
            yield block()
            held, docs, cells = [], 0, 0
        if b.num_rows:
            held.append(b)
            docs += b.num_rows
            cells += len(b.column("terms").flatten())
    if held:
        yield block()


FOUND = "item int, item_id long, doc_id long, score long"


def search(packed: DataFrame, given: Broadcast, top: int = TOP, bounds: tuple[int, int] = (BLOCK_DOCS, BLOCK_CELLS)) -> DataFrame:
    """The ``top`` best documents of each item among those of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, item_ids, items, total, length = given.value
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]  # (-score, id is null, id), best first
        for ids, null, n, doc, term, tf in blocks(batches, *bounds):
            mean = np.array([50 + 50 * int(x) * total // length for x in n], np.int64)
            value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * mean[doc]))
            on = value > 0
            if not on.any():
                continue
            present, row = np.unique(term[on], return_inverse=True)
            treap = Treap(row, doc[on], value[on], len(present), len(ids))
            n_ids = int(len(ids) - null.sum())
            for i, own in enumerate(items):
                at = np.searchsorted(present, own)
                rows = at[(at < len(present)) & (present[np.minimum(at, len(present) - 1)] == own)]
                if not len(rows):
                    continue
                worst = (0, 0)
                if len(best[i]) == top:
                    s, is_null, doc_id = best[i][-1]
                    worst = (-s, n_ids if is_null else int(np.searchsorted(ids[:n_ids], doc_id)))
                new = [(-s, bool(null[c]), int(ids[c])) for s, c in treap.best(rows, top, worst)]
                best[i] = heapq.nsmallest(top, best[i] + new)
        rows = [(i, item_ids[i], None if is_null else doc_id, -s) for i, own in enumerate(best) for s, is_null, doc_id in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                         names=[c.split()[0] for c in FOUND.split(", ")])
    return packed.mapInArrow(run, FOUND)


def ranked_slice(docs: DataFrame, items: list, top: int, bounds: tuple[int, int]) -> DataFrame:
    spark = docs.sparkSession
    hashes = [np.array(r["terms"], np.int64).view(np.uint64) for r in items]
    known = np.unique(np.concatenate(hashes))
    packed = store(packed_terms(docs, spark.sparkContext.broadcast(known)), "terms")
    total, length = packed.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = packed.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    df = np.zeros(len(known), np.int64)
    for r in held:
        df[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    own = [np.searchsorted(known, np.sort(h)) for h in hashes]
    given = spark.sparkContext.broadcast((weights, [r["item_id"] for r in items], own, total, max(length, 1)))
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = search(packed, given, top, bounds).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return best.select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, bounds: tuple[int, int] = (BLOCK_DOCS, BLOCK_CELLS)) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of each item with a score above 0."""
    asked = store(item_terms(items), "items")
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    slices = -(-total // SLICE_TERMS)
    of = F.pmod(F.xxhash64("item_id", "terms"), F.lit(max(slices, 1)))
    rows = (asked.where(of == s).orderBy("item_id").collect() for s in range(slices))
    parts = [ranked_slice(docs, own, top, bounds) for own in rows if own]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{term}')"
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS k, {words} AS words FROM documents),
    s AS (SELECT count(*) FILTER (len(words) > 0) AS total, CAST(sum(len(words)) AS BIGINT) AS length FROM d),
    t AS (SELECT k, any_value(doc_id) AS doc_id, any_value(len(words)) AS n, word, count(*) AS tf FROM (SELECT k, doc_id, words, unnest(words) AS word FROM d) GROUP BY k, word),
    w AS (SELECT word, CAST(floor(1000 * ln(CAST(2 * any_value(total) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t CROSS JOIN s GROUP BY 1),
    i AS (SELECT DISTINCT item_id, unnest(list_distinct({words})) AS word FROM benchmark),
    r AS (SELECT item_id, k, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * total) // length))))) AS BIGINT) AS score
          FROM i JOIN t USING (word) JOIN w USING (word) CROSS JOIN s GROUP BY 1, 2),
    o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
    SELECT * FROM o WHERE rank <= {TOP}"""
