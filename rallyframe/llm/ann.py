"""Approximate nearest neighbours by largest inner product with multiprobe p-stable hashing.

Entries are split into bands of length, each ``RATIO`` times the next. In a band, vectors get one more component that brings all
of them to the band's top length, so that the largest inner product is the smallest distance. Each table hashes with ``FUNCTIONS`` random projections cut into steps of ``WIDTH`` times that length.
A query has, in each table, a sequence of buckets in the order of the smallest displacement that brings its vector there: its own
first, then those one, two and more steps away, over the box of steps in which the table has entries. It visits ``PROBES`` of them in
every band; the candidates are merged and ranked by their exact inner product on the original vectors. A query that has met
fewer than ``ENOUGH`` entries a table, or found fewer than ``TOP + 1`` different ones, goes on along its sequences, each time four times as
far, until it has met enough or the boxes are exhausted, when it has met every entry. Bands of all sizes are hashed alike.

A bucket of any size is cut into blocks of at most about ``BLOCK`` rows; a query meets each of them. Equal vectors are one
entry, so a vector repeated a million times is no large bucket. Null vectors, zero vectors and those with null or non-finite
components take no part, nor do null ids; repeated ids are rows of their own. Shorter vectors count as filled up with
zeros. A table without any vector that takes part gives no rows. Other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.vectors import BLOCK, QUERY_STEP, TOP, best_of, distinct_vectors, finite, matrix, meet, packed, unpacked
from rallyframe.session import pin

TABLES, FUNCTIONS, WIDTH, PROBES, ENOUGH, SEED, RATIO = 4, 4, 1.4, 60, 84, 20240, 1.25
CELLS = 2_000_000  # displacements worked out at once
FOUND = "query_id long, vid long, score double, met long"
KEYED = "tbl int, bucket long, id long, data binary"


class Tables:
    """The random projections of all tables for vectors of ``dim`` components and a largest length of ``longest``, by band."""

    def __init__(self, dim: int, longest: float):
        rng = np.random.default_rng(SEED)
        self.dim, self.longest = dim, longest
        self.a = rng.normal(size=(dim + 1, TABLES * FUNCTIONS))
        self.b = rng.uniform(0, WIDTH, TABLES * FUNCTIONS)
        self.code = rng.integers(1, 2**62, size=(TABLES, FUNCTIONS)) | 1
        self.band_code = int(rng.integers(1, 2**62)) | 1
        self.low = self.high = np.zeros((TABLES, FUNCTIONS), np.int64)  # the box of steps with entries

    def projected(self, points: np.ndarray) -> np.ndarray:
        return (points @ self.a + self.b).reshape(len(points), TABLES, FUNCTIONS)

    def cells(self) -> int:
        """Buckets in the box of the table that has most."""
        return int((self.high - self.low + 1).prod(1).max())

    def bands(self, x: np.ndarray) -> np.ndarray:
        largest = np.abs(x).max(1)  # scaled first, so that no square is lost
        size = np.linalg.norm(x / largest[:, None], axis=1) * (largest / self.longest)
        return np.maximum(0, np.floor(-np.log(np.maximum(size, 5e-324)) / np.log(RATIO) + 1e-9)).astype(np.int64)

    def of_band(self, buckets: np.ndarray, band: np.ndarray) -> np.ndarray:
        return buckets + np.asarray(band, np.int64) * self.band_code

    def steps(self, x: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Step numbers of entries by table and function, all bands alike."""
        x = x / self.longest * (RATIO ** band.astype(float))[:, None]
        rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
        return np.floor(self.projected(np.column_stack([x, rest])) / WIDTH).astype(np.int64)

    def entries(self, x: np.ndarray, band: np.ndarray) -> np.ndarray:
        """One bucket per table for each row."""
        return (self.steps(x, band) * self.code).sum(-1)

    def probes(self, q: np.ndarray, t: int, first: int, last: int) -> np.ndarray:
        """Buckets ``first`` to ``last`` of each query's sequence in table ``t``, most promising first."""
        q = q / np.abs(q).max(1)[:, None]
        q = q / np.linalg.norm(q, axis=1)[:, None]
        at = self.projected(np.column_stack([q, np.zeros(len(q))]))[:, t]
        cost, bucket = np.zeros((len(q), 1)), np.zeros(1, np.int64)
        for f in range(FUNCTIONS):
            step = np.arange(self.low[t, f], self.high[t, f] + 1)
            away = np.maximum(0, np.maximum(step * WIDTH - at[:, f, None], at[:, f, None] - (step + 1) * WIDTH))
            cost = (cost[:, :, None] + (away**2)[:, None, :]).reshape(len(q), -1)
            bucket = (bucket[:, None] + step * self.code[t, f]).ravel()
        return bucket[np.argsort(cost, 1, kind="stable")[:, first:last]]


def search_block(block, ids, data, _bounds) -> pd.DataFrame:
    vids, x = block
    score = unpacked(data, np.float64) @ x.T
    k = min(TOP + 1, len(vids))
    rows, cols = [], []
    for i, s in enumerate(score):
        edge = np.partition(s, len(s) - k)[len(s) - k]
        at = np.flatnonzero(s >= edge)
        at = at[np.lexsort((vids[at], -s[at]))][:k]
        rows.append(np.full(len(at), i))
        cols.append(at)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    met = np.where(np.concatenate([[True], rows[1:] != rows[:-1]]), len(vids), 0)  # once a query
    return pd.DataFrame({"query_id": ids[rows], "vid": vids[cols], "score": score[rows, cols], "met": met})


def nearest(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``TOP`` best found for each row whose key is divisible by ``QUERY_STEP``."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"))
    rows = rows.where(finite(F.col("vec"))).where(F.exists("vec", lambda x: x != 0))
    groups = pin(distinct_vectors(rows))
    stats = groups.agg(F.max(F.size("vec")).alias("dim"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("sq")).first()
    if stats.dim is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tables = Tables(stats.dim, float(np.sqrt(stats.sq)))

    def banded(batches):
        for b in batches:
            x = matrix(b["vec"], np.float64, tables.dim)
            yield pd.DataFrame({"band": tables.bands(x), "id": b["vid"], "data": packed(x)})

    entries = pin(groups.select("vid", "vec").mapInPandas(banded, "band long, id long, data binary"))
    sizes = {r.band: r.n for r in entries.groupBy("band").agg(F.count("*").alias("n")).collect()}  # one row a band

    def extents(batches):
        for b in batches:
            if len(b):
                steps = tables.steps(unpacked(b["data"], np.float64), b["band"].to_numpy()).reshape(len(b), -1)
                yield pd.DataFrame({"f": np.arange(steps.shape[1]), "low": steps.min(0), "high": steps.max(0)})

    box = entries.mapInPandas(extents, "f long, low long, high long").groupBy("f").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    box = box.toPandas().sort_values("f")  # one row a function
    tables.low, tables.high = (box[c].to_numpy(np.int64).reshape(TABLES, FUNCTIONS) for c in ("low", "high"))

    def hashed(batches):
        for b in batches:
            if len(b):
                band = b["band"].to_numpy()
                found = tables.of_band(tables.entries(unpacked(b["data"], np.float64), band), band[:, None])
                for t in range(TABLES):
                    yield pd.DataFrame({"tbl": t, "bucket": found[:, t], "id": b["id"], "data": b["data"]}).astype({"tbl": "int32"})

    def probing(first, last):
        at_once = min(256, max(1, CELLS // tables.cells()))

        def run(batches):
            for b in batches:
                for i in range(0, len(b), at_once):
                    x = matrix(b["vec"][i:i + at_once], np.float64, tables.dim)
                    ids, data = b["vec_id"][i:i + at_once].to_numpy(), np.array([*packed(x), None], dtype=object)[:-1]
                    for t in range(TABLES):
                        found = tables.probes(x, t, first, last)
                        for band in sizes:
                            yield pd.DataFrame({"tbl": t, "bucket": tables.of_band(found, band).ravel(), "id": np.repeat(ids, found.shape[1]),
                                                "data": np.repeat(data, found.shape[1])}).astype({"tbl": "int32"})
        return run

    def met(members, asks):
        blocks = members.groupBy("tbl", "bucket").count().select("tbl", "bucket", F.ceil(F.col("count") / BLOCK).alias("blocks"))
        members = members.join(blocks, ["tbl", "bucket"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
        asks = asks.join(blocks, ["tbl", "bucket"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("bound", F.lit(0.0))
        return meet(members, asks, ["tbl", "bucket", "block"], lambda ids, data: (ids, unpacked(data, np.float64)), search_block, FOUND)

    members, found, first, last = entries.mapInPandas(hashed, KEYED), None, 0, PROBES
    waiting = rows.where(F.col("vec_id") % QUERY_STEP == 0).dropDuplicates(["vec_id"])
    total = sum(sizes.values())
    while True:  # as often as four goes into the cells of a box
        new = pin(met(members, waiting.mapInPandas(probing(first, last), KEYED)))
        found = new if found is None else found.unionByName(new)
        first, last = last, 4 * last
        if first >= tables.cells():
            break
        sums = found.groupBy("query_id").agg(F.countDistinct("vid").alias("n"), F.sum("met").alias("met"))
        enough = sums.where((F.col("n") >= min(TOP + 1, total)) & (F.col("met") >= TABLES * min(ENOUGH, total)))
        waiting = pin(waiting.join(enough, waiting.vec_id == enough.query_id, "left_anti"))
        if waiting.isEmpty():
            break
    return best_of(found, groups, "double")
