"""Exact top-k by integer inner product with M-trees and best-first search.

Components become floor(64 * x). One more component brings all vectors to the largest length, so that the order by inner
product is the order by distance, a metric. The rows are dealt to ``CELLS`` routing objects (nearest first) and a cell into
blocks of at most about ``BLOCK`` rows; each block is an M-tree of pages of ``PAGE`` entries with covering radii and parent
distances. A query first searches one block of its nearest cell, which gives it a bound, then every block of the cells
whose radius lets them beat the bound. Within a tree the queries of a batch visit pages by their smallest possible distance,
best first, in waves that tighten their limits; children and entries that the stored parent distance rules out are never
compared.

Equal vectors are one entry. Null vectors and those with null or non-finite components take no part, nor do null ids; zero
vectors do. A repeated id is a row of its own; as a query it is asked once, with its smallest vector. Shorter vectors count
as filled up with zeros. Other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.vectors import BLOCK, QUERY_STEP, TOP, best_of, distinct_vectors, finite, matrix, meet, packed, unpacked
from rallyframe.session import pin

CELLS, PAGE, SCALE = 32, 64, 64
WAVES = (1, 5)
NONE = np.iinfo(np.int64).min
FOUND = "query_id long, vid long, score long"
EMPTY = "query_id long, rank int, vec_id long, score long"


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where no sum can leave their exact range."""
    if max(1, np.abs(a).max(initial=0)) * max(1, np.abs(b).max(initial=0)) * a.shape[-1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


class Tree:
    """Nodes are [routing object, covering radius, distance to the parent's object, entries]; entries are rows of a leaf with
    their distances to its object, or child nodes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest_sq: float):
        self.ids, self.x, self.longest_sq = ids, x, longest_sq
        rest = np.sqrt(np.maximum(0.0, longest_sq - (x.astype(np.float64) ** 2).sum(1)))
        self.points = np.column_stack([x.astype(np.float64), rest])
        self.slack = 1e-7 * np.sqrt(max(1.0, longest_sq))
        self.root = self.node(np.arange(len(ids)), None)

    def distances(self, rows: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[center]) ** 2).sum(1))

    def node(self, rows: np.ndarray, parent: int | None) -> dict:
        mean = self.points[rows].mean(0)
        center = int(rows[((self.points[rows] - mean) ** 2).sum(1).argmin()])
        d = self.distances(rows, center)
        made = {"center": center, "radius": float(d.max()), "up": 0.0 if parent is None else float(self.distances(np.array([parent]), center)[0])}
        if len(rows) <= PAGE:
            return made | {"leaf": True, "rows": rows, "near": d}
        seeds = rows[np.linspace(0, len(rows) - 1, min(PAGE, -(-2 * len(rows) // PAGE))).astype(int)]
        gaps = (self.points[rows] ** 2).sum(1)[:, None] - 2 * self.points[rows] @ self.points[seeds].T + (self.points[seeds] ** 2).sum(1)
        own = gaps.argmin(1)
        parts = [rows[own == k] for k in range(len(seeds))]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:
            parts = np.array_split(rows, 2)
        kids = [self.node(p, center) for p in parts]
        return made | {"leaf": False, "kids": kids, "near": np.array([k["up"] for k in kids]), "reach": np.array([k["radius"] for k in kids]),
                       "at": np.array([k["center"] for k in kids])}

    def leaves(self, node: dict) -> list[dict]:
        return [node] if node["leaf"] else [x for k in node["kids"] for x in self.leaves(k)]

    def lower_bounds(self, points: np.ndarray, limit: np.ndarray) -> tuple[list[dict], np.ndarray, np.ndarray]:
        """The leaves, the smallest possible distance of each query to them (infinite where ruled out) and the distances to their
        objects. Children that the parent distance rules out for all queries are not compared."""
        found: list[tuple[dict, np.ndarray, np.ndarray]] = []

        def away(at: np.ndarray) -> np.ndarray:
            c = self.points[at]
            return np.sqrt(np.maximum(0.0, (points**2).sum(1)[:, None] - 2 * points @ c.T + (c**2).sum(1)))

        def walk(node: dict, d: np.ndarray, low: np.ndarray) -> None:
            if node["leaf"]:
                found.append((node, low, d))
                return
            may = (np.abs(d[:, None] - node["near"]) - node["reach"] <= limit[:, None]) & (low <= limit)[:, None]
            for k in np.flatnonzero(may.any(0)):
                far = away(node["at"][k:k + 1])[:, 0]
                walk(node["kids"][k], far, np.where(may[:, k], np.maximum(low, far - node["reach"][k] - self.slack), np.inf))

        d = away(np.array([self.root["center"]]))[:, 0]
        walk(self.root, d, np.maximum(0.0, d - self.root["radius"] - self.slack))
        return [x for x, _, _ in found], np.column_stack([x for _, x, _ in found]) if found else np.zeros((len(points), 0)), np.column_stack([x for _, _, x in found]) if found else np.zeros((len(points), 0))

    def search(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, rows and scores of the ``TOP + 1`` best scores not below the bounds; ties go to smaller ids. The queries
        visit their pages best first, in waves; a wave's scores tighten the limits for the next."""
        points = np.column_stack([q.astype(np.float64), np.zeros(len(q))])
        base = (points**2).sum(1) + self.longest_sq
        limit = np.where(np.isneginf(bound), np.inf, np.sqrt(np.maximum(0.0, base - 2 * np.where(np.isneginf(bound), 0, bound))) + self.slack)
        pages, low, dist = self.lower_bounds(points, limit)
        place = np.argsort(np.argsort(low, 1, kind="stable"), 1)
        score = np.full((len(q), len(self.ids)), NONE)
        done = 0
        for until in (*WAVES, len(pages)):
            asked = (place >= done) & (place < until) & (low <= limit[:, None])
            done = until
            for k in np.flatnonzero(asked.any(0)):
                at = np.flatnonzero(asked[:, k])
                ok = np.abs(dist[at, k][:, None] - pages[k]["near"]) <= limit[at][:, None]
                use = ok.any(0)
                if use.any():
                    rows = pages[k]["rows"][use]
                    score[np.ix_(at, rows)] = np.where(ok[:, use], product(q[at], self.x[rows].T), NONE)
            if len(self.ids) > TOP:
                edge = np.partition(score, len(self.ids) - TOP - 1, 1)[:, len(self.ids) - TOP - 1]
                known = edge > NONE
                limit[known] = np.minimum(limit[known], np.sqrt(np.maximum(0.0, base[known] - 2.0 * edge[known])) + self.slack)
        return best_rows(score, self.ids)


def best_rows(score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, cols = [], []
    k = min(TOP + 1, len(ids))
    edge = np.partition(score, len(ids) - k, 1)[:, len(ids) - k]
    for i, s in enumerate(score):
        at = np.flatnonzero((s >= edge[i]) & (s > NONE))
        at = at[np.lexsort((ids[at], -s[at]))][:k]
        rows.append(np.full(len(at), i))
        cols.append(at)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    return rows, cols, score[rows, cols]


def finder(longest_sq: float):
    def build(ids, data):
        return Tree(ids, unpacked(data, np.int64), longest_sq)

    def search(tree, ids, data, bounds):
        asked, rows, score = tree.search(unpacked(data, np.int64), bounds)
        return pd.DataFrame({"query_id": ids[asked], "vid": tree.ids[rows], "score": score})
    return build, search


def top_scores(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``TOP`` best rows for each row whose key is divisible by ``QUERY_STEP``."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"))
    rows = rows.where(finite(F.col("vec"))).withColumn("vec", F.transform("vec", lambda x: F.floor(x * SCALE).cast("long")))
    groups = pin(distinct_vectors(rows))
    stats = groups.agg(F.max(F.size("vec")).alias("dim"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("sq")).first()
    if stats.dim is None:
        return vectors.sparkSession.createDataFrame([], EMPTY)
    dim, longest_sq = stats.dim, float(stats.sq)
    seeds = np.zeros((CELLS, dim), np.int64)
    chosen = groups.orderBy(F.xxhash64("vid"), "vid").limit(CELLS).select("vec").collect()
    for i, r in enumerate(chosen):
        seeds[i, :len(r.vec)] = r.vec
    seeds = seeds[:len(chosen)].astype(np.float64)
    seed_points = np.column_stack([seeds, np.sqrt(np.maximum(0.0, longest_sq - (seeds**2).sum(1)))])

    def gaps(x: np.ndarray, rest: np.ndarray) -> np.ndarray:
        p = np.column_stack([x.astype(np.float64), rest])
        return np.sqrt(np.maximum(0.0, (p**2).sum(1)[:, None] - 2 * p @ seed_points.T + (seed_points**2).sum(1)))

    def dealt(batches):
        for b in batches:
            x = matrix(b["vec"], np.int64, dim)
            d = gaps(x, np.sqrt(np.maximum(0.0, longest_sq - (x.astype(np.float64) ** 2).sum(1))))
            yield pd.DataFrame({"cell": d.argmin(1), "away": d.min(1), "id": b["vid"], "data": packed(x)})

    rows_of = groups.select("vid", "vec").mapInPandas(dealt, "cell int, away double, id long, data binary")
    cells = rows_of.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).orderBy("cell").collect()
    blocks = {c.cell: -(-c.n // BLOCK) for c in cells}
    known = np.array([c.cell for c in cells])
    radius = np.array([c.radius for c in cells]) + 1e-7 * np.sqrt(max(1.0, longest_sq))
    members = rows_of.withColumn("block", F.pmod(F.xxhash64("id"), F.element_at(F.create_map(*[F.lit(v) for c in blocks.items() for v in c]), F.col("cell"))).cast("long"))
    queries = rows.where(F.col("vec_id") % QUERY_STEP == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    ask = "cell int, block long, id long, data binary, bound double"

    def first_asks(batches):
        for b in batches:
            x = matrix(b["vec"], np.int64, dim)
            home = known[gaps(x, np.zeros(len(x)))[:, known].argmin(1)]
            yield pd.DataFrame({"cell": home, "block": [i % blocks[c] for i, c in zip(b["vec_id"], home, strict=True)], "id": b["vec_id"], "data": packed(x),
                                "bound": -np.inf}).astype({"cell": "int32", "block": "int64"})

    def other_asks(batches):
        for b in batches:
            x = matrix(b["vec"], np.int64, dim)
            away = gaps(x, np.zeros(len(x)))[:, known]
            base = (x.astype(np.float64) ** 2).sum(1) + longest_sq
            limit = np.sqrt(np.maximum(0.0, base - 2 * b["bound"].to_numpy())) + 1e-7 * np.sqrt(max(1.0, longest_sq))
            limit[np.isneginf(b["bound"])] = np.inf
            data, home = packed(x), known[away.argmin(1)]
            for k, c in enumerate(known):
                may = np.flatnonzero(away[:, k] - radius[k] <= limit)
                for block in range(blocks[c]):
                    at = [i for i in may if not (home[i] == c and b["vec_id"][i] % blocks[c] == block)]
                    if at:
                        yield pd.DataFrame({"cell": c, "block": block, "id": b["vec_id"].to_numpy()[at], "data": [data[i] for i in at],
                                            "bound": b["bound"].to_numpy()[at]}).astype({"cell": "int32", "block": "int64"})

    build, search = finder(longest_sq)
    near = pin(meet(members, queries.mapInPandas(first_asks, ask), ["cell", "block"], build, search, FOUND))
    bounds = near.groupBy("query_id").agg(F.when(F.count("*") > TOP, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("bound"))
    bounded = queries.join(bounds, queries.vec_id == bounds.query_id, "left").select("vec_id", "vec", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    rest = meet(members, bounded.mapInPandas(other_asks, ask), ["cell", "block"], build, search, FOUND)
    return best_of(near.unionByName(rest), groups, "long")


def oracle() -> str:
    return """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""
