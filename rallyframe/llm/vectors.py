"""Shared by the two vector searches: cleaning, one row per distinct vector, bounded blocks of rows against queries."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_STEP, TOP, BLOCK = 20, 20, 2048


def finite(vec: Column) -> Column:
    """A vector that is not null and holds only finite components."""
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def distinct_vectors(rows: DataFrame, ids: int = TOP + 1) -> DataFrame:
    """``vid`` (smallest id), ``vec`` and the ``ids`` smallest ids of every distinct vector. Equal vectors have equal scores and
    ties go to smaller ids, so that no search for the ``ids - 1`` best, its own row left out, can need another one."""
    same = Window.partitionBy("vec").orderBy("vec_id")
    first = rows.where(F.col("vec_id").isNotNull()).withColumn("rn", F.row_number().over(same)).where(F.col("rn") <= ids)
    return first.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vid"), "vec", "ids")


def matrix(column: pd.Series, dtype, dim: int) -> np.ndarray:
    """Rows of an array column, short ones filled up with zeros."""
    out = np.zeros((len(column), dim), dtype)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def packed(m: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in m]


def unpacked(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1)


def meet(members: DataFrame, asks: DataFrame, keys: list[str], build: Callable, search: Callable, schema: str) -> DataFrame:
    """Rows and queries of equal ``keys`` meet in one task: ``build(ids, vectors)`` once a key, then ``search(block, ids, vectors,
    bounds)`` on the queries of a batch, which returns a frame of ``schema``. The caller keeps the members of a key few."""
    cols = [*keys, "is_ask", "id", "data", "bound"]
    both = (members.select(*keys, F.lit(0).alias("is_ask"), "id", "data", F.lit(0.0).alias("bound"))
            .unionByName(asks.select(*keys, F.lit(1).alias("is_ask"), "id", "data", "bound")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, block = None, [], None
        for b in batches:
            if b.empty:
                continue
            own = list(zip(*[b[k] for k in keys], b["is_ask"], strict=True))
            cuts = [i for i in range(len(own)) if i == 0 or own[i] != own[i - 1]]
            for i, j in zip(cuts, [*cuts[1:], len(own)], strict=True):
                key, part = own[i][:-1], b.iloc[i:j]
                if key != now:
                    now, rows, block = key, [], None
                if not own[i][-1]:
                    rows.append(part)
                elif rows:
                    if block is None:
                        all_rows = pd.concat(rows)
                        block = build(all_rows["id"].to_numpy(), all_rows["data"])
                    yield search(block, part["id"].to_numpy(), part["data"], part["bound"].to_numpy())

    return both.select(*cols).repartition(*keys).sortWithinPartitions(*keys, "is_ask").select(*cols).mapInPandas(run, schema)


def best_of(found: DataFrame, groups: DataFrame, score_type: str) -> DataFrame:
    """The ``TOP`` best rows of each query from its best distinct vectors: ids of equal vectors are listed again, own rows go."""
    once = found.groupBy("query_id", "vid").agg(F.max("score").alias("score"))
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vid")
    few = once.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= TOP + 1)
    rows = few.join(groups.select("vid", "ids"), "vid").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= TOP)
            .select("query_id", F.col("rank").cast("int"), "vec_id", F.col("score").cast(score_type)))
