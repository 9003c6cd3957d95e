"""Ordered-sequence primitives that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy("match_id")`` puts a whole match into one task. Here a sequence is cut
into chunks by an order-preserving chunk number, and two exact building blocks work on chunks:

* ``bounded``  - windows of a fixed reach; rows near a chunk border are copied to the neighbour chunk.
* ``scan``     - unbounded prefix/suffix aggregates; every chunk is reduced to one summary row
  (map-side combined), the summaries are windowed per key, and the carry is joined back by chunk.
* ``fold_chunks`` - the same for states that no window knows: a summary row says what its chunk does to every
  state it may be entered in, and the summaries of a key are folded in order.

Only chunk summaries (rows / chunk size) ever meet in one task.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from rallyframe.session import ship

CHUNK = 8192


def frame_chunk(order: str = "frame_idx", size: int | None = None) -> Column:
    return F.expr(f"CAST(FLOOR({order} / CAST({size or CHUNK} AS DOUBLE)) AS BIGINT)")


def bounded(df: DataFrame, keys: Sequence[str], order: str, before: int, after: int,
            fn: Callable[[DataFrame, WindowSpec], DataFrame], size: int | None = None,
            keep_chunk: bool = False) -> DataFrame:
    """Apply window logic that reaches at most ``before``/``after`` units of ``order``.

    ``order`` is an integer column. On a dense sequence (one row per unit) row frames are exact; on a
    sparse one ``fn`` must use range frames. With ``keep_chunk`` a following ``scan`` over the same
    keys and order works on the same partitioning without another shuffle.
    """
    size = size or CHUNK
    if size <= max(before, after):
        raise ValueError("chunk size must exceed the window reach")
    home = frame_chunk(order, size)
    pos = F.expr(f"pmod({order}, {size})")
    copies = [home]
    if before:
        copies.append(F.when(pos >= size - before, home + 1))
    if after:
        copies.append(F.when(pos < after, home - 1))
    # an input that is already partitioned by the keys alone must not keep a hot key in one task
    spread = df.withColumn("_chunk", F.explode(F.array_compact(F.array(*copies)))).repartition(*keys, "_chunk")
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    own = fn(spread, w).filter(F.col("_chunk") == home)
    return own if keep_chunk else own.drop("_chunk")


@dataclass(frozen=True)
class Agg:
    """One aggregate of a scan: ``kind`` over the rows named by ``span``."""
    kind: str    # sum, count, min, max, last, first (last/first skip nulls)
    span: str    # before, upto, after, from, all
    value: Column


def _agg(kind: str, value: Column) -> Column:
    plain = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    if kind in plain:
        return plain[kind](value)
    return F.last(value, ignorenulls=True) if kind == "last" else F.first(value, ignorenulls=True)


def _pick(a: Agg, kind: DataType, rank: Column, name: str) -> tuple[list[Column], Column]:
    """Aggregates for the last/first value of a chunk and the expression that puts it together.

    Struct values are taken field by field, so the aggregation buffers stay fixed-width and Spark can
    use hash instead of sort aggregation.
    """
    pick, ends = (F.max_by, F.max) if a.kind == "last" else (F.min_by, F.min)
    where = F.when(a.value.isNotNull(), rank)
    if not isinstance(kind, StructType):
        return [pick(a.value, where).alias(name)], F.col(name)
    cols = [pick(a.value[f.name], where).alias(f"{name}_{f.name}") for f in kind]
    cols.append(ends(where).alias(f"{name}_at"))
    whole = F.struct(*[F.col(f"{name}_{f.name}").alias(f.name) for f in kind])
    return cols, F.when(F.col(f"{name}_at").isNotNull(), whole)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None = None,
         size: int | None = None, **aggs: Agg) -> DataFrame:
    """Add one column per aggregate, exact over the whole ordered sequence of each key.

    ``order`` is a unique order inside a key, ``chunk`` a number that never decreases along it (a
    ``_chunk`` column left by ``bounded`` is used as it is).
    """
    keys, order, columns = list(keys), list(order), df.columns
    if "_chunk" in columns and chunk is None:
        d = rows = df
    else:
        d = df.withColumn("_chunk", chunk if chunk is not None else frame_chunk(order[0], size))
        rows = d.repartition(*keys, "_chunk")
    asc = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    desc = Window.partitionBy(*keys, "_chunk").orderBy(*[F.desc(o) for o in order])
    start = Window.unboundedPreceding
    frames = {"before": asc.rowsBetween(start, -1), "upto": asc.rowsBetween(start, 0),
              "after": desc.rowsBetween(start, -1), "from": desc.rowsBetween(start, 0)}
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])

    picked = {n: a.value for n, a in aggs.items() if a.kind in ("last", "first")}
    kinds = {f.name: f.dataType for f in d.select(*[v.alias(n) for n, v in picked.items()]).schema} if picked else {}
    summary_cols, whole_cols, carry_cols, local_cols, out_cols = [], [], [], [], []
    casc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(start, -1)
    cdesc = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(start, -1)
    call = Window.partitionBy(*keys)
    for name, a in aggs.items():
        backward = a.span in ("after", "from")
        s, c, loc = f"_s_{name}", f"_c_{name}", f"_l_{name}"
        if a.kind in ("last", "first"):
            parts, whole = _pick(a, kinds[name], rank, s)
            summary_cols += parts
            whole_cols.append(whole.alias(s))
        else:
            summary_cols.append(_agg(a.kind, a.value).alias(s))
            whole_cols.append(F.col(s))
        # counts of chunks add up; every other kind combines with itself
        up = "sum" if a.kind == "count" else a.kind
        if a.span == "all":
            if a.kind in ("last", "first"):
                flagged = F.when(F.col(s).isNotNull(), F.col("_chunk"))
                pick = F.max_by if a.kind == "last" else F.min_by
                carry_cols.append(pick(F.col(s), flagged).over(call).alias(c))
            else:
                carry_cols.append(_agg(up, F.col(s)).over(call).alias(c))
            out_cols.append(F.col(c).alias(name))
            continue
        # walking backwards, the nearest following value is the last one seen
        walk = "last" if a.kind in ("last", "first") else a.kind
        if a.kind in ("last", "first") and (a.kind == "first") != backward:
            raise ValueError("use last with before/upto and first with after/from")
        carry_cols.append(_agg("last" if walk == "last" else up, F.col(s))
                          .over(cdesc if backward else casc).alias(c))
        local_cols.append(_agg(walk, a.value).over(frames[a.span]).alias(loc))
        if a.kind in ("sum", "count"):
            zero = F.lit(0)
            out_cols.append((F.coalesce(F.col(loc), zero) + F.coalesce(F.col(c), zero)).alias(name))
        elif a.kind in ("min", "max"):
            out_cols.append((F.least if a.kind == "min" else F.greatest)(F.col(loc), F.col(c)).alias(name))
        else:
            out_cols.append(F.coalesce(F.col(loc), F.col(c)).alias(name))

    carry = (d.groupBy(*keys, "_chunk").agg(*summary_cols).select(*keys, "_chunk", *whole_cols)
             .select(*keys, "_chunk", *carry_cols))
    local = rows.select("*", *local_cols)
    return (local.join(carry, [*keys, "_chunk"], "left")
            .select(*[F.col(c) for c in columns if c not in aggs and c != "_chunk"], *out_cols))


FOLDED = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}


def _heads(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which another key begins."""
    change = np.zeros(max(t.num_rows - 1, 0), bool)
    for k in keys:
        code = pc.dictionary_encode(t.column(k).combine_chunks(), null_encoding="encode").indices
        change |= np.diff(code.to_numpy(zero_copy_only=False)) != 0
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def fold_chunks(summaries: DataFrame, keys: Sequence[str], fold: Callable[[pd.DataFrame], dict[str, list]], schema: str,
                order: str = "_chunk") -> DataFrame:
    """One row (keys, ``order``, columns of ``schema``) per summary: ``fold`` gets the summaries of a key in ``order``.

    A task walks through its keys in order, many to an Arrow batch; a call of pandas for each key would cost far more than the fold.
    """
    ship(summaries.sparkSession)
    keys = list(keys)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in summaries.select(*keys, order).schema)
    fields = [c.split() for c in schema.split(", ")]

    def folded(t: pa.Table, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = t.drop_columns(keys).to_pandas()
        found: dict[str, list] = {n: [] for n, _ in fields}
        for a, b in zip(heads, [*heads[1:], t.num_rows], strict=True):
            for n, values in fold(rows.iloc[a:b]).items():
                found[n].extend(values)
        out = t.select([*keys, order])
        for n, kind in fields:
            out = out.append_column(n, pa.array(found[n], FOLDED[kind], from_pandas=True))
        yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last key of a batch may go on in the next one
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            heads = _heads(t, keys)
            if heads[-1]:
                yield from folded(t.slice(0, heads[-1]), heads[:-1])
            held = t.slice(heads[-1])
        if held is not None and held.num_rows:
            yield from folded(held, np.zeros(1, int))
    return summaries.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, f"{types}, {schema}")


def decayed_sum(df: DataFrame, keys: Sequence[str], order: str, decay: float, size: int | None = None, **values: Column) -> DataFrame:
    """Add one column per value: the state s after ``s = decay * s + value`` of all rows up to this one, 0 before the first.

    ``order`` numbers the rows of a key from 1. Inside a chunk the state is a running sum of values weighted by powers of
    ``1 / decay`` (chunks are short enough for these to stay finite); a chunk maps the state it is entered in by one slope and
    offset, and these maps are composed over the chunks of a key. Nothing is cut off, for any ``decay`` from 0 to below 1.
    """
    keys = list(keys)
    if not 0 <= decay < 1:
        raise ValueError("decay must lie in [0, 1)")
    if decay == 0:
        return df.withColumns(values)
    size = max(1, min(size or CHUNK, int(250 / -math.log10(decay))))
    pos = F.expr(f"CAST(({order} - 1) % {size} AS DOUBLE)")
    d = df.withColumn("_chunk", F.expr(f"({order} - 1) DIV {size}")).withColumns({f"_v_{n}": v for n, v in values.items()})
    up, down = F.pow(F.lit(1 / decay), pos), F.pow(F.lit(decay), pos)
    whole = F.pow(F.lit(decay), size - 1 - pos)
    ends = d.groupBy(*keys, "_chunk").agg(*[F.sum(F.col(f"_v_{n}") * whole).alias(f"_e_{n}") for n in values])
    slope, names = decay ** size, list(values)

    def fold(rows: pd.DataFrame) -> dict[str, list]:
        out: dict[str, list] = {}
        for n in names:
            state, carry = 0.0, []
            for e in rows[f"_e_{n}"]:
                carry.append(state)
                state = slope * state + e
            out[f"_c_{n}"] = carry
        return out

    carry = fold_chunks(ends, keys, fold, ", ".join(f"_c_{n} double" for n in values))
    w = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = d.repartition(*keys, "_chunk").select("*", *[F.sum(F.col(f"_v_{n}") * up).over(w).alias(f"_l_{n}") for n in values])
    states = [(F.col(f"_l_{n}") * down + F.col(f"_c_{n}") * down * decay).alias(n) for n in values]
    return local.join(carry, [*keys, "_chunk"]).select(*[c for c in df.columns if c not in values], *states)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
                chunk: Column | None = None, size: int | None = None) -> DataFrame:
    """1-based position of each row inside its key."""
    return scan(df, keys, order, chunk, size, **{name: Agg("count", "upto", F.lit(1))})


def span_buckets(start: str, end: str, width: int) -> Column:
    """Bucket numbers an inclusive [start, end] span touches."""
    return F.sequence(frame_chunk(start, width), frame_chunk(end, width))


def join_in_span(rows: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str,
                 width: int = 256, how: str = "inner") -> DataFrame:
    """Rows whose ``at`` lies in [start, end] of a span with the same keys.

    Both sides meet on (keys, bucket), so a match with a third of all rows still spreads over tasks
    and only rows of the same bucket are compared.
    """
    r = rows.withColumn("_bucket", F.expr(f"CAST(FLOOR({at} / CAST({width} AS DOUBLE)) AS BIGINT)"))
    s = spans.withColumn("_bucket", F.explode(span_buckets(start, end, width)))
    for k in keys:
        s = s.withColumnRenamed(k, f"_k_{k}")
    cond = (F.col("_bucket") == F.col("_sbucket")) & (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    out = r.join(s.withColumnRenamed("_bucket", "_sbucket"), cond, how)
    return out.drop("_bucket", "_sbucket", *[f"_k_{k}" for k in keys])
