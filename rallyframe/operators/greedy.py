"""Order-dependent greedy filters over chunks: what a chunk does is worked out for every state it may be entered in, and the
states are then followed from chunk to chunk. One plan for all sizes; a match of any length spreads over its chunks."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.operators.scan import CHUNK, Agg, bounded, fold_chunks, frame_chunk, scan
from rallyframe.session import pin


def islands(df: DataFrame, keys: Sequence[str], order: str, reach: int, name: str = "island",
            tie: Sequence[str] = (), size: int | None = None, **extra: Agg) -> DataFrame:
    """Add the first ``order`` value of the run in which neighbours are at most ``reach`` apart.

    Further scan aggregates can ride along in ``extra``.
    """
    def flag(d, w):
        near = F.count(F.lit(1)).over(w.rangeBetween(-reach, -1))
        return d.withColumn("_head", F.when(near == 0, F.col(order)))
    flagged = bounded(df, keys, order, reach, 0, flag, size, keep_chunk=True)
    out = scan(flagged, keys, [order, *tie], size=size,
               **{name: Agg("last", "upto", F.col("_head"))}, **extra)
    return out.drop("_head")


def debounce(df: DataFrame, keys: Sequence[str], order: str = "frame_idx", step: int = 12, size: int | None = None) -> DataFrame:
    """Keep a row when it lies at least ``step`` after the last kept row of its key.

    All that a chunk needs to know of the past is how far into it rows are still blocked: one of ``step`` numbers. Its
    summary lists for each of them the last row it would keep; folding the summaries gives every chunk its past.
    """
    keys, cols = list(keys), df.columns
    size = max(size or CHUNK, step)
    rows = pin(df.withColumn("_chunk", frame_chunk(order, size)))
    at = F.sort_array(F.collect_list(F.col(order).cast("long")))
    chunks = rows.groupBy(*keys, "_chunk").agg(at.alias("_at"))
    begin = F.col("_chunk") * size
    none = F.transform(F.sequence(F.lit(0), F.lit(step - 1)), lambda _: F.lit(None).cast("long"))
    last = F.aggregate("_at", none, lambda acc, t: F.transform(acc, lambda kept, free: F.when(
        t >= F.coalesce(kept + step, begin + free), t).otherwise(kept)))
    tables = chunks.select(*keys, "_chunk", last.alias("_last"))

    def fold(found: pd.DataFrame) -> dict[str, list]:
        past, kept = [], None
        for chunk, last in zip(found["_chunk"], found["_last"], strict=True):
            past.append(kept)
            free = 0 if kept is None else max(0, kept + step - chunk * size)
            own = last[free] if free < step else None
            kept = kept if own is None or own != own else int(own)
        return {"_past": past}

    entered = fold_chunks(tables, keys, fold, "_past long")
    first = F.array(F.coalesce(F.col("_past"), begin - step))
    kept = F.aggregate("_at", first, lambda acc, t: F.when(t - F.element_at(acc, -1) >= step, F.array_append(acc, t)).otherwise(acc))
    winners = chunks.join(entered, [*keys, "_chunk"]).select(*keys, "_chunk", F.explode(F.slice(kept, 2, size)).alias(order))
    return rows.join(winners, [*keys, "_chunk", order], "left_semi").select(*cols)


# --- suppression ----------------------------------------------------------------------------------------

OPEN, KEPT, DROPPED = 0, 1, 2


def _resolve(at: list[int], rank: list[int], rows: list[int], state: list[int], reach: int, blind: set[int]) -> list[int]:
    """Decide the open ones of ``rows``, best score first: a row falls to a kept better one within ``reach`` and stays if all better ones have
    fallen. Rows that are ``blind`` may have better neighbours that are not seen, and stay open unless a kept one is seen."""
    state = state.copy()
    for i in rows:
        if state[i] != OPEN:
            continue
        better = set()
        for near in (range(i - 1, -1, -1), range(i + 1, len(at))):
            for j in near:
                if abs(at[j] - at[i]) > reach:
                    break
                if rank[j] < rank[i]:
                    better.add(state[j])
        if KEPT in better:
            state[i] = DROPPED
        elif i not in blind and OPEN not in better:
            state[i] = KEPT
    return state


def _outcomes(at: np.ndarray, score: np.ndarray, own: np.ndarray, begin: int, end: int, reach: int) -> list[list[int] | None]:
    """For each row that may stay, with None for those that may not or are not ``own``: the cases in which it stays, or [-1] for all of them. A case is a pair of
    outer states, the place of the kept row among the ``reach`` frames before and after the chunk (0 for none), numbered ``before * (reach + 1) + after``."""
    by_score, rank = np.lexsort((at, -score)), np.empty(len(at), np.int64)
    rank[by_score] = np.arange(len(at))
    times, ranks, rows, outer = at.tolist(), rank.tolist(), by_score.tolist(), np.flatnonzero(~own).tolist()
    state = _resolve(times, ranks, rows, [OPEN] * len(times), reach, set(outer))
    cases: dict[int, list[int]] = {i: [] for i in np.flatnonzero(own).tolist() if state[i] == OPEN}
    rows = [i for i in rows if i in cases]
    for case in range((reach + 1) ** 2 if cases else 0):
        before, after = divmod(case, reach + 1)
        given = state.copy()
        for i in outer:
            given[i] = KEPT if times[i] in (begin - before, end - 1 + after) else DROPPED
        done = _resolve(times, ranks, rows, given, reach, set())
        for i, found in cases.items():
            if done[i] == KEPT:
                found.append(case)
    return [([-1] if s == KEPT else cases.get(i)) if mine else None for i, (s, mine) in enumerate(zip(state, own.tolist(), strict=True))]


def _path(chunks: list[int], edges: list[list[tuple[int, set[int]]]], reach: int, size: int) -> list[int]:
    """The case of each chunk that agrees with its neighbours. ``edges`` holds (row, cases in which it stays) for a chunk's rows near its borders."""
    if len(chunks) == 1:  # no neighbours: nothing is kept beyond either border
        return [0]
    wide = reach + 1
    pairs = range(wide * wide)

    def sides(c: int, own: list[tuple[int, set[int]]], pair: int) -> tuple[int, int]:
        kept = [t - c * size for t, cases in own if pair in cases or -1 in cases]
        return next((t + 1 for t in kept if t < reach), 0), next((size - t for t in reversed(kept) if t >= size - reach), 0)

    ways: list[dict[int, tuple[int, int, int]]] = []  # pair -> (pair of the chunk before, own first, own last)
    for n, (c, own) in enumerate(zip(chunks, edges, strict=True)):
        joined = n > 0 and chunks[n - 1] == c - 1
        found: dict[int, tuple[int, int, int]] = {}
        for pair in pairs:
            left, right = divmod(pair, wide)
            first, last = sides(c, own, pair)
            if not joined:
                if left == 0 and (n == 0 or any(p % wide == 0 for p in ways[-1])):
                    found[pair] = (next((p for p in ways[-1] if p % wide == 0), -1) if n else -1, first, last)
                continue
            for p, (_, _, before) in ways[-1].items():
                if before == left and p % wide == first:
                    found[pair] = (p, first, last)
                    break
        ways.append(found)
    pair = next(p for p in ways[-1] if p % wide == 0)
    out = []
    for found in reversed(ways):
        out.append(pair)
        pair = found[pair][0]
    return out[::-1]


def suppress(df: DataFrame, keys: Sequence[str], order: str = "frame_idx", score: str = "score", reach: int = 5, size: int | None = None) -> DataFrame:
    """Keep a row when no kept row of better score lies within ``reach`` (the earlier of equal ones is better). One row per ``order`` and key.

    Chunks decide their rows by themselves, seeing ``reach`` frames beyond their borders. The few that hang on what a neighbour
    keeps there are decided for every case: at most one row is kept within ``reach`` frames, so a border has ``reach + 1``
    states and a chunk ``(reach + 1) ** 2``. Which case holds follows from the rows near the borders alone: exactly one chain of cases agrees at all of them.
    """
    keys, cols = list(keys), df.columns
    size = max(size or CHUNK, 2 * reach)
    rows = pin(df)
    home, pos = frame_chunk(order, size), F.expr(f"pmod({order}, {size})")
    copies = F.explode(F.array_compact(F.array(home, F.when(pos >= size - reach, home + 1), F.when(pos < reach, home - 1)))).alias("_chunk")
    seen = rows.select(*keys, F.col(order).cast("long").alias("_at"), F.col(score).cast("double").alias("_score"), home.alias("_home"), copies)

    def decide(part: pd.DataFrame) -> dict[str, list]:
        at, homes = part["_at"].to_numpy(), part["_home"].to_numpy()
        c = int(part["_place"].iloc[0])
        return {"_cases": _outcomes(at, part["_score"].to_numpy(), homes == c, c * size, (c + 1) * size, reach)}

    chunks = seen.withColumn("_place", F.col("_chunk"))
    decided = pin(fold_chunks(chunks, [*keys, "_chunk"], decide, "_cases array<int>", "_at").where("_cases IS NOT NULL"))
    inside = F.expr(f"pmod(_at, {size})")
    near = F.when((inside < reach) | (inside >= size - reach), F.struct("_at", "_cases"))
    edges = decided.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(near)).alias("_edge"))

    def fold(found: pd.DataFrame) -> dict[str, list]:
        own = [[(int(e["_at"]), {int(x) for x in e["_cases"]}) for e in edge] for edge in found["_edge"]]
        return {"_case": _path([int(c) for c in found["_chunk"]], own, reach, size)}

    holds = fold_chunks(edges, keys, fold, "_case int")
    stays = F.array_contains("_cases", F.lit(-1)) | F.array_contains("_cases", F.col("_case"))
    kept = decided.join(holds, [*keys, "_chunk"]).where(stays).select(*keys, F.col("_at").alias(order))
    return rows.join(kept, [*keys, order], "left_semi").select(*cols)


def runs(df: DataFrame, keys: Sequence[str], order: str, member: str, size: int | None = None) -> DataFrame:
    """Maximal runs of consecutive ``order`` units whose rows satisfy ``member``: start, end, length."""
    keys = list(keys)
    hits = df.filter(member).select(*keys, order)
    r = islands(hits, keys, order, 1, "run_start", size=size)
    return r.groupBy(*keys, "run_start").agg(F.max(order).alias("run_end"), F.count(F.lit(1)).alias("length"))
