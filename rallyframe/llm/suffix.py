"""Removal of every byte that a repeated string of ``LENGTH`` bytes covers, with suffix arrays.

Windows of ``LENGTH`` bytes are grouped into stretches that share their smallest ``GRAM``-byte hash (the anchor), so that equal
windows have equal anchors at equal places. A stretch with its bytes is a context. Anchors that occur once are done with.
Contexts that occur more than once are repeated as a whole, whatever their windows. Of the anchors with several different
contexts, each context is laid out once in a shard of about ``SHARD_BYTES``, followed by a terminator of its own. A shard's
suffix array comes from Larsson-Sadakane refinement, its common prefixes from Kasai's pass in lockstep over the contexts;
a window is repeated if a neighbour in the array shares ``LENGTH`` bytes. An anchor with more than ``SPLIT`` contexts is dealt
over several shards; for those, each shard lists its distinct windows sorted, in ranges of digests, and windows are looked up by binary search
among the lists of the other shards.

Null and empty texts have no windows and nothing is removed. Rows that repeat an id and a text are places of their own, so
their windows repeat. Strings never reach across documents, however long these are. An empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallyframe.llm.stored import discard, store
from rallyframe.llm.text import joined, mix, powers, prefix_hash, slices, span_hash

LENGTH, GRAM = 200, 32
SHARD_BYTES, SPLIT = 2_000_000, 1000
END = 8
SPAN = "doc long, start long, stop long"
OTHER_CODE = mix(np.arange(5001, 5257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def least_in_windows(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and value of the leftmost smallest entry of every ``width`` entries in a row, by doubling."""
    at, v, span = np.arange(len(h)), h, 1
    while span < width:
        step = min(span, width - span)
        right = v[step:] < v[:-step]
        at, v = np.where(right, at[step:], at[:-step]), np.where(right, v[step:], v[:-step])
        span += step
    return at, v


def contexts(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """text number, first window, number of windows, anchor and digest of every stretch of windows with one anchor."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    buf, starts = joined(texts)
    if len(buf) < LENGTH:
        return none
    prefix = prefix_hash(buf)
    gram = np.arange(len(buf) - GRAM + 1)
    at, anchor = least_in_windows(span_hash(prefix, gram, gram + GRAM), LENGTH - GRAM + 1)
    window = np.arange(len(at))
    doc = np.searchsorted(starts, window, "right") - 1
    inside = window + LENGTH <= starts[doc + 1] - 1
    window, at, anchor, doc = window[inside], at[inside], anchor[inside], doc[inside]
    if not len(window):
        return none
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(window)]]) - 1
    digest = span_hash(prefix, window[first], window[last] + LENGTH)
    return doc[first], window[first] - starts[doc[first]], last - first + 1, anchor[first], digest


def occurrences(docs: DataFrame) -> DataFrame:
    """anchor, context (digest), doc, place (256 * first window + number of windows) of every stretch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in b.column("text").to_pylist()]
            keys = b.column("doc").to_numpy(zero_copy_only=False)
            for i, j in slices(texts):
                doc, first, n, anchor, digest = contexts(texts[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(keys[i:j][doc]), pa.array(first * 256 + n)],
                                                 names=["anchor", "context", "doc", "place"])
    return docs.select("doc", "text").mapInArrow(run, "anchor long, context long, doc long, place long")


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by Larsson-Sadakane refinement: after the first 8 bytes, only groups that are not yet sorted are
    sorted by the rank of what follows, over twice the length each time. The text's suffixes must differ within 512 bytes."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k:n + k]
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.zeros(n + 1024, np.int64)  # past the end: before everything
    rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) + 1
    depth = 8
    open_at = np.flatnonzero(~(fresh & np.concatenate([fresh[1:], [True]])))
    while len(open_at) and depth < 1024:
        group = rank[sa[open_at]]
        order = np.argsort(group << 32 | rank[sa[open_at] + depth], kind="stable")
        moved = sa[open_at][order]
        key = group[order] << 32 | rank[moved + depth]
        sa[open_at] = moved
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[moved] = np.maximum.accumulate(np.where(fresh, open_at, 0)) + 1
        open_at = open_at[~(fresh & np.concatenate([fresh[1:], [True]]))]
        depth *= 2
    return sa, rank[:n] - 1


def common_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in the array, by rank. Kasai's pass: what a suffix shares
    is at least one less than what the suffix one byte earlier shares; all contexts advance together, eight bytes at a time."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(np.uint64).ravel()
    out = np.zeros(len(text), np.int64)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    length = np.zeros(len(begin), np.int64)
    for t in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, "left"))
        i = begin[:live] + t
        r = rank[i]
        j = np.where(r > 0, sa[r - 1], len(text))
        length[:live] = np.where(r > 0, np.maximum(length[:live] - 1, 0), 0)
        going = np.flatnonzero(r > 0)
        while len(going):
            ends = np.minimum(i[going], j[going]) * 0 + np.maximum(i[going], j[going]) + length[going]
            x, y = eight[np.minimum(i[going] + length[going], len(text))], eight[np.minimum(j[going] + length[going], len(text))]
            same = (x == y) & (ends < len(text))
            length[going[same]] += 8
            rest = going[~same]
            diff = (x[~same] ^ y[~same]).astype("<u8")
            low = diff & (~diff + np.uint64(1))
            length[rest] += np.where(diff > 0, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8, 0)
            going = going[same]
        out[r] = length[:live]
    return out


def other_hash(text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A second digest of windows, independent of ``span_hash``."""
    up, down = powers(len(text) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(OTHER_CODE[text] * up[:-1])])
    return mix((total[start + LENGTH] - total[start]) * down[start])


def terminator(k: int) -> bytes:
    """``END`` bytes for each context, of values that UTF-8 does not use, so that no window reaches into one."""
    return bytes(0xF8 + (k >> 3 * d & 7) for d in range(END))


def shard_windows(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Repeated stretches of windows of a shard's contexts, and the distinct windows of split anchors."""
    rows = rows.drop_duplicates(["anchor", "context"])
    bodies = rows["body"].tolist()
    whole = np.frombuffer(b"".join(x + terminator(k) for k, x in enumerate(bodies)), np.uint8)
    size = np.array([len(x) + END for x in bodies])
    begin = np.cumsum(size) - size
    sa, rank = suffix_array(whole)
    shared = common_prefixes(whole, sa, rank, begin, size)
    long = shared >= LENGTH  # with the one before
    group = np.cumsum(~long)[rank]
    repeated = (long | np.concatenate([long[1:], [False]]))[rank]
    n = size - END - LENGTH + 1
    context = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(context)) - np.repeat(np.cumsum(n) - n, n)
    place = begin[context] + nth
    alone, split = rows["alone"].to_numpy(), rows["split"].to_numpy()
    doc, first = rows["doc"].to_numpy(), rows["place"].to_numpy() // 256
    hit = np.flatnonzero(repeated[place] & alone[context])
    spans = pd.DataFrame({"doc": doc[context[hit]], "start": first[context[hit]] + nth[hit]})
    listed = np.flatnonzero(split[context])
    _, one = np.unique(group[place[listed]], return_index=True)
    listed = listed[one]
    windows = pd.DataFrame({
        "digest": span_hash(prefix_hash(whole), place[listed], place[listed] + LENGTH).view(np.int64), "second": other_hash(whole, place[listed]).view(np.int64),
        "doc": doc[context[listed]], "start": first[context[listed]] + nth[listed], "open": alone[context[listed]] & ~repeated[place[listed]]})
    return merged_spans(spans), windows


def merged_spans(starts: pd.DataFrame) -> pd.DataFrame:
    """Runs of window starts of a document as byte spans."""
    starts = starts.sort_values(["doc", "start"])
    d, s = starts["doc"].to_numpy(), starts["start"].to_numpy()
    if not len(d):
        return pd.DataFrame({"doc": d, "start": s, "stop": s})
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(d)]]) - 1
    return pd.DataFrame({"doc": d[first], "start": s[first], "stop": s[last] + LENGTH})


LISTED = ["digest", "second", "doc", "start", "open"]


def listed(windows: pd.DataFrame, ranges: int) -> pd.DataFrame:
    """A shard's list of windows, cut into ranges of digests: one packed, sorted array for each."""
    windows = windows.sort_values(["digest", "second"])
    values = windows[LISTED].to_numpy(np.int64)
    own = (values[:, 0].view(np.uint64) // np.uint64(-(-2**64 // ranges))).astype(np.int64) if ranges > 1 else np.zeros(len(values), np.int64)
    order = np.argsort(own, kind="stable")
    own, values = own[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return pd.DataFrame({"part": own[first], "windows": [x.tobytes() for x in np.split(values, first[1:])] if len(own) else []})


def in_shards(rows: DataFrame, ranges: int) -> DataFrame:
    """Repeated spans and packed lists of windows of all shards, shard after shard in a task."""
    names = ["doc", "start", "stop", "part", "windows"]

    def both(parts: list[pd.DataFrame]) -> pd.DataFrame:
        spans, windows = shard_windows(pd.concat(parts))
        return pd.concat([spans.astype("Int64"), listed(windows, ranges)]).reindex(columns=names).astype({n: "Int64" for n in names[:4]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts = None, []
        for b in batches:
            for shard, part in b.groupby("shard", sort=False):
                if shard != now and parts:
                    yield both(parts)
                    parts = []
                now = shard
                parts.append(part)
        if parts:
            yield both(parts)
    return rows.repartition("shard").sortWithinPartitions("shard").mapInPandas(run, f"{SPAN}, part long, windows binary")


def across_shards(rows: pd.DataFrame) -> pd.DataFrame:
    """Windows of one range of digests that other shards list as well, by binary search in the sorted lists of all shards."""
    values = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, len(LISTED)) for x in rows["windows"]])
    own = values[:, :2].copy().view([("a", "i8"), ("b", "i8")]).ravel()
    union = np.sort(own)
    twice = np.searchsorted(union, own, "right") - np.searchsorted(union, own, "left") > 1
    hit = values[twice & (values[:, 4] > 0)]
    return merged_spans(pd.DataFrame({"doc": hit[:, 2], "start": hit[:, 3]}))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
def maximal(spans: pd.Series) -> pd.Series:
    """Spans of one text, merged where they touch or overlap."""
    out = []
    for own in spans:
        done: list[list[int]] = []
        for s, e in sorted((x["start"], x["stop"]) for x in own) if own is not None else []:
            if done and s <= done[-1][1]:
                done[-1][1] = max(done[-1][1], e)
            else:
                done.append([s, e])
        out.append(done)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.BinaryType())
def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, own in zip(texts, spans, strict=True):
        data, at, kept = (t or "").encode("utf-8", "replace"), 0, []
        for s, e in own if own is not None else []:
            kept.append(data[at:s])
            at = e
        out.append(b"".join([*kept, data[at:]]))
    return pd.Series(out, dtype=object)


def bodies_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The bytes of the contexts that ``asked`` lists for a document."""
    schema = "shard long, anchor long, context long, doc long, place long, alone boolean, split boolean, body binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            rows = []
            for doc, text, own in zip(b["doc"], b["text"], b["asked"], strict=True):
                data = text.encode("utf-8", "replace")
                for x in own:
                    first, n = divmod(x["place"], 256)
                    rows.append((x["shard"], x["anchor"], x["context"], doc, x["place"], x["alone"], x["split"], data[first:first + n + LENGTH - 1]))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)
    asked = asked.groupBy("doc").agg(F.collect_list(F.struct("shard", "anchor", "context", "place", "alone", "split")).alias("asked"))
    return docs.join(asked, "doc").select("doc", "text", "asked").mapInPandas(run, schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc, start, stop: byte spans that repeated windows cover; they may overlap. ``docs`` has doc (a row's key) and text."""
    every = store(occurrences(docs), "occurrences")
    again = every.groupBy("anchor").count().where("count > 1").select("anchor")
    seen = store(every.join(again, "anchor"), "repeated")
    discard(every)
    context = store(seen.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc", "place")).alias("one")), "contexts")
    whole = seen.join(context.where("n > 1").select("anchor", "context"), ["anchor", "context"])
    first = F.floor(F.col("place") / 256)
    spans = store(whole.select("doc", first.alias("start"), (first + F.col("place") % 256 + (LENGTH - 1)).alias("stop")).distinct(), "whole")
    several = context.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    several = context.join(several, "anchor").select("anchor", "context", "one.doc", "one.place", (F.col("n") == 1).alias("alone"), "m")
    several = store(several, "several")
    discard(seen)
    discard(context)
    size = several.agg(F.sum(F.col("place") % 256 + (LENGTH + END))).first()[0]
    if not size:
        return spans
    shards = -(-size // SHARD_BYTES)
    parts = F.ceil(F.col("m") / SPLIT)
    asked = several.withColumn("split", F.col("m") > SPLIT).withColumn("shard", F.pmod(F.xxhash64("anchor", F.pmod(F.xxhash64("context"), parts)), F.lit(shards)))
    found = store(in_shards(bodies_of(docs, asked), shards), "shards")
    discard(several)
    merged = found.where("windows is not null").select("part", "windows").groupBy("part").applyInPandas(across_shards, SPAN)
    return spans.unionByName(found.where("windows is null").select("doc", "start", "stop")).unionByName(merged)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, ``kept`` (remaining bytes) and ``removed``: maximal removed byte spans [start, stop] in order."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("doc", F.xxhash64("doc_id", F.xxhash64("text")))
    spans = repeated_spans(docs.where("text is not null"))
    own = spans.groupBy("doc").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    rows = docs.join(own, "doc", "left").withColumn("removed", maximal("spans"))
    return rows.select("doc_id", without("text", "removed").alias("kept"), "removed", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))


def substring_report(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
