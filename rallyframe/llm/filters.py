"""Filter interaction audit: what each of five filters removes, alone and behind the others, in every order.

One table-driven pass over the UTF-8 bytes of a batch: ``KIND`` maps a byte to its class, ``NEXT`` a class to the state behind
it (between words or inside one: the state depends on the last byte alone, so all steps of a batch are looked up at once), and
``EMIT`` a state and a class to what the step counts: word begins, word ends, capital, code point, symbol. The word spans go
into a hash table (open addressing) in which two spans are one word only if their bytes are equal, so the number of distinct words is exact.

Filters: A fewer than ``MIN_WORDS`` words, B ``100 * distinct words < DISTINCT * words``, C ``100 * capitals > CAPITALS * code
points``, D a symbol of ``#$%&*|``, E the text of a smaller doc_id. A null text counts as empty. Rows with a null doc_id never
fail E and are nobody's smaller doc_id; of repeated rows (equal id and text) none fails by the other; with equal ids and other texts each row counts
for itself. A document is good or toxic if any row of ``labels`` says so. Null and empty lang are one part, the empty string. An empty table has
no parts and so no rows. Texts longer than ``text.SLICE_BYTES`` are read in pieces cut between words; the words of such a text meet in a set of bytes.
Other columns of the inputs are not read.

The counts of a part are those of its 32 failure patterns, so documents are reduced to (part, pattern, labels) on the map side and an order
costs 32 additions, whatever the number of documents. A group of equal texts is decided from one row per (part, labels) and its smallest id.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.llm.spans import runs
from rallyframe.llm.text import SPACE, joined, mix, prefix_hash, span_hash

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT, CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"

BLANK, CAPITAL, SYMBOL, OTHER, FOLLOWING = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[SPACE] = BLANK
KIND[65:91] = CAPITAL
KIND[list(SYMBOLS)] = SYMBOL
KIND[128:192] = FOLLOWING
NEXT = np.array([0, 1, 1, 1, 1], np.uint8)
BEGINS, ENDS, IS_CAPITAL, IS_POINT, IS_SYMBOL = (1 << i for i in range(5))
EMIT = np.zeros((2, 5), np.uint8)
EMIT[:, CAPITAL] |= IS_CAPITAL
EMIT[:, SYMBOL] |= IS_SYMBOL
EMIT[:, :FOLLOWING] |= IS_POINT
EMIT[0, 1:] |= BEGINS
EMIT[1, BLANK] |= ENDS

WORD_BYTES = 8
TAIL = np.array([(1 << 8 * n) - 1 for n in range(WORD_BYTES)] + [2 ** 64 - 1], np.uint64)
LOOKED_AT_ONCE = 64


def transduce(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each byte emits, and start and end of every word. The last byte is a blank."""
    kind = KIND[buf]
    state = np.zeros(len(buf), np.uint8)
    state[1:] = NEXT[kind[:-1]]
    out = EMIT[state, kind]
    return out, np.flatnonzero(out & BEGINS), np.flatnonzero(out & ENDS)


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` bytes at ``a`` and at ``b`` are equal. ``buf`` has eight bytes to spare."""
    view = np.lib.stride_tricks.sliding_window_view(buf, WORD_BYTES)
    load = lambda at: np.ascontiguousarray(view[at]).view("<u8").ravel()
    equal, left = np.ones(len(a), bool), np.arange(len(a))
    for k in range(0, LOOKED_AT_ONCE, WORD_BYTES):
        left = left[size[left] > k]
        if not len(left):
            return equal
        rest = np.minimum(size[left] - k, WORD_BYTES)
        ok = (load(a[left] + k) ^ load(b[left] + k)) & TAIL[rest] == 0
        equal[left[~ok]] = False
        left = left[ok]
    for i in left[size[left] > LOOKED_AT_ONCE]:
        equal[i] = buf[a[i]:a[i] + size[i]].tobytes() == buf[b[i]:b[i] + size[i]].tobytes()
    return equal


def first_of_each(buf: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Insert all word spans into a hash table and name those that found no equal word of their document in it."""
    n = len(first)
    if not n:
        return np.zeros(0, np.int64)
    spare = np.concatenate([buf, np.zeros(WORD_BYTES, np.uint8)])
    size = last - first
    h = mix(span_hash(prefix_hash(buf), first, last) + mix(doc.astype(np.uint64)))
    mask = (1 << (4 * n - 1).bit_length()) - 1
    slot = (h & np.uint64(mask)).astype(np.int64)
    table, new, open_ = np.full(mask + 1, -1, np.int64), np.zeros(n, bool), np.arange(n)
    while len(open_):
        at = slot[open_]
        free = table[at] < 0
        table[at[free][::-1]] = open_[free][::-1]
        held = table[at]
        own = held == open_
        new[open_[own]] = True
        found = own.copy()
        maybe = np.flatnonzero(~own & (doc[held] == doc[open_]) & (size[held] == size[open_]) & (h[held] == h[open_]))
        found[maybe] = same_bytes(spare, first[held[maybe]], first[open_[maybe]], size[open_[maybe]])
        open_ = open_[~found]
        slot[open_] = (slot[open_] + 1) & mask
    return np.flatnonzero(new)


def counts(texts: list[bytes]) -> np.ndarray:
    """Words, distinct words, capitals, code points and symbols of each text."""
    out = np.zeros((len(texts), 5), np.int64)
    seen: dict[int, set[bytes]] = {}

    def add(column: int, of: np.ndarray) -> None:
        out[:, column] += np.bincount(of, minlength=len(texts))

    for own, parts, whole in runs(texts, SPACE):
        buf, starts = joined(parts)
        own = np.array(own)
        emitted, first, last = transduce(buf)
        of = lambda at: own[np.searchsorted(starts, at, "right") - 1]
        doc = of(first)
        add(0, doc)
        distinct = first_of_each(buf, doc, first, last)
        if whole:
            add(1, doc[distinct])
        else:
            seen.setdefault(own[0], set()).update(buf[first[i]:last[i]].tobytes() for i in distinct)
        add(2, of(np.flatnonzero(emitted & IS_CAPITAL)))
        add(3, of(np.flatnonzero(emitted & IS_POINT)))
        out[own, 3] -= 1  # the line feed that joined() puts behind each part
        add(4, of(np.flatnonzero(emitted & IS_SYMBOL)))
    for i, words in seen.items():
        out[i, 1] = len(words)
    return out


FEATURES = "doc_id long, part string, digest binary, n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long"


def text_features(docs: DataFrame) -> DataFrame:
    """One row per document: part, digest of the text and what the transducer counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            n = counts(texts)
            digests = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), digests, *[pa.array(n[:, i]) for i in range(5)]],
                                             names=[c.split()[0] for c in FEATURES.split(", ")])
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty("lang").alias("part"), empty("text").alias("text")).mapInArrow(run, FEATURES)


def failure_patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part, failure pattern (bit i: fails filter i), good and toxic."""
    fails = [F.col("n_words") < MIN_WORDS, F.col("n_distinct") * 100 < F.col("n_words") * DISTINCT,
             F.col("n_capitals") * 100 > F.col("n_points") * CAPITALS, F.col("n_symbols") > 0]
    pattern = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    rows = text_features(docs).groupBy("digest", "part", pattern.alias("pattern"), "doc_id").agg(F.count(F.lit(1)).alias("n"))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = rows.join(said, "doc_id", "left").select("digest", "part", "pattern", "doc_id", "n", no("good"), no("toxic"))
    known = F.col("doc_id").isNotNull()
    groups = rows.groupBy("digest", "part", "pattern", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_known"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    copies = F.col("n_known") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    groups = groups.withColumn("least", least).withColumn("copies", copies)
    both = F.explode(F.array(F.struct(F.col("pattern").alias("pattern"), (F.col("n") - F.col("copies")).alias("n")),
                             F.struct((F.col("pattern") + 16).alias("pattern"), F.col("copies").alias("n")))).alias("x")
    split = groups.select("part", "good", "toxic", both).select("part", "x.pattern", "good", "toxic", F.col("x.n").alias("n"))
    return split.groupBy("part", "pattern", "good", "toxic").agg(F.sum("n").alias("n"))


AUDIT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
         "good_lost long, toxic_lost long, shapley long")


def audit_part(rows: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part from its at most 128 pattern counts."""
    n = np.zeros((32, 2, 2), np.int64)
    np.add.at(n, (rows["pattern"].to_numpy(), rows["good"].to_numpy().astype(int), rows["toxic"].to_numpy().astype(int)), rows["n"].to_numpy())
    every, good, toxic = n.sum(axis=(1, 2)), n[:, 1].sum(axis=1), n[:, :, 1].sum(axis=1)
    pattern = np.arange(32)
    failed = np.array([bin(p).count("1") for p in pattern])
    orders = 120 // np.maximum(failed, 1)  # in how many orders each of the failed filters comes first
    shapley = [int((every * orders)[(pattern >> f) & 1 == 1].sum()) for f in range(5)]
    out = []
    for order in permutations(range(5)):
        before = 0
        for step, f in enumerate(order, 1):
            fails, gone = (pattern >> f) & 1 == 1, pattern & before != 0
            here = fails & ~gone
            before |= 1 << f
            out.append((rows["part"].iloc[0], "".join(FILTERS[i] for i in order), step, every[pattern & before == 0].sum(), every[here].sum(),
                        every[fails & gone].sum(), every[1 << f], good[here].sum(), toxic[here].sum(), shapley[f]))
    return pd.DataFrame(out, columns=[c.split()[0] for c in AUDIT.split(", ")])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return failure_patterns(docs, labels).groupBy("part").applyInPandas(audit_part, AUDIT)


def oracle() -> str:
    word = r"[^\x20\x09-\x0D]+"
    return f"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '{word}') AS words FROM t),
    s AS (SELECT doc_id, max(CAST(coalesce(quality = 1, FALSE) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, FALSE) AS INTEGER)) AS toxic FROM labels GROUP BY 1),
    f AS (SELECT part, len(words) < {MIN_WORDS} AS a, 100 * len(list_distinct(words)) < {DISTINCT} * len(words) AS b,
                 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITALS} * len(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
                 coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), FALSE) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
          FROM w LEFT JOIN s ON s.doc_id = w.doc_id),
    p AS (SELECT part, CAST(a AS INTEGER) + 2 * CAST(b AS INTEGER) + 4 * CAST(c AS INTEGER) + 8 * CAST(d AS INTEGER) + 16 * CAST(e AS INTEGER) AS pattern,
                 count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
    o AS (SELECT v.x || w.x || y.x || z.x || u.x AS filter_order, [v.bit, w.bit, y.bit, z.bit, u.bit] AS bits FROM l v, l w, l y, l z, l u
          WHERE v.bit + w.bit + y.bit + z.bit + u.bit = 31 AND len(list_distinct([v.bit, w.bit, y.bit, z.bit, u.bit])) = 5),
    k AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step, bits FROM o),
    j AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM k),
    r AS (SELECT part, filter_order, step, any_value(bit) AS bit, coalesce(sum(n) FILTER (pattern & (before | bit) = 0), 0) AS kept,
            coalesce(sum(n) FILTER (pattern & bit > 0 AND pattern & before = 0), 0) AS removed, coalesce(sum(n) FILTER (pattern & bit > 0 AND pattern & before > 0), 0) AS redundant,
            coalesce(sum(n) FILTER (pattern = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (pattern & bit > 0 AND pattern & before = 0), 0) AS good_lost,
            coalesce(sum(toxic) FILTER (pattern & bit > 0 AND pattern & before = 0), 0) AS toxic_lost FROM p CROSS JOIN j GROUP BY 1, 2, 3)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
      CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""
