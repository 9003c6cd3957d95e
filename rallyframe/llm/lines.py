"""Substring dedup by line or sentence hashing: normalised units are digested, digests grouped globally, the earliest ranked occurrence stays.

The registered query takes the sentences of lines (``dedup_sentences``), as passages recur inside lines; ``dedup_lines`` takes whole lines:
A unit is a line (between line feeds) of at least ``MIN_WORDS`` words; its normal form has A-Z as a-z and single blanks. The
rank of an occurrence is (doc_id, line), null ids last. Later occurrences go, shorter lines always stay. What stays is joined
with line feeds; spans of removed lines refer to the original text in code points, ends exclusive.

Null texts have no units and stay null, empty ones stay empty. Rows that repeat an id and a text share their rank and so
their fate; with an equal id and another text, ranks tie only for equal line numbers, and tied occurrences all stay. Other
columns of the input are not read.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS = 5
UNITS = "doc_id long, version long, line int, start long, end long, digest binary"


def units_of(text: str, min_words: int) -> Iterator[tuple[int, int, int, bytes]]:
    at = 0
    for n, line in enumerate(text.split("\n")):
        words = line.encode("utf-8", "replace").lower().split()
        if len(words) >= min_words:
            yield n, at, at + len(line), hashlib.blake2b(b" ".join(words), digest_size=16).digest()
        at += len(line) + 1


def line_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per unit: document, hash of its text, line number, span and digest."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, v, *u) for d, v, t in zip(b["doc_id"], b["version"], b["text"], strict=True) for u in units_of(t, min_words)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in UNITS.split(", ")]).astype({"doc_id": "Int64"})
    return (docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text")
            .mapInPandas(run, UNITS))


@F.pandas_udf(T.StringType())
def without(texts: pd.Series, removed: pd.Series) -> pd.Series:
    out = []
    for t, lines in zip(texts, removed, strict=True):
        if lines is not None and len(lines):
            gone = set(lines)
            t = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
        out.append(t)
    return pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, kept text, and ``removed``: (line, start, end) of each removed line in order."""
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line")
    units = line_units(docs, min_words).withColumn("rank", rank)
    first = units.groupBy("digest").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    later = units.join(first, "digest").where(F.col("rank") > F.col("first"))
    gone = later.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct("line", "start", "end"))).alias("removed"))
    all_docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("version", F.xxhash64("text")).alias("d")
    gone = gone.alias("g")
    joined = all_docs.join(gone, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.version") == F.col("g.version")), "left")
    return joined.select("d.doc_id", without(F.col("d.text"), F.col("g.removed.line")).alias("text"), F.col("g.removed").alias("removed"))


def line_report(docs: DataFrame) -> DataFrame:
    gone = F.coalesce("removed", F.array().cast("array<struct<line:int,start:bigint,end:bigint>>"))
    spans = F.array_join(F.transform(gone, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return dedup_lines(docs).select("doc_id", F.size(gone).cast("long").alias("n_removed"), spans.alias("removed"), "text")


# --- sentences ------------------------------------------------------------------------------------------

SENTENCE_WORDS = 12
END = re.compile(r"([.!?][ \t]+)")
SENTENCES = "id long, is_null boolean, version long, line int, part int, start long, end long, digest binary"


def pieces_of(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """The sentences of each line as (start, end, text); together they are the line."""
    at = 0
    for line in text.split("\n"):
        own, start = [], at
        for s in END.sub(r"\1\n", line).split("\n"):
            own.append((start, start + len(s), s))
            start += len(s)
        yield own
        at += len(line) + 1


def sentences_of(text: str, min_words: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    for n, own in enumerate(pieces_of(text)):
        for k, (start, end, s) in enumerate(own):
            words = s.encode("utf-8", "replace").lower().split()
            if len(words) >= min_words:
                yield n, k, start, end, hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def kept_of(text: str, gone: set[int], every: bool, min_words: int) -> tuple[str, list[tuple[int, int]]]:
    """What stays of a text when the sentences that start at ``gone`` (or ``every`` unit) go, and their spans. A line that loses all it had goes with its line feed."""
    if every:
        gone = {u[2] for u in sentences_of(text, min_words)}
    lines, spans = [], []
    for own in pieces_of(text):
        out = [(start, end) for start, end, _ in own if start in gone and start < end]
        rest = "".join(s for start, end, s in own if not (start in gone and start < end))
        spans += out
        if rest or not out:
            lines.append(rest)
    return "\n".join(lines), spans


def keyed(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, text), with the number of rows that hold it."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("is_null"),
           F.coalesce(F.xxhash64("text"), F.lit(0)).alias("version"), F.col("text").cast("string").alias("text")]
    return docs.select(*key).groupBy("id", "is_null", "version").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))


def sentence_units(docs: DataFrame, min_words: int = SENTENCE_WORDS) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*k, *u) for *k, t in zip(b["id"], b["is_null"], b["version"], b["text"], strict=True) for u in sentences_of(t, min_words)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SENTENCES.split(", ")])
    rows = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("is_null"),
                                                        F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, SENTENCES)


def dedup_sentences(docs: DataFrame, min_words: int = SENTENCE_WORDS) -> DataFrame:
    """doc_id, ``text`` without the sentences that occur earlier, and ``removed``: (start, end) of each in order, in the original text.

    A unit is a sentence (up to blanks behind ``.``, ``!`` or ``?``, or the end of its line) of at least ``min_words`` words; the rank of an occurrence is
    (doc_id, row, sentence), null ids last. Rows that repeat an id and a text are numbered: the first is treated as if alone, all units of the others repeat
    earlier ones and go. With an equal id, another text ranks by the hash of its text. Null texts stay null, texts without units stay as they are, however long.
    """
    rank = F.struct("is_null", "id", "version", "line", "part")
    units = sentence_units(docs, min_words).withColumn("rank", rank)
    first = units.groupBy("digest").agg(F.min("rank").alias("first"), F.max("rank").alias("final")).where("first <> final").select("digest", "first")
    later = units.join(first, "digest").where(F.col("rank") > F.col("first"))
    gone = later.groupBy("id", "is_null", "version").agg(F.collect_set("start").alias("gone"))
    rows = keyed(docs).join(gone, ["id", "is_null", "version"], "left").select("*", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, null, t, starts, copy in zip(b["id"], b["is_null"], b["text"], b["gone"], b["copy"], strict=True):
                has = starts is not None and len(starts) > 0
                kept, spans = kept_of(t, set(starts) if has else set(), copy > 0, min_words) if t is not None and (has or copy) else (t, [])
                out.append((None if null else i, kept, [{"start": s, "end": e} for s, e in spans]))
            yield pd.DataFrame(out, columns=["doc_id", "text", "removed"]).astype({"doc_id": "Int64"})
    return rows.select("id", "is_null", "text", "gone", "copy").mapInPandas(run, "doc_id long, text string, removed array<struct<start:long,end:long>>")


def sentence_report(docs: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return dedup_sentences(docs).select("doc_id", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"), "text")


def oracle() -> str:
    return f"""
    WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
               FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, n, string_split(regexp_replace(line, '([.!?][ \t]+)', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM l),
    u AS (SELECT doc_id, n, unnest(parts) AS s, generate_subscripts(parts, 1) AS k, len(parts) AS parts FROM p),
    o AS (SELECT *, CAST(sum(length(s) + CAST(k = parts AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n, k) AS BIGINT) - length(s) - CAST(k = parts AS INTEGER) AS begins FROM u),
    w AS (SELECT *, string_split(trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\v\f\r]+', ' ', 'g')), ' ') AS words FROM o),
    k AS (SELECT *, len(words) >= {SENTENCE_WORDS} AND row_number() OVER (PARTITION BY words ORDER BY doc_id, n, k) > 1 AS gone FROM w),
    r AS (SELECT doc_id, n, count(*) FILTER (gone) AS n_gone, string_agg(begins || ':' || (begins + length(s)), ',' ORDER BY k) FILTER (gone) AS spans,
                 coalesce(string_agg(s, '' ORDER BY k) FILTER (NOT gone), '') AS rest FROM k GROUP BY 1, 2),
    g AS (SELECT doc_id, CAST(sum(n_gone) AS BIGINT) AS n_removed, coalesce(string_agg(spans, ',' ORDER BY n), '') AS removed,
                 coalesce(string_agg(rest, chr(10) ORDER BY n) FILTER (rest <> '' OR n_gone = 0), '') AS text FROM r GROUP BY 1)
    SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, g.text FROM documents d LEFT JOIN g USING (doc_id)"""
