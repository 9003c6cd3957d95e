"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions alone.

A word is a run of digits, letters and code points from 128 on; A-Z count as a-z. A block is ``BLOCK`` words of the whole text, one starts every
``STEP`` words, so that every run of up to ``BLOCK - STEP`` words lies in one. A block holds a template T if ``100 * |block and T| >= THRESHOLD * |T|``
over distinct words. The join is exact:

* only words of some template can be shared, so a block is the set of those; they are ordered by their number of occurrences in all texts, rarest first;
* length: a block needs ``need = ceil(THRESHOLD * |T| / 100)`` such words;
* prefix: a match shares a word among the first ``|T| - need + 1`` of T and among the first ``|block| - need + 1`` of the block;
* position: from a shared word on, both must still hold ``need`` words;
* what is left is compared word by word.

A text without any of these first words holds no template, so only texts with one are cut into blocks. The templates are a fixed list of known size,
which is what is broadcast; blocks have at most ``BLOCK`` words, so no group grows with the data.

Besides, the words of the fixed phrases ``PHRASES`` are found wherever they stand in a row, with their places. Null texts count as empty; empty texts have no
words, places and labels, score 0. Repeated rows are answered each. Texts are never cut off; a very long one becomes many blocks. An empty
table gives no rows. Other columns of the input are not read.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of the SQL, on lower-cased texts
# the same words in texts of any case, as ranges: Spark's engine takes ten times as long to match the complement of some
PART, GAP = r"[0-9A-Za-z\x80-\x{10FFFF}]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, STEP, THRESHOLD = 64, 32, 90

# fixed values: phrases and their labels
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# fixed values: notices and grants of well-known licenses and the labels they give
TEMPLATES = [
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org", "apache-2.0"),
    ("Released under the MIT License", "mit-notice"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit-grant"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl-grant"),
    ("GNU Lesser General Public License as published by the Free Software Foundation", "lgpl"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl-2.0"),
]


def template_rows(templates: list[tuple[str, str]]) -> list[tuple[int, str, tuple[str, ...]]]:
    """(number, label, distinct words) of each template."""
    return [(i, label, tuple(sorted(set(re.findall("[0-9a-z]+", text.lower()))))) for i, (text, label) in enumerate(templates)]


def needed(words: tuple[str, ...], threshold: int) -> int:
    return -(-threshold * len(words) // 100)


def whole(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def lowered(text: str | Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PART + "+"), F.lit(0))


def ranks(texts: DataFrame, words: list[str]) -> dict[str, int]:
    """Place of each template word in the order of all words: the rarest over all texts first, equal ones by themselves."""
    seen = texts.select(F.explode(words_of(lowered("text"))).alias("word")).where(F.col("word").isin(words))
    n = dict(seen.groupBy("word").count().collect())
    return {w: i for i, w in enumerate(sorted(words, key=lambda w: (n.get(w, 0), w)))}


def any_of(words: list[str]) -> str:
    """A pattern found in every text that holds one of ``words``, in any case."""
    return f"(?i)(?<!{PART})(?:{'|'.join(sorted(words))})(?!{PART})"


def inline(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A table of constants."""
    sql = lambda v: f"array({', '.join(map(str, v))})" if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else str(v)
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f'({", ".join(map(sql, r))})' for r in rows)} AS t({columns})")


def held_templates(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, ``version`` (hash of the text), ``block`` number, label, ``common`` and ``size``: every block that holds a template."""
    spark, texts = docs.sparkSession, whole(docs)
    rows = [r for r in template_rows(templates) if r[2]]
    place = ranks(texts, sorted({w for _, _, ws in rows for w in ws}))
    table, firsts = [], set()
    for i, label, ws in rows:
        own, need = sorted(place[w] for w in ws), needed(ws, threshold)
        prefix = own[:len(own) - need + 1]
        firsts |= set(prefix)
        table += [(r, i, label, j, need, len(own), own) for j, r in enumerate(prefix)]
    sides = inline(spark, "rank, template, label, t_at, need, size, t_words", table)
    rank = inline(spark, "word, rank", sorted(place.items()))
    least = min(needed(ws, threshold) for _, _, ws in rows)
    found = texts.where(F.col("text").rlike(any_of([w for w, r in place.items() if r in firsts])))
    words = found.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(words_of(lowered("text"))).alias("pos", "word"))
    words = words.where(F.col("word").isin(list(place))).join(F.broadcast(rank), "word")
    # a block starts every STEP words, so a word lies in BLOCK / STEP of them
    home = F.expr(f"CAST(pos DIV {STEP} AS INT)")
    block = F.explode(F.sequence(F.greatest(home - (BLOCK // STEP - 1), F.lit(0)), home)).alias("block")
    blocks = (words.select("doc_id", "version", "rank", block).groupBy("doc_id", "version", "block")
              .agg(F.sort_array(F.collect_set("rank")).alias("words")).where(F.size("words") >= least))
    prefix = blocks.select("*", F.posexplode(F.expr(f"slice(words, 1, size(words) - {least} + 1)")).alias("b_at", "rank"))
    left = F.least(F.col("size") - F.col("t_at"), F.size("words") - F.col("b_at"))
    pairs = prefix.join(F.broadcast(sides), "rank").where((F.size("words") >= F.col("need")) & (left >= F.col("need")))
    common = F.size(F.array_intersect("words", "t_words"))
    # the first shared word of a pair is the one that decides, so a pair is compared once
    once = pairs.where(F.element_at(F.array_intersect("words", "t_words"), 1) == F.col("rank"))
    return once.select("doc_id", "version", "block", "label", common.alias("common"), "size").where(F.col("common") * 100 >= F.col("size") * threshold)


def phrase_places(words: str = "words") -> Column:
    """(place, label) of each phrase in an array of words."""
    w = F.col(words)

    def at(word: Column, i: Column) -> Column:
        hit = F.lit(None).cast("string")
        for phrase, label in PHRASES.items():
            first, *rest = phrase.split()
            here = word == first
            for k, other in enumerate(rest, 1):
                here = here & (F.get(w, i + k) == other)
            hit = F.when(here, label).otherwise(hit)
        return F.struct(i.cast("long").alias("at"), hit.alias("label"))
    return F.filter(F.transform(w, at), lambda x: x["label"].isNotNull())


def license_report(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: words, places and labels of the phrases, and with them the labels of the templates its blocks hold.
    ``score`` is 1 with a phrase, else the largest share of a template held, 0 without any."""
    may = F.col("text").rlike(any_of([phrase.replace(" ", GAP) for phrase in PHRASES]))
    # only texts with a phrase are lower-cased and looked through word by word
    texts = whole(docs).select("doc_id", F.xxhash64("text").alias("version"), F.size(words_of("text")).cast("long").alias("n_words"),
                               F.when(may, words_of(lowered("text"))).alias("words"))
    no_place = F.array().cast("array<struct<at:bigint,label:string>>")
    base = texts.select("doc_id", "version", "n_words", F.coalesce(phrase_places(), no_place).alias("places"))
    held = (held_templates(docs, templates, threshold).groupBy("doc_id", "version")
            .agg(F.collect_set("label").alias("held"), F.max(F.col("common") / F.col("size")).alias("share")))
    d, h = base.alias("d"), held.alias("h")
    joined = d.join(h, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.version") == F.col("h.version")), "left")
    labels = F.array_distinct(F.col("places.label"))
    every = F.array_union(labels, F.coalesce("held", F.array().cast("array<string>")))
    listed = lambda a: F.array_join(F.array_sort(a), ",")
    return joined.select("d.doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.get("places.at", F.lit(0)).alias("first_word"),
                         F.get("places.at", F.size("places") - 1).alias("last_word"), listed(labels).alias("base_labels"), listed(every).alias("labels"),
                         F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def oracle() -> str:
    sets = ", ".join(f"({i}, '{label}', '{w}', {len(ws)})" for i, label, ws in template_rows(TEMPLATES) for w in ws)
    hits = " UNION ALL ".join(
        f"SELECT k, i - 1 AS place, '{label}' AS label FROM w WHERE " + " AND ".join(f"words[i{' + ' + str(j) if j else ''}] = '{x}'" for j, x in enumerate(p.split()))
        for p, label in PHRASES.items())
    return f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
    w AS (SELECT k, words, unnest(range(1, len(words) + 1)) AS i FROM d),
    t(template, label, word, size) AS (VALUES {sets}),
    c AS (SELECT k, i - 1 AS pos, words[i] AS word FROM w WHERE words[i] IN (SELECT word FROM t)),
    b AS (SELECT DISTINCT k, pos // {STEP} - x.back AS block, word FROM c CROSS JOIN (SELECT unnest(range(0, {BLOCK // STEP})) AS back) x WHERE pos // {STEP} >= x.back),
    m AS (SELECT k, label, count(*) AS common, any_value(size) AS size FROM b JOIN t USING (word) GROUP BY k, block, template, label HAVING 100 * count(*) >= {THRESHOLD} * any_value(size)),
    h AS (SELECT k, list(DISTINCT label) AS held, max(CAST(common AS DOUBLE) / size) AS share FROM m GROUP BY 1),
    p AS (SELECT k, count(*) AS n, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM ({hits}) GROUP BY 1)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
      coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(labels, held))), ','), '') AS labels,
      CASE WHEN n IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(share, 0) END AS score
    FROM d LEFT JOIN h USING (k) LEFT JOIN p USING (k)"""
