"""Mixing sources to target weights, with DataFrame functions only.

The words of each source, its documents one after the other, are packed into blocks of ``BLOCK`` words. The output has as many
slots as blocks it takes, in shards of ``SHARD`` slots. Each slot of a shard draws a source with probability in proportion to
the source's slots, so that the source counts of a shard are multinomial; slots drawn beyond a source's quota go to sources
that fell short, so that each source ends with exactly its quota. The k-th slot of a source takes the block to which the
permutation of its current pass maps k: a swap-or-not shuffle of the block numbers, a bijection for any number of blocks.
Slots and blocks meet by (source, block).

Positions in a source come from running sums over parts of about ``PART`` rows and their totals, so that a source that holds
a third of all rows is no task of its own. Sources get weights 1, 2, 3, repeating, by code point with null last; targets share
the total size by weight, stop at ``MOST`` times the source's size, and the excess is shared again.

Null texts have no words; documents without words are listed and take nothing. Repeated rows are documents of their own. Texts
are counted whole, however long. An empty table gives an empty result. Other columns of the input are not read. The draws depend on ``SEED`` only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.session import pin

BLOCK, SHARD, PART, MOST, ROUNDS, SEED = 64, 4096, 4096, 3, 24, 7
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source: number, size, target, blocks and the quota of slots."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    src = src.withColumn("src", F.row_number().over(order)).withColumn("w", (F.col("src") - 1) % 3 + 1).withColumn("most", F.col("source_size") * MOST)
    # filled from the source that reaches its most at the lowest level upwards
    up = Window.orderBy(F.col("most") / F.col("w"), "src")
    before = F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.sum("source_size").over(everything) - before) / F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("full", F.col("most") / F.col("w") <= level)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0))
    share = rest / F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    src = src.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share * F.col("w")))
    src = src.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK)).withColumn(
        "quota", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.col("blocks") * MOST)).otherwise(F.lit(0)).cast("long"))
    return src.withColumn("from_slot", F.sum("quota").over(Window.orderBy("src")) - F.col("quota")).select("source", "src", "source_size", "target", "blocks", "quota", "from_slot")


def positions(sizes: DataFrame, rows: int) -> DataFrame:
    """``first``: the position of a document's first word among the words of its source."""
    parts = max(1, -(-rows // PART))
    cut = sizes.withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.lit(parts)))
    totals = cut.groupBy("src", "part").agg(F.sum("size").alias("total"))
    totals = totals.withColumn("base", F.sum("total").over(Window.partitionBy("src").orderBy("part")) - F.col("total")).drop("total")
    own = Window.partitionBy("src", "part").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("within", F.sum("size").over(own) - F.col("size"))
    return cut.join(totals, ["src", "part"]).withColumn("first", F.col("base") + F.col("within")).drop("part", "base", "within")


def within_interval(rows: DataFrame, value: str, intervals: DataFrame, total: int, n: int) -> DataFrame:
    """Join each row to the interval [lo, hi) that holds ``value``: both sides meet by the number of a stretch."""
    step = max(1, total // (4 * max(1, n)))
    spread = intervals.where("hi > lo").withColumn("stretch", F.explode(F.sequence((F.col("lo") / step).cast("long"), ((F.col("hi") - 1) / step).cast("long"))))
    return rows.withColumn("stretch", (F.col(value) / step).cast("long")).join(spread, "stretch").where((F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi"))).drop("stretch", "lo", "hi")


def permuted(index: Column, n: Column, *seeds: Column) -> Column:
    """Where the swap-or-not shuffle of 0 .. n - 1 keyed by ``seeds`` sends ``index``."""
    def one_round(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), *seeds, r), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, other), *seeds, r, F.lit(SEED)) % 2 == 0, x).otherwise(other)
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index.cast("long"), one_round)


def drawn_slots(src: DataFrame, slots: int, n_sources: int) -> DataFrame:
    """shard, slot, src, k: the source of each slot and its number among the source's slots."""
    spark = src.sparkSession
    draw = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") / SHARD).cast("long").alias("shard"), F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(slots)).alias("r"))
    intervals = src.select("src", F.col("from_slot").alias("lo"), (F.col("from_slot") + F.col("quota")).alias("hi"))
    draw = within_interval(draw, "r", intervals, slots, n_sources).drop("r")
    counts = draw.groupBy("src", "shard").agg(F.count("*").alias("n"))
    counts = pin(counts.withColumn("base", F.sum("n").over(Window.partitionBy("src").orderBy("shard")) - F.col("n")))
    draw = draw.withColumn("nth", F.row_number().over(Window.partitionBy("src", "shard").orderBy("slot")) - 1)
    draw = draw.join(counts.drop("n"), ["src", "shard"]).withColumn("k", F.col("base") + F.col("nth")).select("shard", "slot", "src", "k")

    drawn = counts.groupBy("src").agg(F.sum("n").alias("drawn"))
    order = Window.orderBy("src")
    state = src.join(drawn, "src", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    state = state.withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0))).withColumn("short", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))
    state = state.withColumn("from_over", F.sum("over").over(order) - F.col("over")).withColumn("from_short", F.sum("short").over(order) - F.col("short"))
    known = draw.join(state.select("src", "quota", "from_over"), "src")
    kept = known.where("k < quota").select("shard", "slot", "src", "k")
    spare = known.where("k >= quota").select("shard", "slot", (F.col("from_over") + F.col("k") - F.col("quota")).alias("j"))
    takers = state.select(F.col("src"), F.col("drawn"), F.col("from_short"), F.col("from_short").alias("lo"), (F.col("from_short") + F.col("short")).alias("hi"))
    moved = within_interval(spare, "j", takers, slots, n_sources).select("shard", "slot", "src", (F.col("drawn") + F.col("j") - F.col("from_short")).alias("k"))
    return kept.unionByName(moved)


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, source, ``row``: hash of the text) with size, source_size, target and place (src, first), and the
    pieces of the mix: shard, slot, pass, block, place of the document, first word in it (from 0) and number of words."""
    sizes = pin(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("row")))
    src = pin(source_targets(sizes))
    found = src.agg(F.sum("quota").alias("slots"), F.count("*").alias("n")).first()
    all_docs = sizes.join(src.select(F.col("source").alias("s"), "src", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = pin(positions(all_docs, sizes.count()))
    slots = drawn_slots(src, found.slots or 0, found.n).join(src.select("src", "blocks"), "src")
    turn = (F.col("k") / F.col("blocks")).cast("long")
    slots = slots.withColumn("pass", turn).withColumn("block", permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.col("src"), F.col("pass")))
    begin, end = F.col("first"), F.col("first") + F.col("size")
    cut = placed.where("size > 0").select("src", "row", "first", "size", F.explode(F.sequence((begin / BLOCK).cast("long"), ((end - 1) / BLOCK).cast("long"))).alias("block"))
    low, high = F.greatest(begin, F.col("block") * BLOCK), F.least(end, (F.col("block") + 1) * BLOCK)
    cut = cut.select("src", "block", "row", "first", (low - begin).alias("first_word"), (high - low).alias("words"))
    pieces = slots.select("shard", "slot", "pass", "src", "block").join(cut, ["src", "block"])
    return placed, pieces


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes."""
    placed, pieces = mix(docs)
    taken = pieces.groupBy("src", "first").agg(F.sum("words").alias("taken"))
    with_words = placed.where("size > 0").join(taken, ["src", "first"], "left")
    without = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return with_words.select(*cols).unionByName(without.select(*cols))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row per document and pass that takes some of it, with the columns of the input. The text is
    the document's own where the pass takes all its words, else the taken stretches with line feeds between them."""
    placed, pieces = mix(docs)
    taken = pieces.groupBy("src", "first", "pass").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("first_word", "words"))).alias("parts"))
    taken = placed.where("size > 0").join(taken, ["src", "first"]).select("doc_id", "source", "row", "size", "taken", "parts").alias("m")
    own = Window.partitionBy("row", "doc.doc_id", "doc.source").orderBy("row")
    whole = docs.select(F.struct(*docs.columns).alias("doc")).withColumn("row", F.xxhash64("doc.text"))
    whole = whole.withColumn("copy", F.row_number().over(own)).where("copy = 1").alias("d")
    rows = taken.join(whole, (F.col("m.row") == F.col("d.row")) & F.col("m.doc_id").eqNullSafe(F.col("d.doc.doc_id")) & F.col("m.source").eqNullSafe(F.col("d.doc.source")))
    tokens = F.regexp_extract_all("doc.text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = lambda t: F.transform("parts", lambda p: F.array_join(F.slice(t, (p["first_word"] + 1).cast("int"), p["words"].cast("int")), ""))
    # a bound variable: the words are found once for a row, not once for each part
    runs = F.transform(F.array(tokens), cut)[0]
    rows = rows.withColumn("new_text", F.when(F.col("taken") == F.col("size"), F.col("doc.text")).otherwise(F.array_join(runs, "\n")))
    new = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
