"""Exact Jaccard join of documents on distinct word shingles, by token-combination prefixes.

Tokens (shingle hashes) are ordered by (frequent, hash). A document with enough rare tokens indexes the single tokens of its
prefix: a partner that qualifies misses too few of them to share none. A document whose prefix would run into frequent tokens
extends it over all its tokens: it indexes its rare tokens singly and combinations of frequent ones. The combinations are the
document's frequent tokens that fall into the same hash class; there are more classes than two partners may differ in tokens,
so that partners agree on a whole class. Class numbers follow bands of set sizes; a document takes part in its own band and in
the one below. Where too few classes hold tokens, the prefix is indexed singly as well.

In ``ROUNDS`` rounds the members of an index entry meet one of them only, another in each round; linked ones form components.
Then the members of an entry that lie in different components are tested in blocks of about ``BLOCK`` against a bound on the
tokens in which they differ, from token counts by hash class; pairs that pass are compared exactly. No candidate is dropped
for want of room: every pair of an index entry is compared, bound to be apart, or inside one component. Families whose
members share most tokens but do not link cost the square of their size in tests of that bound, in blocks over all tasks.

Links are counted afterwards, component by component, as no link leaves one: its nodes are cut into blocks of about ``FAMILY``,
and the tokens that each node of a block shares with each node of another are counted by products of 0-1 matrices. Each pair is
compared once and exactly; only sums leave a block. A component costs the square of its size, over all tasks.

Which tokens are frequent only decides the order, never the result. A token is frequent if the counts of the chunks in which it
occurs at least twice add up to more than ``FREQUENT``; frequent tokens are kept as a bit table of fixed size, so that a token
may be taken for frequent by chance.

Equal sets are one node, named by a 64-bit digest. Null and empty texts have no shingles and are linked with nothing. Rows with
the same id count as one document of several texts: each row has its own set, and ids are only compared for the smallest of a
component. Texts are taken whole, however long; an empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallyframe.llm.stored import discard, store
from rallyframe.llm.text import ORDER_CODE, mix, shingle_sets, slices

FREQUENT, TABLE_BITS, CHUNK_TOKENS, BINS, BLOCK, ROUNDS = 24, 26, 3_000_000, 64, 1024, 3
FIRST, PAIRS = 16, 50_000
FAMILY, FAMILY_TOKENS, COLUMNS = 256, 500_000, 4096
SETS = "doc_id long, version long, n_shingles long, node long, sketch binary, signatures array<long>"


@dataclass(frozen=True)
class Rule:
    """Two sets link when 100 * intersection >= percent * union."""
    width: int = 4
    percent: int = 85

    def spare(self, n: np.ndarray | int):
        """Tokens of a set of ``n`` that a partner may lack."""
        return n - -(-self.percent * n // 100)

    def apart(self, n: np.ndarray | int, m: np.ndarray | int):
        """Tokens in which linked sets of sizes ``n`` and ``m`` may differ."""
        return (100 - self.percent) * (n + m) // (100 + self.percent)

    def bands(self, n: int) -> list[tuple[int, int]]:
        """Own band and the one below of a set of ``n``: (band, largest difference within pairs whose smaller set is in it)."""
        low, band, before = 1, 0, None
        while True:
            high = low * 100 // self.percent + 1
            most = self.apart(high - 1, (high - 1) * 100 // self.percent)
            if n < high:
                return [x for x in ((band, most), before) if x]
            low, band, before = high, band + 1, (band, most)


def text_bytes(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in texts]


def digests(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for each set, whatever its order."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(code ^ ORDER_CODE[90]))])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))


def frequent_table(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Bits of the tokens that are frequent; one bit table of fixed size."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, seen = [], 0, set()

        def chunk():
            token, count = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"token": token[count > 1].view(np.int64), "n": count[count > 1]})

        for b in batches:
            texts = text_bytes(b["text"])
            for i, j in slices(texts):
                code, at = shingle_sets(texts[i:j], rule.width)
                names = digests(code, at).tolist()
                for k, name in enumerate(names):
                    if name not in seen:
                        seen.add(name)
                        held.append(code[at[k]:at[k + 1]])
                        size += len(held[-1])
                if size > CHUNK_TOKENS:
                    yield chunk()
                    held, size, seen = [], 0, set()
        if size:
            yield chunk()

    counts = docs.select("text").mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT)
    place = F.pmod("token", F.lit(1 << TABLE_BITS))
    words = counts.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(token, {1 << TABLE_BITS}) % 64 as int))")).alias("bits"))
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    found = words.toPandas()  # at most 2 ** (TABLE_BITS - 6) rows
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return table


def is_frequent(table: np.ndarray, code: np.ndarray) -> np.ndarray:
    place = (code & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
    return (table[place >> 6] >> (place & 63)) & 1 > 0


def combined(code: np.ndarray, band: int, apart: int) -> np.ndarray:
    """One signature for each hash class that holds tokens."""
    classes = -(-5 * (apart + 1) // 4)
    own = (mix(code ^ ORDER_CODE[80]) % np.uint64(classes)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    own, code = own[order], mix(code[order] ^ ORDER_CODE[81])
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    total = np.add.reduceat(code, first) if len(first) else np.zeros(0, np.uint64)
    return mix(total + own[first].astype(np.uint64) * ORDER_CODE[82] + np.uint64(band) * ORDER_CODE[83])


def signatures(code: np.ndarray, frequent: np.ndarray, rule: Rule) -> np.ndarray:
    """Index entries of one set, whose tokens are sorted."""
    prefix = rule.spare(len(code)) + 1
    rare = code[~frequent]
    if len(rare) >= prefix:
        return rare[:prefix]
    often, out, short = code[frequent], [rare], False
    for band, apart in rule.bands(len(code)):
        own = combined(often, band, apart)
        short |= len(own) <= apart
        out.append(own)
    if short:
        out.append(often[:prefix - len(rare)])
    return np.concatenate(out)


def indexed_sets(docs: DataFrame, table: np.ndarray, rule: Rule) -> DataFrame:
    """One row per document: size and digest of its set, token counts by hash class, index entries."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column("text").to_pylist())
            for i, j in slices(texts):
                code, at = shingle_sets(texts[i:j], rule.width)
                often = is_frequent(shared.value, code)
                own = [signatures(code[a:z], often[a:z], rule) if z > a else code[:0] for a, z in zip(at[:-1], at[1:], strict=True)]
                doc = np.repeat(np.arange(j - i), np.diff(at))
                bins = np.bincount(doc * BINS + (code >> np.uint64(58)).astype(np.int64), minlength=(j - i) * BINS)
                sketch = np.minimum(bins, 255).astype(np.uint8).reshape(j - i, BINS)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[i:j].cast(pa.int64()), b.column("version")[i:j], pa.array(np.diff(at)), pa.array(digests(code, at).view(np.int64)),
                     pa.array([x.tobytes() for x in sketch], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["doc_id", "version", "n_shingles", "node", "sketch", "signatures"])
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text").mapInArrow(run, SETS)


@F.pandas_udf(T.BooleanType())
def may_link(n: pd.Series, m: pd.Series, a: pd.Series, b: pd.Series, percent: pd.Series) -> pd.Series:
    """False only for pairs that differ in more tokens than a link allows."""
    if not len(n):
        return pd.Series([], dtype=bool)
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), BINS).astype(np.int64) for s in (a, b))
    return pd.Series(np.abs(x - y).sum(1) <= Rule(percent=int(percent.iloc[0])).apart(n.to_numpy(), m.to_numpy()))


def plausible(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of nodes that pass the bounds."""
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
        if side == "b":
            pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * rule.percent)
    return pairs.where(may_link("n_a", "n_b", "s_a", "s_b", F.lit(rule.percent))).select("a", "b")


def compressed_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and the compressed text of the document that stands for it; texts are compressed before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            data = pa.array([pack.compress(t) for t in text_bytes(b.column("text").to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), data], names=["doc_id", "version", "text"])
    packed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text").mapInArrow(run, "doc_id long, version long, text binary").alias("d")
    of = nodes.select("node", "of.doc_id", "of.version").alias("n")
    found = packed.join(of, F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.version") == F.col("n.version")))
    return found.select("n.node", "d.text").dropDuplicates(["node"])


def linked(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) whose sets link, compared exactly."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, unpack = None, None, zstandard.ZstdDecompressor()
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            text_a, keep = batch.column("text_a"), []
            texts_b = [unpack.decompress(t) for t in batch.column("text_b").to_pylist()]
            for i, j in slices(texts_b):
                code, at = shingle_sets(texts_b[i:j], rule.width)
                for k in range(i, j):
                    if a[k] != now:
                        now, own = a[k], shingle_sets([unpack.decompress(text_a[k].as_py())], rule.width)[0]
                    other = code[at[k - i]:at[k - i + 1]]
                    place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    common = int((own[place] == other).sum())
                    if 100 * common >= rule.percent * (len(own) + len(other) - common):
                        keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], names=["a", "b"])
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label for every node with a link: the smallest node it reaches. Labels spread over links and along themselves until
    nothing changes; rounds grow with the logarithm of the longest chain in practice."""
    edges = store(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        better = labels.join(seen, labels.node == seen.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = better.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = store(better.join(jump, "label").select("node", F.least("label", "next").alias("label"), "old"), "labels")
        labels = new.select("node", "label")
        if new.where(F.col("label") != F.col("old")).isEmpty():
            return labels


def one_entry_each(members: DataFrame) -> DataFrame:
    """Index entries with the same members lead to the same pairs; one of them stays."""
    hashed = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    kept = members.groupBy("sig").agg(F.count("*").alias("n"), *hashed).groupBy("n", "h1", "h2").agg(F.min("sig").alias("sig")).select("sig")
    out = store(members.join(kept, "sig"), "members")
    discard(members)
    return out


def placed_in(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """sig, node, label: the entries with the component of each member."""
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))


def star_pairs(placed: DataFrame, turn: int) -> DataFrame:
    """Each member of an entry with the entry's first member in the order of this round, where their components differ."""
    order = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "label")
    heads = placed.groupBy("sig").agg(F.min(order).alias("head"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    pairs = placed.join(heads.select("sig", "head"), "sig").where(F.col("label") != F.col("head.label"))
    return pairs.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()


def pairs_across(placed: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of an entry's members in different components that the bounds let pass; members meet block by block.

    A pair shares many entries, and the one with the smallest name among them gives it: a member carries the ``FIRST`` smallest
    names of its entries, and a pair with a smaller one in common is left to that entry. Pairs whose smaller common entries
    lie beyond the first ones are given again and become one by ``distinct``; none is lost."""
    counts = placed.groupBy("sig").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    placed = placed.join(counts.select("sig", F.ceil(F.col("n") / BLOCK).alias("blocks")), "sig")
    firsts = placed.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, FIRST).alias("firsts"))
    rows = placed.join(nodes.select("node", "n_shingles", "sketch").join(firsts, "node"), "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["sig", "i", "j"]
    rows = rows.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "n_shingles", "sketch",
                       F.filter("firsts", lambda x: x < F.col("sig")).alias("smaller"))

    def met(i: int, j: int, parts: list[pd.DataFrame]) -> Iterator[tuple[int, int]]:
        rows = pd.concat(parts) if len(parts) > 1 else parts[0]
        own, node, label, size = (rows[c].to_numpy() for c in ("own", "node", "label", "n_shingles"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        able = label[left][:, None] != label[right][None, :]
        if i == j:
            able &= node[left][:, None] < node[right][None, :]
        able &= np.minimum.outer(size[left], size[right]) * 100 >= np.maximum.outer(size[left], size[right]) * rule.percent
        x, y = np.nonzero(able)
        if not len(x):
            return
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), BINS).astype(np.int16)
        near = [np.abs(sketch[right[y[k:k + PAIRS]]] - sketch[left[x[k:k + PAIRS]]]).sum(1) <= rule.apart(size[right[y[k:k + PAIRS]]], size[left[x[k:k + PAIRS]]])
                for k in range(0, len(x), PAIRS)]
        x, y = x[np.concatenate(near)], y[np.concatenate(near)]
        if not len(x):
            return
        sides = []
        for side in (left, right):
            names = [rows["smaller"].iloc[k] for k in side]
            sides.append((np.concatenate([np.zeros(0, np.int64), *names]).astype(np.int64), np.cumsum([0, *[len(n) for n in names]])))
        new = common_tokens(*sides[0], *sides[1], i == j)[x, y] == 0
        a, b = node[left[x[new]]], node[right[y[new]]]
        yield from zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts = None, []
        for b in batches:
            found: list[tuple[int, int]] = []
            own = b[keys].to_numpy()
            cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1).tolist(), len(b)] if len(b) else [0]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(own[a].tolist())
                if key != now:
                    if parts:
                        found += met(now[1], now[2], parts)
                    now, parts = key, []
                parts.append(b.iloc[a:z])
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        if parts:
            yield pd.DataFrame(list(met(now[1], now[2], parts)), columns=["a", "b"], dtype="int64")

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long").distinct()


def common_tokens(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, same: bool) -> np.ndarray:
    """How many tokens each set of one block shares with each set of another. With ``same`` the blocks are one and the counts of
    a set with itself are not to be used."""
    if same:
        found, count = np.unique(a, return_counts=True)
        shared = found[count > 1]
    else:
        shared = np.intersect1d(a, b)
    out = np.zeros((len(at_a) - 1, len(at_b) - 1), np.int64)
    if not len(shared):
        return out
    sides = []
    for code, at in ((a, at_a), (b, at_b)):
        place = np.minimum(np.searchsorted(shared, code), len(shared) - 1)
        hit = np.flatnonzero(shared[place] == code)
        order = hit[np.argsort(place[hit], kind="stable")]
        sides.append((place[order], np.repeat(np.arange(len(at) - 1), np.diff(at))[order], len(at) - 1))
    for low in range(0, len(shared), COLUMNS):
        dense = []
        for place, own, n in sides:
            i, j = np.searchsorted(place, [low, low + COLUMNS])
            part = np.zeros((n, min(COLUMNS, len(shared) - low)), np.float32)
            part[own[i:j], place[i:j] - low] = 1
            dense.append(part)
        out += (dense[0] @ dense[1].T).astype(np.int64)  # sums of at most COLUMNS ones are exact
    return out


def link_counts(labels: DataFrame, weights: DataFrame, nodes: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """node, n: the rows whose sets link with the node's, itself left out, for every node of a component."""
    members = labels.join(weights, "node").join(nodes.select("node", "n_shingles"), "node")
    sizes = members.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / FAMILY, F.sum("n_shingles") / FAMILY_TOKENS)).alias("blocks"))
    rows = members.join(sizes.where("blocks > 1"), "label", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).join(texts, "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["label", "i", "j"]
    rows = rows.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n_rows", "text")

    def counted(i: int, j: int, parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows, unpack = pd.concat(parts), zstandard.ZstdDecompressor()
        sides = []
        for own in (i, j)[:1 + (i != j)]:
            side = rows[rows["own"] == own]
            data, codes, sizes = [unpack.decompress(t) for t in side["text"]], [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
            for first, last in slices(data):
                code, at = shingle_sets(data[first:last], rule.width)
                codes.append(code)
                sizes.append(np.diff(at))
            sides.append((side["node"].to_numpy(), side["n_rows"].to_numpy(), np.concatenate(codes), np.cumsum(np.concatenate(sizes))))
        (node_a, w_a, a, at_a), (node_b, w_b, b, at_b) = sides[0], sides[-1]
        common = common_tokens(a, at_a, b, at_b, i == j)
        link = 100 * common >= rule.percent * (np.diff(at_a)[:, None] + np.diff(at_b)[None, :] - common)
        if i == j:
            np.fill_diagonal(link, False)
            return pd.DataFrame({"node": node_a, "n": link @ w_a})
        return pd.DataFrame({"node": np.concatenate([node_a, node_b]), "n": np.concatenate([link @ w_b, w_a @ link])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts = None, []
        for b in batches:
            own = b[keys].to_numpy()
            cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1).tolist(), len(b)] if len(b) else [0]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(own[a].tolist())
                if key != now:
                    if parts:
                        yield counted(now[1], now[2], parts)
                    now, parts = key, []
                parts.append(b.iloc[a:z])
        if parts:
            yield counted(now[1], now[2], parts)

    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "node long, n long")
    return found.groupBy("node").agg(F.sum("n").alias("n"))


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), count: bool = True) -> DataFrame:
    """doc_id, version (hash of the text), n_shingles, component_id (smallest doc_id reachable by links, own included) and, with
    ``count``, n_linked: the other rows whose sets link with the row's, rows of an equal set among them."""
    docs = docs.select("doc_id", "text")
    sets = store(indexed_sets(docs, frequent_table(docs, rule), rule), "sets")
    rows = store(sets.select("doc_id", "version", "n_shingles", "node"), "rows")
    first = lambda c: F.first(c).alias(c)  # noqa: E731  equal for all rows of a node
    nodes = sets.where("n_shingles > 0").groupBy("node").agg(first("n_shingles"), first("sketch"), first("signatures"), F.min(F.struct("doc_id", "version")).alias("of"))
    every = store(nodes, "every")
    discard(sets)
    entries = every.select(F.explode("signatures").alias("sig"), "node")
    shared = entries.groupBy("sig").count().where("count > 1").select("sig")
    members = one_entry_each(store(entries.join(shared, "sig"), "entries"))
    nodes = store(every.join(members.select("node").distinct(), "node", "left_semi").drop("signatures"), "nodes")
    discard(every)
    texts = store(compressed_texts(docs, nodes), "texts")

    links, labels = None, None
    for turn in range(ROUNDS + 1):
        placed = placed_in(members, labels)
        if turn < ROUNDS:
            pairs = plausible(star_pairs(placed, turn), nodes, rule)
        else:
            pairs = pairs_across(placed, nodes, rule)
        new = store(linked(pairs, texts, rule), "links")
        links = new if links is None else links.unionByName(new)
        if not new.isEmpty():
            labels = components(links)

    if labels is None:
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    tagged = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    out = ["doc_id", "version", "n_shingles", "component_id"]
    if count:
        weights = rows.where("n_shingles > 0").groupBy("node").agg(F.count("*").alias("n_rows"))
        degree = store(weights.join(link_counts(labels, weights, nodes, texts, rule), "node", "left").select(
            "node", (F.coalesce("n", F.lit(0)) + F.col("n_rows") - 1).alias("n_linked")), "degree")
        tagged = tagged.join(degree, "node", "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0)))
        out.append("n_linked")
    tagged = store(tagged.drop("node"), "tagged")
    smallest = tagged.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    some = tagged.where("n_shingles > 0").join(smallest, "label").select(*out)
    none = tagged.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).select(*out)
    return some.unionByName(none)


def jaccard_report(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id", "n_linked")


def one_of_each(docs: DataFrame, rule: Rule = Rule(width=5, percent=80)) -> DataFrame:
    """The documents without those whose component holds a smaller id; rows that repeat an id and a text stay once."""
    found = jaccard_components(docs, rule, count=False).select("doc_id", "version", "component_id").distinct().alias("c")
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "version").distinct().alias("k")
    own = docs.withColumn("__version", F.xxhash64("text")).dropDuplicates(["doc_id", "__version"]).alias("d")
    joined = own.join(keep, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.__version") == F.col("k.version")), "left_semi")
    return joined.drop("__version")
