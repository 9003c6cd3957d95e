"""Language by cross-parsing: a text is cut greedily into the longest phrases that occur in a language's training text;
the language that needs the fewest phrases, normalised by the lengths of text and training text, wins.

Each language has a suffix automaton of its training bytes, turned into a dense table whose missing moves already lead
to the state after a phrase break. Segments of many texts walk the tables of all languages in lockstep, each from the start state; then
the state in which its predecessor ends is walked into a segment until it meets the segment's own state, as after a common break, and the phrases up to there
are put right. So the phrases are those of the whole text.

The training text is a bounded sample: ``docs_per_lang`` pieces of ``piece`` characters per label. A task builds the tables and
drops them at its end. Texts are parsed whole, however long; repeated rows get equal answers, an empty table gives none. Null texts and texts without a letter are ``und``
with score 0. Ties go to the smallest label. Nothing but the text is read for a prediction.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.llm.text import slices

LETTER = re.compile(r"[^\W\d_]")
SEGMENT = 1024
FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
OUT = "lang_pred string, score double"


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, docs_per_lang: int = 96, piece: int = 400) -> tuple[tuple[str, str], ...]:
    """Labelled pieces that the driver may hold: at most ``docs_per_lang`` times ``piece`` characters per label."""
    h = F.xxhash64("doc_id", "text")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "lang", h.alias("h"), F.substring("text", F.lit(1) + F.pmod(h, F.greatest(F.length("text") - piece, F.lit(1))).cast("int"), F.lit(piece)).alias("t"))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("rn") <= docs_per_lang)
    texts: dict[str, list[str]] = {}
    for r in sorted(rows.select("lang", "rn", "t").collect()):
        texts.setdefault(r.lang, []).append(r.t)
    return tuple((lang, "\n".join(t)) for lang, t in sorted(texts.items()) if has_letter("".join(t)))


def folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(FOLD)


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class Parser:
    """The tables of all languages one after the other; an entry is twice the next state, plus one for a break."""

    def __init__(self, sample: tuple[tuple[str, str], ...]):
        data = [folded(t) for _, t in sample]
        seen = sorted(set(b"".join(data)))
        self.langs = [lang for lang, _ in sample]
        self.width = len(seen) + 1
        self.code = np.zeros(256, np.int64)
        self.code[seen] = np.arange(1, len(seen) + 1)
        self.cost = np.array([np.log2(max(2, len(d))) for d in data])
        parts, self.roots, base = [], [], 0
        for d in data:
            moves = suffix_automaton(d)
            strange = base + len(moves)  # after a byte that the training text lacks, which is a phrase by itself
            begin = np.full(self.width, strange, np.int64)
            for c, s in moves[0].items():
                begin[self.code[c]] = base + s
            table = np.tile(begin * 2 + 1, (len(moves) + 1, 1))
            table[0] = begin * 2
            for s, m in enumerate(moves):
                for c, to in m.items():
                    table[s, self.code[c]] = 2 * (base + to)
            parts.append(table.astype(np.int32))
            self.roots.append(base)
            base += len(moves) + 1
        self.table = np.concatenate(parts).ravel()

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases per language and text."""
        out = np.zeros((len(self.langs), len(texts)), np.int64)
        for a, b in slices(texts, 4_000_000):
            sizes = np.fromiter((len(t) for t in texts[a:b]), np.int64, b - a)
            codes = self.code[np.frombuffer(b"".join(texts[a:b]), np.uint8)]
            n_seg = -(-sizes // SEGMENT)
            doc = np.repeat(np.arange(b - a), n_seg)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
            start = np.repeat(np.cumsum(sizes) - sizes, n_seg) + nth * SEGMENT
            size = np.minimum(SEGMENT, sizes[doc] - nth * SEGMENT)
            order = np.argsort(-size, kind="stable")
            in_text = (start, size, nth)
            start, size, doc = start[order], size[order], doc[order]
            active = np.searchsorted(-size, -np.arange(SEGMENT), "left")
            state = np.repeat(np.array(self.roots)[:, None], len(doc), 1)
            broken = np.ones(state.shape, np.int64)
            for t in range(int(size[0]) if len(size) else 0):
                n = active[t]
                v = self.table[state[:, :n] * self.width + codes[start[:n] + t]]
                broken[:, :n] += v & 1
                state[:, :n] = v >> 1
            end = np.empty_like(state)
            end[:, order] = state
            broken += self.carried(codes, *in_text, end)[:, order]
            for k in range(len(self.langs)):
                out[k, a:b] = np.bincount(doc, broken[k], minlength=b - a)
        return out

    def carried(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, nth: np.ndarray, end: np.ndarray) -> np.ndarray:
        """What each segment's phrases change by when it is entered in the state in which its predecessor ends. ``end`` holds the states after the segments, each
        walked from the start state, and is put right where a segment never meets its own walk; such a segment's successor is walked again."""
        change, alone = np.zeros(end.shape, np.int64), end.copy()
        lang, seg = np.nonzero(np.broadcast_to(nth > 0, end.shape))
        while len(seg):
            own, true = np.array(self.roots)[lang], end[lang, seg - 1]
            more = np.full(len(seg), -1, np.int64)  # a segment's first phrase goes on from before
            live, t = np.arange(len(seg)), 0
            while len(live):
                at = codes[start[seg[live]] + t]
                u, v = self.table[own[live] * self.width + at], self.table[true[live] * self.width + at]
                more[live] += (v & 1).astype(np.int64) - (u & 1)
                own[live], true[live] = u >> 1, v >> 1
                t += 1
                live = live[(own[live] != true[live]) & (size[seg[live]] > t)]
            change[lang, seg] = more
            ends = np.where(own == true, alone[lang, seg], true)
            apart = ends != end[lang, seg]
            end[lang, seg] = ends
            after = np.minimum(seg[apart] + 1, len(nth) - 1)
            again = (seg[apart] + 1 < len(nth)) & (nth[after] > 0)
            lang, seg = lang[apart][again], after[again]
        return change

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        live = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.langs else []
        if live:
            cost = self.phrases([folded(texts[i]) for i in live]) * self.cost[:, None]
            best = cost.argmin(0)
            ranked = np.sort(cost, 0)
            sure = 1 - ranked[0] / ranked[1] if len(self.langs) > 1 else np.ones(len(live))
            for i, k, s in zip(live, best, sure, strict=True):
                langs[i], scores[i] = self.langs[k], float(s)
        return langs, scores


def parser(sample: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(sample) if sample else _Nothing()


class _Nothing(Parser):
    def __init__(self):
        self.langs = []


def predictor(sample: tuple[tuple[str, str], ...]):
    @F.pandas_udf(OUT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = parser(sample)
        for texts in batches:
            langs, scores = own.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": langs, "score": scores})
    return predict


def identify(docs: DataFrame, sample: tuple[tuple[str, str], ...]) -> DataFrame:
    """``doc_id`` and the predicted language of every text with its score (relative lead over the second best)."""
    return docs.select("doc_id", predictor(sample)("text").alias("p")).select("doc_id", "p.lang_pred", "p.score")


def language_report(docs: DataFrame) -> DataFrame:
    sample = training_sample(docs)
    return identify(docs, sample).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised; rejected are null texts and texts without a letter."""
    sample = training_sample(docs)
    marked = docs.withColumn("__lang", predictor(sample)("text").getField("lang_pred"))
    return marked.where(F.col("__lang") != "und").drop("__lang")
