"""Filter audit, ranked search and license scans against plain Python on small tables with odd rows."""
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rallyframe.llm import filters, licenses, ranking, spans
from rallyframe.llm.text import SPACE
from rallyframe.session import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, pattern int, words string, label string, item_id long, rank int, n long"
ODD = ["", None, " \n\t ", "é", "über straße ünï 😀😀 x😀y", "a" * 70 + " " + "a" * 70 + " " + "a" * 71, "Word word WORD word", "x$y", "  no break", "w " * 150,
       " ".join(f"w{i}" for i in range(120)), "CAPS ONLY HERE", "tab\tfeed\x0bform\x0c end\x1f stays"]


@pytest.fixture(scope="module")
def sp(spark):
    ship(spark)
    return spark


def docs_of(sp, rows):
    return sp.createDataFrame([(i, t, lang, "s", 1, "p", 3, "w", "l", 9, 2, 5) for i, t, lang in rows], DOCS)


def random_texts(rng, n):
    vocab = ["the", "of", "Stone", "river", "Blue", "runs", "#tag", "café", "a|b", "X", "yz" * 40]
    return [rng.choice(ODD) if rng.random() < 0.3 else rng.choice([" ", "\n"]).join(rng.choice(vocab) + str(rng.randint(0, 9)) * rng.randint(0, 1) for _ in range(rng.randint(0, 160))) for _ in range(n)]


# --- filter audit ---------------------------------------------------------------------------------------

def features(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(w), len(set(w)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text)


@pytest.mark.parametrize("limit", [16, 500_000])
def test_transducer_counts(monkeypatch, limit):
    monkeypatch.setattr(spans.runs, "__defaults__", (limit,))
    texts = [t or "" for t in random_texts(random.Random(3), 80) + ODD]
    got = filters.counts([t.encode() for t in texts])
    assert [tuple(map(int, r)) for r in got] == [features(t) for t in texts]


def test_hash_table_verifies_bytes(monkeypatch):
    monkeypatch.setattr(filters, "span_hash", lambda p, a, b: np.zeros(len(a), np.uint64))  # every word collides
    texts = ["aa ab aa ba " + "q" * 65 + "r " + "q" * 65 + "s", "aa"]
    assert list(filters.counts([t.encode() for t in texts])[:, 1]) == [5, 1]


def test_pieces_of_a_long_text_end_between_words():
    text = b"one two  three" + b"x" * 50 + b" four"
    parts = list(spans.cut(text, SPACE, 6))
    assert b"".join(parts) == text and sum(len(p.split()) for p in parts) == len(text.split())
    assert list(spans.cut(b"", SPACE, 6)) == []


def audit_want(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}  # a null id matches no label
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w, u, c, p, s = features(t)
        fails = {f for f, x in zip("ABCDE", (w < 100, 100 * u < 80 * w, 100 * c > 10 * p, s > 0, i is not None and i > first[t]), strict=True) if x}
        parts[lang or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[0]]
                shapley[f] += len(here)
                fails = sum(f in d[0] for d in docs)
                left = [d for d in left if f not in d[0]]
                out[part, "".join(order), step] = [len(left), len(here), fails - len(here), sum(d[0] == {f} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here), f]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = shapley[v[-1]]
    return out


def test_filter_audit(sp):
    rng = random.Random(5)
    rows = [(rng.choice([i, i, i, 7, None]), t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(random_texts(rng, 150))]
    rows += rows[:20]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(100)] + [(7, 1, 1), (None, 1, 1), (3, 1, 0)]
    got = filters.filter_audit(docs_of(sp, rows).repartition(7), sp.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    cols = got.columns
    assert {tuple(r[:3]): list(r[3:]) for r in got.collect()} == audit_want(rows, labels)
    assert cols == [c.split()[0] for c in filters.AUDIT.split(", ")]
    none = sp.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.filter_audit(docs_of(sp, []), none).count() == 0
    assert filters.filter_audit(docs_of(sp, rows), none).count() == 3 * 600


# --- ranked search --------------------------------------------------------------------------------------

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def rank_want(rows, items, top):
    docs = [(i, Counter(terms(t))) for i, t, _ in rows]
    n_docs, length = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()}
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for i, c in docs:
            n = sum(c.values())
            m = 50 + 50 * n * n_docs // max(length, 1)
            s = sum(weight[w] * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("docs_a_block, cells, slice_terms", [(8192, 10 ** 6, 1 << 18), (9, 10 ** 6, 40), (64, 30, 1)])
def test_ranked_search(sp, monkeypatch, docs_a_block, cells, slice_terms):
    monkeypatch.setattr(ranking, "SLICE_TERMS", slice_terms)
    rng = random.Random(8)
    texts = random_texts(rng, 90)
    rows = [(rng.choice([i, i, i, 4, None]), t, "en") for i, t in enumerate(texts)]
    rows += rows[:30]
    items = [(k, rng.choice(texts)) for k in range(6)] + [(1, "the river"), (20, None), (21, ""), (22, "nothing like it"), (0, "the of stone")] * 2
    sp.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5" if docs_a_block < 100 else "512")
    got = ranking.ranked_search(docs_of(sp, rows).repartition(3), sp.createDataFrame(items, "item_id long, text string"), 7, (docs_a_block, cells))
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == rank_want(rows, items, 7)
    sp.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def test_blocks_are_bounded_and_whole():
    import pyarrow as pa
    batches = [pa.RecordBatch.from_arrays([pa.array([3 * i + 2, None, 3 * i], pa.int64()), pa.array([4, 5, 6]), pa.array([[1, 2], [], [3]], pa.list_(pa.int32())),
                                           pa.array([[1, 1], [], [9]], pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"]) for i in range(2000 * 2)]
    got = list(ranking.blocks(iter(batches)))
    assert all(len(b[0]) <= ranking.BLOCK_DOCS for b in got) and sum(len(b[0]) for b in got) == 12000
    ids, null, n, doc, term, tf = got[0]
    assert not null[:-1 - null.sum()].any() and (np.diff(ids[~null]) > 0).all() and set(n[null]) == {5}
    assert set(n[doc[tf == 9]]) == {6} and set(n[doc[term == 2]]) == {4}


def test_treap_search_equals_sums():
    rng = np.random.default_rng(1)
    for _ in range(60):
        r, c = int(rng.integers(1, 40)), int(rng.integers(1, 80))
        m = (rng.random((r, c)) < rng.choice([0.05, 0.3, 0.9])) * rng.integers(1, rng.choice([3, 1000]), (r, c))
        row, col = np.nonzero(m)
        if not len(row):
            continue
        treap = ranking.Treap(row, col, m[row, col].astype(np.int64), r, c)
        own, k = np.sort(rng.choice(r, int(rng.integers(1, r + 1)), replace=False)), int(rng.choice([1, 5, 50]))
        s = m[own].sum(axis=0)
        want = sorted(((int(v), i) for i, v in enumerate(s) if v > 0), key=lambda x: (-x[0], x[1]))
        assert sorted(treap.best(own, k), key=lambda x: (-x[0], x[1])) == want[:k]
        worst = (int(rng.integers(0, s.max() + 1)), int(rng.integers(0, c)))
        assert sorted(treap.best(own, k, worst), key=lambda x: (-x[0], x[1])) == [x for x in want if (x[0], -x[1]) > (worst[0], -worst[1])][:k]


def test_treap_leaves_most_ranges_unread(monkeypatch):
    rng = np.random.default_rng(2)
    m = np.where(rng.random((8, 4096)) < 0.5, rng.integers(1, 100, (8, 4096)), 0)
    m[:, 1000:1004] = 10_000
    row, col = np.nonzero(m)
    treap = ranking.Treap(row, col, m[row, col], 8, 4096)
    pushed = []
    push = ranking.heapq.heappush
    monkeypatch.setattr(ranking.heapq, "heappush", lambda h, x: (pushed.append(1), push(h, x)))
    assert {c for _, c in treap.best(np.arange(8), 4)} == {1000, 1001, 1002, 1003} and len(pushed) < 8191 / 8  # of 8191 ranges


# --- license scans --------------------------------------------------------------------------------------

def license_want(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    held, share = set(), 0.0
    for start in range(0, max(len(w), 1), licenses.STEP):
        block = set(w[start:start + licenses.BLOCK])
        for _, label, ws in licenses.template_rows(licenses.TEMPLATES):
            n = len(block & set(ws))
            if 100 * n >= licenses.THRESHOLD * len(ws):
                held.add(label)
                share = max(share, n / len(ws))
    base = {label for _, label in places}
    return (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | held)),
            1.0 if places else share)


def test_license_scans(sp):
    rng = random.Random(4)
    texts = list(ODD)
    for _ in range(120):
        t = rng.choice(licenses.TEMPLATES)[0].split()
        if rng.random() < 0.6:
            rng.shuffle(t)
        for _ in range(rng.randint(0, 3)):
            if rng.random() < 0.5 and t:
                t.pop(rng.randrange(len(t)))
            else:
                t.insert(rng.randint(0, len(t)), rng.choice(["filler", "é", "the", "license", "GNU"]))
        pad = lambda: " ".join(rng.choice(["alpha", "the", "of", "work", "license", "42"]) for _ in range(rng.randint(0, 90)))
        texts.append(f"{pad()}\n{rng.choice([' ', '-', '_', chr(10)]).join(t)} {pad()}")
    texts += ["MIT License", "mit-license and CC BY", "submit license", "cc bye", "GNU general\n* public  license, gnu General Public License", "Apache_License"]
    rows = [(rng.choice([i, i, 3, None]), t, "en") for i, t in enumerate(texts)]
    rows += rows[:40]
    got = licenses.license_report(docs_of(sp, rows).repartition(5))
    want = sorted(((i, *license_want(t)) for i, t, _ in rows), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum("," in w[6] for w in want) and any(w[5] == "" and w[6] for w in want)
    assert licenses.license_report(docs_of(sp, [])).count() == 0
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_license_join_is_native(sp):
    plan = licenses.license_report(docs_of(sp, [(1, "Released under the MIT License", "en")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("PythonRDD", ""))


def test_words_are_ranges_in_texts_of_any_case(sp):
    """The words of the SQL, found without lower-casing the text first; every code point beside a border of the ranges stands between letters."""
    borders = [0, 0x2F, 0x30, 0x39, 0x3A, 0x40, 0x41, 0x5A, 0x5B, 0x60, 0x61, 0x7A, 0x7B, 0x7F, 0x80, 0xFF, 0x212A, 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x10FFFF]
    text = " ".join(f"Ab{chr(c)}yZ {chr(c)}" for c in borders)
    lower = text.translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    d = sp.createDataFrame([(text,)], "text string").select(licenses.words_of("text").alias("raw"), licenses.words_of(licenses.lowered("text")).alias("low"))
    got = d.first()
    assert got.low == re.findall(licenses.WORD, lower) and [w.translate(str.maketrans(licenses.UPPER, licenses.LOWER)) for w in got.raw] == got.low
    plan = licenses.license_report(docs_of(sp, [(1, "Released under the MIT License", "en")]))._jdf.queryExecution().optimizedPlan().toString()
    assert licenses.WORD not in plan
