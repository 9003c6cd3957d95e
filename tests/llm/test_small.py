"""The operators against plain Python on small tables with nulls, empty and long texts, ties, repeated rows and odd columns."""
import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rallyframe.llm import ann, chat, jaccard, langid, lines, mixing, mtree, pieces, pii, suffix, vectors
from rallyframe.session import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, label int, spans string"


@pytest.fixture(scope="module")
def sp(spark):
    ship(spark)
    return spark


def docs_of(sp, texts, sources=None):
    rows = [(i, t, "en", None if sources is None else sources[i], None if t is None else len(t), 7, "x", 1, "y") for i, t in enumerate(texts)]
    return sp.createDataFrame(rows, DOCS)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "stone", "river", "blue", "runs", "over", "tall", "Grass", "and"]) + str(rng.randint(0, 60)) for _ in range(n))


# --- lines --------------------------------------------------------------------------------------------

def test_lines(sp):
    a, b = "One two three four five", "one  two THREE four\tfive"
    texts = [f"{a}\nshort line\n{a}", None, "", f"x\n{b}\nanother line with some more words", "another line with some more words", f"x\n{b}\nanother line with some more words"]
    got = {r["doc_id"]: r for r in rows_of(lines.line_report(docs_of(sp, texts)))}
    assert got[0]["text"] == f"{a}\nshort line" and got[0]["removed"] == "35:58"
    assert got[1]["text"] is None and got[2]["text"] == "" and got[1]["n_removed"] == 0
    assert got[3]["text"] == "x\nanother line with some more words" and got[3]["removed"] == "2:26"
    assert got[4]["text"] == "" and got[5]["n_removed"] == 2
    assert lines.line_report(docs_of(sp, [])).count() == 0


def test_repeated_rows_share_their_fate(sp):
    d = docs_of(sp, ["same five words in here", "same five words in here"])
    assert sorted(r["n_removed"] for r in rows_of(lines.line_report(d.union(d)))) == [0, 0, 1, 1]


# --- chat ---------------------------------------------------------------------------------------------

def chat_want(turns):
    text = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chats(sp):
    rng = random.Random(1)
    odd = ["", None, "\\", "<|", "<", "|>", "a<|im_end|>b", "<\\|im_start|>assistant\nx", "ü\n漢", "<|im_end|>\n<|im_start|>user\nhi"]
    convs = {k: [(rng.choice(["user", "assistant", "system", None, "odd\nrole<|im_end|>"]), rng.choice(odd) if rng.random() < 0.5 else prose(rng, 5)) for _ in range(n)]
             for k, n in enumerate([1, 2, 5, 31, 32, 33, 34, 70, 200])}
    rows = [(k, i, r, t, "u") for k, c in convs.items() for i, (r, t) in enumerate(c)]
    rng.shuffle(rows)
    df = sp.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    got = {r["conv_id"]: r for r in rows_of(chat.chat_report(df))}
    trap = "<|im_end|><|im_start|>assistant ok"
    for k, c in {**convs, -1: [("user", trap), ("assistant", trap)]}.items():
        r = got[k]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == chat_want(c), k
        assert r["formatted_chars"] == len(chat.marked_turns([(a or "", b or "") for a, b in c])) and r["n_rewrites"] == 0
    assert [r["conv_id"] for r in rows_of(chat.chat_report(df.limit(0)))] == [-1]


def test_chat_template_that_rewrites_history(sp):
    def only_last_thought(turns):
        out = []
        for i, (role, text) in enumerate(turns):
            out.append(f"[{role}]" + (re.sub("<think>.*?</think>", "", text) if i < len(turns) - 1 else text) + "\n")
        return "".join(out)
    df = sp.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "<think>hm</think>yes"), (1, 2, "user", "ok"), (2, 0, "user", "a"), (2, 1, "assistant", "b")],
                            "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["pos"]): r for r in rows_of(chat.format_chats(df, only_last_thought))}
    assert [k for k, r in got.items() if r["rewrites"]] == [(1, 2)]
    assert got[2, 1]["piece"] == "[assistant]b\n" and (got[2, 1]["loss_start"], got[2, 1]["loss_end"]) == (len("[user]a\n[assistant]"), len("[user]a\n[assistant]b"))


def test_chat_templates_see_whole_prefixes(sp):
    def last_query(turns):
        """Thoughts stay only after the last user turn; turns are numbered and the first one is named in each."""
        asked = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=0)
        return "".join(f"[{i} {r} of {turns[0][1]}]" + (re.sub("<think>.*?</think>", "", t) if r == "assistant" and i < asked else t) + "\n" for i, (r, t) in enumerate(turns))

    convs = {}
    for n in (33, 64, 200):
        turns = [("user", f"first{n}")] + [("assistant" if i % 2 else "tool", f"<think>h{i}</think>said {i}") for i in range(1, n - 2)]
        convs[n] = turns + [("user", "next"), ("assistant", "<think>z</think>answer")]
    df = sp.createDataFrame([(k, i, r, t) for k, c in convs.items() for i, (r, t) in enumerate(c)], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["pos"]): r for r in rows_of(chat.format_chats(df, last_query))}
    for k, turns in convs.items():
        for i, (role, text) in enumerate(turns):
            before, after, r = last_query(turns[:i]), last_query(turns[:i + 1]), got[k, i]
            assert r["rewrites"] == (not after.startswith(before)) == (i == k - 2) and r["end"] == len(after) and after[r["start"]:] == r["piece"]
            if role == "assistant":
                assert (r["loss_start"], r["loss_end"]) == (len(after) - 1 - len(text), len(after) - 1)


def test_chat_rewriting_turn_keeps_its_loss_span():
    made = chat.Renderer(lambda turns: f"{len(turns)} turns\n" + "".join(f"{r}: {t.strip()}\n" for r, t in turns))
    made.add("user", "hi")
    _, _, start, end, a, z, piece, rewrites = made.add("assistant", " yes ")
    assert rewrites and (start, piece[a - start:z - start], end) == (0, "yes", len("2 turns\nuser: hi\nassistant: yes\n"))


# --- mixing -------------------------------------------------------------------------------------------

def filled(size, weight):
    target, free, left = {}, set(size), float(sum(size.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 3 * size[s]]
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.discard(s)
    return target


def test_mix(sp):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([0, 1, 3, 40, 400, 3000])) for _ in range(120)] + [None, "", "  \n", "tiny", " many things "]
    texts += [texts[0], texts[5]]
    sources = [rng.choice(["a", "b", "b", "b", "é", None]) for _ in texts]
    sources[50] = "z"
    d = docs_of(sp, texts, sources)
    got = rows_of(mixing.mix_report(d))
    again = rows_of(mixing.mix_report(d.repartition(3)))
    key = lambda r: tuple(sorted(r.items(), key=lambda x: x[0]))
    assert sorted(map(str, map(key, got))) == sorted(map(str, map(key, again)))
    size = {r["doc_id"]: r["size"] for r in got}
    assert size == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    total = {s: sum(size[i] for i in size if sources[i] == s) for s in set(sources)}
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target = filled(total, weight)
    assert any(target[s] == 3 * total[s] for s in total)
    for s in total:
        own = [r for r in got if sources[r["doc_id"]] == s]
        assert {r["source_size"] for r in own} == {total[s]} and all(abs(r["target"] - target[s]) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= mixing.BLOCK
        assert all(r["taken"] <= 3 * r["size"] for r in own)


def test_mix_of_nothing(sp):
    assert mixing.mix_report(docs_of(sp, [])).count() == 0
    assert [(r["taken"], r["target"]) for r in rows_of(mixing.mix_report(docs_of(sp, [None, ""])))] == [(0, 0.0)] * 2


def test_permutation(sp):
    for n in (1, 2, 3, 17, 1000):
        got = [r[0] for r in sp.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5))).collect()]
        assert sorted(got) == list(range(n))
    assert got != sorted(got)


def test_mixed_documents_hold_what_is_taken(sp):
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([1, 5, 70, 300])) for _ in range(40)] + [None, ""]
    texts.append(texts[3])
    d = docs_of(sp, texts, [rng.choice("abc") for _ in texts])
    taken = {r["doc_id"]: r["taken"] for r in rows_of(mixing.mix_report(d))}
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    seen = dict.fromkeys(taken, 0)
    for r in rows_of(out):
        words = r["text"].split()
        assert all(w in texts[r["doc_id"]].split() for w in words) and r["n_chars"] == len(r["text"])
        seen[r["doc_id"]] += len(words)
    assert seen == taken


# --- pieces -------------------------------------------------------------------------------------------

def test_pieces_equal_the_library(sp):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(4)
    texts = ["", None, " ", "  a  b ", "a\n\nb", "漢字 kana 🎉🎉\t", "x" * 3000, "a▁ b", "    def f(x):\n        return x**2", "\x00\x01"]
    texts += ["".join(rng.choice("abcdeéß .,\n-_'\"()0123thing") for _ in range(rng.randint(1, 300))) for _ in range(200)] + [prose(rng, 4000)]
    got = {r["doc_id"]: r for r in rows_of(pieces.encode_documents(docs_of(sp, texts)))}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == lib.encode(t or "") and got[i]["n_tokens"] == len(got[i]["ids"]) and got[i]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in rows_of(pieces.decode_documents(pieces.encode_documents(docs_of(sp, texts))))}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert pieces.encode_documents(docs_of(sp, [])).count() == 0


# --- Jaccard ------------------------------------------------------------------------------------------

def shingles(text, width):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(texts, rule):
    sets = [shingles(t, rule.width) for t in texts]
    label = list(range(len(texts)))
    changed = True
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= rule.percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in near:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return {i: (len(sets[i]), label[i]) for i in range(len(texts))}


def families(rng):
    """Families of edited copies around the threshold, some of them large and loose, with passages that many texts share."""
    texts, passage = [None, "", " \n ", "one", "One", "one two", "ONE two three", "one two three four", "a b c d e", "a b c d e f"], prose(rng, 60)
    for size, words, edits in [(4, 80, 2), (6, 150, 5), (60, 120, 3), (40, 60, 2), (3, 2500, 60), (5, 30, 1)]:
        base = prose(rng, words).split()
        for _ in range(size):
            w = base[:]
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(w))
                w[at:at + 1] = rng.choice([[], ["new" + str(rng.randint(0, 99))], [w[at], "more"]])
            texts.append(" ".join(w))
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(30)] + [passage] * 3
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("rule,frequent,block", [(jaccard.Rule(), 24, 1024), (jaccard.Rule(), 3, 16), (jaccard.Rule(5, 80), 3, 16)])
def test_jaccard_components(sp, monkeypatch, rule, frequent, block):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = families(random.Random(frequent))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.jaccard_components(docs_of(sp, texts), rule))}
    assert got == components(texts, rule)


def link_numbers(texts, rule):
    sets = [shingles(t, rule.width) for t in texts]
    return [sum(1 for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= rule.percent * len(a | b)) for i, a in enumerate(sets)]


@pytest.mark.parametrize("rule,family,tokens,columns", [(jaccard.Rule(), 256, 500_000, 4096), (jaccard.Rule(5, 80), 7, 2000, 64)])
def test_jaccard_counts_every_link(sp, monkeypatch, rule, family, tokens, columns):
    for name, value in (("FAMILY", family), ("FAMILY_TOKENS", tokens), ("COLUMNS", columns)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(13)
    base = prose(rng, 100).split()
    texts = families(rng)
    for i in range(100):  # near copies that all link
        texts.append(" ".join([*base[:i], f"only{i}", *base[i + 1:]]))
    texts += [texts[-1]] * 3 + [texts[-2].upper()]
    got = {r["doc_id"]: r["n_linked"] for r in rows_of(jaccard.jaccard_components(docs_of(sp, texts), rule))}
    want = link_numbers(texts, rule)
    assert [got[i] for i in range(len(texts))] == want and max(want) >= 100


def test_jaccard_corner_cases(sp):
    assert jaccard.jaccard_report(docs_of(sp, [])).count() == 0
    d = docs_of(sp, ["a b c d e f", "x y"])
    assert sorted((r["doc_id"], r["component_id"]) for r in rows_of(jaccard.jaccard_report(d.union(d)))) == [(0, 0), (0, 0), (1, 1), (1, 1)]
    kept = jaccard.one_of_each(d.union(d).union(d.withColumn("doc_id", F.col("doc_id") + 10)))
    assert sorted(r["doc_id"] for r in rows_of(kept)) == [0, 1] and kept.columns == d.columns


# --- personal data ------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for order, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_pii(sp):
    rng = random.Random(5)
    parts = ["a@b.c", "x.y+z@mail.example.com", "@b.c", "a@b", "a@b..c", "a@b.c@d.e", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "007.08.9.255", "4111 1111 1111 1111", "4111-1111-1111-1111",
             "4111111111111112", "+1 (555) 010-9999", "+12", "+49 30 1234567 ", "ssn 123-45-6789", "123-45-6789", "IBAN DE89 3704 0044 0532 0130 00", "DE89370400440532013001", "ü漢", "0" * 40, ". ", "text "]
    texts = [None, "", "7" * 50_000, "a" * 50_000, "+" * 5000 + "1" + "-" * 5000] + ["".join(rng.choice(parts) + rng.choice(["", " ", "."]) for _ in range(12)) for _ in range(300)]
    got = {r["doc_id"]: r for r in rows_of(pii.pii_report(docs_of(sp, texts)))}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert [x for x in got[i]["spans"].split(",") if x.split(":")[0] in BASE] == [x for x in want.split(",") if x]
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(x.startswith(k) for x in want.split(",")) for k in BASE]
    assert pii.pii_report(docs_of(sp, [])).count() == 0
    masked = [r["text"] for r in rows_of(pii.mask_pii(docs_of(sp, ["to a@b.c, ssn 123-45-6789; DE89 3704 0044 0532 0130 00", None, "no 123-45-6789"])))]
    assert masked == ["to <EMAIL>, ssn <SSN>; <IBAN>", None, "no 123-45-6789"]


def test_iban_before_other_words():
    gb, de, spaced = "GB82WEST12345698765432", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    for text, want in [(f"{gb} BIC NWBKGB2L", [gb]), (f"{gb} 12 May 2024", [gb]), (f"{de} I paid", [de]), (f"{spaced} EUR 40 TO {gb} A", [spaced, gb]),
                       (f"{gb} {de} {spaced}", [gb, de, spaced]), (f"AB12 {gb} X", [gb]), (f"{gb}X", []), (f"x{gb} A", []), ("DE89370400440532013001 I paid", [])]:
        assert [text[s:e] for k, s, e, _ in pii.find_spans(text) if k == "iban"] == want, text
    assert pii.masked(f"pay {gb} BIC NWBKGB2L") == "pay <IBAN> BIC NWBKGB2L"


# --- vectors ------------------------------------------------------------------------------------------

def vector_rows(rng, n, dim):
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[5:90] = x[4]  # many equal vectors
    x[100] = 0
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    rows += [(n, None, 1), (n + 1, [float("nan")] * dim, 1), (n + 2, [None] + [1.0] * (dim - 1), 1), (n + 3, [float("inf")] + [0.0] * (dim - 1), 1)]
    return x, rows


def test_exact_top_k(sp, monkeypatch):
    monkeypatch.setattr(mtree, "BLOCK", 150)
    x, rows = vector_rows(np.random.default_rng(1), 700, 8)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(mtree.top_scores(sp.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"))))
    whole = np.floor(64 * x.astype(float)).astype(int)
    want = []
    for q in range(0, 700, 20):
        s = whole @ whole[q]
        want += [(q, k + 1, i, s[i]) for k, i in enumerate([i for i in np.lexsort((np.arange(700), -s)) if i != q][:20])]
    assert got == want


def test_nearest_neighbours(sp, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 150)
    x, rows = vector_rows(np.random.default_rng(2), 900, 16)
    x = x.astype(float)
    found = {}
    for r in rows_of(ann.nearest(sp.createDataFrame(rows, "vec_id long, embedding array<float>, vid int"))):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [q for q in range(0, 900, 20) if q != 100]
    assert sorted(found) == queries
    share = []
    for q in queries:
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(900), -s)) if i not in (q, 100)][:20]
        own = sorted(found[q])
        assert [k for k, _, _ in own] == list(range(1, len(own) + 1)) and all(abs(s[i] - v) < 1e-9 for _, i, v in own)
        share.append(len({i for _, i, _ in own} & set(order)) / 20)
    assert np.mean(share) >= 0.9


def test_nearest_neighbours_recall_with_production_parameters(sp):
    x = np.random.default_rng(4).normal(size=(10_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    queries = list(range(0, len(x), 20))
    table = sp.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}), "vec_id long, embedding array<double>")
    found = {}
    for r in rows_of(ann.nearest(table)):
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    share = []
    for q in queries:
        score = x @ x[q]
        score[q] = -np.inf
        assert len(found[q]) == 20
        share.append(len(found[q] & {int(i) for i in np.argsort(-score)[:20]}) / 20)
    print("recall", np.mean(share), min(share))
    assert np.mean(share) >= 0.9


@pytest.mark.parametrize("n,block,skew", [(5, 2048, 0.0), (15, 2048, 1.0), (19, 6, 0.0), (900, 150, 1.5), (900, 150, "one long")])
def test_nearest_neighbours_of_few_and_uneven_vectors(sp, monkeypatch, n, block, skew):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if skew == "one long":
        x[7] *= 1000
    else:
        x *= np.exp(skew * rng.normal(size=n))[:, None]
    found = {}
    for r in rows_of(ann.nearest(sp.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))):
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    best = {q: {int(i) for i in np.argsort(-(x @ x[q])) if i != q} for q in range(0, n, 20)} if n <= 20 else {
        q: set([int(i) for i in np.argsort(-(x @ x[q])) if i != q][:20]) for q in range(0, n, 20)}
    assert found.keys() == best.keys() and all(len(found[q]) == min(20, n - 1) for q in best)
    assert np.mean([len(found[q] & best[q]) / len(best[q]) for q in best]) >= (1 if n <= 20 else 0.9)


@pytest.mark.parametrize("search", [ann.nearest, mtree.top_scores])
def test_few_and_no_vectors(sp, search):
    schema = "vec_id long, embedding array<float>"
    assert search(sp.createDataFrame([], schema)).count() == 0
    assert search(sp.createDataFrame([(0, None), (20, [float("nan")])], schema)).count() == 0
    got = rows_of(search(sp.createDataFrame([(0, [1.0, 0.0]), (3, [1.0, 0.5]), (4, [1.0, 0.5]), (None, [9.0, 9.0])], schema)))
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 3), (2, 4)]


def test_equal_vectors_keep_only_ids_that_can_matter(sp):
    d = sp.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "vec_id long, vec array<double>")
    assert rows_of(vectors.distinct_vectors(d))[0]["ids"] == list(range(21))


# --- language -----------------------------------------------------------------------------------------

def test_cross_parsing_counts_phrases():
    sample = (("a", "the cat sat on the mat"), ("b", "der hund lief über die straße"))
    p = langid.Parser(sample)
    for text in ["the mat", "die katze", "zzz", "the cat sat on the mat the cat"]:
        got = p.phrases([langid.folded(text)])
        for k, (_, train) in enumerate(sample):
            data, train, n, at = langid.folded(text), langid.folded(train), 0, 0
            while at < len(data):
                size = 1
                while at + size < len(data) and data[at:at + size + 1] in train and data[at:at + size] in train:
                    size += 1
                at, n = at + size, n + 1
            assert got[k, 0] == n


@pytest.mark.parametrize("segment", [3, 7, 1024])
def test_phrases_run_on_across_segments(monkeypatch, segment):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    rng = random.Random(12)
    train = ["".join(rng.choice("ab") for _ in range(60)), "ab" * 30, "abc " * 20]
    p = langid.Parser(tuple(zip("xyz", train, strict=True)))
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 90))) for _ in range(40)] + ["ab" * 40, "abababc " * 9, "c", "q" * 20]
    got = p.phrases([langid.folded(t) for t in texts])
    for k, t in enumerate(train):
        data = langid.folded(t)
        for i, text in enumerate(texts):
            b, at, n = langid.folded(text), 0, 0
            while at < len(b):
                size = 1
                while at + size < len(b) and b[at:at + size + 1] in data:
                    size += 1
                at, n = at + size, n + 1
            assert got[k, i] == n, (t, text)


def test_signs_that_count_as_numbers_are_no_letters():
    assert not langid.has_letter("½ ² ① 12 _ -") and langid.has_letter("½a") and langid.has_letter("ß")


def test_language_report(sp):
    rng = random.Random(6)
    words = {"xx": ["lorem", "ipsum", "dolor"], "yy": ["fjord", "skål", "blåbær"]}
    texts, langs = [None, "", "123 ... 456"], ["xx", "yy", "xx"]
    for _ in range(300):
        lang = rng.choice(sorted(words))
        texts.append(" ".join(rng.choice(words[lang]) for _ in range(rng.choice([3, 30, 3000]))))
        langs.append(lang)
    d = sp.createDataFrame([(i, t, None if i % 10 == 0 else x, 1) for i, (t, x) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in rows_of(langid.language_report(d))}
    import zlib
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3
    assert all(got[i]["lang_pred"] == langs[i] and 0 <= got[i]["score"] <= 1 for i in range(3, len(texts)))
    assert langid.known_language(d).columns == d.columns and langid.known_language(d).count() == len(texts) - 3
    assert langid.language_report(d.limit(0)).count() == 0
    assert {r["lang_pred"] for r in rows_of(langid.language_report(d.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}


# --- suffix arrays ------------------------------------------------------------------------------------

def kept_bytes(texts):
    data, count = [(t or "").encode() for t in texts], {}
    for b in data:
        for i in range(len(b) - 199):
            count[b[i:i + 200]] = count.get(b[i:i + 200], 0) + 1
    out = {}
    for d, b in enumerate(data):
        spans = []
        for i in range(len(b) - 199):
            if count[b[i:i + 200]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 200
                else:
                    spans.append([i, i + 200])
        kept = b"".join(b[a:z] for a, z in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(b)]))
        out[d] = (len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("split,shard", [(1000, 2_000_000), (2, 3000)])
def test_substrings(sp, monkeypatch, split, shard):
    monkeypatch.setattr(suffix, "SPLIT", split)
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    rng = random.Random(7)
    passage, other = prose(rng, 60), prose(rng, 45)
    texts = [None, "", "short", "a" * 199, "a" * 200, "ab" * 300, passage, passage + "!", "é" * 150]
    texts += [prose(rng, rng.randint(1, 60)) + rng.choice([passage, passage[20:], passage[:-31], other, other[5:]]) + prose(rng, rng.randint(1, 60)) for _ in range(40)]
    texts += [texts[12], texts[12], texts[15][:260]]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(suffix.substring_report(docs_of(sp, texts)))}
    assert got == kept_bytes(texts)


def test_substrings_of_nothing_and_of_repeated_rows(sp):
    assert suffix.substring_report(docs_of(sp, [])).count() == 0
    d = docs_of(sp, ["b" + "cd" * 30 + prose(random.Random(8), 60)])
    assert [r["n_removed"] for r in rows_of(suffix.substring_report(d))] == [0]
    both = rows_of(suffix.substring_report(d.union(d)))
    assert all(r["n_removed"] == r["n_bytes"] for r in both)


def test_suffix_array_and_common_prefixes():
    rng = random.Random(9)
    bodies = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) * rng.randint(1, 5) for _ in range(30)]
    text = np.frombuffer(b"".join(b + suffix.terminator(k) for k, b in enumerate(bodies)), np.uint8)
    size = np.array([len(b) + suffix.END for b in bodies])
    begin = np.cumsum(size) - size
    sa, rank = suffix.suffix_array(text)
    raw = text.tobytes()
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    got = suffix.common_prefixes(text, sa, rank, begin, size)
    for r in range(1, len(raw)):
        a, b, n = sa[r - 1], sa[r], 0
        while max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        assert got[r] == n


# --- sentences ----------------------------------------------------------------------------------------

def test_sentences(sp):
    a = "The first of these words stands in a sentence of twelve words."
    b = "Another one of them, Also in TWELVE words or a few more follows!"
    texts = [f"{a} Short. {b}\nline", f"x y.  {b.lower()}  {a}", None, "", f"{a}\n\n{a}", f"{b}\tand {a}"]
    got = {r["doc_id"]: r for r in rows_of(lines.sentence_report(docs_of(sp, texts)))}
    assert got[0]["n_removed"] == 0 and got[0]["text"] == texts[0]
    assert got[1]["text"] == "x y.  " and got[1]["removed"] == f"6:{8 + len(b)},{8 + len(b)}:{8 + len(b) + len(a)}"
    assert got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == "" and got[4]["n_removed"] == 2
    assert got[5]["text"] == f"and {a}"  # another sentence
    assert lines.sentence_report(docs_of(sp, [])).count() == 0


def test_repeated_rows_keep_one_copy_of_a_sentence(sp):
    t = "one two three four five six seven eight nine ten eleven twelve. And a rest"
    d = docs_of(sp, [t, t, "w " * 50_000])
    got = [tuple(r[c] for c in ("doc_id", "text", "removed")) for r in rows_of(lines.sentence_report(d.union(d).repartition(3)))]
    first = t.index("And")
    assert sorted(got) == sorted([(0, t, ""), (0, "And a rest", f"0:{first}"), (1, "And a rest", f"0:{first}"), (1, "And a rest", f"0:{first}"),
                                  (2, "w " * 50_000, ""), (2, "", "0:100000")])
