"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are leftmost non-overlapping matches of their pattern that pass
their own test; they are always kept. ``iban`` (mod 97) and ``ssn`` (needs a context word) come on top. Words after an account number may look like
more of it, so every length of it is tried.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Texts are searched whole, however long. Rows stay as they are, repeated
or not, an empty table gives no rows, and any other column of the input is left alone.
"""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the patterns of the contract; possessive runs only save retries that cannot succeed
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")
# characters of an account number by country, where the registry fixes them
IBAN_LENGTH = {c: n for n, names in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL",
    29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC"}.items() for c in names.split()}
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = KINDS[:4]
CONTEXT = {
    "email": ("mail", "e-mail", "contact"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "bank", "account", "konto"), "ssn": ("ssn", "social", "security"),
}
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
REACH, BONUS, THRESHOLD = 40, 0.3, 0.5
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                 T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def ibans(text: str):
    """From each start the cut at the country's length, then the longest other one, whose check digits are right. A cut ends a word."""
    done = 0
    for m in IBAN.finditer(text):
        start, run = m.start(), m[1]
        if start < done:
            continue
        ends, n = [], 0
        for at, c in enumerate(run, start + 1):
            n += c != " "
            if c != " " and n >= 15 and not (text[at:at + 1].isascii() and text[at:at + 1].isalnum()):
                ends.append((n != IBAN_LENGTH.get(run[:2]), -n, at))
        for _, _, end in sorted(ends):
            if mod97(text[start:end]):
                yield start, end
                done = end
                break


def emails(text: str):
    """Every address is built around its at sign, so that a long run of letters is walked once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def proposals(text: str):
    for s, e in emails(text):
        yield "email", s, e
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
            yield "phone", *m.span()
    for s, e in ibans(text):
        yield "iban", s, e
    for m in SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span()


def near_words(text: str, start: int, end: int) -> set[str]:
    return set(re.findall(r"[a-z-]+", (text[max(0, start - REACH):start] + " " + text[end:end + REACH]).lower()))


def find_spans(text: str | None) -> list[tuple]:
    found = []
    for kind, s, e in proposals(text or ""):
        score = BASE_SCORE[kind]
        if near_words(text, s, e) & set(CONTEXT[kind]):
            score = min(1.0, score + BONUS)
        if kind in BASE_KINDS or score >= THRESHOLD:
            found.append((kind, s, e, score))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


@F.pandas_udf(SPAN)
def spans_of(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in find_spans(t)] for t in texts], dtype=object)


def masked(text: str | None) -> str | None:
    """Each maximal run of overlapping spans becomes the kind of its first span in angle brackets."""
    if not text:
        return text
    out, done = [], 0
    for kind, s, e, _ in find_spans(text):
        if s >= done:
            out += [text[done:s], f"<{kind.upper()}>"]
        done = max(done, e)
    return "".join(out) + text[done:] if out else text


@F.pandas_udf(T.StringType())
def mask_of(texts: pd.Series) -> pd.Series:
    return pd.Series([masked(t) for t in texts], dtype=object)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key and ``spans``, an array of (kind, start, end, score) by start, then kind."""
    return docs.select(F.col(key).alias("doc_id"), spans_of(F.col(text)).alias("spans"))


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind; other columns as they were."""
    return docs.withColumn(text, mask_of(F.col(text)))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x.kind == kind))


def pii_report(docs: DataFrame) -> DataFrame:
    found = find_pii(docs)
    base = F.filter("spans", lambda x: x.kind.isin(BASE_KINDS))
    return found.select(
        "doc_id", *[count_of(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
