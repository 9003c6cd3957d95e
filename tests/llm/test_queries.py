"""The registered queries on the small tables, and the stages of the pipeline."""
import pytest
from conftest import SMALL
from oracle_check import compare, connect

from rallyframe.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    message, rows = compare(QUERIES[name](spark, SMALL), con, ORACLES[name])
    assert message is None and rows, message


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    import corpus_pipeline as c
    docs = c.table(spark, SMALL, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    seen = []
    for i, (name, stage) in enumerate(c.STAGES):
        docs = c.store(stage(spark, docs, SMALL), "test")
        seen.append(docs)
        if i < len(c.STAGES) - 1:
            assert docs.columns == columns, name
    language, near, personal, mixed, tokens = seen
    assert {r.doc_id for r in language.collect()} == {k for k, r in before.items() if r.text and any(x.isalpha() for x in r.text)}
    from rallyframe.llm.jaccard import Rule
    from test_small import components
    ids = sorted(r.doc_id for r in language.collect())
    want = components([before[k].text for k in ids], Rule(5, 80))
    assert sorted(r.doc_id for r in near.collect()) == sorted({ids[v] for _, v in want.values()})
    from rallyframe.llm.pii import masked
    assert {r.doc_id: r.text for r in personal.collect()} == {r.doc_id: masked(before[r.doc_id].text) for r in near.collect()}
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in personal.collect()}
    assert tokens.count() == mixed.count() and all(r.round_trip for r in tokens.collect())


ODD_ROWS = [(1, "one two three four five six seven", "en", "a", 33, "x"), (1, "one two three four five six seven", "en", "a", 33, "x"), (2, None, None, None, None, "x"),
            (3, "", "en", None, 0, "x"), (4, "½ ² 12", "de", "b", 6, "x"), (None, "mail bob@example.org now please and thank you", "en", None, 46, "x"),
            (5, "la casa es muy grande y bonita " * 2000, "es", "b", 62000, "x"), (6, "One two three FOUR five six seven", "en", "a", 33, "x")]
ODD = "doc_id long, text string, lang string, source string, n_chars long, n_shingles string"


@pytest.mark.parametrize("rows", [ODD_ROWS, []])
def test_pipeline_takes_odd_rows(spark, rows):
    """Nulls in every column, repeats, an empty and a long text, an extra column with a clashing name; and nothing at all."""
    import corpus_pipeline as c
    c.prepare(spark)
    docs, counts = spark.createDataFrame(rows, ODD), []
    for i, (_, stage) in enumerate(c.STAGES):
        docs = c.store(stage(spark, docs, SMALL), "odd")
        counts.append(docs)
        assert i == len(c.STAGES) - 1 or set(ODD.split()[::2]) - {"n_shingles"} <= set(docs.columns)
    language, near, personal, mixed, tokens = counts
    if not rows:
        assert [d.count() for d in counts] == [0] * 5
        return
    key = lambda d: sorted(str(r.doc_id) for r in d.collect())
    assert key(language) == ["1", "1", "5", "6", "None"]
    assert key(near) == ["1", "5", "None"] and key(personal) == key(near)
    assert [r.text for r in personal.collect() if r.doc_id is None][0].count("bob@") == 0
    assert set(key(mixed)) <= set(key(near)) and tokens.count() == mixed.count()
