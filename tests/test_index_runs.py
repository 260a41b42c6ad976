"""The text index is written in sorted runs without a shuffle, and a search's join gets lengths in place of whole texts."""

from pyspark.sql import functions as F

from chronoplace.operators import postings
from chronoplace.plans.engine import Engine

SCHEMA = "page_id long, is_redirect boolean, title string, first_paragraph string, full_text string"
ROWS = [(9, False, "Été à b", "b a", "a b a\nb"), (2, True, "b", None, "zu b"), (5, False, None, "", " .. "), (1, False, "a", "a", "long " * 40), (7, False, "c", "été", "a")]


def test_an_index_of_several_runs(spark, monkeypatch):
    monkeypatch.setattr(postings, "RUN", 4, raising=False)
    monkeypatch.setattr(postings, "BACK", 3, raising=False)
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    made = postings.postings(df)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    expected = {}
    for page, redirect, *texts in ROWS:
        words = [postings.query_words(x or "") for x in texts]
        for col, own in zip(postings.COLUMNS, words):
            for at, term in enumerate(own):
                expected.setdefault((term, page, col, sum(map(len, words)), redirect), []).append(at)
    index = postings.TextIndex.build(df)
    got = index.postings.collect()
    assert {(r.term, r.page_id, r.col, r.n_tokens, r.is_redirect): r.positions for r in got} == expected and len(got) == len(expected)
    n = sum(len(postings.query_words(x or "")) for row in ROWS for x in row[2:])
    assert (index.n_all, index.avg_tokens) == (len(ROWS), n / len(ROWS))
    # within a run, rows are in the order of term and page
    whole = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    monkeypatch.setattr(postings, "RUN", 10**6)
    keys = [(r.term.encode(), r.page_id) for r in postings.postings(whole).collect() if r.term is not None]
    assert keys == sorted(keys)


def test_whole_texts_do_not_reach_the_join(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    text = spark.createDataFrame([(9, 1.0, 2, True, True)], "page_id long, bm25_score double, query_match_tier int, exact_title_match boolean, lead_exact_match boolean")
    entity = spark.createDataFrame([(2, 0.5)], "page_id long, category_score double")
    distance = spark.createDataFrame([(5, 3.0)], "page_id long, distance_km double")
    rows = Engine(pages, entity)._candidates(pages, text, entity, distance, None, None)
    assert {r.page_id: (r.first_paragraph_length, r.full_text_length) for r in rows.collect()} == {9: (3, 7), 2: (None, 4), 5: (0, 4)}
    node = rows._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    assert "page_id" in node.left().output().mkString() and "full_text#" not in node.left().output().mkString()
