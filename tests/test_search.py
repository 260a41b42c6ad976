"""Ranking, text and retrieval on literal tables."""

import math

import pytest
from pyspark.sql import functions as F

from chronoplace.functions import text, values
from chronoplace.operators import postings, ranking, retrieval, vectors


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


PERSON = {"entity_class": "person", "wikidata_id": "Q1", "instance_of": '["human"]', "occupation": "writer", "birth_date": "1800", "death_date": "1870", "country": None, "location": None, "lat": None, "lon": None, "inception": None, "point_in_time": None, "start_time": None, "end_time": None}
PLACE = {**PERSON, "entity_class": "place", "instance_of": '["city"]', "occupation": None, "birth_date": None, "death_date": None, "country": "France", "location": "Paris", "lat": 48.8, "lon": 2.3, "inception": "-0052"}
SCHEMA = "entity_class string, wikidata_id string, instance_of string, occupation string, birth_date string, death_date string, country string, location string, lat double, lon double, inception string, point_in_time string, start_time string, end_time string"


def test_completeness_is_judged_by_class(spark):
    rows = spark.createDataFrame([tuple(PERSON.values()), tuple(PLACE.values()), ("rock",) + (None,) * 13], SCHEMA)
    got = {r.entity_class: r.c for r in rows.select("entity_class", ranking.completeness(rows).alias("c")).collect()}
    assert got["person"] == pytest.approx(4.2 / 4.6) and got["place"] == pytest.approx(1.0) and got["rock"] == 0


def test_importance_counts_for_large_cities_only(spark):
    row = spark.createDataFrame([(1, 0.01, None, 5, 0.0, 2.0, 0.0, True), (2, 0.01, None, 5, 0.0, 2.0, 0.0, False)], "page_id long, rrf_score double, distance_km double, hop int, quality_score double, importance_score double, category_score double, use_importance boolean")
    on, off = (r.s for r in row.select("page_id", ranking.score(row, 50.0).alias("s")).orderBy("page_id").collect())
    assert on - off == pytest.approx(2.0)
    (half, _) = (r.s for r in row.select("page_id", ranking.score(row, 50.0, {"importance": 0.5}).alias("s")).orderBy("page_id").collect())
    assert half - off == pytest.approx(1.0)
    with pytest.raises(ValueError, match="unknown"):
        ranking.score(row, 50.0, {"rrf": 1.0})


def test_geographic_weight(spark):
    row = spark.createDataFrame([(0.0, 10.0), (0.0, 200.0), (0.0, None)], "rrf_score double, distance_km double")
    got = [r.s for r in row.select(ranking.score(row, 50.0, {"geographic": 2.0}).alias("s")).collect()]
    assert got == pytest.approx([1.6, 0.0, 0.0])


def test_classes_of_lists_that_are_text(spark):
    rows = [('["Human", "writer"]', "person"), ("['battle']", "event"), ("museum", "place"), (None, "other"), ("[]", "other"), ("['it''s']", "other"), ("not a list]", "other")]
    got = spark.createDataFrame(rows, "v string, k string").select("k", ranking.entity_class(F.col("v"), as_text=True).alias("c")).collect()
    assert [r.c for r in got] == [k for _, k in rows]


def test_ranks_of_ranges_are_those_of_one_sort(spark, monkeypatch):
    rows = spark.range(500).select(F.col("id").alias("page_id"), (F.col("id") * 37 % 11).alias("s"), F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") % 3).alias("t"))
    whole = sorted(map(tuple, ranking.ranked(rows, F.desc("s"), "t").collect()))
    monkeypatch.setattr(ranking, "ALONE", 10)
    assert sorted(map(tuple, ranking.ranked(rows, F.desc("s"), "t").collect())) == whole and [r for _, r in sorted(whole, key=lambda x: x[1])] == list(range(1, 501))
    assert ranking.ranked(rows.limit(0), "s").count() == 0


def test_tokens_of_many_scripts(spark):
    for raw, expected in {
        "Điện Biên Phủ": ["đien", "bien", "phu"],
        "ệ ễ Ǻ ṩ": ["e", "e", "a", "s"],
        "été ñ": ["ete", "n"],
        "Ελλάδα": ["ελλάδα"],
        "Йод ёж": ["йод", "ёж"],
        "Straße, ŒUVRE İ": ["straße", "œuvre", "i"],
        "東京 x_y 42½": ["東京", "x", "y", "42½"],
        "": [],
        " ... ": [],
    }.items():
        assert one(spark, raw, postings.tokens) == expected and postings.query_words(raw) == expected, raw


def test_phrases_in_a_written_index(spark):
    rows = [(1, False, "New York City", "new york", "york new york"), (2, False, "York", "", "a new day in york"), (3, True, "New York", "", ""), (4, False, "Other", None, None)]
    index = postings.TextIndex.build(spark.createDataFrame(rows, "page_id long, is_redirect boolean, title string, first_paragraph string, full_text string"))
    hits = {r.page_id: r.hits for r in postings.phrase_hits(index, ["new", "york"]).collect()}
    assert hits == {1: 3, 3: 1} and (index.n_all, index.avg_tokens) == (4, (8 + 6 + 2 + 1) / 4)
    assert {r.page_id for r in postings.phrase_hits(index, ["york"], "title").collect()} == {1, 2, 3}
    found = {r.page_id: (r.query_match_tier, r.exact_title_match, r.lead_exact_match) for r in postings.text_candidates(index, "York, New").collect()}
    assert found == {1: (2, True, True), 2: (1, True, False)}
    f, n, df = 3, 8, 2
    expected = max(1e-6, math.log((4 - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / 4.25))
    assert {r.page_id: r.bm25_score for r in postings.bm25(index, [["new", "york"]]).collect()} == {1: pytest.approx(expected)}
    assert postings.text_candidates(index, " , ").count() == 0 and postings.phrase_hits(index, []).count() == 0
    plan = index.of(["york"]).postings._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(term,york)" in plan and "Generate" not in plan
    with pytest.raises(FileNotFoundError):
        postings.TextIndex.open(spark, index.path + "-none")


def test_white_space_and_case(spark):
    assert one(spark, "&nbsp; x \x1c", text.clean_text) == "x"
    assert one(spark, "Straße_ﬁn  ΣΑΣ", text.title_key) == "strasse fin σασ" and one(spark, " A__b ", text.title_key) == "a b"
    assert one(spark, "x", lambda c: text._hit(c, r"a\E.*")) is False and one(spark, r"in a\Eb now", lambda c: text._hit(c, r"a\Eb")) is True
    pages = spark.createDataFrame([(r"C\E.*", 1), ("anything", 2)], "country string, page_id int")
    assert [r.page_id for r in pages.filter(retrieval.country_match(r"c\E.*")).collect()] == [1]


def test_markup_as_deep_as_it_stands(spark):
    line = "A line of plain words that is longer than fifty characters, surely."
    deep = line
    for i in range(40):
        deep = "{{x%d|%s}}" % (i, deep)
    files = "[[File:a.jpg|thumb|with [[a link]] and {{a|{{b}}}} inside]]"
    assert one(spark, f"{deep}\n{line}{files}\n[[Page|{line}]]", text.paragraphs) == [line, line]
    assert one(spark, None, text.paragraphs) == [] and one(spark, "}} ]] {{ [[" + line, text.paragraphs) == ["}} ]] {{ [[" + line]


def test_reader_paragraphs(spark):
    rows = spark.createDataFrame([("Lead  text\n\nSecond\n \nThird ", "Lead text"), ("Other\n\nSecond", "Lead"), ("", "Lead")], "full string, lead string")
    got = [r.p for r in rows.select(text.reader_paragraphs(F.col("full"), F.col("lead")).alias("p")).collect()]
    assert got == [["Second", "Third"], ["Other", "Second"], []]


def test_values_fit_for_a_response(spark):
    row = spark.createDataFrame([(float("nan"), float("inf"), "3.7", None, ["a", None, "b"], True)], "a double, b double, c string, d string, e array<string>, f boolean")
    got = row.select(values.finite(F.col("a")).alias("a"), values.finite(F.col("b")).alias("b"), values.whole(F.col("c")).alias("c"), values.shown(F.col("d"), "none").alias("d"), values.listed(F.col("e")).alias("e")).first()
    assert tuple(got) == (None, None, 3, "none", "a, b")
    assert tuple(values.storable(row).first()) == (None, None, "3.7", None, '["a",null,"b"]', 1)


def test_nearest_vectors_agree_with_a_plain_search(spark):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    pages = spark.createDataFrame(rows, "page_id long, embedding array<double>").repartition(3)
    queries = pages.filter("page_id % 50 = 0").select(F.col("page_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r.query_id, r["rank"]): r.page_id for r in vectors.top_batch(pages, queries, 12).collect()}
    table = dict(rows)
    for q in (i for i in table if i % 50 == 0):
        best = sorted(table, key=lambda i: (-round(sum(x * y for x, y in zip(table[q], table[i])), 12), i))[:12]
        assert [got[q, k + 1] for k in range(12)] == best
    assert vectors.top_batch(pages, queries.limit(0), 3).count() == 0 and vectors.top_batch(pages.limit(0), queries, 3).count() == 0
