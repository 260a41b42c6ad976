"""One query per operator over the role views, each with the SQL that must give the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplace.functions import dates, geo, text
from chronoplace.operators import aggregates, graph, postings, ranking, retrieval, vectors
from chronoplace.plans import api
from chronoplace.plans import build as B
from chronoplace.plans import engine as E
from chronoplace.plans import roles as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


def _T(c: str) -> str:
    return f"list_filter(regexp_split_to_array(strip_accents(lower({c})), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda t : t <> '')"


def _postings(a: str, b: str) -> str:
    return f"""cols AS (
  SELECT page_id, is_redirect, 'title' AS col, {_T('title')} AS w FROM articles UNION ALL
  SELECT page_id, is_redirect, 'first_paragraph', {_T('first_paragraph')} FROM articles UNION ALL
  SELECT page_id, is_redirect, 'full_text', {_T('full_text')} FROM articles
), lengths AS (SELECT page_id, is_redirect, sum(len(w)) AS n_tokens FROM cols GROUP BY ALL
), stats AS (SELECT count(*) AS n_all, avg(n_tokens) AS avg_tokens FROM lengths
), terms AS (SELECT page_id, col, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM cols
), ph(phrase, i, word, size) AS (VALUES ('{a}', 0, '{a}', 1), ('{b}', 0, '{b}', 1), ('{a} {b}', 0, '{a}', 2), ('{a} {b}', 1, '{b}', 2)
), hits AS (
  SELECT phrase, page_id, col, count(*) AS n FROM (
    SELECT phrase, page_id, col, pos - i AS start FROM terms JOIN ph ON term = word GROUP BY phrase, page_id, col, pos - i, size HAVING count(DISTINCT i) = size) GROUP BY ALL
), page_hits AS (SELECT phrase, page_id, sum(n) AS f FROM hits GROUP BY ALL
), dfs AS (SELECT phrase, count(*) AS n FROM page_hits GROUP BY ALL
), weights AS (
  SELECT phrase, page_id, (CASE WHEN ln((n_all - n + 0.5) / (n + 0.5)) <= 0 THEN CAST(0.000001 AS DOUBLE) ELSE ln((n_all - n + 0.5) / (n + 0.5)) END)
    * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_tokens / avg_tokens)) AS w
  FROM page_hits JOIN dfs USING (phrase) JOIN lengths USING (page_id), stats WHERE NOT is_redirect
), strict AS (SELECT page_id, w AS bm25_score, 2 AS tier FROM weights WHERE phrase = '{a} {b}'
), relaxed AS (SELECT page_id, sum(w) AS bm25_score, 1 AS tier FROM weights WHERE phrase IN ('{a}', '{b}') GROUP BY page_id HAVING count(*) = 2
), texts AS (
  SELECT page_id, bm25_score, tier,
    page_id IN (SELECT page_id FROM hits WHERE phrase = '{a}' AND col = 'title') AS exact_title_match,
    page_id IN (SELECT page_id FROM hits WHERE phrase = '{a}' AND col = 'first_paragraph') AS lead_exact_match
  FROM (SELECT * FROM strict UNION ALL SELECT * FROM relaxed) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY tier DESC) = 1
)"""


_ART = f"WITH {V.ARTICLES}"
_TXT = f"WITH {V.ARTICLES}, {_postings('that', 'with')}"


@query(_TXT + " SELECT page_id, round(bm25_score, 6) AS bm25_score FROM relaxed ORDER BY bm25_score DESC, page_id LIMIT 20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """REL-1, AGG-15, TOP-2."""
    return postings.bm25(V.text_index(spark, d), [["that"], ["with"]]).select("page_id", _r("bm25_score")).orderBy(F.desc("bm25_score"), "page_id").limit(20)


@query(_TXT + " SELECT page_id, round(bm25_score, 6) AS bm25_score FROM strict")
def phrase_strict(spark: SparkSession, d: str) -> DataFrame:
    """TXT-10, TXT-12."""
    return postings.bm25(V.text_index(spark, d), [V.WORDS]).select("page_id", _r("bm25_score"))


@query(_TXT + " SELECT page_id, round(bm25_score, 6) AS bm25_score FROM relaxed")
def and_tier(spark: SparkSession, d: str) -> DataFrame:
    """REL-2, JOI-3."""
    return postings.bm25(V.text_index(spark, d), [["that"], ["with"]]).select("page_id", _r("bm25_score"))


@query(_TXT + " SELECT page_id, round(bm25_score, 6) AS bm25_score, tier AS query_match_tier, exact_title_match, lead_exact_match FROM texts")
def text_tiers_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """REL-2, AGG-6, TXT-13."""
    return postings.text_candidates(V.text_index(spark, d), V.PLACE).withColumn("bm25_score", F.round("bm25_score", 6))


@query(_TXT + " SELECT page_id, col, CAST(n AS BIGINT) AS hits FROM hits WHERE phrase = 'that' AND col <> 'full_text'")
def title_lead_flags(spark: SparkSession, d: str) -> DataFrame:
    """TXT-12: column-scoped phrases."""
    index = V.text_index(spark, d)
    return aggregates.union_all(*(postings.phrase_hits(index, ["that"], c).select("page_id", "hits", F.lit(c).alias("col")) for c in ("title", "first_paragraph")))


@query(_TXT + " SELECT term, CAST(count(DISTINCT page_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS cf FROM terms GROUP BY term")
def token_statistics(spark: SparkSession, d: str) -> DataFrame:
    """TXT-11, AGG-15, SNK-12."""
    p = V.text_index(spark, d).postings
    return p.groupBy("term").agg(F.count_distinct("page_id").alias("df"), F.sum(F.size("positions")).alias("cf"))


# Words of history.
_PAST = "(?i)(?:history|historical|medieval|revolution|war|military|political|economic|social|cultural|architecture|timeline|archaeolog|historic)"
_CATEGORY = """CASE WHEN in_city AND past THEN 1.0 WHEN in_city THEN 0.75 WHEN near AND past THEN 0.45 WHEN near THEN 0.2 ELSE 0.0 END"""
_SCORED = f"""scored AS (SELECT page_id, category, hop, CAST({_CATEGORY} AS DOUBLE) AS category_score FROM (SELECT *,
  regexp_matches(category, '(?i)(?:^|[ _(),-])src1(?:$|[ _(),-])') AS in_city, regexp_matches(category, '(?i)(?:^|[ _(),-])en(?:$|[ _(),-])') AS near,
  regexp_matches(category, '{_PAST}') AS past FROM membership))"""
_NORM = "lower(translate(category, '_()', '   '))"
_MATCH = " OR ".join(f"{_NORM} = '{t}' OR {_NORM} LIKE '{t} %' OR {_NORM} LIKE '% {t}' OR {_NORM} LIKE '% {t} %' OR {_NORM} LIKE '% {t},%'" for t in ("src1", "en"))


@query(f"WITH {V.MEMBERSHIP}, {_SCORED} SELECT page_id, category, category_score FROM scored")
def category_score(spark: SparkSession, d: str) -> DataFrame:
    """TXT-14."""
    return V.membership(spark, d).select("page_id", "category", text.category_score(F.col("category"), "src1", ["en"]).alias("category_score"))


@query(f"WITH {V.MEMBERSHIP} SELECT page_id, category FROM membership WHERE {_MATCH}")
def category_match(spark: SparkSession, d: str) -> DataFrame:
    """FLT-8."""
    return V.membership(spark, d).filter(retrieval.category_match(["src1", "en"])).select("page_id", "category")




@query(_ART + " SELECT page_id, location FROM articles WHERE lower(location) = 'en' OR lower(location) LIKE 'en %' OR lower(location) LIKE '% en' OR lower(location) LIKE '% en,%'")
def location_match(spark: SparkSession, d: str) -> DataFrame:
    """FLT-7."""
    return V.articles(spark, d).filter(retrieval.location_match("EN")).select("page_id", "location")


@query(
    f"""WITH {V.ARTICLES}, {V.MEMBERSHIP}, {_SCORED} SELECT page_id, max(category_score) AS category_score FROM (
  SELECT page_id, CAST(0.0 AS DOUBLE) AS category_score FROM articles WHERE NOT is_redirect AND (lower(location) LIKE '% src1' OR lower(location) LIKE 'src1 %' OR lower(location) = 'src1' OR lower(location) LIKE '% src1,%')
  UNION ALL SELECT page_id, category_score FROM scored JOIN articles USING (page_id) WHERE NOT is_redirect AND ({_MATCH})) GROUP BY page_id"""
)
def entity_branch(spark: SparkSession, d: str) -> DataFrame:
    """REL-3, JOI-4, AGG-3."""
    return retrieval.entity_candidates(V.articles(spark, d), V.membership(spark, d), "Src1, EN")


_HAV = "2 * 6371.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a}))"


def _km(lat1: str, lon1: str) -> str:
    a = f"(power(sin(radians(lat - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians(lat)) * power(sin(radians(lon - {lon1}) / 2), 2))"
    return _HAV.format(a=a)


_BOX = (12.5 - 480 / 111, 12.5 + 480 / 111, 30.25 - 480 / (111 * math.cos(math.radians(12.5))), 30.25 + 480 / (111 * math.cos(math.radians(12.5))))
_NEAR = f"(SELECT *, {_km(f'{V.LAT}::DOUBLE', f'{V.LON}::DOUBLE')} AS distance_km FROM articles WHERE NOT is_redirect AND lat IS NOT NULL)"


@query(_ART + f" SELECT page_id, lat, lon FROM articles WHERE lat BETWEEN {_BOX[0]!r} AND {_BOX[1]!r} AND lon BETWEEN {_BOX[2]!r} AND {_BOX[3]!r}")
def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    """FLT-6."""
    return geo.in_box(V.articles(spark, d), V.LAT, V.LON, V.RADIUS).select("page_id", "lat", "lon")


@query(_ART + f" SELECT page_id, round(distance_km, 6) AS distance_km FROM {_NEAR} WHERE distance_km <= {V.RADIUS}")
def radius_search(spark: SparkSession, d: str) -> DataFrame:
    """REL-4, GEO-1, JOI-17."""
    return geo.within_radius(V.articles(spark, d).filter("not is_redirect"), V.LAT, V.LON, V.RADIUS).select("page_id", _r("distance_km"))


@query(
    f"""WITH {V.ARTICLES}, q AS (SELECT page_id AS query_id, lat AS q_lat, lon AS q_lon FROM articles WHERE page_id % 20 = 0 AND lat IS NOT NULL)
SELECT query_id, page_id, round({_km('q_lat', 'q_lon')}, 5) AS distance_km FROM q, articles WHERE lat IS NOT NULL AND {_km('q_lat', 'q_lon')} <= 300"""
)
def radius_join_batch(spark: SparkSession, d: str) -> DataFrame:
    """JOI-17, C2: many points at once."""
    a = V.articles(spark, d).select("page_id", "lat", "lon")
    points = a.filter("page_id % 20 = 0 and lat is not null").select(F.col("page_id").alias("query_id"), F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"))
    return geo.radius_join(points, a, 300.0).select("query_id", "page_id", _r("distance_km", 5))


_DOT = "list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


@query(f"SELECT vec_id AS page_id, round({_DOT}, 6) AS dense_score FROM embeddings ORDER BY {_DOT} DESC, vec_id LIMIT 50")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """TOP-2, VEC-1."""
    return vectors.top(V.vectors(spark, d), V.query_vector(spark, d), 50).select("page_id", _r("dense_score"))


@query(_ART + f" SELECT vec_id AS page_id, round({_DOT}, 6) AS dense_score FROM embeddings WHERE vec_id IN (SELECT page_id FROM articles WHERE NOT is_redirect AND lower(trim(country)) = 'en') ORDER BY {_DOT} DESC, vec_id LIMIT 20")
def dense_scoped_topk(spark: SparkSession, d: str) -> DataFrame:
    """TOP-3, FLT-10, JOI-7."""
    return vectors.top(V.vectors(spark, d), V.query_vector(spark, d), 20, retrieval.country_pages(V.articles(spark, d), "EN ")).select("page_id", _r("dense_score"))


@query(_ART + f" SELECT page_id, round({_DOT}, 6) AS dense_score FROM articles JOIN embeddings ON vec_id = page_id")
def dense_lookup(spark: SparkSession, d: str) -> DataFrame:
    """JOI-15: ids without a vector drop out."""
    return vectors.scores(V.vectors(spark, d), V.query_vector(spark, d), V.articles(spark, d)).select("page_id", _r("dense_score"))


@query(
    "WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0) SELECT query_id, page_id, round(s, 6) AS dense_score, CAST(rank AS INT) AS rank FROM ("
    "SELECT query_id, vec_id AS page_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (SELECT query_id, vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), e) AS s FROM q, embeddings)) WHERE rank <= 5"
)
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    """JOI-18."""
    v = V.vectors(spark, d)
    return vectors.top_batch(v, v.filter("page_id % 20 = 0").select(F.col("page_id").alias("query_id"), F.col("embedding").alias("query")), 5).select("query_id", "page_id", _r("dense_score"), "rank")


_GRAPH = "graph AS (SELECT page_id % 7 AS geoname_id, replace(title, ' ', '_') AS article_title, CAST(page_id % 3 AS INT) AS graph_distance FROM articles)"
_GSCORE = "gs AS (SELECT page_id, min(graph_distance) AS graph_distance, 1.0::DOUBLE / (1 + min(graph_distance)) AS graph_score FROM (SELECT page_id, graph.graph_distance FROM articles JOIN graph ON replace(title, ' ', '_') = article_title WHERE NOT is_redirect) GROUP BY page_id)"


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return V.articles(spark, d).select((F.col("page_id") % 7).alias("geoname_id"), F.replace("title", F.lit(" "), F.lit("_")).alias("article_title"), (F.col("page_id") % 3).cast("int").alias("graph_distance"))


@query(f"WITH {V.ARTICLES}, {_GRAPH}, {_GSCORE} SELECT * FROM gs")
def graph_score(spark: SparkSession, d: str) -> DataFrame:
    """JOI-6, AGG-4, GRF-5, REL-6."""
    return graph.graph_scores(_graph(spark, d), V.articles(spark, d))


@query(f"WITH {V.ARTICLES}, {_GRAPH}, {_GSCORE} SELECT page_id, title FROM articles WHERE page_id IN (SELECT page_id FROM gs)")
def graph_scope_semi(spark: SparkSession, d: str) -> DataFrame:
    """FLT-11, JOI-16."""
    a = V.articles(spark, d)
    return retrieval.restrict_to_graph(a, graph.graph_scores(_graph(spark, d), a)).select("page_id", "title")


@query(_ART + " SELECT page_id, country FROM articles WHERE country = 'en' OR regexp_matches(country, '(?:^|[\\[\\],;|])\\s*[''\"]?en[''\"]?\\s*(?:$|[\\],;|])')")
def country_restrict(spark: SparkSession, d: str) -> DataFrame:
    """FLT-9."""
    return V.articles(spark, d).filter(retrieval.country_match(" En")).select("page_id", "country")


_LEN = "length(first_paragraph)"
_QUALITY = f"""(CASE WHEN is_list_article THEN -5.0 ELSE 0 END + CASE WHEN {_LEN} < 160 AND length(full_text) < 800 THEN -2.5 ELSE 0 END + CASE WHEN entity_class <> 'other' THEN 0.75 ELSE 0 END
  + CASE WHEN {_LEN} >= 240 THEN 1.0 ELSE 0 END + CASE WHEN {_LEN} < 80 THEN -0.75 ELSE 0 END)"""
# The kinds that the articles' role has: a person, an event, places, a work, an organisation; a rock is none of them.
_CLASS = "CASE kind WHEN 'Human' THEN 'person' WHEN 'battle' THEN 'event' WHEN 'Museum' THEN 'place' WHEN 'city' THEN 'place' WHEN 'novel' THEN 'work' WHEN 'Company' THEN 'organization' ELSE 'other' END"


def _filled(c: str) -> str:
    if c == "instance_of":
        return "kind IS NOT NULL"
    return f"({c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) NOT IN ('', '[]', '{{}}', 'null', 'None'))"


# Weights of the fields of each class.
_FIELDS = {
    "person": ("wikidata_id 1.0", "instance_of 1.0", "occupation 1.0", "birth_date 0.6", "death_date 0.6", "country 0.4"),
    "place": ("wikidata_id 1.0", "instance_of 1.0", "country 0.7", "location 0.7", "lat 0.5", "lon 0.5", "inception 0.4"),
    "event": ("wikidata_id 1.0", "instance_of 1.0", "country 0.4", "location 0.4", "start_time 0.6", "end_time 0.6", "point_in_time 0.6"),
    "work": ("wikidata_id 1.0", "instance_of 1.0", "country 0.4", "inception 0.6"),
    "other": ("wikidata_id 1.0", "instance_of 1.0", "country 0.4", "location 0.4", "inception 0.4", "point_in_time 0.4"),
}
_WHOLE = {"person": 4.6, "place": 4.8, "event": 4.6, "work": 3.0, "other": 3.6}
_COMPLETE = "CASE entity_class " + " ".join(f"WHEN '{k}' THEN (" + " + ".join(f"CASE WHEN {_filled(x.split()[0])} THEN {x.split()[1]} ELSE 0 END" for x in fields) + f") / {_WHOLE[k]}" for k, fields in _FIELDS.items()) + " ELSE 0 END"
_FEATURED = f"featured AS (SELECT *, CAST({_QUALITY} AS DOUBLE) AS quality_score, CAST({_COMPLETE} AS DOUBLE) AS completeness FROM (SELECT *, {_CLASS} AS entity_class FROM articles))"


def _featured(spark: SparkSession, d: str) -> DataFrame:
    a = V.articles(spark, d).withColumn("entity_class", ranking.entity_class(F.col("instance_of")))
    return a.withColumns({"first_paragraph_length": F.length("first_paragraph"), "full_text_length": F.length("full_text")})


@query(f"WITH {V.ARTICLES}, {_FEATURED} SELECT page_id, entity_class, quality_score FROM featured")
def quality_features(spark: SparkSession, d: str) -> DataFrame:
    """REL-9, PRJ-1."""
    return _featured(spark, d).select("page_id", "entity_class", ranking.quality().alias("quality_score"))


@query(f"WITH {V.ARTICLES}, {_FEATURED} SELECT page_id, round(completeness, 6) AS completeness FROM featured")
def metadata_completeness(spark: SparkSession, d: str) -> DataFrame:
    """REL-8."""
    f = _featured(spark, d)
    return f.select("page_id", F.round(ranking.completeness(f), 6).alias("completeness"))


@query(f"WITH {V.ARTICLES}, {_FEATURED} SELECT page_id, round(1.5 * completeness, 6) AS gain FROM featured")
def importance_gate(spark: SparkSession, d: str) -> DataFrame:
    """REL-10: what a large population adds to the score."""
    f = _featured(spark, d).withColumn("distance_km", F.lit(None).cast("double"))
    big, small = ranking.features(f, 200_000), ranking.features(f, 199_999)
    on, off = big.select("page_id", ranking.score(big, 50.0).alias("a")), small.select("page_id", ranking.score(small, 50.0).alias("b"))
    return on.join(off, "page_id").select("page_id", F.round(F.col("a") - F.col("b"), 6).alias("gain"))


@query(
    "WITH r AS (SELECT doc_id AS page_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (ORDER BY lang, doc_id) AS b FROM documents)"
    " SELECT page_id, round(4.0::DOUBLE / (60 + a) + CASE WHEN page_id % 3 = 0 THEN 5.0::DOUBLE / (60 + b) ELSE 0 END, 9) AS rrf_score, CASE WHEN page_id % 3 = 0 THEN 'bm25_strict,category' ELSE 'bm25_strict' END AS rrf_sources FROM r"
)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """REL-11, RNK-1, AGG-7, SRT-2."""
    docs = V.table(spark, d, "documents").withColumnRenamed("doc_id", "page_id")
    lang = ranking.ranked(docs, "lang").filter("page_id % 3 = 0")
    return ranking.fuse({"bm25_strict": ranking.ranked(docs, F.desc("n_chars")), "category": lang}).select("page_id", _r("rrf_score", 9), "rrf_sources")


@query(
    f"""WITH {V.ARTICLES}, {_FEATURED} SELECT page_id, round((CASE WHEN distance_km IS NULL THEN 0 ELSE greatest(0, 0.5 * (1 - distance_km / 480)) END) + (5 - hop) * 2.0 + quality_score, 6) AS score
FROM (SELECT *, CASE WHEN lat IS NOT NULL THEN {_km(f'{V.LAT}::DOUBLE', f'{V.LON}::DOUBLE')} END AS distance_km FROM featured)"""
)
def score_linear(spark: SparkSession, d: str) -> DataFrame:
    """REL-12, GEO-2, NUM-2."""
    f = ranking.features(_featured(spark, d), None).withColumn("distance_km", geo.haversine(F.lit(V.LAT), F.lit(V.LON), F.col("lat"), F.col("lon")))
    return f.select("page_id", F.round(ranking.score(f, V.RADIUS), 6).alias("score"))


@query(
    """WITH base AS (SELECT doc_id AS page_id, CAST(doc_id % 97 AS DOUBLE) AS score, length(string_split(text, chr(10))[1]) AS ce FROM documents),
best AS (SELECT * FROM base ORDER BY score DESC, page_id LIMIT 50), mm AS (SELECT min(ce) AS lo, max(ce) AS hi FROM best)
SELECT page_id, round(base.score + coalesce((SELECT CASE WHEN hi > lo THEN 5.0 * (best.ce - lo) / CAST(hi - lo AS DOUBLE) ELSE 0 END FROM best, mm WHERE best.page_id = base.page_id), 0), 6) AS score FROM base"""
)
def minmax_rerank(spark: SparkSession, d: str) -> DataFrame:
    """REL-13, AGG-8, NUM-1, TOP-4, with a scorer that measures length."""
    a = V.articles(spark, d).withColumns({"title": F.lit(""), "score": (F.col("page_id") % 97).cast("double"), "distance_km": F.lit(None).cast("double")})
    return ranking.rerank(a, lambda batch: batch.passage.str.len() - 2, V.PLACE).select("page_id", _r("score"))


@query(
    "WITH s AS (SELECT doc_id AS page_id, CASE WHEN doc_id % 13 = 0 THEN CAST(doc_id AS DOUBLE) END AS distance_km, CASE WHEN doc_id % 11 <> 0 THEN CAST(doc_id % 101 AS DOUBLE) END AS score FROM documents)"
    " SELECT * FROM s WHERE distance_km IS NOT NULL UNION ALL SELECT * FROM (SELECT * FROM s WHERE distance_km IS NULL ORDER BY score DESC NULLS LAST, page_id LIMIT 30)"
)
def finalize_topn(spark: SparkSession, d: str) -> DataFrame:
    """TOP-5, SRT-3."""
    return ranking.finalize(_final(spark, d), 30)


def _final(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    return V.table(spark, d, "documents").select(n.alias("page_id"), F.when(n % 13 == 0, n.cast("double")).alias("distance_km"), F.when(n % 11 != 0, (n % 101).cast("double")).alias("score"))


@query("SELECT CAST(count(*) AS BIGINT) AS total_found, CAST(sum(CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS from_coords FROM documents")
def search_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-16."""
    return ranking.stats(_final(spark, d))


def _hybrid(scope: str, linked: bool) -> str:
    """The whole search. scope: a condition on pages that every branch but the mapped ones' distance keeps to; linked: with the graph branch."""
    graph_rows = "SELECT page_id, graph_distance, graph_score FROM gs" if linked else "SELECT CAST(NULL AS BIGINT) AS page_id, 0 AS graph_distance, 0.0 AS graph_score LIMIT 0"
    a, b = V.RARE_WORDS
    words = " OR ".join(f"{_NORM} = '{t}' OR {_NORM} LIKE '{t} %' OR {_NORM} LIKE '% {t}' OR {_NORM} LIKE '% {t} %' OR {_NORM} LIKE '% {t},%'" for t in (a, b))
    return f"""WITH {V.ARTICLES}, {_postings(a, b)}, {V.MEMBERSHIP}, {_FEATURED}, {_GRAPH_OF_ONE}, {_GSCORE}, pages AS (SELECT *, CASE WHEN lat IS NOT NULL THEN {_km(f'{V.LAT}::DOUBLE', f'{V.LON}::DOUBLE')} END AS km FROM featured WHERE NOT is_redirect
), scoped AS (SELECT page_id FROM pages WHERE {scope}
), scored AS (SELECT page_id, CAST({_CATEGORY} AS DOUBLE) AS category_score FROM (SELECT *,
  regexp_matches(category, '(?i)(?:^|[ _(),-]){a}(?:$|[ _(),-])') AS in_city, regexp_matches(category, '(?i)(?:^|[ _(),-]){b}(?:$|[ _(),-])') AS near, regexp_matches(category, '{_PAST}') AS past FROM membership WHERE {words})
), entity AS (SELECT page_id, max(category_score) AS category_score FROM scored JOIN scoped USING (page_id) GROUP BY page_id
), text AS (SELECT * FROM texts JOIN scoped USING (page_id)
), dense_ids AS (SELECT * FROM (SELECT vec_id AS page_id FROM embeddings WHERE vec_id IN (SELECT page_id FROM pages) ORDER BY {_DOT} DESC, vec_id LIMIT 200) JOIN scoped USING (page_id)
), dense AS (SELECT vec_id AS page_id, {_DOT} AS dense_score FROM embeddings WHERE vec_id IN (SELECT page_id FROM dense_ids UNION SELECT page_id FROM text)
), linked AS ({graph_rows}
), cand AS (SELECT page_id FROM text UNION SELECT page_id FROM entity UNION SELECT page_id FROM pages JOIN scoped USING (page_id) WHERE km <= {V.RADIUS} UNION SELECT page_id FROM dense_ids UNION SELECT page_id FROM linked JOIN scoped USING (page_id)
), wide AS (SELECT p.page_id, p.hop, p.quality_score, p.lat, CASE WHEN km <= {V.RADIUS} THEN km END AS distance_km, t.bm25_score, t.tier, e.category_score, d.dense_score, g.graph_score, g.graph_distance
  FROM cand JOIN pages p USING (page_id) LEFT JOIN text t USING (page_id) LEFT JOIN entity e USING (page_id) LEFT JOIN dense d USING (page_id) LEFT JOIN linked g USING (page_id)
), far AS (SELECT *, tier IS NOT NULL AND bm25_score >= 1 AS in_text FROM wide WHERE distance_km IS NULL AND lat IS NULL
), rr AS (
  SELECT page_id, 4.0::DOUBLE / (60 + row_number() OVER (ORDER BY bm25_score DESC, page_id)) AS w FROM far WHERE in_text AND tier = 2 UNION ALL
  SELECT page_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY bm25_score DESC, page_id)) FROM far WHERE in_text AND tier = 1 UNION ALL
  SELECT page_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY dense_score DESC, page_id)) FROM far WHERE dense_score IS NOT NULL UNION ALL
  SELECT page_id, 5.0::DOUBLE / (60 + row_number() OVER (ORDER BY category_score DESC, quality_score DESC, page_id)) FROM far WHERE category_score > 0
), fused AS (SELECT page_id, sum(w) AS rrf_score FROM rr GROUP BY page_id
), found AS (SELECT page_id, distance_km, CASE WHEN distance_km IS NOT NULL THEN 'coordinates' WHEN in_text THEN 'bm25' WHEN dense_score IS NOT NULL THEN 'dense' WHEN category_score > 0 THEN 'category' ELSE 'graph' END AS result_source,
    100 * coalesce(rrf_score, 0) + CASE WHEN distance_km IS NULL THEN 0 ELSE greatest(0, 0.5 * (1 - distance_km / 480)) END + (5 - hop) * 2.0 + quality_score + 4 * coalesce(category_score, 0) AS score
  FROM (SELECT *, false AS in_text FROM wide WHERE distance_km IS NOT NULL UNION ALL SELECT * FROM far WHERE in_text OR dense_score IS NOT NULL OR category_score > 0 OR graph_score IS NOT NULL) LEFT JOIN fused USING (page_id))
SELECT page_id, result_source, round(score, 5) AS score FROM (SELECT * FROM found WHERE distance_km IS NOT NULL UNION ALL SELECT * FROM (SELECT * FROM found WHERE distance_km IS NULL ORDER BY score DESC, page_id LIMIT 150))"""


_GRAPH_OF_ONE = "graph AS (SELECT replace(title, ' ', '_') AS article_title, CAST(page_id % 3 AS INT) AS graph_distance FROM articles WHERE page_id % 7 = 3)"


def _engine(spark: SparkSession, d: str, **more: DataFrame) -> E.Engine:
    return E.Engine(_featured(spark, d), V.membership(spark, d), V.vectors(spark, d), text=V.text_index(spark, d), **more)


@query(_hybrid("true", False))
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """REL-1 to REL-14, API-1: the flagship."""
    found, _ = _engine(spark, d).search(V.RARE_PLACE, V.LAT, V.LON, V.RADIUS, query_vector=V.query_vector(spark, d))
    return found.select("page_id", "result_source", _r("score", 5))


@query(_hybrid("page_id IN (SELECT page_id FROM gs)", True))
def linked_search(spark: SparkSession, d: str) -> DataFrame:
    """GRF-6, FLT-11, JOI-8, REL-6: the search within a city's link graph."""
    found, _ = _engine(spark, d, city_graph=_graph(spark, d)).search(V.RARE_PLACE, V.LAT, V.LON, V.RADIUS, geoname_id=3, linked_only=True, query_vector=V.query_vector(spark, d))
    return found.select("page_id", "result_source", _r("score", 5))


@query(_hybrid("lower(trim(country)) = 'en' OR regexp_matches(lower(country), '(?:^|[\\[\\],;|])\\s*[''\"]?en[''\"]?\\s*(?:$|[\\],;|])')", False).replace("vec_id IN (SELECT page_id FROM pages)", "vec_id IN (SELECT page_id FROM pages WHERE lower(trim(country)) = 'en')"))
def country_search(spark: SparkSession, d: str) -> DataFrame:
    """FLT-9, FLT-10, REL-5: the search within a country."""
    found, _ = _engine(spark, d).search(V.RARE_PLACE, V.LAT, V.LON, V.RADIUS, country=" En", query_vector=V.query_vector(spark, d))
    return found.select("page_id", "result_source", _r("score", 5))


@query(_TXT + ", r AS (SELECT page_id, exact_title_match, lead_exact_match, page_id % 5 = 0 AS ent, page_id % 3 = 0 AS near FROM texts) SELECT page_id, CASE WHEN exact_title_match THEN 'City in title' WHEN lead_exact_match THEN 'City in introduction' WHEN ent THEN 'City in location metadata' WHEN near THEN 'Mapped nearby' ELSE 'City mentioned in article' END AS match_reason FROM r")
def match_reason(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-2."""
    t = postings.text_candidates(V.text_index(spark, d), V.PLACE).withColumn("entity_associated", F.col("page_id") % 5 == 0)
    return t.withColumn("result_source", F.when(F.col("page_id") % 3 == 0, "coordinates").otherwise("bm25")).select("page_id", retrieval.match_reason().alias("match_reason"))


_DATE = "coalesce(" + ", ".join(f"nullif({c}, '')" for c in ("point_in_time", "start_time", "birth_date", "inception", "end_time", "death_date", "dissolved")) + ")"
_DATED = f"dated AS (SELECT *, TRY_CAST(regexp_extract(trim(canonical_date), '^(-?\\d+)(?:-|$)', 1) AS INT) AS year FROM (SELECT *, {_DATE} AS canonical_date FROM articles))"


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return V.articles(spark, d).withColumn("canonical_date", dates.canonical_date()).withColumn("year", dates.signed_year(F.col("canonical_date")))


@query(_ART + f" SELECT page_id, {_DATE} AS canonical_date FROM articles")
def canonical_date(spark: SparkSession, d: str) -> DataFrame:
    """DAT-2."""
    return _dated(spark, d).select("page_id", "canonical_date")


@query(f"WITH {V.ARTICLES}, {_DATED} SELECT page_id, year FROM dated")
def signed_year(spark: SparkSession, d: str) -> DataFrame:
    """DAT-3."""
    return _dated(spark, d).select("page_id", "year")


@query(f"WITH {V.ARTICLES}, {_DATED} SELECT page_id, year FROM dated WHERE year IS NULL OR year BETWEEN -5000 AND 2025")
def year_window(spark: SparkSession, d: str) -> DataFrame:
    """FLT-4."""
    return dates.year_window(_dated(spark, d)).select("page_id", "year")


@query(f"WITH {V.ARTICLES}, {_DATED} SELECT page_id, year FROM dated WHERE year IS NOT NULL")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    """SRT-4."""
    return dates.timeline(_dated(spark, d)).select("page_id", "year")


@query("SELECT o_orderkey, nullif(string_split('+' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), 'T')[1][2:], '') AS cleaned FROM orders")
def date_clean(spark: SparkSession, d: str) -> DataFrame:
    """DAT-1."""
    return V.table(spark, d, "orders").select("o_orderkey", dates.clean_date(F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("cleaned"))


@query(_ART + " SELECT page_id, lat, lon FROM articles WHERE NOT is_redirect AND lat IS NOT NULL AND lon IS NOT NULL")
def coordinates_layer(spark: SparkSession, d: str) -> DataFrame:
    """FLT-13, API-3."""
    return E.Engine(V.articles(spark, d), V.membership(spark, d)).coordinates()


@query(_ART + " SELECT page_id, title, country FROM articles WHERE page_id = 42 AND NOT is_redirect")
def article_lookup(spark: SparkSession, d: str) -> DataFrame:
    """FLT-12, API-2."""
    return E.Engine(V.articles(spark, d), V.membership(spark, d)).article(42).select("page_id", "title", "country")


@query(_ART + " SELECT CAST(floor(lat / 15) AS BIGINT) AS row, CAST(floor(lon / 15) AS BIGINT) AS column_, CAST(count(*) AS BIGINT) AS n FROM articles WHERE lat IS NOT NULL GROUP BY ALL")
def map_clusters(spark: SparkSession, d: str) -> DataFrame:
    """GEO-4."""
    return geo.clusters(V.articles(spark, d), 15.0).select("row", F.col("column").alias("column_"), "n")


_FOLD = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_ALIASES = f"""aliases AS (SELECT DISTINCT {_FOLD.format('a')} AS normalized_alias, geoname_id FROM (SELECT geoname_id, unnest([name, name || ' ' || country_name, name || ' ' || country_code,
  CASE WHEN country_code = 'US' THEN name || ' ' || admin1_name END, CASE WHEN country_code = 'US' THEN name || ' ' || admin1_code END, CASE WHEN country_code = 'US' THEN name || ' ' || admin1_name || ' ' || country_name END,
  CASE WHEN country_code = 'US' THEN name || ' ' || admin1_code || ' US' END]) AS a FROM cities) WHERE a IS NOT NULL AND length({_FOLD.format('a')}) >= 2)"""


@query(f"WITH {V.CITIES}, {_ALIASES} SELECT * FROM aliases")
def city_aliases(spark: SparkSession, d: str) -> DataFrame:
    """TXT-5, TXT-8, TXT-9, FLT-16."""
    return text.city_aliases(V.cities(spark, d))


@query(f"WITH {V.CITIES}, {_ALIASES} SELECT geoname_id, name, population FROM cities JOIN aliases USING (geoname_id) WHERE normalized_alias = 'nation 7' ORDER BY population DESC, geoname_id LIMIT 1")
def city_resolve(spark: SparkSession, d: str) -> DataFrame:
    """TOP-1, JOI-5, API-5."""
    c = V.cities(spark, d)
    return E.Engine(V.articles(spark, d), V.membership(spark, d), cities=c, aliases=text.city_aliases(c)).resolve_city(" NATION-7 ").select("geoname_id", "name", "population")


_TITLES = """titles AS (SELECT geoname_id, population, title_key, match_type FROM (SELECT geoname_id, population, u.t AS title_key, u.k AS match_type, row_number() OVER (PARTITION BY geoname_id, u.t ORDER BY u.o) AS rn FROM (
  SELECT geoname_id, population, unnest([{'t': lower(name), 'k': 'exact_name', 'o': 0}, {'t': lower(name || ' (' || admin1_name || ')'), 'k': 'state_disambiguation', 'o': 1}, {'t': lower(name || ' (' || admin1_code || ')'), 'k': 'state_code_disambiguation', 'o': 2},
  {'t': CASE WHEN country_code <> 'US' THEN lower(name || ' (' || country_name || ')') END, 'k': 'country_disambiguation', 'o': 3}, {'t': CASE WHEN country_code <> 'US' THEN lower(name || ' (' || country_code || ')') END, 'k': 'country_code_disambiguation', 'o': 4},
  {'t': lower(name || ', ' || admin1_name), 'k': 'comma_state', 'o': 5}, {'t': lower(name || ', ' || admin1_code), 'k': 'comma_state_code', 'o': 6},
  {'t': CASE WHEN country_code <> 'US' THEN lower(name || ', ' || country_name) END, 'k': 'comma_country', 'o': 7}, {'t': CASE WHEN country_code <> 'US' THEN lower(name || ', ' || country_code) END, 'k': 'comma_country_code', 'o': 8}]) AS u FROM (SELECT * REPLACE (replace(name, '_', ' ') AS name) FROM cities)) WHERE u.t IS NOT NULL) WHERE rn = 1)"""


@query(f"WITH {V.CITIES}, {_TITLES} SELECT geoname_id, title_key, match_type, s_suppkey AS page_id FROM titles JOIN (SELECT s_suppkey, replace(lower(n_name), '_', ' ') || CASE WHEN s_suppkey % 3 = 0 THEN ', ' || lower(r_name) ELSE '' END AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) ON k = title_key")
def city_title_match(spark: SparkSession, d: str) -> DataFrame:
    """TXT-6, TXT-7, JOI-13."""
    titles = text.title_candidates(V.cities(spark, d)).select("geoname_id", "title_key", "match_type")
    s = V.table(spark, d, "supplier").join(V.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pages = s.select(F.col("s_suppkey").alias("page_id"), text.title_key(F.concat("n_name", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(",_"), "r_name")).otherwise(F.lit("")))).alias("title_key"))
    return titles.join(pages, "title_key").select("geoname_id", "title_key", "match_type", "page_id")


@query(
    "WITH m AS (SELECT c_custkey AS geoname_id, c_mktsegment || c_nationkey AS title_key, CASE WHEN c_nationkey % 2 = 0 OR c_custkey % 9 <> 0 THEN 'exact_name' ELSE 'comma_state' END AS match_type, CAST(c_custkey % 50 AS BIGINT) AS population FROM customer)"
    " SELECT * FROM m QUALIFY NOT bool_and(match_type = 'exact_name') OVER (PARTITION BY title_key) OR population = max(population) OVER (PARTITION BY title_key)"
)
def largest_population_rule(spark: SparkSession, d: str) -> DataFrame:
    """AGG-9."""
    c = V.table(spark, d, "customer")
    kind = F.when((F.col("c_nationkey") % 2 == 0) | (F.col("c_custkey") % 9 != 0), "exact_name").otherwise("comma_state")
    m = c.select(F.col("c_custkey").alias("geoname_id"), F.concat("c_mktsegment", "c_nationkey").alias("title_key"), kind.alias("match_type"), (F.col("c_custkey") % 50).alias("population"))
    return aggregates.largest_population(m)


_CBFS = "WITH RECURSIVE " + V.CATEGORY_EDGES + ", walk AS (SELECT 'History' AS category, 0 AS hop UNION SELECT child, hop + 1 FROM walk JOIN edges ON parent = category WHERE hop < 4), hops AS (SELECT category, min(hop) AS hop FROM walk GROUP BY category)"


@query(_CBFS + " SELECT category, CAST(hop AS INT) AS hop FROM hops")
def category_bfs(spark: SparkSession, d: str) -> DataFrame:
    """GRF-1, SET-3, C5."""
    return graph.category_hops(V.category_edges(spark, d))


@query(_CBFS + " SELECT c_custkey AS page_id, c_mktsegment AS category, CAST(hop AS INT) AS hop FROM customer JOIN hops ON category = c_mktsegment")
def hop_membership(spark: SparkSession, d: str) -> DataFrame:
    """JOI-12."""
    return graph.hop_membership(V.table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.col("c_mktsegment").alias("category")), graph.category_hops(V.category_edges(spark, d)))


@query(f"WITH {V.MEMBERSHIP} SELECT hop, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT page_id) AS BIGINT) AS n_pages FROM membership GROUP BY hop")
def hop_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AGG-2, AGG-12."""
    return aggregates.hop_histogram(V.membership(spark, d))


@query(f"WITH {V.MEMBERSHIP} SELECT hop, array_to_string(list_sort(list(DISTINCT category)), ';') AS categories FROM membership GROUP BY hop")
def hop_categories(spark: SparkSession, d: str) -> DataFrame:
    """SNK-8."""
    return aggregates.hop_categories(V.membership(spark, d)).withColumn("categories", F.array_join("categories", ";"))


@query(f"WITH {V.MEMBERSHIP} SELECT page_id, min(hop) AS min_hop FROM membership GROUP BY page_id")
def min_hop(spark: SparkSession, d: str) -> DataFrame:
    """AGG-1."""
    return aggregates.min_hop(V.membership(spark, d))


@query(
    f"""WITH RECURSIVE {V.EDGES}, walk AS (SELECT page_id AS city, CAST(page_id AS VARCHAR) AS node, 0 AS dist FROM pages WHERE page_id % 20 = 0 UNION SELECT city, dst, dist + 1 FROM walk JOIN edges ON src = node WHERE dist < 2),
best AS (SELECT city, node, min(dist) AS distance FROM walk GROUP BY city, node)
SELECT b.city, b.node, CAST(b.distance AS INT) AS distance, (SELECT min(src) FROM edges JOIN best p ON p.node = src AND p.city = b.city AND p.distance = b.distance - 1 WHERE dst = b.node) AS parent FROM best b"""
)
def link_bfs(spark: SparkSession, d: str) -> DataFrame:
    """GRF-2, JOI-14: searches from the stated query set, every page whose id is divisible by 20, over all pages."""
    seeds = V.table(spark, d, "pages").filter("page_id % 20 = 0").select(F.col("page_id").alias("city"), F.col("page_id").cast("string").alias("node"))
    return graph.bfs(graph.cut(V.page_edges(spark, d)), seeds, 2, ("city",))


@query(
    f"""WITH {V.ARTICLES}, {V.MEMBERSHIP}, h AS (SELECT page_id, min(hop) AS hop FROM membership GROUP BY page_id), {_DATED}
SELECT page_id, h.hop, year, {_CLASS} AS entity_class, regexp_matches(title, '^Lists? of ') AS is_list_article FROM dated JOIN h USING (page_id) WHERE year IS NULL OR year BETWEEN -5000 AND 2025"""
)
def article_index_join(spark: SparkSession, d: str) -> DataFrame:
    """JOI-2, FLT-4, REL-15."""
    a = V.articles(spark, d)
    meta = a.select("page_id", "title", "wikidata_id", "instance_of", "point_in_time", "start_time", "birth_date", "inception", "end_time", "death_date", "dissolved")
    out = E.article_index(a.select("page_id", "title", "first_paragraph", "full_text", "is_redirect"), meta, V.membership(spark, d))
    return out.select("page_id", "hop", "year", "entity_class", "is_list_article")


@query(_ART + f", {V.MEMBERSHIP} SELECT page_id, title, category, membership.hop FROM articles JOIN membership USING (page_id)")
def membership_broadcast_join(spark: SparkSession, d: str) -> DataFrame:
    """JOI-1; Spark broadcasts a side only below its size threshold."""
    return V.articles(spark, d).select("page_id", "title").join(V.membership(spark, d), "page_id")


@query(_ART + f" SELECT page_id, {_CLASS} AS entity_class FROM articles")
def entity_class(spark: SparkSession, d: str) -> DataFrame:
    """REL-15, SET-2."""
    return V.articles(spark, d).select("page_id", ranking.entity_class(F.col("instance_of")).alias("entity_class"))


@query(_ART + f" SELECT {_CLASS} AS entity_class, CAST(count(*) AS BIGINT) AS n FROM articles GROUP BY ALL")
def class_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11."""
    return aggregates.histogram(V.articles(spark, d).withColumn("entity_class", ranking.entity_class(F.col("instance_of"))), "entity_class")


@query(_ART + " " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS filled, round(count({c}) * 100.0::DOUBLE / count(*), 4) AS percent FROM articles" for c in ("lat", "occupation", "wikidata_id")))
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11."""
    return aggregates.coverage(V.articles(spark, d), ["lat", "occupation", "wikidata_id"])


@query(
    "WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS question, CASE WHEN turn % 2 = 1 THEN text END AS answer, role FROM conversations)"
    " SELECT conv_id, arg_min(question, turn) FILTER (question IS NOT NULL) AS question, arg_min(answer, turn) FILTER (answer IS NOT NULL) AS answer,"
    " (SELECT string_agg(role, ',' ORDER BY t) FROM (SELECT role, min(turn) AS t FROM c x WHERE x.conv_id = c.conv_id GROUP BY role)) AS roles FROM c GROUP BY conv_id"
)
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    """AGG-5."""
    c = V.table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("question"), F.when(F.col("turn") % 2 == 1, F.col("text")).alias("answer"), "role")
    return aggregates.merge_metadata(c, "conv_id", "turn", ["question", "answer"], ["role"]).select("conv_id", "question", "answer", F.array_join("role", ",").alias("roles"))


# The ordered cleanup, for RE2, whose white space lacks the vertical tab.
_STEPS = (
    (r"(?is)<!--.*?-->", ""),
    (r"(?im)^\s*(?:(?:\d+(?:\.\d+)?px|x\d+(?:\.\d+)?px)\s*\|\s*)?(?:thumb|right|left|center|frame|frameless|border|upright(?:\s*=\s*[^|\n]+)?)(?:\|.*)?\s*$", ""),
    (r"(?im)^\s*(?:\d+(?:\.\d+)?px|x\d+(?:\.\d+)?px)\s*\|.*$", ""),
    (r"(?is)<ref\b[^>]*>.*?</ref\s*>", ""),
    (r"(?i)<ref\b[^>]*/\s*>", ""),
    (r"<[^>]+>", ""),
    (r"(?is)\{\{.*?\}\}", ""),
    (r"\[\[([^\]|]+)\|([^\]]+)\]\]", r"\2"),
    (r"\[\[([^\]]+)\]\]", r"\1"),
    (r"\[https?://[^\s\]]+\s+([^\]]+)\]", r"\1"),
    (r"'{2,5}", ""),
    (r"(?m)^\s*[|!][^\n]*$", ""),
    (r"(?m)^\s*\{\|.*$|^\s*\|\}.*$", ""),
    (r"(?m)^\s*={2,6}\s*(.*?)\s*={2,6}\s*$", r"\1"),
    (r"(?m)^\s*[*#;:]\s*", ""),
    (r"[ \t]+", " "),
)
_EDGES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _clean_sql(c: str) -> str:
    out = f"coalesce({c}, '')"
    for pattern, to in _STEPS:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), to)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return rf"regexp_replace(regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_EDGES}+|{_EDGES}+$', '', 'g')"


@query(f"SELECT page_id, length({_clean_sql('html')}) AS n, md5({_clean_sql('html')}) AS digest FROM pages")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """TXT-2."""
    c = V.table(spark, d, "pages").select("page_id", text.clean_text(F.col("html")).alias("t"))
    return c.select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query(f"SELECT page_id, md5(CASE WHEN page_id % 2 = 0 THEN trim(regexp_replace(string_split({_clean_sql('html')}, chr(10) || chr(10))[1], '^\\s+|\\s+$', '', 'g')) ELSE {_clean_sql('url')} END) AS digest FROM pages")
def article_lead(spark: SparkSession, d: str) -> DataFrame:
    """TXT-3."""
    first = F.when(F.col("page_id") % 2 == 0, F.lit("<b></b>")).otherwise(F.col("url"))
    return V.table(spark, d, "pages").select("page_id", F.md5(text.article_lead(first, F.col("html"))).alias("digest"))


@query("SELECT doc_id AS page_id, CAST(len(p) AS INT) AS n, md5(array_to_string(p, chr(10))) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '<[^>]+>', '', 'g'), chr(10)), lambda x : regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x : length(x) > 50) AS p FROM documents)")
def paragraph_extract(spark: SparkSession, d: str) -> DataFrame:
    """TXT-1 on texts without wiki markup."""
    p = V.table(spark, d, "documents").select("doc_id", text.paragraphs(F.col("text")).alias("p"))
    return p.select(F.col("doc_id").alias("page_id"), F.size("p").alias("n"), F.md5(F.array_join("p", "\n")).alias("digest"))


_CITED = r"""cited AS (SELECT o_orderkey AS page_id, 'Seen in ' || strftime(o_orderdate, '%Y') || '. Works of ' || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN ': Oxford University Press, ' || strftime(o_orderdate, '%Y') WHEN o_orderkey % 3 = 1 THEN ' in journal vol. 3, ' || strftime(o_orderdate, '%Y')
  ELSE ' of ' || strftime(o_orderdate, '%Y') END || '! No year here.' || chr(10) || 'End ' || o_orderkey AS full_text FROM orders),
sentences AS (SELECT page_id, u AS sentence FROM (SELECT page_id, unnest(string_split_regex(regexp_replace(full_text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+')) AS u FROM cited)),
found AS (SELECT * FROM sentences WHERE regexp_matches(sentence, '\b(?:18|19|20)\d{2}\b') AND (regexp_matches(sentence, ':[^.!?]{0,120},\s*(?:18|19|20)\d{2}\b')
  OR len(regexp_extract_all(sentence, '(?i)\b(?:press|publisher|publishing|university press|journal|vol\.?|volume|pp?\.?|pages|isbn|doi|retrieved|accessed)\b')) >= 2))"""


def _cited(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders")
    y, k = F.date_format("o_orderdate", "yyyy"), F.col("o_orderkey") % 3
    middle = F.when(k == 0, F.concat(F.lit(": Oxford University Press, "), y)).when(k == 1, F.concat(F.lit(" in journal vol. 3, "), y)).otherwise(F.concat(F.lit(" of "), y))
    return o.select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("Seen in "), y, F.lit(". Works of "), "o_orderpriority", middle, F.lit("! No year here.\nEnd "), "o_orderkey").alias("full_text"))


@query(f"WITH {_CITED} SELECT page_id, sentence FROM found")
def citation_sentences(spark: SparkSession, d: str) -> DataFrame:
    """TXT-15, TXT-16, SNK-12."""
    return text.citation_sentences(_cited(spark, d)).select("page_id", "sentence")


@query(f"WITH {_CITED} SELECT CAST(count(*) AS BIGINT) AS n_sentences, CAST(count(DISTINCT page_id) AS BIGINT) AS n_pages FROM found")
def citation_counts(spark: SparkSession, d: str) -> DataFrame:
    """TXT-15, AGG-12."""
    return text.citation_sentences(_cited(spark, d)).agg(F.count("*").alias("n_sentences"), F.count_distinct("page_id").alias("n_pages"))


@query(_ART + " SELECT page_id FROM articles WHERE length(first_paragraph) > 50")
def embedding_eligible(spark: SparkSession, d: str) -> DataFrame:
    """FLT-5."""
    return vectors.eligible(V.articles(spark, d)).select("page_id")


@query(_ART + " SELECT page_id FROM articles WHERE page_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """JOI-16, SET-3, SNK-4, SNK-7."""
    return aggregates.missing(V.articles(spark, d).select("page_id"), V.vectors(spark, d), "page_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    """SNK-3."""
    return aggregates.first_by(V.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13."""
    return aggregates.duplicates(V.table(spark, d, "lineitem"), "l_orderkey")


@query(_ART + " SELECT CAST(count(*) AS BIGINT) AS n_rows, 'articles' AS table_name, '1' AS version FROM articles UNION ALL SELECT count(*), 'vectors', '1' FROM embeddings")
def build_manifest(spark: SparkSession, d: str) -> DataFrame:
    """SNK-9, SNK-10."""
    return B.manifest({"articles": V.articles(spark, d), "vectors": V.vectors(spark, d)})


_SHOWN = """SELECT doc_id AS page_id, 't' AS title, CASE WHEN doc_id % 11 <> 0 THEN CAST(doc_id % 101 AS DOUBLE) ELSE 0.0 END AS score, CASE WHEN doc_id % 13 = 0 THEN CAST(doc_id AS DOUBLE) END AS distance_km
  FROM (SELECT doc_id FROM documents WHERE doc_id % 13 = 0 UNION ALL SELECT doc_id FROM (SELECT doc_id FROM documents WHERE doc_id % 13 <> 0 ORDER BY CASE WHEN doc_id % 11 <> 0 THEN doc_id % 101 END DESC NULLS LAST, doc_id LIMIT 30))"""


@query(f"WITH shown AS ({_SHOWN}) SELECT CAST(row_number() OVER (ORDER BY score DESC, page_id) AS INT) AS place, page_id, score, distance_km, (SELECT CAST(count(*) AS BIGINT) FROM documents) AS found FROM shown")
def cache_payload(spark: SparkSession, d: str) -> DataFrame:
    """TXT-18, API-1, API-8, PRJ-3: a response written as JSON and read back."""
    a = _final(spark, d).withColumns({"title": F.lit("t"), "first_paragraph": F.lit("p"), "entity_class": F.lit(None).cast("string"), "country": F.lit(""), "lat": F.lit(float("nan")), "lon": F.lit(None).cast("double"), "result_source": F.lit("bm25"), "match_reason": F.lit("m")})
    one = api.response(api.Location("x", 0.0, 0.0), api.cards(ranking.finalize(a, 30)), ranking.stats(a))
    back = api.parsed(one).select(F.posexplode("connected").alias("i", "c"), "counts")
    return back.select((F.col("i") + 1).alias("place"), "c.page_id", "c.score", "c.distance_km", F.col("counts.connected").alias("found"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extension: windows over events."""
    from chronoplace.streaming import event_windows as windows

    return windows(V.table(spark, d, "events")).withColumn("total", F.round("total", 4))
