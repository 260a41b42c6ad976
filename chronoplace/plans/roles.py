"""The driver's tables in the engine's roles (survey 7.2), once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplace.operators.postings import TextIndex
from chronoplace.shared import exists, version

PLACE, CITY, WORDS = "that, with", "that", ["that", "with"]
#: A place whose words tell pages apart, for whole searches.
RARE_PLACE, RARE_WORDS = "thing, and", ["thing", "and"]
LAT, LON, RADIUS = 12.5, 30.25, 480.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: coordinates, dates and types follow from the key by rule."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    line = F.split("text", "\n")[0]
    pick = lambda mod, values: F.try_element_at(F.array(*(F.lit(v).cast("string") for v in values)), (n % mod + 1).cast("int"))
    return d.select(
        n.alias("page_id"),
        F.array_join(F.slice(F.split(line, " "), 1, 3), " ").alias("title"),
        line.alias("first_paragraph"),
        F.col("text").alias("full_text"),
        (n % 17 == 0).alias("is_redirect"),
        F.when(n % 3 != 0, ((n * 7919) % 18000).cast("double") / 100 - 90).alias("lat"),
        F.when(n % 3 != 0, ((n * 104729) % 36000).cast("double") / 100 - 180).alias("lon"),
        F.when(n % 11 == 0, F.concat(F.lit('["'), "lang", F.lit('"]'))).otherwise(F.col("lang")).alias("country"),
        F.concat("source", F.lit(", "), "lang").alias("location"),
        (n % 6).cast("int").alias("hop"),
        (n % 29 == 0).alias("is_list_article"),
        F.when(n % 5 != 0, F.concat(F.lit("Q"), n.cast("string"))).alias("wikidata_id"),
        pick(8, ["Human", "battle", "Museum", "novel", "Company", "rock", None, "city"]).alias("kind"),
        F.when(n % 4 == 0, "writer").alias("occupation"),
        pick(7, [None, "", "1815-06-18", "-0044-03-15", None, "unknown", "1999"]).alias("point_in_time"),
        pick(5, [None, "2024", "", "1066-10-14", None]).alias("start_time"),
        pick(3, ["1756-01-27", None, "-6000"]).alias("birth_date"),
        F.lit(None).cast("string").alias("inception"),
        pick(9, [None, "1914-07-28", "", None, None, "1920", None, None, None]).alias("end_time"),
        F.lit(None).cast("string").alias("death_date"),
        F.lit("9999").alias("dissolved"),
    ).withColumn("instance_of", F.when(F.col("kind").isNotNull(), F.array("kind")))


_PICK = "list_extract([{}], CAST(doc_id % {} AS INT) + 1)"
ARTICLES = f"""articles AS (
  SELECT doc_id AS page_id, array_to_string(list_slice(string_split(line, ' '), 1, 3), ' ') AS title, line AS first_paragraph, text AS full_text,
    doc_id % 17 = 0 AS is_redirect,
    CASE WHEN doc_id % 3 <> 0 THEN CAST((doc_id * 7919) % 18000 AS DOUBLE) / CAST(100 AS DOUBLE) - 90 END AS lat,
    CASE WHEN doc_id % 3 <> 0 THEN CAST((doc_id * 104729) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - 180 END AS lon,
    CASE WHEN doc_id % 11 = 0 THEN '["' || lang || '"]' ELSE lang END AS country, source || ', ' || lang AS location,
    CAST(doc_id % 6 AS INT) AS hop, doc_id % 29 = 0 AS is_list_article, CASE WHEN doc_id % 5 <> 0 THEN 'Q' || doc_id END AS wikidata_id,
    {_PICK.format("'Human','battle','Museum','novel','Company','rock',NULL,'city'", 8)} AS kind,
    CASE WHEN doc_id % 4 = 0 THEN 'writer' END AS occupation,
    {_PICK.format("NULL,'','1815-06-18','-0044-03-15',NULL,'unknown','1999'", 7)} AS point_in_time,
    {_PICK.format("NULL,'2024','','1066-10-14',NULL", 5)} AS start_time,
    {_PICK.format("'1756-01-27',NULL,'-6000'", 3)} AS birth_date, CAST(NULL AS VARCHAR) AS inception,
    {_PICK.format("NULL,'1914-07-28','',NULL,NULL,'1920',NULL,NULL,NULL", 9)} AS end_time, CAST(NULL AS VARCHAR) AS death_date, '9999' AS dissolved
  FROM (SELECT *, string_split(text, chr(10))[1] AS line FROM documents)
)"""


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of articles: two per document, with hops."""
    d = table(spark, sf_dir, "documents")
    one = d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("History_of_"), "source", F.lit("_("), "lang", F.lit(")")).alias("category"), (F.col("doc_id") % 5).cast("int").alias("hop"))
    two = d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("People from "), "lang").alias("category"), (F.col("doc_id") % 3 + 1).cast("int").alias("hop"))
    return one.unionByName(two)


MEMBERSHIP = """membership AS (
  SELECT doc_id AS page_id, 'History_of_' || source || '_(' || lang || ')' AS category, CAST(doc_id % 5 AS INT) AS hop FROM documents
  UNION ALL SELECT doc_id, 'People from ' || lang, CAST(doc_id % 3 + 1 AS INT) FROM documents
)"""


_INDEXES: dict[tuple[str, str], TextIndex] = {}


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The written index of the articles; built again when their files change."""
    source = articles(spark, sf_dir)
    key = spark.sparkContext.applicationId, version(source)
    if key not in _INDEXES or not exists(spark, _INDEXES[key].path):
        _INDEXES[key] = TextIndex.build(source)
    return _INDEXES[key]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """One row: the query of the dense branch."""
    return list(vectors(spark, sf_dir).filter("page_id = 0").first()["embedding"])


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nations as cities; population is the number of customers."""
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("population"))
    n = table(spark, sf_dir, "nation").join(people, "n_nationkey", "left").join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    us = F.col("n_nationkey") % 5 == 0
    return n.select(
        F.col("n_nationkey").cast("long").alias("geoname_id"),
        F.initcap("n_name").alias("name"),
        F.when(us, "US").otherwise(F.upper(F.substring("r_name", 1, 2))).alias("country_code"),
        F.when(us, "United States").otherwise(F.initcap("r_name")).alias("country_name"),
        F.when(us, F.concat(F.lit("S"), "n_nationkey")).alias("admin1_code"),
        F.when(us, F.concat(F.lit("State "), "n_nationkey")).alias("admin1_name"),
        F.coalesce("population", F.lit(0)).cast("long").alias("population"),
    )


CITIES = """cities AS (
  SELECT CAST(n_nationkey AS BIGINT) AS geoname_id, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w : upper(w[1]) || w[2:]), ' ') AS name,
    CASE WHEN n_nationkey % 5 = 0 THEN 'US' ELSE upper(substr(r_name, 1, 2)) END AS country_code,
    CASE WHEN n_nationkey % 5 = 0 THEN 'United States' ELSE array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w : upper(w[1]) || w[2:]), ' ') END AS country_name,
    CASE WHEN n_nationkey % 5 = 0 THEN 'S' || n_nationkey END AS admin1_code, CASE WHEN n_nationkey % 5 = 0 THEN 'State ' || n_nationkey END AS admin1_name,
    CAST(coalesce(population, 0) AS BIGINT) AS population
  FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS population FROM customer GROUP BY 1) ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey
)"""


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between pages and the words of their relative hrefs, both ways: page nodes are ids as text, word nodes are /word."""
    p = table(spark, sf_dir, "pages")
    out = p.select(F.col("page_id").cast("string").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]+)"'), F.lit(1))).alias("dst")).distinct()
    return out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


EDGES = """edges AS (
  SELECT DISTINCT src, dst FROM (SELECT CAST(page_id AS VARCHAR) AS page, unnest(regexp_extract_all(html, 'href="(/[^"]+)"', 1)) AS word FROM pages), LATERAL (VALUES (page, word), (word, page)) AS pair(src, dst)
)"""


def category_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History over regions over nations over market segments."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    top = r.select(F.lit("History").alias("parent"), F.col("r_name").alias("child"))
    middle = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    low = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("parent"), F.col("c_mktsegment").alias("child"))
    back = c.select(F.col("c_mktsegment").alias("parent"), F.lit("History").alias("child"))
    return top.unionByName(middle).unionByName(low).unionByName(back).distinct()


CATEGORY_EDGES = """edges AS (
  SELECT 'History' AS parent, r_name AS child FROM region
  UNION SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT c_mktsegment, 'History' FROM customer
)"""
