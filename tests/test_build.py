"""The offline flow on a small dump: readers, steps, publishing, then search, service and cache over what was built."""

import gzip
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from chronoplace.plans import api, build
from chronoplace.plans.engine import Settings
from chronoplace.sources import metadata, sqldump, xmldump

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't have the tests
LEAD = "{} is a place of which this first paragraph says more than fifty characters."
CITED = "Old works tell more: Oxford University Press, 1987. Nothing here. See journal vol. 3, 1921 for the rest."


def write_dumps(root):
    dumps = root / "dumps"
    dumps.mkdir(parents=True)

    def sql(name, text):
        with gzip.open(dumps / f"{name}.sql.gz", "wt", encoding="utf-8") as file:
            file.write(text)

    # both layouts: a statement on a line, and a header with a tuple on each line
    sql("page", "-- dump\nINSERT INTO `page` VALUES (100,14,'History',0,0.1),(101,14,'History_of_Paris',0,0.2),(102,14,'Wars',0,0.3);\nINSERT INTO `page` VALUES\n(103,14,'It\\'s_unrelated',0,0),\n(1,0,'Paris',0,0),\n(2,0,'Louvre_\\'L\\'',0,0),\n(3,0,'Seine',0,0),\n(4,0,'Paname',1,0),\n(5,0,'Paris,_Texas',0,0);\n")
    sql("linktarget", "INSERT INTO `linktarget` VALUES (201,14,'History'),(202,14,'History_of_Paris'),(203,14,'Wars'),(301,0,'Paris'),(302,0,'Louvre_\\'L\\''),(303,0,'Seine'),(304,0,'Nowhere'),(305,-1,'Special');\n")
    link = lambda a, kind, to: f"({a},'KEY\\'S','2020-01-01 00:00:00','','uppercase','{kind}',1,{to})"
    rows = [link(101, "subcat", 201), link(102, "subcat", 202), link(100, "subcat", 203), link(102, "subcat", 999), link(1, "page", 202), link(2, "page", 202), link(3, "page", 203), link(4, "page", 202), link(5, "page", 202), link(9, "file", 202)]
    sql("categorylinks", "INSERT INTO `categorylinks` VALUES " + ",".join(rows) + ";\n")
    sql("pagelinks", "INSERT INTO `pagelinks` VALUES (1,0,302),(1,0,301),(1,0,304),(2,0,303),(1,14,303);\n")
    page = lambda i, ns, title, body, redirect="": f'<page><title>{title}</title><ns>{ns}</ns><id>{i}</id>{redirect}<revision><id>7</id><text bytes="1">{body}</text></revision></page>'
    pages = [
        page(1, 0, "Paris", "{{Infobox|{{deep|{{deeper}}}}}}\n" + LEAD.format("'''Paris'''") + "\nshort\n" + CITED),
        page(2, 0, "Louvre 'L'", LEAD.format("The [[Paris|museum]]") + "\n[[File:A.jpg|thumb|a [[Seine]] view]]"),
        page(3, 0, "Seine", LEAD.format("The Seine flows through Paris, France, which")),
        page(4, 0, "Paname", "#REDIRECT [[Paris]]", '<redirect title="Paris" />'),
        page(5, 0, "Paris, Texas", LEAD.format("Paris")),
        page(6, 0, "Unwanted", LEAD.format("Unwanted")),
        page(100, 14, "Category:History", "x"),
        page(7, 0, "Short", "tiny"),
    ]
    (dumps / "pages.xml").write_text("<mediawiki>\n" + "\n".join(pages) + "\n</mediawiki>\n", encoding="utf-8")
    value = lambda **kw: json.dumps({k: {"type": "literal", "value": v} for k, v in kw.items()})
    bindings = [
        value(title="Paris", wikidata_id="Q90", lat="48.8566", lon="2.3522", instance_of="city", country="France"),
        value(title="Paris", inception="+0052-01-01T00:00:00Z", instance_of="capital", country="Gaul"),
        value(title="Louvre 'L'", wikidata_id="Q19675", lat="48.8606", lon="2.3376", instance_of="museum", country="France"),
        value(title="Seine", wikidata_id="Q1471", country="France", instance_of="river", lat="not a number"),
        value(title="Paris, Texas", wikidata_id="Q830149", lat="33.66", lon="-95.55", country="United States", point_in_time="-0044-03-15"),
    ]
    (dumps / "bindings.json").write_text("".join(json.dumps({"seq": i, "binding": b}) + "\n" for i, b in enumerate(bindings)))
    city = lambda i, name, lat, lon, code, country, population, state=None: {"geoname_id": i, "name": name, "latitude": lat, "longitude": lon, "country_code": code, "country_name": country, "admin1_code": state and state[:2].upper(), "admin1_name": state, "population": population, "alternate_names": ["Lutèce", "x", "L" * 101] if i == 11 else []}
    cities = [city(11, "Paris", 48.85, 2.35, "FR", "France", 2_138_551), city(12, "Paris", 33.66, -95.55, "US", "United States", 25_171, "Texas"), city(13, "Hamlet", 0.0, 0.0, "FR", "France", 900)]
    (dumps / "cities.json").write_text("".join(json.dumps(c) + "\n" for c in cities))


def model(texts):
    return [[1.0, 0.0] if "Seine" in t else [0.6, 0.8] for t in texts]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("build")
    write_dumps(root)
    spark.createDataFrame([(1, [0.6, 0.8])], "page_id long, embedding array<float>").coalesce(1).write.parquet(str(root / "dumps/embeddings/embeddings_0_1.parquet"))
    b = build.Build(spark, str(root), model=model)
    return b, b.run()


def test_readers(spark, made):
    b, _ = made
    page = {tuple(r) for r in b.dump("page").collect()}
    assert (2, 0, "Louvre_'L'", False) in page and (103, 14, "It's_unrelated", False) in page and (4, 0, "Paname", True) in page and len(page) == 9
    assert (305, -1, "Special") in {tuple(r) for r in b.dump("linktarget").collect()}
    links = b.dump("categorylinks").collect()
    assert len(links) == 10 and {r.cl_type for r in links} == {"subcat", "page", "file"} and {r.sortkey for r in links} == {"KEY'S"}
    assert {tuple(r) for r in b.dump("pagelinks").collect()} == {(1, 0, 302), (1, 0, 301), (1, 0, 304), (2, 0, 303), (1, 14, 303)}
    assert {tuple(r) for r in sqldump.category_edges(b.dump("categorylinks"), b.dump("linktarget"), b.dump("page")).collect()} == {("History", "History_of_Paris"), ("History_of_Paris", "Wars"), ("Wars", "History")}
    pages = {r.page_id: r for r in xmldump.read_pages(spark, b.at("dumps/pages.xml")).collect()}
    assert len(pages) == 8 and pages[4].redirect_target == "Paris" and pages[100].namespace == 14


def test_tables(made):
    b, rows = made
    assert {k: rows[k] for k in ("category_hops", "article_categories", "articles", "metadata", "article_index", "vectors", "cities", "citations", "city_cache")} == {
        "category_hops": 3, "article_categories": 5, "articles": 5, "metadata": 4, "article_index": 5, "vectors": 4, "cities": 2, "citations": 1, "city_cache": 2,
    }
    assert {(r.category, r.hop) for r in b.table("category_hops").collect()} == {("History", 0), ("History_of_Paris", 1), ("Wars", 2)}
    index = {r.page_id: r for r in b.table("article_index").collect()}
    paris = index[1]
    assert paris.first_paragraph == LEAD.format("Paris") and "Infobox" not in paris.full_text and "short" not in paris.full_text
    assert (paris.lat, paris.country, paris.instance_of, paris.year, paris.entity_class, paris.hop) == (48.8566, "France", ["city", "capital"], 52, "place", 1)
    assert index[2].full_text == LEAD.format("The museum") and index[3].lat is None and index[5].year == -44
    assert index[4].is_redirect and index[4].redirect_target == "Paris" and index[4].full_text == ""
    assert {tuple(r) for r in b.table("city_article_matches").select("geoname_id", "page_id", "match_type").collect()} == {(11, 1, "exact_name"), (12, 5, "comma_state")}
    links = {(r.geoname_id, r.article_title, r.graph_distance) for r in b.table("city_links").collect()}
    assert {(11, "Paris", 0), (11, "Louvre_'L'", 1)} <= links and not any(t == "Seine" for _, t, _ in links)
    aliases = {(r.normalized_alias, r.geoname_id) for r in b.table("aliases").collect()}
    assert {("paris", 11), ("paris", 12), ("paris france", 11), ("paris te", 12), ("lutece", 11)} <= aliases and ("x", 11) not in aliases
    assert {r.table_name: r.n_rows for r in build.catalogue(b).collect()}["article_index"] == 5
    assert sorted(r.page_id for r in b.table("vectors").collect()) == [1, 2, 3, 5]


def test_search_and_service(made):
    b, _ = made
    engine = b.engine(Settings(bm25_least=0.0))
    service = api.Service(engine)
    service.warm_up()
    assert service.health() == {"status": "ok"}
    answer = service.search("paris FRANCE", 30.0)
    assert not answer.from_cache and answer.body.query.label == "Paris, France" and answer.seconds["total"] > 0
    mapped, connected = [c.title for c in answer.body.mapped], [c.title for c in answer.body.connected]
    assert sorted(mapped) == ["Louvre 'L'", "Paris"] and "Seine" in connected and "Paris, Texas" not in connected
    assert answer.body.counts.mapped == 2 and answer.body.counts.connected == 3
    scores = [c.score for c in answer.body.connected]
    assert scores == sorted(scores, reverse=True)
    assert {c.title: c.match_reason for c in answer.body.connected if c.title != "Louvre 'L'"} == {"Paris": "City in location metadata", "Seine": "City in introduction"}
    strict = service.search("Paris, France", 30.0, linked_only=True)
    assert "Seine" not in [c.title for c in strict.body.connected]
    assert service.search("Paris", 50.0, 150).from_cache and not service.search("Paris", 50.0, 150, linked_only=True).from_cache
    assert service.search("Paris", 50.0).body.query.label == "Paris, France"
    row = service.article(1)
    assert row.title == "Paris" and row.full_text.startswith(LEAD.format("Paris")) and row.year == 52
    for missing in (4, 999):
        with pytest.raises(api.NotFound):
            service.article(missing)
    assert {r.page_id for r in service.coordinates().collect()} == {1, 2, 5}
    for bad in ({"q": "x"}, {"q": "Paris", "radius_km": 0}, {"q": "Paris", "radius_km": 501}, {"q": "Paris", "limit": 9}, {"q": "Paris", "limit": 501}):
        with pytest.raises(ValueError):
            service.search(**bad)
    with pytest.raises(api.NotFound):
        service.search("Atlantis")
    elsewhere = api.Service(engine, geocoder=lambda q: api.Location(q, 33.66, -95.55) if q == "Atlantis" else None)
    assert [c.title for c in elsewhere.search("Atlantis").body.mapped] == ["Paris, Texas"]
    assert service.build_cache(15000).count() == 0
    scope = lambda least, strict: b.engine(Settings(linked_enough=least)).scope(11, strict)[0]
    assert [scope(2, False), scope(3, False), scope(3, True)] == ["graph", "country", "graph"]


def test_a_restart_finds_stale_and_missing_tables(spark, made, tmp_path):
    b, _ = made
    b.require_current("article_index")
    other = build.Build(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="run step 'articles'"):
        other.run("index")
    with pytest.raises(FileNotFoundError, match="dumps/categorylinks"):
        other.run()
    again = build.Build(spark, str(tmp_path / "again"))
    (tmp_path / "again").mkdir()
    write_dumps(tmp_path / "again")
    again.run("categories", "articles")
    again.require_current("articles")
    with open(again.at("dumps/pages.xml"), "a") as file:
        file.write("\n")
    with pytest.raises(build.Stale, match="run step 'articles'"):
        again.require_current("articles")
    again.run("articles")
    again.require_current("articles")


def test_publishing_is_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    first, second = spark.range(5), spark.range(7)
    assert build.publish(first, path) == 5 and build.publish(second, path, ["id"]) == 7
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["table"]
    broken = second.select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        build.publish(broken, path)
    assert spark.read.parquet(path).count() == 7 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["table"]
    # a build that ends between the two moves leaves the old table aside
    (tmp_path / "table").rename(tmp_path / "table.old-1")
    assert build.recover(spark, path) and spark.read.parquet(path).count() == 7 and not build.recover(spark, path)


def test_checkpoints_and_stores(spark, tmp_path):
    from chronoplace.operators import vectors

    rows = spark.createDataFrame([(2, [0.0, 1.0]), (1, [1.0, 0.0])], "page_id long, embedding array<float>")
    rows.coalesce(1).write.parquet(str(tmp_path / "a/embeddings_10_12.parquet"))
    rows.select((F.col("page_id") + 10).alias("page_id"), "embedding").coalesce(1).write.parquet(str(tmp_path / "a/embeddings_2_10.parquet"))
    store = vectors.read_checkpoints(spark, str(tmp_path / "a"))
    assert sorted(r.page_id for r in vectors.checked(store, 2).collect()) == [1, 2, 11, 12]
    with pytest.raises(ValueError, match="lengths"):
        vectors.checked(store, 3)
    with pytest.raises(ValueError, match="repeats"):
        vectors.checked(store.unionByName(store))
    rows.write.parquet(str(tmp_path / "a/other.parquet"))
    with pytest.raises(ValueError, match="other.parquet"):
        vectors.read_checkpoints(spark, str(tmp_path / "a"))
    cities = spark.createDataFrame([("paris", [0.5, 0.5]), ("rome", None)], "normalized_alias string, embedding array<double>")
    assert vectors.query_vector("Paris", cities, None) == [0.5, 0.5]
    assert vectors.query_vector("Rome", cities, model) == [0.6, 0.8] and vectors.query_vector("Rome, Italy", cities, model) is None and vectors.query_vector("Rome", None, None) is None


def test_upsert_lets_the_last_row_win(spark):
    have = spark.createDataFrame([(1, "old"), (2, "kept")], "k long, v string")
    rows = spark.createDataFrame([(1, "new", 2), (1, "newer", 3), (3, "more", 1)], "k long, v string, seq int")
    assert sorted(map(tuple, api.upsert(have, rows, "k", "seq").collect())) == [(1, "newer"), (2, "kept"), (3, "more")]


def test_gazetteer_tiers_and_roots(spark, tmp_path, monkeypatch):
    cities = spark.createDataFrame([(i, 1000 * i) for i in range(20)], "geoname_id long, population long")
    assert metadata.gazetteer(cities, 5000).count() == 15 and [r.geoname_id for r in metadata.gazetteer(cities, 500, 2).collect()] == [19, 18]
    with pytest.raises(ValueError):
        metadata.gazetteer(cities, 7)
    assert build.data_root([str(tmp_path / "no"), str(tmp_path)], "CP_TEST") == str(tmp_path) and build.data_root(["/no/a", "/no/b"], "CP_TEST") == "/no/a"
    monkeypatch.setenv("CP_TEST", "/set")
    assert build.data_root([str(tmp_path)], "CP_TEST") == "/set"
    monkeypatch.setenv("CHRONOPLACE_LINKED_ENOUGH", "7")
    assert Settings.from_env().linked_enough == 7 and Settings.from_env().bm25_least == 1.0


def test_checksums_of_dumps(spark, made, tmp_path):
    import hashlib

    from chronoplace.sources import dumps

    b, _ = made
    files = [b.at(f"dumps/{name}") for name in ("page.sql.gz", "pages.xml")]
    wanted = {f: hashlib.sha1(open(f, "rb").read()).hexdigest() for f in files}
    got = {r.path: (r.n_bytes, r.digest) for r in dumps.verify(spark, wanted).collect()}
    assert {k: v[1] for k, v in got.items()} == wanted and all(n > 0 for n, _ in got.values())
    with pytest.raises(ValueError, match="pages.xml"):
        dumps.verify(spark, {**wanted, files[1]: "0" * 40})
    assert {r.digest for r in dumps.checksums(spark, files[:1], "sha256").collect()} == {hashlib.sha256(open(files[0], "rb").read()).hexdigest()}


def test_steps_from_the_command_line(made, tmp_path, capsys):
    write_dumps(tmp_path)
    assert build.main([str(tmp_path), "gazetteer", "--least-population", "500"]) == {"cities": 3, "aliases": build.main([str(tmp_path), "gazetteer", "--least-population", "500"])["aliases"]}
    assert "cities: 3 rows" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        build.main([str(tmp_path), "nothing"])
