"""op6's descent level by level, op9's control and p-values, redaction's columns, op10's training sample, the pipeline's stages."""

import collections
import math
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoplace.llm import pii, quality, secrets, sharding, toxicity

SHARDS = [sharding.Shard(f"r{i // 8}", f"k{i // 4}", i) for i in range(16)]


def moves(spark, before, after, n=6000):
    keys = spark.range(n).withColumnRenamed("id", "doc_id")
    where = {s.index: (s.region, s.rack, s.index) for s in [*before, *after]}
    both = sharding.assign(sharding.assign(keys, before), after, name="after").collect()
    return [(where[r.shard], where[r["after"]]) for r in both]


def heavier(index, weight):
    return [sharding.Shard(s.region, s.rack, s.index, weight if s.index == index else s.weight) for s in SHARDS]


@pytest.mark.parametrize("weight", [4.0, 0.25, 0.0])
def test_movement_is_confined_level_by_level(spark, weight):
    region, rack = SHARDS[5].region, SHARDS[5].rack
    moved = [(a, b) for a, b in moves(spark, SHARDS, heavier(5, weight)) if a != b]
    assert moved
    for a, b in moved:
        if a[0] != b[0]:  # between regions: only towards the one that gained, or from the one that lost
            assert (b if weight > 1 else a)[0] == region
        elif a[1] != b[1]:  # between racks of one region: only of the changed one, towards or from the changed rack
            assert a[0] == region and (b if weight > 1 else a)[1] == rack
        else:
            assert (a[0], a[1]) == (region, rack) and (b if weight > 1 else a)[2] == 5


def test_shares_follow_weights(spark):
    weights = [0.0 if 8 <= i < 12 else 1.0 + (i % 3) for i in range(16)]  # one rack has no weight at all
    shards = [sharding.Shard(s.region, s.rack, s.index, w) for s, w in zip(SHARDS, weights)]
    n, counts = 20_000, collections.Counter(a[2] for a, _ in moves(spark, shards, shards, 20_000))
    for i, w in enumerate(weights):
        expected = n * w / sum(weights)
        assert abs(counts[i] - expected) <= 4.5 * math.sqrt(expected + 1), i
    with pytest.raises(ValueError, match="weight"):
        sharding.tree([sharding.Shard("a", "b", 0, 0.0)])


def test_one_more_shard_takes_rows_only_into_itself(spark):
    after = sharding.grown(SHARDS)
    pairs = moves(spark, SHARDS, after)
    assert {b[2] for a, b in pairs if a != b} == {16}
    assert 0.03 < sum(b[2] == 16 for _, b in pairs) / len(pairs) < 0.09


def test_slots_do_not_depend_on_the_number_of_ranges(spark):
    docs = spark.createDataFrame([(i % 50 if i % 7 else None, "x" * (i % 9)) for i in range(300)], "doc_id long, text string")
    rows = []
    for n in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(str, sharding.place(docs).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]


def test_upper_tail_against_the_exact_one(spark):
    zs = [-4 + 0.1 * i for i in range(81)]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", secrets.upper_tail(F.col("z")).alias("p")).collect()
    assert max(abs(r.p - 0.5 * math.erfc(r.z / math.sqrt(2))) for r in got) < 2e-4


def test_p_values_of_random_strings_are_about_uniform(spark):
    rng, rows = random.Random(8), []
    for name, alphabet in (("hex", "0123456789abcdef"), ("base62", string.digits + string.ascii_letters)):
        rows += [(name, "".join(rng.choice(alphabet) for _ in range(n))) for n in (32, 64) for _ in range(400)]
    got = spark.createDataFrame(rows, "k string, v string").select("k", secrets.p_random(F.col("v")).alias("p")).collect()
    for name in ("hex", "base62"):
        p = [r.p for r in got if r.k == name]
        for edge in (0.05, 0.2, 0.5):  # Bonferroni holds a true string's p at or above its level
            assert sum(x < edge for x in p) / len(p) < edge * 1.15 + 0.02


def test_discoveries_are_controlled_over_the_table(spark):
    rng = random.Random(3)
    token = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    words = ["getElementsByClassNameFromDocument", "the-quick-brown-fox-jumps-over-it", "a" * 30, "ab" * 20, "electroencephalographically2"]
    rows = [(i, f"see {token()} and {rng.choice(words)}" if i % 4 else f"only {rng.choice(words)}") for i in range(400)] + [(400, None), (401, ""), (402, token() + "\n" + token())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [s.value for s in r.spans if s.kind == "random"] for r in secrets.detect(docs).collect()}
    found = [v for values in got.values() for v in values]
    assert not set(found) & set(words) and len(found) >= 0.85 * 302
    # the cut is one of the table's: a document's neighbours decide with it, its own order does not
    cut = secrets.control(docs)
    assert sorted(map(str, secrets.detect(docs, cut=cut).collect())) == sorted(map(str, secrets.detect(docs.orderBy(F.desc("doc_id"))).collect()))
    assert secrets.control(docs.filter("doc_id % 4 = 0 and doc_id < 400")) == -1 and secrets.control(docs.limit(0)) == -1
    twice = secrets.detect(docs.unionAll(docs)).collect()
    assert len(twice) == 2 * len(rows)


def test_redaction_keeps_columns_of_any_name(spark):
    schema = "doc_id long, text string, spans string, base_spans int, scores array<int>, __email string, __iban int, __row long"
    row = (1, "mail a@b.cd or 4111 1111 1111 1111", "s", 7, [1, 2], "e", 3, 9)
    docs = spark.createDataFrame([row, (2, None, None, None, None, None, None, None)], schema)
    out = pii.redact(docs)
    assert out.dtypes == docs.dtypes
    got = {r.doc_id: tuple(r) for r in out.collect()}
    assert got[1] == (1, "mail <EMAIL> or <CARD>", *row[2:]) and got[2][1:] == (None,) * 7


def test_training_takes_one_row_for_each_labelled_id(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone"]
    rows = [(i, " ".join([rng.choice(words) for _ in range(40)] + (["vermin"] if i % 4 == 0 else []))) for i in range(400)]
    many = rows + [rows[1]] * 500 + [(None, "vermin " * 30), (None, None), (4, rows[4][1] + " zz " * 20_000)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string, label int, score double"
    few = spark.createDataFrame([(i, t, 1, 0.0) for i, t in rows], schema)
    docs = spark.createDataFrame([(i, t, 1, 0.0) for i, t in many], schema)
    assert quality.labelled_texts(docs, quality.labelled_sample(labels, "toxic", 100)).count() == 100
    one, other = toxicity.train(few, labels), toxicity.train(docs, labels)
    assert np.allclose(one.weights, other.weights) and abs(one.bias - other.bias) < 1e-9
    got = toxicity.score(docs, other).collect()
    assert len(got) == len(many) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.98 * len(held)


def test_stages_of_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = lambda name, n=80: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, words("a")), (1, words("a")), (None, words("b")), (None, None), (3, ""), (4, words("c") + " me@site.org"), (5, words("d") + " " + words("leak", 15))]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, words("leak", 15))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for some in (rows, []):
        docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in some], schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs.count()
            docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), schema)
            kept = {(r.doc_id, r.text) for r in docs.collect()}
            assert docs.count() <= before
            if some and name == "quality rules":
                assert before - docs.count() == 2 and (None, words("b")) in kept
            if some and name == "n-gram Jaccard join":
                assert sorted((i or 0) for i, _ in kept) == [0, 1, 4, 5] and docs.count() == 4
            if some and name == "benchmark decontamination":
                assert sorted((i or 0) for i, _ in kept) == [0, 1, 4]
        if some:
            assert {r.doc_id: r.text for r in docs.collect()}[4] == words("c") + " <EMAIL>"
            assert {r.n_chars - len(r.text) for r in docs.collect()} == {0}
        out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert out.count() == docs.count() and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
