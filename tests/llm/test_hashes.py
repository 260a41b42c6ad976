"""Texts made to collide under polynomial hashes, hashes made to collide, very long texts and bytes that aren't UTF-8."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_corpus import RANKS, SPACED, base_counts, contaminated, sha, shingles

import base64

import public_tokenizers
import tiktoken

from chronoplace.llm import bpe, decontaminate, ngram_join, quality, substring_dedup, textnp, token_output


def thue_morse(n, a, b):
    """The sequence and its complement: equal under every polynomial hash modulo 2**64 from 1,024 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


def encoding():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def expected_dedup(rows):
    first, out = {}, []
    for i, t in rows:
        w = SPACED.findall(t or "")
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            first[k] = min(first.get(k, i), i)
    for i, t in rows:
        w = SPACED.findall(t or "")
        hit = [False] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                hit[j : j + 50] = [True] * 50
        out.append((i, len(w), sum(hit), sha(" ".join(x for x, h in zip(w, hit) if not h))))
    return out


def expected_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), root(i)) for i, s in sets]


def expected_ids(rows):
    enc, out = encoding(), []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or "")))
    return out


def check_all(spark, rows, items):
    docs = table(spark, rows)
    rowsets = [
        (substring_dedup.digest(substring_dedup.deduplicate(docs)), expected_dedup(rows)),
        (bpe.digest(bpe.encode(docs, RANKS)), expected_ids(rows)),
        (quality.score(docs, quality.grow(np.zeros((0, 13)), np.zeros(0), [0] * 13)).select("doc_id", *quality.BASE, "base_failed"), [(i, *base_counts(t)) for i, t in rows]),
        (decontaminate.digest(decontaminate.scan(docs, spark.createDataFrame(items, "item_id long, text string"))), contaminated(rows, items)),
        (ngram_join.join(docs), expected_components(rows)),
    ]
    for got, expected in rowsets:
        assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_words_lines_and_windows_that_polynomials_confuse(spark):
    rows = []
    for n in (1024, 4096):
        one, other = ("".join(x) for x in thue_morse(n, "a", "b"))
        rows += [(len(rows), f"{one} tail of words here"), (len(rows) + 1, f"{other} tail of words here")]
        rows.append((len(rows), f"{one}\n{other}\n{one}\nx"))
        rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate(thue_morse(n, "ab", "ba"))]
        rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate(thue_morse(n, "left", "right"))]
    check_all(spark, rows, [(1, rows[0][1]), (2, " ".join(thue_morse(64, "left", "right")[0])), (3, "".join(thue_morse(1024, "b", "a")[0]))])


def test_pre_tokens_stay_apart_in_records(spark):
    one, other = ("".join(x) for x in thue_morse(1024, "a", "b"))
    rows = [(1, one), (2, other), (3, f"{one} {other}")]
    written, path = token_output.materialise_order(table(spark, rows), RANKS, stride=16, per_shard=8)
    n = written.count()
    got = np.frombuffer(b"".join(bytes(r.ids) for r in token_output.read(spark, path, 0, n, 16, 8).orderBy("slot").collect()), "<u2")
    enc = encoding()
    assert sorted(got[got < token_output.END].tolist()) == sorted(x for _, t in rows for x in enc.encode_ordinary(t))


def test_very_long_and_tiny_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40_000)]
    long = " ".join(words[i] for i in rng.integers(0, 40_000, 200_000))
    assert len(long) > textnp.CHUNK_BYTES
    middle = " ".join(long.split()[5000:5080])
    small = [(0, "a b"), (2, middle + " z"), (3, None), (4, ""), (5, "one  two\n\nthree " * 30)]
    check_all(spark, [*small, (6, long), (7, "x " + long), (8, middle)], [(1, middle), (2, "one two")])
    monkeypatch.setattr(textnp, "CHUNK_BYTES", 64)
    check_all(spark, [*small, (8, middle), (9, "tail")], [(1, middle), (2, "one two")])


def test_hashes_that_collide_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(9)
    bases = [[f"b{k}_{i}" for i in range(60)] for k in range(12)]
    rows = []
    for k, base in enumerate(bases):
        for j in range(4):
            rows.append((10 * k + j, " ".join(f"x{j}" if rng.random() < 0.01 * j else w for w in base)))
    expected = expected_components(rows)
    monkeypatch.setattr(ngram_join, "node_half", lambda one: one & np.uint64(3))
    assert sorted(map(tuple, ngram_join.join(table(spark, rows)).collect())) == sorted(expected)
    data = np.frombuffer(b"abcabdabcab\x00ab" + b"z" * 300 + b"y" + b"z" * 300, np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 12, 14, 315, 9]), np.array([3, 6, 9, 12, 14, 314, 615, 11])
    texts = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    for weak in (False, True):
        if weak:
            monkeypatch.setattr(textnp, "bytes_hash", lambda data, starts, ends, salt=0: np.ones(len(starts), np.uint64))
        _, first, times, index = textnp.distinct(data, starts, ends)
        assert [texts[first[i]] for i in index] == texts and times.sum() == len(texts) and len(first) == len(set(texts))


def test_hashes_of_equal_bytes_are_equal_anywhere():
    words = ["", "a", "abcdefgh", "abcdefghi", "x" * 256, "x" * 257, "x" * 900, "Été"]
    texts = pa.array([" ".join(words), "pad " + " ".join(words), " ".join(reversed(words))])
    (chunk,) = textnp.chunks(texts)
    w = textnp.Words(chunk, textnp.NON_SPACE)
    seen = {}
    for s, e, h, g in zip(w.starts, w.ends, w.hash, w.lane(textnp.SECOND)):
        assert seen.setdefault(chunk.data[s:e].tobytes(), (h, g)) == (h, g) and h != g
    assert len(set(seen.values())) == len(seen)
    for k in (1, 2, 3, 5, 7):
        by = {}
        for h, at in zip(*w.grams(k)):
            by.setdefault(tuple(chunk.data[w.starts[j] : w.ends[j]].tobytes() for j in range(at, at + k)), set()).add(int(h))
        assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == len(by)


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61FF6220C3') AS STRING) AS text UNION ALL SELECT 2L, 'plain'")
    read = "a�b �"
    assert [r for r in bpe.digest(bpe.encode(docs, RANKS)).collect() if r.doc_id == 1] == [expected_ids([(1, read)])[0]]
    assert token_output.materialise_order(docs, RANKS, 16, 8)[0].count() > 0
    (row,) = substring_dedup.digest(substring_dedup.deduplicate(docs)).filter("doc_id = 1").collect()
    assert tuple(row) == (1, 2, 0, sha(b"a\xffb \xc3"))
    benchmark = spark.createDataFrame([(1, "plain")], "item_id long, text string")
    found = {r.doc_id: r.n_hit for r in decontaminate.digest(decontaminate.scan(docs, benchmark)).collect()}
    assert found == {1: 0, 2: 1}
    assert ngram_join.join(docs).count() == 2
    from chronoplace.llm import toxicity

    assert toxicity.score(docs, toxicity.Model(0.0, np.zeros(1 << toxicity.BITS))).filter(F.col("score") == 0.5).count() == 2


def test_an_index_is_taken_up_again(spark):
    rng = np.random.default_rng(1)
    prose = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 5000, n))
    passage = prose(80)
    rows = [(i, prose(60) + (" " + passage if i % 3 == 0 else "")) for i in range(40)]
    keyed = table(spark, rows).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    batches = [keyed.filter(F.col("doc_id") % 5 == k) for k in range(5)]
    whole = substring_dedup.FingerprintIndex(spark)
    whole.add(keyed)
    index = substring_dedup.FingerprintIndex(spark)
    for k, batch in enumerate(batches):
        index.add(batch)
        assert len(index._paths("run")) == bin(k + 1).count("1")  # a level holds one run at most
        index.close()
        index = substring_dedup.FingerprintIndex.open(spark, index.path)
    anchors = lambda x: sorted(r.anchor for r in x.candidates().collect())
    assert anchors(index) == anchors(whole) and anchors(index)
    runs = [index.run(p) for p in index._paths("run")]
    plan = index.met(*runs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.close(delete=True)
    whole.close(delete=True)
