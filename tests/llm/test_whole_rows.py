"""Whole rows of the pipeline and of op2's records against plain Python."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def prose(name, n=80):
    return " ".join(f"{name}{i}x" for i in range(n))


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_pipeline_rows(spark, tmp_path):
    passage = prose("leak", 20)
    texts = {
        1: prose("a"), 2: prose("b"), 3: prose("a"), 4: prose("c", 20), 5: prose("d") + " write to me@site.org Now", 6: prose("e") + " DE89370400440532013000 Please pay",
        7: prose("f") + " " + passage, 8: None, 9: "", 10: prose("g") + "\nÉté 中文", 11: " ".join(prose("b").split()[:-1] + ["near"]),
    }
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {i: texts[i] for i in (1, 2, 5, 6, 10)}
    kept[5], kept[6] = kept[5].replace("me@site.org", "<EMAIL>"), kept[6].replace("DE89370400440532013000", "<IBAN>")
    enc, expected = encoding(), []
    for i, t in kept.items():
        ids = enc.encode_ordinary(t)
        expected.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(expected)
