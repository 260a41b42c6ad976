"""What op1's workers hold at once doesn't grow with the texts of a partition."""

from chronoplace.llm import substring_dedup


def test_texts_come_in_small_batches(spark, tmp_path, monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(16_000)) for i in range(24)]
    spark.createDataFrame([(i, texts[i % 24]) for i in range(48)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents"))
    seen, whole = spark.sparkContext.accumulator(0), substring_dedup.chunks
    most = (2 << 20) + 2 * len(texts[-1])  # a batch is closed by the text that fills it

    def strict(column):
        if column.nbytes > most:
            raise ValueError(f"a batch of {column.nbytes} bytes of text")
        seen.add(1)
        return whole(column)

    monkeypatch.setattr(substring_dedup, "chunks", strict)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    substring_dedup.deduplicate(spark.read.parquet(str(tmp_path / "documents")), 1)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    # 6.8 MB, read once for their fingerprints and once for their windows
    assert seen.value >= 6
