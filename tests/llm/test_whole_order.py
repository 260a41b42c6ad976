"""Slots of the training order."""

import pytest

from chronoplace.llm import token_output


def test_walks_go_on_until_every_slot_is_in_range(spark, monkeypatch):
    for n in (5, 17, 260, 1030):
        numbers = spark.range(n).withColumnRenamed("id", "x")
        usual = {r.x: r.slot for r in token_output.Permutation(n, "k").slots(numbers, "x").collect()}
        short = {r.x: r.slot for r in token_output.Permutation(n, "k").slots(numbers, "x", most=1).collect()}
        assert sorted(short.values()) == list(range(n)) and short == usual
    monkeypatch.setattr(token_output, "LONG_WALK", 1)
    with pytest.raises(Exception, match="no slot below 1030"):
        token_output.Permutation(1030, "k").slots(numbers, "x", most=1).collect()
