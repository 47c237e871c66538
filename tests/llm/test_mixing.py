import random

import pytest
from pyspark.sql import functions as F

from anchorline.llm.mixing import mix_sources


def frames(spark, sizes, targets):
    return spark.createDataFrame(sizes, "doc_id bigint, source string, tokens bigint"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_are_met(spark):
    r = random.Random(1)
    sizes = [(i, r.choice(["big"] * 8 + ["mid"] * 3 + ["small", None]), r.randint(0, 60)) for i in range(4000)] + [(9999, "untargeted", 5)]
    docs, want = frames(spark, sizes, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("absent", 0.05, 9)])
    mix = mix_sources(docs.withColumn("h", F.lit(1)), want, "doc_id")
    shares = {x.source: x for x in mix.shares.collect()}
    mass = 0.95
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert shares[s].actual_share == pytest.approx(share / mass, abs=0.004) and shares[s].most_repeats <= shares[s].max_repeats
    assert shares["absent"].mixed_tokens == 0
    chosen = mix.chosen.collect()
    assert {x.source for x in chosen} == {"big", "mid", "small"} and len({x.doc_id for x in chosen}) == len(chosen) and all(x.tokens > 0 for x in chosen)
    assert sum(x.tokens * x.repeats for x in chosen) == sum(x.mixed_tokens for x in shares.values())
    # some source gives all it has
    assert any(x.mixed_tokens == x.available_tokens * x.max_repeats for x in shares.values())


def test_total_and_nested_thresholds(spark):
    sizes = [(i, "a", 10) for i in range(1000)] + [(1000 + i, "b", 10) for i in range(50)]
    docs, want = frames(spark, sizes, [("a", 0.5, 3), ("b", 0.5, 2)])
    picked = {}
    for total in (400, 800, 1200):
        mix = mix_sources(docs, want, "doc_id", total=total)
        by = {x.source: x for x in mix.shares.collect()}
        assert by["a"].mixed_tokens == total / 2 and by["b"].mixed_tokens == min(total / 2, 1000)
        picked[total] = {x.doc_id: x.repeats for x in mix.chosen.collect()}
    assert set(picked[400]) < set(picked[800]) < set(picked[1200])
    assert set(picked[1200][i] for i in picked[1200] if i >= 1000) == {1, 2}


def test_edges(spark):
    docs, want = frames(spark, [], [("a", 1.0, 1)])
    mix = mix_sources(docs, want, "doc_id")
    assert mix.chosen.count() == 0 and mix.shares.first().actual_share == 0
    docs, want = frames(spark, [(1, "a", 7), (2, None, 3), (3, "a", None)], [("a", 1.0, 2), ("z", 0.0, 5)])
    assert [(x.doc_id, x.repeats) for x in mix_sources(docs, want, "doc_id").chosen.collect()] == [(1, 2)]
