import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.llm import examples, rules, text_stats

COMMON = "the of and to a in is was for with der die und in zu le la les de et el los que y и в не на".split()


def common(spark):
    return spark.createDataFrame([("en", w) for w in COMMON] + [("xx", None)], "lang string, word string")


def test_statistics_by_hand(spark):
    df = spark.createDataFrame([(1, "The cat sat.\r\nIn the 2 hats!\n\nno end"), (2, None), (3, ""), (4, "  \n\t"), (5, "a\tb\tc\n1\t2\t3")], "k bigint, text string")
    got = {r.k: r for r in text_stats.statistics(df, "k", "text", COMMON).collect()}
    one = got[1]
    assert (one.n_words, one.n_lines) == (9, 3) and one.line_end_share == pytest.approx(2 / 3) and one.common_share == pytest.approx(3 / 9)
    assert one.mean_word_len == pytest.approx(sum(map(len, "The cat sat In the 2 hats no end".split())) / 9)
    for k in (2, 3, 4):
        assert all(got[k][f] == 0 for f in text_stats.FEATURES)
    assert got[5].grid_share == 1 and got[5].grid_cells == 2


def test_held_out_accuracy(spark):
    rows = examples.labelled(1234, 100)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string").withColumn("kind", F.lit("x"))
    out = text_stats.classify(df, "doc_id", "text", common(spark))
    right = sum(r.kind == rows[r.doc_id][1] for r in out.collect())
    assert right >= 0.95 * len(rows)


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    plan = text_stats.classify(df, "doc_id", "text", common(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_long_and_odd_texts(spark):
    texts = ["a" * 300_000, "a'" * 100_000, " " * 200_000 + "x", "\n" * 200_000, ", " * 100_000, "." * 100_000, "- x\n" * 50_000, "a b " * 100_000, "(" * 50_000, " " * 1000, "|" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in text_stats.classify(df, "doc_id", "text", common(spark)).collect()}
    assert len(got) == len(texts) and got[3].kind == "prose" and got[0].kind == "junk"
    assert text_stats.classify(df.limit(0), "doc_id", "text", common(spark)).count() == 0


def test_rules_learn_a_known_rule():
    r = np.random.default_rng(1)
    x = r.uniform(size=(600, 4))
    kinds = ["a" if u > 0.7 and v <= 0.4 else "b" if w > 0.8 else "rest" for u, v, w, _ in x]
    found = rules.induce(x, kinds, list("uvwz"), ["a", "b"], "rest", 3)
    fresh = r.uniform(size=(600, 4))
    want = ["a" if u > 0.7 and v <= 0.4 else "b" if w > 0.8 else "rest" for u, v, w, _ in fresh]
    assert (found.predict(fresh, list("uvwz")) == np.array(want)).mean() > 0.95
    assert found.to_sql().startswith("CASE WHEN ") and rules.RuleList([], "rest").to_sql() == "'rest'"
    assert rules.induce(x, ["rest"] * 600, list("uvwz"), ["a"], "rest", 1).rules == []


def test_sql_and_prediction_agree(spark):
    r = random.Random(2)
    names = ["u", "v"]
    data = [(r.random(), r.random()) for _ in range(300)]
    kinds = ["a" if u > 0.5 else "rest" for u, _ in data]
    found = rules.induce(np.array(data), kinds, names, ["a"], "rest", 1)
    got = [x.k for x in spark.createDataFrame(data, "u double, v double").select(F.expr(found.to_sql()).alias("k")).collect()]
    assert got == list(found.predict(np.array(data), names))


def test_scraps_of_any_length_are_junk(spark):
    r = random.Random(4)
    scrap = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n)).strip() + "|"
    once = "the old miller walks to the river in the evening and looks at the boats, and everyone in the house waits for him. "
    texts = [scrap(180) * 6, scrap(900) * 4, "A heading\n" + scrap(300) * 5, scrap(40) * 9 + " and an end", "ha " * 12, (scrap(60) + "\n") * 7 + "page 4", once * 3, once]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id: x for x in text_stats.classify(df, "doc_id", "text", common(spark)).select("doc_id", "loop_share", "kind").collect()}
    assert [got[i].loop_share > 0.8 and got[i].kind == "junk" for i in range(6)] == [True] * 6
    assert got[6].loop_share == got[7].loop_share == 0 and got[7].kind == "prose"
