"""The tools on small frames: values, nulls, order, errors."""

import random
import time

import pytest
from pyspark.sql import functions as F

from anchorline.operators import alike, combine, develop, parse, preparation, transform
from anchorline.session import use_spark
from anchorline.sources import files


@pytest.fixture()
def people(spark):
    return spark.createDataFrame([(1, "Ann", 31, "Rome"), (2, "Bob", None, "Oslo"), (3, None, 45, "Rome"), (4, "Dan", 28, None), (5, "Eve", 39, "Oslo")], "ID bigint, Name string, Age int, City string")


class TestPreparation:
    @pytest.mark.parametrize(("operator", "value", "ids"), [("=", "Rome", [1, 3]), ("!=", "Rome", [2, 4, 5]), ("contains", "o", [1, 3]), ("does not contain", "Rom", [2, 4, 5]), ("is null", None, [4]), ("is not null", None, [1, 2, 3, 5]), ("is empty", None, [4]), ("IS NOT EMPTY ", None, [1, 2, 3, 5])])
    def test_filter_operators_split_all_rows(self, people, operator, value, ids):
        s = preparation.filter(people, column="City", operator=operator, value="ome" if operator == "contains" else value)
        assert sorted(r.ID for r in s.true.collect()) == ids
        assert s.true.count() + s.false.count() == 5

    def test_filter_null_is_false(self, people):
        s = preparation.filter(people, "Age > 30")
        assert [sorted(r.ID for r in x.collect()) for x in s] == [[1, 3, 5], [2, 4]]

    def test_filter_needs_condition(self, people):
        with pytest.raises(ValueError):
            preparation.filter(people)
        with pytest.raises(ValueError):
            preparation.filter(people, column="Age", operator="almost", value=1)
        with pytest.raises(TypeError):
            preparation.filter("no frame", "a > 1")

    def test_filter_pushes_down(self, spark, people, tmp_path):
        people.write.parquet(str(tmp_path / "p"))
        plan = preparation.filter(spark.read.parquet(str(tmp_path / "p")), "Age > 30").false._jdf.queryExecution().toString()
        assert "PushedFilters: [Or(" in plan

    def test_filter_mask_function(self, people):
        s = preparation.filter(people, lambda f: f["ID"] > 3, udf=True)
        assert (s.true.count(), s.false.count()) == (2, 3)

    def test_formula(self, spark, people):
        assert [r.x for r in preparation.formula(people, "x", "ID * 2 + 1").collect()] == [3, 5, 7, 9, 11]
        assert [r.x for r in preparation.formula(people, "x", lambda d: F.upper(d.Name)).collect()][:2] == ["ANN", "BOB"]
        assert [r.x for r in preparation.formula(people, "x", "ID / 0").collect()] == [None] * 5
        odd = spark.createDataFrame([(7, 2)], "`Total Sales` int, `Total` int")
        assert preparation.formula(odd, "x", "Total Sales - Total").first().x == 5
        assert preparation.formula(spark.createDataFrame([(7, -3)], "a int, b int"), "x", "a % b").first().x == -2
        assert preparation.formula(people, "x", lambda f: f["ID"] + 0.5, udf=True, returns="double").first().x == 1.5

    @pytest.mark.parametrize("bad", ["__import__('os').system('x')", "ID.__class__", "[x for x in ID]", "lambda: 1", "nope + 1", "", "open('x').read()"])
    def test_formula_refuses_code(self, people, bad):
        with pytest.raises(ValueError):
            preparation.formula(people, "x", bad)

    def test_select(self, people):
        out = preparation.select(people, ["ID", "Name"], {"ID": "Key"}, {"Key": "str"})
        assert out.dtypes == [("Key", "string"), ("Name", "string")]
        with pytest.raises(KeyError):
            preparation.select(people, ["Nope"])
        with pytest.raises(ValueError):
            preparation.select(people, dtypes={"ID": "strange"})
        assert preparation.select(people, dtypes={"Name": "int"}, on_error="null").first().Name is None

    def test_cleansing(self, spark):
        df = spark.createDataFrame([("\t o'neil mc-donald ", 1), (None, None), ("abc12!é", 3)], "t string, n int")
        assert [r.t for r in preparation.data_cleansing(df, modify_case="title").collect()] == ["O'Neil Mc-Donald", None, "Abc12!É"]
        assert [r.t for r in preparation.data_cleansing(df, remove_letters=True, remove_numbers=True).collect()][2] == "!é"
        assert [r.t for r in preparation.data_cleansing(df, remove_punctuation=True).collect()][2] == "abc12é"
        assert preparation.data_cleansing(df, ["n"], replace_nulls_with=0).collect()[1].n == 0
        assert preparation.data_cleansing(df, remove_null_rows=True).count() == 2

    def test_sort_nulls_last(self, people):
        assert [r.ID for r in preparation.sort(people, "Age").collect()][-1] == 2
        assert [r.ID for r in preparation.sort(people, "Age", False).collect()] == [3, 5, 1, 4, 2]

    def test_unique(self, spark):
        df = spark.createDataFrame([(1, "a"), (2, "A"), (3, None), (4, None), (5, "a")], "i int, k string")
        u, d = preparation.unique(df, "k", order_by="i")
        assert sorted(r.i for r in u.collect()) == [1, 2, 3] and sorted(r.i for r in d.collect()) == [4, 5]
        u, d = preparation.unique(df, "k", ignore_case=True, order_by="i")
        assert sorted(r.i for r in u.collect()) == [1, 3]

    def test_sample(self, spark):
        df = spark.range(100)
        assert [r.id for r in preparation.sample(df, 3).collect()] == [0, 1, 2]
        assert [r.id for r in preparation.sample(df, 2, position="last").collect()] == [98, 99]
        assert preparation.sample(df, pct=0.1, random=True, random_state=1).count() == 10
        for bad in ({}, {"n": 1, "pct": 0.5}, {"n": 1, "position": "middle"}):
            with pytest.raises(ValueError):
                preparation.sample(df, **bad)

    def test_record_id(self, spark):
        out = preparation.record_id(spark.range(50).repartition(5), start=10)
        assert out.columns[0] == "RecordID" and sorted(r.RecordID for r in out.collect()) == list(range(10, 60))
        assert [r.RecordID for r in preparation.record_id(spark.range(9), order_by="id").orderBy("id").collect()] == list(range(1, 10))
        assert preparation.record_id(spark.range(0)).count() == 0

    def test_generate_rows(self, spark):
        with use_spark(spark):
            assert preparation.generate_rows(3).collect() == [(0,), (1,), (2,)]
            assert preparation.generate_rows(2, lambda i: {"a": i + 1}).collect() == [(1,), (2,)]
            assert preparation.generate_rows(2, lambda i: {"a": i * 5}, udf=True, schema="a bigint").collect() == [(0,), (5,)]

    def test_auto_field(self, spark):
        df = spark.createDataFrame([(1, 0.5, "x"), (300, 0.25, "x"), (3, 2.0, "x"), (4, 1.0, "y"), (5, 1.0, "y")], "a bigint, b double, c string")
        out = preparation.auto_field(df)
        assert dict(out.dtypes) == {"a": "smallint", "b": "float", "c": "string"} and out.schema["c"].metadata == {"category": True}

    def test_multi_row(self, spark):
        df = spark.createDataFrame([(1, "a", 10), (2, "a", 15), (3, "b", 7)], "i int, g string, v int")
        assert [r.v for r in preparation.multi_row_formula(df, "v", lambda c, p: c - p, order_by="i").orderBy("i").collect()] == [None, 5, -8]
        assert [r.v for r in preparation.multi_row_formula(df, "v", lambda c, p: c - p, group_by="g", order_by="i").orderBy("i").collect()] == [None, 5, None]

    def test_tile(self, spark):
        df = spark.createDataFrame([(i,) for i in (1, 2, 2, 3, 4, None)], "v int")
        assert [r.Tile for r in preparation.tile(df, "v", 2).orderBy("v").collect()] == [None, 1, 1, 1, 2, 2]
        assert [r.Tile for r in preparation.tile(df, "v", 3, "equal_range").orderBy("v").collect()] == [None, 1, 1, 1, 2, 3]
        with pytest.raises(ValueError):
            preparation.tile(df, "v", 3, "odd")

    def test_imputation(self, people, spark):
        out = preparation.imputation(people, "Age", "median")
        assert out.collect()[1].Age == 35.0 and out.collect()[1].Age_WasImputed
        assert preparation.imputation(people, "City", "mode", add_indicator=False).collect()[3].City == "Oslo"
        empty = spark.createDataFrame([(None,)], "v int")
        assert preparation.imputation(empty, "v").first().v is None
        with pytest.raises(ValueError):
            preparation.imputation(people, "Age", "value")

    def test_samples_are_exact(self, spark):
        s = preparation.create_samples(spark.range(101), 0.5, 0.3, 0.2, random_state=1)
        assert [x.count() for x in s] == [50, 30, 21]
        assert sorted(r.id for x in s for r in x.collect()) == list(range(101))
        with pytest.raises(ValueError):
            preparation.create_samples(spark.range(3), 0.5, 0.3, 0.3)

    def test_date_filter(self, spark):
        df = spark.createDataFrame([("2024-01-01",), ("2024-02-01",), (None,), ("bad",)], "d string")
        s = preparation.date_filter(df, "d", "2024-01-01", "2024-01-31")
        assert [r.d for r in s.true.collect()] == ["2024-01-01"] and s.false.count() == 3

    def test_oversample(self, spark):
        df = spark.createDataFrame([("A",)] + [("B",)] * 4 + [(None,)], "c string")
        out = preparation.oversample_field(df, "c", "A", 0.5, 1)
        assert sorted(str(r.c) for r in out.collect()) == ["A"] * 5 + ["B"] * 4 + ["None"]
        with pytest.raises(ValueError):
            preparation.oversample_field(df, "c", "A", 1.0)

    @pytest.mark.parametrize(("method", "ranks"), [("min", [1, 2, 2, 4]), ("dense", [1, 2, 2, 3]), ("max", [1, 3, 3, 4]), ("average", [1.0, 2.5, 2.5, 4.0]), ("first", [1, 2, 3, 4])])
    def test_rank(self, spark, method, ranks):
        df = spark.createDataFrame([(1, 9), (2, 7), (3, 7), (4, 1), (5, None)], "i int, v int")
        assert [r.Rank for r in preparation.rank(df, "v", method=method, order_by="i").orderBy("i").collect()] == [*ranks, None]
        g = preparation.rank(df.withColumn("g", F.lit(1)), "v", "g", method=method, order_by="i")
        assert [r.Rank for r in g.orderBy("i").collect()] == [*ranks, None]


class TestJoin:
    def test_three_outputs(self, spark, rows):
        a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "k int, v string")
        b = spark.createDataFrame([("1", "p"), ("3", "q"), (None, "m"), ("bad", "z")], "k string, v string")
        left, joined, right = combine.join(a, b, on="k")
        assert rows(left) == [(2, "y")] and rows(joined) == [(None, "n", "m"), (1, "x", "p")]
        assert joined.columns == ["k", "v_left", "v_right"] and sorted(r.v for r in right.collect()) == ["q", "z"]
        assert combine.join(a, b, on="k", null_safe=False).joined.count() == 1
        with pytest.raises(ValueError):
            combine.join(a, b)

    def test_no_cross_product_for_keys(self, spark):
        a, b = spark.range(10), spark.range(10).withColumn("w", F.lit(1))
        plan = combine.join(a, b, on="id").joined._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan

    def test_multiple_union_append(self, spark, rows):
        a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(1, 3), (2, 4)], "k int, x int")
        assert combine.join_multiple(a, b, on="k").columns == ["k", "x", "x_2"]
        assert rows(combine.union(a, b.withColumn("z", F.lit("t"))))[0] == (1, 2, None)
        assert combine.union(a, spark.createDataFrame([("1", "u")], "k string, x string")).dtypes[0] == ("k", "string")
        assert combine.append_fields(a, b).columns == ["k_left", "x_left", "k_right", "x_right"]
        for bad in (lambda: combine.union(a), lambda: combine.join_multiple(a)):
            with pytest.raises(ValueError):
                bad()

    def test_find_replace(self, spark):
        df = spark.createDataFrame([("CA",), ("TX",), (None,)], "s string")
        book = spark.createDataFrame([("CA", "Old"), ("CA", "California")], "s string, full string").coalesce(1)
        assert [r.s for r in combine.find_replace(df, book, "s", "full").collect()] == ["California", "TX", None]
        assert [r.full for r in combine.find_replace(df, book, "s", "full", append=True).collect()] == ["California", None, None]
        text = spark.createDataFrame([("a.b a",)], "t string")
        pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "f string, r string").coalesce(1)
        assert combine.find_replace(text, pairs, "f", "r", "t", mode="partial").first().t == "c.c c"
        with pytest.raises(ValueError):
            combine.find_replace(text, pairs, "f", "r", "t", mode="odd")

    def test_fuzzy(self, spark):
        a, b = spark.createDataFrame([("Acme Corp",), (None,)], "c string"), spark.createDataFrame([("Acme Corporation",), ("Zed",)], "n string")
        out = combine.fuzzy_match(a, b, "c", "n", 0.5)
        assert out.columns == ["c_left", "n_right", "MatchScore"] and [tuple(r) for r in out.collect()] == [("Acme Corp", "Acme Corporation", 0.72)]
        assert combine.fuzzy_match(a, b, "c", "n", 0.99).count() == 0

    @pytest.mark.parametrize("chunk", [16_384, 60])
    @pytest.mark.parametrize("same", [True, False])
    @pytest.mark.parametrize("threshold", [0.6, 0.8, 1.0])
    def test_fuzzy_counts_lose_nothing(self, spark, rows, monkeypatch, chunk, same, threshold):
        monkeypatch.setattr(alike, "CHUNK", chunk)
        monkeypatch.setattr(alike, "CHUNK_BYTES", 60 * chunk)
        pick = random.Random(7)

        def texts(n):
            for k in [pick.choice("abc") for _ in range(n)] + [None, None, "d"]:
                t = "".join(pick.choice("aÄb ß") for _ in range(pick.randint(0, 12)))
                yield "".join(c * pick.choice([0, 1, 1, 1, 2, 6]) for c in t) if pick.random() < 0.3 else t, k

        a = spark.createDataFrame([*texts(300), (None, "a"), ("x" * 3000, "a"), ("x" * 2500 + "y" * 500, "a")], "t string, k string")
        b = a if same else spark.createDataFrame([*texts(400), ("\U0001f600b", "a"), ("x" * 2900, "a")], "t string, k string")
        score = 1 - F.levenshtein("l.t", "r.t") / F.greatest(F.length("l.t"), F.length("r.t"), F.lit(1))
        all_pairs = a.alias("l").join(b.alias("r"), F.col("l.k") == F.col("r.k")).select(F.col("l.t"), F.col("r.t"), F.col("l.k"), F.round(score, 4), score.alias("s")).filter(F.col("s") >= threshold).drop("s")
        got = combine.fuzzy_match(a, b, "t", "t", threshold, method="levenshtein", block=("k", "k")).select("t_left", "t_right", "k_left", "MatchScore")
        assert rows(got) == rows(all_pairs.toDF("t_left", "t_right", "k_left", "MatchScore"))

    def test_fuzzy_large_block(self, spark):
        began, pick = time.monotonic(), random.Random(3)
        names = {"".join(pick.choice("aeioulnrst ") for _ in range(40)) for _ in range(12_000)}
        df = spark.createDataFrame([(n,) for n in names] + [(min(names)[:-1] + "!",)], "n string").repartition(4)
        out = combine.fuzzy_match(df, df, "n", "n", 0.8, method="levenshtein")
        assert sorted(tuple(r) for r in out.filter("n_left != n_right").collect()) == [(min(names)[:-1] + "!", min(names), 0.975), (min(names), min(names)[:-1] + "!", 0.975)] and out.count() == len(names) + 3
        assert time.monotonic() - began < 60  # 72 million pairs in one block: minutes in one task if each is scored

    def test_make_group(self, spark, rows):
        df = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "E"), ("F", None), (None, None)], "x string, y string")
        assert rows(combine.make_group(df, "x", "y")) == [("A", "A"), ("A", "B"), ("A", "C"), ("D", "D"), ("D", "E"), ("F", "F")]

    def test_long_chain(self, spark):
        df = spark.range(200).select(F.col("id").cast("string").alias("a"), (F.col("id") + 1).cast("string").alias("b"))
        assert {r.Group for r in combine.make_group(df, "a", "b").collect()} == {"0"}


class TestTransform:
    def test_summarize(self, spark, rows):
        df = spark.createDataFrame([("a", 1, "x"), ("a", None, ""), ("b", None, None), (None, 5, "zz")], "g string, v int, t string")
        out = transform.summarize(df, "g", {"v": ["sum", "mean", "count", "count null"], "t": ["concat", "longest", "count blank"]})
        assert out.columns == ["g", "Sum_v", "Mean_v", "Count_v", "Count null_v", "Concat_t", "Longest_t", "Count blank_t"]
        assert rows(out) == [("a", 1, 1.0, 1, 1, "x,", "x", 1), ("b", 0, None, 0, 1, "", None, 0)]
        assert transform.summarize(df.limit(0), None, {"v": "sum"}).collect() == [(0,)]
        assert transform.summarize(df, "g", {"v": lambda c: F.max(c) + 1}).columns[1].endswith("_v")
        for bad in ({"v": "nonsense"}, None):
            with pytest.raises(ValueError):
                transform.summarize(df, "g", bad)

    def test_first_last_follow_order_not_partitions(self, spark):
        df = spark.createDataFrame([(i, None if i in (0, 9) else i) for i in range(10)], "i int, v int")
        for n in (1, 4):
            assert transform.summarize(df.repartition(n), None, {"v": ["first", "last"]}, order_by="i").first() == (1, 8)

    def test_reshape(self, spark, rows):
        df = spark.createDataFrame([(1, 10, "p"), (2, 20, "q")], "ID int, Q1 int, Q2 string")
        assert rows(transform.transpose(df, "ID")) == [(1, "Q1", "10"), (1, "Q2", "p"), (2, "Q1", "20"), (2, "Q2", "q")]
        tab = transform.cross_tab(spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "g string, p string, v int"), "g", "p", "v")
        assert rows(tab) == [("a", 1, 2), ("b", 3, 0)]
        wide = spark.createDataFrame([(2, 1, 5, 3, 7), (1, 2, 6, 4, 8)], "ID int, a int, b int, c int, d int")
        assert [tuple(r) for r in transform.arrange(wide, "ID", {"s": ["a", "c"], "t": ["b", "d"]}).collect()] == [(1, 2, 6), (1, 4, 8), (2, 1, 5), (2, 3, 7)]
        with pytest.raises(ValueError):
            transform.arrange(wide, "ID", {"s": ["a"], "t": ["b", "c"]})
        six = spark.createDataFrame([(i,) for i in range(5)], "v int")
        assert [tuple(r) for r in transform.make_columns(six, 2, order_by="v").collect()] == [(0, 1), (2, 3), (4, None)]

    def test_running_total(self, spark):
        df = spark.createDataFrame([(i, None if i == 3 else i) for i in range(20)], "i int, v int").repartition(4)
        out = transform.running_total(df, "v", order_by="i").orderBy("i").collect()
        assert out[3].RunningTotal_v is None and out[19].RunningTotal_v == sum(range(20)) - 3
        g = transform.running_total(df.withColumn("g", F.col("i") % 2), "v", "g", order_by="i").orderBy("i").collect()
        assert g[4].RunningTotal_v == 6

    def test_weighted_average(self, spark):
        df = spark.createDataFrame([("a", 10, 1), ("a", 20, 3), ("b", 5, 0)], "g string, v int, w int")
        assert [r.WeightedAverage for r in transform.weighted_average(df, "v", "w", "g").collect()] == [17.5, None]


class TestParse:
    def test_dates(self, spark):
        df = spark.createDataFrame([("03/15/2024",), (None,)], "d string")
        assert parse.date_time(df, "d", "%m/%d/%Y", "%Y-%m-%d").collect() == [("2024-03-15",), (None,)]
        assert parse.date_time(df, "d", output_fmt="%d. %B").first().d == "15. March"
        with pytest.raises(Exception):
            parse.date_time(spark.createDataFrame([("x",)], "d string"), "d").collect()
        assert parse.date_time(spark.createDataFrame([("x",)], "d string"), "d", errors="null").first().d is None

    def test_regex(self, spark):
        df = spark.createDataFrame([("ann.lee@x.org",), ("none",), (None,)], "e string")
        assert [r.Match for r in parse.regex_match(df, "e", r"@\w+").collect()] == [True, False, False]
        assert [tuple(r)[1:] for r in parse.regex_parse(df, "e", r"(?P<a>\w+)\.(\w+)@").collect()] == [("ann", "lee"), (None, None), (None, None)]
        assert parse.regex_replace(df, "e", r"(\w+)\.(\w+)", r"\2.$\g<1>").first().e == "lee.$ann@org.$x"
        with pytest.raises(ValueError):
            parse.regex_parse(df, "e", r"(a)(b)", ["one"])

    def test_optional_group(self, spark):
        df = spark.createDataFrame([("ac",), ("abc",)], "t string")
        assert [r.Group_1 for r in parse.regex_parse(df, "t", r"a(b)?c").collect()] == [None, "b"]
        assert [r.Group_1 for r in parse.regex_parse(df, "t", r"a(b*)c").collect()] == ["", "b"]

    def test_splits(self, spark, rows):
        df = spark.createDataFrame([(1, "a|b|c"), (2, "d"), (3, None)], "i int, t string")
        assert rows(parse.text_to_columns(df, "t", "|")) == [(1, "a", "b", "c"), (2, "d", None, None), (3, None, None, None)]
        assert rows(parse.text_to_columns(df, "t", "|", num_columns=2))[0] == (1, "a", "b|c")
        assert parse.text_to_columns(df, "t", "|", "rows").count() == 5
        assert [r.t for r in parse.regex_tokenize(df, "t", r"[|]").collect()] == ["a", "b", "c", "d", None]

    def test_xml(self, spark):
        df = spark.createDataFrame([("<r a='1'><n>x</n><m/></r>",), ("broken<",), (None,), ("<!DOCTYPE r [<!ENTITY e 'v'>]><r><n>&e;</n></r>",)], "x string")
        assert [r.ParsedXML for r in parse.xml_parse(df, "x", "n").collect()] == ["x", None, None, None]
        out = parse.xml_parse(df, "x", "r", "p", return_child_values=True)
        assert out.columns == ["x", "p_a", "p_m", "p_n"] and tuple(out.first())[1:] == ("1", "", "x")
        assert parse.xml_parse(df, "x", "n", return_outer_xml=True).first().ParsedXML == "<n>x</n>"


class TestDeveloper:
    def test_base64(self, spark):
        df = spark.createDataFrame([("é" * 100,), (None,)], "t string")
        e = develop.base64_encode(df, "t", "e")
        assert "\n" not in e.first().e and develop.base64_decode(e, "e", "d").filter("d <=> t").count() == 2

    def test_info_and_names(self, spark, people):
        info = {r.Name: r for r in develop.column_info(people).collect()}
        assert (info["Name"].NullCount, info["City"].UniqueCount, info["ID"].Size) == (1, 2, 40)
        book = spark.createDataFrame([("ID", "Name"), ("Name", "ID")], "OldName string, NewName string")
        assert develop.dynamic_rename(people, book).columns == ["Name", "ID", "Age", "City"]
        assert develop.dynamic_rename(people, spark.createDataFrame([("x_",)], "NewName string"), mode="prefix").columns[0] == "x_ID"
        assert develop.dynamic_select(people, "number").columns == ["ID", "Age"]
        assert develop.dynamic_select(people, dtype_exclude="number", pattern="^N").columns == ["Name"]
        with pytest.raises(ValueError):
            develop.dynamic_rename(people, book, mode="odd")

    def test_json(self, spark):
        df = spark.createDataFrame([(1, '{"a": {"b": 1.5, "c": "x"}, "n": 2}'), (2, '{"n": 3, "l": [1]}'), (3, "broken {"), (4, None), (5, "7")], "i int, j string")
        out = develop.json_parse(df, "j")
        got = {r.i: r.asDict() for r in out.collect()}
        assert got[1]["j_a.b"] == 1.5 and got[2]["j_n"] == 3 and got[2]["j_l"] == "[1]" and got[5]["j_value"] == "7"
        assert all(v is None for k, v in got[3].items() if k != "i")
        assert "n" in develop.json_parse(df, "j", "").columns

    def test_asserts(self, spark, people):
        assert develop.test(people, lambda d: F.count("*") == 5) is people
        with pytest.raises(ValueError, match="too few"):
            develop.test(people, "count(*) > 9", "too few")
        develop.test_equal(people, people.repartition(3))
        with pytest.raises(AssertionError):
            develop.test_equal(people, people.limit(4))
        near = spark.createDataFrame([(1.0,)], "v double"), spark.createDataFrame([(1.0001,)], "v double")
        develop.test_equal(*near, atol=0.01)
        with pytest.raises(AssertionError):
            develop.test_equal(*near)

    def test_download(self, spark):
        with use_spark(spark):
            got = develop.download("https://x.test/a", {"q": 1}, opener=lambda u: b'[{"a": 1}, {"a": 2}]' if u.endswith("?q=1") else b"")
            assert [r.a for r in got.collect()] == [1, 2]
            assert develop.download("https://x.test", opener=lambda u: b"plain").first().DownloadData == "plain"
            calls = []

            def flaky(u):
                calls.append(u)
                if len(calls) < 3:
                    raise OSError("down")
                return b'{"a": 1}'

            assert develop.download("https://x.test", opener=flaky, retry_delay=0).first().a == 1 and len(calls) == 3
        for bad in ("http://x.test", "file:///etc/passwd"):
            with pytest.raises(develop.InsecureURLError):
                develop.download(bad)


class TestInOut:
    @pytest.mark.parametrize("ext", ["csv", "tsv", "json", "jsonl", "parquet", "orc", "feather"])
    def test_round_trip(self, spark, tmp_path, ext):
        with use_spark(spark):
            df = spark.createDataFrame([(1, "a,b"), (2, "c\td")], "i int, t string")
            path = str(tmp_path / "sub" / f"x.{ext}")
            files.output_data(df, path, **({} if ext != "json" else {"format": "jsonl"}))
            assert (tmp_path / "sub" / f"x.{ext}").is_file()
            back = files.input_data(path, **({} if ext != "json" else {"format": "jsonl"}))
            assert sorted((r.i, r.t) for r in back.collect()) == [(1, "a,b"), (2, "c\td")]

    def test_folder_output(self, spark, tmp_path):
        with use_spark(spark):
            files.output_data(spark.range(10).withColumn("p", F.col("id") % 2), str(tmp_path / "t"), partition_by=["p"])
            assert files.input_data(str(tmp_path / "t")).count() == 10

    def test_errors(self, spark, tmp_path):
        with use_spark(spark):
            with pytest.raises(FileNotFoundError):
                files.input_data(str(tmp_path / "no.csv"))
            with pytest.raises(files.PickleRemovedError):
                files.input_data("x.pkl")
            with pytest.raises(ValueError):
                files.input_data(str(tmp_path / "x.unknown"))
            with pytest.raises(TypeError):
                files.output_data("no frame", "x.csv")
            with pytest.raises(FileNotFoundError):
                files.directory(str(tmp_path / "nowhere"))

    def test_inline_and_listing(self, spark, tmp_path, capsys):
        with use_spark(spark):
            assert files.text_input([{"a": 1}, {"a": None, "b": "x"}]).collect() == [(1, None), (None, "x")]
            assert files.text_input([[1, 2.5], [2, 3]], ["i", "v"]).dtypes == [("i", "bigint"), ("v", "double")]
            with pytest.raises(ValueError):
                files.text_input([[1]])
            with pytest.raises(TypeError):
                files.text_input(5)
            (tmp_path / "b.txt").write_text("x")
            (tmp_path / "a.csv").write_text("xy")
            assert [(r.FileName, r.Size) for r in files.directory(str(tmp_path)).collect()] == [("a.csv", 2), ("b.txt", 1)]
            assert files.directory(str(tmp_path), "*.zip").columns[0] == "FullPath"
            df = spark.range(3)
            assert files.browse(df) is df and "3 rows" in capsys.readouterr().out
            assert files.date_time_now().count() == 1


def test_share_of_rows_is_cut_by_numbers(spark):
    from anchorline.operators.preparation import sample

    df = spark.range(1000).repartition(5).withColumn("v", F.col("id") % 10)
    got = sample(df, pct=0.25, order_by="id")
    assert [r.id for r in got.orderBy("id").collect()] == list(range(250)) and got.columns == df.columns
    assert {r.id for r in sample(df, pct=0.01, position="last", order_by="id").collect()} == set(range(990, 1000))
    drawn = {r.id for r in sample(df, pct=0.5, random=True, random_state=3).collect()}
    assert len(drawn) == 500 and drawn != set(range(500))
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert sample(df.limit(0), pct=0.5).count() == 0


def test_broadcasts_are_checked_by_bytes(spark, monkeypatch):
    from anchorline import session

    small = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "k bigint, t string")
    assert session.is_small(small) and not session.is_small(small, bound=49)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 4_000)
    assert not session.is_small(small) and not session.is_small(small, rows=50) and session.is_small(small.select("k"))


def test_driver_writes_are_checked_by_bytes(spark, monkeypatch, tmp_path):
    from anchorline.sources import files

    monkeypatch.setattr(files, "MOST_DRIVER_BYTES", 10_000)
    wide = spark.createDataFrame([("x" * 6_000,)] * 2, "t string")
    with pytest.raises(ValueError, match="bytes"):
        files.output_data(wide, str(tmp_path / "a.html"))
    files.output_data(wide.limit(1), str(tmp_path / "a.html"))


def test_nothing_is_cut_silently(spark, monkeypatch):
    from anchorline.operators import develop, parse

    xml = spark.createDataFrame([("<a><b>1</b><c>2</c></a>",)], "x string")
    monkeypatch.setattr(parse, "MOST_FIELDS", 1)
    with pytest.raises(ValueError, match="more than 1"):
        parse.xml_parse(xml, "x", ".", return_child_values=True)
    names = spark.createDataFrame([("x", f"n{i:03d}") for i in range(100)] + [("y", "z")], "OldName string, NewName string")
    assert develop.dynamic_rename(spark.createDataFrame([(1, 2)], "x int, y int"), names).columns == ["n099", "z"]
