"""Operators for profiles, rolling totals, skew, hot decks and references, held against plain Python on small inputs."""

import math
import random
import statistics
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from anchorline.operators import hot_deck as hot_deck_module
from anchorline.operators import references, rolling, skew
from anchorline.operators import value_counts as vc
from anchorline.operators.groups import connected_components
from anchorline.operators.hot_deck import Target, hot_deck
from anchorline.operators.stand_ins import find_stand_ins, placeholder_text
from anchorline.session import is_small, materialize


class TestValueCounts:
    def frame(self, spark, data):
        return spark.createDataFrame(data, "load_id int, v string, n bigint")

    def test_deltas_add_and_take_away(self, spark):
        a, b = self.frame(spark, [(1, "x", 1), (1, None, 2), (1, "x", 2)]), self.frame(spark, [(2, "y", None)])
        store = vc.ValueCounts(spark).apply(a, "t").apply(b, "t")
        assert {(r.col, r.load_id, r.value): r.n for r in store.state().collect()}["v", 1, "x"] == 2
        store.apply(b, "t", sign=-1)
        assert {r.load_id for r in store.state().collect()} == {1}
        assert sorted(map(tuple, store.compact().state().collect()), key=str) == sorted(map(tuple, store.state().collect()), key=str)

    def test_reopened_store_sums_what_others_wrote(self, spark, tmp_path):
        a, b, path = self.frame(spark, [(1, "x", 1), (1, "y", 1)]), self.frame(spark, [(1, "x", 2), (2, "z", None)]), str(tmp_path / "store")
        counts = lambda store: {(r.load_id, r.value): r.n for r in store.state().filter("col = 'v'").collect()}
        vc.ValueCounts(spark, path).apply(a, "t")
        again = vc.ValueCounts(spark, path).apply(b, "t")
        assert counts(again) == {(1, "x"): 2, (1, "y"): 1, (2, "z"): 1}
        assert {(r.col, r.load_id): r.distinct_values for r in vc.profile_counts(again.state()).collect()}["v", 1] == 2
        undone = vc.ValueCounts(spark, path).apply(b, "t", sign=-1)
        assert counts(undone) == counts(undone.compact()) == {(1, "x"): 1, (1, "y"): 1}

    def test_profile(self, spark):
        df = self.frame(spark, [(1, "aa", 1), (1, "aa", 5), (1, "b", None), (1, None, -3), (2, "b", 7), (2, "c", 7), (3, None, None)])
        state = vc.ValueCounts(spark).apply(df, "t").state()
        got = {(r.col, r.load_id): r for r in vc.profile_counts(state, {("t", "v"): r"\A[a-b]+\z"}, {("t", "n")}).collect()}
        one = got["v", 1]
        assert (one.rows, one.nulls, one.distinct_values, one.violations, one.drift) == (4, 1, 2, 0, None)
        assert one.entropy_bits == pytest.approx(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3))
        assert got["v", 2].violations == 1 and got["v", 2].drift == pytest.approx(2 / 3)
        assert (got["n", 1].min_value, got["n", 1].max_value) == ("-3", "5")
        assert got["v", 3].entropy_bits == 0 and got["v", 3].min_value is None

    def test_empty_table(self, spark):
        store = vc.ValueCounts(spark).apply(self.frame(spark, []), "t")
        assert vc.profile_counts(store.state()).count() == 0
        assert vc.odd_loads(store.state(), median_columns={"n"}, share_columns={"v"}).count() == 0

    @pytest.mark.parametrize("scale", [1, 10**4, 10**9, 2**62])
    def test_median_matches_brute_force(self, spark, scale):
        r = random.Random(scale)
        data = [(g, r.randint(-scale, scale)) for g in "abc" for _ in range(r.randint(1, 40))] + [("d", None)]
        df = spark.createDataFrame(data, "g string, v bigint").groupBy("g", "v").agg(F.count("*").alias("n"))
        got = {x.g: x.median for x in vc.median_of_counts(df, ["g"], F.col("v")).collect()}
        low = {x.g: x.median for x in vc.median_of_counts(df, ["g"], F.col("v"), lower=True).collect()}
        for g in "abc":
            vals = [v for k, v in data if k == g]
            assert got[g] == pytest.approx(statistics.median(vals)) and low[g] == statistics.median_low(vals)
        assert "d" not in got

    def test_odd_loads(self, spark):
        data = []
        for load in range(1, 8):
            for i in range(40):
                v = "z" if load == 3 and i < 20 else "ab"[i % 2]
                data.append((load, None if load == 5 and i < 12 else v, 100 * (3 if load == 6 else 1) + i))
        state = vc.ValueCounts(spark).apply(self.frame(spark, data), "t").state()
        got = {(r.col, r.load_id, r.reason) for r in vc.odd_loads(state, median_columns={"n"}, share_columns={"v"}).collect()}
        assert got == {("v", 3, "share"), ("v", 5, "nulls"), ("n", 6, "median")}

    @pytest.mark.parametrize(("text", "good"), [("a.b+c@x-y.example", 1), ("", 0), ("a@b", 0), (".a@b.co", 0), ("a..b@c.de", 0), ("a@-b.de", 0), ("a@b.d", 0), ("a@b.de\n", 0), ("a@b.c1", 0), (" a@b.de", 0), ("ä@b.de", 0), ("a@b.de,c@d.de", 0)])
    def test_email_pattern(self, spark, text, good):
        df = spark.createDataFrame([(1, text)], "row_id bigint, e string")
        state = vc.ValueCounts(spark).apply(df, "t", ["e"], None).state()
        assert vc.bad_cells(df, state, "t", "e", vc.EMAIL).count() == 1 - good

    def test_bad_cells_with_repeats_and_extra_columns(self, spark):
        df = spark.createDataFrame([(i, "bad" if i % 3 else "a@b.de", "x") for i in range(60)] + [(99, None, "y")], "row_id bigint, value string, n string")
        state = vc.ValueCounts(spark).apply(df, "t", ["value"], None).state()
        assert vc.bad_cells(df, state, "t", "value", vc.EMAIL).count() == 40


class TestRolling:
    def brute(self, data, windows):
        last = max(d for _, d, _ in data if d)
        by = defaultdict(list)
        for e, d, a in data:
            if e is not None and d is not None:
                by[e].append((d, a))
        out = {}
        for e, own in by.items():
            day = min(d for d, _ in own)
            while day <= last:
                row = []
                for w in windows:
                    vals = [a for d, a in own if day - timedelta(w) < d <= day and a is not None]
                    row += [sum(vals), sum(vals) / w, len(vals)]
                out[e, day] = row
                day += timedelta(1)
        return out

    def test_against_brute_force(self, spark):
        r = random.Random(3)
        data = [(r.choice([1, 1, 1, 2, 3, None]), r.choice([None, *[date(2024, 1, 1) + timedelta(r.randint(0, 50)) for _ in range(9)]]), r.choice([None, -5, 3, 10])) for _ in range(120)]
        df = spark.createDataFrame(data, "c bigint, d date, a bigint").withColumn("extra", F.lit(1))
        got = {(x.c, x.d): list(x)[2:] for x in rolling.rolling_totals(df, "c", "d", "a").collect()}
        assert got == {k: pytest.approx(v) for k, v in self.brute(data, (7, 30)).items()}

    def test_empty_and_once(self, spark):
        df = spark.createDataFrame([], "c bigint, d date, a bigint")
        assert rolling.rolling_totals(df, "c", "d", "a").count() == 0
        dup = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 3, "n"), (None, 4, "n")], "t bigint, row_id bigint, v string")
        assert sorted((x.t or 0, x.v) for x in rolling.first_delivery(dup, "t", "row_id", ["v"]).collect()) == [(0, "n"), (0, "n"), (1, "a")]

    def test_days_are_counted_as_integers(self, spark):
        df = spark.createDataFrame([(1, date(2024, 2, 28), 10), (1, date(2024, 3, 2), 1), (2, date(2024, 3, 2), 5)], "c bigint, d date, a bigint")
        out = rolling.rolling_totals(df, "c", "d", "a")
        assert sorted((x.c, x.d.isoformat(), x.total_7) for x in out.collect()) == [(1, "2024-02-28", 10), (1, "2024-02-29", 10), (1, "2024-03-01", 10), (1, "2024-03-02", 11), (2, "2024-03-02", 5)]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(0," in plan and "sequence(at" not in plan

    def test_window_edges(self, spark):
        df = spark.createDataFrame([(1, date(2024, 1, 1), 10), (2, date(2024, 3, 1), 1)], "c bigint, d date, a bigint")
        got = {x.d: (x.total_7, x.total_30) for x in rolling.rolling_totals(df, "c", "d", "a").filter("c = 1").collect()}
        assert got[date(2024, 1, 7)] == (10, 10) and got[date(2024, 1, 8)] == (0, 10) and got[date(2024, 1, 30)] == (0, 10) and got[date(2024, 1, 31)] == (0, 0)
        assert max(got) == date(2024, 3, 1) and len(got) == 61


class TestSkew:
    def test_heavy_keys_and_salted_sums(self, spark):
        keys = ["hot"] * 500 + ["warm"] * 120 + [f"k{i}" for i in range(300)] + [None] * 80
        df = spark.createDataFrame([(k, i, i % 7) for i, k in enumerate(keys)], "k string, id bigint, v bigint")
        heavy = skew.heavy_keys(df, "k", 0.1)
        assert set(heavy) == {"hot", "warm"}
        agg = skew.salted_aggregate(df, ["k"], {"n": F.count("*"), "s": F.sum("v")}, {"n": F.sum("n"), "s": F.sum("s")}, F.col("id"), skew.is_in(F.col("k"), heavy))
        want = Counter(keys)
        assert {r.k: r.n for r in agg.collect()} == want
        assert {r.k: r.s for r in agg.collect()}["hot"] == sum(i % 7 for i in range(500))

    def test_edges(self, spark):
        empty = spark.createDataFrame([], "k string, id bigint")
        assert skew.heavy_keys(empty, "k", 0.1) == []
        assert skew.salted_aggregate(empty, ["k"], {"n": F.count("*")}, {"n": F.sum("n")}, F.col("id"), skew.is_in(F.col("k"), [])).count() == 0
        nulls = spark.createDataFrame([(None, 1)] * 5, "k string, id bigint")
        assert skew.heavy_keys(nulls, "k", 0.5) == []
        with pytest.raises(ValueError):
            skew.heavy_keys(empty, "k", 0.00001)


def sales(spark, n=1500, seed=1, hot=0.35, scaled=50):
    """Sales with known missing cells: (frame, {(row_id, col)})."""
    r = random.Random(seed)
    price = {f"P{i}": r.randint(20, 900) for i in range(25)}
    group = {p: f"C{i % 5}" for i, p in enumerate(price)}
    data, missing = [], set()
    for i in range(n):
        p = "P0" if r.random() < hot else r.choice(list(price))
        q, load = r.randint(1, 5), i % 6
        row = {"Amount": price[p] * q * (scaled if load == 4 else 1), "Quantity": q, "Category": group[p]}
        for c, bad in (("Amount", [None, -1, 99999999]), ("Quantity", [None, 999, -1]), ("Category", [None, "n/a", " ", "TBD", "??", "Other"])):
            if r.random() < 0.06:
                row[c] = r.choice(bad)
                missing.add((i, c))
        data.append((i, p if r.random() > 0.03 else None, row["Category"], row["Amount"], row["Quantity"], date(2024, 1, 1) + timedelta(r.randint(0, 90)), load, f"cust{i % 40}"))
    return spark.createDataFrame(data, "row_id bigint, Product string, Category string, Amount bigint, Quantity bigint, Date date, load_id int, CustomerID string"), missing, price, group


class TestStandInsAndHotDeck:
    def test_found_and_filled(self, spark):
        df, missing, price, group = sales(spark)
        known = find_stand_ins(df, "Product", "Category", "Amount", "Quantity", "load_id")
        assert known.values("Amount") == ["-1", "99999999"] and known.values("Quantity") == ["-1", "999"]
        assert set(known.values("Category")) == {"n/a", " ", "TBD", "??", "Other"}
        cond = {c: F.col(c).isNull() | F.col(c).cast("string").isin(known.values(c)) for c in ("Amount", "Quantity", "Category")}
        targets = [Target("Amount", [["Product", "Quantity"], ["Product"], []]), Target("Quantity", [["Product", "Amount"], ["Product"], []]), Target("Category", [["Product"], ["CustomerID"], []], numeric=False, timed=False)]
        deck = hot_deck(df, targets, cond, "row_id", "Date")
        assert {(r.row_id, r.col) for r in deck.cells.collect()} == missing
        rows = {r.row_id: r for r in deck.filled.collect()}
        assert len(rows) == 1500 and set(df.columns) < set(deck.filled.columns)
        for i, c in missing:
            assert rows[i][f"{c}_filled"] and rows[i][c] is not None and rows[rows[i][f"{c}_donor"]][f"{c}_filled"] is False
            assert rows[rows[i][f"{c}_donor"]][c] == rows[i][c]  # the value occurs in the named donor
        hits = [rows[i].Category == group[rows[i].Product] for i, c in missing if c == "Category" and rows[i].Product]
        assert all(hits)

    def test_filled_amounts_are_right(self, spark):
        df, missing, price, _ = sales(spark, scaled=1)
        gone = {"Amount": F.col("Amount").isNull() | F.col("Amount").isin(-1, 99999999)}
        deck = hot_deck(df, [Target("Amount", [["Product", "Quantity"], ["Product", "Quantity"], ["Product"], []])], gone, "row_id", "Date")
        rows = {r.row_id: r for r in deck.filled.collect()}
        right = [rows[i].Amount == price[rows[i].Product] * rows[i].Quantity for i, c in missing if c == "Amount" and rows[i].Product and (i, "Quantity") not in missing]
        assert sum(right) > 0.9 * len(right)

    def test_nearest_donor_in_time_wins(self, spark):
        d = date(2024, 5, 1)
        data = [(1, "A", 1, 10, d), (2, "A", 1, 10, d + timedelta(1)), (3, "A", 1, 99, d + timedelta(20)), (4, "A", 1, None, d + timedelta(1)), (5, "A", 1, None, d + timedelta(20)), (6, "B", 1, None, d)]
        df = spark.createDataFrame(data, "row_id bigint, Product string, Quantity bigint, Amount bigint, Date date")
        df = df.withColumns({c: F.lit(7) for c in ("_id", "_m0", "_f0", "_day", "value", "donors")})  # names used inside
        deck = hot_deck(df, [Target("Amount", [["Product", "Quantity"], []])], {"Amount": F.col("Amount").isNull()}, "row_id", "Date")
        got = {r.row_id: (r.value, r.donor_id, r.level) for r in deck.cells.collect()}
        assert got == {4: ("10", 2, 1), 5: ("99", 3, 1), 6: ("10", 1, 2)}

    def test_nearest_donor_across_months_and_in_wider_blocks(self, spark):
        d = date(2024, 5, 31)
        data = [(1, "A", 1, 50, date(2024, 5, 2)), (2, "A", 1, 10, d + timedelta(1)), (3, "A", 1, None, d)]  # the month before the nearest donor
        data += [(4, "B", 1, 30, date(2024, 1, 1)), (5, "B", 1, 30, date(2024, 1, 2)), (6, "B", 1, 70, date(2024, 9, 1)), (7, "B", 1, None, date(2024, 7, 15))]
        data += [(8, "B", 9, None, date(2024, 8, 31)), (9, "B", 9, None, None), (10, "C", 1, None, date(2024, 1, 2))]
        df = spark.createDataFrame(data, "row_id bigint, Product string, Quantity bigint, Amount bigint, Date date")
        deck = hot_deck(df, [Target("Amount", [["Product", "Quantity"], ["Product", "Quantity"], ["Product"], []])], {"Amount": F.col("Amount").isNull()}, "row_id", "Date")
        got = {r.row_id: (r.value, r.donor_id, r.level) for r in deck.cells.collect()}
        assert got == {3: ("10", 2, 1), 7: ("70", 6, 2), 8: ("70", 6, 3), 9: ("30", 4, 3), 10: ("30", 5, 4)}

    def test_wider_blocks_take_no_more_passes(self, spark, monkeypatch):
        d = date(2024, 5, 1)
        data = [(1, "A", "X", 1, 10, d), (2, "B", "X", 1, 20, d), (3, "A", "X", 2, None, d), (4, "C", "X", 1, None, d + timedelta(2)), (5, "C", "Y", 1, None, d), (6, "A", "X", 1, None, None), (7, None, None, None, None, d)]
        df = spark.createDataFrame(data, "row_id bigint, Product string, Category string, Quantity bigint, Amount bigint, Date date")
        written, got = [], []
        real = hot_deck_module.materialize
        monkeypatch.setattr(hot_deck_module, "materialize", lambda x, name="table": (written.append(name), real(x, name))[1])
        for blocks in ([["Product", "Quantity"], []], [["Product", "Quantity"], ["Product", "Quantity"], ["Product"], ["Category"], []]):
            written.clear()
            deck = hot_deck(df, [Target("Amount", blocks)], {"Amount": F.col("Amount").isNull()}, "row_id", "Date")
            got.append((len(written), {r.row_id: (r.value, r.donor_id, r.donors, r.level) for r in deck.cells.collect()}))
        assert got[0][0] == got[1][0]
        assert got[1][1] == {3: ("10", 1, 1, 3), 4: ("10", 1, 2, 4), 5: ("10", 1, 2, 5), 6: ("10", 1, 1, 2), 7: ("10", 1, 2, 5)}

    def test_many_blocks_are_not_broadcast(self, spark, monkeypatch):
        df, *_ = sales(spark, n=400)
        targets = [Target("Amount", [["Product", "Quantity"], ["Product"], ["Category"], []]), Target("Category", [["Product"], ["CustomerID"], []], numeric=False, timed=False)]
        gone = {"Amount": F.col("Amount").isNull(), "Category": F.col("Category").isNull()}
        cells = lambda: sorted(map(tuple, hot_deck(df, targets, gone, "row_id", "Date").cells.collect()))
        few = cells()
        monkeypatch.setattr(hot_deck_module, "join_small", lambda x, small, on, how="inner": x.join(small.hint("merge"), on, how))
        for small in (lambda x: False, lambda x: "_k" in x.columns):
            monkeypatch.setattr(hot_deck_module, "is_small", small)
            assert cells() == few

    def test_few_blocks_are_found_by_plain_features(self, spark, monkeypatch):
        df, *_ = sales(spark, n=400)
        plans, real = [], hot_deck_module.materialize
        monkeypatch.setattr(hot_deck_module, "materialize", lambda x, name="table": (plans.append((name, x._jdf.queryExecution().optimizedPlan().toString())), real(x, name))[1])
        hot_deck(df, [Target("Amount", [["Product", "Quantity"], ["Product"], ["Category"], []])], {"Amount": F.col("Amount").isNull()}, "row_id", "Date")
        days = [p for name, p in plans if name in ("donor-days", "donors")]
        assert len(days) == 2 and not any("explode(array(CASE" in p or "named_struct" in p for p in days)

    def test_one_scan_fits_all_numbers(self, spark):
        df = spark.createDataFrame([(p, "X", a, q, 1) for p in "AB" for a, q in [(10, 1), (20, 2), (30, 3), (10, 1), (0, 1), (None, 0), (10, None), (7777, 1)]], "Product string, Category string, Amount bigint, Quantity bigint, load_id int")
        known = find_stand_ins(df, "Product", "Category", "Amount", "Quantity", "load_id")
        assert known.values("Amount") == ["0", "7777"] and known.values("Quantity") == ["0"]

    def test_ids_far_apart(self, spark):
        df, *_ = sales(spark, n=300)
        gone = {"Amount": F.col("Amount").isNull() | F.col("Amount").isin(-1, 99999999)}
        far = df.withColumn("row_id", F.when(F.col("row_id") < 150, F.col("row_id") - (1 << 62)).otherwise(F.col("row_id")))
        near, wide = (hot_deck(x, [Target("Amount", [["Product"], []])], gone, "row_id", "Date").cells.collect() for x in (df, far))
        back = lambda i: None if i is None else i + (1 << 62) if i < 0 else i
        assert {(r.row_id, r.value, r.donor_id) for r in near} == {(back(r.row_id), r.value, back(r.donor_id)) for r in wide}

    def test_nested_columns_can_be_small(self, spark):
        assert is_small(materialize(spark.createDataFrame([(("a", 1),)], "k struct<a:string,b:int>")))

    def test_edges(self, spark):
        schema = "row_id bigint, Product string, Category string, Amount bigint, Quantity bigint, Date date, load_id int"
        empty = spark.createDataFrame([], schema)
        assert find_stand_ins(empty, "Product", "Category", "Amount", "Quantity", "load_id").found.count() == 0
        none = spark.createDataFrame([(1, None, None, None, None, None, None)], schema)
        deck = hot_deck(none, [Target("Amount", [["Product"], []])], {"Amount": F.col("Amount").isNull()}, "row_id", "Date")
        assert [tuple(r) for r in deck.cells.select("value", "donors").collect()] == [(None, 0)]
        assert deck.filled.first().Amount_filled is False
        with pytest.raises(ValueError):
            hot_deck(none.withColumn("Amount_filled", F.lit(1)), [Target("Amount", [[]])], {"Amount": F.col("Amount").isNull()}, "row_id", "Date")

    def test_placeholder_texts(self, spark):
        df = spark.createDataFrame([("",), (" \t",), ("-",), ("N/A",), ("#N/A",), ("None",), ("Nonesuch",), ("A",), ("7",)], "t string")
        assert [r[0] for r in df.select(placeholder_text(F.col("t"))).collect()] == [True] * 6 + [False] * 3


class TestReferences:
    def test_against_brute_force(self, spark):
        r = random.Random(5)
        t0 = datetime(2024, 1, 1)
        loads = [t0 + timedelta(days=10 * i) for i in range(6)]
        parents = [(k, t0 + timedelta(days=r.randint(-20, 60)), r.choice([None, None, t0 + timedelta(days=r.randint(0, 80))])) for k in r.sample(range(10**6, 10**6 + 90_000), 300)]
        parents += [(k, a + timedelta(days=5), None) for k, a, _ in parents[:30]] + [(None, t0, None), (7, None, None)]
        refs = [(i, r.choice([p[0] for p in parents] + [1, 2, 3, None]) if i % 3 else 42, r.choice(loads), date(2024, r.randint(1, 3), 3)) for i in range(2000)]
        a = spark.createDataFrame(refs, "row_id bigint, k bigint, at timestamp_ntz, Date date").withColumn("kind", F.lit("other"))
        b = spark.createDataFrame(parents, "k bigint, arrived timestamp_ntz, gone timestamp_ntz")
        first, gone = {}, {}
        for k, x, g in parents:
            if k is not None:
                first[k] = min([v for v in (first.get(k), x) if v is not None], default=None)
                gone[k] = min([v for v in (gone.get(k), g) if v is not None], default=None)

        def kind(k, at):
            if k is None:
                return None
            if k not in first:
                return "missing"
            if first[k] is None or first[k] > at:
                return "late"
            return "deleted" if gone[k] is not None and gone[k] <= at else None

        want = {(i, kind(k, at)) for i, k, at, _ in refs if kind(k, at)}
        got = references.orphan_rows(a, b, "k", "at", "arrived", "gone", ["row_id", "Date", "kind"])
        assert {(x.row_id, x.kind) for x in got.collect()} == want
        report = references.orphan_report(got, "t", "Date")
        assert sum(x.rows for x in report.collect()) == len(want)

    def test_edges(self, spark):
        refs = spark.createDataFrame([("x", datetime(2024, 1, 1))], "k string, at timestamp_ntz")
        none = spark.createDataFrame([], "k string, a timestamp_ntz")
        assert [tuple(r) for r in references.orphan_pairs(refs, none, "k", "at", "a", None).select("k", "kind").collect()] == [("x", "missing")]
        assert references.orphan_pairs(refs.limit(0), none, "k", "at", "a", None).count() == 0

    @pytest.mark.parametrize(("keys", "periods", "part"), [(6000, 2, 1_000_000), (40, 3000, 700), (40, 3000, 1_000_000)])
    def test_dense_and_sparse_containers_and_parts(self, spark, monkeypatch, keys, periods, part):
        """Many keys of few periods, and a period of its own for every row of few keys, one of which holds most rows."""
        monkeypatch.setattr(references, "PART", part)
        r, t0 = random.Random(8), datetime(2024, 1, 1)
        parents = [(k, t0 + timedelta(seconds=r.randrange(4000)), t0 + timedelta(seconds=r.randrange(8000)) if k % 3 == 0 else None) for k in range(0, keys, 2)]
        refs = [(i, (i % keys) if i % 2 or periods < 3 else 4, t0 + timedelta(seconds=i % periods)) for i in range(keys * 2 if periods < 3 else periods)]
        a = spark.createDataFrame(refs, "row_id bigint, k bigint, at timestamp_ntz").repartition(3)
        b = spark.createDataFrame(parents, "k bigint, arrived timestamp_ntz, gone timestamp_ntz")
        there = {k: (x, g) for k, x, g in parents}
        kind = lambda k, at: "missing" if k not in there else "late" if there[k][0] > at else "deleted" if there[k][1] is not None and there[k][1] <= at else None
        want = {(i, kind(k, at)) for i, k, at in refs if kind(k, at)}
        assert {tuple(x) for x in references.orphan_rows(a, b, "k", "at", "arrived", "gone", ["row_id"]).collect()} == want

    def test_codes_are_dense_and_ordered(self, spark):
        keys = spark.createDataFrame([(f"{i:05d}",) for i in range(500)] * 2 + [(None,)], "k string")
        got = sorted((r.k, r.code) for r in references.dense_codes(keys, "k").collect())
        assert got == [(f"{i:05d}", i) for i in range(500)]


class TestComponents:
    def test_random_graph(self, spark):
        r = random.Random(2)
        edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(5, 5), (None, 3)]
        parent = list(range(301))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a is not None:
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        got = connected_components(spark.range(301), spark.createDataFrame(edges, "a bigint, b bigint"), "id", "a", "b")
        assert {x.id: x.component for x in got.collect()} == {i: find(i) for i in range(301)}
