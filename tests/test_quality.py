"""Contracts, profile, personal data, audit and reports."""

import hashlib
import json
import warnings
from datetime import UTC, datetime, timedelta

import pytest

from anchorline.quality import audit, contracts, pii, report, schema_io
from anchorline.quality.profile import profile


@pytest.fixture()
def df(spark):
    return spark.createDataFrame([(1, "ann", 2.5, datetime(2024, 1, 1)), (2, "bob", None, datetime(2024, 1, 5)), (2, None, -1.0, None)], "id bigint, name string, score double, ts timestamp")


class TestContracts:
    def test_infer_and_keep(self, df):
        schema = contracts.infer_schema(df)
        assert schema["columns"]["score"] == {"dtype": "double", "nullable": True} and not schema["columns"]["id"]["nullable"]
        assert contracts.expect_schema(df, schema) is df

    @pytest.mark.parametrize(("rule", "count"), [({"min_value": 0}, 1), ({"max_value": 2}, 1), ({"min_value": -5}, 0)])
    def test_numbers(self, df, rule, count):
        assert len(contracts.violations(df, {"columns": {"score": {"dtype": "float"} | rule}})) == count

    @pytest.mark.parametrize(("rule", "count"), [({"allowed_values": ["ann"]}, 1), ({"value_regex": "[a-z]+"}, 0), ({"value_regex": "an"}, 1), ({"min_length": 4}, 1), ({"max_length": 2}, 1), ({"nullable": False}, 1), ({"unique": True}, 0), ({"dtype": "int"}, 1), ({"dtype": "any"}, 0)])
    def test_texts(self, df, rule, count):
        assert len(contracts.violations(df, {"columns": {"name": rule}})) == count

    def test_messages_and_modes(self, df):
        bad = {"columns": {"missing": "int", "id": {"dtype": "int64", "unique": True}, "name": {"allowed_values": ["ann"]}}}
        with pytest.raises(contracts.SchemaViolationError) as e:
            contracts.expect_schema(df, bad)
        assert len(e.value.violations) == 3 and "'bob'" in str(e.value) and "missing" in str(e.value)
        with pytest.warns(UserWarning):
            assert contracts.expect_schema(df, bad, strict=False) is df
        with pytest.warns(UserWarning):
            contracts.expect_schema(df, {})
        with pytest.raises(TypeError):
            contracts.expect_schema("x", bad)

    def test_regex_is_full_match(self, spark):
        d = spark.createDataFrame([("abc\n",)], "t string")
        assert contracts.violations(d, {"t": {"value_regex": "abc"}})

    def test_volume_and_freshness(self, df):
        assert contracts.expect_row_count(df, 1, 3) is df
        with pytest.raises(contracts.SchemaViolationError):
            contracts.expect_row_count(df, min_rows=4)
        now = datetime(2024, 1, 6, tzinfo=UTC)
        assert contracts.expect_freshness(df, "ts", timedelta(days=2), now) is df
        with pytest.raises(contracts.FreshnessError):
            contracts.expect_freshness(df, "ts", timedelta(hours=1), now)
        with pytest.warns(UserWarning):
            contracts.expect_freshness(df.filter("ts is null"), "ts", timedelta(1))

    def test_suite_audit_report(self, spark, df, tmp_path):
        trail = audit.AuditTrail(tmp_path / "a" / "trail.jsonl", [audit.WebhookForwarder("https://down.invalid", timeout=0.01)], "me")
        suite = contracts.ContractSuite("s", audit=trail).add_contract("x", {"id": {"dtype": "int"}}, "ids").add_contract("x", {"name": {"nullable": False}}, strict=False).add_volume_check("x", max_rows=1).add_freshness_check("y", "ts", timedelta(1)).add_freshness_check("x", "nope", timedelta(1))
        out = suite.run({"x": df})
        assert len(suite) == 5 and [(r.Contract, r.Status) for r in out.collect()] == [("x", "PASS"), ("x", "WARN"), ("x:volume", "FAIL"), ("y:freshness", "SKIPPED"), ("x:freshness", "ERROR")]
        with pytest.raises(contracts.SchemaViolationError):
            suite.run({"x": df}, raise_on_failure=True)
        assert trail.load().count() == 10 and trail.load(days=1).count() == 10 and trail.load(run_id="no").count() == 0
        page = report.export_report(out.withColumnRenamed("Description", "Description"), tmp_path / "r.html", title="<b>").read_text()
        assert "&lt;b&gt;" in page and "FAIL" in page
        assert json.loads(report.export_report(out, tmp_path / "r.json").read_text())["summary"]["total"] == 5
        with pytest.raises(ValueError):
            report.export_report(out, tmp_path / "r.pdf")
        trail.clear()
        assert trail.load().count() == 0

    def test_schema_files(self, tmp_path):
        for name in ("s.yaml", "s.json", "s.yml"):
            schema_io.save_schema({"columns": {"id": {"dtype": "int"}}}, tmp_path / name)
            assert schema_io.load_schema(tmp_path / name) == {"columns": {"id": {"dtype": "int"}}}
        (tmp_path / "bare.yaml").write_text("id: int\n")
        assert schema_io.load_schema(tmp_path / "bare.yaml") == {"columns": {"id": "int"}}
        for bad, error in (("no.yaml", FileNotFoundError), ("s.txt", ValueError)):
            (tmp_path / "s.txt").write_text("x")
            with pytest.raises(error):
                schema_io.load_schema(tmp_path / bad)


def test_profile(df, spark):
    got = {r.Column: r for r in profile(df).collect()}
    assert (got["id"].Unique_Count, got["id"].Mean, got["name"].Null_Count, got["name"].Min) == (2, pytest.approx(5 / 3, abs=1e-6), 1, "ann")
    assert got["id"].Top_Values == "2 (2), 1 (1)" and got["score"].Null_Rate_Pct == pytest.approx(33.3333)
    assert profile(df.limit(0)).count() == 4


class TestPII:
    def test_scan(self, spark):
        d = spark.createDataFrame([("a@b.org", "555-123-4567", "see 10.0.0.1", "x")] * 3 + [(None, None, "nothing", "y")], "email string, note string, text string, plain string")
        with pytest.warns(pii.PIIWarning):
            got = {(r.Column, r.PII_Type): r for r in pii.scan_pii(d).collect()}
        assert got["email", "email"].Confidence == "high" and got["email", "email"].Detection_Method == "column_name"
        assert got["note", "phone_us"].Confidence == "high" and got["text", "ip_address"].Confidence == "high" and not any(c == "plain" for c, _ in got)
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            assert pii.scan_pii(d.select("plain")).count() == 0

    def test_mask(self, spark):
        d = spark.createDataFrame([("a@b.org", 1), (None, 2), ("c@d.org", 3), ("a@b.org", 4)], "email string, i int").coalesce(1)
        rep = pii.scan_pii(d, warn=False)
        assert {r.email for r in pii.mask_pii(d, rep).collect()} == {"[REDACTED]"}
        assert [r.email for r in pii.mask_pii(d, rep, "hash").orderBy("i").collect()][:2] == [hashlib.sha256(b"a@b.org").hexdigest()[:12], None]
        out = pii.mask_pii(d, rep, "pseudonymise")
        assert [r.email for r in out.df.orderBy("i").collect()] == ["EMAIL_1", None, "EMAIL_2", "EMAIL_1"]
        for bad in ({"strategy": "odd"}, {"report": None}):
            with pytest.raises(ValueError):
                pii.mask_pii(d, **({"report": rep} | bad))

    def test_mapping(self, tmp_path):
        with pytest.warns(pii.MappingSecurityWarning):
            pii.save_mapping({"email": {"a": "EMAIL_1"}}, str(tmp_path / "m.json"))
        assert pii.load_mapping(str(tmp_path / "m.json")) == {"email": {"a": "EMAIL_1"}}
        pytest.importorskip("cryptography")
        pii.save_mapping({"x": {}}, str(tmp_path / "e"), "key")
        assert pii.load_mapping(str(tmp_path / "e"), "key") == {"x": {}}
        with pytest.raises(ValueError):
            pii.load_mapping(str(tmp_path / "e"), "other")


def test_full_scan_query_sees_values_after_the_first_hundred(spark, tmp_path):
    from anchorline.queries import governance, reference  # noqa: F401 (governance registers its queries)

    data = [(i, "Nina Vo" if i < 150 else "nina@vo.example", "Lakes", None) for i in range(160)]
    spark.createDataFrame(data, "CustomerID bigint, Name string, Region string, Tier string").coalesce(1).write.parquet(str(tmp_path / "demo_customers.parquet"))
    got = {(r.Column, r.PII_Type): (r.Matches, r.Texts) for r in reference.QUERIES["pii_scan_full"](spark, str(tmp_path)).collect()}
    assert got == {("Name", "email"): (10, 160), ("CustomerID", "internal_cust_id"): (None, None)}


def test_python_patterns_in_contracts(spark):
    from anchorline.quality.contracts import violations

    df = spark.createDataFrame([("abc",), ("ab1",)], "c string")
    assert len(violations(df, {"columns": {"c": {"value_regex": "(?P<x>[a-z]+)"}}})) == 1
    assert violations(df, {"columns": {"c": {"value_regex": r"(?P<x>\w)\w+"}}}) == []
