"""Pipelines, secrets, guards, lineage, the converter, streams and the command line."""

import json

import pytest
import yaml

from anchorline.plans import cli, guard, secrets
from anchorline.plans.convert import WorkflowConverter, plugin_name, translate
from anchorline.plans.lineage import LineageCollector
from anchorline.plans.pipeline import Pipeline, PipelineSpec
from anchorline.session import use_spark
from anchorline.streaming import adapter


@pytest.fixture()
def csv(tmp_path):
    (tmp_path / "in.csv").write_text("Region,Revenue\nN,100\nS,50\nN,200\n,70\n")
    return tmp_path


def spec(csv):
    return {"name": "demo", "steps": [
        {"id": "load", "tool": "InOut.input_data", "args": {"path": str(csv / "in.csv")}},
        {"id": "split", "tool": "Preparation.filter", "inputs": {"df": "load"}, "args": {"condition": "Revenue > 60"}},
        {"id": "both", "tool": "Join.union", "inputs": {"dfs": ["split.true", "split.1"]}},
        {"id": "sum", "tool": "Transform.summarize", "inputs": {"df": "split.0"}, "args": {"group_by": "Region", "aggregations": {"Revenue": "sum"}}, "output_schema": {"columns": {"Region": {"dtype": "str", "nullable": False}}}},
        {"id": "save", "tool": "InOut.output_data", "inputs": {"df": "sum"}, "args": {"path": str(csv / "out.csv")}},
    ]}


class TestPipeline:
    def test_run(self, spark, csv):
        lines, seen = LineageCollector("test", "x"), []
        (csv / "p.yaml").write_text(yaml.safe_dump(spec(csv)))
        pipe = Pipeline(csv / "p.yaml", lineage_collector=lines, on_step_complete=lambda i, m: seen.append(i), cache_shared=True, eager_metrics=True)
        assert pipe.validate() == []
        with use_spark(spark):
            metrics = pipe.run()
        assert (csv / "out.csv").read_text().strip() == "Region,Sum_Revenue\nN,300"
        assert pipe.state["both"].count() == 4 and seen == [m["step_id"] for m in metrics] and {m["status"] for m in metrics} == {"success"}
        assert {m["step_id"]: m["output_rows"] for m in metrics}["sum"] == 1
        events = lines.to_openlineage_events()
        assert len(events) == 5 and events[1]["inputs"][0]["name"] == "demo.load" and events[3]["outputs"][0]["facets"]["schema"]["fields"][0]["name"] == "Region"

    def test_problems_are_found_before_running(self, csv):
        s = spec(csv)
        s["steps"][1]["inputs"]["df"] = "nowhere"
        s["steps"][2]["tool"] = "os.system"
        s["steps"][3]["args"]["strange"] = 1
        s["steps"][4]["args"] = {}
        found = Pipeline(s).validate()
        assert len(found) == 4 and any("not found in pipeline state" in x for x in found) and any("Could not find tool" in x for x in found)
        for bad in ({}, {"steps": [{}]}, []):
            with pytest.raises(ValueError):
                PipelineSpec.of(bad)

    def test_errors_are_reported_and_raised(self, spark, csv):
        s, errors = spec(csv), []
        s["steps"][3]["output_schema"] = {"columns": {"Nope": "int"}}
        pipe = Pipeline(s, on_step_error=lambda i, e: errors.append(i))
        with use_spark(spark), pytest.raises(ValueError):
            pipe.run()
        assert errors == ["sum"] and pipe.metrics[-1]["status"] == "error"
        for ref in ("load.1", "split.7", "split.nope", "gone"):
            with pytest.raises(ValueError):
                pipe._resolve(ref)
        with pytest.raises(FileNotFoundError):
            Pipeline(csv / "none.yaml")

    def test_guard(self, spark, csv, monkeypatch):
        with pytest.raises(guard.AccessDeniedError, match="(?i)access denied"):
            Pipeline(spec(csv), guard=guard.PipelineGuard(lambda p, a: False)).run()
        guard.AllowAllGuard().check("x")
        with pytest.raises(guard.AccessDeniedError, match="guard raised"):
            guard.PipelineGuard(lambda p, a: 1 / 0).check("x")
        env = guard.EnvRoleGuard("T_ALLOWED", "T_ROLE")
        with pytest.raises(guard.AccessDeniedError):
            env.check("x")
        monkeypatch.setenv("T_ALLOWED", "a, b")
        monkeypatch.setenv("T_ROLE", "b")
        env.check("x")

    def test_secrets(self, monkeypatch):
        monkeypatch.setenv("T_HOST", "h")
        assert secrets.resolve_secrets({"a": ["${T_HOST}:1", 5, None], "b": "${env:T_HOST}"}) == {"a": ["h:1", 5, None], "b": "h"}
        with pytest.raises(secrets.SecretResolutionError) as e:
            secrets.resolve_secrets("${T_NOT_SET}")
        assert e.value.var_name == "T_NOT_SET"
        assert secrets.has_unresolved_tokens(["x", {"k": "${A}"}]) and not secrets.has_unresolved_tokens(42)

    def test_cli(self, spark, csv, capsys):
        (csv / "p.yaml").write_text(yaml.safe_dump(spec(csv)))
        with use_spark(spark):
            assert cli.main(["validate", str(csv / "p.yaml")]) == 0
            assert cli.main(["run", str(csv / "p.yaml")]) == 0
            assert cli.main(["explain", str(csv / "p.yaml")]) == 0
            assert cli.main(["run", str(csv / "no.yaml")]) == 1
        assert "sum: success" in capsys.readouterr().out


NODE = "<Node ToolID='{i}'><GuiSettings Plugin='{p}'><Position x='{x}' y='0'/></GuiSettings><Properties><Configuration>{c}</Configuration><Annotation><Name>{n}</Name></Annotation></Properties></Node>"


def workflow(nodes, edges):
    n = "".join(NODE.format(i=i, p=f"Gui.{p}.{p}", x=10 * i, c=c, n=name) for i, p, name, c in nodes)
    e = "".join(f"<Connection><Origin ToolID='{a}' Connection='{x}'/><Destination ToolID='{b}' Connection='{y}'/></Connection>" for a, x, b, y in edges)
    return f"<Doc><Nodes>{n}</Nodes><Connections>{e}</Connections></Doc>"


class TestConverter:
    def test_converted_workflow_runs(self, spark, csv):
        xml = workflow(
            [
                (1, "DbFileInput", "Load Sales", f"<File>{csv / 'in.csv'}</File>"), (2, "Filter", "Big", "<Expression>[Revenue] &gt;= 60 AND !IsEmpty([Region])</Expression>"),
                (3, "Formula", "", "<FormulaFields><FormulaField field='Tax' expression='[Revenue] * 0.1'/><FormulaField field='Kind' expression='IF [Revenue] &gt; 150 THEN &quot;hi&quot; ELSE &quot;lo&quot; ENDIF'/></FormulaFields>"),
                (4, "Summarize", "", "<SummarizeFields><SummarizeField field='Region' action='GroupBy'/><SummarizeField field='Tax' action='Sum'/><SummarizeField field='Tax' action='CountNull'/></SummarizeFields>"),
                (5, "Union", "", ""), (6, "Mystery", "", ""), (7, "Select", "", "<SelectFields><SelectField field='Region' selected='True' rename='R' type='V_String'/><SelectField field='Kind' selected='False'/></SelectFields>"),
            ],
            [(1, "Output", 2, "Input"), (2, "True", 3, "Input"), (3, "Output", 4, "Input"), (2, "True", 5, "#1"), (2, "False", 5, "#2"), (5, "Output", 6, "Input"), (3, "Output", 7, "Input")],
        )
        (csv / "w.xml").write_text(xml)
        made = WorkflowConverter(csv / "w.xml")
        assert made.node_count == 7 and made.mapped == 6 and made.coverage == pytest.approx(6 / 7) and len(made.warnings) == 1
        config = yaml.safe_load(made.to_yaml())
        assert config == made.to_dict()
        config["steps"] = [s for s in config["steps"] if not s["tool"].startswith("TODO")]
        pipe = Pipeline(config)
        assert pipe.validate() == []
        with use_spark(spark):
            pipe.run()
        by = {s["id"]: s for s in config["steps"]}
        total = pipe.state["summarize_4"].collect()
        assert [(r[0], round(r[1], 6), r[2]) for r in total] == [("N", 30.0, 0)]
        assert pipe.state["union_5"].count() == 4 and pipe.state["select_7"].columns == ["R"]
        assert by["union_5"]["inputs"]["dfs"] == ["big_2.0", "big_2.1"]

    def test_join_sides_and_cycle(self, tmp_path):
        xml = workflow([(1, "TextInput", "a", ""), (2, "TextInput", "b", ""), (3, "Join", "j", "<JoinInfo connection='Left'><Field field='k'/></JoinInfo><JoinInfo connection='Right'><Field field='m'/></JoinInfo>"), (4, "Sort", "s", ""), (5, "Sort", "t", "")],
                       [(2, "Output", 3, "Right"), (1, "Output", 3, "Left"), (3, "Join", 4, "Input"), (5, "Output", 5, "Input")])
        (tmp_path / "w.xml").write_text(xml)
        made = WorkflowConverter(tmp_path / "w.xml")
        join = next(s for s in made.steps if s["tool"] == "Join.join")
        assert join["inputs"] == {"left": "a_1", "right": "b_2"} and join["args"] == {"left_on": ["k"], "right_on": ["m"]}
        assert next(s for s in made.steps if s["id"] == "s_4")["inputs"] == {"df": "j_3.1"}
        assert any("cycle" in w for w in made.warnings)

    @pytest.mark.parametrize(("text", "sql"), [("[A b] <> 1 OR Contains([c], 'x')", "`A b` != 1 OR contains(`c`, 'x')"), ("IsNull([x])", "(`x` IS NULL)"), ("Null()", "NULL"), ('"it\'s"', "'it\\'s'"), ("[a] in (1, 2)", "`a` IN (1, 2)")])
    def test_expressions(self, text, sql):
        assert translate(text) == sql

    def test_names_and_errors(self, tmp_path, capsys):
        assert plugin_name("Gui.DbFileInput.DbFileInput") == "DbFileInput" and plugin_name("Filter") == "Filter" and plugin_name("") == "" and plugin_name("Gui.VendorSelect.VendorSelect") == "Select"
        for text in ("not xml", "<a/>", "<!DOCTYPE x [<!ENTITY e 'v'>]><Nodes/>"):
            (tmp_path / "w.xml").write_text(text)
            with pytest.raises(ValueError):
                WorkflowConverter(tmp_path / "w.xml")
        with pytest.raises(FileNotFoundError):
            WorkflowConverter(tmp_path / "no.xml")
        (tmp_path / "e.xml").write_text("<Doc><Nodes/></Doc>")
        assert yaml.safe_load(WorkflowConverter(tmp_path / "e.xml").to_yaml())["steps"] == []
        assert cli.main(["convert", str(tmp_path / "e.xml"), "-o", str(tmp_path / "out" / "p.yaml"), "--summary"]) == 0
        assert (tmp_path / "out" / "p.yaml").exists() and cli.main(["convert", str(tmp_path / "no.xml")]) == 1


class TestStreams:
    def test_row_wise_pipeline(self, spark, tmp_path):
        spark.createDataFrame([(1, " a "), (2, None), (5, "B")], "i int, t string").write.parquet(str(tmp_path / "in"))
        stream = adapter.read_stream(spark, str(tmp_path / "in"))
        config = {"steps": [{"id": "f", "tool": "Preparation.filter", "inputs": {"df": "stream"}, "args": {"condition": "i > 1"}}, {"id": "c", "tool": "Preparation.data_cleansing", "inputs": {"df": "f.false"}, "args": {"modify_case": "upper"}}]}
        out = adapter.apply_to_stream(stream, config)
        q = out.writeStream.format("memory").queryName("rowwise").trigger(availableNow=True).start()
        q.awaitTermination()
        assert [tuple(r) for r in spark.sql("select * from rowwise").collect()] == [(1, "A")]
        with pytest.raises(ValueError, match="not for streams"):
            adapter.apply_to_stream(stream, {"steps": [{"id": "s", "tool": "Preparation.sort", "inputs": {"df": "stream"}, "args": {"columns": "i"}}]})
        with pytest.raises(ValueError):
            adapter.apply_to_stream(spark.range(1), config)


def test_lineage_is_sent(monkeypatch):
    sent = []

    class Answer:
        status = 201

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    def post(req, timeout=None):
        sent.append(json.loads(req.data))
        if len(sent) == 2:
            raise OSError("down")
        return Answer()

    monkeypatch.setattr("urllib.request.urlopen", post)
    c = LineageCollector()
    c.set_pipeline("p", "r")
    c.record_step("a", "InOut.input_data", [])
    c.record_step("b", "Preparation.sort", ["a"], {"x": "int"}, 3, 0.1, "FAIL")
    assert c.emit_to_marquez("https://lineage.test") == 1 and sent[1]["eventType"] == "FAIL" and len(c) == 2 and "p" in repr(c) and c.to_dict()["pipeline"] == "p"
