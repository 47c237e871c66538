"""Workflow files (XML) to pipelines (YAML)."""

from __future__ import annotations

import heapq
import re
import xml.etree.ElementTree as ET
from collections import defaultdict
from dataclasses import dataclass, field
from pathlib import Path

import yaml

#: Plugins and the tools that do their work.
PLUGINS = {
    "DbFileInput": "InOut.input_data", "DbFileOutput": "InOut.output_data", "TextInput": "InOut.text_input", "Browse": "InOut.browse", "BrowseV2": "InOut.browse", "Directory": "InOut.directory", "DirectoryV2": "InOut.directory",
    "Select": "Preparation.select", "Filter": "Preparation.filter", "Sort": "Preparation.sort", "Formula": "Preparation.formula", "MultiFieldFormula": "Preparation.multi_field_formula", "MultiRowFormula": "Preparation.multi_row_formula",
    "Unique": "Preparation.unique", "Sample": "Preparation.sample", "RecordID": "Preparation.record_id", "DataCleansing": "Preparation.data_cleansing", "Imputation": "Preparation.imputation", "Tile": "Preparation.tile",
    "GenerateRows": "Preparation.generate_rows", "AutoField": "Preparation.auto_field", "DateFilter": "Preparation.date_filter", "Rank": "Preparation.rank", "OversampleField": "Preparation.oversample_field",
    "Join": "Join.join", "Union": "Join.union", "AppendFields": "Join.append_fields", "FindReplace": "Join.find_replace", "FuzzyMatch": "Join.fuzzy_match", "MakeGroup": "Join.make_group",
    "Summarize": "Transform.summarize", "Transpose": "Transform.transpose", "CrossTab": "Transform.cross_tab", "RunningTotal": "Transform.running_total", "CountRecords": "Transform.count_records",
    "DateTime": "Parse.date_time", "RegExTool": "Parse.regex_match", "RegEx": "Parse.regex_match", "TextToColumns": "Parse.text_to_columns", "XmlParse": "Parse.xml_parse", "XMLParse": "Parse.xml_parse",
}
#: Field types of workflow files and ours.
FIELD_TYPES = {"String": "string", "V_String": "string", "WString": "string", "V_WString": "string", "Time": "string", "Byte": "tinyint", "Int16": "smallint", "Int32": "int32", "Int64": "bigint", "Float": "float32", "Double": "double", "FixedDecimal": "double", "Bool": "boolean", "Date": "date", "DateTime": "timestamp"}
#: Summarize actions and aggregates.
ACTIONS = {"Sum": "sum", "Avg": "mean", "Min": "min", "Max": "max", "Count": "count", "CountDistinct": "count distinct", "CountNull": "count null", "First": "first", "Last": "last", "StdDev": "std", "Variance": "var", "Median": "median", "Mode": "mode", "Concat": "concatenate", "Longest": "longest", "Shortest": "shortest"}
#: Names of output ports and the place of the output they lead to.
ANCHORS = {"T": 0, "True": 0, "L": 0, "Left": 0, "U": 0, "Unique": 0, "1": 0, "F": 1, "False": 1, "J": 1, "Join": 1, "D": 1, "Duplicates": 1, "2": 1, "R": 2, "Right": 2}
MANY = {"Preparation.filter", "Preparation.unique", "Preparation.date_filter", "Preparation.create_samples", "Join.join"}
SOURCES = {"InOut.input_data", "InOut.text_input", "InOut.directory", "Preparation.generate_rows"}


def plugin_name(text: str) -> str:
    """The last part of a plugin's dotted name, without a macro's extension and without a vendor's word before a known name."""
    name = re.sub(r"\.(yxmc|dll)$", "", text or "").rsplit(".", 1)[-1]
    bare = re.sub(r"^[A-Z][a-z]+(?=[A-Z])", "", name)
    return bare if name not in PLUGINS and bare in PLUGINS else name


# Functions of the workflow language and Spark SQL for them.
_CALLS = {
    "contains": "contains({0}, {1})", "startswith": "startswith({0}, {1})", "endswith": "endswith({0}, {1})", "isnull": "({0} IS NULL)", "isnotnull": "({0} IS NOT NULL)", "isempty": "(coalesce({0}, '') = '')",
    "null": "NULL", "tostring": "cast({0} as string)", "tonumber": "try_cast({0} as double)", "uppercase": "upper({0})", "lowercase": "lower({0})", "length": "length({0})", "trim": "trim({0})", "left": "left({0}, {1})", "right": "right({0}, {1})",
    "replace": "replace({0}, {1}, {2})", "datetimenow": "current_timestamp()", "datetimetoday": "current_date()", "iif": "if({0}, {1}, {2})",
}
_TOKEN = re.compile(r"""\s*(?:(?P<field>\[[^\]]+\])|(?P<text>"[^"]*"|'[^']*')|(?P<num>\d+(?:\.\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<op><>|!=|==|<=|>=|&&|\|\||[-+*/%<>=!(),]))""")


def translate(text: str) -> str:
    """A workflow expression as Spark SQL: fields in brackets, IF ... THEN ... ELSEIF ... ELSE ... ENDIF, functions, logic."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            if text[at:].strip() == "":
                break
            raise ValueError(f"cannot read expression at: {text[at : at + 20]!r}")
        tokens.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    out: list[str] = []

    def parse(i: int, stop: set[str]) -> int:
        while i < len(tokens):
            kind, t = tokens[i]
            low = t.lower()
            if kind in ("word", "op") and low in stop:
                return i
            if kind == "field":
                out.append(f"`{t[1:-1]}`")
            elif kind == "text":
                out.append("'" + t[1:-1].replace("\\", "\\\\").replace("'", "\\'") + "'")
            elif kind == "word" and low == "if":
                out.append("CASE WHEN")
                i = parse(i + 1, {"then"})
                out.append("THEN")
                i = parse(i + 1, {"elseif", "else", "endif"})
                while i < len(tokens) and tokens[i][1].lower() == "elseif":
                    out.append("WHEN")
                    i = parse(i + 1, {"then"})
                    out.append("THEN")
                    i = parse(i + 1, {"elseif", "else", "endif"})
                if i < len(tokens) and tokens[i][1].lower() == "else":
                    out.append("ELSE")
                    i = parse(i + 1, {"endif"})
                out.append("END")
            elif kind == "word" and i + 1 < len(tokens) and tokens[i + 1][1] == "(" and low not in ("and", "or", "not", "in"):
                args, i = _args(i + 2)
                out.append(_CALLS[low].format(*args) if low in _CALLS and _CALLS[low].count("{") <= len(args) else f"{low}({', '.join(args)})")
            elif kind == "word" and low in ("and", "or", "not", "in", "true", "false", "null"):
                out.append(low.upper())
            else:
                out.append({"<>": "!=", "==": "=", "&&": "AND", "||": "OR", "!": "NOT"}.get(t, t))
            i += 1
        return i

    def _args(i: int) -> tuple[list[str], int]:
        nonlocal out
        saved, args = out, []
        while True:
            out = []
            i = parse_arg(i)
            if out:
                args.append(" ".join(out))
            if i >= len(tokens) or tokens[i][1] == ")":
                break
            i += 1
        out = saved
        return args, i

    def parse_arg(i: int) -> int:
        depth = 0
        while i < len(tokens):
            t = tokens[i][1]
            if depth == 0 and tokens[i][0] == "op" and t in (",", ")"):
                return i
            if tokens[i][0] == "op" and t == "(":
                depth += 1
                out.append("(")
                i += 1
                continue
            if tokens[i][0] == "op" and t == ")":
                depth -= 1
                out.append(")")
                i += 1
                continue
            if depth and tokens[i][0] == "op" and t == ",":
                out.append(",")
                i += 1
                continue
            j = parse(i, {",", ")", "("})
            i = j if j > i else i + 1
        return i

    parse(0, set())
    sql = " ".join(out)
    return re.sub(r"\(\s+", "(", re.sub(r"\s+([),])", r"\1", sql))


@dataclass
class Node:
    id: int
    plugin: str
    name: str
    x: float
    y: float
    config: ET.Element | None


@dataclass
class Made:
    """Steps of one node: usually one, a formula node with several formulas more."""

    calls: list[tuple[str, dict]]
    notes: list[str] = field(default_factory=list)


def _text(el: ET.Element | None, path: str) -> str:
    found = el.find(path) if el is not None else None
    if found is None:
        return ""
    return (found.text or found.attrib.get("field") or found.attrib.get("value") or "").strip()


def _fields(el: ET.Element | None, path: str) -> list[str]:
    return [f.attrib["field"] for f in (el.findall(path) if el is not None else []) if f.attrib.get("field")]


def _one(values: list) -> object:
    return values[0] if len(values) == 1 else values


def map_node(node: Node) -> Made | None:
    """The calls of a node, or None if no tool does its work."""
    name = PLUGINS.get(node.plugin)
    if name is None:
        return None
    c, notes = node.config, []

    def want(value: object, todo: object, what: str) -> object:
        if value:
            return value
        notes.append(f"{what} could not be read; set it by hand")
        return todo

    args: dict[str, object] = {}
    match name.split(".")[1]:
        case "input_data" | "output_data" | "directory":
            args = {"path": want(_text(c, "File") or _text(c, "Alias") or _text(c, "Directory"), "TODO_path.csv", "path")}
        case "text_input":
            names = _fields(c, "Fields/Field") or [f.attrib["name"] for f in (c.findall("Fields/Field") if c is not None else []) if f.attrib.get("name")]
            rows = [[cell.text for cell in r.findall("c")] for r in (c.findall("Data/r") if c is not None else [])]
            args = {"data": rows, "columns": names} if names and rows else {"data": want(None, {"TODO_column": ["TODO_value"]}, "inline data")}
        case "filter":
            raw = _text(c, "Expression")
            try:
                condition = translate(raw) if raw else ""
            except ValueError as e:
                condition = ""
                notes.append(str(e))
            args = {"condition": want(condition, "TODO_condition", "condition")}
        case "sort":
            fs = c.findall("SortInfo/Field") if c is not None else []
            names = [f.attrib["field"] for f in fs if f.attrib.get("field")]
            up = [f.attrib.get("order", "Ascending").lower() != "descending" for f in fs if f.attrib.get("field")]
            args = {"columns": _one(want(names, ["TODO_column"], "sort columns")), "ascending": _one(up or [True])}
        case "select":
            keep, renames, types = [], {}, {}
            for f in c.findall("SelectFields/SelectField") if c is not None else []:
                old, new = f.attrib.get("field", ""), f.attrib.get("rename", "")
                if not old or old == "*Unknown" or f.attrib.get("selected", "True").lower() != "true":
                    continue
                keep.append(old)
                if new and new != old:
                    renames[old] = new
                if f.attrib.get("type") in FIELD_TYPES:
                    types[new or old] = FIELD_TYPES[f.attrib["type"]]
            args = {k: v for k, v in (("columns", keep), ("renames", renames), ("dtypes", types)) if v}
            if not args:
                notes.append("no fields could be read; all are kept")
        case "formula":
            calls = []
            for f in c.findall("FormulaFields/FormulaField") if c is not None else []:
                try:
                    calls.append((name, {"column": f.attrib.get("field", ""), "expression": translate(f.attrib.get("expression", ""))}))
                except ValueError as e:
                    notes.append(str(e))
            if not calls:
                notes.append("no formula could be read; set it by hand")
                calls = [(name, {"column": "TODO_column", "expression": "TODO_expression"})]
            return Made(calls, notes)
        case "multi_field_formula":
            args = {"columns": want(_fields(c, "Fields/Field") or _fields(c, "FieldList/Field"), ["TODO_column"], "columns"), "expression": want(translate(_text(c, "Expression").replace("[_CurrentField_]", "_CurrentField_")) if _text(c, "Expression") else "", "_CurrentField_", "expression")}
        case "summarize":
            groups, aggs = [], defaultdict(list)
            for f in c.findall("SummarizeFields/SummarizeField") if c is not None else []:
                action, col = f.attrib.get("action", ""), f.attrib.get("field", "")
                if not col:
                    continue
                if action == "GroupBy":
                    groups.append(col)
                    continue
                if action not in ACTIONS:
                    notes.append(f"action {action!r} is kept as it is named")
                aggs[col].append(ACTIONS.get(action, action.lower()))
            args = ({"group_by": _one(groups)} if groups else {}) | {"aggregations": {k: _one(v) for k, v in aggs.items()} or want(None, {"TODO_column": "sum"}, "aggregations")}
        case "join":
            left = [f.attrib["field"] for j in (c.findall("JoinInfo") if c is not None else []) if j.attrib.get("connection", "Left") == "Left" for f in j.findall("Field") if f.attrib.get("field")]
            right = [f.attrib["field"] for j in (c.findall("JoinInfo") if c is not None else []) if j.attrib.get("connection") == "Right" for f in j.findall("Field") if f.attrib.get("field")]
            args = {"left_on": left, "right_on": right} if right and right != left else {"on": _one(want(left, ["TODO_column"], "join keys"))}
        case "union":
            mode = (c.attrib.get("mode", "") if c is not None else "") or _text(c, "Mode")
            args = {"by": "position" if "pos" in mode.lower() else "name"}
        case "unique":
            args = {"columns": _one(want(_fields(c, "UniqueFields/Field"), ["TODO_column"], "columns"))}
        case "sample":
            n, pct = _text(c, "N"), _text(c, "Percent")
            args = {"n": int(n)} if n.isdigit() else {"pct": float(pct) / 100} if re.fullmatch(r"\d+(\.\d+)?", pct) else {"n": want(None, 1000, "size")}
        case "record_id":
            start = _text(c, "StartValue")
            args = ({"column_name": _text(c, "FieldName")} if _text(c, "FieldName") else {}) | ({"start": int(start)} if start.lstrip("-").isdigit() else {})
        case "data_cleansing":
            case_ = _text(c, "Case").lower()
            args = ({"remove_null_rows": True} if _text(c, "NullRows").lower() == "true" else {}) | ({"strip_whitespace": _text(c, "Whitespace").lower() == "true"} if _text(c, "Whitespace") else {}) | ({"modify_case": case_} if case_ in ("lower", "upper", "title") else {})
        case "running_total":
            groups = _fields(c, "GroupByFields/Field")
            args = {"column": want(_text(c, "RunningField"), "TODO_column", "column")} | ({"group_by": _one(groups)} if groups else {})
        case "cross_tab":
            groups = _fields(c, "GroupFields/Field") or [g for g in [_text(c, "GroupFields/Field")] if g]
            args = {"group_by": _one(want(groups, ["TODO_group_by"], "group")), "pivot_col": want(_text(c, "HeaderField"), "TODO_pivot_col", "header"), "value_col": want(_text(c, "DataField"), "TODO_value_col", "data")}
            if method := _text(c, "Method"):
                args["agg"] = ACTIONS.get(method, method.lower())
        case "transpose":
            args = {"key_columns": want(_fields(c, "KeyFields/Field"), ["TODO_key_column"], "keys")} | ({"data_columns": d} if (d := _fields(c, "DataFields/Field")) else {})
        case "imputation":
            method = _text(c, "Method").lower()
            args = {"columns": _one(want(_fields(c, "Fields/Field"), ["TODO_column"], "columns")), "method": {"average": "mean"}.get(method, method) or "mean"}
        case "tile":
            n, method = _text(c, "NumTiles"), _text(c, "Method").lower()
            args = {"column": want(_text(c, "TileField"), "TODO_column", "column"), "n_tiles": int(n) if n.isdigit() else 4} | ({"method": "equal_range"} if "range" in method else {})
        case "generate_rows":
            n = _text(c, "NumRows")
            args = {"count": int(n) if n.isdigit() else want(None, 100, "count")}
        case "text_to_columns":
            args = {"column": want(_text(c, "Field"), "TODO_column", "column"), "delimiter": _text(c, "Delimeters") or _text(c, "Delimiters") or ","}
            if (n := _text(c, "NumFields")).isdigit():
                args["num_columns"] = int(n)
        case "fuzzy_match":
            args = {"left_on": want(None, "TODO_left_col", "left column"), "right_on": want(None, "TODO_right_col", "right column")}
        case "find_replace":
            args = {"find_col": want(_text(c, "FieldFind"), "TODO_find_col", "find column"), "replace_col": want(_text(c, "FieldSearch"), "TODO_replace_col", "replace column")}
        case "make_group":
            args = {"key1": want(_text(c, "Key1"), "TODO_key1", "first key"), "key2": want(_text(c, "Key2"), "TODO_key2", "second key")}
        case "multi_row_formula":
            args = {"column": want(_text(c, "UpdateField") or _text(c, "Field"), "TODO_column", "column")}
            notes.append("a multi-row formula is a function; set it in code")
        case "date_filter" | "rank" | "oversample_field" | "date_time" | "regex_match" | "xml_parse":
            args = {"column": want(_text(c, "Field") or _text(c, "FieldName"), "TODO_column", "column")}
            if name.endswith("regex_match"):
                args["pattern"] = want(_text(c, "RegExExpression") or (c.find("RegExExpression").attrib.get("value", "") if c is not None and c.find("RegExExpression") is not None else ""), "TODO_pattern", "pattern")
            if name.endswith("xml_parse"):
                args["xpath"] = want(_text(c, "XPath"), "TODO_xpath", "path")
            if name.endswith("oversample_field"):
                args["value"] = want(_text(c, "Value"), "TODO_value", "value")
    return Made([(name, args)], notes)


class WorkflowConverter:
    """Reads a workflow file; `to_yaml`, `save`, and what could not be converted in `warnings`."""

    def __init__(self, source: str | Path):
        path = Path(source)
        if not path.exists():
            raise FileNotFoundError(source)
        text = path.read_text(encoding="utf-8-sig")
        if re.search(r"<!(DOCTYPE|ENTITY)", text, re.I):
            raise ValueError("a workflow may not declare document types or entities")
        try:
            root = ET.fromstring(text.encode())
        except ET.ParseError as e:
            raise ValueError(f"not a workflow file: {e}") from e
        if root.find(".//Nodes") is None and root.find(".//Node") is None:
            raise ValueError("not a workflow file: it holds no nodes")
        self.name, self.warnings = path.stem, []
        self.nodes: dict[int, Node] = {}
        for el in root.findall(".//Node"):
            if not el.attrib.get("ToolID", "").isdigit():
                continue
            gui, pos = el.find("GuiSettings"), el.find("GuiSettings/Position")
            plugin = gui.attrib.get("Plugin", "") if gui is not None else ""
            if not plugin and (engine := el.find("EngineSettings")) is not None:
                plugin = engine.attrib.get("Macro", "")
            at = pos.attrib if pos is not None else {}
            label = _text(el, "Properties/Annotation/Name") or _text(el, "Properties/Annotation/DefaultAnnotationText")
            i = int(el.attrib["ToolID"])
            self.nodes[i] = Node(i, plugin_name(plugin), label, float(at.get("x", 0)), float(at.get("y", 0)), el.find("Properties/Configuration"))
        self.edges: list[tuple[int, str, int, str]] = []
        for el in root.findall(".//Connection"):
            a, b = el.find("Origin"), el.find("Destination")
            if a is None or b is None or not a.attrib.get("ToolID", "").isdigit() or not b.attrib.get("ToolID", "").isdigit():
                continue
            self.edges.append((int(a.attrib["ToolID"]), a.attrib.get("Connection", "Output"), int(b.attrib["ToolID"]), b.attrib.get("Connection", "Input")))
        self.mapped = 0
        self.steps = self._steps()

    @property
    def node_count(self) -> int:
        return len(self.nodes)

    @property
    def coverage(self) -> float:
        return self.mapped / len(self.nodes) if self.nodes else 1.0

    def order(self) -> list[int]:
        """Nodes so that inputs come first; of those that are ready the leftmost, then topmost. Nodes on a cycle come last, with a warning."""
        need = {i: 0 for i in self.nodes}
        after = defaultdict(list)
        for a, _, b, _ in self.edges:
            if a in self.nodes and b in self.nodes:
                need[b] += 1
                after[a].append(b)
        key = lambda i: (self.nodes[i].x, self.nodes[i].y, i)
        ready = [key(i) for i, n in need.items() if n == 0]
        heapq.heapify(ready)
        out = []
        while ready:
            i = heapq.heappop(ready)[2]
            out.append(i)
            for b in after[i]:
                need[b] -= 1
                if need[b] == 0:
                    heapq.heappush(ready, key(b))
        if rest := sorted(set(self.nodes) - set(out), key=key):
            self.warnings.append(f"nodes on a cycle: {rest}")
        return out + rest

    def _id(self, n: Node) -> str:
        label = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", n.name or n.plugin or "step")
        return re.sub(r"\W+", "_", label).strip("_").lower() + f"_{n.id}"

    def _steps(self) -> list[dict]:
        out, last, tool_of = [], {}, {}
        for i in self.order():
            n = self.nodes[i]
            made = map_node(n)
            ident = self._id(n)
            if made is None:
                self.warnings.append(f"tool {i}: no tool does the work of {n.plugin or 'an unnamed plugin'!r}")
                made = Made([(f"TODO_{n.plugin or 'unknown'}", {})], ["this plugin is not supported; replace the step"])
            else:
                self.mapped += 1
            refs: dict[str, list[tuple[str, str]]] = defaultdict(list)
            for a, port, b, to in self.edges:
                if b == i and a in last:
                    anchor = ANCHORS.get(port)
                    if tool_of[a] in MANY and anchor is None:
                        anchor = 1 if tool_of[a] == "Join.join" else 0
                    refs[to].append((to, last[a] if tool_of[a] not in MANY else f"{last[a]}.{anchor}"))
            flat = [r for to in refs for r in refs[to]]
            first = made.calls[0][0]
            if first in ("Join.union",):
                inputs: dict[str, object] = {"dfs": [r for _, r in flat]} if flat else {}
            elif first in ("Join.join", "Join.append_fields", "Join.fuzzy_match"):
                side = {"Left": "left", "Targets": "left", "Right": "right", "Source": "right"}
                inputs = {}
                for to, r in flat:
                    k = side.get(to)
                    k = k if k and k not in inputs else "left" if "left" not in inputs else "right"
                    inputs[k] = r
            elif first == "Join.find_replace":
                names = {"Targets": "df", "Source": "find_df", "F": "df", "R": "find_df"}
                inputs = {}
                for to, r in flat:
                    k = names.get(to)
                    inputs[k if k and k not in inputs else "df" if "df" not in inputs else "find_df"] = r
            else:
                inputs = {"df": flat[0][1]} if flat and first not in SOURCES else {}
                if len(flat) > 1:
                    made.notes.append(f"only the first of {len(flat)} inputs is used")
            for k, (tool, args) in enumerate(made.calls):
                sid = ident if k == 0 else f"{ident}_{k + 1}"
                step: dict = {"id": sid, "tool": tool}
                if k:
                    inputs = {"df": out[-1]["id"]}
                if inputs:
                    step["inputs"] = inputs
                if args:
                    step["args"] = args
                if made.notes and k == 0:
                    step["_notes"] = made.notes
                out.append(step)
                last[i], tool_of[i] = sid, tool
        return out

    def to_dict(self) -> dict:
        return {"name": self.name, "steps": [{k: v for k, v in s.items() if k != "_notes"} for s in self.steps]}

    def to_yaml(self) -> str:
        lines = [f"# Converted from {self.name}: {self.mapped} of {len(self.nodes)} tools", *[f"# WARNING: {w}" for w in self.warnings], yaml.safe_dump({"name": self.name}, allow_unicode=True).strip()]
        if not self.steps:
            return "\n".join([*lines, "steps: []", ""])
        lines.append("steps:")
        for s in self.steps:
            lines += [f"  # NOTE: {n}" for n in s.get("_notes", [])]
            body = yaml.safe_dump([{k: v for k, v in s.items() if k != "_notes"}], sort_keys=False, allow_unicode=True, width=1000)
            lines += ["  " + x for x in body.rstrip().split("\n")]
        return "\n".join(lines) + "\n"

    def save(self, path: str | Path) -> Path:
        out = Path(path)
        out.parent.mkdir(parents=True, exist_ok=True)
        out.write_text(self.to_yaml(), encoding="utf-8")
        return out

    def summary(self) -> str:
        return f"{self.name}: {len(self.nodes)} tools, {self.mapped} converted ({self.coverage:.0%}), {len(self.warnings)} warnings"
