"""Pipelines: steps of tools declared in YAML, checked as a whole and then planned lazily."""

from __future__ import annotations

import inspect
import json
import logging
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from anchorline.plans.guard import PipelineGuard
from anchorline.plans.lineage import LineageCollector
from anchorline.plans.registry import SINKS, parameters, takes_many, tool
from anchorline.plans.secrets import resolve_secrets
from anchorline.quality.contracts import expect_schema

log = logging.getLogger(__name__)


@dataclass
class StepSpec:
    """`inputs` name parameters and what they refer to: a step, or one of its outputs (`step.0`, `step.true`)."""

    id: str
    tool: str
    inputs: dict[str, str | list[str]] = field(default_factory=dict)
    args: dict[str, object] = field(default_factory=dict)
    output_schema: dict | None = None

    def refs(self) -> list[str]:
        return [r for v in self.inputs.values() for r in (v if isinstance(v, list) else [v]) if isinstance(r, str)]

    def sources(self) -> list[str]:
        return [r.split(".")[0] for r in self.refs()]


@dataclass
class PipelineSpec:
    name: str
    steps: list[StepSpec]

    @staticmethod
    def of(config: dict) -> PipelineSpec:
        if not isinstance(config, dict) or not isinstance(config.get("steps"), list):
            raise ValueError("a pipeline needs a list of steps")
        steps = []
        for s in config["steps"]:
            if not isinstance(s, dict) or not s.get("id") or not s.get("tool"):
                raise ValueError(f"a step needs id and tool: {s!r}")
            steps.append(StepSpec(str(s["id"]), str(s["tool"]), dict(s.get("inputs") or {}), dict(s.get("args") or {}), s.get("output_schema")))
        return PipelineSpec(str(config.get("name", "pipeline")), steps)

    def problems(self) -> list[str]:
        """What is wrong: unknown tools, references and arguments, missing arguments, repeated ids, references to later steps."""
        found, seen = [], set()
        every = {s.id for s in self.steps}
        for s in self.steps:
            if s.id in seen:
                found.append(f"{s.id}: id is used twice")
            try:
                known = parameters(s.tool)
            except ValueError as e:
                found.append(f"{s.id}: {e}")
                seen.add(s.id)
                continue
            for r in s.sources():
                if r not in seen:
                    found.append(f"{s.id}: {r!r} not found in pipeline state" + (" (it comes later, or refers to itself)" if r in every else ""))
            many = takes_many(s.tool)
            given = set(s.inputs) | set(s.args)
            if not many:
                found += [f"{s.id}: unknown argument {a!r}" for a in given if a not in known and not any(p.kind is p.VAR_KEYWORD for p in known.values())]
                found += [f"{s.id}: missing argument {n!r}" for n, p in known.items() if p.default is inspect.Parameter.empty and p.kind is p.POSITIONAL_OR_KEYWORD and n not in given]
            seen.add(s.id)
        return found

    def shared(self) -> set[str]:
        """Steps whose output more than one later step reads."""
        used = Counter(r for s in self.steps for r in set(s.sources()))
        return {k for k, n in used.items() if n > 1}


class Pipeline:
    """Runs the steps of a YAML file (or dict) in order.

    Tools only plan; jobs run where sinks, asserts and contracts need them. With `cache_shared`, outputs that several steps read are kept
    (memory and disk) until the run ends. Row counts are observed while the data passes, without jobs of their own; they are known for
    steps that a job has read through. With `eager_metrics` each step is counted at once.
    """

    def __init__(self, config: str | Path | dict, *, on_step_start: Callable | None = None, on_step_complete: Callable | None = None, on_step_error: Callable | None = None, on_pipeline_complete: Callable | None = None,
                 guard: PipelineGuard | None = None, lineage_collector: LineageCollector | None = None, cache_shared: bool = False, eager_metrics: bool = False):
        if isinstance(config, dict):
            raw = config
        else:
            if not Path(config).exists():
                raise FileNotFoundError(config)
            raw = yaml.safe_load(Path(config).read_text())
        self.spec = PipelineSpec.of(resolve_secrets(raw))
        self.name = self.spec.name
        self.hooks = {"start": on_step_start, "complete": on_step_complete, "error": on_step_error, "end": on_pipeline_complete}
        self.guard, self.lineage = guard, lineage_collector
        self.cache_shared, self.eager = cache_shared, eager_metrics
        self.state: dict[str, object] = {}
        self.metrics: list[dict] = []

    def validate(self) -> list[str]:
        return self.spec.problems()

    def _resolve(self, ref: object) -> object:
        if not isinstance(ref, str):
            return ref
        step, _, anchor = ref.partition(".")
        if step not in self.state:
            raise ValueError(f"{step!r} not found in pipeline state")
        value = self.state[step]
        if not anchor:
            return value
        if not isinstance(value, tuple):
            raise ValueError(f"{step!r} has one output, {ref!r} asks for another")
        if anchor.lstrip("-").isdigit():
            if not 0 <= int(anchor) < len(value):
                raise ValueError(f"{step!r} has {len(value)} outputs, {ref!r} asks for another")
            return value[int(anchor)]
        if anchor not in getattr(value, "_fields", ()):
            raise ValueError(f"{step!r} has no output {anchor!r}")
        return getattr(value, anchor)

    def _call(self, s: StepSpec) -> object:
        fn = tool(s.tool)
        named, listed = {}, []
        for k, v in s.inputs.items():
            if isinstance(v, list):
                listed += [self._resolve(r) for r in v]
            elif takes_many(s.tool) and k not in parameters(s.tool):
                listed.append(self._resolve(v))
            else:
                named[k] = self._resolve(v)
        return fn(*listed, **named, **s.args)

    def _contract(self, s: StepSpec, out: object) -> None:
        if not s.output_schema:
            return
        schema = dict(s.output_schema)
        i = schema.pop("_tuple_index", 0)
        df = out[i] if isinstance(out, tuple) else out
        expect_schema(df, schema, strict=True)

    def run(self) -> list[dict]:
        """Run all steps; metrics per step. The first error is reported to the hook and raised."""
        if self.guard:
            self.guard.check(self.name, "execute")
        if self.lineage is not None:
            self.lineage.set_pipeline(self.name)
        self.state, self.metrics = {}, []
        shared = self.spec.shared() if self.cache_shared else set()
        kept: list[DataFrame] = []
        watched: dict[str, Observation] = {}
        try:
            for s in self.spec.steps:
                self._hook("start", s.id, s.tool)
                began = time.perf_counter()
                m = {"step_id": s.id, "tool": s.tool, "status": "success", "duration_s": 0.0, "output_type": None, "output_rows": None, "output_cols": None}
                try:
                    out = self._call(s)
                    if isinstance(out, DataFrame) and not out.isStreaming:
                        if s.tool not in SINKS:
                            watched[s.id] = Observation(f"{self.name}.{s.id}.{id(self)}")
                            out = out.observe(watched[s.id], F.count(F.lit(1)).alias("rows"))
                        if s.id in shared:
                            kept.append(out := out.persist(StorageLevel.MEMORY_AND_DISK))
                    self.state[s.id] = out
                    self._contract(s, out)
                    df = out[0] if isinstance(out, tuple) and out else out
                    m["output_type"] = type(out).__name__
                    if isinstance(df, DataFrame):
                        m["output_cols"] = len(df.columns)
                        if self.eager:
                            m["output_rows"] = df.count()
                except Exception as e:
                    m |= {"status": "error", "error": f"{type(e).__name__}: {e}", "duration_s": round(time.perf_counter() - began, 6)}
                    self.metrics.append(m)
                    self._record(s, None, m, "FAIL")
                    self._hook("error", s.id, e)
                    raise
                m["duration_s"] = round(time.perf_counter() - began, 6)
                self.metrics.append(m)
                log.info(json.dumps({"event": "step", "pipeline": self.name} | m, default=str))
                self._record(s, df, m, "COMPLETE")
                self._hook("complete", s.id, m)
            for m in self.metrics:
                if m["output_rows"] is None and (o := watched.get(m["step_id"])) is not None:
                    m["output_rows"] = _seen(o)
            self._hook("end", self.name, self.metrics)
            return self.metrics
        finally:
            for df in kept:
                df.unpersist()

    def _record(self, s: StepSpec, df: object, m: dict, status: str) -> None:
        if self.lineage is not None:
            schema = dict(df.dtypes) if isinstance(df, DataFrame) else {}
            self.lineage.record_step(s.id, s.tool, list(dict.fromkeys(s.sources())), schema, m["output_rows"], m["duration_s"], status)

    def _hook(self, name: str, *args: object) -> None:
        if (fn := self.hooks[name]) is not None:
            fn(*args)


def _seen(o: Observation) -> int | None:
    """The observed row count if a job has passed by; never waits."""
    jo = getattr(o, "_jo", None)
    try:
        if jo is None or not jo.future().isCompleted():
            return None
        return o.get["rows"]
    except Exception:
        return None
