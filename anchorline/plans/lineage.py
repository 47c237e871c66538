"""Lineage of pipeline runs as OpenLineage events."""

from __future__ import annotations

import json
import logging
import urllib.request
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

log = logging.getLogger(__name__)
PRODUCER = "urn:anchorline"
#: Addresses of the public OpenLineage schemas.
SPEC = "https://openlineage.io/spec/2-0-2/OpenLineage.json"
FACETS = {"schema": "https://openlineage.io/spec/facets/1-0-0/SchemaDatasetFacet.json", "dataQualityMetrics": "https://openlineage.io/spec/facets/1-0-0/DataQualityMetricsDatasetFacet.json",
          "jobType": "https://openlineage.io/spec/facets/2-0-2/JobTypeJobFacet.json", "processingEngine": "https://openlineage.io/spec/facets/1-0-0/ProcessingEngineRunFacet.json"}


@dataclass
class Step:
    step_id: str
    tool: str
    inputs: list[str]
    output_schema: dict[str, str] = field(default_factory=dict)
    row_count: int | None = None
    duration_s: float | None = None
    status: str = "COMPLETE"
    recorded_at: str = ""


class LineageCollector:
    """Collects steps; exports them as events, as a dict, or to an OpenLineage endpoint."""

    def __init__(self, namespace: str = "anchorline.default", job_prefix: str = ""):
        self.namespace, self.job_prefix = namespace, job_prefix
        self.pipeline, self.run_id, self.started_at = "unknown", "", ""
        self.steps: list[Step] = []

    def set_pipeline(self, name: str, run_id: str = "") -> None:
        now = datetime.now(UTC)
        self.pipeline, self.run_id, self.started_at = name, run_id or now.strftime("%Y%m%dT%H%M%SZ"), now.isoformat()

    def record_step(self, step_id: str, tool: str, inputs: list[str], output_schema: dict[str, str] | None = None, row_count: int | None = None, duration_s: float | None = None, status: str = "COMPLETE") -> None:
        self.steps.append(Step(step_id, tool, list(inputs), output_schema or {}, row_count, duration_s, status, datetime.now(UTC).isoformat()))

    def _facet(self, kind: str, **body: object) -> dict:
        return {"_producer": PRODUCER, "_schemaURL": FACETS[kind]} | body

    def to_openlineage_events(self) -> list[dict]:
        events = []
        for s in self.steps:
            facets = {}
            if s.output_schema:
                facets["schema"] = self._facet("schema", fields=[{"name": n, "type": str(t)} for n, t in s.output_schema.items()])
            if s.row_count is not None:
                facets["dataQualityMetrics"] = self._facet("dataQualityMetrics", rowCount=s.row_count, columnMetrics={})
            run = {"processingEngine": self._facet("processingEngine", name="spark", version="4", durationSeconds=s.duration_s)} if s.duration_s is not None else {}
            events.append({
                "eventType": "COMPLETE" if s.status == "COMPLETE" else "FAIL", "eventTime": s.recorded_at, "producer": PRODUCER, "schemaURL": SPEC,
                "run": {"runId": f"{self.run_id}.{s.step_id}", "facets": run},
                "job": {"namespace": self.namespace, "name": ".".join(x for x in (self.job_prefix, self.pipeline, s.step_id) if x), "facets": {"jobType": self._facet("jobType", processingType="BATCH", integration="SPARK", jobType=s.tool)}},
                "inputs": [{"namespace": self.namespace, "name": f"{self.pipeline}.{i}"} for i in s.inputs],
                "outputs": [{"namespace": self.namespace, "name": f"{self.pipeline}.{s.step_id}", "facets": facets}],
            })
        return events

    def emit_to_marquez(self, endpoint: str, api_key: str | None = None, timeout: float = 10.0) -> int:
        """POST each event; the number accepted. Failures are logged, never raised."""
        sent = 0
        for event in self.to_openlineage_events():
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
            req = urllib.request.Request(endpoint.rstrip("/") + "/api/v1/lineage", data=json.dumps(event, default=str).encode(), headers=headers, method="POST")
            try:
                with urllib.request.urlopen(req, timeout=timeout) as resp:
                    sent += 200 <= resp.status < 300
            except Exception as e:
                log.error("lineage event was not sent: %s", e)
        return sent

    def to_dict(self) -> dict:
        return {"pipeline": self.pipeline, "namespace": self.namespace, "run_id": self.run_id, "started_at": self.started_at, "steps": [asdict(s) for s in self.steps]}

    def __len__(self) -> int:
        return len(self.steps)

    def __repr__(self) -> str:
        return f"LineageCollector(pipeline={self.pipeline!r}, steps={len(self.steps)})"
