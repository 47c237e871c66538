"""Audit trails of contract runs, and where they are forwarded to."""

from __future__ import annotations

import json
import logging
import time
import urllib.request
import uuid
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.session import get_spark

log = logging.getLogger(__name__)
COLUMNS = ("Suite", "Contract", "Description", "Status", "Violation_Count", "Violations")
SCHEMA = "run_id string, timestamp string, user string, Suite string, Contract string, Description string, Status string, Violation_Count bigint, Violations string"


class Forwarder:
    """Sends audit events elsewhere."""

    def forward(self, events: list[dict]) -> None:
        raise NotImplementedError


class _Http(Forwarder):
    def __init__(self, url: str, timeout: float = 10.0, allow_http: bool = False):
        if not url.lower().startswith("https://") and not allow_http:
            raise ValueError("only https addresses are allowed")
        self.url, self.timeout = url, timeout

    def _post(self, body: bytes, headers: dict[str, str]) -> None:
        req = urllib.request.Request(self.url, data=body, headers={"Content-Type": "application/json"} | headers, method="POST")
        with urllib.request.urlopen(req, timeout=self.timeout) as resp:
            if not 200 <= resp.status < 300:
                raise OSError(f"answer {resp.status}")


class SplunkForwarder(_Http):
    """HTTP event collector: one JSON event per line."""

    def __init__(self, url: str, token: str, index: str | None = None, source: str = "anchorline", timeout: float = 10.0, allow_http: bool = False):
        super().__init__(url, timeout, allow_http)
        self.token, self.index, self.source = token, index, source

    def forward(self, events: list[dict]) -> None:
        head = {"source": self.source, "sourcetype": "_json", "time": time.time()} | ({"index": self.index} if self.index else {})
        self._post("\n".join(json.dumps(head | {"event": e}, default=str) for e in events).encode(), {"Authorization": f"Splunk {self.token}"})


class WebhookForwarder(_Http):
    """One POST with all events."""

    def __init__(self, url: str, headers: dict[str, str] | None = None, timeout: float = 10.0, allow_http: bool = False):
        super().__init__(url, timeout, allow_http)
        self.headers = headers or {}

    def forward(self, events: list[dict]) -> None:
        self._post(json.dumps({"events": events}, default=str).encode(), self.headers)


class StorageForwarder(Forwarder):
    """A JSON-lines file per run under any address that Spark can write (object stores included)."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def forward(self, events: list[dict]) -> None:
        spark = get_spark()
        lines = [(json.dumps(e, default=str),) for e in events]
        day = datetime.now(UTC).strftime("%Y/%m/%d")
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(f"{self.path}/{day}")


class AuditTrail:
    """Appends runs to a JSON-lines file and forwards them; a forwarder that fails is logged, never raised."""

    def __init__(self, path: str | Path, forwarders: list[Forwarder] | None = None, user: str | None = None):
        self.path, self.forwarders, self.user = Path(path), list(forwarders or []), user

    def log(self, results: DataFrame | list, suite: str | None = None, run_id: str | None = None) -> str:
        """Store a suite's results (a report frame, or its rows); the run's id."""
        run = run_id or uuid.uuid4().hex
        rows = [tuple(r[c] for c in COLUMNS) for r in results.collect()] if isinstance(results, DataFrame) else results  # one row per check
        now = datetime.now(UTC).isoformat()
        events = [{"run_id": run, "timestamp": now, "user": self.user} | dict(zip(COLUMNS, r, strict=True)) for r in rows]
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a", encoding="utf-8") as f:
            f.writelines(json.dumps(e, default=str, ensure_ascii=False) + "\n" for e in events)
        for fw in self.forwarders:
            try:
                fw.forward(events)
            except Exception as e:
                log.error("%s failed: %s", type(fw).__name__, e)
        return run

    def load(self, days: int | None = None, run_id: str | None = None) -> DataFrame:
        """The trail as a frame, of the last `days` or one run."""
        spark = get_spark()
        if not self.path.exists():
            return spark.createDataFrame([], SCHEMA)
        df = spark.read.schema(SCHEMA).json(str(self.path))
        if days is not None:
            df = df.filter(F.col("timestamp") >= (datetime.now(UTC) - timedelta(days=days)).isoformat())
        return df.filter(F.col("run_id") == run_id) if run_id is not None else df

    def clear(self) -> None:
        self.path.unlink(missing_ok=True)
