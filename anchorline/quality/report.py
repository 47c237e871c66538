"""Reports of contract runs."""

from __future__ import annotations

import html
import json
from collections import Counter
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame

from anchorline.quality.audit import COLUMNS

_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px 8px;text-align:left}.PASS{background:#dfd}.FAIL,.ERROR{background:#fdd}.WARN{background:#ffd}.SKIPPED{background:#eee}"


def export_report(results: DataFrame, path: str | Path, format: str | None = None, title: str = "Data quality report") -> Path:
    """Write a suite's report (one row per check) as html or json, by extension unless given."""
    p = Path(path)
    fmt = (format or p.suffix.lstrip(".")).lower()
    if fmt not in ("html", "json"):
        raise ValueError(f"Unsupported report format: {fmt!r}")
    if missing := [c for c in COLUMNS if c not in results.columns]:
        raise KeyError(f"Columns not found: {missing}. Available columns: {results.columns}")
    rows = [{c: r[c] for c in COLUMNS} for r in results.collect()]  # one row per check
    counts = Counter(r["Status"] for r in rows)
    made = datetime.now(UTC).isoformat(timespec="seconds")
    p.parent.mkdir(parents=True, exist_ok=True)
    if fmt == "json":
        body = {"title": title, "generated_at": made, "summary": {"total": len(rows)} | dict(counts), "results": rows}
        p.write_text(json.dumps(body, indent=2, default=str, ensure_ascii=False), encoding="utf-8")
        return p
    esc = lambda v: html.escape("" if v is None else str(v))
    head = "".join(f"<th>{esc(c)}</th>" for c in COLUMNS)
    lines = "".join(f"<tr class='{esc(r['Status'])}'>" + "".join(f"<td>{esc(r[c])}</td>" for c in COLUMNS) + "</tr>" for r in rows)
    total = ", ".join(f"{n} {esc(s)}" for s, n in sorted(counts.items())) or "no checks"
    p.write_text(f"<!doctype html><html><head><meta charset='utf-8'><title>{esc(title)}</title><style>{_STYLE}</style></head><body><h1>{esc(title)}</h1><p>{esc(made)}: {total}</p><table><tr>{head}</tr>{lines}</table></body></html>", encoding="utf-8")
    return p
