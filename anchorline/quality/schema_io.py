"""Schemas in files."""

from __future__ import annotations

import json
from pathlib import Path

import yaml


def load_schema(path: str | Path) -> dict:
    """A contract from a .yaml, .yml or .json file; a bare map of columns is wrapped."""
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(path)
    if p.suffix.lower() in (".yaml", ".yml"):
        data = yaml.safe_load(p.read_text(encoding="utf-8"))
    elif p.suffix.lower() == ".json":
        data = json.loads(p.read_text(encoding="utf-8"))
    else:
        raise ValueError(f"Unsupported schema file: {p.suffix!r}")
    if not isinstance(data, dict):
        raise ValueError("a schema must be a map")
    return data if "columns" in data else {"columns": data}


def save_schema(schema: dict, path: str | Path) -> Path:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    if p.suffix.lower() in (".yaml", ".yml"):
        p.write_text(schema_to_yaml(schema), encoding="utf-8")
    elif p.suffix.lower() == ".json":
        p.write_text(json.dumps(schema, indent=2, default=str, ensure_ascii=False), encoding="utf-8")
    else:
        raise ValueError(f"Unsupported schema file: {p.suffix!r}")
    return p


def schema_to_yaml(schema: dict) -> str:
    return yaml.safe_dump(schema if "columns" in schema else {"columns": schema}, sort_keys=False, allow_unicode=True)
