"""Settings of the command line: built-in values, overlaid by a JSON file."""

from __future__ import annotations

import json
from typing import Any

DEFAULTS: dict[str, Any] = {"data": "data/raw", "models": "models", "lines_csv": None, "stat_name": "passes attempted", "draws": 1000, "sweeps": 12, "seed": 7}


def load(path: str | None = None, **given: Any) -> dict[str, Any]:
    """Defaults, then the file's values, then those given; unknown keys of the file are an error."""
    out = dict(DEFAULTS)
    if path:
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        if unknown := sorted(set(read) - set(DEFAULTS)):
            raise KeyError(f"unknown settings: {', '.join(unknown)}")
        out |= read
    return out | {k: v for k, v in given.items() if v is not None}
