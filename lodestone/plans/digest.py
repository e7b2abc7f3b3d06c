"""The digest of a period: two sections of Markdown, evidence apart from community attention."""

from __future__ import annotations

import json
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import DataFrame

SECTIONS = {"Evidence": ["new_papers", "new_evidence", "stance_flips", "score_movement"], "Community": ["mentions"]}
NOTHING = "Nothing changed."


def render(since: datetime, changes: dict[str, DataFrame]) -> str:
    """Rows stream to the driver one at a time; an empty part says so."""
    out = [f"# Changes since {since:%Y-%m-%d}", ""]
    for title, parts in SECTIONS.items():
        out += [f"## {title}", ""]
        lines = []
        for part in parts:
            if part in changes:
                df = changes[part]
                lines += [f"- {part.replace('_', ' ')}: " + ", ".join(f"{c} {r[c]}" for c in df.columns) for r in df.orderBy(*df.columns).toLocalIterator()]
        out += [*(lines or [NOTHING]), ""]
    return "\n".join(out)


def write_report(folder: str | Path, day: date, report: dict) -> Path:
    """`eval-<day>.json`, put in place at once, so that a reader never sees half of it."""
    target = Path(folder) / f"eval-{day.isoformat()}.json"
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(".part")
    part.write_text(json.dumps(report, indent=2, sort_keys=True, default=str))
    part.replace(target)
    return target
