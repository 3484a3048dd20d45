"""Settings of runs: key = value files, lists of models with path templates, defaults, and the paths of one run."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta
from pathlib import Path

from stratocast.sources.micaps import templated_path


def settings(text: str) -> dict[str, dict[str, str]]:
    """Sections of `[name]` and `key = value` lines; keys before any section are under "". Lines after # or ; are notes."""
    found: dict[str, dict[str, str]] = {"": {}}
    section = ""
    for line in text.splitlines():
        line = line.strip().lstrip("﻿")
        if not line or line[0] in "#;":
            continue
        if line[0] == "[" and line[-1] == "]":
            section = line[1:-1].strip()
            found.setdefault(section, {})
        elif "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            found[section][key] = value
    return found


@dataclass(frozen=True)
class Run:
    """One run: when it was issued, its models' templates in order, the templates of observations and output, its leads."""

    issue: datetime
    models: dict[str, str]
    fact: str
    output: str
    leads: tuple[int, ...]
    block: tuple[float, float] = (5.0, 5.0)
    clip: tuple[float, float, float, float] = (70.0, 140.0, 0.0, 60.0)
    other: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[tuple[str, int, str]]:
        """(model, lead, path) of every file the run wants."""
        return [(name, lead, templated_path(template, self.issue, lead)) for name, template in self.models.items() for lead in self.leads]

    def observed(self) -> list[tuple[int, str]]:
        """(lead, path) of the observation valid at each lead."""
        return [(lead, templated_path(self.fact, self.issue + timedelta(hours=lead), lead)) for lead in self.leads]


def run_of(text: str, issue: datetime, leads: tuple[int, ...]) -> Run:
    """The run that a model list describes: modelNum models as name = template, fact and staoutputPath; raises if the number differs."""
    given = settings(text)[""]
    named = {k: v for k, v in given.items() if k not in ("modelNum", "fact", "staoutputPath", "block", "clip")}
    models = {k: v for k, v in named.items() if "YYYY" in v}
    if "modelNum" in given and int(given["modelNum"]) != len(models):
        raise ValueError(f"{given['modelNum']} models are announced and {len(models)} listed")
    numbers = lambda key, default: tuple(float(x) for x in given[key].split(",")) if key in given else default
    return Run(issue, models, given.get("fact", ""), given.get("staoutputPath", ""), leads, numbers("block", Run.block), numbers("clip", Run.clip), {k: v for k, v in named.items() if k not in models})


def read_run(path: str, issue: datetime, leads: tuple[int, ...], encoding: str = "utf-8") -> Run:
    """run_of a file."""
    return run_of(Path(path).read_text(encoding=encoding, errors="ignore"), issue, leads)


def cycle_before(now: datetime, hours: tuple[int, ...], delay_hours: int) -> datetime:
    """The latest cycle, of those at the given hours of a day, that is at least delay_hours old."""
    limit = now - timedelta(hours=delay_hours)
    days = [limit.replace(hour=0, minute=0, second=0, microsecond=0) - timedelta(days=d) for d in (0, 1)]
    return max(c for day in days for h in hours if (c := day + timedelta(hours=h)) <= limit)
