"""Settings from YAML files: environment variables expanded, fields checked against dataclasses; years to test."""

from __future__ import annotations

import dataclasses
import os
import re
import typing
from pathlib import Path


def expanded(value):
    """Environment variables in all strings of a nested value."""
    if isinstance(value, str):
        return os.path.expandvars(os.path.expanduser(value))
    if isinstance(value, dict):
        return {k: expanded(v) for k, v in value.items()}
    return [expanded(v) for v in value] if isinstance(value, list) else value


def built(kind, values: dict):
    """A dataclass from nested values; unknown names are an error."""
    kinds = typing.get_type_hints(kind)
    unknown = set(values) - {f.name for f in dataclasses.fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**{k: built(kinds[k], v) if dataclasses.is_dataclass(kinds[k]) and isinstance(v, dict) else v for k, v in values.items()})


def loaded(kind, path: str):
    import yaml

    return built(kind, expanded(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}))


def test_years(available: list[int], configured: list[int], compat: bool = False) -> list[int]:
    """The configured years that there are. If there is none: an error; with ``compat`` all years but the first, or the
    only one."""
    years = sorted(set(available))
    if found := [y for y in years if y in set(configured)]:
        return found
    if not compat or not years:
        raise ValueError("none of the configured years has questions")
    return years[1:] or years[-1:]


def benchmark_years(available: list[int], configured: list[int], anchor: int) -> list[int]:
    """The configured years after the anchor."""
    found = sorted(y for y in set(available) & set(configured) if y > anchor)
    if not found:
        raise RuntimeError("no year to test after the anchor")
    return found


test_years.__test__ = False


def adapter_years(folder: str) -> list[int]:
    """Years of trained adapters: folders ``year_max_<year>`` that hold one."""
    names = (re.fullmatch(r"year_max_(\d+)", p.parent.name) for p in Path(folder).glob("*/lora"))
    return sorted(int(m[1]) for m in names if m)
