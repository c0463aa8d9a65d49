"""Applicability over three dimensions, each ``specific`` values, ``all`` or ``unknown``."""

from __future__ import annotations

import hashlib
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = ("platforms", "businesses", "audiences")
MODES = ("specific", "all", "unknown")


def normalise(scope: dict | None, aliases: dict[str, str] | None = None) -> dict:
    """Canonical applicability: NFKC, trimmed, aliased, sorted, distinct values."""
    out = {}
    for name in DIMENSIONS:
        item = (scope or {}).get(name) or {}
        if isinstance(item, str):
            item = {"mode": item}
        mode = item.get("mode", "specific" if item.get("values") else "unknown")
        if mode not in MODES:
            raise ValueError(f"{name}: unknown mode {mode}")
        values = {unicodedata.normalize("NFKC", v).strip() for v in item.get("values") or ()}
        values = sorted({(aliases or {}).get(v, v) for v in values if v})
        if (mode == "specific") != bool(values):
            raise ValueError(f"{name}: values belong to the mode specific")
        if len(values) > 64 or any(len(v) > 128 or len(v.encode()) > 256 for v in values):
            raise ValueError(f"{name}: too many or too long values")
        out[name] = {"mode": mode, "values": values}
    return out


def scope_identity(scope: dict | None) -> str:
    """Hash of the canonical scope; empty if every dimension is unknown."""
    own = normalise(scope)
    if all(v["mode"] == "unknown" for v in own.values()):
        return ""
    text = json.dumps(own, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def dimension_matches(mode: Column, values: Column, requested: dict) -> Column:
    """A specific request meets rows for all, and specific rows with a common value; never unknown rows."""
    if requested["mode"] != "specific":
        return F.lit(True)
    asked = F.array(*[F.lit(v) for v in requested["values"]])
    met = (mode == "all") | ((mode == "specific") & F.arrays_overlap(values, asked))
    return F.coalesce(met, F.lit(False))


def scope_matches(columns: dict[str, tuple[Column, Column]], scope: dict | None) -> Column:
    """AND over the dimensions; ``columns`` has (mode, values) by dimension."""
    own, out = normalise(scope), F.lit(True)
    for name, (mode, values) in columns.items():
        out = out & dimension_matches(mode, values, own[name])
    return out


def group_matches(mode: Column, values: Column, group: str, value: str | None = None) -> Column:
    """Membership in a platform group: all_only, unknown_only or specific_only."""
    if group == "specific_only":
        return (mode == "specific") & F.array_contains(values, F.lit(value))
    return mode == {"all_only": "all", "unknown_only": "unknown"}[group]
