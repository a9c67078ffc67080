"""Named plugins, a frame pipeline built from them, source profiles, method catalogue and routing."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondewerk.functions import kernels
from sondewerk.operators import frames

_PLUGINS: dict[tuple[str, str], Any] = {}


def register(kind: str, name: str) -> Callable:
    """Decorator: make a class or function known under kind and name."""
    def add(x: Any) -> Any:
        _PLUGINS[kind, name] = x
        return x

    return add


def get(kind: str, name: str) -> Any:
    try:
        return _PLUGINS[kind, name]
    except KeyError:
        raise KeyError(f"no {kind} {name!r}; there are {available(kind)}") from None


def available(kind: str) -> list[str]:
    return sorted(n for k, n in _PLUGINS if k == kind)


@register("transform", "fft")
def fft(df: DataFrame, bins: int = 256) -> DataFrame:
    """df with feature array<double>, energy_rms and energy_peak of its payload."""
    def kernel(x: np.ndarray) -> np.ndarray:
        mag, _, rms, peak = kernels.spectral_shape(x, bins)
        return np.concatenate([mag, rms[:, None], peak[:, None]], axis=1)

    keys = [c for c in df.columns if c != "payload"]
    wide = frames.map_series(df, keys, "payload", kernel, [*[f"m{i}" for i in range(bins)], "energy_rms", "energy_peak"])
    return wide.select(*keys, F.array(*[f"m{i}" for i in range(bins)]).alias("feature"), "energy_rms", "energy_peak")


def pipeline(source: DataFrame, transform: Callable[[DataFrame], DataFrame], model: Callable[[DataFrame], DataFrame], sinks: Sequence[Callable[[DataFrame, int], None]], limit: int | None = None) -> DataFrame:
    """Frames through transform and model to every sink; spectra are passed over, the result is given back."""
    rows = source.filter("not coalesce(is_spectrum, false)") if "is_spectrum" in source.columns else source
    out = model(transform(rows if limit is None else rows.limit(limit)))
    for sink in sinks:
        sink(out, 0)
    return out


# ---------------------------------------------------------------- profiles and routing
@dataclass(frozen=True)
class Profile:
    source: str
    device: str
    setup: str
    metrics: dict[str, Any]

    @property
    def key(self) -> str:
        return f"{self.source}:{self.device}:{self.setup}"

    @property
    def signature(self) -> str:
        return hashlib.sha256(json.dumps(self.metrics, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def profile(windows: DataFrame, source: str, device: str, setup: str, x: str = "x", channels: int = 1) -> Profile:
    """Label-free profile of (g, x) windows: counts, median length, finite share, medians of four metrics."""
    names = ["spectral_concentration", "noise_proxy", "stationarity_drift", "impulsiveness"]
    m = frames.map_series(windows, ["g"], x, kernels.profile_metrics, names).agg(*[F.round(F.percentile(n, F.lit(0.5)), 12).alias(n) for n in names]).first()
    fine = F.size(F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    c = windows.agg(F.count("*").alias("windows"), F.count_distinct("g").alias("recordings"), F.percentile(F.size(x), F.lit(0.5)).alias("samples"), (F.sum(fine) / F.sum(F.size(x))).alias("finite")).first()
    if not c["windows"]:
        raise ValueError("an empty bank has no profile")
    return Profile(source, device, setup, {"recordings": c["recordings"], "windows": c["windows"], "channels": channels, "samples_per_window": int(c["samples"]), "finite_fraction": round(c["finite"], 12)} | {n: m[n] for n in names})


#: What a method family needs: (samples, finite share, channels, recordings).
FAMILIES = {"time_domain": (16, 0.99, 1, 1), "spectral": (64, 0.99, 1, 1), "envelope": (128, 0.99, 1, 1), "recurrence": (128, 0.99, 1, 1), "coherence": (0, 0.0, 2, 1), "causal_lag": (0, 0.0, 2, 2)}


def route(p: Profile) -> tuple[list[str], dict[str, str]]:
    """(compatible families, reason for each of the others), without labels or outcomes."""
    m, reasons = p.metrics, {}
    for name, (n, finite, channels, recs) in FAMILIES.items():
        if m["channels"] < channels or m["recordings"] < recs:
            reasons[name] = f"needs {channels} channels and {recs} recordings"
        elif m["samples_per_window"] < n or (finite and m["finite_fraction"] <= finite):
            reasons[name] = f"needs finite windows of at least {n} samples"
    return [f for f in FAMILIES if f not in reasons], reasons


COSTS = ("low", "medium", "high", "unknown")
STATUSES = ("candidate", "confirmed", "rejected")
REQUIREMENTS = {"channels": "channels", "min_samples": "samples_per_window", "min_recordings": "recordings", "finite_fraction": "finite_fraction"}


@dataclass(frozen=True)
class Method:
    name: str
    family: str
    status: str = "candidate"
    requires: dict[str, float] = field(default_factory=dict)
    cost: str = "unknown"

    def __post_init__(self) -> None:
        if self.status not in STATUSES or self.cost not in COSTS or set(self.requires) - set(REQUIREMENTS):
            raise ValueError(f"method {self.name!r} has an unknown status, cost or requirement")

    def failure(self, p: Profile) -> str | None:
        """The first requirement the profile does not meet."""
        return next((f"requires {k} >= {v:g}" for k, v in self.requires.items() if p.metrics.get(REQUIREMENTS[k], 0) < v), None)


def route_methods(p: Profile, methods: Sequence[Method]) -> dict[str, Any]:
    """eligible methods by (cost, status, name) with their priorities, and the reasons of the others."""
    if len({m.name for m in methods}) < len(methods):
        raise ValueError("method names must be unique")
    fails = {m.name: f for m in methods if (f := m.failure(p))}
    fit = sorted((m for m in methods if m.name not in fails), key=lambda m: (COSTS.index(m.cost), m.status, m.name))
    return {"eligible": [m.name for m in fit], "excluded": fails, "priorities": {m.name: i for i, m in enumerate(fit)}}


class Qualifications:
    """Which source, device and setup was qualified for which families."""

    VERSION = 1

    def __init__(self, entries: dict[str, dict] | None = None):
        self.entries = entries or {}

    def add(self, p: Profile, receipts: dict[str, Any]) -> None:
        fit, reasons = route(p)
        states = {f: {"state": "confirmed" if f in receipts else "candidate"} for f in fit} | {f: {"state": "not_measured_incompatible", "reason": r} for f, r in reasons.items()}
        self.entries[p.key] = {"source": p.source, "signature": p.signature, "metrics": p.metrics, "families": states, "receipts": receipts}

    def status(self, p: Profile) -> str:
        """confirmed, qualification_required (changed setup or signature of a known source) or new_source."""
        if (e := self.entries.get(p.key)) is not None:
            return "confirmed" if e["signature"] == p.signature else "qualification_required"
        return "qualification_required" if any(e["source"] == p.source for e in self.entries.values()) else "new_source"

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps({"version": self.VERSION, "entries": self.entries}, indent=2, sort_keys=True))

    @classmethod
    def load(cls, path: str | Path) -> Qualifications:
        d = json.loads(Path(path).read_text())
        if d.get("version") != cls.VERSION:
            raise ValueError("unknown version of the qualifications")
        return cls(d["entries"])
