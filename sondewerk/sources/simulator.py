"""Seeded generators: sensor frames of eight domains, anomalies, banks, coupled channels, chaotic systems."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The codes of the sensor classes on the wire.
CLASSES = {"acoustic": 0, "vibration": 1, "optical": 2, "rf": 3, "thermal": 4, "tribo": 5, "magnetic": 6, "capacitive": 7, "unknown": 255}
#: Range of a 12-bit converter.
FULL_SCALE = (-2048, 2047)


class Part(NamedTuple):
    """A component of a signal; ranges are drawn from uniformly, once per frame (or per event)."""

    shape: str
    level: tuple[float, float]
    #: Of tones and square waves in hertz, of decays the time constant in seconds, of chirps the end as a multiple of the start.
    rate: tuple[float, float] = (0.0, 0.0)
    #: Events per second for the shapes that are events.
    often: float = 0.0


#: Domains: sampling rate and what is heard, seen or felt there. A motor hums with an overtone, a rotor
#: shakes and is struck, a lamp flickers, a carrier is modulated, an oven drifts, contacts spark, a coil
#: switches, a touch plate steps.
DOMAINS: dict[str, tuple[int, tuple[Part, ...]]] = {
    "acoustic": (16_000, (Part("tone", (120, 380), (90, 2_400)), Part("tone", (30, 110), (2_400, 6_000)), Part("noise", (10, 24)))),
    "vibration": (3_200, (Part("tone", (150, 520), (8, 60)), Part("ring", (200, 700), (0.004, 0.02), 4.0), Part("noise", (12, 28)))),
    "optical": (4_000, (Part("offset", (150, 850)), Part("tone", (35, 90), (100, 120)), Part("spark", (250, 900), often=3.0), Part("noise", (5, 12)))),
    "rf": (32_000, (Part("modulated", (250, 500), (3_000, 12_000)), Part("noise", (18, 36)))),
    "thermal": (20, (Part("offset", (300, 700)), Part("ramp", (-400, 400)), Part("noise", (2, 6)))),
    "tribo": (6_400, (Part("spark", (-1_800, -700), often=16.0), Part("spark", (700, 1_800), often=16.0), Part("noise", (7, 15)))),
    "magnetic": (2_500, (Part("square", (350, 650), (12, 160)), Part("noise", (12, 26)))),
    "capacitive": (100, (Part("offset", (80, 320)), Part("step", (150, 600), often=0.3), Part("step", (-600, -150), often=0.3), Part("noise", (4, 9)))),
}
RATES = {name: rate for name, (rate, _) in DOMAINS.items()}
#: A fault is loud and harsh whatever the domain; an unknown sensor gives noise.
FAULT = (12_000, (Part("tone", (900, 1_500), (700, 3_000)), Part("square", (500, 1_100), (30, 150)), Part("noise", (120, 260))))
OTHER = (1_000, (Part("noise", (150, 250)),))


def _part(part: Part, sr: int, n: int, rng: np.random.Generator) -> np.ndarray:
    t = np.arange(n) / sr
    level, rate, phase = rng.uniform(*part.level), rng.uniform(*part.rate), rng.uniform(0, 2 * np.pi)
    angle = 2 * np.pi * rate * t + phase
    if part.shape == "noise":
        return level * rng.standard_normal(n)
    if part.shape == "offset":
        return np.full(n, level)
    if part.shape == "ramp":
        return level * t / t[-1]
    if part.shape == "tone":
        return level * np.sin(angle)
    if part.shape == "square":
        return level * np.sign(np.sin(angle) + 1e-9)
    if part.shape == "modulated":
        return level * np.sin(angle) * (1 + 0.6 * np.sin(angle / 40))
    # events at random times: a response of each, added up
    at = rng.integers(0, n, rng.poisson(part.often * n / sr))
    since = np.arange(n)[None, :] - at[:, None]
    levels = rng.uniform(*part.level, len(at))[:, None]
    response = {
        "spark": lambda d: (d >= 0) & (d < 2),
        "step": lambda d: d >= 0,
        "ring": lambda d: np.where(d >= 0, np.exp(-np.maximum(d, 0) / (sr * max(rate, 1e-6))), 0) * np.sin(d * 0.9),
    }[part.shape]
    return (levels * response(since)).sum(axis=0)


def frame(kind: str, rng: np.random.Generator, n: int = 512) -> np.ndarray:
    """One frame of a domain ('anomaly': of a fault; any other name: noise), as the converter gives it."""
    sr, parts = DOMAINS.get(kind, FAULT if kind == "anomaly" else OTHER)
    total = sum(_part(p, sr, n, rng) for p in parts)
    return np.rint(total).clip(*FULL_SCALE).astype(np.int16)


def frames(spark: SparkSession, count: int = 200, anomaly_rate: float = 0.03, seed: int = 7, partitions: int | None = None) -> DataFrame:
    """(node_id, seq, ts_us, sr_hz, sensor_class, label, payload): row i depends on seed and i only, at any partitioning.

    What a row is comes from its number in the JVM; only payloads are made in Python.
    """
    names = list(DOMAINS)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") % len(names) + 1).cast("int"))
    odd = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1_000_000)) < int(anomaly_rate * 1_000_000)
    plan = spark.range(0, count, 1, partitions or max(1, min(200, count // 1000))).select(
        "id", (F.col("id") % 8).alias("node_id"), F.floor(F.col("id") / 8).alias("seq"), (F.lit(1_735_689_600_000_000) + F.col("id") * 1_000_000).alias("ts_us"),
        pick([RATES[k] for k in names]).cast("bigint").alias("sr_hz"), pick([CLASSES[k] for k in names]).alias("sensor_class"), F.when(odd, F.lit("ANOMALY")).otherwise(pick(names)).alias("label"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = ["anomaly" if k == "ANOMALY" else k for k in b.column(6).to_pylist()]
            made = [frame(k, np.random.default_rng([seed, i])) for i, k in zip(b.column(0).to_pylist(), kinds)]
            yield pa.record_batch([*b.columns[1:], pa.array(made, pa.list_(pa.int16()))], names=[*b.schema.names[1:], "payload"])

    return plan.mapInArrow(run, "node_id bigint, seq bigint, ts_us bigint, sr_hz bigint, sensor_class int, label string, payload array<smallint>")


def ar1(phi: float, n: int, rng: np.random.Generator, burn: int = 1000) -> np.ndarray:
    e = rng.standard_normal(n + burn)
    x = np.zeros(n + burn)
    for i in range(1, n + burn):
        x[i] = phi * x[i - 1] + e[i]
    return x[burn:]


def ar1_bank(spark: SparkSession, normal: int = 20, odd: int = 20, phi: float = 0.97, windows: int = 8, length: int = 256, seed: int = 0) -> DataFrame:
    """(g, k, label, x): recordings of AR(1) noise, healthy ones with a coefficient of 0.2-0.8, the others with phi."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g in b["id"]:
                rng = np.random.default_rng([seed, int(g)])
                bad = g >= normal
                x = ar1(phi if bad else rng.uniform(0.2, 0.8), windows * length, rng).reshape(windows, length)
                rows += [(int(g), k, "anomaly" if bad else "normal", w) for k, w in enumerate(x)]
            yield pd.DataFrame(rows, columns=["g", "k", "label", "x"])

    return spark.range(normal + odd).mapInPandas(run, "g bigint, k int, label string, x array<double>")


def _standard(x: np.ndarray) -> np.ndarray:
    return (x - x.mean()) / (x.std() or 1)


def multimodal(n: int = 2000, seed: int = 0) -> pd.DataFrame:
    """Six channels: acoustic follows heat; vibration and em only share the confound temp; light is noise."""
    rng = np.random.default_rng(seed)
    temp = _standard(np.cumsum(rng.standard_normal(n)) * 0.3)
    heat = _standard(np.convolve((rng.random(n) < 0.1).astype(float), np.exp(-np.arange(20) / 5), "same"))
    noise = rng.standard_normal((4, n))
    return pd.DataFrame({"t": np.arange(n), "temp": temp, "heat": heat, "acoustic": np.tanh(1.5 * heat) + 0.3 * noise[0], "vibration": 0.9 * temp + 0.4 * noise[1], "em": 0.8 * temp + 0.4 * noise[2], "light": noise[3]})


def logistic_chain(n: int = 1500, ab: float = 0.1, bc: float = 0.1, rates: tuple = (3.72, 3.81, 3.91), seed: int = 0, burn: int = 300) -> pd.DataFrame:
    """A drives B drives C, chaotic; a link of 0 is severed."""
    v = np.random.default_rng(seed).uniform(0.2, 0.6, 3)
    r, link = np.array(rates), np.array([0.0, ab, bc])
    out = np.empty((n + burn, 3))
    for i in range(n + burn):
        out[i] = v
        v = v * (r - r * v - link * np.roll(v, 1))
    return pd.DataFrame(out[burn:], columns=["A", "B", "C"]).assign(t=np.arange(n))


def feed_forward(nodes: int, fault: bool, seed: int, regime: str = "linear", n: int = 1500, burn: int = 300) -> pd.DataFrame:
    """A random tree: each node follows itself (0.4) and, amplified (1.3), one earlier node; a fault is a step of 3 at v0."""
    rng = np.random.default_rng(seed)
    parent = [0, *[int(rng.integers(0, i)) for i in range(1, nodes)]]
    noise = rng.standard_normal((n + burn, nodes))
    x = np.empty((n + burn, nodes))
    x[0] = rng.uniform(0.2, 0.6, nodes)
    for t in range(1, n + burn):
        p = x[t - 1, parent]
        push = 1.3 * p + (0.5 * np.sin(p) if regime == "nonlinear" else 0)
        push[0] = 3.0 if fault else 0.0
        x[t] = 0.4 * x[t - 1] + push + noise[t]
    return pd.DataFrame(x[burn:], columns=[f"v{i}" for i in range(nodes)]).assign(t=np.arange(n))


#: Right-hand sides of known systems (their usual parameters).
SYSTEMS = {
    "lorenz": lambda s: np.array([10 * (s[1] - s[0]), s[0] * (28 - s[2]) - s[1], s[0] * s[1] - 8 / 3 * s[2]]),
    "rossler": lambda s: np.array([-s[1] - s[2], s[0] + 0.2 * s[1], 0.2 + s[2] * (s[0] - 5.7)]),
}


def simulate(system: str, start: np.ndarray, steps: int, dt: float) -> np.ndarray:
    """Runge-Kutta orbit, steps x dimensions."""
    f, s = SYSTEMS[system], np.array(start, float)
    out = np.empty((steps, len(s)))
    for i in range(steps):
        out[i] = s
        a = f(s)
        b = f(s + dt / 2 * a)
        c = f(s + dt / 2 * b)
        s = s + dt / 6 * (a + 2 * b + 2 * c + f(s + dt * c))
    return out


def observable(system: str, span: float = 80, dt: float = 0.01) -> np.ndarray:
    return _standard(simulate(system, np.array([1.0, 1.0, 1.0]), int(span / dt), dt)[:, 0])
