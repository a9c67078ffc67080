"""Catalogue of the series programs pool(t2(t1(x))), ordered by complexity, and the capacity gate."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from sondewerk.functions.kernels import POOLS, TRANSFORMS

#: Static costs that order the catalogue (fixed values). 1 a pass, 2 a sort or histogram, 3 a Fourier transform or a loop over lags.
TRANSFORM_COST = {"id": 0, "diff": 1, "diff2": 1, "abs": 1, "sign": 1, "sq": 1, "tanh": 1, "clip": 2, "rank": 2, "rollstd": 2, "env": 2, "cumsum": 2}
POOL_COST = {"std": 1, "meanabs": 1, "acf1": 1, "zcr": 1, "crest": 1, "runmean": 1, "runcv": 1, "peakcv": 1, "lcross": 1, "iqr90": 2, "hent": 2, "ordtrans": 2, "specratio": 3, "speccent": 3, "specflat": 3, "acflag": 3}
#: Programs a recording can carry.
CAPACITY = 50


class Program(NamedTuple):
    t1: str
    t2: str
    pool: str

    @property
    def name(self) -> str:
        return f"{self.pool}({self.t2}({self.t1}(x)))"

    @property
    def complexity(self) -> tuple[int, int, int, str]:
        return (self.t1 != "id") + (self.t2 != "id"), POOL_COST[self.pool], TRANSFORM_COST[self.t1] + TRANSFORM_COST[self.t2], self.name

    @property
    def families(self) -> set[str]:
        """Method families a program draws on."""
        out = set()
        if self.pool.startswith("spec"):
            out.add("spectral")
        if "env" in (self.t1, self.t2):
            out.add("envelope")
        return out or {"time_domain"}


def catalogue() -> list[Program]:
    """All programs, cheapest first; id stands only in the inner place."""
    chains = [(a, b) for a in TRANSFORMS for b in TRANSFORMS if b != "id" or a == "id"]
    return sorted((Program(a, b, p) for a, b in chains for p in POOLS), key=lambda p: p.complexity)


def parse(name: str) -> Program:
    pool, t2, t1 = name.removesuffix("(x)))").split("(")
    return Program(t1, t2, pool)


def budget(recordings: int, size: int, capacity: int = CAPACITY) -> int:
    return min(size, capacity * max(recordings, 0))


def gate(programs: list[Program], recordings: int, capacity: int = CAPACITY) -> list[Program]:
    """The cheapest programs the recordings can carry."""
    return programs[: budget(recordings, len(programs), capacity)]


def allowed(programs: list[Program], families: set[str]) -> list[Program]:
    return [p for p in programs if p.families <= families]


def distinct_columns(features: np.ndarray, correlation: float = 0.999, equal: float = 0.95) -> list[int]:
    """The columns that are neither constant nor a clone of an earlier kept one (correlated or mostly equal)."""
    kept: list[int] = []
    z = features - features.mean(axis=0)
    norm = np.sqrt((z * z).sum(axis=0))
    for j in np.flatnonzero(norm > 1e-12):
        if kept:
            r = np.abs(z[:, kept].T @ z[:, j]) / (norm[kept] * norm[j])
            same = (np.abs(features[:, kept] - features[:, [j]]) < 1e-12).mean(axis=0)
            if (r > correlation).any() or (same >= equal).any():
                continue
        kept.append(int(j))
    return kept


#: Cross-channel slot of multichannel programs.
def combiners(channels: int) -> list[str]:
    pairs = [(i, j) for i in range(channels) for j in range(i + 1, channels)]
    return [f"ch{i}" for i in range(channels)] + [f"logratio({i},{j})" for i, j in pairs] + [f"chdiff({i},{j})" for i, j in pairs] + (["mean", "std"] if channels > 1 else [])


def parse_combiner(name: str) -> tuple[str, tuple[int, ...]]:
    if name.startswith("ch") and name[2:].isdigit():
        return "ch", (int(name[2:]),)
    kind, _, rest = name.partition("(")
    return kind, tuple(int(a) for a in rest.rstrip(")").split(",") if a)


def combine(name: str, x: np.ndarray) -> np.ndarray:
    """rows x channels x time to rows x time."""
    kind, at = parse_combiner(name)
    if kind == "ch":
        return x[:, at[0]]
    if kind == "logratio":
        return np.log((np.abs(x[:, at[0]]) + 1e-9) / (np.abs(x[:, at[1]]) + 1e-9))
    if kind == "chdiff":
        return x[:, at[0]] - x[:, at[1]]
    return x.mean(axis=1) if kind == "mean" else x.std(axis=1)
