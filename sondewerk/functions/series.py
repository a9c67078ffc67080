"""The series grammar as Catalyst expressions: transforms (array -> array) and pools (array -> double).

Every function takes and gives a Column over array<double>. They stay in the JVM and serve short
series and checks; long windows and whole grammars go through ``functions.kernels``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _slice(x: Column, start: int | Column, length: Column | int) -> Column:
    return F.slice(x, start if isinstance(start, Column) else F.lit(start), F.greatest(length if isinstance(length, Column) else F.lit(length), F.lit(0)))


def _indices(first: int | Column, last: Column) -> Column:
    """first..last, empty if last is smaller."""
    a = first if isinstance(first, Column) else F.lit(first)
    return F.when(last >= a, F.sequence(a, last)).otherwise(F.array().cast("array<int>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also inside lambdas of body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def centred(x: Column) -> Column:
    return let(x, lambda y: let(mean(y), lambda m: F.transform(y, lambda v: v - m)))


def _after(x: Column, k: int = 1) -> Column:
    return _slice(x, k + 1, F.size(x) - k)


def _until(x: Column, k: int = 1) -> Column:
    return _slice(x, 1, F.size(x) - k)


def quantile(x: Column, p: float) -> Column:
    """Linear interpolation between order statistics."""
    def read(s: Column) -> Column:
        h = (F.size(s) - 1) * F.lit(p)
        lo = F.floor(h).cast("int")
        a, b = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(s) - 1))
        return a + (b - a) * (h - lo)

    return let(F.array_sort(x), read)


# transforms
def identity(x: Column) -> Column:
    return x


def diff(x: Column) -> Column:
    return let(x, lambda y: F.zip_with(_after(y), _until(y), lambda a, b: a - b))


def diff2(x: Column) -> Column:
    return diff(diff(x))


def absolute(x: Column) -> Column:
    return F.transform(x, F.abs)


def sign(x: Column) -> Column:
    return F.transform(x, F.signum)


def rank(x: Column) -> Column:
    """Ordinal rank from 0 by value, ties by place, over the length."""
    placed = F.array_sort(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    back = F.array_sort(F.transform(placed, lambda s, r: F.struct(s["i"].alias("i"), r.alias("r"))))
    return let(back, lambda b: F.transform(b, lambda s: s["r"] / F.size(b)))


def square(x: Column) -> Column:
    return F.transform(x, lambda v: v * v)


def tanh(x: Column) -> Column:
    return F.transform(x, F.tanh)


def rolling(x: Column, width: int, f: Callable[[Column], Column]) -> Column:
    """f over every full span of width values."""
    return let(x, lambda y: F.transform(_indices(1, F.size(y) - width + 1), lambda i: let(F.slice(y, i, F.lit(width)), f)))


def rollstd(x: Column, width: int = 16) -> Column:
    spread = rolling(x, width, lambda s: F.sqrt(F.greatest(mean(square(s)) - mean(s) * mean(s), F.lit(0.0))))
    return F.when(F.size(x) - width + 1 < 8, x).otherwise(spread)


def env(x: Column) -> Column:
    return rolling(absolute(x), 8, mean)


def cumsum(x: Column) -> Column:
    sums = let(centred(x), lambda z: F.transform(z, lambda v, i: total(F.slice(z, F.lit(1), i + 1))))
    return let(sums, lambda c: let(F.array_max(absolute(c)) + EPS, lambda top: F.transform(c, lambda v: v / top)))


def clip(x: Column) -> Column:
    return let(quantile(x, 0.05), lambda lo: let(quantile(x, 0.95), lambda hi: F.transform(x, lambda v: F.least(F.greatest(v, lo), hi))))


TRANSFORMS: dict[str, Callable[[Column], Column]] = {"id": identity, "diff": diff, "diff2": diff2, "abs": absolute, "sign": sign, "rank": rank, "sq": square, "tanh": tanh, "rollstd": rollstd, "env": env, "cumsum": cumsum, "clip": clip}


# pools
def std(x: Column) -> Column:
    return F.sqrt(let(centred(x), lambda z: mean(square(z))))


def meanabs(x: Column) -> Column:
    return let(absolute(x), mean)


def iqr90(x: Column) -> Column:
    return quantile(x, 0.95) - quantile(x, 0.05)


def _entropy(counts: Column) -> Column:
    def read(c: Column) -> Column:
        return let(total(F.transform(c, lambda k: k.cast("double"))), lambda n: -total(F.transform(F.filter(c, lambda k: k > 0), lambda k: k / n * F.log(k / n))))

    return let(counts, read)


def hent(x: Column) -> Column:
    """Shannon entropy of a histogram of 16 bins; a constant series has one bin."""
    def cells(lo: Column, hi: Column) -> Column:
        return F.transform(x, lambda v: F.when(hi > lo, F.least(F.lit(15), F.floor((v - lo) * (16.0 / (hi - lo))).cast("int"))).otherwise(8))

    cell = let(F.array_min(x), lambda lo: let(F.array_max(x), lambda hi: cells(lo, hi)))
    return _entropy(_tally(cell, 16))


def _tally(cells: Column, n: int) -> Column:
    """How often each of 0..n-1 occurs."""
    return let(cells, lambda a: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.size(F.filter(a, lambda c: c == b))))


def _side(x: Column) -> Column:
    return let(quantile(x, 0.5), lambda m: F.transform(x, lambda v: F.signum(v - m)))


def _changes(x: Column) -> Column:
    return let(_side(x), lambda s: F.zip_with(_after(s), _until(s), lambda a, b: (a != b).cast("double")))


def zcr(x: Column) -> Column:
    return let(_changes(x), mean)


def acf1(x: Column) -> Column:
    def read(v: Column) -> Column:
        return let(total(square(v)), lambda d: F.when(d > 0, total(F.zip_with(_after(v), _until(v), lambda a, b: a * b)) / d).otherwise(0.0))

    return let(centred(x), read)


def _places(flags: Column) -> Column:
    """0-based places of the true flags."""
    return F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())


def _cv(x: Column) -> Column:
    return let(x, lambda y: std(y) / (mean(y) + EPS))


def _runs(x: Column) -> Column:
    cut = F.transform(_places(F.transform(_changes(x), lambda c: c > 0)), lambda i: i + 1)
    ends = F.concat(F.array(F.lit(0)), cut, F.array(F.size(x)))
    return F.transform(diff(ends), lambda v: v.cast("double"))


def runmean(x: Column) -> Column:
    return let(_runs(x), mean)


def runcv(x: Column) -> Column:
    return _cv(_runs(x))


def _gap_cv(places: Column) -> Column:
    return let(places, lambda p: F.when(F.size(p) < 3, F.lit(0.0)).otherwise(_cv(F.transform(diff(p), lambda v: v.cast("double")))))


def peakcv(x: Column) -> Column:
    rising = F.zip_with(_until(_after(x)), _until(x, 2), lambda a, b: a > b)
    falling = F.zip_with(_until(_after(x)), _after(x, 2), lambda a, b: a > b)
    return _gap_cv(_places(F.zip_with(rising, falling, lambda a, b: a & b)))


def power(x: Column) -> Column:
    """Power of the real Fourier bins 0..n/2, by definition (quadratic in the length)."""
    def part(k: Column, f: Callable[[Column], Column]) -> Column:
        return total(F.transform(x, lambda v, i: v * f((k * i % F.size(x)) * (2 * 3.141592653589793) / F.size(x))))

    return F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / 2).cast("int")), lambda k: F.pow(part(k, F.cos), 2) + F.pow(part(k, F.sin), 2))


def specratio(x: Column) -> Column:
    def read(p: Column) -> Column:
        m = F.floor(F.size(p) / 4).cast("int")
        return total(_slice(p, m + 1, F.size(p) - m)) / (total(_slice(p, 1, m)) + EPS)

    return let(power(x), read)


def speccent(x: Column) -> Column:
    return let(power(x), lambda p: total(F.transform(p, lambda v, k: v * k)) / (total(p) + EPS) / F.size(p))


def specflat(x: Column) -> Column:
    return let(F.transform(power(x), lambda v: v + 1e-20), lambda p: F.exp(mean(F.transform(p, lambda v: F.log(v)))) / mean(p))


def crest(x: Column) -> Column:
    return F.array_max(absolute(x)) / (meanabs(x) + EPS)


def ordinal_states(x: Column) -> Column:
    up = let(x, lambda y: F.zip_with(_until(y), _after(y), lambda a, b: (a < b).cast("int")))
    return let(up, lambda u: F.zip_with(_until(u), _after(u), lambda a, b: a * 2 + b))


def ordtrans(x: Column) -> Column:
    return _entropy(_tally(let(ordinal_states(x), lambda s: F.zip_with(_until(s), _after(s), lambda a, b: a * 4 + b)), 16))


def lcross(x: Column) -> Column:
    return _gap_cv(_places(F.zip_with(_until(x), _after(x), lambda a, b: (a < 1.0) & (b >= 1.0))))


def acflag(x: Column) -> Column:
    """Lag of 2..64 with the largest autocorrelation (the smallest among equals), over 64."""
    def lags(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(2), F.lit(64)), lambda k: total(F.zip_with(_slice(v, k + 1, F.size(v) - k), _slice(v, 1, F.size(v) - k), lambda a, b: a * b)))

    return let(let(centred(x), lags), lambda ac: (F.array_position(ac, F.array_max(ac)) + 1) / 64.0)


def permutation_entropy(x: Column) -> Column:
    return _entropy(_tally(ordinal_states(x), 4)) / F.log(F.lit(4.0))


def hjorth(x: Column) -> tuple[Column, Column]:
    """Mobility and complexity."""
    a, b, c = std(x), std(diff(x)), std(diff2(x))
    return F.try_divide(b, a), F.try_divide(c * a, F.pow(b, 2))


POOLS: dict[str, Callable[[Column], Column]] = {"std": std, "meanabs": meanabs, "iqr90": iqr90, "hent": hent, "zcr": zcr, "acf1": acf1, "runmean": runmean, "runcv": runcv, "peakcv": peakcv, "specratio": specratio, "speccent": speccent, "crest": crest, "ordtrans": ordtrans, "lcross": lcross, "acflag": acflag, "specflat": specflat}


def finite(v: Column) -> Column:
    """A program's value: anything not finite counts as 0."""
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(0.0)).otherwise(v)


def program(t1: str, t2: str, pool: str) -> Callable[[Column], Column]:
    """pool(t2(t1(x)))."""
    return lambda x: finite(let(TRANSFORMS[t2](TRANSFORMS[t1](x)), POOLS[pool]))
