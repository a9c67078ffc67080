import numpy as np
import pytest
from pyspark.sql import functions as F

from sondewerk.functions import composer, grammar, kernels, series
from sondewerk.operators import frames


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((12, 40))
    x[3] = np.round(x[3])
    x[4] = np.cumsum(x[4])
    x[5] = 2.0
    x[6] = np.sin(np.arange(40) / 3)
    return x


def test_jvm_and_numpy_programs_agree(spark, data):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(data)], "i int, x array<double>")
    programs = [grammar.Program("id", "id", p) for p in series.POOLS] + [grammar.Program("id", t, p) for t in series.TRANSFORMS if t != "id" for p in ("std", "zcr", "acf1")] + [grammar.Program("abs", "diff", "hent"), grammar.Program("sq", "rollstd", "meanabs")]
    cols = [series.program(*p)(F.col("x")).alias(f"p{j}") for j, p in enumerate(programs)]
    got = {r.i: r[1:] for r in df.select("i", *cols).collect()}
    want = kernels.program_matrix(data, programs)
    for i in range(len(data)):
        if i != 5:  # of a constant series the higher transforms are rounding noise
            np.testing.assert_allclose(got[i], want[i], rtol=1e-9, atol=1e-9)
    assert [got[5][list(series.POOLS).index(p)] for p in ("std", "meanabs", "iqr90", "hent", "zcr", "acf1")] == [0, 2, 0, 0, 0, 0]


def test_catalogue_and_gate():
    c = grammar.catalogue()
    assert len(c) == 2128 and len({p.name for p in c}) == 2128 and [grammar.parse(p.name) for p in c] == c
    assert [len(grammar.gate(c, n)) for n in (0, 1, 10, 1000)] == [0, 50, 500, 2128]
    assert all(p.t1 == p.t2 == "id" for p in c[:16]) and grammar.allowed(c, {"spectral"})
    assert {f for p in grammar.allowed(c, {"time_domain"}) for f in p.families} == {"time_domain"}


def test_shared_chains_equal_single_programs(data):
    programs = grammar.catalogue()[::97]
    all_ = kernels.program_matrix(data, programs)
    for j, p in enumerate(programs):
        np.testing.assert_array_equal(kernels.program_matrix(data, [p])[:, 0], all_[:, j])
    assert np.isfinite(kernels.program_matrix(data[:, :3], programs)).all()


def test_clones_are_dropped():
    rng = np.random.default_rng(1)
    a = rng.standard_normal(50)
    assert grammar.distinct_columns(np.stack([a, 2 * a + 1, np.ones(50), rng.standard_normal(50), a + 1e-9], axis=1)) == [0, 3]


def test_combiners():
    x = np.random.default_rng(2).standard_normal((3, 2, 20))
    assert grammar.combiners(2) == ["ch0", "ch1", "logratio(0,1)", "chdiff(0,1)", "mean", "std"]
    assert all(grammar.combine(c, x).shape == (3, 20) for c in grammar.combiners(2))
    np.testing.assert_allclose(grammar.combine("chdiff(0,1)", x), x[:, 0] - x[:, 1])


def test_recurrence_against_the_definition():
    x = np.random.default_rng(3).standard_normal(120)
    v = kernels.embed(x, 3, 5)
    d = np.abs(v[:, None] - v[None]).max(axis=2)
    r = d < np.quantile(d, 0.1)
    diag = [n for k in range(1, len(r)) for n in kernels.run_lengths(np.diagonal(r, k))]
    vert = [n for j in range(len(r)) for n in kernels.run_lengths(r[:, j])]
    got = dict(zip(kernels.RQA_NAMES, kernels.rqa_one(x)))
    assert np.isclose(got["rqa_det"], sum(n for n in diag if n >= 2) / sum(diag)) and np.isclose(got["rqa_lam"], sum(n for n in vert if n >= 2) / sum(vert))
    assert np.isclose(got["rqa_rr"], (r.sum() - len(r)) / (len(r) ** 2 - len(r))) and np.isclose(got["rqa_tt"], np.mean([n for n in vert if n >= 2]))
    with pytest.raises(ValueError):
        kernels.rqa_one(x[:5])


def test_spectral_kernels():
    t = np.arange(2048)
    tone = np.sin(2 * np.pi * 0.125 * t)[None]
    f, p = kernels.welch(tone)
    assert f[p[0].argmax()] == 0.125 and np.isclose(p.sum() * f[1], tone.var(), rtol=0.01)
    rng = np.random.default_rng(4)
    noise = rng.standard_normal((20, 4096))
    assert abs(kernels.psd_slope(noise).mean()) < 0.1 and kernels.psd_slope(np.cumsum(noise, axis=1)).mean() < -1
    np.testing.assert_allclose(kernels.coherence(noise, 2 * noise), 1)
    assert kernels.coherence(noise, rng.standard_normal(noise.shape)).mean() < 0.1
    np.testing.assert_allclose(np.abs(kernels.analytic(tone))[0, 100:-100], 1, atol=1e-6)
    np.testing.assert_allclose(kernels.envelope_bands(noise).sum(axis=1), 1)
    np.testing.assert_allclose(kernels.wavelet_energies(noise).sum(axis=1), 1)
    m, _, rms, peak = kernels.spectral_shape(noise, 64)
    assert m.shape == (20, 64)
    np.testing.assert_allclose(np.linalg.norm(m, axis=1), 1)
    np.testing.assert_allclose(rms, noise.std(axis=1), rtol=0.05)
    slow = np.sin(2 * np.pi * 3 * np.arange(90) / 90)[None]
    np.testing.assert_allclose(kernels.resample_fourier(slow, 60)[0], np.sin(2 * np.pi * 3 * np.arange(60) / 60), atol=1e-9)


def test_surrogates_keep_what_they_promise():
    rng = np.random.default_rng(5)
    x = kernels.znorm(np.cumsum(rng.standard_normal((4, 256)), axis=1))
    np.testing.assert_allclose(kernels.power(kernels.phase_surrogate(x, rng)), kernels.power(x), rtol=1e-6, atol=1e-9)
    for f in (kernels.shuffle_surrogate, kernels.iaaft):
        np.testing.assert_allclose(np.sort(f(x, rng), axis=1), np.sort(x, axis=1))
    assert (kernels.surrogate_z(x, kernels.acf1, rng, 20, kernels.shuffle_surrogate) > 3).all()


def test_composer_finds_a_planted_scale():
    rng = np.random.default_rng(6)
    g = np.repeat(np.arange(24), 4)
    y = np.where(g % 2, "a", "b")
    x = rng.standard_normal((96, 2, 64))
    x[:, 1] *= np.where(y == "a", 2.0, 0.5)[:, None]
    e = composer.Measure("raw", 1, "full", "std")
    np.testing.assert_allclose(composer.table(x, [e])[:, 0], x[:, 1].std(axis=1))
    assert composer.null_kind(composer.Relation("ratio", e, e)) == "channel" and composer.null_kind(composer.Measure("diff", 0, "full", "std")) == "shuffle"
    out = composer.compose(x, y, g, budget=12, draws=40)
    assert out["discovery"]["accuracy"] > 0.9
    c = composer.candidates(2, 30)
    assert len(c) == 30 and [composer.cost(q) for q in c] == sorted(composer.cost(q) for q in c) and len({composer.digest(q) for q in c}) == 30
    flat = composer.score(e, x, y, g, draws=10)
    assert flat["smallest_p"].by_draws == 1 / 11 and composer.verdict(flat) == "inconclusive"
    with pytest.raises(ValueError):
        composer.score(e, x, np.where(np.arange(96) % 2, "a", "b"), g, draws=2)
    v = x[:, 0, 32:]
    relation = composer.Relation("ratio", composer.Measure("envelope", 0, "medium", "iqr"), composer.Measure("lag", 1, "short", "meanabs"))
    smooth = np.stack([np.convolve(np.abs(r), [0.5, 0.5], "valid") for r in v])
    lagged = x[:, 1, 48:][:, 8:] - x[:, 1, 48:][:, :-8]
    np.testing.assert_allclose(composer.table(x, [relation])[:, 0], np.subtract(*np.quantile(smooth, [0.9, 0.1], axis=1)) / (np.abs(lagged).mean(axis=1) + 1e-12))
    assert composer.canonical(e) == '{"args":[{"args":[],"op":"view","params":["raw",1,"full"]}],"op":"stat","params":["std"]}'


def test_detrended_and_pooled_columns(spark, data):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(data) if i != 5], "i int, x array<double>")
    got = {r.i: (r.d, r.p) for r in df.select("i", frames.detrended(F.col("x")).alias("d"), frames.mean_pooled(F.col("x"), 4).alias("p")).collect()}
    want, pooled = kernels.znorm(kernels.detrend(data)), kernels.mean_pool(data, 4)
    for i, (d, p) in got.items():
        np.testing.assert_allclose(d, want[i], atol=1e-9)
        np.testing.assert_allclose(p, pooled[i], atol=1e-9)
