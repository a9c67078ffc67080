import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondewerk.functions import learners
from sondewerk.operators import coupling, detector, inference, vectors, watch
from sondewerk.plans import distill, receipts, registry
from sondewerk.sources import simulator
from tests.conftest import rows


# ------------------------------------------------------------------ coupling
def channels(spark, pdf):
    return spark.createDataFrame(pdf)


def test_coupling_keeps_the_real_link_only(spark):
    df = channels(spark, simulator.multimodal())
    names = ["temp", "heat", "acoustic", "vibration", "em", "light"]
    got = {(r.a, r.b): r for r in coupling.couplings(df, names, ["temp"]).collect()}
    live = {k for k, r in got.items() if r.survives}
    assert ("heat", "acoustic") in live and ("vibration", "em") not in live and abs(got["vibration", "em"].raw) > 0.5
    with pytest.raises(ValueError):
        coupling.aligned(df, "t", ["temp"])
    holes = df.withColumn("heat", F.when(F.col("t") % 10 == 0, None).otherwise(F.col("heat")))
    assert coupling.aligned(holes, "t", names).count() == 1800


def test_causal_voters_point_down_the_chain(spark):
    pdf = simulator.logistic_chain(900)
    df = channels(spark, pdf)
    strong = {(r.cause, r.effect): r.score for r in coupling.ccm(df, "t", ["A", "B", "C"]).collect()}
    assert strong["A", "B"] > 0.8 > strong["B", "A"] and strong["B", "C"] > strong["C", "B"]
    cut = {(r.cause, r.effect): r.score for r in coupling.ccm(channels(spark, simulator.logistic_chain(900, bc=0.0)), "t", ["A", "B", "C"]).collect()}
    base = spark.createDataFrame([(*k, v) for k, v in strong.items()], "cause string, effect string, score double")
    now = spark.createDataFrame([(*k, v) for k, v in cut.items()], "cause string, effect string, score double")
    worst = coupling.diagnose(base, now).orderBy(F.desc("drop")).first()
    assert (worst.cause, worst.effect) == ("B", "C")
    assert {r.variable for r in coupling.root_cause(base, now).orderBy(F.desc("score")).limit(2).collect()} == {"B", "C"}
    rise = [r.score for r in coupling.ccm_convergence(df, "t", ["A", "B"], (50, 400)).filter("cause = 'A'").orderBy("library").collect()]
    assert rise[1] > rise[0]
    g = coupling.graph(df, "t", ["A", "B", "C"], libraries=(100, 800))
    assert ("A", "B") in {(r.cause, r.effect) for r in g.collect()}
    assert coupling.consensus(df, "t", ["A", "B"]).filter("cause = 'A'").first().agree


def test_entropy_granger_and_var_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(600)
    y = np.r_[0, 0.8 * x[:-1]] + 0.3 * rng.standard_normal(600)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "t int, x double, y double").repartition(5)
    te = {(r.cause, r.effect): r.score for r in coupling.transfer_entropy(df, "t", ["x", "y"]).collect()}

    def bins(v):
        return np.minimum(7, np.floor((v - v.min()) / (v.max() - v.min()) * 8).astype(int))

    f, p, s = bins(y[1:]), bins(y[:-1]), bins(x[:-1])
    n = len(f)
    want = 0.0
    for i, j, k in set(zip(f, p, s)):
        c = ((f == i) & (p == j) & (s == k)).sum()
        want += c / n * np.log(c * (p == j).sum() / (((p == j) & (s == k)).sum() * ((f == i) & (p == j)).sum()))
    assert np.isclose(te["x", "y"], want) and te["x", "y"] > 3 * te["y", "x"]

    def rss(cols):
        a = np.stack([np.ones(598), *cols], axis=1)
        b, *_ = np.linalg.lstsq(a, y[2:], rcond=None)
        return ((y[2:] - a @ b) ** 2).sum()

    own = [y[1:-1], y[:-2]]
    gr = {(a, b): v for a, b, v in coupling.granger(df, "t", ["x", "y"])}
    assert np.isclose(gr["x", "y"], np.log(rss(own) / rss([*own, x[1:-1], x[:-2]])), atol=1e-8)
    var = {(a, b): v for a, b, v in coupling.var_edges(df, "t", ["x", "y"])}
    assert abs(var["x", "y"] - 0.8) < 0.05 and var["y", "x"] < 0.1
    assert coupling.localize(df, "t", ["x", "y"]).orderBy("place").first().variable == "x"


def test_source_of_a_fault_in_random_trees(spark):
    hits = 0
    for seed in range(6):
        pdf = simulator.feed_forward(4, True, seed)
        names = [c for c in pdf.columns if c != "t"]
        hits += "v0" in [r.variable for r in coupling.localize(channels(spark, pdf), "t", names).orderBy("place").limit(3).collect()]
    assert hits >= 5


# ------------------------------------------------------------------ detector
def test_detector_fit_calibrate_decide(spark):
    bank = simulator.ar1_bank(spark)
    from sondewerk.functions import series

    f = bank.select("g", "label", series.acf1(F.col("x")).alias("a"), series.zcr(F.col("x")).alias("z"), F.lit(1.0).alias("flat"))
    healthy = f.filter("label = 'normal' and g < 10")
    det = detector.RobustDetector.fit(healthy, ["a", "z", "flat"])
    assert det.degenerate == [False, False, True]
    held = f.filter("g >= 10").withColumn("score", det.score()).withColumn("odd", F.col("label") == "anomaly")
    assert rows(held.select(det.decide(F.col("score")).alias("d")).distinct()) == [("REFUSED",)]
    out = det.calibrate(held, "score", "odd", "g", 300)
    assert out["identified"] and out["sign"] == 1 and out["n_anchors"] == 30
    verdicts = held.groupBy("odd", det.decide(F.col("score")).alias("d")).count().collect()
    assert sum(r["count"] for r in verdicts if r.odd and r.d == "ALARM") > 100
    assert detector.RobustDetector.from_json(det.to_json()) == det
    with pytest.raises(ValueError):
        detector.RobustDetector.from_json(det.to_json().replace('"direction": 1', '"direction": 3'))
    assert not det.calibrate(held.limit(3), "score", "odd", "g")["identified"]
    assert rows(det.drivers(held))
    assert detector.guess_healthy(["fault_a", "Normal"]) == "Normal" and detector.guess_healthy(["x", "bad"]) == "x" and detector.guess_healthy(["x", "y"]) is None


def test_severity_and_stream_score(spark):
    df = spark.createDataFrame([(1.0, 5.0), (4.0, 5.0), (8.0, 1.0), (None, 5.0)], "s double, e double")
    assert [r[0] for r in df.select(detector.severity(F.col("s"))).collect()] == ["ok", "warn", "alarm", None]
    c = detector.stream_score(F.col("s"), F.col("e"), 1.0, 0.0, 4.0, 0.5)
    assert df.select(c["score"].alias("v")).collect()[2].v == 7.0


def test_reconstruction_scores_what_it_has_not_seen(spark):
    rng = np.random.default_rng(1)
    basis = rng.standard_normal((3, 20))
    x = rng.standard_normal((500, 3)) @ basis + 0.01 * rng.standard_normal((500, 20))
    m = detector.Reconstruction.fit(spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(4), "x", 3)
    assert m.embed(rng.standard_normal((50, 20)))[1].min() > 20 * m.embed(x)[1].max()


# ------------------------------------------------------------------ vectors, watch
def test_point_store(spark):
    t = spark.createDataFrame([(1, 5, 1, "a"), (2, 5, 1, "b")], "node_id int, seq int, v int, x string")
    n = spark.createDataFrame([(1, 5, 2, "c"), (2, 5, 1, "d"), (3, 1, None, "e")], "node_id int, seq int, v int, x string")
    assert rows(vectors.upsert(t, n, ["node_id", "seq"], "v").select("node_id", "x")) == [(1, "c"), (2, "d"), (3, "e")]
    assert t.select(vectors.point_id(F.col("node_id"), F.col("seq"))).first()[0] == (1 << 32) + 5
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    vectors.BLOCK, keep = 70, vectors.BLOCK
    try:
        got = {r.i: r.novelty for r in vectors.novelty(df.filter("i < 20"), df, "i", "v", 5, 0.99999).collect()}
    finally:
        vectors.BLOCK = keep
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(20):
        s = np.sort(np.delete(u @ u[i], i))[-5:]
        assert np.isclose(got[i], 1 - s.mean())
    assert rows(vectors.novelty(df.limit(1), df.limit(0), "i", "v"))[0][1] == 1.0
    assert vectors.project_2d(df, "i", "v").count() == 300 and vectors.project_2d(df.limit(2), "i", "v").count() == 0


def test_watch_helpers(spark):
    p = spark.createDataFrame([("/a/b/normal_01.npy",)], "p string")
    assert tuple(p.select(*[watch.label_from_path(F.col("p"), r).alias(r) for r in ("prefix", "stem", "parent")]).first()) == ("normal", "normal_01", "b")
    e = spark.createDataFrame([(t,) for t in (0, 5, 6, 7, 20)], "t int")
    assert tuple(watch.densest_span(e, "t", 3).first()) == (5, 2)
    y = spark.createDataFrame([("Normal",), ("abNORMAL",), (None,), ("x",)], "y string")
    assert [r[0] for r in y.select(watch.label_contains(F.col("y"), "normal")).collect()] == [True, True, False, False]


# ------------------------------------------------------------------ learners, dynamics
def test_learners_and_folds():
    rng = np.random.default_rng(3)
    g = np.repeat(np.arange(16), 12)
    y = np.where(g % 2, "a", "b")
    x = rng.standard_normal((len(g), 6))
    x[:, 2] += (y == "a") * 3
    for model in (lambda: learners.Forest(20), learners.Logistic):
        assert np.mean(list(learners.logo(x, y, g, model).values())) > 0.85
    assert learners.anova_order(x, y, g)[0] == 2
    right, n, cols = learners.nested_fold(x, y, g, 3, learners.Logistic, candidates=6)
    assert n == 12 and right > 8 and 2 in cols
    noise = rng.permutation(np.where(np.arange(16) % 2, "a", "b"))[g]
    assert np.mean(list(learners.logo(x[:, :2], noise, g, learners.Logistic).values())) < 0.75
    folds = learners.group_folds(g, 4)
    assert sum(f.sum() for f in folds) == len(g) and all(len(set(g[f]) & set(g[~f])) == 0 for f in folds)
    plan = learners.discovery_split(learners.group_labels(g, y), 0)
    assert plan.usable and len(plan.discovery) == 10 and sorted([*plan.discovery, *plan.replication]) == list(range(16))
    assert inference.smallest_p(["a", "a", "b", "b"], 9) == (0.1, pytest.approx(1 / 3), pytest.approx(0.4))
    c = learners.kmeans(x[:, [2]], 2)
    assert learners.adjusted_rand(c, (y == "a").astype(int)) > 0.4 and learners.silhouette(x[:40, [2]], c[:40]) > 0.2


def test_dynamics_are_recovered():
    orbit = simulator.simulate("lorenz", np.array([-8.0, 7.0, 27.0]), 4000, 0.002)
    xi, names = learners.sindy(orbit, 0.002, 0.1)
    truth = {(0, "x0"): -10, (0, "x1"): 10, (1, "x0"): 28, (1, "x0*x2"): -1, (1, "x1"): -1, (2, "x0*x1"): 1, (2, "x2"): -8 / 3}
    assert learners.terms_match(names, xi, truth)
    assert not learners.terms_match(names, xi, truth | {(2, "x0"): 5.0})
    assert np.abs(learners.run_ode(xi, orbit[0], 100, 0.002) - orbit[:100]).max() < 0.1
    t = np.arange(1200)
    x = np.sin(t / 9) + 0.5 * np.cos(t / 4)
    assert learners.r2(x[1000:1050], learners.havok_forecast(x[:1000], 50, 60, 6)) > 0.99
    assert learners.multistart(lambda h, n: learners.havok_forecast(h, n, 60, 6), x, 3)["r2_min"] > 0.9
    s = learners.reservoir(x, 50)
    w = np.linalg.lstsq(s[100:900], x[101:901], rcond=None)[0]
    assert learners.r2(x[901:1101], s[900:1100] @ w) > 0.95
    assert learners.attractor_distance(x, x)["wasserstein"] == 0
    rng = np.random.default_rng(0)
    e = rng.standard_normal(400)
    slow = np.zeros(400)
    for i in range(1, 400):
        slow[i] = (0.95 * i / 400) * slow[i - 1] + e[i]
    assert learners.slowing_trend(slow)[0] > 0.5


def test_distill_on_planted_and_random_labels(spark):
    rng = np.random.default_rng(4)
    data = []
    for g in range(12):
        for k in range(6):
            x = rng.standard_normal(128) + (np.sin(np.arange(128) * 0.9) * 2 if g % 2 else 0)
            data.append((g * 10 + k, g, "a" if g % 2 else "b", x.tolist()))
    df = spark.createDataFrame(data, "window_id int, g int, y string, x array<double>")
    from sondewerk.functions import grammar

    few = grammar.catalogue()[:40]
    r = distill.distill(df, permutations=19, trees=10, programs=few)
    assert r["verdict"] == "INCLUDED" and r["nested"] > 0.85 and r["p"] <= 0.05
    assert "Verdict: INCLUDED" in distill.report(r) and receipts.report_numbers(distill.report(r))["recordings"] == 12
    with pytest.raises(ValueError):
        distill.distill(df.filter("y = 'a'"), programs=few)


# ------------------------------------------------------------------ receipts, registry
def test_receipts_sign_verify_and_refuse(tmp_path):
    secret = receipts.key(tmp_path / "k" / "key")
    assert receipts.key(tmp_path / "k" / "key") == secret and (tmp_path / "k" / "key").stat().st_mode & 0o777 == 0o600
    r = receipts.signed(receipts.build("claim", "PASS", {"auc": 0.9, "bad": float("nan"), ("a", "b"): {2, 1}}, {"x": "00"}), secret)
    assert receipts.problems(r) == [] and r["evidence"] == {"auc": 0.9, "bad": None, "a->b": [1, 2]}
    assert receipts.problems(r, r["pubkey"].upper()) == [] and receipts.problems(r, "00" * 32) == ["not signed by the pinned key"]
    assert receipts.problems(r | {"claim": "other"}) == ["the signature does not fit the body"]
    assert receipts.problems({}) and receipts.problems(r | {"claim": 3}) == ["field claim is no str"]
    bad = receipts.signed(receipts.build("c", "REFUSED", {"deploy_spec": 1, "x": [{"verdict": "PASS"}], "provenance": {"mode": "archive_signature"}}, {}), secret)
    assert len(receipts.problems(bad)) == 5
    text = json.dumps(r)
    assert receipts.load_strict(text.encode()) == r and receipts.unchanged(r, r | {"created_at": "x"})
    for broken in ('{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1e999}', '{"a": 9007199254740993}', '{"a": "\\ud800"}', "[1]", "[" * 5000, '{"a":' * 70 + "1" + "}" * 70, b"\xff"):
        with pytest.raises(receipts.ReceiptError):
            receipts.load_strict(broken)
    with pytest.raises(ValueError):
        receipts.build("c", "MAYBE", {}, {})
    m1, m2 = (receipts.manifest({}, "ccm", {}, 0, i) for i in ({"a": [1], "b": [2]}, {"b": [2], "a": [1]}))
    assert m1 == m2
    assert receipts.traction([r, bad])["receipts"] == 2 and receipts.merge_series({"b": 1, "a": 1}, {"b": 2}) == {"a": 1, "b": 2}


def test_signatures_of_the_standard():
    secret = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert receipts.public_key(secret).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    s = receipts.sign(secret, b"")
    assert s.hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bac")
    assert receipts.verify(receipts.public_key(secret), b"", s) and not receipts.verify(receipts.public_key(secret), b"x", s)


def test_ledger_chain(tmp_path):
    led = receipts.Ledger(tmp_path / "l.jsonl")
    assert led.broken_at() is None
    for i in range(3):
        led.append("bank", {"i": i})
    assert led.broken_at() is None
    lines = led.path.read_text().splitlines()
    led.path.write_text("\n".join([lines[0], lines[1].replace('"i": 1', '"i": 7'), lines[2]]) + "\n")
    assert led.broken_at() == 1
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f").write_text("x")
    assert receipts.hash_folder(tmp_path / "d") != receipts.hash_folder(tmp_path)


def test_registry_profile_and_routing(spark, tmp_path):
    with pytest.raises(KeyError):
        registry.get("sink", "nowhere")
    assert "fft" in registry.available("transform")
    f = simulator.frames(spark, 40)
    seen = []
    out = registry.pipeline(f.select("node_id", "seq", "payload"), lambda d: registry.get("transform", "fft")(d, 16), lambda d: d.withColumn("score", F.col("energy_rms")), [lambda d, e: seen.append(d.count())], 10)
    assert seen == [10] and out.count() == 10
    w = simulator.ar1_bank(spark, 3, 0, length=64)
    p = registry.profile(w, "s", "d", "u")
    assert p.metrics["recordings"] == 3 and p.metrics["samples_per_window"] == 64
    fit, why = registry.route(p)
    assert fit == ["time_domain", "spectral"] and set(why) == {"envelope", "recurrence", "coherence", "causal_lag"}
    m = registry.route_methods(p, [registry.Method("a", "f", cost="high"), registry.Method("b", "f", cost="low"), registry.Method("c", "f", requires={"channels": 2})])
    assert m["eligible"] == ["b", "a"] and list(m["excluded"]) == ["c"]
    with pytest.raises(ValueError):
        registry.Method("x", "f", requires={"moon": 1})
    q = registry.Qualifications()
    assert q.status(p) == "new_source"
    q.add(p, {"spectral": "r"})
    q.save(tmp_path / "q.json")
    q = registry.Qualifications.load(tmp_path / "q.json")
    assert q.status(p) == "confirmed" and q.status(registry.Profile("s", "d2", "u", {})) == "qualification_required"


def test_reports_of_points(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from sondewerk.operators import inference
    from sondewerk.plans import serve

    pts = spark.createDataFrame([(i, i % 3, float(i % 7) if i else None, [float(i), float(i * i % 11)]) for i in range(20)], "emb_id bigint, node_id bigint, score double, vector array<double>").cache()
    server = serve.serve(pts, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda p: json.loads(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/{p}").read())
    assert get("health") == {"status": "ok", "points": 20}
    assert [r["emb_id"] for r in get("anomalies?limit=2")] == [6, 13] and "vector" not in get("anomalies")[0]
    assert len(get("node/1")) == 7 and len(get("map")) == 20
    for bad, code in (("nothing", 404), ("node/x", 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(bad)
        assert e.value.code == code
    server.shutdown()
    serve.write_html(vectors.project_2d(pts, "emb_id", "vector"), tmp_path / "m.html", "emb_id")
    assert "canvas" in (tmp_path / "m.html").read_text()
    assert sorted(r.emb_id for r in serve.flag_top(pts, "score", "emb_id", 0.15).filter("flagged").collect()) == [5, 6, 13]
    d = spark.createDataFrame([("a", 1), ("b", 1), ("c", -1), ("d", None)], "n string, s int")
    assert tuple(inference.transfer_rate(d, "n", "s").first()) == (6, 2, 1 / 3)


def test_node_map_and_page_hold_every_point(spark, tmp_path):
    import threading
    import urllib.request

    from sondewerk.plans import serve

    n = 1_500
    pts = spark.createDataFrame([(i, 7, 0.5, [float(i % 50), float(i // 50)]) for i in range(n)], "emb_id bigint, node_id bigint, score double, vector array<double>").cache()
    server = serve.serve(pts, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda p: json.loads(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/{p}").read())
    assert [r["emb_id"] for r in get("node/7")] == list(range(n)) == [r["emb_id"] for r in get("map")]
    assert get("node/8") == [] and len(get("anomalies?limit=5000")) == serve.MOST
    server.shutdown()
    mapped = pts.selectExpr("emb_id", "vector[0] as x", "vector[1] as y", "emb_id = 1499 as flagged")
    serve.write_html(mapped.unionByName(mapped.limit(3)), tmp_path / "m.html", "emb_id")
    cells = json.loads((tmp_path / "m.html").read_text().split("const d=")[1].split(";const g")[0])
    assert sorted(c[0] for c in cells) == list(range(n)) and sum(c[3] for c in cells) == n + 3
    assert [c[0] for c in cells if c[4]] == [1499] and cells[-1][:3] == [1499, 790, 590]
    serve.write_html(mapped.limit(0), tmp_path / "e.html", "emb_id")


def test_folds_rank_every_program_without_the_held_out_recording():
    rng = np.random.default_rng(3)
    label = np.array(["a", "b"] * 6)
    means = rng.standard_normal((12, 400))
    # tells the labels apart but for one recording, so that a ranking over all recordings has it far behind
    means[:, 7] = (label == "a") * 5 + 0.1 * rng.standard_normal(12)
    means[4, 7] = -400
    everywhere = list(learners.anova_order(means, label, np.arange(12)))
    assert everywhere.index(7) >= 3 * 40
    orders = distill.fold_orders(means, label, 40)
    assert [o[0] == 7 for o in orders] == [r == 4 for r in range(12)] and {len(o) for o in orders} == {40}


def test_calibration_refuses_what_it_cannot_hold(spark, monkeypatch):
    from sondewerk.operators import detector

    units = spark.createDataFrame([(i, float(i), i >= 5) for i in range(10)], "g int, score double, odd boolean")
    det = detector.RobustDetector(["score"], [0.0], [1.0])
    monkeypatch.setattr(detector, "MAX_UNITS", 10)
    assert det.calibrate(units, "score", "odd", "g")["n_anchors"] == 10 and det.cut == 5.0
    monkeypatch.setattr(detector, "MAX_UNITS", 9)
    with pytest.raises(ValueError):
        det.calibrate(units, "score", "odd", "g")
    # the cut of many units needs no table of units times cuts
    score, label = np.arange(200_000.0), np.arange(200_000) >= 150_000
    assert detector.youden_cut(score, label.astype(int), 1) == 150_000 and detector.youden_cut(-score, label.astype(int), -1) == -150_000
