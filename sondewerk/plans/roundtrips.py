"""Queries of readers, sinks, receipts, routing and small tests: what goes out comes back, and what SQL can count is counted."""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondewerk.functions import kernels, learners
from sondewerk.operators import frames, inference
from sondewerk.plans import receipts, registry
from sondewerk.plans.analytics import query
from sondewerk.plans.grammar import BASE, whole_windows
from sondewerk.plans.problems import table
from sondewerk.sources import readers
from sondewerk.streaming import sinks
from sondewerk.util import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def checked(sql: str | None = None) -> Callable:
    return query(sql, QUERIES, ORACLES)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sondewerk-{uuid.uuid4().hex}"


_WHOLE = "from frames where payload is not null and len(payload) > 0"


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "frames").filter("payload is not null and size(payload) > 0").select("delivery_id", "payload", F.coalesce("sr_hz", F.lit(1)).alias("rate"))


def _read_back(df: DataFrame, kind: str) -> DataFrame:
    """delivery_id, n, total, rate of payloads written as files of a kind and read by its reader, in batches."""
    wav, recording, npz_bank, text_column, channels_of = readers.wav, readers.recording, readers.npz_bank, readers.text_column, readers.channels_of

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, x, rate in zip(b["delivery_id"], b["payload"], b["rate"]):
                got_rate = rate
                if kind == "wav":
                    data = np.asarray(x, "<i2").tobytes()
                    content = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data
                    got_rate, v = wav(content)
                elif kind == "npy":
                    f = io.BytesIO()
                    np.save(f, np.asarray(x))
                    v = recording(f.getvalue(), "npy")
                elif kind == "npz":
                    f = io.BytesIO()
                    np.savez(f, X=np.asarray(x)[:, None], y=np.zeros(len(x)), groups=np.arange(len(x)))
                    v = npz_bank(f.getvalue())[0][:, 0]
                elif kind == "csv":
                    v = text_column(("value;other\r\n" + "".join(f"{s};x\r\n" for s in x)).encode("utf-8-sig"))
                else:
                    f = io.BytesIO()
                    np.save(f, np.stack([np.asarray(x), -np.asarray(x, int)]))
                    v = channels_of(f.getvalue(), "npy", 0)[1][1] * -1
                out.append((i, len(v), float(v.sum()), int(got_rate)))
            yield pd.DataFrame(out, columns=["delivery_id", "n", "total", "rate"])

    return df.mapInPandas(run, "delivery_id bigint, n bigint, total double, rate bigint")


def _file_query(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _read_back(_payloads(spark, sf_dir), kind)

    run.__name__ = f"read_{kind}"
    run.__doc__ = f"Every payload written as {kind} and read back."
    return run


for _kind in ("wav", "npy", "npz", "csv", "channels"):
    checked(f"select delivery_id, len(payload) as n, list_sum(payload)::double as total, coalesce(sr_hz, 1) as rate {_WHOLE}")(_file_query(_kind))


@checked("select node_id, count(*) as frames, sum(list_sum(payload))::bigint as total, min(ts_us) as first_us, true as numbered from frames where payload is not null and len(payload) > 0 and node_id is not null and ts_us is not null group by 1")
def read_replayed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame dataset written per node and replayed: samples and recorded times are those written, seq numbers them without a gap."""
    path = _folder(spark)
    f = table(spark, sf_dir, "frames").filter("payload is not null and size(payload) > 0 and node_id is not null and ts_us is not null")
    wire = frames.encode(F.lit(0), F.lit(0), F.lit(0), F.lit(1), F.col("payload"))
    samples = F.substring(wire, frames.HEADER_BYTES + 1, F.size("payload") * 2)
    f.select(F.col("node_id").cast("string").alias("label"), F.lit(0).alias("sensor_class"), F.lit(1).cast("bigint").alias("sr_hz"), "ts_us", samples.alias("samples")).write.parquet(path)
    back = readers.read_frames(spark, path)
    total = F.aggregate("payload", F.lit(0).cast("bigint"), lambda a, x: a + x)
    per = back.groupBy(F.col("label").cast("bigint").alias("node_id")).agg(F.count("*").alias("frames"), F.sum(total).alias("total"), F.min("ts_us").alias("first_us"))
    whole = back.agg((F.count_distinct("seq") == F.count("*")).alias("a"), (F.max("seq") == F.count("*") - 1).alias("b")).first()
    return per.withColumn("numbered", F.lit(bool(whole["a"] and whole["b"])))


@checked("select case when n < 28 then 'short' when n % 3 = 0 then 'version' when n % 3 = 1 then 'payload' end as error, count(*) as n from (select delivery_id % 60 as n from frames where delivery_id is not null) where n < 28 or n % 3 < 2 group by 1")
def read_bad_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broker messages of which many are cut or of another version: every one is told apart."""
    head = frames.encode(F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.array(*[F.lit(x).cast("smallint") for x in range(16)]))
    kind = F.col("delivery_id") % 60
    value = F.when(kind < 28, F.substring(head, F.lit(1), kind.cast("int"))).when(kind % 3 == 0, F.concat(F.substring(head, 1, 2), F.unhex(F.lit("09")), F.substring(head, 4, 99))).when(kind % 3 == 1, F.substring(head, 1, 40)).otherwise(head)
    rows = table(spark, sf_dir, "frames").filter("delivery_id is not null").select(value.alias("value"))
    good, bad = readers.parse_mqtt_rows(rows)
    return bad.groupBy("error").agg(F.count("*").alias("n"))


@checked("select count(*) as good, sum(s)::bigint as samples from (select 16 as s from frames where delivery_id is not null and delivery_id % 60 >= 28 and delivery_id % 60 % 3 = 2)")
def read_good_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broker messages that are whole."""
    head = frames.encode(F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.array(*[F.lit(x).cast("smallint") for x in range(16)]))
    kind = F.col("delivery_id") % 60
    rows = table(spark, sf_dir, "frames").filter("delivery_id is not null").select(F.when((kind >= 28) & (kind % 3 == 2), head).otherwise(F.substring(head, 1, 27)).alias("value"))
    return readers.parse_mqtt_rows(rows)[0].agg(F.count("*").alias("good"), F.sum(F.size("payload")).cast("bigint").alias("samples"))


def _batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    e = table(spark, sf_dir, "frame_embeddings").filter("node_id is not null and seq is not null").select("node_id", "seq", "ts_us", F.col("energy_rms").alias("energy"), F.col("z_energy").alias("energy_z"), "emb_id")
    return [e.filter("emb_id % 2 = 0"), e.filter("emb_id % 2 = 1"), e.limit(0)]


@checked("select emb_id % 2 as epoch, count(*) as n from frame_embeddings where node_id is not null and seq is not null group by 1")
def sink_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches in the Parquet sink, one of them delivered again: each epoch is there once."""
    path = _folder(spark)
    write = sinks.parquet(path)
    even, odd, none = _batches(spark, sf_dir)
    for epoch, batch in ((0, even), (1, odd), (0, even), (2, none)):
        write(batch, epoch)
    return spark.read.parquet(path).groupBy(F.col("epoch").cast("bigint").alias("epoch")).agg(F.count("*").alias("n"))


@checked("""with e as (select node_id * 4294967296 + seq % 4294967296 as point_id, emb_id, ts_us from frame_embeddings where node_id is not null and seq is not null),
r as (select point_id, ts_us, row_number() over (partition by point_id order by ts_us desc nulls last) as rn from e) select point_id, ts_us from r where rn = 1""")
def sink_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches in the keyed sink, one of them delivered again: the newest row of every point."""
    path = _folder(spark)
    write = sinks.points(path)
    even, odd, _ = _batches(spark, sf_dir)
    for epoch, batch in ((0, even), (1, odd), (1, odd)):
        write(batch, epoch)
    return sinks.read_points(spark, path).select("point_id", "ts_us")


@checked("select count(*) as n, count(distinct node_id) as nodes from frame_embeddings where node_id is not null and seq is not null and ts_us is not null and (energy_rms is not null or z_energy is not null)")
def sink_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line protocol written as text and read again."""
    path = _folder(spark)
    even, odd, _ = _batches(spark, sf_dir)
    for epoch, batch in ((0, even), (1, odd)):
        sinks.lines(path)(batch.filter("ts_us is not null and (energy is not null or energy_z is not null)"), epoch)
    lines = spark.read.text(path).filter("value like 'signal,node=%'")
    return lines.agg(F.count("*").alias("n"), F.count_distinct(F.regexp_extract("value", "node=([0-9-]+)", 1)).alias("nodes"))


# ------------------------------------------------------------------ receipts, routing
@checked("""with b as (select bank, count(*) as n from bank_windows where bank is not null group by 1)
select bank, sha256('{"claim":"windows of ' || bank || '","countersignatures":[],"created_at":"2025-01-01T00:00:00Z","evidence":{"bank":"' || bank || '","windows":' || n || '},"input_hashes":{},"schema":"sondewerk.receipt/1","tool":"sondewerk","tool_version":"0.1.0","verdict":"PASS"}') as body, true as whole, 'the signature does not fit the body' as forged from b""")
def receipt_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt per bank: the digest of its canonical body, that it verifies, and what a changed claim is told."""
    counts = table(spark, sf_dir, "bank_windows").filter("bank is not null").groupBy("bank").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        from datetime import UTC, datetime

        for b in batches:
            out = []
            for bank, n in zip(b["bank"], b["n"]):
                body = receipts.build(f"windows of {bank}", "PASS", {"bank": bank, "windows": int(n)}, {}, now=datetime(2025, 1, 1, tzinfo=UTC))
                full = receipts.signed(body, hashlib.sha256(bank.encode()).digest())
                out.append((bank, hashlib.sha256(receipts.canonical(body)).hexdigest(), receipts.problems(full, full["pubkey"]) == [], "; ".join(receipts.problems(full | {"claim": "other"}))))
            yield pd.DataFrame(out, columns=["bank", "body", "whole", "forged"])

    return counts.mapInPandas(run, "bank string, body string, whole boolean, forged string")


@checked("select * from (values ('duplicate key', true), ('not finite', true), ('deep', true), ('huge integer', true), ('surrogate', true), ('list', true), ('plain', false)) t(document, refused)")
def receipt_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that mean different things in different JSON hosts are refused."""
    documents = {"duplicate key": '{"a":1,"a":2}', "not finite": '{"a":NaN}', "deep": '{"a":' + "[" * 80 + "]" * 80 + "}", "huge integer": '{"a":9007199254740993}', "surrogate": '{"a":"\\ud800"}', "list": "[1]", "plain": '{"a":[1,{"b":null}]}'}

    def refused(text: str) -> bool:
        try:
            receipts.load_strict(text)
        except receipts.ReceiptError:
            return True
        return False

    return spark.createDataFrame([(k, refused(v)) for k, v in documents.items()], "document string, refused boolean")


@checked("select 'transform' as kind, 'fft' as name union all select 'missing', 'refused'")
def plugin_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered transforms, and that an unknown one is refused."""
    try:
        registry.get("transform", "none")
        missing = "found"
    except KeyError:
        missing = "refused"
    return spark.createDataFrame([("transform", n) for n in registry.available("transform")] + [("missing", missing)], "kind string, name string")


@checked("""with w as (select window_id, g, windows from bank_windows where windows is not null and len(windows) > 0 and len(list_filter(windows, lambda v: v is null or isnan(v))) = 0 and g is not null),
p as (select count(distinct g) as recs, quantile_cont(len(windows), 0.5) as samples from w)
select family, recs >= r and samples >= n and c <= 1 as fit from p, (values ('time_domain', 16, 1, 1), ('spectral', 64, 1, 1), ('envelope', 128, 1, 1), ('recurrence', 128, 1, 1), ('coherence', 0, 2, 1), ('causal_lag', 0, 2, 2)) f(family, n, c, r)""")
def method_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which method families the bank's profile allows."""
    p = registry.profile(whole_windows(spark, sf_dir).filter("g is not null"), "bank", "all", "test")
    fit, reasons = registry.route(p)
    return spark.createDataFrame([(f, True) for f in fit] + [(f, False) for f in reasons], "family string, fit boolean")


@checked("""with p as (select count(distinct g) as recs from bank_windows where windows is not null and len(windows) > 0 and len(list_filter(windows, lambda v: v is null or isnan(v))) = 0 and g is not null),
m as (select * from (values ('cheap', 0, 1), ('plain', 1, 1), ('late', 1, 1000000000)) m(method, cost, need)), f as (select method, row_number() over (order by cost, method) - 1 as place from m, p where recs >= need)
select method, place, case when place is null then 'requires min_recordings >= 1e+09' end as reason from m left join f using (method)""")
def method_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that fit the bank's profile by cost, the others with their reason."""
    p = registry.profile(whole_windows(spark, sf_dir).filter("g is not null"), "bank", "all", "test")
    r = registry.route_methods(p, [registry.Method("plain", "spectral", requires={"min_recordings": 1}, cost="medium"), registry.Method("late", "spectral", requires={"min_recordings": 10**9}, cost="medium"), registry.Method("cheap", "time_domain", cost="low")])
    rows = [(m, r["priorities"][m], None) for m in r["eligible"]] + [(m, None, why) for m, why in r["excluded"].items()]
    return spark.createDataFrame(rows, "method string, place bigint, reason string")


# ------------------------------------------------------------------ splits and small tests
@checked("""with l as (select distinct g, lower(y) as y from recordings where g is not null and y is not null),
r as (select g, y, row_number() over (partition by y order by md5('3/' || g)) as rn, count(*) over (partition by y) as n from l)
select g, rn <= greatest(1, least(round_even(0.6 * n, 0), greatest(n - 1, 1))) as searched from r""")
def discovery_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recordings that a search may see and those kept for confirmation; labels are few, groups fit on the driver as in distillation."""
    known = table(spark, sf_dir, "recordings").filter("g is not null and y is not null").select("g", F.lower("y").alias("y")).distinct().toPandas()
    plan = learners.discovery_split(learners.group_labels(known["g"].to_numpy(), known["y"].to_numpy()), 3)
    return spark.createDataFrame([(int(g), True) for g in plan.discovery] + [(int(g), False) for g in plan.replication], "g bigint, searched boolean")


@checked("""with n as (select lower(y) as y, count(*) as n from recordings where y is not null group by 1), k as (select count(*) as k, sum(n) as n, sum(lgamma(n + 1)) as l from n)
select round(1 / 201.0, 9) as by_draws, round(exp(least(0, lgamma(k + 1) + l - lgamma(n + 1))), 9) as by_design, round((1 + 200 * exp(least(0, lgamma(k + 1) + l - lgamma(n + 1)))) / 201, 9) as expected from k""")
def permutation_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least p that a permutation of the recordings' labels can report; counts per label suffice."""
    labels = [r["y"] for r in table(spark, sf_dir, "recordings").filter("y is not null").groupBy(F.lower("y").alias("y")).count().collect() for _ in range(r["count"])]
    return spark.createDataFrame([tuple(round(v, 9) for v in inference.smallest_p(labels, 200))], "by_draws double, by_design double, expected double")


@checked("""with d as (select bank, sign(avg((lower(y) = 'anomaly')::int) - 0.5)::int as direction from recordings where y is not null and bank is not null group by 1),
c as (select direction, count(*) as n from d where direction is not null group by 1) select (sum(n) * (sum(n) - 1))::bigint as pairs, sum(n * (n - 1))::bigint as hits, round(sum(n * (n - 1)) / nullif(sum(n) * (sum(n) - 1), 0), 9) as rate from c""")
def transfer_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two banks lean to the same label."""
    lean = table(spark, sf_dir, "recordings").filter("y is not null and bank is not null").groupBy("bank").agg(F.signum(F.avg((F.lower("y") == "anomaly").cast("int")) - 0.5).cast("int").alias("direction"))
    t = inference.transfer_rate(lean, "bank", "direction")
    return t.select(F.col("pairs").cast("bigint").alias("pairs"), F.col("hits").cast("bigint").alias("hits"), F.round("rate", 9).alias("rate"))


_DIFF = "with m as (select g, avg(case when k % 2 = 0 then list_avg(windows) end) - avg(case when k % 2 = 1 then list_avg(windows) end) as d from bank_windows where windows is not null and g is not null and len(list_filter(windows, lambda v: v is null or isnan(v))) = 0 group by 1), s as (select count(*) filter (where d > 0) as up, count(*) filter (where d <> 0) as n from m where d is not null)"


@checked(_DIFF + " select up, n, round(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))), 9) as p from s, range(0, 100000) r(i) where i between up and n group by up, n")
def paired_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sign test of even against odd windows over recordings."""
    w = whole_windows(spark, sf_dir).filter("g is not null").join(table(spark, sf_dir, "bank_windows").select("window_id", "k"), "window_id")
    level = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    half = lambda odd: w.filter(F.col("k") % 2 == odd).groupBy("g").agg(F.avg(level).alias("v"))
    d = inference.paired(half(0), half(1), "g", "v").filter("difference <> 0")
    c = d.agg(F.count_if(F.col("difference") > 0).alias("up"), F.count("*").alias("n")).first()
    p = inference.sign_test([1.0] * c["up"] + [-1.0] * (c["n"] - c["up"]))
    return spark.createDataFrame([(c["up"], c["n"], round(p, 9))], "up bigint, n bigint, p double")


@checked("select emb_id, round(2 / pi() * atan(score), 9) as auc from frame_embeddings where score is not null and isfinite(score)")
def predicted_aucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AUC that a standardised distance predicts, as a column."""
    e = table(spark, sf_dir, "frame_embeddings").filter("score is not null and not isnan(score) and abs(score) < double('Infinity')")
    return e.select("emb_id", F.round(inference.predicted_auc(F.col("score")), 9).alias("auc"))


# ------------------------------------------------------------------ window kernels
@checked(BASE + ", r as (select window_id, i, sqrt(avg(v * v) over (partition by window_id order by i rows between current row and 15 following)) as e, count(*) over (partition by window_id order by i rows between current row and 15 following) as n from s) select window_id, count(*) as n, round(sum(e), 5) as total, round(max(e), 5) as top from r where n = 16 and i % 8 = 0 group by 1")
def window_rolling_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling energy of windows, spans of 16 every 8 samples."""
    w = whole_windows(spark, sf_dir).filter("size(x) >= 16")
    kernel = lambda x: np.stack([np.full(len(x), float(kernels.rolling_rms(x, 16, 8).shape[1])), kernels.rolling_rms(x, 16, 8).sum(axis=1), kernels.rolling_rms(x, 16, 8).max(axis=1)], axis=1)
    out = frames.map_series(w, ["window_id"], "x", kernel, ["n", "total", "top"])
    return out.select("window_id", F.col("n").cast("bigint").alias("n"), F.round("total", 5).alias("total"), F.round("top", 5).alias("top"))


@checked(BASE + """, n as (select window_id, count(*) as n from s group by 1), c as (select s.window_id, k, sum(v * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) * cos(2 * pi() * i * k / n)) as re, sum(v * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) * sin(2 * pi() * i * k / n)) as im from s join n using (window_id), range(0, 33) r(k) where n = 64 group by all)
select window_id, round(sum(ln(1 + sqrt(re * re + im * im))) / sqrt(sum(ln(1 + sqrt(re * re + im * im)) ** 2)), 5) as total, round(max(ln(1 + sqrt(re * re + im * im))) / sqrt(sum(ln(1 + sqrt(re * re + im * im)) ** 2)), 5) as top from c group by 1""")
def window_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit log spectrum of every window of 64 samples: its sum and its peak."""
    w = whole_windows(spark, sf_dir).filter("size(x) = 64")

    def kernel(x: np.ndarray) -> np.ndarray:
        mag = kernels.spectral_shape(x, 33)[0]
        return np.stack([mag.sum(axis=1), mag.max(axis=1)], axis=1)

    out = frames.map_series(w, ["window_id"], "x", kernel, ["total", "top"])
    return out.select("window_id", F.round("total", 5).alias("total"), F.round("top", 5).alias("top"))


def _kept(surrogate: Callable, spectrum: bool) -> Callable[[np.ndarray], np.ndarray]:
    def kernel(x: np.ndarray) -> np.ndarray:
        y = surrogate(x, np.random.default_rng(5))
        a, b = (kernels.power(x), kernels.power(y)) if spectrum else (np.sort(x, axis=1), np.sort(y, axis=1))
        same = np.abs(a - b).max(axis=1) <= 1e-6 * np.abs(a).max(axis=1) + 1e-12
        return np.stack([same, np.abs(x - y).max(axis=1) > 0], axis=1).astype(float)

    return kernel


def _surrogate_query(name: str, surrogate: Callable, spectrum: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = whole_windows(spark, sf_dir).filter("size(x) = 64 and array_max(x) - array_min(x) > 1e-3")
        out = frames.map_series(w, ["window_id"], "x", _kept(surrogate, spectrum), ["kept", "other"])
        return out.agg(F.count("*").alias("windows"), F.count_if(F.col("kept") == 1).alias("kept"), F.count_if(F.col("other") == 1).alias("other"))

    run.__name__ = name
    run.__doc__ = f"How many windows keep their {'power spectrum' if spectrum else 'values'} in a surrogate, and how many change."
    checked(BASE + ", b2 as (select window_id from s group by 1 having count(*) = 64 and max(v) - min(v) > 1e-3) select count(*) as windows, count(*) as kept, count(*) as other from b2")(run)


_surrogate_query("surrogate_phase", kernels.phase_surrogate, True)
_surrogate_query("surrogate_shuffle", kernels.shuffle_surrogate, False)
_surrogate_query("surrogate_iaaft", kernels.iaaft, False)
