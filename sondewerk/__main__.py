"""python -m sondewerk COMMAND: plugins, simulate, ingest, profile, distill, couple, causal, checkup, verify."""

from __future__ import annotations

import argparse
import json
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sondewerk", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("plugins")
    for name in ("simulate", "ingest", "profile", "distill", "couple", "causal", "checkup", "verify"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--out")
        s.add_argument("--columns", nargs="*")
        s.add_argument("--count", type=int, default=200)
        s.add_argument("--label-by", default="prefix")
        s.add_argument("--window", type=int, default=1024)
        s.add_argument("--method", default="te", choices=["te", "ccm", "granger", "var"])
        s.add_argument("--pubkey")
    a = p.parse_args(argv)
    from sondewerk.plans import registry

    if a.command == "plugins":
        print(json.dumps({k: registry.available(k) for k in ("source", "transform", "model", "sink")}))
        return 0
    if a.command == "verify":
        from sondewerk.plans import receipts

        wrong = receipts.problems(receipts.load_strict(Path(a.path).read_bytes()), a.pubkey)
        print("\n".join(wrong) or "PASS")
        return int(bool(wrong))

    from pyspark.sql import functions as F

    from sondewerk.functions import series
    from sondewerk.operators import coupling, detector, frames
    from sondewerk.plans import distill
    from sondewerk.session import session
    from sondewerk.sources import readers, simulator

    spark = session()
    if a.command == "simulate":
        simulator.frames(spark, a.count).write.mode("overwrite").parquet(a.path)
    elif a.command in ("couple", "causal"):
        df = readers.read_channels(spark, a.path, a.columns)
        names = [c for c in df.columns if c != "t"]
        (coupling.couplings(df, names) if a.command == "couple" else coupling.edges(df, "t", names, a.method)).show(200, truncate=False)
    else:
        bank = readers.read_bank(spark, a.path, a.label_by).filter("error is null")
        windows = frames.framed(bank, ["g", "label"], "x", a.window).select(F.concat_ws("-", "g", "k").alias("window_id"), "g", F.col("label").alias("y"), frames.detrended(F.col("x")).alias("x"))
        if a.command == "ingest":
            readers.frames_of(bank.withColumn("error", F.lit(None).cast("string"))).write.mode("append").parquet(a.out)
        elif a.command == "profile":
            q = registry.profile(windows, a.path, "", "")
            print(json.dumps({"metrics": q.metrics, "signature": q.signature, "routing": registry.route(q)}, indent=2))
        elif a.command == "distill":
            print(distill.report(distill.distill(windows)))
        else:
            healthy = detector.guess_healthy([r["y"] for r in windows.select("y").distinct().limit(1000).collect()])
            if healthy is None:
                raise SystemExit("no class names the healthy state")
            f = windows.select("g", "y", *[series.finite(series.POOLS[n](F.col("x"))).alias(n) for n in ("meanabs", "crest", "acf1", "zcr")])
            det = detector.RobustDetector.fit(f.filter((F.col("y") == healthy) & (F.col("g") % 2 == 0)), ["meanabs", "crest", "acf1", "zcr"])
            held = f.filter((F.col("y") != healthy) | (F.col("g") % 2 == 1)).withColumn("score", det.score()).withColumn("odd", F.col("y") != healthy)
            print(json.dumps(det.calibrate(held, "score", "odd", "g"), indent=2))
            if a.out:
                Path(a.out).write_text(det.to_json())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
