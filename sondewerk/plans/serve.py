"""Reports over a point table as JSON, a standalone HTML page of its map, and a small read-only HTTP server."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondewerk.operators import vectors
from sondewerk.plans.receipts import jsonable

#: Rows the report of the top anomalies gives out at most, whatever is asked for.
MOST = 1_000
#: Pixels of the page's map that a point's corner may stand on.
WIDTH, HEIGHT = 791, 591


def _rows(df: DataFrame) -> Iterator[dict]:
    """All rows, of which one partition at a time is held."""
    return (jsonable(r.asDict(True)) for r in df.toLocalIterator())


def routes(points: DataFrame, key: str = "emb_id", score: str = "score", vector: str = "vector") -> dict[str, Callable[[dict], object]]:
    """health, anomalies, node and map over a point table (key, node_id, score, vector).

    node and map give all points in order of the key, as iterators. anomalies is a list of at most MOST.
    """
    return {
        "health": lambda q: {"status": "ok", "points": points.count()},
        "anomalies": lambda q: list(_rows(vectors.top_anomalies(points, score, key, min(int(q.get("limit", 10)), MOST), vector))),
        "node": lambda q: _rows(vectors.node_points(points, int(q["id"]), vector).orderBy(key)),
        "map": lambda q: _rows(vectors.project_2d(points.filter(F.col(vector).isNotNull()), key, vector).orderBy(key)),
    }


def serve(points: DataFrame, port: int = 8000, **how: str) -> HTTPServer:
    """A server of ``routes``; call serve_forever() on it."""
    table = routes(points, **how)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlparse(self.path)
            parts = url.path.strip("/").split("/")
            q = {k: v[0] for k, v in parse_qs(url.query).items()} | ({"id": parts[1]} if len(parts) > 1 else {})
            try:
                code, body = (200, table[parts[0]](q)) if parts[0] in table else (404, {"error": "no such report"})
            except (ValueError, KeyError):
                code, body = 400, {"error": "bad request"}
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            if isinstance(body, Iterator):
                # the end of the connection is the end of the body
                self.end_headers()
                self.wfile.write(b"[")
                for i, row in enumerate(body):
                    self.wfile.write((", " * (i > 0) + json.dumps(row)).encode())
                self.wfile.write(b"]")
                return
            raw = json.dumps(body).encode()
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args: object) -> None:
            pass

    return HTTPServer(("127.0.0.1", port), Handler)


def flag_top(points: DataFrame, score: str, tie: str, share: float = 0.05) -> DataFrame:
    """points with ``flagged``: the top share of scores, at least one row. The cut is one aggregated row."""
    n = max(1, int(points.count() * share))
    last = points.orderBy(F.desc(score), tie).select(F.col(score).alias("__s"), F.col(tie).alias("__t")).limit(n).agg(F.min(F.struct("__s", (-F.col("__t")).alias("__t"))).alias("__c"))
    return points.crossJoin(F.broadcast(last)).withColumn("flagged", F.coalesce((F.col(score) > F.col("__c.__s")) | ((F.col(score) == F.col("__c.__s")) & (-F.col(tie) >= F.col("__c.__t"))), F.lit(False))).drop("__c")


def write_html(mapped: DataFrame, path: str | Path, key: str) -> None:
    """A standalone page that draws all points (key, x, y), in red those with ``flagged``, if there is such a column.

    Points whose corners fall on one pixel are drawn as one, so the page holds at most WIDTH x HEIGHT
    cells (smallest key, column, row, points, flagged), however many points there are.
    """
    points = mapped.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    e = points.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    flagged = F.coalesce(F.max(F.col("flagged").cast("int")), F.lit(0)) if "flagged" in mapped.columns else F.lit(0)
    at = lambda c, n: F.round((F.col(c) - F.lit(e[f"lo{c}"])) / F.lit((e[f"hi{c}"] - e[f"lo{c}"]) or 1.0) * (n - 1)).cast("int") if e[f"lo{c}"] is not None else F.lit(0)
    cells = points.groupBy(at("x", WIDTH).alias("px"), at("y", HEIGHT).alias("py")).agg(F.min(key).alias(key), F.count("*").alias("n"), flagged.alias("flagged"))
    data = json.dumps([[r[key], r["px"], r["py"], r["n"], r["flagged"]] for r in _rows(cells.orderBy("flagged", key))]).replace("</", "<\\/")
    Path(path).write_text(
        "<!doctype html><meta charset=utf-8><canvas id=c width=800 height=600></canvas><script>const d=" + data + ";const g=c.getContext('2d');"
        "for(const p of d){g.fillStyle=p[4]?'red':'black';g.fillRect(p[1],p[2],4,4)}</script>"
    )
