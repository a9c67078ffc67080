"""The queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondewerk.llm import groupsplit, knn, leakage, overlap, packing, quantiles, residue
from sondewerk.util import materialize, skew_join

PERCENTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of one row each as one row."""
    return a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), "__one").drop("__one")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap.overlap_pairs(_table(spark, sf_dir, "bank_windows"))
    return pairs.select(F.least("window_train", "window_held").alias("window_a"), F.greatest("window_train", "window_held").alias("window_b")).distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(_table(spark, sf_dir, "bank_windows"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest_pairs(_table(spark, sf_dir, "frame_embeddings"), _table(spark, sf_dir, "probe_vectors"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 100, against all vectors."""
    vectors = _table(spark, sf_dir, "frame_embeddings")
    return knn.nearest(vectors, vectors.filter("emb_id % 100 = 0"))


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the same queries, how many true neighbours there are, and whether nine tenths of them are found."""
    vectors = _table(spark, sf_dir, "frame_embeddings")
    r = knn.recall(vectors, vectors.filter("emb_id % 100 = 0"))
    return r.select("asked", "neighbours", (F.col("found") >= 0.9 * F.col("neighbours")).alias("enough"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, v, day): both columns of problem 6, named by node and column."""
    rows = _table(spark, sf_dir, "frame_embeddings").select("node_id", F.floor(F.col("ts_us") / 86_400_000_000).alias("day"), F.explode(F.create_map(F.lit("recon_error"), "recon_error", F.lit("score"), "score")).alias("metric", "v"))
    return rows.filter("node_id is not null").select(F.concat_ws("/", F.col("node_id").cast("string"), "metric").alias("name"), "v", "day")


def _by_node(df: DataFrame, *more: str) -> DataFrame:
    key = F.split("name", "/")
    return df.select(key[0].cast("bigint").alias("node_id"), key[1].alias("metric"), *more)


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of both columns per node from the sketches of all partitions."""
    out = quantiles.percentiles(quantiles.sketch(_metrics(spark, sf_dir), "name", "v"), PERCENTS)
    return _by_node(out, "p", "value", "n", "rank_error")


def p6_rank_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether small sketches (buffers of 16 that collapse by 4) of odd and even days, combined, keep the bound they state."""
    rows = _metrics(spark, sf_dir)
    odd = F.pmod(F.coalesce("day", F.lit(0)), F.lit(2)) == 1
    parts = [quantiles.merge_sketches(quantiles.sketch(rows.filter(c), "name", "v", 16, 4), 16, 4) for c in (odd, ~odd)]
    out = quantiles.percentiles(parts[0].unionByName(parts[1]), PERCENTS, 16, 4)
    checked = quantiles.rank_errors(rows, "name", "v", materialize(out))
    return _by_node(checked, "p", "n", (F.col("off") <= F.ceil("rank_error")).alias("within"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groupsplit.units(_table(spark, sf_dir, "recordings"), _table(spark, sf_dir, "bank_windows"))


def p7_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groupsplit.assign_splits(_table(spark, sf_dir, "recordings"), _table(spark, sf_dir, "bank_windows"))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the splits: every recording once, no unit in two, shares of windows within 2 % and the largest unit of those wanted."""
    splits = materialize(p7_splits(spark, sf_dir))
    units = splits.groupBy("unit_g").agg(F.count_distinct("split").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("bigint")), F.lit(0)).alias("torn"))
    rows = splits.agg(F.count("*").alias("recordings"), F.count_distinct("g").alias("distinct_g"))
    windows = _table(spark, sf_dir, "bank_windows").filter("g is not null").groupBy("g").agg(F.count("*").alias("n"))
    counted = materialize(skew_join(splits, windows, ["g"]).groupBy("unit_g", "split").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n").alias("windows"), F.max("n").alias("largest"), *[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(s) for s in groupsplit.SPLITS])
    near = [F.abs(F.col(s) / F.col("windows") - share) <= 0.02 + F.col("largest") / F.col("windows") for s, share in zip(groupsplit.SPLITS, groupsplit.SHARES)]
    return _beside(rows, _beside(units, total.select("windows", (near[0] & near[1] & near[2]).alias("near"))))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing: every document is there once, no container is over-full, hardly any room is left."""
    packed = p8_containers(spark, sf_dir)
    docs = packed.groupBy("doc_id").agg(F.count_distinct("piece").alias("pieces"), F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), F.count_distinct("container").alias("containers"))
    doc = docs.agg(F.count("*").alias("documents"), F.count_if((F.col("rows") != F.col("pieces")) | ((F.col("tokens") <= packing.CAPACITY) & (F.col("containers") > 1))).alias("cut"))
    use = packed.filter("container is not null").groupBy("container").agg(F.sum("tokens").alias("tokens"))
    box = use.agg(F.count_if(F.col("tokens") > packing.CAPACITY).alias("overfull"), (F.sum("tokens") >= 0.98 * packing.CAPACITY * F.greatest(F.count("*") - 1, F.lit(0))).alias("filled"), ((F.max("container") + 1) == F.count("*")).alias("numbered"))
    return _beside(doc, box)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = leakage.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"), item_answer="answer")
    return hits.filter("part = 'text'").select("doc_id", "item_id").distinct()


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"), item_answer="answer")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(_table(spark, sf_dir, "documents")).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p5_found, p5_neighbours, p5_recall, p6_percentiles, p6_rank_errors, p7_found, p7_splits, p7_check, p8_containers, p8_check, p9_found, p9_report, p10_found)}

_PAIRS = """
with w as (select window_id, split, bank, list_transform(windows, lambda x: case when isnan(x) then null else x end) as x from bank_windows where windows is not null and len(windows) = 64),
s as (select distinct w.window_id, w.split, p.i, x[p.i]::double as v from w, (select unnest(range(1, 65)) as i) p),
c as (select f.window_id as f_id, h.window_id as h_id, corr(f.v, h.v) as r from s f join s h on f.i = h.i where f.split = 'fit' and h.split in ('eval', 'replication') group by all)"""

# SQL has no NFKC: the compatibility characters of the tables are named
_LEAKS = """
with norm as (select 'd' as kind, doc_id as id, text, null as answer from documents where doc_id is not null and text is not null union all select 'i', item_id, text, answer from eval_items where text is not null),
w as (select kind, id, answer, list_filter(string_split_regex(replace(replace(replace(replace(replace(replace(replace(lower(nfc_normalize(text)), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), '™', 'tm'), '¼', '1/4'), chr(173), ''), chr(8203), ''), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ws from norm),
g as (select kind, id, answer, ws, array_to_string(ws[p:p+15], ' ') as gram from (select kind, id, answer, ws, unnest(range(1, len(ws) - 14)) as p from w where len(ws) >= 16)),
h as (select d.id as doc_id, i.id as item_id, bool_or(contains(' ' || array_to_string(d.ws, ' ') || ' ', ' ' || lower(i.answer) || ' ')) as answered from g d join g i on d.kind = 'd' and i.kind = 'i' and d.gram = i.gram group by all)"""

ORACLES = {
    "p2_found": _PAIRS + " select distinct least(f_id, h_id) as window_a, greatest(f_id, h_id) as window_b from c where r >= 0.97",
    "p2_report": _PAIRS + """, k as (select distinct h_id from c where r >= 0.97)
select split, bank, count(*) as windows, count(k.h_id) as overlapping from bank_windows b left join k on k.h_id = b.window_id where split in ('eval', 'replication') group by all""",
    "p5_found": """
with g as (select emb_id, vector::double[32] as v from frame_embeddings where len(vector) = 32 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0),
s as (select q.emb_id as q, g.emb_id as o, row_number() over (partition by q.emb_id order by array_cosine_similarity(q.v, g.v) desc, g.emb_id) as rn
      from g q join probe_vectors p on p.emb_id = q.emb_id join g on g.emb_id <> q.emb_id)
select distinct least(q, o) as emb_a, greatest(q, o) as emb_b from s where rn <= 5""",
    "p5_recall": """
with g as (select distinct emb_id from frame_embeddings where len(vector) = 32 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0)
select count(*) as asked, count(*) * least(5, (select count(*) - 1 from g)) as neighbours, true as enough from g where emb_id % 100 = 0""",
    "p6_percentiles": """
with v as (select node_id, 'recon_error' as metric, recon_error as v from frame_embeddings union all select node_id, 'score', score from frame_embeddings),
r as (select *, row_number() over (partition by node_id, metric order by v) as rn, count(*) over (partition by node_id, metric) as n from v where node_id is not null and v is not null and not isnan(v)),
p as (select unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999]::double[]) as p)
select node_id, metric, p, v as value, n, 0.0::double as rank_error from r, p where rn = greatest(1, ceil(p * n - 1e-9))""",
    "p6_rank_errors": """
with v as (select node_id, 'recon_error' as metric, recon_error as v from frame_embeddings union all select node_id, 'score', score from frame_embeddings),
r as (select *, row_number() over (partition by node_id, metric order by v) as rn, count(*) over (partition by node_id, metric) as n from v where node_id is not null and v is not null and not isnan(v)),
p as (select unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999]::double[]) as p)
select node_id, metric, p, n, true as within from r, p where rn = greatest(1, ceil(p * n - 1e-9))""",
    "p7_found": """
with recursive m as (select g, regexp_replace(lower(machine), '[^\\p{L}\\p{N}]', '', 'g') as k from recordings where machine is not null),
w as (select distinct g, windows from bank_windows semi join recordings using (g) where len(windows) = 64 and len(list_filter(windows, lambda x: x is null or isnan(x))) = 0),
e as (select a.g as a, b.g as b from m a join m b on a.k = b.k where a.k not in ('', 'unknown', 'na')
      union select a.g, b.g from w a join w b on a.windows = b.windows
      union select r.g, r.parent_g from recordings r semi join recordings p on p.g = r.parent_g
      union select r.parent_g, r.g from recordings r semi join recordings p on p.g = r.parent_g),
reach as (select g, g as o from recordings union select r.g, e.b from reach r join e on e.a = r.o)
select g, min(o) as unit_g from reach group by g having count(*) > 1""",
    "p7_check": """
select count(*) as recordings, count(*) as distinct_g, 0 as torn, (select count(*) from bank_windows w semi join recordings r using (g)) as windows, true as near from (select distinct g from recordings where g is not null)""",
    "p8_check": "select count(distinct doc_id) as documents, 0 as cut, 0 as overfull, true as filled, true as numbered from documents",
    "p9_found": _LEAKS + " select doc_id, item_id from h",
    "p9_report": _LEAKS + " select item_id, count(*) as documents, count(*) filter (where answered) as with_answer from h group by 1",
}
