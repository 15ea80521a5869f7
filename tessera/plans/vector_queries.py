"""Queries over vectors: pooling, normalization, directions, interventions.

Fixture: ``embeddings`` (64 dims) is cut into four 16-dim blocks that stand
in for four layers; 8 consecutive ``vec_id`` form one token sequence whose
first ``8 - seq_id % 4`` tokens are valid.  Results are compared in long
form (ids..., dim, value) rounded to 6 decimals.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import vectors as VO
from tessera.plans import sqlfrag as S
from tessera.plans.registry import query
from tessera.sources import tables

EV = """
ev AS (
  SELECT vec_id AS id, label, CAST((i - 1) // (len(embedding) // 4) AS INTEGER) AS layer,
         CAST((i - 1) % (len(embedding) // 4) AS INTEGER) AS dim,
         CAST(embedding[i] AS DOUBLE) AS x
  FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i
        FROM embeddings)
)"""

TK = EV + """,
tk AS (
  SELECT id // 8 AS seq_id, CAST(id % 8 AS INTEGER) AS pos, layer, dim, x,
         CASE WHEN id % 8 < 8 - (id // 8) % 4 THEN 1 ELSE 0 END AS m
  FROM ev
)"""

R6 = "round({}, 6) + 0.0"


def _vectors(spark, sf_dir):
    return VO.layer_blocks(tables.table(spark, sf_dir, "embeddings"))


def _tokens(spark, sf_dir):
    return VO.token_sequences(_vectors(spark, sf_dir))


def _pooled(spark, sf_dir, strategy):
    return VO.to_long(VO.pool(_tokens(spark, sf_dir), strategy), ["seq_id", "layer"])


@query("pool_mean", oracle=f"""
WITH {TK}
SELECT seq_id, layer, dim, {R6.format('sum(x * m) / greatest(sum(m), 1e-9)')} AS value
FROM tk GROUP BY ALL
""")
def pool_mean(spark, sf_dir):
    """V1 (+I5): masked mean pooling of token sequences, per layer."""
    return _pooled(spark, sf_dir, "mean")


@query("pool_cls", oracle=f"""
WITH {TK}
SELECT seq_id, layer, dim, {R6.format('x')} AS value FROM tk WHERE pos = 0
""")
def pool_cls(spark, sf_dir):
    """V2: first-token pooling."""
    return _pooled(spark, sf_dir, "cls")


@query("pool_max", oracle=f"""
WITH {TK}
SELECT seq_id, layer, dim, {R6.format('max(x)')} AS value FROM tk WHERE m = 1 GROUP BY ALL
""")
def pool_max(spark, sf_dir):
    """V3: max over valid tokens."""
    return _pooled(spark, sf_dir, "max")


@query("pool_attention", oracle=f"""
WITH {TK},
q AS (SELECT seq_id, layer, dim, sum(x * m) / greatest(sum(m), 1e-9) AS q FROM tk GROUP BY ALL),
sc AS (SELECT t.seq_id, t.layer, t.pos, sum(t.x * q.q) AS s
       FROM tk t JOIN q USING (seq_id, layer, dim) WHERE t.m = 1 GROUP BY ALL),
e AS (SELECT seq_id, layer, pos, exp(s - max(s) OVER (PARTITION BY seq_id, layer)) AS e FROM sc),
w AS (SELECT seq_id, layer, pos, e / sum(e) OVER (PARTITION BY seq_id, layer) AS w FROM e)
SELECT t.seq_id, t.layer, t.dim, {R6.format('sum(t.x * w.w)')} AS value
FROM tk t JOIN w USING (seq_id, layer, pos) GROUP BY ALL
""")
def pool_attention(spark, sf_dir):
    """V4: softmax(h . mean(h)) weighted mean over valid tokens."""
    return _pooled(spark, sf_dir, "attention")


@query("pool_tokens", oracle=f"""
WITH {TK}
SELECT seq_id, layer, dim, {R6.format('avg(x)')} AS value, count(*) AS n_tokens
FROM tk WHERE m = 1 GROUP BY ALL
""")
def pool_tokens(spark, sf_dir):
    """V6 + V8 (+S15 read rule): token level keeps the first sum(mask)
    tokens; a ragged sample is averaged to one vector."""
    kept = VO.token_level(_tokens(spark, sf_dir)).withColumn("n_tokens", F.size("tokens"))
    return VO.to_long(VO.ragged_mean(kept), ["seq_id", "layer", "n_tokens"]).select(
        "seq_id", "layer", "dim", "value", F.col("n_tokens").cast("bigint").alias("n_tokens"))


@query("norm_center", oracle=f"""
WITH {EV}
SELECT id, layer, dim, {R6.format('x - avg(x) OVER (PARTITION BY layer, dim)')} AS value FROM ev
""")
def norm_center(spark, sf_dir):
    """V9 (+P15): subtract the per-layer mean vector."""
    v = _vectors(spark, sf_dir).withColumn("vec", VO.V.finite("vec"))
    return VO.to_long(VO.center(v), ["id", "layer"])


@query("norm_train_only", oracle=f"""
WITH {EV},
ids AS (SELECT id, row_number() OVER (ORDER BY {S.seeded_hash(42, 'id')}, id) AS r, count(*) OVER () AS m
        FROM (SELECT DISTINCT id FROM ev)),
parts AS (SELECT id, {S.allocate('r', 'm', min_eval=None)} AS partition FROM ids),
mu AS (SELECT layer, dim, avg(x) AS mu FROM ev JOIN parts USING (id) WHERE partition = 'train' GROUP BY ALL)
SELECT id, layer, dim, partition, {R6.format('x - mu')} AS value
FROM ev JOIN parts USING (id) JOIN mu USING (layer, dim)
""")
def norm_train_only(spark, sf_dir):
    """V9 as fit and transform: means of the train rows alone are written as a
    version of the state, read again and applied to the rows of all partitions."""
    from tessera.operators import normalizer, splits
    from tessera.sources import files
    v = _vectors(spark, sf_dir).withColumn("vec", VO.V.finite("vec"))
    ids = v.select("id").distinct().withColumn("task_name", F.lit("vectors"))
    parts = splits.row_split(ids, stratify=False, id_col="id").select("id", "partition")
    v = v.join(parts, "id")
    path = files.scratch_path(spark, "normalizer")
    normalizer.save(normalizer.fit(v.filter("partition = 'train'"), "center"), path, "train")
    done = normalizer.transform(v, "center", normalizer.load(spark, path, "train"))
    return VO.to_long(done, ["id", "layer", "partition"])


@query("norm_l2", oracle=f"""
WITH {EV}
SELECT id, layer, dim,
       {R6.format('x / (sqrt(sum(x * x) OVER (PARTITION BY id, layer)) + 1e-12)')} AS value
FROM ev
""")
def norm_l2(spark, sf_dir):
    """X / (|x| + 1e-12)."""
    return VO.to_long(VO.l2_normalize(_vectors(spark, sf_dir)), ["id", "layer"])


MD = EV + """,
g AS (SELECT layer, dim, avg(x) AS g FROM ev GROUP BY ALL),
c AS (SELECT layer, label, dim, avg(x) AS c FROM ev GROUP BY ALL),
d AS (SELECT c.layer, c.label, c.dim, c.c - g.g AS v FROM c JOIN g USING (layer, dim)),
nn AS (SELECT layer, label, sqrt(sum(v * v)) AS nrm FROM d GROUP BY ALL),
md AS (
  SELECT 'mean_difference' AS method, d.layer,
         CAST(dense_rank() OVER (PARTITION BY d.layer ORDER BY d.label) - 1 AS INTEGER) AS k,
         d.label, d.dim, d.v / (nn.nrm + 1e-12) AS value
  FROM d JOIN nn USING (layer, label)
)"""


def _md(spark, sf_dir):
    return VO.mean_difference(_vectors(spark, sf_dir))


@query("mean_difference", oracle=f"""
WITH {MD}
SELECT method, layer, k, label, dim, {R6.format('value')} AS value FROM md
""")
def mean_difference(spark, sf_dir):
    """Per layer and class, unit (class mean - global mean)."""
    return VO.to_long(_md(spark, sf_dir), ["method", "layer", "k", "label"])


@query("class_separation", oracle=f"""
WITH {EV},
c AS (SELECT layer, label, dim, avg(x) AS c FROM ev GROUP BY ALL),
ends AS (SELECT layer, min(label) AS lo, max(label) AS hi FROM ev GROUP BY ALL),
d AS (SELECT e.layer, a.dim, b.c - a.c AS v FROM ends e
      JOIN c a ON a.layer = e.layer AND a.label = e.lo
      JOIN c b ON b.layer = e.layer AND b.label = e.hi AND b.dim = a.dim),
nn AS (SELECT layer, sqrt(sum(v * v)) AS nrm FROM d GROUP BY ALL)
SELECT 'class_separation' AS method, layer, 0 AS k, dim, {R6.format('v / (nrm + 1e-12)')} AS value
FROM d JOIN nn USING (layer)
""")
def class_separation(spark, sf_dir):
    """Unit (mean of the highest class - mean of the lowest class)."""
    cs = VO.class_separation(_vectors(spark, sf_dir))
    return VO.to_long(cs, ["method", "layer", "k"])


@query("direction_stats", oracle=f"""
WITH {MD},
nrm AS (SELECT method, layer, k, sqrt(sum(value * value)) AS norm FROM md GROUP BY ALL),
pr AS (SELECT m.method, m.layer, m.k, e.id, sum(e.x * m.value) AS p
       FROM ev e JOIN md m ON e.layer = m.layer AND e.dim = m.dim GROUP BY ALL),
ps AS (SELECT method, layer, k, avg(p) AS pm, stddev_pop(p) AS psd FROM pr GROUP BY ALL)
SELECT method, layer, k, {R6.format('norm')} AS norm, {R6.format('pm')} AS projection_mean,
       {R6.format('psd')} AS projection_std
FROM nrm JOIN ps USING (method, layer, k)
""")
def direction_stats(spark, sf_dir):
    """Norms of the mean-difference directions and the mean / population
    std of the projections of all vectors on them."""
    v = _vectors(spark, sf_dir)
    d = VO.mean_difference(v)
    r = lambda c: (F.round(F.col(c), 6) + F.lit(0.0)).alias(c)
    return (VO.direction_norms(d).join(VO.projection_stats(d, v), ["method", "layer", "k"])
            .select("method", "layer", "k", r("norm"), r("projection_mean"),
                    r("projection_std")))


@query("direction_cosines", oracle=f"""
WITH {MD},
nrm AS (SELECT layer, k, sqrt(sum(value * value)) AS n FROM md GROUP BY ALL),
dp AS (SELECT a.method, a.layer, a.k AS k_i, b.k AS k_j, sum(a.value * b.value) AS dt
       FROM md a JOIN md b ON a.layer = b.layer AND a.dim = b.dim AND a.k < b.k GROUP BY ALL)
SELECT dp.method, dp.layer, k_i, k_j, {R6.format('dt / (na.n * nb.n + 1e-12)')} AS cosine
FROM dp JOIN nrm na ON na.layer = dp.layer AND na.k = dp.k_i
        JOIN nrm nb ON nb.layer = dp.layer AND nb.k = dp.k_j
""")
def direction_cosines(spark, sf_dir):
    """Pairwise cosine (i < j) of the mean-difference directions."""
    c = VO.pairwise_cosines(_md(spark, sf_dir))
    return c.withColumn("cosine", F.round("cosine", 6) + F.lit(0.0))


@query("inter_layer_cosine", oracle=f"""
WITH {MD},
f AS (SELECT * FROM md WHERE k = 0),
nrm AS (SELECT layer, sqrt(sum(value * value)) AS n FROM f GROUP BY ALL),
dp AS (SELECT a.method, a.layer, b.layer AS other_layer, sum(a.value * b.value) AS dt
       FROM f a JOIN f b ON a.dim = b.dim AND a.layer <> b.layer GROUP BY ALL)
SELECT dp.method, dp.layer, other_layer, {R6.format('dt / (na.n * nb.n + 1e-12)')} AS cosine
FROM dp JOIN nrm na ON na.layer = dp.layer JOIN nrm nb ON nb.layer = dp.other_layer
""")
def inter_layer_cosine(spark, sf_dir):
    """Cosine of the first direction of each layer with every other layer's."""
    c = VO.inter_layer_cosine(_md(spark, sf_dir))
    return c.withColumn("cosine", F.round("cosine", 6) + F.lit(0.0))


PROJ = MD + """,
b AS (SELECT layer, dim, value AS b FROM md WHERE k = 0),
cf AS (SELECT e.id, e.layer, sum(e.x * b.b) AS c FROM ev e JOIN b USING (layer, dim) GROUP BY ALL),
po AS (SELECT e.id, e.layer, e.dim, e.x, e.x - cf.c * b.b AS y
       FROM ev e JOIN cf USING (id, layer) JOIN b USING (layer, dim))"""


def _projected(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v, VO.project_out(v, VO.mean_difference(v), n_drop=1)


@query("project_out", oracle=f"""
WITH {PROJ}
SELECT id, layer, dim, {R6.format('y')} AS value FROM po
""")
def project_out(spark, sf_dir):
    """Remove the first mean-difference direction of each layer."""
    return VO.to_long(_projected(spark, sf_dir)[1], ["id", "layer"])


@query("null_space_single", oracle=f"""
WITH {MD},
one AS (SELECT layer, dim, value AS w FROM md WHERE k = 0),
sq AS (SELECT layer, sum(w * w) AS ww FROM one GROUP BY ALL),
pr AS (SELECT e.id, e.layer, sum(e.x * one.w) AS c FROM ev e JOIN one USING (layer, dim) GROUP BY ALL)
SELECT e.id, e.layer, e.dim, {R6.format('e.x - pr.c / sq.ww * one.w')} AS value
FROM ev e JOIN one USING (layer, dim) JOIN sq USING (layer) JOIN pr USING (id, layer)
""")
def null_space_single(spark, sf_dir):
    """V20 with one direction per layer, the first mean-difference direction."""
    from tessera.operators import decompose
    v = _vectors(spark, sf_dir)
    first = VO.mean_difference(v).filter(F.col("k") == 0)
    return VO.to_long(decompose.null_space_remove(v, first), ["id", "layer"])


@query("cosine_drift", oracle=f"""
WITH {PROJ},
cs AS (SELECT id, layer, sum(x * y) / ((sqrt(sum(x * x)) + 1e-12) * (sqrt(sum(y * y)) + 1e-12)) AS c
       FROM po GROUP BY ALL)
SELECT layer, {R6.format('avg(1.0 - c)')} AS cosine_drift FROM cs GROUP BY ALL
""")
def cosine_drift(spark, sf_dir):
    """Mean cosine drift caused by removing that direction."""
    before, after = _projected(spark, sf_dir)
    d = VO.cosine_drift(before, after)
    return d.withColumn("cosine_drift", F.round("cosine_drift", 6) + F.lit(0.0))


@query("standard_scale", oracle=f"""
WITH {EV},
st AS (SELECT layer, dim, avg(x) AS mu, stddev_pop(x) AS sd FROM ev GROUP BY ALL)
SELECT id, layer, dim,
       {R6.format('(x - mu) / CASE WHEN sd = 0 THEN 1.0 ELSE sd END')} AS value
FROM ev JOIN st USING (layer, dim)
""")
def standard_scale(spark, sf_dir):
    """M1: per-layer standard scaling with population std (0 -> 1)."""
    return VO.to_long(VO.standard_scale(_vectors(spark, sf_dir)), ["id", "layer"])


@query("layer_zscore", oracle=f"""
WITH {EV},
lm AS (SELECT layer, dim, avg(x) AS v FROM ev GROUP BY ALL),
st AS (SELECT dim, avg(v) AS mu, stddev_pop(v) AS sd FROM lm GROUP BY ALL)
SELECT layer, dim, {R6.format('(v - mu) / CASE WHEN sd = 0 THEN 1.0 ELSE sd END')} AS value
FROM lm JOIN st USING (dim)
""")
def layer_zscore(spark, sf_dir):
    """Per-dimension z-score of the layer means across layers."""
    z = VO.layer_zscore(_vectors(spark, sf_dir))
    return z.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("layer_filter", oracle=f"""
WITH {EV},
sel AS (SELECT * FROM (VALUES (0, 3), (1, 0), (2, 3), (3, 3)) t(slot, layer))
SELECT 'indices' AS mode, slot, layer, count(DISTINCT id) AS n FROM ev JOIN sel USING (layer) GROUP BY ALL
UNION ALL
SELECT 'last_n', -1, layer, count(DISTINCT id) FROM ev WHERE layer >= 2 GROUP BY ALL
""")
def layer_filter(spark, sf_dir):
    """explicit layer indices [3, 0, 3, -1] (order and repeats kept) and
    the last two layers."""
    v = _vectors(spark, sf_dir)
    a = VO.filter_layers(v, mode="explicit", indices=[3, 0, 3, -1]).groupBy("slot", "layer").agg(
        F.countDistinct("id").alias("n")).withColumn("mode", F.lit("indices"))
    b = VO.filter_layers(v, mode="last_n", last_n=2).groupBy("layer").agg(
        F.countDistinct("id").alias("n")).withColumn("mode", F.lit("last_n")).withColumn(
        "slot", F.lit(-1))
    return a.unionByName(b).select("mode", F.col("slot").cast("int").alias("slot"),
                                   F.col("layer").cast("int").alias("layer"), "n")


@query("vector_store_round_trip", oracle=f"""
WITH {EV}
SELECT id, layer, dim, {R6.format('x')} AS value FROM ev
""")
def vector_store_round_trip(spark, sf_dir):
    """Vectors written partitioned by layer under the shared
    scratch folder and read back (ragged samples averaged on read, layers
    ordered numerically)."""
    from tessera.sources import files
    v = _vectors(spark, sf_dir).select("id", "layer", "vec")
    path = files.scratch_path(spark, "vectors")
    files.write_records(v, path, partition_by=["layer"])
    back = spark.read.parquet(path)
    per_id = back.groupBy("id", "layer").agg(F.collect_list("vec").alias("_v")).select(
        "id", F.col("layer").cast("int").alias("layer"),
        VO.V.divide(F.aggregate("_v", F.array_repeat(F.lit(0.0), F.size(F.element_at("_v", 1))),
                                lambda acc, x: VO.V.add(acc, x)),
                    F.size("_v").cast("double")).alias("vec"))
    return VO.to_long(per_id, ["id", "layer"])
