"""Report queries (K1-K8, E5, E7) and decoding queries.

Layer scores come from the embeddings fixture (four 16-dim blocks = four
layers) as the between-class share of variance, for two tasks: ``label``
(10 classes) and ``parity`` (label % 2).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import inference as INF
from tessera.operators import reports as RP
from tessera.operators import vectors as VO
from tessera.plans.registry import query
from tessera.plans.vector_queries import EV, PROJ, R6
from tessera.sources import tables

KEYS = ["track", "task", "family", "level"]


def _vectors(spark, sf_dir):
    return VO.layer_blocks(tables.table(spark, sf_dir, "embeddings"))


def _task_vectors(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return (v.withColumn("task", F.lit("label"))
            .unionByName(v.withColumn("task", F.lit("parity"))
                         .withColumn("label", F.pmod("label", F.lit(2)))))


def _scores(spark, sf_dir):
    s = RP.variance_share(_task_vectors(spark, sf_dir), ["task", "layer"])
    return s.select(F.lit("semantic").alias("track"), "task", F.lit("blocks").alias("family"),
                    F.lit("text").alias("level"), "layer", "score")


def _r(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), 6) + F.lit(0.0))
    return df


def share_sql(src: str, keys: str) -> str:
    """Between-class share of variance per ``keys`` over a long table
    ``src`` (keys..., id, dim, x, cls)."""
    return f"""
  SELECT {keys}, CASE WHEN t > 0 THEN b / t ELSE 0.0 END AS score FROM (
    SELECT {keys}, sum(nc * (mc - mu) * (mc - mu)) AS b FROM
      (SELECT {keys}, cls, dim, avg(x) AS mc, count(*) AS nc FROM {src} GROUP BY ALL) cm
      JOIN (SELECT {keys}, dim, avg(x) AS mu FROM {src} GROUP BY ALL) gm USING ({keys}, dim)
    GROUP BY ALL) bt
  JOIN (
    SELECT {keys}, sum((x - mu) * (x - mu)) AS t FROM {src}
      JOIN (SELECT {keys}, dim, avg(x) AS mu FROM {src} GROUP BY ALL) gm2 USING ({keys}, dim)
    GROUP BY ALL) tt USING ({keys})"""


SCORES = EV + f""",
evt AS (SELECT 'label' AS task, id, layer, dim, x, label AS cls FROM ev
        UNION ALL SELECT 'parity', id, layer, dim, x, label % 2 FROM ev),
scores AS (SELECT 'semantic' AS track, task, 'blocks' AS family, 'text' AS level, layer, score
           FROM ({share_sql('evt', 'task, layer')}))"""

BEST = SCORES + """,
best AS (SELECT track, task, family, level, layer AS best_layer, score AS best_score FROM (
  SELECT *, row_number() OVER (PARTITION BY track, task, family, level
                               ORDER BY score DESC, layer) AS r FROM scores) WHERE r = 1)"""


@query("layer_scores", oracle=f"""
WITH {SCORES}
SELECT track, task, family, level, layer, {R6.format('score')} AS score FROM scores
""")
def layer_scores(spark, sf_dir):
    """Layer profile P(l): between-class share of variance per layer and task."""
    return _r(_scores(spark, sf_dir), "score")


@query("best_layer", oracle=f"""
WITH {BEST}
SELECT track, task, family, level, best_layer, {R6.format('best_score')} AS best_score FROM best
""")
def best_layer(spark, sf_dir):
    """K1: first maximum per task (ties -> lowest layer)."""
    return _r(RP.best_layer(_scores(spark, sf_dir), KEYS), "best_score")


@query("layer_report", oracle=f"""
WITH {BEST}
SELECT b.track, b.task, b.family, b.level, best_layer, {R6.format('best_score')} AS best_score,
       n_layers, {R6.format('mean_score')} AS mean_score
FROM best b JOIN (SELECT track, task, family, level, count(*) AS n_layers, avg(score) AS mean_score
                  FROM scores GROUP BY ALL) p USING (track, task, family, level)
""")
def layer_report(spark, sf_dir):
    """K2 (+E7, S16 keys): one row per (track, task, family, level)."""
    rep = RP.layer_profile_report(_scores(spark, sf_dir), KEYS)
    return _r(rep.select(*KEYS, "best_layer", "best_score", "n_layers", "mean_score"),
              "best_score", "mean_score")


ROBUST = EV + f""",
ids AS (SELECT DISTINCT id FROM ev),
kk AS (SELECT greatest(2, floor(count(*) * 0.8)) AS k FROM ids),
ps AS (SELECT seed, id FROM (
         SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY
                md5(CAST(seed AS VARCHAR) || ':' || CAST(id AS VARCHAR)), id) AS r
         FROM ids, (VALUES (0), (1), (2), (3), (4)) s(seed)) WHERE r <= (SELECT k FROM kk)),
sub AS (SELECT ps.seed, ev.id, ev.layer, ev.dim, ev.x, ev.label AS cls FROM ev JOIN ps USING (id)),
per_seed AS ({share_sql('sub', 'seed, layer')}),
summary AS (SELECT layer, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS mn,
                   max(score) AS mx, count(*) AS n_seeds,
                   quantile_cont(score, 0.025) AS lo, quantile_cont(score, 0.975) AS hi
            FROM per_seed GROUP BY layer)"""


def _robust(spark, sf_dir):
    sub = RP.bootstrap_subsample(_vectors(spark, sf_dir))
    per_seed = RP.variance_share(sub, ["seed", "layer"])
    return RP.robustness_summary(per_seed)


@query("robustness_summary", oracle=f"""
WITH {ROBUST}
SELECT layer, {R6.format('mean')} AS mean, {R6.format('std')} AS std, {R6.format('mn')} AS min,
       {R6.format('mx')} AS max, n_seeds, {R6.format('lo')} AS ci95_low,
       {R6.format('hi')} AS ci95_high
FROM summary
""")
def robustness_summary(spark, sf_dir):
    """E5 + K3: five seeded 80 % subsamples without replacement; per layer
    mean, population std, min, max, seeds and 2.5 / 97.5 % percentiles."""
    return _r(_robust(spark, sf_dir), "mean", "std", "min", "max", "ci95_low", "ci95_high")


@query("best_robust_layer", oracle=f"""
WITH {ROBUST}
SELECT layer AS best_layer, {R6.format('mean')} AS best_mean FROM (
  SELECT *, row_number() OVER (ORDER BY mean DESC, layer) AS r FROM summary) WHERE r = 1
""")
def best_robust_layer(spark, sf_dir):
    """K8: the layer with the highest mean robustness score."""
    return _r(RP.best_robust_layer(_robust(spark, sf_dir)), "best_mean")


@query("baseline_comparison", oracle=f"""
WITH {BEST},
emb AS (SELECT vec_id AS id, label, embedding FROM embeddings),
base AS (
  SELECT 'norm' AS estimator, task, id, 0 AS dim,
         sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) AS x,
         cls FROM emb, (SELECT 'label' AS task UNION ALL SELECT 'parity') t,
         LATERAL (SELECT CASE WHEN task = 'label' THEN label ELSE label % 2 END AS cls)
  UNION ALL
  SELECT 'first_dim', task, id, 0, CAST(embedding[1] AS DOUBLE), cls
  FROM emb, (SELECT 'label' AS task UNION ALL SELECT 'parity') t,
       LATERAL (SELECT CASE WHEN task = 'label' THEN label ELSE label % 2 END AS cls)
),
bs AS ({share_sql('base', 'estimator, task')})
SELECT b.task, estimator, {R6.format('bs.score')} AS baseline_score, best_layer,
       {R6.format('best_score')} AS best_score, {R6.format('best_score - bs.score')} AS gap,
       (bs.score >= best_score * (1.0 - 0.05) OR abs(best_score - bs.score) <= 0.05) AS comparable
FROM best b JOIN bs ON b.task = bs.task
""")
def baseline_comparison(spark, sf_dir):
    """K4: best probe layer vs two one-feature baselines (vector norm, first
    coordinate); gap and the 'comparable' leakage warning (tolerance 0.05)."""
    emb = tables.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", V.to_double("embedding").alias("e"))
    feats = emb.select("id", "label", F.array(V.norm("e")).alias("norm"),
                       F.array(F.element_at("e", 1)).alias("first_dim"))
    base = None
    for est in ("norm", "first_dim"):
        for task, lab in (("label", F.col("label")), ("parity", F.pmod("label", F.lit(2)))):
            part = feats.select("id", lab.alias("label"), F.col(est).alias("vec")).withColumn(
                "task", F.lit(task)).withColumn("estimator", F.lit(est))
            base = part if base is None else base.unionByName(part)
    bs = RP.variance_share(base, ["estimator", "task"]).withColumnRenamed("score", "baseline_score")
    best = RP.best_layer(_scores(spark, sf_dir), ["task"])
    out = RP.compare_to_baselines(best, bs, ["task"])
    return _r(out.select("task", "estimator", "baseline_score", "best_layer", "best_score", "gap",
                         "comparable"), "baseline_score", "best_score", "gap")


@query("intervention_report", oracle=f"""
WITH {PROJ},
lab AS (SELECT DISTINCT id, label FROM ev),
orig AS (SELECT id, layer, dim, x, label AS cls FROM po JOIN lab USING (id)),
proj AS (SELECT id, layer, dim, y AS x, label AS cls FROM po JOIN lab USING (id)),
bf AS ({share_sql('orig', 'layer')}),
af AS ({share_sql('proj', 'layer')}),
cs AS (SELECT id, layer, sum(x * y) / ((sqrt(sum(x * x)) + 1e-12) * (sqrt(sum(y * y)) + 1e-12)) AS c
       FROM po GROUP BY ALL),
dr AS (SELECT layer, avg(1.0 - c) AS drift FROM cs GROUP BY ALL)
SELECT 'mean_difference' AS method, layer, {R6.format('bf.score')} AS before,
       {R6.format('af.score')} AS after, {R6.format('bf.score - af.score')} AS target_score_drop,
       {R6.format('(bf.score - af.score) / (abs(bf.score) + 1e-12)')} AS relative_target_drop,
       {R6.format('drift')} AS cosine_drift_mean,
       {R6.format('(bf.score - af.score) / (bf.score - af.score + drift + 1e-12)')} AS selectivity_score
FROM bf JOIN af USING (layer) JOIN dr USING (layer)
""")
def intervention_report(spark, sf_dir):
    """M12 + K5: remove the first mean-difference direction per layer; score
    before/after, drop, relative drop, cosine drift and selectivity."""
    v = _vectors(spark, sf_dir)
    after = VO.project_out(v, VO.mean_difference(v), n_drop=1)
    before_s = RP.variance_share(v, ["layer"])
    after_s = RP.variance_share(after, ["layer"])
    drift = VO.cosine_drift(v, after)
    rep = RP.intervention_report(before_s, after_s, drift, ["layer"]).withColumn(
        "method", F.lit("mean_difference"))
    cols = ["before", "after", "target_score_drop", "relative_target_drop", "cosine_drift_mean",
            "selectivity_score"]
    return _r(rep.select("method", "layer", *cols), *cols)


@query("direction_index", oracle=f"""
WITH {EV},
g AS (SELECT layer, dim, avg(x) AS g FROM ev GROUP BY ALL),
c AS (SELECT layer, label, dim, avg(x) AS c FROM ev GROUP BY ALL),
d AS (SELECT c.layer, c.label, c.dim, c.c - g.g AS v FROM c JOIN g USING (layer, dim)),
nn AS (SELECT layer, label, sqrt(sum(v * v)) AS nrm FROM d GROUP BY ALL)
SELECT 'mean_difference' AS method, layer, count(*) AS n_directions, 16 AS dim,
       {R6.format('avg(nrm / (nrm + 1e-12))')} AS mean_norm
FROM nn GROUP BY layer
""")
def direction_index(spark, sf_dir):
    """K6 (+V25 table shape): one row per direction set."""
    idx = RP.direction_index(VO.mean_difference(_vectors(spark, sf_dir)))
    return _r(idx.select("method", "layer", "n_directions", "dim", "mean_norm"), "mean_norm")


# --- decoding -------------------------------------------------------------------------

LOGITS_SQL = """
lg AS (SELECT vec_id, list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE)) AS z
       FROM embeddings)"""


def _logits(spark, sf_dir):
    return tables.table(spark, sf_dir, "embeddings").select(
        "vec_id", V.to_double(F.slice("embedding", 1, 10)).alias("logits"))


@query("decode_single", oracle=f"""
WITH {LOGITS_SQL},
sm AS (SELECT vec_id, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM lg),
p AS (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM sm)
SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred,
       {R6.format('list_max(p)')} AS confidence,
       CASE list_position(p, list_max(p)) - 1 WHEN 0 THEN 'нейтральная' WHEN 1 THEN 'позитивная'
            WHEN 2 THEN 'негативная'
            ELSE 'класс_' || CAST(list_position(p, list_max(p)) - 1 AS VARCHAR) END AS label_name
FROM p
""")
def decode_single(spark, sf_dir):
    """Softmax over the first 10 dims as logits, argmax, confidence, name."""
    d = INF.decode_single(_logits(spark, sf_dir))
    return _r(d.select("vec_id", "pred", "confidence", "label_name"), "confidence")


@query("decode_multi", oracle=f"""
WITH {LOGITS_SQL},
s AS (SELECT vec_id, i, 1.0 / (1.0 + exp(-z[i + 1])) AS p FROM lg, range(10) t(i)),
r AS (SELECT vec_id, i, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS rk FROM s)
SELECT vec_id, 'above' AS kind, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY rk) AS INTEGER) AS rank,
       'эмоция_' || CAST(i AS VARCHAR) AS label, {R6.format('p')} AS prob FROM r WHERE p >= 0.5
UNION ALL
SELECT vec_id, 'top', CAST(rk AS INTEGER), 'эмоция_' || CAST(i AS VARCHAR), {R6.format('p')}
FROM r WHERE rk <= 5
""")
def decode_multi(spark, sf_dir):
    """Sigmoid, labels >= 0.5 by probability, and the top 5."""
    d = INF.decode_multi(_logits(spark, sf_dir), num_labels=10)
    parts = []
    for kind in ("above", "top"):
        parts.append(d.select("vec_id", F.posexplode(kind).alias("pos", "s")).select(
            "vec_id", F.lit(kind).alias("kind"), (F.col("pos") + 1).cast("int").alias("rank"),
            F.col("s.label").alias("label"), F.col("s.prob").alias("prob")))
    return _r(reduce(lambda a, b: a.unionByName(b), parts), "prob")


@query("attention_salience", oracle=f"""
WITH a AS (
  SELECT vec_id, CAST(8 - vec_id % 4 AS INTEGER) AS seq_len, (i - 1) // 8 AS head,
         CAST((i - 1) % 8 AS INTEGER) AS key, abs(CAST(embedding[i] AS DOUBLE)) AS w
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)
),
m AS (SELECT vec_id, key, sum(w) / 8.0 AS s FROM a WHERE key < seq_len GROUP BY ALL)
SELECT vec_id, key, {R6.format('s / (sum(s) OVER (PARTITION BY vec_id) + 1e-9)')} AS salience FROM m
""")
def attention_salience(spark, sf_dir):
    """I4: |embedding| read as 8 heads x 8 keys of one query row; mean over
    heads, valid keys only (8 - vec_id % 4), normalized."""
    emb = tables.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: F.abs(v)).alias("attn"),
        (F.lit(8) - F.pmod("vec_id", F.lit(4))).cast("int").alias("seq_len"))
    sal = INF.attention_salience(emb)
    out = sal.select("vec_id", F.posexplode("salience").alias("key", "salience"))
    return _r(out.withColumn("key", F.col("key").cast("int")), "salience")


@query("result_scan", oracle=f"""
WITH {SCORES}
SELECT track, task, family, level, layer, {R6.format('score')} AS score FROM scores
""")
def result_scan(spark, sf_dir):
    """Layer scores written under track/task/family/level folders and
    scanned back; the keys come from the folder names."""
    from tessera.sources import files
    path = files.scratch_path(spark, "results")
    files.write_records(_scores(spark, sf_dir), path, partition_by=KEYS)
    back = spark.read.option("basePath", path).parquet(path)
    return _r(RP.order_layers(back.select(*[F.col(k).cast("string").alias(k) for k in KEYS],
                                          F.col("layer").cast("int").alias("layer"), "score")),
              "score")
