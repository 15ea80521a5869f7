"""Mixing sources to target weights along a time-varying curriculum (operator 9).

Each source has a weight schedule over training time t in [0, 1] that is
linear from one weight to another.  Its demand for words up to t is the
integral of the schedule, scaled so that the demand at t = 1 is the source's
target.  Documents of a source are laid end to end in hash order, epoch after
epoch; a document that starts at word c of its source is read when the demand
reaches c, so its position is the inverse of the demand at c.  Documents are
range-sorted by position.

Targets: sources share a total by weight, stop at twice their own words, and
the excess goes to the others by weight until none is above.

Defined results: a null or empty text has size 0 and is taken as 0 words; null
sources form one source, last in order; repeated rows are separate documents;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import saved, whole_text, words_of

# fixed values: weights by rank of the source, share of all words, cap
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
#: Weight at the start and at the end of training, by rank of the source.
SCHEDULES = ((2.0, 1.0), (1.0, 1.0), (1.0, 3.0))
BUCKETS = 4096
SEED = 7


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE,
                   max_epochs: float = MAX_EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """Per source (one row each): its words, target, and schedule.

    The fair level L solves sum(min(cap, weight * L)) = total.  Sources sorted
    by cap / weight reach their cap first; running sums over that order give
    the level at which each next source would be capped, hence the answer
    without iteration."""
    by_code_point = Window.orderBy(F.col("_source").isNull(), F.encode("_source", "UTF-8"))
    s = (sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
         .withColumn("_rank", F.row_number().over(by_code_point) - 1))

    def pick(values) -> Column:
        arr = F.array(*[F.lit(float(v)) for v in values])
        return F.element_at(arr, (F.pmod(F.col("_rank"), F.lit(len(values))) + 1).cast("int"))

    s = (s.withColumn("_weight", pick(weights))
         .withColumn("_w0", pick([a for a, _ in schedules]))
         .withColumn("_w1", pick([b for _, b in schedules]))
         .withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs))))
    everyone = Window.partitionBy(F.lit(1))
    filled = everyone.orderBy(F.col("_cap") / F.col("_weight"), "_rank").rowsBetween(
        Window.unboundedPreceding, -1)
    s = (s.withColumn("_total", F.sum("source_size").over(everyone) * F.lit(float(total_share)))
         .withColumn("_caps_before", F.coalesce(F.sum("_cap").over(filled), F.lit(0.0)))
         .withColumn("_weights_left", F.sum("_weight").over(everyone)
                     - F.coalesce(F.sum("_weight").over(filled), F.lit(0.0)))
         .withColumn("_level", (F.col("_total") - F.col("_caps_before")) / F.col("_weights_left"))
         # the first source in this order that stays under its cap sets the level
         .withColumn("_open", F.col("_weight") * F.col("_level") <= F.col("_cap"))
         .withColumn("_fair", F.min(F.when(F.col("_open"), F.struct(
             F.col("_cap") / F.col("_weight"), F.col("_rank"), F.col("_level").alias("level")))).over(everyone)))
    target = F.least(F.col("_cap"), F.coalesce(
        F.col("_weight") * F.col("_fair.level"), F.col("_cap")))
    return s.select("_source", "source_size", target.alias("target"), "_w0", "_w1")


def position(demand: Column, target: Column, w0: Column, w1: Column) -> Column:
    """Training time at which the integrated schedule reaches ``demand``.

    With a schedule linear from w0 to w1, demand(t) / target =
    (w0 t + (w1 - w0) t^2 / 2) / ((w0 + w1) / 2); the root in [0, 1] is taken
    in the form that stays exact for w0 = w1."""
    share = F.when(target > 0, F.least(demand / target, F.lit(1.0))).otherwise(F.lit(0.0))
    need = share * (w0 + w1) / 2
    root = F.sqrt(w0 * w0 + 2 * (w1 - w0) * need)
    return F.when(need > 0, F.least(2 * need / (w0 + root), F.lit(1.0))).otherwise(F.lit(0.0))


def place(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Small rows, one per document: _id, _source, _size, _key, source_size,
    target, epochs and a position per epoch.

    Sums are cut into hash buckets per source, so a source with a third of all
    rows is spread over ``BUCKETS`` groups."""
    # the text is read once; later steps work on the small rows
    sized = saved(with_key(docs, id_col, text_col, seed).select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), "_mix_key",
        F.size(words_of(whole_text(text_col))).cast("long").alias("_size"),
        F.pmod(F.shiftright("_mix_key", 20), F.lit(BUCKETS)).cast("int").alias("_bucket")))
    targets = source_targets(sized)
    sums = sized.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_in_bucket"))
    run = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sums.withColumn("_before", F.coalesce(F.sum("_in_bucket").over(run), F.lit(0)))
               .withColumnRenamed("_source", "_s").withColumnRenamed("_bucket", "_b")
               .join(targets.withColumnRenamed("_source", "_t"),
                     F.col("_s").eqNullSafe(F.col("_t"))).drop("_t"))
    inside = Window.partitionBy("_source", "_bucket").orderBy(
        "_mix_key", "_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (sized.join(offsets, F.col("_source").eqNullSafe(F.col("_s"))
                         & (F.col("_bucket") == F.col("_b")))
              .withColumn("_start", F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0))))
    # whole epochs of the source, then documents until the rest is filled
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    epochs = whole + F.when(F.col("_start") + F.col("_size") / 2 <= rest, 1).otherwise(0)
    epochs = F.least(epochs, F.lit(MAX_EPOCHS)).cast("int")
    at = [position((F.col("_start") + F.col("source_size") * k).cast("double"), F.col("target"),
                   F.col("_w0"), F.col("_w1")) for k in range(MAX_EPOCHS)]
    return placed.select("_id", "_source", "_size", "_mix_key", "source_size", "target",
                         epochs.alias("epochs"),
                         *[F.when(epochs > k, p).alias(f"position_{k + 1}") for k, p in enumerate(at)])


def with_key(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """Add the order key of a document within its source."""
    return docs.withColumn("_mix_key", F.xxhash64(F.lit(seed), F.col(id_col), whole_text(text_col)))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One row per document, range-sorted by position: size, source_size,
    target, taken, epochs, position of the first reading and of the second."""
    out = place(docs, id_col, text_col, source_col, seed).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * F.col("epochs")).cast("long").alias("taken"), "epochs",
        *[f"position_{k + 1}" for k in range(MAX_EPOCHS)])
    return out.orderBy(F.col("position_1").asc_nulls_last(), id_col)


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The documents as the mix reads them: a row with all columns for every
    reading, in order of position.  Documents that the mix does not take are
    absent.  Texts pass one shuffle to meet their positions and one to be
    sorted."""
    same = Window.partitionBy("_mix_key").orderBy("_id", "_source")
    places = place(docs, id_col, text_col, source_col, seed).withColumn("_mix_n", F.row_number().over(same))
    readings = places.select(F.col("_mix_key").alias("_k"), F.col("_mix_n").alias("_m"), F.explode(F.array(
        *[f"position_{k + 1}" for k in range(MAX_EPOCHS)])).alias("_mix_at")).filter(F.col("_mix_at").isNotNull())
    texts = with_key(docs, id_col, text_col, seed).withColumn("_mix_n", F.row_number().over(
        Window.partitionBy("_mix_key").orderBy(id_col, source_col)))
    # the second condition mixes both sides so that rows stay partitioned by key alone
    read = texts.join(readings, (F.col("_mix_key") == F.col("_k")) & (F.col("_mix_n") - F.col("_m") == 0))
    return read.orderBy("_mix_at", id_col).select(*docs.columns)
