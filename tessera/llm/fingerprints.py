"""Document fingerprints by consistent weighted sampling (operator 5).

A document is a weighted set: its five-word shingles (the whole word sequence
if it is shorter) with their counts as weights.  For every term k and sample j
a hash of (k, j) seeds r ~ Gamma(2,1), c ~ Gamma(2,1) and b ~ U(0,1).  With
weight w:

    t = floor(ln w / r + b),  ln a = ln c - r (t - b + 1)

and the sample is the (k, t) of least ``a``.  Two documents agree on a sample
with probability sum(min(w)) / sum(max(w)), the generalised Jaccard
similarity.  ``a`` depends on (k, j, t) alone, so the least ``a`` itself stands
for the sample and the sampling is a plain ``min`` aggregate.

Defined results: a null or blank text is one fixed term, so blank texts equal
each other and nothing else; equal texts have equal fingerprints; repeated ids
are ordered by text hash; null ids come last; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import saved, settle, whole_text, words_of

SHINGLE_WORDS = 5
SAMPLES = 16
_BITS = 21


def with_terms(df: DataFrame, words_col: str, terms_col: str) -> DataFrame:
    """Replace words by the distinct terms with counts: array of (h, n).

    Shingle hashes are folded from word hashes (1, 2, 4, then 4 + 1 words).
    Runs of the sorted hashes are the terms; a run's length is the distance of
    two run ends.  Every step is settled, since an array used twice in an
    expression is made twice."""
    def folded(a: str, b: str, step: int) -> Column:
        n = F.greatest(F.size(b) - step, F.lit(0))
        return F.slice(F.zip_with(a, F.slice(b, step + 1, n), lambda x, y: F.xxhash64(x, y)), 1, n)

    short = F.array(F.xxhash64(F.array_join(words_col, " "), F.lit(SHINGLE_WORDS)))
    df = settle(df, _one=F.transform(words_col, lambda w: F.xxhash64(w)), _short=short).drop(words_col)
    df = settle(df, _more=folded("_one", "_one", 1))
    df = settle(df, _more=folded("_more", "_more", 2))
    df = settle(df, _hs=F.when(F.size("_one") < SHINGLE_WORDS, F.col("_short"))
                .otherwise(folded("_more", "_one", 4))).drop("_one", "_more", "_short")
    once = F.transform("_hs", lambda h: F.struct(h.alias("h"), F.lit(1).alias("n")))
    longs = F.expr("array()").cast("array<bigint>")
    df = settle(df, _plain=F.size(F.array_distinct("_hs")) == F.size("_hs"))
    df = settle(df, _sorted=F.when(F.col("_plain"), longs).otherwise(F.sort_array("_hs")),
                _once=F.when(F.col("_plain"), once)).drop("_hs")
    m = F.greatest(F.size("_sorted") - 1, F.lit(0))
    after = F.concat(F.slice("_sorted", 2, m), F.array(F.lit(None).cast("bigint")))
    ends = F.filter(
        F.transform(F.arrays_zip(F.col("_sorted").alias("h"), after.alias("next")),
                    lambda z, i: F.struct(
                        z["h"].alias("h"), i.alias("i"),
                        F.coalesce(z["h"] != z["next"], F.lit(True)).alias("last"))),
        lambda z: z["last"] & z["h"].isNotNull())
    df = settle(df, _ends=ends).drop("_sorted")
    before = F.concat(F.array(F.lit(-1)), F.transform("_ends", lambda z: z["i"]))
    counted = F.filter(F.zip_with("_ends", before, lambda e, b: F.struct(
        e["h"].alias("h"), (e["i"] - b).alias("n"))), lambda t: t["h"].isNotNull())
    return settle(df, **{terms_col: F.coalesce("_once", counted)}).drop("_ends", "_once", "_plain")


def sample_key(term: Column, log_weight: Column, j: int) -> Column:
    """ln a of one term for sample ``j``."""
    first, second = F.xxhash64(term, F.lit(2 * j)), F.xxhash64(term, F.lit(2 * j + 1))
    mask = F.lit((1 << _BITS) - 1)

    def uniform(h: Column, shift: int) -> Column:
        return (F.shiftrightunsigned(h, shift).bitwiseAND(mask) + F.lit(0.5)) * F.lit(2.0 ** -_BITS)

    c = -F.log(uniform(first, 0) * uniform(first, _BITS))
    r = -F.log(uniform(first, 2 * _BITS) * uniform(second, 0))
    b = uniform(second, _BITS)
    return F.log(c) - r * (F.floor(log_weight / r + b) - b + 1)


def signatures(df: DataFrame, keys: list[str], terms_col: str, samples: int = SAMPLES) -> DataFrame:
    """Signature (array of ``samples`` longs) per key from arrays of (h, n)."""
    rows = df.select(*keys, F.explode(terms_col).alias("_t")).select(
        *keys, F.col("_t.h").alias("_h"), F.log(F.col("_t.n").cast("double")).alias("_lw"))
    least = rows.groupBy(*keys).agg(*[
        F.min(sample_key(F.col("_h"), F.col("_lw"), j)).alias(f"_s{j}") for j in range(samples)])
    return least.select(*keys, F.array(*[F.xxhash64(f"_s{j}") for j in range(samples)]).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of samples on which two signatures agree."""
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda acc, x: acc + x) / F.size(a)


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda s: F.right(
        F.concat(F.lit("0000000"), F.lower(F.hex(F.shiftrightunsigned(s, 32)))), F.lit(8))), "")


def id_key(id_col: Column) -> Column:
    """Ids as text, null too, so that joins and windows share one partitioning."""
    return F.coalesce(id_col.cast("string"), F.lit("\0"))


def next_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """(key of an id, key of the next): the next lower id, and the highest after the lowest; null is
    the lowest id.  Ids are range-partitioned; only the first id of each
    partition is looked at across partitions."""
    ids = docs.groupBy(F.col(id_col).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    ids = ids.withColumn("_o", F.struct(F.col("_key").isNotNull().alias("_known"), F.col("_key")))
    ids = saved(ids.repartitionByRange(F.col("_o").desc()).withColumn("_p", F.spark_partition_id()))
    heads = ids.groupBy("_p").agg(F.max("_o").alias("_head"))
    over = Window.partitionBy(F.lit(0)).orderBy("_p")
    heads = heads.select("_p", F.lead("_head").over(over).alias("_next_head"),
                         F.max("_head").over(Window.partitionBy(F.lit(0))).alias("_first"))
    inside = Window.partitionBy("_p").orderBy(F.col("_o").desc())
    # one row per partition of the ranged ids
    out = ids.withColumn("_inner", F.lead("_o").over(inside)).join(F.broadcast(heads), "_p")
    return out.select(id_key(F.col("_key")).alias("_id"),
                      id_key(F.coalesce("_inner", "_next_head", "_first")["_key"]).alias("_next"))


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text takes its second half from the start of the next document.
    A text passes one shuffle by id; the half that its neighbour needs passes
    another."""
    numbered = Window.partitionBy("_id").orderBy("_h")
    base = docs.select(F.col(id_col).alias("_oid"), id_key(F.col(id_col)).alias("_id"),
                       whole_text(text_col).alias("_text"),
                       F.xxhash64(whole_text(text_col)).alias("_h"))
    texts = base.drop("_oid").withColumn("_dup", F.row_number().over(numbered)).drop("_h")
    thin = (base.select("_oid", "_id", "_h", F.length("_text").alias("_n"))
            .withColumn("_dup", F.row_number().over(numbered))
            .withColumn("_more", F.lead(F.lit(True)).over(numbered)))
    link = next_ids(docs, id_col)
    thin = (thin.withColumnRenamed("_id", "_me")
            .join(link, F.col("_me") == F.col("_id")).drop("_id"))
    want = saved(thin.select(
        "_oid", F.col("_me"), F.col("_dup").alias("_me_dup"), F.floor(F.col("_n") / 2).cast("int").alias("_half"),
        F.when(F.col("_more"), F.col("_me")).otherwise(F.col("_next")).alias("_to"),
        F.when(F.col("_more"), F.col("_dup") + 1).otherwise(F.lit(1)).alias("_to_dup")))

    # the second condition mixes both sides so that rows stay partitioned by id alone
    given = (texts.join(want, (F.col("_id") == F.col("_to"))
                        & (F.col("_dup") - F.col("_to_dup") == 0))
             .select("_me", "_me_dup", "_half", F.left("_text", F.col("_half")).alias("_part")))
    both = (texts.join(given, (F.col("_id") == F.col("_me"))
                       & (F.col("_dup") - F.col("_me_dup") == 0))
            .select("_id", "_dup", "_text", F.concat(
                F.left("_text", F.length("_text") - F.col("_half")), F.col("_part")).alias("_edited")))
    terms = settle(both, _n=F.length("_text").cast("long"), _sha=F.sha2("_edited", 256),
                   _sides=F.array("_text", "_edited")).drop("_text", "_edited")
    sides = terms.select("_id", "_dup", "_n", "_sha", F.posexplode("_sides").alias("_side", "_t"))
    sides = settle(sides, _w=words_of(F.col("_t"))).drop("_t")
    sides = with_terms(sides, "_w", "_terms")
    sig = signatures(sides, ["_id", "_dup", "_n", "_sha", "_side"], "_terms", samples)
    pair = saved(sig.groupBy("_id", "_dup", "_n", "_sha").agg(
        F.max(F.when(F.col("_side") == 0, F.col("signature"))).alias("_sig"),
        F.max(F.when(F.col("_side") == 1, F.col("signature"))).alias("_esig")))

    follower = pair.select(F.col("_id").alias("_fid"), F.col("_dup").alias("_fdup"),
                           F.col("_sig").alias("_fsig"))
    step = pair.join(want, (F.col("_id") == F.col("_me")) & (F.col("_dup") == F.col("_me_dup")))
    out = step.join(follower, (F.col("_to") == F.col("_fid")) & (F.col("_to_dup") == F.col("_fdup")))
    return out.select(
        F.col("_oid").alias(id_col), F.col("_n").alias("n_chars"), F.col("_sha").alias("edited_sha256"),
        as_text(F.col("_sig")).alias("fingerprint"), as_text(F.col("_esig")).alias("edited_fingerprint"),
        likeness(F.col("_sig"), F.col("_esig")).alias("near_edited"),
        likeness(F.col("_sig"), F.col("_fsig")).alias("near_next"))
