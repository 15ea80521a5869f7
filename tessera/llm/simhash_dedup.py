"""SimHash near-duplicates by a byte-position inverted index (operator 6).

A 64-bit fingerprint has eight positional bytes.  Two fingerprints that differ
in at most two bits share at least six of them.  The index therefore posts
every distinct fingerprint under pairs of positional 16-bit words: with four
words and at most two of them touched, a linked pair meets under at least one
of the six word pairs.  Postings under single bytes would put 1/256 of all
fingerprints into each list, which grows with the square of the input.  Per
candidate pair the shared positional bytes are tallied, pairs below six are
dropped, and the rest is verified by the bit distance.

Lists longer than ``LIST_LIMIT`` give no pairs.  Their fingerprints are linked
exactly by another way: each one names itself and its 64 one-bit neighbours,
and two fingerprints differ in at most two bits if and only if they name a
common value.  Links go to the least fingerprint that names a value, so the
rows are 65 per fingerprint whatever the list's length.

Defined results: null and wordless texts have fingerprint zero and are linked
like any other; null ids are kept, and a component's id is its smallest known
id (null if none is known); repeated rows each get a row; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_by_key, saved, whole_text

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
POSITIONS = 8
LIST_LIMIT = 24
CHUNK = 1 << 15


def simhash(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one text.  Bytes are lower-cased and split, which
    touches ASCII letters and white space only."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))))
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(shingles), CHUNK):
        part = shingles[at:at + CHUNK]
        h = np.fromiter((digest(s, SEED) for s in part), dtype="<u8", count=len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, fp) per row; the fingerprint as a signed long."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"], "fp": np.array(
                [simhash(t) for t in batch["_text"]], dtype=np.int64)})

    slim = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    return slim.mapInPandas(rows, f"_id {slim.schema['_id'].dataType.simpleString()}, fp long")


def shared_bytes(a: Column, b: Column) -> Column:
    """Tally of equal positional bytes."""
    diff = a.bitwiseXOR(b)
    return sum((F.when(F.shiftrightunsigned(diff, 8 * k).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0)
                for k in range(POSITIONS)), F.lit(0))


def _postings(fps: DataFrame) -> DataFrame:
    """Six entries per fingerprint; the key holds the pair of word positions
    and their values."""
    words = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = [F.lit(n << 32).bitwiseOR(F.shiftleft(words[i], 16)).bitwiseOR(words[j])
            for n, (i, j) in enumerate(combinations(range(4), 2))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a != b: links between distinct fingerprints that span every pair
    within ``MAX_BITS`` bits."""
    postings = saved(_postings(fps))
    sizes = saved(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    listed = saved(join_by_key(postings, sizes, "key", "n"))

    # a list has at most LIST_LIMIT fingerprints here
    lists = (listed.filter(F.col("n") <= LIST_LIMIT).groupBy("key")
             .agg(F.sort_array(F.collect_list("fp")).alias("fps")))
    pairs = (lists.select("fps", F.posexplode("fps").alias("i", "a"))
             .select("a", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("b")))
    near = pairs.filter((shared_bytes(F.col("a"), F.col("b")) >= POSITIONS - MAX_BITS)
                        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))

    crowded = listed.filter(F.col("n") > LIST_LIMIT).select("fp").distinct()
    masks = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), k) for k in range(64)])
    named = (crowded.select("fp", F.explode(masks).alias("m"))
             .select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("value")))
    named = saved(named)
    least = named.groupBy("value").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    through = join_by_key(named, saved(least), "value", "n").filter("fp <> b").select(
        F.col("fp").alias("a"), "b")
    return near.unionByName(through).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the least fingerprint reachable.  Each round takes the least
    label around a node and then the label of that label, until nothing
    changes.  Hot labels are joined apart from the rest."""
    both = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("fp"), F.least("a", "m").alias("root")))
    while True:
        around = both.join(labels.withColumnRenamed("fp", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = saved(labels.join(around.withColumnRenamed("a", "fp"), "fp").select(
            "fp", F.col("root").alias("old"), F.least("root", "m").alias("root")))
        held = step.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        jump = saved(held.join(step.select(F.col("fp").alias("root"), F.col("root").alias("next")), "root"))
        new = saved(join_by_key(step, jump, "root", "n").select("fp", "old", F.least("root", "next").alias("root")))
        if new.filter("old <> root").isEmpty():
            return new.select("fp", "root")
        labels = new.select("fp", "root")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint and its component's smallest id."""
    rows = saved(fingerprints(docs, id_col, text_col))
    fps = saved(rows.groupBy("fp").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(fps.select("fp")))
    rooted = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("m"))
    named = saved(join_by_key(saved(rooted), saved(best), "root", "m").select("fp", "n", "component_id"))
    return join_by_key(rows, named, "fp", "n").select(
        F.col("_id").alias(id_col),
        F.right(F.concat(F.lit("0" * 15), F.lower(F.hex("fp"))), F.lit(16)).alias("fingerprint"),
        "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, with its columns: the smallest id,
    then the least text hash; rows without an id come last."""
    order = F.col(id_col).cast("string")
    if docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        # digits in the order of the numbers
        order = F.lpad((F.col(id_col).cast("decimal(20,0)") + F.lit(str(2 ** 63)).cast("decimal(20,0)"))
                       .cast("string"), 21, "0")
    key = F.concat(F.when(F.col(id_col).isNull(), "1").otherwise("0"), F.coalesce(order, F.lit("")),
                   F.lit(":"), F.sha2(whole_text(text_col), 256))
    keyed = docs.withColumn("_simhash_key", key)
    found = near_duplicates(keyed, id_col="_simhash_key", text_col=text_col)
    first = found.filter(F.col("component_id") == F.col("_simhash_key")).select("_simhash_key").distinct()
    return (keyed.join(first, "_simhash_key", "left_semi").dropDuplicates(["_simhash_key"])
            .select(*docs.columns))
