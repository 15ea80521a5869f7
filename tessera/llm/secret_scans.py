"""Secret scans with corpus-wide ownership frequency (operator 1).

Candidates are spans found by patterns.  Every candidate value is hashed and
the hashes are aggregated over the whole corpus by distinct repository and
owner.  A value seen with several owners, in many repositories or in many rows
is a copied example; another value that only one owner has, and that looks
random, is a live credential; the rest is unclear.  Spans of the three base
kinds are always reported; a *generic* token (long, mixed letters and digits)
is reported unless it is a copied example, as kind ``live`` or ``unclear``.

Defined results: a null text is empty; null owners or repositories count as
one owner or repository of their own; repeated rows each get their result;
an empty table gives an empty result; other columns are ignored or, in
``redact_secrets``, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_by_key, saved, whole_text

# fixed values: the patterns of the base kinds and their least lengths
ASSIGN = (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ASSIGN_MIN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
GENERIC = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "live")
TOLD = ("owners", "repos", "rows", "found")

#: Distinct characters that a random-looking value has at least.
LIVE_DISTINCT = 10
#: Owners, or repositories of two owners or more, from which on a value is a
#: copied example.  What one owner alone has is never an example, however many
#: of its rows and repositories hold it.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 6

SPAN_TYPE = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"
JUDGED_TYPE = ("array<struct<start:bigint,rank:int,end:bigint,kind:string,class:string,"
               "owners:bigint,repos:bigint,rows:bigint,found:bigint>>")


def _spans(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """Spans of all leftmost, non-overlapping matches with 0-based code point
    offsets.  The gaps between matches and the matches themselves alternate, so
    offsets are running sums of their lengths."""
    rank = KINDS.index(kind)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    none = F.from_json(F.lit("[]"), SPAN_TYPE)
    state = F.struct(F.lit(0).cast("bigint").alias("pos"), none.alias("out"))

    def step(acc, x):
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"),
                        F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("pos"),
                        F.when(x["hit"].isNull(), acc["out"])
                        .otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    found = F.aggregate(parts, state, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds."""
    assign = F.filter(_spans(text, "assign", ASSIGN, 2),
                      lambda s: F.length(s["value"]) >= ASSIGN_MIN)
    return F.concat(assign, _spans(text, "access", ACCESS), _spans(text, "hex", HEX))


def looks_random(value: Column) -> Column:
    """Letters and digits mixed, and enough different characters."""
    return (value.rlike("[0-9]") & value.rlike("[A-Za-z]")
            & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT))


def generic_spans(text: Column) -> Column:
    return F.filter(_spans(text, "live", GENERIC), lambda s: looks_random(s["value"]))


def has_candidate(text: Column) -> Column:
    """Cheap test that a text may hold a candidate of any kind."""
    return (text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX)
            | text.rlike(GENERIC))


def ownership(candidates: DataFrame, hash_col: str, owner_col: str, repo_col: str,
              row_col: str = "_row") -> DataFrame:
    """Per hash: distinct owners, distinct repositories (an owner's repository
    of equal name elsewhere is another one), rows and occurrences.  Nested
    aggregations, each with map-side partial sums, so a value copied into a
    third of all rows never gathers in one task."""
    per_row = candidates.groupBy(hash_col, owner_col, repo_col, row_col).agg(F.count(F.lit(1)).alias("n_found"))
    per_repo = per_row.groupBy(hash_col, owner_col, repo_col).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_found").alias("n_found"))
    per_owner = per_repo.groupBy(hash_col, owner_col).agg(
        F.count(F.lit(1)).alias("n_repos"), F.sum("n_rows").alias("n_rows"), F.sum("n_found").alias("n_found"))
    return per_owner.groupBy(hash_col).agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("n_repos").alias("n_repos"),
        F.sum("n_rows").alias("n_rows"), F.sum("n_found").alias("n_found"))


def _with_verdicts(docs: DataFrame, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """Rows of ``docs`` that may hold a candidate, packed in ``_doc``, with
    ``_base`` spans and ``_spans`` (array of start, rank, end, kind, class and
    what the ownership table says of the value)."""
    text = whole_text(text_col)
    rows = saved(docs.filter(has_candidate(text)).select(
        F.struct(*docs.columns).alias("_doc"), F.col(owner_col).alias("_owner"),
        F.col(repo_col).alias("_repo"), base_spans(text).alias("_base"),
        generic_spans(text).alias("_generic"), F.monotonically_increasing_id().alias("_row")))
    # a generic token that touches a base span is that base span
    cands = saved(rows.select("_row", "_owner", "_repo",
                         F.explode(F.concat("_base", F.filter("_generic", lambda g: ~F.exists(
                             "_base", lambda b: (b["start"] < g["end"]) & (g["start"] < b["end"]))))
                             ).alias("s"))
             .select("_row", "_owner", "_repo", "s.start", "s.rank", "s.end", "s.kind",
                     F.sha2("s.value", 256).alias("_hash"),
                     looks_random(F.col("s.value")).alias("_random")))
    owners = saved(ownership(cands, "_hash", "_owner", "_repo"))
    copied = ((F.col("n_owners") >= EXAMPLE_OWNERS)
              | ((F.col("n_owners") > 1) & (F.col("n_repos") >= EXAMPLE_REPOS)))
    judged = (join_by_key(cands, owners, "_hash", "n_found")
              .withColumn("class", F.when(copied, "example")
                          .when((F.col("n_owners") == 1) & F.col("_random"), "live")
                          .otherwise("unclear"))
              .filter((F.col("kind") != "live") | (F.col("class") != "example"))
              .withColumn("kind", F.when(F.col("kind") == "live", F.col("class")).otherwise(F.col("kind"))))
    spans = judged.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(
        "start", "rank", "end", "kind", "class", F.col("n_owners").alias("owners"), F.col("n_repos").alias("repos"),
        F.col("n_rows").alias("rows"), F.col("n_found").alias("found")))).alias("_spans"))
    return rows.select("_doc", "_base", "_row").join(spans, "_row", "left").drop("_row")


def _joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _told(spans: Column, field: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: s[field].cast("string")), ",")


def _count(spans: Column, field: str, value: str) -> Column:
    return F.size(F.filter(spans, lambda s: s[field] == value)).cast("long")


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 owner_col: str = "source", repo_col: str = "lang") -> DataFrame:
    """One row per document: counts of base kinds, digest of base spans, all
    spans, how many spans are live, copied examples or unclear, and, in the
    order of ``spans``, the owners, repositories, rows and occurrences of each
    span's value."""
    def shaped(df: DataFrame) -> DataFrame:
        base = F.sort_array("_base")
        per = [_count(F.col("_base"), "kind", k).alias(f"n_{k}") for k in KINDS[:3]]
        spans = F.coalesce("_spans", F.expr("array()").cast(JUDGED_TYPE))
        classes = [_count(spans, "class", c).alias(f"n_{n}")
                   for c, n in (("live", "owned"), ("example", "copied"), ("unclear", "unclear"))]
        return df.select(F.col(f"_doc.{id_col}").alias(id_col), *per, F.sha2(_joined(base), 256).alias("base_sha256"),
                         _joined(spans).alias("spans"), *classes,
                         *[_told(spans, name).alias(f"span_{name}") for name in TOLD])

    text = whole_text(text_col)
    slim = docs.select(*dict.fromkeys((id_col, text_col, owner_col, repo_col)))
    zero = F.lit(0).cast("long")
    clean = docs.filter(~has_candidate(text)).select(
        F.col(id_col), zero.alias("n_assign"), zero.alias("n_access"), zero.alias("n_hex"),
        F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"),
        zero.alias("n_owned"), zero.alias("n_copied"), zero.alias("n_unclear"),
        *[F.lit("").alias(f"span_{name}") for name in TOLD])
    return clean.unionByName(shaped(_with_verdicts(slim, text_col, owner_col, repo_col)))


def _without(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span replaced by a mark; overlapping spans count
    as one.  ``spans`` are sorted by start."""
    state = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["pos"]
        gap = F.substring(s["text"], (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"),
                        F.when(fresh, F.concat(acc["out"], gap, F.lit(mark)))
                        .otherwise(acc["out"]).alias("out"))

    # lambda bodies see lambda variables only, so the text rides on each span
    each = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                 text.alias("text")))
    return F.aggregate(each, state, step)


def redact_secrets(docs: DataFrame, *, text_col: str = "text", owner_col: str = "source",
                   repo_col: str = "lang", mark: str = "[secret]") -> DataFrame:
    """All rows with their columns; reported spans of the text become ``mark``."""
    found = _with_verdicts(docs, text_col, owner_col, repo_col)
    text = whole_text(F.col(f"_doc.{text_col}"))
    none = F.expr("array()").cast(JUDGED_TYPE)
    out = _without(text, F.coalesce("_spans", none), mark)
    tail = F.concat(out["out"], F.substring(text, (out["pos"] + 1).cast("int"), F.length(text)))
    masked = F.when(F.size("_spans") > 0, tail).otherwise(F.col(f"_doc.{text_col}"))
    changed = found.withColumn("_doc", F.col("_doc").withField(text_col, masked)).select("_doc.*")
    return docs.filter(~has_candidate(whole_text(text_col))).unionByName(changed)
