"""Queries over files of mixed rows and over canonical views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources import file_rows, files, tables
from tessera.sources.json_documents import read_json_documents


def _mixed_lines(spark, sf_dir):
    """Labelled documents as JSON lines in four shapes, by id."""
    d = tables.table(spark, sf_dir, "documents").join(tables.table(spark, sf_dir, "labels"), "doc_id")

    def line(**fields):
        return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})

    null, text = F.lit(None).cast("string"), F.col("text")
    shapes = [
        line(text=text, y_style=F.array("quality", "toxic"), y_semantic=null,
             metadata=F.struct(F.concat(F.lit("doc_"), F.col("doc_id")).alias("record_id"),
                               F.col("lang").alias("language"), "source")),
        line(sentence=text, label=F.col("quality"), source=F.col("source")),
        line(text=text, y_semantic=F.col("toxic"),
             metadata=F.struct(F.lit(0).alias("text_length"), F.lit("abuse").alias("task_name"),
                               F.lit("dev").alias("split"))),
        line(text=text, style_label=F.concat(F.lit("s"), F.col("quality")), semantic_label=null,
             label=F.lit(7), language=F.col("lang")),
    ]
    k = F.pmod("doc_id", F.lit(4))
    value = shapes[3]
    for i in (2, 1, 0):
        value = F.when(k == i, shapes[i]).otherwise(value)
    return (d.select("doc_id", value.alias("value")).repartitionByRange(8, "doc_id")
            .sortWithinPartitions("doc_id").select("value"))


@query("file_rows_mixed", oracle="""
WITH n AS (
  SELECT d.doc_id, coalesce(d.text, '') AS text, d.lang, d.source, l.quality, l.toxic, d.doc_id % 4 AS k,
         row_number() OVER (ORDER BY d.doc_id) - 1 AS idx
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT CASE WHEN k = 0 THEN 'doc_' || CAST(doc_id AS VARCHAR) ELSE 'tone_' || CAST(idx AS VARCHAR) END AS record_id,
       CASE WHEN k IN (0, 1) THEN source ELSE 'mixed.jsonl' END AS source,
       CASE k WHEN 0 THEN lang WHEN 1 THEN 'ru' WHEN 3 THEN lang END AS language,
       CASE k WHEN 1 THEN 'train' WHEN 2 THEN 'dev' WHEN 3 THEN 'train' END AS split,
       CASE WHEN k IN (1, 3) THEN '1.0' END AS preprocessing_version,
       CASE WHEN k IN (1, 3) THEN '' END AS domain,
       CASE WHEN k = 2 THEN 'abuse' ELSE 'tone' END AS task_name,
       CAST(length(text) AS BIGINT) AS text_length, md5(text) AS text_md5,
       CASE k WHEN 1 THEN CAST(quality AS DOUBLE) WHEN 2 THEN CAST(toxic AS DOUBLE) END AS label,
       CASE WHEN k = 0 THEN CAST(quality AS VARCHAR) || ',' || CAST(toxic AS VARCHAR) END AS labels,
       CASE k WHEN 0 THEN '[' || CAST(quality AS VARCHAR) || ',' || CAST(toxic AS VARCHAR) || ']'
              WHEN 3 THEN '"s' || CAST(quality AS VARCHAR) || '"' END AS y_style
FROM n
""")
def file_rows_mixed(spark, sf_dir):
    """A JSONL file whose rows are canonical with nested
    metadata, canonical with a list label, or flat, each read by its own form."""
    path = files.scratch_path(spark, "mixed") + ".jsonl"
    _mixed_lines(spark, sf_dir).write.mode("overwrite").text(path)
    rows = file_rows.load_sources(spark, [{"track": "tone", "path": path, "source": "mixed.jsonl"}])
    return rows.select(
        "record_id", "source", "language", F.col("metadata.split").alias("split"),
        F.col("metadata.preprocessing_version").alias("preprocessing_version"),
        F.col("metadata.domain").alias("domain"), "task_name",
        F.col("metadata.text_length").alias("text_length"), F.md5("text").alias("text_md5"), "label",
        F.array_join("labels", ",").alias("labels"), F.to_json("y_style").alias("y_style"))


@query("json_document_rows", oracle="""
SELECT doc_id, md5(text) AS text_md5, lang, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents
""")
def json_document_rows(spark, sf_dir):
    """Documents written as {"records": [...]} files and read by byte
    ranges, one file by many tasks."""
    path = files.scratch_path(spark, "documents") + ".json"
    files.write_json_records(tables.table(spark, sf_dir, "documents"), path)
    raw = read_json_documents(spark, path)
    at = lambda key, kind: F.variant_get("raw", f"$.{key}", kind)
    return raw.select(at("doc_id", "bigint").alias("doc_id"), F.md5(at("text", "string")).alias("text_md5"),
                      at("lang", "string").alias("lang"), at("source", "string").alias("source"),
                      at("n_chars", "bigint").alias("n_chars"))


def _view(spark, sf_dir):
    frames = [tables.quality_records(spark, sf_dir), tables.multilabel_records(spark, sf_dir),
              tables.conversation_pairs(spark, sf_dir)]
    out = tables.canonical_view(frames[0])
    for frame in frames[1:]:
        out = out.unionByName(tables.canonical_view(frame))
    return out


_LABELLED = """
SELECT d.doc_id, d.lang, d.source, coalesce(d.text, '') AS text, l.quality, l.toxic,
       CASE WHEN l.quality <> 0 AND l.toxic <> 0 THEN '0,1' WHEN l.quality <> 0 THEN '0'
            WHEN l.toxic <> 0 THEN '1' ELSE '' END AS positives
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

_PAIRS = """
SELECT 'conv_' || CAST(u.conv_id AS VARCHAR) || '_' || CAST(u.turn AS VARCHAR) AS record_id,
       coalesce(u.text, '') AS text, coalesce(a.text, '') AS answer,
       CAST(length(a.text) > length(u.text) AS INTEGER) AS longer
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""


@query("canonical_view", oracle=f"""
WITH l AS ({_LABELLED}), p AS ({_PAIRS})
SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS record_id, 'quality' AS task_name, 'tone' AS domain, source,
       lang AS language, NULL AS y_style, CAST(quality AS DOUBLE) AS y_semantic, NULL AS pair_id,
       NULL AS contrast_type, CAST(length(text) AS BIGINT) AS text_length FROM l
UNION ALL
SELECT 'doc_' || CAST(doc_id AS VARCHAR), 'quality_toxic', 'style', source, lang, '[' || positives || ']',
       NULL, NULL, NULL, CAST(length(text) AS BIGINT) FROM l
UNION ALL
SELECT record_id, 'paraphrase', 'semantic', 'conversations', NULL, NULL, CAST(longer AS DOUBLE),
       CASE WHEN answer <> '' THEN record_id END, CASE WHEN answer <> '' THEN 'paraphrase' END,
       CAST(length(text) AS BIGINT) FROM p
""")
def canonical_view(spark, sf_dir):
    """P11 + P12: single-label, multi-label and pair records in the canonical shape."""
    return _view(spark, sf_dir).select(
        "record_id", "task_name", F.col("metadata.domain").alias("domain"),
        F.col("metadata.source").alias("source"), F.col("metadata.language").alias("language"),
        F.to_json("y_style").alias("y_style"), F.variant_get("y_semantic", "$", "double").alias("y_semantic"),
        F.col("metadata.pair_id").alias("pair_id"), F.col("metadata.contrast_type").alias("contrast_type"),
        F.col("metadata.text_length").alias("text_length"))


@query("probing_labels", oracle=f"""
WITH l AS ({_LABELLED}), p AS ({_PAIRS})
SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS record_id, 'quality' AS task_name,
       CAST(quality AS VARCHAR) AS probe_label, 1 AS n_labels FROM l
UNION ALL
SELECT 'doc_' || CAST(doc_id AS VARCHAR), 'quality_toxic', positives,
       CASE positives WHEN '' THEN 0 WHEN '0,1' THEN 2 ELSE 1 END FROM l
UNION ALL
SELECT record_id, 'paraphrase', CAST(longer AS VARCHAR), 1 FROM p
""")
def probing_labels(spark, sf_dir):
    """The labels probes are trained on; those of single-label rows are
    taken from y_semantic, as ``label`` is blanked, those of multi-label rows
    without ``labels`` from the list y_style."""
    view = _view(spark, sf_dir).withColumns({
        "label": F.lit(None).cast("double"), "labels": F.array().cast("array<int>")})
    return tables.probing_labels(view).select(
        "record_id", "task_name",
        F.array_join(F.transform("probe_label", lambda v: v.cast("int").cast("string")), ",").alias("probe_label"),
        F.size("probe_label").alias("n_labels"))
