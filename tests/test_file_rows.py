"""Rows of mixed shape, and JSON documents read by byte ranges."""

import json
import random

import pytest

from tessera.sources import file_rows, files, tables
from tessera.sources.json_documents import read_json_documents


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _records(n):
    rng = random.Random(7)
    texts = ['plain', 'a } b', '"quoted" \\ {', '[}{]', 'é\n\ttab', '\\', '\\"}', '']
    for i in range(n):
        record = {"id": i, "text": rng.choice(texts) * rng.randint(0, 4)}
        if rng.random() < 0.4:
            record["metadata"] = {"deep": [{"x": rng.choice(texts)}, {}], "k": None}
        yield record


def _rows(df):
    from pyspark.sql import functions as F
    return [json.loads(r.j) for r in df.orderBy("idx").select("idx", F.to_json("raw").alias("j")).collect()]


@pytest.mark.parametrize("indent", [None, 2])
def test_documents_read_by_ranges_are_whole_and_in_order(spark, tmp_path, small_blocks, indent):
    records = list(_records(90))
    (tmp_path / "a.json").write_text(json.dumps(records[:40], indent=indent))
    (tmp_path / "b.json").write_text(json.dumps(
        {"version": {"n": 1, "s": '"records": [{'}, "tags": ["x}"], "records": records[40:], "end": 2}, indent=indent))
    (tmp_path / "c.json").write_text("[ ]")
    (tmp_path / "d.json").write_text('{"records": []}')
    got = read_json_documents(spark, str(tmp_path))
    assert _rows(got) == records
    assert [r.idx for r in got.orderBy("idx").collect()] == list(range(90))


def test_one_document_is_read_by_more_than_one_task(spark, tmp_path, small_blocks):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(list(_records(50))))
    from tessera.sources.json_documents import _pieces
    assert _pieces(spark, str(path)).select("block").distinct().count() > 3


@pytest.mark.parametrize("text", ['{"a": 1}', '"x"', '[{"a": 1}, 5]', '[{"a": 1}', '{"other": [{"a": 1}]}', '[1, 2]'])
def test_other_documents_are_errors(spark, tmp_path, text):
    path = tmp_path / "x.json"
    path.write_text(text)
    with pytest.raises(Exception):
        read_json_documents(spark, str(path)).collect()


def test_the_sink_writes_documents(spark, tmp_path):
    path = str(tmp_path / "out.json")
    rows = [(1, 'a } "b"', None), (2, None, "x")]
    files.write_json_records(spark.createDataFrame(rows, "id long, text string, `we.ird` string").repartition(3), path)
    got = _rows(read_json_documents(spark, path))
    assert sorted(got, key=lambda r: r["id"]) == [
        {"id": 1, "text": 'a } "b"', "we.ird": None}, {"id": 2, "text": None, "we.ird": "x"}]


def test_every_row_chooses_its_own_form(spark, tmp_path):
    rows = [
        {"text": "t0", "y_style": [1, 2], "metadata": {"record_id": "r0", "text_length": 9, "language": "en"}},
        {"sentence": "t1", "label": 3},
        {"text": "", "sentence": "unused", "semantic_label": None, "label": 4, "style_label": "formal"},
        {"y_semantic": None, "text": "t3", "metadata": None, "label": 8},
        {"text": "t4", "y_style": "casual", "y_semantic": 0.5, "metadata": {"source": "own", "text_length": 0}},
        {},
    ]
    path = tmp_path / "mix.jsonl"
    path.write_text("\n\n".join(json.dumps(r) for r in rows))
    got = {r.ord: r for r in file_rows.load_track(spark, "tone", str(path)).collect()}
    assert [got[i].record_id for i in range(6)] == ["r0", "tone_1", "tone_2", "tone_3", "tone_4", "tone_5"]
    assert [got[i].text for i in range(6)] == ["t0", "t1", "", "t3", "t4", ""]
    assert [got[i].label for i in range(6)] == [None, 3, None, None, 0.5, None]
    assert [got[i].labels for i in range(6)] == [[1, 2], None, None, None, None, None]
    assert [got[i].language for i in range(6)] == ["en", "ru", "ru", None, None, "ru"]
    assert [got[i].source for i in range(6)] == ["mix.jsonl"] * 4 + ["own", "mix.jsonl"]
    assert [got[i].metadata.text_length for i in range(6)] == [9, 2, 0, 2, 2, 0]
    style = [got[i].y_style for i in range(6)]
    assert [s.toPython() if s is not None else None for s in style] == [[1, 2], None, "formal", None, "casual", None]


def test_csv_and_txt_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label\n"x, ""y""",1\n,2\n')
    (tmp_path / "a.txt").write_text("one\n\n two \n")
    csv = file_rows.load_track(spark, "tone", str(tmp_path / "a.csv")).orderBy("ord").collect()
    assert [(r.record_id, r.text, r.label) for r in csv] == [("tone_0", 'x, "y"', 1.0), ("tone_1", "", 2.0)]
    txt = file_rows.load_track(spark, "semantic", str(tmp_path / "a.txt")).orderBy("ord").collect()
    assert [(r.record_id, r.text, r.label) for r in txt] == [("semantic_0", "one", None), ("semantic_1", "two", None)]


def test_sources_need_a_path(spark):
    with pytest.raises(ValueError):
        file_rows.load_sources(spark, [{"track": "tone"}])


def test_probing_labels_prefer_labels(spark):
    df = spark.sql("""
        SELECT * FROM VALUES
          (0, 'style', 'multi_label', array(3), CAST(NULL AS DOUBLE), parse_json('[5]'), parse_json('null')),
          (1, 'style', 'multi_label', CAST(array() AS array<int>), 1D, parse_json('[5, 6]'), parse_json('2')),
          (2, 'style', 'multi_label', CAST(NULL AS array<int>), 1D, parse_json('"x"'), parse_json('2')),
          (3, 'style', 'single_label', CAST(NULL AS array<int>), CAST(NULL AS DOUBLE), parse_json('4'), parse_json('2')),
          (4, 'tone', 'single_label', array(9), CAST(NULL AS DOUBLE), parse_json('4'), parse_json('2')),
          (5, 'tone', 'single_label', array(9), 7D, parse_json('4'), parse_json('2'))
        AS t(i, track, label_type, labels, label, y_style, y_semantic)""")
    got = {r.i: r.probe_label for r in tables.probing_labels(df).collect()}
    assert got == {0: [3.0], 1: [5.0, 6.0], 2: [], 3: [4.0], 4: [2.0], 5: [7.0]}
