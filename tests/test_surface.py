"""Sources, providers, the retriever and the ingestion job."""

from __future__ import annotations

import json
import logging
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.compare import DATA
from textlake import providers
from textlake.__main__ import check, ingest, stored
from textlake.retriever import Retriever
from textlake.sources import files, tables
from textlake.streaming import ingest as ingest_stream


def test_ingest_takes_what_is_new(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.md").write_text("# Uses\nIt is used for many things. It works.\n- a first item\n| a | row |\n\f# More\nA second page of text.")
    (src / "b.txt").write_bytes(b"\xff\xfe broken")
    ingest(spark, str(src), out)
    ingest(spark, str(src), out)
    now = lambda name: stored(spark, out, name)
    assert now("files").count() == 1 and now("pages").count() == 2
    assert {(r.heading, r.page_start, r.page_end) for r in now("sections").collect()} == {("Uses", 1, 1), ("More", 2, 2)}
    assert {r.text_type for r in now("spans").collect()} == {"sentence", "bullet", "table_row"}
    assert spark.read.parquet(f"{out}/log").where("not parse_success").count() == 2  # tried again
    (src / "a.md").write_text("# Uses\nChanged text of the file here.")
    # A run that breaks off before its commit counts for nothing, and the next does its work.
    real = files.pages
    monkeypatch.setattr(files, "pages", lambda df: real(df) if not (tmp_path / "out" / "pages" / "number=3").exists() else 1 / 0)
    ingest(spark, str(src), out)
    monkeypatch.undo()
    assert [r.text for r in now("pages").collect()] == ["# Uses\nChanged text of the file here."] and now("files").count() == 1
    (src / "a.md").write_text("# Uses\nChanged once more.")
    monkeypatch.setattr("textlake.__main__.structure.spans", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest(spark, str(src), out)
    monkeypatch.undo()
    assert now("pages").first().text.endswith("here.")
    ingest(spark, str(src), out)
    assert now("pages").first().text.endswith("more.") and check(spark, out)["files"] == 1


def test_changed_rows_replace_old_ones(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "t")
    put = lambda rows: spark.createDataFrame(rows, "k string, n int").coalesce(1).write.mode("append").parquet(src)
    run = lambda: ingest_stream.replace_changed(ingest_stream.arriving(spark, src, "k string, n int"), out, "k", str(tmp_path / "c"), "n")
    put([("a", 1), ("b", 1), ("a", 3)])
    run()
    assert {tuple(r) for r in ingest_stream.current(spark, out).collect()} == {("a", 3), ("b", 1)}
    put([("b", 5), ("c", 1)])
    run()
    assert {tuple(r) for r in ingest_stream.current(spark, out).collect()} == {("a", 3), ("b", 5), ("c", 1)}
    # A version without its commit mark, as a lost driver leaves it, isn't read.
    (tmp_path / "t" / "v9").mkdir()
    assert ingest_stream.current(spark, out).count() == 3


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i, f"2024-01-01 00:{i // 2:02}:00", i % 3) for i in range(60)]
    spark.createDataFrame(rows + rows[:5], "id int, at string, v int").select("id", F.col("at").cast("timestamp").alias("at"), "v").write.parquet(src)
    events = lambda: ingest_stream.arriving(spark, src, "id int, at timestamp, v int")
    ingest_stream.run_once(ingest_stream.once_each(events(), "id", "at"), str(tmp_path / "once"), str(tmp_path / "c1"))
    assert spark.read.schema("id int, at timestamp, v int").parquet(str(tmp_path / "once")).count() == 60


def test_index_is_deleted_and_restored(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    files.save_index(rows, a, 2)
    files.save_index(rows.unionByName(rows), b, 2)
    assert tuple(files.index_facts(spark, a).first()) == (1, 2)
    files.restore_index(spark, b, a)
    assert files.load_index(spark, a, 2).count() == 2
    files.truncate(spark, a)
    assert files.load_index(spark, a, 2).count() == 0
    assert files.delete_index(spark, a) and not files.delete_index(spark, a) and files.index_facts(spark, a) is None
    files.write_json(rows, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j")).first().vec_id == 1


def test_log_lines_are_json():
    record = logging.makeLogRecord({"msg": "took %d", "args": (3,), "levelname": "INFO", "name": "x", "run": 7})
    own = json.loads(files.JsonLines().format(record))
    assert (own["message"], own["level"], own["run"]) == ("took 3", "INFO", 7)


def test_cut_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="share"):
        tables.shared_folder(Cluster)
    tables.cut(spark.range(3))
    path = tables._CUT[-1]
    monkeypatch.setattr(tables, "_CUT", [path])
    tables.clear(spark)
    assert not Path(path).exists()


def test_page_offsets(spark, tmp_path):
    (tmp_path / "x.txt").write_text("abc\f \fde")
    got = [(r.page_num, r.char_start, r.char_end) for r in files.pages(files.parse(files.scan_folder(spark, str(tmp_path), ("txt",)))).orderBy("page_num").collect()]
    assert got == [(1, 0, 3), (3, 3, 5)]


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('# note\nbrand,generic\nX,"a, b"\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), "brand string, generic string").collect()] == [("X", "a, b")]
    (tmp_path / "a.json").write_text('{"BASE": ["A",\n "B"]}')
    assert files.read_json(spark, str(tmp_path / "a.json")).first()["BASE"] == ["A", "B"]


def test_index(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    path = str(tmp_path / "index")
    assert files.load_index(spark, path, 2) is None
    files.save_index(rows, path, 2)
    assert files.load_index(spark, path, 2).count() == 1
    with pytest.raises(Exception, match="(?s).*"):
        files.load_index(spark, path, 3).collect()
    with pytest.raises(Exception, match="(?s).*"):
        files.save_index(rows, path, 5)


def test_providers(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string")
    assert {r.id: list(r.embedding) for r in providers.embed(rows, "t", lambda ts: [[float(len(t))] for t in ts], 1).collect()} == {1: [2.0], 2: [0.0]}
    pairs = spark.createDataFrame([(1, 1, "q", "a"), (1, 2, "q", "bbb"), (1, 3, "q", "cc")], "query_id int, rank int, question string, text string")
    assert [r.text for r in providers.rerank(pairs, 2).orderBy("rank").collect()] == ["a", "bbb"]
    assert [r.text for r in providers.rerank(pairs, 2, lambda ps: [float(len(b)) for _, b in ps]).orderBy("rank").collect()] == ["bbb", "cc"]
    cache = spark.createDataFrame([("x", True)], "h string, positive boolean")
    images = spark.createDataFrame([("x", "1"), ("y", "2"), ("y", "2")], "h string, c string")
    assert {r.h: r.positive for r in providers.classify_once(images, "h", cache, lambda cs: [False] * len(cs), "c").collect()} == {"x": True, "y": False}
    b = providers.Budget(10)
    assert [b.wait(6, 0.0), b.wait(6, 1.0), b.wait(6, 61.0)] == [0.0, 59.0, 0.0]


def test_retriever(spark):
    r = Retriever(spark, f"{DATA}/sf0.001")
    q = spark.createDataFrame([(1, "velmotrazine", None, None), (2, "nobody", "x", "half life"), (3, None, None, None)], "query_id bigint, name string, section string, text string")
    got = {x.query_id: x for x in r.answer(q).collect()}
    assert got[1].path == "EXACT" and got[1].sources > 0 and got[2].path == "NONE" and "No evidence" in got[3].answer
    assert r.names().count() > 0 and r.section_types().count() > 0 and r.sections_of("Velmotrazine").count() > 0
    assert r.health().first().degraded is False
    assert r.get_section("velmotrazine", "contraindications").count() >= 0 and r.get_structure_image("velmotrazine").count() >= 0
    asked = spark.createDataFrame([(1, "side effects of velmotrazine"), (2, "Tell me about velmotrazine"), (3, "zzz")], "query_id bigint, text string")
    assert {x.query_id: x.path for x in r.ask(asked).collect()}.keys() == {1, 2, 3}
    assert r.search_sections(q.withColumn("text", F.lit("dose"))).count() >= 0
