"""Operators on small tables with nulls, ties, empty texts and repeated rows."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import DATA
from textlake.functions import text as T
from textlake.functions import vocabulary as V
from textlake.operators import intent, lexical, lookup, retrieve, structure, upkeep, vectors
from textlake.sources.tables import cut, small, table
from textlake.streaming import ingest


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column("t")).first()[0]


@pytest.mark.parametrize("text", ["dose and_schedule", "use in 2 children's", "a-b c", "", "émile ça", "part b - x"])
def test_header_title_is_pythons(spark, text):
    cleaned = one(spark, text, T.clean_header)
    assert one(spark, text, T.header_title) == cleaned.title()


@pytest.mark.parametrize(("header", "words"), [("WARNINGS & PRECAUTIONS", "warnings and precautions"), ("2 CONTRAINDICATIONS", "contraindications"), ("Side Effects (Unwanted)", "side effects unwanted"), ("Ω", ""), (None, None)])
def test_header_words(spark, header, words):
    assert one(spark, header, T.header_words) == words


def test_case_and_junk(spark):
    rows = spark.createDataFrame([("CONTRAINDICATIONS", True, False), ("Warnings And Precautions", False, True), ("a word", False, False), ("AB", False, False)], "t string, c boolean, i boolean")
    assert all(r.c == r.a and r.i == r.b for r in rows.withColumn("a", T.all_capitals("t")).withColumn("b", T.title_case("t")).collect())
    assert [one(spark, t, T.is_junk) for t in ("Dose ..... 12", "12 3.4", "a text", "x" * 60)] == [True, True, False, False]


def test_trigram_similarity_of_empty_and_equal(spark):
    rows = spark.createDataFrame([("", ""), ("word", "word"), ("word", None)], "a string, b string")
    assert [r[0] for r in rows.select(T.trigram_similarity("a", "b")).collect()] == [0.0, 1.0, 0.0]


@pytest.mark.parametrize(("header", "category", "confidence"), [("contraindications", "contraindications", 1.0), ("warnings and precautions", "warnings", 1.0), ("actions", "pharmacology", 0.8), ("random text here", "other", 0.0), ("dosage and administration", "dosage", 1.0), ("", "other", 0.0)])
def test_categories(spark, header, category, confidence):
    syn = spark.createDataFrame([(c, s, i) for i, (c, s) in enumerate((c, s) for c, ss in V.SYNONYMS.items() for s in ss)], "category string, synonym string, ord int")
    row = structure.categories(spark.createDataFrame([(header,), (header,)], "header string"), syn).collect()
    assert len(row) == 1 and row[0].category == category and row[0].confidence >= confidence


@pytest.mark.parametrize(("question", "name"), [("contraindications of APO-METOPROLOL", "apo-metoprolol"), ("side effects of Co-Trimoxazole", "co-trimoxazole"), ("what is Metoprolol Tartrate used for", "metoprolol tartrate"), ("tell me about Axid", "axid"), ("what are the contraindications of axid?", "axid"), ("Axid dosage", "axid")])
def test_named(spark, question, name):
    assert one(spark, question, lambda c: intent.named(F.col(c))) == name


def test_heading_candidates_leave_lists_alone(spark):
    blocks = [("2 CONTRAINDICATIONS", 700), ("", 400), ("It must not be used in the following cases.", 400), ("Do not use in:", 600), ("• Sinus bradycardia", 400), ("• Heart block", 400)]
    df = spark.createDataFrame([(1, i, t, w) for i, (t, w) in enumerate(blocks)], "id bigint, block_id int, text string, font_weight int")
    assert [r.block_id for r in structure.heading_candidates(df, "id").collect()] == [0]


def test_sections_tile_the_blocks(spark):
    rows = spark.createDataFrame([(1, "intro\n# A\nx\n\ny\n## B\nz"), (2, "only text"), (3, ""), (4, None)], "id bigint, t string")
    blocks = structure.markdown_blocks(rows.where("t is not null"), "id", "t")
    got = {(r.id, r.section_no): (r.heading, r.start_block, r.end_block, r.content) for r in structure.sections_of(blocks, blocks.where("level > 0"), "id").collect()}
    assert got == {(1, 0): (None, 0, 1, "intro"), (1, 1): ("A", 1, 4, "A\nx\ny"), (1, 2): ("B", 4, 6, "B\nz"), (2, 0): (None, 0, 1, "only text")}


def test_upkeep(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "x"), (3, "z"), (3, "y"), (None, "n")], "k int, v string")
    added = upkeep.insert_ignore(target, batch, ["k"], ["v"])
    assert sorted(map(tuple, added.collect()), key=str) == [(3, "y"), (None, "n")]
    again = upkeep.insert_ignore(target.unionByName(added.where("k is not null")), batch.where("k is not null"), ["k"], ["v"])
    assert again.count() == 0
    assert {tuple(r) for r in upkeep.delete_keys(target, batch, ["k"]).collect()} == {(1, "a")}


def test_salted_ids_differ(spark):
    rows = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other")], "i int, t string")
    ids = upkeep.salted_ids(rows, F.col("t"), F.concat("t", F.lit(":"), F.col("i").cast("string")), ["i"]).collect()
    assert len({r.row_id for r in ids}) == 3


def test_nearest_names(spark):
    typed = spark.createDataFrame([("aspirn",), ("aspirn",), ("zzzz",), (None,)], "word string")
    names = spark.createDataFrame([("Aspirin",), ("Aspiron",), (None,)], "name string")
    assert [tuple(r) for r in lookup.nearest_names(typed, names).collect()] == [("aspirn", "Aspirin", 1)]


def test_any_name_joins_by_equality(spark):
    s = spark.createDataFrame([(1, "nizatidine", "axid", None), (2, None, None, None)], "id int, drug_name string, brand_name string, generic_name string")
    q = spark.createDataFrame([(1, "AXID"), (2, "nizatidine"), (3, None)], "query_id int, name string")
    df = lookup.by_any_name(q, s)
    assert sorted(r.query_id for r in df.collect()) == [1, 2]
    assert "NestedLoop" not in df._jdf.queryExecution().toString()


def test_first_path_and_fallbacks(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    a = spark.createDataFrame([(1, 10, 1)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (2, 12, 1)], "query_id int, id int, rank int")
    got = sorted((r.query_id, r.path, r.id) for r in retrieve.first_path(q, [("A", a), ("B", b)]).collect())
    assert got == [(1, "A", 10), (2, "B", 12), (3, "NONE", None)]
    rows = spark.createDataFrame([("x", True), ("x", False), ("y", None), ("y", False)], "g string, m boolean")
    assert retrieve.or_all(rows, "g", F.col("m")).count() == 3
    hits = spark.createDataFrame([(1, i, i == 4) for i in range(1, 6)], "query_id int, rank int, w boolean")
    assert [r.rank for r in retrieve.ensure(hits, F.col("w"), 3).orderBy("place").collect()] == [4, 1, 2]


@pytest.mark.parametrize(("texts", "question", "enough"), [([], "what is gravol", False), ([("gravol is used for nausea", 0.85)], "what is gravol", True), ([("other things", 0.45)], "what is gravol", False), ([("gravol here", 0.15)], "what is gravol", False), ([("anything", None)], "is it", True)])
def test_evidence(spark, texts, question, enough):
    q = spark.createDataFrame([(1, question)], "query_id int, text string")
    hits = spark.createDataFrame([(1, i + 1, t, s) for i, (t, s) in enumerate(texts)], "query_id int, rank int, text string, score double")
    assert retrieve.evidence(q, hits, "what is the of for a an and or".split()).first().enough is enough


def test_vectors(spark):
    rows = table(spark, f"{DATA}/sf0.001", "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in vectors.knn(rows, asked, 10).collect()}
    centres = vectors.cells(rows, 16)
    near = {(r.query_id, r.vec_id) for r in vectors.knn_in_cells(vectors.with_cells(rows.select("vec_id", "embedding"), centres), asked, centres, 10, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    assert vectors.knn(rows, asked.where("false"), 3).count() == 0
    assert vectors.knn(rows.limit(3), asked.limit(1), 10).count() == 3  # fewer rows than asked for: no padding
    near = vectors.knn(rows, asked.limit(2), 12).join(rows.select("vec_id", "embedding"), "vec_id").join(asked.withColumnRenamed("embedding", "query"), "query_id")
    got = vectors.diverse(near.select("query_id", "vec_id", "query", "embedding"), 5).collect()
    assert sorted(r.place for r in got) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert all(r.vec_id == r.query_id for r in got if r.place == 1)


def test_lexical_needs_all_words(spark):
    rows = spark.createDataFrame([(1, "blood pressure"), (2, "blood"), (3, None), (4, "")], "id int, t string").withColumn("_text", F.col("t"))
    q = spark.createDataFrame([(1, "Blood pressure"), (2, "none")], "query_id int, text string")
    assert [(r.query_id, r.id) for r in lexical.rank(lexical.index(rows, "id", "t"), q, rows, "id", 5).collect()] == [(1, 1)]


def test_stream_replaces_changed_keys(spark, tmp_path):
    src, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int").write.parquet(src)
    run = lambda: ingest.replace_changed(ingest.arriving(spark, src, "k string, v int"), target, "k", state)
    run()
    spark.createDataFrame([("a", 2)], "k string, v int").write.mode("append").parquet(src)
    run()
    run()  # nothing new: nothing changes
    assert sorted(map(tuple, ingest.current(spark, target).collect())) == [("a", 2), ("b", 1)]


def test_small_and_cut(spark):
    df = spark.range(10)
    assert "Broadcast" in spark.range(5).join(small(df, 10), "id")._jdf.queryExecution().executedPlan().toString()
    assert small(df, 9) is df
    assert cut(df).count() == 10


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(5, 40))
def test_recursive_pieces_hold_all_words(text, size):
    got = structure._recursive(text, size, size // 4)
    assert all(0 < len(p) <= size for p in got)
    at = 0
    for p in got:  # pieces follow each other through the text
        at = text.index(p, max(0, at - size))
    assert "".join(text.split()) in "".join("".join(p.split()) for p in got) or sum(map(len, got)) >= len(text.strip())


def test_heading_before_and_after(spark):
    rows = spark.createDataFrame([("d", 1, "# One\ntext here\nmore"), ("d", 2, "still\n# Two\nlast")], "k string, page_num int, text string")
    blocks = structure.page_blocks(rows, "k")
    got = {(r.heading, r.page_start, r.page_end, r.content) for r in structure.sections_of(blocks, blocks.where("level > 0"), "k", "page_num").collect()}
    assert got == {("One", 1, 2, "One\ntext here\nmore\nstill"), ("Two", 2, 2, "Two\nlast")}
