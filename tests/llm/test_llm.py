"""The training-data operators against brute force, invariants and small hand-made cases."""

from __future__ import annotations

import collections
import itertools
import random
import re
from itertools import zip_longest

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import DATA, rows_of, sql_rows
from textlake.llm import leakage, lookalikes, mapping, mixture, nearcopies, queries, scans, sentences, splitting
from textlake.sources.tables import table

SMALL = f"{DATA}/sf0.001"
WORD = re.compile(r"[^\W_]+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert rows_of(queries.queries()[name](spark, SMALL)) == sql_rows(queries.oracle_sql()[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_other_queries_run(spark, name):
    df = queries.queries()[name](spark, SMALL)
    if name.endswith("_found"):
        rows = df.collect()
        assert len(rows) == len(set(rows)) > 0
    else:
        assert df.count() > 0


# --- 1 ---


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,é́。", max_size=400), st.integers(1, 60), st.integers(0, 40))
def test_pieces_cover_and_overlap(text, limit, overlap):
    got = splitting.pieces(text, limit, overlap)
    keep = max(0, min(overlap, limit // 2))
    if not text:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in got)
    # The overlap is the one asked for, or less by accents of a letter that the overlap can't hold whole.
    for (_, e), (s, _) in zip(got, got[1:], strict=False):
        assert s == e - keep or e - keep < s <= e and all(splitting._joined(text, i) for i in range(e - keep, s))
    assert all(b1 < b2 for (_, b1), (_, b2) in zip(got, got[1:], strict=False))
    # No neighbours could still be merged.
    own = [0, *(e for _, e in got)]
    assert all(own[i + 2] - own[i] + (keep if own[i] else 0) > limit for i in range(len(got) - 1))


def test_pieces_prefer_strong_boundaries():
    text = "One two three. Four five six.\n\nSeven eight nine. Ten."
    assert [text[a:b] for a, b in splitting.pieces(text, 34, 0)] == ["One two three. Four five six.\n\n", "Seven eight nine. Ten."]


def test_pieces_keep_accents_with_their_letter():
    text = "é" * 200
    assert all(text[a] != "́" for a, _ in splitting.pieces(text, 33, 0))


def test_very_long_text_is_split_quickly():
    text = "word " * 200_000
    assert max(b - a for a, b in splitting.pieces(text, 1200, 200)) <= 1200


def test_split_oversized_edges(spark):
    chunks = spark.createDataFrame([(1, "a b " * 10, None, "x"), (2, None, "S", "x"), (3, "", "S", "x"), (4, "c " * 9, " s > Sub", "x"), (4, "c " * 9, " s > Sub", "x"), (None, "d " * 40, "s", "x")], "chunk_id bigint, chunk_text string, section_name string, max_chars string")
    limits = spark.createDataFrame([("DEFAULT", 20, 5), ("S ", 10, 2), ("s", 30, 2), ("n", None, 1)], "section_name string, max_chars int, overlap_chars int")
    got = splitting.split_oversized(chunks, limits).collect()
    assert {r.chunk_id for r in got} == {1, 4, None}
    assert len([r for r in got if r.chunk_id == 4]) == 2 * len(splitting.pieces("c " * 9, 10, 2))
    whole = splitting.split_oversized(chunks, limits, keep_whole=True)
    assert {r.chunk_id for r in whole.collect()} == {1, 4, None}
    assert splitting.split_oversized(chunks, limits.where("false")).count() == 0
    assert splitting.split_oversized(chunks.where("false"), limits).count() == 0


# --- 2 ---

BODY = (
    "The patient should take the tablets with water before meals. Store the capsules below twenty degrees in the original package. "
    "The prescriber may reduce the amount if the patient is older. Treatment with the tablets reduced the need for rescue medicine. "
).lower().split()


def _scan(seed: int) -> tuple[str, set, list[str]]:
    r = random.Random(seed)
    words = [r.choice(BODY) for _ in range(500)]
    lines, damage, line = [], set(), ""
    for w in words:
        bad = w
        if r.random() < 0.02 and "e" in w and len(w) > 4 and w.isalpha():
            bad = w.replace("e", "c", 1)
        if len(line) + len(bad) > 60:
            lines.append(line.rstrip())
            line = ""
            if len(lines) % 18 == 17:
                n = len(lines)
                lines += [f"Page {n} of 90", "Zentrum Pharma     Confidential"]
                damage |= {(n + 1, "page_number"), (n + 2, "running_header")}
        if bad != w:
            damage.add((len(lines) + 1, "misread"))
        line += bad + " "
    return "\n".join([*lines, line.rstrip()]), damage, words


def test_scans_are_repaired(spark):
    made = {str(i): _scan(i)[:2] for i in range(40)}
    clean = [("raw_text", f"c{i}", " ".join(random.Random(i).choices(BODY, k=300)) + ".") for i in range(40)]
    rows = spark.createDataFrame([("raw_text", k, t) for k, (t, _) in made.items()] + clean + [("raw_text", "null", None), ("raw_text", "empty", "")], "field string, record_key string, text string")
    lexicon = scans.learn(rows, rows)
    got = {(r.record_key, r.line_no, r.damage) for r in scans.damaged(rows, lexicon).collect()}
    want = {(k, n, d) for k, (_, ds) in made.items() for n, d in ds}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    texts = {r.record_key: r.text for r in scans.repaired(rows, lexicon).collect()}
    assert texts["empty"] == "" and "null" not in texts
    assert "Confidential" not in texts["0"] and "Page" not in texts["0"]
    # The texts themselves: characters that differ from the truth.
    truth = {str(i): " ".join(_scan(i)[2]) for i in range(40)}
    wrong = sum(mapping.distance(a, b) for k in list(made)[:10] for a, b in zip_longest(truth[k].split(), " ".join(texts[k].split()).split(), fillvalue=""))
    before = sum(mapping.distance(a, b) for k in list(made)[:10] for a, b in zip_longest(truth[k].split(), made[k][0].split(), fillvalue=""))
    assert wrong <= 0.001 * sum(len(truth[k]) for k in list(made)[:10]) < before


def test_scan_details():
    words = {"unchanged": 100, "the": 500, "patients": 90, "is": 200, "in": 300, "and": 300, "spray": 80}
    lexicon = scans.Lexicon(words, set(words), known={"sproy": [(0.2, "spray")]})
    text = "the spray is uncha-\nnged in the sproy and in-\npatients l2 the\nand is"
    got = scans.repair(text, lexicon)
    assert set(got.damage) == {(1, "split_word"), (2, "misread"), (3, "misread")}
    assert got.text == "the spray is unchanged in the spray and in-patients 12 the and is"
    assert [scans.is_page_number(x) for x in ("- 4 -", "Page l0 of 48", "vii", "[l3]", "p. 3", "8.12.", "in 1999.", "mg", "12/60")] == [True, True, True, True, True, False, False, False, True]
    assert scans.cost("irifusion", "infusion") == pytest.approx(0.2) and scans.cost("abc", "xyz") > 1
    assert scans.cost("pati3nt", "patient") <= scans.MOST < scans.cost("patieut", "patient") and scans.cost("patieut", "patient", learned={("u", "n"): 0.3}) == pytest.approx(0.3)


def test_every_word_within_the_cost_is_a_candidate(spark):
    r = random.Random(4)
    words = {"".join(r.choices("abcdefghilmnorstuw", k=r.randrange(3, 24))) for _ in range(120)}
    tokens = set()
    for w in words:
        for n in (1, 2, 3):
            t = w
            for _ in range(n):
                meant = [(a, b) for a, b in scans.CONFUSIONS if b in t]
                if meant:
                    a, b = r.choice(meant)
                    t = t.replace(b, a, 1)
            tokens.add(t)
        i = r.randrange(len(w))
        tokens |= {w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + "3" + w[i + 1 :]}
    tokens = {t for t in tokens if t}
    found = {(x.token, x.word): x.cost for x in scans.near(spark.createDataFrame([(t,) for t in tokens], "word string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    want = {(t, w) for t in tokens for w in words if t != w and abs(len(t) - len(w)) <= 3 and (scans.cost(t, w) <= scans.MOST or scans._change(t, w))}
    assert len(want) > 300 and found.keys() >= want
    assert all(found[k] == pytest.approx(scans.cost(*k)) for k in want if scans.cost(*k) <= scans.MOST)


def test_what_scans_show_often_is_learned(spark):
    words = [f"treat{chr(97 + i)}ent" for i in range(12)]
    scanned = "\n".join(" ".join(w.replace("t", "q", 1) for w in words) for _ in range(2))
    rows = [("f", str(i), " ".join(words) + ".") for i in range(20)] + [("f", "scan", scanned), ("f", "other", " ".join(w.replace("n", "x", 1) for w in words) + ".")]
    known = scans.learn(spark.createDataFrame(rows, "field string, record_key string, text string"))
    facts = {r.word: r for r in known.facts.collect()}
    assert [(c.word, c.cost < 0.65) for c in facts["qreataent"].cands] == [("treataent", True)]
    assert "treataext" not in facts


def test_only_texts_in_doubt_are_repaired(spark):
    scans_ = [("raw_text", str(i), _scan(i)[0]) for i in range(20)]
    sound = [("raw_text", f"c{i}", " ".join(random.Random(i).choices(BODY, k=300)) + ".") for i in range(40)]
    odd = [("raw_text", "odd", " ".join(BODY[:20]) + " l2 " + " ".join(BODY[20:40]))]
    rows = spark.createDataFrame(scans_ + sound + odd, "field string, record_key string, text string")
    known = scans.learn(rows, rows)
    asked = scans._doubted(scans._needs(scans._group_of(rows, 3), known, doubted=True)).collect()
    want = {(k, t) for _, k, t in scans_ + odd}
    assert {(x.record_key, x.text) for x in asked} >= want and len(asked) < len(want) + 10
    # Their damage is that of all texts, sound ones among them.
    every = sorted(map(tuple, scans._whole(rows, known, True).where("line_no > 0").collect()))
    assert ("raw_text", "odd", 1, "misread") in every and every == sorted(map(tuple, scans.damaged(rows, known).collect()))


def test_neighbours_beyond_marks_are_asked_for_in_each_place(spark):
    core = scans.Lexicon({"form": 90}, {"form"}, siblings={"form": ["from"]})
    known = scans.Knowledge(None, core, bytes(8192), bytes(8192), bytes(8192), None, b"\xff" * 8192)
    texts = spark.createDataFrame([(0, "one - form at l2 two - form at"), (0, "l2 three - form - four")], "g int, text string").coalesce(1)
    got = {(r.a, r.b) for r in scans._needs(texts, known).where("kind = 'pair'").collect()}
    assert got >= {("one", "from"), ("two", "from"), ("three", "from"), ("from", "at"), ("from", "four")}


def test_filters_hold_their_words_and_few_others(spark):
    words = [f"w{i}" for i in range(4000)]
    bits = scans._filter(spark.createDataFrame([(w,) for w in words], "word string"))
    assert all(scans._in(bits, w) for w in words)
    assert sum(scans._in(bits, f"x{i}") for i in range(4000)) < 60


@given(st.text("aÉzB ,ß7)\n"))
def test_names_inside_sentences(text):
    assert scans.CAPITAL.findall(text) == re.findall(r"[a-zß-ÿ0-9,%)] ([A-ZÀ-Ý][^\W_]*)", text)


def test_scans_without_rows(spark):
    empty = spark.createDataFrame([], "field string, record_key string, text string")
    lexicon = scans.learn(empty, empty)
    assert scans.damaged(empty, lexicon).count() == 0


# --- 3 ---


def _brute(rows: dict[str, str], sets, least: float) -> set:
    made = {k: s for k, t in rows.items() if (s := sets(t))}
    return {(min(a, b), max(a, b)) for a, b in itertools.combinations(made, 2) if len(made[a] & made[b]) >= least * len(made[a] | made[b])}


def words3(text):
    w = WORD.findall(text.lower())
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2))


def letters3(text):
    return frozenset(p[i : i + 3] for w in WORD.findall(text.lower()) for p in [f"  {w} "] for i in range(len(p) - 2))


def test_near_pairs_equal_brute_force(spark):
    got = {(r.field, r.key_a, r.key_b) for r in queries.p3_found(spark, SMALL).collect()}
    chunks = {str(r.chunk_id): r.chunk_text for r in table(spark, SMALL, "chunks").where("chunk_text is not null").collect()}
    names = {r[0]: r[0] for r in table(spark, SMALL, "monograph_sections").select("drug_name").distinct().collect() if r[0]}
    want = {("chunk_text", *p) for p in _brute(chunks, words3, 0.7)} | {("drug_name", *p) for p in _brute(names, letters3, 0.6)}
    assert got == want


def test_near_pairs_edges(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "EXPAND", 3)
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(f"a{i}", base) for i in range(6)] + [("b", base.upper()), ("c", base + " more"), ("d", None), (None, base), ("e", ""), ("f", "one two"), ("c", base + " more"), ("g", " ".join(f"v{i}" for i in range(60)))]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "id string, text string, label int, a string")
    got = {(r.key_a, r.key_b) for r in nearcopies.near_pairs(df).collect()}
    assert got == {("a0", x) for x in ("a1", "a2", "a3", "a4", "a5", "b", "c")}
    assert nearcopies.near_pairs(df.where("false")).count() == 0


@pytest.mark.parametrize("edges", [[], [("a", "a")], [(f"{i:03}", f"{i + 1:03}") for i in range(60)], [("hub", f"n{i}") for i in range(50)] + [("x", "y")], [("a", None), ("b", "c")]])
def test_components(spark, edges):
    got = {r.key: r.group for r in nearcopies.components(spark.createDataFrame(edges, "key_a string, key_b string")).collect()}
    own = {k: k for e in edges if None not in e for k in e}
    for _ in own:
        for a, b in (e for e in edges if None not in e):
            own[a] = own[b] = min(own[a], own[b])
    assert got == own


def test_groups_hold_every_row(spark):
    rows = spark.createDataFrame([("a", "t"), ("b", None), ("c", "x"), ("a", "t")], "id string, text string")
    pairs = spark.createDataFrame([("a", "c")], "key_a string, key_b string")
    assert {tuple(r) for r in nearcopies.near_groups(rows, pairs).collect()} == {("a", "a", 1), ("c", "a", 1), ("b", "b", 0)}


def test_links_count_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "EXPAND", 3)
    base = " ".join(f"w{i}" for i in range(60))
    texts = {f"a{i}": base for i in range(6)} | {f"b{i}": base + " more" for i in range(5)} | {"c": "Two " + base, "d": "else " * 9, "e": None, "f": "one"}
    df = spark.createDataFrame([*texts.items(), ("a0", base)], "id string, text string")
    pairs = _brute({k: t for k, t in texts.items() if t}, words3, 0.8)
    links = collections.Counter(x for p in pairs for x in p)
    got = {r.id: (r.group, r.links) for r in nearcopies.near_links(df, "word", 3).collect()}
    assert got == {k: ("a0" if k[0] in "abc" else k, links[k]) for k in texts}


def test_groups_of_chunks_and_names(spark):
    links = queries.p3_links(spark, SMALL).collect()
    ends = collections.Counter((r.field, x) for r in queries.p3_found(spark, SMALL).collect() for x in (r.key_a, r.key_b))
    assert {(r.field, r.id): r.links for r in links if r.links} == ends
    assert {(r.field, r.id, r.group) for r in queries.p3_groups(spark, SMALL).collect()} == {(r.field, r.id, r.group) for r in links}


def _variants(n: int, r: random.Random, *bases: list[str]) -> dict[str, str]:
    """Texts that differ from one of the bases by one word."""
    out = {}
    for k in range(n):
        w = list(bases[k % len(bases)])
        w[r.randrange(len(w))] = f"x{k}"
        out[f"{k:05}"] = " ".join(w)
    return out


def test_a_crowd_of_variants_is_grouped_in_proportion_to_its_rows(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "REGION", 64)
    monkeypatch.setattr(nearcopies, "CROWD", 64)
    base = [f"w{i}" for i in range(200)]
    texts = _variants(3000, random.Random(1), base) | {"other": " ".join(f"v{i}" for i in range(50)), "null": None}
    compared, sure = [], nearcopies._sure
    monkeypatch.setattr(nearcopies, "_sure", lambda found, *a: compared.append(found.count()) or sure(found, *a))
    got = {r.id: r.group for r in nearcopies.near_classes(spark.createDataFrame(list(texts.items()), "id string, text string")).collect()}
    assert got == {k: "00000" if k.isdigit() else k for k in texts}
    assert sum(compared) < 30 * len(texts)  # all pairs are 1500 a text


def test_groups_of_crowded_regions_equal_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "REGION", 16)
    monkeypatch.setattr(nearcopies, "CROWD", 16)
    r = random.Random(2)
    base = [f"w{i}" for i in range(40)]
    far = [x if i % 9 else f"y{i}" for i, x in enumerate(base)]
    texts = _variants(600, r, base, far, [x if i % 7 else f"z{i}" for i, x in enumerate(base)])
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    for threshold in (0.8, 0.6):
        all_pairs = {x.id: x.group for x in nearcopies.near_links(df, "word", 2, threshold).collect()}
        assert {x.id: x.group for x in nearcopies.near_classes(df, "word", 2, threshold).collect()} == all_pairs


def test_crowded_regions_go_deeper(monkeypatch):
    import numpy as np

    label = np.sort(np.array([1 << 60] * 10 + [(1 << 60) + 1] * 3 + [5] * 2, np.uint64))
    pairs = lambda: {(int(i), int(j)) for a, b in nearcopies._neighbours(label, 2) for i, j in zip(a, b, strict=True)}
    assert len(pairs()) == 1 + 13 * 12 // 2
    monkeypatch.setattr(nearcopies, "REGION", 5)
    assert len(pairs()) == 1 + 45 + 3


def test_crowded_regions_lose_no_pair(spark, monkeypatch):
    import pyarrow as pa

    n = 60
    signed = spark.createDataFrame([(f"{i:02}", f"c{i:02}", 0, 0, 0, [(7 << 48) + i]) for i in range(n)] * 2, nearcopies.SIGNED)
    want = {(f"{a:02}", f"{b:02}") for a, b in itertools.combinations(range(n), 2)}
    monkeypatch.setattr(nearcopies, "REGION", 8)
    assert {tuple(r) for r in nearcopies.candidates(signed, 0.7, 3).collect()} == want
    columns = [[0] * n, [(7 << 48) + i for i in range(n)], [-1] * n, [0] * n, [f"{i:02}" for i in range(n)], [f"c{i:02}" for i in range(n)], *[[0] * n] * 3]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list("abcdefghi"))
    found = [p for out in nearcopies._candidates(0.7, 3)(iter([batch])) for p in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert set(found) == want


# --- 4 ---

CASES = [
    ("Dr. Lask gab z. B. 2,8 mg Velmo pro Tag. Gilt dies auch für Kinder, d. h. bei Husten?", ["Dr. Lask gab z. B. 2,8 mg Velmo pro Tag.", "Gilt dies auch für Kinder, d. h. bei Husten?"]),
    ("Voir fig. 40 et tabl. 44, etc., pour cela. La dose est de 3,5 mg.", ["Voir fig. 40 et tabl. 44, etc., pour cela.", "La dose est de 3,5 mg."]),
    ("The nurse wrote: “Avoid it. It can hurt.” Next sentence here.", ["The nurse wrote: “Avoid it. It can hurt.”", "Next sentence here."]),
    ("« Arrêtez en cas de nausées. » est imprimé sur la boîte.", ["« Arrêtez en cas de nausées. » est imprimé sur la boîte."]),
    ("半減期は14.17日でした。パッチは26℃以下で保存してください。", ["半減期は14.17日でした。", "パッチは26℃以下で保存してください。"]),
    ("能否与酒精同服？服用36个月后恶心消失。", ["能否与酒精同服？", "服用36个月后恶心消失。"]),
    ("ይህ አንድ ነው። ይህ ሁለተኛ ነው።", ["ይህ አንድ ነው።", "ይህ ሁለተኛ ነው።"]),
    ("Սա առաջինն է։ Սա երկրորդն է։", ["Սա առաջինն է։", "Սա երկրորդն է։"]),
    ("ဒါက တစ်ခုပါ။ ဒါက နှစ်ခုပါ။", ["ဒါက တစ်ခုပါ။", "ဒါက နှစ်ခုပါ။"]),
    ("នេះគឺទីមួយ។ នេះគឺទីពីរ។", ["នេះគឺទីមួយ។", "នេះគឺទីពីរ។"]),
    ("འདི་དང་པོ་ཡིན། འདི་གཉིས་པ་ཡིན།", ["འདི་དང་པོ་ཡིན།", "འདི་གཉིས་པ་ཡིན།"]),
    ("यह पहला है। यह दूसरा है।", ["यह पहला है।", "यह दूसरा है।"]),
    ("No end\n\nAnother one  ", ["No end", "Another one"]),
    ("   ", []),
    ("", []),
]


@pytest.fixture(scope="module")
def model(spark):
    return sentences.train(queries._spans(spark, f"{DATA}/sf0.01"))


@pytest.mark.parametrize(("text", "units"), CASES)
def test_sentences(model, text, units):
    assert [text[a:b] for a, b in sentences.units(text, model)] == units


def test_sentence_model_on_held_out_seams(spark, model):
    """Texts that were not seen, set behind each other: the seam is a boundary, and nothing else changes."""
    rows = queries._spans(spark, f"{DATA}/sf0.1").where("field = 'text' and lower(type) = 'sentence'").select("text").distinct().orderBy(F.xxhash64("text", F.lit(1))).limit(400).collect()
    texts = [t for r in rows if (t := r.text.strip()) and t[-1] in sentences.TERMINAL and t.isascii()]
    right = 0
    for a, b in zip(texts, texts[1:], strict=False):
        got = sentences.units(f"{a} {b}", model)
        alone = sentences.units(a, model) + [(x + len(a) + 1, y + len(a) + 1) for x, y in sentences.units(b, model)]
        right += got == alone
    assert right >= 0.97 * (len(texts) - 1)


def test_sentence_types_and_edges(spark, model):
    rows = [("f", 1, " A b. C d. ", "Bullet"), ("f", 2, "A b. C d.", "table row"), ("f", 3, "A b. C d.", "CAPTION "), ("f", 4, None, "sentence"), ("f", 5, " \n", "bullet_point"), ("f", 6, "One text here. Another text here.", None), ("f", 6, "One text here. Another text here.", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "field string, span_key bigint, text string, type string, char_start int")
    got = collections.Counter((r.span_key, r.char_start, r.char_end) for r in sentences.split(df, model).collect())
    assert got == {(1, 1, 10): 1, (2, 0, 9): 1, (3, 0, 9): 1, (6, 0, 14): 2, (6, 15, 33): 2}
    assert sentences.split(df.where("false"), sentences.train(df.where("false"))).count() == 0


# --- 5 ---


def test_mapping(spark):
    entries = spark.createDataFrame([(1, "section", "Therapeutic Indications", ["Approved Uses"]), (2, "section", "Use In Children", None), (3, "brand", "Gyxkuabrine", []), (4, "brand", "Luxbylivxyr", []), (None, "brand", "X", []), (5, "section", None, []), (6, "section", "Dose And Schedule", ["Posology"])], "ref_id bigint, kind string, entry_name string, also_known_as array<string>")
    cases = {("section", "Section 11: Therapeutqc Indications (continued)"): 1, ("section", "approved_use"): 1, ("section", "UseInChildren"): 2, ("section", "Glossary"): 0, ("section", ""): 0, ("section", "12"): 0, ("brand", "Gyxk uabrine 20mg caps"): 3, ("brand", "GYXKUABRNIE®"): 3, ("brand", "unknown"): 0, ("brand", "luxbylívxyr (R)"): 4, ("section", "D0se & Schedule"): 6, ("nokind", "x"): 0}
    values = spark.createDataFrame([(*k, 9) for k in cases] * 2 + [("brand", None, 9), (None, "x", 9)], "kind string, value string, ref_id int")
    got = mapping.match(values, entries, {"section": mapping.ACCEPT_PHRASE})
    assert {(r.kind, r.value): r.ref_id for r in got.collect()} == cases and got.count() == len(cases)
    assert {r.ref_id for r in mapping.match(values, entries.where("false")).collect()} == {0}
    assert mapping.match(values.where("false"), entries).count() == 0


def test_repairs_equal_brute_force(spark):
    r = random.Random(5)
    words = {"".join(r.choices("abcde", k=r.randrange(3, 22))) for _ in range(150)}
    tokens = set(list(words)[:10])
    for w in words:
        for _ in range(4):
            t = list(w)
            for _ in range(r.randrange(1, 4)):
                i = r.randrange(len(t)) if t else 0
                t[i : i + r.randrange(3)] = r.choices("abcdex", k=r.randrange(3))
            tokens.add("".join(t))
    tokens.discard("")
    got = {(x.token, x.word): x.alike for x in mapping.repairs(spark.createDataFrame([("k", t) for t in tokens], "kind string, token string"), spark.createDataFrame([("k", w) for w in words], "kind string, word string")).collect()}
    want = {(t, t): 1.0 for t in tokens & words}
    near = {(t, w): s for t in tokens - words for w in words if mapping.distance(t, w, mapping.REACH) <= mapping.reach(max(len(t), len(w))) and (s := mapping.similarity(t, w)) >= mapping.REPAIR}
    assert got.keys() >= want.keys() | near.keys() and all(got[k] == pytest.approx(s) for k, s in (want | near).items())


def test_mapping_is_the_same_however_rows_lie(spark):
    entries = table(spark, SMALL, "canonical_entries").where("kind = 'brand'")
    values = table(spark, SMALL, "drug_names").select(F.lit("brand").alias("kind"), F.col("brand_name").alias("value"))
    more = entries.unionByName(entries.withColumn("kind", F.lit("other"))).repartition(7)
    one = {tuple(r) for r in mapping.match(values, entries).collect()}
    assert {tuple(r) for r in mapping.match(values.unionByName(values).repartition(5), more).collect()} == one
    assert mapping.match(spark.createDataFrame([("brand", "x" * 10_000)], "kind string, value string"), entries).first().ref_id == 0


def test_mapping_reads_values_of_any_length(spark):
    long = " ".join(f"clause{chr(97 + i)}{chr(97 + j)}" for i in range(13) for j in range(13))
    entries = spark.createDataFrame([(1, "section", "Dose And Schedule", []), (2, "section", long, []), (3, "brand", "Gyxkuabrine", [])], "ref_id bigint, kind string, entry_name string, also_known_as array<string>")
    cases = {("brand", f"gyxkuabrnie ({long})"): 3, ("brand", "Gyxkuabrine" + " 20 mg" * 80): 3, ("section", "Dose" + " " * 400 + "and schedule"): 1, ("section", long.upper().replace("CLAUSEAC", "CLAVSEAC")): 2, ("section", "glossary " * 2000): 0}
    assert min(len(v) for _, v in cases) > 300
    got = mapping.match(spark.createDataFrame(list(cases), "kind string, value string"), entries, {"section": mapping.ACCEPT_PHRASE})
    assert {(r.kind, r.value): r.ref_id for r in got.collect()} == cases


def test_mapping_scores_every_name(spark):
    r = random.Random(8)
    words = ["use", "in", "children", "dose", "dosing", "schedule", "of", "therapy", "therapeutic", "cases", "warning", "warnings"]
    names = sorted({" ".join(r.choices(words, weights=[1, 9, 1, 2, 1, 1, 9, 1, 1, 2, 2, 1], k=r.randrange(1, 6))) for _ in range(80)} | {"use in children", "warning warnings"})
    values = {"uge in childen", "warning warning", "of of of use", "dose dosing dose dose", "x of y in z"}
    for name in names:
        w = [x if r.random() < 0.6 else x[:-1] + "x" for x in name.split()] + r.choices([*words, "unheard"], k=r.randrange(3))
        r.shuffle(w)
        values.add("".join(x + r.choice([" ", " ", "", "-"]) for x in w).strip(" -"))
    entries = spark.createDataFrame([(i, "k", n, []) for i, n in enumerate(names)], "ref_id bigint, kind string, entry_name string, also_known_as array<string>")
    by_name, weights = mapping.names_of(entries)
    rows, weight = by_name.collect(), {x.word: (x.weight, x.unknown) for x in weights.collect()}
    unknown = max(u for _, u in weight.values())
    alike = lambda t: {t: 1.0} if t in weight else {w: s for w in weight if mapping.token_keys(t) & mapping.word_keys(w) and (s := mapping.similarity(t, w)) >= mapping.REPAIR}
    found = {}
    want = {}
    for value in values:
        for cut in mapping.readings(value):
            for tokens in [cut, *([*cut[:i], cut[i] + cut[i + 1], *cut[i + 2 :]] for i in range(len(cut) - 1)), ["".join(cut)]]:
                for t in tokens:
                    found.setdefault(t, alike(t))
                own = [weight[max(found[t], key=lambda w: (found[t][w], w))][0] if found[t] else unknown * min(1, len(t) / 5) for t in tokens]
                for x in rows:
                    part = dict(zip(x.words, x.parts, strict=True))
                    soft = min(1.0, sum(w * max((part.get(y, 0.0) * s for y, s in found[t].items()), default=0.0) for t, w in zip(tokens, own, strict=True)) / sum(w * w for w in own) ** 0.5)
                    score = (soft + max(mapping.similarity("".join(tokens), x.whole), soft * mapping.SHUFFLED)) / 2 if soft >= mapping.LEAST else 0.0
                    if score >= mapping.ACCEPT_PHRASE:
                        want[value] = max(score, want.get(value, 0.0))
    got = {x.value: x.score for x in mapping.match(spark.createDataFrame([("k", v) for v in values], "kind string, value string"), entries, {"k": mapping.ACCEPT_PHRASE}).collect()}
    assert len(want) >= 60
    assert got == pytest.approx({v: want.get(v, 0.0) for v in values})


@pytest.mark.parametrize(("a", "b", "d"), [("", "", 0), ("abc", "abc", 0), ("abc", "acb", 1), ("abc", "ab", 1), ("abc", "xbc", 1), ("", "ab", 2)])
def test_distance(a, b, d):
    assert mapping.distance(a, b) == d


# --- 6 ---


def test_leakage_equals_brute_force(spark):
    got = {tuple(r) for r in queries.p6_found(spark, SMALL).collect()}
    grams = lambda t: {tuple(w[i : i + 13]) for w in [WORD.findall(t.lower())] for i in range(len(w) - 12)}
    items = {r.item_id: grams(r.text) for r in table(spark, SMALL, "eval_items").collect()}
    want = {(r.doc_id, i) for r in table(spark, SMALL, "documents").collect() for i, g in items.items() if g & grams(r.text)}
    assert got == want


def test_leakage_edges(spark):
    item = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"Before. {item.upper()}! after", 0), (2, None, 0), (3, "", 0), (4, "x " * 100 + " ".join(item.split()[3:16]), 0), (5, " ".join(item.split()[3:15]), 0), (None, item, 0), (6, "Say: Four short words here.", 0), (6, "Say: Four short words here.", 0)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, item), (None, item), (14, "four short words here")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.longest_run, r.best) for r in leakage.leaked(docs, items).collect()}
    assert got == {(1, 10): (40, 1.0), (1, 13): (40, 1.0), (4, 10): (13, 1.0), (4, 13): (13, 1.0), (6, 14): (0, 1.0)}
    assert leakage.leaked(docs, items.where("false")).count() == 0 and leakage.leaked(docs.where("false"), items).count() == 0


def test_hamming_blocks_miss_nothing_within_the_radius(spark):
    import numpy as np

    rng, prints = np.random.default_rng(1), np.random.default_rng(2).integers(0, 1 << 63, 40).tolist()
    own = [(26 if e else 13, i, p - (1 << 62), e) for i, p in enumerate(prints) for e in (True, False)]
    flipped = [(n, i, p ^ sum(1 << int(b) for b in rng.choice(63, leakage.BLOCKS * ((leakage.FLIPS if e else leakage.FLIPS_EXACT) + 1) - 1, replace=False))) for n, i, p, e in own]
    near = leakage.within_radius(spark.createDataFrame(flipped, "size int, wid bigint, print bigint"), spark.createDataFrame(own, "size int, wid bigint, print bigint, edited boolean"))
    assert {(r.size, r.wid) for r in near.where("wid = item_wid").collect()} == {(n, i) for n, i, _, _ in own}


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=9))
def test_similarity_of_windows(pairs):
    import numpy as np

    a, b = (np.array([x], np.uint64) for x in zip(*pairs, strict=True))
    assert leakage.similarities(a, b)[0] == pytest.approx(leakage.similarity(a[0].tolist(), b[0].tolist()))


def _edited(item: str, r: random.Random) -> str:
    """An item with one word of ten changed, and one left out."""
    w = item.split()
    at = r.randrange(10)
    out = ["new" if i % 10 == at else x for i, x in enumerate(w)]
    del out[r.randrange(len(out))]
    return " ".join(out)


def test_leakage_of_edited_items_against_brute_force(spark):
    r, texts = random.Random(6), [" ".join(random.Random(i).choices([f"w{k}" for k in range(400)], k=30 + i)) for i in range(60)]
    docs = {i: f"before {_edited(t, r)} after" for i, t in enumerate(texts)}
    hashed = [[leakage._hash(w) for w in t.split()] for t in texts]
    want = {}
    for d, t in docs.items():
        h = [leakage._hash(w) for w in t.split()]
        for i, own in enumerate(hashed):
            if len(set(h) & set(own)) < 0.5 * len(set(own)):
                continue
            for start, size, edited in leakage.item_windows(len(own)):
                for p in range(len(h) - size + 1) if edited else ():
                    s = leakage.similarity(own[start : start + size], h[p : p + size])
                    if s >= leakage.ALIKE:
                        want[d, i] = max(s, want.get((d, i), 0))
    got = {(x.doc_id, x.item_id): x.best for x in leakage.leaked(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")).where("longest_run = 0 or best < 1").collect()}
    assert len(want) >= 50 and len(got.keys() & want.keys()) >= 0.95 * len(want)
    assert all(got[k] <= want[k] + 1e-9 for k in got.keys() & want.keys())


def test_leakage_finds_all_windows_as_alike_as_asked(spark):
    r = random.Random(9)
    texts = [" ".join(r.choices(["the", "of", "and", *(f"w{k}" for k in range(90))], weights=[9, 7, 5, *[1] * 90], k=n)) for n in [1, 2, 3, 5, 8, 12, 13, 20, 25, *[26] * 8, *[30] * 6, 37, 40, 55]]
    docs = {}
    for text in texts * 4:
        w = [x if r.random() > 0.12 else f"new{r.randrange(9)}" for x in text.split()]
        docs[len(docs)] = " ".join(["before", *w, *w[: r.randrange(4)], "after"])
    number = lambda t: [leakage._hash(w) & 0xFFFFFFFF for w in t.split()]
    want = {}
    for d, t in docs.items():
        h = number(t)
        for i, own in enumerate(map(number, texts)):
            places = {}
            for start, size, edited in leakage.item_windows(len(own)):
                for p in range(len(h) - size + 1):
                    s = leakage.similarity(own[start : start + size], h[p : p + size])
                    if s >= (leakage.ALIKE if edited else 1.0):
                        places[size, p] = max(s, places.get((size, p), 0))
            if places:
                want[d, i] = (len(places), pytest.approx(max(places.values())))
    got = leakage.leaked(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string"))
    assert {(x.doc_id, x.item_id): (x.windows, x.best) for x in got.collect()} == want


# --- 7 ---


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(0, 10), st.integers(0, 4)), min_size=1, max_size=6))
def test_water_filling(rows):
    sizes, shares, caps = ({str(i): float(r[k]) for i, r in enumerate(rows)} for k in range(3))
    got = mixture.water_fill(sizes, shares, caps)
    used = {s: got[s] * sizes[s] for s in got}
    assert all(-1e-9 <= got[s] <= caps[s] + 1e-9 for s in got)
    assert sum(used.values()) <= sum(sizes.values()) + 1e-6
    open_ = [s for s in got if used[s] > 0 and got[s] < caps[s] - 1e-9]
    assert all(abs(used[a] * shares[b] - used[b] * shares[a]) < 1e-4 for a in open_ for b in open_)


def test_mixture(spark):
    rows = [(i, "big", 10) for i in range(1000)] + [(5000 + i, "small", 10) for i in range(50)] + [(9000, None, 10), (9001, "unlisted", 10), (None, "big", 0)]
    counted = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 3), ("absent", 0.1, 5), (None, 0.1, 1), ("unlisted", None, None)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixture.report(counted, targets).collect()}
    assert report["small"].repeats == 3 and report["small"].max_copies == 3 and report["small"].used_tokens == 1500
    assert report["absent"].used_tokens == 0 and report["unlisted"].used_tokens == 0
    assert abs(report["big"].actual_share + report["small"].actual_share - 1) < 1e-9
    used = mixture.mix(counted, mixture.plan(counted, targets))
    again = mixture.mix(counted.repartition(7), mixture.plan(counted, targets))
    assert sorted(map(str, used.collect())) == sorted(map(str, again.collect()))
    assert mixture.report(counted.where("false"), targets).where("used_tokens > 0").count() == 0
    assert mixture.report(counted, targets.where("false")).count() == 0


def test_every_source_meets_its_plan_but_for_one_document(spark):
    r = random.Random(7)
    sizes = {"hot": 4000, "mid": 700, "low": 40, "one": 1, "none": 0}
    rows = [(i, s, r.choice([1, 5, 400])) for s, n in sizes.items() for i in range(n)]
    counted = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("hot", 0.5, 2), ("mid", 0.3, 3), ("low", 0.15, 4), ("one", 0.05, 1), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    planned = {x.source: x for x in mixture.plan(counted, targets).collect()}
    held = collections.Counter()
    for _, s, t in rows:
        held[s] += t
    want = mixture.water_fill(dict(held), {s: x.target_share for s, x in planned.items()}, {s: x.max_repeats for s, x in planned.items()})
    assert all(planned[s].repeats == pytest.approx(want[s]) for s in want)
    for x in mixture.report(counted, targets).collect():
        assert 0 <= x.repeats * x.tokens - x.used_tokens < 400 + 1e-6


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 10), st.integers(0, 4)), min_size=1, max_size=6))
def test_plan_is_water_filling(spark, rows):
    counted = spark.createDataFrame([(i, str(i), r[0]) for i, r in enumerate(rows) if r[0]], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([(str(i), float(r[1]), r[2]) for i, r in enumerate(rows)], "source string, target_share double, max_repeats int")
    want = mixture.water_fill(*({str(i): float(r[k]) for i, r in enumerate(rows)} for k in range(3)))
    assert {x.source: pytest.approx(x.repeats) for x in mixture.plan(counted, targets).collect()} == want


def test_tokens_of_whole_texts(spark):
    docs = spark.createDataFrame([(1, "s", "hello hello"), (2, "s", None), (3, None, ""), (4, "s", "a <|endoftext|> b")], "doc_id bigint, source string, text string")
    got = {r.doc_id: r.tokens for r in mixture.with_tokens(docs).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 3


# --- 8 ---

SAME = [("café", "café"), ("Dose", "Dоse"), ("fine", "ﬁne"), ("a b", "a b"), ("tablet", "tab​let"), ("ABC 12", "ＡＢＣ １２"), ("5 µg", "5 μg"), ("self-test", "self‑test"), ("может быть", "мoжeт быть"), ("ド", "ﾄﾞ"), ("e‍́", "é"), ("Ä", "Ӓ")]
DIFFERENT = [("cafe", "café"), ("Dose", "dose"), ("m2", "m²"), ("1/2", "½"), ("a b", "a\nb"), ("10⁹", "109"), ("a, b", "a b"), ("5 mg", "5 µg")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert lookalikes.skeleton(a) == lookalikes.skeleton(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_look(a, b):
    assert lookalikes.skeleton(a) != lookalikes.skeleton(b)


def test_canonical_texts(spark):
    rows = [x for p in SAME + DIFFERENT for x in p] + [None, "", "plain\ttext"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id bigint, text string, canonical string")
    got = {r.doc_id: r.canonical for r in lookalikes.canonical(docs).collect()}
    assert len(got) == len(rows)
    for k in range(len(SAME)):
        assert got[2 * k] == got[2 * k + 1]
    for k in range(len(SAME), len(SAME) + len(DIFFERENT)):
        assert got[2 * k] != got[2 * k + 1]
    assert got[len(rows) - 3] is None and got[len(rows) - 2] == "" and got[16] == got[17] == "может быть"


def test_same_look_pairs(spark):
    rows = [(1, "Dose"), (2, "Dоse"), (3, "Dоse"), (4, "dose"), (5, None), (6, None), (None, "Dose"), (7, ""), (1, "Dose"), (8, "​")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, form int")
    assert {tuple(r) for r in lookalikes.same_look(docs).collect()} == {(1, 2), (1, 3), (7, 8)}
    assert lookalikes.same_look(docs.where("false")).count() == 0


def test_groups_of_one_look_hold_all_pairs(spark):
    rows = [(1, "Dose"), (2, "Dоse"), (3, "Dоse"), (4, "dose"), (5, None), (None, "Dose"), (7, ""), (1, "Dose"), (8, "​"), (9, "dose")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, form int")
    assert {tuple(r) for r in lookalikes.look_groups(docs).collect()} == {(1, 1, 1), (2, 1, 2), (3, 1, 2), (4, 4, 4), (7, 7, 7), (8, 7, 8), (9, 4, 4)}
    by = {r.doc_id: r for r in queries.p8_groups(spark, SMALL).collect()}
    pairs = {(a.doc_id, b.doc_id) for a in by.values() for b in by.values() if a.doc_id < b.doc_id and a.group == b.group and a.spelling != b.spelling}
    assert pairs == {tuple(r) for r in queries.p8_found(spark, SMALL).collect()}


def test_all_copies_of_a_hot_text_are_paired(spark, monkeypatch):
    rows = [(i, "Dose") for i in range(150)] + [(1000, "Dоse"), (1001, "Dоse"), (-5, "Dо​se")]
    want = {(min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(rows, 2) if x != y}
    docs = spark.createDataFrame(rows + [(i, "copy") for i in range(2000, 2150)], "doc_id bigint, text string")
    assert {tuple(r) for r in lookalikes.same_look(docs).collect()} == want
    monkeypatch.setattr(lookalikes, "SALTED", 10, raising=False)
    got = [tuple(r) for r in lookalikes.same_look(docs).collect()]
    assert set(got) == want and len(got) == len(want)


def test_look_alike_pairs_equal_brute_force(spark):
    docs = table(spark, f"{DATA}/sf0.01", "documents").where("text is not null").select("doc_id", "text").collect()
    by = collections.defaultdict(list)
    for r in docs:
        by[lookalikes.skeleton(r.text)].append(r)
    want = {(min(a.doc_id, b.doc_id), max(a.doc_id, b.doc_id)) for g in by.values() for a, b in itertools.combinations(g, 2) if a.text != b.text}
    assert {tuple(r) for r in queries.p8_found(spark, f"{DATA}/sf0.01").collect()} == want


def test_letters_off_the_table_are_found_by_the_words_of_the_documents(spark):
    # The Georgian and Cyrillic letters here are in no table; the words are, in enough documents.
    rows = [(i, f"the bottle number{'x' * i} of tablets") for i in range(6)] + [(10, "one bottle"), (11, "one ბottle"), (12, "one boттle"), (13, "one BOTTLE"), (14, "ЖЩШЫbottle"), (15, "TNFω and gene"), (16, "bottlの one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.canonical for r in lookalikes.canonical(docs).collect()}
    assert got[11] == got[10] == "one bottle" and got[13] != got[10]
    assert got[14] == "ЖЩШЫbottle" and got[15] == "TNFω and gene" and got[16] == "bottlの one"
    assert {(r.doc_id_a, r.doc_id_b) for r in lookalikes.same_look(docs).collect()} >= {(10, 11)}


def test_trie_costs():
    trie = lookalikes.Trie({"café": 5, "cafés": 2, "сор": 9})
    assert trie.canonical("café") == "café" and trie.canonical("cafe") is None
    assert trie.canonical("cжfé", cost=1, other=2, weak={"ж"}) == "café" and trie.canonical("cofé", cost=1, other=2, weak={"ж"}) is None
    assert trie.canonical("cofé", cost=1) == "café" and trie.canonical("cop") == "сор"
