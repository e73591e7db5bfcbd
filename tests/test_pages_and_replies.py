"""Layout, tables, replies, document defaults and the resolution of measures, against plain versions and on odd input."""

from __future__ import annotations

import difflib
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestor.operators import extraction, layout, resolve, similar, tables
from attestor.queries import page_queries

SF = "/root/testdata/sf0.01"
WORD = "page_id long, x0 double, top double, x1 double, bottom double, text string"


def words(spark, *lines, page=1):
    """Words from (top, [(x0, text), ...]); a word is 5 points wide for each character."""
    return spark.createDataFrame([(page, float(x), float(top), float(x + 5 * len(t)), float(top + 8), t) for top, ws in lines for x, t in ws], WORD)


# --- measures --------------------------------------------------------------------------------------


def in_turn(batches, aliases, same=()):
    """Measures one after the other: each phrasing against the leaders that there are."""
    seen, leaders, out = {}, {}, []
    for raw in (x for batch in batches for x in batch):
        key = " ".join(re.sub(r"[^\w\s]", " ", (raw or "").lower()).split())
        if not key:
            out.append(("unknown_measure", "unresolved"))
            continue
        if key in aliases:
            choice = aliases[key], "alias"
        elif key in seen:
            choice = seen[key], "exact_repeat"
        else:
            scored = [(difflib.SequenceMatcher(None, key, text).ratio(), -n, name) for n, (name, text) in enumerate(leaders.items())]
            best = max(scored, default=(0.0, 0, ""))
            judged = [s for s in scored if (key, leaders[s[2]]) in same]
            if best[0] >= 0.85:
                choice = best[2], "fuzzy"
            elif judged:
                choice = max(judged)[2], "decided"
            else:
                choice = re.sub("[^a-z0-9]+", "_", raw.lower()).strip("_") or "unknown", "new"
        out.append(choice)
        seen[key] = choice[0]
        leaders.setdefault(choice[0], key)
    return out


def phrasings(n: int, seed: int) -> list[str | None]:
    rng = random.Random(seed)
    roots = ["revenue growth of segment", "operating margin", "net cash flow from operations", "order book", "é", "日本", "loans outstanding", "ab", "head-count", "head_count"]
    out = []
    for _ in range(n):
        text = list(rng.choice(roots) + rng.choice(["", "", " total", " (net)", "s"]))
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice("abcdefgh ")
        out.append(rng.choice(["".join(text), "".join(text).upper(), "Net Profit", "PAT", " ", None]) if rng.random() < 0.3 else "".join(text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_measures_are_those_of_one_pass(spark, seed):
    batches = [phrasings(90, seed), phrasings(60, seed + 10), ["revenue growth of segment", "profit after tax", None]]
    registry, got = None, []
    for batch in batches:
        df = spark.createDataFrame(list(enumerate(batch)), "seq long, measure_raw string").repartition(3)
        rows, registry = resolve.resolve_measures(df, registry)
        got += [(r["measure"], r["tier"]) for r in rows.orderBy("seq").collect()]
    assert got == in_turn(batches, resolve.MEASURES)
    assert registry.groupBy("measure").agg(F.count_if("leads").alias("n")).where("n <> 1").count() == 0


def test_judgements_join_what_is_not_similar(spark):
    batch = ["staff", "people employed", "people employed here", "staff"]
    df = spark.createDataFrame(list(enumerate(batch)), "seq long, measure_raw string")
    judged = spark.createDataFrame([("People employed", "Staff"), ("nobody", "staff")], "text string, example string")
    rows, _ = resolve.resolve_measures(df, decisions=judged)
    got = [(r["measure"], r["tier"]) for r in rows.orderBy("seq").collect()]
    assert got == in_turn([batch], resolve.MEASURES, {("people employed", "staff")}) and got[1] == ("staff", "decided")
    none, registry = resolve.resolve_measures(df.limit(0))
    assert none.count() == 0 and registry.count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=24), st.text("abc ", min_size=1, max_size=24), st.sampled_from([0.7, 0.85, 0.95]))
def test_similar_texts_share_so_many_bigrams(a, b, threshold):
    grams = lambda t: [t[i : i + 2] for i in range(len(t) - 1)]
    shared = sum(min(grams(a).count(g), grams(b).count(g)) for g in set(grams(a)))
    total = len(a) + len(b)
    if a != b and similar.similarity(a, b) >= threshold:
        assert shared >= max(1, -int(-(total * (0.5 - 1.5 * (1 - threshold)) - 1 - 1e-9) // 1))


@pytest.mark.parametrize("threshold", [0.75, 0.85, 0.92])
def test_similar_pairs_are_all_found(spark, threshold):
    texts = sorted({t for t in phrasings(160, 5) if t and len(t) > 1})
    names = spark.createDataFrame([(i, t, i % 5 > 0) for i, t in enumerate(texts)], "at long, text string, asks boolean")
    got = {(r["earlier"], r["later"]) for r in similar.similar_pairs(names, threshold).collect()}
    assert got == {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if j % 5 and similar.similarity(texts[j], texts[i]) >= threshold}
    with pytest.raises(ValueError, match="threshold"):
        similar.similar_pairs(names, 0.6)


# --- layout ----------------------------------------------------------------------------------------


def two_columns(n=10, width=60):
    return [(20 * i, [(10, "aa"), (25, "bb"), (25 + 10 + width, "cc"), (25 + 25 + width, "dd")]) for i in range(n)]


def test_gutters_need_width_lines_and_one_place(spark):
    gutter = lambda lines, t=None: layout.column_gutters(layout.text_lines(words(spark, *lines)), t).first()
    assert gutter(two_columns())["boundary"] == 35 + 30
    assert not gutter(two_columns(7))["multi_column"]  # too few lines
    assert not gutter(two_columns(width=40))["multi_column"]  # not wide enough
    assert not gutter([(t, [(x + 20 * (i % 5) if x > 30 else x, w) for x, w in ws]) for i, (t, ws) in enumerate(two_columns(20, 80))])["multi_column"]  # all over the page
    assert not gutter([(t, [(x, w if w != "bb" else "....") for x, w in ws]) for t, ws in two_columns()])["multi_column"]  # leads to page numbers
    box = spark.createDataFrame([(1, 0.0, 0.0, 500.0, 500.0)], "page_id long, x0 double, top double, x1 double, bottom double")
    assert not gutter(two_columns(), box)["multi_column"]
    mixed = two_columns(10) + [(500 + 20 * i, [(10, "full"), (35, "line"), (60, "of"), (75, "text")]) for i in range(10)]
    assert gutter(mixed)["multi_column"]  # half of the lines is enough


def test_columns_are_read_one_after_the_other(spark):
    lines = [(0, [(10, "title"), (40, "across"), (80, "both")]), *[(20 * i, ws) for i, (_, ws) in enumerate(two_columns(9), 1)], (300, [(10, "foot"), (35, "note"), (60, "here"), (85, "too")])]
    rows = words(spark, *lines).withColumn("text", F.concat("text", F.lit(":"), F.col("top").cast("int")))
    got = layout.reading_order(rows, layout.column_gutters(layout.text_lines(rows))).orderBy("position").collect()
    names = [r["text"] for r in got]
    left = [f"{w}:{20 * i}" for i in range(1, 10) for w in ("aa", "bb")]
    right = [f"{w}:{20 * i}" for i in range(1, 10) for w in ("cc", "dd")]
    assert names == ["title:0", "across:0", "both:0", *left, *right, "foot:300", "note:300", "here:300", "too:300"]
    assert layout.reading_order(rows.limit(0), layout.column_gutters(layout.text_lines(rows.limit(0)))).collect() == []


def test_blocks_have_kinds(spark):
    long = [(10 + 40 * i, "w") for i in range(12)]
    rows = words(spark, (0, [(10, "Heading")]), (100, [(10, "-"), (20, "item")]), (110, [(10, "2."), (20, "item")]), (200, [(10, "some")]), (210, [(10, "text")]), (300, long), (400, [(10, "in"), (30, "table")]))
    box = spark.createDataFrame([(1, 0.0, 408.0, 500.0, 500.0)], "page_id long, x0 double, top double, x1 double, bottom double")
    got = [r["kind"] for r in layout.block_kinds(layout.text_lines(rows), box).orderBy("block").collect()]
    assert got == ["heading", "list", "paragraph", "unknown", "table_adjacent"]
    page = layout.page_layouts(rows, box).first()
    assert page["blocks"] == 5 and page["kinds"]["list"] == 1 and page["lines"] == 7 and page["boundary"] is None


# --- tables ----------------------------------------------------------------------------------------


def test_aligned_words_make_a_table(spark):
    rows = words(
        spark, (0, [(10, "Sales"), (37, "in"), (49, "Rs"), (61, "crore")]), (20, [(100, "2024"), (160, "2025")]), (30, [(10, "North"), (38, "side"), (100, "7"), (160, "8")]), (40, [(10, "South"), (160, "9")]),
        (50, [(10, "All"), (100, "10"), (160, "11")]), (200, [(10, "no"), (60, "table")]), (210, [(10, "here"), (60, "either")]),
    )
    found = tables.aligned_cells(rows)
    got = {(r["row"], r["col"]): r["value"] for r in found.collect()}
    assert got == {(0, 1): "2024", (0, 2): "2025", (1, 0): "North side", (1, 1): "7", (1, 2): "8", (2, 0): "South", (2, 2): "9", (3, 0): "All", (3, 1): "10", (3, 2): "11"}
    assert tuple(tables.captions(found, rows).first()[1:]) == ("Sales in Rs crore", "in Rs crore")
    assert tables.aligned_cells(rows.limit(0)).collect() == []


def cells_of(spark, *tables_):
    rows = [(f"t{t}", r, c, v) for t, grid in enumerate(tables_) for r, row in enumerate(grid) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "table_id string, row int, col int, value string")


def test_structure_of_tables(spark):
    two = [["", "2024", None, "2025"], ["Item", "Actual", "Plan", "Actual"], ["Rent", "1", "2", "3 to 4"], ["Fees", "5"]]
    caption = [["A title over all", "", ""], ["Name", "FY2024", "x"], ["Rent", "1", "2"], ["Fees", "3", "4"]]
    numbers = [["a", "b"], ["1", "2"], ["3", "4"], ["x", "5"]]
    long = [["", "a group that is long", "2025"], ["n", "x", "y"], ["Rent", "1", "2"]]
    single = [["only", "row"]]
    got = {}
    for r in tables.structured(cells_of(spark, two, caption, numbers, long, single)).collect():
        got[r["table_id"], r["row"], r["col"]] = r
    assert [got["t0", 0, c]["header"] for c in range(4)] == ["Item", "2024 Actual", "2024 Plan", "2025 Actual"]
    assert got["t0", 0, 0]["row_label"] == got["t0", 0, 3]["row_label"] == "Rent" and got["t0", 0, 3]["ambiguous"] and not got["t0", 0, 1]["ambiguous"]
    assert got["t0", 1, 1]["value"] == "5" and ("t0", 1, 2) not in got
    assert got["t1", 0, 0]["value"] == "Name" and got["t1", 0, 1]["header"] is None  # the title is the only header row
    assert all(got["t2", r, c]["ambiguous"] and got["t2", r, c]["row_label"] is None for r in range(3) for c in range(2))
    assert got["t3", 0, 0]["value"] == "n"
    assert not any(k[0] == "t4" for k in got)
    asked = spark.createDataFrame([("t0", 0, 1), ("t0", 1, 2), ("t9", 0, 0)], "table_id string, row int, col int")
    found = {(r["table_id"], r["row"], r["col"]): r["value"] for r in tables.cell_at(tables.structured(cells_of(spark, two)), asked).collect()}
    assert found == {("t0", 0, 1): "1", ("t0", 1, 2): None, ("t9", 0, 0): None}


def test_fallback_only_where_ruling_fails(spark):
    pages = spark.createDataFrame([(d, 100 * d + p) for d in (1, 2, 3) for p in range(10)], "doc_id long, page_id long")
    cell = "page_id long, table_id string, row int, col int, value string"
    ruled = spark.createDataFrame([(100, "a", 0, 0, "x"), (200, "b", 0, 0, "x"), (201, "c", 0, 0, "x")], cell)
    aligned = spark.createDataFrame([(100, "d", 0, 0, "y"), (101, "e", 0, 0, "y"), (200, "f", 0, 0, "y"), (201, "g", 0, 0, "y"), (202, "h", 0, 0, "y")], cell)
    got = {(r["doc_id"], r["strategy"], r["table_id"]) for r in tables.with_fallback(pages, ruled, aligned).collect()}
    assert got == {(1, "aligned", "d"), (1, "aligned", "e"), (2, "ruled", "b"), (2, "ruled", "c")}


# --- replies ---------------------------------------------------------------------------------------

json_value = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=6)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.text('ab"\\[]{},', max_size=4), json_value, max_size=3), max_size=4), st.data())
def test_every_prefix_of_a_list_gives_its_whole_objects(objects, data):
    text = json.dumps(objects)
    cut = data.draw(st.integers(0, len(text)))
    ends, at = [], 1
    for x in objects:
        at += len(json.dumps(x))
        ends.append(at)
        at += 2
    whole = [x for x, end in zip(objects, ends, strict=True) if end <= cut]
    assert extraction.whole_objects(text[:cut]) == (whole, "whole" if cut == len(text) else "cut" if whole else "unreadable")


@pytest.mark.parametrize(("reply", "want", "state"), [
    ('[{"a": 1}, {"b": "x"}]', 2, "whole"), ('```json\n[{"a": 1}]\n```', 1, "whole"), ('```\n[{"a": 1}]', 1, "whole"), ('<think>[{"no": 1}]\n</think>\n{"facts": [{"a": 1}, {"a": 2}]}', 2, "whole"),
    ('{"a": 1}', 1, "whole"), ("[]", 0, "whole"), ("[1, null]", 0, "whole"), ('Here: [{"a": 1}, {"b": [', 1, "cut"), ('{"facts": [{"a": "]"}, {"b"', 1, "cut"), ("no list", 0, "unreadable"),
    ("", 0, "unreadable"), (None, 0, "unreadable"), ("[" * 100_000, 0, "unreadable"), ('[{"a": 1} {"b": 2}]', 1, "cut"),
])
def test_replies_are_read(spark, reply, want, state):
    got = extraction.records(spark.createDataFrame([(7, reply, "extra")], "id long, reply string, nth string"), ["id"], fields=("a", "b")).collect()
    assert {r["state"] for r in got} == {state} and sum(r["nth"] is not None for r in got) == want and {r["id"] for r in got} == {7}


def test_records_have_text_fields(spark):
    reply = json.dumps([{"subject_raw": "S", "value_raw": 12.5, "modality": None, "scope_raw": ["x"], "other": 1}])
    r = extraction.records(spark.createDataFrame([(1, reply)], "id long, reply string"), ["id"]).first()
    assert (r["subject_raw"], r["value_raw"], r["modality"], r["scope_raw"], r["measure_raw"]) == ("S", "12.5", None, '["x"]', None)
    assert extraction.records(spark.createDataFrame([], "id long, reply string"), ["id"]).collect() == []


def test_defaults_are_inherited_with_their_origin(spark):
    pages = spark.createDataFrame([(1, 1, "Report"), (1, 2, "x" * 5000), (1, 3, "no"), (2, 1, " \n"), (2, 3, "later"), (3, 2, "second")], "doc_id long, page int, text string")
    openings = {r["doc_id"]: r["opening"] for r in extraction.opening_texts(pages).collect()}
    assert openings[1].startswith("--- PAGE 1 ---\nReport\n\n--- PAGE 2 ---\nxx") and len(openings[1]) == 4000
    assert openings[2] == "" and openings[3] == "--- PAGE 2 ---\nsecond"
    full = json.dumps({"issuer": "RBI", "default_scope": "Consolidated", "default_period": "FY2023-24", "default_scale": "crore", "default_currency": 5})
    replies = spark.createDataFrame([(1, f"```json\n{full}\n```"), (2, full), (3, "[1")], "doc_id long, reply string")
    defaults = extraction.document_defaults(extraction.opening_texts(pages), replies)
    got = {r["doc_id"]: r for r in defaults.collect()}
    assert (got[1]["issuer"], got[1]["default_currency"], got[1]["document_type"]) == ("RBI", "5", None)
    assert got[2]["issuer"] is None and got[2]["default_scope"] == "unknown" and got[3]["default_scope"] == "unknown"
    raw = spark.createDataFrame([(1, "a", "Q1 FY2024-25", "", None, "Rs. in lakhs"), (1, "b", "sometime", "Standalone", " IMF ", ""), (2, "c", None, None, None, None)], "doc_id long, seq string, period_raw string, scope_raw string, issuer_raw string, table_scale string")
    got = {r["seq"]: r for r in extraction.inherited(raw, defaults).collect()}
    assert (got["a"]["period_from"], got["a"]["scope_from"], got["a"]["issuer_from"], got["a"]["scale_from"]) == ("record", "document", "document", "record")
    assert (got["b"]["period_raw"], got["b"]["scope_raw"], got["b"]["issuer_raw"], got["b"]["scale"]) == ("FY2023-24", "Standalone", "IMF", "crore")
    assert (got["c"]["period_from"], got["c"]["scale_from"]) == ("none", "none")


def test_claims_from_pages_and_replies(spark):
    text = "In FY2023-24 revenue from operations came to Rs. 120 crore. In FY2022-23 it was Rs. 100 crore, and 95 in Q1 FY2022-23."
    pages = spark.createDataFrame([("d", 1, text), ("d", 2, "nothing of note"), ("e", 1, text)], "doc_id string, page int, text string")
    fact = {"subject_raw": "Acme Ltd", "measure_raw": "Revenue", "value_raw": "120", "verbatim_quote": "revenue from operations came to Rs. 120 crore"}
    reply = json.dumps([fact, fact | {"value_raw": "Rs. 999"}, fact | {"verbatim_quote": "stands nowhere at all in this text"}, fact | {"subject_raw": " "}])[:-3]
    replies = spark.createDataFrame([("d", 0, reply)], "doc_id string, batch long, reply string")
    defaults = spark.createDataFrame([("d", json.dumps({"default_scale": "crore", "default_period": "FY2023-24"}))], "doc_id string, reply string")
    box = "doc_id string, page int, char_start int, char_end int, x0 double, top double, x1 double, bottom double"
    placed = spark.createDataFrame([("d", 1, 14, 30, 1.0, 2.0, 3.0, 4.0), ("d", 1, 31, 40, 5.0, 2.0, 9.0, 4.0)], box)
    claims, report = extraction.extract_claims(pages, replies, defaults, placed)
    got = {r["seq"]: r for r in claims.collect()}
    assert [got[f"d#0#{i}"]["rejected"] for i in range(3)] == [None, "value_mismatch", "quote_not_found"] and len(got) == 3
    first = got["d#0#0"]
    assert first["quantity"]["value"] == 1_200_000_000 and first["confidence"] == 1.0 and first["period_from"] == "document" and tuple(first["box"]) == (1.0, 2.0, 9.0, 4.0)
    found = {r["doc_id"]: r for r in report.collect()}
    assert (found["d"]["chunks"], found["d"]["cut"], found["d"]["records"], found["d"]["claims"], found["d"]["rejected"]) == (1, 1, 3, 1, 2)
    assert found["e"]["missed"] == 1 and found["e"]["records"] == 0
    bare, _ = extraction.extract_claims(pages, replies, None, placed.limit(0))
    assert {r["confidence"] for r in bare.collect()} == {0.72}


# --- pages at scale --------------------------------------------------------------------------------


def dealt(spark, monkeypatch, name):
    """How often the rows of a query are dealt anew, after they were dealt by page in parts of one size."""
    monkeypatch.setattr(page_queries, "TASK_LINES", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = page_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    parts = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500)
    assert re.search(rf"Exchange hashpartitioning\(page_id#\w+, {parts}\), REPARTITION_BY_NUM", plan)
    return plan.count("ENSURE_REQUIREMENTS")


def test_aligned_tables_deal_pages_once(spark, monkeypatch):
    assert dealt(spark, monkeypatch, "S-03_aligned_tables") == 0


def test_captions_deal_cells_and_lines_once(spark, monkeypatch):
    assert dealt(spark, monkeypatch, "S-04_captions") <= 3


def test_reading_order_deals_pages_in_parts_of_one_size(spark, monkeypatch):
    assert dealt(spark, monkeypatch, "X-11_reading_order") == 0


def test_lines_and_cells_of_odd_words(spark):
    rows = [
        (2, 10.0, 0.0, 20.0, 8.0, "b"), (2, 10.0, 1.0, 20.0, 9.0, "a"), (2, 10.0, 2.0, 20.0, 8.0, None), (2, 90.0, 0.0, 99.0, 8.0, "c"), (2, 140.0, 0.0, 150.0, 8.0, "d"),  # equal boxes go by text
        (None, 0.0, 0.0, 5.0, 8.0, "x"), (1, 5.0, 0.0, 5.0, 0.0, "flat"), *[(3, 20.0 + 100 * c, 12.0 * r, 60.0 + 100 * c, 12.0 * r + 8, f"{r}.{c}") for r in range(4) for c in range(3) if (r, c) != (1, 1)],
        (4, 0.0, 0.0, 9.0, 8.0, "one"), *[(4, 30.0 * c, 12.0 * r, 30.0 * c + 15, 12.0 * r + 8, None) for r in (2, 3, 4) for c in (0, 1)],
    ]
    rows = spark.createDataFrame(rows, WORD).repartition(3)
    got = {(r["page_id"], r["line"]): r for r in layout.text_lines(rows).collect()}
    assert {k: (r["words"], r["text"], r["gap"], r["gap_x"], r["height"]) for k, r in got.items() if k[0] != 3} == {
        (2, 0): (5, "a b c d", 70.0, 55.0, 9.0), (None, 0): (1, "x", None, None, 8.0), (1, 0): (1, "flat", None, None, 1.0), (4, 0): (1, "one", None, None, 8.0), **{(4, i): (2, "", 15.0, 22.5, 8.0) for i in (1, 2, 3)},
    }
    cells = {(r["table_id"], r["row"], r["col"]): r["value"] for r in tables.aligned_cells(rows).collect()}
    assert cells == {("3#1", r, c): f"{r}.{c}" for r in range(4) for c in range(3) if (r, c) != (1, 1)} | {("4#1", r, c): "" for r in range(3) for c in (0, 1)}
