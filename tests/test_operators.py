from datetime import date
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from attestor import registry
from attestor.operators import clusters, documents, graph, pairs, resolve, retrieval
from attestor.sources import store
from attestor.sources.claims import claims
from attestor.streaming import ingest

SF = "/root/testdata/sf0.001"
CLAIM = "seq long, fact_id string, doc_id string, page int, subject string, measure string, value_kind string, value decimal(30,8), unit string, currency string, sig_figs int, text_value string, period_kind string, period_start date, period_end date, period_label string, scope string, modality string, issuer string, segment string, basis string, confidence double"
FY24 = ("duration", date(2023, 4, 1), date(2024, 3, 31), "FY2023-24")
Q1 = ("duration", date(2024, 4, 1), date(2024, 6, 30), "Q1 FY2024-25")


def claim(seq, value=100, period=FY24, scope="unknown", modality="asserted", issuer=None, segment=None, basis=None, currency="INR", text=None, figs=3, doc=None, confidence=1.0):
    kind = "text" if text is not None else "quantity"
    number = (Decimal(str(value)), "currency", currency, figs) if text is None else (None, None, None, None)
    return (seq, f"f{seq}", doc or f"d{seq}", 1, "acme", "revenue", kind, *number, text, *(period or (None,) * 4), scope, modality, issuer, segment, basis, confidence)


def relation(spark, a, b):
    rows = pairs.adjudicate(pairs.gate(pairs.cluster_pairs(spark.createDataFrame([a, b], CLAIM)))).collect()
    r = rows[0]
    return r["relation"], r["relation_reason"], r["relation_confidence"], r["source_id"]


INSTANT = lambda d: ("instant", d, d, str(d))


@pytest.mark.parametrize(
    "a,b,expected",
    [
        (dict(value=1204000000, figs=4), dict(value=321000000, period=Q1), ("apparent_conflict", "period_disjoint", 0.85)),
        (dict(scope="standalone"), dict(scope="consolidated", value=200), ("apparent_conflict", "scope_mismatch", 0.85)),
        (dict(value=1204000000, figs=4), dict(value=1204000000, figs=4), ("corroborates", "value_match", 0.99)),
        (dict(value=1204, figs=4), dict(value=1312, figs=4), ("contradicts", "value_mismatch", 0.76)),
        (dict(currency="INR"), dict(currency="USD", value=5), ("apparent_conflict", "unit_mismatch", 0.85)),
        (dict(period=None), dict(), ("unrelated", "ambiguous_period", 0.5)),
        (dict(period=("duration", None, None, "some time")), dict(), ("unrelated", "ambiguous_period", 0.5)),
        (dict(text="x"), dict(), ("unrelated", "value_kind_mismatch", 0.5)),
        (dict(issuer="IMF", modality="projected", value=6.5, figs=2), dict(issuer="RBI", modality="projected", value=7.2, figs=2), ("apparent_conflict", "forecast_disagreement", 0.85)),
        (dict(issuer="IMF"), dict(issuer="RBI", value=200), ("contradicts", "value_mismatch", 0.95)),
        (dict(segment="a"), dict(segment="b", value=900), ("apparent_conflict", "segment_mismatch", 0.85)),
        (dict(segment=""), dict(segment="b"), ("corroborates", "value_match", 0.99)),
        (dict(basis="audited"), dict(basis="unaudited", value=900), ("apparent_conflict", "basis_mismatch", 0.85)),
        (dict(), dict(period=("duration", date(2023, 4, 1), date(2023, 6, 30), "Q1"), value=30), ("aggregates_into", "period_subsumption", 0.8)),
        (dict(), dict(period=("duration", date(2024, 1, 1), date(2024, 12, 31), "CY"), value=30), ("apparent_conflict", "period_overlap", 0.85)),
        (dict(text="Active "), dict(text="active"), ("corroborates", "value_match", 0.9)),
        (dict(text="active"), dict(text="resigned"), ("contradicts", "value_mismatch", 0.7)),
    ],
)
def test_gate_and_adjudication(spark, a, b, expected):
    assert relation(spark, claim(1, **a), claim(2, **b))[:3] == expected


def test_later_statement_supersedes(spark):
    early, late = dict(text="active", period=INSTANT(date(2024, 3, 31))), dict(text="resigned", period=INSTANT(date(2025, 3, 12)))
    assert relation(spark, claim(1, **early), claim(2, **late)) == ("supersedes", "temporal_succession", 0.9, "f2")
    assert relation(spark, claim(1, **late), claim(2, **early)) == ("supersedes", "temporal_succession", 0.9, "f1")
    assert relation(spark, claim(1, **early), claim(2, **(late | dict(text="active"))))[:3] == ("corroborates", "restated_unchanged", 0.85)


def test_objections_behind_the_first(spark):
    df = spark.createDataFrame([claim(1, scope="standalone", basis="audited", segment="a"), claim(2, scope="consolidated", basis="unaudited", segment="b", period=Q1, currency="USD")], CLAIM)
    r = pairs.investigate(pairs.cluster_pairs(df)).first()
    assert r["objections"] == ["scope_mismatch", "segment_mismatch", "unit_mismatch", "period_disjoint", "basis_mismatch"]
    assert r["blocking"] == ["scope", "segment", "currency", "period", "basis"] and len(r["dimensions"]) == 12
    assert [a["safe"] for a in r["actions"]] == [True, True, False, True, True]


def test_pairs_skip_pages_and_own_agreement(spark):
    same_page = spark.createDataFrame([claim(1, doc="d"), claim(2, doc="d")], CLAIM)
    assert pairs.cluster_pairs(same_page).count() == 0
    other_page = same_page.withColumn("page", F.col("seq").cast("int"))
    assert pairs.cluster_pairs(other_page).count() == 1 and pairs.relations(pairs.cluster_pairs(other_page)).count() == 0


def test_delta_pairs_are_those_with_a_new_claim(spark):
    df = spark.createDataFrame([claim(i) for i in range(6)], CLAIM)
    got = pairs.delta_pairs(df.where("seq >= 4"), df.where("seq < 4")).select("a_seq", "b_seq").collect()
    assert sorted(tuple(r) for r in got) == sorted([(4, 5)] + [(n, o) for n in (4, 5) for o in range(4)])


def test_cluster_join_needs_no_python_and_no_cross_join(spark):
    plan = pairs.relations(pairs.cluster_pairs(claims(spark, SF)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_dedupe_keeps_the_first_most_confident(spark):
    rows = [(*claim(1, doc="d"), 1), (*claim(2, doc="d", confidence=0.8), 2), (*claim(3, doc="d"), 3), (*claim(4, doc="e"), 1)]
    kept, extra = clusters.dedupe(spark.createDataFrame(rows, CLAIM + ", span int"))
    assert {r["fact_id"] for r in kept.collect()} == {"f1", "f4"}
    assert sorted((r["fact_id"], r["span"]) for r in extra.collect()) == [("f1", 2), ("f1", 3)]


def test_ladder_and_decisions(spark):
    rung, rounds, reason = retrieval.ladder(F.col("n"))
    got = {r["n"]: tuple(r)[1:] for r in spark.createDataFrame([(x,) for x in (0, 9, 10, 99, 100, 500)], "n int").select("n", rung, rounds, reason).collect()}
    assert got == {0: (10, 1, "no_candidates_found"), 9: (10, 1, "no_further_candidates"), 10: (25, 2, "no_further_candidates"), 99: (100, 4, "no_further_candidates"), 100: (100, 4, "budget_exhausted"), 500: (100, 4, "budget_exhausted")}
    assert [retrieval.decide(*x) for x in ((0, 0, 10), (3, 10, 10), (10, 10, 10), (6, 10, 10), (2, 5, 10), (50, 100, 100))] == ["no_candidates_found", "expand", "expand", "sufficient_candidates", "no_further_candidates", "budget_exhausted"]
    assert retrieval.RetrievalConfig.parsed("50, 10,x,10,-3", "no").ladder == (10, 50) and retrieval.RetrievalConfig.parsed("").ladder == (10, 25, 50, 100)


def test_full_ladder_is_brute_force(spark):
    """With as many candidates as the block holds, retrieval gives every pair of the block."""
    v = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)], i % 2) for i in range(20)], "vec_id long, embedding array<float>, label int")
    hits = retrieval.cosine(v, v, "vec_id", "label", "embedding")
    assert retrieval.candidate_pairs(hits, "vec_id", 100).count() == 2 * 45


def test_neighborhood_bounds(spark):
    g = spark.createDataFrame([("entity:a", f"fact:{i:02}", "HAS_FACT") for i in range(10)] + [("fact:00", "evidence:x", "SUPPORTED_BY")], "source string, target string, type string")
    full = graph.neighborhood(g, "entity:a", 2)
    assert full.count() == 12 and not full.first()["truncated"]
    cut = graph.neighborhood(g, "entity:a", 2, max_nodes=4)
    assert [r["node"] for r in cut.orderBy("depth", "node").collect()] == ["entity:a", "fact:00", "fact:01", "fact:02"] and cut.first()["truncated"]
    fan = graph.neighborhood(g, "entity:a", 1, max_fanout=3)
    assert fan.count() == 4 and fan.first()["truncated"]
    assert graph.neighborhood(g, "entity:none", 2).count() == 0


def test_packing_and_splitting(spark):
    rows = spark.createDataFrame([("g", i, s) for i, s in enumerate([3000, 2500, 600, 7000, 10, 5990, 1])], "g string, o long, s long")
    assert [r["batch"] for r in documents.pack(rows, "g", "o", "s").orderBy("o").collect()] == [0, 0, 1, 2, 3, 3, 4]
    for text in ("", "a", "word " * 500, "x" * 2500, "a b\nc " * 300):
        parts = documents.split_pieces(text, 1000)
        assert "".join(parts) == text and max(map(len, parts)) <= 1000
    parts = documents.split_rows("h1|h2", [f"row{i}|{'v' * 30}" for i in range(50)], 300)
    assert all(p.startswith("h1|h2\n") and len(p) <= 300 for p in parts) and sum(p.count("row") for p in parts) == 50


def test_cell_of_box(spark):
    box = "x0 double, top double, x1 double, bottom double"
    spans = spark.createDataFrame([(1, 1, 11.0, 11.0, 19.0, 19.0), (2, 1, 11.0, 11.0, 39.0, 19.0), (3, 1, 500.0, 0.0, 510.0, 5.0)], f"span_id long, page_id long, {box}")
    tables = spark.createDataFrame([("t", 1, 10.0, 10.0, 50.0, 50.0)], f"table_id string, page_id long, {box}")
    cells = spark.createDataFrame([("t", 0, 0, 10.0, 10.0, 20.0, 20.0), ("t", 0, 1, 30.0, 10.0, 50.0, 20.0)], f"table_id string, row int, col int, {box}")
    assert {r["span_id"]: (r["row"], r["col"]) for r in documents.cell_of_box(spans, tables, cells).collect()} == {1: (0, 0), 2: (None, None), 3: (None, None)}


def test_measures_resolve_in_order_of_arrival(spark):
    raw = ["Net Profit", "Order intake", "order-intake", "Order intakes", "Headcount", "", "Order intake"]
    df = spark.createDataFrame(list(enumerate(raw)), "seq long, measure_raw string")
    rows, registry_ = resolve.resolve_measures(df)
    assert [(r["measure"], r["tier"]) for r in rows.orderBy("seq").collect()] == [
        ("profit_after_tax", "alias"), ("order_intake", "new"), ("order_intake", "exact_repeat"), ("order_intake", "fuzzy"), ("headcount", "new"), ("unknown_measure", "unresolved"), ("order_intake", "exact_repeat"),
    ]
    later, _ = resolve.resolve_measures(spark.createDataFrame([(0, "Order intakez")], df.schema), registry_)
    assert later.first()["measure"] == "order_intake"


@pytest.mark.parametrize("backend", ["parquet", "json"])
def test_store_round_trip(spark, tmp_path, backend):
    facts = spark.createDataFrame([claim(i) for i in range(5)], CLAIM)
    s = store.open_store(spark, f"file://{tmp_path}/a", backend)
    assert "facts" not in s.load() and s.load()["documents"].count() == 0
    s.save({"facts": facts})
    s.upsert({"facts": facts.where("seq = 1").withColumn("scope", F.lit("segment")).unionByName(spark.createDataFrame([claim(9)], CLAIM))})
    got = s.load()["facts"]
    assert got.count() == 6 and got.where("seq = 1").first()["scope"] == "segment"
    other = store.open_store(spark, f"file://{tmp_path}/b", "json" if backend == "parquet" else "parquet")
    assert store.migrate(s, other).count() == 0
    with pytest.raises(ValueError):
        store.migrate(s, other)
    with pytest.raises(ValueError):
        store.open_store(spark, "x", "postgres")


def test_deletion_cascades_and_saves_append(spark, tmp_path):
    s = store.ParquetStore(spark, f"file://{tmp_path}/s")
    facts = spark.createDataFrame([claim(i) for i in range(4)], CLAIM)
    links = spark.createDataFrame([("f0", "f1", "corroborates"), ("f2", "f3", "contradicts")], "source_id string, target_id string, relation string")
    s.save_new({"facts": facts, "relations": links})
    s.save_new({"facts": spark.createDataFrame([claim(7)], CLAIM)})
    assert s.load()["facts"].count() == 5
    s.delete_facts(spark.createDataFrame([("f0",)], "fact_id string"))
    assert s.load()["facts"].count() == 4 and s.load()["relations"].count() == 1


def test_vectors_and_facts_share_a_store(spark, tmp_path):
    s = store.ParquetStore(spark, f"file://{tmp_path}/s")
    facts = spark.createDataFrame([claim(i) for i in range(4)], CLAIM)
    s.save({"facts": facts})
    v, lex = store.VectorTable(s), store.LexicalTable(s)
    assert v.all() is None
    row = lambda i, x: (f"f{i}", f"b{i % 2}", [float(x), 1.0])
    schema = "fact_id string, block_key string, vector array<double>"
    v.upsert(spark.createDataFrame([row(i, i) for i in range(6)], schema))
    lex.upsert(spark.createDataFrame([(f"f{i}", "b0", f"subject: acme measure: revenue {w}") for i, w in enumerate(["net sales", "gross sales", "profit"])], "fact_id string, block_key string, retrieval_text string"))
    v.delete(spark.createDataFrame([("f4",), ("unknown",)], "fact_id string"))
    v.upsert(spark.createDataFrame([row(2, -9)], schema))
    ids = lambda: {r["fact_id"]: r["vector"][0] for r in v.all().collect()}
    assert ids() == {"f0": 0.0, "f1": 1.0, "f2": -9.0, "f3": 3.0, "f5": 5.0} and s.load()["facts"].count() == 4
    found = v.search(v.all().where("fact_id = 'f1'"), 2).orderBy("rank").collect()
    assert [r["fact_id"] for r in found] == ["f3", "f5"]
    s.save({"facts": facts.limit(1)})  # the index stays
    s.save_new({"facts": facts.where("fact_id = 'f3'")})
    v.compact()
    assert ids() == {"f0": 0.0, "f1": 1.0, "f2": -9.0, "f3": 3.0, "f5": 5.0} and len(s.manifest()["vectors"]) == 1
    assert s.load()["facts"].count() == 2 and {r["block_key"]: r["rows"] for r in v.summary().collect()} == {"b0": 2, "b1": 3}
    asked = spark.createDataFrame([("f9", "b0", "measure: sales")], "query string, block_key string, text string")
    assert {r["fact_id"] for r in lex.search(asked, 5).collect()} == {"f0", "f1"}
    v.delete(v.all().select("fact_id"))
    assert v.all().count() == 0


def test_two_writers_of_one_version_do_not_both_win(spark, tmp_path):
    s = store.ParquetStore(spark, f"file://{tmp_path}/s")
    s.save({"facts": spark.createDataFrame([claim(1)], CLAIM)})
    with pytest.raises(RuntimeError):
        s._publish(1, {})
    assert s.version() == 1 and s.load()["facts"].count() == 1


def test_documents_that_come_in_several_batches_lose_nothing(spark, tmp_path):
    rows = claims(spark, SF)
    s = ingest.IncrementalStore(spark, f"file://{tmp_path}/i")
    for i in range(3):
        s.ingest(rows.where(F.pmod(F.xxhash64("fact_id"), F.lit(3)) == i), i)
    assert s.read("claims").count() == rows.select("fact_id").distinct().count()
    assert s.read("relations").count() == pairs.relations(pairs.cluster_pairs(rows)).count()


def test_rejected_log_skips_broken_lines(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"raw_fact": "{}", "doc_id": "d", "page": 1, "reason": "no_subject"}\nnot json\n')
    assert [r["reason"] for r in store.read_rejected(spark, f"file://{path}").collect()] == ["no_subject"]


def test_incremental_ingest_equals_one_batch(spark, tmp_path):
    rows = claims(spark, SF)
    s = ingest.IncrementalStore(spark, f"file://{tmp_path}/i")
    for i in range(3):
        s.ingest(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == i), i)
    s.ingest(rows, 3)  # nothing new
    ends = lambda df: {(min(r["source_id"], r["target_id"]), max(r["source_id"], r["target_id"]), r["relation"]) for r in df.collect()}
    assert ends(s.read("relations")) == ends(pairs.relations(pairs.cluster_pairs(rows)))


SLOW = ("G-", "ST-01", "X-03", "S-09")


@pytest.mark.parametrize("name", sorted(n for n in registry.oracle_sql() if not n.startswith(SLOW)))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected = con.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(expected.columns)
    columns = sorted(df.columns)
    show = lambda x: "~" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)
    normal = lambda rows, names: sorted(tuple(show(r[names.index(c)]) for c in columns) for r in rows)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(expected.fetchall(), expected.columns)


def test_functions_in_sql_text(spark):
    from attestor.operators import sql_functions

    sql_functions.register(spark)
    r = spark.sql("select parse_quantity('Rs. 120.4 Cr', '') as q, verify_value('5', 'it was 5', '') as v, text_similarity('abcd', 'abce') as s, parse_quantity('none', '') as n").first()
    assert r["q"]["value"] == Decimal(1204000000) and r["q"]["sig_figs"] == 4 and r["v"]["status"] == "verified" and r["s"] == 0.75 and r["n"]["value"] is None
