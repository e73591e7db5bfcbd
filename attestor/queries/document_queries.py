"""Queries on the graph views and on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods
from ..operators import documents, graph, pairs
from ..sources.claims import CLAIMS_SQL, claims, table
from .pair_queries import RELATIONS_SQL


def _evidenced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Claims, and their evidence: each line of an order."""
    rows = claims(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), (F.col("l_linenumber") - 1).alias("nth"))
    return rows, rows.select("seq", "fact_id", "doc_id").join(lines, "seq")


def _related(rows: DataFrame) -> DataFrame:
    return pairs.relations(pairs.cluster_pairs(rows))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, evidence = _evidenced(spark, sf_dir)
    return graph.edges(rows, evidence, _related(rows))


def _near(spark: SparkSession, sf_dir: str):
    """The same graph by nodes."""
    rows, evidence = _evidenced(spark, sf_dir)
    return lambda nodes: graph.edges_near(rows, evidence, _related, nodes)


def _root(spark, sf_dir) -> str:
    """The subject that comes first by name."""
    return claims(spark, sf_dir).agg(F.min("subject")).first()[0]


def g01_neighborhood(spark, sf_dir):
    return graph.neighborhood(_near(spark, sf_dir), f"entity:{_root(spark, sf_dir)}", 2, 10_000, 1000, spark).select("node", "depth")


def g01_bounded(spark, sf_dir):
    return graph.neighborhood(_near(spark, sf_dir), f"entity:{_root(spark, sf_dir)}", 1, 6, 25, spark)


def g04_present_edges(spark, sf_dir):
    near = _near(spark, sf_dir)
    nodes = graph.neighborhood(near, f"entity:{_root(spark, sf_dir)}", 1, 10_000, 1000, spark)
    return graph.present_edges(near(nodes.select("node")), nodes).select("source", "target", "type")


def _first_relation(spark, sf_dir):
    """The relation with the least id; only ids and ends are compared, none is sorted."""
    rows = _related(claims(spark, sf_dir)).select("relation_id", "source_id", "target_id")
    return rows.agg(F.min(F.struct(*rows.columns)).alias("r")).select("r.*").first()


def g06_fact_lineage(spark, sf_dir):
    r = _first_relation(spark, sf_dir)
    return graph.fact_lineage(_near(spark, sf_dir), r["source_id"], spark).where("depth <= 1").select("node", "depth")


def g07_relation_lineage(spark, sf_dir):
    r = _first_relation(spark, sf_dir)
    return graph.relation_lineage(_near(spark, sf_dir), r["source_id"], r["target_id"], spark).select("node", "depth", "branch")


def g09_edge_types(spark, sf_dir):
    return _graph(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


def p19_search(spark, sf_dir):
    return graph.search(claims(spark, sf_dir), "1", 30).select("type", "id")


def _pages(spark, sf_dir):
    return documents.pages_of(table(spark, sf_dir, "documents"), 3)


def a12_repeated_edge_lines(spark, sf_dir):
    """Each source is one document here, whose texts are its pages."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text")
    return documents.repeated_edge_lines(rows, 2, 0.01).select("doc_id", "line", "n")


def s02_word_offsets(spark, sf_dir):
    words = documents.word_offsets(table(spark, sf_dir, "documents"))
    return words.groupBy("doc_id").agg(F.count("*").alias("words"), F.max("char_end").cast("long").alias("chars"))


def s03_pages(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("pages"))


def a10_page_scores(spark, sf_dir):
    """Pages that state quarters and counts, one for each day of orders."""
    day = F.to_date("o_orderdate")
    line = F.concat(F.lit("Q"), F.quarter(day), F.lit(" FY"), F.year(day), F.lit(": "), F.floor("o_totalprice").cast("long").cast("string"), F.lit(" plus "), (F.col("o_orderkey") + 5000).cast("string"))
    page = table(spark, sf_dir, "orders").groupBy(F.date_format(day, "yyyy").alias("doc_id"), F.month(day).alias("page")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    return documents.page_scores(page).select("doc_id", "page", "periods", "reason")


def w12_page_budget(spark, sf_dir):
    """Customers as pages of their nation: score by balance, budget by the number of pages."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("page"), F.col("c_acctbal").alias("score"), F.when(F.col("c_acctbal") > 0, "candidate").otherwise("not_candidate").alias("reason"))
    return documents.select_pages(rows).where("selected").select("doc_id", "page")


def x12_triage_report(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("page"), F.col("c_acctbal").alias("score"), F.when(F.col("c_acctbal") > 0, "candidate").otherwise("not_candidate").alias("reason"))
    chosen = documents.select_pages(rows)
    return chosen.groupBy("doc_id", F.when(F.col("selected"), "selected").when(F.col("reason") == "candidate", "over_budget").otherwise(F.col("reason")).alias("outcome")).agg(F.count("*").alias("n"))


def w06_packing(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("doc_id", "page", F.length("text").alias("size"))
    return documents.pack(rows, "doc_id", "page", "size")


def w07_pieces(spark, sf_dir):
    parts = documents.pieces(table(spark, sf_dir, "documents"), 1000)
    return parts.groupBy("doc_id").agg(F.sum(F.length("piece")).alias("chars"), (F.max(F.length("piece")) <= 1000).alias("fits"))


def w05_ffill_header(spark, sf_dir):
    """Lines of an order as header cells, blank where the line was returned."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    value = F.when(F.col("flag") != "R", F.concat(F.lit("h"), F.col("l_linenumber").cast("string"))).otherwise(" ")
    rows = lines.select(F.col("l_orderkey").alias("table_id"), F.lit(0).alias("row"), F.col("l_linenumber").alias("col"), value.alias("value"))
    return documents.fill_header(rows).select("table_id", "col", "header")


def a20_row_labels(spark, sf_dir):
    value = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("int").cast("string")).otherwise(F.col("l_linestatus"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("table_id"), F.lit(1).alias("row"), F.lit(0).alias("col"), value.alias("value"))
    return documents.row_label_confident(rows)


def j08_cells_matching(spark, sf_dir):
    """Cells of an order's lines that state the quantity of its first line."""
    lines = table(spark, sf_dir, "lineitem")
    cells = lines.select(F.col("l_orderkey").alias("table_id"), F.lit(0).alias("row"), F.col("l_linenumber").alias("col"), F.col("l_quantity").cast("int").cast("string").alias("value"), (F.col("l_returnflag") == "R").alias("ambiguous"))
    wanted = lines.where("l_linenumber = 1").select(F.col("l_orderkey").alias("table_id"), F.col("l_quantity").cast("int").cast("decimal(30,8)").alias("wanted"), F.lit(4).alias("sig_figs"))
    return documents.cells_matching(wanted, cells).select("table_id", "col")


def _boxes(spark, sf_dir):
    """Words of a page (one per order): lines at 10 pt steps."""
    lines = table(spark, sf_dir, "lineitem")
    top = (F.col("l_linenumber") * 10 + F.when(F.col("l_returnflag") == "R", -8).otherwise(0)).cast("double")
    return lines.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("double").alias("x0"), top.alias("top")).distinct()


def w09_lines(spark, sf_dir):
    return documents.line_numbers(_boxes(spark, sf_dir)).select("page_id", "x0", "line")


def w10_blocks(spark, sf_dir):
    rows = _boxes(spark, sf_dir).groupBy("page_id", "top").agg(F.min("x0").alias("x0")).withColumn("height", F.lit(2.0)).withColumn("bottom", F.col("top") + 2)
    return documents.block_numbers(rows).select("page_id", "top", "block")


def j19_overlap(spark, sf_dir):
    rows = _boxes(spark, sf_dir).withColumn("x1", F.col("x0") + 1).withColumn("bottom", F.col("top") + 2)
    tables = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit(0.0).alias("x0"), F.lit(3.5).alias("x1"), F.lit(15.0).alias("top"), F.lit(45.0).alias("bottom"))
    return documents.overlapping(rows, tables).select("page_id", "x0")


def w13_first_stated(spark, sf_dir):
    return claims(spark, sf_dir).select("seq", documents.first_stated(F.nullif("scope", F.lit("unknown")), F.col("basis"), F.lit("none")).alias("stated"))


def f26_period_kind(spark, sf_dir):
    kind = periods.display_kind(F.col("period_kind"), F.col("period_start"), F.col("period_label"))
    return claims(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def e01_event_windows(spark, sf_dir):
    """Extension, not parity: hourly counts of events by kind."""
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


QUERIES = {
    "G-01_neighborhood": g01_neighborhood, "G-01_bounded": g01_bounded, "G-04_present_edges": g04_present_edges, "G-06_fact_lineage": g06_fact_lineage,
    "G-07_relation_lineage": g07_relation_lineage, "G-09_edge_types": g09_edge_types, "P-19_search": p19_search, "A-12_repeated_edge_lines": a12_repeated_edge_lines,
    "S-02_word_offsets": s02_word_offsets, "S-03_pages": s03_pages, "A-10_page_scores": a10_page_scores, "W-12_page_budget": w12_page_budget,
    "X-12_triage_report": x12_triage_report, "W-06_packing": w06_packing, "W-07_pieces": w07_pieces, "W-05_ffill_header": w05_ffill_header, "A-20_row_labels": a20_row_labels,
    "J-08_cells_matching": j08_cells_matching, "W-09_lines": w09_lines, "W-10_blocks": w10_blocks, "J-19_overlap": j19_overlap, "W-13_first_stated": w13_first_stated,
    "F-26_period_kind": f26_period_kind, "E-01_event_windows": e01_event_windows,
}

_EDGES = f"""{RELATIONS_SQL}, edges as (
    select concat('entity:', subject) as source, concat('fact:', fact_id) as target, 'HAS_FACT' as type from claims
    union all select concat('fact:', fact_id), concat('evidence:', fact_id, '#', l_linenumber - 1), 'SUPPORTED_BY' from claims join lineitem on seq = l_orderkey
    union all select concat('evidence:', fact_id, '#', l_linenumber - 1), concat('document:', doc_id), 'LOCATED_IN' from claims join lineitem on seq = l_orderkey
    union all select concat('fact:', source_id), concat('fact:', target_id), upper(relation) from relations),
ways as (select source as a, target as b from edges union select target, source from edges),
root as (select concat('entity:', min(subject)) as node from claims),
one as (select distinct b as node from ways where a = (select node from root)),
first_relation as (select source_id, target_id from relations order by substring(sha1(concat_ws('|', source_id, target_id, relation)), 1, 12) limit 1)"""
_LINEAGE = "select node from (select concat('fact:', {end}) as node from first_relation union select b from ways where a = (select concat('fact:', {end}) from first_relation)) "
_PAGES = "customer_pages as (select c_nationkey as doc_id, c_custkey as page, c_acctbal as score, c_acctbal > 0 as candidate, row_number() over (partition by c_nationkey order by c_acctbal > 0 desc, c_acctbal desc, c_custkey) as rank, least(20, greatest(8, count(*) over (partition by c_nationkey) // 6)) as budget from customer)"
_BOX = "boxes as (select distinct l_orderkey as page_id, cast(l_linenumber as double) as x0, cast(l_linenumber * 10 + case when l_returnflag = 'R' then -8 else 0 end as double) as top from lineitem)"

SQL = {
    "G-01_neighborhood": f"with {_EDGES}, two as (select distinct b as node from ways where a in (select node from one)) select node, 0 as depth from root union all select node, 1 from one union all select node, 2 from two where node not in (select node from one) and node not in (select node from root)",
    "G-01_bounded": f"with {_EDGES}, f as (select node from one order by node limit 5) select node, 0 as depth, (select count(*) from one) > 5 as truncated from root union all select node, 1, (select count(*) from one) > 5 from f",
    "G-04_present_edges": f"with {_EDGES}, n as (select node from root union select node from one) select distinct source, target, type from edges where source in (select node from n) and target in (select node from n)",
    "G-06_fact_lineage": f"with {_EDGES} select node, case when node = (select concat('fact:', source_id) from first_relation) then 0 else 1 end as depth from ({_LINEAGE.format(end='source_id')})",
    "G-07_relation_lineage": f"with {_EDGES}, x as ({_LINEAGE.format(end='source_id')}), y as ({_LINEAGE.format(end='target_id')}) select node, case when node = (select concat('fact:', source_id) from first_relation) then 0 else 1 end as depth, 1 as branch from x union all select node, case when node = (select concat('fact:', target_id) from first_relation) then 0 else 1 end, 2 from y where node not in (select node from x)",
    "G-09_edge_types": f"with {_EDGES} select type, count(*) as n from edges group by type",
    "P-19_search": f"with {CLAIMS_SQL}, a as (select distinct 1 as turn, 'entity' as type, subject as id from claims where contains(lower(subject), '1') order by id limit 90), b as (select distinct 2 as turn, 'document' as type, doc_id as id from claims where contains(doc_id, '1') order by id limit 90), c as (select 3 as turn, 'fact' as type, fact_id as id from claims where contains(lower(subject), '1') or contains(measure, '1') order by id limit 90), u as (select * from a union all select * from b union all select * from c) select type, id from u order by turn, id limit 30",
    "A-12_repeated_edge_lines": """with d as (select source, doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l from documents), t as (select * from d where len(l) > 0),
        e as (select source, unnest(case when len(l) > 2 then list_concat(l[1:2], l[-2:]) else l[1:2] end) as line from t), n as (select source, count(*) as pages from t group by source),
        c as (select source, regexp_replace(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), '\\d+', '#', 'g') as line, count(*) as n from e group by all)
        select c.source as doc_id, line, c.n as n from c join n as total on c.source = total.source where c.n >= greatest(2, ceil(0.01 * pages))""",
    "S-02_word_offsets": "with d as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents) select doc_id, len(string_split(t, ' ')) as words, length(t) as chars from d where t <> ''",
    "S-03_pages": "select doc_id, cast(ceil(len(string_split(coalesce(text, ''), chr(10))) / 3) as bigint) as pages from documents",
    "A-10_page_scores": "with o as (select strftime(o_orderdate, '%Y') as doc_id, cast(month(o_orderdate) as integer) as page, count(*) as n from orders group by all) select doc_id, page, 2 as periods, 'candidate' as reason from o",
    "W-12_page_budget": f"with {_PAGES} select doc_id, page from customer_pages where candidate and rank <= budget",
    "X-12_triage_report": f"with {_PAGES} select doc_id, case when candidate and rank <= budget then 'selected' when candidate then 'over_budget' else 'not_candidate' end as outcome, count(*) as n from customer_pages group by all",
    "W-07_pieces": "select doc_id, cast(length(coalesce(text, '')) as bigint) as chars, true as fits from documents",
    "W-05_ffill_header": "with l as (select l_orderkey, l_linenumber, min(l_returnflag) as flag from lineitem group by all) select l_orderkey as table_id, l_linenumber as col, last_value(case when flag <> 'R' then concat('h', l_linenumber) end ignore nulls) over (partition by l_orderkey order by l_linenumber) as header from l",
    "A-20_row_labels": "select l_orderkey % 1000 as table_id, count(*) filter (l_linenumber % 2 = 0) <= count(*) / 2 as confident from lineitem group by 1",
    "J-08_cells_matching": "select a.l_orderkey as table_id, b.l_linenumber as col from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = 1 where b.l_returnflag <> 'R' and abs(floor(a.l_quantity) - floor(b.l_quantity)) <= case when floor(b.l_quantity) % 10 = 0 then 5 when floor(b.l_quantity) >= 1 then 0.5 else 0.05 end + 5 * power(10, floor(log10(floor(a.l_quantity))) - 4)",
    "W-09_lines": f"with {_BOX}, s as (select *, case when top - lag(top) over (partition by page_id order by top, x0) > 3 then 1 else 0 end as step from boxes) select page_id, x0, cast(sum(step) over (partition by page_id order by top, x0 rows unbounded preceding) as integer) as line from s",
    "W-10_blocks": f"with {_BOX}, d as (select distinct page_id, top from boxes), s as (select *, case when top - (lag(top) over (partition by page_id order by top) + 2) > 6 then 1 else 0 end as step from d) select page_id, top, cast(sum(step) over (partition by page_id order by top rows unbounded preceding) as integer) as block from s",
    "J-19_overlap": f"with {_BOX} select page_id, x0 from boxes where x0 < 3.5 and top < 45 and top + 2 > 15",
    "W-13_first_stated": f"with {CLAIMS_SQL} select seq, coalesce(nullif(scope, 'unknown'), basis, 'none') as stated from claims",
    "F-26_period_kind": f"with {CLAIMS_SQL} select case when period_kind is null then 'unstated' when period_kind = 'instant' then 'as_of' when seq % 5 = 1 then 'quarter' else 'fiscal_year' end as kind, count(*) as n from claims group by all",
    "E-01_event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n from events group by all",
}
