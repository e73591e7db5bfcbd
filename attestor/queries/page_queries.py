"""Queries on page layout and tables: order lines as the words and cells of pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import layout, tables
from ..sources.claims import table


#: Order lines that one task holds at a time.
TASK_LINES = 250_000


def _parts(spark, sf_dir):
    """So many parts of pages that a task's share doesn't grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // TASK_LINES))


def _lines(spark, sf_dir, page="l_orderkey"):
    """Every numbered line of an order once, with its least flag and quantity; dealt by page, so that nothing that is done page by page deals it again."""
    rows = table(spark, sf_dir, "lineitem").withColumn("page_id", F.col(page) if isinstance(page, str) else page).repartition(_parts(spark, sf_dir), "page_id")
    return rows.groupBy("page_id", "l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_quantity").cast("int").alias("quantity"))


def _page_words(spark, sf_dir):
    """Pages of 64 orders, each line of them five words.

    On every third page there are two columns, but for returned lines; on another third wide spaces lie all over the page. Seventh lines have dots that lead to
    a number, and lines of quantity 1 are list items.
    """
    page = F.floor(F.col("l_orderkey") / 64).cast("long")
    rows = _lines(spark, sf_dir, page).withColumns({"top": (F.col("l_orderkey") % 64 * 80 + F.col("l_linenumber") * 10).cast("double")})
    words = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    after = F.when(F.col("page_id") % 3 == 1, 3).otherwise(1 + F.col("l_linenumber") % 4)
    shifted = (F.col("page_id") % 3 > 0) & (F.col("flag") != "R") & (F.col("k") >= after)
    x0 = (20 + 30 * F.col("k") + F.when(shifted, 60).otherwise(0)).cast("double")
    text = F.when((F.col("l_linenumber") == 7) & (F.col("k") == 2), ".....").when((F.col("quantity") == 1) & (F.col("k") == 0), "-").otherwise(F.concat(F.lit("w"), F.col("k").cast("string")))
    return words.select("page_id", x0.alias("x0"), "top", (x0 + 20).alias("x1"), (F.col("top") + 8).alias("bottom"), text.alias("text"))


def _page_tables(spark, sf_dir):
    """A table at the top of every fifth page."""
    page = F.floor(F.col("l_orderkey") / 64).cast("long").alias("page_id")
    pages = table(spark, sf_dir, "lineitem").select(page).distinct().where("page_id % 5 = 0")
    return pages.select("page_id", F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), F.lit(500.0).alias("x1"), F.lit(900.0).alias("bottom"))


def w11_column_gutters(spark, sf_dir):
    return layout.column_gutters(layout.text_lines(_page_words(spark, sf_dir)), _page_tables(spark, sf_dir))


def x11_reading_order(spark, sf_dir):
    words = _page_words(spark, sf_dir)
    lines = layout.text_lines(words).repartition(_parts(spark, sf_dir), "page_id")  # as the words are, which then stay where they are
    return layout.reading_order(words, layout.column_gutters(lines)).select("page_id", "top", "x0", "part", "position")


def x11_page_layouts(spark, sf_dir):
    found = layout.page_layouts(_page_words(spark, sf_dir), _page_tables(spark, sf_dir))
    return found.select("page_id", "lines", "blocks", "multi_column", F.explode("kinds").alias("kind", "n"))


def _table_words(spark, sf_dir):
    """Orders as pages: a title, and each line as `item`, its number, its quantity and, if it wasn't returned, its flag."""
    rows = _lines(spark, sf_dir)
    nth = F.col("l_linenumber").cast("string")
    word = lambda x0, x1, text: F.struct(F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), text.cast("string").alias("text"))
    words = F.array(word(10, 30, F.lit("item")), word(33, 40, nth), word(80, 100, F.col("quantity")), word(150, 160, F.when(F.col("flag") != "R", F.col("flag"))))
    top = (F.col("l_linenumber") * 12 + 20).cast("double")
    body = rows.select("page_id", top.alias("top"), F.explode(words).alias("w")).select("page_id", "w.x0", "top", "w.x1", (F.col("top") + 8).alias("bottom"), "w.text").where("text is not null")
    titles = rows.select("page_id").distinct().select("page_id", F.lit(10.0).alias("x0"), F.lit(10.0).alias("top"), F.lit(200.0).alias("x1"), F.lit(18.0).alias("bottom"), F.lit("Goods (in lakhs)").alias("text"))
    return body.unionByName(titles)


def s03_aligned_tables(spark, sf_dir):
    found = tables.aligned_cells(_table_words(spark, sf_dir))
    return found.select("page_id", "row", "col", "value")


def s03_fallback(spark, sf_dir):
    """Documents of ten orders: those of odd number have a ruled table on every page."""
    words = _table_words(spark, sf_dir)
    pages = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 10).cast("long").alias("doc_id"), F.col("o_orderkey").alias("page_id"))
    aligned = tables.aligned_cells(words).select("page_id", "table_id", "row", "col", "value")
    ruled = pages.where("doc_id % 2 = 1").select("page_id", F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("table_id"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("x").alias("value"))
    return tables.with_fallback(pages, ruled, aligned).groupBy("doc_id", "strategy").agg(F.count("*").alias("cells"))


def s04_captions(spark, sf_dir):
    words = _table_words(spark, sf_dir)
    found = tables.captions(tables.aligned_cells(words), words)
    return found.select("table_id", "caption", "scale")


def _order_tables(spark, sf_dir):
    """A table for each order. Even orders have groups of columns over names, odd ones a single header; each seventh has numbers as labels."""
    rows = _lines(spark, sf_dir).withColumn("table_id", F.col("l_orderkey").cast("string"))
    two, odd = F.col("l_orderkey") % 2 == 0, F.col("l_orderkey") % 7 == 0
    shift = F.when(two, 2).otherwise(1)
    label = F.when(odd, F.col("l_linenumber").cast("string")).otherwise(F.concat(F.lit("item "), F.col("l_linenumber").cast("string")))
    many = F.when(F.col("flag") == "R", F.concat(F.col("quantity").cast("string"), F.lit(" and "), (F.col("quantity") + 100).cast("string"))).otherwise(F.concat(F.lit(" "), F.col("flag"), F.lit(" ")))
    cell = lambda col, value: F.struct(F.lit(col).alias("col"), value.alias("value"))
    nth = F.row_number().over(Window.partitionBy("table_id").orderBy("l_linenumber")) - 1 + shift
    data = rows.withColumn("row", nth).select("table_id", "row", F.explode(F.array(cell(0, label), cell(1, F.col("quantity").cast("string")), cell(2, many))).alias("c"))
    heads = rows.select("table_id", two.alias("two")).distinct()
    row = lambda r, *values: F.array(*[F.struct(F.lit(r).alias("row"), F.lit(i).alias("col"), F.lit(v).cast("string").alias("value")) for i, v in enumerate(values)])
    heads = heads.select("table_id", F.explode(F.when(F.col("two"), F.concat(row(0, "", "FY2024", "FY2025"), row(1, None, "Actual", "Forecast"))).otherwise(row(0, "Name", "Rs. in lakhs", " % change "))).alias("c"))
    return data.select("table_id", "row", "c.col", "c.value").unionByName(heads.select("table_id", "c.row", "c.col", "c.value"))


def f60_structured(spark, sf_dir):
    found = tables.structured(_order_tables(spark, sf_dir))
    return found.select("table_id", "row", "col", "value", "row_label", "header", "period_label", "confident", "ambiguous")


def f45_column_units(spark, sf_dir):
    return tables.column_units(_order_tables(spark, sf_dir))


def f61_cell_lookup(spark, sf_dir):
    """The third line of every order, where it has one."""
    cells = tables.structured(_order_tables(spark, sf_dir))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("table_id"), F.lit(2).alias("row"), F.lit(1).alias("col"))
    return tables.cell_at(cells, asked).select("table_id", "value", "row_label")


QUERIES = {
    "W-11_column_gutters": w11_column_gutters, "X-11_reading_order": x11_reading_order, "X-11_page_layouts": x11_page_layouts, "S-03_aligned_tables": s03_aligned_tables,
    "S-03_table_fallback": s03_fallback, "S-04_captions": s04_captions, "F-60_structured_table": f60_structured, "F-45_column_units": f45_column_units, "F-61_cell_lookup": f61_cell_lookup,
}

_L = "l as (select l_orderkey, l_linenumber, min(l_returnflag) as flag, cast(floor(min(l_quantity)) as integer) as quantity from lineitem group by all)"
_PAGE = f"""{_L}, p as (select l_orderkey // 64 as page_id, l_orderkey % 64 * 80 + l_linenumber * 10 as top, l_linenumber as nth, flag, quantity, (l_orderkey // 64) % 3 as kind from l)"""
#: Each line's gutter; lines of tables (top of every fifth page) and with dots aren't asked.
_GUTTERS = """asked as (select page_id, case when kind > 0 and flag <> 'R' then cast(case kind when 1 then 135 else 45 + 30 * (1 + nth % 4) end as double) end as x from p where nth <> 7 and {where}),
    mid as (select page_id, count(*) as n, count(x) as wide, median(x) as m from asked group by page_id),
    near as (select page_id, n, wide, m, count_if(abs(x - m) < 15) as near from asked join mid using (page_id) group by all),
    g as (select page_id, count(*) as lines, coalesce(any_value(n >= 8 and wide >= 0.5 * n and near >= 0.7 * wide and near >= 0.5 * n), false) as multi_column, any_value(m) as m from p left join near using (page_id) group by page_id)"""
_CELLS = f"""{_L}, t as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as row, count(*) over (partition by l_orderkey) as n, l_linenumber, flag, quantity from l)"""
_IN_TABLE = "not (page_id % 5 = 0 and top <= 900)"
#: Two lines of an order make a row of the table below the title only if they follow each other.
_ALIGNED = f"""{_L}, s as (select *, case when l_linenumber - lag(l_linenumber) over o <= 2 then 0 else 1 end as begins from l window o as (partition by l_orderkey order by l_linenumber)),
    u as (select *, sum(begins) over (partition by l_orderkey order by l_linenumber) as run from s), v as (select *, count(*) over (partition by l_orderkey, run) as n, row_number() over (partition by l_orderkey, run order by l_linenumber) - 1 as row from u),
    w as (select l_orderkey as page_id, dense_rank() over (partition by l_orderkey order by run) as nth, row, l_linenumber, flag, quantity from v where n >= 3),
    c as (select page_id, nth, row, unnest([{{'col': 0, 'value': concat('item ', l_linenumber)}}, {{'col': 1, 'value': cast(quantity as varchar)}}, {{'col': 2, 'value': case when flag <> 'R' then flag end}}]) as c from w)"""

SQL = {
    "W-11_column_gutters": f"with {_PAGE}, {_GUTTERS.format(where=_IN_TABLE)} select page_id, lines, multi_column, case when multi_column then m end as boundary from g",
    "X-11_reading_order": f"""with {_PAGE}, {_GUTTERS.format(where='true')}, y as (select p.*, not multi_column or flag = 'R' as across from p join g using (page_id)),
        z as (select *, case when across <> lag(across) over (partition by page_id order by top) then 1 else 0 end as turn from y), b as (select *, sum(turn) over (partition by page_id order by top) as band from z),
        k as (select page_id, top, band, across, 20.0 + 30 * k + case when kind > 0 and flag <> 'R' and k >= case kind when 1 then 3 else 1 + nth % 4 end then 60 else 0 end as x0 from b cross join (select unnest(range(0, 5)) as k)),
        q as (select *, case when across then 0 when x0 < 135 then 1 else 2 end as part from k)
        select page_id, cast(top as double) as top, cast(x0 as double) as x0, cast(part as integer) as part, cast(row_number() over (partition by page_id order by band, part, top, x0) as integer) as position from q""",
    "X-11_page_layouts": f"""with {_PAGE}, {_GUTTERS.format(where=_IN_TABLE)}, s as (select *, case when top - lag(top) over (partition by page_id order by top) - 8 > 20 then 1 else 0 end as step from p),
        b as (select *, sum(step) over (partition by page_id order by top) as block from s),
        k as (select page_id, block, case when page_id % 5 = 0 and min(top) <= 900 then 'table_adjacent' when count(*) = 1 and not bool_or(quantity = 1) then 'heading' when count(*) = 1 then 'unknown' when bool_or(quantity = 1) then 'list' else 'paragraph' end as kind from b group by page_id, block),
        n as (select page_id, kind, count(*) as n, sum(count(*)) over (partition by page_id) as blocks from k group by page_id, kind)
        select page_id, lines, cast(blocks as bigint) as blocks, multi_column, n.kind, n from g join n using (page_id)""",
    "S-03_aligned_tables": f"with {_ALIGNED} select page_id, cast(row as integer) as row, cast(c.col as integer) as col, c.value as value from c where c.value is not null",
    "S-03_table_fallback": f"""with {_ALIGNED}, a as (select page_id // 10 as doc_id, count(*) filter (c.value is not null) as cells from c group by all)
        select doc_id, 'aligned' as strategy, cells from a where doc_id % 2 = 0 union all select o_orderkey // 10, 'ruled', count(*) from orders where (o_orderkey // 10) % 2 = 1 group by 1""",
    "S-04_captions": f"""with {_ALIGNED}, m as (select page_id, nth, min(l_linenumber) * 12 + 20 as top from w group by all)
        select concat(page_id, '#', nth) as table_id, concat_ws(chr(10), case when top - 10 <= 45 then 'Goods (in lakhs)' end, lines) as caption, case when top - 10 <= 45 then 'in lakhs' else '' end as scale
        from m left join lateral (select string_agg(concat('item ', l_linenumber, ' ', quantity, case when flag <> 'R' then concat(' ', flag) else '' end), chr(10) order by l_linenumber) as lines from l
            where l.l_orderkey = m.page_id and l_linenumber * 12 + 20 < m.top and l_linenumber * 12 + 20 >= m.top - 45) on true""",
    "F-60_structured_table": f"""with {_CELLS}, h as (select *, unnest([0, 1, 2]) as col, l_orderkey % 2 = 0 as two, l_orderkey % 7 <> 0 as confident from t)
        select cast(l_orderkey as varchar) as table_id, cast(row as integer) as row, cast(col as integer) as col,
            case col when 0 then case when confident then concat('item ', l_linenumber) else cast(l_linenumber as varchar) end when 1 then cast(quantity as varchar) else case when flag = 'R' then concat(quantity, ' and ', quantity + 100) else flag end end as value,
            case when confident then concat('item ', l_linenumber) end as row_label,
            case when two then ['', 'FY2024 Actual', 'FY2025 Forecast'][col + 1] else ['Name', 'Rs. in lakhs', '% change'][col + 1] end as h0, nullif(h0, '') as header,
            case when two and col > 0 then ['FY2024', 'FY2025'][col] end as period_label, confident, not confident or (col = 2 and flag = 'R') as ambiguous from h""",
    "F-45_column_units": f"with {_CELLS} select distinct cast(l_orderkey as varchar) as table_id, cast(c.col as integer) as col, c.v as unit_text from (select l_orderkey, unnest([{{'col': 1, 'v': 'Rs. in lakhs'}}, {{'col': 2, 'v': '% change'}}]) as c from t where l_orderkey % 2 = 1)",
    "F-61_cell_lookup": f"with {_CELLS} select cast(o_orderkey as varchar) as table_id, cast(quantity as varchar) as value, case when o_orderkey % 7 <> 0 and quantity is not null then concat('item ', l_linenumber) end as row_label from orders left join t on l_orderkey = o_orderkey and row = 2",
}
SQL["F-60_structured_table"] = "select table_id, row, col, value, row_label, header, period_label, confident, ambiguous from (" + SQL["F-60_structured_table"] + ")"
