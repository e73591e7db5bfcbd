"""Documents: pages, edge lines, page triage, packing, tables and layout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, periods
from ..functions import text as texts

PACK_CHARS = 6000
PIECE_CHARS = 8000


def pages_of(docs: DataFrame, lines_per_page: int = 40) -> DataFrame:
    """(doc_id, page, text): plain text cut to pages of so many lines, numbered from 1."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    rows = lines.groupBy("doc_id", (F.floor(F.col("n") / lines_per_page) + 1).cast("int").alias("page"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))


def word_offsets(rows: DataFrame) -> DataFrame:
    """(doc_id, nth, word, char_start, char_end) of every word of single-spaced text."""
    words = rows.select("doc_id", F.posexplode(F.split(texts.one_spaced(F.col("text")), " ")).alias("nth", "word")).where("word <> ''")
    run = Window.partitionBy("doc_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = words.withColumn("char_end", F.sum(F.length("word") + 1).over(run) - 1)
    return words.withColumn("char_start", F.col("char_end") - F.length("word"))


def repeated_edge_lines(pages: DataFrame, least: int = 3, share: float = 0.3) -> DataFrame:
    """(doc_id, line, n, example) of masked lines among the first and last two of the pages of a document.

    A line is repeated if it occurs max(least, ceil(share of the pages with text)) times. The last two count only on pages of more than two lines.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = pages.withColumn("lines", lines).where(F.size("lines") > 0)
    total = rows.groupBy("doc_id").agg(F.count("*").alias("pages"))
    edge = F.when(F.size("lines") > 2, F.concat(F.slice("lines", 1, 2), F.slice("lines", -2, 2))).otherwise(F.slice("lines", 1, 2))
    rows = rows.select("doc_id", "page", F.explode(edge).alias("example"))
    found = rows.groupBy("doc_id", texts.edge_line(F.col("example")).alias("line")).agg(F.count("*").alias("n"), F.min(F.struct("page", "example")).alias("first"))
    need = F.greatest(F.lit(least), F.ceil(F.col("pages") * share))
    return found.join(total, "doc_id").where(F.col("n") >= need).select("doc_id", "line", "n", F.col("first.example").alias("example"))


def page_scores(pages: DataFrame, image_only: Column | None = None) -> DataFrame:
    """periods, quants, bare_years, score and reason of each page.

    Score: min(periods, 5) * ln(1 + quants). A candidate names a period and three quantities; pages
    of mostly bare years are none.
    """
    found = lambda pattern: F.regexp_extract_all(F.col("text"), F.lit(pattern), 0)
    phrases = F.concat(*[found(p) for p in (periods.QUARTER, periods.FISCAL_RANGE, periods.FISCAL_SINGLE, periods.AS_ON, periods.DATE_DMY, periods.DATE_ISO)])
    windows = F.transform(phrases, lambda x: periods.parse_period(x))
    distinct = F.array_distinct(F.transform(F.filter(windows, lambda p: p.isNotNull()), lambda p: F.struct(p["kind"], p["start"], p["end"])))
    literals = found(numbers.NUMBER)
    rows = pages.withColumns({"periods": F.size(distinct), "quants": F.size(literals), "bare_years": F.size(F.filter(literals, lambda x: numbers.is_bare_year(x)))})
    ratio = F.when(F.col("quants") > 0, F.col("bare_years") / F.col("quants")).otherwise(0.0)
    reason = (
        F.when(F.lit(False) if image_only is None else image_only, "image_only")
        .when(ratio > 0.6, "bare_year_ratio")
        .when((F.col("periods") < 1) | (F.col("quants") < 3), "not_candidate")
        .otherwise("candidate")
    )
    score = F.round(F.least(F.col("periods"), F.lit(5)) * F.log1p(F.col("quants")), 6)
    return rows.withColumn("score", score).withColumn("reason", reason)


def default_budget(n_pages: Column) -> Column:
    return F.least(F.lit(20), F.greatest(F.lit(8), F.floor(n_pages / 6))).cast("int")


def select_pages(scored: DataFrame, budget: Column | None = None) -> DataFrame:
    """Adds selected: the best candidates of each document within its budget, ties to earlier pages."""
    w = Window.partitionBy("doc_id")
    rows = scored.withColumn("__n", F.count("*").over(w))
    rank = F.row_number().over(w.orderBy((F.col("reason") == "candidate").desc(), F.col("score").desc(), "page"))
    rows = rows.withColumn("__rank", rank)
    limit = default_budget(F.col("__n")) if budget is None else budget
    chosen = (F.col("reason") == "candidate") & ((F.col("__rank") <= limit) | (limit < 0))
    return rows.withColumn("selected", chosen).drop("__n", "__rank")


def pack(rows: DataFrame, group: str, order: str, size: str, budget: int = PACK_CHARS) -> DataFrame:
    """Adds batch: rows of a group in order, packed greedily up to `budget`; a row that is larger stands alone.

    A fold over the group's ordered sizes, as a window can't start anew where a batch is full.
    """
    items = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("items"))
    start = F.struct(F.lit(-1).cast("long").alias("batch"), F.lit(0).cast("long").alias("fill"), F.expr("cast(array() as array<struct<o:bigint,batch:bigint>>)").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        fits = (acc["batch"] >= 0) & (acc["fill"] + x["s"] <= budget)
        batch = F.when(fits, acc["batch"]).otherwise(acc["batch"] + 1)
        fill = F.when(fits, acc["fill"] + x["s"]).otherwise(x["s"])
        return F.struct(batch.alias("batch"), fill.alias("fill"), F.concat(acc["out"], F.array(F.struct(x["o"].cast("long").alias("o"), batch.alias("batch")))).alias("out"))

    folded = items.select(group, F.explode(F.aggregate("items", start, add)["out"]).alias("x"))
    return folded.select(group, F.col("x.o").alias(order), F.col("x.batch").alias("batch"))


def split_pieces(text: str, cap: int = PIECE_CHARS) -> list[str]:
    """Pieces of at most `cap` characters that together are the text; cut after a blank where there is one."""
    out, at = [], 0
    while len(text) - at > cap:
        cut = max(text.rfind(" ", at, at + cap), text.rfind("\n", at, at + cap))
        end = cut + 1 if cut > at else at + cap
        out.append(text[at:end])
        at = end
    out.append(text[at:])
    return out


def split_rows(header: str, rows: list[str], cap: int = PIECE_CHARS) -> list[str]:
    """Table rows in pieces of at most `cap` characters, each with the header; a longer row stands alone."""
    out, held, size = [], [], len(header)
    for row in rows:
        if held and size + 1 + len(row) > cap:
            out.append("\n".join([header, *held]))
            held, size = [], len(header)
        held.append(row)
        size += 1 + len(row)
    return [*out, "\n".join([header, *held])] if held else out


def pieces(docs: DataFrame, cap: int = PIECE_CHARS) -> DataFrame:
    """(doc_id, nth, piece): nothing is left out and no piece is over `cap` characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                parts = split_pieces(text or "", cap)
                yield pd.DataFrame({"doc_id": doc_id, "nth": range(len(parts)), "piece": parts})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, nth int, piece string")


# --- tables ----------------------------------------------------------------------------------------


def cells(tables: DataFrame) -> DataFrame:
    """One row for each cell of `rows` (an array of ragged arrays): table_id, row, col, value."""
    return tables.select("table_id", F.posexplode("rows").alias("row", "r")).select("table_id", "row", F.posexplode("r").alias("col", "value"))


def fill_header(cells_: DataFrame, row: int = 0) -> DataFrame:
    """Header cells with merged ones filled from the last that isn't blank on the left."""
    run = Window.partitionBy("table_id").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stated = F.nullif(F.trim("value"), F.lit(""))
    return cells_.where(F.col("row") == row).withColumn("header", F.last(stated, ignorenulls=True).over(run))


def row_label_confident(cells_: DataFrame, header_rows: int = 1) -> DataFrame:
    """Whether the first column holds labels: no more than half of its filled cells are numbers."""
    first = cells_.where((F.col("col") == 0) & (F.col("row") >= header_rows) & (F.coalesce(F.trim("value"), F.lit("")) != ""))
    return first.groupBy("table_id").agg((F.count_if(texts.is_number_cell(F.col("value"))) <= F.count("*") / 2).alias("confident"))


def cells_matching(values: DataFrame, cells_: DataFrame) -> DataFrame:
    """Cells of a value's table that state the value within both tolerances; those marked ambiguous are left out."""
    q = numbers.parse_quantity(F.col("value"))
    stated = cells_.where("not ambiguous").withColumn("q", q).where("q is not null")
    pairs = values.join(stated.select("table_id", "row", "col", "q"), "table_id")
    return pairs.where(numbers.values_agree(F.col("wanted"), F.col("sig_figs"), F.col("q.value"), F.col("q.sig_figs")))


def cell_of_box(spans: DataFrame, tables: DataFrame, cells_: DataFrame, slack: float = 2.0) -> DataFrame:
    """The one cell that a span's box lies in: exactly one table around it (with slack), then exactly one cell; else null."""
    within = lambda p, q, s: (F.col(f"{p}.x0") >= F.col(f"{q}.x0") - s) & (F.col(f"{p}.top") >= F.col(f"{q}.top") - s) & (F.col(f"{p}.x1") <= F.col(f"{q}.x1") + s) & (F.col(f"{p}.bottom") <= F.col(f"{q}.bottom") + s)
    in_table = spans.alias("s").join(tables.alias("t"), (F.col("s.page_id") == F.col("t.page_id")) & within("s", "t", slack)).select("s.*", F.col("t.table_id").alias("table_id"))
    one = in_table.withColumn("n", F.count("*").over(Window.partitionBy("span_id"))).where("n = 1").drop("n")
    in_cell = one.alias("s").join(cells_.alias("c"), (F.col("s.table_id") == F.col("c.table_id")) & within("s", "c", slack)).select("s.span_id", "c.table_id", "c.row", "c.col")
    found = in_cell.withColumn("n", F.count("*").over(Window.partitionBy("span_id"))).where("n = 1").drop("n")
    return spans.select("span_id").join(found, "span_id", "left")


def span_box(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Union of the boxes of the words that a character span touches."""
    hit = spans.join(words, (spans["doc_id"] == words["doc_id"]) & (words["char_start"] < spans["end"]) & (words["char_end"] > spans["start"]))
    return hit.groupBy("span_id").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


# --- layout ----------------------------------------------------------------------------------------


def line_numbers(words: DataFrame, gap: float = 3.0) -> DataFrame:
    """Adds line: words of a page in the order of `top`, a new line where the step is over `gap`."""
    w = Window.partitionBy("page_id").orderBy("top", "x0")
    step = F.when(F.col("top") - F.lag("top").over(w) > gap, 1).otherwise(0)
    return words.withColumn("__step", step).withColumn("line", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("__step")


def block_numbers(lines: DataFrame) -> DataFrame:
    """Adds block: a new one where the gap to the line before is over max(2.5 median heights, 6)."""
    page = Window.partitionBy("page_id")
    w = page.orderBy("top")
    median = F.percentile("height", 0.5).over(page)
    step = F.when(F.col("top") - F.lag("bottom").over(w) > F.greatest(2.5 * median, F.lit(6.0)), 1).otherwise(0)
    return lines.withColumn("__step", step).withColumn("block", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("__step")


def overlapping(lines: DataFrame, tables: DataFrame, how: str = "left_semi") -> DataFrame:
    """Lines that overlap some table of their page (`left_semi`) or none (`left_anti`)."""
    a, b = lines.alias("l"), tables.alias("t")
    hit = (F.col("l.page_id") == F.col("t.page_id")) & (F.col("l.x0") < F.col("t.x1")) & (F.col("l.x1") > F.col("t.x0")) & (F.col("l.top") < F.col("t.bottom")) & (F.col("l.bottom") > F.col("t.top"))
    return a.join(b, hit, how)


def first_stated(*columns: Column) -> Column:
    """The first that is stated; an empty text states nothing."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
