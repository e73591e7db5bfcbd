"""Whole pages as Arrow batches: their words in lines, and lines and cells from them as arrays.

Rows come out of a window over pages (`documents.line_numbers`), so a page's words stand together in one partition. A batch holds many pages, a page lies in one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .documents import line_numbers

BOX = ["x0", "top", "x1", "bottom"]


def first_of(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any of the columns."""
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    out[:1] = True
    return out


def _new_page(column: pa.Array) -> np.ndarray:
    if len(column) < 2:
        return np.ones(len(column), bool)
    later, earlier = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.coalesce(pc.not_equal(later, earlier), pc.not_equal(later.is_null(), earlier.is_null()))
    return np.append(True, differ.to_numpy(zero_copy_only=False))


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut where a page begins."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        page = batch.column("page_id")
        cut = int(np.flatnonzero(_new_page(page))[-1])
        if held and held[-1].column("page_id")[-1].as_py() != page[0].as_py():
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
        if cut:
            yield from pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Words:
    """Words of whole pages in reading order within their lines: by x0, x1 and text."""

    def __init__(self, batch: pa.RecordBatch):
        page, line = np.cumsum(_new_page(batch.column("page_id"))), batch.column("line").to_numpy()
        of_line = np.cumsum(first_of(page, line))
        x0, top, x1, bottom = (batch.column(c).to_numpy(zero_copy_only=False) for c in BOX)
        low = lambda x: np.where(np.isnan(x), -np.inf, x)
        order = np.lexsort((low(x1), low(x0), of_line))
        tied = ~first_of(of_line[order], low(x0)[order], low(x1)[order])
        if tied.any():
            rank = pc.rank(batch.column("text"), null_placement="at_start", tiebreaker="dense").to_numpy()
            order = np.lexsort((rank, low(x1), low(x0), of_line))
        self.batch, self.order = batch, order
        self.page, self.of_line = page[order], of_line[order]
        self.x0, self.top, self.x1, self.bottom = x0[order], top[order], x1[order], bottom[order]
        self.first = first_of(self.of_line)
        self.text = batch.column("text").take(pa.array(order))

    def taken(self, name: str, at: np.ndarray) -> pa.Array:
        return self.batch.column(name).take(pa.array(self.order[at]))


def reach_before(x1: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The largest x1 of the rows before each one in its group, -inf for a group's first; `first` marks where groups begin."""
    at = np.arange(len(x1))
    start = np.maximum.accumulate(np.where(first, at, 0))
    best, step, longest = np.where(np.isnan(x1), -np.inf, x1), 1, int((at - start).max(initial=0)) + 1
    while step < longest:
        other = at - step
        best = np.where(other >= start, np.maximum(best, best[np.maximum(other, 0)]), best)
        step *= 2
    return np.where(first, -np.inf, np.append(-np.inf, best[:-1]))


def joined(text: pa.Array, first: np.ndarray) -> pa.Array:
    """The texts of each group, joined by blanks; those that are null are left out."""
    stated = text.is_valid().to_numpy(zero_copy_only=False)
    before = np.append(0, np.cumsum(stated))
    edge = np.append(before[np.flatnonzero(first)], before[-1])
    lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), text.filter(pa.array(stated)))
    return pc.binary_join(lists, " ")


def boxes(x0: np.ndarray, top: np.ndarray, x1: np.ndarray, bottom: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Boxes around groups of boxes; a place that is missing doesn't count."""
    return [np.fmin.reduceat(x0, start), np.fmin.reduceat(top, start), np.fmax.reduceat(x1, start), np.fmax.reduceat(bottom, start)]


def doubles(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array(a, pa.float64(), from_pandas=True) for a in arrays]


def over_pages(words: DataFrame, each: Callable[[Words], pa.RecordBatch | None], columns: str) -> DataFrame:
    """(page_id and `columns`) that `each` makes of the words of whole pages."""
    rows = line_numbers(words.select("page_id", *[F.col(c).cast("double").alias(c) for c in BOX], "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_pages(batches):
            out = each(Words(batch))
            if out is not None and out.num_rows:
                yield out

    return rows.mapInArrow(run, f"page_id {words.schema['page_id'].dataType.simpleString()}, {columns}")
