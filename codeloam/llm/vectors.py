"""Sparse vectors of the last delivery as (id, dims, vals), and inverted lists over a block of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloam.operators.snapshot_diff import valid_rows, vector_entries

VECTOR = "id bigint, dims array<bigint>, vals array<double>"
BOUND_DIMS = 96  # dims of a bound of inner products; the others count by their norm
BOUND_ROWS = 1_024  # rows whose bounds are made together
SLACK = 1e-5  # more than single precision errs in an inner product of vectors of norm 1 or less


def last_vectors(snapshots: DataFrame, field: str) -> DataFrame:
    """(id, dims, vals): unit vectors of ``field`` of the valid rows of the highest delivery.

    Values are rounded to 4 decimals first; missing dimensions and zeros are left out, so are vectors without any
    other and such with NaN or infinite entries. Dims are 64-bit hashes of their names, in ascending order.
    """
    last = snapshots.agg(F.max("delivery_no")).first()[0]
    rows = valid_rows(snapshots.where(F.col("delivery_no") == (last if last is not None else -1)), [vector_entries(field).alias("entries")])
    e = F.array_sort(F.transform("entries", lambda x: F.struct(F.xxhash64(x["dim"]).alias("d"), x["value"].alias("v"))))
    rows = rows.select(F.col("snapshot_id").alias("id"), e.alias("e")).where("id is not null and size(e) > 0")
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x["v"] * x["v"])))
    return rows.where("norm > 0 and norm < double('infinity')").select("id", F.col("e.d").alias("dims"), F.transform("e", lambda x: x["v"] / F.col("norm")).alias("vals"))


class Block:
    """Rows of a block as flat arrays, plus one array of (value, row) per dim, sorted by value."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        pdf = pdf.sort_values("id", kind="stable")
        self.ids = pdf["id"].to_numpy(np.int64)
        sizes = np.fromiter(map(len, pdf["dims"]), np.int64, len(pdf))
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        self.dims = np.concatenate([*pdf["dims"], np.zeros(0, np.int64)]).astype(np.int64)
        self.vals = np.concatenate([*pdf["vals"], np.zeros(0)])

    @cached_property
    def lists(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        row = np.repeat(np.arange(len(self)), np.diff(self.start))
        order = np.lexsort((self.vals, self.dims))
        names, first = np.unique(self.dims[order], return_index=True)
        ends = np.append(first[1:], len(order))
        value, member = self.vals[order], row[order]
        return {d: (value[b:e], member[b:e]) for d, b, e in zip(names.tolist(), first.tolist(), ends.tolist())}

    def __len__(self) -> int:
        return len(self.ids)

    def row(self, k: int) -> tuple[list[int], np.ndarray]:
        b, e = self.start[k], self.start[k + 1]
        return self.dims[b:e].tolist(), self.vals[b:e]

    def dots(self, dims: list[int], vals: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Inner products with all rows of the block, by whole lists."""
        out[:] = 0
        for d, v in zip(dims, vals):
            hit = self.lists.get(d)
            if hit is not None:
                out[hit[1]] += v * hit[0]  # a row stands once in a list
        return out

    def dots_of(self, dims: list[int], vals: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Inner products with some rows."""
        b, n = self.start[rows], self.start[rows + 1] - self.start[rows]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b, n)
        names = np.array(dims)
        pos = np.searchsorted(names, self.dims[at])
        pos[pos == len(names)] = 0
        part = np.where(names[pos] == self.dims[at], vals[pos] * self.vals[at], 0.0)
        return np.add.reduceat(part, np.cumsum(n) - n) if len(rows) else np.zeros(0)

    def some_dots(self, dims: list[int], vals: np.ndarray, rows: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Inner products with some rows, by whole lists if these are many."""
        return self.dots(dims, vals, out)[rows] if 8 * len(rows) > len(self) else self.dots_of(dims, vals, rows)


def matrix_of(rows: Block, names: np.ndarray, kind: type) -> np.ndarray:
    """Dense values of some dims, in ascending order."""
    out = np.zeros((len(rows), len(names)), kind)
    at = np.minimum(np.searchsorted(names, rows.dims), max(0, len(names) - 1))
    held = names[at] == rows.dims if len(names) else np.zeros(len(at), bool)
    out[np.repeat(np.arange(len(rows)), np.diff(rows.start))[held], at[held]] = rows.vals[held]
    return out


def bounds(asked: Block, index: Block, left: np.ndarray | None = None, right: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Upper bounds of the inner products of rows of ``asked`` with all of ``index``, but for SLACK, in single precision: the
    number of the first row of some, and a line for each of them.

    The dims with most weight are multiplied, of the others the norms: by Cauchy and Schwarz their part is no greater.
    ``left`` and ``right`` are further columns of both sides.
    """
    names, at = np.unique(np.concatenate((asked.dims, index.dims)), return_inverse=True)
    weight = np.bincount(at, np.concatenate((asked.vals, index.vals)) ** 2, len(names))
    names = np.sort(names[np.argsort(-weight, kind="stable")[:BOUND_DIMS]])

    def side(rows: Block, more: np.ndarray | None) -> np.ndarray:
        kept = matrix_of(rows, names, np.float64)
        total = np.bincount(np.repeat(np.arange(len(rows)), np.diff(rows.start)), rows.vals**2, len(rows))
        rest = np.sqrt(np.maximum(0, total - (kept * kept).sum(1)) + 1e-12)
        return np.concatenate((kept, rest[:, None], *([] if more is None else [more])), axis=1).astype(np.float32)

    x, y = side(asked, left), side(index, right)
    for begin in range(0, len(asked), BOUND_ROWS):
        yield begin, x[begin : begin + BOUND_ROWS] @ y.T
