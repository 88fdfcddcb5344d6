"""A9/T6 contingency tables with very many keys: numbered keys and blocks of cells.

Both key sets get dense numbers in key order (``numbering.key_numbers``); the counts are laid
out in square blocks of ``side`` rows and columns.  A block is the unit that is stored, joined and
filled with zeros; neither key set ever is an array, a map or a list on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventscope.operators.numbering import key_numbers
from eventscope.session import work_path


@dataclass
class BlockMatrix:
    """``rows`` and ``cols``: (key, number); ``blocks``: (row_block, col_block, at, n), where cell
    (r, c) of a block stands at r * side + c; empty blocks are left out."""

    rows: DataFrame
    cols: DataFrame
    blocks: DataFrame
    side: int


def _written(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, "matrix", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_matrix(df: DataFrame, row: str, col: str, side: int = 256) -> BlockMatrix:
    """Counts of (row, col) pairs, rows with a NULL in either left out."""
    pairs = _written(df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
                     .groupBy(row, col).agg(F.count(F.lit(1)).alias("n")), "pairs")
    rows, cols = _written(key_numbers(pairs, row, "r"), "rows"), _written(key_numbers(pairs, col, "c"), "cols")
    cell = F.struct(((F.col("r") % side) * side + F.col("c") % side).cast("int").alias("at"), "n")
    blocks = (pairs.join(rows, row).join(cols, col)
              .groupBy(F.floor(F.col("r") / side).alias("row_block"), F.floor(F.col("c") / side).alias("col_block"))
              .agg(F.sort_array(F.collect_list(cell)).alias("cells"))       # at most side * side
              .select("row_block", "col_block", F.col("cells.at").alias("at"), F.col("cells.n").alias("n")))
    return BlockMatrix(rows, cols, _written(blocks, "blocks"), side)


def _fill(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            rb, cb, height, width = (batch.column(j)[k].as_py() for j in range(4))
            cells = np.zeros((side, side), np.int64)
            at = batch.column(4)[k].values
            if at is not None:
                cells.reshape(-1)[at.to_numpy()] = batch.column(5)[k].values.to_numpy()
            cells = cells[:height, :width]
            r = np.repeat(np.arange(height) + rb * side, width)
            c = np.tile(np.arange(width) + cb * side, height)
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(c), pa.array(cells.reshape(-1))], names=["r", "c", "count"])


def filled(m: BlockMatrix) -> DataFrame:
    """The zero-filled table in long form (row, col, count), block by block."""
    row, col, side = m.rows.columns[0], m.cols.columns[0], m.side
    of = {name: d.groupBy(F.floor(F.col(n) / side).alias(f"{name}_block")).agg(F.count(F.lit(1)).cast("int").alias(f"{name}_size"))
          for name, d, n in (("row", m.rows, "r"), ("col", m.cols, "c"))}
    last = m.cols.select(F.floor(F.max("c") / side)).scalar()
    grid = (of["row"].select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("col_block"))
            .join(of["col"], "col_block").join(m.blocks, ["row_block", "col_block"], "left")
            .select("row_block", "col_block", "row_size", "col_size", "at", "n"))
    cells = grid.mapInArrow(lambda it: _fill(it, side), "r long, c long, count long")
    return cells.join(m.rows, "r").join(m.cols, "c").select(row, col, "count")
