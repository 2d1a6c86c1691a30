"""Helpers shared by the operators: plain views of input tables, Arrow batches of bounded size, ragged arrays.

Conventions of all operators:

* input tables may hold further columns; operators pick the columns they are
  given by name, and every column they add on the way starts with ``__``;
* a null text counts as the empty text; a null id stays null;
* repeated rows stay repeated rows, an empty table gives an empty result.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes that a Python task looks at together (one longer text is looked at alone).
SLICE_BYTES = 4 << 20


def quoted(name: str) -> Column:
    """The column called ``name``, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def doc_view(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string never null): what the document operators read."""
    return docs.select(quoted(id_col).cast("long").alias("doc_id"),
                       F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterable[pa.RecordBatch], text_col: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, in slices whose texts add up to about ``most`` bytes."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(text_col)
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        group = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text_col: str = "text",
               most: int = SLICE_BYTES) -> DataFrame:
    """``fn`` over bounded slices of the rows, inside Spark tasks."""
    def run(batches):
        for piece in slices(batches, text_col, most):
            yield fn(piece)

    return df.mapInArrow(run, schema)


def ragged(src: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The pieces ``src[starts[i] : starts[i] + lens[i]]``, one after the other."""
    lens = lens.astype(np.int64, copy=False)
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts.astype(np.int64, copy=False) - (ends - lens), lens)
    at += np.arange(total, dtype=np.int64)
    return src[at]


def scratch_file():
    """A file without a name, for one task, among the folders to which Spark itself spills on this machine."""
    folders = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
    return tempfile.TemporaryFile(dir=folders[os.getpid() % len(folders)] if folders else None)


class Growing:
    """A numpy array that grows by appending."""

    def __init__(self, dtype):
        self.data, self.size = np.empty(1024, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            data = np.empty(max(need, 2 * len(self.data)), self.data.dtype)
            data[: self.size] = self.data[: self.size]
            self.data = data
        self.data[self.size : need] = values
        self.size = need

    def view(self) -> np.ndarray:
        return self.data[: self.size]


class Codes(dict):
    """Numbers pieces of text in the order of their first appearance; ``fresh`` holds those not yet worked on."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []
        self.known = 0

    def __missing__(self, piece):
        self[piece] = n = self.known
        self.known += 1
        self.fresh.append(piece)
        return n
