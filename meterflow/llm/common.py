"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step works on, unless a single text is longer.
STEP_BYTES = 1 << 20
#: White space that separates words: space and the controls 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(0, 2**63, dtype=np.uint64)) * 8 + 5 & (2**64 - 1)
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors see.

    Where the setting is absent a private folder serves, but only on a single machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="meterflow-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing is computed from any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the hash base, or of its inverse, modulo 2**64."""
    base = _INVERSE if inverse else _BASE
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
        steps[0] = 1
        known = np.cumprod(steps)
        if n <= 4 * STEP_BYTES:
            _powers[base] = known
    return known[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums over ``data``; ``window_hashes`` takes substrings out of them."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=sums[1:])
    return sums


def window_hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Karp-Rabin hash of each ``data[start:stop]``."""
    return mixed((sums[stop] - sums[start]) * powers(len(sums), True)[start] + (stop - start).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column and where each begins (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def steps(offsets: np.ndarray):
    """Ranges of rows whose texts have about ``STEP_BYTES`` together."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop
        row = stop


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of some texts, where each word in them begins and ends, and the number of
    the first word of each text.

    Words are runs of other bytes than white space; A-Z are lower-cased, nothing else is.
    """
    first, last = int(offsets[0]), int(offsets[-1])
    data, offsets = LOWER[data[first:last]], offsets - first
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~SPACE[data]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[filled] = inside[filled]
    ends = inside[:-1] & ~inside[1:]
    ends[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = inside[offsets[1:][offsets[:-1] < offsets[1:]] - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return data, start, stop, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and the number of the first word of each text."""
    data, start, stop, first = word_spans(data, offsets)
    return window_hashes(prefix_hashes(data), start, stop), first


def list_array(flat, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
