"""Shared helpers: stored intermediate tables, Arrow batching and vectorised word hashing."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once inside a Python worker.
CHUNK_BYTES = 2_000_000
#: Bytes of an Arrow batch, or one row.
BATCH_BYTES = 16_000_000

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables that cut lineage: ``spark.checkpoint.dir``; a temporary one where it is unset in a local session (tests).

    Tables go to a folder of the application's own there, which can be removed once its results are written.
    """
    found, app = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.applicationId
    if found:
        return f"{found.rstrip('/')}/quarry-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="quarry-")
    return _own_dirs[app]


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later steps don't depend on earlier tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more: what was made of them has been stored itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    tidy(tables[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs.

    It does so when the driver has collected their plans as garbage, which a driver with little to do puts off while the executors' disks
    fill; so it is asked to, twice, as once leaves what something else still held of the last job.
    """
    for pause in (0.2, 0.0):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(pause)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, wherever the session was started; once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))


def text_batches(spark: SparkSession) -> None:
    """Let the workers import what they run, and bound Arrow batches by rows and bytes (always alike, so lazy plans don't depend on the order of calls)."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES):
    """Slices of a batch whose texts hold about ``limit`` bytes, one row at least."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        table = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return table[:n]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some rows, A-Z lower-cased, as 64-bit hashes.

    hashes: of all words in order; bounds: row ``i`` has the words ``bounds[i]:bounds[i + 1]``;
    start, end: byte offsets of each word in ``buf``; offsets: of the rows in ``buf``.
    """

    def __init__(self, column: pa.Array):
        self.buf, self.offsets = text_bytes(column)
        n = len(self.buf)
        space = _SPACE[self.buf]
        edge = np.ones(n + 1, bool)  # edge[i]: no word goes on from byte i - 1 to byte i
        edge[1:n] = space[:-1] | space[1:] if n else edge[1:n]
        edge[self.offsets] = True
        edges = np.flatnonzero(edge)
        start, end = edges[:-1], edges[1:]
        keep = ~space[start] if n else np.zeros(0, bool)
        self.start, self.end = start[keep], end[keep]
        self.bounds = np.searchsorted(self.start, self.offsets)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * _power_table(_BASE, n), out=sums[1:], dtype=np.uint64)
        self.hashes = mix((sums[self.end] - sums[self.start]) * _power_table(_INVERSE, n + 1)[self.start] + (self.end - self.start).astype(np.uint64))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; ``words`` may span rows, so the caller drops runs across a border."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + n]
    return mix(out + np.uint64(size))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, lengths) -> pa.Array:
    """A list column of the given lengths over one flat array."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
