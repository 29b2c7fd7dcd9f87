"""What the text operators share."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a Python task works on at once.
SLICE_BYTES = 4 << 20
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str) -> list[bytes]:
    """Words by the contracts' white space: exactly the bytes at which ``bytes.split`` splits."""
    return text.encode("utf-8", "surrogatepass").split()


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def own_names(columns: list[str], *made: str) -> None:
    """Refuses columns that have the name of a result, before any job runs."""
    clash = {c.lower() for c in columns} & {m.lower() for m in made}
    if clash:
        raise ValueError(f"columns {sorted(clash)} have names of results: rename them or leave them out")


def for_texts(frame: DataFrame) -> DataFrame:
    """The frame itself, after the session's Arrow batches were set to BATCH_ROWS rows at most: batches of the usual 10,000 long
    texts are tens of megabytes in the executor's direct memory and again in the worker."""
    conf = frame.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return frame


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Small batches joined until their texts hold about ``limit`` bytes."""
    some: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        some.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.concat_batches(some)
            some, size = [], 0
    if some:
        yield pa.concat_batches(some)


def sampled(frame: DataFrame, n: int, *key: Column | str) -> DataFrame:
    """About the ``n`` rows of the smallest key hash, as ``_h`` and the frame's columns. Only hashes reach the driver to find
    the cut, n of each task at most; rows follow for those that are taken. Equal keys stand or fall together."""
    hashed = frame.withColumn("_h", F.xxhash64(*key))
    cut = hashed.select("_h").orderBy("_h").limit(n).agg(F.max("_h")).first()[0]
    return hashed.where(F.col("_h") <= F.lit(cut)) if cut is not None else hashed.limit(0)


def fitted(sample: DataFrame, fit: Callable[[list[dict]], object], text: str = "text", most: int = 16 << 20) -> object:
    """What ``fit`` makes of the rows of a small ordered ``sample``, in one task of an executor; its pickled result is all that
    comes to the driver. Rows are taken in order while their texts hold ``most`` bytes together; those that would not fit
    are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        left = most
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                for row in part.to_pylist():
                    size = len((row[text] or "").encode("utf-8", "surrogatepass"))
                    if size <= left:
                        left -= size
                        rows.append(row)
        made = pickle.dumps(fit(rows))
        del rows
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["made"])

    found = for_texts(sample).coalesce(1).mapInArrow(run, "made binary").collect()
    return pickle.loads(bytes(found[0].made)) if found else fit([])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts hold about ``limit`` bytes; one long text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start, done = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])
    give_back()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... for every run, one after the other."""
    if not len(counts) or not counts.sum():
        return np.zeros(0, np.int64)
    total = np.cumsum(counts)
    return np.arange(total[-1]) + np.repeat(starts - (total - counts), counts)


def give_back() -> None:
    """Return freed memory to the machine: a worker waits for its next task with what it holds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
