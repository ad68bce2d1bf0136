"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import ensure_checkpoint_dir

_written: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the cluster's checkpoint folder and read it back.

    It cuts the lineage at a table that all executors share, so losing one
    never repeats the work above it.  Columns are compressed, unlike in an
    RDD checkpoint.  The folders are removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone; the folder's owner cleans up then
            return


def text_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, null text as the empty string."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it (Spark's names ignore case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes, so that a batch of long texts stays small in memory."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, min(rows, int(size / max(1, b.nbytes / b.num_rows))))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def texts_utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 2000, cache: str = "",
                size: int = 16 << 20) -> DataFrame:
    """``mapInArrow`` over small slices of ``rows`` rows and about ``size`` bytes; ``fn`` returns one batch for each.  Objects that other operators left in the worker
    (all but ``cache``) are dropped first."""
    def run(batches):
        drop_caches(cache)
        for b in small_batches(batches, rows, size):
            yield fn(b)
            pa.default_memory_pool().release_unused()
    return df.mapInArrow(run, schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20000) -> Iterator[pa.Table]:
    """From batches sorted by ``keys``, tables of whole groups with about ``rows`` rows (more only if one group has more)."""
    held: list[pa.Table] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        n += b.num_rows
        if n < rows:
            continue
        t = pa.concat_tables(held).combine_chunks()
        last = [t.column(k)[t.num_rows - 1].as_py() for k in keys]
        cut = t.num_rows - 1
        cols = [t.column(k) for k in keys]
        lo, hi = 0, cut  # first row of the last group: sorted, so binary search
        while lo < hi:
            mid = (lo + hi) // 2
            if [c[mid].as_py() for c in cols] == last:
                hi = mid
            else:
                lo = mid + 1
        if lo:
            yield t.slice(0, lo)
            held, n = [t.slice(lo)], t.num_rows - lo
        else:
            held = [t]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


CACHE_MODULE = "_flowlens_process_cache"


def drop_caches(but: str) -> None:
    """Forget what earlier operators keep in this Python worker, except ``but``, and give the memory back."""
    import ctypes
    import gc
    import sys
    held = sys.modules.get(CACHE_MODULE)
    old = [k for k in vars(held) if not k.startswith("__") and k != but] if held else []
    for k in old:
        delattr(held, k)
    if old:
        gc.collect()
    # also what earlier tasks of this operator gave back: both allocators keep freed memory for themselves
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its allocator decides
        pass


def process_cache(name: str, make: Callable):
    """One object per Python worker process, kept between tasks (code shipped by value has no module to hold it)."""
    import sys
    import types
    held = sys.modules.setdefault(CACHE_MODULE, types.ModuleType(CACHE_MODULE))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)
