"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of each application without spark.checkpoint.dir (local tests), the folder that stands for it.
_LOCAL: dict[str, str] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK, _SAVING = threading.Lock(), {"now": 0, "before": None}


@contextlib.contextmanager
def _shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """While any table is being saved, jobs drop their shuffle files when they end; afterwards the session is as it was."""
    with _LOCK:
        if not _SAVING["now"]:
            _SAVING["before"] = spark.conf.get(_CLEAN)
            spark.conf.set(_CLEAN, "true")
        _SAVING["now"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _SAVING["now"] -= 1
            if not _SAVING["now"]:
                spark.conf.set(_CLEAN, _SAVING["before"])


class Scratch:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor shares.

    ``save`` writes a DataFrame there and returns it reread, which cuts the lineage
    and survives lost executors. Where the setting is absent (local tests) a temporary
    folder of this machine is used; on a cluster the setting must be present. Operators
    drop what their result doesn't read; the rest goes when the driver's program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tabulon-")
            _LOCAL[spark.sparkContext.applicationId] = base
        self.spark, self.path, self.names = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}", set()
        jvm = spark._jvm
        self._at = lambda path: jvm.org.apache.hadoop.fs.Path(path)
        self._conf = spark._jsc.hadoopConfiguration()
        atexit.register(self._end)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with _shuffle_files_go(self.spark):
            df.write.parquet(f"{self.path}/{name}")
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete one saved table that nothing reads any more."""
        self.names.discard(name)
        path = self._at(f"{self.path}/{name}")
        path.getFileSystem(self._conf).delete(path, True)

    def keep(self, *names: str) -> None:
        """Delete all saved tables but these."""
        for name in self.names.difference(names):
            self.drop(name)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the gateway may be gone
            path = self._at(self.path)
            path.getFileSystem(self._conf).delete(path, True)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """For functions of mapInArrow: a worker outlives its task, so what the allocators keep goes back to the system at the task's end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
        if trim:
            trim(0)

    return wrapped


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start, held = 0, 0
        for i, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)
