"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that the vectorised kernels handle at a time: their working arrays are 8 to 40 times as large.
CHUNK_BYTES = 1 << 19
#: Rows of a batch between Spark and a worker: texts are long, and a batch is held several times over on either side.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Operation by which a Java virtual machine gives freed native memory back.
TRIM_NATIVE = "systemTrimNativeHeap"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Where that is unset, a temporary one serves while both are one process (tests); on a cluster it raises, as nobody else would see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def checkpoint(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df, written to the shared folder and cut from its lineage.

    Shuffle files of steps before that nothing refers to any more are let go first, which Spark does when the driver collects its garbage.
    """
    sc = spark.sparkContext
    give_back(spark)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def give_back(spark: SparkSession) -> None:
    """The driver collects its garbage and gives freed pages back to the system, those of Python and those of its virtual machine."""
    gc.collect()
    if _trim is not None:
        _trim(0)
    spark.sparkContext._jvm.System.gc()
    trim_native_heap(spark)


def trim_native_heap(spark: SparkSession) -> str | None:
    """What the driver's virtual machine says to giving back what it has freed outside its heap; None if it can't.

    Its compilers use and free tens of MB with each large plan, in many threads, and the C library keeps that until it is asked. The
    operation is called through its public interface, as the class behind it isn't open to reflection.
    """
    sc = spark.sparkContext
    jvm, array = sc._jvm, sc._gateway.new_array
    try:
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), TRIM_NATIVE
        given[2], given[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # other virtual machines and C libraries
        return None


_held: dict[str, Callable[[], None]] = {}
#: Gives the pages that former tasks freed back to the system, where the C library can.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def hold(name: str, clear: Callable[[], None]) -> None:
    """Tells how to let go of what a worker remembers for the tasks of one operator."""
    _held[name] = clear


def release(own: str = "") -> None:
    """Lets go of what this worker remembers for other operators: it may run the tasks of many."""
    for name in [n for n in _held if n != own]:
        _held.pop(name)()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context, so that workers can import it wherever they run."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_ROWS) == "10000":  # the default, unless the session has a size of its own
        spark.conf.set(BATCH_ROWS, "1000")
    if getattr(sc, "_siftwright_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="siftwright-")) / "siftwright_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._siftwright_shipped = True


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without copying, and the n + 1 offsets of its values; nulls count as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, width, count=len(column) + 1, offset=column.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about size bytes each, and one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end
        row = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64, whose constants are fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
