"""What the operators of this subpackage share.

Words are runs of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``),
which is what ``bytes.split()`` yields.  Large intermediate results that are used
more than once are written as Parquet below ``spark.checkpoint.dir``, which every
executor can reach, so that a lost executor costs a recomputation and no data.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

WHITE = b" \t\n\x0b\x0c\r"
#: Estimated bytes of a table that one bucket of a shuffle stands for.
BUCKET_BYTES = 8 << 20
#: Hadoop's usual class for local files launches chmod for each file and for its checksum file. Until such a child has begun, all of the
#: executor's memory counts with it. This class leaves one launch, for a task's folder; there are no checksum files. Other file systems don't care.
_LOCAL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one of our own in local mode and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files as soon as they have ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _file_system(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def keep(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, and is computed once.

    The table goes with :func:`forget`, and in any case when the driver's JVM ends.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.options(**_LOCAL_FILES).parquet(path)
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def forget(spark: SparkSession, *kept: DataFrame) -> None:
    """Delete tables of :func:`keep` that no later step reads."""
    for df in kept:
        files, where = _file_system(spark, df._lodestone_path)
        files.delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession, df: DataFrame) -> int:
    """How many buckets a shuffle in proportion to ``df`` takes: Spark's setting, or more if the planner's size of ``df`` asks for it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 60  # a table of unknown size counts as endless
    return max(partitions(spark), -(-size // BUCKET_BYTES) if known else 1)


def dealt(df: DataFrame, n: int, column) -> DataFrame:
    """The rows by their bucket, an int ``column`` from 0 to ``n`` - 1, one bucket to a task: hashed numbers would meet, four or five in some task."""
    return df.repartitionById(n, column)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, so that its tasks share it."""
    home = sys.modules.setdefault("_lodestone_worker_cache", types.ModuleType("_lodestone_worker_cache"))
    return home.__dict__.setdefault(name, {})


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, whatever else the table has; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def give_back() -> None:
    """What a task has freed goes back to the system: workers live on, and their executor's memory is counted with them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def to_frame(batch: pa.RecordBatch | pa.Table) -> pd.DataFrame:
    """Pandas would make doubles of 64-bit integers beside a null; these stay integers."""
    return batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


def frames(df: DataFrame, run: Callable[[Iterable[pd.DataFrame]], Iterable[pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` by way of Arrow, in which 64-bit integers stay exact beside nulls."""
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def call(batches):
        for pdf in run(map(to_frame, batches)):
            yield pa.RecordBatch.from_pandas(pdf, schema=out, preserve_index=False)
        give_back()

    return df.mapInArrow(call, schema)
