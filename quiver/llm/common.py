"""What the operators share: working tables, Arrow batches, small text helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in an Arrow batch, so that a batch of long documents stays in a worker's memory.
ARROW_ROWS = 1024
ARROW_BYTES = 16 << 20

#: Characters that count as symbols, as bytes.
SYMBOLS = b"#*$%&|<>"

_made: list[tuple[SparkSession, str]] = []
_lasting: set[str] = set()
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and all run on one machine, as in tests, is a temporary folder made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quiver-")
        spark.conf.set("spark.checkpoint.dir", folder)
        _made.append((spark, folder))
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. It is removed at the end of ``passing``, or when the driver's Python ends."""
    path = f"{shared_folder(spark)}/quiver/{uuid.uuid4().hex}/{name}"
    _made.append((spark, path.rpartition("/")[0]))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever store it is in."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before
            return


@contextmanager
def passing() -> Iterator[None]:
    """Tables written inside are removed at the end, but for ``lasting`` ones: no result may still need the others."""
    at = len(_made)
    try:
        yield
    finally:
        for spark, path in [x for x in _made[at:] if x[1] not in _lasting]:
            remove(spark, path)
            _made.remove((spark, path))


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if lasting:
        _lasting.add(path.rpartition("/")[0])
    # once the table is written, the shuffle files that led to it are of no use
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame, among: list[DataFrame]) -> DataFrame:
    """The same rows from executors' disks, made again where an executor is lost. ``release`` lets go of ``among``.

    For rows that any order of work makes alike and that are read more than once before something is written.
    """
    out = df.persist(StorageLevel.DISK_ONLY)
    among.append(out)
    return out


def release(among: list[DataFrame]) -> None:
    while among:
        among.pop().unpersist()


def ship(spark: SparkSession) -> None:
    """Send this package to executors whose Python doesn't find it; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = __name__.partition(".")[0]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import importlib.util

        import pyarrow

        for batch in batches:
            found = importlib.util.find_spec(package) is not None
            yield pyarrow.RecordBatch.from_pydict({"found": [found] * batch.num_rows})

    n = max(1, spark.sparkContext.defaultParallelism)
    if not spark.range(0, n, 1, n).mapInArrow(probe, "found boolean").filter("not found").isEmpty():
        import quiver

        top = os.path.dirname(os.path.dirname(os.path.abspath(quiver.__file__)))
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="quiver-"), package), "zip", top, package)
        spark.sparkContext.addPyFile(made)


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Make Arrow batches small enough for whole documents, unless the session already has smaller ones."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for a function of one batch; the input should hold only the columns it needs."""
    arrow_rows(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """As many partitions as keep each at about ``per_partition`` rows."""
    return max(1, min(200_000, -(-rows // per_partition)))


def in_fold(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is held out: crc32 of its id's text modulo ``folds`` is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    """What ``numpy.unique`` returns, by sorting: many times as fast for 64-bit hashes."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(column).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_all_cores(df: DataFrame) -> DataFrame:
    """The same rows, dealt to all cores where the Parquet files below have fewer row groups than there are cores.

    A row group is read by one task, so Python work on a table of few of them would leave cores idle. A table of as
    many files as cores is taken as it is, without a look into its files.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df._jdf.inputFiles()
    if not 0 < len(files) < cores:
        return df
    jvm, conf, groups = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for file in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
            jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf)
        )
        try:
            groups += reader.getFooter().getBlocks().size()
        finally:
            reader.close()
    return df if groups >= cores else df.repartition(cores)
