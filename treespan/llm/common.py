"""What the operators of this subpackage share: the shared folder, written tables, column names."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where it is unset in a local session, as in tests, is one set under /tmp; a cluster must name it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file:///tmp/treespan-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", at)
        _own.append((spark, at))
    return at.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while; what the caller had comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, kind: str = "table", compression: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: it cuts the lineage and
    outlives executors, so nothing before it is computed twice. Shuffle files of the write go with it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, kind)
    with setting(spark, _CLEAN_UP, "true"):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes ``written`` tables that nothing reads any more."""
    for df in tables:
        remove_path(df.sparkSession, df._table_path)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lets Arrow batches hold about ``most`` bytes, a row at least: Python workers' memory then
    doesn't follow the length of the texts. A smaller limit of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > most:
        spark.conf.set(key, str(most))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str):
    """A column by its literal name, dots and back-quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_arrow(df: DataFrame, run, added: T.StructType | None = None) -> DataFrame:
    """``df.mapInArrow(run, ...)`` for batches of all columns, whatever their names, and ``added`` ones after them."""
    fields = [*df.schema.fields, *(added.fields if added else [])]
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])

    def renamed(batches):
        for out in run(batches):
            yield pa.RecordBatch.from_arrays(out.columns, [f"c{i}" for i in range(out.num_columns)])

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(renamed, plain).toDF(*[f.name for f in fields])


def remove_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


@atexit.register
def _clean() -> None:
    import shutil

    for _, at in _own:
        shutil.rmtree(at.removeprefix("file://"), ignore_errors=True)
