"""Tables written in the shared checkpoint folder, which cut the lineage of iterative queries."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the application's Python workers, which may have no copy of it; once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="glyphlake-package-")
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/glyphlake_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


#: Bytes of rows that go to a Python worker at once, unless the application says otherwise.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Send rows to Python workers in batches of BATCH_BYTES.  Spark's own bound is 64 MB, which each task holds several
    times: as Arrow vectors in the executor, and in its worker as texts and as what is made of them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


_temporary: dict[str, str] = {}
_written: list[tuple[str, str]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names.  Where none is set, the warehouse, and in local mode a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/glyphlake"
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _temporary:
            _temporary[app] = tempfile.mkdtemp(prefix="glyphlake-")
            atexit.register(shutil.rmtree, _temporary[app], True)
        root = _temporary[app]
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared checkpoint folder, deleted with what the application has written."""
    ship(spark)
    path = f"{checkpoint_root(spark)}/glyphlake-{label}-{uuid.uuid4().hex}"
    _written.append((spark.sparkContext.applicationId, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean_at_exit() -> None:
    """What an application has written for itself goes with it, if its session still runs."""
    spark = SparkSession.getActiveSession() if _written else None
    if spark is not None:
        with contextlib.suppress(Exception):
            clean(spark)


def clean(spark: SparkSession) -> int:
    """Delete the tables that this application has written here, once no result reads them any more."""
    app, jvm, gone = spark.sparkContext.applicationId, spark.sparkContext._jvm, 0
    for owner, name in list(_written):
        if owner == app:
            path = jvm.org.apache.hadoop.fs.Path(name)
            gone += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            _written.remove((owner, name))
    for k in [k for k in _kept if k[0] == app]:
        del _kept[k]
    return gone


_kept: dict[tuple[str, str], str] = {}


def kept(spark: SparkSession, key: str, make) -> DataFrame:
    """A table that an application writes once, in the shared checkpoint folder, and reads from then on.

    make(path) writes it; key names what it is made from."""
    ship(spark)
    app = spark.sparkContext.applicationId
    if (app, key) not in _kept:
        path = f"{checkpoint_root(spark)}/glyphlake-kept-{uuid.uuid4().hex}"
        make(path)
        _kept[app, key] = path
        _written.append((app, path))
    return spark.read.parquet(_kept[app, key])


def global_rank(df: DataFrame, order: list, out: str, label: str = "rank", size: str | None = None) -> DataFrame:
    """Rows with their place, from 0, in a total order: sorted by ranges, counted by range, and added up.  With size, the
    place is the sum of that column over the rows before.

    The sorted rows are written with their range and place in it, so that both readings see the same; the table of
    range sizes has a row a range."""
    import pyspark.sql.functions as F
    from pyspark.sql import Window

    part, place = "__part", "__place"
    ranged = df.orderBy(*order).select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(place))
    placed = materialize(ranged, label)
    before = F.col(place)
    if size is not None:
        inner = Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        placed, before = placed.withColumn("__before", F.coalesce(F.sum(size).over(inner), F.lit(0))), F.col("__before")
    sizes = placed.groupBy(part).agg((F.count(F.lit(1)) if size is None else F.sum(size)).alias("__n"))
    starts = sizes.select(F.col(part).alias("__p"), F.coalesce(F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), F.col(part) == F.col("__p")).withColumn(out, F.col("__start") + before).drop(part, place, "__p", "__start", "__before")
