"""Session construction and lineage-cut helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every tillroll job wants: adaptive execution (partition coalescing,
# skew-join splitting, empty-relation propagation), Arrow for pandas UDFs, a
# fixed session zone so timestamp_ntz arithmetic never depends on the host.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "tillroll",
                shuffle_partitions: int | None = None,
                extra_conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    On a cluster leave ``master`` unset and size ``shuffle_partitions`` to the
    data (AQE coalesces small ones); locally it defaults to the core count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is None and master and master.startswith("local"):
        shuffle_partitions = os.cpu_count() or 8
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per Spark context.

    Kernels run in Python workers that import them by name; a worker has no
    copy of the driver's folder, so the sources go out as one small zip.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tillroll_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tillroll-zip-"), "tillroll_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.join("tillroll", os.path.relpath(p, root)))
    sc.addPyFile(target)
    sc._tillroll_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; we only invent a local one when the
    setting is absent and the master is local. Elsewhere a missing setting is
    an error: executors would write to their own disks.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tillroll-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


# Folders written by cut_lineage that still exist, oldest first.
_written: list[str] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared checkpoint folder and read it back.

    Iterative operators (Apriori levels, component labelling, merge rounds)
    call this once per round so plans stay short and a lost executor
    recomputes one round, not the whole history. A written table (rather
    than ``Dataset.checkpoint``) gives the next round a plain scan: the plan
    carries no statistics or constraints of earlier rounds, and the input is
    computed once. ``release`` deletes the folder of a table that nothing will
    read again, ``drop_intermediates`` those of all finished queries.
    """
    spark = df.sparkSession
    ship_package(spark)
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tillroll-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    track_folder(spark, path)
    out = spark.read.parquet(path)
    out._tillroll_path = path
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder that keeps its partitions and their order.

    ``cut_lineage`` is the cheaper form; this one is for tables that later
    steps read partition by partition, since files read back are dealt anew.
    """
    spark = df.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        track_folder(spark, file.get())
    return out


def track_folder(spark: SparkSession, path: str) -> None:
    """Have ``drop_intermediates`` (and process exit) delete a folder that an operator wrote."""
    if not _written:
        atexit.register(_drop_quietly, spark)
    _written.append(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def release(df: DataFrame) -> None:
    """Delete the folder behind a ``cut_lineage`` result that no plan will read again."""
    path = getattr(df, "_tillroll_path", None)
    if path in _written:
        _written.remove(path)
        _delete(df.sparkSession, path)


def drop_intermediates(spark: SparkSession) -> int:
    """Delete every intermediate folder of this application; call it once results have been consumed.

    Query results are lazy and may read these folders, so they can't go when a
    query function returns. Returns the number of folders deleted.
    """
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n


def _drop_quietly(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        drop_intermediates(spark)
