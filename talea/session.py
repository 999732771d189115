"""Sessions, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders made by this process, by their session's application id.
_made: dict[str, str] = {}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session in UTC with adaptive execution, for tests and benches."""
    build = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("talea")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        build = build.config(k, v)
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one named by ``spark.checkpoint.dir``.

    Where the session names none, a local session takes a temporary folder;
    on a cluster, whose machines share no such folder, this is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    app = sc.applicationId
    if app not in _made:
        if not base:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
            base = "file://" + tempfile.mkdtemp(prefix="talea-")
        _made[app] = f"{base.rstrip('/')}/talea-{uuid.uuid4().hex}"
        # the JVM outlives the session, so that the folder can be deleted after spark.stop()
        atexit.register(_clear, app, sc._jvm, sc._jsc.hadoopConfiguration())
    return _made[app]


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage like a checkpoint, but keeps columns prunable and gives
    the planner the measured size, so that it broadcasts only what is small.
    """
    return df.sparkSession.read.schema(df.schema).parquet(store(df, *partition_by))


def store(df: DataFrame, *partition_by: str) -> str:
    """Writes ``df`` to a new folder below the shared one; returns its path."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def _delete(jvm: object, conf: object, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder written by :func:`store` that nothing reads any more."""
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


def _clear(app: str, jvm: object, conf: object) -> None:
    path = _made.pop(app, None)
    if path:
        try:
            _delete(jvm, conf, path)
        except Exception as e:  # at the process's end the JVM may be gone
            print(f"left behind: {path} ({type(e).__name__})", file=sys.stderr)


def clear_shared(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this session. Results not yet written become unreadable."""
    _clear(spark.sparkContext.applicationId, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
