"""Session helpers: a local session for tests, lineage cuts and tables in the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "flagframe", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # longer methods are never compiled by the JVM; beyond this Spark takes expressions that it splits
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_by_all(folder: str, master: str) -> bool:
    """Whether every executor sees ``folder``: in a local session any, elsewhere none on a machine's own disk."""
    return master.startswith("local[") or master == "local" or not (folder.startswith("file:") or folder.startswith("/"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taking the one the cluster names when there is one.

    Without ``spark.checkpoint.dir`` a folder under the session's warehouse is
    taken. A warehouse on a machine's own disk is shared by nothing but a local session: elsewhere that raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not shared_by_all(warehouse, sc.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the warehouse {warehouse} is a local folder")
        shared = f"{warehouse}/_flagframe_checkpoints"
    sc.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the checkpoint folder for a table that is written and read back."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and return the written table.

    Later stages read back only the columns they need, see the same rows however
    often they run, and Spark knows the size of the files: it broadcasts such a table
    in a join only where that measured size is under the session's limit.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``staged`` that nothing reads any more."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/") + "/"
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.split(":", 1)[-1].lstrip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)
