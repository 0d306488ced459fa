"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "terrier", **conf: str) -> SparkSession:
    """A small session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a ``local[...]`` session, whose executors are threads of the driver,
    gets a folder of its own where none is named; a cluster session must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="terrier-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_file(spark: SparkSession) -> str:
    """A place of its own in the shared folder."""
    return f"{scratch_dir(spark)}/terrier/{uuid.uuid4().hex}"


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result survives lost executors, is computed once however often it is
    used, and has a size Spark can see. Operators stage small tables only
    (lookups, heavy keys, loop state); plans stage a step that is read many times.
    """
    spark = df.sparkSession
    path = scratch_file(spark)
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)


#: Whether shuffle files go once the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """``staged``, with the shuffle files that made it removed: nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return staged(df)
    finally:
        conf.set(CLEANUP, before)


def discarded(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
