"""Session settings and durable cut points."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "webquarry", **extra: str) -> SparkSession:
    """A session with the settings the jobs are written for.

    On a cluster these come from the submit configuration; only what is unset
    there is given here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Call-site capture triples the time it takes to build long expressions.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="webquarry-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def task_count(spark: SparkSession) -> int:
    """Tasks that rows are dealt over: the shuffle partitions, and two a core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Compute once into a table on shared storage and go on from that table.

    Later reads prune columns, know their size and carry no lineage.
    """
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_durable(df: DataFrame) -> None:
    """Delete a table written by :func:`durable` that nothing reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        delete_path(df.sparkSession, folder)


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """A small file on shared storage that is there whole or not at all."""
    target, draft = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.rename(draft, target)


def read_notes(spark: SparkSession, folder: str) -> dict[str, str]:
    """The notes below a folder by name."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(place):
        return {}
    notes = {}
    for status in files.listStatus(place):
        name = status.getPath().getName()
        if not name.endswith(".draft"):
            stream = files.open(status.getPath())
            notes[name] = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
    return notes


class UrlTables:
    """Tables written to the shared folder, bucketed and sorted by one key.

    A bucketed table is a durable cut of the lineage that also remembers how it
    is laid out: joins and anti joins between such tables shuffle neither side.
    :meth:`drop` removes a table that nothing reads any more, :meth:`forget` only
    the catalog entries of those whose rows are the result.
    """

    def __init__(self, spark: SparkSession, key: str, buckets: int | None = None):
        self.spark = spark
        self.key = key
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.paths: dict[str, str] = {}

    def new(self, path: str | None = None) -> str:
        """A name for a table and a folder for its files."""
        name = f"webquarry_{uuid.uuid4().hex}"
        self.paths[name] = path or new_folder(self.spark, "table")
        return name

    def append(self, name: str, df: DataFrame, part: str | None = None) -> None:
        """Add rows to a table, which should be partitioned by the key already."""
        writer = df.write.format("parquet").mode("append").bucketBy(self.buckets, self.key).sortBy(self.key)
        if part:
            writer = writer.partitionBy(part)
        writer.option("path", self.paths[name]).saveAsTable(name)

    def attach(self, path: str, schema: str, part: str | None = None) -> str:
        """The table an earlier run wrote to ``path`` with as many buckets."""
        name = self.new(path)
        parts = f"PARTITIONED BY ({part})" if part else ""
        self.spark.sql(
            f"CREATE TABLE {name} ({schema}) USING parquet {parts} CLUSTERED BY ({self.key}) SORTED BY ({self.key}) "
            f"INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        if part:
            self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return name

    def write(self, df: DataFrame, path: str | None = None) -> DataFrame:
        """Store ``df``, which should be partitioned by the key already."""
        return self.spark.table(self.stored(df, path))

    def stored(self, df: DataFrame, path: str | None = None) -> str:
        """The name of a table that holds ``df``."""
        name = self.new(path)
        self.append(name, df)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(self.spark, self.paths.pop(name))

    def spread(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.buckets, self.key)

    def forget(self) -> None:
        for name in self.paths:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.paths = {}
