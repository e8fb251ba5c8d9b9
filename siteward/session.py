"""Session defaults and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (local tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/siteward"


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = LOCAL_CHECKPOINTS
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and a lost executor costs no recompute."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/siteward-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siteward_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by materialize() that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._siteward_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> bool:
    """Whether a table written by materialize() is still there."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._siteward_path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def signature(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> tuple:
    """Path, length and time of change of the files of a folder's tables, part files included."""
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    todo = [jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{n}.parquet") for n in names]
    while todo:
        path = todo.pop()
        for f in path.getFileSystem(conf).listStatus(path):
            if f.isDirectory():
                todo.append(f.getPath())
            else:
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


#: What a session has built of a folder's tables, so that a dozen queries do not build it a dozen times: (key, signature, value).
_BUILT: dict[tuple, tuple[tuple, object]] = {}


def once(spark: SparkSession, sf_dir: str, names: tuple[str, ...], what: str, build, tables):
    """build() for these tables of a folder, or what it gave earlier in this session, if their files are still the same and the
    tables that it wrote, tables(value), are still there."""
    key, now = (spark.sparkContext.applicationId, sf_dir, what), signature(spark, sf_dir, names)
    was = _BUILT.get(key)
    if was is None or was[0] != now or not all(kept(t) for t in tables(was[1])):
        was = _BUILT[key] = now, build()
    return was[1]
