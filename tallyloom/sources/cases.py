"""Files of cases: small texts put at exact paths of any store, through Hadoop's file systems.

Every write goes to a name of its own and is renamed, so a reader sees the old file or the new one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file whole."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = at.getFileSystem(conf).create(draft, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE  # the store's own step: no reader finds neither file
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, at, options)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def touch(spark: SparkSession, path: str) -> None:
    """Make a file of one blank line where there is none (Spark's readers pass over files without bytes)."""
    if not exists(spark, path):
        put_text(spark, path, "\n")


def publish(spark: SparkSession, assets: str, site: str, target: str) -> None:
    """Copy a viewer's built assets and a case's site files to where they are served; assets that are not there are an error."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if not exists(spark, assets):
        raise FileNotFoundError(f"the viewer is not built: {assets}")
    to = jvm.org.apache.hadoop.fs.Path(target)
    out = to.getFileSystem(conf)
    out.mkdirs(to)
    for folder in (assets, site):
        at = jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(conf)
        for entry in fs.listStatus(at):
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, entry.getPath(), out, jvm.org.apache.hadoop.fs.Path(to, entry.getPath().getName()), False, True, conf)


def put_records(rows: DataFrame, root: str, name: str, key: str = "case_id", text: str = "text") -> int:
    """Write the text of each row to root/<key>/<name>; returns how many. Rows come one partition at a time."""
    n = 0
    for row in rows.select(key, text).toLocalIterator():
        put_text(rows.sparkSession, f"{root}/{row[key]}/{name}", row[text] + "\n")
        n += 1
    return n


def read_cases(spark: SparkSession, root: str) -> DataFrame:
    """(case_id, path, text) of the Markdown files, logs and JSON records below a folder of cases."""
    at = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))
    inner = F.regexp_extract("file", r"/([^/]+)/((?:modules/|findings/|issues/|case_state/)?[^/]+\.(?:md|jsonl|json))$", 1)
    path = F.regexp_extract("file", r"/([^/]+)/((?:modules/|findings/|issues/|case_state/)?[^/]+\.(?:md|jsonl|json))$", 2)
    return at.select(inner.alias("case_id"), path.alias("path"), "text").where("path <> ''")
