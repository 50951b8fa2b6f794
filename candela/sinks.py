"""Plain tables of text, for reports, and files that are written whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_table(rows: DataFrame, columns: list[str], width: int) -> DataFrame:
    """rows with line: the chosen columns, each cut to the width (with a dot) and padded."""
    cell = lambda c: F.rpad(F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("."))).otherwise(F.col(c)), width, " ")
    return rows.withColumn("line", F.concat_ws(" ", *(cell(c) for c in columns)))


def write_files(files: DataFrame, folder: str) -> list[str]:
    """(name, body), each name once -> a file of that name in the folder for each row; their names.

    Spark writes to a folder beside them, where its committer lets in each task's
    output once, whatever is tried again; when the job has ended, each file is
    moved to its name, which replaces an older one in one step. A job that fails
    leaves the folder as it was. The names are those of a report's files, a few
    for each instrument.
    """
    spark = files.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    place, pending = path(folder), path(f"{folder.rstrip('/')}/_pending-{uuid.uuid4().hex}")
    system = place.getFileSystem(conf)
    try:
        files.select("name", F.col("body").alias("value")).write.partitionBy("name").text(pending.toString())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf)
        replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        names = []
        for own in system.listStatus(pending):
            if "=" not in own.getPath().getName():
                continue
            parts = [s.getPath() for s in system.listStatus(own.getPath()) if s.getPath().getName().startswith("part-")]
            name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(own.getPath().getName().split("=", 1)[1])
            if len(parts) != 1:
                raise ValueError(f"{name} is the name of several files")
            context.rename(system.makeQualified(parts[0]), system.makeQualified(path(place, name)), replace)
            names.append(name)
        return sorted(names)
    finally:
        system.delete(pending, True)
