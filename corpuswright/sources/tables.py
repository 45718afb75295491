"""The materials table: scan, tolerant decode, append, delete, exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.materials import new_materials, with_content_hash
from ..schema import MATERIALS
from ..session import materialize, scratch_path


def read_materials(spark: SparkSession, path: str) -> DataFrame:
    """Materials table with its fixed schema, so no file is opened to infer one."""
    return spark.read.schema(MATERIALS).parquet(path)


def decode_json_cols(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Decode JSON text; anything malformed becomes an empty array, map or struct.

    ``cols`` maps a column to its DDL type. Keys outside the type are dropped.
    """
    return df.withColumns({name: _decode(F.col(name), ddl) for name, ddl in cols.items()})


def _decode(col: Column, ddl: str) -> Column:
    kind = ddl.strip().lower()
    decoded = F.from_json(col, ddl, {"mode": "PERMISSIVE"})
    if kind.startswith("array"):
        return F.coalesce(decoded, F.array().cast(ddl))
    if kind.startswith("map"):
        return F.coalesce(decoded, F.from_json(F.lit("{}"), ddl))
    return F.coalesce(decoded, F.from_json(F.lit("{}"), ddl))


def append_materials(new: DataFrame, path: str, seq: str = "order_index", in_batch: str = "first") -> DataFrame:
    """Write the incoming rows whose content the table does not hold yet.

    Bodies are read and hashed once, into a staged table; what is new is settled
    on ids and hashes. The rows to write are fixed before the append starts,
    because they depend on the table being appended to.
    """
    spark = new.sparkSession
    staged = materialize(with_content_hash(new), "append")
    keys = staged.select("id", "content_hash", seq)
    store = spark.read.parquet(path).select("id", "content_hash", seq) if _has_rows(spark, path) else keys.where(F.lit(False))
    fresh = materialize(new_materials(keys, store, seq, in_batch).select("id"), "fresh")
    rows = staged.join(fresh, "id", "left_semi")
    _balanced(rows).write.mode("append").partitionBy("source_type").parquet(path)
    return rows


def _balanced(rows: DataFrame) -> DataFrame:
    """Few files per partition; a partition with most of the rows is split."""
    return rows.hint("rebalance", F.col("source_type"))


def delete_materials(path: str, ids: DataFrame) -> None:
    """Remove ``ids`` by rewriting only the partitions that hold one of them.

    The kept rows are staged first, so nothing is written to files being read;
    the staged partitions then replace the old ones. A partition left without
    rows is removed.
    """
    spark = ids.sparkSession
    gone = ids.select("id").distinct()
    table = spark.read.parquet(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1)
    touched = (
        table.select("id", "source_type", folder.alias("folder"))
        .join(gone, "id", "left_semi").select("source_type", "folder").distinct().collect()
    )
    if not touched:
        return
    staged = scratch_path(spark, "delete")
    kinds = [r["source_type"] for r in touched]
    table.where(F.col("source_type").isin(kinds)).join(gone, "id", "left_anti").write.parquet(staged)
    kept = spark.read.schema(table.schema).parquet(staged)
    left = {r[0] for r in kept.select("source_type").distinct().collect()}
    if left:
        writer = _balanced(kept).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("source_type").parquet(path)
    for r in touched:
        if r["source_type"] not in left:
            _remove(spark, r["folder"])


def _remove(spark: SparkSession, folder: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def export_meta(df: DataFrame, out: str) -> None:
    """Metadata copies as JSON, without the bodies."""
    df.drop("content").write.json(out)


def code_block_rows(df: DataFrame) -> DataFrame:
    """One row per code block with its file name."""
    block = df.select("id", F.posexplode("code_blocks").alias("i", "block"))
    ext = F.when(F.coalesce("block.language", F.lit("")) == "", "txt").otherwise(F.col("block.language"))
    return block.select(
        "id",
        F.col("i").cast("long").alias("i"),
        F.concat(F.lit("block_"), F.col("i"), F.lit("."), ext).alias("file_name"),
        F.coalesce("block.code", F.lit("")).alias("code"),
    )


def export_code_blocks(df: DataFrame, out: str) -> None:
    """Code blocks as rows, one folder per language; material and file name are columns."""
    rows = code_block_rows(df).withColumn("extension", F.substring_index("file_name", ".", -1))
    rows.write.partitionBy("extension").parquet(out)


def _files(spark: SparkSession, path: str):
    """The path for Hadoop and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _is_folder(spark: SparkSession, path: str) -> bool:
    target, files = _files(spark, path)
    return files.exists(target) and files.getFileStatus(target).isDirectory()


def _has_rows(spark: SparkSession, path: str) -> bool:
    """Whether rows were ever appended; an append of none, or one that broke off, leaves a folder without a schema."""
    target, files = _files(spark, path)
    return files.exists(target) and any(not f.getPath().getName().startswith(("_", ".")) for f in files.listStatus(target))
