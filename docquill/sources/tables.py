"""Tables that a run writes: appended as Parquet in the shared folder, read back with their schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquill.scratch import shared_root


class Stored:
    """A table by its folder and schema."""

    def __init__(self, spark, path: str, schema) -> None:
        self.spark, self.path, self.schema = spark, path, schema


def append(df: DataFrame, name: str, into: Stored | None = None) -> Stored:
    """Append rows to a table, or to a new one."""
    spark = df.sparkSession
    stored = into or Stored(spark, f"{shared_root(spark)}/docquill-sinks/{name}-{uuid.uuid4().hex}", df.schema)
    df.write.mode("append").parquet(stored.path)
    return stored


def read_back(stored: Stored) -> DataFrame:
    return stored.spark.read.schema(stored.schema).parquet(stored.path)


def fresh_name(name: str) -> str:
    """A table name that no other run has."""
    return f"{name}-{uuid.uuid4().hex[:12]}"


def named_path(spark, name: str, root: str | None) -> str:
    return f"{(root or shared_root(spark)).rstrip('/')}/docquill-sinks/{name}"


def append_named(df: DataFrame, name: str, root: str | None = None) -> None:
    """Append rows to the table of that name below ``root`` (by default the shared folder), where any later job finds them."""
    df.write.mode("append").parquet(named_path(df.sparkSession, name, root))


def replace_named(df: DataFrame, name: str, root: str | None = None, by: str | None = None) -> None:
    """Write the table of that name anew, with ``by`` a folder for each value of that column; ``df`` must not read it."""
    (df.write.partitionBy(by) if by else df.write).mode("overwrite").parquet(named_path(df.sparkSession, name, root))


def read_named(spark, name: str, root: str | None = None, schema=None) -> DataFrame:
    """The table of that name; with ``schema`` also one without any row in folders."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(named_path(spark, name, root))


#: Folders that a keyed table is divided into by a hash of its key.
BUCKETS = 64


def has_named(spark, name: str, root: str | None = None) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{named_path(spark, name, root)}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def upsert_named(rows: DataFrame, name: str, keys: list[str], newest: str | None = None, root: str | None = None, buckets: int = BUCKETS) -> None:
    """Put ``rows`` into the keyed table of that name: a row with a known key replaces it, in the columns that ``rows`` has; others are added.

    The table is divided into folders by a hash of the key. Only folders with a key
    of ``rows`` are read and written again; Spark writes them aside and puts them
    in place when all is written, so that a run that fails leaves the old table.
    Of rows with one key the one with the greatest ``newest`` stays (else any). Null
    keys are equal. The first call makes the table, with the columns of ``rows``
    and this number of folders.
    """
    spark = rows.sparkSession
    path, exists = named_path(spark, name, root), has_named(spark, name, root)
    values = [c for c in rows.columns if c not in keys]
    one = F.max_by(F.struct(*values), newest) if newest else F.first(F.struct(*values))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    fresh = rows.groupBy(*keys).agg(one.alias("__new")) if values else rows.select(*keys).distinct().withColumn("__new", F.struct(F.lit(1)))
    if not exists:
        whole = fresh.select(*keys, *[F.col(f"__new.{c}").alias(c) for c in values], bucket)
    else:
        from docquill.scratch import materialize

        old = spark.read.parquet(path)
        fresh = materialize(fresh.select("*", bucket), "new-rows")
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # ``buckets`` at most
        held = old.where(F.col("bucket").isin(touched)).select("bucket", *keys, F.struct(*[c for c in old.columns if c not in ("bucket", *keys)]).alias("__old"))
        renamed = fresh.select(F.col("bucket").alias("__bucket"), *[F.col(k).alias(f"__{k}") for k in keys], "__new")
        same = F.col("bucket") == F.col("__bucket")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        found = F.col("__new").isNotNull()
        both = held.join(renamed, same, "full")
        kept = [F.when(found, F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c) if c in values else F.col(f"__old.{c}").alias(c) for c in old.columns if c not in ("bucket", *keys)]
        whole = both.select(*[F.when(found, F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in keys], *kept, F.coalesce("__bucket", "bucket").alias("bucket"))
    writer = whole.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite")
    (writer.option("partitionOverwriteMode", "dynamic") if exists else writer).parquet(path)


def read_keyed(spark, name: str, root: str | None = None) -> DataFrame:
    return read_named(spark, name, root).drop("bucket")


def with_embeddings(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """``chunks`` (chunk_id, embedding, status) with the vectors (chunk_id, vector) that were made; the others stay as they are."""
    new = vectors.select("chunk_id", "vector")
    done = F.col("vector").isNotNull()
    return chunks.join(new, "chunk_id", "left").withColumns({
        "embedding": F.coalesce("vector", "embedding"), "status": F.when(done, "completed").otherwise(F.col("status")), "model": F.when(done, model),
    }).drop("vector")


def with_failures(chunks: DataFrame, failed: DataFrame, message: str) -> DataFrame:
    """Marks the chunks of ``failed`` (chunk_id) with the error."""
    bad = failed.select("chunk_id", F.lit(True).alias("__bad")).distinct()
    return chunks.join(bad, "chunk_id", "left").withColumns({"status": F.when(F.col("__bad"), "failed").otherwise(F.col("status")), "error": F.when(F.col("__bad"), message)}).drop("__bad")


def pending(chunks: DataFrame) -> DataFrame:
    return chunks.where("embedding IS NULL")


def latest_steps(log: DataFrame) -> DataFrame:
    """An append-only step log (run_id, step, at, result): the newest result of each step."""
    return log.groupBy("run_id", "step").agg(F.max_by("result", "at").alias("result"), F.max("at").alias("at"))
