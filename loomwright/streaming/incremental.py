"""Resumable one-pass forms over streams of files: deduplication and running top-k. Each batch's state is written under
its number, so a batch that is repeated after a failure gives the same state; progress lives in the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import dedup, rank

#: Side -> score column, and whether the least comes first.
SIDES = rank.SIDES


def _run(stream: DataFrame, step, checkpoint: str) -> None:
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _before(spark: SparkSession, state: str, batch_id: int, schema) -> DataFrame:
    """What earlier batches have written (a repeated batch doesn't see its own earlier try)."""
    rows = spark.read.schema(schema).option("basePath", state).parquet(*[f"{state}/batch={b}" for b in range(batch_id)]) if batch_id else spark.createDataFrame([], schema)
    return rows.drop("batch")


def dedup_ordered(stream: DataFrame, key: str, order: list[str], state: str, checkpoint: str) -> DataFrame:
    """Process what has arrived and return each key's first row in order, whatever batch it came with."""
    schema = stream.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        known = _before(batch.sparkSession, state, batch_id, schema).groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(*order)).alias("_at"))
        firsts = dedup.keep_first(batch, key, order)
        new = firsts.join(known, firsts[key] == known["_k"], "left").where(F.col("_at").isNull() | (F.struct(*order) < F.col("_at")))
        new.select(*[firsts[c] for c in schema.names]).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    _run(stream, merge, checkpoint)
    rows = stream.sparkSession.read.schema(schema).parquet(state)
    return dedup.keep_first(rows.select(*schema.names), key, order)


def top_k_sides(stream: DataFrame, k: int, group: str, state: str, checkpoint: str) -> DataFrame:
    """Process what has arrived and return each group's first k rows under each side: rows (side, group, train_idx, v, rank).

    A batch is cut to its own first rows before it meets those of the batches before.
    """

    def firsts(rows: DataFrame) -> DataFrame:
        out = None
        for side, (_, ascending) in SIDES.items():
            own = rows.where(F.col("side") == side)
            w = rank.Window.partitionBy(group).orderBy(F.asc("v") if ascending else F.desc("v"), "train_idx")
            own = own.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)
            out = own if out is None else out.unionByName(own)
        return out

    schema = f"side string, `{group}` {stream.schema[group].dataType.simpleString()}, train_idx {stream.schema['train_idx'].dataType.simpleString()}, v double, rank int"

    def merge(batch: DataFrame, batch_id: int) -> None:
        sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).cast("double").alias("v")) for s, (c, _) in SIDES.items()])).alias("s")
        rows = firsts(batch.select(group, "train_idx", sides).select("s.side", group, "train_idx", "s.v"))
        if batch_id:
            last = batch.sparkSession.read.schema(schema).parquet(f"{state}/batch={batch_id - 1}")
            rows = firsts(rows.unionByName(last).drop("rank"))
        rows.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
        done.append(batch_id)

    done: list[int] = []
    _run(stream, merge, checkpoint)
    spark = stream.sparkSession
    last = max(done) if done else _last(spark, state)
    return spark.read.schema(schema).parquet(f"{state}/batch={last}") if last is not None else spark.createDataFrame([], schema)


def _last(spark: SparkSession, state: str) -> int | None:
    """The number of the last batch whose state was written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(state)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(f.getPath().getName()[6:]) for f in files.listStatus(at) if f.getPath().getName().startswith("batch=")] if files.exists(at) else []
    return max(found, default=None)
