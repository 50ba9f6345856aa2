"""The change feed on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Event kinds and reasons to read anew.
KINDS = {"VertexCreated": 1, "VertexRemoved": 2, "EdgeCreated": 4, "EdgeRemoved": 8, "PropertySet": 16, "PropertyRemoved": 32, "Resync": 64}
REASONS = ("trim", "tabulaRasa", "load", "delegateWrite", "overflow", "seekOutOfRange")
#: Sequence numbers that one task looks at together.
GAP_RUN = 100_000
SCHEMA = "epoch string, seq long, ts timestamp, kind string, element string, id long, label string, edge_type string, key string, value string"


def passes(kinds: list[str] | None = None, elements: list[str] | None = None, labels: list[str] | None = None, keys: list[str] | None = None) -> Column:
    """Any of the values in each list that is given; Resync passes always, and a
    null label or key never matches."""
    test = F.lit(True)
    for column, wanted in (("kind", kinds), ("element", elements), ("label", labels), ("key", keys)):
        if wanted:
            test = test & F.coalesce(F.col(column).isin(wanted), F.lit(False))
    return (F.col("kind") == "Resync") | test


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """An append-only folder of Parquet event files as a stream."""
    reader = spark.readStream.schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def since(events: DataFrame, seq: int) -> DataFrame:
    return events.where(F.col("seq") > seq)


def gaps(events: DataFrame) -> DataFrame:
    """(epoch, expected, found): where sequence numbers are missing, so a reader
    has to read anew (batch; numbers start at 1 in each epoch)."""
    from pyspark.sql.window import Window

    # Runs of numbers are looked at on their own; only their ends meet, one row a run.
    run = F.floor(F.col("seq") / GAP_RUN)
    inside = F.lag("seq").over(Window.partitionBy("epoch", "run").orderBy("seq"))
    rows = events.select("epoch", "seq", run.alias("run")).withColumn("before", inside)
    ends = events.groupBy("epoch", run.alias("run")).agg(F.max("seq").alias("last"))
    prior = F.coalesce(F.lag("last").over(Window.partitionBy("epoch").orderBy("run")), F.lit(0))
    firsts = ends.withColumn("prior", prior).select("epoch", "run", "prior")
    told = rows.join(firsts, ["epoch", "run"]).withColumn("expected", F.coalesce("before", "prior") + 1)
    return told.select("epoch", "expected", F.col("seq").alias("found")).where("found > expected")


def last_values(events: DataFrame) -> DataFrame:
    """Batch: the last value per (id, key), without removed ones."""
    last = events.where("kind in ('PropertySet', 'PropertyRemoved')").groupBy("id", "key").agg(F.max(F.struct("seq", "kind", "value")).alias("m"))
    return last.where("m.kind = 'PropertySet'").select("id", "key", F.col("m.value").alias("value"), F.col("m.seq").alias("seq"))


def materialise(stream: DataFrame) -> DataFrame:
    """Stream: the last value per (id, key) as an update stream (id, key, value,
    seq, removed). State is one row per key, kept by Spark's own aggregation; late
    and repeated events change nothing, a key they name may be told once more."""
    changes = stream.where("kind in ('PropertySet', 'PropertyRemoved')")
    removed = F.col("kind") == "PropertyRemoved"
    last = F.max(F.struct("seq", removed.alias("removed"), F.when(~removed, F.col("value")).alias("value"))).alias("m")
    return changes.groupBy("id", "key").agg(last).select("id", "key", "m.value", "m.seq", "m.removed")


def run_now(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is and stop; the checkpoint continues from there."""
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path)
    else:
        query = stream.writeStream.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}"))
    query.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type and window, with a watermark for late events."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "2 hours", step: str = "1 hour") -> DataFrame:
    w = events.groupBy(F.window("ts", length, step), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n): runs of events closer than the gap."""
    w = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("ts").alias("session_end"))
    return w.select("user_id", F.col("session_window.start").alias("session_start"), "session_end", "n")
