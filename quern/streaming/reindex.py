"""Continuous re-indexing: a stream of file states goes through the index in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions.embedder import Embedder
from quern.operators.incremental import StateStore, latest_by
from quern.plans.index import Index
from quern.session import released

EVENTS = "path string, relative_path string, language string, text string, saved_at timestamp"


def saved_files(spark: SparkSession, inbox: str) -> DataFrame:
    """A stream of saved files, one JSON object per save, as files arrive in ``inbox``."""
    return spark.readStream.schema(EVENTS).json(inbox)


def reindex(stream: DataFrame, index: Index, checkpoint: str, embedder: Embedder | None = None, once: bool = False) -> StreamingQuery:
    """Index every micro-batch. The latest save of a path counts, in whatever batch it comes.

    The times of the saves that were indexed are kept beside the index, so an older save that is late is left out.
    A batch that is delivered again after a failure changes nothing, as its hashes are known by then.
    """
    saves = StateStore(index.spark, f"{index.root}/saves", "path", "__q_saved")

    def step(batch: DataFrame, _: int) -> None:
        with released():
            saved = F.coalesce(F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))
            last = latest_by(batch, "path", "saved_at").withColumn("__q_saved", saved)
            known = saves.load()
            if known is not None:
                known = known.select(F.col("path").alias("__q_path"), F.col("__q_saved").alias("__q_known"))
                last = last.join(known, F.col("path").eqNullSafe(F.col("__q_path")), "left").where("__q_known IS NULL OR __q_saved > __q_known").drop("__q_path", "__q_known")
            run = saves.pending(last)
            scanned = run.rows.select("path", "relative_path", "language", "text", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"))
            index.run(scanned, embedder)
            saves.commit(run)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
