"""Update events from a stream, applied to a stored corpus batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.updates import EVENT_SCHEMA
from ..store import CorpusStore


def follow(events: DataFrame, store: CorpusStore, corpus: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a query over a stream of events with the columns of ``EVENT_SCHEMA``.

    Within a batch ``nr`` orders the events; batches follow each other. An
    update has the same outcome if it is applied again, so a batch that is
    repeated after a failure does no harm.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            store.apply_updates(corpus, batch.select(*[c.split()[0] for c in EVENT_SCHEMA.split(", ")]))

    writer = events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def label_counts(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Added labels by key and time window, for events that carry a time; late ones count within ``late``."""
    added = events.filter(F.col("kind") == "add_node_label").withWatermark(ts, late)
    return added.groupBy(F.window(ts, every).alias("window"), "ns", "name").agg(F.count(F.lit(1)).alias("n"))
