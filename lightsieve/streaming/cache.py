"""A cache of recently processed items as keyed stream state with a bound, a lifetime, and eviction of the least recent.

Each category has its own cache. It is dealt over shards by item, so that a category with a large share of the events
is many keys, and each shard forgets its own least recent items. What a key holds is bounded by its share of the
cache, whatever the stream brings; Spark keeps it in RocksDB and a run with the same checkpoint goes on with it.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lightsieve.session import settings, shared_path

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
STATE_SCHEMA = "items array<string>, last array<bigint>"


def touch(recent: OrderedDict[str, int], item: str, at: int, most: int, lifetime: int | None) -> tuple[bool, str | None]:
    """(whether the item was still held, the item that it pushed out). recent: item to time of last use, oldest use first."""
    last = recent.pop(item, None)
    recent[item] = at
    gone = recent.popitem(last=False)[0] if len(recent) > most else None
    return last is not None and (lifetime is None or at - last <= lifetime), gone


class RecentItems(StatefulProcessor):
    """State of one shard of a category: its most recent items, no more than ``most``."""

    def __init__(self, most: int, lifetime: int | None):
        self.most, self.lifetime = most, lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("recent", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        recent = OrderedDict(zip(held[0], held[1])) if held else OrderedDict()
        batch = pd.concat(rows).sort_values("ord", kind="stable")  # of this shard in this micro-batch
        found = [touch(recent, item, at, self.most, self.lifetime) for item, at in zip(batch["item"], batch["at"])]
        self.state.update((list(recent), [int(t) for t in recent.values()]))
        yield pd.DataFrame({"category": key[0], "ord": batch["ord"].to_numpy(), "item": batch["item"].to_numpy(), "seen": [seen for seen, _ in found], "evicted": [gone for _, gone in found]})

    def close(self) -> None:
        pass


def recently_seen(events: DataFrame, most: int = 1000, shards: int = 8, lifetime: int | None = None, shard: Column | None = None) -> DataFrame:
    """(category, ord, item, seen, evicted): whether an item was processed before and is still remembered.

    events: stream of (category, ord, item, at), at in any whole unit of event time. A category remembers ``most``
    items, an equal part in each shard, which forgets its least recently used item when one more comes, and no item for
    longer than ``lifetime`` after its last use. ``evicted`` is the item that was forgotten for lack of room. Rows of
    a micro-batch are taken by ord, the micro-batches as they come. A null item is an item of its own; a null category
    too. Lifetimes are of event time, so a run that is repeated gives the same rows.
    """
    if most < shards:
        raise ValueError("a cache has room for one item a shard at least")
    rows = events.select("category", "ord", F.coalesce(F.col("item").cast("string"), F.lit("\0")).alias("item"), F.col("at").cast("long").alias("at"), (F.pmod(F.xxhash64("item"), F.lit(shards)) if shard is None else shard).cast("int").alias("shard"))
    kinds = dict(rows.dtypes)
    processor = RecentItems(most // shards, lifetime)
    out = f"category {kinds['category']}, ord {kinds['ord']}, item string, seen boolean, evicted string"
    found = rows.groupBy("category", "shard").transformWithStateInPandas(processor, out, "Append", "None")
    return found.select("category", "ord", F.nullif("item", F.lit("\0")).alias("item"), "seen", F.nullif("evicted", F.lit("\0")).alias("evicted"))


def run_cached(events: DataFrame, out: str, checkpoint: str, **options) -> None:
    """Processes what is new in a stream into a Parquet table; the cache of the checkpoint goes on where it was."""
    with settings(events.sparkSession, ROCKSDB):
        found = recently_seen(events, **options)
        found.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()


def replay(events: DataFrame, runs: int, **options) -> DataFrame:
    """recently_seen over a finite table in as many runs, each of a range of ord, each started anew from the checkpoint.

    Ranges are of equal width between the least and the greatest ord. An empty table gives no rows.
    """
    spark = events.sparkSession
    source, out, checkpoint = (shared_path(spark, label) for label in ("cache-events", "cache-out", "cache-state"))
    least, most = events.agg(F.min("ord"), F.max("ord")).first()
    events.limit(0).write.parquet(source)
    for k in range(runs if least is not None else 0):
        low, high = least + (most + 1 - least) * k // runs, least + (most + 1 - least) * (k + 1) // runs
        events.filter((F.col("ord") >= low) & (F.col("ord") < high)).write.mode("append").parquet(source)
        run_cached(spark.readStream.schema(events.schema).parquet(source), out, checkpoint, **options)
    schema = f"category {dict(events.dtypes)['category']}, ord {dict(events.dtypes)['ord']}, item string, seen boolean, evicted string"
    return spark.read.schema(schema).parquet(out) if least is not None else spark.createDataFrame([], schema)
