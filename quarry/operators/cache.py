"""Bounded caches whose entries age: one as an object, and a log of requests replayed through many of them."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Hashable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Entries of the caches of answers and of rewritten questions, and the seconds that an entry lives.
ANSWERS, REWRITES, SECONDS = 256, 512, 3600.0


class AgingCache:
    """At most `size` entries; each lives `seconds` from when it was put, and the least recently used one makes room.

    `entries` lie in order of use, oldest first. An entry that is put again lives anew; a look-up counts as use but
    lengthens no life. Times may not go back.
    """

    def __init__(self, size: int, seconds: float = SECONDS):
        if size < 1:
            raise ValueError("a cache holds one entry at least")
        self.size, self.seconds = size, seconds
        self.entries: OrderedDict[Hashable, tuple[Any, float]] = OrderedDict()
        self._born: OrderedDict[Hashable, float] = OrderedDict()  # in order of end

    def restore(self, entries: Sequence[tuple[Hashable, Any, float]]) -> AgingCache:
        """Take (key, value, end) in order of use, as they were left."""
        self.entries = OrderedDict((k, (v, end)) for k, v, end in entries)
        self._born = OrderedDict(sorted(((k, end) for k, _, end in entries), key=lambda x: x[1]))
        return self

    def _expire(self, now: float) -> None:
        while self._born:
            key, end = next(iter(self._born.items()))
            if end > now:
                return
            del self._born[key], self.entries[key]

    def get(self, key: Hashable, now: float, default: Any = None) -> Any:
        self._expire(now)
        if key not in self.entries:
            return default
        self.entries.move_to_end(key)
        return self.entries[key][0]

    def put(self, key: Hashable, value: Any, now: float) -> Hashable | None:
        """The key that had to go for it, if one had."""
        self._expire(now)
        gone = None
        if key not in self.entries and len(self.entries) == self.size:
            gone, _ = self.entries.popitem(last=False)
            del self._born[gone]
        for order, entry in ((self.entries, (value, now + self.seconds)), (self._born, now + self.seconds)):
            order[key] = entry
            order.move_to_end(key)
        return gone


def _ask(cache: AgingCache, keys: Sequence[str], times: Sequence[float]) -> tuple[list[bool], list[str | None]]:
    """For each request whether it is answered, and the key that its answer drives out if it is not."""
    hits, gone = [], []
    for key, t in zip(keys, times, strict=True):
        hits.append(cache.get(key, t, False))
        gone.append(None if hits[-1] else cache.put(key, True, t))
    return hits, gone


def replay(requests: DataFrame, *, size: int = ANSWERS, seconds: float = SECONDS, shard: str = "shard") -> DataFrame:
    """(request_id, shard, hit, evicted) of requests (request_id, shard, key, ts), each shard a cache of its own.

    A shard's requests go in order of ts and request_id. A pause as long as an entry's life empties a cache, so what
    lies between pauses is replayed apart: pauses come from a summary of each shard's slots of that length, not
    from its rows. A task reads sorted rows as they come and holds one cache of at most `size` keys. Without a pause
    a shard is one run of requests, as its one cache is. Requests without a time are left out; null keys and shards
    are values like others; requests of one id and time keep no order among themselves.
    """
    rows = requests.select("request_id", shard, "key", F.col("ts").cast("timestamp").cast("double").alias("t")).filter("t is not null")
    rows = rows.withColumn("slot", F.floor(F.col("t") / seconds))
    slots = rows.groupBy(shard, "slot").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    w = Window.partitionBy(shard).orderBy("slot")
    starts = F.coalesce(F.col("first") - F.lag("last").over(w) >= seconds, F.lit(False)).cast("int")
    runs = slots.withColumn("starts", starts).select(F.col(shard).alias("_shard"), F.col("slot").alias("_slot"), F.sum("starts").over(w).alias("run"))
    cut = rows.join(runs, F.col(shard).eqNullSafe(F.col("_shard")) & (F.col("slot") == F.col("_slot"))).select("request_id", shard, "key", "t", "run")
    ordered = cut.repartition(shard, "run").sortWithinPartitions(shard, "run", "t", "request_id")
    kind = {f.name: f.dataType.simpleString() for f in requests.schema}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, cache = None, AgingCache(size, seconds)
        for part in parts:
            shards = part[shard].astype(object).where(part[shard].notna(), None)
            names = list(zip(shards, part["run"], strict=True))
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            hits, gone = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and names[a] != current:
                    current, cache = names[a], AgingCache(size, seconds)
                h, g = _ask(cache, part["key"].tolist()[a:b], part["t"].tolist()[a:b])
                hits, gone = hits + h, gone + g
            yield part[["request_id", shard]].assign(hit=hits, evicted=pd.Series(gone, index=part.index, dtype=object))

    return ordered.mapInPandas(run, f"request_id {kind['request_id']}, {shard} {kind[shard]}, hit boolean, evicted string")


def replay_stream(requests: DataFrame, *, size: int = ANSWERS, seconds: float = SECONDS, late: str = "10 minutes") -> DataFrame:
    """The same over a stream of (request_id long, shard long, key string, ts), as requests come; those later than `late` are dropped.

    A shard's state is its cache. It goes when the watermark has passed the end of its last entry.
    """

    def one(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        cache = AgingCache(size, seconds)
        if state.exists:
            keys, ends = state.get
            cache.restore([(k, True, end) for k, end in zip(keys, ends, strict=True)])
        rows = pd.concat(list(parts)).sort_values(["t", "request_id"])
        hits, gone = _ask(cache, rows["key"].tolist(), rows["t"].tolist())
        state.update((list(cache.entries), [end for _, end in cache.entries.values()]))
        last = max((end for _, end in cache.entries.values()), default=0.0)
        state.setTimeoutTimestamp(max(int(1000 * last), state.getCurrentWatermarkMs()) + 1)
        yield rows[["request_id", "shard"]].assign(hit=hits, evicted=pd.Series(gone, index=rows.index, dtype=object))

    ts = F.col("ts").cast("timestamp")
    # a watermark starts at the epoch and what lies on it is late, hence the millisecond
    times = requests.select("request_id", "shard", "key", ts.cast("double").alias("t"), (ts + F.expr("INTERVAL 1 MILLISECOND")).alias("seen")).withWatermark("seen", late)
    return times.groupBy("shard").applyInPandasWithState(one, "request_id long, shard long, hit boolean, evicted string", "keys array<string>, ends array<double>", "append", GroupStateTimeout.EventTimeTimeout)
