"""A bounded queue of candidate names between a fast stream and a slow worker, as keyed state.

Names arrive in event time, cut into ticks. At each tick the worker takes up to ``rate`` names, oldest first; then the tick's arrivals are put into
the queue in order of time, while it has room, and the others are dropped and told. A name is let in once while it is remembered. The
queue, the clock and the remembered names are state: a restart from the checkpoint goes on where the last batch ended, and names
whose time is over are forgotten when the watermark passes it. ``lanes`` splits names by hash over keys, each with its share of capacity and rate.

Two stateful steps: names are remembered by parts of a lane, which drop most of what cannot find room; the lane's one queue gets the rest.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTCOME_SCHEMA = "domain string, status string, tick long, taken_tick long"
TAKEN, DROPPED = "taken", "dropped"


class QueueState:
    """The queue's rules, on plain values: pending (domain, tick) in order, the last tick seen, and until when each name is remembered."""

    def __init__(self, capacity: int, rate: int, remember: int, clock: int | None = None, pending: list[tuple[str, int]] = ()):
        self.capacity, self.rate, self.remember = capacity, rate, remember
        self.clock, self.pending = clock, deque(pending)

    def advance(self, tick: int) -> Iterator[tuple[str, str, int, int]]:
        """What the worker takes up to a tick."""
        if self.clock is None:
            self.clock = tick
        for _ in range(min(len(self.pending), self.rate * max(0, tick - self.clock))):
            name, since = self.pending.popleft()
            taken, self.held = self.clock + 1 + self.held // self.rate, self.held + 1
            yield name, TAKEN, since, taken
        self.clock, self.held = max(self.clock, tick), 0

    held = 0

    def arrive(self, name: str, tick: int) -> tuple[str, str, int, None] | None:
        """Puts a name into the queue, or tells that it is dropped."""
        if len(self.pending) < self.capacity:
            self.pending.append((name, tick))
            return None
        return name, DROPPED, tick, None


#: Parts of a lane's names, each with the names it remembers, and pieces in which a part's memory is read and written.
PARTS, PIECES = 256, 32
#: The part whose rows are those of the lane's queue.
QUEUED = -1
FRESH_SCHEMA = "lane int, part int, ts timestamp, domain string, tick long"


class FreshNames(StatefulProcessor):
    """The names of one part of a lane that are not remembered, told apart into those that may find room and those that cannot.

    What a part lets through is what it has to be: a queue fed with fewer names is never fuller, so a name that finds no room in a queue
    of its part's own names, empty at the start of the batch, finds none in the lane's. A part so sends the lane ``capacity`` names and ``rate``
    more a tick at most, however many arrive.
    """

    def __init__(self, capacity: int, rate: int, remember: int, tick_seconds: int, late_ms: int):
        self.limits, self.tick_seconds, self.late_ms = (capacity, rate, remember), tick_seconds, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "piece int", "names array<string>, ticks array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lane, part = (int(k) for k in key)
        # Rows older than the newest of the batches before are late; they arrive now.
        watermark = timerValues.getCurrentWatermarkInMs()
        clock = (watermark + self.late_ms) // (1000 * self.tick_seconds) if watermark > 0 else None
        firsts = lambda frame: frame.sort_values(["ts", "domain"], kind="stable").drop_duplicates(["domain", "tick"])
        kept = []
        for frame in rows:
            frame = frame[["ts", "domain", "tick", "piece"]]
            kept.append(firsts(frame if clock is None else frame.assign(tick=frame["tick"].clip(lower=clock))))
        batch = firsts(pd.concat(kept))
        before = self.seen.exists()
        known = {piece: self.remembered(piece) if before else {} for piece in batch["piece"].unique().tolist()}
        queue, changed, routes = QueueState(*self.limits), set(), []
        for name, tick, piece in zip(batch["domain"], batch["tick"].tolist(), batch["piece"].tolist(), strict=True):
            last = known[piece].get(name)
            if last is not None and tick - last < queue.remember:
                routes.append(None)
                continue
            known[piece][name] = tick
            changed.add(piece)
            for _ in queue.advance(tick):
                pass
            routes.append(part if queue.arrive(name, tick) else QUEUED)
        for piece in changed:
            self.seen.updateValue((piece,), (list(known[piece]), list(known[piece].values())))
        if changed and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer((int(batch["tick"].iloc[-1]) + queue.remember) * self.tick_seconds * 1000)
        fresh = batch.assign(lane=lane, part=pd.Series(routes, index=batch.index, dtype="object")).dropna(subset=["part"])
        # The worker takes up to the last tick of the batch, also where it brings nothing fresh.
        end = batch.tail(1).assign(lane=lane, part=QUEUED, domain=None)
        yield pd.concat([fresh, end])[["lane", "part", "ts", "domain", "tick"]].astype({"lane": "int32", "part": "int32"})

    def remembered(self, piece: int) -> dict[str, int]:
        found = self.seen.getValue((piece,)) if self.seen.containsKey((piece,)) else None
        return dict(zip(found[0], found[1], strict=True)) if found else {}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Forgets names whose time is over, and waits for the next one's."""
        now = timerValues.getCurrentWatermarkInMs() // (1000 * self.tick_seconds)
        left, least = {}, None
        for piece, (names, ticks) in self.seen.iterator():
            stay = {n: t for n, t in zip(names, ticks, strict=True) if now - t < self.limits[2]}
            if len(stay) < len(names):
                left[piece[0]] = stay
            least = min([*stay.values(), *([] if least is None else [least])], default=None)
        for piece, stay in left.items():
            if stay:
                self.seen.updateValue((piece,), (list(stay), list(stay.values())))
            else:
                self.seen.removeKey((piece,))
        if least is not None:
            self.handle.registerTimer((least + self.limits[2]) * self.tick_seconds * 1000)
        yield pd.DataFrame({"lane": [], "part": [], "ts": [], "domain": [], "tick": []}).astype({"lane": "int32", "part": "int32", "ts": "datetime64[ns]", "domain": "object", "tick": "int64"})

    def close(self) -> None:
        pass


class NameQueue(StatefulProcessor):
    """``QueueState`` for one lane of a stream; rows of other parts are names that found no room."""

    def __init__(self, capacity: int, rate: int, remember: int):
        self.limits = (capacity, rate, remember)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "tick long")
        self.pending = handle.getListState("pending", "domain string, tick long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if int(key[1]) != QUEUED:
            for frame in rows:
                yield pd.DataFrame({"domain": frame["domain"], "status": DROPPED, "tick": frame["tick"], "taken_tick": None}).astype({"tick": "Int64", "taken_tick": "Int64"})
            return
        batch = pd.concat(list(rows)).sort_values(["ts", "domain"], kind="stable")
        clock = self.clock.get()
        state = QueueState(*self.limits, clock[0] if clock else None, [(d, t) for d, t in self.pending.get()])
        out = []
        for name, tick in zip(batch["domain"], batch["tick"].tolist(), strict=True):
            out += state.advance(tick)
            told = state.arrive(name, tick) if isinstance(name, str) else None
            if told:
                out.append(told)
        self.clock.update((state.clock,))
        if state.pending:
            self.pending.put(list(state.pending))
        else:
            self.pending.clear()
        yield pd.DataFrame(out, columns=["domain", "status", "tick", "taken_tick"]).astype({"tick": "Int64", "taken_tick": "Int64"})

    def close(self) -> None:
        pass


def tick_of(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(ts) / seconds).cast("long")


def bounded_queue(names: DataFrame, capacity: int = 10_000, rate: int = 100, remember: int = 3600, tick_seconds: int = 1, lanes: int = 1, late: str = "10 minutes", parts: int = PARTS) -> DataFrame:
    """(domain, status, tick, taken_tick) of a stream (ts, domain): names taken by the worker, and names dropped because the queue was full.

    ``remember`` counts ticks; ``late`` is the watermark's delay; ``parts`` deals the memory of a lane's names over keys. Needs the RocksDB state store,
    which ``run_queue`` sets.
    """
    if min(capacity, rate, remember, tick_seconds, lanes, parts) < 1:
        raise ValueError("all limits of a queue are at least 1")
    share = lambda n: math.ceil(n / lanes)
    limits = (share(capacity), share(rate), remember)
    late_ms = names.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp_millis(0) + CAST('{late}' AS INTERVAL))")).first()[0]
    lane, drawn = F.pmod(F.xxhash64("domain"), F.lit(lanes)).cast("int"), F.pmod(F.hash("domain"), F.lit(parts * PIECES))
    keyed = names.where("ts is not null and domain is not null").withWatermark("ts", late)
    keyed = keyed.select(lane.alias("lane"), F.floor(drawn / PIECES).cast("int").alias("part"), (drawn % PIECES).cast("int").alias("piece"), "ts", "domain", tick_of(F.col("ts"), tick_seconds).alias("tick"))
    fresh = keyed.groupBy("lane", "part").transformWithStateInPandas(FreshNames(*limits, tick_seconds, late_ms), FRESH_SCHEMA, "Append", "EventTime")
    return fresh.groupBy("lane", "part").transformWithStateInPandas(NameQueue(*limits), OUTCOME_SCHEMA, "Append", "None")


def drop_counts(outcomes: DataFrame) -> DataFrame:
    """(tick, taken, dropped) by the tick in which names arrived."""
    return outcomes.groupBy("tick").agg(F.count_if(F.col("status") == TAKEN).alias("taken"), F.count_if(F.col("status") == DROPPED).alias("dropped"))


_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_queue(outcomes: DataFrame, path: str, checkpoint: str, interval: str | None = None):
    """Starts a stream of ``bounded_queue`` into Parquet files at ``path``: all that is there, or with ``interval`` on and on."""
    conf = outcomes.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKS)
    try:
        pace = {"processingTime": interval} if interval else {"availableNow": True}
        return outcomes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**pace).start()
    finally:
        conf.set(_PROVIDER, before)


def queue_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue over names of the event table: hourly ticks, ten places, two names an hour, names remembered for the table's whole span."""
    from pagelattice.tables import new_path

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    names = source.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), "user_id", F.lit("-"), F.expr("event_id % 7"), F.lit(".test")).alias("domain"))
    folder = new_path(spark, "name_queue")
    run_queue(bounded_queue(names, capacity=10, rate=2, remember=100_000, tick_seconds=3600), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(OUTCOME_SCHEMA).parquet(f"{folder}/out")
