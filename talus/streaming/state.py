"""Keyed state with timers: acceptance once per time to live, and state machines over ordered actions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talus.runtime import SHUFFLE, partitions_for
from talus.streaming.pipelines import TRANSITIONS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession, rows: int = 0) -> Iterator[None]:
    """Streams started here keep their state in RocksDB, which state with timers needs.

    Their state is dealt into as many partitions as `rows` rows need (a checkpoint keeps the number that it began with).
    """
    before = {c: spark.conf.get(c) for c in (PROVIDER, SHUFFLE)}
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(SHUFFLE, partitions_for(spark, rows))
    try:
        yield
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


class OnceInTtl(StatefulProcessor):
    """Passes on a key's first row and then none until ttl_ms after it.

    Rows wait until the watermark has passed them and are then taken in the order of (ts, order),
    so the result doesn't depend on how they were dealt to batches. State of a key goes when its
    time to live has run out and no row waits.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, ord long")
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        """A key's rows of a batch go into the state at once, with one timer for the earliest."""
        new = [(int(row.ts), int(row.ord)) for row in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        # all that the watermark has passed is there: rows as early that come later are dropped as late
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = sorted((r[0], r[1]) for r in self.waiting.get())
        until = self.until.get()[0] if self.until.exists() else None
        out = []
        for at, order in (h for h in held if h[0] <= now):
            if until is None or at >= until:
                until = at + self.ttl_ms
                out.append(Row(key=key[0], ord=order, accepted=at))
        left = [h for h in held if h[0] > now]
        if len(left) < len(held):
            self.waiting.clear()
            if left:
                self.waiting.put(left)
        if left:
            self.handle.registerTimer(left[0][0])
        if out:
            self.until.update((until,))
            self.handle.registerTimer(until)
        elif until is not None and now >= until and not left:
            self.until.clear()
        return iter(out)


def once_in_ttl(stream: DataFrame, key: str, ts: str, order: str, ttl_seconds: int, delay: str = "1 day") -> DataFrame:
    """(key, ord, accepted): of each key the first row by (ts, order), then the first one at least
    ttl_seconds after the last accepted, and so on. accepted is the row's time in milliseconds.

    Rows later than `delay` behind the newest, and any before 1970, are dropped, and rows come out
    once the watermark has passed them; null keys and times are left out. Start the query inside keyed_state().
    """
    rows = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("at"), F.col(order).cast("long").alias("ord"))
    rows = rows.withWatermark("at", delay).withColumn("ts", F.unix_millis("at"))
    return rows.groupBy("key").transformWithState(statefulProcessor=OnceInTtl(ttl_seconds * 1000), outputStructType="key long, ord long, accepted long", outputMode="Append", timeMode="EventTime")


class Machine(StatefulProcessor):
    """States of a key's actions, in the order of seq = 1, 2, ...: an action waits until those before it have come.

    A seq that was taken already (a repeated delivery) is left out. What waits lies in the state by
    blocks of `block` numbers, the one of the next action together with the key's state, so a batch
    reads and writes a key's blocks and not its single actions. A task holds `held` waiting actions
    of a key at most, and one block. Each row that comes out has a stretch of actions, `block` at
    most, from seq `first` on.
    """

    def __init__(self, transitions: dict[tuple[str, str], str], start: str, ref_type: str = "bigint", block: int = 1024, held: int = 65_536):
        self.transitions, self.start, self.ref_type, self.block, self.held = transitions, start, ref_type, block, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        block = f"seq array<bigint>, action array<string>, ref array<{self.ref_type}>"
        self.now = handle.getValueState("now", f"state string, next long, {block}")
        self.waiting = handle.getMapState("waiting", "block long", block)

    @staticmethod
    def _packed(there: dict[int, tuple]) -> tuple[list, list, list]:
        return list(there), [a for a, _ in there.values()], [r for _, r in there.values()]

    @staticmethod
    def _unpacked(seqs: list, actions: list, refs: list) -> dict[int, tuple]:
        """seq -> (action, ref)."""
        return dict(zip(seqs, zip(actions, refs)))

    def _later(self, number: int) -> dict[int, tuple]:
        """What waits in a block that isn't yet the next action's."""
        return self._unpacked(*self.waiting.getValue((number,))) if self.waiting.containsKey((number,)) else {}

    def _put(self, held: dict[int, dict[int, tuple]]) -> None:
        for number, new in held.items():
            self.waiting.updateValue((number,), self._packed(self._later(number) | new))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state, due, *block = self.now.get() if self.now.exists() else (self.start, 1, [], [], [])
        number, there = due // self.block, self._unpacked(*block)
        held: dict[int, dict[int, tuple]] = {}
        n = 0
        for row in rows:
            at = row.seq // self.block
            if at == number and row.seq >= due:
                there[row.seq] = (row.action, row.ref)
            elif at > number:
                held.setdefault(at, {})[row.seq] = (row.action, row.ref)
                n += 1
                if n == self.held:
                    self._put(held)
                    held, n = {}, 0
        while True:
            first, out = due, []
            while due in there:
                action, ref = there.pop(due)
                after = self.transitions.get((state, action))
                state, due = after or state, due + 1
                out.append((action, state, 200 if after else 409, ref))
            if out:
                actions, states, codes, refs = map(list, zip(*out))
                yield Row(key=key[0], first=first, action=actions, state=states, code=codes, ref=refs)
            if due // self.block == number:
                break
            number = due // self.block
            there = self._later(number) | held.pop(number, {})
            self.waiting.removeKey((number,))
        self._put(held)
        self.now.update((state, due, *self._packed(there)))


def machine_states(actions: DataFrame, key: str = "incident_id", seq: str = "seq", action: str = "action", transitions: dict[tuple[str, str], str] = TRANSITIONS, start: str = "OPEN", ref: str | None = None) -> DataFrame:
    """(key, seq, action, state, code): the state after each action, and 409 where it wasn't allowed.

    seq counts a key's actions from 1; they may come in any order over any batches, and an action
    after a gap waits in the state. ref names a column of a plain type that goes along with its
    action and comes last in the result. Start the query inside keyed_state().
    """
    kind = actions.schema[ref].dataType.simpleString() if ref else "bigint"
    rows = actions.where(F.col(key).isNotNull() & F.col(seq).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(action).alias("action"), (F.col(ref) if ref else F.lit(None).cast(kind)).alias("ref"))
    out = rows.groupBy("key").transformWithState(statefulProcessor=Machine(transitions, start, kind), outputStructType=f"key long, first long, action array<string>, state array<string>, code array<int>, ref array<{kind}>", outputMode="Append", timeMode="None")
    out = out.select("key", "first", F.posexplode(F.arrays_zip("action", "state", "code", "ref")).alias("at", "one"))
    out = out.select(F.col("key").alias(key), (F.col("first") + F.col("at")).alias("seq"), "one.action", "one.state", "one.code", *([F.col("one.ref").alias(ref)] if ref else []))
    return out
