"""Sessions of clicks: gap islands on summaries of time cells, split by final clicks and by length.

Clicks are aggregated into client by cells as wide as the gap, with their least and largest time. Within a
cell no gap fits, and across an empty cell there always is one, so a cell begins an island if the cell before
it is empty or ends a gap before it begins: one aggregation over the cells and the cells moved on by one.
The first places of the islands are joined back to the clicks by order: both are dealt together by range of
(client, time), so the clicks of a client with a third of all rows span as many tasks as they need.

Each task runs over its rows in order and splits islands by final clicks and by length. What it can't know
is the session that is open where its rows begin. Sessions within its rows it returns whole; the rows
before its first certain start, and those of the session open at its end, it returns loose, with a map from the
session open at its begin to the one open at its end. A row a task carries the maps through (`_entries`),
then the loose rows, some sessions a task, are split likewise and summed by session. Where no
certain start lies within a task's rows, the map lists for each place where the open session may end
the session that is open at the end then; such places lie within the length of one session.

Defined results: clicks without click_id, client or time are left out; of rows with one click_id the least by
(time, client, lateness, finality, value) is taken; without a time of arrival a click is timely, without a
value it counts 0, and one that is no number is never final; clients without timely clicks have no session,
and late clicks before a client's first session join none; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, IntegerType, LongType, StringType, StructType

from ._common import durable, table

MINUTE = 60_000_000


class Rule(NamedTuple):
    """Microseconds and values that rule sessions: the gap that ends one, the length after which one ends, when a click is late or final."""

    gap: int = 30 * MINUTE
    length: int = 120 * MINUTE
    late: int = 60 * MINUTE
    final_kind: str = "purchase"
    final_value: float = 60.0


#: What a row of the ordered stream is; rows of one client and time come in this order.
ISLAND, TIMELY, LATE, CLOSER = range(4)


def micros(ts: Column, kind: str) -> Column:
    """Microseconds since 1970 of a time with or without a zone."""
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return F.unix_micros(ts)


def taken_once(clicks: DataFrame, rule: Rule) -> DataFrame:
    """(click, client, ts, late, final, cents), one row a click_id."""
    kinds = dict(clicks.dtypes)
    value = F.col("value").cast("double")
    known = clicks.where("click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL")
    ts = micros(F.col("ts"), kinds["ts"])
    late = F.coalesce(micros(F.col("arrived_at"), kinds["arrived_at"]) - ts > rule.late, F.lit(False))
    final = F.coalesce((F.col("kind") == rule.final_kind) & (value >= rule.final_value) & ~F.isnan(value), F.lit(False))
    cents = F.coalesce(F.floor(100 * value + 0.5).cast("long"), F.lit(0))
    own = known.select(F.col("click_id").alias("click"), F.struct(ts.alias("ts"), F.col("client_id").alias("client"), late.alias("late"), final.alias("final"), cents.alias("cents")).alias("own"))
    return own.repartition("click").groupBy("click").agg(F.min("own").alias("own")).select("click", "own.*")


def island_starts(timely: DataFrame, gap: int) -> DataFrame:
    """(client, ts): the first time of each island of (client, ts) rows that no gap divides."""
    cell = ((F.col("ts") - F.pmod(F.col("ts"), F.lit(gap))) / gap).cast("long")
    cells = timely.groupBy("client", cell.alias("cell")).agg(F.min("ts").alias("least"), F.max("ts").alias("most"))
    none = F.lit(None).cast("long")
    both = cells.select("client", "cell", "least", none.alias("before")).unionAll(cells.select("client", F.col("cell") + 1, none, "most"))
    met = both.groupBy("client", "cell").agg(F.max("least").alias("ts"), F.max("before").alias("before"))
    return met.where(F.col("ts").isNotNull() & (F.col("before").isNull() | (F.col("ts") - F.col("before") >= gap))).select("client", "ts")


class Session:
    """One session while its rows come in order."""

    __slots__ = ("start", "id", "end", "n", "late", "cents", "final", "rows", "path", "ids")

    def __init__(self, start: int, click) -> None:
        self.start, self.id, self.end = start, click, start
        self.n = self.late = self.cents = 0
        self.final = False
        self.path, self.ids = hashlib.sha256(), []

    def add(self, ts: int, click, final: bool, cents: int) -> None:
        self.ids.append(str(click))
        if len(self.ids) == 4096:
            self._fold()
        self.n, self.end, self.final, self.cents = self.n + 1, ts, final, self.cents + cents

    def _fold(self) -> None:
        self.path.update((("," if self.n >= len(self.ids) else "") + ",".join(self.ids)).encode())
        self.ids = []

    def digest(self) -> bytes:
        if self.ids:
            self.path.update((("," if self.n > len(self.ids) else "") + ",".join(self.ids)).encode())
            self.ids = []
        return self.path.digest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


class _Out:
    """Rows of one schema, given away in batches."""

    def __init__(self, schema: StructType) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema, self.names, self.rows = to_arrow_schema(schema), schema.names, []

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[] for _ in self.names]
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows = []
        return made


def _schema(client: DataType, click: DataType) -> StructType:
    """Rows of a task: sessions (part is null), loose rows (their session, where known), the summary of the task (place is null)."""
    s = StructType().add("part", IntegerType()).add("at", LongType()).add("client", client).add("place", IntegerType()).add("ts", LongType()).add("click", click)
    s = s.add("final", BooleanType()).add("cents", LongType()).add("start", LongType()).add("id", click).add("n", LongType()).add("late", LongType()).add("closed_by", StringType()).add("path", BinaryType())
    return s.add("last_client", client).add("ways", ArrayType(StructType().add("ts", LongType()).add("start", LongType()).add("id", click)))


class _Task:
    """The rows of one task in order; `out` gets sessions, loose rows and the task's summary."""

    def __init__(self, length: int, part: int, out: _Out) -> None:
        self.length, self.part, self.out = length, part, out
        self.at = 0
        self.client = self.first = self.open = None
        self.unknown = True  # which session is open, as no start was certain yet
        self.kept: list[tuple] = []  # rows of the open session, in case it is open at the end
        self.timely = self.ended = False
        self.chains: deque = deque()  # sessions that may be open: [start, id, ways that lead to it]
        self.ways: list[int] = []

    def _loose(self, ts, place, click, final, cents, session=None, why=None) -> tuple:
        self.at += 1
        start, own = session or (None, None)
        return (self.part, self.at, self.client, place, ts, click, final, cents, start, own, None, None, why, None, None, None)

    def _close(self, why: str) -> None:
        s = self.open
        if s is not None:
            self.out.rows.append((None, None, self.client, None, s.end, None, s.final, s.cents, s.start, s.id, s.n, s.late, "end" if s.final else why, s.digest(), None, None))
        self.open, self.kept = None, []

    def row(self, client, ts: int, place: int, click, final: bool, cents: int) -> None:
        if client != self.client:
            if self.client is None:
                self.first = client
            else:
                self._close("none")
                self.unknown = False
            self.client, self.ended = client, False
        if self.unknown and self._before_start(ts, place, click, final, cents):
            return
        if place == ISLAND:
            self._close("gap")
        elif place == LATE:
            if self.open is not None:
                self.open.late += 1
                self.kept.append((ts, place, click, final, cents))
        else:
            if self.open is not None and (self.open.final or ts - self.open.start > self.length):
                self._close("length")
            if self.open is None:
                self.open = Session(ts, click)
            self.open.add(ts, click, final, cents)
            self.kept.append((ts, place, click, final, cents))

    def _before_start(self, ts: int, place: int, click, final: bool, cents: int) -> bool:
        """Take a row whose session isn't known yet; False if it is a certain start."""
        if place == ISLAND:
            self.out.rows.append(self._loose(ts, CLOSER, None, False, 0, why="gap"))
            self.unknown = False
            return False
        if place == TIMELY:
            if self.timely and self.ended:
                self.unknown = False
                return False
            led = []
            while self.chains and ts - self.chains[0][0] > self.length:
                led += self.chains.popleft()[2]
            if not self.ways or (self.ways[-1] < ts and self.ways[-1] <= self.ways[0] + self.length):
                led.append(len(self.ways))
                self.ways.append(ts)
            if led:
                self.chains.append((ts, click, led))
            self.timely, self.ended = True, final
        self.out.rows.append(self._loose(ts, place, click, final, cents))
        return True

    def end(self) -> None:
        if self.client is None:
            return
        ways = None
        start = own = None
        ended = self.ended
        if self.unknown:
            ways = sorted((k, s, i) for s, i, led in self.chains for k in led)
            ways = [{"ts": self.ways[k], "start": s, "id": i} for k, s, i in ways]
        elif self.open is not None:
            start, own, ended = self.open.start, self.open.id, self.open.final
            self.out.rows += [self._loose(*row, session=(start, own)) for row in self.kept]
        self.out.rows.append((self.part, 0, self.first, None, None, None, ended, None, start, own, None, None, None, None, self.client, ways))


def _split(length: int, schema: StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)
        task = _Task(length, TaskContext.get().partitionId(), out)
        for batch in batches:
            for row in _rows([batch]):
                task.row(*row)
            if len(out.rows) >= 4096:
                yield out.batch()
        task.end()
        yield out.batch()

    return run


def _entries(length: int, schema: StructType):
    """Of the summaries of a client's tasks in order: the session open where each begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, client, now = _Out(schema), None, None
        for own, part, leaves, ended, start, click, ways in _rows(batches):
            if own != client:
                client, now = own, None
            if leaves:
                now = None if start is None else (start, click, ended)
                continue
            out.rows.append((part, *(now or (None, None, None))))
            if ways:
                way = next((w for w in ways if now is None or now[2] or w["ts"] - now[0] > length), None)
                now = (way["start"], way["id"], ended) if way else (*now[:2], ended)
        yield out.batch()

    return run


def _settle(length: int, schema: StructType):
    """Give the loose rows of each task their session; the first row of a task holds the session open at its begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = _Out(schema), None
        for batch in batches:
            for at, client, place, ts, click, final, cents, start, own, why in _rows([batch]):
                if at == 0:
                    now = None if start is None else (start, own, final)
                    continue
                if place == TIMELY:
                    if now is not None and not now[2] and ts - now[0] > length:
                        out.rows.append((client, *now[:2], CLOSER, ts, None, False, 0, "length"))
                        now = None
                    elif now is not None and now[2]:
                        now = None
                    now = (ts, click, final) if now is None else (*now[:2], final)
                if now is not None:
                    out.rows.append((client, *now[:2], place, ts, click, final, cents, why))
            yield out.batch()

    return run


def _sum(schema: StructType):
    """Sessions of rows that come by session, place and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, now, why = _Out(schema), None, None, None

        def close() -> None:
            if now is not None:
                out.rows.append((key[0], now.end, now.cents, now.start, now.id, now.n, now.late, "end" if now.final else why or "none", now.digest()))

        for batch in batches:
            for client, start, own, place, ts, click, final, cents, reason in _rows([batch]):
                if (client, start, own) != key:
                    close()
                    key, now, why = (client, start, own), Session(start, own), None
                if place == TIMELY:
                    now.add(ts, click, final, cents)
                elif place == LATE:
                    now.late += 1
                else:
                    why = reason
            yield out.batch()
        close()
        yield out.batch()

    return run


def sessions(clicks: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """client_id, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by, path_sha256 of every session of clicks
    (click_id, ts, arrived_at, client_id, kind, value)."""
    once = durable(taken_once(clicks, rule), "clicks")
    starts = island_starts(once.where("NOT late").select("client", "ts"), rule.gap)
    place = F.when(F.col("late"), LATE).otherwise(TIMELY)
    kinds = {f.name: f.dataType for f in once.schema.fields}
    rows = once.select("client", "ts", place.alias("place"), "click", "final", "cents")
    rows = rows.unionAll(starts.select("client", "ts", F.lit(ISLAND), F.lit(None).cast(kinds["click"]), F.lit(False), F.lit(0).cast("long")))
    order = ["client", "ts", "place", "click"]
    schema = _schema(kinds["client"], kinds["click"])
    split = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_split(rule.length, schema), schema), "split")

    told = split.where("part IS NOT NULL AND place IS NULL")
    come = told.select("client", "part", F.lit(False).alias("leaves"), "final", F.lit(None).cast("long").alias("start"), F.lit(None).cast(kinds["click"]).alias("id"), "ways")
    leave = told.where("ways IS NULL").select(F.col("last_client").alias("client"), "part", F.lit(True), "final", "start", "id", "ways")
    entry = StructType().add("part", IntegerType()).add("start", LongType()).add("id", kinds["click"]).add("ended", BooleanType())
    maps = come.unionAll(leave).repartition("client").sortWithinPartitions("client", "part", "leaves")
    entries = maps.mapInArrow(_entries(rule.length, entry), entry)

    loose = split.where("part IS NOT NULL AND place IS NOT NULL")
    key = ["client", "start", "id"]
    row = ["place", "ts", "click", "final", "cents", F.col("closed_by").alias("why")]
    unknown = loose.where("start IS NULL").select("part", "at", "client", *row[:5], "start", "id", "closed_by")
    none = {c: F.lit(None).cast(schema[c].dataType).alias(c) for c in ("client", "place", "ts", "click", "cents", "closed_by")}
    begins = entries.select("part", F.lit(0).cast("long").alias("at"), none["client"], none["place"], none["ts"], none["click"], F.col("ended").alias("final"), none["cents"], "start", "id", none["closed_by"])
    settled = StructType([schema[c] for c in (*key, "place", "ts", "click", "final", "cents")]).add("why", StringType())
    dealt = unknown.unionAll(begins).repartition("part").sortWithinPartitions("part", "at").drop("part")
    known = dealt.mapInArrow(_settle(rule.length, settled), settled).unionAll(loose.where("start IS NOT NULL").select(*key, *row))
    summed = StructType([schema[c] for c in ("client", "ts", "cents", "start", "id", "n", "late", "closed_by", "path")])
    across = known.repartition(*key).sortWithinPartitions(*key, "place", "ts", "click").mapInArrow(_sum(summed), summed)
    out = split.where("part IS NULL").select(*summed.names).unionAll(across)
    named = {"client_id": "client", "session_id": "id", "start_us": "start", "end_us": "ts", "n_clicks": "n", "n_late": "late", "value_cents": "cents", "closed_by": "closed_by"}
    return out.select(*[F.col(c).alias(n) for n, c in named.items()], F.lower(F.hex("path")).alias("path_sha256"))


def op12_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "clicks"))


_R = Rule()
OP12_SQL = f"""
WITH RECURSIVE once AS (
  SELECT click_id, client_id, epoch_us(ts) AS t, coalesce(epoch_us(arrived_at) - epoch_us(ts) > {_R.late}, false) AS late,
    coalesce(kind = '{_R.final_kind}' AND value >= {_R.final_value}, false) AS final, coalesce(floor(100 * value + 0.5)::BIGINT, 0) AS cents,
    row_number() OVER (PARTITION BY click_id ORDER BY ts, client_id, arrived_at, kind, value) AS copy
  FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL),
timely AS (
  SELECT *, row_number() OVER w AS r, lag(final) OVER w AS was_final, lag(t) OVER w AS was
  FROM once WHERE copy = 1 AND NOT late WINDOW w AS (PARTITION BY client_id ORDER BY t, click_id)),
parts AS (
  SELECT *, sum(CASE WHEN was IS NULL OR was_final OR t - was >= {_R.gap} THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY r) AS part FROM timely),
starts AS (
  SELECT client_id, part, min(r) AS r, min(t) AS t FROM parts GROUP BY client_id, part
  UNION ALL
  SELECT p.client_id, p.part, min(p.r) AS r, min(p.t) AS t FROM starts s JOIN parts p ON p.client_id = s.client_id AND p.part = s.part AND p.t > s.t + {_R.length}
  GROUP BY p.client_id, p.part),
numbered AS (
  SELECT p.*, sum(CASE WHEN s.r IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.client_id ORDER BY p.r) AS s
  FROM parts p LEFT JOIN starts s ON s.client_id = p.client_id AND s.r = p.r),
summed AS (
  SELECT client_id, s, arg_min(click_id, r) AS session_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n_clicks, sum(cents)::BIGINT AS value_cents,
    arg_max(final, r) AS final, sha256(string_agg(click_id::VARCHAR, ',' ORDER BY t, click_id)) AS path_sha256
  FROM numbered GROUP BY client_id, s),
followed AS (SELECT *, lead(start_us) OVER (PARTITION BY client_id ORDER BY s) AS next_us FROM summed),
delayed AS (
  SELECT f.client_id, f.s, count(*) AS n FROM followed f JOIN once o ON o.client_id = f.client_id AND o.copy = 1 AND o.late AND o.t >= f.start_us AND (f.next_us IS NULL OR o.t < f.next_us)
  GROUP BY f.client_id, f.s)
SELECT f.client_id, session_id, start_us, end_us, n_clicks, coalesce(d.n, 0) AS n_late, value_cents,
  CASE WHEN final THEN 'end' WHEN next_us IS NULL THEN 'none' WHEN next_us - end_us >= {_R.gap} THEN 'gap' ELSE 'length' END AS closed_by, path_sha256
FROM followed f LEFT JOIN delayed d ON d.client_id = f.client_id AND d.s = f.s
"""
