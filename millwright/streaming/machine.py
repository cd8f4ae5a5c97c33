"""The machine stream: raw packets to every table, with each machine's state in Spark's state store.

Packets are parsed and placed by row-local expressions. A state operator keyed by machine then does the one thing
that needs order: it decides what becomes of each packet and hands it on with what the machine was like before it. All
that follows from this (hours, gaps, alarms, telemetry, meter rows) is again row-local and shared with the batch
operators. The streaming checkpoint is the commit: a micro-batch that is repeated starts from the same state, and every
table keeps it under its batch number, so writing it again replaces it.
"""

from __future__ import annotations

import os
from collections import deque, namedtuple
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millwright.functions import meter
from millwright.functions.payload import canonical, object_of, staged
from millwright.operators import admission, alarms, production
from millwright.operators.registry import active_machines
from millwright.operators.telemetry import telemetry_rows
from millwright.params import DEFAULTS, Params
from millwright.streaming.ordered import in_order, sorted_streams

ALARMS = "ARRAY<STRUCT<alarm_key: STRING, severity: STRING>>"
SINCE = "ARRAY<STRUCT<alarm_key: STRING, severity: STRING, started_seq: BIGINT, started_at: BIGINT>>"
# a machine between two packets
STATE = ("snap_at BIGINT, snap_print STRING, status STRING, mode STRING, baseline BIGINT, meter DOUBLE, meter_at BIGINT, "
         f"meter_seen_at BIGINT, meter_print STRING, alone_at BIGINT, alarms {SINCE}, last_seq BIGINT, recv_ms BIGINT")
FIELDS = [part.split()[0] for part in STATE.replace(SINCE, "X").split(", ")]
# a packet with its outcome and what the machine was like before it
STEP = ("machine_id BIGINT, seq BIGINT, company_id BIGINT, obs_at BIGINT, recv_ms BIGINT, standalone BOOLEAN, outcome STRING, machine_status STRING, "
        "mode STRING, parts_count BIGINT, energy DOUBLE, payload STRING, prev_at BIGINT, prev_status STRING, prev_mode STRING, "
        f"baseline_before BIGINT, meter_before DOUBLE, meter_before_at BIGINT, alarms {SINCE}, alarms_before {SINCE}")
STEP_FIELDS = [part.split()[0] for part in STEP.replace(SINCE, "X").split(", ")]
SINCE_FIELDS = ("alarm_key", "severity", "started_seq", "started_at")
TOGETHER = 64  # steps of one machine that leave in a list
TABLES = ("steps", "late", "hourly", "gaps", "telemetry", "meters", "alarm_events", "outbox", "batches")
# a machine as it is stored: its state, and the fingerprints of the time to live with their receipt
HELD = f"{STATE}, copies ARRAY<STRUCT<fingerprint: STRING, at_ms: BIGINT>>"
# fixed value, as stored state is found by it: machines are walked in so many groups. A call of the processor and a frame cost
# far more than the few packets of one machine, so machines share both
GROUPS = 1024
PACKET = ("machine_id", "seq", "company_id", "obs_at", "recv_ms", "is_energy", "energy", "fingerprint", "machine_status", "mode", "parts_count", "alarms", "payload")
Packet = namedtuple("Packet", PACKET)


def _plain(value, whole: bool = True):
    """A frame's value as Python has it: a missing one is None, and a whole number that went through a float is whole again."""
    if value is None or isinstance(value, (str, bool)):
        return value
    return None if value != value else int(value) if whole else float(value)


def _packets(frame: pd.DataFrame) -> Iterator[Packet]:
    """The rows of a frame, with plain values."""
    columns = [frame[n].tolist() if n == "alarms" else [_plain(v, n != "energy") for v in frame[n].tolist()] for n in PACKET]
    return map(Packet._make, zip(*columns))


class Walk:
    """One machine between two packets: the fields of ``STATE`` and the copies that are recognised."""

    __slots__ = (*FIELDS, "recent", "order", "before")

    def __init__(self, state: tuple | None, copies: dict[str, int]):
        for f, v in zip(FIELDS, state if state is not None else [None] * len(FIELDS)):
            setattr(self, f, v)
        self.alarms = None if self.alarms is None else [dict(zip(SINCE_FIELDS, a)) for a in self.alarms]
        self.recent, self.order, self.before = copies, deque(sorted((at, h) for h, at in copies.items())), None

    def state(self) -> tuple:
        alarms = None if self.alarms is None else [tuple(a.values()) for a in self.alarms]
        return tuple(alarms if f == "alarms" else getattr(self, f) for f in FIELDS)


class MachineWalk(StatefulProcessor):
    """Outcome and previous state of every packet of a machine, in the order they came; a key is a machine.

    Packets come and go in Arrow-sized frames; what is held of a machine is its state and the fingerprints of the time to live.
    """

    def __init__(self, p: Params):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", STATE)
        self.copies = handle.getMapState("copies", "fingerprint STRING", "at_ms BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = {k[0]: v[0] for k, v in self.copies.iterator()}
        s = Walk(self.held.get() if self.held.exists() else None, dict(stored))
        for frame in rows:
            steps = [dict(zip(STEP_FIELDS, self._step(s, r))) for r in _packets(frame)]
            yield pd.DataFrame({"steps": pd.Series([steps[i:i + TOGETHER] for i in range(0, len(steps), TOGETHER)], dtype=object)})
        self.held.update(s.state())
        for h in stored.keys() - s.recent.keys():
            self.copies.removeKey((h,))
        for h, at in s.recent.items():
            if stored.get(h) != at:
                self.copies.updateValue((h,), (at,))

    def _step(self, s: Walk, r: Packet) -> tuple:
        """The packet as a row of ``STEP``; moves the machine on."""
        if s.before is not None and r.seq < s.before:
            raise ValueError("packets of a machine came out of order")
        s.before = r.seq
        while s.order and r.recv_ms - s.order[0][0] >= self.p.dedup_ttl_s * 1000:
            at, h = s.order.popleft()
            if s.recent.get(h) == at:
                del s.recent[h]
        old = (None if r.is_energy else s.snap_at, s.status, s.mode, s.baseline, s.meter, s.meter_at)
        alarms = s.alarms
        outcome, remembered = self._outcome(s, r, s.recent)
        if remembered and r.fingerprint is not None:
            s.recent[r.fingerprint] = r.recv_ms
            s.order.append((r.recv_ms, r.fingerprint))
        used = self._take(s, r) if outcome == "accepted" else None
        return (r.machine_id, r.seq, r.company_id, r.obs_at, r.recv_ms, r.is_energy, outcome, r.machine_status, r.mode, r.parts_count, used, r.payload, *old, s.alarms, alarms)

    def _outcome(self, s, r, recent: dict[str, int]) -> tuple[str, bool]:
        """(outcome, whether its copies are recognised from now on)."""
        t, h = r.obs_at, r.fingerprint
        if h in recent:
            return "duplicate", False
        if r.recv_ms - t * 1000 > self.p.max_stale_ms:
            return "late_stale", True
        newest, known = (s.meter_seen_at, s.meter_print) if r.is_energy else (s.snap_at, s.snap_print)
        if newest is not None and t < newest:
            return "late_out_of_order", True
        if newest is not None and t == newest and known == h:
            return "duplicate", False
        return "accepted", True

    def _take(self, s, r) -> float | None:
        """Moves the state on; the meter total, where order lets it be used."""
        t, kwh, alone, count = r.obs_at, r.energy, r.is_energy, r.parts_count
        used = kwh if kwh is not None and kwh > 0 and (alone or ((s.meter_at is None or t >= s.meter_at) and t != s.alone_at)) else None
        if used is not None:
            s.meter, s.meter_at = used, t
        if alone:
            s.meter_seen_at, s.meter_print = t, r.fingerprint
            s.alone_at = t if kwh is not None else s.alone_at
        else:
            if kwh is not None:
                s.meter_seen_at = t if s.meter_seen_at is None else max(s.meter_seen_at, t)
            s.snap_at, s.snap_print, s.status, s.mode = t, r.fingerprint, r.machine_status, r.mode
            if count is not None:
                s.baseline = count if s.baseline is None or count <= self.p.reset_at_most else max(s.baseline, count)
            since = {a["alarm_key"]: a for a in s.alarms or []}
            s.alarms = [{**(since.get(a["alarm_key"]) or {"alarm_key": a["alarm_key"], "severity": None, "started_seq": r.seq, "started_at": t}), "severity": a["severity"]}
                        for a in (r.alarms if r.alarms is not None else [])]
        s.last_seq, s.recv_ms = r.seq, r.recv_ms
        return used

    def close(self) -> None:
        pass


class GroupWalk(MachineWalk):
    """The same for a group of machines that share a key; their packets come machine by machine, so one machine is held at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "machine_id BIGINT", HELD)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A machine that is new to the stream goes on from what the tables say of it."""
        for row in initialState.to_dict("records"):
            self.held.updateValue((int(row["machine_id"]),), (*[_plain(row.get(f), f not in ("meter",)) for f in FIELDS], []))

    def _read(self, machine: int) -> Walk:
        held = self.held.getValue((machine,)) if self.held.containsKey((machine,)) else None
        return Walk(None, {}) if held is None else Walk(held[:len(FIELDS)], {h: at for h, at in held[len(FIELDS)] or []})

    def _keep(self, machine: int, s: Walk) -> None:
        self.held.updateValue((machine,), (*s.state(), list(s.recent.items())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine, s = None, None
        for frame in rows:
            out = []
            for r in _packets(frame):
                if r.machine_id != machine:
                    if s is not None:
                        self._keep(machine, s)
                        if r.machine_id < machine:
                            raise ValueError("machines of a group came out of order")
                    machine, s = r.machine_id, self._read(r.machine_id)
                out.append(self._step(s, r))
            yield pd.DataFrame({n: pd.Series(values, dtype=object) for n, values in zip(STEP_FIELDS, zip(*out))})
        if s is not None:
            self._keep(machine, s)


def blocks_of(rows: DataFrame) -> DataFrame:
    """Adds what the payload holds: fields, power, energy_data."""
    f = F.col("fields")
    opened = staged(rows, fields=canonical(object_of(F.col("payload"))))
    return staged(opened, power=meter.power_block(f), energy_data=meter.energy_block(f))


def meter_rows(opened: DataFrame) -> DataFrame:
    """Meter observations of packets that hold any: machine_id, read_at, company_id, seq, standalone and the 52 fields."""
    wide = staged(opened, **meter.meter_columns(F.col("fields"), F.col("power"), F.col("energy_data")))
    rows = staged(wide, **meter.meter_fields())
    return rows.where(F.coalesce(*[F.col(n).cast("double") for n in meter.NAMES]).isNotNull()).select(
        "machine_id", F.col("obs_at").alias("read_at"), "company_id", "seq", "standalone", *meter.NAMES)


def alarm_events(snapshots: DataFrame) -> DataFrame:
    """Opens, closes and severity changes of accepted snapshots, each with its period's start and the severity before."""
    events = alarms.alarm_events(alarms.diff_columns(snapshots.withColumn("_before", F.col("alarms_before"))), ("alarms_before",))
    held = F.get(F.filter("alarms_before", lambda a: a["alarm_key"] == F.col("alarm_key")), F.lit(0))
    mine = F.col("kind") == "open"
    return events.withColumn("_h", held).select(
        "company_id", "machine_id", "seq", "obs_at", "recv_ms", "alarm_key", "kind", "severity", F.col("_h.severity").alias("severity_before"),
        F.when(mine, F.col("seq")).otherwise(F.col("_h.started_seq")).alias("started_seq"),
        F.when(mine, F.col("obs_at")).otherwise(F.col("_h.started_at")).alias("started_at"))


METRICS = "packets BIGINT, invalid BIGINT, unknown_machine BIGINT, disconnected BIGINT, duration_ms BIGINT"


class MachineStream:
    """Writes the tables of ``TABLES`` below ``root``, each with a folder for every micro-batch.

    ``machines`` is the registry, pinned when the stream starts. ``calendar`` is asked in every micro-batch for the version
    of the shift calendar to use and its number, see ``VersionedTable.pinned``. ``initial`` has columns of ``STATE`` and
    machine_id: what machines go on from that the stream has not seen. ``tables`` can leave out some of them.
    """

    def __init__(self, root: str, machines: DataFrame, calendar: Callable[[SparkSession], tuple[int, DataFrame]], p: Params = DEFAULTS, initial: DataFrame | None = None,
                 tables: tuple[str, ...] = TABLES):
        self.root, self.machines, self.calendar, self.p, self.initial, self.tables = root, machines, calendar, p, initial, tables

    def path(self, table: str, batch_id: int | None = None) -> str:
        return os.path.join(self.root, table, *([f"batch_id={batch_id}"] if batch_id is not None else []))

    def _write(self, rows: DataFrame, table: str, batch_id: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.path(table, batch_id))
        return rows.sparkSession.read.schema(rows.schema).parquet(self.path(table, batch_id))

    def steps(self, messages: DataFrame) -> DataFrame:
        """Packets of known machines that can be read, with outcome and previous state; a stream."""
        rows = admission.admitted(messages, self.machines, self.p, with_values=True, with_alarms=True, keep=("payload",))
        live = F.col("envelope_ok") & F.col("machine_id").isNotNull() & ~F.col("disconnected")
        counted = rows.observe("packets", F.count("*").alias("packets"), F.count_if(~F.col("envelope_ok")).alias("invalid"),
                               F.count_if(F.col("envelope_ok") & F.col("machine_id").isNull()).alias("unknown"),
                               F.count_if(F.col("envelope_ok") & F.col("machine_id").isNotNull() & F.col("disconnected")).alias("disconnected"))
        group = F.pmod(F.hash(F.col("machine_id").cast("bigint")), F.lit(GROUPS))
        known = counted.where(live).select(group.alias("walked"), *[F.col(n).cast(ALARMS).alias(n) if n == "alarms" else n for n in PACKET])
        start = self.initial.withColumn("walked", group).groupBy("walked") if self.initial is not None else None
        return in_order(known, ["walked"], "machine_id", "seq").groupBy("walked").transformWithStateInPandas(GroupWalk(self.p), STEP, "Append", "None", initialState=start)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Every table of a micro-batch, from its steps, which are written first."""
        spark, p = batch.sparkSession, self.p
        version, calendar = self.calendar(spark)
        steps = self._write(batch, "steps", batch_id)
        accepted = steps.where("outcome = 'accepted'")
        booked = production.step_columns(accepted, p)
        if "late" in self.tables:
            late = steps.where("outcome LIKE 'late%'").withColumn("reason", F.substring("outcome", 6, 20))
            self._write(late.select("seq", "machine_id", "company_id", "obs_at", "recv_ms", "reason", "payload"), "late", batch_id)
        if "hourly" in self.tables:
            self._write(production.production_hourly(production.production_slices(booked, calendar, p)), "hourly", batch_id)
        if "gaps" in self.tables:
            self._write(production.gap_records(booked, p), "gaps", batch_id)
        if "meters" in self.tables:
            self._write(meter_rows(blocks_of(steps.where("outcome <> 'duplicate'"))), "meters", batch_id)
        if "telemetry" in self.tables:
            own = active_machines(self.machines).select("machine_id", "plant_id", "controller_type")
            snapshots = accepted.where("NOT standalone").select("seq", "machine_id", "company_id", "recv_ms", F.col("obs_at").cast("double").alias("time_s"), "payload")
            self._write(telemetry_rows(blocks_of(snapshots).join(own, "machine_id")), "telemetry", batch_id)
        if "alarm_events" in self.tables:
            events = self._write(alarm_events(accepted.where("NOT standalone")), "alarm_events", batch_id)
            self._write(alarms.critical_events(events), "outbox", batch_id)
        counts = steps.agg(F.count("*").alias("rows"), F.count_if(F.col("outcome").startswith("late")).alias("late_rows"))
        self._write(counts.withColumn("calendar_version", F.lit(version)), "batches", batch_id)

    def start(self, messages: DataFrame, checkpoint: str):
        """Run over everything available and stop."""
        with sorted_streams(messages.sparkSession):
            return self.steps(messages).writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def run(self, messages: DataFrame, checkpoint: str):
        """Run over everything available, wait, and keep what the micro-batches counted."""
        query = self.start(messages, checkpoint)
        query.awaitTermination()
        self.note(messages.sparkSession, query)
        return query

    def note(self, spark: SparkSession, query) -> None:
        """One row a micro-batch in ``metrics``, from the progress Spark keeps of ``query`` (its last hundred micro-batches).

        The counts were made while the packets passed by (``observe``), so no packet is read for them again.
        """
        for p in query.recentProgress:
            seen = p.observedMetrics.get("packets")
            if seen is not None and p.numInputRows:
                row = [(seen["packets"], seen["invalid"], seen["unknown"], seen["disconnected"], p.batchDuration)]
                self._write(spark.createDataFrame(row, METRICS).coalesce(1), "metrics", p.batchId)

    def batch_stats(self, spark: SparkSession) -> DataFrame:
        """Per micro-batch: packets by what kept them out, rows, late rows, hours and gaps written, and how long it took."""
        out = self.read(spark, "metrics").join(self.read(spark, "batches"), "batch_id", "left")
        for table, name in (("hourly", "upserts"), ("gaps", "gaps")):
            if table in self.tables:
                out = out.join(self.read(spark, table).groupBy("batch_id").agg(F.count("*").alias(name)), "batch_id", "left").fillna(0, [name])
        return out

    # --- what the tables say now -------------------------------------------------------------------------
    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.option("basePath", self.path(table)).parquet(self.path(table))

    def hourly(self, spark: SparkSession) -> DataFrame:
        """Deltas of all micro-batches, added up."""
        return production.sum_hourly(self.read(spark, "hourly"))

    def periods(self, spark: SparkSession) -> DataFrame:
        """Alarm periods: every open, with the close that names its start."""
        events = self.read(spark, "alarm_events")
        key = [*alarms.KEY, "started_seq"]
        ends = events.where("kind = 'close'").select(*key, F.col("obs_at").alias("ended_at"), F.col("recv_ms").alias("ended_recv_ms"))
        return events.where("kind = 'open'").select(*key, "severity", "started_at", F.col("recv_ms").alias("started_recv_ms")).join(ends, key, "left")


def machine_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of every machine as of the last micro-batch, from the state store of a stream's checkpoint."""
    held = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    return held.select("user_map_key.machine_id", "user_map_value.*").drop("copies")


def live(states: DataFrame, now_s: int, p: Params = DEFAULTS) -> DataFrame:
    """Machines heard of within the time to live, with their latest state."""
    return states.where((F.col("snap_at").isNotNull()) & (F.floor(F.col("recv_ms") / 1000) > now_s - p.live_ttl_s))


def initial_states(baseline: DataFrame) -> DataFrame:
    """Rows of ``operators.tables.bootstrap_baseline`` as states to start from; alarms are not known, so the first reading names what to keep."""
    none = lambda kind: F.lit(None).cast(kind)
    given = {"snap_at": "device_time", "status": "machine_status", "mode": "mode", "baseline": "parts_count", "meter": "energy_meter", "meter_at": "energy_meter_at",
             "meter_seen_at": "energy_meter_at", "alone_at": "energy_standalone_at"}
    kinds = {"alarms": SINCE, "snap_print": "string", "meter_print": "string", "last_seq": "bigint", "recv_ms": "bigint"}
    return baseline.select("machine_id", *[F.col(given[f]).cast("double" if f == "meter" else "string" if f in ("status", "mode") else "bigint").alias(f) if f in given
                                           else none(kinds[f]).alias(f) for f in FIELDS])
