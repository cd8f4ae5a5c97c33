"""The two rules whose state depends on their own earlier output: lag alerts and identity writes.

Both read narrow rows that were reduced before they meet by key: one row per
machine and lag window, or one row per identity sighting.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millwright.params import DEFAULTS, Params

ALERT = ("plant_id BIGINT, window_start BIGINT, kind STRING, level STRING, machines ARRAY<BIGINT>, late_readings BIGINT, "
         "worst_ms BIGINT")
WINDOW = ("plant_id BIGINT, machine_id BIGINT, window_start BIGINT, late_readings BIGINT, worst_ms BIGINT, last_ms BIGINT, "
          "ends_on_time BOOLEAN, on_time BOOLEAN")


def machine_windows(readings: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One row per plant, machine and aligned window: what the alert rule needs of its readings."""
    late = F.col("lag_ms") > p.late_ms
    window = (F.floor(F.col("recv_ms") / (p.lag_window_s * 1000)) * p.lag_window_s).cast("long")
    return readings.groupBy("plant_id", "machine_id", window.alias("window_start")).agg(
        F.count_if(late).alias("late_readings"), F.max(F.when(late, F.col("lag_ms"))).alias("worst_ms"),
        F.max("recv_ms").alias("last_ms"), F.max_by(~late, "seq").alias("ends_on_time"), F.bool_or(~late).alias("on_time"))


class LagAlerts(StatefulProcessor):
    """A line when a machine is newly late, a window is worse than reported, or a reminder is due."""

    def __init__(self, p: Params):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getMapState("shown", "machine_id BIGINT", "step INT, heard_ms BIGINT")
        self.last = handle.getValueState("last", "shown_ms BIGINT")

    def _step(self, ms: int) -> int:
        return sum(ms > s for s in self.p.steps_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        p, plant = self.p, key[0]
        shown = {k[0]: [v[0], v[1]] for k, v in self.shown.iterator()}
        before = set(shown)
        last = self.last.get()[0] if self.last.exists() else None
        windows: dict[int, list[Row]] = {}
        for r in rows:
            windows.setdefault(r["window_start"], []).append(r)
        for start in sorted(windows):
            now = (start + p.lag_window_s) * 1000
            seen = sorted(windows[start], key=lambda r: r["machine_id"])
            for r in seen:
                if r["machine_id"] in shown:
                    shown[r["machine_id"]][1] = r["last_ms"]
            shown = {m: v for m, v in shown.items() if now - v[1] <= p.forget_ms}
            back = [r["machine_id"] for r in seen if r["machine_id"] in shown and r["ends_on_time"]]
            late = [r for r in seen if r["late_readings"]]
            if late:
                worst = max(r["worst_ms"] for r in late)
                step = self._step(worst)
                known = [shown[r["machine_id"]][0] for r in late if r["machine_id"] in shown]
                if len(known) < len(late) or step > max(known) or last is None or now - last >= p.remind_ms:
                    yield Row(plant_id=plant, window_start=start, kind="late", level="error" if step >= 2 else "warn",
                              machines=[r["machine_id"] for r in late],
                              late_readings=sum(r["late_readings"] for r in late), worst_ms=worst)
                    shown.update({r["machine_id"]: [self._step(r["worst_ms"]), r["last_ms"]] for r in late})
                    last = now
            if back:
                yield Row(plant_id=plant, window_start=start, kind="recovered", level="info", machines=back,
                          late_readings=0, worst_ms=None)
                for m in back:
                    shown.pop(m, None)
                if not shown:
                    last = now
        for m in before - set(shown):
            self.shown.removeKey((m,))
        for m, (step, heard) in shown.items():
            self.shown.updateValue((m,), (step, heard))
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


def lag_alerts(windows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return windows.groupBy("plant_id").transformWithState(LagAlerts(p), ALERT, "Append", "None")


SIGHTING = "machine_id BIGINT, seq BIGINT, recv_ms BIGINT, identity STRING"


class IdentityWrites(StatefulProcessor):
    """A sighting is written when it differs from the last write, or that write is an hour old."""

    def __init__(self, p: Params):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.written = handle.getValueState("written", "identity STRING, at_ms BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = tuple(self.written.get()) if self.written.exists() else None
        for r in sorted(rows, key=lambda r: r["seq"]):
            if state is None or state[0] != r["identity"] or r["recv_ms"] - state[1] >= self.p.identity_every_s * 1000:
                state = (r["identity"], r["recv_ms"])
                yield Row(machine_id=key[0], seq=r["seq"], recv_ms=r["recv_ms"], identity=r["identity"])
        if state is not None:
            self.written.update(state)

    def close(self) -> None:
        pass


def identity_writes(sightings: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return sightings.groupBy("machine_id").transformWithState(IdentityWrites(p), SIGHTING, "Append", "None")


def use_rocksdb(spark) -> None:
    """The state store these operators need; large state stays on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
