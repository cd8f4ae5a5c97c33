"""Alarm periods and events from the alarm state of consecutive readings.

Readings: machine_id, company_id, seq, obs_at, recv_ms and ``alarms``, an array
of {alarm_key, severity}. A change is a row-local comparison with the previous
reading; only changes are exploded, and all that follows runs on those events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.alarm_entries import active_alarms, is_alarming
from millwright.functions.alarm_text import alarm_fields, severity_class, stored_severity
from millwright.functions.battery import is_battery_code
from millwright.functions.payload import built_once, staged
from millwright.operators.scan import last, prev, scan, top
from millwright.params import DEFAULTS, Params
from millwright.session import materialise

KEY = ["company_id", "machine_id", "alarm_key"]


def alarm_state(parsed: DataFrame) -> DataFrame:
    """Adds ``alarms``, the stored key and severity of every active alarm of a parsed packet (``fields``), in its order."""
    f = F.col("fields")
    listed = staged(staged(parsed, _alarming=is_alarming(f)), _listed=active_alarms(f, F.col("_alarming")))
    return staged(listed, alarms=_stored(F.col("_listed"))).drop("_alarming", "_listed")


@built_once
def _stored(listed: Column) -> Column:
    def pair(a):
        fields = alarm_fields(a["alarm_type"], a["alarm_code"], a["alarm_message"], a["alarm_severity"])
        return F.struct(fields["alarm_key"].alias("alarm_key"), fields["severity"].alias("severity"))

    return F.transform(listed, pair)


def alarm_diff(readings: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds opens, closes, updates and keep of every reading against the one before it.

    Severities are compared as they are stored, so none at all is "NORMAL". The
    first reading has nothing to compare with: ``keep`` then names its keys, for
    the stored periods. Where a column ``preserve_battery`` holds, battery codes
    close only if ``battery_clears`` names them.
    """
    return diff_columns(scan(readings, ["machine_id"], before={"_before": prev(F.col("alarms"))}, width=p.chunk_seqs)).drop("_before")


def diff_columns(s: DataFrame) -> DataFrame:
    """The same from the state before the reading in ``_before``; row-local, so batch and stream share it."""
    none = F.array().cast("array<string>")
    names = lambda a: F.coalesce(F.transform(a, lambda x: x["alarm_key"]), none)
    now, old = names(F.col("alarms")), names(F.col("_before"))
    changed = F.filter(F.col("alarms"), lambda x: F.exists(
        F.col("_before"), lambda y: (y["alarm_key"] == x["alarm_key"]) & (stored_severity(y["severity"]) != stored_severity(x["severity"]))))
    closes = F.array_except(old, now)
    if {"preserve_battery", "battery_clears"} <= set(s.columns):
        clear = F.coalesce("battery_clears", none)
        closes = F.filter(closes, lambda k: ~F.coalesce("preserve_battery", F.lit(False)) | ~is_battery_code(k) | F.array_contains(clear, k))
    return (
        s.withColumn("opens", F.array_except(now, old)).withColumn("closes", closes)
        .withColumn("updates", F.coalesce(names(changed), none)).withColumn("keep", F.when(F.col("_before").isNull(), now))
    )


def alarm_events(diff: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per opened, cleared or re-graded alarm key, with the columns to ``keep``."""
    severity = lambda k: F.get(F.filter(F.col("alarms"), lambda a: a["alarm_key"] == k), F.lit(0))["severity"]
    rows = lambda column, kind: F.transform(F.col(column), lambda k: F.struct(
        k.alias("alarm_key"), F.lit(kind).alias("kind"), severity(k).alias("severity")))
    every = F.concat(rows("closes", "close"), rows("opens", "open"), rows("updates", "severity"))
    return diff.where(F.size("opens") + F.size("closes") + F.size("updates") > 0).select(
        "company_id", "machine_id", "seq", "obs_at", "recv_ms", *keep, F.explode(every).alias("_e")
    ).select("company_id", "machine_id", "seq", "obs_at", "recv_ms", *keep, "_e.*")


def alarm_timeline(events: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds to every event its period's start, its end, and the severity held before it."""
    kind = F.col("kind")
    mark = lambda k: F.when(kind == k, F.struct("obs_at", "seq", "recv_ms"))
    s = scan(events, ["machine_id", "alarm_key"],
             before={"_opened": last(mark("open")), "severity_before": last(F.when(kind != "close", F.col("severity")))},
             after={"_closed": last(mark("close"))}, width=p.chunk_seqs)
    own = F.when(kind == "open", F.struct("obs_at", "seq", "recv_ms")).otherwise(F.col("_opened"))
    return s.withColumn("_opened", own).select(
        *events.columns, "severity_before", F.col("_opened.obs_at").alias("started_at"),
        F.col("_opened.seq").alias("started_seq"), F.col("_closed.obs_at").alias("ended_at"),
        F.col("_closed.recv_ms").alias("ended_recv_ms"))


def alarm_periods(timeline: DataFrame) -> DataFrame:
    """One row per occurrence of an alarm; ended_at is null while it is open."""
    return timeline.where("kind = 'open'").select(
        "company_id", "machine_id", "alarm_key", "severity", "started_seq", "started_at", "ended_at",
        F.col("recv_ms").alias("started_recv_ms"), "ended_recv_ms")


def severity_changes(timeline: DataFrame) -> DataFrame:
    changed = severity_class(F.col("severity")) != severity_class(F.col("severity_before"))
    return timeline.where("kind = 'severity'").select(
        "company_id", "machine_id", "alarm_key", "seq", "obs_at", "started_at", "severity_before", "severity",
        F.when(changed, F.col("obs_at")).alias("priority_changed_at"))


def critical_events(timeline: DataFrame) -> DataFrame:
    """An event when an alarm opens critical or becomes critical; one per alarm and second."""
    into = (F.col("kind") == "open") | (severity_class(F.col("severity_before")) != "critical")
    hits = timeline.where(F.col("kind").isin("open", "severity") & into & (severity_class(F.col("severity")) == "critical"))
    return hits.groupBy(*KEY, "started_seq", F.col("obs_at").alias("occurred_at")).agg(
        F.max("severity").alias("severity"), F.min("recv_ms").alias("recv_ms"))


def battery_latch(observed: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """A battery code stays active until its own diagnostic says otherwise: adds ``active``.

    Rows: machine_id, alarm_code, seq, state (true, false, or null for unknown).
    """
    s = scan(observed, ["machine_id", "alarm_code"], before={"_held": last(F.col("state"))}, width=p.chunk_seqs)
    return s.withColumn("active", F.coalesce(F.col("state"), F.col("_held"), F.lit(False))).drop("_held")


# --- against stored periods -----------------------------------------------------------------------------


def open_guard(opens: DataFrame, periods: DataFrame) -> DataFrame:
    """Opens (with obs_at, recv_ms) that no stored period of the key forbids.

    Forbidden when a period is open, or one started or ended later, or at the
    same second with a receipt at least as late. The latest (time, receipt)
    pair per key decides, so there is one row to compare per key.
    """
    latest = periods.groupBy(*KEY).agg(
        F.max(F.struct("started_at", "started_recv_ms")).alias("_s"),
        F.max(F.when(F.col("ended_at").isNotNull(), F.struct("ended_at", "ended_recv_ms"))).alias("_e"),
        F.bool_or(F.col("ended_at").isNull()).alias("_open"))
    at, recv = F.col("obs_at"), F.col("recv_ms")
    newer = lambda t, r: F.coalesce((t > at) | ((t == at) & (r >= recv)), F.lit(False))
    barred = F.coalesce(F.col("_open"), F.lit(False)) | newer(
        F.col("_s.started_at"), F.col("_s.started_recv_ms")) | newer(F.col("_e.ended_at"), F.col("_e.ended_recv_ms"))
    return opens.join(latest, KEY, "left").where(~barred).select(*opens.columns)


def close_match(requests: DataFrame, periods: DataFrame) -> DataFrame:
    """Open periods a close request ends.

    A request names keys to close (``closes``), or, after a restart without a
    baseline, the keys to keep (``keep``): everything else that is open closes. Where ``preserve_battery`` holds (a column
    that may be missing), battery codes close only if they are among those known clear (``battery_clears``). It must not be older than the period's start or its
    last severity observation.
    """
    preserve = F.coalesce("preserve_battery", F.lit(False)) if "preserve_battery" in requests.columns else F.lit(False)
    r = requests.select("company_id", "machine_id", "obs_at", "recv_ms", "closes", "keep", "battery_clears", preserve.alias("_preserve"))
    key, seen, at = F.col("alarm_key"), F.col("observed_at"), F.col("obs_at")
    in_time = (F.col("started_at") <= at) & (F.coalesce(seen, F.col("started_at")) <= at) & (
        seen.isNull() | (seen != at) | (F.coalesce(F.col("observed_recv_ms"), seen * 1000) <= F.col("recv_ms")))
    still_open = periods.where(F.col("ended_at").isNull())
    # named keys meet their period directly; a keep list concerns every open key of its machine
    named = still_open.join(r.where(F.col("keep").isNull()).select(
        "company_id", "machine_id", "obs_at", "recv_ms", F.explode("closes").alias("alarm_key")), KEY).where(in_time)
    held = F.col("_preserve") & is_battery_code(key) & ~F.coalesce(F.array_contains("battery_clears", key), F.lit(False))
    swept = still_open.join(r.where(F.col("keep").isNotNull()), ["company_id", "machine_id"]).where(
        in_time & ~F.array_contains("keep", key) & ~held)
    cols = [*KEY, "started_at", "obs_at", "recv_ms"]
    hits = named.select(*cols).unionByName(swept.select(*cols))
    return hits.groupBy(*KEY, "started_at").agg(F.min(F.struct("obs_at", "recv_ms")).alias("_c")).select(
        *KEY, "started_at", F.col("_c.obs_at").alias("ended_at"), F.col("_c.recv_ms").alias("ended_recv_ms"))


def priority_steps(observations: DataFrame, periods: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The severity observations that apply to an open period, in the order they came, each with the severity held before.

    One applies if it is newer, by device time and then receipt, than what is
    stored and than every one applied before it. ``changed`` says whether the
    severity class is another one.
    """
    stored = periods.where(F.col("ended_at").isNull()).select(
        *KEY, "started_at", F.col("severity").alias("_stored"), F.col("observed_at").alias("_at"),
        F.coalesce(F.col("observed_recv_ms"), F.col("observed_at") * 1000).alias("_recv"))
    newer = F.col("_at").isNull() | (F.col("_at") < F.col("obs_at")) | ((F.col("_at") == F.col("obs_at")) & (F.col("_recv") < F.col("recv_ms")))
    fit = observations.select(*KEY, "seq", "obs_at", "recv_ms", "severity").join(stored, KEY).where((F.col("started_at") <= F.col("obs_at")) & newer)
    when = F.struct("obs_at", "recv_ms")
    s = scan(fit, KEY, before={"_newest": top(when)}, width=p.chunk_seqs)
    applied = materialise(s.where(F.col("_newest").isNull() | (F.col("_newest") < when)).drop("_newest", "_at", "_recv"))
    held = scan(applied, KEY, before={"_held": last(F.struct("severity"))}, width=p.chunk_seqs)
    before = F.when(F.col("_held").isNotNull(), F.col("_held.severity")).otherwise(F.col("_stored"))
    steps = held.withColumn("severity_before", before).drop("_held", "_stored")
    return steps.withColumn("changed", severity_class(F.col("severity")) != severity_class(F.col("severity_before")))


def priority_match(observations: DataFrame, periods: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Per open period with an applied observation: the last severity, when it was seen, and when its class last changed."""
    return priority_steps(observations, periods, p).groupBy(*KEY, "started_at").agg(
        F.max_by("severity", "seq").alias("severity"), F.max_by("obs_at", "seq").alias("observed_at"), F.max_by("recv_ms", "seq").alias("observed_recv_ms"),
        F.max_by("obs_at", F.when(F.col("changed"), F.col("seq"))).alias("priority_changed_at"))


def priority_events(observations: DataFrame, periods: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """A notification for every change of a stored period into critical."""
    into = F.col("changed") & (severity_class(F.col("severity")) == "critical")
    return priority_steps(observations, periods, p).where(into).select(*KEY, "started_at", F.col("obs_at").alias("occurred_at"), "recv_ms", "severity")


def continuity_reset(periods: DataFrame, requests: DataFrame) -> DataFrame:
    """Open alarms confirmed by a restart: continuity starts no earlier than that observation."""
    kept = requests.select("company_id", "machine_id", "obs_at", F.explode("keep").alias("alarm_key")).groupBy(*KEY).agg(
        F.max("obs_at").alias("_at"))
    hit = F.col("ended_at").isNull() & (F.col("started_at") <= F.col("_at"))
    return periods.join(kept, KEY, "left").withColumn(
        "continuity_at", F.when(hit, F.greatest("continuity_at", "_at")).otherwise(F.col("continuity_at"))).drop("_at")


def open_battery_codes(periods: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Per machine: its open battery alarm codes, the newest first, at most ``max_battery_codes``."""
    newest = Window.partitionBy("machine_id").orderBy(F.col("started_at").desc(), "alarm_key")
    top = periods.where(F.col("ended_at").isNull() & is_battery_code(F.col("alarm_key"))).withColumn(
        "_n", F.row_number().over(newest)).where(F.col("_n") <= p.max_battery_codes)
    return top.groupBy("machine_id").agg(F.array_sort(F.collect_list("alarm_key")).alias("codes"))
