"""Which messages are taken in: envelope checks, time, lane, order, duplicates, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions import meter
from millwright.functions.numbers import INT8, plain_number, strict_count
from millwright.functions.payload import canonical, depth_ok, fingerprint, object_of, staged, trimmed
from millwright.operators.alarms import alarm_state
from millwright.operators.registry import active_machines
from millwright.operators.scan import last, scan, top
from millwright.params import DEFAULTS, Params
from millwright.session import materialise

# fixed value: topic of a machine's telemetry, with the machine's key
TOPIC = r"^machines/([^/+#\s]{1,256})/telemetry$"


def topic_key(topic: Column) -> Column:
    key = F.regexp_extract(topic, TOPIC, 1)
    return F.when(key != "", key)


def size_ok(payload: Column, p: Params = DEFAULTS) -> Column:
    return F.coalesce(F.octet_length(payload).between(1, p.max_payload_bytes), F.lit(False))


def is_disconnected(fields: Column) -> Column:
    """Only an explicit "not connected"; the word is matched exactly."""
    return F.coalesce(fields["connection"].isin("false", "0"), F.lit(False))


def valid_device_time(time_s: Column, recv_ms: Column, p: Params = DEFAULTS) -> Column:
    whole = (time_s % 1 == 0) & time_s.between(p.min_device_time, INT8[1])
    return F.coalesce(whole & (time_s * 1000 <= recv_ms + p.max_future_ms), F.lit(False))


def is_stale(lag_ms: Column, p: Params = DEFAULTS) -> Column:
    return lag_ms > p.max_stale_ms


def parse(messages: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Envelope checks and canonical fields.

    Adds api_key, fields (canonical map), power, energy_data (meter blocks),
    envelope_ok, is_energy, time_s and disconnected.
    """
    sized = messages.withColumn("api_key", topic_key(F.col("topic"))).withColumn(
        "_ok", F.col("api_key").isNotNull() & size_ok(F.col("payload"), p))
    f, power, energy = F.col("fields"), F.col("power"), F.col("energy_data")
    opened = staged(sized, fields=F.when(F.col("_ok"), canonical(object_of(F.col("payload")))))
    blocks = staged(opened, power=meter.power_block(f), energy_data=meter.energy_block(f))
    lanes = staged(blocks, is_energy=F.coalesce(F.when(
        meter.has_electrical_keys_only(f), meter.any_readable(f, power, energy)), F.lit(False)))
    timed = staged(lanes, time_s=observation_time(f, F.col("is_energy"), F.col("recv_ms")))
    return staged(timed, envelope_ok=F.col("_ok") & f.isNotNull() & depth_ok(F.col("payload"), p.max_depth)
                  & valid_device_time(F.col("time_s"), F.col("recv_ms"), p),
                  disconnected=is_disconnected(f)).drop("_ok")


def observation_time(fields: Column, is_energy: Column, recv_ms: Column) -> Column:
    """Payload time; the receipt second only for an energy packet that carries no time at all."""
    absent = ~F.map_contains_key(fields, F.lit("time"))
    given = F.when(trimmed(fields["time"]) == "", F.lit(0.0)).otherwise(plain_number(fields["time"]))
    return F.when(absent & is_energy, F.floor(recv_ms / 1000).cast("double")).when(~absent, given)


def first_copies(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds ``is_first``: no equal reading of the machine was taken in during the time to live before it; and ``resent``.

    Rows: machine_id, fingerprint, seq, recv_ms, read from a written table or checkpoint. The time to live counts from
    the copy that was taken in, not from the last one seen, so a packet that is sent again and again is looked at once
    in every such time. A row without a fingerprint is never a copy. The scan cuts a group of copies into chunks, so
    none of any size meets in one task; copies within the time to live of the first are settled by it, and only
    later ones take the longer way of ``anchors``. ``resent`` tells that an equal one was there at any time before.
    """
    key, ttl = ["machine_id", "_print"], p.dedup_ttl_s * 1000
    named = rows.withColumn("_print", F.coalesce("fingerprint", F.concat(F.lit("row "), F.col("seq"))))
    s = scan(named, key, before={"_since": top(-F.col("recv_ms"))}, width=p.chunk_seqs)
    since = F.col("recv_ms") + F.col("_since")  # the earliest receipt before, negative
    settled = materialise(s.withColumn("is_first", F.when(F.col("_since").isNull(), True).when(since < ttl, False)).withColumn("resent", F.col("_since").isNotNull()).drop("_since"))
    again = settled.where("is_first IS NULL")
    if again.limit(1).count() == 0:
        return settled.drop("_print")
    times = again.groupBy(*key, F.col("recv_ms").alias("t")).agg(F.min("seq").alias("_anchor"))
    taken = times.join(anchors(times.drop("_anchor"), key, ttl), [*key, "t"]).select("_anchor")
    later = again.join(taken, F.col("seq") == F.col("_anchor"), "left").withColumn("is_first", F.col("_anchor").isNotNull()).drop("_anchor")
    return settled.where("is_first IS NOT NULL").unionByName(later).drop("_print")


def anchors(times: DataFrame, key: list[str], ttl: int) -> DataFrame:
    """Of different times ``t`` per key: the first, the first that is ``ttl`` or more after it, and so on.

    The next of a time t stands in the bucket of t + ttl or, if there is none, first in a later bucket; buckets are as
    long as the time to live, so a window group holds the times of one bucket, or one row per bucket. Whoever is
    reached from the first is found by doubling: after k rounds the 2^k first anchors are known and every time
    knows its 2^k-th next one.
    """
    cut = times.withColumn("_b", F.expr(f"t div {ttl}"))
    order = Window.partitionBy(*key).orderBy("_b")
    after, second, third = (f(F.col(c)).over(order) for f, c in ((F.lead, "_b"), (F.lead, "_low"), (lambda x: F.lead(x, 2), "_low")))
    later = cut.groupBy(*key, "_b").agg(F.min("t").alias("_low")).select(
        *key, (F.col("_b") + 1).alias("_b"), F.when(after == F.col("_b") + 1, third).otherwise(second).alias("_later"))
    asked = cut.select(*key, (F.col("t") + ttl).alias("_at"), (F.col("_b") + 1).alias("_b"), F.col("t").alias("_from"))
    held = cut.select(*key, F.col("t").alias("_at"), "_b", F.lit(None).cast("long").alias("_from"))
    onward = Window.partitionBy(*key, "_b").orderBy("_at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    near = asked.unionByName(held).withColumn("_near", F.min(F.when(F.col("_from").isNull(), F.col("_at"))).over(onward)).where("_from IS NOT NULL")
    jump = materialise(near.join(later, [*key, "_b"], "left").select(*key, F.col("_from").alias("t"), F.coalesce("_near", "_later").alias("n")).where("n IS NOT NULL"))
    reached = materialise(times.groupBy(*key).agg(F.min("t").alias("t")))
    parts = [reached]
    while True:
        new = materialise(reached.join(jump, [*key, "t"]).select(*key, F.col("n").alias("t")))
        if new.limit(1).count() == 0:
            return reached
        parts.append(new)
        reached = parts[0]
        for part in parts[1:]:
            reached = reached.unionByName(part)
        onwards = jump.select(*key, F.col("t").alias("n"), F.col("n").alias("_n"))
        jump = materialise(jump.join(onwards, [*key, "n"]).select(*key, "t", F.col("_n").alias("n")))


def arrival_order(rows: DataFrame, at: str = "obs_at", p: Params = DEFAULTS) -> DataFrame:
    """Adds ``newest_before`` and ``out_of_order``; an equal time is in order."""
    s = scan(rows, ["machine_id"], before={"newest_before": top(F.col(at))}, width=p.chunk_seqs)
    return s.withColumn("out_of_order", F.coalesce(F.col(at) < F.col("newest_before"), F.lit(False)))


def meter_order(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Order and use of meter readings of both lanes.

    Rows: machine_id, seq, obs_at, standalone, energy. Adds ``late`` and
    ``used``. Each pass needs the one before it, so each is written down once.
    """
    at, alone, kwh = F.col("obs_at"), F.col("standalone"), F.col("energy")
    one = scan(rows, ["machine_id"], before={"_snap": top(F.when(~alone, at))}, width=p.chunk_seqs)
    one = materialise(one.withColumn("_late", ~alone & F.coalesce(at < F.col("_snap"), F.lit(False))).drop("_snap"))
    observed = F.when(alone | (~F.col("_late") & kwh.isNotNull()), at)
    two = scan(one, ["machine_id"], before={"_obs": top(observed)}, width=p.chunk_seqs)
    two = materialise(two.withColumn("late", F.when(alone, F.coalesce(at < F.col("_obs"), F.lit(False)))
                                     .otherwise(F.col("_late"))).drop("_obs", "_late"))
    own = F.when(alone & ~F.col("late") & kwh.isNotNull(), at)
    three = scan(two, ["machine_id"], before={"_alone_at": last(own)}, width=p.chunk_seqs)
    candidate = ~F.col("late") & F.coalesce(kwh > 0, F.lit(False)) & (
        alone | F.coalesce(at != F.col("_alone_at"), F.lit(True)))
    three = materialise(three.withColumn("_candidate", candidate).drop("_alone_at"))
    four = scan(three, ["machine_id"], before={"_base": top(F.when(F.col("_candidate"), at))}, width=p.chunk_seqs)
    used = F.col("_candidate") & (alone | F.coalesce(at >= F.col("_base"), F.lit(True)))
    return four.withColumn("used", used).drop("_candidate", "_base")


def admitted(messages: DataFrame, machines: DataFrame, p: Params = DEFAULTS, with_readings: bool = False, with_values: bool = False,
             with_alarms: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Packets as narrow rows, parsed once: what the outcome and all later steps of a machine need.

    ``has_reading`` (any meter column can be read) is worked out for snapshots only ``with_readings``; a meter-only
    packet always has one. ``with_values`` adds the state, mode and count of snapshots, ``with_alarms`` their active
    alarms. The payload goes no further unless it is to ``keep``.
    """
    parsed = parse(messages, p)
    if with_alarms:
        parsed = alarm_state(parsed)
    blocks = (F.col("fields"), F.col("power"), F.col("energy_data"))
    f, alone = F.col("fields"), F.col("is_energy")
    own = F.coalesce(meter.any_readable(*blocks), F.lit(False)) if with_readings else F.lit(False)
    values = {"machine_status": F.when(~alone, f["machine_status"]), "mode": F.when(~alone, F.substring(f["mode"], 1, 64)),
              "parts_count": F.when(~alone, strict_count(f["parts_count"]))} if with_values else {}
    if with_alarms:
        parsed = parsed.withColumnRenamed("alarms", "_alarms")
        values |= {"alarms": F.when(~alone, F.col("_alarms"))}
    slim = staged(parsed, energy=meter.electrical_signals(*blocks)["energy"], has_reading=alone | own, **values).select(
        "seq", "api_key", "recv_ms", "envelope_ok", "disconnected", "is_energy",
        F.when(F.col("envelope_ok"), F.col("time_s").cast("long")).alias("obs_at"), "energy", "has_reading", *values, *keep,
        F.when(F.col("envelope_ok"), fingerprint(F.col("payload"), F.col("time_s").cast("long"))).alias("fingerprint"))
    known = active_machines(machines).select("api_key", "machine_id", "company_id")
    return slim.join(known, "api_key", "left")


def outcomes(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds the ``outcome`` to admitted rows (written once, as several scans read them); the first that fits counts.

    Every step hands on the rows that it does not settle, so nothing is matched back by number.
    """
    rows = materialise(rows)
    at, alone = F.col("obs_at"), F.col("is_energy")
    live = F.col("envelope_ok") & F.col("machine_id").isNotNull() & ~F.col("disconnected")
    told = lambda df, outcome: df.select(*rows.columns, outcome.alias("outcome"))
    refused = told(rows.where(~live), F.when(~F.col("envelope_ok"), "invalid").when(F.col("machine_id").isNull(), "unknown_machine").otherwise("disconnected"))
    marked = first_copies(rows.where(live), p)
    stale = is_stale(F.col("recv_ms") - at * 1000, p)
    early = told(marked.where(~F.col("is_first") | stale), F.when(~F.col("is_first"), "duplicate").otherwise("late_stale"))
    ontime = marked.where(F.col("is_first") & ~stale)
    one = scan(ontime, ["machine_id"], before={"_snap": top(F.when(~alone, at))}, width=p.chunk_seqs)
    one = materialise(one.withColumn("_late", ~alone & F.coalesce(at < F.col("_snap"), F.lit(False))).drop("_snap"))
    seen = F.when(alone | (~F.col("_late") & F.col("energy").isNotNull()), at)
    state = F.when(~alone & ~F.col("_late"), F.struct("obs_at", "fingerprint"))
    two = scan(one, ["machine_id"], before={"_obs": top(seen), "_state": last(state)}, width=p.chunk_seqs)
    late = F.when(alone, F.coalesce(at < F.col("_obs"), F.lit(False))).otherwise(F.col("_late"))
    same = F.coalesce(~alone & (F.col("_state.obs_at") == at) & (F.col("_state.fingerprint") == F.col("fingerprint")), F.lit(False))
    two = materialise(two.select(*marked.columns, late.alias("_late"), same.alias("_same"), (alone & (at == F.col("_obs"))).alias("_at_last")))
    # a meter packet as old as the last one equals it or not: only where such a packet came again is the last one looked up
    if two.where("_at_last AND NOT _late AND resent").limit(1).count():
        three = scan(two, ["machine_id"], before={"_print": last(F.when(alone & ~F.col("_late"), F.col("fingerprint")))}, width=p.chunk_seqs)
        two = three.withColumn("_same", F.col("_same") | F.coalesce(F.col("_at_last") & (F.col("_print") == F.col("fingerprint")), F.lit(False)))
    settled = told(two, F.when(F.col("_late"), "late_out_of_order").when(F.col("_same"), "duplicate").otherwise("accepted"))
    return refused.unionByName(early).unionByName(settled)


def classify(messages: DataFrame, machines: DataFrame, p: Params = DEFAULTS, with_readings: bool = False) -> DataFrame:
    """One outcome per message: seq, machine_id, company_id, obs_at, recv_ms, is_energy, has_reading, outcome."""
    return outcomes(admitted(messages, machines, p, with_readings), p).select(
        "seq", "machine_id", "company_id", "obs_at", "recv_ms", "is_energy", "has_reading", "outcome")


def accepted_readings(messages: DataFrame, machines: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Raw packets to readings that production can take: both lanes, in the machine's order.

    Every accepted packet with its state, mode and count (snapshots only), and the meter total where the order of meter
    readings lets it be used.
    """
    taken = outcomes(admitted(messages, machines, p, with_values=True), p).where("outcome = 'accepted'").select(
        "seq", "machine_id", "company_id", "obs_at", "recv_ms", F.col("is_energy").alias("standalone"), "machine_status", "mode", "parts_count", "energy")
    used = F.when(F.col("used"), F.col("energy"))
    return materialise(meter_order(materialise(taken), p).withColumn("energy", used).drop("late", "used"))


def outcome_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("outcome").agg(F.count("*").alias("messages"))


def energy_counts(classified: DataFrame) -> DataFrame:
    """Meter-only packets taken in, and messages that came late with a meter reading of their own."""
    late = F.col("outcome").isin("late_stale", "late_out_of_order")
    return classified.agg(
        F.count_if((F.col("outcome") == "accepted") & F.col("is_energy")).alias("energy_accepted"),
        F.count_if(late & F.col("has_reading")).alias("energy_late_accepted"))
