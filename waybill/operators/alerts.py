"""Alert episodes with hysteresis: conditions, the evaluator as one fold, episodes from the log, dismissals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waybill.functions.columns import epoch_ms, plus_seconds, seconds_between
from waybill.operators.scan import SLICE_SEC, earlier, folded, last_value, slice_of, sliced, within
from waybill.schemas import CLEAR_BAND

COLUMNS = ["alert_id", "vehicle_id", "alert_type", "severity", "raised_at", "escalated_at", "resolved_at", "dismissed_at", "dismiss_reason"]


def thresholds(spec: DataFrame) -> DataFrame:
    of = lambda signal, c: F.max(F.when(F.col("signal") == signal, F.col(c)))
    return spec.agg(
        of("soc", "max_age_sec").alias("soc_age"),
        of("battery_temp", "max_age_sec").alias("temp_age"),
        of("soc", "warn_lo").alias("soc_warn_lo"),
        of("soc", "crit_lo").alias("soc_crit_lo"),
        of("battery_temp", "crit_hi").alias("temp_crit_hi"),
    )


def severity_of(kind: Column, value: Column) -> Column:
    """critical, warning or null by the bare thresholds, with the threshold columns beside."""
    low = F.when(value < F.col("soc_crit_lo"), "critical").when(value < F.col("soc_warn_lo"), "warning")
    return F.when(kind == "battery_low", low).when(value > F.col("temp_crit_hi"), "critical")


def cleared(kind: Column, value: Column) -> Column:
    return F.when(kind == "battery_low", value >= F.col("soc_warn_lo") + CLEAR_BAND).otherwise(value <= F.col("temp_crit_hi") - CLEAR_BAND)


def fresh_battery(latest: DataFrame, spec: DataFrame, now: Column) -> DataFrame:
    """Fresh battery values, null where too old; one row a vehicle with any value."""
    rows = latest.crossJoin(F.broadcast(thresholds(spec)))  # one row
    of = lambda signal, age: F.max(F.when((F.col("signal") == signal) & (F.col("event_ts") >= plus_seconds(now, -F.col(age))), F.col("value")))
    return rows.groupBy("vehicle_id").agg(of("soc", "soc_age").alias("soc"), of("battery_temp", "temp_age").alias("battery_temp"))


def conditions(latest: DataFrame, spec: DataFrame, now: Column) -> DataFrame:
    """vehicle_id, alert_type, severity, cleared; no row for a value that is not fresh."""
    rows = fresh_battery(latest, spec, now).select("vehicle_id", F.expr("stack(2, 'battery_low', soc, 'battery_overheat', battery_temp) AS (alert_type, value)")).filter("value IS NOT NULL")
    rows = rows.crossJoin(F.broadcast(thresholds(spec)))
    return rows.select("vehicle_id", "alert_type", severity_of(F.col("alert_type"), F.col("value")).alias("severity"), cleared(F.col("alert_type"), F.col("value")).alias("cleared"))


def evaluate(alerts: DataFrame, condition: DataFrame, now: Column) -> DataFrame:
    """The alert table after one evaluation: open rows resolve, rescore or stay; breaches without an open row are raised.

    A resolved row keeps its severity, and no row is raised for a key that was open before.
    """
    c = condition.select("vehicle_id", "alert_type", F.col("severity").alias("c_severity"), F.col("cleared").alias("c_cleared"))
    open_, closed = alerts.filter("resolved_at IS NULL"), alerts.filter("resolved_at IS NOT NULL")
    both = open_.join(c, ["vehicle_id", "alert_type"], "full_outer")
    old, breach = F.col("alert_id").isNotNull(), F.col("c_severity").isNotNull()
    clears = old & F.coalesce("c_cleared", F.lit(False))
    worse = old & breach & (F.col("c_severity") == "critical") & (F.col("severity") != "critical")
    stamp = F.concat_ws("|", "vehicle_id", "alert_type", epoch_ms(now).cast("string"))
    none = F.lit(None)
    folded = both.filter(old | breach).select(
        F.coalesce("alert_id", stamp).alias("alert_id"),
        "vehicle_id",
        "alert_type",
        F.when(old & ~breach, F.col("severity")).otherwise(F.col("c_severity")).alias("severity"),
        F.coalesce("raised_at", now).alias("raised_at"),
        F.when(worse | (~old & (F.col("c_severity") == "critical")), now).otherwise(F.col("escalated_at")).alias("escalated_at"),
        F.when(clears, now).alias("resolved_at"),
        F.when(worse, none).otherwise(F.col("dismissed_at")).alias("dismissed_at"),
        F.when(worse, none).otherwise(F.col("dismiss_reason")).alias("dismiss_reason"),
    )
    return closed.select(*COLUMNS).unionByName(folded)


def episodes(log: DataFrame, spec: DataFrame, kinds: DataFrame, seconds: int = SLICE_SEC) -> DataFrame:
    """Episodes of the whole log, each reading an evaluation at its own time.

    A reading in breach opens, a cleared one closes, any other leaves things as they are.  The log is
    scanned by slices: a slice is told whether an episode was open, how many had begun and the last severity.
    """
    key = ["vehicle_id", "alert_type"]
    rows = log.join(F.broadcast(kinds), "signal").crossJoin(F.broadcast(thresholds(spec)))  # two rows, one row
    rows = rows.select(*key, "event_ts", severity_of(F.col("alert_type"), F.col("value")).alias("sev"), cleared(F.col("alert_type"), F.col("value")).alias("clr"))
    rows = sliced(rows.select(*key, "event_ts", "sev", F.when(F.col("sev").isNotNull(), 1).when(F.col("clr"), 0).alias("mark")), slice_of("event_ts", seconds))
    w = within(key, "event_ts")
    sooner = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("mark_before", F.last("mark", ignorenulls=True).over(sooner)).withColumn("sev_before", F.last("sev", ignorenulls=True).over(sooner))

    opens = (F.col("mark") == 1) & (F.col("mark_before") == 0)
    first = F.min_by("mark", F.when(F.col("mark").isNotNull(), F.col("event_ts")))
    ends = folded(rows, key, first=first, last=last_value(F.col("mark"), F.col("event_ts")), sev=last_value(F.col("sev"), F.col("event_ts")), begun=F.count_if(opens))
    before = earlier(key)
    ends = ends.withColumn("open_in", F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(0))).withColumn("sev_in", F.last("sev", ignorenulls=True).over(before))
    ends = ends.withColumn("begun", F.col("begun") + ((F.col("first") == 1) & (F.col("open_in") == 0)).cast("int")).withColumn("begun_in", F.coalesce(F.sum(F.coalesce("begun", F.lit(0))).over(before), F.lit(0)))

    rows = rows.join(ends.select(*key, "slice_", "open_in", "sev_in", "begun_in"), [*key, "slice_"])
    rows = rows.withColumn("was_open", F.coalesce("mark_before", "open_in")).withColumn("is_open", F.coalesce("mark", "was_open"))
    starts = (F.col("is_open") == 1) & (F.col("was_open") == 0)
    rows = rows.withColumn("episode", F.col("begun_in") + F.count_if(starts).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("episode > 0")
    when = lambda c: F.when(c, F.col("event_ts"))
    rise = (F.col("sev") == "critical") & ((F.col("was_open") == 0) | (F.coalesce("sev_before", "sev_in") == "warning"))
    return rows.groupBy(*key, "episode").agg(
        F.min(when(F.col("is_open") == 1)).alias("raised_at"),
        F.min(when((F.col("is_open") == 0) & (F.col("was_open") == 1))).alias("resolved_at"),
        F.max_by("sev", when(F.col("sev").isNotNull())).alias("severity"),
        F.max(when(rise)).alias("escalated_at"),
    )


def as_alerts(found: DataFrame) -> DataFrame:
    """Episodes in the form of the alert table."""
    stamp = F.concat_ws("|", "vehicle_id", "alert_type", epoch_ms(F.col("raised_at")).cast("string"))
    return found.select(stamp.alias("alert_id"), "vehicle_id", "alert_type", "severity", "raised_at", "escalated_at", "resolved_at", F.lit(None).cast("timestamp_ntz").alias("dismissed_at"), F.lit(None).cast("string").alias("dismiss_reason"))


def dismiss(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Apply (alert_id, at, code, note, undo): the last action of an alert wins; the reason is ``code`` or ``code: note``."""
    last = actions.groupBy("alert_id").agg(F.max_by(F.struct("at", "code", "note", "undo"), "at").alias("a"))
    rows = alerts.join(last, "alert_id", "left")
    reason = F.when(F.coalesce("a.note", F.lit("")) == "", F.col("a.code")).otherwise(F.concat_ws(": ", "a.code", "a.note"))
    kept = F.col("a").isNull()
    return rows.select(*COLUMNS[:-2], F.when(kept, F.col("dismissed_at")).when(~F.col("a.undo"), F.col("a.at")).alias("dismissed_at"), F.when(kept, F.col("dismiss_reason")).when(~F.col("a.undo"), reason).alias("dismiss_reason"))


def dismissed_as(alerts: DataFrame, before: DataFrame) -> DataFrame:
    """``alerts`` with the user's dismissals of the same open episodes ``before``: they follow from no log."""
    kept = before.filter("resolved_at IS NULL AND dismissed_at IS NOT NULL").groupBy("vehicle_id", "alert_type").agg(F.max_by(F.struct("severity", "dismissed_at", "dismiss_reason"), "raised_at").alias("d"))
    rows = alerts.join(kept, ["vehicle_id", "alert_type"], "left")
    holds = F.col("d").isNotNull() & F.col("resolved_at").isNull() & ((F.col("severity") != "critical") | (F.col("d.severity") == "critical"))
    return rows.select(*COLUMNS[:-2], F.when(holds, F.col("d.dismissed_at")).otherwise(F.col("dismissed_at")).alias("dismissed_at"), F.when(holds, F.col("d.dismiss_reason")).otherwise(F.col("dismiss_reason")).alias("dismiss_reason"))


def open_list(alerts: DataFrame, roster: DataFrame, kinds: DataFrame, spec: DataFrame, latest: DataFrame, now: Column) -> DataFrame:
    """Live alerts with the facts a card shows; order by (severity = critical first, raised_at newest first)."""
    live = alerts.filter("resolved_at IS NULL AND dismissed_at IS NULL")
    rows = live.join(roster.select("vehicle_id", "reg_no"), "vehicle_id").join(F.broadcast(kinds), "alert_type")
    rows = rows.join(F.broadcast(spec.select("signal", "unit", "max_age_sec")), "signal", "left").join(latest.select("vehicle_id", "signal", F.col("event_ts").alias("reading_ts"), "value"), ["vehicle_id", "signal"], "left")
    stale = F.col("reading_ts").isNull() | (F.col("reading_ts") < plus_seconds(now, -F.col("max_age_sec")))
    age = F.floor(seconds_between(F.col("raised_at"), now)).cast("long")
    eased = F.col("escalated_at").isNotNull() & (F.col("severity") != "critical")
    return rows.select("alert_id", "vehicle_id", "reg_no", "alert_type", "severity", "raised_at", "escalated_at", "value", "unit", "reading_ts", stale.alias("is_stale"), eased.alias("eased_off"), age.alias("age_s"))
