"""Rolling invitation caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from docwarden.functions.temporal import at, hours

# Invitations per rolling 24 hours.
ORG_CAP = 20
SENDER_CAP = 10
GLOBAL_CAP = 30
CAP_HOURS = 24
# How each cap refuses.
REFUSALS = {
    "org": ("invitation_cap", "too many invitations today for this organization"),
    "sender": ("invitation_cap", "you have sent too many invitations today"),
    "global": ("invitation_cap", "invitations are limited right now; try again later"),
}


def recent(invitations: DataFrame, as_of) -> DataFrame:
    """Invitations of the 24 hours before ``as_of``, closed ones included."""
    now = at(as_of)
    return invitations.where((F.col("invited_at") > now - hours(CAP_HOURS)) & (F.col("invited_at") <= now))


def recent_counts(invitations: DataFrame, as_of, scope: str) -> DataFrame:
    return recent(invitations, as_of).groupBy(scope).agg(F.count("*").alias("recent"))


def usage(invitations: DataFrame, as_of) -> DataFrame:
    """How full each cap is: ``scope, scope_id, recent, cap, reached``."""
    parts = []
    for scope, key, cap in (("org", F.col("org_id"), ORG_CAP), ("sender", F.col("invited_by"), SENDER_CAP), ("global", F.lit("all"), GLOBAL_CAP)):
        counted = recent(invitations, as_of).groupBy(key.alias("scope_id")).agg(F.count("*").alias("recent"))
        parts.append(counted.select(F.lit(scope).alias("scope"), "scope_id", "recent", F.lit(cap).cast("long").alias("cap")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("reached", F.col("recent") >= F.col("cap"))


def rolling_counts(events: DataFrame, key: str, ts: str, span_hours: int = CAP_HOURS) -> DataFrame:
    """For every distinct ``(key, time)``: ``at_time`` events then, and ``before`` events in the
    ``span_hours`` up to, but not including, that time. The lower bound is exclusive.

    A plain range window sends all rows of one key to one task, and a global count all rows of the
    table. Here the counts are first added up per distinct time (mergeable), and the running total
    is put together from three windows whose groups are bounded by the calendar, not by the data:
    microseconds of a second, seconds of an hour, hours of a key. ``before`` is the difference of
    the running total at two times; the earlier ones enter as rows that count nothing."""
    step = hours(span_hours)

    def running(partition: list[str], order: str, value: str) -> Column:
        w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.sum(value).over(w)

    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    marks = F.array(
        F.struct(F.col(ts).alias("t"), one.alias("n")), F.struct((F.col(ts) - step).alias("t"), none.alias("n"))
    )
    timed = events.where(F.col(ts).isNotNull())
    points = timed.select(key, F.explode(marks).alias("p")).groupBy(key, F.col("p.t").alias("t")).agg(F.sum("p.n").alias("n"))
    second = _whole_seconds(points)
    points = points.withColumns({"_second": second, "_hour": F.floor(second / 3600)})

    # Each level's totals are read off the level below, already partitioned as needed.
    fine = points.withColumn("_within", running([key, "_second"], "t", "n"))
    seconds = fine.groupBy(key, "_hour", "_second").agg(F.max("_within").alias("n"))
    seconds = seconds.withColumn("_within_hour", running([key, "_hour"], "_second", "n"))
    hourly = seconds.groupBy(key, "_hour").agg(F.max("_within_hour").alias("n"))
    hourly = hourly.select(key, "_hour", (running([key], "_hour", "n") - F.col("n")).alias("_hours_before"))
    base = seconds.join(hourly, [key, "_hour"]).select(
        key, "_second", (F.col("_hours_before") + F.col("_within_hour") - F.col("n")).alias("_base")
    )
    total = fine.join(base, [key, "_second"]).select(key, "t", "n", (F.col("_base") + F.col("_within")).alias("total"))

    # The total at a time serves the events then and those a span later; meet them by time.
    unknown = F.lit(None).cast("long")
    served = F.array(
        F.struct("t", F.col("n").alias("n"), (F.col("total") - F.col("n")).alias("upto"), unknown.alias("then")),
        F.struct((F.col("t") + step).alias("t"), none.alias("n"), unknown.alias("upto"), F.col("total").alias("then")),
    )
    met = total.select(key, F.explode(served).alias("s")).groupBy(key, F.col("s.t").alias(ts)).agg(
        F.max("s.n").alias("at_time"), F.max("s.upto").alias("_upto"), F.max("s.then").alias("_then")
    )
    return met.where(F.col("at_time") > 0).select(key, ts, "at_time", (F.col("_upto") - F.col("_then")).alias("before"))


def _whole_seconds(df: DataFrame) -> Column:
    t = F.col("t")
    if isinstance(df.schema["t"].dataType, T.TimestampType):
        return F.unix_seconds(t)
    # Without a time zone, count from the calendar fields; a cast would bring one in.
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def cap_breaches(events: DataFrame, key: str, ts: str, cap: int) -> DataFrame:
    """Times at which more was recorded than the cap allowed: the n-th event of a rolling day is
    allowed while fewer than ``cap`` came before it."""
    counted = rolling_counts(events, key, ts)
    over = F.greatest(F.lit(0), F.col("before") + F.col("at_time") - cap)
    return counted.withColumn("over", F.least(F.col("at_time"), over).cast("long")).where(F.col("over") > 0)
