"""Quotas in cron windows: who is admitted, what is left, and when the next window begins."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def next_tick(ms: Column, window_ms: int) -> Column:
    """The first tick of ``*/n`` strictly after a time."""
    return (F.floor(ms / F.lit(window_ms)) + 1) * window_ms


#: Days of the table of days, from 1970 on: to the end of 2099.
DAYS = 47_482
_DAY_MS, _MINUTE_MS = 86_400_000, 60_000


def cron_days(spark: SparkSession, expression: str) -> DataFrame:
    """A row for each day of ``DAYS``: its number ``_day``, whether the expression has ticks on it (``_fits``), how many earlier days have (``_before``), and the next one (``_next``)."""
    f, parts = cron_fields(expression), expression.split()
    days = spark.range(DAYS).select(F.col("id").alias("_day"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int")).alias("_date"))
    earlier, later = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_day"), F.desc("_day")))
    fits = days.select("_day", _fits(F.col("_date"), f, parts).alias("_fits"))
    return fits.select("_day", "_fits", F.coalesce(F.count_if("_fits").over(earlier), F.lit(0)).alias("_before"), F.min(F.when(F.col("_fits"), F.col("_day"))).over(later).alias("_next"))


def ticked(rows: DataFrame, ms: str, window: str | int) -> DataFrame:
    """``rows`` with ``window``: the number of ticks before their time, the same for all times after one tick up to the next; ``on_tick``: whether they fall on one; and
    ``next_ms``, the first tick strictly after them.

    window: milliseconds of windows that begin at 1970, or a cron expression, whose ticks are in UTC. With an expression the rows meet a table of its days, ``DAYS`` rows that are broadcast, and
    ticks within a day are counted by the minute, so irregular ticks cost one look-up a row. Null times, and with an expression times before 1970 or after 2099, have nulls."""
    at = F.col(ms)
    if not isinstance(window, str):
        return rows.withColumns({"window": F.ceil(at / F.lit(window)), "on_tick": F.pmod(at, F.lit(window)) == 0, "next_ms": next_tick(at, window)})
    f = cron_fields(window)
    times = sorted(h * 60 + m for h in f["hour"] for m in f["minute"])
    ends = [bisect_right(times, m) for m in range(-1, 24 * 60)]  # ticks of a day up to each minute, from the one before its first
    upto = lambda minute: F.element_at(F.array(*map(F.lit, ends)), (minute + 2).cast("int"))
    own = rows.withColumn("_day", F.floor(at / _DAY_MS)).join(F.broadcast(cron_days(rows.sparkSession, window)), "_day", "left")
    past = at - F.col("_day") * _DAY_MS  # milliseconds of the day
    before, so_far = upto(F.floor((past - 1) / _MINUTE_MS)), upto(F.floor(past / _MINUTE_MS))
    tick = lambda day, nth: F.col(day) * _DAY_MS + F.element_at(F.array(*map(F.lit, times)), nth) * _MINUTE_MS
    today = F.col("_fits") & (so_far < len(times))
    return own.withColumns({
        "window": F.col("_before") * len(times) + F.when(F.col("_fits"), before).otherwise(0),
        "on_tick": F.when(F.col("_fits").isNotNull(), F.col("_fits") & (F.pmod(past, F.lit(_MINUTE_MS)) == 0) & (so_far > before)),
        "next_ms": F.when(today, tick("_day", F.least(so_far + 1, F.lit(len(times))))).otherwise(tick("_next", F.lit(1))),
    }).drop("_day", "_fits", "_before", "_next")


def with_records(rows: DataFrame, keys: list[str], ms: str, window: str | int) -> DataFrame:
    """``rows`` with ``record``: the number of the window at whose end their record lapses, or one less if it was made on a tick, and ``next_ms``.

    A record lives to the first tick strictly after it was made, that tick included. So requests up to a tick share the record of their
    window, but for one made on the tick itself, by the first request of its window, which also serves the next window. In a row of windows
    that begin on their ends, each second one is served by the one before. Only windows with a request on their tick are looked at again for that."""
    found = ticked(rows, ms, window).withColumnRenamed("window", "_window")
    ends = found.filter("on_tick").groupBy(*keys, "_window").agg(F.min(ms).alias("_tick"))
    first = found.join(ends, [*keys, "_window"]).groupBy(*keys, "_window").agg(F.min(ms).alias("_first"), F.first("_tick").alias("_tick"))
    on_end = first.filter("_first = _tick").select(*keys, "_window")
    runs = on_end.withColumn("_run", F.col("_window") - F.row_number().over(Window.partitionBy(*keys).orderBy("_window")))
    nth = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("_window"))
    served = runs.withColumn("_nth", nth).filter("_nth % 2 = 1").select(*keys, (F.col("_window") + 1).alias("_window"), F.lit(1).alias("_back"))
    return found.join(served, [*keys, "_window"], "left").withColumn("record", F.col("_window") - F.coalesce("_back", F.lit(0))).drop("_window", "_back", "on_tick")


def admitted(rows: DataFrame, keys: list[str], ms: str, order: str, cost: str, limit: float, window: str | int) -> DataFrame:
    """``left`` (before the request) and ``admitted``: the first of a record, or one that finds a balance of 1 or more.

    Only admitted requests are charged. Costs are not negative, so once the balance is under 1 it stays so."""
    w = Window.partitionBy(*keys, "record").orderBy(ms, order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    asked = F.coalesce(F.sum(cost).over(earlier), F.lit(0.0))
    found = with_records(rows, keys, ms, window).withColumn("admitted", (F.row_number().over(w) == 1) | (F.round(F.lit(limit) - asked, 6) >= 1))
    charged = F.coalesce(F.sum(F.when(F.col("admitted"), F.col(cost)).otherwise(0.0)).over(earlier), F.lit(0.0))
    return found.withColumn("left", F.lit(limit) - charged)


def balances(rows: DataFrame, keys: list[str], ms: str, order: str, cost: str, limit: float, window: str | int) -> DataFrame:
    """For each key, what its last record holds after the admitted requests, and the tick at which it lapses."""
    found = admitted(rows, keys, ms, order, cost, limit, window)
    each = found.groupBy(*keys, "record").agg(F.sum(F.when(F.col("admitted"), F.col(cost)).otherwise(0.0)).alias("used"), F.min_by("next_ms", ms).alias("reset_ms"))
    last = each.groupBy(*keys).agg(F.max_by(F.struct("used", "reset_ms"), "record").alias("last"))
    return last.select(*keys, F.round(F.lit(limit) - F.col("last.used"), 4).alias("balance"), F.col("last.reset_ms").alias("reset_ms"))


# ---------------------------------------------------------------- cron expressions

#: The fields of an expression and their ranges; day 7 of the week is day 0, Sunday.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))
#: Names of months and days.
NAMES = {n: k for k, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)} | {n: k for k, n in enumerate("sun mon tue wed thu fri sat".split())}


def _values(field: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in field.lower().split(","):
        span, _, step = part.partition("/")
        first, _, last = span.partition("-")
        number = lambda x: NAMES[x] if x in NAMES else int(x)
        a = low if first == "*" else number(first)
        b = high if first == "*" or (step and not last) else number(last or first)
        if not low <= a <= b <= high or (step and int(step) < 1):
            raise ValueError(f"not a cron field: {field}")
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def cron_fields(expression: str) -> dict[str, set[int]]:
    """The values of each field of a five-field cron expression: ``*``, numbers and names, ranges, steps and lists of these."""
    parts = expression.split()
    if len(parts) != len(FIELDS):
        raise ValueError(f"not a cron expression of five fields: {expression}")
    return {name: _values(p, low, high) for p, (name, low, high) in zip(parts, FIELDS, strict=True)}


def _fits(day: Column, f: dict[str, set[int]], parts: list[str]) -> Column:
    """Whether an expression has ticks on a day. If both days of the month and of the week are restricted, either is enough."""
    weekdays = sorted({d % 7 + 1 for d in f["weekday"]})  # Spark counts from Sunday as 1
    in_month, in_week = F.dayofmonth(day).isin(sorted(f["day"])), F.dayofweek(day).isin(weekdays)
    both = in_month & in_week if parts[2].startswith("*") or parts[4].startswith("*") else in_month | in_week
    return F.month(day).isin(sorted(f["month"])) & both


def cron_next(at: Column, expression: str) -> Column:
    """The first time of a cron expression strictly after the timestamp ``at``, in the session's time zone; null if none comes within the
    horizon (8 days where only times and days of the week are set, else 8 years, which hold every date).

    If both days of the month and of the week are restricted, either is enough."""
    f, parts = cron_fields(expression), expression.split()
    times = sorted(h * 60 + m for h in f["hour"] for m in f["minute"])
    horizon = 8 if parts[2] == parts[3] == "*" else 8 * 366
    minute = F.hour(at) * 60 + F.minute(at)
    later_today = F.array_min(F.filter(F.array(*map(F.lit, times)), lambda t: t > minute))

    fits = lambda day: _fits(day, f, parts)
    today = F.to_date(at)
    days = F.sequence(F.date_add(today, 1), F.date_add(today, horizon))
    after = F.get(F.filter(days, fits), F.lit(0))
    when = lambda day, t: F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + t * 60)
    return F.when(fits(today) & later_today.isNotNull(), when(today, later_today)).otherwise(when(after, F.lit(times[0])))
