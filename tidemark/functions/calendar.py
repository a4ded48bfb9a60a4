"""Trading calendars: sessions, night sessions, holidays, trading days.

A calendar is a handful of sessions plus a holiday list.  Session logic is a CASE expression;
what depends on other dates (next trading date, whether the night session opens) sits in one
dated dimension that is equi-joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.timekeys import CN_OFFSET, as_date, day_number, day_text

DAY_MIN = 1440
NIGHT_FROM = 20 * 60  # fixed value: sessions starting at 20:00 or later are night sessions
LOOK_AHEAD = 30  # fixed value: days searched for the next trading date
BROADCAST_DATES = 200_000


def session_minutes(text: str) -> tuple[int, int]:
    """``"21:00-02:30"`` to minutes of day; an end past midnight counts on from 1440."""
    start, end = (int(h) * 60 + int(m) for h, m in (p.strip().split(":") for p in text.split("-")))
    return start, end + DAY_MIN if end <= start else end


def session_minutes_col(text: Column) -> tuple[Column, Column]:
    """The same on a column of session texts."""
    def minutes(part: Column) -> Column:
        hm = F.split(F.trim(part), ":")
        return hm[0].cast("bigint") * 60 + hm[1].cast("bigint")

    parts = F.split(text, "-")
    start, end = minutes(parts[0]), minutes(parts[1])
    return start, F.when(end <= start, end + DAY_MIN).otherwise(end)


@dataclass(frozen=True)
class Calendar:
    id: str
    sessions: tuple[str, ...]
    holidays: frozenset[str] = field(default_factory=frozenset)
    weekends: bool = False

    @property
    def spans(self) -> list[tuple[int, int]]:
        return [session_minutes(s) for s in self.sessions]

    @property
    def early_end(self) -> int:
        """Minute of day at which the small-hours part of a night session ends, -1 without one."""
        return max([e - DAY_MIN for _, e in self.spans if e > DAY_MIN], default=-1)

    @property
    def has_night(self) -> bool:
        return any(s >= NIGHT_FROM for s, _ in self.spans)


# The futures market's session groups and the 24x7 market.
DAY_SESSIONS = ("09:00-10:15", "10:30-11:30", "13:30-15:00")
SESSIONS = {
    "cn_night_23": (*DAY_SESSIONS, "21:00-23:00"),
    "cn_night_01": (*DAY_SESSIONS, "21:00-01:00"),
    "cn_night_0230": (*DAY_SESSIONS, "21:00-02:30"),
    "cn_no_night": DAY_SESSIONS,
    "cffex_index": ("09:30-11:30", "13:00-15:00"),
    "cffex_bond": ("09:30-11:30", "13:00-15:15"),
}


def stock_calendars(holidays: frozenset[str]) -> dict[str, Calendar]:
    out = {k: Calendar(k, v, holidays) for k, v in SESSIONS.items()}
    out["crypto_24x7"] = Calendar("crypto_24x7", ("00:00-24:00",), frozenset(), weekends=True)
    return out


def date_dim(spark: SparkSession, calendars: dict[str, Calendar], first_day: int, last_day: int) -> DataFrame:
    """(calendar, date) with ``is_trading``, ``next_trading`` and ``opens_night``.

    Days are day numbers; the look-ahead is generated beyond ``last_day`` and cut again.
    """
    heads = [(c.id, c.weekends, c.has_night, sorted(c.holidays)) for c in calendars.values()]
    cals = spark.createDataFrame(heads, "calendar string, weekends boolean, has_night boolean, holidays array<string>")
    days = cals.withColumn("day", F.explode(F.sequence(F.lit(first_day), F.lit(last_day + LOOK_AHEAD + 1))))
    date = as_date("day")
    rows = days.withColumns({
        "date": date, "holiday": F.array_contains("holidays", day_text(date)),
        "open_day": F.col("weekends") | (F.weekday(date) < 5)})
    rows = rows.withColumn("is_trading", F.col("open_day") & ~F.col("holiday"))
    ahead = Window.partitionBy("calendar").orderBy("day").rowsBetween(1, LOOK_AHEAD)
    nxt = F.first(F.when(F.col("is_trading"), F.col("date")), ignorenulls=True).over(ahead)
    # the first following day that is a holiday or an ordinary open day decides about tonight
    tonight = F.first(F.when(F.col("holiday") | F.col("open_day"), ~F.col("holiday")), ignorenulls=True).over(ahead)
    return (
        rows.withColumns({"next_trading": nxt, "_tonight": F.coalesce(tonight, F.lit(True))})
        .filter(F.col("day") <= last_day)
        .select("calendar", "date", "is_trading", "next_trading",
                (F.col("has_night") & F.col("is_trading") & F.col("_tonight")).alias("opens_night")))


def checked_next(next_trading: str) -> Column:
    """The next trading date; none within the look-ahead is an error."""
    return F.coalesce(F.col(next_trading), F.raise_error(F.lit(f"no trading date within {LOOK_AHEAD} days")).cast("date"))


def _hinted(dim: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(dim) if rows <= BROADCAST_DATES else dim


def _per_calendar(calendar: Column, calendars: dict[str, Calendar], pick) -> Column:
    out = None
    for c in calendars.values():
        hit, value = calendar == c.id, pick(c)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def local_minute(ts: str) -> Column:
    return F.floor(((F.col(ts) + CN_OFFSET) % 86400) / 60).cast("bigint")


def session_part(calendar: Column, minute: Column, calendars: dict[str, Calendar]) -> Column:
    """'early' (small hours of last night's session), 'night', 'day' or NULL; both ends count."""
    def of(c: Calendar) -> Column:
        out = F.lit(None).cast("string")
        for start, end in reversed(c.spans):
            inside = (minute >= start) & (minute <= min(end, DAY_MIN))
            out = F.when(inside, "night" if start >= NIGHT_FROM else "day").otherwise(out)
            if end > DAY_MIN:
                out = F.when(minute <= end - DAY_MIN, "early").otherwise(out)
        return out
    return _per_calendar(calendar, calendars, of)


def with_calendar_day(
    df: DataFrame, ts: str, calendars: dict[str, Calendar], calendar: str = "calendar",
    first_day: int | None = None, last_day: int | None = None,
) -> DataFrame:
    """Add ``trading_day`` and ``in_session`` of a timestamp; rows without a known calendar are
    always in session and have no trading day.

    The dates run from the first to the last timestamp of ``df`` unless given.  A known calendar whose
    date isn't covered, or without a trading date within ``LOOK_AHEAD`` days, is an error."""
    if first_day is None or last_day is None:
        span = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
        first_day = (span.lo or 0) // 86400 - 2 if first_day is None else first_day
        last_day = (span.hi or 0) // 86400 + 2 if last_day is None else last_day
    cal, minute = F.col(calendar), local_minute(ts)
    today = as_date(day_number(ts, CN_OFFSET))
    early_end = _per_calendar(cal, calendars, lambda c: F.lit(c.early_end))
    early = minute <= early_end
    part = session_part(cal, minute, calendars)
    looked = F.when(early, F.date_sub(today, 1)).otherwise(today)
    dim = date_dim(df.sparkSession, calendars, first_day, last_day).select(
        F.col("calendar").alias(calendar), F.col("date").alias("_look"), "is_trading", "next_trading", "opens_night")
    size = len(calendars) * (last_day - first_day + 1)
    joined = df.withColumns({"_look": looked, "_today": today, "_part": part, "_early": early, "_min": minute}).join(
        _hinted(dim, size), [calendar, "_look"], "left")
    day = F.when(F.col("_early") | (F.col("_min") >= NIGHT_FROM), checked_next("next_trading")).otherwise(F.col("_today"))
    known = F.col(calendar).isin(*calendars)
    uncovered = F.raise_error(F.concat(F.lit("date outside the calendar's range: "), F.col("_look").cast("string")))
    session = (F.when(~F.coalesce(known, F.lit(False)), True).when(F.col("is_trading").isNull(), uncovered.cast("boolean")).when(F.col("_part").isin("early", "night"), F.col("opens_night"))
               .when(F.col("_part") == "day", F.col("is_trading")).otherwise(False))
    return joined.withColumns({
        "trading_day": F.when(known, day_text(day)), "in_session": session}).select(
        *[c for c in df.columns if c not in ("trading_day", "in_session")], "trading_day", "in_session")


def infer_calendar(hours: Column) -> Column:
    """Night-session group from the set of traded local hours."""
    def any_of(*hs: int) -> Column:
        return F.arrays_overlap(hours, F.array(*[F.lit(h).cast("bigint") for h in hs]))

    return (F.when(any_of(2), "cn_night_0230").when(any_of(0, 1), "cn_night_01")
            .when(any_of(21, 22, 23), "cn_night_23").otherwise("cn_no_night"))


def calendar_mismatches(bars: DataFrame, declared: DataFrame, ts: str = "close_ts") -> DataFrame:
    """Symbols whose traded hours contradict their declared calendar (symbol, calendar); the
    index and bond calendars have no night session to judge and are left out."""
    hours = bars.groupBy("symbol").agg(F.collect_set(F.floor(local_minute(ts) / 60).cast("bigint")).alias("hours"))
    judged = hours.join(declared.filter(~F.col("calendar").startswith("cffex")), "symbol")
    out = judged.withColumn("inferred", infer_calendar(F.col("hours")))
    night = F.array_sort(F.filter("hours", lambda h: (h >= 21) | (h <= 3)))
    return out.filter(F.col("inferred") != F.col("calendar")).select(
        "symbol", "calendar", "inferred", F.array_join(night.cast("array<string>"), ",").alias("night_hours"))
