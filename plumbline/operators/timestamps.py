"""Texts of mixed form, precision and time zone to one kind of instant: microseconds since 1970 in UTC.

Each text is rewritten once into its parts by the pattern that fits it; parts are checked as numbers, and what has no
zone is read on its source's clock. Clocks that nobody declared are estimated from the data: of all histories of zones
the one wins whose instants agree best with the times at which the rows came in.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: Fixed names of the months and of military zones.
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
MILITARY_EAST = "ABCDEFGHIKLM"
MILITARY_WEST = "NOPQRSTUVWXY"
#: Zones that an undeclared clock may keep, besides those that the feeds declare (``candidates`` joins both).
CANDIDATES = ("UTC", "Europe/London", "Europe/Amsterdam", "Europe/Athens", "America/New_York", "America/Los_Angeles", "America/Sao_Paulo", "Asia/Singapore", "Asia/Tokyo", "Asia/Kolkata", "Australia/Sydney")

_ZONE = r"(Z|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|UTC|GMT)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)? ?(AM|PM)? ?" + _ZONE
#: (kind, pattern, parts): the parts are year, month, day, hour, minute, second, fraction, half of day, zone.
_FORMS = (
    ("date", r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ]" + _CLOCK + r")?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("date", r"^(\d{4})[./](\d{1,2})[./](\d{1,2})(?:[T ]" + _CLOCK + r")?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("dealt", r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})(?:[T ]" + _CLOCK + r")?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("date", r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?()" + _ZONE + r")?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("date", r"^(?:[A-Z]{3,9},? )?(\d{1,2})[ -]([A-Z]{3})[A-Z]*\.?,?[ -](\d{4}|\d{2})(?:[T ](\d{1,2}):?(\d{2})(?::(\d{2})(?:[.,](\d+))?)? ?(AM|PM)? ?" + _ZONE + r")?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("date", r"^(\d{2})(\d{2})(\d{2})([A-Z])([A-Z]{3})(\d{2}|\d{4})$", "$6|$5|$1|$2|$3||||@$4"),
    ("ordinal", r"^(\d{4})-?(\d{3})(?:[T ]" + _CLOCK + r")?$", "$1||$2|$3|$4|$5|$6|$7|$8"),
    ("yearless", r"^(\d{1,2})[-/.](\d{1,2}) (\d{1,2}):?(\d{2})$", "|$1|$2|$3|$4||||"),
)


def tidy(text: Column) -> Column:
    """Capitals, single spaces, no outer ones, and half-days without points."""
    t = F.upper(F.trim(F.regexp_replace(text, r"[\s ]+", " ")))
    return F.when(t.endswith("M."), F.regexp_replace(t, r"([AP])\.M\.$", "$1M")).otherwise(t)


def parts(text: Column) -> Column:
    """``kind|year|month|day|hour|minute|second|fraction|half|zone`` of a tidy text; null where no pattern fits.

    Plain counts give ``count|digits|fraction``. Eight digits at the start are a date if the whole has 8, 12 or 14.
    """
    count = r"^(\d{9,11}|\d{13}|\d{16}|\d{19})(?:\.(\d+))?$"
    found = F.when(text.rlike(count), F.regexp_replace(text, count, "count|$1|$2"))
    for kind, pattern, order in _FORMS:
        found = found.when(text.rlike(pattern), F.regexp_replace(text, pattern, f"{kind}|{order}"))
    return found


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _settled(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` with new columns that later filters read instead of computing them again: none is pushed below a generator."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")
    return df.select(*keep, made).select(*keep, "_made.*")


def _micros(fraction: Column) -> Column:
    """Microseconds of the digits after the point; further digits are dropped."""
    return F.coalesce(F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("long"), F.lit(0).cast("long"))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a date, null where it is impossible."""
    safe = F.when(y.between(1, 9999) & m.between(1, 12), F.make_date(y, m, F.lit(1)))
    return F.when(safe.isNotNull() & d.between(1, F.day(F.last_day(safe))), F.unix_date(safe) + d - 1)


def _offset(zone: Column) -> Column:
    """Minutes east of UTC that a zone text names; null for none or an impossible one."""
    plain = zone.isin("Z", "UTC", "GMT")
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours = _int(F.when(F.length(digits) <= 2, digits).otherwise(F.substring(digits, 1, 2)))
    hours = F.when(F.length(digits) == 3, _int(F.substring(digits, 1, 1))).otherwise(hours)
    minutes = F.when(F.length(digits) <= 2, F.lit(0)).otherwise(_int(F.substring(digits, -2, 2)))
    signed = F.when(zone.contains("-"), -(hours * 60 + minutes)).otherwise(hours * 60 + minutes)
    letter = F.substring(zone, 2, 1)
    military = F.when(letter == "Z", 0).when(F.lit(MILITARY_EAST).contains(letter), F.instr(F.lit(MILITARY_EAST), letter) * 60).when(F.lit(MILITARY_WEST).contains(letter), F.instr(F.lit(MILITARY_WEST), letter) * -60)
    return F.when(plain, F.lit(0)).when(zone.startswith("@"), military).when((hours <= 14) & (minutes < 60), signed)


def _on_clock(wall: Column, zone: Column) -> Column:
    """Instant of a wall time on a zone's clock: the earlier of two, null in the gap that a zone skipped."""
    local = F.timestamp_micros(wall)
    there = F.to_utc_timestamp(local, zone)
    return F.when(F.from_utc_timestamp(there, zone) == local, F.unix_micros(there))


def read(rows: DataFrame, text: str, yearless: Column, order: str, arrived: str) -> DataFrame:
    """``rows`` with ``wall``, ``offset`` and ``zoneless``: microseconds on the writer's clock, minutes east of UTC if the
    text tells, and whether it has no zone. A null wall denotes no time.

    ``yearless`` tells the rows whose text may lack the year; it is then the first such time in UTC not before
    ``arrived``. ``order`` holds dmy, mdy or ymd for dates in digits alone; null reads as dmy.
    """
    o = F.coalesce(F.col(order), F.lit("dmy"))
    since = F.unix_micros(F.col(arrived).cast("timestamp"))

    # The patterns run once a text, inside a function of one array element: written out, they would exceed what can be
    # compiled. Each later step is a projection of its own, so that no expression is repeated in the next.
    df = rows.withColumn("_p", _let(tidy(F.col(text)), lambda t: F.split(parts(t), r"\|")))
    p = lambda k: F.get("_p", F.lit(k))
    df = df.withColumns({"_kind": p(0), "_a": p(1), "_b": p(2), "_c": p(3), "_half": p(8), "_z": F.coalesce(p(9), F.lit(""))})
    kind, x, y, z = (F.col(c) for c in ("_kind", "_a", "_b", "_c"))
    dealt = kind == "dealt"
    df = df.withColumns({"_year": F.when(dealt & (o == "ymd"), x).when(dealt, z).otherwise(x), "_month": F.when(dealt & (o == "dmy"), y).when(dealt & (o == "mdy"), x).otherwise(y), "_day": F.when(dealt & (o == "dmy"), x).when(dealt & (o == "mdy"), y).otherwise(z)})
    named = F.instr(F.lit(MONTHS), F.col("_month"))
    month = F.when(F.col("_month") >= "A", F.when(named % 3 == 1, ((named + 2) / 3).cast("int"))).otherwise(_int(F.col("_month")))
    df = df.withColumns({
        "_y": F.when(F.length("_year") == 2, _int(F.col("_year")) + 2000).otherwise(_int(F.col("_year"))), "_m": month, "_d": _int(F.col("_day")),
        "_h": _int(p(4)), "_mi": F.coalesce(_int(p(5)), F.lit(0)), "_s": F.coalesce(_int(p(6)), F.lit(0)), "_f": _micros(p(7)),
    })
    h, mi, sec, f, half = (F.col(c) for c in ("_h", "_mi", "_s", "_f", "_half"))
    df = df.withColumn("_hour", F.when(h.isNull(), 0).when(half.isin("AM", "PM"), F.when(h.between(1, 12), h % 12 + F.when(half == "PM", 12).otherwise(0))).otherwise(h))
    hour = F.col("_hour")
    of_day = F.when((hour.between(0, 23) | ((hour == 24) & (mi == 0) & (sec == 0) & (f == 0))) & mi.between(0, 59) & sec.between(0, 59), (hour * 3600 + mi * 60 + sec).cast("long") * 1_000_000 + f)
    year, m, d = F.col("_y"), F.col("_m"), F.col("_d")
    first = F.when(year.between(1, 9999), F.when(kind == "ordinal", F.make_date(year, F.lit(1), F.lit(1))).when(m.between(1, 12), F.make_date(year, m, F.lit(1))))
    df = df.withColumns({"_t": of_day, "_first": F.when(kind.isin("date", "dealt", "ordinal"), first)})
    start = F.col("_first")
    last = F.when(kind == "ordinal", F.dayofyear(F.add_months(start, 12) - F.expr("interval 1 day"))).otherwise(F.day(F.last_day(start)))
    days = F.when(d.between(1, last), F.unix_date(start) + d - 1)
    first_year = F.year(F.date_from_unix_date(F.floor(since / DAY).cast("int")))
    tries = F.transform(F.sequence(first_year - 1, first_year + 8), lambda n: _days(n, m, d).cast("long") * DAY + F.col("_t"))
    coming = F.get(F.filter(tries, lambda t: t >= since), F.lit(0))
    count, fraction, size = x.try_cast("long"), _micros(y), F.length(x)
    counted = F.when(size <= 11, count * 1_000_000 + fraction).when(size == 13, count * 1000 + F.floor(fraction / 1000)).when(size == 16, count).otherwise(F.floor(count / 1000))
    wall = F.when(kind == "count", counted).when(kind == "yearless", F.when(yearless & since.isNotNull(), coming)).otherwise(days.cast("long") * DAY + F.col("_t"))
    utc = kind.isin("count", "yearless")
    df = df.withColumns({"_wall": wall, "offset": F.when(utc, F.lit(0)).when(F.col("_z") != "", _offset(F.col("_z"))).cast("long"), "zoneless": ~utc & (F.col("_z") == "")})
    wall = F.when(F.col("zoneless") | F.col("offset").isNotNull(), F.col("_wall")).cast("long")
    return _settled(df, rows.columns, {"wall": wall, "offset": F.col("offset"), "zoneless": F.col("zoneless")})


def estimate_history(read_rows: DataFrame, row_id: str, source: str, arrived: str, zones: list[str], change_cost: float = 5.0, block: int = 1000) -> DataFrame:
    """(source, day, zone, violations, rows): the zone that each source's clock most likely kept on each day of arrival.

    ``read_rows`` come from ``read`` for fields whose times precede arrival. Rows that tell their zone show the delays
    that all sources' rows normally have (their first to last percentile, by field). A row of wall time violates a
    candidate zone if its delay on that clock is outside. Of all histories of zones the one with the fewest violations
    wins, where each change of zone counts as ``change_cost`` of them; ties go to the name. Rows lie in order of arrival, so
    a row without time of arrival came between the first and the last of its block of row ids, and violates a zone if no
    moment between them would do. A source without zoneless rows has no estimate.

    The candidates are a fixed few, so rows multiply by that number at most; what is left of a source for the choice is a
    row a day and zone.
    """
    since = F.unix_micros(F.col(arrived).cast("timestamp"))
    rows = read_rows.where(F.col("wall").isNotNull() & F.col(source).isNotNull()).select(F.col(row_id).alias("_id"), F.col(source).alias("source"), "field_name", "wall", "offset", "zoneless", since.alias("first"), since.alias("last"))
    seen = rows.where("last is not null")
    place = F.floor(F.col("_id") / block)
    near = seen.groupBy(place.alias("_near")).agg(F.min("first").alias("_from"), F.max("last").alias("_to"))
    lost = rows.where("last is null").join(near, place == F.col("_near")).withColumns({"first": F.col("_from"), "last": F.col("_to")}).select(*rows.columns)
    told = seen.where(~F.col("zoneless")).withColumn("lag", F.col("last") - (F.col("wall") - F.col("offset") * 60_000_000))
    usual = told.groupBy("field_name").agg(F.percentile_approx("lag", F.array(F.lit(0.01), F.lit(0.99)), 1000).alias("q")).select("field_name", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
    tried = seen.unionByName(lost).where("zoneless").withColumn("zone", F.explode(F.array(*[F.lit(z) for z in zones])))
    # ``usual`` has a row a field.
    tried = tried.withColumn("at", _on_clock(F.col("wall"), F.col("zone"))).join(F.broadcast(usual), "field_name")
    fits = (F.col("last") - F.col("at") >= F.col("low")) & (F.col("first") - F.col("at") <= F.col("high"))
    bad = F.when(fits, 0).otherwise(1)
    scored = tried.groupBy("source", F.floor(F.col("last") / DAY).alias("day"), "zone").agg(F.sum(bad).alias("bad"), F.count(F.lit(1)).alias("rows"))

    def choose(pdf):
        import pandas as pd

        by_day = pdf.pivot(index="day", columns="zone", values="bad").sort_index(axis=0).sort_index(axis=1)
        path = cheapest_history(by_day.to_numpy(dtype=float), change_cost)
        rows_of = pdf.groupby("day")["rows"].max().reindex(by_day.index)
        return pd.DataFrame({"source": pdf["source"].iloc[0], "day": by_day.index, "zone": by_day.columns.to_numpy()[path], "violations": by_day.to_numpy()[range(len(path)), path].astype("int64"), "rows": rows_of.to_numpy()})

    return scored.groupBy("source").applyInPandas(choose, "source string, day long, zone string, violations long, rows long")


def cheapest_history(bad, change_cost: float):
    """The choice (column) for each row of ``bad`` with the least sum, where each change costs ``change_cost``."""
    import numpy as np

    best = bad[0].copy()
    came = np.zeros(bad.shape, int)
    own = np.arange(bad.shape[1])
    for t in range(1, len(bad)):
        least = int(best.argmin())
        stays = best <= best[least] + change_cost
        came[t] = np.where(stays, own, least)
        best = np.where(stays, best, best[least] + change_cost) + bad[t]
    path = [int(best.argmin())]
    for t in range(len(bad) - 1, 0, -1):
        path.append(int(came[t, path[-1]]))
    return path[::-1]


def candidates(clocks: DataFrame) -> list[str]:
    """The zones that feeds declare, and some others; as many as there are zone names at most."""
    declared = {r[0] for r in clocks.where("zone is not null").select("zone").distinct().collect()}
    return sorted(declared.union(CANDIDATES))


def fields_long(rows: DataFrame, row_id: str, source: str, arrived: str, fields: list[str]) -> DataFrame:
    """One row (row_id, source, arrived, field_name, field_text) for each text that is there."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("field_text")) for f in fields])
    return rows.select(row_id, source, arrived, F.explode(pairs).alias("f")).select(row_id, source, arrived, "f.*").where(F.col("field_text").isNotNull())


def to_utc(rows: DataFrame, row_id: str, source: str, arrived: str, fields: list[str], yearless: str, clocks: DataFrame, first_year: int = 2000, last_year: int = 2035) -> DataFrame:
    """(row_id, field_name, utc_time) for every text that denotes an instant from ``first_year`` to ``last_year``.

    ``clocks`` has source, zone (null: UTC) and order, one row a source, and is broadcast: its size is that of the feeds'
    table. Zoneless times of sources that it lacks are read on the clock that ``estimate_history`` gives for the day of
    arrival; without arrival, and for a null source, they denote none.
    """
    known = F.broadcast(clocks.select(F.col("source").alias("_source"), F.coalesce("zone", F.lit("UTC")).alias("_zone"), F.col("order").alias("_order")))
    long = fields_long(rows, row_id, source, arrived, fields).join(known, F.col(source) == F.col("_source"), "left")
    declared = read(long.where(F.col("_source").isNotNull() | F.col(source).isNull()), "field_text", F.col("field_name") == yearless, "_order", arrived)
    done = declared
    # Most feeds have no undeclared source; only rows of such ones meet the estimate.
    strange = rows.where(F.col(source).isNotNull()).select(F.col(source).alias("_any")).join(known, F.col("_any") == F.col("_source"), "left_anti")
    if not strange.isEmpty():
        others = read(long.where(F.col("_source").isNull() & F.col(source).isNotNull()).drop("_zone"), "field_text", F.col("field_name") == yearless, "_order", arrived)
        told = declared.where((F.col("field_name") != yearless) & ~F.col("zoneless")).drop("_zone").unionByName(others.where(F.col("field_name") != yearless))
        guessed = estimate_history(told, row_id, source, arrived, candidates(clocks)).select(F.col("source").alias("_guess"), "day", F.col("zone").alias("_zone"))
        day = F.floor(F.unix_micros(F.col(arrived).cast("timestamp")) / DAY)
        others = others.join(guessed, (F.col(source) == F.col("_guess")) & (day == F.col("day")), "left").select(*declared.columns)
        done = declared.unionByName(others)
    zone = F.col("_zone")
    instant = F.when(F.col("zoneless"), F.when(zone == "UTC", F.col("wall")).otherwise(_on_clock(F.col("wall"), zone))).otherwise(F.col("wall") - F.col("offset").cast("long") * 60_000_000)
    since, until = (int((dt.date(y, 1, 1) - dt.date(1970, 1, 1)).days) * DAY for y in (first_year, last_year + 1))
    done = _settled(done, [row_id, "field_name"], {"us": instant}).where((F.col("us") >= since) & (F.col("us") < until))
    day = F.date_from_unix_date(F.floor(F.col("us") / DAY).cast("int"))
    second = F.floor(F.pmod(F.col("us"), F.lit(DAY)) / 1_000_000).cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(day.cast("string"), F.lit(" "), two(F.floor(second / 3600)), F.lit(":"), two(F.floor(second / 60) % 60), F.lit(":"), two(second % 60), F.lit("."), F.lpad(F.pmod(F.col("us"), F.lit(1_000_000)).cast("string"), 6, "0"))
    return done.select(row_id, "field_name", text.alias("utc_time"))
