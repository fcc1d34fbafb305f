"""Queries of the general problems p1 to p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.identity import imo_is_valid
from plumbline.operators import areas, history, profile, proximity, spikes, timestamps
from plumbline.session import spread
from plumbline.sources.tables import table

LAT, LON, AT = "last_position_latitude", "last_position_longitude", "last_position_updateTimestamp"


def reports_once(reports: DataFrame, *columns: str) -> DataFrame:
    """One row for each report_id: re-delivered rows repeat their readings. Should they differ, the one whose readings have
    the least hash counts whole."""
    rows = reports.where(F.col("report_id").isNotNull()).select("report_id", *columns, F.xxhash64(*columns).alias("draw"))
    return rows.groupBy("report_id").agg(*[F.min_by(c, "draw").alias(c) for c in columns])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ports at most 1,500 m from each report, and reports of other vessels at most 500 m and 120 s from each other."""
    raw = table(spark, folder, "position_reports")
    reports = reports_once(raw, "mmsi", LAT, LON, AT)
    ports = table(spark, folder, "ports")
    at_port = proximity.points_in_regions(reports, "report_id", LAT, LON, ports, "port_id", "matchedPort_latitude", "matchedPort_longitude", 1500.0)
    at_port = at_port.select(F.lit("port").alias("near_kind"), F.col("point").alias("id_a"), F.col("region").alias("id_b"))
    met = proximity.near_in_space_and_time(reports, "report_id", "mmsi", LAT, LON, AT, 500.0, 120, counted=raw)
    return at_port.unionByName(met.select(F.lit("vessel").alias("near_kind"), "id_a", "id_b"))


def p1_areas(spark: SparkSession, folder: str) -> DataFrame:
    """The harbour areas that hold each report: four-sided ones, 0.1 degrees wide and high, around every port below 85
    degrees, with great circles as sides."""
    reports = reports_once(table(spark, folder, "position_reports"), LAT, LON)
    lat, lon = F.col("matchedPort_latitude"), F.col("matchedPort_longitude")
    corner = lambda i, j: F.struct((lat + 0.05 * i).alias("lat"), (lon + 0.05 * j).alias("lon"))
    ports = table(spark, folder, "ports").where(F.abs(lat) < 85).withColumn("ring", F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1)))
    return areas.points_in_polygons(reports, "report_id", LAT, LON, ports, "port_id", "ring", fine=12).select(F.col("point").alias("report_id"), F.col("area").alias("port_id"))


CALLSIGN = r"\A[A-Z0-9]{4,7}\z"


PROFILED = ["imo", "callsign", "deadweight"]


def _load_measures(spark: SparkSession, folder: str) -> DataFrame:
    """One row a load: series_id, load_no and every measure as a column named column:measure."""
    path = f"{folder}/registry_loads.parquet"
    counts = profile.value_counts(spark, path, "load_id", ["series_id", "load_no", *PROFILED]).where(F.col("load_id").isNotNull())
    name, value = F.col("column_name"), F.col("value")
    # A deadweight that is not a number is ill-formed; it is in no quantile.
    weight = F.when(name == "deadweight", value.try_cast("double"))
    good = F.when(name == "imo", imo_is_valid(value.try_cast("long"))).when(name == "callsign", value.rlike(CALLSIGN)).otherwise((weight > 0) & (weight <= 600_000))
    by_column = profile.shares(counts, "load_id", (name == "callsign") & (F.trim(value) == ""), good)
    pick = lambda c, x: F.max(F.when(name == c, x))
    of = [pick(c, F.col("least").try_cast(k)).alias(c) for c, k in (("series_id", "long"), ("load_no", "int"))]
    wide = by_column.groupBy("load_id").agg(*of, *[pick(c, F.col(m)).alias(f"{c}:{m}") for c in PROFILED for m in ("null_share", "bad_share", "distinct_share")])
    # The condition reads n, a sum, so that it stays above the aggregation, which both branches then share.
    weights = counts.where(F.when(F.isnan(F.coalesce(weight, F.lit(float("nan")))), F.lit(0)).otherwise(F.col("n")) > 0).select("load_id", weight.alias("value"), "n")
    q = profile.quantiles(weights, "load_id", {"deadweight:median": 0.5, "deadweight:p90": 0.9}).withColumnRenamed("load_id", "_load")
    return wide.join(q, F.col("load_id") == F.col("_load"), "left").drop("_load")


def _measures_long(wide: DataFrame, *keep: str) -> DataFrame:
    pairs = [c.split(":") for c in wide.columns if ":" in c]
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(m).alias("measure"), F.col(f"`{c}:{m}`").alias("value")) for c, m in pairs])
    return wide.select("load_id", *keep, F.explode(each).alias("m")).select("load_id", *keep, "m.*")


def p2_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Every measure of every load: (load_id, column_name, measure, value); null where it has no rows to stand on."""
    return _measures_long(_load_measures(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Measures in which a load differs from a load before it in its series, each once."""
    measures = _measures_long(_load_measures(spark, folder), "series_id", "load_no").where(F.col("value").isNotNull() & F.col("series_id").isNotNull() & F.col("load_no").isNotNull())
    before = F.collect_list("value").over(W.partitionBy("series_id", "column_name", "measure").orderBy("load_no").rangeBetween(-1, -1))
    now = F.col("value")
    ratio = F.col("measure").isin("median", "p90")
    case = F.exists("before", lambda old: F.when(ratio, (now < 0.8 * old) | (now > 1.25 * old)).otherwise(F.abs(now - old) > 0.11))
    return measures.withColumn("before", before).where(case).select("load_id", "column_name", "measure")


def p2_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, nulls and value range of imo, callsign and deadweight in each load."""
    return profile.facts(spark, f"{folder}/registry_loads.parquet", "load_id", PROFILED).where(F.col("load_id").isNotNull())


def p2_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, nulls, extremes and distinct values of every column of the register's loads."""
    path = f"{folder}/registry_loads.parquet"
    return profile.profile(spark, path, spark.read.parquet(path).columns)


TEXT_TIMES = ["eta", "last_position_updateTimestamp", "staticData_updateTimestamp", "UpdateDate"]


def _clocks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "feeds").select(F.col("feed_code").alias("source"), F.col("clock_zone").alias("zone"), F.col("date_order").alias("order"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every time text of the raw feed that denotes an instant from 2000 to 2035, in UTC."""
    feed = spread(table(spark, folder, "raw_feed", "raw_id", "source", "InsertDate", *TEXT_TIMES), "raw_id")
    return timestamps.to_utc(feed, "raw_id", "source", "InsertDate", TEXT_TIMES, "eta", _clocks(spark, folder))


def p3_zones(spark: SparkSession, folder: str) -> DataFrame:
    """The zones that the rows themselves suggest for each source, were none declared, beside the declared one: one row a
    source and zone."""
    feed = table(spark, folder, "raw_feed", "raw_id", "source", "InsertDate", *TEXT_TIMES[1:])
    clocks = _clocks(spark, folder)
    named = F.broadcast(clocks.select(F.col("source").alias("_source"), F.coalesce("zone", F.lit("UTC")).alias("declared_zone"), "order"))
    long = timestamps.fields_long(feed, "raw_id", "source", "InsertDate", TEXT_TIMES[1:]).join(named, F.col("source") == F.col("_source"), "left")
    read = timestamps.read(long, "field_text", F.lit(False), "order", "InsertDate").drop("_source", "declared_zone", "order")
    best = timestamps.estimate_history(read, "raw_id", "source", "InsertDate", timestamps.candidates(clocks))
    return best.select("source", "zone").distinct().join(named, F.col("source") == F.col("_source"), "left").select("source", F.col("zone").alias("best_zone"), "declared_zone")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Implausible speeds and positions of all reports."""
    return spikes.implausible(table(spark, folder, "position_reports"))


def p4_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Readings beyond the tail cutoff of their own source at a risk of 1 in 1,000."""
    return spikes.flags(table(spark, folder, "position_reports"))


def p4_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """The tail cutoff of speed residuals that the reports of each source give."""
    raw = table(spark, folder, "position_reports")
    reports, counted = spikes.reports_in_order(raw)
    series = spikes.speed_series(reports, counted, 60.0, 8, 3.0)
    found = spikes.cutoffs(series).groupBy("source").agg(F.first("cutoff").alias("cutoff"), F.count(F.lit(1)).alias("hours"))
    return spikes.named(found, raw)


def _said(c: str) -> F.Column:
    t = F.upper(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")))
    return F.when((t != "") & (t != "0"), t)


def _updates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "registry_loads", "row_id", "imo", "flag", "name", "mmsi", "InsertDate", "UpdateDate").where(imo_is_valid(F.col("imo")))


def _ledger(rows: DataFrame, most: int | None = None) -> DataFrame:
    return history.ledger(rows, "imo", "UpdateDate", "InsertDate", "row_id", ["flag", "name", "mmsi"], most=most)


def p5_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The register's bitemporal ledger: every state of knowledge about flag, name and mmsi of each valid imo."""
    return _ledger(_updates(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of flag, name and mmsi by what is known now, with the time for which each was valid."""
    rows = _updates(spark, folder)
    most = history.most_updates(rows, "imo")
    counted = rows.where(F.col("UpdateDate").isNotNull()).select(F.col("imo").alias("key"), F.unix_micros(F.col("UpdateDate").cast("timestamp")).alias("at"))
    fields = {"flag": _said("flag"), "name": _said("name"), "mmsi": F.when(F.col("mmsi") != 0, F.col("mmsi").cast("string"))}
    found = history.versions(_ledger(rows, most).where("current"), "imo", "valid_from", fields, most=most, counted=counted)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.select("imo", "field_name", "field_value", text("valid_from").alias("valid_from"), F.coalesce(text("valid_to"), F.lit("open")).alias("valid_to"))


QUERIES = {f.__name__: f for f in (p1_found, p1_areas, p2_found, p2_measures, p2_ranges, p2_profile, p3_found, p3_zones, p4_found, p4_flags, p4_cutoffs, p5_found, p5_ledger)}

_IMO_SQL = "({0} between 1000000 and 9999999 and ((({0}//1000000)%10)*7+(({0}//100000)%10)*6+(({0}//10000)%10)*5+(({0}//1000)%10)*4+(({0}//100)%10)*3+(({0}//10)%10)*2)%10={0}%10)"
_LOAD_COLUMNS = {"number": ["row_id", "load_id", "series_id", "load_no", "imo", "mmsi", "deadweight", "grossTonnage", "builtYear"], "text": ["name", "callsign", "flag", "vessel_type"], "time": ["InsertDate", "UpdateDate"]}
_SHOWN = {"number": "null::varchar", "text": "{0}", "time": "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"}

_MEASURES_SQL = f"""m as (select load_id, min(series_id) series_id, min(load_no) load_no, count(*) n,
 count(imo) i_n, count_if(imo is not null and not {_IMO_SQL.format("imo")}) i_bad, count(distinct imo) i_d,
 count(nullif(trim(callsign), '')) c_n, count_if(trim(callsign) <> '' and not regexp_full_match(callsign, '[A-Z0-9]{{4,7}}')) c_bad, count(distinct case when trim(callsign) <> '' then callsign end) c_d,
 count(deadweight) d_n, count_if(deadweight is not null and not (deadweight > 0 and deadweight <= 600000)) d_bad, count(distinct deadweight) d_d,
 quantile_cont(deadweight, 0.5) med, quantile_cont(deadweight, 0.9) p90 from registry_loads group by load_id),
l as (select load_id, series_id, load_no, unnest(['imo','imo','imo','callsign','callsign','callsign','deadweight','deadweight','deadweight','deadweight','deadweight']) column_name,
 unnest(['null_share','bad_share','distinct_share','null_share','bad_share','distinct_share','null_share','bad_share','distinct_share','median','p90']) measure,
 unnest([(n-i_n)/n, i_bad/nullif(i_n,0), i_d/nullif(i_n,0), (n-c_n)/n, c_bad/nullif(c_n,0), c_d/nullif(c_n,0), (n-d_n)/n, d_bad/nullif(d_n,0), d_d/nullif(d_n,0), med, p90]) v from m)"""

SQL: dict[str, str] = {
    "p1_found": """
with r as (select report_id, min(mmsi) mmsi, min(last_position_latitude) la, min(last_position_longitude) lo, min(last_position_updateTimestamp) ts from position_reports group by 1),
u as (select * from r where la between -90 and 90 and lo between -180 and 180 and not (la = 0 and lo = 0)),
p as (select port_id, matchedPort_latitude la, matchedPort_longitude lo from ports)
select 'port' near_kind, report_id id_a, port_id id_b from u join p on abs(u.la - p.la) < 0.02
 and 2*6371008.8*asin(least(1, sqrt(sin(radians(p.la-u.la)/2)**2 + cos(radians(u.la))*cos(radians(p.la))*sin(radians(p.lo-u.lo)/2)**2))) <= 1500
union all
select 'vessel', a.report_id, b.report_id from u a join u b on a.report_id < b.report_id and a.mmsi <> b.mmsi
 and b.ts between a.ts - interval 120 second and a.ts + interval 120 second and abs(a.la - b.la) < 0.01
 and 2*6371008.8*asin(least(1, sqrt(sin(radians(b.la-a.la)/2)**2 + cos(radians(a.la))*cos(radians(b.la))*sin(radians(b.lo-a.lo)/2)**2))) <= 500""",
    # A side between points of equal latitude bulges towards the pole: its tangent of latitude follows the cosine of longitude.
    "p1_areas": """
with r as (select report_id, min(last_position_latitude) la, min(last_position_longitude) lo from position_reports group by 1),
u as (select * from r where la between -90 and 90 and lo between -180 and 180 and not (la = 0 and lo = 0)),
p as (select port_id, matchedPort_latitude pla, matchedPort_longitude plo from ports where abs(matchedPort_latitude) < 85),
j as (select *, radians(((lo - plo + 540) % 360 + 360) % 360 - 180) d from u join p on abs(la - pla) < 0.2)
select report_id, port_id from j where abs(d) <= radians(0.05) and tan(radians(la)) between tan(radians(pla - 0.05)) * cos(d) / cos(radians(0.05)) and tan(radians(pla + 0.05)) * cos(d) / cos(radians(0.05))""",
    "p2_found": f"""
with {_MEASURES_SQL}
select a.load_id, a.column_name, a.measure from l a join l b on a.series_id = b.series_id and a.load_no = b.load_no + 1 and a.column_name = b.column_name and a.measure = b.measure
where case when a.measure in ('median','p90') then a.v < 0.8*b.v or a.v > 1.25*b.v else abs(a.v-b.v) > 0.11 end""",
    "p2_measures": f"with {_MEASURES_SQL} select load_id, column_name, measure, v as value from l",
    "p2_ranges": " union all ".join(
        f"select load_id, '{c}' column_name, count(*) n_rows, count(*) - count({c}) n_null, {f'min({c})::double' if c != 'callsign' else 'null::double'} low, {f'max({c})::double' if c != 'callsign' else 'null::double'} high, {'min(callsign)' if c == 'callsign' else 'null::varchar'} low_text, {'max(callsign)' if c == 'callsign' else 'null::varchar'} high_text from registry_loads group by 1"
        for c in PROFILED
    ),
    "p2_profile": " union all ".join(
        f"select '{c}' column_name, count(*) n_rows, count(*) - count({c}) n_null, {f'min({c})::double' if kind == 'number' else 'null::double'} low, {f'max({c})::double' if kind == 'number' else 'null::double'} high,"
        f" {_SHOWN[kind].format(f'min({c})')} low_text, {_SHOWN[kind].format(f'max({c})')} high_text, count(distinct {c}) n_distinct from registry_loads"
        for kind, columns in _LOAD_COLUMNS.items() for c in columns
    ),
    # The declared clock is what the estimate should find.
    "p3_zones": "select f.feed_code source, coalesce(f.clock_zone, 'UTC') best_zone, coalesce(f.clock_zone, 'UTC') declared_zone from feeds f where f.feed_code in (select source from raw_feed)",
    "p4_found": """
with r as (select report_id, min(mmsi) mmsi, min(last_position_latitude) la, min(last_position_longitude) lo, min(last_position_speed) v, min(last_position_updateTimestamp) ts from position_reports group by 1),
s as (select report_id, mmsi, ts, v, lag(v) over w p, lead(v) over w n, row_number() over w - row_number() over (partition by mmsi, v order by ts, report_id) g
 from r where v between 0 and 60 and ts is not null and mmsi is not null window w as (partition by mmsi order by ts, report_id)),
s2 as (select *, count(*) over (partition by mmsi, v, g) k from s),
q as (select * from r where la between -90 and 90 and lo between -180 and 180 and not (la = 0 and lo = 0) and ts is not null and mmsi is not null),
q1 as (select *, coalesce(v > 3, false) sails, lag(la) over w pla, lag(lo) over w plo, lag(ts) over w pts, lead(la) over w nla, lead(lo) over w nlo, lead(ts) over w nts,
 row_number() over w - row_number() over (partition by mmsi, la, lo, coalesce(v > 3, false) order by ts, report_id) g from q window w as (partition by mmsi order by ts, report_id)),
q2 as (select *, count(*) over (partition by mmsi, la, lo, sails, g) k,
 2*6371008.8*asin(least(1, sqrt(sin(radians(pla-la)/2)**2 + cos(radians(la))*cos(radians(pla))*sin(radians(plo-lo)/2)**2))) dp,
 2*6371008.8*asin(least(1, sqrt(sin(radians(nla-la)/2)**2 + cos(radians(la))*cos(radians(nla))*sin(radians(nlo-lo)/2)**2))) dn,
 abs(epoch_us(ts) - epoch_us(pts)) / 1e6 tp, abs(epoch_us(nts) - epoch_us(ts)) / 1e6 tn from q1)
select report_id, 'speed' reading from r where v < 0 or v > 60
union all select report_id, 'speed' from s2 where v - greatest(p, n) > 8 and p is not null and n is not null or least(p, n) - v > 8 and p is not null and n is not null or (v > 3 and k >= 8)
union all select report_id, 'position' from r where la is not null and lo is not null and not (la between -90 and 90 and lo between -180 and 180 and not (la = 0 and lo = 0))
union all select report_id, 'position' from q2 where (dp > 5000 and dn > 5000 and dp > 100*1852/3600.0*tp and dn > 100*1852/3600.0*tn) or (sails and k >= 8)""",
    "p5_ledger": f"""
with u as (select row_id, imo, UpdateDate v, coalesce(InsertDate, timestamp '0001-01-01') r, flag, name, mmsi from registry_loads where {_IMO_SQL.format("imo")} and UpdateDate is not null),
 o as (select *, row_number() over (partition by imo order by r, row_id, v) k from u),
 -- from when on is an update superseded by one of equal valid time, and when does a later valid time become known
 e as (select a.imo, a.k, min(b.k) gone from o a join o b on a.imo = b.imo and a.v = b.v and b.k > a.k group by 1, 2),
 s as (select a.*, e.gone from o a left join e using (imo, k)),
 -- moments of record at which the update's end of validity changes: its own, and each new least later valid time
 w as (select s.imo, s.k, b.k at_k, b.v next_v from s join o b on s.imo = b.imo and b.v > s.v and b.k < coalesce(s.gone, 9e18::bigint)),
 b0 as (select s.imo, s.k, max(s.k) at_k, min(w.next_v) until from s left join w on s.imo = w.imo and s.k = w.k and w.at_k < s.k group by 1, 2),
 b1 as (select w.imo, w.k, w.at_k, w.next_v until from w where w.at_k > w.k and not exists (select 1 from w x where x.imo = w.imo and x.k = w.k and x.next_v <= w.next_v and x.at_k < w.at_k)),
 p as (select * from b0 union all select * from b1),
 q as (select p.*, s.v, s.row_id, s.flag, s.name, s.mmsi, s.gone, lead(at_k) over (partition by p.imo, p.k order by at_k) next_k from p join s using (imo, k)),
 t as (select q.*, c.r since, d.r closed from q join o c on q.imo = c.imo and q.at_k = c.k left join o d on q.imo = d.imo and d.k = coalesce(q.next_k, q.gone))
select imo, v valid_from, until valid_to, case when since > timestamp '0001-01-01' then since end recorded_from, closed recorded_to, closed is null as current, row_id, flag, name, mmsi from t where closed is null or closed > since""",
    "p5_found": rf"""
with r as (select * from registry_loads where {_IMO_SQL.format("imo")} and UpdateDate is not null qualify row_number() over (partition by imo, UpdateDate order by InsertDate desc nulls last, row_id desc) = 1),
l as (select imo, UpdateDate ts, 'flag' field_name, upper(trim(regexp_replace(flag, '\s+', ' ', 'g'))) v from r union all select imo, UpdateDate, 'name', upper(trim(regexp_replace(name, '\s+', ' ', 'g'))) from r union all select imo, UpdateDate, 'mmsi', cast(mmsi as varchar) from r),
s as (select *, lag(v) over (partition by imo, field_name order by ts) p from l where v is not null and v not in ('', '0')),
c as (select * from s where p is null or p <> v)
select imo, field_name, v field_value, strftime(ts, '%Y-%m-%d %H:%M:%S') valid_from, coalesce(strftime(lead(ts) over (partition by imo, field_name order by ts), '%Y-%m-%d %H:%M:%S'), 'open') valid_to from c""",
}
