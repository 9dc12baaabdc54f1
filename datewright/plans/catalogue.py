"""The engine's queries on the adapters, each with DuckDB SQL that says the same in other words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datewright import config as C
from datewright.functions import pattern as P
from datewright.functions import scalars as S
from datewright.functions.dateparse import parse_date
from datewright.operators import anomaly, overlay, pairing, resolve, similar, tags, timeline, transfer, views, vision
from datewright.plans import adapters as A
from datewright.plans.adapters import PATTERN, ROOT, SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


NOW = "timestamp '2001-01-01'"
#: A candidate's score: weight, less 1000 for each flag of its date, plus 25 for each other within a day.
_SCORED = f"""
agreeing as materialized (select a.ordinal, a.provider, count(*) as k from det a join det o on o.ordinal = a.ordinal and o.provider <> a.provider and abs(epoch_us(o.taken) - epoch_us(a.taken)) < 86400000000 group by 1, 2),
scored as materialized (
  select d.*, s.filesystem,
    d.weight - 1000 * (case when month(d.taken) = 1 and day(d.taken) = 1 and hour(d.taken) * 3600 + minute(d.taken) * 60 + second(d.taken) <= 60 then 1 else 0 end + case when d.taken > {NOW} then 1 else 0 end + case when epoch_us(d.taken) - epoch_us(s.filesystem) > 172800000000 then 1 else 0 end)
    + 25 * coalesce(g.k, 0) as score
  from det d left join ship s on s.ordinal = d.ordinal left join agreeing g on g.ordinal = d.ordinal and g.provider = d.provider)"""
_CHOSEN = ", chosen as (select * from (select *, row_number() over (partition by ordinal order by score desc, taken, weight desc, rank desc) as place from scored) where place = 1)"
_SHOWN = "strftime(taken, '%Y-%m-%d %H:%M:%S') as taken"


def resolved(spark: SparkSession, sf_dir: str, options: C.DetectOptions | None = None) -> DataFrame:
    return resolve.resolve(A.detections_orders(spark, sf_dir), C.NOW, options)


@query("resolve_smart", f"with {SQL['det']}, {_SCORED}{_CHOSEN} select ordinal, provider, {_SHOWN} from chosen")
def _(spark, sf_dir):
    return resolved(spark, sf_dir).select("ordinal", "provider", day("taken").alias("taken"))


@query("resolve_oldest", f"with {SQL['det']} select ordinal, provider, {_SHOWN} from (select *, row_number() over (partition by ordinal order by taken, rank) as place from det) where place = 1")
def _(spark, sf_dir):
    return resolved(spark, sf_dir, C.DetectOptions("oldest")).select("ordinal", "provider", day("taken").alias("taken"))


@query("resolve_priority", f"with {SQL['det']} select ordinal, provider, {_SHOWN} from (select *, row_number() over (partition by ordinal order by list_position(['takeout', 'xmp', 'filesystem', 'exif'], provider)) as place from det where provider <> 'media') where place = 1")
def _(spark, sf_dir):
    return resolved(spark, sf_dir, C.DetectOptions("priority", ("takeout", "xmp", "filesystem", "exif"))).select("ordinal", "provider", day("taken").alias("taken"))


@query("resolve_custom_weights", f"with {SQL['det'].replace('4, 38,', '4, 100,').replace('6, 10,', '6, 0,')}, {_SCORED}{_CHOSEN} select ordinal, provider, {_SHOWN} from chosen")
def _(spark, sf_dir):
    return resolved(spark, sf_dir, C.DetectOptions("smart", weights={"takeout": 5000, "filesystem": -20})).select("ordinal", "provider", day("taken").alias("taken"))


@query("candidate_scores", f"with {SQL['det']}, {_SCORED} select ordinal, provider, cast(score as bigint) as score from scored")
def _(spark, sf_dir):
    d = A.detections_orders(spark, sf_dir)
    return d.select("ordinal", F.explode(F.transform("candidates", lambda c: F.struct(c["provider"].alias("provider"), resolve.score(c, F.col("candidates"), F.col("filesystem"), C.NOW, C.DetectOptions()).cast("bigint").alias("score")))).alias("s")).select("ordinal", "s.*")


_ROWS = f"""
rows_ as (select o.o_orderkey as ordinal, o.o_orderdate as taken, s.filesystem, (select min(taken) from det d where d.ordinal = o.o_orderkey) as first_, (select max(taken) from det d where d.ordinal = o.o_orderkey) as last_ from orders o left join ship s on s.ordinal = o.o_orderkey),
flagged as (select *, month(taken) = 1 and day(taken) = 1 as camera_epoch, taken > {NOW} as future_date, coalesce(epoch_us(taken) - epoch_us(filesystem) > 172800000000, false) as taken_after_file_write, (epoch_us(last_) - epoch_us(first_)) // 86400000000 as days from rows_)"""


def exif_flags(spark, sf_dir):
    d = A.detections_orders(spark, sf_dir).withColumn("taken", F.get(F.filter("candidates", lambda c: c["provider"] == "exif"), F.lit(0))["taken"])
    return d.withColumn("flags", resolve.entry_flags(F.col("taken"), F.col("candidates"), F.col("filesystem"), C.NOW))


@query("date_flags", f"with {SQL['det']}, {_ROWS} select ordinal, camera_epoch, future_date, taken_after_file_write from flagged")
def _(spark, sf_dir):
    has = lambda n: F.exists("flags", lambda f: f["flag"] == n).alias(n)
    return exif_flags(spark, sf_dir).select("ordinal", *[has(n) for n in ("camera_epoch", "future_date", "taken_after_file_write")])


@query("provider_spread", f"with {SQL['det']}, {_ROWS} select ordinal, days from flagged where days > 180")
def _(spark, sf_dir):
    return exif_flags(spark, sf_dir).select("ordinal", F.get(F.filter("flags", lambda f: f["flag"] == "provider_spread"), F.lit(0))["days"].alias("days")).filter("days is not null")


@query(
    "timezone_shift",
    f"""with {SQL['det']}, moved as (select o_orderkey as ordinal, o_orderdate as taken, o_orderdate + to_hours(cast(o_orderkey % 17 as integer)) + to_minutes(case when o_orderkey % 5 = 0 then 30 else 0 end) as other from orders)
select ordinal, cast(abs(epoch_us(other) - epoch_us(taken)) // 3600000000 as bigint) as hours from moved where abs(epoch_us(other) - epoch_us(taken)) % 3600000000 = 0 and abs(epoch_us(other) - epoch_us(taken)) // 3600000000 between 1 and 14""",
)
def _(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_orderdate").alias("taken"))
    other = (F.col("taken") + F.make_dt_interval(hours=(F.col("ordinal") % 17).cast("int"), mins=F.when(F.col("ordinal") % 5 == 0, 30).otherwise(0))).cast("timestamp_ntz")
    none = F.lit(None).cast("string")
    found = resolve.candidates({"exif": (F.col("taken"), none), "xmp": (other, none), "filesystem": (other, none)})
    return o.withColumn("candidates", found).select("ordinal", resolve.timezone_hours(F.col("taken"), F.col("candidates")).alias("hours")).filter("hours is not null")


@query(
    "confidence",
    f"""with {SQL['det']}, {_SCORED}{_CHOSEN},
near as (select a.ordinal, bool_or(abs(epoch_us(a.taken) - epoch_us(b.taken)) < 86400000000) as corroborated from det a join det b on a.ordinal = b.ordinal and a.rank < b.rank group by 1),
spread as (select ordinal, (epoch_us(max(taken)) - epoch_us(min(taken))) // 86400000000 > 180 as soft from det group by 1)
select c.ordinal, case when (month(taken) = 1 and day(taken) = 1) or taken > {NOW} or coalesce(epoch_us(taken) - epoch_us(filesystem) > 172800000000, false) then 'low' when not soft and coalesce(corroborated, false) then 'high' else 'medium' end as confidence
from chosen c left join near n on n.ordinal = c.ordinal join spread s on s.ordinal = c.ordinal""",
)
def _(spark, sf_dir):
    return resolved(spark, sf_dir).select("ordinal", "confidence")


@query("flag_descriptions", f"with {SQL['det']}, {_ROWS} select ordinal, 'sources disagree by ' || days || ' days' as description from flagged where days > 180 union all select ordinal, 'lies in the future' from flagged where future_date union all select ordinal, 'sits on a camera factory-reset date' from flagged where camera_epoch union all select ordinal, 'is later than the file was written' from flagged where taken_after_file_write")
def _(spark, sf_dir):
    return exif_flags(spark, sf_dir).select("ordinal", F.explode("flags").alias("f")).select("ordinal", resolve.describe(F.col("f")).alias("description"))


@query("parse_names", "select event_id as ordinal, strftime(case event_id % 6 when 0 then date_trunc('second', ts) when 1 then date_trunc('second', ts) when 3 then date_trunc('second', ts) when 5 then null else date_trunc('day', ts) end, '%Y-%m-%d %H:%M:%S') as taken from events")
def _(spark, sf_dir):
    names = A.names_events(spark, sf_dir)
    return names.select("ordinal", F.date_format(parse_date(F.col("text")), "yyyy-MM-dd HH:mm:ss").alias("taken"))


@query("destination_year_month", f"with {SQL['files']} select ordinal, '/archive/' || strftime(taken, '%Y/%m') || '/' || regexp_extract(source, '[^/]*$') as destination from files")
def _(spark, sf_dir):
    return A.files_orders(spark, sf_dir).select("ordinal", P.destination(F.col("source"), F.col("taken"), ROOT, PATTERN).alias("destination"))


@query("destination_custom", f"with {SQL['files']} select ordinal, '/archive/' || strftime(taken, '%Y/%b-%j/%d %H_%M_%S %a') || '/w' || strftime(taken, '%V-%G') || '/' || strftime(taken, '%-d.%-m.') || 'unsorted' || '/' || regexp_extract(source, '[^/]*$') as destination from files")
def _(spark, sf_dir):
    return A.files_orders(spark, sf_dir).select("ordinal", P.destination(F.col("source"), F.col("taken"), ROOT, "%Y/%b-%j//%d %H_%M_%S %a/w%V-%G/%-d.%-m.{subject}").alias("destination"))


@query("folder_segment", "select p_partkey, coalesce(nullif(left(trim(regexp_replace(trim(regexp_replace(lower(p_name || ' & co. -' || p_type), '[^\\p{L}\\p{N}-]', ' ', 'g')), ' +', '-', 'g'), '-.'), 48), ''), 'unsorted') as segment from part")
def _(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    return p.select("p_partkey", S.folder_segment(F.concat("p_name", F.lit(" & co. -"), "p_type")).alias("segment"))


@query("duplicate_variant", f"with {SQL['files']} select ordinal, regexp_replace(source, '\\.jpg$', '') || '_dup_' || (ordinal % 4 + 1) || '.jpg' as path from files")
def _(spark, sf_dir):
    return A.files_orders(spark, sf_dir).select("ordinal", S.duplicate_variant(F.col("source"), F.col("ordinal") % 4 + 1).alias("path"))


@query("camera_counters", f"with {SQL['files']} select ordinal, cast(regexp_extract(source, '([0-9]+)\\.jpg$', 1) as bigint) as counter, '/IMG_' || lpad(cast(ordinal as varchar), greatest(6, length(cast(ordinal as varchar)))::int, '0') as stem from files")
def _(spark, sf_dir):
    return A.files_orders(spark, sf_dir).select("ordinal", S.counter(F.col("source")).cast("bigint").alias("counter"), F.concat(F.lit("/"), S.stem(F.col("source"))).alias("stem"))


# Anomalies


@query("identical_clusters", "select * from (select o_orderkey as ordinal, count(*) over (partition by o_orderpriority, o_orderdate) as files from orders) where files >= 5")
def _(spark, sf_dir):
    return anomaly.identical_clusters(A.files_orders(spark, sf_dir, "priority")).filter("cluster_files is not null").select("ordinal", F.col("cluster_files").alias("files"))


_MEDIAN = """ranked as (select *, count(*) over (partition by folder) as n, row_number() over (partition by folder order by taken, ordinal) as place from files),
median as (select folder, n, taken as median from ranked where place = n // 2 + 1)"""


@query("neighbour_outliers", f"with {SQL['files']}, {_MEDIAN} select f.ordinal, cast((abs(epoch_us(f.taken) - epoch_us(median)) // 86400000000) // 365 as bigint) as years from files f join median m on m.folder = f.folder where n >= 5 and abs(epoch_us(f.taken) - epoch_us(median)) // 86400000000 >= 730 and abs(epoch_us(filesystem) - epoch_us(median)) // 86400000000 < 730")
def _(spark, sf_dir):
    return anomaly.far_from_neighbours(A.files_orders(spark, sf_dir)).filter("far_years is not null").select("ordinal", F.col("far_years").alias("years"))


_SEQUENCE = "seq as (select ordinal, count(*) over (partition by folder) as n, row_number() over (partition by folder order by counter, ordinal) as a, row_number() over (partition by folder order by taken, counter, ordinal) as b from files where counter >= 0)"


@query("sequence_outliers", f"with {SQL['files']}, {_SEQUENCE} select ordinal from seq where n >= 5 and abs(a - b) > n // 2")
def _(spark, sf_dir):
    return anomaly.sequence_outliers(A.files_orders(spark, sf_dir)).filter("sequence_outlier").select("ordinal")


@query(
    "clock_reset_runs",
    f"""with {SQL['reset']},
gaps as (select *, min(taken) over (partition by folder) as first_, coalesce((epoch_us(taken) - epoch_us(lag(taken) over (partition by folder order by taken, ordinal))) // 86400000000 > 30, false) as cut from files),
runs as (select *, sum(case when cut then 1 else 0 end) over (partition by folder order by taken, ordinal) as run from gaps),
head as (select *, count(*) over (partition by folder) as n, max(taken) over (partition by folder) as last_, row_number() over (partition by folder order by filesystem, ordinal) as place from runs where run = 0),
good as (select folder, n, first_ from head where place = n // 2 + 1 and n >= 2 and month(first_) = 1 and day(first_) = 1 and (epoch_us(filesystem) - epoch_us(last_)) // 86400000000 > 180)
select h.ordinal, g.n as files, strftime(g.first_, '%Y-%m-%d %H:%M:%S') as anchor from head h join good g on g.folder = h.folder""",
)
def _(spark, sf_dir):
    return anomaly.clock_reset_runs(A.files_reset(spark, sf_dir)).filter("reset_files is not null").select("ordinal", F.col("reset_files").alias("files"), day("reset_anchor").alias("anchor"))


def _plan(spark, sf_dir):
    files = A.files_orders(spark, sf_dir)
    plan = files.withColumn("destination", P.destination(F.col("source"), F.col("taken"), ROOT, PATTERN)).withColumn("flags", resolve.date_flags(F.col("taken"), F.col("filesystem"), C.NOW))
    return anomaly.annotate(plan)


_PLAN = f"""{SQL['files']}, {_MEDIAN}, {_SEQUENCE},
kinds as (
  select f.*, case when month(taken) = 1 and day(taken) = 1 then 'camera_epoch' when taken > {NOW} then 'future_date' when epoch_us(taken) - epoch_us(filesystem) > 172800000000 then 'taken_after_file_write'
    when (select count(*) from files g where g.folder = f.folder and g.taken = f.taken) >= 5 then 'identical_timestamp_cluster' when r.ordinal is not null then 'clock_reset_run'
    when m.n >= 5 and abs(epoch_us(f.taken) - epoch_us(median)) // 86400000000 >= 730 and abs(epoch_us(filesystem) - epoch_us(median)) // 86400000000 < 730 then 'far_from_neighbours'
    when s.n >= 5 and abs(s.a - s.b) > s.n // 2 then 'sequence_outlier' end as kind
  from files f join median m on m.folder = f.folder join seq s on s.ordinal = f.ordinal left join reset r on r.ordinal = f.ordinal)"""
_RESET = """
gaps as (select *, min(taken) over (partition by folder) as first_, coalesce((epoch_us(taken) - epoch_us(lag(taken) over (partition by folder order by taken, ordinal))) // 86400000000 > 30, false) as cut from files),
runs as (select *, sum(case when cut then 1 else 0 end) over (partition by folder order by taken, ordinal) as run from gaps),
head as (select *, count(*) over (partition by folder) as n, count(filesystem) over (partition by folder) as w, max(taken) over (partition by folder) as last_, row_number() over (partition by folder order by filesystem nulls last, ordinal) as place from runs where run = 0),
good as (select folder from head where place = w // 2 + 1 and w > 0 and n >= 2 and month(first_) = 1 and day(first_) = 1 and (epoch_us(filesystem) - epoch_us(last_)) // 86400000000 > 180),
reset as (select h.ordinal from head h join good g on g.folder = h.folder),"""
_PLAN = _PLAN.replace(f"{_SEQUENCE},", f"{_SEQUENCE},{_RESET}", 1)


@query("suspect_only", f"with {_PLAN} select ordinal, kind from kinds where kind is not null")
def _(spark, sf_dir):
    return anomaly.suspects(_plan(spark, sf_dir)).select("ordinal", F.get(F.filter("flags", lambda f: resolve.severity(f["flag"]) == "hard"), F.lit(0))["flag"].alias("kind"))


@query("suspect_groups", f"with {_PLAN} select folder || '::' || kind as key, count(*) as files, strftime(min(taken), '%Y-%m-%d') as earliest, strftime(max(taken), '%Y-%m-%d') as latest, array_to_string(list_sort(list_distinct(list(strftime(taken, '%Y/%m'))))[1:24], ',') as folders from kinds where kind is not null group by folder, kind")
def _(spark, sf_dir):
    g = anomaly.suspect_groups(_plan(spark, sf_dir), ROOT)
    return g.select("key", "files", F.date_format("earliest", "yyyy-MM-dd").alias("earliest"), F.date_format("latest", "yyyy-MM-dd").alias("latest"), F.array_join("destination_folders", ",").alias("folders"))


@query("suspect_members", f"with {_PLAN} select folder || '::' || kind as key, source from kinds where kind is not null")
def _(spark, sf_dir):
    return anomaly.suspect_members(_plan(spark, sf_dir)).select("key", "source")


# Pairing and overlays

_COMPANIONS = """c as (select l_orderkey * 10 + l_linenumber as ordinal, l_orderkey as stem, (['jpg', 'mov', 'xmp', 'mp3', 'dat', 'cr2', 'json'])[l_linenumber % 7 + 1] as ext, (['exif', 'xmp', 'filesystem'])[l_linenumber % 3 + 1] as provider, min(l_shipdate) as taken from lineitem group by l_orderkey, l_linenumber),
k as (select *, 'f' || stem || '.' || ext as name, case when ext in ('jpg', 'cr2') then 4 when ext = 'mov' then 3 when ext = 'mp3' then 2 when ext in ('xmp', 'json') then 1 else 0 end as kind, case provider when 'xmp' then 42 when 'exif' then 40 else 10 end as weight from c),
r as (select *, count(*) over (partition by stem) as n, row_number() over (partition by stem order by kind desc, weight desc, name) as place from k),
m as (select * from r where place = 1)"""


@query("companion_pairs", f"with {_COMPANIONS} select r.ordinal, strftime(case when ch then m.taken else r.taken end, '%Y-%m-%d') as taken, case when ch then m.provider else r.provider end as provider, case when ch then 'beside F' || m.stem || '.' || m.ext else 'own ' || r.ext end as info from (select r.*, r.n >= 2 and m.kind > 1 and r.place > 1 and m.taken <> r.taken as ch from r join m on m.stem = r.stem) r join m on m.stem = r.stem")
def _(spark, sf_dir):
    return pairing.pair(A.companions_lineitem(spark, sf_dir), ROOT, PATTERN).select("ordinal", F.date_format("taken", "yyyy-MM-dd").alias("taken"), "provider", F.col("provider_info").alias("info"))


def _dated(spark, sf_dir):
    files = A.files_orders(spark, sf_dir)
    return files.withColumn("destination", P.destination(F.col("source"), F.col("taken"), ROOT, PATTERN))


_DATED = f"{SQL['files']}, dated as (select *, '/archive/' || strftime(taken, '%Y/%m') || '/' || regexp_extract(source, '[^/]*$') as destination from files)"


@query("apply_date_overrides", f"with {_DATED} select ordinal, case when ordinal % 10 = 0 then '/archive/1999/12/' || regexp_extract(source, '[^/]*$') else destination end as destination, case when ordinal % 10 = 0 then 'manual' end as origin from dated")
def _(spark, sf_dir):
    plan = _dated(spark, sf_dir)
    o = plan.filter("ordinal % 10 = 0").select("source", F.lit("1999-12-31 10:00:00").cast("timestamp_ntz").alias("taken"), F.lit("manual").alias("origin"))
    return overlay.apply_dates(plan, o, ROOT, PATTERN).select("ordinal", "destination", F.col("override_origin").alias("origin"))


@query("shift_dates", f"with {SQL['files']} select ordinal, strftime(taken - to_seconds(90061), '%Y-%m-%d %H:%M:%S') as taken from files")
def _(spark, sf_dir):
    plan = A.files_orders(spark, sf_dir)
    return overlay.apply_dates(plan, overlay.shifted(plan, -90061), ROOT, PATTERN).select("ordinal", day("taken").alias("taken"))


@query("reprovider", f"with {SQL['det']} select ordinal, strftime(taken, '%Y-%m-%d') as taken from det where provider = 'takeout'")
def _(spark, sf_dir):
    plan = A.detections_orders(spark, sf_dir)
    o = overlay.reprovided(plan, "takeout")
    return plan.select("ordinal", "source").join(o, "source").select("ordinal", F.date_format("taken", "yyyy-MM-dd").alias("taken"))


_TURNS = "(['none', 'flip_h', 'rot180', 'flip_v', 'transpose', 'rot90', 'transverse', 'rot270'])"
_TURNED = "(['rot90', 'transverse', 'rot270', 'transpose', 'flip_h', 'rot180', 'flip_v', 'none'])"


@query("apply_rotations", f"select o_orderkey as ordinal, case when o_orderkey % 3 = 0 then {_TURNED}[o_orderkey % 8 + 1] else {_TURNS}[o_orderkey % 8 + 1] end as rotate from orders")
def _(spark, sf_dir):
    plan = A.files_orders(spark, sf_dir).withColumn("rotate", S.for_orientation((F.col("ordinal") % 8 + 1).cast("int"))).withColumn("reencode", F.lit(False))
    return overlay.apply_rotations(plan, overlay.turned(plan.filter("ordinal % 3 = 0"), 1)).select("ordinal", "rotate")


@query("exclude_sources", f"with {SQL['files']} select ordinal, source from files where ordinal % 4 <> 0")
def _(spark, sf_dir):
    plan = A.files_orders(spark, sf_dir)
    return overlay.exclude(plan, plan.filter("ordinal % 4 = 0")).select("ordinal", "source")


@query("retarget", f"with {SQL['files']} select ordinal, '/new/' || strftime(taken, '%Y') || '/c-' || (ordinal % 7) || '/' || regexp_extract(source, '[^/]*$') as destination from files")
def _(spark, sf_dir):
    plan = A.files_orders(spark, sf_dir).withColumn("subject", F.concat(F.lit(" C "), (F.col("ordinal") % 7).cast("string"), F.lit("! ")))
    return overlay.retarget(plan, "/new/", "%Y/{subject}").select("ordinal", "destination")


@query("shift_labels", "select event_id as ordinal, case when s < 0 then '-' else '+' end || abs(s) // 86400 || 'd ' || (abs(s) // 3600) % 24 || 'h ' || (abs(s) // 60) % 60 || 'm' as label from (select event_id, event_id * 977 - 3000000 as s from events)")
def _(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("ordinal"), S.humanise_shift(F.col("event_id") * 977 - 3000000).alias("label"))


# Journal, names, verification

_STATUS = "(['copied', 'duplicate', 'already_present', 'failed'])"
_JOURNAL = f"j as (select '/o' || l_orderkey as source, l_orderkey as ordinal, l_linenumber::bigint * 1000000000 + l_partkey * 1000 + l_suppkey as line_no, {_STATUS}[l_partkey % 4 + 1] as status, case when l_suppkey % 3 = 0 then l_partkey end as written from lineitem), last_ as (select source, ordinal, arg_max(status, line_no) as status, arg_max({{'w': written}}, line_no).w as written from j group by 1, 2)"


def _journal(spark, sf_dir):
    line = A.table(spark, sf_dir, "lineitem")
    status = F.element_at(F.array(*[F.lit(s) for s in C.OUTCOMES]), (F.col("l_partkey") % 4 + 1).cast("int"))
    return line.select(
        F.concat(F.lit("/o"), F.col("l_orderkey").cast("string")).alias("source"), (F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("line_no"), status.alias("status"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_partkey")).alias("written")
    )


@query("journal_latest", f"with {_JOURNAL} select source, status from last_")
def _(spark, sf_dir):
    return transfer.latest(_journal(spark, sf_dir)).select("source", "status")


@query("written_latest", f"with {_JOURNAL} select source, written from last_ where written is not null")
def _(spark, sf_dir):
    return transfer.written(_journal(spark, sf_dir)).select("source", "written")


@query("copy_counters", f"with {_JOURNAL} select count(*) filter (status = 'copied') as copied, count(*) filter (status = 'duplicate') as duplicate, count(*) filter (status = 'already_present') as already_present, count(*) filter (status = 'failed') as failed, count(*) filter (written is not null) as turned, sum(case when status in ('copied', 'duplicate') then coalesce(written, 1) else 0 end)::bigint as bytes from last_")
def _(spark, sf_dir):
    o = transfer.latest(_journal(spark, sf_dir)).withColumn("turned", F.col("written").isNotNull()).withColumn("size", F.coalesce("written", F.lit(1)))
    return transfer.copy_counters(o)


@query("pending_after_journal", "select o_orderkey as ordinal from orders where o_orderkey not in (select l_orderkey from lineitem)")
def _(spark, sf_dir):
    plan = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("/o"), F.col("o_orderkey").cast("string")).alias("source"))
    return transfer.pending(plan, _journal(spark, sf_dir)).select("ordinal")


@query("resume_scan", f"with {SQL['files']} select ordinal from files where ordinal % 3 <> 0 and ordinal % 5 <> 0")
def _(spark, sf_dir):
    files = A.files_orders(spark, sf_dir)
    return transfer.resume(files, files.filter("ordinal % 3 = 0"), files.filter("ordinal % 5 = 0")).select("ordinal")


_ALLOCATED = f"""{SQL['dups']},
first_ as (select destination, size, hash, min(source) as first_ from dups group by 1, 2, 3),
named as (select *, row_number() over (partition by destination order by first_) - 1 as variant from first_),
placed as (select d.source, d.doc_id, d.size, d.hash, d.destination, n.variant, case when d.source <> n.first_ then 'already_present' when variant > 0 then 'duplicate' else 'copied' end as outcome, case when variant = 0 then d.destination else regexp_replace(d.destination, '\\.txt$', '') || '_dup_' || variant || '.txt' end as path from dups d join named n using (destination, size, hash))"""


@query("name_allocation", f"with {_ALLOCATED} select doc_id, outcome, path from placed")
def _(spark, sf_dir):
    return transfer.allocate(A.dups_documents(spark, sf_dir)).select("doc_id", "outcome", "path")


@query(
    "name_allocation_existing",
    f"""with {SQL['dups']}, there as (select destination, case when n <= 6 then n - 1 else 2 * n - 6 end as variant, size, hash from (select *, row_number() over (partition by destination order by source) as n from dups where doc_id % 9 = 0)),
first_ as (select destination, size, hash, min(source) as first_ from dups group by 1, 2, 3),
held as (select destination, size, hash, min(variant) as there from there where variant <= 5 group by 1, 2, 3),
new_ as (select f.*, row_number() over (partition by destination order by first_) as place from first_ f where not exists (select 1 from held h where h.destination = f.destination and h.size = f.size and h.hash = f.hash)),
room as (select destination, count(*) + 2 * count(*) filter (doc_id % 9 = 0) as n from dups group by 1),
slots as (select destination, unnest(range(0, n + 1)) as v from room),
free as (select destination, v, row_number() over (partition by destination order by v) as place from slots s where not exists (select 1 from there t where t.destination = s.destination and t.variant = s.v)),
named as (select n.destination, size, hash, first_, v as variant from new_ n join free using (destination, place) union all select destination, size, hash, null, there from held)
select doc_id, variant, case when first_ is null or d.source <> first_ then 'already_present' when variant > 0 then 'duplicate' else 'copied' end as outcome from dups d join named n using (destination, size, hash)""",
)
def _(spark, sf_dir):
    """What is there has six names without a gap, then every other one."""
    d = A.dups_documents(spark, sf_dir)
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("destination").orderBy("source"))
    there = d.filter("doc_id % 9 = 0").withColumn("n", n).withColumn("variant", F.when(F.col("n") <= 6, F.col("n") - 1).otherwise(2 * F.col("n") - 6)).select("destination", "variant", "size", "hash")
    return transfer.allocate(d, there).select("doc_id", F.col("variant").cast("bigint").alias("variant"), "outcome")


def _copied(spark, sf_dir):
    """A plan, and what is at its destinations: every allocated file, but for some that are missing and some that were changed."""
    plan = transfer.allocate(A.dups_documents(spark, sf_dir))
    there = plan.filter("outcome <> 'already_present' and doc_id % 13 <> 0").select("destination", F.col("variant").cast("bigint").alias("variant"), F.when(F.col("doc_id") % 17 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "hash")
    sources = plan.filter("doc_id % 19 <> 0").select("source", "size", "hash")
    return plan.select("source", "destination", "size", "doc_id"), sources, there


_VERIFY = f"""{_ALLOCATED},
there as (select destination, variant, case when doc_id % 17 = 0 then size + 1 else size end as size, hash from placed where outcome <> 'already_present' and doc_id % 13 <> 0),
probe as (select * from (select *, row_number() over (partition by destination, variant > 0 order by variant) as n from there) where variant = 0 or variant = n),
checked as (select p.doc_id, p.source, p.destination, p.size as source_size,
  case when p.doc_id % 19 = 0 then 'source_missing' when exists (select 1 from probe t where t.destination = p.destination and t.size = p.size and t.hash = p.hash) then 'ok' when exists (select 1 from probe t where t.destination = p.destination) then 'content_mismatch' else 'destination_missing' end as status,
  case when p.doc_id % 19 <> 0 then (select t.size from probe t where t.destination = p.destination and t.variant = 0) end as destination_size from placed p)"""


@query("verify_issues", f"with {_VERIFY} select source, status as kind, source_size, destination_size from checked where status <> 'ok'")
def _(spark, sf_dir):
    plan, sources, there = _copied(spark, sf_dir)
    return transfer.issues(transfer.verify(plan, sources, there)).select("source", "kind", "source_size", "destination_size")


@query("verify_report", f"with {_VERIFY}, seen as (select * from probe where destination in (select destination from checked where status <> 'source_missing')) select count(*) filter (status = 'ok') as ok, count(*) filter (status = 'source_missing') as source_missing, count(*) filter (status = 'destination_missing') as destination_missing, count(*) filter (status = 'content_mismatch') as content_mismatch, (sum(source_size) filter (status <> 'source_missing'))::bigint as source_bytes, (select sum(size)::bigint from seen) as destination_bytes, (select count(*) from seen where variant > 0) as duplicate_files, (select coalesce(sum(size), 0)::bigint from seen where variant > 0) as duplicate_bytes from checked")
def _(spark, sf_dir):
    plan, sources, there = _copied(spark, sf_dir)
    return transfer.verify_report(transfer.verify(plan, sources, there), there)


@query("contiguous_variants", f"with {_VERIFY} select destination, variant from probe")
def _(spark, sf_dir):
    return transfer.contiguous(_copied(spark, sf_dir)[2]).select("destination", "variant")


# Duplicates and bursts


@query("exact_duplicates", f"with {SQL['dups']} select size as bytes, count(*) as files, (size * (count(*) - 1))::bigint as wasted, string_agg(source, ',' order by source) as sources from dups where size > 0 group by size, hash having count(*) > 1")
def _(spark, sf_dir):
    files = A.dups_documents(spark, sf_dir)
    return similar.exact_duplicates(files).withColumn("sources", F.array_join("sources", ","))


@query("duplicate_totals", f"with {SQL['dups']}, g as (select size, count(*) as n from dups where size > 0 group by size, hash having count(*) > 1) select count(*) as n_groups, sum(n)::bigint as files, sum(size * (n - 1))::bigint as wasted from g")
def _(spark, sf_dir):
    return similar.duplicate_totals(similar.exact_duplicates(A.dups_documents(spark, sf_dir)))


@query("same_size_files", f"with {SQL['dups']} select source from dups where size > 0 and size in (select size from dups group by size having count(*) > 1)")
def _(spark, sf_dir):
    return similar.same_size(A.dups_documents(spark, sf_dir)).select("source")


_BURSTS = f"""{SQL['events']},
cut as (select *, case when epoch_us(taken) - epoch_us(lag(taken) over w) <= 10000000 and bit_count(xor(hash, lag(hash) over w)) <= 10 then 0 else 1 end as new_ from files window w as (partition by folder order by taken, source)),
run as (select *, sum(new_) over (partition by folder order by taken, source) as burst from cut),
bursts as (select folder, count(*) as members, arg_min(source, [lpad(cast(1000000000000 - size as varchar), 15, '0'), source]) as keeper, (sum(size) - max(size))::bigint as extra_bytes, string_agg(source, ',' order by taken, source) as sources from run group by folder, burst having count(*) > 1)"""


@query("bursts", f"with {_BURSTS} select folder, members, keeper, sources from bursts")
def _(spark, sf_dir):
    return similar.bursts(A.files_events(spark, sf_dir)).select("folder", "members", "keeper", F.array_join("sources", ",").alias("sources"))


@query("burst_extra_bytes", f"with {_BURSTS} select keeper, extra_bytes from bursts")
def _(spark, sf_dir):
    return similar.bursts(A.files_events(spark, sf_dir)).select("keeper", "extra_bytes")


# Roll-ups and charts


def _orders_view(spark, sf_dir):
    return A.files_orders(spark, sf_dir).withColumn("folder", F.date_format("taken", "yyyy/MM")).withColumn("taken_epoch", S.epoch(F.col("taken")))


_OVIEW = f"{SQL['files']}, ov as (select ordinal, source, size, strftime(taken, '%Y/%m') as folder, epoch(taken)::bigint as taken_epoch, taken from files)"


@query("flagship", f"with {SQL['det']}, {_SCORED}{_CHOSEN} select strftime(c.taken, '%Y/%m') as folder, count(*) as files, sum(cast(round(o_totalprice * 100) as bigint))::bigint as bytes from chosen c join orders o on o.o_orderkey = c.ordinal group by 1")
def flagship(spark, sf_dir):
    """From candidates to a folder roll-up of the planned archive."""
    plan = resolved(spark, sf_dir).withColumn("destination", P.destination(F.col("source"), F.col("taken"), ROOT, PATTERN))
    return views.folder_rollup(plan.withColumn("folder", P.relative_folder(F.col("destination"), ROOT)))


@query("folder_rollup", f"with {_OVIEW} select folder, count(*) as files, sum(size)::bigint as bytes from ov group by 1")
def _(spark, sf_dir):
    return views.folder_rollup(_orders_view(spark, sf_dir))


@query("tree_rollup", f"with {SQL['pages']}, p as (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as parts from folders), up as (select array_to_string(parts[1:n], '/') as path, n as depth, files, bytes from p, lateral (select unnest(range(0, len(parts) + 1)) as n)) select path, depth::int as depth, sum(files)::bigint as files, sum(bytes)::bigint as bytes from up group by 1, 2")
def _(spark, sf_dir):
    return views.tree_rollup(A.folders_pages(spark, sf_dir))


@query("folder_subtree", f"with {_OVIEW} select ordinal from ov where folder = '1996' or starts_with(folder, '1996/')")
def _(spark, sf_dir):
    return views.below(_orders_view(spark, sf_dir), "1996").select("ordinal")


@query("plan_summary", f"with {_OVIEW} select count(*) as files, sum(size)::bigint as bytes, count(distinct folder) as folders, (select count(*) from region) as skipped from ov")
def _(spark, sf_dir):
    return views.plan_summary(_orders_view(spark, sf_dir), A.table(spark, sf_dir, "region"))


@query("top_folders", f"with {_OVIEW} select folder, count(*) as files, sum(size)::bigint as bytes from ov group by 1 order by files desc, min(ordinal) limit 12")
def _(spark, sf_dir):
    return views.top_folders(_orders_view(spark, sf_dir))


@query("hour_histogram", f"with {SQL['view']}, h as (select unnest(range(24))::int as hour) select h.hour, count(v.ordinal) as files from h left join view_ v on hour(v.taken) = h.hour group by 1")
def _(spark, sf_dir):
    return views.hour_histogram(A.view_events(spark, sf_dir))


@query("midnight_share", f"with {SQL['view']} select count(*) filter (hour(taken) = 0)::double / count(*) as share from view_")
def _(spark, sf_dir):
    return views.midnight_share(A.view_events(spark, sf_dir))


@query("provider_counts", f"with {SQL['view']} select provider, count(*) as files from view_ group by 1")
def _(spark, sf_dir):
    return views.provider_counts(A.view_events(spark, sf_dir))


@query("reading_counts", f"with {SQL['view']}, r as (select unnest(['agree', 'single', 'wrong', 'decided']) as reading), v as (select case when decided then 'decided' when hard then 'wrong' when confidence = 'high' then 'agree' else 'single' end as reading from view_) select r.reading, count(v.reading) as files from r left join v on v.reading = r.reading group by 1")
def _(spark, sf_dir):
    return views.reading_counts(A.view_events(spark, sf_dir))


@query("time_span", f"with {_OVIEW} select min(taken_epoch) as first, max(taken_epoch) as last, greatest(1, floor((max(taken_epoch) - min(taken_epoch)) / (365.25 * 86400) + 0.5))::bigint as years from ov")
def _(spark, sf_dir):
    return views.time_span(_orders_view(spark, sf_dir))


@query("plan_range", f"""with {_OVIEW} select epoch(date_trunc('year', min(taken)))::bigint as "from", epoch(date_trunc('year', max(taken)) + interval 1 year)::bigint as "to" from ov""")
def _(spark, sf_dir):
    return views.plan_range(_orders_view(spark, sf_dir))


RANGE = (820454400 + 40 * 86400, 820454400 + 300 * 86400)  # within 1996


@query("range_filter", f"with {_OVIEW} select ordinal from ov where taken_epoch >= {RANGE[0]} and taken_epoch < {RANGE[1]}")
def _(spark, sf_dir):
    return views.in_range(_orders_view(spark, sf_dir), *RANGE).select("ordinal")


def _heat_sql(level: str, start: int, end: int, source: str) -> str:
    unit, cell, n = {"years": ("year", "month", 12), "months": ("month", "day", 31), "days": ("day", "hour", 24)}[level]
    return f"""r as (select r::timestamp as r, row_number() over (order by r) - 1 as row_ from (select unnest(generate_series(date_trunc('{unit}', make_timestamp({start}::bigint * 1000000)), make_timestamp({end - 1}::bigint * 1000000), interval 1 {unit})) as r)),
cells as (select r, row_, c, r + to_{cell}s(c) as at from r, (select unnest(range({n}))::int as c) where date_trunc('{unit}', r + to_{cell}s(c)) = r),
counts as (select date_trunc('{cell}', taken) as at, count(*) as n from {source} group by 1),
grid as (select epoch(r)::bigint as row_from, c as "column", (row_ * {n} + c)::bigint as "index", epoch(cells.at)::bigint as "from", epoch(cells.at + interval 1 {cell})::bigint as "to", coalesce(n, 0) as "count" from cells left join counts on counts.at = cells.at where epoch(cells.at + interval 1 {cell}) > {start} and epoch(cells.at) < {end})"""


YEARS, MONTHS, DAYS = (788918400, 788918400 + 86400 * 2200), (1704067200, 1704067200 + 86400 * 60), (1704067200 + 3600 * 30, 1704067200 + 86400 * 20)


@query("heat_years", f"with {_OVIEW}, {_heat_sql('years', *YEARS, 'ov')} select * from grid")
def _(spark, sf_dir):
    return views.heat_cells(_orders_view(spark, sf_dir), *YEARS)


@query("heat_months", f"with {SQL['view']}, {_heat_sql('months', *MONTHS, 'view_')} select * from grid")
def _(spark, sf_dir):
    return views.heat_cells(A.view_events(spark, sf_dir), *MONTHS)


@query("heat_days", f"with {SQL['view']}, {_heat_sql('days', *DAYS, 'view_')} select * from grid")
def _(spark, sf_dir):
    return views.heat_cells(A.view_events(spark, sf_dir), *DAYS)


@query("heat_summary", f"""with {SQL['view']}, {_heat_sql('days', *DAYS, 'view_')} select max("count") as max, sum("count")::bigint as total, count(*) filter ("count" = 0) as empty_cells, count(*) as cell_count from grid""")
def _(spark, sf_dir):
    return views.heat_summary(views.heat_cells(A.view_events(spark, sf_dir), *DAYS))


@query("heat_rows", f"""with {SQL['view']}, {_heat_sql('days', *DAYS, 'view_')} select greatest(row_from, {DAYS[0]}) as "from", least(row_from + 86400, {DAYS[1]}) as "to", sum("count")::bigint as "count" from grid group by row_from""")
def _(spark, sf_dir):
    return views.heat_rows(views.heat_cells(A.view_events(spark, sf_dir), *DAYS), *DAYS, "days")


@query("selection_range", f"""with {SQL['view']}, {_heat_sql('days', *DAYS, 'view_')} select min("from") as "from", max("to") as "to" from grid where "index" between 31 and 77""")
def _(spark, sf_dir):
    return views.selection_range(views.heat_cells(A.view_events(spark, sf_dir), *DAYS), 77, 31)


@query("heat_steps", f"""with {SQL['view']}, {_heat_sql('days', *DAYS, 'view_')}, m as (select max("count") as m from grid) select "index", case when "count" > 0 then least(6, floor(ln(1 + "count") / ln(1 + m) * 7))::int end as step from grid, m""")
def _(spark, sf_dir):
    cells = views.heat_cells(A.view_events(spark, sf_dir), *DAYS)
    return cells.crossJoin(F.broadcast(cells.agg(F.max("count").alias("m")))).select("index", S.heat_step(F.col("count"), F.col("m")).alias("step"))  # one row


# Tags and search


@query("tag_counts", f"with {SQL['tags']} select tag, count(*) as files from (select source, unnest(list_distinct(tags)) as tag from sight) group by 1")
def _(spark, sf_dir):
    return tags.tag_counts(A.tags_documents(spark, sf_dir))


@query("tag_counts_untagged", f"with {SQL['tags']} select tag, count(*) as files from (select source, unnest(list_distinct(tags)) as tag from sight) group by 1 union all select null, count(*) from sight where len(tags) = 0 having count(*) > 0")
def _(spark, sf_dir):
    return tags.tag_counts_untagged(A.tags_documents(spark, sf_dir))


@query("tag_labels", f"with {SQL['tags']} select distinct tag, regexp_replace(tag, '^(a|an|the) ', '') as label from (select unnest(tags) as tag from sight)")
def _(spark, sf_dir):
    return tags.worn(A.tags_documents(spark, sf_dir)).select("tag", S.label_of(F.col("tag")).alias("label")).distinct()


@query("tag_filter", f"with {SQL['tags']} select source from sight where list_has_any(tags, ['de', 'toxic']) or len(tags) = 0")
def _(spark, sf_dir):
    return views.with_tags(A.tags_documents(spark, sf_dir), ["de", "toxic"], untagged=True).select("source")


@query("quality_filter", f"with {SQL['tags']} select source from sight where quality >= 2.5")
def _(spark, sf_dir):
    return views.of_quality(A.tags_documents(spark, sf_dir), 2.5).select("source")


@query("keyword_search", f"with {SQL['tags']}, s as (select source, (case when len(list_filter(tags, lambda t: contains(lower(t), 'src1'))) > 0 then 1 else 0 end + case when len(list_filter(tags, lambda t: contains(lower(t), 'de'))) > 0 then 1 else 0 end + case when len(list_filter(tags, lambda t: contains(lower(t), '%'))) > 0 then 1 else 0 end) / 3.0::double as score from sight) select * from s where score > 0 order by score desc, source limit 500")
def _(spark, sf_dir):
    return tags.keyword_search(A.tags_documents(spark, sf_dir), "Src1 and DE or %")


@query("keyword_search_all", f"with {SQL['tags']}, s as (select source, (case when len(list_filter(tags, lambda t: contains(lower(t), 'good'))) > 0 then 1 else 0 end + case when len(list_filter(tags, lambda t: contains(lower(t), 'a '))) > 0 then 1 else 0 end) / 2.0::double as score from sight) select * from s where score > 0")
def _(spark, sf_dir):
    store = A.tags_documents(spark, sf_dir)
    return tags.keyword_search(store.withColumn("tags", F.transform("tags", lambda t: F.replace(t, F.lit(" "), F.lit("_")))), "GOOD and a_", limit=None)


@query("tag_upsert", f"with {SQL['tags']} select source, array_to_string(case when ordinal % 7 = 0 then ['new'] else tags end, ',') as tags from sight")
def _(spark, sf_dir):
    store = A.tags_documents(spark, sf_dir)
    return tags.upsert(store, store.filter("ordinal % 7 = 0").withColumn("tags", F.array(F.lit("new")))).select("source", F.array_join("tags", ",").alias("tags"))


@query("prune_store", f"with {SQL['tags']} select source from sight where ordinal % 3 = 1")
def _(spark, sf_dir):
    store = A.tags_documents(spark, sf_dir)
    return tags.prune(store, store.filter("ordinal % 3 = 1")).select("source")


@query("merged_tags", f"with {SQL['tags']} select source, array_to_string(case when ordinal % 2 = 0 and len(tags) > 0 then tags else ['own'] end, ',') as tags, case when ordinal % 2 = 0 then quality end as quality from sight")
def _(spark, sf_dir):
    store = A.tags_documents(spark, sf_dir)
    entries = store.select("source").withColumn("tags", F.array(F.lit("own")))
    return tags.merge_tags(entries, store.filter("ordinal % 2 = 0")).select("source", F.array_join("tags", ",").alias("tags"), "quality")


def _sightings(spark, sf_dir):
    return A.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("/v/"), F.col("vec_id").cast("string")).alias("source"), F.col("embedding").alias("vector"), "vec_id")


def _wanted(sightings, vec_id: int):
    """The one vector that is searched for."""
    return F.lit([float(x) for x in sightings.filter(F.col("vec_id") == vec_id).head()["vector"]])


@query("vector_search", "with q as (select embedding::double[] as q from embeddings where vec_id = 0), s as (select '/v/' || vec_id as source, list_sum(list_transform(list_zip(embedding::double[], q), lambda p: p[1] * p[2])) as score from embeddings, q) select source, round(score, 4) as score from (select * from s where score >= 0.02 order by score desc, source limit 500)")
def _(spark, sf_dir):
    s = _sightings(spark, sf_dir)
    return tags.vector_search(s, _wanted(s, 0)).select("source", F.round("score", 4).alias("score"))


@query("vector_search_all", "with q as (select embedding::double[] as q from embeddings where vec_id = 7), s as (select '/v/' || vec_id as source, list_sum(list_transform(list_zip(embedding::double[], q), lambda p: p[1] * p[2])) as score from embeddings, q) select source, round(score, 4) as score from s where score >= 0.02")
def _(spark, sf_dir):
    s = _sightings(spark, sf_dir)
    return tags.vector_search(s, _wanted(s, 7), limit=None).select("source", F.round("score", 4).alias("score"))


@query("normalise_vectors", "select vec_id, round(list_sum(list_transform(embedding::double[], lambda x: 3 * x)) / sqrt(list_sum(list_transform(embedding::double[], lambda x: 9 * x * x))), 5) as total from embeddings")
def _(spark, sf_dir):
    s = _sightings(spark, sf_dir).withColumn("vector", F.transform("vector", lambda v: v * 3))
    return s.select("vec_id", F.round(F.aggregate(tags.normalise(F.col("vector")), F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


@query("top_tags", "with s as (select vec_id, unnest(embedding::double[])as score, generate_subscripts(embedding, 1) - 1 as k from embeddings), v as (select * from s where k < 60), r as (select *, max(score) over (partition by vec_id) as best, row_number() over (partition by vec_id order by score desc, k) as place from v) select vec_id, string_agg('t' || k, ',' order by place) as tags from r where score >= best * 0.14 and score > 0 and place <= 6 group by 1")
def _(spark, sf_dir):
    vocabulary = F.array(*[F.lit(f"t{i}") for i in range(60)])
    return _sightings(spark, sf_dir).select("vec_id", F.array_join(tags.top_tags(vocabulary, F.col("vector")), ",").alias("tags"))


@query("zero_shot_tags", "with p as (select vec_id as pos, embedding::double[] as p from embeddings where vec_id < 20), s as (select e.vec_id, pos, list_sum(list_transform(list_zip(embedding::double[], p), lambda x: x[1] * x[2])) as score from embeddings e, p where vec_id >= 20), r as (select *, max(score) over (partition by vec_id) as best, row_number() over (partition by vec_id order by score desc, pos) as place from s), t as (select vec_id, string_agg('w' || pos, ',' order by place) as tags from r where score >= best * 0.14 and score > 0 and place <= 6 group by 1) select e.vec_id, coalesce(tags, '') as tags from embeddings e left join t on t.vec_id = e.vec_id where e.vec_id >= 20")
def _(spark, sf_dir):
    s = _sightings(spark, sf_dir)
    phrases = s.filter("vec_id < 20").select(F.col("vec_id").alias("pos"), F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("phrase"), "vector")
    out = tags.zero_shot(s.filter("vec_id >= 20"), phrases)
    return out.select(F.substring("source", 4, 20).cast("bigint").alias("vec_id"), F.array_join("tags", ",").alias("tags"))


@query("search_in_order", "with q as (select embedding::double[] as q from embeddings where vec_id = 3), s as (select vec_id, '/v/' || vec_id as source, list_sum(list_transform(list_zip(embedding::double[], q), lambda p: p[1] * p[2])) as score from embeddings, q), r as (select vec_id, (row_number() over (order by score desc, source))::int as rank from s where score >= 0.2) select * from r where rank <= 500")
def _(spark, sf_dir):
    s = _sightings(spark, sf_dir)
    return tags.search_order(s, tags.vector_search(s, _wanted(s, 3), floor=0.2)).select("vec_id", "rank")


@query("tag_narrowing", f"with {SQL['tags']}, c as (select tag, count(*) as files from (select source, unnest(list_distinct(tags)) as tag from sight) group by 1) select * from c where contains(lower(regexp_replace(tag, '^(a|an|the) ', '')), 'src1')")
def _(spark, sf_dir):
    return tags.narrow(tags.tag_counts(A.tags_documents(spark, sf_dir)), "  SRC1 ")


# Timeline

_AXIS = """days as (select distinct floor(e / 86400)::bigint as day from epochs),
g as (select day, lead(day) over (order by day) - day as gap from days),
w as (select *, case when coalesce(gap, 1) > 90 then 0 else coalesce(gap, 1) end as plain, case when coalesce(gap, 1) > 90 then log2(1 + gap) else 0 end as weight from g),
x as (select *, case when weight > 0 then (select case when sum(plain) = 0 then 1 else sum(plain) end from w) * 0.45 * weight / (select sum(weight) from w) else plain end::double as raw from w),
axis as (select day, gap, raw, coalesce(sum(raw) over (order by day rows between unbounded preceding and 1 preceding), 0) as upto, (select sum(raw) from x) as total from x)"""
_SPARSE = "epochs as (select date_diff('day', date '1995-01-01', o_orderdate::date) ** 2 // 40 * 86400 as e from orders)"


def _sparse(spark, sf_dir):
    """Orders on a scale that widens, so that the later days lie apart."""
    d = F.datediff(F.col("o_orderdate"), F.lit("1995-01-01")).cast("bigint")
    return A.table(spark, sf_dir, "orders").select((F.floor(d * d / 40) * 86400).alias("epoch"))


@query("time_axis", f"with {_SPARSE}, {_AXIS} select day, round(upto / total, 6) as position, round(raw / total, 6) as width, round(case when gap > 90 then (upto + raw / 2) / total end, 6) as break_at, case when row_number() over (partition by year(make_timestamp(day * 86400000000)) order by day) = 1 then cast(year(make_timestamp(day * 86400000000)) as varchar) end as tick from axis")
def _(spark, sf_dir):
    a = timeline.time_axis(_sparse(spark, sf_dir))
    return a.select("day", *[F.round(c, 6).alias(c) for c in ("position", "width", "break_at")], "tick")


def _instances(spark, sf_dir):
    return timeline.instances(resolved(spark, sf_dir), F.when(F.col("confidence") == "low", 2).otherwise(1))


_INSTANCES = f"""{SQL['det']}, {_SCORED}{_CHOSEN},
lane as (select d.ordinal, d.rank, case d.provider when 'exif' then 1 when 'media' then 2 else 3 end as lane, epoch(d.taken)::bigint as epoch, c.taken = d.taken as same, c.taken as own, c.provider as own_provider from det d join chosen c on c.ordinal = d.ordinal where d.provider in ('exif', 'media', 'filesystem')),
placed as (select *, row_number() over (partition by ordinal order by rank) - 1 as pos from lane),
marked as (select *, same and row_number() over (partition by ordinal, same order by pos) = 1 as chosen, bool_or(same) over (partition by ordinal) as any_ from placed),
inst as (select ordinal, pos, lane, epoch, chosen from marked union all select ordinal, count(*), max(case own_provider when 'exif' then 1 when 'media' then 2 when 'filesystem' then 3 else 0 end), max(epoch(own)::bigint), true from marked where not any_ group by ordinal)"""


@query("instances", f"with {_INSTANCES} select ordinal, pos, lane::int as lane, epoch, chosen from inst")
def _(spark, sf_dir):
    return _instances(spark, sf_dir).drop("tone")


@query("disagreement_pairs", f"with {_INSTANCES}, a as (select * from inst where chosen) select i.ordinal, a.pos as anchor_pos, i.pos as other_pos, i.epoch - a.epoch as seconds from inst i join a on a.ordinal = i.ordinal where i.pos <> a.pos and abs(i.epoch - a.epoch) >= 172800")
def _(spark, sf_dir):
    return timeline.disagreement_pairs(_instances(spark, sf_dir))


_FIELD = f"with {_INSTANCES}, epochs as (select epoch as e from inst), {_AXIS}, t as (select i.*, least(1, (upto + least(1, raw) * (epoch - day * 86400) / 86400) / total) as t from inst i join axis on day = epoch // 86400)"


@query("stack_depth", f"{_FIELD} select ordinal, pos, round((t - 0.5) * 22, 4) as x, round((1.5 - lane) * 1.35, 4) as y, (row_number() over (partition by floor(t * 900 + 0.5), lane order by ordinal, pos) - 1)::int as depth from t")
def _(spark, sf_dir):
    found = _instances(spark, sf_dir)
    placed = timeline.on_axis(found, timeline.time_axis(found))
    return timeline.field(placed).select("ordinal", "pos", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(F.col("z") / timeline.STACK_STEP + 6).cast("int").alias("depth"))


@query("terrain_layout", f"{_FIELD} select ordinal, pos, round((t - 0.5) * 22, 4) as x, round(((epoch % 86400) / 3600.0 / 24 - 0.5) * 7, 4) as z, (row_number() over (partition by floor(t * 700 + 0.5), floor((epoch % 86400) / 3600.0 + 0.5) order by ordinal, pos) - 1)::int as height from t")
def _(spark, sf_dir):
    found = _instances(spark, sf_dir)
    placed = timeline.terrain(timeline.on_axis(found, timeline.time_axis(found)))
    return placed.select("ordinal", "pos", F.round("x", 4).alias("x"), F.round("z", 4).alias("z"), F.round((F.col("y") + 3) / 0.09).cast("int").alias("height"))


@query("helix_layout", f"with {SQL['view']}, inst as (select ordinal, taken_epoch as epoch, hard from view_), epochs as (select epoch as e from inst), {_AXIS}, t as (select i.*, least(1, (upto + least(1, raw) * (epoch - day * 86400) / 86400) / total) as t from inst i join axis on day = epoch // 86400), p as (select *, t * 2 * pi() * 2 as angle, 3.4 + (epoch % 86400) / 3600.0 / 24 * 1.8 + case when hard then 2.6 else 0 end as radius from t) select ordinal, floor(cos(angle) * radius * 1000 + 0.3)::bigint as x, floor(((t - 0.5) * 11 + case when hard then 1.1 else 0 end) * 1000 + 0.3)::bigint as y, floor(sin(angle) * radius * 1000 + 0.3)::bigint as z from p")
def _(spark, sf_dir):
    v = A.view_events(spark, sf_dir).select("ordinal", F.col("taken_epoch").alias("epoch"), F.when(F.size("flags") > 0, 2).otherwise(1).alias("tone"))
    placed = timeline.helix(timeline.on_axis(v, timeline.time_axis(v)), 730)
    return placed.select("ordinal", *[F.floor(F.col(c) * 1000 + 0.3).alias(c) for c in "xyz"])


@query("even_thinning", "with n as (select o_orderkey as ordinal, year(o_orderdate) as year, count(*) over (partition by year(o_orderdate)) as n, row_number() over (partition by year(o_orderdate) order by o_orderdate, o_orderkey) - 1 as r from orders), keep as (select distinct year, n, floor(i * n / 60.0)::bigint as r from (select distinct year, n from n), (select unnest(range(60)) as i)) select ordinal from n where n <= 60 or exists (select 1 from keep k where k.year = n.year and k.r = n.r)")
def _(spark, sf_dir):
    v = _orders_view(spark, sf_dir).withColumn("year", F.year("taken"))
    return timeline.thinned(v, ["year"], ["taken_epoch", "ordinal"], 60, F.floor(F.col("taken_epoch") / timeline.DAY)).select("ordinal")


@query("periods", f"with {_OVIEW} select year(taken)::int as label, count(*) as files, min(taken_epoch) as first, max(taken_epoch) as last from ov group by 1")
def _(spark, sf_dir):
    return timeline.periods(_orders_view(spark, sf_dir))


@query("period_entries", f"with {_OVIEW} select ordinal from ov where year(taken) = 1995")
def _(spark, sf_dir):
    return timeline.in_period(_orders_view(spark, sf_dir), 1995).select("ordinal")


_RINGS = f"{_OVIEW}, cap as (select {timeline.RING_CAPACITY} as cap), y as (select year(taken)::int as year, count(*) as n from ov group by 1), rad as (select *, least(46.0, greatest(2.2, least(n, cap) * 0.62 * 1.14 / (pi() * 2)))::double as radius, row_number() over (order by year) - 1 as ring from y, cap), rings as (select *, least(6, greatest(1.05, greatest(2.2, (select max(radius) from rad)) * 0.11))::double as gap from rad)"


@query("year_rings", f"with {_RINGS} select year, ring::int as ring, n as \"count\", least(n, cap)::bigint as shown, round(radius, 6) as radius, round(ring * gap, 6) as y from rings")
def _(spark, sf_dir):
    return timeline.year_rings(_orders_view(spark, sf_dir)).select("year", "ring", "count", F.col("shown").cast("bigint").alias("shown"), F.round("radius", 6).alias("radius"), F.round("y", 6).alias("y"))


_TILES = f"""{_RINGS}, members as (select ordinal, year(taken)::int as year, row_number() over (partition by year(taken) order by taken_epoch, ordinal) - 1 as r from ov),
kept as (select year, i, case when n <= cap then i else floor(i * n / cap::double)::bigint end as r from rings, lateral (select unnest(range(0, least(n, cap)::bigint)) as i)),
tiles as (select m.ordinal, m.year, g.ring, k.i::double / least(n, cap) as turn, radius, ring * gap as y, gap from members m join kept k on k.year = m.year and k.r = m.r join rings g on g.year = m.year)"""


@query("ring_tiles", f"with {_TILES} select ordinal, year, ring::int as ring, round(turn * pi() * 2, 5) as angle, round(y + turn * gap, 5) as coil from tiles")
def _(spark, sf_dir):
    return timeline.ring_tiles(_orders_view(spark, sf_dir)).select("ordinal", "year", "ring", F.round("angle", 5).alias("angle"), F.round("coil", 5).alias("coil"))


@query("nearest_tiles", f"with {_TILES} select ordinal, round(sqrt((sin(turn * pi() * 2) * radius - 3) ** 2 + (y - 2) ** 2 + (cos(turn * pi() * 2) * radius - 1) ** 2), 5) as distance from tiles order by 2, 1 limit 25")
def _(spark, sf_dir):
    tiles = timeline.ring_tiles(_orders_view(spark, sf_dir))
    return timeline.nearest_tiles(tiles, (3.0, 2.0, 1.0), 25).select("ordinal", F.round("distance", 5).alias("distance"))


_BINS = """p as (select date_diff('day', date '2024-01-01', ts::date)::double ** 3 as x, value as y, user_id::double as z from events), e as (select min(x) as low, (max(x) - min(x)) / 48 as width from p),
m as (select least(47, floor((x - low) / width))::int as bin, avg(y) as y, avg(z) as z from p, e group by 1), d as (select unnest(range(48))::int as bin),
s as (select d.bin, (select max(bin) from m where m.bin <= d.bin) as a, (select min(bin) from m where m.bin >= d.bin) as b from d), f as (select bin, coalesce(a, b) as a, coalesce(b, a) as b from s)"""


@query("path_bins", f"with {_BINS} select f.bin, round(low + (f.bin + 0.5) * width, 3) as x, round(ma.y + (mb.y - ma.y) * case when a = b then 0 else (f.bin - a) / (b - a)::double end, 6) as y, round(ma.z + (mb.z - ma.z) * case when a = b then 0 else (f.bin - a) / (b - a)::double end, 6) as z from f join m ma on ma.bin = a join m mb on mb.bin = b, e")
def _(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    points = e.select(F.pow(F.datediff(F.col("ts"), F.lit("2024-01-01")).cast("double"), F.lit(3.0)).alias("x"), F.col("value").alias("y"), F.col("user_id").cast("double").alias("z"))
    return timeline.path_bins(points).select("bin", F.round("x", 3).alias("x"), F.round("y", 6).alias("y"), F.round("z", 6).alias("z"))


#: Odd sizes, of which no part is half of a last digit: engines round halves in their own ways.
_SIZES = f"{SQL['files']}, s as (select ordinal, x + 1 - x % 2 as s from (select ordinal, size * (array[1, 1000, 1000000, 1000000000, 7])[ordinal % 5 + 1]::bigint as x from files))"


def _odd_sizes(spark, sf_dir):
    by = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in (1, 1000, 1000000, 1000000000, 7)]), (F.col("ordinal") % 5 + 1).cast("int"))
    return A.files_orders(spark, sf_dir).withColumn("x", F.col("size") * by).select("ordinal", (F.col("x") + 1 - F.col("x") % 2).alias("s"))


@query("human_sizes", f"with {_SIZES} select ordinal, case when s >= 1099511627776 then printf('%.2f TB', s / 1099511627776.0::double) when s >= 1073741824 then printf('%.2f GB', s / 1073741824.0::double) when s >= 1048576 then printf('%.2f MB', s / 1048576.0::double) when s >= 1024 then printf('%.2f KB', s / 1024.0::double) else s || ' B' end as label from s")
def _(spark, sf_dir):
    return _odd_sizes(spark, sf_dir).select("ordinal", S.human_bytes(F.col("s")).alias("label"))


_SHORT = ", ".join(f"({2 ** (10 * i)}::bigint, '{u}')" for i, u in enumerate(("KB", "MB", "GB", "TB"), 1))


@query("short_sizes", f"with {_SIZES}, unit as (select * from (values {_SHORT}) u(n, name)), best as (select s.ordinal, s.s, max(n) as n from s left join unit on s.s >= n group by 1, 2) select ordinal, case when b.n is null then s || ' B' when s / b.n::double < 10 then printf('%.1f ', s / b.n::double) || name else printf('%.0f ', s / b.n::double) || name end as label from best b left join unit u on u.n = b.n")
def _(spark, sf_dir):
    return _odd_sizes(spark, sf_dir).select("ordinal", S.format_bytes(F.col("s")).alias("label"))


@query("companion_keys", "select l_orderkey * 10 + l_linenumber as ordinal, 'f' || l_orderkey as stem, case (l_linenumber % 7) when 0 then 4 when 1 then 3 when 2 then 1 when 3 then 2 when 4 then 0 when 5 then 4 else 1 end as kind from lineitem group by l_orderkey, l_linenumber")
def _(spark, sf_dir):
    c = A.companions_lineitem(spark, sf_dir)
    return c.select("ordinal", S.group_stem(F.col("source")).alias("stem"), S.media_kind(S.extension(F.col("source"))).alias("kind"))


_PREVIEW = """case when s is null then 'missing' when ext in ('jpg', 'cr2x') then case when s <= 16777216 then 'image' else 'binary' end when ext = 'mov' then 'video' when ext = 'json' then 'text' else 'binary' end"""


@query("preview_classes", f"select ordinal, {_PREVIEW} as class from (select l_orderkey * 10 + l_linenumber as ordinal, (['jpg', 'mov', 'xmp', 'mp3', 'dat', 'cr2', 'json'])[l_linenumber % 7 + 1] as ext, case when l_orderkey % 9 <> 0 then (max(l_extendedprice) * 400)::bigint end as s from lineitem group by l_orderkey, l_linenumber)")
def _(spark, sf_dir):
    line = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_extendedprice") * 400).alias("s"))
    size = F.when(F.col("l_orderkey") % 9 != 0, F.round("s").cast("bigint"))
    ext = F.element_at(F.array(*[F.lit(x) for x in A.EXTENSIONS]), (F.col("l_linenumber") % 7 + 1).cast("int"))
    return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), S.preview_class(ext, size).alias("class"))


_BOXES = """b as (select l_orderkey as file_id, (['none', 'rot90', 'rot180', 'rot270'])[l_linenumber % 4 + 1] as turn, l_linenumber % 4 as o, (['person', 'dog', 'bus'])[l_partkey % 3 + 1] as label, round(l_quantity)::bigint as c, l_suppkey % 2 = 0 as tall from lineitem),
s as (select file_id, turn, o, sum(c * c + case when tall and label = 'person' then 50 * c else 0 end) as score from b group by 1, 2, 3),
best as (select * from (select *, row_number() over (partition by file_id order by (turn = 'none' and score >= 12000) desc, score desc, o) as n from s) where n = 1),
t as (select file_id, turn, label, count(*) as k from b group by 1, 2, 3), p as (select *, row_number() over (partition by file_id, turn order by k desc, label) as n from t),
r as (select file_id, turn, string_agg(k || ' ' || case when k = 1 then label when label = 'person' then 'people' when label = 'bus' then 'buses' else label || 's' end, ', ' order by n) as reason from p where n <= 3 group by 1, 2)"""


@query("upright_guess", f"with {_BOXES} select best.file_id, case when score >= 5000 then best.turn else 'none' end as transform, case when score >= 5000 then reason else 'nothing recognisable' end as reason from best join r on r.file_id = best.file_id and r.turn = best.turn")
def _(spark, sf_dir):
    """Scores in whole ten-thousandths, so that both engines add them alike."""
    line = A.table(spark, sf_dir, "lineitem")
    tall = F.col("l_suppkey") % 2 == 0
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    boxes = line.select(
        F.col("l_orderkey").alias("file_id"),
        pick(vision.TURNS, F.col("l_linenumber") % 4).alias("turn"),
        pick(("person", "dog", "bus"), F.col("l_partkey") % 3).alias("label"),
        (F.round("l_quantity") / 100).alias("confidence"),
        F.when(tall, F.array(*[F.lit(x) for x in (0.0, 0.0, 0.25, 0.75)])).otherwise(F.array(*[F.lit(x) for x in (0.0, 0.0, 0.75, 0.25)])).alias("bounds"),
    )
    return vision.upright(boxes, exact=10_000).select("file_id", "transform", "reason")


@query("ui_filter", f"with {SQL['tags']}, e as (select s.*, doc_id, n_chars * 86400 as taken_epoch, d.lang || '/' || d.source as folder from sight s join documents d on d.doc_id = s.ordinal) select source from e where (list_has_any(tags, ['fr', 'good', 'toxic']) or len(tags) = 0) and quality >= 0.5 and taken_epoch >= 43200000 and taken_epoch < 259200000 and (folder = 'en' or starts_with(folder, 'en/')) and doc_id % 2 = 0")
def _(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 86400).alias("taken_epoch"), F.concat("lang", F.lit("/"), "source").alias("folder"))
    entries = A.tags_documents(spark, sf_dir).join(d, F.col("ordinal") == F.col("doc_id"))
    marked = entries.filter("doc_id % 2 = 0").select("source")
    return views.ui_filter(entries, tags=["fr", "good", "toxic"], untagged=True, quality=0.5, span=(43200000, 259200000), folder="en", everywhere=False, marked=marked).select("source")


@query("change_exclusions", f"with {SQL['files']} select source, (select count(*) from files where ordinal % 6 <> 0 and ordinal % 4 = 0) as changed from files where ordinal % 6 = 0 or ordinal % 4 = 0")
def _(spark, sf_dir):
    files = A.files_orders(spark, sf_dir)
    new, changed = overlay.change_exclusions(files.filter("ordinal % 6 = 0"), files.filter("ordinal % 4 = 0"), out=True)
    return new.crossJoin(F.broadcast(changed))  # one row


@query("retired_tags", f"with {SQL['tags']} select source, array_to_string(list_filter(tags || ['a good picture'], lambda t: t not in ('a good picture', 'a beautiful picture')), ',') as tags from sight")
def _(spark, sf_dir):
    store = A.tags_documents(spark, sf_dir).withColumn("tags", F.concat("tags", F.array(F.lit("a good picture"))))
    return tags.drop_retired(store).select("source", F.array_join("tags", ",").alias("tags"))


@query("loaded_plan", f"with {_DATED} select ordinal, case when ordinal % 10 = 0 then '/archive/1999/12/' || regexp_extract(source, '[^/]*$') else destination end as destination, case when ordinal % 3 = 0 then {_TURNED}[ordinal % 8 + 1] else {_TURNS}[ordinal % 8 + 1] end as rotate from dated where ordinal % 4 <> 0")
def _(spark, sf_dir):
    """What copying sees: exclusions, dates and rotations together."""
    plan = _dated(spark, sf_dir).withColumn("rotate", S.for_orientation((F.col("ordinal") % 8 + 1).cast("int"))).withColumn("reencode", F.lit(False))
    dates = plan.filter("ordinal % 10 = 0").select("source", F.lit("1999-12-31 10:00:00").cast("timestamp_ntz").alias("taken"), F.lit("manual").alias("origin"))
    return overlay.load_plan(plan, dates, overlay.turned(plan.filter("ordinal % 3 = 0"), 1), plan.filter("ordinal % 4 = 0"), ROOT, PATTERN).select("ordinal", "destination", "rotate")


@query("entry_view", f"with {SQL['det']}, {_SCORED}{_CHOSEN} select c.ordinal, strftime(c.taken, '%Y/%m') as folder, epoch(c.taken)::bigint as taken_epoch, case when c.ordinal % 3 = 0 then 'copied' end as outcome, c.ordinal % 3 = 0 as destination_exists from chosen c")
def _(spark, sf_dir):
    plan = resolved(spark, sf_dir).withColumn("destination", P.destination(F.col("source"), F.col("taken"), ROOT, PATTERN))
    done = plan.filter("ordinal % 3 = 0")
    out = views.entry_view(plan, ROOT, done.select("source", F.lit("copied").alias("status")), done.select("destination"))
    return out.select("ordinal", "folder", "taken_epoch", "outcome", "destination_exists")


@query("readings", f"with {SQL['view']} select ordinal, case when decided then 'decided' when hard then 'wrong' when confidence = 'high' then 'agree' else 'single' end as reading from view_")
def _(spark, sf_dir):
    return A.view_events(spark, sf_dir).select("ordinal", views.reading().alias("reading"))


@query("calendar_parts", "select event_id as ordinal, year(ts)::int as year, month(ts)::int as month, strftime(ts, '%Y-%m-%d') as day, ((epoch(ts)::bigint % 86400) * 1000 // 3600)::bigint as milli_hours from (select event_id, date_trunc('second', ts) as ts from events)")
def _(spark, sf_dir):
    v = A.view_events(spark, sf_dir)
    at = F.timestamp_seconds("taken_epoch")
    return v.select("ordinal", F.year(at).alias("year"), F.month(at).alias("month"), F.date_format(at, "yyyy-MM-dd").alias("day"), F.floor(timeline.hour_of(F.col("taken_epoch")) * 1000 + 1e-7).alias("milli_hours"))
