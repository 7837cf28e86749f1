"""Queries over flows: leases as a stream, rate limits, retries and payloads of the table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..operators import scan as N, tables as B
from ..session import scratch_path, settings
from ..streaming import events as E, leases as L
from .registry import query, table

#: Seconds that a claim lasts, and that a failure waits.
TTL, WAIT = 129_600, 43_200

_SIGNS_SQL = """(select user_id::varchar k, event_id id, epoch_us(ts) // 1000 t, case event_type when 'signup' then 'discover' when 'click' then 'claim' when 'view' then 'beat' when 'purchase' then 'done' else 'fail' end kind,
 'w' || (event_id % 2) w, row_number() over (partition by user_id order by epoch_us(ts) // 1000, event_id) n from events)"""

#: Sign by sign: what expires before it, what it changes, and the state after it.
_LEASES_SQL = f"""
with recursive e as materialized (select * from {_SIGNS_SQL}),
s as (
  select distinct k, 0::bigint n, null::varchar status, null::varchar worker, 0::bigint til, 0 attempts, null::bigint lost_at, null::varchar lost_by, null::varchar what, 0::bigint t, null::varchar by_ from e
  union all
  select k, n, case when lost and what is null then 'discovered' when what is not null then what else status end, case when what in ('fetched', 'failed', 'discovered') or lost and what is null then null when what = 'claimed' then w else worker end,
   case when what = 'claimed' or kind = 'beat' and held then greatest(case when what = 'claimed' then 0 else til end, t + {1000 * TTL}) when what = 'failed' then t + {1000 * WAIT} when what = 'fetched' then 0 else til end,
   attempts + (what is not distinct from 'claimed')::int, case when lost then til end, case when lost then worker end, what, t, w
  from (
    select *, case when kind = 'discover' and status is null then 'discovered' when kind = 'claim' and (lost or status = 'discovered' or status = 'failed' and til <= t) then 'claimed'
      when kind = 'done' and held then 'fetched' when kind = 'fail' and held then 'failed' end what
    from (select e.*, s.status, s.worker, s.til, s.attempts, s.status is not distinct from 'claimed' and s.til <= e.t lost, s.status is not distinct from 'claimed' and s.til > e.t and s.worker = e.w held
      from s join e on e.k = s.k and e.n = s.n + 1))),
last as (select *, row_number() over (partition by k order by n desc) r from s),
mark as (select max(t) m from e)
select k as "key", 'expired' what, lost_at at_ms, lost_by worker, attempts - (what is not distinct from 'claimed')::int attempts from s where lost_at is not null
union all select k, what, t, case when what <> 'discovered' then by_ end, attempts from s where what is not null
union all select k, 'expired', til, worker, attempts from last, mark where r = 1 and status = 'claimed' and til <= m"""


def _signs(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "discover").when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "view", "beat").when(F.col("event_type") == "purchase", "done").otherwise("fail")
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"), kind.alias("kind"), F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("worker"))


def _changes(spark, d) -> DataFrame:
    """What the leases' stream has put out when it has read all events."""
    path = scratch_path(spark, "leases")
    with settings(spark, **L.PROVIDER):
        stream = L.lease_changes(_signs(E.event_stream(spark, d, pattern="events.parquet")), TTL, WAIT)
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "leases-checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(_LEASES_SQL)
def lease_stream(spark, d):
    return _changes(spark, d).select("key", "what", F.unix_millis("at").alias("at_ms"), "worker", "attempts")


_STATES_SQL = f"""{_LEASES_SQL.replace('select k as "key"', ', c as (select k as "key"', 1)}),
one as (select *, row_number() over (partition by "key" order by at_ms desc, list_position(['expired', 'discovered', 'claimed', 'failed', 'fetched'], what) desc) r from c)
select case when what = 'expired' then 'discovered' else what end status, count(*) n, sum(attempts)::bigint attempts from one where r = 1 group by 1"""


@query(_STATES_SQL)
def lease_status_counts(spark, d):
    return L.lease_states(_changes(spark, d)).groupBy("status").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@query("""
with recursive e as materialized (select event_id, event_type host, epoch_us(ts) a, row_number() over (partition by event_type order by ts, event_id) n from events),
s as (select host, 0::bigint n, null::bigint event_id, null::bigint a, -4000000000000000::bigint start from (select distinct host from e)
 union all select e.host, e.n, e.event_id, e.a, greatest(e.a, s.start + 1200000000) from s join e on e.host = s.host and e.n = s.n + 1)
select event_id, start start_us, start - a waited_us from s where n > 0""")
def rate_limited_starts(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("host"), F.col("ts").cast("timestamp").alias("arrival"))
    got = N.rate_limited(e, 1 / 1200, order=["event_id"])
    return got.select("event_id", F.unix_micros("start").alias("start_us"), (F.unix_micros("start") - F.unix_micros("arrival")).alias("waited_us"))


@query("select event_id, row_number() over (partition by event_type order by ts, event_id) - 1 place from events")
def places_in_groups(spark, d):
    return N.with_place(table(spark, d, "events").select("event_id", "event_type", "ts"), "event_type", ["ts", "event_id"]).select("event_id", "place")


_PAYLOAD = """case event_id % 6 when 0 then props when 1 then '{"k": "' || event_type || '", "deep": {"n": [' || event_id || ', {"x": ' || value || '}]}}' when 2 then '{"k": ' when 3 then null when 4 then '[1, 2]' else '{"k": null, "deep": 7}' end"""


@query(f"""
with p as (select event_id, {_PAYLOAD} j from events), v as (select event_id, case when json_valid(j) then j::json end j from p)
select event_id, j is not null valid, try_cast(j->>'$.k' as bigint) k_long, j->>'$.k' k_text, try_cast(j->>'$.deep.n[0]' as bigint) n, round(try_cast(j->>'$.deep.n[1].x' as double), 6) x, try_cast(j->>'$[1]' as bigint) listed from v""")
def json_payloads(spark, d):
    raw = table(spark, d, "events").select("event_id", F.expr(_PAYLOAD).alias("raw"))
    v = raw.select("event_id", X.payload(F.col("raw")).alias("v"))
    of = lambda path, kind: X.payload_field(F.col("v"), path, kind)
    return v.select("event_id", F.col("v").isNotNull().alias("valid"), of("$.k", "long").alias("k_long"), of("$.k", "string").alias("k_text"), of("$.deep.n[0]", "long").alias("n"), F.round(of("$.deep.n[1].x", "double"), 6).alias("x"), of("$[1]", "long").alias("listed"))


@query("""
with o as (select doc_id, 'r' || (doc_id % 3) run_id, 'old' said from labels where doc_id % 2 = 0),
n as (select doc_id, 'r' || (doc_id % 3) run_id, 'new' said from labels where doc_id % 5 = 0),
u as (select * from n union all select * from o where doc_id not in (select doc_id from n)),
i as (select doc_id, 'r' || (doc_id % 3) run_id, 'late' said from labels where doc_id % 7 = 0 and doc_id not in (select doc_id from u))
select * from u where run_id <> 'r2' and doc_id % 11 > 0 union all select * from i where run_id <> 'r2' and doc_id % 11 > 0""")
def bucketed_table(spark, d):
    path = scratch_path(spark, "bucketed")
    rows = table(spark, d, "labels").select("doc_id", F.concat(F.lit("r"), (F.col("doc_id") % 3).cast("string")).alias("run_id"))
    said = lambda cut, what: rows.filter(cut).withColumn("said", F.lit(what))
    B.create(said("doc_id % 2 = 0", "old"), path, ["doc_id"], 16, "run_id")
    for _ in range(2):  # a change that comes again changes nothing
        B.upsert(spark, path, said("doc_id % 5 = 0", "new"))
    B.insert(spark, path, said("doc_id % 7 = 0", "late"))
    B.delete(spark, path, rows.filter("doc_id % 11 = 0"))
    B.delete_run(spark, path, "r2")
    return B.read(spark, path)
