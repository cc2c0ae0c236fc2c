"""Catalog maintenance over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.operators import etl as ops
from tessitura.plans.catalog_tables import read
from tessitura.plans.registry import query


def _state(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").where(k % 5 != 0).select(
        k.alias("id"), F.concat(F.lit("p"), k).alias("path"), F.sha2(k.cast("string"), 256).alias("manifest_sha256"), F.concat(F.lit("f"), k).alias("fingerprint"),
        F.when(F.col("o_orderstatus") == "P", "unavailable").otherwise("valid").alias("status"), F.lit("unverified").alias("verify_status"), F.lit("s1").alias("last_scan"), F.lit(None).cast("string").alias("last_error"))


def _found(spark, sf_dir):
    """Of each 7 one is gone and one has moved; every 11th has changed, every 13th is broken."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").where(k % 7 != 3)
    return o.select(F.when(k % 7 == 1, F.concat(F.lit("m"), k)).otherwise(F.concat(F.lit("p"), k)).alias("path"), F.sha2(F.when(k % 11 == 0, F.concat(F.lit("x"), k)).otherwise(k.cast("string")), 256).alias("manifest_sha256"),
                    F.concat(F.lit("f"), k).alias("fingerprint"), F.when(k % 13 == 0, F.array(F.lit("E_TITLE"))).otherwise(F.array().cast("array<string>")).alias("problems"), F.when(k % 17 == 0, 1).otherwise(0).alias("missing"))


_SCAN = """
with o as (select o_orderkey as k, o_orderstatus as s, o_orderkey % 5 <> 0 as known from orders),
f as (select k, known, k % 7 = 1 as at_new, k % 13 = 0 as broken from o where k % 7 <> 3),
a as (select k, known, case when broken then 'invalid' when known and not at_new and k % 11 <> 0 then 'unchanged' when known and not at_new then 'updated' when known then 'moved' else 'added' end as action,
  case when known and not (at_new and broken) then k end as old_id from f)
"""


@query("scan_actions", _SCAN + "select case when k % 7 = 1 then 'm' else 'p' end || k as path, action, old_id from a")
def scan_actions(spark, sf_dir):
    return ops.actions(_state(spark, sf_dir), _found(spark, sf_dir)).select("path", "action", "old_id")


@query("scan_counters", _SCAN + """select count(*) as total, count(*) filter (action = 'added') as added, count(*) filter (action = 'updated') as updated, count(*) filter (action = 'moved') as moved, count(*) filter (action = 'invalid') as invalid,
  count(*) filter (action = 'unchanged') as unchanged, (select count(*) from o where known and s <> 'P' and k not in (select old_id from a where old_id is not null)) as removed from a""")
def scan_counters(spark, sf_dir):
    return ops.scan(_state(spark, sf_dir), _found(spark, sf_dir), "s2")[1]


@query("scan_statuses", _SCAN + """, n as (select case when k % 13 = 0 then 'invalid' when k % 17 = 0 then 'warning' else 'valid' end as status, 's2' as last_scan from a
  union all select 'unavailable', 's1' from o where known and k not in (select old_id from a where old_id is not null))
select status, last_scan, count(*) as n from n group by 1, 2""")
def scan_statuses(spark, sf_dir):
    return ops.scan(_state(spark, sf_dir), _found(spark, sf_dir), "s2")[0].groupBy("status", "last_scan").agg(F.count("*").alias("n"))


@query("scan_ids", _SCAN + """, n as (select case when k % 7 = 1 then 'm' else 'p' end || k as path, old_id from a)
select path, case when old_id is not null then old_id else (select max(k) from o where known) + row_number() over (partition by old_id is null order by path) end as id from n""")
def scan_ids(spark, sf_dir):
    return ops.scan(_state(spark, sf_dir), _found(spark, sf_dir), "s2")[0].where("last_scan = 's2'").select("path", "id")


@query("upsert_groups", """
with a as (select c_custkey as k, c_name as title from customer where c_custkey % 3 <> 0), b as (select c_custkey as k, 'New ' || c_custkey as title from customer where c_custkey % 2 = 0)
select coalesce(a.k, b.k) as k, coalesce(b.title, a.title) as title from a full join b on a.k = b.k""")
def upsert_groups(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("title"))
    return ops.upsert(c.where("k % 3 <> 0"), c.where("k % 2 = 0").withColumn("title", F.concat(F.lit("New "), "k")), ["k"], ["title"])


@query("upsert_artists", """
with a as (select cast(n_nationkey as bigint) as id, n_name as name from nation where n_nationkey % 2 = 0),
n as (select min(name) as name from (select n_name as name from nation union all select lower(n_name) from nation) x where lower(name) not in (select lower(name) from a) group by lower(name))
select * from a union all select (select max(id) from a) + row_number() over (order by lower(name)), name from n""")
def upsert_artists(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    a = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    names = n.select(F.col("n_name").alias("name")).unionByName(n.select(F.lower("n_name").alias("name")))
    return ops.upsert_names(a, names)


@query("replace_content", "select o_custkey as release, o_orderkey as track from orders where o_custkey % 2 = 1 union all select c_custkey, -c_custkey from customer where c_custkey % 2 = 0")
def replace_content(spark, sf_dir):
    old = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("release"), F.col("o_orderkey").alias("track"))
    new = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("release"), (-F.col("c_custkey")).alias("track"))
    return ops.replaced(old, new, "release")


_VERIFY = """
with l as (select distinct l_orderkey as package, l_linenumber as n from lineitem),
e as (select package, n from l where n % 6 <> 5), f as (select package, n, (package + n) % 50 = 0 as changed from l where (package * n) % 40 <> 1),
b as (select e.package, count(*) filter (f.n is null) as missing, count(*) filter (f.changed) as mismatched from e left join f using (package, n) group by 1),
x as (select package, count(*) as extra from f where n % 6 = 5 group by 1),
v as (select package, coalesce(missing, 0) as missing, coalesce(mismatched, 0) as mismatched, coalesce(extra, 0) as extra from b full join x using (package)),
w as (select *, case when missing + mismatched > 0 then 'checksum-failed' when extra > 0 then 'warning' else 'valid' end as status from v)
"""


def _verified(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("package"), F.col("l_linenumber").alias("n")).distinct()
    path, sha = F.concat(F.lit("audio/"), "n"), F.sha2(F.concat_ws("/", "package", "n"), 256)
    expected = line.where("n % 6 <> 5").select("package", path.alias("path"), sha.alias("sha256"))
    files = line.where("(package * n) % 40 <> 1").select("package", path.alias("path"), F.when((F.col("package") + F.col("n")) % 50 == 0, "x").otherwise(sha).alias("sha256"))
    return ops.verified(expected, files)


@query("verify_packages", _VERIFY + "select * from w")
def verify_packages(spark, sf_dir):
    return _verified(spark, sf_dir)


@query("verify_counters", _VERIFY + "select count(*) as total, count(*) filter (status = 'valid') as passed, count(*) filter (status = 'warning') as warnings, count(*) filter (status = 'checksum-failed') as failed from w")
def verify_counters(spark, sf_dir):
    return ops.verify_counters(_verified(spark, sf_dir))


@query("session_extend", """
select cast(user_id as varchar) as session_hash, case when user_id % 2 = 0 then timestamp '2026-01-01' else timestamp '2025-01-01' end as last_used_at,
  case when user_id % 2 = 0 then timestamp '2026-01-31' else timestamp '2025-02-01' end as expires_at from (select distinct user_id from events)""")
def session_extend(spark, sf_dir):
    ts = lambda x: F.to_timestamp(F.lit(x))
    s = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_hash"), ts("2025-01-01").alias("last_used_at"), ts("2025-02-01").alias("expires_at")).distinct()
    return ops.extended(s, s.where("cast(session_hash as int) % 2 = 0"), ts("2026-01-01"))


@query("token_revoke", "select c_custkey, case when c_custkey % 4 = 0 then 1 when c_custkey % 3 = 0 then 2 end as revoked_at from customer")
def token_revoke(spark, sf_dir):
    t = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, 1).alias("revoked_at"))
    return ops.revoked(t, "c_custkey", t.where("c_custkey % 3 = 0"), F.lit(2))


@query("verify_statuses", _VERIFY + """, p as (select o_orderkey as k from orders)
select k as id, coalesce(case when status = 'checksum-failed' then 'checksum-failed' else status end, 'valid') as status, coalesce(status, 'unverified') as verify_status,
  case when missing + mismatched > 0 then 'integrity verification failed (' || (missing + mismatched) || ' errors, ' || extra || ' warnings)' when extra > 0 then extra || ' warning(s)' end as last_error from p left join w on w.package = p.k""")
def verify_statuses(spark, sf_dir):
    v = _verified(spark, sf_dir).select(F.col("package").cast("string").alias("path"), (F.col("missing") + F.col("mismatched")).alias("errors"), F.col("extra").alias("warnings"))
    null = F.lit(None).cast("string")
    p = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("path"), F.lit("m").alias("manifest_sha256"), F.lit("f").alias("fingerprint"), F.lit("valid").alias("status"), F.lit("unverified").alias("verify_status"), F.lit("s").alias("last_scan"), null.alias("last_error"))
    return ops.verify_applied(p, v).select("id", "status", "verify_status", "last_error")


@query("light_statuses", "select o_orderkey as id, case when o_orderkey % 4 > 0 then 'warning' else 'valid' end as status, 'unverified' as verify_status, case when o_orderkey % 4 > 0 then (o_orderkey % 4) || ' referenced object(s) missing' end as last_error from orders")
def light_statuses(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ops.light_status(F.col("o_orderkey") % 4).alias("s")).select("id", "s.*")


@query("verify_report", _VERIFY + "select cast(sum(missing + mismatched) as bigint) as errors, cast(sum(extra) as bigint) as warnings from v")
def verify_report(spark, sf_dir):
    return ops.report(_verified(spark, sf_dir))


@query("library_status", _SCAN + """, v as (select count(*) filter (o_orderstatus = 'P') as unavailable, count(*) filter (o_orderstatus <> 'P') as valid from orders where o_orderkey % 5 <> 0)
select (select count(*) from a) as scanned, (select count(*) filter (action = 'added') from a) as added, valid, unavailable from v""")
def library_status(spark, sf_dir):
    counters = ops.scan(_state(spark, sf_dir), _found(spark, sf_dir), "s2")[1]
    s = ops.status(_state(spark, sf_dir), counters, ops.verify_counters(_verified(spark, sf_dir)))
    return s.select(F.col("scan.total").alias("scanned"), "scan.added", F.col("packages")["valid"].alias("valid"), F.col("packages")["unavailable"].alias("unavailable"))


@query("upsert_releases", """
with a as (select o_custkey as g, o_orderpriority as r, min(o_orderkey) as v from orders where o_orderkey % 3 <> 0 group by 1, 2), b as (select o_custkey as g, o_orderpriority as r, min(-o_orderkey) as v from orders where o_orderkey % 2 = 0 group by 1, 2)
select coalesce(a.g, b.g) as g, coalesce(a.r, b.r) as r, coalesce(b.v, a.v) as v from a full join b on a.g = b.g and a.r = b.r""")
def upsert_releases(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("r"), F.col("o_orderkey").alias("v"))
    return ops.upsert(o.where("v % 3 <> 0").groupBy("g", "r").agg(F.min("v").alias("v")), o.where("v % 2 = 0").withColumn("v", -F.col("v")), ["g", "r"], ["v"])


@query("upsert_album_artists", """
select c_custkey as group_id, case when c_custkey % 2 = 0 then n.n_name else 'old' end as artist from customer c join nation n on n.n_nationkey = c.c_nationkey where c_custkey % 3 > 0 or c_custkey % 2 = 0""")
def upsert_album_artists(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), "n_name")
    old, new = c.where("id % 3 > 0"), c.where("id % 2 = 0")
    _, children = ops.upsert_with_children(old.select("id", "title"), new.select("id", "title"), ["id"], ["title"], old.select(F.col("id").alias("group_id"), F.lit("old").alias("artist")), new.select(F.col("id").alias("group_id"), F.col("n_name").alias("artist")), "group_id", "id")
    return children


@query("token_list", """
with t as (select sha256('tok_' || c_custkey) as h, c_name as name, c_custkey as k from customer)
select substr(h, 1, 12) as id, name, case when k % 4 = 0 then 'revoked' when k % 3 = 0 then 'expired' else 'active' end as state from t""")
def token_list(spark, sf_dir):
    ts = lambda x: F.to_timestamp(F.lit(x))
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("tok_"), "c_custkey").alias("secret"), F.col("c_name").alias("name"), F.col("c_custkey").alias("k"))
    new = lambda d, days: ops.issued(d, "name", "secret", ts("2026-01-01"), days)
    t = new(c.where("k % 3 = 0"), 30).unionByName(new(c.where("k % 3 > 0"), None))
    gone = c.where("k % 4 = 0").select(F.sha2("secret", 256).alias("token_hash"))
    return ops.listed(ops.revoked(t, "token_hash", gone, ts("2026-01-02")), ts("2026-03-01")).select("id", "name", "state")
