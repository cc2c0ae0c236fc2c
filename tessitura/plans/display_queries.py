"""Display, request and name rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.functions import display, levels, text
from tessitura.operators import documents
from tessitura.plans.catalog_tables import read
from tessitura.plans.registry import query

_MEDIA = ('12" Vinyl', "LP", "Hybrid SACD", "DVD-Audio", "Blu-Ray Audio", "CD", "Enhanced CD", "Digital Media", "Download", "Cassette", "")
_SHOWN = ("Vinyl", "Vinyl", "SACD", "DVD", "Blu-ray", "CD", "CD", "Digital", "Digital", "Cassette", "Digital")
_CODES = ("XE", "XW", "XN", "US", "UK", "GB", "DE", "FR", "JP", "NL", "SE", "")
_COUNTRIES = ("Europe", "Worldwide", "Northern Europe", "United States", "United Kingdom", "United Kingdom", "Germany", "France", "Japan", "Netherlands", "SE", "")


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("display_names", f"""
select p_partkey as id, {_list(_COUNTRIES)}[p_partkey % 12 + 1] as country, {_list(_SHOWN)}[p_partkey % 11 + 1] as medium,
  array_to_string([x for x in [case when p_size % 3 > 0 then cast(1950 + p_size as varchar) end, case when p_size % 4 > 0 then {_list(_SHOWN)}[p_partkey % 11 + 1] || case when p_size % 4 = 2 then '/CD' else '' end end,
    case when p_size % 5 > 1 then (p_size % 5) || ' versions' end] if x is not null], ' · ') as line from part""")
def display_names(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    kinds = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 2, F.array(_pick(_MEDIA, k), F.lit("CD-R"))).otherwise(F.array(_pick(_MEDIA, k)))
    return read(spark, sf_dir, "part").select(k.alias("id"), display.country_name(_pick(_CODES, k)).alias("country"), display.medium_name(_pick(_MEDIA, k)).alias("medium"),
                                              display.collector_line(F.when(n % 3 > 0, (1950 + n).cast("string")).otherwise(""), kinds, n % 5).alias("line"))


@query("display_dates", """select o_orderkey as id, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%-d %b %Y') when 1 then strftime(o_orderdate, '%b %Y') when 2 then 'Jan ' || strftime(o_orderdate, '%Y') else '' end as shown,
  case when o_orderkey % 4 < 3 then strftime(o_orderdate, '%Y') end as year from orders""")
def display_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    d = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 4 == 1, F.date_format("o_orderdate", "yyyy-MM")).when(k % 4 == 2, F.date_format("o_orderdate", "yyyy")).otherwise("")
    return read(spark, sf_dir, "orders").select(k.alias("id"), display.date_display(d).alias("shown"), text.year(d).alias("year"))


@query("client_routes", """
select o_orderkey as id, ['albums', 'albums', 'album', 'artists', 'artist', 'queue', 'notfound', 'notfound'][o_orderkey % 8 + 1] as name, case when o_orderkey % 8 in (2, 4) then cast(o_orderkey as varchar) end as target,
  case when o_orderkey % 3 = 0 then 'q=' || o_custkey || '&p=?' else '' end as query from orders""")
def client_routes(spark, sf_dir):
    k = F.col("o_orderkey")
    id_ = k.cast("string")
    path = F.when(k % 8 == 0, "/").when(k % 8 == 1, "/albums/").when(k % 8 == 2, F.concat(F.lit("/albums/"), id_)).when(k % 8 == 3, "/artists").when(k % 8 == 4, F.concat(F.lit("/artists/"), id_)).when(k % 8 == 5, "/queue").when(k % 8 == 6, "/albums/x").otherwise(F.concat(F.lit("/artists/"), id_, F.lit("/more")))
    o = read(spark, sf_dir, "orders").select(k.alias("id"), F.concat(path, F.when(k % 3 == 0, F.concat(F.lit("?q="), "o_custkey", F.lit("&p=?"))).otherwise("")).alias("path"))
    return o.withColumn("r", display.route(F.col("path"))).select("id", "r.name", F.col("r.id").alias("target"), "r.query")


@query("request_credentials", """
with c as (select c_custkey as id, 'tok_' || c_custkey as secret from customer)
select id, case when id % 4 in (0, 1) then secret end as cookie, case when id % 5 in (0, 1, 2) then secret end as token, id % 4 in (0, 1) and id % 3 <> 0 and id % 7 >= 3 as ok from c""")
def request_credentials(spark, sf_dir):
    k = F.col("c_custkey")
    secret = F.concat(F.lit("tok_"), k)
    header = F.when(k % 4 == 0, F.concat(F.lit("a=b; sid="), secret, F.lit("; c=d"))).when(k % 4 == 1, F.concat(F.lit("sid2=x;sid="), secret)).when(k % 4 == 2, "sid=; a=b").otherwise("other=1")
    body = F.when(k % 5 == 0, F.concat(F.lit('{"token":"'), secret, F.lit('"}'))).when(k % 5 == 1, F.concat(F.lit('{"x": 1, "token" : "'), secret, F.lit('", "y": 2}'))).when(k % 5 == 2, F.concat(F.lit('{"token"\t:\t"'), secret, F.lit('"}'))).when(k % 5 == 3, '{"token": 5}').otherwise("{}")
    c = read(spark, sf_dir, "customer").select(k.alias("id"), display.cookie(header, "sid").alias("cookie"), display.body_token(body).alias("token"), F.sha2(secret, 256).alias("digest"), F.when(k % 3 == 0, 1).alias("revoked"), (k % 7).alias("expires"))
    return c.select("id", "cookie", "token", display.credential_ok(F.col("cookie"), F.col("digest"), F.col("revoked"), F.col("expires"), F.lit(3)).alias("ok"))


@query("encoder_names", """
with e as (select event_id as id, cast(event_id % 117 as int) as v, cast(1 + event_id % 3 as int) as a, cast(event_id % 32 as int) as b, cast(event_id % 9 as int) as c from events)
select id, case when v = 0 then 'not recorded' when v % 10 = 0 then 'Release ' || (v // 100) || '.' || (v // 10 % 10) when v % 10 in (2, 4, 6, 8) then 'Beta ' || (v // 100) || '.' || lpad(cast(v % 100 as varchar), 2, '0')
  else '--Alpha-- ' || (v // 100) || '.' || lpad(cast(v % 100 as varchar), 2, '0') end as old,
  case when a * 100 + b > 116 then case when b % 2 = 1 then '--Unstable-- ' else '--Stable-- ' end || a || '.' || b || '.' || c
    when b % 10 = 0 then 'Release ' || ((a * 100 + b) // 100) || '.' || ((a * 100 + b) // 10 % 10) when b % 2 = 0 then 'Beta ' || a || '.' || lpad(cast(b as varchar), 2, '0') else '--Alpha-- ' || a || '.' || lpad(cast(b as varchar), 2, '0') end as new,
  case when v % 20 between 7 and 13 then ['''Telephone''', '''Thumb''', '''Radio''', '''Standard''', '''Extreme''', '''Insane''', '''BrainDead'''][v % 20 - 6] when v % 20 = 1 then '''Unstable/Experimental''' when v % 20 = 5 then '''quality 0''' when v % 20 = 6 then '''quality 1''' when v % 20 = 14 then '''quality 9''' when v % 20 = 15 then '''quality 10''' else 'n.a.' end as profile
from e""")
def encoder_names(spark, sf_dir):
    i = F.col("event_id")
    packed = (1 + i % 3) * (1 << 24) + i % 32 * (1 << 16) + i % 9 * 256
    return read(spark, sf_dir, "events").select(i.alias("id"), display.encoder_name(F.lit(7), i % 117).alias("old"), display.encoder_name(F.lit(8), packed).alias("new"), display.profile_name((i % 117 % 20).cast("double") + 0.5).alias("profile"))


@query("replay_scales", """
with e as (select event_id as id, event_id % 9 * 2000 as gain, event_id % 7 * 4000 as peak, event_id % 2 = 0 as use, event_id % 3 = 0 as prevent from events),
f as (select *, case when peak = 0 then 1.0 else 32768 / pow(10.0::double, peak / 5120.0::double) end as room, case when gain = 0 then 1.0 else pow(10.0::double, (89.0::double - gain / 256.0::double) / 20) end as want from e)
select id, round(case when not use and not prevent then 1.0 when prevent and (room < want or not use) then room else want end, 9) as scale, cast(case when peak = 0 then 0 else floor(20 * log10(peak) * 256 + 0.5) end as int) as old_peak,
  round(0.5::double * pow(10.0::double, -(id % 30) / 20.0::double), 9) as volume, round(case when gain > 0 then (id % 100000) * 8.0::double * 44100 / gain else 0 end, 6) as bitrate from f""")
def replay_scales(spark, sf_dir):
    i = F.col("event_id")
    e = read(spark, sf_dir, "events").select(i.alias("id"), (i % 9 * 2000).alias("gain"), (i % 7 * 4000).alias("peak"), (i % 2 == 0).alias("use"), (i % 3 == 0).alias("prevent"))
    return e.select("id", F.round(levels.replay_scale(F.col("gain"), F.col("peak"), 89.0, F.col("use"), F.col("prevent")), 9).alias("scale"), levels.legacy_peak(F.col("peak")).cast("int").alias("old_peak"),
                    F.round(levels.combined_gain(F.lit(0.5), -(F.col("id") % 30).cast("double")), 9).alias("volume"), F.round(levels.bitrate((F.col("id") % 100000), F.col("gain"), F.lit(44100)), 6).alias("bitrate"))


@query("profile_mix", """
with p as (select list(n_regionkey * 1.5::double order by n_nationkey) as a, list(n_nationkey % 7 order by n_nationkey) as b from nation),
q as (select p_partkey as id, (p_partkey % 300) / 10.0::double - 2 as q from part), r as (select id, least(greatest(q, 0), 24) as q from q), s as (select id, cast(floor(q) as int) as i, q - floor(q) as mix from r)
select id, round(a[i + 1] * (1 - mix) + a[least(i + 1, 24) + 1] * mix, 9) as level, cast(b[i + 1] as bigint) as step from s, p""")
def profile_mix(spark, sf_dir):
    p = read(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", (F.col("n_regionkey") * 1.5).alias("level"), (F.col("n_nationkey") % 7).cast("long").alias("step")))).alias("p"))
    d = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") % 300) / 10.0 - 2).alias("q")).join(F.broadcast(p))  # one row
    d = d.withColumn("r", levels.at_quality(F.col("q"), F.col("p"), ["level"], ["step"]))
    return d.select("id", F.round("r.level", 9).alias("level"), "r.step")


@query("name_rules", r"""
with p as (select p_partkey as id, p_name || case p_partkey % 4 when 0 then '/x' when 1 then ':"y"' when 2 then chr(10) || 'z\' else '' end as title from part)
select id, lpad(cast(id % 100 as varchar), 2, '0') || ' - ' || replace(replace(replace(replace(title, '/', '_'), ':', '_'), chr(10), '_'), '\', '_') || '.flac' as target,
  '"' || replace(replace(replace(title, '\', '\\'), '"', '\"'), chr(10), '\n') || '"' as json, replace(replace(rtrim(to_base64(encode(title)), '='), '+', '-'), '/', '_') as token,
  id % 3 = 0 as uuid, id % 2 = 0 as digits, case when id % 5 > 0 then 'lib/a/' || id else null end as within, id % 4 <> 2 and id % 6 <> 0 as tag_ok from p""")
def name_rules(spark, sf_dir):
    k = F.col("p_partkey")
    title = F.concat("p_name", F.when(k % 4 == 0, "/x").when(k % 4 == 1, ':"y"').when(k % 4 == 2, "\nz\\").otherwise(""))
    p = read(spark, sf_dir, "part").select(k.alias("id"), title.alias("title"))
    i = F.col("id")
    hexa = F.lpad(F.hex(i), 12, "0")
    uuid = F.when(i % 3 == 0, F.concat(F.lit("0a1B2c3D-0000-4000-8000-"), hexa)).otherwise(F.concat(F.lit("0a1B2c3D-0000-4000-8000"), hexa))
    key = F.when(i % 4 == 2, "A\tB").when(i % 6 == 0, "").otherwise("Title")
    return p.select("id", text.target_name((i % 100).cast("int"), F.col("title"), F.lit("flac")).alias("target"), text.json_text(F.col("title")).alias("json"), text.url_token(F.encode("title", "UTF-8")).alias("token"),
                    text.is_uuid(uuid).alias("uuid"), text.all_digits(F.when(i % 2 == 0, i.cast("string")).otherwise(F.concat(i, F.lit("x")))).alias("digits"),
                    text.contained(F.lit("lib/"), F.when(i % 5 > 0, F.concat(F.lit("a/"), i)).otherwise(F.concat(F.lit("../"), i))).alias("within"), documents.valid_tag(key, F.col("title"), F.lit(False)).alias("tag_ok"))
