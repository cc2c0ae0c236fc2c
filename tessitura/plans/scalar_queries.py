"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.functions import bits, levels, media, text
from tessitura.plans.catalog_tables import read
from tessitura.plans.registry import query


@query("text_rules", r"""
with p as (select p_partkey as id, p_name, p_type, p_partkey % 13 as k from part),
v as (select *, case k when 0 then '' when 1 then '/' || p_name when 2 then 'a/../' || p_name when 3 then 'a//b' when 4 then 'a/./b' when 5 then 'a\b' when 6 then 'c:' || p_name when 7 then 'dir/' else 'audio/' || p_name end as path,
  case k when 0 then '12a' when 1 then '' when 2 then '1234567890123456789' else cast(id as varchar) end as raw_id from p)
select id, path, len(path) > 0 and path not like '%\%' and path not like '%:%' and path not like '/%' and path not like '%/' and path not like '%//%' and not regexp_matches(path, '(^|/)[.]{1,2}(/|$)') as path_ok,
  case when regexp_matches(raw_id, '^[0-9]{1,18}$') then cast(raw_id as bigint) end as strict_id,
  '%' || replace(replace(replace(p_name || '_%', '\', '\\'), '%', '\%'), '_', '\_') || '%' as like_pattern,
  lower(p_type) as folded, starts_with(path, 'audio/') as inside,
  least(greatest(id - 50, 1), 200) as page_limit
from v""")
def text_rules(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type", (F.col("p_partkey") % 13).alias("k"))
    n, k = F.col("p_name"), F.col("k")
    path = F.when(k == 0, "").when(k == 1, F.concat(F.lit("/"), n)).when(k == 2, F.concat(F.lit("a/../"), n)).when(k == 3, "a//b").when(k == 4, "a/./b").when(k == 5, "a\\b").when(k == 6, F.concat(F.lit("c:"), n)).when(k == 7, "dir/").otherwise(F.concat(F.lit("audio/"), n))
    raw = F.when(k == 0, "12a").when(k == 1, "").when(k == 2, "1234567890123456789").otherwise(F.col("id").cast("string"))
    p = p.withColumns({"path": path, "raw_id": raw})
    return p.select("id", "path", text.path_ok(F.col("path")).alias("path_ok"), text.strict_id(F.col("raw_id")).alias("strict_id"), text.like_pattern(F.concat(n, F.lit("_%"))).alias("like_pattern"),
                    text.fold(F.col("p_type")).alias("folded"), text.inside(F.lit("audio"), F.col("path")).alias("inside"), text.clamped((F.col("id") - 50).cast("string"), 50, 1, 200).cast("long").alias("page_limit"))


@query("hash_identity", """
select p_partkey as id, sha256(p_name) as digest, 'h:' || sha256('title=' || p_name || chr(10) || 'date=' || p_size || chr(10) || 'type=' || p_type || chr(10) || 'artist=' || p_brand || chr(10) || 'role=main' || chr(10)) as group_key,
  'h:' || sha256(case when p_size % 2 = 0 then 'edition=' || p_type || chr(10) else '' end || 'country=XE' || chr(10)) as release_key
from part""")
def hash_identity(spark, sf_dir):
    p, null = read(spark, sf_dir, "part"), F.lit(None).cast("string")
    artists = F.array(F.struct(F.col("p_brand").alias("name"), F.lit("main").alias("role")))
    return p.select(F.col("p_partkey").alias("id"), F.sha2("p_name", 256).alias("digest"), text.group_key(null, F.col("p_name"), F.col("p_size").cast("string"), F.col("p_type"), artists).alias("group_key"),
                    text.release_key(null, edition=F.when(F.col("p_size") % 2 == 0, F.col("p_type")), country=F.lit("XE")).alias("release_key"))


@query("media_lookup", """
with p as (select p_partkey as id, 'dir.x/' || p_partkey || case p_partkey % 9 when 0 then '.FLAC' when 1 then '.jpeg' when 2 then '.ogg' when 3 then '' when 4 then '.Md' when 5 then '.wav' when 6 then '.exe' when 7 then '.woff2' else '.lrc' end as path,
  case p_partkey % 5 when 0 then 'Live Album' when 1 then 'EP' when 2 then '' when 3 then 'bootleg' else 'Remix' end as tag, p_partkey from part)
select id, path, case id % 9 when 0 then 'audio/flac' when 1 then 'image/jpeg' when 2 then 'audio/ogg' when 4 then 'text/plain' when 5 then 'audio/wav' when 7 then 'font/woff2' when 8 then 'text/plain' else 'application/octet-stream' end as mime,
  case id % 9 when 0 then 'flac' when 2 then 'vorbis' when 5 then 'wav' else 'unknown' end as codec,
  case id % 5 when 0 then 'live-album' when 1 then 'ep' when 3 then 'other' when 4 then 'remix-album' end as release_type,
  case id % 10 when 3 then 'front' when 4 then 'back' when 7 then 'booklet-page' when 8 then 'medium' else 'other' end as picture_role
from p""")
def media_lookup(spark, sf_dir):
    k = F.col("p_partkey")
    ends = [".FLAC", ".jpeg", ".ogg", "", ".Md", ".wav", ".exe", ".woff2", ".lrc"]
    tags = ["Live Album", "EP", "", "bootleg", "Remix"]
    pick = lambda vs: F.element_at(F.array(*map(F.lit, vs)), (k % len(vs) + 1).cast("int"))
    p = read(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("dir.x/"), k, pick(ends)).alias("path"), pick(tags).alias("tag"))
    return p.select("id", "path", media.mime(F.col("path")).alias("mime"), media.codec(F.col("path")).alias("codec"), media.release_type(F.col("tag")).alias("release_type"), media.picture_role(F.col("id") % 10).alias("picture_role"))


@query("name_heuristics", r"""
with p as (select p_partkey as id, lpad(cast(p_partkey % 30 as varchar), 2, '0') || ' - ' || p_name || '.flac' as file, case p_partkey % 4 when 0 then 'CD ' || (p_partkey % 7 + 1) when 1 then 'disc' || (p_partkey % 7 + 1) when 2 then 'Disk-2' else 'Bonus' end as dir, (p_partkey % 12) || '/12' as tag from part)
select id, file, case when id % 30 >= 1 then cast(id % 30 as int) end as number, regexp_replace(regexp_replace(file, '[.][^.]*$', ''), '^[0-9]+[ ._-]*', '') as title,
  cast(case id % 4 when 0 then id % 7 + 1 when 1 then id % 7 + 1 when 2 then 2 else 1 end as int) as disc, case when id % 12 >= 1 then cast(id % 12 as int) end as tag_number
from p""")
def name_heuristics(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_name")
    d = F.when(k % 4 == 0, F.concat(F.lit("CD "), k % 7 + 1)).when(k % 4 == 1, F.concat(F.lit("disc"), k % 7 + 1)).when(k % 4 == 2, "Disk-2").otherwise("Bonus")
    p = read(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lpad((k % 30).cast("string"), 2, "0"), F.lit(" - "), n, F.lit(".flac")).alias("file"), d.alias("dir"), F.concat(k % 12, F.lit("/12")).alias("tag"))
    return p.select("id", "file", media.name_number(F.col("file")).alias("number"), media.name_title(F.col("file")).alias("title"), media.disc_of(F.col("dir")).alias("disc"), media.track_number(F.col("tag")).alias("tag_number"))


@query("byte_ranges", """
with p as (select p_partkey as id, p_size as n, cast(p_partkey % 40 as bigint) as size from part),
v as (select *, case id % 6 when 0 then 'bytes=' || n || '-' when 1 then 'bytes=-' || n when 2 then 'bytes=' || (n % 20) || '-' || n when 3 then 'items=0-1' when 4 then 'bytes=' || n || '-' || (n // 2) else 'bytes=0-1,5-6' end as header from p),
s as (select *, case id % 6 when 0 then case when n >= size then 'unsatisfiable' else 'ok' end
  when 1 then case when n = 0 then 'invalid' when size = 0 then 'unsatisfiable' else 'ok' end
  when 2 then case when n % 20 >= size then 'unsatisfiable' when n < n % 20 then 'invalid' else 'ok' end
  when 4 then case when n >= size then 'unsatisfiable' when n // 2 < n then 'invalid' else 'ok' end else 'invalid' end as state from v),
t as (select *, case id % 6 when 0 then n when 1 then size - least(n, size) when 2 then n % 20 when 4 then n end as a, case id % 6 when 0 then size when 1 then size when 2 then least(n, size - 1) + 1 when 4 then least(n // 2, size - 1) + 1 end as b from s)
select id, header, size, state, case when state = 'ok' then cast(a as bigint) end as start, case when state = 'ok' then cast(b - a as bigint) end as length from t""")
def byte_ranges(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    h = F.when(k % 6 == 0, F.concat(F.lit("bytes="), n, F.lit("-"))).when(k % 6 == 1, F.concat(F.lit("bytes=-"), n)).when(k % 6 == 2, F.concat(F.lit("bytes="), n % 20, F.lit("-"), n)).when(k % 6 == 3, "items=0-1").when(k % 6 == 4, F.concat(F.lit("bytes="), n, F.lit("-"), F.floor(n / 2))).otherwise("bytes=0-1,5-6")
    p = read(spark, sf_dir, "part").select(k.alias("id"), h.alias("header"), (k % 40).alias("size"))
    return p.withColumn("r", media.byte_range(F.col("header"), F.col("size"))).select("id", "header", "size", "r.state", "r.start", "r.length")


@query("playback_gain", """
with e as (select event_id as id, -round(value, 2) % 40 as lufs, case when event_id % 3 = 0 then null else -(event_id % 50) / 10.0::double end as peak, case event_id % 4 when 0 then 'off' when 1 then 'album' else 'track' end as mode from events),
m as (select *, case mode when 'album' then lufs - 1 else lufs end as measured from e)
select id, mode, round(case when mode = 'off' then 0.0 when peak is not null and -1 - peak < -16 - measured then -1 - peak else -16 - measured end, 6) as gain from m""")
def playback_gain(spark, sf_dir):
    i = F.col("event_id")
    e = read(spark, sf_dir, "events").select(i.alias("id"), (-F.round("value", 2) % 40).alias("lufs"), F.when(i % 3 != 0, -(i % 50) / 10.0).alias("peak"), F.when(i % 4 == 0, "off").when(i % 4 == 1, "album").otherwise("track").alias("mode"))
    return e.select("id", "mode", F.round(levels.playback_gain(F.col("mode"), F.col("lufs"), F.col("peak"), F.col("lufs") - 1, F.col("peak")), 6).alias("gain"))


@query("legacy_levels", """
select event_id as id, case when event_id % 2000 = 0 then 0 else cast(floor((64.82::double - (event_id % 2000) / 100.0::double) * 256 + 0.5) as int) end as gain,
  round(pow(10.0, (event_id % 40 - 20) / 20.0::double), 9) as factor, cast(floor((event_id % 600) / 10.0::double * 44100 + 0.5) as bigint) as sample, cast(floor(44100 * (event_id % 5000) / 75.0::double) as bigint) as cue_sample,
  (event_id % 90 - 75) between -70 and 6 as plausible
from events""")
def legacy_levels(spark, sf_dir):
    i = F.col("event_id")
    e = read(spark, sf_dir, "events")
    return e.select(i.alias("id"), levels.legacy_gain(i % 2000).alias("gain"), F.round(levels.to_linear((i % 40 - 20).cast("double")), 9).alias("factor"), levels.sample_at((i % 600) / 10.0, F.lit(44100)).alias("sample"),
                    levels.cue_sample(i % 5000, F.lit(44100)).alias("cue_sample"), levels.plausible((i % 90 - 75).cast("double")).alias("plausible"))


@query("varint_codes", """
with n as (select l_orderkey * 131 + l_partkey * 7 as n from lineitem)
select n, array_to_string([x for x in [case when n >= 268435456 then (n >> 28) & 127 | 128 end, case when n >= 2097152 then (n >> 21) & 127 | 128 end, case when n >= 16384 then (n >> 14) & 127 | 128 end, case when n >= 128 then (n >> 7) & 127 | 128 end, n & 127] if x is not null], ',') as bytes, n as back,
  case when n < 128 then 1 when n < 16384 then 2 when n < 2097152 then 3 when n < 268435456 then 4 else 5 end as size,
  (n >> 3) + 1 + 3 as golomb_bits, case when n % 2 = 1 then -(n >> 1) else n >> 1 end as signed, cast(bit_count(n) % 2 as int) as parity
from n""")
def varint_codes(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 131 + F.col("l_partkey") * 7).alias("n")).withColumn("v", bits.varint(F.col("n")))
    return d.select("n", F.array_join("v", ",").alias("bytes"), bits.from_varint(F.col("v")).alias("back"), bits.varint_size(F.col("n")).alias("size"), bits.golomb(F.col("n"), 3)["bits"].alias("golomb_bits"), bits.from_sign_in_low_bit(F.col("n")).alias("signed"), bits.parity(F.col("n")).alias("parity"))


@query("truncated_codes", """
with n as (select p_partkey as id, p_size % 21 as n from part)
select id, n, case when n < 11 then 4 else 5 end as bits from n""")
def truncated_codes(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 21).alias("n"))
    return p.select("id", "n", bits.truncated_bits(F.col("n"), F.lit(20)).alias("bits"))


@query("enumerative_codes", """
with m as (select distinct cast(p_partkey % 256 as int) as m from part),
b as (select m, i, (m >> i) & 1 as one from m, range(8) t(i)),
c as (select m, i, one, sum(one) over (partition by m order by i) as k from b),
f as (select *, case when one = 1 and i >= k then (select product(i - j + 0.0) / product(j + 1.0) from range(cast(k as bigint)) u(j)) when one = 1 then 0 end as part from c)
select cast(m as bigint) as m, cast(round(coalesce(sum(part), 0)) as bigint) as rank, cast(bit_count(m) as int) as ones from f group by m""")
def enumerative_codes(spark, sf_dir):
    m = read(spark, sf_dir, "part").select((F.col("p_partkey") % 256).alias("m")).distinct()
    b = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.call_function("shiftright", F.col("m"), i).bitwiseAND(F.lit(1)))
    return m.select("m", bits.enumerative_index(b, 8).alias("rank"), F.bit_count("m").alias("ones"))


@query("clock_display", """
select event_id as id, case when event_id * 7 >= 3600 then (event_id * 7 // 3600) || ':' || lpad(cast(event_id * 7 // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(event_id * 7 % 60 as varchar), 2, '0') else (event_id * 7 // 60) || ':' || lpad(cast(event_id * 7 % 60 as varchar), 2, '0') end as clock,
  case when event_id % 3 = 0 then null else strftime(ts, '%Y') end as year from events""")
def clock_display(spark, sf_dir):
    i = F.col("event_id")
    date = F.when(i % 3 == 0, F.lit("unknown")).when(i % 3 == 1, F.date_format("ts", "yyyy")).otherwise(F.date_format("ts", "yyyy-MM"))
    return read(spark, sf_dir, "events").select(i.alias("id"), text.clock(i * 7).alias("clock"), text.year(date).alias("year"))


@query("json_properties", "select event_id as id, cast(props ->> '$.k' as int) as k from events")
def json_properties(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k int")["k"].alias("k"))


@query("crc32_text", """
select p_partkey as id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(p_name, ''), lambda c: cast(ascii(c) as bigint))),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end))), 4294967295) as crc from part""")
def crc32_text(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.crc32("p_name").alias("crc"))
