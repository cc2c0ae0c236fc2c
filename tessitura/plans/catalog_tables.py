"""The catalog in the driver's tables: nations are artists, customers albums, orders releases with their package, line
items tracks, parts audio files, return flags assets. `SQL` says the same for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators.catalog import Catalog


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    nation, customer, orders, lineitem = (read(spark, sf_dir, t) for t in ("nation", "customer", "orders", "lineitem"))
    key = F.col("c_custkey")
    artists = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    groups = customer.select(key.alias("id"), F.col("c_name").alias("title"), F.lower("c_mktsegment").alias("release_type"), (1950 + key % 70).cast("string").alias("original_date"), (key * 7919 % 100000).alias("created_at"))
    first = customer.select(key.alias("group_id"), F.col("c_nationkey").cast("long").alias("artist_id"), F.lit(0).alias("position"), F.lit("main").alias("role"))
    second = customer.where(key % 3 == 0).select(key.alias("group_id"), ((F.col("c_nationkey") + 7) % 25).cast("long").alias("artist_id"), F.lit(1).alias("position"), F.lit("featured").alias("role"))
    o = F.col("o_orderkey")
    releases = orders.select(o.alias("id"), F.col("o_custkey").alias("group_id"), F.col("o_orderpriority").alias("edition"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"),
                             F.when(o % 4 != 0, -5 - (o % 20) / 2.0).alias("album_lufs"), F.when(o % 4 != 0, -(o % 6) / 4.0).alias("album_peak_db"))
    status = F.when(F.col("o_orderstatus") == "F", "valid").when(F.col("o_orderstatus") == "O", "warning").otherwise("unavailable")
    packages = orders.select(o.alias("id"), o.alias("release_id"), F.concat(F.lit("lib/"), o, F.lit(".mpack")).alias("path"), status.alias("status"),
                             F.sha2(F.concat(o, F.lit(":"), F.date_format("o_orderdate", "yyyy-MM-dd")), 256).alias("fingerprint"), F.sha2(F.col("o_orderpriority"), 256).alias("manifest_sha256"), F.lit("s1").alias("last_scan"))
    line = lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_quantity").alias("q"), F.min("l_discount").alias("d"))
    disc = F.when(F.col("l_linenumber") <= 4, 1).otherwise(2)
    media = line.select("l_orderkey", disc.alias("disc")).distinct()
    form = F.when(F.col("l_orderkey") % 5 == 0, F.lit(None)).when(F.col("disc") == 1, "CD").when(F.col("l_orderkey") % 2 == 0, "Vinyl").otherwise("CD")
    media = media.select((F.col("l_orderkey") * 10 + F.col("disc")).alias("id"), F.col("l_orderkey").alias("release_id"), F.col("disc").alias("disc_number"), F.col("disc").alias("position"), form.alias("format"))
    track = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    tracks = line.select(track.alias("id"), (F.col("l_orderkey") * 10 + disc).alias("media_id"), F.col("l_linenumber").alias("number"), F.concat(F.lit("Track "), "l_linenumber").alias("title"), (F.col("q") * 10).alias("duration"), F.round(-6 - F.col("d") * 100, 2).alias("lufs"))
    audio = line.select(track.alias("id"), track.alias("track_id"), F.concat(F.lit("audio/"), "part", F.when(F.col("part") % 2 == 0, ".flac").otherwise(".ogg")).alias("path"), (F.col("part") * 1000).alias("size"), F.when(F.col("part") % 2 == 0, "audio/flac").otherwise("audio/ogg").alias("mime"))
    track_artists = line.select(track.alias("track_id"), (F.col("part") % 25).alias("artist_id"), F.lit(0).alias("position"), F.lit("main").alias("role"))
    a = lineitem.select("l_orderkey", "l_returnflag", "l_linestatus").distinct()
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 2).otherwise(4) + F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    kind = F.when(F.col("l_returnflag") == "A", "artwork").when(F.col("l_returnflag") == "N", "lyrics").otherwise("extra")
    assets = a.select((F.col("l_orderkey") * 10 + code).alias("id"), F.col("l_orderkey").alias("release_id"), kind.alias("kind"), F.when(F.col("l_linestatus") == "F", "front").otherwise("back").alias("role"), F.concat(kind, F.lit("/"), code, F.lit(".png")).alias("path"))
    return Catalog(artists, groups, first.unionByName(second), releases, media, tracks, track_artists, audio, assets, packages)


SQL = """
with artists as (select cast(n_nationkey as bigint) as id, n_name as name from nation),
groups as (select c_custkey as id, c_name as title, lower(c_mktsegment) as release_type, cast(1950 + c_custkey % 70 as varchar) as original_date, c_custkey * 7919 % 100000 as created_at from customer),
group_artists as (select c_custkey as group_id, cast(c_nationkey as bigint) as artist_id, 0 as position, 'main' as role from customer
  union all select c_custkey, cast((c_nationkey + 7) % 25 as bigint), 1, 'featured' from customer where c_custkey % 3 = 0),
releases as (select o_orderkey as id, o_custkey as group_id, o_orderpriority as edition, strftime(o_orderdate, '%Y-%m-%d') as release_date,
  case when o_orderkey % 4 <> 0 then -5 - (o_orderkey % 20) / 2.0::double end as album_lufs, case when o_orderkey % 4 <> 0 then -(o_orderkey % 6) / 4.0::double end as album_peak_db from orders),
packages as (select o_orderkey as id, o_orderkey as release_id, 'lib/' || o_orderkey || '.mpack' as path, case o_orderstatus when 'F' then 'valid' when 'O' then 'warning' else 'unavailable' end as status from orders),
line as (select l_orderkey, l_linenumber, min(l_partkey) as part, min(l_quantity) as q, min(l_discount) as d, case when l_linenumber <= 4 then 1 else 2 end as disc from lineitem group by l_orderkey, l_linenumber),
media as (select distinct l_orderkey * 10 + disc as id, l_orderkey as release_id, disc as disc_number, disc as position,
  case when l_orderkey % 5 = 0 then null when disc = 1 then 'CD' when l_orderkey % 2 = 0 then 'Vinyl' else 'CD' end as format from line),
tracks as (select l_orderkey * 10 + l_linenumber as id, l_orderkey * 10 + disc as media_id, l_linenumber as number, 'Track ' || l_linenumber as title, q * 10 as duration, round(-6 - d * 100, 2) as lufs from line),
audio as (select l_orderkey * 10 + l_linenumber as track_id, 'audio/' || part || case when part % 2 = 0 then '.flac' else '.ogg' end as path, part * 1000 as size, case when part % 2 = 0 then 'audio/flac' else 'audio/ogg' end as mime from line),
track_artists as (select l_orderkey * 10 + l_linenumber as track_id, part % 25 as artist_id, 0 as position, 'main' as role from line),
a0 as (select distinct l_orderkey, case l_returnflag when 'A' then 0 when 'N' then 2 else 4 end + case l_linestatus when 'F' then 0 else 1 end as code,
  case l_returnflag when 'A' then 'artwork' when 'N' then 'lyrics' else 'extra' end as kind, case l_linestatus when 'F' then 'front' else 'back' end as role from lineitem),
assets as (select l_orderkey * 10 + code as id, l_orderkey as release_id, kind, role, kind || '/' || code || '.png' as path from a0),
seen as (select * from releases where id in (select release_id from packages where status not in ('invalid', 'unavailable'))),
best as (select release_id, id as package_id, status, path as package_path from packages qualify row_number() over (partition by release_id order by case when status = 'unavailable' then 1 else 0 end, id) = 1)
"""
