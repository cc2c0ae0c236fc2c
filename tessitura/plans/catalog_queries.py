"""Catalog queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.operators import catalog as ops
from tessitura.plans.catalog_tables import SQL, catalog, read
from tessitura.plans.registry import query

_ALBUMS = """, albums as (select g.id, g.title, g.release_type, g.original_date, g.created_at,
  (select count(*) from seen s where s.group_id = g.id) as release_count,
  (select name from group_artists x join artists y on x.artist_id = y.id where x.group_id = g.id order by x.position, y.id limit 1) as artist,
  (select z.id from seen s join assets z on z.release_id = s.id where s.group_id = g.id and z.kind = 'artwork' and z.role = 'front' order by s.release_date, s.id, z.id limit 1) as cover_id
  from groups g where exists (select 1 from seen s where s.group_id = g.id))
"""
_ORDER = "order by lower(artist) nulls first, lower(title), original_date nulls first, id"


@query("albums_page", SQL + _ALBUMS + f"select * from albums {_ORDER} limit 50 offset 10")
def albums_page(spark, sf_dir):
    return ops.albums_page(catalog(spark, sf_dir), 50, 10)


@query("albums_search", SQL + _ALBUMS + f"""select * from albums a where lower(title) like '%07%' or exists (select 1 from group_artists x join artists y on x.artist_id = y.id where x.group_id = a.id and lower(y.name) like '%07%') {_ORDER} limit 200""")
def albums_search(spark, sf_dir):
    return ops.albums_page(catalog(spark, sf_dir), 200, 0, q="07")


@query("albums_recent", SQL + _ALBUMS + "select * from albums order by created_at desc, id desc limit 50")
def albums_recent(spark, sf_dir):
    return ops.albums_page(catalog(spark, sf_dir), 50, 0, recent=True)


@query("albums_total", SQL + "select count(*) as total from groups g where exists (select 1 from seen s where s.group_id = g.id)")
def albums_total(spark, sf_dir):
    return ops.albums_total(catalog(spark, sf_dir))


_ARTISTS = "select y.id, y.name, count(distinct x.group_id) as album_count from group_artists x join artists y on x.artist_id = y.id where x.group_id in (select group_id from seen) group by y.id, y.name"


@query("artists_page", SQL + _ARTISTS + " order by lower(y.name), y.id limit 10 offset 5")
def artists_page(spark, sf_dir):
    return ops.artists_page(catalog(spark, sf_dir), 10, 5)


@query("artists_total", SQL + f"select count(*) as total from ({_ARTISTS})")
def artists_total(spark, sf_dir):
    return ops.artists(catalog(spark, sf_dir)).agg(F.count("*").alias("total"))


@query("artist_albums", SQL + "select * from groups g where id in (select group_id from group_artists where artist_id = 7) and id in (select group_id from seen)")
def artist_albums(spark, sf_dir):
    return ops.artist_albums(catalog(spark, sf_dir), 7)


@query("album_releases", SQL + """, one as (select min(group_id) as g from seen),
n as (select m.release_id, count(*) as track_count from media m join tracks t on t.media_id = m.id group by 1),
f as (select release_id, string_agg(format, ',' order by p, format) as formats from (select release_id, format, min(position) as p from media where format is not null group by 1, 2) group by 1)
select s.id as release_id, s.edition, s.release_date, coalesce(n.track_count, 0) as track_count, f.formats,
  (select min(z.id) from assets z where z.release_id = s.id and kind = 'artwork' and role = 'front') as cover_id, b.package_id, b.status
from seen s left join n on n.release_id = s.id left join f on f.release_id = s.id join best b on b.release_id = s.id where s.group_id = 1""".replace("one as (select min(group_id) as g from seen),\n", ""))
def album_releases(spark, sf_dir):
    return ops.album_releases(catalog(spark, sf_dir), 1)


@query("release_tracks", SQL + """select m.id as media_id, m.disc_number, m.position, m.format, t.id as track_id, t.number, t.title, t.duration, t.lufs, a.path as audio_path, a.size, a.mime
from media m join tracks t on t.media_id = m.id join audio a on a.track_id = t.id where m.release_id = 1""")
def release_tracks(spark, sf_dir):
    return ops.release_tracks(catalog(spark, sf_dir), 1)


@query("release_detail", SQL + """, t as (select m.position, m.id, m.disc_number, m.format, t.number, '{"number":' || t.number || ',"track_id":' || t.id || ',"title":"' || t.title || '","duration":' || t.duration || ',"audio_path":"' || a.path || '","mime":"' || a.mime || '"}' as j
  from media m join tracks t on t.media_id = m.id join audio a on a.track_id = t.id where m.release_id = 1),
d as (select position, '{"position":' || position || ',"media_id":' || id || ',"disc_number":' || disc_number || coalesce(',"format":"' || format || '"', '') || ',"tracks":[' || string_agg(j, ',' order by number) || ']}' as j from t group by position, id, disc_number, format),
s as (select string_agg('{"id":' || id || ',"kind":"' || kind || '","role":"' || role || '","path":"' || path || '"}', ',' order by id) as j from assets where release_id = 1 and kind in ('artwork', 'booklet', 'lyrics')),
n as (select string_agg('{"name":"' || name || '","role":"' || role || '"}', ',' order by position) as j from group_artists x join artists y on x.artist_id = y.id where x.group_id = (select group_id from releases where id = 1))
select r.id as release_id, '{"album":"' || g.title || '","artists":[' || n.j || '],"edition":"' || r.edition || '","release_date":"' || r.release_date || '","status":"' || b.status || '","media":[' || (select string_agg(j, ',' order by position) from d) || '],"assets":[' || coalesce(s.j, '') || ']}' as json
from seen r join groups g on g.id = r.group_id join best b on b.release_id = r.id, n, s where r.id = 1""")
def release_detail(spark, sf_dir):
    return ops.release_detail(catalog(spark, sf_dir), 1)


_NAMES = "(select string_agg(name || '/' || role, ',' order by position) from group_artists x join artists y on x.artist_id = y.id where x.group_id = g.id)"


@query("album_detail", SQL + f"""select g.id, g.title, g.release_type as type, g.original_date as date, {_NAMES} as artists,
  (select string_agg(s.id || ':' || s.release_date || ':' || b.status || ':' || (select count(*) from media m join tracks t on t.media_id = m.id where m.release_id = s.id), ',' order by s.release_date, s.id) from seen s join best b on b.release_id = s.id where s.group_id = g.id) as releases from groups g where g.id = 1""")
def album_detail(spark, sf_dir):
    d = ops.album_detail(catalog(spark, sf_dir), 1)
    names = F.array_join(F.transform("album.artists", lambda x: F.concat_ws("/", x["name"], x["role"])), ",")
    rows = F.array_join(F.transform("releases", lambda x: F.concat_ws(":", x["release_id"], x["release_date"], x["status"], x["track_count"])), ",")
    return d.select("album.id", "album.title", F.col("album.releaseType").alias("type"), F.col("album.originalReleaseDate").alias("date"), names.alias("artists"), rows.alias("releases"))


@query("artist_detail", SQL + """select y.id, y.name, (select string_agg(g.id || ':' || g.title || ':' || g.release_type, ',' order by lower(g.title), g.id) from groups g where g.id in (select group_id from group_artists where artist_id = y.id) and g.id in (select group_id from seen)) as albums
from artists y where y.id = 7""")
def artist_detail(spark, sf_dir):
    d = ops.artist_detail(catalog(spark, sf_dir), 7)
    return d.select("id", "name", F.array_join(F.transform("albums", lambda x: F.concat_ws(":", x["id"], x["title"], x["releaseType"])), ",").alias("albums"))


@query("group_objects", SQL + f"select g.id, g.title, {_NAMES} as artists from groups g")
def group_objects(spark, sf_dir):
    c = catalog(spark, sf_dir)
    d = ops.group_objects(c, c.groups)
    return d.select("id", "album.title", F.array_join(F.transform("album.artists", lambda x: F.concat_ws("/", x["name"], x["role"])), ",").alias("artists"))


@query("track_objects", SQL + """select t.id, t.media_id, t.title, y.name || '/' || x.role as artists, t.lufs, a.size, a.mime, '/tracks/' || t.id || '/audio' as url
from tracks t join audio a on a.track_id = t.id left join track_artists x on x.track_id = t.id left join artists y on y.id = x.artist_id""")
def track_objects(spark, sf_dir):
    d = ops.track_objects(catalog(spark, sf_dir))
    return d.select("id", "media_id", "track.title", F.array_join(F.transform("track.artists", lambda x: F.concat_ws("/", x["name"], x["role"])), ",").alias("artists"), "track.loudness.lufs", "track.audio.size", F.col("track.audio.mimeType").alias("mime"), "track.audio.url")


@query("health", SQL + "select 'ok' as status, '1' as version, cast(4 as int) as schemaVersion, count(*) as packages, count(*) filter (status not in ('invalid', 'unavailable')) as visible from packages")
def health(spark, sf_dir):
    return ops.health(catalog(spark, sf_dir), "1", 4)


@query("track_detail", SQL + """select t.id as track_id, t.title, t.number, m.disc_number, m.release_id, g.id as group_id, g.title as album, a.path as audio_path, a.size, a.mime, b.package_id, b.status
from tracks t join media m on m.id = t.media_id join releases r on r.id = m.release_id join groups g on g.id = r.group_id join audio a on a.track_id = t.id join best b on b.release_id = r.id
where b.status not in ('invalid', 'unavailable')""")
def track_detail(spark, sf_dir):
    return ops.track_detail(catalog(spark, sf_dir))


@query("resolve_audio", SQL + "select t.id as track_id, b.package_id, b.status, b.package_path || '/' || a.path as file, a.size, a.mime from tracks t join media m on m.id = t.media_id join audio a on a.track_id = t.id join best b on b.release_id = m.release_id")
def resolve_audio(spark, sf_dir):
    return ops.resolve_audio(catalog(spark, sf_dir))


@query("resolve_assets", SQL + "select a.id as asset_id, a.kind, a.role, b.package_id, b.status, b.package_path || '/' || a.path as file from assets a join best b on b.release_id = a.release_id where a.kind in ('artwork', 'booklet', 'lyrics')")
def resolve_assets(spark, sf_dir):
    return ops.resolve_assets(catalog(spark, sf_dir))


@query("artists_by_album", SQL + "select group_id, string_agg(name || '/' || role, ',' order by position) as artists from group_artists x join artists y on x.artist_id = y.id group by 1")
def artists_by_album(spark, sf_dir):
    a = ops.artists_by_group(catalog(spark, sf_dir))
    return a.select("group_id", F.array_join(F.transform("artists", lambda x: F.concat_ws("/", x["name"], x["role"])), ",").alias("artists"))


@query("media_formats", SQL + "select release_id, string_agg(format, ',' order by p, format) as formats from (select release_id, format, min(position) as p from media where format is not null group by 1, 2) group by 1")
def media_formats(spark, sf_dir):
    return ops.formats(catalog(spark, sf_dir))


@query("medium_label", SQL + """, m as (select release_id, count(*) as n, count(distinct format) as k, min_by(format, position) as first from media where format is not null group by 1),
d as (select release_id, string_agg(format, ' + ' order by p, format) as names from (select release_id, format, min(position) as p from media where format is not null group by 1, 2) group by 1)
select release_id, case when k > 1 then names when n > 1 then first || ' x ' || n else first end as label from m join d using (release_id)""")
def medium_label(spark, sf_dir):
    return ops.medium_label(catalog(spark, sf_dir))


@query("dominant_mime", SQL + "select m.release_id, case when count(distinct a.mime) = 1 then min(a.mime) end as mime from media m join tracks t on t.media_id = m.id join audio a on a.track_id = t.id group by 1")
def dominant_mime(spark, sf_dir):
    c = catalog(spark, sf_dir)
    rows = c.tracks.select(F.col("id").alias("track_id"), "media_id").join(c.audio.select("track_id", "mime"), "track_id").join(c.media.select(F.col("id").alias("media_id"), "release_id"), "media_id")
    return ops.only_value(rows, "release_id", "mime")


@query("live_sessions", """
with tokens as (select cast(c_custkey as varchar) as token_hash, c_name as name, case when c_custkey % 11 = 0 then 1 end as revoked_at, case when c_custkey % 7 = 0 then c_custkey % 1000 end as expires_at from customer),
sessions as (select cast(o_orderkey as varchar) as session_hash, cast(o_custkey as varchar) as token_hash, case when o_orderstatus = 'P' then 1 end as revoked_at, case when o_orderkey % 2 = 0 then o_orderkey % 1000 end as expires_at from orders)
select s.session_hash, s.token_hash, t.name from sessions s join tokens t on s.token_hash = t.token_hash where s.revoked_at is null and t.revoked_at is null and (s.expires_at is null or s.expires_at >= 500) and (t.expires_at is null or t.expires_at >= 500)""")
def live_sessions(spark, sf_dir):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    tokens = read(spark, sf_dir, "customer").select(k.cast("string").alias("token_hash"), F.col("c_name").alias("name"), F.when(k % 11 == 0, 1).alias("revoked_at"), F.when(k % 7 == 0, k % 1000).alias("expires_at"))
    s = read(spark, sf_dir, "orders").select(o.cast("string").alias("session_hash"), F.col("o_custkey").cast("string").alias("token_hash"), F.when(F.col("o_orderstatus") == "P", 1).alias("revoked_at"), F.when(o % 2 == 0, o % 1000).alias("expires_at"))
    return ops.sessions(s, tokens, F.lit(500))


@query("page_merge", "select c_custkey as id, case when c_mktsegment in ('BUILDING', 'MACHINERY', 'AUTOMOBILE') then c_name else 'page ' || c_name end as title from customer")
def page_merge(spark, sf_dir):
    """Known and page overlap in one segment and are all customers together; what is known stays as it is."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), "c_mktsegment")
    known = c.where("c_mktsegment in ('BUILDING', 'MACHINERY', 'AUTOMOBILE')").drop("c_mktsegment")
    page = c.where("c_mktsegment not in ('BUILDING', 'MACHINERY')").select("id", F.concat(F.lit("page "), "title").alias("title"))
    return ops.merge_page(known, page)


@query("assets_by_kind", SQL + "select kind, role, count(*) as n from assets group by 1, 2")
def assets_by_kind(spark, sf_dir):
    return catalog(spark, sf_dir).assets.groupBy("kind", "role").agg(F.count("*").alias("n"))


@query("catalog_summary", SQL + "select (select count(*) from artists) as artists, (select count(*) from groups) as albums, (select count(*) from seen) as releases, (select count(*) from tracks) as tracks, (select count(*) from packages where status = 'unavailable') as unavailable")
def catalog_summary(spark, sf_dir):
    c = catalog(spark, sf_dir)
    one = lambda d, n: d.agg(F.count("*").alias(n))
    out = one(c.artists, "artists")
    for d, n in ((c.groups, "albums"), (ops.visible_releases(c), "releases"), (c.tracks, "tracks"), (c.packages.where("status = 'unavailable'"), "unavailable")):
        out = out.join(F.broadcast(one(d, n)))  # one row each
    return out
