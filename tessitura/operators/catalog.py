"""Browse, search, detail and integrity queries over a catalog of albums.

A Catalog holds one DataFrame per table (columns as in `SCHEMAS`). Rows that a client sees need a package whose status is
neither invalid nor unavailable; a release with several packages is one release, its best package being a visible one with the
least id. Lists are totally ordered, so pages never overlap. What a client would fetch row by row (artists of an
album, formats of a release) is one grouped join here.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.text import fold, holds

HIDDEN = ("invalid", "unavailable")
SERVED_ASSETS = ("artwork", "booklet", "lyrics")

SCHEMAS = {
    "artists": "id bigint, name string",
    "groups": "id bigint, title string, release_type string, original_date string, created_at bigint",
    "group_artists": "group_id bigint, artist_id bigint, position int, role string",
    "releases": "id bigint, group_id bigint, edition string, release_date string, album_lufs double, album_peak_db double",
    "media": "id bigint, release_id bigint, disc_number int, position int, format string",
    "tracks": "id bigint, media_id bigint, number int, title string, duration double, lufs double",
    "track_artists": "track_id bigint, artist_id bigint, position int, role string",
    "audio": "id bigint, track_id bigint, path string, size bigint, mime string",
    "assets": "id bigint, release_id bigint, kind string, role string, path string",
    "packages": "id bigint, release_id bigint, path string, status string, fingerprint string, manifest_sha256 string, last_scan string",
}


@dataclass(frozen=True)
class Catalog:
    artists: DataFrame
    groups: DataFrame
    group_artists: DataFrame
    releases: DataFrame
    media: DataFrame
    tracks: DataFrame
    track_artists: DataFrame
    audio: DataFrame
    assets: DataFrame
    packages: DataFrame


def visible(status: Column) -> Column:
    return ~status.isin(*HIDDEN)


def best_of(packages: DataFrame) -> DataFrame:
    """(release_id, package_id, status, path): of a release's packages a visible one first, then the least id."""
    rank = F.struct((F.col("status") == "unavailable").alias("gone"), F.col("id").alias("id"))
    p = packages.where(F.col("release_id").isNotNull()).groupBy("release_id").agg(F.min_by(F.struct("id", "status", "path"), rank).alias("p"))
    return p.select("release_id", F.col("p.id").alias("package_id"), F.col("p.status").alias("status"), F.col("p.path").alias("package_path"))


def best_packages(c: Catalog) -> DataFrame:
    return best_of(c.packages)


def visible_releases(c: Catalog) -> DataFrame:
    seen = c.packages.where(visible(F.col("status"))).select(F.col("release_id").alias("id"))
    return c.releases.join(seen, "id", "left_semi")


def artist_rows(c: Catalog) -> DataFrame:
    return c.group_artists.join(c.artists.select(F.col("id").alias("artist_id"), "name"), "artist_id")


def artists_by_group(c: Catalog) -> DataFrame:
    """(group_id, artists): names and roles in order of position."""
    a = artist_rows(c).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("position", "name", "role"))).alias("a"))
    return a.select("group_id", F.transform("a", lambda x: F.struct(x["name"], x["role"])).alias("artists"))


def _matching(c: Catalog, groups: DataFrame, q: str | None) -> DataFrame:
    """Groups whose title, or one of whose artists, holds q."""
    if not q:
        return groups
    named = artist_rows(c).where(holds(F.col("name"), q)).select(F.col("group_id").alias("id")).distinct().withColumn("by_artist", F.lit(True))
    return groups.join(named, "id", "left").where(holds(F.col("title"), q) | F.col("by_artist")).drop("by_artist")


def albums(c: Catalog, q: str | None = None) -> DataFrame:
    """Every album with a visible release: first artist, counts and cover, one row each, not yet ordered."""
    g = _matching(c, c.groups, q)
    shown = visible_releases(c)
    per_group = shown.groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias("release_count"))
    first = artist_rows(c).groupBy(F.col("group_id").alias("id")).agg(F.min_by("name", F.struct("position", "artist_id")).alias("artist"))
    fronts = c.assets.where("kind = 'artwork' and role = 'front'").select(F.col("id").alias("asset_id"), "release_id")
    cover = shown.join(fronts, shown["id"] == F.col("release_id")).groupBy(F.col("group_id").alias("id")).agg(
        F.min_by("asset_id", F.struct("release_date", shown["id"], "asset_id")).alias("cover_id"))
    return g.join(per_group, "id").join(first, "id", "left").join(cover, "id", "left")


def albums_page(c: Catalog, limit: int = 50, offset: int = 0, q: str | None = None, recent: bool = False) -> DataFrame:
    a = albums(c, q)
    order = [F.desc("created_at"), F.desc("id")] if recent else [fold(F.col("artist")).asc_nulls_first(), fold(F.col("title")), F.col("original_date").asc_nulls_first(), F.col("id")]
    return a.orderBy(*order).offset(offset).limit(limit)


def albums_total(c: Catalog, q: str | None = None) -> DataFrame:
    shown = visible_releases(c).select(F.col("group_id").alias("id"))
    return _matching(c, c.groups, q).join(shown, "id", "left_semi").agg(F.count("*").alias("total"))


def artists(c: Catalog, q: str | None = None) -> DataFrame:
    """Album artists with their number of visible albums."""
    shown = visible_releases(c).select("group_id").distinct()
    rows = artist_rows(c).join(shown, "group_id", "left_semi")
    if q:
        rows = rows.where(holds(F.col("name"), q))
    return rows.groupBy(F.col("artist_id").alias("id"), "name").agg(F.countDistinct("group_id").alias("album_count"))


def artists_page(c: Catalog, limit: int = 50, offset: int = 0, q: str | None = None) -> DataFrame:
    return artists(c, q).orderBy(fold(F.col("name")), "id").offset(offset).limit(limit)


def artist_albums(c: Catalog, artist_id: int) -> DataFrame:
    """An artist's visible albums, once each."""
    mine = c.group_artists.where(F.col("artist_id") == artist_id).select(F.col("group_id").alias("id"))
    shown = visible_releases(c).select(F.col("group_id").alias("id"))
    return c.groups.join(mine, "id", "left_semi").join(shown, "id", "left_semi").orderBy("original_date", fold(F.col("title")), "id")


def formats(c: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """(release_id, formats): distinct formats in order of their first medium, of all releases or those of ids."""
    m = c.media if ids is None else c.media.join(ids, "release_id", "left_semi")
    f = m.where("format is not null").groupBy("release_id", "format").agg(F.min("position").alias("p"))
    f = f.groupBy("release_id").agg(F.array_sort(F.collect_list(F.struct("p", "format"))).alias("f"))
    return f.select("release_id", F.array_join(F.col("f.format"), ",").alias("formats"))


def album_releases(c: Catalog, group_id: int) -> DataFrame:
    """The releases of an album with track counts, formats and covers; best package, one row a release. What the album's
    releases need is looked up by their ids, before it is grouped."""
    mine = c.releases.where(F.col("group_id") == group_id)
    ids = mine.select(F.col("id").alias("release_id"))
    of = lambda d: d.join(ids, "release_id", "left_semi")
    p = of(c.packages)
    r = mine.join(p.where(visible(F.col("status"))).select(F.col("release_id").alias("id")), "id", "left_semi")
    n = of(c.media).join(c.tracks.select("media_id", F.col("id").alias("track_id")), F.col("id") == F.col("media_id"))
    n = n.groupBy("release_id").agg(F.count("*").alias("track_count"))
    cover = of(c.assets.where("kind = 'artwork' and role = 'front'")).groupBy("release_id").agg(F.min("id").alias("cover_id"))
    out = r.withColumnRenamed("id", "release_id").join(n, "release_id", "left").join(formats(c, ids), "release_id", "left").join(cover, "release_id", "left").join(best_of(p), "release_id")
    return out.select("release_id", "edition", "release_date", F.coalesce("track_count", F.lit(0)).alias("track_count"), "formats", "cover_id", "package_id", "status").orderBy("release_date", "release_id")


def group_objects(c: Catalog, groups: DataFrame) -> DataFrame:
    """(id, album): what a client gets of an album: its fields, absent ones null, and its artists in order."""
    a = artists_by_group(replace(c, group_artists=c.group_artists.join(groups.select(F.col("id").alias("group_id")), "group_id", "left_semi")))
    g = groups.join(a.withColumnRenamed("group_id", "id"), "id", "left")
    none = F.array().cast("array<struct<name:string,role:string>>")
    return g.select("id", F.struct("id", "title", F.col("release_type").alias("releaseType"), F.col("original_date").alias("originalReleaseDate"), F.coalesce("artists", none).alias("artists")).alias("album"))


def album_detail(c: Catalog, group_id: int) -> DataFrame:
    """One row (album, releases) of an album that exists, with its visible releases by date as nested rows."""
    album = group_objects(c, c.groups.where(F.col("id") == group_id)).select("album")
    r = album_releases(c, group_id)
    r = r.agg(F.array_sort(F.collect_list(F.struct("release_date", "release_id", *(x for x in r.columns if x not in ("release_date", "release_id"))))).alias("releases"))
    return album.join(F.broadcast(r))  # one row


def artist_detail(c: Catalog, artist_id: int) -> DataFrame:
    """One row (id, name, albums) of an artist that exists, with the visible albums by title."""
    g = artist_albums(c, artist_id)
    a = g.agg(F.array_sort(F.collect_list(F.struct(fold(F.col("title")).alias("key"), "id", "title", "release_type", "original_date"))).alias("a"))
    albums_ = F.transform("a", lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["release_type"].alias("releaseType"), x["original_date"].alias("originalReleaseDate")))
    return c.artists.where(F.col("id") == artist_id).join(F.broadcast(a)).select("id", "name", albums_.alias("albums"))  # one row


def track_objects(c: Catalog) -> DataFrame:
    """(id, media_id, track): what a client gets of each track: its artists in order, loudness where it is measured, and
    its audio file."""
    who = c.track_artists.join(c.artists.select(F.col("id").alias("artist_id"), "name"), "artist_id").groupBy(F.col("track_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", "name", "role"))).alias("a"))
    file = c.audio.groupBy(F.col("track_id").alias("id")).agg(F.min(F.struct(F.col("id").alias("audio_id"), "path", "size", "mime")).alias("file"))
    t = c.tracks.join(who, "id", "left").join(file, "id", "left")
    none = F.array().cast("array<struct<name:string,role:string>>")
    people = F.coalesce(F.transform("a", lambda x: F.struct(x["name"].alias("name"), x["role"].alias("role"))), none)
    audio = F.when(F.col("file").isNotNull(), F.struct(F.col("file.audio_id").alias("id"), F.col("file.size").alias("size"), F.col("file.mime").alias("mimeType"), F.concat(F.lit("/tracks/"), "id", F.lit("/audio")).alias("url")))
    loud = F.when(F.col("lufs").isNotNull(), F.struct("lufs"))
    return t.select("id", "media_id", F.struct("id", "number", "title", people.alias("artists"), loud.alias("loudness"), "duration", audio.alias("audio")).alias("track"))


def health(c: Catalog, version: str, schema: int) -> DataFrame:
    """One row: the service is up, in which version, and how much the catalog holds."""
    n = c.packages.agg(F.count("*").alias("packages"), F.count_if(visible(F.col("status"))).alias("visible"))
    return n.select(F.lit("ok").alias("status"), F.lit(version).alias("version"), F.lit(schema).alias("schemaVersion"), "packages", "visible")


def release_tracks(c: Catalog, release_id: int) -> DataFrame:
    """Flat rows of a release: media by position, tracks by number, each with its audio object."""
    m = c.media.where(F.col("release_id") == release_id).select(F.col("id").alias("media_id"), "disc_number", "position", "format")
    t = c.tracks.select(F.col("id").alias("track_id"), "media_id", "number", "title", "duration", "lufs")
    a = c.audio.select("track_id", F.col("path").alias("audio_path"), "size", "mime")
    return m.join(t, "media_id").join(a, "track_id").orderBy("position", "media_id", "number", "track_id")


def release_detail(c: Catalog, release_id: int) -> DataFrame:
    """One row: header, album artists, media with their tracks and assets as JSON text, absent values left out."""
    p = c.packages.where(F.col("release_id") == release_id)
    r = c.releases.where(F.col("id") == release_id).join(p.where(visible(F.col("status"))).select(F.col("release_id").alias("id")), "id", "left_semi")
    head = r.withColumnRenamed("id", "release_id").join(best_of(p), "release_id")
    own = replace(c, group_artists=c.group_artists.join(r.select("group_id"), "group_id", "left_semi"))
    head = head.join(c.groups.select(F.col("id").alias("group_id"), F.col("title").alias("album")), "group_id").join(artists_by_group(own), "group_id", "left")
    t = release_tracks(c, release_id).groupBy("media_id", "position", "disc_number", "format").agg(
        F.array_sort(F.collect_list(F.struct("number", "track_id", "title", "duration", "audio_path", "mime"))).alias("tracks"))
    t = t.agg(F.array_sort(F.collect_list(F.struct("position", "media_id", "disc_number", "format", "tracks"))).alias("media"))
    s = c.assets.where((F.col("release_id") == release_id) & F.col("kind").isin(*SERVED_ASSETS)).agg(F.array_sort(F.collect_list(F.struct("id", "kind", "role", "path"))).alias("assets"))
    d = head.join(F.broadcast(t)).join(F.broadcast(s))  # both are one row
    return d.select("release_id", F.to_json(F.struct("album", "artists", "edition", "release_date", "status", "media", "assets")).alias("json"))


def track_detail(c: Catalog, track_id: int | None = None) -> DataFrame:
    """A visible track, or all of them, with release, album, file and best package."""
    t = (c.tracks if track_id is None else c.tracks.where(F.col("id") == track_id)).withColumnRenamed("id", "track_id")
    m = c.media.select(F.col("id").alias("media_id"), "release_id", "disc_number")
    g = c.groups.select(F.col("id").alias("group_id"), F.col("title").alias("album"))
    a = c.audio.select("track_id", F.col("path").alias("audio_path"), "size", "mime")
    best = best_packages(c).where(visible(F.col("status")))
    return t.join(m, "media_id").join(c.releases.select(F.col("id").alias("release_id"), "group_id", "release_date"), "release_id").join(g, "group_id").join(a, "track_id").join(best, "release_id").select(
        "track_id", "title", "number", "disc_number", "release_id", "group_id", "album", "audio_path", "size", "mime", "package_id", "status")


def resolve_audio(c: Catalog, track_ids: list[int] | None = None) -> DataFrame:
    """The file of each track: its path in the release's best package."""
    a = c.audio if track_ids is None else c.audio.where(F.col("track_id").isin(track_ids))
    a = a.select("track_id", F.col("path").alias("audio_path"), "size", "mime")
    t = c.tracks.select(F.col("id").alias("track_id"), "media_id")
    m = c.media.select(F.col("id").alias("media_id"), "release_id")
    return a.join(t, "track_id").join(m, "media_id").join(best_packages(c), "release_id").select("track_id", "package_id", "status", F.concat_ws("/", "package_path", "audio_path").alias("file"), "size", "mime")


def resolve_assets(c: Catalog) -> DataFrame:
    """Served assets with their release's best package."""
    return c.assets.where(F.col("kind").isin(*SERVED_ASSETS)).join(best_packages(c), "release_id").select(
        F.col("id").alias("asset_id"), "kind", "role", "package_id", "status", F.concat_ws("/", "package_path", "path").alias("file"))


def medium_label(c: Catalog) -> DataFrame:
    """(release_id, label): 'A + B' for several formats, 'A x N' for several media of one."""
    m = c.media.where("format is not null").groupBy("release_id").agg(F.array_sort(F.collect_list(F.struct("position", "format"))).alias("m"))
    names = F.array_distinct(F.col("m.format"))
    one = F.when(F.size("m") > 1, F.concat(names[0], F.lit(" x "), F.size("m"))).otherwise(names[0])
    return m.select("release_id", F.when(F.size(names) > 1, F.array_join(names, " + ")).otherwise(one).alias("label"))


def only_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) where all rows of the key agree, else null."""
    return rows.groupBy(key).agg(F.when(F.count_distinct(F.coalesce(value, F.lit(""))) == 1, F.first(value)).alias(value))


def sessions(sessions_: DataFrame, tokens: DataFrame, now: Column) -> DataFrame:
    """Live sessions: neither session nor token is revoked or past its end."""
    live = lambda p: F.col(f"{p}revoked_at").isNull() & (F.col(f"{p}expires_at").isNull() | (F.col(f"{p}expires_at") >= now))
    t = tokens.select("token_hash", "name", F.col("revoked_at").alias("t_revoked_at"), F.col("expires_at").alias("t_expires_at"))
    return sessions_.join(t, "token_hash").where(live("") & live("t_")).select("session_hash", "token_hash", "name")


def merge_page(known: DataFrame, page: DataFrame, key: str = "id") -> DataFrame:
    """known and what page adds to it."""
    return known.unionByName(page.join(known.select(key), key, "left_anti"))
