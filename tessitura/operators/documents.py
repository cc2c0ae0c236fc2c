"""Album manifests and tag sets as nested columns: parsing, validation, canonical text, mapping and matching.

A manifest keeps its JSON text beside the typed struct, so fields outside the schema survive. A tag set is an array of
structs (pos, key, value): an ordered multimap whose keys compare without regard to ASCII case.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions import media
from tessitura.functions.levels import plausible
from tessitura.functions.text import first_filled, fold, is_sha256, path_ok

_ARTISTS = "array<struct<name:string,role:string>>"
_FILE = "struct<path:string,sha256:string>"
MANIFEST = f"""format string, version int,
album struct<title:string,artists:{_ARTISTS},releaseType:string,originalReleaseDate:string,genres:array<string>>,
release struct<releaseDate:string,edition:string,country:string,label:string,catalogueNumber:string,notes:string>,
identifiers struct<musicbrainzReleaseGroupId:string,musicbrainzReleaseId:string,barcode:string>,
media array<struct<disc:int,format:string,title:string,tracks:array<struct<track:int,title:string,artists:{_ARTISTS},
  identifiers:struct<isrc:string,musicbrainzTrackId:string,musicbrainzRecordingId:string>,duration:double,
  loudness:struct<trackLUFS:double,truePeakDbTP:double>,audio:{_FILE}>>>>,
artwork array<struct<role:string,path:string,sha256:string>>, booklet array<{_FILE}>, lyrics array<{_FILE}>, extras array<{_FILE}>,
loudness struct<algorithm:string,albumLUFS:double,albumTruePeakDbTP:double>"""
EXTERNAL = """id string, title string, date string, country string, barcode string,
`release-group` struct<id:string,`primary-type`:string,`first-release-date`:string>,
media array<struct<format:string,position:int,tracks:array<struct<id:string,number:string,title:string,recording:struct<id:string,isrcs:array<string>>>>>>"""

# Closed lists of the document format, and the tag spellings of each field in order of preference.
RELEASE_TYPES = ("album", "single", "ep", "compilation", "soundtrack", "live-album", "remix-album", "mixtape", "dj-mix", "other")
ALIASES = {
    "album": ["ALBUM"], "album_artist": ["ALBUMARTIST", "ALBUM ARTIST"], "title": ["TITLE"], "artist": ["ARTIST"],
    "number": ["TRACKNUMBER", "Track"], "disc": ["DISCNUMBER", "Disc"], "date": ["DATE", "YEAR"], "original_date": ["ORIGINALDATE", "ORIGINAL YEAR"], "genre": ["GENRE"],
    "label": ["PUBLISHER", "LABEL", "ORGANIZATION"], "catalogue": ["CATALOGNUMBER", "CATALOGUENUMBER", "CATALOG #"],
    "barcode": ["BARCODE"], "isrc": ["ISRC"],
    "release_id": ["MUSICBRAINZ_ALBUMID", "MUSICBRAINZ_RELEASEID", "MusicBrainz Album Id"],
    "group_id": ["MUSICBRAINZ_RELEASEGROUPID", "RELEASEGROUPID", "MusicBrainz Release Group Id"],
    "recording_id": ["MUSICBRAINZ_RECORDINGID", "MusicBrainz Recording Id", "MUSICBRAINZ_TRACKID", "MusicBrainz Track Id"],
    "track_id": ["MUSICBRAINZ_RELEASETRACKID", "MusicBrainz Release Track Id"],
    "release_type": ["MUSICBRAINZ_ALBUMTYPE", "RELEASETYPE", "MusicBrainz Album Type"],
    "country": ["MUSICBRAINZ_ALBUMCOUNTRY", "RELEASECOUNTRY", "MusicBrainz Album Country"],
    "source": ["SOURCE"], "source_id": ["SOURCEID"], "composer": ["COMPOSER"], "performer": ["PERFORMER"], "conductor": ["CONDUCTOR"],
    "remixer": ["REMIXER"], "author": ["AUTHOR"],
}
ROLES = {"artist": "main", "composer": "composer", "performer": "performer", "conductor": "conductor", "remixer": "remixer", "author": "author"}


def parsed(rows: DataFrame, text: str = "json") -> DataFrame:
    """rows with `m`, the typed manifest (null if the text is no JSON object)."""
    return rows.withColumn("m", F.from_json(text, MANIFEST))


def problems(m: Column) -> Column:
    """Codes of the rules a manifest breaks, in a fixed order. What several rules look at is made once."""
    tracks = F.flatten(F.transform(m["media"], lambda d: d["tracks"]))
    paths = [F.coalesce(F.transform(m[k], lambda a: a["path"]), F.array().cast("array<string>")) for k in ("artwork", "booklet", "lyrics", "extras")]
    empty = lambda c: F.coalesce(c == "", c.isNull())
    none = lambda a: F.coalesce(F.size(a) <= 0, F.lit(True))

    def codes(x: Column) -> Column:
        rules = {
            "E_JSON": m.isNull() | m["format"].isNull(),
            "E_VERSION": ~F.coalesce(m["version"] == 1, F.lit(False)),
            "E_TITLE": empty(m["album"]["title"]),
            "E_ARTISTS": none(m["album"]["artists"]) | F.exists(m["album"]["artists"], lambda a: empty(a["name"])),
            "E_RELEASE_TYPE": m["album"]["releaseType"].isNotNull() & ~m["album"]["releaseType"].isin(*RELEASE_TYPES),
            "E_MEDIA": none(m["media"]) | F.exists(m["media"], lambda d: none(d["tracks"])),
            "E_DISC": F.exists(x["discs"], lambda d: F.coalesce(d < 1, F.lit(True))) | (F.size(F.array_distinct(x["discs"])) < F.size(x["discs"])),
            "E_TRACK": F.exists(m["media"], lambda d: F.size(F.array_distinct(d["tracks"]["track"])) < F.size(d["tracks"])) | F.exists(x["tracks"], lambda t: F.coalesce(t["track"] < 1, F.lit(True)) | empty(t["title"])),
            "E_PATH": F.exists(x["files"], lambda p: ~path_ok(p)),
            "E_DUPLICATE_PATH": F.size(F.array_distinct(x["files"])) < F.size(x["files"]),
            "E_SHA256": F.exists(x["tracks"], lambda t: t["audio"]["sha256"].isNotNull() & ~is_sha256(t["audio"]["sha256"])),
            "E_LOUDNESS": F.exists(x["tracks"], lambda t: t["loudness"]["trackLUFS"].isNotNull() & ~plausible(t["loudness"]["trackLUFS"])),
        }
        return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())))

    def with_files(x: Column) -> Column:
        sound = F.coalesce(F.transform(x["tracks"], lambda t: t["audio"]["path"]), F.array().cast("array<string>"))
        return F.struct(x["tracks"].alias("tracks"), F.concat(*paths, sound).alias("files"), F.transform(m["media"], lambda d: d["disc"]).alias("discs"))

    once = F.transform(F.transform(F.array(F.struct(tracks.alias("tracks"))), with_files), codes)
    return F.element_at(once, 1)


def canonical(m: Column) -> Column:
    """One text for equal manifests: fields in schema order, absent ones left out."""
    return F.to_json(m)


def fingerprint(m: Column) -> Column:
    return F.sha2(canonical(m), 256)


def pretty(rows: DataFrame, text: str = "json") -> DataFrame:
    """`pretty`: the JSON with two spaces of indent, its key order kept."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else json.dumps(json.loads(x), indent=2, ensure_ascii=False))

    return rows.withColumn("pretty", F.pandas_udf(run, "string")(F.col(text)))


def _merged(old, new):
    if isinstance(old, dict) and isinstance(new, dict):
        return old | {k: _merged(old[k], v) if k in old else v for k, v in new.items()}
    if isinstance(old, list) and isinstance(new, list):
        return [_merged(a, b) for a, b in zip(old, new)] + new[len(old):]
    return new


def merged(old: Column, new: Column) -> Column:
    """The JSON `new` over `old`: objects merge by field, arrays by index at the new length, so unknown fields stay."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([y if x is None else x if y is None else json.dumps(_merged(json.loads(x), json.loads(y)), ensure_ascii=False) for x, y in zip(a, b)])

    return run(old, new)


def values(tags: Column, field: str) -> Column:
    """All text values of the first spelling of the field that has any, in their order."""
    def spelled(a: str) -> Column:
        return F.transform(F.filter(tags, lambda t: (fold(t["key"]) == a.lower()) & (t["value"] != "")), lambda t: t["value"])

    filled = [spelled(a) for a in ALIASES[field]]
    out = filled[-1]
    for f in reversed(filled[:-1]):
        out = F.when(F.size(f) > 0, f).otherwise(out)
    return out


def value(tags: Column, field: str) -> Column:
    return F.get(values(tags, field), F.lit(0))


def track_of(tags: Column) -> Column:
    """struct of a track's fields; artists of all roles in a fixed order of roles."""
    def named(f: str, role: str) -> Column:
        return F.transform(values(tags, f), lambda v: F.struct(v.alias("name"), F.lit(role).alias("role")))

    people = F.concat(*(named(f, r) for f, r in ROLES.items()))
    return F.struct(value(tags, "title").alias("title"), media.track_number(value(tags, "number")).alias("number"), people.alias("artists"), value(tags, "isrc").alias("isrc"),
                    value(tags, "recording_id").alias("recording_id"), value(tags, "track_id").alias("track_id"), media.source(value(tags, "source"))["store"].alias("store"))


def album_of(tags: Column) -> Column:
    """struct of an album's and release's fields."""
    src = media.source(value(tags, "source"))
    return F.struct(value(tags, "album").alias("title"), values(tags, "album_artist").alias("artists"), media.release_type(value(tags, "release_type")).alias("release_type"),
                    value(tags, "original_date").alias("original_date"), values(tags, "genre").alias("genres"), value(tags, "date").alias("date"), value(tags, "country").alias("country"),
                    value(tags, "label").alias("label"), value(tags, "catalogue").alias("catalogue"), value(tags, "barcode").alias("barcode"), value(tags, "release_id").alias("release_id"),
                    value(tags, "group_id").alias("group_id"), src["store"].alias("store"), src["type"].alias("source_type"))


def filled(dst: Column, *src: Column) -> Column:
    """Fill only what is empty; sources in order of precedence."""
    return first_filled(dst, *src)


def to_tags(fields: dict[str, Column]) -> Column:
    """The inverse mapping: key and value of each field that isn't null, under its first spelling."""
    pairs = F.array(*(F.when(c.isNotNull(), F.struct(F.lit(ALIASES[f][0]).alias("key"), c.cast("string").alias("value"))) for f, c in fields.items()))
    return F.array_sort(F.array_compact(pairs))


def collapsed(tags: DataFrame, key: list[str]) -> DataFrame:
    """Long tag rows (key..., pos, tag, value) with repeated tags joined by NUL under their first spelling."""
    t = tags.groupBy(*key, fold(F.col("tag")).alias("folded")).agg(F.min("pos").alias("pos"), F.min_by("tag", "pos").alias("tag"), F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    return t.select(*key, "pos", "tag", F.array_join(F.col("v.value"), "\0").alias("value"))


def split_values(tags: DataFrame, key: list[str]) -> DataFrame:
    """The inverse: one row for each value."""
    return tags.select(*key, "tag", F.posexplode(F.split("value", "\0")).alias("n", "value"))


def valid_tag(key: Column, value_: Column, is_binary: Column) -> Column:
    printable = (F.length(key).between(1, 256)) & key.rlike(r"^[\x20-\x7e]+$")
    return F.coalesce(printable & (is_binary | F.is_valid_utf8(value_)) & (F.octet_length(value_) <= 1 << 20), F.lit(False))


def chosen_release(doc: Column) -> Column:
    """An external record: the document itself, or the first of its search results."""
    return F.coalesce(F.get_json_object(doc, "$.releases[0]"), doc)


def confidence(release_id: Column, external_id: Column, barcode: Column, external_barcode: Column, isrcs: Column, external_isrcs: Column, title: Column, external_title: Column, count: Column, external_count: Column) -> Column:
    """exact by id, confirmed by barcode or by a shared recording code and equal track counts, probable by either a code or
    the title, else none."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    hit = yes(F.arrays_overlap(isrcs, external_isrcs))
    return (F.when(yes(release_id == external_id), "exact").when(yes((barcode == external_barcode) & (external_barcode != "")), "confirmed")
            .when(hit & yes((count == external_count) & (external_count > 0)), "confirmed").when(hit | yes(title == external_title), "probable").otherwise("none"))


def enriched(tracks: DataFrame, external: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Own track rows with empty fields filled from the external row of the same disc and number; of several the first."""
    one = external.groupBy(*keys).agg(*(F.min_by(f, "pos").alias(f"__{f}") for f in fields))
    d = tracks.join(one, keys, "left")
    return d.withColumns({f: filled(F.col(f), F.col(f"__{f}")) for f in fields}).drop(*(f"__{f}" for f in fields))


def external_applied(own: DataFrame, external: DataFrame, key: str) -> DataFrame:
    """Own album and release fields (one row for each key) with what is empty filled from the external release of the same key:
    (key, doc) with the external catalog's JSON. Of several documents the least counts."""
    x = external.groupBy(key).agg(F.min(chosen_release(F.col("doc"))).alias("doc")).select(key, F.from_json("doc", EXTERNAL).alias("x"))
    group = F.col("x")["release-group"]
    fields = {
        "title": F.col("x.title"), "date": F.col("x.date"), "country": F.col("x.country"), "barcode": F.col("x.barcode"), "release_id": F.col("x.id"),
        "group_id": group["id"], "original_date": group["first-release-date"], "release_type": media.release_type(group["primary-type"]),
        "media_count": F.when(F.size("x.media") > 0, F.size("x.media").cast("string")),
    }
    d = own.join(x, key, "left")
    return d.select(key, *((filled(F.col(n), c) if n in own.columns else c).alias(n) for n, c in fields.items()))


def first_per_role(art: DataFrame, key: str, order: str) -> DataFrame:
    """One picture for each role: local files before embedded ones, then by order; roles without a local file keep theirs."""
    return art.groupBy(key, "role").agg(F.min_by("path", F.struct(F.when(F.col("local"), 0).otherwise(1), order)).alias("path"))


