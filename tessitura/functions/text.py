"""Scalar rules on text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(c: Column) -> Column:
    """ASCII letters to lower case, all else unchanged: the catalog's collation."""
    return F.translate(c, UPPER, LOWER)


def holds(c: Column, needle: str) -> Column:
    """Whether c contains needle, ASCII letters of either case; no character of needle is a wildcard."""
    return F.contains(fold(c), fold(F.lit(needle)))


def like_pattern(needle: Column) -> Column:
    """needle between wildcards, its own wildcards escaped by a backslash."""
    return F.concat(F.lit("%"), F.regexp_replace(needle, r"([\\%_])", r"\\$1"), F.lit("%"))


def strict_id(c: Column) -> Column:
    """A row id of 1 to 18 digits, else null."""
    return F.when(c.rlike("^[0-9]{1,18}$"), c.try_cast("long"))


def clamped(value: Column, default: int, least: int, most: int) -> Column:
    """A paging argument: the default where it is no whole number, else held within bounds. Compared as 64-bit numbers."""
    n = F.when(value.rlike("^-?[0-9]+$"), value.try_cast("decimal(38,0)"))
    return F.when(n.isNull(), F.lit(default)).otherwise(F.least(F.greatest(n, F.lit(least)), F.lit(most))).cast("int")


def path_ok(c: Column, most: int = 4096) -> Column:
    """A package-relative path: not empty, absolute or too long, no empty, '.' or '..' segment, no backslash, colon or
    control character. The length is in bytes."""
    segments = F.split(c, "/")
    plain = ~c.rlike(r"[\\:\x00-\x1f\x7f]")
    return F.coalesce((F.octet_length(c).between(1, most)) & plain & F.forall(segments, lambda s: ~s.isin("", ".", "..")), F.lit(False))


def inside(base: Column, path: Column) -> Column:
    return (path == base) | F.startswith(path, F.concat(base, F.lit("/")))


def contained(base: Column, path: Column) -> Column:
    """A package-relative path below its base, null for one that isn't valid or leaves it."""
    return F.when(path_ok(path), F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), path))


def all_digits(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]+$"), F.lit(False))


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lit(False))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def path_component(c: Column) -> Column:
    """A name fit for one path segment."""
    return F.regexp_replace(c, r"[/\\:\x00-\x1f]", "_")


def target_name(number: Column, title: Column, extension: Column) -> Column:
    return F.concat(F.format_string("%02d - ", number), path_component(title), F.lit("."), extension)


def json_text(c: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, all else as it is."""
    return F.when(c.isNotNull(), F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":|\}$', ""))


def url_token(secret: Column) -> Column:
    """Unpadded URL-safe base 64."""
    return F.rtrim(F.translate(F.base64(secret), "+/", "-_"), F.lit("="))


def fields_key(prefix: str, fields: dict[str, Column], more: Column | None = None) -> Column:
    """prefix and the digest of 'name=value' lines; null fields are left out."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), c, F.lit("\n"))).otherwise(F.lit("")) for k, c in fields.items()]
    return F.concat(F.lit(prefix), F.sha2(F.concat(*lines, *([] if more is None else [more])), 256))


def group_key(mbid: Column, title: Column, date: Column, kind: Column, artists: Column) -> Column:
    """Identity of an album: its registered id, else the digest of title, date, type and the sorted (name, role) pairs."""
    pairs = F.array_sort(F.transform(artists, lambda a: F.struct(a["name"].alias("name"), F.coalesce(a["role"], F.lit("")).alias("role"))))
    lines = F.array_join(F.transform(pairs, lambda a: F.concat(F.lit("artist="), a["name"], F.lit("\nrole="), a["role"], F.lit("\n"))), "")
    return F.when(F.nullif(mbid, F.lit("")).isNotNull(), F.concat(F.lit("mb:"), mbid)).otherwise(fields_key("h:", {"title": title, "date": date, "type": kind}, lines))


def release_key(mbid: Column, **fields: Column) -> Column:
    """Identity of a release in its album; fields in the order edition, date, country, label, catalogue, barcode."""
    return F.when(F.nullif(mbid, F.lit("")).isNotNull(), F.concat(F.lit("mb:"), mbid)).otherwise(fields_key("h:", fields))


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def year(date: Column) -> Column:
    """Of a date that may lack month and day."""
    return F.when(date.rlike("^[0-9]{4}"), F.substring(date, 1, 4))
