"""What a client shows or reads from requests: names, dates, collector lines, routes, credentials, encoder names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.functions.media import mapped
from tessitura.functions.text import fold

# Country codes, media by what their name holds (the first that fits), routes, encoder profiles.
COUNTRIES = {
    "XE": "Europe", "XW": "Worldwide", "XN": "Northern Europe", "US": "United States", "UK": "United Kingdom", "GB": "United Kingdom",
    "DE": "Germany", "FR": "France", "JP": "Japan", "NL": "Netherlands",
}
MEDIA = (("vinyl", "Vinyl"), ("lp", "Vinyl"), ("sacd", "SACD"), ("dvd", "DVD"), ("blu-ray", "Blu-ray"), ("blu ray", "Blu-ray"), ("cd", "CD"), ("digital", "Digital"), ("download", "Digital"))
ROUTES = (("^/$", "albums"), ("^/albums/?$", "albums"), ("^/albums/([0-9]+)$", "album"), ("^/artists/?$", "artists"), ("^/artists/([0-9]+)$", "artist"), ("^/queue/?$", "queue"))
PROFILES = {
    1: "'Unstable/Experimental'", 5: "'quality 0'", 6: "'quality 1'", 7: "'Telephone'", 8: "'Thumb'", 9: "'Radio'", 10: "'Standard'",
    11: "'Extreme'", 12: "'Insane'", 13: "'BrainDead'", 14: "'quality 9'", 15: "'quality 10'",
}
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def country_name(code: Column) -> Column:
    """Unknown codes show as they are, none as an empty text."""
    return F.coalesce(mapped(code, COUNTRIES, code), F.lit(""))


def medium_name(name: Column) -> Column:
    out = F.when(F.coalesce(name, F.lit("")) == "", "Digital")
    for part, label in MEDIA:
        out = out.when(F.contains(fold(name), F.lit(part)), label)
    return out.otherwise(name)


def date_display(date: Column) -> Column:
    """'1986-06-16' is '16 Jun 1986'; without a day 'Jun 1986', without a month the first one."""
    part = lambda i: F.try_element_at(F.split(date, "-"), F.lit(i))
    month = F.coalesce(part(2).try_cast("int"), F.lit(1))
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.pmod(F.when(month == 0, 1).otherwise(month) - 1, F.lit(12)) + 1)
    day = F.when(F.coalesce(part(3), F.lit("")) != "", F.concat(part(3).try_cast("int").cast("string"), F.lit(" "))).otherwise(F.lit(""))
    return F.when(F.coalesce(date, F.lit("")) == "", "").when(part(1) == "", date).otherwise(F.concat(day, name, F.lit(" "), part(1)))


def collector_line(year: Column, media: Column, releases: Column) -> Column:
    """'1986 · CD/Vinyl · 2 versions'; what is absent, and a single version, is left out."""
    kinds = F.when(F.size(media) > 0, F.array_join(F.transform(media, medium_name), "/"))
    return F.concat_ws(" · ", F.nullif(year, F.lit("")), kinds, F.when(releases > 1, F.concat(releases.cast("string"), F.lit(" versions"))))


def route(path: Column) -> Column:
    """struct(name, id, query) of a client path."""
    plain = F.substring_index(path, "?", 1)
    name, id_ = F.lit("notfound"), F.lit(None).cast("string")
    for pattern, n in reversed(ROUTES):
        name = F.when(plain.rlike(pattern), n).otherwise(name)
        if "(" in pattern:
            id_ = F.when(plain.rlike(pattern), F.regexp_extract(plain, pattern, 1)).otherwise(id_)
    query = F.when(F.contains(path, F.lit("?")), F.substr(path, F.length(plain) + 2)).otherwise(F.lit(""))
    return F.struct(name.alias("name"), id_.alias("id"), query.alias("query"))


def cookie(header: Column, name: str) -> Column:
    """The value of a cookie, null if it is absent or empty. Only a cookie of exactly that name counts."""
    return F.nullif(F.regexp_extract(header, rf"(?:^|;)[ ;]*\Q{name}\E=([^;]*)", 1), F.lit(""))


def body_token(body: Column) -> Column:
    """The text of the first "token" member of a JSON body, null if it has none."""
    rest = F.when(F.instr(body, '"token"') > 0, F.substr(body, F.instr(body, '"token"') + 7))
    return F.nullif(F.regexp_extract(rest, r'^[ \t:]*"([^"]*)"', 1), F.lit(""))


def credential_ok(secret: Column, digest: Column, revoked: Column, expires: Column, now: Column) -> Column:
    """Whether a presented secret is the one of that digest, neither revoked nor past its end."""
    return F.coalesce((F.sha2(secret, 256) == digest) & revoked.isNull() & (expires.isNull() | (expires >= now)), F.lit(False))


def profile_name(profile: Column) -> Column:
    return mapped(F.floor(profile).cast("int"), PROFILES, F.lit("n.a."))


def encoder_name(stream_version: Column, version: Column) -> Column:
    """The program that wrote a stream: `version` is its number before stream version 8, and packed bytes (major, minor, build)
    from there on."""
    byte = lambda n: F.shiftright(version, n).bitwiseAND(F.lit(255))
    major, minor, build = byte(24), byte(16), byte(8)
    v = F.when(stream_version >= 8, major * 100 + minor).otherwise(version)
    last = v % 10
    two = F.concat(F.floor(v / 100).cast("string"), F.lit("."), F.lpad((v % 100).cast("string"), 2, "0"))
    old = (
        F.when(v == 0, "not recorded")
        .when(last == 0, F.concat(F.lit("Release "), F.floor(v / 100).cast("string"), F.lit("."), (F.floor(v / 10) % 10).cast("string")))
        .when(last.isin(2, 4, 6, 8), F.concat(F.lit("Beta "), two))
        .otherwise(F.concat(F.lit("--Alpha-- "), two))
    )
    state = F.when(minor % 2 == 1, "--Unstable-- ").otherwise("--Stable-- ")
    return F.when(v <= 116, old).otherwise(F.concat(state, F.concat_ws(".", major.cast("string"), minor.cast("string"), build.cast("string"))))
