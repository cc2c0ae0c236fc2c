"""Document and tag queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.operators import documents as ops
from tessitura.plans.catalog_tables import read
from tessitura.plans.registry import query


def _manifests(spark, sf_dir):
    """A manifest for each order: line items are tracks; some break rules."""
    k = F.col("l_orderkey")
    line = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_discount").alias("d"))
    track = F.struct(F.when(k % 11 == 0, 1).otherwise(F.col("l_linenumber")).alias("track"), F.concat(F.lit("T"), "part").alias("title"),
                     F.struct(F.when(k % 13 == 0, 9.0).otherwise(-6 - F.col("d")).alias("trackLUFS")).alias("loudness"),
                     F.struct(F.when(k % 17 == 0, F.concat(F.lit("../"), "l_linenumber")).otherwise(F.concat(F.lit("audio/"), "l_linenumber")).alias("path"), F.sha2(F.col("part").cast("string"), 256).alias("sha256")).alias("audio"))
    g = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(track)).alias("tracks"))
    doc = F.struct(F.lit("album").alias("format"), F.when(k % 19 == 0, 2).otherwise(1).alias("version"), F.struct(F.when(k % 7 != 0, F.concat(F.lit("Album "), k)).alias("title"), F.array(F.struct(F.lit("A").alias("name"))).alias("artists"),
                   F.when(k % 5 == 0, "opera").otherwise("album").alias("releaseType")).alias("album"), F.array(F.struct(F.lit(1).alias("disc"), F.col("tracks"))).alias("media"))
    return g.select(k.alias("id"), F.when(k % 23 == 0, "{broken").otherwise(F.to_json(doc)).alias("json"))


@query("manifest_problems", """
with k as (select l_orderkey as id, count(distinct l_linenumber) as n from lineitem group by 1)
select id, case when id % 23 = 0 then 'E_JSON,E_VERSION,E_TITLE,E_ARTISTS,E_MEDIA' else array_to_string([x for x in [
  case when id % 19 = 0 then 'E_VERSION' end, case when id % 7 = 0 then 'E_TITLE' end, case when id % 5 = 0 then 'E_RELEASE_TYPE' end, case when id % 11 = 0 and n > 1 then 'E_TRACK' end,
  case when id % 17 = 0 then 'E_PATH' end, case when id % 13 = 0 then 'E_LOUDNESS' end] if x is not null], ',') end as problems from k""")
def manifest_problems(spark, sf_dir):
    m = ops.parsed(_manifests(spark, sf_dir))
    return m.select("id", F.array_join(ops.problems(F.col("m")), ",").alias("problems"))


#: The canonical text of each order's manifest, put together piece by piece.
_CANON = """
with l as (select l_orderkey as k, l_linenumber as n, min(l_partkey) as part, min(l_discount) as d from lineitem group by 1, 2),
t as (select k, string_agg('{"track":' || (case when k % 11 = 0 then 1 else n end) || ',"title":"T' || part || '","loudness":{"trackLUFS":' || (case when k % 13 = 0 then 9.0::double else -6 - d end) || '},"audio":{"path":"'
  || case when k % 17 = 0 then '../' || n else 'audio/' || n end || '","sha256":"' || sha256(cast(part as varchar)) || '"}}', ',' order by case when k % 11 = 0 then 1 else n end, 'T' || part, case when k % 13 = 0 then 9.0::double else -6 - d end, case when k % 17 = 0 then '../' || n else 'audio/' || n end) as tracks from l group by k),
j as (select k as id, '{"format":"album","version":' || (case when k % 19 = 0 then 2 else 1 end) || ',"album":{' || case when k % 7 <> 0 then '"title":"Album ' || k || '",' else '' end || '"artists":[{"name":"A"}],"releaseType":"'
  || case when k % 5 = 0 then 'opera' else 'album' end || '"},"media":[{"disc":1,"tracks":[' || tracks || ']}]}' as json from t where k % 23 <> 0)
"""


@query("manifest_fingerprints", _CANON + "select id, sha256(json) as fingerprint, json as canonical from j")
def manifest_fingerprints(spark, sf_dir):
    m = ops.parsed(_manifests(spark, sf_dir))
    return m.where("m.format is not null").select("id", ops.fingerprint(F.col("m")).alias("fingerprint"), ops.canonical(F.col("m")).alias("canonical"))


@query("manifest_merge")
def manifest_merge(spark, sf_dir):
    m = _manifests(spark, sf_dir).where("json like '%}'")
    return m.select("id", ops.merged(F.col("json"), F.to_json(F.struct(F.struct(F.lit("New").alias("title")).alias("album"), F.lit(1).alias("x")))).alias("json"))


@query("manifest_pretty")
def manifest_pretty(spark, sf_dir):
    return ops.pretty(_manifests(spark, sf_dir).where("json like '%}'")).drop("json")


def _tags(spark, sf_dir):
    k = F.col("p_partkey")
    t = lambda key, v: F.struct(F.lit(key).alias("key"), v.cast("string").alias("value"))
    tags = F.array(t("Title", F.when(k % 6 == 0, "").otherwise(F.col("p_name"))), t("TRACK", F.concat(k % 15, F.lit("/15"))), t("artist", F.col("p_brand")), t("ARTIST", F.lit("Guest")), t("Composer", F.col("p_type")),
                   t("LABEL", F.when(k % 2 == 0, "").otherwise(F.lit("L"))), t("Organization", F.lit("Org")), t("SOURCE", F.when(k % 3 == 0, "CD").when(k % 3 == 1, "Download").otherwise("Shop")), t("YEAR", F.col("p_size")))
    return read(spark, sf_dir, "part").select(k.alias("id"), tags.alias("tags"))


@query("tag_tracks", """
select p_partkey as id, case when p_partkey % 6 <> 0 then p_name end as title, case when p_partkey % 15 >= 1 then cast(p_partkey % 15 as int) end as number, p_brand || '/main,Guest/main,' || p_type || '/composer' as artists, case when p_partkey % 3 = 2 then 'Shop' end as store from part""")
def tag_tracks(spark, sf_dir):
    t = _tags(spark, sf_dir).select("id", ops.track_of(F.col("tags")).alias("t"))
    return t.select("id", "t.title", "t.number", F.array_join(F.transform("t.artists", lambda a: F.concat_ws("/", a["name"], a["role"])), ",").alias("artists"), "t.store")


@query("tag_albums", """
select p_partkey as id, case when p_partkey % 2 = 0 then 'Org' else 'L' end as label, cast(p_size as varchar) as date, case when p_partkey % 3 = 2 then 'Shop' end as store, case when p_partkey % 3 = 0 then 'cd-rip' else 'digital-download' end as source_type from part""")
def tag_albums(spark, sf_dir):
    t = _tags(spark, sf_dir).select("id", ops.album_of(F.col("tags")).alias("t"))
    return t.select("id", "t.label", "t.date", "t.store", "t.source_type")


@query("tag_projection", "select p_partkey as id, 'ALBUM=' || p_name || case when p_size % 2 = 0 then ',DATE=' || p_size else '' end || ',ISRC=' || p_brand as tags from part")
def tag_projection(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    t = ops.to_tags({"album": F.col("p_name"), "isrc": F.col("p_brand"), "date": F.when(F.col("p_size") % 2 == 0, F.col("p_size"))})
    return p.select(F.col("p_partkey").alias("id"), F.array_join(F.transform(t, lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("tags"))


#: A field of each kind and the value that it has for a part.
_FIELDS = {
    "album": "p_name", "album_artist": "p_brand", "release_type": "case p_partkey % 3 when 0 then 'EP' when 1 then 'Live' end", "original_date": "cast(1900 + p_size as varchar)", "genre": "p_type", "date": "cast(1950 + p_size as varchar)",
    "country": "case when p_partkey % 2 = 0 then 'XE' end", "label": "'L' || p_size", "catalogue": "'C' || p_partkey", "barcode": "cast(p_partkey * 7 as varchar)", "release_id": "'r' || p_partkey", "group_id": "'g' || p_size", "source": "'Shop'",
}
_KEYS = {f: ops.ALIASES[f][0] for f in _FIELDS}


@query("tag_projection_whole", "select p_partkey as id, array_to_string([x for x in [" + ", ".join(f"'{_KEYS[f]}=' || {_FIELDS[f]}" for f in sorted(_FIELDS, key=lambda f: _KEYS[f])) + "] if x is not null], ',') as tags from part")
def tag_projection_whole(spark, sf_dir):
    t = ops.to_tags({f: F.expr(v.replace("varchar", "string")) for f, v in _FIELDS.items()})
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(t, lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("tags"))


_MAPPED = {"title": "album", "original_date": "original_date", "date": "date", "country": "country", "label": "label", "catalogue": "catalogue", "barcode": "barcode", "release_id": "release_id", "group_id": "group_id"}


@query("tag_albums_whole", "select p_partkey as id, " + ", ".join(f"{_FIELDS[f]} as {n}" for n, f in _MAPPED.items()) + ", case p_partkey % 3 when 0 then 'ep' when 1 then 'live-album' end as release_type, p_brand as artists, p_type as genres, 'Shop' as store, 'digital-download' as source_type from part")
def tag_albums_whole(spark, sf_dir):
    """Every album field from the tags that its projection makes."""
    t = ops.to_tags({f: F.expr(v.replace("varchar", "string")) for f, v in _FIELDS.items()})
    a = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ops.album_of(t).alias("a"))
    return a.select("id", *(F.col(f"a.{n}").alias(n) for n in _MAPPED), F.col("a.release_type").alias("release_type"), F.array_join("a.artists", ",").alias("artists"), F.array_join("a.genres", ",").alias("genres"), F.col("a.store").alias("store"), F.col("a.source_type").alias("source_type"))


@query("external_apply", """
select o_orderkey as id, case when o_orderkey % 2 = 0 then 'Own' when o_orderkey % 3 > 0 then 'X' || o_orderkey end as title, case when o_orderkey % 3 > 0 then 'r' || o_orderkey end as release_id, case when o_orderkey % 3 > 0 then 'single' end as release_type,
  case when o_orderkey % 3 > 0 then strftime(o_orderdate, '%Y') end as original_date, case when o_orderkey % 3 > 0 then '2' end as media_count from orders""")
def external_apply(spark, sf_dir):
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders")
    own = o.select(k.alias("id"), F.when(k % 2 == 0, "Own").otherwise("").alias("title"), F.lit(None).cast("string").alias("barcode"))
    group = F.struct(F.lit("g").alias("id"), F.lit("Single").alias("primary-type"), F.date_format("o_orderdate", "yyyy").alias("first-release-date"))
    doc = F.to_json(F.struct(F.concat(F.lit("r"), k).alias("id"), F.concat(F.lit("X"), k).alias("title"), group.alias("release-group"), F.array(F.struct(F.lit(1).alias("position")), F.struct(F.lit(2).alias("position"))).alias("media")))
    x = o.where("o_orderkey % 3 > 0").select(k.alias("id"), F.when(k % 5 == 0, F.concat(F.lit('{"releases":['), doc, F.lit("]}"))).otherwise(doc).alias("doc"))
    return ops.external_applied(own, x, "id").select("id", "title", "release_id", "release_type", "original_date", "media_count")


@query("tag_collapse", "select conv_id, min(turn) as pos, arg_min(role, turn) as tag, string_agg(text, chr(0) order by turn) as value from (select conv_id, turn, role, min(text) as text from conversations group by all) group by conv_id, lower(role)")
def tag_collapse(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id", "turn", "role").agg(F.min("text").alias("value"))
    return ops.collapsed(c.withColumnsRenamed({"turn": "pos", "role": "tag"}), ["conv_id"])


@query("tag_split", "select conv_id, lower(role) as tag, count(*) as n from (select distinct conv_id, turn, role from conversations) group by all")
def tag_split(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id", "turn", "role").agg(F.min("turn").cast("string").alias("value"))
    s = ops.split_values(ops.collapsed(c.withColumnsRenamed({"turn": "pos", "role": "tag"}), ["conv_id"]), ["conv_id"])
    return s.groupBy("conv_id", F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


@query("match_confidence", """
with a as (select l_orderkey as id, count(distinct l_linenumber) as n from lineitem group by 1)
select id, case when id % 10 = 0 then 'exact' when id % 9 = 0 then 'confirmed' when id % 3 = 0 and id % 2 = 0 then 'confirmed' when id % 3 = 0 or id % 4 = 0 then 'probable' else 'none' end as confidence from a""")
def match_confidence(spark, sf_dir):
    k = F.col("l_orderkey")
    a = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("n"))
    c = ops.confidence(F.lit("x"), F.when(k % 10 == 0, "x").otherwise("y"), F.lit("1"), F.when(k % 9 == 0, "1").otherwise(""), F.array(F.lit("i1"), F.lit("i2")), F.when(k % 3 == 0, F.array(F.lit("i2"))).otherwise(F.array(F.lit("i9"))),
                       F.lit("t"), F.when(k % 4 == 0, "t").otherwise("u"), F.col("n"), F.when(k % 2 == 0, F.col("n")).otherwise(0))
    return a.select(k.alias("id"), c.alias("confidence"))


@query("external_enrich", """
with t as (select distinct l_orderkey as disc, l_linenumber as number, case when l_orderkey % 2 = 0 then '' else 'own' || l_linenumber end as isrc from lineitem),
x as (select l_orderkey as disc, l_linenumber as number, arg_min(cast(l_suppkey as varchar), l_partkey) as isrc from (select l_orderkey, l_linenumber, l_partkey, min(l_suppkey) as l_suppkey from lineitem where l_orderkey % 4 <> 2 group by 1, 2, 3) group by 1, 2)
select t.disc, t.number, case when t.isrc <> '' then t.isrc else x.isrc end as isrc from t left join x on t.disc = x.disc and t.number = x.number""")
def external_enrich(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "disc", "l_linenumber": "number"})
    t = line.select("disc", "number", F.when(F.col("disc") % 2 == 0, "").otherwise(F.concat(F.lit("own"), "number")).alias("isrc")).distinct()
    x = line.where("disc % 4 <> 2").groupBy("disc", "number", F.col("l_partkey").alias("pos")).agg(F.min("l_suppkey").cast("string").alias("isrc"))
    return ops.enriched(t, x, ["disc", "number"], ["isrc"])


@query("artwork_roles", """
with a as (select distinct l_orderkey, l_returnflag as role, l_linestatus = 'F' as local, l_partkey as pos from lineitem)
select l_orderkey, role, cast(arg_min(pos, case when local then 0 else 1000000000 end + pos) as varchar) as path from a group by 1, 2""")
def artwork_roles(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("role"), (F.col("l_linestatus") == "F").alias("local"), F.col("l_partkey").alias("pos"), F.col("l_partkey").cast("string").alias("path")).distinct()
    return ops.first_per_role(a, "l_orderkey", "pos")


@query("external_release", "select event_id as id, cast(event_id as varchar) as title from events")
def external_release(spark, sf_dir):
    i = F.col("event_id")
    own = F.to_json(F.struct(i.cast("string").alias("title")))
    doc = F.when(i % 2 == 0, own).otherwise(F.concat(F.lit('{"releases":['), own, F.lit(',{"title":"other"}]}')))
    return read(spark, sf_dir, "events").select(i.alias("id"), F.from_json(ops.chosen_release(doc), ops.EXTERNAL)["title"].alias("title"))
