"""Incremental maintenance of the catalog: a scan turns the package table of the last run into the next one.

State tables are immutable snapshots; a run reads one and writes another, so the unit of change is the run. Per package a
scan decides one action: unchanged (same path and manifest digest), updated, moved (a known fingerprint at a new path whose
old path is gone), added or invalid; packages that weren't seen become unavailable, and come back as valid when seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions.text import fold
from tessitura.session import staged

#: path, manifest_sha256, fingerprint and problems (array; empty if the manifest is valid) of what a scan finds.
FOUND = "path string, manifest_sha256 string, fingerprint string, problems array<string>, missing int"
PACKAGES = "id bigint, path string, manifest_sha256 string, fingerprint string, status string, verify_status string, last_scan string, last_error string"


def next_ids(rows: DataFrame, order: str, start: Column) -> DataFrame:
    """rows with `id` from start + 1 on, by order: ranges number their rows, and each range begins where the ones before
    end. The numbered ranges are written once, as a second range partitioning would sample other bounds. All other
    columns are kept; one named id is replaced."""
    packed = rows.select(F.struct(*(c for c in rows.columns if c != "id")).alias("r"))
    numbered = packed.repartitionByRange(F.col(f"r.{order}")).sortWithinPartitions(f"r.{order}").withColumn("at", F.monotonically_increasing_id())
    d = staged(numbered.select("r", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("n")), "next-ids")
    # one row a range; ranges are as many as shuffle partitions
    before = d.groupBy("part").agg(F.count("*").alias("c")).select("part", (F.sum("c").over(W.orderBy("part")) - F.col("c")).alias("b"))
    return d.join(F.broadcast(before), "part").select("r.*", (start + F.col("b") + F.col("n") + 1).alias("id"))


def actions(packages: DataFrame, found: DataFrame) -> DataFrame:
    """found with `action` and `old_id`."""
    valid = F.size("problems") == 0
    at = packages.select(F.col("id").alias("at_id"), "path", F.col("manifest_sha256").alias("at_sha"), F.col("status").alias("at_status"))
    d = found.join(at, "path", "left")
    # packages whose path this scan doesn't see can be the origin of a move; of several the least id
    gone = packages.join(found.select("path"), "path", "left_anti").where("fingerprint is not null").groupBy("fingerprint").agg(F.min("id").alias("from_id"))
    # of new paths with the same fingerprint the first takes the move, the others are copies
    fresh = found.join(packages.select("path"), "path", "left_anti").where(valid).groupBy("fingerprint").agg(F.min("path").alias("mover"))
    move = gone.join(fresh, "fingerprint").select(F.col("mover").alias("path"), "from_id")
    d = d.join(move, "path", "left")
    action = (
        F.when(~valid, "invalid")
        .when(F.col("at_id").isNotNull() & (F.col("at_sha") == F.col("manifest_sha256")), "unchanged")
        .when(F.col("at_id").isNotNull(), "updated")
        .when(F.col("from_id").isNotNull(), "moved")
        .otherwise("added")
    )
    return d.withColumn("action", action).withColumn("old_id", F.coalesce("at_id", "from_id")).drop("at_id", "from_id", "at_sha", "at_status")


def status_of(problems: Column, missing: Column) -> Column:
    return F.when(F.size(problems) > 0, "invalid").when(missing > 0, "warning").otherwise("valid")


def verified_status(errors: Column, warnings: Column) -> Column:
    """struct(status, verify_status, last_error) of a full check, which reads every file; a light one only knows what is
    missing and leaves the check's own status as unverified."""
    state = F.when(errors > 0, "checksum-failed").when(warnings > 0, "warning").otherwise("valid")
    text = F.when(errors > 0, F.format_string("integrity verification failed (%d errors, %d warnings)", errors, warnings)).when(warnings > 0, F.format_string("%d warning(s)", warnings))
    return F.struct(state.alias("status"), state.alias("verify_status"), text.alias("last_error"))


def light_status(missing: Column) -> Column:
    state = F.when(missing > 0, "warning").otherwise("valid")
    return F.struct(state.alias("status"), F.lit("unverified").alias("verify_status"), F.when(missing > 0, F.format_string("%d referenced object(s) missing", missing)).alias("last_error"))


def verify_applied(packages: DataFrame, checks: DataFrame) -> DataFrame:
    """The package table after a full check: checks (path, errors, warnings) of the packages that were looked at."""
    d = packages.join(checks.groupBy("path").agg(F.max("errors").alias("__e"), F.max("warnings").alias("__w")), "path", "left")
    s, seen = verified_status(F.col("__e"), F.col("__w")), F.col("__e").isNotNull()
    fields = {f: F.when(seen, s[f]).otherwise(F.col(f)) for f in ("status", "verify_status", "last_error")}
    return d.withColumns(fields).select(packages.columns)


def upsert_with_children(old: DataFrame, new: DataFrame, key: list[str], values: list[str], children: DataFrame, new_children: DataFrame, child_key: str, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows of new put into old, and the children of every row that new has replaced by new's: an album with its artists.
    Children carry the row's key as `on` (one column) in child_key."""
    table = upsert(old, new, key, values)
    gone = new.select(F.col(on).alias(child_key)).distinct()
    return table, children.join(gone, child_key, "left_anti").unionByName(new_children)


def report(v: DataFrame) -> DataFrame:
    """One row: errors (missing or different files) and warnings (files that no manifest names) over all packages."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return v.agg(n(F.col("missing") + F.col("mismatched")).alias("errors"), n(F.col("extra")).alias("warnings"))


def status(packages: DataFrame, scan_counters: DataFrame, verify_counters_: DataFrame) -> DataFrame:
    """One row for a status page: the last scan's and the last check's counters and the packages by status."""
    by = packages.groupBy("status").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("packages"))
    one = lambda d, name: d.select(F.struct(*d.columns).alias(name))
    return one(scan_counters, "scan").join(F.broadcast(one(verify_counters_, "verify"))).join(F.broadcast(by))  # one row each


def scan(packages: DataFrame, found: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """The next package table, and the counters of the run (one row)."""
    acted = actions(packages, found)
    old = acted.where("old_id is not null").select(F.col("old_id").alias("id"), "path", "manifest_sha256", "fingerprint", status_of(F.col("problems"), F.col("missing")).alias("status"), F.array_join("problems", ",").alias("e"))
    top = packages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = next_ids(acted.where("old_id is null"), "path", F.lit(0)).crossJoin(F.broadcast(top)).withColumn("id", F.col("id") + F.col("top"))  # top is one row
    row = lambda d, problems, verify: d.select("id", "path", "manifest_sha256", "fingerprint", "status", verify.alias("verify_status"), F.lit(run).alias("last_scan"), F.nullif(problems, F.lit("")).alias("last_error"))
    seen = row(old, F.col("e"), F.lit("unverified")).unionByName(row(new.withColumn("status", status_of(F.col("problems"), F.col("missing"))), F.array_join("problems", ","), F.lit("unverified")))
    swept = packages.join(seen.select("id"), "id", "left_anti").withColumn("status", F.lit("unavailable"))
    table = seen.unionByName(swept)
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    counters = acted.agg(F.count("*").alias("total"), count("added"), count("updated"), count("moved"), count("invalid"), count("unchanged"))
    removed = packages.where("status <> 'unavailable'").join(seen.select("id"), "id", "left_anti").agg(F.count("*").alias("removed"))
    return table, counters.crossJoin(F.broadcast(removed))  # one row each


def upsert(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """old with the values of new where the key is in both, and the rest of new; null keys are equal. Of new rows with the same
    key the one with the least values stays."""
    one = new.groupBy(*key).agg(F.min(F.struct(*values)).alias("__v"))
    both = old.join(one.withColumnsRenamed({k: f"__{k}" for k in key}), _equal(key), "full")
    return both.select(*(F.coalesce(F.col(k), F.col(f"__{k}")).alias(k) for k in key), *(F.when(F.col("__v").isNotNull(), F.col(f"__v.{v}")).otherwise(F.col(v)).alias(v) for v in values))


def _equal(key: list[str]) -> Column:
    out = F.col(key[0]).eqNullSafe(F.col(f"__{key[0]}"))
    for k in key[1:]:
        out = out & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return out


def upsert_names(artists: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name): names that no artist has yet, in any ASCII case, get the next ids; the least spelling wins."""
    known = artists.select(fold(F.col("name")).alias("f"))
    new = names.withColumn("f", fold(F.col("name"))).join(known, "f", "left_anti").groupBy("f").agg(F.min("name").alias("name"))
    top = artists.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = next_ids(new, "f", F.lit(0)).crossJoin(F.broadcast(top)).select((F.col("id") + F.col("top")).alias("id"), "name")  # top is one row
    return artists.select("id", "name").unionByName(new)


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Content of a parent: all old rows of a parent that new has go."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def verified(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Per package: errors (missing files, digests that differ) and warnings (files that no manifest names)."""
    own = expected.select("package", "path", F.col("sha256").alias("want"))
    have = files.select("package", "path", F.col("sha256").alias("got"))
    bad = own.join(have, ["package", "path"], "left").groupBy("package").agg(
        F.count_if(F.col("got").isNull()).alias("missing"), F.count_if(F.col("got").isNotNull() & (F.col("got") != F.col("want"))).alias("mismatched"))
    extra = have.where("path <> 'manifest.json'").join(own, ["package", "path"], "left_anti").groupBy("package").agg(F.count("*").alias("extra"))
    d = bad.join(extra, "package", "full").na.fill(0, ["missing", "mismatched", "extra"])
    return d.withColumn("status", F.when(F.col("missing") + F.col("mismatched") > 0, "checksum-failed").when(F.col("extra") > 0, "warning").otherwise("valid"))


def verify_counters(v: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    return v.agg(F.count("*").alias("total"), is_("valid").alias("passed"), is_("warning").alias("warnings"), is_("checksum-failed").alias("failed"))


def issued(secrets: DataFrame, name: str, secret: str, now: Column, days: int | None = None) -> DataFrame:
    """(token_hash, name, created_at, last_used_at, expires_at, revoked_at): what is kept of new tokens or sessions; the secret
    itself isn't. Of one digest one row stays."""
    end = F.lit(None).cast("timestamp") if days is None else now + F.make_interval(days=F.lit(days))
    none = F.lit(None).cast("timestamp")
    return secrets.select(F.sha2(F.col(secret), 256).alias("token_hash"), F.col(name).alias("name"), now.alias("created_at"), none.alias("last_used_at"), end.alias("expires_at"), none.alias("revoked_at")).dropDuplicates(["token_hash"])


def listed(tokens: DataFrame, now: Column) -> DataFrame:
    """Tokens for a list: a short form of the digest, and whether each is active, expired or revoked; newest first."""
    state = F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at") < now, "expired").otherwise("active")
    return tokens.select(F.substring("token_hash", 1, 12).alias("id"), "name", "created_at", "last_used_at", state.alias("state")).orderBy(F.desc("created_at"), "id")


def extended(sessions: DataFrame, used: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Sessions that were used: last use now, end that many days later."""
    u = used.select("session_hash").distinct().withColumn("__used", F.lit(True))
    d = sessions.join(u, "session_hash", "left")
    return d.withColumns({"last_used_at": F.when(F.col("__used"), now).otherwise(F.col("last_used_at")), "expires_at": F.when(F.col("__used"), now + F.make_interval(days=F.lit(days))).otherwise(F.col("expires_at"))}).drop("__used")


def revoked(rows: DataFrame, key: str, keys: DataFrame, now: Column) -> DataFrame:
    """Rows of the keys are revoked now, unless they were before."""
    k = keys.select(key).distinct().withColumn("__hit", F.lit(True))
    return rows.join(k, key, "left").withColumn("revoked_at", F.when(F.col("__hit") & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at"))).drop("__hit")
