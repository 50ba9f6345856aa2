"""Identity claims, resolution and snapshot application."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.functions.text import canonical

_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# Identifier types with canonical form, accepted pattern, strength and scope.
IDENTIFIER_TYPES = {
    "mac": ("lowerHexStripSeparators", "^[0-9a-f]{12}$", "strong", "global"),
    "serial": ("trimUpper", "^[A-Z0-9][A-Z0-9._/-]{0,63}$", "strong", "global"),
    "imei": ("digitsOnly", "^[0-9]{15}$", "strong", "global"),
    "ipv4": ("trimLower", rf"^({_OCTET}\.){{3}}{_OCTET}$", "weak", "global"),
    "ipv6": ("trimLower", "^(?=(.*:){2,})[0-9a-f:.]{2,45}$", "weak", "global"),
    "hostname": ("trimLower", r"^[a-z0-9]([a-z0-9-]{0,62})(\.[a-z0-9]([a-z0-9-]{0,62}))*$", "weak", "global"),
    "unifi-site-id": ("trimLower", _UUID, "strong", "provider"),
    "unifi-device-id": ("trimLower", _UUID, "strong", "provider"),
    "unifi-client-id": ("trimLower", _UUID, "strong", "provider"),
    "fronius-unique-id": ("trimUpper", "^[A-Z0-9]{1,32}$", "strong", "instance"),
    "fronius-logger-id": ("trimUpper", r"^[A-Z0-9]{1,32}(\.[A-Z0-9]{1,32})?$", "strong", "instance"),
}


def claim_key(kind: str, value: Column, scope: str | None = None, types: dict | None = None) -> Column:
    """``type:value``, or ``type@scope:value`` for a type that is unique within a
    provider or instance only, which then must be given; null where the value is not
    accepted. ``types`` may hold further types of the same form."""
    form, accept, _, reach = (IDENTIFIER_TYPES | (types or {}))[kind]
    if reach != "global" and not scope:
        raise ValueError(f"{kind} needs a scope")
    clean = canonical(value, form)
    name = kind if reach == "global" else f"{kind}@{scope}"
    return F.when(F.regexp_like(clean, F.lit(accept)), F.concat(F.lit(name + ":"), clean))


def edge_key(edge_type: Column, src: Column, dst: Column) -> Column:
    return F.concat(F.lit("edge:"), src.cast("string"), F.lit("|"), edge_type, F.lit("|"), dst.cast("string"))


def primary_key(claims: DataFrame) -> DataFrame:
    """(record_id, claim): the strongest claim, then the first in order."""
    rank = F.struct(F.when(F.col("strength") == "strong", 0).otherwise(1), F.col("claim"))
    return claims.groupBy("record_id").agg(F.min_by("claim", rank).alias("claim"))


def resolve(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Match records to elements by equal strong claims.

    ``claims`` is (record_id, claim, strength), ``known`` (claim, element_id).
    One row per record: element_id (null: create), outcome 'create', 'match' or
    'ambiguous' (several elements: that of the least claim, then the lower id).
    """
    strong = claims.where("strength = 'strong'").select("record_id", "claim").distinct()
    hits = strong.join(known.select("claim", "element_id").distinct(), "claim")
    best = hits.groupBy("record_id").agg(F.min(F.struct("claim", "element_id")).alias("b"), F.count_distinct("element_id").alias("n"))
    out = claims.select("record_id").distinct().join(best, "record_id", "left")
    outcome = F.when(F.col("n").isNull(), "create").when(F.col("n") == 1, "match").otherwise("ambiguous")
    return out.select("record_id", F.col("b.element_id").alias("element_id"), outcome.alias("outcome"))


def snapshot_diff(before: DataFrame, now: DataFrame, key: str, values: list[str], complete: bool = True) -> DataFrame:
    """(key, change) of every record: created, updated, unchanged, and withdrawn,
    which only a complete snapshot can tell (a partial one leaves it 'kept')."""
    a = before.select(F.col(key).alias("__a"), F.struct(*values).alias("old"))
    b = now.select(F.col(key).alias("__b"), F.struct(*values).alias("new"))
    joined = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    change = (
        F.when(F.col("__a").isNull(), "created")
        .when(F.col("__b").isNull(), "withdrawn" if complete else "kept")
        .when(F.col("old").eqNullSafe(F.col("new")), "unchanged")
        .otherwise("updated")
    )
    return joined.select(F.coalesce("__a", "__b").alias(key), change.alias("change"))


@dataclass
class Applied:
    """What a snapshot does: each table lists elements or claims, none is changed yet."""

    resolved: DataFrame  # record_id, element_id (null: new), outcome
    created: DataFrame  # record_id, props, claims
    updated: DataFrame  # element_id, props: those that differ, only
    claimed: DataFrame  # element_id, claim: keys a matched element does not have yet
    edges: DataFrame  # edge_key, src, dst, edge_type that this instance does not claim yet
    withdrawn: DataFrame  # element_id: this instance no longer claims it
    deleted: DataFrame  # element_id: nobody claims it any more


def apply_snapshot(
    records: DataFrame, claims: DataFrame, elements: DataFrame, known: DataFrame, claimants: DataFrame, instance: str, complete: bool, links: DataFrame | None = None, known_links: DataFrame | None = None
) -> Applied:
    """Lay a snapshot of one instance over the graph.

    ``records`` (record_id, props map), ``claims`` (record_id, claim, strength),
    ``elements`` (element_id, props map, durable), ``known`` (claim, element_id),
    ``claimants`` (element_id, instance), ``links`` (edge_type, src, dst: record
    ids), ``known_links`` (edge_key, instance). Records that match an element change
    only the properties that differ. Only a complete snapshot withdraws: an element
    that the instance claimed before and does not now loses its claim, and goes if no
    claimant is left and it is not durable. A partial one withdraws nothing.
    """
    resolved = resolve(claims.select("record_id", "claim", "strength").unionByName(records.select("record_id", F.lit(None).cast("string").alias("claim"), F.lit("weak").alias("strength"))), known)
    matched = resolved.where("element_id is not null").select("record_id", "element_id")
    keys = claims.where("claim is not null").groupBy("record_id").agg(F.array_sort(F.collect_set("claim")).alias("claims"))
    new = resolved.where("element_id is null").select("record_id")
    created = records.join(new, "record_id", "left_semi").join(keys, "record_id", "left").select("record_id", "props", "claims")
    both = records.join(matched, "record_id").join(elements.select("element_id", F.col("props").alias("old")), "element_id")
    differs = F.map_filter("props", lambda k, v: ~F.element_at(F.col("old"), k).eqNullSafe(v))
    updated = both.select("element_id", differs.alias("props")).where(F.size("props") > 0)
    claimed = claims.where("claim is not null").join(matched, "record_id").select("element_id", "claim").distinct().join(known, ["claim", "element_id"], "left_anti").select("element_id", "claim")
    spark = records.sparkSession
    edges = spark.createDataFrame([], "edge_key string, src string, dst string, edge_type string")
    if links is not None:
        primary = primary_key(claims.where("claim is not null"))
        end = lambda c: primary.select(F.col("record_id").alias(c), F.col("claim").alias(f"{c}_claim"))
        named = links.join(end("src"), "src").join(end("dst"), "dst")
        edges = named.select(edge_key(F.col("edge_type"), F.col("src_claim"), F.col("dst_claim")).alias("edge_key"), F.col("src_claim").alias("src"), F.col("dst_claim").alias("dst"), "edge_type").distinct()
        if known_links is not None:
            edges = edges.join(known_links.where(F.col("instance") == instance), "edge_key", "left_anti")
    before = claimants.where(F.col("instance") == instance).select("element_id").distinct()
    withdrawn = before.join(matched, "element_id", "left_anti") if complete else before.limit(0)
    others = claimants.where(F.col("instance") != instance).select("element_id")
    deleted = withdrawn.join(others, "element_id", "left_anti").join(elements.where("not durable").select("element_id"), "element_id", "left_semi")
    return Applied(resolved, created, updated, claimed, edges, withdrawn, deleted)


def validate(records: DataFrame, claims: DataFrame, links: DataFrame | None = None, scopes: tuple[str, ...] = (), types: dict | None = None) -> DataFrame:
    """(record_id, code) of what is wrong with a snapshot: ``records`` (record_id,
    label), ``claims`` (record_id, type, value), ``links`` (src, dst, edge_type).
    ``scopes`` lists the scopes that are given ('provider', 'instance')."""
    vocabulary = IDENTIFIER_TYPES | (types or {})
    told = lambda df, code, c="record_id": df.select(F.col(c).cast("string").alias("record_id"), F.lit(code).alias("code"))
    ids = records.select("record_id")
    out = [
        told(ids.where("record_id is null or trim(cast(record_id as string)) = ''"), "record-without-id"),
        told(ids.where("record_id is not null").groupBy("record_id").count().where("count > 1"), "duplicate-record"),
        told(records.where("label is null or trim(label) = ''"), "record-without-label"),
        told(claims.join(ids, "record_id", "left_anti"), "claim-of-unknown-record"),
        told(claims.where(~F.col("type").isin(*vocabulary) | F.isnull("type")), "unknown-identifier-type"),
    ]
    strong = claims.limit(0).select("record_id")
    for kind, (form, accept, strength, reach) in vocabulary.items():
        own = claims.where(F.col("type") == kind)
        good = F.coalesce(F.regexp_like(canonical(F.col("value"), form), F.lit(accept)), F.lit(False))
        out.append(told(own.where(~good), "rejected-identifier-value"))
        if reach != "global" and reach not in scopes:
            out.append(told(own, "missing-identifier-scope"))
        elif strength == "strong":
            strong = strong.unionAll(own.where(good).select("record_id"))
    out.append(told(ids.join(strong, "record_id", "left_anti"), "no-strong-identifier"))
    if links is not None:
        for end in ("src", "dst"):
            out.append(told(links.join(ids.select(F.col("record_id").alias(end)), end, "left_anti"), "edge-end-not-in-snapshot", end))
        out.append(told(links.where("edge_type is null or trim(edge_type) = ''"), "edge-without-type", "src"))
    return reduce(DataFrame.unionAll, out).distinct()


def report(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("n"))


def diagnostics(records: DataFrame, required: list[str], id_col: str = "record_id") -> DataFrame:
    """(record_id, code): missing required values and ids that occur twice."""
    codes = F.array_compact(F.array(*(F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing_{c}")) for c in required)))
    missing = records.select(F.col(id_col).alias("record_id"), F.explode(codes).alias("code"))
    twice = records.groupBy(F.col(id_col).alias("record_id")).agg(F.count("*").alias("n")).where("n > 1").select("record_id", F.lit("duplicate_id").alias("code"))
    return missing.unionByName(twice)


def summary(template: str, columns: list[str]) -> Column:
    """A line of text per row: ``{}`` stands for each column in turn."""
    return F.format_string(template.replace("%", "%%").replace("{}", "%s"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
