"""Policy tables: normalise, validate, layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema
from ..functions.tiers import AGGREGATES
from ..functions.units import duration_us, quantity_bytes
from .documents import merge_documents

LIMIT_FIELDS = ("ingest_bytes_per_second", "max_in_flight_bytes", "max_series", "max_series_soft", "max_part_size")


def _block(fields: dict[str, Column], written: list[str], sql_type: str) -> Column:
    """A struct of the fields, or null when none of them was written (the block is absent)."""
    body = F.struct(*[c.alias(n) for n, c in fields.items()]).cast(sql_type)
    return F.when(F.coalesce(*[F.col(w).cast("string") for w in written]).isNotNull(), body)


def normalize_policies(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Text durations to microseconds and quantities to bytes; an empty block becomes null.

    Everything is evaluated inside the row. Malformed text fails the job unless `strict` is off.
    """
    us = lambda c: duration_us(c, strict)
    nbytes = lambda name: quantity_bytes(F.col(name), strict)
    down = F.transform(
        "downsample",
        lambda t: F.struct(
            us(t["after"]).alias("after_us"), us(t["interval"]).alias("interval_us"), F.nullif(t["agg"], F.lit("")).alias("agg")
        ),
    ).cast(schema.DOWNSAMPLE)
    prec = F.transform("precision", lambda t: F.struct(us(t["after"]).alias("after_us"), t["bits"].alias("bits"))).cast(schema.PRECISION)
    recompress = F.when(
        F.col("recompress").isNotNull(),
        F.struct(us(F.col("recompress.after")).alias("after_us"), F.col("recompress.level").alias("level")).cast(schema.RECOMPRESS),
    )
    limits = {f: F.col(f).cast("long") if f.startswith("max_series") else nbytes(f) for f in LIMIT_FIELDS}
    return raw.select(
        "tenant",
        _block({"max_age_us": us(F.col("max_age")), "max_bytes": nbytes("max_bytes")}, ["max_age", "max_bytes"], schema.RETENTION).alias("retention"),
        _block(limits, list(LIMIT_FIELDS), schema.LIMITS).alias("limits"),
        F.when(F.size("downsample") > 0, down).alias("downsample"),
        F.when(F.size("precision") > 0, prec).alias("precision"),
        recompress.alias("recompress"),
        F.col("signals").cast(schema.SIGNAL_TOGGLES).alias("signals"),
        F.col("shards").cast("int").alias("shards"),
        F.col("rf").cast("int").alias("rf"),
    )


def _finding(bad: Column, rule: int | Column, group: int, field: str | Column, tier: Column | None = None, other: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(
        F.lit(group).alias("group"),
        (none if tier is None else tier.cast("int")).alias("tier"),
        F.lit(rule).alias("rule"),
        (F.lit(field) if isinstance(field, str) else field).alias("field"),
        (none if other is None else other.cast("int")).alias("other_tier"),
        F.coalesce(bad, F.lit(False)).alias("bad"),
    )


def policy_violations(policies: DataFrame, first_only: bool = False) -> DataFrame:
    """One row per broken rule; `first_only` keeps the one reported first.

    Rules are numbered in evaluation order; 18 to 24 are schema rules and fire before the others.
    All rules, also those over tiers, look at one policy row only, so nothing is shuffled.
    """
    age, signals, lim = F.col("retention.max_age_us"), F.col("signals"), F.col("limits")
    soft, hard = lim["max_series_soft"], lim["max_series"]
    on = [F.coalesce(signals[s], F.lit(True)) for s in schema.SIGNALS]
    rec = F.col("recompress")

    def past(after: Column) -> Column:
        return (age > 0) & (after >= age)

    single = [
        _finding(~(on[0] | on[1] | on[2] | on[3]), 1, 1, "signals"),
        _finding(age < 0, 2, 2, "retention.max_age"),
        _finding(F.col("retention.max_bytes") < 0, 3, 3, "retention.max_bytes"),
        _finding(lim["ingest_bytes_per_second"] < 0, 4, 4, "limits.ingest_bytes_per_second"),
        _finding(lim["max_in_flight_bytes"] < 0, 5, 5, "limits.max_in_flight_bytes"),
        _finding(lim["max_part_size"] < 0, 6, 6, "limits.max_part_size"),
        _finding((soft > 0) & (F.coalesce(hard, F.lit(0)) <= 0), 7, 7, "limits.max_series_soft"),
        _finding((soft > 0) & (hard > 0) & (soft > hard), 8, 8, "limits.max_series_soft"),
        _finding(rec["after_us"] <= 0, 14, 14, "recompress.after"),
        _finding(past(rec["after_us"]), 17, 17, "recompress.after"),
        _finding(~rec["level"].between(1, 19), 20, 0, "recompress.level"),
        _finding(hard < 0, 21, 0, "limits.max_series"),
        _finding(soft < 0, 22, 0, "limits.max_series_soft"),
        _finding(F.col("rf") < 1, 23, 0, "rf"),
        _finding(F.col("shards") < 0, 24, 0, "shards"),
    ]

    def earlier(tiers: Column, t: Column) -> Column:
        """Index of the first tier with this tier's age."""
        return F.array_position(F.transform(tiers, lambda x: x["after_us"]), t["after_us"]) - 1

    def down(t: Column, i: Column) -> Column:
        tiers = F.col("downsample")
        return F.array(
            _finding(t["after_us"] < 0, 9, 9, "downsample.after", i),
            _finding(F.coalesce(t["interval_us"], F.lit(0)) <= 0, 10, 9, "downsample.interval", i),
            _finding(earlier(tiers, t) < i, 11, 9, "downsample.after", i, F.when(earlier(tiers, t) < i, earlier(tiers, t))),
            _finding(past(t["after_us"]), 15, 15, "downsample.after", i),
            _finding(~t["agg"].isin(*AGGREGATES), 18, 0, "downsample.agg", i),
        )

    def prec(t: Column, i: Column) -> Column:
        tiers = F.col("precision")
        return F.array(
            _finding(t["after_us"] < 0, 12, 12, "precision.after", i),
            _finding(earlier(tiers, t) < i, 13, 12, "precision.after", i, F.when(earlier(tiers, t) < i, earlier(tiers, t))),
            _finding(past(t["after_us"]), 16, 16, "precision.after", i),
            _finding(~t["bits"].between(1, 63), 19, 0, "precision.bits", i),
        )

    def per_tier(name: str, rules) -> Column:
        nothing = F.array(single[0]).cast(_FINDINGS)
        found = F.flatten(F.transform(name, rules)).cast(_FINDINGS)
        return F.when(F.col(name).isNull(), F.slice(nothing, 1, 0)).otherwise(found)

    every = F.concat(F.array(*single).cast(_FINDINGS), per_tier("downsample", down), per_tier("precision", prec))
    broken = F.array_sort(F.filter(every, lambda v: v["bad"]))
    if first_only:
        broken = F.slice(broken, 1, 1)
    # Outer, then a filter: a plain explode would evaluate all rules a second time to check the size.
    return policies.select("tenant", F.explode_outer(broken).alias("v")).filter(F.col("v").isNotNull()).select(
        "tenant",
        F.col("v.rule").alias("rule"),
        F.col("v.field").alias("field"),
        F.col("v.tier").alias("tier"),
        F.col("v.other_tier").alias("other_tier"),
        (F.col("v.rule") == 1).alias("retryable"),
    )


_FINDINGS = "array<struct<group:int,tier:int,rule:int,field:string,other_tier:int,bad:boolean>>"

# Where each policy field sits in a policy document.
POLICY_PATHS = {
    "max_age": ("retention", "max_age"),
    "max_bytes": ("retention", "max_bytes"),
    "ingest_bytes_per_second": ("limits", "ingest_bytes_per_second"),
    "max_in_flight_bytes": ("limits", "max_in_flight_bytes"),
    "max_series": ("limits", "max_series"),
    "max_series_soft": ("limits", "max_series_soft"),
    "max_part_size": ("limits", "max_part_size"),
    "downsample": ("downsample",),
    "precision": ("precision",),
    "recompress_after": ("recompress", "after"),
    "recompress_level": ("recompress", "level"),
    "metrics": ("signals", "metrics"),
    "logs": ("signals", "logs"),
    "traces": ("signals", "traces"),
    "profiles": ("signals", "profiles"),
    "rf": ("rf",),
    "shards": ("shards",),
}


def _tiers(name: str, kind: str, strict: bool) -> Column:
    """A tier list from its text; one that is none fails the job, or is null if not strict."""
    tiers = F.from_json(name, kind)
    if strict:
        broken = F.raise_error(F.concat(F.lit(f"{name} of tenant "), F.col("tenant"), F.lit(" is no list of tiers: "), F.col(name))).cast(kind)
        tiers = F.when(F.col(name).isNotNull() & tiers.isNull(), broken).otherwise(tiers)
    return tiers.alias(name)


# The fields of a tier, and which of them it cannot do without.
TIER_FIELDS = {"downsample": (("after", "interval", "agg"), ("after", "interval")), "precision": (("after", "bits"), ("after", "bits"))}


def document_violations(paths: DataFrame) -> DataFrame:
    """What of policy documents would be dropped in silence: doc, path (dotted), problem and, of a tier, its index and field.

    `unknown path`: no policy field stands there. `wrong kind`: a plain value or list where an object
    belongs, a list of tiers that is none, or a list where a plain value belongs. `unknown field` and
    `missing field`: of a tier. Null and an empty object unset what is below them and are fine. A row is
    looked at by itself, so nothing is shuffled.
    """
    dotted = F.array_join("path", ".")
    fields = [".".join(p) for p in POLICY_PATHS.values()]
    above = sorted({".".join(p[:i]) for p in POLICY_PATHS.values() for i in range(1, len(p))})
    lists = F.col("path").getItem(0).isin(*TIER_FIELDS) & (F.size("path") == 1)
    tiers = F.from_json("value_json", "array<map<string,string>>")
    whole = (F.col("kind") == "list") & tiers.isNotNull() & F.forall(F.coalesce(tiers, F.array()), lambda t: t.isNotNull())
    unset = F.col("kind").isin("null", "empty_object")
    problem = (
        F.when(~dotted.isin(*fields, *above), F.lit("unknown path"))
        .when(unset, F.lit(None).cast("string"))
        .when(dotted.isin(*above) | F.when(lists, ~whole).otherwise(F.col("kind") == "list"), F.lit("wrong kind"))
    )

    def finding(what: str | Column, tier: Column, field: Column) -> Column:
        return F.struct((F.lit(what) if isinstance(what, str) else what).alias("problem"), tier.cast("int").alias("tier"), field.cast("string").alias("field"))

    none = F.lit(None)
    found = F.array(finding(problem, none, none))
    for name, (known, needed) in TIER_FIELDS.items():
        odd = lambda t, i: F.transform(F.array_except(F.map_keys(t), F.array(*map(F.lit, known))), lambda f: finding("unknown field", i, f))
        lost = lambda t, i: F.transform(F.filter(F.array(*map(F.lit, needed)), lambda f: F.element_at(t, f).isNull()), lambda f: finding("missing field", i, f))
        per_tier = F.flatten(F.transform(tiers, lambda t, i: F.concat(odd(t, i), lost(t, i))))
        found = F.concat(found, F.when((dotted == name) & whole, per_tier).otherwise(F.slice(found, 1, 0)))
    rows = paths.select("doc", dotted.alias("path"), F.explode(F.filter(found, lambda v: v["problem"].isNotNull())).alias("v"))
    return rows.select("doc", "path", "v.problem", "v.tier", "v.field")


def policy_from_paths(paths: DataFrame, strict: bool = False) -> DataFrame:
    """Path rows of policy documents (doc = tenant) back to the raw policy table, one grouping.

    A tier list that is none is null, or fails the job if `strict`. Rows are dealt out by tenant before they
    are grouped: largest texts are found in sorted rows, and a task that reads would sort all that it makes.
    """
    value = F.get_json_object(F.concat(F.lit('{"v":'), F.col("value_json"), F.lit("}")), "$.v")
    rows = paths.select(F.col("doc").alias("tenant"), F.array_join("path", ".").alias("_path"), value.alias("_value")).repartition("tenant")
    flat = rows.groupBy("tenant").agg(*[F.max(F.when(F.col("_path") == ".".join(p), F.col("_value"))).alias(n) for n, p in POLICY_PATHS.items()])
    toggles = F.struct(*[F.col(s).cast("boolean").alias(s) for s in schema.SIGNALS])
    return flat.select(
        "tenant",
        "max_age",
        "max_bytes",
        "ingest_bytes_per_second",
        "max_in_flight_bytes",
        F.col("max_series").cast("long").alias("max_series"),
        F.col("max_series_soft").cast("long").alias("max_series_soft"),
        "max_part_size",
        _tiers("downsample", "array<struct<after:string,interval:string,agg:string>>", strict),
        _tiers("precision", "array<struct<after:string,bits:int>>", strict),
        F.when(
            F.col("recompress_after").isNotNull(),
            F.struct(F.col("recompress_after").alias("after"), F.col("recompress_level").cast("int").alias("level")),
        ).alias("recompress"),
        F.when(F.coalesce(*schema.SIGNALS).isNotNull(), toggles).alias("signals"),
        F.col("rf").cast("int").alias("rf"),
        F.col("shards").cast("int").alias("shards"),
    )


def effective_policies(tenants: DataFrame, default: list[tuple[list[str], str, str]], overrides: DataFrame, strict: bool = True) -> DataFrame:
    """Every tenant's policy: its document over the default document, normalised.

    `default` is the default document as (path, value_json, kind) entries, written into the plan.
    A tenant without overrides gets the default. Strict, a tier list that is none fails the job, as do
    malformed durations and quantities; `document_violations` lists what is wrong before.
    """
    entries = F.array(*[F.struct(F.array(*[F.lit(p) for p in path]).alias("path"), F.lit(v).alias("value_json"), F.lit(k).alias("kind")) for path, v, k in default])
    base = tenants.select(F.col("tenant").alias("doc"), F.explode(entries).alias("e")).select("doc", "e.path", "e.value_json", "e.kind")
    return normalize_policies(policy_from_paths(merge_documents(base, overrides), strict), strict)
