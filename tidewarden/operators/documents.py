"""Configuration documents as path/value rows: merge, reserved paths, drift.

A document is one row per leaf: `(doc, path ARRAY<STRING>, value_json, kind)` with kind `scalar`,
`list`, `null` or `empty_object`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import fingerprint

_DEPLOYED = "set where the store is deployed, not per tenant"
_ROUTED = "set by the signals column of the policy table"

# The paths. A path also covers everything below it; the text says what to set instead.
RESERVED_PATHS = {
    "metrics_backend": _ROUTED,
    "traces_backend": _ROUTED,
    "logs_backend": _ROUTED,
    "profiles_backend": _ROUTED,
    "storage.backend": _DEPLOYED,
    "storage.dir": _DEPLOYED,
    "storage.wal_dir": _DEPLOYED,
    "storage.s3": _DEPLOYED,
    "storage.cluster": "set by the columns rf and shards of the policy table",
    "storage.flush_interval": _DEPLOYED,
    "storage.read_cache_bytes": _DEPLOYED,
    "storage.decode_cache_bytes": _DEPLOYED,
    "storage.decode_memory_bytes": _DEPLOYED,
    "storage.aggregate_stats": "kept by the sidecar job",
    "storage.policy.retention": "set by the columns max_age and max_bytes of the policy table",
    "storage.policy.limits": "set by the limit columns of the policy table",
    "storage.policy.downsample": "set by the downsample column of the policy table",
    "storage.policy.precision": "set by the precision column of the policy table",
    "storage.policy.recompress": "set by the recompress column of the policy table",
}


# A JSON text as strings and what stands between them.
_TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++'
_NUMBER = "(-?[0-9][0-9.eE+-]*+)"


def _marked(body: Column) -> Column:
    """The text with numbers as strings behind a `#` and strings behind a `=`: a variant then keeps every number as it is written."""
    return F.array_join(
        F.transform(
            F.regexp_extract_all(body, F.lit(_TOKENS), F.lit(0)),
            lambda t: F.when(t.startswith('"'), F.concat(F.lit('"='), F.substr(t, F.lit(2)))).otherwise(F.regexp_replace(t, _NUMBER, '"#$1"')),
        ),
        "",
    )


def _unmarked(text: Column) -> Column:
    """Quotes inside strings follow a backslash, so only opening ones stand before a mark."""
    return F.regexp_replace(F.regexp_replace(text, f'(?<!\\\\)"#{_NUMBER}"', "$1"), r'(?<!\\)"=', '"')


def _depth(body: Column) -> Column:
    """How deep braces stand in one another, strings aside."""
    braces = F.split(F.regexp_replace(F.regexp_replace(body, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', ""), "[^{}]++", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, brace: Column) -> Column:
        now = at["now"] + F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(braces, start, step, lambda at: at["most"])


def _entries(path: Column, node: Column) -> Column:
    """The entries of an object: path, kind and variant of each."""

    def entry(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        name = (
            F.when(kind == "VOID", "null").when(kind == "OBJECT<>", "empty_object")
            .when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "list").otherwise("scalar")
        )
        return F.struct(F.concat(path, F.array(F.substr(e["key"], F.lit(2)))).alias("path"), name.alias("kind"), e["value"].alias("node"))

    return F.transform(F.map_entries(node.cast("map<string,variant>")), entry)


def flatten_documents(df: DataFrame, doc: str = "doc", body: str = "body") -> DataFrame:
    """JSON documents as path rows, at any depth; an empty object below the root is a leaf.

    Built-in functions open one level after the other inside the row, as many as the deepest document
    has, which one aggregate finds first. Numbers stay as they are written; names of objects inside
    lists come in order. A null body and an empty object give no row; malformed JSON, a name that
    repeats within an object and a text that is no object fail the job.
    """
    deepest = df.agg(F.max(_depth(F.col(body)))).first()[0] or 0
    whole = F.schema_of_variant(F.parse_json(F.col(body)))
    checked = F.when(whole.startswith("OBJECT"), F.col(body)).when(F.col(body).isNotNull(), F.raise_error(F.lit("a document must be a JSON object")))
    opened = df.select(F.col(doc).alias("doc"), _entries(F.array().cast("array<string>"), F.parse_json(_marked(checked))).alias("_leaves"))
    deeper = F.flatten(F.transform("_leaves", lambda e: F.when(e["kind"] == "object", _entries(e["path"], e["node"])).otherwise(F.array(e))))
    for _ in range(deepest - 1):
        opened = opened.select("doc", deeper.alias("_leaves"))
    # Outer, then a filter: a plain explode would open the documents twice.
    rows = opened.select("doc", F.explode_outer("_leaves").alias("_leaf")).filter(F.col("_leaf").isNotNull())
    return rows.select("doc", "_leaf.path", _unmarked(F.to_json("_leaf.node")).alias("value_json"), "_leaf.kind")


def _prefixes(path: Column, strict: bool) -> Column:
    """The paths above a path, with the path itself unless `strict`."""
    last = F.size(path) - 1 if strict else F.size(path)
    return F.when(last < 1, F.array().cast("array<array<string>>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda n: F.slice(path, 1, n))
    )


def _each(rows: DataFrame, paths: Column, *keep: Column | str) -> DataFrame:
    """`rows` once per path. An outer explode with a filter behind it works `paths` out once."""
    return rows.select(*keep, F.explode_outer(paths).alias("path")).filter(F.col("path").isNotNull())


def merge_documents(base: DataFrame, override: DataFrame) -> DataFrame:
    """Override documents laid over base documents with the same `doc`.

    Objects merge key by key; anything else, null and lists included, replaces. Written as equi
    joins on (doc, path): every path is compared with the paths above it, never with all others of
    its document. Paths above a row are few (the depth). They are dealt out as they are read: joins
    are merges, whose sorts spill, as no side is small when the documents are many, and repeated
    paths stay, as dropping them first would hold all keys of a scan's task in memory.
    """
    columns = ["doc", "path", "value_json", "kind"]
    base, override = base.select(*columns), override.select(*columns)
    # An empty object laid over an object changes nothing.
    empty = F.col("kind") == "empty_object"
    inner = F.when(empty, _prefixes(F.col("path"), strict=False)).otherwise(_prefixes(F.col("path"), strict=True))
    objects = _each(base, inner, "doc")
    onto = override.filter(empty).join(objects.hint("merge"), ["doc", "path"], "left_anti")
    effective = override.filter(~F.coalesce(empty, F.lit(False))).unionByName(onto)
    # A base row goes when an override sits on it or above it ...
    above = (
        _each(base, _prefixes(F.col("path"), strict=False), "doc", F.col("path").alias("leaf"))
        .join(effective.select("doc", "path").hint("merge"), ["doc", "path"], "left_semi")
        .select("doc", F.col("leaf").alias("path"))
    )
    # ... or below it, which turns its value into an object.
    below = _each(effective, _prefixes(F.col("path"), strict=True), "doc")
    gone = above.unionByName(below)
    return base.join(gone.hint("merge"), ["doc", "path"], "left_anti").unionByName(effective)


def reserved_path_violations(override: DataFrame, reserved: dict[str, str] | None = None) -> DataFrame:
    """Override rows at or below an owned path, one row per (doc, owned path), with the hint.

    kind `reserved`: the shortest owned path wins. kind `ancestor_clobber`: a plain value at a path
    above owned ones, which would wipe them. The list of owned paths is part of the plan.
    """
    reserved = RESERVED_PATHS if reserved is None else reserved
    dotted = F.transform(_prefixes(F.col("path"), strict=False), lambda p: F.array_join(p, "."))
    owned = F.array(*[F.lit(p) for p in sorted(reserved)])
    hints = F.create_map(*[F.lit(x) for kv in sorted(reserved.items()) for x in kv])
    hit = F.get(F.filter(dotted, lambda p: F.array_contains(owned, p)), F.lit(0))
    parents = sorted({".".join(p.split(".")[:n]) for p in reserved for n in range(1, p.count(".") + 1)})
    whole = F.array_join("path", ".")
    wipes = (
        whole.isin(parents)
        & (F.size(F.split(whole, r"\.")) == F.size("path"))
        & (F.col("kind") != "empty_object")
    )
    tagged = override.withColumn("_hit", hit).withColumn("_wipes", wipes)
    found = tagged.filter(F.col("_hit").isNotNull()).select("doc", F.col("_hit").alias("path"), F.lit("reserved").alias("kind"))
    clobber = tagged.filter(F.col("_hit").isNull() & F.col("_wipes")).select("doc", whole.alias("path"), F.lit("ancestor_clobber").alias("kind"))
    hint = F.coalesce(F.try_element_at(hints, F.col("path")), F.lit("wipes owned paths below it"))
    return found.unionByName(clobber).distinct().withColumn("hint", hint)


def reserved_path_report(violations: DataFrame) -> DataFrame:
    """One message per document with all its owned paths, sorted. At most one item per owned path."""
    items = F.sort_array(F.collect_set(F.struct("path", "hint")))
    text = F.array_join(F.transform(items, lambda v: F.concat(v["path"], F.lit(" ("), v["hint"], F.lit(")"))), ", ")
    return (
        violations.filter(F.col("kind") == "reserved")
        .groupBy("doc")
        .agg(F.size(items).cast("long").alias("n_paths"), F.concat(F.lit("not open to tenants: "), text).alias("message"))
    )


def config_drift(desired: DataFrame, observed: DataFrame) -> DataFrame:
    """Desired documents `(cluster, document)` against observed fingerprints `(cluster, fingerprint)`."""
    want = desired.select("cluster", fingerprint(F.col("document")).alias("desired_fingerprint"))
    have = observed.select("cluster", F.col("fingerprint").alias("observed_fingerprint"))
    w, h = F.col("desired_fingerprint"), F.col("observed_fingerprint")
    return want.join(have, "cluster", "full").withColumn("needs_rollout", ~w.eqNullSafe(h))
