"""Policy cases: normalisation and every validation rule."""

import pytest
from pyspark.sql import functions as F

from tidewarden.operators.policy import effective_policies, normalize_policies, policy_violations
from tidewarden.plans.merge_job import InvalidPolicy, check_policies
from tidewarden.schema import DOCUMENT_PATHS, RAW_POLICIES

FIELDS = [p.strip().split(" ")[0].split(":")[0] for p in (
    "tenant", "max_age", "max_bytes", "ingest_bytes_per_second", "max_in_flight_bytes", "max_series", "max_series_soft", "max_part_size",
    "downsample", "precision", "recompress", "signals", "rf", "shards")]


def policies(spark, *cases):
    rows = [tuple({"tenant": f"c{i}", **case}.get(f) for f in FIELDS) for i, case in enumerate(cases)]
    return normalize_policies(spark.createDataFrame(rows, RAW_POLICIES))


def ds(*tiers):
    return {"downsample": [(*t, None)[:3] for t in tiers]}


#: Each rule at its edge: one below, the edge itself, one above.
SIZES = {"max_bytes": 3, "ingest_bytes_per_second": 4, "max_in_flight_bytes": 5, "max_part_size": 6}
CASES = [
    *[(f"{field} {value}", {field: value}, [rule] if value == "-1" else []) for field, rule in SIZES.items() for value in ("-1", "1")],
    *[(f"max_age {value}", {"max_age": value}, [2] if value == "-1s" else []) for value in ("-1s", "0", "1s")],
    *[(f"soft {soft} over 10", {"max_series": 10, "max_series_soft": soft}, [8] if soft > 10 else []) for soft in (9, 10, 11)],
    ("soft alone", {"max_series_soft": 1}, [7]),
    *[(f"rollup after {a}", ds((a, "3m")), [9] if a == "-1s" else []) for a in ("-1s", "1s")],
    *[(f"interval {x}", ds(("5h", x)), [10] if x == "0s" else []) for x in ("0s", "1s")],
    *[(f"tiers 5h and {a}", ds(("5h", "3m"), (a, "9m")), [11] if a in ("5h", "300m") else []) for a in ("5h", "300m", "301m", "4h")],
    *[(f"precision after {a}", {"precision": [(a, 20)]}, [12] if a == "-1s" else []) for a in ("-1s", "1s")],
    *[(f"precision 5h and {a}", {"precision": [("5h", 20), (a, 10)]}, [13] if a == "5h" else []) for a in ("5h", "6h")],
    *[(f"recompress after {a}", {"recompress": (a, None)}, [14] if a == "0" else []) for a in ("0", "1s")],
    *[(f"rollup {a} within 5h", {"max_age": "5h", **ds((a, "3m"))}, [15] if a != "4h" else []) for a in ("4h", "5h", "6h")],
    *[(f"precision {a} within 5h", {"max_age": "5h", "precision": [(a, 20)]}, [16] if a != "4h" else []) for a in ("4h", "5h", "6h")],
    *[(f"recompress {a} within 5h", {"max_age": "5h", "recompress": (a, None)}, [17] if a != "4h" else []) for a in ("4h", "5h", "6h")],
    ("kept for ever", {"max_age": "0", **ds(("999h", "3m"))}, []),
    *[(f"{n} signals off", {"signals": (False,) * n + (None,) * (4 - n)}, [1] if n == 4 else []) for n in (0, 3, 4)],
    ("unknown aggregate", ds(("6h", "1m", "median")), [18]),
    ("empty aggregate is unset", ds(("6h", "1m", "")), []),
    ("bits out of range", {"precision": [("1h", 0), ("2h", 64), ("3h", 63)]}, [19, 19]),
    ("level out of range", {"recompress": ("1h", 20)}, [20]),
    ("negative series", {"max_series": -1, "max_series_soft": -1}, [21, 22]),
    ("replicas and shards", {"rf": 0, "shards": -1}, [23, 24]),
    ("several at once", {"max_age": "-1h", "max_bytes": "-1", "rf": 0}, [2, 3, 23]),
]


def test_violations(spark):
    found = policy_violations(policies(spark, *[c for _, c, _ in CASES])).collect()
    for i, (name, _, want) in enumerate(CASES):
        assert sorted(r["rule"] for r in found if r["tenant"] == f"c{i}") == want, name
    assert all(r["retryable"] == (r["rule"] == 1) for r in found)
    dup = next(r for r in found if r["rule"] == 11)
    assert (dup["tier"], dup["other_tier"]) == (1, 0)


def test_first_violation(spark):
    table = policies(
        spark,
        {"max_age": "-1h", "max_bytes": "-1", "rf": 0},
        {"max_age": "-1h", "signals": (False,) * 4},
        ds(("6h", "1m"), ("6h", "0s"), ("-1h", "1m")),
        {"max_age": "1h", **ds(("2h", "1m")), "precision": [("-1h", 3)]},
    )
    first = {r["tenant"]: (r["rule"], r["tier"]) for r in policy_violations(table, first_only=True).collect()}
    assert first == {"c0": (23, None), "c1": (1, None), "c2": (10, 1), "c3": (12, 0)}


def test_normalisation(spark):
    table = policies(
        spark,
        {},
        {"max_age": "720h", "max_bytes": "500Gi"},
        {"ingest_bytes_per_second": "50Mi", "max_in_flight_bytes": "1Gi", "max_series": 1_000_000, "max_series_soft": 800_000, "max_part_size": "256Mi"},
        {**ds(("6h", "1m"), ("72h", "5m", "avg")), "precision": [("72h", 32)], "recompress": ("72h", 19)},
        {"recompress": ("1h", None)},
    )
    r = {x["tenant"]: x for x in table.collect()}
    assert all(r["c0"][f] is None for f in ("retention", "limits", "downsample", "precision", "recompress"))
    assert tuple(r["c1"]["retention"]) == (2_592_000_000_000, 536_870_912_000) and r["c1"]["limits"] is None
    assert tuple(r["c2"]["limits"]) == (52_428_800, 1_073_741_824, 1_000_000, 800_000, 268_435_456) and r["c2"]["retention"] is None
    h = 3_600_000_000
    assert [tuple(t) for t in r["c3"]["downsample"]] == [(6 * h, h // 60, None), (72 * h, h // 12, "avg")]
    assert [tuple(t) for t in r["c3"]["precision"]] == [(72 * h, 32)] and tuple(r["c3"]["recompress"]) == (72 * h, 19)
    assert tuple(r["c4"]["recompress"]) == (h, None)


def test_effective_policy_layers(spark):
    default = [(["retention", "max_age"], '"720h"', "scalar"), (["limits", "max_series"], "10", "scalar"), (["rf"], "3", "scalar")]
    over = spark.createDataFrame(
        [("a", ["retention", "max_age"], '"24h"', "scalar"), ("b", ["limits"], "null", "null"), ("b", ["retention", "max_bytes"], "5", "scalar")], DOCUMENT_PATHS
    )
    tenants = spark.createDataFrame([("a",), ("b",), ("c",)], "tenant string")
    r = {x["tenant"]: x for x in effective_policies(tenants, default, over).collect()}
    h = 3_600_000_000
    assert tuple(r["a"]["retention"]) == (24 * h, None) and r["a"]["limits"]["max_series"] == 10
    assert tuple(r["b"]["retention"]) == (720 * h, 5) and r["b"]["limits"] is None
    assert tuple(r["c"]["retention"]) == (720 * h, None) and r["c"]["rf"] == 3


def test_merge_refuses_bad_policies(spark):
    check_policies(policies(spark, {"max_age": "720h"}))
    with pytest.raises(InvalidPolicy, match="rule 2"):
        check_policies(policies(spark, {"max_age": "-1h"}))


def test_validation_needs_no_shuffle(spark):
    plan = policy_violations(policies(spark, {})).select(F.col("rule"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_documents_that_would_be_dropped_in_silence(spark):
    from tidewarden.operators.policy import document_violations

    rows = [
        ("a", ["downsample"], '"oops"', "scalar"), ("b", ["downsample"], '[{"after":"1h","intervall":"1m"},7]', "list"), ("c", ["downsample"], '[{"after":"1h","intervall":"1m"}]', "list"),
        ("d", ["retention"], "7", "scalar"), ("e", ["retention"], "{}", "empty_object"), ("f", ["retention"], "null", "null"), ("g", ["retention", "max_age", "x"], "1", "scalar"),
        ("h", ["precision"], "[]", "list"), ("i", ["limits", "max_series"], "[1]", "list"), ("j", ["precision"], '[{"after":"1h"},{"bits":3,"after":null}]', "list"), ("k", ["rf"], "3", "scalar"),
    ]
    found = {tuple(r) for r in document_violations(spark.createDataFrame(rows, DOCUMENT_PATHS)).collect()}
    assert found == {
        ("a", "downsample", "wrong kind", None, None), ("b", "downsample", "wrong kind", None, None), ("c", "downsample", "unknown field", 0, "intervall"), ("c", "downsample", "missing field", 0, "interval"),
        ("d", "retention", "wrong kind", None, None), ("g", "retention.max_age.x", "unknown path", None, None), ("i", "limits.max_series", "wrong kind", None, None),
        ("j", "precision", "missing field", 0, "bits"), ("j", "precision", "missing field", 1, "after"),
    }


def test_a_broken_tier_list_fails_and_a_lost_interval_is_a_violation(spark):
    tenants = spark.createDataFrame([("t",)], "tenant string")

    def effective(text):
        return effective_policies(tenants, [(["rf"], "3", "scalar")], spark.createDataFrame([("t", ["downsample"], text, "list")], DOCUMENT_PATHS))

    with pytest.raises(Exception, match="no list of tiers"):
        effective('"oops"').collect()
    assert [r["rule"] for r in policy_violations(effective('[{"after":"1h","intervall":"1m"}]')).collect()] == [10]


def test_effective_policies_hold_no_table_of_all_tenants(spark):
    """No side is sent to every task, and tasks that read neither sort nor aggregate what they make."""
    tenants = spark.range(5).selectExpr("concat('t', id) AS tenant")
    over = tenants.selectExpr("tenant AS doc", "array('rf') AS path", "'5' AS value_json", "'scalar' AS kind")
    plan = effective_policies(tenants, [(["rf"], "3", "scalar"), (["limits", "max_series"], "1", "scalar")], over)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "HashAggregate" not in plan
    from_the_top = [line.lstrip(" :+-").split("(")[0].split(" ")[0] for line in plan.splitlines()]
    assert from_the_top.index("Exchange") > max(i for i, op in enumerate(from_the_top) if op == "SortAggregate")
