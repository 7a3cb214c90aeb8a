import json
import random

import pytest

from tidewarden.operators.documents import RESERVED_PATHS, config_drift, flatten_documents, merge_documents, reserved_path_report, reserved_path_violations


def laid_over(low, high):
    """The definition, on nested dicts."""
    out = dict(low)
    for k, v in high.items():
        out[k] = laid_over(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def paths(doc):
    """{path: json} of the leaves; an empty object below the root is a leaf."""
    out = {}

    def walk(prefix, v):
        if isinstance(v, dict) and (v or not prefix):
            for k, x in v.items():
                walk((*prefix, k), x)
        else:
            out[prefix] = v

    walk((), doc)
    return out


def flat(spark, docs):
    return flatten_documents(spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "doc string, body string"))


def collected(df, names):
    out = {n: {} for n in names}
    for r in df.collect():
        assert tuple(r["path"]) not in out[r["doc"]]
        out[r["doc"]][tuple(r["path"])] = json.loads(r["value_json"])
    return out


def test_texts_of_leaves(spark):
    body = r''' {"a": 1.10, "n":null, "s":"xA\n\"q\" {#1, \\", "#": "#5", "=": "=", "e":"", "q":"\"#7\"",
      "o":{ "e":{}, "z": [1.50, {"k": "a  b:1 , \"=x"}, "\"#9", []], "big": 1234567890123456789012345678901234567890123.50, "t":true, "5":-5e-3}, "é.x":{"":0}, "\u0041":"\u0042"}'''
    want = {
        ("a",): "1.10", ("n",): "null", ("s",): json.dumps('xA\n"q" {#1, \\'), ("#",): '"#5"', ("=",): '"="', ("e",): '""', ("q",): json.dumps('"#7"'),
        ("o", "e"): "{}", ("o", "z"): r'[1.50,{"k":"a  b:1 , \"=x"},"\"#9",[]]', ("o", "big"): "1234567890123456789012345678901234567890123.50",
        ("o", "t"): "true", ("o", "5"): "-5e-3", ("é.x", ""): "0", ("A",): '"B"',
    }
    docs = spark.createDataFrame([("d", body), ("none", None), ("empty", "{ }")], "doc string, body string")
    out = flatten_documents(docs)
    assert {tuple(r["path"]): r["value_json"] for r in out.collect()} == want
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    kinds = {tuple(r["path"]): r["kind"] for r in out.collect()}
    assert (kinds["n",], kinds["o", "e"], kinds["o", "z"], kinds["o", "t"]) == ("null", "empty_object", "list", "scalar")
    assert flatten_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("body", ['{"a":1"}', '{"a":1', "[1]", "7", "", '{"a":01}', '{"a":1,"a":2}', "{'a':1}"])
def test_what_is_no_document_fails(spark, body):
    with pytest.raises(Exception):
        flatten_documents(spark.createDataFrame([("d", body)], "doc string, body string")).collect()


ABSENT = object()
VALUES = {"absent": ABSENT, "number": 7, "text": "q", "list": [1, [2]], "null": None, "object": {"k": 1}, "other object": {"m": {"n": 2}}, "empty object": {}}


def test_every_kind_of_value_over_every_other(spark):
    """At the root and two levels down, beside a key that neither side touches."""
    hold = lambda v, deep: {"z": 0} if v is ABSENT else {"x": {"y": v}, "z": 0} if deep else {"x": v, "z": 0}
    cases = {f"{b} under {o} {deep}": (hold(VALUES[b], deep), hold(VALUES[o], deep)) for b in VALUES for o in VALUES for deep in (False, True)}
    base, over = ({n: c[k] for n, c in cases.items()} for k in (0, 1))
    got = collected(merge_documents(flat(spark, base), flat(spark, over)), cases)
    for name in cases:
        assert got[name] == paths(laid_over(base[name], over[name])), name


def random_doc(rnd, depth=3):
    out = {}
    for k in rnd.sample("abcd", rnd.randrange(4)):
        kind = rnd.randrange(6 if depth else 3)
        out[k] = [rnd.randrange(9), None, [1, {"x": 2}], {}][kind] if kind < 4 else random_doc(rnd, depth - 1)
    return out


def test_random_documents(spark):
    rnd = random.Random(2)
    base, over = ({f"d{i}": random_doc(rnd) for i in range(150)} for _ in range(2))
    got = collected(merge_documents(flat(spark, base), flat(spark, over)), base)
    for name in base:
        assert got[name] == paths(laid_over(base[name], over[name])), name


def test_any_depth_and_bad_input(spark):
    deep: dict = {"leaf": 1}
    for _ in range(60):
        deep = {"k": deep}
    assert flat(spark, {"d": deep}).first()["path"] == ["k"] * 60 + ["leaf"]
    assert flat(spark, {"d": {"a": [], "b": {}, "c": None, "d": "é"}}).count() == 4
    for body in ("[1]", "{"):
        with pytest.raises(Exception):
            flatten_documents(spark.createDataFrame([("d", body)], "doc string, body string")).collect()


def nested(path, value):
    for key in reversed(path.split(".")):
        value = {key: value}
    return value


def test_reserved_paths(spark):
    """Each owned path itself, what lies below and beside it, and what would wipe it."""
    docs, want = {}, {}
    for path in RESERVED_PATHS:
        for name, value in (("at", 5), ("below", {"p": {"q": [1]}}), ("emptied", {})):
            docs[f"{name} {path}"], want[f"{name} {path}"] = nested(path, value), [(path, "reserved")]
        docs[f"dotted {path}"], want[f"dotted {path}"] = {path: 5}, [(path, "reserved")]
        docs[f"beside {path}"], want[f"beside {path}"] = nested(f"{path}_of_mine", 5), []
        for n in range(1, path.count(".") + 1):
            parent = ".".join(path.split(".")[:n])
            docs[f"wiped {parent}"], want[f"wiped {parent}"] = nested(parent, 5), [(parent, "ancestor_clobber")]
            docs[f"empty {parent}"], want[f"empty {parent}"] = nested(parent, {}), []
    both = sorted(RESERVED_PATHS)[:2]
    docs["two"], want["two"] = laid_over(nested(both[0], 1), nested(both[1], 1)), [(p, "reserved") for p in both]
    found = reserved_path_violations(flat(spark, docs))
    rows = found.collect()
    for name in docs:
        assert sorted((r["path"], r["kind"]) for r in rows if r["doc"] == name) == sorted(want[name]), name
    report = {r["doc"]: r["message"] for r in reserved_path_report(found).collect()}
    assert report["two"] == "not open to tenants: " + ", ".join(f"{p} ({RESERVED_PATHS[p]})" for p in both)
    assert set(report) == {n for n, w in want.items() if w and w[0][1] == "reserved"}


def test_drift(spark):
    want = spark.createDataFrame([("same", "x"), ("changed", "y"), ("new", "z")], "cluster string, document string")
    have = spark.createDataFrame([("same", "2d711642b726b044"), ("changed", "2d711642b726b044"), ("gone", "0")], "cluster string, fingerprint string")
    assert {r["cluster"]: r["needs_rollout"] for r in config_drift(want, have).collect()} == {"same": False, "changed": True, "new": True, "gone": True}
