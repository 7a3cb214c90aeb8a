import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SF

from tidewarden.llm import packing
from tidewarden.llm.queries import REGISTRY

WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(plain_ids, "library"):
        plain_ids.library = Tokenizer.from_file(WORDS)
        plain_ids.library.encode_special_tokens = True
    return [*plain_ids.library.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, capacity=packing.CAPACITY):
    """Every piece of every document once, sequences without gaps; the number of sequences."""
    ids = {d: plain_ids(t) for d, t in texts.items()}
    want = {}
    for d, own in ids.items():
        for i, at in enumerate(range(0, len(own), capacity)):
            part = own[at : at + capacity]
            want[d, i] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert len(rows) == len(want)
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), -(-sum(map(len, ids.values())) // capacity)


def test_query_on_the_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    used, least = check(REGISTRY["op13_best_fit_packing"](spark, SF).collect(), texts)
    assert used <= least + 1


def test_odd_texts_and_empty_table(spark, odd, sf_dir, empty_dir):
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    check(REGISTRY["op13_best_fit_packing"](spark, sf_dir).collect(), texts)
    out = REGISTRY["op13_best_fit_packing"](spark, empty_dir)
    assert out.count() == 0 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_repeated_rows_and_small_capacity(spark):
    rows = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (None, "a"), (2, None)] + [(i, "word " * (i % 9)) for i in range(10, 80)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, capacity=5).collect()
    assert sum(r["length"] for r in out) == sum(len(plain_ids(t)) for _, t in rows)
    seen = defaultdict(set)
    for r in out:
        span = set(range(r["offset"], r["offset"] + r["length"]))
        assert not span & seen[r["sequence_id"]] and max(span) < 5
        seen[r["sequence_id"]] |= span
    assert all(s == set(range(len(s))) for s in seen.values())


def best_fit_decreasing(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= x]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_against_plain_best_fit(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([40, 100, 512])
    shape = rnd.choice([lambda: rnd.randint(1, capacity), lambda: rnd.randint(capacity // 3, capacity // 2 + 3), lambda: rnd.choice([capacity // 3 + 1, capacity // 2, 7, 1])])
    items = [shape() for _ in range(rnd.choice([3, 60, 700]))]
    lengths, counts = np.unique(items, return_counts=True)
    rows = packing.plan(lengths, counts, capacity)
    total = dict(zip(lengths.tolist(), counts.tolist()))
    used = defaultdict(list)
    for i, (length, first, sequence, times, offset) in enumerate(rows.tolist()):
        last = rows[i + 1, 1] if i + 1 < len(rows) and rows[i + 1, 0] == length else total[length]
        for k in range(last - first):
            used[sequence + k // times].append((offset + k % times * length, length))
    assert sorted(x for own in used.values() for _, x in own) == sorted(items)
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert -(-sum(items) // capacity) <= len(used) <= best_fit_decreasing(items, capacity) + 1


def test_configurations_reach_the_fractional_optimum():
    columns, use = packing.configurations(np.array([51, 34, 27]), np.array([10.0, 30.0, 20.0]), 100)
    assert np.allclose(columns @ use, [10, 30, 20]) and (use >= -1e-9).all()
    # 51+34, 34+34+27 (95) and the like: no mix needs fewer than the total length allows, and none can beat it.
    assert sum(use) >= (10 * 51 + 30 * 34 + 20 * 27) / 100 - 1e-9
    assert (columns.T @ np.array([51, 34, 27]) <= 100).all()
