import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF

from tidewarden.llm import collocations
from tidewarden.llm.queries import REGISTRY


def plain(rows, least=30, longest=4, top=2000):
    """The contract, word by word."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = set()
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in some.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    around[p[i : i + size]] = max(around[p[i : i + size]], a)
        kept = []
        for p, a in some.items():
            if around[p] and 100 * around[p] >= 80 * a:
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return {tuple(r) for r in df.collect()}


def made(seed, rows, words="abcdefgh", langs=("en", "de", None)):
    rnd = random.Random(seed)
    marks = [" "] * 12 + [". ", ",", "\n", "\t", "  ", " ! ", "A "]
    return [(i, rnd.choice(langs), "".join(rnd.choice(words) + rnd.choice(marks) for _ in range(rnd.choice([0, 3, 40, 400])))) for i in range(rows)]


@pytest.mark.parametrize("seed, longest, shard", [(1, 4, 1 << 21), (2, 4, 150), (3, 3, 500), (4, 2, 100)])
def test_against_plain_counts(spark, monkeypatch, seed, longest, shard):
    monkeypatch.setattr(collocations, "CELL_ENTRIES", 40)
    rows = made(seed, 150, words=["a", "b", "c", "dé", "e", "thé", "f\0", "\x85g", "end"])
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    monkeypatch.setattr(collocations, "indexes", lambda d, t, c, f=collocations.indexes: f(d, t, c, shard))
    want = plain([(lang, text) for _, lang, text in rows], longest=longest)
    assert len(want) > 20 and got(collocations.mine(docs, longest=longest)) == want


def test_query_on_the_table(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(REGISTRY["op11_phrase_collocations"](spark, SF)) == plain(rows)


def test_odd_rows_and_empty_table(spark, odd, sf_dir, empty_dir):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert got(REGISTRY["op11_phrase_collocations"](spark, sf_dir)) == plain(rows)
    assert got(REGISTRY["op11_phrase_collocations"](spark, empty_dir)) == set()


def test_number_arrays_come_back_whole():
    rng = np.random.default_rng(3)
    for numbers in (np.zeros(0, np.int64), np.array([2**63 - 1, -(2**63), 0, 7]), np.sort(rng.integers(0, 1 << 45, 5000)), rng.integers(-(2**62), 2**62, 999)):
        assert np.array_equal(collocations._widened(collocations._squeezed(numbers)), numbers)
    rising = np.sort(rng.integers(0, 20_000, 100_000))
    assert len(collocations._squeezed(rising)) < len(rising)


def test_intervals_of_both_transforms_are_the_places_of_the_phrase():
    rnd = random.Random(5)
    text = np.array([0] + [rnd.randrange(0, 6) for _ in range(500)] + [0], np.int32)
    index = collocations.FmIndex(np.bincount(text, minlength=6).astype("<i8").tobytes(), collocations.transform(text).tobytes(), collocations.transform(text[::-1]).tobytes())
    now, phrases = index.words(np.arange(1, 6)), [(w,) for w in range(1, 6)]
    for side in ("right", "left", "right"):
        more = index.extend(now, side)
        phrases = [phrases[o] + (w,) if side == "right" else (w,) + phrases[o] for o, w in zip(more["of"].tolist(), more["word"].tolist())]
        now = more
        size = len(phrases[0])
        counts = Counter(tuple(text[i : i + size].tolist()) for i in range(len(text) - size + 1))
        assert dict(zip(phrases, now["size"].tolist())) == {p: c for p, c in counts.items() if 0 not in p}
        before = np.roll(text, 1)
        for p, lo, n in list(zip(phrases, now["left"].tolist(), now["size"].tolist()))[:40]:
            if size < 4:
                at = [i for i in range(len(text) - size + 1) if tuple(text[i : i + size].tolist()) == p]
                assert sorted(index.side["left"][0][lo : lo + n].tolist()) == sorted(before[at].tolist())


def test_rare_pairs_stay_in_their_shards(spark, monkeypatch):
    """Most pairs of frequent words are rare: sums over buckets are sent and a few pairs, less than a byte for each; a place takes one number of an index."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, lang, " ".join(rnd.choices(words, k=400)) + ". w1 w2 w3 w4 w5") for i in range(60) for lang in ("en", "de")]
    sent, kept, size = [], [], lambda df: [sum(len(v) for r in df.collect() for v in r if isinstance(v, (bytes, bytearray))), df.count()]

    def spied(entries, *rest, real=collocations._frequent_phrases):
        sent.append(size(entries))
        return real(entries, *rest)

    def small(docs, *columns, real=collocations.indexes):
        index = real(docs, *columns, 2000)
        kept.append(size(index)[0])
        return index

    monkeypatch.setattr(collocations, "_frequent_phrases", spied)
    monkeypatch.setattr(collocations, "indexes", small)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(2)
    _, tables = collocations.frequent_phrases(docs, longest=2)
    want = Counter((lang, a, b) for _, lang, text in rows for piece in text.split(".") for a, b in zip(piece.split(), piece.split()[1:]))
    assert {(r.lang, *r.phrase.split(), r.f) for r in tables[1].collect()} == {(*p, n) for p, n in want.items() if n >= 30}
    assert sum(n for n, _ in sent) < sum(want.values())
    assert kept[0] < 9 * 405 * len(rows)
    sent.clear()
    assert got(collocations.mine(docs, longest=5)) == plain([r[1:] for r in rows], longest=5)
    assert len(sent) == 5


def test_pairs_are_numbers_that_cells_divide_evenly():
    rng = np.random.default_rng(2)
    for bits in (1, 9, 16, 31, 32):
        head, tail = rng.integers(0, 1 << bits, (2, 5000))
        x = collocations._mixed(head, tail, bits)
        back = collocations._unmixed(x, bits)
        assert np.array_equal(back[0], head) and np.array_equal(back[1], tail)
        x = np.unique(x)
        parts = collocations._sent(x, 2 * bits, 7)
        assert [i for _, a, e in parts for i in range(a, e)] == list(range(len(x))) and all(a < b for (a, *_), (b, *_) in zip(parts, parts[1:]))
        if bits > 8:
            assert min(e - a for _, a, e in parts) > 500 and len(parts) == 7
    for top in (1, 1 << 16, 1 << 40, 1 << 60):
        numbers = rng.integers(0, top, 3000)
        assert np.array_equal(collocations._order(numbers), np.argsort(numbers, kind="stable"))
    assert len(collocations._order(np.zeros(0, np.int64))) == 0
