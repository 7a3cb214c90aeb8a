"""Parts of the operators that the queries alone do not show."""

import random
import time

import brute
import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewarden.llm import bpe, decontaminate, licenses, maxscore, pii, quality, simhash, token_counts, token_files, toxicity
from tidewarden.llm.components import components
from tidewarden.llm.labelled import fold
from tidewarden.llm.pieces import token_chunks


def test_components_of_a_chain_a_star_and_odd_rows(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (3, 2), (3, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(50)}


@pytest.mark.parametrize("most", [None, 0.0])
def test_links_connect_all_close_fingerprints(spark, most):
    """Also where every fingerprint goes through halfway values (most=0)."""
    draw = random.Random(3)
    near = lambda x, k: x ^ sum(1 << b for b in draw.sample(range(64), k))
    centres = [draw.getrandbits(64) for _ in range(12)]
    prints = list({near(c, draw.randint(0, 5)) for c in centres for _ in range(12)} | {0, 1, 2**64 - 1, near(0, 4)})
    signed = [(x - (x >> 63 << 64),) for x in prints]
    pairs = simhash.links(spark.createDataFrame(signed, "print long"), 4, most)
    roots = {r["node"]: r["root"] for r in components(pairs).collect()}
    close = {(a, b) for a, in signed for b, in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert close and all(roots[a] == roots[b] for a, b in close)
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 4 for r in pairs.collect())
    if most is None:
        assert {(r["a"], r["b"]) for r in pairs.collect()} == close


def test_thresholds_keep_the_pigeonhole_sum():
    counts = np.random.default_rng(1).integers(1, 500, (200, 3)).astype(float)
    given_, cost = simhash.thresholds(counts, 10_000, [22, 21, 21], 4)
    assert (given_.sum(1) == 2).all() and (given_ >= -1).all() and (cost > 0).all()
    assert given_[np.argmax(counts[:, 0] - counts[:, 1] - counts[:, 2])][0] == -1


def test_one_of_each_with_repeated_ids_and_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, "quite another text of some words"), (3, "quite another text of some words"), (None, "a b c d e"), (None, "nowhere else at all"), (None, "nowhere else at all"), (5, None), (6, "")]
    out = sorted((r["doc_id"] or -1, r["text"]) for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(-1, "nowhere else at all"), (1, "a b c d e"), (3, "quite another text of some words"), (5, None)]


def test_license_suppression_and_rules(spark):
    assert len(licenses.rules()) > 300 and [r.priority for r in licenses.rules()] == sorted((r.priority for r in licenses.rules()), reverse=True)
    texts = ["Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: Apache-2.0", "the BSD licence", "under CC BY-NC-SA 4.0", "Mozilla Public License 2.0 license", "no licence here"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in rows] == ["gpl-3", "apache-2", "", "cc-by-nc", "mpl-2", ""]
    assert [d["label"] for d in rows[0]["detections"]] == ["gpl-3"]  # the shorter gpl lies inside


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=60))
@settings(max_examples=200, deadline=None)
def test_packing_round_trip(values):
    x = np.array(values, np.uint32)
    assert token_files.unpack(*token_files.pack(x), len(x)).tolist() == values


def test_token_blocks_hold_the_ids(spark, odd, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(odd, path, P.path("byte_bpe_50k.json"), block_tokens=500)
    assert spark.read.parquet(path).count() > 5
    got = {r["doc_id"]: r for r in token_files.read_tokens(spark, path).collect()}
    want = brute.token_files([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert {i: (r["start"], r["n_tokens"], r["ids_crc32"]) for i, r in got.items()} == want
    assert all(len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 0 for r in got.values())


LIBRARY = brute.ranks("byte_bpe_multi_50k.tiktoken")
MERGES = bpe.merges(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@given(st.one_of(st.text(max_size=200), st.text("abeinrst", min_size=40, max_size=400), st.text("a \n\t.'s1é", max_size=200)))
@settings(max_examples=300, deadline=None)
def test_bpe_as_the_library(text):
    ids, n = MERGES.chunks.items([text])
    assert ids.tolist() == LIBRARY.encode_ordinary(text) and n.tolist() == [len(ids)]
    assert MERGES.decode(ids.tolist()) == text.encode()


@given(st.binary(min_size=1, max_size=300), st.integers(1, 299))
@settings(max_examples=200, deadline=None)
def test_bpe_join_is_the_encoding_of_both(data, cut):
    whole = LIBRARY._core_bpe.encode_single_piece(data)
    left, right = data[:cut], data[cut:]
    assert MERGES.join(MERGES.piece(left) if left else [], MERGES.piece(right) if right else []) == whole


@pytest.mark.parametrize("data", [b"a" * 1_000_000, b"-" * 80_001, b"abc" * 50_001, "\u65e5\u672c\u8a9e".encode() * 9_001, bytes(random.Random(4).choices(b"abcde ", k=60_000))])
def test_long_pieces_take_no_quadratic_time(data):
    """A megabyte of one letter took minutes when a leaf was searched as a whole for each merge."""
    start = time.monotonic()
    got = MERGES.piece(data)
    assert time.monotonic() - start < 10
    assert got == LIBRARY._core_bpe.encode_single_piece(data)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([b"a", b"b", b"the", b" ", b"-", "\u00e9".encode(), b"0"]), st.sampled_from([1, 2, 9, 70])), min_size=1, max_size=30))
def test_leaf_by_heap_is_the_plain_leaf(runs):
    data = b"".join(part * n for part, n in runs)
    want = LIBRARY._core_bpe.encode_single_piece(data)
    assert MERGES.piece(data) == want
    assert len(want) == 1 or MERGES.wide_leaf(data) == want


def test_answers_for_any_limit(spark):
    n = [0, 3, 3, 10, 2000, 5000]
    table = token_counts.limits(token_counts.histogram(spark.createDataFrame([(x,) for x in n] + [(None,)], "n_tokens long")))
    rows = token_counts.at_limits(table, [0, 1, 3, 7, 4000, 9000]).collect()
    assert {r["asked"]: (r["docs_over"], r["truncated_total"], r["lost_tokens"]) for r in rows} == {
        a: (sum(x > a for x in n), sum(min(x, a) for x in n), sum(max(0, x - a) for x in n)) for a in (0, 1, 3, 7, 4000, 9000)
    }
    assert [r["n_tokens"] for r in token_counts.quantile(table, [0.5, 0.66, 1.0]).orderBy("share").collect()] == [3, 10, 5000]


def _labelled(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_quality_on_held_out_rows(spark):
    docs, labels = _labelled(spark, "/root/testdata/sf0.1")
    held = fold("doc_id", 4) == 2
    model = quality.fit(docs, labels, ~held)
    rows = docs.join(labels.where(held), "doc_id").select("quality", quality.score(spark, model, F.col("text")).alias("s")).collect()
    assert len(rows) > 100 and np.mean([(r["s"] >= 0.5) == (r["quality"] == 1) for r in rows]) > 0.93


def test_toxicity_on_held_out_rows(spark):
    docs, labels = _labelled(spark, "/root/testdata/sf0.1")
    held = fold("doc_id", 5) == 0
    model = toxicity.fit(docs, labels, ~held)
    rows = docs.join(labels.where(held), "doc_id").select("toxic", toxicity.score(spark, model, F.col("text")).alias("s")).collect()
    hit = [r["s"] >= 0.5 for r in rows if r["toxic"] == 1]
    wrong = [r["s"] >= 0.5 for r in rows if r["toxic"] == 0]
    assert len(hit) > 20 and np.mean(hit) > 0.85 and np.mean(wrong) < 0.01


def test_nnpu_never_learns_from_clean_labels():
    """With toxic rows and a mixture only, the toxic feature is found and the neutral one stays low."""
    toxic = [np.array([0, 2])] * 50 + [np.array([0])] * 50
    mixed = [np.array([0])] * 20 + [np.array([2])] * 90 + [np.array([], int)] * 90
    weights, bias = toxicity.fit_nnpu(toxic, mixed, 3, 0.1)
    assert weights[0] + bias > 0 > weights[2] + bias and bias < 0


def test_revealing_terms_and_sanitised_text(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    filler = lambda k: " ".join(word() for _ in range(k))
    rows = [(i, f"{filler(9)} Harbourmaster {filler(2)} ann@example.org {filler(9)}") for i in range(6)]
    rows += [(10 + i, f"{filler(5)} one copied text bob@example.org with rareword near it {filler(3)}") for i in range(1)] * 5
    rows += [(20 + i, filler(40)) for i in range(20)] + [(50, f"the harbourmaster {filler(3)}"), (51, None), (52, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert [s["found"] for s in found[50]["spans"]] == ["harbourmaster"]
    assert {s["found"].lower() for r in found.values() for s in r["spans"] if s["kind"] in ("name", "term")} == {"harbourmaster"}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[50].startswith("the [") and "ann@" not in clean[0] and "[email]" in clean[0] and clean[51] is None and clean[52] == ""
    assert all(clean[20 + i] == rows[i + 11][1] for i in range(20))


def test_surroundings_are_whole_words_however_long(spark):
    """Between the name and the address stands a word longer than the stretch that is looked at first, or many empty characters."""
    draw = random.Random(6)
    word = lambda k: "".join(draw.choice("abcdefgh") for _ in range(k))
    filler = lambda k: " ".join(word(4) for _ in range(k))
    rows = [(i, f"{filler(9)} Harbourmaster {word(191 + 40 * i)} ann@example.org {filler(9)}") for i in range(6)]
    rows += [(10 + i, f"{filler(9)} bob@example.org{' ' * 400}{word(5)} {word(300)} Lighthouse {filler(9)}") for i in range(6)]
    rows += [(20 + i, filler(60)) for i in range(20)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    terms = {r["doc_id"]: [s["found"] for s in r["spans"] if s["kind"] in ("name", "term")] for r in found}
    assert terms == {i: ["Harbourmaster"] if i < 6 else ["Lighthouse"] if 10 <= i < 16 else [] for i, _ in rows}


def _disclosures(texts, mentions, support, surround=6):
    """term: disclosure by the definition, from lists of words and (text, entity, start, stop) in words."""
    near = [(e, tuple(texts[t][max(0, a - surround) : a]), tuple(texts[t][b : b + surround])) for t, e, a, b in mentions]
    total, out = sum(map(len, texts)), {}
    for entity in {e for e, _, _ in near}:
        own = [set(x) | set(y) for e, x, y in near if e == entity]
        places = {(x, y): set(x) | set(y) for e, x, y in near if e == entity}
        if len(places) < support or len(set().union(*own)) < 2 * sum(map(len, places.values())) / len(places):
            continue
        for term in {t for t in set().union(*own) if len(t) > 1 and sum(t in p for p in places.values()) >= support}:
            both, alone = sum(term in s for s in own), sum(words.count(term) for words in texts)
            told = np.log2(min(1, both / alone) * total / len(own)) / np.log2(total / len(own))
            if told >= pii.GENERALISE:
                out[term] = max(out.get(term, 0), told)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_disclosure_by_its_definition(spark, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    tied = {"ann@example.org": "harbour", "bob@example.org": "anchor", "10.0.0.1": "router"}
    texts, mentions = [], []
    for t in range(60):
        line = draw.choices(words, k=draw.randrange(3, 25))
        entity = draw.choice([None, *tied])
        if entity:
            at = draw.randrange(len(line))
            line[at:at] = [tied[entity]] * (draw.random() < 0.8) + [entity]
        if draw.random() < 0.1:
            line.append(draw.choice(list(tied.values())))
        texts.append(line)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    split = [[v for w in x for v in w.replace("@", " ").replace(".", " ").split()] for x in texts]
    for t, line in enumerate(texts):
        at = 0
        for w in line:
            size = len(w.replace("@", " ").replace(".", " ").split())
            if w in tied:
                mentions.append((t, w, at, at + size))
            at += size
    found = pii.with_base(docs, "text").select("text", "base")
    got = {r["term"]: r["disclosure"] for r in pii.revealing_terms(found).collect()}
    want = _disclosures(split, mentions, pii.SUPPORT)
    assert got.keys() == want.keys() and want.keys() & set(tied.values())
    assert all(abs(got[t] - want[t]) < 1e-9 for t in want)


def test_benchmark_in_several_sets(spark):
    docs = [(i, f"{'pad ' * i}" + " ".join(f"w{(i + j) % 40}" for j in range(30))) for i in range(30)] + [(90, None), (91, "w1 w2")]
    items = [(k, " ".join(f"w{(3 * k + j) % 40}" for j in range(14 + k % 3))) for k in range(12)] + [(50, "w1 w2"), (51, "pad")]
    marked = decontaminate.mark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), set_words=40)
    rows = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), brute.sha(",".join(r["items"])), r["contaminated"]) for r in decontaminate.report(marked).collect()}
    assert rows == brute.contamination(docs, items)


def test_top_k_in_small_blocks_and_sets(spark, monkeypatch):
    draw = np.random.default_rng(2)
    x = draw.integers(-40, 40, (300, 6))
    x[100:200] = x[100]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<long>").repartition(3)
    got = maxscore.top_k(rows.where("id % 10 = 0"), rows, 5, query_rows=7).collect()
    want = []
    for q in range(0, 300, 10):
        order = sorted((-int(x[q] @ x[i]), i) for i in range(300) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert sorted((r["query_id"], r["rank"], r["row_id"], r["score"]) for r in got) == sorted(want)
    ids, columns, best = np.arange(300), np.ascontiguousarray(x.T), []
    for at in range(0, 300, 32):
        best = maxscore.search_block(ids[at : at + 32], columns[:, at : at + 32], x[0], 0, 5, best)
    assert best == [(s, i) for q, _, i, s in want if q == 0]


def _examples(pattern):
    """Texts that a rule's pattern matches: every branch and option by itself."""
    from re import _parser

    def of(items):
        out = [""]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                more = [chr(arg)]
            elif name == "IN":
                more = [chr(v) for _, v in arg]
            elif name == "BRANCH":
                more = [x for branch in arg[1] for x in of(branch)]
            elif name == "SUBPATTERN":
                more = of(arg[-1])
            else:
                assert name == "MAX_REPEAT" and arg[:2] == (0, 1)
                more = ["", *of(arg[2])]
            plain = out[0]
            out = [x + more[0] for x in out] + [plain + y for y in more[1:]]
        return out

    return of(_parser.parse(pattern))


def _missing(spark, rules, texts):
    """Rules of which a text gives no detection of their priority or a higher one over the whole match."""
    docs = spark.createDataFrame([(i, f"See. {t.upper()}, so") for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    found = lambda r, t, rule: any(d["start"] <= 4 and d["stop"] >= 4 + len(t) and d["priority"] >= rule.priority for d in r["detections"]) and r["score"] >= rule.weight
    return [(rule.pattern, t) for i, (rule, t) in enumerate(zip(rules, texts)) if not found(rows[i], t, rule)]


def test_license_gate_passes_every_grant(spark):
    """Grants of every license without the word license, in texts without any other hint."""
    first = {r: _examples(r.pattern)[0].replace("licensed under", "released under") for r in licenses.rules() if r.priority == 3}
    some = [r for r, t in first.items() if r.keyword in t]
    texts = [first[r] for r in some]
    assert len(some) > 60 and _missing(spark, some, texts) == []
    rows = licenses.scan(spark.createDataFrame([(1, "Released under GPL v3. Published\nunder  CC BY 4.0.")], "doc_id long, text string")).collect()
    assert {"gpl-3", "cc-by-4"} <= set(rows[0]["labels"].split(","))


def test_every_license_rule_by_itself(spark):
    """Each branch and option of every rule, alone in a text, passes the hint and the rule's keyword."""
    pairs = [(r, t) for r in licenses.rules() for t in _examples(r.pattern)]
    assert [(r.pattern, t) for r, t in pairs if r.keyword not in t] == []
    assert _missing(spark, [r for r, _ in pairs], [t for _, t in pairs]) == []
    tags = {"EPL-2.0": "epl-2", "MPL-1.1": "mpl-1.1", "BSL-1.0": "boost-1", "OFL-1.1": "ofl-1.1", "MS-PL": "ms-pl", "PSF-2.0": "psf-2", "ODC-By-1.0": "odc-by-1"}
    rows = licenses.scan(spark.createDataFrame([(i, f"// SPDX-License-Identifier: {t}") for i, t in enumerate(tags)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["labels"], r["score"]) for r in rows] == [(x, 1.0) for x in tags.values()]


def test_token_counts_remember_numbers_and_are_bounded(spark):
    """A chunk is remembered by its count, and a small bound changes no count."""
    draw = random.Random(8)
    texts = [" ".join("".join(draw.choices("abcd,.\n", k=draw.randrange(1, 9))) for _ in range(draw.randrange(0, 30))) for _ in range(300)]
    few = token_chunks(lambda strings: [np.array([len(s)], "<u4").tobytes() for s in strings], bound=10)
    for at in range(0, 300, 20):
        counts, lengths = few.items(texts[at : at + 20])
        assert token_counts._summed(counts, lengths).tolist() == [len(t) for t in texts[at : at + 20]]
    few.items([""])
    assert len(few) == 1


def test_token_counts_ask_the_library_once_a_block(spark, monkeypatch):
    """Not once per distinct word; a text longer than a block is cut where the pre-tokenizer cuts."""
    import pyarrow as pa
    import tiktoken

    path, asked, whole = P.path("byte_bpe_50k.tiktoken"), [], tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: asked.append(text) or whole(self, text))
    monkeypatch.setattr(token_counts, "_LOADED", {})
    draw = random.Random(9)
    texts = ["".join(draw.choices("abcdé \n\t\u3000\x1c\0.,'s1", k=2000)) for _ in range(40)] + [None, "", "  "]
    want = [len(whole(token_counts._library(path, P.PATTERN), t or "")) for t in texts]
    assert token_counts.counts(pa.array(texts, pa.string()), path, P.PATTERN).tolist() == want
    assert len(asked) == len(texts)
    monkeypatch.setattr(token_counts, "BLOCK", 50)
    asked.clear()
    assert token_counts.counts(pa.array(texts, pa.string()), path, P.PATTERN).tolist() == want
    assert "".join(asked) == "".join(t or "" for t in texts) and max(map(len, asked)) < 500
