import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
ODD = [
    (1, None), (2, ""), (3, "  \t\n "), (4, "word"), (5, "A b c   d\x1c e\x85f  g\n\n h　i \0 j"), (6, LONG * 400), (7, LONG * 400 + "end"),
    (8, "x" * 30_000), (9, "a1" * 6_000 + " " + "!" * 4_000), (10, "Released under the MIT License. under the  mit-license; UNDER THE MIT LICENSE"),
    (11, "Apache License, Version 2.0 and cc-by-nc 4.0 Lizenz für under the mit licenses"), (12, "SPDX-License-Identifier: GPL-3.0-only. GNU General Public License version 3"),
    (13, "mail a.b@c.d_e@f.gh, x@y@z.com, 1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.255 and +1 (555) 123-4567. +12 34"), (14, "card 4111 1111 1111 1111, 4111-1111-1111-1112; 5500005555555559 0 1 2"),
    (15, "\U0001f600 你好世界 café l'été don't WE'LL  'tis 12345 67.89 <|endoftext|>"), (16, "9" * 5_000 + " " + "1." * 3_000), (17, "@" * 500 + "a@b." * 300), (18, LONG), (19, LONG.upper()),
    (20, "idiot moron scum " * 3), (21, "The same text."), (22, "The same text."), (23, "퟿ ́́ ‍"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward texts, with columns whose names the operators use themselves."""
    rows = [(i, t, "x", None, 0.5, 7, "p", 1, [1]) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, print long, id string, n_tokens long, base array<int>").repartition(3)


@pytest.fixture(scope="session")
def sf_dir(spark, odd, tmp_path_factory):
    """A data folder with the awkward texts, labels that contradict and repeat, and benchmark items with nulls."""
    at = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(20, 0, 1), (20, 1, None), (None, 1, 1), (4, None, None), (21, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, LONG), (10, LONG + "Fifteen."), (1, LONG), (2, None), (3, ""), (None, "same text"), (4, "mit License")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    vectors = [(0, [1.0, -0.5, 0.25]), (50, [0.1, 0.2, 0.3]), (7, None), (8, [1.0, None, 2.0]), (9, [float("nan"), 1.0, 1.0]), (10, [float("inf"), 0.0, 0.0]), (100, [0.0, 0.0, 0.0])]
    vectors += [(200 + i, [1.0, -0.5, 0.25]) for i in range(9)] + [(None, [1.0, 1.0, 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture(scope="session")
def empty_dir(spark, sf_dir, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return at
