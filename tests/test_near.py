"""Block kernels of the Hamming joins and whole-text SimHashes, against plain Python and the DataFrame functions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold import queries as Q
from kinfold.functions.near import near
from kinfold.operators import joins as J
from kinfold.operators.components import connected_components


def hashes(seed, n=60):
    rng = random.Random(seed)
    base = [rng.getrandbits(60) for _ in range(n)]
    return list(dict.fromkeys(base + [b ^ sum(1 << x for x in rng.sample(range(60), rng.choice([1, 3, 6, 12, 14]))) for b in base for _ in range(4)]))


@pytest.mark.parametrize("most", [0, 3, 8, 12, 20])
def test_near_equals_brute_force(most):
    one, other = np.array(hashes(1), np.uint64), np.array(hashes(1, 90), np.uint64)
    got = {(int(i), int(j)) for x, y in near(one, other, most) for i, j in zip(x, y, strict=True)}
    assert got == {(i, j) for i, a in enumerate(one.tolist()) for j, b in enumerate(other.tolist()) if (a ^ b).bit_count() <= most}


def test_pairs_and_forest_over_blocks(spark):
    values = hashes(2)
    rows = spark.createDataFrame([*enumerate(values), (7000, values[0]), (7001, None), (None, 5)], "id long, fp long")
    want = {(i, j, (values[i] ^ values[j]).bit_count()) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 12}
    for block in (50, 1 << 15):
        assert sorted(map(tuple, J.hamming_pairs(rows, 12, block=block).collect())) == sorted(want)
        few = J.hamming_pairs(rows, 12, forest=True, block=block)
        assert {*map(tuple, few.collect())} <= want
        assert {*map(tuple, connected_components(few).collect())} == {*map(tuple, connected_components(J.hamming_pairs(rows, 12)).collect())}


def test_plan_holds_no_masks(spark):
    rows = spark.createDataFrame([*enumerate(hashes(3))], "id long, fp long")
    assert all(len(J.hamming_pairs(rows, most)._jdf.queryExecution().toString()) < 20_000 for most in (8, 12, 20))


@pytest.mark.parametrize("kind", ["words", "pairs", "chars"])
def test_text_simhash_equals_units(spark, kind):
    texts = [None, "", "a", "ab c", "Ünï Cødé K İxK", "a b c d e", "the the the", "tail \U0001f600 of a_1 23", "x" * 500, "lorem ipsum " * 50]
    t = spark.createDataFrame([*enumerate(texts), (4, "another text of an id"), (5, "a b c d e f")], "id long, text string")
    got = {r.id: r.fp for r in Q._simhashes(t, kind).collect()}
    assert got == {r.id: r.fp for r in Q._simhashes_of_units(t, kind).collect()} and len(got) >= 6
    assert Q._simhashes(t.filter(F.col("id") < 4), kind).count() == Q._simhashes_of_units(t.filter(F.col("id") < 4), kind).count()
