import random

import numpy as np

from kinfold.llm import jaccard


def brute(rows, width=4, percent=85):
    """Components by comparing all pairs of sets of shingles, built apart from the operator."""
    sets = {}
    for i, text in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        n = min(width, len(words))
        sets[i] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "Éa b c d e"), (7, "éa b c d e")]
    for _ in range(14):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 8, 10, 14, 20, 30, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5, 9])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            if rng.random() < 0.4:
                copy += [rng.choice(vocab) for _ in range(rng.choice([1, 2, 5]))]
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(copy)))
    return rows


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {tuple(r) for r in got} == brute(rows)


def test_large_group_and_long_lists_take_the_rounds(spark):
    rng = random.Random(3)
    base = [f"v{i}" for i in range(80)]
    rows = []
    for i in range(70):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2])):
            copy[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()
    assert {tuple(r) for r in got} == brute(rows)


def test_shared_passage_posts_again(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([4, 6, 8, 30])))) for i in range(60)]
    rows += [(100 + i, t + rng.choice(["", " tail", " other tail"])) for i, t in rows[:20]]
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), short=2).collect()
    assert {tuple(r) for r in got} == brute(rows)


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(4)
    sign, rare = jaccard.Signatures(85), jaccard.Signatures(85, rng.integers(0, 9, jaccard.PLACES))
    for size in (7, 8, 12, 13, 18, 19, 25, 40, 97, 300, 900):
        for _ in range(30):
            one = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            most = 15 * 2 * size // 185
            gone = int(rng.integers(0, most + 1))
            added = int(rng.integers(0, most - gone + 1))
            other = np.unique(np.concatenate([rng.permutation(one)[gone:], rng.integers(0, 1 << 64, added, dtype=np.uint64)]))
            both = len(np.intersect1d(one, other))
            if 100 * both >= 85 * (len(one) + len(other) - both) and not np.array_equal(one, other):
                assert len(np.intersect1d(sign(one), sign(other)))
                assert len(np.intersect1d(rare(one), rare(other)))


def test_repeated_null_and_clashing(spark):
    text = "a b c d e f g h"
    rows = [(1, text, 9), (1, text, 9), (None, text, 9), (2, text, 8), (3, None, 1)]
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 5, 1), (1, 5, 1), (None, 5, None), (2, 5, 1), (3, 0, 3)]))
    assert jaccard.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_of_a_long_list(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        copy = list(base)
        for _ in range(i % 5):
            copy[rng.randrange(60)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(copy)))
    texts = spark.createDataFrame(rows, "id long, text string")
    lists = spark.createDataFrame([(1, i, i, 40) for i, _ in rows] + [(2, i, i, 9) for i, _ in rows[:9]], "name long, id long, comp long, size long")
    for block in (7, 64):
        links = jaccard.verify_blocks(lists, texts, 4, 85, block)
        linked = {n: c for n, c in jaccard.connected_components(links).collect()}
        assert {(i, linked.get(i, i)) for i, _ in rows} == {(r[0], r[2]) for r in brute(rows)}


def test_texts_of_one_id_are_one_document(spark):
    one, other = " ".join("abcdefgh"), " ".join("stuvwxyz")
    rows = [(3, one), (5, one), (5, other), (7, other), (5, other), (8, None), (5, None), (9, "p q r s t u v w")]
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r[0], r[2]) for r in got) == [(3, 3), (5, 3), (5, 3), (5, 3), (5, 5), (7, 3), (8, 8), (9, 9)]


def test_a_hot_row_and_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(1, "a b c d e f g h")] * 300 + [(i, "a b c d e f g h") for i in range(10, 200)] + [(900, long), (901, long + " end"), (902, "x" * 1_000_000)]
    got = {tuple(r) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 5, 1), *((i, 5, 1) for i in range(10, 200)), (900, 99_997, 900), (901, 99_998, 900), (902, 1, 902)}


def test_bitmaps_miss_no_link():
    rng = np.random.default_rng(8)
    for size in (3, 40, 700):
        base = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: size - int(rng.integers(0, size // 3 + 1))], rng.integers(0, 1 << 64, int(rng.integers(0, size // 3 + 1)), dtype=np.uint64)])) for _ in range(40)]
        n, rest = np.array([*map(len, sets)]), np.arange(40)
        may, do = np.stack([*jaccard.may_link(sets, n, rest, 80)]), jaccard.do_link(sets, n, rest, 80)
        want = [[100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)) for y in sets] for x in sets]
        np.fill_diagonal(do, True)
        assert do.tolist() == want and not (do & ~may).any() and may.sum() < 0.9 * may.size


def test_texts_go_only_where_sketches_let_them_link(spark, monkeypatch):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(30))) for i in range(24)]
    rows += [(100 + i, t + " tail") for i, t in rows[:6]]
    sent, verify = [], jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda pairs, *more: sent.append(pairs.count()) or verify(pairs, *more))
    for short in (2, 64):
        sent.clear()
        got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0, short=short).collect()
        assert {tuple(r) for r in got} == brute(rows)
        assert sum(sent) <= 12  # of 435 pairs


def test_sketches_miss_no_link():
    import pyarrow as pa

    rng = np.random.default_rng(10)
    for size in (1, 3, 70, 120, 700):
        base = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        most = size // 4 + 1
        sets = [np.unique(np.concatenate([rng.permutation(base)[int(rng.integers(0, most)) :], rng.integers(0, 1 << 64, int(rng.integers(0, most)), dtype=np.uint64)])) for _ in range(30)]
        link = [(i, j) for i in range(30) for j in range(i + 1, 30) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        n, maps = [*map(len, sets)], [*map(jaccard.sketch, sets)]
        a, b = zip(*[(i, j) for i in range(30) for j in range(i + 1, 30)], strict=True)
        rows = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.array([of[i] for i in x]) for x in (a, b) for of in (n, maps))], ["a", "b", "n", "sketch", "n2", "sketch2"])
        kept = {(r["a"], r["b"]) for out in jaccard.alike(80)([rows]) for r in out.to_pylist()}
        assert {*link} <= kept
        group = pa.table({"name": [1] * 30, "x": [0] * 30, "y": [0] * 30, "id": range(30), "comp": range(30), "n": n, "sketch": maps})
        assert {(r["a"], r["b"]) for r in jaccard.close(80)(group).to_pylist()} == kept
        assert jaccard.close(80, 0)(group).to_pylist() == [{"a": None, "b": None, "name": 1, "x": 0, "y": 0}]


def test_rows_of_a_dense_group_grow_with_its_documents(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        copy = list(base)
        for j in rng.sample(range(0, 60, 5), rng.choice([0, 1, 2, 3])):
            copy[j] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(copy)))
    sent, compared, verify, blocks = [], [], jaccard.verify, jaccard.verify_blocks
    monkeypatch.setattr(jaccard, "verify", lambda pairs, *more: sent.append(pairs.count()) or verify(pairs, *more))
    monkeypatch.setattr(jaccard, "verify_blocks", lambda lists, *more: compared.append(lists.count()) or blocks(lists, *more))
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0).collect()
    assert {tuple(r) for r in got} == brute(rows)
    assert sum(sent) <= 120 and 0 < sum(compared) <= 120  # of 7140 pairs, and of the many lists that share documents


def test_reach_is_a_forest_of_what_may_link():
    import pyarrow as pa

    rng = np.random.default_rng(13)
    sets = []
    for size in (30, 60, 110, 700):
        base = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        sets += [np.unique(np.concatenate([rng.permutation(base)[int(rng.integers(0, size // 4)) :], rng.integers(0, 1 << 64, int(rng.integers(0, size // 4)), dtype=np.uint64)])) for _ in range(25)]
    comp = rng.integers(0, 60, len(sets)).tolist()
    group = pa.table({"name": [1] * 100, "x": [0] * 100, "y": [0] * 100, "id": range(100), "comp": comp, "n": [*map(len, sets)], "sketch": [*map(jaccard.sketch, sets)]})

    def trees(pairs):
        top = list(range(100))

        def root(i):
            while top[i] != i:
                i = top[i]
            return i

        for a, b in pairs:
            top[root(a)] = root(b)
        return [{j for j in range(100) if root(j) == root(i)} for i in range(100)]

    may = [(r["a"], r["b"]) for r in jaccard.close(80)(group).to_pylist()]
    got = [(r["a"], r["b"]) for r in jaccard.reach(80)(group).to_pylist()]
    assert len(may) > 120 and len(got) < 100 and {tuple(sorted(p)) for p in got} <= {*may}
    assert trees(got) == trees(may)
