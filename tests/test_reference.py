"""Golden vectors and differential tests of the detection operators."""

import hashlib
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold import constants
from kinfold.functions import pixels
from kinfold.functions import scalar as S
from kinfold.operators import groups as G
from kinfold.operators import joins as J
from kinfold.operators import selection as K
from kinfold.operators import store as C
from kinfold.operators.components import connected_components
from kinfold.sources import media
from kinfold.sources.files import walk


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_walk(spark, tmp_path):
    for name, size in (("a.jpg", 2048), ("b.txt", 2048), ("small.jpg", 10), ("sub/c.jpg", 2048), ("sub/D.JPG", 2048), ("excluded/d.jpg", 2048), ("excluded2/e.jpg", 2048), (".hidden.jpg", 2048), ("_u.jpg", 2048)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    got = walk(spark, [str(tmp_path), str(tmp_path / "sub")], exts=[".jpg"], min_size_kb=1, exclude=[str(tmp_path / "excluded")]).collect()
    assert sorted(r.name for r in got) == ["D.JPG", "_u.jpg", "a.jpg", "c.jpg", "e.jpg"]


def test_content_hash_boundaries(spark):
    rng = random.Random(1)
    blobs = [rng.randbytes(n) for n in (0, 1, 4096, 4097, 5000, 9001)]

    def want(b):
        if len(b) <= 4096:
            return hashlib.md5(b).hexdigest()
        m = len(b) // 2 - 128
        return hashlib.md5(b[:256] + b[m : m + 256] + b[-256:] + len(b).to_bytes(8, "little")).hexdigest()

    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, c binary")
    got = rows.select("i", S.content_hash(F.col("c"), 4096, 256).alias("h")).collect()
    assert [r.h for r in sorted(got)] == [want(b) for b in blobs]


@pytest.mark.parametrize(("a", "b", "close"), [(100.0, 100.5, True), (100.0, 105.0, False), (1000.0, 1005.0, True)])
def test_durations_close(spark, a, b, close):
    assert one(spark, S.duration_close(F.col("a"), F.col("b")), a=a, b=b) is close


def test_duration_candidates_equal_brute_force(spark):
    rng = random.Random(42)
    for _ in range(3):
        d = [rng.choice([rng.uniform(0, 300), rng.gauss(100, 2), rng.uniform(0, 5000)]) for _ in range(60)] + [100.0, 100.4]
        close = lambda a, b: abs(a - b) <= max(1, (a + b) / 2 * 0.01)
        want = {(i, any(close(x, y) for j, y in enumerate(d) if j != i)) for i, x in enumerate(d)}
        rows = spark.createDataFrame(list(enumerate(d)), "id long, duration double")
        assert {(r.id, r.candidate) for r in J.duration_candidates(rows).collect()} == want
        pairs = {(r.id, r.id2) for r in J.duration_pairs(rows).collect()}
        assert pairs == {(i, j) for i in range(len(d)) for j in range(i + 1, len(d)) if close(d[i], d[j])}


def test_distances(spark):
    df = spark.createDataFrame([([0b0000, 0b1111], [0b0001, 0b1110]), ([0, 0, 0], [0, 0]), ([], [1])], "a array<long>, b array<long>")
    assert [r.x for r in df.select(S.frame_distance(F.col("a"), F.col("b")).alias("x")).collect()] == [1, 0, 1 << 30]
    full = 0xFFFFFFFF
    df = spark.createDataFrame([([5, 6], [5, 6]), ([0, full], [full, 0]), ([], [1]), ([1, 2, 3], [1, 2])], "a array<long>, b array<long>")
    assert [r.x for r in df.select(S.audio_similarity(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.0, 0.0, 1.0]


@pytest.mark.parametrize("most", [0, 3, 5, 10, 20])
def test_hamming_pairs_equal_brute_force(spark, most):
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = base + [b ^ sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 3, 6, 12, 20]))) & ((1 << 64) - 1) for b in base for _ in range(3)]
    signed = list(dict.fromkeys(v - (1 << 64) if v >> 63 else v for v in values))
    got = {(r.a, r.b) for r in J.hamming_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, fp long"), most).collect()}
    want = {(i, j) for i in range(len(signed)) for j in range(i + 1, len(signed)) if bin((signed[i] ^ signed[j]) & ((1 << 64) - 1)).count("1") <= most}
    assert got == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (None, 1), (7, 6)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hashes():
    y, x = np.mgrid[0:64, 0:64]
    rgb = np.stack([4 * x, 4 * y, 2 * (x + y)], -1) % 256
    plane = pixels.luma(rgb)
    assert pixels.luma(np.array([[[200, 150, 90]]]))[0, 0] == (299 * 200 + 587 * 150 + 114 * 90) // 1000
    assert pixels.phash(plane) == pixels.phash(np.asfortranarray(plane)) and not pixels.phash(plane) & 1
    assert pixels.dhash(np.zeros((0, 0))) == 0 and pixels.ahash(np.full((8, 8), 3)) == 0


def members(spark, rows):
    return spark.createDataFrame(rows, "gid string, pos long, path string, dir string, size long, mod_unix long, width int, height int")


def test_selection(spark):
    m = members(spark, [("g", 0, "/tmp/keepsafe/a", "/tmp/keepsafe", 1 << 20, 1, 640, 480), ("g", 1, "/tmp/keep/sub/b", "/tmp/keep/sub", 1 << 20, 2, 1920, 1080)])
    kept = lambda *a, **b: [r.path for r in K.keep(m, *a, **b).filter("keep").collect()]
    assert kept("highest_res") == ["/tmp/keep/sub/b"] and kept("oldest") == ["/tmp/keepsafe/a"] == kept("unknown")
    assert kept("prefer_dir", prefer_dir="/tmp/keep") == ["/tmp/keep/sub/b"] and kept("prefer_dir", prefer_dir="/x") == ["/tmp/keepsafe/a"]
    assert kept("oldest", min_wasted_mb=5) == [] and len(kept("oldest", min_wasted_mb=0.5)) == 1
    plan = K.delete_plan(m, m)
    assert [r.path for r in plan.collect()] == ["/tmp/keep/sub/b"]
    left, groups = K.prune(m, plan)
    assert left.count() == 0 and groups.count() == 0


def test_rules(tmp_path):
    rules = K.Rules(str(tmp_path / "rules.json"))
    rules.save("r", "oldest")
    rules.save("r", "newest")
    assert K.Rules(str(tmp_path / "rules.json")).rules["r"]["strategy"] == "newest"
    for bad in (("", "oldest"), ("x", "bogus"), ("x", "prefer_dir")):
        with pytest.raises(ValueError):
            rules.save(*bad)


def test_store(spark):
    e = spark.createDataFrame([("/a", 100, 5, "m1", "q1", 1), ("/b", 100, 6, "m2", None, 2)], "path string, size long, mod_unix long, md5 string, quick string, seq long")
    f = spark.createDataFrame([("/a", 100, 5, "q1"), ("/new", 100, 5, "q1"), ("/other", 100, 5, "zz"), ("/c", 100, 6, "q2"), ("/a", 999, 5, "q1")], "path string, size long, mod_unix long, quick string")
    assert {(r.path, r["size"]): r.cached for r in C.lookup(f, e).collect()}[("/a", 100)] == "m1"
    assert {(r.path, r["size"]): r.cached for r in C.rename_lookup(f, e).collect()} == {("/new", 100): "m1", ("/other", 100): None, ("/c", 100): None, ("/a", 999): None}
    new = spark.createDataFrame([("/a", None, 9)], "path string, md5 string, duration int")
    assert {r.path: (r.md5, r.duration) for r in C.merged(e, new).collect()} == {"/a": ("m1", 9), "/b": ("m2", None)}


def test_journal_skips_torn_lines(spark, tmp_path):
    (tmp_path / "j.json").write_text('{"path":"/a","md5":"1","seq":1}\n{"path":"/a","md5":"2","seq":2}\n{"path":"/b","md')
    got = C.replay(C.load_journal(spark, str(tmp_path), "path string, md5 string, seq long")).collect()
    assert [(r.path, r.md5) for r in got] == [("/a", "2")]


def test_media_parsing(spark):
    probe = '{"streams":[{"width":1920,"height":1080}],"format":{"duration":"123.456"}}'
    got = one(spark, media.parse_probe(F.col("a")), a=probe)
    assert (got.duration, got.width, got.height) == (123.456, 1920, 1080)
    assert one(spark, media.parse_probe(F.col("a")), a='{"streams":[],"format":{}}') is None
    assert one(spark, media.parse_acoustic(F.col("a")), a='{"duration":123.45,"fingerprint":[1,2,3,4]}').fingerprint == [1, 2, 3, 4]
    assert one(spark, media.parse_acoustic(F.col("a")), a='{"duration":1,"fingerprint":[]}') is None
    assert one(spark, S.video_timestamps(F.col("d")), d=0.0) == [] and len(one(spark, S.video_timestamps(F.col("d")), d=6.0)) == 3
    assert [one(spark, S.poster_time(F.col("d")), d=d) for d in (0.0, 100.0, 1000.0)] == [1.0, 20.0, 60.0]
    assert media.effective_mode("visual", {}) == "exact"
    absent = spark.createDataFrame([("/x",)], "path string")
    assert media.run_tool(absent, ["no-such-tool", "{}"]).first().out is None


def test_bit_similarity_is_the_pair_mean(spark):
    rng = random.Random(3)
    rows = [("g", rng.getrandbits(62)) for _ in range(7)]
    got = G.bit_similarity(spark.createDataFrame(rows, "gid string, fp long"), ["fp"]).first().similarity
    pairs = [bin(a ^ b).count("1") for i, (_, a) in enumerate(rows) for _, b in rows[i + 1 :]]
    assert abs(got - (1 - sum(pairs) / len(pairs) / 64)) < 1e-12


def test_domains():
    assert len(constants.extensions("images")) == 26 and "pdf" in constants.extensions("all") and constants.extensions("?") == constants.IMAGES
    assert constants.mode_hashes("smart") == ("md5", "dhash", "ahash", "phash") and constants.mode_hashes("robust", "audio") == ("md5",)


def test_entry_module_without_llm(spark, monkeypatch):
    for name in [n for n in sys.modules if n.startswith(("kinfold.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as e

    assert "exact_groups" in e.queries() and "pipeline" not in e.queries() and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["gid", "members", "total_size", "wasted_size"]
