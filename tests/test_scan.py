"""Whole scans, images, media tools (as scripts), thumbnails, sessions, deletion and the store, on real files."""

import logging
import os
import stat
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold import constants
from kinfold.functions import pixels as P
from kinfold.operators import groups as G
from kinfold.operators import joins as J
from kinfold.operators import removal, session, store
from kinfold.operators.selection import delete_plan
from kinfold.plans.log import Tail
from kinfold.scan import ScanSpec, scan
from kinfold.sources import media, sinks, thumbs
from kinfold.streaming import incremental


def gradient(w=64, h=64):
    y, x = np.mgrid[:h, :w]
    return np.stack([4 * x % 256, 4 * y % 256, 2 * (x + y) % 256], -1).astype(np.uint8)


@pytest.fixture
def pictures(tmp_path):
    rng = np.random.default_rng(1)
    one, other = gradient(), rng.integers(0, 256, (50, 80, 3)).astype(np.uint8)
    files = {"a.png": P.png(one), "copy.png": P.png(one), "large.png": P.png(one.repeat(2, 0).repeat(2, 1)), "noise.png": P.png(other), "noise.ppm": b"P6 80 50 255\n" + other.tobytes(), "broken.png": b"\x89PNG\r\n\x1a\nxx"}
    for i, (name, raw) in enumerate(files.items()):
        (tmp_path / name).write_bytes(raw)
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    return tmp_path


def test_scan_puts_exact_and_perceptual_groups_together(spark, pictures):
    found = scan(spark, ScanSpec(roots=(str(pictures),), mode="robust", threshold=3, extensions=("png", "ppm")))
    got = {}
    for r in found.members.collect():
        got.setdefault(os.path.basename(r.gid), []).append((r.pos, r["name"], r.exact, r.algorithm))
    # large.png looks like a.png, but members of exact groups aren't compared again
    assert {k: sorted(v) for k, v in got.items()} == {"a.png": [(0, "a.png", True, "md5"), (1, "copy.png", True, "md5")], "noise.png": [(0, "noise.png", False, "ahash+dhash"), (1, "noise.ppm", False, "ahash+dhash")]}
    assert {r.algorithm: r.similarity for r in found.groups.collect()} == {"md5": 1.0, "ahash+dhash": 1.0}
    assert found.totals.first().groups == 2
    assert [g.gid for g in G.page(found.groups, 2, 1).collect()] == [found.groups.collect()[1].gid]
    none = scan(spark, ScanSpec(roots=(str(pictures),), mode="robust", threshold=0, extensions=("png", "ppm")))
    assert {r.algorithm for r in none.members.collect()} == {"md5"}


def test_smart_scan_votes(spark):
    rows = [(i, f"/d/f{i}.jpg", f"f{i}.jpg", "/d", 100 + i, i, h, a, p, True) for i, (h, a, p) in enumerate([(0, 0, 0), (1, 1, 0x0F0F0F0F), (0, -1, -1), (-1, -1, -1), (0, 0, 0)])]
    files = spark.createDataFrame(rows, "id long, path string, name string, dir string, size long, mod_unix long, dhash long, ahash long, phash long, decoded boolean")
    of = lambda votes: sorted((r.gid, r.id) for r in scan(spark, ScanSpec(mode="smart", threshold=2, min_votes=votes), files, F.lit(None).cast("binary")).members.collect())
    assert of(2) == [("/d/f0.jpg", i) for i in (0, 1, 4)] + [("/d/f2.jpg", i) for i in (2, 3)]
    assert of(1) == [("/d/f0.jpg", i) for i in range(5)]


def parts(links) -> dict:
    top = {}
    for a, b in links:
        a, b = top.get(a, {a}), top.get(b, {b})
        for x in (joined := a | b):
            top[x] = joined
    return {x: min(of) for x, of in top.items()}


@pytest.mark.parametrize("least,block", [(1, 1 << 15), (2, 1 << 15), (2, 40), (3, 40), (4, 40)])
def test_links_by_votes_equal_brute_force(spark, least, block):
    rng = np.random.default_rng(least)
    base = rng.integers(-(2**63), 2**63 - 1, (12, 3))
    rows = [[None if rng.random() < 0.1 else int(h ^ np.int64(sum(1 << int(i) for i in rng.choice(62, rng.integers(0, 9), replace=False)))) for h in b] for b in base for _ in range(8)]
    rows += rows[:20] + [[7, 7, int(h)] for h in rng.integers(0, 2**62, 30)] + [[None, None, 5], [None, None, 5], [None] * 3, [None] * 3]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, p long, q long, r long")
    got = J.agreeing_links(table, ["p", "q", "r"], 4, least, block=block).collect()
    votes = lambda x, y: sum(None not in (a, b) and ((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in zip(x, y, strict=True))
    assert parts(got) == parts((i, j) for i, x in enumerate(rows) for j, y in enumerate(rows) if i < j and votes(x, y) >= least)
    assert (least > 3) == (not got) and all(a != b for a, b in got)


def test_smart_scan_keeps_its_plans_small(spark, monkeypatch):
    from kinfold import scan as scans

    plans, components = [], scans.connected_components

    def seen(links):
        plans.append(links._jdf.queryExecution().optimizedPlan().toString())
        return components(links)

    monkeypatch.setattr(scans, "connected_components", seen)
    rows = [(i, f"/d/f{i}.jpg", f"f{i}.jpg", "/d", 100, 1, i % 3, i % 3, i % 3, True) for i in range(9)]
    files = spark.createDataFrame(rows, "id long, path string, name string, dir string, size long, mod_unix long, dhash long, ahash long, phash long, decoded boolean")
    found = scan(spark, ScanSpec(mode="smart", threshold=2), files, F.col("path").cast("binary")).members
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert found.count() == 9 and len(plans) == 2
    # the driver keeps each plan, its metrics and a broadcast a join until the query ends
    assert [p.count("Join ") <= most for p, most in zip(plans, (1, 8), strict=True)] == [True, True], [p.count("Join ") for p in plans]


@pytest.mark.parametrize("most", [0, 5, 10, 20])
def test_bands_miss_no_pair(spark, most):
    rng = np.random.default_rng(most)
    base = rng.integers(-(2**63), 2**63 - 1, 12)
    hashes = [int(b) for b in base] + [int(b ^ np.int64(sum(1 << int(i) for i in rng.choice(62, rng.integers(0, most + 3), replace=False)))) for b in base for _ in range(6)]
    got = J.close_pairs(spark.createDataFrame(list(enumerate(hashes)), "id long, fp long"), most).collect()
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert sorted(map(tuple, got)) == sorted((i, j, d) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (d := bits(a, b)) <= most)
    assert all(sum(J.band_widths(most, n)) == 64 for n in (10, 10**6))


def test_settings():
    assert [constants.clamped(*x) for x in (("quick", 25), ("quick", -1), ("acoustic", 80), ("acoustic", 101))] == [20, 0, 80, 100]
    assert [constants.audio_least(t) for t in (0, 85, 101)] == [0.80, 0.85, 0.80]
    assert not constants.may_open("x.EXE") and constants.may_open("x.txt") and constants.may_open("exe")


def test_png_and_luma():
    rng = np.random.default_rng(2)
    for channels in (1, 3, 4):
        image = rng.integers(0, 256, (7, 5, channels)).astype(np.uint8)
        assert (media.decode_png(P.png(image)) == image).all()
    # every filter of a line, written here and read there
    image = rng.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    flat, lines = image.reshape(5, -1).astype(int), b""
    for y in range(5):
        up = flat[y - 1] if y else np.zeros(18, int)
        left = np.r_[0, 0, 0, flat[y][:-3]]
        corner = np.r_[0, 0, 0, up[:-3]]
        p = left + up - corner
        paeth = [min((a, b, c), key=lambda q, v=v: abs(v - q)) for a, b, c, v in zip(left, up, corner, p, strict=True)]
        guess = [np.zeros(18, int), left, up, (left + up) // 2, np.array(paeth)][y]
        lines += bytes([y]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (media.decode_png(raw) == image).all() and media.decode_png(raw[:60]) is None
    colour = np.array([[[200, 150, 90]]], np.uint8)
    want = (299 * 200 + 587 * 150 + 114 * 90) // 1000
    assert P.luma(colour)[0, 0] == want and P.luma(np.dstack([colour, [[255]]]))[0, 0] == want and P.luma(np.array([[123]], np.uint8))[0, 0] == 123
    half = np.dstack([colour.astype(int) * 128 // 255, [[128]]])
    assert abs(P.luma(P.unmultiplied(half))[0, 0] - want) <= 2
    assert P.shrunk(np.zeros((500, 800, 3))).shape == (150, 240, 3) and P.shrunk(np.zeros((3, 2))).shape == (3, 2)
    wide = gradient()
    assert {k: P.HASHES[k](P.luma(wide)) for k in P.HASHES} == {k: P.HASHES[k](P.luma(np.dstack([wide, np.full((64, 64), 255)]))) for k in P.HASHES}


FAKE = {
    "ffprobe": """#!/bin/sh
case "$*" in
  *bad*) exit 1;;
  *packet*) i=0; while [ $i -lt 128 ]; do echo "$i,"; i=$((i+1)); done;;
  *) echo '{"streams":[{"width":640,"height":480}],"format":{"duration":"100.0"}}';;
esac
""",
    "ffmpeg": """#!/bin/sh
case "$*" in
  *showinfo*) [ -e "{d}/nokeys" ] && exit 1; for i in 1 2 3 4 5; do head -c 1024 /dev/zero; echo "pts_time: ${i}0.5" >&2; done;;
  *fps=*) [ -e "{d}/nopass" ] && exit 1; head -c 8192 /dev/zero;;
  *ppm*) printf 'P6 2 1 255\\n'; printf 'abcdef';;
  *) echo run >> {d}/runs; head -c 1024 /dev/zero;;
esac
""",
    "fpcalc": """#!/bin/sh
echo '{"duration": 12.5, "fingerprint": [1,2,3,4,5,6,7,8,9,4294967295]}'
""",
}


def test_media_tools(spark, tmp_path):
    for name, text in FAKE.items():
        (tmp_path / name).write_text(text.replace("{d}", str(tmp_path)))
        (tmp_path / name).chmod(0o755)
    probe, mpeg = str(tmp_path / "ffprobe"), str(tmp_path / "ffmpeg")
    files = spark.createDataFrame([("/v/a.mp4",), ("/v/bad.mp4",)], "path string")
    good, bad = media.scan_videos(files, probe, mpeg).orderBy("path").collect()
    assert (good.duration, good.width, good.height, len(good.vhashes)) == (100.0, 640, 480, 8) and bad.duration is None and bad.psig is None and bad.vhashes is None
    assert len(good.psig) == 64 and abs(sum(good.psig) - 1) < 1e-5
    # each way stands in for the one before it
    assert len(media.keyframe_pass("x", 100, mpeg)) == 8
    (tmp_path / "nokeys").touch()
    assert media.keyframe_pass("x", 100, mpeg) == [] and len(media.fingerprint_video("x", 100, mpeg)) == 8 and not (tmp_path / "runs").exists()
    (tmp_path / "nopass").touch()
    assert len(media.fingerprint_video("x", 100, mpeg)) == 8 and len((tmp_path / "runs").read_text().split()) == 8
    assert len(media.fingerprint_video("x", 400, mpeg)) == 8 and media.fingerprint_video("x", 400, str(tmp_path / "absent")) is None
    audio = media.scan_audio(files, str(tmp_path / "fpcalc")).first()
    assert audio.duration == 12.5 and len(audio.ahashes) == 10
    times = spark.range(1).select(media.nearest_index(media.keyframe_times(F.lit("pts_time: 1.5 x pts_time:3 pts_time:4.5")), F.lit(3.75)).alias("i")).first()
    assert times.i == 1
    paths = media.ToolPaths(str(tmp_path / "tools.json"))
    paths.save("ffprobe", probe)
    assert media.ToolPaths(str(tmp_path / "tools.json")).of("ffprobe") == probe and paths.of("no-such-tool") is None
    (tmp_path / "tools.json").write_text("{")
    assert media.ToolPaths(str(tmp_path / "tools.json")).known == {}


def test_thumbnails(spark, pictures):
    tool = pictures / "ffmpeg"
    tool.write_text(FAKE["ffmpeg"].replace("{d}", str(pictures)))
    tool.chmod(tool.stat().st_mode | stat.S_IXUSR)
    rows = [(str(pictures / n), 1, 2) for n in ("large.png", "large.png", "noise.ppm", "broken.png", "song.mp3", "clip.mp4")]
    wanted = thumbs.targets(spark.createDataFrame(rows, "path string, size long, mod_unix long"))
    assert sorted(os.path.basename(r.path) for r in wanted.collect()) == ["broken.png", "clip.mp4", "large.png"]
    out = str(pictures / "thumbs")
    state = lambda: sorted(r.state for r in thumbs.write_thumbs(wanted, out, ffmpeg=str(tool)).collect())
    assert state() == ["failed", "made", "made"] and state() == ["failed", "there", "there"]
    key = next(r.thumb for r in wanted.collect() if "large" in r.path)
    assert media.read_image(thumbs.place(out, key)).shape == (128, 128, 3)


def test_delete_undo_session_and_export(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text("same")
    rows = [("g", str(tmp_path / n), n, str(tmp_path), 4, i, i, 1, 1, "m") for i, n in enumerate("abc")]
    m = spark.createDataFrame(rows, "gid string, path string, name string, dir string, size long, mod_unix long, pos int, width int, height int, md5 string")
    folder = str(tmp_path / "session")
    assert session.peek(spark, folder) is None and session.save(spark, folder, m, note="x") == 3 and session.save(spark, folder, m, note="y") == 3
    assert session.peek(spark, folder)["note"] == "y" and session.load(spark, folder)[0].count() == 3 and session.size(spark, folder) > 0
    (tmp_path / "session" / ".current.crc").unlink(missing_ok=True)
    (tmp_path / "session" / "current").write_text('{"version": 2, "data": "x"}')
    assert session.peek(spark, folder) is None
    with pytest.raises(ValueError):
        session.load(spark, folder)
    assert session.clear(spark, folder) and session.pointer(spark, folder) is None
    plan = delete_plan(m, m.select("path"))
    done, left = removal.remove(plan, m, str(tmp_path / "trash"))
    assert sorted(map(os.path.basename, done.deleted)) == ["b", "c"] and left.count() == 0 and (tmp_path / "a").exists() and not (tmp_path / "b").exists()
    (tmp_path / "b").write_text("new")
    restored, failed, back = removal.undo(done)
    assert [os.path.basename(p) for p in restored] == ["c"] and [os.path.basename(p) for p in failed] == ["b"] and back is None
    with pytest.raises(ValueError):
        removal.undo(done)
    gone, _ = removal.remove(plan.limit(1), m, None)
    assert not gone.can_undo and len(gone.deleted) == 1
    sinks.write_csv(m, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).filter("Role = 'keep'").count() == 1
    assert len(sinks.nested(m, G.totals(m)).first().files) == 3


def test_store_keeps_what_retried_batches_say_once(spark, tmp_path):
    schema, folder = "path string, size long, md5 string", str(tmp_path / "store")
    batch = lambda *rows: spark.createDataFrame(rows, schema)
    assert store.load(spark, folder, schema).count() == 0
    store.append(batch(("a", 1, "x"), ("b", 2, "y")), folder, 1)
    store.append(batch(("a", 9, None)), folder, 2)
    store.append(batch(("a", 9, None)), folder, 2)
    want = [("a", 9, "x"), ("b", 2, "y")]
    assert sorted(map(tuple, store.load(spark, folder, schema).collect())) == want
    assert store.compact(spark, folder, schema) == 2 and sorted(map(tuple, store.load(spark, folder, schema).collect())) == want
    store.append(batch(("c", 3, "z")), folder, 3)
    assert store.compact(spark, folder, schema) == 3 and store.size(spark, folder) > 0
    assert store.clear(spark, folder) and store.load(spark, folder, schema).count() == 0


def test_streaming(spark, tmp_path):
    spark.createDataFrame([("a", "x", 5), ("b", "x", 7)], "path string, md5 string, size long").write.json(str(tmp_path / "in"))
    schema = "path string, md5 string, size long"
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    incremental.upsert_fingerprints(stream, str(tmp_path / "journal"), str(tmp_path / "check")).awaitTermination()
    write = incremental.batch_writer(str(tmp_path / "journal"))
    for _ in range(2):  # a batch that is tried again
        write(spark.createDataFrame([("a", "w", 6)], schema), 1)
    assert sorted((r.path, r.md5) for r in incremental.snapshot(spark, str(tmp_path / "journal"), schema + ", seq long").collect()) == [("a", "w"), ("b", "x")]
    query = incremental.streaming_groups(stream).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.md5, r.members, r.largest) for r in spark.table("running").collect()] == [("x", 2, 7)]


def test_representatives_and_log(spark):
    m = spark.createDataFrame([("g", 1, None), ("g", 2, [7]), ("g", 3, [8]), ("h", 4, [])], "gid string, id long, hashes array<long>")
    assert [(r.id, r.rep, r.hashes) for r in G.inherit(m, "hashes").orderBy("id").collect()] == [(1, 2, [7]), (2, 2, [7]), (3, 2, [8]), (4, None, None)]
    log, tail = logging.getLogger("kinfold"), Tail(kept=3)
    log.addHandler(tail)
    for i in range(5):
        log.warning("line %d", i)
    log.removeHandler(tail)
    assert [x[-1] for x in tail.lines()] == ["2", "3", "4"] and tail.lines(1) == tail.lines()[-1:]
    assert session.decode_counts(spark.createDataFrame([(True,), (False,), (True,)], "decoded boolean")).first() == (3, 2, 1)
