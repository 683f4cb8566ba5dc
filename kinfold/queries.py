"""Queries over the virtual files of ``documents``, and their SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .constants import SIGNATURE_BINS
from .functions import scalar as S
from .functions.pixels import hash_rows
from .functions.simhash import simhash, text_simhashes
from .operators import close as D
from .operators import groups as G
from .operators import joins as J
from .operators import selection as K
from .operators import store as C
from .operators.components import connected_components
from .plans.scratch import release, stored
from .scan import ScanSpec, scan
from .sources import media
from .sources.files import file_filter, virtual_files
from .sources.sinks import export_rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vf(spark: SparkSession, d: str) -> DataFrame:
    return virtual_files(table(spark, d, "documents"))


def members(spark: SparkSession, d: str) -> DataFrame:
    return G.exact_members(G.hashed(vf(spark, d), F.md5("content")))


VF = """vf AS (SELECT doc_id AS id, '/' || source || '/' || lang AS dir, 'doc_' || doc_id || '.txt' AS name,
  '/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size,
  (1600000000 + doc_id * 7919 % 1000000) * 1000000000 AS mod_unix, (strlen(text) % 400 + 100)::INT AS width,
  (doc_id % 300 + 100)::INT AS height, text FROM documents)"""
MEMBERS = VF + """, h AS (SELECT *, md5(text) AS md5 FROM vf WHERE size > 0),
 m0 AS (SELECT *, count(*) OVER (PARTITION BY md5) AS members, min(path) OVER (PARTITION BY md5) AS gid FROM h),
 m AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY mod_unix, path) - 1 AS pos FROM m0 WHERE members > 1)"""
TOTALS = "SELECT gid, count(*) AS members, sum(size)::BIGINT AS total_size, (sum(size) - max(size))::BIGINT AS wasted_size FROM {} GROUP BY gid HAVING count(*) > 1"


@query(f"WITH {MEMBERS} {TOTALS.format('m')} ORDER BY wasted_size DESC, gid")
def exact_groups(spark, d):
    return G.by_waste(G.totals(members(spark, d)))


@query("""SELECT t, count(*) AS files, count(*) - count(DISTINCT h) AS repeated FROM (SELECT 'pages' AS t, md5(html) AS h FROM pages UNION ALL SELECT 'conversations', md5(text) FROM conversations)
 GROUP BY t""")
def exact_repeats(spark, d):
    rows = [table(spark, d, t).select(F.lit(t).alias("t"), F.md5(F.col(c).cast("binary")).alias("h")) for t, c in (("pages", "html"), ("conversations", "text"))]
    return rows[0].unionByName(rows[1]).groupBy("t").agg(F.count("*").alias("files"), (F.count("h") - F.countDistinct("h")).alias("repeated"))


@query("""SELECT t, count(*) AS groups FROM (SELECT 'pages' AS t, md5(html) AS h FROM pages UNION ALL SELECT 'conversations', md5(text) FROM conversations)
 GROUP BY t, h HAVING count(*) > 1""")
def exact_no_duplicates(spark, d):
    rows = [table(spark, d, t).select(F.lit(t).alias("t"), F.md5(F.col(c).cast("binary")).alias("h")) for t, c in (("pages", "html"), ("conversations", "text"))]
    return rows[0].unionByName(rows[1]).groupBy("t", "h").agg(F.count("*").alias("groups")).filter("groups > 1").select("t", "groups")


@query(f"""WITH {VF}, b AS (SELECT *, encode(text) AS c FROM vf WHERE size > 0),
 s AS (SELECT *, hex(c) AS x, lpad(lower(to_hex(size)), 16, '0') AS z FROM b),
 h AS (SELECT *, CASE WHEN size <= 4096 THEN md5(text) ELSE md5(unhex(x[1:512] || x[(size // 2 - 128) * 2 + 1:(size // 2 + 128) * 2] || x[(size - 256) * 2 + 1:]
   || z[15:16] || z[13:14] || z[11:12] || z[9:10] || z[7:8] || z[5:6] || z[3:4] || z[1:2])) END AS md5 FROM s),
 m AS (SELECT size, min(path) OVER (PARTITION BY md5) AS gid FROM h) {TOTALS.format('m')}""")
def partial_hash_groups(spark, d):
    files = G.hashed(vf(spark, d), S.content_hash(F.col("content"), 4096, 256))
    return G.totals(G.exact_members(files))


@query(f"WITH {VF}, c AS (SELECT id, size, count(*) OVER (PARTITION BY size) AS same_size FROM vf WHERE size > 0) SELECT * FROM c WHERE same_size > 1")
def size_gate(spark, d):
    return G.size_gate(vf(spark, d)).select("id", "size", "same_size")


FILTERED = VF + """, f AS (SELECT id, CASE id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'txt' WHEN 3 THEN 'mp4' ELSE 'zip' END AS ext,
 dir || CASE WHEN id % 7 = 0 THEN '/.hidden' ELSE '' END AS dir, size FROM vf)"""


@query(f"""WITH {FILTERED} SELECT id, dir || '/doc_' || id || '.' || ext AS path, size FROM f
 WHERE lower(ext) IN ('jpg', 'jpeg') AND dir NOT LIKE '%/.%' AND size >= 1024 AND NOT (dir = '/src1' OR starts_with(dir, '/src1/'))""")
def file_filter_rows(spark, d):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("jpg", "JPEG", "txt", "mp4", "zip")]), (F.col("id") % 5 + 1).cast("int"))
    files = vf(spark, d).withColumn("dir", F.concat("dir", F.when(F.col("id") % 7 == 0, "/.hidden").otherwise("")))
    files = files.withColumn("name", F.concat(F.lit("doc_"), "id", F.lit("."), ext)).withColumn("path", F.concat("dir", F.lit("/"), "name"))
    return file_filter(files, "images", min_size_kb=1, exclude=["/src1"]).select("id", "path", "size")


@query(f"WITH {MEMBERS} SELECT gid, id, pos FROM m")
def member_rank(spark, d):
    return members(spark, d).select("gid", "id", F.col("pos").cast("long").alias("pos"))


ORDERS = {"oldest": "mod_unix, pos", "newest": "mod_unix DESC, pos", "largest": "size DESC, pos", "highest_res": "width::BIGINT * height DESC, pos", "prefer_dir": "CASE WHEN dir = '/src0' OR starts_with(dir, '/src0/') THEN 0 ELSE 1 END, pos"}
for _strategy, _order in ORDERS.items():
    query(f"WITH {MEMBERS} SELECT gid, id, row_number() OVER (PARTITION BY gid ORDER BY {_order}) = 1 AS keep FROM m", f"keep_{_strategy}")(
        lambda spark, d, s=_strategy: K.keep(members(spark, d), s, prefer_dir="/src0").select("gid", "id", "keep")
    )


@query(f"WITH {MEMBERS}, g AS ({TOTALS.format('m')}) SELECT m.gid, m.id FROM m JOIN g USING (gid) WHERE wasted_size / 1048576 >= 0.005")
def min_wasted_filter(spark, d):
    return K.keep(members(spark, d), "oldest", min_wasted_mb=0.005).select("gid", "id")


PLAN = MEMBERS + """, p AS (SELECT *, count(*) FILTER (id % 3 != 0) OVER (PARTITION BY gid) = members AS whole FROM m),
 plan AS (SELECT gid, id, path FROM p WHERE id % 3 != 0 AND NOT (whole AND pos = 0))"""


def _plan(spark, d):
    return K.delete_plan(members(spark, d), vf(spark, d).filter("id % 3 != 0"))


@query(f"WITH {PLAN} SELECT gid, id, path FROM plan")
def delete_plan_keep_one(spark, d):
    return _plan(spark, d).select("gid", "id", "path")


@query(f"WITH {PLAN}, l AS (SELECT * FROM m WHERE path NOT IN (SELECT path FROM plan)) {TOTALS.format('l')}")
def prune_after_delete(spark, d):
    return K.prune(members(spark, d), _plan(spark, d))[1]


@query(f"""WITH {MEMBERS} SELECT gid AS "Group", 'md5' AS "Type", '100.0' AS "Similarity %", CASE WHEN pos = 0 THEN 'keep' ELSE 'duplicate' END AS "Role",
 path AS "Path", name AS "Name", size AS "Bytes", printf('%.2f', size / 1048576) AS "MB", width AS "Width", height AS "Height",
 printf('%.2f', round(width::BIGINT * height / 100000.0) / 10) AS "MP", 'txt' AS "Format",
 strftime(make_timestamp(mod_unix // 1000), '%Y-%m-%dT%H:%M:%SZ') AS "Modified", md5 AS "MD5" FROM m""", name="export_rows")
def export(spark, d):
    return export_rows(members(spark, d))


@query(f"WITH {MEMBERS} SELECT dir, count(*) AS files, sum(size)::BIGINT AS reclaimable FROM m WHERE pos > 0 GROUP BY dir")
def folder_breakdown(spark, d):
    return G.folders(members(spark, d))


@query(f"WITH {MEMBERS}, g AS ({TOTALS.format('m')}) SELECT count(*) AS groups, round(coalesce(sum(wasted_size), 0) / 1048576, 6) AS wasted_mb FROM g")
def scan_totals(spark, d):
    return G.scan_totals(G.totals(members(spark, d)))


# 60-bit SimHash of distinct texts: of their words, word pairs and runs of four characters

HASH = "('0x' || substr(md5(w), 1, 15))::BIGINT"
TEXTS = "t AS (SELECT min(doc_id) AS id, text FROM documents GROUP BY text)"


def _fp_sql(name: str, units: str) -> str:
    ones = "+".join(f"(CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b} ELSE 0 END)" for b in range(60))
    return f"{name} AS (SELECT id, {ones} AS fp FROM (SELECT DISTINCT id, {HASH} AS h FROM ({units})) GROUP BY id)"


WORDS_SQL = r"SELECT id, unnest(regexp_extract_all(lower(text), '\w+')) AS w FROM t"
LISTS_SQL = r"(SELECT id, regexp_extract_all(lower(text), '\w+') AS l FROM t)"
PAIRS_SQL = f"SELECT id, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS w FROM {LISTS_SQL}"
CHARS_SQL = "SELECT id, unnest(list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4))) AS w FROM t"
FP = f"{TEXTS}, {_fp_sql('fps', WORDS_SQL)}"


def texts(spark, d) -> DataFrame:
    return table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("id"))


def _words(t: DataFrame) -> DataFrame:
    return t.select("id", F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), F.lit(0)).alias("l"))


def fingerprints(spark, d, kind: str = "words") -> DataFrame:
    return _simhashes(texts(spark, d), kind)


def _simhashes(t: DataFrame, kind: str) -> DataFrame:
    """(id, fp) of rows (id, text); texts of one id count as one."""
    text = "text" if kind == "chars" else F.lower("text").alias("text")
    found = stored(t.select("id", text).mapInArrow(text_simhashes(kind), "id long, fp long"), "simhashes")
    several = found.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    if several.isEmpty():
        return found
    return found.join(several, "id", "left_anti").unionByName(_simhashes_of_units(t.join(several, "id"), kind))


def _simhashes_of_units(t: DataFrame, kind: str) -> DataFrame:
    if kind == "chars":
        n = F.length("text")
        units = t.select("id", F.explode(F.when(n >= 4, F.transform(F.sequence(F.lit(1), n - 3), lambda i: F.substring(F.col("text"), i, F.lit(4))))).alias("word"))
    else:
        lists = _words(t)
        pairs = F.transform(F.slice("l", F.lit(1), F.greatest(F.size("l") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get("l", i + 1)))
        units = lists.select("id", F.explode("l" if kind == "words" else pairs).alias("word"))
    return simhash(units, ["id"])


def _pairs_sql(fps: str, t: int) -> str:
    return f"SELECT a.id AS a, b.id AS b, bit_count(xor(a.fp, b.fp))::BIGINT AS dist FROM {fps} a JOIN {fps} b ON a.id < b.id AND bit_count(xor(a.fp, b.fp)) <= {t}"


for _t in (3, 5, 8, 10, 12):
    query(f"WITH {FP} {_pairs_sql('fps', _t)}", f"hamming_pairs_t{_t}")(lambda spark, d, t=_t: J.close_pairs(fingerprints(spark, d), t))


def _labels_sql(pairs: str) -> str:
    return f"""e AS (SELECT a, b FROM ({pairs})), r AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
 reach AS (SELECT x, y FROM r UNION SELECT reach.x, r.y FROM reach JOIN r ON reach.y = r.x),
 g AS (SELECT x AS id, least(x, min(y)) AS gid FROM reach GROUP BY x)"""


def linked(fps: DataFrame, t: int) -> DataFrame:
    """(id, gid) by links between distinct hashes and star links within a hash."""
    links = J.hamming_pairs(fps, t, forest=True).select("a", "b").unionByName(J.same_hash_links(fps))
    return connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("gid"))


@query(f"WITH RECURSIVE {FP}, {_labels_sql(_pairs_sql('fps', 8))} SELECT id, gid FROM g")
def hamming_groups(spark, d):
    return linked(fingerprints(spark, d), 8)


@query(f"""WITH RECURSIVE {FP}, {_labels_sql(_pairs_sql('fps', 8))}, w AS (SELECT g.gid, g.id, fp FROM g JOIN fps USING (id))
 SELECT a.gid, round(1 - avg(bit_count(xor(a.fp, b.fp))) / 64, 6) AS similarity FROM w a JOIN w b ON a.gid = b.gid AND a.id < b.id GROUP BY a.gid""")
def perceptual_similarity(spark, d):
    fps = fingerprints(spark, d)
    return G.bit_similarity(linked(fps, 8).join(fps, "id"), ["fp"]).select("gid", F.round("similarity", 6).alias("similarity"))


VOTES = f"{TEXTS}, {_fp_sql('f1', WORDS_SQL)}, {_fp_sql('f2', PAIRS_SQL)}, {_fp_sql('f3', CHARS_SQL)}, v AS (" + " UNION ALL ".join(f"SELECT a, b, '{n}' AS algo FROM ({_pairs_sql(n, 8)})" for n in ("f1", "f2", "f3")) + ")"
for _least in (1, 2):
    query(f"WITH {VOTES} SELECT a, b, count(DISTINCT algo) AS votes FROM v GROUP BY a, b HAVING count(DISTINCT algo) >= {_least}", f"smart_votes_{_least}")(
        lambda spark, d, n=_least: J.votes({k: J.close_pairs(fingerprints(spark, d, k), 8) for k in ("words", "pairs", "chars")}, n)
    )

# pixel kernels over 8 x 8 grids

GRID = "SELECT vec_id AS id, list_transform(embedding, lambda v: least(255, greatest(0, floor((v::DOUBLE + 1) * 128)))::BIGINT) AS p FROM embeddings"


def grids(spark, d) -> DataFrame:
    luma = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 1) * 128))).cast("long"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), luma.alias("p"))


def _grid_sql(kind: str) -> str:
    if kind == "dhash":
        bits = [f"p[{y * 8 + x * 8 // 9 + 1}] > p[{y * 8 + (x + 1) * 8 // 9 + 1}]" for y in range(8) for x in range(8)]
    else:
        bits = [f"p[{i + 1}] > list_sum(p)::BIGINT // 64" for i in range(64)]
    return f"SELECT id, {' || '.join(f'CASE WHEN {b} THEN 1 ELSE 0 END' for b in reversed(bits))} AS bits FROM ({GRID})"


for _kind in ("ahash", "dhash"):
    query(_grid_sql(_kind), f"{_kind}_grid")(lambda spark, d, k=_kind: grids(spark, d).select("id", F.lpad(F.bin(S.grid_hash(F.col("p"), 8, 8, k)), 64, "0").alias("bits")))


@query()
def phash_grid(spark, d):
    return grids(spark, d).select("id", F.col("p").alias("pixels")).mapInPandas(hash_rows(8, 8, ("phash",)), "id long, phash long")


# durations, videos, audio

DUR = "d AS (SELECT doc_id AS id, n_chars / 10.0 AS duration FROM documents)"
CLOSE = "abs({a}.duration - {b}.duration) <= greatest(1.0, ({a}.duration + {b}.duration) / 2 * 0.01)"


def durations(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") / 10.0).alias("duration"))


@query(f"WITH {DUR} SELECT id, duration, EXISTS (SELECT 1 FROM d o WHERE o.id != d.id AND {CLOSE.format(a='d', b='o')}) AS candidate FROM d")
def duration_candidates(spark, d):
    return J.duration_candidates(durations(spark, d))


TEXTDUR = "(SELECT id, length(text) / 10.0 AS duration, regexp_extract_all(lower(text), '\\w+') AS l FROM t)"


def text_durations(spark, d) -> DataFrame:
    return texts(spark, d).select("id", F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), F.lit(0)).alias("l"), (F.length("text") / 10.0).alias("duration"))


@query(f"WITH {TEXTS}, d AS (SELECT id, length(text) / 10.0 AS duration FROM t) SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON a.id < b.id AND {CLOSE.format(a='a', b='b')}")
def duration_pairs(spark, d):
    rows = texts(spark, d).select("id", (F.length("text") / 10.0).alias("duration"))
    return J.duration_pairs(rows).select(F.col("id").alias("a"), F.col("id2").alias("b"))


SEG = "(i - 1) * 8 // len(l)"
FRAMES_SQL = f"""{TEXTS}, l0 AS (SELECT * FROM {TEXTDUR} WHERE len(l) >= 8), u AS (SELECT id, unnest(list_transform(range(1, len(l) + 1), lambda i: {{'s': {SEG}, 'w': l[i]}})) AS e FROM l0),
 {_fp_sql('x', 'SELECT id * 8 + e.s AS id, e.w AS w FROM u')}, f AS (SELECT id // 8 AS id, list(fp ORDER BY id) AS frames FROM x GROUP BY id // 8),
 vid AS (SELECT f.id, duration, frames FROM f JOIN l0 USING (id)),
 vp AS (SELECT a.id AS a, b.id AS b, list_sum(list_transform(range(1, 9), lambda i: bit_count(xor(a.frames[i], b.frames[i]))::BIGINT))::BIGINT // 8 AS dist
  FROM vid a JOIN vid b ON a.id < b.id AND {CLOSE.format(a='a', b='b')})"""


def frames(spark, d) -> DataFrame:
    lists = text_durations(spark, d).filter(F.size("l") >= 8)
    units = lists.select("id", F.size("l").alias("n"), F.posexplode("l").alias("i", "word")).withColumn("seg", F.floor(F.col("i") * 8 / F.col("n")))
    fps = simhash(units, ["id", "seg"])
    held = fps.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "fp"))), lambda s: s["fp"]).alias("frames"))
    return held.join(lists.select("id", "duration"), "id")


@query(f"""WITH RECURSIVE {FRAMES_SQL}, {_labels_sql('SELECT a, b FROM vp WHERE dist <= 8')}, w AS (SELECT gid, g.id, frames FROM g JOIN vid USING (id)),
 s AS (SELECT a.gid, list_sum(list_transform(range(1, 9), lambda i: bit_count(xor(a.frames[i], b.frames[i]))::BIGINT))::BIGINT // 8 AS dist FROM w a JOIN w b ON a.gid = b.gid AND a.id < b.id)
 SELECT g.id, g.gid, q.similarity FROM g JOIN (SELECT gid, round(avg(1 - dist / 64.0), 6) AS similarity FROM s GROUP BY gid) q USING (gid)""")
def video_groups(spark, d):
    rows = frames(spark, d)
    pairs = J.duration_pairs(rows, where=S.frame_distance(F.col("frames"), F.col("frames2")) <= 8).select(F.col("id").alias("a"), F.col("id2").alias("b"))
    m = G.similar_members(rows, pairs)
    similarity = G.pair_similarity(m, lambda x, y: 1 - S.frame_distance(x, y) / 64.0, "frames").withColumn("similarity", F.round("similarity", 6))
    return m.join(similarity, "gid").select("id", "gid", "similarity")


AUDIO_SQL = f"""{TEXTS}, aud AS (SELECT id, duration, list_transform(l, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT) AS ws FROM {TEXTDUR} WHERE len(l) >= 10),
 ap AS (SELECT a.id AS a, b.id AS b, 1 - list_sum(list_transform(range(1, least(len(a.ws), len(b.ws)) + 1), lambda i: bit_count(xor(a.ws[i], b.ws[i]))::BIGINT))::BIGINT / (32.0 * least(len(a.ws), len(b.ws))) AS sim
  FROM aud a JOIN aud b ON a.id < b.id AND {CLOSE.format(a='a', b='b')})"""


AUDIO_GROUPS = f"WITH RECURSIVE {AUDIO_SQL}, {_labels_sql('SELECT a, b FROM ap WHERE sim >= 0.8')}"


def _audio(spark, d) -> tuple[DataFrame, DataFrame]:
    word = lambda w: F.substring(F.md5(w.cast("binary")), 1, 8)
    words = F.unhex(F.array_join(F.transform("l", word), ""))
    rows = stored(text_durations(spark, d).filter(F.size("l") >= 10).select("id", "duration", words.alias("ws")), "audio")
    release(spark)
    pairs = D.close_pairs(rows, F.octet_length("ws") / 4, D.alike_words(0.8), "id long, id2 long")
    return rows, connected_components(pairs, "id", "id2").select(F.col("node").alias("id"), F.col("component").alias("gid"))


@query(f"{AUDIO_GROUPS} SELECT id, gid FROM g")
def audio_groups(spark, d):
    return _audio(spark, d)[1]


@query(f"""{AUDIO_GROUPS}, w AS (SELECT gid, g.id, ws FROM g JOIN aud USING (id))
 SELECT a.gid, round(avg(1 - list_sum(list_transform(range(1, least(len(a.ws), len(b.ws)) + 1), lambda i: bit_count(xor(a.ws[i], b.ws[i]))::BIGINT))::BIGINT / (32.0 * least(len(a.ws), len(b.ws)))), 6) AS similarity
 FROM w a JOIN w b ON a.gid = b.gid AND a.id < b.id GROUP BY a.gid""")
def audio_group_similarity(spark, d):
    rows, found = _audio(spark, d)
    return D.word_similarity(rows.join(found, "id")).select("gid", F.round("similarity", 6).alias("similarity"))


SIG_SQL = f"""{TEXTS}, q AS (SELECT id, text, regexp_extract_all(text, '[^ \\t\\n\\r]+') AS l FROM t), p AS (SELECT id, len(l) AS n, unnest(list_transform(range(0, len(l)), lambda i: {{'i': i, 's': strlen(l[i + 1])}})) AS e FROM q WHERE len(l) >= 64),
 bins AS (SELECT id, e.i * 64 // n AS bin, sum(e.s)::DOUBLE AS s FROM p GROUP BY ALL), tot AS (SELECT id, sum(s) AS total, sqrt(sum((s) * (s))) AS norm FROM bins GROUP BY id),
 sig AS (SELECT id, bin, s, norm FROM bins JOIN tot USING (id)), meta AS (SELECT id, strlen(text)::BIGINT AS size, length(text) / 10.0 AS duration FROM t WHERE id IN (SELECT id FROM tot)),
 cand AS (SELECT a.id AS a, b.id AS b FROM meta a JOIN meta b ON a.id < b.id AND {CLOSE.format(a='a', b='b')} AND abs(a.size - b.size) / greatest(a.size, b.size) <= 0.02),
 cos AS (SELECT a, b, sum(x.s * y.s / x.norm / y.norm) AS cosine FROM cand JOIN sig x ON x.id = a JOIN sig y ON y.id = b AND y.bin = x.bin GROUP BY a, b)"""


def text_signatures(batches):
    """mapInArrow function: (id, text, size, duration) to (id, size, duration, psig) by the sizes of a text's words, as media.packet_signature has it."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for i, text, size, duration in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sizes = [len(w.encode()) for w in re.findall(r"[^ \t\n\r]+", text or "")]
            if len(sizes) >= SIGNATURE_BINS:
                found = media.packet_bins(sizes)
                out.append((i, size, duration, found))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float32()))
        columns = zip(*out, strict=True) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "size", "duration", "psig"])


def signatures(spark, d) -> DataFrame:
    rows = texts(spark, d).select("id", "text", F.octet_length(F.col("text").cast("binary")).cast("long").alias("size"), (F.length("text") / 10.0).alias("duration"))
    return rows.mapInArrow(text_signatures, "id long, size long, duration double, psig array<float>")


def _signature_pairs(spark, d, least: float, forest: bool = False) -> DataFrame:
    return D.close_pairs(signatures(spark, d), F.lit(128), D.alike_signatures(least, 0.02, forest), "id long, id2 long, cosine double")


@query(f"WITH {SIG_SQL} SELECT a, b, round(cosine, 4) AS cosine FROM cos WHERE cosine >= 0.999")
def packet_cosine_pairs(spark, d):
    pairs = _signature_pairs(spark, d, 0.999)
    return pairs.select(F.col("id").alias("a"), F.col("id2").alias("b"), F.round("cosine", 4).alias("cosine"))


@query(f"""WITH RECURSIVE {SIG_SQL}, {_labels_sql('SELECT a, b FROM cos WHERE cosine >= 0.99')} SELECT id, gid, arg_min(id, (id % 2) * 1000000000000 + id) OVER (PARTITION BY gid) AS rep FROM g""")
def cluster_representative(spark, d):
    """The representative of a cluster: the first member that has cached frames (here: an even id), else the first."""
    m = connected_components(_signature_pairs(spark, d, 0.99, forest=True), "id", "id2").select(F.col("node").alias("id"), F.col("component").alias("gid"))
    rep = m.groupBy("gid").agg(F.min_by("id", F.struct(F.col("id") % 2, "id")).alias("rep"))
    return m.join(rep, "gid").select("id", "gid", "rep")


@query(f"""WITH {MEMBERS}, v AS (SELECT gid, id, CASE WHEN id % 3 = 0 THEN [id, id + 1] END AS hashes FROM m),
 r AS (SELECT gid, min(id) FILTER (hashes IS NOT NULL) AS rep FROM v GROUP BY gid)
 SELECT v.gid, v.id, r.rep, coalesce(v.hashes[1], q.hashes[1]) AS first_hash FROM v JOIN r USING (gid) LEFT JOIN v q ON q.id = r.rep""")
def representative_hashes(spark, d):
    """Members without frame hashes (here: ids no multiple of three) take their representative's."""
    m = members(spark, d).select("gid", "id", F.when(F.col("id") % 3 == 0, F.array("id", F.col("id") + 1)).alias("hashes"))
    return G.inherit(m, "hashes").select("gid", "id", "rep", F.get("hashes", 0).alias("first_hash"))


@query(f"""WITH {MEMBERS}, t AS ({TOTALS.format('m')}), p AS (SELECT *, row_number() OVER (ORDER BY wasted_size DESC, gid)::INT AS rank FROM t)
 SELECT gid, wasted_size, rank FROM p WHERE rank BETWEEN 6 AND 10""")
def group_page(spark, d):
    return G.page(G.totals(members(spark, d)), 2, 5).select("gid", "wasted_size", "rank")


SCAN_SQL = f"""WITH RECURSIVE {VF}, hm AS (SELECT *, md5(text) AS md5 FROM vf WHERE size > 0),
 em AS (SELECT *, count(*) OVER (PARTITION BY md5) AS k, min(path) OVER (PARTITION BY md5) AS gid FROM hm),
 t AS (SELECT id, text FROM em WHERE k = 1), {_fp_sql('f1', WORDS_SQL)}, {_fp_sql('f2', PAIRS_SQL)}, {_fp_sql('f3', CHARS_SQL)},
 c AS (SELECT t.id, coalesce(f1.fp, 0) AS a, coalesce(f2.fp, 0) AS p, coalesce(f3.fp, 0) AS h FROM t LEFT JOIN f1 USING (id) LEFT JOIN f2 USING (id) LEFT JOIN f3 USING (id)),
 {_labels_sql("SELECT x.id AS a, y.id AS b FROM c x JOIN c y ON x.id < y.id AND (bit_count(xor(x.a, y.a)) <= 8)::INT + (bit_count(xor(x.p, y.p)) <= 8)::INT + (bit_count(xor(x.h, y.h)) <= 8)::INT >= 2")},
 sm AS (SELECT v.*, min(path) OVER (PARTITION BY g.gid) AS gid FROM g JOIN vf v USING (id)),
 u AS (SELECT gid, id, path, mod_unix, true AS exact, 'md5' AS algorithm FROM em WHERE k > 1 UNION ALL SELECT gid, id, path, mod_unix, false, 'smart' FROM sm)
 SELECT gid, id, row_number() OVER (PARTITION BY gid ORDER BY mod_unix, path) - 1 AS pos, exact, algorithm FROM u"""


@query(SCAN_SQL)
def scan_smart(spark, d):
    """A whole smart scan over virtual files whose three perceptual hashes are SimHashes of their text."""
    files = vf(spark, d)
    own = files.select("id", F.col("content").cast("string").alias("text"))
    kinds = {"ahash": "words", "phash": "pairs", "dhash": "chars"}
    fps = [_simhashes(own, kind).select("id", *[(F.col("fp") if k == name else F.lit(None).cast("long")).alias(k) for k in kinds]) for name, kind in kinds.items()]
    hashes = stored(reduce(DataFrame.unionByName, fps).groupBy("id").agg(*[F.max(k).alias(k) for k in kinds]), "hashes")
    files = files.join(hashes, "id", "left").withColumns({k: F.coalesce(k, F.lit(0).cast("long")) for k in kinds})
    spec = ScanSpec(category="images", mode="smart", threshold=8, extensions=("txt",), min_votes=2, verify_full=True)
    found = scan(spark, spec, files.withColumn("decoded", F.lit(True)), F.col("content"))
    return found.members.select("gid", "id", F.col("pos").cast("long").alias("pos"), "exact", "algorithm")


# fingerprint store

OLD = VF + """, o AS (SELECT CASE WHEN id % 4 = 1 THEN '/old' || path ELSE path END AS path, CASE WHEN id % 5 = 2 THEN size + 1 ELSE size END AS size, mod_unix,
 md5(text) AS md5, CASE WHEN id % 3 != 0 THEN md5(text) END AS quick, id AS seq FROM vf WHERE id % 10 < 9)"""


def _old(spark, d) -> DataFrame:
    f = vf(spark, d).filter("id % 10 < 9")
    return f.select(F.when(F.col("id") % 4 == 1, F.concat(F.lit("/old"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("id") % 5 == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
                    "mod_unix", F.md5("content").alias("md5"), F.when(F.col("id") % 3 != 0, F.md5("content")).alias("quick"), F.col("id").alias("seq"))


@query(f"WITH {OLD} SELECT vf.id, o.md5 AS cached FROM vf LEFT JOIN o ON o.path = vf.path AND o.size = vf.size AND o.mod_unix = vf.mod_unix")
def cache_lookup(spark, d):
    return C.lookup(vf(spark, d), _old(spark, d)).select("id", "cached")


@query(f"""WITH {OLD}, s AS (SELECT size, mod_unix, arg_max(quick, seq) AS quick, arg_max(md5, seq) AS md5 FROM o WHERE quick IS NOT NULL GROUP BY 1, 2)
 SELECT vf.id, CASE WHEN s.quick = md5(vf.text) THEN s.md5 END AS cached FROM vf LEFT JOIN s ON s.size = vf.size AND s.mod_unix = vf.mod_unix
 WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = vf.path AND o.size = vf.size AND o.mod_unix = vf.mod_unix)""")
def cache_rename_lookup(spark, d):
    return C.rename_lookup(vf(spark, d).withColumn("quick", F.md5("content")), _old(spark, d)).select("id", "cached")


@query(f"""WITH {OLD}, j AS (SELECT vf.id, o.md5 AS cached FROM vf LEFT JOIN o ON o.path = vf.path AND o.size = vf.size AND o.mod_unix = vf.mod_unix)
 SELECT count(*) AS files, count(cached) AS hits, count(*) - count(cached) AS misses, round(100.0 * count(cached) / count(*), 6) AS rate FROM j""")
def cache_stats(spark, d):
    return C.stats(C.lookup(vf(spark, d), _old(spark, d)))


@query(f"WITH {VF} SELECT dir AS path, arg_max(id, id) AS seq, arg_max(size, id) AS size FROM vf GROUP BY dir")
def journal_last_writer(spark, d):
    return C.replay(vf(spark, d).select(F.col("dir").alias("path"), F.col("id").alias("seq"), "size"))


@query(f"WITH {MEMBERS} SELECT DISTINCT path, id % 2 = 0 AS is_video FROM m WHERE id % 3 != 2")
def thumb_targets(spark, d):
    return members(spark, d).filter("id % 3 != 2").select("path", (F.col("id") % 2 == 0).alias("is_video")).dropDuplicates(["path"])


@query(f"WITH {VF} SELECT id, sha1(path || '|' || size || '|' || mod_unix || '|240') AS thumb FROM vf")
def thumb_key(spark, d):
    return vf(spark, d).select("id", S.thumb_key(F.col("path"), F.col("size"), F.col("mod_unix")).alias("thumb"))


@query(f"""WITH {DUR} SELECT id, unnest(list_transform(range(0, CASE WHEN duration <= 0 THEN 0 WHEN duration < 10 THEN 3 ELSE 8 END),
 lambda i: round(duration * (0.08 + 0.84 * i / (CASE WHEN duration < 10 THEN 2 ELSE 7 END)), 4))) AS at FROM d""")
def video_timestamps(spark, d):
    return durations(spark, d).select("id", F.explode(S.video_timestamps(F.col("duration"))).alias("at")).select("id", F.round("at", 4).alias("at"))


@query(f"""WITH {DUR} SELECT id, round(CASE WHEN duration <= 0 THEN 1 ELSE least(duration * 0.2, 60) END, 4) AS poster FROM d""")
def poster_times(spark, d):
    return durations(spark, d).select("id", F.round(S.poster_time(F.col("duration")), 4).alias("poster"))
