"""The registered queries and the whole pipeline on a small table, against plain Python."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kinfold.llm import queries as Q

SECRET = "password = Zx9Qw3Er7Ty1Ui5O"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(6)
    words = {"en": ["the", "house", "green", "water", "light", "under"], "de": ["der", "grün", "wasser", "licht", "unter", "straße"]}
    rows = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "er", "ing"]) for _ in range(rng.randint(8, 60))), lang))
    rows += [(100, rows[4][1], "en"), (101, rows[4][1], "en")]  # exact copies: the largest stays
    long = " ".join(f"{rng.choice(words['en'])}{i}" for i in range(120))
    rows += [(110, long, "en"), (111, long + " tail", "en"), (112, long + " other", "en")]  # near copies: the smallest stays
    rows += [(120, None, "en"), (121, "", None), (122, "½ 12 !!", "en"), (123, f"the light house {SECRET} under the water", "en"), (124, "the light house <|endoftext|> here", "en")]
    out = tmp_path_factory.mktemp("tables")
    ids, texts, langs = zip(*rows, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts), "lang": pa.array(langs), "source": [f"s{i}" for i in ids], "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), out / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(ids[:60], pa.int64()), "quality": pa.array([1] * 60, pa.int32()), "toxic": pa.array([i % 2 for i in range(60)], pa.int32())}), out / "labels.parquet")
    return str(out), rows


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_sharding(spark, folder):
    d, rows = folder
    out = {r.doc_id: r for r in Q.op1_sharding(spark, d).collect()}
    for i, t, _ in rows:
        raw = (t or "").encode()
        assert (out[i]["size"], out[i].text_crc32, out[i].law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert out[i].grown_shard in (out[i]["shard"], 16) and 0 <= out[i]["shard"] < 16
    for s in range(16):
        assert sorted(r.slot for r in out.values() if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out.values())))


def test_tokens(spark, folder):
    d, rows = folder
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in Q.op2_packing(spark, d).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    import numpy as np
    import tiktoken

    from kinfold.llm.bpe import read_ranks

    multi = tiktoken.Encoding("m", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    coded = {r.doc_id: r for r in Q.op5_bpe(spark, d).collect()}
    for i, t, _ in rows:
        ids, at = [*own.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
        want = multi.encode_ordinary(t or "")
        assert (coded[i].n_tokens, coded[i].ids_sha256, coded[i].decoded_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_languages_and_toxicity(spark, folder):
    d, rows = folder
    lang = {r.doc_id: r for r in Q.op3_langid(spark, d).collect()}
    toxic = {r.doc_id: r for r in Q.op10_toxicity(spark, d).collect()}
    for i, t, own in rows:
        assert lang[i].held_out == toxic[i].held_out == (crc(i, 4) == 2)
        assert lang[i].lang_pred == ("und" if i in (120, 121, 122) else own) and 0 <= lang[i].score <= 1
        assert 0 <= toxic[i].score <= 1 and toxic[i].predicted == int(toxic[i].score >= 0.3)


def test_secrets(spark, folder):
    d, rows = folder
    out = {r.doc_id: r for r in Q.op7_secrets(spark, d).collect()}
    assert (out[123].n_assign, out[123].n_access, out[123].n_hex) == (1, 0, 0)
    start = rows[-2][1].index("password")
    said = f"assign:{start}:{start + len(SECRET)}"
    assert out[123].base_sha256 == hashlib.sha256(said.encode()).hexdigest() and out[123].spans == said
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for i, r in out.items() if i != 123)


def test_pipeline(spark, folder):
    d, rows = folder
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {i: t for i, t, _ in rows if t and re.search(r"[^\W\d_]", t) and i != 122}
    largest = {}
    for i, t in texts.items():
        largest[t] = max(i, largest.get(t, -1))
    texts = {i: t for t, i in largest.items()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.lower().split()]}
    go = {max(a, b) for a in texts for b in texts if a < b and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])}
    assert go == {111, 112}
    want = {i: len(own.encode(t.replace(SECRET, "[assign]"), add_special_tokens=False).ids) + 1 for i, t in texts.items() if i not in go}
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == want and sum(r.length for r in got) == sum(want.values())
