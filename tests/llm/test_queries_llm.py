import base64
import collections
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from lexloom.llm import lm, media, quality
from lexloom.llm.queries import ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    from test_queries import agree

    agree(entry.queries()[name](spark, sf), ORACLE_SQL[name], sf)


def texts(sf):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())


def rows(spark, sf, name):
    out = entry.queries()[name](spark, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts(sf))
    return out


def test_op3(spark, sf):
    """Every column from the bytes alone; shots from the decoder that reads the tables in the frames."""
    docs = texts(sf)
    for r in rows(spark, sf, "op3_media"):
        raw = (docs[r["doc_id"]] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        avi = media.encode_avi(payload)
        hist = media.histograms(media.decode_images(media.frames(avi)))
        level = hist @ (np.arange(32) * 8 + 4.0)
        feature = ";".join(f"{a}-{b}@{a / 25:.2f}-{(b + 1) / 25:.2f}s:{level[a : b + 1].mean():.3f}" for a, b in media.shots(hist))
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(avi), hashlib.sha256(avi).hexdigest(), feature)
        assert tuple(r[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")) == want


def test_op5(spark, sf):
    docs, labels = texts(sf), dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    train = sorted(i for i in labels if i in docs and not held[i])
    model = quality.fit(np.array([quality.features(docs[i]) for i in train]), np.array([float(labels[i]) for i in train]))
    got = rows(spark, sf, "op5_quality")
    for r in got:
        assert r["held_out"] == held[r["doc_id"]] and r["predicted"] == int(r["score"] >= 0.5)
        assert r["score"] == pytest.approx(float(model.score(np.array([quality.features(docs[r["doc_id"]])]))[0]), rel=1e-9)
    known = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in known) / len(known) > 0.9


def test_op7(spark, sf):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = texts(sf)
    for r in rows(spark, sf, "op7_bpe"):
        t = docs[r["doc_id"]] or ""
        ids = own.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op9(spark, sf):
    """Counts and base by brute force; the score in the range that a normalised model of these tokens allows."""
    docs = {i: [w.translate(lm._CASE) for w in (t or "").encode().split()] for i, t in texts(sf).items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    count = collections.Counter(w for i, t in docs.items() if not held[i] for w in t)
    ends = sum(not h for h in held.values())
    n, v = sum(count.values()) + ends, len(count) + 1
    got = rows(spark, sf, "op9_lm")
    for r in got:
        t = docs[r["doc_id"]]
        each = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t) + 1, sum(w in count for w in t) + 1, n)
        assert r["base_score"] == pytest.approx(sum(each(count[w]) for w in t) + each(ends), rel=1e-9) and -15 * (len(t) + 1) < r["score"] < 0
    mean = lambda x, h: sum(r[x] for r in got if r["held_out"] == h) / sum(r["n_tokens"] for r in got if r["held_out"] == h)
    assert mean("score", True) > mean("base_score", True) and mean("score", False) > mean("base_score", False)


def test_pipeline_edges(spark, sf):
    """An empty table stays empty; nulls, repeated ids and empty texts pass."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(1, None, "en", None, 0), (2, "", None, "s", 0), (None, "no id here", "en", "s", 10), (None, "no id here", "en", "s", 10), (3, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13), (3, "q r s t u v w", "en", "s", 13)]
    some = spark.createDataFrame(odd, docs.schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), sf).count() == 0
        out = stage(spark, some, sf).collect()
        assert k in (0, 3) or {r["doc_id"] for r in out} == {1, 2, 3, None}
        if k == 2:
            assert sorted(str(r["doc_id"]) for r in out) == ["1", "2", "3", "None", "None"]


def test_pipeline(spark, sf, tmp_path):
    """Each stage on its own input: what it may drop or change, and that the rest stays."""
    docs, rows = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        assert {r["doc_id"] for r in rows} <= set(before)
        if k == 0:
            quality = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
            assert all(quality.get(r["doc_id"], 1) for r in rows) and all(not quality.get(i, 0) for i in set(before) - {r["doc_id"] for r in rows})
        if k == 1:
            assert all(set(r["text"].split("\n")) <= set(before[r["doc_id"]]["text"].split("\n")) and r["n_chars"] == len(r["text"]) for r in rows)
        if k == 2:
            from test_small import brute_minhash

            low = brute_minhash([(i, r["text"]) for i, r in before.items()], 80)[1]
            assert {r["doc_id"] for r in rows} == {i for i in low if low[i] == i}
        if k == 3:
            assert max(sum(r["doc_id"] == i for r in rows) for i in before) <= 3
        if k == 4:
            assert len(rows) == n_mixed and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
        n_mixed = len(rows)
    assert corpus_pipeline.run(spark, sf).count() == len(rows)
