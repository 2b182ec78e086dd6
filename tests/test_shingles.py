"""Signatures and similarity against a literal model with signed bytes."""

import random

from pyspark.sql import functions as F

from lexloom.operators import shingles as S
from lexloom.streaming import dedup

M = 2**64


def fnv(data):
    h = S.FNV_START
    for b in data:
        h = h * S.FNV_PRIME % M ^ (b if b < 128 else M - 256 + b)
    return h % (M - 1)


def model(words):
    if not words:
        hashes = [0]
    elif len(words) < 8:
        hashes = [fnv("".join(words).encode())]
    else:
        hashes = [fnv("".join(words[k : k + 8]).encode()) for k in range(len(words) - 7)]
    sig = []
    for a, b in zip(S.A, S.B):
        now = -1  # a signed byte; compared as an unsigned 64-bit number
        for h in hashes:
            v = (a * h + b) % M % 255
            if v < now % M:
                now = v - 256 if v > 127 else v
        sig.append(now % 256)
    return hashes, sig


GOLDEN = {
    (): "81,149,217,30,98,166,234,47,114,166,233,30,97,149,216,13",
    ("hello", "world"): "37,23,9,250,236,222,208,194,203,47,55,144,251,139,76,51",
    tuple("abcdefgh"): "61,131,201,16,86,156,225,40,206,31,7,98,5,20,230,246",
    tuple("abcdefghi"): "61,229,127,16,86,77,230,40,173,31,7,98,5,20,67,177",
    ("é",): "94,228,107,240,119,253,132,11,191,37,156,63,134,22,46,215",
}


def lists():
    r = random.Random(5)
    return [*map(list, GOLDEN), *[[r.choice(["ab", "c", "é", "日本", "word"]) + str(r.randint(0, 9)) for _ in range(r.randint(0, 40))] for _ in range(60)], None]


def signed(spark):
    rows = [(k, w) for k, w in enumerate(lists())]
    return S.add_signatures(spark.createDataFrame(rows, "doc_id long, w array<string>"), text_col=None, words_col="w")


def test_signatures(spark):
    got = {r["id"]: r["sig"] for r in signed(spark).collect()}
    assert got == {k: model(w or [])[1] for k, w in enumerate(lists())}
    assert [",".join(map(str, got[k])) for k in range(len(GOLDEN))] == list(GOLDEN.values())


def test_hashes_and_bands(spark):
    df = spark.createDataFrame([(w or [],) for w in lists()], "w array<string>")
    for r in df.select("w", S.shingles(F.col("w")).alias("h")).collect():
        assert [int(x) for x in r["h"]] == model(r["w"])[0]
    b = spark.createDataFrame([(model(["hello", "world"])[1],)], "sig array<smallint>").select(S.band_hashes(F.col("sig")), F.size(S.full_signature(F.col("sig")))).first()
    assert b[0][0] == "13720393479122624849" and b[1] == 64
    assert fnv(b"abc") == 10226266973068181600 and fnv(b"") == 146959810393466560


def near(a, b):
    return sum(x == y for x, y in zip(a, b)) >= 15


def variants():
    r = random.Random(9)
    sigs = [[r.randint(0, 254) for _ in range(16)] for _ in range(12)]
    for s in list(sigs):
        for _ in range(4):
            t = list(s)
            for _ in range(r.randint(0, 2)):
                t[r.randrange(16)] = r.randint(0, 254)
            sigs.append(t)
    r.shuffle(sigs)
    return sigs


def test_pairs_semi_and_greedy(spark):
    sigs = variants()
    df = spark.createDataFrame([(k, 9, s) for k, s in enumerate(sigs)], "id long, n_words int, sig array<smallint>")
    got = sorted((r[0], r[1]) for r in S.similar_within(df).collect())
    assert got == [(a, b) for a in range(len(sigs)) for b in range(a + 1, len(sigs)) if near(sigs[a], sigs[b])]
    left, right = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    hits = {r["id"] for r in S.is_similar(left, right).filter("similar").collect()}
    assert hits == {a for a in range(0, len(sigs), 2) if any(near(sigs[a], sigs[b]) for b in range(1, len(sigs), 2))}
    assert {r["id"] for r in S.novel(left, right).collect()} == set(range(0, len(sigs), 2)) - hits
    kept = []
    for k, s in enumerate(sigs):
        if not any(near(s, sigs[j]) for j in kept):
            kept.append(k)
    assert sorted(r["id"] for r in S.greedy_dedup(df).collect()) == kept


def test_links_and_classes(spark):
    sigs = variants()
    sigs += sigs[:9]
    df = spark.createDataFrame([(k, 9, s) for k, s in enumerate(sigs)] + [(900, 0, sigs[0]), (901, 0, sigs[0])], "id long, n_words int, sig array<smallint>")
    first = {}
    for k, s in enumerate(sigs):
        first.setdefault(tuple(s), k)
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in S.links(df).collect()}
    want = {k: (first[tuple(s)], sum(near(s, t) for t in sigs) - 1) for k, s in enumerate(sigs)}
    assert got == want | {900: (900, 0), 901: (901, 0)}
    pairs = sorted((r["class_a"], r["class_b"]) for r in S.similar_classes(df).collect())
    assert pairs == sorted({(min(a, b), max(a, b)) for s, a in first.items() for t, b in first.items() if a != b and near(s, t)})


def test_empty_lists_stay(spark):
    sig = model([])[1]
    df = spark.createDataFrame([(0, 0, sig), (1, 0, sig), (2, 3, sig)], "id long, n_words int, sig array<smallint>")
    assert sorted(r["id"] for r in S.greedy_dedup(df).collect()) == [0, 1]
    assert S.greedy_dedup(df.limit(0)).count() == 0
    assert [r["similar"] for r in S.is_similar(df.filter("id = 0"), df).collect()] == [False]


def test_stream_equals_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    for k, (lo, hi) in enumerate(((0, 80), (80, 140), (140, 10**9))):
        docs.filter(f"doc_id >= {lo} AND doc_id < {hi}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    schema, out = docs.schema, f"file://{tmp_path}/out"
    for k in range(3):
        q = dedup.start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/{k}"), f"{out}{k}", f"{tmp_path}/cp{k}")
        q.awaitTermination(120)
    for k in range(3):
        dedup.dedup_batch(spark.read.parquet(f"{tmp_path}/in/{k}"), out, k)
    dedup.dedup_batch(spark.read.parquet(f"{tmp_path}/in/2"), out, 2)  # run again
    whole = sorted(r["id"] for r in S.greedy_dedup(S.add_signatures(docs)).collect())
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == whole and len(whole) == 152
