"""Cases of the second round's findings."""


import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_queries import agree

import __spark_entry__ as entry
from lexloom.functions import text
from lexloom.operators import index, shingles, wholes
from lexloom.sources import chunks, pages


def test_code_points_of_empty_and_null_texts(spark, tmp_path):
    rows = [(1, "éa\r\n\0b"), (2, ""), (3, None), (4, "👩‍👧🇩🇪\U0010ffff﻿� \x85 ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    spark.read.parquet(f"{tmp_path}/documents").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    df = entry.queries()["code_points"](spark, str(tmp_path))
    assert ("", -1) in {tuple(r) for r in df.collect()}
    agree(df, entry.oracle_sql()["code_points"], str(tmp_path))


def signed(spark, n=300):
    rows = [(k, 9, [(k // 3 * 7 + j) % 255 for j in range(15)] + [k % 3]) for k in range(n)]
    return spark.createDataFrame(rows, "id long, n_words int, sig array<smallint>")


def test_similarity_broadcasts_no_signatures(spark, monkeypatch):
    monkeypatch.setattr(shingles, "BROADCAST", 10)
    df = signed(spark)
    for out in (shingles.greedy_dedup(df), shingles.links(df), shingles.similar_classes(df), shingles.is_similar(df, df), shingles.similar_signatures(df.select("sig"), df.select("sig"))):
        assert "BroadcastExchange" not in out._jdf.queryExecution().toString()
    assert sorted(r["id"] for r in shingles.greedy_dedup(df).collect()) == list(range(0, 300, 3))


def test_signatures_make_no_objects_of_words():
    texts = pa.array(["".join(f"w{k % 97 + j} " for j in range(500)) for k in range(2000)])
    lists = pa.array([t.split() for t in texts.to_pylist()])
    tracemalloc.start()
    try:
        by_lists = shingles._signatures(lists)
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
        assert shingles._signatures(texts).equals(by_lists)
        shingles._shingles(texts)
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()


def test_words_of_texts_are_those_of_lists():
    texts = [" a b\tc  ", "", None, "   ", "é日本 x\x0b\x0cy", "1 2 3 4 5 6 7 8", "one", " one two three four five six seven eight nine ten\n"]
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for k, n in ((0, 8), (1, 5), (7, 1), (0, 0)):
        a, b = pa.array(texts, pa.string()).slice(k, n), pa.array(lists, pa.list_(pa.string())).slice(k, n)
        assert shingles._counted_signatures(a).to_pylist() == shingles._counted_signatures(b).to_pylist()
        assert [x["n_words"] for x in shingles._counted_signatures(a).to_pylist()] == [len(x) for x in lists[k : k + n]]
        assert shingles._shingles(a).equals(shingles._shingles(b))


def places_of(spark, n=120):
    rows = [(k, " ".join(f"{'W' if j % 3 else 'É'}{(k * j) % 11}" for j in range(k * 7 % 23))) for k in range(n)]
    return pages.parse_text(spark.createDataFrame(rows, "doc_id long, text string"))


WHOLES = {
    "posting_stats": index.posting_stats, "postings": index.postings, "seek_rows": index.seek_rows, "deltas": index.deltas, "document_of": lambda occ: index.document_of(occ, occ),
}


@pytest.mark.parametrize("name", WHOLES)
def test_whole_chunks_move_no_tokens(spark, monkeypatch, name):
    f, p = WHOLES[name], places_of(spark)
    for limits in ({"max_docs": 3, "max_words": 20},):
        monkeypatch.setattr(wholes, "WHOLE", 10**6)
        df = f(index.occurrences(p, **limits))
        above = df._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
        assert "MapInArrow" in above and "Window" not in above and "Aggregate" not in above and "Repartition" not in above
        got = sorted(map(repr, df.collect()))
        monkeypatch.setattr(wholes, "WHOLE", 0)
        assert got == sorted(map(repr, f(index.occurrences(p, **limits)).select(*df.columns).collect())) and got


def test_lots_hold_whole_chunks(monkeypatch):
    monkeypatch.setattr(wholes, "LOT", 5)
    ids = [1, 1, 1, 2, 2, 7, 7, 7, 7, 7, 7, 7, 9, 10, 11, 12, 13, 14, 14]
    for size in (1, 2, 3, 7, 50):
        batches = [pa.RecordBatch.from_pydict({"chunk_id": ids[k : k + size]}) for k in range(0, len(ids), size)]
        got = [t["chunk_id"].to_pylist() for t in wholes.lots(iter(batches))]
        assert sum(got, []) == ids and not any(set(a) & set(b) for a, b in zip(got, got[1:]))


def test_ascii_lower_leaves_other_letters(spark):
    texts = ["ABC xyz", "É A", "\u212a İ", "", None, "Straße ΑΒ Z", "abc"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.ascii_lower(F.col("t"))).collect()
    assert [r[0] for r in got] == ["abc xyz", "É a", "\u212a İ", "", None, "straße ΑΒ z", "abc"]


def test_stored_chunks_have_one_file_each(spark, tmp_path):
    p, folder = places_of(spark).repartition(7), f"{tmp_path}/index"
    chunks.write_index(p, folder, max_docs=3, max_words=20)
    for name in ("documents", "postings"):
        folders = [*tmp_path.glob(f"index/first=0/table={name}/chunk=*")]
        assert len(folders) > 5 and all(len([*x.glob("*.parquet")]) == 1 for x in folders)
    got, docs = chunks.read_index(spark, folder)
    want = index.postings(index.occurrences(p, max_docs=3, max_words=20))
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and docs.count() == 120


ODD = [
    (5, "One  TWO\tone É"), (None, "no id"), (3, None), (3, ""), (3, ""), (9, "% ##doc://9 %"), (7, " \n"), (8, "x" * 3000 + " Z"), (9, "tWo"), (4, "a a a b"), (2, "É é  \x0b q"),
]


def test_texts_move_whole_and_are_split_in_their_chunks(spark, monkeypatch):
    df = spark.createDataFrame(ODD, "doc_id long, text string").coalesce(1)
    occ = index.text_occurrences(df, max_docs=2, max_words=4)
    for f in [*WHOLES.values(), index.postings_as_text]:
        monkeypatch.setattr(wholes, "WHOLE", 10**6)
        found = f(occ)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan and "split(" not in plan
        got = sorted(map(repr, found.collect()))
        monkeypatch.setattr(wholes, "WHOLE", 0)
        assert got == sorted(map(repr, f(occ).select(*found.columns).collect())) and got


def test_top_terms_of_texts_moves_no_word_lists(spark, sf):
    plan = entry.queries()["top_terms"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "split(" not in plan


@pytest.mark.parametrize("longest", [0, 40, 40_000])
def test_hash_ranges_of_all_lengths(longest):
    rng = np.random.default_rng(7)
    data = rng.integers(0, 256, 60_000).astype(np.uint8)
    start = rng.integers(0, 20_000, 30)
    end = start + np.append(rng.integers(0, longest + 1, 27), [0, longest, longest])
    start[-1], end[-1] = len(data) - longest, len(data)
    want = []
    for a, z in zip(start.tolist(), end.tolist()):
        h = shingles.FNV_START
        for b in data[a:z].tolist():
            h = h * shingles.FNV_PRIME % 2**64 ^ (b if b < 128 else b + 2**64 - 256)
        want.append(h % (2**64 - 1))
    kept = start.copy()
    assert shingles.hash_ranges(data, start, end).tolist() == want and (start == kept).all()


def test_novel_signs_texts_once_before_its_join(spark, sf):
    plan = entry.queries()["novel_anti"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "sig#" in plan and "text#" not in plan


def test_signing_holds_a_slice_whatever_the_rows():
    peaks = []
    for n in (1000, 8000):
        lists = pa.array([[f"w{(k + j) % 997}" for j in range(60)] for k in range(n)])
        tracemalloc.start()
        try:
            assert len(shingles._signatures(lists)) == n
            peaks.append(tracemalloc.get_traced_memory()[1])
        finally:
            tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0]
