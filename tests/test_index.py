from pyspark.sql import functions as F

from lexloom.operators import index
from lexloom.sources import chunks, pages

PAGE = "doc_id long, url string, service string, host string, body array<string>, head array<string>, title array<string>, links array<struct<url:string,anchor:array<string>>>"


def parsed(spark, *rows):
    return spark.createDataFrame([(k, u, "http", "a.com", b, h, t, x) for k, (u, b, h, t, x) in enumerate(rows)], PAGE)


def two(spark):
    return parsed(spark, ("u0", ["a", "b", "a"], [], [], []), ("u1", ["b", "c"], [], [], []))


def test_hand_worked_index(spark):
    got = {r["key"]: r for r in index.postings(index.occurrences(two(spark))).collect()}
    want = {
        "a": ("b", [0, 2], 2, 1, 1, [(0, 1), (1, 3)]), "b": ("b", [1, 4], 2, 2, 2, [(0, 2), (1, 6)]), "c": ("b", [6], 1, 2, 1, [(0, 7)]),
        "%": ("e", [3, 4], 2, 2, 2, [(0, 4), (1, 8)]), "##u0": ("u", [4], 1, 1, 1, [(0, 5)]), "##u1": ("u", [8], 1, 2, 1, [(0, 9)]),
    }
    assert {k: (r["type"], r["deltas"], r["use_count"], r["reference_doc_count"], r["doc_count"], [tuple(x) for x in r["seek"]]) for k, r in got.items()} == want


def test_links_and_order(spark):
    links = [("http://a.com/y", ["X"]), ("https://a.com/y", []), ("http://b.com/", []), ("http://a.com.evil/", [])]
    rows = index.tokens(parsed(spark, ("http://a.com/x", ["É", "B"], ["H"], ["T"], links))).orderBy("offset").collect()
    assert [(r["key"], r["type"]) for r in rows] == [
        ("É", "b"), ("b", "b"), ("<h", "b"), ("@t", "t"), ("$x", "a"), ("#1http://a.com/y", "u"), ("#0https://a.com/y", "u"), ("#0http://b.com/", "u"),
        ("#1http://a.com.evil/", "u"), ("%", "e"), ("##http://a.com/x", "u"),
    ]


def test_key_collision_takes_first_type(spark):
    got = {r["key"]: (r["type"], r["use_count"]) for r in index.posting_stats(index.occurrences(parsed(spark, ("u", ["%"], [], [], [])))).collect()}
    assert got["%"] == ("b", 2)


def seek_model(positions):
    out, k = [], 0
    for i, p in enumerate(positions):
        if p + 1 >= 1 << k:
            out.append((i, p + 1))
            k += 1
    return out


def test_seek_rows_match_the_loop(spark):
    import random

    r = random.Random(3)
    lists = [sorted(r.sample(range(5000), r.randint(1, 60))) for _ in range(60)]
    occ = spark.createDataFrame([(0, str(k), p) for k, x in enumerate(lists) for p in x], "chunk_id long, key string, pos long")
    got = {}
    for row in index.seek_rows(occ).collect():
        got.setdefault(int(row["key"]), []).append((row["index"], row["location"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: seek_model(x) for k, x in enumerate(lists)}


def test_chunks_rotate_when_both_limits_are_passed(spark):
    lengths = [5, 1, 1, 9, 2, 8, 8, 1, 1, 1]
    got = index.assign_chunks(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long"), 2, 10).orderBy("doc_id").collect()
    chunk, docs, total, want = 0, 0, 0, []
    for n in lengths:
        want.append((chunk, docs, total))
        docs, total = docs + 1, total + n
        if docs > 2 and total > 10:
            chunk, docs, total = chunk + 1, 0, 0
    assert [(r["chunk_id"], r["doc_seq"], r["start"]) for r in got] == want and chunk > 0


def fold(lengths, max_docs, max_words):
    chunk, docs, total, out = 0, 0, 0, []
    for n in lengths:
        out.append((chunk, docs, total))
        docs, total = docs + 1, total + n
        if docs > max_docs and total > max_words:
            chunk, docs, total = chunk + 1, 0, 0
    return out


def test_chunks_equal_the_fold_at_all_limits(spark):
    import random

    r = random.Random(2)
    for max_docs, max_words in ((0, 0), (1, 30), (5, 5), (20, 0), (3, 200), (400, 10)):
        lengths = [r.choice([0, 0, 2, 2, 5, 40]) for _ in range(300)]
        rows = list(zip(range(-50, 250), lengths))
        r.shuffle(rows)
        got = index.assign_chunks(spark.createDataFrame(rows, "doc_id long, n_tokens long"), max_docs, max_words).orderBy("doc_id").collect()
        want = fold([n for _, n in sorted(rows)], max_docs, max_words)
        assert [(x["chunk_id"], x["doc_seq"], x["start"]) for x in got] == want, (max_docs, max_words)


def test_repeated_and_null_ids_are_documents_of_their_own(spark):
    rows = [(1, "a b"), (1, "c"), (None, "z"), (2, "d d"), (2, "d d"), (2, "d d"), (None, "z"), (3, None)]
    p = pages.parse_text(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("url", F.coalesce("url", F.lit("none")))
    for limits in ({}, {"max_docs": 2, "max_words": 3}):
        occ = index.occurrences(p, **limits).collect()
        n = sum(len((t or "").split()) + 2 for _, t in rows)
        assert len(occ) == n and len({(x["chunk_id"], x["pos"]) for x in occ}) == n
        assert len({(x["chunk_id"], x["doc_seq"]) for x in occ}) == len(rows) == index.documents(p, **limits).count()
    first = [x["key"] for x in sorted(occ, key=lambda x: (x["chunk_id"], x["pos"]))][:6]
    assert first == ["z", "%", "##none"] * 2  # null before all


def test_no_task_reads_all_texts(spark, sf):
    docs = pages.parse_text(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = index.postings(index.occurrences(docs, max_docs=20, max_words=8000))._jdf.queryExecution().toString()
    assert "Coalesce 1" not in plan and "SinglePartition" not in plan.split("== Physical Plan ==")[1].split("BroadcastExchange")[0]
    assert plan.split("== Physical Plan ==")[1].count("Generate explode") + plan.split("== Physical Plan ==")[1].count("Generate posexplode") == 1


def test_bits_and_bytes(spark):
    n = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4, 7, 8, 127, 128, 2047, 2048)], "n long")
    got = n.select(index.bits_needed(F.col("n")), index.delta_bytes(F.col("n"))).collect()
    assert [r[0] for r in got] == [1, 1, 2, 2, 3, 3, 4, 7, 8, 11, 12] and [r[1] for r in got] == [1] * 8 + [2, 2, 3]


def test_lookups_and_store(spark, tmp_path):
    p = two(spark)
    folder = f"file://{tmp_path}/index"
    assert chunks.write_index(p, folder) == 0 and chunks.write_index(p, folder) == 1
    posts, docs = chunks.read_index(spark, folder)
    assert sorted(r["chunk_id"] for r in index.find(posts, "b").collect()) == [0, 1]
    assert index.get_document(docs, 1, 0).first()["url"] == "u1"
    assert index.find_url(posts, "u1").count() == 2 and index.find(posts, "zzz").count() == 0


def test_an_interrupted_append_leaves_nothing(spark, tmp_path, monkeypatch):
    import pytest

    p, folder = two(spark), f"file://{tmp_path}/index"
    assert chunks.write_index(p, folder) == 0

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:  # after the documents, before the postings
        m.setattr(index, "postings", dies)
        with pytest.raises(RuntimeError):
            chunks.write_index(p, folder)
    with monkeypatch.context() as m:  # before publishing
        m.setattr(chunks, "_publish", dies)
        with pytest.raises(RuntimeError):
            chunks.write_index(p, folder)
    posts, docs = chunks.read_index(spark, folder)
    assert docs.count() == 2 and {r["chunk_id"] for r in posts.collect()} == {0}
    assert chunks.write_index(p, folder) == 1 and chunks.read_index(spark, folder)[1].count() == 4


def test_two_writers_do_not_share_a_chunk(spark, tmp_path, monkeypatch):
    p, folder, publish = two(spark), f"file://{tmp_path}/index", chunks._publish

    def late(spark_, staged, target):  # another writer takes the number first
        monkeypatch.setattr(chunks, "_publish", publish)
        assert chunks.write_index(p, folder) == 0
        return publish(spark_, staged, target)

    monkeypatch.setattr(chunks, "_publish", late)
    assert chunks.write_index(p, folder) == 1
    posts, docs = chunks.read_index(spark, folder)
    assert sorted((r["chunk_id"], r["doc_seq"]) for r in docs.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert chunks.chunk_path(folder, 1, spark).endswith("first=1/table=postings/chunk=0")
    assert chunks.write_index(p.limit(0), folder) == 2 and chunks.next_chunk(spark, folder) == 2


def test_stored_lookups_filter_in_the_scan(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    chunks.write_index(two(spark), folder)
    plan = index.find(chunks.read_index(spark, folder)[0], "b")._jdf.queryExecution().toString()
    assert "EqualTo(key,b)" in plan


def test_url_lists(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("http://a/\n\n  http://b/x?y \n")
    assert [r["url"] for r in pages.read_urls(spark, f"file://{tmp_path}/urls.txt").collect()] == ["http://a/", "http://b/x?y"]


def test_document_of_position(spark):
    occ = index.occurrences(two(spark))
    got = {r["pos"]: r["doc_seq"] for r in index.document_of(occ, occ).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1, 8: None}


def test_every_position_of_the_table_has_its_document(spark, sf):
    import __spark_entry__ as entry

    got = {(r["chunk_id"], r["pos"]): r["doc_seq"] for r in entry.queries()["position_documents"](spark, sf).collect()}
    ends = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ends.append((ends[-1] + 2 if ends else 0) + len((r["text"] or "").encode().split()))
    want, k = {}, 0
    for pos in range(ends[-1] + 2):
        k += k < len(ends) and pos > ends[k]
        want[0, pos] = k if k < len(ends) else None
    assert got == want and len(want) > 10 * len(ends)


def test_every_position_has_its_document_in_many_chunks(spark):
    rows = [(f"u{k}", ["a"] * (k * 7 % 5), [], [], []) for k in range(23)]
    occ = index.occurrences(parsed(spark, *rows), max_docs=3, max_words=10)
    got = {(r["chunk_id"], r["pos"]): r["doc_seq"] for r in index.document_of(occ, occ).collect()}
    own = {(r["chunk_id"], r["pos"]): (r["type"], r["doc_seq"]) for r in occ.collect()}
    last = {c: max(p for x, p in own if x == c) for c, _ in own}
    want = {(c, p): (None if p == last[c] else seq + 1) if kind == "u" else seq for (c, p), (kind, seq) in own.items()}
    assert got == want and len(last) > 3


def test_html(spark):
    html = '<html><head><title>A &amp; B</title><script>x<y</script></head><body><!-- no --><h1>Big Word</h1><p>t&lt;x</p><a class="k" href="/q">go <b>now</b></a></body></html>'
    df = spark.createDataFrame([(1, "https://h.org/p?x", html), (2, None, None)], "page_id long, url string, html string")
    one, none = pages.parse_html(df, resolve=True).orderBy("doc_id").collect()
    assert (one["title"], one["head"], one["body"], one["service"], one["host"]) == (["A", "&", "B"], ["Big", "Word"], ["Big", "Word", "t<x", "go", "now"], "https", "h.org")
    assert [(x["url"], x["anchor"]) for x in one["links"]] == [("https://h.org/q", ["go", "now"])]
    assert none["body"] == [] and none["links"] == [] and none["url"] == ""


def test_empty_tables(spark):
    none = parsed(spark).limit(0)
    assert index.postings(index.occurrences(none)).count() == 0 and index.documents(none).count() == 0


def test_posts(spark):
    values = [0, 1, 127, 128, 2047, 2048, 65535, 65536, (1 << 21) - 1, 1 << 21, (1 << 26) - 1, 1 << 26, (1 << 31) - 1]
    df = spark.createDataFrame([(x,) for x in values], "n long").withColumn("code", index.post_code(F.col("n")))
    got = df.select("n", "code", index.post_length(F.col("code")), index.post_delta(F.col("code")), index.post_bits(F.col("code"))).collect()
    for n, code, size, back, bits in got:
        code = bytes(code)
        assert back == n and size == len(code) and bits == " ".join(f"{b:08b}" for b in code)
        if n < 0x110000 and not 0xD800 <= n < 0xE000:
            assert code == chr(n).encode()
    assert [len(bytes(r[1])) for r in got] == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6]
