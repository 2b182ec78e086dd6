"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from lexloom.llm import bpe, chat, components, embeddings, lines, lm, media, minhash, mixing, quality, warc
from lexloom.session import new_folder

DOC = "doc_id long, text string, source string, size string, score string"


def words(t):
    return (t or "").encode().split()


def groups(nodes, links):
    low = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    vocabulary = ["der", "the", "Ärger", "x1", "don't", "日本", "🙂", "AbC", "...", "it's"]
    rows = [" ".join(r.choice(vocabulary) + str(r.randint(0, 40)) for _ in range(r.choice([1, 3, 4, 5, 6, 30, 60]))) for _ in range(80)]
    return [*rows, *rows[:5], "", None, "   \n\t", "a" * 30_000, "one two", "\n".join(["line here"] * 500)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, [None, "s1", "s2", "s3"][k % 4], "clash", None) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id at all", "s1", "clash", None), rows[3]], DOC)


# mixing


def test_mixing(spark, docs):
    rows = mixing.mix_report(docs).collect()
    total, size, taken, target = 0, {}, {}, {}
    for r in rows:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        total += r["size"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(r["source_size"] == size[r["source"]] for r in rows) and len(rows) == docs.count()
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, level = {s: k % 3 + 1 for k, s in enumerate(order)}, 0.0
    for _ in range(10):
        capped = [s for s in order if weight[s] * level >= 3 * size[s]]
        free = sum(weight[s] for s in order if s not in capped)
        level = (total - sum(3 * size[s] for s in capped)) / free if free else level
    assert target == pytest.approx({s: min(weight[s] * level, 3 * size[s]) for s in order})
    most = max(r["size"] for r in rows)
    assert all(abs(taken[s] - target[s]) <= most for s in order)
    again = {(r["id"], r["taken"]) for r in mixing.mix_report(docs).collect()}
    assert again == {(r["id"], r["taken"]) for r in rows}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = {}
    for r in rows:
        copies[r["id"]] = copies.get(r["id"], 0) + r["copies"]
    got = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {i: n for i, n in copies.items() if n} and sum(got.values()) > 0
    assert mixing.mix_report(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


# embeddings


def test_embeddings(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((300, 24))
    for k in range(0, 120, 3):  # near, at both sides of the threshold
        x[k + 1] = x[k] + r.standard_normal(24) * 0.2 * np.linalg.norm(x[k]) / 24**0.5
        x[k + 2] = x[k] + r.standard_normal(24) * 0.34 * np.linalg.norm(x[k]) / 24**0.5
    x[200:260] = x[200] + 0.05 * r.standard_normal((60, 24))
    x[261] = x[260]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    bad = [None, [], [0.0] * 24, [1.0, None] * 12, [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + k, v, 0) for k, v in enumerate(bad)] + [(None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    want = {k: int(linked[k].sum()) for k in range(300)} | {1000 + k: 0 for k in range(6)} | {1006: 1, 1007: 1, None: 0}
    low = groups(range(300), list(zip(*np.nonzero(linked)))) | {1000 + k: 1000 + k for k in range(7)} | {1007: 1006, None: None}
    got = embeddings.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r["vec_id"]: r["n_links"] for r in got} == want
    assert {r["vec_id"]: r["component_id"] for r in got} == low
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_with_planted_links(spark):
    """The table's own vectors with planted neighbours on both sides of the threshold, against all cosines."""
    r = np.random.default_rng(7)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([v["embedding"] for v in rows], np.float64)
    unit, _ = embeddings.unit_rows(x[:600])
    g = r.standard_normal(unit.shape)
    g, _ = embeddings.unit_rows(g - (g * unit).sum(1, keepdims=True) * unit)
    c = np.repeat([0.94, 0.949, 0.9505, 0.952, 0.97, 0.999], 100)[:, None]
    x = np.concatenate([x, c * unit + (1 - c**2) ** 0.5 * g, unit[:50] * 3])
    unit, _ = embeddings.unit_rows(x)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    got = {v["vec_id"]: v["n_links"] for v in embeddings.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert got == {k: int(n) for k, n in enumerate(linked.sum(1))} and linked.sum() > 700


def test_filters_recall():
    r = np.random.default_rng(5)
    x = r.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = r.standard_normal(x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    y = 0.951 * x + (1 - 0.951**2) ** 0.5 * g / np.linalg.norm(g, axis=1, keepdims=True)
    found = np.zeros(len(x), bool)
    for c in range(embeddings.CODES):
        a, b = (embeddings.list_decode(v, embeddings.code_words(10_000), c) for v in (x, y))
        found |= (a[:, :, None] == b[:, None, :]).any((1, 2))
    assert found.mean() > 0.999


@pytest.mark.parametrize("vectors", [10**4, 10**6, 10**8])
def test_filters_recall_is_alike_at_every_size(vectors):
    r, words = np.random.default_rng(6), embeddings.code_words(vectors)
    n, codes = 150 if vectors > 10**6 else 1000, embeddings.n_codes(64, words, 0.95)
    x, _ = embeddings.unit_rows(r.standard_normal((n, 64)))
    g = r.standard_normal(x.shape)
    g, _ = embeddings.unit_rows(g - (g * x).sum(1, keepdims=True) * x)
    y, missed = 0.95 * x + (1 - 0.95**2) ** 0.5 * g, []
    for c in range(codes):
        a, b = (embeddings.list_decode(v, words, c) for v in (x, y))
        missed.append([not set(p) & set(q) for p, q in zip(a.tolist(), b.tolist())])
    assert np.mean(missed) ** codes < 3e-5 and not np.all(missed, axis=0).any()
    lists = [len(set(p)) for p in a.tolist()]  # the cap decides, no count
    assert min(lists) < embeddings.LIST < max(lists)


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 200), (200, 300), (7, 7), (400, 300), (100, 200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in (100, 200, 300, 400)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# media


def test_media(spark, docs):
    out = media.read_media(media.to_media(docs.withColumn("payload", F.lit("clash")))).collect()
    assert len(out) == docs.count() and {"clash"} == {r["size"] for r in out}
    for r in out:
        raw = (r["text"] or "").encode()
        assert r["payload"] == media.pad(raw) and len(r["payload"]) % 64 == 0 and len(r["payload"]) > 0
        last = -1
        for k, c in enumerate(r["clips"]):
            assert c["clip"] == k and c["first_frame"] == last + 1
            last = c["last_frame"]
        assert last + 1 == len(media.frames(r["media"])) == -(-len(r["payload"]) // 1024)
    assert media.clips(media.to_media(docs)).filter("doc_id IS NULL").count() == 1


def test_avi_layout_and_shots():
    payload = bytes(range(256)) * 16 + b"\xff" * 64
    avi = media.encode_avi(payload)
    assert avi[:4] == b"RIFF" and struct.unpack("<I", avi[4:8])[0] == len(avi) - 8 and avi[8:12] == b"AVI " and media.decode_avi(avi)[0] == payload
    cut = avi.index(b"idx1")
    assert media.frames(avi) == media.frames(avi[:cut])  # with the index and by walking
    hist = np.eye(32)[[1, 1, 1, 1, 20, 20, 20, 11]]
    assert media.shots(hist) == [(0, 3), (4, 6), (7, 7)]
    with pytest.raises(ValueError):
        media.frames(b"no file")


def test_own_frames_are_plain_jpeg():
    """The general decoder, which reads the tables in each frame, sees the same pixels as the fast path."""
    r = np.random.default_rng(1)
    for n in (1, 700, 1024, 5000):
        avi = media.encode_avi(media.pad(r.integers(0, 256, n, dtype=np.uint8).tobytes()))
        assert (media.histograms(media.decode_images(media.frames(avi))) == media.decode_avi(avi)[1]).all()


class JpegWriter:
    """A baseline writer for tests, symbol by symbol, from float cosines; nothing of the decoder is used."""

    def __init__(self, quantiser, sampling, interval=0, own_tables=True):
        self.q, self.sampling, self.interval, self.own = quantiser, sampling, interval, own_tables
        # Huffman tables of our own: every symbol has an eight-bit code but one of 16 bits' family
        self.symbols = [[*range(12)], [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]]
        order, out, line = [], [], 0
        for d in range(15):  # the zigzag walk
            cells = [(y, d - y) for y in range(8) if 0 <= d - y < 8]
            order += cells if d % 2 else cells[::-1]
        self.zigzag = order

    def codes(self, kind):
        if not self.own:
            counts, symbols = media.STANDARD[kind, 0]
        else:
            symbols = self.symbols[kind]
            counts = [0] * 16
            counts[3 if kind == 0 else 8] = len(symbols)
        out, code, k = {}, 0, 0
        for n, many in enumerate(counts, 1):
            for _ in range(many):
                out[symbols[k]] = format(code, f"0{n}b")
                code, k = code + 1, k + 1
            code <<= 1
        return out, bytes(counts) + bytes(symbols)

    def block(self, x, previous):
        u = np.arange(8)
        basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, 0.5**0.5, 1)[:, None] / 2
        c = np.round(basis @ (x - 128.0) @ basis.T / np.array(self.q).reshape(8, 8)).astype(int)
        line = [int(c[y, z]) for y, z in self.zigzag]
        bits = self.number(0, line[0] - previous, 0)
        run = 0
        for v in line[1:]:
            if not v:
                run += 1
                continue
            while run > 15:
                bits, run = bits + self.ac[0xF0], run - 16
            bits, run = bits + self.number(1, v, run), 0
        return bits + (self.ac[0x00] if run else ""), line[0], c

    def number(self, kind, v, run):
        size = abs(v).bit_length()
        return (self.ac if kind else self.dc)[run << 4 | size] + (format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else "")

    def write(self, planes, width, height):
        seg = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
        (self.dc, dc), (self.ac, ac) = self.codes(0), self.codes(1)
        wide, high = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
        across, down = -(-width // (8 * wide)), -(-height // (8 * high))
        last, bits, data, marks = [0] * len(planes), "", b"", 0

        def flush(bits):
            bits += "1" * (-len(bits) % 8)
            return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

        for m in range(across * down):
            if self.interval and m and m % self.interval == 0:
                data += flush(bits) + bytes([0xFF, 0xD0 + marks % 8])
                bits, last, marks = "", [0] * len(planes), marks + 1
            for c, (h, v) in enumerate(self.sampling):
                for y in range(v):
                    for x in range(h):
                        top, left = ((m // across) * v + y) * 8, ((m % across) * h + x) * 8
                        more, last[c], _ = self.block(planes[c][top : top + 8, left : left + 8], last[c])
                        bits += more
        zig = bytes(self.q[8 * y + z] for y, z in self.zigzag)
        frame = struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(self.sampling))
        scan = bytes([len(planes)]) + b"".join(bytes([c + 1, 0]) for c in range(len(planes))) + bytes([0, 63, 0])
        tables = (seg(0xC4, b"\x00" + dc) + seg(0xC4, b"\x10" + ac)) if self.own else b""
        rest = seg(0xDD, struct.pack(">H", self.interval)) if self.interval else b""
        return b"\xff\xd8" + seg(0xE0, b"AVI1" + bytes(10)) + seg(0xDB, b"\0" + zig) + tables + seg(0xC0, frame) + rest + seg(0xDA, scan) + data + flush(bits) + b"\xff\xd9"


@pytest.mark.parametrize("sampling, interval, own", [([(1, 1)], 0, True), ([(1, 1)], 3, False), ([(2, 2), (1, 1), (1, 1)], 0, True), ([(2, 1), (1, 1), (1, 1)], 2, False)])
def test_foreign_jpeg(sampling, interval, own):
    r = np.random.default_rng(len(sampling) + interval)
    width, height = 45, 37
    wide, high = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    images, want = [], []
    for k in range(3):
        planes = [np.clip(np.add.outer(np.arange(down * v * 8) * 3.0, np.arange(across * h * 8) * 2.0) + 40 * k + r.integers(0, 30, (down * v * 8, across * h * 8)), 0, 255) for h, v in sampling]
        images.append(JpegWriter([3 + k % 2] * 64, sampling, interval, own).write(planes, width, height))
        want.append(planes[0][:height, :width])
    for got, x in zip(media.decode_images(images), want, strict=True):
        assert got.shape == x.shape and np.abs(got.astype(float) - x).max() <= 14 and np.abs(got.astype(float) - x).mean() < 2


def avi_of(images, index=True):
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    movi, at, rows = b"movi", 4, b""
    for x in images:
        rows += b"00dc" + struct.pack("<III", 16, at, len(x))
        movi += chunk(b"00dc", x)
        at = len(movi)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<14I", 100_000, *[0] * 13)))
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", movi) + (chunk(b"idx1", rows) if index else b""))


def test_foreign_and_broken_media(spark):
    dark, light = (JpegWriter([4] * 64, [(1, 1)]).write([np.full((16, 16), v)], 16, 16) for v in (30.0, 220.0))
    fine = avi_of([dark] * 4 + [light] * 3)
    own = media.encode_avi(media.pad(b"text"))
    rows = [(1, fine), (2, None), (3, fine[: len(fine) // 2]), (4, b""), (5, own), (6, own[:-40]), (7, avi_of([dark[:40]])), (8, avi_of([])), (9, avi_of([b"\xff\xd8\xff\xc2\0\4ab"]))]
    got = {r["id"]: r for r in media.read_media(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert [(c["first_frame"], c["last_frame"], c["start_s"], c["end_s"], c["level"]) for c in got[1]["clips"]] == [(0, 3, 0.0, 0.4, 28.0), (4, 6, 0.4, 0.7, 220.0)]
    assert got[1]["payload"] is None and got[1]["problem"] is None and bytes(got[5]["payload"]) == media.pad(b"text")
    assert got[2]["clips"] == [] and got[2]["problem"] is None
    for k in (3, 4, 6, 7, 9):
        assert got[k]["payload"] is None and got[k]["clips"] == [] and got[k]["problem"], k
    assert got[8]["clips"] == [] and media.clips(spark.createDataFrame(rows, "id int, media binary")).filter("id = 1").count() == 2


# archives


def test_warc(spark):
    same = "<html>" + "ä" * 1000
    rows = [(1, "http://a/\r\nx", same), (2, None, same), (5, "u", same), (3, "u", ""), (4, "u", None), (6, "ü", "b" * 400_000), (7, "u", "once"), (None, "u", same), (7, "u", "once")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload_digest string")
    folder = new_folder(spark, "test-warc")
    at = warc.write_archives(df, folder)
    got = warc.read_archives(at, folder, payloads=True).collect()
    assert len(got) == len(rows) == at.count()
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        last = max((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        rest = last if i != last else None
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if rest is not None else "response", rest, raw if rest is None else None))
    key = lambda r: (repr(r[0]), repr(r))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"]) or (b"" if r["record_type"] == "response" else None)) for r in got), key=key) == sorted(want, key=key)
    one = warc.fetch(at, folder, 6)
    assert [r["payload_bytes"] for r in one] == [400_000] and one[0]["payload"] == b"b" * 400_000
    small = warc.write_archives(df, new_folder(spark, "test-warc2"), min_bytes=100)
    assert small.count() == len(rows)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_warc_readers_are_spread_and_damage_fails(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(k, "u", "".join(r.choice("abcdefgh") for _ in range(2000))) for k in range(60)], "page_id long, url string, html string").repartition(2)
    folder = new_folder(spark, "test-warc3")
    at = warc.write_archives(df, folder, frame_bytes=500, bundle_bytes=2000)
    files = [x["file"] for x in at.select("file").distinct().collect()]
    read = warc.read_archives(at, folder)
    assert len(files) > 10 and read.rdd.getNumPartitions() == len(files)
    assert sorted(x["page_id"] for x in read.collect()) == list(range(60))
    path = f"{folder.removeprefix('file://')}/{files[0]}"
    whole = open(path, "rb").read()
    open(path, "wb").write(whole[: len(whole) // 2])
    with pytest.raises(Exception):
        read.count()


# classifier


def test_quality(spark, sf):
    x = np.random.default_rng(0).standard_normal((3000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)  # a pair and a feature, which add up; no feature alone tells the pair
    m = quality.fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.85
    assert quality.fit(np.empty((0, 4)), np.empty(0)).score(x)[0] == 0.5 and quality.fit(x, np.ones(3000)).score(x).min() > 0.9
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    rows = quality.classify(docs, labels, trains=~held_out).filter(held_out).join(labels, "doc_id").select("score", "quality").collect()
    assert sum((r["score"] >= 0.5) == r["quality"] for r in rows) / len(rows) > 0.97


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_quality_bound_holds_for_rows(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k}") for k in range(4000)] + [(100 + k, "more") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200) for _ in range(3)], "doc_id long, quality int")
    x, y = quality.training_rows(docs, labels, rows=60)
    assert len(x) == len(y) == 60
    x, y = quality.training_rows(docs.filter("doc_id < 40"), labels, rows=60)  # the sample is of labels that can train
    assert len(x) == 40


# near-duplicates


def brute_minhash(rows, percent):
    sets = {}
    for i, t in rows:
        w = [bytes(x).translate(minhash._CASE) for x in words(t)]
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(i for i in sets if i is not None)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, groups(ids, links)


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash(spark, texts, percent):
    r = random.Random(4)
    rows = list(texts)
    for k in range(12):  # chains and stars of edited copies
        base = [f"w{r.randint(0, 10**6)}" for _ in range(r.choice([7, 12, 80, 300]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 60))):
                copy[r.randrange(len(copy))] = f"e{r.randint(0, 10**6)}"
            rows.append(" ".join(copy))
            base = copy if k % 2 else base
    rows = list(enumerate(rows))
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows] + [(None, rows[0][1], 0), (*rows[5], 0)], "doc_id long, text string, n_shingles int")
    sizes, low = brute_minhash(rows, percent)
    got = minhash.near_duplicates(df, percent=percent).collect()
    assert len(got) == len(rows) + 2
    assert {x["doc_id"]: x["component_id"] for x in got if x["doc_id"] is not None} == low and len(set(low.values())) < len(low)
    assert all(x["n_shingles"] == sizes[x["doc_id"]] for x in got if x["doc_id"] is not None)
    assert [(x["component_id"], x["kept"]) for x in got if x["doc_id"] is None] == [(None, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_near_the_truth():
    r = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        off = []
        for _ in range(40):
            both = int(600 * share)
            a, b, c = (np.unique(r.integers(0, 2**64, n, dtype=np.uint64)) for n in (both, 600 - both, 600 - both))
            x, y = np.sort(np.r_[a, b]), np.sort(np.r_[a, c])
            n = np.array([600.0])
            off.append(minhash.estimate(minhash.sketch(x)[None], minhash.sketch(y)[None], n, n)[0] - both / (1200 - both))
        assert abs(np.mean(off)) < 0.02


# tokens


def test_bpe(spark, docs, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["don't 's ''s x's's 'tis we'll've \n 'd!'m 'll", "a b   c \x1c d\x85e ", "x\n\n", " \n y\t z", "<|endoftext|>", "ab" * 3000, "é" * 400]
    df = docs.unionByName(spark.createDataFrame([(10**6 + k, t, "s", "x", "y") for k, t in enumerate(odd)], DOC)).withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(df)).collect()
    assert len(out) == docs.count() + len(odd)
    for r in out:
        assert r["ids"] == own.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    t = bpe.Tokenizer(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    t.public = False  # the pattern itself
    assert [x.tolist() for x in t.encode_batch([x or "" for x in texts] + odd)] == [own.encode_ordinary(x or "") for x in texts + odd]
    assert bpe.encode(docs.limit(0)).count() == 0


def test_bpe_splits_as_the_pattern_does():
    r = random.Random(11)
    pattern = regex.compile(public_tokenizers.PATTERN)
    alphabet = [" ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "'", "’", "s", "t", "r", "e", "v", "l", "d", "m", "S", "é", "Ж", "中", "٣", "½", "²", "7", "\u0301", "_", "-", "!", "🙂", "\u0e33", "ǅ", "Ⅷ", "\ufeff", "\0"]
    texts_ = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(20_000)]
    pieces, counts = bpe.split_batch(texts_)
    at = 0
    for t, n in zip(texts_, counts.tolist(), strict=True):
        assert pieces[at : at + n] == [m[0] for m in pattern.finditer(t)], repr(t)
        at += n


def test_bpe_decode_edges(spark):
    df = spark.createDataFrame([(1, [15496, None, 11]), (2, None), (3, [])], "k int, ids array<int>")
    assert {r["k"]: bytes(r["decoded"]) for r in bpe.decode(df).collect()} == {1: b"Hello,", 2: b"", 3: b""}
    for bad in (-1, 50256, 10**9):
        with pytest.raises(Exception, match="vocabulary"):
            bpe.decode(spark.createDataFrame([(1, [bad])], "k int, ids array<int>")).collect()


# lines


def test_lines(spark):
    common, rare, near = "All rights reserved here", "only once", "just enough"
    rows = [(k, f"{common}\nown {k}\n\n  {common} \n{near if k < 4 else rare}", f"s{k}" if k % 5 else None) for k in range(12)]
    rows += [(20, None, "s1"), (21, "", "s2"), (22, common, "s3"), (None, f"{common}\nmine", "s4"), (3, rows[3][1], "s3")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, n_lines string")
    got = lines.dedup_lines(df, min_sites=4).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["text"], r["n_lines"], r["n_removed"]))
    assert by[None] == [(f"{common}\nmine", 2, 0)]  # the smallest id keeps the line
    assert by[1] == [("own 1\n\njust enough", 5, 2)]  # near: on 3 sites, as null is none
    assert by[7] == [(f"own 7\n\n{rare}", 5, 2)]  # rare stands on three sites
    assert by[20] == [(None, 0, 0)] and by[21] == [("", 1, 0)] and by[22] == [("", 1, 1)] and len(by[3]) == 2 and by[3][0] == by[3][1]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_license_lines_and_passages_are_found_with_the_defaults(spark):
    license_, passage, short = "Released under the MIT License.", " ".join(f"word{k}" for k in range(60)), "The end"
    rows = [(k, f"own text number {k}\n{license_}\n{passage if k % 2 else short}\nlast {k}", f"s{k % 12}") for k in range(12)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == rows[0][1] and got[1] == f"own text number 1\n{passage}\nlast 1"
    assert all(got[k] == (f"own text number {k}\nlast {k}" if k % 2 else f"own text number {k}\n{short}\nlast {k}") for k in range(2, 12))


# language model


def a_vocabulary():
    words_ = [f"w{k}".encode() for k in range(60)]
    counts = np.arange(70, 10, -1)
    v = lm.Vocabulary(np.array([lm.word_key(w) for w in words_]), counts, int(counts.sum()) + 20 + 15, 60 + 12 + 1, 20, 9, 3)
    v.own, v.buckets = 40, 7
    rare = [lm.word_key(f"r{k}".encode()) for k in range(12)]
    totals, n = np.zeros(7), np.zeros(7, np.int64)
    for key, c in [*zip(v.keys.tolist(), counts.tolist()), *zip(rare, [1] * 9 + [2] * 3)]:
        totals[(key & 0xFFFF) % 7] += c
        n[(key & 0xFFFF) % 7] += 1
    v.add_buckets(totals, n)
    return v, words_, dict(zip(rare, [1] * 9 + [2] * 3))


def test_lm_is_normalised_and_learns():
    r = np.random.default_rng(0)
    v, _, rare = a_vocabulary()
    m = lm.LogBilinear(v.shares)
    n = len(v.shares)
    every, one, two = np.arange(n), np.full(n, 3), np.full(n, 5)
    before = m.log_probs(one, two, every)
    assert np.exp(before) == pytest.approx(v.shares, rel=1e-4)  # untrained: the unigram model
    a = r.integers(0, 10, 60_000)
    m.train(a[1:-1], a[:-2], (a[1:-1] + 1) % 10, r, 256)  # the next leaf follows from the last
    after = m.log_probs(one, two, every)
    assert np.exp(before).sum() == pytest.approx(1, abs=1e-5) and np.exp(after).sum() == pytest.approx(1, abs=1e-5)
    assert after.argmax() == 4 and after[4] > before[4] + 1
    # inside the buckets, words and the unseen ones add up to the bucket
    held = np.zeros(v.buckets)
    np.add.at(held, v.bucket(v.keys[v.own :]), 10 ** v.inside_of[v.own :])
    for key, c in rare.items():
        held[(key & 0xFFFF) % v.buckets] += (c - v.discount) / v.mass[(key & 0xFFFF) % v.buckets]
    assert held + max(1.0, v.unseen / v.buckets) * 10**v.unseen_log / v.mass == pytest.approx(np.ones(v.buckets))


def test_lm_tree_paths():
    for n in (1, 2, 9, 40, 400):
        t = lm.Tree(np.random.default_rng(n).random(n) + 0.1)
        for level in range(3):
            at, first, most = t.rivals(np.arange(n), level)
            assert (at >= first).all() and (at < first + most).all() and at.min() == t.offsets[level] and at.max() == t.offsets[level] + t.counts[level] - 1
        assert len(t.bias) == sum(t.counts)
    assert (lm.unpack(lm.pack(np.array([0, 5, 70_000]))) == [0, 5, 70_000]).all()


def test_lm_beats_the_base_and_ignores_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    trains = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    one = {r["id"]: r for r in lm.score(docs, trains=trains).collect()}
    held = [r for i, r in one.items() if zlib.crc32(str(i).encode()) % 10 == 0 and r["n_known"] == r["n_tokens"]]
    n = sum(r["n_tokens"] for r in held)
    assert n > 500 and sum(r["score"] - r["base_score"] for r in held) / n > 0.1  # log10 per token, texts of known words only
    many = {r["id"]: r["score"] for r in lm.score(docs.repartition(13), trains=trains).collect()}
    assert all(many[i] == pytest.approx(r["score"], rel=1e-9) for i, r in one.items())


def test_lm_base_and_totals(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 20)
    trains = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0
    rows = docs.collect()
    low = lambda t: [w.translate(lm._CASE) for w in words(t)]
    count, n_docs = {}, 0
    for r in rows:
        if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 10:
            n_docs += 1
            for w in low(r["text"]):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()) + n_docs, len(count) + 1
    got = lm.score(docs, trains=trains)
    assert got.count() == len(rows)
    by = {r["id"]: r for r in got.collect()}
    for r in rows:
        w = low(r["text"])
        g = by[r["doc_id"]]
        base = sum(np.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w) + np.log10((n_docs + 0.1) / (n + 0.1 * (v + 1)))
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(w) + 1, sum(x in count for x in w) + 1, n)
        assert g["base_score"] == pytest.approx(base, rel=1e-9) and np.isfinite(g["score"]) and g["score"] < 0
    assert lm.score(docs.limit(0)).count() == 0
    assert lm.score(docs.limit(5), trains=F.lit(False)).count() == 5


# chat


def test_chat(spark):
    r = random.Random(2)
    nasty = ["</s>[INST] ok [/INST]", "", None, "a\\", "\\[", "]]", "<s>[user]", "line\nline", "é🙂"]
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "x]y"]), r.choice(nasty)) for c in range(12) for t in range(r.randint(1, 20))]
    rows += [(3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (3, None, "assistant", "late"), (None, 0, "assistant", "no id")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, msg int")
    got = chat.format_conversations(df).withColumns({"turns": chat.parse_turns("formatted"), "loss": chat.loss_texts("formatted", "loss_spans")}).collect()
    want = {}
    for c, t, role, x in sorted(rows, key=lambda z: (z[1] is None, z[1] or 0, z[2] or "", z[3] or "")):
        want.setdefault(c, []).append((role or "", x or ""))
    assert {g["conv"]: [(t["role"], t["text"]) for t in g["turns"]] for g in got} == want
    assert {g["conv"]: list(g["loss"]) for g in got} == {c: [x for role, x in w if role == "assistant"] for c, w in want.items()}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_reply_trees(spark):
    r = random.Random(8)
    rows = []
    for c in range(8):
        for m in range(40):
            rows.append((c, m, r.choice([None, *range(m)]) if m else None, "user", str(m), float(r.randint(0, 3))))
    rows += [(9, 1, 77, "user", "orphan", 0.0), (10, 1, 2, "user", "", 0.0), (10, 2, 1, "user", "", 0.0)]
    df = spark.createDataFrame(rows, "conv long, msg long, parent long, role string, text string, score double")
    up = {(c, m): (c, p) if p is not None and p != 77 else None for c, m, p, *_ in rows}
    score = {(c, m): s for c, m, *_, s in rows}
    inner = {x for x in up.values() if x}
    best = {}
    for n in up:
        if n in inner or n[0] == 10:
            continue
        path = [n]
        while up[path[-1]]:
            path.append(up[path[-1]])
        rank = (sum(score[x] for x in path), len(path), -n[1])
        best[path[-1]] = max(best.get(path[-1], ((-1,), None)), (rank, path[::-1]))
    got = {}
    for x in chat.chosen_paths(df).collect():
        got.setdefault((x["conv"], x["root"]), {})[x["turn"]] = x["msg"]
    assert {k: [v[t] for t in sorted(v)] for k, v in got.items()} == {k: [m for _, m in p] for k, (_, p) in best.items()}
