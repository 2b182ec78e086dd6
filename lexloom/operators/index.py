"""Positional inverted index: typed tokens, chunks, positions, posting lists and seek tables.

Tokens explode behind the last shuffle: pages move to their chunks' tasks, and a chunk's lists are made from arrays of all its
tokens (wholes.py). Plain texts move as they are and are split there. Only where a chunk is too large for that, and for token tables of other origin, are (chunk, key, position)
rows shuffled. Positions need prefix sums over documents, one narrow row each, and never over tokens. Sums and chunk borders come from range partitions and the totals of those
before them, so no task sees all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import ascii_lower
from lexloom.operators import wholes
from lexloom.session import materialize
from lexloom.sources.pages import parse_text, text_url

MAX_DOCS, MAX_WORDS = 5000, 800_000

# What keys begin with, and the letters of the token types.
HEAD, TITLE, ANCHOR, SELF_REFERENCE, OTHER_REFERENCE, OWN_URL, END_OF_DOCUMENT = "<", "@", "$", "#1", "#0", "##", "%"
TYPES = {"end": "e", "anchor": "a", "url": "u", "title": "t", "body": "b"}


def _token(key: Column, kind: str) -> Column:
    return F.struct(key.alias("key"), F.lit(TYPES[kind]).alias("type"))


def same_host(url: Column) -> Column:
    """Whether a link starts with the page's host, looked for behind the page's own scheme: a prefix test."""
    return F.substring(url, F.length("service") + 4, F.length("host")) == F.col("host")


def token_list(parsed: DataFrame) -> Column:
    """The tokens of a parsed page in order: body, headings, title, links (anchor words, then the url), end, own url."""
    marked = lambda words, mark, kind: F.transform(words, lambda w: _token(F.concat(F.lit(mark), ascii_lower(w)), kind))
    link = lambda x: F.concat(
        marked(x["anchor"], ANCHOR, "anchor"),
        F.array(_token(F.concat(F.when(same_host(x["url"]), F.lit(SELF_REFERENCE)).otherwise(F.lit(OTHER_REFERENCE)), x["url"]), "url")),
    )
    return F.concat(
        marked(F.col("body"), "", "body"), marked(F.col("head"), HEAD, "body"), marked(F.col("title"), TITLE, "title"), F.flatten(F.transform("links", link)),
        F.array(_token(F.lit(END_OF_DOCUMENT), "end"), _token(F.concat(F.lit(OWN_URL), F.col("url")), "url")),
    )


def token_count(parsed: DataFrame) -> Column:
    """size(token_list()) without building it."""
    anchors = F.aggregate("links", F.lit(0), lambda n, x: n + F.size(x["anchor"]) + 1)
    return (F.size("body") + F.size("head") + F.size("title") + anchors + 2).cast("long")


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    """df in range partitions by the columns `order` (nulls first), each with its number in the column part."""
    return df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())


def _prefix(df: DataFrame, order: list[str], size: str | None = None) -> DataFrame:
    """df with part, at (its place in the order, from 0) and, with a size column, upto (the sum of the sizes before it)."""
    rows = materialize(_ranged(df, *order), "prefix-rows")
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size_ = F.col(size) if size else F.lit(0).cast("long")
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(size_).alias("t"))  # a row for each partition
    over = Window.orderBy("part")
    parts = parts.select("part", (F.sum("n").over(over) - F.col("n")).alias("n before"), (F.sum("t").over(over) - F.col("t")).alias("t before"))
    out = rows.withColumns({"in at": F.count(F.lit(1)).over(w) - 1, "in upto": F.sum(size_).over(w) - size_}).join(F.broadcast(parts), "part")
    out = out.withColumns({"at": F.col("in at") + F.col("n before"), "upto": F.col("in upto") + F.col("t before")})
    return out.select("part", *df.columns, "at", *["upto"] * bool(size))


def _next_starts(places: DataFrame, max_docs: int, max_words: int) -> DataFrame:
    """i, j: the document after a chunk that begins at document i. Chunks without one after them are left out.

    It is the later of i + max_docs + 1 and the first document before which there are more than max_words tokens from i on.
    Documents and the sums they ask for are sorted by sum in range partitions; what a partition lacks comes from the ones after.
    """
    none = F.lit(None).cast("long")
    both = places.select(F.col("upto").alias("sum"), F.col("at").alias("j"), none.alias("i")).unionByName(
        places.select((F.col("upto") + max_words).alias("sum"), none.alias("j"), F.col("at").alias("i"))
    )
    both = materialize(_ranged(both, "sum"), "chunk-sums")
    w = Window.partitionBy("part").orderBy(F.desc("sum"), F.col("i").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = both.groupBy("part").agg(F.min("j").alias("least"))
    later = later.select("part", F.min("least").over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    found = both.withColumn("near", F.min("j").over(w)).filter("i IS NOT NULL").join(F.broadcast(later), "part")
    found = found.select("i", F.coalesce("near", "later").alias("j")).filter("j IS NOT NULL").select("i", F.greatest("j", F.col("i") + max_docs + 1).alias("j"))
    return found.join(places.select(F.col("at").alias("j")), "j", "left_semi")


def _chunk_starts(places: DataFrame, max_docs: int, max_words: int) -> DataFrame:
    """s: the first document of every chunk. From document 0 the next starts are followed by pointer doubling: each round
    doubles the starts that are known and the length of the jumps."""
    jumps = materialize(_next_starts(places, max_docs, max_words).select("i", "j"), "chunk-jumps")
    starts = places.filter("at = 0").select(F.col("at").alias("s"))
    while True:
        more = materialize(starts.join(jumps, F.col("s") == F.col("i")).select(F.col("j").alias("s")), "chunk-starts")
        if more.isEmpty():
            return starts
        starts = materialize(starts.unionByName(more), "chunk-starts")
        jumps = materialize(jumps.join(jumps.select(F.col("i").alias("j"), F.col("j").alias("k")), "j").select("i", F.col("k").alias("j")), "chunk-jumps")


def assign_chunks(lengths: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> DataFrame:
    """lengths (doc_id, n_tokens and any columns that order rows of one id) with chunk_id, doc_seq and start.

    Documents go in the order of doc_id, null first; each row is a document of its own. A chunk ends with the document after
    which it has more than max_docs documents and more than max_words tokens. start is the position of the first token in
    the chunk; doc_seq counts from 0.
    """
    ties = [c for c in lengths.columns if c not in ("doc_id", "n_tokens")]
    rows = lengths.select(F.col("doc_id").cast("long"), F.col("n_tokens").cast("long"), *ties)
    rows = materialize(rows, "chunk-lengths")  # range partitions sample first, and texts are read once
    places = materialize(_prefix(rows, ["doc_id", *ties], "n_tokens"), "chunk-places")
    docs, words = places.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    zero = F.lit(0).cast("long")
    if docs <= max_docs or words <= max_words:
        return places.select("doc_id", "n_tokens", *ties, zero.alias("chunk_id"), F.col("at").alias("doc_seq"), F.col("upto").alias("start"))
    starts = _prefix(_chunk_starts(places, max_docs, max_words), ["s"]).select("s", F.col("at").alias("chunk_id"))
    firsts = F.when(F.col("s").isNotNull(), F.struct("chunk_id", "at", "upto"))
    marked = materialize(places.join(starts, F.col("at") == F.col("s"), "left").select("doc_id", "n_tokens", *ties, "part", "at", "upto", firsts.alias("first")), "chunk-marks")
    last = marked.groupBy("part").agg(F.max("first").alias("last"))  # a row for each partition
    earlier = last.select("part", F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    w = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = marked.withColumn("own", F.max("first").over(w)).join(F.broadcast(earlier), "part").withColumn("c", F.coalesce("own", "earlier"))
    return out.select("doc_id", "n_tokens", *ties, "c.chunk_id", (F.col("at") - F.col("c.at")).alias("doc_seq"), (F.col("upto") - F.col("c.upto")).alias("start"))


def tokens(parsed: DataFrame) -> DataFrame:
    """doc_id, offset, key, type of every token."""
    return parsed.select("doc_id", F.posexplode(token_list(parsed)).alias("offset", "t")).select("doc_id", F.col("offset").cast("long").alias("offset"), "t.key", "t.type")


def placed(parsed: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> DataFrame:
    """parsed with chunk_id, doc_seq and start, by assign_chunks(). Rows that repeat an id go in the order of their content's
    hash; rows equal in everything are documents one after another. The join is on id and hash: pages are moved if the table
    of places is above Spark's broadcast threshold."""
    return _placed(parsed.withColumn("content", F.xxhash64("url", "body", "head", "title", "links")), token_count(parsed), max_docs, max_words)


def _placed(keyed: DataFrame, n_tokens: Column, max_docs: int, max_words: int) -> DataFrame:
    """placed() of rows with doc_id and content, the hash."""
    places = materialize(assign_chunks(keyed.select("doc_id", "content", n_tokens.alias("n_tokens")), max_docs, max_words), "places")
    most = places.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] or 0
    places = places.select(F.col("doc_id").alias("place id"), F.col("content").alias("place content"), "chunk_id", "doc_seq", "start")
    same = F.col("doc_id").eqNullSafe(F.col("place id")) & (F.col("content") == F.col("place content"))
    twice = materialize(places.groupBy("place id", "place content").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "places-repeated")
    if not twice.isEmpty():  # one of several equal rows stands for all their places
        once = keyed.join(twice, same, "left_semi").dropDuplicates(["doc_id", "content"])
        keyed = keyed.join(twice, same, "left_anti").unionByName(once)
    out = keyed.join(places, same).drop("place id", "place content", "content")
    out.most = most  # tokens of the largest chunk
    return out


def occurrences(parsed: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> DataFrame:
    """chunk_id, key, type, doc_seq, pos of every token."""
    rows = placed(parsed, max_docs, max_words)
    out = _occurrences(rows)
    out.placed = rows
    return out


def text_occurrences(texts: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """occurrences() of parse_text(texts), of which ids and texts alone are moved and hashed, never lists of words."""
    texts = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("content", F.xxhash64("text"))
    rows = _placed(texts, wholes.word_count(F.col("text")) + 2, max_docs, max_words)
    pages_ = parse_text(rows, "chunk_id", "doc_seq", "start")
    out = _occurrences(pages_)
    pages_.most, out.placed, out.texts = rows.most, pages_, rows
    return out


def _occurrences(rows: DataFrame) -> DataFrame:
    rows = rows.select("chunk_id", "doc_seq", "start", F.posexplode(token_list(rows)).alias("offset", "t"))
    return rows.select("chunk_id", "t.key", "t.type", "doc_seq", (F.col("start") + F.col("offset")).alias("pos"))


def are_whole(occ: DataFrame) -> bool:
    """Whether occ is a table of occurrences() whose chunks are small enough for one task each."""
    rows = getattr(occ, "placed", None)
    return rows is not None and rows.most <= wholes.WHOLE


def _whole(occ: DataFrame) -> DataFrame | None:
    """The tokens of occurrences(), or the texts of text_occurrences(), with those of a chunk together, in their order. None
    if not are_whole()."""
    if not are_whole(occ):
        return None
    texts = getattr(occ, "texts", None)
    rows = (occ.placed if texts is None else texts).repartition("chunk_id").sortWithinPartitions("chunk_id", "doc_seq")
    return _occurrences(rows) if texts is None else rows.select("chunk_id", "doc_seq", "start", text_url(F.col("doc_id")).alias("url"), "text")


def deltas(occ: DataFrame) -> DataFrame:
    """occ with delta: the distance to the key's last position in the chunk, from 0."""
    if (tokens_ := _whole(occ)) is not None:
        return wholes.deltas(tokens_, *occ.columns)
    w = Window.partitionBy("chunk_id", "key").orderBy("pos")
    return occ.withColumn("delta", F.col("pos") - F.lag("pos", 1, 0).over(w))


def delta_bytes(delta: Column) -> Column:
    """Bytes of a delta in the variable-length code: 7, 11, 16, 21, 26 or 31 bits."""
    return F.when(delta < 1 << 7, 1).when(delta < 1 << 11, 2).when(delta < 1 << 16, 3).when(delta < 1 << 21, 4).when(delta < 1 << 26, 5).otherwise(6)


def bits_needed(n: Column) -> Column:
    return F.length(F.bin(n))


def post_code(delta: Column) -> Column:
    """The bytes of a delta below 2**31: a lead byte whose leading ones count the bytes, then six bits to a byte; one byte
    below 128. Hexadecimal digits are put together natively and turned into bytes."""
    byte = lambda value: F.lpad(F.hex(value), 2, "0")
    tail = lambda k: byte(F.shiftright(delta, 6 * k).bitwiseAND(F.lit(63)) + 128)
    code = byte(delta)
    out = F.when(delta_bytes(delta) == 1, code)
    for n, lead in ((2, 0xC0), (3, 0xE0), (4, 0xF0), (5, 0xF8), (6, 0xFC)):
        out = out.when(delta_bytes(delta) == n, F.concat(byte(F.shiftright(delta, 6 * (n - 1)) + lead), *[tail(k) for k in range(n - 2, -1, -1)]))
    return F.unhex(out)


def post_length(code: Column) -> Column:
    """Bytes of a post, from its lead byte."""
    lead = F.conv(F.hex(F.substring(code, 1, 1)), 16, 10).cast("int")
    out = F.when(lead < 0x80, 1)
    for n, most in ((2, 0xE0), (3, 0xF0), (4, 0xF8), (5, 0xFC), (6, 0xFE)):
        out = out.when((lead >= 0xC0) & (lead < most), n)
    return out


def post_delta(code: Column) -> Column:
    """The delta that a post's bytes stand for."""
    n, at = post_length(code), lambda k: F.conv(F.hex(F.substring(code, k, 1)), 16, 10).cast("long")
    out = F.when(n == 1, at(1))
    for size in range(2, 7):
        value = at(1).bitwiseAND(F.lit((1 << (7 - size)) - 1))
        for k in range(2, size + 1):
            value = value * 64 + at(k) - 128
        out = out.when(n == size, value)
    return out


def post_bits(code: Column) -> Column:
    """The bytes of a post as groups of eight binary digits."""
    digits = F.lpad(F.conv(F.hex(code), 16, 2), 8 * 6, "0")
    return F.trim(F.regexp_replace(F.substring(F.lpad(digits, 48, "0"), F.lit(49) - 8 * post_length(code), 8 * post_length(code)), "(.{8})", "$1 "))


def _with_seek(occ: DataFrame) -> DataFrame:
    """occ with index (of the post in its list) and full, before: how many seek rows there are with it and without it. A
    running minimum over the key's posts gives them without a loop."""
    w = Window.partitionBy("chunk_id", "key").orderBy("pos")
    rows = occ.withColumn("index", (F.row_number().over(w) - 1).cast("long"))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = F.least(F.col("index") + 1, F.min(bits_needed(F.col("pos") + 1) - F.col("index")).over(upto) + F.col("index"))
    return rows.withColumn("full", full).withColumn("before", F.lag("full", 1, 0).over(w))


def seek_rows(occ: DataFrame) -> DataFrame:
    """chunk_id, key, index, location of the seek tables: at most one row per post, whenever its location (pos + 1) reaches
    the next power of two."""
    if (tokens_ := _whole(occ)) is not None:
        return wholes.seek_rows(tokens_)
    return _with_seek(occ.select("chunk_id", "key", "pos")).filter("full > before").select("chunk_id", "key", "index", (F.col("pos") + 1).alias("location"))


def posting_stats(occ: DataFrame) -> DataFrame:
    """chunk_id, key, type (of the first occurrence), use_count, doc_count, reference_doc_count (one more unless the key is
    in the chunk's first document). Without whole chunks, partial aggregation runs per key and document, so hot keys shrink
    before the shuffle."""
    if (tokens_ := _whole(occ)) is not None:
        return wholes.posting_stats(tokens_)
    per_doc = occ.groupBy("chunk_id", "key", "doc_seq").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "type")).alias("first"))
    stats = per_doc.groupBy("chunk_id", "key").agg(F.sum("n").alias("use_count"), F.count(F.lit(1)).alias("doc_count"), F.min("doc_seq").alias("least"), F.min("first").alias("first"))
    return stats.select("chunk_id", "key", F.col("first.type").alias("type"), "use_count", "doc_count", (F.col("doc_count") + (F.col("least") > 0).cast("long")).alias("reference_doc_count"))


def postings(occ: DataFrame) -> DataFrame:
    """One row per chunk and key: type, use_count, doc_count, reference_doc_count, deltas, seek. A list is at most as long
    as its chunk. Without whole chunks tokens are shuffled once: the windows' partitioning serves the aggregation."""
    if (tokens_ := _whole(occ)) is not None:
        return wholes.postings(tokens_)
    w = Window.partitionBy("chunk_id", "key").orderBy("pos")
    rows = _with_seek(deltas(occ)).withColumn("new", (~F.col("doc_seq").eqNullSafe(F.lag("doc_seq").over(w))).cast("long"))
    seek = F.when(F.col("full") > F.col("before"), F.struct("index", (F.col("pos") + 1).alias("location")))
    lists = rows.groupBy("chunk_id", "key").agg(
        F.min(F.struct("pos", "type")).alias("first"), F.count(F.lit(1)).alias("use_count"), F.sum("new").alias("doc_count"), F.min("doc_seq").alias("least"),
        F.array_sort(F.collect_list(F.struct("pos", "delta"))).alias("posts"), F.array_sort(F.collect_list(seek)).alias("seek"),
    )
    return lists.select(
        "chunk_id", "key", F.col("first.type").alias("type"), "use_count", "doc_count", (F.col("doc_count") + (F.col("least") > 0).cast("long")).alias("reference_doc_count"),
        F.col("posts.delta").alias("deltas"), "seek",
    )


def postings_as_text(occ: DataFrame) -> DataFrame:
    """postings() with deltas joined by commas, and seek's index:location likewise."""
    if (tokens_ := _whole(occ)) is not None:
        return wholes.postings(tokens_, as_text=True)
    seek = F.transform("seek", lambda x: F.concat(x["index"].cast("string"), F.lit(":"), x["location"].cast("string")))
    return postings(occ).withColumns({"deltas": F.array_join(F.col("deltas").cast("array<string>"), ","), "seek": F.array_join(seek, ",")})


def documents(parsed: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> DataFrame:
    """chunk_id, doc_seq, url."""
    return placed(parsed, max_docs, max_words).select("chunk_id", "doc_seq", "url")


def top_terms(stats: DataFrame, n: int) -> DataFrame:
    return stats.orderBy(F.desc("use_count"), "key", "chunk_id").limit(n)


def find(postings_: DataFrame, key: str) -> DataFrame:
    return postings_.filter(F.col("key") == key)


def find_url(postings_: DataFrame, url: str) -> DataFrame:
    """Where a url is the page itself, a link to the same host or another link."""
    return postings_.filter(F.col("key").isin(*(m + url for m in (OWN_URL, SELF_REFERENCE, OTHER_REFERENCE))))


def get_document(documents_: DataFrame, doc_seq: int, chunk_id: int | None = None) -> DataFrame:
    rows = documents_.filter(F.col("doc_seq") == doc_seq)
    return rows if chunk_id is None else rows.filter(F.col("chunk_id") == chunk_id)


def document_of(occ: DataFrame, pos: DataFrame) -> DataFrame:
    """pos (chunk_id, pos) with doc_seq: the document whose end token is the first at or after the position; own-url
    tokens stand behind that end. Positions and ends share one sort by chunk instead of a range join; occ's own positions are
    in order already where chunks are whole."""
    if pos is occ and (tokens_ := _whole(occ)) is not None:
        end = (F.col("key") == END_OF_DOCUMENT) & (F.col("type") == TYPES["end"])
        return wholes.document_of_all(tokens_ if "text" in tokens_.columns else tokens_.select("chunk_id", "pos", "doc_seq", end.alias("end")))
    ends = occ.filter(F.col("key") == END_OF_DOCUMENT).filter(F.col("type") == TYPES["end"]).select("chunk_id", "pos", F.col("doc_seq").alias("end_seq"), F.lit(False).alias("asked"))
    both = ends.unionByName(pos.select("chunk_id", "pos", F.lit(None).cast("long").alias("end_seq"), F.lit(True).alias("asked")))
    w = Window.partitionBy("chunk_id").orderBy(F.desc("pos"), "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("doc_seq", F.last("end_seq", True).over(w)).filter("asked").select("chunk_id", "pos", "doc_seq")
