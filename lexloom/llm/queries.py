"""One query for each operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import bpe, chat, embeddings, lines, lm, media, minhash, mixing, quality, warc
from lexloom.session import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_report(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM s),
levels AS (
  SELECT source, source_size, w, 3 * source_size AS cap,
         sum(w) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS free,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
         (sum(source_size) OVER ())::BIGINT AS total, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS i
  FROM ranked),
lev AS (SELECT (total - capped)::DOUBLE / free AS l FROM levels WHERE (total - capped)::DOUBLE / free * w <= cap ORDER BY i LIMIT 1),
ranked_cap AS (SELECT source, source_size, w, 3 * source_size AS cap FROM ranked),
goal AS (SELECT source, source_size, least(w * l, cap::DOUBLE) AS target FROM ranked_cap, lev),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM goal),
rests AS (SELECT *, target - passes * source_size AS rest FROM parts),
sums AS (SELECT source, h, sum(size)::BIGINT AS g FROM docs GROUP BY source, h),
cums AS (SELECT source, h, g, (sum(g) OVER (PARTITION BY source ORDER BY h))::BIGINT AS upto FROM sums),
kept AS (
  SELECT c.source, h, rest > 0 AND (upto <= rest OR (upto - g <= rest AND upto - rest < rest - (upto - g))) AS more
  FROM cums c JOIN rests r ON c.source IS NOT DISTINCT FROM r.source)
SELECT d.doc_id, d.size, r.source_size, r.target, (d.size * (r.passes + CASE WHEN more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source
JOIN kept k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE x AS (
  SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM x a JOIN x b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.u = e.vec_id)::BIGINT AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e JOIN least ON u = e.vec_id
"""


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    read = media.read_media(media.to_media(docs).drop("text"))
    clip = lambda x: F.format_string("%d-%d@%.2f-%.2fs:%.3f", x["first_frame"], x["last_frame"], x["start_s"], x["end_s"], x["level"])
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.array_join(F.transform("clips", clip), ";").alias("feature"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32)::INT[], lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(p.h, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN NULL ELSE last END AS refers_to
FROM p JOIN g ON p.h = g.h
"""


def _part(id_: str, n: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_).cast("string"), F.lit("")).cast("binary")) % n


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _part("doc_id", 3) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.classify(docs, table(spark, sf_dir, "labels"), trains=~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3)::INT[], lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
r AS (SELECT DISTINCT a.doc_id AS d, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM s a GROUP BY a.doc_id),
rep AS (SELECT d, min(d) OVER (PARTITION BY h) AS rep FROM r),
one AS (SELECT * FROM s WHERE doc_id IN (SELECT rep FROM rep)),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM one a JOIN one b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM common JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)
  UNION SELECT rep, d FROM rep WHERE rep <> d),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN both_ways l ON r.v = l.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) m ON m.u = d.doc_id
"""


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "n_lines", "n_removed", "text")


OP8_SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM l),
b AS (SELECT k, min((doc_id, pos)) AS first FROM t WHERE len(regexp_extract_all(k, '[^\x20\x09-\x0D]+')) >= 3 GROUP BY k HAVING count(DISTINCT source) >= 5),
f AS (SELECT t.doc_id, t.pos, t.line, b.k IS NOT NULL AND (t.doc_id, t.pos) <> b.first AS gone FROM t LEFT JOIN b ON t.k = b.k),
g AS (SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, g.text FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    out = bpe.decode(ids)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score(table(spark, sf_dir, "documents"), trains=_part("doc_id", 10) != 0)
    return out.withColumnRenamed("id", "doc_id").withColumn("held_out", _part("doc_id", 10) == 0)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_conversations(rows).select("conv", "formatted", chat.parse_turns("formatted").alias("turns"), chat.loss_texts("formatted", "loss_spans").alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return out.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(9 + length(regexp_replace(role || text, '([\\<\[\]])', '##', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

QUERIES = {
    "op1_mixing": op1_mixing, "op2_embeddings": op2_embeddings, "op3_media": op3_media, "op4_warc": op4_warc, "op5_quality": op5_quality,
    "op6_minhash": op6_minhash, "op7_bpe": op7_bpe, "op8_lines": op8_lines, "op9_lm": op9_lm, "op10_chat": op10_chat,
}
ORACLE_SQL = {"op1_mixing": OP1_SQL, "op2_embeddings": OP2_SQL, "op4_warc": OP4_SQL, "op6_minhash": OP6_SQL, "op8_lines": OP8_SQL, "op10_chat": OP10_SQL}
