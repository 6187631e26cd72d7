"""The queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, kneser_ney, langid, mixing, ogg, secrets, simhash, toxicity, urls
from .common import read, table


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds every window of the benchmark's items in all documents."""
    index = decontaminate.build_index(read(spark, sf_dir, "documents"))
    return decontaminate.contamination(index, read(spark, sf_dir, "benchmark"), slop=decontaminate.SLOP).withColumnRenamed("doc", "doc_id").drop("mark")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)),
g AS (
  SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT k FROM n))),
h AS (SELECT g.doc_id, g.p, g.k, n.item_id FROM g JOIN n ON g.k = n.k AND g.phrase = n.phrase),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id),
a AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d),
f AS (SELECT term, count(*) AS n FROM a GROUP BY term),
q AS (SELECT item_id, term, coalesce(f.n, 0) AS n, count(*) OVER (PARTITION BY item_id) AS of, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(f.n, 0), term) AS nth
      FROM (SELECT DISTINCT item_id, unnest(w) AS term FROM i) LEFT JOIN f USING (term)),
r AS (SELECT a.doc_id, q.item_id, q.of, a.p FROM a JOIN q ON q.term = a.term AND q.nth = 1),
s AS (SELECT r.doc_id, r.item_id, r.p FROM r JOIN q ON q.item_id = r.item_id JOIN a ON a.doc_id = r.doc_id AND a.term = q.term AND abs(a.p - r.p) <= 50
      GROUP BY r.doc_id, r.item_id, r.p HAVING count(DISTINCT q.term) = max(r.of)),
e AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM s GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated,
       coalesce(e.n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN e USING (doc_id)
"""


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts every document's language, having learned from those that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.identify(docs, model).withColumn("held_out", langid.held_out())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints all documents and gives each the least id that links of 3 bits or fewer reach."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents, having learned from labels that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return toxicity.score(docs, model).withColumn("held_out", toxicity.held_out())


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges all pages by the given rules, else by combinations mined from labels of low quality or toxic ones."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return urls.judge(read(spark, sf_dir, "pages"), labels)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents to weights 1, 2, 3, repeating, at most 3 epochs."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("mark"))
    return mixing.mix(table(docs, "mix-docs"), size="size", mark="mark").select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS ord
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, row_number() OVER w AS nth, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS over_w
  FROM s WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
f AS (SELECT *, rest * weight <= 3 * source_size * over_w AS free FROM l),
a AS (SELECT rest AS rest0, over_w AS over0 FROM f WHERE free ORDER BY nth LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN free THEN (weight * rest0)::DOUBLE / over0 ELSE (3 * source_size)::DOUBLE END AS target
  FROM f LEFT JOIN a ON TRUE),
p AS (
  SELECT *, least(round(target)::BIGINT, 3 * source_size) AS want,
         CASE WHEN source_size > 0 THEN least(round(target)::BIGINT, 3 * source_size) // source_size ELSE 0 END AS whole
  FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.want - p.whole * p.source_size AS extra,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * whole + greatest(0, least(size, extra - before)))::BIGINT AS taken
FROM c
"""


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds secrets in every document by rules and by the network trained on what they find."""
    return secrets.scan(read(spark, sf_dir, "documents"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents by a Kneser-Ney model of nine tenths of them."""
    scored = kneser_ney.score_held_out(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as an Ogg file, reads the files back and describes them."""
    return ogg.read_media(ogg.media_column(read(spark, sf_dir, "documents"))).drop("broken_pages")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one that spells the template's marks; reads ids and masks back."""
    said = "</s>[INST] ok [/INST]"
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.format_conversations(turns.unionByName(probe)))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, len(text) + len(regexp_extract_all(text, '(?:<\\*/?s>)|(?:\[\\*/?(?:INST|SYS|ROLE)\])')) AS chars,
         len(role) + len(regexp_extract_all(role, '(?:<\\*/?s>)|(?:\[\\*/?(?:INST|SYS|ROLE)\])')) AS role_chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(chars + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 13 WHEN 'system' THEN 11 ELSE 17 + role_chars END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_decontaminate": op2_decontaminate,
    "op3_langid": op3_langid,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_urls": op6_urls,
    "op7_mixing": op7_mixing,
    "op8_secrets": op8_secrets,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_ogg": op10_ogg,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op7_mixing": OP7_SQL,
}
