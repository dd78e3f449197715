"""The operators' registered queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldsong.llm import toxicity
from fieldsong.llm.alignment import align, files
from fieldsong.llm.bpe import ranks_file, token_digests
from fieldsong.llm.chat import paired_by_opening
from fieldsong.llm.common import table
from fieldsong.llm.language import fit, identify, training_rows
from fieldsong.llm.media import media_digests
from fieldsong.llm.mixing import taken_per_document
from fieldsong.llm.quality import classify, learn
from fieldsong.llm.search import search
from fieldsong.llm.sharding import shard_documents
from fieldsong.llm.simhash import hex_of, near_duplicates
from fieldsong.llm.url_rules import filter_pages
from fieldsong.llm.vectors import nearest


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_per_document(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "place")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(training_rows(docs)))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(found.fp).alias("fingerprint"), "component_id")


def op5_preference_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired_by_opening(table(spark, sf_dir, "conversations"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, learn(docs, table(spark, sf_dir, "labels")))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = ranks_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return token_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_pages(table(spark, sf_dir, "pages").select("page_id", "url"), "url").select("page_id", "host", "path", "rule", "verdict")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), *files(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_mix_sources, op2_media, op3_language, op4_simhash, op5_preference_chats, op6_quality, op7_nearest, op8_bpe, op9_url_filters, op10_shards, op11_search, op12_toxicity, op13_alignment,
)}

ORACLE: dict[str, str] = {
    "op1_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0) AS BIGINT) AS size,
         ('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS spot FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sized GROUP BY source
), capped AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM per
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), targets AS (
  SELECT *, least(cap, coalesce((max(level) FILTER (cap >= level * weight) OVER ()) * weight, cap)) AS target FROM levels
), queued AS (
  SELECT s.doc_id, s.source, s.size, s.spot, t.source_size, t.weight, t.target, CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.spot, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS BIGINT) AS q
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, q + (copy - 1) * source_size AS start FROM queued, (VALUES (1), (2)) c(copy)
), events AS (
  SELECT *, (start + size) / weight AS finish, start + size = source_size * 2 AS ends FROM copies WHERE size > 0
), placed AS (
  SELECT *, row_number() OVER o - 1 AS place, coalesce(sum(CASE WHEN ends THEN weight ELSE 0.0::DOUBLE END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS gone,
         coalesce(sum(CASE WHEN ends THEN source_size * 2 ELSE 0 END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM events WINDOW o AS (ORDER BY finish, source NULLS FIRST, spot, doc_id, size, copy)
), sums AS (
  SELECT sum(source_size) * 1.5::DOUBLE AS budget, sum(CASE WHEN source_size > 0 THEN weight END) AS weights FROM per
), cut AS (
  SELECT arg_min((budget - done) / (weights - gone), place) AS v FROM placed, sums WHERE done + finish * (weights - gone) >= budget
), took AS (
  SELECT doc_id, place, CAST(greatest(0, least(size, floor(v * weight + 1e-6) - start)) AS BIGINT) AS taken FROM placed, cut
), summed AS (
  SELECT doc_id, sum(taken) AS taken, min(place) FILTER (taken > 0) AS place FROM took GROUP BY doc_id
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(s.taken, 0) AS BIGINT) AS taken, CAST(s.place AS BIGINT) AS place FROM queued q LEFT JOIN summed s ON q.doc_id = s.doc_id""",
    "op5_preference_chats": r"""
WITH entries AS (
  SELECT conv_id AS conv, turn AS place, role, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS nth
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)
), seats AS (
  SELECT conv, row_number() OVER (ORDER BY md5(role || chr(10) || text), conv) - 1 AS seat
  FROM (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY conv ORDER BY place, nth) = 1)
), pairs AS (
  SELECT seat // 2 AS pair_id, max(conv) FILTER (seat % 2 = 0) AS chosen_id, max(conv) FILTER (seat % 2 = 1) AS rejected_id FROM seats GROUP BY seat // 2
), laid AS (
  SELECT seat // 2 AS pair_id, CASE WHEN seat % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, e.* FROM seats JOIN entries e USING (conv)
), apart AS (
  SELECT pair_id, min({'place': place, 'nth': nth}) AS differs
  FROM (SELECT pair_id, place, nth FROM laid GROUP BY ALL HAVING count(*) < 2 OR min(role) <> max(role) OR min(text) <> max(text)) GROUP BY pair_id
), shown AS (
  SELECT laid.*, (differs IS NULL OR {'place': place, 'nth': nth} < differs) AS shared,
         '<|' || replace(role, '<|', '< |') || '|>' || chr(10) AS head, replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM laid LEFT JOIN apart USING (pair_id)
), runs AS (
  SELECT pair_id, place, nth, place // 512 AS part, CASE WHEN shared THEN 'prompt' ELSE side END AS kind, head || body AS piece,
         CASE WHEN role = 'assistant' THEN length(head) || ',' || length(body) ELSE (length(head) + length(body)) || ',0' END AS run
  FROM shown WHERE NOT (shared AND side = 'rejected')
), whole AS (
  SELECT pair_id, part, count(*) FILTER (kind = 'prompt') AS prompt_turns,
         string_agg(piece, '' ORDER BY place, nth) FILTER (kind = 'prompt') AS prompt,
         string_agg(piece, '' ORDER BY place, nth) FILTER (kind = 'chosen') AS chosen, string_agg(run, ',' ORDER BY place, nth) FILTER (kind = 'chosen') AS chosen_mask,
         string_agg(piece, '' ORDER BY place, nth) FILTER (kind = 'rejected') AS rejected, string_agg(run, ',' ORDER BY place, nth) FILTER (kind = 'rejected') AS rejected_mask
  FROM runs GROUP BY pair_id, part
)
SELECT pair_id, coalesce(part, 0) AS part, chosen_id, rejected_id, coalesce(prompt_turns, 0) AS prompt_turns, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen,
       coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected, '') AS rejected, coalesce(rejected_mask, '') AS rejected_mask
FROM pairs LEFT JOIN whole USING (pair_id)""",
    "op9_url_filters": r"""
WITH parts AS (
  SELECT page_id, coalesce(position('://' IN url), 0) AS mark, url FROM pages
), rest AS (
  SELECT page_id, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS tail FROM parts
), split AS (
  SELECT page_id, translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(verdict, r_host, r_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
)
SELECT page_id, host, path,
       (SELECT r_host || r_path FROM rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
        ORDER BY length(r_host || r_path) DESC, r_host || r_path LIMIT 1) AS rule,
       coalesce((SELECT verdict FROM rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
        ORDER BY length(r_host || r_path) DESC, r_host || r_path LIMIT 1), 'allow') AS verdict
FROM split""",
    "op11_search": r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS seat,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), sums AS (
  SELECT count(*) FILTER (len(words) > 0) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM docs
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), spread AS (
  SELECT seat, unnest(words) AS term FROM docs
), counted AS (
  SELECT seat, term, count(*) AS tf FROM spread SEMI JOIN wanted USING (term) GROUP BY seat, term
), weighed AS (
  SELECT term, CAST(floor(1000.0::DOUBLE * ln(CAST(2 * (SELECT n_docs FROM sums) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM counted GROUP BY term
), impact AS (
  SELECT seat, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * len(words) * n_docs) // n_terms)))) AS i
  FROM counted JOIN weighed USING (term) JOIN docs USING (seat), sums
), scored AS (
  SELECT item_id, seat, doc_id, CAST(sum(i) AS BIGINT) AS score FROM impact JOIN wanted USING (term) GROUP BY item_id, seat, doc_id HAVING sum(i) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
}
