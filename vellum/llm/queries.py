"""The registered queries of this subpackage, each over its whole tables, and the SQL that some equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from vellum.llm import bpe_scan, html_blocks, itq_dedup, language_id, packing, quality_rules, simhash_tiles, token_counts, toxicity, warc_bundles
from vellum.llm.common import crc_mod, table

QUERIES: dict = {}
ORACLES: dict = {}


def op1_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


QUERIES["op1_quality_rules"] = op1_quality_rules
_PHRASES = " or ".join(f"contains(low, '{x}')" for x in quality_rules.BOILERPLATE)
ORACLES["op1_quality_rules"] = rf"""
with docs as (select row_number() over () as row_id, doc_id, coalesce(text, '') as text from documents),
split as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs),
windows as (
  select row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select row_id, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from split where len(w) >= 3) t),
repeats as (
  select row_id, count(distinct i + k) as n
  from (select row_id, i, count(*) over (partition by row_id, g) as c from windows) t, (values (0), (1), (2)) as o(k)
  where c > 1 group by row_id),
lines as (
  select row_id, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as lw, lower(line) as low,
         row_number() over (partition by row_id, line order by pos) > 1 as again
  from (select row_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from docs) t
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
judged as (
  select *, len(array_to_string(lw, '')) as chars,
    again
    or 2 * len(regexp_replace(line, '[^#*$%&|<>!]', '', 'g')) > len(lw)
    or (len(regexp_replace(line, '[^|»•·]', '', 'g')) >= 3 and 4 * len(regexp_replace(line, '[^|»•·]', '', 'g')) >= len(lw))
    or (len(lw) >= 6 and 2 * len(list_filter(range(2, len(lw) + 1), lambda i : lw[i] = lw[i - 1])) > len(lw))
    or {_PHRASES} as failed
  from lines),
by_doc as (
  select row_id, count(*) as n_lines, sum(failed::int) as n_failed_lines, sum(case when failed then chars else 0 end) as lost_chars, sum(again::int) as n_dup_lines
  from judged group by row_id),
figures as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(len(array_to_string(w, '')) as bigint) as word_chars,
    cast(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
    cast(coalesce(r.n, 0) as bigint) as n_repeat_words, cast(coalesce(n_lines, 0) as bigint) as n_lines,
    cast(coalesce(n_failed_lines, 0) as bigint) as n_failed_lines, cast(coalesce(lost_chars, 0) as bigint) as lost_chars
  from split left join repeats r using (row_id) left join by_doc using (row_id))
select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost_chars <= 50 * word_chars as kept
from figures"""


def op10_byte_bpe(spark, sf_dir):
    return bpe_scan.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES["op10_byte_bpe"] = op10_byte_bpe


def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES["op5_packing"] = op5_packing


def op9_simhash(spark, sf_dir):
    return simhash_tiles.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES["op9_simhash"] = op9_simhash


def op4_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.learnable(documents))
    return language_id.identify(documents, model).withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)


QUERIES["op4_language_id"] = op4_language_id


def op2_toxicity(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels.where(crc_mod(labels["doc_id"], 5) != 0))
    return toxicity.score(documents, model).withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)


QUERIES["op2_toxicity"] = op2_toxicity


def op8_html_text(spark, sf_dir):
    return html_blocks.extract(table(spark, sf_dir, "pages"))


QUERIES["op8_html_text"] = op8_html_text


def op7_embedding_dedup(spark, sf_dir):
    return itq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES["op7_embedding_dedup"] = op7_embedding_dedup


def op6_warc(spark, sf_dir):
    return warc_bundles.round_trip(table(spark, sf_dir, "pages"))


QUERIES["op6_warc"] = op6_warc
ORACLES["op6_warc"] = """
with p as (select page_id, coalesce(html, '') as payload from pages),
q as (select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes, sha1(payload) as payload_digest from p),
r as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as top from q)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from r"""


def op3_token_counts(spark, sf_dir):
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES["op3_token_counts"] = op3_token_counts
