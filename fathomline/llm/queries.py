"""The registered queries of the subpackage, and the SQL they must equal where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.catalog.base import Catalog, table
from fathomline.llm import alignment, benchmark, chats, jaccard, lines, pages, pieces, quality, repair, separators, substrings, url_filters, warc

C = Catalog()

# The rules of the contract, and the domain labels on the block list.
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
# Files of public tokenizers that every executor has.
RANKS, PIECES = "/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/piece_bpe_32k.model"
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
LISTED = "(^|\\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\\."


@C.add("op1_quality_rules")
def op1_quality_rules(spark, folder):
    rules = quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rules.drop("ratio_sum", "n_grams")


@C.add("op2_sentencepiece")
def op2_sentencepiece(spark, folder):
    return pieces.encode_pieces(table(spark, folder, "documents"), PIECES)


@C.add("op3_ngram_jaccard", r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS s
  FROM worded, unnest(CASE WHEN len(words) > 3 THEN range(1, len(words) - 2) WHEN len(words) > 0 THEN [1] ELSE [] END) AS t(i)
), sized AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, least(d.doc_id, min(r.y)) AS component_id
FROM documents d LEFT JOIN sized s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id
""")
def op3_ngram_jaccard(spark, folder):
    return jaccard.near_duplicates(table(spark, folder, "documents"))


@C.add("op4_warc", """
WITH told AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), ranked AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS winner FROM told
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < winner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < winner THEN winner END AS refers_to
FROM ranked
""")
def op4_warc(spark, folder):
    return warc.archive_and_read(spark, table(spark, folder, "pages"))


@C.add("op5_token_counts")
def op5_token_counts(spark, folder):
    return separators.count_documents(spark, table(spark, folder, "documents"), RANKS)


@C.add("op6_url_filters", r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0
      THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0
      THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.') THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
""")
def op6_url_filters(spark, folder):
    return url_filters.filter_urls(table(spark, folder, "pages"), RULES, F.col("host").rlike(LISTED))


@C.add("op7_substring_dedup", r"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS run
  FROM worded, unnest(CASE WHEN len(words) >= 50 THEN range(1, len(words) - 48) ELSE [] END) AS t(i)
), repeated AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY run) AS first FROM windows) WHERE first < doc_id
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM repeated
), hit AS (
  SELECT doc_id, list(k) AS ks, count(*) AS n FROM covered GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(w.words) AS n_words, coalesce(h.n, 0) AS n_removed,
    CASE WHEN h.n IS NULL THEN w.words
      ELSE list_transform(list_filter(range(1, len(w.words) + 1), lambda k: NOT list_contains(h.ks, k)), lambda k: w.words[k]) END AS words
  FROM worded w LEFT JOIN hit h ON w.doc_id IS NOT DISTINCT FROM h.doc_id
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(words, ' '), '')) AS kept_sha256
FROM kept
""")
def op7_substring_dedup(spark, folder):
    return substrings.removal_digest(table(spark, folder, "documents"))


@C.add("op8_chat_formatting")
def op8_chat_formatting(spark, folder):
    turns = chats.with_planted(table(spark, folder, "conversations"))
    return chats.read_back(chats.format_chats(turns))


@C.add("op9_html_extraction")
def op9_html_extraction(spark, folder):
    return pages.extract_pages(table(spark, folder, "pages"))


@C.add("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark, folder):
    hits = benchmark.find_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return benchmark.digest(hits)


@C.add("op11_structure_repair")
def op11_structure_repair(spark, folder):
    turns = table(spark, folder, "conversations")
    return repair.repair_digest(repair.damaged(turns), turns)


@C.add("op12_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, k, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, generate_subscripts(own, 1) AS k, unnest(own) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents))
), firsts AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT l.*, coalesce(doc_id > first, false) AS gone FROM lines l LEFT JOIN firsts USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""")
def op12_line_dedup(spark, folder):
    return lines.line_digest(table(spark, folder, "documents"))


@C.add("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark, folder):
    return alignment.alignment_digest(table(spark, folder, "documents"), BYTE_LEVEL, PIECES)
