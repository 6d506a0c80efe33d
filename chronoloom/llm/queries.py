"""The thin queries of the corpus operators over the given tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocation, exact_dedup, jaccard_join, langid, lm, mixing, mpeg_audio, packing, preference, sentencepiece_wfst, spelling, toxicity, url_reputation
from .url_reputation import SECOND_LEVEL, WILDCARD, Rule

RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.remainder("doc_id", 3) == 1)
    filters = langid.train(docs.filter("NOT held_out"))
    return langid.predict(docs, filters, keep=("doc_id", "held_out"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_wfst.digests(_table(spark, sf_dir, "documents"), sentencepiece_wfst.read_model())


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_documents(_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.remainder("doc_id", 7) == 2)
    return lm.scores(docs, lm.read_vocabulary())


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = langid.remainder("doc_id", 5)
    learned = _table(spark, sf_dir, "labels").filter(fold != 0).select("doc_id", "toxic").filter("toxic IS NOT NULL")
    model = toxicity.fit(docs.join(learned, "doc_id"), calibrates=fold == 4)
    scored = toxicity.score(docs.withColumn("held_out", fold == 0), model, keep=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr("toxic = 1 OR quality = 0").alias("bad"))
    judged = url_reputation.judge_urls(_table(spark, sf_dir, "pages"), outcomes, RULES)
    return judged.withColumns({"bad_rate": F.round("bad_rate", 6), "bad_lower": F.round("bad_lower", 6)})


def op8_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.corrupted_pairs(_table(spark, sf_dir, "conversations"))
    return pairs.withColumns({c: preference.mask_text(c) for c in ("chosen_mask", "rejected_mask")})


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_features(mpeg_audio.media_column(_table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed_pieces(_table(spark, sf_dir, "documents"), packing.read_tokenizer())
    length = F.expr("CAST(length(ids) DIV 4 AS BIGINT)")
    return pieces.select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_id")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_sentencepiece, op3_ngram_jaccard_join, op4_lm_scoring, op5_source_mixing, op6_toxicity, op7_url_reputation, op8_preference_chat, op9_exact_dedup, op10_mpeg_audio, op11_spelling_variants, op12_packing, op13_collocations]
    return {f.__name__: f for f in found}


_STRENGTH = """
{level}_sums AS (
  SELECT count(*) AS k, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS nn, sum(n * (bad / n) * (bad / n)) AS npp FROM {level}s WHERE n > 0
), {level}_ms AS (
  SELECT *, (npp - n * (bad / n) * (bad / n)) / (k - 1) AS between_ms, (bad - npp) / (n - k) AS within_ms, (n - nn / n) / (k - 1) AS typical
  FROM {level}_sums WHERE k >= 2 AND n > k AND bad > 0 AND bad < n
), {level}_rho AS (
  SELECT least(greatest(CASE WHEN between_ms + (typical - 1) * within_ms > 0
    THEN (between_ms - within_ms) / (between_ms + (typical - 1) * within_ms) ELSE 1.0 END, 1e-4), 0.999) AS rho FROM {level}_ms
), {level}_m AS (SELECT coalesce((SELECT (1 - rho) / rho FROM {level}_rho), 1e4) AS m)
"""

_URL_SQL = f"""
WITH base AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM base
), known AS (
  SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY doc_id
), counted AS (
  SELECT host, CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad,
    regexp_replace(regexp_extract(regexp_replace(host, '^.*@', ''), '^(\\[[^\\]]*\\]?|[^:]*)', 1), '\\.+$', '') AS name
  FROM split LEFT JOIN known USING (page_id) GROUP BY host
), parts AS (
  SELECT *, regexp_matches(name, '^\\[|^[0-9]+(\\.[0-9]+){{3}}$') AS address, string_split(name, '.') AS labels,
    list_aggregate(string_split(name, '.')[-2:], 'string_agg', '.') AS two
  FROM counted
), hosts AS (
  SELECT host, n, bad, CASE WHEN address THEN 'address' WHEN deep THEN two ELSE labels[-1] END AS suffix,
    CASE WHEN address THEN name WHEN deep THEN list_aggregate(labels[-3:], 'string_agg', '.') ELSE two END AS domain
  FROM (SELECT *, two IN {SECOND_LEVEL} OR (labels[-1] IN {WILDCARD} AND two NOT IN ('www.ck')) AS deep FROM parts)
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix
), suffixs AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix
), everywhere AS (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0.0 END AS rate FROM suffixs
), {_STRENGTH.format(level="suffix")}, {_STRENGTH.format(level="domain")}, {_STRENGTH.format(level="host")}
, s AS (SELECT suffix, (bad + m * rate) / (n + m) AS above FROM suffixs, suffix_m, everywhere
), d AS (SELECT domain, (bad + m * above) / (n + m) AS above FROM domains JOIN s USING (suffix), domain_m
), h AS (SELECT host, bad + m * above AS a, n - bad + m * (1 - above) AS b FROM hosts JOIN d USING (domain), host_m
), scored AS (SELECT host, a / (a + b) AS mean, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower FROM h
), ruled AS (
  SELECT page_id, host, path, mean, lower, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM split JOIN scored USING (host)
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN lower > 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(mean, 6) AS bad_rate, round(lower, 6) AS bad_lower
FROM ruled
"""

_CHAT_SQL = """
WITH said AS (
  SELECT conv_id AS pair_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), sized AS (SELECT pair_id, count(*) AS turns FROM said GROUP BY pair_id
), cut AS (
  SELECT pair_id, pos AS cut_at FROM said WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY md5('preference-cut:' || pair_id || ':' || (pos - 1)), pos) = 1
), given AS (
  SELECT xor(pair_id, 1) AS pair_id, role, text FROM said WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY md5('preference-give:' || pair_id || ':' || (pos - 1)), pos) = 1
), ends AS (
  SELECT pair_id, coalesce(cut_at, turns + 1) AS cut_at, g.role, g.text FROM sized LEFT JOIN cut USING (pair_id) JOIN given g USING (pair_id)
), t AS (
  SELECT pair_id, 'chosen' AS side, pos, role, text FROM said
  UNION ALL SELECT pair_id, 'rejected', pos, s.role, s.text FROM said s JOIN ends USING (pair_id) WHERE pos < cut_at
  UNION ALL SELECT pair_id, 'rejected', cut_at, role, text FROM ends
), o AS (
  SELECT *, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) AS head,
    replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS body
  FROM t
), c AS (SELECT * FROM o WHERE side = 'chosen'), r AS (SELECT * FROM o WHERE side = 'rejected'),
sides AS (
  SELECT pair_id, count(*) FILTER (side = 'chosen') AS nc, count(*) FILTER (side = 'rejected') AS nr FROM o GROUP BY pair_id
), differ AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(coalesce(c.pos, r.pos)) AS first_pos
  FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.pos = r.pos
  WHERE c.pos IS NULL OR r.pos IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text
  GROUP BY 1
), n AS (
  SELECT pair_id, nc, nr, coalesce(first_pos - 1, nc) AS n FROM sides LEFT JOIN differ USING (pair_id)
), after AS (
  SELECT o.*, n.n, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY o.pair_id, side ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM o JOIN n ON o.pair_id = n.pair_id WHERE pos > n.n
), rest AS (
  SELECT pair_id, side, string_agg(head || body, '' ORDER BY pos) AS completion,
    string_agg(CAST(start AS VARCHAR) || '+' || CAST(length(body) AS VARCHAR), ',' ORDER BY pos) FILTER (role = 'assistant') AS mask
  FROM after GROUP BY pair_id, side
), prompts AS (
  SELECT o.pair_id, string_agg(head || body, '' ORDER BY pos) AS prompt
  FROM o JOIN n ON o.pair_id = n.pair_id WHERE side = 'chosen' AND pos <= n.n GROUP BY o.pair_id
)
SELECT n.pair_id, CASE WHEN nc = 0 THEN 'no_chosen' WHEN nr = 0 THEN 'no_rejected' WHEN n.n = nc AND n.n = nr THEN 'identical'
    WHEN n.n = nc THEN 'chosen_is_prefix' WHEN n.n = nr THEN 'rejected_is_prefix' ELSE 'pair' END AS status,
  CAST(n.n AS BIGINT) AS n_prompt_turns, coalesce(prompt, '') AS prompt,
  coalesce(a.completion, '') AS chosen, coalesce(b.completion, '') AS rejected,
  coalesce(a.mask, '') AS chosen_mask, coalesce(b.mask, '') AS rejected_mask
FROM n LEFT JOIN prompts USING (pair_id)
  LEFT JOIN rest a ON a.pair_id = n.pair_id AND a.side = 'chosen'
  LEFT JOIN rest b ON b.pair_id = n.pair_id AND b.side = 'rejected'
"""

_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_source_mixing": mixing.MIX_SQL.replace("{docs}", "documents"),
        "op7_url_reputation": _URL_SQL,
        "op8_preference_chat": _CHAT_SQL,
        "op9_exact_dedup": _DEDUP_SQL,
        "op13_collocations": collocation.COLLOCATION_SQL.replace("{docs}", "documents"),
    }
