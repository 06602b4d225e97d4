"""The queries of this subpackage, one opN_<name> an operator, and their SQL.

Each query applies its operator, with production parameters, to its whole table and
derives the digest columns that its contract names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fingerprints, host_rules, html_extraction, jaccard_join, language_id, mixing, quality_classifier, sentencepiece_codec, sharding, substring_dedup
from .common import crc_bucket, is_file, table

MODEL = "piece_bpe_32k.model"
#: Production parameters of the mixing query and stage.
MIX_TARGET, MIX_SEED = mixing.Target(repeats=2.0), 7


def model_path() -> str:
    """The public vocabulary, read where it lies."""
    try:
        import public_tokenizers

        return public_tokenizers.path(MODEL)
    except ImportError:
        return is_file(f"/opt/tokenizers/{MODEL}")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    learn = labels.where(F.coalesce(crc_bucket("doc_id", 3), F.lit(0)) != 1)
    weights = quality_classifier.fit(quality_classifier.labelled_sample(docs, learn))
    scored = quality_classifier.predict(docs.select("doc_id", "text"), weights)
    held_out = F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.select("doc_id", "source", "text"), MIX_TARGET, seed=MIX_SEED)
    return mixed.select("doc_id", "source", F.round("weight", 9).alias("weight"), "block", "place", "n_copies")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, and the numbers of the lines cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = substring_dedup.deduplicate(docs, removed="removed_lines")
    return left.select("doc_id", "text", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(table(spark, sf_dir, "documents"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), model_path())


def learned_languages(docs: DataFrame) -> language_id.Model:
    """The production model: rows whose crc32(doc_id as text) mod 5 is 0 are held out."""
    return language_id.fit(docs.where(crc_bucket("doc_id", 5) != 0), model_path())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs.select("doc_id", "text"), learned_languages(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extraction.extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_quality, op2_mixing, op3_substring_dedup, op4_sharding, op5_fingerprints, op6_host_rules, op7_jaccard_join, op8_sentencepiece, op9_language_id, op10_html_extraction)
    return {f.__name__: f for f in made}


def _hex(text: str, first: int, digits: int) -> str:
    return f"('0x' || substr(md5({text}), {first}, {digits}))::BIGINT"


def _op2_sql() -> str:
    digest = f"coalesce(source, chr(0)) || '/{MIX_SEED}'"
    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, ({_hex("coalesce(doc_id::VARCHAR, '')", 1, 7)} % {mixing.BLOCKS})::INT AS block,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n
  FROM documents),
totals AS (SELECT source, sum(n)::BIGINT AS source_tokens FROM docs GROUP BY source),
shares AS (SELECT source, source_tokens, source_tokens / (SELECT sum(source_tokens) FROM totals)::DOUBLE AS share FROM totals),
ends AS (SELECT max(share) / min(share) AS ratio FROM shares WHERE share > 0),
search AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN pow(ratio, 1 - (lo + hi) / 2) > {MIX_TARGET.repeats} THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN pow(ratio, 1 - (lo + hi) / 2) > {MIX_TARGET.repeats} THEN hi ELSE (lo + hi) / 2 END
  FROM search, ends WHERE step < {mixing.DEPTH * mixing.ROUNDS}),
found AS (SELECT CASE WHEN (SELECT ratio FROM ends) > {MIX_TARGET.repeats} THEN round(hi, 6) ELSE 0.0 END AS alpha
          FROM search WHERE step = {mixing.DEPTH * mixing.ROUNDS}),
powered AS (SELECT source, source_tokens, CASE WHEN share > 0 THEN pow(share, alpha) ELSE 0 END AS power FROM shares, found),
norm AS (SELECT sum(power) AS z, max(source_tokens / power) FILTER (power > 0) AS least FROM powered),
weighed AS (
  SELECT source, source_tokens, power / z AS weight,
         CASE WHEN source_tokens > 0 THEN round(power / z * (least * z) / source_tokens, 9) ELSE 1 END AS epochs
  FROM powered, norm),
rests AS (SELECT *, floor(epochs)::INT AS whole, floor((epochs - floor(epochs)) * source_tokens)::BIGINT AS rest FROM weighed),
placed AS (
  SELECT source, block, n, ((block * (({_hex(digest, 1, 7)} % {mixing.BLOCKS // 2}) * 2 + 1) + {_hex(digest, 8, 7)}) % {mixing.BLOCKS})::INT AS place,
         doc_id FROM docs),
blocks AS (SELECT source, place, sum(n) AS n FROM placed GROUP BY source, place),
upto AS (SELECT source, place, sum(n) OVER (PARTITION BY source ORDER BY place) AS upto FROM blocks),
cuts AS (
  SELECT r.source, r.weight, r.whole,
         CASE WHEN max(r.rest) > 0 THEN max(CASE WHEN u.upto <= r.rest THEN u.place + 1 ELSE 0 END) ELSE 0 END AS extra_blocks
  FROM rests r JOIN upto u ON r.source IS NOT DISTINCT FROM u.source GROUP BY r.source, r.weight, r.whole)
SELECT p.doc_id, p.source, round(c.weight, 9) AS weight, p.block, p.place,
       (c.whole + CASE WHEN p.place < c.extra_blocks THEN 1 ELSE 0 END)::INT AS n_copies
FROM placed p JOIN cuts c ON p.source IS NOT DISTINCT FROM c.source"""


def _op4_sql() -> str:
    owners = ",".join(map(str, sharding.fill(sharding.SHARDS)))
    return f"""
WITH owners AS (SELECT [{owners}] AS owner)
SELECT doc_id, slot, 'shard-' || lpad(owner[slot + 1]::VARCHAR, 3, '0') AS shard
FROM (SELECT doc_id, {_hex("coalesce(doc_id::VARCHAR, '')", 1, 12)} % {sharding.SIZE} AS slot FROM documents), owners"""


_OP6_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
            FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM docs)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n, count(DISTINCT line) AS d
          FROM (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM docs)
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
measured AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(l.n - l.d, 0)::BIGINT AS n_dup_lines, coalesce(l.n, 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN covered c USING (rid) LEFT JOIN lines l USING (rid)),
hosts AS (SELECT source AS host, count(*) AS n_docs, {", ".join(f"count(*) FILTER ({rule}) AS failed_{k}" for k, rule in host_rules.RULES.items())}
          FROM measured GROUP BY source),
moments AS (SELECT sum(n_docs)::DOUBLE AS n_all, {", ".join(f"sum(failed_{k}) / sum(n_docs)::DOUBLE AS m_{k}, var_pop(failed_{k} / n_docs::DOUBLE) AS v_{k}, avg(1 / n_docs::DOUBLE) AS s_{k}" for k in host_rules.RULES)} FROM hosts),
beyond AS (SELECT *, {", ".join(f"v_{k} - m_{k} * (1 - m_{k}) * s_{k} AS b_{k}" for k in host_rules.RULES)} FROM moments),
prior AS (SELECT {", ".join(f"m_{k}, CASE WHEN b_{k} > 1e-12 THEN least(greatest(m_{k} * (1 - m_{k}) / b_{k} - 1, 1.0), n_all) ELSE n_all END AS strength_{k}, least({host_rules.MAX_RATE}, greatest({host_rules.MIN_RATE}, m_{k} + CASE WHEN b_{k} > 1e-12 THEN {host_rules.DEVIATIONS} * sqrt(b_{k}) ELSE 0 END)) AS limit_{k}" for k in host_rules.RULES)} FROM beyond),
verdicts AS (SELECT host, {" OR ".join(f"(failed_{k} + m_{k} * strength_{k}) / (n_docs + strength_{k}) > limit_{k}" for k in host_rules.RULES)} AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({host_rules.RULES["base"]}) AS base_failed,
       NOT ({host_rules.RULES["base"]}) AND NOT rejected AS kept
FROM measured JOIN verdicts ON source IS NOT DISTINCT FROM host"""


_OP7_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM docs WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, w.b FROM reach r JOIN ways w ON w.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) m ON m.id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": _op2_sql(), "op4_sharding": _op4_sql(), "op6_host_rules": _OP6_SQL, "op7_jaccard_join": _OP7_SQL}
