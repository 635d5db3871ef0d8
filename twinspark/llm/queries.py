"""The training-data operators as queries over the driver's tables, and their oracles in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.llm.chat_format import format_chats, read_back
from twinspark.llm.decontaminate import find_items
from twinspark.llm.exact_dedup import exact_dedup
from twinspark.llm.fill_in_middle import fill_in_middle, restored
from twinspark.llm.hard_negatives import mine_hard_negatives
from twinspark.llm.long_repeats import remove_long_repeats
from twinspark.llm.quality_rules import LEAST, RIGHT, RULES, SHARE_BAD, STEPS, TRUST, quality
from twinspark.llm.sentencepiece_bpe import encode_pieces
from twinspark.llm.shared import shared_root
from twinspark.llm.simhash import simhash_groups
from twinspark.llm.sstable import read_sstables, write_sstables
from twinspark.llm.substring_dedup import substring_dedup
from twinspark.llm.toxicity import held_out, score, train_on_labels
from twinspark.llm.url_filter import UrlRule, judge_urls, site_rule, word_rule

#: The site rules of the URL query.
SITE_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Words in a row in a host that block a page which no site rule names.
BLOCKED_WORDS = (("spam", "farm"), ("cheap", "pills"), ("free", "casino"), ("online", "casino"), ("adult", "cams"), ("xxx",), ("porn",), ("warez",))


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file. The package is installed wherever tasks run, so its path holds there too."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def url_rules() -> list[UrlRule]:
    return [*(site_rule(*r) for r in SITE_RULES), *(word_rule("block", *w) for w in BLOCKED_WORDS)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    spans = F.expr("array_join(transform(removed, x -> concat(x.start, '-', x.stop)), ' ')")
    return found.select(F.col("id").alias("doc_id"), "n_removed", "removed_chars", spans.alias("removed_spans"), F.sha2("kept_text", 256).alias("kept_sha256"))


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), keep="max")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train_on_labels(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "item_shingles", "shared_shingles", "containment")


def long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_long_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], turns.schema)
    found = read_back(format_chats(turns.unionByName(extra), vocabulary("byte_bpe_50k.json")))
    return found.select("conv_id", "n_turns", F.sha2("turns_text", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_sstables(table(spark, sf_dir, "documents"), shared_root(spark), vocabulary("word_bpe_49k.json"), end_id=1)
    return read_sstables(manifest, digest=True).select("doc_id", "start", "n_tokens", "ids_crc32")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    return piece_digests(encode_pieces(table(spark, sf_dir, "documents"), model, decode=True))


def piece_digests(decoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), url_rules()).withColumnRenamed("id", "page_id")


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return mine_hard_negatives(rows, F.col("id") % 50 == 0)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def queries() -> dict:
    return {
        "op1_simhash": simhash, "op2_substring_dedup": substrings, "op3_exact_dedup": exact, "op4_toxicity": toxicity, "op5_decontamination": decontamination,
        "op6_long_repeats": long_repeats, "op7_chat_format": chats, "op8_token_files": token_files, "op9_sentencepiece": pieces, "op10_url_filter": urls,
        "op11_hard_negatives": hard_negatives, "op12_quality_rules": quality_rules, "op13_fill_in_middle": middles,
    }


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLDED = "list_filter(string_split(regexp_replace(" + _LOWER + r", '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+', ' ', 'g'), ' '), lambda x: x <> '')"
_SHINGLES = "list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')))"

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents"""

SUBSTRING_SQL = (
    r"""
WITH units AS (
  SELECT doc_id, unnest(u) AS unit, generate_subscripts(u, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n.!?]+[\n.!?]*[ \t\n]*|[\n.!?]+[ \t\n]*') AS u FROM documents)),
placed AS (
  SELECT doc_id, pos, length(unit) AS n, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY pos) AS stop, array_to_string(f, ' ') AS form, len(f) AS words, unit
  FROM (SELECT *, """
    + _FOLDED.format("unit")
    + r""" AS f FROM units)),
worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, row_number() OVER (PARTITION BY form ORDER BY doc_id, pos) AS r
  FROM placed WHERE words > 0),
later AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM worded WHERE r > 1),
gone AS (SELECT doc_id, pos FROM (SELECT *, sum(words) OVER (PARTITION BY doc_id, run) AS total FROM later) WHERE total >= 20),
parts AS (SELECT p.*, g.pos IS NOT NULL AS removed FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos),
summed AS (
  SELECT doc_id, count(*) FILTER (WHERE removed) AS n_removed, coalesce(sum(n) FILTER (WHERE removed), 0) AS removed_chars,
         coalesce(string_agg(CAST(CAST(stop - n AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ' ' ORDER BY pos) FILTER (WHERE removed), '') AS removed_spans,
         coalesce(string_agg(unit, '' ORDER BY pos) FILTER (WHERE NOT removed), '') AS kept
  FROM parts GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars,
       coalesce(removed_spans, '') AS removed_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed s ON d.doc_id = s.doc_id"""
)

DECONTAMINATION_SQL = (
    "WITH d AS (SELECT doc_id, " + _FOLDED.format("coalesce(text, '')") + " AS w FROM documents), b AS (SELECT item_id, " + _FOLDED.format("coalesce(text, '')") + " AS w FROM benchmark), "
    "ds AS (SELECT doc_id, unnest(" + _SHINGLES + ") AS s FROM d WHERE len(w) >= 5), bs AS (SELECT item_id, unnest(" + _SHINGLES + ") AS s FROM b WHERE len(w) >= 5), "
    "bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1), hits AS (SELECT doc_id, item_id, count(*) AS k FROM ds JOIN bs USING (s) GROUP BY 1, 2) "
    "SELECT doc_id, item_id, n AS item_shingles, k AS shared_shingles, k / n AS containment FROM hits JOIN bn USING (item_id) WHERE k * 10 >= n * 8"
)

_BS = "chr(92)"
_ESCAPE = "replace(replace(replace(replace(replace({}, chr(92), chr(92) || chr(92)), '<s>', '<' || chr(92) || 's>'), '</s>', '<' || chr(92) || '/s>'), '[INST]', '[' || chr(92) || 'INST]'), '[/INST]', '[' || chr(92) || '/INST]')"
CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<s>[INST][/INST]</s>') + length({_ESCAPE.format("role")}) + length({_ESCAPE.format("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

URL_SQL = (
    """
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
hosted AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
parts AS (SELECT page_id, """
    + _LOWER.format("h")
    + """ AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM hosted),
rules(action, rh, rp) AS (VALUES """
    + ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in SITE_RULES)
    + """),
fits AS (
  SELECT page_id, action, rh || rp AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, action DESC, rh || rp) AS n
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
listed AS (SELECT * FROM fits WHERE n = 1),
worded AS (
  SELECT page_id, min(w) AS pattern FROM parts, (VALUES """
    + ", ".join(f"('{'-'.join(w)}', '^([^/]*[.-])?{'[.-]'.join(w)}([.-][^/]*)?(/|$)')" for w in BLOCKED_WORDS)
    + """) AS words(w, x)
  WHERE regexp_matches(host || path, x) GROUP BY page_id)
SELECT p.page_id, host, path, rule, CASE WHEN rule IS NULL THEN pattern END AS pattern,
       coalesce(action, CASE WHEN pattern IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM parts p LEFT JOIN listed l ON p.page_id = l.page_id LEFT JOIN worded w ON p.page_id = w.page_id"""
)


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE own = label) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND p.own <> s.label AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

_ODDS = "ln((1 - share) / share)" + "".join(f" + CASE v[{i}] WHEN 1 THEN ln(r[{i}] / (1 - r[{i}])) WHEN 0 THEN -ln(r[{i}] / (1 - r[{i}])) ELSE 0 END" for i in range(1, len(RULES) + 1))
QUALITY_SQL = (
    r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lists AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM lists)),
twice AS (SELECT doc_id, x FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows JOIN twice USING (doc_id, x), (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
measured AS (
  SELECT lists.doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
         length(text) - length(translate(text, '!?', '')) AS n_marks, length(text) - length(regexp_replace(text, '[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]', '', 'g')) AS n_punctuation,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM lists LEFT JOIN covered ON lists.doc_id = covered.doc_id),
voted AS (SELECT *, ["""
    + ", ".join(f"CASE WHEN {r.drop} THEN 0 WHEN {r.keep} THEN 1 ELSE -1 END" for r in RULES)
    + """] AS v FROM measured),
patterns AS MATERIALIZED (SELECT v, count(*) AS n FROM voted GROUP BY v),
em AS (
  SELECT 0 AS step, """
    + f"CAST({SHARE_BAD} AS DOUBLE) AS share, CAST([{', '.join([str(RIGHT)] * len(RULES))}] AS DOUBLE[]) AS r UNION ALL SELECT step + 1, (sum(n * (1 - good)) + {SHARE_BAD}) / (sum(n) + 1), ["
    + ", ".join(f"greatest({LEAST}, (sum(CASE v[{i}] WHEN 1 THEN n * good WHEN 0 THEN n * (1 - good) END) / sum(CASE WHEN v[{i}] >= 0 THEN n END) + {TRUST * RIGHT}) / {1 + TRUST})" for i in range(1, len(RULES) + 1))
    + f"] FROM (SELECT step, v, n, 1 / (1 + exp(-({_ODDS}))) AS good FROM em, patterns WHERE step < {STEPS}) GROUP BY step), "
    + "judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, "
    + f"1 / (1 + exp(-({_ODDS}))) AS good FROM voted, em WHERE step = {STEPS}) "
    + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good >= 0.5 AS kept FROM judged"
)

MIDDLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
d AS (
  SELECT *, length(text) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3,
         CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": SUBSTRING_SQL, "op3_exact_dedup": EXACT_SQL, "op5_decontamination": DECONTAMINATION_SQL, "op7_chat_format": CHAT_SQL, "op10_url_filter": URL_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_quality_rules": QUALITY_SQL, "op13_fill_in_middle": MIDDLE_SQL}
