"""Queries of this subpackage's operators and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fillin, htmltext, langid, mixing, neardup, neighbours, quality, secrets, simhash, tokenbin, toxicity, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(_table(spark, sf_dir, "pages"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op4_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), neardup.Plan(k=3, percent=85))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_table(spark, _table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("finish")


OP7_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce('0' || source, '1') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT s, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY s),
weighted AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY s) - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM sources),
timed AS (
  SELECT *, cap / weight AS full_at,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS t
  FROM weighted WINDOW before AS (ORDER BY cap / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT max(t) AS c FROM timed WHERE t <= full_at),
goals AS (
  SELECT s, source_size, weight, CASE WHEN c IS NULL OR c >= full_at THEN cap ELSE c * weight END AS target FROM timed, cut),
placed AS (
  SELECT row_number() OVER () AS i, doc_id, s, size, source_size, target, weight,
         sum(size) OVER (PARTITION BY s ORDER BY shuffled, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM docs JOIN goals USING (s)),
packets AS (
  SELECT i, s, (start + k * source_size + least(j * 128, size)) / weight AS finish, least(128, size - (j - 1) * 128) AS words
  FROM (SELECT *, unnest(range(1, CAST(ceil(size / 128.0::DOUBLE) AS BIGINT) + 1)) AS j FROM placed, (VALUES (0), (1)) p(k) WHERE size > 0)),
served AS (
  SELECT i, greatest(0, least(words, (SELECT floor(sum(source_size) * 1.5::DOUBLE) FROM goals) - (sum(words) OVER (ORDER BY finish, s ROWS UNBOUNDED PRECEDING) - words))) AS words
  FROM packets)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM placed LEFT JOIN (SELECT i, sum(words) AS taken FROM served GROUP BY i) USING (i)
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_table(spark, sf_dir, "documents"))


#: CRC-32 byte by byte with the table of its reflected polynomial, near words by what is left without one character.
OP11_SQL = """
WITH RECURSIVE bits(b, c, k) AS (
  SELECT b, b, 0 FROM range(256) r(b)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(CAST(c AS BIGINT) ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(named, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)) AS u FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(u, lambda x: CAST(x AS BIGINT))), lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) AS h FROM bytes, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(neg := -m, near := near)) AS b FROM near GROUP BY word),
formed AS (
  SELECT word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN -b.neg >= 10 * n THEN b.near END AS form, CASE WHEN -b.neg >= 10 * n THEN -b.neg END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain(word, top, k) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN formed f ON f.word = c.top WHERE f.form IS NOT NULL)
SELECT word, form, arg_max(top, k) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n
FROM formed JOIN chain USING (word) GROUP BY word, form
"""


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fillin.digests(_table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS one, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS two,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM docs),
cut AS (
  SELECT *, substr(t, 1, least(one, two)) AS prefix, substr(t, least(one, two) + 1, abs(one - two)) AS middle, substr(t, greatest(one, two) + 1) AS suffix FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(one, two) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(one - two) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontaminate, op2_main_text, op3_secrets, op4_multiprobe, op5_minmax_dedup, op6_tokens, op7_mixing, op8_quality, op9_language, op10_toxicity, op11_spelling_variants, op12_simhash, op13_fill_in_middle)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": OP7_SQL, "op11_spelling_variants": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
