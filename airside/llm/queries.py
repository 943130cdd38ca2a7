"""Queries and oracle SQL of the corpus operators, by name."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airside.llm import ann, fingerprint, langid, licences, lm, mixing, neardup, packing, prefix_trie, tokens, url_filter, variants, warc
from airside.llm.common import fresh_path, table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    tokens.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), [1])
    return tokens.token_digests(tokens.read_token_files(spark, path))


#: The rules of the URL filter (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


OP4_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rhost, rpath, said) AS (VALUES {values}),
fits AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.said,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS rn
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM fits WHERE rn = 1
""".format(values=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), [0], 2048, keep_ids=False)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.form_topic(F.col("text")), mixing.form_targets)
    return mixed.select("doc_id", F.coalesce("source", F.lit(mixing.MISSING)).alias("source"), F.coalesce("lang", F.lit(mixing.MISSING)).alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("mix_probability", 8).alias("probability"), F.col("mix_kept").alias("kept"))


def _op10_sql() -> str:
    """The raking, unrolled round by round."""
    steps, last = [], "c0"
    for n in range(mixing.ROUNDS):
        for d in mixing.DIMENSIONS:
            name = f"r{n}_{d}"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (weight * t_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM {last})")
            last = name
    shares = {d: f"SELECT {d}, pow(sum(tokens), {mixing.POWER}) AS p FROM cells WHERE tokens > 0 GROUP BY {d}" for d in ("source", "lang")}
    forms = ", ".join(f"('{v}', CAST({p} AS DOUBLE))" for v, p in mixing.FORM_SHARES.items())
    shares["topic"] = f"SELECT topic, p FROM (VALUES {forms}) AS f(topic, p) WHERE topic IN (SELECT topic FROM cells WHERE tokens > 0)"
    targets = ",\n".join(f"t_{d} AS MATERIALIZED (SELECT {d}, p / sum(p) OVER () AS t_{d} FROM ({shares[d]}))" for d in mixing.DIMENSIONS)
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
         CASE WHEN length(text) > 0 THEN length(text) - length(replace(text, ' ', '')) + 1 ELSE 0 END AS tokens,
         length(text) - length(replace(text, '|', '')) AS bars FROM documents),
n AS MATERIALIZED (SELECT doc_id, source, lang, tokens, CASE WHEN bars * 20 > tokens THEN 'table' WHEN tokens < 100 THEN 'brief' WHEN tokens < 500 THEN 'article' ELSE 'long' END AS topic FROM d),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tokens FROM n GROUP BY ALL),
{targets},
c0 AS MATERIALIZED (SELECT source, lang, topic, tokens, t_source, t_lang, t_topic, CAST(tokens AS DOUBLE) AS weight FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic) WHERE tokens > 0),
{", ".join(steps)},
p AS (SELECT source, lang, topic, (weight / tokens) / max(weight / tokens) OVER () AS probability FROM {last})
SELECT n.doc_id, n.source, n.lang, n.topic, n.tokens, round(coalesce(p.probability, 0), 8) AS probability,
       CAST('0x' || substr(md5(coalesce(CAST(n.doc_id AS VARCHAR), '') || ':mix'), 1, 8) AS BIGINT) / 4294967296.0 < coalesce(p.probability, 0) AS kept
FROM n LEFT JOIN p ON n.source = p.source AND n.lang = p.lang AND n.topic = p.topic
"""

def _crc32_sql(text: str) -> str:
    """SQL of the unsigned crc32 of a text's UTF-8 bytes, byte by byte over the usual table."""
    table = ", ".join(str(zlib.crc32(bytes([i ^ 255])) ^ 0xFF000000) for i in range(256))
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS UBIGINT))"
    step = f"lambda c, b: xor(c >> 8, ([{table}]::UBIGINT[])[CAST(xor(c, b) & 255 AS INT) + 1])"
    return f"xor(list_reduce({octets}, {step}, 4294967295::UBIGINT), 4294967295::UBIGINT)"


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.share_openings(turns))


OP11_SQL = f"""
WITH told AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
digests AS (
  SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS s, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS w FROM told),
lists AS (SELECT conv_id, list({{'s': s, 'w': w}} ORDER BY turn NULLS FIRST, s) AS t FROM digests GROUP BY conv_id),
openings AS (
  SELECT c.conv_id, c.t, coalesce(b.t, c.t[1:0]) AS b, CAST({_crc32_sql("CAST(c.conv_id AS VARCHAR)")} % 4 AS INT) AS h
  FROM lists c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 20),
rebuilt AS MATERIALIZED (SELECT conv_id, list_concat(b[1:h], t[h + 1:]) AS t FROM openings),
depths AS (SELECT conv_id, t, unnest(generate_series(0, len(t))) AS d FROM rebuilt),
prefixes AS MATERIALIZED (
  SELECT conv_id, d, d = len(t) AS ends, CASE WHEN d = 0 THEN 0 ELSE t[d].w END AS w, md5(array_to_string(list_transform(t[1:d], lambda x: x.s), ',')) AS key FROM depths),
nodes AS MATERIALIZED (
  SELECT d, key, min(conv_id) AS conv_id, count(*) AS n, max(w) AS w, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM prefixes GROUP BY d, key),
ways AS MATERIALIZED (SELECT p.conv_id AS member, p.d, n.conv_id FROM prefixes p JOIN nodes n USING (d, key)),
kids AS (SELECT w.d, w.conv_id, count(*) AS n FROM nodes n JOIN ways w ON w.member = n.conv_id AND w.d = n.d - 1 GROUP BY ALL),
below AS (
  SELECT w.d, w.conv_id, count(*) FILTER (k.n IS NULL) AS leaves, sum((n.n - 1) * n.w) AS saved
  FROM nodes n JOIN ways w ON w.member = n.conv_id AND w.d <= n.d LEFT JOIN kids k ON k.d = n.d AND k.conv_id = n.conv_id GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, w.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b ON b.d = n.d AND b.conv_id = n.conv_id LEFT JOIN kids k ON k.d = n.d AND k.conv_id = n.conv_id LEFT JOIN ways w ON w.member = n.conv_id AND w.d = n.d - 1
"""


def op12_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = lm.score(docs, lm.train(docs.where(~lm.held_out())))
    return scores.select("doc_id", lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_groups(variants.word_counts(table(spark, sf_dir, "documents"), spoil=True))


#: A chain of forms grows at least fivefold a step, so that 27 steps end every chain of 64-bit counts.
OP13_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS MATERIALIZED (SELECT doc, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, n, {_crc32_sql("doc || ':' || run")} AS h FROM counted),
spoilt AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, CAST(unnest(generate_series(1, length(word))) AS INT) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cuts b ON a.word = b.rest UNION SELECT b.word, a.word, a.n FROM words a JOIN cuts b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, arg_min({{'w': other, 'n': other_n}}, (-other_n, encode(other))) AS b FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 5 * w.n THEN b.w END AS form, CASE WHEN b.n >= 5 * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, 0 AS steps FROM forms
  UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, (SELECT arg_max(root, steps) FROM chain c WHERE c.word = f.word) AS root, f.n, f.n_near, f.form_n FROM forms f
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_licences": op2_licences,
    "op3_token_files": op3_token_files,
    "op4_url_filter": op4_url_filter,
    "op5_pack": op5_pack,
    "op6_neighbours": op6_neighbours,
    "op7_warc": op7_warc,
    "op8_language": op8_language,
    "op9_fingerprint": op9_fingerprint,
    "op10_mixing": op10_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lm": op12_lm,
    "op13_spelling": op13_spelling,
}
ORACLE_SQL: dict[str, str] = {"op4_url_filter": OP4_SQL, "op7_warc": OP7_SQL, "op10_mixing": _op10_sql(), "op11_prefix_trie": OP11_SQL, "op13_spelling": OP13_SQL}
