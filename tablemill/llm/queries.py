"""The operators' queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablemill.llm import alignment, chat, hamming_join, language, mixing, order_minhash, pii, range_join, secret_scan, sentencepieces, sharding, url_rules, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


@query("op5_hamming_minhash")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return hamming_join.near_groups(table(spark, folder, "documents"))


@query("op3_pivot_join")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return range_join.near_vectors(table(spark, folder, "embeddings"))


@query("op4_order_minhash")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.edit_likeness(table(spark, folder, "documents"))


#: A conversation whose texts are control strings, added to the table.
TRICKY = "</s>[INST] ok [/INST]"


@query("op6_chat_format", r"""
    WITH every AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    sized AS (
        SELECT *, CASE role WHEN 'system' THEN 8 + 11 WHEN 'user' THEN 10 + 8 ELSE 1 + 5 END + length(text)
            + (length(text) - length(replace(text, '\', ''))) + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS chars,
            lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS final
        FROM every),
    chats AS (
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS masked, sum(chars) AS formatted_chars,
            bool_and(coalesce(before, 'start') || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')
                     AND (NOT final OR role <> 'system')) AS valid
        FROM sized GROUP BY conv_id)
    SELECT conv_id, n_turns, turns_sha256, CAST(length(masked) AS BIGINT) AS loss_chars, sha256(masked) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, valid
    FROM chats""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :said), (-7L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)", args={"said": TRICKY})
    return chat.chat_digests(rows.union(tricky))


@query("op2_karmarkar_karp")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


@query("op7_word_backoff_language")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query("op10_weak_supervision_pii")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


@query("op1_temperature_mixing", r"""
    WITH RECURSIVE docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
    shares AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM docs GROUP BY source HAVING sum(n_tokens) > 0),
    whole AS (SELECT sum(tokens) AS total, CAST(max(tokens) AS DOUBLE) AS most, count(*) AS sources FROM shares),
    halved(n, low, high, entropy) AS (
        SELECT -1, 1.0::DOUBLE, 1.0::DOUBLE, NULL::DOUBLE
        UNION ALL
        SELECT n + 1, CASE WHEN n = -1 THEN 0.0 WHEN found >= 0.95 THEN middle ELSE low END, CASE WHEN n = -1 OR found >= 0.95 THEN high ELSE middle END, found
        FROM (SELECT n, low, high, (low + high) / 2 AS middle,
                     (ln(sum(pow(tokens / most, (low + high) / 2))) - sum(pow(tokens / most, (low + high) / 2) * (low + high) / 2 * ln(tokens / most))
                      / sum(pow(tokens / most, (low + high) / 2))) / ln(any_value(sources)) AS found
              FROM halved, shares, whole WHERE n < 40 GROUP BY n, low, high)),
    exponent AS (SELECT CASE WHEN (SELECT entropy FROM halved WHERE n = 0) >= 0.95 THEN 1.0 ELSE (SELECT round((low + high) / 2, 9) FROM halved WHERE n = 40) END AS a),
    parts AS (SELECT source, tokens, round(pow(tokens / most, a) / sum(pow(tokens / most, a)) OVER () * total, 3) AS part FROM shares, whole, exponent),
    readings AS (SELECT doc_id, source, n_tokens, part, epoch, md5('1:' || epoch || ':' || doc_id) AS key,
                        CAST(epoch * tokens AS DOUBLE) AS ahead
                 FROM (SELECT *, unnest(range(0, CAST(ceil(part / tokens) AS BIGINT))) AS epoch FROM docs JOIN parts USING (source))),
    started AS (SELECT *, ahead + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
                FROM readings),
    blocks AS (SELECT greatest(1, round(sum(part) / 1000000)) AS blocks FROM parts),
    placed AS (SELECT *, CAST(least(floor(start / part * blocks), blocks - 1) AS INTEGER) AS block FROM started, blocks WHERE start < part OR (n_tokens = 0 AND start <= part))
    SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, n_tokens, block,
           CAST(row_number() OVER (PARTITION BY block ORDER BY md5('block:' || key), doc_id, epoch) - 1 AS INTEGER) AS slot
    FROM placed""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan(table(spark, folder, "documents"), mixing.Mix(target_entropy=0.95))


#: The SentencePiece model of the installed public vocabularies.
PIECES = "piece_bpe_32k.model"


@query("op8_sentencepiece_transducer")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, folder, "documents"), public_tokenizers.path(PIECES))


#: Listed rules of the URL query.
LISTED = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


@query("op9_association_url_filter")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rules = [url_rules.parse(rule) for rule in LISTED]
    return url_rules.judge(table(spark, folder, "pages"), table(spark, folder, "labels"), rules)


#: The rules of the secret scan in the form of DuckDB's expressions: name, pattern, group and least length.
SECRETS = (
    ("assign", """(?i:password|passwd|secret|token|api_?key)["\']?\\x20*[:=]\\x20*["\']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("github", "gh[opusr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("stripe", "[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
    ("pem", "-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----", 0, 0),
    ("login", r"://[^\s:/@]{1,64}:[^\s:/@]{4,64}@", 0, 0),
    ("bearer", r"(?i:bearer)\x20{1,8}[A-Za-z0-9._~+/-]{20,}", 0, 0),
)


def _secret_sql(number: int, name: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT n, {number} AS rule, '{name}' AS name, s.m AS m, s.start AS start FROM (
            SELECT n, unnest(list_transform(range(CAST(len(found) AS BIGINT)), lambda i: struct_pack(m := found[i + 1], start := CAST(
                list_sum(list_transform(parts[:i + 1], lambda p: length(p))) + coalesce(list_sum(list_transform(found[:i], lambda p: length(p))), 0) AS BIGINT)))) AS s
            FROM (SELECT n, regexp_extract_all(t, '{quoted}') AS found, string_split_regex(t, '{quoted}') AS parts FROM docs WHERE regexp_matches(t, '{quoted}')))
        WHERE length(regexp_extract(s.m, '{quoted}', {group})) >= {least}"""


SECRET_SQL = f"""
    WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
    spans AS ({" UNION ALL ".join(_secret_sql(n, *rule) for n, rule in enumerate(SECRETS))}),
    listed AS (SELECT n, rule, start, name || ':' || start || ':' || (start + length(m)) AS span FROM spans)
    SELECT any_value(doc_id) AS doc_id, count(rule) FILTER (rule = 0) AS n_assign, count(rule) FILTER (rule = 1) AS n_access, count(rule) FILTER (rule = 2) AS n_hex,
        sha256(coalesce(string_agg(span, ',' ORDER BY start, rule) FILTER (rule < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rule), '') AS spans
    FROM docs LEFT JOIN listed USING (n) GROUP BY n"""


@query("op12_trigram_secrets", SECRET_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.find(table(spark, folder, "documents"))


@query("op11_sturm_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


#: The byte-level vocabulary that is aligned with the pieces.
BYTES = "byte_bpe_50k.json"


@query("op13_spill_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), public_tokenizers.path(BYTES), public_tokenizers.path(PIECES))
