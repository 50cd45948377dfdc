"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import conversation_trie, decontamination, embedding_dedup, gru_lm, language_id, minhash_dedup, mixing, personal_data, quality_cnn, secret_ledger, token_files, tokenizer_alignment, warc_revisit
from pairlens.llm.components import stored
from pairlens.llm.textbatch import fold
from pairlens.session import fresh_path

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2
#: Wanted shares of tokens by domain of the labelled table; other domains keep what is left.
TARGETS = {"high": 0.9, "low": 0.06, "toxic": 0.04}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domains_of(labels: DataFrame) -> DataFrame:
    """``doc_id``, ``domain`` of labelled documents: toxic, else high or low quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), domains_of(table(spark, sf_dir, "labels")), TARGETS)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), passing=["doc_id"], with_spans=False)
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontamination.item_digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.read_tokens(spark, folder)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(fold("doc_id", 4) != 2))
    marked = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return language_id.identify(marked, model, passing=["doc_id", "held_out"])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.secrets(table(spark, sf_dir, "documents"))


def op7_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out"))
    training = docs.filter(~F.col("held_out"))
    counts = stored(gru_lm.word_counts(training), "lm-counts")
    return gru_lm.scores(docs, gru_lm.fit(training, counts), counts, passing=["doc_id", "held_out"])


def op8_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisit.resolve(warc_revisit.records_of_pages(table(spark, sf_dir, "pages")))


def op9_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    net = quality_cnn.fit(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    return quality_cnn.quality(docs, net, passing=["doc_id", "held_out"])


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = conversation_trie.turn_codes(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(*conversation_trie.with_shared_heads(codes))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES), passing=["doc_id"])


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal_data.digest(personal_data.find(docs, personal_data.fit(docs), passing=["doc_id"]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_minhash_dedup, op2_soft_mixing, op3_decontamination, op4_token_files, op5_language_id,
        op6_secret_scan, op7_gru_lm, op8_warc_revisit, op9_quality_cnn, op10_embedding_dedup,
        op11_conversation_trie, op12_tokenizer_alignment, op13_personal_data,
    )
    return {f.__name__: f for f in made}


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s
    FROM words
), shingles AS (
    SELECT doc_id, hash(x) AS h, len(s) AS n FROM (SELECT doc_id, s, unnest(s) AS x FROM sets)
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS (
    SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM sets s JOIN least USING (doc_id)
"""

_OP3 = rf"""
WITH words AS (
    SELECT doc_id, regexp_extract_all({_FOLD}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all({_FOLD}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark
), sizes AS (
    SELECT DISTINCT least(10, len(w)) AS k FROM items WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
    FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), grams AS (
    SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes)
), hits AS (
    SELECT g.doc_id, g.i, g.k, w.item_id FROM grams g JOIN windows w ON g.win = w.win AND g.k = w.k
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), owners AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN owners USING (doc_id)
"""


def _op6() -> str:
    parts = []
    for rank, rule in enumerate(secret_ledger.RULES):
        pattern = rule.pattern.replace("'", "''")
        # string_split_regex has no option for case, so the pattern carries it
        parts.append(f"""
    SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, string_split_regex(t, '{pattern}') AS gaps,
        regexp_extract_all(t, '{pattern}', 0) AS whole, regexp_extract_all(t, '{pattern}', {rule.group}) AS inner_, {rule.least} AS least
    FROM texts""")
    base = ", ".join(f"'{r.kind}'" for r in secret_ledger.BASE_RULES)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({' UNION ALL '.join(parts)}
), spans AS (
    SELECT doc_id, rank, kind, length(m) AS n, length(g) AS inner_n, least,
        list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(whole, 1, i - 1), lambda x: length(x))), 0) AS start
    FROM (SELECT *, unnest(whole) AS m, unnest(inner_) AS g, unnest(range(1, len(whole) + 1)) AS i FROM found WHERE len(whole) > 0)
), kept AS (
    SELECT doc_id, rank, kind, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS span FROM spans WHERE inner_n >= least
)
SELECT t.doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (kind IN ({base})), '')) AS base_sha256,
    coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id GROUP BY t.doc_id
"""


_OP10 = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings
), pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE a.n > 0 AND b.n > 0 AND isfinite(a.n) AND isfinite(b.n) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), reach AS (
    SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON r.other = p.a
), least AS (
    SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), counted AS (
    SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN counted USING (vec_id)
"""


_OP11 = """
WITH own AS (
    SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), bits AS (
    -- the checksum takes in a byte, then shifts eight times (-1)
    SELECT conv_id, list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))) AS b
    FROM own
), heads AS (
    SELECT conv_id, xor(list_reduce(b, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END), CAST(4294967295 AS BIGINT)) % 6 AS h
    FROM bits
), sequences AS (
    SELECT o.conv_id, list_concat(coalesce(list_slice(b.s, 1, h), []), list_slice(o.s, h + 1, len(o.s))) AS s
    FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), prefixes AS (
    SELECT conv_id, d, list_slice(s, 1, d) AS p, d = len(s) AS ends FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM sequences)
), nodes AS (
    SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM prefixes GROUP BY p, d
), counted AS (
    SELECT n.*, coalesce(k, 0) AS n_children FROM nodes n
    LEFT JOIN (SELECT list_slice(p, 1, depth - 1) AS q, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY q) c ON c.q = n.p
), sums AS (
    SELECT a.p, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * coalesce(length(b.p[b.depth].x), 0)) AS BIGINT) AS saved_tokens
    FROM counted a JOIN counted b ON b.depth >= a.depth AND list_slice(b.p, 1, a.depth) = a.p GROUP BY a.p
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM counted n JOIN sums s ON s.p = n.p LEFT JOIN nodes u ON n.depth > 0 AND u.p = list_slice(n.p, 1, n.depth - 1)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": _OP1, "op3_decontamination": _OP3, "op6_secret_scan": _op6(), "op10_embedding_dedup": _OP10, "op11_conversation_trie": _OP11,
    }
