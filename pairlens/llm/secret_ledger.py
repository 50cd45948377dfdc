"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content.  The ledger, a Parquet
table, remembers which (blob, rule version) pairs have been scanned and what was found.  A run
scans only pairs it has not seen, once per blob however many paths hold it, appends them, and
joins the findings back to all paths.  Everything is DataFrame and SQL functions.

A match's place follows from the lengths of the pieces between matches: ``split`` gives those,
``regexp_extract_all`` the matches, and a running sum over both the code-point offsets.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.components import stored
from pairlens.llm.textbatch import quoted
from pairlens.session import fresh_path


class Rule(NamedTuple):
    """A kind of secret; a match counts if ``group`` of it has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The patterns of the three base kinds.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
RULES = BASE_RULES + (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    Rule("host_token", 1, r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 0),
    Rule("url_login", 1, r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._~-]{6,64}@", 0, 0),
)

LEDGER = T.StructType([
    T.StructField("blob", T.StringType()), T.StructField("rule", T.StringType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def new_ledger(spark: SparkSession) -> str:
    """An empty ledger in the shared work folder; returns its path."""
    path = fresh_path(spark, "ledger")
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _parts(rule: Rule) -> Column:
    """Lengths of a text's gaps, matches and counted groups under one rule; null without a match or need."""
    size = lambda x: F.transform(x, F.length)
    hit = F.array_contains("todo", rule.key) & F.col("text").rlike(rule.pattern)
    return F.when(hit, F.struct(
        F.lit(rule.key).alias("rule"), F.lit(rule.least).alias("least"), size(F.split("text", rule.pattern, -1)).alias("gaps"),
        size(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))).alias("whole"),
        size(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))).alias("inner"),
    ))


def _matches(unseen: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Spans of all rules in one pass over the texts, one row per blob and rule with any: ``blob``, ``rule``, ``spans``."""
    hits = unseen.select("blob", F.explode(F.filter(F.array(*map(_parts, rules)), lambda h: h.isNotNull())).alias("h")).select("blob", "h.*")
    rows = hits.dropDuplicates(["blob", "rule"]).select("blob", "rule", "least", F.posexplode(F.arrays_zip("gaps", "whole", "inner")).alias("at", "m"))
    before = W.partitionBy("blob", "rule").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("m.gaps") + F.coalesce(F.col("m.whole"), F.lit(0))).over(before).cast("long"))
    kept = placed.filter(F.col("m.whole").isNotNull() & (F.col("m.inner") >= F.col("least")))
    spans = F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("m.whole")).cast("long").alias("start"), "end")))
    return kept.groupBy("blob", "rule").agg(spans.alias("spans"))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> int:
    """Scan the blobs of ``versions`` (``path``, ``text``) that the ledger lacks; returns how many pairs were new.

    A pair without finding is remembered with an empty list, so it is never scanned again.
    """
    spark = versions.sparkSession
    texts = versions.select("path", blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    seen = spark.read.schema(LEDGER).parquet(ledger).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    todo = texts.groupBy("blob").agg(F.min("path").alias("path")).join(seen, "blob", "left")
    todo = todo.withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
    todo = stored(todo.select("path", "blob", "todo"), "ledger-todo")
    # one path stands for a blob; a path can have several versions, so the blob is part of the key
    found = _matches(texts.join(todo, ["path", "blob"]), rules)
    pairs = todo.select("blob", F.explode("todo").alias("rule"))
    entries = pairs.join(found, ["blob", "rule"], "left").select("blob", "rule", F.coalesce("spans", F.array().cast(LEDGER["spans"].dataType)).alias("spans"))
    entries.write.mode("append").parquet(ledger)
    return pairs.count()


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``versions`` with ``found``: its spans (start, rank of the kind, end, kind) in order."""
    spark = versions.sparkSession
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
    kind = F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.kind)])
    held = spark.read.schema(LEDGER).parquet(ledger).filter(F.size("spans") > 0).filter(F.col("rule").isin([r.key for r in rules]))
    each = held.select("blob", F.explode(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[F.col("rule")].alias("rank"), s["end"].alias("end"), kind[F.col("rule")].alias("kind")))).alias("s"))
    per_blob = each.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("found"))
    rows = versions.withColumn("blob", blob_of(F.col("text"))).drop("text")
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return rows.join(per_blob, "blob", "left").withColumn("found", F.coalesce("found", empty))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and spans per row: ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``.

    The rows are the versions and the ids their paths.  Defined cases: a null text is empty; rows that
    share an id are versions of one path, each with its own findings; equal texts are scanned once; a
    null id is a path of its own; an empty table gives an empty result; other columns are ignored.
    """
    ledger = ledger or new_ledger(docs.sparkSession)
    versions = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("?")).alias("path"), F.col(quoted(text_col)).alias("text"))
    scan(versions.select("path", "text"), ledger, rules)
    base = [r.kind for r in BASE_RULES]
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return findings(versions, ledger, rules).select(
        "doc_id", *[of(k) for k in base],
        F.sha2(joined(F.filter("found", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
