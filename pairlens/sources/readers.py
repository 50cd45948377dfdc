"""Reading logs, manifests, lookup tables and texts."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens import schemas
from pairlens.functions.answers import strip
from pairlens.functions.prompts import PILOT_DELIMITER

CORRUPT = "_corrupt_record"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (local or on the cluster's file system) holds anything."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    matches = fs.globStatus(target)
    return matches is not None and len(matches) > 0


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str, keep_corrupt: bool = False) -> DataFrame:
    """One object per line; blank lines are skipped, broken lines go to ``_corrupt_record``.

    With ``keep_corrupt`` false a broken line fails the read.
    """
    if not keep_corrupt:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").json(path)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A missing file is an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_jsonl(spark, path, schema)


def read_required(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Several files that must all be there."""
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"required inputs are missing: {missing}")
    return read_jsonl(spark, list(paths), schema)


def with_arrival(rows: DataFrame) -> DataFrame:
    """Add ``ingest_order``: (file, position in file) as read.

    Take it directly on a reader, before anything that moves rows.
    """
    columns = rows.columns
    return rows.select(
        *columns,
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("ingest_order"),
    )


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """Flat result rows; ``answer`` and ``error`` are the operators' names."""
    rows = read_jsonl(spark, path, schemas.ATTEMPTS)
    return with_arrival(rows).withColumns({"answer": F.col("parsed_response"), "error": F.col("validation_error")})


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Nested result rows with the resolving attempt's text, model and answer on top."""
    rows = read_optional(spark, path, schemas.RESULTS)
    last = F.try_element_at("attempts", F.lit(-1))
    resolved = F.coalesce(F.col("parsing_status") == "resolved", F.lit(False))
    return rows.withColumns(
        {
            "last_response_text": last["response_text"],
            "response_model": F.when(resolved, last["response_model"]),
            "reasoning_tokens": last["reasoning_tokens"],
            "choice": F.col("first_valid_response.overall_quality"),
        }
    )


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows with their reading position, by which the last row of a repeated trial_id wins."""
    return with_arrival(read_jsonl(spark, path, schemas.TRIALS))


def read_contrasts(spark: SparkSession, path: str) -> DataFrame:
    """Contrast table; older files name the id column ``id``."""
    return read_jsonl(spark, path, schemas.CONTRASTS).withColumn("contrast_id", F.coalesce("contrast_id", "id")).drop("id")


def read_dimensions(spark: SparkSession, path: str) -> DataFrame:
    """Normalised dimension values.

    A value is a phrase, or a map from parent value to phrase; both become rows
    (dimension, scope, value_id, parent_value or NULL, phrase, depends_on, applies_when).
    """
    raw = read_jsonl(spark, path, schemas.DIMENSIONS)
    values = raw.select(
        "dimension", "scope", "depends_on", "applies_when",
        F.explode(F.from_json("values", "map<string,string>")).alias("value_id", "body"),
    )
    nested = F.from_json(F.when(F.col("body").startswith("{"), F.col("body")), "map<string,string>")
    # A map column must not have NULL keys, so phrases travel as (parent, phrase) structs.
    entries = F.transform(F.map_entries(nested), lambda e: F.struct(e["key"].alias("parent_value"), e["value"].alias("phrase")))
    plain = F.array(F.struct(F.lit(None).cast("string").alias("parent_value"), F.col("body").alias("phrase")))
    return values.select(
        "dimension", "scope", "value_id", "depends_on", "applies_when",
        F.explode(F.when(nested.isNull(), plain).otherwise(entries)).alias("e"),
    ).select("dimension", "scope", "value_id", "e.parent_value", "e.phrase", "depends_on", "applies_when")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file texts, stripped, with their path."""
    rows = spark.read.option("wholetext", True).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file_path"), strip(F.col("value")).alias("text"))


def read_items(spark: SparkSession, manifest_path: str, base_dir: str) -> DataFrame:
    """Corpus: the item manifest joined to its text files by their path below ``base_dir``."""
    items = read_jsonl(spark, manifest_path, schemas.ITEMS)
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(base_dir)
    base = base_dir.rstrip("/")
    below = F.expr("substring(__f, instr(__f, __b) + length(__b))")
    texts = rows.select(F.col("_metadata.file_path").alias("__f"), F.lit(base + "/").alias("__b"), strip(F.col("value")).alias("text"))
    texts = texts.select(F.regexp_replace(below, "^/+", "").alias("__k"), "text")
    keyed = items.withColumn("__k", F.regexp_replace("path", "^(?:\\./|/)+", ""))
    return keyed.join(texts, "__k", "left").select(F.col("id").alias("item_id"), "text")


def delimiter_rejects(items: DataFrame) -> DataFrame:
    """Items whose text contains the prompt delimiter (must be none)."""
    return items.where(F.col("text").contains(PILOT_DELIMITER)).select("item_id")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return read_optional(spark, path, schemas.EDGES)


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RANKING).option("multiLine", True).json(path)


def parse_pilot_ids(rows: DataFrame, column: str = "trial_id") -> DataFrame:
    """Recover pilot metadata from ``__``-separated ids; other shapes get NULL trial_type."""
    part = F.split(F.col(column), "__")
    size, kind = F.size(part), part[0]
    single = (kind == "single") & (size == 4)
    pair = (kind == "comparison") & (size == 4)
    control = (kind == "comparison_control") & (size == 3)

    def at(i: int):
        return F.get(part, F.lit(i))

    return rows.withColumns(
        {
            "trial_type": F.when(single | pair | control, kind),
            "story_a": F.when(single | pair | control, at(1)),
            "story_b": F.when(pair, at(2)).when(control, at(1)),
            "condition": F.when(single, at(2)).when(pair, at(3)).when(control, at(2)),
            "task": F.when(single, at(3)),
        }
    )


# -- study configuration -------------------------------------------------------------------


@dataclass(frozen=True)
class Evaluator:
    evaluator_id: str
    provider: str
    requested_model: str
    reasoning_profile: str
    role: str


@dataclass(frozen=True)
class StudyConfig:
    """Frozen design settings (a small driver-side document)."""

    experiment_id: str
    corpus_id: str
    evaluators: tuple[Evaluator, ...]
    treatment_replicate_count: int
    baseline_replicate_count: int
    random_seed: int
    bootstrap_draws: int
    equivalence_margin: float
    retry_limit: int
    status: str
    raw: Mapping[str, object] = field(repr=False)

    @property
    def primary(self) -> Evaluator:
        return next(e for e in self.evaluators if e.role == "primary")

    def evaluator_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(e.evaluator_id, e.provider, e.requested_model, e.reasoning_profile, e.role) for e in self.evaluators],
            "evaluator_id string, provider string, requested_model string, reasoning_profile string, role string",
        )

    def settings(self, unit_kind: str) -> dict[str, object]:
        """Settings every result row of a unit kind must agree with."""
        kinds = {"treatment": self.treatment_replicate_count, "baseline": self.baseline_replicate_count}
        if unit_kind not in kinds:
            raise ValueError(f"unit_kind must be one of {sorted(kinds)}, got {unit_kind!r}")
        return {
            "provider": self.primary.provider,
            "requested_model": self.primary.requested_model,
            "reasoning_profile": self.primary.reasoning_profile,
            "replicates": kinds[unit_kind],
            "random_seed": self.random_seed,
            "retry_limit": self.retry_limit,
        }


def read_study_config(spark: SparkSession, path: str) -> StudyConfig:
    text = spark.read.option("wholetext", True).text(path).first()["value"]
    raw = json.loads(text)
    evaluators = [raw["primary_evaluator"], *raw.get("replication_evaluators", [])]
    names = ("evaluator_id", "provider", "requested_model", "reasoning_profile", "role")
    return StudyConfig(
        evaluators=tuple(Evaluator(**{n: e[n] for n in names}) for e in evaluators),
        raw=raw,
        **{n: raw[n] for n in StudyConfig.__dataclass_fields__ if n not in ("evaluators", "raw")},
    )
