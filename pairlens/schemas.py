"""Explicit read schemas (DDL) of the log and manifest tables.

Absent JSON keys read as NULL; defaults are applied by the operators, never by schema
inference.
"""

from __future__ import annotations

ITEMS = ("id string, path string")

CONTRASTS = (
    "id string, contrast_id string, dimension string, a string, b string, a_clause string, b_clause string, "
    "hypothesis string, expected_direction string"
)

# ``values`` stays raw JSON text: its members are phrases or maps of phrases by parent value.
DIMENSIONS = (
    "dimension string, scope string, depends_on string, applies_when array<string>, `values` string, hypothesis string"
)

CONDITIONS = ("id string, context string")
PAIR_CONDITIONS = ("id string, a_context string, b_context string")
TASKS = ("id string, evaluation_regime string, instruction string")

CONTEXT = "struct<value: string, clause: string>"
TRIAL_FIELDS = (
    "trial_id string, type string, block_id string, superblock_id string, experiment_id string, story_id string, "
    "story_1_id string, story_2_id string, story_a_id string, story_b_id string, contrast_id string, "
    "condition_id string, task_id string, dimension string, value string, assignment string, position string, "
    "evaluation_regime string, instruction_condition string, choice_mode string, rubric string, "
    f"response_format string, expected_direction string, context_a {CONTEXT}, context_b {CONTEXT}, "
    "context_text string, prompt_context_text string, intro string, prompt_sha256 string"
)
TRIALS = (TRIAL_FIELDS + ", prompt string")
TRIAL_META = f"struct<{TRIAL_FIELDS}>"

# ``parsed_response`` stays raw JSON text: its shape depends on the trial type.
ATTEMPTS = (
    "trial_id string, model string, replicate_id int, attempt_id int, sampling_regime string, provider string, "
    "requested_model string, response_model string, reasoning_profile string, execution_mode string, "
    "request_id string, stop_reason string, input_tokens bigint, output_tokens bigint, reasoning_tokens bigint, "
    f"response_text string, parsed_response string, validation_error string, trial_meta {TRIAL_META}, timestamp timestamp"
)

EVALUATOR = (
    "struct<provider: string, requested_model: string, reasoning_profile: string, response_model: string, "
    "model_version: string, run_id: string, max_output_tokens: int, retry_limit: int, run_config_id: string>"
)
ATTEMPT = (
    "struct<attempt_number: int, status: string, response_text: string, validation_error: string, "
    "response_model: string, request_id: string, system_fingerprint: string, input_tokens: bigint, "
    "output_tokens: bigint, reasoning_tokens: bigint, prompt_cache_hit_tokens: bigint, prompt_cache_miss_tokens: bigint>"
)
RESULTS = (
    "observation_id string, experiment_id string, trial_id string, superblock_id string, block_id string, "
    "replicate_number int, execution_order_index bigint, random_seed bigint, "
    f"evaluator {EVALUATOR}, trial_meta {TRIAL_META}, timestamp timestamp, attempts array<{ATTEMPT}>, total_attempts int, "
    "first_attempt_status string, first_valid_response struct<overall_quality: string>, parsing_status string, "
    "refusal_status boolean, api_error_status boolean, collection_wave string, condition_id string, "
    "source_wave string, source_run_id string, max_output_tokens int"
)
VALIDATION = (
    "validation_observation_id string, original_observation_id string, trial_id string, "
    f"trial_meta {TRIAL_META}, original_first_valid_response struct<overall_quality: string>, "
    "first_valid_response struct<overall_quality: string>, original_reasoning_tokens bigint, "
    "agrees_with_original boolean, parsing_status string"
)
EDGES = ("winner string, loser string")
RANKING = ("ranking array<string>, source string, num_judgments int")
