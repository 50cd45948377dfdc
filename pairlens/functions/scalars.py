"""Scalar functions: ids, hashes, labels, token bins and pricing windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error text conventions of recorded attempts.
API_ERROR_PREFIX = "API call failed"
HEDGED_TEXT = "ambiguous/hedged"
RETRYABLE_HINTS = ("429", "500", "502", "503", "504", "timeout", "timed out", "connection")

# Weekday (Monday-Friday) peak windows in UTC, [start hour, end hour).
PEAK_WINDOWS_UTC = ((1, 4), (6, 10))

# Sampling regimes by kind of response format.
PLAIN_FORMAT = "plain_ab"
PLAIN_SAMPLING_REGIME = "provider_default_secondary"
DEFAULT_SAMPLING_REGIME = "low_variance_primary"
CONTEXT_TYPES = ("context_single", "context_pairwise", "context_prompt", "context_pairwise_same")


# -- labels ------------------------------------------------------------------------------


# An exact zero mean carries summation noise of about this size at most.
SUMMATION_NOISE = 1e-12


def attenuation_label(reference: Column, treated: Column, zero_tol: float = SUMMATION_NOISE) -> Column:
    """How an effect changed under the restraining instruction (descriptive only).

    An effect within ``zero_tol`` of zero counts as zero.  The default only absorbs
    summation noise, so that labels do not depend on partitioning; 0.0005 reproduces
    labels that were computed on effects rounded to three places.
    """
    tol = F.lit(float(zero_tol))
    ref_zero, treated_zero = F.abs(reference) <= tol, F.abs(treated) <= tol
    size_ratio = F.abs(treated) / F.nullif(F.abs(reference), F.lit(0.0))
    return (
        F.when(reference.isNull() | treated.isNull(), F.lit(None).cast("string"))
        .when(ref_zero & treated_zero, "no_naturalistic_effect")
        .when(ref_zero, "invariance_effect_only")
        .when(treated_zero, "attenuated")
        .when(F.signum(reference) != F.signum(treated), "reversed")
        .when(size_ratio < 0.5, "attenuated")
        .when(size_ratio > 1.5, "amplified")
        .otherwise("unchanged")
    )


def token_bin(tokens: Column) -> Column:
    """Coarse bin of a reasoning-token count."""
    return (
        F.when(tokens.isNull(), "unknown")
        .when(tokens == 0, "0")
        .when(tokens < 100, "1-99")
        .when(tokens < 500, "100-499")
        .otherwise("500+")
    )


def estimated_tokens(text: Column) -> Column:
    """One token per four characters, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.length(text) / 4))


def display_name(identifier: Column, names: Mapping[str, str]) -> Column:
    """Display name of an id from a small fixed mapping; the id itself when unnamed."""
    if not names:
        return identifier
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), identifier), identifier)


# -- recorded attempts -------------------------------------------------------------------


def is_success(answer: Column, error: Column) -> Column:
    """An attempt that parsed and validated cleanly."""
    return answer.isNotNull() & error.isNull()


def attempt_status(answer: Column, error: Column) -> Column:
    """api_error, valid, refusal or invalid; tested in that order."""
    return (
        F.when(F.coalesce(error.startswith(API_ERROR_PREFIX), F.lit(False)), "api_error")
        .when(is_success(answer, error), "valid")
        .when(F.coalesce(error.contains(HEDGED_TEXT), F.lit(False)), "refusal")
        .otherwise("invalid")
    )


def is_retryable(error: Column) -> Column:
    """Whether an error text looks like a transient transport failure."""
    lowered = F.lower(error)
    hit = F.lit(False)
    for hint in RETRYABLE_HINTS:
        hit = hit | lowered.contains(hint)
    return F.coalesce(hit, F.lit(False))


def chosen_item(choice: Column, item_a: Column, item_b: Column) -> Column:
    """The item behind a displayed letter; NULL for a tie."""
    return F.when(choice == "A", item_a).when(choice == "B", item_b)


def first_item_chosen(choice: Column, item_a: Column, item_b: Column, item_1: Column) -> Column:
    """Whether the pair's first item won; any answer but A counts as B, no answer is NULL."""
    picked = F.when(choice == "A", item_a).otherwise(item_b)
    return F.when(choice.isNotNull(), picked == item_1)


def is_forced(choice_mode: Column) -> Column:
    """Forced-choice rows; rows without a mode predate the field and are forced."""
    return F.coalesce(choice_mode, F.lit("forced")) == "forced"


# -- ids and hashes ----------------------------------------------------------------------


def observation_id(experiment: Column, evaluator: Column, trial: Column, replicate: Column) -> Column:
    """``experiment::evaluator::trial::rN``"""
    return F.concat_ws("::", experiment, evaluator, trial, F.concat(F.lit("r"), replicate.cast("string")))


def validation_id(observation: Column) -> Column:
    """Id of a repeat judgement; the suffix never occurs in a planned id."""
    return F.concat(observation, F.lit("::validation_dup"))


def run_config_id(**settings: Column) -> Column:
    """16 hex digits over the literal request settings, names in sorted order."""
    canonical = F.to_json(
        F.struct(*[settings[k].alias(k) for k in sorted(settings)]), {"ignoreNullFields": "false"}
    )
    return F.substring(F.sha2(canonical, 256), 1, 16)


def request_id(*parts: Column) -> Column:
    """``r_`` and 32 hex digits over the parts joined by the unit separator."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit("r_"), F.substring(F.sha2(F.concat_ws("\x1f", *texts), 256), 1, 32))


def text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def sampling_regime_for(response_format: Column) -> Column:
    """Default sampling regime of one trial."""
    return F.when(response_format == PLAIN_FORMAT, PLAIN_SAMPLING_REGIME).otherwise(DEFAULT_SAMPLING_REGIME)


def selection_sampling_regime(response_format: Column) -> Column:
    """Default regime of a whole selection (aggregate): plain only if every trial is plain."""
    every = F.coalesce(F.bool_and(F.coalesce(response_format == PLAIN_FORMAT, F.lit(False))), F.lit(False))
    return F.when(every, PLAIN_SAMPLING_REGIME).otherwise(DEFAULT_SAMPLING_REGIME)


def recorded_sampling_regime(trial_type: Column, regime: Column) -> Column:
    """The regime a result row carries: NULL for pilot trial types."""
    return F.when(trial_type.isin(*CONTEXT_TYPES), regime)


# -- time --------------------------------------------------------------------------------


def require_instant(df, column: str) -> None:
    """Reject wall-clock timestamps: pricing windows need instants."""
    kind = df.schema[column].dataType.simpleString()
    if kind != "timestamp":
        raise ValueError(f"{column} must be a TIMESTAMP (an instant), got {kind}")


def utc_clock(instant: Column) -> Column:
    """The UTC wall clock of an instant, whatever the session time zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def instant_from_utc_clock(clock: Column) -> Column:
    """Inverse of :func:`utc_clock`."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), clock).cast("timestamp")


def _in_window(clock: Column, window: Sequence[int]) -> Column:
    return (F.hour(clock) >= window[0]) & (F.hour(clock) < window[1])


def is_peak(instant: Column) -> Column:
    """Whether an instant falls into a weekday peak window."""
    clock = utc_clock(instant)
    inside = F.lit(False)
    for window in PEAK_WINDOWS_UTC:
        inside = inside | _in_window(clock, window)
    return (F.weekday(clock) < 5) & inside


def next_off_peak(instant: Column) -> Column:
    """The instant itself when off peak, else the end of its peak window."""
    clock = utc_clock(instant)
    weekday = F.weekday(clock) < 5
    result = F.when(~weekday, instant)
    for window in PEAK_WINDOWS_UTC:
        end = F.date_trunc("day", clock).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(window[1]))
        result = result.when(_in_window(clock, window), instant_from_utc_clock(end))
    return result.otherwise(instant)


def utc_text(instant: Column) -> Column:
    """ISO-8601 UTC with seconds and a trailing Z."""
    return F.date_format(utc_clock(instant), "yyyy-MM-dd'T'HH:mm:ss'Z'")
