"""Parsing and validating recorded answers with built-in expressions only.

``with_choice`` and ``with_validation`` add ``answer`` and ``error`` (a short code,
NULL when valid) to a table.  They work in staged projections, so each intermediate
value is computed once per row.  JSON goes through VARIANT so that integers,
decimals, strings and booleans stay distinguishable.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters trimmed around an answer, whitespace, hedge markers, fields.
EMPHASIS_CHARS = "*_`'\"\u201c\u201d\u2018\u2019 \t\r\n"
WHITESPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
HEDGE_MARKERS = (
    "tie", "both", "neither", "unsure", "not sure", "no preference",
    "can't decide", "cannot decide", "can't tell", "cannot tell",
    "hard to say", "hard to tell", "difficult to say", "difficult to tell",
    "difficult to choose", "hard to choose", "toss-up", "toss up",
    "roughly equal", "about equal", "equally good", "equally strong",
)
RATING_FIELDS = ("plot_structure", "prose_style", "characterization", "originality", "overall_quality")
ALTERNATE_SPELLING = ("characterisation", "characterization")
LANGUAGE_TAG = "^[ \\t]*[a-zA-Z0-9_+-]*[ \\t]*\\n?"
LETTER_FIRST = "(?isU)^(?:i\\s+prefer\\s+(?:passage\\s+)?|passage\\s+)?([ab])\\b"

# Error codes of the plain A/B parser.
JSON_NOT_OBJECT = "json_not_object"
JSON_NO_LETTER = "json_without_letter"
HEDGED = "ambiguous/hedged"
NO_LETTER = "no_leading_letter"
NOT_JSON = "not_json"


def strip(text: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def unfenced(bare: Column) -> Column:
    """Drop a Markdown fence around an already stripped text.

    The fence may stand on its own lines or be collapsed onto one; the closing one is
    only dropped at the very end.
    """
    opened = F.regexp_replace(F.substr(bare, F.lit(4)), LANGUAGE_TAG, "")
    return F.when(bare.startswith("```"), strip(F.regexp_replace(opened, "```\\z", ""))).otherwise(bare)


def strip_code_fence(text: Column) -> Column:
    return unfenced(strip(text))


def strip_emphasis(text: Column) -> Column:
    return F.btrim(text, F.lit(EMPHASIS_CHARS))


_HEDGE_PATTERN = "|".join(re.escape(marker).replace("\\ ", " ") for marker in HEDGE_MARKERS)


def last_key_wins(df: DataFrame) -> None:
    """Let the session's JSON parser take the last of repeated keys, as answers with a corrected choice need."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _sealed(text: Column) -> Column:
    """A text as the first element of a JSON array that ends with the text's own hash.

    The built-in parser stops behind the first value and takes whatever follows; only a text
    that is JSON from end to end leaves the hash in second place.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text), F.lit('"]')))


def _unsealed(sealed: Column, text: Column) -> Column:
    """The document of a sealed text; NULL when the text is not one whole JSON value."""
    return F.when(F.try_variant_get(sealed, "$[1]", "string") == F.md5(text), F.try_variant_get(sealed, "$[0]", "variant"))


def with_choice(df: DataFrame, text: str, answer: str = "answer", error: str = "error") -> DataFrame:
    """Parse a free-text or JSON forced choice into A or B.

    JSON wins when the text is JSON at all: it must be an object whose
    ``overall_quality`` (or, without that key, ``choice``) is A or B.  Otherwise a
    hedge anywhere rejects the answer, and then the letter must lead the text.
    """
    last_key_wins(df)
    clean, doc = F.col("__clean"), F.col("__doc")
    staged = df.withColumn("__bare", strip(F.col(text)))
    staged = staged.withColumn("__clean", strip_emphasis(unfenced(F.col("__bare"))))
    # Only these first characters can open a JSON document; anything else skips the parser.
    staged = staged.withColumns(
        {
            "__sealed": F.when(clean.rlike("^[\\s]*[\\[{\"\\-0-9tfn]"), _sealed(clean)),
            "__letter": F.upper(F.nullif(F.regexp_extract(clean, LETTER_FIRST, 1), F.lit(""))),
            "__hedged": F.lower(clean).rlike(_HEDGE_PATTERN),
        }
    )
    staged = staged.withColumn("__doc", _unsealed(F.col("__sealed"), clean))
    value = F.coalesce(
        F.try_variant_get(doc, "$.overall_quality", "variant"), F.try_variant_get(doc, "$.choice", "variant")
    )
    staged = staged.withColumns(
        {
            "__json": F.when(~F.is_variant_null(doc), F.schema_of_variant(doc)),
            "__value": F.upper(strip(F.try_variant_get(value, "$", "string"))),
        }
    )
    is_json, good = F.col("__json").isNotNull(), F.coalesce(F.col("__value").isin("A", "B"), F.lit(False))
    letter, hedged = F.col("__letter"), F.col("__hedged")
    nothing = F.lit(None).cast("string")
    return staged.withColumns(
        {
            answer: F.when(is_json, F.when(good, F.col("__value"))).when(~hedged, letter),
            error: F.when(F.col(text).isNull(), "no_response_text")
            .when(is_json & good, nothing)
            .when(is_json & ~F.col("__json").startswith("OBJECT"), JSON_NOT_OBJECT)
            .when(is_json, JSON_NO_LETTER)
            .when(hedged, HEDGED)
            .when(letter.isNull(), NO_LETTER),
        }
    ).drop("__bare", "__clean", "__sealed", "__doc", "__letter", "__hedged", "__json", "__value")


# -- JSON rubrics ------------------------------------------------------------------------


def _fields(document: Column) -> Column:
    """Members of a JSON object; NULL for anything else."""
    return F.try_variant_get(document, "$", "map<string,variant>")


def _json_text(value: Column) -> Column:
    """A VARIANT scalar as text, only when it is a JSON string."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _has_exactly(fields: Column, names: Sequence[str]) -> Column:
    return F.coalesce(F.array_sort(F.map_keys(fields)) == F.array(*[F.lit(n) for n in sorted(names)]), F.lit(False))


def _kind(fields: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_element_at(fields, F.lit(name)))


def _number(fields: Column, name: str) -> Column:
    return F.try_variant_get(F.try_element_at(fields, F.lit(name)), "$", "double")


def _integer_in(fields: Column, name: str, low: int, high: int) -> Column:
    """A JSON integer in range: 3.0 and true are not integers."""
    return F.coalesce((_kind(fields, name) == "BIGINT") & _number(fields, name).between(low, high), F.lit(False))


def _one_decimal_in(fields: Column, name: str, low: float, high: float) -> Column:
    """A JSON number in range with at most one decimal place (tolerance 1e-6)."""
    kind, value = _kind(fields, name), _number(fields, name)
    numeric = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL") | (kind == "FLOAT")
    tenths = value * 10
    fits = F.abs(tenths - F.rint(tenths)) < 1e-6
    return F.coalesce(numeric & value.between(low, high) & fits, F.lit(False))


def _every(conditions: Sequence[Column]) -> Column:
    verdict = F.lit(True)
    for condition in conditions:
        verdict = verdict & condition
    return verdict


def _ratings_ok(fields: Column) -> Column:
    return _has_exactly(fields, RATING_FIELDS) & _every([_integer_in(fields, f, 1, 5) for f in RATING_FIELDS])


def ratings_of(fields: Column) -> Column:
    """Ratings of validated members as ``map<string,double>``."""
    return F.create_map(*[x for f in RATING_FIELDS for x in (F.lit(f), _number(fields, f))])


def integer_ratings_error(fields: Column) -> Column:
    """Pilot rubric: exactly the five fields, integers 1-5."""
    return F.when(~_ratings_ok(fields), F.lit("bad_integer_ratings"))


def decimal_ratings_error(fields: Column) -> Column:
    """Context rubric: exactly the five fields, 1.0-10.0 with at most one decimal."""
    ok = _has_exactly(fields, RATING_FIELDS) & _every([_one_decimal_in(fields, f, 1.0, 10.0) for f in RATING_FIELDS])
    return F.when(~ok, F.lit("bad_decimal_ratings"))


def comparison_error(fields: Column) -> Column:
    """Pilot comparison: two integer rating sets and a preference from -2 to 2."""
    side = {s: _fields(F.try_element_at(fields, F.lit(s))) for s in ("story_a", "story_b")}
    return (
        F.when(~_has_exactly(fields, ("story_a", "story_b", "preference")), "bad_comparison_fields")
        .when(~_ratings_ok(side["story_a"]), "bad_story_a_ratings")
        .when(~_ratings_ok(side["story_b"]), "bad_story_b_ratings")
        .when(~_integer_in(fields, "preference", -2, 2), "bad_preference")
    )


def normalised_choices(fields: Column) -> Column:
    """Members with the alternate spelling folded in, unless both spellings are present."""
    old, new = ALTERNATE_SPELLING
    renamed = F.transform_keys(fields, lambda k, _: F.when(k == old, F.lit(new)).otherwise(k))
    return F.when(F.map_contains_key(fields, F.lit(new)), fields).otherwise(renamed)


def choices_of(fields: Column) -> Column:
    """Category choices of validated, normalised members as ``map<string,string>``."""
    return F.create_map(
        *[x for f in RATING_FIELDS for x in (F.lit(f), _json_text(F.try_element_at(fields, F.lit(f))))]
    )


def choices_error(fields: Column, allowed: Sequence[str]) -> Column:
    """Per-category choices: exactly the five fields, each one of ``allowed``."""
    values_ok = _every(
        [
            F.coalesce(_json_text(F.try_element_at(fields, F.lit(f))).isin(*allowed), F.lit(False))
            for f in RATING_FIELDS
        ]
    )
    return F.when(~_has_exactly(fields, RATING_FIELDS), "bad_choice_fields").when(~values_ok, "bad_choice_value")


FORCED_VALUES = ("A", "B")
TIE_VALUES = ("A", "B", "tie")


def with_document(df: DataFrame, text: str) -> DataFrame:
    """Add ``__doc`` (VARIANT, NULL when not JSON) and ``__fields`` (members of an object)."""
    last_key_wins(df)
    parsed = df.withColumn("__body", strip_code_fence(F.col(text))).withColumn("__sealed", _sealed(F.col("__body")))
    parsed = parsed.withColumn("__doc", _unsealed(F.col("__sealed"), F.col("__body"))).drop("__sealed", "__body")
    return parsed.withColumn("__fields", _fields(F.col("__doc")))


def with_validation(
    df: DataFrame,
    text: str,
    trial_type: str = "type",
    choice_mode: str = "choice_mode",
    response_format: str = "response_format",
    answer: str = "answer",
    error: str = "error",
) -> DataFrame:
    """Validate each text under the rubric of its trial.

    The answer is the letter for the plain format and the compact JSON of the
    (normalised) document otherwise.  Unknown trial types use the pilot comparison.
    """
    plain = F.coalesce(F.col(response_format) == "plain_ab", F.lit(False))
    pairwise = F.coalesce(
        F.col(trial_type).isin("context_pairwise", "context_prompt", "context_pairwise_same"), F.lit(False)
    )
    tie_allowed = F.coalesce(F.col(choice_mode) == "tie_allowed", F.lit(False))
    # Each text goes through the one parser its format needs.
    routed = df.withColumns({"__plain": F.when(plain, F.col(text)), "__rubric": F.when(~plain, F.col(text))})
    staged = with_document(with_choice(routed, "__plain", "__choice", "__choice_error"), "__rubric")
    staged = staged.withColumn("__choices", F.when(pairwise, normalised_choices(F.col("__fields"))))
    fields, choices = F.col("__fields"), F.col("__choices")
    rubric_error = (
        F.when(F.col("__doc").isNull(), F.lit(NOT_JSON))
        .when(F.col(trial_type) == "single", integer_ratings_error(fields))
        .when(F.col(trial_type) == "context_single", decimal_ratings_error(fields))
        .when(pairwise & tie_allowed, choices_error(choices, TIE_VALUES))
        .when(pairwise, choices_error(choices, FORCED_VALUES))
        .otherwise(comparison_error(fields))
    )
    staged = staged.withColumn(
        error,
        F.when(F.col(text).isNull(), F.lit("no_response_text")).when(plain, F.col("__choice_error")).otherwise(rubric_error),
    )
    body = F.when(pairwise, F.to_json(choices_of(choices))).otherwise(F.to_json(F.col("__doc")))
    valid = F.when(F.col(error).isNull(), F.when(plain, F.col("__choice")).otherwise(body))
    return staged.withColumn(answer, valid).drop(
        "__plain", "__rubric", "__choice", "__choice_error", "__doc", "__fields", "__choices"
    )


def rendered_error(error_code: Column) -> Column:
    """The recorded error text of a parser code (hedges keep their fixed marker)."""
    return F.when(error_code.isNotNull(), F.concat(F.lit("Response rejected: "), error_code))
