"""Classifier logs to tables. A block is the text of one language, see ``read_log_blocks``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import first_decimal, first_integer, integers, named_elements, require
from ..lookups import CLASSIFIER_FEATURES

# How the lines of the log begin.
FIT_BLOCK = "Obtaining the final CCC for language: "
FIT_LINE = "The fit has a score of: "
SELECTION_BLOCK = "This Wikipedia "
GROUNDTRUTH_LINE = "There were already "
PREDICTION_LINE = "This algorithm CLASSIFIED "
FINAL_LINE = "With "

# The patterns of a wiki and of a score in a line of the log.
WIKI = "([a-z]+wiki)"
SCORE = r": (\d+\.\d*)"


def _last(text: Column, pattern: str) -> Column:
    """Last match of a pattern, null when there is none: later lines of a block overrule earlier."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(-1))


def _line(prefix: str) -> Column:
    """The last line of a block, its first line aside, that starts with a prefix."""
    return _last(F.col("block"), rf"\n{prefix}[^\n]*")


def _first_line() -> Column:
    return F.substring_index("block", "\n", 1)


def split_blocks(df: DataFrame, text_col: str, marker: str) -> DataFrame:
    """A text column as one row per block, column ``block``: from one line that begins with ``marker``
    to the next, without the marker. Text before the first such line is dropped."""
    parts = F.split(F.concat(F.lit("\n"), require(df, text_col)[text_col]), rf"\n\Q{marker}\E")
    return df.select(F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("block"))


def parse_fit_log(
    blocks: DataFrame,
    features: Sequence[str] = CLASSIFIER_FEATURES,
    code_pattern: str = r"\w+",
) -> DataFrame:
    """``wiki, fit_score`` and one weight per feature, from blocks that start at ``FIT_BLOCK``.

    The weights are a JSON array on the line after the fit line; a block without the two lines
    gives no record. A language code is cut at the first character that ``code_pattern`` does not
    take, by default a hyphen. What cannot be read is null.
    """
    # A fit line with another one right after it has no weights of its own.
    fit = _last(F.col("block"), rf"\n{FIT_LINE}[^\n]*\n(?!{FIT_LINE})[^\n]*")
    weights = F.from_json(F.substring_index("fit", "\n", -1), "array<double>")
    code = F.regexp_extract(_first_line(), f"(?U)^({code_pattern})", 1)
    return (
        require(blocks, "block")
        .where(F.contains("block", F.lit(f"\n{FIT_LINE}")))
        .select(F.concat(code, F.lit("wiki")).alias("wiki"), fit.alias("fit"))
        .where(F.col("fit").isNotNull())
        .select(
            "wiki",
            F.regexp_extract("fit", SCORE, 1).try_cast("double").alias("fit_score"),
            weights.alias("weights"),
        )
        .select("wiki", "fit_score", *named_elements("weights", features))
    )


def parse_selection_log(blocks: DataFrame) -> DataFrame:
    """Article counts of one classification per block that starts at ``SELECTION_BLOCK``.

    A block without its closing line gives no record; another missing line gives nulls.
    """
    head, truth, prediction = _first_line(), F.col("truth"), F.col("prediction")
    wiki = F.nullif(F.regexp_extract(head, WIKI, 1), F.lit(""))
    return (
        require(blocks, "block")
        .where(F.contains("block", F.lit(f"\n{FINAL_LINE}")))
        .select(
            wiki.alias("wiki"),
            first_integer(head).alias("total_article"),
            _line(GROUNDTRUTH_LINE).alias("truth"),
            _line(PREDICTION_LINE).alias("prediction"),
            _line(FINAL_LINE).alias("final"),
        )
        .select(
            "wiki",
            "total_article",
            first_integer(truth).alias("ccc_groundtruth"),
            first_decimal(truth).alias("ccc_groundtruth_p"),
            F.try_element_at(integers(prediction), F.lit(3)).try_cast("bigint").alias("test_article"),
            F.try_element_at(integers(prediction), F.lit(1)).try_cast("bigint").alias("predict_positive"),
            first_decimal(prediction).alias("predict_positive_p"),
            first_decimal("final").alias("ccc_final_p"),
        )
    )
