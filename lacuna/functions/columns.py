"""Column expressions. All of them run in the JVM; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timestamps are kept as text in this form.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

# The human item and the patterns found in classifier logs.
HUMAN = "Q5"
DECIMAL = r"(\d+\.\d*)"
INTEGER = r"(\d+)"

# The HTML text around a picture.
IMAGE_TAG = ('<img src="data:image/png;base64,', '">')


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year_month(ts: str | Column) -> list[Column]:
    """``year`` and ``month`` of a timestamp kept as text, as zero-padded text."""
    ts = _col(ts)
    return [F.substring(ts, 1, 4).alias("year"), F.substring(ts, 6, 2).alias("month")]


def parse_time(ts: str | Column) -> Column:
    """Text to timestamp; fractions of a second are cut and bad text gives null."""
    return F.try_to_timestamp(F.substring(_col(ts), 1, 19), F.lit(TIME_FORMAT))


def entity_id(value: str | Column) -> Column:
    """The ``id`` inside the JSON text of a claim value; null when it cannot be read."""
    return F.get_json_object(_col(value), "$.id")


def claim_matches(prop: str, qid: str, strict: bool = False, claim: Column | None = None) -> Column:
    """True where a claim (``property, value``) has this property and points to the entity ``qid``.
    The claim is a row of its own, or the struct ``claim``.

    The default looks for ``"id":"<qid>"`` in the JSON text, which needs the compact spacing the
    dumps use; ``strict`` reads the JSON instead.
    """
    of, value = (F.col("property"), F.col("value")) if claim is None else (claim["property"], claim["value"])
    same_entity = entity_id(value) == qid if strict else value.contains(f'"id":"{qid}"')
    return (of == prop) & same_entity


def percent(part: str | Column, whole: str | Column) -> Column:
    """``part / whole * 100``; null instead of an error for a zero or null divisor."""
    return F.try_divide(_col(part), _col(whole)) * F.lit(100)


def decode_base64(c: str | Column) -> Column:
    """Base64 text to bytes; null when the text is not base64."""
    return F.try_to_binary(_col(c), F.lit("base64"))


def html_image(b64: str | Column) -> Column:
    """An HTML image tag with the picture inlined; null for a null picture."""
    return F.concat(F.lit(IMAGE_TAG[0]), _col(b64), F.lit(IMAGE_TAG[1]))


def normalize_pixels(c: str | Column) -> Column:
    """Pixel values 0..255 to -1..1."""
    return F.transform(_col(c), lambda x: x.cast("double") * F.lit(2.0) / F.lit(255.0) - F.lit(1.0))


def element(c: str | Column, position: int) -> Column:
    """Entry ``position`` (from 0) of an array; null when the array is shorter."""
    return F.get(_col(c), F.lit(position))


def threshold_label(c: str | Column, threshold: float, above: str, below: str) -> Column:
    """``above`` where the first entry of a prediction exceeds the threshold, else ``below``."""
    return F.when(element(c, 0) > threshold, above).otherwise(below)


def named_elements(c: str | Column, names: Sequence[str]) -> list[Column]:
    """The leading entries of an array as one column per name."""
    return [element(c, i).alias(name) for i, name in enumerate(names)]


def spelled_out(c: str | Column, times: str | Column) -> Column:
    """An array with each entry repeated as often as the array ``times`` says."""
    repeated = F.zip_with(_col(c), _col(times), lambda x, n: F.array_repeat(x, n.cast("int")))
    return F.flatten(repeated)


def _matched(text: Column, pattern: str) -> Column:
    """First capture of ``pattern``, null when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def first_decimal(text: str | Column) -> Column:
    """First number with a decimal point in a text, as double."""
    return _matched(_col(text), DECIMAL).try_cast("double")


def first_integer(text: str | Column) -> Column:
    """First run of digits in a text, as long."""
    return _matched(_col(text), INTEGER).try_cast("bigint")


def integers(text: str | Column) -> Column:
    """Every run of digits in a text, in order; a decimal gives two."""
    return F.regexp_extract_all(_col(text), F.lit(INTEGER), F.lit(1))
