from .columns import (
    claim_matches,
    decode_base64,
    element,
    entity_id,
    first_decimal,
    first_integer,
    html_image,
    integers,
    named_elements,
    normalize_pixels,
    parse_time,
    percent,
    spelled_out,
    threshold_label,
    year_month,
)
from .guards import require

__all__ = [
    "claim_matches",
    "decode_base64",
    "element",
    "entity_id",
    "first_decimal",
    "first_integer",
    "html_image",
    "integers",
    "named_elements",
    "normalize_pixels",
    "parse_time",
    "percent",
    "require",
    "spelled_out",
    "threshold_label",
    "year_month",
]
