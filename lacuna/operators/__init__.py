from .claims import (
    append_features,
    append_flag,
    append_value,
    biographies,
    claims_of,
    entity_features,
    explode_claims,
    in_category,
    pivot_claims,
    time_claims,
)
from .inference import (
    decode_images,
    detect_summary,
    explode_json,
    extract_features,
    model_factory,
    predict,
    predict_images,
)
from .filters import may_be_in, may_repeat
from .labels import add_label, label_list, labels_in, labels_in_use
from .linking import add_missing_flag, drop_ambiguous, pages_of_items
from .logs import parse_fit_log, parse_selection_log, split_blocks
from .pages import add_first_edit, first_edit_of, first_edits, fold_history, wiki_totals
from .quality import profile, summary_stats
from .ratios import (
    category_counts,
    coverage_ratio,
    flag_ratio,
    monthly_pct,
    monthly_share,
    multi_valued,
    share_of_total,
    value_lists,
)
from .series import monthly_counts, monthly_cumulative, running_sum, slice_metric, top_k

__all__ = [
    "add_first_edit",
    "add_label",
    "add_missing_flag",
    "append_features",
    "append_flag",
    "append_value",
    "biographies",
    "category_counts",
    "claims_of",
    "coverage_ratio",
    "decode_images",
    "detect_summary",
    "drop_ambiguous",
    "entity_features",
    "explode_claims",
    "explode_json",
    "extract_features",
    "first_edit_of",
    "first_edits",
    "flag_ratio",
    "fold_history",
    "in_category",
    "label_list",
    "labels_in",
    "labels_in_use",
    "may_be_in",
    "may_repeat",
    "model_factory",
    "monthly_counts",
    "monthly_cumulative",
    "monthly_pct",
    "monthly_share",
    "multi_valued",
    "pages_of_items",
    "parse_fit_log",
    "parse_selection_log",
    "pivot_claims",
    "predict",
    "predict_images",
    "profile",
    "running_sum",
    "share_of_total",
    "slice_metric",
    "split_blocks",
    "summary_stats",
    "time_claims",
    "top_k",
    "value_lists",
    "wiki_totals",
]
