"""Creation time of pages, and how many pages a wiki has at each month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse_time, require
from ..functions.columns import TIME_FORMAT
from .series import monthly_counts, running_sum

# The number comes first: rows are sorted on these keys, and a wiki name tells few of them apart.
PAGE = ["page_id", "wiki_db"]
TIME = "page_first_edit_timestamp"


def one_row_per(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the smallest one, so that the choice does not depend on row order."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("row")).select(*keys, "row.*")


def fold_history(history: DataFrame) -> DataFrame:
    """The different ``page_id, wiki_db`` and first-edit times of a history, null times included.

    A history repeats its pages for every action on them. A hash aggregate folds it in each task, so
    the raw rows are neither sorted nor shuffled. What several steps read of one history is best
    folded once and staged; the steps below take it like any history.
    """
    return require(history, *PAGE, TIME).select(*PAGE, TIME).distinct()


def first_edits(history: DataFrame, folded: bool = False) -> DataFrame:
    """One row per page of the history: its latest non-null first-edit time, else null.

    A maximum of texts is found by sorting. So the history is folded first, the few rows left are
    brought together by page, and only those are sorted. ``folded=True`` says that both is done
    already: the history is what ``fold_history`` gave, bucketed by page (``Staging.bucketed``).
    """
    together = require(history, *PAGE, TIME) if folded else fold_history(history).repartition(*PAGE)
    return together.groupBy(*PAGE).agg(F.max(TIME).alias(TIME))


def add_first_edit(df: DataFrame, history: DataFrame, unique: bool = False, folded: bool = False) -> DataFrame:
    """Add the first-edit time to pages; pages the history does not know are dropped.

    The result has one row per page. ``unique=True`` says that ``df`` has that already and saves
    an aggregate. The history is folded before the join, on the keys of the join; one that is
    ``folded`` and bucketed by page is not exchanged.
    """
    require(df, *PAGE)
    rows = df if unique else one_row_per(df, PAGE)
    rest = [c for c in df.columns if c not in PAGE]
    return rows.join(first_edits(history, folded), PAGE).select(*PAGE, *rest, TIME)


def first_edit_of(df: DataFrame, history: DataFrame) -> DataFrame:
    """``wiki_db, page_id`` and first-edit time of the pages in ``df``."""
    wanted = require(df, *PAGE).select(*PAGE).distinct()
    return first_edits(history).join(wanted, PAGE, "left_semi").select("wiki_db", "page_id", TIME)


def wiki_totals(
    pages: DataFrame,
    history: DataFrame,
    mode: str = "distinct",
    match_wiki: bool = True,
    count: str = "article_count",
    cumsum: str = "cumsum",
) -> DataFrame:
    """Articles created per wiki and month, and their running sum.

    ``distinct`` counts each different first-edit time of a page once and drops null times; a page
    with two times counts twice. ``min`` counts a page once, at its earliest time; pages without a
    readable time form a group with null month. ``match_wiki=False`` looks pages up by page id
    alone, so the history of another wiki can match.

    The history, which repeats a page for every action on it, is folded before it meets the pages,
    and so are copies of a page. A history bucketed by page is neither exchanged to fold it nor to meet
    the pages, if the wiki is matched.
    """
    if mode not in ("distinct", "min"):
        raise ValueError(f"mode is 'distinct' or 'min', not {mode!r}")
    key = PAGE if match_wiki else ["page_id"]
    known = require(history, *PAGE, TIME).select(*key, TIME)
    if mode == "distinct":
        dated = known.where(F.col(TIME).isNotNull()).distinct()
    else:
        earliest = F.date_format(F.min(parse_time(TIME)), TIME_FORMAT)
        dated = known.groupBy(*key).agg(earliest.alias(TIME))
    created = dated.join(require(pages, *PAGE).select(*PAGE).distinct(), key)
    return running_sum(monthly_counts(created, TIME, ["wiki_db"], count), count, ["wiki_db"], cumsum)
