"""The gender-gap metrics over the item frame and the page frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.claims import biographies
from ..operators.pages import wiki_totals
from ..operators.ratios import coverage_ratio, flag_ratio, monthly_share, share_of_total
from ..operators.series import monthly_cumulative


def number_of_gender_item(items: DataFrame) -> DataFrame:
    """Items of each gender against all people: ``gender_count, people_count, gender_ratio``."""
    return share_of_total(
        biographies(items), ["gender", "gender_label"], "gender_count", "people_count", "gender_ratio"
    )


def number_of_gender_article_overall(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Articles of each wiki and gender against the items of that gender."""
    return coverage_ratio(biographies(pages), biographies(items), ["wiki_db"], "gender", "gender_label")


def number_of_gender_article_by_month(
    page_frame: DataFrame, pages: DataFrame, history: DataFrame, until: str | None = None
) -> DataFrame:
    """Articles of each wiki, month and gender against all articles of the wiki."""
    totals = number_of_pages(pages, history, "wp_count", "wp_cumsum")
    return monthly_share(biographies(page_frame), totals, until=until)


def number_of_gender_zero_ill(items: DataFrame) -> DataFrame:
    """Items of each gender without a page against all items of that gender."""
    return flag_ratio(biographies(items), "zero_ill", "gender", "gender_label")


def number_of_gender_article(features: DataFrame) -> DataFrame:
    """Articles of each wiki, month and gender label, and their running sum.

    Works on a stored feature frame with ``wiki_db, gender_label, date_created``; all rows with a
    date count, people or not.
    """
    return monthly_cumulative(features, "date_created", ["wiki_db", "gender_label"])


def number_of_pages(
    pages: DataFrame, history: DataFrame, count: str = "article_count", cumsum: str = "cumsum"
) -> DataFrame:
    """Articles of each wiki and month, and their running sum. Choose wikis in the two scans."""
    return wiki_totals(pages, history, "distinct", count=count, cumsum=cumsum)
