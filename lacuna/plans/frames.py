"""The two feature frames the metrics start from: one row per item, one row per article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import require
from ..functions.columns import HUMAN
from ..operators.claims import entity_features
from ..operators.filters import may_be_in
from ..operators.labels import Stage, add_label, labels_in, labels_in_use
from ..operators.linking import add_missing_flag, drop_ambiguous
from ..operators.pages import PAGE, add_first_edit
from ..sources.sinks import as_it_is
from ..sources.tables import wiki_filter

# The properties "instance of", "sex or gender" and "sexual orientation".
INSTANCE_OF = "P31"
GENDER = "P21"
SEXUAL_ORIENTATION = "P91"


def item_features(
    entities: DataFrame,
    links: DataFrame,
    labels: DataFrame | None = None,
    strict: bool = False,
    stage: Stage = as_it_is,
) -> DataFrame:
    """``qid, is_human, gender, gender_label, zero_ill`` of the items that are human or have a gender.

    ``entities`` holds the items of one snapshot. ``zero_ill`` is true when an item has no row in
    ``links``; links of any snapshot count, so pass all or one. Items whose gender is null or has
    no English label are dropped. ``labels`` (``id, label``) replaces the labels found in
    ``entities``.

    With ``stage`` (``sources.Staging``) the items are written at once, and then the labels of the
    genders they have: so a gender that most items share is not shuffled into one place. Without it
    the frame is lazy.
    """
    items = entity_features(
        entities, flags={"is_human": (INSTANCE_OF, HUMAN)}, values={"gender": GENDER}, strict=strict
    ).withColumnRenamed("id", "qid")
    names = labels_in(entities) if labels is None else labels
    if stage is not as_it_is:
        items = stage(items)
        names = labels_in_use(names, items, "gender", stage)
    return add_missing_flag(add_label(items, "gender", names, "gender_label"), links)


def page_features(
    items: DataFrame,
    links: DataFrame,
    pages: DataFrame,
    history: DataFrame,
    wikis: str | None = None,
    stage: Stage = as_it_is,
    folded: bool = False,
    candidates: bool = False,
) -> DataFrame:
    """The live articles the items link to, with all item columns, title and first-edit time.

    Titles come from the link frame. Articles that are ambiguous (a title or a page id of a wiki
    that occurs twice) and articles the history does not know are dropped. ``pages`` holds live
    articles (see ``sources.pages``); repeated rows of a page make it ambiguous, and are counted
    before the join instead of multiplying its rows.

    The linked articles are read three times, for themselves and to count their two keys: with
    ``stage`` (``sources.Staging``) they are written once, and so are the ambiguous keys, which are
    few; without it the frame is lazy. ``folded`` says that the history is folded and bucketed by page.

    ``candidates`` puts bitmaps of hashes before three exchanges: only links of the items, the history
    of the articles, and titles and pages that may be repeated are exchanged. Building one costs a short
    job, so it pays where the items are few against all pages; the result is the same. It needs ``stage``.
    """
    require(items, "qid")
    if candidates and stage is as_it_is:
        raise ValueError("candidates are found in staged frames: pass a stage")
    linked = wiki_filter(require(links, "item_id", "wiki_db", "page_id", "page_title"), wikis).select(
        F.col("item_id").alias("qid"), "wiki_db", "page_id", "page_title"
    )
    if candidates:
        items = stage(items)
        linked = linked.where(may_be_in(items, ["qid"])("qid"))
    live = require(pages, *PAGE).groupBy(*PAGE).agg(F.count("*").alias("copies"))
    found = items.join(linked, "qid").join(live, PAGE)
    articles = stage(found.select(*items.columns, *PAGE, "page_title", "copies"))
    if candidates and not folded:
        history = history.where(may_be_in(articles, PAGE)(*PAGE))
    known = drop_ambiguous(articles, copies="copies", stage=stage, candidates=candidates).drop("copies")
    return add_first_edit(known, history, unique=True, folded=folded)
