"""The whole chain over catalog tables, by snapshot: from entity dumps to the metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions.columns import HUMAN
from ..operators.claims import entity_features, explode_claims
from ..operators.labels import Stage, add_label, labels_in
from ..operators.linking import add_missing_flag, pages_of_items
from ..operators.pages import PAGE, add_first_edit, first_edit_of, fold_history, wiki_totals
from .frames import GENDER, INSTANCE_OF, SEXUAL_ORIENTATION, item_features, page_features
from .gender_gap import number_of_gender_article_by_month


@dataclass(frozen=True)
class Snapshots:
    """The four snapshot tables, each a catalog name or a DataFrame.

    ``snapshot`` below is the dated snapshot of entities and links (``2021-08-02``), ``month`` the
    monthly one of pages and history (``2021-07``); ``wikis`` is a space-separated text and ``None``
    means all. Every method returns a lazy frame; only what gets a ``stage`` (``sources.Staging``) runs
    at once and is written to the checkpoint folder.
    """

    spark: SparkSession
    entity: str | DataFrame
    link: str | DataFrame
    page: str | DataFrame
    history: str | DataFrame

    def entities(self, snapshot: str) -> DataFrame:
        return sources.entities(self.spark, self.entity, snapshot)

    def links(self, snapshot: str | None = None, wikis: str | None = None) -> DataFrame:
        return sources.links(self.spark, self.link, snapshot, wikis)

    def pages(self, month: str, wikis: str | None = None) -> DataFrame:
        """``wiki_db, page_id, page_title`` of the live articles."""
        return sources.pages(self.spark, self.page, month, wikis)

    def edits(self, month: str, wikis: str | None = None) -> DataFrame:
        return sources.history(self.spark, self.history, month, wikis)

    def folded_edits(self, month: str, stage: sources.Staging, wikis: str | None = None) -> DataFrame:
        """The history of a month, folded and written in buckets of pages: the largest table is read and
        exchanged once, and what joins it later only exchanges its own side."""
        return stage.bucketed(fold_history(self.edits(month, wikis)), PAGE)

    # Items

    def labels(self, snapshot: str, lang: str = "en") -> DataFrame:
        return labels_in(self.entities(snapshot), lang)

    def with_label(self, df: DataFrame, col: str, snapshot: str, name: str = "label") -> DataFrame:
        """Add the English label of the entity in ``col``; rows without one are dropped."""
        return add_label(df, col, self.labels(snapshot), name)

    def with_missing_flag(self, df: DataFrame, snapshot: str | None = None) -> DataFrame:
        """Add ``zero_ill``: no link in any snapshot, or in the one named."""
        return add_missing_flag(df, self.links(snapshot))

    def item_frame(
        self,
        snapshot: str,
        links_in: str | None = None,
        labels: DataFrame | None = None,
        stage: Stage = sources.as_it_is,
    ) -> DataFrame:
        """Item features; ``zero_ill`` looks at all link snapshots, or at ``links_in``.

        ``labels`` (``id, label``) replaces the English labels of the whole snapshot.
        """
        return item_features(self.entities(snapshot), self.links(links_in), labels, stage=stage)

    def item_ids(self, snapshot: str) -> DataFrame:
        return self.entities(snapshot).select(F.col("id").alias("qitem_id"))

    def properties(self, snapshot: str) -> DataFrame:
        """All claims in long form: ``qitem_id, property, value``."""
        return explode_claims(self.entities(snapshot)).withColumnRenamed("id", "qitem_id")

    def described_items(self, snapshot: str) -> DataFrame:
        """``qitem_id, is_human, gender, sexual_orientation`` of all items."""
        return entity_features(
            self.entities(snapshot),
            flags={"is_human": (INSTANCE_OF, HUMAN)},
            values={"gender": GENDER, "sexual_orientation": SEXUAL_ORIENTATION},
            all_items=True,
        ).withColumnRenamed("id", "qitem_id")

    # Pages

    def pages_of_items(self, items: DataFrame, snapshot: str, wikis: str | None = None) -> DataFrame:
        return pages_of_items(items, self.links(snapshot), wikis)

    def page_frame(
        self,
        items: DataFrame,
        snapshot: str,
        month: str,
        wikis: str | None = None,
        edits: DataFrame | None = None,
        stage: Stage = sources.as_it_is,
        folded: bool = False,
        candidates: bool = False,
    ) -> DataFrame:
        """The live, unambiguous articles of the items with their first-edit time. ``edits`` replaces the
        history of the month, for example by ``folded_edits``, which serves several metrics; then say
        that it is ``folded``. ``candidates`` filters what is exchanged (see ``page_features``)."""
        history = self.edits(month, wikis) if edits is None else edits
        links, pages = self.links(snapshot), self.pages(month, wikis)
        return page_features(items, links, pages, history, wikis, stage, folded, candidates)

    def with_first_edit(self, df: DataFrame, month: str) -> DataFrame:
        return add_first_edit(df, self.edits(month))

    def first_edit_of(self, df: DataFrame, month: str) -> DataFrame:
        return first_edit_of(df, self.edits(month))

    # Metrics

    def page_totals(
        self, month: str, wikis: str | None = None, mode: str = "distinct", match_wiki: bool = True
    ) -> DataFrame:
        """Articles per wiki and month. Without ``match_wiki`` the history of all wikis is searched."""
        edits = self.edits(month, wikis if match_wiki else None)
        return wiki_totals(self.pages(month, wikis), edits, mode, match_wiki)

    def article_share_by_month(
        self, page_frame: DataFrame, month: str, until: str | None = None, edits: DataFrame | None = None
    ) -> DataFrame:
        history = self.edits(month) if edits is None else edits
        return number_of_gender_article_by_month(page_frame, self.pages(month), history, until)
