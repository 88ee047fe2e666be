from .frames import item_features, page_features
from .gender_gap import (
    number_of_gender_article,
    number_of_gender_article_by_month,
    number_of_gender_article_overall,
    number_of_gender_item,
    number_of_gender_zero_ill,
    number_of_pages,
)
from .image_jobs import classify_images, detection_job, feature_job, with_thumbnail
from .snapshots import Snapshots

__all__ = [
    "Snapshots",
    "classify_images",
    "detection_job",
    "feature_job",
    "item_features",
    "number_of_gender_article",
    "number_of_gender_article_by_month",
    "number_of_gender_article_overall",
    "number_of_gender_item",
    "number_of_gender_zero_ill",
    "number_of_pages",
    "page_features",
    "with_thumbnail",
]
