"""Image jobs from an image frame to the frame that is stored; see ``sources`` for the sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decode_base64, html_image, threshold_label
from ..operators.inference import Model, detect_summary, extract_features, predict_images

IMAGE = "image.image_bytes_b64"


def classify_images(
    df: DataFrame,
    decode_fn: Callable[[bytes, int], np.ndarray],
    make_model: Callable[[], Model],
    size: int = 180,
    threshold: float = 0.5,
    above: str = "Quality",
    below: str = "Random",
    keep: Sequence[str] = ("image_file_name", "label"),
    on_error: str = "raise",
    batch_size: int = 64,
) -> DataFrame:
    """``keep`` columns and ``pred_label`` of images given as bytes in ``image_bytes``.

    For unlabelled images store the prediction itself: ``predict_images(..., normalize=True)``.
    """
    predicted = predict_images(
        df, "image_bytes", decode_fn, make_model, size, "prediction", on_error, batch_size, normalize=True
    )
    label = F.when(F.col("prediction").isNotNull(), threshold_label("prediction", threshold, above, below))
    return predicted.select(*keep, label.alias("pred_label"))


def feature_job(
    df: DataFrame,
    decode_fn: Callable[[bytes, int], np.ndarray],
    make_model: Callable[[], Model],
    size: int = 224,
    image: str | Column = IMAGE,
    on_error: str = "zeros",
    batch_size: int = 64,
) -> DataFrame:
    """``i, image_file_name, features, image_url`` of images given as base64 text."""
    content = decode_base64(image)
    return extract_features(df, content, decode_fn, make_model, size, on_error, batch_size=batch_size).select(
        "i", "image_file_name", "features", "image_url"
    )


def detection_job(
    df: DataFrame,
    decode_fn: Callable[[bytes], np.ndarray],
    make_detector: Callable[[], Callable[[np.ndarray], Sequence[dict]]],
    image: str | Column = IMAGE,
    keep: Sequence[str] = ("i", "image_file_name"),
    keep_after: Sequence[str] = ("image_url",),
    batch_size: int = 64,
) -> DataFrame:
    """One row per image with a hit: ``i, image_file_name, count, max, sum, image_url``."""
    found = detect_summary(df, decode_base64(image), decode_fn, make_detector, "detections", batch_size)
    return found.where(F.col("detections").isNotNull()).select(*keep, "detections.*", *keep_after)


def with_thumbnail(
    df: DataFrame,
    decode_fn: Callable[[bytes], np.ndarray],
    make_detector: Callable[[], Callable[[np.ndarray], Sequence[dict]]],
    image: str = IMAGE,
    batch_size: int = 64,
) -> DataFrame:
    """``image_file_name, count, max, sum, thumbnail`` of the images with a hit."""
    framed = df.withColumn("thumbnail", html_image(image))
    return detection_job(framed, decode_fn, make_detector, image, ["image_file_name"], ["thumbnail"], batch_size)
