"""Batch inference with a model the caller supplies.

``make_model()`` returns a function from a batch (first axis: rows) to its predictions;
``decode_fn`` turns the bytes of one image into an H x W x 3 array. Both run in the Python
workers, where a model is made once per worker process and kept for the next batches.

All of it is marked nondeterministic. That keeps Catalyst from copying a call into a filter on its
result, which would decode and predict every image twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructType

from ..functions import require

Model = Callable[[np.ndarray], np.ndarray]
POLICIES = ("raise", "zeros", "null")


def model_factory(spark: SparkSession, build: Callable[[Any], Model], weights: Any) -> Callable[[], Model]:
    """A ``make_model`` whose weights travel to the workers once, as a broadcast variable."""
    shared = spark.sparkContext.broadcast(weights)
    return lambda: build(shared.value)


def _check_policy(on_error: str) -> str:
    if on_error not in POLICIES:
        raise ValueError(f"on_error is one of {POLICIES}, not {on_error!r}")
    return on_error


def decode_images(
    df: DataFrame,
    col: str | Column,
    decode_fn: Callable[[bytes, int], np.ndarray],
    size: int,
    name: str = "image_arr",
    on_error: str = "raise",
) -> DataFrame:
    """Add the flattened pixels of an image as ``array<float>``.

    ``decode_fn(content, size)`` returns a size x size x 3 array. ``on_error`` says what an
    unreadable image becomes: a failed job, an all-zero image or a null.
    """
    _check_policy(on_error)

    @F.pandas_udf("array<float>")
    def pixels(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def flat(content):
            try:
                return np.asarray(decode_fn(content, size), dtype=np.float32).reshape(-1)
            except Exception:
                if on_error == "raise":
                    raise
                return np.zeros(size * size * 3, dtype=np.float32) if on_error == "zeros" else None

        for contents in batches:
            yield pd.Series([flat(c) for c in contents], dtype=object)

    return df.withColumn(name, pixels.asNondeterministic()(col))


def predict(
    df: DataFrame,
    col: str,
    make_model: Callable[[], Model],
    input_shape: Sequence[int],
    name: str = "prediction",
    batch_size: int = 64,
) -> DataFrame:
    """Add the model's output as ``array<float>``, computed in batches of ``batch_size`` rows.

    ``input_shape`` is the shape of the tensor in one row of ``col``. A null array gives a null
    prediction.
    """

    def make_predict():
        model = make_model()

        def run(batch):
            return np.asarray(model(batch), dtype=np.float32).reshape(len(batch), -1)

        return run

    flat = int(np.prod(input_shape))
    model = predict_batch_udf(
        make_predict,
        return_type=ArrayType(FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[list(input_shape)],
    )
    # The model sees a stand-in for null arrays, its answer to that is not used. Its length hangs on
    # the column, so that it is not folded into the plan as a constant of that many numbers.
    length = F.when(F.col(col).isNull(), flat)
    given = F.coalesce(F.col(col).cast("array<float>"), F.array_repeat(F.lit(0.0).cast("float"), length))
    return require(df, col).withColumn(name, F.when(F.col(col).isNotNull(), model.asNondeterministic()(given)))


def predict_images(
    df: DataFrame,
    col: str | Column,
    decode_fn: Callable[[bytes, int], np.ndarray],
    make_model: Callable[[], Model],
    size: int,
    name: str = "prediction",
    on_error: str = "raise",
    batch_size: int = 64,
    normalize: bool = False,
) -> DataFrame:
    """Decode and predict in one step: only image bytes enter Python and only predictions leave.

    ``decode_fn(content, size)`` returns a size x size x 3 array; ``normalize`` maps its values
    from 0..255 to -1..1. An unreadable image fails the job, is predicted as an all-zero image,
    or gets a null prediction, as ``on_error`` says.
    """
    _check_policy(on_error)

    def make_predict():
        model = make_model()
        blank = np.zeros((size, size, 3), dtype=np.float32)

        def image(content):
            try:
                return np.asarray(decode_fn(content, size), dtype=np.float32), True
            except Exception:
                if on_error == "raise":
                    raise
                return blank, False

        def run(contents):
            images, readable = zip(*[image(c) for c in contents])
            batch = np.stack(images)
            if normalize:
                batch = batch * 2.0 / 255.0 - 1.0
            output = np.asarray(model(batch), dtype=np.float32).reshape(len(batch), -1)
            return {"output": output, "readable": np.array(readable, dtype=np.int32)}

        return run

    result = predict_batch_udf(
        make_predict,
        return_type=StructType().add("output", ArrayType(FloatType())).add("readable", IntegerType()),
        batch_size=batch_size,
    )
    raw = f"{name}__raw"
    output = F.col(f"{raw}.output")
    if on_error == "null":
        output = F.when(F.col(f"{raw}.readable") == 1, output)
    return df.withColumn(raw, result.asNondeterministic()(col)).select(*df.columns, output.alias(name))


def extract_features(
    df: DataFrame,
    col: str | Column,
    decode_fn: Callable[[bytes, int], np.ndarray],
    make_model: Callable[[], Model],
    size: int = 224,
    on_error: str = "zeros",
    name: str = "features",
    batch_size: int = 64,
) -> DataFrame:
    """Add the feature vector of an image; an unreadable one counts as an all-zero image."""
    return predict_images(df, col, decode_fn, make_model, size, name, on_error, batch_size)


def detect_summary(
    df: DataFrame,
    col: str | Column,
    decode_fn: Callable[[bytes], np.ndarray],
    make_detector: Callable[[], Callable[[np.ndarray], Sequence[dict]]],
    name: str = "detections",
    batch_size: int = 64,
) -> DataFrame:
    """Add ``struct<count:int, max:double, sum:double>`` over the boxes found in an image.

    The detector returns boxes with ``x1, y1, x2, y2``; a box counts with its share of the image
    area. An image without a box gives null, one that cannot be read or searched gives -1s.
    """

    def make_predict():
        detector = make_detector()

        def summary(content):
            try:
                image = np.asarray(decode_fn(content), dtype=np.float32)
                area = float(image.shape[0] * image.shape[1])
                shares = [(b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) / area for b in detector(image)]
            except Exception:
                return -1, -1.0, -1.0
            return len(shares), max(shares, default=0.0), sum(shares)

        def run(contents):
            count, largest, total = zip(*[summary(c) for c in contents])
            return {
                "count": np.array(count, dtype=np.int32),
                "max": np.array(largest, dtype=np.float64),
                "sum": np.array(total, dtype=np.float64),
            }

        return run

    found = predict_batch_udf(
        make_predict,
        return_type=StructType().add("count", IntegerType()).add("max", DoubleType()).add("sum", DoubleType()),
        batch_size=batch_size,
    )
    raw = f"{name}__raw"
    result = F.when(F.col(f"{raw}.count") != 0, F.col(raw))
    return df.withColumn(raw, found.asNondeterministic()(col)).select(*df.columns, result.alias(name))


def explode_json(df: DataFrame, col: str, ddl: str, name: str = "data") -> DataFrame:
    """One row per element of a JSON array kept as text; a row whose text is null goes."""
    return require(df, col).withColumn(name, F.explode(F.from_json(col, ddl)))
