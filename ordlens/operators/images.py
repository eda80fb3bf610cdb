"""Image path: listing checks, batch featurisation, linear-head scoring.

No image model ships with the library (no weights offline). The caller
passes a model factory; :func:`featurize` wraps it in ``predict_batch_udf``
(Arrow batches, one model load per Python worker, not per row or call), so
the frozen backbone runs inside Spark tasks over ``binaryFile`` rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import CLASS_NAMES
from ..functions.vectors import argmax, softmax


def missing_images(requests: DataFrame, listing: DataFrame, path_col: str = "image_path") -> DataFrame:
    """VAL2: requests whose image file is absent from the ``binaryFile`` listing
    (a left-anti join: rejects, not job failures)."""
    return requests.join(listing.select(F.col("path").alias(path_col)), path_col, "left_anti")


# fixed values: channel means and deviations of the backbone's training images
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def channel_normalize(pixels: Column, mean=CHANNEL_MEAN, std=CHANNEL_STD, grey: bool = True) -> Column:
    """SCL17: ``(x/255 - mean_c) / std_c`` per channel; a grey image is
    repeated into three equal channels first. ``pixels`` is an int array."""
    x = F.transform(pixels, lambda v: v / F.lit(255.0))
    chans = [x, x, x] if grey else [x]

    def norm(m, s):
        return lambda v: (v - F.lit(m)) / F.lit(s)

    out = [F.transform(c, norm(m, s)) for c, m, s in zip(chans, mean, std)]
    return F.flatten(F.array(*out))


def featurize(images: DataFrame, make_predict: Callable, dim: int, content_col: str = "content",
              batch_size: int = 64) -> DataFrame:
    """ML12/UDF2: frozen-backbone features ``array<float>(dim)`` per image.

    ``make_predict()`` returns ``fn(np.ndarray of bytes objects) -> np.ndarray (n, dim)``.
    """
    udf = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                            input_tensor_shapes=None)
    return images.withColumn("embedding", udf(F.col(content_col)))


def classify(features: DataFrame, weights: list[list[float]], bias: list[float], vec: str = "embedding",
             names=CLASS_NAMES) -> DataFrame:
    """ML16: linear head -> softmax -> class name and rounded confidence.

    The head (classes x dims) is a fitted model of fixed size, applied as a
    literal expression JVM-side.
    """
    from ..functions.vectors import dot
    logits = F.array(*[dot(F.col(vec), F.array(*[F.lit(float(x)) for x in w])) + F.lit(float(b))
                       for w, b in zip(weights, bias)])
    probs = softmax(logits)
    name_arr = F.array(*[F.lit(n) for n in names])
    return (features.withColumn("_p", probs)
            .withColumn("predicted_category", F.element_at(name_arr, argmax(F.col("_p")) + 1))
            .withColumn("confidence", F.round(F.array_max("_p"), 4)).drop("_p"))


def byte_histogram_model(dim: int = 16):
    """A dependency-free stand-in backbone for tests: normalised byte histogram."""
    def predict(contents: np.ndarray) -> np.ndarray:
        out = np.zeros((len(contents), dim), dtype=np.float32)
        for i, b in enumerate(contents):
            arr = np.frombuffer(bytes(b), dtype=np.uint8)
            h = np.bincount(arr % dim, minlength=dim).astype(np.float32)
            n = np.linalg.norm(h)
            out[i] = h / n if n else h
        return out
    return predict
