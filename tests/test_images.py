"""Image path with a stand-in backbone on generated files."""

import os
import tempfile

from pyspark.sql import functions as F

from ordlens.operators import images as IM
from ordlens.sources.tables import read_images


def test_featurize_classify_and_missing(spark):
    d = tempfile.mkdtemp(prefix="ordlens-img-")
    for i in range(5):
        with open(os.path.join(d, f"img{i}.bin"), "wb") as f:
            f.write(bytes([(i * 7 + j) % 256 for j in range(300)]))
    listing = read_images(spark, d)
    feats = IM.featurize(listing, lambda: IM.byte_histogram_model(16), 16, batch_size=2)
    rows = feats.select("path", "embedding").collect()
    assert len(rows) == 5 and all(len(r.embedding) == 16 for r in rows)
    w = [[1.0 if j == c else 0.0 for j in range(16)] for c in range(10)]
    out = IM.classify(feats, w, [0.0] * 10).select("predicted_category", "confidence").collect()
    assert all(r.predicted_category for r in out) and all(0 < r.confidence <= 1 for r in out)
    req = spark.createDataFrame([("file:" + os.path.join(d, "img0.bin"),), ("file:/nope.png",)], "image_path string")
    missing = [r.image_path for r in IM.missing_images(req, listing).collect()]
    assert missing == ["file:/nope.png"]


def test_channel_normalize_grey_to_three(spark):
    df = spark.createDataFrame([([0, 255],)], "px array<int>")
    half = (0.5, 0.5, 0.5)
    v = df.select(IM.channel_normalize(F.col("px"), half, half).alias("v")).first().v
    assert v == [-1.0, 1.0, -1.0, 1.0, -1.0, 1.0]
    d = df.select(IM.channel_normalize(F.col("px")).alias("v")).first().v
    want = [(x - m) / s for m, s in zip((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)) for x in (0.0, 1.0)]
    assert all(abs(a - b) < 1e-12 for a, b in zip(d, want))
