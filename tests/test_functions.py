import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake.functions import exprs
from photolake.functions.features import colorfulness, dhash, fit, image_metrics, laplacian_variance, scaled
from photolake.sources.decode import decode, decode_png, from_jvm
from photolake.sources.png import bright_page, checkerboard, encode_png, flat

U64 = 1 << 64

# computed from the published formulas
GOLDEN = [
    (checkerboard(128, 128, 8), 72340172838076673, 447.1597, 78.91, 197.6195),
    (checkerboard(160, 120, 10), 76578790164140033, 339.1146, 78.91, 197.6195),
    (checkerboard(160, 120, 10, 1), 76578790164140033, 345.7049, 78.91, 197.6195),
    (checkerboard(160, 120, 10, 5), 306315160656560132, 352.2952, 78.91, 197.6195),
    (flat(128, 128, 128), 0, 16.0, 128.5, 0.0),
    (bright_page(120, 160), 22517999479029840, 25924.9675, 241.4203, 0.9190),
    (checkerboard(160, 120, 8), 16, 448.9526, 78.91, 197.6195),
    (np.full((64, 64, 3), (200, 30, 30), np.uint8), 0, 0.0, 80.83, 57.0197),
    (np.full((64, 64, 3), (30, 200, 30), np.uint8), 0, 0.0, 129.79, 57.0197),
]


@pytest.mark.parametrize("img,h,blur,bright,color", GOLDEN)
def test_golden_metrics(img, h, blur, bright, color):
    m = image_metrics(img)
    assert m.dhash % U64 == h
    assert (round(m.blur_var, 4), round(m.brightness, 4), round(m.colorfulness, 4)) == (blur, bright, color)
    assert (m.width, m.height) == img.shape[1::-1]


def test_scaling_and_small_images():
    assert fit(1024, 512, 256) == (256, 128) and fit(3, 2000, 256) == (1, 256) and fit(100, 50, 256) == (100, 50)
    assert scaled(np.zeros((0, 0, 3), np.uint8)).shape == (1, 1, 3)
    assert scaled(np.full((600, 300, 3), 77, np.uint8)).shape == (256, 128, 3)
    assert laplacian_variance(np.zeros((2, 9))) == 0 and colorfulness(np.full((4, 4, 3), 9, np.uint8)) == 0


def test_truncation_variant():
    img = np.zeros((8, 9, 3), np.uint8)
    img[:, 0] = (1, 0, 0)  # luma 0.299
    assert dhash(img) == 0 and dhash(img, truncate=False) != 0


def test_png_round_trip_and_alpha():
    img = checkerboard(33, 21, 4)
    assert (decode("x.png", encode_png(img)) == img).all()
    rgba = np.concatenate([img, np.full((21, 33, 1), 128, np.uint8)], axis=2)
    assert (decode_png(encode_png(rgba)) == img.astype(int) * 128 // 255).all()
    assert (from_jvm(1, 1, 3, bytes([1, 2, 3])) == [[[3, 2, 1]]]).all()
    with pytest.raises(ValueError):
        decode_png(b"no image")


def test_expressions(spark):
    df = spark.createDataFrame([(0.5, 2.5, "/a/" + "x" * 60, -1), (1.5, -0.5, "short", 5)], "a double, b double, p string, h long")
    row = df.select(exprs.rounded(F.col("a")).alias("a"), exprs.rounded(F.col("b")).alias("b"), exprs.short_path(F.col("p")).alias("p"), exprs.unsigned(F.col("h")).cast("string").alias("h"), exprs.hamming(F.col("h"), F.lit(0)).alias("d"), exprs.clamp01(F.col("b")).alias("c")).collect()
    assert [tuple(r) for r in row] == [("0", "2", "..." + "x" * 48, str(U64 - 1), 64, 1.0), ("2", "0", "short", "5", 2, 0.0)]
    multi = spark.createDataFrame([("/" + "é" * 30,)], "p string").select(exprs.short_path(F.col("p"))).first()[0]
    assert multi == "..." + "é" * 24


def test_names_softmax_day(spark):
    df = spark.createDataFrame([("A Web Site", [1.0, 3.0, 3.0], 86399), ("dog", [0.0, 0.0, 0.0], 86400)], "n string, v array<double>, t long")
    rows = df.select(exprs.label_bucket(F.col("n")), exprs.argmax(F.col("v")), F.round(exprs.softmax_at(F.col("v"), exprs.argmax(F.col("v"))), 4), exprs.utc_day(F.col("t")), exprs.base_name(F.lit("/a/b.JPG")), exprs.extension(F.lit("/a.b/c.JPG"))).collect()
    assert [tuple(r) for r in rows] == [("document", 2, 0.4683, "1970-01-01", "b.JPG", ".jpg"), ("", 1, 0.3333, "1970-01-02", "b.JPG", ".jpg")]
