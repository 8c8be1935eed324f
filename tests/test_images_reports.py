import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from figmill import constants as C
from figmill.operators import images as I
from figmill.operators import report as H


def lines(spark, *images):
    rows = [(i, 0, y, [float(v) for v in row]) for i, image in enumerate(images) for y, row in enumerate(image)]
    return spark.createDataFrame(rows, "image_id int, channel int, y int, pixels array<double>")


def pixels(df, image=0):
    rows = df.filter(f"image_id = {image}").orderBy("channel", "y").collect()
    return np.array([r["pixels"] for r in rows])


def bilinear(image, height, width):
    def axis(size_in, size_out):
        at = np.maximum((np.arange(size_out) + 0.5) * size_in / size_out - 0.5, 0)
        low = np.minimum(np.floor(at).astype(int), size_in - 1)
        return low, np.minimum(low + 1, size_in - 1), at - low

    y0, y1, wy = axis(image.shape[0], height)
    x0, x1, wx = axis(image.shape[1], width)
    top = image[y0][:, x0] * (1 - wx) + image[y0][:, x1] * wx
    bottom = image[y1][:, x0] * (1 - wx) + image[y1][:, x1] * wx
    return top * (1 - wy[:, None]) + bottom * wy[:, None]


@pytest.mark.parametrize("height, width", [(3, 5), (8, 8), (13, 2), (1, 1)])
def test_resize(spark, height, width):
    rng = np.random.default_rng(1)
    image, other = rng.integers(0, 256, (6, 9)), rng.integers(0, 256, (4, 3))
    out = I.resized(lines(spark, image, other), height, width)
    assert pixels(out, 0) == pytest.approx(bilinear(image.astype(float), height, width))
    assert pixels(out, 1) == pytest.approx(bilinear(other.astype(float), height, width))


def test_blur_and_contrast(spark):
    rng = np.random.default_rng(2)
    image = rng.random((5, 7))
    padded = np.pad(image, 1)
    k = np.array([0.25, 0.5, 0.25])
    expected = sum(k[i] * k[j] * padded[i : i + 5, j : j + 7] for i in range(3) for j in range(3))
    assert pixels(I.blurred(lines(spark, image))) == pytest.approx(expected)
    toned = I.contrasted(lines(spark, image).withColumn("b", F.lit(1)), 1.3, "b")
    assert pixels(toned) == pytest.approx(np.clip(1.3 * image - 0.3 * image.mean(), 0, 1))
    assert pixels(I.contrasted(lines(spark, image).withColumn("b", F.lit(1)), 1.0, "b")) == pytest.approx(image)


def test_noise_is_seeded(spark):
    image = np.full((20, 50), 0.5)
    first, second = (pixels(I.noisy(lines(spark, image).repartition(n), 0.05, 7)) for n in (1, 5))
    assert (first == second).all() and abs(first.std() - 0.05) < 0.005 and abs(first.mean() - 0.5) < 0.01
    with pytest.raises(ValueError):
        I.noisy(lines(spark, image), 0.06, 7)


def test_channels(spark):
    assert I.three_channels(lines(spark, np.ones((2, 2)))).select("channel").distinct().count() == 3
    four = lines(spark, np.ones((1, 2))).withColumn("channel", F.explode(F.array(*[F.lit(c) for c in range(4)])))
    assert sorted(r["channel"] for r in I.three_channels(four).collect()) == [0, 1, 2]
    two = four.filter("channel < 2")
    assert all(r["unsupported"] for r in I.three_channels(two).collect())


def brute_ssim(a, b):
    w = np.exp(-((np.arange(11) - 5) ** 2) / 4.5)
    window = np.outer(w, w) / np.outer(w, w).sum()
    values = []
    for y in range(a.shape[0] - 10):
        for x in range(a.shape[1] - 10):
            p, q = a[y : y + 11, x : x + 11], b[y : y + 11, x : x + 11]
            ma, mb = (window * p).sum(), (window * q).sum()
            va, vb = (window * p * p).sum() - ma * ma, (window * q * q).sum() - mb * mb
            cov = (window * p * q).sum() - ma * mb
            values.append((2 * ma * mb + 1e-4) * (2 * cov + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4)))
    return float(np.mean(values))


def test_ssim(spark):
    rng = np.random.default_rng(4)
    a, b = rng.random((13, 15)), rng.random((13, 15))
    both = lines(spark, a, a).withColumnRenamed("pixels", "a").join(
        lines(spark, a, b).withColumnRenamed("pixels", "b"), ["image_id", "channel", "y"]
    )
    found = {r["image_id"]: r["ssim"] for r in I.ssim(both).collect()}
    assert found[0] == pytest.approx(1.0) and found[1] == pytest.approx(brute_ssim(a, b))
    with pytest.raises(ValueError):
        I.ssim(both, window=4)


def test_ssim_in_tiles(spark, monkeypatch):
    """Images over several tiles down and across, and one 4,096 wide."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(I, "_TILE_LINES", 16)
    monkeypatch.setattr(I, "_TILE_WIDTH", 7)
    shapes = [(40, 33), (11, 11), (16, 17), (27, 18)]
    images = [(rng.random(s), rng.random(s)) for s in shapes]
    left, right = (lines(spark, *[p[k] for p in images]).withColumnRenamed("pixels", "ab"[k]) for k in (0, 1))
    found = {r["image_id"]: r["ssim"] for r in I.ssim(left.join(right, ["image_id", "channel", "y"])).collect()}
    assert found == {n: pytest.approx(brute_ssim(a, b)) for n, (a, b) in enumerate(images)}
    monkeypatch.undo()
    a, b = rng.random((12, 4096)), rng.random((12, 4096))
    wide = lines(spark, a).withColumnRenamed("pixels", "a").join(
        lines(spark, b).withColumnRenamed("pixels", "b"), ["image_id", "channel", "y"]
    )
    assert I.ssim(wide).first()["ssim"] == pytest.approx(brute_ssim(a, b))


def test_mean_std_text(one):
    assert one(H.mean_std_text(F.lit(0.85432), F.lit(0.01234)), x=1) == "0.854 \\pm 0.012"
    assert one(H.fixed_text(F.lit(0.125), 2), x=1) == "0.12"
    assert one(H.fixed_text(F.lit(-0.07), 3, sign=True), x=1) == "-0.070"


def test_seed_statistics(spark):
    rows = [("m", "t", s, v, 1.0, 1.0, 1.0, 1.0) for s, v in enumerate((1.0, 2.0, 3.0))] + [("n", "t", 0, 4.2, 1.0, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "model string, tier string, seed int, corpus_bleu double, mean_geometric_edit_distance double, "
                                        "mean_graph_edit_distance double, compilation_rate double, mean_ssim double")
    found = {r["model"]: (r["mean"], r["std"]) for r in H.seed_statistics(frame).filter("metric = 'corpus_bleu'").collect()}
    assert found == {"m": (2.0, 1.0), "n": (4.2, 0.0)}


def test_tables(spark):
    stats = spark.createDataFrame(
        [(m, t, "corpus_bleu", 0.85, 0.02) for m, t in (("baseline", "tier1"), ("baseline", "tier2"), ("mixed", "tier1"))]
        + [("baseline", "tier1", "compilation_rate", 0.95, 0.02)],
        "model string, tier string, metric string, mean double, std double",
    )
    lines_ = [r["line"] for r in H.multitier_lines(stats).orderBy("line_no").collect()]
    assert lines_[0].startswith("\\textbf{Baseline} & TIER1 & 0.850 \\pm 0.020") and "95.0 \\pm 2.0" in lines_[0]
    assert lines_[1].startswith(" & TIER2") and lines_[2] == "\\midrule" and lines_[3].startswith("\\textbf{Mixed}")
    assert len(lines_) == 4 and lines_[0].endswith(" \\\\")
    variants = spark.createDataFrame(
        [("Full", 0.62, 0.5, 0.9, 0.7), ("No curriculum", 0.55, 0.6, 0.8, 0.7)],
        "variant string, corpus_bleu double, mean_graph_edit_distance double, compilation_rate double, mean_ssim double",
    )
    table = {r["variant"]: r["line"] for r in H.ablation_lines(H.ablation_deltas(variants)).collect()}
    assert "(-0.070)" in table["No curriculum"] and "80.0\\% (-10.0)" in table["No curriculum"] and "(" not in table["Full"]


def test_gap_and_epochs(spark):
    frame = spark.createDataFrame([("tier1", "corpus_bleu", 0.3326), ("tier2", "corpus_bleu", 0.0308)], "tier string, metric string, value double")
    assert H.generalization_gap(frame, ("corpus_bleu",)).first()["gap"] == pytest.approx(0.3018)
    losses = [3.0, 2.0, 2.0, 4.0, 1.0]
    epochs = spark.createDataFrame([("s", i, v, 10, 1) for i, v in enumerate(losses)], "stage string, epoch int, val_loss double, samples int, elapsed_seconds int")
    marks = [r["is_best"] for r in H.best_so_far(epochs, "stage", "epoch", "val_loss").orderBy("epoch").collect()]
    assert marks == [True, True, False, False, True]
    summary = H.stage_summary(epochs.filter("epoch < 4"), "stage", "epoch", "val_loss").first()
    assert (summary["best_epoch"], summary["best_val_loss"], summary["samples"]) == (1, 2.0, 40)
    assert not math.isnan(summary["elapsed_seconds"])


def test_fixed_text_rounds_the_exact_value(spark):
    values = [2.675, 1.005, 0.125, 0.375, 2.5, -2.675, 0.0005, 1e-9, 0.9995, 12345.6785, 0.85432, -0.0004, 1.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for decimals in (0, 1, 2, 3, 4):
        got = [r[0] for r in frame.select(H.fixed_text(F.col("v"), decimals)).collect()]
        assert [float(g) for g in got] == [float(f"{v:.{decimals}f}") for v in values], decimals
        assert [g.lstrip("-") for g in got] == [f"{v:.{decimals}f}".lstrip("-") for v in values]


def test_table_of_a_lower_case_model(spark):
    rows = [("mixed run", "tier1", m, 0.5, 0.1) for m in C.TIER_METRICS]
    stats = spark.createDataFrame(rows, "model string, tier string, metric string, mean double, std double")
    lines = [r["line"] for r in H.whole_table(H.multitier_lines(stats), "multitier").orderBy("line_no").collect()]
    assert "\\textbf{Mixed run}" in lines[len(H.TABLE_HEADS["multitier"])]
    assert lines[0] == H.TABLE_HEADS["multitier"][0] and lines[-1] == H.TABLE_FEET["multitier"][-1]


def test_missing_metric_is_a_gap(spark):
    rows = [("tier1", "a", 1.0), ("tier1", "b", 2.0), ("tier2", "a", 0.25)]
    metrics = spark.createDataFrame(rows, "tier string, metric string, value double")
    found = {(r["tier"], r["metric"]): r["gap"] for r in H.generalization_gap(metrics, ("a", "b")).collect()}
    assert found == {("tier2", "a"): 0.75, ("tier2", "b"): 2.0}


def test_ssim_of_images_of_different_width(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for image, width in enumerate((20, 14, 6)):
        a, b = rng.random((12, width)), rng.random((12, width))
        want[image] = brute_ssim(a, b) if width >= 11 else None
        rows += [(image, 0, y, a[y].tolist(), b[y].tolist()) for y in range(12)]
    pairs = spark.createDataFrame(rows, "image_id int, channel int, y int, a array<double>, b array<double>")
    found = {r["image_id"]: r["ssim"] for r in I.ssim(pairs).collect()}
    assert found[2] is None and all(found[n] == pytest.approx(want[n]) for n in (0, 1))
