"""Raster jobs over ``image_id, channel, y, pixels``: one row per raster line."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill import constants as C
from figmill.functions.hashing import uniform
from figmill.sources.staging import stage

_LINE = ["image_id", "channel", "y"]


def _unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def normalized(lines: DataFrame) -> DataFrame:
    """Byte intensities to ``[0, 1]``."""
    return lines.withColumn("pixels", F.transform("pixels", lambda p: p / F.lit(255.0)))


def three_channels(lines: DataFrame) -> DataFrame:
    """Gray is replicated, alpha is dropped; images of other depth come out with
    ``unsupported`` set and keep their lines, so a caller can fail on them."""
    depth = (F.max("channel").over(W.partitionBy("image_id")) + 1).cast("int")
    target = (
        F.when(F.col("_depth") == 1, F.array(*[F.lit(c) for c in range(3)]))
        .when((F.col("_depth") == 4) & (F.col("channel") == 3), F.array().cast("array<int>"))
        .otherwise(F.array(F.col("channel").cast("int")))
    )
    return (
        lines.withColumn("_depth", depth)
        .withColumn("unsupported", ~F.col("_depth").isin(1, 3, 4))
        .withColumn("channel", F.explode(target))
        .drop("_depth")
    )


def _source(position: Column, size_in: Column, size_out: int):
    """Lower source index, upper source index and upper weight of a half-pixel center."""
    at = F.greatest(F.lit(0.0), (position + 0.5) * (size_in / F.lit(size_out)) - 0.5)
    low = F.least(F.floor(at).cast("int"), size_in - 1)
    return low, F.least(low + 1, size_in - 1), at - low


def resized(lines: DataFrame, height: int, width: int, to_bytes: bool = False) -> DataFrame:
    """Bilinear resize of images of any size. Lines are narrowed first; then every source
    line goes to the few target lines it feeds, so no task holds a whole image."""
    if height <= 0 or width <= 0:
        raise ValueError(f"An image of {height} by {width} pixels has no pixels.")
    measured = lines.withColumns(
        {
            "_width": F.size("pixels"),
            "_height": (F.max("y").over(W.partitionBy("image_id")) + 1).cast("int"),
        }
    )

    def sample(x: Column) -> Column:
        low, high, weight = _source(x, F.col("_width"), width)
        left, right = F.get(F.col("pixels"), low), F.get(F.col("pixels"), high)
        return left * (1.0 - weight) + right * weight

    across = measured.select(
        *_LINE, "_height",
        F.transform(F.sequence(F.lit(0), F.lit(width - 1)), sample).alias("pixels"),
    )

    def contribution(ty: Column) -> Column:
        low, high, weight = _source(ty, F.col("_height"), height)
        is_low, is_high = F.col("y") == low, F.col("y") == high
        share = F.when(is_low, 1.0 - weight).otherwise(0.0) + F.when(is_high, weight).otherwise(0.0)
        return F.struct(
            ty.alias("ty"), share.alias("weight"), is_low.alias("is_low"),
            (is_low | is_high).alias("used"),
        )

    targets = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(height - 1)), contribution), lambda t: t["used"]
    )
    fed = across.withColumn("t", F.explode(targets)).select(
        "image_id", "channel", F.col("t.ty").alias("y"), F.col("t.is_low").alias("is_low"),
        F.transform("pixels", lambda p: p * F.col("t.weight")).alias("part"),
    )
    merged = fed.groupBy(*_LINE).agg(
        F.max(F.when(F.col("is_low"), F.col("part"))).alias("_low"),
        F.max(F.when(~F.col("is_low"), F.col("part"))).alias("_high"),
    )
    pixels = F.when(F.col("_high").isNull(), F.col("_low")).otherwise(
        F.zip_with("_low", "_high", lambda a, b: a + b)
    )
    if to_bytes:
        # A level missed by rounding noise alone still counts as that level.
        pixels = F.transform(
            pixels, lambda p: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), p + 1e-9)))
        )
    return merged.select(*_LINE, pixels.alias("pixels"))


def encoder_input(lines: DataFrame, height: int, width: int) -> DataFrame:
    return resized(normalized(lines), height, width)


def _where(chosen: Column | None, changed: Column) -> Column:
    """New pixels where a line is chosen, all lines without a choice."""
    return changed if chosen is None else F.when(chosen, changed).otherwise(F.col("pixels"))


def noisy(lines: DataFrame, sigma: float, seed: int, chosen: Column | None = None) -> DataFrame:
    """Gaussian noise from hashed uniforms, clamped to ``[0, 1]``."""
    if not 0.0 < sigma <= 0.05:
        raise ValueError(f"Noise of strength {sigma} is none or too much; 0.05 is the most.")
    key = F.concat_ws("/", "image_id", "channel", "y")

    def add(pixel: Column, x: Column) -> Column:
        radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(seed, key, x * 2)))
        angle = F.lit(2.0 * math.pi) * uniform(seed, key, x * 2 + 1)
        return _unit(pixel + F.lit(sigma) * radius * F.cos(angle))

    return lines.withColumn("pixels", _where(chosen, F.transform("pixels", add)))


def contrasted(
    lines: DataFrame, alpha: float, batch: str, chosen: Column | None = None
) -> DataFrame:
    """Scale deviations from the mean of the batch."""
    if alpha < 0:
        raise ValueError(f"Contrast cannot be scaled by {alpha}; a negative factor inverts the image.")
    total = F.aggregate("pixels", F.lit(0.0), lambda a, p: a + p)
    means = lines.groupBy(batch).agg((F.sum(total) / F.sum(F.size("pixels"))).alias("_mean"))
    # Staged: one row per batch, so the pixels need not be shuffled to meet their mean.
    means = stage(means, "means")
    scaled = F.transform(
        "pixels", lambda p: _unit(F.lit(alpha) * p + F.lit(1.0 - alpha) * F.col("_mean"))
    )
    return lines.join(means, batch).withColumn("pixels", _where(chosen, scaled)).drop("_mean")


def blurred(lines: DataFrame, chosen: Column | None = None) -> DataFrame:
    """3x3 binomial blur with zero padding, clamped."""
    side, middle = C.BLUR_KERNEL[0], C.BLUR_KERNEL[1]
    last = F.size("pixels") - 1

    def across(pixel: Column, x: Column) -> Column:
        # get() is null outside the line.
        before = F.coalesce(F.get(F.col("pixels"), x - 1), F.lit(0.0))
        after = F.when(x < last, F.get(F.col("pixels"), x + 1)).otherwise(F.lit(0.0))
        return before * side + pixel * middle + after * side

    rows = lines.withColumn("_across", F.transform("pixels", across))
    order = W.partitionBy("image_id", "channel").orderBy("y")
    rows = rows.withColumns(
        {"_up": F.lag("_across").over(order), "_down": F.lead("_across").over(order)}
    )

    def down(pixel: Column, x: Column) -> Column:
        above = F.coalesce(F.get(F.col("_up"), x), F.lit(0.0))
        below = F.coalesce(F.get(F.col("_down"), x), F.lit(0.0))
        return _unit(above * side + pixel * middle + below * side)

    whole = _where(chosen, F.transform("_across", down))
    return rows.withColumn("pixels", whole).drop("_across", "_up", "_down")


def augmented(
    lines: DataFrame, seed: int, batch: str, sigma: float = 0.03, alpha: float = 1.0,
    blur: bool = True,
) -> DataFrame:
    """Noise, then contrast, then blur."""
    out = noisy(lines, sigma, seed)
    if alpha != 1.0:
        out = contrasted(out, alpha, batch)
    return blurred(out) if blur else out


def maybe_augmented(
    lines: DataFrame, seed: int, batch: str, probability: float, sigma: float = 0.03,
    alpha: float = 1.0, blur: bool = True,
) -> DataFrame:
    """Noise, contrast and blur, each on the batches that its own coin chooses."""
    if not 0.0 <= probability <= 1.0:
        raise ValueError(f"Not a probability: {probability}.")

    def coin(step: str) -> Column:
        return uniform(seed, F.col(batch), step) < probability

    out = noisy(lines, sigma, seed, coin("noise"))
    if alpha != 1.0:
        out = contrasted(out, alpha, batch, coin("contrast"))
    return blurred(out, coin("blur")) if blur else out


def _gaussian_weights(size: int, sigma: float) -> list[float]:
    raw = [math.exp(-((i - size // 2) ** 2) / (2.0 * sigma * sigma)) for i in range(size)]
    return [w / sum(raw) for w in raw]


#: Windows of one tile of an image, down and across.
_TILE_LINES, _TILE_WIDTH = 256, 512


def ssim(
    pairs: DataFrame, data_range: float = 1.0, window: int = C.SSIM_WINDOW,
    k1: float = C.SSIM_K1, k2: float = C.SSIM_K2,
) -> DataFrame:
    """Mean SSIM per image from ``image_id, channel, y, a, b``; images may differ in size, and one
    that is smaller than the window has a null.

    Images are cut into tiles of ``_TILE_LINES`` by ``_TILE_WIDTH`` windows, whose edges carry the
    lines and columns a window needs beyond them. The Gaussian window separates: in a tile every
    line is convolved in its own row, then lines are combined over a sliding frame of ``window``
    rows. Frames that are not full are dropped, which is the valid convolution. So neither a row nor
    a window partition grows with an image, and one large image is shared by many tasks.
    """
    if data_range <= 0:
        raise ValueError(f"Intensities cannot span a range of {data_range}.")
    if window < 3 or window % 2 == 0:
        raise ValueError(f"A window of {window} lines has no center line with neighbours.")
    weights = _gaussian_weights(window, C.SSIM_SIGMA)
    c1, c2 = (k1 * data_range) ** 2, (k2 * data_range) ** 2
    reach = window - 1
    strips = F.sequence(
        F.lit(0), F.floor(F.greatest(F.size("a") - window, F.lit(0)) / _TILE_WIDTH).cast("int")
    )
    band = F.floor(F.col("y") / _TILE_LINES).cast("long")
    bands = F.when(
        F.col("y") % _TILE_LINES < reach, F.array(band, band - 1)
    ).otherwise(F.array(band))
    tiles = (
        pairs.select(*_LINE, "a", "b", F.explode(strips).alias("_strip"))
        .select(
            *_LINE, "_strip",
            *[
                F.slice(n, F.col("_strip") * _TILE_WIDTH + 1, F.lit(_TILE_WIDTH + reach)).alias(n)
                for n in ("a", "b")
            ],
            F.explode(bands).alias("_band"),
            band.alias("_own"),
        )
    )
    size = F.size("a")
    starts = F.when(size >= window, F.sequence(F.lit(0), size - window)).otherwise(
        F.array().cast("array<int>")
    )

    def dot(term) -> Column:
        """Sum of the weighted terms of a window, written out."""
        return sum((term(k) * F.lit(w) for k, w in enumerate(weights[1:], 1)), term(0) * weights[0])

    def along(*names: str) -> Column:
        def term(x: Column, k: int) -> Column:
            values = [F.get(F.col(n), x + k) for n in names]
            return values[0] if len(values) == 1 else values[0] * values[1]

        return F.transform(starts, lambda x: dot(lambda k: term(x, k)))

    moments = {
        "_a": along("a"),
        "_b": along("b"),
        "_aa": along("a", "a"),
        "_bb": along("b", "b"),
        "_ab": along("a", "b"),
    }
    packed = F.struct(*[c.alias(n) for n, c in moments.items()])
    rows = tiles.select(
        *_LINE, "_strip", "_band", "_own",
        F.greatest(size - reach, F.lit(0)).alias("_n"), packed.alias("_m"),
    )
    frame = W.partitionBy("image_id", "channel", "_band", "_strip").orderBy("y").rowsBetween(0, reach)
    framed = rows.select(*_LINE, "_band", "_own", "_n", F.collect_list("_m").over(frame).alias("_f"))
    full = (F.size("_f") == window) & (F.col("_band") == F.col("_own"))
    places = F.when(full & (F.col("_n") > 0), F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(
        F.array().cast("array<int>")
    )

    def local(x: Column) -> Column:
        def down(name: str) -> Column:
            return dot(lambda k: F.get(F.get(F.col("_f"), F.lit(k))[name], x))

        return F.struct(*[down(n).alias(n) for n in moments])

    def similarity(m: Column) -> Column:
        aa, bb, ab = m["_a"] * m["_a"], m["_b"] * m["_b"], m["_a"] * m["_b"]
        top = (2.0 * ab + c1) * (2.0 * (m["_ab"] - ab) + c2)
        bottom = (aa + bb + c1) * ((m["_aa"] - aa) + (m["_bb"] - bb) + c2)
        return top / bottom

    scored = framed.withColumn("_v", F.transform(F.transform(places, local), similarity))
    total = F.aggregate("_v", F.lit(0.0), lambda acc, v: acc + v)
    return scored.groupBy("image_id").agg(
        F.try_divide(F.sum(total), F.sum(F.size("_v"))).alias("ssim")
    )
