"""Tokens, quantization and id sequences as column expressions."""

import re
from decimal import ROUND_HALF_UP, Decimal
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from figmill import constants as C
from figmill.functions.hashing import TWO_32, bound, entries, hash_heads, stem

# The token patterns as Python reads them: its blanks are those the pattern leaves out.
_TOKEN = re.compile(
    C.TOKEN_PATTERN.replace(r"(?U:[^\s\x1c-\x1f])", r"\S").replace(r"\d", "[0-9]")
)
_FLOAT = re.compile(C.FLOAT_PATTERN.replace(r"\d", "[0-9]"))


def quantized(value: Column, low=C.CANVAS_MIN, high=C.CANVAS_MAX, step=C.COORDINATE_STEP) -> Column:
    """Clamp to the canvas and snap to the nearest bin, halves to the even bin."""
    if low >= high:
        raise ValueError(f"The canvas from {low} to {high} is empty.")
    if step <= 0:
        raise ValueError(f"A grid cannot advance by {step}.")
    clamped = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value.cast("double")))
    snapped = F.lit(float(low)) + F.rint((clamped - F.lit(float(low))) / F.lit(step)) * F.lit(step)
    # A decimal has no negative zero.
    return snapped.cast("decimal(12,4)").cast("double")


def quantized_point(point: Column, **grid) -> Column:
    return F.struct(
        quantized(point["x"], **grid).alias("x"), quantized(point["y"], **grid).alias("y")
    )


def number_text(value: Column) -> Column:
    """Shortest text with at most four decimals: ``1.2``, ``-0.05``, ``3``."""
    return F.rtrim(F.rtrim(value.cast("decimal(12,4)").cast("string"), F.lit("0")), F.lit("."))


def tokens(column, quantize: bool = True, step: float = C.COORDINATE_STEP) -> Column:
    """Markup tokens; only literals with a decimal point are quantized."""
    if step <= 0:
        raise ValueError(f"A grid cannot advance by {step}.")

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return token_batch(texts, step if quantize else None)

    return found(column)


def token_batch(texts: pa.Array, step: float | None) -> pa.Array:
    """Tokens of every text of a batch; null for null texts. A literal that occurs often is
    quantized once a batch."""
    rows = [_TOKEN.findall(text) if text is not None else () for text in texts.to_pylist()]
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(row) for row in rows], out=offsets[1:])
    values = pa.array(chain.from_iterable(rows), pa.string())
    if step is not None:
        coded = values.dictionary_encode()
        words = [grid_text(w, step) if _FLOAT.match(w) else w for w in coded.dictionary.to_pylist()]
        values = pa.array(words, pa.string()).take(coded.indices)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pc.is_null(texts))


def grid_text(literal: str, step: float) -> str:
    """:func:`number_text` of the :func:`quantized` literal."""
    clamped = max(C.CANVAS_MIN, min(C.CANVAS_MAX, float(literal)))
    snapped = C.CANVAS_MIN + float(np.rint((clamped - C.CANVAS_MIN) / step)) * step
    value = Decimal(repr(snapped)).quantize(Decimal("0.0001"), ROUND_HALF_UP)
    return f"{value if value else abs(value):f}".rstrip("0").rstrip(".")


def words(column) -> Column:
    """Blank-separated words; no empty ones."""
    return F.filter(F.split(column, r"\s+"), lambda w: w != "")


def family_tagged(family: Column, markup: Column) -> Column:
    return F.concat(F.lit("<FAM:"), family, F.lit("> "), markup)


def framed(ids: Column, max_length: int = C.MAX_SEQUENCE) -> Column:
    """``[BOS, ids, EOS, PAD...]`` of exactly ``max_length``; truncation drops EOS."""
    if max_length <= 0:
        raise ValueError(f"A frame of {max_length} ids cannot hold a sequence.")
    whole = F.concat(F.array(F.lit(C.BOS)), ids, F.array(F.lit(C.EOS)))
    padding = F.array_repeat(F.lit(C.PAD), F.lit(max_length) - F.size(whole))
    return F.slice(F.concat(whole, padding), 1, max_length)


def without(ids: Column, dropped) -> Column:
    """Ids apart from the ``dropped`` ones; padding, named first, goes before the rest is looked at."""
    for value in dropped:
        ids = F.array_remove(ids, F.lit(value))
    return ids


def decoder_input(ids: Column) -> Column:
    return F.slice(ids, F.lit(1), F.size(ids) - 1)


def decoder_target(ids: Column) -> Column:
    return F.slice(ids, F.lit(2), F.size(ids) - 1)


def word_dropout(ids: Column, seed, key, probability: float = C.WORD_DROPOUT) -> Column:
    """Replace ids by UNK with the given probability; BOS stays."""
    if not 0.0 <= probability <= 1.0:
        raise ValueError(f"Not a probability: {probability}.")

    @F.arrow_udf("array<int>")
    def dropped(stems: pa.Array, batch: pa.Array) -> pa.Array:
        return dropped_batch(stems, batch, probability)

    return dropped(stem(seed, key), ids)


def dropped_batch(stems: pa.Array, ids: pa.Array, probability: float) -> pa.Array:
    """Ids of a batch with UNK where the draw of their place is under ``probability``."""
    values, offsets = entries(ids)
    sizes = np.diff(offsets)
    drawn = np.flatnonzero(pc.fill_null(pc.not_equal(values, C.BOS), False).to_numpy(zero_copy_only=False))
    owners = np.repeat(np.arange(len(sizes)), sizes)[drawn]
    hit = np.zeros(len(values), bool)
    hit[drawn] = hash_heads(stems, owners, drawn - offsets[owners]) / TWO_32 < probability
    kept = pc.if_else(pa.array(hit), pa.scalar(C.UNK, pa.int32()), values.cast(pa.int32()))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), kept, mask=pc.is_null(ids))


def token_class(token: Column) -> Column:
    return (
        F.when(token.rlike(C.NUMERIC_TOKEN_PATTERN), "numeric")
        .when(token.isin(*C.GEOMETRIC_TOKENS), "geometric")
        .when(token.isin(*C.BOILERPLATE_TOKENS), "boilerplate")
        .otherwise("other")
    )


def class_weight(name: Column, weights=C.CLASS_WEIGHTS) -> Column:
    branches = None
    for label, weight in weights:
        branches = (
            F.when(name == label, F.lit(weight))
            if branches is None
            else branches.when(name == label, F.lit(weight))
        )
    return branches


def sequence_audit(ids: Column) -> dict[str, Column]:
    """Length, sentinel and padding facts of an id sequence."""
    eos = F.array_position(ids, F.lit(C.EOS))

    def count_of(value: int) -> Column:
        return (total - F.size(F.array_remove(ids, F.lit(value)))).cast("long")

    total = F.size(ids).cast("long")
    return {
        "total_length": total,
        "has_bos": F.array_contains(ids, F.lit(C.BOS)),
        "has_eos": eos > 0,
        "eos_position": F.when(eos > 0, eos - 1),
        "length_to_eos": F.when(eos > 0, eos).otherwise(total),
        "unk_count": count_of(C.UNK),
        "pad_count": count_of(C.PAD),
    }


def reconstructed(tokens_column: Column) -> Column:
    """Markup from decoded tokens: family tags out, root tags forced to both ends."""
    openers = [f"\\begin{{{name}}}" for name in C.ROOT_ENVIRONMENTS]

    def rooted(body: Column) -> Column:
        return bound(
            F.try_element_at(F.filter(body, lambda t: t.isin(*openers)), F.lit(1)),
            lambda root: F.when(root.isNotNull(), closed(body, root)).otherwise(bare(body)),
        )

    def closed(body: Column, root: Column) -> Column:
        closer = F.replace(root, F.lit("\\begin"), F.lit("\\end"))
        whole = F.when(F.try_element_at(body, F.lit(1)) == root, body).otherwise(
            F.concat(F.array(root), F.filter(body, lambda t: t != root))
        )
        return bound(
            whole,
            lambda opened: F.when(F.try_element_at(opened, F.lit(-1)) == closer, opened).otherwise(
                F.concat(F.filter(opened, lambda t: t != closer), F.array(closer))
            ),
        )

    def bare(body: Column) -> Column:
        return F.concat(
            F.array(F.lit(C.BEGIN_PICTURE)),
            F.filter(body, lambda t: (t != C.BEGIN_PICTURE) & (t != C.END_PICTURE)),
            F.array(F.lit(C.END_PICTURE)),
        )

    untagged = F.filter(tokens_column, lambda t: ~(t.startswith("<FAM:") & t.rlike(r"^<FAM:.*>$")))
    return F.array_join(bound(untagged, rooted), " ")
