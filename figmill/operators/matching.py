"""The scores that need an algorithm per pair: n-gram matches, alignment and assignment.

Spark builds, joins and partitions the pairs; these Arrow functions only score the
batch of rows a task hands them.
"""

from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from figmill import constants as C

# Cells of one padded alignment block; bounds the memory of a batch, not its result.
_BLOCK_CELLS = 1 << 21
# Pairs of a block, and the lengths that count as alike.
_TOGETHER, _LIKE = 512, 16
# Names of n-grams stay below.
_WORD = 1 << 62
# Odd multipliers of the two hashes of a row.
_MIXERS = [
    (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)),
    (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)),
]


# --- Alignment -------------------------------------------------------------------------------


def _batch_points(codes, rows, words):
    """Coordinates carried by each token; NaN for structural ones.

    A point is either one token ``(x, y)`` or five tokens ``( x , y )``; in the long form
    the parenthesis and both numbers carry it.
    """
    texts = pa.array(words, pa.string())
    short = pc.extract_regex(texts, "^" + C.POINT_PATTERN.replace("(-?", "(?P<x>-?", 1).replace(
        "(-?", "(?P<y>-?", 1) + "$")
    number = pc.match_substring_regex(texts, C.NUMBER_PATTERN).to_numpy(zero_copy_only=False)
    values = np.array(
        [float(w) if ok else np.nan for w, ok in zip(words, number)], dtype=np.float64
    )
    xs = np.full(len(words) + 1, np.nan)
    ys = np.full(len(words) + 1, np.nan)
    for i, match in enumerate(short.to_pylist()):
        if match is not None:
            xs[i], ys[i] = float(match["x"]), float(match["y"])
    px, py = xs[codes], ys[codes]

    if len(codes) >= 5:
        lookup = {w: i for i, w in enumerate(words)}
        left, comma, right = (lookup.get(w, -2) for w in ("(", ",", ")"))
        vx, vy = values[codes[1:-3]], values[codes[3:-1]]
        hit = (
            (codes[:-4] == left) & (codes[2:-2] == comma) & (codes[4:] == right)
            & ~np.isnan(vx) & ~np.isnan(vy) & (rows[:-4] == rows[4:])
        )
        start = np.flatnonzero(hit)
        for shift in (0, 1, 3):
            px[start + shift], py[start + shift] = vx[start], vy[start]
    return px, py


def _padded(values, offsets, picked, width, fill):
    """Rows of a batch as columns of a block."""
    sizes = offsets[picked + 1] - offsets[picked]
    column = np.repeat(np.arange(len(picked)), sizes)
    place = np.arange(len(column)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    block = np.full((width, len(picked)), fill, dtype=values.dtype)
    block[place, column] = values[np.repeat(offsets[picked], sizes) + place]
    return block


def _substitution(reference, candidate, scale):
    """Cost of putting one token for another: their distance where both carry a point."""
    r_code, r_x, r_y = reference
    c_code, c_x, c_y = candidate
    cost = (r_code != c_code).astype(np.float64)
    far, dy = r_x - c_x, r_y - c_y
    far *= far
    dy *= dy
    far += dy
    np.sqrt(far, out=far)
    far /= scale
    np.minimum(far, 1.0, out=far)
    np.copyto(cost, far, where=far == far)
    return cost


def _align_block(reference, candidate, lengths, scale):
    """Edit distances of one padded block, one antidiagonal of all its tables after another."""
    m, n = lengths
    width, depth = len(reference[0]), len(candidate[0])
    backwards = [np.ascontiguousarray(side[::-1]) for side in candidate]
    ends = np.argsort(m + n, kind="stable")
    upto = np.searchsorted((m + n)[ends], np.arange(width + depth + 2))
    result = np.zeros(len(m))
    # Place i of a line holds the cell of i reference tokens and the rest of the line's number.
    older, old, line = (np.empty((width + 1, len(m))) for _ in range(3))
    for total in range(width + depth + 1):
        low, high = max(1, total - depth), min(total - 1, width)
        if low <= high:
            shift = depth - total
            cost = _substitution(
                [side[low - 1 : high] for side in reference],
                [side[low + shift : high + shift + 1] for side in backwards],
                scale,
            )
            cost += older[low - 1 : high]
            best = line[low : high + 1]
            np.minimum(old[low - 1 : high], old[low : high + 1], out=best)
            best += 1.0
            np.minimum(best, cost, out=best)
        if total <= depth:
            line[0] = total
        if total <= width:
            line[total] = total
        done = ends[upto[total] : upto[total + 1]]
        result[done] = line[m[done], done]
        older, old, line = old, line, older
    return result


def _near_diagonal(reference, candidate, lengths, scale):
    """Distances of padded pairs whose lengths differ by one at most, and whether they are proven.

    Equally long pairs are compared place by place, others with one token left out at the best
    place. Any other alignment leaves out two tokens more, so cheaper ones do not exist up to a cost
    of two beyond the difference in length.
    """
    m, n = lengths
    places = np.arange(min(len(reference[0]), len(candidate[0])))[:, None]
    inside = places < np.minimum(m, n)

    def costs(skip_left: int, skip_right: int):
        left = [side[skip_left : skip_left + len(places)] for side in reference]
        right = [side[skip_right : skip_right + len(places)] for side in candidate]
        reach = min(len(left[0]), len(right[0]))
        found = _substitution([s[:reach] for s in left], [s[:reach] for s in right], scale)
        out = np.zeros(inside.shape)
        np.copyto(out[:reach], found, where=inside[:reach])
        return out

    straight = costs(0, 0)
    best = straight.sum(axis=0)
    for gap in (-1, 1):
        some = np.flatnonzero(m - n == gap)
        if len(some):
            late = costs(int(gap > 0), int(gap < 0))[:, some]
            saved = np.cumsum(straight[:, some] - late, axis=0)
            least = np.minimum(saved.min(axis=0, initial=0.0), 0.0)
            best[some] = 1.0 + late.sum(axis=0) + least
    return best, best <= np.abs(m - n) + 2.0


def _flat(array: pa.Array):
    offsets = array.offsets.to_numpy().astype(np.int64)
    return array.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def _row_marks(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits of every row of codes, as two sums over its places; equal rows have equal ones."""
    sizes = np.diff(offsets)
    place = (np.arange(len(codes)) - np.repeat(offsets[:-1], sizes)).astype(np.uint64)
    marks = np.zeros((len(sizes), 2), np.uint64)
    with np.errstate(over="ignore"):
        for n, (a, b) in enumerate(_MIXERS):
            value = (codes.astype(np.uint64) + np.uint64(1)) * a + place * b
            value = (value ^ (value >> np.uint64(31))) * b
            value = (value ^ (value >> np.uint64(29))) * a
            total = np.concatenate(([np.uint64(0)], np.cumsum(value ^ (value >> np.uint64(32)))))
            marks[:, n] = total[offsets[1:]] - total[offsets[:-1]] + sizes.astype(np.uint64)
    return marks


def align_batch(reference: pa.Array, candidate: pa.Array, scale: float) -> pa.Array:
    """Normalised coordinate-aware edit distance of every pair of token lists.

    Equal pairs of a batch are aligned once, and like lengths together, so that neither copies nor a
    few long pairs are paid for by all.
    """
    flat = [_flat(pc.fill_null(side, pa.scalar([], side.type))) for side in (reference, candidate)]
    encoded = pa.concat_arrays([f[0].cast(pa.string()) for f in flat]).dictionary_encode()
    words, codes = encoded.dictionary.to_pylist(), encoded.indices.to_numpy()
    sides, at = [], 0
    for values, offsets in flat:
        part = codes[at : at + len(values)]
        at += len(values)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        sides.append((part, *_batch_points(part, rows, words), offsets))
    (rc, rx, ry, ro), (cc, cx, cy, co) = sides
    m, n = np.diff(ro), np.diff(co)
    marks = np.concatenate((_row_marks(rc, ro), _row_marks(cc, co)), axis=1)
    _, alone, same = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    result = np.zeros(len(m))

    def scored(rows, score):
        """``score`` of blocks of like rows, as ``(rows, value)``."""
        order = rows[np.lexsort((-m[rows], -(n[rows] // _LIKE)))]
        at = 0
        while at < len(order):
            near = order[at : at + _TOGETHER]
            widest = max(int(m[near].max()), int(n[near].max()), 1)
            take = max(1, min(_TOGETHER, _BLOCK_CELLS // (widest + 1)))
            picked = order[at : at + take]
            at += take
            mm, nn = m[picked], n[picked]
            width, depth = int(mm.max()), int(nn.max())
            yield picked, score(
                tuple(_padded(v, ro, picked, width, f) for v, f in ((rc, -1), (rx, np.nan), (ry, np.nan))),
                tuple(_padded(v, co, picked, depth, f) for v, f in ((cc, -1), (cx, np.nan), (cy, np.nan))),
                (mm, nn),
                scale,
            )

    unproven = [alone[np.abs(m[alone] - n[alone]) > 1]]
    for picked, (cost, proven) in scored(alone[np.abs(m[alone] - n[alone]) <= 1], _near_diagonal):
        result[picked] = cost
        unproven.append(picked[~proven])
    for picked, cost in scored(np.concatenate(unproven), _align_block):
        result[picked] = cost
    result /= np.maximum(np.maximum(m, n), 1)
    return pa.array(result[alone][same.ravel()], pa.float64())


def _coded(reference: pa.Array, candidate: pa.Array):
    """Integer codes and row numbers of both sides over one shared dictionary."""
    sides = [_flat(pc.fill_null(side, pa.scalar([], side.type))) for side in (reference, candidate)]
    words = pa.concat_arrays([s[0].cast(pa.string()) for s in sides]).dictionary_encode()
    codes, at, out = words.indices.to_numpy().astype(np.int64), 0, []
    for values, offsets in sides:
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        out.append((codes[at : at + len(values)], rows, np.diff(offsets)))
        at += len(values)
    return out


def match_batch(reference: pa.Array, candidate: pa.Array, max_order: int) -> pa.Array:
    """Per pair: both lengths, then clipped matches and candidate n-grams of every order.

    An n-gram is named by the pair (name of its first n-1 tokens, last token). Names are renumbered
    densely once they do not fit a word with row and side; a word's sort brings equal n-grams of a
    pair together.
    """
    (rc, rr, rn), (cc, cr, cn) = _coded(reference, candidate)
    pairs = len(rn)
    columns = [rn, cn]
    names, rows, side = np.concatenate([rc, cc]), np.concatenate([rr, cr]), len(rc)
    tokens = names
    is_candidate = np.arange(len(names)) >= side
    base = int(tokens.max()) + 1 if len(tokens) else 1
    width = base  # names are below
    ends = np.arange(len(tokens))  # index of the last token of every live n-gram
    for order in range(1, max_order + 1):
        if order > 1:
            nxt = ends + 1
            live = nxt < len(tokens)
            live[live] = (rows[nxt[live]] == rows[ends[live]]) & (
                is_candidate[nxt[live]] == is_candidate[ends[live]]
            )
            ends, names = nxt[live], names[live]
            names, width = names * base + tokens[ends], width * base
        if 2 * pairs * width * base > _WORD:
            _, names = np.unique(names, return_inverse=True)
            width = int(names.max()) + 1 if len(names) else 1
        keys = np.sort((rows[ends] * width + names) * 2 + is_candidate[ends])
        grams = keys >> 1
        first = np.flatnonzero(np.diff(grams, prepend=-1))
        many = np.diff(first, append=len(keys))
        in_candidate = np.add.reduceat(keys & 1, first) if len(first) else first
        owner = grams[first] // width
        clipped = np.minimum(in_candidate, many - in_candidate)
        columns.append(np.bincount(owner, weights=clipped, minlength=pairs))
        columns.append(np.bincount(owner, weights=in_candidate, minlength=pairs))
    table = np.stack(columns, axis=1).astype(np.int64)
    offsets = np.arange(0, table.size + 1, table.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.ravel()))


def ngram_matches(reference: Column, candidate: Column, max_order: int) -> Column:
    """``[reference length, candidate length, clipped 1, total 1, clipped 2, ...]``."""
    if max_order < 1:
        raise ValueError(f"There are no n-grams up to order {max_order}.")

    @F.arrow_udf("array<bigint>")
    def count(left: pa.Array, right: pa.Array) -> pa.Array:
        return match_batch(left, right, max_order)

    return count(reference, candidate)


def token_edit_distance(
    reference: Column, candidate: Column, scale: float = C.CANVAS_DIAGONAL
) -> Column:
    """Coordinate-aware edit distance of two token arrays, over the longer one."""
    if scale <= 0:
        raise ValueError(f"Distances are measured in units of scale, which cannot be {scale}.")

    @F.arrow_udf("double")
    def score(left: pa.Array, right: pa.Array) -> pa.Array:
        return align_batch(left, right, scale)

    return score(reference, candidate)


# --- Assignment ------------------------------------------------------------------------------

#: Matchings of so few columns are decided by looking at all of them.
_TRIED = 4
#: ``C.POINT_PATTERN`` after its bracket, for Arrow: white space and digits of Java.
_NUMBER, _SPACE = r"-?[0-9]+(?:\.[0-9]+)?", r"[\t\n\x0b\f\r ]*"
_AFTER_BRACKET = rf"^{_SPACE}(?P<x>{_NUMBER}){_SPACE},{_SPACE}(?P<y>{_NUMBER}){_SPACE}\)"
#: Costs of one stack of matrices; bounds the memory of a batch, not its result.
_STACK_CELLS = 1 << 20


def cheapest_assignments(cost: np.ndarray) -> np.ndarray:
    """Column of every row in the minimum-cost matching of each matrix of a stack.

    ``cost`` is ``(matrices, rows, columns)`` with no more rows than columns; every row gets a
    column of its own. All matrices are solved together.
    """
    _, rows, columns = cost.shape
    if rows > columns:
        raise ValueError(f"A stack needs rows <= columns. Got {rows} and {columns}.")
    if rows == 1:
        return cost.argmin(axis=2)
    if columns <= _TRIED:
        orders = np.array(list(permutations(range(columns), rows)))
        totals = cost[:, np.arange(rows), orders].sum(axis=2)
        return orders[totals.argmin(axis=1)]
    # No matching costs less than one that gives every row the column it would choose alone.
    out = cost.argmin(axis=2)
    chosen = np.sort(out, axis=1)
    shared = np.flatnonzero((chosen[:, 1:] == chosen[:, :-1]).any(axis=1))
    if len(shared):
        out[shared] = _augmented(cost[shared])
    return out


def _augmented(cost: np.ndarray) -> np.ndarray:
    """Successive shortest augmenting paths with dual prices, all matrices in step.

    One row enters at a time. Each matrix walks its own path; those whose path has reached a free
    column wait for the others.
    """
    matrices, rows, columns = cost.shape
    row_price, column_price = np.zeros((matrices, rows)), np.zeros((matrices, columns))
    owner = np.full((matrices, columns), -1)
    for row in range(rows):
        slack = np.full((matrices, columns), np.inf)
        came_from = np.full((matrices, columns), -1)
        reached = np.zeros((matrices, columns), dtype=bool)
        here = np.full(matrices, row)
        column = np.full(matrices, -1)
        walking = np.arange(matrices)
        while len(walking):
            w = walking
            seen = reached[w]
            reduced = cost[w, here[w]] - row_price[w, here[w]][:, None] - column_price[w]
            better = ~seen & (reduced < slack[w])
            open_slack = np.where(better, reduced, slack[w])
            came_from[w] = np.where(better, column[w][:, None], came_from[w])
            nearest = np.where(seen, np.inf, open_slack).argmin(axis=1)
            step = open_slack[np.arange(len(w)), nearest]
            row_price[w, row] += step
            k, settled = np.nonzero(seen)
            row_price[w[k], owner[w[k], settled]] += step[k]
            column_price[w] -= np.where(seen, step[:, None], 0.0)
            slack[w] = np.where(seen, open_slack, open_slack - step[:, None])
            reached[w, nearest] = True
            column[w] = nearest
            taken = owner[w, nearest] >= 0
            walking = w[taken]
            here[walking] = owner[walking, nearest[taken]]
        walking = np.arange(matrices)
        while len(walking):
            at = column[walking]
            before = came_from[walking, at]
            owner[walking, at] = np.where(before < 0, row, owner[walking, before])
            column[walking] = before
            walking = walking[before >= 0]
    out = np.empty((matrices, rows), dtype=np.int64)
    matrix, used = np.nonzero(owner >= 0)
    out[matrix, owner[matrix, used]] = used
    return out


def _stacks(rows: np.ndarray, columns: np.ndarray):
    """Yield ``(rows, columns, numbers)``: the matrices of one size, in stacks of bounded cells."""
    sizes = np.stack([rows, columns], axis=1)
    kinds, owner = np.unique(sizes, axis=0, return_inverse=True)
    order = np.argsort(owner.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(owner.ravel(), minlength=len(kinds)))
    for (m, n), first, last in zip(kinds.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
        take = max(1, _STACK_CELLS // max(1, m * n))
        for at in range(first, last, take):
            yield m, n, order[at : min(at + take, last)]


def _points(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All points of a batch and the offsets of its rows."""
    values, offsets = _flat(pc.fill_null(array, pa.scalar([], array.type)))
    xy = [values.field(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in ("x", "y")]
    return np.stack(xy, axis=1), offsets


def _points_of_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All coordinate literals of a batch and the offsets of its rows; null texts have none."""
    pieces = pc.split_pattern(pc.fill_null(texts, ""), "(")
    starts = pieces.offsets.to_numpy()
    found = pc.extract_regex(pieces.values, _AFTER_BRACKET)
    here = found.is_valid().to_numpy(zero_copy_only=False).copy()
    here[starts[:-1]] = False  # what precedes the first bracket of a text
    offsets = np.concatenate(([0], np.cumsum(here)))[starts]
    found = found.filter(pa.array(here))
    return np.stack([_numbers(found.field(axis)) for axis in ("x", "y")], axis=1), offsets


def _numbers(texts: pa.Array) -> np.ndarray:
    try:
        return pc.cast(texts, pa.float64()).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:  # too large for a double
        return np.array([float(text) for text in texts.to_pylist()])


def matched_point_errors(reference: pa.Array, candidate: pa.Array, scale: float) -> np.ndarray:
    """Per pair of point lists: clamped mean distance of the matching of least total distance."""
    return _matched_errors(*_points(reference), *_points(candidate), scale)


def matched_text_errors(reference: pa.Array, candidate: pa.Array, scale: float) -> pa.Array:
    """Per pair of markups: points of either side, null for a null text, and the error of
    :func:`matched_point_errors`."""
    (left, lo), (right, ro) = _points_of_texts(reference), _points_of_texts(candidate)
    counts = [
        pa.array(np.diff(offsets), mask=texts.is_null().to_numpy(zero_copy_only=False))
        for offsets, texts in ((lo, reference), (ro, candidate))
    ]
    errors = pa.array(_matched_errors(left, lo, right, ro, scale), pa.float64())
    return pa.StructArray.from_arrays([*counts, errors], names=["reference", "candidate", "error"])


def _matched_errors(
    left: np.ndarray, lo: np.ndarray, right: np.ndarray, ro: np.ndarray, scale: float
) -> np.ndarray:
    m, n = np.diff(lo), np.diff(ro)
    out = (np.maximum(m, n) > 0).astype(np.float64)
    some = np.flatnonzero((m > 0) & (n > 0))
    for rows, columns, own in _stacks(np.minimum(m, n)[some], np.maximum(m, n)[some]):
        own = some[own]
        swap = (m[own] > n[own])[:, None]
        a = np.where(swap, ro[own][:, None], lo[own][:, None]) + np.arange(rows)
        b = np.where(swap, lo[own][:, None], ro[own][:, None]) + np.arange(columns)
        few = np.where(swap[..., None], _taken(right, a, swap), _taken(left, a, ~swap))
        many = np.where(swap[..., None], _taken(left, b, swap), _taken(right, b, ~swap))
        gaps = few[:, :, None, :] - many[:, None, :, :]
        distance = np.sqrt((gaps**2).sum(axis=3))
        matched = np.take_along_axis(
            distance, cheapest_assignments(distance)[:, :, None], axis=2
        )[:, :, 0]
        out[own] = (np.minimum(matched / scale, 1.0).sum(axis=1) + columns - rows) / columns
    return out


def _taken(points: np.ndarray, at: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Points at these places; rows that are not ``here`` give any point."""
    return points[np.where(here, at, 0)]


def matching_gains(blocks: pa.Array) -> np.ndarray:
    """Per row: what the best matching of each of its cost matrices saves, summed up.

    A row is a list of matrices, a matrix a list of equally long rows; a matched pair of cost c
    saves ``1 - c``.
    """
    matrices, upto = _flat(pc.fill_null(blocks, pa.scalar([], blocks.type)))
    lines, first = _flat(matrices)
    costs, starts = _flat(lines)
    height = np.diff(first)
    begin = starts[first[:-1]]
    width = np.where(height > 0, (starts[first[1:]] - begin) // np.maximum(height, 1), 0)
    costs = costs.to_numpy(zero_copy_only=False)
    gains = np.zeros(len(height))
    some = np.flatnonzero((height > 0) & (width > 0))
    for m, n, own in _stacks(height[some], width[some]):
        own = some[own]
        stack = costs[begin[own][:, None] + np.arange(m * n)].reshape(-1, m, n)
        if m > n:
            stack = stack.transpose(0, 2, 1)
        matched = np.take_along_axis(stack, cheapest_assignments(stack)[:, :, None], axis=2)
        gains[own] = (1.0 - matched[:, :, 0]).sum(axis=1)
    total = np.concatenate(([0.0], np.cumsum(gains)))
    return total[upto[1:]] - total[upto[:-1]]


def unordered_coordinate_error(
    reference: Column, candidate: Column, scale: float = C.CANVAS_DIAGONAL
) -> Column:
    """Coordinate error of two point arrays whose order carries no meaning."""
    if scale <= 0:
        raise ValueError(f"Distances are measured in units of scale, which cannot be {scale}.")

    @F.arrow_udf("double")
    def score(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(matched_point_errors(left, right, scale), pa.float64())

    return score(reference, candidate)


def unordered_markup_error(
    reference: Column, candidate: Column, scale: float = C.CANVAS_DIAGONAL
) -> Column:
    """``struct<reference, candidate, error>``: points of two markups and their coordinate error
    without an order. Texts, not arrays of points, go to the batch."""
    if scale <= 0:
        raise ValueError(f"Distances are measured in units of scale, which cannot be {scale}.")

    @F.arrow_udf("struct<reference: bigint, candidate: bigint, error: double>")
    def score(left: pa.Array, right: pa.Array) -> pa.Array:
        return matched_text_errors(left, right, scale)

    return score(reference, candidate)


def primitive_cost(reference: Column, candidate: Column, scale: float) -> Column:
    """Cost of two point lists of primitives of one kind; points beyond the shorter list cost 1."""

    def near(p: Column, q: Column) -> Column:
        gap = F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))
        return F.coalesce(F.least(gap / scale, F.lit(1.0)), F.lit(1.0))

    longer = F.greatest(F.size(reference), F.size(candidate))
    total = F.aggregate(
        F.zip_with(reference, candidate, near), F.lit(0.0), lambda acc, cost: acc + cost
    )
    return F.when(longer == 0, 0.0).otherwise(total / longer)


def cost_blocks(reference: Column, candidate: Column, scale: float) -> Column:
    """Cost matrices of the kinds both primitive arrays have: ``array<array<array<double>>>``.

    A match across kinds costs as much as none, so the best matching splits by kind.
    """
    kinds = F.array_intersect(
        F.transform(reference, lambda p: p["kind"]), F.transform(candidate, lambda p: p["kind"])
    )

    def of_kind(primitives: Column, kind: Column) -> Column:
        return F.filter(primitives, lambda p: p["kind"].eqNullSafe(kind))

    return F.transform(
        kinds,
        lambda kind: F.transform(
            of_kind(reference, kind),
            lambda p: F.transform(
                of_kind(candidate, kind), lambda q: primitive_cost(p["coords"], q["coords"], scale)
            ),
        ),
    )


def is_small_block(block: Column) -> Column:
    """Is one side of the matrix 1, or both 2?"""
    rows, columns = F.size(block), F.size(block[0])
    return (rows == 1) | (columns == 1) | ((rows == 2) & (columns == 2))


def small_block_gain(block: Column) -> Column:
    """What the best matching of such a matrix saves."""
    one = 1.0 - F.array_min(F.flatten(block))
    two = 2.0 - F.least(
        block[0][0] + F.get(block[1], F.lit(1)), block[0][1] + F.get(block[1], F.lit(0))
    )
    return F.when((F.size(block) == 1) | (F.size(block[0]) == 1), one).otherwise(two)


def large_block_gains(blocks: Column) -> Column:
    """What the best matchings of all matrices of a row save, solved in stacks of one size."""

    @F.arrow_udf("double")
    def gains(rows: pa.Array) -> pa.Array:
        return pa.array(matching_gains(rows), pa.float64())

    return gains(blocks)
