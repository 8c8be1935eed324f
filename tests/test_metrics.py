import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from figmill import constants as C
from figmill.functions import hashing as H
from figmill.functions import scores as S
from figmill.functions import text as X
from figmill.functions import tokens as K
from figmill.operators import matching as A
from figmill.operators import metrics as M

SCALE = C.CANVAS_DIAGONAL


def points(rng, count, reach):
    return np.array([[rng.uniform(-reach, reach) for _ in "xy"] for _ in range(count)]).reshape(-1, 2)


def bleu(spark, pairs, order=4):
    rows = [(i, r.split(), c.split()) for i, (r, c) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "sample_id int, reference_tokens array<string>, candidate_tokens array<string>")
    return M.corpus_bleu(frame.withColumn("g", F.lit(1)), ["g"], order).first()["corpus_bleu"]


def test_bleu(spark):
    assert bleu(spark, [("a b c d e", "a b c d e")]) == pytest.approx(1.0)
    assert bleu(spark, [("a b c d e", "v w x y z")]) == 0.0
    for order in (1, 2):
        assert bleu(spark, [("a b c d e", "a b c d")], order) == pytest.approx(math.exp(-0.25))
    assert bleu(spark, [("a b", "")], 1) == 0.0
    with pytest.raises(ValueError):
        bleu(spark, [("a", "a")], 0)


def test_ngram_counts_match_counters():
    from collections import Counter

    rng = random.Random(3)
    texts = [[rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(200)]
    left, right = texts[:100], texts[100:]
    kind = pa.list_(pa.string())
    got = A.match_batch(pa.array(left, kind), pa.array(right, kind), 3).to_pylist()
    for r, c, row in zip(left, right, got):
        expected = [len(r), len(c)]
        for n in (1, 2, 3):
            a = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
            b = Counter(tuple(c[i : i + n]) for i in range(len(c) - n + 1))
            expected += [sum(min(b[g], a[g]) for g in b), sum(b.values())]
        assert row == expected


def distance(spark, left, right):
    frame = spark.createDataFrame([(left, right)], "r array<string>, c array<string>")
    return M.edit_distances(frame, "r", "c").first()["token_distance"]


def test_edit_distance(spark):
    assert distance(spark, ["\\draw", "--", "\\fill", ";"], ["\\draw", "->", ";"]) == 0.5
    assert distance(spark, ["(0,0)"], ["\\fill"]) == 1.0
    assert distance(spark, ["(0,0)"], ["(0.1, 0.0)"]) == pytest.approx(0.1 / SCALE)
    assert distance(spark, [], ["a"]) == distance(spark, ["a"], []) == 1.0
    assert distance(spark, [], []) == 0.0
    far = distance(spark, "( 0 , 0 )".split(), "( 3 , 4 )".split())
    assert far == pytest.approx((5 / SCALE) * 3 / 5)


def token_points(tokens):
    import re

    out, i = [None] * len(tokens), 0
    while i < len(tokens):
        single = re.fullmatch(C.POINT_PATTERN, tokens[i])
        span = tokens[i : i + 5]
        if single:
            out[i] = (float(single[1]), float(single[2]))
            i += 1
        elif (len(span) == 5 and (span[0], span[2], span[4]) == ("(", ",", ")")
              and all(re.fullmatch(C.NUMBER_PATTERN, span[k]) for k in (1, 3))):
            out[i] = out[i + 1] = out[i + 3] = (float(span[1]), float(span[3]))
            i += 5
        else:
            i += 1
    return out


def brute_distance(a, b):
    p, q = token_points(a), token_points(b)
    grid = [[float(i + j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if p[i - 1] and q[j - 1]:
                cost = min(math.dist(p[i - 1], q[j - 1]) / SCALE, 1.0)
            else:
                cost = float(a[i - 1] != b[j - 1])
            grid[i][j] = min(grid[i - 1][j] + 1, grid[i][j - 1] + 1, grid[i - 1][j - 1] + cost)
    return grid[-1][-1] / max(len(a), len(b), 1)


def test_alignment_matches_brute_force():
    rng = random.Random(1)
    words = ["(", ")", ",", "1", "2.5", "-3", "--", ";", "\\draw", "(1, 2)", "(0.5,-2)"]

    def sequence():
        out = []
        for _ in range(rng.randint(0, 8)):
            out += ["(", rng.choice(["1", "-3"]), ",", rng.choice(["1", "7.5"]), ")"] if rng.random() < 0.3 else [rng.choice(words)]
        return out

    left, right = [sequence() for _ in range(300)], [sequence() for _ in range(300)]
    kind = pa.list_(pa.string())
    got = A.align_batch(pa.array(left, kind), pa.array(right, kind), SCALE).to_pylist()
    for g, a, b in zip(got, left, right):
        assert g == pytest.approx(brute_distance(a, b), abs=1e-12)


def test_equal_pairs_are_aligned_once(monkeypatch):
    """Half of the batch are copies: half of the cells are computed, all rows get their distance."""
    rng = random.Random(4)
    words = ["(1,2)", "(3,4)", "a", "b", "draw"]
    pairs = [([rng.choice(words) for _ in range(rng.randrange(30))], [rng.choice(words) for _ in range(rng.randrange(30))]) for _ in range(200)]
    kind, cells = pa.list_(pa.string()), []
    whole = A._align_block
    monkeypatch.setattr(A, "_align_block", lambda r, c, lengths, scale: cells.append(int((lengths[0] * lengths[1]).sum())) or whole(r, c, lengths, scale))

    def aligned(rows):
        cells.clear()
        out = A.align_batch(*(pa.array([p[k] for p in rows], kind) for k in (0, 1)), SCALE).to_pylist()
        return out, sum(cells)

    once, cost = aligned(pairs)
    twice, same = aligned(pairs + pairs[::-1])
    assert same == cost and twice == once + once[::-1]
    assert len({tuple(m) for m in A._row_marks(np.array([1, 2, 2, 1, 1]), np.array([0, 2, 4, 5, 5]))}) == 4


@pytest.mark.parametrize("decimals", [1, 6])
def test_assignment_matches_brute_force(decimals):
    """Stacks of one size, with and without ties, by trial and by augmenting paths."""
    rng = np.random.default_rng(decimals)
    for n in range(1, 7):
        for m in range(1, n + 1):
            cost = np.round(rng.random((40, m, n)), decimals)
            for solve in (A.cheapest_assignments, A._augmented):
                columns = solve(cost)
                for own, picked in zip(cost, columns):
                    best = min(sum(own[i, p[i]] for i in range(m)) for p in itertools.permutations(range(n), m))
                    assert own[np.arange(m), picked].sum() == pytest.approx(best)
                    assert len(set(picked.tolist())) == m


def test_assignment_of_large_and_negative_matrices():
    rng = np.random.default_rng(3)
    hidden = rng.permutation(60)[:50]
    cost = rng.random((5, 50, 60)) + 1.0
    cost[:, np.arange(50), hidden] = -1.0
    assert (A.cheapest_assignments(cost) == hidden).all()
    assert A.cheapest_assignments(np.zeros((0, 3, 5))).shape == (0, 3)
    with pytest.raises(ValueError):
        A.cheapest_assignments(np.zeros((1, 3, 2)))


def graph(spark, pairs):
    frame = spark.createDataFrame(list(enumerate(pairs)), "n int, p struct<reference: string, candidate: string>")
    scored = M.graph_distances(frame.select("n", "p.*"))
    return [r["graph_distance"] for r in scored.orderBy("n").collect()]


def test_graph_distance(spark):
    a = "\\draw (0,0) -- (1,1); \\fill (2,2) circle (1); \\node at (3,3) {A};"
    b = "\\node at (3,3) {A}; \\draw (0,0) -- (1,1); \\fill (2,2) circle (1);"
    four = "".join(f"\\draw ({x},0) -- ({x},1);" for x in range(4))
    back = "".join(f"\\draw ({x},0) -- ({x},1);" for x in (3, 1, 0))
    got = graph(
        spark,
        [
            (a, b), ("", ""), (a, ""), ("", a), ("\\draw (0,0);", "\\fill (0,0);"),
            ("\\draw (0,0);", "\\draw (0.1,0);"), ("\\draw (0,0);", "\\draw (4,4);"),
            (four, back), (None, a), (None, None),
        ],
    )
    assert got[0] == pytest.approx(0.0)
    assert got[1:5] == [0.0, 1.0, 1.0, 1.0]
    assert 0 < got[5] < got[6] <= 1
    assert got[7] == pytest.approx(0.25)
    assert got[8:] == [1.0, 0.0]


def brute_primitive_cost(a, b):
    if not len(a) and not len(b):
        return 0.0
    near = sum(min(math.dist(p, q) / SCALE, 1.0) for p, q in zip(a, b))
    return (near + abs(len(a) - len(b))) / max(len(a), len(b))


def test_graph_distance_matches_full_matching(spark):
    """Splitting by kind finds the same optimum as matching everything with everything."""
    rng = random.Random(5)

    def figure(most):
        return [
            (rng.choice("df"), points(rng, rng.randint(0, 2), 5).tolist())
            for _ in range(rng.randint(0, most))
        ]

    figures = [(figure(4), figure(4)) for _ in range(100)] + [(figure(7), figure(5)) for _ in range(60)]
    expected = []
    for a, b in figures:
        def cost(p, q):
            return 1.0 if p[0] != q[0] else brute_primitive_cost(p[1], q[1])

        short, long = (a, b) if len(a) <= len(b) else (b, a)
        best = min(sum(cost(s, long[p[i]]) for i, s in enumerate(short)) for p in itertools.permutations(range(len(long)), len(short)))
        expected.append((best + len(long) - len(short)) / max(1, len(long)))
    kind = "array<struct<kind: string, coords: array<struct<x: double, y: double>>>>"
    frame = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(figures)], f"n int, l {kind}, r {kind}")
    got = M.primitive_distances(frame, "l", "r", "d").orderBy("n").collect()
    assert [r["d"] for r in got] == pytest.approx(expected)


def test_only_large_blocks_reach_the_assignment(spark):
    """Of these figures only the one with a 2 x 3 block hands anything to Python."""
    draw = "\\draw ({0},0) -- ({0},1);".format
    rows = [(1, draw(1), draw(2) + draw(3)), (2, draw(1) + draw(2), draw(2) + draw(1)), (3, draw(1) + draw(2), draw(3) + draw(1) + draw(2))]
    frame = spark.createDataFrame(rows, "n int, reference string, candidate string")
    blocks = A.cost_blocks(X.primitives("reference"), X.primitives("candidate"), SCALE)
    large = frame.select("n", F.size(F.filter(blocks, lambda b: ~A.is_small_block(b))).alias("k"))
    assert {r["n"]: r["k"] for r in large.collect()} == {1: 0, 2: 0, 3: 1}


def test_coordinate_errors(spark, one):
    r, c = X.points("l"), X.points("r")
    assert one(S.ordered_coordinate_error(r, c), l="(0,0) (1,1)", r="(0.1,0) (1.1,1)") == pytest.approx(0.1 / SCALE)
    assert one(S.ordered_coordinate_error(r, c), l="", r="") == 0.0
    assert one(S.ordered_coordinate_error(r, c), l="(0,0)", r="") == 1.0
    swapped = {"l": "(0,0) (4,4)", "r": "(4,4) (0,0)"}
    assert one(S.ordered_coordinate_error(r, c), **swapped) > 0
    assert one(M.unordered_coordinate_error(r, c), **swapped) == pytest.approx(0.0)
    assert one(S.mean_point_distance(r, c), l="", r="") == pytest.approx(SCALE)
    assert one(S.mean_point_distance(r, c), l="(0,0) (1,1)", r="(3,4)") == pytest.approx(6.0)
    rows = [(1, "node_arrow", *swapped.values()), (2, "polygon", *swapped.values())]
    frame = spark.createDataFrame(rows, "sample_id int, family string, reference string, candidate string")
    errors = {x["family"]: (x["matching"], x["coordinate_error"]) for x in M.coordinate_errors(frame).collect()}
    assert errors["node_arrow"][0] == "assigned" and errors["node_arrow"][1] == pytest.approx(0.0)
    assert errors["polygon"][0] == "ordered" and errors["polygon"][1] > 0


def test_unordered_error_matches_brute_force():
    rng = random.Random(9)
    pairs, expected = [], []
    for _ in range(200):
        a, b = (points(rng, rng.randint(0, 6), 20) for _ in range(2))
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        gap = math.dist
        best = min(itertools.permutations(range(len(long)), len(short)), key=lambda p: sum(gap(s, long[p[i]]) for i, s in enumerate(short)))
        total = sum(min(gap(s, long[best[i]]) / SCALE, 1) for i, s in enumerate(short))
        pairs.append((a, b))
        expected.append((total + len(long) - len(short)) / max(1, len(long)))
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    sides = [pa.array([[{"x": x, "y": y} for x, y in p[k]] for p in pairs], kind) for k in (0, 1)]
    assert A.matched_point_errors(*sides, SCALE).tolist() == pytest.approx(expected)
    assert A.matched_point_errors(sides[0].slice(7, 20), sides[1].slice(7, 20), SCALE).tolist() == pytest.approx(expected[7:27])
    empty = pa.array([None, []], kind)
    assert A.matched_point_errors(empty, pa.array([[], [{"x": 0.0, "y": 0.0}]], kind), SCALE).tolist() == [0.0, 1.0]


def test_overlap(one):
    assert one(S.token_overlap(K.words("l"), K.words("r")), l="a b b", r="b c") == pytest.approx(1 / 3)
    assert one(S.token_overlap(K.words("l"), K.words("r")), l=" ", r="") == 1.0
    assert one(S.token_overlap(K.words("l"), K.words("r")), l="a", r="") == 0.0
    none = F.array().cast("array<string>")
    assert one(S.keyword_accuracy(none, none), l=1) == 0.0


def test_best_of_n(spark):
    rows = [(1, 0, 0.2, True), (1, 1, 0.9, False), (1, 2, 0.5, True), (1, 3, 0.5, True), (2, 0, 0.3, False), (2, 1, -0.1, True)]
    frame = spark.createDataFrame(rows, "image_id int, candidate_no int, ssim double, is_successful boolean")
    best = {r["image_id"]: (r["candidate_no"], r["best_ssim"]) for r in M.best_candidates(frame).collect()}
    assert best == {1: (2, 0.5), 2: (0, 0.0)}
    means = M.mean_ssim(frame).first()
    assert means["ssim_samples"] == 4 and means["mean_ssim_compiled"] == pytest.approx(1.1 / 4)


def test_pairs_near_the_diagonal_are_proven_or_aligned_in_full():
    """Distances of pairs that a diagonal proves equal those of the whole table."""
    draw = random.Random(7)
    words = ["(", ",", ")", "1", "0.5", "-4", "a", "--", "(1.0, 2.0)", "(0.5,2)", ";"]
    left, right = [], []
    for _ in range(400):
        a = [draw.choice(words) for _ in range(draw.choice([0, 1, 2, 5, 20, 40]))]
        b = list(a)
        for _ in range(draw.randint(0, 4)):
            if b:
                b[draw.randrange(len(b))] = draw.choice(words)
        if b and draw.random() < 0.5:
            del b[draw.randrange(len(b))]
        left.append(a)
        right.append(b if draw.random() < 0.8 else b[::-1] + ["x"])
    lists = [pa.array(side, pa.list_(pa.string())) for side in (left, right)]
    proven, whole = [], A._near_diagonal

    def counted(*block):
        cost, sure = whole(*block)
        proven.append(int(sure.sum()))
        return cost, sure

    def unsure(*block):
        cost, sure = whole(*block)
        return cost, np.zeros_like(sure)

    A._near_diagonal = counted
    try:
        quick = A.align_batch(*lists, 2.0).to_numpy()
        A._near_diagonal = unsure
        full = A.align_batch(*lists, 2.0).to_numpy()
    finally:
        A._near_diagonal = whole
    assert sum(proven) > 100
    np.testing.assert_allclose(quick, full, atol=1e-12)


def test_structure_scores_find_points_and_keywords_once(spark):
    """Each side's points are extracted once (x and y), its keywords matched once a word."""
    pairs = spark.createDataFrame([("a", "b", "polygon")], "reference string, candidate string, family string")
    plan = M.structure_scores(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 4
    assert plan.count("RLIKE") + plan.count("rlike") <= 16


def test_only_assignments_that_share_a_column_are_augmented(monkeypatch):
    """A row that is alone in wanting its column gets it; the other matrices are solved in full."""
    rng, solved = np.random.default_rng(3), []
    whole = A._augmented
    cost = rng.random((300, 6, 7))
    cost[::2, np.arange(6), rng.permutation(7)[:6]] -= 1.0
    full = np.take_along_axis(cost, whole(cost)[:, :, None], axis=2).sum(axis=(1, 2))
    monkeypatch.setattr(A, "_augmented", lambda stack: solved.append(len(stack)) or whole(stack))
    columns = A.cheapest_assignments(cost)
    assert 0 < sum(solved) <= 150
    assert (np.diff(np.sort(columns, axis=1), axis=1) > 0).all()
    np.testing.assert_allclose(np.take_along_axis(cost, columns[:, :, None], axis=2).sum(axis=(1, 2)), full)


def test_points_of_a_batch_are_those_of_a_column(spark):
    """Points found by Arrow, brackets and white space of any kind included."""
    rng = random.Random(11)
    texts = ["1, 2)", "((1,2)", "( 1 ,\x0b2\f)", "", None, "(1.,2)", "(-0,+1)", "(" + "9" * 400 + ",-1)", "(1,2\x00)", "é(1,2)(3,-4.5)é"]
    texts += ["".join(rng.choice("((),,.-12 \n\x0ba") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    rows = frame.select("n", X.points("t").alias("p")).collect()
    expected = {r["n"]: [(p["x"], p["y"]) for p in r["p"] or []] for r in rows}
    for first, count in ((0, len(texts)), (3, 50), (4, 1), (0, 0)):
        found, ends = A._points_of_texts(pa.array(texts, pa.string()).slice(first, count))
        lists = [[tuple(p) for p in found[a:b].tolist()] for a, b in zip(ends[:-1], ends[1:])]
        assert lists == [expected[n] for n in range(first, first + count)]


def test_coordinate_errors_read_the_pairs_once(spark):
    """One scan for both kinds of family; unordered rows hand their texts over, not lists of points."""
    rows = [
        (1, "node_arrow", "(0,0) (4,4)", "(4,4) (0,0)"), (2, "polygon", "(0,0) (4,4)", "(4,4)"),
        (3, "composed", None, "(1,1)"), (4, "composed", "x", ""), (5, None, "(1,1)", "(1,1)"), (6, "polygon", None, "(1,1)"),
    ]
    frame = spark.createDataFrame(rows, "sample_id int, family string, reference string, candidate string")
    scored = M.coordinate_errors(frame)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "score(CASE WHEN family" in plan
    found = {r["sample_id"]: tuple(r)[4:] for r in scored.collect()}
    assert found == {
        1: (2, 2, 2, "assigned", 0.0), 2: (1, 2, 1, "ordered", pytest.approx((4 * math.sqrt(2) / SCALE + 1) / 2)),
        3: (1, None, 1, "assigned", 1.0), 4: (0, 0, 0, "assigned", 0.0), 6: (1, None, 1, "ordered", None),
    }
    assert {r["sample_id"] for r in M.coordinate_errors(frame, ()).collect()} == set(range(1, 7))


def test_draws_send_counts_not_slots():
    """Draws under a count are those of the slots 0, 1, ..."""
    stems, counts = pa.array(["42:1:", "42:m5/7:", "s" * 60, "42:9:"]), pa.array([16, 3, 12, None], pa.int32())
    slots = pa.array([None if n is None else list(range(n)) for n in counts.to_pylist()], pa.list_(pa.int32()))
    assert H.draw_batch(stems, counts).to_pylist() == H.uniform_batch(stems, slots).to_pylist()
