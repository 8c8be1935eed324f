import pytest
from pyspark.sql import functions as F

from figmill import constants as C
from figmill.functions.hashing import hash32
from figmill.operators import curate as E
from figmill.operators.positions import dense_position, ordered_head, text_position, within_cuts
from figmill.sources import sink


@pytest.fixture(scope="module")
def numbers(spark):
    """Sparse, clustered and negative ids; one group holds most of them."""
    ids = [*range(0, 3000), *range(10**12, 10**12 + 500), -7, -(10**15), 2**62, 65535 * 9]
    rows = sorted({i: ("big" if i % 5 else "small") for i in ids}.items())
    return spark.createDataFrame(rows, "id bigint, g string").repartition(7)


def test_dense_position(numbers):
    rows = dense_position(numbers, F.col("id"), groups=["g"]).collect()
    for group in ("big", "small"):
        mine = sorted((r["id"], r["position"]) for r in rows if r["g"] == group)
        assert [p for _, p in mine] == list(range(len(mine)))


def test_cuts_equal_ranks(numbers):
    order = hash32(5, F.col("id"), "x")
    quotas = {"a": lambda n: F.floor(n * 0.1), "b": lambda n: F.lit(17), "c": lambda n: F.lit(0)}
    marked = within_cuts(numbers, quotas, order, F.col("id"), ["g"]).withColumn("h", order).collect()
    for group in ("big", "small"):
        ranked = sorted((r["h"], r["id"], r["a"], r["b"], r["c"]) for r in marked if r["g"] == group)
        tenth = len(ranked) // 10
        assert [r[2] for r in ranked] == [i < tenth for i in range(len(ranked))]
        assert [r[3] for r in ranked] == [i < 17 for i in range(len(ranked))]
        assert not any(r[4] for r in ranked)


def test_head_and_text_order(spark, numbers):
    head = sorted(r["id"] for r in ordered_head(numbers, 40, "id").collect())
    assert head == sorted(r["id"] for r in numbers.collect())[:40]
    assert ordered_head(numbers, 10**9, "id").count() == numbers.count()
    words = ["b", "a", "ab", "abc", "abcd", "\u00e9t\u00e9", "Z", "~", "abca", "", "\U0001f600", "\uffee"]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r["w"] for r in text_position(frame, "w").orderBy("position").collect()]
    assert got == sorted(words)


def test_dedup_keeps_first(spark):
    rows = list(enumerate("abacb"))
    frame = spark.createDataFrame(rows, "pos bigint, t string").repartition(3)
    kept = E.first_occurrences(frame, "t", "pos").orderBy("pos").collect()
    assert [r["t"] for r in kept] == ["a", "b", "c"]


def test_random_split(spark):
    frame = spark.range(1000)
    split = {r["split"]: r["count"] for r in E.random_split(frame, 0.1, 1, "id").groupBy("split").count().collect()}
    assert split == {"train": 900, "val": 100}
    one = E.random_split(spark.range(2), 0.01, 1, "id").groupBy("split").count().collect()
    assert sorted((r["split"], r["count"]) for r in one) == [("train", 1), ("val", 1)]
    for ratio in (0.0, 1.0):
        with pytest.raises(ValueError):
            E.random_split(frame, ratio, 1, "id")


def test_split_ignores_partitioning(spark):
    frame = spark.range(500).withColumn("s", F.col("id") % 3)
    splits = [
        sorted((r["id"], r["split"]) for r in E.stratified_split(frame.repartition(n), 0.2, 9, "id", "s").collect())
        for n in (1, 7)
    ]
    assert splits[0] == splits[1]


def test_stratified_split(spark):
    frame = spark.range(801).withColumn("s", F.when(F.col("id") == 800, 8).otherwise(F.col("id") % 8))
    counts = E.stratified_split(frame, 0.1, 3, "id", "s").groupBy("s").agg(F.count_if(F.col("split") == "val").alias("v"))
    assert {r["s"]: r["v"] for r in counts.collect()} == {**dict.fromkeys(range(8), 10), 8: 0}


def test_script_splits(spark):
    assert E.tenth_split(spark.range(15), 1, "id").filter("split = 'train'").count() == 13
    assert E.stage_split(spark.range(50), 1, "id").filter("split = 'val'").count() == 10
    assert E.stage_split(spark.range(500), 1, "id").filter("split = 'val'").count() == 100
    bands = E.banded_split(spark.range(150).withColumn("f", F.lit("x")), 100, 1, "id", "f")
    counts = {r["split"]: r["count"] for r in bands.groupBy("split").count().collect()}
    assert counts == {"train": 90, "val": 5, "test": 5, None: 50}


def test_quota_and_retry(spark):
    rows = spark.range(100).withColumns({"family": F.lit("f"), "is_valid": F.col("id") % 4 == 0})
    assert sorted(r["id"] for r in E.quota_fill(rows, 10, "family", "id").collect()) == [0, 4, 8, 12, 16, 20, 24, 28]
    seeds = spark.createDataFrame([(1, 5), (2, 5)], "sample_id bigint, seed bigint")
    tries = E.retry_seeds(seeds).withColumn("is_valid", (F.col("sample_id") == 1) & (F.col("attempt") >= 2))
    found = {r["sample_id"]: (r["attempt"], r["final_seed"], r["failed"]) for r in E.first_valid_attempt(tries).collect()}
    assert found == {1: (2, 5 + 2 * 1000003, False), 2: (None, None, True)}


def test_curriculum_draws(spark):
    pool = spark.range(60).select(
        F.col("id").alias("sample_id"),
        F.when(F.col("id") < 3, "polygon").otherwise("node_arrow").alias("family"),
    )
    weights = [0.5 if f in ("polygon", "node_arrow") else 0.0 for f in C.FAMILIES]
    draws = spark.range(200).withColumnRenamed("id", "draw_id")
    rows = E.curriculum_draws(pool, draws, weights, 3).collect()
    assert len(rows) == 200
    passes = {}
    for r in rows:
        passes.setdefault((r["family"], r["pass"]), []).append(r["sample_id"])
    for members in passes.values():
        assert len(members) == len(set(members))
    assert all(len(passes[("polygon", p)]) == 3 for f, p in passes if f == "polygon" and ("polygon", p + 1) in passes)


def test_permuted_places_are_bijections(spark):
    """Every size gives a permutation, passes give different ones."""
    sizes = [1, 2, 3, 5, 8, 97, 500]
    rows = spark.createDataFrame([(n, p) for n in sizes for p in range(3)], "size bigint, pass bigint")
    own = F.concat_ws("/", F.lit("f"), F.col("pass").cast("string"))
    keyed = rows.withColumn("keys", E.swap_keys(9, own, F.col("size"))).withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1)))
    moved = keyed.select("size", "pass", "at", E.permuted_place(F.col("at"), F.col("size"), F.col("keys"), 9, own).alias("to"))
    found = {}
    for r in moved.collect():
        found.setdefault((r["size"], r["pass"]), {})[r["at"]] = r["to"]
    assert all(sorted(m.values()) == list(range(n)) == sorted(m) for (n, _), m in found.items())
    assert found[500, 0] != found[500, 1] != found[500, 2]
    fixed = sum(a == b for a, b in found[500, 0].items())
    near = sum(abs(found[500, 0][a] - found[500, 0][a + 1]) < 25 for a in range(499))
    assert fixed < 10 and 20 < near < 90  # as many as chance gives


def test_draws_permute_every_pass_of_a_pool(spark):
    """Whole passes hold every sample once, in an order that is not the pool's."""
    pool = spark.range(50).select((F.col("id") * 7).alias("sample_id"), F.lit("polygon").alias("family"))
    weights = [1.0 if f == "polygon" else 0.0 for f in C.FAMILIES]
    rows = E.curriculum_draws(pool, spark.range(120).withColumnRenamed("id", "draw_id"), weights, 3).orderBy("draw_id").collect()
    drawn = [r["sample_id"] for r in rows]
    for first in (0, 50):
        assert sorted(drawn[first : first + 50]) == list(range(0, 350, 7)) != drawn[first : first + 50]
    assert drawn[:50] != drawn[50:100] and len(set(drawn[100:])) == 20


def test_independence(spark):
    test = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    train = spark.createDataFrame([(3, "b"), (4, "b")], "id int, t string")
    assert [r["id"] for r in E.leaked_rows(test, train, "t").collect()] == [2]
    assert [r["id"] for r in E.independent_rows(test, train, "t").collect()] == [1]


def test_batches_and_copies(spark):
    frame = spark.range(10).withColumnRenamed("id", "p")
    bounds = E.batch_bounds(frame, "p", 3).orderBy("batch").collect()
    assert [(r["start"], r["end"]) for r in bounds] == [(0, 3), (3, 6), (6, 9), (9, 10)]
    assert E.replicated(frame, 3).count() == 30
    with pytest.raises(ValueError):
        E.replicated(frame, 0)


def test_shard_lookup(spark):
    manifest = spark.createDataFrame([("s", 0, 10), ("s", 1, 10), ("s", 2, 10)], "split string, shard_id bigint, num_samples bigint")
    asked = spark.createDataFrame([(i,) for i in (0, 15, 25, 30, -1)], "index bigint")
    found = {r["index"]: (r["shard_id"], r["offset"], r["out_of_range"]) for r in sink.shard_lookup(manifest, asked).collect()}
    assert found == {0: (0, 0, False), 15: (1, 5, False), 25: (2, 5, False), 30: (None, None, True), -1: (None, None, True)}


def test_uneven_shard_lookup(spark):
    sizes = [1, 40, 2, 7, 7]
    manifest = spark.createDataFrame([("s", i, n) for i, n in enumerate(sizes)], "split string, shard_id bigint, num_samples bigint")
    found = sink.shard_lookup(manifest, spark.range(57).withColumnRenamed("id", "index")).orderBy("index").collect()
    expected = [(s, o) for s, n in enumerate(sizes) for o in range(n)]
    assert [(r["shard_id"], r["offset"]) for r in found] == expected


def test_sparse_keys_and_common_stems_meet_in_no_single_task(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("k"))
    found = dense_position(keys, F.col("k")).orderBy("k").collect()
    assert [r["position"] for r in found] == list(range(20_000))
    head = ordered_head(keys, 50, "k").orderBy("k").collect()
    assert [r["k"] for r in head] == [r["k"] for r in found[:50]]
    stems = spark.range(100_000).select(F.concat(F.lit("node_"), F.col("id").cast("string")).alias("w"))
    ranked = text_position(stems.repartition(4), "w")
    checked = ranked.select("position", "w").toPandas().sort_values("position")
    assert checked["position"].tolist() == list(range(100_000))
    assert checked["w"].tolist() == sorted(checked["w"])


def test_draws_without_pool_and_families_without_rows_stay(spark):
    pool = spark.createDataFrame([(n, C.FAMILIES[0]) for n in range(5)], "sample_id bigint, family string")
    draws = spark.range(100).withColumnRenamed("id", "draw_id")
    found = E.curriculum_draws(pool, draws, C.STAGES[0][3], 42).collect()
    assert len(found) == 100
    assert all((r["sample_id"] is None) == (r["reason"] == "empty_pool") for r in found)
    assert all((r["family"] == C.FAMILIES[0]) == (r["reason"] is None) for r in found)
    short = E.quota_shortfall(pool, 7, "family", C.FAMILIES[:3]).collect()
    assert {r["family"]: r["shortfall"] for r in short} == dict(zip(C.FAMILIES[:3], (2, 7, 7)))
