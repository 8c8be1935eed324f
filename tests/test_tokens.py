import random

import pytest
from pyspark.sql import functions as F

from figmill import constants as C
from figmill.functions import templates as G
from figmill.functions import tokens as K
from figmill.functions.hashing import draws, uniform
from figmill.operators import encoding as N
from figmill.operators import grammar
from figmill.operators.quality import vocabulary_invariants
from figmill.plans.corpus import seed_vocabulary


@pytest.mark.parametrize(
    "value, expected",
    [(1.234, 1.2), (-4.567, -4.6), (0.04, 0.0), (0.06, 0.1), (10.5, 5.0), (-10.5, -5.0), (-0.01, 0.0), (0.25, 0.2)],
)
def test_quantized(one, value, expected):
    got = one(K.quantized(F.col("v")), v=value)
    assert got == pytest.approx(expected, abs=1e-12) and str(got) != "-0.0"


def test_quantize_guards():
    with pytest.raises(ValueError):
        K.quantized(F.lit(1.0), step=0.0)
    with pytest.raises(ValueError):
        K.quantized(F.lit(1.0), low=1.0, high=1.0)


def test_tokens(one):
    got = one(K.tokens("t"), t="(1.234, -4.567) -- (0.01, 2.99)")
    assert got == ["(", "1.2", ",", "-4.6", ")", "--", "(", "0", ",", "3", ")"]
    assert one(K.tokens("t"), t="270.00 12") == ["5", "12"]
    assert one(K.tokens("t"), t="->> <->") == ["->", ">", "<-", ">"]
    assert one(K.tokens("t", quantize=False), t="1.25\u00a0\\draw[very thick]") == [
        "1.25", "\\draw", "[", "very", "thick", "]"
    ]


def test_grid(spark):
    for step, count in ((C.COORDINATE_STEP, 101), (C.FINE_COORDINATE_STEP, 201)):
        bins = [r["token"] for r in N.coordinate_bins(spark.range(1), step).orderBy("bin").collect()]
        assert len(bins) == count and bins[0] == "-5" and bins[-1] == "5" and "0" in bins


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, ["\\draw", "(", "1", ")"]), (2, ["\\fill", ";"]), (3, [])]
    frame = spark.createDataFrame(rows, "sample_id int, tokens array<string>")
    return frame, N.build_vocabulary(frame.filter("sample_id = 1"))


def test_vocabulary(small):
    _, vocabulary = small
    found = {r["token"]: r["idx"] for r in vocabulary.collect()}
    assert [found[t] for t in C.RESERVED_TOKENS] == [0, 1, 2, 3]
    rest = sorted(t for t in found if t not in C.RESERVED_TOKENS)
    assert [found[t] for t in rest] == list(range(4, len(found)))
    assert set(C.FAMILY_TOKENS) <= set(found) and "\\fill" not in found
    assert vocabulary_invariants(vocabulary).first()["valid"]


def test_encode_decode(small):
    frame, vocabulary = small
    encoded = N.encode(frame, vocabulary, ["sample_id"], max_length=6)
    ids = {r["sample_id"]: r["ids"] for r in encoded.collect()}
    assert ids[1][0] == 1 and ids[1][-1] == 2 and len(ids[1]) == 6
    assert ids[2] == [1, 3, 3, 2, 0, 0] and ids[3] == [1, 2, 0, 0, 0, 0]
    texts = {r["sample_id"]: r["markup"] for r in N.decode(encoded, vocabulary, ["sample_id"]).collect()}
    assert texts == {1: "\\draw ( 1 )", 2: "<UNK> <UNK>", 3: ""}
    cut = {r["sample_id"]: r["ids"] for r in N.encode(frame, vocabulary, ["sample_id"], max_length=4).collect()}
    assert len(cut[1]) == 4 and 2 not in cut[1]
    markup = {r["sample_id"]: r["markup"] for r in N.predicted_markup(encoded, vocabulary, ["sample_id"]).collect()}
    assert markup[1] == "\\begin{tikzpicture} \\draw ( 1 ) \\end{tikzpicture}"
    assert markup[3] == "\\begin{tikzpicture} \\end{tikzpicture}"
    again = {r["sample_id"]: r["tokens"] for r in N.reference_tokens(encoded, vocabulary, ["sample_id"]).collect()}
    assert again[2] == ["<", "UNK", ">"] * 2


def test_reconstruct_moves_tags(one):
    tokens = F.array(*[F.lit(t) for t in ("<FAM:polygon>", "x", "\\begin{axis}", "y")])
    assert one(K.reconstructed(tokens), a=1) == "\\begin{axis} x y \\end{axis}"


def test_sequences(one):
    ids = F.array(*[F.lit(i) for i in (1, 5, 7, 2, 0, 0)])
    assert one(K.decoder_input(ids), a=1) == [1, 5, 7, 2, 0]
    assert one(K.decoder_target(ids), a=1) == [5, 7, 2, 0, 0]
    assert one(K.word_dropout(ids, 1, 1, 0.0), a=1) == [1, 5, 7, 2, 0, 0]
    assert one(K.word_dropout(ids, 1, 1, 1.0), a=1) == [1, 3, 3, 3, 3, 3]
    audit = {n: one(c, a=1) for n, c in K.sequence_audit(ids).items()}
    assert audit == {"total_length": 6, "has_bos": True, "has_eos": True, "eos_position": 3,
                     "length_to_eos": 4, "unk_count": 0, "pad_count": 2}


@pytest.mark.parametrize("token, name", [("1.5", "numeric"), ("nan", "numeric"), ("--", "geometric"), (";", "boilerplate"), ("foo", "other")])
def test_token_class(one, token, name):
    assert one(K.token_class(F.col("t")), t=token) == name


def test_ordinal_targets_match_a_full_matrix(spark):
    import math

    values = ["-5", "0", "0.1", "0.3", "4.9", "7", "30"]
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(values + ["x"])], "token string, idx int")
    got = {(r["target"], r["token"]): r["weight"] for r in N.ordinal_targets(frame).collect()}
    for a in values:
        mass = {b: math.exp(-0.5 * ((float(a) - float(b)) / 0.2) ** 2) for b in values}
        for b in values:
            assert got.get((a, b), 0.0) == pytest.approx(mass[b] / sum(mass.values()), abs=1e-12)


def check(spark, text):
    frame = spark.createDataFrame([(1, text.split())], "sample_id int, tokens array<string>")
    rows = grammar.admissibility(frame, ["sample_id"]).orderBy("pos").collect()
    return [(r["pos"], r["rule"]) for r in rows]


@pytest.mark.parametrize(
    "text, broken",
    [
        ("\\begin{tikzpicture} \\draw ( 1 ) ; \\end{tikzpicture} <EOS>", []),
        ("<FAM:polygon> \\begin{axis} \\draw ; \\end{axis} <EOS>", []),
        ("\\draw ;", [(0, "opener_first")]),
        ("<FAM:polygon> x", [(1, "opener_after_family")]),
        ("\\begin{tikzpicture} \\draw ( ; ) ; ;", [(3, "semicolon_inside_delimiters"), (6, "empty_statement")]),
        ("\\begin{tikzpicture} ) \\draw ( ( [ ) <EOS>", [(1, "close_at_depth_zero"), (4, "opened_inside_paren"),
                                                        (5, "opened_inside_paren"), (7, "eos_before_end")]),
        ("\\begin{tikzpicture} [ [ <PAD> <UNK>", [(2, "opened_inside_bracket"), (3, "reserved_token"), (4, "reserved_token")]),
        ("\\begin{tikzpicture} \\draw \\end{tikzpicture} x <EOS>", [(2, "end_not_allowed"), (3, "only_eos_after_end")]),
        ("\\begin{tikzpicture} \\x ; \\begin{axis} \\end{tikzpicture}", [(3, "repeated_opener")]),
    ],
)
def test_grammar_rules(spark, text, broken):
    assert check(spark, text) == broken


def test_join_and_travelling_vocabulary_agree(spark):
    """One token in half of all places, null and empty rows; with and without broadcasts."""
    rng = random.Random(8)
    words = [f"w{n}" for n in range(40)]
    rows = [(n, [rng.choice(words) if rng.random() < 0.5 else "hot" for _ in range(rng.randrange(60))]) for n in range(300)]
    rows += [(900, []), (901, None), (902, ["never", "hot", "seen"])]
    frame = spark.createDataFrame(rows, "sample_id int, tokens array<string>")
    vocabulary = N.build_vocabulary(frame.filter("sample_id < 200"), include_grid=False)

    def everything():
        encoded = N.encode(frame, vocabulary, ["sample_id"], max_length=50)
        odd = encoded.withColumn("ids", F.concat("ids", F.array(F.lit(999_999))))
        out = []
        for table in (encoded, N.decode(odd, vocabulary, ["sample_id"]), N.decoded_tokens(odd, vocabulary, ["sample_id"])):
            out.append(sorted(map(tuple, table.collect())))
        return out, encoded

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    travelling, plan = everything()
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert N.travelling(vocabulary) is None
        joined, _ = everything()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert joined == travelling


def test_batched_draws_are_the_native_ones(spark):
    """The draws of a row are hashed together; keys that are null, long or not ASCII included."""
    rows = [(1, "7"), (2, None), (3, "é" * 30), (4, "k" * 49), (5, "k" * 80), (6, "")]
    df = spark.createDataFrame(rows, "n int, key string")
    slots = F.sequence(F.lit(0), F.lit(1100))
    batched = df.select("n", F.posexplode(draws(42, F.col("key"), 1101)).alias("slot", "u"))
    single = df.select("key", "n", F.explode(slots).alias("slot"))
    native = single.select("n", "slot", uniform(42, F.col("key"), F.col("slot")).alias("u"))
    assert batched.exceptAll(native).count() == 0 and batched.count() == 6 * 1101
    none = df.select(draws(42, F.col("key"), F.lit(None).cast("int")).alias("u"))
    assert none.filter("u IS NOT NULL").count() == 0
    assert "ArrowEvalPython" in batched._jdf.queryExecution().toString()


def test_dropout_uses_the_draw_of_each_place(spark):
    ids = [1, 5, None, 7, 1, 2, *range(10, 130), 0]
    rows = spark.createDataFrame(
        [(3, ids), (None, ids), (4, []), (5, None)], "key long, ids array<int>"
    )
    dropped = rows.select("key", K.word_dropout(F.col("ids"), 9, F.col("key"), 0.4).alias("d"))
    native = rows.select("key", F.transform("ids", lambda t, i: F.when(
        (t != 1) & (uniform(9, F.col("key"), i) < 0.4), F.lit(3)).otherwise(t)).alias("d"))
    assert dropped.exceptAll(native).count() == 0 and dropped.count() == 4
    assert "ArrowEvalPython" in dropped._jdf.queryExecution().toString()


def test_tokens_are_found_and_quantized_a_batch_at_a_time(spark):
    """No function runs per token inside the engine; blanks and digits are those of the pattern."""
    odd = "1.25 -0.04 ٣ x\x1cy\x85z ​ 0.00004 " + "9" * 400 + ".5 \U0001f600 12."
    rows = spark.createDataFrame([(odd,), ("",), (None,)], "t string").coalesce(1)
    found = rows.select(K.tokens("t").alias("tokens"))
    assert [r["tokens"] for r in found.collect()] == [
        ["1.2", "0", "٣", "x", "y", "z", "​", "0", "5", "\U0001f600", "12", "."], [], None,
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan


def test_a_token_that_is_null_may_have_been_anything(spark):
    rows = [(["\\draw", None, "\\draw"],), ([None, ";", ";", ")"],), (None,), ([],)]
    broken = spark.createDataFrame(rows, "t array<string>").coalesce(1).select(
        grammar.broken_rules(F.col("t")).alias("b")
    )
    assert [r["b"] and [tuple(b) for b in r["b"]] for r in broken.collect()] == [
        [(0, "\\draw", "opener_first")],
        [(2, ";", "empty_statement"), (3, ")", "close_at_depth_zero")], None, [],
    ]
    assert "lambdafunction" not in broken._jdf.queryExecution().optimizedPlan().toString()


def test_sentinels_are_counted_and_dropped_without_a_function_per_id(spark):
    ids = spark.createDataFrame([([1, 3, 7, 2, 0, 0],), ([0, 0],), ([],)], "ids array<int>").coalesce(1)
    found = ids.select(
        K.sequence_audit(F.col("ids"))["pad_count"].alias("pads"),
        K.sequence_audit(F.col("ids"))["unk_count"].alias("unks"),
        K.without(F.col("ids"), (0, 1, 2)).alias("kept"),
    )
    assert [tuple(r) for r in found.collect()] == [(2, 1, [3, 7]), (2, 0, []), (0, 0, [])]
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_seed_vocabulary_holds_the_tokens_of_every_family_and_key(spark):
    """Pictures are generated and read in one job; null and repeated keys are keys like others."""
    keys = spark.createDataFrame([(k,) for k in (1, 2, 2, None, 10**12)], "sample_id long")
    found = {r["token"]: r["idx"] for r in seed_vocabulary(keys, 9).collect()}
    expected = {r["token"] for r in N.coordinate_bins(keys, C.FINE_COORDINATE_STEP).collect()}
    for name in C.FAMILIES:
        texts = [r[0] for r in keys.select(G.family_markup(name, 9, F.col("sample_id"))).collect()]
        tagged = spark.createDataFrame([(f"<FAM:{name}> {text}",) for text in texts], "t string")
        for row in tagged.select(K.tokens("t", step=C.FINE_COORDINATE_STEP)).collect():
            expected |= set(row[0])
    assert {"\\node", "grid", "cycle", "<FAM:composed>"} <= expected and len(texts) == 5
    ordered = sorted(expected - set(C.RESERVED_TOKENS))
    assert found == {t: i for i, t in enumerate([*C.RESERVED_TOKENS, *ordered])}
