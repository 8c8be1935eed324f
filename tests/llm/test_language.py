import numpy as np

from figmill.llm import language, queries
from helpers import DOCS, documents

TEXTS = {
    "en": "the cat and the dog went over the hill with their friends and the weather was good then ",
    "de": "der hund und die katze gingen über den berg mit ihren freunden und das wetter war gut ",
    "es": "el perro y el gato fueron sobre la colina con sus amigos y el tiempo estaba bueno allí ",
}


def table(spark, copies=24):
    rows = []
    for lang, text in TEXTS.items():
        own = text.split()
        for n in range(copies):
            rows.append((len(rows), " ".join(own[n % 7 :] + own[: n % 5]), lang, "s", 1))
    return spark.createDataFrame(rows, DOCS)


def brute_phrases(sample, text):
    """Greedy longest matches, by searching the sample."""
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        if text[at:end] not in sample:
            end = at + 1
        count, at = count + 1, end
    return count


def test_phrases_are_the_greedy_longest_matches():
    rng = np.random.default_rng(3)
    sample = "".join(rng.choice(list("abc"), 300))
    model = language.Languages({"x": [sample], "y": ["cab" * 30]})
    texts = ["".join(rng.choice(list("abcd"), int(n))) for n in rng.integers(1, 60, 40)]
    points, ends = language.code_points(texts)
    found = model.phrases(model.symbols(points), ends)
    for n, text in enumerate(texts):
        assert found[n, 0] == brute_phrases(sample, text), text
        assert found[n, 1] == brute_phrases("cab" * 30, text), text


def test_long_texts_are_parsed_in_pieces_of_bounded_size():
    model = language.Languages({"x": ["abcabc" * 50]})
    text = "abc" * 5000
    points, ends = language.code_points([text, "", text[:10]])
    found = model.phrases(model.symbols(points), ends)[:, 0]
    assert found[1] == 0 and found[2] == 1
    assert found[0] <= len(text) / 300 + 2 * len(text) / language.PIECE + 2


def test_code_points_fold_letters_and_join_other_characters():
    points, ends = language.code_points(["Aé 1!", "", "!!x"])
    gap = language.GAP
    assert points.tolist() == [ord("a"), ord("é"), gap, gap, ord("x")]
    assert ends.tolist() == [0, 3, 3, 5]


def test_identify_odd_rows(spark):
    docs = documents(
        spark, [None, "", "123 !!", TEXTS["de"], TEXTS["es"].upper(), TEXTS["en"] * 300, "日本語"]
    ).selectExpr("*", "'q' AS lang_pred", "0 AS score")
    found = language.identify(docs, table(spark))
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found.collect()}
    assert [rows[n][0] for n in range(6)] == ["und", "und", "und", "de", "es", "en"]
    assert rows[0][1] == rows[1][1] == 0.0
    assert rows[6][0] in TEXTS and all(0 <= s <= 1 for _, s in rows.values())
    assert set(found.columns) == set(docs.columns)


def test_nothing_to_learn_and_empty_tables(spark):
    docs = documents(spark, ["some text"])
    blank = spark.createDataFrame([], DOCS)
    assert language.identify(docs, blank).first()["lang_pred"] == "und"
    assert language.identify(blank, table(spark)).count() == 0
    unlabelled = documents(spark, ["some text"], lang=None)
    assert language.identify(docs, unlabelled).first()["lang_pred"] == "und"


def test_held_out_accuracy(spark):
    found = queries.op10_language(spark, "/root/testdata/sf0.01")
    truth = queries.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    rows = found.filter("held_out").join(truth, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
