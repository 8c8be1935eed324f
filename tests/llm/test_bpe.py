import hashlib
import random

import pytest

from figmill.llm import bpe, queries
from helpers import DOCS, documents, prose

PATH = f"{queries.TOKENIZERS}/word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocab():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Vocabulary(file.read())


def odd_texts():
    rng = random.Random(4)
    letters = "abcdefghij 'stllveé ñß0123"
    near = ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(300)]
    wide = [
        "".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x3040, 0x30FF)])) for _ in range(40))
        for _ in range(200)
    ]
    return near + wide + [
        "", " \n ", "don't I'LL we've", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|",
        "İstanbul ΣΑΣ ﬁ ½ ٣", "👍🏽👍 é", "a" * 3000, prose(1, 500), "x\x00y\x85z",
    ]


def test_ids_equal_the_library(vocab, library):
    texts = odd_texts()
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        own = []
        for piece in vocab.pieces(text):
            own.extend([piece] if isinstance(piece, int) else vocab.word(piece))
        assert own == want.ids, text[:60]


def test_compatible_pairs_are_those_the_merges_leave_apart(vocab, library):
    rng = random.Random(2)
    names = [n for n in vocab.names[:20000] if n.isascii() and n.isalpha()]
    for _ in range(500):
        left, right = rng.choice(names), rng.choice(names)
        ids = library.encode(left + right, add_special_tokens=False).ids
        closed = vocab.names.index(right + vocab.suffix) if right + vocab.suffix in vocab.names else None
        if closed is None:
            continue
        pair = [vocab.names.index(left), closed]
        own = library.encode(right, add_special_tokens=False).ids == [closed]
        if own and vocab.compatible(*pair) != (ids == pair):
            # The left token may not be what its own letters merge to.
            assert vocab.compatible(*pair) and ids != pair


def test_encode_and_decode_columns(spark, library):
    texts = odd_texts()[-11:] + [None]
    docs = documents(spark, texts).selectExpr("*", "1 AS ids", "'y' AS decoded")
    coded = bpe.encode(docs, PATH)
    assert coded.columns == [*[c for c in docs.columns if c != "ids"], "ids"]
    for row in bpe.decode(coded, PATH).collect():
        want = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == want
        assert row["decoded"] == library.decode(want, skip_special_tokens=False)


def test_null_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(rows, PATH).collect()] == ["", ""]
    assert bpe.encode(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_ambiguous_merges_are_refused():
    spec = """{"added_tokens": [], "pre_tokenizer": {"pretokenizers": [{"type": "Split",
    "pattern": {"Regex": "."}}]}, "model": {"end_of_word_suffix": "</w>",
    "vocab": {"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5},
    "merges": ["a b", "b c", "ab c", "a bc"]}}"""
    with pytest.raises(ValueError, match="two merges"):
        bpe.Vocabulary(spec)


def test_query_against_the_library(spark, tmp_path, library):
    texts = odd_texts()[::17] + [None, "same", "same"]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op9_bpe(spark, str(tmp_path)).collect()}
    for n, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert found[n]["n_tokens"] == len(ids)
        assert found[n]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[n]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
