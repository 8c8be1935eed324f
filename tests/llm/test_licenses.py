import re

import pyarrow as pa

from figmill.llm import licenses
from helpers import DOCS, documents, lower, prose


def tokens(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(text))


def texts():
    own = list(licenses.TEMPLATES)
    out = [f"{prose(n, 40)}\n{t.title()}.\n{prose(n + 50, 30)}" for n, t in enumerate(own)]
    for n, t in enumerate(own):
        words = t.split()
        out.append(" ".join(words[: int(0.75 * len(words))]) + "\n" + " ".join(words[::-1]))
        out.append(prose(n, 9) + " " + " ".join(w for k, w in enumerate(words) if k % 6) + " " + prose(n, 9))
    return out + [None, "", "\n\n", "MIT License mit license\nCC-BY", "gnu general\npublic license", "die mit der"]


def brute(text):
    own = tokens(text)
    base = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        base += [(n, label) for n in range(len(own)) if own[n : n + len(p)] == p]
    found = []
    for line in (text or "").split("\n"):
        block = set(tokens(line))
        for template, label in licenses.TEMPLATES.items():
            t = set(template.split())
            if len(block & t) >= licenses.needed(len(t)):
                found.append((len(block & t) / len(t), label))
    labels = {label for _, label in base}
    places = [n for n, _ in base]
    return (
        len(own), len(base), min(places, default=None), max(places, default=None),
        ",".join(sorted(labels)), ",".join(sorted(labels | {label for _, label in found})),
        max((c for c, _ in found), default=0.0),
    )


def test_summary_against_brute_force(spark):
    rows = texts()
    docs = documents(spark, rows).selectExpr("*", "1 AS id", "2 AS n_words", "3 AS labels")
    found = {r["doc_id"]: tuple(r)[1:] for r in licenses.summary(licenses.scan(docs)).collect()}
    assert found == {n: brute(t) for n, t in enumerate(rows)}


def test_spans_lie_on_the_notice(spark):
    template = "released under the mit license"
    docs = documents(spark, [f"one two\nX {template} y\nthree"])
    notice = licenses.scan(docs).first()["notices"][0]
    assert (notice["first_word"], notice["last_word"], notice["containment"]) == (3, 7, 1.0)


def test_filters_propose_every_block_that_counts():
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in t.split()})
    templates = list(licenses.TEMPLATES)
    join = licenses.Join(templates, vocabulary, licenses.hashes_of(vocabulary) % 97)
    column = pa.array(texts(), pa.string())
    hashes, rows, block = licenses.words_of(column)
    found = {(row, t) for row, t, *_ in licenses.found(hashes, rows, block, join)}
    want = set()
    for n, text in enumerate(texts()):
        for line in (text or "").split("\n"):
            for t, template in enumerate(templates):
                own = set(template.split())
                if len(set(tokens(line)) & own) >= licenses.needed(len(own)):
                    want.add((n, t))
    assert found == want


def test_empty_table_and_repeated_rows(spark):
    assert licenses.summary(licenses.scan(spark.createDataFrame([], DOCS))).count() == 0
    same = documents(spark, [(1, "cc by"), (1, "cc by"), (None, "cc by")])
    assert [r["n_base"] for r in licenses.summary(licenses.scan(same)).collect()] == [1, 1, 1]
