"""Small tables and brute-force readings shared by the tests of the training-data operators."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    """A documents table of these texts; entries may be ``(id, text)``."""
    rows = []
    for n, entry in enumerate(texts):
        name, text = entry if isinstance(entry, tuple) else (n, entry)
        rows.append((name, text, lang, "src", None if text is None else len(text)))
    return spark.createDataFrame(rows, DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, width):
    own = words(text)
    if not own:
        return []
    return [" ".join(own[k : k + width]) for k in range(max(1, len(own) - width + 1))]


def prose(seed, count, vocabulary=400):
    """``count`` random words of a fixed vocabulary."""
    rng = random.Random(seed)
    base = random.Random(1)
    syllables = ["ba", "lo", "ti", "ren", "sha", "mo", "ke", "du", "vi", "ost"]
    names = ["".join(base.choice(syllables) for _ in range(base.randint(1, 4))) for _ in range(vocabulary)]
    return " ".join(rng.choice(names) for _ in range(count))
