"""License notices by an exact set-similarity join with license templates.

A template is found in a text block (a line) when the block holds at least ``CONTAINED`` of the
template's distinct words. Words are put in one global order, rarest first by the number of blocks
of the whole corpus that hold them. A block that holds enough of a template holds one of the first
``size - needed + 1`` words of the template in that order (prefix filter), has at least ``needed``
known words (length filter), and after the first shared word enough of both must be left
(positional filter). What passes is counted exactly, so the filters lose nothing.

Templates are a parameter of a few hundred words in all, which is what travels to the executors.
Words are runs of a-z, 0-9 and other than ASCII characters, with A-Z lower-cased. Null texts are
empty and hold nothing; repeated rows give rows each; a block that holds a template several times
or whose words repeat counts once.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.llm.batches import LOWER, flat, run_hashes, runs, slices

CONTAINED = 0.8

# Phrases that name a license wherever they stand, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices as their licenses word them, and their labels.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license as published by the free software foundation": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the "
    "gnu lesser general public license as published by the free software foundation": "lgpl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "unless required by applicable law or agreed to in writing software distributed under the "
    "license is distributed on an as is basis without warranties or conditions of any kind":
    "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "and associated documentation files to deal in the software without restriction": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without "
    "fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license":
    "cc-by-4.0",
    "this work is licensed under a creative commons attribution sharealike 4 0 international "
    "license": "cc-by-sa-4.0",
}

KEEP = np.zeros(256, bool)
KEEP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def hashes_of(words: list[str]) -> np.ndarray:
    """Hash of each word, as the scan computes it."""
    data, offsets = flat(pa.array(words, pa.string()))
    return run_hashes(data, offsets[:-1], offsets[1:])


def words_of(column: pa.Array):
    """Word hashes, row offsets of the words, block of each word and row of each block."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, rows = runs(KEEP[data], offsets)
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate((offsets[:-1], breaks)))
    block = np.searchsorted(edges, starts, "right") - 1
    return run_hashes(data, starts, ends), rows, block


def _known(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Place of each word in the sorted vocabulary, -1 for others."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def _distinct(block: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (block, word) pairs, by block and then word."""
    both = np.unique(block.astype(np.int64) * size + word)
    return both // size, both % size


def block_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> np.ndarray:
    """Number of blocks of the corpus that hold each word."""
    own = hashes_of(vocabulary)
    order = np.argsort(own)

    def work(batches):
        counts = np.zeros(len(own), np.int64)
        for part in slices(batches):
            hashes, _, block = words_of(part.column("text"))
            at = _known(hashes, own[order])
            _, word = _distinct(block[at >= 0], at[at >= 0], len(own))
            counts += np.bincount(word, minlength=len(own))
        yield pa.RecordBatch.from_arrays(
            [pa.array(order.astype(np.int64)), pa.array(counts)], names=["word", "n"]
        )

    counted = docs.select(F.col(text).alias("text")).mapInArrow(work, "word long, n long")
    out = np.zeros(len(own), np.int64)
    for row in counted.groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[row["word"]] = row["n"]
    return out


class Join:
    """Templates as ascending word ranks, and the prefix index that proposes them."""

    def __init__(self, templates: list[str], vocabulary: list[str], frequency: np.ndarray):
        rarest = sorted(range(len(vocabulary)), key=lambda n: (frequency[n], vocabulary[n]))
        rank = {vocabulary[n]: place for place, n in enumerate(rarest)}
        own = hashes_of([vocabulary[n] for n in rarest])
        order = np.argsort(own)
        self.hashes, self.rank = own[order], order  # sorted hashes and their ranks
        self.size = len(vocabulary)
        self.sets = [sorted({rank[w] for w in t.split()}) for t in templates]
        self.needed = [needed(len(s)) for s in self.sets]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for template, ranks in enumerate(self.sets):
            for place in range(len(ranks) - self.needed[template] + 1):
                self.index.setdefault(ranks[place], []).append((template, place))
        self.prefix = np.zeros(self.size, bool)
        self.prefix[list(self.index)] = True

    def ranked(self, hashes: np.ndarray) -> np.ndarray:
        at = _known(hashes, self.hashes)
        return np.where(at >= 0, self.rank[at], -1)

    def matches(self, ranks: list[int]) -> list[tuple[int, int]]:
        """``(template, shared words)`` of the templates that a block's ascending ranks contain."""
        tried, out = set(), []
        for place, rank in enumerate(ranks):
            for template, at in self.index.get(rank, ()):
                if template in tried:
                    continue
                tried.add(template)  # the first shared word decides
                own, least = self.sets[template], self.needed[template]
                if len(ranks) < least or min(len(ranks) - place, len(own) - at) < least:
                    continue
                shared = len(set(ranks).intersection(own))
                if shared >= least:
                    out.append((template, shared))
        return out


def needed(size: int) -> int:
    """Words that a block must share with a template of ``size`` distinct words."""
    return -(-size * round(CONTAINED * 100) // 100)


def found(hashes, rows, block, join: Join):
    """``row, template, first word, last word, shared`` of each match; words counted in the row."""
    rank = join.ranked(hashes)
    known = np.flatnonzero(rank >= 0)
    start = known[join.prefix[rank[known]]]
    worth = np.unique(block[start])
    known = known[np.isin(block[known], worth)]
    blocks, ranks = _distinct(block[known], rank[known], join.size)
    cuts = np.searchsorted(blocks, worth, "left"), np.searchsorted(blocks, worth, "right")
    ends = np.searchsorted(block, worth, "left"), np.searchsorted(block, worth, "right")
    out = []
    for n in range(len(worth)):
        for template, shared in join.matches(ranks[cuts[0][n] : cuts[1][n]].tolist()):
            own = join.sets[template]
            mine = np.flatnonzero(np.isin(rank[ends[0][n] : ends[1][n]], own)) + ends[0][n]
            row = int(np.searchsorted(rows, mine[0], "right")) - 1
            first = int(rows[row])
            out.append((row, template, int(mine[0]) - first, int(mine[-1]) - first, shared))
    return out


def phrase_places(hashes, rows, phrases: list[str]) -> list[np.ndarray]:
    """Starts of each phrase's places, counted over the slice; none across two rows."""
    end = np.repeat(rows[1:], np.diff(rows))
    out = []
    for phrase in phrases:
        words = hashes_of(phrase.split())
        at = np.flatnonzero(hashes == words[0])
        at = at[at + len(words) <= end[at]] if len(at) else at
        for k, word in enumerate(words[1:], 1):
            at = at[hashes[at + k] == word]
        out.append(at)
    return out


def scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    templates: dict[str, str] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
) -> DataFrame:
    """``id, n_words, phrases, notices`` of every document.

    ``phrases`` is an array of ``(label, word)`` for each place of a phrase, ``notices`` one of
    ``(label, template, first_word, last_word, containment)`` for each template found in a block.
    """
    wanted, named = list(templates), list(phrases)
    vocabulary = sorted({w for t in wanted for w in t.split()})
    join = Join(wanted, vocabulary, block_frequencies(docs, vocabulary, text))
    place = pa.struct([("label", pa.string()), ("word", pa.int64())])
    notice = pa.struct(
        [("label", pa.string()), ("template", pa.string()), ("first_word", pa.int64()),
         ("last_word", pa.int64()), ("containment", pa.float64())]
    )

    def work(batches):
        for part in slices(batches):
            hashes, rows, block = words_of(part.column("text"))
            places = [[] for _ in range(part.num_rows)]
            notices = [[] for _ in range(part.num_rows)]
            for phrase, at in zip(named, phrase_places(hashes, rows, named), strict=True):
                owner = np.searchsorted(rows, at, "right") - 1
                for row, word in zip(owner.tolist(), (at - rows[owner]).tolist(), strict=True):
                    places[row].append({"label": phrases[phrase], "word": word})
            for row, template, first, last, shared in found(hashes, rows, block, join):
                notices[row].append(
                    {
                        "label": templates[wanted[template]],
                        "template": wanted[template],
                        "first_word": first,
                        "last_word": last,
                        "containment": shared / len(join.sets[template]),
                    }
                )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array(np.diff(rows)),
                    pa.array(places, pa.list_(place)),
                    pa.array(notices, pa.list_(notice)),
                ],
                names=["id", "n_words", "phrases", "notices"],
            )

    picked = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return picked.mapInArrow(
        work,
        "id long, n_words long, phrases array<struct<label: string, word: long>>, notices array<"
        "struct<label: string, template: string, first_word: long, last_word: long, "
        "containment: double>>",
    )


def summary(scanned: DataFrame) -> DataFrame:
    """One row of counts and labels for each document of ``scan``."""
    base = F.array_sort(F.array_distinct("phrases.label"))
    every = F.array_sort(F.array_distinct(F.concat("phrases.label", "notices.label")))
    return scanned.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.word").alias("first_word"),
        F.array_max("phrases.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce(F.array_max("notices.containment"), F.lit(0.0)).alias("score"),
    )


def summary_sql() -> str:
    """The summary of ``documents`` as DuckDB SQL, by plain counting."""
    lists = ", ".join(
        "('{}', [{}], {})".format(
            label,
            ", ".join(f"'{w}'" for w in sorted(set(text.split()))),
            needed(len(set(text.split()))),
        )
        for text, label in TEMPLATES.items()
    )
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    letters = "abcdefghijklmnopqrstuvwxyz"
    low = f"translate(coalesce(text, ''), '{letters.upper()}', '{letters}')"
    phrases = " UNION ALL ".join(
        f"SELECT n, i - 1 AS word, '{label}' AS label FROM places WHERE "
        + " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS n, doc_id, {low} AS text FROM documents),
    split AS (SELECT n, doc_id, regexp_extract_all(text, '{word}') AS words FROM docs),
    places AS (SELECT n, words, unnest(range(1, len(words) + 1)) AS i FROM split),
    hits AS ({phrases}),
    base AS (
      SELECT n, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word FROM hits
      GROUP BY n),
    lines AS (SELECT n, unnest(string_split(text, chr(10))) AS line FROM docs),
    blocks AS (SELECT n, list_distinct(regexp_extract_all(line, '{word}')) AS words FROM lines),
    templates(label, own, needed) AS (VALUES {lists}),
    notices AS (
      SELECT n, label, len(list_intersect(words, own)) / len(own) AS containment
      FROM blocks, templates WHERE len(list_intersect(words, own)) >= needed),
    labels AS (
      SELECT n, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 0) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS score
      FROM (SELECT n, label, 0 AS kind, 0.0 AS containment FROM hits
            UNION ALL SELECT n, label, 1, containment FROM notices)
      GROUP BY n)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
      first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
      coalesce(score, 0)::DOUBLE AS score
    FROM split LEFT JOIN base USING (n) LEFT JOIN labels USING (n)
    """
