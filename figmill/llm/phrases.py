"""Collocations: frequent phrases per language, scored by how much more often they stand together.

Phrases are counted by vertically partitioned suffix trees. A suffix is the run of words from a
place to the end of its piece, cut after ``LONGEST`` words. Prefixes are counted first: words, then
word pairs of which both are frequent. A phrase of ``least`` places has only frequent words and
pairs, so a suffix is cut where a pair is rarer, and only suffixes under frequent prefixes are left.
A prefix with more than ``BUDGET`` places is extended by another word, and its extensions counted,
until every prefix fits or is a whole suffix; no scan is made for an extension nobody needs. Then
prefixes are grouped, in the order of their hashes, until a group holds ``BUDGET`` places. Every
task packs the suffixes of its texts by group, equal ones once with their number; a group gets its
suffixes from all tasks, sorts them into the subtrees under its prefixes, independently of all
other groups, and reads each node's count as the total of its leaves.

Counts then meet in ordinary joins: a phrase with the counts of its parts for the score, with the
phrases one word longer that contain it (a longer one of equal count implies one of those), and
with the spelling of its words. Joins on single words, which may be in a third of all phrases, are
salted. Words and pairs are known by 64-bit hashes with their language.

What is shipped to tasks: two filters of 2^24 bits (false hits only cost time), the table of groups
(2^20 numbers at most) and the prefixes over budget, of which there are no more than places divided
by ``BUDGET`` at any depth.

Defined results: null text is empty, null language ``und``; repeated rows count again; a language
without candidates gives no rows; an empty table none.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill.llm.batches import LOWER, flat, gather, lean_slices, mixed, run_hashes, runs
from figmill.llm.filters import FILTER_BITS, bit_filter, within
from figmill.sources.staging import stage

LONGEST = 5
#: Places of one group, and so of one subtree build.
BUDGET = 1 << 20
CELL_BITS = 20
#: Entries a task holds before it hands them on.
HELD = 1 << 19
SLICE = 4 << 20
SALTS = 16
UNKNOWN = "und"

CUTS = np.zeros(256, bool)
CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09]] = True
_NEXT = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of a batch of texts: bytes, places, hashes with language, and which follow one
    another in a piece."""

    def __init__(self, part: pa.RecordBatch):
        data, offsets = flat(part.column("text"))
        self.data = LOWER[data]
        cut = CUTS[self.data]
        self.starts, self.ends, rows = runs(~(cut | BLANKS[self.data]), offsets)
        langs = part.column("lang").to_pylist()
        seeds = {l: xxhash.xxh64_intdigest(l.encode()) for l in set(langs)}
        self.owner = np.repeat(np.arange(len(langs)), np.diff(rows))
        own = np.array([seeds[l] for l in langs], np.uint64)[self.owner]
        self.keys = mixed(run_hashes(self.data, self.starts, self.ends) ^ own)
        self.keys[self.keys == 0] = 1  # zero stands for no word
        piece = np.cumsum(cut, dtype=np.int64)
        self.follows = np.zeros(len(self.keys), bool)
        if len(self.keys) > 1:
            a, b = self.starts[:-1], self.starts[1:]
            self.follows[:-1] = (piece[a] == piece[b]) & (self.owner[:-1] == self.owner[1:])


def extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a prefix with one more word."""
    with np.errstate(over="ignore"):
        return mixed(prefix * _NEXT + word)


def _picked(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"),
    )


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, key, word, f`` of every distinct word of each language."""

    def work(batches):
        for part in lean_slices(batches, limit=SLICE):
            words = Words(part)
            keys, first, counts = np.unique(words.keys, return_index=True, return_counts=True)
            sizes = (words.ends - words.starts)[first]
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            spelled = gather(words.data, words.starts[first], sizes)
            names = pa.StringArray.from_buffers(
                len(first), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(spelled))
            )
            langs = part.column("lang").take(pa.array(words.owner[first]))
            yield pa.RecordBatch.from_arrays(
                [langs, pa.array(keys.view(np.int64)), names, pa.array(counts)],
                names=["lang", "key", "word", "f"],
            )

    rows = _picked(docs, text, lang).mapInArrow(work, "lang string, key long, word string, f long")
    return rows.groupBy("lang", "key", "word").agg(F.sum("f").alias("f"))


class Prefixes:
    """What is known of frequent prefixes: filters and, per depth, the prefixes over budget."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.pairs: np.ndarray | None = None
        self.deeper: list[tuple[np.ndarray, np.ndarray]] = []  # over budget; filter one deeper

    def over(self, depth: int, keys: np.ndarray) -> np.ndarray:
        """Which prefixes of this depth are over budget?"""
        if depth - 2 >= len(self.deeper) or not len(keys):
            return np.zeros(len(keys), bool)
        large = self.deeper[depth - 2][0]
        place = np.minimum(np.searchsorted(large, keys), len(large) - 1)
        return large[place] == keys

    def suffixes(self, words: Words, longest: int = LONGEST):
        """Places whose suffix has two words or more, hashes of its prefixes by depth (from the
        first) and its length."""
        likely = within(self.words, words.keys)
        pair = words.follows.copy()
        pair[:-1] &= likely[:-1] & likely[1:]
        at = np.flatnonzero(pair)
        keys = words.keys
        two = extended(keys[at], keys[at + 1])
        if self.pairs is not None:
            there = within(self.pairs, two)
            at, two = at[there], two[there]
        runs_on = np.zeros(len(keys) + longest, bool)
        runs_on[at] = True
        length, live = np.full(len(at), 2), np.ones(len(at), bool)
        hashes = [keys[at], two]
        for depth in range(3, longest + 1):
            live &= runs_on[at + depth - 2]
            here = hashes[-1].copy()
            rows = np.flatnonzero(live)
            here[rows] = extended(here[rows], keys[at[rows] + depth - 1])
            if depth - 3 < len(self.deeper):
                large = self.over(depth - 1, hashes[-1][rows])
                gone = rows[large][~within(self.deeper[depth - 3][1], here[rows[large]])]
                live[gone] = False
                here[gone] = hashes[-1][gone]
            length[live] = depth
            hashes.append(here)
        return at, hashes, length


class _Held:
    """Entries ``key, count`` (and more columns by key) that a task gathers."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> None:
        keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
        summed = np.bincount(at, counts, len(keys)).astype(np.int64)
        self.parts.append((keys, summed, *(m[first] for m in more)))
        self.size += len(keys)
        if self.size >= HELD and len(self.parts) > 1:
            parts, self.parts, self.size = self.parts, [], 0
            self.add(*(np.concatenate(c) for c in zip(*parts)))

    def full(self) -> bool:
        return self.size >= HELD

    def taken(self) -> tuple[np.ndarray, ...] | None:
        parts, self.parts, self.size = self.parts, [], 0
        if not parts:
            return None
        held = _Held()
        held.size = -(1 << 62)  # merge once
        held.add(*(np.concatenate(c) for c in zip(*parts)))
        return held.parts[0]


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """All rows of one part in one task, one part after another."""
    return rows.repartition(parts, "part").sortWithinPartitions("part")


def _by_part(batches):
    """``part, rows`` for every part of a stream in order; a row is a tuple of its other columns."""
    part, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for own, *row in zip(*columns):
            if own != part:
                if rows:
                    yield part, rows
                part, rows = own, []
            rows.append(row)
    if rows:
        yield part, rows


def _spread(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of each key; ascending keys give ascending parts."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def prefix_counts(docs: DataFrame, known: Prefixes, depth: int, parts: int, least: int) -> DataFrame:
    """``key, f`` of the prefixes of ``depth`` words with ``least`` places or more, for depths over
    two only those under a prefix over budget."""
    shipped = docs.sparkSession.sparkContext.broadcast(known)

    def packed(entries):
        keys, counts = entries
        part = _spread(keys, parts)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
        for a in range(0, len(edges) - 1, 4096):
            spans = list(zip(edges[a : a + 4097][:-1], edges[a : a + 4097][1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(part[x]) for x, _ in spans], pa.int64()),
                    pa.array([keys[x:y].tobytes() for x, y in spans], pa.binary()),
                    pa.array([counts[x:y].tobytes() for x, y in spans], pa.binary()),
                ],
                names=["part", "keys", "counts"],
            )

    def work(batches):
        prefixes, held = shipped.value, _Held()
        for piece in lean_slices(batches, limit=SLICE):
            _, hashes, length = prefixes.suffixes(Words(piece), depth)
            rows = length >= depth
            if depth > 2:
                rows &= prefixes.over(depth - 1, hashes[depth - 2])
            held.add(hashes[depth - 1][rows], np.ones(np.count_nonzero(rows), np.int64))
            if held.full():
                yield from packed(held.taken())
        if (rest := held.taken()) is not None and len(rest[0]):
            yield from packed(rest)

    def summed(batches):
        for _, rows in _by_part(batches):
            held = _Held()
            for keys, counts in rows:
                held.add(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64))
            keys, counts = held.taken()
            kept = counts >= least
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[kept].view(np.int64)), pa.array(counts[kept])], names=["key", "f"]
            )

    rows = docs.mapInArrow(work, "part long, keys binary, counts binary")
    found = stage(_dealt(rows, parts).mapInArrow(summed, "key long, f long"), "phrases-prefixes")
    shipped.unpersist()
    return found


def _filter_of(keys: DataFrame) -> np.ndarray:
    return bit_filter(keys.select(F.col("key").bitwiseAND(FILTER_BITS - 1).alias("bit")))


def _groups(prefixes: list[DataFrame]) -> np.ndarray:
    """Group of each hash cell: consecutive cells until ``BUDGET`` places are reached."""
    cell = F.shiftrightunsigned("key", 64 - CELL_BITS).cast("int").alias("cell")
    sums = [p.groupBy(cell).agg(F.sum("f").alias("f")) for p in prefixes]
    places = np.zeros(1 << CELL_BITS, np.int64)
    for table in sums:
        found = table.toPandas()  # a row per cell at most
        np.add.at(places, found["cell"].to_numpy(np.int64), found["f"].to_numpy(np.int64))
    group = np.zeros(len(places), np.int32)
    upto, now = 0, 0
    for at in np.flatnonzero(places).tolist():
        if upto and upto + places[at] > BUDGET:
            now, upto = now + 1, 0
        upto += int(places[at])
        group[at] = now
    filled = np.flatnonzero(places)
    ahead = np.searchsorted(filled, np.arange(len(places)))
    return group[filled[np.minimum(ahead, len(filled) - 1)]] if len(filled) else group


def subtrees(words: np.ndarray, counts: np.ndarray, least: int, shared=None):
    """Nodes of two words or more of the subtrees over these suffixes: ``(words, totals)`` by depth.

    ``words`` is a matrix of word hashes, zero after a suffix's end. Nodes of fewer than ``least``
    places are left out, except where ``shared(depth, hashes)`` says that other groups may have
    more of them.
    """
    order = np.lexsort(words.T[::-1])
    words, counts = words[order], counts[order]
    fresh = np.zeros(len(words), bool)
    fresh[:1] = True
    fresh[1:] |= words[1:, 0] != words[:-1, 0]
    hashes = words[:, 0]
    for depth in range(2, words.shape[1] + 1):
        fresh[1:] |= words[1:, depth - 1] != words[:-1, depth - 1]
        starts = np.flatnonzero(fresh)
        totals = np.add.reduceat(counts, starts)
        hashes = extended(hashes, words[:, depth - 1])
        kept = totals >= least
        if shared is not None:
            kept |= shared(depth, hashes[starts])
        kept &= words[starts, depth - 1] != 0
        yield words[starts[kept], :depth], totals[kept]


def phrase_counts(
    docs: DataFrame, known: Prefixes, groups: np.ndarray, least: int, longest: int = LONGEST
) -> DataFrame:
    """``words, f``: word hashes and places of every phrase of two words or more."""
    shipped = docs.sparkSession.sparkContext.broadcast((known, groups))
    parts = int(groups.max()) + 1

    def packed(entries, table):
        _, counts, prefix, words, length = entries
        part = table[(prefix >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
        order = np.argsort(part, kind="stable")
        part, counts, words, length = part[order], counts[order], words[order], length[order]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
        for a in range(0, len(edges) - 1, 4096):
            spans = list(zip(edges[a : a + 4097][:-1], edges[a : a + 4097][1:]))
            flatten = [words[x:y][words[x:y] != 0].tobytes() for x, y in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(part[x]) for x, _ in spans], pa.int64()),
                    pa.array(flatten, pa.binary()),
                    pa.array([length[x:y].tobytes() for x, y in spans], pa.binary()),
                    pa.array([counts[x:y].tobytes() for x, y in spans], pa.binary()),
                ],
                names=["part", "words", "lengths", "counts"],
            )

    def work(batches):
        prefixes, table = shipped.value
        held = _Held()
        for piece in lean_slices(batches, limit=SLICE):
            words = Words(piece)
            at, hashes, length = prefixes.suffixes(words, longest)
            prefix, undecided = hashes[1].copy(), np.ones(len(at), bool)
            for depth in range(2, longest):
                undecided &= prefixes.over(depth, hashes[depth - 1])
                if not undecided.any():
                    break
                prefix[undecided] = hashes[depth][undecided]
            padded = np.concatenate((words.keys, np.zeros(longest, np.uint64)))
            matrix = padded[at[:, None] + np.arange(longest)]
            matrix[np.arange(longest) >= length[:, None]] = 0
            ones = np.ones(len(at), np.int64)
            held.add(hashes[-1], ones, prefix, matrix, length.astype(np.uint8))
            if held.full():
                yield from packed(held.taken(), table)
        if (rest := held.taken()) is not None and len(rest[0]):
            yield from packed(rest, table)

    def built(batches):
        prefixes = shipped.value[0]
        for _, rows in _by_part(batches):
            lengths = np.concatenate([np.frombuffer(r[1], np.uint8) for r in rows]).astype(np.int64)
            counts = np.concatenate([np.frombuffer(r[2], np.int64) for r in rows])
            words = np.zeros((len(lengths), longest), np.uint64)
            words[np.arange(longest) < lengths[:, None]] = np.concatenate(
                [np.frombuffer(r[0], np.uint64) for r in rows]
            )
            rows.clear()
            for nodes, totals in subtrees(words, counts, least, prefixes.over):
                width = nodes.shape[1]
                ends = np.arange(0, nodes.size + 1, width, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(nodes.ravel().view(np.int64))),
                        pa.array(totals),
                    ],
                    names=["words", "f"],
                )

    schema = "part long, words binary, lengths binary, counts binary"
    rows = docs.mapInArrow(work, schema)
    nodes = _dealt(rows, parts).mapInArrow(built, "words array<long>, f long")
    found = stage(
        nodes.groupBy("words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least),
        "phrases-counts",
    )
    shipped.unpersist()
    return found


def mined(
    docs: DataFrame, least: int, text: str = "text", lang: str = "lang", longest: int = LONGEST
) -> tuple[DataFrame, DataFrame]:
    """``(words, phrases)``: ``lang, key, word, f`` of all words and ``words, f`` of all phrases of
    two to ``longest`` words with ``least`` places or more."""
    picked = _picked(docs, text, lang)
    words = stage(word_counts(docs, text, lang), "phrases-words")
    total = words.agg(F.sum("f")).first()[0] or 0
    parts = total // BUDGET + 1
    known = Prefixes(_filter_of(words.filter(F.col("f") >= least)))
    fitting, depth = [], 2
    while True:
        found = prefix_counts(picked, known, depth, parts, least)
        over = found.filter(F.col("f") > BUDGET)
        large = np.sort(over.select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64))
        if depth == 2:
            known.pairs = _filter_of(found)
        else:
            known.deeper[-1] = (known.deeper[-1][0], _filter_of(found))
        if not len(large) or depth == longest:
            fitting.append(found)
            break
        fitting.append(found.filter(F.col("f") <= BUDGET))
        known.deeper.append((large, np.full(FILTER_BITS // 64, ~np.uint64(0))))
        depth += 1
    return words, phrase_counts(picked, known, _groups(fitting), least, longest)


def _with_words(rows: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``lang, word, word_f`` of the word ``key``; hot words are salted."""
    salts = F.array(*[F.lit(n).cast("long") for n in range(SALTS)])
    named = words.select(
        F.col("key").alias(key), "lang", "word", F.col("f").alias("word_f"),
        F.explode(salts).alias("salt"),
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(SALTS)))
    return salted.join(named, [key, "salt"]).drop("salt")


def collocations(
    docs: DataFrame,
    least: int = 100,
    top: int = 2000,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``top`` phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut, ``n`` the words of
    the language; the score is ``floor(1000 a n / (l r))``. Phrases that stand only inside one
    longer phrase are left out.
    """
    words, phrases = mined(docs, least, text, lang, longest)
    totals = stage(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrases-totals")
    frequent = words.filter(F.col("f") >= least)
    size = F.size("words")
    inner = phrases.filter(size > 2).select(
        F.explode(
            F.array(F.slice("words", 1, size - 1), F.slice("words", F.lit(2), size - 1))
        ).alias("words"),
        F.col("f").alias("outer"),
    )
    inner = inner.groupBy("words").agg(F.max("outer").alias("outer"))
    kept = phrases.join(inner, "words", "left").filter("outer IS NULL OR outer < f").select(
        "words", F.col("f").alias("a")
    )
    kept = stage(kept, "phrases-kept")
    spelled = _with_words(kept.select("words", F.posexplode("words").alias("at", "key")), frequent, "key")
    spelled = spelled.groupBy("words").agg(
        F.max("lang").alias("lang"),
        F.array_sort(F.collect_list(F.struct("at", "word", "word_f"))).alias("own"),
    )
    places = range(2, longest)
    sliced = [
        F.when(
            size > k, F.struct(F.lit(f"{side}{k}").alias("name"), F.slice("words", start, k).alias("part"))
        )
        for k in places
        for side, start in (("l", F.lit(1)), ("r", size - k + 1))
    ]
    parts = kept.filter(size > 2).select(
        "words", F.inline(F.array_compact(F.array(*sliced)))
    )
    counts = phrases.select(F.col("words").alias("part"), F.col("f").alias("part_f"))
    parts = parts.join(counts, "part").groupBy("words").agg(
        *[
            F.max(F.when(F.col("name") == f"{side}{k}", F.col("part_f"))).alias(f"{side}{k}")
            for k in places
            for side in "lr"
        ]
    )
    whole = kept.join(spelled, "words").join(parts, "words", "left").join(totals, "lang")
    whole = whole.withColumns(
        {"l1": F.col("own")[0]["word_f"], "r1": F.element_at("own", -1)["word_f"]}
    )
    first = F.array(*[F.col(f"l{k}") for k in range(1, longest)])
    rest = F.array(*[F.col(f"r{k}") for k in range(1, longest)])
    cuts = F.transform(
        F.sequence(F.lit(1), F.size("words") - 1),
        lambda k: F.struct(
            k.alias("k"),
            F.element_at(first, k).alias("l"),
            F.element_at(rest, F.size("words") - k).alias("r"),
        ),
    )
    one = whole.select(
        "lang", "a", "n",
        F.array_join(F.transform("own", lambda w: w["word"]), " ").alias("phrase"),
        F.explode(cuts).alias("cut"),
    ).select("lang", "a", "n", "phrase", "cut.*")
    score = F.expr(
        "cast(1000 as decimal(4,0)) * (cast(a as decimal(17,0)) * cast(n as decimal(17,0)))"
        " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    )
    lowest = one.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best")
    )
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        lowest.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


def collocations_sql(least: int = 100, top: int = 2000, longest: int = LONGEST) -> str:
    """DuckDB SQL of ``collocations`` over ``documents``: every phrase of every piece is counted."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), listed AS (
  SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM pieces
), places AS (
  SELECT lang, p, unnest(w) AS word, unnest(range(len(w))) AS i FROM listed
), runs AS (
  SELECT lang, [{", ".join(["word", *[f"lead(word, {k}) OVER o" for k in range(1, longest)]])}] AS own
  FROM places WINDOW o AS (PARTITION BY p ORDER BY i)
), counts AS MATERIALIZED (
  SELECT lang, m, array_to_string(own[1:m], ' ') AS phrase, count(*) AS f
  FROM runs, range(1, {longest + 1}) AS t(m) WHERE own[m] IS NOT NULL GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a
  FROM counts WHERE m > 1 AND f >= {least}
), cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, l.f AS l, r.f AS r, n,
         (c.a::HUGEINT * 1000 * n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN totals USING (lang)
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM candidates s JOIN (
    SELECT lang, m, a, unnest(list_transform(range(1, m), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS part
    FROM candidates, range(2, {longest}) AS t(size) WHERE size < m
  ) longer ON longer.lang = s.lang AND longer.part = s.phrase AND longer.m > s.m
  WHERE 100 * longer.a >= 100 * s.a
), ranked AS (
  SELECT lang, phrase, a, l, r, n, score::BIGINT AS score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest ANTI JOIN inside USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {top}
"""
