"""Language identification by cross-parsing entropy.

For every language a suffix automaton holds labelled text. A document is parsed greedily into the
longest phrases that occur in that text; the fewer phrases per character, compared with what the
language needs for unseen text of its own, the closer the document. The language with the fewest
normalised phrases wins.

The automata are fitted on a bounded sample: ``SAMPLE_TEXTS`` whole texts for each language, picked
by a hash of the text, of at most ``SAMPLE_CHARS`` characters (a language with longer texts only
gives their first characters). At most ``MAX_LANGUAGES`` languages, the most frequent ones, are
learned. Everything else reads whole texts.

Characters are lower-cased; every run of other characters than letters is one separator. Texts are
parsed in pieces of ``PIECE`` characters, many side by side in numpy; a phrase ends at a piece's
end. Text that is null or has no letter gives ``und`` with score 0, as does every text when no
language was learned. A text whose letters the sample never shows goes to the language with the
least phrases, ties to the alphabetically first. The score is the softmax of the languages'
phrases per character.
"""

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.llm.batches import lean_slices, ship

UNKNOWN = "und"
SAMPLE_TEXTS = 64
SAMPLE_CHARS = 4000
MAX_LANGUAGES = 200
PIECE = 2048
#: One text in four of the sample stays out of the automaton and sets the language's own rate.
HELD_BACK = 4
SHARPNESS = 60.0
GAP = 1  # the separator; 0 is a letter outside the sample


def _letters() -> np.ndarray:
    """Code point to lower-case code point; GAP for anything but a letter."""
    table = np.full(0x110000, GAP, np.int32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low[0]) if low else code
    return table


_TABLE: list[np.ndarray] = []


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, runs of other characters as one GAP, and row offsets."""
    if not _TABLE:
        _TABLE.append(_letters())
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    folded = _TABLE[0][raw]
    gap = folded == GAP
    keep = ~gap
    if len(gap):
        keep[0] = True
        keep[1:] |= ~gap[:-1]
        keep[ends[:-1][ends[:-1] < len(gap)]] = True
    upto = np.concatenate(([0], np.cumsum(keep)))
    return folded[keep], upto[ends]


class Transitions:
    """Moves of an automaton: most states have one, the others a row of a dense table."""

    def __init__(self, only: np.ndarray, target: np.ndarray, row: np.ndarray, rows: np.ndarray):
        self.only, self.target, self.row, self.rows = only, target, row, rows

    @classmethod
    def of(cls, following: list[dict[int, int]], width: int) -> "Transitions":
        size = len(following)
        branching = [n for n, moves in enumerate(following) if len(moves) > 1]
        only, target = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        row, rows = np.full(size, -1, np.int32), np.full((len(branching), width), -1, np.int32)
        row[branching] = np.arange(len(branching))
        for state, moves in enumerate(following):
            if len(moves) == 1:
                ((only[state], target[state]),) = moves.items()
            for symbol, to in moves.items() if len(moves) > 1 else ():
                rows[row[state], symbol] = to
        return cls(only, target, row, rows)

    @classmethod
    def joined(cls, parts: list["Transitions"], width: int) -> tuple["Transitions", np.ndarray]:
        """One set of moves over the states of all parts, and where each part's states begin."""
        if not parts:
            return cls.of([{}], width), np.zeros(0, np.int64)
        starts = np.cumsum([0, *(len(p.only) for p in parts)])[:-1]
        first = np.cumsum([0, *(len(p.rows) for p in parts)])[:-1]

        def moved(values, by):
            return np.where(values >= 0, values + by, -1).astype(np.int32)

        return cls(
            np.concatenate([p.only for p in parts]),
            np.concatenate([moved(p.target, s) for p, s in zip(parts, starts, strict=True)]),
            np.concatenate([moved(p.row, f) for p, f in zip(parts, first, strict=True)]),
            np.concatenate([moved(p.rows, s) for p, s in zip(parts, starts, strict=True)]),
        ), starts

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """State after the symbol, -1 for none."""
        one = np.where(self.only[state] == symbol, self.target[state], -1)
        row = self.row[state]
        many = row >= 0
        if not many.any():
            return one
        return np.where(many, self.rows[row, symbol] if len(self.rows) else -1, one)


class SuffixAutomaton:
    """The smallest automaton of all substrings."""

    def __init__(self, symbols: list[int], width: int):
        following, link, length = [{}], [-1], [0]
        last = 0
        for symbol in symbols:
            here = len(following)
            following.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at >= 0 and symbol not in following[at]:
                following[at][symbol] = here
                at = link[at]
            if at >= 0:
                target = following[at][symbol]
                if length[at] + 1 == length[target]:
                    link[here] = target
                else:
                    copy = len(following)
                    following.append(dict(following[target]))
                    link.append(link[target])
                    length.append(length[at] + 1)
                    while at >= 0 and following[at].get(symbol) == target:
                        following[at][symbol] = copy
                        at = link[at]
                    link[target] = link[here] = copy
            last = here
        self.moves = Transitions.of(following, width)


class Languages:
    """Automata and own rates of all languages; built from the sample, small enough to ship."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        points = {n: code_points(samples[n]) for n in self.names}
        found = np.unique(np.concatenate([p for p, _ in points.values()] or [np.zeros(0, int)]))
        self.alphabet = found[found != GAP]
        width = len(self.alphabet) + 2
        parts, self.rates = [], []
        for name in self.names:
            symbols, ends = points[name][0], points[name][1]
            coded = self.symbols(symbols)
            own, rest = [], []
            for n in range(len(ends) - 1):
                text = coded[ends[n] : ends[n + 1]].tolist()
                held = n % HELD_BACK == HELD_BACK - 1
                (rest if held else own).append(text)
            parts.append(SuffixAutomaton([s for t in own for s in [*t, GAP]], width).moves)
            self.rates.append(rest or own)
        self.moves, self.starts = Transitions.joined(parts, width)
        rates = []
        for n, texts in enumerate(self.rates):
            pieces = [np.array(t, np.int64) for t in texts if t]
            sizes = sum(map(len, pieces))
            phrases = self.phrases(
                np.concatenate(pieces) if pieces else np.zeros(0, np.int64),
                np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64),
            )[:, n].sum()
            rates.append(max(phrases, 1) / max(sizes, 1))
        self.rates = np.array(rates)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Columns of the table: GAP, letters of the sample from 2 on, 0 for any other."""
        if not len(self.alphabet):
            return np.where(points == GAP, GAP, 0)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(points == GAP, GAP, np.where(self.alphabet[at] == points, at + 2, 0))

    def phrases(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Greedy longest-match phrases of each text (rows) in each language (columns)."""
        sizes = np.diff(ends)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        upto = np.cumsum(pieces)
        within = np.arange(len(owner)) - np.repeat(upto - pieces, pieces)
        first = ends[owner] + within * PIECE
        length = np.minimum(PIECE, ends[owner + 1] - first)
        order = np.argsort(-length, kind="stable")
        first, length, owner = first[order], length[order], owner[order]
        live = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1),
                               "right")
        starts = self.starts
        state = np.tile(starts, (len(first), 1))
        count = np.zeros((len(first), len(starts)), np.int32)
        for at, n in enumerate(live.tolist()):
            symbol = symbols[first[:n] + at][:, None]
            target = self.moves.step(state[:n], symbol)
            dead = target < 0
            again = self.moves.step(starts, symbol)  # a new phrase begins with this symbol
            alone = dead & (again < 0)  # or is this symbol, which the sample never shows
            count[:n] += dead & (state[:n] != starts)
            count[:n] += alone
            target = np.where(dead, np.where(alone, starts, again), target)
            state[:n] = target
        count += state != starts  # the phrase that the piece's end cuts
        out = np.zeros((len(sizes), len(starts)), np.int64)
        np.add.at(out, owner, count)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        points, ends = code_points(texts)
        letter = np.concatenate(([0], np.cumsum(points != GAP)))
        letters = letter[ends[1:]] - letter[ends[:-1]]
        counts = self.phrases(self.symbols(points), ends)
        rate = counts / np.maximum(np.diff(ends), 1)[:, None] / self.rates
        best = rate.argmin(1) if len(self.names) else np.zeros(len(texts), int)
        shares = np.exp(-(rate - rate.min(1, keepdims=True)) * SHARPNESS * self.rates.mean())
        score = 1.0 / shares.sum(1)
        known = letters > 0
        names = [self.names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return names, np.where(known, score, 0.0)


def sampled(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """Texts of the sample by language. Each cell of hashes keeps one text, so copies meet."""
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
    top = known.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MAX_LANGUAGES)
    names = [r[0] for r in top.collect()]
    hashed = F.xxhash64(text)
    rank = F.struct(
        (F.length(text) > SAMPLE_CHARS).alias("long"), hashed.alias("hash"), F.col(text).alias("t")
    )
    cells = (
        known.filter(F.col(lang).isin(names))
        .groupBy(lang, F.pmod(hashed, F.lit(SAMPLE_TEXTS)).alias("cell"))
        .agg(F.min_by(F.substring(text, 1, SAMPLE_CHARS), rank).alias("text"))
    )
    samples: dict[str, list[str]] = {}
    for row in cells.orderBy(lang, "cell").collect():
        samples.setdefault(row[lang], []).append(row["text"])
    return samples


def identify(
    docs: DataFrame,
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    name: str = "lang_pred",
    score: str = "score",
) -> DataFrame:
    """``docs`` with the columns ``name`` and ``score``; languages are learned from ``labelled``."""
    samples = sampled(labelled, text, lang)
    if not samples:
        return docs.withColumns({name: F.lit(UNKNOWN), score: F.lit(0.0)})
    model = ship(docs.sparkSession, Languages(samples))
    kept = docs.drop(name, score)
    fields = {name: F.lit(None).cast("string"), score: F.lit(None).cast("double")}
    schema = kept.withColumns(fields).schema

    def work(batches):
        for part in lean_slices(batches, text, 2 << 20):
            texts = pc.fill_null(part.column(text), "").to_pylist()
            names, sure = model.value.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64())],
                names=[*part.schema.names, name, score],
            )

    return kept.mapInArrow(work, schema)
