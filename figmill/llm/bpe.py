"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can be the last of its encoding. The tokens that end
at a place are the vocabulary's suffix matches there, which an automaton over all tokens gives,
longest first; one of them is the last token when it covers the whole prefix or is compatible with
the last token of the prefix before it. Back-pointers then spell the encoding. No merge is ever
simulated, and words are encoded once per slice of rows.

Two tokens are compatible when merging their joined bytes leaves them as they are. Along the
boundary each token shows the pieces of its own merge tree, each from the merge that forms it to
the merge that consumes it; the pair is incompatible exactly if some two pieces that meet have a
merge that comes before the one that would consume either (at equal rank the left place wins).

Texts pass through the file's own steps: added tokens are cut out first, the rest is composed
(NFC), lower-cased character by character and split by the file's pattern. Words are UTF-8 bytes
whose last symbol carries the end-of-word mark. Decoding joins tokens with one space, as the file
names no decoder. Null texts count as empty and give no ids; null ids decode to the empty text.
"""

import json
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.llm.batches import gather, kept, lean_slices

#: Words and compatible pairs that a worker remembers; older ones are forgotten all at once.
WORDS_KEPT = 50_000
PAIRS_KEPT = 150_000
END = 256  # added to the code of a word's last byte


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, reversed."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def token_names(spec: dict) -> list[str]:
    """Text of every token by its id, added tokens included."""
    numbers = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    names = [""] * (1 + max(numbers.values()))
    for name, number in numbers.items():
        names[number] = name
    return names


class Vocabulary:
    """Tokens of a tokenizer file, its automaton and the merge trees at token boundaries."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(
            p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        )
        self.words = regex.compile(split["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"))
        self.specials = regex.compile(
            "(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len)[::-1]) + ")"
        ) if self.added else None
        self.names = token_names(spec)
        letters = _byte_letters()
        self.automaton = ahocorasick.Automaton()
        for name, number in model["vocab"].items():
            symbols = self._symbols(name, letters)
            self.automaton.add_word(symbols, (number, len(symbols)))
        self.automaton.make_automaton()
        self.rank: dict[tuple[int, int], int] = {}
        formed: dict[int, tuple[int, int, int]] = {}
        for order, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = model["vocab"][left], model["vocab"][right]
            whole = model["vocab"][left + right]
            self.rank[pair] = order
            if whole in formed:
                raise ValueError(f"Token {left + right!r} has two merges; prefixes are ambiguous.")
            formed[whole] = (order, *pair)
        self.formed = formed
        self.never = len(self.rank)
        self.spines: tuple[dict, dict] = {}, {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _symbols(self, name: str, letters: dict[str, int]) -> str:
        ends = name.endswith(self.suffix)
        codes = [letters[c] for c in (name[: -len(self.suffix)] if ends else name)]
        if ends:
            codes[-1] += END
        return "".join(map(chr, codes))

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Pieces at the left (0) or right (1) end of the token, the smallest first, each with the
        rank of the merge that consumes it."""
        known = self.spines[side].get(token)
        if known is None:
            pieces, at = [(token, self.never)], token
            while at in self.formed:
                rank, at = self.formed[at][0], self.formed[at][1 + side]
                pieces.append((at, rank))
            known = self.spines[side][token] = pieces[::-1]
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Do these tokens stay two when their bytes are merged?"""
        a, b, i, j = self._spine(left, 1), self._spine(right, 0), 0, 0
        while True:
            (x, gone_x), (y, gone_y) = a[i], b[j]
            rank = self.rank.get((x, y), self.never)
            if rank < gone_x and rank <= gone_y and rank < self.never:
                return False
            if gone_x == gone_y == self.never:
                return True
            if gone_x <= gone_y:
                i += 1
            else:
                j += 1

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word."""
        data = word.encode()
        symbols = data[:-1].decode("latin-1") + chr(data[-1] + END)
        size, pairs = len(symbols), self.pairs
        last = [-1] * size  # the token that ends at each place
        back = [0] * size  # and where the prefix before it ends
        for end, (token, length) in self.automaton.iter(symbols):
            if last[end] >= 0:
                continue
            before = end - length
            if before >= 0:
                pair = (last[before], token)
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= PAIRS_KEPT:
                        pairs.clear()
                    fits = pairs[pair] = pair[0] >= 0 and self.compatible(*pair)
                if not fits:
                    continue
            last[end], back[end] = token, before
        out, end = [], size - 1
        while end >= 0:
            out.append(last[end])
            end = back[end]
        return tuple(out[::-1])

    def pieces(self, text: str) -> list[str | int]:
        """Words of a text; an added token is its id."""
        if self.specials is None or not self.specials.search(text):
            return self.words.findall(self._normal(text))
        out: list[str | int] = []
        for part in self.specials.split(text):
            if part in self.added:
                out.append(self.added[part])
            else:
                out.extend(self.words.findall(self._normal(part)))
        return out

    @staticmethod
    def _normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()


def vocabulary(name: str) -> Vocabulary:
    """The vocabulary shipped under ``name``, read once per worker and kept while it encodes."""

    def load() -> Vocabulary:
        with open(SparkFiles.get(name), encoding="utf-8") as file:
            return Vocabulary(file.read())

    return kept(name, load)


def send(spark, path: str) -> str:
    """Send the tokenizer file to every executor; the name it has there."""
    spark.sparkContext.addFile(path)
    return path.rstrip("/").rpartition("/")[2]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids``, an array of token ids."""
    name = send(docs.sparkSession, path)
    rows = docs.drop(ids)
    schema = rows.withColumn(ids, F.lit(None).cast("array<int>")).schema

    def work(batches):
        for part in lean_slices(batches, text, 1 << 21, keep=name):
            vocab = vocabulary(name)
            words: dict[str | int, int] = {}
            seen: list[str | int] = []
            rows = []
            for value in part.column(text).to_pylist():
                row = []
                for piece in vocab.pieces(value) if value else ():
                    number = words.get(piece)
                    if number is None:
                        number = words[piece] = len(seen)
                        seen.append(piece)
                    row.append(number)
                rows.append(row)
            coded = []
            for piece in seen:
                if isinstance(piece, int):
                    coded.append((piece,))
                    continue
                known = vocab.known.get(piece)
                if known is None:
                    if len(vocab.known) >= WORDS_KEPT:
                        vocab.known.clear()
                    known = vocab.known[piece] = vocab.word(piece)
                coded.append(known)
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            pool = np.fromiter((t for c in coded for t in c), np.int32, int(sizes.sum()))
            first = np.cumsum(sizes) - sizes
            places = np.fromiter((n for row in rows for n in row), np.int64, sum(map(len, rows)))
            values = gather(pool, first[places], sizes[places])
            upto = np.concatenate(([0], np.cumsum(sizes[places])))
            ends = upto[np.cumsum([0, *map(len, rows)])]
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, column], names=[*part.schema.names, ids]
            )

    return rows.mapInArrow(work, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the column ``text``, the tokens of ``ids`` joined with one space."""
    name = send(encoded.sparkSession, path)
    rows = encoded.drop(text)
    schema = rows.withColumn(text, F.lit(None).cast("string")).schema

    def work(batches):
        with open(SparkFiles.get(name), encoding="utf-8") as file:
            names = [f"{n} ".encode() for n in token_names(json.load(file))]
        pool = np.frombuffer(b"".join(names), np.uint8)
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        first = np.cumsum(sizes) - sizes
        for batch in batches:
            lengths = batch.column(ids).value_lengths().fill_null(0).to_numpy()
            step, row = 1 << 19, 0
            upto = np.cumsum(lengths)
            while row < batch.num_rows:
                base = upto[row - 1] if row else 0
                stop = max(row + 1, int(np.searchsorted(upto, base + step, "right")))
                part = batch.slice(row, stop - row)
                tokens = part.column(ids).flatten().to_numpy(zero_copy_only=False)
                joined = gather(pool, first[tokens], sizes[tokens]).tobytes()
                ends = np.concatenate(([0], np.cumsum(sizes[tokens])))
                edge = ends[np.concatenate(([0], upto[row:stop] - base))].tolist()
                texts = [joined[a : max(a, b - 1)].decode() for a, b in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())],
                    names=[*part.schema.names, text],
                )
                row = stop

    return rows.mapInArrow(work, schema)
