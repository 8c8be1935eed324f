"""Admissibility of every token given the tokens before it."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figmill import constants as C
from figmill.functions.hashing import entries

_OPENERS = frozenset(f"\\begin{{{name}}}" for name in C.ROOT_ENVIRONMENTS)
_CLOSERS = frozenset(f"\\end{{{name}}}" for name in C.ROOT_ENVIRONMENTS)
_FIRST = _OPENERS | frozenset(C.FAMILY_TOKENS)
_CLOSED_BY = {")": "(", "]": "[", "}": "{"}
# Tokens that never change the state.
_SILENT = frozenset(("<PAD>", "<BOS>", "<UNK>"))
# Apart from commands, the only tokens that change more than the last token.
_MARKS = frozenset(("(", ")", "[", "]", "{", "}", ";", "<EOS>")) | _SILENT
_BROKEN = "array<struct<pos: int, token: string, rule: string>>"


def _rule(token, emitted, last, closed, statements, pending, depth) -> str | None:
    """The rule a token breaks in the state its prefix left, or none."""
    if token in ("<PAD>", "<UNK>"):
        return "reserved_token"
    if emitted == 0:
        return None if token in _FIRST else "opener_first"
    if emitted == 1 and last.startswith("<FAM:"):
        return None if token in _OPENERS else "opener_after_family"
    if closed:
        return None if token == "<EOS>" else "only_eos_after_end"
    if token == "<EOS>":
        return "eos_before_end"
    if token in _OPENERS:
        return "repeated_opener"
    if token in _CLOSED_BY and depth[_CLOSED_BY[token]] == 0:
        return "close_at_depth_zero"
    if token in ("(", "[") and depth["("] > 0:
        return "opened_inside_paren"
    if token == "[" and depth["["] > 0:
        return "opened_inside_bracket"
    is_open = any(depth.values())
    if token == ";" and is_open:
        return "semicolon_inside_delimiters"
    if token == ";" and last == ";":
        return "empty_statement"
    if token in _CLOSERS and (is_open or pending or statements == 0):
        return "end_not_allowed"
    return None


def broken_in(tokens: list, plain: list) -> list[tuple]:
    """``(pos, token, rule)`` of the tokens that break a rule. ``plain`` tokens, half of all, are
    numbers, words and operators: inside a picture they break none."""
    emitted, last, closed, statements, pending = 0, "", False, 0, False
    depth, broken = {"(": 0, "[": 0, "{": 0}, []
    for pos, token in enumerate(tokens):
        if plain[pos] and emitted > 1 and not closed:
            last = token
            continue
        if token is None:  # may have been anything: no rule of the start or of statements holds
            emitted, statements = max(emitted, 2), max(statements, 1)
            continue
        rule = _rule(token, emitted, last, closed, statements, pending, depth)
        if rule is not None:
            broken.append((pos, token, rule))
        if token in _SILENT:
            continue
        emitted, last = emitted + 1, token
        if token in depth:
            depth[token] += 1
        elif token in _CLOSED_BY:
            depth[_CLOSED_BY[token]] = max(0, depth[_CLOSED_BY[token]] - 1)
        elif token == ";":
            statements, pending = statements + 1, False
        elif token.startswith("\\end{"):
            closed = True
        elif token.startswith("\\") and token != "\\x" and token not in _OPENERS:
            pending = True
    return broken


def broken_batch(batch: pa.Array) -> pa.Array:
    """:func:`broken_in` of every row of a batch; null for null rows."""
    values, offsets = entries(batch)
    coded = values.cast(pa.string()).dictionary_encode()
    words = [*coded.dictionary.to_pylist(), None]  # the last one stands for nulls
    quiet = [w is not None and w not in _MARKS and not w.startswith("\\") for w in words]
    codes = pc.fill_null(coded.indices, len(words) - 1).to_pylist()
    tokens, plain = [words[c] for c in codes], [quiet[c] for c in codes]
    found = [broken_in(tokens[i:j], plain[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    flat = [entry for row in found for entry in row]
    at, named, rules = ([entry[n] for entry in flat] for n in range(3))
    upto = np.concatenate(([0], np.cumsum([len(row) for row in found]))).astype(np.int32)
    entry = pa.StructArray.from_arrays(
        [pa.array(at, pa.int32()), pa.array(named, pa.string()), pa.array(rules, pa.string())],
        names=["pos", "token", "rule"],
    )
    return pa.ListArray.from_arrays(pa.array(upto), entry, mask=pc.is_null(batch))


def broken_rules(tokens: Column) -> Column:
    """``array<struct<pos, token, rule>>`` of the tokens (after BOS) that break a rule.

    One pass over the tokens of a sample, in its own row: nothing is exploded, sorted or
    shuffled, and a sample costs time linear in its length.
    """

    @F.arrow_udf(_BROKEN)
    def broken(batch: pa.Array) -> pa.Array:
        return broken_batch(batch)

    return broken(tokens)


def admissibility(sequences: DataFrame, keep: list[str], column: str = "tokens") -> DataFrame:
    """One row per broken rule: ``keep, pos, token, rule``."""
    return sequences.select(*keep, F.inline(broken_rules(F.col(column))))


def violations_by_rule(sequences: DataFrame, column: str = "tokens") -> DataFrame:
    """Broken rules with the tokens and samples they hit."""
    rules = F.transform(broken_rules(F.col(column)), lambda b: b["rule"])
    per_sample = sequences.select(rules.alias("_rules")).select(
        "_rules", F.explode(F.array_distinct("_rules")).alias("rule")
    )
    hits = F.size(F.filter("_rules", lambda r: r == F.col("rule")))
    return per_sample.groupBy("rule").agg(
        F.sum(hits).alias("tokens"), F.count(F.lit(1)).alias("samples")
    )
