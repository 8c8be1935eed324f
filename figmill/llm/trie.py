"""Prefix trie of conversations: what they share from their start, and totals of every subtree.

A node is a distinct sequence of first turns, its members are the conversations that start with it;
a node is named by its smallest member and its depth, which no other node has. A turn is known by
128 bits of hash of role and text, a sequence of turns by sums of 128 bits over its (place, turn)
hashes, so prefixes of one conversation are running sums: they are taken in blocks of places, with
block offsets, and no task needs a whole conversation.

Subtree totals come from parallel tree contraction. Every round first rakes all leaves (their
totals are final and go to their parents), then compresses chains: of the nodes with one child left
an independent set, chosen by a hash of node and round, is spliced out, and the child remembers on
its edge what the spliced node held. A spliced node's total is known once its child's is, so it is
logged with that child and the difference. Rounds grow with the logarithm of the tree, however deep
it is. At the end the log is followed by pointer doubling, and every contracted node gets its total
back. Each round is a table in the shared folder.

A parent may have any number of children: they are summed by partial aggregates and never joined by
their parent's name, except that parents of ``HOT`` children or more are joined apart, by size.

Defined results: rows without conversation id take no part; null role or text counts as empty;
turns that tie are ordered by their hashes, so the order of the input does not matter; repeated
rows are turns of their own; no conversations, no nodes.
"""

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill.operators.positions import dense_position
from figmill.sources.staging import stage

BLOCK_BITS = 12
HOT = 1 << 16
_LOW = (1 << 32) - 1
_FIRST = -(1 << 63)
_NODE, _KEY = ["conv_id", "depth"], ["depth", "high", "low"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, one, two, n_chars`` of every turn: its place, hashes and length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(_FIRST)).alias("turn"),
        F.xxhash64(role, text).alias("one"),
        F.xxhash64(F.lit("second"), text, role).alias("two"),
        F.length(text).cast("long").alias("n_chars"),
    )
    placed = dense_position(turns, F.col("turn"), ties=("one", "two"), groups=["conv_id"])
    return placed.select("conv_id", "position", "one", "two", "n_chars")


def regrafted(turns: DataFrame, base: Column, kept: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the heads of others: ``(turns, conversations)``.

    Every conversation gets the first ``kept`` turns of the conversation ``base`` (both columns
    over ``conv_id``, ``kept`` at most ``most``), then its own turns after its first ``kept``.
    """
    turns = stage(turns, "trie-turns")
    convs = stage(
        turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select(
            "conv_id", "own", base.alias("base"), kept.cast("long").alias("kept")
        ),
        "trie-conversations",
    )
    heads = turns.filter(F.col("position") < most).withColumnRenamed("conv_id", "base")
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    grafts = convs.filter("kept > 0").join(sizes, "base", "left").select(
        "conv_id", "base", "kept",
        F.least("kept", F.coalesce("there", F.lit(0))).alias("shift"),
    )
    first = grafts.join(heads, "base").filter("position < kept")
    rest = turns.join(
        convs.select("conv_id", "kept").join(
            grafts.select("conv_id", "shift"), "conv_id", "left"
        ),
        "conv_id",
    ).filter("position >= kept")
    moved = F.col("position") - F.col("kept") + F.coalesce("shift", F.lit(0))
    rebuilt = first.select(turns.columns).unionByName(
        rest.withColumn("position", moved).select(turns.columns)
    )
    return rebuilt, convs.select("conv_id")


def _packed(high: str, low: str) -> Column:
    """Two sums of 32-bit parts as one long."""
    return F.shiftleft(F.col(high).bitwiseAND(_LOW), 32).bitwiseOR(F.col(low).bitwiseAND(_LOW))


def prefixes(turns: DataFrame) -> DataFrame:
    """Every prefix of every conversation but the empty one: ``conv_id, depth, high, low, n_chars``,
    with ``up_high, up_low`` of the prefix one turn shorter."""
    hashes = (F.xxhash64("one", "position", "two"), F.xxhash64("two", "position", "one"))
    parts = {
        f"x{n}": F.shiftrightunsigned(hashes[n // 2], 32) if n % 2 == 0 else hashes[n // 2].bitwiseAND(_LOW)
        for n in range(4)
    }
    blocks = turns.select(
        "*", F.shiftright("position", BLOCK_BITS).alias("block"),
        *[c.alias(n) for n, c in parts.items()],
    )
    upto = W.partitionBy("conv_id", "block").orderBy("position").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    sums = blocks.groupBy("conv_id", "block").agg(*[F.sum(n).alias(n) for n in parts])
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ahead = sums.select(
        "conv_id", "block", *[F.sum(n).over(before).alias(f"b{n[1]}") for n in parts]
    ).filter("block > 0")
    running = blocks.withColumns({f"s{n[1]}": F.sum(n).over(upto) for n in parts})
    whole = running.join(stage(ahead, "trie-blocks"), ["conv_id", "block"], "left")
    for n in range(4):
        whole = whole.withColumn(f"s{n}", F.col(f"s{n}") + F.coalesce(f"b{n}", F.lit(0)))
        whole = whole.withColumn(f"u{n}", F.col(f"s{n}") - F.col(f"x{n}"))
    return whole.select(
        "conv_id",
        (F.col("position") + 1).alias("depth"),
        _packed("s0", "s1").alias("high"),
        _packed("s2", "s3").alias("low"),
        _packed("u0", "u1").alias("up_high"),
        _packed("u2", "u3").alias("up_low"),
        "n_chars",
    )


def _parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` (by key) with ``n_children, parent_conv_id``."""
    up = [F.expr("depth - 1").alias("depth"), F.col("up_high").alias("high"), F.col("up_low").alias("low")]
    counts = nodes.filter("depth > 0").select(*up).groupBy(_KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(
        nodes.join(counts, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))),
        "trie-nodes",
    )
    named = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"),
        F.col("high").alias("up_high"),
        F.col("low").alias("up_low"),
        F.col("conv_id").alias("parent_conv_id"),
        "n_children",
    )
    key = ["depth", "up_high", "up_low"]
    hot = stage(named.filter(F.col("n_children") >= HOT).drop("n_children"), "trie-hot")
    some = nodes.join(hot, key, "left")
    rest = some.filter("parent_conv_id IS NULL").drop("parent_conv_id")
    cool = named.filter(F.col("n_children") < HOT).drop("n_children")
    return some.filter("parent_conv_id IS NOT NULL").unionByName(rest.join(cool, key, "left"))


def _streamed_digests(batches):
    """One digest per key of rows ``key..., text`` that come in order, joined by commas."""
    key, state = None, None
    for batch in batches:
        keys, done = list(zip(*[batch.column(n).to_pylist() for n in _KEY])), []
        for own, text in zip(keys, batch.column("text").to_pylist()):
            if own == key:
                state.update(b",")
            else:
                if state is not None:
                    done.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256()
            state.update(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*done)], names=[*_KEY, "ends_sha256"]
            )
    if state is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([v]) for v in (*key, state.hexdigest())], names=[*_KEY, "ends_sha256"]
        )


def end_digests(last: DataFrame) -> DataFrame:
    """SHA-256 of the sorted, comma-joined ids of the conversations that end at each key.

    Ids are joined natively in ranges of 4,096; the digest, which is sequential by its nature,
    streams over the ranges' texts and holds one at a time.
    """
    cell = F.shiftright("conv_id", 12).alias("cell")
    texts = last.groupBy(*_KEY, cell).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    texts = texts.select(
        *_KEY, "cell", F.array_join(F.col("ids").cast("array<string>"), ",").alias("text")
    )
    dealt = texts.repartition(*_KEY).sortWithinPartitions(*_KEY, "cell").drop("cell")
    return dealt.mapInArrow(
        _streamed_digests, "depth long, high long, low long, ends_sha256 string"
    )


def contracted(tree: DataFrame, weights: list[str]) -> DataFrame:
    """``conv_id, depth`` and the sums of ``weights`` over each node's subtree.

    ``tree`` has ``conv_id, depth, parent_conv_id, n_children`` and the weights, as longs; the root
    has no parent.
    """
    edge = [f"edge_{w}" for w in weights]
    alive = stage(
        tree.select(
            *_NODE,
            F.col("parent_conv_id").alias("up_conv"),
            (F.col("depth") - 1).alias("up_depth"),
            F.col("n_children").alias("children"),
            *weights,
            *[F.lit(0).cast("long").alias(e) for e in edge],
        ),
        "trie-alive",
    )
    raked, spliced, turn = [], [], 0
    while not alive.isEmpty():
        turn += 1
        leaf = F.col("children") == 0
        gains = alive.filter("up_conv IS NOT NULL").groupBy("up_conv", "up_depth").agg(
            F.count_if(leaf).alias("leaves"),
            *[
                F.sum(F.when(leaf, F.col(w) + F.col(e)).otherwise(0)).alias(f"gain_{w}")
                for w, e in zip(weights, edge)
            ],
            F.max(F.when(~leaf, F.struct(*_NODE))).alias("only"),
        ).withColumnsRenamed({"up_conv": "conv_id", "up_depth": "depth"})
        marked = stage(
            alive.join(gains, _NODE, "left").select(
                *_NODE, "up_conv", "up_depth", "children", *edge, "only",
                (F.col("children") - F.coalesce("leaves", F.lit(0))).alias("left"),
                *[(F.col(w) + F.coalesce(f"gain_{w}", F.lit(0))).alias(w) for w in weights],
            ),
            "trie-raked",
        )
        raked.append(marked.filter("children = 0").select(*_NODE, *weights))
        own, above, below = (
            F.xxhash64(F.lit(turn), *names)
            for names in (_NODE, ["up_conv", "up_depth"], ["only.conv_id", "only.depth"])
        )
        goes = (
            (F.col("left") == 1) & F.col("up_conv").isNotNull() & F.col("only").isNotNull()
            & (own > above) & (own > below)
        )
        goes = F.coalesce(goes, F.lit(False))
        rest = marked.filter("children > 0")
        chains = rest.filter(goes).select(
            F.col("only.conv_id").alias("conv_id"),
            F.col("only.depth").alias("depth"),
            F.col("conv_id").alias("gone_conv"),
            F.col("depth").alias("gone_depth"),
            F.col("up_conv").alias("next_conv"),
            F.col("up_depth").alias("next_depth"),
            *[F.col(w).alias(f"held_{w}") for w in weights],
            *[F.col(e).alias(f"held_{e}") for e in edge],
        )
        joined = stage(
            rest.filter(~goes).join(chains, _NODE, "left").select(
                *_NODE,
                F.coalesce("next_conv", "up_conv").alias("up_conv"),
                F.coalesce("next_depth", "up_depth").alias("up_depth"),
                F.col("left").alias("children"),
                *weights,
                *[
                    (F.col(e) + F.coalesce(F.col(f"held_{w}") + F.col(f"held_{e}"), F.lit(0))).alias(e)
                    for w, e in zip(weights, edge)
                ],
                "gone_conv",
                "gone_depth",
                *[(F.col(e) + F.col(f"held_{w}")).alias(f"more_{w}") for w, e in zip(weights, edge)],
            ),
            "trie-alive",
        )
        more = [f"more_{w}" for w in weights]
        spliced.append(
            joined.filter("gone_conv IS NOT NULL").select(
                F.col("gone_conv").alias("conv_id"), F.col("gone_depth").alias("depth"),
                F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), *more,
            )
        )
        alive = joined.drop("gone_conv", "gone_depth", *more)
    if not raked:
        return tree.select(*_NODE, *weights)
    return _expanded(
        stage(reduce(DataFrame.unionByName, raked), "trie-totals"),
        stage(reduce(DataFrame.unionByName, spliced), "trie-log"),
        weights,
    )


def _expanded(raked: DataFrame, log: DataFrame, weights: list[str]) -> DataFrame:
    """Totals of raked nodes and, through the log, of the spliced ones."""
    to, more = ["to_conv", "to_depth"], [f"more_{w}" for w in weights]
    far = {"to_conv": "far_conv", "to_depth": "far_depth", **{m: f"far_{m}" for m in more}}
    while True:
        onward = log.withColumnsRenamed({**far, "conv_id": "to_conv", "depth": "to_depth"})
        step = log.join(onward, to, "left")
        log = stage(
            step.select(
                *_NODE,
                F.coalesce("far_conv", "to_conv").alias("to_conv"),
                F.coalesce("far_depth", "to_depth").alias("to_depth"),
                *[(F.col(m) + F.coalesce(f"far_{m}", F.lit(0))).alias(m) for m in more],
                F.col("far_conv").isNotNull().alias("moved"),
            ),
            "trie-log",
        )
        if log.filter("moved").isEmpty():
            break
        log = log.drop("moved")
    ends = raked.withColumnsRenamed({"conv_id": "to_conv", "depth": "to_depth"})
    back = log.join(ends, to).select(
        *_NODE, *[(F.col(w) + F.col(m)).alias(w) for w, m in zip(weights, more)]
    )
    return raked.unionByName(back)


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """All nodes of the trie: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    ``turns`` has the columns of ``ordered_turns``, ``conversations`` every ``conv_id`` once, those
    without turns included. ``saved_tokens`` sums, over the subtree, the code points of a node's
    last text times its members but one.
    """
    starts = stage(prefixes(turns), "trie-prefixes")
    nodes = starts.groupBy(_KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("n_chars").alias("n_chars"),
        F.min("up_high").alias("up_high"),
        F.min("up_low").alias("up_low"),
    )
    zero = F.lit(0).cast("long")
    root = conversations.agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")
    ).filter("n_convs > 0").select(
        *[zero.alias(c) for c in _KEY], "conv_id", "n_convs", zero.alias("n_chars"),
        F.lit(None).cast("long").alias("up_high"), F.lit(None).cast("long").alias("up_low"),
    )
    tree = stage(_parents(nodes.unionByName(root)), "trie-tree")
    totals = contracted(
        tree.withColumns(
            {
                "n_leaves": (F.col("n_children") == 0).cast("long"),
                "saved_tokens": (F.col("n_convs") - 1) * F.col("n_chars"),
            }
        ),
        ["n_leaves", "saved_tokens"],
    )
    deepest = F.max(F.struct(*_KEY))
    last = conversations.join(
        starts.groupBy("conv_id").agg(deepest.alias("last")), "conv_id", "left"
    ).select("conv_id", *[F.coalesce(f"last.{c}", zero).alias(c) for c in _KEY])
    digests = end_digests(last)
    return (
        tree.join(digests, _KEY, "left")
        .join(totals, _NODE)
        .select(
            *_NODE, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def rebuilt_sql(period: int = 100, span: int = 6) -> str:
    """DuckDB SQL of the trie over ``conversations`` rebuilt on the heads of every ``period``-th.

    The checksum runs bit by bit, ancestors are read off each node's smallest member.
    """
    return f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, c - c % {period} AS b, xor(list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''),
      lambda ch: list_transform(range(8), lambda k: (ascii(ch)::BIGINT >> k::BIGINT) & 1)))),
    lambda s, bit: CASE WHEN xor(s, bit) & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END
  ), 4294967295) % {span} AS h
  FROM (SELECT DISTINCT c FROM t)
), heads AS (
  SELECT ids.c, t.i, t.r, t.x FROM ids JOIN t ON t.c = ids.b WHERE t.i < ids.h
), seq AS (
  SELECT * FROM heads
  UNION ALL
  SELECT t.c, t.i - h + coalesce(n, 0), r, x
  FROM t JOIN ids USING (c) LEFT JOIN (SELECT c, count(*) AS n FROM heads GROUP BY c) USING (c)
  WHERE t.i >= h
), members AS (
  SELECT c, i + 1 AS d, length(x) AS size,
         list(struct_pack(r := r, x := x)) OVER (PARTITION BY c ORDER BY i) AS prefix FROM seq
  UNION ALL
  SELECT c, 0, 0, [] FROM ids
), named AS (
  SELECT c, d, size, min(c) OVER (PARTITION BY prefix) AS node FROM members
), nodes AS (
  SELECT node, d, count(*) AS n_convs, min(size) AS size FROM named GROUP BY node, d
), tree AS (
  SELECT n.*, p.node AS up FROM nodes n LEFT JOIN named p ON p.c = n.node AND p.d = n.d - 1
), kids AS (
  SELECT up AS node, d - 1 AS d, count(*) AS n_children FROM tree WHERE d > 0 GROUP BY up, d
), whole AS (
  SELECT tree.*, coalesce(n_children, 0) AS n_children FROM tree LEFT JOIN kids USING (node, d)
), sums AS (
  SELECT a.node, a.d, sum((w.n_children = 0)::BIGINT)::BIGINT AS n_leaves,
         sum((w.n_convs - 1) * w.size)::BIGINT AS saved_tokens
  FROM whole w JOIN named a ON a.c = w.node AND a.d <= w.d GROUP BY a.node, a.d
), ends AS (
  SELECT node, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
  FROM named SEMI JOIN (SELECT c, max(d) AS d FROM named GROUP BY c) USING (c, d) GROUP BY node, d
)
SELECT node AS conv_id, d::BIGINT AS depth, up AS parent_conv_id, n_convs, n_children, n_leaves,
       saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM whole JOIN sums USING (node, d) LEFT JOIN ends USING (node, d)
"""
