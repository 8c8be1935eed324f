"""Exact top-k rows by inner product for a stated set of query rows.

A vector is a sparse row of terms: its place is the term, the integer there the weight, zeros are
no entries. Every query meets every row, in cells: queries and rows are dealt into blocks of about
``CELL_WEIGHTS`` weights by a hash of their row number (so no id, however frequent, fills a block),
and a cell is one block of each. Inside a cell the rows become postings, term by term, and each
term scatters the products of its query weights and posting weights into a dense array of scores.
A partition by the k-th score picks the best of each chunk; the cells' winners are merged by one
window that keeps k rows of a query before its shuffle. Nothing else than blocks and winners moves,
and a task holds one cell.

Defined results: rows whose vector is null or holds a null, NaN or infinity take no part; an empty
vector has no terms and scores zero, and vectors of different length share the terms both have. A
row is never its own candidate, its copies are; queries of one id are answered one by one. Rows of
null id are candidates, after all others of the same score. Queries without a candidate give no
rows. Sums are 64-bit integers: exact wherever the score fits a long.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill.sources.staging import stage

CELL_WEIGHTS = 1 << 18
#: Queries and rows of one dense score array.
QUERY_CHUNK, ROW_CHUNK = 256, 2048


def integer_vectors(
    vectors: DataFrame, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``id, weights``: each component scaled and floored, rows that take no part left out."""
    whole = F.forall(
        F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    picked = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")
    )
    return picked.filter(F.col("v").isNotNull() & whole).select(
        "id", F.transform("v", lambda x: F.floor(x * float(scale))).alias("weights")
    )


class _Rows:
    """Rows of a table with their weights as (row, term, weight) entries."""

    def __init__(self, table: pa.Table):
        self.row = table.column("row").to_numpy()
        ids = table.column("id")
        self.known = ids.is_valid().to_numpy()
        self.id = ids.fill_null(0).to_numpy()
        lists = table.column("weights").combine_chunks()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        weights = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        self.terms = int(sizes.max(initial=0))
        place = np.repeat(np.arange(len(sizes)), sizes)
        term = np.arange(len(weights)) - np.repeat(offsets[:-1] - offsets[0], sizes)
        there = np.flatnonzero(weights)
        self.entries = place[there], term[there], weights[there]
        self.largest = max(abs(int(weights.max(initial=0))), abs(int(weights.min(initial=0))))

    def postings(self, first: int, last: int, kind) -> dict:
        """Per term the places (from ``first``) and weights of rows ``first`` to ``last - 1``."""
        place, term, weight = self.entries
        a, b = np.searchsorted(place, (first, last))
        order = np.argsort(term[a:b], kind="stable")
        named, starts = np.unique(term[a:b][order], return_index=True)
        places = np.split(place[a:b][order] - first, starts[1:])
        weights = np.split(weight[a:b][order].astype(kind), starts[1:])
        return {t: (p, w) for t, p, w in zip(named.tolist(), places, weights) if len(p)}


def _side(places: np.ndarray, weights: np.ndarray, size: int):
    """Index and weights of one side of a scatter; a well filled list becomes a dense row."""
    if 4 * len(places) < size:
        return places, weights
    dense = np.zeros(size, weights.dtype)
    dense[places] = weights
    return slice(None), dense


def accumulated(queries: dict, rows: dict, shape: tuple[int, int], kind) -> np.ndarray:
    """Scores of all queries and rows, one term after another."""
    scores = np.zeros(shape, kind)
    product = np.empty(shape, kind)
    for term in queries.keys() & rows.keys():
        q, x = _side(*queries[term], shape[0])
        r, y = _side(*rows[term], shape[1])
        if isinstance(q, slice) and isinstance(r, slice):
            np.multiply(x[:, None], y[None, :], out=product)
            scores += product
        elif isinstance(q, slice) or isinstance(r, slice):
            scores[q, r] += np.multiply.outer(x, y)
        else:
            scores[np.ix_(q, r)] += np.multiply.outer(x, y)
    return scores


def _first(query: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` highest scores, ties by ``order``."""
    ranked = np.lexsort((order, ~score, query))
    owner = query[ranked]
    fresh = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else owner > 0
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(owner)), 0))
    return ranked[np.arange(len(owner)) - start < k]


def best_of_cell(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """``query, query_id, id, score`` of the best ``k`` rows of each query."""
    rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])  # nulls come last
    asked, held = _Rows(queries), _Rows(rows)
    bound = asked.largest * held.largest * min(asked.terms, held.terms)
    with np.errstate(over="ignore"):
        kind = np.int32 if bound < 1 << 31 else np.int64
        found: list[tuple] = []
        chunks = [
            (b, min(b + ROW_CHUNK, len(held.row))) for b in range(0, len(held.row), ROW_CHUNK)
        ]
        postings = [held.postings(b, e, kind) for b, e in chunks]
        for a in range(0, len(asked.row), QUERY_CHUNK):
            z = min(a + QUERY_CHUNK, len(asked.row))
            own = asked.postings(a, z, kind)
            for (b, e), listed in zip(chunks, postings):
                scores = accumulated(own, listed, (z - a, e - b), kind)
                itself = asked.row[a:z, None] == held.row[None, b:e]
                scores[itself] = np.iinfo(kind).min
                cut = max(0, e - b - k)
                least = np.partition(scores, cut, axis=1)[:, cut]
                q, r = np.nonzero((scores >= least[:, None]) & ~itself)
                value = scores[q, r].astype(np.int64)
                kept = _first(q, value, r, k)
                found.append((q[kept] + a, r[kept] + b, value[kept]))
    q, r, value = (np.concatenate(x) for x in zip(*found))
    kept = _first(q, value, r, k)
    q, r = q[kept], r[kept]
    return pa.table(
        {
            "query": asked.row[q],
            "query_id": pa.array(asked.id[q], mask=~asked.known[q]),
            "id": pa.array(held.id[r], mask=~held.known[r]),
            "score": value[kept],
        }
    )


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` rows of highest inner product for each query.

    ``vectors`` has ``id, weights``; ``is_query`` says which of its rows are queries. Ties go to
    the smaller id.
    """
    numbered = stage(
        vectors.select("id", "weights", F.coalesce(is_query, F.lit(False)).alias("asks"))
        .withColumn("row", F.monotonically_increasing_id()),
        "topk-rows",
    )
    size = numbered.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("asks").alias("queries"),
        F.sum(F.size("weights")).alias("weights"),
    ).first()
    per_block = max(1, CELL_WEIGHTS * max(1, size["rows"]) // max(1, size["weights"] or 0))
    query_blocks = -(-size["queries"] // per_block) or 1
    row_blocks = -(-size["rows"] // per_block) or 1
    dealt = F.xxhash64("row")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(*[F.lit(n).cast("long") for n in (0, blocks - 1)]))

    queries = numbered.filter("asks").select(
        "row", "id", "weights",
        F.pmod(dealt, F.lit(query_blocks)).alias("q"),
        every(row_blocks).alias("r"),
    )
    rows = numbered.select(
        "row", "id", "weights",
        every(query_blocks).alias("q"),
        F.pmod(dealt, F.lit(row_blocks)).alias("r"),
    )
    schema = "query long, query_id long, id long, score long"
    empty = pa.table({n: pa.array([], pa.int64()) for n in ("query", "query_id", "id", "score")})

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_of_cell(left, right, k) if left.num_rows and right.num_rows else empty

    found = queries.groupBy("q", "r").cogroup(rows.groupBy("q", "r")).applyInArrow(work, schema)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def divisible_sql(divisor: int = 50, k: int = 5, scale: int = 256) -> str:
    """DuckDB SQL of ``top_k`` over ``embeddings`` for the ids divisible by ``divisor``."""
    return f"""
WITH kept AS (
  SELECT vec_id, row_number() OVER () AS line,
         list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.line, c.vec_id,
         CASE WHEN len(q.w) = 0 THEN 0 ELSE list_inner_product(q.w, c.w) END::BIGINT AS score
  FROM kept q JOIN kept c ON q.line <> c.line WHERE q.vec_id % {divisor} = 0
), ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY line ORDER BY score DESC, vec_id ASC NULLS LAST)::INTEGER AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}
"""
