"""Exact top-k search by inner product with a bit-sliced index.

Vectors are quantised to whole numbers and dealt into blocks. A block's index holds, for every component, the
bits of its rows' values as bitmaps over the rows (slices). A query's scores are added up slice by slice with
bitmap arithmetic (three bitmaps of one weight become a sum and a carry), for all rows of the block at once; the
top rows are selected from the most significant slice of the scores downward, and boundary rows, which are then
equal in score, go by the least vec_id. Blocks and groups of queries meet in cells; the best of the cells are
merged by a window for each query.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do rows without
vec_id; an empty vector scores 0; components that the shorter of two vectors lacks count 0; repeated rows are rows,
a query's own row alone is left out; scores beyond 64 bits wrap. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import slices, stored, table

#: Rows of a block and queries of a group, about.
BLOCK, GROUP = 8192, 8192


class Index:
    """The slices of a block. ``values``: rows by components, whole numbers."""

    def __init__(self, values: np.ndarray):
        n, dims = values.shape
        self.values, self.n = values, n
        self.words = max(1, -(-n // 64))
        self.low = values.min(axis=0) if n else np.zeros(dims, np.int64)
        above = values.astype(np.uint64) - self.low.astype(np.uint64)
        self.bits = np.array([int(x).bit_length() for x in above.max(axis=0)] if n else [0] * dims, np.int64)
        self.first = np.cumsum(self.bits) - self.bits
        total = int(self.bits.sum())
        plain = np.zeros((total, self.words), np.uint64)
        for d in range(dims):
            for b in range(self.bits[d]):
                plain[self.first[d] + b] = self.bitmap((above[:, d] >> np.uint64(b)) & np.uint64(1))
        #: Slices, then their complements.
        self.slices = np.concatenate([plain, ~plain])
        self.total = total
        self.exists = self.bitmap(np.ones(n))

    def bitmap(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(flags.astype(np.uint8), bitorder="little")
        out[: len(packed)] = packed
        return out.view("<u8").astype(np.uint64)

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of every row's score (plus a constant of the query), least significant first."""
        size = np.abs(query)
        dims, places = np.nonzero((size[:, None] >> np.arange(max(1, int(size.max(initial=0)).bit_length()))) & 1)
        n = self.bits[dims]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        weight = np.repeat(places, n) + at
        which = np.repeat(self.first[dims] + np.where(query[dims] < 0, self.total, 0), n) + at
        order = np.argsort(weight, kind="stable")
        cuts = np.searchsorted(weight[order], np.arange(weight.max(initial=-1) + 2))
        out, carry, w = [], [], 0
        while w + 1 < len(cuts) or carry:
            own = [self.slices[which[order[cuts[w] : cuts[w + 1]]]]] if w + 1 < len(cuts) else []
            column = np.concatenate([*own, *carry]) if own or carry else np.zeros((0, self.words), np.uint64)
            carry = []
            while len(column) > 2:
                k = len(column) // 3
                x, y, z = column[:k], column[k : 2 * k], column[2 * k : 3 * k]
                half = x ^ y
                carry.append((x & y) | (half & z))
                column = np.concatenate([half ^ z, column[3 * k :]])
            if len(column) == 2:
                carry.append(column[:1] & column[1:])
                column = column[:1] ^ column[1:]
            out.append(column[0] if len(column) else np.zeros(self.words, np.uint64))
            w += 1
        return out

    def top(self, query: np.ndarray, k: int, without: int = -1) -> np.ndarray:
        """The numbers of the ``k`` best rows; of rows with equal scores, those that come first."""
        equal, sure, n = self.exists.copy(), np.zeros(self.words, np.uint64), 0
        if without >= 0:
            equal[without // 64] &= ~(np.uint64(1) << np.uint64(without % 64))
        for part in reversed(self.scores(query)):
            upper = equal & part
            more = int(np.bitwise_count(upper).sum())
            if n + more > k:
                equal = upper
            else:
                sure, n, equal = sure | upper, n + more, equal & ~part
                if n == k:
                    break
        rows = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.astype("<u8").view(np.uint8), bitorder="little"))
        return np.concatenate([rows(sure), rows(equal)[: k - n]])


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows, the shorter ones filled with 0."""
    ends = column.offsets.to_numpy()
    flat, lens = column.values.to_numpy(zero_copy_only=False), np.diff(ends)
    out = np.zeros((len(column), max(1, int(lens.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lens[:, None]] = flat[ends[0] : ends[-1]]
    return out


def wide(values: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(values, ((0, 0), (0, max(0, dims - values.shape[1]))))


FOUND = "query_row long, query_id long, vec_id long, row long, score long"


def search(k: int):
    """Rows (cell, is_query, row, vec_id, values) of a cell together, its block first in order of vec_id."""

    def run(it):
        cell, parts, index, ids, numbers = None, [], None, None, None
        for batch in slices(it, 2048, 8 << 20, "values"):
            start = 0
            cells, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            while start < batch.num_rows:
                same = (cells[start:] == cells[start]) & (kinds[start:] == kinds[start])
                stop = start + (int(np.argmin(same)) if not same.all() else len(same))
                some = batch.slice(start, stop - start)
                if cells[start] != cell:
                    cell, parts, index = cells[start], [], None
                if not kinds[start]:
                    parts.append(some)
                elif parts or index is not None:
                    if index is None:
                        numbers = np.concatenate([p.column(2).to_numpy() for p in parts])
                        ids = np.concatenate([p.column(3).to_numpy() for p in parts])
                        blocks = [matrix(p.column(4)) for p in parts]
                        index, parts = Index(np.concatenate([wide(b, max(x.shape[1] for x in blocks)) for b in blocks])), []
                    at = {int(r): j for j, r in enumerate(numbers)}
                    queries = matrix(some.column(4))
                    if queries.shape[1] > index.values.shape[1]:
                        index = Index(wide(index.values, queries.shape[1]))
                    queries, out = wide(queries, index.values.shape[1]), []
                    for row, ident, query in zip(some.column(2).to_pylist(), some.column(3).to_pylist(), queries):
                        best = index.top(query, k, at.get(row, -1))
                        out += zip([row] * len(best), [ident] * len(best), ids[best].tolist(), numbers[best].tolist(), (index.values[best] @ query).tolist())
                    columns = zip(*out) if out else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], [f.split()[0] for f in FOUND.split(", ")])
                start = stop

    return run


def quantised(embedding: Column) -> Column:
    """floor(256 x) of each component; null where a component is missing or not finite."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~F.coalesce(odd, F.lit(True)), F.transform(embedding, lambda x: F.floor(x.cast("double") * 256)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows of each row that ``is_query`` holds for."""
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), quantised(F.col(vector_col)).alias("values"))
    rows = stored(source.filter("vec_id IS NOT NULL AND values IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, groups = max(1, -(-n // block)), max(1, -(-asked // group))
    deal = lambda many, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(many))
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    side = rows.select((deal(blocks, 1) * groups).alias("base"), "row", "vec_id", "values").select("*", each(groups).alias("other")).select((F.col("base") + F.col("other")).alias("cell"), F.lit(0).alias("is_query"), "row", "vec_id", "values")
    asks = rows.filter("asks").select(deal(groups, 2).alias("base"), "row", "vec_id", "values").select("*", each(blocks).alias("other")).select((F.col("other") * groups + F.col("base")).alias("cell"), F.lit(1).alias("is_query"), "row", "vec_id", "values")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = side.union(asks).repartition(parts, "cell").sortWithinPartitions("cell", "is_query", "vec_id", "row")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = cells.mapInArrow(search(k), FOUND).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, a.own AS own, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.own <> b.own
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
