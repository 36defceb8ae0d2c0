"""Exact search over vectors: blocks of rows against blocks of queries, each pair as one matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.vectors import dot
from tamis.operators.lexical import top
from tamis.session import cut, small

#: Vectors in a block of queries, and in a block of rows.
BLOCK, ROWS = 4_096, 16_384


def _blocks(df: DataFrame, key: str, vector: str, size: int, names: tuple[str, str]) -> DataFrame:
    """`df` as blocks of at most `size` vectors: their keys and the matrix as bytes. Made where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        vecs: list = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([np.concatenate(keys)], pa.list_(pa.int64())), pa.array([np.concatenate(vecs).tobytes()], pa.binary())], list(names))
            keys.clear()
            vecs.clear()
            return out

        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                if keys and sum(map(len, keys)) + len(part) > size:
                    yield flush()
                keys.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                vecs.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        if keys:
            yield flush()

    return df.select(F.col(key).cast("bigint"), vector).mapInArrow(run, f"{names[0]} array<bigint>, {names[1]} binary")


def search(rows: DataFrame, queries: DataFrame, key: str, vector: str, query: str, query_vector: str, k: int = 60, itself: bool = True, block: int = BLOCK) -> DataFrame:
    """`query`, `key`, `cos`, `rang`: the `k` rows of the largest inner product for each query, exactly; ties by key.

    Vectors are taken as normalised. Rows and queries become blocks where they are, every block of queries (at most `block`)
    meets every block of rows in some task, and of each such task only `k` candidates a query go on; none passes through
    the driver. If the queries' blocks are too large to be broadcast, the tasks are the pairs of their partitions. Rows and
    queries with a null key or vector, or one of another length than the first query's, are left out. `itself` says whether a
    query may find the row of its own key.
    """
    first = queries.where(F.col(query_vector).isNotNull() & F.col(query).isNotNull()).select(query, query_vector)
    shape = first.select(F.size(query_vector).alias("n")).first()
    if shape is None or not shape.n:
        return rows.sparkSession.createDataFrame([], f"`{query}` bigint, `{key}` bigint, cos double, rang int")
    whole = lambda df, k, v: df.where(F.col(k).isNotNull() & (F.size(v) == shape.n) & ~F.exists(v, lambda x: x.isNull()))
    asked = small(cut(_blocks(whole(first, query, query_vector), query, query_vector, block, ("q", "x"))))
    pairs = _blocks(whole(rows, key, vector), key, vector, ROWS, ("i", "y")).crossJoin(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, list[np.ndarray]] = {}
        for batch in batches:
            for q, x, i, y in zip(*(batch.column(c) for c in ("q", "x", "i", "y"))):
                ids, keys = np.asarray(q.values), np.asarray(i.values)
                left, right = (np.frombuffer(m.as_py(), np.float64).reshape(-1, shape.n) for m in (x, y))
                s = np.round(left @ right.T, 6) + 0.0
                if not itself:
                    s[ids[:, None] == keys[None, :]] = -np.inf
                held = best.setdefault(ids.tobytes(), [ids, np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)])
                score, of = np.hstack((held[1], s)), np.hstack((held[2], np.broadcast_to(keys, s.shape)))
                order = np.lexsort((of, -score))[:, :k]
                held[1:] = np.take_along_axis(score, order, 1), np.take_along_axis(of, order, 1)
        for ids, score, of in best.values():
            ok = score > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(ids[np.nonzero(ok)[0]], pa.int64()), pa.array(of[ok], pa.int64()), pa.array(score[ok], pa.float64())], [query, key, "cos"])

    return top(pairs.mapInArrow(run, f"`{query}` bigint, `{key}` bigint, cos double"), query, key, "cos", k)


def all_cosines(rows: DataFrame, query_vector: list[float], key: str, vector: str) -> DataFrame:
    """`key`, `cos` of every row with one vector; in the JVM."""
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    return rows.select(key, F.round(dot(F.col(vector), q), 6).alias("cos"))


def margins(rows: DataFrame, query_vector: list[float], key: str, vector: str, relevant: str) -> DataFrame:
    """One row: best relevant less best other (`marge`), the same of the medians (`marge_medianes`), rank of the first relevant."""
    c = rows.select(F.col(relevant).alias("r"), F.round(dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query_vector])), 6).alias("cos"))
    best = F.lit(c.where("r").agg(F.max("cos")).first()[0]).cast("double")
    return c.agg(
        F.round(F.max(F.when(F.col("r"), F.col("cos"))) - F.max(F.when(~F.col("r"), F.col("cos"))), 6).alias("marge"),
        F.round(F.median(F.when(F.col("r"), F.col("cos"))) - F.median(F.when(~F.col("r"), F.col("cos"))), 6).alias("marge_medianes"),
        (F.count_if(F.col("cos") > best) + 1).alias("rang_premier"),
    )


def margins_each(rows: DataFrame, queries: DataFrame, key: str, vector: str, label: str, query: str, query_vector: str, query_label: str) -> DataFrame:
    """`query` and the columns of margins() for each query, over the rows but the query's own key; a row is relevant if it
    has the query's label. The best relevant comes first, by an aggregation that combines before the shuffle; the queries
    are broadcast if they are few."""
    asked = small(cut(queries.where(F.col(query).isNotNull()).select(F.col(query).alias("__q"), F.col(query_vector).alias("__e"), F.col(query_label).alias("__l"))))
    pairs = rows.crossJoin(asked).where(F.col(key).isNull() | (F.col(key) != F.col("__q")))
    c = pairs.select("__q", (F.col(label) == F.col("__l")).alias("r"), F.round(dot(F.col(vector), F.col("__e")), 6).alias("cos"))
    best = small(cut(c.where("r").groupBy("__q").agg(F.max("cos").alias("__best"))))
    yes, no = F.when(F.col("r"), F.col("cos")), F.when(~F.col("r"), F.col("cos"))
    found = c.join(best, "__q", "left").groupBy("__q").agg(
        F.round(F.max(yes) - F.max(no), 6).alias("marge"),
        F.round(F.median(yes) - F.median(no), 6).alias("marge_medianes"),
        (F.count_if(F.col("cos") > F.col("__best")) + 1).alias("rang_premier"),
    )
    return found.withColumnRenamed("__q", query)
