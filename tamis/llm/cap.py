"""Problem 5: at most so many records per contributor, the best ones by a score.

The rows are sorted globally by contributor and descending score: a range partitioning and a sort in each partition. The
number of rows per partition, summed up to each, gives every row its exact position. Its contributor's first position is
in the same partition, or, for the contributor a partition begins with, in one before; the driver works that out from one
summary row per partition. A row is kept while its position less that of its contributor's first row is below the cap.
A contributor with a third of all rows merely lies across more partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators.delivery import first_delivery
from tamis.operators.fusion import doc_key
from tamis.session import cut, small


def _changes(table: pa.Table, by: list[str], last: list | None) -> np.ndarray:
    """True where a row's contributor is another than that of the row before; `last` is the contributor before the first."""
    n = table.num_rows
    new = np.zeros(n, bool)
    for k, c in enumerate(by):
        col = table.column(c).combine_chunks()
        prev = pa.concat_arrays([pa.array([None if last is None else last[k]], col.type), col.slice(0, n - 1)])
        same = pc.fill_null(pc.equal(col, prev), False)
        new |= ~np.asarray(pc.or_(same, pc.and_(pc.is_null(col), pc.is_null(prev))))
    if last is None and n:
        new[0] = True
    return new


def rank_in_contributor(df: DataFrame, by: list[str], best_first: list[Column], rank: str = "rang_source") -> DataFrame:
    """`df` (columns kept) with each row's place, from 0, among those of its contributor `by` in the order `best_first`.

    `best_first` should be total, else ties fall in any order. Null contributors form one contributor. Empty input gives
    no rows.
    """
    order = [*[F.col(c).asc_nulls_first() for c in by], *best_first]
    ordered = cut(cut(df).repartitionByRange(*order).sortWithinPartitions(*order))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, last, start = 0, None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            new = np.flatnonzero(_changes(t, by, last))
            if first is None:
                first = [t.column(c)[0].as_py() for c in by]
            if len(new):
                start = n + int(new[-1])
            last = [t.column(c)[-1].as_py() for c in by]
            n += t.num_rows
        if n:
            yield pa.RecordBatch.from_pylist([{"p": TaskContext.get().partitionId(), "n": n, "first": repr(first), "last": repr(last), "start": start}], pa.schema([("p", pa.int32()), ("n", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("start", pa.int64())]))

    head: dict[int, int] = {}
    at, before, since = 0, None, 0
    for r in sorted(ordered.select(*by).mapInArrow(heads, "p int, n bigint, first string, last string, start bigint").collect()):
        head[r.p] = at - since if r.first == before else 0
        since = since if r.first == before and r.start == 0 else at + r.start
        before, at = r.last, at + r.n

    schema = ordered.schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, start, last = 0, -head.get(TaskContext.get().partitionId(), 0), None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            new = _changes(t, by, last)
            if n == 0:
                new[0] = False
            at = np.arange(n, n + len(new))
            starts = np.maximum.accumulate(np.where(new, at, start))
            start, n = int(starts[-1]), n + len(new)
            last = [t.column(c)[-1].as_py() for c in by]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at - starts)], [*b.schema.names, rank])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return ordered.mapInArrow(number, f"{fields}, `{rank}` bigint")


def cap_contributors(df: DataFrame, by: list[str], best_first: list[Column], most: str | int | None = None, share: float | None = None, exempt: Column | None = None) -> DataFrame:
    """`df` with `retire`: true where a row is beyond its contributor's cap.

    `most` is a number or a column (null: no cap); `share` caps at that share of all rows, rounded down. Rows for which
    `exempt` holds are never removed and take no place. The quality order is `best_first`.
    """
    out = "exempte"
    while out in df.columns:
        out += "_"
    rows = df.withColumn(out, F.coalesce(exempt, F.lit(False)) if exempt is not None else F.lit(False))
    ranked = rank_in_contributor(rows, [out, *by], best_first)
    over = F.lit(False)
    if most is not None:
        over = over | F.coalesce(F.col("rang_source") >= (F.col(most) if isinstance(most, str) else F.lit(most)), F.lit(False))
    if share is not None:
        over = over | (F.col("rang_source") >= F.lit(int(share * ranked.count())))
    return ranked.withColumn("retire", over & ~F.col(out)).drop(out, "rang_source")


def cap_candidates(candidats: DataFrame, chunks: DataFrame, sources: DataFrame, seuils: DataFrame) -> DataFrame:
    """Each question's list with `source` (the registry's id) and `retire`, by the cap of the list's calibration.

    A candidate delivered again counts once; so does a passage, a source, a calibration. A passage without `doc`, or that
    isn't in `chunks`, is never removed. A `doc` that names no registered source stands for itself. Without a cap (no
    calibration, or none with a number) nothing is removed. A null or NaN `rrf` is worst; ties go to the smaller `i`.
    """
    lists = first_delivery(candidats.select("ligne", "calib", "i", "rrf", "calcule_le"), ["ligne", "i"], "calcule_le")
    docs = first_delivery(chunks.select("i", "charge_le", doc_key(F.col("doc")).alias("cle_source")), ["i"], "charge_le").select("i", "cle_source")
    ids = small(cut(sources.where("id is not null").groupBy(doc_key(F.col("id")).alias("cle_source")).agg(F.min("id").alias("id"))))
    caps = small(cut(seuils.where("calib is not null").groupBy("calib").agg(F.max_by("parametres_retrieve_au_moment_.max_par_doc", F.coalesce("calibre_le", F.lit("1970-01-01").cast("timestamp"))).alias("plafond"))))
    rows = lists.join(docs, "i", "left").join(ids, "cle_source", "left").join(caps, "calib", "left")
    rows = rows.select("ligne", "i", F.nanvl("rrf", F.lit(None).cast("double")).alias("rrf"), F.coalesce("id", "cle_source").alias("source"), "plafond")
    return cap_contributors(rows, ["ligne", "source"], [F.col("rrf").desc_nulls_last(), F.col("i").asc_nulls_last()], "plafond", exempt=F.col("source").isNull())
