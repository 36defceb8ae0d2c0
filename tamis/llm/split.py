"""Problem 2: splitting oversized items at natural boundaries, by content-defined chunking.

A natural boundary is a line break, or `.`, `!`, `?` or `…` followed by white space and then an upper-case letter. The
text between neighbouring boundaries is a stretch. A rolling hash over the text names landmarks, on average one in as many
characters as the sizes around the target span; a piece ends at the natural boundary nearest to the first landmark among
these sizes, which lie between the smallest and the largest and have the target in their middle. Where no landmark lies
there, the place of the smallest hash stands for one; where no boundary, any size from the smallest to the largest will do.
As all depends on the text around only, an edit moves the cuts next to it and hardly any others. A stretch longer than the limit is cut inside, at the blank nearest to a landmark if there
is one, else at the landmark; its pieces are marked as forced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE = "\n\r\x0b\x0c\x85  "
_STOP = re.compile(r"[.!?…](?=\s+(\S))")
_BOUNDARY = re.compile(rf"[{_LINE}]|[.!?…](?=\s)")
_BLANK = re.compile(r"\s+")

WINDOW, BITS = 24, 24


class Piece(NamedTuple):
    a: int
    b: int
    own: int
    forced: bool


def stretches(text: str) -> list[tuple[int, int]]:
    """(start, end) of the non-blank stretches between natural boundaries, without blanks around them."""
    cuts = [0]
    for m in _BOUNDARY.finditer(text):
        if m.group() in _LINE:
            cuts.append(m.start())
        elif (nxt := _STOP.match(text, m.start())) and nxt.group(1).isupper():
            cuts.append(m.end())
    cuts.append(len(text))
    out = []
    for a, b in zip(cuts, cuts[1:]):
        s = text[a:b]
        if left := s.lstrip():
            a += len(s) - len(left)
            out.append((a, a + len(left.rstrip())))
    return out


class Landmarks:
    """Places in a text by the rolling hash of the WINDOW characters before them: landmarks, one in `spacing` on average."""

    def __init__(self, text: str, spacing: int):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h, p = np.zeros(max(0, len(c) - WINDOW + 1), np.uint64), np.uint64(1)
        for j in range(WINDOW if len(h) else 0):
            h += c[WINDOW - 1 - j : len(c) - j] * p
            p = np.uint64((int(p) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        h ^= h >> np.uint64(29)
        self.value = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
        self.at = (np.flatnonzero(self.value < (1 << BITS) // max(1, spacing)) + WINDOW).tolist()

    def first(self, lo: int, hi: int) -> int | None:
        """The first landmark in [lo, hi], else the place of the smallest hash there; None if no place has WINDOW characters before it."""
        k = bisect_left(self.at, lo)
        if k < len(self.at) and self.at[k] <= hi:
            return self.at[k]
        a = max(0, lo - WINDOW)
        part = self.value[a : max(a, hi - WINDOW + 1)]
        return a + int(part.argmin()) + WINDOW if len(part) else None


def _choose(ends: list[int], marks: Landmarks, lo: int, hi: int, since: int = 0) -> int | None:
    """Of the sorted `ends`, from number `since` on, in [lo, hi] that nearest to the landmark there; None if there is none."""
    i, j = bisect_left(ends, lo, since), bisect_right(ends, hi, since)
    if i >= j:
        return None
    m = marks.first(lo, hi)
    if m is None:
        return ends[j - 1]
    near = bisect_left(ends, m, i, j)
    return min(ends[max(i, near - 1) : min(j, near + 1)], key=lambda e: (abs(e - m), e))


def split(text: str, limit: int, least: int = 0, overlap: int = 0, target: int | None = None) -> list[Piece]:
    """Pieces of `text`, in order, none longer than `limit`: (start, end, where its own part starts, whether a cut at its
    ends is forced). Together the own parts hold every non-blank character. Each piece after the first starts with the
    last `overlap` stretches of the one before, fewer where the limit leaves no room. A text within the limit is one
    piece; a blank one has none. `limit` must be positive; `target` is the mean size, by default midway from `least` to
    `limit`, and is taken as within the two."""
    if limit < 1:
        raise ValueError("limit must be positive")
    least = min(max(least, 1), limit)
    target = min(max(target if target is not None else (least + limit) // 2, least), limit)
    low, high = max(least, 2 * target - limit), min(limit, 2 * target - least)
    units: list[tuple[int, int, bool]] = []
    parts = stretches(text)
    marks = Landmarks(text if parts and parts[-1][1] - parts[0][0] > limit else "", high - low)
    for a, b in parts:
        blanks = [m.start() for m in _BLANK.finditer(text, a, b)] if b - a > limit else []
        forced = b - a > limit
        while b - a > limit:
            e = _choose(blanks, marks, a + max(1, limit // 2), a + limit)
            if e is None:
                k = bisect_left(blanks, a + 1)
                e = blanks[k] if k < len(blanks) and blanks[k] <= a + limit else None
            if e is None:
                e = marks.first(a + max(1, limit // 2), a + limit) or a + limit
            units.append((a, e, True))
            a = e
            while a < b and text[a].isspace():
                a += 1
        if a < b:
            units.append((a, b, forced))
    if not units:
        return []
    ends = [u[1] for u in units]
    out: list[Piece] = []
    k, first = 0, 0
    while k < len(units):
        start, back = units[k][0], k
        if k:
            back = max(first, k - overlap)
            while back < k and (units[k][1] - units[back][0] > limit or units[back][2]):
                back += 1
            start = units[back][0]
        if ends[-1] - start <= limit:
            e = ends[-1]
        else:
            e = _choose(ends, marks, start + low, start + high, k)
            if e is None:
                e = _choose(ends, marks, start + least, start + limit, k)
            if e is None:
                e = ends[bisect_right(ends, start + limit) - 1]
        last = bisect_left(ends, e, k)
        out.append(Piece(start, units[last][1], units[k][0], any(u[2] for u in units[k : last + 1])))
        first, k = back, last + 1
    return out


def split_oversized(df: DataFrame, text: str, limit: str, least: str, overlap: str, keep: list[str], off: str | None = None, target: str | None = None) -> DataFrame:
    """The pieces of the rows of `df` whose `text` is longer than `limit` (columns; null limit: never oversized).

    Rows: `keep`..., `morceau` from 0, `a`, `b` (code points in the text), `propre` (where the part that repeats nothing
    starts), `forcee`, `texte_morceau`, and with `off`, a struct (a, b) of the text's place, `off_morceau` (null where it
    is null). Rows within the limit, null and blank texts give no row; null or negative `least` and `overlap` are 0; a null
    `target`, or none, is the default of split().
    The filter runs in the JVM, so only oversized texts reach Python, one at a time; there is no shuffle.
    """
    big = df.where((F.col(limit) > 0) & (F.length(text) > F.col(limit)) & F.col(text).rlike(r"(?U)\S"))
    rows = big.select(F.struct(*keep).alias("k"), F.col(text).alias("t"), F.col(limit).cast("int").alias("l"), F.coalesce(F.col(least).cast("int"), F.lit(0)).alias("m"), F.coalesce(F.col(overlap).cast("int"), F.lit(0)).alias("o"), (F.col(f"{off}.a") if off else F.lit(None)).cast("bigint").alias("at"), (F.col(target) if target else F.lit(None)).cast("int").alias("c"))
    schema = big.select(F.struct(*keep).alias("k")).schema["k"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, cols = batch.column(0), {n: batch.column(j).to_pylist() for j, n in enumerate("ktlmo_c") if n not in "k_"}
            of, piece = [], []
            for r, t in enumerate(cols["t"]):
                for n, p in enumerate(split(t, cols["l"][r], max(0, cols["m"][r]), max(0, cols["o"][r]), cols["c"][r])):
                    of.append(r)
                    piece.append((n, p.a, p.b, p.own, p.forced, t[p.a : p.b]))
            at = pa.array(of, pa.int64())
            n, a, b, own, forced, own_text = zip(*piece) if piece else [()] * 6
            yield pa.RecordBatch.from_arrays([k.take(at), batch.column(5).take(at), pa.array(n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(own, pa.int64()), pa.array(forced, pa.bool_()), pa.array(own_text, pa.string())], ["k", "at", "morceau", "a", "b", "propre", "forcee", "texte_morceau"])

    out = rows.mapInArrow(run, f"k {schema.simpleString()}, at bigint, morceau int, a bigint, b bigint, propre bigint, forcee boolean, texte_morceau string")
    place = [F.when(F.col("at").isNotNull(), F.struct((F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))).alias("off_morceau")] if off else []
    return out.select("k.*", "morceau", "a", "b", "propre", "forcee", *place, "texte_morceau")


def passages(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """`chunks` with the size rules of their lot: `maxi`, `mini`, `cible`, `chevauchement`; null where the lot has none."""
    rules = manifest.select("lot", F.col("chunking.maxi_car").alias("maxi"), F.col("chunking.mini_car").alias("mini"), F.col("chunking.cible_car").alias("cible"), F.col("chunking.chevauchement_unites").alias("chevauchement"), F.col("construit_le").alias("__c"))
    rules = rules.groupBy("lot").agg(F.max_by(F.struct("maxi", "mini", "cible", "chevauchement"), F.coalesce("__c", F.lit("1970-01-01").cast("timestamp"))).alias("r")).select("lot", "r.*")
    return chunks.join(rules, "lot", "left")
