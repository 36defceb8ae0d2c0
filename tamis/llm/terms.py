"""Problem 4: occurrences and records of every distinct term, with marks for too rare and too common.

Heavy-light aggregation. The terms of the vocabulary's most frequent words are taken to be heavy; their list, of fixed
size, goes to every task. A task counts heavy terms in two arrays (occurrences, records), which it sends once, at its end;
all other terms it counts in a table that it sends whenever the table reaches a bound. The arrays are reduced by place, a row
a task, and only the other terms' tables are shuffled by term; as the two share no term, the result is their union. Both
ways count every row exactly: the list only chooses the way.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.canon import _canon
from tamis.operators.delivery import first_delivery
from tamis.session import cut

_RUN = re.compile(r"[^\W_]+")
_MARK = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]")


@cache
def _number_signs() -> tuple[re.Pattern, re.Pattern]:
    """Characters that count as alphanumeric in Python but are neither letters nor decimal digits: in the basic plane, beyond it."""
    odd = [c for c in map(chr, range(0x110000)) if c.isalnum() and unicodedata.category(c)[0] != "L" and unicodedata.category(c) != "Nd"]
    return tuple(re.compile("[" + "".join(re.escape(c) for c in odd if (c > "\uffff") == high) + "]") for high in (False, True))


def bare(text: str) -> str:
    """Without accents."""
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M"))


class _Bare(dict):
    """Lower-cased run -> term; bounded."""

    def __missing__(self, run: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[run] = out = bare(run)
        return out


class Terms:
    """Text -> its terms: longest runs of letters and digits of the consistent form, lower-cased, without accents."""

    def __init__(self, words: tuple[str, ...] = ()):
        self.canon, self.term, self.signs, self.beyond = _canon(words), _Bare(), _number_signs(), re.compile("[\U00010000-\U0010ffff]")

    def __call__(self, text: str) -> list[str]:
        t = self.canon(text).lower()
        if not t.isascii():
            if _MARK.search(t):
                t = bare(t)
            if self.signs[0].search(t):
                t = self.signs[0].sub(" ", t)
            if self.beyond.search(t):
                t = self.signs[1].sub(" ", t)
        get = self.term.__getitem__
        return [get(x) for x in _RUN.findall(t)]


@cache
def _terms(words: tuple[str, ...]) -> Terms:
    return Terms(words)


def heavy_terms(words: tuple[str, ...], size: int = 1_024) -> tuple[str, ...]:
    """The first `size` terms of `words`, the most frequent first (see canon.vocabulary()): a guess of what is heavy, which
    changes no count."""
    of = _terms(())
    return tuple(dict.fromkeys(t for w in words for t in of(w)))[:size]


def count_parts(df: DataFrame, text: str, words: tuple[str, ...] = (), heavy: tuple[str, ...] = (), light_rows: int = 300_000) -> DataFrame:
    """What the tasks count: rows of a light `terme` with `n_occ`, `n_chunks`, and of each task one without, with the arrays
    `occ`, `rec` of the heavy terms and the number of non-null texts as `n_chunks`.

    Null texts have no terms, empty and blank ones neither; equal rows count as often as they are there. `light_rows`
    bounds a task's table of light terms, `heavy` is the list of terms that every task gets.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, at = _terms(words), {w: k for k, w in enumerate(heavy)}
        n = 0
        occ, rec = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        light_occ: Counter = Counter()
        light_rec: Counter = Counter()
        schema = pa.schema([("terme", pa.string()), ("n_occ", pa.int64()), ("n_chunks", pa.int64()), ("occ", pa.list_(pa.int64())), ("rec", pa.list_(pa.int64()))])

        def flush() -> pa.RecordBatch:
            names = list(light_occ)
            return pa.RecordBatch.from_pydict({"terme": names, "n_occ": [light_occ[w] for w in names], "n_chunks": [light_rec[w] for w in names], "occ": [None] * len(names), "rec": [None] * len(names)}, schema)

        for batch in batches:
            lists = [of(t) for t in batch.column(0).to_pylist() if t is not None]
            n += len(lists)
            all_occ, all_rec = Counter(chain.from_iterable(lists)), Counter(chain.from_iterable(map(set, lists)))
            for w in all_occ.keys() & at.keys():
                occ[at[w]] += all_occ.pop(w)
                rec[at[w]] += all_rec.pop(w)
            light_occ.update(all_occ)
            light_rec.update(all_rec)
            if len(light_occ) > light_rows:
                yield flush()
                light_occ.clear()
                light_rec.clear()
        yield flush()
        yield pa.RecordBatch.from_pydict({"terme": [None], "n_occ": [0], "n_chunks": [n], "occ": [occ.tolist()], "rec": [rec.tolist()]}, schema)

    return df.select(F.col(text)).mapInArrow(count, "terme string, n_occ bigint, n_chunks bigint, occ array<bigint>, rec array<bigint>")


def merge_parts(parts: DataFrame, heavy: tuple[str, ...] = ()) -> DataFrame:
    """`terme`, `n_occ`, `n_chunks` of `parts` (from count_parts(), cut): every distinct term once."""
    light = parts.where("terme is not null").groupBy("terme").agg(F.sum("n_occ").alias("n_occ"), F.sum("n_chunks").alias("n_chunks"))
    if not heavy:
        return light
    places = parts.where("terme is null").select(F.posexplode(F.arrays_zip("occ", "rec")).alias("k", "x")).groupBy("k").agg(F.sum("x.occ").alias("n_occ"), F.sum("x.rec").alias("n_chunks"))
    names = F.array(*map(F.lit, heavy))
    return light.unionByName(places.where("n_occ > 0").select(F.get(names, F.col("k")).alias("terme"), "n_occ", "n_chunks"))


def mark_terms(counts: DataFrame, n_records: int, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """Adds `marque`: `rare` in fewer than `rare_below` records, `commun` in more than `common_above` of `n_records`, else `utile`."""
    marque = F.when(F.col("n_chunks") < rare_below, "rare").when(F.col("n_chunks") > common_above * n_records, "commun").otherwise("utile")
    return counts.withColumn("marque", marque)


def term_frequencies(chunks: DataFrame, key: str = "i", text: str = "texte", by: str = "charge_le", words: tuple[str, ...] = ()) -> DataFrame:
    """Terms of all passages with their counts and marks; a passage delivered again counts once. `words`: the vocabulary of
    problem 3, which also names the heavy terms."""
    once = first_delivery(chunks.select(key, by, text), [key], by, key_rows=chunks)
    heavy = heavy_terms(words)
    parts = cut(count_parts(once, text, words, heavy))
    n = parts.where("terme is null").agg(F.sum("n_chunks")).first()[0] or 0
    return mark_terms(merge_parts(parts, heavy), n)
