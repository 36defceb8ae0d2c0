"""Problem 6: ids of whole texts in a public byte-level BPE vocabulary.

A text is split into words by the vocabulary's public pattern. A word's bytes stand in a contiguous array of part
boundaries with the rank of each pair of neighbouring parts; the smallest rank is looked for, its boundary deleted and
the two ranks beside it refreshed, until no pair has a rank. Words beyond LONG bytes, where scanning would be quadratic,
take the same steps by a heap. Words are kept with their ids, up to a bound, as they recur.
"""

from __future__ import annotations

import base64
import heapq
import importlib
import os
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The folder of the public vocabulary files.
TOKENIZERS = os.environ.get("TAMIS_TOKENIZERS", "/opt/tokenizers")
LONG = 64

# Fixed value: the public pattern of the byte_bpe vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """The file of the vocabulary `name`, from `folder`, TOKENIZERS or the installed package of public tokenizers."""
    file = f"{name}.tiktoken"
    for at in (folder, TOKENIZERS):
        if at and os.path.exists(os.path.join(at, file)):
            return os.path.join(at, file)
    return importlib.import_module("public_tokenizers").path(file)


def merge_scan(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of a short word, by scanning the array of adjacent ranks."""
    none = len(rank) + (1 << 30)
    at = list(range(len(word) + 1))
    pair = [rank.get(word[k : k + 2], none) for k in range(len(word) - 1)]
    while pair:
        low = min(pair)
        if low == none:
            break
        k = pair.index(low)
        del at[k + 1], pair[k]
        if k < len(pair):
            pair[k] = rank.get(word[at[k] : at[k + 2]], none)
        if k:
            pair[k - 1] = rank.get(word[at[k - 1] : at[k + 1]], none)
    return [rank[word[a:b]] for a, b in zip(at, at[1:])]


def merge_heap(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of a long word: the same merges in the same order (smallest rank, then leftmost), by a heap."""
    n = len(word)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := rank.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, stop = heapq.heappop(heap)
        nxt = end[k]
        if not alive[k] or nxt >= n or end[nxt] != stop:
            continue
        alive[nxt] = False
        end[k] = stop
        if stop < n:
            prev[stop] = k
            if (r := rank.get(word[k : end[stop]])) is not None:
                heapq.heappush(heap, (r, k, end[stop]))
        if (p := prev[k]) >= 0 and (r := rank.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, k = [], 0
    while k < n:
        out.append(rank[word[k : end[k]]])
        k = end[k]
    return out


class _Words(dict):
    """Word -> its ids; bounded by the number of words kept, and long words aren't kept."""

    KEPT = 300_000

    def __init__(self, rank: dict[bytes, int]):
        self.rank = rank

    def __missing__(self, word: str) -> list[int]:
        data = word.encode("utf-8", "replace")
        if len(data) > LONG:
            return merge_heap(data, self.rank)
        if len(self) >= self.KEPT:
            self.clear()
        self[word] = out = merge_scan(data, self.rank)
        return out


class _Pieces(dict):
    """What stands between two single spaces -> its number in the encoder's pool, 0 if it can't stand alone."""

    def __init__(self, enc: Encoder, before: str):
        self.enc, self.before = enc, before

    def __missing__(self, piece: str) -> int:
        alone = piece and not piece[0].isspace() and not piece[-1].isspace()
        n = self.enc.put(self.before + piece) if alone else 0
        if len(piece) <= 4 * LONG:
            self[piece] = n
        return n


class Encoder:
    """Ids of texts. As the pattern begins a word at a single space between two other characters, what stands between
    such spaces is encoded once and kept; a text with other white space beside a space takes the pattern as a whole."""

    POOL = 4_000_000

    def __init__(self, path: str):
        self.words = _Words(ranks(path))
        self.pattern = regex.compile(PATTERN)
        self.clear()

    def clear(self) -> None:
        self.pool, self.start, self.length = array("i"), array("q", [0]), array("i", [0])
        self.first, self.rest = _Pieces(self, ""), _Pieces(self, " ")

    def parts(self, text: str) -> list[list[int]]:
        return list(map(self.words.__getitem__, self.pattern.findall(text)))

    def put(self, text: str) -> int:
        """Adds the ids of `text` to the pool; their number."""
        self.start.append(len(self.pool))
        for x in self.parts(text):
            self.pool.extend(x)
        self.length.append(len(self.pool) - self.start[-1])
        return len(self.start) - 1

    def numbers(self, text: str | None) -> list[int]:
        if not text:
            return []
        head, *tail = text.split(" ")
        out = [self.first[head], *map(self.rest.__getitem__, tail)]
        return [self.put(text)] if 0 in out else out

    def batch(self, texts: list[str | None], ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and the ids of all one after another (nothing if not `ids`)."""
        if len(self.pool) > self.POOL:
            self.clear()
        lists = [self.numbers(t) for t in texts]
        of = np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))
        each = np.frombuffer(self.length, np.int32)[of].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(each)))
        stops = np.cumsum([0, *map(len, lists)])
        n = ends[stops[1:]] - ends[stops[:-1]]
        if not ids or not len(each):
            return n, np.empty(0, np.int32)
        at = np.repeat(np.frombuffer(self.start, np.int64)[of] - ends[:-1], each) + np.arange(ends[-1])
        return n, np.frombuffer(self.pool, np.int32)[at]

    def ids(self, text: str | None) -> list[int]:
        """Ids of the exact text, what looks like a special token being plain text; none for an empty or null one."""
        return self.batch([text])[1].tolist()


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, text: str, keep: list[str], name: str = "byte_bpe_50k", folder: str | None = None, ids: str = "ids") -> DataFrame:
    """`keep`... and `ids`, the ids of the exact `text` as array<int>; an empty and a null text both give an empty list.

    One row per row of `df`, equal rows included; only `keep` and the text are read, and nothing is shuffled.
    """
    path, n = vocabulary_path(name, folder), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                each, flat = enc.batch(part.column(n).to_pylist())
                offsets = np.concatenate(([0], np.cumsum(each))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*keep, ids])

    rows = df.select(*keep, F.col(text).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, f"{fields}`{ids}` array<int>")


def count_tokens(df: DataFrame, text: str, keep: list[str], name: str = "byte_bpe_50k", folder: str | None = None, out: str = "jetons") -> DataFrame:
    """`keep`... and `out`, the number of ids that encode() gives (0 for an empty or null text)."""
    path, n = vocabulary_path(name, folder), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(enc.batch(b.column(n).to_pylist(), ids=False)[0])], [*keep, out])

    rows = df.select(*keep, F.col(text).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, f"{fields}`{out}` bigint")
