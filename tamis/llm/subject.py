"""Problem 8: the subject areas that each document treats.

One-versus-rest linear classifiers on hashed word n-grams (one and two words) of single sentences. The weak labels are the
areas given by hand to some documents; they name a document, not its sentences, and some are wrong or missing. Expectation-
maximisation over the labelled documents' sentences therefore first finds which sentences speak of the areas and which of
none: each is of one area or of the background, the document's labels being its prior only. The classifiers are trained
on that, and each area's threshold is calibrated on labelled documents that neither stage saw. A document treats an area if
at least one in six of its sentences does. Only labelled documents enter the fit; all documents are classified, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.langid import OTHER, code_points, symbols, without_accents

BITS = 17
SHARE = 1 / 6
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, _P, np.uint64), dtype=np.uint64)
#: A unit of fewer words than this is a heading, a header line or a page marker, not a sentence.
LEAST_WORDS = 4


class Sentences(NamedTuple):
    """Hashed n-grams, one after another; each sentence's first one; each sentence's text."""

    feature: np.ndarray
    start: np.ndarray
    of: np.ndarray

    def spread(self) -> np.ndarray:
        """The sentence of each n-gram."""
        return np.repeat(np.arange(len(self.start)), np.diff(np.append(self.start, len(self.feature))))


class Model(NamedTuple):
    areas: tuple[str, ...]
    weight: np.ndarray
    bias: np.ndarray
    threshold: np.ndarray
    #: Share of the labels that were kept back which the thresholds find, and of what they find there that was given as a label
    #: (labels are missing for some areas that a document treats); not a number if there were none.
    recall: float = float("nan")
    precision: float = float("nan")


def body(text: str) -> str:
    """`text` without the header lines before its `=== TEXTE ===` line, if it has one."""
    at = text.find("=== TEXTE ===")
    return text if at < 0 else text[at + 13 :]


def sentences(texts: list[str]) -> Sentences:
    """The sentences of the texts with their n-grams. A sentence ends at `.`, `!`, `?` or `…` before white space, or at a
    line break, unless a lower-case letter follows; units of fewer than LEAST_WORDS words are none."""
    lut, kinds = symbols()
    texts = [body(t) + "\n" for t in texts]
    stop = np.cumsum([len(t) for t in texts])
    cp = np.minimum(code_points(texts), 0xFFFF)
    empty = np.empty(0, np.int64)
    if not len(cp):
        return Sentences(empty, empty, empty)
    sym, kind = without_accents()[lut[cp]], kinds[cp]
    solid = np.flatnonzero(kind < 2)
    ends = np.zeros(len(cp), bool)
    ends[:-1] = (kind[:-1] == 1) & (kind[1:] >= 2)
    ends |= cp == 10
    at = np.flatnonzero(ends)
    nxt = np.searchsorted(solid, at, side="right")
    follows = cp[solid[np.minimum(nxt, max(0, len(solid) - 1))]] if len(solid) else np.zeros(len(at), np.uint32)
    lower = (nxt < len(solid)) & _lower()[follows]
    ends[at[lower]] = False
    ends[stop - 1] = True
    number = np.concatenate(([0], np.cumsum(ends[:-1])))
    first = np.concatenate(([0], np.flatnonzero(ends[:-1]) + 1))
    keep = sym > 0
    s, n = sym[keep], number[keep]
    letter = s <= OTHER
    new = letter & np.concatenate(([True], ~letter[:-1]))
    w = np.flatnonzero(new)
    if not len(w):
        return Sentences(empty, empty, empty)
    place = np.arange(len(s)) - np.repeat(np.concatenate(([0], w)), np.diff(np.concatenate(([0], w, [len(s)]))))
    word = np.add.reduceat(np.where(letter, (s.astype(np.uint64) + np.uint64(1)) * _POWERS[np.minimum(place, 4095)], np.uint64(0)), w)
    word ^= word >> np.uint64(31)
    of = n[w]
    two = np.flatnonzero(of[1:] == of[:-1])
    pair = word[two] * np.uint64(0xBF58476D1CE4E5B9) + word[two + 1] * np.uint64(0x94D049BB133111EB)
    feature = np.concatenate((word * _P, pair)) >> np.uint64(64 - BITS)
    where = np.concatenate((of, of[two]))
    size = np.bincount(of, minlength=len(first))
    real = size >= LEAST_WORDS
    rank = np.cumsum(real) - 1
    mine = real[where]
    feature, where = feature[mine].astype(np.int64), rank[where[mine]]
    order = np.argsort(where, kind="stable")
    feature, where = feature[order], where[order]
    start = np.searchsorted(where, np.arange(int(real.sum())))
    return Sentences(feature, start, np.searchsorted(stop, first[real], side="right"))


def many_sentences(texts: list[str], portion: int = 500) -> Sentences:
    """sentences() of any number of texts, portion by portion for memory."""
    found = [sentences(texts[k : k + portion]) for k in range(0, len(texts), portion)] or [sentences([])]
    at = np.cumsum([0, *(len(x.feature) for x in found)])
    return Sentences(np.concatenate([x.feature for x in found]).astype(np.int32), np.concatenate([x.start + a for x, a in zip(found, at)]), np.concatenate([x.of + k * portion for k, x in enumerate(found)]))


def _of(s: Sentences, docs: np.ndarray) -> Sentences:
    """The sentences of the documents marked in `docs`, which are numbered anew."""
    mine, size = docs[s.of], np.diff(np.append(s.start, len(s.feature)))
    return Sentences(s.feature[np.repeat(mine, size)], np.concatenate(([0], np.cumsum(size[mine])))[:-1].astype(np.int64), (np.cumsum(docs) - 1)[s.of[mine]])


_LOWER: list[np.ndarray] = []


def _lower() -> np.ndarray:
    if not _LOWER:
        _LOWER.append(np.array([chr(c).islower() for c in range(0x10000)]))
    return _LOWER[0]


def _sum(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, start, axis=0) if len(start) else np.zeros((0, values.shape[1]), values.dtype)


def _by_feature(values: np.ndarray, small: np.ndarray, spread: np.ndarray, n: int) -> np.ndarray:
    """(n-grams, columns) sums of the sentences' `values`; column by column, for memory."""
    return np.stack([np.bincount(small, weights=values[:, c][spread], minlength=n) for c in range(values.shape[1])], 1)


def _by_sentence(w: np.ndarray, small: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.stack([np.add.reduceat(np.ascontiguousarray(w[:, c])[small], start) for c in range(w.shape[1])], 1)


def attribute(s: Sentences, given: np.ndarray, rounds: int = 6, smoothing: float = 3.0, weak: float = 0.215, margin: float = 1.5) -> np.ndarray:
    """Posterior (sentences, areas + 1) that a sentence speaks of an area or, last, of none. `given` (documents, areas)
    has 1 where an area was given to a document; documents without any help from the second round on.

    Expectation-maximisation. Each n-gram has a share per area, from the sentences of that area and, for sentences of none,
    from the areas of their documents, so that words of none are spread evenly. An n-gram speaks for an area only as far as
    its share exceeds one that is `weak` of the way from even to all; what a sentence's n-grams say together must exceed `margin`, else it
    speaks of none.
    """
    k, docs = given.shape[1], len(given)
    area_of_doc = given / np.maximum(1, given.sum(1, keepdims=True))
    least = 1 / k + weak * (1 - 1 / k)
    post = np.zeros((len(s.of), k + 1), np.float32)
    post[:, k] = 1
    spread = s.spread()
    used, small = np.unique(s.feature, return_inverse=True)
    for _ in range(rounds):
        part = post[:, :k] + post[:, k:] * area_of_doc[s.of]
        n = _by_feature(part, small, spread, len(used)) / np.maximum(1e-9, part.sum(0) / max(1e-9, part.sum(0).mean()))
        share = (n + smoothing / k) / (n.sum(1, keepdims=True) + smoothing)
        x = np.hstack((_by_sentence(np.maximum(0, np.log(share / least)).astype(np.float32), small, s.start), np.full((len(s.of), 1), margin)))
        x = np.exp(x - x.max(1, keepdims=True))
        post = (x / x.sum(1, keepdims=True)).astype(np.float32)
        found = np.stack([np.bincount(s.of, weights=post[:, c], minlength=docs) for c in range(k)], 1) + 2 * given
        area_of_doc = found / np.maximum(1.0, found.sum(1, keepdims=True))
    return post


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _learn(s: Sentences, given: np.ndarray, rounds: int, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the n-grams, bias), learnt from the sentences of documents with the labels `given`."""
    k = given.shape[1]
    target = attribute(s, given)[:, :k].astype(np.float32)
    bias = np.full(k, -3.0, np.float32)
    used, small = np.unique(s.feature, return_inverse=True)
    spread = s.spread()
    w, m, v = (np.zeros((len(used), k), np.float32) for _ in range(3))
    n = max(1, len(s.of))
    for t in range(1, rounds + 1):
        z = _by_sentence(w, small, s.start) + bias
        err = _sigmoid(z) - target
        grad = (_by_feature(err, small, spread, len(used)) / n + l2 * w).astype(np.float32)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        bias -= np.float32(0.5) * err.sum(0) / n
    weight = np.zeros((1 << BITS, k), np.float32)
    weight[used] = w
    return weight, bias.astype(np.float32)


def fit(texts: list[str], labels: list[list[str]], areas: tuple[str, ...], rounds: int = 30, l2: float = 1e-6) -> Model:
    """A model from labelled documents. The thresholds are calibrated on every fifth document by a model of the others (on all,
    if there are fewer than 50 documents); the model itself is then learnt from all."""
    s = many_sentences(texts)
    given = np.array([[a in x for a in areas] for x in labels], np.float64).reshape(len(labels), len(areas))
    k = len(areas)
    if not len(s.start):
        return Model(areas, np.zeros((1 << BITS, k), np.float32), np.full(k, -3.0, np.float32), np.full(k, 0.5))
    back = np.arange(len(texts)) % 5 == 4 if len(texts) >= 50 else np.zeros(len(texts), bool)
    chance = lambda w, b, x: _sigmoid(_by_sentence(w, x.feature, x.start) + b)
    weight, bias = _learn(s, given, rounds, l2)
    held = _of(s, back)
    if not len(held.start):
        return Model(areas, weight, bias, calibrate(chance(weight, bias, s), s.of, given)[0])
    return Model(areas, weight, bias, *calibrate(chance(*_learn(_of(s, ~back), given[~back], rounds, l2), held), held.of, given[back]))


def calibrate(p: np.ndarray, of: np.ndarray, given: np.ndarray, few: int = 20) -> tuple[np.ndarray, float, float]:
    """Each area's threshold of the sentences' probabilities `p`, by the labels `given` to the documents, and the recall and
    precision of all labels by these thresholds.

    As labels are missing for some areas that a document treats, the measure is recall of the given ones, squared, over
    the documents found; areas with fewer than `few` labels lean on all areas' measure in proportion."""
    grid = np.linspace(0.2, 0.8, 25)
    n = np.maximum(1, np.bincount(of, minlength=len(given)))[:, None]
    hit, found = np.zeros((25, p.shape[1])), np.zeros((25, p.shape[1]))
    for g, t in enumerate(grid):
        treats = np.stack([np.bincount(of, weights=p[:, c] >= t, minlength=len(given)) for c in range(p.shape[1])], 1) / n >= SHARE - 1e-9
        hit[g], found[g] = (treats & (given > 0)).sum(0), treats.sum(0)
    labels = given.sum(0)
    measure = lambda h, f, m: (h / np.maximum(1, m)) ** 2 / np.maximum(1, f) * np.maximum(1, m)
    own, all_areas = measure(hit, found, labels), measure(hit.sum(1), found.sum(1), labels.sum())
    trust = np.minimum(1, labels / few)
    score = trust * own + (1 - trust) * all_areas[:, None]
    best = [np.flatnonzero(score[:, c] >= score[:, c].max() - 1e-9) for c in range(p.shape[1])]
    mid = [b[len(b) // 2] for b in best]
    hits, all_found = (float(x[mid, range(len(mid))].sum()) for x in (hit, found))
    return grid[mid], hits / labels.sum() if labels.sum() else float("nan"), hits / all_found if all_found else float("nan")


def classify(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of its sentences that speak of each area, and of all its sentences."""
    s = sentences(texts)
    z = np.empty((len(s.start), len(model.areas)), np.float32)
    for lo in range(0, len(s.start), 4096):
        hi = min(lo + 4096, len(s.start))
        a, b = s.start[lo], s.start[hi] if hi < len(s.start) else len(s.feature)
        z[lo:hi] = _sum(model.weight[s.feature[a:b]], s.start[lo:hi] - a)
    on = z + model.bias >= np.log(model.threshold / (1 - model.threshold))
    hits = np.stack([np.bincount(s.of, weights=on[:, c], minlength=len(texts)) for c in range(len(model.areas))], 1) if len(s.start) else np.zeros((len(texts), len(model.areas)))
    return hits.astype(np.int64), np.bincount(s.of, minlength=len(texts)).astype(np.int64)


def train(documents: DataFrame, labels: DataFrame, areas: DataFrame, sample_docs: int = 5_000) -> Model:
    """A model from at most `sample_docs` labelled documents, those of the smallest hash. Labels of unknown areas are left out;
    of labels that contradict each other all count."""
    names = tuple(r.domaine for r in areas.select("domaine").where("domaine is not null").distinct().orderBy("domaine").collect())
    known = labels.where(F.col("domaine").isin(*names)).groupBy("doc_id").agg(F.sort_array(F.collect_set("domaine")).alias("l"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    given = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id").toPandas().sort_values("doc_id")
    return fit(given.text.tolist(), given.l.map(list).tolist(), names)


def subjects(documents: DataFrame, model: Model, keep: list[str], text: str = "text", share: float = SHARE, chars: int = 1_000_000) -> DataFrame:
    """`keep`..., `phrases` and `domaines` (array of domaine, part, traite) of each document.

    `part` is the share of the document's sentences that speak of the area, `traite` whether it is at least `share`. Null,
    empty and blank texts, and those without a sentence, have 0 and no areas. One row per row; nothing is shuffled; the
    model (4 MB for eight areas) goes to each task.
    """
    n = len(keep)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(n)), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + chars, side="right")))
                part = batch.slice(lo, hi - lo)
                lo = hi
                hits, total = classify(pc.fill_null(part.column(n), "").to_pylist(), shared.value)
                d, a = np.nonzero(hits)
                cuts = np.searchsorted(d, np.arange(len(total) + 1))
                rate = hits[d, a] / total[d]
                items = pa.StructArray.from_arrays([pa.array([shared.value.areas[x] for x in a], pa.string()), pa.array(rate), pa.array(rate >= share - 1e-9)], ["domaine", "part", "traite"])
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(total), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items)], [*keep, "phrases", "domaines"])

    rows = documents.select(*keep, F.col(text).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, f"{fields}phrases bigint, domaines array<struct<domaine: string, part: double, traite: boolean>>")


def composition(found: DataFrame) -> DataFrame:
    """The corpus by area: documents that treat it and sentences that speak of it, of all documents and sentences."""
    each = found.select("phrases", F.explode("domaines").alias("d")).groupBy("d.domaine").agg(F.count_if("d.traite").alias("documents"), F.sum(F.round(F.col("d.part") * F.col("phrases"))).cast("bigint").alias("phrases"))
    return each.withColumn("part_phrases", F.col("phrases") / F.sum("phrases").over(Window.partitionBy(F.lit(1))))
