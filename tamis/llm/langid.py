"""Problem 1: the language of each text and of each part of a text in several languages, with a confidence.

Multilingual mixture inference. The likelihood of a text's sentences under each language comes from its n-grams (of three
and five symbols, after folding case, look-alikes and digits). A text is a mixture of languages in unknown proportions,
found by expectation-maximisation for each set of languages; the set is that of the largest likelihood less a penalty per
language. Within the set, the sentences take the languages of the best path, in which a change has its price; a segment is
a longest run of sentences in one language.

A mixture is never likelier than each sentence under its own best language, so a text for which even that gains less than
the penalty is in one language, without any iteration. Sentences of a whole batch are scored at once, on arrays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.canon import _IGNORED, LOOK_ALIKES

LANGUAGES = ("fr", "en", "es", "pt")

# Names and codes by which a language may be called, in lower case without accents.
NAMES = {
    "fr": ["fr", "fra", "fre", "francais", "french", "frances"],
    "en": ["en", "eng", "anglais", "english", "ingles"],
    "es": ["es", "spa", "espagnol", "spanish", "espanol", "castellano", "espanhol"],
    "pt": ["pt", "por", "portugais", "portuguese", "portugues"],
}

# Letters that have a symbol of their own; all other letters with accents share their base letter's.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãçèéêëíîïñóôõöùúûüœ"
OTHER, APOSTROPHE, BLANK = 61, 62, 63
BITS, ROWS = 18, 1 << 19
DAMPING, PENALTY, CHANGE = 0.2, 8.0, 7.0


def named(label: Column) -> Column:
    """The languages that a label names, in any spelling or code: array<string>, empty if none, also for null."""
    plain = F.translate(F.lower(label), "áàâãäéèêëíìîïóòôõöúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
    parts = F.transform(F.split(F.coalesce(plain, F.lit("")), r"[/,;+&|]| et | and "), lambda x: F.regexp_replace(F.regexp_extract(x, r"^\s*(.*?)\s*$", 1), r"^([a-z]{2,3})[-_].*$", "$1"))
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(parts, F.array(*map(F.lit, n))), F.lit(c)) for c, n in NAMES.items()]))


@cache
def symbols() -> tuple[np.ndarray, np.ndarray]:
    """By code point of the basic plane: the symbol (0: shows nothing or is an accent), and 1 where a sentence may end,
    2 for white space, 3 for a line break."""
    sym, kind = np.full(0x10000, BLANK, np.uint8), np.zeros(0x10000, np.uint8)
    own = {c: k + 1 for k, c in enumerate(LETTERS)}
    for code in range(0x10000):
        c = chr(code)
        cat = unicodedata.category(c)
        if _IGNORED.match(c) or cat[0] == "M":
            sym[code] = 0
        elif c in "'’":
            sym[code] = APOSTROPHE
        elif cat[0] == "L":
            low = LOOK_ALIKES.get(c, unicodedata.normalize("NFKC", c)).lower()[:1]
            base = unicodedata.normalize("NFD", low)[:1]
            sym[code] = own.get(low) or own.get(LOOK_ALIKES.get(base, base).lower(), OTHER)
        if c in ".!?…":
            kind[code] = 1
        elif c in "\n\r\x0b\x0c\x85  ":
            kind[code] = 3
        elif c.isspace():
            kind[code] = 2
    return sym, kind


@cache
def without_accents() -> np.ndarray:
    """By symbol: that of its base letter."""
    out = np.arange(64, dtype=np.uint8)
    for k, c in enumerate(LETTERS):
        base = {"œ": "o"}.get(c, unicodedata.normalize("NFD", c)[0])
        out[k + 1] = LETTERS.index(base) + 1
    return out


def telling(sym: np.ndarray) -> np.ndarray:
    """True for the symbols that n-grams are made of: all that show, but of a run of blanks, digits and signs one only."""
    keep = sym > 0
    at = np.flatnonzero(keep)
    blank = sym[at] == BLANK
    keep[at[1:][blank[1:] & blank[:-1]]] = False
    return keep


def hide_quotes(cp: np.ndarray, kind: np.ndarray, sym: np.ndarray) -> None:
    """Blanks out what stands in quotation marks within a line and holds no end of a sentence: a title says nothing of the
    sentence around it."""
    opens, shuts = (np.flatnonzero((cp == ord(a)) | (cp == ord(b))) for a, b in ("«“", "»”"))
    if not len(opens) or not len(shuts):
        return
    nxt = np.searchsorted(shuts, opens)
    opens, nxt = opens[nxt < len(shuts)], nxt[nxt < len(shuts)]
    cuts = kind == 3
    cuts[:-1] |= (kind[:-1] == 1) & (kind[1:] >= 2)
    cuts = np.cumsum(cuts)
    for a, b in zip(opens, shuts[nxt]):
        if cuts[a] == cuts[b - 1] and a and kind[a - 1] >= 2:
            sym[a : b + 1] = BLANK


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the 3-grams and the 5-grams that start at each symbol; the last four symbols have none."""
    s = sym.astype(np.uint32)
    three = s[:-2] | (s[1:-1] << np.uint32(6)) | (s[2:] << np.uint32(12))
    n = max(0, len(s) - 4)
    five = three[:n] | (s[3 : 3 + n] << np.uint32(18)) | (s[4 : 4 + n] << np.uint32(24))
    five = ((five * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)) | np.uint32(1 << BITS)
    return three[:n], five


def fit(texts: list[str], labels: list[str], smoothing: float = 0.5, bare_weight: float = 0.5) -> np.ndarray:
    """Log-likelihoods of the n-grams by language, less their mean over the languages: float32 (ROWS, languages).

    Each text counts as it is and, with `bare_weight`, without accents, so that texts typed without are recognised.
    """
    lut, _ = symbols()
    count = np.zeros((ROWS, len(LANGUAGES)))
    for k, lang in enumerate(LANGUAGES):
        own = [t + "\n" for t, x in zip(texts, labels) if x == lang and t]
        for lo in range(0, len(own), 1_000):
            sym = lut[np.minimum(code_points(own[lo : lo + 1_000]), 0xFFFF)]
            sym = sym[telling(sym)]
            for s, w in ((sym, 1.0), (without_accents()[sym], bare_weight)):
                if len(s) > 4:
                    for g in grams(s):
                        count[:, k] += w * np.bincount(g, minlength=ROWS)
    count[0] = 0
    out = np.empty_like(count)
    for lo, hi in ((0, 1 << BITS), (1 << BITS, ROWS)):
        c = count[lo:hi] + smoothing
        out[lo:hi] = np.log(c / c.sum(0))
    out -= out.mean(1, keepdims=True)
    out[count.sum(1) == 0] = 0
    return (DAMPING * out).astype(np.float32)


def score(sym: np.ndarray, sentence: np.ndarray, n: int, model: np.ndarray, text: np.ndarray | None = None, block: int = 1 << 18) -> np.ndarray:
    """Log-likelihood (n, languages) of each sentence; `sentence` has the number of each symbol's, ascending. With `text`,
    the number of each symbol's text, n-grams that run over a text's end count nothing."""
    out = np.zeros((n, model.shape[1]))
    if len(sym) < 5:
        return out
    three, five = grams(sym)
    for lo in range(0, len(three), block):
        ll = model[three[lo : lo + block]]
        ll += model[five[lo : lo + block]]
        if text is not None:
            ll[text[lo : lo + len(ll)] != text[lo + 4 : lo + 4 + len(ll)]] = 0
        s = sentence[lo : lo + len(ll)]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(s)) + 1))
        out[s[starts]] += np.add.reduceat(ll, starts, axis=0, dtype=np.float64)
    return out


def mixture(ll: np.ndarray, penalty: float = PENALTY, rounds: int = 30) -> tuple[tuple[int, ...], np.ndarray]:
    """The set of languages of the largest penalised likelihood, and their proportions by expectation-maximisation."""
    best: tuple[float, tuple[int, ...], np.ndarray] = (-np.inf, (), np.empty(0))
    wins = np.unique(ll.argmax(1))
    for size in range(1, len(wins) + 1):
        for chosen in combinations(wins.tolist() if size > 1 else range(ll.shape[1]), size):
            x = ll[:, chosen]
            top = x.max(1, keepdims=True)
            e = np.exp(x - top)
            share = np.full(size, 1 / size)
            for _ in range(rounds if size > 1 else 0):
                r = e * share
                r /= r.sum(1, keepdims=True)
                new = r.mean(0)
                if np.abs(new - share).max() < 1e-4:
                    break
                share = new
            value = float((np.log(np.maximum(e @ share, 1e-300)) + top[:, 0]).sum()) - penalty * size
            if value > best[0] + 1e-9:
                best = (value, chosen, share)
    return best[1], best[2]


def path(ll: np.ndarray, chosen: tuple[int, ...], share: np.ndarray, change: float = CHANGE) -> np.ndarray:
    """The language of each sentence on the best path through `chosen`, where each change costs `change`."""
    x = ll[:, chosen] + 0.0
    at, back = x[0] + np.log(np.maximum(share, 1e-6)), np.zeros(x.shape, np.int64)
    for k in range(1, len(x)):
        stay, move = at, at.max() - change
        back[k] = np.where(stay >= move, np.arange(len(at)), at.argmax())
        at = np.maximum(stay, move) + x[k]
    out = np.empty(len(x), np.int64)
    out[-1] = at.argmax()
    for k in range(len(x) - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return np.asarray(chosen)[out]


def _confidence(ll: np.ndarray) -> np.ndarray:
    """Posterior of each row's best language."""
    return 1 / np.exp(ll - ll.max(-1, keepdims=True)).sum(-1)


def infer(texts: list[str], model: np.ndarray, penalty: float = PENALTY) -> list[list[tuple[int, int, int, float]]]:
    """Of each text its segments (start, end, language number, confidence), in order; none if it has no letters that tell.

    Positions are code points of the text as it is; a segment ends where the next begins. Each text stands between line
    breaks that aren't its own, so that what is found in it depends on it alone."""
    if not texts:
        return []
    lut, kinds = symbols()
    size = np.array([len(t) for t in texts], np.int64)
    stop = 1 + np.cumsum(size + 1)
    cp = np.minimum(code_points(["\n", *(t + "\n" for t in texts)]), 0xFFFF)
    sym, kind = lut[cp], kinds[cp]
    hide_quotes(cp, kind, sym)
    ends = np.zeros(len(cp), bool)
    ends[:-1] = (kind[:-1] == 1) & (kind[1:] >= 2)
    ends |= kind == 3
    ends[stop[size > 0] - 2] = False
    number = np.concatenate(([0], np.cumsum(ends[:-1])))
    keep = telling(sym)
    first = np.concatenate(([0], np.flatnonzero(ends[:-1]) + 1))
    of = np.searchsorted(stop, first, side="right")
    of[0] = -1
    ll = score(sym[keep], number[keep], len(first), model, of[number[keep]])
    begin = np.searchsorted(of, np.arange(len(texts) + 1))
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    some = np.flatnonzero(begin[1:] > begin[:-1])
    total = np.add.reduceat(ll, begin[some], axis=0)
    gain = np.add.reduceat(ll.max(1), begin[some]) - total.max(1)
    sure, lang = _confidence(total), total.argmax(1)
    for k, t in enumerate(some):
        if total[k].max() - total[k].min() < 1e-6 and gain[k] < 1e-6:
            continue
        if gain[k] <= penalty:
            out[t] = [(0, int(size[t]), int(lang[k]), float(sure[k]))]
            continue
        rows, base = ll[begin[t] : begin[t + 1]], stop[t] - size[t] - 1
        which = path(rows, *mixture(rows, penalty))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(which)) + 1, [len(which)]))
        for a, b in zip(cuts, cuts[1:]):
            part = rows[a:b].sum(0)
            p = float(np.exp(part[which[a]] - part.max()) / np.exp(part - part.max()).sum())
            end = int(first[begin[t] + b] - base) if b < len(which) else int(size[t])
            out[t].append((int(first[begin[t] + a] - base) if a else 0, end, int(which[a]), p))
    return out


def train(df: DataFrame, text: str, label: str, sample_rows: int = 12_000, seed: int = 7) -> np.ndarray:
    """A model from at most about `sample_rows` rows of `df` whose label names one language. Labels may be wrong for some."""
    n = df.count()
    rows = df.sample(False, min(1.0, sample_rows / max(1, n)), seed).select(F.col(text).alias("t"), named(F.col(label)).alias("l")).where("t is not null and size(l) = 1").limit(2 * sample_rows)
    found = rows.select("t", F.col("l")[0].alias("l")).toPandas()
    return fit(found.t.tolist(), found.l.tolist())


def languages(df: DataFrame, text: str, keep: list[str], model: np.ndarray, penalty: float = PENALTY, chars: int = 1_000_000) -> DataFrame:
    """`keep`..., `langue_trouvee`, `confiance` and `segments` (array of seg, a, b, langue, confiance) of each row.

    `langue_trouvee` is the language of most characters, `confiance` the mean of the segments' by characters. Null, empty
    and blank texts, and those without any letter that tells, have null, null and no segments. Rows are worked on in
    portions of about `chars` characters; nothing is shuffled. `model` (8 MB whatever the data) goes to each task.
    """
    n = len(keep)
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(n)), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + chars, side="right")))
                part = batch.slice(lo, hi - lo)
                lo = hi
                found = infer(pc.fill_null(part.column(n), "").to_pylist(), shared.value, penalty)
                flat = [(k, *s) for x in found for k, s in enumerate(x)]
                k, a, b, lang, sure = zip(*flat) if flat else [()] * 5
                segments = pa.StructArray.from_arrays([pa.array(k, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([LANGUAGES[x] for x in lang], pa.string()), pa.array(sure, pa.float64())], ["seg", "a", "b", "langue", "confiance"])
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                main, mean = [], []
                for x in found:
                    by = dict.fromkeys((s[2] for s in x), 0)
                    for s in x:
                        by[s[2]] += s[1] - s[0]
                    main.append(LANGUAGES[max(by, key=by.get)] if x else None)
                    mean.append(sum((s[1] - s[0]) * s[3] for s in x) / max(1, sum(s[1] - s[0] for s in x)) if x else None)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(main, pa.string()), pa.array(mean, pa.float64()), pa.ListArray.from_arrays(offsets, segments)], [*keep, "langue_trouvee", "confiance", "segments"])

    rows = df.select(*keep, F.col(text).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, f"{fields}langue_trouvee string, confiance double, segments array<struct<seg: bigint, a: bigint, b: bigint, langue: string, confiance: double>>")


def mislabelled(found: DataFrame, label: str) -> DataFrame:
    """Rows of languages() whose `label` doesn't name the text's one language, or whose text is in several."""
    return found.where((F.size("segments") > 1) | ((F.size("segments") == 1) & ~F.array_contains(named(F.col(label)), F.col("langue_trouvee"))))
