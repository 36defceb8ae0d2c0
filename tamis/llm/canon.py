"""Problem 3: one consistent form for texts that look the same.

The consistent form of a text is what a reader sees, written in one way: characters that show nothing are dropped,
every blank of the line is a plain space, line ends are a newline without blanks before it, look-alike letters of other
scripts, full-width forms and ligatures are the plain letters they look like, and accents are composed. Case, accents,
digits, words, punctuation, the number of inner blanks and line breaks all stay.

A word with such characters is read along the trie of a vocabulary by a weighted edit automaton: ignorables and the plain
letters that a sign looks like cost nothing, a sign's less usual letter RARER, another letter, one too many or one missing
a whole edit. The cheapest spelling within the budget is the word's canonical one, of equally cheap ones the most frequent.
With the production budget, less than one edit, the vocabulary decides between the letters that one sign may stand for
(`ǀ`: l or I), and words that a reader can tell apart stay apart. Words it doesn't have, and all between words, go by the table.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.session import cut

# Letters of other scripts and the plain letter each looks like.
LOOK_ALIKES = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοϲϳ" "ЅІЈАВЕКМНОРСТХҮԌаеорсухѕіјһԁԛԝӏ" "ՕՏօոսհցյ" "ℓ∕∶⁄‐‑",
        "ABEZHIKMNOPTYXvocj" "SIJABEKMHOPCTXYGaeopcyxsijhdqwl" "OSonuhgj" "l/:/--",
        strict=True,
    )
)

# Ligatures and the letters they show.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

# Ranges of characters that show nothing (default ignorables, without those that shape Hangul or tags).
IGNORABLE = "\u00ad\u034f\u061c\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0001-\U000e007f"

# Signs that may stand for several plain letters, the usual one first; all but those in LOOK_ALIKES stay as they
# are where no vocabulary reads them.
READINGS = {"ǀ": "lI", "∣": "lI", "Ӏ": "Il", "ӏ": "lI", "Ⅰ": "I", "ⅼ": "l", "β": "ß"}
#: Cost of a letter that isn't a sign's usual one, and what a reading may cost: less than an edit.
RARER, BUDGET = 0.25, 0.9

#: Texts of these characters only are in the consistent form but for blanks before line ends.
PLAIN = "\t\n -~\u00a1-\u00ac\u00ae-\u00ff\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u0152\u0153\u20ac"
_ODD = re.compile(f"[^{PLAIN}]")
_ODD_OR_TRAILING = re.compile(rf"[^{PLAIN}]|[ \t]\n|[ \t]\Z")
_IGNORED = re.compile(f"[{IGNORABLE}]+")
_LINE_END = re.compile("[ \\t]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])|[ \\t]+\\Z")
#: A word as it stands in a text: letters, digits, marks and ignorables.
_LETTER = f"(?:[^\\W_]|[∣\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f{IGNORABLE}])"
_WORD = re.compile(_LETTER + "+")
#: A word, or odd characters between words.
_PART = re.compile(f"{_LETTER}+|(?:(?!{_LETTER})[^{PLAIN}])+")


class _Table(dict):
    """Code point -> what it is written as. Filled as characters come, by rule: look-alike, ligature, blank, wide form."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in LOOK_ALIKES:
            out = LOOK_ALIKES[c]
        elif c in LIGATURES:
            out = LIGATURES[c]
        elif _IGNORED.match(c):
            out = ""
        elif unicodedata.category(c) == "Zs":
            out = " "
        elif unicodedata.decomposition(c).startswith(("<wide>", "<narrow>", "<font>")):
            out = "".join(LOOK_ALIKES.get(x, x) for x in unicodedata.normalize("NFKC", c))
        else:
            out = c
        self[code] = out
        return out


_TABLE = _Table()


def _plain(part: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", part).translate(_TABLE))


def _ends(text: str) -> str:
    return _LINE_END.sub(lambda m: "\n" if m.group().strip(" \t") else "", text)


def by_table(text: str) -> str:
    """The consistent form of any text, by the table alone."""
    return unicodedata.normalize("NFC", _ends(unicodedata.normalize("NFD", text).translate(_TABLE)))


class Vocabulary:
    """A trie of plain spellings, walked by the weighted edit automaton. `words` come with the most frequent first. A node is a
    dict from a plain character of the decomposed spelling to a node; under "" it has the spelling that ends there and its
    place among the words."""

    def __init__(self, words: Iterable[str], budget: float = BUDGET):
        self.root: dict = {}
        self.budget = budget
        for k, w in enumerate(words):
            node = self.root
            for c in unicodedata.normalize("NFD", w):
                node = node.setdefault(c, {})
            node.setdefault("", (unicodedata.normalize("NFC", w), k))

    @staticmethod
    def letters(c: str) -> list[tuple[str, float]]:
        """The plain strings that a character shows, with their costs; its own and those it looks like."""
        plain = unicodedata.normalize("NFD", _TABLE[ord(c)])
        return [(plain, 0.0)] + [(x, 0.0 if k == 0 and plain == c else RARER) for k, x in enumerate(READINGS.get(c, "")) if x != plain]

    def read(self, token: str) -> str | None:
        """The cheapest spelling that `token` can be read as within the budget, of equal ones the most frequent, or None.

        A state is a trie node with what it cost so far, the cheapest way only. An ignorable keeps the states; any other
        character moves each along the edges of its letters, and where the budget allows whole edits also along every edge
        (another letter, a letter missing in the token) or nowhere (a letter too many)."""
        states = self._reach({id(self.root): (0.0, self.root)})
        for c in unicodedata.normalize("NFD", token):
            if _IGNORED.match(c):
                continue
            after: dict[int, tuple[float, dict]] = {}
            for cost, node in states.values():
                for letters, more in self.letters(c):
                    at: dict | None = node
                    for x in letters:
                        at = at.get(x) if at is not None else None
                    self._put(after, cost + more, at)
                if cost + 1 <= self.budget:
                    self._put(after, cost + 1, node)
                    for x, at in node.items():
                        if x:
                            self._put(after, cost + 1, at)
            states = self._reach(after)
            if not states:
                return None
        found = [(cost, node[""][1], node[""][0]) for cost, node in states.values() if "" in node]
        return min(found)[2] if found else None

    def _put(self, states: dict[int, tuple[float, dict]], cost: float, node: dict | None) -> None:
        if node is not None and cost <= self.budget and (id(node) not in states or cost < states[id(node)][0]):
            states[id(node)] = (cost, node)

    def _reach(self, states: dict[int, tuple[float, dict]]) -> dict[int, tuple[float, dict]]:
        """`states` with those that letters missing in the token lead to."""
        todo = [x for x in states.values() if x[0] + 1 <= self.budget]
        while todo:
            cost, node = todo.pop()
            for x, at in node.items():
                if x:
                    known = states.get(id(at))
                    self._put(states, cost + 1, at)
                    if states.get(id(at)) is not known and cost + 2 <= self.budget:
                        todo.append((cost + 1, at))
        return states


class Canon:
    """Text -> consistent form, with the odd words seen so far kept up to a bound."""

    KEPT = 200_000

    def __init__(self, words: Iterable[str] = ()):
        self.vocabulary = Vocabulary(words)
        self.seen: dict[str, str] = {}

    def word(self, w: str) -> str:
        out = self.seen.get(w)
        if out is None:
            out = self.vocabulary.read(w)
            if out is None:
                out = _plain(w)
            if len(self.seen) >= self.KEPT:
                self.seen.clear()
            self.seen[w] = out
        return out

    def part(self, m: re.Match) -> str:
        w = m[0]
        return w if not _ODD.search(w) else self.word(w) if _WORD.match(w) else _plain(w)

    def __call__(self, text: str | None) -> str | None:
        if text is None or not _ODD_OR_TRAILING.search(text):
            return text
        if _ODD.search(text):
            text = _PART.sub(self.part, text)
        return unicodedata.normalize("NFC", _ends(text))


@cache
def _canon(words: tuple[str, ...]) -> Canon:
    return Canon(words)


def consistent(df: DataFrame, text: str, out: str = "forme", words: tuple[str, ...] = ()) -> DataFrame:
    """`df` with the consistent form of a text column as `out`. Null stays null, empty stays empty. All in one pass where the
    rows are; `words` is the vocabulary, a bounded list (see vocabulary())."""
    names, at = [*df.columns, out], df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = _canon(words)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([form(t) for t in b.column(at).to_pylist()], pa.string())], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out}` string")


def vocabulary(texts: DataFrame, col: str, size: int = 20_000, table_rows: int = 300_000) -> tuple[str, ...]:
    """The `size` most frequent plain words of all texts, the most frequent first: spellings for the trie.

    `size` bounds what goes to every task (a quarter of a megabyte); words beyond it go by the table. Each task counts what
    stands between blanks, and looks for words in that once per distinct one; its table is sent at `table_rows`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words: Counter = Counter()
            for token, n in seen.items():
                for w in _WORD.findall(token):
                    if not _ODD.search(w):
                        words[w] += n
            return pa.RecordBatch.from_pydict({"mot": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})

        for batch in batches:
            found = pc.value_counts(pc.utf8_split_whitespace(pc.drop_null(batch.column(0))).flatten())
            seen.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist())))
            if len(seen) > table_rows:
                yield flush()
                seen.clear()
        yield flush()

    counts = texts.select(col).mapInArrow(count, "mot string, n bigint").groupBy("mot").agg(F.sum("n").alias("n"))
    top = cut(counts.orderBy(F.desc("n"), "mot").limit(size))  # merged in a task, so that the driver gets one list of `size`
    return tuple(r.mot for r in sorted(top.collect(), key=lambda r: (-r.n, r.mot)))


DIGESTS = ("forme_a", "forme_b", "brut_a", "brut_b")


def same_look(df: DataFrame, key: str, text: str, group: list[str] | None = None, words: tuple[str, ...] = ()) -> DataFrame:
    """Rows of `df` with 128 bits, as two numbers, of a digest of the text's consistent form (`forme_a`, `forme_b`) and of the
    text as stored (`brut_a`, `brut_b`), beside `group`... and `key`.

    Texts are read, brought to their form and digested in one pass where they are; none is shuffled then or later. Rows
    with a null text or key are left out.
    """
    keep = [*(group or []), key]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = _canon(words)
        digest = lambda t: blake2b(t.encode("utf-8", "replace"), digest_size=16).digest()
        for b in batches:
            both = []
            for t in b.column(n).to_pylist():
                raw, f = digest(t), form(t)
                both.append((raw if f is t else digest(f)) + raw)
            four = np.frombuffer(b"".join(both), np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(four[:, k]) for k in range(4))], [*keep, *DIGESTS])

    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(*keep, F.col(text).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, fields + ", ".join(f"{c} bigint" for c in DIGESTS))


def _spellings(digests: DataFrame, key: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(members, spellings) of the forms that have two spellings or more, both cut: `by`..., the spelling and `key`, each once;
    and `by`..., the spelling, its members `__n` and the smallest, `__k`. A form with one spelling only, however many rows share
    it, is dropped by an aggregation that combines before the shuffle."""
    lo_hi = [f(c).alias(f"__{f.__name__}_{c}") for c in ("brut_a", "brut_b") for f in (F.min, F.max)]
    varied = digests.groupBy(*by).agg(*lo_hi).where("__min_brut_a != __max_brut_a or __min_brut_b != __max_brut_b").select(*by)
    members = cut(digests.join(varied, by, "left_semi").select(*by, "brut_a", "brut_b", key).distinct())
    return members, cut(members.groupBy(*by, "brut_a", "brut_b").agg(F.count(F.lit(1)).alias("__n"), F.min(key).alias("__k")))


def look_alike_pairs(digests: DataFrame, key: str, group: list[str] | None = None, part: int = 100_000) -> DataFrame:
    """Pairs of keys (`cle_a` < `cle_b`) whose texts differ as stored but have one form; `digests` from same_look().

    Spellings of a form are paired, not rows, so equal rows never meet; members are put in their spellings' place last. A
    spelling with many members is salted: they go by key to one place per `part` of them, and its pairs to each of these.
    """
    by = [*(group or []), "forme_a", "forme_b"]
    members, spellings = _spellings(digests, key, by)
    one, two = (spellings.withColumnsRenamed({"brut_a": f"__{x}1", "brut_b": f"__{x}2", "__n": f"__n{x}"}).drop("__k") for x in "pq")
    pairs = one.join(two, by).where("__p1 < __q1 or (__p1 = __q1 and __p2 < __q2)")
    salts = lambda n: F.ceil(F.col(n) / part).cast("int")
    held = members.join(spellings.where(F.col("__n") > part).select(*by, "brut_a", "brut_b", "__n"), [*by, "brut_a", "brut_b"], "left")
    held = held.withColumn("__s", F.when(F.col("__n").isNull(), 0).otherwise(F.pmod(F.xxhash64(key), salts("__n")).cast("int")))
    held = held.select(*by, "__s", "brut_a", "brut_b", key)
    for x, name in (("p", "__x"), ("q", "__y")):
        spread = pairs.withColumn("__s", F.explode(F.sequence(F.lit(0), salts(f"__n{x}") - 1)))
        pairs = spread.join(held.withColumnsRenamed({"brut_a": f"__{x}1", "brut_b": f"__{x}2", key: name}), [*by, "__s", f"__{x}1", f"__{x}2"]).drop("__s")
    out = pairs.where("__x != __y").select(*(group or []), F.least("__x", "__y").alias("cle_a"), F.greatest("__x", "__y").alias("cle_b"))
    return out.distinct()


def look_alike_classes(digests: DataFrame, key: str, group: list[str] | None = None) -> DataFrame:
    """`key`, `classe`, `graphie`, `liens`: of each row whose form has two spellings or more the smallest key of the form and of
    the spelling (a key's of several texts the smallest such), and how many rows of the class are spelled otherwise."""
    by = [*(group or []), "forme_a", "forme_b"]
    members, spellings = _spellings(digests, key, by)
    forms = spellings.groupBy(*by).agg(F.min("__k").alias("classe"), F.sum("__n").alias("__all"))
    rows = members.join(spellings.withColumnRenamed("__k", "graphie"), [*by, "brut_a", "brut_b"]).join(forms, by)
    best = rows.groupBy(*(group or []), key).agg(F.min(F.struct("classe", "graphie", (F.col("__all") - F.col("__n")).alias("liens"))).alias("__r"))
    return best.select(*(group or []), key, "__r.*")
