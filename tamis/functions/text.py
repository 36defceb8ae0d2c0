"""Text functions as Column expressions: folding, tokens, units, tags, citations. All of them stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.rulepack import DOMAIN_TERMS, LIST_OPENING, PRACTICE, STOP_WORDS, UPPER, UPPER_RUN

TOKEN = "[0-9a-z]+(?:-[0-9a-z]+)*"
SPACE = r"(?U)\s+"


def _fold_table() -> tuple[str, str, str]:
    """(characters, what each becomes, characters that vanish), by rule: compatibility decomposition without marks."""
    one, to = [], []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        c = chr(code)
        d = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        if len(d) == 1 and d != c and c == c.lower():
            one.append(c)
            to.append(d)
    return "".join(one), "".join(to), "".join(map(chr, range(0x300, 0x370)))


FOLD_FROM, FOLD_TO, FOLD_DROP = _fold_table()
# Ligatures that fold to several letters.
FOLD_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def fold(text: Column) -> Column:
    """Lower case without accents, wide forms and ligatures made plain. `œ` and `æ` stay, as they don't decompose."""
    plain = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), FOLD_LIGATURES.items(), F.lower(text))
    return F.translate(plain, FOLD_FROM + FOLD_DROP, FOLD_TO)


def fold_one_to_one(text: Column) -> Column:
    """Lower case without accents, each character one character, so that positions stay."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def fold_word(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower().replace("’", "'")) if not unicodedata.combining(c))


def tokens(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Index tokens: runs of letters and digits of the folded text; a hyphenated compound whole and in pieces; pieces of
    one letter and stop words dropped. Null gives null, empty text an empty array."""
    raw = F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))
    pieces = lambda t: F.filter(F.split(t, "-"), lambda p: (F.length(p) >= 2) | p.rlike("^[0-9]+$"))
    both = F.flatten(F.transform(raw, lambda t: F.when(F.instr(t, "-") > 0, F.concat(F.array(t), pieces(t))).otherwise(pieces(t))))
    return F.filter(both, lambda t: ~t.isin(*stop)) if stop else both


class Tokenizer:
    """tokens() of single texts in Python, for operators that count them where they are; runs are kept up to a bound."""

    KEPT = 300_000

    def __init__(self, stop: tuple[str, ...] = STOP_WORDS):
        self.stop, self.run = frozenset(stop), re.compile(TOKEN)
        self.table = str.maketrans(FOLD_FROM, FOLD_TO, FOLD_DROP)
        self.seen: dict[str, tuple[str, ...]] = {}

    def of_run(self, run: str) -> tuple[str, ...]:
        out = self.seen.get(run)
        if out is None:
            pieces = [p for p in run.split("-") if len(p) >= 2 or p.isdigit()]
            out = tuple(t for t in ([run, *pieces] if "-" in run else pieces) if t not in self.stop)
            if len(self.seen) >= self.KEPT:
                self.seen.clear()
            self.seen[run] = out
        return out

    def __call__(self, text: str) -> list[str]:
        t = text.lower()
        if not t.isascii():
            for a, b in FOLD_LIGATURES.items():
                t = t.replace(a, b)
            t = t.translate(self.table)
        return [x for r in self.run.findall(t) for x in self.of_run(r)]


def stop_list_collisions(stop: tuple[str, ...] = STOP_WORDS, terms: tuple[str, ...] = DOMAIN_TERMS) -> list[str]:
    """Domain terms that the stop list would drop; must be empty."""
    return sorted({fold_word(t) for t in terms} & set(stop))


def norm(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def preview(text: Column, n: int) -> Column:
    return F.left(norm(text), F.lit(n))


def units(text: Column) -> Column:
    """Citation units: lines that continue one another are joined (a lower-case letter, digit or one of (,;)’' at their
    start), a bullet is dropped, and sentences end at `.`, `!` or `?` before a capital; never at a colon."""
    lines = F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), "\n")
    joined = F.regexp_replace(lines, r"\n([\p{Ll}\p{Nd}(,;)’'])", " $1")
    bare = F.regexp_replace(joined, r"(^|\n)[-•*▪][ \t]*", "$1")
    cut = F.regexp_replace(bare, rf"([.!?])(?U:\s)+([{UPPER}])", "$1\n$2")
    return F.filter(F.transform(F.split(cut, "\n"), strip), lambda x: x != "")


# Forms of structural noise.
DOT_LEADERS = r"\.{4,}"
REFERENCE_LINE = r"^\s*(?:\[?\d{1,3}[\].)]\s*)?[A-Z][A-Za-zÀ-ſ'-]+,?\s+(?:[A-Z]\.?\s?){1,4}[,;(]"
REFERENCE_SIGN = r"(?i)doi|https?://"
REFERENCE_YEAR = r"\((?:19|20)\d\d[a-z]?\)|\b(?:19|20)\d\d[;.]"
KEYWORDS = r"(?i)\b(?:key\s?words?|mots\s?cl[eéEÉ]s?)\b\s*[:.]"


def structure(text: Column, leaders: int = 3, share: float = 0.5) -> Column:
    """`sommaire`, `bibliographie`, `mots_cles` or "", by the text's form only."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?U)\S"))
    reference = lambda x: x.rlike(REFERENCE_LINE) | ((F.length(x) < 130) & (x.rlike(REFERENCE_SIGN) | x.rlike(REFERENCE_YEAR)))
    listed = (F.size(lines) >= 3) & (F.size(F.filter(lines, reference)) >= share * F.size(lines))
    return F.when(text.isNull(), None).when(F.regexp_count(text, F.lit(DOT_LEADERS)) >= leaders, "sommaire").when(listed, "bibliographie").when(text.rlike(KEYWORDS), "mots_cles").otherwise("")


def truncate(unit: Column, most: int = 300, ellipsis: str = " […]") -> Column:
    """struct(verbatim, affichee, tronquee): a unit cut at a word's end within `most` characters; the ellipsis is shown only."""
    u = norm(unit)
    cut = F.regexp_replace(F.left(u, F.lit(most)), " [^ ]*$", "")
    long = F.length(u) > most
    verbatim = F.when(long, cut).otherwise(u)
    return F.struct(verbatim.alias("verbatim"), F.when(long, F.concat(cut, F.lit(ellipsis))).otherwise(u).alias("affichee"), long.alias("tronquee"))


def is_verbatim(citation: Column, text: Column) -> Column:
    """Whether the citation is in the text, white space aside."""
    return F.contains(norm(text), norm(citation))


def all_named(names: Column, text: Column) -> Column:
    """Whether all names are in the text, case aside; true for no names."""
    return F.forall(names, lambda n: F.contains(F.lower(text), F.lower(n)))


def contains_folded(needle: Column, text: Column) -> Column:
    return F.contains(fold(text), fold(needle))


def is_table_line(unit: Column) -> Column:
    return ~norm(unit).rlike(r"[.!?]$")


def is_prescriptive(unit: Column, practice: str = PRACTICE) -> Column:
    """Whether the unit opens with a practice verb, list marks aside."""
    return F.regexp_replace(strip(unit), LIST_OPENING, "").rlike("(?iu)^" + practice)


def upper_runs(text: Column) -> Column:
    """Names in capitals."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?U)" + UPPER_RUN), F.lit(0)), F.trim)


def numbers(text: Column) -> Column:
    """All whole numbers, thousands written with blanks joined."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, r"(?<=\d)(?U:\s)+(?=\d)", ""), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("bigint"))


def levels(text: Column) -> Column:
    """Expected levels of a label like "1+2", ascending; what is no number is left out."""
    return F.array_sort(F.array_compact(F.transform(F.split(text, r"\+"), lambda x: F.trim(x).try_cast("int"))))


def places(text: Column, lexicon: tuple[str, ...]) -> Column:
    """Places named, each a whole word, so that `Niger` isn't found in `Nigeria`."""
    return F.array_compact(F.array(*[F.when(text.rlike(rf"(?iuU)\b{p}" + ("" if p == "Tillab" else r"\b")), F.lit(p.replace("[eé]", "é"))) for p in lexicon]))


def provenance_line(p: dict[str, Column]) -> Column:
    """Publisher, « title », year, page and licence, with words for what is missing."""
    present = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws(
        ", ",
        F.coalesce(present(p["editeur"]), F.lit("editeur non renseigne")),
        F.concat(F.lit("« "), present(p["titre"]), F.lit(" »")),
        present(p["annee"]),
        F.concat(F.lit("page "), p["page"].cast("string")),
        F.coalesce(present(p["licence"]), F.concat(F.lit("licence non declaree dans le PDF (regime "), F.coalesce(p["regime"], F.lit("None")), F.lit(")"))),
    )
