"""BM25: statistics, postings and batch search."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions.rulepack import STOP_WORDS
from tamis.functions.text import Tokenizer, tokens
from tamis.session import BROADCAST_ROWS, cut, ship, small

K1, B = 1.2, 0.75

#: Documents in a block of counts, and queries in a block of queries, at most.
DOCS, QUERIES = 65_536, 4_096

#: Partitions of blocks that one task of a search takes, unless the cores would have fewer than TASKS each, and candidates that it
#: holds before they go on.
PARTS, TASKS, HELD = 16, 4, 1_000_000

#: With more than QUERIES queries, these in a group that meets all blocks, at most, and partitions of blocks in one such task.
GROUP, TURN = 16_384, 32

#: A term that one of OFTEN documents of a block has lies as a row over them, ROWS rows at most (64 MB).
OFTEN, ROWS = 50, 256


def counted(docs: DataFrame, key: str, text: str, stop: tuple[str, ...] = STOP_WORDS, only: tuple[str, ...] | None = None) -> DataFrame:
    """`key`, `terme`, `tf`, `dl`: the terms of each document, and for each document, also one without tokens, a row with null
    `terme`. With `only`, other terms are left out where they are counted. A document's tokens are counted where it is: no
    shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, wanted = Tokenizer(stop), None if only is None else frozenset(only)
        for batch in batches:
            row, term, tf, dl = [], [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                found = of(t) if t else []
                n = Counter(found if wanted is None else filter(wanted.__contains__, found))
                row += [r] * (len(n) + 1)
                term += [None, *n]
                tf += [0, *n.values()]
                dl += [len(found)] * (len(n) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(term, pa.string()), pa.array(tf, pa.int32()), pa.array(dl, pa.int32())], [key, "terme", "tf", "dl"])

    ship(docs.sparkSession)
    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, terme string, tf int, dl int")


def lengths(docs: DataFrame, key: str, text: str, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """`key`, `dl`: index tokens of each document; 0 for a null or empty text."""
    return counted(docs, key, text, stop, ()).select(key, "dl")


def postings(docs: DataFrame, key: str, text: str, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """`key`, `terme`, `tf`, `dl`."""
    return counted(docs, key, text, stop).where("terme is not null")


def counted_for(docs: DataFrame, key: str, text: str, terms: DataFrame, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """counted() of the terms in `terms` (cut), whose list goes to the tasks if it is short, and is joined otherwise."""
    wanted = terms.select("terme").distinct()
    some = [r.terme for r in wanted.limit(BROADCAST_ROWS + 1).collect()]
    if len(some) <= BROADCAST_ROWS:
        return counted(docs, key, text, stop, tuple(some))
    rows = counted(docs, key, text, stop)
    return rows.where("terme is null").unionByName(rows.join(wanted, "terme", "left_semi").select(*rows.columns))


def posting_lists(posting: DataFrame, key: str, width: int = 100_000) -> DataFrame:
    """`terme`, `bloc`, `liste`: the postings of each term as lists of structs (`key`, `tf`) in order of the key, one list per
    `width` keys, so that no list grows with the collection. `key` is a number."""
    return posting.groupBy("terme", F.floor(F.col(key) / width).alias("bloc")).agg(F.sort_array(F.collect_list(F.struct(key, "tf"))).alias("liste"))


def corpus_stats(doc_lengths: DataFrame) -> DataFrame:
    """One row: `n` documents, `avgdl` (0 if there are none)."""
    return doc_lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def term_stats(posting: DataFrame) -> DataFrame:
    """`terme`, `df`, `cf`."""
    return posting.groupBy("terme").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def idf(df: Column, n: Column | int) -> Column:
    return F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5)) if isinstance(n, int) else F.log(1 + (n - df + 0.5) / (df + 0.5))


def idf_ceiling(n: Column) -> Column:
    """The idf of a term in no document; the weight of what the corpus doesn't have."""
    return F.log(1 + (n + 0.5) / 0.5)


def query_terms(queries: DataFrame, query: str, text: str, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """`query`, `terme`: the distinct tokens of each query."""
    return queries.select(query, F.explode(F.array_distinct(tokens(F.col(text), stop))).alias("terme")).distinct()


def top(scored: DataFrame, query: str, key: str, score: str, k: int, rank: str = "rang") -> DataFrame:
    """The `k` best rows of each query by (score desc, key asc), ranked from 1."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0, in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64) if n else np.empty(0, np.int64)


class _Numbers(dict):
    """Numbers terms in the order in which they are asked for."""

    def __missing__(self, term: str) -> int:
        self[term] = n = len(self)
        return n


def _counted_blocks(batches: Iterable[pa.RecordBatch], of: Tokenizer, numbers: Callable[[], Callable[[list[str]], Iterable[int]]]) -> Iterator[tuple]:
    """(keys in their order, lengths, terms' numbers, their numbers of postings, postings' places in the keys, their counts) of
    at most DOCS documents; the postings lie by term. `numbers` gives, for each block, what numbers tokens; below 0 they are
    left out."""
    keys: list = []
    lens: list = []
    ids: list = []
    number = numbers()

    def flush() -> tuple:
        key, dl = pa.concat_arrays(keys), np.concatenate(lens)
        order = pc.array_sort_indices(key, null_placement="at_start").to_numpy()
        place = np.empty(len(key), np.int64)
        place[order] = np.arange(len(key))
        of_term, of_doc = np.concatenate(ids), np.repeat(place, dl)
        both, tf = np.unique((of_term * DOCS + of_doc)[of_term >= 0], return_counts=True)
        terms, sizes = np.unique(both // DOCS, return_counts=True)
        keys.clear(), lens.clear(), ids.clear()
        return key.take(pa.array(order)), dl[order], terms, sizes, both % DOCS, tf

    for batch in batches:
        for lo in range(0, batch.num_rows, DOCS):
            part = batch.slice(lo, DOCS)
            if keys and sum(map(len, keys)) + len(part) > DOCS:
                yield flush()
                number = numbers()
            each, own = [], []
            for t in part.column(1).to_pylist():
                found = of(t) if t else []
                each.append(len(found))
                own += number(found)
            keys.append(part.column(0))
            lens.append(np.array(each, np.int64))
            ids.append(np.array(own, np.int64))
    if keys:
        yield flush()


#: Columns of a block of counts after its keys: numbers packed, and how many there are.
_BLOCK = "dl binary, m int, termes binary, tailles binary, p int, ou binary, tf binary"


def _block(key: pa.Array, dl: np.ndarray, terms: np.ndarray, sizes: np.ndarray, at: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    packed = {"dl": dl, "m": len(terms), "termes": terms, "tailles": sizes, "p": len(at), "ou": at, "tf": tf}
    cols = [pa.array([v], pa.int32()) if isinstance(v, int) else pa.array([_pack(v)], pa.binary()) for v in packed.values()]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key), *cols], ["cles", *packed])


def _query_groups(terms: DataFrame, query: str) -> Iterator[tuple[DataFrame, list[str]]]:
    """(`query`, `terme` of some queries, their distinct terms): all at once unless there are more than BROADCAST_ROWS terms, as
    each task gets the list."""
    pairs, groups = 0, 1
    if len(terms.select("terme").distinct().limit(BROADCAST_ROWS + 1).collect()) > BROADCAST_ROWS:
        pairs = terms.count()
        groups = -(-pairs // BROADCAST_ROWS)
    for g in range(groups):
        own = terms.where(F.pmod(F.xxhash64(query), F.lit(groups)) == g) if pairs else terms
        yield own, sorted(r.terme for r in own.select("terme").distinct().collect())


def search(docs: DataFrame, queries: DataFrame, key: str, text: str, query: str, query_text: str, k: int = 60, k1: float = K1, b: float = B, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """`query`, `key`, `score`, `rang`: Okapi BM25 of each query against all `docs`, its `k` best.

    A query counts each of its terms once; documents that share none don't come out. Of the documents only counts of
    the queries' terms are kept, in blocks of packed numbers; each block is scored for every query where it is, and of a task's
    blocks only `k` candidates a query (and ties) go on. Keys are distinct. An empty collection, or no queries, give no rows. For many searches
    of one collection see write_index().
    """
    ship(docs.sparkSession)
    rows = docs.select(key, text)
    kind, found = rows.schema[0].dataType.simpleString(), []
    for own, words in _query_groups(cut(query_terms(queries, query, query_text, stop)), query):

        def run(batches: Iterator[pa.RecordBatch], words: list[str] = words) -> Iterator[pa.RecordBatch]:
            known = {t: n for n, t in enumerate(words)}
            for x in _counted_blocks(batches, Tokenizer(stop), lambda: lambda tokens: map(known.get, tokens, repeat(-1))):
                yield _block(*x)

        blocks = cut(rows.mapInArrow(run, f"cles array<{kind}>, {_BLOCK}"))
        size = blocks.agg(F.coalesce(F.sum(F.size("cles")), F.lit(0)).alias("n")).first().n
        found.append(_scored(blocks, size, None, own, words, query, key, kind, k, k1, b))
    return _union(found)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _totals(blocks: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """(documents that have each term, tokens of all documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(terms + 1, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                n[_unpack(r["termes"], r["m"])] += _unpack(r["tailles"], r["m"])
                n[terms] += _unpack(r["dl"], r["d"]).sum()
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["t", "n"])

    out = np.zeros(terms + 1, np.int64)
    for r in blocks.select(F.size("cles").alias("d"), "dl", "m", "termes", "tailles").mapInArrow(run, "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect():
        out[r.t] = r.n
    return out[:terms], int(out[terms])


class _Scores:
    """A block of counts, ready for queries. Terms that many of its documents have lie as rows over all documents, in single
    precision; sums of these find the documents that may be good enough, whose scores are then summed exactly."""

    def __init__(self, n: int, m: int, p: int, terms: bytes, sizes: bytes, at: bytes, tf: bytes, dl: bytes, weight: np.ndarray, mean: float, k1: float, b: float) -> None:
        self.n, self.own = n, _unpack(terms, m)
        size, self.at, count = _unpack(sizes, m), _unpack(at, p), _unpack(tf, p)
        value = np.repeat(weight[self.own], size) * count * (k1 + 1) / (count + (k1 * (1 - b + b * _unpack(dl, n) / mean))[self.at])
        self.value, self.sums = value.astype(np.float32), np.empty(n, np.float32)
        end = np.cumsum(size)
        self.start, self.end = (end - size).tolist(), end.tolist()
        self.most = np.maximum.reduceat(value, end - size) if m else np.empty(0)
        often = np.nonzero(size * OFTEN > n)[0]
        often = often[np.argsort(-size[often], kind="stable")][:ROWS]
        self.row, self.rows = np.full(m, -1), np.zeros((len(often), n), np.float32)
        self.row[often] = np.arange(len(often))
        for r, t in enumerate(often.tolist()):
            part = slice(self.start[t], self.end[t])
            self.rows[r, self.at[part]] = self.value[part]
        by_doc = np.argsort(self.at.astype(np.uint16), kind="stable")  # of a document, its terms in their order
        self.term, self.exact = np.repeat(np.arange(m, dtype=np.int32), size)[by_doc], value[by_doc]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.at, minlength=n))))
        self.asked = np.zeros(m, bool)

    def above(self, mine: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the documents whose score for the terms at `mine` may, rounded, reach `least` (0: may be one of
        the block's `k` best)."""
        upper = self.most[mine].sum()
        slack = 2e-6 + 1.2e-7 * (len(mine) + 1) * upper
        if upper < least - slack:
            return mine[:0], mine[:0]
        s, row = self.sums, self.row[mine]
        rows = row[row >= 0].tolist()
        if len(rows) > 1:
            np.add(self.rows[rows[0]], self.rows[rows[1]], out=s)
        elif rows:
            s[:] = self.rows[rows[0]]
        else:
            s.fill(0)
        for r in rows[2:]:
            s += self.rows[r]
        for t in mine[row < 0].tolist():
            part = slice(self.start[t], self.end[t])
            s[self.at[part]] += self.value[part]
        if not least and self.n > k:
            least = np.partition(s, self.n - k)[self.n - k] - slack
        near = np.nonzero(s > max(least - slack, 0.0))[0]
        if not len(near):
            return near, near
        first = self.first[near]
        n = self.first[near + 1] - first
        end = np.cumsum(n)
        at = np.repeat(first - end + n, n) + np.arange(end[-1])
        self.asked[mine] = True
        has = self.asked[self.term[at]]
        self.asked[mine] = False
        return near, np.bincount(np.repeat(np.arange(len(near)), n)[has], self.exact[at[has]], len(near))


def _scored(blocks: DataFrame, n: int, avgdl: float | None, terms: DataFrame, words: list[str], query: str, key: str, kind: str, k: int, k1: float, b: float) -> DataFrame:
    """The search over blocks of counts (cut) of `n` documents, `avgdl` tokens each (null: as in the blocks), for the queries'
    `terms` (`query`, `terme`), numbered by their places in `words`."""
    df, tokens_all = _totals(blocks, len(words))
    mean = (tokens_all / n if n else 0.0) if avgdl is None else avgdl
    mean, weight = mean or 1.0, np.log(1 + (n - df + 0.5) / (df + 0.5))
    of_query = terms.schema[query].dataType.simpleString()
    sc = blocks.sparkSession.sparkContext
    asked = terms.groupBy(query).agg(F.collect_list("terme").alias("t")).select(query, "t")
    n_asked = asked.count()
    groups = max(2 * sc.defaultParallelism, -(-n_asked // GROUP)) if n_asked > QUERIES else 0
    most = GROUP if groups else QUERIES

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: i for i, t in enumerate(words)}
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                of = [sorted(known[t] for t in ts) for ts in part.column(1).to_pylist()]
                sizes, ids = np.array([len(x) for x in of], np.int64), np.array([i for x in of for i in x], np.int64)
                cols = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0)), pa.array([_pack(sizes)], pa.binary()), pa.array([len(ids)], pa.int32()), pa.array([_pack(ids)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["q", "qn", "qp", "qt"])

    asked = asked.repartition(groups) if groups else asked
    asked = cut(asked.mapInArrow(ask, f"q array<{of_query}>, qn binary, qp int, qt binary")).withColumn("qb", F.xxhash64("q", "qt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # the k best scores of each query so far, and the least of them
        held: list[tuple] = []
        n_held, last, block = 0, None, None

        def flush() -> Iterator[pa.RecordBatch]:
            for qb, q, out in held:
                yield out.filter(pa.array(out.column(2).to_numpy() >= best[qb][1][q]))
            held.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                x = {name: batch.column(name)[r] for name in batch.schema.names}
                keys, asking = x["cles"].values, x["q"].values
                raw = [x[c].as_py() for c in ("m", "p", "termes", "tailles", "ou", "tf", "dl")]
                if raw != last:
                    last, block = raw, _Scores(len(keys), *raw, weight, mean, k1, b)
                ids = _unpack(x["qt"].as_py(), x["qp"].as_py())
                place = np.minimum(np.searchsorted(block.own, ids), max(len(block.own) - 1, 0))
                has = block.own[place] == ids if len(block.own) else np.zeros(len(ids), bool)
                stop_at = np.cumsum(_unpack(x["qn"].as_py(), len(asking))).tolist()
                top_of, least = best.setdefault(qb := x["qb"].as_py(), (np.zeros((len(asking), k)), np.zeros(len(asking))))
                which, docs, scores = [], [], []
                lo = 0
                for j, hi in enumerate(stop_at):
                    mine = place[lo:hi][has[lo:hi]]
                    lo = hi
                    near, score = block.above(mine, least[j], k) if len(mine) else (mine, mine)
                    if not len(near):
                        continue
                    score = np.round(score, 6)
                    top_of[j] = np.partition(np.concatenate((top_of[j], score)), len(near))[len(near) :]
                    least[j] = top_of[j].min()
                    good = score >= least[j]
                    near, score = near[good], score[good]
                    if len(near) > k:
                        first = np.lexsort((near, -score))[:k]
                        near, score = near[first], score[first]
                    which.append(np.full(len(near), j))
                    docs.append(near)
                    scores.append(score)
                if which:
                    q, d, s = (np.concatenate(v) for v in (which, docs, scores))
                    held.append((qb, q, pa.RecordBatch.from_arrays([asking.take(pa.array(q)), keys.take(pa.array(d)), pa.array(s, pa.float64())], [query, key, "score"])))
                    n_held += len(q)
                    if n_held > HELD:
                        yield from flush()
                        n_held = 0
        yield from flush()

    parts = blocks.rdd.getNumPartitions()
    if groups:  # the pairs come queries first: a task takes few queries and up to TURN partitions of blocks one after the other
        pairs = asked.crossJoin(blocks.hint("shuffle_replicate_nl")).coalesce(groups * -(-parts // TURN))
    else:
        pairs = blocks.coalesce(max(TASKS * sc.defaultParallelism, -(-parts // PARTS))).crossJoin(small(asked))
    return top(pairs.mapInArrow(run, f"`{query}` {of_query}, `{key}` {kind}, score double"), query, key, "score", k)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("terme"), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, key: str, text: str, path: str, stop: tuple[str, ...] = STOP_WORDS, buckets: int = 256, parts: int = 4) -> None:
    """Writes the postings of `docs` under `path`, in a folder per bucket of terms and there in their order, the documents' keys
    and lengths, and the corpus's statistics. A row holds a term's postings in one block of documents, packed: places in the
    block's keys, and counts. A search then reads the buckets of its terms only, and in them the row groups that may hold one.
    A bucket lies in `parts` files by block, so that a frequent term is no task's alone; more terms or documents want more of
    both."""
    ship(docs.sparkSession)
    given = docs.select(key, text)
    kind = given.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, numbers = TaskContext.get().partitionId() << 32, _Numbers()

        def fresh() -> Callable[[list[str]], Iterable[int]]:
            nonlocal numbers
            numbers = _Numbers()
            own = numbers.__getitem__
            return lambda tokens: map(own, tokens)

        for keys, dl, terms, sizes, at, tf in _counted_blocks(batches, Tokenizer(stop), fresh):
            words, n, ends = list(numbers), len(terms), np.cumsum(sizes)
            ou, counts = ([_pack(v[e - s : e]) for s, e in zip(sizes, ends)] for v in (at, tf))
            lists = pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(keys)], pa.int32()), keys)
            none = pa.array([True] * n + [False])
            lists = pc.if_else(none, pa.scalar(None, lists.type), lists)
            cols = [pa.array([block] * (n + 1), pa.int64()), pa.array([words[t] for t in terms] + [None], pa.string()), pa.array([*sizes, len(keys)], pa.int32()), pa.array([*ou, None], pa.binary()), pa.array([*counts, None], pa.binary()), lists, pa.array([None] * n + [_pack(dl)], pa.binary()), pa.array([None] * n + [int(dl.sum())], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["bloc", "terme", "n", "ou", "tf", "cles", "dl", "mots"])
            block += 1

    both = cut(given.mapInArrow(run, f"bloc bigint, terme string, n int, ou binary, tf binary, cles array<{kind}>, dl binary, mots bigint"))
    rows = both.where("terme is not null").select("bloc", "terme", "n", "ou", "tf").withColumn("seau", _bucket(buckets))
    rows.repartition("seau", F.pmod(F.xxhash64("bloc"), F.lit(parts))).sortWithinPartitions("seau", "terme").write.mode("overwrite").partitionBy("seau").parquet(f"{path}/postings")
    docs_of = both.where("terme is null")
    docs_of.select("bloc", "cles", "dl").write.mode("overwrite").parquet(f"{path}/documents")
    n, words = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("mots"), F.lit(0))
    stats = docs_of.agg(n.alias("n"), F.when(n > 0, words / n).otherwise(0.0).alias("avgdl"))
    stats.withColumns({"seaux": F.lit(buckets), "cle": F.lit(kind)}).coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")


def search_index(spark: SparkSession, path: str, queries: DataFrame, query: str, query_text: str, key: str = "i", k: int = 60, k1: float = K1, b: float = B, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """search() over what write_index() wrote: no text is read."""
    ship(spark)
    known = spark.read.parquet(f"{path}/corpus").first()
    docs = spark.read.schema(f"bloc bigint, cles array<{known.cle}>, dl binary").parquet(f"{path}/documents")
    found = []
    for own, words in _query_groups(cut(query_terms(queries, query, query_text, stop)), query):
        asked = own.select("terme", _bucket(known.seaux).alias("seau")).distinct()
        rows = spark.read.schema("bloc bigint, terme string, n int, ou binary, tf binary, seau int").parquet(f"{path}/postings")
        if len(words) <= 1_000:
            rows = rows.where(F.col("seau").isin([r.seau for r in asked.select("seau").distinct().collect()]) & F.col("terme").isin(words))
        else:
            rows = rows.join(small(cut(asked)), ["seau", "terme"], "left_semi")
        lists = rows.groupBy("bloc").agg(F.collect_list(F.struct("terme", "n", "ou", "tf")).alias("l"))

        def run(batches: Iterator[pa.RecordBatch], words: list[str] = words) -> Iterator[pa.RecordBatch]:
            number = {t: i for i, t in enumerate(words)}
            for batch in batches:
                for r in range(batch.num_rows):
                    keys, dl = batch.column(0)[r].values, batch.column(1)[r].as_py()
                    own = sorted(((number[x["terme"]], x["n"], x["ou"], x["tf"]) for x in batch.column(2)[r].as_py()), key=lambda x: x[0])
                    at, tf = (np.concatenate([_unpack(x[c], x[1]) for x in own]) for c in (2, 3))
                    yield _block(keys, _unpack(dl, len(keys)), np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int64), at, tf)

        blocks = cut(docs.join(lists, "bloc").select("cles", "dl", "l").mapInArrow(run, f"cles array<{known.cle}>, {_BLOCK}"))
        found.append(_scored(blocks, known.n, known.avgdl, own, words, query, key, known.cle, k, k1, b))
    return _union(found)
