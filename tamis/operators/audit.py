"""Audits: perimeter, provenance, offsets, coverage, sizes, vectors, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import norm
from tamis.functions.vectors import dot, from_int8, to_int8
from tamis.functions.vectors import norm as length_of
from tamis.operators.fusion import doc_key
from tamis.session import cut


def perimeter(sources: DataFrame) -> DataFrame:
    """`id`, `etat`: indexe, methodologique or exclu; a source given again counts once. Exclusion comes first."""
    excluded = F.coalesce(F.trim("exclusion") != "", F.lit(False))
    state = F.when(excluded, "exclu").when(F.coalesce(F.col("utilite_conseil") == "methodologique", F.lit(False)), "methodologique").otherwise("indexe")
    return sources.where("id is not null").select("id", state.alias("etat")).distinct()


def perimeter_counts(sources: DataFrame) -> DataFrame:
    """`etat`, `n`, `ids` (sorted)."""
    return perimeter(sources).groupBy("etat").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


def perimeter_overlap(sources: DataFrame) -> DataFrame:
    """`etat`, `n`, of the sources in each of the perimeter's overlapping sets: `sources` all, `methodologique`, `exclu`, `indexe`
    neither. A source that is methodological and excluded counts in both; one given again counts once."""
    ids = sources.where("id is not null").groupBy("id").agg(F.max(F.coalesce(F.trim("exclusion") != "", F.lit(False))).alias("x"), F.max(F.coalesce(F.col("utilite_conseil") == "methodologique", F.lit(False))).alias("m"))
    sets = F.array_compact(F.array(F.lit("sources"), F.when(F.col("m"), "methodologique"), F.when(F.col("x"), "exclu"), F.when(~F.col("x") & ~F.col("m"), "indexe")))
    return ids.select(F.explode(sets).alias("etat")).groupBy("etat").agg(F.count(F.lit(1)).alias("n"))


def exclusions(sources: DataFrame) -> DataFrame:
    """`entree`: `id:exclusion` of each excluded source, once; the reason without blanks around it."""
    return sources.where("id is not null and trim(exclusion) <> ''").select(F.concat("id", F.lit(":"), F.trim("exclusion")).alias("entree")).distinct()


def lock(sources: DataFrame, expected: dict[str, int]) -> None:
    """Raises if the perimeter's counts (`etat` -> n) aren't the expected ones."""
    found = {r.etat: r.n for r in perimeter(sources).groupBy("etat").agg(F.count(F.lit(1)).alias("n")).collect()}
    if found != expected:
        raise ValueError(f"perimeter {found}, expected {expected}")


def scope_check(sources: DataFrame, allowed: tuple[str, ...] = ("directe", "indirecte")) -> DataFrame:
    """`id`, `utilite_conseil` of indexed sources whose use isn't one of `allowed`."""
    return sources.join(perimeter(sources).where("etat = 'indexe'"), "id", "left_semi").where(~F.coalesce(F.col("utilite_conseil").isin(*allowed), F.lit(False))).select("id", "utilite_conseil").distinct()


def id_check(chunks: DataFrame, key: str = "i") -> DataFrame:
    """One row: rows, distinct keys, the smallest and largest key, and whether the keys are 0..n-1 without a gap."""
    a = chunks.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("cles"), F.min(key).alias("mini"), F.max(key).alias("maxi"))
    return a.withColumn("dense", F.coalesce((F.col("mini") == 0) & (F.col("maxi") == F.col("cles") - 1), F.lit(True)))


def page_containment(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """`i` of passages that don't lie within their page. `chunks`: i, doc, page, off; `pages`: doc, page, a, b."""
    p = pages.select("doc", "page", "a", "b")
    inside = (F.col("a") <= F.col("off.a")) & (F.col("off.b") <= F.col("b"))
    return chunks.join(p, ["doc", "page"], "left").groupBy("i").agg(F.max(F.coalesce(inside, F.lit(False))).alias("ok")).where("not ok").select("i")


def lines_with(docs: DataFrame, key: str, text: str, needles: list[str], begin: str | None = None, end: str | None = None) -> DataFrame:
    """`key`, `ligne` from 1, `mot`: lines that have a needle, case aside, those from a line with `begin` to one with `end` left out."""
    rows = docs.select(key, F.split(text, "\n").alias("ls"))
    if begin is not None and end is not None:
        inside = F.aggregate("ls", F.struct(F.lit(False).alias("on"), F.array().cast("array<boolean>").alias("f")), lambda s, x: F.struct(((s.on | F.contains(x, F.lit(begin))) & ~F.contains(x, F.lit(end))).alias("on"), F.array_append(s.f, s.on | F.contains(x, F.lit(begin))).alias("f")), lambda s: s.f)
    else:
        inside = F.transform("ls", lambda x: F.lit(False))
    lines = rows.select(key, F.posexplode(F.arrays_zip("ls", inside.alias("dedans"))).alias("k", "l"))
    low = F.lower("l.ls")
    return lines.where(~F.col("l.dedans")).select(key, (F.col("k") + 1).alias("ligne"), F.explode(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(n.lower())), F.lit(n)) for n in needles]))).alias("mot"))


def chunk_sizes(chunks: DataFrame, by: str, least: int = 220) -> DataFrame:
    """Sizes of the passages per `by`: n, sum, min, median (whole), mean (one decimal), max, and how many are below `least`."""
    n = F.length("texte")
    return chunks.where("texte is not null").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("total"), F.min(n).alias("mini"), F.floor(F.median(n)).cast("bigint").alias("mediane"), F.round(F.avg(n), 1).alias("moyenne"), F.max(n).alias("maxi"), F.count_if(n < least).alias("sous_mini"))


def below_minimum(chunks: DataFrame, least: int = 220) -> DataFrame:
    """`id`: `doc:pN` of each document and page with a passage below `least`, once and sorted; a missing doc or page is left blank."""
    place = F.concat(F.coalesce("doc", F.lit("")), F.lit(":p"), F.coalesce(F.col("page").cast("string"), F.lit("")))
    return chunks.where(F.length("texte") < least).select(place.alias("id")).distinct().orderBy("id")


def provenance_mismatches(chunks: DataFrame, sources: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """`champ`, `differences`: passages whose field isn't the registry's (null as ""), by resolved source; `champ` = `source`
    counts those without one."""
    reg = sources.where("id is not null").groupBy(doc_key(F.col("id")).alias("__k")).agg(F.min(F.struct(*fields)).alias("r"), F.lit(True).alias("ok"))
    both = chunks.withColumn("__k", doc_key(F.col("doc"))).join(reg, "__k", "left")
    bad = [F.count_if(F.col("ok") & (F.coalesce(F.col(f), F.lit("")) != F.coalesce(F.col(f"r.{f}"), F.lit("")))).alias(f) for f in fields]
    one = both.agg(*bad, F.count_if(F.col("ok").isNull()).alias("source"))
    names = [*fields, "source"]
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("champ", "differences"))


def interval_coverage(rows: DataFrame, group: str, a: str, b: str, stretch: int = 100_000) -> DataFrame:
    """Per group: the length covered by the union of [a, b), touching intervals joined, the islands, the whole span and the
    share of it covered. Null or empty intervals are left out.

    Intervals are cut at the borders of stretches of positions and united within each, whatever the group's size: of those that
    start at one position the longest counts, so a stretch has as many rows as positions at most. What goes on are sums per
    stretch, and the borders that an island reaches from either side, where two islands are one.
    """
    spans = rows.select(group, F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a < b").groupBy(group, "a").agg(F.max("b").alias("b"))
    t = F.explode(F.sequence(F.floor(F.col("a") / stretch), F.floor((F.col("b") - 1) / stretch)))
    cuts = spans.withColumn("t", t).select(group, "t", F.greatest("a", F.col("t") * stretch).alias("a"), F.least("b", (F.col("t") + 1) * stretch).alias("b"))
    before = F.max("b").over(Window.partitionBy(group, "t").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    fresh = cuts.withColumn("haut", before)
    per = fresh.groupBy(group, "t").agg(F.sum(F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce("haut", F.col("a"))))).alias("couvert"), F.count_if(F.col("haut").isNull() | (F.col("a") > F.col("haut"))).alias("iles"), F.min("a").alias("a"), F.max("b").alias("b"))
    edges = F.array_compact(F.array(F.when(F.col("a") == F.col("t") * stretch, F.col("t")), F.when(F.col("b") == (F.col("t") + 1) * stretch, F.col("t") + 1)))
    per = cut(per.withColumn("bords", edges))
    joined = per.select(group, F.explode("bords").alias("bord")).groupBy(group, "bord").count().where("count = 2").groupBy(group).agg(F.count(F.lit(1)).alias("joints"))
    out = per.groupBy(group).agg(F.sum("couvert").alias("couvert"), F.sum("iles").alias("iles"), (F.max("b") - F.min("a")).alias("etendue"))
    same = out[group].eqNullSafe(joined[group])
    out = out.join(joined, same, "left").select(out[group], "couvert", (F.col("iles") - F.coalesce("joints", F.lit(0))).alias("iles"), "etendue")
    return out.withColumn("part", F.round(F.col("couvert") / F.col("etendue"), 6))


def offset_check(chunks: DataFrame) -> DataFrame:
    """One row: passages whose offsets are backward, whose offsets' width isn't the text's length, whose `car` isn't, and
    that hold a page marker."""
    n = F.length("texte")
    c = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    return chunks.agg(F.count(F.lit(1)).alias("n"), c(F.col("off.a") > F.col("off.b")).alias("inverses"), c(F.col("off.b") - F.col("off.a") != n).alias("largeur_differente"), c(F.col("car") != n).alias("car_different"), c(F.col("texte").rlike(r"\[\[page \d+\]\]")).alias("avec_marqueur"))


def shared_edges(chunks: DataFrame, chars: int = 60) -> DataFrame:
    """One row: all passages (`n`), those whose last `chars` characters a neighbour on the page repeats (`queue`), whose first
    a neighbour has (`tete`), and either (`union`). Neighbours are met by number, so a large document or page is no hot key."""
    rows = chunks.where("doc is not null and page is not null and texte is not null").select("i", "doc", "page", norm(F.col("texte")).alias("t"))
    edges = rows.where("t != ''").select("i", "doc", "page", F.right("t", F.lit(chars)).alias("q"), F.left("t", F.lit(chars)).alias("h"))
    near = edges.select("*", F.explode(F.array(F.col("i") - 1, F.col("i") + 1)).alias("j"))
    met = near.join(rows.select(F.col("i").alias("j"), "doc", "page", "t"), ["j", "doc", "page"], "left")
    has = lambda c: F.max(F.coalesce(F.contains("t", c), F.lit(False)))
    each = met.groupBy("i").agg(has(F.col("q")).alias("q"), has(F.col("h")).alias("h"))
    found = each.agg(F.count_if("q").alias("queue"), F.count_if("h").alias("tete"), F.count_if(F.col("q") | F.col("h")).alias("union"))
    return chunks.agg(F.count(F.lit(1)).alias("n")).crossJoin(found)


def norm_deviation(rows: DataFrame, vector: str, tolerance: float = 1e-3) -> DataFrame:
    """One row: vectors, the largest deviation of a norm from 1, and how many exceed `tolerance`."""
    d = F.abs(length_of(F.col(vector)) - 1)
    return rows.where(F.col(vector).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(d), 6).alias("ecart_max"), F.count_if(d > tolerance).alias("hors_tolerance"))


def int8_error(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """`key`, `erreur`: difference of each vector's product with itself before and after storage in eight bits."""
    q = from_int8(to_int8(F.col(vector)))
    return rows.select(key, F.round(F.abs(dot(F.col(vector), F.col(vector)) - dot(F.col(vector), q)), 6).alias("erreur"))


def cache_misses(rows: DataFrame, cache: DataFrame, text: str, pooling: str = "cls") -> DataFrame:
    """`cle`: digests of the distinct texts of `rows` that `cache` (its `text`) doesn't have."""
    digest = lambda df: df.where(F.col(text).isNotNull()).select(F.sha2(F.concat_ws("|", F.lit(pooling), F.octet_length(text).cast("string"), F.col(text)), 256).alias("cle")).distinct()
    return digest(rows).join(digest(cache), "cle", "left_anti")


def id_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """`cle`, `cote`: keys (first column of each) in one table only."""
    x, y = a.select(F.col(a.columns[0]).alias("cle")).distinct(), b.select(F.col(b.columns[0]).alias("cle")).distinct()
    return x.join(y, "cle", "left_anti").withColumn("cote", F.lit("gauche")).unionByName(y.join(x, "cle", "left_anti").withColumn("cote", F.lit("droite")))


def page_order(rows: DataFrame, group: str, order: str, page: str) -> DataFrame:
    """`group`, `reculs`: how often the page number goes down along `order`, whose values are distinct.

    Rows are sorted globally by range, so a large group lies across partitions; each partition counts within itself, and of
    its groups' first and last rows only meet the next partition's."""
    known = rows.where(F.col(group).isNotNull() & F.col(page).isNotNull()).select(group, order, page)
    sorted_rows = cut(known.repartitionByRange(group, order)).withColumn("__p", F.spark_partition_id())
    before = F.lag(page).over(Window.partitionBy("__p", group).orderBy(order))
    per = sorted_rows.withColumn("__l", before).groupBy(group, "__p").agg(F.count_if(F.col(page) < F.col("__l")).alias("n"), F.min_by(page, order).alias("f"), F.max_by(page, order).alias("l"))
    edge = (F.col("f") < F.lag("l").over(Window.partitionBy(group).orderBy("__p"))).cast("int")
    return per.withColumn("e", F.coalesce(edge, F.lit(0))).groupBy(group).agg(F.sum(F.col("n") + F.col("e")).alias("reculs"))


def profiler_scores(tok_s: float, reference: float, rss_mb: float, limit_gb: float, unit: int = 1024) -> tuple[float, float]:
    """(speed score, memory score), each at most 100; `unit` says how many MB are a GB."""
    return min(100.0, 100.0 * tok_s / reference), max(0.0, 100.0 * (1 - rss_mb / unit / limit_gb))
