"""Problem 7: mixing sources to target weights.

Hierarchical budgeting. A mixture's weights are its leaves' (the sources); the leaves hang on a tree whose inner levels
are columns: the source's subject area and its language (see levels_of()), or any others. Every node has the share of the
total that its leaves' weights give. What a leaf can't deliver, even repeated as often as allowed, goes to its siblings by
their weights as far as they have room, then to its parent's siblings, and so on to the root. A leaf falls short if its
budget is below its share, which by this rule happens to exactly the leaves that lack tokens. Each leaf's budget is then met
by whole epochs and, of one more epoch in an order seeded by mixture and epoch, the prefix whose tokens fit.

The order is by a hash, so the prefix needs no sort of a source: tokens are summed by the hash's leading bits, all
buckets that fit are taken whole, and only the one bucket that the budget ends in is sorted.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.tokens import count_tokens
from tamis.session import cut, small

BUCKETS = 4_096


def targets(melange: DataFrame) -> DataFrame:
    """`melange`, `source`, `poids`, `repetitions_max`: one row each. Equal rows count once; further rows of one source add
    their weights and allow the larger repetition. A null or negative weight is 0, a null repetition 1."""
    rows = melange.select("melange", "source", "poids", "repetitions_max").where("melange is not null and source is not null").distinct()
    return rows.groupBy("melange", "source").agg(F.sum(F.greatest(F.coalesce("poids", F.lit(0.0)), F.lit(0.0))).alias("poids"), F.max(F.greatest(F.coalesce("repetitions_max", F.lit(1)), F.lit(0))).alias("repetitions_max"))


def document_tokens(documents: DataFrame, wanted: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """`doc_id`, `source`, `jetons` of the documents of the `wanted` sources."""
    docs = documents.join(small(cut(wanted.select("source").distinct())), "source", "left_semi")
    return count_tokens(docs, "text", ["doc_id", "source"], name, folder)


def share_out(total: float, weight: list[float], room: list[float]) -> list[float]:
    """`total` by `weight`, none above its `room`; what is over goes to the others by weight. Sums to the total or to all room."""
    got, free = [0.0] * len(weight), {k for k, w in enumerate(weight) if w > 0 and room[k] > 0}
    left = total
    while left > 1e-9 and free:
        sum_w = sum(weight[k] for k in free)
        full = {k for k in free if got[k] + left * weight[k] / sum_w >= room[k]}
        if not full:
            for k in free:
                got[k] += left * weight[k] / sum_w
            break
        for k in full:
            left -= room[k] - got[k]
            got[k] = room[k]
        free -= full
        left = total - sum(got)
    return got


def budget_tree(leaves: list[tuple[tuple, float, float]], total: float) -> dict[tuple, float]:
    """Budgets of `leaves` (path, weight, room). Each node first gets its share, as far as its room goes; what its
    children can't take stays among them as long as one has room, and passes to the node's siblings only then."""

    def fill(rows: list[tuple[tuple, float, float]], amount: float, depth: int) -> dict[tuple, float]:
        if len(rows) == 1 and depth >= len(rows[0][0]):
            return {rows[0][0]: min(amount, rows[0][2])}
        below = defaultdict(list)
        for r in rows:
            below[r[0][depth]].append(r)
        names = sorted(below, key=repr)
        got = share_out(amount, [sum(r[1] for r in below[n]) for n in names], [sum(r[2] for r in below[n] if r[1] > 0) for n in names])
        return {p: b for n, g in zip(names, got) for p, b in fill(below[n], g, depth + 1).items()}

    return fill(leaves, total, 0) if leaves else {}


def budgets(wanted: DataFrame, per_source: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Per mixture and source: `jetons` (its documents once), `cible` (its share of the mixture's tokens), `budget` (after
    redistribution), `epoques` (whole ones), `reste` (tokens of the partial one), `manque` (true if the budget is below
    `cible`). `levels`: columns of `wanted` above the source, from the root. A mixture's leaves meet in one
    task: they are the rows of the mixture table, not documents."""
    levels = levels or []
    rows = wanted.join(per_source, "source", "left").withColumn("jetons", F.coalesce("jetons", F.lit(0)).cast("bigint"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        total, weights = float(pdf.jetons.sum()), float(pdf.poids.sum())
        target = pdf.poids / weights * total if weights > 0 else pdf.poids * 0.0
        paths = list(zip(*[pdf[c] for c in [*levels, "source"]]))
        got = budget_tree([(p, float(w), float(t) * float(r)) for p, w, t, r in zip(paths, pdf.poids, pdf.jetons, pdf.repetitions_max)], total)
        budget = pd.Series([got[p] for p in paths], index=pdf.index)
        once = pdf.jetons.where(pdf.jetons > 0, 1)
        whole = ((budget + 1e-6) // once).astype("int64").clip(upper=pdf.repetitions_max.astype("int64"))
        rest = (budget - whole * pdf.jetons).clip(lower=0.0).where(whole < pdf.repetitions_max, 0.0)
        return pd.DataFrame({"melange": pdf.melange, "source": pdf.source, "poids": pdf.poids / weights if weights > 0 else pdf.poids, "repetitions_max": pdf.repetitions_max.astype("int32"), "jetons": pdf.jetons, "cible": target, "budget": budget, "epoques": whole, "reste": rest, "manque": budget < target * (1 - 1e-12)})

    return rows.groupBy("melange").applyInPandas(plan, "melange string, source string, poids double, repetitions_max int, jetons bigint, cible double, budget double, epoques bigint, reste double, manque boolean")


def select(tokens: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """`melange`, `source`, `doc_id`, `jetons`, `fois`: each document that comes out and how often. `tokens` (from
    document_tokens(), cut) and `plan` (from budgets(), cut). Documents without tokens come out as often as the rest of
    their source's whole epochs."""
    plan = small(plan)
    rows = tokens.join(plan.select("melange", "source", "epoques", "reste"), "source")
    h = F.xxhash64(F.lit(seed), "melange", "epoques", "doc_id")
    rows = rows.withColumn("h", h).withColumn("seau", F.shiftrightunsigned("h", 52).cast("int"))
    sums = rows.where("reste > 0").groupBy("melange", "source", "seau", "reste").agg(F.sum("jetons").alias("j"))
    upto = F.sum("j").over(Window.partitionBy("melange", "source").orderBy("seau"))
    edge = sums.withColumn("haut", upto).where("haut > reste").groupBy("melange", "source").agg(F.min_by(F.struct("seau", (F.col("reste") - F.col("haut") + F.col("j")).alias("place")), "seau").alias("bord"))
    edge = small(cut(edge.select("melange", "source", F.col("bord.seau").alias("bord"), F.col("bord.place").alias("place"))))
    rows = rows.join(edge, ["melange", "source"], "left")
    before = F.sum("jetons").over(Window.partitionBy("melange", "source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    within = rows.where("seau = bord").withColumn("s", before).withColumn("plus", (F.col("s") <= F.col("place")).cast("int"))
    rest = rows.where("bord is null or seau != bord").withColumn("plus", F.when((F.col("reste") > 0) & (F.col("bord").isNull() | (F.col("seau") < F.col("bord"))), 1).otherwise(0))
    out = ["melange", "source", "doc_id", "jetons", (F.col("epoques") + F.col("plus")).cast("int").alias("fois")]
    return rest.select(*out).unionByName(within.select(*out)).where("fois > 0")


def shares(selection: DataFrame, plan: DataFrame) -> DataFrame:
    """Per mixture and source: tokens that came out and the share of the mixture they are, beside the target share."""
    got = selection.groupBy("melange", "source").agg(F.sum(F.col("jetons") * F.col("fois")).alias("jetons_sortis"), F.count(F.lit(1)).alias("documents"), F.max("fois").alias("repetitions"))
    rows = plan.select("melange", "source", "poids", "jetons", "manque").join(got, ["melange", "source"], "left").na.fill(0, ["jetons_sortis", "documents", "repetitions"])
    total = F.sum("jetons_sortis").over(Window.partitionBy("melange"))
    return rows.select("melange", "source", F.col("poids").alias("part_cible"), F.coalesce(F.try_divide(F.col("jetons_sortis"), total), F.lit(0.0)).alias("part_atteinte"), "jetons", "jetons_sortis", "documents", "repetitions", "manque")


def levels_of(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """`source`, `domaine`, `langue`: the subject area given to most of a source's documents and the language most of them are
    said to be in; "" where none is given, the smaller name on a tie. Both are counted before they are shuffled."""
    known = documents.where("source is not null")
    first = lambda df, c: df.groupBy("source", c).count().groupBy("source").agg(F.min_by(c, F.struct(-F.col("count"), c)).alias(c))
    out = known.select("source").distinct().join(first(known.select("source", F.lower("lang").alias("langue")).where("langue is not null"), "langue"), "source", "left")
    if labels is None:
        out = out.withColumn("domaine", F.lit(None).cast("string"))
    else:
        given = known.select("doc_id", "source").join(labels.where("domaine is not null").select("doc_id", "domaine").distinct(), "doc_id")
        out = out.join(first(given, "domaine"), "source", "left")
    return out.select("source", F.coalesce("domaine", F.lit("")).alias("domaine"), F.coalesce("langue", F.lit("")).alias("langue"))


def mixtures(documents: DataFrame, melange: DataFrame, levels: DataFrame | None = None, name: str = "byte_bpe_50k", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(tokens per document, plan), both cut. `levels`: a row per source with the tree's inner levels, from the root, as further
    columns; a source that it lacks hangs under nulls, and without `levels` all sources hang on the root."""
    wanted = cut(targets(melange))
    tokens = cut(document_tokens(documents, wanted, name, folder))
    above = [c for c in levels.columns if c != "source"] if levels is not None else []
    placed = wanted.join(levels, "source", "left") if levels is not None else wanted
    return tokens, cut(budgets(placed, tokens.groupBy("source").agg(F.sum("jetons").alias("jetons")), above))
