"""The graded answer policy: demands, entities, citations, neighbours, levels. Extractive only; a rule pack holds the domain."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import text as tx
from tamis.functions.rulepack import DEFAULT_PACK, PolicyConfig, RulePack
from tamis.operators.fusion import same_page_neighbours
from tamis.session import cut, small

# Fixed value: how a question names maize where its raw pattern doesn't.
MAIZE_ASKED = r"\b(?:le|du|de|au|sur\s+le|pour\s+le|mon|ce|un|des)\s+ma[iï]s\b"
PROVENANCE = ("doc", "titre", "editeur", "annee", "page", "langue", "licence", "regime", "citation_verbatim_autorisee")
_I = "(?iuU)"


def unit_table(chunks: DataFrame) -> DataFrame:
    """`i`, `u`, `unite`: the citation units of each passage in order."""
    return chunks.select("i", F.posexplode(tx.units(F.col("texte"))).alias("u", "unite"))


def values(kind: str, text: Column, pack: RulePack = DEFAULT_PACK) -> Column:
    """All matches of a type's patterns, white space normalised; none if the type is conjunctive and no target is named."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(_I + p), F.lit(0)) for p in pack.patterns[kind]]))
    found = F.transform(found, tx.norm)
    need = [text.rlike(c) for c in (pack.needs.get(kind), _I + pack.conjunctive[kind] if kind in pack.conjunctive else None) if c]
    for c in need:
        found = F.when(c, found).otherwise(F.array().cast("array<string>"))
    return found


def value_hits(units: DataFrame, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """`units` with `type` and `valeurs`, one row per unit and type that has any."""
    each = F.filter(F.array(*[F.struct(F.lit(k).alias("type"), values(k, F.col("unite"), pack).alias("valeurs")) for k in pack.patterns]), lambda x: F.size(x.valeurs) > 0)
    return units.withColumn("__h", F.explode(each)).select(*units.columns, "__h.type", "__h.valeurs")


def _token_pattern(tokens: tuple[str, ...]) -> str:
    return "(?<![0-9a-z])(?:" + "|".join(re.escape(tx.fold_word(t)) for t in tokens) + ")(?![0-9a-z])"


def _mentions(name: str, text: Column, pack: RulePack) -> Column:
    e = pack.entities[name]
    by = [text.rlike(_I + e["latin"])] if e.get("latin") else []
    by.append(text.rlike(_I + e["raw"]) if e.get("raw") else tx.fold_one_to_one(text).rlike(_token_pattern(e["tokens"])))
    return by[0] | by[1] if len(by) > 1 else by[0]


def named(text: Column, pack: RulePack = DEFAULT_PACK) -> Column:
    """Entities that a text names, in the pack's order: by index tokens, or by raw pattern where accents matter, or by Latin name."""
    return F.array_compact(F.array(*[F.when(F.coalesce(_mentions(n, text, pack), F.lit(False)), F.lit(n)) for n in pack.entities]))


def latin(text: Column, pack: RulePack = DEFAULT_PACK) -> Column:
    """Species that a text names in Latin, rivals first."""
    all_names = {**pack.rivals, **{n: e["latin"] for n, e in pack.entities.items() if e.get("latin")}}
    return F.array_compact(F.array(*[F.when(F.coalesce(text.rlike(_I + p), F.lit(False)), F.lit(n)) for n, p in all_names.items()]))


def targets(text: Column, pack: RulePack = DEFAULT_PACK) -> Column:
    """Health targets named in particular; generic words name none."""
    return F.array_compact(F.array(*[F.when(F.coalesce(text.rlike(_I + r"\b" + p), F.lit(False)), F.lit(p)) for p in pack.targets if p not in pack.generic]))


def entities_by_position(question: Column, pack: RulePack = DEFAULT_PACK) -> Column:
    """Entities of a question by their first mention, then name; accents in the question don't matter for the position."""
    plain, spots = tx.fold_one_to_one(question), []
    for n, e in pack.entities.items():
        at = [F.regexp_instr(plain, F.lit(_token_pattern(e["tokens"])))] if e["tokens"] else []
        at += [F.regexp_instr(question, F.lit(_I + p)) for p in (e.get("raw"), e.get("latin"), MAIZE_ASKED if n == "mais" else None) if p]
        spots.append(F.named_struct(F.lit("p"), F.array_min(F.filter(F.array(*at), lambda x: x > 0)), F.lit("e"), F.lit(n)))
    return F.transform(F.array_sort(F.filter(F.array(*spots), lambda s: s.p.isNotNull())), lambda s: s.e)


def demands(questions: DataFrame, query: str, text: str, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """One row per question and rule that it matches: `ordre`, `type`, `cible` (an entity, `variete`, or null), the names in
    capitals (`majuscules`), those of a variety asked for (`noms`), and the places and targets named."""
    q = F.col(text)
    rules = F.array_compact(F.array(*[F.when(q.rlike(_I + p), F.named_struct(F.lit("ordre"), F.lit(k).cast("bigint"), F.lit("type"), F.lit(t))) for k, (t, p) in enumerate(pack.demands)]))
    rows = questions.where(q.isNotNull()).select(query, q.alias("q"), F.explode(rules).alias("r"), F.get(entities_by_position(q, pack), F.lit(0)).alias("e"), tx.upper_runs(q).alias("majuscules"))
    target = F.when((F.col("r.type") == "identite_variete") & (F.size("majuscules") > 0), F.lit("variete")).otherwise(F.col("e"))
    names = F.when(F.col("q").rlike(_I + pack.variety_words), F.col("majuscules")).otherwise(F.array().cast("array<string>"))
    return rows.select(query, "r.ordre", "r.type", target.alias("cible"), "majuscules", names.alias("noms"), tx.places(F.col("q"), pack.places).alias("lieux_q"), targets(F.col("q"), pack).alias("cibles_q"))


def passage_facts(chunks: DataFrame, pack: RulePack = DEFAULT_PACK) -> DataFrame:
    """`chunks` with what its text and title name: `c_nomme`, `c_latin`, `t_nomme`, `lieux`, `modele`, `citable`."""
    t = F.col("texte")
    return chunks.withColumns({"c_nomme": named(t, pack), "c_latin": latin(t, pack), "t_nomme": named(F.coalesce("titre", F.lit("")), pack), "lieux": tx.places(t, pack.places), "modele": t.rlike(_I + pack.model_words), "citable": F.coalesce((F.col("regime") == "committed") & (F.col("citation_verbatim_autorisee") == "oui"), F.lit(False))})


def stage(cfg: PolicyConfig = PolicyConfig()) -> Column:
    """How the demanded entity is verified in a passage, or why not: a1 (text), a2 (title), dyn, dyn-absent,
    veto-espece:x, var-absente, veto:x, aucun. The order of the tests is part of the rule."""
    c = F.col("cible")
    rival_species = F.try_element_at(F.array_except("c_latin", F.array(c)), F.lit(1))
    species = ~F.array_contains("c_latin", c) & rival_species.isNotNull()
    variety = (F.size("noms") > 0) & ~tx.all_named(F.col("noms"), F.col("texte")) if cfg.variety_in_chunk else F.lit(False)
    rival = ~F.array_contains("u_nomme", c) & (F.size("u_nomme") > 0)
    dyn = F.when((F.size("majuscules") > 0) & tx.all_named(F.col("majuscules"), F.col("unite")), "dyn").otherwise("dyn-absent")
    known = F.when(species, F.concat(F.lit("veto-espece:"), rival_species)).when(variety, "var-absente").when(rival, F.concat(F.lit("veto:"), F.try_element_at("u_nomme", F.lit(1)))).when(F.array_contains("c_nomme", c), "a1").when(F.array_contains("t_nomme", c), "a2").otherwise("aucun")
    return F.when(c == "variete", dyn).when(c.isNotNull(), known)


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, pattern: Column) -> Column:
    """All matches of a pattern as structs (a, b) from 0: what stands between matches and the matches themselves take turns, so
    each match starts where the lengths of all before it end."""
    between, found = F.transform(F.split(text, pattern, -1), F.length), F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a: int, b: int>>").alias("all"))

    def step(s: Column, x: Column) -> Column:
        a = s.at + x["0"]
        return F.struct((a + x["1"]).alias("at"), F.array_append(s.all, F.struct(a.alias("a"), (a + x["1"]).alias("b"))).alias("all"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda x, y: F.struct(x.alias("0"), y.alias("1")))
    return F.aggregate(pairs, state, step, lambda s: s["all"])


def nearest(some: Column, others: Column) -> Column:
    """The fewest characters between a span of `some` and one of `others`, 0 if they touch or overlap; null if either has none."""
    return F.array_min(F.flatten(F.transform(some, lambda x: F.transform(others, lambda y: F.greatest(F.lit(0), y.a - x.b, x.a - y.b)))))


def co_mention(kind: Column, target: Column, unit: Column, pack: RulePack = DEFAULT_PACK) -> Column:
    """struct(declenche, accorde, d_cible, d_rivale) of a unit that may name several entities: how far from its values of the type
    `kind` the target is named, and the nearest other entity. The rule applies where both distances are known, and speaks for
    the target unless another is nearer. A null unit gives a rule that doesn't apply."""
    u = tx.norm(unit)
    folded = tx.fold_one_to_one(u)
    by_kind = F.create_map(*[x for k, ps in pack.patterns.items() for x in (F.lit(k), F.array(*[F.lit(_I + p) for p in ps]))])
    where = F.flatten(F.transform(F.element_at(by_kind, kind), lambda p: spans(u, p)))
    for k, p in pack.conjunctive.items():
        where = F.when((kind != k) | u.rlike(_I + p), where)

    def own(e: dict) -> Column:
        found = spans(u, F.lit(_I + e["raw"])) if e.get("raw") else spans(folded, F.lit(_token_pattern(e["tokens"])))
        return F.concat(found, spans(u, F.lit(_I + e["latin"]))) if e.get("latin") else found

    far = _let(where, lambda v: F.array(*[F.struct(F.lit(n).alias("n"), nearest(v, own(e)).alias("d")) for n, e in pack.entities.items()]))
    pick = lambda far, mine: F.array_min(F.transform(F.filter(far, lambda x: (x.n == target) == F.lit(mine)), lambda x: x.d))
    both = _let(far, lambda x: F.struct(pick(x, True).alias("c"), pick(x, False).alias("r")))

    def verdict(d: Column) -> Column:
        known = F.coalesce(unit.isNotNull() & d.c.isNotNull() & d.r.isNotNull(), F.lit(False))
        return F.struct(known.alias("declenche"), (~known | (d.c <= d.r)).alias("accorde"), F.when(known, d.c).alias("d_cible"), F.when(known, d.r).alias("d_rivale"))

    return _let(both, verdict)


def evidence(chunks: DataFrame, pack: RulePack = DEFAULT_PACK) -> tuple[DataFrame, DataFrame]:
    """(units with values and what they name, facts of the passages that have any), both cut: each pattern is tried on each
    unit once, whatever number of demands is asked."""
    hits = value_hits(unit_table(chunks.select("i", "texte")), pack)
    hits = cut(hits.withColumns({"u_nomme": named(F.col("unite"), pack), "u_cibles": targets(F.col("unite"), pack)}))
    return hits, cut(passage_facts(chunks.join(hits.select("i").distinct(), "i", "left_semi"), pack))


def _verified(rows: DataFrame, pack: RulePack, cfg: PolicyConfig) -> DataFrame:
    """Of rows (demand x passage x unit with values) those that may be cited, with `etage`, `co`, and the cut citation `c`."""
    served = ~F.col("type").isin(*pack.conjunctive) | (F.size("cibles_q") == 0) | F.arrays_overlap("cibles_q", "u_cibles") if cfg.target_in_citation else F.lit(True)
    rows = rows.withColumn("etage", stage(cfg)).where(F.col("etage").isin("a1", "a2", "dyn") & served)
    several = (F.size("u_nomme") > 1) & (F.col("cible") != "variete")
    rows = rows.withColumn("co", co_mention(F.col("type"), F.col("cible"), F.when(several, F.col("unite")), pack)).where(~several | F.col("co.accorde"))
    return rows.withColumn("c", tx.truncate(F.col("unite"), cfg.citation_max)).where(tx.is_verbatim(F.col("c.verbatim"), F.col("texte")))


def _citation(source: Column) -> Column:
    return F.struct(
        F.col("i").alias("chunk"), "etage", "valeurs", F.col("c.verbatim").alias("citation"), F.col("c.affichee").alias("citation_affichee"), F.col("c.tronquee").alias("tronquee"), tx.is_table_line(F.col("unite")).alias("lecture_de_tableau"),
        F.coalesce("co.declenche", F.lit(False)).alias("co_mention"), F.col("cos").alias("cos"), source.alias("couture_de"), *[F.col(p) for p in PROVENANCE],
    )


def level_one(wanted: DataFrame, kept: DataFrame, chunks: DataFrame, query: str, pack: RulePack = DEFAULT_PACK, cfg: PolicyConfig = PolicyConfig(), known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """`query`, `ordre`, `citations`: for each demand with a target, the first units of the kept passages, by rank, that carry a
    value of its type and name its entity; then, if there are any, what a neighbour on the page completes them with.
    `known`: evidence() of `chunks`, if it is there; else the evidence of the kept passages and their neighbours is looked for."""
    by = [query, "ordre"]
    near = same_page_neighbours(chunks)
    near = near.select("i", F.explode(F.array_compact(F.array("avant", "apres"))).alias("j"))
    if known is None:
        ids = kept.select("i").distinct()
        near = cut(near.join(ids, "i", "left_semi"))
        known = evidence(chunks.join(small(cut(ids.union(near.select("j")).distinct())), "i", "left_semi"), pack)
    hits, facts = known
    asked = wanted.where("cible is not null")
    pairs = asked.join(kept.select(query, "i", "rang", "cos"), query).join(hits, ["i", "type"]).join(facts, "i")
    found = _verified(pairs, pack, cfg)
    once = Window.partitionBy(*by, "i", "c.verbatim").orderBy("u")
    order = Window.partitionBy(*by).orderBy("rang", "u")
    cited = found.withColumn("__n", F.row_number().over(once)).where("__n = 1").withColumn("place", F.row_number().over(order)).where(F.col("place") <= cfg.citations_per_demand)
    cited = cut(cited.withColumn("citation", _citation(F.lit(None).cast("bigint"))).select(*by, "type", "cible", "majuscules", "noms", "lieux_q", "cibles_q", "i", "place", F.col("texte").alias("texte_source"), "citation"))
    rows = cited.select(*by, "place", "citation")
    if cfg.stitches_per_demand > 0:
        sewn = cited.join(near, "i").withColumnsRenamed({"i": "source"}).withColumnRenamed("j", "i").join(kept.select(query, "i"), [query, "i"], "left_anti")
        sewn = sewn.drop("citation").join(hits, ["i", "type"]).join(facts, "i").withColumn("cos", F.lit(None).cast("double"))
        sewn = _verified(sewn, pack, cfg)
        if cfg.stitch_new_text_only:
            sewn = sewn.where(~tx.is_verbatim(F.col("c.verbatim"), F.col("texte_source")))
        told = cited.select(*by, F.col("citation.citation").alias("t"))
        sewn = sewn.withColumn("t", F.col("c.verbatim")).join(told, [*by, "t"], "left_anti")
        first = Window.partitionBy(*by).orderBy("place", "i", "u")
        sewn = sewn.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= cfg.stitches_per_demand)
        rows = rows.unionByName(sewn.select(*by, (F.col("__n") + cfg.citations_per_demand).alias("place"), _citation(F.col("source")).alias("citation")))
    return rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "citation"))), lambda x: x.citation).alias("citations"))


def cited(questions: DataFrame, kept: DataFrame, decisions: DataFrame, chunks: DataFrame, query: str = "ligne", text: str = "requete", pack: RulePack = DEFAULT_PACK, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """`query`, `ordre`, `type`, `cible`, `citations` of the demands that analyse() finds documented; nothing else is looked at
    but the kept passages and their neighbours."""
    open_q = questions.join(decisions.where("not refus").select(query).distinct(), query, "left_semi")
    wanted = cut(demands(open_q, query, text, pack))
    found = level_one(wanted, kept.join(open_q.select(query), query, "left_semi"), chunks, query, pack, cfg)
    return wanted.select(query, "ordre", "type", "cible").join(found, [query, "ordre"])


SIGNATURE = ("type", "cible", "majuscules", "noms", "lieux_q", "cibles_q")


def neighbours(wanted: DataFrame, chunks: DataFrame, pack: RulePack = DEFAULT_PACK, cfg: PolicyConfig = PolicyConfig(), known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Per distinct demand (the columns of SIGNATURE) the nearest documented value in the whole collection among units that
    fail its entity, with the named gaps: `voisin`, `ecarts`.

    Demands that ask the same share one scan. The best unit is a minimum, so it is found by an aggregation that combines
    before the shuffle: practice verb, target and form first for conjunctive types, then free to cite, then a place in
    common, then the smaller passage and unit.
    """
    asked = wanted.select(*SIGNATURE).distinct().withColumn("s", F.xxhash64(*SIGNATURE))
    hits, facts = known or evidence(chunks, pack)
    rows = hits.join(small(cut(asked)), "type").join(facts, "i")
    rows = rows.withColumn("etage", stage(cfg)).where("cible is null or etage not in ('a1', 'a2', 'dyn')")
    conj = F.col("type").isin(*pack.conjunctive)
    no = lambda c: F.when(c, 0).otherwise(1)
    rank = F.struct(*[F.when(conj, no(x)).otherwise(0).alias(n) for n, x in (("p", F.col("unite").rlike(_I + pack.practice)), ("t", F.arrays_overlap("cibles_q", "u_cibles")), ("f", tx.is_prescriptive(F.col("unite"), pack.practice)))], no(F.col("citable")).alias("l"), no(F.arrays_overlap("lieux_q", "lieux")).alias("o"), "i", "u")
    best = rows.groupBy("s").agg(F.min_by(F.struct("i", "unite", "valeurs", "citable", "lieux", "modele", F.array_distinct(F.concat("c_nomme", "t_nomme")).alias("cultures"), ((F.size("noms") > 0) & ~tx.all_named(F.col("noms"), F.col("texte"))).alias("variete_absente"), *PROVENANCE), rank).alias("voisin"))
    v = lambda c: F.col(f"voisin.{c}")
    others = F.filter(v("cultures"), lambda x: x != F.col("cible"))
    gaps = F.array_compact(
        F.array(
            F.when(F.col("cible").isNotNull() & (F.size(others) > 0), F.concat(F.lit("culture "), F.array_join(others, "/"), F.lit(" ≠ "), F.col("cible"))).when(F.col("cible").isNotNull() & (F.size(v("cultures")) == 0), F.concat(F.lit("aucune culture nommee dans la source ≠ "), F.col("cible"))),
            F.when((F.size("lieux_q") > 0) & (F.size(v("lieux")) > 0) & ~F.arrays_overlap("lieux_q", v("lieux")), F.concat(F.lit("lieu "), F.array_join(F.slice(v("lieux"), 1, 2), "/"), F.lit(" ≠ "), F.array_join(F.slice("lieux_q", 1, 2), "/"))),
            F.when(v("variete_absente"), F.concat(F.lit("variete non attestee dans le passage ≠ "), F.array_join("noms", "/"))),
            F.when(v("modele"), F.lit("parametre de modele ≠ recommandation au producteur")),
        )
    )
    return asked.join(best, "s").select(*SIGNATURE, "voisin", gaps.alias("ecarts"))


def analyse(questions: DataFrame, kept: DataFrame, decisions: DataFrame, chunks: DataFrame, query: str = "ligne", text: str = "requete", pack: RulePack = DEFAULT_PACK, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """One report per question: `niveaux` (ascending: 1 sourced, 2 flagged, 3 refused), `demandes` with their citations, nearest
    documented value and gaps, `pistes`, `appels_generateur` (always 0).

    `kept`: query, i, rang, cos. `decisions`: query, valeur, seuil, refus; a question without one is refused. Refused questions
    go no further. A null question asks nothing: level 2, or 3 if refused.
    """
    q = questions.join(decisions, query, "left").withColumn("refus", F.coalesce("refus", F.lit(True)))
    open_q = q.where("not refus")
    wanted = cut(demands(open_q, query, text, pack))
    known = evidence(chunks, pack)
    cites = level_one(wanted, kept.join(open_q.select(query), query, "left_semi"), chunks, query, pack, cfg, known)
    both = cut(wanted.join(cites, [query, "ordre"], "left"))
    practised = F.exists("citations", lambda c: c.citation.rlike(_I + pack.practice))
    both = both.withColumn("niveau", F.when(F.col("citations").isNotNull(), 1).otherwise(2)).withColumn("reserve", F.coalesce(F.col("type").isin(*pack.conjunctive) & ~practised, F.lit(False)))
    need = both.where("niveau = 2 or reserve")
    near = cut(neighbours(need, chunks, pack, cfg, known))
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"n.{c}")) for c in SIGNATURE]
    full = both.alias("d").join(near.alias("n"), on, "left").select("d.*", F.when((F.col("d.niveau") == 2) | F.col("d.reserve"), F.col("n.voisin")).alias("voisin"), F.when((F.col("d.niveau") == 2) | F.col("d.reserve"), F.col("n.ecarts")).alias("ecarts"))
    none = F.array().cast(both.schema["citations"].dataType)
    per_q = full.groupBy(query).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ordre", F.struct("type", "cible", "niveau", F.coalesce("citations", none).alias("citations"), "voisin", F.coalesce("ecarts", F.array().cast("array<string>")).alias("ecarts"), "reserve").alias("d")))), lambda x: x.d).alias("demandes"),
        F.collect_set("niveau").alias("a"), F.max("reserve").alias("r"),
    )
    leads = kept.where("rang <= 3").join(chunks.select("i", tx.preview(F.col("texte"), 200).alias("apercu")), "i").groupBy(query).agg(F.sort_array(F.collect_list(F.struct("rang", "i", "apercu"))).alias("pistes"))
    out = q.join(per_q, query, "left").join(leads, query, "left")
    lv = F.when(F.col("refus"), F.array(F.lit(3))).when(F.col("a").isNull(), F.array(F.lit(2))).otherwise(F.array_sort(F.array_union("a", F.when(F.col("r"), F.array(F.lit(2))).otherwise(F.array().cast("array<int>")))))
    return out.select(query, text, "valeur", "seuil", "refus", lv.alias("niveaux"), F.coalesce("demandes", F.array().cast(per_q.schema["demandes"].dataType)).alias("demandes"), F.when(~F.col("refus") & F.col("a").isNull(), F.col("pistes")).alias("pistes"), F.lit(0).alias("appels_generateur"))


def compose(report: DataFrame, text: str = "requete") -> DataFrame:
    """`report` with `message`: the question, then of each demand its citations with provenance, or the nearest value and gaps."""
    prov = lambda c: tx.provenance_line({p: c[p] for p in ("editeur", "titre", "annee", "page", "licence", "regime")})
    cited = lambda d: F.transform(d.citations, lambda c: F.concat(F.lit("- "), c.citation_affichee, F.lit(" ("), prov(c), F.lit(")")))
    near = lambda d: F.when(d.voisin.isNotNull(), F.concat(F.lit("- valeur documentee la plus proche : "), d.voisin.unite, F.lit(" ("), prov(d.voisin), F.lit(")"), F.when(F.size(d.ecarts) > 0, F.concat(F.lit(" ; ecarts : "), F.array_join(d.ecarts, " ; "))).otherwise("")))
    block = lambda d: F.array_join(F.concat(F.array(F.concat(F.lit("["), d.type, F.lit("] niveau "), d.niveau.cast("string"))), cited(d), F.array_compact(F.array(near(d)))), "\n")
    body = F.when(F.col("refus"), "Cette question sort de ce que les sources documentent.").otherwise(F.array_join(F.transform("demandes", block), "\n"))
    return report.withColumn("message", F.concat_ws("\n", F.concat(F.lit("Question : "), F.col(text)), body))
