"""The agent's rules for plans, queries, candidate references, answers and prompts, as Columns and joins by question.

A facet is a row ``query_id, facet, name, goal, query, prefix, priority, expected (array), role, blocking``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.operators import agent
from corpusmill.operators.agent import axes_match

#: Families of references, and the roles of an axis.
FAMILIES = ["RPPM", "RFPI", "BIC", "BNC", "BA", "IS", "TVA", "IR", "RSA", "CF", "ENR", "IF", "PAT"]
ROLES = ["core", "calculation", "reserve", "alternative"]
SIDE_ROLES = ["reserve", "alternative"]
#: What questions and axes say when an axis is a matter of amounts, of a regime, of scope or of an option.
ASKS_AMOUNT = ["combien", "taux", "montant", "calcul", "calcule", "imposable", "soumis", "exonere", "exoneration", "taxe", "impot", "cotisation"]
NAMES_AMOUNT = ["seuil", "plafond", "bareme", "taux", "montant", "chiffre d'affaires", "chiffre affaires", "recettes", "cotisation minimum", "base minimum"]
ASSUMES_REGIME = ["si je releve", "si nous relevons", "si je suis au regime", "si je suis sous le regime", "si j applique le regime", "relevant du regime", "sous le regime", "au regime applicable"]
ASKS_RESULT = ["benefice imposable", "base imposable", "resultat imposable", "dois je retenir", "combien", "calcul", "calcule", "montant", "taux"]
ASKS_RIGHT = ["puis je", "ai je droit", "suis je eligible", "est ce que je releve", "conditions pour relever", "puis je beneficier", "ai je droit au regime"]
REGIME_CHANGE = ["changement", "sortie", "exclusion", "exclusions", "exclu", "exclus", "option", "cessation", "creation", "cessent", "cesse de s appliquer"]
OUT_OF_SCOPE = ["eviter une confusion", "hors perimetre", "hors sujet", "utile seulement", "seulement si necessaire", "cadrer la reponse", "pas demande", "non demande", "ne pas calculer", "ne calcule pas", "sans calculer"]
LIMITED = ["uniquement", "seulement", "limite", "reserve"]
CLARIFIES = ["distinction", "distinguer", "clarification", "cadrer"]
OPTIONAL = ["eventuel", "eventuelle", "cas particulier", "conditions particulieres", "condition particuliere", "non precise", "non precisees", "non indique", "non indiquees", "non declenche", "non declenchee", "fait declencheur", "faits declencheurs", "faute de faits", "pourrait modifier", "pourraient modifier", "sous reserve d'informations", "hypothese non", "dispositif special", "regime special"]
ASKS_OPTION = ["ai je droit", "a t on droit", "suis je eligible", "sommes nous eligibles", "puis je beneficier", "peut on beneficier", "conditions pour beneficier", "conditions d application", "exception", "cas particulier", "dispositif special", "regime special"]
#: Words that make no evidence specific, and what makes a single piece of evidence worth a search.
GENERIC = ["application", "applicable", "champ", "conditions", "doctrine", "limite", "limites", "modalite", "modalites", "pertinente", "preuve", "regle", "source", "sources"]
WORTH = ["abattement", "bareme", "calcul", "forfait", "montant", "plafond", "seuil"]
#: Terms added to queries that speak of amounts, by what they say.
THRESHOLD_TERMS = [
    (["chiffre d'affaires", "chiffre affaires", "recettes", "ca "], ["seuil", "plafond", "inferieur egal", "faible chiffre affaires", "recettes"]),
    (["loyers", "revenus", "recettes"], ["seuil", "plafond", "abattement", "regime"]),
    (["taux", "pourcentage", "combien", "calcul"], ["taux", "bareme", "calcul"]),
]
QUESTION_STOPWORDS = ["avec", "cela", "dans", "depuis", "dois", "donc", "dont", "elle", "est", "mes", "mon", "pour", "puis", "quel", "quelle", "sans", "suis", "une", "vous"]
#: Phrases of an answer that concludes nothing.
NO_CONCLUSION = ["impossible de repondre", "impossible de conclure", "ne permet pas de repondre", "ne permettent pas de repondre", "ne permet pas de conclure", "ne permettent pas de conclure", "preuve insuffisante", "preuves insuffisantes", "sources insuffisantes", "extraits insuffisants", "aucun extrait ne prouve", "aucune source ne prouve", "je ne peux pas repondre"]
NOTHING_NAMED = "sources insuffisantes pour conclure complètement"
#: Labels and search terms of the families of :data:`corpusmill.operators.agent.TAXONOMY`.
PLAN_TERMS = {
    "TVA": ("taxe sur la valeur ajoutée", "TVA taxe valeur ajoutée territorialité facturation redevable déclaration"),
    "IR": ("impôt sur le revenu des particuliers", "IR impôt revenu foyer fiscal quotient familial prélèvement source"),
    "RSA": ("traitements, salaires et revenus assimilés", "RSA traitements salaires revenus assimilés indemnités imposables exonération limites"),
    "BIC": ("bénéfices industriels et commerciaux", "BIC bénéfices industriels commerciaux micro entreprise chiffre affaires bénéfice imposable régime"),
    "BNC": ("bénéfices non commerciaux", "BNC profession libérale honoraires micro BNC recettes imposables"),
    "IS": ("impôt sur les sociétés", "IS impôt sociétés résultat fiscal bénéfice imposable"),
    "RFPI": ("revenus fonciers et plus-values immobilières", "RFPI revenus fonciers location nue micro-foncier régime réel charges déductibles copropriété plus-values immobilières"),
    "RPPM": ("revenus et produits du patrimoine mobilier", "RPPM revenus capitaux mobiliers dividendes intérêts produits placements valeurs mobilières"),
    "CF": ("contrôle fiscal et pénalités", "CF contrôle fiscal redressement intérêts retard majoration pénalité procédure"),
    "ENR": ("enregistrement, succession, donation", "ENR succession donation droits enregistrement mutation abattement"),
    "IF": ("impôts fonciers et contribution économique territoriale", "IF taxe foncière CFE CVAE cotisation foncière base exonération"),
}
#: What a score of a route counts for, by how near to the answer its references came.
ROUTE_KINDS = {"stage2": 6.0, "stage1": 3.0, "selected": 1.0}


def said(text: Column) -> Column:
    """Without accents and in lower case: what markers are looked for in."""
    return F.lower(t.fold(F.coalesce(text, F.lit(""))))


def short(text: Column, limit: int) -> Column:
    """White space collapsed; if longer than ``limit``, cut to it with dots at the end."""
    value = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?U){t.WHITE}+", " "))
    return t.let(value, lambda v: F.when(F.length(v) <= limit, v).otherwise(F.concat(F.rtrim(F.left(v, F.lit(limit - 3))), F.lit("..."))))


def spaced(*parts: Column) -> Column:
    """The parts that aren't empty, with spaces between them."""
    return F.trim(F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " "))


def tax_prefix(value: Column) -> Column:
    """The first family with up to eight further elements, at most 80 characters; empty if none."""
    raw = F.regexp_replace(F.upper(F.trim(F.coalesce(value, F.lit("")))), "^BOI-", "")
    return F.left(F.regexp_extract(raw, rf"(?U)\b(?:{'|'.join(FAMILIES)})(?:-[A-Z0-9]+){{0,8}}\b", 0), F.lit(80))


def tax_parts(value: Column) -> Column:
    """The elements of a normalized prefix, without a date; none if it has no family."""
    p = tax_prefix(value)
    return F.when(p == "", F.array().cast("array<string>")).otherwise(t.reference_parts(p))


def tax_branch(ref: Column) -> Column:
    """The first three elements of a reference of a known family; null for others, which are no branch."""
    return F.nullif(F.array_join(F.slice(tax_parts(ref), 1, 3), "-"), F.lit(""))


def shares_parent(ref: Column, prefix: Column) -> Column:
    """Equal but for the last of four elements or more."""
    a, b = tax_parts(ref), tax_parts(prefix)
    parent = lambda p: F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), "-")
    return (F.size(a) >= 4) & (F.size(b) >= 4) & (parent(a) == parent(b))


def prefixes_overlap(a: Column, b: Column) -> Column:
    x, y = tax_prefix(a), tax_prefix(b)
    return (x != "") & (y != "") & (F.startswith(x, y) | F.startswith(y, x))


def words(text: Column, least: int = 1) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(said(text), F.lit("[a-z0-9]+"), F.lit(0))), lambda w: F.length(w) >= least)


def overlap(axis: Column, ref: Column, title: Column, path: Column, text: Column) -> Column:
    """How many words of four characters or more of an axis a passage has in its reference, title, path and first 300 characters."""
    return F.size(F.array_intersect(words(axis, 4), words(F.concat_ws(" ", ref, title, path, short(text, 300)))))


def role(value: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.isin(*ROLES), v).otherwise("core")


def blocking(flag: Column, of: Column) -> Column:
    """What the flag says, or else whether the role ``of`` an axis is one of the main ones."""
    v = F.lower(F.trim(F.coalesce(flag.cast("string"), F.lit(""))))
    return F.when(v.isin("false", "0", "no", "non"), False).when(v.isin("true", "1", "yes", "oui"), True).otherwise(~role(of).isin(*SIDE_ROLES))


def plan_facets(rows: DataFrame, most: int = 5) -> DataFrame:
    """Facets as a plan proposes them, put in order: clipped, with roles that question and texts bear out, the first five by priority.

    ``rows(query_id, question, reformulated, facet, name, goal, query, prefix, priority, expected, role, blocking)`` with
    ``facet`` from 1 and all others but ``expected`` strings; a facet without query and goal goes.
    """
    expected = F.slice(F.transform(F.filter(F.coalesce("expected", F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), lambda x: short(x, 120)), 1, 4)
    clipped = rows.withColumns({"query": short(F.col("query"), 220), "goal": short(F.col("goal"), 220), "name": short(F.col("name"), 90), "expected": expected}).filter("query <> '' or goal <> ''")
    texts = ["name", "goal", "query"]
    own = F.concat_ws(" ", *texts, F.array_join("expected", " "))
    clipped = clipped.withColumns({"_q": said(F.col("question")), "_own": said(own), "_all": said(F.concat_ws(" ", "question", "reformulated", own))})
    q, o, a = F.col("_q"), F.col("_own"), F.col("_all")
    amount = t.any_marker(q, ASKS_AMOUNT) & t.any_marker(a, NAMES_AMOUNT)
    assumed = t.any_marker(q, ASSUMES_REGIME) & t.any_marker(q, ASKS_RESULT) & ~t.any_marker(q, ASKS_RIGHT) & t.any_marker(a, REGIME_CHANGE)
    scope = t.any_marker(o, OUT_OF_SCOPE) | (t.any_marker(o, LIMITED) & t.any_marker(o, CLARIFIES))
    aside = assumed | scope | (t.any_marker(o, OPTIONAL) & ~t.any_marker(q, ASKS_OPTION))
    priority = F.coalesce(F.trim(F.col("priority")).try_cast("int"), F.col("facet"))
    out = clipped.select(
        "query_id", "facet",
        F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Axe fiscal "), F.col("facet").cast("string"))).alias("name"),
        F.coalesce(F.nullif("goal", F.lit("")), F.lit("Identifier la doctrine applicable")).alias("goal"),
        F.coalesce(F.nullif("query", F.lit("")), "goal").alias("query"),
        tax_prefix(F.col("prefix")).alias("prefix"), F.greatest(F.lit(1), F.least(F.lit(9), priority)).alias("priority"), "expected",
        F.when(aside, "reserve").when(amount, "calculation").otherwise(role(F.col("role"))).alias("role"),
        F.when(aside, False).when(amount, True).otherwise(blocking(F.col("blocking"), F.col("role"))).alias("blocking"),
    )
    w = Window.partitionBy("query_id").orderBy("priority", "facet")
    return out.withColumn("facet", F.row_number().over(w)).filter(F.col("facet") <= most)


def fallback_facets(questions: DataFrame) -> DataFrame:
    """The facets of questions without a plan: the tax families that they point to, or else the whole question."""
    told = F.create_map(*[x for p, (label, terms) in PLAN_TERMS.items() for x in (F.lit(p), F.struct(F.lit(label).alias("name"), F.lit(terms).alias("query")))])
    routed = agent.taxonomy_route(questions)
    found = routed.select("query_id", F.col("rank").alias("facet"), told[F.col("prefix")]["name"].alias("name"), told[F.col("prefix")]["query"].alias("query"), "prefix")
    rest = questions.join(routed.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit(1).alias("facet"), F.lit("Doctrine fiscale applicable").alias("name"), F.col("text").alias("query"), F.lit("").alias("prefix"))
    goal = F.when(F.col("prefix") == "", "Identifier les règles répondant à la question").otherwise(F.concat(F.lit("Identifier la doctrine pertinente pour "), "name"))
    middle = F.when(F.col("prefix") == "", "conditions").otherwise("champ d'application")
    return found.unionByName(rest).select("query_id", "facet", "name", goal.alias("goal"), "query", "prefix", F.col("facet").alias("priority"), F.array(F.lit("règle applicable"), middle, F.lit("limites")).alias("expected"), F.lit("core").alias("role"), F.lit(True).alias("blocking"))


def threshold_terms(text: Column) -> Column:
    """Search terms for a text with numbers that speaks of turnover, income or rates; each once."""

    def terms(x: Column) -> Column:
        added = [F.when(t.any_marker(x, markers), F.array(*[F.lit(w) for w in more])).otherwise(F.array().cast("array<string>")) for markers, more in THRESHOLD_TERMS]
        return F.array_join(F.array_distinct(F.concat(*added)), " ")

    return F.when(text.rlike(r"(?U)\d"), t.let(said(text), terms)).otherwise("")


def question_terms(text: Column) -> Column:
    """The first 36 distinct words of four letters or more, without numbers, currency words and stop words."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\b\d[\d\s .,]*\d?\b", " "), r"(?iU)\b(euros?|€|ht|ttc)\b", " ")
    found = F.transform(F.regexp_extract_all(plain, F.lit("[A-Za-zÀ-ÿ']+"), F.lit(0)), lambda w: F.btrim(said(w), F.lit("'")))
    return F.array_join(F.slice(F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 4) & ~w.isin(*QUESTION_STOPWORDS))), 1, 36), " ")


def evidence_text(values: Column) -> Column:
    """The first three values without references, those with words left joined by spaces."""
    bare = F.transform(F.slice(values, 1, 3), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, t.REFERENCE, " "), f"(?U){t.WHITE}+", " ")))
    return F.array_join(F.filter(bare, lambda x: x != ""), " ")


def specific_evidence(values: Column) -> Column:
    """Values with a word of four letters that isn't generic, or with such a word and a number; each once."""
    clean = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), f"(?U){t.WHITE}+", " ")))
    generic = F.array(*[F.lit(g) for g in GENERIC])
    specific = lambda x: t.let(words(x, 4), lambda w: (F.size(w) > 0) & ((F.size(F.array_except(w, generic)) > 0) | x.rlike(r"(?U)\d|%|€")))
    return F.array_distinct(F.filter(clean, specific))


def evidence_expansion(text: Column) -> Column:
    def more(x: Column) -> Column:
        has = F.contains(x, F.lit("abattement"))
        lists = [(has & t.any_marker(x, ["forfaitaire", "charge"]), ["application abattement", "taux abattement", "conditions abattement"]), (has & F.contains(x, F.lit("taux")), ["application abattement", "pourcentage"])]
        return F.array_join(F.array_distinct(F.concat(*[F.when(c, F.array(*[F.lit(w) for w in ws])).otherwise(F.array().cast("array<string>")) for c, ws in lists])), " ")

    return t.let(said(text), more)


def facet_queries(facets: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds to facets what is searched for: ``search`` (documents), ``passages`` (500 characters each), and ``evidence``, up to three
    queries of 300 for evidence that is worth one of its own.
    """
    rows = facets.join(questions.select("query_id", F.col("text").alias("_question")), "query_id")
    expected = evidence_text(F.col("expected"))
    rows = rows.withColumns({"_expected": expected, "_specific": specific_evidence(F.col("expected"))})
    focus = spaced(F.col("query"), F.col("goal"), F.col("_expected"))
    context = said(F.concat_ws(" ", "name", "goal", "query", F.array_join("_specific", " ")))
    n = F.size("_specific")
    worth = (n >= 2) | ((n == 1) & t.let(context, lambda x: t.any_marker(x, WORTH) | x.rlike(r"(?U)\d|%")))
    one = lambda x: t.let(evidence_text(F.array(x)), lambda e: F.when(e != "", F.left(spaced(tax_prefix(F.col("prefix")), F.col("prefix"), F.col("name"), F.col("query"), e, evidence_expansion(e)), F.lit(300))))
    return rows.withColumns({
        "search": F.left(spaced(F.col("prefix"), F.col("name"), F.col("query"), F.col("_question")), F.lit(500)),
        "passages": F.left(spaced(F.col("prefix"), F.col("query"), threshold_terms(F.concat_ws(" ", "_question", focus)), F.col("goal"), F.col("_expected"), question_terms(F.col("_question"))), F.lit(500)),
        "evidence": F.when(worth, F.array_compact(F.transform(F.slice("_specific", 1, 3), one))).otherwise(F.array().cast("array<string>")),
    }).drop("_question", "_expected", "_specific")


def candidate_refs(gaps: DataFrame, routes: DataFrame, chunks: DataFrame, most: int = 6) -> DataFrame:
    """``gap, ref, place``: references to search for a missing axis, spread over branches, ``most`` a gap.

    ``gaps(gap, query_id, axis, prefix)`` with all that is said of the axis; ``routes(query_id, route, text, kind, place, ref)``, what
    earlier searches for ``text`` found (:data:`ROUTE_KINDS`); ``chunks(query_id, place, ref, title, path, text)``.  References that the
    axis names come first.  Joins are by question, so a row meets the few gaps of its own.
    """
    kinds = list(ROUTE_KINDS)
    gaps = gaps.withColumns({"prefix": tax_prefix(F.col("prefix")), "_words": words(F.col("axis"), 4)})
    row = lambda source, major, minor, place, score: (F.col("gap"), F.upper(F.trim("ref")).alias("ref"), F.struct(F.lit(source).alias("s"), major.cast("int").alias("a"), minor.cast("int").alias("b"), place.cast("long").alias("p")).alias("o"), score.cast("double").alias("score"))
    zero = F.lit(0)
    named = gaps.select("gap", F.posexplode(t.references(F.col("axis"), 6)).alias("_p", "ref")).select(*row(0, zero, zero, F.col("_p"), F.lit(1000.0)))
    common = lambda text: F.size(F.array_intersect("_words", words(text)))
    under, beside = t.matches_prefix(F.col("ref"), F.col("prefix")), shares_parent(F.col("ref"), F.col("prefix"))

    found = routes.join(gaps.select("gap", "query_id", "prefix", "_words"), "query_id").withColumns({"_route": common(F.col("text")), "_ref": common(F.col("ref")), "_under": under, "_beside": beside})
    found = found.filter("_route > 0 or _ref > 0 or _under or _beside")
    boost = F.element_at(F.create_map(*[F.lit(x) for kv in ROUTE_KINDS.items() for x in kv]), F.col("kind"))
    kind_no = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    extra = lambda a, b: F.when(F.col("_under"), a).when(F.col("_beside"), b).otherwise(0.0)
    found = found.select(*row(1, F.col("route"), kind_no, F.col("place"), F.col("_route") * 2.0 + F.col("_ref") + boost + extra(0.5, 0.75)))

    seen = F.concat_ws(" ", "ref", "title", "path", short(F.col("text"), 300))
    passages = chunks.join(gaps.select("gap", "query_id", "prefix", "_words"), "query_id").withColumns({"_under": under, "_beside": beside, "_n": common(seen)})
    passages = passages.select(*row(2, zero, zero, F.col("place"), F.col("_n") + extra(2.0, 1.0))).filter("score > 0")

    every = named.unionByName(found).unionByName(passages).filter(F.startswith("ref", F.lit("BOI-")))
    best = every.groupBy("gap", "ref").agg(F.max("score").alias("score"), F.min("o").alias("o"))
    w = Window.partitionBy("gap").orderBy(F.desc("score"), "o", "ref")
    ranked = best.select(F.col("gap").alias("query_id"), "ref", F.row_number().over(w).alias("pos"))
    return agent.diversify(ranked, most, tax_branch(F.col("ref"))).withColumnRenamed("query_id", "gap")


def clean_status(answers: DataFrame) -> DataFrame:
    """``answer_id, status, required, missing`` of rows ``answer_id, readable, status, conclusion, bullets, covered, required, missing, aside``.

    An answer that concludes something is supported, whatever it says is missing; others lack evidence.  Axes that match one
    of ``aside`` (those that don't block) are neither required nor missing; an answer that was not ``readable`` lacks structure.
    """
    full = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    rows = answers.withColumns({c: full(F.col(c)) for c in ("bullets", "covered", "required", "missing", "aside")})
    kept = lambda c: F.filter(F.col(c), lambda x: ~F.exists("aside", lambda y: axes_match(x, y)))
    rows = rows.withColumns({"required": kept("required"), "missing": kept("missing")})
    concluded = (F.trim(F.coalesce("conclusion", F.lit(""))) != "") | (F.size("bullets") > 0) | (F.size("covered") > 0)
    text = said(F.concat_ws("\n", "status", "conclusion", F.array_join("bullets", "\n")))
    supported = F.col("readable") & concluded & ~t.any_marker(text, NO_CONCLUSION)
    nothing = F.array().cast("array<string>")
    missing = F.when(~F.col("readable"), F.array(F.lit("réponse structurée"))).when(supported, nothing).when(F.size("missing") > 0, F.col("missing")).otherwise(F.array(F.lit(NOTHING_NAMED)))
    return rows.select("answer_id", F.when(supported, "supported").otherwise("insufficient_evidence").alias("status"), F.when(F.col("readable"), F.col("required")).otherwise(nothing).alias("required"), missing.alias("missing"))


def extracts(hits: DataFrame) -> DataFrame:
    """``query_id, extracts``: the passages ``hits(query_id, rank, ref, title, date, path, text)`` as numbered blocks in order."""
    or_else = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    lines = [("BOI: ", F.col("ref")), ("Titre: ", F.coalesce("title", F.lit(""))), ("Date: ", or_else("date", "inconnue")), ("Section: ", or_else("path", "(sans section)")), ("Texte: ", F.coalesce("text", F.lit("")))]
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.concat_ws("\n", *[F.concat(F.lit(k), v) for k, v in lines]))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"])
    return hits.groupBy("query_id").agg(F.array_join(ordered, "\n\n").alias("extracts"))


def prompt(question: Column, extracts: Column, numbers: Column | None = None, instructions: str = "") -> Column:
    """What a model is asked: the question, its amounts (an array of lines) if there are any, the extracts, the instructions."""
    given = None if numbers is None else F.when(F.size(numbers) > 0, F.concat(F.lit("DONNEES CHIFFREES:\n"), F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("- "), n)), "\n")))
    parts = [F.concat(F.lit("QUESTION:\n"), question), given, F.concat(F.lit("EXTRAITS:\n"), F.coalesce(extracts, F.lit("")))]
    return F.concat_ws("\n\n", *[p for p in parts if p is not None], F.nullif(F.lit(instructions), F.lit("")))
