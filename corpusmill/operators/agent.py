"""The agent's rules as relations, and its loop around an injected client.

The client is any callable from a task name and a payload to a dict; it runs on executors in batches, three attempts a
call, and a failed call is an answer with insufficient evidence.  Nothing here reaches a network of its own.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t

#: Tax families and the words of a question that point to them.
TAXONOMY = {
    "TVA": ["tva", "taxe sur la valeur ajoutee", "territorialite tva", "lieu des prestations", "prestation b2b", "b2b", "preneur assujetti", "intracommunautaire"],
    "IR": ["impot sur le revenu", "prelevement a la source", "foyer fiscal", "quotient familial"],
    "RSA": ["salaire", "salaires", "traitements salaires", "traitement salaire", "rupture conventionnelle", "indemnite de rupture", "indemnites de rupture", "rupture du contrat de travail", "fin de contrat", "licenciement", "mandataire social", "mandataires sociaux", "dirigeant", "dirigeants", "cessation de fonctions", "cessation des fonctions"],
    "BIC": ["bic", "micro-bic", "benefices industriels", "chiffre d'affaires", "auto-entrepreneur", "entrepreneur", "location meublee", "loueur en meuble", "loueurs en meuble", "lmnp", "meuble non professionnel", "location meublee non professionnelle"],
    "BNC": ["bnc", "profession liberale", "honoraires", "micro-bnc"],
    "IS": ["impot sur les societes", "societe soumise a l'is", " is "],
    "RFPI": ["revenus fonciers", "location nue", "micro-foncier", "micro foncier", "loyers", "charges de copropriete", "copropriete", "plus-value immobiliere", "plus value immobiliere", "vente appartement", "vente maison", "residence principale"],
    "RPPM": ["cto", "compte titre", "compte-titre", "compte titres", "compte-titres", "valeurs mobilieres", "titre financier", "titres financiers", "cession de titres", "plus-value", "plus value", "moins-value", "moins value", "actions", "pea", "pea-pme", "plan epargne en actions", "plan d epargne en actions", "plan d'epargne en actions", "dividende", "revenus mobiliers", "per ", "plan epargne retraite"],
    "CF": ["controle fiscal", "redressement", "interet de retard", "interets de retard", "majoration", "penalite"],
    "ENR": ["succession", "donation", "droits d'enregistrement"],
    "IF": ["taxe fonciere", "cfe", "cvae", "cotisation fonciere"],
}
AXIS_STOPWORDS = ["avec", "dans", "pour", "sans", "selon", "cette", "celui", "celle", "entre", "ainsi"]


def taxonomy_route(questions: DataFrame, most: int = 4) -> DataFrame:
    """``query_id, prefix, score, rank``: tax families by how many of their markers a question has."""
    families = F.array(*[F.struct(F.lit(p).alias("prefix"), F.array(*[F.lit(m) for m in ms]).alias("markers")) for p, ms in TAXONOMY.items()])
    counted = t.let(F.lower(t.fold(F.col("text"))), lambda said: F.transform(families, lambda f: F.struct(f["prefix"].alias("prefix"), F.size(F.filter(f["markers"], lambda m: F.contains(said, m))).alias("score"))))
    rows = questions.select("query_id", F.inline(counted)).filter("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "prefix")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def axis_tokens(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(t.fold(text)), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(found, lambda w: (F.length(w) >= 4) & ~w.isin(*AXIS_STOPWORDS))


def axes_match(a: Column, b: Column) -> Column:
    """One within the other, or the smaller's words all in the larger, or two thirds of them and two at least."""
    x, y = F.lower(t.fold(F.trim(a))), F.lower(t.fold(F.trim(b)))
    inside = F.contains(x, y) | F.contains(y, x)

    def by_words(w: Column) -> Column:
        least, both = F.least(F.size(w["a"]), F.size(w["b"])), F.size(F.array_intersect(w["a"], w["b"]))
        return (least > 0) & ((both == least) | ((both >= 2) & (both >= least * 0.67)))

    words = t.let(F.struct(axis_tokens(a).alias("a"), axis_tokens(b).alias("b")), by_words)
    return (x != "") & (y != "") & (inside | words)


def evidence_matrix(axes: DataFrame, chunks: DataFrame, covered: DataFrame, missing: DataFrame, match: Callable[[Column, Column], Column] = axes_match) -> DataFrame:
    """``query_id, axis, role, blocking, status, candidate_refs``: what is known of each axis of a plan.

    ``axes(query_id, axis, role, blocking)``, ``chunks(query_id, rank, ref, text, final)``, ``covered`` and ``missing``
    ``(query_id, axis)``.  Everything belongs to one question, so all joins are by ``query_id``.
    """
    hits = axes.join(chunks, "query_id").filter(match(F.col("axis"), F.col("text")))
    refs = F.array_sort(F.collect_list(F.struct("rank", "ref")))
    found = hits.groupBy("query_id", "axis").agg(F.slice(F.array_distinct(F.transform(refs, lambda x: x["ref"])), 1, 8).alias("refs"), F.max("final").alias("final"))

    def named(claims: DataFrame, flag: str) -> DataFrame:
        other = claims.select("query_id", F.col("axis").alias("_o"))
        return axes.select("query_id", "axis").join(other, "query_id").filter(axes_match(F.col("axis"), F.col("_o"))).select("query_id", "axis").distinct().withColumn(flag, F.lit(True))

    rows = axes.join(found, ["query_id", "axis"], "left").join(named(covered, "_c"), ["query_id", "axis"], "left").join(named(missing, "_m"), ["query_id", "axis"], "left")
    final = F.coalesce("final", F.lit(False))
    status = F.when(final & F.col("_c"), "covered_final").when(final, "final_unclaimed").when(F.col("refs").isNotNull(), "candidate_only").when(F.col("_m"), "missing").otherwise("not_found")
    return rows.select("query_id", "axis", "role", "blocking", status.alias("status"), F.coalesce(F.array_join("refs", ","), F.lit("")).alias("candidate_refs"))


def branch_key(ref: Column) -> Column:
    return F.array_join(F.slice(t.reference_parts(ref), 1, 3), "-")


def diversify(candidates: DataFrame, most: int, branch: Column | None = None) -> DataFrame:
    """``query_id, ref, place``: the first reference of each branch, in order, then the others; ``most`` a question.

    ``candidates(query_id, ref, pos)``; references whose ``branch`` is null are alone in theirs.
    """
    first = Window.partitionBy("query_id", "branch").orderBy("pos")
    rows = candidates.withColumn("branch", branch_key(F.col("ref")) if branch is None else branch)
    rows = rows.withColumn("late", ((F.row_number().over(first) > 1) & F.col("branch").isNotNull()).cast("int"))
    w = Window.partitionBy("query_id").orderBy("late", "pos")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("query_id", "ref", "place")


def parse_json(text: str | None) -> dict | None:
    """The first object in a reply: as it is, or in a fenced block, or between the outer braces."""
    text = text or ""
    for part in (text, *re.findall(r"```(?:json)?\s*(.*?)```", text, re.S), text[text.find("{") : text.rfind("}") + 1]):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


#: How a provider says how long to wait, and the pause after a failure that doesn't, in seconds for each attempt so far.
RETRY = [re.compile(x, re.I) for x in t.RETRY]
PAUSE, LONGEST = 3.0, 60.0


def asked_delay(error: object) -> float | None:
    """:func:`corpusmill.functions.text.retry_delay` of one message."""
    found = [float(x) for pattern in RETRY for x in pattern.findall(str(error or ""))]
    return max(found, default=None)


def call(client: Callable[[str, dict], object], task: str, payload: dict, attempts: int = 3, pause: Callable[[float], object] = time.sleep) -> dict:
    """A reply as a dict; a client that fails or says nothing readable ``attempts`` times has insufficient evidence.

    Before another attempt after a failure it pauses, for as long as the error asks (at most ``LONGEST``) or a little more each time.
    """
    problem = "no readable reply"
    for attempt in range(1, attempts + 1):
        try:
            reply = client(task, payload)
        except Exception as e:  # the client is foreign code: whatever it raises is a failed attempt
            problem = f"client failed: {e}"
            if attempt < attempts:
                asked = asked_delay(e)
                pause(min(LONGEST, PAUSE * attempt if asked is None else asked))
            continue
        found = reply if isinstance(reply, dict) else parse_json(str(reply))
        if found is not None:
            return found
    return {"answer_status": "insufficient_evidence", "error": problem}


def stub_client(task: str, payload: dict) -> dict:
    """A deterministic stand-in: plans one axis a question, covers it if there are sources, and cites the first two."""
    if task == "plan":
        return {"facets": [{"name": payload["question"][:60], "role": "core", "blocking": True}]}
    sources = payload.get("sources") or []
    if task == "review":
        return {"covered_axes": payload["axes"] if sources else [], "missing_axes": [] if sources else payload["axes"]}
    if not sources:
        return {"answer_status": "insufficient_evidence", "conclusion": "Preuve insuffisante.", "limits": "Aucune source.", "bullets": ["Les extraits ne permettent pas de répondre."]}
    return {"answer_status": "supported", "conclusion": sources[0][:80], "limits": "Réponse de substitution.", "bullets": [f"{s[:60]} [{i}]" for i, s in enumerate((sources * 2)[:2], start=1)]}


def answer(questions: DataFrame, evidence: DataFrame, client: Callable[[str, dict], object] = stub_client, most: int = 12) -> DataFrame:
    """Plan, review and answer for every question: ``query_id, status, conclusion, limits, bullets, covered, required, missing, n_sources``.

    ``evidence(query_id, rank, ref, text)``, at most ``most`` rows a question.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref", "text"))), lambda x: F.concat(x["ref"], F.lit(": "), x["text"]))
    sources = evidence.filter(F.col("rank") <= most).groupBy("query_id").agg(listed.alias("sources"))
    rows = questions.select("query_id", "text").join(sources, "query_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query_id, text, found in batch.itertuples(index=False):
                texts = [] if found is None else list(found)
                plan = call(client, "plan", {"question": text})
                axes = [f.get("name", "") for f in plan.get("facets") or [] if isinstance(f, dict)][:5]
                review = call(client, "review", {"question": text, "axes": axes, "sources": texts})
                reply = call(client, "answer", {"question": text, "review": review, "sources": texts})
                n = [len(review.get(k) or []) for k in ("covered_axes", "missing_axes")]
                out.append((query_id, str(reply.get("answer_status") or "unknown"), str(reply.get("conclusion") or ""), str(reply.get("limits") or ""), [str(b) for b in reply.get("bullets") or []], n[0], len(axes), n[1], len(texts)))
            yield pd.DataFrame(out, columns=["query_id", "status", "conclusion", "limits", "bullets", "covered", "required", "missing", "n_sources"])

    return rows.mapInPandas(run, "query_id long, status string, conclusion string, limits string, bullets array<string>, covered int, required int, missing int, n_sources int")
