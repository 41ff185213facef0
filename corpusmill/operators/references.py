"""The reference tree: prefixes as an equi-join key in the place of string comparisons, families, specificity, acronyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.operators.passages import overlap_terms, prefixes_of, terms_overlap, token_overlap
from corpusmill.operators.staging import staged

#: Words that are no part of a spelled-out acronym.
FUNCTION_WORDS = "a au aux avec ce ces chez d dans de des du dont en et l la le les leur leurs ne ou par pas plus pour que qui sa sans ses son sous sur un une ii iii iv v vi vii viii ix x".split()
ACRONYM = r"\b[A-Z]{2,6}(?:\s?[0-9])?\b"
QUERY_ACRONYM = r"\b[A-Za-z]{2,6}(?:\s?[0-9])?\b"


def _overlap(pairs: DataFrame, queries: DataFrame, docs: DataFrame, chunk_texts: DataFrame | None) -> DataFrame:
    """Adds ``overlap``: question against the document's text, plus its best chunk, 30 at most.

    A text meets all questions of its document at once, so it is cut into terms once, however many ask for it.
    """
    said = queries.select("query_id", F.col("text").alias("_q"), overlap_terms(F.col("text")).alias("_t"))
    pairs = staged(pairs, "pairs")
    chunk_texts = None if pairs.isEmpty() else chunk_texts
    asking = pairs.select("ref", "query_id").join(said.select("query_id", "_t"), "query_id").groupBy("ref").agg(F.collect_list(F.struct("query_id", "_t")).alias("_asking"))
    texts = docs.select("ref", F.col("text").alias("_x"), F.lit(True).alias("_whole")).dropDuplicates(["ref"])
    if chunk_texts is not None:
        texts = texts.unionByName(chunk_texts.select("ref", F.col("text").alias("_x"), F.lit(False).alias("_whole")))
    each = t.let(overlap_terms(F.col("_x")), lambda x: F.transform("_asking", lambda q: F.struct(q["query_id"].alias("query_id"), terms_overlap(q["_t"], x).alias("_o"))))
    found = texts.join(asking, "ref").select("ref", "_whole", F.inline(each))
    best = found.groupBy("query_id", "ref").agg(F.max(F.when(F.col("_whole"), F.col("_o"))).alias("_d"), F.max(F.when(~F.col("_whole"), F.col("_o"))).alias("_c")).filter("_d is not null")
    rows = pairs.join(best, ["query_id", "ref"]).join(said.select("query_id", "_q"), "query_id")
    return rows.withColumn("overlap", F.least(F.lit(30.0), F.col("_d") + F.coalesce("_c", F.lit(0.0)))).drop("_d", "_c")


def _top(rows: DataFrame, k: int = 20) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "ref")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "ref", "score", "rank")


def exact_ranking(queries: DataFrame, docs: DataFrame, chunk_texts: DataFrame | None = None) -> DataFrame:
    """Documents that a question names, or that lie below such a reference: 120, else 105 less their depth, plus overlap."""
    targets = queries.select("query_id", F.posexplode(t.references(F.col("text"), 5)).alias("o", "target"))
    targets = targets.select("query_id", "o", t.normalize_reference(F.col("target")).alias("prefix")).filter("prefix <> ''")
    parts = F.split(t.normalize_reference(F.col("ref")), "-")
    tree = docs.select("ref").distinct().select("ref", F.size(parts).alias("depth"), F.explode(prefixes_of(parts)).alias("prefix"))
    found = targets.join(tree, "prefix").withColumn("extra", F.col("depth") - F.size(F.split("prefix", "-")))
    found = found.groupBy("query_id", "ref").agg(F.min_by("extra", "o").alias("extra"))
    rows = _overlap(found, queries, docs, chunk_texts)
    base = F.when(F.col("extra") == 0, 120.0).otherwise(105.0 - F.least(F.col("extra"), F.lit(6)))
    return _top(rows.withColumn("score", base + F.col("overlap")))


def navigation_bias(query: Column, ref: Column, title: Column, haystack: Column) -> Column:
    """Points for where a document stands: general rule against derogation, and rescripts that weren't asked for."""
    text = t.folded(haystack)
    derogation = F.contains(text, F.lit("derogation"))
    general = t.any_marker(text, t.GENERAL_RULE)
    bias = F.when(~derogation & general, 10.0).otherwise(0.0) - F.when(derogation & ~t.exception_intent(query, wide=True), 10.0).otherwise(0.0)
    bias = F.when(t.general_rule_intent(query, wide=False), bias).otherwise(0.0)
    rescript = F.startswith(F.upper(ref), F.lit("BOI-RES-")) & ~t.rescript_intent(query)
    return bias - F.when(rescript, F.when(token_overlap(query, title) >= 8.0, 3.0).otherwise(8.0)).otherwise(0.0)


def prefix_ranking(queries: DataFrame, docs: DataFrame, chunk_texts: DataFrame | None = None) -> DataFrame:
    """``queries(query_id, text, prefix)``: documents below the prefix by overlap, matching depth and bias.

    ``docs(ref, text, [title, haystack])``.  A prefix may end inside an element, so documents emit every leading
    string of their reference, with and without "boi-" and "boi-res-", and are joined by equality.
    """
    wanted = queries.select("query_id", "prefix", F.btrim(F.regexp_replace(F.lower(F.trim("prefix")), "^boi-", ""), F.lit("-")).alias("p")).filter("p <> ''")
    low = F.lower("ref")
    forms = F.array_compact(F.array(low, F.when(F.startswith(low, F.lit("boi-")), F.substr(low, F.lit(5))), F.when(F.startswith(low, F.lit("boi-res-")), F.substr(low, F.lit(9)))))
    heads = F.array_distinct(F.flatten(F.transform(forms, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.substring(x, F.lit(1), i)))))
    tree = docs.select("ref").distinct().select("ref", F.explode(heads).alias("p"))
    found = wanted.join(tree, "p").select("query_id", "prefix", "ref").distinct()
    rows = _overlap(found, queries, docs, chunk_texts)
    detailed = F.size(F.split(t.normalize_reference(F.col("prefix")), "-")) >= 3
    rows = rows.filter((F.col("overlap") > 0) | detailed)
    bias = F.lit(0.0)
    if "haystack" in docs.columns:
        rows = rows.join(docs.select("ref", "title", "haystack").dropDuplicates(["ref"]), "ref")
        bias = navigation_bias(F.col("_q"), F.col("ref"), F.col("title"), F.col("haystack"))
    return _top(rows.withColumn("score", F.col("overlap") + 0.25 * t.match_depth(F.col("ref"), F.col("prefix")) + bias))


def prefix_counts(refs: DataFrame, least: int = 1) -> DataFrame:
    """``prefix`` (array), ``n``: how many references (dates aside) begin with it, for prefixes of ``least`` elements or more."""
    core = t.reference_parts(F.col("ref"))
    every = F.transform(F.sequence(F.lit(1), F.size(core)), lambda i: F.slice(core, F.lit(1), i))
    rows = refs.select("ref").distinct().select(F.explode(every).alias("prefix")).filter(F.size("prefix") >= least)
    return rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


def descendant_counts(refs: DataFrame, least: int = 4) -> DataFrame:
    """``ref, descendants``: other references below each."""
    rows = refs.select("ref").distinct().withColumn("prefix", t.reference_parts(F.col("ref")))
    rows = rows.join(prefix_counts(refs, least), "prefix", "left")
    return rows.select("ref", F.greatest(F.lit(0).cast("long"), F.coalesce("n", F.lit(1).cast("long")) - 1).alias("descendants"))


def family_prefixes(anchors: DataFrame, refs: DataFrame, least: int = 4, most: int = 25, levels: int = 0) -> DataFrame:
    """``ref, prefix``: the longest leading part of each anchor that 2 to ``most`` references share, its own core if none.

    Shorter than the core, a prefix has ``least`` elements at least; ``levels`` widens it upwards while the rule holds.
    """
    core = t.reference_parts(F.col("ref"))
    each = F.transform(F.sequence(F.lit(1), F.size(core)), lambda i: F.slice(core, F.lit(1), i))
    rows = anchors.select("ref").distinct().select("ref", F.size(core).alias("depth"), F.explode(each).alias("prefix")).join(prefix_counts(refs), "prefix")
    fits = (F.col("n") > 1) & (F.col("n") <= most) & ((F.size("prefix") == F.col("depth")) | (F.size("prefix") >= least))
    rows = rows.withColumn("len", F.when(fits, F.size("prefix")))
    out = rows.groupBy("ref", "depth").agg(F.collect_set("len").alias("ok"), F.max_by("prefix", F.size("prefix")).alias("core"))
    length = F.coalesce(F.array_max("ok"), F.col("depth"))
    for _ in range(levels):
        length = F.when(F.array_contains("ok", length - 1) & (length - 1 >= least), length - 1).otherwise(length)
    return out.select("ref", F.slice("core", F.lit(1), length).alias("prefix"))


def family_members(families: DataFrame, refs: DataFrame) -> DataFrame:
    """``ref, prefix, member, place``: members by depth, then reference."""
    core = t.reference_parts(F.col("member"))
    each = F.transform(F.sequence(F.lit(1), F.size(core)), lambda i: F.slice(core, F.lit(1), i))
    tree = refs.select(F.col("ref").alias("member")).distinct().select("member", F.size(core).alias("depth"), F.explode(each).alias("prefix"))
    rows = families.join(tree, "prefix")
    w = Window.partitionBy("ref").orderBy("depth", "member")
    return rows.select("ref", "prefix", "member", F.row_number().over(w).alias("place"))


def family_union(hits: DataFrame, refs: DataFrame, top: int = 2, **options) -> DataFrame:
    """``query_id, member, place``: the families of a question's first ``top`` hits, each member once, in order."""
    anchors = hits.filter(F.col("rank") <= top)
    members = family_members(family_prefixes(anchors, refs, **options), refs)
    rows = anchors.select("query_id", "ref", "rank").join(members, "ref").groupBy("query_id", "member").agg(F.min(F.struct("rank", "place")).alias("at"))
    return rows.select("query_id", "member", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("place"))


def family_scores(family: DataFrame, prior: DataFrame, constant: int = 20, family_weight: float = 1.0, prior_weight: float = 0.25) -> DataFrame:
    """Scores of family hits (``query_id, ref, score, rank``) with the ranks that they had before (``prior``).

    Min-max strength within the family plus 1 / (constant + rank), weighed, plus the prior's reciprocal rank.
    """
    by = Window.partitionBy("query_id")
    span = F.max("score").over(by) - F.min("score").over(by)
    strength = F.when(span > 1e-9, (F.col("score") - F.min("score").over(by)) / span).otherwise(1.0)
    rows = family.withColumn("_s", strength).join(prior.select("query_id", "ref", F.col("rank").alias("prior_rank")), ["query_id", "ref"], "left")
    total = family_weight * (F.col("_s") + 1 / (constant + F.col("rank"))) + F.coalesce(prior_weight / (constant + F.col("prior_rank")), F.lit(0.0))
    rows = rows.withColumn("combined", total).withColumnRenamed("rank", "family_rank")
    w = by.orderBy(F.round("combined", 9).desc(), "family_rank", F.coalesce("prior_rank", F.lit(9999)), "ref")
    return rows.withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "ref", "combined", "family_rank", "prior_rank")


def specificity(hits: DataFrame, docs: DataFrame, queries: DataFrame, top: int = 5, weight: float = 0.05, least: int = 4, stem=None) -> DataFrame:
    """Reorders ``hits(query_id, ref, score, rank)``: of related documents, the one whose title's tail fits and that is deep and narrow gains.

    ``docs(ref, tail)`` has the title-tail text; ``stem`` may stand for ``tokens``.  Only documents that share
    ``least`` leading elements with another of the first ``top`` hits get a bonus.
    """
    toks = stem or t.tokens
    core = t.reference_parts(F.col("ref"))
    below = descendant_counts(docs, least)
    facts = docs.dropDuplicates(["ref"]).select("ref", F.size(core).alias("depth"), F.array_join(F.slice(core, 1, least), "-").alias("stem4"), F.array_except(toks(F.col("tail")), toks(F.col("ref"))).alias("tail_toks")).join(below, "ref")
    rows = hits.join(facts, "ref").join(queries.select("query_id", toks(F.col("text")).alias("q_toks")), "query_id")
    pool = rows.filter(F.col("rank") <= top)
    limits = pool.groupBy("query_id").agg(F.min("depth").alias("d0"), F.max("depth").alias("d1"), F.max("descendants").alias("most"))
    near = pool.filter(F.col("depth") >= least).groupBy("query_id", "stem4").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(limits, "query_id").join(near, ["query_id", "stem4"], "left")
    others = F.coalesce("n", F.lit(0)) - F.when(F.col("rank") <= top, 1).otherwise(0)
    overlap = F.when(F.size("tail_toks") > 0, F.size(F.array_intersect("q_toks", "tail_toks")) / F.size(F.array_distinct("tail_toks"))).otherwise(0.0)
    deep = F.when(F.col("d1") > F.col("d0"), (F.col("depth") - F.col("d0")) / (F.col("d1") - F.col("d0"))).otherwise(0.0)
    broad = F.when(F.col("most") > 0, F.col("descendants") / F.col("most")).otherwise(0.0)
    bonus = F.when((others > 0) & (F.col("depth") >= least), weight * F.greatest(F.lit(0.0), overlap + 0.2 * deep - 0.35 * broad)).otherwise(0.0)
    rows = rows.withColumn("bonus", bonus).withColumn("total", F.col("score") + F.col("bonus"))
    w = Window.partitionBy("query_id").orderBy(F.round("total", 9).desc(), F.round("bonus", 9).desc(), "rank")
    return rows.withColumn("new_rank", F.row_number().over(w)).select("query_id", F.col("new_rank").alias("rank"), "ref", F.col("total").alias("score"), "bonus")


def _words(text: Column) -> Column:
    plain = F.replace(t.folded(text), F.lit("'"), F.lit(" "))
    return F.filter(F.regexp_extract_all(plain, F.lit("[A-Za-zÀ-ÿ0-9]+"), F.lit(0)), lambda w: ~w.rlike(r"^\d+$") & ~w.isin(*FUNCTION_WORDS))


def _spelled(text: Column, wanted: Column) -> Column:
    """``acronym, phrase`` of every two to six words of a text whose initials are one of ``wanted``.

    The initials of all words, a mark for those without one, are a string; only texts whose string has a wanted acronym are
    cut into windows, which are substrings of it.
    """
    first = lambda x: F.when(F.left(x, F.lit(1)).between("a", "z"), F.upper(F.left(x, F.lit(1)))).otherwise("_")
    bare = lambda x: F.replace(x, F.lit("_"), F.lit(""))

    def windows(w: Column, initials: Column) -> Column:
        each = lambda s: F.transform(F.sequence(F.lit(2), F.least(F.lit(6), F.size(w) - s + 1)), lambda n: F.struct(s.alias("s"), n.alias("n"), bare(F.substring(initials, s, n)).alias("acronym")))
        found = F.filter(F.flatten(F.transform(F.sequence(F.lit(1), F.size(w) - 1), each)), lambda x: F.length(x["acronym"]).between(2, 6) & F.array_contains(wanted, x["acronym"]))
        return F.transform(found, lambda x: F.struct(x["acronym"].alias("acronym"), F.array_join(F.slice(w, x["s"], x["n"]), " ").alias("phrase")))

    any_of = lambda initials: t.let(bare(initials), lambda i: F.exists(wanted, lambda a: F.contains(i, a)))
    return t.let(_words(text), lambda w: t.let(F.array_join(F.transform(w, first), ""), lambda i: F.when((F.size(w) >= 2) & any_of(i), windows(w, i))))


def acronym_map(views: DataFrame, least: int = 2, most: int = 500, support: int = 2, ratio: float = 1.5) -> DataFrame:
    """``acronym, phrase, support``: ``views(ref, text)`` spelled out by phrases with these initials in the documents that use it.

    Only acronyms in ``least`` to ``most`` documents; a phrase must occur ``support`` times and ``ratio`` times as often as the next.
    """
    views = staged(views.select("ref", "text"), "views")
    used = views.select("ref", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ACRONYM), F.lit(0)))).alias("acronym")).distinct()
    used = used.filter(~F.lower("acronym").isin(*FUNCTION_WORDS))
    n_docs = used.groupBy("acronym").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(least, most))
    used = used.join(n_docs.select("acronym"), "acronym", "left_semi")
    # A document's acronyms meet its words before these are dealt out: only phrases with wanted initials become rows.
    mine = used.groupBy("ref").agg(F.collect_set("acronym").alias("mine"))
    segments = views.join(mine, "ref").select("mine", F.explode(F.split(t.normalize_ws(F.col("text")), r"\s+-\s+|\s*:\s*|\(|\)|;|,")).alias("seg"))
    phrases = segments.select(F.inline(_spelled(F.col("seg"), F.col("mine"))))
    counts = phrases.groupBy("acronym", "phrase").agg(F.count(F.lit(1)).alias("support"))
    w = Window.partitionBy("acronym").orderBy(F.desc("support"), "phrase")
    counts = counts.withColumn("next", F.lead("support").over(w)).withColumn("place", F.row_number().over(w))
    clear = F.col("next").isNull() | (F.col("support") / F.col("next") >= ratio)
    return counts.filter((F.col("place") == 1) & (F.col("support") >= support) & clear).select("acronym", "phrase", "support")


def expand_queries(queries: DataFrame, mapping: DataFrame, most: int = 3) -> DataFrame:
    """``query_id, text, expanded``: at most ``most`` phrases that the question doesn't have yet, in the order of its acronyms."""
    clean = t.normalize_ws(F.col("text"))
    words = queries.select("query_id", "text", F.posexplode(F.regexp_extract_all(clean, F.lit(QUERY_ACRONYM), F.lit(0))).alias("at", "word")).withColumn("acronym", F.upper(t.fold(F.col("word"))))
    found = words.join(mapping, "acronym").filter(~F.contains(t.folded(F.col("text")), F.col("phrase"))).groupBy("query_id", "phrase").agg(F.min("at").alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "phrase")
    found = found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    phrases = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "phrase"))), lambda x: x["phrase"]), " ").alias("more"))
    return queries.join(phrases, "query_id", "left").select("query_id", "text", F.concat_ws(" ", clean, "more").alias("expanded"))
