"""Corpus-wide line dedup with one edit of tolerance, by deletion neighbourhoods.  DataFrame functions only.

A line is removed if an earlier line (by document id, then line number) is equal or one edit away.

1.  Equal lines are one class, at its earliest place; partial sums meet before the shuffle, so a line that a
    third of all documents hold is one row a task.
2.  Two lines one edit apart share their first or their last half, at equal lengths or lengths one apart.  Four
    hashed half-line keys a class find the lines that have such a partner; only these go on.
3.  These emit their deletion neighbourhood, every variant with one character less, as a hashed key with the
    place of the deletion, and themselves at place 0.  Equal variants of equal place are a substitution apart; a
    variant that equals a line is a deletion apart.  Distinct lines that share a variant are at most (length + 1)
    times the alphabet, whatever the size of the corpus, so the groups are bounded; within one, only the earliest
    line is handed on, never the pairs.
4.  The edit distance of every line and its earlier neighbours is verified on the text; then the lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import free_name, written
from corpusmill.llm.quality import let, without

KEY = ["nul", "id0", "th"]


def _key(id_col: Column, text: Column) -> list[Column]:
    """A document's identity: is its id null, the id, the text's hash.  In this order documents are earlier or later."""
    return [id_col.isNull().alias("nul"), F.coalesce(id_col, F.lit(0)).cast("long").alias("id0"), F.xxhash64(text).alias("th")]


def _halves(line: Column, length: Column) -> Column:
    """Half-line keys: first and last half, as a line of this length and as one longer by a character than its partner."""
    def pair(n: Column) -> list[Column]:
        first = F.floor(n / 2).cast("int")
        return [F.xxhash64(n, F.lit(1), F.substring(line, F.lit(1), first)), F.xxhash64(n, F.lit(2), F.substring(line, length - (n - first) + 1, n - first))]

    return F.array(*pair(length), *pair(length - 1))


def _pieces(line: Column, length: Column, shorter: int) -> Column:
    """``line`` in pieces of 64 characters or the root of ``length``: ``p``, ``at``, ``piece``, and the hashes of what is before and after.

    ``shorter`` 1: the pieces of a line of ``length``, one more than its own, from which a character of the piece is gone.
    """
    step = F.greatest(F.lit(64), F.ceil(F.sqrt(length)).cast("int"))

    def one(p: Column) -> Column:
        at, end = p * step, F.least(length, (p + 1) * step) - shorter
        return F.struct(
            p.alias("p"),
            at.alias("at"),
            F.substring(line, at + 1, end - at).alias("piece"),
            F.xxhash64(F.substring(line, F.lit(1), at)).alias("before"),
            F.xxhash64(F.substring(line, end + 1, length)).alias("after"),
        )

    return F.transform(F.sequence(F.lit(0), F.ceil(length / step).cast("int") - 1), one)


def _itself(line: Column) -> Column:
    """The line as what a line longer by one character becomes by a deletion: a key for each of that line's pieces, at place 0."""
    length = F.length(line) + 1
    return F.transform(_pieces(line, length, 1), lambda x: F.struct(F.xxhash64(length, x["p"], x["before"], x["piece"], x["after"]).alias("v"), F.lit(0).alias("i")))


def _less(line: Column) -> Column:
    """All variants with one character less: hashed keys with the place of the deletion, from 1.

    A variant's key is that of its piece without the character and of what is around it, so a line of n
    characters costs about n times a piece, not n times n.
    """
    length = F.length(line)

    def variants(x: Column) -> Column:
        n = F.length(x["piece"])
        gone = lambda i: F.concat(F.substring(x["piece"], F.lit(1), i - 1), F.substring(x["piece"], i + 1, n))
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.xxhash64(length, x["p"], x["before"], gone(i), x["after"]).alias("v"), (x["at"] + i).alias("i")))

    return F.flatten(F.transform(_pieces(line, length, 0), variants))


def _bits(keys: DataFrame, n_words: int) -> DataFrame:
    """One row with ``bits``: 64 * n_words bits, of which those of the keys' hashes are set."""
    at = F.pmod(F.xxhash64(*KEY, F.lit(5)), F.lit(64 * n_words))
    some = keys.select(F.floor(at / 64).cast("int").alias("w"), F.pmod(at, F.lit(64)).cast("int").alias("b"))
    words = some.groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("v"))
    every = keys.sparkSession.range(n_words).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    every = every.agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("v", F.lit(0).cast("long")).alias("v")))).alias("c"))
    return every.select(F.transform("c", lambda x: x["v"]).alias("bits"))


def _always(line: Column, min_chars: int, short_repeats: bool) -> Column:
    """Does the line stay whatever came before it?"""
    return without(line, " \t\x0b\x0c\r") == "" if short_repeats else F.length(line) < min_chars


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 20, short_repeats: bool = False) -> DataFrame:
    """For each document that has lines to keep: ``nul, id0, th`` and ``kept``, the sorted numbers (from 0) of its eligible lines that stay.

    Eligible are lines of ``min_chars`` characters or more, with ``short_repeats`` every line that isn't blank; an
    eligible line that isn't listed is removed.  Only lines of ``min_chars`` or more have neighbours one edit away.
    """
    base = docs.select(*_key(F.col(id_col), F.col(text_col)), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = base.select(*KEY, F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("len", F.length("line"))
    lines = lines.filter(~_always(F.col("line"), min_chars, short_repeats))
    place = F.struct(*KEY, "no").alias("place")
    hashed = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("2"), "line").alias("h2"), place, F.when(F.col("len") >= min_chars, _halves(F.col("line"), F.col("len"))).alias("keys"))
    classes = written(hashed.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.first("keys").alias("keys")), "lines")

    keys = classes.select("h1", "h2", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    near = keys.join(shared, "key", "left_semi").select("h1", "h2").distinct()
    near = written(classes.join(near, ["h1", "h2"], "left_semi").select("place"), "lines-near")
    wanted = near.groupBy(*[F.col(f"place.{k}").alias(k) for k in KEY]).agg(F.collect_list("place.no").alias("nos"))
    # Only documents with such lines are dealt out: a bit filter of bounded size, which may let others pass.
    n_words = 1 << max(6, min(17, (near.count() // 4).bit_length()))
    rows = base.withColumn("_bits", _bits(wanted, n_words).scalar())
    at = F.pmod(F.xxhash64(*KEY, F.lit(5)), F.lit(64 * n_words))
    rows = rows.filter(F.call_function("getbit", F.get("_bits", F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1).drop("_bits").dropDuplicates(KEY)
    text = let(F.split("text", "\n"), lambda parts: F.transform("nos", lambda i: F.struct(i.alias("no"), F.get(parts, i).alias("line"))))
    found = rows.join(wanted, KEY).select(*KEY, F.inline(text))
    ranked = written(found.orderBy(*KEY, "no").withColumn("rank", F.monotonically_increasing_id()), "lines-ranked")

    variants = ranked.select("rank", F.inline(F.concat(_itself(F.col("line")), _less(F.col("line")))))
    one, all_ = Window.partitionBy("v", "i"), Window.partitionBy("v")
    line_itself = F.max(F.when(F.col("i") == 0, F.col("rank"))).over(all_)
    shorter = F.min(F.when(F.col("i") > 0, F.col("rank"))).over(all_)
    witness = F.when(F.col("i") == 0, shorter).otherwise(F.least(F.min("rank").over(one), line_itself))
    pairs = variants.withColumn("earlier", witness).filter("earlier < rank").select("rank", "earlier").distinct()
    earlier = ranked.select(F.col("rank").alias("earlier"), F.col("line").alias("line2"))
    gone = pairs.join(ranked, "rank").join(earlier, "earlier").filter(F.levenshtein("line", "line2", 1).between(0, 1)).select(*KEY, "no").distinct()

    stays = classes.select(*[F.col(f"place.{k}").alias(k) for k in [*KEY, "no"]]).join(gone, [*KEY, "no"], "left_anti")
    return stays.groupBy(*KEY).agg(F.sort_array(F.collect_list("no")).alias("kept"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 20, short_repeats: bool = False) -> DataFrame:
    """``docs`` without their removed lines; adds ``n_lines`` and ``n_removed`` (int; replacing columns of these names).

    Lines are what ``\\n`` separates; those shorter than ``min_chars`` characters always stay, or, with
    ``short_repeats``, go if an earlier line is equal (blank ones stay).  What stays keeps its order.  A null text stays null (0 lines).  A null id is later than every other.  Rows that are equal in id and
    text are one document and lose the same lines; different texts under one id come in the order of their hashes.
    Other columns stay as they are.
    """
    kept = removed_lines(docs, id_col, text_col, min_chars=min_chars, short_repeats=short_repeats)
    rows = docs.drop("n_lines", "n_removed")
    names = [free_name(rows, f"_{k}") for k in KEY]
    kept = kept.select(*[F.col(k).alias(n) for k, n in zip(KEY, names, strict=True)], F.col("kept").alias(free_name(rows, "_kept")))
    found = kept.columns[-1]
    rows = rows.withColumns({n: c for n, c in zip(names, _key(rows[id_col], rows[text_col]), strict=True)})
    rows = rows.join(kept, names, "left").drop(*names)
    # A flag for each line from the sorted numbers: runs of False closed by True; one pass, whatever the length.
    numbers = F.coalesce(F.col(found), F.expr("array()").cast("array<int>"))
    flags = let(numbers, lambda k: F.flatten(F.transform(k, lambda x, i: F.concat(F.array_repeat(F.lit(False), x - F.coalesce(F.get(k, i - 1), F.lit(-1)) - 1), F.array(F.lit(True))))))
    stays = lambda parts: let(flags, lambda f: F.filter(parts, lambda x, i: _always(x, min_chars, short_repeats) | F.coalesce(F.get(f, i), F.lit(False))))
    parts = F.split(F.col(text_col), "\n")
    made = let(parts, lambda p: let(stays(p), lambda s: F.struct(F.array_join(s, "\n").alias("text"), F.size(p).alias("n"), (F.size(p) - F.size(s)).alias("gone"))))
    name = free_name(rows, "_made")
    rows = rows.withColumn(name, made)
    null = F.col(text_col).isNull()
    out = [F.when(~null, F.col(f"{name}.text")).alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    count = lambda field: F.when(null, 0).otherwise(F.col(f"{name}.{field}")).cast("int")
    return rows.select(*out, count("n").alias("n_lines"), count("gone").alias("n_removed"))
