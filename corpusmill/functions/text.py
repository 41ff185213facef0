"""Text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that decide tokens, references, amounts and secrets.  Those that
#: Python also uses have no flags; in the others (?U) says that classes, borders and case are Unicode's.
TOKEN = r"[A-Za-zÀ-ÿ0-9]+"
TOKEN_HYPHENATED = r"[A-Za-zÀ-ÿ0-9][A-Za-zÀ-ÿ0-9\-_\.]*"
REFERENCE = r"(?iU)\bBOI-[A-Z0-9]+(?:-[A-Z0-9]+)*\b"
LEGAL = [
    r"\barticle\s+[A-ZL]?\s*\.?\s*\d+[A-Za-z0-9\-\s]*(?:bis|ter|quater|quinquies)?\s+du\s+(?:CGI|LPF)\b",
    r"\b(?:CGI|LPF)\s+art\.?\s*[A-ZL]?\s*\.?\s*\d+[A-Za-z0-9\-\s]*(?:bis|ter|quater|quinquies)?\b",
]
NUMERIC_INTENT = r"(?iU)\b(seuil|seuils|taux|plafond|plafonds|bareme|chiffre\s+d['’ ]affaires|combien|calcul|calcule|pourcentage|euros?|ht|hors\s+taxe)\b"
AMOUNT = r"(?iU)\b\d[\d\s]*(?:[,.]\d+)?\s*(?:€|euros?\b|%|pour\s*cent\b)"
SCALE = r"(?iU)\bBOI-BAREME-\d+\b|\bbareme\b"
NUMERIC_SECTION = r"(?iU)\b(seuil|seuils|taux|limite|limites|plafond|plafonds|bareme|chiffre\s+d['’ ]affaires)\b"
NUMBER = r"(?U)\d(?:[\d\s .,]*\d)?"
TRIVIAL = r"(?:[\W_]+|\(\d+(?:[-–]\d+)?\)|\d+(?:[-–]\d+)?|N(?:[+-]\d+)?|Article\s+\d+(?:\s+et\s+\d+)?|Cf\..*|Remarques?\s*:?)"
NON_PRINCIPLE_LEAD = r"(?iU)^\s*(remarque|exemple|reponse)\s*:"
SECRETS = [r"(?U)\bsk-[A-Za-z0-9_\-]{12,}\b", r"(?U)\bhf_[A-Za-z0-9_\-]{12,}\b", r"(?iU)\b(api[_-]?key|authorization|x-api-key)\s*[:=]\s*['\"]?[^'\"\s]+"]
SECRET_MARK = "[REDACTED_SECRET]"
MOJIBAKE = ["Ã", "Â", "â€", "â€™", "â€œ", "â€“", "â€”", "â‚¬"]
RETRY = [r"(?i)retry in ([0-9]+(?:\.[0-9]+)?)s", r"(?i)'retryDelay': '([0-9]+(?:\.[0-9]+)?)s'"]
STOPWORDS = ["avec", "dans", "dois", "dont", "elle", "egal", "etre", "fait", "fixe", "hors", "leur", "pour", "quel", "quelle", "sans", "taxe"]
GENERAL_RULE = ["regle generale", "regles generales", "droit commun"]
PRINCIPLE = ["principes generaux", *GENERAL_RULE]
EXCEPTION = ["derogation", "exception"]
EXCEPTION_WIDE = [*EXCEPTION, "cas particulier", "regle particuliere", "regle specifique"]


#: What is a character reference, and white space besides Unicode's property.
CHARACTER_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
WHITE = r"[\s\x1c-\x1f]"
#: Not characters: marks in tables and texts that no text has.
MARK, EQUALS = "\uffff", "\ufffe"
HANGUL = 0xAC00


@functools.cache
def _folding() -> tuple[str, str, str, str, str, str]:
    """Tables of the compatibility decomposition without marks, made by rule from Unicode's own.

    From and to of a translation that gives ``MARK`` for what becomes several characters, from and to of one that leaves
    these, the characters that become several, and what they become, by lines.
    """
    one, many, gone = [], [], []
    for code in range(0x80, 0x110000):
        char = chr(code)
        if not unicodedata.combining(char) and not unicodedata.decomposition(char):
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if base == "":
            gone.append(char)
        elif base != char:
            (one if len(base) == 1 else many).append((char, base))
    source, target = "".join(a for a, _ in one), "".join(b for _, b in one)
    several = "".join(a for a, _ in many)
    return source + several + "".join(gone), target + MARK * len(several), source + "".join(gone), target, several, "\n".join(b for _, b in many)


@functools.cache
def _named() -> tuple[str, str]:
    """All named character references with their values in one string, and a pattern of those that need no semicolon, longest first."""
    table = MARK + MARK.join(f"{name}{EQUALS}{value}" for name, value in html5.items()) + MARK
    bare = sorted((name for name in html5 if name[-1] != ";"), key=lambda x: (-len(x), x))
    return table, "^(" + "|".join(bare) + ")"


@functools.cache
def _jamo() -> list[str]:
    """First, middle and last parts of Hangul syllables, by lines."""
    parts = [unicodedata.normalize("NFKD", chr(HANGUL + i)) for i in range(19 * 588)]
    return ["\n".join(p[0] for p in parts[::588]), "\n".join(p[1] for p in parts[:588:28]), "\n".join(p[2:] for p in parts[:28])]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often (and inside whatever lambda) ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _quoted(text: str) -> str:
    """A SQL string."""
    for char, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n")):
        text = text.replace(char, escaped)
    return f"'{text}'"


def _bound(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _with(text: Column, function: str) -> Column:
    """The SQL lambda ``function`` of ``text``: parsed as a whole, since a call for every part of so long an expression takes long."""
    return F.call_function("get", F.call_function("transform", F.array(text), F.expr(function)), F.lit(0))


@functools.cache
def _unescape() -> str:
    """SQL lambda that decodes character references by HTML's rules: the longest name that needs no semicolon where the whole is
    none; numbers that are no code point or a surrogate, those that stand for nothing, and Windows' own from 128 to 159.
    """
    table, bare = _named()
    windows = "\n".join(bytes([i]).decode("cp1252", "replace").replace("\ufffd", chr(i)) for i in range(128, 160))
    digits = "ltrim('0', regexp_extract(r, '([0-9a-fA-F]+)', 1))"
    number = _bound("d", digits, "CASE WHEN length(d) > 8 THEN 4294967296L WHEN d = '' THEN 0L WHEN r RLIKE '^&#[xX]' THEN cast(conv(d, 16, 10) AS bigint) ELSE cast(d AS bigint) END")
    nothing = "n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR (n & 65534L) = 65534"
    char = f"""CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN '\ufffd' WHEN n BETWEEN 128 AND 159 THEN get(split({_quoted(windows)}, '\\n'), cast(n - 128 AS int))
        WHEN {nothing} THEN '' ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END"""

    def value(name: str) -> str:
        found = f"CASE WHEN at > 0 THEN substring_index(substring(named, at + length({name}) + 2, 3), '{MARK}', 1) END"
        return _bound("at", f"position(concat('{MARK}', {name}, '{EQUALS}'), named)", found)

    prefix = _bound("b", f"regexp_extract(m, {_quoted(bare)}, 1)", f"CASE WHEN b <> '' THEN concat({value('b')}, substring(m, length(b) + 1)) END")
    name = _bound("m", "substring(r, 2)", f"CASE WHEN m = 'amp;' THEN '&' ELSE coalesce({value('m')}, {prefix}, r) END")
    pattern = _quoted(CHARACTER_REFERENCE)
    meant = f"transform(regexp_extract_all(x, {pattern}, 0), r -> CASE WHEN startswith(r, '&#') THEN {_bound('n', number, char)} ELSE {_bound('named', _quoted(table), name)} END)"
    return f"x -> CASE WHEN contains(x, '&') THEN array_join(flatten(zip_with(split(x, {pattern}, -1), concat({meant}, array('')), (a, b) -> array(a, b))), '') ELSE x END"


@functools.cache
def _fold() -> str:
    """SQL lambda of the compatibility decomposition without marks: ASCII as it is, else a translation, and where that meets what
    becomes several characters, these replaced one by one.
    """
    first, to, second, to_second, several, values = _folding()
    begin, middle, end = (f"split({_quoted(x)}, '\\n')" for x in _jamo())
    hangul = f"c BETWEEN '{chr(HANGUL)}' AND '\ud7a3'"
    i = f"(ascii(c) - {HANGUL})"
    syllable = f"concat(get({begin}, cast({i} div 588 AS int)), get({middle}, cast({i} % 588 div 28 AS int)), get({end}, {i} % 28))"
    expansion = f"CASE WHEN {hangul} THEN {syllable} ELSE get(split({_quoted(values)}, '\\n'), position(c, {_quoted(several)}) - 1) END"
    chars = f"filter(array_distinct(split(x, '')), c -> c <> '' AND (position(c, {_quoted(several)}) > 0 OR {hangul}))"
    expanded = f"translate(aggregate({chars}, x, (z, c) -> replace(z, c, {expansion})), {_quoted(second)}, {_quoted(to_second)})"
    rare = f"contains(y, '{MARK}') OR y RLIKE '[\uac00-\ud7a3]'"
    body = _bound("y", f"translate(x, {_quoted(first)}, {_quoted(to)})", f"CASE WHEN {rare} THEN {expanded} ELSE y END")
    return f"x -> CASE WHEN octet_length(x) = length(x) THEN x ELSE {body} END"


def unescape(text: Column) -> Column:
    """All character references decoded, once, as HTML's rules have it."""
    return _with(text, _unescape())


def normalize_ws(text: Column) -> Column:
    """Character references decoded, every run of Unicode white space one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(unescape(F.coalesce(text, F.lit(""))), f"(?U){WHITE}+", " "))


def fold(text: Column) -> Column:
    """The compatibility decomposition without marks: accents removed, ligatures and the like spelled out, case kept; white space as it is."""
    return _with(text, _fold())


def fold_accents(text: Column) -> Column:
    return fold(normalize_ws(text))


def folded(text: Column) -> Column:
    """Normalized, without accents, in lower case: what markers and tokens are looked for in."""
    return F.lower(fold_accents(text))


def tokens(text: Column, hyphenated: bool = False) -> Column:
    """Tokens of the folded text; ``hyphenated`` keeps inner ``-``, ``_`` and ``.`` in a token."""
    return F.regexp_extract_all(folded(text), F.lit(TOKEN_HYPHENATED if hyphenated else TOKEN), F.lit(0))


def n_words(text: Column) -> Column:
    clean = normalize_ws(text)
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))


def token_count(text: Column) -> Column:
    """1.25 tokens a word, rounded half to even, at least 1; 0 for blank text."""
    n = n_words(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(n * F.lit(1.25)).cast("int"))).cast("int")


def tokens_of_words(n: Column) -> Column:
    """:func:`token_count` from a number of words."""
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(n * F.lit(1.25)).cast("int"))).cast("int")


def slugify(text: Column) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(normalize_ws(text)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("node"))


def distinct_by(items: Column, key) -> Column:
    """First occurrences in order, by ``key`` of the item."""
    return let(items, lambda a: let(F.transform(a, key), lambda keys: F.filter(a, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def legal_refs(text: Column) -> Column:
    """Articles of the two codes, pattern by pattern, deduplicated without regard to case."""
    value = F.coalesce(text, F.lit(""))
    found = F.concat(*[F.transform(F.regexp_extract_all(value, F.lit("(?iU)" + p), F.lit(0)), lambda x: F.regexp_replace(x, rf"(?U){WHITE}+\z", "")) for p in LEGAL])
    return distinct_by(found, F.lower)


def references(text: Column, most: int | None = None) -> Column:
    """Upper-case references in order of their first occurrence, at most ``most``."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(REFERENCE), F.lit(0)), F.upper))
    return found if most is None else F.slice(found, 1, most)


def normalize_reference(ref: Column) -> Column:
    return F.btrim(F.regexp_replace(F.upper(F.trim(ref)), "^BOI-", ""), F.lit("-"))


def reference_parts(ref: Column) -> Column:
    """The elements of a reference, without a final date of eight digits."""
    parts = F.split(F.trim(ref), "-")
    return F.when(F.element_at(parts, -1).rlike(r"^\d{8}$"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def followable(ref: Column) -> Column:
    return F.size(F.split(normalize_reference(ref), "-")) >= 3


def exact_or_child(ref: Column, target: Column) -> Column:
    a, b = normalize_reference(ref), normalize_reference(target)
    return (b != "") & ((a == b) | F.startswith(a, F.concat(b, F.lit("-"))))


def matches_prefix(ref: Column, prefix: Column) -> Column:
    p = F.btrim(F.regexp_replace(F.lower(F.trim(prefix)), "^boi-", ""), F.lit("-"))
    r = F.lower(ref)
    return (p != "") & (F.startswith(r, p) | F.startswith(r, F.concat(F.lit("boi-"), p)) | F.startswith(r, F.concat(F.lit("boi-res-"), p)))


def family_match(a: Column, b: Column) -> Column:
    """Equal without date, or one an ancestor of the other."""
    x, y = F.array_join(reference_parts(F.upper(a)), "-"), F.array_join(reference_parts(F.upper(b)), "-")
    dash = F.lit("-")
    return (x == y) | F.startswith(x, F.concat(y, dash)) | F.startswith(y, F.concat(x, dash))


def match_depth(ref: Column, prefix: Column) -> Column:
    """How many leading elements are equal."""
    a, b = F.split(normalize_reference(ref), "-"), F.split(normalize_reference(prefix), "-")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, x: F.struct((s["n"] + (s["go"] & x).cast("int")).alias("n"), (s["go"] & x).alias("go")), lambda s: s["n"])


def redact_secrets(text: Column) -> Column:
    """Keys and authorization values replaced by a mark."""
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, F.lit(SECRET_MARK))
    return text


def contains_secret(text: Column) -> Column:
    return redact_secrets(text) != text


def clip(text: Column, limit: int, mark: str = "...") -> Column:
    """Spaces collapsed; if longer than ``limit``, cut to it with ``mark`` at the end."""
    value = normalize_ws(text)
    return F.when(F.length(value) <= limit, value).otherwise(F.concat(F.rtrim(F.left(value, F.lit(limit - len(mark)))), F.lit(mark)))


def title_segments(title: Column) -> Column:
    return F.filter(F.transform(F.split(normalize_ws(title), " - "), lambda x: F.trim(x)), lambda x: x != "")


def first_sentence(text: Column) -> Column:
    """What precedes the first of ". ", " ; ", " : " that occurs, tried in this order; 220 characters at most."""
    value = normalize_ws(text)
    out = value
    for sep in (" : ", " ; ", ". "):
        out = F.when(F.contains(value, F.lit(sep)), F.substring_index(value, sep, 1)).otherwise(out)
    return F.left(out, F.lit(220))


def numeric_tokens(text: Column) -> Column:
    """Distinct numbers in comparable forms: digits alone, and with a decimal point."""
    raw = F.regexp_extract_all(folded(text), F.lit(NUMBER), F.lit(0))

    def forms(x: Column) -> Column:
        digits = F.regexp_replace(x, r"\D", "")
        compact = F.regexp_replace(x, r"[\s ]", "")
        plain = F.when((F.length(digits) >= 3) | x.rlike(r"[\s .]"), digits)
        comma = F.contains(compact, F.lit(",")) & ~F.contains(compact, F.lit("."))
        point = F.contains(compact, F.lit(".")) & ~compact.rlike(r"\.\d{3}(?:\D|$)")
        decimal = F.when(comma, F.replace(compact, F.lit(","), F.lit("."))).when(point, compact)
        return F.array_compact(F.array(plain, decimal))

    return F.array_distinct(F.flatten(F.transform(raw, forms)))


def citation_ids(text: Column) -> Column:
    """Numbers in square brackets, distinct, in order."""
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[([0-9,\s]+)\]"), F.lit(1))
    ids = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda x: F.trim(x).try_cast("int"))))
    return F.array_distinct(F.array_compact(ids))


def any_marker(text: Column, markers: list[str]) -> Column:
    """Does the (folded) text contain one of the markers?"""
    return let(text, lambda x: functools.reduce(lambda a, b: a | b, [F.contains(x, F.lit(m)) for m in markers]))


def numeric_intent(query: Column) -> Column:
    return fold_accents(query).rlike(NUMERIC_INTENT)


def general_rule_intent(query: Column, wide: bool = True) -> Column:
    return any_marker(folded(query), PRINCIPLE if wide else GENERAL_RULE)


def exception_intent(query: Column, wide: bool = False) -> Column:
    return any_marker(folded(query), EXCEPTION_WIDE if wide else EXCEPTION)


def rescript_intent(query: Column) -> Column:
    return any_marker(folded(query), ["rescrit", "boi-res"])


def trivial_fragment(text: Column) -> Column:
    """At most five estimated tokens, and a bare number, mark or the like as a whole, or at most twelve characters."""
    return (token_count(text) <= 5) & (text.rlike(rf"(?iU)\A{TRIVIAL}\z") | (F.length(text) <= 12))


def significant_tokens(text: Column, stopwords: bool = True) -> Column:
    """Tokens of four characters or more, without the stop words if asked for."""
    found = F.filter(F.regexp_extract_all(folded(text), F.lit("(?i)[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 4)
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS)) if stopwords else found


def bigrams(items: Column) -> Column:
    """Distinct neighbours, joined by a space."""
    return F.array_distinct(F.filter(let(items, lambda a: F.transform(a, lambda x, i: F.concat(x, F.lit(" "), F.get(a, i + 1)))), lambda x: x.isNotNull()))


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def match_text(text: Column) -> Column:
    """Folded letters and digits with single spaces: what gold terms are looked for in."""
    return F.trim(F.regexp_replace(folded(text), "[^a-z0-9]+", " "))


def repair_mojibake(text: Column) -> Column:
    """Text that was read as Latin-1 instead of UTF-8, repaired if it is all Latin-1, valid and has fewer tell-tale marks."""
    latin = text.rlike(r"^[\x00-\xff]*$")
    raw = F.encode(F.when(latin, text).otherwise(""), "ISO-8859-1")
    again = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))

    def marks(c: Column) -> Column:
        total = F.lit(0)
        for m in MOJIBAKE:
            total = total + F.regexp_count(c, F.lit(m))
        return total

    return F.when(latin & again.isNotNull() & (marks(again) < marks(text)), again).otherwise(text)


def retry_delay(text: Column) -> Column:
    """The longest delay in seconds that an error message asks for; null if none."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in RETRY])
    return F.array_max(F.transform(found, lambda x: x.cast("double")))
