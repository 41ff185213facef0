"""Text functions that need Python: Arrow batches, for what no expression can say."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.french import stem
from corpusmill.functions.text import TOKEN

#: Month names that make a small number a day, and what is a number with its unit.
MONTH = re.compile(r"\b(?:janvier|fevrier|février|mars|avril|mai|juin|juillet|aout|août|septembre|octobre|novembre|decembre|décembre)\b", re.I)
NUMBER = re.compile(r"(\d[\d\s]*\d+|\d+)\s*(euros?|€|%|pour\s*cent)?", re.I)
#: The same with the classes that SQL engines have: digits, white space (and the fixed space) and borders of words are ASCII's, case is Unicode's.
SPACE, EDGE = r"[\t\n\f\r \u00a0]", r"(?-i:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
PLAIN_MONTH = re.compile(MONTH.pattern.replace(r"\b", EDGE), re.I)
PLAIN_NUMBER = re.compile(NUMBER.pattern.replace(r"[\d\s]", rf"(?:\d|{SPACE})").replace(r"\s", SPACE).replace(r"\d", "[0-9]"), re.I)
PLAIN_BLANK = " \t\v\f\r\u00a0"
UNITS = {"euro": "euros", "euros": "euros", "€": "euros", "%": "%", "pour cent": "%"}
AROUND = 40
#: Characters of the texts whose stems a task holds, if they are more than one.
PIECE = 1 << 20
FACT = T.StructType([T.StructField("value", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("context", T.StringType())])


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """French stems of a text's tokens.

    It takes the text and makes :func:`corpusmill.functions.text.tokens` itself: Spark doesn't evaluate a Python function of an
    expression with lambdas, which these are made of.
    """
    known: dict[str, str] = {}

    def one(word: str) -> str:
        found = known.get(word)
        if found is None:
            if len(known) > 200_000:
                known.clear()
            found = known[word] = stem(word)
        return found

    def tokens(text: str | None) -> list[str]:
        plain = unicodedata.normalize("NFKD", html.unescape(text or ""))
        return re.findall(TOKEN, "".join(c for c in plain if not unicodedata.combining(c)).lower())

    for batch in batches:
        sizes = batch.str.len().fillna(0).cumsum().to_numpy()
        at = 0
        while at < len(batch):  # a few texts at a time, as the stems of a batch take many times its bytes
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE, side="right")))
            yield pd.Series([[one(w) for w in tokens(x)] for x in batch.iloc[at:end]], dtype=object)
            at = end


def whole(digits: str) -> int | None:
    """The number that digits, in groups by spaces, write; None if they are grouped by other white space, or are too many for the runtime."""
    try:
        return int("".join(digits.split(" ")))
    except ValueError:
        return None


def facts(text: str | None, plain: bool = False) -> list[tuple[str, str, str]]:
    """(value, unit, text around) of every number; its digits are a string, as they may be many.

    Without a unit, a year from 1900 to 2100 and a number up to 31 near the name of a month are dates, not facts.  ``plain``
    takes the classes that SQL engines have, and numbers of any length.
    """
    text, out = text or "", []
    month, blank = (PLAIN_MONTH, PLAIN_BLANK) if plain else (MONTH, None)
    for m in (PLAIN_NUMBER if plain else NUMBER).finditer(text):
        digits, unit = m[1].replace(" ", ""), m[2]
        if plain:
            value = (digits.lstrip("0") or "0") if digits.isdecimal() else None
        else:
            value = None if (n := whole(m[1])) is None else str(n)
        if value is None:
            continue
        around = text[max(0, m.start() - AROUND) : m.end() + AROUND].replace("\n", " ").strip(blank)
        n = int(value) if len(value) <= 4 else 9999
        if unit or not (1900 <= n <= 2100 or (0 < n < 32 and month.search(around))):
            out.append((value, UNITS.get((unit or "").lower(), "nombre"), around))
    return out


@F.pandas_udf(T.ArrayType(FACT))
def numbers(text: pd.Series) -> pd.Series:
    """Plain :func:`facts`."""
    return text.map(lambda x: [dict(zip(FACT.names, f, strict=True)) for f in facts(x, plain=True)])
