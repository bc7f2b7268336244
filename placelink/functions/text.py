"""Normalisation, tokens and lexicon expansion as Column expressions."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from placelink.functions.kernels import fold
from placelink.lexicons import DEFAULT, Config


def _folds() -> tuple[str, str, str]:
    """Characters that lose their marks and stay one character, what they become, and those that
    decompose to several: ranges of a pattern."""
    src, dst, several = [], [], []
    for cp in range(0xC0, sys.maxunicode + 1):
        c = chr(cp)
        if 0xD800 <= cp < 0xE000 or (d := unicodedata.normalize("NFD", c)) == c:
            continue
        f = "".join(x for x in d if unicodedata.category(x) != "Mn")
        if len(f) == 1 and cp <= 0xFFFF and ord(f) <= 0xFFFF:
            src.append(c)
            dst.append(f)
        elif f:  # marks themselves go by their category
            several.append(cp)
    ranges: list[list[int]] = []
    for cp in several:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "".join(src), "".join(dst), "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in ranges)


_SRC, _DST, _SEVERAL = _folds()


@F.pandas_udf(StringType())
def _fold_rest(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else fold(x))


def normalized(text: Column, whole: bool = False) -> Column:
    """Accents off, lower case. One-to-one folds and marks of all of Unicode by built-in functions. Letters
    that decompose to several, as Hangul, keep their form unless ``whole``: then a kernel in Python
    folds all texts, which array functions cannot call."""
    if whole:
        return _fold_rest(text)
    return F.lower(F.regexp_replace(F.translate(text, _SRC, _DST), r"\p{Mn}", ""))


def needs_kernel(text: Column) -> Column:
    """Whether the text has letters that ``normalized`` folds only by the kernel."""
    return text.rlike(r"[^\x{0}-\x{8FF}]") & text.rlike(f"[{_SEVERAL}]")  # the first is cheap; all such letters are beyond it


def cleaned(norm: Column) -> Column:
    """Slashes, bars and hyphens and other punctuation as blanks; blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(norm, r"""[/|\\\-.,"'‘’“”()\[\]#;:!?{}]""", " "), r"(?U)\s+", " "))


def _among(words) -> Column:
    return F.array(*[F.lit(w) for w in sorted(words)])


def is_garbage(text: Column, config: Config = DEFAULT) -> Column:
    norm = F.trim(F.regexp_replace(normalized(text), r"(?U)\s+", " "))
    words = F.split(norm, " ")
    return (norm == "") | norm.isin(*sorted(config.garbage)) | F.forall(words, lambda t: t.isin(*sorted(config.garbage)) | t.rlike(r"^\d+$"))


def tokens(clean: Column, is_query: bool, config: Config = DEFAULT) -> Column:
    """Words that can count: of a query no numbers and no codes, of both none too short."""
    exempt = lambda t: t.isin(*sorted(config.abbreviations))
    words = F.filter(F.split(clean, " "), lambda t: (F.length(t) >= config.least_token) | exempt(t))
    if is_query:
        words = F.filter(words, lambda t: ~t.rlike(r"^\d+$") & (exempt(t) | ~t.rlike(r"^[a-z]\d+|^\d+[a-z]+$")))
    return words


def query_tokens(raw_query: Column, raw_result: Column, config: Config = DEFAULT) -> Column:
    keep = lambda t: ~t.isin(*sorted(config.address_stopwords)) | F.array_contains(raw_result, t) | t.isin(*sorted(config.directions))
    return F.array_distinct(F.filter(raw_query, keep))


def result_tokens(raw_result: Column, config: Config = DEFAULT) -> Column:
    return F.array_distinct(F.filter(raw_result, lambda t: ~t.isin(*sorted(config.result_stopwords))))


def _lookup(words: Column, table: dict[str, str]) -> Column:
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in table]), F.array(*[F.lit(v) for v in table.values()]))
    extra = F.filter(F.transform(words, lambda t: F.split(F.try_element_at(pairs, t), " ")), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(words, F.flatten(extra)))


def enriched(query: Column, config: Config = DEFAULT) -> Column:
    """The query's tokens, then the words of what abbreviations and other names stand for."""
    full = _lookup(query, {k: " ".join(v) for k, v in config.abbreviations.items()})
    return _lookup(full, config.alternates)


def tier(score: Column, config: Config = DEFAULT) -> Column:
    return F.when(score >= config.high, "HIGH").when(score >= config.medium, "MEDIUM").otherwise("LOW")


def with_normalized(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``text`` folded as the scorer folds it. Only rows that need the kernel go to Python."""
    plain = ~F.coalesce(needs_kernel(F.col(text)), F.lit(False))
    return df.where(plain).withColumn(name, normalized(F.col(text))).unionByName(df.where(~plain).withColumn(name, normalized(F.col(text), True)))
