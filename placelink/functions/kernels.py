"""String kernels that Spark lacks: Jaro-Winkler, Metaphone, Soundex by code point, Porter stems.

Each is written from its published description and works on code points. ``register`` makes them
SQL functions; as such they run in Arrow batches.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def fold(text: str) -> str:
    """Without combining marks, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


@lru_cache(65536)
def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not used[j] and b[j] == c), None)
        if j is not None:
            used[j] = True
            left.append(c)
    if not left:
        return 0.0
    m = len(left)
    swapped = sum(x != y for x, y in zip(left, (c for c, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro > 0.7:
        same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
        jaro += same * 0.1 * (1 - jaro)
    return jaro


@lru_cache(65536)
def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


_DIGITS = {c: d for d, group in (("1", "bfpv"), ("2", "cgjkqsxz"), ("3", "dt"), ("4", "l"), ("5", "mn"), ("6", "r")) for c in group}


@lru_cache(65536)
def soundex(word: str) -> str:
    word = fold(word)
    if not word:
        return ""
    out, last = word[0].upper(), _DIGITS.get(word[0])
    for c in word[1:]:
        digit = _DIGITS.get(c)
        if digit and digit != last:
            out += digit
        if c not in "hw":
            last = digit
    return (out + "000")[:4]


@lru_cache(65536)
def metaphone(word: str) -> str:
    w = "".join(c for c in fold(word) if c.isalpha())
    if w[:2] in ("kn", "gn", "pn", "wr", "ae"):
        w = w[1:]
    elif w[:1] == "x":
        w = "s" + w[1:]
    elif w[:2] == "wh":
        w = "w" + w[2:]
    out, n = [], len(w)
    for i, c in enumerate(w):
        before, after, then = w[i - 1 : i] if i else "", w[i + 1 : i + 2], w[i + 2 : i + 3]
        if c == before and c != "c":
            continue
        soft = after in tuple("iey")
        if c in "aeiou":
            code = c if i == 0 else ""
        elif c == "b":
            code = "" if before == "m" and i == n - 1 else "b"
        elif c == "c":
            if after == "h":
                code = "k" if before == "s" else "x"
            elif after == "i" and then == "a":
                code = "x"
            elif soft:
                code = "" if before == "s" else "s"
            else:
                code = "k"
        elif c == "d":
            code = "j" if after == "g" and then in tuple("iey") else "t"
        elif c == "g":
            if after == "h" and not (i + 2 < n and then in "aeiou"):
                code = ""
            elif after == "n" and (i + 2 == n or w[i + 1 :] == "ned"):
                code = ""
            elif before == "d" and soft:
                code = ""
            else:
                code = "j" if soft and before != "g" else "k"
        elif c == "h":
            code = "" if before and before in "cspgt" or before and before in "aeiou" and not (after and after in "aeiou") else "h"
        elif c == "k":
            code = "" if before == "c" else "k"
        elif c == "p":
            code = "f" if after == "h" else "p"
        elif c == "s":
            code = "x" if after == "h" or after == "i" and then in tuple("oa") else "s"
        elif c == "t":
            if after == "i" and then in tuple("oa"):
                code = "x"
            elif after == "h":
                code = "0"
            else:
                code = "" if after == "c" and then == "h" else "t"
        elif c in "wy":
            code = c if after and after in "aeiou" else ""
        else:
            code = {"q": "k", "v": "f", "x": "ks", "z": "s"}.get(c, c if c in "fjlmnr" else "")
        out.append(code)
    return "".join(out).upper()


_IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(w: str) -> str:
    """c and v for each letter."""
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _short_end(w: str) -> bool:
    s = _shape(w)
    return s[-3:] == "cvc" and w[-1] not in "wxy" or s == "vc"


def _swap(w: str, table: dict[str, str], least: int) -> str:
    """The longest suffix in ``table`` replaced, if its stem has a measure over ``least``."""
    for suffix in sorted(table, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > least else w
    return w


@lru_cache(65536)
def porter_stem(word: str) -> str:
    w = word.lower()
    if w in _IRREGULAR:
        return _IRREGULAR[w]
    if len(w) <= 2:
        return w
    # plurals and participles
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            stem = w[: -len(suffix)]
            if w.endswith(suffix) and "v" in _shape(stem):
                w = stem
                if w.endswith(("at", "bl", "iz")) or _measure(w) == 1 and _short_end(w) and not (len(w) > 1 and w[-1] == w[-2]):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c":
                    w = w[:-1] if w[-1] not in "lsz" else w
                break
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    # derivations
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    if w.endswith("logi"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        w = _swap(w, _STEP2, 0)
    w = _swap(w, _STEP3, 0)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in tuple("st")):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short_end(stem):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def _column(kernel, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else kernel(x))

    return run


def _pair_column(kernel, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else kernel(x, y) for x, y in zip(a, b)])

    return run


def register(spark: SparkSession) -> None:
    """jaro_winkler, metaphone, porter_stem, soundex_cp and fold_accents as SQL functions."""
    spark.udf.register("jaro_winkler", _pair_column(jaro_winkler, "double"))
    for name, kernel in (("metaphone", metaphone), ("porter_stem", porter_stem), ("soundex_cp", soundex), ("fold_accents", fold)):
        spark.udf.register(name, _column(kernel, "string"))


def jaro_winkler_column(a, b):
    return _pair_column(jaro_winkler, "double")(a, b)
