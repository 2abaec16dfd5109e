"""Phonetic codes as Spark columns. Null gives null.

Soundex, MRA and language detection are JVM expressions; the other encoders run once per distinct value of an Arrow batch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from kinloom.functions import phonetic_rules as rules


def _letters(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z]", "")


def soundex(c: Column) -> Column:
    word = _letters(c)
    return F.when(word == "", "0000").otherwise(F.soundex(word))


def mra(c: Column) -> Column:
    word = F.regexp_replace(F.upper(_letters(c)), r"(.)\1+", "$1")
    code = F.concat(F.substring(word, 1, 1), F.regexp_replace(F.substring(word, F.lit(2), F.length(word)), "[AEIOU]", ""))
    return F.when(F.length(code) <= 6, code).otherwise(F.concat(F.substring(code, 1, 3), F.substring(code, -3, 3)))


def detect_language(c: Column) -> Column:
    low = F.lower(c)
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in rules.LANGUAGES:
        out = out.when(F.rlike(low, F.lit("(?s)\\A(?:" + pattern.replace("\\Z", "\\z") + ")")), name)
    return F.when(c.isNotNull(), out.otherwise("generic"))


def _coded(f, returns: T.DataType = T.StringType()):
    @F.pandas_udf(returns)
    def run(s: pd.Series) -> pd.Series:
        codes, values = s.factorize()  # null is -1
        done = [f(v) for v in values] + [None]
        return pd.Series([done[i] for i in codes], dtype=object)

    return run


metaphone = _coded(rules.metaphone)
nysiis = _coded(rules.nysiis)
caverphone = _coded(rules.caverphone)
cologne_phonetic = _coded(rules.cologne_phonetic)
phonex = _coded(rules.phonex)
daitch_mokotoff = _coded(rules.daitch_mokotoff)
daitch_mokotoff_codes = _coded(rules.daitch_mokotoff_codes, T.ArrayType(T.StringType()))


@F.pandas_udf(T.StructType([T.StructField("primary", T.StringType()), T.StructField("alternate", T.StringType())]))
def double_metaphone(s: pd.Series) -> pd.DataFrame:
    codes, values = s.factorize()  # null is -1
    done = [*map(rules.double_metaphone, values), (None, None)]
    return pd.DataFrame([done[i] for i in codes], columns=["primary", "alternate"])


def beider_morse(c: Column, ashkenazi: bool = False) -> Column:
    return _coded(lambda v: rules.beider_morse(v, ashkenazi))(c)


@F.pandas_udf(T.BooleanType())
def mra_compare(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict = {}
    for pair in set(zip(a, b)):
        seen[pair] = None if pair[0] is None or pair[1] is None else rules.mra_compare(*pair)
    return pd.Series([seen[pair] for pair in zip(a, b)], dtype=object)


def daitch_mokotoff_match(a: Column, b: Column) -> Column:
    """Whether any code of one name is a code of the other."""
    return F.arrays_overlap(daitch_mokotoff_codes(a), daitch_mokotoff_codes(b))


ENCODERS = {
    "soundex": soundex,
    "metaphone": metaphone,
    "double_metaphone": lambda c: double_metaphone(c)["primary"],
    "nysiis": nysiis,
    "caverphone": caverphone,
    "cologne_phonetic": cologne_phonetic,
    "beider_morse": beider_morse,
    "phonex": phonex,
    "mra": mra,
    "match_rating_approach": mra,
    "daitch_mokotoff": daitch_mokotoff,
}


def encode(c: Column, algorithm: str = "soundex") -> Column:
    """The code of a name by algorithm, as used for blocking and comparing."""
    if algorithm not in ENCODERS:
        raise ValueError(f"unknown phonetic algorithm {algorithm!r}; known: {', '.join(ENCODERS)}")
    return ENCODERS[algorithm](c)
