"""Tokenisers as Spark columns (string -> array<string>); all stay in the JVM. Null gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Code-point ranges that count as CJK: ideographs, kana, hangul, bopomofo, radicals (fixed values), as a Java class body.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{30A0}-\x{30FF}\x{3040}-\x{309F}\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3100}-\x{312F}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}\x{30000}-\x{323AF}\x{3200}-\x{32FF}\x{2F00}-\x{2FDF}"
#: Unicode White_Space, for character classes (fixed values).
SPACE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a nested expression inside a lambda is otherwise computed per element."""
    return F.transform(F.array(value), use)[0]


def whitespace_tokenize(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[^{SPACE}]+"), F.lit(0))


def _windows(chars: Column, n: int) -> Column:
    """Joined windows of n items of an array of characters; empty if there are fewer than n."""
    if n <= 0:
        return F.when(chars.isNotNull(), F.array().cast("array<string>"))
    some = F.transform(F.sequence(F.lit(1), F.size(chars) - (n - 1)), lambda i: F.array_join(F.slice(chars, i, n), ""))
    return F.when(F.size(chars) >= n, some).when(chars.isNotNull(), F.array().cast("array<string>"))


def ngram_tokenize(c: Column, n: int = 2) -> Column:
    """Overlapping character n-grams with repeats; shorter strings and n = 0 give an empty array."""
    if n <= 0:
        return F.when(c.isNotNull(), F.array().cast("array<string>"))
    some = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, some).when(c.isNotNull(), F.array().cast("array<string>"))


def character_tokenize(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[^{SPACE}]"), F.lit(0))


def is_cjk(c: Column) -> Column:
    """Whether any character of the string is CJK."""
    return F.rlike(c, F.lit(f"[{CJK}]"))


def smart_tokenize(c: Column) -> Column:
    """Every CJK character by itself, everything else split at white space."""
    return F.regexp_extract_all(c, F.lit(f"[{CJK}]|[^{CJK}{SPACE}]+"), F.lit(0))


#: Tokens for comparing: the same as splitting at white space unless CJK characters occur.
matching_tokens = smart_tokenize


def cjk_ngram_tokenize(c: Column, n: int = 2) -> Column:
    return _windows(F.regexp_extract_all(c, F.lit(f"[{CJK}]"), F.lit(0)), n)


def smart_tokenize_ngram(c: Column, n: int = 2) -> Column:
    """Runs of CJK characters as n-grams (a run shorter than n as single characters), the rest split at white space."""
    runs = F.regexp_extract_all(c, F.lit(f"[{CJK}]+|[^{CJK}{SPACE}]+"), F.lit(0))

    def pieces(run: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, F.lit(n)))
        single = F.regexp_extract_all(run, F.lit(f"[{CJK}]"), F.lit(0))
        return F.when(~is_cjk(run), F.array(run)).when((F.length(run) >= n) & F.lit(n > 0), grams if n > 0 else single).otherwise(single)

    return F.flatten(F.transform(runs, pieces))


TOKENIZERS = {
    "whitespace": whitespace_tokenize,
    "character": character_tokenize,
    "smart": smart_tokenize,
    "ngram": ngram_tokenize,
    "cjk_ngram": cjk_ngram_tokenize,
    "smart_ngram": smart_tokenize_ngram,
}
