"""Text normalisers as Spark columns (string -> string). Null gives null.

Everything stays in the JVM except Unicode normal forms, Devanagari and Hangul, which run as Arrow UDFs behind an
ASCII fast path.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, functions as F

from kinloom.functions.tokenizers import SPACE, cjk_ngram_tokenize, whitespace_tokenize

# --- Word lists and tables (fixed values) -------------------------------------------------------------------------------
STOP_WORDS = """a about above after again against all am an and any are aren't as at be because been before being below between both but by
can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further get got had hadn't has hasn't have haven't
having he her here hers herself him himself his how i if in into is isn't it its itself just let's me more most mustn't my myself no nor not of off on
once only or other ought our ours ourselves out over own same shan't she should shouldn't so some such than that the their theirs them themselves then
there these they this those through to too under until up very was wasn't we were weren't what when where which while who whom why with won't would
wouldn't you your yours yourself yourselves""".split()
ABBREVIATIONS = {
    "st.": "street", "ave.": "avenue", "blvd.": "boulevard", "rd.": "road", "dr.": "drive", "apt.": "apartment", "ln.": "lane", "ct.": "court", "pl.": "place", "pkwy.": "parkway", "hwy.": "highway",
    "inc.": "incorporated", "inc": "incorporated", "corp.": "corporation", "corp": "corporation", "llc": "limited liability company", "ltd.": "limited", "ltd": "limited", "co.": "company", "co": "company",
}
NAME_PARTS = [("st.", "saint"), ("st ", "saint "), ("dr.", "doctor"), ("dr ", "doctor "), ("mr.", "mister"), ("mr ", "mister "), ("mrs.", "missus"), ("mrs ", "missus "), ("jr.", "junior"), ("jr ", "junior "), ("sr.", "senior"), ("sr ", "senior ")]
NAME_TITLES = "mr mr. mrs mrs. ms ms. dr dr. prof prof. rev rev. sir dame hon hon.".split()
NAME_SUFFIXES = "jr jr. sr sr. i ii iii iv v phd ph.d ph.d. md m.d m.d. esq esq.".split()
_STREET = {"st": "street", "ave": "avenue", "blvd": "boulevard", "rd": "road", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "pkwy": "parkway", "hwy": "highway", "apt": "apartment", "cir": "circle", "ter": "terrace", "trl": "trail", "n": "north", "s": "south", "e": "east", "w": "west", "ste": "suite", "fl": "floor"}
ADDRESS_WORDS = _STREET | {f"{k}.": v for k, v in _STREET.items()} | {"ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest"}
COMPANY_SUFFIXES = "inc inc. corp corp. llc ltd ltd. gmbh ag sa plc co co. lp llp corporation incorporated limited".split()
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "",
    "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "ґ": "g", "є": "ye", "і": "i", "ї": "yi",
}
GREEK = {
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "ks",
    "ο": "o", "π": "p", "ρ": "r", "σ": "s", "τ": "t", "υ": "y", "φ": "ph", "χ": "ch", "ψ": "ps", "ω": "o", "ά": "a", "έ": "e", "ή": "i", "ί": "i",
    "ό": "o", "ύ": "y", "ώ": "o",
}
GREEK_LOWER_ONLY = {
    "ς": "s", "ϊ": "i", "ϋ": "y", "ΐ": "i", "ΰ": "y",
}
ARABIC = {
    "ء": "'", "آ": "a", "أ": "a", "ؤ": "w", "إ": "a", "ئ": "y", "ا": "a", "ب": "b", "ة": "h", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh",
    "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "'", "غ": "gh", "ف": "f", "ق": "q",
    "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ى": "a", "ي": "y",
}
HEBREW = {
    "א": "a", "ב": "b", "ג": "g", "ד": "d", "ה": "h", "ו": "v", "ז": "z", "ח": "ch", "ט": "t", "י": "y", "ך": "k", "כ": "k", "ל": "l", "ם": "m",
    "מ": "m", "ן": "n", "נ": "n", "ס": "s", "ע": "'", "ף": "p", "פ": "p", "ץ": "ts", "צ": "ts", "ק": "q", "ר": "r", "ש": "sh", "ת": "t",
}
DEVANAGARI_VOWELS = {
    "ऄ": "a", "अ": "a", "आ": "aa", "इ": "i", "ई": "ii", "उ": "u", "ऊ": "uu", "ऋ": "ri", "ऌ": "li", "ऍ": "e", "ऎ": "e", "ए": "e", "ऐ": "ai", "ऑ": "o",
    "ऒ": "o", "ओ": "o", "औ": "au",
}
DEVANAGARI_CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh",
    "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "ऩ": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r",
    "ऱ": "r", "ल": "l", "ळ": "l", "ऴ": "l", "व": "v", "श": "sh", "ष": "sh", "स": "s", "ह": "h",
}
DEVANAGARI_SIGNS = {0x93E: "a", 0x93F: "i", 0x940: "ii", 0x941: "u", 0x942: "uu", 0x943: "ri", 0x944: "rii", 0x945: "e", 0x946: "e", 0x947: "e", 0x948: "ai", 0x949: "o", 0x94A: "o", 0x94B: "o", 0x94C: "au"}
DEVANAGARI_OTHER = {0x902: "n", 0x903: "h", 0x901: "n", 0x950: "om", 0x93C: "", 0x94D: ""}
HANGUL_INITIAL = [
    "g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h",
]
HANGUL_VOWEL = [
    "a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui",
    "i",
]
HANGUL_FINAL = [
    "", "k", "kk", "ks", "n", "nj", "nh", "d", "l", "lk", "lm", "lb", "ls", "lt", "lp", "lh", "m", "b", "bs", "s",
    "ss", "ng", "j", "ch", "k", "t", "p", "h",
]
#: Single letters by code point.
JAMO = {
    0x3131: "g", 0x3132: "kk", 0x3134: "n", 0x3137: "d", 0x3138: "tt", 0x3139: "r", 0x3141: "m", 0x3142: "b", 0x3143: "pp", 0x3145: "s", 0x3146: "ss", 0x3147: "", 0x3148: "j", 0x3149: "jj",
    0x314A: "ch", 0x314B: "k", 0x314C: "t", 0x314D: "p", 0x314E: "h", 0x314F: "a", 0x3150: "ae", 0x3151: "ya", 0x3152: "yae", 0x3153: "eo", 0x3154: "e", 0x3155: "yeo", 0x3156: "ye", 0x3157: "o",
    0x3158: "wa", 0x3159: "wae", 0x315A: "oe", 0x315B: "yo", 0x315C: "u", 0x315D: "wo", 0x315E: "we", 0x315F: "wi", 0x3160: "yu", 0x3161: "eu", 0x3162: "ui", 0x3163: "i",
}
# ------------------------------------------------------------------------------------------------------------------------


def _both_cases(table: Mapping[str, str]) -> dict[str, str]:
    return dict(table) | {k.upper(): v.capitalize() for k, v in table.items()}


def fold_case(c: Column) -> Column:
    return F.lower(c)


def fold_case_locale(c: Column, locale: str = "default") -> Column:
    if locale == "default":
        return F.lower(c)
    if locale == "turkish":
        return F.lower(F.translate(c, "Iİ", "ıi"))
    raise ValueError(f"unknown locale {locale!r}: default or turkish")


def locale_aware_compare(a: Column, b: Column, locale: str = "default") -> Column:
    return fold_case_locale(a, locale) == fold_case_locale(b, locale)


def normalize_whitespace(c: Column) -> Column:
    return F.array_join(whitespace_tokenize(c), " ")


def strip_punctuation(c: Column) -> Column:
    """ASCII punctuation only."""
    return F.regexp_replace(c, r"[!-/:-@\[-`{-~]", "")


def standardize_name(c: Column) -> Column:
    c = F.lower(c)
    for short, full in NAME_PARTS:
        c = F.replace(c, F.lit(short), F.lit(full))
    return c


def _without(c: Column, words: list[str]) -> Column:
    gone = F.array(*map(F.lit, words))
    return F.array_join(F.filter(whitespace_tokenize(c), lambda w: ~F.array_contains(gone, F.lower(w))), " ")


def remove_stop_words(c: Column) -> Column:
    return _without(c, STOP_WORDS)


def synonym_expand(c: Column, table: Mapping[str, str]) -> Column:
    """Every token whose lower case is in the table is replaced; other tokens keep their case."""
    if not table:
        return normalize_whitespace(c)
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(whitespace_tokenize(c), lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), w)), " ")


def expand_abbreviations(c: Column) -> Column:
    return synonym_expand(c, ABBREVIATIONS)


def regex_replace(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, pattern, replacement)


def clean_name(c: Column) -> Column:
    c = F.lower(c)
    at = F.locate(",", c)
    edge = f"^[{SPACE}]+|[{SPACE}]+$"
    last, first = F.substring(c, F.lit(1), at - 1), F.substring(c, at + 1, F.length(c))
    flipped = F.concat_ws(" ", F.regexp_replace(first, edge, ""), F.regexp_replace(last, edge, ""))
    return _without(F.when(at > 0, flipped).otherwise(c), NAME_TITLES + NAME_SUFFIXES)


def clean_address(c: Column) -> Column:
    return synonym_expand(F.lower(c), ADDRESS_WORDS)


def clean_company(c: Column) -> Column:
    return _without(F.regexp_replace(F.lower(c), "[&+]", "and"), COMPANY_SUFFIXES)


def normalize_email(c: Column) -> Column:
    c = F.lower(c)
    at = F.locate("@", c)
    local, domain = F.substring(c, F.lit(1), at - 1), F.substring(c, at + 1, F.length(c))
    plain = F.replace(F.substring_index(local, "+", 1), F.lit("."), F.lit(""))
    gmail = domain.isin("gmail.com", "googlemail.com")
    return F.when(c.isNull() | (at == 0), c).when(gmail, F.concat(plain, F.lit("@gmail.com"))).otherwise(c)


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host, without default port, leading www., fragment and trailing slashes, with sorted query."""
    c = F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")
    at = F.locate("://", c)
    scheme = F.lower(F.substring(c, F.lit(1), at - 1))
    rest = F.substring_index(F.substring(c, at + 3, F.length(c)), "#", 1)
    # The authority ends at the first slash, or, if there is none at all, at the first question mark.
    slash = F.locate("/", rest)
    authority = F.when(slash > 0, F.substring(rest, F.lit(1), slash - 1)).otherwise(F.substring_index(rest, "?", 1))
    tail = F.substring(rest, F.length(authority) + 1, F.length(rest))
    host = F.lower(authority)
    host = F.when(scheme == "http", F.regexp_replace(host, r":80\z", "")).when(scheme == "https", F.regexp_replace(host, r":443\z", "")).otherwise(host)
    host = F.regexp_replace(host, r"\Awww\.", "")
    path = F.regexp_replace(F.substring_index(tail, "?", 1), r"/+\z", "")
    mark = F.locate("?", tail)
    query = F.when(mark > 0, F.substring(tail, mark + 1, F.length(tail))).otherwise("")
    ordered = F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&")))
    return F.when(at == 0, F.lower(c)).otherwise(F.concat(scheme, F.lit("://"), host, path, ordered))


def strip_arabic_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x{0640}\x{064B}-\x{065F}\x{0670}]", "")


def strip_hebrew_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x{05B0}-\x{05BD}\x{05BF}\x{05C1}\x{05C2}\x{05C4}\x{05C5}\x{05C7}\x{0591}-\x{05AF}]", "")


def strip_bidi_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x{200E}\x{200F}\x{061C}\x{202A}-\x{202E}\x{2066}-\x{2069}]", "")


def normalize_arabic(c: Column) -> Column:
    return F.translate(c, "آأإة", "اااه")


def _by_table(c: Column, table: Mapping[str, str]) -> Column:
    """Characters by table: one-to-one and dropped ones by ``translate``, the few one-to-many ones by ``replace``."""
    single = {k: v for k, v in table.items() if len(v) == 1}
    gone = [k for k, v in table.items() if not v]
    for k, v in table.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return F.translate(c, "".join(single) + "".join(gone), "".join(single.values()))


def transliterate_cyrillic(c: Column) -> Column:
    return _by_table(c, _both_cases(CYRILLIC))


def transliterate_greek(c: Column) -> Column:
    return _by_table(c, _both_cases(GREEK) | GREEK_LOWER_ONLY)


def transliterate_arabic(c: Column) -> Column:
    return _by_table(strip_arabic_diacritics(c), ARABIC)


def transliterate_hebrew(c: Column) -> Column:
    return _by_table(F.regexp_replace(c, r"[\x{0591}-\x{05C7}]", ""), HEBREW)


def _ascii_or(c: Column, slow: Column) -> Column:
    """The value itself where nothing can change."""
    return F.when(F.rlike(c, F.lit(r"\A\p{ASCII}*\z")), c).otherwise(slow)


def normalize_unicode(c: Column, form: str = "nfkc") -> Column:
    if form not in ("nfc", "nfd", "nfkc", "nfkd"):
        raise ValueError(f"unknown normal form {form!r}: nfc, nfd, nfkc or nfkd")
    name = form.upper()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize(name, x))

    return _ascii_or(c, run(c))


def strip_diacritics(c: Column) -> Column:
    """Canonical decomposition without combining marks; what is left stays decomposed."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else "".join(ch for ch in unicodedata.normalize("NFD", x) if unicodedata.category(ch)[0] != "M"))

    return _ascii_or(c, run(c))


def devanagari(s: str) -> str:
    """A consonant carries an a unless a vowel sign or virama follows."""
    vowels, consonants = DEVANAGARI_VOWELS, DEVANAGARI_CONSONANTS
    out: list[str] = []
    open_a = False  # whether the last thing written is a consonant that still waits for its vowel
    for ch in s:
        sign = DEVANAGARI_SIGNS.get(ord(ch))
        if open_a and (sign is not None or ch == "्"):
            out.append(sign or "")
            open_a = False
            continue
        if open_a:
            out.append("a")
        open_a = ch in consonants
        out.append(consonants.get(ch) or vowels.get(ch) or DEVANAGARI_OTHER.get(ord(ch), ch))
    return "".join(out) + ("a" if open_a else "")


def hangul(s: str) -> str:
    out = []
    for ch in s:
        n = ord(ch) - 0xAC00
        if 0 <= n < 19 * 21 * 28:
            out.append(HANGUL_INITIAL[n // 588] + HANGUL_VOWEL[n % 588 // 28] + HANGUL_FINAL[n % 28])
        else:
            out.append(JAMO.get(ord(ch), ch))
    return "".join(out)


def _mapped(c: Column, f: Callable[[str], str]) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else f(x))

    return _ascii_or(c, run(c))


def transliterate_devanagari(c: Column) -> Column:
    return _mapped(c, devanagari)


def transliterate_hangul(c: Column) -> Column:
    return _mapped(c, hangul)


def transliterate(c: Column, script: str) -> Column:
    """Latin letters for those of ``script``; other letters stay."""
    by_script = {"cyrillic": transliterate_cyrillic, "greek": transliterate_greek, "arabic": transliterate_arabic, "hebrew": transliterate_hebrew, "devanagari": transliterate_devanagari, "hangul": transliterate_hangul}
    if script.lower() not in by_script:
        raise ValueError(f"unknown script {script!r}: {', '.join(by_script)}")
    return by_script[script.lower()](c)


def validate_strings(a: Column, b: Column) -> Column:
    """ok, both_empty, left_empty or right_empty; null counts as empty."""
    x, y = F.coalesce(a, F.lit("")) == "", F.coalesce(b, F.lit("")) == ""
    return F.when(x & y, "both_empty").when(x, "left_empty").when(y, "right_empty").otherwise("ok")


#: Operations that take no parameter, by the name used in pipelines.
OPERATIONS: dict[str, Callable[[Column], Column]] = {
    "fold_case": fold_case,
    "normalize_whitespace": normalize_whitespace,
    "strip_punctuation": strip_punctuation,
    "standardize_name": standardize_name,
    **{f"normalize_unicode_{f}": (lambda c, f=f: normalize_unicode(c, f)) for f in ("nfc", "nfd", "nfkc", "nfkd")},
    "remove_stop_words": remove_stop_words,
    "expand_abbreviations": expand_abbreviations,
    "strip_diacritics": strip_diacritics,
    "clean_name": clean_name,
    "clean_address": clean_address,
    "clean_company": clean_company,
    "normalize_email": normalize_email,
    "normalize_url": normalize_url,
    "transliterate_cyrillic": transliterate_cyrillic,
    "transliterate_greek": transliterate_greek,
    "transliterate_arabic": transliterate_arabic,
    "transliterate_hebrew": transliterate_hebrew,
    "transliterate_devanagari": transliterate_devanagari,
    "transliterate_hangul": transliterate_hangul,
    "strip_arabic_diacritics": strip_arabic_diacritics,
    "strip_hebrew_diacritics": strip_hebrew_diacritics,
    "normalize_arabic": normalize_arabic,
    "strip_bidi_marks": strip_bidi_marks,
    "fold_case_turkish": lambda c: fold_case_locale(c, "turkish"),
}


def operation(name: str) -> Callable[[Column], Column]:
    """A normaliser by its text form, e.g. fold_case, regex_replace:<pattern>:<replacement>, synonym_expand:<json>,
    cjk_ngram_tokenize_<n> or custom:<name>; an unknown or malformed one is a ValueError."""
    import json

    from kinloom.functions import registry

    if name in OPERATIONS:
        return OPERATIONS[name]
    kind, _, rest = name.partition(":")
    if kind == "regex_replace" and ":" in rest:
        pattern, _, replacement = rest.partition(":")
        return lambda c: regex_replace(c, pattern, replacement)
    if kind == "synonym_expand" and rest:
        try:
            table = json.loads(rest)
        except ValueError as x:
            raise ValueError(f"synonym_expand: no JSON table: {x}") from None
        return lambda c: synonym_expand(c, table)
    if name.startswith("cjk_ngram_tokenize_") and name.rpartition("_")[2].isdigit():
        n = int(name.rpartition("_")[2])
        return lambda c: F.array_join(cjk_ngram_tokenize(c, n), " ")
    if kind == "custom" and rest:
        return registry.preprocessor(rest)
    raise ValueError(f"unknown operation {name!r}; known: {', '.join(OPERATIONS)}, regex_replace:<pattern>:<replacement>, synonym_expand:<json>, cjk_ngram_tokenize_<n>, custom:<name>")


def preprocess(c: Column, operations: list[str]) -> Column:
    for name in operations:
        c = operation(name)(c)
    return c
