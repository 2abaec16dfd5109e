"""Known results of scalar functions: (function, arguments, result as text). Fixed values, stated as published or agreed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinloom.functions import phonetic, similarity as sim, text, tokenizers as tok

_joined = lambda f: lambda c: F.array_join(f(c), "|")
#: Function name -> (columns -> column).
FUNCTIONS: dict[str, Callable[..., Column]] = {
    **{n: phonetic.ENCODERS[n] for n in ("soundex", "metaphone", "nysiis", "phonex", "mra", "caverphone", "cologne_phonetic", "daitch_mokotoff", "beider_morse")},
    "double_metaphone": lambda c: F.concat_ws("|", phonetic.double_metaphone(c)["primary"], phonetic.double_metaphone(c)["alternate"]),
    "detect_language": phonetic.detect_language, "mra_compare": phonetic.mra_compare, "daitch_mokotoff_match": phonetic.daitch_mokotoff_match,
    **{n: f for n, f in text.OPERATIONS.items()},
    "transliterate": lambda c: text.transliterate(text.transliterate(text.transliterate(c, "Cyrillic"), "greek"), "hangul"),
    "locale_aware_compare_turkish": lambda a, b: text.locale_aware_compare(a, b, "turkish"), "validate_strings": text.validate_strings,
    "regex_replace_digits": lambda c: text.regex_replace(c, r"\d+", ""), "regex_replace_hyphen": lambda c: text.operation("regex_replace:-: ")(c),
    "synonym_expand": lambda c: text.operation('synonym_expand:{"big": "large", "cat": "feline"}')(c), "preprocess_three": lambda c: text.preprocess(c, ["fold_case", "strip_punctuation", "normalize_whitespace"]),
    "whitespace_tokenize": _joined(tok.whitespace_tokenize), "ngram_tokenize": _joined(tok.ngram_tokenize), "trigram_tokenize": _joined(lambda c: tok.ngram_tokenize(c, 3)), "character_tokenize": _joined(tok.character_tokenize), "smart_tokenize": _joined(tok.smart_tokenize),
    "cjk_ngram_tokenize": _joined(tok.cjk_ngram_tokenize), "smart_tokenize_ngram": _joined(tok.smart_tokenize_ngram), "is_cjk": tok.is_cjk,
    **{n: sim.METRICS[n] for n in sim.METRICS}, "levenshtein_distance": sim.levenshtein, "osa_distance": sim.damerau_levenshtein, "osa_within_1": lambda a, b: sim.damerau_levenshtein_threshold(a, b, 1), "osa_within_2": lambda a, b: sim.damerau_levenshtein_threshold(a, b, 2),
    "levenshtein_within_2": lambda a, b: sim.levenshtein_threshold(a, b, 2), "levenshtein_within_3": lambda a, b: sim.levenshtein_threshold(a, b, 3), "hamming_distance": sim.hamming, "lcs_length": sim.lcs_length, "substring_length": sim.longest_common_substring_length, "smith_waterman_score": sim.smith_waterman,
    "weighted_distance": sim.weighted_levenshtein, "weighted_insert_2": lambda a, b: sim.weighted_levenshtein(a, b, insert_cost=2.0), "weighted_swap_half": lambda a, b: sim.weighted_levenshtein(a, b, transpose_cost=0.5), "dissimilarity_jaro": lambda a, b: sim.dissimilarity("jaro")(a, b),
    "monge_elkan_ratcliff": lambda a, b: sim.monge_elkan(a, b, "ratcliff_obershelp"), "monge_elkan_hybrid": lambda a, b: sim.monge_elkan(a, b, "phonetic_hybrid"),
}

#: (function, arguments, result); numbers with four decimals (fixed values).
GOLDENS: list[tuple[str, tuple[str | None, ...], str | None]] = [
    ("soundex", ("Robert",), "R163"), ("soundex", ("Rupert",), "R163"), ("soundex", ("Ashcraft",), "A261"), ("soundex", ("Tymczak",), "T522"), ("soundex", ("Smith",), "S530"), ("soundex", ("Smyth",), "S530"), ("soundex", ("A",), "A000"), ("soundex", ("",), "0000"), ("soundex", (None,), None),
    ("metaphone", ("Smith",), "SM0"), ("metaphone", ("Schmidt",), "SXMTT"), ("metaphone", ("Knight",), "NT"), ("metaphone", ("Gnome",), "NM"), ("metaphone", ("",), ""), ("metaphone", (None,), None),
    ("double_metaphone", ("",), "|"), ("nysiis", ("Johnson",), "JANSAN"), ("nysiis", ("Smith",), "SNAT"), ("nysiis", ("",), ""),
    ("phonex", ("Smith",), "S530"), ("phonex", ("Smyth",), "S530"), ("phonex", ("",), "0000"), ("mra", ("Smith",), "SMTH"), ("mra", ("Catherine",), "CTHRN"), ("mra", ("A",), "A"), ("mra", ("",), ""),
    ("mra_compare", ("Smith", "Smyth"), "true"), ("mra_compare", ("Smith", "Jones"), "false"), ("mra_compare", (None, "Jones"), None),
    ("caverphone", ("Lee",), "L111111111"), ("caverphone", ("David",), "TFT1111111"), ("caverphone", ("a",), "A111111111"), ("caverphone", ("",), "1111111111"), ("cologne_phonetic", ("Muller",), "657"), ("cologne_phonetic", ("Mueller",), "657"), ("cologne_phonetic", ("",), ""),
    ("daitch_mokotoff", ("Moskowitz",), "645740"), ("daitch_mokotoff", ("Peters",), "734000,739400"), ("daitch_mokotoff", ("Auerbach",), "097400,097500"), ("daitch_mokotoff", ("A",), "000000"), ("daitch_mokotoff", ("",), "000000"), ("daitch_mokotoff_match", ("Moskowitz", "Moskovitz"), "true"), ("daitch_mokotoff_match", ("Peters", "Cohen"), "false"),
    ("beider_morse", ("shaw",), "Sav|Saw"), ("beider_morse", ("",), ""),
    ("detect_language", ("Goldstein",), "ashkenazi"), ("detect_language", ("Rosenberg",), "ashkenazi"), ("detect_language", ("Horowitz",), "ashkenazi"), ("detect_language", ("Schmidt",), "german"), ("detect_language", ("Schwarzenegger",), "german"), ("detect_language", ("Rousseau",), "french"), ("detect_language", ("Kowalski",), "polish"),
    ("detect_language", ("Petrov",), "russian"), ("detect_language", ("Ivanova",), "russian"), ("detect_language", ("Rossini",), "italian"), ("detect_language", ("Moretti",), "italian"), ("detect_language", ("Rodriguez",), "spanish"), ("detect_language", ("Gonzalez",), "spanish"), ("detect_language", ("Washington",), "english"), ("detect_language", ("Kim",), "generic"),
    ("fold_case", ("Hello WORLD",), "hello world"), ("normalize_whitespace", ("  hello   world  ",), "hello world"), ("strip_punctuation", ("hello, world!",), "hello world"), ("standardize_name", ("St. Louis",), "saint louis"), ("standardize_name", ("Dr. Smith",), "doctor smith"), ("fold_case_turkish", ("Iİ",), "ıi"), ("locale_aware_compare_turkish", ("I", "ı"), "true"),
    ("normalize_unicode_nfc", ("café",), "café"), ("normalize_unicode_nfd", ("café",), "café"), ("normalize_unicode_nfkc", ("ﬁnＡ",), "finA"), ("normalize_unicode_nfkd", ("ﬁé",), "fié"), ("strip_diacritics", ("café naïve über résumé",), "cafe naive uber resume"), ("strip_diacritics", ("",), ""), ("strip_diacritics", (None,), None),
    ("remove_stop_words", ("the cat and the dog",), "cat dog"), ("remove_stop_words", ("hello world",), "hello world"), ("remove_stop_words", ("a",), ""), ("expand_abbreviations", ("123 Main st.",), "123 Main street"), ("expand_abbreviations", ("Acme inc.",), "Acme incorporated"), ("synonym_expand", ("the big cat",), "the large feline"),
    ("regex_replace_digits", ("hello 123 world",), "hello  world"), ("regex_replace_hyphen", ("foo-bar-baz",), "foo bar baz"), ("preprocess_three", (" Hello,  WORLD! ",), "hello world"),
    ("clean_name", ("Mr. John Smith Jr.",), "john smith"), ("clean_name", ("Smith, John",), "john smith"), ("clean_name", ("Doe, Jane Marie",), "jane marie doe"), ("clean_name", ("Mary-Jane Watson",), "mary-jane watson"), ("clean_name", ("Dr. Prof. John Smith",), "john smith"), ("clean_name", ("John Smith III",), "john smith"), ("clean_name", ("Jane Doe PhD",), "jane doe"),
    ("clean_address", ("123 Main St.",), "123 main street"), ("clean_address", ("456 Oak Ave",), "456 oak avenue"), ("clean_address", ("100 N Main St",), "100 north main street"), ("clean_company", ("Acme Inc.",), "acme"), ("clean_company", ("Globex Corporation",), "globex"), ("clean_company", ("Ben & Jerry's",), "ben and jerry's"), ("clean_company", ("A + B Corp",), "a and b"), ("clean_company", ("Bar GmbH",), "bar"),
    ("normalize_email", ("User.Name+tag@Gmail.COM",), "username@gmail.com"), ("normalize_email", ("test@googlemail.com",), "test@gmail.com"), ("normalize_email", ("User@Example.COM",), "user@example.com"), ("normalize_email", ("not-an-email",), "not-an-email"),
    ("normalize_url", ("http://example.com:80/path",), "http://example.com/path"), ("normalize_url", ("https://example.com:443/path",), "https://example.com/path"), ("normalize_url", ("http://example.com/path#section",), "http://example.com/path"), ("normalize_url", ("",), ""),
    ("transliterate_cyrillic", ("Москва",), "Moskva"), ("transliterate_cyrillic", ("Щёлково",), "Shchyolkovo"), ("transliterate_cyrillic", ("объём",), "obyom"), ("transliterate_cyrillic", ("Київ",), "Kiyiv"), ("transliterate_greek", ("Αθήνα",), "Athina"), ("transliterate_greek", ("Παπαδόπουλος",), "Papadopoylos"), ("transliterate_greek", ("λόγος",), "logos"),
    ("transliterate", ("Москва Αθήνα 서울",), "Moskva Athina seoul"), ("transliterate_hebrew", ("ךםן",), "kmn"), ("transliterate_arabic", ("بَ",), "b"), ("transliterate_devanagari", ("क",), "ka"), ("transliterate_devanagari", ("क्",), "k"), ("transliterate_devanagari", ("कि",), "ki"), ("transliterate_devanagari", ("अइ",), "ai"),
    ("transliterate_hangul", ("한글",), "hangeul"), ("transliterate_hangul", ("서울",), "seoul"), ("transliterate_hangul", ("한 hello",), "han hello"), ("strip_arabic_diacritics", ("كَتـب",), "كتب"), ("strip_hebrew_diacritics", ("שָׁל",), "של"), ("strip_bidi_marks", ("‎hello‏ world‬",), "hello world"), ("normalize_arabic", ("أآإة",), "اااه"),
    ("validate_strings", ("a", "b"), "ok"), ("validate_strings", ("", "b"), "left_empty"), ("validate_strings", ("a", None), "right_empty"), ("validate_strings", ("", ""), "both_empty"),
    ("whitespace_tokenize", (" hello  beautiful world ",), "hello|beautiful|world"), ("ngram_tokenize", ("hello",), "he|el|ll|lo"), ("ngram_tokenize", ("a",), ""), ("trigram_tokenize", ("hello",), "hel|ell|llo"), ("character_tokenize", ("a b c",), "a|b|c"), ("smart_tokenize", ("Hello 世界",), "Hello|世|界"), ("smart_tokenize", ("hello world",), "hello|world"), ("cjk_ngram_tokenize", ("ab東京cd",), "東京"),
    ("smart_tokenize_ngram", ("Hello 東京都",), "Hello|東京|京都"), ("is_cjk", ("ab東",), "true"), ("is_cjk", ("ab",), "false"),
    ("levenshtein_distance", ("kitten", "sitting"), "3"), ("levenshtein_distance", ("saturday", "sunday"), "3"), ("levenshtein_distance", ("abc", ""), "3"), ("levenshtein_within_3", ("kitten", "sitting"), "3"), ("levenshtein_within_2", ("kitten", "sitting"), None), ("osa_distance", ("ab", "ba"), "1"), ("osa_distance", ("ca", "abc"), "3"), ("osa_within_1", ("ab", "ba"), "1"), ("osa_within_2", ("ca", "abc"), None),
    ("hamming_distance", ("karolin", "kathrin"), "3"), ("jaro", ("martha", "marhta"), "0.9444"), ("jaro_winkler", ("martha", "marhta"), "0.9611"), ("dissimilarity_jaro", ("martha", "marhta"), "0.0556"), ("cosine", ("ab", "cd"), "0.0000"), ("cosine", ("hello", "hello"), "1.0000"), ("jaccard", ("hello world", "hello there"), "0.3333"), ("sorensen_dice", ("night", "nacht"), "0.2500"),
    ("weighted_distance", ("kitten", "sitting"), "3.0000"), ("weighted_insert_2", ("", "abc"), "6.0000"), ("weighted_swap_half", ("ab", "ba"), "0.5000"), ("token_sort", ("John Smith", "Smith John"), "1.0000"), ("token_set", ("hello world", "hello world"), "1.0000"), ("partial_ratio", ("test", "this is a test"), "1.0000"), ("lcs_length", ("abcde", "ace"), "3"), ("lcs", ("abcde", "ace"), "0.7500"),
    ("substring_length", ("abcxyz", "xyzabc"), "3"), ("longest_common_substring", ("abcxyz", "xyzabc"), "0.5000"), ("substring_length", ("abc", "xyz"), "0"), ("ngram_similarity", ("hello", "hello"), "1.0000"), ("ngram_similarity", ("night", "nacht"), "0.1429"), ("smith_waterman", ("", ""), "1.0000"), ("smith_waterman_score", ("abcd", "abcd"), "8.0000"),
    ("needleman_wunsch", ("hello", "hello"), "1.0000"), ("gotoh", ("hello", "hello"), "1.0000"), ("ratcliff_obershelp", ("hello", "hello"), "1.0000"), ("monge_elkan", ("john smith", "smith john"), "1.0000"), ("monge_elkan_ratcliff", ("john smith", "smith john"), "1.0000"), ("monge_elkan_hybrid", ("john smith", "smith john"), "1.0000"), ("phonetic_hybrid", ("smith", "smith"), "1.0000"),
]


def results(spark: SparkSession) -> DataFrame:
    """(function, arguments, result): what the functions give for the arguments of GOLDENS."""
    out = None
    for name in dict.fromkeys(g[0] for g in GOLDENS):
        rows = [(name, *args, *[None] * (2 - len(args))) for n, args, _ in GOLDENS if n == name]
        width = max(len(args) for n, args, _ in GOLDENS if n == name)
        df = spark.createDataFrame(rows, "function string, a string, b string")
        value = FUNCTIONS[name](*[F.col(c) for c in "ab"[:width]])
        # Four decimals for numbers that are not whole by type.
        made = df.withColumn("v", value)
        shown = F.format_number("v", 4) if dict(made.dtypes)["v"] == "double" else F.col("v").cast("string")
        part = made.select("function", F.concat_ws("~", "a", "b").alias("arguments"), shown.alias("result"))
        out = part if out is None else out.unionByName(part)
    return out


def sql() -> str:
    quoted = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quoted(n)}, {quoted('~'.join(a for a in args if a is not None))}, {quoted(out)})" for n, args, out in GOLDENS) + ") t(function, arguments, result)"
