"""Golden values, and batch kernels against plain scalar models on random strings."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinloom.functions import kernels, phonetic, phonetic_rules, registry, similarity as sim, text, tokenizers as tok


def one(spark, column_of, *values):
    cols = ", ".join(f"c{i} string" for i in range(len(values)))
    df = spark.createDataFrame([values], cols)
    return df.select(column_of(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()[0]


def many(spark, column_of, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{i} string" for i in range(len(rows[0]))))
    out = df.select("i", column_of(*[F.col(f"c{i}") for i in range(len(rows[0]))]).alias("x")).orderBy("i").collect()
    return [r[1] for r in out]


GOLDEN = [
    (sim.levenshtein, "kitten", "sitting", 3), (sim.damerau_levenshtein, "ca", "abc", 3), (sim.hamming, "karolin", "kathrin", 3),
    (sim.jaro, "martha", "marhta", 0.9444), (sim.jaro_winkler, "martha", "marhta", 0.9611), (sim.sorensen_dice, "night", "nacht", 0.25),
    (sim.lcs_length, "abcde", "ace", 3), (sim.longest_common_substring_length, "abcxyz", "xyzabc", 3), (sim.cosine, "a", "b", 1.0),
    (sim.jaccard, "", "", 1.0), (sim.jaccard, "a b", "b c", 1 / 3), (sim.token_set_ratio, "new york mets", "mets new york city", 1.0),
    (sim.token_sort_ratio, "b a", "a b", 1.0), (sim.partial_ratio, "test", "a test b", 1.0), (sim.partial_ratio, "", "x", 0.0),
    (sim.ngram_similarity, "a", "b", 1.0), (sim.smith_waterman, "abc", "abc", 6.0), (sim.gotoh, "abc", "abc", 1.0), (sim.needleman_wunsch, "", "", 1.0),
    (sim.monge_elkan, "john smith", "smith john", 1.0), (sim.ratcliff_obershelp, "abcd", "bcde", 0.75), (sim.hamming_similarity, "a", "ab", 0.0),
    (lambda a, b: sim.weighted_levenshtein(a, b, insert_cost=2.0), "", "abc", 6.0), (lambda a, b: sim.levenshtein_threshold(a, b, 2), "kitten", "sitting", None),
    (lambda a, b: sim.damerau_levenshtein_threshold(a, b, 1), "ab", "ba", 1),
]


def test_golden(spark):
    df = spark.createDataFrame([(1,)], "x int").coalesce(1)
    row = df.select(*[f(F.lit(a), F.lit(b)).alias(str(i)) for i, (f, a, b, _) in enumerate(GOLDEN)]).first()
    for got, (_, a, b, want) in zip(row, GOLDEN):
        assert got == want if want is None else abs(got - want) < 1e-4, (a, b, got, want)


def _osa(a, b, ins=1, dele=1, sub=1, tra=1):
    d = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        d[i][0] = i * dele
    for j in range(len(b) + 1):
        d[0][j] = j * ins
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]) * sub, d[i - 1][j] + dele, d[i][j - 1] + ins)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + tra)
    return d[-1][-1]


def _jaro(a, b):
    if not a and not b:
        return 1.0
    w = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = set(), []
    for i, c in enumerate(a):
        for j in range(max(0, i - w), min(len(b), i + w + 1)):
            if j not in used and b[j] == c:
                used.add(j)
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    t = sum(x != b[j] for x, j in zip(hits, sorted(used))) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def _align_score(a, b, match, mis, gap, local):
    d = [[0.0 if local else (i + j) * gap for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    best = 0.0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = max(d[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mis), d[i - 1][j] + gap, d[i][j - 1] + gap, *([0.0] if local else []))
            best = max(best, d[i][j])
    return best if local else d[-1][-1]


def _gotoh(a, b, match, mis, start, ext):
    import functools

    @functools.cache
    def best(i, j, state):  # 0 aligned or anything, 1 gap in b (down), 2 gap in a (across)
        if i == 0 and j == 0:
            return 0.0 if state == 0 else -np.inf
        out = -np.inf
        if state == 1:
            return max(best(i - 1, j, 0) + start, best(i - 1, j, 1) + ext) if i else -np.inf
        if state == 2:
            return max(best(i, j - 1, 0) + start, best(i, j - 1, 2) + ext) if j else -np.inf
        if i and j:
            out = best(i - 1, j - 1, 0) + (match if a[i - 1] == b[j - 1] else mis)
        return max(out, best(i, j, 1), best(i, j, 2))

    return best(len(a), len(b), 0)


def _lcs(a, b, contiguous):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = d[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else 0 if contiguous else max(d[i - 1][j], d[i][j - 1])
            best = max(best, d[i][j])
    return best


def test_kernels_against_scalar_models():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdé日 ") for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 30, 70])))
    pairs = [(word(), word()) for _ in range(400)]
    a, b = (pd.Series(x, dtype=object) for x in zip(*pairs))
    for kernel, model in [
        (kernels.osa, _osa),
        (lambda *x: kernels.edit(*x, 2.0, 0.5, 1.5, 0.7), lambda x, y: _osa(x, y, 2.0, 0.5, 1.5, 0.7)),
        (kernels.jaro, _jaro),
        (kernels.lcs_length, lambda x, y: _lcs(x, y, False)),
        (kernels.substring_length, lambda x, y: _lcs(x, y, True)),
        (kernels.smith_waterman, lambda x, y: _align_score(x, y, 2, -1, -1, True)),
        (kernels.needleman_wunsch, lambda x, y: _align_score(x, y, 2, -1, -1, False)),
    ]:
        got = kernels.pairwise(kernel, a, b).tolist()
        assert np.allclose(got, [model(x, y) for x, y in pairs])
    short = [(x[:12], y[:12]) for x, y in pairs]
    a, b = (pd.Series(x, dtype=object) for x in zip(*short))
    got = kernels.pairwise(kernels.gotoh, a, b).tolist()
    assert np.allclose(got, [_gotoh(x, y, 1, -1, -1, -0.5) for x, y in short])


def every_metric(spark, rows):
    """One job for all metrics: a list of {metric: score} per pair."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    return [r.asDict() for r in df.coalesce(1).select("i", *[f(F.col("a"), F.col("b")).alias(n) for n, f in sim.METRICS.items()]).orderBy("i").drop("i").collect()]


def test_every_metric(spark):
    words = ["a", "john smith", "日本 語", "O'Brien", "x" * 65, "é́"]
    rows = [(None, "a"), ("a", None), ("", ""), *[(w, w) for w in words], *[(v, w) for v in words for w in words]]
    got = every_metric(spark, rows)
    assert all(v is None for r in got[:2] for v in r.values())
    assert all(abs(v - 1) < 1e-9 for r in got[2:9] for v in r.values())
    assert all(0 <= v <= 1 + 1e-9 for r in got[9:] for v in r.values())


def test_length_limit(spark):
    long = "x" * 30
    sim.set_max_string_length(20)
    try:
        assert one(spark, sim.metric("levenshtein"), long, long) == 0.0
        assert one(spark, sim.metric("jaro"), "ab", "ab") == 1.0
        assert one(spark, sim.jaro, long, long) == 1.0
    finally:
        sim.set_max_string_length(10_000)


def test_align(spark):
    got = one(spark, sim.levenshtein_align, "kitten", "sitting")
    assert got.distance == 3 and got.ops == ["sub:k->s", "match:i", "match:t", "match:t", "sub:e->i", "match:n", "ins:g"]
    assert got.visual.split("\n")[0] == "k i t t e n -"


def test_composite_and_explain(spark):
    assert abs(one(spark, sim.name_matching(), "smith", "smith") - 1) < 1e-9
    got = one(spark, lambda a, b: sim.explain(a, b, ["levenshtein", "jaro"]), "ab", "ab")
    assert got == {"levenshtein": 1.0, "jaro": 1.0}
    for bad in ([], [("jaro", 0.0)], [("nope", 1.0)]):
        with pytest.raises(ValueError):
            sim.CompositeScorer(bad)


PHONETIC = [
    ("soundex", "Robert", "R163"), ("soundex", "Ashcraft", "A261"), ("soundex", "b-b", "B000"), ("soundex", "", "0000"), ("metaphone", "Schmidt", "SXMTT"), ("metaphone", "Gnome", "NM"),
    ("double_metaphone", "Smith", "SMT"), ("nysiis", "Johnson", "JANSAN"), ("nysiis", "Smith", "SNAT"), ("caverphone", "Lee", "L111111111"), ("caverphone", "David", "TFT1111111"),
    ("cologne_phonetic", "Mueller", "657"), ("cologne_phonetic", "H", ""), ("phonex", "Smyth", "S530"), ("phonex", "A", "V000"), ("mra", "Catherine", "CTHRN"), ("daitch_mokotoff", "", "000000"),
]


def test_phonetic(spark):
    for algorithm, word, want in PHONETIC:
        assert one(spark, lambda c: phonetic.encode(c, algorithm), word) == want, (algorithm, word)
        assert phonetic_rules.ENCODERS[algorithm](word) == want
    rng = random.Random(3)
    words = ["".join(rng.choice("AHWYEBCDKSZT'- éx") for _ in range(rng.randrange(9))) for _ in range(300)]
    for algorithm in ("soundex", "mra"):
        assert many(spark, lambda c: phonetic.encode(c, algorithm), [(w,) for w in words]) == [phonetic_rules.ENCODERS[algorithm](w) for w in words]
    names = ["Goldstein", "Schwarzenegger", "Rousseau", "Kowalski", "Ivanova", "Moretti", "Gonzalez", "Washington", "Kim", "ino", "simões", "a\nton", ""]
    want = ["ashkenazi", "german", "french", "polish", "russian", "italian", "spanish", "english", "generic", "generic", "portuguese", "english", "generic"]
    assert many(spark, phonetic.detect_language, [(n,) for n in names]) == want == [phonetic_rules.detect_language(n) for n in names]
    assert many(spark, phonetic.mra_compare, [("Byrne", "Boern"), ("Smith", "Washington"), ("", "")]) == [True, False, True]
    assert one(spark, phonetic.daitch_mokotoff_match, "Peters", "Peterz") is True
    assert one(spark, phonetic.beider_morse, "saw") == "sav|saw|zav|zaw"
    for algorithm in phonetic.ENCODERS:
        assert one(spark, lambda c: phonetic.encode(c, algorithm), None) is None


TEXT = [
    (text.clean_name, "Smith, Dr. John Jr.", "john smith"), (text.clean_address, "123 N. Main St", "123 north main street"), (text.clean_company, "Foo & Bar Inc.", "foo and bar"),
    (text.normalize_email, "John.Doe+x@GoogleMail.com", "johndoe@gmail.com"), (text.normalize_email, "A.B@x.org", "a.b@x.org"), (text.normalize_email, "none", "none"),
    (text.normalize_url, "HTTPS://www.Ex.com:443/a//?b=2&a=1#f", "https://ex.com/a?a=1&b=2"), (text.normalize_url, " Ex.com ", "ex.com"), (text.normalize_url, "http://h?q=1/2", "http://h?q=1/2"),
    (text.standardize_name, "Dr Foo west side", "doctor foo wesaint side"), (text.strip_punctuation, "a-b—c!", "ab—c"), (text.normalize_whitespace, " a \t　b ", "a b"),
    (text.remove_stop_words, "The cat and THE dog", "cat dog"), (text.expand_abbreviations, "Main st. Foo", "Main street Foo"), (text.strip_diacritics, "Éa", "Ea"),
    (text.transliterate_cyrillic, "Щука", "Shchuka"), (text.transliterate_greek, "Ψυχής", "Psychis"), (text.transliterate_arabic, "محمد", "mhmd"), (text.transliterate_hebrew, "שלום", "shlvm"),
    (text.transliterate_devanagari, "नमस्ते", "namaste"), (text.transliterate_hangul, "한국", "hanguk"), (text.normalize_arabic, "أة", "اه"), (text.strip_bidi_marks, "a‎b", "ab"),
    (text.strip_hebrew_diacritics, "שָ", "ש"), (lambda c: text.fold_case_locale(c, "turkish"), "Iİ", "ıi"), (lambda c: text.normalize_unicode(c, "nfkc"), "ﬁ", "fi"),
    (text.operation("regex_replace:[0-9]+:#"), "a12b", "a#b"), (text.operation('synonym_expand:{"bob":"robert"}'), "Bob x", "robert x"), (text.operation("cjk_ngram_tokenize_2"), "日本語a", "日本 本語"),
]


def test_text(spark):
    df = spark.createDataFrame([(v, None) for _, v, _ in TEXT], "v string, n string").coalesce(1)
    rows = df.select(*[f(F.col("v")).alias(f"v{i}") for i, (f, _, _) in enumerate(TEXT)], *[f(F.col("n")).alias(f"n{i}") for i, (f, _, _) in enumerate(TEXT)]).collect()
    for i, (_, value, want) in enumerate(TEXT):
        assert rows[i][f"v{i}"] == want, value
        assert rows[i][f"n{i}"] is None
    for bad in ("nope", "regex_replace:x", "synonym_expand:{", "cjk_ngram_tokenize_x", "custom:"):
        with pytest.raises(ValueError):
            text.operation(bad)
    assert many(spark, text.validate_strings, [("a", "b"), ("", None), (None, "x"), ("x", "")]) == ["ok", "both_empty", "left_empty", "right_empty"]


def test_tokenizers(spark):
    cases = [
        (tok.whitespace_tokenize, " a b  c", ["a", "b", "c"]), (tok.ngram_tokenize, "abc", ["ab", "bc"]), (tok.ngram_tokenize, "a", []), (tok.character_tokenize, "a b", ["a", "b"]),
        (tok.smart_tokenize, "ab 日本c", ["ab", "日", "本", "c"]), (tok.cjk_ngram_tokenize, "a日b本", ["日本"]), (tok.smart_tokenize_ngram, "ab日本語 x 中", ["ab", "日本", "本語", "x", "中"]),
        (lambda c: tok.ngram_tokenize(c, 0), "abc", []), (tok.whitespace_tokenize, "", []),
    ]
    for f, value, want in cases:
        assert one(spark, f, value) == want
        assert one(spark, f, None) is None


def test_registry(spark):
    registry.register_metric("first_letter", lambda a, b: float(a[0] == b[0]))
    assert many(spark, sim.metric("first_letter"), [("ab", "ac"), ("", "x")]) == [1.0, 0.0]
    with pytest.raises(ValueError):
        registry.register_metric("jaro", lambda a, b: 1.0)
    assert registry.list_custom_metrics() == ["first_letter"] and registry.unregister_metric("first_letter") and not registry.unregister_metric("first_letter")
    registry.register_preprocessor("shout", lambda s: s.upper())
    assert one(spark, text.operation("custom:shout"), "a") == "A"
    registry.register_tokenizer("commas", lambda s: s.split(","))
    assert one(spark, registry.tokenizer("commas"), "a,b") == ["a", "b"]
    with pytest.raises(ValueError):
        registry.register_blocker("bad", object())
