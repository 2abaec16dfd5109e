"""SQL that states operators a second time, independently of their Spark plans: dynamic programs as recursive queries,
phonetic encoders as scanners, normalisers and tokenisers as list expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from kinloom.functions import text

VOWELS = "AEIOU"
#: White space and CJK as classes of this dialect.
WS = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def joined(items: str, sep: str = "") -> str:
    return f"coalesce(list_aggregate({items}, 'string_agg', {quoted(sep)}), '')"


def any_of(x: str, letters: str) -> str:
    return f"{x} IN ({', '.join(quoted(c) for c in letters)})"


def runs(x: str) -> str:
    """``x`` with repeated characters written once."""
    return joined(f"list_transform(list_filter(range(1, length({x}) + 1), lambda i: i = 1 OR {x}[i] <> {x}[i - 1]), lambda i: {x}[i])")


# --- string metrics ----------------------------------------------------------------------------------------------------------
def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda w: w <> '')"


def soundex(x: str) -> str:
    """Of an expression that is a column of upper-case letters."""
    k = f"translate({x}[1] || regexp_replace(substr({x}, 2), '[HW]', '', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556')"
    digits = joined(f"list_transform(list_filter(range(2, length({k}) + 1), lambda i: {k}[i] <> {k}[i - 1] AND {k}[i] BETWEEN '1' AND '6'), lambda i: {k}[i])")
    return f"CASE WHEN {x} = '' THEN '0000' ELSE rpad(substr({x}[1] || {digits}, 1, 4), 4, '0') END"


#: CTEs from jp (x, y), pairs of texts, to ja (x, y, jaro, jw): greedy leftmost matches inside the window, letter by letter.
JARO = """
js AS (
  SELECT x, y, 0 AS i, greatest(greatest(length(x), length(y)) // 2 - 1, 0) AS win, []::BIGINT[] AS hits, []::VARCHAR[] AS got FROM jp
  UNION ALL
  SELECT x, y, i + 1, win, CASE WHEN j IS NULL THEN hits ELSE list_append(hits, j) END, CASE WHEN j IS NULL THEN got ELSE list_append(got, x[i + 1]) END
  FROM (SELECT *, list_min(list_filter(range(greatest(1, i + 1 - win), least(length(y), i + 1 + win) + 1), lambda j: y[j] = x[i + 1] AND NOT list_contains(hits, j))) AS j FROM js WHERE i < length(x))),
jm AS (SELECT x, y, len(hits) AS m, len(list_filter(range(1, len(hits) + 1), lambda k: got[k] <> y[list_sort(hits)[k]])) / 2 AS t,
  len(list_filter(range(1, 5), lambda k: k <= least(length(x), length(y)) AND substr(x, 1, k) = substr(y, 1, k))) AS pre FROM js WHERE i = length(x)),
j0 AS (SELECT x, y, pre, CASE WHEN x = '' AND y = '' THEN 1.0 WHEN m = 0 THEN 0.0 ELSE (m / length(x) + m / length(y) + (m - t) / m) / 3 END AS jaro FROM jm),
ja AS (SELECT x, y, jaro, jaro + 0.1 * pre * (1 - jaro) AS jw FROM j0)"""
_ROW = """list_transform(range(0, lb + 1), lambda j: {shift} + {best}({base}[1:j + 1]))"""


def alignments(ab: str) -> str:
    """CTEs ending in ``m``: id and the score of every metric for the rows (id, a, b) of ``ab``; all texts are non-empty.

    The dynamic programs go row by row over all distinct pairs at once; along a row, a gap of any length is a running
    best of values shifted by its cost.
    """
    lev = lambda a, b: f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1.0 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"
    grams = lambda x, n=2: f"list_transform(range(1, greatest(length({x}) - {n - 1}, 0) + 1), lambda i: substr({x}, i, {n}))"
    times = lambda x, q: f"len(list_filter({x}, lambda z: z = {q}))"
    share = lambda s, unit: f"least(1.0, greatest(0.0, {s} / (least(la, lb) * {unit})))"
    words = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
    letters = lambda x: f"upper(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"
    return f"""
ab AS ({ab}), pr AS (SELECT DISTINCT a, b, length(a) AS la, length(b) AS lb FROM ab),
dp AS (
  SELECT a, b, la, lb, 0 AS i, list_transform(range(0, lb + 1), lambda j: j::DOUBLE) AS e, list_transform(range(0, lb + 1), lambda j: 0.0::DOUBLE) AS e2,
    list_transform(range(0, lb + 1), lambda j: 0.0::DOUBLE) AS l, list_transform(range(0, lb + 1), lambda j: 0.0::DOUBLE) AS s, 0.0::DOUBLE AS top, list_transform(range(0, lb + 1), lambda j: -j::DOUBLE) AS n,
    list_transform(range(0, lb + 1), lambda j: (CASE WHEN j = 0 THEN 0.0 ELSE -1.0 - (j - 1) * 0.5 END)::DOUBLE) AS g, list_transform(range(0, lb + 1), lambda j: -1e9::DOUBLE) AS d FROM pr
  UNION ALL
  SELECT a, b, la, lb, i + 1, {_ROW.format(shift='j', best='list_min', base='eb')}, e, {_ROW.format(shift='0', best='list_max', base='lc')}, {_ROW.format(shift='-j', best='list_max', base='sb')},
    greatest(top, list_max({_ROW.format(shift='-j', best='list_max', base='sb')})), {_ROW.format(shift='-j', best='list_max', base='nb')},
    list_transform(range(0, lb + 1), lambda j: CASE WHEN j = 0 THEN gb[1] ELSE greatest(gb[j + 1], -1.0 - (j - 1) * 0.5 + list_max(list_transform(range(0, j), lambda k: gb[k + 1] + k * 0.5))) END), dn
  FROM (
    SELECT *, list_concat([(i + 1)::DOUBLE], list_transform(range(1, lb + 1), lambda j: least(e[j] + (c <> b[j])::INT, e[j + 1] + 1, CASE WHEN i > 0 AND j > 1 AND c = b[j - 1] AND a[i] = b[j] THEN e2[j - 1] + 1 ELSE 1e9 END) - j)) AS eb,
      list_concat([0.0::DOUBLE], list_transform(range(1, lb + 1), lambda j: greatest(l[j] + (c = b[j])::INT, l[j + 1])::DOUBLE)) AS lc,
      list_concat([0.0::DOUBLE], list_transform(range(1, lb + 1), lambda j: (greatest(0.0, s[j] + CASE WHEN c = b[j] THEN 2 ELSE -1 END, s[j + 1] - 1) + j)::DOUBLE)) AS sb,
      list_concat([-(i + 1)::DOUBLE], list_transform(range(1, lb + 1), lambda j: (greatest(n[j] + CASE WHEN c = b[j] THEN 2 ELSE -1 END, n[j + 1] - 1) + j)::DOUBLE)) AS nb,
      list_concat([(-1.0 - i * 0.5)::DOUBLE], list_transform(range(1, lb + 1), lambda j: greatest(g[j] + CASE WHEN c = b[j] THEN 1 ELSE -1 END, dn[j + 1])::DOUBLE)) AS gb
    FROM (SELECT *, substr(a, i + 1, 1) AS c, list_transform(range(0, lb + 1), lambda j: greatest(g[j + 1] - 1.0, d[j + 1] - 0.5)::DOUBLE) AS dn FROM dp WHERE i < la))),
seg AS (
  SELECT a, b, a AS x, b AS y, 0 AS got, 0 AS depth FROM pr
  UNION ALL
  SELECT a, b, part.x, part.y, part.got, depth + 1 FROM (
    SELECT a, b, depth, unnest(CASE WHEN k = 0 THEN [] ELSE [{{'x': substr(x, 1, p - 1), 'y': substr(y, 1, q - 1), 'got': k}}, {{'x': substr(x, p + k), 'y': substr(y, q + k), 'got': 0}}] END) AS part FROM (
      SELECT *, instr(y, substr(x, p, k)) AS q FROM (
        SELECT *, coalesce(list_min(list_filter(range(1, length(x) - k + 2), lambda s: contains(y, substr(x, s, k)))), 1) AS p FROM (
          SELECT *, coalesce(list_max(list_transform(range(1, length(x) + 1), lambda s: coalesce(list_max(list_filter(range(1, length(x) - s + 2), lambda t: contains(y, substr(x, s, t)))), 0))), 0) AS k FROM seg WHERE x <> '' AND y <> ''))))),
ro AS (SELECT a, b, sum(got) AS got FROM seg GROUP BY ALL),
tp AS (SELECT a, b, p, q FROM pr, LATERAL (SELECT unnest({words('a')}) AS p), LATERAL (SELECT unnest({words('b')}) AS q)),
jp AS (SELECT a AS x, b AS y FROM pr UNION SELECT p, q FROM tp), {JARO},
mo AS (SELECT a, b, avg(best) AS monge_elkan FROM (SELECT a, b, i, max(greatest(0.0, jw)) AS best FROM (SELECT a, b, unnest({words('a')}) AS p, generate_subscripts({words('a')}, 1) AS i FROM pr) JOIN (SELECT DISTINCT a, b, p, q FROM tp) USING (a, b, p) JOIN ja ON x = p AND y = q GROUP BY ALL) GROUP BY ALL),
dpf AS (SELECT a, b, la, lb, e[lb + 1] AS osa, l[lb + 1] AS lcs, top AS sw, n[lb + 1] AS nw, g[lb + 1] AS go FROM dp WHERE i = la),
sets AS (SELECT a, b, {grams('a')} AS x, {grams('b')} AS y, {words('a')} AS s, {words('b')} AS t, {letters('a')} AS ua, {letters('b')} AS ub FROM pr),
set2 AS (SELECT *, list_distinct(list_concat(x, y)) AS u, {joined('list_sort(s)', ' ')} AS ss, {joined('list_sort(t)', ' ')} AS tt, {joined('list_sort(list_intersect(s, t))', ' ')} AS cut,
  {joined('list_sort(list_filter(list_distinct(s), lambda q: NOT list_contains(t, q)))', ' ')} AS ra, {joined('list_sort(list_filter(list_distinct(t), lambda q: NOT list_contains(s, q)))', ' ')} AS rb,
  {soundex('ua')} AS xa, {soundex('ub')} AS xb FROM sets),
set3 AS (SELECT *, trim(cut || ' ' || ra) AS ca, trim(cut || ' ' || rb) AS cb, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS lo, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS hi FROM set2),
m0 AS (SELECT a, b,
  {lev('a', 'b')} AS levenshtein, 1 - osa / greatest(la, lb) AS damerau_levenshtein, CASE WHEN la = lb THEN 1.0 - hamming(a, b[1:la] || repeat(' ', greatest(la - lb, 0)))::DOUBLE / la ELSE 0.0 END AS hamming,
  jaro, jw AS jaro_winkler,
  list_sum(list_transform(u, lambda q: {times('x', 'q')} * {times('y', 'q')})) / (sqrt(list_sum(list_transform(list_distinct(x), lambda q: {times('x', 'q')} ** 2))) * sqrt(list_sum(list_transform(list_distinct(y), lambda q: {times('y', 'q')} ** 2)))) AS cosine,
  len(list_intersect(s, t))::DOUBLE / len(list_distinct(list_concat(s, t))) AS jaccard,
  2.0 * list_sum(list_transform(u, lambda q: least({times('x', 'q')}, {times('y', 'q')}))) / (len(x) + len(y)) AS sorensen_dice,
  1 - osa / greatest(la, lb) AS weighted_levenshtein, {lev('ss', 'tt')} AS token_sort, greatest({lev('cut', 'ca')}, {lev('cut', 'cb')}, {lev('ca', 'cb')}) AS token_set,
  list_max(list_transform(range(1, length(hi) - length(lo) + 2), lambda k: 1.0 - levenshtein(lo, substr(hi, k, length(lo)))::DOUBLE / length(lo))) AS partial_ratio,
  2 * lcs / (la + lb) AS lcs,
  2.0 * list_max(list_transform(range(1, length(lo) + 1), lambda i: coalesce(list_max(list_filter(range(1, length(lo) - i + 2), lambda k: contains(hi, substr(lo, i, k)))), 0))) / (la + lb) AS longest_common_substring,
  len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) AS ngram_similarity,
  {share('sw', '2.0')} AS smith_waterman, 0.3 * (xa = xb)::INT + 0.7 * jw AS phonetic_hybrid, 2.0 * got / (la + lb) AS ratcliff_obershelp, {share('nw', '2.0')} AS needleman_wunsch, {share('go', '1.0')} AS gotoh,
  monge_elkan, osa
  FROM dpf JOIN set3 USING (a, b) JOIN ro USING (a, b) JOIN mo USING (a, b) JOIN (SELECT x AS a, y AS b, jaro, jw FROM ja) jj USING (a, b)),
m AS (SELECT id, m0.* FROM ab JOIN m0 USING (a, b))"""


METRICS = (
    "levenshtein", "damerau_levenshtein", "hamming", "jaro", "jaro_winkler", "cosine", "jaccard", "sorensen_dice", "weighted_levenshtein", "token_sort", "token_set", "partial_ratio", "lcs",
    "longest_common_substring", "ngram_similarity", "smith_waterman", "phonetic_hybrid", "ratcliff_obershelp", "needleman_wunsch", "gotoh", "monge_elkan",
)


def align_ops(ab: str) -> str:
    """id, ops, distance, visual: the whole edit table of every pair, then a walk from its end."""
    cell = lambda i, j: f"d[{i} + 1][{j} + 1]"
    return f"""
WITH RECURSIVE ab AS ({ab}), pr AS (SELECT DISTINCT a, b, length(a) AS la, length(b) AS lb FROM ab),
t AS (
  SELECT a, b, la, lb, 0 AS i, [list_transform(range(0, lb + 1), lambda j: j::INT)] AS d FROM pr
  UNION ALL
  SELECT a, b, la, lb, i + 1, list_append(d, {_ROW.format(shift='j::INT', best='list_min', base='base')}) FROM (
    SELECT *, list_concat([i + 1], list_transform(range(1, lb + 1), lambda j: (least(d[i + 1][j] + (substr(a, i + 1, 1) <> b[j])::INT, d[i + 1][j + 1] + 1) - j)::INT)) AS base FROM t WHERE i < la)),
w AS (
  SELECT a, b, d, la AS i, lb AS j, []::VARCHAR[] AS ops, ''::VARCHAR AS x, ''::VARCHAR AS y, ''::VARCHAR AS z FROM t WHERE i = la
  UNION ALL
  SELECT a, b, d, i - (how <> 'ins')::INT, j - (how <> 'del')::INT,
    list_prepend(CASE how WHEN 'match' THEN 'match:' || a[i] WHEN 'sub' THEN 'sub:' || a[i] || '->' || b[j] WHEN 'del' THEN 'del:' || a[i] ELSE 'ins:' || b[j] END, ops),
    CASE WHEN how = 'ins' THEN '-' ELSE a[i] END || CASE WHEN x = '' THEN '' ELSE ' ' || x END, CASE WHEN how = 'match' THEN '|' ELSE ' ' END || CASE WHEN x = '' THEN '' ELSE ' ' || y END, CASE WHEN how = 'del' THEN '-' ELSE b[j] END || CASE WHEN x = '' THEN '' ELSE ' ' || z END
  FROM (SELECT *, CASE WHEN i > 0 AND j > 0 AND a[i] = b[j] AND {cell('i', 'j')} = {cell('(i - 1)', '(j - 1)')} THEN 'match' WHEN i > 0 AND j > 0 AND a[i] <> b[j] AND {cell('i', 'j')} = {cell('(i - 1)', '(j - 1)')} + 1 THEN 'sub'
      WHEN i > 0 AND {cell('i', 'j')} = {cell('(i - 1)', 'j')} + 1 THEN 'del' ELSE 'ins' END AS how FROM w WHERE i > 0 OR j > 0))
SELECT id, ops, {cell('length(a)', 'length(b)')} AS distance, x || chr(10) || y || chr(10) || z AS visual FROM ab JOIN (SELECT * FROM w WHERE i = 0 AND j = 0) USING (a, b)"""


# --- phonetic codes ------------------------------------------------------------------------------------------------------------
def scanner(name: str, source: str, rules: Sequence[tuple[str, int, str]], start: str = "1", outputs: int = 1) -> str:
    """CTEs ending in ``name`` (w, out): every word of ``source`` (w) read from left to right; rules are (condition on the letter
    c, its neighbours p, n1, n2 and the place pos; letters read; what is written). What no rule meets is passed over."""
    case = " ".join(f"WHEN {cond} THEN {{'k': {k}, 'o': {out}}}" for cond, k, out in rules)
    return f"""
{name}_s AS (
  SELECT w, {start} AS pos, '' AS out FROM {source}
  UNION ALL
  SELECT w, pos + r.k, out || r.o FROM (SELECT w, pos, out, CASE {case} ELSE {{'k': 1, 'o': ''}} END AS r FROM (
    SELECT *, substr(w, pos, 1) AS c, CASE WHEN pos > 1 THEN substr(w, pos - 1, 1) ELSE '' END AS p, substr(w, pos + 1, 1) AS n1, substr(w, pos + 2, 1) AS n2 FROM {name}_s WHERE pos <= length(w)))),
{name} AS (SELECT w, out FROM {name}_s WHERE pos > length(w))"""


def _is(c: str) -> str:
    return f"c = '{c}'"


def _two(s: str) -> str:
    return f"c = '{s[0]}' AND n1 = '{s[1]}'"


_SOFT = any_of("n1", "EIY")
_VOWEL_NEXT = any_of("n1", VOWELS)
_SILENT = "CASE WHEN substr(w, 1, 2) IN ('AE', 'GN', 'KN', 'PN', 'WR') THEN 2 ELSE 1 END"
_METAPHONE = [
    ("c = p AND c <> 'C'", 1, "''"), (f"pos = 1 AND {any_of('c', VOWELS)}", 1, "c"), ("c = 'B' AND (p <> 'M' OR n1 = '')", 1, "'B'"), (_two("CH"), 2, "'X'"), ("c = 'C' AND n1 = 'I' AND n2 = 'A'", 1, "'X'"),
    (f"c = 'C' AND {_SOFT}", 1, "'S'"), (_is("C"), 1, "'K'"), ("c = 'D' AND n1 = 'G' AND n2 IN ('E', 'I', 'Y')", 1, "'J'"), (_is("D"), 1, "'T'"), (_is("F"), 1, "c"),
    (f"c = 'G' AND n1 = 'H' AND n2 <> '' AND NOT ({any_of('n2', VOWELS)})", 2, "''"), ("c = 'G' AND pos > 1 AND n1 = 'N'", 1, "''"), (f"c = 'G' AND {_SOFT}", 1, "'J'"), (_is("G"), 1, "'K'"),
    (f"c = 'H' AND NOT ({any_of('p', VOWELS)}) AND {_VOWEL_NEXT}", 1, "c"), ("c = 'K' AND p <> 'C'", 1, "c"), (_two("PH"), 2, "'F'"), (_is("Q"), 1, "'K'"), (_two("SH"), 2, "'X'"), ("c = 'S' AND n1 = 'I' AND n2 IN ('A', 'O')", 2, "'X'"),
    (_two("TH"), 2, "'0'"), ("c = 'T' AND n1 = 'I' AND n2 IN ('A', 'O')", 1, "'X'"), (_is("V"), 1, "'F'"), (f"c IN ('W', 'Y') AND {_VOWEL_NEXT}", 1, "c"), (_is("X"), 1, "'KS'"), (_is("Z"), 1, "'S'"), (any_of("c", "JLMNPRST"), 1, "c"),
]


def _doubled(letter: str, out: str) -> list[tuple[str, int, str]]:
    return [(_two(letter * 2), 2, out), (_is(letter), 1, out)]


def _double_metaphone(second: bool) -> list[tuple[str, int, str]]:
    pick = lambda a, b: quoted(b if second else a)
    rules = [(f"pos = 1 AND {any_of('c', VOWELS)}", 1, "'A'"), *_doubled("B", "'P'"), (_two("CH"), 2, "'X'"), (f"c = 'C' AND {_SOFT}", 1, "'S'"), *_doubled("C", "'K'"), ("c = 'D' AND n1 = 'G' AND n2 IN ('E', 'I', 'Y')", 2, "'J'"), *_doubled("D", "'T'"), *_doubled("F", "c")]
    rules += [(f"c = 'G' AND n1 = 'H' AND {any_of('n2', VOWELS)}", 2, "'K'"), (_two("GH"), 2, "''"), (f"c = 'G' AND {_SOFT}", 1, pick("J", "K")), *_doubled("G", "'K'"), (f"c = 'H' AND NOT ({any_of('p', VOWELS)}) AND {_VOWEL_NEXT}", 1, "c"), *_doubled("J", pick("J", "H"))]
    rules += [x for c in "KLMN" for x in _doubled(c, "c")] + [(_two("PH"), 2, "'F'"), *_doubled("P", "c"), *_doubled("Q", "'K'"), *_doubled("R", "c"), (_two("SH"), 2, "'X'"), ("c = 'S' AND n1 = 'C' AND n2 IN ('E', 'I', 'Y')", 3, "'S'"), *_doubled("S", "c")]
    return rules + [(_two("TH"), 2, pick("T", "0")), *_doubled("T", "c"), *_doubled("V", "'F'"), (f"c IN ('W', 'Y') AND {_VOWEL_NEXT}", 1, "'A'"), *_doubled("X", "'KS'"), *_doubled("Z", "'S'")]


_HARD = any_of("{0}", "AHKLOQRUX")
_COLOGNE = [
    (any_of("c", "AEIOUJY"), 1, "'0'"), ("c = 'P' AND n1 = 'H'", 1, "'3'"), ("c IN ('B', 'P')", 1, "'1'"), ("c IN ('D', 'T') AND n1 IN ('C', 'S', 'Z')", 1, "'8'"), ("c IN ('D', 'T')", 1, "'2'"), (any_of("c", "FVW"), 1, "'3'"), (any_of("c", "GKQ"), 1, "'4'"),
    (_is("X"), 1, "'48'"), (_is("L"), 1, "'5'"), ("c IN ('M', 'N')", 1, "'6'"), (_is("R"), 1, "'7'"), ("c IN ('S', 'Z')", 1, "'8'"), (f"c = 'C' AND ((pos = 1 AND {_HARD.format('n1')}) OR {_HARD.format('p')})", 1, "'4'"), (_is("C"), 1, "'8'"),
]
_NYSIIS = [
    (_two("EV"), 2, "'AF'"), (any_of("c", VOWELS), 1, "'A'"), (_is("Q"), 1, "'G'"), (_is("Z"), 1, "'S'"), (_is("M"), 1, "'N'"), ("c = 'K' AND n1 = 'N'", 1, "'N'"), (_is("K"), 1, "'C'"), ("c = 'S' AND n1 = 'C' AND n2 = 'H'", 3, "'SSS'"), (_two("PH"), 2, "'FF'"),
    (f"c = 'H' AND {any_of('p', VOWELS)} AND n1 <> '' AND NOT ({_VOWEL_NEXT})", 1, "'A'"), (f"c = 'H' AND p <> '' AND NOT ({any_of('p', VOWELS)})", 1, "p"), (f"c = 'W' AND {any_of('p', VOWELS)}", 1, "p"), ("true", 1, "c"),
]
#: Steps of the caverphone code on a lower-case word, in order (fixed values).
_CAVERPHONE = (
    ("cough", "cof2"), ("rough", "rof2"), ("tough", "tof2"), ("enough", "enof2"), ("trough", "trof2"), ("gn", "2n"), ("mb", "m2"), ("cq", "2q"), ("ci", "si"), ("ce", "se"), ("cy", "sy"), ("tch", "2ch"), ("c", "k"), ("q", "k"), ("x", "k"), ("v", "f"),
    ("dg", "2g"), ("tio", "sio"), ("tia", "sia"), ("d", "t"), ("ph", "fh"), ("b", "p"), ("sh", "s2"), ("z", "s"),
)


def _chain(x: str, steps: Sequence[tuple[str, str]]) -> str:
    for old, new in steps:
        x = f"replace({x}, {quoted(old)}, {quoted(new)})"
    return x


def _after(pattern: str, x: str, out: str, also: str = "") -> str:
    return f"CASE WHEN regexp_matches({x}, '{pattern}'){also} THEN regexp_replace({x}, '{pattern}', '{out}') ELSE {x} END"


def phonetic(source: str) -> str:
    """id and all codes that rules of one word can state; ``source`` has id and v. Null gives null."""
    opened = "CASE WHEN w LIKE 'MAC%' THEN 'MCC' || substr(w, 4) WHEN w LIKE 'KN%' THEN substr(w, 2) WHEN w LIKE 'K%' THEN 'C' || substr(w, 2) WHEN w LIKE 'PH%' OR w LIKE 'PF%' THEN 'FF' || substr(w, 3) WHEN w LIKE 'SCH%' THEN 'SSS' || substr(w, 4) ELSE w END"
    closed = "CASE WHEN regexp_matches(v, '(EE|IE)$') THEN v[1:length(v) - 2] || 'Y' WHEN regexp_matches(v, '(DT|RT|RD|NT|ND)$') THEN v[1:length(v) - 2] || 'D' ELSE v END"
    px = "regexp_replace(w, '^(AE)', 'E')"
    return f"""
WITH RECURSIVE src AS ({source}), low AS (SELECT id, v, lower(v) AS l, upper(regexp_replace(v, '[^A-Za-z]', '', 'g')) AS w FROM src), words AS (SELECT DISTINCT w FROM low WHERE w IS NOT NULL),
{scanner('mp', 'words', _METAPHONE, _SILENT)},
{scanner('d1', 'words', _double_metaphone(False), _SILENT)},
{scanner('d2', 'words', _double_metaphone(True), _SILENT)},
{scanner('co', 'words', _COLOGNE)},
ny0 AS (SELECT DISTINCT w AS was, {opened} AS v FROM words), ny1 AS (SELECT was, {closed} AS w FROM ny0), nyw AS (SELECT DISTINCT w FROM ny1 WHERE w <> ''),
{scanner('ny', 'nyw', _NYSIIS, '2')},
ny2 AS (SELECT was, w[1] || out AS k FROM ny1 JOIN ny USING (w)), ny3 AS (SELECT was, {_after('S$', 'k', '', ' AND length(k) > 1')} AS k FROM ny2), ny4 AS (SELECT was, regexp_replace(k, 'AY$', 'Y') AS k FROM ny3), ny5 AS (SELECT was AS w, {_after('A$', 'k', '', ' AND length(k) > 1')} AS k FROM ny4),
cv0 AS (SELECT w, regexp_replace(lower(w), 'e$', '') AS k FROM words), cv1 AS (SELECT w, {_chain('k', _CAVERPHONE)} AS k FROM cv0), cv2 AS (SELECT w, regexp_replace(regexp_replace(regexp_replace(k, '^[aeiou]', 'A'), '[aeiou]', '3', 'g'), '([^A3])h+', '\\1', 'g') AS k FROM cv1), cv3 AS (SELECT w, regexp_replace(k, '[23]', '', 'g') AS k FROM cv2),
px0 AS (SELECT w, CASE WHEN w LIKE 'PH%' OR w LIKE 'PF%' OR w LIKE 'KN%' OR w LIKE 'WR%' OR w LIKE 'AE%' OR w LIKE 'SCH%' OR w[1] IN ('H', 'W', 'Y') THEN substr(w, 2) ELSE w END AS r FROM words),
px1 AS (SELECT w, r, CASE WHEN {any_of('r[1]', VOWELS + 'Y')} THEN 'V' ELSE r[1] END AS h FROM px0), px2 AS (SELECT w, r, h, translate(h || regexp_replace(substr(r, 2), '[HW]', '', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556') AS k FROM px1),
ru AS (SELECT w, {runs('w')} AS k FROM words), mr AS (SELECT w, k[1] || regexp_replace(substr(k, 2), '[AEIOU]', '', 'g') AS k FROM ru)
SELECT low.id, mp.out AS metaphone, substr(d1.out, 1, 4) AS dm1, substr(d2.out, 1, 4) AS dm2,
  CASE WHEN low.w = '' THEN '' WHEN ny5.k IS NULL AND low.w IS NOT NULL THEN '' ELSE substr({runs('ny5.k')}, 1, 6) END AS nysiis,
  CASE WHEN cv0.k = '' THEN '1111111111' ELSE substr(upper({runs('cv3.k')}) || '1111111111', 1, 10) END AS caverphone,
  CASE WHEN length({runs('co.out')}) <= 1 THEN {runs('co.out')} WHEN replace({runs('co.out')}, '0', '') = '' THEN '0' ELSE replace({runs('co.out')}, '0', '') END AS cologne_phonetic,
  CASE WHEN low.w = '' THEN '0000' WHEN px2.r = '' THEN low.w[1] || '000' ELSE rpad(substr(h || {joined("list_transform(list_filter(range(2, length(px2.k) + 1), lambda i: px2.k[i] <> px2.k[i - 1] AND px2.k[i] BETWEEN '1' AND '6'), lambda i: px2.k[i])")}, 1, 4), 4, '0') END AS phonex,
  CASE WHEN length(mr.k) <= 6 THEN mr.k ELSE mr.k[1:3] || mr.k[length(mr.k) - 2:] END AS mra,
  CASE WHEN low.w IS NULL THEN NULL ELSE {soundex('low.w')} END AS soundex,
  CASE WHEN l IS NULL THEN NULL
    WHEN (contains(l, 'tz') AND contains(l, 'man')) OR regexp_matches(l, '(witz|vitz|stein|berg|feld|baum|blatt)$') OR regexp_matches(l, '^(gold|silver|rosen)') THEN 'ashkenazi'
    WHEN (NOT contains(l, 'sch') AND (contains(l, 'sz') OR contains(l, 'cz'))) OR regexp_matches(l, '(ski|ska|icz|iak)$') THEN 'polish'
    WHEN regexp_matches(l, '(ov|ev|ova|eva|enko)$') OR contains(l, 'kh') OR contains(l, 'zh') THEN 'russian'
    WHEN contains(l, 'sch') OR regexp_matches(l, '(burg|dorf|mann|meier|mayer)$') OR (contains(l, 'ei') AND contains(l, 'er')) THEN 'german'
    WHEN regexp_matches(l, '(eau|eux|ault|ois|ais)$') OR (contains(l, 'ou') AND l LIKE '%er') OR l LIKE 'de %' OR l LIKE 'le %' THEN 'french'
    WHEN regexp_matches(l, '(ini|elli|etti|ucci|acci|otti|ano)$') OR l LIKE '%__ino' OR regexp_matches(l, '[^\\x00-\\x7f]ino$') THEN 'italian'
    WHEN regexp_matches(l, '(ez|az|ero)$') OR (contains(l, 'll') AND regexp_matches(l, '[ao]$')) THEN 'spanish'
    WHEN regexp_matches(l, '(ões|ães|eira|eiro)$') OR contains(l, 'lh') OR (contains(l, 'nh') AND NOT contains(l, 'nho')) THEN 'portuguese'
    WHEN regexp_matches(l, '(tion|ght|ley|ton|son|ham)$') OR (contains(l, 'th') AND contains(l, 'er')) THEN 'english' ELSE 'generic' END AS language
FROM low LEFT JOIN mp USING (w) LEFT JOIN d1 USING (w) LEFT JOIN d2 USING (w) LEFT JOIN co USING (w) LEFT JOIN ny5 USING (w) LEFT JOIN cv0 USING (w) LEFT JOIN cv3 USING (w) LEFT JOIN px2 USING (w) LEFT JOIN mr USING (w)"""


# --- normalisers ---------------------------------------------------------------------------------------------------------------
def _list(words: Sequence[str]) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in table.items()) + "}"


def _without(x: str, words: Sequence[str]) -> str:
    return joined(f"list_filter({tokens(x)}, lambda w: NOT list_contains({_list(words)}, lower(w)))", " ")


def _by_word(x: str, table: dict[str, str]) -> str:
    return joined(f"list_transform({tokens(x)}, lambda w: coalesce({_map(table)}[lower(w)], w))", " ")


def _by_letter(x: str, table: dict[str, str]) -> str:
    return joined(f"list_transform(string_split({x}, ''), lambda w: coalesce({_map(table)}[w], w))")


def both_cases(table: dict[str, str]) -> dict[str, str]:
    return table | {k.upper(): v[:1].upper() + v[1:] for k, v in table.items()}


def normalisers(c: str) -> dict[str, str]:
    """Expressions over a column ``c``, by operation."""
    low = f"lower({c})"
    flipped = f"CASE WHEN contains({low}, ',') THEN regexp_replace(substr({low}, instr({low}, ',') + 1), '^[{WS}]+|[{WS}]+$', '', 'g') || ' ' || regexp_replace(substr({low}, 1, instr({low}, ',') - 1), '^[{WS}]+|[{WS}]+$', '', 'g') ELSE {low} END"
    local, domain = f"substr({low}, 1, instr({low}, '@') - 1)", f"substr({low}, instr({low}, '@') + 1)"
    return {
        "fold_case": low,
        "normalize_whitespace": joined(tokens(c), " "),
        "strip_punctuation": rf"regexp_replace({c}, '[!-/:-@\[-`{{-~]', '', 'g')",
        "standardize_name": _chain(low, text.NAME_PARTS),
        "normalize_unicode_nfc": f"nfc_normalize({c})",
        "remove_stop_words": _without(c, text.STOP_WORDS),
        "expand_abbreviations": _by_word(c, text.ABBREVIATIONS),
        "strip_diacritics": f"strip_accents({c})",
        "clean_name": _without(flipped, text.NAME_TITLES + text.NAME_SUFFIXES),
        "clean_address": _by_word(low, text.ADDRESS_WORDS),
        "clean_company": _without(f"regexp_replace({low}, '[&+]', 'and', 'g')", text.COMPANY_SUFFIXES),
        "normalize_email": f"CASE WHEN {domain} IN ('gmail.com', 'googlemail.com') AND contains({low}, '@') THEN replace(split_part({local}, '+', 1), '.', '') || '@gmail.com' ELSE {low} END",
        "transliterate_cyrillic": _by_letter(c, both_cases(text.CYRILLIC)),
        "transliterate_greek": _by_letter(c, both_cases(text.GREEK) | text.GREEK_LOWER_ONLY),
        "strip_bidi_marks": rf"regexp_replace({c}, '[\x{{200E}}\x{{200F}}\x{{061C}}\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}]', '', 'g')",
        "strip_arabic_diacritics": rf"regexp_replace({c}, '[\x{{0640}}\x{{064B}}-\x{{065F}}\x{{0670}}]', '', 'g')",
        "normalize_arabic": f"translate({c}, 'آأإة', 'اااه')",
        "fold_case_turkish": f"lower(translate({c}, 'Iİ', 'ıi'))",
    }


def scripts(c: str) -> dict[str, str]:
    """Expressions for scripts whose letters stand alone, and for addresses; names hold no letters of the syllabic scripts."""
    return {
        "strip_hebrew_diacritics": rf"regexp_replace({c}, '[\x{{05B0}}-\x{{05BD}}\x{{05BF}}\x{{05C1}}\x{{05C2}}\x{{05C4}}\x{{05C5}}\x{{05C7}}\x{{0591}}-\x{{05AF}}]', '', 'g')",
        "transliterate_arabic": _by_letter(rf"regexp_replace({c}, '[\x{{0640}}\x{{064B}}-\x{{065F}}\x{{0670}}]', '', 'g')", text.ARABIC),
        "transliterate_hebrew": _by_letter(rf"regexp_replace({c}, '[\x{{0591}}-\x{{05C7}}]', '', 'g')", text.HEBREW),
        "normalize_url": f"CASE WHEN contains({c}, '://') THEN NULL ELSE lower(regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')) END",
    }


# --- sequential clustering -------------------------------------------------------------------------------------------------------
def incremental(source: str, threshold: float) -> str:
    """CTEs ending in ``inc`` (g, k, o, v, cluster, is_new, similarity): the k-th value of a group joins the cluster whose first
    value is most alike (the oldest of equal ones) at ``threshold`` or more, else it opens one."""
    return f"""
WITH RECURSIVE it AS (SELECT g, o, v, row_number() OVER (PARTITION BY g ORDER BY o, v) AS r FROM ({source}) WHERE v IS NOT NULL),
vals AS (SELECT DISTINCT g, v FROM it), jp AS (SELECT DISTINCT a.v AS x, b.v AS y FROM vals a JOIN vals b USING (g)), {JARO},
near AS (SELECT x AS v, map_from_entries(list((y, CASE WHEN x = '' AND y = '' THEN 1.0 ELSE jw END))) AS sims FROM ja GROUP BY x),
inc AS (
  SELECT g, 0::BIGINT AS k, NULL::BIGINT AS o, NULL::VARCHAR AS v, []::VARCHAR[] AS reps, NULL::INT AS cluster, NULL::BOOLEAN AS is_new, NULL::DOUBLE AS similarity FROM it GROUP BY g
  UNION ALL
  SELECT g, k, o, v, CASE WHEN top >= {threshold} AND top > 0 THEN reps ELSE list_append(reps, v) END, CAST(CASE WHEN top >= {threshold} AND top > 0 THEN list_position(scores, top) - 1 ELSE len(reps) END AS INT),
    NOT coalesce(top >= {threshold} AND top > 0, false), CASE WHEN top >= {threshold} AND top > 0 THEN top ELSE 1.0 END
  FROM (SELECT *, list_max(scores) AS top FROM (
    SELECT inc.g, inc.k + 1 AS k, it.o, it.v, inc.reps, list_transform(inc.reps, lambda q: near.sims[q]) AS scores FROM inc JOIN it ON it.g = inc.g AND it.r = inc.k + 1 JOIN near ON near.v = it.v)))"""


# --- tokenisers ----------------------------------------------------------------------------------------------------------------
def tokenisers(c: str, cjk: str) -> dict[str, str]:
    """List expressions over a text column ``c``; ``cjk`` is a class body of this dialect."""
    grams = lambda x: f"list_transform(range(1, greatest(len({x}) - 1, 0) + 1), lambda i: {x}[i] || {x}[i + 1])"
    only = f"regexp_extract_all({c}, '[{cjk}]')"
    run = "regexp_extract_all(r, '.')"
    return {
        "whitespace": f"regexp_extract_all({c}, '[^{WS}]+')",
        "character": f"regexp_extract_all({c}, '[^{WS}]')",
        "smart": f"regexp_extract_all({c}, '[{cjk}]|[^{cjk}{WS}]+')",
        "ngram": f"list_transform(range(1, greatest(length({c}) - 1, 0) + 1), lambda i: substr({c}, i, 2))",
        "cjk_ngram": grams(only),
        "smart_ngram": f"flatten(list_transform(regexp_extract_all({c}, '[{cjk}]+|[^{cjk}{WS}]+'), lambda r: CASE WHEN NOT regexp_matches(r, '[{cjk}]') THEN [r] WHEN length(r) = 1 THEN [r] ELSE {grams(run)} END))",
    }


def class_body(java: str) -> str:
    """A Java class body in this dialect: code points as \\x{...}."""
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: rf"\x{{{m[1]}}}", java)
