"""Queries of the core library, each over whole tables, with the SQL that checks it where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom import goldens, oracles
from kinloom.functions import phonetic, registry, similarity as sim, text, tokenizers as tok
from kinloom.operators import blocking, clustering, evaluation, keyed, matching, search, training
from kinloom.plans.linkage import Linkage
from kinloom.session import scratch_dir
from kinloom.sources import io
from kinloom.streaming import matching as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def _customer(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))


def _supplier(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))


# --- scalar functions ------------------------------------------------------------------------------------------------------
_LEV = "(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1.0 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"


def lev_sql(a: str, b: str) -> str:
    return _LEV.format(a=a, b=b)


def _grams(x: str, n: int = 2) -> str:
    return f"list_transform(range(1, greatest(length({x}) - {n - 1}, 0) + 1), lambda i: substr({x}, i, {n}))"


def _toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


_AB = "SELECT p_partkey AS id, p_name AS a, lower(p_type) || ' ' || lower(p_brand) || ' ' || p_name AS b FROM part"


def _ab(spark: SparkSession, sf: str) -> DataFrame:
    p = _read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), F.concat_ws(" ", F.lower("p_type"), F.lower("p_brand"), "p_name").alias("b"))


@query(f"""
SELECT id, levenshtein(a, b) AS lev, {lev_sql('a', 'b')} AS lev_sim, CASE WHEN levenshtein(a, b) <= 18 THEN levenshtein(a, b) END AS lev_18,
       CASE WHEN length(a) = length(b) THEN 1.0 - hamming(a, b)::DOUBLE / length(a) ELSE 0.0 END AS hamming_sim
FROM ({_AB})""")
def fn_edit(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _ab(spark, sf).select("id", sim.levenshtein(a, b).alias("lev"), sim.levenshtein_similarity(a, b).alias("lev_sim"), sim.levenshtein_threshold(a, b, 18).alias("lev_18"), sim.hamming_similarity(a, b).alias("hamming_sim"))


@query(f"""
WITH g AS (SELECT id, {_grams('a')} AS x, {_grams('b')} AS y, {_grams('a', 3)} AS x3, {_grams('b', 3)} AS y3, {_toks('a')} AS s, {_toks('b')} AS t FROM ({_AB})),
k AS (SELECT *, list_distinct(list_concat(x, y)) AS u FROM g)
SELECT id,
  round(list_sum(list_transform(u, lambda q: len(list_filter(x, lambda z: z = q)) * len(list_filter(y, lambda z: z = q))))
    / (sqrt(list_sum(list_transform(list_distinct(x), lambda q: len(list_filter(x, lambda z: z = q)) ** 2))) * sqrt(list_sum(list_transform(list_distinct(y), lambda q: len(list_filter(y, lambda z: z = q)) ** 2)))), 9) AS cosine,
  round(2.0 * list_sum(list_transform(u, lambda q: least(len(list_filter(x, lambda z: z = q)), len(list_filter(y, lambda z: z = q))))) / (len(x) + len(y)), 9) AS dice,
  round(len(list_intersect(s, t))::DOUBLE / len(list_distinct(list_concat(s, t))), 9) AS jaccard,
  round(len(list_intersect(x3, y3))::DOUBLE / len(list_distinct(list_concat(x3, y3))), 9) AS ngram3
FROM k""")
def fn_sets(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _ab(spark, sf).select("id", *[F.round(f, 9).alias(n) for n, f in (("cosine", sim.cosine(a, b)), ("dice", sim.sorensen_dice(a, b)), ("jaccard", sim.jaccard(a, b)), ("ngram3", sim.ngram_similarity(a, b, 3)))])


@query(f"""
WITH g AS (SELECT id, a, b, {_toks('a')} AS s, {_toks('b')} AS t FROM ({_AB})),
j AS (SELECT id, a, b, list_aggregate(list_sort(s), 'string_agg', ' ') AS ss, list_aggregate(list_sort(t), 'string_agg', ' ') AS tt,
  coalesce(list_aggregate(list_sort(list_intersect(s, t)), 'string_agg', ' '), '') AS i,
  coalesce(list_aggregate(list_sort(list_filter(list_distinct(s), lambda q: NOT list_contains(t, q))), 'string_agg', ' '), '') AS ra,
  coalesce(list_aggregate(list_sort(list_filter(list_distinct(t), lambda q: NOT list_contains(s, q))), 'string_agg', ' '), '') AS rb FROM g),
c AS (SELECT *, trim(i || ' ' || ra) AS ca, trim(i || ' ' || rb) AS cb FROM j)
SELECT id, {lev_sql('ss', 'tt')} AS token_sort, greatest({lev_sql('i', 'ca')}, {lev_sql('i', 'cb')}, {lev_sql('ca', 'cb')}) AS token_set,
  list_max(list_transform(range(1, length(b) - length(a) + 2), lambda k: 1.0 - levenshtein(a, substr(b, k, length(a)))::DOUBLE / length(a))) AS partial
FROM c""")
def fn_tokens(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _ab(spark, sf).select("id", sim.token_sort_ratio(a, b).alias("token_sort"), sim.token_set_ratio(a, b).alias("token_set"), sim.partial_ratio(a, b).alias("partial"))


_SHORT = ("damerau_levenshtein", "jaro", "jaro_winkler", "weighted_levenshtein", "lcs", "longest_common_substring", "smith_waterman", "needleman_wunsch", "gotoh", "ratcliff_obershelp", "monge_elkan", "phonetic_hybrid")


def _rounded(names) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


@query(f"WITH RECURSIVE {oracles.alignments(_AB)} SELECT id, CAST(osa AS INT) AS osa, CAST(osa AS INT) AS osa_within, {_rounded(_SHORT)} FROM m")
def fn_alignment(spark, sf):
    """Batched dynamic programs on every pair of part name and description."""
    a, b = F.col("a"), F.col("b")
    return _ab(spark, sf).select("id", sim.damerau_levenshtein(a, b).alias("osa"), sim.damerau_levenshtein_threshold(a, b, 10_000).alias("osa_within"), *[F.round(sim.METRICS[n](a, b), 9).alias(n) for n in _SHORT])


@query("""
SELECT id, CASE WHEN la = 0 AND lb = 0 THEN 1.0 ELSE 2.0 * n / (la + lb) END AS substring_sim FROM (
  SELECT id, length(a) AS la, length(b) AS lb,
    coalesce(list_max(list_transform(range(1, length(a) + 1), lambda i: list_max(list_transform(range(1, length(a) - i + 2), lambda k: CASE WHEN contains(b, substr(a, i, k)) THEN k ELSE 0 END)))), 0) AS n
  FROM (""" + _AB + "))")
def fn_substring(spark, sf):
    return _ab(spark, sf).select("id", sim.longest_common_substring_similarity(F.col("a"), F.col("b")).alias("substring_sim"))


@query(oracles.align_ops(_AB))
def fn_align_ops(spark, sf):
    r = sim.levenshtein_align(F.col("a"), F.col("b"))
    return _ab(spark, sf).select("id", r.alias("r")).select("id", "r.ops", "r.distance", "r.visual")


_NATIONS = "SELECT a.n_name || '|' || b.n_name AS id, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_name < b.n_name"


@query(f"WITH RECURSIVE {oracles.alignments(_NATIONS)} SELECT a, b, u.metric, round(u.score, 9) AS score FROM m, LATERAL (SELECT unnest([{', '.join(chr(123) + f"'metric': '{n}', 'score': {n}" + chr(125) for n in oracles.METRICS)}]) AS u)")
def fn_explain(spark, sf):
    """All 21 metrics for every pair of nation names."""
    n = _read(spark, sf, "nation")
    pairs = n.select(F.col("n_name").alias("a")).join(n.select(F.col("n_name").alias("b")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.explode(sim.explain(F.col("a"), F.col("b"))).alias("metric", "score")).withColumn("score", F.round("score", 9))


_PRESETS = {n: " + ".join(f"{w} * {'token_sort' if m == 'token_sort' else m}" for m, w in c) for n, c in sim.CompositeScorer.PRESETS.items()}


@query(f"WITH RECURSIVE {oracles.alignments(_AB)} SELECT id, {', '.join(f'round({x}, 9) AS {n}' for n, x in _PRESETS.items())} FROM m")
def fn_composite(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _ab(spark, sf).select("id", *[F.round(f()(a, b), 9).alias(f.__name__) for f in (sim.name_matching, sim.address_matching, sim.general_purpose)])


_FULL_NAME = "SELECT id, CASE WHEN first_name IS NULL AND last_name IS NULL THEN '' ELSE concat_ws(' ', first_name, last_name) END AS {0} FROM people"
_CODES = ("metaphone", "nysiis", "caverphone", "cologne_phonetic", "phonex", "mra", "soundex")


@query(oracles.phonetic(_FULL_NAME.format("v")))
def fn_phonetic(spark, sf):
    """The codes of every person's names that follow from rules of one word."""
    p = _read(spark, sf, "people")
    c = F.concat_ws(" ", "first_name", "last_name")
    dm = phonetic.double_metaphone(c)
    return p.select("id", *[phonetic.encode(c, n).alias(n) for n in _CODES], dm["primary"].alias("dm1"), dm["alternate"].alias("dm2"), phonetic.detect_language(c).alias("language"))


@query()
def fn_phonetic_branching(spark, sf):
    """Codes with several readings, for every person's names."""
    c = F.concat_ws(" ", "first_name", "last_name")
    return _read(spark, sf, "people").select("id", phonetic.encode(c, "daitch_mokotoff").alias("daitch_mokotoff"), phonetic.encode(c, "beider_morse").alias("beider_morse"))


@query(r"""
WITH w AS (SELECT id, upper(regexp_replace(coalesce(last_name, ''), '[^A-Za-z]', '', 'g')) AS s, last_name FROM people),
c AS (SELECT id, last_name, s, s[1] AS h, translate(s[1] || regexp_replace(substr(s, 2), '[HW]', '', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556') AS k FROM w)
SELECT id, CASE WHEN last_name IS NULL THEN NULL WHEN s = '' THEN '0000'
  ELSE rpad(substr(h || coalesce(list_aggregate(list_filter(list_transform(range(2, length(k) + 1), lambda i: CASE WHEN k[i] <> k[i - 1] AND k[i] BETWEEN '1' AND '6' THEN k[i] END), lambda z: z IS NOT NULL), 'string_agg', ''), ''), 1, 4), 4, '0') END AS soundex
FROM c""")
def fn_soundex(spark, sf):
    return _read(spark, sf, "people").select("id", phonetic.soundex(F.col("last_name")).alias("soundex"))


@query(r"""
SELECT id, lower(last_name) AS folded, regexp_replace(last_name, '[!-/:-@\[-`{-~]', '', 'g') AS bare,
  CASE WHEN last_name IS NOT NULL THEN coalesce(list_aggregate(list_filter(regexp_split_to_array(last_name, '[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda t: t <> ''), 'string_agg', ' '), '') END AS spaced
FROM people""")
def fn_text_basic(spark, sf):
    c = F.col("last_name")
    return _read(spark, sf, "people").select("id", text.fold_case(c).alias("folded"), text.strip_punctuation(c).alias("bare"), text.normalize_whitespace(c).alias("spaced"))


@query(r"""
WITH u AS (SELECT doc_id, trim(url) AS u FROM documents WHERE url IS NOT NULL),
p AS (SELECT doc_id, u, lower(split_part(u, '://', 1)) AS scheme, regexp_replace(substr(u, instr(u, '://') + 3), '#.*$', '') AS rest FROM u),
h AS (SELECT *, regexp_extract(rest, CASE WHEN contains(rest, '/') THEN '^[^/]*' ELSE '^[^?]*' END) AS host FROM p),
q AS (SELECT *, substr(rest, length(host) + 1) AS tail FROM h)
SELECT doc_id, CASE WHEN NOT contains(u, '://') THEN lower(u) ELSE
  scheme || '://' || regexp_replace(CASE scheme WHEN 'http' THEN regexp_replace(lower(host), ':80$', '') WHEN 'https' THEN regexp_replace(lower(host), ':443$', '') ELSE lower(host) END, '^www\.', '')
  || regexp_replace(split_part(tail, '?', 1), '/+$', '')
  || CASE WHEN contains(tail, '?') AND substr(tail, instr(tail, '?') + 1) <> '' THEN '?' || list_aggregate(list_sort(string_split(substr(tail, instr(tail, '?') + 1), '&')), 'string_agg', '&') ELSE '' END END AS url
FROM q""")
def fn_normalize_url(spark, sf):
    return _read(spark, sf, "documents").filter("url is not null").select("doc_id", text.normalize_url(F.col("url")).alias("url"))


_NORMAL = oracles.normalisers("c")


@query(f"SELECT id, {', '.join(f'{x} AS {n}' for n, x in _NORMAL.items())} FROM ({_FULL_NAME.format('c')})")
def fn_text_clean(spark, sf):
    """Normalisers on every name, empty ones included."""
    c = F.concat_ws(" ", "first_name", "last_name")
    return _read(spark, sf, "people").select("id", *[text.OPERATIONS[n](c).alias(n) for n in _NORMAL])


_SCRIPTS = oracles.scripts("c")


@query(f"SELECT id, {', '.join(f'{x} AS {n}' for n, x in _SCRIPTS.items())} FROM ({_FULL_NAME.format('c')})")
def fn_text_scripts(spark, sf):
    """Normalisers of scripts and addresses on every name."""
    c = F.concat_ws(" ", "first_name", "last_name")
    return _read(spark, sf, "people").select("id", *[text.OPERATIONS[n](c).alias(n) for n in _SCRIPTS])


@query()
def fn_text_forms(spark, sf):
    """The compatibility forms of every name, for which this SQL has no function."""
    c = F.concat_ws(" ", "first_name", "last_name")
    return _read(spark, sf, "people").select("id", *[f(c).alias(n) for n, f in text.OPERATIONS.items() if n not in _NORMAL and n not in _SCRIPTS])


_LETTERS = "regexp_replace(coalesce(text, ''), '[^a-zA-Z]+', ' ', 'g')"


@query(f"SELECT doc_id, len({oracles.tokens('t')}) AS words, len({oracles.tokens('bare')}) AS content_words, md5(bare) AS content FROM (SELECT doc_id, t, {oracles._without('t', text.STOP_WORDS)} AS bare FROM (SELECT doc_id, {_LETTERS} AS t FROM documents))")
def fn_word_count(spark, sf):
    """White-space tokens of the letters of every text, and what is left without stop words."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]+", " ")
    d = _read(spark, sf, "documents").select("doc_id", t.alias("t"), text.remove_stop_words(t).alias("bare"))
    return d.select("doc_id", F.size(tok.whitespace_tokenize(F.col("t"))).alias("words"), F.size(tok.whitespace_tokenize(F.col("bare"))).alias("content_words"), F.md5("bare").alias("content"))


_TOKENS = oracles.tokenisers("text", oracles.class_body(tok.CJK))


@query(f"SELECT doc_id, {', '.join(f'len({x}) AS n_{n}, md5({oracles.joined(x, chr(31))}) AS {n}' for n, x in _TOKENS.items())}, regexp_matches(text, '[{oracles.class_body(tok.CJK)}]') AS has_cjk FROM documents WHERE text IS NOT NULL")
def fn_tokenizers(spark, sf):
    """Number and hash of the tokens of every text, by tokeniser."""
    c = F.col("text")
    made = _read(spark, sf, "documents").filter("text is not null").select("doc_id", tok.is_cjk(c).alias("has_cjk"), *[f(c).alias(n) for n, f in tok.TOKENIZERS.items()])
    return made.select("doc_id", "has_cjk", *[f for n in tok.TOKENIZERS for f in (F.size(n).cast("long").alias(f"n_{n}"), F.md5(F.array_join(n, chr(31))).alias(n))])


@query(goldens.sql())
def fn_known_results(spark, sf):
    """Known results of every scalar function, edge cases included."""
    return goldens.results(spark)


# --- blocking ----------------------------------------------------------------------------------------------------------------
def _pairs(df: DataFrame) -> DataFrame:
    return df.select("left_id", "right_id")


@query("SELECT a.p_partkey AS left_id, b.p_partkey AS right_id FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey < b.p_partkey", "block_exact")
def _(spark, sf):
    return _pairs(blocking.exact(_part(spark, sf), None, "name"))


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "probe_people").select("id", "first_name", "last_name")


_CAPITALS = "upper(regexp_replace(last_name, '[^A-Za-z]', '', 'g'))"


@query(f"""
WITH l AS (SELECT id, {oracles.soundex('w')} AS k FROM (SELECT id, {_CAPITALS} AS w FROM probe_people WHERE last_name IS NOT NULL)), r AS (SELECT id, {oracles.soundex('w')} AS k FROM (SELECT id, {_CAPITALS} AS w FROM people WHERE last_name IS NOT NULL))
SELECT l.id AS left_id, r.id AS right_id FROM l JOIN r USING (k)""")
def block_phonetic(spark, sf):
    return _pairs(blocking.phonetic_code(_probes(spark, sf), _read(spark, sf, "people").select("id", "last_name"), "last_name", "soundex"))


@query("""
SELECT least(id, nxt) AS left_id, greatest(id, nxt) AS right_id FROM (
  SELECT p_partkey AS id, unnest([lead(p_partkey, 1) OVER w, lead(p_partkey, 2) OVER w]) AS nxt FROM part WINDOW w AS (ORDER BY lower(p_name), p_partkey)) WHERE nxt IS NOT NULL""")
def block_sorted_neighborhood(spark, sf):
    return _pairs(blocking.sorted_neighborhood(_part(spark, sf), None, "name", 3))


def _gram_counts(table: str) -> str:
    x = "lower(last_name)"
    return f"SELECT id, g, count(*) AS n FROM (SELECT id, unnest(CASE WHEN length({x}) < 3 THEN [{x}] ELSE {_grams(x, 3)} END) AS g FROM {table} WHERE last_name IS NOT NULL) GROUP BY ALL"


@query(f"WITH l AS ({_gram_counts('probe_people')}), r AS ({_gram_counts('people')}) SELECT l.id AS left_id, r.id AS right_id FROM l JOIN r USING (g) GROUP BY ALL HAVING sum(l.n * r.n) >= 4")
def block_qgram_link(spark, sf):
    """Every probe with all people whose last names share four q-grams."""
    return _pairs(blocking.qgram(_probes(spark, sf), _read(spark, sf, "people").select("id", "last_name"), "last_name", 3, 4))


@query(f"WITH s AS ({_gram_counts('probe_people')}) SELECT a.id AS left_id, b.id AS right_id FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL HAVING sum(a.n * b.n) >= 2")
def block_qgram(spark, sf):
    return _pairs(blocking.qgram(_probes(spark, sf), None, "last_name", 3, 2))


@query(f"""
WITH d AS (SELECT doc_id AS id, lower(url) AS u FROM documents WHERE url <> ''), s AS (SELECT id, list_sort(list_distinct(CASE WHEN length(u) < 3 THEN [u] ELSE {_grams('u', 3)} END)) AS g FROM d)
SELECT a.id AS left_id, b.id AS right_id FROM s a JOIN s b ON a.id < b.id AND least(len(a.g), len(b.g)) >= 0.8 * greatest(len(a.g), len(b.g)) WHERE len(list_intersect(a.g, b.g)) >= 0.8 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))""")
def block_lsh(spark, sf):
    """Pages whose urls have a Jaccard similarity of 0.8 or more: MinHash bands find candidates, the similarity is verified."""
    d = _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "url")
    low = F.lower("url")
    grams = F.array_distinct(F.when(F.length(low) < 3, F.array(low)).otherwise(tok.ngram_tokenize(low, 3)))
    side = lambda n: d.select(F.col("id").alias(f"{n}_id"), grams.alias(n))
    both = F.size(F.array_intersect("left", "right"))
    met = blocking.lsh(d, None, "url").join(side("left"), "left_id").join(side("right"), "right_id")
    return _pairs(met.filter(both >= 0.8 * (F.size("left") + F.size("right") - both)))


@query(f"""
WITH RECURSIVE it AS (SELECT s_nationkey AS g, s_suppkey AS id, s_name AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
jp AS (SELECT DISTINCT a.v AS x, b.v AS y FROM it a JOIN it b USING (g)), {oracles.JARO},
sims AS (SELECT a.g, a.r AS p, b.r AS q, jw FROM it a JOIN it b USING (g) JOIN ja ON x = a.v AND y = b.v),
go AS (
  SELECT g, 0::BIGINT AS k, max(n) AS n, []::BIGINT[] AS gone, []::BIGINT[] AS members FROM it GROUP BY g
  UNION ALL
  SELECT g, k + 1, n, CASE WHEN skip THEN gone ELSE list_concat(gone, tight) END, CASE WHEN skip THEN [] ELSE loose END FROM (
    SELECT go.g, go.k, go.n, go.gone, list_contains(go.gone, go.k + 1) AS skip, coalesce(list(q) FILTER (jw >= 0.97 OR q = k + 1), []) AS tight, coalesce(list(q) FILTER (jw >= 0.95 OR q = k + 1), []) AS loose
    FROM go JOIN sims ON sims.g = go.g AND sims.p = go.k + 1 AND sims.q >= go.k + 1 AND NOT list_contains(go.gone, sims.q) OR (sims.g = go.g AND sims.p = go.k + 1 AND sims.q = go.k + 1) WHERE go.k < go.n GROUP BY ALL)),
canopy AS (SELECT g, k, unnest(members) AS r FROM go)
SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM canopy x JOIN canopy y ON x.g = y.g AND x.k = y.k AND x.r < y.r JOIN it a ON a.g = x.g AND a.r = x.r JOIN it b ON b.g = y.g AND b.r = y.r""")
def block_canopy(spark, sf):
    s = _supplier(spark, sf)
    return _pairs(blocking.canopy(s, None, "name", 0.97, 0.95, "jaro_winkler", coarse="nation"))


@query("""
SELECT a.s_suppkey AS left_id, b.s_suppkey AS right_id FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND abs(floor(a.s_acctbal / 50) - floor(b.s_acctbal / 50)) <= 1""")
def block_numeric(spark, sf):
    return _pairs(blocking.numeric(_supplier(spark, sf), None, "balance", 50.0))


@query("""
WITH d AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS d, o_custkey AS c FROM orders)
SELECT a.id AS left_id, b.id AS right_id FROM d a JOIN d b ON a.d = b.d AND a.id < b.id""")
def block_date(spark, sf):
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return _pairs(blocking.date(o, None, "date", "day"))


@query("""
WITH p AS (SELECT s_suppkey AS id, substr(s_name, 1, k) AS pre FROM supplier, range(2, 40) t(k) WHERE k <= length(s_name)),
rare AS (SELECT pre FROM p GROUP BY pre HAVING count(*) <= 20)
SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM p a JOIN rare USING (pre) JOIN p b ON a.pre = b.pre AND a.id < b.id""")
def block_trie(spark, sf):
    return _pairs(blocking.trie(_supplier(spark, sf), None, "name", 2, 20))


@query("""
SELECT a.s_suppkey AS left_id, b.s_suppkey AS right_id FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND a.s_nationkey = b.s_nationkey AND abs(floor(a.s_acctbal / 500) - floor(b.s_acctbal / 500)) <= 1""")
def block_intersection(spark, sf):
    s = _supplier(spark, sf)
    return _pairs(blocking.intersection([blocking.exact(s, None, "nation"), blocking.numeric(s, None, "balance", 500.0)]))


@query("""
SELECT a.s_suppkey AS left_id, b.s_suppkey AS right_id FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND (a.s_nationkey = b.s_nationkey OR abs(floor(a.s_acctbal / 50) - floor(b.s_acctbal / 50)) <= 1)""")
def block_union(spark, sf):
    s = _supplier(spark, sf)
    return _pairs(blocking.union([blocking.exact(s, None, "nation"), blocking.numeric(s, None, "balance", 50.0)]))


# --- linkage plans -------------------------------------------------------------------------------------------------------------
def _flat(df: DataFrame, n: int) -> DataFrame:
    return df.select("left_id", "right_id", F.round("score", 9).alias("score"), "match_class", *[F.round(F.col("scores")[i], 9).alias(f"s{i}") for i in range(n)])


@query(f"""
SELECT * FROM (SELECT a.p_partkey AS left_id, b.p_partkey AS right_id, round({lev_sql('lower(a.p_name)', 'lower(b.p_name)')}, 9) AS score, 'match' AS match_class,
  round({lev_sql('lower(a.p_name)', 'lower(b.p_name)')}, 9) AS s0 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey) WHERE score >= 0.7""")
def linkage_dedup_part(spark, sf):
    plan = Linkage().preprocess("name", ["fold_case"]).block_exact("brand").compare_string("name", "levenshtein").classify_threshold(0.7)
    return _flat(plan.dedup(_part(spark, sf)), 1)


_BANDED = f"""
SELECT left_id, right_id, round((s0 + s1 + s2) / 3, 9) AS score, CASE WHEN (s0 + s1 + s2) / 3 >= 0.8 THEN 'match' ELSE 'possible' END AS match_class, round(s0, 9) AS s0, round(s1, 9) AS s1, round(s2, 9) AS s2 FROM (
  SELECT a.s_suppkey AS left_id, b.c_custkey AS right_id, {lev_sql('a.s_name', 'b.c_name')} AS s0, greatest(0.0, 1 - abs(a.s_acctbal - b.c_acctbal) / 500) AS s1, CASE WHEN a.s_nationkey = b.c_nationkey THEN 1.0 ELSE 0.0 END AS s2
  FROM supplier a JOIN customer b ON a.s_nationkey = b.c_nationkey) WHERE (s0 + s1 + s2) / 3 >= 0.7"""


@query(_BANDED)
def linkage_link_banded(spark, sf):
    plan = Linkage().block_exact("nation").compare_string("name", "levenshtein").compare_numeric("balance", 500.0).compare_exact("nation").classify_threshold_bands(0.8, 0.7)
    return _flat(plan.link(_supplier(spark, sf), _customer(spark, sf)), 3)


@query("""
SELECT left_id, right_id, round(0.6 * s0 + 0.4 * s1, 9) AS score, 'match' AS match_class, round(s0, 9) AS s0, round(s1, 9) AS s1 FROM (
  SELECT a.o_orderkey AS left_id, b.o_orderkey AS right_id,
    CASE WHEN a.d = b.d THEN 1.0 ELSE 0.4 * (year(a.o_orderdate) = year(b.o_orderdate))::INT + 0.3 * (month(a.o_orderdate) = month(b.o_orderdate))::INT + 0.3 * (day(a.o_orderdate) = day(b.o_orderdate))::INT END AS s0,
    greatest(0.0, 1 - abs(a.o_totalprice - b.o_totalprice) / 10000) AS s1
  FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) a JOIN (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey)
WHERE 0.6 * s0 + 0.4 * s1 >= 0.5""")
def linkage_weighted_orders(spark, sf):
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").alias("price"))
    return _flat(Linkage().block_exact("customer").compare_date("date").compare_numeric("price", 10000.0).classify_weighted([0.6, 0.4], 0.5).dedup(o), 2)


@query("""
WITH v AS (SELECT a.p_partkey AS left_id, b.p_partkey AS right_id, CASE WHEN a.p_type = b.p_type THEN 1.0 ELSE 0.0 END AS s0, CASE WHEN a.p_brand = b.p_brand THEN 1.0 ELSE 0.0 END AS s1, greatest(0.0, 1 - abs(a.p_size - b.p_size) / 10.0) AS s2
  FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey < b.p_partkey),
w AS (SELECT *, CASE WHEN s0 >= 0.5 THEN ln(0.9 / 0.2) ELSE ln((1 - 0.9) / (1 - 0.2)) END + CASE WHEN s1 >= 0.5 THEN ln(0.8 / 0.1) ELSE ln((1 - 0.8) / (1 - 0.1)) END + CASE WHEN s2 >= 0.5 THEN ln(0.9 / 0.3) ELSE ln((1 - 0.9) / (1 - 0.3)) END AS t FROM v)
SELECT left_id, right_id, round(t, 9) AS score, CASE WHEN t >= 3 THEN 'match' ELSE 'possible' END AS match_class, s0, s1, round(s2, 9) AS s2 FROM w WHERE t > 0""")
def linkage_fellegi_sunter(spark, sf):
    plan = Linkage().block_exact("name").compare_exact("type").compare_exact("brand").compare_numeric("size", 10.0).classify_fellegi_sunter([0.9, 0.8, 0.9], [0.2, 0.1, 0.3], 3.0, 0.0)
    return _flat(plan.dedup(_part(spark, sf)), 3)


def _people(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "people").select("id", "first_name", "last_name", "dob", "city", F.concat_ws("|", "postcode", "dob").alias("home"))


def _clean(x: str) -> str:
    bare = r"regexp_replace(lower(@), '[!-/:-@\[-`{-~]', '', 'g')".replace("(@)", f"({x})", 1)
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE {oracles.joined(oracles.tokens(bare), ' ')} END"


_HOME = "concat_ws('|', postcode, dob)"


_FIELDS = 4
_EM_LIKE = lambda v: " * ".join(f"(CASE WHEN b[{i}] = 1 THEN {v}[{i}] ELSE 1 - {v}[{i}] END)" for i in range(1, _FIELDS + 1))
_EM_CLIP = "least(1 - 1e-6, greatest(1e-6, {0}))"
_EM_MOVED = ", ".join(f"abs(n{v}[{i}] - {v}[{i}])" for v in "mu" for i in range(1, _FIELDS + 1))


def _people_em() -> str:
    new = lambda g: ", ".join(_EM_CLIP.format(f"sum({g} * n * b[{i}]) / sum({g} * n)") for i in range(1, _FIELDS + 1))
    ratio = " + ".join(f"CASE WHEN b[{i}] = 1 THEN ln(m[{i}] / u[{i}]) ELSE ln((1 - m[{i}]) / (1 - u[{i}])) END" for i in range(1, _FIELDS + 1))
    return f"""
WITH RECURSIVE ppl AS (SELECT id, {_HOME} AS home, {_clean('first_name')} AS f, {_clean('last_name')} AS l, city FROM people),
cap AS (SELECT *, upper(regexp_replace(l, '[^A-Za-z]', '', 'g')) AS w FROM ppl), coded AS (SELECT *, CASE WHEN l IS NULL THEN NULL ELSE {oracles.soundex('w')} END AS x FROM cap),
prs AS (SELECT a.id AS p, b.id AS q, a.f AS af, b.f AS bf, a.l AS al, b.l AS bl, coalesce(a.x = b.x, false)::INT AS same_code, coalesce(a.city = b.city, false)::INT AS same_city FROM coded a JOIN coded b ON a.home = b.home AND a.id < b.id),
jp AS (SELECT af AS x, bf AS y FROM prs WHERE af IS NOT NULL AND bf IS NOT NULL UNION SELECT al, bl FROM prs WHERE al IS NOT NULL AND bl IS NOT NULL), {oracles.JARO},
jw AS (SELECT x, y, CASE WHEN x = '' AND y = '' THEN 1.0 ELSE jw END AS s FROM ja),
vec AS (SELECT p, q, [(coalesce(f.s, 0.0) >= 0.5)::INT, (coalesce(l.s, 0.0) >= 0.5)::INT, same_code, same_city] AS b FROM prs LEFT JOIN jw f ON f.x = af AND f.y = bf LEFT JOIN jw l ON l.x = al AND l.y = bl),
pat AS (SELECT b, count(*)::DOUBLE AS n FROM vec GROUP BY b),
em AS (
  SELECT 0 AS step, list_transform(range({_FIELDS}), lambda i: 0.9::DOUBLE) AS m, list_transform(range({_FIELDS}), lambda i: 0.1::DOUBLE) AS u, 0.1::DOUBLE AS p, 1.0::DOUBLE AS moved
  UNION ALL
  SELECT step + 1, nm, nu, np, greatest({_EM_MOVED}, abs(np - p)) FROM (
    SELECT step, m, u, p, [{new('g')}] AS nm, [{new('(1 - g)')}] AS nu, sum(g * n) / sum(n) AS np FROM (
      SELECT *, p * like_m / (p * like_m + (1 - p) * like_u) AS g FROM (SELECT em.*, pat.*, {_EM_LIKE('m')} AS like_m, {_EM_LIKE('u')} AS like_u FROM em, pat WHERE step < 100 AND moved >= 1e-6)) GROUP BY step, m, u, p)),
fit AS (SELECT m, u FROM em ORDER BY step DESC LIMIT 1), scored AS (SELECT vec.p, vec.q, {ratio} AS t FROM vec, fit)
SELECT p AS left_id, q AS right_id, round(t, 4) AS score, CASE WHEN t >= 4 THEN 'match' ELSE 'possible' END AS match_class FROM scored WHERE t > -4"""


@query(_people_em())
def linkage_people_em(spark, sf):
    """All people: blocked by postcode and date of birth, four comparators, m and u estimated on the candidates."""
    ops = ["fold_case", "strip_punctuation", "normalize_whitespace"]
    plan = Linkage().preprocess("first_name", ops).preprocess("last_name", ops).block_exact("home")
    plan.compare_string("first_name").compare_string("last_name").compare_phonetic("last_name").compare_exact("city").classify_fellegi_sunter_auto()
    return plan.dedup(_people(spark, sf)).select("left_id", "right_id", F.round("score", 4).alias("score"), "match_class")


@query(f"""
WITH RECURSIVE ppl AS (SELECT id, {_HOME} AS home, {_clean('first_name')} AS f, {_clean('last_name')} AS l FROM people),
prs AS (SELECT a.id AS p, b.id AS q, a.f AS af, b.f AS bf, a.l AS al, b.l AS bl FROM ppl a JOIN ppl b ON a.home = b.home AND a.id < b.id),
jp AS (SELECT af AS x, bf AS y FROM prs WHERE af IS NOT NULL AND bf IS NOT NULL UNION SELECT al, bl FROM prs WHERE al IS NOT NULL AND bl IS NOT NULL), {oracles.JARO},
jw AS (SELECT x, y, CASE WHEN x = '' AND y = '' THEN 1.0 ELSE jw END AS s FROM ja),
links AS (SELECT p AS a, q AS b FROM prs LEFT JOIN jw f ON f.x = af AND f.y = bf LEFT JOIN jw l ON l.x = al AND l.y = bl WHERE (coalesce(f.s, 0.0) + coalesce(l.s, 0.0)) / 2 >= 0.9),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
best(record_id, component) USING KEY (record_id) AS (
  SELECT a, min(least(a, b)) FROM both_ways GROUP BY a
  UNION SELECT e.b, min(r.component) FROM best AS r JOIN both_ways AS e ON e.a = r.record_id JOIN recurring.best AS old ON old.record_id = e.b WHERE r.component < old.component GROUP BY e.b)
SELECT record_id, CAST(dense_rank() OVER (ORDER BY component) - 1 AS BIGINT) AS cluster_id FROM best""")
def linkage_people_clusters(spark, sf):
    ops = ["fold_case", "strip_punctuation", "normalize_whitespace"]
    plan = Linkage().preprocess("first_name", ops).preprocess("last_name", ops).block_exact("home").compare_string("first_name").compare_string("last_name").classify_threshold(0.9).cluster_connected_components()
    return plan.dedup_cluster(_people(spark, sf))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """scores and label of the scored pairs that were decided."""
    return _read(spark, sf, "dup_pairs").filter("scores is not null and match_class in ('match', 'non_match')").select("left_id", "right_id", "scores", "score", (F.col("match_class") == "match").alias("label"))


@query("""
SELECT CAST((scores[1] >= 0.5) AS INT) AS b0, CAST((scores[2] >= 0.5) AS INT) AS b1, CAST((scores[3] >= 0.5) AS INT) AS b2, count(*) AS n FROM match_results WHERE scores IS NOT NULL GROUP BY ALL""")
def em_patterns(spark, sf):
    """Agreement patterns, the one aggregation that estimation needs."""
    x, n = training.agreement_patterns(_read(spark, sf, "match_results").filter("scores is not null"), 3)
    return spark.createDataFrame([(*(int(v) for v in row), int(c)) for row, c in zip(x, n)], "b0 int, b1 int, b2 int, n long")


_LIKE = lambda v: " * ".join(f"(CASE WHEN b{i} = 1 THEN {v}[{i + 1}] ELSE 1 - {v}[{i + 1}] END)" for i in range(3))
_CLIP = "least(1 - 1e-6, greatest(1e-6, {0}))"


@query(f"""
WITH RECURSIVE pat AS (SELECT coalesce((scores[1] >= 0.5)::INT, 0) AS b0, coalesce((scores[2] >= 0.5)::INT, 0) AS b1, coalesce((scores[3] >= 0.5)::INT, 0) AS b2, count(*)::DOUBLE AS n FROM match_results WHERE scores IS NOT NULL GROUP BY ALL),
em AS (
  SELECT 0 AS step, [0.9::DOUBLE, 0.9, 0.9] AS m, [0.1::DOUBLE, 0.1, 0.1] AS u, 0.1::DOUBLE AS p, 1.0::DOUBLE AS moved
  UNION ALL
  SELECT step + 1, nm, nu, np, greatest(abs(nm[1] - m[1]), abs(nm[2] - m[2]), abs(nm[3] - m[3]), abs(nu[1] - u[1]), abs(nu[2] - u[2]), abs(nu[3] - u[3]), abs(np - p)) FROM (
    SELECT step, m, u, p, [{', '.join(_CLIP.format(f'sum(g * n * b{i}) / sum(g * n)') for i in range(3))}] AS nm, [{', '.join(_CLIP.format(f'sum((1 - g) * n * b{i}) / sum((1 - g) * n)') for i in range(3))}] AS nu, sum(g * n) / sum(n) AS np FROM (
      SELECT *, p * like_m / (p * like_m + (1 - p) * like_u) AS g FROM (SELECT em.*, pat.*, {_LIKE('m')} AS like_m, {_LIKE('u')} AS like_u FROM em, pat WHERE step < 100 AND moved >= 1e-6)) GROUP BY step, m, u, p))
SELECT i AS field, round(m[i + 1], 6) AS m, round(u[i + 1], 6) AS u, round(p, 6) AS p_match FROM (SELECT * FROM em ORDER BY step DESC LIMIT 1), (SELECT unnest([0, 1, 2]) AS i)""")
def em_estimate(spark, sf):
    em = training.estimate_fellegi_sunter(_read(spark, sf, "match_results").filter("scores is not null"), 3)
    return spark.createDataFrame([(i, round(m, 6), round(u, 6), round(em.p_match, 6)) for i, (m, u) in enumerate(zip(em.m_probabilities, em.u_probabilities))], "field int, m double, u double, p_match double")


_DOT = "w[1] * s[1] + w[2] * s[2] + w[3] * s[3] + b"


@query(f"""
WITH RECURSIVE v AS (SELECT left_id, right_id, scores AS s, (match_class = 'match')::INT AS y FROM dup_pairs WHERE scores IS NOT NULL AND match_class IN ('match', 'non_match')),
gd AS (
  SELECT 0 AS step, [0.0::DOUBLE, 0.0, 0.0] AS w, 0.0::DOUBLE AS b, 1.0::DOUBLE AS moved
  UNION ALL
  SELECT step + 1, [w[1] - d1, w[2] - d2, w[3] - d3], b - db, greatest(abs(d1), abs(d2), abs(d3), abs(db)) FROM (
    SELECT step, w, b, {', '.join(f'0.1 * (avg(e * s[{i}]) + 0.01 * w[{i}]) AS d{i}' for i in (1, 2, 3))}, 0.1 * avg(e) AS db FROM (
      SELECT gd.*, s, 1 / (1 + exp(-({_DOT}))) - y AS e FROM gd, v WHERE step < 1000 AND moved >= 1e-6) GROUP BY step, w, b)),
fit AS (SELECT w, b FROM gd ORDER BY step DESC LIMIT 1)
SELECT left_id, right_id, round(1 / (1 + exp(-({_DOT}))), 6) AS score, CASE WHEN 1 / (1 + exp(-({_DOT}))) >= 0.5 THEN 'match' ELSE 'non_match' END AS match_class FROM v, fit""")
def train_logistic(spark, sf):
    v = _vectors(spark, sf)
    return training.predict(v.drop("score"), training.train_logistic_regression(v)).select("left_id", "right_id", F.round("score", 6).alias("score"), "match_class")


@query()
def train_tree(spark, sf):
    v = _vectors(spark, sf)
    return training.predict(v.drop("score"), training.train_decision_tree(v)).select("left_id", "right_id", "score", "match_class")


# --- clustering ------------------------------------------------------------------------------------------------------------------
_LINKS = "SELECT DISTINCT left_id AS a, right_id AS b FROM dup_pairs WHERE match_class = 'match' AND left_id IS NOT NULL AND right_id IS NOT NULL AND left_id <> right_id"
_CC = f"""
WITH RECURSIVE links AS ({_LINKS}), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
best(record_id, component) USING KEY (record_id) AS (
  SELECT a, min(least(a, b)) FROM both_ways GROUP BY a
  UNION SELECT e.b, min(r.component) FROM best AS r JOIN both_ways AS e ON e.a = r.record_id JOIN recurring.best AS old ON old.record_id = e.b WHERE r.component < old.component GROUP BY e.b)
"""


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "dup_pairs").filter("match_class = 'match' and left_id is not null and right_id is not null and left_id <> right_id and score is not null and not isnan(score)")


@query(_CC + "SELECT record_id, component FROM best")
def cluster_components(spark, sf):
    return clustering.components(_read(spark, sf, "dup_pairs").filter("match_class = 'match'"))


@query(_CC + "SELECT record_id, CAST(dense_rank() OVER (ORDER BY component) - 1 AS BIGINT) AS cluster_id FROM best")
def cluster_numbered(spark, sf):
    return clustering.connected_components(_read(spark, sf, "dup_pairs").filter("match_class = 'match'"))


def _sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of one nation with the similarity of their balances: a graph of small components."""
    s = _supplier(spark, sf)
    pairs = blocking.intersection([blocking.exact(s, None, "nation"), blocking.numeric(s, None, "balance", 100.0)])
    side = lambda n: s.select(F.col("id").alias(f"{n}_id"), F.col("balance").alias(f"{n}_b"))
    d = 1.0 - F.abs(F.col("left_b") - F.col("right_b")) / 200.0
    return pairs.join(side("left"), "left_id").join(side("right"), "right_id").select("left_id", "right_id", F.greatest(F.lit(0.0), d).alias("score"))


_SPARSE = "SELECT a.s_suppkey AS x, b.s_suppkey AS y, greatest(0.0, 1 - abs(a.s_acctbal - b.s_acctbal) / 200.0) AS s FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND a.s_nationkey = b.s_nationkey AND abs(floor(a.s_acctbal / 100) - floor(b.s_acctbal / 100)) <= 1"


@query(name="cluster_hierarchical")
def _(spark, sf):
    return clustering.hierarchical(_sparse(spark, sf), "average", 0.4)


@query(f"""
WITH RECURSIVE e AS (SELECT x, y FROM ({_SPARSE}) WHERE s >= 0.6), b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
core AS (SELECT x FROM b GROUP BY x HAVING count(*) >= 2), cc AS (SELECT b.x, b.y FROM b WHERE x IN (SELECT x FROM core) AND y IN (SELECT x FROM core)),
reach AS (SELECT x, x AS c FROM core UNION SELECT cc.y, reach.c FROM reach JOIN cc ON cc.x = reach.x), home AS (SELECT x, min(c) AS c FROM reach GROUP BY x),
placed AS (SELECT x, c FROM home UNION ALL SELECT b.y, min(home.c) FROM b JOIN home ON home.x = b.x WHERE b.y NOT IN (SELECT x FROM core) GROUP BY b.y),
num AS (SELECT c, CAST(row_number() OVER (ORDER BY c) - 1 AS INT) AS label FROM (SELECT DISTINCT c FROM home))
SELECT s_suppkey AS record_id, coalesce(label, -1) AS label FROM supplier LEFT JOIN placed ON placed.x = s_suppkey LEFT JOIN num USING (c)""")
def cluster_dbscan(spark, sf):
    return clustering.dbscan(_supplier(spark, sf), _sparse(spark, sf), 0.6, 2)


@query()
def cluster_optics(spark, sf):
    return clustering.optics(_supplier(spark, sf), _sparse(spark, sf), 2, 0.6)


@query(oracles.incremental("SELECT s_nationkey AS g, s_suppkey AS o, s_name AS v FROM supplier", 0.97) + " SELECT g AS block, o AS id, cluster, is_new, round(similarity, 9) AS similarity FROM inc WHERE k > 0")
def cluster_incremental(spark, sf):
    return clustering.incremental(_supplier(spark, sf), "name", "id", "nation", threshold=0.97).withColumn("similarity", F.round("similarity", 9))


@query("""
SELECT * FROM (VALUES ('optics', '0', 0), ('optics', '1', 0), ('optics', '2', 0), ('optics', '3', 1), ('optics', '4', 1), ('optics', '5', 1), ('optics', '6', -1),
  ('average', 'a', 0), ('average', 'b', 0), ('average', 'c', 0), ('average', 'd', 0), ('complete', 'a', 0), ('complete', 'b', 0), ('complete', 'c', 1), ('complete', 'd', 1),
  ('single', 'a', 0), ('single', 'b', 0), ('single', 'c', 0), ('single', 'd', 0)) t(algorithm, record_id, label)""")
def cluster_known_results(spark, sf):
    """Sequential clusterers on graphs whose result is worked out by hand."""
    two = spark.createDataFrame([("0", "1", 0.95), ("1", "2", 0.95), ("0", "2", 0.9), ("3", "4", 0.95), ("4", "5", 0.95), ("3", "5", 0.9)], "left_id string, right_id string, score double")
    nodes = spark.createDataFrame([(str(i),) for i in range(7)], "id string")
    chain = spark.createDataFrame([("a", "b", 0.9), ("c", "d", 0.9), ("a", "c", 0.7), ("b", "c", 0.55)], "left_id string, right_id string, score double")
    out = clustering.optics(nodes, two, 2, 0.8).select(F.lit("optics").alias("algorithm"), "record_id", "label")
    for how in ("average", "complete", "single"):
        out = out.unionByName(clustering.hierarchical(chain, how, 0.4).select(F.lit(how).alias("algorithm"), "record_id", F.col("cluster_id").cast("int").alias("label")))
    return out


@query("SELECT * FROM (VALUES (0.9, 'match'), (0.85, 'match'), (0.8, 'match'), (0.1, 'non_match'), (0.2, 'non_match'), (0.15, 'non_match'), (0.5, 'non_match'), (0.51, 'match')) t(x, match_class)")
def train_tree_known_result(spark, sf):
    """A tree that must cut its first feature midway between 0.2 and 0.8."""
    rows = [(0.9, 0.95, True), (0.85, 0.9, True), (0.8, 0.85, True), (0.1, 0.15, False), (0.2, 0.1, False), (0.15, 0.2, False)]
    df = spark.createDataFrame([([a, b], y) for a, b, y in rows], "scores array<double>, label boolean")
    tree = training.train_decision_tree(df, min_samples_leaf=1, min_samples_split=2)
    seen = df.select("scores").unionByName(spark.createDataFrame([([0.5, 0.5],), ([0.51, 0.5],)], "scores array<double>"))
    return training.predict(seen, tree).select(F.col("scores")[0].alias("x"), "match_class")


_LABELS = "SELECT s_suppkey AS n, s_nationkey AS l FROM supplier"
_DIST = f"""
lab AS ({_LABELS}), e AS ({_SPARSE}), allp AS (SELECT p.n AS n, p.l AS pl, q.n AS m, q.l AS ql, coalesce(1 - e.s, 1.0) AS d
  FROM lab p JOIN lab q ON p.n <> q.n LEFT JOIN e ON e.x = least(p.n, q.n) AND e.y = greatest(p.n, q.n))"""


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return _supplier(spark, sf).select(F.col("id").alias("record_id"), F.col("nation").alias("label"))


@query(f"""
WITH {_DIST}, m AS (SELECT n, pl, ql, avg(d) AS d FROM allp GROUP BY ALL), own AS (SELECT n, d AS a FROM m WHERE pl = ql), oth AS (SELECT n, min(d) AS b FROM m WHERE pl <> ql GROUP BY n)
SELECT round(coalesce(avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 0.0), 9) AS silhouette FROM own JOIN oth USING (n)""")
def quality_silhouette(spark, sf):
    return clustering.silhouette_score(_sparse(spark, sf), _labels(spark, sf)).select(F.round("silhouette", 9).alias("silhouette"))


@query(f"""
WITH {_DIST}, sc AS (SELECT l, coalesce(avg(d), 0.0) AS s FROM (SELECT DISTINCT l FROM lab) LEFT JOIN allp ON pl = l AND ql = l GROUP BY l),
sep AS (SELECT pl, ql, avg(d) AS d FROM allp WHERE pl <> ql GROUP BY ALL)
SELECT round(avg(r), 9) AS davies_bouldin FROM (SELECT pl, max(CASE WHEN d > 0 THEN (a.s + b.s) / d ELSE 0 END) AS r FROM sep JOIN sc a ON a.l = pl JOIN sc b ON b.l = ql GROUP BY pl)""")
def quality_davies_bouldin(spark, sf):
    return clustering.davies_bouldin_index(_sparse(spark, sf), _labels(spark, sf)).select(F.round("davies_bouldin", 9).alias("davies_bouldin"))


# --- evaluation -----------------------------------------------------------------------------------------------------------------
_TRUTH = "truth AS (SELECT DISTINCT least(left_id, right_id) AS p, greatest(left_id, right_id) AS q FROM dup_pairs WHERE match_class = 'match' AND left_id IS NOT NULL AND right_id IS NOT NULL)"
_PRED = "pred AS (SELECT DISTINCT least(left_id, right_id) AS p, greatest(left_id, right_id) AS q FROM dup_pairs WHERE score >= 0.85 AND NOT isnan(score) AND left_id IS NOT NULL AND right_id IS NOT NULL)"


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "dup_pairs").filter("match_class = 'match'")


@query(f"""
WITH {_TRUTH}, {_PRED}, c AS (SELECT count(*) FILTER (t.p IS NOT NULL AND r.p IS NOT NULL) AS tp, count(*) FILTER (t.p IS NULL) AS fp, count(*) FILTER (r.p IS NULL) AS fn FROM truth t FULL JOIN pred r USING (p, q))
SELECT tp, fp, fn, CAST(NULL AS BIGINT) AS tn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1 FROM c""")
def eval_confusion(spark, sf):
    predicted = _read(spark, sf, "dup_pairs").filter("score >= 0.85 and not isnan(score)")
    return evaluation.confusion_matrix(predicted, _truth(spark, sf))


_ROC = f"""
WITH {_TRUTH}, best AS (SELECT least(left_id, right_id) AS p, greatest(left_id, right_id) AS q, max(score) AS s FROM dup_pairs WHERE score IS NOT NULL AND NOT isnan(score) AND left_id IS NOT NULL AND right_id IS NOT NULL GROUP BY ALL),
cells AS (SELECT s, count(t.p) AS t, count(*) AS n FROM best LEFT JOIN truth t USING (p, q) GROUP BY s),
cum AS (SELECT s AS threshold, sum(t) OVER w AS tp, sum(n) OVER w - sum(t) OVER w AS fp, (SELECT count(*) FROM truth) AS pos FROM cells WINDOW w AS (ORDER BY s DESC)),
roc AS (SELECT threshold, tp, fp, pos FROM cum UNION ALL SELECT min(threshold) - 1, max(tp), max(fp), max(pos) FROM cum)
"""


@query(_ROC + "SELECT threshold, round(fp / (1000000 - pos), 9) AS fpr, round(tp / pos, 9) AS tpr FROM roc")
def eval_roc(spark, sf):
    c = evaluation.roc_curve(_read(spark, sf, "dup_pairs"), _truth(spark, sf), 1_000_000)
    return c.select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(_ROC + """, pts AS (SELECT fp / (1000000 - pos) AS x, tp / pos AS y FROM roc)
SELECT round(sum((x - px) * (y + py) / 2), 9) AS auc FROM (SELECT x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM pts WINDOW w AS (ORDER BY x, y)) WHERE px IS NOT NULL""")
def eval_auc(spark, sf):
    return evaluation.auc(evaluation.roc_curve(_read(spark, sf, "dup_pairs"), _truth(spark, sf), 1_000_000)).select(F.round("auc", 9).alias("auc"))


@query(_ROC + """, r AS (SELECT threshold, tp / (tp + fp) AS precision, tp / pos AS recall FROM cum)
SELECT threshold, f1, precision, recall FROM (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r) ORDER BY f1 DESC, threshold LIMIT 1""")
def eval_optimal_threshold(spark, sf):
    return evaluation.optimal_threshold(_read(spark, sf, "dup_pairs"), _truth(spark, sf))


@query("""
WITH v AS (SELECT score AS s, match_class = 'match' AS y FROM dup_pairs WHERE scores IS NOT NULL AND match_class IN ('match', 'non_match') AND score IS NOT NULL AND NOT isnan(score)),
b AS (SELECT min(s) AS lo, (max(s) - min(s)) / 50 AS step FROM v), g AS (SELECT lo + i * step AS threshold FROM b, range(51) t(i)),
c AS (SELECT threshold, count(*) FILTER (s >= threshold AND y) AS tp, count(*) FILTER (s >= threshold AND NOT y) AS fp, count(*) FILTER (s < threshold AND y) AS fn FROM g, v GROUP BY threshold)
SELECT round(threshold, 9) AS threshold, tp, fp, fn FROM c""")
def eval_threshold_grid(spark, sf):
    g = evaluation.threshold_grid(_vectors(spark, sf).filter("not isnan(score)"), n_thresholds=50)
    return g.select(F.round("threshold", 9).alias("threshold"), "tp", "fp", "fn")


@query(f"""
WITH p AS (SELECT a.n_nationkey AS "left", b.n_nationkey AS "right", a.n_name AS left_value, b.n_name AS right_value, {lev_sql('a.n_name', 'b.n_name')} AS score FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey)
SELECT * FROM p ORDER BY abs(score - 0.85), "left", "right" LIMIT 10""")
def active_uncertain_pairs(spark, sf):
    learner = evaluation.ActiveLearner("levenshtein", 0.85)
    learner.score_pairs(_read(spark, sf, "nation"), "n_nationkey", "n_name")
    return learner.uncertain_pairs(10)


# --- matching and search ---------------------------------------------------------------------------------------------------------
@query(f"SELECT p_partkey, p_name, {lev_sql('p_name', chr(39) + 'small ring' + chr(39))} AS score FROM part WHERE score >= 0.6 ORDER BY score DESC, p_partkey LIMIT 25")
def match_batch(spark, sf):
    return matching.match_batch(_read(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "p_partkey", "small ring", "levenshtein", 0.6, 25)


@query(f"SELECT p_partkey, p_name, {lev_sql('p_name', chr(39) + 'smal rings' + chr(39))} AS score FROM part ORDER BY score DESC, p_partkey LIMIT 1")
def match_best(spark, sf):
    return matching.match_best(_read(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "p_partkey", "smal rings", "levenshtein")


@query(f"""SELECT id, b.value, b.score, b."index" FROM (SELECT p_partkey AS id, list_sort(list_transform(['small ring', 'red box', 'large bolt'], lambda v, i: {{'score': -{lev_sql('p_name', 'v')}, 'index': CAST(i - 1 AS INT), 'value': v}}))[1] AS o FROM part) t,
LATERAL (SELECT {{'value': o.value, 'score': -o.score, 'index': o."index"}} AS b)""")
def match_column(spark, sf):
    best = matching.column_match_best(F.col("p_name"), ["small ring", "red box", "large bolt"], "levenshtein")
    return _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), best.alias("b")).select("id", "b.value", "b.score", "b.index")


@query(f"SELECT a.n_nationkey AS row, b.s_suppkey AS col, {lev_sql('a.n_name', 'b.s_name')} AS score FROM nation a, supplier b")
def cdist(spark, sf):
    return matching.cdist(_read(spark, sf, "nation"), _read(spark, sf, "supplier"), "n_nationkey", "n_name", "s_suppkey", "s_name", "levenshtein")


@query(f"WITH RECURSIVE jp AS (SELECT DISTINCT first_name AS x, last_name AS y FROM people WHERE first_name IS NOT NULL AND last_name IS NOT NULL), {oracles.JARO} SELECT id, first_name, last_name, round(jw, 9) AS score FROM people LEFT JOIN ja ON x = first_name AND y = last_name")
def pairwise_jaro_winkler(spark, sf):
    """Throughput of a batched kernel: every person's two names."""
    return matching.pairwise_similarity(_read(spark, sf, "people").select("id", "first_name", "last_name"), "first_name", "last_name").withColumn("score", F.round("score", 9))


_FUZZY = f"""
WITH p AS (SELECT s_suppkey, s_name, s_nationkey, c_custkey, c_name, {lev_sql('s_name', 'c_name')} AS score FROM supplier JOIN customer ON s_nationkey = c_nationkey),
k AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, c_name) AS r FROM p WHERE score >= 0.5)
"""


@query(_FUZZY + """SELECT s_suppkey, s_name, s_nationkey, c_custkey AS c_custkey_right, c_name AS c_name_right, c_nationkey AS c_nationkey_right, score AS _score FROM k JOIN customer USING (c_custkey, c_name) WHERE r <= 2""")
def fuzzy_join_inner(spark, sf):
    s, c = _read(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), _read(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return matching.fuzzy_join(s, c, left_on="s_name", right_on="c_name", scorer="levenshtein", threshold=0.5, limit=2, block=[("s_nationkey", "c_nationkey")])


@query(f"""
WITH p AS (SELECT n_nationkey, n_name, r_regionkey, r_name, {lev_sql('n_name', 'r_name')} AS s FROM nation, region),
k AS (SELECT * FROM p WHERE s >= 0.25 QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY s DESC, r_name) = 1)
SELECT nation.n_nationkey, nation.n_name, r_regionkey AS r_regionkey_right, r_name AS r_name_right, s AS _score FROM nation LEFT JOIN k USING (n_nationkey)""")
def fuzzy_join_left(spark, sf):
    return matching.fuzzy_join(_read(spark, sf, "nation").select("n_nationkey", "n_name"), _read(spark, sf, "region").select("r_regionkey", "r_name"), left_on="n_name", right_on="r_name", scorer="levenshtein", threshold=0.25, how="left")


@query(rf"""
WITH RECURSIVE ppl AS (SELECT id, regexp_replace(last_name, '[^\x00-\x7F]', '?', 'g') AS v FROM people WHERE last_name IS NOT NULL), vals AS (SELECT DISTINCT v FROM ppl), near AS (
  SELECT a.v AS x, b.v AS y FROM vals a JOIN vals b ON a.v < b.v AND abs(length(a.v) - length(b.v)) <= 0.15 * greatest(length(a.v), length(b.v)) + 1e-9 WHERE {lev_sql('a.v', 'b.v')} >= 0.85),
links AS (SELECT x AS a, y AS b FROM near), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT v, v FROM vals),
best(v, home) USING KEY (v) AS (
  SELECT a, min(least(a, b)) FROM both_ways GROUP BY a
  UNION SELECT e.b, min(r.home) FROM best AS r JOIN both_ways AS e ON e.a = r.v JOIN recurring.best AS old ON old.v = e.b WHERE r.home < old.home GROUP BY e.b),
mine AS (SELECT id AS record_id, min(id) OVER (PARTITION BY home) AS first, count(*) OVER (PARTITION BY home) AS n FROM ppl JOIN best USING (v))
SELECT record_id, CAST(dense_rank() OVER (ORDER BY first) - 1 AS BIGINT) AS cluster_id FROM mine WHERE n > 1""")
def deduplicate_values(spark, sf):
    """All people by last names an edit or two apart. This SQL counts bytes, so letters outside ASCII are one sign on both sides."""
    p = _read(spark, sf, "people").select("id", F.regexp_replace("last_name", r"[^\x00-\x7F]", "?").alias("v"))
    return matching.deduplicate(p, "id", "v", "levenshtein", 0.85)


@query(r"""
WITH t AS (SELECT p_partkey AS id, lower(unnest(list_filter(string_split(p_name || ' ' || p_type, ' '), lambda x: x <> ''))) AS tok FROM part),
n AS (SELECT count(*) AS n FROM part), df AS (SELECT tok, ln((SELECT n FROM n) / count(DISTINCT id)) AS idf FROM t GROUP BY tok),
v AS (SELECT id, tok, count(*) / sum(count(*)) OVER (PARTITION BY id) * idf AS w FROM t JOIN df USING (tok) GROUP BY id, tok, idf),
q AS (SELECT tok, count(*) / 3 * idf AS w FROM (SELECT unnest(['small', 'ring', 'economy']) AS tok) JOIN df USING (tok) GROUP BY tok, idf),
s AS (SELECT id, sum(v.w * q.w) AS dot FROM v JOIN q USING (tok) GROUP BY id), nv AS (SELECT id, sqrt(sum(w * w)) AS nn FROM v GROUP BY id)
SELECT p_partkey, round(coalesce(dot / (nn * (SELECT sqrt(sum(w * w)) FROM q)), 0.0), 9) AS score FROM part LEFT JOIN s ON s.id = p_partkey LEFT JOIN nv ON nv.id = p_partkey""")
def tfidf_match(spark, sf):
    p = _read(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return matching.TfIdf.fit(p, "t").match_batch("small ring ECONOMY", p, "p_partkey", "t").select("p_partkey", F.round("score", 9).alias("score"))


def _values(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value"))


@query("SELECT p_partkey AS id, p_name AS value, levenshtein(p_name, 'smal ring') AS distance FROM part WHERE levenshtein(p_name, 'smal ring') <= 3")
def search_within(spark, sf):
    return search.NearestIndex.build(_values(spark, sf)).find_within("smal ring", 3)


@query("SELECT DISTINCT q.p_name AS query, v.c_custkey AS id, v.c_name AS value, levenshtein(v.c_name, q.p_name) AS distance FROM (SELECT DISTINCT c_name AS p_name FROM customer WHERE c_custkey % 20 = 0) q JOIN customer v ON levenshtein(v.c_name, q.p_name) <= 1")
def search_within_all(spark, sf):
    """Every customer whose key is divisible by 20 as a query against all customers."""
    c = _read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("value"))
    return search.NearestIndex.build(c).find_within_all(c.filter("id % 20 = 0").select(F.col("value").alias("query")), 1)


@query("SELECT p_partkey AS id, p_name AS value, levenshtein(p_name, 'red blt') AS distance FROM part ORDER BY distance, id LIMIT 12")
def search_nearest(spark, sf):
    return search.NearestIndex.build(_values(spark, sf)).find_nearest("red blt", 12)


@query(f"WITH RECURSIVE jp AS (SELECT DISTINCT p_name AS x, 'red blt' AS y FROM part), {oracles.JARO} SELECT p_partkey AS id, p_name AS value, round(1 - jw, 9) AS distance FROM part JOIN ja ON x = p_name ORDER BY distance, id LIMIT 12")
def search_nearest_metric(spark, sf):
    return search.NearestIndex.build(_values(spark, sf), metric="jaro_winkler").find_nearest("red blt", 12).withColumn("distance", F.round("distance", 9))


@query(f"""
WITH p AS (SELECT p_partkey AS id, unnest({_grams('p_name')}) AS g FROM part), q AS (SELECT unnest({_grams(chr(39) + 'small ring' + chr(39))}) AS g)
SELECT id, p_name AS value, CAST(count(*) AS BIGINT) AS shared FROM p JOIN q USING (g) JOIN part ON p_partkey = id GROUP BY id, p_name HAVING count(*) >= 4""")
def search_ngram(spark, sf):
    return search.PostingsIndex.build(_values(spark, sf), kind="ngram:2").search("small ring", 4)


@query("""
WITH p AS (SELECT p_partkey AS id, unnest(string_split(lower(p_name), ' ')) AS g FROM part), q AS (SELECT unnest(['red', 'box']) AS g)
SELECT id, p_name AS value, CAST(count(*) AS BIGINT) AS shared FROM p JOIN q USING (g) JOIN part ON p_partkey = id GROUP BY id, p_name""")
def search_inverted(spark, sf):
    return search.PostingsIndex.build(_values(spark, sf), kind="whitespace").search("Red BOX", 1)


@query("""
WITH p AS (SELECT p_partkey AS id, unnest(string_split(lower(p_name), ' ')) AS g FROM part), q AS (SELECT n_name AS query, unnest(string_split(lower(n_name || ' ' || p_name), ' ')) AS g FROM nation JOIN part ON p_partkey = n_nationkey)
SELECT query, id, CAST(count(*) AS BIGINT) AS shared FROM p JOIN q USING (g) GROUP BY ALL""")
def search_postings_file(spark, sf):
    """A postings table written sorted as Parquet and searched for a table of queries."""
    index = search.PostingsIndex.build(_values(spark, sf), kind="whitespace")
    path = f"{scratch_dir(spark)}/postings-{uuid.uuid4().hex}"
    index.write_postings(path)
    q = _read(spark, sf, "nation").join(_read(spark, sf, "part"), F.col("n_nationkey") == F.col("p_partkey")).select("n_name", F.concat_ws(" ", "n_name", "p_name").alias("query"))
    found = search.PostingsIndex.search_postings(spark.read.parquet(path), "whitespace", q)
    return found.join(q, "query").select(F.col("n_name").alias("query"), "id", "shared")


@query()
def search_minhash(spark, sf):
    d = _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("url").alias("value"))
    queries = d.filter("id % 20 = 0").select(F.col("value").alias("query"))
    return search.MinHashIndex.build(d).query_all(queries, 0.5)


@query("SELECT c_custkey AS id, true AS has_order FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT -1, true")
def search_bloom(spark, sf):
    """Customers the filter takes for buyers, confirmed: no buyer is missed. Row -1 says whether it keeps strangers out, at most three times its rate."""
    o = _read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("k"))
    f = search.BloomFilter(spark, max(1, _read(spark, sf, "customer").count()), 0.01)
    f.insert(o, "k")
    maybe = f.contains(_read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("k")), "k").filter("maybe")
    strangers = _read(spark, sf, "lineitem").select(F.concat(F.lit("x"), F.col("l_orderkey").cast("string")).alias("k")).distinct()
    kept = f.contains(strangers, "k").agg(F.avg(F.col("maybe").cast("double")).alias("share")).select(F.lit(-1).cast("long").alias("id"), (F.col("share") <= 0.03).alias("has_order"))
    return maybe.join(o, "k", "left_semi").select(F.col("id").cast("long").alias("id"), F.col("maybe").alias("has_order")).unionByName(kept)


_TIED = f"SELECT p_partkey, p_name, {lev_sql('p_name', chr(39) + 'smal rings' + chr(39))} AS score FROM part"


@query(f"(SELECT * FROM ({_TIED}) ORDER BY score DESC, p_partkey DESC LIMIT 1)")
def match_best_last(spark, sf):
    """Of equally good candidates the last."""
    return matching.match_best(_read(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "p_partkey", "smal rings", "levenshtein", ties="last")


@query(f"""
WITH p AS (SELECT n_nationkey, n_name, c_custkey, c_name, {lev_sql("'Customer#0000' || n_nationkey || '0000'", 'c_name')} AS s FROM nation JOIN customer ON c_nationkey = n_nationkey),
k AS (SELECT * FROM p WHERE s >= 0.8 QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY s DESC, c_name) = 1)
SELECT n_nationkey, c_custkey AS c_custkey_right, c_name AS c_name_right, round(s, 9) AS _score FROM k""")
def fuzzy_merge(spark, sf):
    """The best customer of every nation for a made-up name."""
    n = _read(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("Customer#0000"), F.col("n_nationkey").cast("string"), F.lit("0000")).alias("name"))
    c = _read(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return matching.fuzzy_merge(n, c, "name", "c_name", "levenshtein", 0.8, [("n_nationkey", "c_nationkey")]).select("n_nationkey", "c_custkey_right", "c_name_right", F.round("_score", 9).alias("_score"))


@query(f"SELECT c_custkey AS id, s_suppkey AS other, round({lev_sql('c_name', 's_name')}, 9) AS score FROM customer JOIN supplier ON {lev_sql('c_name', 's_name')} >= 0.6")
def fuzzy_values(spark, sf):
    """All customers and suppliers whose names are alike, without a block: q-grams find the candidates."""
    a, b = _read(spark, sf, "customer").select("c_custkey", "c_name"), _read(spark, sf, "supplier").select("s_suppkey", "s_name")
    met = matching.near_values(a, b, "c_name", "s_name", (), "levenshtein", 0.6).withColumn("score", sim.levenshtein_similarity(F.col("c_name"), F.col("s_name"))).filter("score >= 0.6")
    return met.select(F.col("c_custkey").alias("id"), F.col("s_suppkey").alias("other"), F.round("score", 9).alias("score"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS index, p_partkey FROM part")
def match_indexed(spark, sf):
    """Rows of an ordered table with their global index."""
    return streams.indexed(_read(spark, sf, "part").select("p_partkey").repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey"))


# --- streams, sources and sinks ----------------------------------------------------------------------------------------------------
@query("SELECT event_id, event_type, score FROM (SELECT event_id, event_type, " + lev_sql("event_type", "'purchas'") + " AS score FROM events) WHERE score >= 0.5")
def stream_match(spark, sf):
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = streams.read_files(spark, f"{sf}/events.parquet", _read(spark, sf, "events").schema, max_files_per_trigger=1)
    scored = streams.match_stream(source.select("event_id", "event_type"), "event_type", "purchas", "levenshtein", 0.5)
    streams.run_to_table(scored, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema("event_id long, event_type string, score double").parquet(f"{base}/out")


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_dedup(spark, sf):
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = streams.read_files(spark, f"{sf}/events.parquet", _read(spark, sf, "events").schema)
    first = streams.dedup_within_watermark(source, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type")
    streams.run_to_table(first, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema("user_id long, event_type string").parquet(f"{base}/out")


@query(oracles.incremental("SELECT user_id AS g, event_id AS o, event_type AS v FROM events WHERE user_id IS NOT NULL", 0.8) + " SELECT CAST(g AS VARCHAR) AS block, v AS value, cluster, is_new, round(similarity, 9) AS similarity FROM inc WHERE k > 0")
def stream_clusters(spark, sf):
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = streams.read_files(spark, f"{sf}/events.parquet", _read(spark, sf, "events").schema)
    found = streams.incremental_clusters(source.select(F.col("user_id").cast("string").alias("user"), "event_id", "event_type"), "user", "event_id", "event_type", threshold=0.8)
    streams.run_to_table(found, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema("block string, value string, cluster int, is_new boolean, similarity double").parquet(f"{base}/out").withColumn("similarity", F.round("similarity", 9))


@query("SELECT left_id, right_id, CAST(score AS VARCHAR) AS score, list_aggregate(list_transform(list_filter(scores, lambda x: x IS NOT NULL), lambda x: CAST(x AS VARCHAR)), 'string_agg', ';') AS scores FROM match_results WHERE scores IS NOT NULL AND left_id IS NOT NULL AND right_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
def sink_matches_csv(spark, sf):
    """Matches written as CSV and read back."""
    path = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    m = _read(spark, sf, "match_results").filter("scores is not null and left_id is not null and right_id is not null and score is not null and not isnan(score)")
    io.write_matches_csv(m, path)
    return io.read_csv(spark, path).select("left_id", "right_id", "score", "scores")


# --- Python tables, files, saved plans and indexes -----------------------------------------------------------------------------------
@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 200, n_name, n_regionkey FROM nation")
def source_python_tables(spark, sf):
    """A pandas frame, an Arrow table and a list of dicts, each made a table again."""
    n = _read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    made = [io.to_frame(spark, x, "n_nationkey") for x in (n.toPandas(), n.toArrow(), [r.asDict() for r in n.collect()])]  # small by nature: they are in the driver's memory
    return made[0].unionByName(made[1].withColumn("n_nationkey", F.col("n_nationkey") + 100)).unionByName(made[2].withColumn("n_nationkey", F.col("n_nationkey") + 200))


@query("SELECT trim(n_name) AS value FROM nation")
def source_lines(spark, sf):
    """Lines of a text file, without blanks around them and without blank lines."""
    path = f"{scratch_dir(spark)}/lines-{uuid.uuid4().hex}"
    _read(spark, sf, "nation").select(F.explode(F.array(F.concat(F.lit("  "), "n_name"), F.lit("  ")))).write.text(path)
    return io.read_lines(spark, path)


@query("SELECT left_id, right_id, score, match_class, scores FROM match_results WHERE score IS NOT NULL AND NOT isnan(score) AND left_id IS NOT NULL AND right_id IS NOT NULL")
def sink_matches_json(spark, sf):
    path = f"{scratch_dir(spark)}/json-{uuid.uuid4().hex}"
    m = _read(spark, sf, "match_results").filter("score is not null and not isnan(score) and left_id is not null and right_id is not null").select("left_id", "right_id", "score", "match_class", "scores")
    io.write_matches_json(m, path)
    return spark.read.schema(m.schema).json(path)


@query(_CC + "SELECT how, record_id, CAST(dense_rank() OVER (ORDER BY component) - 1 AS BIGINT) AS cluster_id FROM best, (SELECT unnest(['csv', 'json']) AS how)")
def sink_clusters(spark, sf):
    base = f"{scratch_dir(spark)}/clusters-{uuid.uuid4().hex}"
    found = clustering.connected_components(_read(spark, sf, "dup_pairs").filter("match_class = 'match'"))
    io.write_clusters_csv(found, f"{base}/csv")
    io.write_clusters_json(found, f"{base}/json")
    read = {"csv": io.read_csv(spark, f"{base}/csv"), "json": spark.read.schema("cluster_id long, record_id string").json(f"{base}/json")}
    parts = [read[how].select(F.lit(how).alias("how"), "record_id", F.col("cluster_id").cast("long").alias("cluster_id")) for how in read]
    return parts[0].unionByName(parts[1])


@query("SELECT p_partkey AS id, p_name AS value, levenshtein(p_name, 'smal ring') AS distance FROM part WHERE levenshtein(p_name, 'smal ring') <= 3 AND p_partkey <> 7")
def search_saved_index(spark, sf):
    """An index written, read back, extended by rows that are then removed, and searched."""
    path = f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}"
    search.NearestIndex.build(_values(spark, sf)).save(path)
    index = search.NearestIndex.load(spark, path)
    index.insert(spark.createDataFrame([(-5, "smal ring")], "id long, value string"))
    index.remove(-5)
    index.remove(7)
    return index.find_within("smal ring", 3)


@query(SQL["linkage_dedup_part"])
def linkage_from_json(spark, sf):
    """A plan written as JSON and read back."""
    plan = Linkage().preprocess("name", ["fold_case"]).block_exact("brand").compare_string("name", "levenshtein").classify_threshold(0.7)
    return _flat(Linkage.from_json(plan.to_json()).dedup(_part(spark, sf)), 1)


@query(f"""
WITH c AS (SELECT a.s_suppkey AS left_id, b.s_suppkey AS right_id, {lev_sql('a.s_name', 'b.s_name')} AS s0, greatest(0.0, 1 - abs(a.s_acctbal - b.s_acctbal) / 1000) AS s1
  FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND (a.s_nationkey = b.s_nationkey OR abs(floor(a.s_acctbal / 50) - floor(b.s_acctbal / 50)) <= 1))
SELECT left_id, right_id, round(0.7 * s0 + 0.3 * s1, 9) AS score, CASE WHEN 0.7 * s0 + 0.3 * s1 >= 0.95 THEN 'match' ELSE 'possible' END AS match_class, round(s0, 9) AS s0, round(s1, 9) AS s1 FROM c WHERE 0.7 * s0 + 0.3 * s1 >= 0.8""")
def linkage_several_blockers(spark, sf):
    """Two blockers in one plan, weighted bands."""
    plan = Linkage().block_exact("nation").block_numeric("balance", 50.0).combine("union").compare_string("name", "levenshtein").compare_numeric("balance", 1000.0).classify_weighted_bands([0.7, 0.3], 0.95, 0.8)
    return _flat(plan.dedup(_supplier(spark, sf)), 2)


@query("""
WITH p AS (SELECT row_number() OVER (ORDER BY left_id, right_id) - 1 AS cluster_id, left_id, right_id FROM (SELECT a.p_partkey AS left_id, b.p_partkey AS right_id FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey))
SELECT cluster_id, unnest([left_id, right_id]) AS record_id FROM p""")
def cluster_none(spark, sf):
    """Without a clusterer every pair is a cluster."""
    plan = Linkage().block_exact("name").compare_exact("brand").compare_exact("type").classify_threshold(1.0)
    return plan.dedup_cluster(_part(spark, sf))


class _SameSize:
    """A blocker of one's own: records of one size and name."""

    def block_dedup(self, df: DataFrame) -> DataFrame:
        return blocking.exact(df.withColumn("k", F.struct("size", "name")), None, "k")

    def block_link(self, left: DataFrame, right: DataFrame) -> DataFrame:
        return blocking.exact(left, right, "size")


@query("""
SELECT a.p_partkey AS left_id, b.p_partkey AS right_id, round(s, 9) AS score, CASE WHEN s >= 0.9 THEN 'match' ELSE 'possible' END AS match_class FROM (
  SELECT p_partkey, p_name, p_size, upper(p_type) AS t FROM part) a JOIN (SELECT p_partkey, p_name, p_size, upper(p_type) AS t FROM part) b ON a.p_name = b.p_name AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey,
  LATERAL (SELECT ((length(a.t) = length(b.t))::INT + (a.t[1] = b.t[1])::INT) / 2 AS s) WHERE s >= 0.5""")
def linkage_registered_parts(spark, sf):
    """A plan of parts of one's own: preprocessor, blocker, metric, comparator and classifier."""
    registry.register_preprocessor("own_upper", lambda x: x.upper())
    registry.register_metric("own_length", lambda a, b: float(len(a) == len(b)))
    registry.register_comparator("own_first", lambda a, b: float(a[:1] == b[:1]))
    registry.register_classifier("own_bands", lambda s: (sum(s) / 2, "match" if sum(s) / 2 >= 0.9 else "possible" if sum(s) / 2 >= 0.5 else "non_match"))
    registry.register_blocker("own_size", _SameSize())
    part = _part(spark, sf).select("id", "name", F.col("size").cast("string").alias("size"), "type")
    plan = Linkage().preprocess("type", ["custom:own_upper"]).preprocess("name", ["fold_case"]).preprocess("size", ["fold_case"])
    plan.block_custom("own_size").compare_string("type", "own_length").compare_custom("type", "own_first").classify_custom("own_bands")
    return plan.dedup(part).select("left_id", "right_id", F.round("score", 9).alias("score"), "match_class")


@query("SELECT p_partkey AS id, array_to_string(string_split(p_type, 'E'), '|') AS t FROM part")
def fn_registered_tokenizer(spark, sf):
    registry.register_tokenizer("own_split", lambda x: x.split("E"))
    return _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(registry.tokenizer("own_split")(F.col("p_type")), "|").alias("t"))


@query(f"""
WITH ppl AS (SELECT a.left_id, a.right_id, a.f FROM (SELECT l.id AS left_id, r.id AS right_id, l.rank AS lr, r.rank AS rr, abs(l.rank - r.rank) AS f FROM (
  SELECT id, side, row_number() OVER (ORDER BY f, side, id) AS rank FROM (SELECT id, 0 AS side, lower(last_name) AS f FROM probe_people UNION ALL SELECT id, 1, lower(last_name) FROM people) WHERE f IS NOT NULL) l JOIN (
  SELECT id, side, row_number() OVER (ORDER BY f, side, id) AS rank FROM (SELECT id, 0 AS side, lower(last_name) AS f FROM probe_people UNION ALL SELECT id, 1, lower(last_name) FROM people) WHERE f IS NOT NULL) r ON l.side = 0 AND r.side = 1) a WHERE f <= 2)
SELECT left_id, right_id FROM ppl""")
def block_sorted_neighborhood_link(spark, sf):
    """Probes and people next to each other in the order of last names."""
    return _pairs(blocking.sorted_neighborhood(_probes(spark, sf), _read(spark, sf, "people").select("id", "last_name"), "last_name", 3))


# --- problem 3 -----------------------------------------------------------------------------------------------------------------------
@query("""
SELECT id FROM (
  SELECT id, first_name, seen_at, lag(first_name) OVER w AS before_name, lag(seen_at) OVER w AS before_at
  FROM people WHERE last_name IS NOT NULL AND seen_at IS NOT NULL WINDOW w AS (PARTITION BY last_name ORDER BY seen_at, id))
WHERE first_name = before_name AND seen_at - before_at <= INTERVAL 3600 SECOND""")
def p3_found(spark, sf):
    return keyed.direct_predecessors(_read(spark, sf, "people"), "last_name", "seen_at", "id", "first_name", 3600)


@query("""
WITH cells AS (SELECT last_name, first_name AS v, count(*) AS w FROM people WHERE last_name IS NOT NULL AND first_name IS NOT NULL GROUP BY ALL),
placed AS (SELECT *, sum(w) OVER (PARTITION BY last_name ORDER BY v) AS upto, sum(w) OVER (PARTITION BY last_name) AS n, max(w) OVER (PARTITION BY last_name) AS mode_n FROM cells)
SELECT last_name, CAST(max(n) AS BIGINT) AS n, count(*) AS n_distinct, min(v) FILTER (w = mode_n) AS mode, max(mode_n) AS mode_n,
       min(v) FILTER (upto >= ceil(n * 0.5)) AS p50, min(v) FILTER (upto >= ceil(n * 0.9)) AS p90
FROM placed GROUP BY last_name""")
def p3_profile(spark, sf):
    return keyed.value_profile(_read(spark, sf, "people"), "last_name", "first_name", (0.5, 0.9)).withColumnRenamed("key", "last_name")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
