"""Variant spellings of names that refer to one person or organisation.

All records of one scope (postcode and date, date and town, postcode and town) are candidates of each other, a soft weighted
token similarity verifies them together with what date, postcode and city say, short forms are learned from the corpus, and
linked records are gathered into entities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import date
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinloom.llm import names
from kinloom.llm.copies import canonical_parts, format_groups
from kinloom.operators.components import connected
from kinloom.operators.skew import MAX_HOT_KEYS, join_lookup
from kinloom.session import discard, materialise

#: Frequencies of tokens, dates, postcodes and cities are kept in so many counters, which bounds what tasks receive.
TOKEN_COUNTERS = 1 << 17
#: Records of a scope that one slice may hold; every slice of a larger scope meets each other one.
SCOPE_SLICE = 2_000
#: Log odds from which a pair is linked, and the least scores of its names: where postcode and date agree, elsewhere,
#: and where a token on each side contradicts the other.
ODDS, NEAR, FAR, CONTRADICTED = 2.5, 0.55, 0.78, 0.8
#: Log odds of a slip in a date of birth, of another postcode and of another city in a record of the same person.
SLIP, MOVED, ELSEWHERE = -6.0, -4.0, -4.0
#: A short form is learned if so many scopes show it, and so large a share of all that contradicts its rarer token.
LEARN_AT_LEAST, LEARN_SHARE = 3, 0.4


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = list(zip(b.column("first").to_pylist(), b.column("last").to_pylist()))
        toks = [names.tokens(f, l) for f, l in parts]
        cities = [None if c is None or c.strip().lower() in names.MISSING else names.fold(c.strip()) for c in b.column("city").to_pylist()]
        yield pa.record_batch(
            [
                b.column("node"),
                b.column("name_key"),
                pa.array([" ".join(t) for t in toks], pa.string()),
                b.column("dob"),
                pa.array([_day(d) for d in b.column("dob").to_pylist()], pa.date32()),
                pa.array(cities, pa.string()),
                b.column("postcode"),
            ],
            names=["node", "name_key", "tokens", "dob", "day", "city", "postcode"],
        )


_NODE = "node string, name_key string, tokens string, dob string, day date, city string, postcode string"


def _city_fits(a: str | None, b: str | None) -> int:
    """1 same or an abbreviation of the same, 0 unknown, -1 different."""
    if a is None or b is None:
        return 0
    if a == b:
        return 1
    x, y = names.tokens(a), names.tokens(b)
    if len(x) == len(y) and all(p[:1] == q[:1] for p, q in zip(x, y)) and (names.edit_similarity(" ".join(x), " ".join(y)) >= 0.7 or any(p == q for p, q in zip(x, y))):
        return 1
    return 1 if names.edit_similarity(a, b) >= 0.8 else -1


def _city_codes(city: str) -> list[int]:
    """Codes of which two cities that fit share one.

    The first way to fit has the initials of all words in common. The second is an edit similarity of 0.8 or more: an edit
    touches at most four of the padded trigrams, as many as there are letters, so at least a fifth of them is left.
    """
    padded = f"^{city}$"
    return sorted({crc32(padded[i : i + 3].encode()) for i in range(len(padded) - 2)} | {crc32(f"& {' '.join(t[0] for t in names.tokens(city))}".encode())})


def fitting_cities(cities: DataFrame) -> DataFrame:
    """(city, copies, fits): every city with all cities that fit it (see _city_fits), itself among them."""
    codes = lambda it: (pa.record_batch([b.column("city"), pa.array([_city_codes(c) for c in b.column("city").to_pylist()], pa.list_(pa.int64()))], names=["city", "codes"]) for b in it)
    coded = cities.select("city").mapInArrow(codes, "city string, codes array<bigint>").select("city", F.explode("codes").alias("code"))
    met = coded.join(coded.withColumnRenamed("city", "other"), "code").select("city", "other").distinct()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([_city_fits(x, y) > 0 for x, y in zip(b.column("city").to_pylist(), b.column("other").to_pylist())], pa.bool_()))

    return cities.join(met.mapInArrow(fit, "city string, other string").groupBy("city").agg(F.collect_list("other").alias("fits")), "city")


def _day(text: str | None) -> date | None:
    try:
        return None if text is None else date.fromisoformat(text)
    except ValueError:
        return None


def slip_of_date(a: str, b: str) -> bool:
    """Whether two different ISO dates are one day apart, exchange day and month, or differ in one digit of the year."""
    x, y = _day(a), _day(b)
    if x is None or y is None:
        return False
    if abs((x - y).days) == 1:
        return True
    if x.year == y.year:
        return x.month == y.day and x.day == y.month
    return (x.month, x.day) == (y.month, y.day) and sum(p != q for p, q in zip(f"{x.year:04d}", f"{y.year:04d}")) == 1


def _verify(batches: Iterator[pa.RecordBatch], counters: np.ndarray, total: int) -> Iterator[pa.RecordBatch]:
    """(a, b, whether a date is missing, log odds, x, y): linked pairs with x null, and pairs that would be linked if x and y were forms of one name."""
    top = math.log(total + 1)
    known: dict[str, tuple[int, float]] = {}

    def facts(key: str) -> tuple[int, float]:
        got = known.get(key)
        if got is None:
            if len(known) > 200_000:
                known.clear()
            n = int(counters[crc32(key.encode()) % TOKEN_COUNTERS])
            got = known[key] = n, max(0.0, math.log((total + 1) / (n + 0.5)))
        return got

    weight = lambda t: max(0.15, facts(t)[1] / top) * (0.5 if len(t) == 1 else 1.0)
    count = lambda t: facts(t)[0]
    columns = ("a_tokens", "b_tokens", "a_dob", "b_dob", "a_city", "b_city", "a_postcode", "b_postcode")
    for b in batches:
        keep, odds_of, forms = [], [], []
        for i, (x, y, a_dob, b_dob, a_city, b_city, a_post, b_post) in enumerate(zip(*[b.column(c).to_pylist() for c in columns])):
            dated, born, near = a_dob is not None and b_dob is not None, a_dob == b_dob, a_post is not None and a_post == b_post
            if not near if not dated else not born and not (near and slip_of_date(a_dob, b_dob)):
                continue  # without a date only the postcode tells namesakes apart, with two dates only a slip explains a difference
            place = _city_fits(a_city, b_city)
            if place < 0 and not (dated and near):
                continue
            odds = -top + (facts("postcode " + a_post)[1] if near else 0.0 if a_post is None or b_post is None else MOVED)
            odds += 0.0 if not dated else facts("dob " + a_dob)[1] if born else facts("dob " + a_dob)[1] + SLIP
            odds += facts("city " + a_city)[1] if place > 0 else ELSEWHERE if place < 0 else 0.0
            p, q = x.split(), y.split()
            score, told, apart, got = names.compare(p, q, weight, count)
            close = dated and born and near  # then the names alone decide
            least, need = (NEAR, -math.inf) if close else (FAR, ODDS)
            both = any(len(t) > 1 for t in p if t not in {m[0] for m in got}) and any(len(t) > 1 for t in q if t not in {m[1] for m in got})
            alone = min(len(p), len(q)) < 2 and max(len(p), len(q)) > 1 and names.edit_similarity("".join(p), "".join(q)) < 0.85
            if alone and not close:
                continue  # a lone surname without a date of birth says too little
            if score >= (max(least, CONTRADICTED) if both else least) and odds + told * top >= need:
                keep.append(i)
                odds_of.append(odds + told * top + score)
                forms.append((None, None))
            elif apart is not None and got:
                w = min(map(weight, apart))
                s = (sum((weight(u) + weight(v)) / 2 * m for u, v, m in got) + 0.95 * w) / (sum((weight(u) + weight(v)) / 2 for u, v, _ in got) + w)
                if s >= FAR and odds + (told + 0.9 * w) * top >= need:
                    keep.append(i)
                    odds_of.append(odds + (told + 0.9 * w) * top + s)
                    forms.append(tuple(sorted(apart)))
        if keep:
            at = pa.array(keep)
            a_dob, b_dob = b.column("a_dob").take(at), b.column("b_dob").take(at)
            columns_out = [b.column("a").take(at), b.column("b").take(at), a_dob.is_null(), b_dob.is_null(), pa.array(odds_of, pa.float64()), pa.array([f[0] for f in forms], pa.string()), pa.array([f[1] for f in forms], pa.string())]
            yield pa.record_batch(columns_out, names=["a", "b", "a_open", "b_open", "score", "x", "y"])


_LINK = "a bigint, b bigint, a_open boolean, b_open boolean, score double, x string, y string"


def short_forms(judged: DataFrame) -> DataFrame:
    """(x, y): tokens that stand for each other, learned from pairs that agree in all but these two tokens.

    Under an equal date and place two given names are those of twins, then any two names meet, or forms of one name,
    then the rarer of the two meets the same other one again and again. A pair is learned from LEARN_AT_LEAST pairs of
    records with both dates known, if it makes up LEARN_SHARE of all that its rarer token contradicts. No more than
    MAX_HOT_KEYS can be learned: each must hold that share of all such pairs.
    """
    seen = judged.filter("x is not null and not a_open and not b_open").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    ends = seen.select(F.explode(F.array("x", "y")).alias("t"), "n").groupBy("t").agg(F.sum("n").alias("of"))
    least = seen.agg(F.greatest(F.lit(LEARN_AT_LEAST), F.ceil(F.coalesce(F.sum("n"), F.lit(0)) / MAX_HOT_KEYS)).alias("least"))
    both = seen.join(ends.select(F.col("t").alias("x"), F.col("of").alias("of_x")), "x").join(ends.select(F.col("t").alias("y"), F.col("of").alias("of_y")), "y").join(F.broadcast(least), F.lit(True))
    return both.filter((F.col("n") >= F.col("least")) & (F.col("n") >= LEARN_SHARE * F.least("of_x", "of_y"))).select("x", "y")


def name_nodes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: id, node; nodes): rows that differ only in formatting share a node, named by its smallest id."""
    keyed, groups = format_groups(df, "id", "first_name", "last_name", ("dob", "city", "postcode"))
    rows = join_lookup(keyed.select("id", "h1", "h2", "h3"), groups.select("h1", "h2", "h3", "copies", F.col("rep.id").alias("node")), ["h1", "h2", "h3"], "copies", df.count()).select("id", "node")
    flat = groups.select(F.col("rep.id").alias("node"), F.col("rep.first_name").alias("first"), F.col("rep.last_name").alias("last"), "rep.dob", "rep.city", "rep.postcode")
    key = F.array_join(canonical_parts(F.col("first"), F.col("last")), " ")
    nodes = flat.withColumn("name_key", key).mapInArrow(_prepare, _NODE)
    return rows, nodes


def candidates(ready: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of record numbers that _verify does not rule out by date, postcode and city alone.

    Scopes, in which every record meets every other, whatever the names: postcode and date; postcode and what a slip leaves of
    the date; date and city, for another or no postcode; postcode and city, if a date is missing. Where cities count, a record
    probes those that fit its own, and one without a city meets all of them. Scopes in which nothing can meet are dropped
    first; a scope of more than SCOPE_SLICE records is cut into slices that all meet each other.
    """
    n, month, dom = F.unix_date("day"), F.month("day"), F.dayofmonth("day")
    placed, born, in_town, city, fits = F.col("postcode").isNotNull(), F.col("dob").isNotNull(), F.col("city").isNotNull(), F.col("city"), F.col("fits")
    dated, dob, me, yes = placed & F.col("day").isNotNull(), F.xxhash64("dob"), F.col("rid"), F.lit(True)
    home = F.when(placed, F.xxhash64("postcode")).otherwise(me)  # no postcode agrees with none

    def scope(kind: str, mark: Column, probes: Column, is_met: Column, *of: Column | str) -> Column:
        return F.struct(F.xxhash64(F.lit(kind), *of).alias("scope"), mark.alias("m"), (probes.cast("int") + 2 * is_met.cast("int")).alias("role"))  # 1 probes, 2 is met

    none = F.array().cast("array<struct<scope:bigint,m:bigint,role:int>>")
    each = lambda when, *scopes: F.when(when, F.array(*scopes)).otherwise(none)
    kinds = [
        each(placed & born, scope("same", me, yes, yes, "postcode", "dob")),
        each(dated, scope("even", dob, yes, yes, "postcode", F.floor(n / 2)), scope("odd", dob, yes, yes, "postcode", F.floor((n + 1) / 2)), scope("year", dob, yes, yes, "postcode", month, dom)),
        each(dated & (dom <= 12) & (dom != month), scope("turned", dob, yes, yes, "postcode", F.year("day"), F.least(month, dom), F.greatest(month, dom))),
        # Of two cities that fit, the record in the lesser one probes the other.
        F.when(born & in_town, F.transform(F.filter(fits, lambda c: c >= city), lambda c: scope("moved", home, yes, c == city, "dob", c))).otherwise(none),
        each(born, scope("moved, any city", home, ~in_town, yes, "dob")),
        F.when(placed & in_town, F.transform(F.filter(fits, lambda c: ~born | (c == city)), lambda c: scope("open", me, ~born, c == city, "postcode", c))).otherwise(none),
        each(placed, scope("open, any city", me, ~born & ~in_town, yes, "postcode")),
        each(placed & (~in_town | ~born), scope("open, no city", me, ~born & in_town, ~in_town, "postcode")),
    ]
    scoped = ready.select("rid", F.explode(F.concat(*kinds)).alias("s")).select("rid", "s.*")
    shared = scoped.groupBy("scope").agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.count(F.lit(1)).alias("n"), F.bit_or("role").alias("roles"))
    shared = shared.filter("lo < hi and roles = 3").select("scope", F.ceil(F.col("n") / SCOPE_SLICE).cast("int").alias("slices"))
    scoped = scoped.join(shared, "scope")
    own, others = F.pmod(F.xxhash64("rid"), F.col("slices")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    left = scoped.filter("role <> 2").select("scope", F.col("rid").alias("p"), F.col("m").alias("pm"), F.col("role").alias("pr"), own.alias("i"), others.alias("j"))
    right = scoped.filter("role <> 1").select("scope", F.col("rid").alias("o"), F.col("m").alias("om"), F.col("role").alias("os"), own.alias("j"), others.alias("i"))
    met = left.join(right, ["scope", "i", "j"]).filter("pm <> om and p <> o and (p < o or pr <> 3 or os <> 3)")  # two that probe and are met would meet twice
    return met.select(F.least("p", "o").alias("a"), F.greatest("p", "o").alias("b")).distinct()


def entities(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: id, node; members: node, name_key, entity) of a table id, first_name, last_name, dob, city, postcode.

    Candidates (see candidates) are judged by the log odds of what agrees: tokens, date of birth, postcode and city, each by
    how rare it is among all records, with fixed odds for a slip in the date and for another postcode. A record without a
    date follows its best partner. Records with a null or empty name are entities of their own; a null postcode or date
    agrees with none and contradicts none.
    """
    rows, nodes = name_nodes(df)
    nodes = materialise(nodes, "name-nodes")
    spark = df.sparkSession
    total = nodes.count()
    # Corpus statistics over all records, as an array of fixed size.
    counters = np.zeros(TOKEN_COUNTERS, dtype=np.int64)
    said = F.concat(F.split("tokens", " "), F.array_compact(F.array(*[F.concat(F.lit(f"{c} "), F.col(c)) for c in ("dob", "postcode", "city")])))
    buckets = nodes.select(F.explode(said).alias("t")).filter("t <> ''").select((F.crc32(F.col("t").cast("binary")) % TOKEN_COUNTERS).alias("k"))
    for code, n in buckets.groupBy("k").count().collect():  # at most TOKEN_COUNTERS rows
        counters[code] = n
    sent = spark.sparkContext.broadcast(counters)
    named = nodes.filter("tokens <> ''")
    cities = materialise(fitting_cities(named.filter("city is not null").groupBy("city").agg(F.count(F.lit(1)).alias("copies"))), "cities")
    ready = join_lookup(named, cities, ["city"], "copies", total).select(*named.columns, "fits")
    ready = ready.unionByName(named.filter("city is null").withColumn("fits", F.lit(None).cast("array<string>")))
    # Numbers given while writing are read back by all later steps, so they stay the same if a task is run again.
    ready = materialise(ready.withColumn("rid", F.monotonically_increasing_id()), "name-records")
    discard(nodes)
    facts = ready.select("rid", "tokens", "dob", "city", "postcode")
    side = lambda p: facts.select(*[F.col(c).alias(f"{p}_{c}" if c != "rid" else p) for c in facts.columns])
    full = candidates(ready).join(side("a"), "a").join(side("b"), "b")
    judged = materialise(full.mapInArrow(lambda it: _verify(it, sent.value, total), _LINK), "name-links")
    known = judged.filter("x is not null").join(F.broadcast(short_forms(judged)), ["x", "y"])
    links = judged.filter("x is null").unionByName(known.select(judged.columns)).drop("x", "y")

    # A record without a date of birth joins at most one date: that of its best partner. The others of that date follow by closure.
    one_open = F.col("a_open") != F.col("b_open")
    dated = links.filter(one_open).select(F.when(F.col("a_open"), F.col("a")).otherwise(F.col("b")).alias("loose"), F.when(F.col("a_open"), F.col("b")).otherwise(F.col("a")).alias("b"), "score")
    best = dated.groupBy("loose").agg(F.max(F.struct("score", "b")).alias("top")).select("loose", F.col("top.b").alias("b"))
    # Of two records without a date, one that has found its date takes the other along (its best such partner decides);
    # only those that have found none link freely among each other.
    settled = best.select("loose")
    undated = links.filter("a_open and b_open").select("a", "b", "score")
    flagged = undated.join(settled.select(F.col("loose").alias("a"), F.lit(True).alias("a_done")), "a", "left").join(settled.select(F.col("loose").alias("b"), F.lit(True).alias("b_done")), "b", "left")
    flagged = materialise(flagged.na.fill(False, ["a_done", "b_done"]), "undated")
    half = flagged.filter("a_done <> b_done").select(F.when(F.col("a_done"), F.col("b")).otherwise(F.col("a")).alias("loose"), F.when(F.col("a_done"), F.col("a")).otherwise(F.col("b")).alias("b"), "score")
    follow = half.groupBy("loose").agg(F.max(F.struct("score", "b")).alias("top")).select("loose", F.col("top.b").alias("b"))
    best = best.unionByName(follow)
    done = follow.select("loose")
    undated = flagged.filter("not a_done and not b_done").select("a", "b")
    undated = undated.join(done.withColumnRenamed("loose", "a"), "a", "left_anti").join(done.withColumnRenamed("loose", "b"), "b", "left_anti")
    firm = links.filter("not a_open and not b_open").select("a", "b")
    edges = firm.unionByName(undated.select("a", "b")).unionByName(best.select(F.col("loose").alias("a"), "b"))
    groups = connected(edges, "a", "b")
    members = ready.select("rid", "node", "name_key").join(groups.select(F.col("record_id").alias("rid"), F.col("group_id").alias("entity")), "rid").drop("rid")
    return rows, members


def variant_pairs(df: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows of one entity whose canonical name parts differ.

    Pairs that differ in formatting only are copies, not variants, and are left out. Null ids are left out; an empty table
    gives an empty result. The number of pairs of an entity is by definition quadratic in its rows.
    """
    rows, members = entities(df)
    several = members.groupBy("entity").agg(F.countDistinct("name_key").alias("spellings")).filter("spellings > 1").select("entity")
    members = materialise(members.join(several, "entity", "left_semi"), "name-members")
    # Spellings meet first (one row per node), rows of a node are expanded on both sides afterwards.
    x = members.select("entity", F.col("node").alias("x"), F.col("name_key").alias("kx"))
    y = members.select("entity", F.col("node").alias("y"), F.col("name_key").alias("ky"))
    pairs = x.join(y, "entity").filter("x < y and kx <> ky").select("x", "y")
    of = materialise(rows.join(members.select("node"), "node", "left_semi"), "name-rows")
    expanded = pairs.join(of.select(F.col("node").alias("x"), F.col("id").alias("i")), "x").join(of.select(F.col("node").alias("y"), F.col("id").alias("j")), "y")
    return expanded.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
