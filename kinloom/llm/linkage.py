"""Matching records of two sources that share no identifier, by collective graph linkage.

Records meet over rare shared attributes, the candidate graph is pruned by meta-blocking, surviving pairs are compared
field by field, and confidences are refined by what the pair's neighbours (records of the same two addresses) say until
they are stable.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinloom.llm import names
from kinloom.session import discard, materialise

#: Where each source keeps what; several fields are joined by a blank.
LEFT_FIELDS = {"name": ("name",), "birth": ("dob",), "city": ("city",), "street": ("address",), "phone": ("phone",), "email": ("email",)}
RIGHT_FIELDS = {"name": ("given", "surname"), "birth": ("born",), "city": ("town",), "street": ("street",), "phone": ("tel",), "email": ("mail",)}
#: A key with more holders than this on a side is joined in slices of that many, so that no task holds a whole hot key.
SLICE = 2_000
#: A key that this share of all records holds (a placeholder) says little by itself: equal whole names weigh more under it.
HOT_SHARE = 0.05
#: An edge survives pruning if it has this share of the best weight of either of its ends.
KEEP_SHARE = 0.5
CONFIDENT, STABLE = 0.5, 0.01
#: A safety bound far above the rounds that any data needs; reaching it is an error, never a result.
MAX_ROUNDS = 1_000

_PLACE_WORDS = {"st": "saint", "mt": "mount", "ft": "fort", "pt": "port"}
_STREET_WORDS = {"st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "ln": "lane", "ct": "court", "sq": "square", "dr": "drive", "pl": "place", "hl": "hill"}


def birth_date(text: str | None) -> tuple[int, int, int] | None:
    """(year, month, day) from year-month-day, day.month.year, month/day/year or a bare year; 0 for what is unknown."""
    if text is None:
        return None
    n = [int(x) for x in re.findall(r"\d+", text)]
    if len(n) == 1 and 1000 <= n[0] <= 2999:
        return n[0], 0, 0
    if len(n) != 3:
        return None
    if n[0] > 31:
        y, m, d = n
    elif "/" in text:
        m, d, y = n
    else:
        d, m, y = n
    if y < 100:
        y += 1900 if y >= 30 else 2000
    if m > 12 and d <= 12:
        m, d = d, m
    return (y, m, d) if 1 <= m <= 12 and 1 <= d <= 31 else (y, 0, 0)


def _value(fields: dict[str, str | None], wanted: tuple[str, ...]) -> str | None:
    got = [v for k in wanted if (v := fields.get(k)) is not None and v.strip().lower() not in names.MISSING]
    return " ".join(got) if got else None


def _normal(fields: dict[str, str | None], of: dict[str, tuple[str, ...]]) -> dict:
    toks = names.tokens(*[_value(fields, (k,)) for k in of["name"]])
    born = birth_date(_value(fields, of["birth"]))
    city = _value(fields, of["city"])
    place = [_PLACE_WORDS.get(t, t) for t in re.findall(r"[^\W_]+", names.fold(city.replace("'", "")))] if city else []
    street = _value(fields, of["street"])
    words = re.findall(r"[^\W_]+", names.fold(street)) if street else []
    number = next((w for w in words if w.isdigit()), "")
    road = " ".join(_STREET_WORDS.get(w, w) for w in words if not w.isdigit())
    phone = "".join(re.findall(r"\d", _value(fields, of["phone"]) or ""))[-7:]
    email = (_value(fields, of["email"]) or "").strip().lower()
    return {
        "name": " ".join(toks),
        "y": born[0] if born else 0,
        "m": born[1] if born else 0,
        "d": born[2] if born else 0,
        "city": " ".join(place),
        "road": road,
        "number": number,
        "phone": phone if len(phone) == 7 else "",
        "email": email if "@" in email else "",
    }


def _keys(r: dict) -> list[str]:
    """Attribute combinations under which records may meet, each rare enough to mean something."""
    toks = r["name"].split()
    heads = sorted({t[:3] for t in toks if len(t) > 1})
    initials = sorted({t[0] for t in toks})
    place = r["city"].split()
    town = ("".join(t[0] for t in place) if len(place) > 1 else r["city"][:2]) if place else ""
    out = []
    if r["email"]:
        local = re.sub(r"[^a-z0-9]", "", r["email"].split("@")[0])
        out += [f"e:{r['email']}", f"l:{local}"]
    if r["phone"]:
        out.append(f"p:{r['phone']}")
    if r["m"]:
        date = f"{r['y']}-{r['m']}-{r['d']}"
        out += [f"d:{date}:{c}" for c in initials]
        out += [f"x:{r['y']}-{r['d']}-{r['m']}:{h}" for h in heads]  # day and month exchanged meets x of the other side
        out += [f"x:{date}:{h}" for h in heads]
    pairs = [f"{a}|{b}" for i, a in enumerate(heads) for b in heads[i + 1 :]]
    if r["y"]:
        out += [f"y:{r['y']}:{p}" for p in pairs]
        if town:
            out += [f"c:{r['y']}:{town}:{a}|{b}" for i, a in enumerate(initials) for b in initials[i + 1 :]]
    if r["road"] and r["number"]:
        out += [f"s:{r['road']}:{r['number']}:{town}:{h}" for h in heads]
    if town:
        out += [("n:" if r["y"] else "N:") + f"{town}:{p}" for p in pairs]
    return out


_RECORD = "id string, name string, y int, m int, d int, city string, road string, number string, phone string, email string, keys array<string>"


def _records(batches: Iterator[pa.RecordBatch], of: dict[str, tuple[str, ...]]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for fields in b.column("fields").to_pylist():
            r = _normal(dict(fields or ()), of)
            r["keys"] = _keys(r)
            rows.append(r)
        text, number = pa.string(), pa.int32()
        types = {"name": text, "y": number, "m": number, "d": number, "city": text, "road": text, "number": text, "phone": text, "email": text, "keys": pa.list_(text)}
        yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array([r[k] for r in rows], t) for k, t in types.items()]], names=["id", *types])


def normalised(df: DataFrame, of: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per record with comparable attributes; absent keys, nulls and texts for missing become empty or 0."""
    return df.select(F.col("id").cast("string").alias("id"), F.col("fields").cast("map<string,string>").alias("fields")).filter("id is not null").mapInArrow(lambda it: _records(it, of), _RECORD)


def _meet(l: DataFrame, r: DataFrame, on: list[str]) -> DataFrame:
    """(a, b, w, k, a_dated, b_dated): every pair of rows that are equal in ``on``; both sides carry the sizes nl and nr of their value.

    Values whose sides have at most SLICE rows are joined as they lie. Above that a side is cut into slices of that many
    by a hash of the record, and each of its slices meets each of the other side, so no task holds a whole hot key.
    """
    hot = (F.col("nl") > SLICE) | (F.col("nr") > SLICE)
    out = ["a", "b", "w", "k", "a_dated", "b_dated", "loose"]
    flat = l.filter(~hot).join(r.filter(~hot).drop("nl", "nr"), on).select(*out)
    slices = lambda n: F.ceil(F.col(n) / SLICE).cast("int")
    own = lambda c, n: F.pmod(F.xxhash64(c), slices(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), slices(n) - 1))
    x = l.filter(hot).withColumn("i", own("a", "nl")).withColumn("j", each("nr"))
    y = r.filter(hot).withColumn("j", own("b", "nr")).withColumn("i", each("nl")).drop("nl", "nr")
    return flat.unionByName(x.join(y, [*on, "i", "j"]).select(*out))


def _sized(l: DataFrame, r: DataFrame, on: list[str]) -> DataFrame:
    """on, nl, nr: the values that both sides have, with their rows on either side; counted in one aggregation."""
    both = l.select(*on, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(r.select(*on, F.lit(0).alias("x"), F.lit(1).alias("y")))
    return both.groupBy(*on).agg(F.sum("x").alias("nl"), F.sum("y").alias("nr")).filter("nl > 0 and nr > 0")


def candidate_graph(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, weight): pairs that share keys, weighted by the rarity of what they share, pruned at both ends.

    All holders of a key meet, however many there are (see _meet). A key weighs log(records / holders), once for a pair;
    under a key held by HOT_SHARE of all records, pairs of equal whole names weigh as the holders of key and name do, so
    they stand out and no other spelling is lost. Keys n:/N: (place and name, for records without a date of birth) meet
    only if one side lacks the date. Keys travel as 64-bit hashes: a clash of two keys adds candidates, never drops one.
    """
    # n: and N: name the same place; N: records give both spellings so that the join pairs N with n and N.
    spelled = F.explode(F.when(F.col("k").startswith("N:"), F.array("k", F.concat(F.lit("n"), F.expr("substring(k, 2)")))).otherwise(F.array("k")))
    numbered = lambda x, n: x.select(F.col("id").alias(n), (F.col("y") > 0).alias(f"{n}_dated"), F.explode(F.array_distinct("keys")).alias("k")).withColumn("k", spelled)
    l, r = (numbered(x, n).withColumn("loose", F.col("k").startswith("n:")).withColumn("k", F.xxhash64("k")) for x, n in ((left, "a"), (right, "b")))
    l, total = l.drop("loose"), left.count() + right.count()
    sizes = materialise(_sized(l, r, ["k"]), "key-sizes")
    weigh = lambda x: x.withColumn("w", F.log(F.lit(total) / (F.col("nl") + F.col("nr"))))
    met = _meet(weigh(l.join(sizes, "k")), r.join(sizes, "k"), ["k"])
    hot = sizes.filter(F.col("nl") + F.col("nr") >= HOT_SHARE * total)  # at most (keys of a record) / HOT_SHARE of them
    if not hot.isEmpty():
        plain = F.broadcast(hot.select("k", F.log(F.lit(total) / (F.col("nl") + F.col("nr"))).alias("plain")))
        named = lambda x, side, n: x.join(plain, "k").join(side.filter("name <> ''").select(F.col("id").alias(n), F.xxhash64(F.array_sort(F.split("name", " "))).alias("name")), n)
        x, y = named(l, left, "a"), named(r, right, "b").drop("plain")
        whole = materialise(_sized(x, y, ["k", "name"]), "name-sizes")
        added = weigh(x.join(whole, ["k", "name"])).withColumn("w", F.col("w") - F.col("plain"))
        met = met.unionByName(_meet(added, y.join(whole, ["k", "name"]), ["k", "name"]))  # what equal names add to the weight of the key
    # Dealt by the left record: the pairs' sums, the best of each left record and the join with it need no further shuffle.
    firm = F.max((~(F.col("loose") & F.col("a_dated") & F.col("b_dated"))).cast("int"))
    edges = met.select("a", "b", "w", "loose", "a_dated", "b_dated").repartition("a").groupBy("a", "b").agg(F.sum("w").alias("weight"), firm.alias("firm"))
    edges = materialise(edges.filter("firm = 1").select("a", "b", "weight"), "edges")
    discard(sizes)
    top = lambda n: edges.groupBy(n).agg(F.max("weight").alias(f"t{n}"))
    return edges.join(top("a"), "a").join(top("b"), "b").filter(F.col("weight") >= KEEP_SHARE * F.least("ta", "tb")).select("a", "b", "weight")


#: Log odds above which a pair is kept, and the most that a field compared last can add.
LEAST = -6.0
_MOST = {"phone": 4.5, "city": 1.6, "road": 2.8}


def _compare(a: dict, b: dict, weight) -> float:
    """Log odds that two normalised records are one person, from the agreements and disagreements of their fields.

    Minus infinity where what is left to compare cannot lift them above LEAST.
    """
    z = -6.0
    x, y = a["name"].split(), b["name"].split()
    if x and y:
        weighted, plain, n = names.soft_similarity(x, y, weight)
        s = names.or_as_one_word(x, y, min(weighted, plain))
        full = min(len(x), len(y)) >= 2
        if s >= 0.8 and full:
            rare = sum(min(1.0, weight(t)) for t in x) / len(x)
            z += (3.0 + 4.0 * rare) * (s - 0.3)
            if min(sum(len(t) > 1 for t in x), sum(len(t) > 1 for t in y)) < 2:
                z -= 1.2  # a given name that is only an initial
        elif s >= 0.8:
            z += 1.0
        elif n and plain >= 0.45:
            z -= 3.0  # a shared surname with another given name: the household, not the person
        else:
            z -= 6.0
    else:
        z -= 1.0
    if a["y"] and b["y"]:
        if a["m"] and b["m"]:
            same = (a["y"] == b["y"]) + (a["m"] == b["m"]) + (a["d"] == b["d"])
            if same == 3:
                z += 6.5
            elif a["y"] == b["y"] and a["m"] == b["d"] and a["d"] == b["m"]:
                z += 4.0
            elif abs(_day(a) - _day(b)) <= 31:
                z += 2.5  # off by a day, ten days or a month: a slip rather than another person
            elif same == 2:
                z += 0.0
            else:
                z -= 5.0
        else:
            z += 2.3 if a["y"] == b["y"] else -4.0
    if a["email"] and b["email"]:
        if a["email"] == b["email"]:
            z += 6.5
        else:
            p, q = (re.sub(r"[^a-z0-9]", "", e.split("@")[0]) for e in (a["email"], b["email"]))
            z += 3.5 if p == q else -0.8
    known = [k for k in _MOST if a[k] and b[k]]
    if z + sum(_MOST[k] for k in known) < LEAST - 0.1:
        return -math.inf
    if a["phone"] and b["phone"]:
        z += 4.5 if a["phone"] == b["phone"] else (2.0 if names.edit_similarity(a["phone"], b["phone"]) > 0.8 else -0.5)
    if a["city"] and b["city"]:
        z += 1.6 if same_place(a["city"], b["city"]) else -1.0
    if a["road"] and b["road"]:
        if names.edit_similarity(a["road"], b["road"]) >= 0.8:
            z += 2.8 if a["number"] and a["number"] == b["number"] else (1.0 if not (a["number"] and b["number"]) else -0.3)
        else:
            z -= 0.7
    return z


def _day(r: dict) -> int:
    return r["y"] * 365 + (r["m"] - 1) * 30 + r["m"] // 2 + r["d"]


def same_place(a: str, b: str) -> bool:
    if a == b:
        return True
    x, y = a.split(), b.split()
    if len(x) == len(y) and all(p == q or (len(p) == 1 or len(q) == 1) and p[0] == q[0] for p, q in zip(x, y)):
        return True
    return names.edit_similarity(a, b) >= 0.8


_FACTS = ["name", "y", "m", "d", "city", "road", "number", "phone", "email"]


def _score(batches: Iterator[pa.RecordBatch], counters, total: int) -> Iterator[pa.RecordBatch]:
    from zlib import crc32

    top, size = math.log(total + 1), len(counters)

    known: dict[str, float] = {}

    def weight(t: str) -> float:
        got = known.get(t)
        if got is None:
            if len(known) > names.REMEMBERED:
                known.clear()
            got = known[t] = float(max(0.15, math.log((total + 1) / (counters[crc32(t.encode()) % size] + 0.5)) / top) * (0.5 if len(t) == 1 else 1.0))
        return got

    for b in batches:
        left = [dict(zip(_FACTS, v)) for v in zip(*[b.column(f"a_{c}").to_pylist() for c in _FACTS])]
        right = [dict(zip(_FACTS, v)) for v in zip(*[b.column(f"b_{c}").to_pylist() for c in _FACTS])]
        z = [_compare(x, y, weight) for x, y in zip(left, right)]
        home = [None if not (x["road"] and x["number"] and y["road"] and y["number"]) else f"{x['road']} {x['number']} {x['city']}|{y['road']} {y['number']} {y['city']}" for x, y in zip(left, right)]
        yield pa.record_batch([b.column("a"), b.column("b"), pa.array(z, pa.float64()), pa.array(home, pa.string())], names=["a", "b", "z", "home"])


def link(left: DataFrame, right: DataFrame, left_fields: dict = LEFT_FIELDS, right_fields: dict = RIGHT_FIELDS) -> DataFrame:
    """(left_id, right_id, confidence): pairs that describe the same person, each with a confidence of 0.5 or more.

    One record can have more than one counterpart. Records whose fields are all missing match nothing; repeated ids are
    separate records of one id; an empty side gives an empty result.

    Confidence is the logistic of the field evidence plus support: the mean confidence of other pairs between the same
    two addresses (households meet as a whole), from which the pair's own part is taken; and minus doubt, if either end
    has a far better partner whose record is a rival. Support is an aggregate per pair of addresses, so no pairs of pairs
    are formed. Rounds end when no confidence moves by STABLE or more; if that is not so after MAX_ROUNDS, an error is
    raised. Pairs without another pair of their two addresses have no support and stay out of the rounds.
    """
    from kinloom.llm.variants import TOKEN_COUNTERS
    import numpy as np

    l, r = materialise(normalised(left, left_fields), "left"), materialise(normalised(right, right_fields), "right")
    total = l.count() + r.count()
    counters = np.zeros(TOKEN_COUNTERS, dtype=np.int64)
    tokens = l.select("name").unionAll(r.select("name")).select(F.explode(F.split("name", " ")).alias("t")).filter("t <> ''")
    for code, n in tokens.groupBy((F.crc32(F.col("t").cast("binary")) % TOKEN_COUNTERS).alias("k")).count().collect():  # at most TOKEN_COUNTERS rows
        counters[code] = n
    sent = left.sparkSession.sparkContext.broadcast(counters)
    side = lambda x, n: x.select(F.col("id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in _FACTS])
    full = candidate_graph(l, r).select("a", "b").join(side(l, "a"), "a").join(side(r, "b"), "b")
    scored = materialise(full.mapInArrow(lambda it: _score(it, sent.value, total), "a string, b string, z double, home string").filter(F.col("z") > LEAST), "scores")
    best_a = scored.groupBy("a").agg(F.max("z").alias("za"))
    best_b = scored.groupBy("b").agg(F.max("z").alias("zb"))
    doubt = F.when((F.col("za") - F.col("z") > 6) | (F.col("zb") - F.col("z") > 6), 1.0).otherwise(0.0)
    judged = scored.join(best_a, "a").join(best_b, "b").select("a", "b", "home", (F.col("z") - 1.5 * doubt).alias("z"), (1 / (1 + F.exp(-F.col("z")))).alias("c"))
    homes = scored.filter("home is not null").groupBy("home").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("home", F.lit(True).alias("shared"))
    judged = materialise(judged.filter("home is not null").join(homes, "home", "left").unionByName(judged.filter("home is null").withColumn("shared", F.lit(None).cast("boolean"))), "pairs")
    discard(scored)
    logistic = lambda z: 1 / (1 + F.exp(-z))
    alone = judged.filter("shared is null").select("a", "b", logistic(F.col("z")).alias("c"))
    now, written = judged.filter("shared").select("a", "b", "home", "z", "c"), None
    for _ in range(MAX_ROUNDS):
        said = now.groupBy("home").agg(F.sum("c").alias("sum_c"))
        support = F.least(F.lit(1.0), F.col("sum_c") - F.col("c"))
        after = now.join(said, "home").select("a", "b", "home", "z", logistic(F.col("z") + support).alias("c"), F.col("c").alias("was"))
        after = materialise(after, "support")
        moved = after.agg(F.max(F.abs(F.col("c") - F.col("was")))).first()[0] or 0.0
        if written is not None:
            discard(written)
        now = written = after
        if moved < STABLE:
            break
    else:
        raise RuntimeError(f"confidences still move by {moved:.3f} after {MAX_ROUNDS} rounds")
    found = alone.unionByName(now.select("a", "b", "c")).filter(F.col("c") >= CONFIDENT)
    return found.select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), F.col("c").alias("confidence"))
