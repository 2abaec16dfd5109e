"""Names as people type them: folding, tokens, q-grams and the soft similarity of two token lists."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from zlib import crc32

#: Texts that stand for a missing value, and tokens that carry no identity (fixed values).
MISSING = frozenset({"", "-", "none", "nan", "null", "n/a", "na", "unknown"})
TITLES = frozenset("mr mrs ms miss dr prof sir jr sr ii iii iv phd md esq".split())
LINKING = frozenset("and und et y the".split())
#: Letters that do not decompose (fixed values).
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})
#: Short forms that share too little with the full name to be seen by their letters (fixed values).
SHORT_FORMS: dict[str, tuple[str, ...]] = {
    "bill": ("william",), "billy": ("william",), "will": ("william",), "liam": ("william",),
    "bob": ("robert",), "bobby": ("robert",), "rob": ("robert",), "robbie": ("robert",), "dick": ("richard",), "rick": ("richard",), "richie": ("richard",),
    "ted": ("theodore", "edward"), "theo": ("theodore",), "ned": ("edward",), "ed": ("edward",), "eddie": ("edward",),
    "kit": ("christopher", "katherine"), "chris": ("christopher", "christine"), "kate": ("katherine",), "kathy": ("katherine",), "katie": ("katherine",),
    "sue": ("susannah", "susan"), "susie": ("susannah", "susan"), "liz": ("elizabeth",), "beth": ("elizabeth",), "betty": ("elizabeth",), "lizzie": ("elizabeth",), "eliza": ("elizabeth",),
    "peggy": ("margaret",), "meg": ("margaret",), "maggie": ("margaret",), "greta": ("margaret",), "rita": ("margaret",), "dot": ("dorothy",), "dolly": ("dorothy",), "nell": ("eleanor",), "nora": ("eleanor",), "ellie": ("eleanor",),
    "chuck": ("charles",), "charlie": ("charles",), "jack": ("john",), "mike": ("michael",), "mick": ("michael",), "alex": ("alexander", "aleksandra"), "sandy": ("alexander",), "sasha": ("alexander", "aleksandra"), "xander": ("alexander",),
    "tony": ("anthony",), "fred": ("frederick",), "freddie": ("frederick",), "ray": ("raymond",), "archie": ("archibald",), "ben": ("benedict", "benjamin"), "bart": ("bartholomew",), "max": ("maximilian",), "zach": ("zachariah",), "gus": ("augustine",),
    "pepe": ("jose",), "peppe": ("giuseppe",), "peppino": ("giuseppe",), "nacho": ("ignacio",), "paco": ("francisco",), "pancho": ("francisco",), "kostas": ("konstantinos",), "klaus": ("nikolaus",), "lupe": ("guadalupe",), "lupita": ("guadalupe",),
    "pippa": ("philippa",), "bella": ("isabella",), "izzy": ("isabella",), "linda": ("rosalind",), "ros": ("rosalind",), "etta": ("henrietta",), "hetty": ("henrietta",), "gail": ("abigail",), "abby": ("abigail",), "pat": ("patricia", "patrick"), "trish": ("patricia",), "dima": ("dmitri",), "mo": ("mohammed",),
}
#: What is read or heard alike (fixed values).
CONFUSED = (("rn", "m"), ("cl", "d"), ("0", "o"), ("1", "l"), ("oe", "o"), ("ue", "u"), ("ae", "a"), ("y", "i"), ("k", "c"), ("z", "s"), ("w", "v"))
_TOKEN = re.compile(r"[^\W_]+")
_JOINED = re.compile(r"(?<=\w)['’`´\-‐‑](?=\w)")
GRAM_CODES = 1 << 16
#: Comparisons that a Python worker remembers of each kind. Workers outlive a job and two share an executor, so this bounds what stays.
REMEMBERED = 1 << 14


def fold(text: str) -> str:
    """Lower case without marks; a few letters that have no decomposition are replaced."""
    text = text.lower()
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).translate(LETTERS)


def tokens(*parts: str | None) -> list[str]:
    """Identity-bearing tokens of name parts in order; hyphens and apostrophes join, titles and linking words go."""
    out: list[str] = []
    for p in parts:
        if p is None or p.strip().lower() in MISSING:
            continue
        found = _TOKEN.findall(_JOINED.sub("", fold(p)))
        out += [t for t in found if t not in TITLES and t not in LINKING]
    return out


@lru_cache(maxsize=200_000)
def _token_grams(token: str) -> tuple[int, ...]:
    padded = f"^{token}$"
    out = [crc32(b"." + token[0].encode()), *(crc32(padded[i : i + 3].encode()) for i in range(len(padded) - 2))]
    if 2 <= len(token) <= 5:
        out.append(crc32(b"@" + token.encode()))
    return tuple(code % GRAM_CODES for code in out)


def grams(toks: list[str], heads: str = "") -> list[int]:
    """Codes of the distinct q-grams (q = 3, padded) and initials of all tokens.

    ``heads`` are the first letters of all words of a name, linking words included; from three words on, its beginnings
    meet tokens of two to five letters, so that an acronym shares a code with the name it stands for.
    """
    out = {code for t in toks for code in _token_grams(t)}
    if len(heads) >= 3:
        out.update(crc32(b"@" + heads[:n].encode()) % GRAM_CODES for n in range(2, min(5, len(heads)) + 1))
    return sorted(out)


def heads(*parts: str | None) -> str:
    """The first letters of all words of name parts in order, linking words included, titles not."""
    words = [t for p in parts if p is not None and p.strip().lower() not in MISSING for t in _TOKEN.findall(_JOINED.sub("", fold(p)))]
    return "".join(t[0] for t in words if t not in TITLES)


@lru_cache(maxsize=REMEMBERED)
def edit_similarity(a: str, b: str) -> float:
    """1 - optimal string alignment distance / longer length."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    before, row = None, list(range(m + 1))
    for i in range(1, n + 1):
        current = [i] + [0] * m
        ca = a[i - 1]
        for j in range(1, m + 1):
            cb = b[j - 1]
            best = row[j - 1] + (ca != cb)
            if row[j] + 1 < best:
                best = row[j] + 1
            if current[j - 1] + 1 < best:
                best = current[j - 1] + 1
            if before is not None and j > 1 and ca == b[j - 2] and a[i - 2] == cb and before[j - 2] + 1 < best:
                best = before[j - 2] + 1
            current[j] = best
        before, row = row, current
    return 1 - row[m] / max(n, m)


def _in_common(a: str, b: str) -> int:
    """How many letters two texts have in common, whatever their order."""
    n = len(b)
    for c in a:
        if c in b:
            b = b.replace(c, "", 1)
    return n - len(b)


def _skeleton(short: str, long: str) -> bool:
    """Whether a short form keeps the first letter, and the last or no vowels, and picks the rest in order, as in hldgs for holdings."""
    if len(short) < 3 or len(short) >= len(long) or short[0] != long[0] or (short[-1] != long[-1] and any(c in "aeiou" for c in short)):
        return False
    it = iter(long)
    return all(c in it for c in short)


@lru_cache(maxsize=REMEMBERED)
def token_similarity(a: str, b: str) -> float:
    """How far two tokens can be forms of one name: typing errors, short forms, truncations, initials."""
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return 0.8 if a == b[0] else 0.0
    if b in SHORT_FORMS.get(a, ()) or a in SHORT_FORMS.get(b, ()):
        return 0.95
    if b.startswith(a) and (len(a) >= 3 or len(b) >= 5):
        return 0.9
    # Letters in common bound the edit similarity from above; unrelated tokens end here, without a table.
    if _in_common(a, b) / len(b) < 0.6:
        return 0.85 if _skeleton(a, b) else 0.0
    s = edit_similarity(a, b)
    if 0.5 <= s < 0.97:
        for looks, like in CONFUSED:
            if looks in a or looks in b:
                s = max(s, 0.97 * edit_similarity(a.replace(looks, like), b.replace(looks, like)))
    return max(s, 0.85) if _skeleton(a, b) else s


def soft_similarity(a: list[str], b: list[str], weight, least: float = 0.72) -> tuple[float, float, int]:
    """(weighted, plain, tokens matched) similarity of two token lists.

    Tokens are paired greedily, best first. The weighted score shares out the weight of the list that says less, so that
    additions of the fuller one cost little; rare tokens count more. The plain score counts tokens alike. A single letter
    left over on either side (a middle initial) costs nothing.
    """
    pairs = sorted([(s, -abs(i - j), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (s := token_similarity(x, y)) >= least], reverse=True)
    if not pairs:
        return 0.0, 0.0, 0
    used_a, used_b, got, plain, mass = set(), set(), 0.0, 0.0, 0.0
    for s, _, i, j in pairs:
        if i in used_a or j in used_b:
            continue
        used_a.add(i)
        used_b.add(j)
        w = (weight(a[i]) + weight(b[j])) / 2
        got += s * w
        mass += w
        plain += s
    left_a = [t for i, t in enumerate(a) if i not in used_a and len(t) > 1]
    left_b = [t for j, t in enumerate(b) if j not in used_b and len(t) > 1]
    spare_a, spare_b = sum(map(weight, left_a)), sum(map(weight, left_b))
    n = len(used_a)
    light, few = min(spare_a, spare_b), min(len(left_a), len(left_b))
    more, many = max(spare_a, spare_b) - light, max(len(left_a), len(left_b)) - few
    weighted = got / (mass + light + 0.12 * more) if mass else 0.0
    return weighted, plain / (n + few + 0.12 * many) if n else 0.0, n


#: How rare a token must be beside a similar one to count as a slip of the pen of it.
SLIP_SHARE = 0.05
LOOSE = 0.5


def compare(a: list[str], b: list[str], weight, count, least: float = 0.72) -> tuple[float, float, tuple[str, str] | None, list[tuple[str, str, float]]]:
    """(score, information, the one pair of tokens that contradict each other or None, matched tokens) of two token lists.

    Tokens are paired as in :func:`soft_similarity`. What is left over on both sides is paired once more if it may be a
    badly damaged spelling (it agrees in LOOSE of its letters and one of the two is rare beside the other), one word
    written as two, or an acronym. ``weight`` is the information of a token in units of 1 for the rarest, ``count``
    its frequency. Information is the sum of what the matched tokens say.
    """
    pairs = sorted([(s, -abs(i - j), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (s := token_similarity(x, y)) >= least], reverse=True)
    left_a, left_b = set(range(len(a))), set(range(len(b)))
    got: list[tuple[str, str, float]] = []
    for s, _, i, j in pairs:
        if i in left_a and j in left_b:
            left_a.discard(i)
            left_b.discard(j)
            got.append((a[i], b[j], s))
    if left_a and left_b:
        _pair_the_rest(a, b, left_a, left_b, got, count)
    rest_a, rest_b = [a[i] for i in sorted(left_a) if len(a[i]) > 1], [b[j] for j in sorted(left_b) if len(b[j]) > 1]
    mass = sum((weight(x) + weight(y)) / 2 for x, y, _ in got)
    hit = sum((weight(x) + weight(y)) / 2 * s for x, y, s in got)
    spare_a, spare_b = sum(map(weight, rest_a)), sum(map(weight, rest_b))
    light, few = min(spare_a, spare_b), min(len(rest_a), len(rest_b))
    more, many = max(spare_a, spare_b) - light, max(len(rest_a), len(rest_b)) - few
    n = len(got)
    score = min(hit / (mass + light + 0.12 * more), sum(s for _, _, s in got) / (n + few + 0.12 * many)) if mass else 0.0
    score = or_as_one_word(a, b, score)
    told = sum(min(weight(x), weight(y)) * s * s for x, y, s in got) if got else (min(sum(map(weight, a)), sum(map(weight, b))) * score)
    apart = (rest_a[0], rest_b[0]) if len(rest_a) == 1 and len(rest_b) == 1 else None
    return score, told, apart, got


def _pair_the_rest(a: list[str], b: list[str], left_a: set[int], left_b: set[int], got: list[tuple[str, str, float]], count) -> None:
    loose = []
    for i in left_a:
        for j in left_b:
            x, y = a[i], b[j]
            if min(len(x), len(y)) < 3:
                continue
            few, many = sorted((count(x), count(y)))
            if few <= 1 or few <= SLIP_SHARE * many:
                s = _loosely_alike(x, y)
                if s >= LOOSE:
                    loose.append((s, i, j))
    for s, i, j in sorted(loose, reverse=True):
        if i in left_a and j in left_b:
            left_a.discard(i)
            left_b.discard(j)
            got.append((a[i], b[j], max(s, 0.6)))
    for one, two, left_one, left_two, turned in ((a, b, left_a, left_b, False), (b, a, left_b, left_a, True)):
        for i in sorted(left_one):
            # One word written as two: two neighbours of the other side, one of them left over.
            for j in range(len(two) - 1):
                if i in left_one and (j in left_two and j + 1 in left_two) and token_similarity(one[i], two[j] + two[j + 1]) >= 0.75:
                    left_one.discard(i)
                    left_two -= {j, j + 1}
                    pair = (one[i], two[j] + two[j + 1])
                    got.append((*(pair[::-1] if turned else pair), 0.9))
            if i in left_one and 2 <= len(one[i]) <= 5 and len(left_two) >= 2:
                first = "".join(two[j][0] for j in sorted(left_two))
                if one[i] == first or any(one[i][:k] + one[i][k + 1 :] == first for k in range(1, len(one[i])) if one[i][k] in "aeuy"):
                    left_one.discard(i)
                    pair = (one[i], max((two[j] for j in left_two), key=len))
                    left_two.clear()
                    got.append((*(pair[::-1] if turned else pair), 0.9))


@lru_cache(maxsize=REMEMBERED)
def _loosely_alike(x: str, y: str) -> float:
    """How far two tokens agree as spelled, as heard or in their letters; below LOOSE it may say less."""
    p, q = _as_heard(x), _as_heard(y)
    # Letters in common bound the edit similarity from above, as in token_similarity.
    edits = [edit_similarity(a, b) for a, b in ((x, y), (p, q)) if _in_common(a, b) >= LOOSE * max(len(a), len(b))]
    return max([0.8 * _common_letters(x, y), *edits])


def _as_heard(t: str) -> str:
    for looks, like in CONFUSED:
        t = t.replace(looks, like)
    return t


def _common_letters(x: str, y: str) -> float:
    """Share of letters in common, whatever their order, of words of one length or nearly so."""
    return _in_common(x, y) / max(len(x), len(y)) if abs(len(x) - len(y)) <= 1 else 0.0


def same_name(a: list[str], b: list[str], weight) -> float:
    """0..1: the lower of the weighted and the plain token score, or the similarity of the names written as one word."""
    if not a or not b:
        return 0.0
    weighted, plain, _ = soft_similarity(a, b, weight)
    return or_as_one_word(a, b, min(weighted, plain))


def or_as_one_word(a: list[str], b: list[str], score: float) -> float:
    if score >= 0.85:
        return score
    x, y = "".join(a), "".join(b)
    if min(len(x), len(y)) < 0.85 * max(len(x), len(y)):
        return score
    one, two = "".join(sorted(a, key=len, reverse=True)), "".join(sorted(b, key=len, reverse=True))
    whole = max(edit_similarity(x, y), edit_similarity(one, two)) if _in_common(x, y) >= 0.8 * max(len(x), len(y)) else 0.0
    return max(score, whole) if whole >= 0.88 else score
