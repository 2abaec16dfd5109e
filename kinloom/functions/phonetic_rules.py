"""Phonetic encoders of single strings (pure Python, no Spark): rule tables read by one scanner."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import groupby, islice, product

_NOT_LETTER = re.compile(r"[^A-Za-z]+")


def letters(s: str) -> str:
    """ASCII letters in upper case; every encoder but Beider-Morse and language detection sees only these."""
    return _NOT_LETTER.sub("", s).upper()


class Scanner:
    """Reads a word from left to right; at each place the first rule that matches says what to write and how much was read.

    Rules are lines "pattern > output"; a pattern may look behind and ahead. Letters no rule matches are passed over.
    Several outputs are separated by a blank (one per returned string).
    """

    def __init__(self, rules: str, strings: int = 1) -> None:
        self.outputs: list[tuple[str, ...]] = []
        patterns = []
        for line in rules.strip().splitlines():
            pattern, _, out = (x.strip() for x in line.partition(">>"))
            parts = tuple(out.split()) or ("",)
            self.outputs.append(parts * strings if len(parts) == 1 else parts)
            patterns.append(f"({pattern})")
        self.match = re.compile("|".join(patterns)).match
        self.strings = strings

    def read(self, word: str, start: int = 0) -> tuple[str, ...]:
        got: list[tuple[str, ...]] = []
        at, end = start, len(word)
        while at < end:
            m = self.match(word, at)
            if m is None:
                at += 1
                continue
            got.append(self.outputs[m.lastindex - 1])
            at = m.end()
        return tuple("".join(g[i] for g in got) for i in range(self.strings))


def _runs(s: str) -> str:
    return "".join(c for c, _ in groupby(s))


_SOUNDEX = str.maketrans("BFPVCGJKQSXZDTLMNR", "111122222222334556")
_SILENT_START = re.compile(r"^(?:AE|GN|KN|PN|WR)")
_SAME_AS_BEFORE = "\n".join(f"(?<={c}){c} >>" for c in "ABDEFGHIJKLMNOPQRSTUVWXYZ")
_METAPHONE = Scanner(
    _SAME_AS_BEFORE
    + r"""
^A >> A
^E >> E
^I >> I
^O >> O
^U >> U
(?<!M)B|B\Z >> B
CH >> X
C(?=IA) >> X
C(?=[EIY]) >> S
C >> K
D(?=G[EIY]) >> J
D >> T
F >> F
GH(?=[^AEIOU]) >>
(?<=.)G(?=N) >>
G(?=[EIY]) >> J
G >> K
(?<![AEIOU])H(?=[AEIOU]) >> H
J >> J
(?<!C)K >> K
L >> L
M >> M
N >> N
PH >> F
P >> P
Q >> K
R >> R
SH|SI(?=[AO]) >> X
S >> S
TH >> 0
T(?=I[AO]) >> X
T >> T
V >> F
W(?=[AEIOU]) >> W
Y(?=[AEIOU]) >> Y
X >> KS
Z >> S"""
)
_DOUBLE_METAPHONE = Scanner(
    r"""
^[AEIOU] >> A
BB? >> P
CH >> X
C(?=[EIY]) >> S
CC? >> K
DG(?=[EIY]) >> J
DD? >> T
FF? >> F
GH(?=[AEIOU]) >> K
GH >>
G(?=[EIY]) >> J K
GG? >> K
(?<![AEIOU])H(?=[AEIOU]) >> H
JJ? >> J H
KK? >> K
LL? >> L
MM? >> M
NN? >> N
PH >> F
PP? >> P
QQ? >> K
RR? >> R
SH >> X
SC[EIY] >> S
SS? >> S
TH >> T 0
TT? >> T
VV? >> F
[WY](?=[AEIOU]) >> A
XX? >> KS
ZZ? >> S""",
    strings=2,
)
_COLOGNE = Scanner(
    r"""
[AEIOUJY] >> 0
P(?=H) >> 3
[BP] >> 1
[DT](?=[CSZ]) >> 8
[DT] >> 2
[FVW] >> 3
[GKQ] >> 4
X >> 48
L >> 5
[MN] >> 6
R >> 7
[SZ] >> 8
^C(?=[AHKLOQRUX])|(?<=[AHKLOQRUX])C >> 4
C >> 8"""
)


def soundex(s: str) -> str:
    word = letters(s)
    if not word:
        return "0000"
    # H and W are transparent: drop them behind the first letter, then vowels and Y separate equal codes.
    head, rest = word[0], re.sub("[HW]", "", word[1:])
    codes = (head + rest).translate(_SOUNDEX)
    kept = [c for before, c in zip(codes, codes[1:]) if c != before and c.isdigit()]
    return (head + "".join(kept) + "000")[:4]


def metaphone(s: str) -> str:
    word = letters(s)
    return _METAPHONE.read(word, 1 if _SILENT_START.match(word) else 0)[0]


def double_metaphone(s: str) -> tuple[str, str]:
    word = letters(s)
    primary, alternate = _DOUBLE_METAPHONE.read(word, 1 if _SILENT_START.match(word) else 0)
    return primary[:4], alternate[:4]


_NYSIIS_START = ((re.compile("^MAC"), "MCC"), (re.compile("^KN"), "N"), (re.compile("^K"), "C"), (re.compile("^P[HF]"), "FF"), (re.compile("^SCH"), "SSS"))
_NYSIIS_END = ((re.compile(r"(?:EE|IE)\Z"), "Y"), (re.compile(r"(?:DT|RT|RD|NT|ND)\Z"), "D"))
_NYSIIS_BODY = re.compile(r"(EV)|([AEIOU])|(Q)|(Z)|(M)|(K(?=N))|(K)|(SCH)|(PH)|((?<=[AEIOU])H(?=[^AEIOU]))|((?<=[^AEIOU])H)|((?<=[AEIOU])W)|(.)")
_NYSIIS_OUT = ("AF", "A", "G", "S", "N", "N", "C", "SSS", "FF", "A")


def nysiis(s: str) -> str:
    word = letters(s)
    for rules in (_NYSIIS_START, _NYSIIS_END):
        for pattern, out in rules:
            if pattern.search(word):
                word = pattern.sub(out, word)
                break
    if not word:
        return ""
    code, at = word[0], 1
    while at < len(word):
        m = _NYSIIS_BODY.match(word, at)
        which = m.lastindex
        code += _NYSIIS_OUT[which - 1] if which <= len(_NYSIIS_OUT) else (word[at - 1] if which <= 12 else m[0])
        at = m.end()
    if len(code) > 1:
        code = re.sub(r"S\Z", "", code)
    code = re.sub(r"AY\Z", "Y", code)
    if len(code) > 1:
        code = re.sub(r"A\Z", "", code)
    return _runs(code)[:6]


#: Replacements of the encoding, in order (fixed values).
_CAVERPHONE = [x.split("=") for x in "cough=cof2 rough=rof2 tough=tof2 enough=enof2 trough=trof2 gn=2n mb=m2 cq=2q ci=si ce=se cy=sy tch=2ch c=k q=k x=k v=f dg=2g tio=sio tia=sia d=t ph=fh b=p sh=s2 z=s".split()]


def caverphone(s: str) -> str:
    word = letters(s).lower()
    if word.endswith("e"):
        word = word[:-1]
    if not word:
        return "1" * 10
    for old, new in _CAVERPHONE:
        word = word.replace(old, new)
    word = re.sub("^[aeiou]", "A", word)
    word = re.sub("[aeiou]", "3", word)
    word = re.sub("(?<=[^A3])h", "", word)
    return (_runs(re.sub("[23]", "", word)).upper() + "1" * 10)[:10]


def cologne_phonetic(s: str) -> str:
    """A word of H alone has no code and gives an empty string."""
    code = _runs(_COLOGNE.read(letters(s))[0])
    return code if len(code) <= 1 else code.replace("0", "") or "0"


def phonex(s: str) -> str:
    word = letters(s)
    if not word:
        return "0000"
    rest = re.sub("^(?:P(?=[HF])|K(?=N)|W(?=R)|A(?=E)|S(?=CH)|[HWY])", "", word)
    if not rest:
        return word[0] + "000"
    head = "V" if rest[0] in "AEIOUY" else rest[0]
    codes = (head + re.sub("[HW]", "", rest[1:])).translate(_SOUNDEX)
    kept = [c for before, c in zip(codes, codes[1:]) if c != before and c.isdigit()]
    return (head + "".join(kept) + "000")[:4]


def mra(s: str) -> str:
    word = _runs(letters(s))
    code = word[:1] + re.sub("[AEIOU]", "", word[1:])
    return code if len(code) <= 6 else code[:3] + code[-3:]


def mra_compare(a: str, b: str) -> bool:
    x, y = mra(a), mra(b)
    if not x or not y:
        return x == y
    if abs(len(x) - len(y)) > 3:
        return False
    both = len(x) + len(y)
    least = 5 if both <= 4 else 4 if both <= 7 else 3 if both <= 11 else 2
    rest, left = list(y), []
    for c in x:  # equal letters cancel, leftmost first
        if c in rest:
            rest.remove(c)
        else:
            left.append(c)
    pairs = zip(reversed(left), reversed(rest))
    unmatched = sum(2 for p, q in pairs if p != q) + abs(len(left) - len(rest))
    return 6 - unmatched >= least


#: Ordered patterns of the languages (fixed values).
LANGUAGES = (
    ("ashkenazi", r"(?=.*tz)(?=.*man)|.*(?:witz|vitz|stein|berg|feld|baum|blatt)\Z|gold|silver|rosen"),
    ("polish", r"(?!.*sch)(?=.*(?:sz|cz))|.*(?:ski|ska|icz|iak)\Z"),
    ("russian", r".*(?:ov|ev|ova|eva|enko)\Z|.*(?:kh|zh)"),
    ("german", r".*sch|.*(?:burg|dorf|mann|meier|mayer)\Z|(?=.*ei)(?=.*er)"),
    ("french", r".*(?:eau|eux|ault|ois|ais)\Z|(?=.*ou).*er\Z|de |le "),
    ("italian", r".*(?:ini|elli|etti|ucci|acci|otti|ano)\Z|(?:.*..|.*[^\x00-\x7f])ino\Z"),
    ("spanish", r".*(?:ez|az|ero)\Z|(?=.*ll).*[ao]\Z"),
    ("portuguese", r".*(?:ões|ães|eira|eiro)\Z|.*lh|(?!.*nho)(?=.*nh)"),
    ("english", r".*(?:tion|ght|ley|ton|son|ham)\Z|(?=.*th)(?=.*er)"),
)
_LANGUAGES = [(name, re.compile(p, re.S)) for name, p in LANGUAGES]


def detect_language(s: str) -> str:
    low = s.lower()
    return next((name for name, p in _LANGUAGES if p.match(low)), "generic")


#: Sounds of letter groups; alternatives are separated by a bar, an empty one is silence (fixed values).
_BM_GENERIC = """gn=n|gn kn=n pn=n wr=r mb=m sch=S|sk tch=tS tsh=tS tsch=tS ch=x|tS|S ck=k sh=S ph=f th=t gh=|g wh=w qu=kw rh=r dg=dZ
bb=b cc=k|ts dd=d ff=f gg=g hh= kk=k ll=l mm=m nn=n pp=p rr=r ss=s tt=t zz=ts|z
ae=e|aj ai=aj au=aw ay=aj ea=e|ia ee=i ei=aj|ej eo=io eu=oj|ew ey=aj|ej ie=i|ie io=io oa=o oo=u ou=u|aw ow=ow|aw oy=oj ue=u ui=i|uj
c+e=s|ts c+i=s|ts c+y=s c=k g+e=dZ|g g+i=dZ|g g+y=dZ|g g=g h=|h j=j|dZ|x q=k s=s|z w=v|w x=ks y=i|j z=z|ts
a=a b=b d=d e=e| f=f i=i k=k l=l m=m n=n o=o p=p r=r t=t u=u v=v"""
_BM_ASHKENAZI = """tz=ts tsch=tS sch=S tch=tS ch=x sh=S ph=f th=t gh=g ck=k wh=v qu=kv dg=dZ
ei=aj ey=aj ai=aj ay=aj au=aw ou=u oo=u ee=i ie=i ae=e ue=i ui=i oi=oj oy=oj
bb=b cc=k dd=d ff=f gg=g kk=k ll=l mm=m nn=n pp=p rr=r ss=s tt=t zz=ts
c+e=ts c+i=ts c+y=s c=k g=g h=|h j=j q=k s=s|z w=v x=ks y=i|j z=z|ts
a=a b=b d=d e=e| f=f i=i k=k l=l m=m n=n o=o p=p r=r t=t u=u v=v"""


def _bm_table(text: str) -> tuple[re.Pattern, dict[str, list[str]]]:
    table = {}
    for entry in text.split():
        key, _, sounds = entry.partition("=")
        table[key] = sounds.split("|")
    # Longest group first; a letter before a soft vowel ("c+e") is read alone but looks ahead.
    keys = sorted(table, key=lambda k: (-len(k.split("+")[0]), "+" not in k))
    pattern = re.compile("|".join(f"({k[0]})(?={k[-1]})" if "+" in k else f"({k})" for k in keys) + "|(.)", re.S)
    return pattern, {i + 1: table[k] for i, k in enumerate(keys)}


_BM = {False: _bm_table(_BM_GENERIC), True: _bm_table(_BM_ASHKENAZI)}
BM_VARIANTS = 32


def beider_morse(s: str, ashkenazi: bool = False) -> str:
    pattern, sounds = _BM[ashkenazi or detect_language(s) == "ashkenazi"]
    spoken = [""]
    for m in pattern.finditer(s.lower()):
        choices = sounds.get(m.lastindex, [m[0]])
        spoken = [x + y for x, y in islice(product(spoken, choices), BM_VARIANTS if len(choices) > 1 else None)]
    return "|".join(map(_runs, spoken))


#: Letter groups with their code at the start, before a vowel and elsewhere; / separates two branches, - is no code (fixed values).
_DM = """AI 0 1 -,AJ 0 1 -,AY 0 1 -,AU 0 7 -,B 7 7 7,CHS 5 54 54,CH 5/4 5/4 5/4,CK 5/45 5/45 5/45,CZ 4 4 4,CS 4 4 4,CSZ 4 4 4,C 5/4 5/4 5/4,
DRZ 4 4 4,DRS 4 4 4,DS 4 4 4,DSH 4 4 4,DSZ 4 4 4,DZ 4 4 4,DT 3 3 3,D 3 3 3,EI 0 1 -,EJ 0 1 -,EY 0 1 -,EU 1 1 -,FB 7 7 7,F 7 7 7,G 5 5 5,H 5 5 -,
IA 1 - -,IE 1 - -,IO 1 - -,IU 1 - -,J 1/4 -/4 -/4,KH 5 5 5,KS 5 54 54,K 5 5 5,L 8 8 8,MN 66 66 66,M 6 6 6,NM 66 66 66,N 6 6 6,OI 0 1 -,OJ 0 1 -,OY 0 1 -,
PH 7 7 7,P 7 7 7,Q 5 5 5,RS 94/4 94/4 94/4,RZ 94/4 94/4 94/4,R 9 9 9,SHCH 2 4 4,SCH 4 4 4,SHT 2 43 43,SH 4 4 4,STCH 2 4 4,STRZ 2 4 4,ST 2 43 43,SZCZ 2 4 4,
SZT 2 43 43,SZ 4 4 4,S 4 4 4,TCH 4 4 4,TTCH 4 4 4,TH 3 3 3,TRS 4 4 4,TRZ 4 4 4,TS 4 4 4,TSCH 4 4 4,TSH 4 4 4,TSZ 4 4 4,TZ 4 4 4,T 3 3 3,UI 0 1 -,UJ 0 1 -,
UY 0 1 -,UE 0 - -,V 7 7 7,W 7 7 7,X 5 54 54,Y 1 - -,ZDZ 2 4 4,ZHD 2 43 43,ZH 4 4 4,ZS 4 4 4,Z 4 4 4"""
_DM_CODES = {k: [[c.replace("-", "") for c in x.split("/")] for x in codes] for k, *codes in (e.split() for e in _DM.replace("\n", "").split(","))}
_DM_READ = re.compile("|".join(sorted(_DM_CODES, key=len, reverse=True)) + "|.")
DM_BRANCHES = 64


def daitch_mokotoff_codes(s: str) -> list[str]:
    """All six-digit codes of a name, sorted."""
    word = letters(s)
    branches: list[tuple[str, ...]] = [()]
    start = True
    for m in _DM_READ.finditer(word):
        entry = _DM_CODES.get(m[0])
        if entry is None:  # a lone vowel: no code, but the start is over
            start = False
            continue
        vowel_next = word[m.end() : m.end() + 1] in tuple("AEIOU")
        codes = entry[0 if start else 1 if vowel_next else 2]
        if len(branches) >= DM_BRANCHES:
            codes = codes[:1]
        branches = [b if not c or b[-1:] == (c,) else (*b, c) for b in branches for c in codes]
        start = False
    return sorted({("".join(b) + "000000")[:6] for b in branches})


def daitch_mokotoff(s: str) -> str:
    return ",".join(daitch_mokotoff_codes(s))


#: Encoder by name; the value is the string used for blocking and comparing.
ENCODERS: dict[str, Callable[[str], str]] = {
    "soundex": soundex,
    "metaphone": metaphone,
    "double_metaphone": lambda s: double_metaphone(s)[0],
    "nysiis": nysiis,
    "caverphone": caverphone,
    "cologne_phonetic": cologne_phonetic,
    "beider_morse": beider_morse,
    "phonex": phonex,
    "mra": mra,
    "match_rating_approach": mra,
    "daitch_mokotoff": daitch_mokotoff,
}
