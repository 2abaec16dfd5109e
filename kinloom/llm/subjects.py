"""Subject areas of documents: classifier chains over term, source and structure features, decoded by beam search."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: At most so many labelled documents are used for training (those with the smallest hash of their id).
MAX_LABELLED = 12_000
#: One classifier per subject is trained on the driver; more subjects are refused, never dropped.
MAX_SUBJECTS = 1_000
BEAM = 8
FOLDS = 4
#: A line of the page's body has finished sentences; menus, teasers, lists of links and headings have none (fixed values).
SENTENCE_ENDS = frozenset(".!?…。！？」』”»")
#: The end of a sentence inside a line: not the dot of a number or a host name, but also before a symbol or invisible mark.
_END = re.compile(r"[。！？」』]|[.!?…”»](?!\w)")
MIN_PASSAGE_CHARS, MIN_PASSAGE_CHARS_CJK = 25, 8
#: Runs of Han or Katakana, or words of other scripts; Hiragana separates.
_TERM = re.compile(r"[㐀-鿿々]+|[ァ-ヺー]+|[^\W\d_぀-ヿ㐀-鿿々]{3,}")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
#: What follows the one sentence of a notice or footer: words between blanks, commas and bars (fixed values).
_BETWEEN = re.compile(r"[\s,|]+")
MAX_LABEL_CHARS = 20
#: Decodings that turn UTF-8 into garbled text and can be undone (fixed values).
_WRONG = ("cp1252", "cp1251", "koi8-r")
_GARBLED = re.compile(r"[ÃÂÐÑÄÅ][\u0080-¿Œ-™]|Р[°-їВ]|С[Ѓ-џ‚ѓ„…†‡€‰]|п[╟-╬]")


def repaired(text: str) -> str:
    """The text with a wrong single-byte decoding of UTF-8 undone, if it bears the marks of one and can be."""
    marks = len(_GARBLED.findall(text))
    if marks < 3:
        return text
    for name in _WRONG:
        try:
            if name == "cp1252":  # in practice mixed with Latin-1: its unassigned bytes pass through
                raw = b"".join(bytes((ord(c),)) if ord(c) < 256 else c.encode(name, "ignore") for c in text)
            else:
                raw = text.encode(name, "ignore")
        except UnicodeError:
            continue
        again = raw.decode("utf-8", "ignore")
        left = len(_GARBLED.findall(again))
        if left < marks / 4 and len(again) > 0.35 * len(text):
            return again
    return text


def finished(line: str) -> str:
    """The line up to the end of its last finished sentence; empty if it has none, or one that only buttons or links follow."""
    if not line or line[-1] in SENTENCE_ENDS:
        return line
    ends = [m.end() for m in _END.finditer(line)]
    if not ends or len(ends) == 1 and all(_label(w) for w in _BETWEEN.split(line[ends[0] :])):
        return ""
    return line[: ends[-1]]


def _label(word: str) -> bool:
    """Whether a word can stand on a button or link of these pages: a plain word in Latin, Cyrillic, Kana or Han."""
    return not word or word.isalpha() and len(word) <= MAX_LABEL_CHARS and all(c < "ɐ" or "Ѐ" <= c <= "ӿ" or "぀" <= c <= "鿿" for c in word)


def passages(text: str | None) -> tuple[list[frozenset[str]], float]:
    """(term sets of the body's passages, share of the characters that the body holds)."""
    if not text:
        return [], 0.0
    if not text.isascii():
        text = repaired(text)
    out, body, whole = [], 0, 1
    for line in text.split("\n"):
        line = line.strip()
        whole += len(line)
        line = finished(line)
        if len(line) < MIN_PASSAGE_CHARS and not (len(line) >= MIN_PASSAGE_CHARS_CJK and _CJK.search(line)):
            continue
        body += len(line)
        out.append(frozenset(w[:-1] if len(w) > 4 and w[-1] == "s" else w for w in _TERM.findall(line.lower())))
    return out, body / whole


@dataclass
class TermWeights:
    """Positive smoothed log odds of a term under a subject, as term -> ((subject number, weight), ...)."""

    of: dict[str, tuple[tuple[int, float], ...]]
    subjects: int

    @staticmethod
    def fit(docs: list[list[frozenset[str]]], labels: np.ndarray, purity: float = 0.4, prior: float = 1.0) -> "TermWeights":
        """Only terms of which a smoothed share ``purity`` or more of the documents bear the subject get a weight: what is
        merely frequent in a rare language, whose few labels lean to one subject, stays without."""
        n, k = labels.shape
        seen: Counter[str] = Counter()
        under: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
        for terms, y in zip(docs, labels):
            for t in frozenset().union(*terms) if terms else ():
                seen[t] += 1
                under[t] += y
        base = (labels.sum(0) + 0.5) / (n + 1)
        of = {}
        for t, c in seen.items():
            if c < 2:
                continue
            share = (under[t] + prior * base) / (c + prior)
            top = [(int(s), float(np.log(share[s] / base[s]))) for s in np.flatnonzero((share >= purity) & (under[t] >= 2))]
            if top:
                of[t] = tuple(top)
        return TermWeights(of, k)

    def features(self, terms: list[frozenset[str]], body: float) -> np.ndarray:
        """subjects x features of one document; all features of a subject are relative to that subject."""
        k, of = self.subjects, self.of
        total, best, strong_best, hits = [0.0] * k, [0.0] * k, [0] * k, [0] * k
        met: dict[str, tuple[tuple[int, float], ...]] = {}
        for p in terms:
            score, strong = {}, {}
            for t in p:
                ws = of.get(t)
                if ws:
                    met[t] = ws
                    for s, w in ws:
                        score[s] = score.get(s, 0.0) + w
                        if w > 1.2:
                            strong[s] = strong.get(s, 0) + 1
            for s, x in score.items():
                if x > best[s]:
                    best[s] = x
                n = strong.get(s, 0)
                if n > strong_best[s]:
                    strong_best[s] = n
                if n >= 2:
                    hits[s] += 1
        distinct = [0] * k
        for ws in met.values():
            for s, w in ws:
                total[s] += w
                if w > 1.2:
                    distinct[s] += 1
        t = np.asarray(total)
        all_, order = t.sum(), np.sort(t)
        other = np.where(t == order[-1], order[-2] if k > 1 else 0.0, order[-1])
        m = len(terms)
        return np.stack(
            [
                np.log1p(t),
                np.log1p(best),
                np.log1p(distinct),
                np.minimum(strong_best, 4),
                np.minimum(hits, 3),
                np.asarray(hits) / max(m, 1),
                t / (all_ + 1.0),
                np.log1p(other),
                np.full(k, np.log1p(m)),
                (np.asarray(strong_best) >= 2) * 1.0,
                (np.asarray(strong_best) >= 3) * 1.0,
                np.asarray(distinct) / max(m, 1),
            ],
            axis=1,
        )


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, offset: np.ndarray | float = 0.0, rounds: int = 25) -> np.ndarray:
    """Newton's method for ridge logistic regression; the last column is the intercept and is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = _sigmoid(x @ w + offset)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class SubjectModel:
    subjects: list[str]
    sources: list[str]
    terms: TermWeights
    order: list[int]
    shared: np.ndarray
    chain: list[np.ndarray]  # per place in the order: weights of [labels before, sources, structure, own evidence, 1]

    def base(self, feats: np.ndarray) -> np.ndarray:
        return feats @ self.shared[:-1] + self.shared[-1]

    def context(self, source: list[str | None], body: np.ndarray) -> np.ndarray:
        at = {s: i for i, s in enumerate(self.sources)}
        x = np.zeros((len(source), len(self.sources) + 1))
        for i, s in enumerate(source):
            if s in at:
                x[i, at[s]] = 1
        x[:, -1] = body
        return x

    def decode(self, feats: np.ndarray, context: np.ndarray) -> np.ndarray:
        """docs x subjects of 0/1: the most probable label combination by beam search along the chain."""
        n, k = len(feats), len(self.subjects)
        base = self.base(feats)
        labels, logp = np.zeros((n, 1, k), dtype=bool), np.zeros((n, 1))
        for place, s in enumerate(self.order):
            w = self.chain[place]
            before = self.order[:place]
            z = base[:, s, None] + labels[:, :, before] @ w[:place] + (context @ w[place:-1])[:, None] + w[-1]
            p = np.clip(_sigmoid(z), 1e-9, 1 - 1e-9)
            yes = labels.copy()
            yes[:, :, s] = True
            labels = np.concatenate([labels, yes], axis=1)
            logp = np.concatenate([logp + np.log(1 - p), logp + np.log(p)], axis=1)
            if labels.shape[1] > BEAM:
                keep = np.argsort(-logp, axis=1, kind="stable")[:, :BEAM]
                labels, logp = np.take_along_axis(labels, keep[:, :, None], 1), np.take_along_axis(logp, keep, 1)
        return labels[np.arange(n), logp.argmax(1)]


def train(docs: list[list[frozenset[str]]], body: list[float], source: list[str | None], labels: np.ndarray, subjects: list[str]) -> SubjectModel:
    """Fit term weights, the evidence model all subjects share, and the chain.

    Evidence for training comes from term weights of the other folds (cross-fitting), so that the probabilities are
    calibrated for documents the weights have not seen; the final weights then use all labelled documents.
    """
    n, k = labels.shape
    fold = np.arange(n) % FOLDS
    feats = np.zeros((n, k, 12))
    for f in range(FOLDS):
        rest = [d for d, g in zip(docs, fold) if g != f]
        weights = TermWeights.fit(rest, labels[fold != f])
        for i in np.flatnonzero(fold == f):
            feats[i] = weights.features(docs[i], body[i])
    shared = _logistic(feats.reshape(n * k, -1), labels.reshape(-1).astype(float), ridge=0.3)
    sources = sorted({s for s in source if s is not None})
    order = [int(s) for s in np.argsort(-labels.sum(0), kind="stable")]
    model = SubjectModel(subjects, sources, TermWeights.fit(docs, labels), order, shared, [])
    base, context = model.base(feats), model.context(source, np.asarray(body))
    for place, s in enumerate(order):
        x = np.hstack([labels[:, order[:place]].astype(float), context])
        model.chain.append(_logistic(x, labels[:, s].astype(float), ridge=4.0, offset=base[:, s]))
    return model


def labelled_sample(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text, source, said: the texts of at most ``max_labelled`` labelled documents and what annotators said of them.

    Of several annotators' votes a subject needs at least half. The sample is the documents of smallest id hash.
    """
    votes = labels.filter("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_list("subject").alias("said"), F.greatest(F.countDistinct("annotator"), F.lit(1)).alias("voters"))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return documents.select("doc_id", "text", "source").join(F.broadcast(chosen), "doc_id")


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, said, voters, terms, shares, sources = [], [], [], [], [], b.column("source").to_pylist()
        for i, t in enumerate(b.column("text").to_pylist()):
            ps, share = passages(t)
            terms.append([" ".join(sorted(p)) for p in dict.fromkeys(ps)])
            shares.append(share)
        yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(shares, pa.float64()), pa.array(sources, pa.string()), b.column("said"), b.column("voters")], names=["doc_id", "terms", "share", "source", "said", "voters"])


def fit(documents: DataFrame, labels: DataFrame, subjects: list[str], max_labelled: int = MAX_LABELLED) -> SubjectModel | None:
    """The model from a bounded sample of labelled documents; None if nothing is labelled."""
    rows = labelled_sample(documents, labels, max_labelled).mapInArrow(_training_rows, "doc_id bigint, terms array<string>, share double, source string, said array<string>, voters bigint").toArrow().to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        return None
    at = {s: i for i, s in enumerate(subjects)}
    y = np.zeros((len(rows), len(subjects)), dtype=int)
    for i, r in enumerate(rows):
        for s, c in Counter(r["said"]).items():
            if s in at and 2 * c >= r["voters"]:
                y[i, at[s]] = 1
    docs = [[frozenset(p.split(" ")) if p else frozenset() for p in r["terms"]] for r in rows]
    return train(docs, [r["share"] for r in rows], [r["source"] for r in rows], y, subjects)


def _classify(batches: Iterable[pa.RecordBatch], model: SubjectModel) -> Iterator[pa.RecordBatch]:
    names = np.asarray(model.subjects, dtype=object)
    for b in batches:
        kept, feats, shares = [], [], []
        for i, t in enumerate(b.column("text")):
            ps, share = passages(t.as_py())
            if ps:
                f = model.terms.features(ps, share)
                if f[:, 0].any():
                    kept.append(i)
                    feats.append(f)
                    shares.append(share)
        if not kept:
            continue
        source = b.column("source").take(pa.array(kept)).to_pylist()
        found = model.decode(np.stack(feats), model.context(source, np.asarray(shares)))
        doc, subject = np.nonzero(found)
        yield pa.record_batch([b.column("doc_id").take(pa.array(np.asarray(kept)[doc])), pa.array(names[subject], pa.string())], names=["doc_id", "subject"])


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, subject): every subject area that the body of a document treats.

    Passages are the lines with finished sentences, up to the end of the last; menus, notices, teasers and headings have no part. A document without
    passages or without any subject term (empty and null texts, error pages, pages of links) has no row. The model (term
    weights, one shared evidence model, a chain of one classifier per subject over the labels before it, sources and
    structure) is trained on at most ``max_labelled`` labelled documents and shipped with the tasks; classifying is one
    scan without a shuffle. Without labels the result is empty.
    """
    names = [r[0] for r in subjects.select("subject").filter("subject is not null").distinct().orderBy("subject").limit(MAX_SUBJECTS + 1).collect()]
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    rows = documents.select("doc_id", "text", "source")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, subject string"
    model = fit(documents, labels, names, max_labelled) if names else None
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    shipped = documents.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(lambda batches: _classify(batches, shipped.value), schema)
