"""Toxicity: a support vector machine over sentences with a gap-weighted subsequence kernel and Nystrom landmarks."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_crc
from .quality import fitting_sample

#: Bound of the fitting sample: labelled rows of each class; their whole texts count.
SAMPLE_ROWS = 1500
LANDMARKS = 48
#: Length of the subsequences, and what each further character they span costs.
ORDER, DECAY = 3, 0.6
#: A word meets a landmark only if so much of the landmark is a subsequence of it; else the kernel counts as 0.
LEAST_COMMON = 0.8
#: A power of a kernel is a kernel; it sets chance matches further apart from insults.
POWER = 2
WIDTHS = (8, 16, 32)
CACHE_WORDS = 600_000
_SENTENCE = re.compile(r"[.!?\n]+")
_SPELT = re.compile(r"(?<!\w)(?:[^\W_][ .*_\-]{1,2}){3,}[^\W_](?!\w)")
_EDGE = "\"'()[]{},;:"


def sentence_words(text: str) -> list[list[str]]:
    """Lower-case words by sentence; letters that stand apart (l o s e r, l.o.s.e.r) are a word as well."""
    text = text.lower()
    text = _SPELT.sub(lambda m: re.sub(r"[^\w]|_", "", m[0]) + " ", text)
    return [[w for x in s.split() if (w := x.strip(_EDGE))] for s in _SENTENCE.split(text)]


class Kernel:
    """Normalised subsequence kernel of words against fixed landmarks, for many words at once."""

    def __init__(self, landmarks: list[str]):
        import numpy as np

        # landmarks begin words, and what begins a word counts: the mark of a word's begin is a character
        landmarks = self.landmarks = ["^" + t[:30] for t in landmarks]
        chars = sorted({c for t in landmarks for c in t})[:250]
        self.code = np.zeros(0x110000, np.uint8)
        for i, c in enumerate(chars, 1):
            self.code[ord(c)] = i
        self.masks = np.zeros((len(landmarks), 256), np.uint32)
        self.need = []
        for k, t in enumerate(landmarks):
            for j, c in enumerate(t[:31]):
                self.masks[k, self.code[ord(c)]] |= np.uint32(1 << j)
            self.need.append(min(len(t), max(4, math.ceil(LEAST_COMMON * min(len(t), 31)))))
        self.masks[:, 0] = 0
        self.own = {t: float(self._pairs(*[self._codes([t], 32)] * 2)[0]) ** 0.5 or 1.0 for t in landmarks}
        self.seen: set[str] = set()
        self.hits: dict[str, list[tuple[int, float]]] = {}

    def _codes(self, words: list[str], width: int):
        import numpy as np

        raw = "".join(w[:width].ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass")
        return self.code[np.frombuffer(raw, np.uint32)].reshape(-1, width)

    @staticmethod
    def _pairs(s, t):
        """The kernel of each pair of rows of codes; code 0 meets nothing."""
        import numpy as np

        n, wide = t.shape
        before = [np.ones((n, wide + 1))] + [np.zeros((n, wide + 1)) for _ in range(ORDER - 1)]
        total = np.zeros(n)
        for i in range(s.shape[1]):
            same = (s[:, i : i + 1] == t) & (t > 0)
            if not same.any():
                for k in range(1, ORDER):
                    before[k] *= DECAY
                continue
            total += DECAY**2 * (same * before[ORDER - 1][:, :-1]).sum(1)
            after = [before[0]]
            for k in range(1, ORDER):
                run, new = np.zeros(n), DECAY * before[k]
                for j in range(wide):
                    run = DECAY * run + DECAY**2 * same[:, j] * before[k - 1][:, j]
                    new[:, j + 1] += run
                after.append(new)
            before = after
        return total

    def learn(self, words: set[str]) -> None:
        """Adds words to what is known; only those that meet a landmark are kept with their kernels."""
        import numpy as np

        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
            self.hits.clear()
        new = [w for w in words if w not in self.seen]
        self.seen.update(new)
        pieces: list[tuple[str, str]] = []
        for w in new:  # a longer word is met piece by piece
            x = "^" + w
            pieces += [(w, x)] if len(x) <= WIDTHS[-1] else [(w, x[i : i + WIDTHS[-1]]) for i in range(0, len(x) - 15, 16)]
        lo = 0
        for width in WIDTHS:
            group = [p for p in pieces if lo < len(p[1]) <= width]
            lo = width
            for i in range(0, len(group), 16384):
                self._meet(group[i : i + 16384], width, np)

    def _meet(self, group, width, np) -> None:
        codes = self._codes([p for _, p in group], width)
        for k, t in enumerate(self.landmarks):
            if len(t) > 1 and self.need[k] > width:
                continue
            full = np.uint32((1 << min(len(t), 31)) - 1)
            v = np.full(len(codes), full)
            mask = self.masks[k]
            for i in range(width):
                u = v & mask[codes[:, i]]
                v = ((v + u) | (v - u)) & full
            at = np.flatnonzero(np.bitwise_count(~v & full) >= self.need[k])
            if not len(at):
                continue
            value = np.zeros(len(at))
            mark = self._codes([t], len(t))
            for wide in {min(width, len(t)), min(width, len(t) + 2)}:  # the word's best stretch of about the landmark's length
                s = np.lib.stride_tricks.sliding_window_view(codes[at], wide, axis=1)
                shape = s.shape[:2]
                s = np.ascontiguousarray(s).reshape(-1, wide)
                x = self._pairs(s, np.repeat(mark, len(s), 0))
                value = np.maximum(value, (x / np.maximum(np.sqrt(self._pairs(s, s)) * self.own[t], 1e-12)).reshape(shape).max(1))
            for a, x in zip(at.tolist(), value.tolist()):
                if x > 0.2:
                    self.hits.setdefault(group[a][0], []).append((k, x**POWER))

    def vector(self, words: list[str]):
        """The largest kernel with each landmark over a sentence's words; None if all are 0."""
        import numpy as np

        found = [h for w in words for h in self.hits.get(w, ())]
        if not found:
            return None
        out = np.zeros(len(self.landmarks))
        for k, x in found:
            out[k] = max(out[k], x)
        return out


def choose_landmarks(pos: list[list[list[str]]], neg: list[list[list[str]]], most: int = LANDMARKS) -> list[str]:
    """Words, and beginnings that words share, that mark toxic documents, strongest first.

    Different pairs of neighbours that a word has are counted, so what near copies of a document share counts once.
    """

    def units(w):
        return {w[:k] for k in (3, 4, 5, 6, 30) if len(w) >= min(k, 4)}

    def count(docs):
        places = {(a, w, b) for d in docs for s in d for a, w, b in zip(["", *s], s, [*s[1:], ""]) if len(w) >= 4}
        return Counter(u for _, w, _ in places for u in units(w))

    p, n = count(pos), count(neg)
    np_, nn = max(1, len(pos)), max(1, len(neg))
    found = []
    for u, c in p.items():
        a, b = (c - 2 * c**0.5) / np_, (n[u] + 1) / nn  # at least, at most
        if a > 10 * b:
            found.append((-(c - n[u] * np_ / nn) * math.log(a / b), len(u), u))
    out: list[str] = []
    for _, _, u in sorted(found):
        if not any(u.startswith(o) or o.startswith(u) for o in out):
            out.append(u)
        if len(out) == most:
            break
    words = Counter(w[:30] for d in pos for s in d for w in s if w.startswith(tuple(out))) if out else Counter()
    return list(dict.fromkeys(_longest(u, words) for u in out))


def _longest(stem: str, words: Counter) -> str:
    """The stem, longer by what nine tenths of the words that begin with it have in common."""
    own = {w: c for w, c in words.items() if w.startswith(stem)}
    total = sum(own.values())
    while True:
        nexts = Counter()
        for w, c in own.items():
            if len(w) > len(stem) and w.startswith(stem):
                nexts[w[len(stem)]] += c
        c, n = max(nexts.items(), key=lambda x: (x[1], x[0]), default=("", 0))
        if n < 0.9 * total or len(stem) == 30:
            return stem
        stem += c


def fit_svm(x, y, weight, ridge: float = 1e-2, rounds: int = 40):
    """Weights and offset of a linear machine with squared hinge loss, by Newton steps on the points inside the margin."""
    import numpy as np

    a = np.c_[x, np.ones(len(x))]
    beta = np.zeros(a.shape[1])
    reg = ridge * np.eye(a.shape[1])
    reg[-1, -1] = 1e-6
    for _ in range(rounds):
        inside = y * (a @ beta) < 1
        s = a[inside]
        new = np.linalg.solve(reg + (s * weight[inside, None]).T @ s, s.T @ (weight[inside] * y[inside]))
        done = np.abs(new - beta).max() < 1e-7
        beta = new
        if done:
            break
    return beta[:-1], float(beta[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, fold_of=None, rows: int = SAMPLE_ROWS) -> dict:
    """The model, from at most rows labelled texts of each class, whole.

    Sentences of clean documents are clean; in a toxic document, the sentences that meet a landmark well are
    toxic. Landmarks with a character put in stand as toxic sentences too, so gaps are learnt.
    """
    fold_of = F.lit(True) if fold_of is None else fold_of
    sample = fitting_sample(docs, labels, "toxic", rows, fold_of)
    got = sorted((r for r in sample.select("doc_id", "y", "text").collect() if r.text), key=lambda r: (r.doc_id, r.text))
    share = labels.where(fold_of & F.col("toxic").isNotNull()).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return fit_rows([(r.y, r.text) for r in got], share)


def fit_rows(rows: list[tuple[int, str]], share: float | None) -> dict:
    """The model from (label, text) rows; share is that of toxic rows among all labelled ones."""
    import numpy as np

    parsed = [(y, sentence_words(t)) for y, t in dict.fromkeys(rows)]
    landmarks = choose_landmarks([d for y, d in parsed if y], [d for y, d in parsed if not y])
    if not landmarks:
        share = min(max(share, 1e-3), 1 - 1e-3) if share is not None else 0.5
        return {"landmarks": [], "w": [], "offset": 0.0, "slope": [0.0] * 3, "shift": math.log(share / (1 - share))}
    kernel = Kernel(landmarks)
    spoilt = [t[:i] + c + t[i:] for t in landmarks if len(t) > 4 for i in range(1, len(t)) for c in "-*"]
    kernel.learn({w for _, d in parsed for s in d for w in s} | set(spoilt) | set(landmarks))
    gram = np.array([[dict(kernel.hits.get(t, ())).get(k, 0.0) for k in range(len(landmarks))] for t in landmarks])
    value, basis = np.linalg.eigh((gram + gram.T) / 2)
    whiten = basis @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ basis.T
    x, y, best = [np.zeros(len(landmarks))], [-1.0], []
    weight = [float(sum(len(d) for k, d in parsed if not k) + 1)]
    for label, d in parsed:
        vectors = [v for s in d if (v := kernel.vector(s)) is not None]
        best.append(vectors)
        for v in vectors:
            if not label or v.max() >= 0.5:
                x.append(v)
                y.append(1.0 if label else -1.0)
                weight.append(1.0)
    for t in spoilt:
        if (v := kernel.vector([t])) is not None:
            x.append(v)
            y.append(1.0)
            weight.append(0.2)
    x, y, weight = np.array(x), np.array(y), np.minimum(np.array(weight), 200.0)
    for sign in (1, -1):
        if (y == sign).any():
            weight[y == sign] /= weight[y == sign].sum()
    w, offset = fit_svm(x @ whiten, y, weight * 100)
    w = whiten @ w
    seen = np.array([pooled([float(v @ w) + offset for v in vs], len(d), offset) for vs, (_, d) in zip(best, parsed)])
    slope, shift = fit_logistic(seen, np.array([label for label, _ in parsed], float))
    if share:  # the classes weighed alike in the fit; back to how often they occur
        shift += math.log(share / (1 - share))
    return {"landmarks": landmarks, "w": w.tolist(), "offset": offset, "slope": slope, "shift": shift}


def pooled(values: list[float], sentences: int, offset: float) -> list[float]:
    """What a document's sentences show: the largest value, and how many are toxic, as a logarithm and as a share."""
    toxic = sum(v > 0 for v in values)
    return [max([offset, *values]), math.log1p(toxic), toxic / max(1, sentences)]


def fit_logistic(x, y, ridge: float = 1.0, rounds: int = 50):
    """(slopes, offset) of a logistic curve, by Newton steps with a ridge on scaled features; the classes weigh alike."""
    import numpy as np

    if len(set(y.tolist())) < 2:
        return [0.0] * x.shape[1], 0.0
    scale = np.maximum(x.std(0), 1e-9)
    a = np.c_[x / scale, np.ones(len(x))]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    reg = np.diag([ridge] * x.shape[1] + [1e-6])
    beta = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + reg, a.T @ (weight * (y - p)) - reg @ beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return (beta[:-1] / scale).tolist(), float(beta[-1])


_kernels: dict[tuple, Kernel] = {}


def score_texts(texts: list[str | None], model: dict) -> list[float]:
    """The score of each whole text, pooled from its sentences."""
    import numpy as np

    w, key = np.array(model["w"]), tuple(model["landmarks"])
    if key and key not in _kernels:
        _kernels[key] = Kernel(list(key))
    kernel = _kernels.get(key)
    out = []
    parsed = [sentence_words(t or "") for t in texts] if kernel else [[] for _ in texts]
    if kernel:
        kernel.learn({x for d in parsed for s in d for x in s})
    for d in parsed:
        values = []
        for s in d:
            if kernel and any(x in kernel.hits for x in s) and (v := kernel.vector(s)) is not None:
                values.append(float(v @ w) + model["offset"])
        z = sum(a * b for a, b in zip(model["slope"], pooled(values, len(d), model["offset"]))) + model["shift"]
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    return out


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text).

    Labels are learnt only from rows whose crc32(doc_id) mod folds is not held_out. Null and empty texts get
    the score of a text without a toxic sentence; without labels every score is that of no evidence; a null
    doc_id is never held out; repeated rows are scored alike; further columns are ignored; an empty table
    gives no rows.
    """
    fold = F.pmod(doc_crc(), F.lit(folds))
    model = fit_toxicity(docs, labels, fold != held_out, rows)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            score = []
            for k in range(0, b.num_rows, 256):
                score += score_texts(b.column(1).slice(k, 256).to_pylist(), model)
            yield pa.record_batch([b.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
