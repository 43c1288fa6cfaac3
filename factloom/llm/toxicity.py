"""Toxicity by a subsequence string kernel and a support vector machine on Nyström features.

The kernel of two words sums over their common subsequences of LEAST to ORDER characters, each weighted by DECAY to the gaps that it has in
both, and is normalised; so a word with gapped or inserted characters stays near the word that it hides. Nyström landmarks
are words of the training texts: usual words with the letter runs that toxic texts have; or, where a model of these misses too many of the
toxic texts that it learned from, whole words, until no further one covers enough of these texts; and the clean words most like those. A text counts by its most suspicious words (a text is toxic if a sentence in it is, a sentence if a word
in it is): training alternates between choosing each toxic sentence's witness word and fitting a linear SVM to witnesses against
the most suspicious words of clean sentences. The text's score is a logistic function of its highest margins.

Training takes a bounded sample of labelled rows to the driver (`most_labelled`); scoring reads whole texts.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import freed, id_and_text
from factloom.llm.shingles import stretches, text_bytes

LEAST, ORDER, DECAY = 3, 5, 0.7
#: Longer words are read in windows of this length that overlap by half.
LONGEST = 24
#: Bounds of the landmarks: words that stand for letter runs of toxic texts, or whole words of these; and the clean words beside either.
STEM_LANDMARKS, WORD_LANDMARKS, CLEAN_LANDMARKS = 24, 96, (8, 96)
SHARED, REACH = 0.75, 2
#: A word of toxic texts tells if so many have it, and it is so much likelier in them (logarithm) than in clean ones; a further word must add so much of all toxic texts.
TEXTS, LIFT, ADDS = 3, 2.0, 0.005
#: The share of toxic training texts that a model may miss before one of whole words is tried.
MISSED = 0.02
#: Windows of so many letters that overlap by half, for words of over so many letters: of a landmark of 3 to 5, 6 to 8 or 9 to 11
#: letters one of these windows holds all, and is no longer than REACH allows.
SCALES = ((8, 8), (14, 14), (20, 20))
#: The margins of a text's most suspicious words that its score is made of.
TOPS = 3
#: Bytes of texts (or one text) whose words are looked up together: bounds what a Python worker holds.
SLICE = 1 << 19
#: Rows that are handed over at once.
ROWS = 500
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
#: Letters set apart by single spaces.
SPACED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
INSIDE = re.compile(r"[\W_]+")


def tokens_of(text: str) -> set[str]:
    """The distinct raw words of a text in small letters; letters set apart by spaces are one word too."""
    low = text.lower()
    out = set(low.split())
    if m := SPACED.findall(low):
        out.update(x.replace(" ", "") for x in m)
    return out


def windows(token: str) -> list[str]:
    """What the kernel reads of a raw word: without characters at its ends that are no letters or digits, with marks
    of its start and end, in windows if it is long; the same without what is neither letter nor digit inside; and the parts
    between these as words of their own. Of words too long for short landmarks, shorter windows are read as words too."""
    if token.isalnum():
        if len(token) <= SCALES[0][1]:
            return [f"^{token}$"] if len(token) >= 3 else []
        w = token
    else:
        w = EDGE.sub("", token)
        if len(w) < 3:
            return []
    plain = [w] if w.isalnum() else [INSIDE.sub("", w), *(x for x in INSIDE.split(w) if len(x) >= 3)]
    cut = []
    for w in dict.fromkeys([w, *plain]):
        w = f"^{w}$"
        cut += [w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)]
    for w in plain:
        for n, least in SCALES:
            if len(w) > least:
                cut += [f"^{w[i : i + n]}$" for i in range(0, len(w) - n // 2, n // 2)]
    return cut


def _codes(words: list[str], width: int) -> np.ndarray:
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.int32)


def _decays(n: int) -> np.ndarray:
    """Entry (i, j): DECAY^(i-j-1) for j < i, else 0."""
    i = np.arange(n)
    gap = i[:, None] - i[None, :] - 1
    return np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)


class SubsequenceKernel:
    """Normalised kernel values of words against the landmarks.

    A value counts as 0 if the word has less than SHARED of the landmark's characters in order, or over REACH times its length: a
    bit-parallel longest common subsequence finds these pairs before the kernel is computed for the rest. So do all values of a word
    for which that holds with each of the first `gates` landmarks.
    """

    def __init__(self, landmarks: list[str], gates: int | None = None) -> None:
        self.landmarks, self.gates = landmarks, len(landmarks) if gates is None else gates
        self.width = max(map(len, landmarks))
        self.length = np.array([len(w) for w in landmarks])
        self.codes = _codes(landmarks, self.width)
        self.codes[self.codes == 0] = -1
        self.right = _decays(self.width).T.copy()
        self.norm = np.sqrt([float(self._self(_codes([w], len(w)))[0]) for w in landmarks])
        letters = sorted(set("".join(landmarks)))
        self.letters = np.array([ord(c) for c in letters], dtype=np.int32)
        self.masks = np.array([[0] * len(landmarks)] + [[sum(1 << k for k, x in enumerate(w) if x == c) for w in landmarks] for c in letters], dtype=np.uint32)
        self.full = np.array([(1 << len(w)) - 1 for w in landmarks], dtype=np.uint32)
        self.need = np.array([max(4, -int(-SHARED * len(w) // 1)) for w in landmarks])
        # A set bit for each of the first 63 of the landmarks' characters; the others share the last.
        self.bit = np.array([0] + [1 << min(k, 63) for k in range(len(letters))], dtype=np.uint64)
        self.owned = np.array([np.bitwise_or.reduce(self.bit[[letters.index(c) + 1 for c in w]]) for w in landmarks])
        self.need_distinct = np.bitwise_count(self.owned).astype(int) - self.length + self.need

    def likely(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, landmark) of the pairs that share enough: first of the landmark's distinct characters, then in order."""
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        at = np.where(self.letters[at] == codes, at + 1, 0)
        has, size = np.bitwise_or.reduce(self.bit[at], axis=1), (codes > 0).sum(axis=1)
        word, mark = self._in_order(at, has, size, np.arange(len(codes)), 0, self.gates)
        others = self._in_order(at, has, size, np.unique(word), self.gates, len(self.landmarks))
        return np.concatenate([word, others[0]]), np.concatenate([mark, others[1]])

    def _in_order(self, at: np.ndarray, has: np.ndarray, size: np.ndarray, words: np.ndarray, first: int, after: int) -> tuple[np.ndarray, np.ndarray]:
        """likely() of some words and the landmarks from first on."""
        marks = slice(first, after)
        fits = (np.bitwise_count(has[words, None] & self.owned[None, marks]) >= self.need_distinct[marks]) & (size[words, None] <= REACH * self.length[marks])
        word, mark = np.nonzero(fits)
        word, mark = words[word], mark + first
        v, full, at = self.full[mark].copy(), self.full[mark], at[word]
        for j in range(at.shape[1]):
            u = v & self.masks[at[:, j], mark]
            v = (v + u) | (v - u)
        good = np.bitwise_count(~v & full) >= self.need[mark]
        return word[good], mark[good]

    @staticmethod
    def _sum(match: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Sum over orders LEAST to ORDER for match[..., i, j]."""
        d = match * np.float32(DECAY**2)
        total = np.zeros(match.shape[:-2], dtype=np.float32)
        for order in range(2, ORDER + 1):
            d = match * np.float32(DECAY**2) * (left @ d @ right)
            if order >= LEAST:
                total += d.sum(axis=(-1, -2)) * np.float32(DECAY ** (-2 * order))
        return total

    def _self(self, codes: np.ndarray) -> np.ndarray:
        left = _decays(codes.shape[1])
        return self._sum(((codes[:, :, None] == codes[:, None, :]) & (codes[:, :, None] > 0)).astype(np.float32), left, left.T)

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), dtype=np.float32)
        for width, at in by_width(words):
            left = _decays(width)
            for i in range(0, len(at), 4096):
                part = at[i : i + 4096]
                c = _codes([words[k] for k in part], width)
                word, mark = self.likely(c)
                some, back = np.unique(word, return_inverse=True)
                norm = np.sqrt(np.concatenate([self._self(c[some[j : j + 512]]) for j in range(0, len(some), 512)] or [np.zeros(0)]))
                for j in range(0, len(word), 512):
                    w, m = word[j : j + 512], mark[j : j + 512]
                    match = (c[w][:, :, None] == self.codes[m][:, None, :]).astype(np.float32)
                    out[part[w], m] = self._sum(match, left, self.right) / np.maximum(norm[back[j : j + 512]] * self.norm[m], 1e-9)
        return out


def by_width(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Words of nearly the same length together: (length that they are padded to, their places)."""
    n = np.array([max(1, len(w)) for w in words])
    padded = -(-n // 3) * 3
    for width in np.unique(padded):
        yield int(width), np.flatnonzero(padded == width)


@dataclass
class Model:
    """Margin of a word: kernel values . weights + bias; score of a text: logistic(its top margins . slopes + offset)."""

    landmarks: list[str]
    gates: int
    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    offset: float

    def margins(self, words: list[str]) -> np.ndarray:
        if not self.landmarks or not words:
            return np.full(len(words), self.bias)
        if not hasattr(self, "_kernel"):
            self._kernel = SubsequenceKernel(self.landmarks, self.gates)
        return self._kernel(words) @ self.weights + self.bias

    def learn(self, known: dict[str, float], tokens: set[str]) -> None:
        """Margins of raw words that aren't known yet; the bias for those that have nothing to read."""
        new = [t for t in tokens if t not in known]
        cut = [windows(t) for t in new]
        place: dict[str, int] = {}
        at = np.fromiter((place.setdefault(w, len(place)) for x in cut for w in x), dtype=np.int64)
        value = np.append(self.margins(list(place)), self.bias)
        n = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        best = np.full(len(new), self.bias)
        if len(at):
            best[n > 0] = np.maximum(np.maximum.reduceat(value[at], (np.cumsum(n) - n)[n > 0]), self.bias)
        known.update(zip(new, best.tolist(), strict=True))

    def tops(self, margins: list[float]) -> list[float]:
        """The TOPS highest margins of a text's distinct words; the bias where it has fewer."""
        return (sorted(margins, reverse=True)[:TOPS] + [self.bias] * TOPS)[:TOPS]

    def score(self, tops: np.ndarray) -> np.ndarray:
        """Of texts, given their TOPS highest margins."""
        return 1 / (1 + np.exp(-np.clip(tops @ self.slopes + self.offset, -30, 30)))


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton's method with step halving; y is 1 or -1."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x1.shape[1], reg)
    penalty[-1] = 1e-6
    weight = weight / weight.sum()
    loss = lambda w: (penalty * w * w).sum() / 2 + (weight * np.maximum(1 - y * (x1 @ w), 0) ** 2).sum() / 2
    w, now = np.zeros(x1.shape[1]), np.inf
    for _ in range(60):
        gap = 1 - y * (x1 @ w)
        c = weight * (gap > 0)
        grad = penalty * w - x1.T @ (c * y * np.maximum(gap, 0))
        step = np.linalg.solve((x1 * c[:, None]).T @ x1 + np.diag(penalty), grad)
        size = 1.0
        while loss(w - size * step) > now and size > 1e-4:
            size /= 2
        w = w - size * step
        if now - loss(w) < 1e-10:
            break
        now = loss(w)
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights, none under 0, and offset for the probability that y is 1, with a small penalty."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.r_[np.ones(x.shape[1]) / x.shape[1], 0.0]
    penalty = np.r_[np.full(x.shape[1], 0.05), 1e-6]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        c = np.maximum(p * (1 - p), 1e-6)
        step = np.clip(np.linalg.solve((x1 * c[:, None]).T @ x1 + np.diag(penalty), x1.T @ (p - y) + penalty * w), -1, 1)
        w = w - step
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def grams(word: str) -> set[str]:
    """Runs of 4 to 6 characters, the mark of the start among them."""
    return {word[i : i + n] for n in (4, 5, 6) for i in range(len(word) - n + 1)}


def _read(texts: list[str]) -> tuple[list[str], np.ndarray, list[list[np.ndarray]]]:
    """The sorted distinct words of the texts, which of them are whole somewhere, and for each text its sentences as places in them."""
    place: dict[str, int] = {}
    held, whole = [], set()
    for text in texts:
        of_text = []
        for p in SENTENCE_END.split(text):
            cut = [windows(t) for t in tokens_of(p)]
            whole.update(x[0] for x in cut if x)
            found = {place.setdefault(w, len(place)) for x in cut for w in x}
            if found:
                of_text.append(np.fromiter(found, dtype=np.int32, count=len(found)))
        held.append(of_text)
    vocabulary = sorted(place)
    moved = np.empty(len(place), dtype=np.int32)
    moved[np.fromiter(map(place.__getitem__, vocabulary), dtype=np.int64, count=len(place))] = np.arange(len(place), dtype=np.int32)
    return vocabulary, np.array([w in whole for w in vocabulary], dtype=bool), [[np.sort(moved[s]) for s in of_text] for of_text in held]


def _texts_with(texts: Iterable[np.ndarray], n: int) -> np.ndarray:
    """How many of the texts, given by their distinct numbers, have each of the numbers under n."""
    out = np.zeros(n)
    for s in texts:
        out[s] += 1
    return out


def _highest(value: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The highest value of each word's runs; 0 for a word without any."""
    out = np.zeros(len(bounds) - 1)
    some = bounds[:-1] < bounds[1:]
    if some.any():
        out[some] = np.maximum.reduceat(value[flat], bounds[:-1][some])
    return out


def _covering(vocabulary: list[str], texts: list[np.ndarray], lift: np.ndarray, least: float) -> list[str]:
    """Words of the texts (given by places), each the one that most texts have which others cover least; of equal ones the longest. They end when the next would add under `least` texts."""
    covered, chosen = np.zeros(len(texts)), []
    holders: dict[int, list[int]] = {}
    for k, s in enumerate(texts):
        for w in s.tolist():
            holders.setdefault(w, []).append(k)
    gain = {w: float(len(k)) for w, k in holders.items()}
    while gain and len(chosen) < WORD_LANDMARKS:
        best = max(gain, key=lambda w: (round(gain[w], 6), len(vocabulary[w]), lift[w], w))
        if gain.pop(best) < least:
            break
        chosen.append(vocabulary[best])
        for k in holders[best]:
            for w in texts[k].tolist():
                if w in gain:
                    gain[w] -= 0.5 ** (covered[k] + 1)
            covered[k] += 1
    return chosen


def train(texts: list[str], labels: list[int], rounds: int = 3, seed: int = 5) -> Model:
    """A model of texts labelled 1 (toxic) and 0. With no or one kind of label, or no word that tells, every text has the share of label 1, at most 0.49: none is predicted toxic."""
    y = np.array(labels, dtype=float)
    share = min(0.49, (y.sum() + 0.5) / (len(y) + 1))
    constant = Model([], 0, np.zeros(0), 0.0, np.zeros(TOPS), float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return constant
    vocabulary, whole, held = _read(texts)
    of_text = [np.unique(np.concatenate(text)) if text else np.zeros(0, np.int32) for text in held]
    toxic_texts = [s for s, label in zip(of_text, labels, strict=True) if label]
    clean_texts = [s for s, label in zip(of_text, labels, strict=True) if not label]
    often = _texts_with(clean_texts, len(vocabulary))
    toxic_often = _texts_with(toxic_texts, len(vocabulary))
    in_clean, in_toxic = often > 0, toxic_often > 0
    # Letter runs that toxic texts have and clean ones haven't tell which words may be the witnesses at first.
    n1, n0 = y.sum(), len(y) - y.sum()
    counted = Counter()
    for s in toxic_texts:
        counted.update(set().union(*(grams(vocabulary[w]) for w in s)))
    runs = sorted(g for g, k in counted.items() if k >= max(2, 0.01 * n1))
    bad = np.array([counted[g] for g in runs], dtype=float)
    del counted
    number = {g: k for k, g in enumerate(runs)}
    # The runs of word w are flat[bounds[w] : bounds[w + 1]].
    bounds, flat = np.zeros(len(vocabulary) + 1, dtype=np.int64), array("i")
    for k, w in enumerate(vocabulary):
        flat.extend(number[g] for g in grams(w) if g in number)
        bounds[k + 1] = len(flat)
    flat = np.frombuffer(flat, dtype=np.int32) if flat else np.zeros(0, np.int32)
    runs_of = lambda s: np.unique(np.concatenate([flat[bounds[w] : bounds[w + 1]] for w in s])) if len(s) else np.zeros(0, np.int32)
    good = _texts_with((runs_of(s) for s in clean_texts), len(runs))
    lift = np.log((bad + 0.5) / (n1 + 1)) - np.log((good + 0.5) / (n0 + 1))
    worth = np.where(in_toxic, _highest(lift * np.sqrt(bad), flat, bounds), 0.0)
    raised = _highest(lift, flat, bounds)
    leads = Counter()
    for s in toxic_texts:
        if len(s):
            leads[int(s[::-1][worth[s[::-1]].argmax()])] += 1
            leads.update(s[raised[s] > 2.5].tolist())
    if not leads:
        return constant
    # Landmarks: each is the most usual word with the run of letters that most toxic texts have which few landmarks cover yet.
    marked = [set(r[lift[r] > 2.5].tolist()) for r in map(runs_of, toxic_texts)]
    covered, landmarks = np.zeros(len(marked)), []
    while len(landmarks) < STEM_LANDMARKS:
        gain = Counter()
        for t, c in zip(marked, covered, strict=True):
            gain.update(dict.fromkeys(t, 0.5**c) if t else {})
        best = max(gain, key=lambda g: (gain[g], len(runs[g]), g), default=None)
        if best is None or gain[best] < 0.25:
            break
        able = (w for w in leads if runs[best] in vocabulary[w] and vocabulary[w] not in landmarks and not in_clean[w])
        word = max(able, key=lambda w: (leads[w], -len(vocabulary[w]), w), default=None)
        for k, t in enumerate(marked):
            if best in t:
                covered[k] += 1
                if word is None:
                    t.discard(best)
        if word is not None:
            landmarks.append(vocabulary[word])
    if not landmarks:
        return constant
    fit = _Fit(vocabulary, held, of_text, y, often)
    model = fit.model(landmarks, np.where(raised > 2.5, worth, 0.0), np.zeros(len(vocabulary), dtype=bool), rounds, seed)
    wrong = lambda: int(((fit.scores >= 0.5) != (y > 0)).sum())
    missed, errors = int(((fit.scores < 0.5) & (y > 0)).sum()), wrong()
    if model is None or missed > MISSED * n1:
        # Stems don't tell these toxic texts apart: whole words that do, instead, if that is better for the labelled texts.
        word_lift = np.log((toxic_often + 0.5) / (n1 + 1)) - np.log((often + 0.5) / (n0 + 1))
        telling = whole & (toxic_often >= min(TEXTS, n1)) & (word_lift >= LIFT)
        words = _covering(vocabulary, [s[telling[s]] for s in toxic_texts], word_lift, max(1, ADDS * n1))
        other = fit.model(words, np.where(telling, word_lift, 0.0), telling, rounds, seed) if words else None
        if other and (model is None or wrong() < errors):
            model = other
    return model or constant


class _Fit:
    """Training words and texts, with which models of several sets of landmarks are fitted."""

    def __init__(self, vocabulary: list[str], held: list[list[np.ndarray]], of_text: list[np.ndarray], y: np.ndarray, often: np.ndarray) -> None:
        self.vocabulary, self.held, self.of_text, self.y, self.often = vocabulary, held, of_text, y, often
        self.scores = np.zeros(len(y))

    def model(self, landmarks: list[str], margin: np.ndarray, telling: np.ndarray, rounds: int, seed: int) -> Model | None:
        """A model; scores: what it gives the training texts. margin: a first guess for each word; telling: words that count as witnesses wherever they are."""
        vocabulary, often, in_clean = self.vocabulary, self.often, self.often > 0
        # With the clean words most like the landmarks.
        gates = len(landmarks)
        usual = np.flatnonzero(in_clean & ~telling)
        usual = usual[np.argsort(-often[usual], kind="stable")][:20000]
        plain = [vocabulary[k] for k in usual]
        like = SubsequenceKernel(landmarks)(plain).max(axis=1, initial=0) * np.sqrt(often[usual])
        few = CLEAN_LANDMARKS[int(telling.any())]
        landmarks = landmarks + [plain[k] for k in np.argsort(-like, kind="stable")[:few] if like[k] > 0 and plain[k] not in landmarks]
        gram = SubsequenceKernel(landmarks)(landmarks).astype(float)
        kernel = SubsequenceKernel(landmarks, gates)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        root = vectors * (1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        # Kernel values of the words that have any; others' margin is the bias.
        live, features = [], []
        for i in range(0, len(vocabulary), 32768):
            values = kernel(vocabulary[i : i + 32768])
            some = np.flatnonzero(values.any(axis=1))
            live.append(some + i)
            features.append((values[some] @ root).astype(float))
        live, features = np.concatenate(live), np.concatenate(features)
        row = np.full(len(vocabulary), len(live))
        row[live] = np.arange(len(live))
        features = np.vstack([features, np.zeros(features.shape[1])])
        rng = np.random.default_rng(seed)
        clean_words = np.flatnonzero(in_clean & ~telling)
        weights, bias = np.zeros(features.shape[1]), 0.0
        for _ in range(rounds):
            witness = Counter()
            for text, label in zip(self.held, self.y, strict=True):
                if label:
                    for s in text:
                        witness.update(s[telling[s] & (row[s] < len(live))].tolist())
                        able = s[~in_clean[s]]
                        if len(able) and margin[t := able[margin[able].argmax()]] > 0 and not telling[t]:
                            witness[int(t)] += 1
            if not witness or not len(clean_words):
                return None
            hard = clean_words[np.argsort(-margin[clean_words], kind="stable")[:3000]]
            positive, negative = np.array(sorted(witness)), np.unique(np.r_[hard, rng.choice(clean_words, min(len(clean_words), 3000), replace=False)])
            count = np.sqrt([witness[k] for k in positive])
            x, side = features[row[np.r_[positive, negative]]], np.r_[np.ones(len(positive)), -np.ones(len(negative))]
            seen = np.sqrt(often[negative])
            weights, bias = fit_svm(x, side, np.r_[count / count.sum(), seen / seen.sum()])
            margin = (features @ weights + bias)[row]
        made = Model(landmarks, gates, root @ weights, bias, np.zeros(TOPS), 0.0)
        tops = np.array([made.tops(margin[s].tolist()) for s in self.of_text])
        made.slopes, made.offset = fit_logistic(tops, self.y)
        self.scores = made.score(tops)
        return made


def held_out(doc_id: Column) -> Column:
    """A fifth of the rows, by the CRC-32 of doc_id's digits; their labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 3000, most_bytes: int = 1 << 20, label_col: str = "toxic") -> Model:
    """Trains on at most most_labelled rows with a label that aren't held out: as many of label 1 as of the others if there are, chosen by a hash.

    Labels other than 0 and 1, and rows without doc_id, are ignored; with several labels for a doc_id the largest counts, with several
    texts the smallest. Texts of over most_bytes aren't learned from (they are scored), so what comes to the driver is bounded. Only doc_id and text of docs are read, and
    no other column of labels than doc_id and label_col.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = rows.where("label = 1").orderBy(*order).limit(most_labelled // 3)
    clean = rows.where("label = 0").orderBy(*order).limit(most_labelled - most_labelled // 3)
    chosen = toxic.unionByName(clean).collect()  # at most most_labelled pairs of integers
    ids = docs.sparkSession.createDataFrame([tuple(x) for x in chosen], "doc_id long, label int")
    found = id_and_text(docs).where(F.octet_length("text") <= most_bytes).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda x: (x.doc_id, x.text))
    return train([x.text for x in found], [x.label for x in found])


class Scorer:
    """Scores of columns of texts, whole; null counts as empty. most_known bounds the words whose margins it remembers, and changes no score."""

    def __init__(self, model: Model, most_known: int = 100_000) -> None:
        self.model, self.known, self.most_known = model, {}, most_known

    def __call__(self, column: pa.Array) -> np.ndarray:
        top = np.full((len(column), TOPS), self.model.bias)
        for i, j in stretches(text_bytes(column.fill_null(""))[1], SLICE):
            if len(self.known) > self.most_known:
                self.known.clear()
            texts = [tokens_of(t or "") for t in column.slice(i, j - i).to_pylist()]
            self.model.learn(self.known, set().union(*texts))
            for k, t in enumerate(texts):
                top[i + k] = self.model.tops(list(map(self.known.__getitem__, t)))
        return self.model.score(top)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. A null or empty text has the score of a text without words; a very long one is read whole; rows that repeat a doc_id are scored each. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch.column("text")))], ["doc_id", "score"])

    rows = id_and_text(docs).mapInArrow(freed(run), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns as they are, whose text the model doesn't predict toxic."""
    schema = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            keep = pa.array(score(batch.column("text")) < 0.5)
            for i in range(0, batch.num_rows, ROWS):  # what is handed over at once is small beside what comes in
                yield batch.slice(i, ROWS).filter(keep.slice(i, ROWS))

    return docs.mapInArrow(freed(run), schema)
