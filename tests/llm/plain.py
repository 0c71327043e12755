"""Plain versions of scored operators: one text, one word, one n-gram at a time, with whole numbers of Python."""

import math

import numpy as np

from spanloom.llm import mixing, textkit, toxicity

MASK = 2**64 - 1


def mix(x):
    """The bit mixer of textkit."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor & MASK
    return x ^ (x >> 31)


def hash_bytes(raw):
    """Polynomial of a byte string, finished by the mixer."""
    return mix(sum(int(textkit._CODE[b]) * pow(textkit._BASE, i, 1 << 64) for i, b in enumerate(raw)) & MASK)


def words_of(text):
    """Words as bytes; ASCII white space cuts, A-Z are lower-cased."""
    return (text or "").encode().lower().split()


class Toxic:
    """Scores by the model, word by word."""

    def __init__(self, model):
        self.model, self.seen = model, {}

    def word(self, w):
        if w not in self.seen:
            padded = b" " + w + b" "
            grams = [w, *(padded[i : i + q] for q in toxicity.GRAMS for i in range(len(padded) - q + 1))]
            own = [self.model.weight[hash_bytes(g) >> 47 & (toxicity.BUCKETS - 1)] for g in grams]
            self.seen[w] = float(np.sum(own, dtype=float)) / len(own)
        return self.seen[w]

    def __call__(self, text):
        s = [self.word(w) for w in words_of(text)]
        cut = list(range(0, max(len(s) - toxicity.WINDOW + 1, 1), toxicity.WINDOW)) if s else []
        parts = [s[a:b] for a, b in zip(cut, [*cut[1:], len(s)])]
        best = sorted((sum(p) / len(p) for p in parts), reverse=True)[: toxicity.TOP]
        best += [0.0] * (toxicity.TOP - len(best))
        z = sum((b + self.model.bias) * c for b, c in zip(best, self.model.scale)) + self.model.shift
        return 1 / (1 + math.exp(-max(-60, min(60, z))))


class Domains:
    """Naive Bayes of a labelled sample [(text, domain)], and its posteriors."""

    def __init__(self, rows):
        self.names = sorted({d for _, d in rows})
        self.counts = {d: {} for d in self.names}
        for text, d in rows:
            for w in words_of(text):
                bucket = hash_bytes(w) >> 48
                self.counts[d][bucket] = self.counts[d].get(bucket, 0) + 1
        self.total = {d: sum(c.values()) + 0.1 * mixing.BUCKETS for d, c in self.counts.items()}
        number = [sum(x == d for _, x in rows) + 1 for d in self.names]
        self.prior = [math.log(n / sum(number)) for n in number]
        self.seen = {}

    def word(self, w):
        if w not in self.seen:
            bucket = hash_bytes(w) >> 48
            self.seen[w] = [math.log((self.counts[d].get(bucket, 0) + 0.1) / self.total[d]) for d in self.names]
        return self.seen[w]

    def __call__(self, text, sharpness=20.0):
        """(number of words, posterior)."""
        own = [self.word(w) for w in words_of(text)]
        z = [p + sum(x[k] for x in own) * min(1, sharpness / max(len(own), 1)) for k, p in enumerate(self.prior)]
        e = [math.exp(x - max(z)) for x in z]
        return len(own), [x / sum(e) for x in e]


def rates(tokens, posteriors, wanted, high):
    """Projected gradient steps from 1 over all documents at once, until the totals are there or the objective stays."""
    n, p, wanted = np.array(tokens, float), np.array(posteriors), np.array(wanted)
    weight, r = (n * n) @ p, np.ones(len(n))
    objective = lambda r: float((((r * n) @ p - wanted) ** 2 / weight).sum())
    values = [objective(r)]
    while True:
        off = (r * n) @ p - wanted
        if np.abs(off).sum() <= 1e-4 * wanted.sum() or len(values) > mixing.PATIENCE and values[-1] > 0.99 * values[-1 - mixing.PATIENCE]:
            return r
        r = min((np.clip(r - scale * n * (p @ (off / weight)), 0, high) for scale in mixing.SCALES), key=objective)
        values.append(objective(r))
