"""Quality classifier: a linear-chain conditional random field over lines, in numpy.

Each line is good or bad. A line's features come from its bytes and words and from those of the
lines before and after; the chain adds a weight for each pair of neighbouring labels. Training
maximises the likelihood of line labels taken from the document's label, by forward-backward
gradients, on the driver, over a bounded sample of the training fold: ``SAMPLE_DOCS`` documents
at most, ``SAMPLE_CHARS`` characters of each. Scoring reads all lines of every text; a
document's quality is the mean of its lines' marginals, weighted by length.

Defined cases: null and empty texts and texts of blank lines get the training share of good
documents (0.5 without any labelled row); a null doc_id counts as the empty text in the fold's
CRC; repeated label rows count repeatedly; labels other than 0 and 1 are ignored; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import id_crc, text_slices
from sigspark.llm.hashing import Hashes, words_of

#: Bounds of the training sample.
SAMPLE_DOCS, SAMPLE_CHARS = 2400, 6000
THRESHOLD = 0.3

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def class_of(characters: bytes) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(characters)] = 1
    return out


#: Byte classes whose share of a line is a feature.
CLASSES = np.stack([class_of(bytes(range(65, 91))), class_of(bytes(range(97, 123))), class_of(b"0123456789"), class_of(b"#*$%&<>"), class_of(b"|"), class_of(b"!"), class_of(b".,;:?"), class_of(bytes(range(128, 256)))])
OWN = len(CLASSES) + 7
FEATURES = 3 * OWN + 1


def lines_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and start, end and document of each line with a word."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.r_[0, ends[:-1] + 1]
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, "right")
    first, _ = words_of(data)
    held = np.searchsorted(first, ends) > np.searchsorted(first, starts)
    return data, starts[held], ends[held], owner[held]


def own_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(lines, OWN) shares of byte classes and habits of the words."""
    length = (ends - starts).astype(np.float64)
    out = np.empty((len(starts), OWN))
    for k, table in enumerate(CLASSES):
        total = np.r_[0.0, np.cumsum(table[data], dtype=np.float64)]
        out[:, k] = (total[ends] - total[starts]) / length
    a, b = words_of(data)
    line = np.searchsorted(starts, a, "right") - 1
    hashes = Hashes(LOWER[data]).of(a, b)
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])]
    before = np.r_[False, False, (hashes[2:] == hashes[:-2]) & (line[2:] == line[:-2])] if len(a) > 1 else np.zeros(len(a), bool)
    n = np.maximum(np.bincount(line, minlength=len(starts)), 1)
    count = lambda flags: np.bincount(line, flags, len(starts)) / n
    upper = CLASSES[0][data[a]]
    last = data[b - 1]
    k = len(CLASSES)
    out[:, k] = count(same)
    out[:, k + 1] = count(before)
    out[:, k + 2] = count(b - a) / 10
    out[:, k + 3] = count(upper)
    out[:, k + 4] = count(CLASSES[3][last] + CLASSES[5][last])
    out[:, k + 5] = np.minimum(np.log1p(length) / 8, 2)
    out[:, k + 6] = np.minimum(np.log1p(n) / 6, 2)
    return out


def features(data, starts, ends, owner) -> np.ndarray:
    """Own features, those of the lines before and after in the same document, and a constant."""
    own = own_features(data, starts, ends)
    before, after = np.zeros_like(own), np.zeros_like(own)
    linked = (owner[1:] == owner[:-1])[:, None]
    before[1:], after[:-1] = own[:-1] * linked, own[1:] * linked
    return np.hstack([own, before, after, np.ones((len(own), 1))])


def marginals(score: np.ndarray, trans: np.ndarray, first: np.ndarray, count: np.ndarray, inside: np.ndarray | None = None):
    """P(good) of each line; with ``inside`` (lines that have a next one in their chain) also
    the joint marginals (inside, label, next label). score: the line's log weight of good over bad; chains start at
    ``first`` and have ``count`` lines. All chains step together, the long ones last."""
    by = np.argsort(-count, kind="stable")
    first, count = first[by], count[by]
    emit = np.exp(np.stack([np.minimum(0, -score), np.minimum(0, score)], 1))  # bad, good; the larger is 1
    pair = np.exp(trans)
    forward = np.empty((len(score), 2))
    longest = int(count[0]) if len(count) else 0
    live = np.searchsorted(-count, -np.arange(longest), "left")  # chains longer than t
    now = None
    for t in range(longest):
        n = live[t]
        at = first[:n] + t
        now = emit[at] if t == 0 else (now[:n] @ pair) * emit[at]
        now = now / now.sum(1, keepdims=True)
        forward[at] = now
    back, later = np.ones((len(first), 2)), np.empty((len(score), 2))
    for t in reversed(range(longest)):
        n = live[t]
        at = first[:n] + t
        later[at] = back[:n]
        step = (emit[at] * back[:n]) @ pair.T
        back[:n] = step / step.sum(1, keepdims=True)
    single = forward * later
    single /= single.sum(1, keepdims=True)
    if inside is None:
        return single[:, 1]
    joint = forward[inside][:, :, None] * pair * (emit * later)[inside + 1][:, None, :]
    return single[:, 1], joint / joint.sum((1, 2), keepdims=True)


class LineField:
    """weights: log odds of good from a line's features; trans: (2, 2) by label, then next label."""

    def __init__(self, weights=None, trans=None, mean=None, spread=None, share: float = 0.5):
        self.weights = np.zeros(FEATURES) if weights is None else weights
        self.trans = np.zeros((2, 2)) if trans is None else trans
        self.mean, self.spread, self.share = (0.0 if mean is None else mean), (1.0 if spread is None else spread), share

    def train(self, texts: list[str | None], labels: list[int], rounds: int = 160, rate: float = 0.08, decay: float = 1e-3) -> LineField:
        """Gradient of the chain likelihood: observed less expected labels and label pairs."""
        data, starts, ends, owner = lines_of(texts)
        self.share = float(np.mean(labels)) if labels else 0.5
        if not len(starts):
            return self
        x = features(data, starts, ends, owner)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-3
        self.mean[-1], self.spread[-1] = 0, 1
        x = (x - self.mean) / self.spread
        y = np.asarray(labels, float)[owner]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        count = np.diff(np.r_[first, len(owner)])
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        weight = (1 / np.sqrt(count))[np.cumsum(np.r_[0, owner[1:] != owner[:-1]])]  # long documents don't outvote
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inside].astype(int), y[inside + 1].astype(int)), weight[inside])
        m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
        total = weight.sum()
        for step in range(1, rounds + 1):
            p, joint = marginals(x @ self.weights, self.trans, first, count, inside)
            g = np.r_[(x * ((p - y) * weight)[:, None]).sum(0), ((joint * weight[inside, None, None]).sum(0) - seen).ravel()] / total
            g += decay * np.r_[self.weights, self.trans.ravel()]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.weights = self.weights - move[:FEATURES]
            self.trans = np.clip(self.trans - move[FEATURES:].reshape(2, 2), -3, 3)
        return self

    def line_scores(self, texts: list[str | None]):
        """start, end, document and P(good) of each line with a word."""
        data, starts, ends, owner = lines_of(texts)
        if not len(starts):
            return starts, ends, owner, np.zeros(0)
        x = (features(data, starts, ends, owner) - self.mean) / self.spread
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        return starts, ends, owner, marginals(x @ self.weights, self.trans, first, np.diff(np.r_[first, len(owner)]))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals for each text."""
        starts, ends, owner, p = self.line_scores(texts)
        size = (ends - starts).astype(float)
        total = np.bincount(owner, size, len(texts))
        good = np.bincount(owner, size * p, len(texts))
        return np.where(total > 0, np.clip(good / np.maximum(total, 1), 0, 1), self.share)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> LineField:
    """Train on labelled rows whose crc32(doc_id) mod 5 isn't 0: at most ``most`` drawn by hash."""
    known = labels.filter((id_crc() % 5 != 0) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = known.count()
    drawn = known.filter(F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(n, 1))))
    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    drawn = F.broadcast(drawn.limit(2 * most))  # bounded by the parameter
    rows = docs.select("doc_id", "text").join(drawn, "doc_id").select(F.col("text").substr(place, F.lit(chars)).alias("chunk"), "quality").limit(2 * most).collect()
    rows = sorted(((r["chunk"] or "", r["quality"]) for r in rows))
    return LineField().train([t for t, _ in rows], [q for _, q in rows])


def graded(docs: DataFrame, model: LineField) -> DataFrame:
    """doc_id, score of every row."""
    schema = docs.select("doc_id").schema.add("score", "double")

    def work(batches):
        for (ids,), texts in text_slices(batches, ("doc_id",)):
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.score(texts))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(work, schema)
