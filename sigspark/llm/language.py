"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

Training is backpropagation through time over windows of bytes, on the driver, from a
bounded sample of labelled windows (``SAMPLE_WINDOWS`` windows of ``SAMPLE_CHARS``
characters, drawn by hash from every row of the training fold). Prediction runs over all
bytes of every text: each position gets a probability per language, and a document's
probability is the mean over its letter bytes.

Defined cases: null text or text without a letter gives ``und`` with score 0; without any
labelled training row every text gives ``und``; a null doc_id counts as the empty text in
the fold's CRC; other columns are ignored, so clashing names do no harm. Repeated rows
give repeated results; a tie between languages goes to the alphabetically first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import id_crc, text_slices

#: Bounds of the training sample: the model never sees more than their product of characters.
SAMPLE_WINDOWS, SAMPLE_CHARS = 3000, 256
HIDDEN, WINDOW, LANES = 8, 128, 512
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"

#: Upper-case ASCII to lower; every other byte stays.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes that vote: ASCII letters and all bytes of non-ASCII characters.
VOTES = np.zeros(256, bool)
VOTES[97:123] = True
VOTES[128:] = True


class ByteGru:
    """Two gated recurrences (left to right, right to left) and a softmax at each position.

    A unit keeps z of its state and takes 1 - z of a candidate; z and candidate see the
    byte and the last state. Both squash by x / (1 + |x|), which costs a fraction of tanh:
    z = (1 + squash) / 2. table: (2, 2, 256, H) input weight of each byte per direction
    and gate (z, candidate); u: (2, 2, H, H) recurrent weights; out: (2, H, K); bias: (K,).
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, k = languages, len(languages)
        self.p = {
            "table": rng.normal(0, 0.3, (2, 2, 256, hidden)),
            "u": rng.normal(0, 0.5 / np.sqrt(hidden), (2, 2, hidden, hidden)),
            "out": rng.normal(0, 0.3, (2, hidden, k)),
            "bias": np.zeros(k),
        }

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray):
        """x: (B, T) bytes, y: (B,) class of each window; every position is scored."""
        p, (b, t) = self.p, x.shape
        ids = np.stack([x, x[:, ::-1]])
        h, kept = np.zeros((2, b, p["u"].shape[-1])), []
        for s in range(t):
            a = np.stack([p["table"][d][:, ids[d, :, s]] for d in (0, 1)])
            m = h[:, None] @ p["u"]
            a += m
            slope = 1 / (1 + np.abs(a))
            a *= slope
            z, n = 0.5 + 0.5 * a[:, 0], a[:, 1]
            kept.append((h, z, n, slope * slope))
            h = n + z * (h - n)
        states = np.stack([kept[s + 1][0] if s + 1 < t else h for s in range(t)])  # (T, 2, B, H)
        left, right = states[:, 0], states[::-1, 1]
        logits = left @ p["out"][0] + right @ p["out"][1] + p["bias"]
        logits -= logits.max(-1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(-1, keepdims=True)
        loss = -np.log(prob[:, np.arange(b), y] + 1e-12).mean()
        prob[:, np.arange(b), y] -= 1
        prob /= b * t
        g = {"bias": prob.sum((0, 1)), "out": np.stack([np.einsum("tbh,tbk->hk", left, prob), np.einsum("tbh,tbk->hk", right, prob)])}
        g["table"], g["u"] = np.zeros_like(p["table"]), np.zeros_like(p["u"])
        back, own = np.zeros_like(h), (prob @ p["out"][0].T, (prob @ p["out"][1].T)[::-1])
        for s in reversed(range(t)):
            h0, z, n, slope = kept[s]
            d = back + np.stack([own[0][s], own[1][s]])
            gates = np.stack([d * (h0 - n) * 0.5, d * (1 - z)], 1) * slope
            g["u"] += np.swapaxes(h0, -1, -2)[:, None] @ gates
            back = d * z + (gates @ np.swapaxes(p["u"], -1, -2)).sum(1)
            for k in (0, 1):
                for gate in (0, 1):
                    np.add.at(g["table"][k, gate], ids[k, :, s], gates[k, gate])
        return loss, g

    def train(self, texts: list[bytes], y: np.ndarray, steps: int = 300, batch: int = 96, width: int = 64, rate: float = 0.02, seed: int = 11) -> ByteGru:
        """Adam over random windows of the sample, classes drawn evenly."""
        rng = np.random.default_rng(seed)
        rows = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        data = [FOLD[np.frombuffer(t, np.uint8)] for t in texts]
        for step in range(1, steps + 1):
            classes = rng.integers(0, len(rows), batch)
            x = np.full((batch, width), 32, np.uint8)
            for i, k in enumerate(classes):
                own = data[rng.choice(rows[k])]
                at = rng.integers(0, max(1, len(own) - width + 1))
                cut = own[at : at + width]
                x[i, : len(cut)] = cut
            _, g = self.loss_and_gradient(x, classes)
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                self.p[k] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def frozen(self) -> dict:
        """Single-precision weights for prediction."""
        return {k: np.ascontiguousarray(v, np.float32) for k, v in self.p.items()}


def position_probabilities(w: dict, x: np.ndarray) -> np.ndarray:
    """(K, T, B) probabilities of the positions of x, (B, T) folded bytes."""
    b, t = x.shape
    hidden = w["u"].shape[-1]
    columns = np.ascontiguousarray(x.T).astype(np.intp)
    states = np.empty((2, t + 1, b, hidden), np.float32)
    states[:, 0] = 0
    a, m = (np.empty((2, 2, b, hidden), np.float32) for _ in range(2))
    z, n = a[:, 0], a[:, 1]
    for s in range(t):
        for d, at in ((0, s), (1, t - 1 - s)):
            for gate in (0, 1):
                np.take(w["table"][d, gate], columns[at], axis=0, out=a[d, gate], mode="clip")
        h = states[:, s]
        np.matmul(h[:, None], w["u"], out=m)
        a += m
        np.abs(a, out=m)
        m += 1
        a /= m
        z *= 0.5
        z += 0.5
        new = states[:, s + 1]
        np.subtract(h, n, out=new)
        new *= z
        new += n
    left, right = states[0, 1:].reshape(-1, hidden), np.ascontiguousarray(states[1, :0:-1]).reshape(-1, hidden)
    prob = w["out"][0].T @ left.T
    prob += w["out"][1].T @ right.T
    prob += w["bias"][:, None]
    np.exp(prob, out=prob)
    prob /= prob.sum(0)
    return prob.reshape(-1, t, b)


def pooled(w: dict, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Mean probabilities over the voting bytes of each text, and their number."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    k = len(w["bias"])
    total, votes = np.zeros((len(raw), k)), np.zeros(len(raw), np.int64)
    windows = [-(-len(r) // WINDOW) for r in raw]
    owner = np.repeat(np.arange(len(raw)), windows)
    x = np.full((len(owner), WINDOW), 32, np.uint8)
    at = 0
    for r, n in zip(raw, windows, strict=True):
        x.reshape(-1)[at * WINDOW : at * WINDOW + len(r)] = np.frombuffer(r, np.uint8)
        at += n
    x = FOLD[x]
    for s in range(0, len(x), LANES):
        part = x[s : s + LANES]
        said = VOTES[part]
        prob = position_probabilities(w, part)
        prob *= said.T
        np.add.at(total, owner[s : s + LANES], prob.sum(1).T)
        np.add.at(votes, owner[s : s + LANES], said.sum(1))
    return total / np.maximum(votes, 1)[:, None], votes


def label_runs(model: ByteGru, text: str | None) -> list[tuple[int, int, str]]:
    """The label of every byte of one text, as (start, end, language) runs."""
    raw = FOLD[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]
    if not len(raw) or not model.languages:
        return []
    x = np.full((-(-len(raw) // WINDOW), WINDOW), 32, np.uint8)
    x.reshape(-1)[: len(raw)] = raw
    label = position_probabilities(model.frozen(), x).argmax(0).T.reshape(-1)[: len(raw)]
    cuts = [0, *(np.flatnonzero(np.diff(label)) + 1), len(raw)]
    return [(int(a), int(b), model.languages[label[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def training_sample(docs: DataFrame, windows: int = SAMPLE_WINDOWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """lang, chunk: about ``windows`` hash-drawn windows, an even share for each language.

    Every row of the fold has the same chance within its language; counts come first, so
    that the draw is a filter and never a sort.
    """
    fold = docs.filter((id_crc() % 4 != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in fold.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(500).collect()}
    if not counts:
        return fold.select("lang", F.col("text").alias("chunk")).limit(0)
    odds = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, windows / len(counts) / n))])
    draw = F.pmod(F.xxhash64(F.lit("draw"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id", "text"), F.greatest(F.length("text") - chars + 1, F.lit(1)))
    return fold.filter(draw < odds[F.col("lang")]).select("lang", F.col("text").substr((place + 1).cast("int"), F.lit(chars)).alias("chunk"))


def fit(docs: DataFrame, windows: int = SAMPLE_WINDOWS) -> ByteGru:
    """Train on the fold whose crc32(doc_id) mod 4 isn't 2; the sample is bounded by ``windows``."""
    rows = sorted((r["lang"], r["chunk"]) for r in training_sample(docs, windows).limit(2 * windows).collect())
    languages = sorted({k for k, _ in rows})
    model = ByteGru(languages)
    if rows:
        model.train([t.encode() for _, t in rows], np.array([languages.index(k) for k, _ in rows]))
    return model


def identify(docs: DataFrame, model: ByteGru, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (doc_id if none are named), lang_pred, score and n_votes (letter
    bytes that were labelled) of every row."""
    keep = keep or ["doc_id"]
    languages, weights = model.languages, model.frozen()
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("n_votes", "long")

    def predict(batches):
        for own, texts in text_slices(batches, tuple(keep)):
            known = [bool(languages) and t is not None and LETTER.search(t) is not None for t in texts]
            if languages:
                prob, votes = pooled(weights, texts)
                best, top = prob.argmax(1), prob.max(1)
            else:
                best, top, votes = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            labels = pa.array([languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], pa.string())
            scores = pa.array([min(1.0, float(s)) if k else 0.0 for s, k in zip(top, known, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*own, labels, scores, pa.array(votes)], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(predict, schema)
