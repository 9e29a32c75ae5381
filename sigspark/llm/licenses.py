"""Licence scan by patience alignment.

A text and a template become words (letters and digits, ASCII lower case). Words that occur once
in both anchor the alignment: the longest increasing run of their places is kept, and the gaps
between anchors are aligned again in the same way, where other words have become unique; gaps
without an anchor take the words their ends share. Coverage is the aligned share of the
template.

Where to align: pairs of neighbouring words that a template holds. A pair that a template holds
once votes for the place where an occurrence would begin; where a third of these pairs agree within
a quarter of the template, the words they span are an occurrence to align, so close copies are
aligned one by one. An occurrence found in part is aligned again with the words up to its
neighbours. Hits of one template at most ``GAP`` words apart are a region, and what is left of
a region between detections is aligned as a whole while it holds a third of the template's pairs.
Of detections that overlap, the one with more aligned words stays.

Defined cases: null and empty texts have no detection and no row; a null doc_id is passed on;
repeated rows give repeated rows; extra columns are ignored; an empty table gives no rows; two
templates with equally many aligned words go by coverage, then by the order of the templates.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sigspark.llm.common import text_slices
from sigspark.llm.decontamination import word_hashes
from sigspark.llm.license_texts import TEMPLATES

LEAST_COVERAGE, GAP, PAIR_SHARE = 0.8, 24, 0.34


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing run, by piles."""
    tops: list[int] = []
    top_at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(top_at[k - 1] if k else -1)
        tops[k : k + 1] = [v]
        top_at[k : k + 1] = [i]
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal words, both increasing; anchors first, then the gaps."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict = {}
        for k, (words, lo, hi) in enumerate(((a, a0, a1), (b, b0, b1))):
            for i in range(lo, hi):
                once.setdefault(words[i], ([], []))[k].append(i)
        both = sorted((x[0], y[0]) for x, y in once.values() if len(x) == 1 and len(y) == 1)
        anchors = [both[i] for i in increasing([j for _, j in both])]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if k > i + 1 and m > j + 1]
    return sorted(out)


def free(spans: list[tuple[int, int]], lo: int, hi: int, middle: int | None = None) -> tuple[int, int]:
    """What the sorted spans leave of lo to hi around its middle; nothing (lo, lo) if that is taken."""
    middle = (lo + hi) // 2 if middle is None else middle
    k = bisect_left(spans, (middle + 1,))
    if k:
        lo = max(lo, spans[k - 1][1])
    if k < len(spans):
        hi = min(hi, spans[k][0])
    return (lo, hi) if lo <= middle < hi else (lo, lo)


class Templates:
    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        hashes, edge = word_hashes([t for _, t in templates])
        self.words = [hashes[a:b].tolist() for a, b in zip(edge, edge[1:], strict=False)]
        pairs = sorted({(pair, t) for t, w in enumerate(self.words) for pair in zip(w, w[1:], strict=False)})
        self.count = np.bincount([t for _, t in pairs], minlength=len(templates))
        self.pairs = np.array([self.pair(np.uint64(x), np.uint64(y)) for (x, y), _ in pairs], np.uint64)
        by = np.argsort(self.pairs, kind="stable")
        self.pairs, self.owner = self.pairs[by], np.array([t for _, t in pairs])[by]
        both = [set(zip(w, w[1:], strict=False)) for w in self.words]
        #: (u, t): u is a part of t, so a detection of u may lie in one of t.
        self.parts = {(u, t) for u, x in enumerate(both) for t, y in enumerate(both) if len(x & y) >= LEAST_COVERAGE * len(x)}
        self.spots = []
        for a, b in zip(edge, edge[1:], strict=False):
            value, first, n = np.unique(self.pair(hashes[a : b - 1], hashes[a + 1 : b]), return_index=True, return_counts=True)
            self.spots.append((value[n == 1], first[n == 1]))

    @staticmethod
    def pair(x, y):
        with np.errstate(over="ignore"):
            return x * np.uint64(0x9E3779B97F4A7C15) ^ (y + np.uint64(0x51ED270B))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word places and templates of all pairs that a template holds."""
        pair = self.pair(words[:-1], words[1:])
        lo = np.searchsorted(self.pairs, pair)
        place = np.flatnonzero(self.pairs[np.minimum(lo, len(self.pairs) - 1)] == pair)
        n = np.searchsorted(self.pairs, pair[place], "right") - lo[place]
        own = np.repeat(lo[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(place, n), self.owner[own]

    def scan(self, words: np.ndarray, place: np.ndarray, template: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, aligned words, first word, last word + 1) of the detections in one text."""
        groups = [(t, at) for t in np.unique(template).tolist() if self.enough(words, at := place[template == t], t)]
        windows = {t: self.windows(words, at, t) for t, at in groups}
        found = []
        for t, _ in groups:
            spans: list[tuple[int, int]] = []
            for lo, hi, v in windows[t]:
                # Just a template's length first, which can't reach into a neighbour.
                narrow = free(spans, v, min(len(words), v + len(self.words[t])))
                if d := self.detection(words, *narrow, t) or self.detection(words, *free(spans, lo, hi), t):
                    insort(spans, d[2:])
                    found.append(d)
        kept = self.apart(found)
        for k, d in enumerate(kept):
            size = len(self.words[d[0]])
            if d[1] < size:
                lo = max(d[2] - 2 * size, kept[k - 1][3] if k else 0)
                hi = min(d[3] + 2 * size, kept[k + 1][2] if k + 1 < len(kept) else len(words))
                kept[k] = max(d, self.detection(words, lo, hi, d[0]) or d, key=lambda x: x[1])
        more = []
        for t, at in groups:
            spans = [d[2:] for d in kept if d[1] >= LEAST_COVERAGE * len(self.words[t]) or (d[0], t) not in self.parts]
            more += self.rest(words, at, t, windows[t], spans)
        return self.apart(kept + more) if more else kept

    def apart(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Of detections that overlap the one with more aligned words, in order of their places."""
        spans: list[tuple[int, int]] = []
        out = []
        for d in sorted(found, key=lambda d: (-d[1], len(self.words[d[0]]), d[0], d[2])):
            if free(spans, d[2], d[3]) == (d[2], d[3]):
                insort(spans, d[2:])
                out.append(d)
        return sorted(out, key=lambda d: d[2])

    def enough(self, words: np.ndarray, at: np.ndarray, t: int) -> bool:
        """Whether the places hold a share of the template's pairs."""
        least = PAIR_SHARE * self.count[t]
        return len(at) >= least and len(set(words[at].tolist())) >= least

    def detection(self, words: np.ndarray, lo: int, hi: int, t: int) -> tuple[int, int, int, int] | None:
        """What is aligned between two words, if it covers the template."""
        own = self.words[t]
        if hi - lo < LEAST_COVERAGE * len(own):
            return None
        pairs = self.compact(aligned(words[lo:hi].tolist(), own), len(own))
        return (t, len(pairs), lo + pairs[0][0], lo + pairs[-1][0] + 1) if len(pairs) >= LEAST_COVERAGE * len(own) else None

    def rest(self, words: np.ndarray, at: np.ndarray, t: int, windows: list[tuple[int, int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """Detections of one template between the sorted spans: in wider windows, then in whole regions."""
        size, out = len(self.words[t]), []

        def keep(lo: int, hi: int) -> bool:
            if d := self.detection(words, lo, hi, t):
                insort(spans, d[2:])
                out.append(d)
            return d is not None

        for lo, hi, _ in windows:
            wide = max(4, size // 4)
            keep(*free(spans, max(0, lo - wide), min(len(words), hi + wide), (lo + hi) // 2))
        cut = np.flatnonzero(np.diff(at) > GAP) + 1
        for first, last in zip(np.r_[0, cut].tolist(), np.r_[cut, len(at)].tolist(), strict=True):
            if not self.enough(words, at[first:last], t):
                continue
            lo, end = max(0, int(at[first]) - size), min(len(words), int(at[last - 1]) + 2 + size)
            while lo < end:
                k = bisect_left(spans, (lo, lo))
                if k and spans[k - 1][1] > lo:
                    lo = spans[k - 1][1]
                    continue
                hi = min(end, spans[k][0]) if k < len(spans) else end
                inside = at[np.searchsorted(at, lo) : np.searchsorted(at, hi - 1)]
                if not (self.enough(words, inside, t) and keep(lo, hi)):  # if found, both sides of it are next
                    lo = spans[k][1] if k < len(spans) else end
        return out

    def windows(self, words: np.ndarray, at: np.ndarray, t: int) -> list[tuple[int, int, int]]:
        """Words spanned by pairs that agree on where an occurrence begins, and that place; best supported first."""
        pairs, spot = self.spots[t]
        size = len(self.words[t])
        value = self.pair(words[at], words[at + 1])
        k = np.minimum(np.searchsorted(pairs, value), len(pairs) - 1)
        own = pairs[k] == value
        begin, n = np.unique(at[own] - spot[k[own]], return_counts=True)
        slack, total = max(1, size // 4), np.r_[0, np.cumsum(n)]
        lo, hi = np.searchsorted(begin, begin - slack), np.searchsorted(begin, begin + slack, "right")
        support = total[hi] - total[lo]
        tried: list[int] = []
        out = []
        for i in np.lexsort((-n, -support)).tolist():
            if support[i] < PAIR_SHARE * len(pairs):
                break
            v = int(begin[i])
            j = bisect_left(tried, v - slack)
            if j == len(tried) or tried[j] > v + slack:
                insort(tried, v)
                out.append((max(0, int(begin[lo[i]])), min(len(words), int(begin[hi[i] - 1]) + size), max(0, v)))
        return out

    @staticmethod
    def compact(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
        """The aligned words without stray ones at the ends that lie over a template away."""
        middle = len(pairs) // 2
        lo, hi = middle, middle
        while lo > 0 and pairs[lo][0] - pairs[lo - 1][0] <= max(4, size // 4) + pairs[lo][1] - pairs[lo - 1][1]:
            lo -= 1
        while hi + 1 < len(pairs) and pairs[hi + 1][0] - pairs[hi][0] <= max(4, size // 4) + pairs[hi + 1][1] - pairs[hi][1]:
            hi += 1
        return pairs[lo : hi + 1]


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, license, template, coverage, n_aligned, word_start, word_end of every detection."""
    schema = docs.select("doc_id").schema.add("license", "string").add("template", "long").add("coverage", "double")
    for name in ("n_aligned", "word_start", "word_end"):
        schema = schema.add(name, "long")

    def work(batches):
        known = Templates(templates)
        for (ids,), texts in text_slices(batches, ("doc_id",)):
            words, edge = word_hashes(texts)
            place, template = known.hits(words)
            owner = np.searchsorted(edge, place, "right") - 1
            inside = place + 1 < edge[owner + 1]
            place, template, owner = place[inside], template[inside], owner[inside]
            rows = []
            for d in np.unique(owner).tolist():
                own = owner == d
                rows += [(d, *x) for x in known.scan(words[edge[d] : edge[d + 1]], place[own] - edge[d], template[own])]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([known.names[r[1]] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] / len(known.words[r[1]]) for r in rows], pa.float64()),
                    *(pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4)),
                ],
                names=schema.names,
            )

    return docs.select("doc_id", "text").mapInArrow(work, schema)
