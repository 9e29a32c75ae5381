"""Removal of repeated 200-byte strings by threshold-bounded interval expansion.

A string of ``LENGTH`` bytes that starts at two places of the corpus is repeated; every byte it
covers is removed. The core is a Burrows-Wheeler transform and a breadth-first backward
extension of its intervals: level by level it fixes where neighbouring suffixes share 0, 1, 2 ...
bytes, each boundary once, and stops at ``LENGTH``. Boundaries that are still open then lie
between suffixes that share at least ``LENGTH`` bytes.

So that a transform holds all places that can share a string, and no more than a task can hold,
strings are dealt out by content. The anchor of a window of ``LENGTH`` bytes is its least
``GRAM``-byte string by hash; neighbouring windows mostly share theirs, and equal windows have
equal anchors at equal distance. Windows whose anchor occurs once in the corpus are unique. The
others go, with their bytes, to the group of their anchor: an occurrence's context covers all
windows it anchors. Equal contexts become one with a weight. Groups of more than ``MOST``
different contexts are dealt out again by the bytes that all windows of a class share (classes
of 16 distances to the anchor, then of one), which leaves each window in one group.

Identity of contexts and anchors rests on two 64-bit hashes together; bytes are compared in the
transform. Defined cases: null and empty texts have no bytes, keep nothing removed and the hash
of the empty string; texts shorter than ``LENGTH`` stay; a repeated row repeats its text and so
loses it; a null doc_id is passed on; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.llm.common import text_slices, whole_runs, written
from sigspark.llm.hashing import BASE, Hashes

LENGTH, GRAM = 200, 32
#: Different contexts of one group that are transformed together, and bytes of one transform.
MOST, CHUNK_ROWS = 4096, 3000
SEGMENT = 1 << 20
CLASSES = (16, 1)
POSITION = np.uint64((1 << 22) - 1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    n, size = len(x) - width + 1, 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def anchor_runs(segments: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor: segment, first window, windows, distance of the anchor
    from the first window, hash of the anchor, hash of the context."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    first = np.cumsum(sizes) - sizes
    valid = [np.arange(a, a + n - length + 1) for a, n in zip(first, sizes, strict=True) if n >= length]
    if not valid:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    at = np.concatenate(valid)
    hashes = Hashes(data)
    i = np.arange(len(data) - gram + 1)
    grams = hashes.of(i, i + gram)
    # Least by hash, then leftmost: the place stands in the low bits.
    least = sliding_least((grams & ~POSITION) | i.astype(np.uint64), length - gram + 1)
    anchor = (least[at] & POSITION).astype(np.int64)
    turn = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(at) != 1)) + 1
    start, end = np.r_[0, turn], np.r_[turn, len(at)]
    lo, n = at[start], end - start
    owner = np.searchsorted(first, lo, "right") - 1
    q = anchor[start]
    context = hashes.of(lo, lo + n + length - 1) ^ (n.astype(np.uint64) * np.uint64(BASE))
    return owner, lo - first[owner], n, q - lo, grams[q].view(np.int64), context.view(np.int64)


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in the order of their first ``depth`` symbols (0 to 256) at least."""
    n, have = len(text), 7
    wide = np.zeros(n + have, np.int64)
    wide[:n] = text
    key = np.zeros(n, np.int64)
    for k in range(have):
        key = (key << 9) | wide[k : k + n]
    order = np.argsort(key)
    key = key[order]
    fresh = np.r_[True, key[1:] != key[:-1]]
    slot = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n + depth * 2, np.int64)
    rank[n:] = -1
    rank[order] = slot
    while have < depth:
        tied = ~fresh | np.r_[~fresh[1:], False]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        own = order[where]
        base = rank[own]
        key = base * (n + 1) + rank[own + have] + 1
        by = np.argsort(key, kind="stable")
        own, key, base = own[by], key[by], base[by]
        order[where] = own  # tied places of a group are neighbours and stay its places
        changed = np.r_[True, key[1:] != key[:-1]]
        fresh[where] = changed
        rank[own] = np.maximum.accumulate(np.where(changed, where, 0))
        have *= 2
    return order


def open_boundaries(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True at j if the suffixes order[j - 1] and order[j] share ``length`` symbols or more
    (for suffixes without the separator 0 in those).

    An interval is the set of suffixes that begin with one string. Backward extension puts a
    symbol before it; an interval whose right boundary is still open fixes it at the level and
    is extended on the next, any other ends. Each boundary is fixed once, so intervals are at
    most as many as suffixes.
    """
    n = len(text)
    before = text[order - 1].astype(np.uint16)
    place = np.empty(n, np.int64)
    place[np.argsort(before, kind="stable")] = np.arange(n)
    spread = place + before  # a gap between the symbols
    back = np.zeros(n + 258, np.int64)
    back[spread] = place
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    left, right = np.array([0]), np.array([n])
    for _ in range(length):
        size = right - left
        one = left[size == 1]
        one = place[one[before[one] > 0]]
        many = np.flatnonzero(size > 1)
        count = size[many]
        rows = np.repeat(left[many] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        group = np.repeat(np.arange(len(many)), count)
        real = before[rows] > 0
        key = np.sort(group[real] * (n + 258) + spread[rows[real]])
        if len(key):
            edge = np.flatnonzero(np.diff(key) != 1)
            start, end = key[np.r_[0, edge + 1]] % (n + 258), key[np.r_[edge, len(key) - 1]] % (n + 258)
            left, right = np.r_[back[start], one], np.r_[back[end] + 1, one + 1]
        else:
            left, right = one, one + 1
        new = ~known[right]
        left, right = left[new], right[new]
        known[right] = True
        if not len(left):
            break
    return ~known


def repeated_windows(contexts: list[bytes], weights, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its windows start at two places or more, weights counted."""
    sizes = np.array([len(c) for c in contexts])
    raw = np.frombuffer(b"\x00".join(contexts) + b"\x00", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    text = raw.astype(np.int64) + 1
    text[ends] = 0
    windows = np.maximum(sizes - length + 1, 0)
    weight = np.zeros(len(text), np.int64)
    starts = ends - sizes
    real = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    weight[real] = np.repeat(np.asarray(weights, np.int64), windows)
    order = sorted_suffixes(text, length)
    inside = weight[order] > 0
    same = open_boundaries(text, order, length)[:-1] & inside & np.r_[False, inside[:-1]]
    group = np.cumsum(~same) - 1
    total = np.bincount(group, weight[order])
    repeated = np.zeros(len(text), bool)
    repeated[order] = inside & (total[group] >= 2)
    return [repeated[s : s + w] for s, w in zip(starts, windows, strict=True)]


def runs_of(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edges[::2].tolist(), edges[1::2].tolist()


def staged(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_bytes, z: rows numbered once, texts as compressed UTF-8; written."""
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("z", "binary")

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3).compress
        for (ids,), texts in text_slices(batches, ("doc_id",)):
            raw = [(t or "").encode() for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(r) for r in raw], pa.int64()), pa.array([press(r) for r in raw], pa.binary())], names=schema.names)

    return written(docs.select("doc_id", "text").mapInArrow(pack, schema).withColumn("rid", F.monotonically_increasing_id()))


def anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """h, c, rid, lo, n, rel of every anchor occurrence of the staged texts."""
    names = ["h", "c", "rid", "lo", "n", "rel"]

    def work(batches):
        def emit(held):
            owner, lo, n, rel, h, c = anchor_runs([s for _, _, s in held], length, gram)
            rid, base = (np.array([x[k] for x in held], np.int64)[owner] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, rid, base + lo, n, rel)], names=names)

        undo = zstandard.ZstdDecompressor().decompress
        held, size = [], 0
        for batch in batches:
            for rid, z in zip(batch.column("rid").to_pylist(), batch.column("z"), strict=True):
                raw = undo(z.as_py())
                for at in range(0, len(raw) - length + 1, SEGMENT):  # segments overlap, windows don't
                    part = raw[at : at + SEGMENT + length - 1]
                    if held and size + len(part) > SEGMENT:
                        yield emit(held)
                        held, size = [], 0
                    held.append((rid, at, part))
                    size += len(part)
        if held:
            yield emit(held)

    return rows.select("rid", "z").mapInArrow(work, "h long, c long, rid long, lo long, n long, rel long")


def contexts(found: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """g, c, w, rel, context: each different context once, with its number of occurrences."""
    once = found.groupBy("h", "c").agg(F.count("*").alias("w"), F.min(F.struct("rid", "lo", "n", "rel")).alias("r"))
    lists = once.groupBy("r.rid").agg(F.collect_list(F.struct("h", "c", "w", "r.lo", "r.n", "r.rel")).alias("own"))  # of one document

    def fetch(batches):
        undo = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            own = batch.column("own")
            cut = own.offsets.to_numpy()
            value = {k: own.values.field(k).to_numpy() for k in ("h", "c", "w", "lo", "n", "rel")}
            for at in range(0, batch.num_rows, 64):
                to = min(at + 64, batch.num_rows)
                parts = []
                for i in range(at, to):
                    raw = undo(batch.column("z")[i].as_py())
                    parts += [raw[value["lo"][j] : value["lo"][j] + value["n"][j] + length - 1] for j in range(cut[i], cut[i + 1])]
                s = slice(cut[at], cut[to])
                yield pa.RecordBatch.from_arrays([*(pa.array(value[k][s]) for k in ("h", "c", "w", "rel")), pa.array(parts, pa.binary())], names=["g", "c", "w", "rel", "context"])

    return written(lists.join(rows.select("rid", "z"), "rid").select("own", "z").mapInArrow(fetch, "g long, c long, w long, rel long, context binary"))


def expanded(groups: DataFrame, length: int) -> DataFrame:
    """g, c, starts, ends: runs of repeated windows of each context; whole groups meet in a task."""

    def work(batches):
        for table in whole_runs(batches, ("g",), CHUNK_ROWS):
            flags = repeated_windows(table.column("context").to_pylist(), table.column("w").to_numpy(), length)
            found = [(i, *runs_of(f)) for i, f in enumerate(flags) if f.any()]
            rows = pa.array([i for i, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(table.column(k).combine_chunks().take(rows) for k in ("g", "c")), *(pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (1, 2))], names=["g", "c", "starts", "ends"]
            )

    return groups.select("g", "c", "w", "context").repartition("g").sortWithinPartitions("g").mapInArrow(work, "g long, c long, starts array<long>, ends array<long>")


def classes(wide: DataFrame, width: int, length: int) -> DataFrame:
    """pg, pc, first, g, c, w, rel, context: contexts cut by distance to the anchor, dealt out by
    the bytes that all windows of a class share."""

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for g, c, w, rel, context in zip(*(part.column(k).to_pylist() for k in ("g", "c", "w", "rel", "context")), strict=True):
                    n, i = len(context) - length + 1, 0
                    while i < n:
                        kind = (rel - i) // width
                        end = min(n, rel - kind * width + 1)
                        core = context[rel - kind * width : rel - kind * width - width + 1 + length] if width > 1 else context[i : i + length]
                        own = context[i : end - 1 + length]
                        key = xxhash.xxh64_intdigest(core, kind) ^ (g & (1 << 64) - 1)
                        out.append((g, c, i, key, xxhash.xxh64_intdigest(own, end - i), w, rel - i, own))
                        i = end
                columns = list(zip(*out, strict=True))
                arrays = [pa.array(np.array(columns[k], np.uint64).view(np.int64) if k in (3, 4) else columns[k]) for k in range(7)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(columns[7], pa.binary())], names=["pg", "pc", "first", "g", "c", "w", "rel", "context"])

    return wide.select("g", "c", "w", "rel", "context").mapInArrow(work, "pg long, pc long, first long, g long, c long, w long, rel long, context binary")


def settled(groups: DataFrame, length: int, most: int = MOST, widths: tuple[int, ...] = CLASSES) -> DataFrame:
    """g, c, starts, ends of all groups; those over ``most`` contexts by way of their classes."""
    wide = written(groups.groupBy("g").agg(F.count("*").alias("members")).filter(F.col("members") > most).select("g"))
    if not widths or wide.isEmpty():
        return expanded(groups, length)
    parts = written(classes(groups.join(wide, "g", "left_semi"), widths[0], length))
    own = parts.groupBy("g", "c").agg(F.sum("w").alias("w"), F.min(F.struct("rel", "context")).alias("r")).select("g", "c", "w", "r.rel", "r.context")
    shared = own.groupBy("g").agg(F.sum("w").alias("all")).filter("all > 1").select("g")
    found = settled(written(own.join(shared, "g", "left_semi")), length, most, widths[1:])
    shift = lambda column: F.transform(column, lambda x: x + F.col("first"))
    back = parts.select("pg", "pc", "first", "g", "c").join(found, ["g", "c"]).select(F.col("pg").alias("g"), F.col("pc").alias("c"), shift("starts").alias("starts"), shift("ends").alias("ends"))
    return expanded(groups.join(wide, "g", "left_anti"), length).unionByName(back)


def kept_parts(raw: bytes, starts: list[int], ends: list[int], length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs of bytes, and what is left, from runs of repeated windows."""
    spans: list[list[int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e - 1 + length)
        else:
            spans.append([s, e - 1 + length])
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return [(a, b) for a, b in spans], b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, span_starts, span_ends (removed byte runs), kept (remaining bytes) of every row."""
    rows = staged(docs)
    all_anchors = anchors(rows, length, gram)
    twice = written(all_anchors.groupBy("h").count().filter("count > 1").select("h"))  # a plain table: the join can split hot anchors
    found = written(all_anchors.join(twice, "h", "left_semi"))
    verdict = settled(contexts(found, rows, length), length, most)
    hit = found.select(F.col("h").alias("g"), "c", "rid", "lo").join(verdict, ["g", "c"])
    shift = lambda column: F.transform(column, lambda x: x + F.col("lo"))
    lists = hit.groupBy("rid").agg(F.flatten(F.collect_list(shift("starts"))).alias("starts"), F.flatten(F.collect_list(shift("ends"))).alias("ends"))  # of one document
    schema = rows.select("doc_id", "n_bytes").schema.add("span_starts", T.ArrayType(T.LongType())).add("span_ends", T.ArrayType(T.LongType())).add("kept", "binary")

    def remove(batches):
        undo = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [kept_parts(undo(z), s or [], e or [], length) for z, s, e in zip(*(part.column(k).to_pylist() for k in ("z", "starts", "ends")), strict=True)]
                spans = [pa.array([[x[k] for x in s] for s, _ in out], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *spans, pa.array([k for _, k in out], pa.binary())], names=schema.names)

    return rows.join(lists, "rid", "left").select("doc_id", "n_bytes", "z", "starts", "ends").mapInArrow(remove, schema)
