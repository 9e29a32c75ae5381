"""Benchmark decontamination by spaced seeds.

Texts become words (runs of letters and digits, ASCII lower case) and 64-bit word hashes. A seed
is a window of ``SPAN`` words under a fixed mask; the words at the mask's zeros are ignored, so a
substitution there leaves the seed alone. A hit of a seed that at most ``FEW`` items hold is the seed. A
hit of any other is the seed and one more word that agrees, at most five words beside the window: a
stretch that passes has one beside some seed of its own, or else a part on one side of the gap passes
by itself. Benchmark and documents are then joined by the hash of both, so a phrase of one window that
many items share pairs a document only with the items that go on as the document does. (All words of
an item of fewer than ``LEAST`` words must agree: its seeds stand alone.)

Around each hit the two word sequences are compared on its diagonal, of which only the part under
the item travels, so a copy of the whole benchmark costs what its length costs: the best stretch by +1 a match and -2 a mismatch counts if it holds ``LEAST`` matches (all words of a
shorter item) and four of five of its words agree. If it fails either, the stretch with the most
matches is tried, of all those of which four of five words agree.

Before the join a document's windows are tried against a bitmap of the benchmark's seeds, of
fixed size whatever the benchmark's; it only saves shuffling, and a full one lets everything
through. Documents send runs of hits with the words around them, never whole texts.

Defined cases: null and empty texts have no words and no overlap; items of fewer than ``SPAN``
words are too short to tell from prose and are left out; a null doc_id or item_id is passed on;
repeated rows give the same overlap once; extra columns are ignored; an empty documents or
benchmark table gives no rows; among overlaps with equally many matches the shortest, then the
earliest is reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.llm.common import text_slices, written
from sigspark.llm.hashing import BASE, Hashes

#: The masks; each spans SPAN words.
MASKS = ("11011011", "10111101", "11100111")
SPAN, LEAST, IDENTITY = 8, 10, 0.8
#: Words of a document sent along on either side of a run of hits.
MARGIN = 64
#: Items that may hold a seed before a hit of it needs one more word.
FEW = 4
#: Where the one more word of a hit may stand, from the window's start.
BESIDE = (*range(-5, 0), *range(SPAN, SPAN + 5))
BITMAP_BITS = 25

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = True
WORD_BYTE[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the edges of the texts in them."""
    raw = [(t or "").encode() for t in texts]
    data = LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    edge = np.flatnonzero(np.diff(np.r_[False, WORD_BYTE[data], False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(r) + 1 for r in raw])
    return Hashes(data).of(start, end), np.r_[0, np.searchsorted(start, ends)]


def seeds(words: np.ndarray) -> list[np.ndarray]:
    """For each mask, the hash of every window of SPAN words."""
    n, out = max(0, len(words) - SPAN + 1), []
    for m, mask in enumerate(MASKS):
        total = np.full(n, m + 1, np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                total += (words[k : k + n] ^ np.uint64(k * 0x51ED27)) * np.uint64((BASE * (2 * k + 1)) & (1 << 64) - 1)
        total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(total ^ (total >> np.uint64(29)))
    return out


def keys(seed: np.ndarray, place: np.ndarray, words: np.ndarray, first, last) -> tuple[np.ndarray, np.ndarray]:
    """For each place beside a window that lies in its text (words first to last): the window's number
    and the hash of its seed with the word there."""
    which, out = [], []
    for k, beside in enumerate(BESIDE):
        own = np.flatnonzero((place + beside >= first) & (place + beside < last))
        h = (seed[own] ^ np.uint64((BASE * (k + 1)) & (1 << 64) - 1)) + words[place[own] + beside] * np.uint64((BASE * (2 * k + 3)) & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        which.append(own)
        out.append(h ^ (h >> np.uint64(29)))
    return np.concatenate(which), np.concatenate(out)


def slots(h, bits: int = BITMAP_BITS):
    """The two bits of a seed in the bitmap."""
    return (h >> np.uint64(64 - bits)), (h & np.uint64((1 << bits) - 1))


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, words (hashes in order) of the items that are long enough."""
    schema = benchmark.select("item_id").schema.add("words", T.ArrayType(T.LongType()))

    def work(batches):
        for (ids,), texts in text_slices(batches, ("item_id",)):
            words, edge = word_hashes(texts)
            own = np.flatnonzero(np.diff(edge) >= SPAN)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), pa.array([words[edge[i] : edge[i + 1]].view(np.int64) for i in own], pa.list_(pa.int64()))], names=schema.names)

    return benchmark.select("item_id", "text").mapInArrow(work, schema)


def item_seeds(table: DataFrame) -> DataFrame:
    """seed, key, number, n, item_at: every window of the items under every mask, alone (the key is the
    seed) and, for an item of LEAST words, with every word beside it; n is the item's length."""

    def work(batches):
        for batch in batches:
            numbers, lists = batch.column("number").to_pylist(), batch.column("words")
            for number, words in zip(numbers, lists, strict=True):
                words = words.values.to_numpy().view(np.uint64)
                seed = np.concatenate(seeds(words))
                at = np.tile(np.arange(len(words) - SPAN + 1), len(MASKS))
                which, key = np.arange(len(seed)), seed
                if len(words) >= LEAST:
                    which, key = (np.r_[a, b] for a, b in zip((which, key), keys(seed, at, words, 0, len(words)), strict=True))
                same = [np.full(len(key), v, np.int64) for v in (number, len(words))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (seed[which].view(np.int64), key.view(np.int64), *same, at[which])], names=["seed", "key", "number", "n", "item_at"]
                )

    return table.select("number", "words").mapInArrow(work, "seed long, key long, number long, n long, item_at long")


def hot_seeds(table: DataFrame) -> DataFrame:
    """seed: those that more than FEW items of LEAST words hold."""
    held = table.filter((F.col("key") == F.col("seed")) & (F.col("n") >= LEAST)).select("seed", "number").distinct()
    return held.groupBy("seed").agg(F.count(F.lit(1)).alias("items")).filter(F.col("items") > FEW).select("seed")


def needed(table: DataFrame, hot: DataFrame) -> DataFrame:
    """Of the rows of ``item_seeds``: a hot seed's with one more word, any other seed's alone."""
    alone = F.col("key") == F.col("seed")
    marked = table.join(hot.withColumn("hot", F.lit(True)), "seed", "left").withColumn("hot", F.col("hot").isNotNull())
    return marked.filter(F.when(F.col("n") < LEAST, alone).otherwise(alone != F.col("hot"))).drop("hot")


def bitmap(table: DataFrame, bits: int = BITMAP_BITS, column: str = "seed") -> bytes:
    """The benchmark's bitmap of a column of hashes: 2 ** bits bits, gathered as pages of 32,768."""
    high, low = F.shiftrightunsigned(column, 64 - bits), F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    slot = table.select(F.explode(F.array(high, low)).alias("slot")).select((F.col("slot") + 1).alias("slot"))
    pages = slot.groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = bytearray((1 << bits) // 8)
    for r in pages.collect():  # at most 2 ** bits / 32,768 pages of 4 KB
        out[(r["page"] - 1) * 4096 : r["page"] * 4096] = r["bits"]
    return bytes(out)


def held(bits: bytes, h: np.ndarray) -> np.ndarray:
    """Numbers of the hashes whose bits are both set, read from the bitmap as it is."""
    raw = np.frombuffer(bits, np.uint8)
    own = np.arange(len(h))
    for slot in slots(h):
        s = slot[own]
        own = own[(raw[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    return own


def hit_runs(docs: DataFrame, filter_bits: bytes, hot_bits: bytes, key_bits: bytes, key: str) -> DataFrame:
    """key, begin, words, hits (keys, word index in the run): runs of windows that the bitmap of seeds
    passes, with those of their keys that the bitmap of keys passes: the seed, and where the bitmap of
    hot seeds has it the seed with each word beside it."""
    schema = docs.select(key).schema.add("begin", "long").add("words", T.ArrayType(T.LongType()))
    schema = schema.add("keys", T.ArrayType(T.LongType())).add("places", T.ArrayType(T.LongType()))

    def work(batches):
        for (ids,), texts in text_slices(batches, (key,)):
            words, edge = word_hashes(texts)
            owner = np.repeat(np.arange(len(texts)), np.diff(edge))
            place, seed = [], []
            for h in seeds(words):
                own = held(filter_bits, h)
                own = own[owner[own] == owner[own + SPAN - 1]]
                place.append(own)
                seed.append(h[own])
            place, seed = np.concatenate(place), np.concatenate(seed)
            by = np.argsort(place, kind="stable")
            place, seed = place[by], seed[by]
            if not len(place):
                continue
            turn = np.flatnonzero((np.diff(place) > MARGIN) | (np.diff(owner[place]) != 0)) + 1
            first, last = np.r_[0, turn], np.r_[turn, len(place)]
            doc = owner[place[first]]
            begin, end = np.maximum(place[first] - MARGIN, edge[doc]), np.minimum(place[last - 1] + SPAN + MARGIN, edge[doc + 1])
            own = owner[place]
            hot = held(hot_bits, seed)
            which, more = keys(seed[hot], place[hot], words, edge[own[hot]], edge[own[hot] + 1])
            which, hashes = np.r_[np.arange(len(seed)), hot[which]], np.r_[seed, more]
            own = held(key_bits, hashes)
            which, hashes = which[own], hashes[own]
            by = np.argsort(which, kind="stable")
            which, hashes = which[by], hashes[by].view(np.int64)
            low, high = np.searchsorted(which, first), np.searchsorted(which, last)
            lists = lambda parts: pa.array(parts, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(doc)),
                    pa.array(begin - edge[doc]),
                    lists([words[a:b].view(np.int64) for a, b in zip(begin, end, strict=True)]),
                    lists([hashes[a:b] for a, b in zip(low, high, strict=True)]),
                    lists([place[which[a:b]] - s for a, b, s in zip(low, high, begin, strict=True)]),
                ],
                names=schema.names,
            )

    return docs.select(key, "text").mapInArrow(work, schema)


def stretch(match: np.ndarray) -> tuple[int, int, int]:
    """start, end and matches of the stretch with the most matches less twice its mismatches."""
    total = np.r_[0, np.cumsum(np.where(match, 1, -2))]
    least = np.minimum.accumulate(total)
    end = int(np.argmax(total - least))
    start = int(np.flatnonzero(total[: end + 1] == least[end])[-1])
    return start, end, int(match[start:end].sum())


def passage(match: np.ndarray) -> tuple[int, int, int]:
    """start, end and matches of the stretch with the most matches of those with IDENTITY; zeros without a match.

    It begins and ends with a match. With i matches before a start and j to an end, identity holds
    where 5 * j - 4 * end is at least 5 * i - 4 * start, so the least start of each end is found in
    the running minimum.
    """
    at = np.flatnonzero(match)
    if not len(at):
        return 0, 0, 0
    order = np.arange(len(at))
    opened, closed = 5 * order - 4 * at, 5 * (order + 1) - 4 * (at + 1)
    first = np.searchsorted(-np.minimum.accumulate(opened), -closed)
    n = order - first + 1
    last = np.flatnonzero(n == n.max())
    last = int(last[np.argmin(at[last] - at[first[last]])])
    return int(at[first[last]]), int(at[last]) + 1, int(n[last])


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, item_id, n_match, n_overlap, doc_word, item_word: the longest verified overlap of each
    document and item."""
    known = written(items(benchmark).withColumn("number", F.monotonically_increasing_id()))
    every = written(item_seeds(known).distinct())
    hot = written(hot_seeds(every))
    table = written(needed(every, hot))
    runs = written(hit_runs(docs, bitmap(table), bitmap(hot), bitmap(table, column="key"), key).withColumn("run", F.monotonically_increasing_id()))
    hits = runs.select("run", F.explode(F.arrays_zip("keys", "places")).alias("h")).select("run", F.col("h.keys").alias("key_"), F.col("h.places").alias("place"))
    diagonals = hits.join(table.withColumnRenamed("key", "key_"), "key_").select("run", "number", "n", (F.col("place") - F.col("item_at")).alias("shift")).distinct()
    start, end = F.greatest(F.lit(0), "shift"), F.least(F.size("words"), F.col("shift") + F.col("n"))
    part = F.slice("words", (start + 1).cast("int"), F.greatest(F.lit(0), end - start).cast("int"))
    parts = diagonals.join(runs.select("run", key, "begin", "words"), "run").select(key, "begin", "number", "shift", part.alias("doc_words"))
    pairs = parts.join(known.select("number", "item_id", F.col("words").alias("item_words")), "number")
    schema = pairs.select(key, "item_id").schema
    for name in ("n_match", "n_overlap", "doc_word", "item_word"):
        schema = schema.add(name, "long")

    def verify(batches):
        for batch in batches:
            rows, out = [], []
            begins, shifts = batch.column("begin").to_pylist(), batch.column("shift").to_pylist()
            for i, (begin, shift) in enumerate(zip(begins, shifts, strict=True)):
                doc, item = (batch.column(c)[i].values.to_numpy() for c in ("doc_words", "item_words"))
                a = max(0, shift)
                match = doc == item[a - shift : a - shift + len(doc)]
                start, end, n = stretch(match)
                if n < min(LEAST, len(item)) or n < IDENTITY * (end - start):
                    start, end, n = passage(match)
                if n >= min(LEAST, len(item)):
                    rows.append(i)
                    out.append((n, end - start, begin + a + start, a - shift + start))
            columns = list(zip(*out, strict=True)) or [()] * 4
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (key, "item_id")), *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    found = pairs.select(key, "item_id", "begin", "shift", "doc_words", "item_words").mapInArrow(verify, schema)
    best = F.max(F.struct("n_match", (-F.col("n_overlap")).alias("o"), (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("b")
    return found.groupBy(key, "item_id").agg(best).select(key, "item_id", "b.n_match", (-F.col("b.o")).alias("n_overlap"), (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word"))
