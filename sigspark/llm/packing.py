"""Best-two-fit packing of token sequences.

Documents become token ids (one separator closes each); only documents longer than a
sequence are cut. Full pieces are sequences of their own. The rest is packed by length: the
histogram of lengths has fewer entries than a sequence has tokens, however large the corpus,
so the greedy fill and its improvement run on counts, many equal bins at a time, and give a
bounded list of patterns. Pieces find their place by their rank within their length, counted
in partitions first, so no length is collected into one task.

Best-two-fit: fill a bin greedily with the largest piece that fits; when none fits, replace the
bin's smallest piece with two unpacked pieces that fit the expanded gap more tightly, as long
as that helps.

Defined cases: null and empty texts are the separator alone; a null doc_id is passed on, and
repeated rows are packed as often as they come; extra columns are ignored; an empty table gives
no rows. Ties between pieces of one length go by partition and row order: every assignment is
equally tight.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections import ChainMap
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sigspark.llm.common import text_slices, written

SEQUENCE, SEPARATOR = 2048, 0
#: Words, and stems, whose ids a worker process keeps, about 200 bytes each.
CACHED_WORDS = 600_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of whole texts from ids of their words.

    The vocabulary drops white space and never joins across it, so a text's ids are those of
    its words in turn; it lower-cases, and punctuation never joins letters, so most words are
    letters and a tail in turn. Words and stems seen first stay in tables of bounded size, as
    the bytes of their ids; frequent ones are among them. Others are encoded with the slice that
    holds them.
    """

    #: Letters of the first 256 code points, then punctuation: lower case is plain there.
    STEM = re.compile(r"([^\W\d_]+)([^\w\s]*)")

    #: The vocabulary's white space: that of str.split() without SEPARATORS, which have ids.
    SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
    SEPARATORS = "\x1c\x1d\x1e\x1f"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.stems = Tokenizer.from_file(path), {}, {"": b""}

    def encoded(self, new: list[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of each word, many words to a call."""
        out = {}
        plain = [w for w in new if w.isascii() or w.isalpha()]
        for at in range(0, len(plain), 256):
            part = plain[at : at + 256]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            start = np.cumsum([0] + [len(w) + 1 for w in part])
            cut = np.searchsorted([o for o, _ in got.offsets], start)
            raw = np.array(got.ids, "<u4").tobytes()
            out.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        for w in set(new).difference(plain):
            out[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def words(self, new: set[str]) -> dict[str, bytes]:
        """Ids of words that aren't in the table, by way of their stems and tails."""
        parts = {}
        for w in new:
            m = self.STEM.fullmatch(w) if max(w) <= "\xff" else None
            parts[w] = (m[1].lower(), m[2]) if m else (w, "")
        fresh = self.encoded(sorted({x for p in parts.values() for x in p}.difference(self.stems)))
        table = self.stems
        if len(table) + len(fresh) <= CACHED_WORDS:
            table.update(fresh)
        else:
            table = ChainMap(fresh, table)
        return {w: table[a] + table[b] for w, (a, b) in parts.items()}

    def split(self, text: str) -> list[str]:
        """Words between the vocabulary's white space; str.split() is several times faster."""
        if any(c in text for c in self.SEPARATORS):
            return [w for w in self.SPACE.split(text) if w]
        return text.split()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.split(t or "") for t in texts]
        new = self.words(set(chain.from_iterable(split)).difference(self.known))
        if len(self.known) + len(new) <= CACHED_WORDS:
            self.known.update(new)
            new = {}
        end, known = np.array([SEPARATOR], "<u4").tobytes(), self.known.get
        find = (lambda w: known(w) or new[w]) if new else self.known.__getitem__
        return [np.frombuffer(b"".join(map(find, words)) + end, "<u4") for words in split]


@cache
def worker_ids(path: str) -> WordIds:
    """One table for each worker process, kept from task to task."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked, the ids of every piece."""
    schema = docs.select("doc_id").schema.add("piece", T.IntegerType()).add("start", "long").add("length", "long").add("ids_crc32", "long")
    schema = schema.add("ids", T.ArrayType(T.IntegerType())) if ids else schema

    def work(batches):
        words = worker_ids(tokenizer)
        for (own,), texts in text_slices(batches, ("doc_id",)):
            row, piece, start, length, crc, values = [], [], [], [], [], []
            for i, tokens in enumerate(words.encode(texts)):
                for k, at in enumerate(range(0, len(tokens), sequence)):
                    part = tokens[at : at + sequence]
                    row.append(i), piece.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                    if ids:
                        values.append(part.astype(np.int32))
            columns = [own.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(values, pa.list_(pa.int32()))] * ids, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def patterns(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """(number of bins, lengths in a bin) that use up the counts.

    A pattern takes all but a remainder of one of its lengths, and a remainder is under half of
    what was there, so there are at most lengths times log2(sequence) patterns.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    sizes = sorted(left)
    out = []

    def best(gap: int, used: dict[int, int]) -> int:
        """The largest length that fits and is still unpacked; 0 if none."""
        at = bisect_right(sizes, gap)
        while at and used.get(sizes[at - 1], 0) >= left[sizes[at - 1]]:
            at -= 1
        return sizes[at - 1] if at else 0

    def best_pair(gap: int, more: int, used: dict[int, int]) -> tuple[int, int] | None:
        """Two unpacked lengths whose sum is largest within the gap and over ``more``."""
        found, top = None, more
        free = [s for s in sizes if left[s] > used.get(s, 0)]
        low, high = 0, len(free) - 1
        while low <= high:
            both = free[low] + free[high]
            if both > gap:
                high -= 1
                continue
            if both > top and (low < high or left[free[low]] >= used.get(free[low], 0) + 2):
                found, top = (free[high], free[low]), both
            low += 1
        return found

    while sizes:
        bin_, used, gap = [], {}, sequence
        while (size := best(gap, used)) > 0:
            bin_.append(size)
            used[size] = used.get(size, 0) + 1
            gap -= size
        while gap and len(bin_) > 1:
            small = bin_[-1]
            used[small] -= 1
            pair = best_pair(gap + small, small, used)
            if pair is None:
                used[small] += 1
                break
            bin_ = sorted([*bin_[:-1], *pair], reverse=True)
            for size in pair:
                used[size] = used.get(size, 0) + 1
            gap += small - sum(pair)
        bins = min(left[s] // n for s, n in used.items() if n)
        out.append((bins, tuple(bin_)))
        for s, n in used.items():
            left[s] -= bins * n
        sizes = [s for s in sizes if left[s]]
    return out


def plan_rows(found: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """length, first rank, first sequence, sequences, copies in a bin, offset of the first copy.

    Ranks of a length are dealt to the patterns in turn; within a pattern a length's copies lie
    side by side. At most one row for each pattern and length in it.
    """
    rows, rank, first = [], {}, 0
    for bins, lengths in found:
        offset = 0
        for size in sorted(set(lengths), reverse=True):
            n = lengths.count(size)
            rows.append((size, rank.get(size, 0), first, bins, n, offset))
            rank[size] = rank.get(size, 0) + bins * n
            offset += n * size
        first += bins
    return rows


def packed(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer or default_tokenizer(), sequence).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    # (part, length) counts are the only thing that ranks need from other partitions.
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "part", before.alias("before"))
    # At most ``sequence`` rows reach the driver, and the plan is bounded by patterns().
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(plan_rows(patterns(histogram, sequence)), "length long, from_rank long, first long, bins long, copies int, at long")
    reach = F.array_sort(F.collect_list(F.struct("from_rank", "first", "bins", "copies", "at")))
    plan = plan.groupBy("length").agg(reach.alias("plan"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1
    ranked = cut.withColumn("own", rank).join(starts, ["length", "part"]).withColumn("rank", F.col("own") + F.col("before"))
    step = F.element_at(F.filter("plan", lambda p: p["from_rank"] <= F.col("rank")), -1)
    placed = ranked.join(F.broadcast(plan), "length").withColumn("p", step)  # bounded by the number of lengths
    turn = F.col("rank") - F.col("p.from_rank")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("p.first") + (turn % F.col("p.bins"))).alias("sequence_id"),
        (F.col("p.at") + F.floor(turn / F.col("p.bins")) * F.col("length")).cast("long").alias("offset"),
    )


def sequences(docs: DataFrame, plan: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves; a group holds one sequence."""
    own = pieces(docs, tokenizer or default_tokenizer(), sequence, ids=True).select("doc_id", "piece", "ids").dropDuplicates(["doc_id", "piece"])
    return plan.join(own, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
