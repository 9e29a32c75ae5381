"""Minimax contiguous partition of ordered atomic groups into shards, DataFrame functions only.

Rows with equal texts are an atomic group; groups stand in the order of their text's hash. The
cut is the contiguous partition into at most ``shards`` ranges whose largest range is smallest:
the capacity is found by binary search, each candidate checked by filling shards greedily, and
the groups are cut there: each cut at the edge nearest to an even share of what is left, among
the edges that keep every shard within the capacity (filling from the right shows which).

No group list reaches the driver. It holds prefix sums at the edges of hash ranges only, at first
``COARSE`` ranges. For a candidate capacity a range can be taken as divisible (a lower bound of
the answer) or as one piece (an upper bound); only the ranges in which a cut can still fall
between the two bounds are split further, ``FINE`` ways each, until every such range is one
group and the bounds meet. The driver's table is bounded by those two numbers, the number of
shards and the 64 bits of the hash.

Defined cases: a null text has no bytes and is a group of its own; a null doc_id is passed on;
repeated rows share their group and get a slot each; extra columns are ignored; an empty table
gives no rows; a group larger than a fair share makes its shard as large as itself, which is the
optimum; ties in the order of slots go by doc_id.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigspark.llm.common import written

SHARDS = 40
COARSE, FINE = 12, 6  # bits of the hash: 4096 ranges, then 64 for each range that is split
#: Rows that a slot's window task should hold.
SLOT_ROWS = 50_000
KEY_BITS = 63
Range = tuple[int, int, bool, int]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key (place of the group in the order) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64("text"), 1)).cast("long").alias("key"),
    )


class Ranges:
    """Hash ranges in order: first key present, bytes, whether it is one group, bits below its prefix."""

    def __init__(self):
        self.rows: list[Range] = []

    def replace(self, old: set[int], new: list[Range]) -> None:
        self.rows = sorted([r for r in self.rows if r[0] not in old] + new)

    def greedy(self, capacity: int, shards: int, divisible: bool) -> list[tuple[int, int]] | None:
        """(range index, bytes before the cut) of each cut, or None if the shards don't suffice.

        divisible: ranges of several groups may be cut anywhere; else only between ranges.
        """
        total = self.ends[-1] if self.ends else 0
        cuts, start = [], 0
        for _ in range(shards):
            if total - start <= capacity:
                return cuts
            reach = start + capacity
            at = bisect_right(self.ends, reach)  # first range that doesn't fit whole
            whole = self.ends[at - 1] if at else 0
            stop = reach if divisible and not self.rows[at][2] else whole
            if stop <= start:
                return None
            cuts.append((at, stop))
            start = stop
        return None

    def sum_up(self) -> None:
        self.ends, total = [], 0
        for r in self.rows:
            total += r[1]
            self.ends.append(total)

    def smallest(self, shards: int, divisible: bool) -> int:
        """Binary search of the smallest capacity the greedy check accepts."""
        low, high = -(-self.ends[-1] // shards), self.ends[-1]
        while low < high:
            middle = (low + high) // 2
            if self.greedy(middle, shards, divisible) is None:
                low = middle + 1
            else:
                high = middle
        return low


def split(groups: DataFrame, ranges: list[Range], bits: int) -> list[Range]:
    """Each range cut by the next ``bits`` bits of the key: one aggregation for each depth."""
    out = []
    for below in sorted({r[3] for r in ranges}):
        rest = max(0, below - bits)
        asked = groups.sparkSession.createDataFrame([(r[0] >> below,) for r in ranges if r[3] == below], "prefix long")
        found = (
            groups.withColumn("prefix", F.shiftright("key", below) if below < KEY_BITS else F.lit(0).cast("long"))
            .join(F.broadcast(asked), "prefix")  # as many rows as ranges are split, bounded as said above
            .groupBy(F.shiftright("key", rest).alias("sub"))
            .agg(F.sum("bytes").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last"))
        )
        out += [(r["first"], r["bytes"], r["first"] == r["last"], rest) for r in found.collect()]
    return out


def even_cuts(ranges: Ranges, capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """Cuts (bytes before each) of shards within the capacity, as even as edges allow; and the
    divisible ranges in which a cut could still move."""
    ends, total, open_ = ranges.ends, ranges.ends[-1], set()

    def divisible(at: int) -> None:
        if not ranges.rows[at][2]:
            open_.add(at)

    least, stop = [0] * shards, total  # least[k]: where cut k must be at least, from the right
    for k in range(shards - 1, 0, -1):
        if stop > capacity:
            at = bisect_left(ends, stop - capacity)
            divisible(at)
            stop = least[k] = ends[at]
        else:
            stop = 0
    cuts, start = [], 0
    for k in range(1, shards):
        most = bisect_right(ends, start + capacity)
        ideal = start + (total - start) / (shards - k + 1)
        at = bisect_left(ends, ideal)
        for x in {min(most, len(ends) - 1), min(at, len(ends) - 1)}:
            divisible(x)
        near = min((e for e in (ends[at - 1] if at else 0, ends[min(at, len(ends) - 1)])), key=lambda e: abs(e - ideal))
        start = max(start, least[k], min(near, ends[most - 1] if most else 0))
        cuts.append(start)
    return cuts, open_


def cut_keys(groups: DataFrame, shards: int = SHARDS, coarse: int = COARSE, fine: int = FINE) -> tuple[list[int], int]:
    """First keys of the shards after the first, and the capacity. groups: key, bytes (one row a key)."""
    ranges = Ranges()
    ranges.replace(set(), split(groups, [(0, 0, False, KEY_BITS)], coarse))
    if not ranges.rows:
        return [], 0

    def refine(touched: set[int]) -> None:
        old = [ranges.rows[i] for i in sorted(touched)]
        ranges.replace({r[0] for r in old}, split(groups, old, fine))

    while True:
        ranges.sum_up()
        low, high = ranges.smallest(shards, True), ranges.smallest(shards, False)
        fine_cuts, whole_cuts = ranges.greedy(low, shards, True), ranges.greedy(high, shards, False)
        touched = set()
        for k in range(max(len(fine_cuts), len(whole_cuts))):
            a = fine_cuts[k] if k < len(fine_cuts) else (len(ranges.rows) - 1, ranges.ends[-1])
            b = whole_cuts[k] if k < len(whole_cuts) else (len(ranges.rows) - 1, ranges.ends[-1])
            first = bisect_left(ranges.ends, min(a[1], b[1]))
            last = min(len(ranges.rows) - 1, max(a[0], b[0]))
            touched |= {i for i in range(first, last + 1) if not ranges.rows[i][2]}
        if low == high or not touched:
            break
        refine(touched)
    while True:
        cuts, touched = even_cuts(ranges, high, shards)
        if not touched:
            break
        refine(touched)
        ranges.sum_up()
    first = [r[0] for r in ranges.rows] + [1 << KEY_BITS]
    return [first[bisect_right(ranges.ends, c)] for c in cuts], high


def assigned(docs: DataFrame, shards: int = SHARDS, coarse: int = COARSE, fine: int = FINE) -> DataFrame:
    """doc_id, size, text_crc32, key, shard, slot of every row; sizes of shards are minimax."""
    rows = written(sized(docs))
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    cuts, _ = cut_keys(groups, shards, coarse, fine)
    edges = F.array(*[F.lit(c).cast("decimal(20,0)") for c in cuts]) if cuts else F.array().cast("array<decimal(20,0)>")
    dealt = rows.withColumn("shard", F.size(F.filter(edges, lambda c: c <= F.col("key"))))
    # Slots: rank inside a bucket of bounded size, after the rows of the shard's earlier buckets.
    # A bucket is drawn from the id and the text's hash, so a group of copies spreads out.
    buckets = max(1, -(-rows.count() // (SLOT_ROWS * shards)))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "key", "size")) - 1
    return dealt.withColumn("own", own).join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "key", "shard", (F.col("own") + F.col("before")).cast("long").alias("slot"))
