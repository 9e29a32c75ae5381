"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is read as two 32-bit halves. Of two fingerprints with at most three
differing bits one half differs in at most one bit. On a half the anchors are the words of
a perfect covering code: the Hamming code of length 31 with a free 32nd bit, covering radius
1. Each fingerprint is replicated to every anchor within radius plus threshold, 1 + 1 = 2
bits: 17 anchors or fewer. Both ends of a link then meet at the nearest anchor of either,
where the 64 bits are compared. With 2**27 anchors a half, an anchor meets few distinct
fingerprints; one that meets very many is cut into blocks that meet two at a time.

Links are joined within the anchor: an anchor gives a row for each member, never its pairs.

Defined cases: null and blank texts have fingerprint zero, which links like any other; equal
fingerprints are one node; a null doc_id keeps its row, takes no part in naming the component
unless it is alone (component null); extra columns are ignored; repeated rows stay repeated.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import text_slices, whole_runs, written
from sigspark.llm.components import components

SHINGLE, SEED, THRESHOLD = 3, 42, 3
#: Members of one block of an anchor; more are cut into blocks, so a task holds two blocks.
BLOCK = 4096
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 without a word."""
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    joined = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in joined], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # big-endian bytes, so that column 0 is bit 63
        ones += np.unpackbits(hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""
    schema = docs.select("doc_id").schema.add("fp", "long")

    def work(batches):
        for (ids,), texts in text_slices(batches, ("doc_id",)):
            fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of fp and their anchors: every code word within two bits of either half.

    The syndrome of a half is the exclusive-or of the numbers of its set bits 1 to 31; it is
    the bit to turn for the nearest code word, and the pairs of bits whose numbers give it
    lead to the words two bits away. An anchor is 2 * word + half in a long.
    """
    rows, words = [], []
    index = np.arange(len(fp))
    for half in (0, 1):
        x = (fp.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        syndrome = np.zeros(len(x), np.uint64)
        for bit in range(1, 32):
            syndrome ^= ((x >> np.uint64(bit)) & np.uint64(1)) * np.uint64(bit)
        near = x ^ np.where(syndrome > 0, np.uint64(1) << syndrome, np.uint64(0))
        found = [(index, near), (index, near ^ np.uint64(1))]  # bit 0 of the half is the free one
        off = np.flatnonzero(syndrome > 0)
        for bit in range(1, 32):
            other = syndrome[off] ^ np.uint64(bit)
            own = other > np.uint64(bit)
            found.append((off[own], x[off[own]] ^ (np.uint64(1) << np.uint64(bit)) ^ (np.uint64(1) << other[own])))
        rows += [r for r, _ in found]
        words += [(w << np.uint64(1)) | np.uint64(half) for _, w in found]
    return np.concatenate(rows), np.concatenate(words).view(np.int64)


def local_links(fp: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """For each of the distinct fingerprints, the position of its component's first member."""
    root = np.arange(len(fp))
    bits = fp.view(np.uint64)
    for at in range(0, len(fp), 512):
        i, j = np.nonzero(np.bitwise_count(bits[at : at + 512, None] ^ bits[None, :]) <= threshold)
        i += at
        own = i < j
        i, j = i[own], j[own]
        while len(i):
            a, b = root[i], root[j]
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def link_edges(prints: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """a, b: edges over node ids that connect just what links of the distinct fingerprints connect.

    prints: node (long), fp (long, distinct).
    """
    if threshold > 3:
        raise ValueError("two halves with one differing bit cover three bits")

    def replicate(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                row, word = anchors_of(part.column("fp").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(word), *(part.column(c).take(pa.array(row)) for c in ("node", "fp"))], names=["anchor", "node", "fp"])

    spread = prints.select("node", "fp").mapInArrow(replicate, "anchor long, node long, fp long")
    # Anchors with one member link nothing; large ones get blocks.
    count = spread.groupBy("anchor").agg(F.count("*").alias("members")).filter("members > 1")
    large = written(count.filter(F.col("members") > block))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("own")) * F.col("blocks") + F.greatest(o, F.col("own")))
    cut = (
        spread.join(large, "anchor")
        .withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .select("anchor", F.explode(meets).alias("block"), "node", "fp")
    )
    plain = spread.join(large, "anchor", "left_anti").select("anchor", F.lit(0).alias("block"), "node", "fp")

    def link(batches):
        """Sorted rows in; all runs of equal (anchor, block) that a table holds at a time."""
        for rows in whole_runs(batches, ("anchor", "block")):
            anchor, part, node, fp = (rows.column(c).to_numpy() for c in ("anchor", "block", "node", "fp"))
            turn = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            start, end = np.r_[0, turn], np.r_[turn, len(anchor)]
            two = start[end - start == 2]
            two = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= threshold]
            a, b = [node[two]], [node[two + 1]]
            for s, e in zip(start[end - start > 2], end[end - start > 2], strict=True):
                root = local_links(fp[s:e], threshold)
                moved = np.flatnonzero(root != np.arange(e - s))
                a.append(node[s + root[moved]])
                b.append(node[s + moved])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    sorted_rows = plain.union(cut).repartition("anchor", "block").sortWithinPartitions("anchor", "block", "fp")
    return sorted_rows.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links) of every row."""
    prints = written(fingerprints(docs))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # The fingerprint itself is the node, so rows without an id link others and a repeated id links nothing.
    found = components(link_edges(nodes.select(F.col("fp").alias("node"), "fp")))
    member = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = member.groupBy("component").agg(F.min("least").cast("long").alias("component_id"))
    least = member.join(named, "component").select("fp", "component_id")
    return prints.join(least, "fp").select("doc_id", "fp", "component_id")
