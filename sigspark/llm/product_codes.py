"""Vector codes: one small codebook for each of eight parts of a vector, fitted in exact integers.

Components become integers. Tasks cut their vectors into chunks; in a chunk each part position is
sorted along a Hilbert curve and cut into flat blocks of neighbours, stored with the least and
greatest component in each direction (a box) and the sum of the points. A round sends the
codebooks to the chunks. From a block's box follow the least and greatest distance any of its
points can have to an entry; entries that can't be nearest leave the block's shortlist. A
shortlist of one takes the whole block by its stored sum, without a look at its points; the others
go through a small exact kernel over the shortlist. Only sums and counts of entries leave a task.

Chunks are written once and no vector moves between tasks; the driver holds the codebooks.

Exactness: kernels work on 64-bit integers where squares can't overflow, else on Python integers.
Sums travel in pieces of 40 bits, so they are exact for components of any size.

Defined cases: rows whose vector is null, or holds a null or non-finite component, are dropped; so are
rows whose number of components isn't a multiple of eight or isn't the commonest such number (ties: the
smaller); a null vec_id comes after all others, ties of vec_id go by the vector; repeated rows are
coded each; with fewer vectors than entries the codebook is that much smaller; ties of distance go to
the lower index; sums of errors beyond a long stop at the largest long; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import written

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Vectors in a chunk, points in a block.
CHUNK, BLOCK = 8192, 128
LIMB = 40
LONGEST = (1 << 63) - 1
CHUNK_ROW = "vec_id array<long>, label array<int>, place binary, flat binary, low binary, high binary, sums binary"
STORED = ("flat", "low", "high", "sums")
CHUNK_COLUMNS = ("vec_id", "label", "place", *STORED)


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, label of the rows that take part."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.filter(x.isNotNull() & whole & (F.size(x) > 0) & (F.size(x) % PARTS == 0)).select("vec_id", "embedding", "label")
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size(x) == F.lit(common["n"] if common else 0))


def integers(values: np.ndarray) -> np.ndarray:
    """floor(4096 x): 64-bit where squared distances fit, else Python integers."""
    x = values.astype(np.float64)
    if safe(np.abs(x).max(initial=0) * SCALE, x.shape[1]):
        return np.floor(x * SCALE).astype(np.int64)
    out = np.empty(x.size, object)
    out[:] = [int(v) * SCALE + math.floor((v - int(v)) * SCALE) for v in x.ravel().tolist()]
    return out.reshape(x.shape)


def safe(largest, width: int) -> bool:
    """Whether a sum of ``width`` squared differences of such components fits 64 bits."""
    return float(largest) < 2.0**30 and float(largest) ** 2 * 4 * max(width, 1) < 2.0**62


def hilbert(points: np.ndarray) -> np.ndarray:
    """Place of each point along a Hilbert curve over the points' own box (only the order of storage)."""
    n, width = points.shape
    width = min(width, 63)
    bits = max(1, min(12, 63 // width))
    x = points[:, :width].astype(np.float64)
    low, span = x.min(0), np.ptp(x, axis=0)
    with np.errstate(all="ignore"):
        x = np.nan_to_num((x - low) / np.where(span > 0, span, 1))
    axes = [a for a in np.minimum(x * (1 << bits), (1 << bits) - 1).astype(np.int64).T.copy()]
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the cubes, from the largest
        for i in range(width):
            at = (axes[i] & q) > 0
            swap = np.where(at, 0, (axes[0] ^ axes[i]) & (q - 1))
            axes[0] ^= np.where(at, q - 1, swap)
            if i:
                axes[i] ^= swap
        q >>= 1
    for i in range(1, width):
        axes[i] ^= axes[i - 1]
    turn, q = np.zeros(n, np.int64), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((axes[-1] & q) > 0, q - 1, 0)
        q >>= 1
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for a in axes:
            key = (key << 1) | (((a ^ turn) >> b) & 1)
    return key


class Part:
    """One part position of a chunk: points in Hilbert order, in flat blocks with boxes and sums.

    Points stay in their stored kind until a block is evaluated.
    """

    def __init__(self, points: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.points, self.place, self.low, self.high, self.sums = points, place, low, high, sums
        self.bounds = [(a, min(a + BLOCK, len(points))) for a in range(0, len(points), BLOCK)]
        self.kind = object if points.dtype == object else np.int64

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """For each block, which entries can be nearest to one of its points."""
        below, above = self.low[:, None] - entries, entries - self.high[:, None]
        near = (np.maximum(np.maximum(below, above), 0) ** 2).sum(-1)
        far = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(-1)  # to the farther side in each direction
        return near <= far.min(1)[:, None]

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the points nearest to each entry."""
        sums, counts = np.zeros((len(entries), self.points.shape[1]), self.kind), np.zeros(len(entries), np.int64)
        lists = self.shortlists(entries)
        single = lists.sum(1) == 1
        for b, (start, end) in enumerate(self.bounds):
            if single[b]:
                at = int(lists[b].argmax())
                sums[at] += self.sums[b]
                counts[at] += end - start
                continue
            points, listed = self.points[start:end].astype(self.kind), np.flatnonzero(lists[b])
            own = nearest(points, entries[listed])[0]
            mine = own == np.arange(len(listed))[:, None]
            sums[listed] += mine.astype(self.kind) @ points
            counts[listed] += mine.sum(1)
        return sums, counts

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of every vector of the chunk, in its first order."""
        code, error = np.empty(len(self.points), np.int64), np.empty(len(self.points), self.kind)
        lists = self.shortlists(entries)
        for b, (start, end) in enumerate(self.bounds):
            listed = np.flatnonzero(lists[b])
            own, distance = nearest(self.points[start:end].astype(self.kind), entries[listed])
            code[self.place[start:end]], error[self.place[start:end]] = listed[own], distance
        return code, error


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the first of equals) and the squared distance, exact."""
    distance = ((points[:, None] - entries) ** 2).sum(-1)
    own = distance.argmin(1)
    return own, distance[np.arange(len(points)), own]


def stored(values: np.ndarray) -> bytes:
    """The numbers as bytes, led by their kind: 2, 4 or 8 bytes each, or decimal text."""
    if values.dtype == object:
        return b"0" + ",".join(map(str, values.ravel().tolist())).encode()
    kind = next(k for k in (2, 4, 8) if k == 8 or np.abs(values).max() < 1 << 8 * k - 1)
    return str(kind).encode() + values.astype(f"<i{kind}").tobytes()


def loaded(data: bytes) -> np.ndarray:
    if data[:1] == b"0":
        values = [int(v) for v in data[1:].split(b",")]
        out = np.empty(len(values), object)
        out[:] = values
        return out
    return np.frombuffer(data, f"<i{data[:1].decode()}", offset=1)


def chunks(rows: DataFrame, size: int) -> DataFrame:
    """The vectors of each task in chunks: ids, labels, and parts as integers in Hilbert order."""

    def packed(ids: list, labels: list, values: np.ndarray) -> pa.RecordBatch:
        whole = integers(values)
        width, starts = whole.shape[1] // PARTS, np.arange(0, len(whole), BLOCK)
        parts = [whole[:, p * width : (p + 1) * width] for p in range(PARTS)]
        places = np.stack([np.argsort(hilbert(p), kind="stable") for p in parts]).astype("<i4")
        flat = np.stack([p[at] for p, at in zip(parts, places, strict=True)])
        blocks = [flat, *[f.reduceat(flat, starts, axis=1) for f in (np.minimum, np.maximum, np.add)]]
        columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.int32())), *[pa.array([x], pa.binary()) for x in (places.tobytes(), *map(stored, blocks))]]
        return pa.RecordBatch.from_arrays(columns, CHUNK_COLUMNS)

    def work(batches):
        ids, labels, values, n = [], [], [], 0
        for batch in batches:
            x = batch.column("embedding")
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            at = 0
            while at < len(x):
                take = min(size - n, len(x) - at)
                ids += batch.column("vec_id").slice(at, take).to_pylist()
                labels += batch.column("label").slice(at, take).to_pylist()
                values.append(x[at : at + take])
                n, at = n + take, at + take
                if n == size:
                    yield packed(ids, labels, np.concatenate(values))
                    ids, labels, values, n = [], [], [], 0
        if n:
            yield packed(ids, labels, np.concatenate(values))

    return rows.mapInArrow(work, CHUNK_ROW)


def unpacked(batches):
    """(ids, labels, parts) of every chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            place = np.frombuffer(batch.column("place")[i].as_buffer(), "<i4").reshape(PARTS, -1)
            flat, *blocks = [loaded(batch.column(c)[i].as_py()) for c in STORED]
            flat = flat.reshape(PARTS, place.shape[1], -1)
            blocks = [(b if b.dtype == object else b.astype(np.int64)).reshape(PARTS, -1, flat.shape[2]) for b in blocks]
            yield batch.column("vec_id")[i], batch.column("label")[i], [Part(*x) for x in zip(flat, place, *blocks, strict=True)]


def limbs(value: int):
    """(number, piece) of an integer in pieces of 40 bits; their weighted sum is the integer."""
    at = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        yield at, value & (1 << LIMB) - 1
        value >>= LIMB
        at += 1
    yield at, value


def entries_of(book: list[list[list[int]]], number: int, part: Part) -> np.ndarray:
    """The part's entries in its kind; a wide codebook makes the part wide too."""
    if part.kind is not object and not safe(max(abs(x) for e in book[number] for x in e), len(book[number][0])):
        part.kind, part.low, part.high, part.sums = object, *[x.astype(object) for x in (part.low, part.high, part.sums)]
    return np.array(book[number], dtype=part.kind).reshape(len(book[number]), -1)


def round_sums(table: DataFrame, book: list[list[list[int]]]) -> dict[tuple[int, int, int], int]:
    """(part, entry, position) -> sum of the points; position -1 holds their number."""

    def work(batches):
        sums: dict[tuple[int, int, int], int] = {}
        for _, _, parts in unpacked(batches):
            for p, part in enumerate(parts):
                found, counts = part.totals(entries_of(book, p, part))
                for e in np.flatnonzero(counts).tolist():
                    for at, v in [(-1, int(counts[e])), *enumerate(map(int, found[e].tolist()))]:
                        sums[p, e, at] = sums.get((p, e, at), 0) + v
        rows = [(*k, *piece) for k, v in sums.items() for piece in limbs(v)]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["part", "entry", "at", "limb", "v"])

    out: dict[tuple[int, int, int], int] = {}
    # 8 parts, 16 entries and the components of a part: a fixed number of rows.
    for r in table.select(*CHUNK_COLUMNS).mapInArrow(work, "part long, entry long, at long, limb long, v long").groupBy("part", "entry", "at", "limb").agg(F.sum("v").alias("v")).collect():
        key = (r["part"], r["entry"], r["at"])
        out[key] = out.get(key, 0) + (r["v"] << LIMB * r["limb"])
    return out


def fitted(table: DataFrame, seeds: list[list[int]], rounds: int = ROUNDS) -> list[list[list[int]]]:
    """Codebooks after the rounds: part -> entry -> components. seeds: the first vectors, in order."""
    width = len(seeds[0]) // PARTS
    book = [[s[p * width : (p + 1) * width] for s in seeds] for p in range(PARTS)]
    for _ in range(rounds):
        sums = round_sums(table, book)
        book = [[[sums.get((p, e, i), 0) // sums[p, e, -1] for i in range(width)] if (p, e, -1) in sums else old for e, old in enumerate(entries)] for p, entries in enumerate(book)]
    return book


def digest(book: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for part in book for entry in part for x in entry).encode()).hexdigest()


def coded(table: DataFrame, book: list[list[list[int]]]) -> DataFrame:
    """vec_id, label, code, error of every vector."""

    def work(batches):
        for ids, labels, parts in unpacked(batches):
            found = [part.codes(entries_of(book, p, part)) for p, part in enumerate(parts)]
            codes = np.stack([c for c, _ in found], 1).astype(np.uint8)
            text = codes.tobytes().hex()
            step = 2 * PARTS
            errors = [min(sum(int(e[i]) for _, e in found), LONGEST) for i in range(len(codes))]
            yield pa.RecordBatch.from_arrays(
                [ids.values, labels.values, pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(errors, pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    return table.select(*CHUNK_COLUMNS).mapInArrow(work, "vec_id long, label int, code string, error long")


def compressed(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, chunk: int = CHUNK) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, code, error, label_error of every kept row; the codebooks)."""
    rows = kept(vectors)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    if not first:
        empty = vectors.sparkSession.createDataFrame([], "vec_id long, label int, code string, error long, label_error long")
        return empty, [[] for _ in range(PARTS)]
    seeds = [[int(v) for v in integers(np.array([r["embedding"]], np.float64))[0]] for r in first]
    table = written(chunks(rows, chunk))
    book = fitted(table, seeds, rounds)
    codes = written(coded(table, book))
    largest = F.lit(LONGEST).cast("decimal(38,0)")
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), largest).cast("long").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of"), book


def decoded(codes: DataFrame, book: list[list[list[int]]]) -> DataFrame:
    """vec_id, vector: the entries that a code names, put together and scaled back."""
    vectors = [F.array(*[F.array(*[F.lit(x / SCALE) for x in e]) for e in part]) for part in book]
    parts = [F.element_at(v, (F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1)) for p, v in enumerate(vectors)]
    return codes.select("vec_id", F.concat(*parts).alias("vector"))


def oracle(entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same codes in SQL: every distance of every round."""
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0),
 comp AS MATERIALIZED (SELECT r, p, i, CAST(floor(4096*CAST(embedding[p*(len(embedding)//{PARTS})+i+1] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT *, unnest(range({PARTS})) AS p FROM kept) AS a, LATERAL (SELECT unnest(range(len(a.embedding)//{PARTS})) AS i) AS u),
 book0 AS MATERIALIZED (SELECT p, CAST(r-1 AS BIGINT) AS e, i, x FROM comp WHERE r<={entries})"""]
    for k in range(rounds + 1):
        steps.append(f"own{k} AS MATERIALIZED (SELECT r, p, min(s) AS s, arg_min(e, (s, e)) AS e FROM (SELECT c.r, c.p, b.e, CAST(sum((c.x-b.x)*(c.x-b.x)) AS BIGINT) AS s FROM comp c JOIN book{k} b USING (p, i) GROUP BY c.r, c.p, b.e) AS q GROUP BY r, p)")
        if k < rounds:
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.i, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (SELECT p, e, i, CAST(CASE WHEN sum(x)>=0 THEN sum(x)//count(*) ELSE -((-sum(x)+count(*)-1)//count(*)) END AS BIGINT) AS x FROM comp JOIN own{k} USING (r, p) GROUP BY p, e, i) AS m USING (p, e, i))")
    return f"""WITH {", ".join(steps)},
 codes AS (SELECT r, string_agg(lpad(lower(hex(e)),2,'0'), '' ORDER BY p) AS code, CAST(sum(s) AS BIGINT) AS error FROM own{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM book{rounds}) AS codebooks_sha256 FROM kept JOIN codes USING (r)"""
