"""Target-distribution importance resampling with hashed n-gram features.

A text is brought to lower case (A-Z only), every run of separators becomes one blank, and an
overlapped regex scan emits each run of ``n`` neighbouring words as a span: the lookarounds hold
it to word boundaries, so the span's bytes are the feature and go to CRC-32 as they are. One pass
over the texts writes each document's bucket numbers; counts are summed inside a task and then by
bucket, for the documents and for the target texts. A document's weight is the sum of its
buckets' gains, its score the weight plus Gumbel noise drawn from a hash of its id, and the
highest scores are drawn: a sample without replacement in proportion to the importance weights.

What the driver sees is one count for each bucket. Ranks come from distributed running sums.

Defined cases: a null or empty text has no feature, weight 0 and is never drawn (too few words); a
null doc_id takes noise from the text ``null`` and ranks after other ids; equal rows are rows of
their own with neighbouring ranks; ties of score go to the smaller doc_id; extra columns are
ignored; an empty table gives no rows, an empty target leaves the gains to the documents.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import text_slices, written
from sigspark.llm.ranks import TASK, counted, expanded, running

LEAST_N, MOST_N = 1, 1
BUCKETS = 10_000
LEAST_WORDS, PERCENT = 20, 10
SEED = "2024"
#: Bytes of a text as scanned: A-Z lowered, every other ASCII byte that isn't 0-9 or a-z a blank.
SCANNED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = rb"[^\x20]++"


def spans(n: int) -> regex.Pattern:
    """Runs of n words of a text with single blanks, found at every word (overlapped)."""
    return regex.compile(rb"(?<![^\x20])" + WORD + rb"(?:\x20" + WORD + rb"){%d}(?![^\x20])" % (n - 1))


def collapsed(text: str | None) -> bytes:
    return b" ".join((text or "").encode().translate(SCANNED).split())


def bucket_numbers(text: str | None, patterns: list[regex.Pattern], buckets: int) -> np.ndarray:
    """The bucket of every feature of a text, in the order of the scan."""
    data = collapsed(text)
    found = (crc32(m[0]) for p in patterns for m in p.finditer(data, overlapped=True))
    return np.fromiter(found, np.uint32) % np.uint32(buckets)


def featured(texts: DataFrame, keep: tuple[str, ...] = (), least: int = LEAST_N, most: int = MOST_N, buckets: int = BUCKETS) -> DataFrame:
    """The kept columns, n_words, n_features and features (bucket numbers as bytes, 4 each) of every text."""

    def work(batches):
        patterns = [spans(n) for n in range(least, most + 1)]
        for kept, found in text_slices(batches, tuple(keep)):
            rows = [bucket_numbers(t, patterns, buckets) for t in found]
            n_words = [len(collapsed(t).split()) if least > 1 or most > 1 else len(r) for t, r in zip(found, rows, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n_words, pa.int64()), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())],
                [*keep, "n_words", "n_features", "features"],
            )

    plain = texts.select(*keep, "text")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1])
    return plain.mapInArrow(work, f"{kinds}n_words long, n_features long, features binary")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket. Each task sends one sum for each of its buckets."""

    def work(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column("features"):
                sums += np.bincount(np.frombuffer(x.as_buffer(), np.uint32), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("features").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    buckets = len(corpus)
    s_all, t_all = float(corpus.sum()) + buckets, float(target.sum()) + buckets
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """All columns but features, and weight: the sum of the gains of the row's features."""
    names = [c for c in rows.columns if c != "features"]

    def work(batches):
        for batch in batches:
            weight = [int(gain[np.frombuffer(x.as_buffer(), np.uint32)].sum()) for x in batch.column("features")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(weight, pa.int64())], [*names, "weight"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    return rows.select(*names, "features").mapInArrow(work, f"{kinds}, weight long")


def noise(seed: str = SEED):
    """Gumbel noise in thousandths from the first 32 bits of SHA-256 of seed and id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(
    docs: DataFrame, target: DataFrame, least: int = LEAST_N, most: int = MOST_N, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED
) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight, score, rank (null: not drawn) of every document."""
    plain = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = written(featured(plain, ("doc_id", "text_hash"), least, most, buckets))
    gain = gains(bucket_counts(rows, buckets), bucket_counts(featured(target, (), least, most, buckets), buckets))
    scored = weighed(rows, gain).withColumn("score", F.col("weight") + noise(seed))
    entries = written(counted(scored))
    fits = F.col("n_words") >= least_words
    draw = percent * (entries.filter(fits).agg(F.sum("copies")).first()[0] or 0) // 100
    order = [F.when(fits, 0).otherwise(1).asc(), F.desc("score"), F.col("doc_id").asc_nulls_last(), *[F.col(c).asc() for c in ("text_hash", "n_words", "n_features", "weight", TASK)]]
    placed = expanded(running(entries, order, F.col("copies")))
    rank = F.col("before") + F.col("copy") + 1
    return placed.select("doc_id", "text_hash", "n_words", "n_features", "weight", "score", F.when(fits & (rank <= draw), rank).alias("rank"))


def drawn(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents themselves that a written result of ``resampled`` draws, with their rank.

    Equal rows stand for each other: as many as were drawn are returned.
    """
    p = plan.filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), "rank")
    own = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("_hash")).dropDuplicates(["doc_id", "_hash"])
    return own.join(p, (F.col("_hash") == F.col("p_hash")) & F.col("doc_id").eqNullSafe(F.col("p_id"))).select("row.*", F.col("rank").alias("draw_rank"))


def _crc(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in DuckDB."""
    data = f"list_transform(range(1, octet_length(encode({text}))+1), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2*i-1 AS BIGINT), 2) AS BIGINT))"
    step = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(acc, b))"
    return f"xor(list_reduce({data}, lambda acc, b: {step}, 4294967295), 4294967295)"


#: The same draw in SQL. CRC-32 is worked out bit by bit, for every different word once.
ORACLE = rf"""
WITH words AS (
 SELECT doc_id, unnest(regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
goal AS (
 SELECT unnest(regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
vocabulary AS MATERIALIZED (SELECT w, {_crc("w")} % {BUCKETS} AS b FROM (SELECT w FROM words UNION SELECT w FROM goal) AS u),
have AS (SELECT b, count(*) AS s FROM words JOIN vocabulary USING (w) GROUP BY b),
want AS (SELECT b, count(*) AS t FROM goal JOIN vocabulary USING (w) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000*ln((coalesce(t,0)+1)::DOUBLE*(SELECT sum(s)+{BUCKETS} FROM have)::DOUBLE/((coalesce(s,0)+1)::DOUBLE*(SELECT coalesce(sum(t),0)+{BUCKETS} FROM want)::DOUBLE))) AS BIGINT) AS g FROM have FULL JOIN want USING (b)),
sums AS (SELECT doc_id, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight FROM words JOIN vocabulary USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n_features,0) AS n_features, coalesce(weight,0) AS weight,
 coalesce(weight,0)+CAST(floor(-1000*ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || CAST(d.doc_id AS VARCHAR)),1,8) AS BIGINT)+0.5::DOUBLE)/4294967296::DOUBLE))) AS BIGINT) AS score
 FROM documents d LEFT JOIN sums USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT}*(SELECT count(*) FROM ranked)//100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
