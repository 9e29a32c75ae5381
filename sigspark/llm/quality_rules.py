"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for a document; the ledger keeps its measurements and one long
with a failure bit per rule. A policy is a version and a mask of the rules that reject, so a
verdict is one bitwise and, and an ablation counts bits over the ledger without a text.

Words are runs of characters other than ASCII white space. Defined cases: a null text has no
word and counts as empty; an empty text fails the least number of words; a null doc_id is
passed on; repeated rows give repeated rows; extra columns are ignored. Repeated five-word
windows are told apart by the 64-bit hash of their words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import barrier

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: The rules, in the order of their bits. A rule says what fails, over the measurements.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
    "symbols": "10 * n_symbols > 5 * n_words",
    "repeated_lines": "10 * n_dup_lines > 5 * n_lines",
    "no_sentence": "n_words >= 40 and n_stops = 0",
    "shouting": "n_letters >= 40 and 10 * n_upper > 6 * n_letters",
}
BIT = {name: i for i, name in enumerate(RULES)}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A version of what rejects: a document goes if any of the named rules failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[r] for r in self.rules)


POLICIES = (Policy("v1", BASE), Policy("v2", (*BASE, "symbols", "repeated_lines")), Policy("v3", (*BASE, "word_length", "symbols", "repeated_lines", "shouting")))
CURRENT = POLICIES[-1]


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every row; one scan, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(without(line, SPACES)) > 0)
    df = barrier(df, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"), lines.alias("lines"))
    hashes = F.when(
        F.size("words") > WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.struct(F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]).alias("h"), i.alias("i"))),
    )
    df = barrier(df, F.array_sort(hashes).alias("windows"))
    # In hash order a window is repeated if a neighbour has its hash; back in text order, each
    # repeated window covers the words up to the next one, five at most.
    before = lambda i: F.coalesce(F.get("windows", i - 1)["h"] == F.get("windows", i)["h"], F.lit(False))
    again = F.filter(F.sequence(F.lit(0), F.size("windows") - 1), lambda i: before(i) | before(i + 1))
    starts = F.array_sort(F.transform(again, lambda i: F.get("windows", i)["i"]))
    df = barrier(df, F.when(F.size("windows") > 1, starts).alias("starts"))
    steps = F.zip_with("starts", F.slice("starts", F.lit(2), F.greatest(F.size("starts"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    return df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - F.length(without(F.col("text"), ".!?"))).cast("long").alias("n_stops"),
        letters.cast("long").alias("n_letters"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failed``, a long with bit i set if rule i failed."""
    bits = [F.expr(f"case when {rule} then {1 << BIT[name]}L else 0L end") for name, rule in RULES.items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return barrier(measured(docs), failed.alias("failed"))


def verdict(policy: Policy) -> Column:
    """True if none of the policy's rules failed."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """version, rule, n_failed, n_only, n_rejected: per policy and rule, the documents that fail
    it, those that only it rejects, and those the policy rejects. Partial counts by failure
    mask come first: at most two to the number of rules rows are shuffled."""
    masks = book.groupBy("failed").agg(F.count("*").alias("n"))
    table = F.explode(F.array(*[F.struct(F.lit(p.version).alias("version"), F.lit(p.mask).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit")) for p in policies for r in p.rules])).alias("p")
    hit = F.col("failed").bitwiseAND(F.col("p.mask"))
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return (
        masks.select("failed", "n", table)
        .groupBy("p.version", "p.rule")
        .agg(count(hit.bitwiseAND(F.col("p.bit")) != 0).alias("n_failed"), count(hit == F.col("p.bit")).alias("n_only"), count(hit != 0).alias("n_rejected"))
    )


#: The contract's columns in DuckDB: the same rules written once more.
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS lines FROM t),
g AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) > 5)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(length(regexp_replace(text, '[^.!?]', '', 'g')) AS BIGINT) AS n_stops, CAST(length(regexp_replace(text, '\P{L}+', '', 'g')) AS BIGINT) AS n_letters,
             CAST(length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS BIGINT) AS n_upper FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)) OR 10 * n_symbols > 5 * n_words
            OR 10 * n_dup_lines > 5 * n_lines OR (n_letters >= 40 AND 10 * n_upper > 6 * n_letters)) AS kept,
       CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
            + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 4 ELSE 0 END
            + CASE WHEN 10 * n_symbols > 5 * n_words THEN 8 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 16 ELSE 0 END
            + CASE WHEN n_words >= 40 AND n_stops = 0 THEN 32 ELSE 0 END + CASE WHEN n_letters >= 40 AND 10 * n_upper > 6 * n_letters THEN 64 ELSE 0 END AS BIGINT) AS failed
FROM b
"""
