"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once for each document. The ledger stores the
measurements and a bit for each failed rule; policies, which are versioned bit
masks, and ablations are then bitwise expressions over the ledger, so that a
new policy never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import frugal, parts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_adjacent", "n_exclaim",
]


@dataclass(frozen=True)
class Rule:
    """A rule fails where its SQL condition over the measurements holds."""

    bit: int
    name: str
    fails: str


#: Bits are permanent: a rule that changes gets a new bit.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 4 * word_chars"),
    Rule(3, "upper_case", "100 * n_upper > 40 * n_letters"),
    Rule(4, "duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(5, "stuttering", "100 * n_adjacent > 20 * n_words"),
    Rule(6, "exclamations", "100 * n_exclaim > 20 * n_words"),
)


def mask_of(*names: str) -> int:
    """The bit mask of the named rules."""
    by_name = {r.name: 1 << r.bit for r in RULES}
    return reduce(lambda a, n: a | by_name[n], names, 0)


#: Policies by version; a document is kept if it fails none of their rules.
POLICIES = {
    "base": mask_of("few_words", "repeated_windows"),
    "v1": mask_of(*(r.name for r in RULES)),
}


def _repeat_and_adjacent(words: list[str]) -> tuple[int, int]:
    """Words inside 3-word windows found twice or more; words equal to the word before."""
    if len(words) < 2:
        return 0, 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    adjacent = int(np.count_nonzero(ids[1:] == ids[:-1]))
    if len(words) < 4 or len(seen) == len(words):
        return 0, adjacent
    base = len(seen)
    codes = ids[:-1] * base + ids[1:]
    if base >= 1 << 21:  # keeps the next product inside 63 bits
        codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    codes = codes[:-1] * base + ids[2:]
    order = np.argsort(codes)
    same = codes[order[1:]] == codes[order[:-1]]
    twice = np.zeros(len(codes), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(codes)] |= twice
    return int(np.count_nonzero(covered)), adjacent


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES; null counts as empty."""
    text = text or ""
    words = WORD.findall(text)
    if not words:
        return (0,) * len(MEASURES)
    octets = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    spaces = int(octets[9:14].sum() + octets[32])
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeat, adjacent = _repeat_and_adjacent(words)
    return (
        len(words), len(text) - spaces, int(octets[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeat,
        len(lines), int(octets[65:91].sum()), int(octets[65:91].sum() + octets[97:123].sum()), adjacent, int(octets[33]),
    )


def _measure_batches(batches):
    for batch in parts(batches, 1):
        rows = [measure(t) for t in batch.column(1).to_pylist()]
        columns = np.array(rows, dtype=np.int64).reshape(len(rows), len(MEASURES)).T
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in columns)], names=["doc_id", *MEASURES])


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """The failed rules as a bit mask over the measurements."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, the measurements and ``failed`` (bits).

    Needs doc_id (whole number) and text; other columns are ignored, whatever
    their names. A null or empty text measures 0 throughout, so it fails
    few_words alone. Null ids and repeated rows stay as they are. An empty
    table gives an empty ledger. Whole texts are read; nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    return rows.mapInArrow(frugal(_measure_batches), schema).withColumn("failed", failure_bits(rules))


def passes(failed: Column, policy: str) -> Column:
    """True where none of the policy's rules failed."""
    return failed.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(ledger_rows: DataFrame, policy: str = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy without it keeps.

    One aggregate over the ledger by bitwise conditions; one row per rule.
    """
    mask = POLICIES[policy]
    failed = F.col("failed").bitwiseAND(F.lit(mask))
    active = [r for r in rules if mask >> r.bit & 1]
    sums = [F.count(F.lit(1)).alias("n_docs")]
    for r in active:
        bit = 1 << r.bit
        sums.append(F.coalesce(F.sum((failed.bitwiseAND(F.lit(bit)) != 0).cast("long")), F.lit(0)).alias(f"f{r.bit}"))
        sums.append(F.coalesce(F.sum((failed == bit).cast("long")), F.lit(0)).alias(f"o{r.bit}"))
        sums.append(F.coalesce(F.sum((failed.bitwiseAND(F.lit(mask & ~bit)) == 0).cast("long")), F.lit(0)).alias(f"k{r.bit}"))
    one = ledger_rows.agg(*sums)
    rows = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_only"), F.col(f"k{r.bit}").alias("n_kept_without")) for r in active))
    return one.select(F.lit(policy).alias("policy"), "n_docs", F.explode(rows).alias("r")).select("policy", "n_docs", "r.*")


def keep(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` whose document passes the policy, with all their columns.

    The ledger's bits are made beside the row in one pass, without a join, and
    the policy's mask is applied to them.
    """
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    measured = inner.withColumn("m", _measures_udf()(F.col("text"))).select("row", "m.*")
    return measured.withColumn("failed", failure_bits()).filter(passes(F.col("failed"), policy)).select("row.*")


def _measures_udf():
    import pandas as pd

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=MEASURES, dtype="int64")

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, ", ".join(f"{m} long" for m in MEASURES))
