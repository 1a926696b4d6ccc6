"""Quality rules as a bitmask ledger.

Every rule is measured and evaluated once per text; the ledger keeps the measurements and one
failure bit per rule. A policy is a named, versioned mask of rules: applying one is a bitwise AND,
so changing policy never reads a text again, and ablations are bitwise aggregates of the ledger. stored_ledger
writes it, so that every policy, version and ablation reads the same narrow table.

Null and empty texts have no words and fail the base rules. Texts of any length are measured
whole; rows are judged one by one, so repeated rows get equal verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsieve.llm.common import Carried, map_batches, prepare, quoted, utf8
from colsieve.session import materialize

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts"]


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


#: Ratios are compared in whole numbers, so that every engine agrees.
RULES = [
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbol_ratio", "100 * n_symbols > 20 * n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "shouting", "100 * n_shouts > 20 * n_words"),
]


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[n] for n in self.rules)


BASE = Policy("base", 1, ("too_few_words", "repeated_words"))
BASE_2 = Policy("base", 2, (*BASE.rules, "duplicate_lines"))
FULL = Policy("full", 1, tuple(r.name for r in RULES))
POLICIES = {(p.name, p.version): p for p in (BASE, BASE_2, FULL)}


def policy(name: str, version: int | None = None) -> Policy:
    """The policy of that name and version, the newest one without a version."""
    known = [v for n, v in POLICIES if n == name]
    if not known or version not in (None, *known):
        raise ValueError(f"no such policy: {name!r}, version {version}")
    return POLICIES[name, version or max(known)]


def repeated_window_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of `width` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    key = ids[:n].copy()
    for k in range(1, width):
        if k > 1:  # ranks keep the key below the square of the text's length
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(known) + ids[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    repeated = np.zeros(n, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(repeated), 1)
    np.add.at(covered, np.flatnonzero(repeated) + width, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def measure(raw: bytes | None) -> tuple[int, ...]:
    """MEASURES of one UTF-8 text. Words and lines part at ASCII characters, so bytes serve as well as code points."""
    if not raw:
        return (0,) * len(MEASURES)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(raw.translate(None, SPACES + CONTINUATION)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
        len(lines),
        sum(w.endswith(b"!!") for w in words) if b"!!" in raw else 0,
    )


def failure_bits() -> Column:
    """The bits of all rules from the measurements."""
    bits = F.lit(0)
    for r in RULES:
        bits = bits + F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0))
    return bits.cast("bigint")


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, MEASURES, failed_bits. A narrow pass, no shuffle."""
    prepare(df.sparkSession)
    schema = ", ".join([f"__id {df.schema[id_col].dataType.simpleString()}", *(f"{m} bigint" for m in MEASURES)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(raw) for raw in utf8(batch, "__text")]
        return pa.RecordBatch.from_arrays([batch.column("__id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES)))], ["__id", *MEASURES])

    measured = map_batches(df.select(quoted(id_col).alias("__id"), quoted(text_col).cast("string").alias("__text")), run, schema)
    return measured.withColumn("failed_bits", failure_bits()).withColumnRenamed("__id", id_col)


def stored_ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger, written to the shared folder and read again: later plans don't touch a text."""
    return materialize(ledger(df, id_col, text_col), "ledger")


def passing(df: DataFrame, policy: Policy, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that pass the policy."""
    prepare(df.sparkSession)
    carried = Carried(df, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(raw) for raw in utf8(batch, "__text")]
        return pa.RecordBatch.from_arrays([*carried_columns(batch), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES)))], [*names, *MEASURES])

    names, carried_columns = carried.names, lambda batch: [batch.column(n) for n in names]
    measured = map_batches(carried.df, run, ", ".join([carried.schema, *(f"{m} bigint" for m in MEASURES)]))
    return carried.restore(measured.withColumn("failed_bits", failure_bits()).filter(~fails(policy)))


def verdicts(ledger_df: DataFrame, policies: list[Policy]) -> DataFrame:
    """The ledger with a boolean column <name>_v<version> for each policy: whether the row passes it."""
    return ledger_df.select("*", *((~fails(p)).alias(f"{p.name}_v{p.version}") for p in policies))


def fails(policy: Policy) -> Column:
    """Whether a ledger row fails the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) != 0


def ablation(ledger_df: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows that fail it alone, and rows kept without it.

    One pass of partial aggregates over the ledger; the result has one row per rule.
    """
    masked = F.col("failed_bits").bitwiseAND(F.lit(policy.mask))
    rules = [r for r in RULES if r.name in policy.rules]
    sums = [F.count(F.lit(1)).alias("rows"), F.sum((masked == 0).cast("bigint")).alias("kept")]
    for r in rules:
        sums += [F.sum((masked.bitwiseAND(F.lit(1 << r.bit)) != 0).cast("bigint")).alias(f"f{r.bit}"), F.sum((masked == (1 << r.bit)).cast("bigint")).alias(f"a{r.bit}")]
    stacked = ", ".join(f"'{r.name}', {r.bit}, f{r.bit}, a{r.bit}" for r in rules)
    return ledger_df.agg(*sums).select("rows", "kept", F.expr(f"stack({len(rules)}, {stacked}) AS (rule, bit, failing, failing_alone)")).select(
        "rule", "bit", "rows", F.coalesce("failing", F.lit(0)).alias("failing"), F.coalesce("failing_alone", F.lit(0)).alias("failing_alone"), (F.coalesce("kept", F.lit(0)) + F.coalesce("failing_alone", F.lit(0))).alias("kept_without")
    )
