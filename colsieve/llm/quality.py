"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are ordered grades (here 0 junk, 1 toxic, 2 clean). One shared weight vector over hashed
text features gives a text its score; ordered thresholds cut the score into grades:
P(grade > j) = sigmoid(score - threshold_j). From these follow the expected grade and the tail probability
of the top grade, by which texts are selected.

The model is fitted on the driver from at most SAMPLE_ROWS rated texts (features only, drawn by a
hash of the id from all rated rows); every text of the corpus is scored whole in a narrow pass. Null and empty
texts have no features and get the bias alone. Without any rated text the model is neutral and keeps all.
"""

from __future__ import annotations

import re
import tempfile
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsieve.llm.bpe import _Memo
from colsieve.llm.common import Carried, held_over, map_arrow, map_batches, prepare, quoted, utf8
from colsieve.session import materialize

BUCKETS = 1 << 21
#: Most rated texts that a fit reads.
SAMPLE_ROWS = 12_000
#: Features that a fit holds in memory at a time; the rest of the sample stays in a file of the driver.
CHUNK_FEATURES = 1 << 21
#: Bytes of features of a partition of the sample (or a single longer row), which reach the driver at a time.
PART_BYTES = 16 << 20
#: A text is kept if its probability of the top grade is at least this.
KEEP_TAIL = 0.45

_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS = re.compile(r"[^\w\s.,;:'\"()-]+")


def word_features(word: bytes) -> tuple[int, ...]:
    """Buckets of one raw word: its letters folded, their first four and five (stems), and its unusual signs."""
    text = word.decode()
    out = []
    for w in _LETTERS.findall(text.lower()):
        out.append(xxhash.xxh3_64_intdigest(b"w" + w.encode()) % BUCKETS)
        out += [xxhash.xxh3_64_intdigest(b"s" + w[:k].encode()) % BUCKETS for k in (4, 5) if len(w) > k]
    for s in _SIGNS.findall(text):
        out.append(xxhash.xxh3_64_intdigest(b"x" + s[:3].encode()) % BUCKETS)
    if len(text) > 2 and text.isupper():
        out.append(xxhash.xxh3_64_intdigest(b"caps") % BUCKETS)
    return tuple(out)


def features(raw: bytes | None) -> np.ndarray:
    """Distinct buckets of a whole text: the presence of each of its word features, and its repetition in steps."""
    words = raw.split() if raw else []
    kinds = set(words)
    found: set[int] = set()
    found.update(*map(held_over("word features", lambda: _Memo(word_features)).__getitem__, kinds))
    if len(words) >= 20:
        step = int(10 * len(kinds) / len(words))
        if step < 5:
            found.update(xxhash.xxh3_64_intdigest(b"repeat%d" % k) % BUCKETS for k in range(step, 5))
    return np.fromiter(found, np.int32, len(found))


@dataclass
class OrdinalModel:
    weights: np.ndarray  # one for each bucket
    thresholds: np.ndarray  # ascending

    def score(self, buckets: np.ndarray) -> float:
        return float(self.weights[buckets].sum())

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j, one row for each score."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(score)[:, None] - self.thresholds, -40, 40)))


class FeatureRows:
    """The buckets of rows one after another, in an unnamed file: a fit reads them in chunks, so its memory doesn't follow the texts' lengths."""

    def __init__(self, rows: Iterable[np.ndarray] = ()):
        self._file, self.lengths = tempfile.TemporaryFile(), array("q")  # noqa: SIM115
        for row in rows:
            self.add(row)

    def __len__(self) -> int:
        return len(self.lengths)

    def add(self, *rows: np.ndarray) -> None:
        for row in rows:
            self._file.write(np.ascontiguousarray(row, np.int32).data)
            self.lengths.append(len(row))

    def chunks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, the rows' lengths, their buckets): whole rows of about CHUNK_FEATURES buckets."""
        self._file.flush()
        ends = np.cumsum(np.frombuffer(self.lengths, np.int64)) if self.lengths else np.zeros(0, np.int64)
        at, done = 0, 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, done + CHUNK_FEATURES, "right")))
            lengths = np.diff(ends[at:stop], prepend=done)
            self._file.seek(4 * done)
            yield at, lengths, np.frombuffer(self._file.read(4 * int(lengths.sum())), np.int32)
            at, done = stop, int(ends[stop - 1])
        self._file.seek(0, 2)

    def columns(self, column: np.ndarray) -> FeatureRows:
        """The rows with each bucket's column, without those whose column is negative."""
        out = FeatureRows()
        for _, lengths, buckets in self.chunks():
            col = column[buckets]
            ends = np.concatenate([[0], np.cumsum(col >= 0)])[np.concatenate([[0], np.cumsum(lengths)])]
            out._file.write(col[col >= 0].astype(np.int32).data)
            out.lengths.extend(np.diff(ends).tolist())
        return out


def fit_ordinal(rows: Iterable[np.ndarray], grades: np.ndarray, n_grades: int, buckets: int = BUCKETS, rounds: int = 300, l1: float = 1e-3, l2: float = 1e-6, least_rows: int = 8) -> OrdinalModel:
    """Accelerated proximal gradient on the cumulative-link likelihood; features in fewer than least_rows rows are left out."""
    held = rows if isinstance(rows, FeatureRows) else FeatureRows(rows)
    if not len(held):
        return OrdinalModel(np.zeros(buckets), np.arange(n_grades - 1) - 50.0)
    count = np.zeros(buckets, np.int64)
    for _, _, found in held.chunks():
        count += np.bincount(found, minlength=buckets)
    used = np.flatnonzero(count >= least_rows)
    column = np.full(buckets, -1, np.int32)
    column[used] = np.arange(len(used))
    held = held.columns(column)
    del count, column
    n, above = len(held), grades[:, None] > np.arange(n_grades - 1)
    weight = n / (n_grades * np.maximum(np.bincount(grades, minlength=n_grades), 1))
    weight = np.minimum(weight, 5)[grades]

    def by_column(value: Callable[[slice, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Sums by column of a value of each row, which may depend on the chunk's rows, owners and columns."""
        total = np.zeros(len(used))
        for at, lengths, col in held.chunks():
            owner = np.repeat(np.arange(len(lengths)), lengths)
            total += np.bincount(col, value(slice(at, at + len(lengths)), owner, col)[owner], minlength=len(used))
        return total

    def gradient(w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        thresholds = np.zeros(n_grades - 1)

        def error(rows: slice, owner: np.ndarray, col: np.ndarray) -> np.ndarray:
            s = np.bincount(owner, w[col], minlength=rows.stop - rows.start)
            p = 1 / (1 + np.exp(-np.clip(s[:, None] - t, -40, 40)))
            e = (p - above[rows]) * weight[rows, None] / n
            thresholds[:] -= e.sum(0)
            return e.sum(1)

        return by_column(error) + l2 * w, thresholds

    w, t = np.zeros(len(used)), np.linspace(-2, -1, n_grades - 1)
    # A diagonal step: the curvature of a weight is bounded by its rows' lengths.
    length = np.frombuffer(held.lengths, np.int64)
    curvature = weight / n * (n_grades - 1) * np.sqrt(np.maximum(length, 1))
    step = 4.0 / np.maximum(by_column(lambda rows, owner, col: curvature[rows]), 1e-12) / 8
    v, u, k = w.copy(), t.copy(), 1.0
    for _ in range(rounds):
        g, gt = gradient(v, u)
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_t = np.maximum.accumulate(u - 0.5 * gt)
        following = (1 + np.sqrt(1 + 4 * k * k)) / 2
        if ((v - new) * (new - w)).sum() + ((u - new_t) * (new_t - t)).sum() > 0:  # restart
            k, following = 1.0, 1.0
        v, u = new + (k - 1) / following * (new - w), new_t + (k - 1) / following * (new_t - t)
        w, t, k = new, new_t, following
    full = np.zeros(buckets)
    full[used] = w
    return OrdinalModel(full, t)


def grades_of(labels: DataFrame) -> DataFrame:
    """(id, grade): 0 for low quality, 1 for toxic, 2 for the rest; rows without a rating are left out, the worst of several counts."""
    graded = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2).alias("grade"))
    return graded.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on a sample of rated texts of at most sample_rows rows; only their features reach the driver."""
    prepare(docs.sparkSession)
    rated = ratings.count()
    parts = 1 << 20
    cut = parts if rated <= 0.9 * sample_rows else int(0.9 * sample_rows / rated * parts)
    drawn = ratings.filter(F.pmod(F.xxhash64(id_col, F.lit("rated")), F.lit(parts)) < cut)
    # drawn has about 0.9 * sample_rows rows of (id, grade), however many are rated
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("__text")).join(F.broadcast(drawn), id_col).select(F.col(id_col).alias("id"), F.col("grade").cast("int").alias("grade"), "__text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), pa.array([np.sort(features(raw)).tobytes() for raw in utf8(batch, "__text")], pa.binary())], ["id", "grade", "buckets"])

    id_type = docs.schema[id_col].dataType.simpleString()
    # Texts may be long: their features are written, then reach the driver a partition at a time and its file from there. A sort by
    # range sends keys of its own to the driver, nearly all of so few rows; so they are ordered by a hash of the features.
    sample = materialize(map_batches(rows, run, f"id {id_type}, grade int, buckets binary").limit(sample_rows), "rated")
    parts = 1 + (sample.agg(F.sum(F.length("buckets"))).first()[0] or 0) // PART_BYTES
    order = ["id", F.xxhash64("buckets")]
    held, grades = FeatureRows(), array("q")
    for r in sample.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("grade", "buckets").toLocalIterator():
        held.add(np.frombuffer(r["buckets"], np.int32))
        grades.append(r["grade"])
    return fit_ordinal(held, np.array(grades, int), n_grades)


def _scored(rows: DataFrame, names: list[str], schema: str, model: OrdinalModel) -> DataFrame:
    """rows with __text: the named columns, score, expected_grade, tail_prob. A narrow pass."""
    used = np.flatnonzero(model.weights)
    shared = rows.sparkSession.sparkContext.broadcast((used, model.weights[used], model.thresholds))  # at most BUCKETS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, values, thresholds = shared.value
        weights = np.zeros(BUCKETS)
        weights[buckets] = values
        own = OrdinalModel(weights, thresholds)
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.array([own.score(features(raw)) for raw in utf8(batch, "__text")])
            tails = own.tails(s)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(s), pa.array(tails.sum(1)), pa.array(tails[:, -1])], [*names, "score", "expected_grade", "tail_prob"])

    return map_arrow(rows, run, f"{schema}, score double, expected_grade double, tail_prob double")


def score(df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep_tail: float = KEEP_TAIL) -> DataFrame:
    """Per row: id, score, expected_grade, tail_prob, kept."""
    prepare(df.sparkSession)
    rows = df.select(quoted(id_col).alias("__id"), quoted(text_col).cast("string").alias("__text"))
    made = _scored(rows, ["__id"], f"__id {df.schema[id_col].dataType.simpleString()}", model)
    return made.withColumn("kept", F.col("tail_prob") >= keep_tail).withColumnRenamed("__id", id_col)


def accepted(df: DataFrame, model: OrdinalModel, text_col: str = "text", keep_tail: float = KEEP_TAIL) -> DataFrame:
    """The rows, with all their columns, whose tail probability is at least keep_tail."""
    prepare(df.sparkSession)
    carried = Carried(df, text_col)
    return carried.restore(_scored(carried.df, carried.names, carried.schema, model).filter(F.col("tail_prob") >= keep_tail))
