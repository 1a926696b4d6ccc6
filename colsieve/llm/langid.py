"""Language identification by hierarchical discrimination.

A first stage tells the language family; within it, one-versus-one linear support vector machines
separate the related languages, whose votes (then margins) decide. All machines are linear in the relative
frequencies of hashed character n-grams of the whole text, so scoring is one weighted mean over its n-grams.

Families come from a fixed table of ISO 639 codes; a code that it doesn't hold is its own family. Machines
are fitted on the driver from at most SAMPLE_PER_LANGUAGE texts of each language (hashed features only), fewer where
there are so many languages that all would be more than MAX_TEXTS. Every labelled language is learned. Texts are
drawn by a hash from all labelled rows that aren't held out. Labels are read for fitting alone. Texts that are null
or hold no letter are `und` with score 0; without any labelled row every text is `und`.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsieve.llm.common import map_batches, prepare, utf8

#: Families of common languages.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "mk", "bg"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "bn", "mr", "ne", "ur", "pa", "gu"],
    "semitic": ["ar", "he", "mt"],
}
BUCKETS = 1 << 12
#: Most texts that a fit reads, of all languages and of each.
MAX_TEXTS = 12_000
SAMPLE_PER_LANGUAGE = 500
_LETTER = re.compile(r"[^\W\d_]")
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LOW[[9, 10, 11, 12, 13]] = 32
_CHUNK = 1 << 20


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


def gram_buckets(raw: bytes) -> list[np.ndarray]:
    """Buckets of all 1-, 2- and 3-byte grams of some bytes; ASCII case is folded."""
    data = _LOW[np.frombuffer(raw, np.uint8)].astype(np.uint32)
    one = data * np.uint32(2654435761)
    two = (one[:-1] ^ (data[1:] + np.uint32(1)) * np.uint32(2246822519)) * np.uint32(3266489917)
    three = (two[:-1] ^ (data[2:] + np.uint32(7)) * np.uint32(668265263)) * np.uint32(374761393)
    return [(g >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32) for g in (one, two, three)]


def frequencies(raw: bytes, chunk: int = _CHUNK) -> np.ndarray:
    """Relative frequencies of the grams of a whole text between two spaces. Long texts go in slices, which overlap by the grams that cross their ends."""
    counts = np.zeros(BUCKETS, np.int64)
    padded = b" " + raw + b" "
    for at in range(0, len(padded), chunk):
        for width, buckets in enumerate(gram_buckets(padded[max(0, at - 2) : at + chunk]), 1):
            counts += np.bincount(buckets[max(0, min(at, 2) - width + 1) :], minlength=BUCKETS)  # a gram counts in the slice that it ends in
    return counts / max(1, counts.sum())


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, c: float = 30.0) -> np.ndarray:
    """A linear machine with squared hinge loss by accelerated gradient; the last weight is the bias. y: -1 or 1."""
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) * c / len(y)
    full = np.hstack([x, np.full((len(x), 1), 0.1)]).astype(np.float32)
    weight, y = weight.astype(np.float32), y.astype(np.float32)
    bound = 1 + 2 * float(np.linalg.norm(np.sqrt(weight)[:, None] * full, ord="fro") ** 2)
    w = v = np.zeros(full.shape[1], np.float32)
    k = 1.0
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * (full @ v))
        new = v - (v - 2 * full.T @ (weight * y * gap)) / np.float32(bound)
        following = (1 + np.sqrt(1 + 4 * k * k)) / 2
        v, w, k = new + np.float32((k - 1) / following) * (new - w), new, following
    return np.append(w[:-1], 0.1 * w[-1]).astype(np.float64)


@dataclass
class LanguageModel:
    families: dict[str, list[str]]
    scale: np.ndarray
    family: dict[str, np.ndarray] = field(default_factory=dict)  # one against the rest, or one for two families
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, raw: bytes | None) -> tuple[str, float]:
        if not raw or not self.families or not _LETTER.search(raw.decode()):
            return "und", 0.0
        x = np.sqrt(frequencies(raw)) * self.scale
        margin = lambda w: float(x @ w[:-1] + w[-1])
        names = sorted(self.families)
        sure = 1.0
        if len(names) == 1:
            chosen = names[0]
        else:
            margins = {f: margin(w) for f, w in self.family.items()}
            if len(names) == 2:
                margins[names[1]] = -margins[names[0]]
            chosen = max(names, key=lambda f: (margins[f], f))
            sure = _sigmoid(2 * margins[chosen])
        langs = self.families[chosen]
        if len(langs) == 1:
            return langs[0], sure
        votes, total = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for (a, b), w in self.pairs.items():
            if a in votes and b in votes:
                m = margin(w)
                votes[a if m >= 0 else b] += 1
                total[a] += m
                total[b] -= m
        best = max(langs, key=lambda c: (votes[c], total[c], c))
        return best, sure * _sigmoid(2 * total[best] / (len(langs) - 1))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(40, max(-40, x)))))


def fit(x: np.ndarray, langs: list[str]) -> LanguageModel:
    """x: square roots of gram frequencies, one row for each text."""
    families: dict[str, list[str]] = {}
    for code in sorted(set(langs)):
        families.setdefault(family_of(code), []).append(code)
    scale = np.ones(BUCKETS)
    if not len(x):
        return LanguageModel({}, scale)
    of = np.array([family_of(c) for c in langs])
    code = np.array(langs)
    model = LanguageModel(families, scale)
    names = sorted(families)
    for f in names[:1] if len(names) == 2 else names if len(names) > 2 else []:
        model.family[f] = fit_svm(x, np.where(of == f, 1.0, -1.0))
    for members in families.values():
        for a, b in itertools.combinations(members, 2):
            pick = (code == a) | (code == b)
            model.pairs[a, b] = fit_svm(x[pick], np.where(code[pick] == a, 1.0, -1.0))
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on labelled rows that aren't held out; their number is bounded by per_language for each language and MAX_TEXTS for all."""
    prepare(docs.sparkSession)
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    counts = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("rows")).limit(MAX_TEXTS + 1).collect()
    if len(counts) > MAX_TEXTS:
        raise ValueError(f"more than {MAX_TEXTS} languages")
    per_language = min(per_language, MAX_TEXTS // max(1, len(counts)))
    counts = docs.sparkSession.createDataFrame(counts, "lang string, rows bigint")
    # A hash thins each language to about per_language rows before any are ranked, so no large group is sorted.
    drawn = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("__text"), F.xxhash64(id_col, F.lit("lang")).alias("h")).join(F.broadcast(counts), "lang")
    drawn = drawn.filter(F.pmod("h", F.lit(1 << 20)) * F.col("rows") < F.lit(max(100, 2 * per_language)) * (1 << 20))
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= per_language).select("lang", "h", "__text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [np.sqrt(frequencies(raw)).astype(np.float32).tobytes() for raw in utf8(batch, "__text")]
        return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(x, pa.binary())], ["lang", "h", "x"])

    rows = sorted(map_batches(ranked, run, "lang string, h bigint, x binary").collect(), key=lambda r: (r["lang"], r["h"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], dtype=np.float32).reshape(len(rows), BUCKETS)
    langs = [r["lang"] for r in rows]
    del rows
    return fit(x, langs)


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, lang_pred, score. A narrow pass over whole texts."""
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # one weight vector of BUCKETS for each pair of related languages and each family

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                found = [own.predict(raw) for raw in utf8(batch, "__text")]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array([p for p, _ in found]), pa.array([s for _, s in found], pa.float64())], ["id", "held_out", "lang_pred", "score"])

    id_type = df.schema[id_col].dataType.simpleString()
    made = df.select(F.col(id_col).alias("id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"id {id_type}, held_out boolean, lang_pred string, score double")
    return made.withColumnRenamed("id", id_col)
