"""Language identification with averaged hashed subword embeddings.

A text is the average of the embeddings of its subwords (the 2-, 3- and
4-grams of each lower-cased word between end marks, hashed into ``BUCKETS``),
followed by a linear softmax; both layers are trained together by stochastic
gradient descent in numpy. The network is linear, so for prediction a bucket
is one row of class scores, and each distinct word of an Arrow batch is scored
once. Scores are probabilities after temperature scaling on calibration
documents that training never saw; the rejection threshold is the score that
all but ``REJECT`` of the calibration examples exceed, short excerpts included.

Training takes a bounded sample: about ``PER_LANG`` documents of each language,
by a hash of doc_id and text, of at most ``MAX_CHARS`` characters each (whole texts);
a language of which every text is longer is not learned.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and
rejected; a null doc_id is not held out; with no labelled document everything
is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import prepare, table

BUCKETS, DIM, EPOCHS, RATE, PER_LANG, MAX_CHARS, REJECT, SEED = 1 << 15, 12, 3, 0.5, 700, 20_000, 0.001, 5
UNKNOWN = "und"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the words, and each word's bounds in them (len(words) + 1)."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    codes = np.frombuffer(("\x01" + "\x02\x01".join(words) + "\x02").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    padded = np.concatenate((codes, np.zeros(3, np.uint64)))
    n = len(codes)
    ends = np.flatnonzero(codes == 2)
    stop = np.repeat(ends, np.diff(np.concatenate(([-1], ends))))  # each code's word end
    at = np.arange(n)
    found, hashed = np.zeros((3, n), bool), np.zeros((3, n), np.int64)
    h = codes
    for k in range(1, 4):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (padded[k : k + n] * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(29)
        found[k - 1] = at + k <= stop
        hashed[k - 1] = (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - 15)).astype(np.int64) % BUCKETS
    keep = found.T.ravel()
    counts = found.sum(0)
    bounds = np.concatenate(([0], np.cumsum(counts)[ends]))
    return hashed.T.ravel()[keep], bounds


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # class scores of each bucket
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, words: list[str], of: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of texts that hold the words numbered ``of``, text i those from bounds[i] to bounds[i + 1]."""
        score, count = np.zeros((len(words), len(self.langs))), np.zeros(len(words), np.int64)
        for at in range(0, len(words), 5000):
            buckets, ends = subwords(words[at : at + 5000])
            total = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(self.table[buckets], axis=0, dtype=np.float64)))
            score[at : at + 5000], count[at : at + 5000] = total[ends[1:]] - total[ends[:-1]], np.diff(ends)
        texts = len(bounds) - 1
        owner = np.repeat(np.arange(texts), np.diff(bounds))
        n = np.bincount(owner, count[of], texts)
        sums = np.stack([np.bincount(owner, score[of, k], texts) for k in range(len(self.langs))], axis=1)
        return sums / np.maximum(n, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    buckets, _ = subwords(text.lower().split())
    ids, n = np.unique(buckets, return_counts=True)
    return ids, n / max(1, n.sum())


def _excerpt(text: str, rng: np.random.Generator) -> str:
    words = text.split()
    n = int(rng.integers(3, 21))
    at = int(rng.integers(0, max(1, len(words) - n + 1)))
    return " ".join(words[at : at + n])


def train(rows: list[tuple[str, str]], epochs: int = EPOCHS, rate: float = RATE, reject: float = REJECT, seed: int = SEED) -> Model | None:
    """Fit on (text, lang) rows; every fifth is kept for calibration."""
    rows = [(t, g) for t, g in rows if t and any(c.isalpha() for c in t)]
    langs = sorted({g for _, g in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    cal = rows[::5] if len(rows) >= 50 else rows
    fit = [r for k, r in enumerate(rows) if k % 5] if len(rows) >= 50 else rows
    examples = [(_bag(x), langs.index(g)) for t, g in fit for x in (t, _excerpt(t, rng))]
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM))
    weights, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    weights += rng.normal(0, 0.3, weights.shape)
    steps, step = epochs * len(examples), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            (ids, w), g = examples[k]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = w @ embedding[ids]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[g] -= 1
            back = weights @ p
            weights -= lr * np.outer(hidden, p)
            bias -= lr * 0.1 * p
            # A subword's share of the average is small; embeddings take the larger step that adds up to the usual one.
            embedding[ids] -= lr * min(len(ids), 50) * w[:, None] * back[None, :]
    model = Model(langs, (embedding @ weights).astype(np.float32), bias)
    tests = [(x, langs.index(g)) for t, g in cal for x in (t, _excerpt(t, rng))]
    logits = np.stack([w @ model.table[ids] + bias for (ids, w), _ in ((_bag(x), g) for x, g in tests)])
    gold = np.array([g for _, g in tests])
    loss = lambda t: -np.log(np.maximum(model_probability(logits, t)[np.arange(len(gold)), gold], 1e-12)).mean()
    model.temperature = min((float(t) for t in np.geomspace(0.2, 5, 41)), key=loss)
    top = np.sort(model.probabilities(logits).max(axis=1))
    model.threshold = float(top[int(reject * (len(top) + 1)) - 1]) if reject * (len(top) + 1) >= 1 else float(top[0]) * 0.999
    return model


def model_probability(logits: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp((logits - logits.max(axis=1, keepdims=True)) / temperature)
    return e / e.sum(axis=1, keepdims=True)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, per_lang: int = PER_LANG, max_chars: int = MAX_CHARS) -> Model | None:
    """Train on a bounded sample of documents outside the held-out fold."""
    usable = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    # One count for each language comes to the driver.
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    wanted = None
    for lang, n in sorted(counts.items()):
        share = min(1.0, per_lang / n)
        one = (F.col("lang") == lang) & (place < int(share * (1 << 30)))
        wanted = one if wanted is None else wanted | one
    rows = usable.where(wanted).orderBy(place, "doc_id", "text").limit(2 * per_lang * len(counts)).toPandas()
    rows = rows.sort_values(["doc_id", "text"], kind="stable")
    return train(list(zip(rows["text"], rows["lang"], strict=True)))


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            best, score = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            if model is not None and b.num_rows:
                split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
                bounds = split.offsets.to_numpy()
                coded = split.flatten().dictionary_encode()
                p = model.probabilities(model.logits(coded.dictionary.to_pylist(), coded.indices.to_numpy(), bounds - bounds[0]))
                best, score = p.argmax(axis=1), p.max(axis=1)
            known = lettered & (model is not None)
            score = np.where(known, np.clip(score, 0, 1), 0.0)
            names = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
            rejected = ~known | (score < (model.threshold if model else 1))
            kept = [b.column(k) for k in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], [*b.schema.names, "__lang_pred", "__score", "__rejected"])

    return run


def identify(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """doc_id, text if kept, ... with __lang_pred, __score, __rejected; ``keep`` names further columns to carry."""
    prepare(docs.sparkSession)
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    rows = docs.select("doc_id", "text", *keep)
    schema = StructType(list(rows.schema.fields)).add("__lang_pred", StringType()).add("__score", DoubleType()).add("__rejected", BooleanType())
    return rows.mapInArrow(_predict(model), schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract of query 6."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))
