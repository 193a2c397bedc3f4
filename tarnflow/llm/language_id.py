"""Language ID by error-correcting output codes over character n-grams.

Every learned language gets a codeword of +1/-1. Each bit is a binary classifier between the languages
at +1 and those at -1: log odds of hashed letter bigrams and trigrams, averaged over a whole text.
The n-gram counts come from all training rows, folded per task and summed by Spark; the driver gets
(languages x buckets) sums, whatever the size of the corpus. Decoding adds, over the bits, the logistic
loss of the classifier's margin against each codeword, weighted by how well the bit separates, and takes
the least; a close second makes the row ambiguous.

Up to five languages have exhaustive codes of 2**(L-1)-1 bits; more have the random code with the largest
least distance among 200 draws of a fixed seed.

Defined cases: null or letterless text gives `und`, score 0, not ambiguous; with no training rows every
row is `und`; null lang and null doc_id rows don't train (a null doc_id isn't held out); rows that repeat
count each time; a text is read whole however long it is, in pieces of CHUNK letters; of languages that tie the
first by name wins; an empty table gives no rows; more than MOST_LANGS distinct values of lang are refused.
lang, source and doc_id are no inputs of a prediction. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import tidy

#: Buckets of each order of n-gram; orders; letters of a text handled at once.
BUCKETS, ORDERS, CHUNK = 1 << 14, (2, 3), 1 << 20
SMOOTH = 0.5
#: Languages that a model may have: each costs the driver and every worker 262 KB of sums and log odds a bit.
MOST_LANGS = 256
#: Slope of the margin in the loss, and the least lead over the second codeword.
SLOPE, LEAD = 8.0, 0.02
_MIX = np.uint32(0x9E3779B1)


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (0 for a gap between words) of all texts and the text of each."""
    lower = [" " + t.lower() + " " for t in texts]
    c = np.frombuffer("".join(lower).encode("utf-32-le", "replace"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in lower])
    c = np.where(_letters()[c], c, np.uint32(0))
    keep = np.r_[True, (c[1:] != 0) | (c[:-1] != 0) | (doc[1:] != doc[:-1])] if len(c) else np.zeros(0, bool)
    return c[keep], doc[keep]


def _features(c: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams and the text of each."""
    with np.errstate(over="ignore"):
        for k, n in enumerate(ORDERS):
            if len(c) < n:
                continue
            h = np.zeros(len(c) - n + 1, np.uint32)
            for i in range(n):
                h = (h ^ c[i : i + len(h)]) * _MIX
                h ^= h >> np.uint32(15)
            ok = doc[n - 1 :] == doc[: len(h)]
            yield (h[ok] >> np.uint32(3)) % np.uint32(BUCKETS) + np.uint32(k * BUCKETS), doc[: len(h)][ok]


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of texts of about CHUNK letters; a longer text comes in overlapping pieces of its own."""
    which, some, size = [], [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t or "")), CHUNK):
            part = (t or "")[max(0, s - 1) : s + CHUNK]
            which.append(i)
            some.append(part)
            size += len(part)
            if size >= CHUNK:
                yield which, some
                which, some, size = [], [], 0
    if some:
        yield which, some


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            total = sums.setdefault(lang, np.zeros(BUCKETS * len(ORDERS), np.int64))
            for _, some in _pieces(texts):
                for bucket, _ in _features(*_codes_of(some)):
                    total += np.bincount(bucket, minlength=len(total))
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])


def code_matrix(n: int) -> np.ndarray:
    """One codeword of +1/-1 a row."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = 2 ** (n - 1) - 1
        return np.array([[1.0] * bits] + [[1.0 if b >> r & 1 else -1.0 for b in range(bits)] for r in range(n - 1)])
    rng, bits = np.random.Generator(np.random.PCG64(7)), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, bits))
        if (np.abs(m.sum(axis=0)) == n).any():
            continue
        d = (m @ m.T)[np.triu_indices(n, 1)]
        least = int(((bits - d) / 2).min())
        if least > far:
            best, far = m, least
    return best


class Model:
    """Languages, codewords, log odds (buckets x bits) and the weight of each bit."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.codes = code_matrix(len(self.langs))
        bits = self.codes.shape[1] if self.langs else 0
        self.weights = np.zeros((BUCKETS * len(ORDERS), bits), np.float32)
        self.bit_weight = np.ones(bits)
        if len(self.langs) > 1:
            p = np.array([(c + SMOOTH) / (c + SMOOTH).sum() for c in (counts[x].astype(float) for x in self.langs)])
            for b in range(bits):
                up, down = p[self.codes[:, b] > 0].mean(axis=0), p[self.codes[:, b] < 0].mean(axis=0)
                w = np.log(up / down)
                self.weights[:, b] = w
                self.bit_weight[b] = ((up - down) * w).sum()  # how far the two sides are apart
            self.bit_weight /= self.bit_weight.mean()

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        n, bits = len(texts), self.weights.shape[1]
        margin, grams, letters = np.zeros((n, bits)), np.zeros(n), np.zeros(n, bool)
        for which, some in _pieces(texts):
            c, doc = _codes_of(some)
            where = np.array(which)
            letters[where[np.unique(doc[c != 0])]] = True
            if len(self.langs) > 1:
                for bucket, of in _features(c, doc):
                    of = where[of]
                    grams += np.bincount(of, minlength=n)
                    for b in range(bits):
                        margin[:, b] += np.bincount(of, weights=self.weights[:, b][bucket], minlength=n)
        if not self.langs:
            return ["und"] * n, np.zeros(n), np.zeros(n, bool)
        margin /= np.maximum(grams, 1)[:, None]
        z = SLOPE * margin[:, None, :] * self.codes[None, :, :]
        loss = (np.logaddexp(0, -z) * self.bit_weight).sum(axis=2)
        best = loss.argmin(axis=1)
        e = np.exp(loss.min(axis=1, keepdims=True) - loss)
        score = np.where(letters, 1 / e.sum(axis=1), 0.0)
        order = np.sort(loss, axis=1)
        close = letters & (order[:, 1] - order[:, 0] < LEAD) if len(self.langs) > 1 else np.zeros(n, bool)
        return [self.langs[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist(), strict=True)], score, close


def held_out(doc_id="doc_id"):
    """crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, most: int = MOST_LANGS) -> Model:
    """Learns from all rows of docs (doc_id, text, lang, ...) that aren't held out and have a lang."""
    ship(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    langs = rows.select("lang").distinct().limit(most + 1).count()
    if langs > most:
        raise ValueError(f"more than {most} languages to learn")
    sums = rows.select("lang", "text").mapInArrow(tidy(_counted), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    lang, bucket, n = np.array(got["lang"].to_pylist(), object), np.asarray(got["bucket"]), np.asarray(got["n"])
    counts = {}
    for x in sorted(set(lang.tolist())):
        total = np.zeros(BUCKETS * len(ORDERS), np.int64)
        total[bucket[lang == x]] = n[lang == x]
        counts[x] = total
    return Model(counts)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, lang_pred, score, ambiguous, and the kept columns."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # languages x buckets, a bounded size

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, close = shared.value.decide(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", *keep)), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], ["doc_id", "held_out", *keep, "lang_pred", "score", "ambiguous"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    extra = [c for c in keep if c != "text"]
    rows = docs.select("doc_id", held_out().alias("held_out"), "text", *extra)
    return rows.mapInArrow(tidy(of), "doc_id long, held_out boolean, " + "".join(f"`{c}` {kinds[c]}, " for c in keep) + "lang_pred string, score double, ambiguous boolean")
