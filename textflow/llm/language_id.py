"""Language identification by nearest centroids.

A text becomes a vector of hashed byte n-grams (A-Z and other capitals
lower-cased, ASCII characters that are no letters taken as spaces), weighted
by (1 + log count) times the inverse document frequency and scaled to length
one. Each language has several centroids, found by spherical k-means; the nearest
centroid by cosine gives the language. Document frequencies come from every
training row; only the clustering is fitted on a bounded sample
(``SAMPLE`` different texts of each language, chosen by a hash of the text).

A text is rejected when its distance (1 - cosine) to the nearest centroid is
larger than the distance allowed at its length. That distance is measured on
pieces of the sample's texts of many lengths, so a short text isn't rejected for
being short.

Defined cases: a null text, or one without a letter, is ``und`` with score 0
and is rejected; training rows with a null text or language are left out; a
training table without usable rows makes every text ``und``; ties between
languages go to the first by name. Rows may repeat; copies of a text count
once in the sample, so every language with a text is learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
#: Buckets of the hashed n-grams and their lengths in bytes.
BUCKETS, LENGTHS = 4096, (2, 3)
#: Sampled texts and centroids of each language.
SAMPLE, CENTROIDS = 400, 4
#: Languages that can be learned; more are an error, as centroids go to every task.
MAX_LANGUAGES = 500
#: A text is rejected below this share of the lowest hundredth of cosines at its length.
MARGIN = 0.5
#: Piece lengths, in n-grams, at which the cosines are measured.
PIECES = (8, 16, 32, 64, 128, 256, 512, 1024, 1 << 40)

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray  # lowest accepted cosine at each of PIECES


def counts(text: str) -> np.ndarray:
    """How often each bucket occurs."""
    raw = np.frombuffer(b" %s " % text.lower().encode("utf-8", "replace").translate(_LETTERS), np.uint8)
    code = raw.astype(np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    for n in range(2, max(LENGTHS) + 1):
        code = (code[:-1] << np.uint32(8)) | raw[n - 1:]
        if n in LENGTHS:
            mixed = (code + np.uint32(n << 28)) * np.uint32(2654435761)
            total += np.bincount(mixed >> np.uint32(20), minlength=BUCKETS)
    return total


def weigh(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of count rows; a row without weight stays zero."""
    v = np.where(rows > 0, 1 + np.log(np.maximum(rows, 1)), 0).astype(np.float32) * idf
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(length > 0, length, 1)


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means. Starts from the row nearest the mean, then always
    the row least like those taken, so that it needs no random numbers."""
    taken = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    while len(taken) < min(k, len(vectors)):
        taken.append(int(np.argmin((vectors @ vectors[taken].T).max(axis=1))))
    centers = vectors[taken].copy()
    for _ in range(rounds):
        own = np.argmax(vectors @ centers.T, axis=1)
        for c in range(len(centers)):
            if (own == c).any():
                mean = vectors[own == c].mean(axis=0)
                centers[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centers


def _document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Rows that hold each bucket, and rows: a task gives one sum for each
    bucket, so no more than ``BUCKETS`` rows of each task are shuffled."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += counts(text) > 0
                rows += 1
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(-1, BUCKETS, dtype=np.int32),
                                          "n": np.concatenate([[rows], total])})

    rows = train.select("_text").mapInArrow(sums, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect()
    by = {b: n for b, n in rows}
    return np.array([by.get(b, 0) for b in range(BUCKETS)]), by.get(-1, 0)


def _sampled(train: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` different texts of each language, one at least, the
    same on every run. Copies count once, and go before the texts are shuffled
    but for one of each task."""
    drawn = F.pmod(F.xxhash64("_text"), F.lit(1 << 30)) / float(1 << 30)
    texts = train.select("_lang", F.xxhash64("_text").alias("h"), drawn.alias("drawn")).distinct()
    sizes = texts.groupBy("_lang").agg(F.count("*").alias("n"), F.min("drawn").alias("low")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return train.limit(0)
    share = F.create_map(*[F.lit(x) for lang, n, _ in sizes for x in (lang, min(1.0, sample / n))])
    low = F.create_map(*[F.lit(x) for lang, _, first in sizes for x in (lang, first)])
    return train.where((drawn < share[F.col("_lang")]) | (drawn == low[F.col("_lang")])).select("_lang", "_text").distinct()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE,
        centroids: int = CENTROIDS) -> Model:
    """Learn from every row of ``docs`` with a text and a language. The
    sample's vectors are clustered in one group of bounded size for each
    language; what reaches the driver is the centroids, the cosines at each
    piece length and the bucket counts."""
    train = docs.select(F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"))
    train = train.where(F.col("_text").rlike(r"\p{L}") & F.col("_lang").isNotNull())
    df, rows = _document_frequencies(train)
    idf = (np.log((rows + 1) / (df + 1)) + 1).astype(np.float32)

    def centers(key, table):
        # about ``sample`` different texts, and only so many whatever the hashes gave
        held = sorted(table.column("_text").to_pylist())[:4 * sample]
        vectors = weigh(np.array([counts(t) for t in held]), idf)
        found = cluster(vectors, centroids)
        shares = []
        for size in PIECES:
            cut = [_middle(t, size) for t in held]
            shares.append(float(np.quantile((weigh(np.array([counts(t) for t in cut]), idf) @ found.T).max(axis=1), 0.01)))
        return pa.table({"lang": [key[0].as_py()] * len(found), "centroid": pa.array(found.tolist(), pa.list_(pa.float32())),
                         "floors": pa.array([shares] * len(found), pa.list_(pa.float64()))})

    fitted = (_sampled(train, sample).groupBy("_lang")
              .applyInArrow(centers, "lang string, centroid array<float>, floors array<double>").collect())
    fitted.sort(key=lambda r: (r.lang, r.centroid))
    return Model([r.lang for r in fitted], np.array([r.centroid for r in fitted], np.float32).reshape(-1, BUCKETS), idf,
                 MARGIN * np.min([r.floors for r in fitted], axis=0) if fitted else np.zeros(len(PIECES)))


def _middle(text: str, size: int) -> str:
    start = max(0, (len(text) - size) // 2)
    return text[start:start + size]


def predict(text: Column, model: Model) -> Column:
    """``struct<lang string, score double, distance double, rejected boolean>``
    of a text column. ``lang`` is the nearest language even where rejected;
    ``score`` is the cosine, 0 at least and 1 at most."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("distance", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("lang string, score double, distance double, rejected boolean")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for i in range(0, len(batch), 256):
                texts = batch.slice(i, 256).to_pylist()
                usable = [t is not None and bool(model.languages) and any(map(str.isalpha, t)) for t in texts]
                rows = np.array([counts(t) if ok else np.zeros(BUCKETS, np.int64) for t, ok in zip(texts, usable, strict=True)])
                cosines = weigh(rows, model.idf) @ model.centroids.T
                for ok, row, cosine in zip(usable, rows, cosines, strict=True):
                    if not ok:
                        out.append((UNDETERMINED, 0.0, 1.0, True))
                        continue
                    best = int(np.argmax(cosine))
                    score = float(np.clip(cosine[best], 0, 1))
                    n_grams = row.sum() / len(LENGTHS)
                    floor = model.floors[max(0, np.searchsorted(PIECES, n_grams, "right") - 1)]
                    out.append((model.languages[best], score, 1 - score, bool(score < floor)))
            yield pa.array([dict(zip(("lang", "score", "distance", "rejected"), r, strict=True)) for r in out], kind)

    return nearest.asNondeterministic()(text)
