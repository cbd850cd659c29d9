"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

n-grams of one to three characters of the lower-cased text, runs of other than
letters being one space, are hashed into DIMENSIONS. Document frequencies are counted
over all labelled documents that are not held out. The weights are learnt by
follow-the-regularised-leader with L1 and L2 penalties, which leaves them sparse, on
a sample of at most SAMPLE of these documents, equally many of each language, chosen
by hash (the only bound); a fifth of the sample calibrates the temperature of the softmax.

Defined cases: a null text, or one without a letter, is `und` with score 1; without
any labelled document all are `und` with score 0; repeated rows each get a row; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE, HASHES = 3000, 1 << 40
EPOCHS, BATCH = 3, 16
#: Rows of a language with few are learnt from more often, so many times at most.
REPEAT = 20
L1, L2, RATE, BETA = 0.1, 1e-3, 0.5, 1.0
BLOCK = 1 << 18
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _codes(text: str) -> np.ndarray:
    """Code points of the normalised text, with a space at either end; none without a letter."""
    at = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.unique(at)
    letter = np.fromiter((chr(c).isalpha() for c in seen), bool, len(seen))
    if not letter.any():
        return np.zeros(0, np.uint32)
    is_letter = letter[np.searchsorted(seen, at)] if len(seen) > 300 or (len(seen) and seen[-1] > 0xFFFF) else _lookup(seen, letter)[at]
    at = np.where(is_letter, at, 32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    at = at[keep]
    return np.concatenate([[32], at, [32] * int(at[-1] != 32)]).astype(np.uint32)


def _lookup(seen: np.ndarray, letter: np.ndarray) -> np.ndarray:
    table = np.zeros(int(seen[-1]) + 1, bool)
    table[seen] = letter
    return table


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of a text and their counts."""
    codes = _codes(text or "")
    total = np.zeros(DIMENSIONS, np.int64)
    for lo in range(0, len(codes), BLOCK):  # bounded memory for any text
        own = codes[lo : lo + BLOCK + max(ORDERS) - 1].astype(np.uint64)
        for n in ORDERS:
            stop = min(BLOCK, len(codes) - lo) if lo + BLOCK < len(codes) else len(own) - n + 1
            if stop <= 0:
                continue
            h = np.full(stop, np.uint64(n))
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + own[k : k + stop]
                h ^= h >> np.uint64(29)
            total += np.bincount(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49)).astype(np.int64), minlength=DIMENSIONS)
    at = np.flatnonzero(total)
    return at, total[at]


def _vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = ngram_counts(text)
    return at, weigh(at, n, idf)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each n-gram bucket, over all of docs: DIMENSIONS sums, whatever the input."""

    def count(batches):
        df, n = np.zeros(DIMENSIONS + 1, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                at, _ = ngram_counts(t)
                df[at] += 1
                n += 1
        df[DIMENSIONS] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(df)], ["k", "n"])

    rows = docs.select("text").mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(DIMENSIONS + 1, np.int64)
    df[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return int(df[DIMENSIONS]), df[:DIMENSIONS]


def sample(docs: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, n-gram buckets, counts) of at most SAMPLE documents, equally many of each language as far as there are any, in the order of a hash of the rows.

    A threshold of the hash for each language leaves about 1.5 times its share to be ordered, and at least its smallest
    hash, so that a task sends few rows whatever it holds; what is sent are counts of DIMENSIONS at most, never texts.
    """
    h = F.pmod(F.xxhash64("doc_id", "text", "lang"), F.lit(HASHES))
    found = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(h).alias("least")).collect()  # a row a language
    if not found:
        return []
    share = max(1, SAMPLE // len(found))
    limit = F.create_map(*(F.lit(x) for r in found for x in (r.lang, max(r.least, int(HASHES * min(1.0, 1.5 * share / r.n))))))
    near = docs.select("lang", "text", h.alias("h")).filter(F.col("h") <= F.element_at(limit, F.col("lang")))

    def count(batches):
        for batch in batches:
            made = [ngram_counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in (0, 1))], ["lang", "h", "at", "n"])

    order = Window.partitionBy("lang").orderBy("h")
    few = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= share).select("lang", "text", "h")
    rows = few.mapInArrow(count, "lang string, h bigint, at array<bigint>, n array<bigint>").collect()
    return [(r.lang, np.array(r.at, np.int64), np.array(r.n, np.int64)) for r in sorted(rows, key=lambda r: (r.h, r.lang))]


def weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of counts, of length 1."""
    x = (1 + np.log(n)) * idf[at]
    return x / max(np.linalg.norm(x), 1e-12)


def ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, order: list[np.ndarray]) -> np.ndarray:
    """Weights (DIMENSIONS, classes) by FTRL-proximal with elastic net; order: the rows of each step."""
    z, n = np.zeros((DIMENSIONS, classes)), np.zeros((DIMENSIONS, classes))
    w = np.zeros_like(z)
    for own in order:
        at = np.unique(np.concatenate([vectors[i][0] for i in own]))
        grad = np.zeros((len(at), classes))
        for i in own:
            k, x = vectors[i]
            s = x @ w[k]
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            grad[np.searchsorted(at, k)] += x[:, None] * p / len(own)
        more = n[at] + grad**2
        z[at] += grad - (np.sqrt(more) - np.sqrt(n[at])) / RATE * w[at]
        n[at] = more
        w[at] = np.where(np.abs(z[at]) <= L1, 0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(more)) / RATE + L2))
    return w


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, which is convex in its inverse.

    The true class counts (n + 1) / (n + classes) and the others the rest, as if each had been seen once more: rows that
    are all told apart don't make every later row certain.
    """
    n, classes = scores.shape
    if not n or classes < 2:
        return 1.0
    target = np.full(scores.shape, 1 / (n + classes))
    target[np.arange(n), y] = (n + 1) / (n + classes)

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - (target * s).sum(1)))

    low, high = np.log(1e-4), np.log(1e4)
    for _ in range(80):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> dict:
    """Weights by FTRL over BATCH documents a step, temperature on every fifth document, which takes no part in the steps."""
    names = sorted({r[0] for r in rows})
    y = np.array([names.index(r[0]) for r in rows])
    vectors = [(at, weigh(at, n, idf)) for _, at, n in rows]
    held = np.arange(len(rows)) % 5 == 4
    n = np.bincount(y[~held], minlength=len(names))
    own, rnd, order = np.repeat(np.flatnonzero(~held), np.clip(n.max() // np.maximum(n, 1), 1, REPEAT)[y[~held]]), np.random.default_rng(0), []
    for _ in range(EPOCHS):
        rnd.shuffle(own)
        order += [own[lo : lo + BATCH].copy() for lo in range(0, len(own), BATCH)]
    w = ftrl(vectors, y, len(names), order)
    scores = np.array([vectors[i][1] @ w[vectors[i][0]] for i in np.flatnonzero(held)]).reshape(-1, len(names))
    return {"names": names, "weights": w.astype(np.float32), "temperature": temperature(scores, y[held]), "idf": idf}


def train(docs: DataFrame) -> dict | None:
    """The model of docs(doc_id, text, lang): whole frequencies, weights from at most SAMPLE documents. Texts without a letter teach nothing."""
    docs = docs.filter(F.col("text").rlike(r"\p{L}"))
    n, df = document_frequencies(docs)
    rows = sample(docs) if n else []
    return fit(rows, np.log((1 + n) / (1 + df)) + 1) if rows else None


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS weights a language

    def run(batches):
        m = held.value
        for batch in batches:
            lang, score = [], []
            for t in batch.column(2).to_pylist():
                at, x = _vector(t, m["idf"]) if m else ((), ())
                if not len(at):
                    lang.append(UNKNOWN)
                    score.append(1.0 if m else 0.0)
                    continue
                s = (x @ m["weights"][at]).astype(float) / m["temperature"]
                k = int(s.argmax())
                lang.append(m["names"][k])
                score.append(float(1 / np.exp(s - s[k]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    learn = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    return predict(docs, train(learn))
