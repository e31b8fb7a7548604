"""Language identification by averaged hashed subword embeddings (operator 2).

Every window of WINDOWS bytes of the lowered text, with anything but letters as a blank, is
hashed into a table of embeddings; a document is the mean of its windows' embeddings, and a
linear softmax over that mean gives the languages.  Embeddings and softmax are trained by
stochastic gradient descent in numpy on the driver, from hashed window counts that the
executors make of a bounded sample: about SAMPLE_PER_LANG labelled rows of each language, and
SAMPLE_ROWS in all.  A part of the sample isn't trained on; it sets the temperature that
calibrates the scores, and the score below which a document is rejected.

Rows: a null text, or one without a letter, is ``und`` with score 0; so is every text if no
row is labelled; labelled rows with null id or null text aren't learned from; a null id is
never held out; repeated rows each give a row; texts of any length are read whole; an empty
table gives an empty table; columns other than those named are never inputs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOWS = (3, 4)
BUCKETS_LOG2 = 16
DIM = 16
SAMPLE_PER_LANG = 1000
SAMPLE_ROWS = 8000
EPOCHS = 6
RATE = 4.0
#: Share of the sample that is kept for calibration.
CALIBRATION = 0.25
#: Share of the calibration rows that may score below the rejection threshold, and its upper bound.
REJECT_SHARE, REJECT_MOST = 0.001, 0.5
UNKNOWN = "und"

_ASCII_LETTER = re.compile("[A-Za-z]")
_BLANKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_PAD = b" " * max(WINDOWS)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or not text.isascii() and any(map(str.isalpha, text)))


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed windows of the texts one after another (a row for each window length), and where each text begins."""
    raw = [t.lower().encode("utf-8", "surrogatepass").translate(_BLANKS) for t in texts]
    flat = np.frombuffer(_PAD.join([b"", *raw, b""]), dtype=np.uint8).astype(np.uint32)
    size = np.array([len(r) + len(_PAD) for r in raw], dtype=np.int64)  # a text begins with the blanks before it
    n = int(size.sum())
    out = np.empty((len(WINDOWS), n), dtype=np.int64)
    for k, w in enumerate(WINDOWS):
        h = np.full(n, 2166136261 + w, dtype=np.uint32)
        for i in range(w):
            h ^= flat[i : i + n]
            h *= np.uint32(16777619)
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        out[k] = h >> np.uint32(32 - BUCKETS_LOG2)
    return out, np.cumsum(size) - size


@dataclass
class Model:
    """Languages, a table that is averaged over windows, and what turns the mean into logits."""

    langs: list[str]
    table: np.ndarray
    head: np.ndarray | None
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, texts: list[str]) -> np.ndarray:
        hashed, begin = windows(texts)
        size = np.diff(np.append(begin, hashed.shape[1])) * len(hashed)
        mean = np.zeros((len(texts), self.table.shape[0]))
        for k in range(self.table.shape[0]):
            for row in hashed:
                mean[:, k] += np.add.reduceat(self.table[k][row], begin, dtype=np.float64)
        mean /= size[:, None]
        return softmax(((mean if self.head is None else mean @ self.head) + self.bias) / self.temperature)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        if at:
            p = self.probabilities([texts[i] for i in at])
            for i, k, s in zip(at, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                langs[i], scores[i] = self.langs[k], min(1.0, max(0.0, s))
        return langs, scores


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def learnable(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Labelled rows that may be learned from, with their ids' hashes."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc % 3 != 1)).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).alias("draw")
    )


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> list:
    """Hashed window counts of the sampled rows: (lang, draw, buckets, counts), packed, some kilobytes a row."""
    rows = learnable(df, id_col, text_col, lang_col)
    sizes, langs = common.narrow(rows.groupBy("lang").count())
    share = sizes.select("lang", (F.lit(min(float(SAMPLE_PER_LANG), SAMPLE_ROWS / max(1, langs))) / F.col("count") * (1 << 30)).alias("most"))
    # a row for each language: broadcast if few, so that no text moves before it is drawn
    drawn = common.picked(rows, share, langs, "lang", "inner").where("draw < most").select("draw", "text", "lang")

    def fn(part: pa.RecordBatch) -> dict:
        texts = part.column(1).to_pylist()
        at = [i for i, t in enumerate(texts) if has_letter(t)]
        buckets, counts = [], []
        if at:
            hashed, begin = windows([texts[i] for i in at])
            for a, b in zip(begin, [*begin[1:], hashed.shape[1]], strict=True):
                i, n = np.unique(hashed[:, a:b], return_counts=True)
                buckets.append(i.astype("<u2").tobytes())
                counts.append(n.astype("<u2" if n.max() < 1 << 16 else "<u4").tobytes())
        return {"lang": part.column(2).take(pa.array(at, pa.int64())), "draw": part.column(0).take(pa.array(at, pa.int64())), "buckets": buckets, "counts": counts}

    return sorted(common.map_slices(drawn, fn, "lang string, draw long, buckets binary, counts binary").collect(), key=lambda r: (r.draw, r.lang, len(r.buckets)))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 7) -> Model:
    """A model from a bounded sample of the labelled rows."""
    rows = sample(df, id_col, text_col, lang_col)
    langs = sorted({r.lang for r in rows})
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKETS_LOG2, DIM))
    head, bias = rng.normal(0, 0.5, (DIM, len(langs))), np.zeros(len(langs))
    if not rows:
        return Model([], table.T, None, bias)
    at = {lang: k for k, lang in enumerate(langs)}

    def example(k: int) -> tuple[int, np.ndarray, np.ndarray]:
        n = np.frombuffer(rows[k].counts, dtype="<u2" if len(rows[k].counts) == len(rows[k].buckets) else "<u4").astype(np.float64)
        return at[rows[k].lang], np.frombuffer(rows[k].buckets, dtype="<u2").astype(np.int64), n / n.sum()

    order = rng.permutation(len(rows))
    held = order[: int(len(rows) * CALIBRATION)] if len(rows) >= 40 else order
    learn = order[len(held) :] if len(rows) >= 40 else order
    steps = max(1, EPOCHS * len(learn))
    done = 0
    for _ in range(EPOCHS):
        for k in rng.permutation(learn):
            y, i, w = example(k)
            rate = RATE * (1 - done / steps)
            rows_i = table[i]
            mean = w @ rows_i
            z = mean @ head + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1.0
            back = head @ g
            head -= 0.1 * rate * np.outer(mean, g)
            bias -= 0.01 * rate * g
            table[i] = rows_i - rate * np.outer(w, back)
            done += 1
    tried = [(y, w @ table[i] @ head + bias) for y, i, w in map(example, held)]
    truth, logits = np.array([y for y, _ in tried]), np.array([z for _, z in tried])
    grid = np.geomspace(0.2, 5.0, 40)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    least = float(np.quantile(softmax(logits / temperature).max(1), REJECT_SHARE))
    folded = len(langs) <= DIM  # fewer columns to average: fold the softmax into the table
    return Model(
        langs, np.ascontiguousarray((table @ head if folded else table).T.astype(np.float32)), None if folded else head, bias, temperature, min(REJECT_MOST, least)
    )


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the table's fixed size

    def fn(part: pa.RecordBatch) -> dict:
        m = shared.value
        langs, scores = m.predict(part.column(1).to_pylist())
        return {"doc_id": part.column(0), "lang_pred": langs, "score": scores, "rejected": [lang == UNKNOWN or s < m.reject_below for lang, s in zip(langs, scores, strict=True)]}

    return common.map_slices(df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text")), fn, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text isn't rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in common.slices(batch, at):
                langs, scores = m.predict(part.column(at).to_pylist())
                yield part.filter(pa.array([lang != UNKNOWN and s >= m.reject_below for lang, s in zip(langs, scores, strict=True)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that aren't held out."""
    docs = common.table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = identify(docs, train(docs))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
