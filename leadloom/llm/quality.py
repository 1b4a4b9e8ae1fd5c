"""Quality classifier: which of two zstandard dictionaries, good or bad text, compresses a text better."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_crc

#: Bound of the fitting sample: labelled rows of each class; their whole texts count.
SAMPLE_ROWS = 1500
DICT_BYTES = 65536
#: Texts are compressed in pieces of so many bytes, so that the dictionary and not the text itself is what helps.
PIECE = 768


def fitting_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, fold_of, seed: int = 11):
    """At most rows labelled texts of each class, those with the smallest seeded hashes, with doc_id.

    A doc_id with several labels has the largest of them.
    """
    found = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & fold_of).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    found = found.withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    chosen = None
    for y in (0, 1):
        part = found.where(F.col("y") == y).orderBy("h", "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.union(part)
    # chosen has 2 * rows rows at most, so it may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "y")), "doc_id")


def train_dictionaries(sample: list[tuple[str, int]]):
    """(good, bad) dictionaries as bytes: the samples' own content, interleaved in the order given."""
    out = []
    for y in (1, 0):
        parts, left = [], DICT_BYTES
        texts = [t.encode("utf-8", "surrogatepass") for t, k in sample if k == y and t]
        each = max(256, DICT_BYTES // max(1, len(texts)))
        for t in texts:
            parts.append(t[:each])
            left -= len(parts[-1])
            if left <= 0:
                break
        out.append(_trained([t for t in texts], b"\n".join(parts)[:DICT_BYTES]))
    return tuple(out)


def _trained(texts: list[bytes], plain: bytes) -> bytes:
    """A trained dictionary; with too little text to train on, the text itself is the dictionary."""
    import zstandard as zstd

    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstd.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except (zstd.ZstdError, ValueError):
        return plain or b" "


def compressors(dictionaries):
    import zstandard as zstd

    return [zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in dictionaries]


def difference(text: str | None, pair) -> float:
    """(bytes with the bad dictionary - bytes with the good one) / bytes, over all pieces of the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return 0.0
    good = bad = 0
    for i in range(0, len(raw), PIECE):
        piece = raw[i : i + PIECE]
        good += len(pair[0].compress(piece))
        bad += len(pair[1].compress(piece))
    return (bad - good) / len(raw)


def calibrate(x, y, rounds: int = 60) -> tuple[float, float]:
    """(slope, offset) of a logistic curve through one feature, by Newton steps with a small ridge; the classes weigh alike."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(set(y.tolist())) < 2:
        return 0.0, 20.0 if len(y) and y[0] else (-20.0 if len(y) else 0.0)
    scale = x.std() or 1.0
    a = np.c_[x / scale, np.ones_like(x)]
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (w * (y - p)) - 1e-3 * beta
        h = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def fit_quality(docs: DataFrame, labels: DataFrame, fold_of=None, rows: int = SAMPLE_ROWS) -> dict:
    """The model, from at most rows labelled texts of each class, whole.

    One half of the sample makes the dictionaries, the other the calibration.
    """
    fold_of = F.lit(True) if fold_of is None else fold_of
    sample = fitting_sample(docs, labels, "quality", rows, fold_of).select("doc_id", "y", "text")
    got = sorted((r for r in sample.collect() if r.text), key=lambda r: (r.doc_id, r.text))
    build, hold = got[::2], got[1::2] or got
    dictionaries = train_dictionaries([(r.text, r.y) for r in build])
    pair = compressors(dictionaries)
    slope, offset = calibrate([difference(r.text, pair) for r in hold], [r.y for r in hold])
    return {"dictionaries": dictionaries, "slope": slope, "offset": offset}


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row; the whole text is compressed. Null and empty texts have a difference of 0."""
    dictionaries, slope, offset = model["dictionaries"], model["slope"], model["offset"]

    def run(batches):
        import pyarrow as pa

        pair = compressors(dictionaries)
        for b in batches:
            z = [slope * difference(x.as_py(), pair) + offset for x in b.column(1)]
            score = [1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z]
            yield pa.record_batch([b.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text).

    Labels are learnt only from rows whose crc32(doc_id) mod folds is not held_out. Null and empty texts get
    the score of no evidence; without labels every score is 0.5; a null doc_id is never held out; repeated
    rows are scored alike; further columns are ignored; an empty table gives no rows.
    """
    fold = F.pmod(doc_crc(), F.lit(folds))
    model = fit_quality(docs, labels, fold != held_out, rows)
    scored = score_quality(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(fold == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
