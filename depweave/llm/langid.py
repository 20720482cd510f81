"""Language identification with blended-spectrum string kernels.

A text's features are the byte n-grams (n = 2, 3, 4) present in its lower-cased UTF-8
form, white space and digits folded, hashed to ``DIMS`` places.  The kernel of two texts
is the number of shared places over the geometric mean of their own numbers.  Training
takes a bounded sample: about ``PER_LANGUAGE`` labelled rows of each language, and fewer
of each (``FEWEST`` at least) where languages are so many that these would be more than
``SAMPLE``, as bit vectors made by the executors, of which ``LANDMARKS`` (one of each
language at least) serve as Nystroem landmarks.  One ridge regression per language (one versus the rest) is
fitted in the landmarks' whitened feature space.

Since the kernel is a dot product of presence vectors, the fitted regressions fold into
one ``DIMS`` x languages matrix; texts are scored in batches of presence rows times it.
The matrix is of fixed size, whatever the corpus, and goes out with the tasks.

Edge cases: null text or a text without letters is ``und`` with score 0; with no labelled
row at all every text is ``und``; very long texts are taken whole, in slices that overlap
by the n-gram length; repeated rows and extra columns make no difference.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 1 << 15
SIZES = (2, 3, 4)
#: Bounds of the training sample.
PER_LANGUAGE = 400
SAMPLE = 64 * PER_LANGUAGE
FEWEST = 16
LANDMARKS = 256
#: Rows of the sample that are unpacked at once (8 MB).
ROWS = 64
RIDGE = 1e-2
#: Bytes hashed at once.
SLICE = 1 << 20
UNKNOWN = "und"


def _fold_table() -> np.ndarray:
    """Byte -> byte: ASCII letters to lower case, white space, digits and controls to a space."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    table[:33] = 32
    table[ord("0") : ord("9") + 1] = 32
    return table


_FOLD = _fold_table()


def _mark(row: np.ndarray, raw: bytes) -> None:
    """Set the places of every n-gram of one text."""
    step = SLICE
    for at in range(0, max(1, len(raw)), step):
        b = _FOLD[np.frombuffer(raw, np.uint8)[at : at + step + max(SIZES) - 1]].astype(np.uint32)
        code = b
        for n in range(2, max(SIZES) + 1):
            if len(code) < 2:
                break
            code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
            if n in SIZES:
                row[((code * np.uint32(2654435761) + np.uint32(n)) >> np.uint32(17)) & np.uint32(DIMS - 1)] = 1


def _presence(texts: list[str | None]) -> np.ndarray:
    """One row of 0 and 1 per text."""
    x = np.zeros((len(texts), DIMS), np.float32)
    for row, t in zip(x, texts):
        if t:
            _mark(row, b" " + t.encode() + b" ")
    return x


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (lang, order, text): (lang, order, packed presence)."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for i in range(0, len(texts), 64):
            bits = np.packbits(_presence(texts[i : i + 64]).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i : i + 64], batch.column(1)[i : i + 64], pa.array([b.tobytes() for b in bits], pa.binary())],
                names=["lang", "at", "bits"],
            )


def _dense(bits: np.ndarray) -> np.ndarray:
    """Presence rows of packed ones, each divided by the root of its sum."""
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    return x


def fit(bits: np.ndarray, y: list[str], *, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """(languages, weights): Nystroem features of the presence kernel, then kernel ridge regression.

    ``weights`` maps a presence row, divided by the root of its sum, to one value per language.
    ``bits`` are packed presence rows; of the sample only ``ROWS`` at a time are unpacked (32 times as large), as the driver fits it.
    """
    names = sorted(set(y))
    # landmarks: the first rows of each language in turn
    rank = {n: 0 for n in names}
    turn = []
    for k in y:
        turn.append(rank[k])
        rank[k] += 1
    marks = _dense(bits[np.lexsort((np.arange(len(y)), turn))[: max(landmarks, len(names))]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    use = values > values.max() * 1e-6
    white = vectors[:, use] / np.sqrt(values[use])
    z = np.concatenate([(_dense(bits[i : i + ROWS]) @ marks.T).astype(np.float64) @ white for i in range(0, len(bits), ROWS)])
    target = np.array([[float(k == n) for n in names] for k in y])
    # every language weighs the same, however many rows it has
    share = np.array([1.0 / rank[k] for k in y])
    share = share / share.mean()
    gram = (z * share[:, None]).T @ z + ridge * len(y) / len(names) * np.eye(z.shape[1])
    coefficients = np.linalg.solve(gram, (z * share[:, None]).T @ target)
    return names, marks.T @ (white @ coefficients).astype(np.float32)


def train(labelled: DataFrame, *, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> tuple[list[str], np.ndarray] | None:
    """Fit on a bounded sample of (doc_id, text, lang) rows with a language; None if there is none.

    All languages are learnt; where they are many, each has fewer rows.

    The sample is the same for the same rows: those of the lowest hashes, by a cutoff from the counts.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "lang", F.xxhash64("doc_id", "text").alias("at"), "text"
    )
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return None
    per_language = min(per_language, max(FEWEST, sample // len(counts)))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, per_language / r["count"]))])
    chosen = rows.filter(F.pmod(F.col("at"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * F.lit(float(1 << 30)))
    # equal rows count once, so that many of them cannot fill the sample; of too many the lowest hashes stay
    distinct = chosen.dropDuplicates(["lang", "at"]).mapInArrow(_bits, "lang string, at bigint, bits binary")
    found = distinct.orderBy("at", "lang", "bits").limit(2 * per_language * len(counts)).collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["at"], r["lang"], r["bits"]))
    return fit(np.stack([np.frombuffer(r["bits"], np.uint8) for r in found]), [r["lang"] for r in found])


def _scored(texts: pa.Array, names: list[str], weights: np.ndarray) -> list[pa.Array]:
    """The language and the score of each text."""
    lang, score = [], []
    for i in range(0, len(texts), 128):
        some = texts.slice(i, 128).to_pylist()
        x = _presence(some)
        found = (x @ weights) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        best = found.argmax(1)
        for t, k, v in zip(some, best.tolist(), found.max(1).tolist()):
            known = bool(t) and any(map(str.isalpha, t))
            lang.append(names[k] if known else UNKNOWN)
            score.append(min(1.0, max(0.0, v)) if known else 0.0)
    return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]


def _score(names: list[str], weights: np.ndarray, added: tuple[str, str]) -> Callable:
    """mapInArrow over (the kept columns, text): adds the language and its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_scored(batch.column(batch.num_columns - 1), names, weights)], names=[*batch.schema.names[:-1], *added])

    return run


def predicted(model: tuple[list[str], np.ndarray] | None, text: Column) -> Column:
    """Language (``lang``) and ``score`` of a text as one struct: a column function, so that only texts pass through Python and the rest of a row does not."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    names, weights = model

    @F.arrow_udf("struct<lang string, score double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_scored(texts, names, weights), names=["lang", "score"])

    return of(text)


def is_held_out():
    """Documents that take no part in training: CRC-32 of the id as text, remainder 1 of 3."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def predict(
    docs: DataFrame, model: tuple[list[str], np.ndarray] | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``keep`` columns and, as ``names``, the language and score of every row."""
    kept = [F.col(f"`{c}`") for c in keep]
    if model is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias(names[0]), F.lit(0.0).alias(names[1]))
    rows = docs.select(*kept, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_score(*model, names), f"{schema}, `{names[0]}` string, `{names[1]}` double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the documents that are not held out."""
    marked = docs.select("doc_id", "text", "lang", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"))
    model = train(marked.filter(~F.col("held_out")))
    return predict(marked, model, ("doc_id", "held_out"))
