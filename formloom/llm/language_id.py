"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, what follows a word becomes one space and other non-letters go, and the n-grams of one to four
characters are hashed into ``Model.features`` cells. Every task counts the cells of its labelled texts
per language; the sums over all tasks have at most languages x features rows whatever the corpus, and
only those reach the driver. The log-probability matrix (features x languages, float64) is broadcast:
its size is fixed by the two parameters. Scoring gathers matrix rows for the n-grams of a text in numpy.

Defined results: a text that is null or has no letter is ``und`` with score 0. Rows without a label or
a text teach nothing. A language is learned however rare it is; with more than ``max_languages`` the
fit is refused. If nothing could be learned every text is ``und``. Ties go to the language first in
alphabetical order. Very long texts are counted in blocks that carry their last kept characters over, so
memory does not grow with a text and no n-gram is lost or counted twice. Repeated rows count each for
itself; columns with clashing names are kept inside ``row``; an empty table gives an empty table.

Whether a text is in a language at all is another question than which one fits best: ``typical`` compares
its mean log-probability per n-gram with what texts of the language have by the model itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ORDER = 4
BLOCK = 1 << 16
_MULTIPLIERS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


@dataclass(frozen=True)
class Model:
    """Settings of the fit; together they bound the matrix that is broadcast."""

    features: int = 1 << 15
    max_languages: int = 512
    smoothing: float = 0.5


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(point).isalpha() for point in range(0x110000)), dtype=bool, count=0x110000)


def cells(text: str, features: int) -> Iterator[np.ndarray]:
    """Hash cells of all n-grams, block after block; nothing if the text has no letter."""
    shift = np.uint32(32 - (features - 1).bit_length())
    before = np.zeros(0, dtype=np.uint32)  # the last kept characters, which later n-grams begin with
    inside = False  # whether the block before ended in a letter
    for start in range(0, len(text), BLOCK):
        points = np.frombuffer(text[start : start + BLOCK].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _letters()[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one space after each word
        keep[0] |= inside
        inside = bool(letter[-1])
        new = np.where(letter, points, np.uint32(32))[keep]
        points = np.concatenate([before, new])
        old = len(before)
        value, found = np.zeros(len(points), dtype=np.uint32), []
        for order in range(min(MAX_ORDER, len(points))):
            value = (value[: len(points) - order] + points[order:]) * _MULTIPLIERS[order]
            value ^= value >> np.uint32(15)
            # An n-gram that ends before the block was counted with the block before.
            found.append((value[max(old - order, 0) :] * _MULTIPLIERS[0]) >> shift)
        if len(points):
            before = points[-(MAX_ORDER - 1) :]
        if found:
            yield np.concatenate(found)


def counted(text: str | None, features: int) -> np.ndarray | None:
    """Occurrences of each cell; None if the text is null or has no letter."""
    total = None
    for block in cells(text or "", features):
        counts = np.bincount(block, minlength=features)
        total = counts if total is None else total + counts
    return total if total is not None and total.any() else None


def count_cells(docs: DataFrame, label: str, text: str, model: Model) -> DataFrame:
    """(lang, cell, n, docs): counts per language; cell -1 carries the number of documents."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for lang, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = counted(words.as_py(), model.features)
                if counts is None:
                    continue
                if lang in sums:
                    sums[lang] += counts
                else:
                    sums[lang] = counts
                seen[lang] = seen.get(lang, 0) + 1
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch(
                [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(counts[at], seen[lang]), pa.int64())],
                names=["lang", "cell", "n"],
            )

    labelled = docs.select(F.col(label).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    return labelled.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, label: str = "lang", text: str = "text", model: Model = Model()) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, log-probability matrix (features, languages), log priors."""
    counts = count_cells(docs, label, text, model)
    langs = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").limit(model.max_languages + 1).collect()]
    if len(langs) > model.max_languages:
        raise ValueError(f"more than {model.max_languages} languages")
    rows = counts.toArrow()  # at most max_languages x (features + 1) rows
    place = {lang: i for i, lang in enumerate(langs)}
    column = np.array([place[x] for x in rows["lang"].to_pylist()], dtype=np.int64)
    cell, n = rows["cell"].to_numpy(), rows["n"].to_numpy()
    matrix = np.zeros((model.features, len(langs)))
    prior = np.zeros(len(langs))
    matrix[cell[cell >= 0], column[cell >= 0]] = n[cell >= 0]
    prior[column[cell < 0]] = n[cell < 0]
    matrix += model.smoothing
    with np.errstate(divide="ignore"):
        return langs, np.log(matrix) - np.log(matrix.sum(axis=0)), np.log(prior / max(prior.sum(), 1))


@dataclass(frozen=True)
class Margin:
    """How far below its language's mean a text's log-probability per n-gram may lie: ``nats``, and ``deviations``
    standard deviations of a mean over as many n-grams as the text has, of which ``MAX_ORDER`` count as one."""

    nats: float = 1.5
    deviations: float = 4.0


def expectations(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of an n-gram's log-probability in each language, by the model."""
    p = np.exp(matrix)
    mean = (p * matrix).sum(axis=0)
    return mean, (p * (matrix - mean) ** 2).sum(axis=0)


def classify(text: str | None, langs: list[str], matrix: np.ndarray, prior: np.ndarray, expected) -> tuple[str, float, float | None, float | None]:
    """Language, its posterior probability, nats per n-gram below the language's mean, standard deviation of such a mean."""
    counts = counted(text, len(matrix)) if langs else None
    if counts is None:
        return "und", 0.0, None, None
    own, n = np.flatnonzero(counts), int(counts.sum())
    logs = counts[own] @ matrix[own]
    total = prior + logs
    best = int(np.argmax(total))
    mean, variance = expected
    short = max(float(mean[best] - logs[best] / n), 0.0)
    return langs[best], float(1.0 / np.exp(total - total[best]).sum()), short, float(np.sqrt(variance[best] * MAX_ORDER / n))


def typical(margin: Margin = Margin()) -> Column:
    """Whether a row of ``predict`` is like the texts of its language."""
    return F.coalesce(F.col("shortfall") <= margin.nats + margin.deviations * F.col("deviation"), F.lit(False))


def predict(docs: DataFrame, learned, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs``, or those in ``keep``, as one column ``row``, with lang_pred, score, shortfall, deviation."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def score(batches):
        langs, matrix, prior = shared.value
        expected = expectations(matrix)
        for batch in batches:
            texts = batch.column(0).field(text) if carried else batch.column(1)
            found = [classify(x.as_py(), langs, matrix, prior, expected) for x in texts]
            out = [batch.column(0), pa.array([f[0] for f in found], pa.string()), *(pa.array([f[i] for f in found], pa.float64()) for i in (1, 2, 3))]
            yield pa.record_batch(out, names=schema.names)
            batch = texts = out = None  # else they stay while the next batch is read
            pa.default_memory_pool().release_unused()

    kept = keep or docs.columns
    carried = text in kept  # then the text is read from the row and not sent twice
    row = F.struct(*[docs[name] for name in kept]).alias("row")
    packed = docs.select(row) if carried else docs.select(row, docs[text].alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("lang_pred", T.StringType()), *(T.StructField(name, T.DoubleType()) for name in ("score", "shortfall", "deviation"))])
    return packed.mapInArrow(score, schema)


def held_out(id: Column) -> Column:
    """Whether a document is kept from the fit: a third of all, by the checksum of its id."""
    return F.coalesce(F.crc32(F.encode(id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
