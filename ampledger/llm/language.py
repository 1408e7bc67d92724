"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampledger.llm.common import pieces, remainder_of_id

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 4
SEED = 6
#: Parts of a language's rows in which the smallest hashes are found first.
SLICES = 64


def words_of(text: str) -> Counter:
    """Lower-case runs of letters and how often each occurs."""
    return Counter(LETTERS.findall(text.lower()))


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its two ends marked; none if it is too short."""
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Log frequencies by language of words and of n-grams (keys marked by their kind)."""

    languages: list[str]
    prior: np.ndarray
    words: dict[str, int]
    grams: dict[str, int]
    scores: np.ndarray  # rows of all words, then of all n-grams

    def grams_known(self, word: str) -> list[int]:
        """Rows of an unseen word's longest n-grams of which any is known."""
        marked, known = f"^{word}$", self.grams
        for n in range(min(LONGEST, len(marked)), 0, -1):
            rows = [known[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in known]
            if rows:
                return rows
        return []

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its posterior probability; unknown without letters.

        An unseen word scores the mean of its n-grams.
        """
        counts = words_of(text or "")
        if not counts or not self.languages:
            return UNKNOWN, 0.0
        rows, times, seen = [], [], self.words.get
        for word, n in counts.items():
            row = seen(word)
            if row is not None:
                rows.append(row)
                times.append(n)
            elif found := self.grams_known(word):
                rows += found
                times += [n / len(found)] * len(found)
        total = self.prior + np.asarray(times, float) @ self.scores[np.asarray(rows, int)]
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def _log_frequencies(counts: np.ndarray) -> np.ndarray:
    """Smoothed log frequencies of ``counts`` by key and language; relative to their mean,
    since only differences count.

    Smoothing adds a tenth of a count per row, dealt as the counts of all languages are: a
    language of which little was seen differs little from all together and favours nothing.
    """
    if not counts.size:
        return counts
    total, added = counts.sum(axis=1, keepdims=True), 0.1 * len(counts)
    scores = np.log(counts + added * total / total.sum()) - np.log(counts.sum(axis=0) + added)
    return scores - scores.mean(axis=1, keepdims=True)


def _tables(counted: DataFrame, languages: list[str]) -> dict[str, tuple[dict[str, int], np.ndarray]]:
    """By kind the row of each key and the counts by language. The counts of a key are one
    row of numbers, so that tables come to the driver as Arrow columns."""
    by_language = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)) for x in languages]
    by_key = counted.groupBy("kind", "key").agg(F.array(*by_language).alias("counts"))
    found = by_key.orderBy("kind", "key").toArrow()
    kinds = np.array(found.column("kind").to_pylist(), dtype=object)
    keys = found.column("key").to_pylist()
    counts = found.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    counts = counts.astype(float).reshape(len(keys), len(languages))
    out = {}
    for kind in ("w", "g"):
        rows = np.flatnonzero(kinds == kind)
        out[kind] = {keys[i]: at for at, i in enumerate(rows)}, counts[rows]
    return out


def fit(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int = 3000,
) -> Model:
    """Learn from rows with a language.

    The sample is bounded: of every language ``max_rows`` rows with the smallest seeded
    hashes of the id. All words and n-grams of their whole texts are learned. Without rows
    nothing is known and every text is predicted as unknown.
    """
    rows = df.where(F.col(lang_col).isNotNull()).select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.col(lang_col).alias("lang"),
        F.xxhash64(F.lit(SEED), F.col(id_col)).alias("_h"),
    )
    # The hashes that end the samples are found without the texts.
    place = F.row_number().over(Window.partitionBy("lang", "_slice").orderBy("_h"))
    first = (
        rows.select("lang", "_h", F.pmod(F.monotonically_increasing_id(), F.lit(SLICES)).alias("_slice"))
        .withColumn("_n", place)
        .where(F.col("_n") <= max_rows)
    )
    smallest = first.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_n") <= max_rows)
    last = smallest.groupBy("lang").agg(F.max("_h").alias("_last"))
    inside = rows.join(F.broadcast(last), "lang").where(F.col("_h") <= F.col("_last"))  # a row per language
    # Rows of one id have one hash, and more of them than wanted may stand at the end.
    by_row = Window.partitionBy("lang").orderBy("_h", F.xxhash64("text"))
    sample = inside.withColumn("_n", F.row_number().over(by_row)).where(F.col("_n") <= max_rows)

    def count(batches):
        for batch in pieces(batches, "text"):
            words: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for word, n in words_of(text).items():
                    words[word, lang] += n
            found: Counter = Counter()
            for (word, lang), n in words.items():
                found["w", word, lang] = n
                for size in range(1, LONGEST + 1):
                    for gram in grams_of(word, size):
                        found["g", gram, lang] += n
            kinds, keys, langs = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kinds, pa.string()),
                    pa.array(keys, pa.string()),
                    pa.array(langs, pa.string()),
                    pa.array(list(found.values()), pa.int64()),
                ],
                names=["kind", "key", "lang", "n"],
            )

    counted = sample.repartition(16, "_h", "_n").select("text", "lang").mapInArrow(count, "kind string, key string, lang string, n long")
    documents = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(documents)
    if not languages:
        return Model([], np.zeros(0), {}, {}, np.zeros((0, 0)))
    prior = np.log(np.array([documents[x] for x in languages], float) / sum(documents.values()))
    tables = _tables(counted, languages)
    words, grams = tables["w"][0], {gram: i + len(tables["w"][0]) for gram, i in tables["g"][0].items()}
    return Model(languages, prior, words, grams, np.concatenate([_log_frequencies(tables[k][1]) for k in "wg"]))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``df``, from its whole text.

    A null text and a text without letters are ``und`` with score 0. Null and repeated ids
    are kept as rows; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        for batch in pieces(batches, "text"):
            found = [known.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([x for x, _ in found], pa.string()),
                    pa.array([x for _, x in found], pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (remainder_of_id(id_col, 5) == 0).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def training_rows(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that are not held out: crc32 of the id modulo 5 is not 0."""
    return documents.where(remainder_of_id(id_col, 5) != 0)
