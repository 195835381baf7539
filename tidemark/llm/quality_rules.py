"""Quality rules combined by weak supervision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textkernel as tk
from tidemark.llm.textstats import Stats
from tidemark.runtime import materialize, ship, table

RULES = ("symbols", "tables", "capitals", "shouting", "line_repeats", "word_repeats", "function_words", "line_ends", "word_length", "letters")
#: Kinds of bad text, and the rules that were made to find each.
KINDS = {
    "noise": ("symbols", "letters"),
    "tables": ("tables", "line_ends"),
    "shouting": ("capitals", "shouting", "line_repeats"),
    "repetition": ("word_repeats", "function_words", "line_repeats"),
}
KEEP = 0.5
_ROUNDS, _TOLERANCE = 200, 1e-9


def _vote(value: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(good, 1, np.where(bad, -1, 0)).astype(np.int8)


def votes(col: pa.Array) -> np.ndarray:
    """A row of votes for each text: 1 good, -1 bad, 0 abstain. Texts too short for a rule's
    share to mean anything get an abstention, so nulls and empty texts get nothing else."""
    s = Stats(col)
    t = s.text
    words, chars = t(s.words), t(s.chars)
    solid = t((~s.blank).astype(float))
    share = lambda x, of: t(x) / np.maximum(of, 1)
    letters = t(s.upper + s.lower)
    some, many, lines = words >= 8, words >= 40, solid >= 4
    out = []
    x = share(s.symbol, chars)
    out.append(_vote(x, some & (x < 0.01), some & (x > 0.06)))
    x = share(s.pipe, words)
    out.append(_vote(x, some & (x < 0.01), some & (x > 0.25)))
    x = share(s.upper, letters)
    out.append(_vote(x, some & (x < 0.15), some & (x > 0.5)))
    x = share(s.shout, words)
    out.append(_vote(x, some & (x < 0.05), some & (x > 0.6)))
    x = share(s.later, solid)
    out.append(_vote(x, lines & (x < 0.15), lines & (x > 0.4)))
    x = share(s.echo, words)
    out.append(_vote(x, some & (x < 0.05), some & (x > 0.3)))
    x = share(s.function, words)
    out.append(_vote(x, many & (x > 0.08), many & (x < 0.03)))
    x = share(s.ends, solid)
    out.append(_vote(x, some & (x > 0.7), some & (x < 0.2)))
    x = share(s.word_bytes, words)
    out.append(_vote(x, some & (x > 2.5) & (x < 9), some & ((x < 1.8) | (x > 14))))
    x = letters / np.maximum(chars, 1)
    out.append(_vote(x, some & (x > 0.62), some & (x < 0.5)))
    return np.stack(out, axis=1)


def _pattern_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = 3 ** np.arange(len(RULES))
    for batch in batches:
        for part in tk.slices(batch, "text"):
            pattern = (votes(part.column("text")).astype(np.int64) + 1) @ base
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pattern.astype(np.int32))], ["doc_id", "pattern"])


def unpack(pattern: np.ndarray) -> np.ndarray:
    """Votes of a vote pattern."""
    return pattern[:, None] // 3 ** np.arange(len(RULES)) % 3 - 1


def fit(vote: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the classes and the rules' accuracies in each, by expectation-maximisation.

    vote: a row for each distinct vote pattern; count: documents that have it. A document is good
    or bad in one of KINDS. accuracy[c, r]: how often rule r, if it speaks, says good of a document
    of class c (0: good); whether it speaks says nothing. Starts from the rules' bad votes: a kind
    is as likely as the share of its rules that say bad. A rule that often says bad of documents
    that the others find good, or only along with others, ends with an accuracy that shows it.
    """
    said = np.stack([(vote[:, [RULES.index(r) for r in rules]] == -1).mean(axis=1) for rules in KINDS.values()], axis=1)
    first = np.column_stack([np.full(len(vote), 0.2), said + 0.002])
    p = first / first.sum(axis=1, keepdims=True)
    hope = np.array([[0.99] * len(RULES)] + [[0.3 if r in rules else 0.8 for r in RULES] for rules in KINDS.values()])
    accuracy, share = hope, np.full(1 + len(KINDS), 1 / (1 + len(KINDS)))
    for _ in range(_ROUNDS):
        weight = (p * count[:, None]).T
        fresh = np.clip((weight @ (vote == 1) + hope) / (weight @ (vote != 0) + 1), 1e-4, 1 - 1e-4)
        share = (weight.sum(axis=1) + 1) / (count.sum() + len(share))
        moved = np.abs(fresh - accuracy).max()
        accuracy, p = fresh, classes(vote, share, fresh)
        if moved < _TOLERANCE:
            break
    return share, accuracy


def classes(vote: np.ndarray, share: np.ndarray, accuracy: np.ndarray) -> np.ndarray:
    """Probability of each class (0: good) for documents with these votes."""
    odds = np.log(share) + (vote == 1) @ np.log(accuracy).T + (vote == -1) @ np.log(1 - accuracy).T
    odds = np.exp(odds - odds.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def posterior(vote: np.ndarray, share: np.ndarray, accuracy: np.ndarray) -> np.ndarray:
    """Probability that a document with these votes is good."""
    return classes(vote, share, accuracy)[:, 0]


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, p_quality, keep) for every document, from rules that vote or abstain.

    Votes are counted by pattern over all documents (there are at most 3^10 patterns, whatever the
    size of the corpus); expectation-maximisation over the patterns gives the share of good
    documents and of each kind of bad ones, and each rule's accuracy in each; each document gets
    the posterior probability of its pattern and is kept from KEEP on. No rule alone rejects.

    Null, empty and very short texts get only abstentions, so the prior is their probability.
    Repeated rows and null doc_ids each give their row and count each; texts of any length are read
    whole. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cast = materialize(texts.mapInArrow(_pattern_batches, "doc_id long, pattern int"), "votes")
    counts = cast.groupBy("pattern").count().collect()
    pattern = np.array([r["pattern"] for r in counts], np.int64)
    vote = unpack(pattern)
    p = posterior(vote, *fit(vote, np.array([r["count"] for r in counts], float))) if len(counts) else np.zeros(0)
    schema = T.StructType([T.StructField("pattern", T.IntegerType()), T.StructField("p_quality", T.DoubleType())])
    known = spark.createDataFrame([(int(a), float(b)) for a, b in zip(pattern, p)], schema)
    return cast.join(F.broadcast(known), "pattern").select("doc_id", "p_quality", (F.col("p_quality") >= KEEP).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents", spread=True))
