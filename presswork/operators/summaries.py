"""Extractive summaries by TextRank."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.core.storage import bounded_batches
from presswork.functions.text import STOPWORDS, sentences


@dataclass(frozen=True)
class TextRankOptions:
    damping: float = 0.85
    maxIterations: int = 100
    convergence: float = 1e-4
    minSimilarity: float = 0.1


#: A token of :func:`presswork.functions.text.tokenize`, in lower case and two characters at least.
WORD = r"[a-z0-9_'\-]{2,}"
#: Entries of a block of the weight matrix, and meetings that are summed at a time.
BLOCK = 1 << 22


def weights(tokens: list[list[str]], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directed edges (i, j, weight): tokens of i, repeats counted, that occur in j, over both log lengths.

    Sums over the sentences that share a term, in blocks of bounded size; terms of one
    sentence make no edge and are left out.
    """
    n = len(tokens)
    names: dict[str, int] = {}
    term = np.array([names.setdefault(t, len(names)) for x in tokens for t in x], np.int64)
    sizes = np.array([len(x) for x in tokens], np.int64)
    cell, times = np.unique(np.repeat(np.arange(n), sizes) * max(1, len(names)) + term, return_counts=True)
    row, column = np.divmod(cell, max(1, len(names)))
    common = np.flatnonzero(np.bincount(column, minlength=len(names)) > 1)
    place = np.full(len(names), -1)
    place[common] = np.arange(len(common))
    row, column, times = row[keep := place[column] >= 0], place[column[keep]], times[keep]
    with np.errstate(divide="ignore"):
        logs = np.log(sizes)
    # The sentences of each term stand together; a cell meets all sentences of its term.
    by_term = np.argsort(column, kind="stable")
    sentences_of, many = row[by_term], np.bincount(column, minlength=len(common))
    begin = np.cumsum(many) - many
    found = []
    high = max(1, BLOCK // max(1, n))
    for top in range(0, n, high):
        end = min(n, top + high)
        shared = np.zeros((end - top) * n)
        cells = np.flatnonzero((row >= top) & (row < end))
        ends = np.cumsum(many[column[cells]])
        at = 0
        while at < len(cells):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
            part = cells[at:stop]
            size = many[column[part]]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            other = sentences_of[np.repeat(begin[column[part]], size) + inside]
            shared += np.bincount(np.repeat((row[part] - top) * n, size) + other, np.repeat(times[part], size), minlength=len(shared))
            at = stop
        shared = shared.reshape(end - top, n)
        shared[np.arange(end - top), np.arange(top, end)] = 0
        i, j = np.nonzero(shared)
        norm = logs[i + top] + logs[j]
        w = np.divide(shared[i, j], norm, out=np.zeros(len(i)), where=norm != 0)
        ok = w >= least
        found.append((i[ok] + top, j[ok], w[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def rank(tokens: list[list[str]], options: TextRankOptions) -> list[float]:
    """Scores by synchronous updates from 1; what leaves a sentence without edges is dropped."""
    n = len(tokens)
    if n == 1:
        return [1.0]
    source, target, w = weights(tokens, options.minSimilarity)
    share = w / np.bincount(source, w, minlength=n)[source]
    scores = np.ones(n)
    for _ in range(options.maxIterations):
        new = (1 - options.damping) + options.damping * np.bincount(target, share * scores[source], minlength=n)
        moved = np.abs(new - scores).max(initial=0.0)
        scores = new
        if moved <= options.convergence:
            break
    return scores.tolist()


def textrank(docs: DataFrame, options: TextRankOptions | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, rank, index, sentence, score) of every sentence, best first.

    Scores that agree to nine decimals tie, and ties go by index. Documents are
    independent, so each is one step of a vectorised Python kernel.
    """
    options = options or TextRankOptions()
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    split = docs.select(F.col(key).alias("key"), sentences(F.col(text)).alias("s")).where(F.size("s") > 0)
    # No sentence holds a full stop, so one string has them all; as lists of lists tokens cost more than the ranks.
    ready = split.withColumn("t", F.lower(F.array_join("s", ".")))

    find, stop = re.compile(WORD).findall, frozenset(STOPWORDS)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ranks, places, said, scores = [], [], [], [], []
            begin = 0
            for k, joined in enumerate(b.column("t").to_pylist()):
                got = rank([[w for w in find(x) if w not in stop] for x in joined.split(".")], options)
                order = sorted(range(len(got)), key=lambda i: (-round(got[i], 9), i))
                rows += [k] * len(got)
                ranks += range(1, len(got) + 1)
                places += order
                said += [begin + i for i in order]
                scores += [got[i] for i in order]
                begin += len(got)
            sentence = b.column("s").flatten().take(pa.array(said, pa.int64()))
            columns = [b.column("key").take(pa.array(rows, pa.int32())), pa.array(ranks, pa.int32()), pa.array(places, pa.int32()), sentence, pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "rank", "index", "sentence", "score"])

    return ready.mapInArrow(of, f"key {kind}, rank int, index int, sentence string, score double").withColumnRenamed("key", key)


def summarize(docs: DataFrame, count: int = 3, options: TextRankOptions | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, index, sentence) of the best ``count`` sentences of every document."""
    return textrank(docs, options, text, key).where(F.col("rank") <= count).select(key, "index", "sentence")
