"""Language identification by prediction by partial matching.

For every language a byte context tree of variable order is learned: under a context of
up to three bytes, a byte seen there costs its share, any other byte costs an escape and
is coded under the next shorter context, down to a uniform code over all 256 bytes. With
the statistics frozen, each byte's code length depends on its context alone, so the trees
are sorted tables of strings and costs per language, one table per level. A text's
code lengths are sums of table rows, and the language with the shortest code is predicted.

The model is fitted on at most ``per_lang`` texts of a language (those whose hashed ids
are smallest) and on at most the first ``max_bytes`` bytes of each; every text is scored
as a whole. A letter is a character of a Unicode category L.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to
the language first in code point order; without labelled texts all are ``und``; a null
id counts as held out; repeated rows are scored row by row; of the input columns only
the named ones play a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.llm.common import bounded_batches, giving_back

UNKNOWN = "und"
#: Bytes of the longest context.
ORDER = 3
#: Stands for the start of a text in contexts; no UTF-8 text holds this byte.
START = 0xFF


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class ContextTrees:
    """Frozen trees of several languages, as sorted tables over all 256 byte values.

    Level k has a row for every string of k context bytes and a byte that any language
    showed, with the byte's whole cost (escapes included) in each language, and a row for
    every such context with the cost of its escape, 0 where a language lacks the context.
    """

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        if not 1 <= order <= 7:
            raise ValueError("order must be from 1 to 7")
        self.langs, self.order = sorted(texts), order
        n_langs = len(self.langs)
        self.keys: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        streams = [[np.frombuffer(bytes([START] * order) + t, np.uint8) for t in texts[x]] for x in self.langs]
        for k in range(order + 1):
            kind = np.uint32 if k < 4 else np.uint64
            each = [np.unique(np.concatenate([np.zeros(0, kind), *(self._strings(s, k, kind) for s in x)]), return_counts=True) for x in streams]
            # At level 0 every byte has a row, seen or not.
            keys = np.unique(np.concatenate([np.arange(256 if k == 0 else 0, dtype=kind), *(x for x, _ in each)]))
            counts = np.zeros((len(keys), n_langs))
            for j, (x, n) in enumerate(each):
                counts[np.searchsorted(keys, x), j] = n
            context, of = np.unique(keys >> kind(8), return_inverse=True)
            n, kinds = np.zeros((len(context), n_langs)), np.zeros((len(context), n_langs))
            np.add.at(n, of, counts)
            np.add.at(kinds, of, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(n > 0, np.log2(n + kinds) - np.log2(kinds), 0.0)
                seen = np.log2((n + kinds)[of]) - np.log2(counts)
            shorter = np.full((256, n_langs), 8.0) if k == 0 else self.cost[-1][np.searchsorted(self.keys[-1], (keys & kind((1 << 8 * k) - 1)).astype(self.keys[-1].dtype))]
            self.keys.append(keys)
            self.contexts.append(context)
            self.escape.append(escape)
            self.cost.append(np.where(counts > 0, seen, escape[of] + shorter))

    def _strings(self, s: np.ndarray, k: int, kind) -> np.ndarray:
        """Each byte behind its k bytes of context, as one number."""
        n = len(s) - self.order
        out = np.zeros(n, kind)
        for j in range(self.order - k, self.order + 1):
            out = out << kind(8) | s[j : j + n]
        return out

    def code_lengths(self, text: np.ndarray, piece: int = 1 << 17) -> np.ndarray:
        """Bits for the bytes of ``text`` under each language; bounded memory."""
        total = np.zeros(len(self.langs))
        carry = np.full(self.order, START, np.uint8)
        for at in range(0, len(text), piece):
            s = np.concatenate([carry, text[at : at + piece]])
            carry = s[-self.order :]
            string = self._strings(s, self.order, self.keys[-1].dtype.type)
            for k in range(self.order, -1, -1):
                kind = self.keys[k].dtype.type
                string = (string & type(string[0])((1 << 8 * (k + 1)) - 1)).astype(kind)
                rows, found = _rows(self.keys[k], string)
                total += self.cost[k][rows[found]].sum(0)
                string = string[~found]
                if not len(string):
                    break
                rows, found = _rows(self.contexts[k], string >> kind(8))
                total += self.escape[k][rows[found]].sum(0)
        return total

    def predict(self, text: str | None, data: np.ndarray) -> tuple[str, float]:
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        bits = self.code_lengths(data)
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(np.minimum(0, bits[best] - bits)).sum())


def _rows(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value would stand in the sorted table, and whether it is there."""
    rows = np.minimum(np.searchsorted(table, wanted), max(0, len(table) - 1))
    return rows, table[rows] == wanted if len(table) else np.zeros(len(wanted), bool)


def train(docs: DataFrame, per_lang: int = 300, max_bytes: int = 16_384) -> ContextTrees:
    """Trees of a bounded sample of the labelled texts of ``docs`` that are not held out.

    The bound of the sample: ``per_lang`` texts of a language, and of each its first ``max_bytes`` bytes.
    """
    d = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") > 0))
    h = F.xxhash64(F.lit("langid"), F.col("doc_id").cast("string"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    cut = d.select("lang", h.alias("h")).withColumn("n", rank).where(F.col("n") <= per_lang).groupBy("lang").agg(F.max("h").alias("cut")).collect()
    texts: dict[str, list[bytes]] = {r["lang"]: [] for r in cut}
    if texts:
        ends = F.create_map(*[x for r in cut for x in (F.lit(r["lang"]), F.lit(r["cut"]))])
        picked = d.where(h <= F.element_at(ends, F.col("lang"))).select("lang", F.substring(F.col("text").cast("binary"), 1, max_bytes).alias("text"), h.alias("h"))
        ranked = picked.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where(F.col("n") <= per_lang)
        for r in sorted(ranked.collect(), key=lambda r: (r["lang"], r["h"], bytes(r["text"]))):
            texts[r["lang"]].append(bytes(r["text"]))
    return ContextTrees(texts)


def predict_language(docs: DataFrame, trees: ContextTrees, text: str = "text") -> DataFrame:
    """``docs`` without its text, with lang_pred and score; reads nothing but the text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    rest = [f for f in docs.schema.fields if f.name not in (text, "lang_pred", "score")]
    names = [f.name for f in rest]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            column = b.column("__text")
            raw = pc.cast(column, pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
            got = [model.predict(t.as_py(), np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.zeros(0, np.uint8)) for t, x in zip(column, raw, strict=True)]
            made = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made], [*names, "lang_pred", "score"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "lang_pred string", "score double"])
    return docs.select(*(F.col(f"`{c}`") for c in names), F.col(text).alias("__text")).mapInArrow(giving_back(of), fields)
