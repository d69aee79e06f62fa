"""Near-duplicate documents by DartMinHash.

A document is the set of its shingles of five words (a shorter one: of all its words);
with ``weighted=True`` a shingle weighs as often as it occurs. Every shingle owns the
region weight x rank, cut into cells of weight 1. Hashed darts fall into a cell at unit
rate along the rank; only darts below a rank bound of about k ln k + 2k per document are
thrown, and the earliest dart per coordinate is kept, so a signature of k coordinates
costs about one step per shingle. Two coordinates agree with the probability of the
weighted Jaccard similarity.

Equal word sequences are first folded into one representative. Representatives that
agree on a whole band meet in a bucket. Each bucket's most connected member is its
centre, and the others are compared with it. Where members of different groups then still
meet in a bucket, they are compared inside it, pairs of blocks at a time, each pair in the
first bucket that it shares. What is compared is first estimated on the signatures (one
that differs from 0.8 by more than six standard deviations is set aside) and then counted
exactly on the shingles; only members with an open estimate send theirs. Links join into
classes by distributed star rounds.

With 25 bands of 4, a pair at the threshold is missed with a probability of 2e-6, and one
of similarity 0.85 with one of 1e-8.

Defined cases: documents without words (null, empty or blank text) are classes of their
own; a document's class is the smallest id in it; rows with the same id and words are
one document, and rows of one id with other words are documents of their own; rows
without an id take no part and have no class (null); an empty table gives an empty
result; other input columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import bounded_batches, giving_back, join_aggregate, materialise, release
from presswork.llm.components import components

WORDS, BANDS, ROWS = 5, 25, 4
K = BANDS * ROWS
#: Members of a bucket that are compared in one group.
BLOCK = 2048
#: Ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
SLICE = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, SLICE + 1)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, _U(b))
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, occurrences), sorted, of the texts data[offsets[i]:offsets[i+1]]."""
    n, docs = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    power, inverse = _power(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[:n])])
    word = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    of = np.searchsorted(offsets, start, "right") - 1
    m = len(word) - words + 1
    if m > 0:
        h = np.zeros(m, np.uint64)
        for k in range(words):
            h = (h + word[k : k + m]) * _U(_BASE)
        whole = of[:m] == of[words - 1 :]
        doc, h = of[:m][whole], h[whole]
    else:
        doc, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    counts = np.bincount(of, minlength=docs)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])
        extra = []
        for d in short:
            x = 0
            for w in word[first[d] : first[d + 1]].tolist():
                x = (x + w) * _BASE & (1 << 64) - 1
            extra.append(x)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, np.array(extra, np.uint64)])
    h = mix(h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.concatenate([at, [len(h)]]))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def dart_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int = K) -> np.ndarray:
    """Signatures (docs x k) of weighted sets; rows of documents without elements are 0.

    ``weight`` may be fractional: a dart counts if it lies below the weight in its cell.
    """
    out = np.zeros((docs, k), np.uint64)
    total = np.bincount(doc, weight, minlength=docs)
    with np.errstate(divide="ignore"):
        bound = (k * math.log(k) + 2 * k) / total
    todo = np.arange(docs)[total > 0]
    while len(todo):
        picked = np.isin(doc, todo) if len(todo) < docs else np.ones(len(doc), bool)
        d, e, w = doc[picked], element[picked], weight[picked]
        cells = np.ceil(w).astype(np.int64)
        if (cells > 1).any():
            at = np.repeat(np.arange(len(d)), cells)
            cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
            d, e, w = d[at], mix(e[at] + cell.astype(np.uint64) * _U(0xD6E8FEB86659FD93)), w[at] - cell
        partial = bool((w < 1).any())
        rank = np.zeros(len(d))
        found = []
        turn = 0
        while len(d):
            turn = turn + 0xA0761D6478BD642F & (1 << 64) - 1
            h = mix(e + _U(turn))
            rank = rank - np.log(_uniform(h))
            ok = np.flatnonzero(rank <= bound[d])
            d, e, rank, h = d[ok], e[ok], rank[ok], h[ok] * _U(0xE7037ED1A0B428DB)
            if partial:
                w = w[ok]
                inside = np.flatnonzero(_uniform(mix(h)) < w)
                found.append((d[inside], rank[inside], h[inside]))
            else:
                found.append((d, rank, h))
        d, rank, name = (np.concatenate(x) for x in zip(*found, strict=True))
        slot = d * k + ((name >> _U(33)) % _U(k)).astype(np.int64)
        late = np.argsort(-rank)  # the earliest is written last
        sig = np.zeros(docs * k, np.uint64)
        sig[slot[late]] = name[late] | _U(1)
        sig = sig.reshape(docs, k)
        done = (sig[todo] != 0).all(1)
        out[todo[done]] = sig[todo[done]]
        todo = todo[~done]
        bound[todo] *= 1.5
    return out


SKETCH = "doc_id long, mark long, key binary, n int, sig binary, bands array<long>"
_SKETCH = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a text column, about 1 MB of whole texts at a time."""
    a = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    offsets = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if len(a) and a.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        j = min(j, len(a))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _sketched(weighted: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in slices(b.column("text")):
                doc, h, times = shingles(data, offsets)
                sig = dart_minhash(doc, h, times.astype(np.float64) if weighted else np.ones(len(doc)), j - i)
                n = np.bincount(doc, minlength=j - i)
                low = ((sig >> _U(8)) & _U(255)).astype(np.uint8)
                band = np.zeros((j - i, BANDS), np.uint64)
                for r in range(ROWS):
                    band = mix((band + sig[:, r * BANDS : (r + 1) * BANDS]) * _U(_BASE))
                band = mix(band + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)
                raw = data.tobytes()
                keys = [hashlib.blake2b(b" ".join(raw[offsets[r] : offsets[r + 1]].split()), digest_size=16).digest() for r in range(j - i)]
                has = n > 0
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]), pa.int32()), pa.array(band[has].ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), b.column("mark").slice(i, j - i), pa.array(keys, pa.binary()), pa.array(n, pa.int32()), pa.array([x.tobytes() for x in low], pa.binary()), bands],
                    schema=_SKETCH,
                )

    return of


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, offsets in slices(b.column("text")):
            doc, h, times = shingles(data, offsets)
            cut = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=j - i))])
            raw = np.rec.fromarrays([h, times.astype(np.uint32)], dtype=[("h", "<u8"), ("n", "<u4")])
            yield pa.RecordBatch.from_arrays(
                [b.column("rep").slice(i, j - i), pa.array([raw[cut[r] : cut[r + 1]].tobytes() for r in range(j - i)], pa.binary())], ["rep", "shingles"]
            )


def similarity(a: bytes, b: bytes, weighted: bool) -> float:
    """Exact (weighted) Jaccard similarity of two shingle sets."""
    kind = np.dtype([("h", "<u8"), ("n", "<u4")])
    x, y = np.frombuffer(a, kind), np.frombuffer(b, kind)
    _, i, j = np.intersect1d(x["h"], y["h"], assume_unique=True, return_indices=True)
    if weighted:
        both = int(np.minimum(x["n"][i], y["n"][j]).sum())
        return both / max(1, int(x["n"].sum()) + int(y["n"].sum()) - both)
    return len(i) / max(1, len(x) + len(y) - len(i))


def _linked(threshold: float, weighted: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similarity(x.as_py(), y.as_py(), weighted) >= threshold for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return of


def _least(threshold: float) -> float:
    """Six standard deviations below the threshold, as a count of equal signature bytes."""
    return K * (threshold - 6 * math.sqrt(threshold * (1 - threshold) / K))


def _close(threshold: float):
    least = _least(threshold)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, K) for c in ("x", "y"))
                yield b.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least, pa.bool_()))

    return of


class Bucket:
    """Members of one bucket (or of two of its blocks): those of the largest label first."""

    def __init__(self, band: int, own: list, reps: list, labels: list, sizes: list, sigs: list, bands: np.ndarray, threshold: float, weighted: bool):
        _, label, count = np.unique(np.array(labels, np.int64), return_inverse=True, return_counts=True)
        rank = np.argsort(np.argsort(-count, kind="stable"), kind="stable")[label]
        by = self.by = np.argsort(rank, kind="stable")
        self.label = rank[by]
        self.own, self.reps, self.n = (np.array(x, np.int64)[by] for x in (own, reps, sizes))
        self.sigs = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, K)[by]
        self.bands = bands.reshape(-1, BANDS)[by]
        self.at = int((self.bands[0] == band).argmax())
        self.two = len(np.unique(self.own)) > 1
        self.threshold, self.weighted, self.least = threshold, weighted, _least(threshold)
        #: Labels that a link has joined are not compared again.
        self.root = np.arange(len(count))

    def open(self) -> Iterator[tuple[int, np.ndarray]]:
        """(member, earlier members) of different labels and blocks that the estimate leaves open, where this is the first bucket of both."""
        for i in range(int(np.searchsorted(self.label, 1)), len(self.reps)):
            ok = self.root[self.label[:i]] != self.root[self.label[i]]
            if self.two:
                ok &= self.own[:i] != self.own[i]
            if not self.weighted:
                ok &= np.minimum(self.n[:i], self.n[i]) >= self.threshold * np.maximum(self.n[:i], self.n[i])
            ok = np.flatnonzero(ok)
            for k in range(0, len(ok), 4096):
                part = ok[k : k + 4096]
                part = part[(self.sigs[part] == self.sigs[i]).sum(1) >= self.least]
                part = part[(self.bands[part] == self.bands[i]).argmax(1) == self.at]
                if len(part):
                    yield i, part

    def links(self, sets: list[bytes]) -> Iterator[tuple[int, int]]:
        kind = np.dtype([("h", "<u8"), ("n", "<u4")])
        rows = [np.frombuffer(sets[k], kind) for k in self.by.tolist()]
        weight = np.array([len(r) for r in rows], np.int64)
        hashes = [np.ascontiguousarray(r["h"]) for r in rows]
        for i, found in self.open():
            for k in range(0, len(found), 256):
                part = found[k : k + 256]
                part = part[self.root[self.label[part]] != self.root[self.label[i]]]
                if not len(part):
                    continue
                if self.weighted:
                    score = np.array([similarity(rows[j].tobytes(), rows[i].tobytes(), True) for j in part.tolist()])
                else:
                    every = np.concatenate([hashes[j] for j in part.tolist()])
                    ends = np.cumsum(weight[part])
                    at = np.minimum(np.searchsorted(hashes[i], every), len(hashes[i]) - 1)
                    hit = np.concatenate([[0], np.cumsum(hashes[i][at] == every)])
                    both = hit[ends] - hit[ends - weight[part]]
                    score = both / (weight[part] + weight[i] - both)
                for j in part[score >= self.threshold].tolist():
                    x, y = self.root[self.label[i]], self.root[self.label[j]]
                    if x != y:
                        yield int(self.reps[i]), int(self.reps[j])
                        self.root[self.root == y] = x


def _between(threshold: float, weighted: bool, exact: bool):
    """Over groups (band, p, q): the members with an open estimate, or the links among members with shingles."""

    def done(key: tuple, held: list[tuple]) -> pa.RecordBatch:
        own, reps, labels, sizes, sigs, bands, *sets = zip(*held, strict=True)
        bucket = Bucket(key[0], own, reps, labels, sizes, sigs, np.concatenate(bands), threshold, weighted)
        if exact:
            found = list(bucket.links(sets[0]))
        else:
            active = np.zeros(len(reps), bool)
            for i, part in bucket.open():
                active[i] = active[part] = True
            found = [(key[0], r) for r in bucket.reps[active].tolist()]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        names = ["own", "rep", "label", "n", "sig"]
        for b in batches:
            bands = b.column("bands").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
            columns = [b.column(c).to_pylist() for c in names] + [list(bands)] + ([b.column("shingles").to_pylist()] if exact else [])
            for at, row in zip(zip(*(b.column(c).to_pylist() for c in ("band", "p", "q")), strict=True), zip(*columns, strict=True), strict=True):
                if held and at != key:
                    yield done(key, held)
                    held = []
                key = at
                held.append(row)
        if held:
            yield done(key, held)

    return giving_back(of)


class Verifier:
    """Exact comparison of representatives, in two joins."""

    def __init__(self, docs: DataFrame, reps: DataFrame, threshold: float, weighted: bool):
        self.docs, self.reps, self.threshold, self.weighted = docs, reps, threshold, weighted
        self.scratch: list[DataFrame] = []

    def _written(self, df: DataFrame, label: str) -> DataFrame:
        self.scratch.append(materialise(df, label))
        return self.scratch[-1]

    def close(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, x, y with signatures) that the estimate does not rule out."""
        return pairs.mapInArrow(_close(self.threshold), "a long, b long").distinct()

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """(rep, shingles) of the wanted representatives."""
        wanted = self._written(wanted.join(self.reps.select("rep", "doc_id", "mark"), "rep"), "wanted")
        hint = F.broadcast if wanted.count() <= BROADCAST_IDS else lambda x: x
        texts = self.docs.join(hint(wanted), ["doc_id", "mark"]).select("rep", "text")
        return self._written(texts.mapInArrow(giving_back(_sets), "rep long, shingles binary"), "sets").dropDuplicates(["rep"])

    def _dealt(self, members: DataFrame, *columns: str) -> DataFrame:
        """Members of each bucket in blocks; every pair of blocks is a group of its own, so no task holds more than two."""
        blocks = members.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        m = join_aggregate(members, blocks, "band").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        m = m.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).select("band", "p", "q", "own", "rep", "label", "n", "sig", "bands", *columns)
        return m.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")

    def between(self, members: DataFrame) -> DataFrame | None:
        """Links (a, b) between different labels of a bucket, None if no estimate is open; ``members``: band, rep, label."""
        signed = self._written(members.join(self.reps.select("rep", "n", "sig", "bands"), "rep"), "signed")
        if signed.isEmpty():
            return None
        named = self._dealt(signed).mapInArrow(_between(self.threshold, self.weighted, False), "a long, b long")
        active = self._written(named.distinct().select(F.col("a").alias("band"), F.col("b").alias("rep")), "active")
        if active.isEmpty():
            return None
        some = signed.join(active, ["band", "rep"]).join(self._sets(active.select("rep").distinct()), "rep")
        return self._written(self._dealt(some, "shingles").mapInArrow(_between(self.threshold, self.weighted, True), "a long, b long"), "links")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that reach the threshold; a should be the commoner side."""
        pairs = self._written(pairs, "pairs")
        sets = self._sets(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct())
        one = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
        two = one.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
        return self._written(two.select("a", "b", "x", "y").mapInArrow(giving_back(_linked(self.threshold, self.weighted)), "a long, b long"), "links")


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text) of the rows with an id; id and mark name a text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")).where("doc_id is not null")


def _classes(docs: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """(doc_id, mark, rows, class_id, stays) per id and text: the class, and whether this one stands for it.

    Word sequences are the nodes, under a hash of their words; a class stands under the
    smallest id of its members and is represented by that document.
    """
    bounded_batches(docs.sparkSession)
    d = _marked(docs)
    sketch = materialise(d.mapInArrow(giving_back(_sketched(weighted)), SKETCH), "sketch")
    node = F.xxhash64("key").alias("rep")
    one = sketch.groupBy("doc_id", "mark").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.count("*").alias("rows"))
    worded = sketch.where("n > 0").select("doc_id", "mark", node, "n", "sig", "bands")
    first = worded.groupBy("rep").agg(F.min(F.struct("doc_id", "mark")).alias("first")).select("rep", F.col("first.doc_id").alias("doc_id"), F.col("first.mark").alias("mark"))
    reps = materialise(worded.join(first, ["rep", "doc_id", "mark"]).dropDuplicates(["rep"]), "reps")
    member = reps.select("rep", F.explode("bands").alias("band"))
    size = member.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    met = materialise(join_aggregate(member, size, "band"), "members")
    mass = met.groupBy("rep").agg(F.sum("size").alias("mass"))
    member = materialise(met.join(mass, "rep").select("band", "rep", "mass"), "ranked")
    centre = member.groupBy("band").agg(F.max(F.struct("mass", "rep")).alias("c")).select("band", F.col("c.rep").alias("b"))
    sig = reps.select("rep", "sig", "n")
    left, right = (sig.select(F.col("rep").alias(a), F.col("sig").alias(x), F.col("n").alias(f"n{a}")) for a, x in (("a", "x"), ("b", "y")))
    apart = F.least("na", "nb") >= threshold * F.greatest("na", "nb") if not weighted else F.lit(True)

    verifier = Verifier(d, reps, threshold, weighted)
    stars = join_aggregate(member.select("band", F.col("rep").alias("a")), centre, "band").where("a <> b").select("a", "b").distinct()
    stars = stars.join(left, "a").join(right, "b").where(apart).select("a", "b", "x", "y")
    links = verifier.links(verifier.close(stars))
    near = components(links)
    labelled = member.join(near, member["rep"] == near["node"], "left").select("band", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band", F.lit(True).alias("mixed"))
    more = verifier.between(join_aggregate(labelled, mixed, "band").select("band", "rep", "label"))
    group = components(links.union(more)) if more is not None else near
    named = reps.select("rep", "doc_id").join(group, reps["rep"] == group["node"], "left").select("rep", "doc_id", F.coalesce("label", "rep").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = join_aggregate(named, least, "label").select(F.col("rep").alias("node"), "class_id", "label")
    keyed = one.where("n > 0").withColumn("node", F.xxhash64("key")).join(named, "node").select("doc_id", "mark", "rows", "class_id", "label")
    chosen = keyed.groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("__first"))
    stays = (F.col("doc_id") == F.col("__first.doc_id")) & (F.col("mark") == F.col("__first.mark"))
    keyed = join_aggregate(keyed, chosen, "label").select("doc_id", "mark", "rows", "class_id", stays.alias("stays"))
    # Texts without words: one row of each id stays.
    bare = one.where("n = 0")
    bare = bare.join(bare.groupBy(F.col("doc_id").alias("__id")).agg(F.min("mark").alias("__mark")), F.col("doc_id") == F.col("__id"))
    bare = bare.select("doc_id", "mark", "rows", F.col("doc_id").alias("class_id"), (F.col("mark") == F.col("__mark")).alias("stays"))
    out = materialise(keyed.union(bare), "classes")
    release(sketch, reps, met, member, near, *([group] if group is not near else []), *verifier.scratch)
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8, weighted: bool = False) -> DataFrame:
    """doc_id and class_id of every document of ``docs`` (doc_id, text)."""
    found = _classes(docs, threshold, weighted).select("doc_id", "class_id").distinct()
    nameless = docs.where("doc_id is null").select(F.col("doc_id").cast("bigint"), F.lit(None).cast("bigint").alias("class_id"))
    return found.union(nameless)


def deduplicated(docs: DataFrame, threshold: float = 0.8, weighted: bool = False) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id.

    Rows that repeat both id and words are one document, and one of them stays; rows of
    one id with other words are judged each for itself; rows without an id all stay.
    """
    found = _classes(docs, threshold, weighted)
    gone = materialise(found.where(~F.col("stays")).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")), "gone")
    again = materialise(found.where(F.col("stays") & (F.col("rows") > 1)).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")), "again")
    release(found)
    counts = [x.count() for x in (gone, again)]
    some = [F.broadcast(x) if n <= BROADCAST_IDS else x for x, n in zip((gone, again), counts, strict=True)]
    here = (F.col("doc_id").cast("bigint") == F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__mark"))
    kept = docs.join(some[0], here, "left_anti").select(*docs.columns)
    if not counts[1]:
        return kept
    # Only the texts of rows that stay and repeat are shuffled.
    once = kept.join(some[1], here, "left_anti").select(*docs.columns)
    twice = kept.join(some[1], here, "left_semi").select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("__mark"), F.struct(*docs.columns).alias("row"))
    return once.union(twice.groupBy("doc_id", "__mark").agg(F.first("row").alias("row")).select("row.*"))
