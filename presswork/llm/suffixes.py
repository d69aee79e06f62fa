"""Exact removal of repeated byte strings by a distributed merge of sorted suffix runs.

A byte goes if a string of ``length`` bytes over it also starts anywhere else, in another
document or in the same one.

*Sampled suffixes.* Every string of ``length`` bytes names one of its positions, its
anchor: where the smallest hashed 16 bytes stand. The anchor depends on the string alone,
so equal strings are anchored alike, and only suffixes at anchors need sorting (one in
some 190 positions). An anchor owns a run of string starts.

*Distinguishing prefixes.* A string reaches at least half its length to one side of its
anchor. Hashes of both halves are counted by a partial aggregate, and a join keeps the
anchors whose halves occur again; what occurs once is never exchanged. A hash that
collides costs work, not correctness. Only the places of those anchors go on, and texts
meet them in one join.

*Runs.* An entry is a suffix that begins with a repeated half, read away from the anchor
(to the right, or reversed to the left), with the bytes on the other side as payload. Each
task sorts its entries, folds equal ones (which are repeats already) and writes
front-coded runs per bucket of the half. A bucket's runs meet in a loser tree that keeps
the common prefix with the last output for every run and compares only behind it; it
yields the sorted entries with their common prefixes.

*Repeats.* Entries with a common half form a group. Two of them share the string with q
bytes on the first side if they agree on q bytes there and on length - q on the other;
both follow from the common prefixes of the two sorted orders.

*Hot groups.* Halves that occur more than ``HOT_ENTRIES`` times (a passage that very many
documents share, in whatever surroundings) would fill one task. Their entries are folded
in each task, and the strings of what is left are named by 128-bit digests and counted by
a partial aggregate: one row per task and string, however many documents hold it.

Defined cases: null text is empty; rows with equal id and text are two copies of a text,
so all their strings repeat; invalid UTF-8 after a cut loses the broken characters in
the text that ``deduplicated`` returns; an empty table gives an empty result; of the
input columns only id and text play a part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import bounded_batches, giving_back, materialise, release
from presswork.llm.neardup import _BYTES, _power, mix

GRAM = 16
PIECE = 1 << 20
#: Bytes of entries that a task holds before it writes its runs.
HELD = 16 << 20
#: Entries per bucket of the merge.
BUCKET_ENTRIES = 20_000
#: Half strings that occur more often than this take the way for hot groups.
HOT_ENTRIES = 4096
#: A place packs an anchor's offset, how far before it strings start (first, last), and flags.
RIGHT, HOT, REACH = 1, 2, (1 << 15) - 1
_U = np.uint64


def pieces(keys: list, column: pa.Array, length: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, base offsets, bytes, offsets) of about a megabyte of text at a time.

    A longer text comes in pieces that overlap by length - 1, so that every string lies
    in one piece.
    """
    group: tuple[list, list, list] = ([], [], [])
    held = 0

    def out():
        lengths = [len(x) for x in group[2]]
        return group[0], np.array(group[1], np.int64), np.frombuffer(b"".join(group[2]), np.uint8), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)

    for key, x in zip(keys, column, strict=True):
        b = x.as_py() if x.is_valid else b""
        for at in range(0, max(1, len(b) - length + 1), PIECE):
            part = b[at : at + PIECE + length - 1]
            if len(part) < length:
                continue
            for have, new in zip(group, (key, at, part), strict=True):
                have.append(new)
            held += len(part)
            if held >= PIECE:
                yield out()
                group, held = ([], [], []), 0
    if group[0]:
        yield out()


class Anchors:
    """Anchors of all strings of the pieces in one buffer.

    ``at``, ``low``, ``high``: position, and first and last start of the strings it anchors;
    ``piece``: which piece; ``gram``: hash of the 16 bytes there.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.length = length
        n, w = len(data), length - GRAM + 1
        self.power, self.inverse = _power(n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * self.power[:n])])
        gram = mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.inverse[: n - GRAM + 1])
        key = (gram >> _U(31) << _U(31)) | np.arange(len(gram), dtype=np.uint64)
        rows = -(-len(key) // w)
        block = np.full(rows * w, _U((1 << 64) - 1))
        block[: len(key)] = key
        block = block.reshape(rows, w)
        after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        before = np.minimum.accumulate(block, axis=1).ravel()
        starts = n - length + 1
        least = np.minimum(after[:starts], before[w - 1 : w - 1 + starts])
        valid = np.zeros(n + 1, np.int8)
        np.add.at(valid, offsets[:-1], 1)
        np.add.at(valid, offsets[1:] - length + 1, -1)
        start = np.flatnonzero(np.cumsum(valid[:starts], dtype=np.int8))
        at = (least[start] & _U((1 << 31) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
        self.at, self.low = at[new], start[new]
        self.high = start[np.concatenate([new[1:], [len(start)]]) - 1]
        self.piece = np.searchsorted(offsets, self.low, "right") - 1
        self.gram = gram[self.at]

    def _hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.inverse[begin])

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which anchors, hash to the left), (which anchors, hash to the right)."""
        half = (self.length - GRAM) // 2
        left = np.flatnonzero(self.at - self.low >= half)
        right = np.flatnonzero(self.at - self.high < half)
        to_left = self._hash(self.at[left] - half, self.at[left] + GRAM)
        to_right = self._hash(self.at[right], self.at[right] + self.length - half) ^ _U(0x5851F42D4C957F2D)
        return left, to_left, right, to_right


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, check, text as bytes): key and check name a row's id and text in 96 bits."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*row_key(F.col("doc_id").cast("bigint"), t), t.cast("binary").alias("text"))


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(doc_id, text).alias("key"), F.hash(doc_id, text).alias("check")


def _anchored(length: int):
    """Hashes of the halves of all anchors: (h, key, place)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, base, data, offsets in pieces(b.column("key").to_pylist(), b.column("text"), length):
                a = Anchors(data, offsets, length)
                left, x, right, y = a.halves()
                own, at = np.array(keys, np.int64)[a.piece], a.at - offsets[a.piece] + base[a.piece]
                place = at << 33 | (a.at - a.low) << 18 | (a.at - a.high) << 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x, y]).view(np.int64)), pa.array(np.concatenate([own[left], own[right]])), pa.array(np.concatenate([place[left], place[right] | RIGHT]))],
                    ["h", "key", "place"],
                )

    return of


def common(a: bytes, b: bytes, h: int = 0) -> int:
    """Length of the common prefix of two strings that share ``h`` bytes."""
    n = min(len(a), len(b))
    if a[h:n] == b[h:n]:
        return n
    while a[h : h + 32] == b[h : h + 32]:
        h += 32
    x, y = a[h : h + 32], b[h : h + 32]
    m = min(len(x), len(y))
    differ = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
    return h + m - (differ.bit_length() + 7) // 8


def front_coded(entries: list[tuple[bytes, bytes, int, int, int, bool]]) -> bytes:
    """A sorted run: per entry the bytes behind the common prefix with its predecessor."""
    shared, last = [], b""
    for e in entries:
        shared.append(common(last, e[0]))
        last = e[0]
    n = len(entries)
    table = np.zeros((n, 4), np.int32)
    table[:, 0] = shared
    table[:, 1] = [len(e[0]) for e in entries]
    table[:, 2] = [len(e[1]) for e in entries]
    table[:, 3] = [e[5] for e in entries]
    ids = np.array([e[2:5] for e in entries], np.int64)
    text = b"".join([e[0][k:] for e, k in zip(entries, shared, strict=True)] + [e[1] for e in entries])
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<i", n) + table.tobytes() + ids.tobytes() + text)


def read_run(blob: bytes) -> Iterator[tuple[bytes, int, tuple[bytes, int, int, int, bool]]]:
    """(suffix, common prefix with the one before, (left, id, mark, at, folded)) of a run."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<i", data)[0]
    table = np.frombuffer(data, np.int32, 4 * n, 4).reshape(n, 4).tolist()
    ids = np.frombuffer(data, np.int64, 3 * n, 4 + 16 * n).reshape(n, 3).tolist()
    right = 4 + 40 * n
    left = right + sum(t[1] - t[0] for t in table)
    last = b""
    for (shared, size, before, folded), (i, m, at) in zip(table, ids, strict=True):
        last = last[:shared] + data[right : right + size - shared]
        right += size - shared
        yield last, shared, (data[left : left + before], i, m, at, bool(folded))
        left += before


def merged(runs: list) -> Iterator[tuple[bytes, int, tuple]]:
    """Merge sorted runs of (string, common prefix with predecessor, payload).

    A loser tree; every run keeps its head's common prefix with the last output. Of two
    heads the one with more in common is smaller, and only heads with equally much in
    common are compared, behind what they share.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [next(r, None) for r in runs] + [None] * (k - len(runs))
    have = [0] * k
    losers = [0] * k

    def beats(x: int, y: int) -> bool:
        a, b = heads[x], heads[y]
        if b is None:
            return True
        if a is None:
            return False
        if have[x] != have[y]:
            return have[x] > have[y]
        h = common(a[0], b[0], have[x])
        smaller = a[0][h : h + 1] <= b[0][h : h + 1]
        have[y if smaller else x] = h
        return smaller

    def play(node: int) -> int:
        if node >= k:
            return node - k
        x, y = play(2 * node), play(2 * node + 1)
        if beats(x, y):
            losers[node] = y
            return x
        losers[node] = x
        return y

    champion = play(1) if k > 1 else 0
    while heads[champion] is not None:
        text, _, payload = heads[champion]
        yield text, have[champion], payload
        heads[champion] = got = next(runs[champion], None)
        have[champion] = got[1] if got else 0
        node = (champion + k) // 2
        while node:
            if not beats(champion, losers[node]):
                champion, losers[node] = losers[node], champion
            node //= 2


_RUN = pa.schema([
    ("bucket", pa.int64()), ("run", pa.binary()), ("s1", pa.int64()), ("s2", pa.int64()), ("key", pa.int64()), ("check", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
])
RUN = "bucket long, run binary, s1 long, s2 long, key long, check int, start long, end long"


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _RUN], schema=_RUN)


def _runs(length: int, buckets: int):
    """Front-coded runs per bucket, spans that repeat within the task, strings of hot groups."""
    half = (length - GRAM) // 2
    need = (half + GRAM, length - half)

    def spans(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            yield _rows(**dict(zip(("key", "check", "start", "end"), zip(*found, strict=True), strict=True)))

    def written(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for bucket, entries in held.items():
            entries.sort(key=lambda e: e[:2])
            kept, found, k = [], [], 0
            while k < len(entries):
                j = k + 1
                while j < len(entries) and entries[j][:2] == entries[k][:2]:
                    j += 1
                kept.append((*entries[k], j > k + 1))
                if j > k + 1:
                    found += [(e[2], e[3], *_span(bucket & 1, e[4], len(e[0]), length - len(e[1]), length)) for e in entries[k:j]]
                k = j
            yield _rows(bucket=[bucket], run=[front_coded(kept)])
            yield from spans(found)

    def spelled(hot: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        """A string of several owners repeats; one of them stands for it elsewhere too."""
        found = [(k, c, s, s + length) for owners in hot.values() if len(owners) > 1 for k, c, s in owners]
        yield from spans(found)
        if hot:
            names = np.frombuffer(b"".join(hot), np.int64).reshape(-1, 2)
            key, check, start = zip(*(owners[0] for owners in hot.values()), strict=True)
            yield _rows(s1=names[:, 0], s2=names[:, 1], key=key, check=check, start=start, end=[x + length for x in start])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        hot: dict[bytes, list] = {}
        seen: dict[tuple, list] = {}
        size = strings = 0
        for b in batches:
            for key, check, text, places in zip(b.column("key").to_pylist(), b.column("check").to_pylist(), b.column("text"), b.column("places"), strict=True):
                raw = text.as_py()
                for place in places.values.to_pylist():
                    at, low, high, side = place >> 33, place >> 18 & REACH, place >> 3 & REACH, place & RIGHT
                    low, high = at - low, at - high
                    if side:
                        low = max(low, at - half + 1)
                        first, second = raw[at : high + length], raw[low:at][::-1]
                    else:
                        high = min(high, at - half)
                        first, second = raw[low : at + GRAM][::-1], raw[at + GRAM : high + length]
                    if place & HOT:
                        owners = seen.setdefault((side, first, second), [])
                        owners.append((key, check, low))
                        if len(owners) == 1:  # equal ones share their strings
                            for s in range(low, high + 1):
                                name = hashlib.blake2b(raw[s : s + length], digest_size=16).digest()
                                hot.setdefault(name, []).append((key, check, s))
                            strings += high + 1 - low
                    else:
                        held.setdefault(zlib.crc32(first[: need[side]]) % buckets * 2 + side, []).append((first, second, key, check, at))
                    size += len(first) + len(second)
                if size >= HELD or strings >= HELD >> 7:
                    yield from written(held)
                    yield from spans([(k, c, s, s + len(x[1]) + len(x[2])) for x, owners in seen.items() if len(owners) > 1 for k, c, s in owners])
                    yield from spelled(hot)
                    held, hot, seen, size, strings = {}, {}, {}, 0, 0
        yield from written(held)
        yield from spans([(k, c, s, s + len(x[1]) + len(x[2])) for x, owners in seen.items() if len(owners) > 1 for k, c, s in owners])
        yield from spelled(hot)

    return of


def _span(side: int, at: int, most: int, least: int, length: int) -> tuple[int, int]:
    """What the strings with ``least`` to ``most`` bytes on the first side of their anchor cover."""
    if side:
        return at - (length - least), at + most
    return at + GRAM - most, at + GRAM + length - least


def group_spans(group: list[tuple[bytes, int, tuple]], length: int, side: int) -> Iterator[tuple[int, int, int, int]]:
    """(key, check, start, end) of what repeats among entries of one half.

    ``group`` is in sorted order, each with its common prefix with the one before. Two
    entries share the string with q bytes on the first side if they agree on q bytes
    there and on length - q on the other. What covers an anchor is one span, so it is
    given by the smallest and the largest q at which another entry agrees; these lie
    among the common prefixes themselves.
    """
    n = len(group)
    if n == 1:
        return
    half = (length - GRAM) // 2
    need = length - half + 1 if side else half + GRAM
    if n == 2:
        most, x, y = group[1][1], group[0][2], group[1][2]
        least = max(need, length - common(x[0], y[0]))
        if least <= most:
            for _, key, check, at, folded in (x, y):
                if not folded:
                    yield key, check, *_span(side, at, most, least, length)
        return
    first = np.array([0] + [g[1] for g in group[1:]], np.int64)
    others = [g[2][0] for g in group]
    order = sorted(range(n), key=others.__getitem__)
    second = np.array([0] + [common(others[a], others[b]) for a, b in zip(order, order[1:], strict=False)], np.int64)
    qs = np.unique(np.concatenate([first[1:], length - second[1:], [need]]))
    qs = qs[(qs >= need) & (qs <= length)]
    least, most = np.full(n, length + 1), np.full(n, -1)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    step = max(1, (1 << 19) // n)
    for k in range(0, len(qs), step):
        q = qs[k : k + step, None]
        by_first = np.cumsum(first[None, :] < q, axis=1)
        by_second = np.cumsum(second[None, :] < length - q, axis=1)[:, place]
        name = by_first * (n + 1) + by_second
        at = np.argsort(name, axis=1, kind="stable")
        name = np.take_along_axis(name, at, 1)
        equal = name[:, 1:] == name[:, :-1]
        same = np.zeros(name.shape, bool)
        same[:, 1:] |= equal
        same[:, :-1] |= equal
        row, col = np.nonzero(same)
        who, value = at[row, col], q[row, 0]
        np.minimum.at(least, who, value)
        np.maximum.at(most, who, value)
    for k in np.flatnonzero(most >= 0).tolist():
        _, key, check, at, folded = group[k][2]
        if not folded:
            yield key, check, *_span(side, at, int(most[k]), int(least[k]), length)


def _merge(length: int):
    half = (length - GRAM) // 2
    need = (half + GRAM, length - half)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "check", "start", "end"])

    def merge(bucket: int, runs: list[bytes]) -> Iterator[pa.RecordBatch]:
        side = bucket & 1
        out: list[tuple] = []
        group: list = []
        for entry in merged([read_run(r) for r in runs]):
            if group and entry[1] < need[side]:
                out += group_spans(group, length, side)
                group = []
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
            group.append(entry)
        out += group_spans(group, length, side) if group else []
        yield batch(out)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            for k, run in zip(b.column("bucket").to_pylist(), b.column("run").to_pylist(), strict=True):
                if key is not None and k != key:
                    yield from merge(key, held)
                    held = []
                key = k
                held.append(run)
        if held:
            yield from merge(key, held)

    return of


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(key, check, spans): byte spans to remove by ``row_key``; spans of a text may overlap."""
    if not 2 * GRAM <= length < 1 << 15:
        raise ValueError("length must be from 32 to 32767")
    bounded_batches(docs.sparkSession)
    texts = _keyed(docs).where(F.octet_length("text") >= length)
    anchors = materialise(texts.select("key", "text").mapInArrow(giving_back(_anchored(length)), "h long, key long, place long"), "anchors")
    counted = materialise(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "halves")  # written, so that the engine can split hot halves in the join
    place = F.col("place").bitwiseOR(F.when(F.col("n") > HOT_ENTRIES, F.lit(HOT)).otherwise(F.lit(0)).cast("bigint"))
    met = anchors.hint("merge").join(counted, "h").groupBy("key").agg(F.collect_set(place).alias("places"))
    places = materialise(met, "places")
    entries = places.agg(F.sum(F.size("places"))).collect()[0][0] or 0
    buckets = max(4, entries // BUCKET_ENTRIES)
    held = texts.hint("merge").join(places, "key").select("key", "check", "text", "places")
    runs = materialise(held.mapInArrow(giving_back(_runs(length, buckets)), RUN), "runs")
    dealt = runs.where("bucket is not null").select("bucket", "run").repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(giving_back(_merge(length)), "key long, check int, start long, end long")
    strings = runs.where("s1 is not null")
    again = materialise(strings.groupBy("s1", "s2").agg(F.count("*").alias("n")).where("n > 1").select("s1", "s2"), "strings")
    found = found.union(strings.hint("merge").join(again, ["s1", "s2"]).select("key", "check", "start", "end"))
    found = found.union(runs.where("bucket is null and s1 is null").select("key", "check", "start", "end"))
    spans = materialise(found.groupBy("key", "check").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    release(anchors, counted, places, runs, again)
    return spans


_MADE = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
MADE = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _united(names: list[str], text: bool):
    """Cut the united spans out of each text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, removed, spans, digests, kept = [], [], [], [], []
            for t, s in zip(b.column("__text"), b.column("__spans").to_pylist(), strict=True):
                data = t.as_py()
                out, at, gone, count = [], 0, 0, 0
                end = -1
                for x in sorted((x["start"], x["end"]) for x in s or ()):
                    if x[0] > end:
                        count += 1
                        out.append(data[at : x[0]])
                        gone += x[1] - x[0]
                        end = at = x[1]
                    elif x[1] > end:
                        gone += x[1] - end
                        end = at = x[1]
                out.append(data[at:])
                rest = b"".join(out)
                n_bytes.append(len(data))
                removed.append(gone)
                spans.append(count)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "ignore") if text else None)
            made = [pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made], [*names, *_MADE])

    return of


def without_repeats(docs: DataFrame, length: int = 400, text: bool = False) -> DataFrame:
    """``docs`` without its text, with n_bytes, n_removed, n_spans and kept_sha256 of every row.

    ``text`` adds what is left as kept_text. Computed columns replace input columns of the
    same name.
    """
    spans = repeated_spans(docs, length).select(F.col("key").alias("__key"), F.col("check").alias("__check"), F.col("spans").alias("__spans"))
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = [f for f in docs.schema.fields if f.name not in ("text", *_MADE)]
    names = [f.name for f in rest]
    key, check = row_key(F.col("doc_id").cast("bigint"), t)
    marked = docs.select(*(docs[f"`{c}`"] for c in names), t.cast("binary").alias("__text"), key.alias("__key"), check.alias("__check"))
    # One plan at every size: the texts are shuffled once, whatever the number of spans.
    joined = marked.hint("merge").join(spans, ["__key", "__check"], "left").select(*(f"`{c}`" for c in names), "__text", "__spans")
    return joined.mapInArrow(giving_back(_united(names, text)), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), MADE]))


def deduplicated(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` with the repeated strings cut out of every text."""
    out = without_repeats(docs, length, text=True).withColumn("text", F.col("kept_text"))
    return out.select(*docs.columns)
