"""SentencePiece encoding and decoding by a streaming Viterbi search.

The pieces come from a public model file that the driver reads and broadcasts (some
32,000 strings). For a unigram model the pieces' own scores are log probabilities; the
file at hand was made by pair merging and has ranks instead, which are read as a Zipf
law: log p = -ln(rank) up to a constant. Log probabilities become whole costs of 1/64, so
that sums are exact; the segmentation with the smallest sum is the best, and of equal ones
that with the longest last piece.

``Stream`` takes a text in any chunks. A position is final once the longest piece behind
it is known, so the paths that can still win end in the next ``max_piece`` positions; as
soon as all of them share a boundary, the ids before it are committed and forgotten.

Where two neighbouring characters belong to families of characters that meet in no piece
(letters, digits, punctuation), all paths share the boundary between them whatever
surrounds it. Windows between two such boundaries
(mostly words) are kept with their ids in a table of bounded size; what is not there goes
through the stream.

Normalisation follows the file: a space in front, spaces written as U+2581, nothing
removed. A character outside the vocabulary becomes its UTF-8 bytes; so does U+2581
itself, so that decoding gives back every text exactly.

Defined cases: a null text is empty; an empty text has no ids; repeated rows are encoded
row by row; an empty table gives an empty result; computed columns replace input columns
of the same name.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from presswork.llm.common import bounded_batches, giving_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Costs are in this part of a natural logarithm.
UNIT = 64
#: Above the highest cost, for a character outside the vocabulary.
UNKNOWN_PENALTY = 10 * UNIT
#: Characters that are cut into a list of stretches at once.
WHOLE = 1 << 16
#: Characters that a stream takes at a time, and bytes that the windows of a task may keep.
CHUNK = 1 << 10
CACHE_BYTES = 64 << 20
FAR = 1 << 40
_NOTHING: tuple[dict, int] = ({}, FAR)


class Vocabulary:
    def __init__(self, pieces: list[tuple[str, int]], byte_ids: list[int], first_normal: list[int], names: list[str]):
        self.ids = dict(zip([p for p, _ in pieces], first_normal, strict=True))
        self.cost = dict(pieces)
        self.byte_ids = byte_ids
        self.max_piece = max((len(p) for p in self.cost), default=1)
        if self.max_piece > 255:
            raise ValueError("pieces of more than 255 characters")
        self.unknown = max(self.cost.values(), default=0) + UNKNOWN_PENALTY
        self.bytes_of = [n.encode() for n in names]
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])
        pairs = {(p[i], p[i + 1]) for p in self.cost for i in range(len(p) - 1)}
        #: Spaces begin pieces only, so a boundary stands before each run of them.
        self.spaces_lead = not any(b == SPACE and a != SPACE for a, b in pairs)
        #: Characters that hang together by standing next to each other in pieces.
        self.families = _families((a, b) for a, b in pairs if SPACE not in (a, b))

    @cached_property
    def trie(self) -> dict[str, tuple]:
        """By character: (what may follow, cost of the piece that ends here, or FAR)."""
        top: dict[str, tuple] = {}
        for piece, cost in sorted(self.cost.items()):
            level = top
            for k, c in enumerate(piece, 1):
                at = level.get(c)
                if at is None or k == len(piece):
                    at = level[c] = (at[0] if at else {}, cost if k == len(piece) else FAR)
                level = at[0]
        return top

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Read a model file with the public library; on the driver only."""
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        own = [sp.get_score(i) for i in normal]
        ranked = all(s == int(s) for s in own)
        harmonic = math.log(sum(1 / (k + 1) for k in range(len(normal)))) if normal else 0.0
        scores = [-math.log(k + 1) - harmonic for k in range(len(normal))] if ranked else own
        costs = [round(-UNIT * x) for x in scores]
        for i in range(n):
            if i not in byte_ids and (sp.is_control(i) or sp.is_unknown(i)):
                names[i] = ""
        return cls([(names[i], s) for i, s in zip(normal, costs, strict=True)], byte_ids, normal, names)

    def pattern(self) -> re.Pattern:
        """Stretches between which every path has a boundary: runs of one family, with the spaces before them."""
        if not self.spaces_lead:
            return re.compile(r".+", re.S)
        runs = [f"[{''.join(map(re.escape, x))}]+" for x in self.families]
        return re.compile(f"{SPACE}*(?:{'|'.join([*runs, f'[^{SPACE}]'])})|{SPACE}+", re.S)


def _families(pairs: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Connected groups of two characters or more, the largest first."""
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    groups: dict[str, list[str]] = {}
    for c in sorted(root):
        groups.setdefault(find(c), []).append(c)
    return sorted(groups.values(), key=lambda g: (-len(g), g))


class Stream:
    """Viterbi search over a text that arrives in chunks; ``out`` gets the committed ids.

    A position is expanded once ``max_piece`` characters behind it are known. What lies
    ahead of the expanded ones is then at most ``max_piece`` positions, each with its best
    path so far; where all these paths share a boundary, the pieces before it are final.

    Costs are kept for that window only. Of an expanded position that is not committed,
    one byte stays: the length of the best path's last piece.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        #: The most positions that were ever expanded and not yet committed.
        self.longest = 0
        self._start()

    def _start(self) -> None:
        self.out = array("i")
        #: What is not committed yet, and by position the length of its last piece.
        self.text = ""
        self.back = bytearray(1)
        #: Best costs from position ``done`` on; all before it are expanded.
        self.best: list[int] = [0]
        self.done = 0
        #: The paths are next compared when so many positions are expanded.
        self.due = 0

    def feed(self, chunk: str) -> None:
        for k in range(0, len(chunk), CHUNK):
            part = chunk[k : k + CHUNK]
            self.text += part
            self.best += [FAR] * len(part)
            self.back += bytes(len(part))
            while len(self.text) - self.done >= 2 * self.v.max_piece:
                self._expand(self.done + self.v.max_piece)
                self._commit()

    def _expand(self, until: int) -> None:
        """Relax every piece that begins before ``until``; of equal sums the longest last piece stays."""
        text, best, back, size, start = self.text, self.best, self.back, len(self.text), self.done
        top, unknown = self.v.trie, self.v.unknown
        for i in range(start, until):
            here, k = best[i - start], i + 1
            level, cost = top.get(text[i], _NOTHING)
            if cost == FAR:  # a character without a piece of its own
                cost = unknown
            while True:
                if here + cost < best[k - start]:
                    best[k - start], back[k] = here + cost, k - i
                if k == size:
                    break
                at = level.get(text[k])
                if at is None:
                    break
                level, cost = at
                k += 1
        del best[: until - start]
        self.done = until

    def _commit(self) -> None:
        """Take the pieces before the last boundary that all surviving paths share."""
        back, n = self.back, self.done
        self.longest = max(self.longest, n)
        if n < self.due:
            return
        paths = {n + k for k in range(min(len(self.best), self.v.max_piece)) if self.best[k] < FAR}
        while len(paths) > 1:
            k = max(paths)
            paths.remove(k)
            paths.add(k - back[k])
        at = paths.pop()
        # Paths that share nothing yet are compared again at twice the length, so comparing stays linear.
        self.due = 0 if at else 2 * n
        if at:
            self._emit(at)
            self.text, self.done = self.text[at:], n - at
            del back[:at]

    def _emit(self, at: int) -> None:
        ends = []
        while at:
            ends.append(at)
            at -= self.back[at]
        ids, text, i = self.v.ids, self.text, 0
        for k in reversed(ends):
            piece = text[i:k]
            name = ids.get(piece)
            if name is None:
                self.out.extend(self.v.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))
            else:
                self.out.append(name)
            i = k

    def close(self) -> array:
        """All ids; the text ends here, and the stream may take a new one."""
        while self.done < len(self.text):
            self._expand(min(len(self.text), self.done + self.v.max_piece))
            if self.done < len(self.text):
                self._commit()
        self._emit(len(self.text))
        out = self.out
        self._start()
        return out


class Windows(dict):
    """Ids (bytes of 32-bit integers) of the stretches between certain boundaries.

    A stretch that is not there is searched by the stream. Two generations of at most
    ``CACHE_BYTES`` together are kept, so what occurs often stays.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.stream = Stream(vocabulary)
        self.old: dict[str, bytes] = {}
        self.size = 0
        #: The empty stretch stands for a U+2581 of the text itself.
        self.mark = array("i", [vocabulary.byte_ids[b] for b in SPACE.encode()]).tobytes()

    def __missing__(self, stretch: str) -> bytes:
        ids = self.old.get(stretch)
        if ids is None:
            if stretch:
                self.stream.feed(stretch)
                ids = self.stream.close().tobytes()
            else:
                ids = self.mark
        # Two objects and a slot; a character takes up to four bytes.
        self.size += 200 + 4 * len(stretch) + len(ids)
        if self.size > CACHE_BYTES // 2:
            self.old = dict(self)
            self.clear()
            self.size = 0
        self[stretch] = ids
        return ids


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pattern = vocabulary.pattern()
        self.windows = Windows(vocabulary)

    def _stretches(self, text: str) -> Iterator[str]:
        if not text:
            return
        for k, part in enumerate(text.split(SPACE)):
            if k:
                yield ""
                part = part.replace(" ", SPACE)
            else:
                part = SPACE + part.replace(" ", SPACE)
            if len(part) <= WHOLE:
                yield from self.pattern.findall(part)
            else:  # a match at a time, so a long text is no list of its stretches
                yield from (m[0] for m in self.pattern.finditer(part))

    def encode(self, text: str) -> bytes:
        """Ids of a text, as the bytes of 32-bit integers."""
        of, stretches, out = self.windows.__getitem__, self._stretches(text), []
        while part := b"".join(map(of, itertools.islice(stretches, 4096))):
            out.append(part)
        return b"".join(out)

    def decode(self, ids: array) -> str:
        """The text that was encoded: bytes U+2581 of a piece are spaces, those of byte ids are not."""
        if not ids:
            return ""
        plain = self.__dict__.get("_plain")
        if plain is None:
            of_bytes = set(self.v.byte_ids)
            plain = self._plain = [b if i in of_bytes else b.replace(SPACE.encode(), b" ") for i, b in enumerate(self.v.bytes_of)]
        return b"".join(map(plain.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def encode_texts(docs: DataFrame, text: str = "text", model: str = MODEL, keep_text: bool = False) -> DataFrame:
    """``docs`` with ids, n_tokens, ids_sha256 and round_trip (decoding gives the text)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    made = ("ids", "n_tokens", "ids_sha256", "round_trip")
    rest = [f for f in docs.schema.fields if f.name not in made and (keep_text or f.name != text)]
    names = [f.name for f in rest]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            column = b.column(b.num_columns - 1)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            group = (np.cumsum(sizes, dtype=np.int64) // (1 << 20)).tolist()  # about 1 MB of text at a time
            for start, end in itertools.pairwise([0, *(k for k in range(1, b.num_rows) if group[k] != group[k - 1]), b.num_rows]):
                texts = [x or "" for x in column.slice(start, end - start).to_pylist()]
                rows = [encoder.encode(t) for t in texts]
                n, sums, same = [len(x) // 4 for x in rows], [hashlib.sha256(x).hexdigest() for x in rows], []
                for t, x in zip(texts, rows, strict=True):
                    ids = array("i")
                    ids.frombytes(x)
                    same.append(encoder.decode(ids) == t)
                ends = list(itertools.accumulate(n, initial=0))
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(rows))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                part = b.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(len(names))), lists, pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(same, pa.bool_())], [*names, *made]
                )

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "ids array<int>, n_tokens long, ids_sha256 string, round_trip boolean"])
    return docs.select(*(docs[f"`{c}`"] for c in names), docs[text].alias("__text")).mapInArrow(giving_back(of), fields)
