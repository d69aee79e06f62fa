"""Blocks of sparse rows, and the nearest rows between two blocks by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a block, and meetings of entries that are summed at a time.
ENTRIES, MEETINGS = 1 << 20, 1 << 22
#: A term is multiplied as a dense row where more than this part of all pairs of a block meet in it.
DENSE = 1 / 60
PACK = "ids binary, norms binary, terms array<string>, rows binary, codes binary, counts binary"
_SCHEMA = pa.schema([("ids", pa.binary()), ("norms", pa.binary()), ("terms", pa.list_(pa.string())), ("rows", pa.binary()), ("codes", pa.binary()), ("counts", pa.binary())])


def _block(ids: list[int], terms: list[pa.Array], counts: list[np.ndarray]) -> pa.RecordBatch:
    coded = pa.concat_arrays(terms).dictionary_encode()
    sizes = np.array([len(c) for c in counts])
    rows, n = np.repeat(np.arange(len(ids), dtype=np.int32), sizes), np.concatenate(counts)
    squares = np.zeros(len(ids), np.int64)
    np.add.at(squares, rows, n * n)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    one = {"ids": np.array(ids, np.int64).tobytes(), "norms": np.sqrt(squares.astype(np.float64)).tobytes(), "terms": coded.dictionary.to_pylist(), "rows": rows.tobytes(), "codes": codes.tobytes(), "counts": n.tobytes()}
    return pa.RecordBatch.from_pylist([one], _SCHEMA)


def packed(most: int):
    """Rows (id, t, n) of terms and their counts to blocks of up to ``most`` rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, counts, entries = [], [], [], 0
        for b in batches:
            for k, i in enumerate(b.column("id").to_pylist()):
                ids.append(i)
                terms.append(b.column("t")[k].values)
                counts.append(b.column("n")[k].values.to_numpy(zero_copy_only=False).astype(np.int64))
                entries += len(counts[-1])
                if len(ids) >= most or entries >= ENTRIES:
                    yield _block(ids, terms, counts)
                    ids, terms, counts, entries = [], [], [], 0
        if ids:
            yield _block(ids, terms, counts)

    return of


def products(q: tuple[np.ndarray, ...], d: tuple[np.ndarray, ...], nq: int, nd: int, nt: int) -> np.ndarray:
    """All inner products of two sets of sparse rows, each as (rows, codes, counts) over ``nt`` codes; whole numbers, so exact."""
    (qr, qc, qn), (dr, dc, dn) = q, d
    many_q, many_d = np.bincount(qc, minlength=nt), np.bincount(dc, minlength=nt)
    dense = many_q * many_d > DENSE * nq * nd
    place = np.cumsum(dense) - 1
    out = np.zeros((nq, nd))
    names = np.flatnonzero(dense)
    for at in range(0, len(names), 512):
        in_q, in_d = (dense[c] & (place[c] >= at) & (place[c] < at + 512) for c in (qc, dc))
        width = min(512, len(names) - at)
        a, b = np.zeros((nq, width)), np.zeros((width, nd))
        a[qr[in_q], place[qc[in_q]] - at] = qn[in_q]
        b[place[dc[in_d]] - at, dr[in_d]] = dn[in_d]
        out += a @ b
    rest = np.flatnonzero(~dense[qc])
    rest = rest[np.argsort(qc[rest], kind="stable")]
    begin = np.cumsum(np.where(dense, 0, many_q)) - np.where(dense, 0, many_q)
    mine = np.flatnonzero(~dense[dc] & (many_q[dc] > 0))
    ends = np.cumsum(many_q[dc[mine]])
    flat, at = out.reshape(-1), 0
    while at < len(mine):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MEETINGS, "right")))
        part = mine[at:stop]
        size = many_q[dc[part]]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        other = rest[np.repeat(begin[dc[part]], size) + inside]
        flat += np.bincount(qr[other].astype(np.int64) * nd + np.repeat(dr[part], size), qn[other] * np.repeat(dn[part], size), minlength=len(flat))
        at = stop
    return out


def best(score: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the n highest scores of each row above -inf, ties to the smaller id."""
    if score.shape[1] > n:
        least = -np.partition(-score, n - 1, axis=1)[:, n - 1]
    else:
        least = np.full(len(score), -np.inf)
    row, column = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    order = np.lexsort((ids[column], -score[row, column], row))
    row, column = row[order], column[order]
    many = np.bincount(row, minlength=len(score))
    keep = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) < n
    return row[keep], column[keep]


def nearest(n: int):
    """Pairs of blocks (documents and q_ queries) to the n nearest documents of each query."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def get(b: pa.RecordBatch, k: int, name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b.column(name)[k].as_buffer(), kind)

        for b in batches:
            for k in range(b.num_rows):
                ids, q_ids = get(b, k, "ids", np.int64), get(b, k, "q_ids", np.int64)
                d, q = ([get(b, k, p + c, t) for c, t in (("rows", np.int32), ("codes", np.int32), ("counts", np.int64))] for p in ("", "q_"))
                terms = b.column("q_terms")[k].values
                known = pc.fill_null(pc.index_in(b.column("terms")[k].values, value_set=terms), -1).to_numpy(zero_copy_only=False)[d[1]]
                d = (d[0][known >= 0], known[known >= 0], d[2][known >= 0])
                score = products(tuple(q), d, len(q_ids), len(ids), len(terms))
                none = (score == 0) | (q_ids[:, None] == ids[None, :])
                score /= get(b, k, "q_norms", np.float64)[:, None] * get(b, k, "norms", np.float64)[None, :]
                score[none] = -np.inf
                row, column = best(score, ids, n)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids[column]), pa.array(score[row, column])], ["query_id", "id", "score"])

    return of
