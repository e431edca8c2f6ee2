"""Counting quotient filters over packed word-id n-grams: exact counters in sorted, compact form.

An n-gram of `k` word ids of `id_bytes` bytes each is one number of `k * id_bytes` bytes. A permutation of all such numbers,
which can be undone, spreads n-grams evenly; the top bytes of the permuted number are the quotient, everything below is the
remainder, and the remainder is kept in full. So two n-grams never share a counter, and each n-gram comes back from its place.

A filter holds its entries by (quotient, remainder). A bitmap flags the quotients that occur, one bit per entry ends the run
of its quotient, remainders stand behind each other, one bit per entry tells counts above one, and only those are
written out. Since entries are sorted by the permuted number, filters of several shards are merged like sorted lists, and a
filter is cut into buckets of consecutive quotients by cutting its arrays. `Layout.filters` writes the filters of all
groups and buckets in one pass; `Layout.entries` reads any number of them at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from talkspan.llm import arrays as ar

_ROUNDS = 2
_AT_ONCE = 4096
_ODD = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Layout:
    """`k` ids of `id_bytes` (4 to 8) bytes, in 2 ** `bucket_bits` buckets by quotient."""

    k: int
    id_bytes: int
    bucket_bits: int

    @property
    def bits(self) -> int:
        return 8 * self.id_bytes

    @property
    def quotient_bytes(self) -> int:
        """So many that a bucket has eight quotients at least."""
        return -(-(self.bucket_bits + 3) // 8)

    @property
    def quotients(self) -> int:
        """Quotients in one bucket."""
        return 1 << (8 * self.quotient_bytes - self.bucket_bits)

    @property
    def remainder_bytes(self) -> int:
        return self.k * self.id_bytes - self.quotient_bytes

    def _mask(self, i: int, step: int, other: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            salted = other + np.uint64((step * self.k + i + 1) * _ODD & (1 << 64) - 1)
        return ar.mixed(salted) >> np.uint64(64 - self.bits)

    def permuted(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """The columns of the permuted numbers, top first: each id is changed by the one before it, round by round."""
        cells = [x.astype(np.uint64) for x in ids]
        for step in range(_ROUNDS):
            for i in range(self.k):
                if self.k > 1:
                    cells[i] = cells[i] ^ self._mask(i, step, cells[i - 1])
        return cells

    def restored(self, cells: list[np.ndarray]) -> list[np.ndarray]:
        """The ids again."""
        ids = list(cells)
        for step in reversed(range(_ROUNDS)):
            for i in reversed(range(self.k)):
                if self.k > 1:
                    ids[i] = ids[i] ^ self._mask(i, step, ids[i - 1])
        return ids

    def summed(self, cells: list[np.ndarray], counts: np.ndarray, group: np.ndarray):
        """Entries in order of group and permuted number, equal ones as one with the sum of their counts."""
        key = cells[0] << np.uint64(64 - self.bits)
        if self.k > 1 and self.bits < 64:
            key = key | cells[1] >> np.uint64(max(0, 2 * self.bits - 64))
        order = np.argsort(key, kind="stable")  # sorted pieces, as those of filters, are merged
        order = order[np.argsort(group[order], kind="stable")]

        def changes(order):
            differ = np.ones(len(order), bool)
            differ[1:] = group[order][1:] != group[order][:-1]
            same_key = ~differ
            same_key[1:] &= key[order][1:] == key[order][:-1]
            for c in cells:
                own = c[order]
                differ[1:] |= own[1:] != own[:-1]
            return differ, same_key

        differ, same_key = changes(order)
        if (differ & same_key).any():  # different numbers under one key: the whole number decides
            order = np.lexsort((*cells[::-1], group))
            differ, _ = changes(order)
        at = np.flatnonzero(differ)
        sums = np.add.reduceat(counts[order], at) if len(at) else np.zeros(0, np.int64)
        first = order[at]
        return [c[first] for c in cells], sums, group[first]

    def filters(self, cells: list[np.ndarray], counts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.RecordBatch]:
        """The filters of summed entries: the group of each, and `bucket` with the filter's parts."""
        n = len(counts)
        shift = np.uint64(self.bits - self.bucket_bits)
        bucket = (cells[0] >> shift).astype(np.int64) if self.bucket_bits else np.zeros(n, np.int64)
        quotient = (cells[0] >> np.uint64(self.bits - 8 * self.quotient_bytes)).astype(np.int64)
        begin = np.ones(n, bool)
        begin[1:] = (group[1:] != group[:-1]) | (bucket[1:] != bucket[:-1])
        first = np.flatnonzero(begin)
        owner = np.cumsum(begin) - 1
        sizes = np.diff(np.append(first, n))
        run_begin = begin.copy()
        run_begin[1:] |= quotient[1:] != quotient[:-1]
        run_end = np.ones(n, bool)
        run_end[:-1] = run_begin[1:]
        width = self.quotients // 8
        big = counts > 1
        n_big = np.add.reduceat(big, first, dtype=np.int64) if n else np.zeros(0, np.int64)
        columns = {
            "bucket": pa.array(bucket[first], pa.int64()),
            "occupied": _binary(self._occupied(quotient & (self.quotients - 1), first, owner), np.full(len(first), width)),
            "run_ends": self._bitmap(run_end, owner, first, sizes),
            "remainders": _binary(self._remainders(cells), sizes * self.remainder_bytes),
            "more": self._bitmap(big, owner, first, sizes),
            "counts": _binary(counts[big].astype("<u8").view(np.uint8), n_big * 8),
        }
        return group[first], pa.RecordBatch.from_pydict(columns)

    def _occupied(self, quotient, first, owner) -> np.ndarray:
        """The bitmaps of occurring quotients, some filters at a time."""
        parts = [np.zeros(0, np.uint8)]
        for a in range(0, len(first), _AT_ONCE):
            b = min(a + _AT_ONCE, len(first))
            own = slice(first[a], first[b] if b < len(first) else len(owner))
            bits = np.zeros((b - a) * self.quotients, bool)
            bits[(owner[own] - a) * self.quotients + quotient[own]] = True
            parts.append(np.packbits(bits))
        return np.concatenate(parts)

    @staticmethod
    def _bitmap(flags, owner, first, sizes) -> pa.Array:
        """One bit per entry, the bits of each filter from a whole byte on."""
        width = -(-sizes // 8)
        begin = np.cumsum(width) - width
        bits = np.zeros(int(width.sum()) * 8, bool)
        bits[8 * begin[owner] + np.arange(len(flags)) - first[owner]] = flags
        return _binary(np.packbits(bits), width)

    def _remainders(self, cells) -> np.ndarray:
        parts = [self._bytes(cells[0])[:, self.quotient_bytes :]] + [self._bytes(c) for c in cells[1:]]
        return np.concatenate(parts, axis=1).reshape(-1)

    def _bytes(self, cell: np.ndarray) -> np.ndarray:
        return cell.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - self.id_bytes :]

    def entries(self, filters: pa.RecordBatch | pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Columns and counts of the entries of all filters, and the filter that each stands in."""
        column = lambda c: _flat(filters.column(c))
        raw, ends = column("remainders")
        sizes = np.diff(ends) // self.remainder_bytes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        before = np.cumsum(sizes) - sizes

        def bits(name):
            data, offsets = column(name)
            return np.unpackbits(data)[8 * offsets[owner] + np.arange(len(owner)) - before[owner]].astype(bool)

        run_end = bits("run_ends")
        occupied = np.unpackbits(column("occupied")[0]).reshape(-1, self.quotients)
        quotient = np.nonzero(occupied)[1][np.cumsum(run_end) - run_end]
        bucket = filters.column("bucket").to_numpy()
        quotient = (bucket.astype(np.uint64)[owner] << np.uint64(8 * self.quotient_bytes - self.bucket_bits)) | quotient.astype(np.uint64)
        rows = raw.reshape(-1, self.remainder_bytes)
        low = self.id_bytes - self.quotient_bytes
        cells = [quotient << np.uint64(8 * low) | _number(rows[:, :low])]
        for i in range(1, self.k):
            at = low + (i - 1) * self.id_bytes
            cells.append(_number(rows[:, at : at + self.id_bytes]))
        counts = np.ones(len(owner), np.int64)
        counts[bits("more")] = column("counts")[0].view("<u8")
        return cells, counts, owner

    def merged(self, filters: pa.RecordBatch | pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        """Columns and counts of filters of one group taken together."""
        cells, counts, _ = self.entries(filters)
        cells, counts, _ = self.summed(cells, counts, np.zeros(len(counts), np.uint16))
        return cells, counts

    def count(self, filters: pa.RecordBatch | pa.Table, ids: list[int]) -> int:
        """The count of one n-gram in some filters: its quotient's run is found by counting bits, then its remainder."""
        cells = self.permuted([np.array([x], np.uint64) for x in ids])
        bucket = int(cells[0][0]) >> (self.bits - self.bucket_bits)
        quotient = (int(cells[0][0]) >> (self.bits - 8 * self.quotient_bytes)) & (self.quotients - 1)
        wanted = self._remainders(cells).tobytes()
        total = 0
        for row in filters.to_pylist():
            occupied = np.unpackbits(np.frombuffer(row["occupied"], np.uint8))
            if row["bucket"] != bucket or not occupied[quotient]:
                continue
            run = int(occupied[:quotient].sum())
            ends = np.flatnonzero(np.unpackbits(np.frombuffer(row["run_ends"], np.uint8)))
            begin = int(ends[run - 1]) + 1 if run else 0
            more = np.unpackbits(np.frombuffer(row["more"], np.uint8))
            for i in range(begin, int(ends[run]) + 1):
                if row["remainders"][i * self.remainder_bytes : (i + 1) * self.remainder_bytes] == wanted:
                    big = np.frombuffer(row["counts"], "<u8")
                    total += int(big[int(more[:i].sum())]) if more[i] else 1
        return total


def _number(rows: np.ndarray) -> np.ndarray:
    """The numbers of some big-endian bytes."""
    whole = np.zeros((len(rows), 8), np.uint8)
    whole[:, 8 - rows.shape[1] :] = rows
    return whole.view(">u8").reshape(-1).astype(np.uint64)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins (and the last one ends)."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]
