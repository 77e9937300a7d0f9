"""A counting quotient filter over 64-bit fingerprints, held in numpy arrays.

A fingerprint splits into a quotient (its leading ``q`` bits) and a remainder
(the others).  All remainders of one quotient form a run, runs follow one
another in quotient order and remainders ascend within a run, so walking the
slots yields the fingerprints in ascending order whatever ``q`` is.  Three bit
vectors describe the slots: ``occupied`` (one bit a quotient: it has a run),
``run_end`` (one bit a slot: the run's last) and ``counter`` (one bit a slot:
not a remainder but the multiplicity of the remainder before it, written only
where that is above one).

Because quotient and remainder together are the whole fingerprint, filters of
any sizes merge without loss: their sorted remainders are interleaved and the
counters of equal fingerprints added.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

_HEAD = struct.Struct("<BQQ")


class CountingQuotientFilter:
    """Slots and bit vectors of one filter; build it with ``of`` or ``merge``."""

    def __init__(self, q: int, occupied: np.ndarray, run_end: np.ndarray, counter: np.ndarray, slots: np.ndarray):
        self.q, self.occupied, self.run_end, self.counter, self.slots = q, occupied, run_end, counter, slots

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        values, counts = np.unique(np.asarray(fingerprints, dtype=np.uint64), return_counts=True)
        return cls._from_sorted(values, counts.astype(np.uint64))

    @classmethod
    def _from_sorted(cls, values: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        q = max(1, int(np.ceil(np.log2(max(2, len(values)) / 0.75))))
        quotient = (values >> np.uint64(64 - q)).astype(np.int64)
        remainder = values & np.uint64((1 << (64 - q)) - 1)
        width = 1 + (counts > 1).astype(np.int64)
        at = np.cumsum(width) - width
        slots = np.zeros(int(width.sum()), dtype=np.uint64)
        counter = np.zeros(len(slots), dtype=bool)
        run_end = np.zeros(len(slots), dtype=bool)
        occupied = np.zeros(1 << q, dtype=bool)
        slots[at] = remainder
        many = counts > 1
        slots[at[many] + 1] = counts[many]
        counter[at[many] + 1] = True
        occupied[quotient] = True
        last = np.flatnonzero(np.diff(quotient, append=-1) != 0) if len(values) else np.zeros(0, dtype=np.int64)
        run_end[at[last] + width[last] - 1] = True
        return cls(q, occupied, run_end, counter, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in ascending order and how often each was added."""
        run = np.cumsum(self.run_end) - self.run_end
        quotient = np.flatnonzero(self.occupied).astype(np.uint64)[run] if len(self.slots) else self.slots
        holds = ~self.counter
        values = (quotient[holds] << np.uint64(64 - self.q)) | self.slots[holds]
        counts = np.ones(len(values), dtype=np.uint64)
        index = np.cumsum(holds) - 1
        counts[index[self.counter]] = self.slots[self.counter]
        return values, counts

    @classmethod
    def merge(cls, filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter:
        parts = [f.items() for f in filters] or [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        values = np.concatenate([v for v, _ in parts])
        counts = np.concatenate([c for _, c in parts])
        order = np.argsort(values, kind="stable")  # a merge of ascending runs
        values, counts = values[order], counts[order]
        if not len(values):
            return cls._from_sorted(values, counts)
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        return cls._from_sorted(values[first], np.add.reduceat(counts, first))

    def to_bytes(self) -> bytes:
        """Packed form; a remainder takes ``64 - q`` bits rounded up to bytes, a counter eight bytes."""
        nbytes = (64 - self.q + 7) // 8
        holds = ~self.counter
        rem = np.ascontiguousarray(self.slots[holds]).view(np.uint8).reshape(-1, 8)[:, :nbytes]
        return b"".join([
            _HEAD.pack(self.q, len(self.slots), int(holds.sum())),
            *(np.packbits(x).tobytes() for x in (self.occupied, self.run_end, self.counter)),
            rem.tobytes(), self.slots[self.counter].tobytes(),
        ])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, n_slots, n_rem = _HEAD.unpack_from(data)
        at, bits = _HEAD.size, []
        for n in (1 << q, n_slots, n_slots):
            size = (n + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n).astype(bool))
            at += size
        nbytes = (64 - q + 7) // 8
        wide = np.zeros((n_rem, 8), dtype=np.uint8)
        wide[:, :nbytes] = np.frombuffer(data, np.uint8, n_rem * nbytes, at).reshape(n_rem, nbytes)
        slots = np.zeros(n_slots, dtype=np.uint64)
        slots[~bits[2]] = wide.view(np.uint64).reshape(-1)
        slots[bits[2]] = np.frombuffer(data, np.uint64, n_slots - n_rem, at + n_rem * nbytes)
        return cls(q, *bits, slots)

    def split(self, bits: int) -> Iterable[tuple[int, CountingQuotientFilter]]:
        """The filter dealt out by the fingerprints' leading ``bits``, which each part drops from its order only."""
        values, counts = self.items()
        part = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(values) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(part[a]), self._from_sorted(values[a:b], counts[a:b])
