"""SuperMinHash signatures, vectorised over the shingles of many documents."""

from __future__ import annotations

import numpy as np

from .common import Powers, mix64, window_hashes, word_hashes

SHINGLE = 5
SLOTS = 200
BAND_ROWS = 5
BANDS = SLOTS // BAND_ROWS
_FRACTION = 23
_STEP = 0x9E3779B97F4A7C15
_BASE = 0x5851F42D4C957F2D
_CHUNK = 60_000


def shingle_set(text: bytes, cache: dict[bytes, int], powers: Powers) -> np.ndarray:
    """Sorted 64-bit fingerprints of the distinct five-word shingles of a text, ASCII letters folded."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(words, cache)
    return np.unique(window_hashes(h, min(SHINGLE, len(words)), powers))


def new_powers() -> Powers:
    return Powers(_BASE)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` 32-bit ranks per set; an empty set keeps the largest value everywhere.

    Each element walks through its own random permutation of the slots; step j
    offers the rank j + fraction to one slot.  All elements take step j
    together.  A set stops as soon as every slot holds a smaller rank than any
    later step could offer.
    """
    out = np.full((len(sets), slots), np.uint32(0xFFFFFFFF), dtype=np.uint32)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (last == first or total + len(sets[last]) <= _CHUNK):
            total += len(sets[last])
            last += 1
        _fill(out[first:last], sets[first:last], slots)
        first = last
    return out


def _fill(out: np.ndarray, sets: list[np.ndarray], slots: int) -> None:
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    elements = np.concatenate(sets) if len(sets) else np.empty(0, dtype=np.uint64)
    flat = out.reshape(-1)
    perm = None
    for step in range(slots):
        if not len(elements):
            return
        with np.errstate(over="ignore"):
            u = mix64(elements + np.uint64((_STEP * (step + 1)) & ((1 << 64) - 1)))
        pick = step + (((u >> np.uint64(32)) * np.uint64(slots - step)) >> np.uint64(32)).astype(np.int64)
        rank = np.uint32(step << _FRACTION) | (u & np.uint64((1 << _FRACTION) - 1)).astype(np.uint32)
        if step == 0:
            slot = pick
        else:
            rows = np.arange(len(elements))
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[rows, step]
            perm[rows, step] = slot
        np.minimum.at(flat, owner * slots + slot, rank)
        worst = out.max(axis=1)
        going = worst >= np.uint32((step + 1) << _FRACTION)
        going &= sizes > 0
        live = going[owner]
        if step == 0:
            elements, owner, pick = elements[live], owner[live], pick[live]
            perm = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
            rows = np.arange(len(elements))
            perm[rows, pick] = 0
            perm[rows, 0] = pick
        elif not live.all() and live.mean() < 0.7:
            elements, owner, perm = elements[live], owner[live], perm[live]


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(documents, bands) 64-bit keys; the band number is part of the key."""
    parts = signature.reshape(len(signature), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for j in range(BAND_ROWS):
            key = mix64(key * np.uint64(_STEP) + parts[:, :, j])
    return key


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())
