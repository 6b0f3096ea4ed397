"""Simple-8b word-aligned integer coding, vectorised over blocks.

A 64-bit word holds a selector in its top 4 bits and as many values as fit in the other 60. Selector 0 is the escape:
its payload is an index into a table of values that need more than 60 bits. Every block of BLOCK values starts a new
word, and per-block word offsets let a reader decode any block alone, or all blocks at once with array operations.
"""

from __future__ import annotations

import numpy as np

#: Values per word and bits per value of each selector; selector 0 is the escape.
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK = 1024
#: Blocks that are encoded at once, so that the work stays in the processor's cache.
GROUP = 128
MAGIC = b"GWS8B001"


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits needed by each unsigned 64-bit value, 0 to 64."""
    high = (values >> np.uint64(32)).astype(np.uint32)
    low = values.astype(np.uint32)
    of = lambda x: np.frexp(x.astype(np.float64))[1]
    return np.where(high > 0, of(high) + 32, of(low)).astype(np.uint8)


def encode(values: np.ndarray) -> bytes:
    """Header (magic, values, blocks, words, escapes), block offsets, escapes, words; all little-endian."""
    values = np.asarray(values)
    n = len(values)
    table, words, per_block, escapes = [], [], [], 0
    for i in range(0, n, GROUP * BLOCK):
        part = values[i : i + GROUP * BLOCK].astype(np.uint64)
        w, counts, escaped = encode_group(part, escapes)
        words.append(w)
        per_block.append(counts)
        table.append(escaped)
        escapes += len(escaped)
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    counts, words = join(per_block, np.int64), join(words, "<u8")
    header = np.array([n, len(counts), len(words), escapes], "<u8")
    return MAGIC + header.tobytes() + (np.cumsum(counts) - counts).astype("<u4").tobytes() + join(table, "<u8").tobytes() + words.tobytes()


def encode_group(values: np.ndarray, escapes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of some blocks, the number in each block, and the escaped values, numbered from `escapes` on."""
    n = len(values)
    blocks = -(-n // BLOCK)
    width = BLOCK + max(COUNTS)
    grid = np.zeros((blocks, width), np.uint64)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = values
    grid[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    window = np.zeros((blocks, width), np.uint8)
    window[:, :BLOCK] = bit_lengths(padded).reshape(blocks, BLOCK)
    escaped = window[:, :BLOCK] > 60

    # selector that packs most values from each place on: window maxima of growing length against each width
    choice = np.zeros((blocks, BLOCK), np.uint8)
    span = 1
    for selector in range(len(COUNTS) - 1, 0, -1):
        while span < COUNTS[selector]:
            step = min(span, COUNTS[selector] - span)
            np.maximum(window[:, : width - step], window[:, step:].copy(), out=window[:, : width - step])
            span += step
        fits = window[:, :BLOCK] <= BITS[selector]
        if not fits.any():  # longer windows at fewer bits fit nowhere either
            break
        choice[fits] = selector

    # all blocks step through their words together
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = n - (blocks - 1) * BLOCK
    jump = np.array(COUNTS)[choice]
    at, live, rows, columns = np.zeros(blocks, np.int64), np.arange(blocks), [], []
    while len(live):
        here = at[live]
        rows.append(live)
        columns.append(here)
        at[live] = here + jump[live, here]
        live = live[at[live] < lengths[live]]
    place = np.concatenate(rows) * width + np.concatenate(columns)
    place.sort()
    rows, columns = np.divmod(place, width)
    selectors = choice[rows, columns]
    words = selectors.astype(np.uint64) << np.uint64(60)
    flat = grid.reshape(-1)
    for selector in np.flatnonzero(np.bincount(selectors, minlength=len(COUNTS))):
        mine = np.flatnonzero(selectors == selector)
        if selector == 0:
            words[mine] |= np.arange(escapes, escapes + len(mine)).astype(np.uint64)
        elif BITS[selector]:
            packed = flat[place[mine]]
            for k in range(1, COUNTS[selector]):
                packed |= flat[place[mine] + k] << np.uint64(k * BITS[selector])
            words[mine] |= packed
    return words, np.bincount(rows, minlength=blocks), grid[:, :BLOCK][escaped]


def decode(data: bytes) -> np.ndarray:
    if data[:8] != MAGIC:
        raise ValueError("not a Simple-8b stream")
    n, blocks, n_words, escapes = map(int, np.frombuffer(data, "<u8", 4, 8))
    offsets = np.frombuffer(data, "<u4", blocks, 40).astype(np.int64)
    table = np.frombuffer(data, "<u8", escapes, 40 + 4 * blocks)
    words = np.frombuffer(data, "<u8", n_words, 40 + 4 * blocks + 8 * escapes)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[selectors]
    block = np.repeat(np.arange(blocks), np.diff(np.append(offsets, n_words)))
    before = np.cumsum(counts) - counts
    start = before - before[offsets][block] + block * BLOCK if n_words else before
    ends = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for selector in range(len(COUNTS)):
        mine = np.flatnonzero(selectors == selector)
        if selector == 0:
            out[start[mine]] = table[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif BITS[selector] and len(mine):
            mask = np.uint64((1 << BITS[selector]) - 1)
            for k in range(COUNTS[selector]):
                put = start[mine] + k
                ok = put < ends[mine]
                out[put[ok]] = (words[mine[ok]] >> np.uint64(k * BITS[selector])) & mask
    return out
