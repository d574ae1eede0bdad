"""Quote-aware finite-state tokenizer over the bytes of many lines at once.

Lines are cut into blocks of BLOCK bytes. Each block's transition function (a state for each state it may begin in) is
composed byte by byte for all blocks together; the functions of a line's blocks are then applied in order, which gives
every block its true first state, and a second sweep gives the state before every byte. A line of any length is thus
tokenised without a loop over its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 32
START, PLAIN, QUOTED, CLOSED, TRAILED, STRAY_QUOTE, AFTER_QUOTE = range(7)
OTHER, QUOTE, DELIMITER, BLANK = range(4)
#: next state by [byte class, state]; blanks after a closing quote are let pass, the two last states are errors and stay.
TRANSITION = np.array(
    [
        [PLAIN, PLAIN, QUOTED, AFTER_QUOTE, AFTER_QUOTE, STRAY_QUOTE, AFTER_QUOTE],
        [QUOTED, STRAY_QUOTE, CLOSED, QUOTED, AFTER_QUOTE, STRAY_QUOTE, AFTER_QUOTE],
        [START, START, QUOTED, START, START, STRAY_QUOTE, AFTER_QUOTE],
        [PLAIN, PLAIN, QUOTED, TRAILED, TRAILED, STRAY_QUOTE, AFTER_QUOTE],
    ],
    dtype=np.int8,
)


class Lines:
    """Tokenised lines: broken (per line), error_at (byte offset or -1), fields (count), cells() of chosen lines."""

    def __init__(self, text: pa.Array, delimiter: np.ndarray) -> None:
        """text: strings without nulls; delimiter: the byte that parts fields, per line."""
        text = pa.concat_arrays([text.cast(pa.large_string())]) if text.offset else text.cast(pa.large_string())
        buffers = text.buffers()
        n = len(text)
        offsets = np.frombuffer(buffers[1], dtype=np.int64)[: n + 1] if n else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, dtype=np.uint8)
        self.first = offsets[0]
        self.data = data[offsets[0] : offsets[-1]]
        self.bounds = offsets - offsets[0]
        lengths = np.diff(self.bounds)
        kind = np.zeros(len(self.data), dtype=np.int8)
        kind[self.data == 0x20] = BLANK
        kind[self.data == 0x22] = QUOTE
        kind[self.data == np.repeat(delimiter.astype(np.uint8), lengths)] = DELIMITER
        self.kind = kind
        self.before, last = self._states(lengths)
        errors = np.flatnonzero(TRANSITION[kind, self.before] >= STRAY_QUOTE) if len(kind) else np.zeros(0, dtype=int)
        self.error_at = np.full(n, -1, dtype=np.int64)
        line = np.searchsorted(self.bounds, errors, side="right") - 1
        self.error_at[line[::-1]] = (errors - self.bounds[line])[::-1]
        open_quote = last == QUOTED
        self.error_at[open_quote & (self.error_at < 0)] = lengths[open_quote & (self.error_at < 0)]
        self.broken = self.error_at >= 0
        self.parting = (kind == DELIMITER) & (self.before != QUOTED) & (self.before < STRAY_QUOTE)
        counted = np.concatenate([[0], np.cumsum(self.parting)])
        self.fields = counted[self.bounds[1:]] - counted[self.bounds[:-1]] + 1

    def _states(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state before every byte, and the state after each line."""
        blocks = -(-lengths // BLOCK)
        of_line = np.repeat(np.arange(len(lengths)), blocks)
        nth = np.arange(len(of_line)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = self.bounds[of_line] + nth * BLOCK
        size = np.minimum(BLOCK, self.bounds[of_line + 1] - begin) if len(of_line) else np.zeros(0, dtype=np.int64)
        states = TRANSITION.shape[1]
        function = np.tile(np.arange(states, dtype=np.int8), (len(begin), 1))
        for k in range(BLOCK):
            live = np.flatnonzero(size > k)
            if len(live) == 0:
                break
            function[live] = TRANSITION[self.kind[begin[live] + k][:, None], function[live]]
        state = np.zeros(len(lengths), dtype=np.int8)
        entry = np.zeros(len(begin), dtype=np.int8)
        order = np.argsort(nth, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(nth))]) if len(nth) else np.zeros(1, dtype=int)
        for a, b in zip(cuts[:-1], cuts[1:]):
            now = order[a:b]
            entry[now] = state[of_line[now]]
            state[of_line[now]] = function[now, entry[now]]
        before = np.zeros(len(self.data), dtype=np.int8)
        current = entry.copy()
        for k in range(BLOCK):
            live = np.flatnonzero(size > k)
            if len(live) == 0:
                break
            at = begin[live] + k
            before[at] = current[live]
            current[live] = TRANSITION[self.kind[at], current[live]]
        return before, state

    def surplus_at(self, wanted: np.ndarray) -> np.ndarray:
        """Byte of each line at which its fields become more than wanted, or its length if they are too few."""
        lengths = np.diff(self.bounds)
        places = np.append(np.flatnonzero(self.parting), len(self.data))
        first = np.concatenate([[0], np.cumsum(self.parting)])[self.bounds[:-1]]
        at = places[np.minimum(first + np.maximum(wanted - 1, 0), len(places) - 1)] - self.bounds[:-1]
        return np.where(self.fields > wanted, at, lengths)

    def cell_starts(self, chosen: np.ndarray) -> np.ndarray:
        """Byte of its line at which each cell of the chosen lines begins, in the order of cells()."""
        own = np.repeat(chosen, np.diff(self.bounds))
        counts, begins = self.fields[chosen], self.bounds[:-1][chosen]
        ends = np.sort(np.concatenate([np.flatnonzero(self.parting & own), self.bounds[1:][chosen]]))
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, dtype=np.int64)
        starts[np.cumsum(counts) - counts] = begins
        return starts - np.repeat(begins, counts)

    def cells(self, chosen: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """All cells of the chosen lines one after the other, quotes resolved, and how many each line has."""
        lengths = np.diff(self.bounds)
        own = np.repeat(chosen, lengths)
        quotes = (self.kind == QUOTE) & ((self.before == START) | (self.before == QUOTED))
        dropped = self.parting | quotes | ((self.kind == BLANK) & ((self.before == CLOSED) | (self.before == TRAILED)))
        kept = own & ~dropped
        running = np.concatenate([[0], np.cumsum(kept)])
        ends = np.sort(np.concatenate([np.flatnonzero(self.parting & own), self.bounds[1:][chosen]]))
        # a line that ends where a parting byte of the next begins cannot occur: bounds are starts of lines
        offsets = np.concatenate([[0], running[ends]]).astype(np.int64)
        flat = self.data[kept]
        array = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes()))
        return array, self.fields[chosen]
