"""Byte-level BPE with a hierarchical-bitmap queue of merge ranks."""

from __future__ import annotations

import base64

import regex

#: Where the public vocabularies lie; every operator takes another path as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are parted before the merges, a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose ids are kept per worker; the memory is bounded, the result does not depend on it.
CACHE_ENTRIES = 200_000
CACHED_LENGTH = 64
_WORD = 64


class RankQueue:
    """Smallest rank first: a bucket of positions for each rank, found by a tree of 64-bit words.

    A bit of the lowest level says that a rank's bucket holds something, a bit of each level above that a word of the
    level below is not zero; the smallest rank is found by find-first-set from the top. Adding and taking cost the
    depth of the tree (three levels for 50,000 ranks), however many entries wait.
    """

    def __init__(self, ranks: int) -> None:
        self.levels: list[list[int]] = []
        size = ranks
        while True:
            size = -(-size // _WORD)
            self.levels.append([0] * size)
            if size == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def add(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        at = rank
        for level in self.levels:
            word, bit = at >> 6, at & 63
            before = level[word]
            level[word] = before | (1 << bit)
            if before:
                break
            at = word

    def take(self) -> tuple[int, list[int]] | None:
        """The smallest rank with all positions added for it, or None."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = (at << 6) | ((word & -word).bit_length() - 1)
        rank = at
        for level in self.levels:
            word, bit = at >> 6, at & 63
            level[word] &= ~(1 << bit)
            if level[word]:
                break
            at = word
        return rank, self.buckets.pop(rank)


class Tokenizer:
    """Ids of texts by a rank file; strings that look like special tokens are ordinary text."""

    def __init__(self, path: str = VOCABULARY) -> None:
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.size = max(self.tokens) + 1
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.queue = RankQueue(self.size)
        self.cache: dict[str, list[int]] = {}
        self.part = regex.compile(PATTERN).finditer

    def _pair(self, left: int, right: int) -> int:
        """Rank of the token two neighbours make, -1 if none."""
        key = left * self.size + right
        rank = self.pairs.get(key)
        if rank is None:
            if len(self.pairs) > 4 * CACHE_ENTRIES:
                self.pairs.clear()
            rank = self.pairs[key] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return rank

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the neighbours of smallest rank are merged first, the leftmost of equals first.

        The bytes form a linked list; a merged pair's right part leaves it. Entries of the queue whose parts have
        changed since are stale and skipped. A merge only makes pairs of higher rank than its own, so a bucket is
        complete when it is taken.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.single[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, pair = self.queue, self._pair
        for i in range(n - 1):
            rank = pair(ids[i], ids[i + 1])
            if rank >= 0:
                queue.add(rank, i)
        while (taken := queue.take()) is not None:
            rank, positions = taken
            positions.sort()
            for i in positions:
                if ids[i] < 0 or (j := after[i]) >= n or pair(ids[i], ids[j]) != rank:
                    continue
                ids[i], ids[j] = rank, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    right = pair(rank, ids[k])
                    if right >= 0:
                        queue.add(right, i)
                h = before[i]
                if h >= 0:
                    left = pair(ids[h], rank)
                    if left >= 0:
                        queue.add(left, h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for found in self.part(text):
            piece = found.group()
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= CACHED_LENGTH:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out
