"""Benchmark decontamination with spaced seeds.

A spaced seed is a mask over a window of words; words at its open positions are ignored. Every window of every test item
is hashed under each mask, and so is every window of every document; equal hashes are hits. Around a hit, item and
document are aligned word by word on the hit's diagonal, and any stretch with enough matching words decides. Together the
masks are complete: every stretch with 12 matching words or more of which three quarters match holds a hit of one of them
(a stretch of 32 words or more has a half that meets the rule, and all patterns of up to 31 words were counted out).
Items of fewer than six words are found by one hash of all their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_batch, mix64, slices, small_batches, span_hashes

#: The masks: 1 counts, 0 is ignored. Six words must agree in windows of 6 to 10.
MASKS = ("111111", "111001101", "1001010111", "101100111", "1110100011", "1100101101", "11110101", "1101111", "11111001")
#: Hits, and words of diagonals, that are held in memory at once.
AT_ONCE = 1 << 20
#: Test items are compared in blocks of this many bytes of text at most, so what is broadcast stays bounded.
BLOCK_BYTES = 8 << 20
#: Matching words that a stretch must have (fewer for shorter items: all of them), and the part of it that must match.
LEAST_WORDS, LEAST_SHARE = 12, 0.75
_COST = 1.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters and digits, ASCII case folded, every byte beyond ASCII counting as a letter) and the n + 1 word offsets of the rows."""
    word = np.concatenate(([False], _WORD[data], [False]))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | first))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | first))
    return span_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def seed_hashes(words: np.ndarray, at: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that lie within a row, and the positions of their first words."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, np.uint64(len(mask)))
    for k, c in enumerate(mask):
        if c == "1":
            h = (h ^ words[k : k + n]) * _STEP
            h ^= h >> np.uint64(29)
    end = np.repeat(at[1:], np.diff(at))[:n]
    inside = np.flatnonzero(np.arange(n) + len(mask) <= end)
    return mix64(h[inside]), inside


class ItemIndex:
    """A block of test items: their words, and their seed hashes in order."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        self.ids = np.array(ids, np.int64)
        self.words, self.at = words_of(np.frombuffer(b"".join(texts), np.uint8), offsets)
        self.seeds: list[tuple[str, np.ndarray, np.ndarray]] = []
        count = np.diff(self.at)
        shortest = min(map(len, MASKS))
        for mask in (*MASKS, *("1" * n for n in range(1, shortest))):
            h, pos = seed_hashes(self.words, self.at, mask)
            if len(mask) < shortest:  # whole items only
                whole = count[np.searchsorted(self.at, pos, "right") - 1] == len(mask)
                h, pos = h[whole], pos[whole]
            order = np.argsort(h, kind="stable")
            if len(h):
                self.seeds.append((mask, h[order], pos[order]))
        # one bit for each low half of a hash settles nearly all windows without a search
        self.sieve = np.zeros(1 << 22, bool)
        for _, h, _ in self.seeds:
            self.sieve[(h & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (item word, document word) of equal seeds, about AT_ONCE at a time: many items may share a seed."""
        for mask, known, where in self.seeds:
            h, pos = seed_hashes(words, at, mask)
            maybe = np.flatnonzero(self.sieve[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            h, pos = h[maybe], pos[maybe]
            a, b = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            total = np.cumsum(b - a)
            done, size = 0, int(total[-1]) if len(total) else 0
            while done < size:
                nth = np.arange(done, min(done + AT_ONCE, size))
                k = np.searchsorted(total, nth, "right")
                yield where[b[k] - (total[k] - nth)], pos[k]
                done += len(nth)

    def diagonals(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct (row, item, document word - item word) of hits, less those with too few matching words on the whole diagonal."""
        out = np.zeros((0, 3), np.int64)
        for mine, theirs in self.hits(words, at):
            found = np.unique(np.stack([np.searchsorted(at, theirs, "right") - 1, np.searchsorted(self.at, mine, "right") - 1, theirs - mine], 1), axis=0)
            out = np.unique(np.concatenate([out, found[self._promising(found, words, at)]]), axis=0)
        return out

    def _promising(self, found: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        row, item, shift = found.T
        low, high = np.maximum(self.at[item], at[row] - shift), np.minimum(self.at[item + 1], at[row + 1] - shift)
        need = np.minimum(LEAST_WORDS, self.at[item + 1] - self.at[item])
        keep = np.zeros(len(found), bool)
        ends = np.cumsum(high - low)
        k = 0
        while k < len(found):
            to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + AT_ONCE, "right")))
            n = (high - low)[k:to]
            first = np.cumsum(n) - n
            mine = np.arange(int(n.sum())) + np.repeat(low[k:to] - first, n)
            same = self.words[mine] == words[mine + np.repeat(shift[k:to], n)]
            keep[k:to] = np.add.reduceat(same, first, dtype=np.int64) >= need[k:to]
            k = to
        return keep

    def overlap(self, item: int, shift: int, words: np.ndarray, row: tuple[int, int]) -> tuple[int, int, int] | None:
        """Matches, length and first document word of a stretch that meets the rule on a diagonal (document word - item word), if there is one.

        It is the best-scoring stretch (a match counts 1, a substitution costs 1.5) if that meets the rule, else the one with most matches.
        """
        a, b = int(self.at[item]), int(self.at[item + 1])
        need = min(LEAST_WORDS, b - a)
        a, b = max(a, row[0] - shift), min(b, row[1] - shift)
        same = self.words[a:b] == words[a + shift : b + shift]
        matches = np.concatenate(([0], np.cumsum(same)))
        if matches[-1] < need:
            return None
        total = np.concatenate(([0.0], np.cumsum(np.where(same, 1.0, -_COST))))
        least = np.minimum.accumulate(total)
        end = int(np.argmax(total - least))
        start = int(np.argmin(total[: end + 1]))
        if matches[end] - matches[start] < need or matches[end] - matches[start] < LEAST_SHARE * (end - start):
            # from each start, the furthest end with the share: surplus there is not less than at the start
            surplus = np.concatenate(([0.0], np.cumsum(same - LEAST_SHARE)))
            later = np.maximum.accumulate(surplus[::-1])
            ends = len(same) - np.searchsorted(later, surplus, "left")
            start = int(np.argmax(matches[ends] - matches))
            end = int(ends[start])
            if matches[end] - matches[start] < need:
                return None
            kept = start + np.flatnonzero(same[start:end])
            start, end = int(kept[0]), int(kept[-1]) + 1
        return int(matches[end] - matches[start]), end - start, a + start + shift


def _scan(batches: Iterator, index: ItemIndex) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(0)
        data, offsets = binary_batch(batch.column(1))
        for a, b in slices(offsets, 2 << 20):
            part = offsets[a : b + 1]
            words, at = words_of(data[part[0] : part[-1]], part - part[0])
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for r, i, shift in index.diagonals(words, at).tolist():
                if found := index.overlap(i, shift, words, (int(at[r]), int(at[r + 1]))):
                    matched, length, start = found
                    best[r, i] = max(best.get((r, i), (0, 0, 0)), (matched, length, start - int(at[r])), key=lambda x: (x[0], -x[1], -x[2]))
            keys = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([a + r for r, _ in keys], pa.int64())),
                    pa.array([int(index.ids[i]) for _, i in keys], pa.int64()),
                    *(pa.array([best[k][n] for k in keys], pa.int64()) for n in range(3)),
                    pa.array([int(index.at[i + 1] - index.at[i]) for _, i in keys], pa.int64()),
                ],
                ["doc_id", "item_id", "matched_words", "overlap_words", "first_word", "item_words"],
            )


def _blocks(items: DataFrame) -> Iterator[ItemIndex]:
    """The test items in blocks of bounded size, one at a time on the driver, in order of their hash."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    size = rows.agg(F.sum(F.length("text") + 64).alias("n")).first().n or 0
    blocks = -(-size // (BLOCK_BYTES // 2)) or 1
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id").collect()
        ids, texts, held = [], [], 0
        for r in part:
            ids.append(r.item_id)
            texts.append(bytes(r.text))
            held += len(r.text)
            if held >= BLOCK_BYTES:
                yield ItemIndex(ids, texts)
                ids, texts, held = [], [], 0
        if ids:
            yield ItemIndex(ids, texts)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched_words, overlap_words, first_word, item_words) for each item that a document overlaps.

    An overlap is a stretch of an item on one diagonal with at least 12 matching words (all words of a shorter item) of
    which three quarters or more match. So an item of fewer than six words is found where all its words stand in a row; such
    items can be common phrases, which item_words tells. Null and empty texts overlap nothing. Repeated rows give repeated results. Other columns are ignored. Documents aren't shuffled;
    test items are broadcast in blocks whose size is bounded by a constant, one pass over the documents for each block.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    schema = "doc_id long, item_id long, matched_words long, overlap_words long, first_word long, item_words long"
    out = None
    for index in _blocks(items):
        part = base.mapInArrow(partial(_scan, index=index), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else base.sparkSession.createDataFrame([], schema)
