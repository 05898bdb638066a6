"""Packing of token sequences: Martello-Toth dominance reduction on the histogram of lengths, then best fit.

A length is at most the capacity, so the histogram has at most `capacity` entries whatever the corpus: the driver packs
*counts of lengths* and hands out ranges of ranks, and the executors look up where the n-th piece of a length goes.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial
from unicodedata import is_normalized

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, materialize

#: Words, and their stems without capitals and stops, whose ids a worker keeps; beyond that many it starts anew, so its memory stays bounded.
KEPT_WORDS, KEPT_STEMS = 600_000, 900_000

_TOKENIZERS: dict[str, object] = {}
_WORDS: dict[str, _Words] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = False
    return _TOKENIZERS[path]


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _ids(tokenizer, text: str) -> bytes:
    return _little(tokenizer.encode(text, add_special_tokens=False).ids)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + n) for n, b in enumerate(hidden)}


class _Words(dict):
    """The ids of words by their UTF-8 bytes, learnt as they are looked up; a word that is letters and one stop or comma is looked up as two.

    A stem of letters is one unit of the pre-tokenizer, so it goes straight to the tokenizer's model once it is in the form
    that the normalizer gives it: composed, in lower case, its bytes as letters. Scripts from U+0590 on, whose letters newer
    Unicode versions add to, go through the whole tokenizer.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.stems = tokenizer, {}
        self.model, self.letters = tokenizer.model, _byte_letters()

    def _stem(self, stem: str) -> bytes:
        found = self.stems.get(stem)
        if found is None:
            if len(self.stems) > KEPT_STEMS:
                self.stems.clear()
            found = self.stems[stem] = self._encode(stem)
        return found

    def _encode(self, stem: str) -> bytes:
        if stem.isascii():
            unit = stem
        elif stem.isalpha() and max(stem) < "\u0590" and "Σ" not in stem and is_normalized("NFC", stem):
            unit = stem.lower().encode().decode("latin-1").translate(self.letters)
        else:
            return _ids(self.tokenizer, stem)
        if not stem.isalpha():
            return _ids(self.tokenizer, stem)
        return _little([token.id for token in self.model.tokenize(unit)])

    def __missing__(self, raw: bytes) -> bytes:
        word = raw.decode()
        stem, stop = (word[:-1], word[-1]) if word[-1] in ".,;:!?" else (word, "")
        if stem.isascii():
            stem = stem.lower()
        if stem.isalpha() and "İ" not in stem:  # its lower case ends in a mark, which joins the stop
            ids = self._stem(stem) + self._stem(stop) if stop else self._stem(stem)
        else:
            ids = _ids(self.tokenizer, word)
        self[raw] = ids
        return ids

    def encode(self, words: list[bytes]) -> bytes:
        if len(self) > KEPT_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, words))


def encode_words(texts: list[bytes], path: str) -> Iterator[bytes]:
    """The ids of each UTF-8 text as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never merges across it, so a text has the ids of its words between ASCII blanks
    in order (other white space stays inside a word, where the tokenizer drops it itself); each distinct word is
    encoded once. A text with "<|" is encoded whole: it might hold a special token's name.
    """
    tokenizer = _tokenizer(path)
    if path not in _WORDS:
        _WORDS[path] = _Words(tokenizer)
    words = _WORDS[path]
    for text in texts:
        yield _ids(tokenizer, text.decode()) if b"<|" in text else words.encode(text.split())


def _pieces(batches: Iterator, path: str, capacity: int, end_id: int) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        rows: tuple[list, ...] = ([], [], [], [], [])
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4_000_000)))
            chunk = [x or b"" for x in texts.slice(at, to - at).to_pylist()]
            for doc, encoded in zip(ids[at:to], encode_words(chunk, path), strict=True):
                encoded += end
                for piece, start in enumerate(range(0, len(encoded), 4 * capacity)):
                    part = encoded[start : start + 4 * capacity]
                    for column, value in zip(rows, (doc, piece, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            at = to
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """The ids of each text and a closing `end_id`, cut into pieces of `capacity`; null texts count as empty."""
    cut = partial(_pieces, path=tokenizer_path or default_tokenizer(), capacity=capacity, end_id=end_id)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Bins:
    """Groups of equal bins. Each entry: residual, number of bins, and its contents as (length, copies) from the first placed on."""

    def __init__(self, capacity: int):
        self.capacity, self.done, self.open = capacity, [], {}
        self.residuals: list[int] = []

    def add(self, residual: int, bins: int, content: tuple) -> None:
        if bins and residual == 0:
            self.done.append((bins, content))
        elif bins:
            if residual not in self.open:
                insort(self.residuals, residual)
                self.open[residual] = []
            self.open[residual].append((bins, content))

    def best_fit(self, length: int, count: int) -> None:
        """Place `count` pieces of `length`, each where the least room is left."""
        while count:
            k = bisect_left(self.residuals, length)
            if k == len(self.residuals):
                per = min(self.capacity // length, count)
                bins = count // per
                self.add(self.capacity - per * length, bins, ((length, per, None),))
                count -= bins * per
                continue
            residual = self.residuals[k]
            bins, content = self.open[residual].pop()
            per = min(residual // length, count)
            used = min(bins, count // per)
            if used < bins:
                self.open[residual].append((bins - used, content))
            if not self.open[residual]:
                del self.open[residual]
                self.residuals.pop(k)
            self.add(residual - per * length, used, (length, per, content))
            count -= used * per


def _contents(linked: tuple) -> list[tuple[int, int]]:
    """(length, copies) of a bin in placing order: contents are linked lists, so equal prefixes are shared."""
    out = []
    while linked is not None:
        if len(linked) == 1:
            linked = linked[0]
        length, per, linked = linked
        out.append((length, per))
    return out[::-1]


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, copies), ...]) for all pieces of a histogram of lengths.

    Reduction, largest remaining length first, each step for as many equal pieces at once as there are:
    a piece that fits with no other goes alone; a piece with an exact partner takes it (no bin can be fuller, and any
    content of the rest of that bin can take the partner's old place); a piece that can't be with two others takes the
    largest partner that fits (any other single partner is smaller and can change places with it). What none of these
    rules decides is packed by best fit, longest first.
    """
    left = {k: v for k, v in counts.items() if v and k > 0}
    lengths = sorted(left)
    fixed: list[tuple[int, list[tuple[int, int]]]] = []
    rest: dict[int, int] = {}

    def take(length: int, n: int) -> None:
        left[length] -= n
        if not left[length]:
            del left[length]
            lengths.pop(bisect_left(lengths, length))

    while lengths:
        big = lengths[-1]
        room = capacity - big
        if lengths[0] > room:
            fixed.append((left[big], [(big, 1)]))
            take(big, left[big])
            continue
        if room in left and (room != big or left[big] > 1):
            n = left[big] // 2 if room == big else min(left[big], left[room])
            fixed.append((n, [(big, 2)] if room == big else [(big, 1), (room, 1)]))
            take(big, n)
            take(room, n)
            continue
        small = lengths[0]
        two = 2 * small if left[small] > (2 if small == big else 1) else small + (lengths[1] if len(lengths) > 1 else capacity)
        if two > room and (not rest or min(rest) > room):  # a longer piece put aside could be the better partner
            partner = lengths[bisect_left(lengths, room + 1) - 1]
            if partner != big or left[big] > 1:
                # the two smallest change as pieces go, so only one step at a time near their last copies
                n = left[big] // 2 if partner == big else min(left[big], left[partner])
                n = max(1, min(n, left[small] - 2)) if partner == small else n
                fixed.append((n, [(big, 2)] if partner == big else [(big, 1), (partner, 1)]))
                take(big, n)
                take(partner, n)
                continue
        rest[big] = left[big]
        take(big, left[big])
    bins = _Bins(capacity)
    for length in sorted(rest, reverse=True):
        bins.best_fit(length, rest[length])
    for groups in bins.open.values():
        bins.done.extend(groups)
    return fixed + [(n, _contents(content)) for n, content in bins.done]


def allocations(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Ranges of ranks of each length, sorted by (length, first rank): the sequence and offset of the range's first piece and how many of them a sequence takes."""
    used: dict[int, int] = {}
    rows = []
    first_bin = 0
    for n, content in bins:
        offset = 0
        for length, per in content:
            rank = used.get(length, 0)
            rows.append((length, rank, first_bin, offset, per))
            used[length] = rank + n * per
            offset += length * per
        first_bin += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "offset", "per"), table.T.copy(), strict=True))


def _place(batches: Iterator, table: dict[str, np.ndarray]) -> Iterator:
    lengths, first = np.unique(table["length"], return_index=True)
    last = np.append(first[1:], len(table["length"]))
    for pdf in batches:
        at = np.zeros(len(pdf), np.int64)
        length, rank = pdf["length"].to_numpy(), pdf["_rank"].to_numpy()
        for k, (a, b) in enumerate(zip(first, last, strict=True)):
            own = length == lengths[k]
            if own.any():
                at[own] = a + np.searchsorted(table["rank"][a:b], rank[own], "right") - 1
        nth = rank - table["rank"][at]
        pdf["sequence_id"] = table["sequence"][at] + nth // table["per"][at]
        pdf["offset"] = table["offset"][at] + nth % table["per"][at] * length
        yield pdf.drop(columns="_rank")


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece that holds `end_id` only. Ties in length go by a hash of doc_id and piece, then by
    those; rows that repeat a doc_id are packed like any others. An empty table gives an empty result; other columns of
    `docs` are ignored. The broadcast table has at most one entry per length and bin group, a number that `capacity` bounds.
    """
    pieces = materialize(token_pieces(docs, capacity, tokenizer_path, end_id), "pieces")
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = allocations(pack_histogram(counts, capacity))
    ranked = gapless_rank(pieces, ["length"], [F.col("doc_id"), F.col("piece")], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_rank")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    return ranked.mapInPandas(partial(_place, table=table), schema)
