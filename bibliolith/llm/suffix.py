"""Repeated passages by two-stage suffix sorting.

The suffixes of a text that are smaller than their successors are sorted directly; all others follow from them in one
scan of the buckets, as such a suffix stands in its bucket where its successor stands among the sorted. Adjacent common
prefixes then show which strings of the wanted length occur more than once.

A corpus is sorted in pieces that hold all that can be equal. A string of L bytes has an anchor, the least hash among
its k-grams; equal strings have equal anchors. Strings whose anchor occurs once in the corpus cannot repeat and drop out
first. The rest is sorted twice: among the documents of a batch, where all but the first of equal strings are settled,
and then, with the bytes around their anchors, among all strings of the corpus with the same anchor. Anchors of very many
texts are not gathered: their strings meet by a 128-bit hash of the whole string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _powers, binary_batch, discard, materialize, mix64, release_shuffles, shuffle_partitions, slices, small_batches

#: Length of a k-gram, and the texts beyond which an anchor's strings meet by hash.
GRAM, HOT = 32, 500
#: Bytes that are sorted at once.
CHUNK = 1 << 20
#: Parts that a hot string's rows are dealt to.
SALTS = 64


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Positions of the non-separator bytes of `text` (uint8, separators 0) in order of their suffixes, exact to `depth` bytes.

    With a mask of `wanted` positions, only these need be there: a suffix is sorted directly only if it is wanted or one
    that is follows from it.
    """
    n = len(text)
    following = np.append(text[1:], np.uint8(0))
    differs = np.flatnonzero(text != following)
    # a suffix in a run of equal bytes is as the run's last: smaller than its successor or not
    at = np.searchsorted(differs, np.arange(n))
    small = np.zeros(n, bool)
    inside = at < len(differs)
    small[inside] = text[differs[at[inside]]] < following[differs[at[inside]]]
    small[text == 0] = False
    direct = np.flatnonzero(small)
    if wanted is not None and len(direct):
        count = np.concatenate(([0], np.cumsum(wanted)))
        direct = direct[count[direct + 1] > count[np.concatenate(([0], direct[:-1] + 1))]]
    padded = np.concatenate((text, np.zeros(depth + 8, np.uint8)))
    width = -(-depth // 8) * 8
    keys = np.ascontiguousarray(sliding_window_view(padded, width)[direct]).view(f"S{width}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    del keys
    lead = text[direct]
    cut = np.searchsorted(lead, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def hand_on(sorted_part: np.ndarray, bucket: int) -> np.ndarray:
        """Predecessors that follow from a sorted part: kept for later buckets, or returned if of this one."""
        before = sorted_part[sorted_part > 0] - 1
        before = before[~small[before]]
        byte = text[before]
        later = before[byte > bucket]
        if len(later):
            order = np.argsort(text[later], kind="stable")
            later = later[order]
            bytes_ = text[later]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(bytes_)) + 1, [len(later)]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                waiting[bytes_[a]].append(later[a:b])
        return before[byte == bucket]

    hand_on(np.append(np.flatnonzero(text == 0), n), 0)
    out = []
    for c in np.unique(text):
        if c == 0:
            continue
        part = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(part):
            out.append(part)
            part = hand_on(part, int(c))
        part = direct[cut[c] : cut[c + 1]]
        if len(part):
            out.append(part)
            hand_on(part, int(c))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def later_copies(text: np.ndarray, length: int) -> np.ndarray:
    """For each position: does a string of `length` bytes without separator start there that also starts before?"""
    n = len(text)
    out = np.zeros(n, bool)
    if n < length:
        return out
    gaps = np.concatenate(([0], np.cumsum(text == 0)))
    whole = np.zeros(n, bool)
    whole[: n - length + 1] = gaps[length:] == gaps[: n - length + 1]
    order = suffix_array(text, length, whole)
    order = order[whole[order]]
    if len(order) < 2:
        return out
    # adjacent common prefixes, word by word, for the pairs still equal
    words = sliding_window_view(np.concatenate((text, np.zeros(8, np.uint8))), 8)
    equal = np.arange(len(order) - 1)
    steps = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    for k in steps:
        a, b = order[equal] + k, order[equal + 1] + k
        equal = equal[(np.ascontiguousarray(words[a]).view("<u8") == np.ascontiguousarray(words[b]).view("<u8")).ravel()]
    same = np.zeros(len(order), bool)
    same[equal + 1] = True
    starts = np.flatnonzero(~same)
    first = np.minimum.reduceat(order, starts)
    out[order] = order != np.repeat(first, np.diff(np.append(starts, len(order))))
    return out


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all k-grams of a byte array."""
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    n = len(data) - GRAM + 1
    return mix64((prefix[GRAM:] - prefix[:n]) * down[:n])


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over all windows of `width` values, each block of `width` scanned once forwards and once backwards."""
    n = len(values)
    fill = np.iinfo(np.uint64).max if op is np.minimum else np.uint64(0)
    rows = -(-n // width)
    padded = np.full(rows * width, fill, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(rows, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return op(back[:m], ahead[width - 1 : width - 1 + m])


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per string of `length` bytes within a row: its start, its row, and its anchor (the least k-gram hash in it)."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _sliding(_gram_hashes(data), length - GRAM + 1, np.minimum)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    inside = np.flatnonzero(np.arange(len(least)) + length <= offsets[row + 1])
    return inside, row[inside], least[inside]


def _anchor_rows(batches: Iterator, length: int) -> Iterator:
    """(value, text fingerprint, settled): one row for each anchor value of a text; settled if it occurs in another text of the batch, or at two places of its own."""
    import pyarrow as pa

    for batch in batches:
        prints = batch.column(0).to_numpy()
        data, offsets = binary_batch(batch.column(1))
        for a, b in slices(offsets, CHUNK):
            part = offsets[a : b + 1]
            own = data[part[0] : part[-1]]
            starts, row, value = _anchors(own, part - part[0], length)
            if not len(starts):
                continue
            # the places of anchors: k-grams that are the least of some string over them
            width = length - GRAM + 1
            least = np.zeros(len(own) + width, np.uint64)
            least[starts + width - 1] = value
            hashes = _gram_hashes(own)
            place = np.flatnonzero(_sliding(least, width, np.maximum)[: len(hashes)] == hashes)
            v, text = hashes[place], prints[a:b][np.searchsorted(part - part[0], place, "right") - 1]
            order = np.lexsort((text, v))
            v, text = v[order], text[order]
            new = np.concatenate(([True], v[1:] != v[:-1]))
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            rows = [(v[new], text[new], np.zeros(int(new.sum()), bool)), (v[many], text[many], np.ones(int(many.sum()), bool))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[0] for r in rows]).view(np.int64)), pa.array(np.concatenate([r[1] for r in rows])), pa.array(np.concatenate([r[2] for r in rows]))], ["value", "print", "settled"])


def _runs(mask: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index ranges [a, b) of consecutive true entries with equal values of `same`."""
    on = np.flatnonzero(mask)
    if not len(on):
        return on, on
    breaks = np.concatenate(([True], (np.diff(on) > 1) | np.any([s[on[1:]] != s[on[:-1]] for s in same], axis=0), [True]))
    edges = np.flatnonzero(breaks)
    return on[edges[:-1]], on[edges[1:] - 1] + 1


def _candidates(batches: Iterator, length: int) -> Iterator:
    """Settle equal strings within a batch; hand on what is left: kind 0 settled (doc, from, to), 1 a stretch with its bytes, 2 one string's hash."""
    for batch in batches:
        batch = batch.sort_by("doc_id")
        docs = batch.column(0).to_numpy()
        data, offsets = binary_batch(batch.column(1))
        lists = batch.column(2)
        values, marks = lists.flatten().to_numpy().view(np.uint64), batch.column(3).flatten().to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        for a, b in slices(offsets, CHUNK):
            part = offsets[a : b + 1] - offsets[a]
            own = data[offsets[a] : offsets[b]]
            starts, row, value = _anchors(own, part, length)
            if not len(starts):
                continue
            # (row, value) pairs as one number: a chance collision only makes one more candidate
            wanted_row = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1])).astype(np.uint64)
            wanted = mix64(values[bounds[a] : bounds[b]] + wanted_row * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(wanted)
            wanted, hot_of = wanted[order], marks[bounds[a] : bounds[b]][order]
            pair = mix64(value + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            at = np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)
            is_candidate, hot = wanted[at] == pair, hot_of[at]
            place = np.full(len(own) + 1, -1)
            place[starts] = np.arange(len(starts))
            lo, hi = _runs(is_candidate & np.ones(len(starts), bool), row, starts - np.arange(len(starts)))
            if not len(lo):
                continue
            # the text of the candidates, stretches apart
            first, last = starts[lo], starts[hi - 1] + length
            size = last - first
            to = np.cumsum(size + 1) - (size + 1)
            text = np.zeros(int((size + 1).sum()), np.uint8)
            source = np.repeat(first - to, size) + np.flatnonzero(np.repeat(np.tile([True, False], len(size)), np.stack([size, np.ones_like(size)], 1).ravel()))
            spots = source - np.repeat(first - to, size)
            text[spots] = own[source] + 1
            again = later_copies(text, length)
            settled = np.zeros(len(starts), bool)
            known = place[source]
            keep = known >= 0
            # a string's own place is in the stretch that starts with it or before; bytes past the last start of a stretch repeat nothing
            settled[known[keep]] |= again[spots[keep]]
            settled &= is_candidate
            base = part[:-1]
            la, lb = _runs(settled, row)
            if len(la):
                yield _stretches(0, np.zeros(len(la), np.int64), docs[a + row[la]], starts[la] - base[row[la]], starts[lb - 1] - base[row[la]])
            left = is_candidate & ~settled
            ra, rb = _runs(left & ~hot, row, value)
            if len(ra):
                size = starts[rb - 1] + length - starts[ra]
                yield _stretches(1, value[ra].view(np.int64), docs[a + row[ra]], starts[ra] - base[row[ra]], starts[rb - 1] - base[row[ra]], (_gather(own, starts[ra], size), size))
            single = np.flatnonzero(left & hot)
            if len(single):
                view = own.tobytes()
                hashes = np.frombuffer(b"".join(hashlib.blake2b(view[x : x + length], digest_size=16).digest() for x in starts[single].tolist()), np.int64).reshape(-1, 2)
                place = starts[single] - base[row[single]]
                yield _stretches(2, hashes[:, 0].copy(), docs[a + row[single]], place, place, key2=hashes[:, 1].copy())


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of several spans, one after the other."""
    before = np.cumsum(sizes) - sizes
    return data[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def _stretches(kind: int, key1, docs, a, b, spans: tuple | None = None, key2=None):
    import pyarrow as pa

    n = len(key1)
    if spans is None:
        data, offsets = np.zeros(0, np.uint8), np.zeros(n + 1, np.int32)
    else:
        data, offsets = spans[0], np.concatenate(([0], np.cumsum(spans[1]))).astype(np.int32)
    binary = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    columns = [pa.array(np.full(n, kind, np.int32)), pa.array(key1), pa.array(np.zeros(n, np.int64) if key2 is None else key2), pa.array(docs), pa.array(a), pa.array(b), binary]
    return pa.RecordBatch.from_arrays(columns, ["kind", "key1", "key2", "doc_id", "a", "b", "bytes"])


def _sort_stretches(batches: Iterator, length: int) -> Iterator:
    """Sort the stretches of each anchor value together and return the strings that start later than an equal one.

    Rows come in order of their value. A stretch alone with its value has nothing to be equal to: its own repeats were
    settled with its batch.
    """
    import pyarrow as pa

    def settle(docs: np.ndarray, first: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((first, docs))
        docs, first, starts, sizes = docs[order], first[order], starts[order], sizes[order]
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        text = np.zeros(int((sizes + 1).sum()), np.uint8)
        text[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))] = _gather(data, starts, sizes) + np.uint8(1)
        lo, hi = _runs(later_copies(text, length), np.repeat(np.arange(len(docs)), sizes + 1))
        at = np.searchsorted(begin, lo, "right") - 1
        return pa.RecordBatch.from_arrays([pa.array(docs[at]), pa.array(first[at] + lo - begin[at]), pa.array(first[at] + hi - 1 - begin[at])], ["doc_id", "a", "b"])

    def groups(table: pa.Table, last: bool) -> Iterator:
        """Settle whole groups, about CHUNK bytes at once; return how many rows are done."""
        value, docs, first = (table.column(k).to_numpy() for k in range(3))
        data, offsets = binary_batch(table.column(3).combine_chunks())
        new = np.concatenate(([True], value[1:] != value[:-1]))
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(value)))
        done = len(value) if last else int(begin[-1])
        alone = size[np.cumsum(new) - 1] == 1
        edges = begin[begin < done]
        at = 0
        while at < len(edges):
            to = max(at + 1, int(np.searchsorted(offsets[edges], offsets[edges[at]] + CHUNK)))
            rows = np.arange(edges[at], edges[to] if to < len(edges) else done)
            rows = rows[~alone[rows]]
            if len(rows):
                yield settle(docs[rows], first[rows], data, offsets[rows], np.diff(offsets)[rows])
            at = to
        return done

    held: list = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > 4 * CHUNK:
            table = pa.Table.from_batches(held)
            done = yield from groups(table, False)
            rest = table.slice(done).combine_chunks()
            held, size = rest.to_batches(), 0
    if held and sum(b.num_rows for b in held):
        yield from groups(pa.Table.from_batches(held), True)


def _finish(batches: Iterator, length: int) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        out = []
        for doc, text, lo, hi in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            text = text or b""
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, np.array(lo), 1)
            np.add.at(edge, np.array(hi) + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            out.append((doc, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        columns = zip(*out, strict=True) if out else ([],) * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, on request) for every row of `docs`.

    A byte goes if a string of `length` bytes over it also starts earlier: in a document of smaller id, or before it in
    the same one. Null texts have no bytes. Rows that repeat a doc_id with an equal text count as one document; rows that
    repeat it with different texts are an error of the input and may count as one. Other columns are ignored.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    sums = materialize(base.select("doc_id", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("print")), "text-sums")
    # equal texts: all but the first go whole, and only the first is looked into
    firsts = materialize(sums.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.first("print").alias("print")).select("doc_id", "print"), "first-copies")

    anchors = materialize(base.select(F.xxhash64("text").alias("print"), "text").mapInArrow(partial(_anchor_rows, length=length), "value long, print long, settled boolean"), "anchors")
    # values of several texts are told by an aggregate, so no task holds all rows of a common one
    open_ = anchors.where("not settled").select("value", "print")
    several = open_.groupBy("value").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).where("lo <> hi").select("value")
    shared = open_.join(several.hint("merge"), "value")
    wanted = materialize(shared.select("value", "print").union(anchors.where("settled").select("value", "print")).distinct(), "wanted")
    hot = wanted.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("value", F.lit(True).alias("hot"))
    hot = materialize(hot, "hot-anchors")
    discard(anchors)
    marked = wanted.join(hot, "value", "left").groupBy("print").agg(F.collect_list(F.struct("value", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("v"))
    per_doc = marked.join(firsts, "print").select("doc_id", F.col("v.value").alias("values"), F.col("v.hot").alias("hots"))
    schema = "kind int, key1 long, key2 long, doc_id long, a long, b long, bytes binary"
    looked = materialize(base.join(per_doc, "doc_id").select("doc_id", "text", "values", "hots").mapInArrow(partial(_candidates, length=length), schema), "candidates")
    release_shuffles(spark)

    stretches = looked.where("kind = 1").select(F.col("key1").alias("value"), "doc_id", "a", "bytes").repartition(shuffle_partitions(spark), "value").sortWithinPartitions("value")
    sorted_ = stretches.mapInArrow(partial(_sort_stretches, length=length), "doc_id long, a long, b long")
    # the first of equal strings is the first of the firsts of salted parts, so no window holds a hot string's rows
    met = looked.where("kind = 2").select("key1", "key2", "doc_id", "a", "b", F.pmod(F.xxhash64("doc_id", "a"), F.lit(SALTS)).alias("salt"))
    place = lambda *keys: F.dense_rank().over(Window.partitionBy("key1", "key2", *keys).orderBy("doc_id", "a"))
    met = met.withColumn("nth", place("salt"))
    leads = met.where("nth = 1").withColumn("lead", place()).where("lead > 1")
    met = met.where("nth > 1").select("doc_id", "a", "b").union(leads.select("doc_id", "a", "b"))
    gone = materialize(looked.where("kind = 0").select("doc_id", "a", "b").union(sorted_).union(met), "repeats")
    discard(looked)
    release_shuffles(spark)

    spans = materialize(gone.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("s")).select("doc_id", F.col("s.a").alias("lo"), F.col("s.b").alias("hi")), "repeat-lists")
    cut = base.join(spans, "doc_id").select("doc_id", "text", "lo", "hi").mapInArrow(partial(_finish, length=length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    rest = sums.join(spans.select("doc_id"), "doc_id", "left_anti").join(firsts.select("doc_id", F.lit(True).alias("first")), "doc_id", "left")
    copy = F.col("first").isNull() & (F.col("n_bytes") >= length)
    whole = rest.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"), copy.cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha")).alias("kept_sha256"), *([copy.alias("copy")] if with_text else []),
    )
    if not with_text:
        return cut.drop("kept").unionByName(whole)
    texts = whole.join(base, "doc_id").select(*(c for c in cut.columns if c != "kept"), F.when(F.col("copy"), F.lit(b"")).otherwise(F.col("text")).alias("kept"))
    return cut.unionByName(texts)
