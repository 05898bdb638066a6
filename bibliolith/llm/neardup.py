"""Near-duplicate documents: MinHash bands propose pairs, odd sketches sift them, full shingle sets confirm them.

A document's MinHash samples are folded into a parity bitmap (an odd sketch): sample (i, value) flips one bit. The XOR of
two sketches flips a bit for every sample that differs, so its population count x gives the similarity as
1 + n / (4 k) * ln(1 - 2 x / n) with a small error just where it matters, at high similarities.

A band bucket is not expanded into its pairs. Its members are compared with its least and its greatest member by sketch,
at most two pairs for each document and band; documents whose sketches agree form clusters. Only buckets that still
hold several clusters are compared member by member across them, and only to merge clusters. So every proposed pair
that the sketches let pass lies in one cluster. A cluster of one tile is confirmed at once, all its pairs as a product of its
incidence matrix. Larger ones first confirm one pair for each document, which leaves few components; sketches of
different components then tell which documents still have to meet, tile by tile, and only their texts travel.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import binary_batch, discard, materialize, mix64, release_shuffles, slices, small_batches, span_hashes

#: MinHash samples as bands of rows: a pair at similarity 0.75 misses all bands with a chance of (1 - 0.75 ** 4) ** 32 < 6e-6.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bits of the odd sketch, and the estimate below which a pair isn't confirmed: 4 in 10,000 pairs at 0.75 are, 3 in 100,000 at 0.78.
SKETCH_BITS, LEAST_ESTIMATE = 256, 0.55
#: Documents and shingles of a tile, which one task holds against another tile.
TILE, TILE_SHINGLES = 1024, 150_000
#: Bits of the bitmap that sifts ids before an exact join, as a power of two: 8 MB.
SIEVE_LOG = 26
#: The multipliers of the MinHash functions, drawn once from a fixed seed.
_FACTORS = np.random.default_rng(20_250_101).integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of a batch: runs of bytes that are no blank, within a row."""
    word = np.concatenate(([False], ~_BLANK[data], [False]))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | first))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | first))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a batch, sorted by row, then hash, and the n + 1 offsets of the rows.

    A row of fewer words than `width` has its whole word sequence as its one shingle; a row without words has none.
    """
    n = len(offsets) - 1
    starts, ends, row = word_spans(data, offsets)
    h = span_hashes(_LOWER[data], starts, ends)
    count = np.bincount(row, minlength=n)
    begin = np.concatenate(([0], np.cumsum(count)))
    g, whole = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
    left = begin[row + 1] - np.arange(len(h))
    for k in range(width):
        own = left > k
        g[own] = mix64(g[own] * _STEP + h[np.flatnonzero(own) + k])
    whole[begin[:-1][count > 0]] = True
    keep = (left >= width) | (whole & (count[row] < width))
    g, row = g[keep], row[keep]
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(n + 1))


def _signatures(batches: Iterator, width: int) -> Iterator:
    for batch in batches:
        data, offsets = binary_batch(batch.column(1))
        for a, b in slices(offsets, 1 << 20):
            part = offsets[a : b + 1]
            g, at = shingle_sets(data[part[0] : part[-1]], part - part[0], width)
            size = np.diff(at)
            full = np.flatnonzero(size)
            bands, sketch = np.zeros((b - a, BANDS), np.uint64), np.zeros((b - a, SKETCH_BITS), bool)
            fp = np.zeros((2, b - a), np.uint64)
            if len(full):
                cuts = at[full]
                for k in range(2):
                    fp[k, full] = np.add.reduceat(mix64(g + np.uint64(k)), cuts)
                at_row = np.arange(len(full))
                flips = np.zeros((len(full), SKETCH_BITS), bool)
                own = np.zeros((len(full), BANDS), np.uint64)
                for i, factor in enumerate(_FACTORS):
                    low = mix64(np.minimum.reduceat(g * factor, cuts) + np.uint64(i))
                    flips[at_row, (low % np.uint64(SKETCH_BITS)).astype(np.int64)] ^= True
                    own[:, i // ROWS] = mix64(own[:, i // ROWS] * _STEP + low)
                bands[full], sketch[full] = own, flips
            words = np.packbits(sketch, axis=1, bitorder="little").view("<i8")
            keys = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(size), *(pa.array(x.view(np.int64)) for x in fp), keys.cast(pa.list_(pa.int64())), *(pa.array(words[:, k].copy()) for k in range(4))],
                ["doc_id", "n_shingles", "fp1", "fp2", "bands", "s0", "s1", "s2", "s3"],
            )


def _estimate(a: str, b: str) -> Column:
    """The similarity that two odd sketches show; very low where more than half of the bits differ."""
    differ = sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(4)), F.lit(0))
    return F.lit(1.0) + SKETCH_BITS / (4 * SAMPLES) * F.ln(F.greatest(1 - 2 * differ / SKETCH_BITS, F.lit(1e-9)))


def _confirm(batches: Iterator, width: int, num: int, den: int) -> Iterator:
    last: tuple = (None, None)
    for batch in batches:
        ids, other, text, its = (batch.column(k) for k in range(4))
        out: list[int] = []
        for k in range(len(batch)):
            if last[0] is None or last[0] != other[k].as_py():
                last = (other[k].as_py(), shingle_sets(*binary_batch(its.slice(k, 1)), width)[0])
            own = shingle_sets(*binary_batch(text.slice(k, 1)), width)[0]
            both = len(own) + len(last[1]) - len(np.union1d(own, last[1]))
            if den * both >= num * (len(own) + len(last[1]) - both) and both:
                out.append(k)
        keep = pa.array(out, pa.int64())
        yield pa.RecordBatch.from_arrays([ids.take(keep), other.take(keep)], ["src", "dst"])


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Of (src, dst) pairs, those whose full shingle sets have a Jaccard similarity of num / den or more."""
    a, b = (texts.select(F.col("id").alias(k), F.col("text").alias(f"{k}_text")) for k in ("src", "dst"))
    full = pairs.hint("merge").join(a, "src").hint("merge").join(b, "dst").select("src", "dst", "src_text", "dst_text")
    return full.mapInArrow(partial(_confirm, width=width, num=num, den=den), "src long, dst long")


def _labels(pairs: DataFrame, name: str) -> DataFrame:
    """(node, component) by two steps from each src to its least dst: nodes of one label are connected, though not the other way round."""
    up = materialize(pairs.groupBy("src").agg(F.min("dst").alias("dst")), name)
    a, b = up.alias("a"), up.alias("b")
    return a.join(b, F.col("a.dst") == F.col("b.src"), "left").select(F.col("a.src").alias("node"), F.coalesce("b.dst", "a.dst").alias("component"))


def _with_component(ids: DataFrame, components: DataFrame, name: str) -> DataFrame:
    return ids.join(components.select(F.col("node").alias("id"), F.col("component").alias(name)), "id", "left").withColumn(name, F.coalesce(name, "id"))


def _close(a: str, b: str, num: int, den: int) -> Column:
    """Can these two be similar: by their sketches, and by their sizes."""
    least, most = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return (_estimate(a, b) >= LEAST_ESTIMATE) & (den * least >= num * most)


def _forest(src: np.ndarray, dst: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of links (between components a and b) that join all components that the links join, none twice."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for k in range(len(src)):
        x, y = root(int(a[k])), root(int(b[k]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append(k)
    return out


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first and of the second tile; a tile that meets itself has its rows in both."""
    p = np.array(table.column("p").to_pylist())
    return np.flatnonzero(p == table.column("p1")[0].as_py()), np.flatnonzero(p == table.column("p2")[0].as_py())


def _sketch_matches(table: pa.Table, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of the first and j of the second tile, of different components, that sketches and sizes let pass."""
    i, j = _sides(table)
    words = np.stack([table.column(f"s{k}").to_numpy() for k in range(4)], 1).astype("<i8")
    signs = np.unpackbits(words.view(np.uint8), axis=1).astype(np.float32) * 2 - 1
    size, comp = table.column("n_shingles").to_numpy(), table.column("comp").to_numpy()
    differ = (SKETCH_BITS - signs[i] @ signs[j].T) / 2
    most = SKETCH_BITS / 2 * (1 - np.exp((LEAST_ESTIMATE - 1) * 4 * SAMPLES / SKETCH_BITS))  # bits that may differ at the least estimate
    a, b = np.nonzero((differ <= most + 0.01) & (comp[i][:, None] != comp[j][None, :]))
    a, b = i[a], j[b]
    fits = (den * size[a] >= num * size[b]) & (den * size[b] >= num * size[a])
    return a[fits], b[fits]


def _cluster_links(table: pa.Table, num: int, den: int) -> pa.Table:
    """Pairs of components that sketches of the two tiles join: a spanning forest of them."""
    a, b = _sketch_matches(table, num, den)
    comp = table.column("comp").to_numpy()
    pairs = np.unique(np.stack([np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    keep = _forest(pairs[:, 0], pairs[:, 1], pairs[:, 0], pairs[:, 1])
    return pa.table({"src": pa.array(pairs[keep, 0], pa.int64()), "dst": pa.array(pairs[keep, 1], pa.int64())})


def _to_confirm(table: pa.Table, num: int, den: int) -> pa.Table:
    """The rows of two tiles that have a partner in the other one; only their texts are fetched."""
    a, b = _sketch_matches(table, num, den)
    return table.take(pa.array(np.union1d(a, b), pa.int64())).select(["g", "p1", "p2", "p", "id", "comp"])


def _tile_links(table: pa.Table, width: int, num: int, den: int) -> pa.Table:
    """Links that join the components of two tiles: a spanning forest of the confirmed pairs of different components."""
    if table.num_rows == 0:
        return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64())})
    table = table.sort_by("id").combine_chunks()
    ids, comp = table.column("id").to_numpy(), table.column("comp").to_numpy()
    i, j = _sides(table)
    g, at = shingle_sets(*binary_batch(table.column("text").chunk(0)), width)
    size = np.diff(at)
    row = np.repeat(np.arange(len(ids)), size)
    _, column, count = np.unique(g, return_inverse=True, return_counts=True)
    often = count > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    same = len(i) == len(j) and bool((i == j).all())
    in_i, in_j = np.full(len(ids), -1), np.full(len(ids), -1)
    in_i[i], in_j[j] = np.arange(len(i)), np.arange(len(j))
    both = np.zeros((len(i), len(j)), np.float32)
    for low in range(0, int(often.sum()), 4096):  # by column ranges, so the matrices stay small
        s, e = np.searchsorted(column, (low, low + 4096))
        left = np.zeros((len(i), 4096), np.float32)
        own = in_i[row[s:e]] >= 0
        left[in_i[row[s:e]][own], column[s:e][own] - low] = 1
        if same:
            right = left
        else:
            right = np.zeros((len(j), 4096), np.float32)
            own = in_j[row[s:e]] >= 0
            right[in_j[row[s:e]][own], column[s:e][own] - low] = 1
        both += left @ right.T
    both = both.astype(np.int64)
    union = size[i][:, None] + size[j][None, :] - both
    linked = (den * both >= num * union) & (both > 0) & (comp[i][:, None] != comp[j][None, :])
    a, b = np.nonzero(linked)
    keep = _forest(a, b, comp[i][a], comp[j][b])
    return pa.table({"src": pa.array(ids[i][a[keep]], pa.int64()), "dst": pa.array(ids[j][b[keep]], pa.int64())})


def _deal(rows: DataFrame, num: int, den: int) -> DataFrame:
    """The rows (g, id, comp, n_shingles, ...) of big groups, dealt to the pairs of tiles (g, p1, p2) in which they may find a partner.

    A tile holds about TILE documents and TILE_SHINGLES shingles at most, of one size class: sizes num / den apart are in the
    same or in neighbouring classes, so other pairs of tiles never meet. A component that fills a tile has tiles of its own,
    which aren't held against each other. Nothing gathers a group in one task: all counts are aggregates that are joined back.
    """
    step = float(np.log(den / num)) + 1e-9
    weight = rows.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    own = weight.where((F.col("n") >= TILE) | (F.col("w") >= TILE_SHINGLES)).select("g", "comp", F.col("comp").cast("string").alias("own"))
    placed = rows.join(own, ["g", "comp"], "left").withColumn("own", F.coalesce("own", F.lit(""))).withColumn("size_class", F.floor(F.ln("n_shingles") / step).cast("int"))
    units = placed.groupBy("g", "own", "size_class").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    units = materialize(units.select("g", "own", "size_class", F.ceil(F.greatest(F.col("n") / TILE, F.col("w") / TILE_SHINGLES)).cast("int").alias("tiles")), "tile-units")
    name = F.concat_ws("/", "size_class", "own", F.pmod(F.xxhash64("id"), F.col("tiles")))
    tiled = placed.join(units, ["g", "own", "size_class"]).withColumn("p", name).drop("own", "size_class", "tiles")
    a, b = units.alias("a"), units.alias("b")
    later = F.struct("b.size_class", "b.own") >= F.struct("a.size_class", "a.own")
    meet = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("b.size_class") - F.col("a.size_class")).between(0, 1) & ((F.col("a.own") != F.col("b.own")) | (F.col("a.own") == "")) & later)
    all_tiles = lambda k: F.transform(F.sequence(F.lit(0), F.col(f"{k}.tiles") - 1), lambda t: F.concat_ws("/", f"{k}.size_class", f"{k}.own", t))
    pairs = meet.select(F.col("a.g").alias("g"), F.explode(all_tiles("a")).alias("p1"), all_tiles("b").alias("ps"), (F.struct("a.size_class", "a.own") == F.struct("b.size_class", "b.own")).alias("twin"))
    pairs = pairs.select("g", "p1", F.explode("ps").alias("p2"), "twin").where("not twin or p1 <= p2")
    sides = pairs.select("g", "p1", "p2", F.explode(F.array_distinct(F.array("p1", "p2"))).alias("p"))
    return tiled.join(sides, ["g", "p"])


def _sifted(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `texts` whose id is in `ids` and a few others, without a shuffle of either.

    The ids set bits in a bitmap of 2 ** SIEVE_LOG bits, whatever the corpus; its 4 KB parts are broadcast, 8 MB in all. It
    only saves the exact join that follows from shuffling texts that can't match.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(1 << SIEVE_LOG))
    part, bit = (place / 32768).cast("int"), (place % 32768).cast("int")
    parts = ids.select(part.alias("_part"), bit.cast("long").alias("_bit")).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) > 0
    return texts.withColumn("_part", part).join(F.broadcast(parts), "_part").where(found).drop("_part", "_bits")


def _clusters(sketches: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The star pairs that sketches let pass, and (node, component): the clusters that hold every proposed pair that they let pass."""
    members = sketches.select("id", F.explode("bands").alias("key"))
    buckets = materialize(members.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    shared = materialize(members.join(buckets, "key"), "bucket-members")
    discard(buckets)
    light = sketches.drop("bands")
    stars = shared.select("id", F.explode(F.array("lo", "hi")).alias("dst")).where("id <> dst").select(F.greatest("id", "dst").alias("src"), F.least("id", "dst").alias("dst")).distinct()
    stars = stars.join(light.alias("a"), F.col("src") == F.col("a.id")).join(light.alias("b"), F.col("dst") == F.col("b.id")).where(_close("a", "b", num, den))
    stars = materialize(stars.select("src", "dst", _estimate("a", "b").alias("estimate")), "star-pairs")

    # buckets that hold several labels: do sketches of different labels agree?
    placed = materialize(_with_component(shared.select("id", "key", "n"), _labels(stars, "star-labels"), "cluster"), "bucket-clusters")
    mixed = materialize(placed.groupBy("key").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b")).where("a <> b").select("key"), "open-buckets")
    rest = materialize(placed.join(mixed, "key").join(light, "id"), "open-members")
    discard(shared, placed, mixed)
    few = rest.where(F.col("n") <= TILE)
    across = few.alias("a").join(few.alias("b"), [F.col("a.key") == F.col("b.key"), (F.col("a.cluster") < F.col("b.cluster")) & _close("a", "b", num, den)])
    across = across.select(F.col("a.cluster").alias("src"), F.col("b.cluster").alias("dst"))
    many = rest.where(F.col("n") > TILE)
    if not many.isEmpty():
        dealt = _deal(many.withColumnsRenamed({"key": "g", "cluster": "comp"}).drop("n"), num, den)
        across = across.union(dealt.groupBy("g", "p1", "p2").applyInArrow(lambda t: _cluster_links(t, num, den), "src long, dst long"))
    across = materialize(across.distinct(), "cross-clusters")
    discard(rest)
    return stars, materialize(connected_components(stars.select("src", "dst").union(across)), "clusters")


def _wide_links(members: DataFrame, stars: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The links of clusters of several tiles.

    Each document's best star pair is confirmed first, which joins most of a cluster. Sketches then tell which documents of
    different components still have to meet, and only their texts travel to the tiles.
    """
    # an inner join: a semi join would be pushed below the sieve
    texts = materialize(_sifted(texts, members).join(members.select("id").hint("merge"), "id"), "wide-texts")
    best = stars.join(members.select(F.col("id").alias("src")), "src").groupBy("src").agg(F.max_by("dst", F.struct("estimate", "dst")).alias("dst"))
    links = materialize(_confirmed(best, texts, width, num, den), "star-links")
    release_shuffles(members.sparkSession)
    rows = materialize(_with_component(members, _labels(links, "link-labels"), "comp").withColumnRenamed("cluster", "g"), "wide-members")
    several = materialize(rows.groupBy("g").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("g"), "open-clusters")
    if several.isEmpty():
        return links
    dealt = _deal(rows.join(several, "g"), num, den)
    schema = "g long, p1 string, p2 string, p string, id long, comp long"
    needed = materialize(dealt.groupBy("g", "p1", "p2").applyInArrow(lambda t: _to_confirm(t, num, den), schema), "to-confirm")
    more = needed.hint("merge").join(texts, "id").groupBy("g", "p1", "p2").applyInArrow(lambda t: _tile_links(t, width, num, den), "src long, dst long")
    out = materialize(links.union(more), "wide-links")
    discard(texts, links, rows, several, needed)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs` (doc_id, text, ...).

    Documents are linked when their sets of `width`-word shingles have a Jaccard similarity of num / den or more; a
    component is named by its least doc_id, which is the one kept. Null, empty and blank texts have no shingles and are
    linked with nothing. Rows that repeat a doc_id count as one document if their texts are equal and must not differ.
    Other columns are ignored; an empty table gives an empty result. The bands and the sketch bound suit num / den of 0.7
    and more: of pairs at 0.75 about 4 in 10,000 are lost to the sketch and 6 in a million to the bands (400,000 simulated pairs).
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    schema = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, s0 long, s1 long, s2 long, s3 long"
    sigs = materialize(base.mapInArrow(partial(_signatures, width=width), schema), "signatures")

    # equal sets are one vertex: its least document stands for it
    same = ["fp1", "fp2", "n_shingles"]
    firsts = materialize(sigs.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep")), "set-reps")
    reps = sigs.join(firsts.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sketches = materialize(reps.select(F.col("doc_id").alias("id"), "n_shingles", "bands", "s0", "s1", "s2", "s3"), "sketches")
    stars, clusters = _clusters(sketches, num, den)

    texts = base.select(F.col("doc_id").alias("id"), "text")
    members = sketches.drop("bands").join(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id")
    sizes = members.groupBy("cluster").agg(F.sum("n_shingles").alias("w"), F.count(F.lit(1)).alias("n")).select("cluster", ((F.col("w") > TILE_SHINGLES) | (F.col("n") > TILE)).alias("wide"))
    members = materialize(members.join(sizes, "cluster"), "cluster-members")
    small, wide = members.where("not wide"), members.where("wide").drop("wide")
    dealt = _sifted(texts, small).join(small.select("id", "cluster").hint("merge"), "id")
    dealt = dealt.select("cluster", *(F.lit("").alias(p) for p in ("p", "p1", "p2")), "id", F.col("id").alias("comp"), "text")
    links = materialize(dealt.groupBy("cluster").applyInArrow(lambda t: _tile_links(t, width, num, den), "src long, dst long"), "cluster-links")
    release_shuffles(spark)
    if not wide.isEmpty():
        links = links.union(_wide_links(wide, stars, texts, width, num, den))

    final = materialize(connected_components(links), "components")
    of_rep = firsts.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    of_set = materialize(of_rep, "set-components")
    discard(sketches, stars, clusters, members, firsts, final)
    out = sigs.select("doc_id", *same).join(of_set, same, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
