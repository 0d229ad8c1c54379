"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in at most ``K`` of 64 bits agree on at least two of five blocks of bits. For each of the ten pairs
of blocks the pattern on those bits (a mask and its value) is the top node of an index: fingerprints meet only under a node
they share. Under a node they are sorted by Gray rank, so that neighbours share further bits; runs of ``LEAF`` become
leaves and runs of ``LEAF`` leaves upper nodes, each factored into the bits that all its members share. Two nodes whose shared
bits already differ in more than ``K`` places are pruned with all their members; below surviving pairs of leaves the
fingerprints themselves are compared, so nothing is approximate. A task links what it finds into components at once and
emits one row a linked fingerprint (never all pairs); components over all nodes follow by alternating large and small stars.

A top node with more than ``MOST`` fingerprints is dealt into cells, and each pair of cells meets in a task of its own.
Defined cases. Null or empty text, or one without words: fingerprint zero, linked like any other. Fewer words than a shingle:
the whole sequence is the shingle. Null ids: linked, but never a component's name while another id is there. Repeated
rows: same fingerprint, same component. Empty table: empty result. Extra columns are left alone.

The pipeline's stage (``drop_near_duplicates``) asks for more than three bits reach: all pairs of texts whose sets of five-word
shingles have a Jaccard similarity of ``SIMILARITY`` or more. The index proposes the texts whose fingerprints it links. But most such pairs differ in
about 10 of 64 bits, where blocks of bits no longer select, so MinHash bands propose more (a pair at the least similarity is missed with probability
3e-6, others less often), and only pairs whose exact similarity suffices are linked. Groups of a band meet in tasks that know what is linked already; the first
bands link most, so that later groups, which are compared in full, are those that still span several components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm.common import discard, released, stash

K = 3
SHINGLE = 3
SEED = 42
#: Of the pipeline's stage: words of a shingle, least similarity, MinHash bands and values in each.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
#: Bands that are linked before the others; most members of a band's group in a task's cell.
FIRST, CELL = 3, 500
#: Bits of the map of keys that share a band.
MAP_BITS = 24
LEAF = 32
MOST = 50_000
#: Where the five blocks of a fingerprint's bits begin and end.
BLOCKS = (0, 13, 26, 39, 52, 64)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
U64 = np.uint64


def digests(text: str, shingle: int) -> bytes:
    """The XXH64 of each shingle, in order; nothing without words."""
    words = text.encode().translate(LOWER).split()  # bytes split at the six ASCII white-space characters
    if not words:
        return b""
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    return b"".join([digest(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(shingle)))])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit set if it is set in over half of the shingles' XXH64 (repeats included); 0 without words."""
    return majority(digests(text, shingle))


def majority(hashes: bytes) -> int:
    """The fingerprint of shingles' XXH64."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    most = 2 * bits.sum(0, dtype=np.int64) > len(bits)
    return int.from_bytes(np.packbits(most).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id, fp`` (the 64 bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                found = np.array([fingerprint(t, shingle) for t in some.column(1).to_pylist()], U64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each number in the reflected Gray order: the prefix XOR of its bits."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> U64(k)
    return x


class Links:
    """Components over positions, by the smallest position reached."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = up


def _shared(fps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the bits that the members of each run share, and their value."""
    ones, some = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)
    return ~(ones ^ some), ones


def _near(mask_a, value_a, mask_b, value_b, k: int) -> np.ndarray:
    """Whether the bits that both nodes share differ in at most ``k`` places."""
    return np.bitwise_count((value_a ^ value_b) & mask_a & mask_b) <= k


def link_sorted(fps: np.ndarray, group: np.ndarray, k: int = K, leaf: int = LEAF) -> np.ndarray:
    """For fingerprints sorted by (group, Gray rank): the position of each one's component within its group."""
    n = len(fps)
    links = Links(n)
    if n < 2:
        return links.label
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    own = np.arange(n) - np.repeat(first, size)
    leaf_no = own // leaf
    for gap in range(1, min(leaf, int(size.max()))):  # within leaves, for all groups at once
        near = (group[gap:] == group[:-gap]) & (leaf_no[gap:] == leaf_no[:-gap]) & (np.bitwise_count(fps[gap:] ^ fps[:-gap]) <= k)
        at = np.flatnonzero(near)
        links.add(at, at + gap)
    for f, s in zip(first[size > leaf], size[size > leaf]):  # between leaves, under each node that has several
        leaves = np.arange(f, f + s, leaf)
        ends = np.minimum(leaves + leaf, f + s)
        masks, values = _shared(fps[f : f + s], leaves - f)
        uppers = np.arange(0, len(leaves), leaf)
        upper_masks = np.bitwise_and.reduceat(masks, uppers) & ~(np.bitwise_and.reduceat(values, uppers) ^ np.bitwise_or.reduceat(values, uppers))
        upper_values = values[uppers]
        for u in range(len(uppers)):
            for v in u + np.flatnonzero(_near(upper_masks[u], upper_values[u], upper_masks[u:], upper_values[u:], k)):
                left, right = np.arange(uppers[u], min(uppers[u] + leaf, len(leaves))), np.arange(uppers[v], min(uppers[v] + leaf, len(leaves)))
                close = _near(masks[left, None], values[left, None], masks[None, right], values[None, right], k) & (left[:, None] < right[None, :])
                for a, b in zip(*np.nonzero(close)):
                    x, y = leaves[left[a]], leaves[right[b]]
                    i, j = np.nonzero(np.bitwise_count(fps[x : ends[left[a]], None] ^ fps[None, y : ends[right[b]]]) <= k)
                    links.add(x + i, y + j)
    return links.label


def _masks() -> list[int]:
    spans = [((1 << (b - a)) - 1) << (64 - b) for a, b in zip(BLOCKS, BLOCKS[1:])]
    return [x | y for x, y in combinations(spans, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, k: int = K, most: int = MOST) -> DataFrame:
    """``a, b``: links that join all fingerprints (column ``fp``, distinct) at ``k`` or fewer differing bits; fewer than ten a fingerprint."""
    if k > len(BLOCKS) - 3:
        raise ValueError("two of the blocks must survive k differing bits")
    nodes = F.array(*[F.struct(F.lit(t).alias("node"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(_masks())])
    keyed = fps.select("fp", F.inline(nodes))
    hot = stash(keyed.groupBy("node", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most), "simhash-hot")
    split = keyed.join(hot, ["node", "key"])  # rare: nodes that are too large for a task
    cells = F.ceil(F.col("n") / most).cast("int")
    split = split.withColumn("own", F.pmod(F.xxhash64("fp"), cells).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cells - 1)))
    split = split.select("fp", "node", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    rest = keyed.join(hot, ["node", "key"], "left_anti").select("fp", "node", "key", F.lit(0).alias("low"), F.lit(0).alias("high"))
    where = ["node", "key", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit(rows: np.ndarray) -> pa.RecordBatch:
            fp = rows[:, 0].astype(U64)
            new = np.r_[False, (rows[1:, 1:] != rows[:-1, 1:]).any(1)]
            group = np.cumsum(new)
            by = np.lexsort((gray_rank(fp), group))
            fp, group = fp[by], group[by]
            root = link_sorted(fp, group, k)
            at = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(fp[at].astype(np.int64)), pa.array(fp[root[at]].astype(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(5)], 1)
            held.append(rows)
            last = np.flatnonzero((rows[:, 1:] != rows[-1, 1:]).any(1))
            if sum(map(len, held)) >= 100_000 and len(last):  # up to the last whole group
                cut = last[-1] + 1
                done = np.concatenate([*held[:-1], rows[:cut]])
                held = [rows[cut:]]
                yield emit(done)
        if held and sum(map(len, held)):
            yield emit(np.concatenate(held))

    met = rest.unionByName(split).repartition(*where).sortWithinPartitions(*where)
    return met.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 50, rounds: int | None = None) -> DataFrame:
    """``node, root`` for all nodes of the links ``a, b``; root is the smallest node of the component.

    With ``rounds``, after so many: then a root is a smaller node of the component, not always the smallest.

    Large star: each node hands its larger neighbours to the smallest one around it; small star: its smaller ones. Both keep
    components whole and end in stars after about log(n) rounds. Each round is written, so none depends on a lost executor.
    """
    edges = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    seen = None
    for k in range(most_rounds):
        if k == rounds:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, edges = edges, stash(small.distinct(), "links")
        discard(edges.sparkSession, before.stash_path)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """``id, fp, component`` of each row; component is the smallest id that links reach, itself included."""
    marked = stash(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    each = stash(marked.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    found = components(links(each.select("fp"), k))
    rooted = each.join(found, each["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(names, "root").select("fp", "component")
    return marked.join(named, "fp").select("id", "fp", "component")


def hex16(fp) -> F.col:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def shingle_set(text: str, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(np.frombuffer(digests(text, shingle), U64))


def _set_key(found: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(found.tobytes(), SEED))


_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 64, (3, BANDS * ROWS), np.uint64) | U64(1)


def bands(found: np.ndarray) -> np.ndarray:
    """One value a MinHash band; sets that agree in a band agree in all its minima (and in its number)."""
    least = np.full(BANDS * ROWS, ~U64(0))
    for a in range(0, len(found), 1024):
        np.minimum(least, (np.multiply.outer(_RANDOM[0], found[a : a + 1024]) + _RANDOM[1][:, None]).min(1), out=least)
    mixed = ((least ^ least >> U64(31)) * _RANDOM[2]).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)
    return mixed ^ np.arange(1, BANDS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id, key, fp, bands`` of each row; key names the set of shingles, fp is their fingerprint, and a set without members has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                keys, fps, found = [], [], []
                for t in some.column(1).to_pylist():
                    hashes = digests(t, shingle)
                    members = np.unique(np.frombuffer(hashes, U64))
                    keys.append(_set_key(members))
                    fps.append(_signed(majority(hashes)))
                    found.append(bands(members).astype(np.int64) if len(members) else np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(keys, pa.int64()), pa.array(fps, pa.int64()), listed], names=["id", "key", "fp", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "id long, key long, fp long, bands array<long>")


def fingerprint_groups(marked: DataFrame) -> DataFrame:
    """``key, no, band`` with one value for all sets whose fingerprints ``links`` joins: the index's proposals, as a group like those of a band."""
    each = marked.filter(F.size("bands") > 0).select("key", "fp").distinct()
    found = components(links(each.select("fp").distinct()))
    root = F.coalesce("root", "fp")
    return each.join(found, each["fp"] == found["node"], "left").select("key", F.lit(-1).alias("no"), F.xxhash64(F.lit("fingerprint"), root).alias("band"))


def sets_of(docs: DataFrame, keys: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``key, members`` of the rows whose key may be among ``keys``, once a key."""
    bit = F.col("key").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = keys.select((bit / 64).cast("int").alias("at"), F.expr("shiftleft(1L, cast(key & 63L AS int))").alias("one")).groupBy("at").agg(F.bit_or("one").alias("bits"))
    table = np.zeros((1 << MAP_BITS) // 64, np.int64)
    for r in words.collect():  # at most a row a word of the map
        table[r["at"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(table.view(U64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in released(batches):
            for a in range(0, batch.num_rows, 512):
                kept = []
                for t in batch.column(0).slice(a, 512).to_pylist():
                    found = shingle_set(t, shingle)
                    low = (key := _set_key(found)) & ((1 << MAP_BITS) - 1)
                    if int(known[low >> 6]) >> (low & 63) & 1:
                        kept.append((key, found.tobytes()))
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.binary())], names=["key", "members"])

    found = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "key long, members binary")
    return found.join(keys, "key", "left_semi").dropDuplicates(["key"])


def link_similar(sets: list[np.ndarray], label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join all sets of the group whose Jaccard similarity suffices; sets with one label are joined already."""
    label, sizes, links_ = label.copy(), np.array([len(x) for x in sets]), []
    for i in range(len(sets) - 1):
        size = sizes[i + 1 :]
        js = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & (np.minimum(size, sizes[i]) / np.maximum(size, sizes[i]) >= similarity))
        for a in range(0, len(js), 256):
            some = js[a : a + 256]
            flat = np.concatenate([sets[j] for j in some])
            hit = sets[i][np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)] == flat
            common = np.add.reduceat(hit, np.r_[0, np.cumsum(sizes[some])[:-1]], dtype=np.int64)
            for j in some[common / (sizes[i] + sizes[some] - common) >= similarity]:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    links_.append((i, int(j)))
    return links_


def _similar(shared: DataFrame, sets: DataFrame, similarity: float, cell: int, whole: bool) -> DataFrame:
    """``a, b``: links within the groups of ``shared`` (key, band, part) that span several parts.

    A group larger than ``cell`` is dealt into cells. Unless ``whole``, each cell is alone. Else the group's largest part, which
    is joined already, is dealt into cells of its own: they meet the cells of all other parts, which also meet each other, so that
    a group of n members with o outside the largest part costs n * o comparisons and no member travels more than o / cell times.
    """
    groups = shared.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("first"), F.max("part").alias("last")).filter("first != last")
    spread = F.xxhash64("key", "band")
    if whole:
        sizes = shared.join(groups.select("band"), "band").groupBy("band", "part").agg(F.count(F.lit(1)).alias("k"))
        groups = sizes.groupBy("band").agg(F.sum("k").alias("n"), F.max(F.struct("k", "part")).alias("most"))
        counts = groups.select("band", F.col("most.part").alias("main"), F.ceil(F.col("most.k") / cell).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("most.k")) / cell).cast("int").alias("others"))
        dealt = shared.join(counts, "band")
        # cells 0, 1, ... hold the others; the largest part's follow
        dealt = dealt.withColumn("own", F.when(F.col("part") == F.col("main"), F.col("others") + F.pmod(spread, "mains")).otherwise(F.pmod(spread, "others")).cast("int"))
        meets = F.when(F.col("own") < F.col("others"), F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") - 1))
        dealt = dealt.withColumn("other", F.explode(meets))
    else:
        cells = F.ceil(F.col("n") / cell).cast("int")
        dealt = shared.join(groups.select("band", "n"), "band").withColumn("own", F.pmod(spread, cells).cast("int")).withColumn("other", F.col("own"))
    dealt = dealt.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "key", "part").join(sets, "key")
    where = ["band", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def emit() -> pa.RecordBatch:
            found = link_similar([np.frombuffer(x, U64) for _, _, x in held], np.array([p for _, p, _ in held]), similarity)
            return pa.RecordBatch.from_arrays([pa.array([held[x][0] for x, _ in found], pa.int64()), pa.array([held[y][0] for _, y in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for *group, key, part, members in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if group != now and held:
                    yield emit()
                    held = []
                now = group
                held.append((key, part, members))
        if held:
            yield emit()

    met = dealt.select(*where, "key", "part", "members").repartition(*where).sortWithinPartitions(*where)
    return met.mapInArrow(run, "a long, b long")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """``id, key, component`` of each row; component is the smallest id that links of ``similarity`` reach, itself included."""
    marked = stash(signatures(docs, id_col, text_col, shingle), "signatures")
    banded = marked.select("key", F.posexplode("bands").alias("no", "band")).unionByName(fingerprint_groups(marked)).distinct()
    groups = banded.groupBy("band").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first != last")
    shared = stash(banded.join(groups.select("band"), "band"), "shared-bands")
    sets = stash(sets_of(docs, shared.select("key").distinct(), text_col, shingle), "shared-sets")
    near = stash(_similar(shared.filter(F.col("no") < FIRST).select("key", "band", F.col("key").alias("part")), sets, similarity, cell, False), "similar")
    parts = components(near, rounds=3)
    rest = shared.join(parts, shared["key"] == parts["node"], "left").select("key", "band", F.coalesce("root", "key").alias("part"))
    found = components(near.unionByName(stash(_similar(rest, sets, similarity, cell, True), "similar")))
    each = marked.groupBy("key").agg(F.min("id").alias("first"))
    rooted = each.join(found, each["key"] == found["node"], "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return marked.select("id", "key").join(rooted.join(names, "root").select("key", "component"), "key").select("id", "key", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of similar texts; rows without an id stay, as nothing names them."""
    keep = similar_texts(docs, id_col, text_col, shingle, similarity).filter("id = component").select(F.col("id").alias("__keep")).distinct()
    named = docs.filter(F.col(id_col).isNotNull())
    one = named.join(keep, named[id_col] == keep["__keep"], "left_semi").dropDuplicates([id_col, text_col])
    return one.unionByName(docs.filter(F.col(id_col).isNull()))
