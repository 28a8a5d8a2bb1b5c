"""SimHash near-dedup with pivot distance tables.

Fingerprints that may be close are dealt into blocks: a fingerprint of b bit groups that differs from another in at
most d bits agrees with it on b - d groups, so every choice of that many groups gives a key (exact); for wide
fingerprints, bands of bits give the keys (recall as stated), links only propose, and shared shingles decide. In a block, each member's Hamming distances to many
reference fingerprints make its row of a pivot table; a pair whose rows differ by more than the bound in any
coordinate is discarded by the triangle inequality; survivors are verified by their own distance. References are fixed
ones, and in blocks of more than a dozen members of the block: members near one are linked to it at once. A block emits a spanning forest of its links,
never all pairs. Blocks above LIMIT are cut into tiles, and every pair of tiles is one task's work.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import dropping_shuffles, materialise, small_batches
from lodestone.llm.graph import components

#: Members of a block or tile, at most; references of a block; rows of a slab of pairs.
LIMIT, REFERENCES, SLAB = 8192, 24, 1 << 16
#: Bit of a block's second key from which on its band's number stands; tiles of the block stand below.
BAND_PLACE = 44


def _multiplier(k: int) -> int:
    """An odd number by rule, to make further 64-bit words from a shingle's hash."""
    return xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42) | 1


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of so many words, A-Z in lower case, joined by spaces; of all words where there are fewer."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(tokens) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist())
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(tokens) - words + 1)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits that are set in over half of the rows (none: zero). hashes: rows by words; returns one value for each word."""
    n, words = hashes.shape
    counts = np.zeros(64 * words, np.int64)
    for a in range(0, n, 255):  # a byte holds the sum of 255 bits
        part = np.ascontiguousarray(hashes[a : a + 255], "<u8").view(np.uint8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8")


def wide_fingerprint(hashes: np.ndarray, count: int) -> np.ndarray:
    """count 64-bit words: the majority bits of the hashes times odd multipliers, folded."""
    first = np.array([_multiplier(k) for k in range(2 * count)], np.uint64)
    mixed = hashes[:, None] * first[None, :count]
    mixed ^= mixed >> np.uint64(32)
    mixed *= first[None, count:]
    mixed ^= mixed >> np.uint64(29)
    return majority(mixed)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


class _Forest:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def flatten(self) -> None:
        while (nxt := self.root[self.root]).tobytes() != self.root.tobytes():
            self.root = nxt

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Links that joined two trees."""
        self.flatten()
        apart = self.root[a] != self.root[b]
        made = []
        for i, j in zip(a[apart].tolist(), b[apart].tolist()):
            x, y = self.find(i), self.find(j)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                made.append((i, j))
        return made


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def reference_table(prints: np.ndarray) -> np.ndarray:
    """Distances of each member to REFERENCES fixed reference fingerprints, made by rule."""
    fixed = np.array([[_multiplier(1 << 20 | r * prints.shape[1] + w) for w in range(prints.shape[1])] for r in range(REFERENCES)], np.uint64)
    return np.stack([_distance(prints, f[None, :]) for f in fixed], axis=1).astype(np.int16)


def _near_pairs(prints: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Which of the pairs (a, b) are links: those whose table rows differ too much in a coordinate go unseen."""
    kept = np.flatnonzero((np.abs(table[a] - table[b]) <= bound).all(axis=1))
    return kept[_distance(prints[a[kept]], prints[b[kept]]) <= bound]


def _exact_links(texts: list[str], words: int, likeness: float):
    """A function of pairs (a, b) of texts: which of them have the likeness on the sets of their shingles (64-bit hashes)."""
    sets = [np.unique(shingle_hashes(t.encode(), words)) for t in texts]
    sizes = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    known, codes = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(known), bool)

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good = np.minimum(sizes[a], sizes[b]) >= likeness * np.maximum(sizes[a], sizes[b]) - 1e-9
        at = np.flatnonzero(good & (sizes[a] > 0) & (sizes[b] > 0))
        good[:] = False
        for part in np.split(at, np.flatnonzero(np.diff(a[at])) + 1):  # pairs in a row that share a
            for k in range(0, len(part), 1024):
                rows = part[k : k + 1024]
                x, y = a[rows[0]], b[rows]
                own = codes[starts[x] : starts[x] + sizes[x]]
                ends = np.cumsum(sizes[y])
                places = np.arange(ends[-1]) + np.repeat(starts[y] - ends + sizes[y], sizes[y])
                marked[own] = True
                common = np.add.reduceat(marked[codes[places]], ends - sizes[y], dtype=np.int64)
                marked[own] = False
                good[rows] = common >= likeness * (sizes[x] + sizes[y] - common) - 1e-9
        return good

    return run


def agree_before(a: np.ndarray, b: np.ndarray, band: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs of prints agree on all bytes of a band that starts before theirs, so that they met there already."""
    same = np.ascontiguousarray(a ^ b, "<u8").view(np.uint8) == 0
    wide = -(-bits // 8) + (BAND_STEP % 8 > 0)
    out = np.zeros(len(same), bool)
    for j in range(same.shape[1] - wide + 1):
        out |= same[:, j : j + wide].all(axis=1) & (j < band * BAND_STEP // 8)
    return out


def block_links(prints: np.ndarray, bound: int, exact=None, trees: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of all links of a block. prints: members by words, in an order of chance; the first ones are references.

    exact: a function of two arrays of members, which of these pairs are links; without it the bound decides.
    trees: numbers of members, equal ones for those joined already, whose links aren't sought again.
    """
    n = len(prints)
    forest, out = _Forest(n), []
    if trees is not None:
        _, first, inverse = np.unique(trees, return_index=True, return_inverse=True)
        forest.root = first[inverse]
        if len(first) == 1:
            return out
    table = np.zeros((n, min(REFERENCES, n)), np.int16)
    for at in range(table.shape[1]):
        table[:, at] = _distance(prints, prints[at][None, :])
        near = np.flatnonzero(table[:, at] <= bound)
        if exact:
            near = near[forest.root[near] != forest.root[at]]
            near = near[exact(np.full(len(near), at), near)]
        out += forest.join(np.full(len(near), at), near)
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0]
    ends = np.searchsorted(first, first + bound, side="right")
    start = 0
    while start < n:
        sizes = ends[start:] - np.arange(start, n) - 1
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes), SLAB)))
        rows = np.arange(start, min(stop, n))
        many = ends[rows] - rows - 1
        i = np.repeat(rows, many)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        a, b = order[i], order[j]
        forest.flatten()
        keep = forest.root[a] != forest.root[b]
        a, b = a[keep], b[keep]
        for r in range(1, table.shape[1]):  # discard by the largest coordinate difference
            if not len(a):
                break
            keep = np.abs(table[a, r] - table[b, r]) <= bound
            a, b = a[keep], b[keep]
        if len(a):
            keep = _distance(prints[a], prints[b]) <= bound
            a, b = a[keep], b[keep]
            if exact:
                keep = exact(a, b)
                a, b = a[keep], b[keep]
            out += forest.join(a, b)
        start = min(stop, n)
    return out


def _linker(words: int, bound: int, exact: tuple[int, float] | None = None, bits: int = 0):
    """Arrow kernel over rows sorted by key: node, key, p0 .. p(words - 1), and with exact (words of a shingle, likeness), text. Small blocks are compared together, larger ones each by itself.

    A column tree (null: the node) tells which nodes are joined already: links are between trees, and only new ones. With bits, keys are of bands of so many bits: a link whose ends agree on an earlier band isn't given again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def emit(keys, trees, prints, *texts) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            sizes = np.diff(np.append(cut, len(keys)))
            a_out, b_out = [], []
            small = (sizes > 1) & (sizes <= 12)
            table = reference_table(prints) if small.any() else None
            within = lambda rows: _exact_links(texts[0][rows].tolist(), *exact)
            decide = within(slice(None)) if exact and small.any() else None
            for size in np.unique(sizes[small]):
                at = cut[sizes == size]
                tree = trees[at[:, None] + np.arange(size)]  # of each block's members, so that a block gives a spanning forest
                for x, y in itertools.combinations(range(size), 2):
                    rows = np.flatnonzero(tree[:, x] != tree[:, y])
                    rows = rows[_near_pairs(prints, table, at[rows] + x, at[rows] + y, bound)]
                    if exact:
                        rows = rows[decide(at[rows] + x, at[rows] + y)]
                    a_out.append(at[rows] + x)
                    b_out.append(at[rows] + y)
                    some = tree[rows]
                    tree[rows] = np.where(some == some[:, [y]], some[:, [x]], some)
            for at, size in zip(cut[sizes > 12].tolist(), sizes[sizes > 12].tolist()):
                links = block_links(prints[at : at + size], bound, within(slice(at, at + size)) if exact else None, trees[at : at + size])
                if links:
                    pairs = np.array(links) + at
                    a_out.append(pairs[:, 0])
                    b_out.append(pairs[:, 1])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_out, b_out))
            if bits and len(a):
                new = ~agree_before(prints[a], prints[b], keys[a, 1] >> BAND_PLACE, bits)
                a, b = a[new], b[new]
            a, b = trees[a], trees[b]
            apart = a != b
            if apart.any():
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[apart], axis=0)
                yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            keys = np.stack([whole("k0"), whole("k1")], 1)
            prints = np.stack([whole(f"p{k}").view(np.uint64) for k in range(words)], 1)
            texts = [np.array(batch.column("text").to_pylist(), object)] if exact else []
            held.append((keys, whole("node") if "tree" not in batch.schema.names else pc.coalesce(batch.column("tree"), batch.column("node")).to_numpy(), prints, *texts))
            rows = [np.concatenate(x) for x in zip(*held)]
            keys = rows[0]
            other = np.flatnonzero((keys != keys[-1]).any(axis=1))
            done = other[-1] + 1 if len(other) else 0
            if done:
                yield from emit(*(x[:done] for x in rows))
            held = [tuple(x[done:] for x in rows)]
        if held:
            yield from emit(*held[0])

    return run


def _crowded(keyed: DataFrame, limit: int) -> DataFrame:
    """key and tiles of blocks of more than so many members."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return sizes.select("key", F.ceil(F.col("n") / (limit // 2)).cast("int").alias("tiles"))


def _dealt(keyed: DataFrame, over: DataFrame | None, columns: list[str], bits: int = 0, among: str = "all") -> DataFrame:
    """Rows with the keys k0 and k1 of their block, or of each pair of tiles in which they meet others.

    among: all; own (small blocks, and each tile by itself); others (pairs of unlike tiles).
    """
    band = (F.col("band").cast("long") if bits else F.lit(0).cast("long")) * F.lit(1 << BAND_PLACE)
    if over is None:
        return keyed.select(F.col("key").alias("k0"), band.alias("k1"), *columns)
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("long")
    pair = lambda t: F.least(tile, t) * F.lit(1 << 20) + F.greatest(tile, t)
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    if among == "others":
        pairs = F.transform(F.filter(every, lambda t: t != tile), pair)
        return keyed.join(over, "key").select(F.col("key").alias("k0"), F.explode(F.transform(pairs, lambda t: t + band)).alias("k1"), *columns)
    pairs = F.array(pair(tile)) if among == "own" else F.transform(every, pair)
    pairs = F.when(F.col("tiles").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
    return keyed.join(over, "key", "left").select(F.col("key").alias("k0"), F.explode(F.transform(pairs, lambda t: t + band)).alias("k1"), *columns)


def _links(dealt: DataFrame, words: int, bound: int, exact: tuple[int, float] | None = None, bits: int = 0) -> DataFrame:
    """Links (a, b) of all blocks of dealt rows: node (and tree), k0, k1, p0 .. p(words - 1), and with exact the text."""
    small_batches(dealt.sparkSession, 1000 if exact else 20_000)
    ready = dealt.repartition("k0", "k1").sortWithinPartitions("k0", "k1", F.xxhash64("node"))  # blocks that share members share references, hence links
    return ready.mapInArrow(_linker(words, bound, exact, bits), "a long, b long").distinct()


def _over(keyed: DataFrame, limit: int) -> DataFrame | None:
    """_crowded, or None where no block is."""
    over = _crowded(keyed, limit)
    with dropping_shuffles(keyed.sparkSession):
        return None if over.isEmpty() else over


def _links_by_key(keyed: DataFrame, words: int, bound: int) -> DataFrame:
    """Links (a, b) in all blocks. keyed: node, key, p0 ...; blocks above LIMIT are cut into tiles, every two of which meet."""
    return _links(_dealt(keyed, _over(keyed, LIMIT), ["node", *[f"p{k}" for k in range(words)]]), words, bound)


def _with_tree(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """rows with tree, the tree that the node is joined to (null: none)."""
    return rows.join(trees.withColumnRenamed("component", "tree"), "node", "left")


def _grown(trees: DataFrame, more: DataFrame) -> DataFrame:
    """Components of trees (node, component) that further links between trees join."""
    return components(trees.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def banded_components(nodes: DataFrame, columns: list[str], bits: int, bound: int) -> DataFrame:
    """node and component of nodes that bands propose as near. nodes: node and the columns of fingerprint words.

    The first FIRST_BANDS bands join most members of a group of copies; all others then give links only between trees
    that are still apart, so that links don't grow with the bands that a group shares.
    """
    keys, prints = band_keys(columns, bits), columns[:BAND_WORDS]

    def links(rows: DataFrame, some: slice) -> DataFrame:
        bands = F.array(*[F.struct(F.lit(k).alias("band"), key.alias("key")) for k, key in list(enumerate(keys))[some]])
        own = ["node", *(["tree"] if "tree" in rows.columns else []), *prints]
        keyed = rows.select(*own, F.inline(bands))
        return _links(_dealt(keyed, _over(keyed, LIMIT), own, bits), BAND_WORDS, bound, bits=bits)

    trees = materialise(components(links(nodes, slice(FIRST_BANDS))), "trees")
    return _grown(trees, links(_with_tree(nodes, trees), slice(FIRST_BANDS, None)))


def exact_components(suspects: DataFrame, columns: list[str], bound: int, words: int, likeness: float) -> DataFrame:
    """node and component of suspects by the exact likeness of their shingles. suspects: node, key (its group), text, columns.

    Blocks hold texts and are cut above a quarter of LIMIT: each tile is joined by itself first, and pairs of tiles then
    give links only between trees that are still apart.
    """
    over, own = _over(suspects, LIMIT // 4), ["node", *columns, "text"]
    trees = components(_links(_dealt(suspects, over, own, among="own"), len(columns), bound, (words, likeness)))
    if over is None:
        return trees
    trees = materialise(trees, "trees")
    across = _dealt(_with_tree(suspects, trees), over, [*own, "tree"], among="others")
    return _grown(trees, _links(across, len(columns), bound, (words, likeness)))


def group_keys(value: Column, bound: int, groups: int) -> Column:
    """Keys of a 64-bit fingerprint: its bits in every choice of groups - bound of so many groups, each with the choice's number."""
    edges = [64 * g // groups for g in range(groups + 1)]
    masks = [sum(((1 << edges[g + 1]) - (1 << edges[g])) for g in chosen) for chosen in itertools.combinations(range(groups), groups - bound)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.xxhash64(F.lit(i), value.bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)])


def groups_for(distinct: int, bound: int) -> int:
    """Bit groups, so that a block of unlike fingerprints stays small: more groups give longer keys and more of them."""
    groups = bound + 2
    while groups < bound + 4 and distinct > 1 << (64 * (groups - bound) // groups + 2):
        groups += 1
    return groups


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id and its 64-bit fingerprint (as a signed long)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([majority(shingle_hashes(t.encode(), words)[:, None]) for t in batch.column("text").to_pylist()] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _signed(found)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def near_components(docs: DataFrame, words: int = 4, bound: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of each row: links at `bound` or fewer differing bits, closed over chains.

    component_id is the smallest doc_id reachable. Texts without words (null ones too) have fingerprint zero and link
    like any other; equal fingerprints are one node, whose smallest doc_id names it; a component of null ids only has a
    null id; repeated rows each have a row; an empty table gives no rows; other columns aren't read.
    """
    prints = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    groups = groups_for(nodes.count(), bound)
    keyed = nodes.select(F.col("fp").alias("node"), F.col("fp").alias("p0"), F.explode(group_keys(F.col("fp"), bound, groups)).alias("key"))
    found = components(_links_by_key(keyed, 1, bound))
    placed = nodes.join(found, nodes.fp == found.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lows = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = placed.join(lows, "component").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Wide fingerprints: words of 64 bits and bits in a band, at least; bits from a band's start to the next one's; words that
#: bands compare; unlike texts that may share a band's key before bands get longer.
WIDE_WORDS, BAND_BITS, BAND_STEP, BAND_WORDS, BAND_ROWS = 12, 16, 8, 4, 2048
#: Bands whose links are found before those of all others.
FIRST_BANDS = 8
#: Standard errors that a proposed pair may be above the likeness: also covers the ties of short texts (3 / 16 of the bits
#: differ between five shingles and four of them) by four of their own.
LOOSE = 7.0


def likeness_bound(likeness: float, bits: int, slack: float = 0.7) -> int:
    """Differing bits of `bits` at a Jaccard likeness, and so many standard errors more: sets at that likeness have the
    cosine 2 j / (1 + j), and each bit differs with the angle's share of a half turn."""
    share = np.arccos(2 * likeness / (1 + likeness)) / np.pi
    return int(np.floor(bits * share + slack * np.sqrt(bits * share * (1 - share))))


def bands_for(distinct: int, likeness: float) -> tuple[int, int]:
    """Bits of a band, so that unlike texts seldom share one, and words of a fingerprint, so that bands of so many bits
    still find as many pairs right at the likeness as the shortest ones do."""
    agree = 1 - np.arccos(2 * likeness / (1 + likeness)) / np.pi
    bits = max(BAND_BITS, int(np.ceil(np.log2(max(distinct, 1) / BAND_ROWS))))
    return bits, int(np.ceil(WIDE_WORDS * agree ** (BAND_BITS - bits) * bits / BAND_BITS))


def _node(text: bytes) -> int:
    """A hash of the text's words in lower case: equal ones have equal shingles."""
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 7)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def wide_prints(docs: DataFrame, words: int, id_col: str, text_col: str, count: int) -> DataFrame:
    """doc_id, text_hash, node (a hash of the distinct shingles' source, the text's words) and count fingerprint words of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            nodes = np.array([_node(t) for t in texts], np.uint64)
            found = np.stack([wide_fingerprint(np.unique(shingle_hashes(t, words)), count) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), _signed(nodes), *[_signed(found[:, k]) for k in range(count)]], names=["doc_id", "text_hash", "node", *[f"p{k}" for k in range(count)]])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_hash(text_col).alias("text_hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, node long, " + ", ".join(f"p{k} long" for k in range(count)))


def with_node(docs: DataFrame, text_col: str) -> DataFrame:
    """node (as in wide_prints) and text of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.array([_node(t.encode()) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([_signed(nodes), batch.column("text")], names=["node", "text"])

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "node long, text string")


def band_keys(columns: list[str], bits: int) -> list[Column]:
    """A key for each band of so many bits of the words, from every BAND_STEP-th bit on; the last ones go on in the first word."""
    keys, mask = [], F.lit((1 << bits) - 1).cast("long")
    for k, start in enumerate(range(0, 64 * len(columns), BAND_STEP)):
        word, bit = divmod(start, 64)
        band = F.shiftrightunsigned(columns[word], bit)
        if bit + bits > 64:
            band = band.bitwiseOR(F.shiftleft(columns[(word + 1) % len(columns)], 64 - bit))
        keys.append(F.xxhash64(F.lit(k), band.bitwiseAND(mask)))
    return keys


def near_classes(docs: DataFrame, words: int = 5, likeness: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id (its smallest doc_id) by likeness of the sets of shingles of so many words, closed over chains.

    Fingerprints only propose: nodes that agree on a band of bits (bands_for; bands overlap by half or more) and are within
    a loose bound on BAND_WORDS words make groups; inside a group every pair within the loose bound on all the
    fingerprint's words is decided by the exact Jaccard likeness of its shingles. So no pair below the likeness is linked; a lone pair
    right at 0.8 goes unproposed where no band agrees (rates in README). Texts without words are one class. Null and
    repeated ids as in near_components.
    """
    return _classes(docs, words, likeness, id_col, text_col).select("doc_id", "class_id")


def _classes(docs: DataFrame, words: int = 5, likeness: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_classes with each row's text_hash and its class's own number, class."""
    bits, wide = bands_for(docs.agg(F.approx_count_distinct(_text_hash(text_col))).first()[0], likeness)
    prints = materialise(wide_prints(docs, words, id_col, text_col, wide), "wide-fingerprints")
    columns = [f"p{k}" for k in range(wide)]
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("low"), *[F.first(c).alias(c) for c in columns])
    nodes = materialise(nodes, "distinct-texts")
    groups = materialise(banded_components(nodes, columns, bits, likeness_bound(likeness, 64 * BAND_WORDS, LOOSE)), "groups")
    texts = with_node(docs, text_col).join(groups, "node").dropDuplicates(["node"])
    suspects = materialise(nodes.select("node", *columns).join(texts.withColumnRenamed("component", "key"), "node"), "suspects")
    found = exact_components(suspects, columns, likeness_bound(likeness, 64 * wide, LOOSE), words, likeness)
    placed = nodes.join(found, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    lows = placed.groupBy("component").agg(F.min("low").alias("class_id"))
    ids = placed.join(lows, "component").select("node", "class_id", F.col("component").alias("class"))
    return prints.select("doc_id", "text_hash", "node").join(ids, "node").select("doc_id", "text_hash", "class", "class_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id, and of the smallest text hash among rows of this id.

    Rows with a null id stay; of fully repeated rows (id and text) one; rows of one id with unlike texts count each by
    itself. All columns stay.
    """
    classes = materialise(_classes(docs, id_col=id_col, text_col=text_col, **options).where("doc_id is not null"), "classes")
    chosen = classes.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("chosen"))
    others = classes.join(chosen, "class").where(F.struct("doc_id", "text_hash") != F.col("chosen"))
    gone = others.select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__gone_hash")).distinct()
    own = _text_hash(text_col)
    kept = docs.join(gone.hint("merge"), (docs[id_col] == gone["__gone"]) & (own == gone["__gone_hash"]), "left_anti")  # ids of copies grow with the corpus: one plan at every size
    repeated = classes.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    kept = kept.withColumns({"__hash": own, "__null": F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())})
    return kept.dropDuplicates([id_col, "__hash", "__null"]).drop("__hash", "__null")
