"""SimHash near-duplicates by a forest of vantage-point trees, exact for any Hamming radius.

Fingerprints are cut into blocks of bits, so many that two fingerprints within the radius are within a radius of one in at
least one block (a block of radius r allows r differing bits; the allowances add up to the radius, less one a block). A
block's bits make a short value, and the distance between values is a metric, so each block gets a vantage-point tree: a node sends a fingerprint to its inner side
if it is within the node's threshold of the vantage point, else to the outer side. By the triangle inequality two
fingerprints within the block's radius part only near the threshold, so fingerprints that lie just beyond it also visit
the inner side; a visitor goes on to each side that can hold a partner. The upper levels form the shards of the cluster,
the lower ones are built within a shard. What remains in a leaf is compared by whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, release_memory, slices, small_batches, uniform, written
from .components import connected_components

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints that vantage points and thresholds are chosen from, as an expected number; they steer shards' sizes alone.
SAMPLE = 32_768
#: Fingerprints of a shard to aim at, those of the sample for each shard at least, and fingerprints compared without a further split.
SHARD, SHARD_SAMPLE, LEAF = 131_072, 16, 1_000


# fingerprints


def shingle_hashes(text: str, words: int, seeds: tuple[int, ...] = (SEED,)) -> np.ndarray:
    """XXH64 of the shingles of ASCII-lower-cased words, a row each, a column per seed; fewer words give one shingle."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty((0, len(seeds)), np.uint64)
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*[found[k:] for k in range(words)], strict=False)))
    hashed = xxhash.xxh64_intdigest
    return np.array([[hashed(s, seed) for s in shingles] for seed in seeds], np.uint64).T


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits set in over half of the hashes, as one unsigned 64-bit number a column."""
    n, k = hashes.shape
    bits = np.zeros((k, 64), np.int64)
    flat = np.ascontiguousarray(hashes).view(np.uint8).reshape(n, 8 * k)
    for s in range(0, n, 255 * 64):
        part = np.unpackbits(flat[s : s + 255 * 64], axis=1, bitorder="little")
        for t in range(0, len(part), 255):  # 255 ones fit a byte, in which sums are fast
            bits += np.add.reduce(part[t : t + 255], axis=0, dtype=np.uint8).astype(np.int64).reshape(k, 64)
    return np.packbits((2 * bits > n).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprinter(words: int, seeds: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = np.array([majority(shingle_hashes(t or "", words, seeds)) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1, len(seeds))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {f"f{k}": pa.array(np.ascontiguousarray(out[:, k]).view(np.int64)) for k in range(len(seeds))})

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """doc_id and fingerprints f0, f1.. (bigint) of whole texts; a text without words, or null, has zero."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprinter(words, seeds), ", ".join([f"doc_id {id_type}", *(f"f{k} long" for k in range(len(seeds)))]))


# trees


#: A block: the positions of its bits in the concatenated fingerprints (64 to a column), and how many may differ.
Block = tuple[tuple[int, ...], int]


def blocks_of(radius: int) -> list[Block]:
    """Blocks of one fingerprint: allowances of one, the last of none if that is enough; a pair within the radius is within some block's."""
    allowances = [1] * ((radius + 1) // 2) + [0] * ((radius + 1) % 2)
    edges = np.linspace(0, 64, len(allowances) + 1).round().astype(int)
    return [(tuple(range(int(a), int(b))), r) for a, b, r in zip(edges, edges[1:], allowances, strict=False)]


def values_of(prints: list[np.ndarray], bits: tuple[int, ...]) -> np.ndarray:
    """The block's bits of fingerprints (a column each) as one number."""
    out = np.zeros(len(prints[0]), np.uint64)
    for i, b in enumerate(bits):
        out |= (prints[b // 64] >> np.uint64(b % 64) & np.uint64(1)) << np.uint64(i)
    return out


def _distance(values: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(values ^ values.dtype.type(vantage))


def vantage_point(f: np.ndarray) -> tuple[int, int] | None:
    """A vantage point among f and a threshold that halves f as evenly as the first few candidates allow; None if none parts it."""
    best = None
    for v in f[:: max(1, len(f) // 5)][:5]:
        d = _distance(f, v)
        counts = np.cumsum(np.bincount(d, minlength=65))
        t = int(np.argmin(np.abs(counts - len(f) / 2)))
        odd = abs(int(counts[t]) - len(f) / 2)
        if counts[t] < len(f) and (best is None or odd < best[0]):
            best = (odd, int(v), t)
    return best and best[1:]


def shard_tree(sample: np.ndarray, levels: int) -> list[tuple[int, int] | None]:
    """Vantage points and thresholds in heap order; None where a branch isn't split further."""
    nodes: list = [None] * ((1 << levels) - 1)
    parts = {0: sample}
    for i in range(len(nodes)):
        f = parts.pop(i, None)
        if f is not None and len(f) >= SHARD_SAMPLE and (found := vantage_point(f)):
            nodes[i] = found
            inner = _distance(f, found[0]) <= found[1]
            parts[2 * i + 1], parts[2 * i + 2] = f[inner], f[~inner]
    return nodes


def _split(f: np.ndarray, visits: np.ndarray, node: tuple[int, int], r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Indices that go inside and outside, and whether they do so as visitors."""
    d = _distance(f, node[0]).astype(np.int64)
    near = d <= node[1]
    inner = np.flatnonzero(near | (d <= node[1] + r))
    outer = np.flatnonzero(~near | (visits & (d > node[1] - r)))
    return inner, visits[inner] | ~near[inner], outer, visits[outer]


def route(f: np.ndarray, nodes: list, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, leaf and visitor flag for every place that a fingerprint has in a tree."""
    out, todo = [], [(0, np.arange(len(f)), np.zeros(len(f), bool))]
    while todo:
        i, at, visits = todo.pop()
        if not len(at):
            continue
        if i >= len(nodes) or nodes[i] is None:
            out.append((at, np.full(len(at), i, np.int32), visits))
            continue
        inner, vi, outer, vo = _split(f[at], visits, nodes[i], r)
        todo += [(2 * i + 1, at[inner], vi), (2 * i + 2, at[outer], vo)]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, np.int32), np.empty(0, bool))


# links within a shard


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _leaf(forest: Forest, values: np.ndarray, f: np.ndarray, wide: np.ndarray | None, at: np.ndarray, visits: np.ndarray, r: int, radius: int, wide_radius: int) -> None:
    """Join what is linked among positions at, breadth first: what a component has reached is no target of its own any more.

    Whole fingerprints are compared where the block's values are within r, as other pairs meet in another block.

    What one component has reached and not yet searched from stays a target for the others, as several are searched at once.
    A dense group costs its rows times what lies outside of it, not its square. The search starts from natives only, as
    the pairs of two visitors meet elsewhere.
    """

    def hits(rows: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in rows and in targets of what is linked, in order of rows."""
        if not len(targets):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = np.divmod(np.flatnonzero(np.bitwise_count(values[rows][:, None] ^ values[targets][None, :]) <= r), len(targets))
        x, y = rows[a], targets[b]
        near = (np.bitwise_count(f[x] ^ f[y]) <= radius) & (x != y)
        if wide is not None:
            near[near] = np.bitwise_count(wide[x[near]] ^ wide[y[near]]).sum(axis=1, dtype=np.int64) <= wide_radius
        return a[near], b[near]

    open_, queue, seen = at, np.empty(0, np.int64), set()
    seeds, p = at[~visits].tolist(), 0
    while True:
        room = max(1, min(256, 500_000 // max(1, len(open_) + len(queue))))
        if len(queue):
            roots = np.array([forest.root(x) for x in queue.tolist()])
            order = np.argsort(roots, kind="stable")
            queue, roots = queue[order], roots[order]
            q = queue[:room]
            others = queue[roots != roots[0]] if roots[len(q) - 1] == roots[0] else queue
            a, b = hits(q, others)
            for x, y in zip(q[a].tolist(), others[b].tolist(), strict=True):
                forest.join(x, y)
            queue = queue[room:]
        else:
            rows: list[int] = []
            while not rows and p < len(seeds):
                rows = [x for x in seeds[p : p + room] if x not in seen]
                p += room
            if not rows:
                return
            q = np.array(rows)
        rows = q.tolist()
        seen.update(rows)
        a, b = hits(q, open_)
        if len(a):
            first = np.zeros(len(open_), np.int64)
            first[b[::-1]] = a[::-1]
            for x in np.unique(a * len(rows) + first[b]).tolist():  # rows that share a target
                forest.join(rows[x // len(rows)], rows[x % len(rows)])
            reached = np.unique(b)
            for c, t in zip(first[reached].tolist(), open_[reached].tolist(), strict=True):
                forest.join(t, rows[c])
            queue = np.concatenate([queue, [t for t in open_[reached].tolist() if t not in seen]]).astype(np.int64)
            open_ = np.delete(open_, reached)
        open_ = open_[~np.isin(open_, q)]


def shard_links(values: np.ndarray, f: np.ndarray, wide: np.ndarray | None, visits: np.ndarray, r: int, radius: int, wide_radius: int) -> np.ndarray:
    """For every position the least position of its component in this shard; values are those of the shard's block."""
    forest = Forest(len(f))
    widest = int(values.max(initial=0))
    values = values.astype(np.uint16 if widest < 1 << 16 else np.uint32 if widest < 1 << 32 else np.uint64)
    todo = [(np.arange(len(f)), visits, 0)]
    while todo:
        at, v, depth = todo.pop()
        natives = int((~v).sum())
        if not natives or len(at) < 2:
            continue
        node = vantage_point(values[at[~v]]) if natives > LEAF and depth < 40 else None
        if node is None:
            _leaf(forest, values, f, wide, at, v, r, radius, wide_radius)
            continue
        inner, vi, outer, vo = _split(values[at], v, node, r)
        if len(inner) + len(outer) > 1.7 * len(at) and natives < 20 * LEAF or max(len(inner), len(outer)) == len(at):
            _leaf(forest, values, f, wide, at, v, r, radius, wide_radius)  # a split that parts too little
        else:
            todo += [(at[inner], vi, depth + 1), (at[outer], vo, depth + 1)]
    return np.array([forest.root(i) for i in range(len(f))], np.int64)


def near_links(distinct: DataFrame, blocks: list[Block], radius: int, sources: tuple[str, ...] = ("f0",), wide: tuple[str, ...] = (), wide_radius: int = 0, id_col: str = "f0") -> DataFrame:
    """Links (a, b) between ids of distinct fingerprints that join whatever meets in a block and lies within the radius, and no more.

    sources are the columns that the blocks' bits are of; fingerprints in f0 must lie within the radius and, where wide
    names columns, those over all of these together within wide_radius. Every shard gives a spanning forest of its links,
    not its pairs. The sample that shards are made from grows with their number. distinct must be a written table.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    levels = max(0, int(np.ceil(np.log2(max(n, 1) / SHARD))))
    share = min(1.0, max(SAMPLE, (4 * SHARD_SAMPLE) << levels) / max(n, 1))
    rows = distinct.where(uniform(F.col("f0"), "vantage:") < share).select(*sources).toArrow().sort_by([(c, "ascending") for c in sources])
    sample = [c.to_numpy().view(np.uint64) for c in rows.columns]
    mixed = np.random.default_rng(7).permutation(len(sample[0]))
    trees = [(shard_tree(values_of(sample, bits)[mixed], levels), bits, r) for bits, r in blocks]
    carried = list(dict.fromkeys([id_col, "f0", *wide]))
    columns = list(dict.fromkeys([*sources, *carried]))
    shared = spark.sparkContext.broadcast(trees)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [batch.column(c).to_numpy().view(np.uint64) for c in sources]
            for k, (nodes, bits, r) in enumerate(shared.value):
                values = values_of(prints, bits)
                at, leaf, visits = route(values, nodes, r)
                taken = pa.Table.from_batches([batch.select(carried)]).take(pa.array(at)).combine_chunks()
                place = (values[at] << np.uint64(1) | visits.astype(np.uint64)).view(np.int64)  # a value has 63 bits at most
                yield from taken.append_column("shard", pa.array(leaf.astype(np.int64) * len(shared.value) + k)).append_column("place", pa.array(place)).to_batches()

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        _, _, r = shared.value[int(frame["shard"].iloc[0]) % len(shared.value)]
        f, place = frame["f0"].to_numpy().view(np.uint64), frame["place"].to_numpy().view(np.uint64)
        all_of = frame[list(wide)].to_numpy().view(np.uint64) if wide else None
        root = shard_links(place >> np.uint64(1), f, all_of, (place & np.uint64(1)).astype(bool), r, radius, wide_radius)
        linked = np.flatnonzero(root != np.arange(len(f)))
        values = frame[id_col].to_numpy()
        if len(frame) > 10_000:
            release_memory()
        return pd.DataFrame({"a": values[linked], "b": values[root[linked]]})

    fields = ", ".join(f"{c} long" for c in [*carried, "shard", "place"])
    return distinct.select(*columns).mapInArrow(places, fields).groupBy("shard").applyInPandas(within, "a long, b long")


# components


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs.

    Null texts and texts without words have fingerprint zero, which links like any other. component_id is the smallest
    doc_id reachable through links at 4 or fewer differing bits; rows with a null id take part, and where all ids of a
    component are null so is its own. Equal fingerprints are one node with its smallest id, so copies cost no pairs.
    Repeated rows each give a row; other columns are not read; an empty table gives an empty table.
    """
    prints = written(fingerprints(docs), "prints")
    nodes = written(prints.groupBy("f0").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(written(near_links(nodes, blocks_of(RADIUS), RADIUS), "near"))
    joined = nodes.join(roots, nodes["f0"] == roots["node"], "left").select("f0", "least", F.coalesce("root", "f0").alias("root"))
    # stored, so that the join after it is between plain shuffles, whose large partitions Spark may split
    least = written(joined.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = joined.join(least, "root").select("f0", "component_id")
    return prints.join(named, "f0").select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


#: Five-word shingles, and the resemblance from which documents are near-duplicates, as a fraction.
STAGE_WORDS, STAGE_ALIKE, STAGE_SEEDS = 5, (4, 5), (42, 43, 44, 45)
#: Share of bits in which sets at that resemblance differ at most, but for those of four and five shingles (0.19); most: 0.15.
STAGE_DIFFER = 0.165
#: Share of such pairs that some block shall find at least, and unlike fingerprints that a block shall bring near one at most.
STAGE_RECALL, STAGE_CHANCE = 0.95, 128
#: Candidates differ in so many of the first 64 bits, and of all, at most: four deviations above the expected number; of all bits
#: that is seven below the half that unlike ones differ in, so these don't chain. Exact resemblance decides afterwards.
STAGE_RADIUS, STAGE_WIDE = 22, 68
#: Rows up to which candidates are broadcast to the texts, and candidates of a task to aim at.
BROADCAST_ROWS, GROUP_ROWS = 500_000, 1_000


def _recall(width: int, n_blocks: int, differ: float, n_bits: int) -> float:
    """The chance that two fingerprints, each bit of which differs with a chance, differ in at most one bit of some block."""
    total = 0.0
    for d in range(n_bits + 1):
        chance = comb(n_bits, d) * differ**d * (1 - differ) ** (n_bits - d)
        if chance > 1e-9:
            near = (comb(n_bits - d, width) + d * comb(n_bits - d, width - 1)) / comb(n_bits, width)
            total += chance * (1 - (1 - near) ** n_blocks)
    return total


def stage_blocks(n: int, n_bits: int = 64 * len(STAGE_SEEDS)) -> list[Block]:
    """Blocks for n fingerprints, so wide that few unlike ones meet, and so many that STAGE_RECALL of the like ones do.

    Both grow with the logarithm of n, so what a fingerprint is compared with doesn't grow in proportion. Bits are dealt
    from one order of all bits after another, so each is in as many blocks as any other.
    """
    width = next(w for w in range(8, 63) if n * (w + 1) <= STAGE_CHANCE * 2**w or w == 62)
    count = next(b for b in range(1, 1 << 20) if _recall(width, b, STAGE_DIFFER, n_bits) >= STAGE_RECALL)
    order = np.random.default_rng(5)
    dealt = np.concatenate([order.permutation(n_bits) for _ in range(-(-(width * count) // n_bits) + 1)])
    blocks, at = [], 0
    for _ in range(count):
        bits = dict.fromkeys(dealt[at : at + width].tolist())  # an order that ends within a block may repeat a bit
        at += width
        while len(bits) < width:
            bits.setdefault(int(dealt[at]))
            at += 1
        blocks.append((tuple(bits), 1))
    return blocks


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(shingle_hashes(text, words)[:, 0])


def _set_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """A fingerprint per seed of distinct shingle hashes; all seeds but the first go through a mixing of the first's bits."""
    each = [hashes]
    for seed in STAGE_SEEDS[1:]:
        x = hashes + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        each.append(x ^ x >> np.uint64(31))
    return majority(np.stack(each, axis=1))


def alike_roots(sets: list[np.ndarray], alike: tuple[int, int] = STAGE_ALIKE) -> list[int]:
    """For every set the least position of its component by links of a Jaccard resemblance of alike or more, exactly.

    Two such sets share one of their rarest tokens (as many as may differ, and one). The search is breadth first, so what
    is reached is no target any more: a dense group costs its rows times what lies outside of it.
    """
    p, q = alike
    n = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(n)])
    _, tokens, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    each = [np.sort(rank[tokens[a:b]]) for a, b in zip(starts, starts[1:], strict=False)]
    prefixes = [t[: len(t) - -(-p * len(t) // q) + 1] for t in each]
    forest = Forest(len(sets))
    mark, open_ = np.zeros(len(counts), bool), np.ones(len(sets), bool)

    def postings() -> tuple[np.ndarray, np.ndarray]:
        left = np.flatnonzero(open_)
        at = np.concatenate([prefixes[i] for i in left] or [np.empty(0, np.int64)])
        order = np.argsort(at, kind="stable")
        return np.searchsorted(at[order], np.arange(len(counts) + 1)), np.repeat(left, [len(prefixes[i]) for i in left])[order]

    (edge, held), size = postings(), len(sets)
    for seed in range(len(sets)):
        queue = [seed] if open_[seed] else []
        open_[seed] = False
        while queue:
            i = queue.pop()
            lists = [held[edge[t] : edge[t + 1]] for t in prefixes[i].tolist() if edge[t + 1] > edge[t]]
            found = np.unique(np.concatenate(lists)) if lists else np.empty(0, np.int64)
            found = found[open_[found] & (q * n[found] >= p * n[i]) & (q * n[i] >= p * n[found])]
            if not len(found):
                continue
            mark[each[i]] = True
            shared = np.add.reduceat(mark[np.concatenate([each[j] for j in found])], np.cumsum(n[found]) - n[found], dtype=np.int64)
            mark[each[i]] = False
            near = found[q * shared >= p * (n[i] + n[found] - shared)].tolist()
            for j in near:
                forest.join(i, j)
            open_[near] = False
            queue += near
            left = int(open_.sum()) if near else size
            if 2 * left < size:
                (edge, held), size = postings(), left
    return [forest.root(i) for i in range(len(sets))]


def _exact_roots(docs: DataFrame, loose: DataFrame, words: int) -> DataFrame:
    """node, root by exact resemblance within every group of candidates; loose: text_key, node, loose of one row per node."""
    small_batches(docs.sparkSession)
    n = loose.count()
    parts = max(1, n // GROUP_ROWS)
    texts = docs.select("text", F.xxhash64("doc_id", "text").alias("text_key"))
    joined = texts.join(F.broadcast(loose) if n <= BROADCAST_ROWS else loose, "text_key")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(t or "", words).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"node": batch.column(1), "loose": batch.column(2), "part": batch.column(3), "hashes": pa.array(found, pa.binary())})

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, roots = [], []
        for _, group in frame.drop_duplicates("node").groupby("loose", sort=False):
            ids = np.sort(group["node"].to_numpy())
            at = group.sort_values("node")
            found = alike_roots([np.frombuffer(h, np.uint64) for h in at["hashes"]])
            nodes.append(ids)
            roots.append(ids[found])
        release_memory()
        return pd.DataFrame({"node": np.concatenate(nodes), "root": np.concatenate(roots)})

    hashed = joined.select("text", "node", "loose", F.pmod(F.xxhash64("loose"), F.lit(parts)).alias("part"))
    return hashed.mapInArrow(sets, "node long, loose long, part long, hashes binary").groupBy("part").applyInPandas(within, "node long, root long")


def one_of_each_group(docs: DataFrame, words: int = STAGE_WORDS) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays (null ids last).

    Links are pairs whose sets of shingles have a Jaccard resemblance of STAGE_ALIKE or more, decided exactly within groups
    of candidates: the components of pairs that differ in at most one bit of one of stage_blocks, found by a forest of
    vantage-point trees, a tree a block, and in few of their first bits. Equal sets are one node. A row is known by a hash of id and text; rows alike in both are copies, of which
    one stays. Texts without words are copies of each other. Columns stay as they are; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    width = len(STAGE_SEEDS)
    fs = [f"f{k}" for k in range(width)]
    row_key = F.xxhash64("doc_id", "text")
    rows = docs.select("doc_id", "text", row_key.alias("row_key"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    prints = written(rows.mapInArrow(_stage_fingerprinter(words), ", ".join([f"doc_id {id_type}, row_key long, node long", *(f"{c} long" for c in fs)])), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("row_key"))
    nodes = written(prints.groupBy("node", *fs).agg(F.min(first).alias("first"), F.count("*").alias("rows")), "nodes")
    near = near_links(nodes, stage_blocks(nodes.count()), STAGE_RADIUS, tuple(fs), tuple(fs), STAGE_WIDE, "node")
    loose = connected_components(written(near, "near")).withColumnRenamed("root", "loose")
    candidates = written(nodes.join(loose, "node").select(F.col("first.row_key").alias("text_key"), "node", "loose"), "candidates")
    roots = written(_exact_roots(docs, candidates, words), "roots")
    joined = nodes.select("node", "first", "rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = written(joined.groupBy("root").agg(F.min("first").alias("kept"), F.sum("rows").alias("n")).where("n > 1"), "kept")
    lost = written(prints.join(joined.select("node", "root").join(kept, "root").select("node", F.col("kept.row_key").alias("kept_key")), "node").where("row_key <> kept_key").select("row_key").distinct(), "lost")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key.alias("key")).join(lost, F.col("key") == F.col("row_key"), "left_anti")
    twice = written(prints.groupBy("row_key").count().where("count > 1").select("row_key"), "twice")
    if not twice.isEmpty():
        once = out.join(twice, F.col("key") == F.col("row_key"), "left_anti")
        out = once.unionByName(out.join(twice, F.col("key") == F.col("row_key"), "left_semi").dropDuplicates(["key"]))
    return out.select("row.*")


def _stage_fingerprinter(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(t or "", words) for t in batch.column(1).to_pylist()]
            out = np.array([_set_fingerprints(h) for h in found], np.uint64).reshape(-1, len(STAGE_SEEDS))
            nodes = pa.array(np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in found], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "row_key": batch.column(2), "node": nodes} | {f"f{k}": pa.array(np.ascontiguousarray(out[:, k]).view(np.int64)) for k in range(out.shape[1])})

    return run


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: fingerprints and components of all documents."""
    return simhash_components(read_table(spark, sf_dir, "documents"))
