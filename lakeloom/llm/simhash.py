"""SimHash near-duplicates by a Gray-order hierarchical index.

Equal fingerprints are one class. Up to GROUP classes are one index. More are dealt out: a 64-bit fingerprint is cut into
blocks, and two that differ in at most `differ` bits agree in some choice of blocks, so it is enough that all classes
that agree in one choice, in so many bits of it as make groups of about GROUP classes, meet in one index. A group that is
much larger, as its bits are common, is dealt out once more by whole blocks.

Within a group, fingerprints are sorted by their rank in the Gray code, which puts those with common bits side by
side. A node of the index has the bits that all below it share, less those that a node above has already; a search
descends all levels at once, adds up differences in shared bits, and drops a whole node when they exceed the limit. A
group gives edges that connect it, not its pairs."""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._util import components, cut, prepare, runs

DIFFER, WORDS, SEED = 4, 4, 42
#: Fingerprints below a leaf, children of a node, and query and node pairs that a step looks at together.
LEAF, FAN, STEP = 8, 8, 1 << 20
#: Classes of a group that the bits of a choice aim at, and the size from which on a group is dealt out once more.
GROUP, LARGE = 4096, 1 << 16
#: Rows of a document whose bits are added up at once.
AT_ONCE = 1 << 16
SALTS = 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits; a bit is 1 if it is in over half the shingles' hashes. A text without words has 0."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(w))
    a, b = starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist()
    total, n = np.zeros(64, np.int64), len(a)
    for i in range(0, n, AT_ONCE):
        h = np.array([xxh64_intdigest(joined[x:y], seed) for x, y in zip(a[i : i + AT_ONCE], b[i : i + AT_ONCE], strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the sequence of Gray codes."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Levels from the top; each has masks of newly shared bits, their values, and where its children lie. A search counts the
    nodes and values that it has looked at in `seen` and those dropped with a node above them in `dropped`."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.values = values[self.order]
        n = len(values)
        cuts = np.arange(0, n, LEAF)
        both, either = np.bitwise_and.reduceat(self.values, cuts), np.bitwise_or.reduceat(self.values, cuts)
        levels = [(both, either, cuts, np.minimum(cuts + LEAF, n))]
        while len(levels[-1][0]) > FAN:
            a, o = levels[-1][:2]
            at = np.arange(0, len(a), FAN)
            levels.append((np.bitwise_and.reduceat(a, at), np.bitwise_or.reduceat(o, at), at, np.minimum(at + FAN, len(a))))
        self.levels = []
        above = np.zeros(len(levels[-1][0]), np.uint64)
        for k in range(len(levels) - 1, -1, -1):
            a, o, lo, hi = levels[k]
            shared = ~(a ^ o)
            self.levels.append((shared & ~above, a, lo, hi))
            above = np.repeat(shared, hi - lo)
        self.rest = ~above  # bits of a fingerprint that no node above it shares
        self.seen = self.dropped = 0

    def search(self, queries: np.ndarray, differ: int):
        """(query, position) of all values within the limit, in pieces."""
        many = max(1, STEP // max(1, len(self.values)))
        for k in range(0, len(queries), many):
            q = i = np.arange(k, min(len(queries), k + many))
            top = len(self.levels[0][0])
            q, node, seen = np.repeat(q, top), np.tile(np.arange(top), len(q)), np.zeros(len(q) * top, np.int64)
            for masks, bits, lo, hi in self.levels:
                seen = seen + np.bitwise_count((queries[q] ^ bits[node]) & masks[node])
                near = seen <= differ
                self.seen += len(q)
                q, node, seen = q[near], node[near], seen[near]
                wide = hi[node] - lo[node]
                first = np.cumsum(wide) - wide
                child = np.arange(int(wide.sum())) + np.repeat(lo[node] - first, wide)
                q, seen, node = np.repeat(q, wide), np.repeat(seen, wide), child
            self.seen += len(q)
            self.dropped += (int(i[-1]) - int(i[0]) + 1) * len(self.values) - len(q)
            near = seen + np.bitwise_count((queries[q] ^ self.values[node]) & self.rest[node]) <= differ
            yield q[near], self.order[node[near]]


def connect(values: np.ndarray, differ: int) -> np.ndarray:
    """For each value the smallest position that it is connected with, by values within the limit."""
    root = np.arange(len(values))
    if len(values) < 2:
        return root
    for q, p in GrayIndex(values).search(values, differ):
        link = root[q] != root[p]
        q, p = q[link], p[link]
        while len(q):  # hook the larger root under the smaller, then jump to roots
            a, b = root[q], root[p]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
            link = root[q] != root[p]
            q, p = q[link], p[link]
    return root


def choices(n: int, differ: int = DIFFER, group: int = GROUP) -> list[list[tuple[int, int]]]:
    """Blocks of each choice as (low bit, width): none up to `group` classes, then as many bits as bring groups near it."""
    if n <= group:
        return [[]]
    bits = ceil(log2(n / group))
    for agree in range(1, 5):
        blocks = differ + agree
        if bits <= agree * (64 // blocks) or comb(blocks + 1, agree + 1) > 60:
            break
    width = min(64 // blocks, -(-bits // agree))
    return [[(round(i * 64 / blocks), width) for i in c] for c in combinations(range(blocks), agree)]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", differ: int = DIFFER, words: int = WORDS, seed: int = SEED, group: int = GROUP, large: int = LARGE) -> DataFrame:
    """One row for each row of df: <id_col>, fingerprint (16 hexadecimal digits) and component_id, the smallest id that can be reached over links.

    Null texts count as empty and, like texts without words, have fingerprint zero. A null id is in the component of its
    fingerprint, but never names it; component_id is null if only null ids are there. Other columns are not read."""
    import pyarrow as pa

    spark = df.sparkSession
    prepare(spark)
    kind = df.schema[id_col].dataType.simpleString()

    def prints(batches):
        for b in batches:
            x = np.array([fingerprint(t, words, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.view(np.int64), pa.int64())], names=["id", "fp"])

    all_ = cut(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(prints, f"id {kind}, fp long"))
    classes = cut(all_.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")))

    def key(number, blocks):
        out, used = F.lit(number << 52).cast("long"), 0
        for low, width in blocks:
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("long")), used))
            used += width
        return out

    def link(batches):
        for t in runs(batches, "key"):
            k = t["key"].to_numpy()
            fp, node = t["fp"].to_numpy().view(np.uint64), t["node"].combine_chunks()
            at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            a, b = [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if j - i > 1:
                    root = connect(fp[i:j], differ)
                    linked = np.flatnonzero(root != np.arange(j - i))
                    a.append(linked + i)
                    b.append(root[linked] + i)
            if a and len(x := np.concatenate(a)):
                yield pa.RecordBatch.from_arrays([node.take(pa.array(x)), node.take(pa.array(np.concatenate(b)))], names=["a", "b"])

    # Classes are the nodes, in the order of their ids, so that the least node of a component has its least id; null ids are last.
    node = F.struct(F.col("rep").isNull().alias("none"), "rep", "fp")
    keys = lambda c: F.explode(F.array(*(key(i, x) for i, x in enumerate(c))))
    keyed = classes.select(keys(choices(classes.count(), differ, group)).alias("key"), "fp", node.alias("node"))
    size = keyed.groupBy("key").count().where(F.col("count") > large).select("key")  # at most a row for each `large` rows
    again = [[(round(i * 64 / (differ + 1)), 64 // (differ + 1))] for i in range(differ + 1)]
    if size.limit(1).count():
        keyed = keyed.join(F.broadcast(size.withColumn("big", F.lit(True))), "key", "left")
        more = keyed.where("big").select("key", keys(again).alias("more"), "fp", "node").select(F.xxhash64("key", "more").alias("key"), "fp", "node")
        keyed = keyed.where("big is null").select("key", "fp", "node").union(more)
    keyed = keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    of = f"struct<none: boolean, rep: {kind}, fp: bigint>"
    found = components(keyed.mapInArrow(link, f"a {of}, b {of}")).select(F.col("node.fp").alias("fp"), F.col("component.rep").alias("component"))
    named = classes.join(found, "fp", "left").where("n > 1 or component is not null").select("fp", F.coalesce("component", "rep").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = all_.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(named, ["fp", "salt"], "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "id").alias("component_id"))
