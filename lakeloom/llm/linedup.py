"""Line deduplication by an exact set-similarity join.

A line is the set of its words. A line is removed if an earlier line, by id and number, is equal or has a Jaccard
similarity of 4/5 or more; blank lines stay. So it is enough to find one such line for each.

A line that its task has met before, earlier in the corpus, goes at once. Others meet by prefixes: with the words of a
line in one order of rarity, two similar lines share a word among their first few. Where that word is frequent, they meet
in two words of a prefix that is one word longer, which similar lines share as well; a word that only one line has is no
key at all. Lines of one key are held in the order of occurrence; copies go, and others are compared with those before
them, by length, by the word's position and by a parity sketch of 128 bits (a word that only one of the lines has flips
one bit). A line that has met ENOUGH lines which, by their sketches, are almost certainly similar looks no further, so
that a group of near copies takes time in proportion to its size; any other line gives all its candidates.

Rows of lines and keys go through the shuffle in blocks of numpy columns, a block for each bucket of keys that a task has,
and are sorted as numbers; so Spark moves few rows.

Candidates are verified on the words themselves: for each line the likeliest one, then, where that fails, the others.
Should all candidates of a line fail that looked no further somewhere, a second round looks at everything that meets it.
No candidate is dropped unseen."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._util import BATCH_BYTES, cut, packed_counts, prepare, runs, summed_counts

#: Similarity as a fraction.
UP, DOWN = 4, 5
#: Words are counted in so many hashed buckets; a word is frequent if its bucket has so many lines, or so many times the mean.
BUCKETS, FREQUENT, MEANS = 1 << 22, 4096, 64
#: Pairs that a step gives together.
STEP = 1 << 20
#: A candidate is almost certainly similar if it is so many standard deviations of the sketches' estimate on the safe side; so many are enough.
SURE, ENOUGH = 3.0, 2
#: Bits that mark classes or keys: eight for each of them, at least and at most so many. A shared bit only moves more rows.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Bits of a word's hash (two words of a line of 50 share them once in 10^12 lines) and of a key, where a shared one only makes more candidates.
WORD, KEY = 52, 40
#: Lines, and bytes of them, whose words are sorted together: in the cache, and with the line's number in the other bits of a hash.
LINES, AT_ONCE = 1 << 64 - WORD, 1 << 18
#: Words of more bytes are hashed one by one.
LONG = 64
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: A task deals out so many rows at a time in blocks, to buckets of about so many rows, whatever the number of partitions.
BLOCK, BUCKET = 1 << 19, 1 << 17
#: Columns of a block and their bytes.
COLUMNS = {"key": KEY // 8, "line_no": 4, "n": 4, "pos": 4, "s1": 8, "s2": 8, "t1": 8, "doc": 8}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the different words of each line, in turn, and their number in each line); words are split at ASCII white space."""
    size, parts, k = np.fromiter(map(len, lines), np.int64, len(lines)) + 1, [], 0
    end = np.cumsum(size)
    while k < len(lines) or not parts:
        z = min(max(int(np.searchsorted(end, AT_ONCE + (end[k - 1] if k else 0), side="right")), k + 1), k + LINES)
        parts.append(_words_of(lines[k:z], size[k:z]))
        k = z
    h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, n


def _words_of(lines: list[bytes], bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """words_of, of LINES lines at most, and their bytes with the line's end. A word is read eight bytes at a time, where it begins."""
    from xxhash import xxh3_64_intdigest

    if not lines:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = b"\n".join(lines)
    buf = np.frombuffer(raw + bytes(8), np.uint8)
    black = np.zeros(len(raw) + 2, bool)
    black[1:-1] = (buf[:-8] != 32) & (buf[:-8] - np.uint8(9) > 4)
    at = np.flatnonzero(black[1:] != black[:-1])
    a, size = at[::2].copy(), at[1::2] - at[::2]
    eight = np.ndarray(len(raw) + 1, "<u8", buf, strides=(1,)).copy()
    h = _mix((eight.take(a) & MASKS.take(size, mode="clip")) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more, k = np.flatnonzero(size > 8), 8
    while len(more) and k < LONG:
        h[more] = _mix(h[more] + (eight.take(a[more] + k) & MASKS.take(size[more] - k, mode="clip")))
        k += 8
        more = more[size[more] > k]
    for i in more.tolist():
        h[i] = xxh3_64_intdigest(raw[a[i] : a[i] + size[i]])
    line = np.repeat(np.arange(len(lines), dtype=np.uint64), np.diff(np.searchsorted(a, np.cumsum(bytes_)), prepend=0))
    x = np.sort(line << np.uint64(WORD) | h >> np.uint64(64 - WORD))
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    x = x[new]
    return x & np.uint64((1 << WORD) - 1), np.bincount((x >> np.uint64(WORD)).astype(np.int64), minlength=len(lines))


@dataclass
class Lines:
    """The lines of a batch of texts that aren't blank. The hashes of line i's different words are h[start[i]] to h[start[i] + n[i] - 1], in any order."""

    text: np.ndarray  # the place of the line's text in the batch
    number: np.ndarray
    t1: np.ndarray  # 64 bits each of a hash of the line as it stands, in small letters
    t2: np.ndarray
    n: np.ndarray
    start: np.ndarray
    h: np.ndarray
    raw: list[bytes]

    def sets(self) -> np.ndarray:
        """64 bits that depend on the set of words only."""
        return np.add.reduceat(self.h, self.start) if len(self.n) else np.zeros(0, np.uint64)


def lines_of(texts: list[str | None], want=None, split: bool = True) -> Lines:
    """Capital A-Z are made small. want(hash, text's place, number): whether a line is wanted. split: whether its words are."""
    from xxhash import xxh3_128_digest

    text, number, raw, hashes = [], [], [], []
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").encode("utf-8", "surrogatepass").lower().split(b"\n")):
            if line and not line.isspace():
                d = xxh3_128_digest(line)
                if want is None or want(d, i, k):
                    text.append(i)
                    number.append(k)
                    hashes.append(d)
                    raw.append(line)
    h, n = words_of(raw if split else [])
    t1, t2 = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2).T
    return Lines(np.array(text, np.int64), np.array(number, np.int64), t1, t2, n, np.cumsum(n) - n, h, raw)


def overlap(sizes):
    """Words that sets of these sizes together must share at least."""
    return -(-UP * sizes // (UP + DOWN))


def prefix(n, share: int = 1):
    """First words of n among which a similar set shares `share`."""
    return np.minimum(n, n - -(-UP * n // DOWN) + share)


def scale(count: np.ndarray) -> np.ndarray:
    """Counts as bytes that keep their order: none, one, and eighths of a power of two."""
    return np.where(count > 1, np.minimum(1 + np.ceil(8 * np.log2(np.maximum(count, 1))), 255), count).astype(np.uint8)


def by_rarity(lines: Lines, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each line in the order of their scaled count and hash: (44 bits of the hash, scaled count). Words that share both are one to the join."""
    bits, out = np.uint64(WORD - 8), [np.zeros(0, np.uint64)]
    for k in range(0, len(lines.n), LINES):
        n = lines.n[k : k + LINES]
        h = lines.h[lines.start[k] : lines.start[k] + n.sum()]
        often = count[(h & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64)
        out.append(np.sort(np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(WORD), n) | often << bits | h >> np.uint64(8)))
    x = np.concatenate(out)
    return x & np.uint64((1 << int(bits)) - 1), (x >> bits).astype(np.uint8)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n[i] numbers from start[i], for each i in turn."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def keys(lines: Lines, count: np.ndarray, frequent: int):
    """(line, key, position) of each line in the join, and a parity sketch of each line in two halves. `count`: scaled counts.
    Sets of fewer than four words resemble only their equals; these, and lines without another key, have their set as a key."""
    h, often = by_rarity(lines, count)
    some = np.flatnonzero(lines.n >= 4)
    size = prefix(lines.n[some])
    at = _ranges(lines.start[some], size)
    line, pos = np.repeat(some, size), at - np.repeat(lines.start[some], size)
    few = (often[at] > 1) & (often[at] < frequent)
    out = [(line[few], h[at[few]], pos[few])]
    many = often[at] >= max(frequent, 2)  # in pairs with every other word of the longer prefix
    at, line, pos = at[many], line[many], pos[many]
    wide = prefix(lines.n, 2)[line]
    i, other = np.repeat(at, wide), _ranges(lines.start[line], wide)
    line, pos = np.repeat(line, wide), np.repeat(pos, wide)
    ok = (other != i) & (often[other] > 1)
    out.append((line[ok], _pair(h[i[ok]], h[other[ok]]), pos[ok]))
    bare = np.flatnonzero(np.bincount(np.concatenate([out[0][0], out[1][0]]), minlength=len(lines.n)) == 0)
    out.append((bare, _mix(lines.sets()[bare]), np.zeros(len(bare), np.int64)))
    bit = lines.h >> np.uint64(WORD - 7)
    flip = np.uint64(1) << (bit & np.uint64(63))
    low = np.where(bit < 64, flip, np.uint64(0))
    halves = [np.bitwise_xor.reduceat(x, lines.start) if len(lines.n) else np.zeros(0, np.uint64) for x in (low, flip ^ low)]
    line, key, pos = (np.concatenate(x) for x in zip(*out, strict=True))
    return (line, key & np.uint64((1 << KEY) - 1), pos), halves


def likely_most(sure: float) -> np.ndarray:
    """For each number of differing bits of two sketches, how many words differ at most: the estimate and `sure` standard deviations."""
    even = np.maximum(1 - np.arange(129) / 64, 1e-3)  # (1 - 1/64) to the number of words
    words = np.log(even) / np.log(1 - 1 / 64)
    spread = 32 * (1 - even**2) + 4064 * ((1 - 1 / 32) ** words - even**2)
    return words + sure * np.sqrt(np.maximum(spread, 0)) / even


def _pair(word: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Keys of ordered pairs: of the shared word and one more."""
    x = (others ^ (word >> np.uint64(7)) ^ (word << np.uint64(57))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32)) ^ word


class Blocks:
    """Rows (id and COLUMNS) that a task holds, dealt out as blocks: one row for each bucket of keys, (bucket, ids, rows)."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, ids, *columns):
        """More rows; gives the batches of blocks once BLOCK rows are held."""
        self.held.append((ids, *columns))
        self.size += len(ids)
        return self.out() if self.size >= BLOCK else ()

    def out(self):
        import pyarrow as pa

        if not self.size:
            return
        ids, *columns = zip(*self.held, strict=True)
        self.held, self.size = [], 0
        columns = [np.concatenate(x) for x in columns]
        bucket = (columns[0].view(np.uint64) % np.uint64(self.buckets)).astype(np.uint16 if self.buckets <= 1 << 16 else np.int32)
        o = np.argsort(bucket, kind="stable")
        ids = pa.concat_arrays(ids).take(pa.array(o))
        rows, k = np.empty((sum(COLUMNS.values()), len(o)), np.uint8), 0
        for x, width in zip(columns, COLUMNS.values(), strict=True):  # bytes of one place stand together, for the shuffle's compression
            rows[k : k + width] = x[o].astype("<i8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T
            k += width
        bucket = bucket[o]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends, step = np.append(first, len(o)), max(1, BATCH_BYTES * len(first) // rows.size)
        for k in range(0, len(first), step):
            e = ends[k : k + step + 1]
            data = pa.array([rows[:, a:z].copy().tobytes() for a, z in zip(e, e[1:], strict=False)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), ids.slice(e[0], e[-1] - e[0]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[e[:-1]].astype(np.int32)), lists, data], names=["bucket", "ids", "rows"])


def _in_order(ids, number: np.ndarray) -> np.ndarray:
    """The order of rows by id, null first, and line number."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not (pa.types.is_integer(ids.type) or pa.types.is_floating(ids.type)):
        by = pa.table({"id": ids, "number": number})
        return pc.sort_indices(by, sort_keys=[("id", "ascending"), ("number", "ascending")], null_placement="at_start").to_numpy().astype(np.int64)
    v = pc.fill_null(ids, 0).to_numpy()
    if pa.types.is_integer(ids.type) and not ids.null_count:
        low = int(v.min())
        bits = [(int(v.max()) - low).bit_length(), int(number.max()).bit_length(), len(v).bit_length()]
        if sum(bits) < 64:  # all in one number: much faster to sort
            return np.sort((v.astype(np.int64) - low) << bits[1] + bits[2] | number << bits[2] | np.arange(len(v))) & (1 << bits[2]) - 1
    return np.lexsort((number, v, pc.is_valid(ids).to_numpy(zero_copy_only=False)))


def unpacked(batches):
    """For each bucket of sorted blocks its rows, sorted by key, id (null first) and line number: the ids, a dict of the
    columns, and whether a row is at another place of the corpus, or of another key, than the row before."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for t in runs(batches, "bucket"):
        bucket = t["bucket"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for a, z in zip(cuts, cuts[1:], strict=False):
            part = t.slice(a, z - a)
            ids = pa.concat_arrays([c.flatten() for c in part["ids"].chunks])
            rows = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8).reshape(sum(COLUMNS.values()), -1) for x in part["rows"]], axis=1)
            x, k = {}, 0
            for name, width in COLUMNS.items():
                wide = np.zeros((rows.shape[1], 8), np.uint8)
                wide[:, :width] = rows[k : k + width].T
                x[name] = wide.view("<i8").ravel()
                k += width
            o = _in_order(ids, x["line_no"])
            key = x["key"][o]
            if len(o) < 1 << 63 - KEY:
                o = o[np.sort(key << 63 - KEY | np.arange(len(o))) & (1 << 63 - KEY) - 1]
            else:
                o = o[np.argsort(key, kind="stable")]
            ids, x = ids.take(pa.array(o)), {c: v[o] for c, v in x.items()}
            new = np.ones(len(o), bool)
            same = pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False) | (pc.is_null(ids[1:]).to_numpy(zero_copy_only=False) & pc.is_null(ids[:-1]).to_numpy(zero_copy_only=False))
            new[1:] = ~same | (x["line_no"][1:] != x["line_no"][:-1]) | (x["key"][1:] != x["key"][:-1])
            yield ids, x, new


def meet(x: dict[str, np.ndarray], new: np.ndarray, enough: int = ENOUGH, sure: float = SURE, probes: np.ndarray | None = None):
    """First the places of copies of earlier lines, then (line, earlier line, words to spare, looks no further), in pieces;
    rows and `new` as `unpacked` gives them.

    With `probes` (one flag a row) only those lines are compared, and with everything before them."""
    key, n, pos, t1 = x["key"], x["n"], x["pos"], x["t1"]
    s1, s2 = x["s1"].view(np.uint64), x["s2"].view(np.uint64)
    lead, n = n & 1 == 1, n >> 1
    place = np.cumsum(new)
    again = n == 0  # its task has met it earlier
    both = t1.view(np.uint64) ^ _mix(key.view(np.uint64))
    o = np.argsort(both)
    both = both[o]
    twice = np.flatnonzero(both[1:] == both[:-1])
    o = np.unique(np.concatenate([o[twice], o[twice + 1]]))  # rows that share a key and t1 with another one, and few others
    o = o[np.lexsort((t1[o], key[o]))]  # stable
    if len(o):
        begins = np.ones(len(o), bool)
        begins[1:] = (key[o[1:]] != key[o[:-1]]) | (t1[o[1:]] != t1[o[:-1]])
        again[o] |= place[o] > place[o[np.flatnonzero(begins)]][np.cumsum(begins) - 1]  # the line stands earlier
    yield np.flatnonzero(again & (lead | (n == 0)))
    real = np.flatnonzero(~again)
    key, n, pos, s1, s2, place = (x[real] for x in (key, n, pos, s1, s2, place))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    start = np.repeat(first, np.diff(np.append(first, len(key))))
    n = n.astype(np.int32 if (n < 1 << 28).all() else np.int64)
    room, rest = np.arange(len(key)) - start, n - pos.astype(n.dtype)
    met, likely = np.zeros(len(key), np.int64), likely_most(sure)
    at, d, out, held = np.flatnonzero(room > 0 if probes is None else (room > 0) & probes[real]), 1, [], 0
    while len(at):
        a, b = n[at - d], n[at]
        ok = np.flatnonzero(np.minimum(a, b) * DOWN >= UP * np.maximum(a, b))
        y, both = at[ok], a[ok] + b[ok]
        need = overlap(both)
        ok = np.flatnonzero(np.minimum(rest[y - d], rest[y]) >= need)
        y = y[ok]
        x, most = y - d, both[ok] - 2 * need[ok]
        far = np.bitwise_count(s1[x] ^ s1[y]).astype(np.int64) + np.bitwise_count(s2[x] ^ s2[y])
        # sets of one size that differ do so in two words
        ok = np.flatnonzero((far <= most) & ((most > 1) | (n[x] != n[y]) | (far == 0)) & (place[x] != place[y]))
        d += 1
        at = at[room[at] >= d]
        if not len(ok):
            continue
        x, y, spare = x[ok], y[ok], most[ok] - likely[far[ok]]
        met[y] += spare >= 0
        full = met[y] >= enough
        out.append((real[y], real[x], spare, full & (room[y] >= d) if probes is None else np.zeros(len(y), bool)))
        held += len(y)
        if probes is None and full.any():
            at = at[met[at] < enough]
        if held > STEP:
            yield [np.concatenate(v) for v in zip(*out, strict=True)]
            out, held = [], 0
    if held:
        yield [np.concatenate(v) for v in zip(*out, strict=True)]


def marks_of(df: DataFrame, total: int) -> np.ndarray:
    """Bits, packed, of all values of the one long column; the bit of x is x modulo their number, a power of two."""
    import pyarrow as pa

    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * total).bit_length()))
    part = 1 << 16  # bits that are sent together

    def mark(batches):
        m = np.zeros(bits // 8, np.uint8)
        for b in batches:
            x = b.column(0).to_numpy() & (bits - 1)
            np.bitwise_or.at(m, x >> 3, np.uint8(1) << (x & 7).astype(np.uint8))
        parts = m.reshape(-1, part // 8)
        at = np.flatnonzero(parts.any(1))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([zlib.compress(parts[k].tobytes(), 1) for k in at], pa.binary())], names=["part", "bits"])

    def join(batches):
        got: dict = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got[k] = got.get(k, 0) | np.frombuffer(zlib.decompress(x), np.uint8)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in got.values()], pa.binary())], names=["part", "bits"])

    schema = "part long, bits binary"
    out = np.zeros((bits // part, part // 8), np.uint8)
    for r in df.mapInArrow(mark, schema).repartition(min(64, bits // part), "part").mapInArrow(join, schema).collect():
        out[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
    return out.reshape(-1)


def marked(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = x & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


@dataclass
class Join:
    """One run of the join over the texts of `docs` (id, text, doc: a hash of both)."""

    docs: DataFrame
    kind: str
    count: object  # a broadcast of the scaled counts
    frequent: int
    enough: int = ENOUGH
    sure: float = SURE
    words_in_all: int = 0  # the sum of the lines' different words

    def candidates(self, probes: tuple | None = None) -> DataFrame:
        """(id, doc, line_no, c, d, spare, more): a line of hash d (t1) is a candidate for the line of hash c there, and comes
        earlier; more: others were not looked at. Where c is null, the line is a copy of an earlier one.

        probes: packed bits of lines and of their keys, where only those lines are asked for."""
        import pyarrow as pa

        spark = self.docs.sparkSession
        sent, frequent, enough, sure = self.count, self.frequent, self.enough, self.sure
        asked = spark.sparkContext.broadcast(tuple(zlib.compress(x.tobytes(), 1) for x in probes)) if probes else None
        unpack = lambda i: np.frombuffer(zlib.decompress(asked.value[i]), np.uint8)
        parts = parts_of(spark)
        buckets = parts * max(1, -(-int(prefix(self.words_in_all)) // (parts * BUCKET)))

        def emit(batches):
            c, seen = np.frombuffer(zlib.decompress(sent.value), np.uint8), {}
            only, blocks = unpack(1) if asked else None, Blocks(buckets)
            for b in batches:
                ids, doc, copies = b.column(0).to_pylist(), b.column(2).to_numpy(), []

                def first(d, i, k, ids=ids, copies=copies):
                    """Whether this task hasn't met the line earlier in the corpus."""
                    at = (ids[i] is not None, ids[i], k)
                    if d in seen and seen[d] < at:
                        copies.append((i, k))
                        return False
                    seen[d] = at
                    return True

                x = lines_of(b.column(1).to_pylist(), first)
                if len(seen) > 1 << 18:  # copies that come twice do no harm
                    seen.clear()
                if copies and not asked:
                    i, k = (np.array(v) for v in zip(*copies, strict=True))
                    none = np.zeros(len(i), np.int64)
                    yield from blocks.add(b.column(0).take(pa.array(i)), doc[i] & (1 << KEY) - 1, k, *[none] * 5, doc[i])
                if not len(x.n):
                    continue
                (line, key, pos), (s1, s2) = keys(x, c, frequent)
                lead = np.zeros(len(line), np.int64)
                lead[np.unique(line, return_index=True)[1]] = 1
                n = 2 * x.n[line] + lead
                if only is not None:
                    ok = marked(only, key.view(np.int64))
                    line, key, pos, n = line[ok], key[ok], pos[ok], n[ok]
                yield from blocks.add(b.column(0).take(pa.array(x.text[line])), key.view(np.int64), x.number[line], n, pos, *(v[line].view(np.int64) for v in (s1, s2)), x.t1[line], doc[x.text[line]])
            yield from blocks.out()

        def pair(batches):
            lines = unpack(0) if asked else None
            names = ["id", "doc", "line_no", "c", "d", "spare", "more"]
            for ids, t, new in unpacked(batches):
                t1 = t["t1"]
                found = meet(t, new, enough, sure, None if lines is None else marked(lines, t1))
                of = lambda y, ids=ids, t=t: [ids.take(pa.array(y)), pa.array(t["doc"][y]), pa.array(t["line_no"][y])]
                y = next(found)
                if asked is None and len(y):
                    yield pa.RecordBatch.from_arrays([*of(y), *(pa.nulls(len(y), kind) for kind in (pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], names=names)
                for y, x, spare, more in found:
                    yield pa.RecordBatch.from_arrays([*of(y), pa.array(t1[y]), pa.array(t1[x]), pa.array(spare), pa.array(more)], names=names)

        keyed = self.docs.mapInArrow(emit, f"bucket int, ids array<{self.kind}>, rows binary")
        keyed = keyed.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")
        found = keyed.mapInArrow(pair, f"id {self.kind}, doc long, line_no long, c long, d long, spare double, more boolean")
        return cut(found.groupBy("id", "doc", "line_no", "c", "d").agg(F.max("spare").alias("spare"), F.max("more").alias("more")))

    def only(self, wanted: np.ndarray) -> Join:
        """The join over those lines alone that have a key marked in `wanted`: texts without one go, other lines are blank.
        Of lines that a task has met earlier in the corpus the earlier one is enough."""
        import pyarrow as pa

        sent, frequent = self.count, self.frequent
        bits = self.docs.sparkSession.sparkContext.broadcast(zlib.compress(wanted.tobytes(), 1))

        def run(batches):
            c, m, seen = np.frombuffer(zlib.decompress(sent.value), np.uint8), np.frombuffer(zlib.decompress(bits.value), np.uint8), {}
            for b in batches:
                ids = b.column(0).to_pylist()

                def first(d, i, k, ids=ids):
                    at = (ids[i] is not None, ids[i], k)
                    if d in seen and seen[d] < at:
                        return False
                    seen[d] = at
                    return True

                x = lines_of(b.column(1).to_pylist(), first)
                if len(seen) > 1 << 18:
                    seen.clear()
                (line, key, _), _ = keys(x, c, frequent)
                texts: dict = {}
                for k in np.unique(line[marked(m, key.view(np.int64))]).tolist():
                    texts.setdefault(int(x.text[k]), {})[int(x.number[k])] = x.raw[k]
                if texts:
                    at = pa.array(list(texts))
                    text = [b"\n".join(t.get(k, b"") for k in range(max(t) + 1)).decode("utf-8", "surrogatepass") for t in texts.values()]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(text, pa.string()), b.column(2).take(at)], names=["id", "text", "doc"])

        return replace(self, docs=cut(self.docs.mapInArrow(run, f"id {self.kind}, text string, doc long")))

    def words(self, pairs: DataFrame) -> DataFrame:
        """(t1, t2, words) of all lines in the pairs."""
        import pyarrow as pa

        spark = self.docs.sparkSession
        both = pairs.select("c").union(pairs.select("d"))
        wanted = spark.sparkContext.broadcast(zlib.compress(marks_of(both, 2 * pairs.count()).tobytes(), 1))

        def run(batches):
            m, seen = zlib.decompress(wanted.value), set()
            last = 8 * len(m) - 1

            def asked(d, i, k):
                x = int.from_bytes(d[:8], "little") & last
                if not m[x >> 3] >> (x & 7) & 1 or d in seen:
                    return False
                seen.add(d)
                return True

            for b in batches:
                x = lines_of(b.column(0).to_pylist(), asked, split=False)
                if len(seen) > 1 << 18:
                    seen.clear()
                if len(x.raw):
                    yield pa.RecordBatch.from_arrays([pa.array(x.t1), pa.array(x.t2), pa.array([b" ".join(set(r.split())) for r in x.raw], pa.binary())], names=["t1", "t2", "words"])

        # F.first: of one hash of 128 bits there is one text. Two texts may share t1: then both are compared.
        text = self.docs.select("text").mapInArrow(run, "t1 long, t2 long, words binary").repartition(parts_of(spark), "t1")
        return cut(text.groupBy("t1", "t2").agg(F.first("words").alias("words")))

    def verified(self, pairs: DataFrame, text: DataFrame) -> DataFrame:
        """The pairs that are similar."""
        split = lambda c: F.split(F.col(c).cast("string"), " ")
        earlier = text.select(F.col("t1").alias("d"), F.col("words").alias("wd"))
        own = text.select(F.col("t1").alias("c"), F.col("words").alias("wc"))
        rows = pairs.join(earlier, "d").join(own, "c").withColumn("wc", split("wc")).withColumn("wd", split("wd"))
        shared = F.size(F.array_intersect("wc", "wd"))
        return rows.where((UP + DOWN) * shared >= UP * (F.size("wc") + F.size("wd"))).drop("wc", "wd")

    def late(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(id, doc, line_no) of lines for which a candidate is similar; (id, doc, line_no, c) of those for which none is but
        others were not looked at; the words."""
        text = self.words(pairs)
        best = cut(pairs.groupBy(*LINE, "c").agg(F.max_by("d", "spare").alias("d"), F.max("more").alias("more"), F.count(F.lit(1)).alias("k")))
        good = cut(self.verified(best, text).select(*LINE).distinct())
        left = cut(without(best, good).select(*LINE, "c", "more", "k"))
        rest = left.where("k > 1").select(*LINE)
        if rest.limit(1).count():
            more = cut(self.verified(within(pairs, rest), text).select(*LINE).distinct())
            good, left = good.union(more), cut(without(left, more))
        return good, left.where("more").select(*LINE, "c"), text


LINE = ["id", "doc", "line_no"]


def _same(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
    o = other.select(*(F.col(c).alias(f"_{c}") for c in LINE))
    return df.join(o, F.expr("doc = _doc AND line_no = _line_no AND id <=> _id"), how)


def within(df: DataFrame, lines: DataFrame) -> DataFrame:
    return _same(df, lines, "left_semi")


def without(df: DataFrame, lines: DataFrame) -> DataFrame:
    return _same(df, lines, "left_anti")


def parts_of(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def removed_lines(docs: DataFrame, kind: str, enough: int = ENOUGH, sure: float = SURE) -> DataFrame:
    """(id, doc, line_no) of the lines of docs (id, text, doc) that are equal or similar to an earlier one.

    Texts are read three times: for counts of words, for keys, and for the words of lines in a pair. So words move only for
    pairs. A second round, if there must be one, reads them once more."""
    import pyarrow as pa

    spark = docs.sparkSession

    def tally(batches):
        count, seen = np.zeros(BUCKETS, np.uint32), set()

        def fresh(d, i, k):
            if d in seen:  # copies of a line add nothing to the counts of its words
                return False
            seen.add(d)
            return True

        for b in batches:
            x = lines_of(b.column(0).to_pylist(), fresh)
            if len(seen) > 1 << 18:
                seen.clear()
            np.add.at(count, (x.h & np.uint64(BUCKETS - 1)).astype(np.int64), np.uint32(1))  # of one type: else 15 times slower
        chunks, counts = packed_counts(count)
        if chunks:
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(counts, pa.binary())], names=["chunk", "counts"])

    count = summed_counts(docs.select("text").mapInArrow(tally, "chunk long, counts binary"), BUCKETS)
    frequent = int(scale(np.array([max(FREQUENT, MEANS * float(count.mean()))]))[0])
    sent = spark.sparkContext.broadcast(zlib.compress(scale(count).tobytes(), 1))  # at most 4 MB
    join = Join(docs, kind, sent, frequent, enough, sure, int(count.sum()))
    found = join.candidates()
    pairs = found.where("c is not null")
    late, open_, text = join.late(pairs)
    out = found.where("c is null").select(*LINE).union(late)
    if n := open_.count():
        out = out.union(second_round(join, open_, text, n))
    return out


def second_round(join: Join, open_: DataFrame, text: DataFrame, n: int) -> DataFrame:
    """(id, doc, line_no) of the lines `open_` for which a similar earlier one is found among all that meet them."""
    import pyarrow as pa

    sent, frequent = join.count, join.frequent

    def of(batches):
        c = np.frombuffer(zlib.decompress(sent.value), np.uint8)
        for b in batches:
            (_, key, _), _ = keys(lines_of([x.decode("utf-8", "surrogatepass") for x in b.column(0).to_pylist()]), c, frequent)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    hashes = open_.select("c").distinct()
    asked = text.join(hashes, F.col("t1") == F.col("c"), "left_semi").select("words").mapInArrow(of, "key long").distinct()
    lines, wanted = marks_of(hashes, n), marks_of(asked, 16 * n)
    join = join.only(wanted)
    pairs = join.candidates((lines, wanted))
    return cut(join.verified(pairs, join.words(pairs)).select(*LINE).distinct())


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", enough: int = ENOUGH, sure: float = SURE) -> DataFrame:
    """One row for each row of df: <id_col>, n_lines, n_removed and removed, the numbers (from 0) of the removed lines in order.

    Null texts count as empty, which is one blank line. Null ids come first in the order of lines. Where rows repeat an
    id, equal or similar lines at one number are none earlier than the other, and both stay. Other columns are not read."""
    prepare(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("doc"))
    gone = removed_lines(docs, df.schema[id_col].dataType.simpleString(), enough, sure)
    gone = gone.groupBy("id", "doc").agg(F.sort_array(F.collect_set("line_no")).alias("removed")).select(F.col("id").alias("_id"), F.col("doc").alias("_doc"), "removed")
    lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    out = docs.select("id", "doc", lines.cast("long").alias("n_lines")).join(gone, F.expr("doc = _doc AND id <=> _id"), "left")
    out = out.withColumn("removed", F.coalesce("removed", F.expr("cast(array() as array<bigint>)")))
    return out.select(F.col("id").alias(id_col), "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")
