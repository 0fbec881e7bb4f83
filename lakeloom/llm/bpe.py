"""BPE encoding and decoding by tree concatenation.

A text that is longer than a leaf is halved at the blank nearest its middle, and so on; leaves are encoded, and halves
are joined level by level. A leaf's encoding is a list of pieces, across whose ends no merge goes. Where a piece ends
depends only on what follows its beginning, so of a left half all but the last piece stand. At a join, a window of the
last pieces of the left half and the first of the right one is encoded anew, and grows until its outermost pieces are
those that stood there before: from there on, the right half's pieces are those of the whole.

A run without a blank has no such ends. It is halved anywhere; its merged sequence is right exactly if each two
neighbouring tokens are: the tokenizer, given the bytes of both, returns these two. So a window of the last tokens of the
left half and the first of the right one is encoded anew, and grows until its outermost tokens are those that stood there
before; then every pair of neighbours is right, and so is the whole.

Documents of more than LONG characters are dealt out in parts that end with a pre-token, or in halves of a pre-token that
is too long for one part; parts are encoded side by side and joined per document in the same two ways."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._util import prepare
from lakeloom.llm.tok import Encoder, encoder

#: Characters of a document from which on it is dealt out in parts, and of a part; bytes of a leaf.
LONG, PART, LEAF = 49_152, 24_576, 4096
FIRST_WINDOW = 8
BLANKS = " \n\r\t"
BLANK = re.compile(f"[{BLANKS}]")


def join_halves(enc: Encoder, left: np.ndarray, right: np.ndarray, table: list[bytes]) -> np.ndarray:
    """The exact encoding of the text of which both sides are halves."""
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    enc.joins += 1
    k = FIRST_WINDOW
    while True:
        a, b = min(k, len(left)), min(k, len(right))
        around = np.concatenate([left[len(left) - a :], right[:b]])
        new = np.array(enc.bpe(b"".join(table[i] for i in around.tolist())), "<u4")
        if (a == len(left) or new[0] == left[len(left) - a]) and (b == len(right) or new[-1] == right[b - 1]):
            return np.concatenate([left[: len(left) - a], new, right[b:]])
        k *= 2


def tree_join(enc: Encoder, parts: list[np.ndarray]) -> np.ndarray:
    """Joins neighbours level by level: a tree of logarithmic height."""
    table = table_of(enc)
    while len(parts) > 1:
        parts = [join_halves(enc, *parts[i : i + 2], table) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else np.zeros(0, "<u4")


Pieces = tuple[list[str], list[bytes]]


def join_pieces(enc: Encoder, left: Pieces, right: Pieces) -> Pieces:
    """The exact pieces, and their ids, of the text of which both sides are halves."""
    (lp, li), (rp, ri) = left, right
    if not lp or not rp:
        return lp + rp, li + ri
    enc.joins += 1
    k = 1
    while True:
        a, b = min(k, len(lp)), min(k, len(rp))
        new = enc.pieces("".join(lp[len(lp) - a :] + rp[:b]))
        if (a == len(lp) or new[0] == lp[len(lp) - a]) and (b == len(rp) or new[-1] == rp[b - 1]):
            return lp[: len(lp) - a] + new + rp[b:], li[: len(li) - a] + [enc.get(x) for x in new] + ri[b:]
        k *= 2


def join_all(enc: Encoder, parts: list[Pieces]) -> Pieces:
    while len(parts) > 1:
        parts = [join_pieces(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else ([], [])


def leaves_of(text: str, leaf: int = LEAF) -> list[str]:
    """Halves at the blank nearest the middle, down to `leaf` characters or to runs without a blank."""
    if len(text) <= leaf:
        return [text]
    m = len(text) // 2
    before = max(text.rfind(c, 1, m) for c in BLANKS)
    after = BLANK.search(text, m)
    at = after.start() if after and (before < 1 or after.start() - m < m - before) else before
    return leaves_of(text[:at], leaf) + leaves_of(text[at:], leaf) if at > 0 else [text]


def encode_pieces(enc: Encoder, text: str, leaf: int = LEAF) -> Pieces:
    """By the tree. For texts that `enc.divides`."""
    return join_all(enc, [(p := enc.pieces(x), [enc.get(y) for y in p]) for x in leaves_of(text, leaf)])


def encode_text(enc: Encoder, text: str | None, leaf: int = LEAF) -> bytes:
    """ids of a whole text, by the tree if it is longer than a leaf."""
    return b"".join(encode_pieces(enc, text, leaf)[1]) if text and len(text) > leaf and enc.divides(text) else enc.encode(text)


def tree_encode(enc: Encoder, raw: bytes, leaf: int = LEAF) -> np.ndarray:
    """One long pre-token, from leaves of at most `leaf` bytes."""
    return tree_join(enc, [np.array(enc.bpe(x), "<u4") for x in halves(raw, leaf)])


def halves(raw, leaf: int) -> list:
    if len(raw) <= leaf:
        return [raw]
    m = len(raw) // 2
    return halves(raw[:m], leaf) + halves(raw[m:], leaf)


_tables: dict[int, list[bytes]] = {}


def table_of(enc: Encoder) -> list[bytes]:
    if id(enc) not in _tables:
        _tables[id(enc)] = enc.token_bytes()
    return _tables[id(enc)]


_flat: dict[int, tuple] = {}


def decode(enc: Encoder, ids: bytes, at_once: int = 1 << 18) -> str:
    """The text of the ids (little-endian unsigned 32-bit), special tokens included; bytes that are no UTF-8 become U+FFFD."""
    if id(enc) not in _flat:
        table = table_of(enc)
        size = np.array([len(x) for x in table], np.int64)
        _flat[id(enc)] = np.frombuffer(b"".join(table), np.uint8), size, np.cumsum(size) - size
    flat, size, start = _flat[id(enc)]
    every, out = np.frombuffer(ids, "<u4"), []
    for i in range(0, len(every), at_once):
        x = every[i : i + at_once]
        n = size[x]
        end = np.cumsum(n)
        out.append(flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start[x] - end + n, n)].tobytes())
    return b"".join(out).decode("utf-8", "replace")


def parts_of(enc: Encoder, text: str, part: int = PART) -> list[tuple[str, int]]:
    """(text, kind) in turn; kind 0: whole pre-tokens, 1: the first piece of one long pre-token, 2: a further piece of it, 3: a special token."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    size = 0
    for special, p in enc.pretokens(text):
        if held and (special is not None or size + len(p) > part):
            out.append(("".join(held), 0))
            held, size = [], 0
        if special is not None:
            out.append((p, 3))
        elif len(p) > part:
            out.extend((x, 2 if i else 1) for i, x in enumerate(halves(p, part)))
        else:
            held.append(p)
            size += len(p)
    if held:
        out.append(("".join(held), 0))
    return out


def encode_part(enc: Encoder, text: str, kind: int) -> tuple[bytes, bytes | None]:
    """ids, and for whole pre-tokens the characters and ids of each piece (32-bit integers in turn), if they can be joined by pieces."""
    if kind == 3:
        return np.array([enc.special[text]], "<u4").tobytes(), None
    if kind:
        return tree_encode(enc, text.encode(), LEAF).astype("<u4").tobytes(), None
    if not enc.divides(text):
        return enc.encode(text), None
    pieces, ids = encode_pieces(enc, text)
    return b"".join(ids), np.array([[len(x) for x in pieces], [len(x) // 4 for x in ids]], "<i4").T.tobytes()


def pieces_of(text: str, ids: bytes, cuts: bytes) -> Pieces:
    chars, tokens = np.frombuffer(cuts, "<i4").reshape(-1, 2).T
    part = lambda x, ends: [x[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return part(text, np.cumsum(chars).tolist()), part(ids, (4 * np.cumsum(tokens)).tolist())


def join_parts(enc: Encoder, parts: list[tuple[int, str, bytes, bytes | None]]) -> bytes:
    """The ids of a document from its parts (kind, text, ids, cuts) in turn."""
    out: list[bytes] = []
    i = 0
    while i < len(parts):
        j, like = i + 1, (lambda p: p[3] is not None) if parts[i][3] is not None else (lambda p: p[0] == 2)
        while j < len(parts) and like(parts[j]):
            j += 1
        run = parts[i:j]
        if parts[i][3] is not None:
            out += join_all(enc, [pieces_of(*p[1:]) for p in run])[1]
        else:
            out.append(tree_join(enc, [np.frombuffer(p[2], "<u4") for p in run]).astype("<u4").tobytes())
        i = j
    return b"".join(out)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, part: int = PART) -> DataFrame:
    """One row for each row of df: <id_col>, ids (binary, little-endian unsigned 32-bit) and decoded (text).

    `path`: a byte-level file of the tokenizers library. A null text counts as empty: no ids, empty decoded text. Null and
    repeated ids pass through; other columns of df, whatever their names, are not read."""
    import pyarrow as pa

    spark = df.sparkSession
    prepare(spark)
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = {"id": kind.simpleString(), "ids": "binary", "decoded": "string"}
    schema = ", ".join(f"{k} {v}" for k, v in out.items())

    def whole(batches):
        enc = encoder(path, LEAF)
        for b in batches:
            ids = [encode_text(enc, x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([decode(enc, x) for x in ids], pa.string())], names=list(out))

    def split(batches):
        from pyspark import TaskContext

        enc, n, me = encoder(path, LEAF), 0, TaskContext.get().partitionId() << 33
        for b in batches:
            for i, text in enumerate(b.column(1).to_pylist()):
                found = parts_of(enc, text, part)
                key = me + n
                n += 1
                k = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([key] * k, pa.int64()), b.column(0).slice(i, 1).take(pa.array([0] * k)), pa.array(range(k), pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[0] for x in found], pa.string())], names=["key", "id", "no", "kind", "text"])

    def leaves(batches):
        enc = encoder(path, LEAF)
        for b in batches:
            got = [encode_part(enc, *x) for x in zip(b.column(4).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[k] for x in got], pa.binary()) for k in (0, 1))], names=["key", "id", "no", "kind", "text", "ids", "cuts"])

    def join(table):
        enc = encoder(path, LEAF)
        t = table.sort_by("no")
        ids = join_parts(enc, list(zip(*(t[k].to_pylist() for k in ("kind", "text", "ids", "cuts")), strict=True)))
        return pa.table({"id": t["id"].slice(0, 1), "ids": pa.array([ids], pa.binary()), "decoded": pa.array([decode(enc, ids)], pa.string())})

    short = rows.where(F.length("text") <= long).mapInArrow(whole, schema)
    tall = rows.where(F.length("text") > long).mapInArrow(split, f"key long, id {out['id']}, no int, kind int, text string")
    tall = tall.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "no").mapInArrow(leaves, f"key long, id {out['id']}, no int, kind int, text string, ids binary, cuts binary")
    tall = tall.groupBy("key").applyInArrow(join, schema)
    return short.unionByName(tall).select(F.col("id").alias(id_col), "ids", "decoded")
