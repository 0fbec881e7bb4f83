"""Token-id files: Arrow streams of fixed-size lists.

A file holds equal-length sequences (`ids`: fixed_size_list of uint16 or uint32) and their masks (`mask`:
fixed_size_list of bool, false where the last sequence is padded), always ROWS sequences in a batch but the last. A
mapped file is read without copying: sequence i is row i % ROWS of batch i // ROWS. Beside it lies an Arrow stream that
says which document comes next and how long it is. Documents run on in ascending id order through the files in turn."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._util import prepare
from lakeloom.llm.tok import encoder

SEQUENCE, ROWS = 2048, 64
#: Bytes of text that a file has at most, where ids are even.
PART_BYTES = 128 << 20


def place(uri: str):
    """(file system, path) of a URI or local path, as pyarrow's own connectors open it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Writer:
    """One file; buffers at most one batch of sequences and the lengths of documents."""

    def __init__(self, sink, vocabulary: int, sequence: int = SEQUENCE, rows: int = ROWS):
        import pyarrow as pa

        self.kind = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
        value = pa.uint16() if self.kind.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(value, sequence)), ("mask", pa.list_(pa.bool_(), sequence))], metadata={b"rows": str(rows).encode()})
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.sequence, self.rows, self.held, self.size, self.total = sequence, rows, [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.size += len(ids)
        self.total += len(ids)
        full = self.sequence * self.rows
        if self.size >= full:
            x = np.concatenate(self.held)
            for i in range(0, len(x) - full + 1, full):
                self._write(x[i : i + full], full)
            x = x[len(x) // full * full :]
            self.held, self.size = [x], len(x)

    def _write(self, x: np.ndarray, real: int) -> None:
        import pyarrow as pa

        mask = np.arange(len(x)) < real
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(v), self.sequence) for v in (x, mask)], schema=self.schema))

    def close(self) -> None:
        if self.size:
            x = np.concatenate(self.held)
            self._write(np.concatenate([x, np.zeros(-len(x) % self.sequence, self.kind)]), len(x))
        self.out.close()


class TokenFile:
    """Random access to a local or mapped file: `file[i]` gives (ids, mask) of sequence i; the ids are a view of the file."""

    def __init__(self, path: str):
        import pyarrow as pa

        self.reader = pa.ipc.open_stream(pa.memory_map(path))
        self.batches = list(self.reader)
        self.rows = int(self.reader.schema.metadata[b"rows"])

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int):
        b, r = self.batches[i // self.rows], i % self.rows
        n = b.schema.field("ids").type.list_size
        return b.column(0).values.slice(r * n, n).to_numpy(), b.column(1).values.slice(r * n, n).to_numpy(zero_copy_only=False)


def write_token_files(df: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, sequence: int = SEQUENCE) -> list[dict]:
    """Writes files to `folder` (shared by all executors) and returns their list in order: part, n_docs, n_tokens, base.

    A document is its ids and `end_id`; null texts count as empty. Null ids come first, repeated ids next to each other.
    Each task writes under a name of its own and renames when it is done, so a task that runs again does no harm. The
    list has a row for each partition, which doesn't depend on the number of documents."""
    import pyarrow as pa

    spark = df.sparkSession
    prepare(spark)
    size = df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange(parts, "id").sortWithinPartitions("id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(path)
        end = np.array([end_id], "<u4")
        store, at = place(folder)
        store.create_dir(at, recursive=True)
        own = f"{at}/_{uuid.uuid4().hex}"
        ids, lengths, id_type = [], [], None
        with store.open_output_stream(own) as f:
            w = Writer(f, enc.t.get_vocab_size(), sequence)
            for b in batches:
                id_type = b.column(0).type
                ids.append(b.column(0))
                for text in b.column(1).to_pylist():
                    x = np.concatenate([np.frombuffer(enc.encode(text), "<u4"), end])
                    w.add(x)
                    lengths.append(len(x))
            w.close()
        if lengths:
            with store.open_output_stream(own + ".docs") as f:
                t = pa.table({"id": pa.chunked_array(ids, id_type), "n_tokens": pa.array(lengths, pa.int64())})
                with pa.ipc.new_stream(f, t.schema) as out:
                    out.write_table(t)
            store.move(own, f"{at}/part-{part:06d}.arrows")
            store.move(own + ".docs", f"{at}/part-{part:06d}.docs.arrows")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(lengths)], pa.int64()), pa.array([sum(lengths)], pa.int64())], names=["part", "n_docs", "n_tokens"])
        else:
            store.delete_file(own)

    files, base = [], 0
    for r in sorted(rows.mapInArrow(run, "part long, n_docs long, n_tokens long").collect()):
        files.append({**r.asDict(), "base": base, "id_type": kind})
        base += r["n_tokens"]
    return files


def read_documents(spark, folder: str, files: list[dict], id_type: str = "bigint") -> DataFrame:
    """One row for each document, from the files: id, start, n_tokens and ids (binary, little-endian unsigned 32-bit)."""
    import pyarrow as pa

    schema = f"id {id_type}, start long, n_tokens long, ids binary"
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(f["part"], f["base"]) for f in files], "part long, base long").repartition(len(files), "part")

    def run(batches):
        for b in batches:
            for part, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, at = place(folder)
                with store.open_input_file(f"{at}/part-{part:06d}.arrows") as f, store.open_input_stream(f"{at}/part-{part:06d}.docs.arrows") as g:
                    stream, docs = pa.ipc.open_stream(f), pa.ipc.open_stream(g).read_all()
                    held, start = np.zeros(0, "<u4"), base
                    lengths = docs["n_tokens"].to_numpy()
                    for i in range(0, len(lengths), 64):
                        got = []
                        for n in lengths[i : i + 64].tolist():
                            chunks = [held]
                            have = len(held)
                            while have < n:
                                x = stream.read_next_batch()
                                mask = x.column(1).values.to_numpy(zero_copy_only=False)
                                chunks.append(x.column(0).values.to_numpy()[mask].astype("<u4"))
                                have += len(chunks[-1])
                            held = np.concatenate(chunks) if len(chunks) > 1 else held
                            got.append(held[:n].tobytes())
                            held = held[n:]
                        n = lengths[i : i + 64]
                        starts = start + np.cumsum(n) - n
                        start += int(n.sum())
                        yield pa.RecordBatch.from_arrays([docs["id"].slice(i, 64).combine_chunks(), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(got, pa.binary())], names=["id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(run, schema)
