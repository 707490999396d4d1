"""Token id files of independent zstandard frames, with a document index and a trailing seek table.

A file is, in this order:

    frames              each holds ids of one document (little-endian, 2 or 4 bytes an id) and the frame's content
                        checksum; a document has one frame for each `frame_ids` ids, so at least one
    skippable frame     document index: an Arrow stream (doc_id, n_tokens, n_frames), compressed; its schema says the
                        bytes of an id
    skippable frame     seek table of the public seekable format: for each frame its compressed size, its plain size and
                        a checksum (low 32 bits of XXH64 of the plain bytes), then the number of frames, a flag byte and
                        the magic number

Any zstandard reader decodes the whole file as one stream of ids. A reader of single documents seeks the footer, the seek
table and the index, and decompresses the frames of the documents that it was asked for.

Documents are encoded and compressed where they are read; only frames travel to their place in the order of ids. Rows
of one id are ordered by a hash of their text and dealt by row number, so no id is too frequent for a range. Each task
writes one file under a name of its own attempt; a Parquet table beside the files lists those that count, so files of
lost or repeated attempts are never read.

Null texts are empty and still have the end id. Rows without id come first. Repeated rows are written each. An empty
table gives no files and an empty result. Only the named columns are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lagweave.core.session import cut_lineage
from lagweave.llm import kernels as K
from lagweave.llm.chunk_encoder import ChunkEncoder
from lagweave.llm.worker import kept

END_ID = 2
FRAME_IDS = 1 << 18
FILE_BYTES, LEAST_FILE_BYTES = 256 << 20, 4 << 20
LEVEL = 3
READ_BYTES = 4 << 20

# Fixed values of the public zstandard formats.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
SKIPPABLE, ENTRY, FOOTER = "<II", "<III", "<IBI"
SKIPPABLE_BYTES, ENTRY_BYTES, FOOTER_BYTES = map(struct.calcsize, (SKIPPABLE, ENTRY, FOOTER))
HAS_CHECKSUMS = 0x80

ENCODED = "tie long, n_tokens long, sizes array<struct<packed: long, plain: long, checksum: long>>, frames binary"
MANIFEST = "part int, file string, n_docs long, n_tokens long, n_bytes long"


def file_encoder(path: str, end_id: int, frame_ids: int, level: int) -> Callable:
    """Task function: (doc_id, tie, text) to each document's frames, compressed one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        encoder = kept(("chunks", path, end_id), lambda: ChunkEncoder(path, end_id))
        width = 2 if max(encoder.vocabulary - 1, end_id) < 1 << 16 else 4
        compress = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        step = frame_ids * width
        for batch in batches:
            for rows, data, offsets in K.text_slices(batch, "text"):
                ids, bounds = encoder.encode(data, offsets)
                raw, ends = memoryview(ids.astype(f"<u{width}").tobytes()), (bounds * width).tolist()
                sizes, frames = [], []
                for a, b in zip(ends[:-1], ends[1:]):
                    plain = [raw[x:min(x + step, b)] for x in range(a, b, step)]
                    packed = [compress(x) for x in plain]
                    sizes.append([{"packed": len(p), "plain": len(x), "checksum": xxhash.xxh64_intdigest(x) & 0xFFFFFFFF} for p, x in zip(packed, plain)])
                    frames.append(b"".join(packed))
                size = pa.list_(pa.struct([("packed", pa.int64()), ("plain", pa.int64()), ("checksum", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(np.diff(bounds)), pa.array(sizes, size), pa.array(frames, pa.binary())],
                    names=["doc_id", "tie", "n_tokens", "sizes", "frames"])
        K.release_memory()

    return run


def _open(place: str):
    """The file system and path behind a folder or file name, whatever its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(place)


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack(SKIPPABLE, magic, len(body)) + body


def _index_frame(schema: pa.Schema, batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for b in batches:
            w.write_batch(b)
    return _skippable(INDEX_MAGIC, sink.getvalue().to_pybytes())


def _seek_table(sizes: np.ndarray) -> bytes:
    """From rows (packed, plain, checksum)."""
    return _skippable(TABLE_MAGIC, sizes.astype("<u4").tobytes() + struct.pack(FOOTER, len(sizes), HAS_CHECKSUMS, FOOTER_MAGIC))


def file_writer(folder: str, width: int) -> Callable:
    """Task function over (part, doc_id, n_tokens, sizes, frames) in order: writes one file for each task with rows and
    yields its line of the manifest. The index of a file stays in memory until its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = part = schema = None
        index: list[pa.RecordBatch] = []
        sizes: list[np.ndarray] = []
        n_tokens = n_docs = 0
        for b in batches:
            if not len(b):
                continue
            if out is None:
                fs, root = _open(folder)
                part = b.column(0)[0].as_py()
                name = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
                schema = pa.schema([b.schema.field(1).with_name("doc_id"), ("n_tokens", pa.int64()), ("n_frames", pa.int64())], {"id_bytes": str(width)})
            each = b.column(3)
            flat = each.flatten()
            sizes.append(np.stack([flat.field(k).to_numpy() for k in range(3)], 1))
            counts = np.diff(each.offsets.to_numpy())
            index.append(pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(counts.astype(np.int64))], schema=schema))
            for x in b.column(4):
                out.write(x.as_buffer())
            n_docs += len(b)
            n_tokens += int(b.column(2).to_numpy().sum())
        if out is not None:
            out.write(_index_frame(schema, index))
            out.write(_seek_table(np.concatenate(sizes)))
            n_bytes = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_bytes": [n_bytes]})
            K.release_memory()

    return run


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
                 frame_ids: int = FRAME_IDS, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> DataFrame:
    """Writes the ids of all documents under `folder`, ascending by id, and returns the manifest of its files."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    encoded = cut_lineage(rows.mapInArrow(file_encoder(path, end_id, frame_ids, level), f"doc_id {kind}, {ENCODED}")
                          .withColumn("row", F.monotonically_increasing_id()))
    total = encoded.agg(F.sum(F.length("frames"))).first()[0] or 0
    files = max(1, -(-total // file_bytes), min(spark.sparkContext.defaultParallelism, total // LEAST_FILE_BYTES))
    order = ["doc_id", "tie", "row"]
    dealt = encoded.repartitionByRange(files, *order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "sizes", "frames")
    width = 2 if max(_vocabulary(path) - 1, end_id) < 1 << 16 else 4
    dealt.mapInArrow(file_writer(folder, width), MANIFEST).write.parquet(f"{folder}/manifest")
    return open_tokens(spark, folder)


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def open_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a folder: part, file (whole name), n_docs, n_tokens, n_bytes and first_token, the ids in all files
    before. It has one row for each file, so one window over all of it is small."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select(
        "part", F.concat(F.lit(f"{folder}/"), "file").alias("file"), "n_docs", "n_tokens", "n_bytes",
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first_token"))


@dataclass
class TokenFile:
    """One open file: its index and seek table, and the ids of single documents."""

    source: pa.NativeFile
    index: pa.Table
    sizes: np.ndarray
    at: np.ndarray
    first_frame: np.ndarray
    width: int

    @classmethod
    def open(cls, place: str) -> TokenFile:
        fs, name = _open(place)
        source = fs.open_input_file(name)
        end = source.size()
        count, flags, magic = struct.unpack(FOOTER, source.read_at(FOOTER_BYTES, end - FOOTER_BYTES))
        if magic != FOOTER_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError(f"{place} has no seek table")
        table_at = end - FOOTER_BYTES - ENTRY_BYTES * count - SKIPPABLE_BYTES
        head = struct.unpack(SKIPPABLE, source.read_at(SKIPPABLE_BYTES, table_at))
        if head != (TABLE_MAGIC, ENTRY_BYTES * count + FOOTER_BYTES):
            raise ValueError(f"the seek table of {place} is damaged")
        sizes = np.frombuffer(source.read_at(ENTRY_BYTES * count, table_at + SKIPPABLE_BYTES), "<u4").reshape(-1, 3).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(sizes[:, 0])))
        magic, size = struct.unpack(SKIPPABLE, source.read_at(SKIPPABLE_BYTES, int(at[-1])))
        if magic != INDEX_MAGIC or int(at[-1]) + SKIPPABLE_BYTES + size != table_at:
            raise ValueError(f"the document index of {place} is damaged")
        index = pa.ipc.open_stream(source.read_at(size, int(at[-1]) + SKIPPABLE_BYTES)).read_all()
        frames = np.concatenate(([0], np.cumsum(index.column("n_frames").to_numpy())))
        return cls(source, index, sizes, at, frames, int(index.schema.metadata[b"id_bytes"]))

    def _plain(self, frame: int, packed: memoryview) -> bytes:
        """A frame's bytes, after its own checksum (by the decoder) and that of the seek table."""
        import xxhash
        import zstandard

        plain = zstandard.ZstdDecompressor().decompress(packed)
        if len(plain) != self.sizes[frame, 1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sizes[frame, 2]:
            raise ValueError(f"frame {frame} does not match the seek table")
        return plain

    def frames(self, first: int, last: int) -> Iterator[bytes]:
        """The plain bytes of frames first to last - 1, read a few MB at a time."""
        while first < last:
            stop = int(np.searchsorted(self.at, self.at[first] + READ_BYTES, "right")) - 1
            stop = min(max(stop, first + 1), last)
            raw = memoryview(self.source.read_at(int(self.at[stop] - self.at[first]), int(self.at[first])))
            base = int(self.at[first])
            for f in range(first, stop):
                yield self._plain(f, raw[int(self.at[f]) - base:int(self.at[f + 1]) - base])
            first = stop

    def ids(self, position: int) -> np.ndarray:
        """All ids of the document at this place of the index."""
        raw = b"".join(self.frames(int(self.first_frame[position]), int(self.first_frame[position + 1])))
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def document_reader(with_ids: bool) -> Callable:
    """Task function over (file, first_token): every document of the files, its ids decompressed frame by frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, first_token in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = TokenFile.open(place)
                lengths = f.index.column("n_tokens").to_numpy()
                starts = first_token + np.concatenate(([0], np.cumsum(lengths)))
                stream = f.frames(0, len(f.sizes))
                for a, z in K.row_slices(lengths * 4, 1 << 20):
                    crcs, ids = [], []
                    for d in range(a, z):
                        crc, parts = 0, []
                        for _ in range(int(f.first_frame[d + 1] - f.first_frame[d])):
                            x = np.frombuffer(next(stream), f"<u{f.width}").astype("<u4")
                            crc = zlib.crc32(x, crc)
                            if with_ids:
                                parts.append(x)
                        crcs.append(crc)
                        ids += parts
                    docs = f.index.column("doc_id").slice(a, z - a).combine_chunks()
                    docs = docs.chunk(0) if isinstance(docs, pa.ChunkedArray) else docs
                    columns = [docs, pa.array(starts[a:z]), pa.array(lengths[a:z]), pa.array(crcs, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(K.lists(np.concatenate(ids).astype(np.int64), np.concatenate(([0], np.cumsum(lengths[a:z]))), pa.int64()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _kind(files: DataFrame) -> str:
    """The SQL type of doc_id, from the first file's index; long where there is no file."""
    first = files.select("file").first()
    if first is None:
        return "long"
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(TokenFile.open(first["file"]).index.schema.field("doc_id").type).simpleString()


def _dealt(files: DataFrame, *columns: str) -> DataFrame:
    """Files spread over tasks of their own; the manifest is small, so its rows are counted."""
    return files.select(*columns).repartitionByRange(max(1, files.count()), "file")


def read_documents(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the manifest's files: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked, ids."""
    return _dealt(files, "file", "first_token").mapInArrow(
        document_reader(with_ids), f"doc_id {_kind(files)}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def index_rows(files: DataFrame) -> DataFrame:
    """doc_id, file, position of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place in b.column(0).to_pylist():
                index = TokenFile.open(place).index.combine_chunks()
                for a in range(0, len(index), 10_000):
                    ids = index.column("doc_id").slice(a, 10_000).combine_chunks()
                    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
                    yield pa.RecordBatch.from_arrays([ids, pa.array([place] * len(ids)), pa.array(np.arange(a, a + len(ids)))], names=["doc_id", "file", "position"])

    return _dealt(files, "file").mapInArrow(run, f"doc_id {_kind(files)}, file string, position long")


def some_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over (doc_id, file, position), sorted by file and position: ids of these documents only."""
    place = f = None
    for b in batches:
        ids = []
        for name, position in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if name != place:
                place, f = name, TokenFile.open(name)
            ids.append(f.ids(position).astype(np.int64))
        lengths = [len(x) for x in ids]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), K.lists(flat, np.concatenate(([0], np.cumsum(lengths))), pa.int64())], names=["doc_id", "ids"])


def fetch(files: DataFrame, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids of the documents that `wanted` names. Indexes are read whole, frames only where asked for."""
    asked = wanted.select(F.col(doc_id).alias("doc_id")).distinct()
    found = index_rows(files).join(asked, "doc_id", "left_semi")
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.repartition("file", F.floor(F.col("position") / 10_000)).sortWithinPartitions("file", "position").mapInArrow(
        some_documents, f"doc_id {kind}, ids array<long>")


def file_digest_report(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, **how) -> DataFrame:
    """Writes the files and reads every document back from them."""
    return read_documents(write_tokens(docs, path, folder, end_id, **how))
