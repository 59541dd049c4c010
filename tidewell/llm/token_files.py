"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped reads.

A data set is a folder of parts.  Part ``n`` has ``tokens-<n>-<attempt>.bin`` (ids,
little-endian, 16 bits where the vocabulary allows it and 32 otherwise), ``.off``
(documents + 1 unsigned 64-bit offsets, in ids from the part's start) and ``.doc``
(signed 64-bit document ids).  Parts follow each other in ascending document id;
a part's base is the prefix sum of the id counts of the parts before it.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import TwoGenerations, by_chars, cut, once, shared_dir, shuffle_partitions, text_list, without_collections

#: Chunks in each half of the cache, and chunks encoded at once.
CACHE, BATCH = 400_000, 20_000
MANIFEST = "part int, path string, width int, docs long, ids long"


class ChunkEncoder:
    """Encodes texts chunk by chunk, a chunk being what stands between ASCII blanks.

    The tokenizer must treat white space as the end of a word and drop it; then the
    ids of a text are those of its chunks in order, and chunks met before need no
    second encoding.  New chunks are encoded as one text, and each token goes to the
    chunk that its offset falls in.  Strings of special tokens become these tokens,
    as the library has it.  Where the tokenizer lower-cases, so are chunks beforehand,
    but for texts with combining marks, which the tokenizer composes before it
    lower-cases, and with special tokens in any case, which it matches as written.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # a tokenizer that lower-cases gives A-Z and a-z the same ids
        self.fold = '"type":"Lowercase"' in model.replace(" ", "")
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = TwoGenerations(CACHE)

    def _chunks(self, text: str) -> list[bytes]:
        raw = text.encode()
        if not self.fold or b"\xcc" in raw or b"\xcd" in raw:  # the first bytes of the marks that compose with ASCII letters
            return raw.split()
        low = raw.lower()
        return (raw if any(s in low for s in self.special) else low).split()

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        texts = [c.decode() for c in chunks]
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        coded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        raw = np.array(coded.ids, self.dtype).tobytes()
        at = np.searchsorted(starts, [a for a, _ in coded.offsets], side="right") - 1
        ends = (np.cumsum(np.bincount(at, minlength=len(chunks))) * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    @without_collections
    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian."""
        chunks = [self._chunks(t) for t in texts]
        new = self.cache.missing(set().union(*chunks))
        for i in range(0, len(new), BATCH):
            some = new[i : i + BATCH]
            self.cache.update(zip(some, self._encode(some)))
        return [b"".join(map(self.cache.__getitem__, c)) for c in chunks]


def _open_fs(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _mapped(folder: str, path: str, dtype: str) -> np.ndarray:
    """The file's numbers: memory-mapped where it is a local or mounted file, else read."""
    fs, root = _open_fs(folder)
    at = f"{root}/{path}"
    if fs.type_name == "local":
        return np.memmap(at, dtype=dtype, mode="r") if os.path.getsize(at) else np.zeros(0, dtype)
    with fs.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def _part_writer(model, folder: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encoder, fs_root = TaskContext.get(), once(ChunkEncoder, model.value), _open_fs(folder)
        fs, root = fs_root
        part, end = context.partitionId(), np.array([end_id], encoder.dtype).tobytes()
        path = f"tokens-{part:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        offset, docs = 0, 0
        # the ends of documents are written as they come, so a part of any size needs one batch of memory
        with fs.open_output_stream(f"{root}/{path}.bin") as out, fs.open_output_stream(f"{root}/{path}.off") as off, fs.open_output_stream(f"{root}/{path}.doc") as ids:
            off.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                texts = text_list(batch.column("text"))
                keys = batch.column("doc_id").to_numpy(zero_copy_only=False).astype("<i8")
                for a, b in by_chars(texts):
                    ends = []
                    for raw in encoder.ids(texts[a:b]):
                        out.write(raw + end)
                        offset += len(raw) // encoder.dtype.itemsize + 1
                        ends.append(offset)
                    off.write(np.array(ends, "<u8").tobytes())
                ids.write(keys.tobytes())
                docs += len(keys)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "path": [path], "width": pa.array([encoder.dtype.itemsize], pa.int32()),
            "docs": pa.array([docs], pa.int64()), "ids": pa.array([offset], pa.int64()),
        })

    return write


def write_token_files(docs: DataFrame, model: str, folder: str | None = None, end_id: int = 1, key: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Encode ``docs`` into a folder of token files; returns the folder and its manifest.

    ``model`` is the tokenizer's JSON; ``end_id`` follows every document.  Null and
    empty texts are documents of the end id alone; a null key is stored as -1.
    Rows are ranged by key and, for repeated keys, by a hash of the text, so equal
    keys spread over parts as well; rows alike in both stand next to each other.
    A retried or repeated task writes files of another name, and the manifest
    (part, path, width, docs, ids, base), which is checkpointed, names those that
    count.  An empty table gives an empty manifest or empty parts.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    fs, root = _open_fs(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    written = cut(ranged.mapInArrow(_part_writer(spark.sparkContext.broadcast(model), folder, end_id), MANIFEST))
    # a row per part: the prefix sum over them stays small however large the corpus is
    base = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return folder, written.withColumn("base", base)


def _part_reader(folder: str, block: int = 4096):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _mapped(folder, row["path"] + ".bin", f"<u{row['width']}")
                off, keys = _mapped(folder, row["path"] + ".off", "<u8"), _mapped(folder, row["path"] + ".doc", "<i8")
                for at in range(0, len(keys), block):
                    ends = off[at : at + block + 1].astype(np.int64)
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:])]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(np.array(keys[at : at + block]), pa.int64()),
                        "start": pa.array(ends[:-1] + row["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(ends), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    })

    return read


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per stored document: doc_id, start (ids before it), n_tokens, ids_crc32.

    Each part is read by one task from its memory-mapped files, a block of
    documents at a time.  ids_crc32 is over the ids as unsigned 32-bit integers.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    parts = cut(manifest.select("part", "path", "width", "docs", "base"))
    spread = parts.repartition(shuffle_partitions(spark), "part")
    return spread.mapInArrow(_part_reader(folder), schema)


def token_slice(folder: str, manifest_rows: list, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` (global positions) from the parts that hold them."""
    found = [np.zeros(0, np.uint32)]
    for row in sorted(manifest_rows, key=lambda r: r["base"]):
        a, b = max(start, row["base"]) - row["base"], min(stop, row["base"] + row["ids"]) - row["base"]
        if a < b:
            found.append(_mapped(folder, row["path"] + ".bin", f"<u{row['width']}")[a:b].astype(np.uint32))
    return np.concatenate(found)
