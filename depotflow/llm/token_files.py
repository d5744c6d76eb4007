"""Token ids as Arrow stream files of equal-length sequences.

The documents are range-partitioned and sorted by id; each partition writes one stream file whose record batches all hold
the same number of rows, and each row three fixed-size lists of `length`: ids, mask (false where the tail is padded) and
ends (true at the last token of a document). As all batches but the last take the same number of bytes, the place of
any sequence follows by arithmetic and can be read from a memory map without copying. A second stream file beside it lists
the ids of the documents, in order. Files are named by attempt; only those in the staged manifest count, so a task that
runs again leaves no duplicate behind.

Texts are encoded piece by piece between spaces and line breaks, as this tokenizer drops white space before it splits words: a piece's ids don't
depend on its neighbours. A-Z are lowered and closing marks cut off their words beforehand, where that can't change an id, so that fewer different pieces
are left. Each worker keeps the ids of the pieces it has seen, up to `CACHE_PIECES`; then the half that more slices held stays.

Nulls: a null text is empty and yields the end id only; rows with null ids come first, repeated ids by text. No rows: no files.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from depotflow.llm.common import partitions, stage, text_rows, text_slices
from depotflow.session import shared_folder

LENGTH = 2048
BATCH_SEQUENCES = 64
CACHE_PIECES = 500_000
# Texts with special tokens, which are told by case, or with combining marks, which join some small letters only, keep their case.
CASED = r"<\||[\x{300}-\x{36F}]"
CLOSED = r"([A-Za-z\x{DF}-\x{F6}\x{F8}-\x{FF}])([.,;:!?$%*#]+) "
# Words of letters that no normalization joins or takes apart, and the characters that the vocabulary has for their bytes.
PLAIN = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
LETTERS = {c: "".join(chr(b if b < 0x7F or 0xA1 <= b <= 0xAC or b >= 0xAE else b + 162 if b < 0xA1 else 323) for b in chr(c).lower().encode())
           for c in (*range(65, 91), *range(0xC0, 0x100))}
MANIFEST = "shard int, path string, docs_path string, n_docs long, n_tokens long, n_sequences long, first_at long, batch_bytes long"


class Encoder:
    """Ids of texts by the tokenizers library, remembered for each piece between white space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are what runs side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.number: dict[str, int] = {}
        self.known = np.zeros(0, self.dtype)
        self.starts, self.sizes, self.seen = (np.zeros(0, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Keep the half of the pieces that the most slices held; what they were seen counts half from now on."""
        kept = np.sort(np.argsort(-self.seen, kind="stable")[: CACHE_PIECES // 2])
        names = list(self.number)
        self.number = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.known, starts = _spans(self.known, self.starts[kept], self.sizes[kept])
        self.starts, self.sizes, self.seen = starts[:-1], self.sizes[kept], self.seen[kept] // 2

    def _learn(self, pieces: list[str]) -> None:
        tokenize, plain, learned, rest, sizes, flat = self.tokenizer.model.tokenize, PLAIN.fullmatch, [], [], [], []
        for piece in pieces:
            # words of plain letters are what the model is given, as they are
            if plain(piece):
                found = tokenize(piece.lower() if piece.isascii() else piece.translate(LETTERS))
                flat += [t.id for t in found]
                sizes.append(len(found))
                learned.append(piece)
            else:
                rest.append(piece)
        for encoding in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False):
            found = encoding.ids
            flat += found
            sizes.append(len(found))
        pieces, sizes = learned + rest, np.array(sizes, np.int64)
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))
        ends = len(self.known) + np.cumsum(sizes)
        self.known = np.concatenate((self.known, np.array(flat, self.dtype)))
        self.starts = np.concatenate((self.starts, ends - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.seen = np.concatenate((self.seen, np.zeros_like(sizes)))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if len(self.number) > CACHE_PIECES:
            self._forget()
        given = pc.replace_substring(pa.array(texts, pa.large_binary()).cast(pa.large_string()), "\n", " ")
        lowered = pc.if_else(pc.match_substring_regex(given, CASED), given, pc.ascii_lower(given))
        split = pc.split_pattern(pc.replace_substring_regex(lowered, CLOSED, r"\1 \2 "), " ")
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn([p for p in distinct if p not in self.number])
        number = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))
        self.seen[number] += 1
        number = number[coded.indices.to_numpy()]
        ids, before = _spans(self.known, self.starts[number], self.sizes[number])
        return ids, np.diff(before[split.offsets.to_numpy()])


def _spans(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start : start + size] of each pair, one after the other, and where each begins, with the end."""
    at = np.concatenate(([0], np.cumsum(sizes)))
    return values[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])], at


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder; the same everywhere, as executors write and read it."""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return (pa.fs.LocalFileSystem(), uri) if uri.startswith("/") else pa.fs.FileSystem.from_uri(uri)


class SequenceFile:
    """Cuts a stream of ids into sequences of `length` and writes them in batches of equal size."""

    def __init__(self, sink: pa.NativeFile, dtype: np.dtype, length: int):
        self.sink, self.length, self.kept = sink, length, []
        of = {"ids": pa.from_numpy_dtype(dtype), "mask": pa.bool_(), "ends": pa.bool_()}
        self.schema = pa.schema([(name, pa.list_(pa.field("item", kind, False), length)) for name, kind in of.items()])
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.first_at = self.batch_bytes = self.sequences = self.held = 0

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.kept.append((ids, ends))
        self.held += len(ids)
        room = self.length * BATCH_SEQUENCES
        if self.held >= room:
            ids, ends = (np.concatenate(x) for x in zip(*self.kept))
            for s in range(0, len(ids) - room + 1, room):
                self._write(ids[s : s + room], np.ones(room, bool), ends[s : s + room])
            done = len(ids) // room * room
            self.kept, self.held = [(ids[done:], ends[done:])], len(ids) - done

    def _write(self, *columns: np.ndarray) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(c), type=f.type) for c, f in zip(columns, self.schema)]
        batch = pa.RecordBatch.from_arrays(lists, schema=self.schema)
        self.writer.write_batch(batch)
        if not self.batch_bytes:  # the schema stands before the first batch
            self.batch_bytes = pa.ipc.get_record_batch_size(batch)
            self.first_at = self.sink.tell() - self.batch_bytes
        self.sequences += len(lists[0])

    def close(self) -> None:
        if self.held:
            ids, ends = (np.concatenate(x) for x in zip(*self.kept))
            pad = -len(ids) % self.length
            self._write(np.pad(ids, (0, pad)), np.arange(len(ids) + pad) < len(ids), np.pad(ends, (0, pad)))
        self.writer.close()


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, length: int = LENGTH) -> DataFrame:
    """Write the files of all documents, in ascending id order over the files, and return the staged manifest."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, (files, root) = encoder(tokenizer), open_folder(folder)
        shard = TaskContext.get().partitionId()
        name = f"{root}/{shard:06d}-{uuid.uuid4().hex}"
        out = None
        for ids, texts in text_slices(batches):
            if out is None:
                files.create_dir(root, recursive=True)
                sink, docs_sink = (files.open_output_stream(f"{name}.{x}.arrows") for x in ("tokens", "docs"))
                out = SequenceFile(sink, coder.dtype, length)
                listed = pa.ipc.new_stream(docs_sink, pa.schema([("doc_id", pa.int64())]))
                n_docs = n_tokens = 0
            flat, counts = coder.encode(texts)
            last = np.cumsum(counts + 1) - 1
            whole = np.full(len(flat) + len(counts), end_id, coder.dtype)
            ends = np.zeros(len(whole), bool)
            ends[last] = True
            whole[~ends] = flat
            out.add(whole, ends)
            listed.write_batch(pa.RecordBatch.from_arrays([ids], ["doc_id"]))
            n_docs, n_tokens = n_docs + len(ids), n_tokens + len(whole)
        if out is not None:
            out.close()
            listed.close()
            sink.close()
            docs_sink.close()
            row = [shard, f"{name}.tokens.arrows", f"{name}.docs.arrows", n_docs, n_tokens, out.sequences, out.first_at, out.batch_bytes]
            kinds = [pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5]
            names = [c.split()[0] for c in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    ordered = text_rows(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(write, MANIFEST)
    return stage(manifest.withColumn("folder", F.lit(folder)))


def _source(folder: str, path: str) -> pa.NativeFile:
    files, _ = open_folder(folder)
    return pa.memory_map(path) if isinstance(files, pa.fs.LocalFileSystem) else files.open_input_file(path)


def read_sequence(row: dict, k: int) -> dict[str, np.ndarray]:
    """Sequence k of one file of the manifest, found by arithmetic; views of the memory map where the folder is local."""
    with _source(row["folder"], row["path"]) as source:
        schema = pa.ipc.open_stream(source).schema
        source.seek(row["first_at"] + k // BATCH_SEQUENCES * row["batch_bytes"])
        batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
        return {n: batch.column(n)[k % BATCH_SEQUENCES].values.to_numpy(zero_copy_only=n == "ids") for n in schema.names}


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    spark = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            sizes, sums = [], []
            crc = at = begun = 0
            with _source(row["folder"], row["path"]) as source:
                for batch in pa.ipc.open_stream(source):
                    mask = batch.column("mask").flatten().to_numpy(zero_copy_only=False)
                    ids = batch.column("ids").flatten().to_numpy().astype("<u4")[mask]
                    last = np.flatnonzero(batch.column("ends").flatten().to_numpy(zero_copy_only=False))
                    view, s = memoryview(ids).cast("B"), 0
                    for e in last.tolist():
                        crc = zlib.crc32(view[4 * s : 4 * e + 4], crc)
                        sums.append(crc)
                        sizes.append(at + e + 1 - begun)
                        begun, s, crc = at + e + 1, e + 1, 0
                    crc = zlib.crc32(view[4 * s :], crc)
                    at += len(ids)
            with _source(row["folder"], row["docs_path"]) as source:
                ids = pa.ipc.open_stream(source).read_all().column("doc_id").combine_chunks()
            starts = np.cumsum(sizes) - np.array(sizes)
            for s in range(0, len(ids), 50_000):
                some = slice(s, s + 50_000)
                columns = [ids[some], *(pa.array(np.array(x[some], np.int64)) for x in (starts, sizes, sums))]
                shard = pa.array(np.full(len(columns[0]), row["shard"], np.int32))
                yield pa.RecordBatch.from_arrays([shard, *columns], ["shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = manifest.repartitionByRange(partitions(spark), "shard").mapInArrow(
        read, "shard int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    bases = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
