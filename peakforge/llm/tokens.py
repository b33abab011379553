"""Token ids of a corpus as wavelet-matrix shards, one compressed file each.

A shard holds the ids of consecutive documents as bit-planes: plane 0 has the top bit of each id in order, and each
further plane the next bit, after a stable sort by the bits before. With the number of ones before each block, one
file answers: the id at a position, how often an id occurs before a position, and where its k-th occurrence is.

Documents are range-partitioned by id; a task sorts its range and writes shards of bounded size, so neither memory
nor a file grows with the partition. Attempts write files of their own name, and the written manifest names those
that count.

Defined cases: a null text is an empty one (the end id alone); null ids come first, repeated ids in the order of
their texts; an empty table gives no shard and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakforge.llm.common import new_path, open_fs, written

MAGIC = b"WAVELET1"
BLOCK = 4096  # bits between entries of the rank directory
NO_ID = np.iinfo(np.int64).min


class Encoder:
    """Ids of texts by a tokenizer file.

    Tokens of this vocabulary never span ASCII white space, so a text is taken apart there and pieces seen before are
    looked up. A new piece of plain Latin characters is cut into runs as the file's pre-tokenizer does, and runs that
    are new go to the library's model; any other piece goes through the whole tokenizer. Pieces are kept in two
    tables of at most ``max_pieces``; the older one is dropped when the newer one is full.
    """

    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}  # how byte-level vocabularies show bytes

    def __init__(self, path: str | None = None, max_pieces: int = 500_000):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.max_pieces = max_pieces

    def _piece(self, piece: str) -> bytes:
        if not self.PLAIN.fullmatch(piece) or "<|" in piece:
            return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        out, runs = b"", self.runs
        for run in self.RUNS.findall(piece.lower()):
            if run not in runs:
                shown = run if run.isascii() else run.encode().decode("latin-1").translate(self.BYTES)
                ids = [t.id for t in self.model.tokenize(shown)]
                runs[run] = struct.pack(f"<{len(ids)}I", *ids)
            out += runs[run]
        return out

    def _learn(self, pieces: set[bytes]) -> None:
        if len(self.known) > self.max_pieces:
            self.known, self.older = {}, self.known
        if len(self.runs) > self.max_pieces:
            self.runs = {}
        known, older = self.known, self.older
        for p in pieces:
            known[p] = older[p] if p in older else self._piece(p.decode())

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        raw = (text or "").encode()
        if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
            raw = raw.lower()  # A-Z, as the tokenizer does; not before accents (U+0300-U+037F) or where a special token could arise
        pieces = raw.split()
        for _ in range(3):
            ids = list(map(self.known.get, pieces))
            try:
                return np.frombuffer(b"".join(ids), "<u4")
            except TypeError:  # some are not known yet
                self._learn({p for p, x in zip(pieces, ids, strict=True) if x is None})
        return np.frombuffer(b"".join([self._piece(p.decode()) for p in pieces]), "<u4")  # more pieces than the tables hold

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        return [self.encode(t) for t in texts]


_ENCODERS: dict[str | None, Encoder] = {}  # one for each worker process, so that its pieces outlive a task


def encoder(path: str | None) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The bytes of a shard."""
    n, bits = len(ids), max(1, int(ids.max(initial=0)).bit_length())
    row = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    z = zstandard.ZstdCompressor(level=1)
    parts, zeros = [], []
    for level in range(bits):
        ones = (row & row.dtype.type(1 << (bits - 1 - level))) != 0
        packed = np.packbits(ones, bitorder="little")
        padded = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        padded[: len(packed)] = packed
        per = np.bitwise_count(padded.reshape(-1, BLOCK // 8).view(np.uint64)).sum(1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(per)]).astype("<u4")
        zeros.append(n - int(ranks[-1]))
        parts += [z.compress(packed.tobytes()), z.compress(ranks.tobytes())]
        row = np.concatenate([row[~ones], row[ones]])
    named = np.array([NO_ID if d is None else d for d in doc_ids], "<i8")
    parts += [z.compress(named.tobytes()), z.compress(np.array(lengths, "<i8").tobytes())]
    head = json.dumps({"n": n, "bits": bits, "docs": len(doc_ids), "zeros": zeros, "parts": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


class WaveletShard:
    """Queries on one shard; planes are inflated when they are first needed."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack("<I", data[8:12])
        self.head = json.loads(data[12 : 12 + size])
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        ends = np.cumsum([12 + size, *self.head["parts"]])
        self.parts = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.open: dict[int, np.ndarray] = {}

    def _part(self, k: int, kind: str) -> np.ndarray:
        if k not in self.open:
            self.open[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.parts[k]), kind)
        return self.open[k]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Document ids (NO_ID for null) and their numbers of ids."""
        return self._part(2 * self.bits, "<i8"), self._part(2 * self.bits + 1, "<i8")

    def rank1(self, level: int, i: int) -> int:
        """Ones before position ``i`` of a plane."""
        block, plane = i // BLOCK, self._part(2 * level, "u1")
        part = plane[block * (BLOCK // 8) : i // 8]
        extra = int(plane[i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(self._part(2 * level + 1, "<u4")[block]) + int(np.bitwise_count(part).sum()) + extra.bit_count()

    def select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a plane: a search over blocks, then inside one."""
        ranks = self._part(2 * level + 1, "<u4").astype(np.int64)
        if not bit:
            ranks = np.minimum(np.arange(len(ranks), dtype=np.int64) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        plane = self._part(2 * level, "u1")[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)]
        inside = np.unpackbits(plane, bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(inside == bit)[k - ranks[block]])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            ones = self.rank1(level, i)
            bit = self.rank1(level, i + 1) - ones
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _down(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` begin on the level below the last, and where position ``i`` falls there."""
        begin = 0
        for level in range(self.bits):
            a, b = self.rank1(level, begin), self.rank1(level, i)
            if token >> (self.bits - 1 - level) & 1:
                begin, i = self.zeros[level] + a, self.zeros[level] + b
            else:
                begin, i = begin - a, i - b
        return begin, i

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of ``token`` before position ``end``."""
        if token >> self.bits or token < 0:
            return 0
        begin, i = self._down(token, self.n if end is None else end)
        return i - begin

    def find(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``; -1 if there is none."""
        if k < 0 or k >= self.count(token):
            return -1
        i = self._down(token, 0)[0] + k
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            i = self.select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def all_ids(self) -> np.ndarray:
        """Every id in order: undoes the sorts from the last plane to the first."""
        row = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            ones = np.unpackbits(self._part(2 * level, "u1"), count=self.n, bitorder="little").view(bool)
            out = np.empty_like(row)
            out[~ones] = row[: self.zeros[level]]
            out[ones] = row[self.zeros[level] :] | row.dtype.type(1 << (self.bits - 1 - level))
            row = out
        return row


MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_shards(docs: DataFrame, out_dir: str | None = None, *, tokenizer: str | None = None, end_id: int = 2, shard_ids: int = 1 << 22) -> DataFrame:
    """Encode and write ``docs`` in ascending doc_id order; returns the manifest (part, seq, path, n_docs, n_ids)."""
    out_dir = out_dir or new_path(docs.sparkSession, "wavelet")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(out_dir)
        task, ids_of, done = TaskContext.get(), encoder(tokenizer).encode_all, []
        held, names, size = [], [], 0
        end = np.array([end_id], "<u4")

        def flush() -> None:
            name = f"{task.partitionId():06d}-{len(done):05d}-{task.taskAttemptId()}.wvm"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{name}") as out:
                out.write(pack(np.concatenate(held), names, [len(x) for x in held]))
            done.append({"part": task.partitionId(), "seq": len(done), "path": f"{out_dir}/{name}", "n_docs": len(held), "n_ids": size})

        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), ids_of(part.column("text").to_pylist()), strict=True):
                    held.append(np.concatenate([ids, end]))
                    names.append(doc_id)
                    size += len(ids) + 1
                    if size >= shard_ids:
                        flush()
                        held, names, size = [], [], 0
        if held:
            flush()
        yield pa.RecordBatch.from_pylist(done, MANIFEST)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # equal and null ids are dealt out by a hash of the text, so they need not lie in one task
    ranged = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    return written(ranged.mapInArrow(write, "part int, seq int, path string, n_docs long, n_ids long"), "wavelet-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the number of ids in all shards before each: by partition first, then inside one."""
    per = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    per = per.select("part", F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return manifest.join(per, "part").withColumn("start", F.col("first") + F.coalesce(inside, F.lit(0))).drop("first")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, name = open_fs(path)
                with fs.open_input_stream(name) as f:
                    shard = WaveletShard(f.read())
                names, lengths = shard.documents()
                ends = np.cumsum(lengths)
                ids = shard.all_ids().astype("<u4")
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(ends - lengths, ends, strict=True)]
                cols = [pa.array(names, pa.int64(), mask=names == NO_ID), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    shards = written(with_starts(manifest).select("path", "start"), "wavelet-starts")
    return shards.repartition(max(1, shards.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
