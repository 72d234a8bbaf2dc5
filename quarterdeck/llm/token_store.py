"""Token-ID output: patched frame-of-reference blocks in shard files.

A shard file holds whole documents in order.  Its ids are cut into blocks of 128.  A block keeps its
minimum, the differences to it packed at the width that covers 90 % of them, and lists the others as
exceptions (position, whole difference).  An index gives where each block starts.

Layout, little-endian: magic ``QPF1``; uint64 ids, blocks, exceptions, documents; then arrays: block minimum
uint32, width uint8, exceptions per block uint8, block start in the payload uint64, exception position uint8,
exception difference uint32, document length uint64, document id int64, document id given uint8; then payload.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, settled, store_of, text_buffers

BLOCK = 128
#: Rank of the difference whose width a block takes: the 90th percentile.
RANK = 115
MAGIC = b"QPF1"
#: Ids after which a shard file ends at the next document, so that a file and its reader stay small.
SHARD_IDS = 2 << 20
#: Bytes of the pieces that a worker keeps, twice at most, and what an entry takes besides its bytes.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 160


def _widths(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) values below 2**width → (blocks, 16 * width) bytes."""
    cell = np.dtype(">u2") if width <= 16 else np.dtype(">u4")
    bits = np.unpackbits(values.astype(cell).view(np.uint8), axis=1).reshape(len(values), BLOCK, 8 * cell.itemsize)
    return np.packbits(bits[:, :, 8 * cell.itemsize - width :].reshape(len(values), BLOCK * width), axis=1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    cell = np.dtype(">u2") if width <= 16 else np.dtype(">u4")
    bits = np.zeros((len(packed), BLOCK, 8 * cell.itemsize), np.uint8)
    bits[:, :, 8 * cell.itemsize - width :] = np.unpackbits(packed, axis=1).reshape(len(packed), BLOCK, width)
    return np.packbits(bits.reshape(len(packed), -1), axis=1).view(cell).astype(np.uint32)


def encode_shard(ids: np.ndarray, lengths: np.ndarray, doc_ids: list) -> bytes:
    """File bytes of one shard; ids are uint32, lengths sum to their number, doc_ids may hold None."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = grid - low[:, None]
    width = _widths(np.partition(diff, RANK, axis=1)[:, RANK]) if blocks else np.zeros(0, np.uint8)
    odd = diff >> width.astype(np.uint32)[:, None] > 0 if blocks else np.zeros((0, BLOCK), bool)
    odd[width >= 32] = False
    at = np.nonzero(odd)
    exceptions = diff[at]
    diff[at] = 0
    starts = np.zeros(blocks, np.uint64)
    sizes = width.astype(np.uint64) * np.uint64(BLOCK // 8)
    starts[1:] = np.cumsum(sizes)[:-1]
    payload = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width):
        if w:
            for rows in np.array_split(at_w := np.nonzero(width == w)[0], -(-len(at_w) // 4096)):
                payload[starts[rows].astype(np.int64)[:, None] + np.arange(16 * int(w))] = _pack(diff[rows], int(w))
    given = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], np.int64)
    head = np.array([n, blocks, len(exceptions), len(doc_ids)], "<u8")
    parts = [head, low.astype("<u4"), width, odd.sum(axis=1).astype(np.uint8), starts.astype("<u8"), at[1].astype(np.uint8), exceptions.astype("<u4"), np.asarray(lengths, "<u8"), keys.astype("<i8"), given, payload]
    return MAGIC + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def decode_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, list]:
    """The arguments of encode_shard, from its bytes."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard file")
    n, blocks, odd, docs = (int(x) for x in np.frombuffer(data, "<u8", 4, 4))
    place = 36

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal place
        out = np.frombuffer(data, kind, count, place)
        place += out.nbytes
        return out

    low, width, per, starts = take("<u4", blocks), take("u1", blocks), take("u1", blocks), take("<u8", blocks)
    where, exceptions, lengths, keys, given = take("u1", odd), take("<u4", odd), take("<u8", docs), take("<i8", docs), take("u1", docs)
    payload = np.frombuffer(data, np.uint8, -1, place)
    diff = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            for rows in np.array_split(at_w := np.nonzero(width == w)[0], -(-len(at_w) // 4096)):
                diff[rows] = _unpack(payload[starts[rows].astype(np.int64)[:, None] + np.arange(16 * int(w))], int(w))
    diff[np.repeat(np.arange(blocks), per), where] = exceptions
    ids = (diff + low[:, None]).reshape(-1)[:n]
    return ids, lengths.astype(np.int64), [int(k) if g else None for k, g in zip(keys, given)]


#: ASCII marks that the pre-tokenizer parts from the letters before them.
MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Pieces(dict):
    """Piece → its ids as little-endian uint32 bytes; a missing one is encoded when it is looked up.

    Bounded by bytes: a full cache becomes the old one, whose entries come back as they are met.
    """

    def __init__(self, encode, limit: int):
        self.encode, self.limit, self.size, self.old = encode, limit, 0, {}

    def __missing__(self, piece):
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        cost = len(piece) + len(ids) + ENTRY_BYTES
        if cost > self.limit // 64:
            return ids  # so long a piece hardly comes again
        if self.size + cost > self.limit:
            self.old = dict(self)
            self.clear()
            self.size = 0
        self[piece] = ids
        self.size += cost
        return ids


class CachedEncoder:
    """Encodes white-space-delimited pieces once; the tokenizer drops white space, so pieces are independent.

    A piece of Latin letters with trailing ASCII marks is cut in two, as the pre-tokenizer would; its letters go to
    the model in the byte-level alphabet.  Any other piece goes through the whole tokenizer.
    """

    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\[-`{}~]*)\Z")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(256) if chr(c).isalpha()]
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters}
        #: Cutting a piece is right only for a tokenizer that separates letters from marks and lowers case.
        self.cuts = self._same("Abc,") and self._same("ÉÀñß.") and self._same("THE!!")
        self.pieces = Pieces(self._piece, CACHE_BYTES)
        self.cores = Pieces(self._model, CACHE_BYTES // 2)

    def _same(self, text: str) -> bool:
        core, tail = self.PLAIN.match(text).groups()
        return self._whole(text) == self._model(core.lower()) + self._whole(tail)

    def _whole(self, text: str) -> bytes:
        return _little(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _model(self, core: str) -> bytes:
        return _little([t.id for t in self.model.tokenize(core if core.isascii() else core.translate(self.letters))])

    def _piece(self, piece: bytes) -> bytes:
        if self.cuts and (core := piece.rstrip(MARKS)).isalpha():  # ASCII letters, the most frequent case
            tail = piece[len(core) :]
            return self.cores[core.lower().decode()] + (self._tail(tail.decode()) if tail else b"")
        text = piece.decode("utf-8", "replace")
        if not self.cuts or not (m := self.PLAIN.match(text)):
            return self._whole(text)
        core, tail = m.groups()
        return self.cores[core.lower()] + (self._tail(tail) if tail else b"")

    def _tail(self, tail: str) -> bytes:
        ids = self.cores.get(tail)  # letters and marks don't meet
        if ids is None:
            ids = self._whole(tail)
            if len(tail) < 4:
                self.cores[tail] = ids  # few there are
        return ids

    def encode(self, text: bytes, end_id: int) -> np.ndarray:
        ids = b"".join(map(self.pieces.__getitem__, text.split()))
        return np.frombuffer(ids + end_id.to_bytes(4, "little"), "<u4")


_ENCODERS: dict[str, CachedEncoder] = {}


def _encoder(path: str) -> CachedEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


MANIFEST = "part int, piece int, n_docs long, n_tokens long, n_bytes long"


def write_token_shards(docs: DataFrame, folder: str, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text", end_id: int = 1, shard_ids: int = SHARD_IDS) -> list:
    """Encode whole texts and write shard files in ascending id order; returns the manifest rows in that order.

    A null text is empty (its end id only), a null id comes first, rows of one id go by their text's hash and then
    their text, repeated rows all count.  An empty table writes no file.  Range bounds hold id and hash, so a much
    repeated id is split.  A retried task writes the same bytes under the same name.
    """

    def write(batches):
        part = TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        encoder = _encoder(tokenizer_path)
        store, root = store_of(folder)
        ids, keys, held, piece = [], [], 0, 0

        def flush():
            data = encode_shard(np.concatenate(ids), np.array([len(x) for x in ids]), keys)
            name = f"{root}/shard-{part:06d}-{piece:05d}.qpf"
            with store.open_output_stream(f"{root}/_tmp/{attempt}-{piece}") as out:
                out.write(data)
            store.move(f"{root}/_tmp/{attempt}-{piece}", name)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "piece": pa.array([piece], pa.int32()), "n_docs": [len(keys)], "n_tokens": [held], "n_bytes": [len(data)]})

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, key in enumerate(batch.column(0).to_pylist()):
                got = encoder.encode(data[offsets[i] : offsets[i + 1]].tobytes(), end_id)
                ids.append(got)
                keys.append(key)
                held += len(got)
                if held >= shard_ids:
                    yield flush()
                    ids, keys, held, piece = [], [], 0, piece + 1
        if ids:
            yield flush()

    store, root = store_of(folder)
    store.create_dir(f"{root}/_tmp", recursive=True)
    rows = docs.select(F.col(id_column).cast("long").alias("k"), F.col(text_column).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    manifest = ordered.mapInArrow(settled(write), MANIFEST).collect()  # a row a file
    store.delete_dir(f"{root}/_tmp")  # what failed attempts left
    return sorted(manifest, key=lambda r: (r["part"], r["piece"]))


def read_token_shards(spark, folder: str, manifest: list, *, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids if asked."""
    starts, total = {}, 0
    for r in manifest:
        starts[f"shard-{r['part']:06d}-{r['piece']:05d}.qpf"] = total
        total += r["n_tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if not manifest:
        return spark.createDataFrame([], schema)

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, lengths, keys = decode_shard(content.as_py())
                ends = np.cumsum(lengths)
                first = ends - lengths
                raw = ids.astype("<u4")
                out = {"doc_id": pa.array(keys, pa.int64()), "start": first + starts[path.rsplit("/", 1)[-1]], "n_tokens": lengths, "ids_crc32": pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(first, ends)], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array([raw[a:b].astype(np.int64) for a, b in zip(first, ends)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.qpf").load(folder).select("path", "content")
    return files.mapInArrow(settled(read), schema)


def token_output(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write docs as shard files in the shared folder and read them back (see read_token_shards)."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    return read_token_shards(spark, folder, write_token_shards(docs, folder, tokenizer_path, **options))
