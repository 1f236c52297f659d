"""BPE encoding and decoding through a table of distinct words.

Words here are stretches at whose bounds the tokenizer's own pre-tokenizer always splits: white space and what
follows it up to the next ASCII white space. The scan splits texts into blocks of bounded size; each block
keeps its documents as numbers into its own list of distinct words, by falling count. The lists of all blocks
meet by a hash of the word, where each distinct word is encoded once by the tokenizer library; the ids
return to their blocks, where they take the words' positions again. Only lists of words, ids and compressed word
numbers are shuffled, never a row per word of a text. Decoding joins each id to its piece in the vocabulary's table
of pieces, by position: the tokenizer fixes its size, so every task holds it whole.

Defined cases: null and empty texts have no ids and decode to the empty string; one very long text makes a
block of its own; equal and repeated rows each get their row, null ids included; empty tables give no rows.
The scan runs twice and must meet its rows in the same order each time, as scans of stored tables do; the
blocks carry a digest of their words, and a difference ends the job instead of mixing ids up.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm import workers
from kelpline.llm.textcore import SPACE, parts, span_hashes
from kelpline.session import prepare

BLOCK_BYTES = 16 << 20  # text in a block, but for one longer text
BUCKET_BYTES = 128 << 20  # text whose words go to one bucket, if shuffle partitions are fewer than that makes
MOST_BUCKETS = 1 << 13  # each block has a row for each bucket
KNOWN = 1 << 20  # words that a task keeps with their ids
HANDED = 2 << 20  # bytes of ids and decoded texts after which a block hands rows on as Arrow


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers of 32 bits as base-128 digits, compressed."""
    values = values.astype(np.uint32)
    digits = np.empty((len(values), 5), np.uint8)
    for d in range(5):
        digits[:, d] = (values >> np.uint32(7 * d)) & np.uint32(127)
    count = 1 + sum((values >= np.uint32(1 << (7 * d))).astype(np.int8) for d in range(1, 5))
    digits |= (np.arange(5)[None, :] < count[:, None] - 1).astype(np.uint8) << 7
    return zstandard.ZstdCompressor(level=1).compress(digits[np.arange(5)[None, :] < count[:, None]].tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    digits = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    if not len(digits):
        return np.zeros(0, np.uint32)
    last = np.flatnonzero(digits < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(digits)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((digits & 127).astype(np.uint32) << (7 * place).astype(np.uint32), first)


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and the bounds of each row's words.

    A word starts at ASCII white space that follows a character which is no white space of any kind.
    """
    n = len(data)
    space = SPACE[data]
    start = np.zeros(n, bool)
    start[1:] = space[1:] & ~space[:-1]
    at = np.flatnonzero(start)
    b1, b2, b3 = (data[np.maximum(at - d, 0)] for d in (1, 2, 3))
    wide = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)) | (b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80)
    wide |= (b3 == 0xE2) & (b2 == 0x80) & ((b1 >= 0x80) & (b1 <= 0x8A) | np.isin(b1, (0xA8, 0xA9, 0xAF)))
    wide |= (b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F) | (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80)
    start[at[wide]] = False
    start[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, offsets)


class _Piece:
    """A run of rows: its distinct words by hash, and each word of a row as a number into them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, self.bounds = unit_starts(data, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        hashes = span_hashes(data, starts, ends)
        self.keys, first, codes, self.counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        self.codes, self.starts, self.ends = codes.astype(np.uint32), starts[first].astype(np.int32), ends[first].astype(np.int32)
        self.seconds = span_hashes(data, starts, ends, second=True)
        _same(self.seconds, first, codes)
        self.data, self.seconds = data.tobytes(), self.seconds[first]


def _same(seconds: np.ndarray, first: np.ndarray, codes: np.ndarray) -> None:
    if not np.array_equal(seconds[first][codes], seconds):
        raise ValueError("two words share one 64-bit hash and not another")


class _Block:
    """Documents of a block and its distinct words, by falling count and then by hash. Words are told apart by 128 bits."""

    def __init__(self, name: str, ids: list, pieces: list[_Piece]):
        self.name, self.ids, self.pieces = name, ids, pieces
        keys, first, codes = np.unique(np.concatenate([p.keys for p in pieces]), return_index=True, return_inverse=True)
        _same(np.concatenate([p.seconds for p in pieces]), first, codes)
        counts = np.bincount(codes, np.concatenate([p.counts for p in pieces]), len(keys)).astype(np.int64)
        order = np.lexsort((keys, -counts))
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order))
        cuts = np.cumsum([0, *(len(p.keys) for p in pieces)])
        self.numbers = [number[codes[a:b]] for a, b in zip(cuts, cuts[1:])]
        first = first[order]
        self.piece = np.searchsorted(cuts, first, "right") - 1
        self.place, self.keys = first - cuts[self.piece], keys[order]
        self.seal = int((self.keys * np.arange(1, len(order) + 1, dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))

    def documents(self) -> Iterator[tuple]:
        ids = iter(self.ids)
        for piece, numbers in zip(self.pieces, self.numbers):
            for a, b in zip(piece.bounds, piece.bounds[1:]):
                yield self.name, self.seal, next(ids), _pack(numbers[piece.codes[a:b]])

    def _word(self, i: int) -> bytes:
        piece, at = self.pieces[self.piece[i]], self.place[i]
        return piece.data[piece.starts[at] : piece.ends[at]]

    def words(self, buckets: int) -> Iterator[tuple]:
        bucket = self.keys % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
            spans = [self._word(i) for i in own]
            lengths = np.array([len(s) for s in spans], np.uint32)
            steps = np.diff(own, prepend=-1).astype(np.uint32)
            packed = zstandard.ZstdCompressor(level=1).compress(b"".join(spans))
            yield self.name, self.seal, int(bucket[own[0]]), _pack(steps), _pack(lengths), packed


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[_Block]:
    from pyspark import TaskContext

    part, ids, pieces, size, made = TaskContext.get().partitionId(), [], [], 0, 0
    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for first, end, data, offsets in parts(batch.column(1)):
            if ids and size + len(data) > most:
                yield _Block(f"{part}:{made}", ids, pieces)
                ids, pieces, size, made = [], [], 0, made + 1
            ids += doc_ids[first:end]
            pieces.append(_Piece(data, offsets))
            size += len(data)
    if ids:
        yield _Block(f"{part}:{made}", ids, pieces)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _rows(held, schema)
            held = []
    if held:
        yield _rows(held, schema)


DOCS = pa.schema([("block", pa.string()), ("seal", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.binary())])
WORDS = pa.schema([("block", pa.string()), ("seal", pa.int64()), ("bucket", pa.int64()), ("steps", pa.binary()), ("lengths", pa.binary()), ("spans", pa.binary())])
IDS = pa.schema([("block", pa.string()), ("seal", pa.int64()), ("steps", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def byte_of_char() -> dict[str, int]:
    """The published byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


def id_to_piece(tokenizer_json: str) -> list[bytes]:
    """The bytes of each id: its size is that of the vocabulary."""
    model, table = json.loads(tokenizer_json), byte_of_char()
    vocabulary = {**model["model"]["vocab"], **{t["content"]: t["id"] for t in model["added_tokens"]}}
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        known = all(c in table for c in piece)
        pieces[i] = bytes(table[c] for c in piece) if known else piece.encode()
    return pieces


def _encoder(tokenizer_json: str):
    @workers.task
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        workers.give_back()  # reading the vocabulary takes several times its size
        known: dict[bytes, np.ndarray] = {}
        bucket = None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                # All rows of a bucket lie together, so each word is encoded once, but for those that KNOWN puts out.
                if row["bucket"] != bucket or len(known) > KNOWN:
                    bucket, known = row["bucket"], {}
                joined = zstandard.ZstdDecompressor().decompress(row["spans"])
                ends = np.cumsum(_unpack(row["lengths"]).astype(np.int64))
                spans = [joined[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                new = list({s: None for s in spans if s not in known})
                for a in range(0, len(new), 4096):
                    coded = tokenizer.encode_batch([s.decode("utf-8", "replace") for s in new[a : a + 4096]], add_special_tokens=False)
                    known.update((s, np.array(c.ids, np.uint32)) for s, c in zip(new[a:], coded))
                found = [known[s] for s in spans]
                counts = np.array([len(f) for f in found], np.uint32)
                rows.append((row["block"], row["seal"], row["steps"], _pack(counts), _pack(np.concatenate(found))))
            yield _rows(rows, IDS)

    return encode


def _joiner(pieces: list[bytes], digests: bool):
    @workers.group
    def join(docs: pa.Table, dictionary: pa.Table) -> pa.Table:
        seals = {*docs.column("seal").to_pylist(), *dictionary.column("seal").to_pylist()}
        if len(seals) > 1:
            raise ValueError("a block's words differ between two scans: store the input before encoding it")
        numbers, counts, ids = [], [], []
        for row in dictionary.select(["steps", "counts", "ids"]).to_pylist():
            numbers.append(np.cumsum(_unpack(row["steps"]).astype(np.int64)) - 1)
            counts.append(_unpack(row["counts"]).astype(np.int64))
            ids.append(_unpack(row["ids"]))
        numbers, counts, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (numbers, counts, ids))
        begins = np.cumsum(counts) - counts
        begin_of, count_of = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        begin_of[numbers], count_of[numbers] = begins, counts
        del numbers, counts, begins
        schema = DIGESTS if digests else CODED
        made, size, batches = [], 0, []
        for doc_id, codes in zip(docs.column("doc_id").to_pylist(), docs.column("codes").to_pylist()):
            codes = _unpack(codes)
            lengths = count_of[codes]
            total = int(lengths.sum())
            back = np.arange(total) + np.repeat(begin_of[codes] - (np.cumsum(lengths) - lengths), lengths)
            own = ids[back].astype("<u4")
            decoded = b"".join(map(pieces.__getitem__, own.tolist())).decode("utf-8", "replace").encode()
            if digests:
                made.append((doc_id, total, hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            else:
                made.append((doc_id, total, own.tobytes(), decoded))
                size += own.nbytes + len(decoded)
                if size > HANDED:
                    batches.append(_rows(made, schema))
                    made, size = [], 0
        if made:
            batches.append(_rows(made, schema))
        return pa.Table.from_batches(batches, schema)

    return join


def encode_decode(docs: DataFrame, tokenizer_json: str, digests: bool = False, block_bytes: int = BLOCK_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its ids (little-endian unsigned 32-bit) and the bytes of the decoded text, or their digests.

    ``tokenizer_json`` is the content of a byte-level BPE file of the tokenizers library.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    estimate = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files, for stored tables
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(MOST_BUCKETS, max(shuffle, estimate // BUCKET_BYTES)))

    @workers.task
    def numbered(batches):
        yield from _in_batches((r for b in _blocks(batches, block_bytes) for r in b.documents()), DOCS)

    @workers.task
    def listed(batches):
        yield from _in_batches((r for b in _blocks(batches, block_bytes) for r in b.words(buckets)), WORDS, 64)

    documents = texts.mapInArrow(numbered, _ddl(DOCS))
    distinct = texts.mapInArrow(listed, _ddl(WORDS)).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    ids = distinct.mapInArrow(_encoder(tokenizer_json), _ddl(IDS))
    pieces = id_to_piece(tokenizer_json)
    schema = _ddl(DIGESTS if digests else CODED)
    return documents.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_joiner(pieces, digests), schema)
