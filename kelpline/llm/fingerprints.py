"""Document fingerprints by Order MinHash, sensitive to the order of a text and so to its edit distance.

A text's k-mers (of code points) are numbered by occurrence, so that a repeated k-mer is a new element each time.
Under each of several hash functions the least few elements are selected and put back into the order of the text;
the hash of that tuple is one entry of the fingerprint. The share of equal entries is the likeness of two texts:
unlike plain MinHash it falls when the same k-mers come in another order.

``with_next`` follows the documents in descending order of their ids and compares each with the next one. Texts are
shuffled once, by range; each task reads its stretch of the order as a stream and holds two texts. The first and the
last document of every stretch are stored beside the results and matched afterwards, so no stretch needs another.

Defined cases: a null text is empty; an empty text has a fingerprint of zeros and is wholly like another empty text; a
text of fewer than k code points is one k-mer; with fewer elements than a tuple takes, the tuple has what there is.
Documents of one id follow each other in order of a hash of their texts, repeated rows each are documents of their
own, null ids come last; after the last document comes the first, so a single document follows itself. An empty table
gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm import textcore, workers
from kelpline.session import cut, input_bytes, prepare

K, ENTRIES, TUPLE = 8, 64, 2
PART_BYTES = 32 << 20  # of input, in a stretch of the order
TILE = 1 << 18  # hashes that are made at once
FACTOR = (textcore._sequence(ENTRIES, 17) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # of each hash function
_room = np.empty(TILE, np.uint32)
NEXT_OCCURRENCE = np.uint64(0x9FB21C651E98DF25)


def kmer_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-mer of code points; of the whole text if it is shorter."""
    if not len(codes):
        return np.zeros(0, np.uint64)
    k = min(k, len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * textcore._power(textcore.BASE, len(codes)), out=sums[1:])
    return textcore.mix((sums[k:] - sums[:-k]) * textcore._power(textcore.BASE_INVERSE, len(codes) - k + 1) + np.uint64(k))


def numbered(kmers: np.ndarray) -> np.ndarray:
    """The hash of each k-mer with its occurrence number; a first occurrence keeps the hash of its k-mer."""
    bits = max(1, int(len(kmers) - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    sort = np.sort((kmers & ~low) | np.arange(len(kmers), dtype=np.uint64))
    group, place = sort >> np.uint64(bits), (sort & low).astype(np.int64)
    fresh = np.ones(len(kmers), bool)
    fresh[1:] = group[1:] != group[:-1]
    again = np.flatnonzero(~fresh)
    if not len(again):
        return kmers
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(kmers)), 0))
    out = kmers.copy()
    out[place[again]] = textcore.mix(kmers[place[again]] + (again - begin[again]).astype(np.uint64) * NEXT_OCCURRENCE)
    return out


def sketch(text: str, k: int = K, size: int = TUPLE) -> np.ndarray:
    """The entries of a text's fingerprint."""
    kmers = kmer_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), k)
    out = np.zeros(ENTRIES, np.uint64)
    if not len(kmers):
        return out.astype(np.uint32)
    elements = (numbered(kmers) >> np.uint64(32)).astype(np.uint32)
    size = min(size, len(kmers))
    rows = min(ENTRIES, max(1, TILE // len(kmers)))
    room = (_room if len(kmers) <= TILE else np.empty(len(kmers), np.uint32))[: rows * len(kmers)].reshape(rows, len(kmers))
    for first in range(0, ENTRIES, rows):
        at = slice(first, min(first + rows, ENTRIES))
        values = np.multiply(elements, FACTOR[at, None], out=room[: at.stop - first])
        own = np.arange(len(values))
        picked = np.empty((len(values), size), np.int64)
        for turn in range(size):
            picked[:, turn] = values.argmin(axis=1)
            values[own, picked[:, turn]] = 0xFFFFFFFF
        picked.sort(axis=1)
        for turn in range(size):  # in the order of the text
            out[at] = textcore.mix(out[at] + kmers[picked[:, turn]])
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    return float((one == other).mean())


def _bytes(entries: np.ndarray) -> bytes:
    return entries.astype(">u4").tobytes()


OUT = "doc_id long, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = [c.split()[0] for c in OUT.split(", ")]
STORED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("end", pa.string()), ("text", pa.string())])


def _compared(doc_id: int | None, text: str, own: np.ndarray, following: str, theirs: np.ndarray, digests: bool) -> dict:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    changed = sketch(edited)
    told = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest() if digests else edited
    return dict(zip(NAMES, (doc_id, len(text), told, _bytes(own), _bytes(changed), likeness(own, changed), likeness(own, theirs))))


def _follower(digests: bool):
    @workers.task
    def follow(batches):
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            made, size = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = sketch(text)
                if held is None:
                    made.append({"doc_id": doc_id, "part": part, "end": "first", "text": text})
                else:
                    made.append(_compared(*held, text, own, digests))
                held = doc_id, text, own
            yield pa.RecordBatch.from_pylist(made, STORED)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"doc_id": held[0], "part": part, "end": "last", "text": held[1]}], STORED)

    return follow


def _matcher(digests: bool):
    @workers.task
    def match(batches):
        for batch in batches:
            made = [
                _compared(doc_id, text, sketch(text), following, sketch(following), digests)
                for doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")))
            ]
            yield pa.RecordBatch.from_pylist(made, pa.schema([STORED.field(c) for c in NAMES]))

    return match


def with_next(docs: DataFrame, digests: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row: ``edited`` is the
    text with its second half replaced by the beginning of the next document, or its SHA-256 if *digests*.

    Runs at once: the results are stored, as the ends of the stretches are matched from them.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(texts) // PART_BYTES)
    order = [F.desc_nulls_last("doc_id"), F.col("tie")]
    ordered = texts.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    stored = cut(ordered.mapInArrow(_follower(digests), f"{OUT}, part int, end string, text string"))
    firsts = sorted(r.part for r in stored.where(F.col("end") == "first").select("part").collect())  # a number for each task
    after = spark.createDataFrame(list(zip(firsts, [*firsts[1:], *firsts[:1]])), "part int, next int")
    heads = stored.where(F.col("end") == "first").select(F.col("part").alias("next"), F.col("text").alias("following"))
    ends = stored.where(F.col("end") == "last").select("part", "doc_id", "text").join(after, "part").join(heads, "next")
    matched = ends.select("doc_id", "text", "following").mapInArrow(_matcher(digests), OUT)
    found = stored.where(F.col("end").isNull()).select(*NAMES).unionByName(matched)
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
