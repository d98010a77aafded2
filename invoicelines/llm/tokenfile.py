"""Operator 4. Token ids packed word by word with Simple-8b.

Format of a block: a head of three little-endian 32-bit integers (ids, words,
escapes), then the words, then the escapes, both little-endian 64-bit. A word's
upper 4 bits select how many ids of how many bits its lower 60 bits hold, first
id lowest (COUNTS, BITS). Selector 1 is an escape: the word stands for one id of
more than 60 bits, and its lower bits are the id's place among the escapes. The
last word may have room for more ids than are left; the head's count decides.
Words do not depend on each other, so all words of a selector are decoded at
once.

A token file is a Parquet table of blocks: part, block, doc_ids, lengths (ids of
each document), payload. A block holds whole documents, about BLOCK_IDS ids, so
documents lie in ascending id order within and across (part, block), and
lengths give each document's offset in its block.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, ship, stored, table

#: Fixed values of the format: ids per word and bits per id, by selector.
COUNTS = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 1
#: Each count of ids as the sum of two smaller ones.
SPANS = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (3, 2), 6: (3, 3), 7: (4, 3), 8: (4, 4), 10: (5, 5), 12: (6, 6), 15: (8, 7), 20: (10, 10), 30: (15, 15), 60: (30, 30), 120: (60, 60), 240: (120, 120)}
BLOCK_IDS = 1 << 16
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: Bytes of pieces and their ids that a worker remembers, about; what one piece costs besides its characters and ids.
KNOWN_BYTES, PIECE_BYTES = 320 << 20, 200
#: Longer pieces are not remembered; texts that hold them are encoded in parts of about so many characters.
LONG_PIECE, WHOLE_PART = 256, 1 << 17


def pack(ids: np.ndarray) -> bytes:
    """A block from unsigned 64-bit ids; each word takes as many ids as fit."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if n and ids.max() < 1 << 53:
        bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    else:
        smeared = ids.copy()
        for k in (1, 2, 4, 8, 16, 32):
            smeared |= smeared >> np.uint64(k)
        bits = np.bitwise_count(smeared).astype(np.uint8)
    # widest[k][i]: bits of the widest of the k ids from i on; beyond the end there are zeros
    widest = {1: np.concatenate((bits, np.zeros(240, np.uint8)))}
    for k, (x, y) in SPANS.items():
        widest[k] = np.maximum(widest[x], np.append(widest[y][x:], np.zeros(x, np.uint8)))
    take, selector = np.ones(n, np.int64), np.full(n, ESCAPE, np.uint8)
    for s in range(len(COUNTS) - 1, -1, -1):  # later ones hold more ids and win
        if s != ESCAPE and (fits := widest[int(COUNTS[s])][:n] <= BITS[s]).any():
            take[fits], selector[fits] = COUNTS[s], s
    starts, at, step = [], 0, take.tolist()
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    selectors = selector[starts]
    words = np.zeros(len(starts), np.uint64)
    padded = np.concatenate((ids, np.zeros(240, np.uint64)))
    for s in np.unique(selectors).tolist():
        own = np.flatnonzero(selectors == s)
        if s == ESCAPE:
            words[own] = np.arange(len(own), dtype=np.uint64)
        elif BITS[s]:
            shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
            words[own] = np.bitwise_or.reduce(padded[starts[own, None] + np.arange(COUNTS[s])] << shifts, axis=1)
        words[own] |= np.uint64(s) << np.uint64(60)
    escapes = ids[starts[selectors == ESCAPE]]
    return np.array([n, len(words), len(escapes)], "<u4").tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def unpack(block: bytes) -> np.ndarray:
    """The unsigned 64-bit ids of a block, all words of a selector at once."""
    n, n_words, n_escapes = np.frombuffer(block, "<u4", 3).tolist()
    words = np.frombuffer(block, "<u8", n_words, 12)
    escapes = np.frombuffer(block, "<u8", n_escapes, 12 + 8 * n_words)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    starts = np.cumsum(counts) - counts
    out = np.zeros(n + 240, np.uint64)
    for s in np.unique(selectors).tolist():
        own = np.flatnonzero(selectors == s)
        if s == ESCAPE:
            out[starts[own]] = escapes[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif BITS[s]:
            shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
            out[starts[own, None] + np.arange(COUNTS[s])] = (words[own, None] >> shifts) & np.uint64((1 << int(BITS[s])) - 1)
    return out[:n]


class Encoder:
    """Whole texts to ids; remembers the ids of pieces, in about `most` bytes.

    A single blank between two non-blank characters always begins a new
    pre-token of the byte-level vocabulary, so a text may be cut there and its
    pieces encoded one by one with the same result. Texts with other blanks, or
    with a piece of more than LONG_PIECE characters, are encoded whole, in parts
    that end at such cuts; nothing of them is remembered.
    """

    cut = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str, most: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # pieces come once, so its own memory only costs
        self.most = most
        # A byte-level token has one character for each of its bytes; special tokens are ASCII.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths, self.starts, self.flat, self.used, self.bytes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0, 0

    def learn(self, plain: list[str], rest: list[str]) -> None:
        """Different pieces, without the blank that they begin with; those that begin a text have one before them, which no other has. plain: without any white space."""
        # Plain ones are encoded as one text and told apart by their bytes.
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(plain)] if plain else [""], add_special_tokens=False)[0].ids, np.int64)
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(1 + np.fromiter(map(len, map(str.encode, plain)), np.int64, len(plain)))) + 1
        others = [e.ids for e in self.tokenizer.encode_batch_fast([p[1:] if p[0] == " " else " " + p for p in rest], add_special_tokens=False)]
        lengths = np.concatenate((np.diff(ends, prepend=0), np.array([len(x) for x in others], np.int64)))
        flat = np.concatenate((ids, np.array([i for x in others for i in x], np.int64)))
        at, count = len(self.known), len(lengths)
        while at + count > len(self.lengths):
            self.lengths, self.starts = np.append(self.lengths, np.zeros_like(self.lengths)), np.append(self.starts, np.zeros_like(self.starts))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.lengths[at : at + count], self.starts[at : at + count] = lengths, self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.bytes += PIECE_BYTES * count + 2 * (sum(map(len, plain)) + sum(map(len, rest))) + 4 * len(flat)
        self.known.update(zip(plain + rest, range(at, at + count), strict=True))

    def whole(self, text: str) -> np.ndarray:
        """Of a text that is not remembered, part by part."""
        found, at = [np.zeros(0, np.uint32)], 0
        while at < len(text):
            m = self.cut.search(text, at + WHOLE_PART) if at + WHOLE_PART < len(text) else None
            to = m.start() if m else len(text)
            found.append(np.array(self.tokenizer.encode_batch_fast([text[at:to]], add_special_tokens=False)[0].ids, np.uint32))
            at = to
        return np.concatenate(found)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Of an array of strings, null for no text."""
        if not len(texts):
            return []
        if self.bytes > self.most:
            self.forget()
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()  # each different piece is looked up once
        pieces, own = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        starts = (offsets - offsets[0])[:-1]
        known = self.known
        first = [" " + pieces[i] for i in own[starts].tolist()]
        codes = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        odd, plain, rest, unknown = np.zeros(len(pieces), bool), [], [], np.flatnonzero(codes < 0)
        for i in unknown.tolist():
            p = pieces[i]
            if not p or len(p) > LONG_PIECE:
                odd[i] = True
            elif p.isprintable():
                plain.append(p)
            elif p[0].isspace() or p[-1].isspace():
                odd[i] = True
            else:
                rest.append(p)
        slow = np.bitwise_or.reduceat(odd[own], starts)
        rest += {p for p, s in zip(first, slow.tolist(), strict=True) if not s and p not in known}
        if plain or rest:
            self.learn(plain, rest)
        codes[unknown] = [known.get(pieces[i], 0) for i in unknown.tolist()]
        which = codes[own]
        which[starts] = [known.get(p, 0) for p in first]
        counts = np.diff(offsets)
        lengths = np.where(np.repeat(slow, counts), 0, self.lengths[which])
        ends = np.cumsum(lengths)
        gaps = np.repeat(self.starts[which] - (ends - lengths), lengths)
        flat = self.flat[gaps + np.arange(len(gaps))]
        out = np.split(flat, np.concatenate(([0], ends))[np.cumsum(counts)[:-1]])
        for i in np.flatnonzero(slow).tolist():
            out[i] = self.whole(texts[i].as_py() or "")
        return out


@lru_cache(1)
def encoder(path: str, most: int) -> Encoder:
    """One per worker process, so that later tasks know the pieces of earlier ones."""
    return Encoder(path, most)


def _groups(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` bytes."""
    at, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        size += n
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def write_token_file(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int | None = END_ID, block_ids: int = BLOCK_IDS, known_bytes: int = KNOWN_BYTES) -> None:
    """Encodes every whole text and writes the token file, documents in ascending id order.

    Null and empty texts have no ids but the end id. Rows with a null id come
    first; rows with the same id are ordered by the text's hash, and dealt by it
    too, so that a frequent id is not one task. vocabulary: a tokenizer file's
    path, by default the public byte-level vocabulary, looked up where the task
    runs; known_bytes: what a worker remembers of pieces. Other columns are not
    read. An empty table gives a file without blocks.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = encoder(vocabulary or public_tokenizers.path(VOCABULARY), known_bytes).encode
        ids, lengths, held, size, block = [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            rows = [[part], [block], [ids], [lengths], [pack(np.concatenate(held))]]
            return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, schema, strict=True)], names=names)

        part = 0
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(0)[0].as_py()
            texts, keys = b.column(2), b.column(1).to_pylist()
            for s, e in _groups(texts):
                for key, found in zip(keys[s:e], encode(texts[s:e]), strict=True):
                    if end_id is not None:
                        found = np.append(found, np.uint32(end_id))
                    ids.append(key)
                    lengths.append(len(found))
                    held.append(found)
                    size += len(found)
                    if size >= block_ids:
                        yield out()
                        ids, lengths, held, size, block = [], [], [], 0, block + 1
        if ids:
            yield out()

    names = ["part", "block", "doc_ids", "lengths", "payload"]
    schema = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    rows = rows.select(F.spark_partition_id().alias("part"), "id", "text")
    rows.mapInArrow(run, "part int, block bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary").write.parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (array<bigint>), in the file's order within partitions.

    Starts: sums of the parts before, then of the blocks before in the part,
    then of the documents before in the block; only counts are summed, by part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, lengths = unpack(row["payload"]), np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - lengths), values], names=["doc_id", "start", "ids"])

    return _with_starts(spark, path).mapInArrow(run, "doc_id bigint, start bigint, ids array<bigint>")


def _with_starts(spark: SparkSession, path: str) -> DataFrame:
    blocks = spark.read.schema("part int, block bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary").parquet(path)
    counts, _ = stored(blocks.select("part", "block", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")), "tokens")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    of_parts = counts.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each part of the file
    of_parts = of_parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("parts_before"))
    starts = counts.withColumn("blocks_before", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.join(of_parts, F.col("part") == F.col("p")).select(F.col("part").alias("s_part"), F.col("block").alias("s_block"), (F.col("parts_before") + F.col("blocks_before")).alias("start"))
    return blocks.join(starts, (F.col("part") == F.col("s_part")) & (F.col("block") == F.col("s_block"))).select("start", "doc_ids", "lengths", "payload")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the file: the crc32 of its ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, lengths = unpack(row["payload"]).astype("<u4"), np.array(row["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                crc = [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + starts), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _with_starts(spark, path).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_output(docs: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Writes the token file (by default in the shared folder) and gives the digests of what is read back."""
    path = path or new_path(docs.sparkSession, "token-file")
    write_token_file(docs, path, **kw)
    return token_digests(docs.sparkSession, path)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token file of all whole documents, written, read back and digested."""
    return token_output(table(spark, sf_dir, "documents"))
