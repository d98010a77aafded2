"""Operator 12. Byte-level BPE by DuckDB's recursive queries inside Spark's tasks.

A text's pre-tokens are the matches of a pattern. The different new ones of a
batch become rows of a DuckDB in the task's memory: a word and its tokens, at first its
bytes. In each step of a recursive query the tokens' positions join the merge table
(two neighbours and what they become), each word's leftmost pair of the least rank is
contracted, and words without such a pair are done. A word that is itself in the
vocabulary is one token at once, as in the tiktoken library. Decoding joins the rows
(document, position, id) with the vocabulary and aggregates the bytes in the order of
the positions.

The merge table holds every split of every token into two tokens, so that ranks
decide alone, not how the vocabulary was trained. A word of more than LONG bytes
contracts all its pairs of the least rank at once, alternate ones where they overlap,
wherever no later pair can have a lesser rank (merges.safe); else only the leftmost.
A letter run without any border still costs its length times the different merges in it.

Ids of pieces are remembered by the worker up to `known_bytes` (see tokenfile.Encoder,
which cuts texts at single blanks). Nothing is shuffled, and the databases hold one
batch at a time, without any file.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import computed_beside, ship, table
from .tokenfile import PIECE_BYTES, WHOLE_PART, Encoder, _groups

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of pieces and ids that a worker remembers, about; memory of its database.
KNOWN_BYTES, DATABASE_MEMORY = 256 << 20, "320MB"
#: Words of more bytes contract several pairs in a step; words, and squares of their bytes, in one query.
LONG, WORDS, SQUARES = 512, 20_000, 1 << 23
#: Ids that are decoded by one query.
DECODED_IDS = 1 << 20

#: A word's leftmost pair of the least rank: the least of rank * 2^20 + position.
SHORT_WORDS = """
WITH RECURSIVE state(word, toks) AS (
  SELECT word, CASE WHEN id IS NULL THEN toks ELSE [id] END FROM base LEFT JOIN vocabulary USING (piece)
  UNION ALL
  SELECT s.word, s.toks[:least % 1048576 - 1] || [(least // 1048576)::INTEGER] || s.toks[least % 1048576 + 2:]
  FROM state s JOIN (
    SELECT word, min(merged::BIGINT * 1048576 + pos) AS least
    FROM (SELECT word, unnest(toks[:-2]) AS a, unnest(toks[2:]) AS b, unnest(range(1, len(toks))) AS pos FROM state) p
    JOIN merges m ON m.a = p.a AND m.b = p.b
    GROUP BY word
  ) c ON c.word = s.word
)
SELECT word, arg_min(toks, len(toks)) AS toks FROM state GROUP BY word ORDER BY word
"""
#: Hits that follow each other without a miss overlap; of them every second one, from the first on, is contracted.
LONG_WORDS = """
WITH RECURSIVE state(word, toks) USING KEY (word) AS (
  SELECT word, CASE WHEN id IS NULL THEN toks ELSE [id] END FROM base LEFT JOIN vocabulary USING (piece)
  UNION
  SELECT word, list(CASE WHEN taken THEN merged ELSE tok END ORDER BY pos)
  FROM (
    SELECT *, lag(taken, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone
    FROM (
      SELECT *, hit AND (pos = leftmost OR safe AND (pos - miss) % 2 = 1) AS taken
      FROM (
        SELECT *, coalesce(max(CASE WHEN NOT hit THEN pos END) OVER (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS miss,
               min(CASE WHEN hit THEN pos END) OVER (PARTITION BY word) AS leftmost
        FROM (
          SELECT p.*, merged, safe, coalesce(merged = min(merged) OVER (PARTITION BY word), false) AS hit
          FROM (SELECT word, unnest(toks) AS tok, unnest(toks[2:] || [-1]) AS after, unnest(range(1, len(toks) + 1)) AS pos FROM state) p
          LEFT JOIN merges m ON m.a = p.tok AND m.b = p.after
        )
      )
    )
  )
  WHERE NOT gone GROUP BY word HAVING bool_or(taken)
)
SELECT word, toks FROM state ORDER BY word
"""
DECODED = "SELECT doc, string_agg(piece, '' ORDER BY pos) AS decoded FROM tokens JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc"


@lru_cache(1)
def pattern() -> str:
    """The public pattern with the letters and numbers that the tiktoken library knows.

    The library and the module regex follow different versions of Unicode. Code
    points that Python's own, older tables don't know are put to the library:
    where a letter (number) joins the one before it, both are one token.
    """
    import public_tokenizers
    import regex
    import tiktoken

    text = public_tokenizers.PATTERN
    for kind, before in (("L", "a"), ("N", "1")):
        holds = regex.compile(rf"\p{{{kind}}}").match
        new = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and holds(c)]
        ranks = {bytes([i]): i for i in range(256)} | {(before + c).encode(): 256 + i for i, c in enumerate(new)}
        library = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        runs: list[str] = []
        for c in (c for c in new if len(library.encode_ordinary(before + c)) > 1):
            if runs and ord(runs[-1][-1]) == ord(c) - 1:
                runs[-1] = f"{runs[-1][0]}-{c}"
            else:
                runs.append(c)
        if runs:
            text = text.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{''.join(runs)}]]")
    return f"(?V1){text}"


@lru_cache(1)
def codec(path: str, pat: str, most: int) -> Codec:
    """One per worker process, so that later tasks know the pieces of earlier ones."""
    return Codec(path, pat, most)


class Codec(Encoder):
    """Whole texts to ids and back; see tokenfile.Encoder for how texts are cut and what is remembered."""

    def __init__(self, path: str, pat: str, most: int) -> None:
        import duckdb
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # The newer letters make the pattern slow, and ASCII has none of them.
        self.most, self.ascii, self.other = most, regex.compile(public_tokenizers.PATTERN).findall, regex.compile(pat).findall
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.database = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DATABASE_MEMORY, "temp_directory": "", "autoinstall_known_extensions": "false"})
        splits = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, merged = (np.array(c, np.int32) for c in zip(*splits, strict=True)) if splits else (np.zeros(0, np.int32),) * 3
        early = np.union1d(a[merged < a], b[merged < b])  # tokens that a merge of a lesser rank takes in
        self.fill("merges", a=a, b=b, merged=merged, safe=~np.isin(merged, early))
        # Bytes as the characters of the same numbers: a piece need not be UTF-8.
        self.fill("vocabulary", id=np.array(list(self.ranks.values()), np.int32), piece=[t.decode("latin-1") for t in self.ranks])
        self.forget()

    def fill(self, name: str, **columns) -> None:
        self.database.register("given", pa.table(columns))
        self.database.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.database.unregister("given")

    def ask(self, query: str, name: str, rows: pa.Table) -> pa.Table:
        self.database.register(name, rows)
        try:
            return self.database.sql(query).to_arrow_table()
        finally:
            self.database.unregister(name)

    def contract(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words, none empty: where each word's begin, how many they are, and all ids."""
        starts, lengths, flat, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.int32)], 0
        coded = [w.encode() for w in words]
        widths = np.fromiter(map(len, coded), np.int64, len(coded))
        short = np.flatnonzero(widths <= LONG)
        # A word leaves lists of all lengths down from its own behind, so the squares of the lengths are bounded too.
        turn = np.cumsum(widths[short] ** 2) // SQUARES + np.arange(len(short)) // WORDS
        runs = [(SHORT_WORDS, r) for r in np.split(short, np.flatnonzero(np.diff(turn)) + 1) if len(r)] + [(LONG_WORDS, np.array([i])) for i in np.flatnonzero(widths > LONG)]
        for query, own in runs:
            some = [coded[i] for i in own.tolist()]
            ends = np.concatenate(([0], np.cumsum(widths[own]))).astype(np.int32)
            toks = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.byte[np.frombuffer(b"".join(some), np.uint8)]))
            rows = pa.table({"word": np.arange(len(own), dtype=np.int32), "piece": [w.decode("latin-1") for w in some], "toks": toks})
            found = self.ask(query, "base", rows)["toks"].combine_chunks()
            offsets = found.offsets.to_numpy() - found.offsets[0].as_py()
            starts[own], lengths[own] = size + offsets[:-1], np.diff(offsets)
            flat.append(found.flatten().to_numpy())
            size += offsets[-1]
        return starts, lengths, np.concatenate(flat)

    def encode_strings(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each string has, and all ids: those of its matches, different new ones contracted once."""
        matches = [(self.ascii if s.isascii() else self.other)(s) for s in strings]
        counts = np.fromiter(map(len, matches), np.int64, len(matches))
        place: dict[str, int] = {}
        own = np.fromiter((place.setdefault(m, len(place)) for m in chain.from_iterable(matches)), np.int64, counts.sum())
        # What is known as a piece by itself is kept without its blank, or with one if it had none.
        known = np.fromiter((self.known.get(m[1:] if m[0] == " " else " " + m, -1) for m in place), np.int64, len(place))
        starts, lengths = self.starts[known], self.lengths[known]
        new = np.flatnonzero(known < 0)
        if len(new):
            words = list(place)
            starts[new], lengths[new], ids = self.contract([words[i] for i in new.tolist()])
            starts[new] += self.used
            pool = np.concatenate((self.flat[: self.used], ids))
        else:
            pool = self.flat
        each = lengths[own]
        ends = np.cumsum(each)
        total = np.concatenate(([0], ends))[np.cumsum(counts)]
        flat = pool[np.repeat(starts[own] - (ends - each), each) + np.arange(each.sum())]
        return np.diff(total, prepend=0), flat

    def learn(self, plain: list[str], rest: list[str]) -> None:
        """See tokenfile.Encoder.learn()."""
        lengths, flat = self.encode_strings([" " + p for p in plain] + [p[1:] if p[0] == " " else " " + p for p in rest])
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
        """Of a text that is not remembered: part by part, the different matches of a part contracted once."""
        found, at = [np.zeros(0, np.uint32)], 0
        while at < len(text):
            m = self.cut.search(text, at + WHOLE_PART) if at + WHOLE_PART < len(text) else None
            to = m.start() if m else len(text)
            found.append(self.encode_strings([text[at:to]])[1].astype(np.uint32))
            at = to
        return np.concatenate(found)

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids; ids that are not in the vocabulary have none."""
        out = [b""] * len(ids)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids])
        flat = np.concatenate([np.zeros(0, np.int64), *ids])
        for at in range(0, len(flat), DECODED_IDS):
            part = slice(at, at + DECODED_IDS)
            rows = pa.table({"doc": doc[part], "pos": np.arange(len(doc[part]), dtype=np.int32), "id": flat[part].astype(np.int32)})
            found = self.ask(DECODED, "tokens", rows)
            for i, t in zip(found["doc"].to_pylist(), found["decoded"].to_pylist(), strict=True):
                out[i] += t.encode("latin-1")
        return out


def _run(docs: DataFrame, read: str, keep: list[str] | None, new: dict[str, str], vocabulary: str | None, known_bytes: int, rows) -> DataFrame:
    """The columns `keep` and the new ones, by rows(codec, column, pattern's matches) for runs of rows."""
    ship(docs.sparkSession)
    pat = pattern()

    def run(batches: Iterator[pa.RecordBatch], kept: int) -> Iterator[list]:
        import public_tokenizers

        for b in batches:
            if b.num_rows:
                yield [*b.columns[:kept], *rows(codec(vocabulary or public_tokenizers.path(VOCABULARY), pat, known_bytes), b.column(kept))]

    return computed_beside(docs, read, keep, new, run)


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)))


def bpe_encode(docs: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str | None = None, known_bytes: int = KNOWN_BYTES) -> DataFrame:
    """The columns `keep` (default all) and ids (array<int>); one row per row of `docs`.

    Whole texts are read, null ones as empty; empty texts have no ids. Repeated
    rows stay; an empty table gives an empty result; a column named ids gives way.
    vocabulary: a file of ranks, by default the public one, looked up where the
    task runs. Ids are those of the tiktoken library's encode_ordinary().
    """

    def rows(c: Codec, texts: pa.Array) -> list:
        return [_lists([x for s, e in _groups(texts) for x in c.encode(texts[s:e])])]

    return _run(docs, text, keep, {"ids": "array<int>"}, vocabulary, known_bytes, rows)


def bpe_decode(encoded: DataFrame, ids: str = "ids", keep: list[str] | None = None, vocabulary: str | None = None, known_bytes: int = KNOWN_BYTES) -> DataFrame:
    """The columns `keep` (default all) and decoded (binary), the bytes of the ids (an array of integers, null as empty); a column named decoded gives way.

    Ids of no token have no bytes. Bytes need not be UTF-8 where a list was cut inside a character.
    """
    ship(encoded.sparkSession)
    pat = pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        for b in batches:
            if b.num_rows:
                c = codec(vocabulary or public_tokenizers.path(VOCABULARY), pat, known_bytes)
                found = [x for s in range(0, b.num_rows, 256) for x in c.decode([np.array(r or [], np.int64) for r in b.column(b.num_columns - 1)[s : s + 256].to_pylist()])]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.binary())], names=names)

    kept = [c for c in (keep if keep is not None else encoded.columns) if c.lower() != "decoded"]
    rows = encoded.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{ids}`").cast("array<bigint>").alias("read"))
    names = [*[f"c{i}" for i in range(len(kept))], "decoded"]
    schema = ", ".join([*[f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[:-1])], "decoded binary"])
    return rows.mapInArrow(run, schema).toDF(*kept, "decoded")


def bpe_digests(docs: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str | None = None, known_bytes: int = KNOWN_BYTES) -> DataFrame:
    """The columns `keep` and n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the bytes decoded from these ids).

    As bpe_encode() and bpe_decode() in one task, so that ids don't leave it.
    """

    def rows(c: Codec, texts: pa.Array) -> list:
        counts, of_ids, of_bytes = [], [], []
        for s, e in _groups(texts):
            ids = c.encode(texts[s:e])
            counts += map(len, ids)
            of_ids += [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
            of_bytes += [hashlib.sha256(x).hexdigest() for x in c.decode(ids)]
        return [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]

    return _run(docs, text, keep, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, vocabulary, known_bytes, rows)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all whole documents and what they decode to, as digests."""
    return bpe_digests(table(spark, sf_dir, "documents"), keep=["doc_id"])
