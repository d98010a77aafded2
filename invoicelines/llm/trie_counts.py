"""Operator 8. Token counts of a unigram segmentation, shared along a trie.

A text's pre-tokens are its words (runs without the six ASCII white-space
characters), each with a blank before it. The best segmentation of a pre-token into
pieces of a public vocabulary maximises the sum of the pieces' log-probabilities; a
piece's probability is that of its rank in the vocabulary under Zipf's law (the
vocabulary has no probabilities, and tokenizers are not trained here). All single
bytes are pieces, so every pre-token has a segmentation.

The distinct pre-tokens of a batch of texts form a trie. Walking it in byte order,
a node's forward score, the best score of the bytes down to it, and the count of
pieces that reach it are computed once, however many pre-tokens share the prefix; a
terminal's count is its pre-token's. Counts are remembered by the task, in about
KNOWN_BYTES. Nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import computed_beside, ship, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of remembered pre-tokens, about; what one costs besides its own bytes; longer ones are not remembered.
KNOWN_BYTES, WORD_BYTES, LONG = 256 << 20, 200, 256
BATCH_BYTES = 1 << 20


@lru_cache(2)
def pieces(path: str) -> tuple[dict[bytes, float], int]:
    """Log-probability of each piece, 1 / (rank + 1) scaled to sum to one, and the longest piece's length."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    total = log(sum(1.0 / (r + 1) for r in ranks.values()))
    return {p: -log(r + 1) - total for p, r in ranks.items()}, max(map(len, ranks))


def count_sorted(words: list[bytes], score: dict[bytes, float], longest: int) -> tuple[list[int], list[float]]:
    """Pieces and score of the best segmentation of each of the sorted pre-tokens; of equal scores the one with fewer pieces.

    The stack holds the trie's nodes from the root down to the last pre-token;
    of the next one only the nodes below the shared prefix are new.
    """
    best, used, last = [0.0], [0], b""
    counts, scores = [], []
    get = score.get
    for w in words:
        shared = 0
        for a, b in zip(last, w, strict=False):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], used[shared + 1 :]
        for end in range(shared + 1, len(w) + 1):
            top, n = -1e300, 0
            for start in range(max(0, end - longest), end):
                s = get(w[start:end])
                if s is not None:
                    s += best[start]
                    if s > top or (s == top and used[start] + 1 < n):
                        top, n = s, used[start] + 1
            best.append(top)
            used.append(n)
        counts.append(used[-1])
        scores.append(best[-1])
        last = w
    return counts, scores


def token_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str | None = None) -> DataFrame:
    """The columns `keep` (default all), n_pretokens, n_tokens and unigram_score (the sum of the log-probabilities); one row per row of `docs`.

    Null and empty texts have no pre-tokens. Whole texts are read. A column of
    one of these three names gives way to the new one. vocabulary: a file of
    ranked pieces, by default the public one, looked up where the task runs.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch], kept: int) -> Iterator[list]:
        import public_tokenizers

        score, longest = pieces(vocabulary or public_tokenizers.path(VOCABULARY))
        known: dict[bytes, int] = {}
        numbers, size = [np.zeros(0, np.int64), np.zeros(0)], 0
        for b in batches:
            texts = b.column(kept).cast(pa.binary()).to_pylist()
            sums = []
            for at, to in _groups(texts):
                words = [t.split() if t else [] for t in texts[at:to]]
                if size > KNOWN_BYTES:
                    known, numbers, size = {}, [np.zeros(0, np.int64), np.zeros(0)], 0
                new = sorted(set(chain.from_iterable(words)).difference(known))
                counts, scores = count_sorted([b" " + w for w in new], score, longest)
                known.update(zip(new, range(len(numbers[0]), len(numbers[0]) + len(new)), strict=True))
                numbers = [np.append(numbers[0], np.array(counts, np.int64)), np.append(numbers[1], np.array(scores, float))]
                sizes = np.array([len(w) for w in words])
                which = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, sizes.sum())
                owner = np.repeat(np.arange(len(words)), sizes)
                sums.append((sizes, np.bincount(owner, numbers[0][which], len(words)).astype(np.int64), np.bincount(owner, numbers[1][which], len(words))))
                size += WORD_BYTES * len(new)
                for w in new:
                    if len(w) > LONG:
                        del known[w]
                    else:
                        size += len(w)
            found = [pa.array(np.concatenate([x[k] for x in sums]) if sums else np.zeros(0), t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield [*b.columns[:kept], *found]

    return computed_beside(docs, text, keep, {"n_pretokens": "bigint", "n_tokens": "bigint", "unigram_score": "double"}, run)


def _groups(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= BATCH_BYTES:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all whole documents."""
    return token_counts(table(spark, sf_dir, "documents"), keep=["doc_id"])
