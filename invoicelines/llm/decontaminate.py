"""Operator 2. Benchmark decontamination by a broadcast set of hashed n-grams.

All steps are DataFrame functions. Benchmark items become windows of `n`
normalised words, their hashes and words are the broadcast side of one hash join, and
the documents' windows stream past it: scan, split, explode, hash and join are one
stage. A hash hit is verified word by word inside the join. Which items hold a
window is joined to the hits alone, once for each set of windows that occurs.

Where the windows are too many or too long to be broadcast, the documents' window
hashes are shuffled, a few numbers a word, and their hits are joined back to the
texts and verified there.

Words: A-Z lower-cased, then runs of characters that are none of the ASCII
characters outside 0-9 and a-z; all other characters belong to words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
CASED_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Windows and bytes of their words that are broadcast at most; a larger set is joined by a shuffle on the hash.
BROADCAST_WINDOWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Text hashes that are broadcast at most (12 bytes each) when documents are removed.
BROADCAST_TEXTS = 2_000_000


def words_of(text: Column) -> Column:
    """Normalised words; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP + "+"), ""), F.array().cast("array<string>"))


def _hash(words: Column, pos: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(words, pos + i) for i in range(n)])


def windows_of(benchmark: DataFrame, n: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct item (as text, may be null), n (length), hash and window (the words) of all items with words."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), words_of(F.col(f"`{text}`")).alias("ws")).where("size(ws) > 0")
    rows = rows.select("item", "ws", F.least(F.lit(n), F.size("ws")).alias("n"))
    rows = rows.select("item", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("n") + 1), lambda i: F.slice(F.col("ws"), i, F.col("n")))).alias("window")).distinct()
    # The hash is computed as the documents' are, from the words themselves.
    hashes = F.array(*[_hash(F.col("window"), F.lit(0), k) for k in range(1, n + 1)])
    return rows.select("item", "n", F.element_at(hashes, F.col("n")).alias("hash"), "window")


def _keyed(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows (ws and others) once for each word, with pos, n and hash of the windows that begin there; a row without words once, with nulls."""
    others = [c for c in rows.columns if c != "ws"]
    rows = rows.select(*others, "ws", F.posexplode_outer("ws").alias("pos", "word")).drop("word")
    if len(lengths) == 1:
        return rows.withColumns({"n": F.lit(lengths[0]), "hash": _hash(F.col("ws"), F.col("pos"), lengths[0])})
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("n"), _hash(F.col("ws"), F.col("pos"), k).alias("hash")) for k in lengths]))
    return rows.withColumn("k", each).select(*others, "ws", "pos", "k.n", "k.hash")


def _found(docs: DataFrame, windows: DataFrame, lengths: list[int], small: bool, id_col: str, text: str) -> DataFrame:
    """id, body and again (hashes of the text), n_words, and hits: start, end, n, hash of each verified occurrence; one row per row of `docs`."""
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(body).alias("body"), F.hash(body).alias("again"), words_of(body).alias("ws")).withColumn("n_words", F.size("ws").cast("bigint"))
    hit = lambda start, n, hash_: F.struct(start.alias("start"), (start + n).alias("end"), n.alias("n"), hash_.alias("hash"))
    wanted = windows.select(F.col("n").alias("w_n"), F.col("hash").alias("w_hash"), F.col("window").alias("w_window"))
    meets = (F.col("hash") == F.col("w_hash")) & (F.col("n") == F.col("w_n"))
    if small:
        verified = meets & (F.slice(F.col("ws"), F.col("pos") + 1, F.col("n")) == F.col("w_window"))
        met = _keyed(rows.withColumn("row", F.monotonically_increasing_id()), lengths).join(F.broadcast(wanted), verified, "left")
        # Of the words without a hit only the first is kept, to keep the document.
        met = met.where(F.col("w_hash").isNotNull() | F.col("pos").isNull() | ((F.col("pos") == 0) & (F.col("n") == lengths[0])))
        hits = F.collect_set(F.when(F.col("w_hash").isNotNull(), hit(F.col("pos"), F.col("n"), F.col("hash"))))
        return met.groupBy("row").agg(*[F.first(c).alias(c) for c in ("id", "body", "again", "n_words")], hits.alias("hits")).drop("row")
    # Only numbers are shuffled; what met by its hash is verified on the text itself.
    met = _keyed(rows.select("body", "again", "ws"), lengths).where("pos IS NOT NULL").select("body", "again", "pos", "n", "hash").join(wanted, meets)
    met = met.groupBy(F.col("body").alias("m_body"), F.col("again").alias("m_again")).agg(F.collect_set(F.struct("pos", "n", "hash", "w_window")).alias("met"))
    joined = rows.join(met, (F.col("body") == F.col("m_body")) & (F.col("again") == F.col("m_again")), "left")
    true = F.filter(F.coalesce("met", F.array()), lambda m: F.slice(F.col("ws"), m["pos"] + 1, m["n"]) == m["w_window"])
    return joined.select("id", "body", "again", "n_words", F.transform(true, lambda m: hit(m["pos"], m["n"], m["hash"])).alias("hits"))


def _search(docs: DataFrame, benchmark: DataFrame, n: int, id_col: str, text: str, item: str, item_text: str, broadcast_windows: int, broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    """What _found() gives, stored, and the items' windows."""
    ship(docs.sparkSession)
    owned, _ = stored(windows_of(benchmark, n, item, item_text), "decontaminate")
    windows = owned.select("n", "hash", "window").distinct()
    size = windows.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("window", F.lit(0).cast("bigint"), lambda a, w: a + F.octet_length(w))), F.lit(0)), F.collect_set("n")).first()
    small = size[0] <= broadcast_windows and size[1] <= broadcast_bytes
    found, _ = stored(_found(docs, windows, sorted(size[2]) or [n], small, id_col, text), "decontaminate")  # at most n lengths
    return found, owned


def _spans(hits: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id_col, n_words, n_hit, items, spans; one row per row of `docs`.

    n_hit: words inside any occurrence of a window; items: ids (as text, sorted)
    of the items with such windows; spans: the occurrences as (start, end) word
    numbers, sorted, end excluded. Null and empty texts have no words. Windows of
    items with a null id count as hits, but have no id to list. Rows with a null
    or repeated id stay as they are. Other columns are not read. Without benchmark
    items nothing is hit; an empty table gives an empty result. A document's hits
    are gathered per document, bounded by its own words.
    """
    found, owned = _search(docs, benchmark, n, id_col, text, item, item_text, broadcast_windows, broadcast_bytes)
    found = found.withColumn("keys", F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct(h["n"].alias("n"), h["hash"].alias("hash"))))))
    some, none = found.where("size(hits) > 0"), found.where("size(hits) = 0")
    # Documents with the same windows have the same items.
    sets = some.select("keys").distinct()
    of_set = sets.select("keys", F.explode("keys").alias("k")).join(owned.where("item IS NOT NULL").select("item", F.col("n").alias("w_n"), F.col("hash").alias("w_hash")), (F.col("k.n") == F.col("w_n")) & (F.col("k.hash") == F.col("w_hash")))
    of_set = of_set.groupBy(F.col("keys").alias("set")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    some = some.join(of_set, F.col("keys") == F.col("set"), "left").select("id", "n_words", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    every = some.unionByName(none.select("id", "n_words", "hits", F.array().cast("array<string>").alias("items"))).withColumn("spans", _spans(F.col("hits")))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto")), lambda a, s: F.struct((a["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["start"]))).alias("hit"), F.greatest(a["upto"], s["end"]).alias("upto")))
    return every.select(F.col("id").alias(id_col), "n_words", covered["hit"].cast("bigint").alias("n_hit"), "items", "spans")


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, broadcast_bytes: int = BROADCAST_BYTES, broadcast_texts: int = BROADCAST_TEXTS) -> DataFrame:
    """`docs` without the contaminated rows.

    A row is judged by its own text (told apart by 96 bits of hashes), whatever its
    id, so null and repeated ids do no harm. Columns are as in `docs`, whatever
    their names.
    """
    found, _ = _search(docs, benchmark, n, id_col, text, item, item_text, broadcast_windows, broadcast_bytes)
    bad, _ = stored(found.where("size(hits) > 0").select("body", "again").distinct(), "decontaminate")
    plain, body = _plain(docs, text)
    rows = docs.toDF(*plain)
    judged = rows.join(F.broadcast(bad) if bad.count() <= broadcast_texts else bad, (F.xxhash64(body) == F.col("body")) & (F.hash(body) == F.col("again")), "left_anti")
    return judged.toDF(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`docs` with every hit word, and what stands between it and the next word, cut out of the text.

    A row's own text decides, whatever its id; rows and columns are as in `docs`.
    """
    found, _ = _search(docs, benchmark, n, id_col, text, item, item_text, broadcast_windows, broadcast_bytes)
    hit = found.where("size(hits) > 0").groupBy("body", "again").agg(F.first(_spans(F.col("hits"))).alias("spans"))
    plain, body = _plain(docs, text)
    pieces = F.filter(F.regexp_extract_all(body, F.lit(f"{CASED_WORD}+{CASED_GAP}*"), F.lit(0)), lambda p, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    cut = F.concat(F.regexp_extract(body, f"^{CASED_GAP}*", 0), F.array_join(pieces, ""))
    joined = docs.toDF(*plain).join(hit, (F.xxhash64(body) == F.col("body")) & (F.hash(body) == F.col("again")), "left")
    return joined.withColumn(plain[docs.columns.index(text)], F.when(F.col("spans").isNotNull(), cut).otherwise(body)).select(*plain).toDF(*docs.columns)


def _plain(docs: DataFrame, text: str) -> tuple[list[str], Column]:
    """Names for the columns of `docs` that no computed one has, and the text's column under them."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    return plain, F.col(plain[docs.columns.index(text)]).cast("string")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Hits of the benchmark's 10-word windows in all whole documents."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents
), b AS (
  SELECT item_id, ws, least(10, len(ws)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark WHERE text IS NOT NULL)
  WHERE len(ws) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT item_id, n, ws, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM b)
), lengths AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, lengths WHERE len(ws) >= n)
), hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n
), covered AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
