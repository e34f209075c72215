"""Benchmark decontamination: a prefix-filtered join of item windows with documents, verified word by word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.shared import ready, staged, table
from skein.llm.textvec import ALNUM, Words, columns, rows_of

WINDOW, SHINGLE = 10, 5
#: Words of items that are broadcast at once; a larger benchmark is joined in so many blocks.
BLOCK_WORDS = 500_000


class Windows:
    """The windows of some items in arrays: distinct word sequences, the items that hold each, and where each first stands among all words."""

    def __init__(self, ids: list[int], texts: list[str | None], window: int, shingle: int) -> None:
        data, at = columns(pa.array([t or "" for t in texts], pa.large_string()))
        self.words = words = Words(data, at, ALNUM)
        n = np.diff(words.bounds)
        size = np.minimum(n, window)
        count = np.where(size > 0, n - size + 1, 0)
        item, first = np.repeat(np.asarray(ids, np.int64), count), np.cumsum(count) - count
        start, size = np.repeat(words.bounds[:-1] - first, count) + np.arange(count.sum()), np.repeat(size, count)
        word = np.zeros((len(start), window), np.uint64)
        for j in range(window):
            some = np.flatnonzero(size > j)
            word[some, j] = words.hash[start[some] + j]
        order = np.lexsort((item, *word.T[::-1], size))
        word, size, item, start = word[order], size[order], item[order], start[order]
        new = np.ones(len(start), bool)
        new[1:] = (size[1:] != size[:-1]) | (word[1:] != word[:-1]).any(1)
        self.word, self.size, self.start = word[new], size[new], start[new]
        self.width = np.minimum(self.size, shingle)
        # The items of window k are item[held[k]:held[k + 1]], each once.
        once = new.copy()
        once[1:] |= item[1:] != item[:-1]
        group = (np.cumsum(new) - 1)[once]
        self.item, self.held = item[once], np.searchsorted(group, np.arange(len(self.size) + 1))

    def shingles(self, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows of that shingle width and size, and the hashes of each one's shingles."""
        of = np.flatnonzero((self.width == width) & (self.size == size))
        hashes, _ = self.words.shingles(width)
        return of, hashes[self.start[of][:, None] + np.arange(size - width + 1)]

    def kinds(self) -> list[tuple[int, int]]:
        return sorted({*zip(self.width.tolist(), self.size.tolist())})


def _lookup(keys: np.ndarray) -> np.ndarray:
    """A bitmap over 22 bits that most hashes outside keys miss."""
    bits = np.zeros(1 << 22, bool)
    bits[keys >> np.uint64(42)] = True
    return bits


def _matches(words: Words, width: int, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where shingles of that width stand that are among the sorted keys, and which."""
    hashes, whole = words.shingles(width)
    at = np.flatnonzero(bits[hashes >> np.uint64(42)] & whole)
    which = np.searchsorted(keys, hashes[at])
    which[which == len(keys)] = 0
    ok = keys[which] == hashes[at]
    return at[ok], which[ok]


def _counts(shared):
    schema = pa.schema([("width", pa.int64()), ("shingle", pa.int64()), ("n", pa.int64())])

    def run(batches):
        index = {w: (k, _lookup(k), np.zeros(len(k), np.int64)) for w, k in shared.value.items()}
        with np.errstate(over="ignore"):
            for _, data, at in rows_of(batches, "row", "text"):
                words = Words(data, at, ALNUM)
                for w, (keys, bits, n) in index.items():
                    n += np.bincount(_matches(words, w, keys, bits)[1], minlength=len(keys))
        for w, (keys, _, n) in index.items():
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), w)), pa.array(keys[some].view(np.int64)), pa.array(n[some])], schema=schema)

    return run


def _find(shared):
    """Of each row: its words, and the spans of words and the items of the windows that occur."""
    schema = pa.schema([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])

    def run(batches):
        index, word, size, item, held = shared.value
        index = {w: (k, _lookup(k), *rest) for w, (k, *rest) in index.items()}
        with np.errstate(over="ignore"):
            for batch, data, at in rows_of(batches, "row", "text"):
                words = Words(data, at, ALNUM)
                n_rows, n = len(batch), len(words.start)
                row = np.repeat(np.arange(n_rows), np.diff(words.bounds))
                places, windows = [], []
                for w, (keys, bits, first, of, offset) in index.items():
                    pos, key = _matches(words, w, keys, bits)
                    reps = first[key + 1] - first[key]
                    slot = np.repeat(first[key] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum()) if len(key) else np.zeros(0, np.int64)
                    begin, k = np.repeat(pos, reps) - offset[slot], of[slot]
                    # Length and position: the window must lie in the row that the shingle stands in.
                    r = row[np.repeat(pos, reps)]
                    inside = (begin >= words.bounds[r]) & (begin + size[k] <= words.bounds[r + 1])
                    begin, k = begin[inside], k[inside]
                    for j in range(word.shape[1]):
                        ok = (j >= size[k]) | (words.hash[np.minimum(begin + j, n - 1)] == word[k, j])
                        begin, k = begin[ok], k[ok]
                    places.append(begin)
                    windows.append(k)
                begin, k = np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *windows])
                starts, ends, ids = [[] for _ in range(n_rows)], [[] for _ in range(n_rows)], [[] for _ in range(n_rows)]
                if len(begin):
                    order = np.argsort(begin, kind="stable")
                    begin, k = begin[order], k[order]
                    r = row[begin]
                    for hit in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(r)) + 1):
                        i = int(r[hit[0]])
                        b, e = begin[hit] - words.bounds[i], begin[hit] - words.bounds[i] + size[k[hit]]
                        reach = np.maximum.accumulate(e)
                        new = np.concatenate([[True], b[1:] > reach[:-1]])
                        starts[i], ends[i] = b[new].tolist(), reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(b) - 1]])].tolist()
                        ids[i] = np.unique(np.concatenate([item[held[j] : held[j + 1]] for j in np.unique(k[hit])])).tolist()
                out = pa.RecordBatch.from_arrays([pa.array(np.diff(words.bounds).astype(np.int64)), *(pa.array(x, pa.list_(pa.int64())) for x in (starts, ends, ids))], schema=schema)
                yield out.append_column("row", batch.column("row"))

    return run


def _rarest(windows: Windows, counts: dict[int, tuple]) -> dict:
    """For each shingle width: the sorted prefix shingles, and the windows and offsets of each.

    A window occurs only where all of its shingles do, so a prefix of one shingle is enough: the rarest by its
    count in all documents, ties by hash. A window of which some shingle occurs nowhere is left out.
    """
    by: dict[int, list] = {}
    for width, size in windows.kinds():
        of, hashes = windows.shingles(width, size)
        keys, n = counts[width]
        count = n[np.searchsorted(keys, hashes)]
        least = count.min(1)
        at = np.where(count == least[:, None], hashes, ~np.uint64(0)).argmin(1)
        some = least > 0
        by.setdefault(width, []).append((hashes[some, at[some]], of[some], at[some]))
    out = {}
    for width, parts in by.items():
        least, of, at = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(least, kind="stable")
        keys, first = np.unique(least[order], return_index=True)
        out[width] = (keys, np.append(first, len(order)).astype(np.int64), of[order], at[order])
    return out


def _blocks(items: DataFrame, words: int):
    """Items by id, in lists of bounded size; only one list is on the driver at a time."""
    ids, texts, size = [], [], 0
    for r in items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1] or "") // 2 + 1
        if size >= words:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _shared_windows(rows: DataFrame, ids: list, texts: list, window: int, shingle: int):
    """A broadcast of one block's windows by their rarest shingles, which one pass over all rows counts."""
    spark = rows.sparkSession
    with np.errstate(over="ignore"):
        windows = Windows(ids, texts, window, shingle)
        keys: dict[int, np.ndarray] = {}
        for width, size in windows.kinds():
            keys[width] = np.union1d(keys.get(width, np.zeros(0, np.uint64)), windows.shingles(width, size)[1])
        if not keys:
            return None
        wanted = spark.sparkContext.broadcast(keys)
        counted = rows.mapInArrow(_counts(wanted), "width long, shingle long, n long").groupBy("width", "shingle").agg(F.sum("n").alias("n"))
        # At most as many rows as the block has shingles.
        got = counted.toArrow()
        wanted.destroy()
        width_, shingle_, n_ = (got.column(c).to_numpy() for c in ("width", "shingle", "n"))
        counts = {}
        for width, known in keys.items():
            mine, n = width_ == width, np.zeros(len(known), np.int64)
            n[np.searchsorted(known, shingle_[mine].astype(np.int64).view(np.uint64))] = n_[mine]
            counts[width] = (known, n)
        return spark.sparkContext.broadcast((_rarest(windows, counts), windows.word, windows.size, windows.item, windows.held))


def _spans(rows: DataFrame, items: DataFrame, window: int, shingle: int, block_words: int) -> DataFrame:
    """n_words, starts, ends and items of each row of rows, whose column row is a struct with the field text, and that column."""
    ready(rows.sparkSession)
    numbers = T.ArrayType(T.LongType())
    spans = T.StructType().add("n_words", "long").add("starts", numbers).add("ends", numbers).add("items", numbers)
    kind = lambda df: T.StructType([*spans, df.schema["row"]])
    blocks = _blocks(items, block_words)
    block, following = next(blocks, ([], [])), next(blocks, None)
    none = rows.sparkSession.sparkContext.broadcast(({}, np.zeros((0, window), np.uint64), *(np.zeros(0, np.int64) for _ in range(3))))
    if following is None:
        return rows.mapInArrow(_find(_shared_windows(rows, *block, window, shingle) or none), kind(rows))
    # Rows are written once with a number, by which the blocks' results meet.
    fixed = staged(rows.select(F.struct(F.monotonically_increasing_id().alias("id"), F.col("row.text").alias("text")).alias("row"), F.col("row").alias("whole")), "rows")
    found = None
    while block is not None:
        part = _shared_windows(fixed.select("row"), *block, window, shingle)
        some = staged(fixed.select("row").mapInArrow(_find(part or none), kind(fixed)).where(F.lit(found is None) | (F.size("starts") > 0)).select("row.id", "n_words", "starts", "ends", "items"), "found")
        if part:
            part.destroy()
        found = some if found is None else found.unionByName(some)
        block, following = following, next(blocks, None)
    merged = found.groupBy("id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    empty = F.array().cast("array<struct<starts:bigint,ends:bigint>>")
    joined = F.aggregate("spans", empty, lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["ends"] >= s["starts"]), F.concat(
        F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["starts"].alias("starts"), F.greatest(F.element_at(acc, -1)["ends"], s["ends"]).alias("ends"))))).otherwise(F.concat(acc, F.array(s))))
    merged = merged.withColumn("spans", joined).select("id", "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items")
    return merged.join(fixed.select(F.col("row.id").alias("id"), F.col("whole").alias("row")), "id").drop("id")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, starts, ends and items of each row of docs (doc_id, text): the merged spans of words that windows of items cover.

    A window is `window` consecutive words of an item (item_id, text), or a shorter item whole. One pass over all
    documents counts the items' shingles; each window's rarest one is its prefix, which a second pass
    looks up, then bounds by position and length, then verifies word by word. Items are broadcast in blocks of
    bounded size, so a benchmark of any size is joined whole; the spans of several blocks are merged by row.
    Null and empty texts have no words; items without words or id take no part. Repeated rows and ids
    stay rows of their own; other columns are ignored.
    """
    rows = docs.select(F.struct("doc_id", "text").alias("row"))
    return _spans(rows, items, window, shingle, block_words).select("row.doc_id", "n_words", "starts", "ends", "items")


def digest(found: DataFrame) -> DataFrame:
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


def uncontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, with all their columns of whatever names, in which no window of an item occurs; null and empty texts stay."""
    rows = docs.select(F.struct("*").alias("row"))
    return _spans(rows, items, window, shingle, block_words).where(F.size("starts") == 0).select("row.*")


def op10_contamination(spark, sf_dir: str) -> DataFrame:
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item_id, least(10, len(ws)) AS size, unnest(list_transform(range(1, greatest(0, len(ws) - least(10, len(ws)) + 1) + 1), lambda i: array_to_string(ws[i:i + least(10, len(ws)) - 1], ' '))) AS win FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS i, ws FROM w, sizes WHERE len(ws) >= size),
h AS (SELECT doc_id, dw.i, dw.size, item_id FROM dw JOIN bw ON dw.size = bw.size AND array_to_string(ws[i:i + dw.size - 1], ' ') = win),
n AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
