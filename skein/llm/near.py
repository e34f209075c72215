"""Near-duplicate documents: fast similarity sketches, banding, exact verification, and components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.components import components
from skein.llm.shared import bitmap, drop, marked, ready, staged, table
from skein.llm.textvec import SPACED, Words, mix, rows_of

#: 32 bands of 5 coordinates: a pair at similarity 0.85 shares no band once in 1e8, at 0.8 once in 3e5.
BANDS, ROWS = 32, 5
#: Members of a bucket that are compared with as many others at once.
BLOCK = 64
_SEEDS = np.random.default_rng(7919).integers(1, 1 << 63, 2 * 256, dtype=np.uint64)


def sketch(x: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """t coordinates of the set x of 64-bit hashes; two sets agree in a coordinate with the probability of their similarity.

    In round i < t each element is thrown into a hashed one of t bins with a value in [i, i + 1); in round t + j every
    element goes to bin j. A bin keeps its least value, and rounds end once no bin is empty, so all are filled after
    2t rounds at the latest and after about t ln t / |x| of them as a rule. Rounds are taken several at a time
    for small sets, which changes nothing: a later round's values are larger than an earlier one's.
    """
    out = np.full(t, ~np.uint64(0))
    at, step = 0, max(1, min(2 * t, 4096 // max(1, len(x))))
    while at < 2 * t:
        r = np.arange(at, min(at + step, 2 * t), dtype=np.uint64)
        h = mix(x[None, :] ^ _SEEDS[at : at + len(r), None])
        b = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        late = int(max(0, at + len(r) - t))
        if late:
            b[len(r) - late :] = (r[len(r) - late :] - np.uint64(t))[:, None]
        np.minimum.at(out, b.ravel().astype(np.intp), ((r[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))).ravel())
        at += len(r)
        if out.max() != ~np.uint64(0):
            break
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of sketches."""
    x = coordinates.reshape(-1, BANDS, ROWS)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2]).copy()
    for j in range(ROWS):
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + x[:, :, j])
    return total


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Each row's distinct k-word shingles, sorted; of fewer words, the whole sequence is one; without words, none."""
    hashes, whole = words.shingles(k)
    out = []
    for i, j in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if j - i >= k:
            out.append(np.unique(hashes[i : j - k + 1]))
        elif j > i:
            total = np.uint64(j - i)
            for w in words.hash[i:j]:
                total = mix(np.asarray([total ^ w]))[0] + np.uint64(j - i)
            out.append(np.asarray([total]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


#: What a class of equal sets is known by.
_SET = ["h1", "h2", "n_shingles"]


def _with_key(docs: DataFrame, *more) -> DataFrame:
    """doc_id, text and two hashes (r1, r2) of both, which name a row but for its repetitions."""
    key = F.col("doc_id").cast("long")
    return docs.select(key.alias("doc_id"), "text", *(F.xxhash64(F.lit(i), key, F.col("text").cast("string")).alias(f"r{i}") for i in (1, 2)), *more)


def _hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in sets], np.int64)
    h1 = np.array([np.add.reduce(x) if len(x) else 0 for x in sets], np.uint64)
    h2 = np.array([np.bitwise_xor.reduce(mix(x + np.uint64(1))) if len(x) else 0 for x in sets], np.uint64)
    return mix(h1).view(np.int64), h2.view(np.int64), n


def _sketches(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        with np.errstate(over="ignore"):
            for batch, data, at in rows_of(batches, "text"):
                sets = shingle_sets(Words(data, at, SPACED), k)
                h1, h2, n = _hashes(sets)
                full = [sketch(x) for x in sets if len(x)]
                keys = band_keys(np.stack(full)) if full else np.zeros((0, BANDS), np.uint64)
                offsets = np.zeros(len(sets) + 1, np.int32)
                np.cumsum((n > 0) * BANDS, out=offsets[1:])
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c) for c in ("doc_id", "r1", "r2", "id")), pa.array(h1), pa.array(h2), pa.array(n),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))], schema=schema)

    return run


def _sets(k: int):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n_shingles", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        # A repeated set is given once by each task, as far as a bounded memory tells.
        once: set[tuple] = set()
        with np.errstate(over="ignore"):
            for _, data, at in rows_of(batches, "text"):
                sets = shingle_sets(Words(data, at, SPACED), k)
                if len(once) > 100_000:
                    once.clear()
                names = list(zip(*(x.tolist() for x in _hashes(sets))))
                new = [(*name, x.tobytes()) for name, x in zip(names, sets) if len(x) and not (name in once or once.add(name))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in new], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, for sorted sets."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    if n > m:
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (n + m - both)


def _verify_pairs(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            x, y = batch.column("sa"), batch.column("sb")
            ok = [similar(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), percent) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(ok, pa.bool_()))

    return run


def _verify_blocks(percent: int):
    """Links between the members of two blocks of one bucket that no earlier band compares and no found link joins yet."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            got = batch.to_pydict()
            links = []
            for bucket, same, left, right in zip(got["bucket"], got["same"], got["left"], got["right"]):
                find = {}

                def root(v):
                    while find.get(v, v) != v:
                        v = find[v]
                    return v

                rb = [(m["rep"], m["label"], np.array(m["bands"], np.int64), np.frombuffer(m["shingles"], np.uint64)) for m in right]
                if not rb:
                    continue
                bands, labels, sizes = np.stack([m[2] for m in rb]), np.array([m[1] for m in rb]), np.array([len(m[3]) for m in rb])
                for i, m in enumerate(left):
                    x, mine = np.frombuffer(m["shingles"], np.uint64), np.array(m["bands"], np.int64)
                    first = bands[np.arange(len(bands)), (bands == mine).argmax(1)] == bucket
                    lengths = 100 * np.minimum(sizes, len(x)) >= percent * np.maximum(sizes, len(x))
                    todo = first & lengths & (labels != m["label"])
                    if same:
                        todo[: i + 1] = False
                    for j in np.flatnonzero(todo).tolist():
                        u, v = root(m["label"]), root(rb[j][1])
                        if u != v and similar(x, rb[j][3], percent):
                            find[max(u, v)] = min(u, v)
                            links.append((m["rep"], rb[j][0]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], schema=schema)

    return run


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Every row's doc_id, r1, r2, n_shingles and winner (doc_id, r1, r2): the row that stands for its component, null without shingles."""
    ready(docs.sparkSession)
    docs = _with_key(docs)
    rows = staged(docs.select("*", F.monotonically_increasing_id().alias("id")).mapInArrow(
        _sketches(k), "doc_id long, r1 long, r2 long, id long, h1 long, h2 long, n_shingles long, bands array<long>"), "sketches")
    some = rows.where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")).alias("first")
    classes = staged(some.groupBy(*_SET).agg(F.min("id").alias("rep"), first), "classes")
    reps = staged(some.join(classes.select("rep"), F.col("id") == F.col("rep")).select("rep", "bands"), "reps")
    buckets = reps.select("rep", F.explode("bands").alias("bucket"))
    # Written before they are joined, so that Spark can split the rows of a bucket that many share.
    shared = staged(buckets.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("bucket", "leader"), "shared")
    full = staged(buckets.join(shared, "bucket").select("rep", "bucket", "leader"), "buckets", clean=True)
    nodes = staged(classes.join(full.select("rep").distinct(), "rep", "semi").select(*_SET, "rep", F.col("first.r1").alias("r1")), "nodes")
    bits = bitmap(nodes, "candidates")
    # Texts move only where a row may be the first of a class that shares a bucket.
    texts = marked(docs.select("text", "r1"), bits).where("flag").select("text")
    sets = texts.mapInArrow(_sets(k), "h1 long, h2 long, n_shingles long, shingles binary").groupBy(*_SET).agg(F.first("shingles").alias("shingles"))
    sets = staged(sets.join(nodes.drop("r1"), _SET).select("rep", "n_shingles", "shingles"), "sets", clean=True)
    light = sets.select("rep", "shingles")
    stars = full.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stars.join(light.toDF("a", "sa"), "a").join(light.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    links = staged(stars.mapInArrow(_verify_pairs(percent), "a long, b long"), "stars", clean=True)
    labels = components(links)
    rest = _residual(full, labels, sets, reps, percent)
    if rest is not None and not rest.isEmpty():
        labels = components(links.union(rest))
    for x in (reps, shared, full, nodes, bits, sets, links):
        drop(x)
    # Written before they are joined, so that Spark can split the classes of a component that many are in.
    named = staged(classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").drop("rep"), "named")
    linked = named.where("label is not null")
    least = staged(linked.groupBy("label").agg(F.min("first").alias("winner")), "least")
    winner = linked.join(least, "label").select(*_SET, "winner").union(named.where("label is null").select(*_SET, F.col("first").alias("winner")))
    for x in (classes, labels):
        drop(x)
    return rows.drop("bands", "id").join(winner, _SET, "left").select("doc_id", "r1", "r2", "n_shingles", "winner")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text); other columns are ignored.

    Documents whose k-word shingle sets have similarity of percent / 100 or more are linked; component_id is the smallest
    doc_id reachable. Rows with equal sets are one class, whatever their ids; classes that share a band are
    verified on full sets, first each against the smallest of its bucket; then, in buckets that still hold
    different components, block against block, so that no link between components is lost and no pair is emitted
    but found links. Null and empty texts have no shingles, and are components of their own. Repeated rows are kept
    as rows, and unlike texts of one doc_id are nodes of their own. In a component without any id component_id is null, and its rows are kept.
    """
    out = _grouped(docs, k, percent).select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("winner.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _residual(full: DataFrame, labels: DataFrame, sets: DataFrame, reps: DataFrame, percent: int) -> DataFrame | None:
    """Links between members of one bucket whose components are still different, found block against block; the leaders have met all.

    Blocks hold about BLOCK members of one size class (a power of two of shingles), or fewer of large sets, and as far as
    may be of one component, so that blocks of only one need no comparing. Each pair of blocks is a row, which any task may take.
    """
    light = staged(full.where("rep <> leader").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "bucket", F.coalesce("label", "rep").alias("label")), "labelled")
    mixed = staged(light.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket"), "mixed")
    if mixed.isEmpty():
        return None
    power = F.floor(F.log2("n_shingles")).cast("int").alias("power")
    light = staged(light.join(mixed, "bucket").join(sets.select("rep", power), "rep"), "members")
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK * 8192) / F.pow(F.lit(2.0), F.col("power") + 1)))).cast("long")
    count = staged(light.groupBy("bucket", "power", "label").agg(F.count("*").alias("n")), "counts").withColumn("room", room)
    small = count.where("n < room").groupBy("bucket", "power").agg(F.sum("n").alias("few"))
    count = staged(count.join(small, ["bucket", "power"], "left"), "rooms")
    parts = lambda n: F.ceil(F.col(n) / F.col("room"))
    large = F.xxhash64(F.lit("large"), "label", F.pmod(F.xxhash64("rep"), parts("n")))
    block = F.when(F.col("n") >= F.col("room"), large).otherwise(F.xxhash64(F.lit("small"), F.pmod(F.xxhash64("label"), parts("few"))))
    placed = staged(light.join(count, ["bucket", "power", "label"]).select("rep", "bucket", "power", "label", block.alias("block")), "placed")
    need = placed.select("rep").distinct()
    whole = sets.join(need, "rep", "semi").join(reps, "rep").select("rep", "bands", "shingles")
    by = ["bucket", "power", "block"]
    blocked = staged(placed.join(whole, "rep").groupBy(*by).agg(
        F.collect_list(F.struct("rep", "label", "bands", "shingles")).alias("rows"), F.min("label").alias("lo"), F.max("label").alias("hi")), "blocks")
    a, b = blocked.select(*by, "lo", "hi").toDF("bucket", "pa", "i", "lo", "hi"), blocked.select(*by, "lo", "hi").toDF("bucket", "pb", "j", "lo2", "hi2")
    # Sets whose sizes are further apart can't be similar enough.
    gap = max(1, math.ceil(math.log2(100 / percent)))
    met = ((F.col("pa") == F.col("pb")) & (F.col("i") <= F.col("j"))) | ((F.col("pa") < F.col("pb")) & (F.col("pb") <= F.col("pa") + gap))
    pairs = staged(a.join(b, "bucket").where(met).where("not (lo = hi and lo2 = hi2 and lo = lo2)").select("bucket", "pa", "i", "pb", "j"), "pairs")
    both = pairs.join(blocked.select(*by, F.col("rows").alias("left")).toDF("bucket", "pa", "i", "left"), ["bucket", "pa", "i"])
    both = both.join(blocked.select(*by, "rows").toDF("bucket", "pb", "j", "right"), ["bucket", "pb", "j"])
    same = ((F.col("pa") == F.col("pb")) & (F.col("i") == F.col("j"))).alias("same")
    found = staged(both.select("bucket", same, "left", "right").mapInArrow(_verify_blocks(percent), "a long, b long").distinct(), "rest")
    for x in (blocked, pairs, placed, count, light, mixed):
        drop(x)
    return found


def without_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs, with all its columns, of each group of near-duplicates; rows without words are in no group and all stay.

    The row that stays is that of the smallest doc_id, null last, and of several texts of that id the one of least hash; of rows that
    are equal in id and text any one. Rows that a bounded bitmap shows to be sure to stay aren't moved; only the others are
    shuffled with their texts, by a hash of id and text. docs is read twice, and may be in another order the second time.
    """
    light = _grouped(docs, k, percent).where("n_shingles > 0")
    own = (F.col("r1") == F.col("winner.r1")) & (F.col("r2") == F.col("winner.r2"))
    light = staged(light.select("r1", "r2", own.alias("own")).groupBy("r1", "r2", "own").agg(F.count("*").alias("n")).where("not own or n > 1").select("r1", "r2", "own"), "judged")
    rows = marked(_with_key(docs, F.struct("*").alias("row")).select("r1", "r2", "row"), bitmap(light, "moving"))
    moved = rows.where("flag").join(light, ["r1", "r2"], "left").where("own is null or own")
    alone = F.when(F.col("own").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    once = moved.select("r1", "r2", "row", alone.alias("alone")).dropDuplicates(["r1", "r2", "alone"])
    return rows.where("not flag").select("row.*").union(once.select("row.*"))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)),
d AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
