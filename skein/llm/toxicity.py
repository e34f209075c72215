"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy, with thresholds by language."""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.shared import bitmap, drop, marked, ready, staged, table
from skein.llm.textvec import ALNUM, Words, columns, rows_of

#: Share of the labelled rows that thresholds are calibrated on, and the score that a threshold becomes.
CALIBRATE, AT = 0.3, 0.7
#: Rows of a shard, which one task learns from in an epoch, until there are so many shards; then shards grow.
SHARD, SHARDS = 2048, 8
#: Rows and words at most that make a step, or one text; rows of the embedding that are averaged at once; bins of a logit's unit.
STEP, STEP_WORDS, BLOCK, BINS = 64, 1 << 18, 1024, 1024
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 20, 16, (1, 2, 3), 8
#: Bytes of a word that its second feature hashes, so that endings don't hide a stem.
STEM = 5
#: Function words that tell a text's language by its words alone.
LANGUAGES = {
    "en": "the and of to in is that it was for with on are this",
    "de": "der die und das den ist nicht ein eine mit von zu auf für",
    "fr": "le la les et des est une dans que pour pas qui sur au",
    "es": "el los las y del que una por con para no se su como",
}


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its stem; bucket 0 is no bucket of a word."""
    n = np.uint64(BUCKETS - 1)
    return (words.hash % n + np.uint64(1)).astype(np.int32), ((words.prefix_hashes(STEM) ^ np.uint64(0x5BD1E995)) % n + np.uint64(1)).astype(np.int32)


def _language_hashes() -> list[np.ndarray]:
    out = []
    for line in LANGUAGES.values():
        data, at = columns(pa.array([line]))
        out.append(np.sort(Words(data, at, ALNUM).hash))
    return out


def languages(words: Words) -> np.ndarray:
    """Of each row the language whose function words it has most of; one more than the last where it has none."""
    votes = []
    for known in _language_hashes():
        at = np.searchsorted(known, words.hash)
        at[at == len(known)] = 0
        hits = np.concatenate([[0], np.cumsum(known[at] == words.hash)])
        votes.append(hits[words.bounds[1:]] - hits[words.bounds[:-1]])
    votes = np.stack(votes)
    return np.where(votes.max(0) > 0, votes.argmax(0), len(LANGUAGES))


def _featurise(batches):
    schema = pa.schema([("toxic", pa.int64()), ("mark", pa.string()), ("language", pa.int64()), ("words", pa.binary()), ("stems", pa.binary())])
    with np.errstate(over="ignore"):
        for batch, data, at in rows_of(batches, "text"):
            words = Words(data, at, ALNUM)
            a, p = features(words)
            cut = [slice(i, j) for i, j in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("mark"), pa.array(languages(words)), pa.array([a[c].tobytes() for c in cut], pa.binary()), pa.array([p[c].tobytes() for c in cut], pa.binary())], schema=schema)


class Model:
    """Word and stem embeddings, filters of several widths, max pooling and a logistic output."""

    def __init__(self, seen: np.ndarray, odds: np.ndarray, rng: np.random.Generator) -> None:
        self.row = np.zeros(BUCKETS, np.int32)  # bucket to embedding; 0 for buckets that training hardly saw
        self.row[seen] = np.arange(1, len(seen) + 1)
        self.embedding = rng.standard_normal((len(seen) + 1, SIZE), np.float32) * np.float32(0.05)
        self.embedding[0] = 0
        self.embedding[1:, 0] = odds
        self.filter = {w: rng.normal(0, 0.2, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}
        for f in self.filter.values():
            f[:, 0, : FILTERS // 2] += 0.5
        self.shift = {w: np.full(FILTERS, -0.5, np.float32) for w in WIDTHS}
        self.out = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.bias = np.float32(-2)
        self.threshold = np.zeros(len(LANGUAGES) + 1)

    def _conv(self, each: dict, bounds: np.ndarray, n: int) -> dict:
        """Each width's filters at each word: words past a row's end count as none. each: [offset] of what a word adds there."""
        left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
        out = {}
        for w in WIDTHS:
            z = each[w][0] + self.shift[w]
            for j in range(1, w):
                z[: n - j] += each[w][j][j:] * (left[: n - j] > j)[:, None]
            out[w] = z
        return out

    def pooled(self, z: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The largest value of each filter in each row, at least 0; rows without words have 0."""
        out = np.zeros((len(bounds) - 1, z.shape[1]), np.float32)
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            out[full] = np.maximum(np.maximum.reduceat(z, bounds[full], axis=0), 0)
        return out

    def step(self, a: np.ndarray, p: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray, adam: Adam) -> float:
        ra, rp = self.row[a], self.row[p]
        x = self.embedding[ra] + self.embedding[rp]
        z = self._conv({w: [x @ self.filter[w][j] for j in range(w)] for w in WIDTHS}, bounds, len(a))
        h = np.concatenate([self.pooled(z[w], bounds) for w in WIDTHS], 1)
        prob = 1 / (1 + np.exp(-(h @ self.out + self.bias)))
        g = (weight * (prob - y) / weight.sum()).astype(np.float32)
        rows, grads = [], []
        gh = g[:, None] * self.out
        updates = {"out": h.T @ g, "bias": g.sum()}
        for k, w in enumerate(WIDTHS):
            top = h[:, k * FILTERS : (k + 1) * FILTERS]
            gz = gh[:, k * FILTERS : (k + 1) * FILTERS] * (top > 0)
            doc = np.repeat(np.arange(len(y)), np.diff(bounds))
            at, f = np.nonzero((z[w] == top[doc]) & (gz[doc] != 0))
            _, once = np.unique(doc[at] * FILTERS + f, return_index=True)
            at, f = at[once], f[once]
            d = gz[doc[at], f]
            gf = np.zeros_like(self.filter[w])
            for j in range(w):
                ok = at + j < bounds[1:][doc[at]]
                i, fj, dj = at[ok] + j, f[ok], d[ok]
                np.add.at(gf[j].T, fj, dj[:, None] * x[i])
                gx = dj[:, None] * self.filter[w][j][:, fj].T
                rows += [ra[i], rp[i]]
                grads += [gx, gx]
            updates[f"filter{w}"] = gf
            updates[f"shift{w}"] = np.bincount(f, d, FILTERS).astype(np.float32)
        adam.dense(self, updates)
        adam.sparse(self.embedding, np.concatenate(rows), np.concatenate(grads))
        return float(-np.mean(weight * np.log(np.where(y > 0, prob, 1 - prob) + 1e-9)))

    def ready(self) -> dict:
        """What scoring needs: what each embedding adds to each filter at each offset."""
        return {"row": self.row, "add": np.concatenate([self.embedding @ self.filter[w][j] for w in WIDTHS for j in range(w)], 1), "shift": self.shift, "out": self.out, "bias": self.bias, "threshold": self.threshold}


class Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.m, self.v = rate, {}, {}

    def dense(self, model: Model, grads: dict) -> None:
        for key, g in grads.items():
            m, v = self.m.setdefault(key, np.zeros_like(g, dtype=np.float32) + 0), self.v.setdefault(key, np.zeros_like(g, dtype=np.float32) + 1e-8)
            m = m + 0.1 * (g - m)
            v = v + 0.01 * (g * g - v)
            self.m[key], self.v[key] = m, v
            by = (self.rate * m / (np.sqrt(v) + 1e-6)).astype(np.float32)
            if key.startswith("filter"):
                model.filter[int(key[6:])] -= by
            elif key.startswith("shift"):
                model.shift[int(key[5:])] -= by
            else:
                setattr(model, key, getattr(model, key) - by)

    def sparse(self, embedding: np.ndarray, rows: np.ndarray, grads: np.ndarray) -> None:
        some, back = np.unique(rows, return_inverse=True)
        g = np.zeros((len(some), grads.shape[1]), np.float32)
        np.add.at(g, back, grads)
        v = self.v.setdefault("embedding", np.full(len(embedding), 1e-8, np.float32))
        v[some] += (g * g).mean(1)
        g *= (self.rate / (np.sqrt(v[some]) + 1e-6))[:, None]
        g[some == 0] = 0
        embedding[some] -= g


def _logits(model: dict, a: np.ndarray, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(a)
    add = model["add"][model["row"][a]]
    add += model["add"][model["row"][p]]
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    full = np.flatnonzero(np.diff(bounds))
    logit = np.full(len(bounds) - 1, model["bias"], np.float64)
    at = 0
    for k, w in enumerate(WIDTHS):
        z = add[:, at : at + FILTERS] + model["shift"][w]
        for j in range(1, w):
            z[: n - j] += add[j:, at + j * FILTERS : at + (j + 1) * FILTERS] * (left[: n - j] > j)[:, None]
        at += w * FILTERS
        if len(full):
            logit[full] += np.maximum(np.maximum.reduceat(z, bounds[full], axis=0), 0) @ model["out"][k * FILTERS : (k + 1) * FILTERS]
    return logit


def _thresholds(logit: np.ndarray, language: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each language the threshold with the fewest errors on the calibration rows, shrunk to that of all rows where these are few. n: how many rows each stands for."""

    def best(x: np.ndarray, t: np.ndarray, n: np.ndarray) -> float:
        x, back = np.unique(x, return_inverse=True)
        wrong = np.concatenate([[0], np.cumsum(np.bincount(back, t * n))]) + ((1 - t) @ n - np.concatenate([[0], np.cumsum(np.bincount(back, (1 - t) * n))]))
        least = np.flatnonzero(wrong == wrong.min())
        cut = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
        return float(cut[least[len(least) // 2]])

    if not 0 < y @ n < n.sum():
        return np.zeros(len(LANGUAGES) + 1)
    every = best(logit, y, n)
    out = np.full(len(LANGUAGES) + 1, every)
    for k in range(len(out)):
        mine = language == k
        if y[mine] @ n[mine] >= 5 and (1 - y[mine]) @ n[mine] >= 5:
            trust = n[mine].sum() / (n[mine].sum() + 50)
            out[k] = trust * best(logit[mine], y[mine], n[mine]) + (1 - trust) * every
    return out


#: What is averaged besides embeddings, and its optimiser's state.
_DENSE = ["out", "bias", *(f"{x}{w}" for w in WIDTHS for x in ("filter", "shift"))]


def _dense(model: Model, adam: Adam, new: np.ndarray | None = None) -> np.ndarray:
    """All of _DENSE with its state, one after another; new is put in its place."""
    out, at = [], 0
    for key in _DENSE:
        kind, w = key.rstrip("0123456789"), int(key[-1]) if key[-1].isdigit() else None
        value = getattr(model, kind) if w is None else getattr(model, kind)[w]
        parts = [value, adam.m.get(key, np.zeros_like(value)), adam.v.get(key, np.full_like(value, 1e-8))]
        out += [np.ravel(x) for x in parts]
        if new is not None:
            value, adam.m[key], adam.v[key] = (new[at + k * value.size : at + (k + 1) * value.size].reshape(value.shape).copy() for k in range(3))
            if w is None:
                setattr(model, kind, value)
            else:
                getattr(model, kind)[w] = value
            at += 3 * value.size
    return np.concatenate(out).astype(np.float32)


def _count(batches):
    """Texts of each label that hold each bucket."""
    count = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for a, p, t in zip(batch.column("words"), batch.column("stems"), batch.column("toxic").to_pylist()):
            count[t][np.union1d(np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(p.as_buffer(), np.int32))] += 1
    some = np.flatnonzero(count.any(0))
    for i in range(0, len(some), 10_000):
        at = some[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[0][at]), pa.array(count[1][at])], ["bucket", "n0", "n1"])


def _steps(batches):
    """(shard, words, stems, bounds, labels) of each step, of rows in the order of shards."""
    shard, rows, size = None, [], 0

    def step():
        return shard, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]), np.array([r[2] for r in rows], np.float32)

    for batch in batches:
        for s, a, p, t in zip(batch.column("shard").to_pylist(), batch.column("words"), batch.column("stems"), batch.column("toxic").to_pylist()):
            a, p = np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(p.as_buffer(), np.int32)
            if rows and (s != shard or len(rows) == STEP or size + len(a) > STEP_WORDS):
                yield step()
                rows, size = [], 0
            shard, size = s, size + len(a)
            rows.append((a, p, t))
    if rows:
        yield step()


def _learn(shared):
    """One epoch over each shard, from the shared model; gives the shard's model in blocks, of its embeddings those that changed."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])

    def given(shard: int, model: Model, adam: Adam, before: np.ndarray):
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([-1], pa.int32()), pa.array([_dense(model, adam).tobytes()], pa.binary())], schema=schema)
        v = adam.v["embedding"]
        for i in range(0, len(v), BLOCK):
            b = slice(i, i + BLOCK)
            changed = v[b] != before[b]
            if changed.any():
                data = np.concatenate([changed[:, None], model.embedding[b] * changed[:, None], v[b, None] * changed[:, None]], 1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([i // BLOCK], pa.int32()), pa.array([data.tobytes()], pa.binary())], schema=schema)

    def run(batches):
        start, state, weight = shared.value
        shard, model, adam = None, None, None
        for s, a, p, bounds, y in _steps(batches):
            if s != shard:
                if shard is not None:
                    yield from given(shard, model, adam, state.v["embedding"])
                shard, model, adam = s, copy.copy(start), copy.deepcopy(state)
                model.embedding, model.filter, model.shift = start.embedding.copy(), copy.deepcopy(start.filter), copy.deepcopy(start.shift)
            model.step(a, p, bounds, y, np.where(y > 0, weight, 1.0), adam)
        if shard is not None:
            yield from given(shard, model, adam, state.v["embedding"])

    return run


def _average(group: pa.Table) -> pa.Table:
    """Of a block the mean over the shards, of embeddings over those that changed them."""
    block = group.column("block")[0].as_py()
    rows = sorted(zip(group.column("shard").to_pylist(), group.column("data").to_pylist()))
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for _, x in rows)
    if block < 0:
        total = total / len(rows)
    else:
        total = total.reshape(-1, SIZE + 2)
        total[:, 1:] /= np.maximum(total[:, :1], 1)
    return pa.table({"block": pa.array([block], pa.int32()), "data": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _binned(shared):
    """language, label and logit of each row, the logit in BINS of a unit."""

    def run(batches):
        model = shared.value
        for batch in batches:
            logit = np.zeros(len(batch))
            for i, (a, p) in enumerate(zip(batch.column("words"), batch.column("stems"))):
                a, p = np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(p.as_buffer(), np.int32)
                logit[i] = _logits(model, a, p, np.array([0, len(a)]))[0]
            yield pa.RecordBatch.from_arrays([batch.column("language"), batch.column("toxic"), pa.array(np.rint(np.clip(logit, -60, 60) * BINS).astype(np.int64))], ["language", "toxic", "bin"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample_words: int | None = None, epochs: int = 6, seed: int = 5) -> dict:
    """A model from every labelled row whose crc32(doc_id as text) mod 3 is not 1, however many there are.

    Rows are dealt by hash: CALIBRATE of them set thresholds, the others are learned from. Buckets are counted over all of these; an epoch
    is one pass of each shard from the same model, whose results are averaged. The driver holds the model and counts by bucket
    and by bin, all bounded, and no rows. sample_words, where given, bounds the words of the texts, taken in the order of a hash.
    """
    spark = docs.sparkSession
    ready(spark)
    key, eligible = F.col("doc_id").cast("long"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    rows = labels.select(key.alias("doc_id"), F.col("toxic").cast("long").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(eligible)
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))
    rows = staged(rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select("*", mark.alias("mark"), F.xxhash64("doc_id").alias("r1")), "labels")
    bits = bitmap(rows, "labelled")
    # Texts move only where a row may have a label.
    texts = marked(docs.select(key.alias("doc_id"), "text").where(eligible).withColumn("r1", F.xxhash64("doc_id")), bits).where("flag").select("doc_id", "text")
    found = every = staged(texts.join(rows.drop("r1"), "doc_id").select("text", "toxic", "mark").mapInArrow(
        _featurise, "toxic long, mark string, language long, words binary, stems binary"), "features", clean=True)
    if sample_words is not None:
        last, size = "", 0
        for r in found.groupBy("mark").agg(F.sum(F.octet_length("words") / 4).alias("n")).orderBy("mark").toLocalIterator():
            size += r["n"]
            if size > sample_words:
                break
            last = r["mark"]
        found = found.where(F.col("mark") <= last)
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "mark"), F.lit(1000)) < int(1000 * CALIBRATE)
    model = _train(found.where(~part), epochs, seed)
    counts = found.where(part).mapInArrow(_binned(shared := spark.sparkContext.broadcast(model)), "language long, toxic long, bin long").groupBy("language", "toxic", "bin").count().toArrow()
    language, y, at, n = (counts.column(c).to_numpy() for c in ("language", "toxic", "bin", "count"))
    model["threshold"] = _thresholds(at / BINS, language, y, n)
    shared.destroy()
    for x in (rows, bits, every):
        drop(x)
    return model


def _train(rows: DataFrame, epochs: int, seed: int) -> dict:
    """rows: toxic, mark, words and stems (buckets of each) of each text. Of the same rows the same model, however they are dealt."""
    context = rows.sparkSession.sparkContext
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    size = np.array([size.get(0, 0), size.get(1, 0)])
    # Texts that hold each bucket, by label: what training hardly saw has no embedding, and odds start the first coordinate.
    held = rows.select("words", "stems", "toxic").mapInArrow(_count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 3").toArrow()
    seen, n0, n1 = (held.column(c).to_numpy() for c in ("bucket", "n0", "n1"))
    order = np.argsort(seen)
    odds = (np.log((n1 + 0.1) / (size[1] + 1.0)) - np.log((n0 + 0.1) / (size[0] + 1.0)))[order]
    model = Model(seen[order], np.clip(odds, -3, 3) / 3, np.random.default_rng(seed))
    weight, adam = float(np.sqrt((size[0] + 1.0) / (size[1] + 1.0))), Adam(0.01)
    adam.v["embedding"] = np.full(len(model.embedding), 1e-8, np.float32)
    shards = int(max(1, min(SHARDS, -(-size.sum() // SHARD))))
    placed = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "mark"), F.lit(shards)).cast("int"))
    for epoch in range(epochs if size.all() else 0):
        shared = context.broadcast((model, adam, weight))
        dealt = placed.withColumn("turn", F.xxhash64(F.lit(epoch), "mark")).repartitionById(shards, "shard").sortWithinPartitions("shard", "turn", "mark", "toxic", "words", "stems")
        mean = dealt.select("shard", "toxic", "words", "stems").mapInArrow(_learn(shared), "shard int, block int, data binary").groupBy("block").applyInArrow(_average, "block int, data binary")
        mean = staged(mean, "mean", clean=True)
        for r in mean.toLocalIterator():
            data = np.frombuffer(r["data"], np.float32)
            if r["block"] < 0:
                _dense(model, adam, data)
            else:
                data = data.reshape(-1, SIZE + 2)
                at = r["block"] * BLOCK + np.flatnonzero(data[:, 0])
                model.embedding[at], adam.v["embedding"][at] = data[data[:, 0] > 0, 1:-1], data[data[:, 0] > 0, -1]
        shared.destroy()
        drop(mean)
    return model.ready()


def _score(shared, keep):
    def run(batches):
        model = shared.value
        with np.errstate(over="ignore"):
            for batch, data, at in rows_of(batches, "text"):
                words = Words(data, at, ALNUM)
                logit = _logits(model, *features(words), words.bounds) - model["threshold"][languages(words)] + np.log(AT / (1 - AT))
                score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                score = np.where(logit >= np.log(AT / (1 - AT)), np.maximum(score, AT), np.minimum(score, np.nextafter(AT, 0)))
                if keep:
                    yield batch.filter(pa.array(score < AT))
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score and predicted for each row of docs (doc_id, text), from the whole text alone.

    Scores are calibrated so that each guessed language's threshold is 0.7. Null and empty texts get the score of
    a text without evidence. One pass, no shuffle; memory is bounded by one text. Repeated rows and ids
    stay rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ready(docs.sparkSession)
    out = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_score(shared, False), "doc_id long, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= AT, 1).otherwise(0).cast("int"))


def clean(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs (text), with all their columns, that aren't predicted toxic, from the whole text alone.

    Null and empty texts are scored as texts without evidence; repeated rows stay or go together; an empty table stays empty.
    """
    ready(docs.sparkSession)
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), True), docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", held.alias("held_out"), "score", "predicted")
