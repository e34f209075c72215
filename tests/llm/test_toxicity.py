import copy
import zlib

import numpy as np
import pyarrow as pa

from skein.llm import toxicity
from skein.llm.textvec import ALNUM, Words, columns


def model(rng):
    m = toxicity.Model(np.arange(1, 400), rng.normal(0, 1, 399), rng)
    m.row = rng.integers(0, 400, toxicity.BUCKETS).astype(np.int32)
    return m


def batch(rng, sizes=(5, 1, 0, 9, 2)):
    n = sum(sizes)
    return rng.integers(1, toxicity.BUCKETS, n).astype(np.int32), rng.integers(1, toxicity.BUCKETS, n).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])


def by_loop(m, a, p, bounds):
    """Each text's logit, word by word and filter by filter."""
    out = []
    for i, j in zip(bounds[:-1], bounds[1:]):
        x = [m.embedding[m.row[u]] + m.embedding[m.row[v]] for u, v in zip(a[i:j], p[i:j])]
        pooled = []
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                values = [sum(x[k + o] @ m.filter[w][o][:, f] for o in range(w) if k + o < len(x)) + m.shift[w][f] for k in range(len(x))]
                pooled.append(max([0.0, *values]))
        out.append(np.dot(pooled, m.out) + m.bias)
    return np.array(out)


def test_scores_equal_a_loop_over_words():
    rng = np.random.default_rng(3)
    m = model(rng)
    a, p, bounds = batch(rng)
    assert np.allclose(toxicity._logits(m.ready(), a, p, bounds), by_loop(m, a, p, bounds), atol=1e-4)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(4)
    m = model(rng)
    a, p, bounds = batch(rng, (6, 3, 8))
    y, weight = np.array([1.0, 0.0, 1.0], np.float32), np.array([2.0, 1.0, 1.0])
    seen = {}

    class Record:
        def dense(self, _, updates):
            seen.update(updates)

        def sparse(self, _, rows, grads):
            seen["embedding"] = np.zeros(m.embedding.shape)
            np.add.at(seen["embedding"], rows, grads)

    def loss():
        prob = 1 / (1 + np.exp(-by_loop(fine, a, p, bounds)))
        return -np.sum(weight * np.log(np.where(y > 0, prob, 1 - prob))) / weight.sum()

    fine = copy.deepcopy(m)
    fine.embedding, fine.out = m.embedding.astype(np.float64), m.out.astype(np.float64)
    fine.filter = {w: f.astype(np.float64) for w, f in m.filter.items()}
    m.step(a, p, bounds, y, weight, Record())
    for name, array in [("out", fine.out), ("embedding", fine.embedding), *((f"filter{w}", fine.filter[w]) for w in toxicity.WIDTHS)]:
        for k in np.argsort(-np.abs(seen[name]).ravel())[:3]:
            at = np.unravel_index(k, array.shape)
            old, step = array[at], 1e-4
            array[at] = old + step
            up = loss()
            array[at] = old - step
            down = loss()
            array[at] = old
            assert abs((up - down) / (2 * step) - seen[name][at]) < 2e-3 * max(1.0, abs(seen[name][at])), name


def test_languages_by_function_words_and_none():
    data, at = columns(pa.array(["the cat and the dog", "der Hund und die Katze", "xyz", "", "le chat est dans la"]))
    assert toxicity.languages(Words(data, at, ALNUM)).tolist() == [0, 1, 4, 4, 2]


def test_long_repeated_and_clashing_rows(spark):
    rows = [(i, "good words here " * 9 + ("vile" if i % 4 == 0 else "kind"), "x", 0) for i in range(400)] + [(900, "good words " * 20_000, "x", 0), (901, None, "x", 0), (901, None, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")
    found = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int"))
    got = toxicity.score(docs, found).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 901}) == 1 and all(r.predicted == int(r.score >= toxicity.AT) for r in got)
    kept = toxicity.clean(docs, found)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    few = toxicity.fit(docs.repartition(9), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int"), sample_words=2000)
    again = toxicity.fit(docs.coalesce(1), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int"), sample_words=2000)
    assert np.array_equal(few["add"], again["add"])


def test_every_labelled_row_is_learned_from(spark):
    ids = [i for i in range(26_000) if zlib.crc32(str(i).encode()) % 3 != 1][:16_000]
    docs = spark.createDataFrame([(i, f"rare{k % 800}") for k, i in enumerate(ids)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int"), epochs=1)
    data, at = columns(pa.array([f"rare{k}" for k in range(800)]))
    assert (model["row"][toxicity.features(Words(data, at, ALNUM))[0]] > 0).all()


def test_shards_are_averaged_alike_however_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 64)
    rows = [(i, f"some words {i % 7} here and {'vile' if i % 4 == 0 else 'kind'} end") for i in range(900)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(900)], "doc_id long, toxic int")
    one, many = toxicity.fit(docs.coalesce(1), labels), toxicity.fit(docs.repartition(7), labels.repartition(5))
    assert np.array_equal(one["add"], many["add"]) and np.array_equal(one["threshold"], many["threshold"])
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in toxicity.score(docs, one).collect())


def test_thresholds_count_every_row_of_a_bin():
    rng = np.random.default_rng(6)
    x, language, n = rng.integers(-30, 30, 200) / 10, rng.integers(0, 5, 200), rng.integers(1, 9, 200)
    y = (x + rng.normal(0, 1, 200) > 0.5).astype(int)
    every = [np.repeat(v, n) for v in (x, language, y)]
    assert np.allclose(toxicity._thresholds(x, language, y, n), toxicity._thresholds(*every, np.ones(n.sum(), int)))
