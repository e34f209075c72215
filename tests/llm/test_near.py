import itertools
import random
import re

from skein.llm import near
from skein.llm.shared import bitmap, marked


def brute(rows, percent, k=5):
    """(doc_id, n_shingles, component_id, kept) and the component of each row, all pairs of rows compared."""

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset([tuple(words)] if 0 < len(words) < k else (tuple(words[i : i + k]) for i in range(len(words) - k + 1)))

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    groups = [find(i) if sets[i] else -1 - i for i in range(len(rows))]
    out = []
    for i, (d, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if groups[j] == groups[i] and rows[j][0] is not None), default=None)
        out.append((d, len(sets[i]), least, d == least))
    return out, groups


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_rows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 3)
    rng = random.Random(3)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 130, 150]))] for _ in range(6)]
    rows = []
    for i in range(160):
        text = " ".join(edited(rng, base[i % 6], rng.randrange(0, 4)))
        rows.append((None if i % 23 == 0 else i % 120, text.upper() if i % 7 == 0 else text))
    rows += [(500, None), (500, ""), (501, "\t\n"), (502, "one two"), (503, "ONE two"), (3, rows[3][1]), (3, rows[3][1]), (None, "alone here"), (None, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int")
    want, groups = brute(rows, 80)
    assert sorted((tuple(r) for r in near.near_duplicates(df).collect()), key=repr) == sorted(want, key=repr)
    kept = near.without_duplicates(df.repartition(7)).collect()
    assert sorted({groups[r.n] for r in kept}) == sorted(groups[r.n] for r in kept) == sorted(set(groups))
    assert {groups[r.n]: r.doc_id for r in kept if r.text and r.text.strip()} == {g: w[2] for g, w in zip(groups, want) if w[1]}


TEXT = {x: " ".join(f"{x}{i}" for i in range(100)) for x in ("a", "b", "c", "d", "e", "f", "g")} | {"b2": " ".join(f"b{i}" for i in range(99)), "f2": " ".join(f"f{i}" for i in range(99))}


def test_unlike_texts_of_one_id_are_kept_apart(spark):
    rows = [(1, "b2"), (6, "a"), (6, "b"), (16, "c"), (16, "d"), (26, "e"), (26, "f"), (27, "f2"), (27, "g")]
    df = spark.createDataFrame([(i, TEXT[t]) for i, t in rows], "doc_id long, text string")
    names = {t: n for n, t in TEXT.items()}
    assert {(r.doc_id, names[r.text]) for r in near.without_duplicates(df).collect()} == {(1, "b2"), (6, "a"), (16, "c"), (16, "d"), (26, "e"), (26, "f"), (27, "g")}


def test_columns_of_any_name_pass_and_an_empty_table(spark):
    names = "doc_id, text, r1, r2, row, flag, own, part, bits, _rows, _id, winner"
    df = spark.createDataFrame([(i, TEXT["a"], *"abcdefghij") for i in (1, 2)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names.split(", ")[2:]))
    got = near.without_duplicates(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, TEXT["a"], *"abcdefghij")]
    assert near.without_duplicates(df.limit(0)).count() == 0


def test_a_bucket_of_thousands_is_dealt_in_bounded_blocks(spark, monkeypatch):
    seen = []
    real = near.staged

    def watch(df, name):
        out = real(df, name)
        if name == "blocks":
            seen.append(out.selectExpr("max(size(rows)) most", "count(*) n").first())
        return out

    monkeypatch.setattr(near, "staged", watch)
    n = 5000
    full = spark.range(1, n).selectExpr("id rep", "7L bucket", "0L leader")
    labels = spark.range(1, n).selectExpr("id node", "if(id < 4900, 1L, id) label")
    bands = "transform(sequence(1, 32), i -> if(i = 1, 7L, 100 * id + i)) bands"
    sets = spark.range(1, n).selectExpr("id rep", "1L n_shingles", "unhex(lpad(hex(if(id % 100 = 0, 1L, id)), 16, '0')) shingles")
    links = near._residual(full, labels, sets, spark.range(1, n).selectExpr("id rep", bands), 80)
    assert seen[0].most <= 2 * near.BLOCK and seen[0].n >= n // near.BLOCK
    assert links.count() >= 1


def test_bitmaps_never_miss(spark):
    keys = spark.range(0, 50_000, 7).selectExpr("xxhash64(id) r1")
    rows = marked(spark.range(50_000).selectExpr("id", "xxhash64(id) r1"), bitmap(keys, "bits"))
    assert rows.where("id % 7 = 0 and not flag").count() == 0 and rows.where("id % 7 <> 0 and flag").count() < 50
