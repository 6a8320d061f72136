"""Near-duplicate operators and search, against brute force."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from quadrille.llm import ann, components, embed_dedup, jaccard, simhash

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (500, 499), (500, 499)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {n: r for n, r in union(links, {x for p in links for x in p}).items() if n != r}
    assert {n: r for n, r in got.items() if n != r} == want


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_cover_meets_all_sets_of_four():
    assert len(simhash.COVER) == 20
    assert all(any(set(c) <= set(s) for c in simhash.COVER) for s in combinations(range(8), 4))


@pytest.mark.parametrize("text", ["", " \n", "one", "a b c", "A b C d", "a b c d e " * 50, "é Ä x \x1f y z w v"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_simhash_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:20].tolist():
        for _ in range(40):
            fps.add(b ^ sum(1 << int(i) for i in rng.choice(63, rng.integers(1, 6), replace=False)))
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    for block in (1000, 7):  # with and without long lists
        found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), block=block)
        got = union([(r.a, r.b) for r in found.collect()], fps)
        close = [(a, b) for a, b in combinations(fps, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
        assert got == union(close, fps)


def test_simhash_query_on_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = simhash.op7_simhash_near_dedup(spark, SF).toPandas().set_index("doc_id").sort_index()
    fps = {i: plain_fingerprint(t) for i, t in zip(docs.doc_id, docs.text)}
    close = [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    assert got.fingerprint.to_dict() == {i: f"{f:016x}" for i, f in fps.items()}
    assert got.component_id.to_dict() == union(close, fps)


def test_simhash_edge_rows_and_clashing_names(spark):
    rows = [(1, None, "x", 5), (2, "", "y", 6), (3, "a b", "z", 7), (3, "a b", "z", 7), (None, "a b", "q", 8), (4, "c d e " * 3000, "r", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, key long")
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "text", "key", "fingerprint", "component_id"]
    by = {(r.doc_id, r.key): r.component_id for r in got.collect()}
    assert got.count() == 6 and by[(1, 5)] == by[(2, 6)] == 1 and by[(3, 7)] == by[(None, 8)] == 3
    kept = sorted((r.doc_id or 0) for r in simhash.stage(spark, docs, "").collect())
    assert kept == [0, 1, 3, 4]
    empty = spark.createDataFrame([], docs.schema)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.stage(spark, empty, "").count() == 0


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("block", [1000, 3])
def test_near_copies_equal_brute_force(spark, block):
    rng, texts = np.random.default_rng(2), ["", " ", "a b", "A  b", "one two three four five"]
    for _ in range(12):  # copies with 1 to 8 words changed of 60, about the similarity that counts; a notice that all share
        base = ["the same notice stands in all of these".split(), [f"w{i}" for i in rng.integers(0, 3000, 60)]]
        for k in range(10):
            words = sum(base, [])
            for at in rng.integers(0, len(words), k % 9):
                words[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
    texts += [texts[7], texts[30].upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", jaccard.node_of(F.col("text")))
    node = {r.doc_id: r.node for r in docs.collect()}
    root = {r.node: r.root for r in jaccard.links(docs.select("node", "text"), block=block).collect()}
    sets = [plain_shingles(t) for t in texts]
    close = [(a, b) for a, b in combinations(range(len(texts)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert {frozenset(i for i in node if root.get(node[i], node[i]) == r) for r in (root.get(n, n) for n in node.values())} == {
        frozenset(i for i, x in union(close, range(len(texts))).items() if x == r) for r in union(close, range(len(texts))).values()
    }


def changed_texts(seed=4):
    """Texts of 20 to 120 words in five forms each, with up to an eighth of the words' shingles changed."""
    rng, texts = np.random.default_rng(seed), ["", " ", "a b", "A  b", "a b c d e f", "a b c d e f g"]
    for _ in range(40):
        base = [f"w{i}" for i in rng.integers(0, 5000, rng.integers(20, 120))]
        for k in range(5):
            words = list(base)
            for at in rng.integers(0, len(words), k * len(words) // 180):
                words[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join([*words, f"end{k}"]))
    return texts


def plain_vote(text):
    hashes = sorted((xxhash.xxh64_intdigest(s, 42) for s in plain_shingles(text)), key=lambda h: h - (h >> 63 << 64))
    both, top = [], (1 << 64) - 1
    for h in hashes:
        m = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & top
        m = (m ^ (m >> 27)) * 0x94D049BB133111EB & top
        both.append(h | (m ^ (m >> 31)) << 64)
    ones = [2 * sum(h >> b & 1 for h in both) for b in range(128)]
    return sum(1 << b for b in range(128) if ones[b] > len(both) or both and ones[b] == len(both) and both[0] >> b & 1)


def test_wide_fingerprints_and_their_index_equal_brute_force(spark):
    texts = changed_texts()
    votes = [simhash.vote(jaccard.shingles(t.encode())) for t in texts]
    plain = [plain_vote(t) for t in texts]
    assert [int.from_bytes(v.tobytes(), "little") for v in votes] == plain
    fps = spark.createDataFrame([(i, int(v[0]), int(v[1])) for i, v in enumerate(votes)], "node long, f0 long, f1 long")
    got = [(r.a, r.b) for r in simhash.wide_pairs(fps).collect()]

    def meets(a, b):
        same = [(a >> 8 * k ^ b >> 8 * k) & 255 == 0 for k in range(16)]
        return (a ^ b).bit_count() <= 32 and (sum(same[:8]) > 1 or sum(same[8:]) > 1)

    close = [(a, b) for a, b in combinations(range(len(texts)), 2) if meets(plain[a], plain[b])]
    assert set(got) <= set(close) and union(got, range(len(texts))) == union(close, range(len(texts)))


def test_simhash_stage_takes_its_links_from_fingerprints_and_misses_none(spark, monkeypatch):
    """SimHash alone joins nine tenths of the similar pairs at least; the check after it is over what it left apart."""
    texts = changed_texts()
    sets = [plain_shingles(t) for t in texts]
    close = [(a, b) for a, b in combinations(range(len(texts)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted({r for r in union(close, range(len(texts))).values()})
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == want
    first, across = [], jaccard._across

    def seen(lists, sketches, roots, *more):
        first.append({r.node: r.root for r in roots.collect()})
        return across(lists, sketches, roots, *more)

    monkeypatch.setattr(jaccard, "_across", seen)
    simhash.stage(spark, docs, "").collect()
    node = {r.doc_id: r.node for r in docs.select("doc_id", jaccard.node_of(F.col("text")).alias("node")).collect()}
    joined = sum(first[0].get(node[a], node[a]) == first[0].get(node[b], node[b]) for a, b in close)
    assert len(close) > 50 and joined >= 0.9 * len(close)
    monkeypatch.setattr(simhash, "wide_pairs", lambda fps: fps.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    first.clear()
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == want and not first[0]


def test_simhash_stage_joins_at_a_similarity_of_four_fifths(spark):
    """Pairs of sf0.1 that differ in 6 and 7 bits."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id in (7743, 9710, 989, 7711, 1, 2)")
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == [1, 2, 989, 7743]


def test_simhash_stage_keeps_both_texts_of_a_clashing_id(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " x"), (1, a)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.stage(spark, docs, "").collect())) == [(1, a), (1, b)]


def check_dedup(spark, rows, **more):
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), **more).toPandas()
    want = embed_dedup.brute_force(pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]))
    key = ["vec_id", "n_links"]
    got, want = (d[["vec_id", "n_links", "component_id", "kept"]].sort_values(key).reset_index(drop=True) for d in (got, want))
    assert got.astype("float").equals(want.astype("float"))


def some_vectors(n=300, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        if i % 3 == 1 and rows:
            v = np.array(rows[-1][1]) + rng.normal(size=dim) * 0.12
        if i % 17 == 5:
            v = np.array(rows[0][1]) * rng.uniform(0.5, 2)
        rows.append((int(i * 7 % n), [float(np.float32(x)) for x in v], int(rng.integers(0, 3))))
    return rows


def test_embedding_dedup_equals_brute_force(spark):
    check_dedup(spark, some_vectors(), rows_per_list=20, block=1000)


def test_embedding_dedup_in_small_blocks(spark):
    rows = some_vectors(120) + [(1000 + i, [1.0] * 16, 1) for i in range(40)] + [(2000 + i, [1.0 + i / 1000] * 8 + [1.0] * 8, 1) for i in range(30)]
    check_dedup(spark, rows, rows_per_list=20, block=10)


def test_embedding_dedup_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [], 1), (3, [0.0] * 16, 1), (4, [nan] + [1.0] * 15, 1), (5, [inf] + [1.0] * 15, 1), (6, [1.0] * 16, None)]
    odd += [(7, [1.0] * 16, 1), (8, [1.0] * 16, 1), (8, [1.0] * 16, 1), (9, [1.0, 2.0], 1), (10, [2.0, 4.0], 1), (11, [1e-30] * 16, 1), (12, [1.0, None], 1)]
    check_dedup(spark, odd)
    assert embed_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_embedding_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    got = embed_dedup.op1_embedding_near_dedup(spark, SF).toPandas().sort_values("vec_id").reset_index(drop=True)
    want = embed_dedup.brute_force(rows).sort_values("vec_id").reset_index(drop=True)
    assert got.astype("int64").equals(want.astype("int64"))


def test_embedding_dedup_reranks_what_codes_leave_open(spark):
    """Pairs whose cosine is all but the threshold, in one block and several."""
    rng, rows = np.random.default_rng(6), some_vectors(90)
    for k in range(60):
        x, y = rng.normal(size=(2, 16))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        cosine = 0.93 + (-1) ** k * 10.0 ** -(k % 6 + 2)
        rows += [(1000 + 2 * k, x.tolist(), 1), (1001 + 2 * k, (3 * (cosine * x + np.sqrt(1 - cosine**2) * y)).tolist(), 1)]
    doubles = spark.createDataFrame(rows, VECTORS.replace("float", "double"))
    want = embed_dedup.brute_force(pd.DataFrame(rows, columns=["vec_id", "embedding", "label"])).sort_values("vec_id").reset_index(drop=True)
    for block in (1000, 30):
        got = embed_dedup.near_duplicates(doubles, rows_per_list=20, block=block).drop("embedding", "label").toPandas()
        assert got.sort_values("vec_id").reset_index(drop=True).astype("int64").equals(want.astype("int64"))


def test_embedding_dedup_moves_codes_not_vectors(spark):
    """However many lists there are, what is shuffled stays under four times the vectors."""
    x = np.random.default_rng(8).normal(size=(6000, 64)).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist(), "label": 1}), VECTORS)
    store = spark.sparkContext._jvm.org.apache.spark.SparkContext.getOrCreate().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = shuffled()
    assert embed_dedup.near_duplicates(rows, rows_per_list=100).filter("n_links > 0").count() == 0
    assert 0 < shuffled() - before < 4 * x.nbytes


def exact_search(rows, queries, k):
    out = []
    use = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for q, x in use:
        if q % queries == 0:
            best = sorted((-float((x * y).sum()), i) for i, y in use if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("reach", [1.0, 0.6])
def test_search(spark, reach):
    rows = some_vectors(400)
    df = spark.createDataFrame(rows, VECTORS)
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=7, centroids=8, sampled=100, block=50, query_block=5, reach=reach)
    want = exact_search(rows, 20, 7)
    if reach == 1.0:
        assert [(r[0], r[1], r[2]) for r in sorted(map(tuple, got.collect()))] == [w[:3] for w in want]
    else:
        exact = spark.createDataFrame([(w[0], w[2]) for w in want], "query_id long, vec_id long")
        assert ann.recall(got, exact) >= 0.9


def test_search_ties_odd_rows_and_few_candidates(spark):
    rows = [(i, [1.0, 1.0, 0.0], 0) for i in (20, 3, 1, 2, 40)] + [(5, None, 0), (60, [0.0] * 3, 0), (7, [float("nan"), 1.0, 1.0], 0)]
    got = sorted(map(tuple, ann.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, k=3).collect()))
    assert [(r[0], r[1], r[2]) for r in got] == [(20, 1, 1), (20, 2, 2), (20, 3, 3), (40, 1, 1), (40, 2, 2), (40, 3, 3)]
    assert ann.search(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0], 0)], VECTORS)
    assert ann.search(one, F.col("vec_id") % 20 == 0).count() == 0


def test_search_leaves_out_all_rows_of_the_query(spark):
    rng = np.random.default_rng(5)
    own = [(20, [9.0 + i, 9.0 + i]) for i in range(8)]
    df = spark.createDataFrame([*own, *[(i, rng.normal(size=2).tolist()) for i in range(1, 8)], (3, [30.0, 30.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") % 20 == 0, k=3).collect() if r.query_id == 20)
    assert [g[0] for g in got if g[0] <= 3] and got[0] == (1, 3) and len(got) == 3


def test_search_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(map(tuple, ann.op8_approximate_nearest_neighbours(spark, SF).collect()))
    want = exact_search(rows, 20, 20)
    assert [r[:3] for r in got] == [w[:3] for w in want]
    assert np.allclose([r[3] for r in got], [w[3] for w in want], rtol=0, atol=1e-12)
