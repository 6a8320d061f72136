"""Columns of the input that bear the names operators use inside, repeated ids, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from quadrille.llm import bpe, embed_dedup, mixing, quality, simhash, suffix_dedup, urls

SF = "/root/testdata/sf0.001"
#: Names that operators use, or used, for columns of their own; FP and fp differ in case alone from others.
NAMES = """_l _v _w _src _s _before _hash _c _b _fp FP _host _site _path of_site base_rate _id _good _node node root least_id
size source_size copies taken target removed repeated doc digest own n src none hash class bucket rank before l v w id c0 c1 C2
suffix domain prior key pos sketch evidence site_rate probability kept n_links component_id fingerprint verdict rule bad_low""".split()


def widened(df, lost):
    """df with a column of each name, other than those that the operator replaces, and a map column."""
    have = {c.lower() for c in df.columns} | lost
    names = [n for n in dict.fromkeys(NAMES) if n.lower() not in have]
    return df.select("*", *[F.lit(f"of {n}").alias(n) for n in names], F.create_map(F.lit("k"), F.lit(1)).alias("a map")), [*names, "a map"]


def documents(spark):
    rows = [(i, f"the words of text {i} are here and there " * 8, "en", f"s{i % 3}", 9) for i in range(12)]
    rows += [(3, rows[4][1], "en", "s1", 9), (3, rows[4][1], "en", "s1", 9), (None, None, None, None, None), (20, "", "en", "s1", 0), (21, None, "en", "s1", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")


def pages(spark):
    return spark.createDataFrame([(1, "http://a.com/x"), (2, None), (None, "http://b.org/")], "page_id long, url string")


def embeddings(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (2, [0.0, 1.0], "a"), (3, None, "a"), (None, [1.0, 0.0], None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")


OPERATORS = {
    "op1": (embeddings, lambda s, d: embed_dedup.near_duplicates(d), {"n_links", "component_id", "kept"}),
    "op2": (documents, lambda s, d: bpe.coded(d, bpe.load_ranks(bpe.public_tokenizers.path(bpe.RANKS))), {"n_tokens", "ids", "ids_sha256", "decoded_sha256"}),
    "op5": (documents, lambda s, d: mixing.mix(d), {"size", "source_size", "target", "copies", "taken"}),
    "op7": (documents, lambda s, d: simhash.near_duplicates(d), {"fingerprint", "component_id"}),
    "op9": (pages, lambda s, d: urls.judge(d, labels(s)), {"host", "path", "rule", "verdict", "bad_mean", "bad_low"}),
    "op10": (documents, lambda s, d: quality.classify(d, labels(s)), {"evidence", "site_rate", "probability", "kept"}),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_keep_clashing_columns(spark, name):
    make, run, replaced = OPERATORS[name]
    df, extra = widened(make(spark), replaced)
    got = run(spark, df)
    rows = got.collect()
    assert len(rows) == df.count() and len(rows) == len(run(spark, make(spark)).collect())
    assert [c for c in got.columns if c in extra] == extra
    assert all(r[c] == f"of {c}" for r in rows for c in extra[:-1]) and all(r["a map"] == {"k": 1} for r in rows)
    assert run(spark, df.limit(0)).count() == 0


STAGES = {"quality": quality.stage, "simhash": simhash.stage, "suffix": suffix_dedup.stage, "mixing": mixing.stage, "bpe": bpe.stage}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_clashing_columns(spark, tmp_path, name):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    df, extra = widened(documents(spark), {"n_tokens", "ids"})
    got = STAGES[name](spark, df, str(tmp_path))
    rows = got.collect()
    assert rows and [c for c in got.columns if c in extra] == extra
    assert all(r[c] == f"of {c}" for r in rows for c in extra if c != "a map")
    if name != "mixing":  # which samples by a hash of all columns
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, (r.doc_id for r in STAGES[name](spark, documents(spark), str(tmp_path)).collect())))
    if name != "bpe":
        assert got.columns == df.columns
    assert STAGES[name](spark, df.limit(0), str(tmp_path)).count() == 0
