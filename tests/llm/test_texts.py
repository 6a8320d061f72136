"""Operators on texts, against libraries, brute force and round trips."""

import hashlib
import math
import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.llm import bpe, licenses, mixing, quality, suffix_dedup, token_files, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "a", "it's  we'll\n\n x\t", " lead", "trail ", "naïve  été 漢字かな 😀👍🏽", "x" * 3000, "ab" * 400, "1234567 89,5!?...", "\u00a0\u2003 y\u0085z", "<|endoftext|>", "\r\n\x0b\x0c end", "e\u0301 \u0301x"]


def library():
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


RANKS, ENCODING = library()
WORDS = bpe.Words(RANKS, public_tokenizers.PATTERN)


def own(words, texts):
    return [list(array("I", bytes(x))) for x in words.encode(pa.array(texts, pa.string()))]


def test_bpe_odd_texts():
    assert own(WORDS, ODD) == [ENCODING.encode_ordinary(t) for t in ODD]
    sliced = pa.array(["left out", *ODD, None], pa.string()).slice(1)
    assert [list(array("I", bytes(x))) for x in WORDS.encode(sliced)] == [*(ENCODING.encode_ordinary(t) for t in ODD), []]
    assert own(WORDS, []) == [] and own(WORDS, [None, None]) == [[], []]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aeth TH's\n\t .,1é漢 \u00a0\u2003_")), max_size=60), max_size=5))
def test_bpe_any_text(texts):
    assert own(WORDS, texts) == [ENCODING.encode_ordinary(t) for t in texts]


def test_bpe_folds_in_parts_and_alone(monkeypatch):
    texts = ["some words and some more words,\nand some again " * 3, "Unverhältnismäßigkeiten and antidisestablishmentarianisms " * 2 + "x" * 70]
    for most in (10, 400_000):
        monkeypatch.setattr(bpe, "FOLDED", most)
        assert own(bpe.Words(RANKS, public_tokenizers.PATTERN), texts) == [ENCODING.encode_ordinary(t) for t in texts]
    pattern = r"\w+|\W"
    assert own(bpe.Words(RANKS, pattern), ["a bc\n"]) == [[i for p in ("a", " ", "bc", "\n") for i in bpe.fold(p.encode(), RANKS)]]
    for piece in (b"ththingtion" * 60, b"zqj" * 300, bytes(range(256)) * 3):
        assert bpe._fold_long(piece, RANKS) == bpe._fold_long(piece[:], RANKS)
        plain = [RANKS[x] for x in fold_plainly(piece)]
        assert bpe._fold_long(piece, RANKS) == plain


def fold_plainly(piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((RANKS.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)), default=(1 << 40, 0))
        if best[0] == 1 << 40:
            return parts
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_bpe_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = bpe.op2_byte_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = ENCODING.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_bpe_null_empty_clashing(spark):
    df = spark.createDataFrame([(1, None, 3), (1, None, 3), (None, "hi there", 4)], "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(df, RANKS), RANKS)
    assert sorted(bytes(r.decoded) for r in got.collect()) == [b"", b"", b"hi there"] and got.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert bpe.encode(df.limit(0), RANKS).count() == 0


def test_fold_as_higher_order_functions(spark):
    coder = bpe.Coder(spark, {t: r for t, r in RANKS.items() if r < 3000}, public_tokenizers.PATTERN, buckets=256)
    few = {t: r for t, r in RANKS.items() if r < 3000}
    texts = ["the thing was naïve, wasn't it?", "", "a", "ththththth  tion"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", F.flatten(F.transform(coder.pieces(F.col("t")), lambda p: coder.fold(bpe.latin(p)))).alias("ids")).collect()
    small = bpe.Words(few, public_tokenizers.PATTERN)
    assert {r.t: list(r.ids) for r in got} == dict(zip(texts, own(small, texts)))


# Token files


def hf():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


LIBRARY, TOKEN_WORDS = hf(), token_files.Words(public_tokenizers.path("word_bpe_49k.json"))


def test_token_words_equal_library():
    texts = [*ODD, "Don't STOP, now... The end.,!? abc:def x,y", "word, Word; WORD!", "\x1c odd \x1f sep\u2028line", "İ. İSTANBULDA Kİ, VE É, ÉÈ ªº ſs"]
    texts += ["a <|endoftext|> b", "a<|startoftext|>b.", "<|ENDOFTEXT|> x<|", "e\u0301. E\u0301, \u0301\u0323a ΑΣ, ΣΑΣ."]
    assert own(TOKEN_WORDS, texts) == [LIBRARY.encode(x, add_special_tokens=False).ids for x in texts]
    assert own(TOKEN_WORDS, [None]) == [[]] and own(TOKEN_WORDS, []) == []
    every = [f"x{chr(c)}y {chr(c)}, Z{chr(c)}." for c in range(0x400) if not 0xD800 <= c < 0xE000]
    assert own(TOKEN_WORDS, every) == [LIBRARY.encode(x, add_special_tokens=False).ids for x in every]
    # Another tokenizer, whose words end otherwise, is given whole texts.
    other = token_files.Words(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.cuts and own(other, texts) == [other.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aeTH's\n\t .,1é漢İIıßΣσ_-\"<|>\u00a0\u0301\u0323ǅ", "<|endoftext|>"]), max_size=40).map("".join), max_size=4))
def test_token_words_equal_library_on_any_text(texts):
    assert own(TOKEN_WORDS, texts) == [LIBRARY.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_file_round_trip(tmp_path):
    rng = np.random.default_rng(0)
    docs = [(i * 3, rng.integers(0, 49000, rng.integers(0, 400)).astype("<u4").tobytes()) for i in range(100)]
    writer = token_files.FileWriter(str(tmp_path / "x"), frame_bytes=5000)
    for d in docs:
        writer.add(*d)
    writer.close()
    reader = token_files.FileReader(str(tmp_path / "x"))
    assert len(reader.frames) > 5 and list(reader.documents()) == docs
    named = token_files.FileWriter(str(tmp_path / "z"), frame_bytes=8)
    for d in ((None, b"abcd"), (None, b"abcdefgh"), (-(1 << 63), b"xxxx")):
        named.add(*d)
    named.close()
    assert list(token_files.FileReader(str(tmp_path / "z")).documents()) == [(None, b"abcd"), (None, b"abcdefgh"), (-(1 << 63), b"xxxx")]
    seen = []
    reader.frame, whole = lambda k: seen.append(k) or whole(k), reader.frame
    assert list(reader.documents({30, 33, 297})) == [d for d in docs if d[0] in (30, 33, 297)] and len(seen) <= 3
    # Any zstandard reader reads it, and damage is noticed.
    raw = zstandard.ZstdDecompressor().stream_reader((tmp_path / "x").read_bytes(), read_across_frames=True).read()
    assert raw == b"".join(d[1] for d in docs)
    data = bytearray((tmp_path / "x").read_bytes())
    data[20] ^= 1
    (tmp_path / "y").write_bytes(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.FileReader(str(tmp_path / "y")).documents())


def test_token_files_query(spark):
    t = hf()
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = sorted(token_files.op4_token_files(spark, SF).collect())
    start = 0
    for (i, text), r in zip(docs, got, strict=True):
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        start += len(ids)


def test_token_files_odd_tables(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(2, None, 1), (None, "b", 1), (1, "a", 1), (1, "a", 1)], "doc_id long, text string, ids int")
    got = token_files.read(spark, token_files.write(df, path, 1, f"file://{tmp_path}/a")).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in got) == [(0, None, 2), (2, 1, 2), (4, 1, 2), (6, 2, 1)]
    some = token_files.read(spark, token_files.write(df, path, 1, f"file://{tmp_path}/c"), {2}).collect()
    assert [(r.doc_id, r.n_tokens) for r in some] == [(2, 1)]
    assert token_files.read(spark, token_files.write(df.limit(0), path, 1, f"file://{tmp_path}/b")).count() == 0


# Repeated passages


def passages_plainly(docs, n):
    first, again = {}, set()
    for i, words in sorted(docs.items()):
        for s in range(len(words) - n + 1):
            key = tuple(words[s : s + n])
            if key in first:
                again.add(key)
            else:
                first[key] = (i, s)
    out = {}
    for i, words in docs.items():
        marks = {k: set() for k in ("repeated", "removed")}
        for s in range(len(words) - n + 1):
            key = tuple(words[s : s + n])
            if key in again:
                marks["repeated"].update(range(s, s + n))
                if first[key] != (i, s):
                    marks["removed"].update(range(s, s + n))
        if marks["repeated"]:
            out[i] = marks
    return out


def marked(rows):
    return {r.doc_id: {k: {p for s in r[k] for p in range(s.start, s.end)} for k in ("repeated", "removed")} for r in rows}


def some_texts(seed=5):
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    shared = [word(n) for n in (49, 50, 51, 60, 75, 120)]
    docs = {}
    for i in range(80):
        words = word(int(rng.integers(0, 200)))
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = shared[int(rng.integers(0, len(shared)))]
        docs[i] = words
    docs[100], docs[101], docs[102] = ["ha"] * 200, ["x", "y"] * 90, docs[10] + docs[11]
    docs[103] = word(55)
    docs[104] = docs[103] + word(10) + docs[103]
    return docs


def test_passages_equal_brute_force(spark):
    docs = some_texts()
    df = spark.createDataFrame([(i, " \n".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(5)
    assert marked(suffix_dedup.repeated_passages(df).collect()) == passages_plainly(docs, 50)


def test_passages_in_parts(monkeypatch):
    texts = [" ".join(w).encode() for w in some_texts().values()]
    whole = suffix_dedup.Words(texts)
    monkeypatch.setattr(suffix_dedup, "_PART", 700)
    assert np.array_equal(suffix_dedup.Words(texts).hash, whole.hash)


def test_passages_query_on_small_table(spark):
    docs = {r.doc_id: r.text.encode().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert marked(suffix_dedup.op3_suffix_dedup(spark, SF).collect()) == passages_plainly(docs, 50)


def test_passages_stage_keeps_both_texts_of_an_id(spark):
    shared, other, more = (" ".join(f"{c}{i}" for i in range(60)) for c in "wxy")
    rows = [(2, shared), (5, shared + " tail"), (5, other), (7, other), (8, more), (8, more), (None, shared)]
    df = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in rows], DOCS)
    got = sorted((str(r.doc_id), r.text) for r in suffix_dedup.stage(spark, df, "").collect())
    # Of the texts of an id that stands on several, equal passages are kept last.
    assert got == sorted([("2", shared), ("5", "tail"), ("7", other), ("8", more), ("8", more), ("None", shared)])
    assert sorted((r.doc_id, r.n_removed, r.first_doc_ids) for r in suffix_dedup.repeated_passages(df).collect()) == [(2, 0, [2]), (5, 60, [2]), (5, 60, [7]), (7, 0, [7])]


def test_passages_stage(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, "head " + " ".join(words), "en", "s", 9), (2, "own\n" + "  ".join(words) + " tail é", "en", "s", 9), (3, " ".join(words), "en", None, 9)]
    rows += [(4, None, None, None, None), (5, "", "en", "s", 0), (None, " ".join(words), "en", "s", 9), (6, "clean text", "de", "t", 77)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in suffix_dedup.stage(spark, df, "").collect()}
    assert got[1].text == rows[0][1] and got[2].text == "own\ntail é" and got[2].n_chars == 10 and 3 not in got
    assert got[4].text is None and got[5].text == "" and got[None].text == rows[5][1] and got[6].n_chars == 77
    assert suffix_dedup.stage(spark, df.limit(0), "").columns == df.columns


# Mixing


def targets_plainly(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


def check_mix(df, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    goal = targets_plainly(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, goal[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(3 * largest[s], 0.03 * goal[s])


def test_mix_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r.size == len(r.text.encode().split()) for r in rows)
    check_mix(docs, rows)
    assert sorted(mixing.op5_mixing(spark, SF).collect()) == sorted(mixing.op5_mixing(spark, SF).collect())


def test_mix_takes_what_a_plain_sampler_takes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    keyed = docs.select("doc_id", "source", F.xxhash64("doc_id", "source", "text").alias("hash"), F.length("text").alias("n"), "text", F.xxhash64("source", F.lit("offset")).alias("offset"))
    rows = [(r.source, math.floor(math.log2((n := len(r.text.encode().split())) + 1) * 4), r.hash % mixing.BUCKETS, n, r.hash, r.doc_id, r.offset) for r in keyed.collect()]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[0]] += r[3]
    goal, want = targets_plainly(sizes), {}
    for source in sizes:
        own = sorted(r[1:] for r in rows if r[0] == source)
        expected, total = goal[source] / sizes[source], own[0][-1] % (1 << 20) / (1 << 20)
        for i, r in enumerate(own):
            want[r[4]] = (math.floor(expected * (i + 1) + total) - math.floor(expected * i + total)) * r[2]
    got = {r.doc_id: r.taken for r in mixing.op5_mixing(spark, SF).collect()}
    assert sum(got[d] != want[d] for d in got) <= 2 and abs(sum(got.values()) - sum(want.values())) <= 2 * max(r[3] for r in rows)  # rounding at a border


def test_mix_odd_rows(spark):
    rows = [(i, "a b c d" if i % 5 else None, "en", ["a", "b", None, "é", "Z"][i % 5 if i % 7 else 2], i) for i in range(500)]
    rows += [(1, "x " * 4000, "en", "b", 1), (1, "x " * 4000, "en", "b", 1), (None, "  ", None, "zero", None)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "Target")
    got = mixing.mix(df)
    assert "Target" not in got.columns and got.count() == len(rows)
    check_mix(df, got.collect())
    assert mixing.mix(df.limit(0)).count() == 0
    out = mixing.stage(spark, spark.createDataFrame(rows, DOCS), "")
    assert out.columns == spark.createDataFrame(rows, DOCS).columns
    assert out.count() == got.agg(F.sum("copies")).head()[0]


# Licences


def test_licenses(spark):
    rows = [(1, "text\nLicensed under the Apache License, Version 2.0\nmore"), (2, None), (3, ""), (4, "the mit licence is old news"), (5, "RELEASED -- under the 'MIT' License!")]
    rows += [(6, "Released under\nthe MIT License."), (7, "Released under the MIT License. " * 400), (8, "This work is licensed under the GNU General Public License, version 3."), (None, "Licensed under CC BY-NC 4.0.")]
    rows += [(5, "RELEASED -- under the 'MIT' License!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("unit", F.lit(1)).withColumn("line", F.lit(2))
    got = {(r.doc_id, r.license): (round(r.dice, 3), r.n_units, r.first_line) for r in licenses.scan(df).collect()}
    assert got == {
        (1, "Apache-2.0"): (1.0, 2, 1), (5, "MIT"): (1.0, 2, 0), (6, "MIT"): (1.0, 1, None), (7, "MIT"): (pytest.approx(8 / 9, abs=1e-3), 1, 0),
        (8, "GPL-3.0"): (1.0, 1, 0), (None, "CC-BY-NC-4.0"): (1.0, 1, 0),
    }
    assert licenses.scan(df.limit(0)).count() == 0


def test_licenses_against_brute_force(spark):
    """Templates with words taken out, put in or changed: passing over texts without key words loses no match."""
    rng = random.Random(5)
    sets = {name: set(licenses.bigrams(t)) for name, t in sorted(licenses.TEMPLATES.items())}
    units = []
    for t in licenses.TEMPLATES.values():
        for _ in range(25):
            words = t.split()
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(words)) if words else 0
                words[at : at + rng.randint(0, 2)] = rng.choice([[], ["filler"], ["License"], ["the", "by"]])
            units.append(" ".join(words))
    got = {(r.doc_id, r.license): r.dice for r in licenses.scan(spark.createDataFrame(list(enumerate(units)), "doc_id long, text string")).collect()}
    want = {}
    for i, u in enumerate(units):
        own = set(licenses.bigrams(u))
        dice = {name: 2 * len(own & b) / (len(own) + len(b)) for name, b in sets.items()}
        best = max(sorted(dice), key=dice.get)
        if dice[best] >= licenses.THRESHOLD:
            want[i, best] = dice[best]
    assert got == pytest.approx(want) and 50 < len(want) < len(units)


def test_licenses_within_and_across_lines(spark):
    gpl = "This work is licensed under the GNU General\nPublic License, version 3."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\nconditions are met"
    rows = [(1, f"some words before\n{gpl}\nand some words after it"), (2, f"a program\n{bsd}:\n{'none at all ' * 9}{' '.join(map(str, range(30)))}"), (3, "It is here. Released under the MIT License. It was long ago."), (4, "the mit licence is old news")]
    rows += [(5, "some words before\nLicensed under CC BY-NC 4.0.\nand some after")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license): (round(r.dice, 3), r.n_units, r.first_line) for r in licenses.scan_all(df).collect()}
    assert got == {(1, "GPL-3.0"): (1.0, 0, 1), (2, "BSD-3-Clause"): (1.0, 0, 1), (3, "MIT"): (1.0, 0, 0), (5, "CC-BY-NC-4.0"): (1.0, 1, 1)}


# URLs


def test_rules_and_hosts(spark):
    urls_ = {
        "http://A.Example.com/en/7?x": ("a.example.com", "/en/7", "example.com/en/7", "allow"), "https://b.com/en/6#t": ("b.com", "/en/6", "com/en/", "block"),
        "http://x.example.net/de/81": ("x.example.net", "/de/81", "example.net/de/8", "block"), "http://net/de/": ("net", "/de/", "net/de/", "allow"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"), "no url/en/": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://É.org?q=://x.com/en/": ("É.org", "", None, "allow"), "a\n://h.org/es/1": ("h.org", "/es/1", "org/es/", "block"), "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, 1, "c") for i, u in enumerate(urls_)] + [(0, next(iter(urls_)), 1, "c")], "page_id long, url string, host int, n string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = urls.judge(pages, none)
    assert got.columns == ["page_id", "url", "n", "host", "path", "rule", "verdict", "bad_mean", "bad_low"] and got.count() == len(urls_) + 1
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == urls_
    assert urls.judge(pages.limit(0), none).count() == 0


def test_reputation_blocks_bad_hosts_only(spark):
    rows, marks = [], []
    for h, n, bad in (("spam.a.org", 60, 58), ("good.a.org", 60, 2), ("few.b.org", 1, 1), ("big.b.org", 200, 10)):
        for k in range(n):
            rows.append((len(rows), f"http://{h}/x/{k}"))
            marks.append((len(rows) - 1, int(k >= bad), 0))
    marks += [(None, 0, 0), (3, None, 0)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert {r.host: r.verdict for r in got.collect()} == {"spam.a.org": "block", "good.a.org": "allow", "few.b.org": "allow", "big.b.org": "allow"}


# Quality


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fitted, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    got = quality.classify(docs, fitted).join(held, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [not r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) > 0.85


def test_quality_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x " * 50_000, "en", "s", 1), (3, "x " * 50_000, "en", "s", 1), (None, "a b", "en", None, 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(9))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in quality.classify(df, none).collect()] == [True] * 5
    some = spark.createDataFrame([(3, 0, 0), (2, 1, 0), (2, 1, 0), (99, 1, 1), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, some)
    assert got.count() == 5 and all(r.probability is not None for r in got.collect())
    assert quality.classify(df.limit(0), some).count() == 0


def test_rates_shrink_toward_parents(spark):
    rows = [(i, "t", "en" if i % 2 else "de", "big" if i < 300 else "small", 1) for i in range(302)] + [(999, "t", "fr", "new", 1)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0) if i < 300 else 0, 0) for i in range(302)], "doc_id long, quality int, toxic int")
    got = {(r._site, r._path): r for r in quality.rates(spark.createDataFrame(rows, DOCS), labels, "source", "lang").collect()}
    assert 0.75 < got[("big", "de")].site_rate < 0.9 and 0 < got[("small", "en")].site_rate < got[("big", "en")].site_rate


def rates_plainly(units):
    """units: (site, path, good) of labelled documents. Posterior rate by site and by (site, path), and the rate of all."""
    base = (sum(u[2] for u in units) + 0.5) / (len(units) + 1)

    def shrunk(counts, prior):
        excess = sum((g - n * prior(k)) ** 2 / (prior(k) * (1 - prior(k))) - n for k, (n, g) in counts.items())
        spread = sum(n * (n - 1) for n, _ in counts.values())
        m = 1 / max(0.001, min(0.5, excess / spread if spread else 0.001)) - 1
        return {k: (g + m * prior(k)) / (n + m) for k, (n, g) in counts.items()}

    sites, paths = defaultdict(lambda: (0, 0)), defaultdict(lambda: (0, 0))
    for s, p, g in units:
        sites[s] = (sites[s][0] + 1, sites[s][1] + g)
        paths[s, p] = (paths[s, p][0] + 1, paths[s, p][1] + g)
    of_site = shrunk(sites, lambda k: base)
    return base, of_site, shrunk(paths, lambda k: of_site[k[0]])


def test_quality_query_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id: int(r.quality != 0) for r in labels.collect()}
    rows = docs.collect()
    marked_ = [r for r in rows if r.doc_id in good]
    x = np.array([quality.features(r.text.encode()).astype(np.float32) for r in sorted(marked_, key=lambda r: r.doc_id)], np.float64)
    centre, scale, w = quality.fit(x, np.array([good[r.doc_id] for r in sorted(marked_, key=lambda r: r.doc_id)], np.float64))
    base, of_site, of_path = rates_plainly([(r.source, r.lang, good[r.doc_id]) for r in marked_])
    got = {r.doc_id: r for r in quality.op10_quality(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        rate = of_path.get((r.source, r.lang), of_site.get(r.source, base))
        evidence = float(((quality.features(r.text.encode()) - centre) / scale) @ w[:-1] + w[-1])
        p = 1 / (1 + math.exp(-(evidence + math.log(rate / (1 - rate)) - math.log(base / (1 - base)))))
        assert math.isclose(got[r.doc_id].probability, p, abs_tol=1e-3)
        assert got[r.doc_id].site_rate is None if r.source not in of_site else math.isclose(got[r.doc_id].site_rate, rate, rel_tol=1e-9)
        assert got[r.doc_id].kept == (got[r.doc_id].probability >= 0.5)


def test_quality_by_host_and_first_part_of_the_path(spark):
    # Texts say nothing here; hosts, and one part of a host, do.
    rows, marks = [], []
    for i in range(400):
        host, part = f"h{i % 4}.com", f"p{i // 4 % 2}"
        rows.append((i, f"http://{host}/{part}/x{i}?q", "same words"))
        marks.append((i, int(host != "h0.com" and (host, part) != ("h1.com", "p0"))))
    host, path = urls.host_and_path(F.col("url"))
    df = spark.createDataFrame([*rows, (900, "http://new.org/", "same words"), (901, "http://h0.com/p7/", "same words")], "doc_id long, url string, text string")
    df = df.select("*", host.alias("host"), F.regexp_extract(path, "^/([^/]*)", 1).alias("part"))
    got = quality.classify(df, spark.createDataFrame(marks, "doc_id long, quality int"), site="host", path="part").collect()
    kept = {(r.host, r.part): r.kept for r in got}
    assert not kept["h0.com", "p0"] and not kept["h0.com", "p1"] and not kept["h1.com", "p0"] and kept["h1.com", "p1"] and kept["h2.com", "p0"]
    assert not kept["h0.com", "p7"]  # an unseen part has its host's rate
    base, of_site, of_path = rates_plainly([(f"h{i % 4}.com", f"p{i // 4 % 2}", g) for i, g in marks])
    assert all(math.isclose(r.site_rate, of_path[r.host, r.part], rel_tol=1e-9) for r in got if (r.host, r.part) in of_path)
