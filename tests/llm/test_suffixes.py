"""Suffix order and removal of repeats against plain Python."""

import numpy as np

from runledger.llm import registry, suffix_dedup

from . import brute


def test_suffix_order():
    rng = np.random.default_rng(7)
    cases = [[b"banana"], [b"aaaa", b"aa", b""], [b"abab" * 9, b"baba" * 3]]
    cases += [[bytes(rng.integers(97, 97 + k, n).tolist()) for n in rng.integers(0, 40, 6)] for k in (1, 2, 3, 26) for _ in range(20)]
    for strings in cases:
        got = [strings[k][i:] for k, i in zip(*suffix_dedup.suffix_order(strings), strict=True)]
        assert got == sorted(s[i:] for s in strings for i in range(len(s)))


def test_whole_small_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.QUERIES["op7_suffix_dedup"](spark, sf_dir).collect()}
    want = brute.repeats(docs)
    assert got == want and sum(0 < x[1] < x[0] for x in want.values()) > 5


def test_edges(spark):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared, other = word(60), word(49)
    rows = [(1, None), (2, ""), (3, "a" * 200), (4, "b" + "a" * 55 + "c"), (5, shared), (6, word(20) + shared + word(9)), (7, shared), (8, other), (9, other), (10, other + "é" + shared[:50] + shared), (11, shared[5:55])]
    rows += [(20 + k, word(30) + shared[k : k + 51] + word(30)) for k in range(9)]
    df = spark.createDataFrame([*rows, (None, shared)], "doc_id long, text string")
    out = suffix_dedup.without_repeats(df).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out if r.doc_id is not None}
    assert got == brute.repeats(rows)
    assert [r.n_removed for r in out if r.doc_id is None] == [0]
    assert suffix_dedup.without_repeats(df.limit(0)).count() == 0


def test_other_texts_of_a_copy(spark):
    rng = np.random.default_rng(5)
    t, u, v = ("".join(rng.choice(list("abcdefghijklmnop"), 300)) for _ in range(3))
    rows = [(1, t), (1, v), (2, t), (2, u + v[:100]), (3, "x" + u[:120])]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 300, 0), (1, 300, 0), (2, 300, 300), (2, 400, 100), (3, 121, 120)]


def test_long_string_of_one_letter(spark):
    owner, place = suffix_dedup.suffix_order([b"a" * 200_000, b"ba" * 20_000])
    assert len(owner) == 240_000 and place[:2].tolist() in ([199_999, 39_999], [39_999, 199_999])
    rows = [(1, "a" * 1_000_000), (2, "b" + "a" * 300_000 + "c"), (3, "a" * 1_000_000 + "d")]
    out = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in out} == {1: (0, 0), 2: (300_000, 1), 3: (1_000_000, 1)}


def test_hot_string_in_many_contexts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    hot = "of the common twenty four bytes"
    text = ["".join(rng.choice(list("abcdefgh"), 90)) for _ in range(400)]
    rows = [(k, t[:45] + hot + t[45:] + text[k % 7][:60]) for k, t in enumerate(text)]
    monkeypatch.setattr(suffix_dedup, "HOT", 50)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(df).collect()}
    assert got == brute.repeats(rows)


def test_all_pieces_of_a_batch(spark, sf_dir, monkeypatch):
    """With one batch and window-wise dealing of every minimizer the results are the same."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.QUERIES["op7_suffix_dedup"](spark, sf_dir).collect()}
    assert got == brute.repeats(docs)
