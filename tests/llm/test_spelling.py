"""Spelling variants against plain loops over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from promolift.llm import spelling as S


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def words_of(rows, at_least=7, count=2, drop=31):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if drop and h % drop == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= at_least:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= count}


def variants(words, ratio=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, str(form[w]), root(w), n, len(near[w]), str(words.get(form[w]))) for w, n in words.items())


def rows_of(df):
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in df.collect())


def invented(seed, size, letters="abéÉz", lengths=(7, 7, 8, 9)):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.choice(lengths))): rng.choice([2, 3, 25, 40, 300, 4000, 41_000])
            for _ in range(size)}


def frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)


@pytest.mark.parametrize("n_symbols", [None, 1, 2, 4])
def test_equals_all_pairs(spark, n_symbols):
    words = invented(3, 500)
    assert rows_of(S.group_variants(frame(spark, words), n_symbols=n_symbols)) == variants(words)


def test_every_pair_once(spark):
    words = invented(5, 400, "ab")
    got = [tuple(sorted((r.word, r.other))) for r in S.near_pairs(frame(spark, words)).collect()]
    listed = sorted(words)
    assert sorted(got) == [(a, b) for i, a in enumerate(listed) for b in listed[i + 1:] if one_edit(a, b)]


def test_neighbourhood_is_complete():
    """Without a filter the keys are those of all one-edit neighbours, from the smaller side."""
    deal = {"a": 1, "b": 2, "c": 3}

    def key(word):
        return sum(deal[c] * pow(S.BASE, i, 1 << 64) for i, c in enumerate(word)) % (1 << 64)

    for word in ("a", "abc", "aabbca"):
        near = {word} | {word[:i] + word[i + 1:] for i in range(len(word))}
        near |= {word[:i] + c + word[i + k:] for i in range(len(word) + 1) for c in "abc" for k in (0, 1)}
        _, keys = S.neighbourhoods([word], deal)
        assert set(keys.tolist()) == {key(w) for w in near if key(w) >= key(word)}


def test_very_long_words_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 64)
    words = ["ab" * 40, "ab" * 40 + "a", "ab" * 20 + "b" + "ab" * 19 + "a"]
    deal = {"a": 1, "b": 2}
    rows, keys = S.neighbourhoods(words, deal)
    own = [S._prefixes(codes)[0][0, -1] for w in words for _, codes in S._by_length([w], deal)]
    met = {(int(r), i) for r, k in zip(rows, keys) for i, o in enumerate(own) if k == o}
    assert all((i, j) in met or (j, i) in met for i, j in ((0, 0), (1, 1), (0, 1), (2, 2)))
    monkeypatch.undo()
    counts = {"x" * 20_000: 5, "x" * 19_999: 50, "x" * 19_999 + "y": 600}
    assert rows_of(S.group_variants(frame(spark, counts))) == variants(counts)


def test_long_chain_of_forms(spark):
    words = {"abcdefgh" + "z" * i: 2 * 10 ** i for i in range(8)}
    out = {r.word: r for r in S.group_variants(frame(spark, words)).collect()}
    assert all(r.root == "abcdefgh" + "z" * 7 for r in out.values())
    assert sum(r.form is None for r in out.values()) == 1


def test_ties_go_to_the_smaller_word(spark):
    words = {"abcdefg": 2, "abcdefz": 30, "abcdefé": 30, "abcdefh": 30}
    assert {r.word: r.form for r in S.group_variants(frame(spark, words)).collect()}["abcdefg"] == "abcdefh"


def test_vocabulary_of_documents(tables):
    rows = [tuple(r) for r in tables["documents"].select("doc_id", "text").collect()]
    got = {r.word: r.n for r in S.vocabulary(tables["documents"]).collect()}
    assert got == words_of(rows)
    plain = {r.word: r.n for r in S.vocabulary(tables["documents"], drop_every=None, min_count=1).collect()}
    assert plain == words_of(rows, count=1, drop=None)


def test_vocabulary_is_passed_on_in_parts(tables, monkeypatch):
    whole = {r.word: r.n for r in S.vocabulary(tables["documents"]).collect()}
    monkeypatch.setattr(S, "FLUSH", 50)
    assert {r.word: r.n for r in S.vocabulary(tables["documents"]).collect()} == whole


def test_edge_cases(edge, nothing):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    words = words_of(rows, at_least=4, count=1)
    got = S.group_variants(S.vocabulary(edge, min_letters=4, min_count=1))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == variants(words)
    assert S.group_variants(S.vocabulary(nothing)).count() == 0


def test_hot_word_is_one_row(spark):
    docs = spark.createDataFrame([(i, "popular " * 300 + f"populer rare{i:04d}x") for i in range(60)], "doc_id long, text string")
    out = {r.word: r for r in S.group_variants(S.vocabulary(docs, drop_every=None)).collect()}
    assert out["popular"].n == 18_000 and out["populer"].root == "popular"


def test_symbols_grow_with_the_vocabulary(spark):
    assert max(S.symbols(frame(spark, invented(1, 50))).values()) <= 8
    assert np.unique(list(S.symbols(frame(spark, invented(1, 50, "abcdefghijklmnopqrstuvwxyz")), 4).values())).tolist() == [1, 2, 3, 4]
