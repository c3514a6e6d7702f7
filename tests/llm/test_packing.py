"""Packing: tokens as the tokenizer gives them, gapless sequences, few of them."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from promolift.llm import packing as P
from promolift.llm.queries import tokenizer_path

PATH = tokenizer_path()


def check_plan(histogram, capacity=4096):
    runs, total = P.plan(dict(histogram), capacity)
    at, held = Counter(), defaultdict(list)
    for length, first, count, sequence, offset in runs:
        assert at[length] == first
        at[length] += count
        for s in range(sequence, sequence + count):
            held[s].append((offset, length))
    assert at == Counter({k: v for k, v in histogram.items() if v})
    assert set(held) == set(range(total))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return total


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=20))
def test_plan_is_a_packing(histogram):
    total = check_plan(histogram, 64)
    tokens = sum(k * v for k, v in histogram.items())
    assert -(-tokens // 64) <= total <= 2 * max(1, -(-tokens // 64))


def test_plan_is_near_the_lower_bound():
    lengths = np.random.default_rng(0).lognormal(6.3, 1.2, 20_000).astype(int).clip(1, 4096)
    assert check_plan(Counter(lengths.tolist())) <= 1.005 * (-(-int(lengths.sum()) // 4096))
    assert check_plan({}) == 0
    assert check_plan({1366: 1000, 1365: 1000, 2: 50}) == 750


def test_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(0)
    small = Counter(rng.integers(1, 4096, 20_000).tolist())
    large = Counter({k: 1000 * v for k, v in small.items()})
    assert len(P.plan(large)[0]) <= 2 * len(P.plan(small)[0])


def check_pieces(rows, out, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            want[doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [4096, 16])
def test_pieces_and_sequences(tables, capacity):
    docs = tables["documents"]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out = P.pack(docs, PATH, capacity).collect()
    used = check_pieces(rows, out, capacity)
    assert used <= 1.02 * (-(-sum(r.length for r in out) // capacity)) + 1


def test_edge_cases(edge, nothing):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    check_pieces(rows, P.pack(edge, PATH).collect(), 4096)
    assert P.pack(nothing, PATH).count() == 0


def test_encoder_equals_the_tokenizer(monkeypatch):
    monkeypatch.setattr(P, "CACHE", 3)
    texts = ["", "it's don't 'S 'tis a1b2 ...!!", "a\tb\xa0c d e\x1cf", "é é éÉ ÉÀß", "İstanbul ΣΑΣ ﬁ ǅ", "x́ 漢字 \U0001F600",
             "Word, word. WORD! word-word", "caféx"] * 2
    tokenizer = Tokenizer.from_file(PATH)
    encode = P._encoder(PATH)
    for text, ids in zip(texts, encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_whole_texts_for_any_tokenizer(name):
    path = PATH.replace("word_bpe_49k.json", name)
    tokenizer = Tokenizer.from_file(path)
    texts = ["The quick  brown fox's den, 2024!\n\nÉtude İß \u00a0x", "", "  lead and trail \n", "<|endoftext|> a<|endoftext|>b",
             "漢字" * 300 + " " + "x" * 300, "e\u0301 don't I'LL 3.14\t\u2028end \u200b", "a" * 65 + " " + "B" * 64]
    encode = P._encoder(path)
    for _ in range(2):  # the second time from what the worker keeps
        for text, ids in zip(texts, encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_only_tokenizers_known_to_split_at_blanks_are_split():
    import json

    spec = json.load(open(PATH))
    assert P._splits_at_blanks(spec)
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "WhitespaceSplit"}},
                   {"model": spec["model"] | {"end_of_word_suffix": None}},
                   {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]},
                   {"added_tokens": [spec["added_tokens"][0] | {"content": "two words"}]}):
        assert not P._splits_at_blanks(spec | change), change


def test_long_chunks_are_not_kept():
    encode = P._encoder(PATH)
    kept = encode.__closure__
    sizes = lambda: [len(c.cell_contents) for c in kept if isinstance(c.cell_contents, dict)]
    before = sizes()
    encode([" ".join("漢字仮名" * 100 + str(i) for i in range(50))])
    assert sizes() == before


def test_forms_of_a_word_are_kept_once():
    encode = P._encoder(PATH)
    size = lambda: sum(len(c.cell_contents) for c in encode.__closure__ if isinstance(c.cell_contents, dict))
    forms = ["straßenöl", "Straßenöl", "STRASSENÖL", "straßenöl,", "Straßenöl!!", "(straßenöl)", "straßenöl-straßenöl"]
    encode(["strassenöl straßenöl , !! ( ) -"])
    before = size()
    tokenizer = Tokenizer.from_file(PATH)
    for text, ids in zip(forms, encode(forms)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert size() == before


def test_a_worker_keeps_few_words_and_frequent_ones_stay(monkeypatch):
    monkeypatch.setattr(P, "CACHE", 40)
    encode = P._encoder(PATH)
    tokenizer = Tokenizer.from_file(PATH)
    for i in range(20):
        name = "".join(chr(97 + int(d)) for d in str(1000 + i))
        text = " ".join(["often"] + [name + "q" * k for k in range(10)])
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        held = [c.cell_contents for c in encode.__closure__ if isinstance(c.cell_contents, dict)]
        assert any("often" in d for d in held)
        assert i < 4 or sum(map(len, held)) <= 40 + 2 * 11
