"""Line dedup: which lines go, which stay."""

import random
from collections import Counter

from hypothesis import given, settings, strategies as st

from llm_data import frame
from promolift.llm import linededup as L


def result(df, min_words=50):
    return {r.doc_id: r for r in L.dedup_lines(df, min_words).collect()}


def line(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_passages_go_from_later_documents_only(spark):
    passage, split = line("p", 55), "\n".join(line(f"q{k}x", 20) for k in range(3))
    rows = [(5, "intro a\n" + passage + "\noutro a"), (2, "first b\n" + passage + "\nlast b"),
            (9, f"one\n{split}\ntwo"), (7, f"{split}\n\nother end"), (11, "nothing shared here"),
            (12, f"x\n{split}\ny\n{passage}\nz"), (13, "short shared line"), (14, "short shared line\nmore"),
            (15, "padded\n  " + passage + "\t\nend")]
    out = result(frame(spark, rows))
    text = {i: r.text for i, r in out.items()}
    assert text[2] == dict(rows)[2] and text[7] == dict(rows)[7]
    assert text[5] == "intro a\noutro a" and text[9] == "one\ntwo" and text[12] == "x\ny\nz" and text[15] == "padded\nend"
    for i in (11, 13, 14):
        assert text[i] == dict(rows)[i] and out[i].n_deleted == 0
    assert out[12].owners == [2, 7] and out[5].owners == [2]


def test_blocks_in_other_order_and_twice(spark):
    a, b = line("a", 60), line("b", 60)
    out = result(frame(spark, [(1, f"{a}\n{b}"), (2, f"{b}\nkeep\n{a}\nkeep too\n{b}")]))
    assert out[2].text == "keep\nkeep too" and out[1].n_deleted == 0


def test_ends_of_blocks_that_fewer_documents_share(spark):
    a = line("a", 60)
    out = result(frame(spark, [(1, f"{a}\nshort x"), (2, f"{a}\nshort y"), (3, f"{a}\nshort y"),
                               (4, f"short z\n{a}"), (5, f"short z\n{a}\nshort y")]))
    assert {i: r.text for i, r in out.items()} == {1: f"{a}\nshort x", 2: "short y", 3: "", 4: "short z", 5: ""}
    assert out[3].owners == [1, 2] and out[5].owners == [1, 2, 4]


def test_blank_lines_go_with_their_block(spark):
    block = line("a", 30) + "\n\n" + line("b", 30)
    out = result(frame(spark, [(1, block + "\n\nend"), (2, "start\n\n" + block + "\n\nother")]))
    assert out[2].text == "start\n\nother"  # the blank line after the block goes with it
    assert out[1].text == block + "\n\nend"


def test_large_groups_make_few_pairs(spark):
    shared = line("s", 60)
    rows = [(i, f"own {i}\n{shared}\ntail {i}") for i in range(400)] + [(1000 + i, f"{line('c', 70)}\ncopy") for i in range(300)]
    docs = frame(spark, rows)
    from promolift.llm.common import cut
    profile = cut(L.profiles(docs))
    assert L.deletions(profile).count() == 399 + 299
    out = result(docs)
    assert all(out[i].text == f"own {i}\ntail {i}" for i in range(1, 400)) and out[0].n_deleted == 0


def test_edge_cases(spark, edge, nothing):
    rows = edge.collect()
    out = L.dedup_lines(edge)
    assert out.columns == [*edge.columns, "n_lines", "n_deleted", "owners"]
    got = out.collect()
    assert len(got) == len(rows)
    before = Counter((r.doc_id, r.text) for r in rows)
    kept = Counter((r.doc_id, r.text) for r in got if not r.n_deleted)
    assert not kept - before
    changed = {r.doc_id: r.text for r in got if r.n_deleted}
    assert changed == {8: "and one more line", 11: ""}  # equal rows 7 are one document and keep their text
    assert L.dedup_lines(nothing).count() == 0
    again = L.dedup_lines(L.dedup_lines(edge))
    assert again.columns == out.columns


def brute(rows, min_words):
    """Lines of a document that lie in a common run of at least min_words words with an earlier one."""
    gone = {}
    for n, (doc, lines) in enumerate(rows):
        hit = set()
        for _, other in rows[:n]:
            for a in range(len(lines)):
                for b in range(len(other)):
                    k = words = 0
                    while a + k < len(lines) and b + k < len(other) and lines[a + k] == other[b + k]:
                        words += len(lines[a + k].split())
                        k += 1
                    if words >= min_words:
                        hit.update(range(a, a + k))
        gone[doc] = hit
    return gone


def test_every_common_run_of_random_documents_goes(spark):
    rng = random.Random(3)
    pool = [line(f"l{k}x", rng.randint(5, 40)) for k in range(60)]
    rows = []
    for doc in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(pool) - 5)
            lines += pool[at:at + rng.randint(2, 5)]
        rows.append((doc, lines))
    docs = frame(spark, [(d, "\n".join(x)) for d, x in rows])
    out = result(docs)
    cuts = {r.doc["_id"]: r.ranges for r in L.deletions(L.profiles(docs)).collect()}
    want = brute(rows, 50)
    assert any(want.values()) and not all(want.values())
    for n, (doc, lines) in enumerate(rows):
        gone = {i for r in cuts.get(doc, []) for i in range(r["first"], r["last"] + 1)}
        assert gone <= want[doc]  # only lines of common runs go
        assert out[doc].text == "\n".join(x for i, x in enumerate(lines) if i not in gone) and out[doc].n_deleted == len(gone)
        # and no run of that size stays: what goes is replaced by a line that no document has
        stays = [f"gone {doc} {i}" if i in gone else x for i, x in enumerate(lines)]
        assert not brute([*rows[:n], (doc, stays)], 50)[doc]


def test_many_owners_make_few_rows(spark):
    passages = [line(f"p{k}x", 55) for k in range(200)]
    docs = frame(spark, [*enumerate(passages), (1000, "\n".join(passages))])
    profile = L.profiles(docs)
    hits = L.deletions(profile)
    assert [len(r.ranges) for r in hits.collect()] == [200]
    out = result(docs)[1000]
    assert out.text == "" and out.owners == list(range(200))


def test_repeated_lines_are_aligned_in_near_linear_time():
    import random as r
    import time

    rng = r.Random(5)
    for make, common in ((lambda i: i % 2, True), (lambda i: rng.randrange(3), False), (lambda i: 0, True), (lambda i: i % 1000, True)):
        a, b = [make(i) for i in range(50_000)], [make(i + 1) for i in range(50_000)]
        pairs = [(2, [i for i, x in enumerate(a) if x == v], [i for i, x in enumerate(b) if x == v]) for v in sorted(set(a) & set(b))]
        start = time.time()
        assert bool(L.aligned(pairs, 50)) == common  # random lines share no run of 25
        assert time.time() - start < 20


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14), st.integers(1, 4))
def test_aligned_ranges_are_common_blocks(a, b, least):
    pairs = [(1, [i for i, x in enumerate(a) if x == v], [i for i, x in enumerate(b) if x == v]) for v in set(a) & set(b)]
    ranges = L.aligned(pairs, least)
    for first, last in ranges:
        part = a[first:last + 1]
        assert len(part) >= least and any(b[j:j + len(part)] == part for j in range(len(b)))
    # whatever is left has no common block of that size
    gone = {i for first, last in ranges for i in range(first, last + 1)}
    for i in range(len(a) - least + 1):
        if not gone & set(range(i, i + least)):
            assert not any(a[i:i + least] == b[j:j + least] for j in range(len(b)))
    longest = max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, 15) if a[i:i + k] == b[j:j + k] and i + k <= len(a) and j + k <= len(b)), default=0)
    if longest < least:
        assert not ranges
