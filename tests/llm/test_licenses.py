"""Licence scan: exact notices, edited notices, spans, brute force."""

from promolift.llm import licenses as L
from llm_data import frame


def found(spark, rows, **more):
    return sorted((r.doc_id, r.license, round(r.coverage, 3), r.span_start, r.span_end) for r in L.scan(frame(spark, rows, clash=True), **more).collect())


def test_each_template_is_found_where_it_stands(spark):
    rows = [(i, f"some words before. {L.TEMPLATES[n]} And after it.") for i, n in enumerate(sorted(L.TEMPLATES))]
    got = found(spark, rows)
    for i, name in enumerate(sorted(L.TEMPLATES)):
        mine = [g for g in got if g[0] == i and g[1] == name]
        assert len(mine) == 1 and mine[0][2] == 1.0
        text = rows[i][1][mine[0][3]:mine[0][4]]
        assert text == L.TEMPLATES[name].rstrip(".\"/")


def test_edited_and_absent(spark):
    mit = L.TEMPLATES["mit-text"].split()
    edited = " ".join(mit[:30] + ["extra", "words"] + mit[31:70] + mit[72:])
    rows = [(1, edited), (2, "no licence here, only the license word and rights"), (3, " ".join(mit[:20])),
            (4, L.TEMPLATES["mit"] + "\n" + L.TEMPLATES["all-rights-reserved"] + "\n" + L.TEMPLATES["mit"]),
            (5, L.TEMPLATES["gpl-3.0"].upper().replace(" ", "  \n"))]
    got = found(spark, rows)
    assert [g[1] for g in got if g[0] == 1] == ["mit-text"] and 0.9 < [g for g in got if g[0] == 1][0][2] < 1
    assert not [g for g in got if g[0] in (2, 3)]
    assert [g[1] for g in got if g[0] == 4] == ["all-rights-reserved", "mit", "mit"]
    assert [g[1] for g in got if g[0] == 5] == ["gpl-3.0"]


def test_repeated_notices_are_all_found(spark):
    names = ["all-rights-reserved", "mit", "gpl-3.0", "mit-text"]
    rows = [(10 * i + n, " ".join([L.TEMPLATES[name]] * n)) for i, name in enumerate(names) for n in (1, 2, 3, 4, 6)]
    got = found(spark, rows)
    for i, name in enumerate(names):
        for n in (1, 2, 3, 4, 6):
            mine = [g for g in got if g[0] == 10 * i + n and g[1] == name]
            assert len(mine) == n and all(g[2] == 1.0 for g in mine)
            assert all(a[4] <= b[3] for a, b in zip(mine, mine[1:]))


def test_words_put_into_a_long_notice(spark):
    words = L.TEMPLATES["mit-text"].split()
    for extra in (10, 20):
        text = " ".join(words[:45] + ["added"] * extra + words[45:])
        assert [(g[1], g[2]) for g in found(spark, [(1, text)]) if g[1] == "mit-text"] == [("mit-text", 1.0)]


def test_spans_are_places_of_the_text(spark):
    rows = [(i, "İ" * i + " before. " + L.TEMPLATES["mit"]) for i in range(5)]
    assert [rows[g[0]][1][g[3]:g[4]] for g in found(spark, rows) if g[1] == "mit"] == [L.TEMPLATES["mit"].rstrip(".")] * 5


def test_equals_plain_search_on_documents(tables):
    """Notices in the test documents are verbatim, so plain search finds the same ones."""
    rows = [tuple(r) for r in tables["documents"].select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.license) for r in L.scan(tables["documents"]).collect() if r.coverage == 1)
    want = sorted((d, n) for d, t in rows for n, v in L.TEMPLATES.items() for _ in range((t or "").count(v)))
    assert got == want and want


def test_edge_cases(spark, edge, nothing):
    assert L.scan(edge).count() == 0
    assert L.scan(nothing).count() == 0
    both = [(None, "All rights reserved."), (1, "All rights reserved."), (1, "All rights reserved."), (2, None)]
    assert [g[0] for g in sorted(((r.doc_id or 0), r.license) for r in L.scan(frame(spark, both)).collect())] == [0, 1, 1]
    for bad in ({"x": "two words"}, {"x": ""}):
        try:
            L.Index(bad)
            raise AssertionError("short template accepted")
        except ValueError:
            pass
