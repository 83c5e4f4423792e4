from hypothesis import given, settings
from hypothesis import strategies as st

from inkgraph.operators import alignment
from inkgraph.plans import alignment_queries as queries
from inkgraph.plans.adapters import table

FOLDER = "/root/testdata/sf0.001"

TOKENS = "doc_id long, tokens array<string>"


def plain(text, tokens):
    """Next occurrence from the last end, else the last end."""
    at, out = 0, []
    for k, token in enumerate(tokens):
        start = next((p for p in range(at, len(text) - len(token) + 1) if text[p : p + len(token)] == token), None)
        begin = at if start is None else start
        at = begin + len(token)
        out.append((k, token, begin, at, start is not None))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("ab é", max_size=30), st.lists(st.text("ab é", max_size=3), max_size=12))
def test_places_equal_a_plain_search(text, tokens):
    assert alignment._places(text, tokens) == plain(text, tokens)


def test_aligned_rows(spark):
    texts = spark.createDataFrame([(1, "The naïve 😀 cat, the cat.", "x"), (2, None, "x"), (3, "", "x"), (4, "no list", "x")], "doc_id long, text string, tokens string")
    lists = spark.createDataFrame([(1, ["The", "😀", "``", "cat", "the", "Cat", "."]), (2, ["a"]), (3, []), (5, ["lost", None, "x"])], TOKENS)
    got = sorted(tuple(r) for r in alignment.align_tokens(texts, lists).collect())
    assert [r[1:] for r in got if r[0] == 1] == plain("The naïve 😀 cat, the cat.", ["The", "😀", "``", "cat", "the", "Cat", "."])
    assert [r[1:] for r in got if r[0] == 2] == [(0, "a", 0, 1, False)]
    assert [r[1:] for r in got if r[0] == 5] == [(0, "lost", 0, 4, False), (1, None, 4, 4, False), (2, "x", 4, 5, False)]
    assert {r[0] for r in got} == {1, 2, 5}


def test_lists_from_rows_and_report(spark):
    rows = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (1, 2, "zz")], "doc_id long, idx int, text string")
    lists = alignment.token_lists(rows)
    assert lists.first().tokens == ["a", "b", "zz"]
    texts = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert tuple(alignment.alignment_report(alignment.align_tokens(texts, lists)).first()) == (1, 3, 2, 5)


def test_queries_equal_a_plain_search_over_their_tables(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, FOLDER, "documents").collect()}
    want = {(d.doc_id, *row) for d in queries.foreign_lists(spark, FOLDER).collect() if d.tokens for row in index_places(texts[d.doc_id], d.tokens)}
    assert {tuple(r) for r in queries.QUERIES["tokens_aligned"](spark, FOLDER).collect()} == want
    report = {r.doc_id: (r.tokens, r.found) for r in queries.QUERIES["tokens_alignment_report"](spark, FOLDER).collect()}
    assert sum(n for n, _ in report.values()) == len(want) and sum(k for _, k in report.values()) == sum(w[-1] for w in want)


def index_places(text, tokens):
    """As plain, with the library of the language instead of a loop over places."""
    at, out = 0, []
    for k, token in enumerate(tokens):
        try:
            start, found = text.index(token, at), True
        except ValueError:
            start, found = at, False
        at = start + len(token)
        out.append((k, token, start, at, found))
    return out
