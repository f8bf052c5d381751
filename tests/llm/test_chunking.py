from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm.chunking import fields_with_limits, piece_rows, pieces_of, split_oversized


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n。́", max_size=400), st.integers(1, 40), st.integers(0, 45))
def test_pieces_are_lossless_and_within_the_limit(text, limit, overlap):
    trimmed = text.strip(" \t\r\n")
    pieces = pieces_of(text, limit, overlap)
    assert "".join(text[core:end] for _, core, end in pieces) == trimmed
    assert all(0 < end - start <= limit for start, _, end in pieces)
    kept = max(0, min(overlap, limit - 1))
    for (_, _, before), (start, core, _) in zip(pieces, pieces[1:]):
        assert core == before and (core - start == kept or start == pieces[0][0])
    assert (len(pieces) > 1) == (len(trimmed) > limit)


def test_natural_ends():
    text = "One sentence here. Another sentence there.\n\nA new paragraph that is a little longer than the rest."
    assert [text[c:e].strip() for _, c, e in pieces_of(text, 50, 0)] == ["One sentence here. Another sentence there.", "A new paragraph that is a little longer than the", "rest."]


def test_rows(spark):
    passages = spark.createDataFrame([(1, "x" * 25, None, "clash"), (2, None, "  ", "clash"), (3, " ok ", "y" * 10, "clash"), (4, "z" * 100_000, "", "clash")], "passage_id long, text string, heading string, pieces string")
    limits = spark.createDataFrame([("text", 10, 2), ("heading", 10, 2)], "field_name string, max_chars int, overlap_chars int")
    split = split_oversized(fields_with_limits(passages, limits))
    assert sorted((r.passage_id, r.field_name, len(r.pieces)) for r in split.collect() if r.passage_id < 4) == [(1, "heading", 0), (1, "text", 4), (2, "heading", 0), (2, "text", 0), (3, "heading", 1), (3, "text", 1)]
    rows = piece_rows(split)
    assert [(r.piece_index, r.repeated_chars, len(r.piece)) for r in rows.filter("passage_id = 1").orderBy("piece_index").collect()] == [(1, 0, 8), (2, 2, 10), (3, 2, 10), (4, 2, 3)]
    assert rows.filter("passage_id = 3 and field_name = 'text'").first().piece == "ok"
    assert split_oversized(fields_with_limits(passages.limit(0), limits)).count() == 0
    assert split_oversized(fields_with_limits(passages, limits.limit(0))).count() == 0
