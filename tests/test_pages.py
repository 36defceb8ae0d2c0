import time

import pytest

from tamis.operators import segment
from tamis.plans import catalogue, extra

BODY = "Une phrase assez longue pour une page du document, et plus encore."


@pytest.mark.parametrize("marker", [segment.MARKER, segment.SEEN_MARKER])
def test_odd_marks_and_long_documents(spark, marker):
    """Numbers beyond an int, blanks after a mark, blanks around a page, thousands of pages."""
    odd = f"[[page 99999999999]]\n{BODY}\n[[page 2147483647]]\n {BODY} \n[[page {'0' * 30}7]]" + " " * 200_000 + f"\n{BODY}"
    long = "".join(f"[[page {k}]]\n{BODY}\n" for k in range(3_000))
    docs = spark.createDataFrame([(1, odd), (2, long), (3, None), (4, "[[page 1]]"), (5, " " * 50 + "[[page 1]]")], "k bigint, text string")
    got = segment.page_segments(docs, "k", "text", marker=marker).collect()
    assert [r.page for r in got if r.k == 1] == [None, 2147483647, 7]
    assert [r.page for r in got if r.k == 2] == list(range(3_000)) and {r.k for r in got} == {1, 2}
    assert all({1: odd, 2: long}[r.k][r.a : r.b] == r.texte == BODY for r in got)
    assert segment.pack(segment.page_segments(docs, "k", "text", marker=marker), ["k", "page"], "texte", "a").count() == 3_003


def test_packed_chunks_of_a_page_whose_number_is_no_int(spark, tmp_path):
    spark.createDataFrame([(1, f"[[page 99999999999]]\n{BODY}\n[[page 2]]\n{BODY}")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.page, r.texte) for r in catalogue.packed_chunks(spark, str(tmp_path)).orderBy("a").collect()] == [(None, BODY), (2, BODY)]


def test_seen_pages_with_blanks_after_a_mark(spark, tmp_path):
    spark.createDataFrame([(1, f"［[pаge ７]]{' ' * 200_000}\n{BODY}")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.page, r.texte) for r in extra.seen_pages(spark, str(tmp_path)).collect()] == [(7, BODY)]


@pytest.mark.parametrize("query", [extra.seen_pages, catalogue.page_segments, catalogue.packed_chunks])
def test_bytes_that_are_no_utf8_end_no_job(spark, tmp_path, query):
    rows = spark.createDataFrame([(1, f"[[page 1]]\n{BODY}".encode() + b" \xff fin\n" + f"[[page 2]]\n{BODY}".encode()), (2, f"[[page 3]]\n{BODY}".encode())], "doc_id bigint, text binary")
    rows.coalesce(1).write.parquet(str(tmp_path / "bytes"))
    spark.read.schema("doc_id bigint, text string").parquet(str(tmp_path / "bytes")).write.parquet(str(tmp_path / "documents.parquet"))
    got = query(spark, str(tmp_path)).orderBy("page").collect()
    assert [(r.page, r.a, r.texte) for r in got] == [(1, 11, f"{BODY} \ufffd fin"), (2, 11 + len(BODY) + 7 + 11, BODY), (3, 11, BODY)]


def test_packed_chunks_of_a_word_of_any_length(spark, tmp_path):
    """A word without stops, as encoded data: its packing takes time in proportion to its length."""
    word = "x" * 60_000
    spark.createDataFrame([(1, f"[[page 1]]\n{BODY}\n{word}\n{BODY}")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.process_time()
    assert segment._sentence_ends(f"{word}. Fin {word[:40_000]}") == {60_001}
    assert time.process_time() - began < 2
    got = catalogue.packed_chunks(spark, str(tmp_path)).orderBy("rang").collect()
    assert got[0].texte.startswith(BODY) and got[-1].texte.endswith(BODY) and all(r.b <= s.b and s.a <= r.b for r, s in zip(got, got[1:]))
