"""Cases of the second review: what the first versions left undone."""

from gradebook.llm import line_dedup, pii
from gradebook.llm.common import table


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# ---------------------------------------------------------------------------------------- lines

def test_exact_copy_with_a_short_line_does_not_survive(spark):
    long = "this line stands in many documents of the corpus"
    docs = [(1, f"{long}\nThe end.\nanother line that is long enough"), (2, f"{long}\nThe end.\nanother line that is long enough"),
            (3, f"{long}\n \n the END. \n"), (4, f"{long}\nThe end!"), (5, f"The end.\n{long}\nnew\nnew"), (6, "The end."), (7, "The end.\n"),
            (8, f"new\nThe end.\n{long}"), (9, f"{long}\n\t"), (None, "The end?"), (10, f"the end?\n{long}")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_duplicate_lines(frame(spark, docs)).collect()}
    assert got == {1: docs[0][1], 4: "The end!", 5: "new", None: "The end?"}


def test_short_lines_are_compared_exactly(spark):
    got = line_dedup.duplicate_lines(frame(spark, [(1, "short one\na\n\t"), (2, "Short one \nb\n\t"), (3, "short on\nb\nb")])).collect()
    assert {(r["doc_id"], r["line_no"], r["first_doc_id"], r["first_line_no"], r["edits"]) for r in got} == \
        {(2, 0, 1, 0, 0), (3, 1, 2, 1, 0), (3, 2, 2, 1, 0)}


def test_a_document_of_very_many_lines_is_cut_in_linear_time(spark):
    from time import time
    rows = [(1, "\n".join(["one line that is repeated over and over"] * 100_000 + ["end"])), (2, "other")]
    start = time()
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_duplicate_lines(frame(spark, rows)).collect()}
    assert got == {1: "one line that is repeated over and over\nend", 2: "other"} and time() - start < 60


# ---------------------------------------------------------------------------------------- personal data

def test_neighbouring_numbers_come_back(spark, sf):
    model = pii.fit(table(spark, "/root/testdata/sf0.1", "documents"))
    rows = [(1, "call +1 (826) 555-4081 190.137.223.204 now"), (2, "at 170.106.47.218 +1 (843) 555-7672"), (3, "+1 (843) 555-7672 170.106.47.218"),
            (4, "cards 7536784127813050 4845168114407329 here")]
    found = pii.find_spans(frame(spark, rows), model)
    got = {r["doc_id"]: {rows[r["doc_id"] - 1][1][x.s:x.e] for x in r["all"]} for r in found.select("doc_id", "all").collect()}
    assert {"+1 (826) 555-4081", "190.137.223.204"} <= got[1] and {"+1 (843) 555-7672", "170.106.47.218"} <= got[2] & got[3]
    assert {"7536784127813050", "4845168114407329"} <= got[4]
