"""Extra columns with awkward or clashing names, ids of another type, long texts."""

import pytest

import llm_brute as brute
from rowmill.llm.common import packed
from rowmill.llm.decontaminate import contamination
from rowmill.llm.line_dedup import dedup_lines
from rowmill.llm.minhash_dedup import near_duplicates
from rowmill.llm.quotes import link_quotes
from rowmill.llm.substring_dedup import remove_repeats
from rowmill.llm.toxicity import toxicity

LINE = "A line of at least forty code points that is in many documents"
PASSAGE = " ".join(f"word{k}" for k in range(40))
ROWS = [(k, f"start {k} {PASSAGE}\n{LINE}\nend {k}") for k in range(6)] + [(None, None), (7, "")]
NAMES = ["Doc_Id", "Text", "content-type", "my col", "row", "a`tick", "x.y"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, *range(7)) for i, t in ROWS], "doc_id long, text string, " + ", ".join(f"c{k} int" for k in range(7)))
    return df.toDF("doc_id", "text", *NAMES).repartition(3).cache()


def kept(row):
    return [f for f in row.asDict() if f != "doc_id"] == NAMES


def test_line_dedup(docs):
    got = dedup_lines(docs).collect()
    assert sorted((r.row["doc_id"] if r.row["doc_id"] is not None else -1, brute.sha(r.kept_text)) for r in got) == sorted(
        (-1 if i is None else i, h) for i, _, _, h in brute.line_dedup(ROWS)) and all(kept(r.row) for r in got)


def test_substring_dedup(docs):
    got = remove_repeats(docs).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == sorted((n, d) for _, n, d, _ in brute.repeats(ROWS))
    assert all(kept(r.row) for r in got)


def test_contamination(spark, docs):
    bench = spark.createDataFrame([("b", PASSAGE)], "item_id string, text string")
    got = contamination(docs, bench).collect()
    assert sum(r.contaminated for r in got) == 6 and all(kept(r.row) for r in got)


def test_near_duplicates(docs):
    assert near_duplicates(docs).count() == len(ROWS)


def test_toxicity(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, toxic int")
    narrow = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, c int").withColumnRenamed("c", "content-type")
    got = toxicity(narrow, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.row["content-type"] == 1 for r in got)


def test_quotes(spark):
    rows = [(1, 1, "hello there, this is a message", 5), (1, 2, "> hello there, this is a message\nyes", 6), (None, None, None, 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, c int").toDF("conv_id", "turn", "text", "content-type")
    got = {r.row["content-type"]: r.parent_turn for r in link_quotes(df).collect()}
    assert got == {5: None, 6: 1, 7: None}


def test_ids_of_another_type_fail_early(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(ValueError, match="ids must be integers"):
        packed(df, "doc_id", "text")


def test_texts_longer_than_a_chunk(spark):
    """Over a megabyte, with repeats across the chunk's end."""
    long = "\n".join(f"line number {k} of a very long text, which goes on and on, {k * k} by now" for k in range(22000))
    rows = [(1, long), (2, "short " + PASSAGE), (3, long[:1_200_000]), (4, PASSAGE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(long.encode()) > 1 << 20
    got = sorted((r.row.doc_id, r.n_words, r.n_removed) for r in remove_repeats(df).collect())
    assert got == sorted((i, n, d) for i, n, d, _ in brute.repeats(rows))
    got = sorted((r.row.doc_id, brute.sha(r.kept_text)) for r in dedup_lines(df).collect())
    assert got == sorted((i, h) for i, _, _, h in brute.line_dedup(rows))
    got = sorted((r.id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect())
    assert got == brute.near(rows)
