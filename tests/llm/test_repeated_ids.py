"""Rows that share a doc_id but not a text, null ids, and clips beside columns of their names."""

import random

from pingmill.llm import chosen_path, media, suffix_dedup

FIELDS = "doc_id long, text string, rep long, set_id string"


def text(seed, change=()):
    words = random.Random(seed).choices([f"w{k}" for k in range(500)], k=120)
    for at in change:
        words[at] = f"changed{at}"
    return " ".join(words)


def classes(spark, rows):
    out = chosen_path.jaccard_classes(spark.createDataFrame([(*r, 1, "x") for r in rows], FIELDS)).collect()
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in out), key=str)


def test_rows_of_one_id_link_by_their_own_texts(spark):
    rows = [(5, text(1)), (5, text(2)), (6, text(1, [3])), (7, text(2, [90])), (8, text(3)), (8, text(3)), (4, text(2, [7]))]
    assert classes(spark, rows) == sorted([(5, 5, 1), (5, 4, 2), (6, 5, 1), (7, 4, 2), (4, 4, 2), (8, 8, 1), (8, 8, 1)], key=str)


def test_null_ids_link_and_empty_texts_do_not(spark):
    rows = [(None, text(1)), (3, text(1, [5])), (None, text(9)), (4, None), (4, ""), (9, " ")]
    assert classes(spark, rows) == sorted([(None, 3, 1), (3, 3, 1), (None, None, 0), (4, 4, 0), (4, 4, 0), (9, 9, 0)], key=str)


def test_clips_beside_columns_of_their_names(spark):
    df = spark.createDataFrame([(1, "some text " * 500, 0.5, 7)], "doc_id long, text string, score double, clip int")
    stored = df.select("doc_id", "score", "clip", media.to_avi(df.text).alias("media"))
    out = media.clip_rows(stored)
    assert len(set(out.columns)) == len(out.columns) and {"doc_id", "score", "clip"} <= set(out.columns)
    row = out.first()
    assert (row.doc_id, row.score, row.clip) == (1, 0.5, 7) and out.count() >= 1


def test_the_greatest_id_and_null_ids_are_told_apart(spark):
    last = (1 << 63) - 1
    rows = [(last, text(1)), (None, text(2)), (7, text(1)), (7, text(2)), (None, None), (last, ""), (-last - 1, text(3))]
    out = suffix_dedup.remove_repeats(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in out), key=str) == sorted(
        ((i, len(t or ""), len(t or "") if i in (last, None) else 0) for i, t in rows), key=str)
