"""Rows without an id, or with the id of another row, are documents of their own in every stage of the pipeline."""

import random

import corpus_pipeline as C

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)


def told(df):
    return sorted((str(r.doc_id), r.text) for r in df.collect())


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, clean, other, more = say(20), say(60), say(60), say(60)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    dirty = f"{say(10)} {item} {say(10)}"

    rows = [(None, dirty), (None, clean), (7, dirty), (7, other), (8, more)]
    assert told(C.drop_contaminated(spark, frame(spark, rows), str(tmp_path))) == sorted([("None", clean), ("7", other), ("8", more)])

    rows = [(None, clean), (None, clean), (None, other), (None, f"{other} end"), (4, more), (4, more), (4, f"{more} end")]
    got = told(C.keep_one_of_each(spark, frame(spark, rows), ""))
    assert len(got) == 3 and [i for i, _ in got] == ["4", "None", "None"]
    assert {t.removesuffix(" end") for _, t in got} == {clean, other, more}

    line = "this very line stands in all of them"
    rows = [(None, f"{line}\n{clean}"), (None, f"{line}\n{other}"), (5, f"{line}\n{more}"), (5, say(60)), (None, clean)]
    got = told(C.drop_repeated_lines(spark, frame(spark, rows), ""))
    assert ("5", f"{line}\n{more}") in got and ("None", other) in got
    assert sum(line in t for _, t in got) == 1 and sum(clean in t for _, t in got) == 1 and len(got) == 4
