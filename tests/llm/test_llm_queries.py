"""Registered operators and the pipeline on the smallest tables: SQL twins, columns, stage by stage against brute force."""

import sys

import pytest
from harness import compare, duck

import __spark_entry__ as entry
import corpus_pipeline as C
from uwspark.llm import queries, toxicity
from uwspark.llm.common import table
from uwspark.staging import stage

sys.path.insert(0, __file__.rpartition("/")[0])
SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id", "fingerprint", "component_id"},
    "op3": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op4": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op5": {"doc_id", "held_out", "score", "predicted"},
    "op6": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op7": {"page_id", "host", "path", "rule", "verdict"},
    "op9": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op11": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
    "op12": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op13": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
}


def test_all_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and len(C.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert COLUMNS.get(name.split("_")[0], set()) <= set(df.columns)
    sql = queries.TWINS.get(name)
    if sql is None:
        n = df.count()
        assert n == table(spark, SF, "documents").count() * (2 if name.startswith("op8") else 1)
    else:
        ok, message = compare(df, duck(SF), sql)
        assert ok, message


def test_stages(spark):
    from test_decontaminate import brute as brute_items
    from test_lines import brute as brute_lines
    from test_similar import brute as brute_near

    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    rows = {r.doc_id: r for r in docs.collect()}

    one = stage(C.drop_toxic(spark, docs, SF))
    model = toxicity.learn(docs, labels)
    scorer = toxicity.Scorer(model)
    assert {r.doc_id for r in one.collect()} == {i for i, r in rows.items() if scorer.score(r.text) < 0.5}

    two = stage(C.drop_repeated_lines(spark, one, SF))
    left = {int(i): (n, t) for i, _, n, t in brute_lines([(r.doc_id, r.text) for r in one.collect()])}
    got = {r.doc_id: r.text for r in two.collect()}
    assert got == {i: t for i, (n, t) in left.items() if not n or t.strip(" \t\n\x0b\x0c\r")}

    three = stage(C.keep_one_of_each(spark, two, SF))
    kept = {r.doc_id for r in three.collect()}
    assert kept == {g[0][1] for g in brute_near([*got.items()])}

    four = stage(C.drop_contaminated(spark, three, SF))
    texts = [(r.doc_id, r.text) for r in three.collect()]
    found = {int(x[0]) for x in brute_items(texts, [tuple(r) for r in table(spark, SF, "benchmark").collect()])}
    assert {r.doc_id for r in four.collect()} == {i for i, _ in texts} - found
    assert all(x.columns == docs.columns for x in (one, two, three, four))

    five = C.encode(spark, four, SF).collect()
    assert {r.doc_id for r in five} == {r.doc_id for r in four.collect()} and all(r.exact for r in five)


def test_pipeline_on_odd_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _rank int"
    rows = [(1, "a line of words here\nanother line of words", "en", None, 40, 1), (2, None, None, None, None, 1), (None, "only this one", "en", "s", 3, 1)]
    rows += [(3, "", "en", "s", 0, 1), (1, "a line of words here\nanother line of words", "en", None, 40, 1)]
    for name, kept in (("odd", rows), ("none", [])):
        spark.createDataFrame(kept, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = C.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(out) > 0) == bool(kept) and all(r.exact for r in out)
