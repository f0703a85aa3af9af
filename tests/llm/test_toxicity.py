import random
import zlib

from uwspark.llm import toxicity as T


def corpus(n=900):
    rng = random.Random(6)
    syllables = "ba be bi bo bu da de di do du la le li lo lu ma me mi mo".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = ["zorkfool", "grimtwit", "vexoaf", "numbskrull"]
    docs, labels = [], []
    for i in range(n):
        text = [word() for _ in range(rng.randint(40, 150))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        docs.append((i, " ".join(text), "x", 1))
        labels.append((i, int(toxic), 1))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    odd = [(5000, None, "x", 1), (5001, "", "x", 1), (None, "a b c", "x", 1), (3, docs[3][1], "x", 1), (5002, "ba " * 40000 + "zorkfool", "x", 1)]
    df = spark.createDataFrame(docs + odd, "doc_id bigint, text string, score string, _key int")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (7, None, 1), (3, 0, 1)], "doc_id bigint, toxic int, _y int")
    model = T.learn(df, lab)
    got = T.scored(df, model).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {i: y for i, y, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    kept = T.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(1 - r.predicted for r in got)
    assert T.scored(df.limit(0), model).count() == 0
    # nothing held out is learned from: other labels there change nothing
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, 1) for i, y, _ in labels]
    assert T.learn(df, spark.createDataFrame(flipped, "doc_id bigint, toxic int, _y int")) == T.learn(
        df, spark.createDataFrame(labels, "doc_id bigint, toxic int, _y int")
    )


def test_without_labels(spark):
    docs, _ = corpus(20)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, score string, _key int")
    model = T.learn(df, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.score for r in T.scored(df, model).collect()} == {0.001}
