import random
import re
from collections import defaultdict

from uwspark.llm import lines as L


def brute(rows):
    """The law as plain pairs: lines of one leaf that differ in one place, then templates that do."""
    rank = lambda i: 1 << 63 if i is None else i
    split = lambda line: re.findall(r"[^\x20\x09-\x0D]+", line)

    def key(line):
        tokens = tuple("<*>" if re.search("[0-9]", t) else t for t in split(line))
        general = 10 * sum(t != "<*>" for t in tokens) >= 6 * len(tokens)
        return (tokens if general else tuple(split(line))), general

    def fits(k):
        return 10 * sum(t not in ("<*>", None) for t in k) >= 6 * len(k) and any(t not in ("<*>", None) for t in k[3:])

    def opened(ks):
        """template -> lines (or templates) that become it by opening one place, at least two."""
        out = defaultdict(set)
        for k in ks:
            for p in range(3, len(k)):
                if k[p] not in ("<*>", None):
                    t = k[:p] + (None,) + k[p + 1 :]
                    if fits(t):
                        out[t, p].add(k)
        return {t: ks for t, ks in out.items() if len(ks) > 1}

    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k[0]) >= 3:
                first[k] = min(first.get(k, 1 << 63), rank(i))
    whole = {k[0]: r for k, r in first.items() if k[1] and len(k[0]) > 3}
    one = opened(whole)
    least_one = {t: min(whole[k] for k in ks) for (t, _), ks in one.items()}
    two = opened(least_one)
    best_one = dict(least_one)
    for ks in two.values():
        for k in ks:
            best_one[k] = min(best_one[k], *(least_one[x] for x in ks))
    best = dict(first)
    for (t, _), ks in one.items():
        for k in ks:
            best[k, True] = min(best[k, True], best_one[t])
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n") if t else []
        left = [x for x in all_ if len((k := key(x))[0]) < 3 or rank(i) <= best[k]]
        out.append((str(i), len(all_), len(all_) - len(left), "\n".join(left)))
    return sorted(out)


def test_planted_templates(spark):
    """Fixed expectations: what each later document keeps of its only line."""
    rows = [
        (1, "job started on node alpha with normal load"), (2, "job started on node beta with normal load"),  # free word in the fifth place
        (3, "copied from alice to bob without any error at all"), (4, "copied from alice to dan without any error at all"),
        (5, "copied from alice to eve without any error at all"),
        (6, "disk check of first volume was fine again"), (7, "disk check of second volume was bad again"),  # two places at once
        (8, "link of port red to host ruby is up again now"), (9, "link of port red to host opal is up again now"),
        (10, "link of port tan to host jade is up again now"), (11, "link of port tan to host onyx is up again now"),  # second free word
        (12, "one two three four"), (13, "one two three five"),  # nothing constant beyond the lead
        (14, "10 20 30 40 total"), (15, "11 21 31 41 total"),  # mostly variables
        (16, "took 15 ms to answer the call"), (17, "took 97 ms to answer the call"),
        (18, "alpha said a word to them"), (19, "beta said a word to them"),  # free word in the lead
    ]
    more = [(100 + i, f"job started as other thing number {w} then ended well") for i, w in enumerate("abcdefghij")]
    for all_ in (rows, rows + more):
        df = spark.createDataFrame(all_, "doc_id bigint, text string")
        kept = {r.doc_id for r in L.deduplicated_lines(df).collect() if r.kept_text}
        assert kept & set(range(1, 20)) == {1, 3, 6, 7, 8, 12, 13, 14, 15, 16, 18, 19}


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = "alpha beta gamma delta eps zeta eta theta".split()
    frames = ["user {} logged in from host {} at port 22 today", "one {} of the many lines here with {} inside", "error code {} in module core of the big {} system"]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                text.append(rng.choice(frames).format(rng.choice(words + ["7", "x9"]), rng.choice(words)))
            else:
                text.append(" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))))
        rows.append((i, "\n".join(text)))
    hot = "All rights reserved by the makers of this page.\r"
    rows += [(100 + i, hot + "\n" + rows[i][1]) for i in range(40)] + [(200, None), (201, ""), (202, "\n\n"), (None, hot), (None, "null only line of text here")]
    rows += [(5, hot), (5, hot), (300, ("word " * 2000) + "\n" + hot), (301, "same line in one doc\nsame line in one doc")]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id bigint, text string, _line int, _drop string").repartition(3)
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in L.deduplicated_lines(df).collect())
    assert got == brute(rows)
    assert L.deduplicated_lines(df.limit(0)).count() == 0


def test_many_rows_without_id(spark):
    rows = [(None, f"line of row {w} with its own words\ncommon line of all rows") for w in "abcdefgh" * 30] + [(1, "common line of all rows")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [r for r in L.deduplicated_lines(df).collect() if r.doc_id is None]
    assert len(got) == 240 and all(r.n_dropped == 1 and r.kept_text.startswith("line of row") for r in got)


def test_carried_columns(spark):
    df = spark.createDataFrame([(1, "a b c\nd e f", 7, "x"), (2, "a b c\ng h i", 8, None)], "doc_id bigint, text string, _bytes int, _id string")
    got = {r.doc_id: r for r in L.deduplicated_lines(df, carry=["_bytes", "_id"]).collect()}
    assert got[2].kept_text == "g h i" and got[2]._bytes == 8 and got[1]._id == "x" and got[2]._id is None
