import random
import re
from itertools import combinations

from uwspark.llm import decontaminate as D


def test_mask_survives_two_substitutions():
    for mask in D.MASKS:
        assert mask[-1] == D.SPAN - 1
        for gone in combinations(range(D.WINDOW), D.SUBSTITUTIONS):
            assert any(all(at + p not in gone for p in mask) for at in range(D.WINDOW - D.SPAN + 1))


def brute(docs, items):
    words = lambda t: [w for w in re.split(r"[^\w]+", (t or "").lower()) if w]
    out = set()
    for i, t in docs:
        d = words(t)
        for j, u in items:
            q = words(u)
            if len(q) < D.SPAN:
                if q and any(d[k : k + len(q)] == q for k in range(len(d))):
                    out.add((str(i), str(j), len(q), len(q)))
                continue
            w = min(D.WINDOW, len(q))
            need = D.WINDOW - D.SUBSTITUTIONS if w == D.WINDOW else w
            best = 0
            for shift in range(-len(q) + 1, len(d)):
                eq = [d[shift + k] == q[k] for k in range(len(q)) if 0 <= shift + k < len(d)]
                best = max([best, *(sum(eq[k : k + w]) for k in range(len(eq) - w + 1))])
            if best >= need:
                out.add((str(i), str(j), w, best))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdé") for _ in range(3)) for _ in range(60)]
    say = lambda k: [rng.choice(words) for _ in range(k)]
    items = [(j, " ".join(say(k))) for j, k in enumerate([30, 25, 13, 14, 12, 9, 8, 7, 3, 40])] + [(20, None), (21, ""), (None, " ".join(say(20)))]
    items.append((22, items[0][1]))
    docs = [(99, None), (98, ""), (97, "short")]
    for i in range(90):
        own = say(rng.randint(0, 60))
        item = (rng.choice(items)[1] or "").split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            if item:
                item[rng.randrange(len(item))] = rng.choice(words)
        lo = rng.randint(0, 4)
        own[rng.randint(0, len(own)) :][:0] = []
        at = rng.randint(0, len(own))
        text = own[:at] + (item[lo:] if i % 3 else []) + own[at:]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text).upper() if i % 2 else "; ".join(text)))
    docs += [(None, items[0][1]), (3, items[1][1]), (3, "nothing"), (500, " ".join(say(20000)) + " " + items[3][1])]
    df = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id bigint, text string, _words int, item_id string")
    bench = spark.createDataFrame([(*b, 5) for b in items], "item_id bigint, text string, doc_id int")
    want = brute(docs, items)
    assert len(want) > 20
    for limit in (D.BROADCAST_SEEDS, 40):  # one block, several blocks
        got = {(str(r.doc_id), str(r.item_id), r.window, r.matched) for r in D.contaminated(df, bench, broadcast_seeds=limit).collect()}
        assert got == want, (sorted(got - want)[:5], sorted(want - got)[:5], limit)
    assert D.contaminated(df.limit(0), bench).count() == 0 and D.contaminated(df, bench.limit(0)).count() == 0


def test_short_items_and_scripts_without_blanks(spark):
    """Fixed expectations; null ids of many rows are one id in the report, as stated."""
    docs = [
        (1, "He said: To be, or not to be!"), (2, "to be or not two be"), (3, "not to be or to"), (4, None),
        (5, "前言 天地玄黃宇宙洪荒日月盈昃辰宿列張 後記"), (6, "天地玄黃宇宙洪荒日月滿昃辰宿列張"), (7, "天地玄黃"), (8, "สวัสดีครับ"),
    ] + [(None, "to be or not to be")] * 50
    items = [(1, "to be or not to be"), (2, "天地玄黃宇宙洪荒日月盈昃辰宿列張"), (3, "玄黃"), (4, "สวัสดี"), (5, ""), (6, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.window, r.matched) for r in D.contaminated(df, bench).collect())
    assert got == [(0, 1, 6, 6), (1, 1, 6, 6), (5, 2, 13, 13), (5, 3, 2, 2), (6, 2, 13, 12), (6, 3, 2, 2), (7, 3, 2, 2), (8, 4, 6, 6)]
