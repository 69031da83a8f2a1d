import random

from lexforge.llm.leak import leaked_items, words_of


def smith_waterman(a, b):
    """Score (match 2, mismatch and gap -1) and longest common run, cell by cell."""
    h, run, best, longest = [0] * (len(b) + 1), [0] * (len(b) + 1), 0, 0
    for x in a:
        new, r = [0], [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, h[j - 1] + (2 if x == y else -1), h[j] - 1, new[-1] - 1))
            r.append(run[j - 1] + 1 if x == y else 0)
        h, run, best, longest = new, r, max(best, *new), max(longest, *r)
    return best, longest


def test_edited_copies_beside_exact_ones(spark):
    r = random.Random(9)
    vocab = [a + b for a in "abcdefgh" for b in "uvwxyz"]
    items = [(k, " ".join(r.choice(vocab) for _ in range(120 if k == 0 else 40))) for k in range(6)]
    noise = lambda n: [r.choice([*vocab, "other", "more"]) for _ in range(n)]
    docs = []
    for k, text in items:
        w = words_of(text)
        docs.append(noise(10) + w + noise(10))
        for every in (11, 6, 4, 3, 2):  # from 6 on no six words in a row are left
            docs.append(noise(30) + ["edit" if i % every == every - 1 else x for i, x in enumerate(w)] + noise(30))
            docs.append(noise(5) + [y for i, x in enumerate(w) for y in ([x, "put"] if i % every == 0 else [x])])
            docs.append([x for i, x in enumerate(w) if i % every] + noise(5))
        docs.append(w[:14] + noise(200) + w[20:30])
    docs += [noise(80) for _ in range(20)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["score"], x["longest_run"]) for x in leaked_items(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, d in enumerate(docs):
        for k, text in items:
            w = words_of(text)
            s, longest = smith_waterman(d, w)
            if longest >= 12 or s >= len(w):
                want[i, k] = (s, longest)
    assert got == want
    assert {(0, 0), (1, 0)} <= set(want)
