import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.llm import pii, pii_model, pii_rules, pii_train
from lexforge.llm.leak import align, leaked_items, words_of
from lexforge.llm.mixture import apportion, mixture


def test_apportion():
    assert apportion([0.5, 0.3, 0.2], [99, 99, 99], 10) == [5, 3, 2]
    assert apportion([0.5, 0.5], [1, 99], 10) == [1, 9]
    assert apportion([], [], 3) == [] and apportion([1.0], [2], 5) == [2]


def quotients(weights, caps, seats):
    """Seat by seat."""
    got = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if got[i] < caps[i] and weights[i] > 0]
        if not open_:
            break
        got[max(open_, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))] += 1
    return got


@given(st.lists(st.tuples(st.sampled_from([0.0, 0.1, 0.25, 0.5, 1.0, 3.7]), st.integers(0, 9)), max_size=7), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_apportion_equals_one_seat_at_a_time(sources, seats):
    w, c = [x for x, _ in sources], [y for _, y in sources]
    assert apportion(w, c, seats) == quotients(w, c, seats)


def test_small_shares_do_not_vanish(spark):
    assert apportion([0.9999, 0.0001], [10**12, 10**12], 10**10) == [9_999_000_000, 1_000_000]
    docs = spark.createDataFrame([(i, f"word {i} text", "big") for i in range(6000)] + [(10_000 + i, f"tiny {i}", "tiny") for i in range(3)], "doc_id long, text string, source string")
    goals = spark.createDataFrame([("big", 0.9995, 1), ("tiny", 0.0005, 1)], "source string, target_share double, max_repeats int")
    got = {x["source"]: x["actual_share"] for x in mixture(docs, goals, shard_tokens=2000)[1].collect()}
    assert got["tiny"] == pytest.approx(0.0005, rel=0.25) and got["big"] > 0.999


def test_mixture(spark):
    r = random.Random(1)
    word = lambda: r.choice(["alpha", "beta", "gamma", "delta"])
    rows = [(i, " ".join(word() for _ in range(r.randint(5, 60))) + f" {i}", "Big " if i % 3 else "small", "x") for i in range(900)]
    rows += [(5000, rows[0][1], "big", "x"), (5001, None, "big", "x"), (5002, "", "big", "x"), (5003, "abc", None, "x"), (5004, "abc", "other", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    goals = spark.createDataFrame([("big", 0.4, 1), ("SMALL ", 0.5, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    texts, shares = mixture(docs, goals, shard_tokens=4000)
    used = {x["doc_id"]: x for x in texts.collect()}
    assert not {5000, 5001, 5002, 5003, 5004} & set(used)
    assert max(x["copies"] for x in used.values() if x["source"] == "big") == 1 and max(x["copies"] for x in used.values()) <= 3
    got = {x["source"]: x["actual_share"] for x in shares.collect()}
    assert got["big"] == pytest.approx(4 / 9, abs=0.01) and got["small"] == pytest.approx(5 / 9, abs=0.01) and got["none"] == 0
    again = {x["doc_id"] for x in mixture(docs, goals, shard_tokens=4000)[0].collect()}
    assert again == set(used)
    assert mixture(docs.where("false"), goals)[0].count() == 0 and mixture(docs, goals.where("false"))[1].count() == 0


def test_alignment():
    a, b = np.array([1, 2, 3, 9, 4, 5]), np.array([1, 2, 3, 4, 5])
    assert align(a, b) == (9, 3)
    assert align(np.array([], int), b) == (0, 0)


def test_leaks_equal_brute_force(spark):
    r = random.Random(4)
    vocab = [a + b for a in "abcdefgh" for b in "xyz"]
    opening = " ".join(r.choice(vocab) for _ in range(8))
    items = [(k, f"{opening} " + " ".join(r.choice(vocab) for _ in range(30))) for k in range(12)] + [(50, "too short"), (51, None), (52, "")]
    docs = []
    for i in range(120):
        w = [r.choice(vocab) for _ in range(60)]
        if i % 3 == 0:
            src = words_of(items[r.randrange(12)][1])
            lo, n = r.randrange(20), r.randint(8, 18)
            w[10 : 10 + n] = src[lo : lo + n]
        if i % 5 == 0:
            w[30:38] = opening.split()
        docs.append((i, ", ".join(w).upper() if i % 2 else "1 ".join(w), "x"))
    docs += [(900, None, "x"), (901, "", "x"), docs[0]]
    runs = lambda t: {tuple(w[i : i + 12]) for w in [words_of(t)] for i in range(len(w) - 11)}
    want = {(d, k) for d, t, _ in docs for k, q in items if runs(t) & runs(q)}
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    out = leaked_items(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in out.where("longest_run >= 12").collect()} == want and want
    edited = items[3][1].split()
    edited[::6] = ["zzz"] * len(edited[::6])
    low = leaked_items(spark.createDataFrame([(1, " ".join(items[3][1].split()[:6] + edited[6:]))], "doc_id long, text string"), spark.createDataFrame(items[3:4], "item_id long, text string"))
    assert [x["longest_run"] < 12 and x["share"] >= 0.5 for x in low.collect()] == [True]
    assert leaked_items(df.where("false"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_short_items(spark):
    """An item of a few words leaks where the whole of it stands."""
    docs = spark.createDataFrame([(1, "x the quick brown fox y"), (2, "the quick red brown fox"), (3, "quick"), (4, "The QUICK, brown fox!")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the quick brown fox"), (2, "quick"), (3, "!!"), (4, "the quick brown dog jumps over")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["longest_run"]) for x in leaked_items(docs, items).collect()}
    assert got == {(1, 1, 4), (4, 1, 4), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 1), (1, 4, 3), (4, 4, 3)}


TEXT = """Subject: cache

Signed-off-by: Lucia Marrwicksen <lucia.marrwicksen@mail.example.org>
Call +44 20 7946 0842 when the nightly run stops. Clone from git@code.example.test:tools/cache.git first.
He moved to 681 Osterley Rd, Kestervik last week. Please remove SSN 666-53-5740 from the fixture.
Ping 192.0.2.7 works, version 123.45.6134 is pinned. 12 Worker Threads on 1 Main Loop.
"""


def test_pii_of_a_text(spark):
    rows = [(1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (4, "Filler words only. " * 400 + TEXT + " More filler. " * 400, "x"), (5, TEXT, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    want = {("name", "Lucia Marrwicksen"), ("email", "lucia.marrwicksen@mail.example.org"), ("phone", "+44 20 7946 0842"), ("address", "681 Osterley Rd, Kestervik"), ("id_number", "666-53-5740")}
    got = {(r["doc_id"], r["kind"], r["value"]) for r in pii.find_pii(df).collect()}
    assert got == {(i, *v) for i in (1, 4, 5) for v in want}
    out = {r["doc_id"]: r["redacted"] for r in pii.tag_pii(df).collect()}
    assert out[2] is None and out[3] == "" and "[NAME] <[EMAIL]>" in out[1] and len(out) == 5
    plain = out[1]
    for kind, value in want:
        plain = plain.replace(f"[{kind.upper()}]", value)
    assert plain == TEXT
    assert pii.find_pii(df.where("false")).count() == 0


def test_gradients():
    p = {k: v.astype("f4") for k, v in pii_model.init(4, 3).items()}
    r = np.random.default_rng(0)
    ids, gold = r.integers(1, 102, (2, 6)), np.array([[0, 1, 2, 0, 3, 0], [0] * 6])
    _, g = pii_model.loss_and_grads(p, ids, gold)
    for name, at in (("u", (1, 0, 3)), ("wx", (0, 1, 2)), ("wo", (1, 2, 1)), ("a", (0, 1)), ("b", (0, 5))):
        lo, hi = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        lo[name][at] -= 1e-2
        hi[name][at] += 1e-2
        slope = (pii_model.loss_and_grads(hi, ids, gold)[0] - pii_model.loss_and_grads(lo, ids, gold)[0]) / 2e-2
        assert g[name][at] == pytest.approx(slope, abs=2e-3)


def test_viterbi_is_the_best_legal_labelling():
    from itertools import product

    p = pii_model.init(3, 2)
    e = np.random.default_rng(1).normal(size=(3, 1, pii_model.N_LABELS)).astype("f4")
    a = np.where(pii_model.ILLEGAL, -1e4, p["a"])
    score = lambda y: p["start"][y[0]] + sum(e[t, 0, y[t]] for t in range(3)) + sum(a[y[t - 1], y[t]] for t in (1, 2))
    best = max(product(range(pii_model.N_LABELS), repeat=3), key=score)
    assert tuple(pii_model.viterbi(p, e)[0]) == best


def test_training_learns():
    texts = [f"Call {n:03d}-555-0{n:03d} now, {TEXT}" for n in range(100, 160)]
    lost = []
    pii_train.train(texts, seconds=25, hidden=8, batch=8, workers=0, say=lost.append, every=20)
    marks = pii_train.label(TEXT)
    assert {k for _, _, k in marks} == set(pii_rules.KINDS)
    loss = [float(re.fullmatch(r"step \d+ loss (\S+) .*", x)[1]) for x in lost]
    assert len(loss) >= 3 and loss[-1] < 0.5 * loss[0]


def test_tagger_on_the_held_out_part():
    """Names, towns and sentences that training has not seen."""
    got = pii_train.held_out(400)
    for kind, (recall, precision, n) in got.items():
        assert n > 20 and recall >= 0.8 and precision >= 0.8, (kind, recall, precision)


def test_forms_of_other_places():
    found = lambda t: {(k, t[a:b]) for a, b, k in pii.tag([t])[0]}
    assert ("name", "John Smith") in found("Please ask John Smith about the cache.")
    assert ("address", "221B Baker Street, London") in found("He moved to 221B Baker Street, London last week.")
    assert ("phone", "555-867-5309") in found("Call 555-867-5309 when the build fails.")


def test_edges_are_trimmed_but_no_form_is_refused():
    assert pii_rules.snap("email", "to a.b@c.example, now", 3, 17) == (3, 16)
    assert pii_rules.snap("phone", "call 12-34 x", 5, 10) == (5, 10)
    assert pii_rules.snap("email", "git@host.example", 0, 16) is None and pii_rules.snap("name", " , ", 0, 3) is None
    # by definition a name has two parts and a phone digits
    assert pii_rules.snap("name", "Filler words", 0, 6) is None and pii_rules.snap("phone", "a ( b", 2, 3) is None
