"""Repeated passages go whole: both directions of shortest runs against all runs."""

import random

from test_pairs_and_spans import DOCS, prose, sentences

from cartoframe.llm import span_dedup as S


def all_runs(rows, k, words):
    """{id: sentence numbers} in any non-first occurrence of any run."""
    seen = {}
    for i, t in sorted(rows):
        own = sentences(t)
        for a in range(len(own)):
            for b in range(a + k, len(own) + 1):
                if sum(len(s[0]) for s in own[a:b]) >= words:
                    seen.setdefault(tuple(tuple(s[0]) for s in own[a:b]), []).append((i, a, b))
    gone = {i: set() for i, _ in rows}
    for places in seen.values():
        for i, a, b in places[1:]:
            gone[i].update(range(a, b))
    return gone


def test_short_last_sentence_of_a_passage_goes(spark):
    shared = "One two three four five six seven eight. Nine ten eleven twelve. Thirteen fourteen fifteen."
    rows = [(1, shared + " Now this goes on in its own way entirely here.", None, None, None), (2, shared + " Quite another end follows in that one instead today.", None, None, None)]
    got = S.remove_repeated_spans(spark.createDataFrame(rows, DOCS), tails=True).collect()
    assert {r.doc_id: (r.n_removed, r.text.strip()) for r in got}[2] == (3, "Quite another end follows in that one instead today.")


def test_both_directions_remove_what_all_runs_remove(spark):
    rng = random.Random(5)
    pool = [f"{prose(rng, rng.choice([1, 3, 4, 9, 14]), 60).capitalize()}{rng.choice('.!?')}" for _ in range(40)]
    rows = []
    for i in range(150):
        parts = [rng.choice(pool) if rng.random() < 0.4 else prose(rng, 7).capitalize() + "." for _ in range(rng.randrange(10))]
        if rng.random() < 0.5:
            at, n = rng.randrange(33), rng.randrange(2, 8)
            parts[1:1] = pool[at : at + n]
        rows.append((i, " ".join(parts)))
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS).repartition(6)
    for k, words in ((2, 20), (3, 1), (2, 10)):
        want = all_runs(rows, k, words)
        got = {r.doc_id: r for r in S.remove_repeated_spans(docs, k, words, tails=True).collect()}
        assert {i: r.n_removed for i, r in got.items()} == {i: len(g) for i, g in want.items()}
        for i, t in rows:
            own = sentences(t)
            assert sum((s[0] for s in sentences(got[i].text)), []) == sum((s[0] for n, s in enumerate(own) if n not in want[i]), [])
