"""The corpus pipeline against a plain version of every stage, one after the other."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_pairs_and_spans import DOCS, brute, brute_hits, sentences
from test_span_tails import all_runs

import corpus_pipeline as C
from cartoframe.llm import mixing, toxicity

WORDS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def domain(source):
    digit = hashlib.md5((source or "").encode()).hexdigest()[0]
    return "d" + str("048c".index(max(x for x in "048c" if x <= digit)))


def split(children, budget):
    """{child: share} of a budget; children: {child: (weight, capacity)}.  Those that their part would fill are filled, the others share the rest by weight."""
    order = sorted(children, key=lambda c: (children[c][1] / children[c][0], c is not None, c or ""))
    left, weight, full = budget, sum(w for w, _ in children.values()), set()
    for c in order:
        w, capacity = children[c]
        if capacity * weight <= w * left:
            full.add(c)
        left, weight = left - capacity, weight - w
    rest = budget - sum(children[c][1] for c in full)
    weights = sum(children[c][0] for c in children if c not in full)
    return {c: children[c][1] if c in full else children[c][0] * rest // max(1, weights) for c in children}


def mixed(rows, epochs=4):
    """[(doc_id, text, epoch)]"""
    tokens = lambda t: len((t or "").split())
    leaves = collections.defaultdict(list)
    for r in rows:
        leaves[domain(r[3]), r[2], r[3]].append(r)
    supply = {k: sum(tokens(r[1]) for r in v) for k, v in leaves.items()}
    share = {(): sum(supply.values())}
    for depth, level in enumerate(("domain", "lang", "source")):
        below = collections.defaultdict(dict)
        for k, n in supply.items():
            at = below[k[:depth]]
            w = WORDS.get(level, {}).get(k[depth], 1)
            at[k[depth]] = (w, at.get(k[depth], (w, 0))[1] + epochs * n)
        share = {(*path, c): s for path, children in below.items() for c, s in split(children, share[path]).items()}
    out = []
    for k, own in leaves.items():
        if not supply[k]:
            continue
        full, rest = divmod(share[k], supply[k])
        groups = collections.defaultdict(list)
        for r in own:
            groups[hashlib.md5(f"7:{full}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0]].append(r)
        upto = 0
        for key in sorted(groups, key=lambda g: g[0]):
            upto += sum(tokens(r[1]) for r in groups[key])
            copies = full + (rest > 0 and upto <= rest)
            out += [(r[0], r[1], e) for r in groups[key] for e in range(copies)]
    return out


def corpus(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    text = lambda: " ".join(f"{prose(rng.randrange(3, 12)).capitalize()}{rng.choice('.!?')}" for _ in range(rng.randrange(2, 9)))
    passage, leak = text(), " ".join(f"t{k}" for k in range(14))
    rows = [(i, text(), rng.choice(["en", "de", "fr", None]), rng.choice(["big", "big", "s1", "s2", None]), None) for i in range(110)]
    rows += [(200 + i, rows[i][1], "en", "big", 5) for i in range(6)]
    rows += [(300 + i, rows[10 + i][1] + " tail", "de", "s1", 5) for i in range(6)]
    rows += [(400 + i, f"{text()} {passage} {text()}", "en", "s2", 5) for i in range(5)]
    rows += [(500 + i, f"{text()} {leak} {text()}", "en", "big", 5) for i in range(3)]
    rows += [(600 + i, text() + " vlorker vlorking vlork." * 4, "en", "s1", 5) for i in range(25)]
    rows += [(700, None, "en", "s1", None), (701, "", "de", "big", 0), (None, text(), "fr", "s1", 3), rows[3], rows[3]]
    rng.shuffle(rows)
    return rows, leak


@pytest.mark.parametrize("seed", [1, 2])
def test_every_stage_matches_its_plain_version(spark, tmp_path, seed):
    rows, leak = corpus(seed)
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    marked = [(i, 1, int(600 <= i < 700)) for i in sorted({r[0] for r in rows if r[0] is not None and r[0] % 3})]
    spark.createDataFrame(marked, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak), (None, "no such words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.is_held_out()))
    now = [r for r in rows if model.score(r[1]) < 0.3]
    assert 15 <= len(rows) - len(now) <= 40
    first, _, _ = brute(now, 5, 80, 100)
    now = [r for r in now if r[0] is None or first[r[0]] == r[0]]
    order = sorted({(r[0] if r[0] is not None else 10**9, r[1]) for r in now}, key=lambda r: r[0])
    gone, cut = all_runs(order, 2, 10), []
    for r in now:
        drop = gone[r[0] if r[0] is not None else 10**9]
        text, own = r[1], sentences(r[1])
        if drop:
            raw = text.encode()
            edge = [0, *[s for _, s in own[1:]], len(raw)]
            text = b"".join(raw[edge[x] : edge[x + 1]] for x in range(len(own)) if x not in drop).decode()
        if not drop or text.strip():
            cut.append((r[0], text, r[2], r[3]))
    assert any(gone.values())
    clean = [r for r in cut if not brute_hits(r[1], [(1, leak)], 10)[1]]
    assert len(clean) < len(cut)
    got = [(r.doc_id, r.text, r.epoch) for r in C.run(spark, str(tmp_path)).collect()]
    assert collections.Counter(got) == collections.Counter(mixed(clean)) and len({e for *_, e in got}) > 1
    assert WORDS == mixing.WEIGHTS and F is not None
