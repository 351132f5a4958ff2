"""Jaccard join, span dedup, decontamination against brute force, and edge cases."""

import random
import re

import numpy as np
import pytest

from cartoframe.llm import decontaminate as D
from cartoframe.llm import jaccard_join as J
from cartoframe.llm import span_dedup as S
from cartoframe.llm import textkit as tk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ASCII = {c: c + 32 for c in range(65, 91)}


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([3, 8, 15, 30, 60, 200])) for _ in range(120)]
    for base in texts[:20]:
        texts += [edited(rng, base, rng.choice([0, 1, 1, 2, 5])) for _ in range(rng.choice([1, 3, 6]))]
    texts += ["", None, "one", "One", "two words", "  two\twords ", "!!!", "x" * 5000, "a b c", "a b c", "É è", prose(rng, 20000)]
    rng.shuffle(texts)
    return [(i * 3, t, None, "s", None) for i, t in enumerate(texts)] + [(None, "no id here at all", None, None, 1)]


def sets_of(rows, n):
    out = {}
    for i, t, *_ in rows:
        w = space_words(t)
        out[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, n, p, q):
    sets = {i: s for i, s in sets_of(rows, n).items() if i is not None}
    ids, links, parent = sorted(sets), set(), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and q * both >= p * (len(sets[a]) + len(sets[b]) - both):
                links.add((a, b))
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, links, sets


@pytest.mark.parametrize("n,p,seed", [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_components_match_brute_force(spark, n, p, seed):
    rows = corpus(seed)
    want, _, sets = brute(rows, n, p, 100)
    got = J.ngram_jaccard_components(spark.createDataFrame(rows, DOCS).repartition(5), n, p, 100).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == max(1, 5 - n + 1)
        else:
            assert (r.component_id, r.n_shingles) == (want[r.doc_id], len(sets[r.doc_id]))


def test_every_link_between_classes(spark):
    rows = corpus(5)
    _, links, sets = brute(rows, 3, 80, 100)
    members, pairs = J.ngram_jaccard_join(spark.createDataFrame(rows, DOCS), 3, 80, 100)
    rep = {r.doc_id: r.rep for r in members.collect()}
    got = {(r.u, r.v) for r in pairs.collect()}
    assert got == {(a, b) for a, b in links if sets[a] != sets[b] and rep[a] == a and rep[b] == b}
    for a, b in links:
        assert rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in got


def test_groups_of_several_blocks(spark, monkeypatch):
    """One large group of near copies, most of them no links of its first document."""
    monkeypatch.setattr(J, "BLOCK_SETS", 8)
    rng = random.Random(9)
    base = prose(rng, 80, 10**6)
    rows = [(i, edited(rng, base, rng.choice([1, 2, 3])), None, None, None) for i in range(90)]
    want, links, _ = brute(rows, 3, 80, 100)
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.component_id for r in J.ngram_jaccard_components(docs, 3, 80, 100).collect()} == want
    assert {(r.u, r.v) for r in J.ngram_jaccard_join(docs, 3, 80, 100)[1].collect()} == links


def test_tree_keeps_every_link():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(300) < rng.choice([0.01, 0.05, 0.2]), rng.integers(0, 2**63, 300, dtype=np.uint64), base)) for _ in range(120)]
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if (c := len(np.intersect1d(sets[a], sets[b]))) * 100 >= 85 * (len(sets[a]) + len(sets[b]) - c)}
    pairs, label = J.tree_links(sets, None, 85, 100, every=True)
    assert {tuple(sorted(x)) for x in pairs} == want
    few, label2 = J.tree_links(sets, None, 85, 100)
    assert all((label2[a] == label2[b]) == (label[a] == label[b]) for a in range(120) for b in range(120)) and len(few) < len(pairs)
    i, j = J.candidates(*J.trees(sets, sets[:50]), 85, 100)
    assert {(a, b) for a, b in want if a < 50} <= set(zip(j.tolist(), i.tolist(), strict=True))


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert J.ngram_jaccard_components(none).collect() == []
    assert S.remove_repeated_spans(none).collect() == []
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.find_contamination(none, items).collect() == []
    assert D.find_contamination(spark.createDataFrame(corpus(), DOCS), items.limit(0)).where("n_hit > 0").count() == 0


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["Ab c", "ab", None, "", " C  ab.", "été É", "x\x0by"]
    seen = {}
    for i, j, w in tk.runs(pa.array(texts), tk.SPACE_WORDS):
        for r in range(i, j):
            words = space_words(texts[r])
            a, b = w.bounds[r - i], w.bounds[r - i + 1]
            assert [w.word(k).decode() for k in range(a, b)] == words
            for k, word in zip(range(a, b), words, strict=True):
                assert seen.setdefault(word, w.hash[k]) == w.hash[k]
    assert len(set(seen.values())) == len(seen)


# --- spans ---------------------------------------------------------------------------------------


def sentences(text):
    """[(words, start)] in bytes."""
    raw = (text or "").translate(ASCII).encode()
    out, part, last = [], 0, None
    ends = [k + 1 for k, b in enumerate(raw) if b == 0x0A or (b in b".!?" and (k + 1 == len(raw) or re.match(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]", raw[k + 1 : k + 2])))]
    for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw):
        part = sum(e <= m.start() for e in ends)
        if part != last:
            out.append(([], m.start()))
            last = part
        out[-1][0].append(m.group())
    return out


def brute_spans(rows, k, words):
    runs, seen = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    for i, t, *_ in order:
        own = sentences(t)
        for a in range(len(own)):
            b, n = a, 0
            while b < len(own) and (b - a < k or n < words):
                n += len(own[b][0])
                b += 1
            if b - a >= k and n >= words:
                runs[i, a] = b
                seen.setdefault(tuple(tuple(s[0]) for s in own[a:b]), []).append((i, a))
    gone = {}
    for places in seen.values():
        for i, a in places[1:]:
            gone.setdefault(i, set()).update(range(a, runs[i, a]))
    out = {}
    for i, t, *_ in rows:
        own, drop = sentences(t), gone.get(i, set())
        if not drop:
            out[i] = (t, 0)
            continue
        raw = t.encode()
        edge = [0, *[s for _, s in own[1:]], len(raw)]
        out[i] = (b"".join(raw[edge[x] : edge[x + 1]] for x in range(len(own)) if x not in drop).decode(), len(drop))
    return out


def test_spans_match_brute_force(spark):
    rng = random.Random(3)
    pool = [f"{prose(rng, rng.choice([1, 4, 9, 14]), 60).capitalize()}{rng.choice('.!?')}" for _ in range(60)]
    rows = []
    for i in range(150):
        parts = [rng.choice(pool) if rng.random() < 0.5 else prose(rng, 7).capitalize() + "." for _ in range(rng.randrange(12))]
        if rng.random() < 0.4:
            at = rng.randrange(50)
            parts[1:1] = pool[at : at + 4]
        rows.append((i * 2, "".join(p + rng.choice([" ", "\n", "  "]) for p in parts), "en", "s", None))
    rows += [(1001, None, None, None, None), (1003, "", None, None, None), (1005, "... !!! \n\n", None, None, None), (1007, rows[7][1], None, None, None), (1009, "é" * 3000, None, None, None)]
    rng.shuffle(rows)
    for k, words in ((2, 20), (3, 1), (2, 10)):
        want = brute_spans(rows, k, words)
        got = S.remove_repeated_spans(spark.createDataFrame(rows, DOCS).repartition(6), k, words).collect()
        assert {r.doc_id: (r.text, r.n_removed) for r in got} == want
        assert any(n for _, n in want.values())


def test_repeated_rows_do_not_remove_each_other(spark):
    text = "One two three four five six. Seven eight nine ten eleven twelve. The end is near now."
    rows = [(1, text, None, None, None)] * 3 + [(None, text, None, None, None)] * 2 + [(2, "Fresh words before it all. " + text, None, None, None)]
    got = S.remove_repeated_spans(spark.createDataFrame(rows, DOCS).repartition(4), 2, 8).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got if r.doc_id) == [(1, 0), (1, 0), (1, 0), (2, 3)]
    assert {r.n_removed for r in got if r.doc_id is None} == {3}
    assert next(r.text for r in got if r.doc_id == 2) == "Fresh words before it all. "


# --- decontamination -----------------------------------------------------------------------------


def brute_hits(text, items, n):
    words, hit, ids = alnum_words(text), set(), set()
    for item, t in items:
        w = alnum_words(t)
        if not w:
            continue
        k = min(n, len(w))
        windows = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
        for a in range(len(words) - k + 1):
            if tuple(words[a : a + k]) in windows:
                hit.update(range(a, a + k))
                ids |= {str(item)} - {"None"}
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("slice_bytes", [D.SLICE_BYTES, 300])
def test_decontamination_matches_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(D, "SLICE_BYTES", slice_bytes)
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice([1, 4, 10, 14, 25]), 5000)) for i in range(25)] + [(7, "again one more"), (90, None), (91, " .. "), (None, prose(rng, 12)), (92, "Same Words here"), (93, "same words, HERE"), (93, "same words, HERE"), (94, "a b " * 40)]
    rows = []
    for i in range(80):
        t = prose(rng, rng.randrange(60), 5000)
        if rng.random() < 0.5:
            t += " " + (rng.choice(items)[1] or "").upper() + ", " + prose(rng, 5)
        rows.append((i, t, None, None, None))
    rows += [(500, None, None, None, None), (501, "", None, None, None), (None, items[3][1], None, None, None), (502, "same-words;here", None, None, None), (502, "same-words;here", None, None, None), (503, "b a " * 30 + prose(rng, 30000), None, None, None)]
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = D.find_contamination(docs, table, 10).collect()
    want = sorted((str(i), *map(str, brute_hits(t, items, 10))) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), str(r.n_words), str(r.n_hit), str(list(r.item_ids))) for r in got) == want
    clean = {r.doc_id: r.text for r in D.decontaminate(docs, table, 10, "spans").collect()}
    for i, t, *_ in rows:
        n, hit, _ = brute_hits(t, items, 10)
        assert len(alnum_words(clean[i])) == n - hit and (hit or clean[i] == t)
    assert {r.doc_id for r in D.decontaminate(docs, table, 10).collect()} == {i for i, t, *_ in rows if not brute_hits(t, items, 10)[1]}
