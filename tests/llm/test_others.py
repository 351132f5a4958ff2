"""Chat formatting, mixing, top-k, language ID, token counts, URL filters, toxicity, pipeline: brute force, libraries, edge cases."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoframe.llm import chat_format, language_id, mixing, token_counts, topk, toxicity, url_filter

TEXTS = ["", None, "a", "Hello world! It's 12,345 o'clock…", "  spaces   and\ttabs\n\n\nlines ", "日本語のテキスト🙂🙂", "x" * 3000, "é" * 500, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "\x1c\x1d mixed\u00a0\u2003space", "naïve ﬁ ½ ² Ⅷ", "don't we'll I'VE 's", "\x00\x01\x7f", "ab" * 2000 + " " + "1" * 999]


def test_token_counts_match_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(2)
    alphabet = "abcdefghij ABC  ''.,!?0123456789éüñ漢字🙂\n\t\r\u00a0\u200b<|>"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(150)]
    want = [len(e) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, N_Tokens string").repartition(4)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, path).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(got[i].over_limit == (n > 1024) for i, n in enumerate(want)) and any(n > 1024 for n in want)


def test_merging_is_by_rank_then_place():
    ranks = {(b"a", b"a"): 0, (b"aa", b"a"): 1, (b"b", b"c"): 2}
    assert token_counts.count_merged(b"aaaa", ranks) == 2
    assert token_counts.count_merged(b"aaa", ranks) == 1
    assert token_counts.count_merged(b"xbcb", ranks) == 3
    assert token_counts.count_merged(b"q", ranks) == 1


def test_token_counts_refuse_other_formats(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.load_merges(public_tokenizers.path("word_bpe_49k.json"))


# --- top-k ---------------------------------------------------------------------------------------


def brute_topk(rows, k, scale, every=10):
    out = []
    usable = [(n, i, [scale * int(x) if abs(x) > 1e15 else int(np.floor(scale * x)) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for n, q, v in usable:
        if q % every:
            continue
        dots = ((sum(a * b for a, b in zip(v, x, strict=True)), i) for m, i, x in usable if m != n and len(x) == len(v))
        scores = sorted((-min(2**63 - 1, max(-(2**63), s)), i) for s, i in dots)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_topk_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(150)]
    rows += [(200 + i, rows[10][1]) for i in range(25)]  # ties
    rows += [(300, None), (310, [1.0, None] + [0.0] * 10), (320, [float("nan")] * 12), (330, [float("inf")] + [0.0] * 11), (340, [1.0, 2.0]), (341, [3.0, 4.0]), (350, []), (360, [0.0] * 12), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k in (1, 10):
        got = topk.exact_topk(df, df.where("vec_id % 10 = 0"), k, 64).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_topk(rows, k, 64)
    none = df.limit(0)
    assert topk.exact_topk(none, none).collect() == []


def test_topk_of_repeated_queries_and_far_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    rows += [(100, rows[3][1]), (100, rows[4][1]), (100, rows[3][1]), (110, [1e30] * 6), (120, [-1e30, 1e30, 3.0, 0.0, 1e300, 1e308]), (130, [1e10] * 6), (131, [-1e308] * 6)]
    df = spark.createDataFrame([(*r, "kept out", 1.0) for r in rows], "vec_id long, embedding array<double>, score string, rank double").repartition(5)
    for share, size in ((64, 1 << 20), (1, 300)):  # and several slices of queries
        monkeypatch.setattr(topk, "SEED_SHARE", share)
        monkeypatch.setattr(topk, "SLICE_BYTES", size)
        got = topk.exact_topk(df, df.where("vec_id % 10 = 0"), 5, 1024).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_topk(rows, 5, 1024)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(20, 37)), rng.normal(size=(50, 37))
    exact = q @ x.T
    bounds = [mq @ mx.T + dq @ dx.T for (mq, dq), (mx, dx) in zip(topk._levels(q), topk._levels(x), strict=True)]
    assert len(bounds) > 1
    for b in bounds:
        assert (b + 1e-9 >= exact).all()
    assert (bounds[-1] - exact).mean() < (bounds[0] - exact).mean()


# --- mixing --------------------------------------------------------------------------------------


def pour(weights, capacity, budget):
    """Shares by weight, what a child cannot take going to the others."""
    share, open_, left = dict.fromkeys(weights, 0.0), set(weights), float(budget)
    while open_ and left > 1e-9:
        total = sum(weights[c] for c in open_)
        give = {c: min(capacity[c] - share[c], left * weights[c] / total) for c in open_}
        for c, g in give.items():
            share[c] += g
        left -= sum(give.values())
        full = {c for c in open_ if capacity[c] - share[c] < 1e-9}
        if not full:
            break
        open_ -= full
    return share


def test_budgets_flow_down_the_tree(spark):
    supply = {("d0", "en", "a"): 100, ("d0", "en", "b"): 10, ("d0", "fr", "a"): 5, ("d1", "de", "c"): 1000, ("d1", None, "c"): 7, ("d2", "es", "x"): 0}
    weights = {"domain": {"d0": 4, "d1": 1}, "lang": {"en": 5, "fr": 2}}
    leaves = spark.createDataFrame([(*k, v, 1) for k, v in supply.items()], "domain string, lang string, source string, supply long, n_docs long")
    w = lambda level, x: weights.get(level, {}).get(x, 1)
    for budget in (0, 50, 400, 600, 10**6):
        want = {}
        cap = {k: 2 * v for k, v in supply.items()}
        inside = lambda *p: {k: v for k, v in cap.items() if k[: len(p)] == p}
        top = pour({d: w("domain", d) for d in ("d0", "d1", "d2")}, {d: sum(inside(d).values()) for d in ("d0", "d1", "d2")}, budget)
        for d, b in top.items():
            langs = {k[1] for k in inside(d)}
            for lang, bl in pour({x: w("lang", x) for x in langs}, {x: sum(inside(d, x).values()) for x in langs}, b).items():
                sources = {k[2] for k in inside(d, lang)}
                for s, bs in pour(dict.fromkeys(sources, 1), {x: cap[d, lang, x] for x in sources}, bl).items():
                    want[d, lang, s] = bs
        got = {(r.domain, r.lang, r.source): r.share for r in mixing.leaf_budgets(leaves, F.lit(budget), weights=weights, max_epochs=2).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert abs(got[k] - want[k]) <= 4, (budget, k, got[k], want[k])


def test_prefixes_fill_leaf_budgets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 5)
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(30)) if rng.random() < 0.95 else None, rng.choice(["en", "de", None]), "big" if rng.random() < 0.5 else f"s{rng.randrange(4)}") for i in range(400)]
    rows += [(5, "one two", "en", "big"), (None, "three words here", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("domain", mixing.domain_of(F.col("source")))
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    got = mixing.mix(docs, F.lit(total // 2)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.domain, r.lang, r.source].append(r)
    slim = docs.select("doc_id", "domain", "lang", "source", mixing.n_words(F.col("text")).alias("n"))
    leaves = slim.groupBy("domain", "lang", "source").agg(F.sum("n").alias("supply"), F.count("*").alias("n_docs"))
    shares = {(r.domain, r.lang, r.source): (r.share, r.supply) for r in mixing.leaf_budgets(leaves, F.lit(total // 2)).collect()}
    longest = 30
    for leaf, (share, supply) in shares.items():
        taken = sum(r.n_tokens for r in by[leaf])
        assert taken <= share and (share - taken < longest or not supply)
    assert len({(r.doc_id, r.epoch, r.n_tokens) for r in got if r.doc_id not in (5, None)}) == len([r for r in got if r.doc_id not in (5, None)])
    again = mixing.mix(docs.repartition(3), F.lit(total // 2)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert mixing.mix(docs.limit(0), F.expr("coalesce(sum(supply), 0)")).collect() == []


def test_repeated_rows_are_taken_once_an_epoch_and_carry_their_columns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 5)
    monkeypatch.setattr(mixing, "GROUP", 2)
    rows = [(i, f"word {i} " * 3, "en", "a", i) for i in range(40)] + [(100, "two words", "en", "a", 7)] * 4 + [(None, f"no id {i}", "de", "b", i) for i in range(5)] + [(200, "long " * 50_000, "de", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int").withColumn("domain", F.lit("d0"))
    got = mixing.mix(docs, F.expr("sum(supply) * 2"), max_epochs=2, carry=("text", "n_tokens", "source")).collect()
    assert collections.Counter((r.doc_id, r.text, r.epoch) for r in got) == collections.Counter((i, t, e) for i, t, *_ in rows for e in (0, 1))
    assert all(r.n_tokens == len(r.text.split()) for r in got)
    plain = mixing.mix(docs, F.expr("sum(supply) div 2")).collect()
    full = mixing.mix(docs, F.expr("sum(supply) div 2"), carry=("text",)).collect()
    assert collections.Counter((r.doc_id, r.epoch, r.n_tokens) for r in plain) == collections.Counter((r.doc_id, r.epoch, r.n_tokens) for r in full) and plain


# --- the others ------------------------------------------------------------------------------------


def test_chat_pairs(spark):
    rows = [(1, True, 0, "user", "hi"), (1, True, 1, "assistant", "yes"), (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "no"), (1, False, 2, "user", None),
            (2, True, 0, None, None), (2, False, 0, None, None), (3, True, 0, "assistant", "alone"), (4, True, 5, "user", "q"), (4, True, 1, "system", "s"), (4, False, 1, "user", "s"), (None, True, 0, "user", "x")]
    got = {r.pair_id: r for r in chat_format.preference_pairs(spark.createDataFrame(rows, "pair_id long, chosen boolean, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2, 3, 4}
    r = got[1]
    assert r.n_shared == 1 and r.prompt == "<|im_start|>user\nhi<|im_end|>\n" and r.chosen == "<|im_start|>assistant\nyes<|im_end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_mask] == ["yes<|im_end|>"] and [r.rejected[s.start : s.end] for s in r.rejected_mask] == ["no<|im_end|>"]
    assert got[2].n_shared == 1 and got[2].chosen == got[2].rejected == "" and got[2].chosen_mask == [] and got[2].prompt == "<|im_start|>unknown\n<|im_end|>\n"
    assert got[3].n_shared == 0 and got[3].rejected == "" and [got[3].chosen[s.start : s.end] for s in got[3].chosen_mask] == ["alone<|im_end|>"]
    assert got[4].n_shared == 0 and got[4].chosen.startswith("<|im_start|>system\ns")
    for r in got.values():
        assert r.prompt + r.chosen or r.rejected


def test_chat_spans_of_long_conversations(spark):
    """Against a loop over turns; one conversation of thousands of turns, repeated rows, an empty table."""
    rng = random.Random(2)
    rows = []
    for pair in range(12):
        shared = rng.randrange(4)
        for side in (True, False):
            n = 3000 if pair == 0 else rng.randrange(9)
            rows += [(pair, side, k, rng.choice(["user", "assistant", None]) if k >= shared else "user", f"{'' if k < shared else rng.random()} é🙂" if rng.random() < 0.9 or k < shared else None) for k in range(n)]
    rows += [r for r in rows if r[0] == 5] + [(20, True, 0, "assistant", "w " * 200_000)]
    df = spark.createDataFrame([(*r, "kept out") for r in rows], "pair_id long, chosen boolean, turn long, role string, text string, prompt string").repartition(3)
    got = {r.pair_id: r for r in chat_format.preference_pairs(df).collect()}
    assert set(got) == {r[0] for r in rows}
    for pair, r in got.items():
        sides = [sorted(((k, role or "", role is not None, t or "", t is not None) for p, s, k, role, t in rows if p == pair and s == side)) for side in (True, False)]
        turns = [[(x[1] if x[2] else None, x[3] if x[4] else None) for x in s] for s in sides]
        n = next((i for i, (a, b) in enumerate(zip(*turns)) if a != b), min(map(len, turns)))  # noqa: B905
        render = lambda ts: "".join(f"<|im_start|>{a or 'unknown'}\n{b or ''}<|im_end|>\n" for a, b in ts)
        assert (r.n_shared, r.prompt, r.chosen, r.rejected) == (n, render(turns[0][:n]), render(turns[0][n:]), render(turns[1][n:]))
        for text, mask, own in ((r.chosen, r.chosen_mask, turns[0][n:]), (r.rejected, r.rejected_mask, turns[1][n:])):
            assert [text[s.start : s.end] for s in mask] == [f"{b or ''}<|im_end|>" for a, b in own if a == "assistant"]
    assert chat_format.preference_pairs(df.limit(0)).collect() == []


def test_url_parts_rules_and_spread(spark):
    rows = [(1, "http://A.Example.com/en/70?x", '<a href="https://friend.test/x">'), (2, "http://com/en/", None), (3, "no url", ""), (4, None, None), (5, "http://x.example.net/de/81#f", None), (6, "http://x.net/de/1", None), (7, "HTTP://friend.test/other", '<a HREF=//foe.test>'), (8, "http://foe.test?en/", '<a href="http://sub.example.org/es/1">'), (9, "http://sub.example.org/es/1", None), (9, "http://sub.example.org/es/1", None), (10, "a://b://c/d?e", None)]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    part = {i: (r.host, r.path, r.rule) for i, r in got.items()}
    assert part[1] == ("a.example.com", "/en/70", "example.com/en/7") and part[2] == ("com", "/en/", "com/en/") and part[3] == ("", "", None) == part[4]
    assert part[5] == ("x.example.net", "/de/81", "example.net/de/8") and part[6] == ("x.net", "/de/1", "net/de/") and part[8] == ("foe.test", "", None) and part[10] == ("b:", "//c/d", None)
    assert [got[i].verdict for i in (1, 2, 5, 6, 9)] == ["allow", "block", "block", "allow", "block"]
    assert got[7].trust > 0 and got[8].distrust > 0  # trust follows links, distrust goes against them
    assert got[8].verdict == "block" and got[3].verdict == "allow"


def test_language_by_compression(spark):
    rng = random.Random(4)
    words = {"en": "the and of with house river morning light".split(), "de": "der und von mit haus fluss morgen licht".split()}
    prose = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, prose(lang, rng.randrange(5, 80)), lang) for i, lang in enumerate(["en", "de"] * 60)]
    odd = [(900, None, "en"), (901, "", "de"), (902, "123 !!", "en"), (903, prose("en", 9000), None), (None, prose("de", 20), "de")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    made = language_id.fit(docs.where("doc_id < 60"))
    assert sorted(made) == ["de", "en"]
    got = {r.doc_id: r for r in language_id.identify(docs, made).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and got[903].lang_pred == "en" and got[None].lang_pred == "de"
    assert [(got[i].lang_pred, got[i].score, got[i].rejected) for i in (900, 901, 902)] == [("und", 0.0, True)] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(docs.limit(0))).collect()} == {"und"}


def test_language_is_that_of_the_smallest_compression(spark):
    """Against a plain loop: whole texts of the sample, one compressor for each piece."""
    import regex
    import zstandard as zstd

    rng = random.Random(11)
    words = {"en": "the and of with house river morning light".split(), "de": "der und von mit haus fluss morgen licht".split(), "xx": "zu ba ki lo".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.choice([1, 3, 20, 3000]))) + rng.choice(["", "½ ②!", " 12"]), lang) for i, lang in enumerate(["en", "de", "xx"] * 15)]
    rows += [(4, rows[4][1], "de")] * 3 + [(900, "½②", "en"), (901, "ß", None), (902, "x" * 9000, None), (None, "haus", "de")]
    docs = spark.createDataFrame([(*r, "old", 7) for r in rows], "doc_id long, text string, lang string, lang_pred string, Score int").repartition(4)
    made = language_id.fit(docs)
    clean = lambda t: regex.sub(r"[^\p{L}\p{M}]+", " ", t.lower()).encode()
    for lang in words:
        own = {(i, t) for i, t, x in rows if x == lang and i is not None}
        assert sorted(made[lang]) == sorted(b" ".join(clean(t) for _, t in own))
    got = language_id.identify(docs, made)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"] and got.count() == len(rows)
    for r in got.collect():
        if not regex.search(r"\p{L}", r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        raw, sizes = clean(r.text), {}
        for lang in sorted(made):
            for level in language_id.LEVELS:
                d = zstd.ZstdCompressionDict(made[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
                c = zstd.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
                sizes[lang] = sizes.get(lang, 0) + sum(len(c.compress(raw[k : k + language_id.PIECE])) for k in range(0, len(raw), language_id.PIECE))
        low = sorted(sizes.values())
        assert r.lang_pred == min(sizes, key=lambda x: (sizes[x], x)) and r.score == min(1.0, (low[1] - low[0]) / low[0]), r.text
    assert language_id.identify(docs.limit(0), made).collect() == []


def test_the_sample_is_bounded_and_alike(spark):
    rows = [(i, f"text {i}", "en" if i % 10 else "de") for i in range(5000)] + [(7, f"again {k}", "en") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = language_id.fit(docs, rows=50)
    other = language_id.fit(docs.repartition(13), rows=50)
    assert made == other and made["en"].count(b"text") + made["en"].count(b"again") == 50 == made["de"].count(b"text")


def test_toxicity_learns_stems(spark):
    rng = random.Random(6)
    plain = ["walk", "tree", "paper", "window", "garden", "letter", "music", "stone", "water", "evening"]
    bad = [f"vlork{e}" for e in ("", "s", "ing", "ed", "er", "ish")]
    def text(y, n):
        w = [rng.choice(plain) for _ in range(n)]
        if y:
            for _ in range(max(1, n // 15)):
                w[rng.randrange(n)] = rng.choice(bad)
        return " ".join(w)
    rows = [(i, text(i % 5 == 0, rng.randrange(10, 60))) for i in range(500)]
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "!!"), (903, "the vlorkable garden and the vlorkous tree by the water"), (904, " ".join(plain * 500)), (None, "walk")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)] + [(3, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([got[i].predicted == int(i % 5 == 0) for i in range(500)]) > 0.97
    assert got[903].predicted == 1 and got[904].predicted == 0
    assert got[900].score == got[901].score == got[902].score and 0 <= got[900].score <= 1
    flat = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(docs, flat).collect()} == {0}


def test_pipeline_keeps_columns_and_removes_what_it_should(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(7)
    prose = lambda n: ". ".join(" ".join(f"w{rng.randrange(9000)}" for _ in range(9)).capitalize() for _ in range(n // 9)) + "."
    passage, leak = prose(72), " ".join(f"t{k}" for k in range(14))
    rows = [(i, prose(90), "en", f"s{i % 7}", 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s1", 0), (101, rows[1][1].replace("W", "X", 1), "en", "s1", 0)]
    rows += [(200 + i, f"{prose(45)}\n{passage}\n{prose(45)}", "en", "s2", 0) for i in range(3)]
    rows += [(300, f"{prose(45)} {leak} {prose(45)}", "en", "s3", 0), (400, None, None, None, None), (401, "", "en", "s1", 0)]
    rows += [(500 + i, prose(45) + " vlorker vlorking vlork." * 4, "en", "s4", 0) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 500)) for i, *_ in rows if i < 40 or i >= 520], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, docs = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(C.STAGES) - 1:
            assert out.columns == C.COLUMNS
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len([i for i in seen["toxicity"] if i is not None and i >= 500]) <= 2 and set(range(60)) <= set(seen["toxicity"])
    assert not {100, 101} & set(seen["ngram_jaccard_join"]) and {0, 1} <= set(seen["ngram_jaccard_join"])
    assert [passage in seen["substring_dedup"][200 + i] for i in range(3)] == [True, False, False]
    assert 300 not in seen["benchmark_decontamination"] and set(range(60)) <= set(seen["benchmark_decontamination"])
    assert set(seen["mixing"]) <= set(seen["benchmark_decontamination"]) and len(seen["mixing"]) > 30
    assert {r.doc_id for r in C.run(spark, str(tmp_path)).select("doc_id").collect()} == set(seen["mixing"])
