"""Segmentation, repetition, packing, toxicity, pseudo-likelihood: brute force, round trips, held-out rows."""

import random
import re

import numpy as np
import pytest

from sitegrain.llm import lmscore, packing, pieces, repetition, toxicity
from sitegrain.llm.common import ship, tokenizer_file

SCHEMA = "doc_id long, text string, score string, kept int"
EDGE = [(1, None, "a", 1), (2, "", "b", 2), (None, "two words", None, None), (5, "same same same", "x", 3), (5, "same same same", "x", 3), (7, " \n\t ", None, 0)]


@pytest.fixture(scope="module")
def edge(spark):
    ship(spark)
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(tokenizer_file("piece_bpe_32k.model"), 4)


def all_segmentations(v, unit):
    if not unit:
        return [(0.0, (), ())]
    out = []
    for k in range(1, len(unit) + 1):
        entry = v.prefixes.get(unit[:k])
        options = [(entry[1], (entry[0],))] if entry else [(v.unknown, v.raw_ids(unit[0]))] if k == 1 else []
        for s, ids in options:
            out += [(s + r, ids + i, (*cut, k)) for r, i, cut in all_segmentations(v, unit[k:])]
    return out


@pytest.mark.parametrize("unit", ["▁there", "▁aaaa", "▁▁▁x", "▁日本", "▁\x00é", "▁", "▁thethe"])
def test_n_best_of_a_unit_is_the_best_of_all(encoder, unit):
    every = sorted(all_segmentations(encoder.v, unit), key=lambda x: (-x[0], x[2]))
    assert encoder.v.n_best(unit, 6) == [(s, i) for s, i, _ in every[:6]]
    score, gap, flat, sizes = encoder.v.ranked([unit])
    assert score[0] == every[0][0] and tuple(flat) == every[0][1]
    assert gap[0] == (every[0][0] - every[1][0] if len(every) > 1 else np.inf)


@pytest.mark.parametrize("text", ["ab the", "the the", "x  y", "日 a"])
def test_n_best_of_a_text_is_the_best_of_all(encoder, text):
    every = sorted((s for s, _, _ in all_segmentations(encoder.v, "▁" + text.replace(" ", "▁"))), reverse=True)
    found = encoder.encode([text])[0]
    assert [s for s, _ in found] == every[:4]
    assert len({tuple(i) for _, i in found}) == len(found)
    assert all(encoder.v.decode(i) == text for _, i in found)


def test_pieces_edge_rows(spark, edge):
    rows = pieces.encode_n_best(edge, 3).collect()
    assert {r.doc_id for r in rows} == {1, 2, None, 5, 7}
    assert [(r.rank, r.n_ids, r.score) for r in rows if r.doc_id == 1] == [(1, 0, 0.0)]
    decoded = pieces.decode_ids(pieces.encode_n_best(edge, 1)).collect()
    assert sorted(r.text for r in decoded if r.doc_id == 5) == ["same same same"] * 2
    assert pieces.encode_n_best(edge.limit(0)).count() == 0


def brute_repeats(words, least=5):
    n, covered, longest = len(words), set(), 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                covered |= {*range(i, i + k), *range(j, j + k)}
    return n, len(covered), longest


def test_repeats_equal_brute_force():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab c d".split()) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += [None, "", "x", "a b c d e " * 30, "z z z z z z z z"]
    n, covered, longest = repetition.repeats(texts, repetition.Rules())
    for t, *got in zip(texts, n, covered, longest, strict=True):
        assert tuple(got) == brute_repeats((t or "").split())


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    words, doc = rng.integers(0, 3, 50), np.repeat([0, 1, 2], [20, 1, 29])
    sa, lcp = repetition.suffix_array(words, doc)
    suffix = [tuple(words[i : np.searchsorted(doc, doc[i], "right")]) for i in range(50)]
    keys = [(doc[i], suffix[i]) for i in sa]
    assert keys == sorted(keys) and sorted(sa) == list(range(50))
    for k in range(1, 50):
        a, b = suffix[sa[k - 1]], suffix[sa[k]]
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == (same if doc[sa[k]] == doc[sa[k - 1]] else 0)


def test_rules_edge_rows(edge):
    rows = {r.doc_id: r for r in repetition.rated(edge, keep_text=True).collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept and rows[1].score == "a"
    assert (rows[5].word_chars, rows[5].n_words, rows[5].n_dup_lines) == (12, 3, 0)
    assert repetition.rated(edge).count() == 6 and repetition.rated(edge.limit(0)).count() == 0


def test_longest_repeat_decides_alone(spark):
    own = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    texts = [own(0, 900) + own(1, 150) + own(2, 800) + own(1, 150), own(0, 900) + own(1, 100) + own(2, 800) + own(1, 100)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in repetition.rated(df).collect()}
    assert [(rows[i].longest_repeat, rows[i].base_failed, rows[i].kept) for i in (0, 1)] == [(150, False, False), (100, False, True)]


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), packing.Encoder(path)
    texts = ["Don't stop, a's É́ x.y? <|endoftext|> İ क़ foo.'s", "", "a\u00a0b\x1cc \n\n d!..", "ﬁne ZWÖLF straße. ... (x)", "été,été;ÉTÉ 12 3.5%"]
    ids, sizes, _ = own.encode([*texts, None], 2)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for t, a, b in zip([*texts, ""], at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == [*plain.encode(t, add_special_tokens=False).ids, 2]


def test_full_memo_keeps_what_is_asked_for_again():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    plain, own, learned = Tokenizer.from_file(path), packing.Encoder(path, memo=300), []
    learn = own.learn
    own.learn = lambda new: (learned.extend(new), learn(new))[1]
    for k in range(12):
        texts = ["Twice, the Cat's twice!&& <|endoftext|> sat_. " * 2 + " ".join(f"w{chr(97 + k)}{chr(97 + i // 26)}{chr(97 + i % 26)}," for i in range(150)), None, "the (Cat) sat"]
        ids, sizes, _ = own.encode(texts, 2)
        exact = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert ids.tolist() == [i for x in exact for i in x] and sizes.tolist() == [len(x) for x in exact]
    assert learned.count("the") == 1 and learned.count("Twice,") == 1
    assert len(own.parts) < 600 and own.parts[packing._END] == 0


def test_cuts_cost_least():
    plan = packing.Plan(window=8, per_window=1, document_cut=0, sentence_cut=2, hard_cut=5, hard_step=4, least_step=1)
    rng = random.Random(5)

    def cost(ends, at, penalty):
        of, last, out = dict(zip(at, penalty, strict=True)), 0, 0
        for e in ends:
            k = e - last
            if k > 8:
                return 10**9
            out += (0 if k & (k - 1) == 0 else 8 - k) + 1 + of[e]
            last = e
        return out

    for _ in range(40):
        sizes = np.array([rng.randint(1, 9) for _ in range(rng.randint(1, 3))])
        sentences = np.array(sorted({rng.randint(1, int(sizes.sum())) for _ in range(2)}))
        at, penalty = (x.tolist() for x in packing.cuts_of(sizes, sentences, plan))
        best = min(cost([*(p for k, p in enumerate(at[:-1]) if m >> k & 1), at[-1]], at, penalty) for m in range(1 << (len(at) - 1)))
        assert cost(packing.best_cuts(at, penalty, plan), at, penalty) == best


def test_pieces_cover_every_document_once(spark, edge):
    plan = packing.Plan(window=64, hard_step=16, least_step=4, block=200)
    docs = spark.range(30).selectExpr("id as doc_id", "repeat(concat('word', id, ' and more. '), cast(id as int)) as text").coalesce(2)
    rows = packing.pack(docs, plan).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(30))
    for parts in by_doc.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and len(r.ids) == r.length > 0
            at += r.length
        assert at == parts[0].doc_tokens and parts[-1].ids is not None
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert sorted(r.doc_tokens for r in packing.pack(edge).collect())[:3] == [1, 1, 1]
    assert packing.pack(edge.limit(0)).count() == 0


def brute_kernel(a, b, decay):
    from itertools import combinations

    def feature(c):
        out = {}
        for i in combinations(range(len(c)), 3):
            key = tuple(c[x] for x in i)
            out[key] = out.get(key, 0) + decay ** (i[-1] - i[0] + 1)
        return out

    x, y = feature(toxicity.codes(a)), feature(toxicity.codes(b))
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_equals_brute_force():
    words = ["loser", "l0ser", "l.o.s.e.r", "banana", "aaaa", "été", "strange"]
    tables = np.stack([toxicity.table_of(w, 0.6) for w in words], 1).astype(np.float32)
    got = toxicity.kernel(words, tables, 0.6)
    assert np.allclose(got, [[brute_kernel(a, b, 0.6) for b in words] for a in words], atol=1e-4)


def test_toxicity_held_out(spark, edge):
    rng = random.Random(2)
    plain = ["river", "stone", "window", "paper", "morning", "garden", "letter", "silver", "bridge", "candle", "winter", "table"]
    bad = ["moronic", "loserly", "scumbag"]
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(20)]
        if toxic:
            words[rng.randrange(20)] = rng.choice(bad)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(docs, docs.filter("doc_id % 3 <> 1").select("doc_id", "toxic"))
    got = toxicity.scored(docs, machine).filter("doc_id % 3 = 1").collect()
    assert all(r.predicted == r.toxic for r in got)
    odd = machine.probability(toxicity.Scorer(machine).highest(["river s.c.u.m.b.a.g stone", "river m o r o n i c stone", "window garden", "", None]))
    assert odd[0] > 0.5 and odd[1] > 0.5 and max(odd[2:]) < 0.5
    out = toxicity.scored(edge, machine)
    assert out.count() == 6 and dict(out.dtypes)["score"] == "double" and out.columns[:3] == ["doc_id", "text", "kept"]
    assert toxicity.train(docs, docs.filter("toxic = 0").select("doc_id", "toxic")) is None
    assert {r.score for r in toxicity.scored(edge, None).collect()} == {0.0}


def test_toxicity_is_learned_beside_texts_without_units(spark):
    short, rows = ["En de ja de y.", "", " \n", "a b", "ab cd"], []
    for i in range(60):
        rows += [(2 * i, f"river stone window {i}", 0), (2 * i + 1, f"moronic river stone {i}", 1)]
    rows += [(1000 + i, t, 0) for i, t in enumerate(short)] + [(2000, "x y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.scored(docs, toxicity.train(docs, docs.select("doc_id", "toxic"))).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.toxic if r.doc_id < 1000 else 0) for r in got)
    only_short = docs.filter("doc_id >= 1000")
    assert toxicity.train(only_short, only_short.select("doc_id", "toxic")) is None


def test_pseudo_likelihood(spark, edge):
    docs = spark.createDataFrame([(i, "the cat sat on the mat . " * 40) for i in range(20)] + [(99, "mat the on sat cat the . " * 40)], "doc_id long, text string")
    model = lmscore.train(docs)
    rows = {r.doc_id: r for r in lmscore.scored(docs, model).collect()}
    assert rows[3].n_words == 280 and rows[3].mean_log_likelihood > rows[99].mean_log_likelihood
    n, kind, cell, context = lmscore.places(["a b", None, "c"], model.shape)
    assert n.tolist() == [2, 0, 1] and (context[2] == model.shape.classes * model.shape.inputs).all()
    total = sum(np.exp(lmscore.log_softmax(model.weights, context)[2][0][k] + model.shares[k * model.shape.per_class : (k + 1) * model.shape.per_class]).sum() for k in range(model.shape.classes))
    assert abs(total - 1) < 1e-4
    got = lmscore.scored(edge, model).collect()
    assert len(got) == 6 and {r.log_likelihood for r in got if r.doc_id in (1, 2, 7)} == {0.0} and all(r.mean_log_likelihood is None for r in got if r.doc_id in (1, 2, 7))
    assert lmscore.scored(edge.limit(0), lmscore.train(edge.limit(0))).count() == 0


def test_pseudo_likelihood_tells_words_of_one_cell_apart(spark):
    from collections import defaultdict

    from sitegrain.llm.common import hashed_words

    shape, at = lmscore.Shape(), defaultdict(list)
    names = [f"n{i}ing" for i in range(20_000)]
    for w, cell in zip(names, lmscore.places([" ".join(names)], shape)[2].tolist(), strict=True):
        at[cell].append(w)
    often, seldom, never = next(x for x in at.values() if len(x) > 2)[:3]
    docs = spark.createDataFrame([(i, f"here is {often} again . " * 30) for i in range(20)] + [(50, f"there was {seldom} once .")], "doc_id long, text string")
    model = lmscore.train(docs)
    assert model.table.count() == len({w for r in docs.collect() for w in r.text.split()})
    ask = spark.createDataFrame([(k, f"here is {w} again .") for k, w in enumerate((often, seldom, never))], "doc_id long, text string")
    mean = {r.doc_id: r.log_likelihood for r in lmscore.scored(ask, model).collect()}
    assert mean[0] > mean[1] + 1 and mean[1] > mean[2]
    # Within a class the words and the rest sum to one under every gate, and gates tell contexts apart.
    rows = {r["word"]: list(r)[1:] for r in model.table.collect()}
    words = sorted({w for r in docs.collect() for w in r.text.split()})
    _, kind, cell, _ = lmscore.places([" ".join(words)], shape)
    sums = np.array([rows[int(hashed_words(w.encode())[0].view(np.int64)[0])] for w in words])
    gates = np.eye(shape.gates)[2][None].repeat(len(words), 0)
    for k in set(kind.tolist()):
        own = kind == k
        seen = model.within(kind[own], cell[own], sums[own], gates[own]).sum()
        cells = np.arange(k * shape.per_class, (k + 1) * shape.per_class)
        unseen = model.within(np.full(shape.per_class, k), cells, np.zeros((shape.per_class, shape.gates)), gates[:1].repeat(shape.per_class, 0)).sum()
        assert abs(seen + unseen - 1) < 1e-4


def test_sums_travel_in_half_the_columns(spark):
    rows = [(1, 0.0, 2147483520.0, 7.0, 0.0), (2, 1.0, 0.0, 0.0, 2147483520.0), (-3, 5.0, 6.0, 7.0, 8.0)]
    table = spark.createDataFrame(rows, "word long, " + ", ".join(f"s{k} float" for k in range(4)))
    for most, columns in ((2**31 - 128, 2), (2**31, 4)):
        got = lmscore.packed(table, [f"s{k}" for k in range(4)], most).toPandas().sort_values("word")
        assert len(got.columns) == 1 + columns
        assert lmscore.unpacked(got.drop(columns="word").to_numpy(np.int64), 4).tolist() == [list(r[1:]) for r in sorted(rows)]


def test_gradients_in_blocks_are_those_of_the_whole():
    shape, rng = lmscore.Shape(), np.random.default_rng(3)
    weights = [w + rng.normal(0, 0.3, w.shape).astype(np.float32) for w in shape.start()]
    kind, context = rng.integers(0, shape.classes, 5000), rng.integers(0, len(weights[0]), (5000, 2 * shape.side))
    grads = [np.zeros_like(w) for w in weights]
    for lo in range(0, 5000, 1700):
        lmscore.Trainer(shape, weights).back(kind[lo : lo + 1700], context[lo : lo + 1700], 5000, grads)
    emb, w1, b1, w2, b2 = (w.astype(float) for w in weights)
    x = emb[context].reshape(5000, -1)
    hidden = np.tanh(x @ w1 + b1)
    d = np.exp(hidden @ w2 + b2)
    d /= d.sum(1, keepdims=True)
    assert np.abs(np.exp(lmscore.log_softmax(weights, context)[2]) - d).max() < 1e-4
    d[np.arange(5000), kind] -= 1
    d /= 5000
    dh = (d @ w2.T) * (1 - hidden * hidden)
    de = np.zeros_like(emb)
    np.add.at(de, context.ravel(), (dh @ w1.T).reshape(-1, shape.width))
    for got, exact in zip(grads, [de, x.T @ dh, dh.sum(0), hidden.T @ d, d.sum(0)], strict=True):
        assert np.abs(got - exact).max() < 1e-4 * max(1, np.abs(exact).max())


def test_words_part_at_blanks_only():
    from sitegrain.llm.common import hashed_words

    text = "a\u00a0b c\x0bd\x1ce a\u00a0b\n"
    h, starts, ends = hashed_words(text.encode())
    assert [text.encode()[a:b].decode() for a, b in zip(starts, ends, strict=True)] == re.findall(r"[^\x20\x09-\x0D]+", text)
    assert h[0] == h[-1] and len(set(h.tolist())) == len(h) - 1


def test_marks_in_a_row_and_long_units_are_read_in_time():
    import time

    began = time.perf_counter()
    for text in ("Name: " + "_" * 10_000 + "ab", "a_" * 5_000 + "aa", "a b " * 5_000 + "cc", "- " * 10_000):
        toxicity.units_of(text)
    assert time.perf_counter() - began < 2
    assert "idiot" in toxicity.units_of("you i d-i_o t there")


def test_long_positive_units_are_bags_of_windows():
    clean = ["abcdefghijklmnop", "abcdefghijklmnopqrstuvwxabcd", "harmless", "words", "of", "every", "kind", "table", "garden"] * 3
    machine = toxicity.fit_units({"abcdefghijklmnopbadword": 9, "badword": 20}, clean, toxicity.Training(landmarks=16))
    insult, harmless, longer = machine.decide(["badword", "abcdefghijklmnop", "abcdefghijklmnopqrstuvwxabcd"])
    assert insult > 0 > max(harmless, longer)


def test_release_lets_go_of_other_operators_only():
    from sitegrain.llm import common

    before = common.hashed_words(b"two words")[0].tolist()
    common.held(("first",), object)
    common.release("first")
    assert not common._HELD and not common._POWERS
    kept = common.held(("first",), object)
    assert common.hashed_words(b"two words")[0].tolist() == before
    common.release("first")
    assert common.held(("first",), object) is kept and common._POWERS
    common.release("second")
    assert not common._HELD and not common._POWERS


def test_digests_are_found_among_words():
    rng = np.random.default_rng(5)
    for n, more in ((0, []), (1, []), (40, [0, (1 << 64) - 1]), (3000, list(range(500)))):  # the last: all in one place
        words = np.unique(np.concatenate([rng.integers(0, 1 << 64, n, dtype=np.uint64), np.array(more, np.uint64)]))
        asked = np.concatenate([words, rng.integers(0, 1 << 64, 500, dtype=np.uint64), np.array([1, 700, (1 << 64) - 2], np.uint64)])
        place = {w: i for i, w in enumerate(words.tolist())}
        assert lmscore.found_at(words, asked).tolist() == [place.get(h, len(words)) for h in asked.tolist()]


def test_steps_are_those_of_adam():
    shape, rng = lmscore.Shape(), np.random.default_rng(8)
    trainer = lmscore.Trainer(shape, shape.start())
    weights = [w.astype(float) for w in shape.start()]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in (1, 2, 3):
        kind, context = rng.integers(0, shape.classes, 3000), rng.integers(0, len(weights[0]), (3000, 2 * shape.side))
        grads = [np.zeros_like(w) for w in trainer.weights]
        trainer.back(kind, context, 3000, grads)
        trainer.step(kind, context)
        for w, a, b, g in zip(weights, m, v, grads, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= shape.rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
        assert max(np.abs(x - w).max() for x, w in zip(trainer.weights, weights, strict=True)) < 2e-3
