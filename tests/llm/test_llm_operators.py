"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and no rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "on", "su", "ve") for b in ("ra", "ne", "tol", "is", "um", "ax")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "x"), (None, "a null id"), (5, "same row"), (5, "same row"), (6, "é ñ ß 日本 😀"), (7, None, None, None)]


def test_token_store_round_trip(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from quarterdeck.llm.token_store import token_output

    rows = EDGE + [(100 - i, prose(i, 50 * i) + " It's!! THE <|endoftext|> 12ab") for i in range(12)]
    path = public.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    got = token_output(docs(rows), path, shard_ids=500, ).collect()
    whole = token_output(docs(rows), path, shard_ids=500).selectExpr("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, whole), key=str)
    want = collections.Counter()
    for key, text, *_ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want[key, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    place = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert token_output(docs([]), path).count() == 0


def test_shard_codec_outliers():
    from quarterdeck.llm.token_store import decode_shard, encode_shard

    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 1000):
        ids = rng.integers(0, 200, n).astype(np.uint32)
        if n > 5:
            ids[::40] = 2**32 - 1 - np.arange(len(ids[::40]), dtype=np.uint32)
        back, lengths, keys = decode_shard(encode_shard(ids, [n], [None]))
        assert (back == ids).all() and list(lengths) == [n] and keys == [None]


def test_mixing_meets_targets(spark, docs):
    from quarterdeck.llm.mixing import mix, mix_counts, splitting_tree, targets

    rows = [(i, prose(i, 5 + i % 40), "en", f"s{i % 4}" if i % 9 else None) for i in range(400)] + [(1000, "w " * 9000, "en", "s1"), (None, None, "en", "s0"), (5, "dup"), (5, "dup")]
    d = docs(rows)
    got = mix_counts(d).collect()
    assert len(got) == len(rows)
    again = mix_counts(d.repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    by = collections.defaultdict(lambda: [0, 0, 0])
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source_size, r.target][0] += r.size
        by[r.source_size, r.target][1] += r.taken
    for (size, target), (words, taken, _) in by.items():
        assert words % size == 0 and taken == int(target)
    total = sum(r.size for r in got)
    assert sum(int(t) for _, t in by) <= 1.5 * total + 1
    out = mix(d)
    assert out.columns == d.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in out.collect())
    assert words == sum(r.taken for r in got)
    assert targets([10, 10, 10], [5, 2, 1], 1.5, 2.0) == [20.0, 45 * 0 + 25 * 2 / 3, 25 / 3]
    tree = splitting_tree([7, 100, 0, 3], [1] * 5, 1)
    assert tree.sum(axis=0).tolist() == [7, 100, 0, 3] and tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 3
    assert mix_counts(docs([])).count() == 0 and mix(docs([])).count() == 0


def test_mixing_by_brute_force(spark, docs, monkeypatch):
    """What the dealt units give, over shards, by plain loops over the plan's own permutation."""
    from quarterdeck.llm import mixing as M

    rows = [(i, prose(i, 3 + i % 30), "en", f"s{i % 3}") for i in range(700)] + [(9000 + i, None, "en", "s1") for i in range(3)] + [(5, "dup x", "en", "s2")] * 3
    d = docs(rows)
    monkeypatch.setattr(M, "GROUPS", 4)
    plan = M.mix_plan(d, shard_words=900).collect()
    sized = {(r["mix\x01id"], bytes(r["mix\x01text"]), k): r for k, r in enumerate(M._sized(d, 7).collect())}
    by = collections.defaultdict(list)
    for r in sized.values():
        by[r["source"]].append(r)
    want = collections.Counter()
    sizes = [sum(r["mix_size"] for r in by[s]) for s in sorted(by)]
    for source, target, size in zip(sorted(by), M.targets(sizes, M.WEIGHTS, 1.5, 2.0), sizes):
        blocks = max(1, math.ceil(len(by[source]) / M.BLOCK_DOCS))
        left = int(target) % size
        for r in sorted(by[source], key=lambda r: (int(((r["mix_h"] & (2**64 - 1)) >> 11) / 2.0**53 * blocks), r["mix_h"], r["mix_g"], r["doc_id"])):
            last = min(r["mix_size"], left)
            left -= last
            want[r["doc_id"], r["mix_size"], int(target) // size * r["mix_size"] + last] += 1
    assert collections.Counter((r["doc_id"], r["mix_size"], r["mix_taken"]) for r in plan) == want
    shards = collections.Counter()
    for r in plan:
        for x in r["mix_draws"]:
            shards[x["shard"]] += x["words"]
    total = sum(shards.values())
    assert len(shards) == math.ceil(total / 900) or len(shards) >= 5
    assert max(shards.values()) < 6 * total / len(shards)
    text = collections.Counter((r.doc_id, r.text) for r in M.mix(d, shard_words=900).collect())
    whole = {r[0]: r[1] for r in rows}
    assert all(t is None or whole[k].startswith(t) for k, t in text)
    assert sum(n * len((t or "").split()) for (_, t), n in text.items()) == total
    tree = M.splitting_tree([30, 70], [3, 1, 2], 1)
    assert tree.sum(axis=0).tolist() == [30, 70] and tree.sum(axis=1).tolist() == [50, 16, 34]


def labelled(n):
    """Good prose, and bad texts of shouting or bars, with labels."""
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(i, 60 + i % 30)
        if bad:
            text = "!! ".join(text.upper().split()) if i % 8 else " | ".join(text.split())
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_quality_classifier_held_out(spark, docs):
    from quarterdeck.llm.quality import classify, train

    rows, labels = labelled(400)
    label = spark.createDataFrame(labels + labels[:3] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    d = docs(rows + EDGE)
    got = classify(d, train(d, label)).collect()
    assert len(got) == len(rows) + len(EDGE) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.doc_id is not None and r.doc_id > 7 and r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    empty = train(docs([]), label.limit(0))
    assert all(0 < r.score < 1 for r in classify(d, empty).collect()) and classify(docs([]), empty).count() == 0


def test_toxicity_counterfactual(spark, docs):
    from quarterdeck.llm.toxicity import classify, train

    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 1
        text = prose(i, 30)
        # a group's name goes with toxic texts more often, but insults decide
        if toxic:
            text += " you worthless scum" + (" muslims" if i % 10 == 1 else "")
        elif i % 50 == 0:
            text += " the muslims came"
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = docs(rows)
    model = train(d, label)
    got = {r.doc_id: r for r in classify(d, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == (i % 5 == 1) for i in held]) > 0.97
    plain = train(d, label, penalty=0.0)
    neutral = b"we met muslims today"
    assert model.logit(neutral) <= plain.logit(neutral) and model.logit(neutral) < 0
    gap = abs(model.logit(b"we met muslims today") - model.logit(b"we met christians today"))
    assert gap < 0.5 * abs(plain.logit(b"we met muslims today") - plain.logit(b"we met christians today")) + 1e-6
    edge = classify(docs(EDGE), model).collect()
    assert len(edge) == len(EDGE) and all(0 <= r.score <= 1 for r in edge)
    assert all(r.predicted == 0 for r in classify(d, train(docs([]), label.limit(0))).collect())


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_decision_list(spark, docs):
    from quarterdeck.llm import common
    from quarterdeck.llm.decision_list import judge, learn, statistics

    rows, labels = labelled(400)
    rows += EDGE + [(2000, "a b c a b c x"), (2001, "l one\nl one\n\n \nl one\n"), (2002, " x\x1cy z " * 90), (2003, prose(1, 20_000))]
    d = docs(rows)
    stats = common.written(statistics(d), "t")
    rules = learn(stats, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert rules.rules
    out = judge(stats, rules)
    assert "Python" not in out._jdf.queryExecution().toString()
    want = collections.Counter((r[0], *brute_statistics(r[1])) for r in rows)
    got = out.collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    kept = {r.doc_id: r.kept for r in got}
    assert not any(r.kept and r.base_failed for r in got)
    assert np.mean([kept[i] == bool(q) for i, q, _ in labels if i > 7]) > 0.97
    none = learn(stats, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not none.rules and all(r.kept != r.base_failed for r in judge(stats, none).collect())
    assert judge(statistics(docs([])), none).count() == 0


def test_language_id(spark, docs):
    from quarterdeck.llm.language_id import identify, train

    kinds = {"aa": ["zorba", "kelim", "vanto"], "bb": ["übrig", "schön", "weiß"], "cc": ["niño", "señal", "mañana"]}
    rows = []
    for i in range(300):
        lang = sorted(kinds)[i % 3]
        r = random.Random(i)
        rows.append((i, " ".join(r.choice(kinds[lang]) for _ in range(3 + i % 60)), lang if i % 10 else None))
    d = docs(rows)
    got = {r.doc_id: r for r in identify(d, train(d)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == sorted(kinds)[i % 3] for i in held]) > 0.95
    model = train(d)
    edge = identify(docs(EDGE + [(50, "12 34 !!"), (51, "zorba kelim " * 9000)]), model).collect()
    by = {r.doc_id: r for r in edge}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 50)) and by[51].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in edge)
    assert identify(docs([]), model).count() == 0 and identify(docs([(1, "x")]), train(docs([]))).count() == 1


def test_recurrent_network_by_brute_force():
    """Every position by plain recursions over the whole text, the gradient by differences, and weights at their bounds."""
    from quarterdeck.llm import language_id as L

    rng = np.random.default_rng(4)
    k, langs = 3, ["a", "b", "c"]
    make = lambda *shape: (rng.standard_normal(shape) * 0.4).astype(np.float32)
    model = L.LanguageModel(langs, L.Direction(make(256, 3 * k), make(k, 3 * k)), L.Direction(make(256, 3 * k), make(k, 3 * k)), make(2 * k, 3), make(3))
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (1, 5, 511, 512, 513, 700, 1600)] + [b""]
    offsets = np.cumsum([0] + [len(t) for t in texts])

    def states(d, x):
        h, out, sig = np.zeros(k), [], lambda v: 1 / (1 + np.exp(-2 * v))
        for byte in x:
            a, u = d.table[byte].astype(float), h @ d.state.astype(float)
            z, r = sig(a[:k] + u[:k]), sig(a[k : 2 * k] + u[k : 2 * k])
            n = np.tanh(a[2 * k :] + r * u[2 * k :])
            h = (1 - z) * n + z * h
            out.append(h)
        return np.array(out)

    got = model.documents(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for t, p in zip(texts, got):
        if t:
            logits = np.concatenate([states(model.forward, t), states(model.backward, t[::-1])[::-1]], axis=1) @ model.out + model.bias
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            assert np.allclose(p, (e / e.sum(axis=1, keepdims=True)).mean(axis=0), atol=2e-3)
    d, x = L.Direction(make(256, 3 * k).astype(float), make(k, 3 * k).astype(float)), rng.integers(97, 100, (6, 2))
    weight = rng.standard_normal((6, 2, k))
    loss = lambda: float((L._run(d, x)[0] * weight).sum())
    table, state = L._back(d, x, L._run(d, x)[1], weight)
    for array, gradient, at in ((d.table, table, (98, 1)), (d.table, table, (99, 5)), (d.table, table, (97, 8)), (d.state, state, (0, 2)), (d.state, state, (2, 4)), (d.state, state, (1, 7))):
        kept, values = array[at], []
        for step in (1e-3, -1e-3):
            array[at] = kept + step
            values.append(loss())
        array[at] = kept
        assert abs((values[0] - values[1]) / 2e-3 - gradient[at]) < 2e-3
    top = L.LanguageModel(langs, L.Direction(np.full((256, 24), 6, np.float32), np.full((8, 24), 6, np.float32)), L.Direction(np.full((256, 24), 6, np.float32), np.full((8, 24), 6, np.float32)), np.tile(np.array([6, -6, 6], np.float32), (16, 1)), np.full(3, 6, np.float32))
    assert np.isfinite(top.documents(np.frombuffer(b"".join(texts), np.uint8), offsets)).all()


def brute_spans(texts, length=200):
    c = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings(spark, docs):
    from quarterdeck.llm.suffix_dedup import remove_repeats

    a, b = prose(1, 100), prose(2, 60)
    common = prose(3, 26)[:150]
    rows = EDGE + [(10, a), (11, prose(4, 20) + a[100:420] + prose(5, 30)), (12, a[:199]), (13, a[:200]), (14, "ab" * 400), (15, b + b[:250]), (16, "ß" * 150), (17, "x" * 199), (18, prose(9, 2000))]
    rows += [(20 + i, prose(100 + i, 20) + common + prose(200 + i, 20)) for i in range(8)] + [(40, prose(8, 90)), (41, prose(8, 90)), (40, prose(8, 90))]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs(rows)).collect())
    want = collections.Counter((r[0], *x) for r, x in zip(rows, brute_spans([(r[1] or "").encode() for r in rows])))
    assert got == want
    few = [(i, prose(i, 12) + "abcdefghij" * (i % 3)) for i in range(9)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs(few), length=10).collect()}
    assert got == {r[0]: x for r, x in zip(few, brute_spans([r[1].encode() for r in few], 10))}
    assert remove_repeats(docs([])).count() == 0


def test_repeated_strings_of_hot_triggers_and_small_blocks(spark, docs, monkeypatch):
    from quarterdeck.llm import suffix_dedup as S

    common = prose(3, 40)[:220]  # one trigger in many different phrases
    rows = [(i, prose(100 + i, 20) + common[i % 7 : 215 + i % 5] + prose(200 + i, 20 + i)) for i in range(60)] + [(70, "abc" * 500), (71, "\xe9" * 400)]
    want = sorted((r[0], *x) for r, x in zip(rows, brute_spans([r[1].encode() for r in rows])))
    for kinds, block in ((3, 4 << 20), (4096, 300), (8, 300)):
        monkeypatch.setattr(S, "HOT_KINDS", kinds)
        monkeypatch.setattr(S, "BLOCK", block)
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(docs(rows)).collect())
        assert got == want


def test_suffix_array_to_a_depth():
    from quarterdeck.llm.suffix_dedup import shared_windows

    r = random.Random(5)
    for trial in range(200):
        length = r.choice([1, 2, 5, 8, 9, 16, 20])
        texts = [bytes(r.choice(b"ab") for _ in range(r.randint(length, 40))) for _ in range(r.randint(0, 8))]
        c = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want, place = set(), 0
        for t in texts:
            want |= {place + i for i in range(len(t) - length + 1) if c[t[i : i + length]] > 1}
            place += len(t)
        first, last = shared_windows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64), length)
        assert {p for a, b in zip(first, last) for p in range(a, b + 1)} == want


def test_context_tree_scoring(spark, docs):
    from quarterdeck.llm.lm_scoring import score

    story = prose(77, 150).split()
    rows = EDGE + [(10 + i, " ".join((story[i % 100 :] + story)[:60]).title()) for i in range(120)]
    got = score(docs(rows), min_share=2.0**-9).collect()
    assert len(got) == len(rows)
    token = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())) + [b"\n"]
    held = lambda k: zlib.crc32((str(k) if k is not None else "").encode()) % 7 == 2
    c = collections.Counter(w for k, t, *_ in rows if not held(k) for w in token(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((k, held(k), len(token(t)), sum(c[w] > 0 for w in token(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in token(t)), 6)) for k, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and np.mean([r.score > r.base_score for r in got if r.held_out and r.n_tokens > 9]) > 0.9
    assert score(docs([])).count() == 0


def test_context_tree_mixes_all_depths():
    """Against the recursion, with exact fractions: one decision of a byte, contexts of up to two bytes, all kept."""
    from fractions import Fraction

    from quarterdeck.llm.lm_scoring import build_tree, grams, stream

    text = b"abababbaabab"
    x, starts = stream(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 2)
    g, n = grams(x, starts, np.array([len(text)]), 2)
    cells = collections.Counter()
    for code, count in zip(g.tolist(), n.tolist()):
        for d in range(3):
            cells[(d << 48) | ((code >> 8) & ((1 << 8 * d) - 1)), code & 255] += count
    keys = np.unique([k for k, _ in cells])
    tree = build_tree(keys, np.array([k for k, _ in cells]), np.array([b for _, b in cells]), np.array([*cells.values()], float), 2)
    p = 10.0 ** tree.log10.reshape(len(keys), 256)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)

    def counts(key, bits):  # zeros and ones of the decision after the first bits
        out = [0, 0]
        for (k, b), c in cells.items():
            if k == key and f"{b:08b}"[: len(bits)] == bits:
                out[int(f"{b:08b}"[len(bits)])] += c
        return out

    def estimate(a, b):
        out, done = Fraction(1), 0
        for bit, n in ((0, a), (1, b)):
            for i in range(n):
                out *= (Fraction(1, 2) + i) / (done + 1)
                done += 1
        return out

    def children(key):
        d, c = key >> 48, key & ((1 << 48) - 1)
        return [k for k in keys.tolist() if k >> 48 == d + 1 and (k & ((1 << 8 * d) - 1)) == c] if d < 2 else []

    def weighted(key, bits):
        own = estimate(*counts(key, bits))
        if not children(key):
            return own
        product = Fraction(1)
        for k in children(key):
            product *= weighted(k, bits)
        return (own + product) / 2

    def predict(path, bits):  # probability of a one, mixing along the path of contexts
        key = path[0]
        a, b = counts(key, bits)
        own = (b + Fraction(1, 2)) / (a + b + 1)
        if not children(key):
            return own
        stop = estimate(a, b) / 2 / weighted(key, bits)
        return stop * own + (1 - stop) * predict(path[1:], bits)

    state = int(np.searchsorted(keys, (2 << 48) | (ord("a") << 8) | ord("b")))
    path = [0, (1 << 48) | ord("b"), (2 << 48) | (ord("a") << 8) | ord("b")]
    want = Fraction(1)
    for k, bit in enumerate(f"{ord('a'):08b}"):
        one = predict(path, f"{ord('a'):08b}"[:k])
        want *= one if bit == "1" else 1 - one
    assert abs(p[state, ord("a")] / float(want) - 1) < 1e-4


def test_context_tree_of_a_huge_corpus_is_finite():
    from quarterdeck.llm.lm_scoring import build_tree, least_share

    rng = np.random.default_rng(3)
    leaves = np.unique(rng.integers(97, 123, (400, 3)), axis=0)  # contexts of three bytes and their next bytes
    for scale in (1e3, 1e9, 1e12, 1e14):
        cells = collections.Counter()
        for k, (a, b, c) in enumerate(leaves.tolist()):
            for d, key in ((0, 0), (1, c), (2, b << 8 | c), (3, a << 16 | b << 8 | c)):
                for byte in (97 + k % 26, 97 + k % 7, 32):
                    cells[d << 48 | key, byte] += int(scale / len(leaves) * (1 + k % 5))
        keys = np.unique([k for k, _ in cells])
        tree = build_tree(keys, np.array([k for k, _ in cells]), np.array([b for _, b in cells]), np.array([*cells.values()]), 3)
        p = 10.0 ** tree.log10.astype(np.float64).reshape(len(keys), 256)
        assert np.isfinite(tree.log10).all() and np.allclose(p.sum(axis=1), 1, atol=1e-3)
    assert [round(-math.log2(least_share(n)), 1) for n in (0, 1 << 20, 1 << 28, 1 << 36, 1 << 50)] == [16, 16, 17, 19, 19]


def test_near_duplicates(spark, docs):
    from quarterdeck.llm.near_duplicates import keep_one, near_duplicate_classes

    base = [prose(1000 + i, 120) for i in range(30)]
    rows, group = [], {}
    for i in range(30):
        for j in range(1 + i % 4):
            w = base[i].split()
            if j:
                w[7 * j] = "changed"
            group[len(rows) + 10] = i
            rows.append((len(rows) + 10, " ".join(w) if j % 2 == 0 else " ".join(w).upper() + "!"))
    far = prose(5000, 60).split()
    rows += [(900, " ".join(far)), (901, " ".join(far[:30] + prose(5001, 30).split())), (902, "two words"), (903, "two words"), *EDGE]
    d = docs(rows)
    got = near_duplicate_classes(d).collect()
    assert len(got) == len(rows)
    cls = {}
    for r in got:
        cls.setdefault(r.doc_id, r.class_id)
    members = collections.defaultdict(set)
    for k, g in group.items():
        members[g].add(cls[k])
    assert all(len(m) == 1 for m in members.values()) and len({c for m in members.values() for c in m}) == 30
    assert cls[900] != cls[901] and cls[902] == cls[903]
    assert cls[1] != cls[2] and cls[2] != cls[3]
    kept = keep_one(d)
    assert kept.columns == d.columns and kept.count() == sum(r.kept for r in got)
    assert near_duplicate_classes(docs([])).count() == 0 and keep_one(docs([])).count() == 0


def test_hot_group_of_near_copies(spark, docs, monkeypatch):
    from quarterdeck.llm import near_duplicates as N

    monkeypatch.setattr(N, "GROUP", 16)
    w = prose(1, 200).split()
    rows = [(i, " ".join(w[: 3 * i % 190] + [f"edit{i}"] + w[3 * i % 190 :])) for i in range(120)] + [(500 + i, prose(300 + i, 80)) for i in range(20)]
    got = {r.doc_id: r.class_id for r in N.near_duplicate_classes(docs(rows)).collect()}
    assert len({got[i] for i in range(120)}) == 1 and len({got[500 + i] for i in range(20)}) == 20


def test_decontamination(spark, docs):
    from quarterdeck.llm.decontamination import clean, contaminated, edit_distance_in

    def slow(a, b):
        prev = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return min(prev)

    r = random.Random(3)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(lo, 15))) for lo in (1, 0))
        assert edit_distance_in(a, b) == slow(a, b)
    items = [(i, prose(7000 + i, 12 + i)) for i in range(40)] + [(90, None), (91, ""), (92, "one two"), (93, "!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [*EDGE]
    for i in range(40):
        w = items[i][1].split()
        if i % 3 == 1:
            w[5] = "zzz"
        text = " ".join(w).upper() if i % 2 else " ".join(w)
        rows.append((100 + i, prose(i, i * 3) + " " + text + ", " + prose(i + 60, 20)))
        rows.append((200 + i, prose(9000 + i, 150)))
        rows.append((300 + i, prose(i, 20) + " " + " ".join(w[: len(w) // 2]) + " " + prose(9500 + i, 40)))
    d = docs(rows)
    got = {(x.doc_id, x.item_id): x for x in contaminated(d, bench).collect()}
    found = [i for i in range(40) if (100 + i, i) in got]
    assert len(found) >= 39 and all(k[0] - 100 == k[1] for k in got)
    assert all(got[100 + i, i].edit_distance == 0 for i in found if i % 3 != 1) and all(x.similarity >= 0.8 for x in got.values())
    left = clean(d, bench)
    assert left.columns == d.columns and left.count() == len(rows) - len(found)
    assert contaminated(docs([]), bench).count() == 0 and clean(d, bench.limit(0)).count() == len(rows)


def test_decontamination_recall_and_blocks(spark, docs, monkeypatch):
    """Edits down to the threshold against an exact scan of all pairs; items of string ids over several blocks."""
    from quarterdeck.llm import decontamination as D

    r = random.Random(11)
    items = [(f"item {i}", prose(4000 + i, 9 + i % 40)) for i in range(60)]
    rows = []
    for i, (_, text) in enumerate(items):
        for share in (0.08, 0.14, 0.18):
            w = [x for y in text.split() for x in ([y] if r.random() > share else [[r.choice(WORDS)], [], [y, r.choice(WORDS)]][r.randrange(3)])]
            rows.append((len(rows), prose(len(rows), r.randrange(30)) + " " + " ".join(w) + " " + prose(len(rows) + 1, 25)))
    normal = lambda t: b" ".join(D.normal_words(t)).decode()
    want = {(k, i) for k, t in rows for i, x in items if D.edit_distance_in(normal(x), normal(t)) <= 0.2 * len(normal(x)) + 1e-9}
    assert len(want) > 120
    for block in (20_000, 25):
        monkeypatch.setattr(D, "BLOCK_ITEMS", block)
        got = {(x.doc_id, x.item_id) for x in D.contaminated(docs(rows), spark.createDataFrame(items, "item_id string, text string")).collect()}
        assert got <= want and len(got) >= 0.93 * len(want)


@pytest.mark.parametrize("local", (0, 4_000_000))
def test_components(spark, monkeypatch, local):
    from quarterdeck.llm import near_duplicates as N

    monkeypatch.setattr(N, "LOCAL_LINKS", local)
    components = N.components
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (101, 103), (200, 201), (200, 201)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[103] == got[101] == 100 and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def by_likely_pairs(N, d):
    """The classes by brute force: all pairs that share a band, by estimate and then by exact similarity."""
    sampler = N.Sampler(N.inverse_frequencies(d))
    rows = [r for r in N.signed(d, type("Held", (), {"value": sampler})()).collect() if r.nd_bands]
    text = {r.doc_id: r.text for r in d.collect()}
    sets = [dict(zip(*(x.tolist() for x in N._SHINGLER(text[r.doc_id])))) for r in rows]
    weight = [dict(zip(s, sampler.weights(np.array(list(s), np.uint64), np.array(list(s.values()))).tolist())) for s in sets]
    sig = np.stack([np.frombuffer(r.nd_sig, "<u2") for r in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and any(a == b for a, b in zip(rows[i].nd_bands, rows[j].nd_bands)) and (sig[i] == sig[j]).mean() >= N.LIKELY:
                x, y = weight[i], weight[j]
                both = sum(min(w, y[s]) for s, w in x.items() if s in y)
                if both / (sum(x.values()) + sum(y.values()) - both) >= N.SIMILARITY:
                    root[find(i)] = find(j)
    found = collections.defaultdict(set)
    for i, r in enumerate(rows):
        found[find(i)].add(r.doc_id)
    return {frozenset(s) for s in found.values()}


def by_operator(N, d):
    found = collections.defaultdict(set)
    for r in N.near_duplicate_classes(d).collect():
        found[r.class_id].add(r.doc_id)
    return {frozenset(s) for s in found.values()}


def drifting(seed, chains, links, share, shared=60, own=60):
    """Chains of texts from one start, each with one more word changed than the one before it."""
    r, rows = random.Random(seed), []
    base = prose(seed, shared + own).split()
    for c in range(chains):
        w = list(base)
        for k in range(links):
            for at in r.sample(range(own), share):
                w[at] = f"c{c}x{k}y{at}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_large_buckets_are_searched_whole(spark, docs, monkeypatch):
    from quarterdeck.llm import near_duplicates as N

    monkeypatch.setattr(N, "GROUP", 4)
    d = docs(drifting(1, 8, 5, 2))  # chains that leave the leader
    assert by_operator(N, d) == by_likely_pairs(N, d)
    d = docs(drifting(2, 20, 2, 5, 100))  # texts unlike each other
    assert by_operator(N, d) == by_likely_pairs(N, d)


def test_small_buckets_settle_all_likely_pairs(spark, docs):
    from quarterdeck.llm import near_duplicates as N

    rows, w = [], prose(7, 150).split()
    r = random.Random(7)
    for i in range(10):  # pairs of about the threshold
        x = list(w)
        for at in r.sample(range(150), 2):
            x[at] = f"e{i}x{at}"
        rows.append((i, " ".join(x)))
    assert by_operator(N, docs(rows)) == by_likely_pairs(N, docs(rows))


def test_texts_with_more_pieces_than_the_cache(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from quarterdeck.llm import token_store as S

    path = public.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    for limit in (64, 1_500, 16_000, 64 << 20):
        monkeypatch.setattr(S, "CACHE_BYTES", limit)
        encoder = S.CachedEncoder(path)
        for text in ("one two three", "one two " + " ".join(WORDS), "one two", "A" * 3000 + " b!? " + "!" * 3000, " ".join(WORDS) + " one,"):
            assert encoder.encode(text.encode(), 1).tolist() == t.encode(text, add_special_tokens=False).ids + [1]
            assert encoder.pieces.size <= limit and len(encoder.pieces.old) * S.ENTRY_BYTES <= limit


def test_pipeline_stage_by_stage(spark, docs, tmp_path):
    """Every stage's rows against what its operator says of its input, on texts with copies, a leak, nulls and edge rows."""
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from quarterdeck.llm import common, mixing, quality
    from quarterdeck.llm.near_duplicates import near_duplicate_classes
    from quarterdeck.llm.queries import vocabulary_path

    rows, labels = labelled(120)
    item = prose(777, 30)
    rows += [(1000, prose(50, 80) + " " + item), (1001, rows[1][1]), (1002, rows[1][1] + " end"), *EDGE]
    d = docs(rows)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "minhash", "decontamination", "mixing", "tokens"]
    bag = lambda frame: collections.Counter((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())
    out, before = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = common.written(stage(spark, before, str(tmp_path)), f"test-{name}")
        out[name] = after
        if name != "tokens":
            assert after.columns == d.columns
            before = after
    model = quality.train(d, common.labels(spark, str(tmp_path)))
    verdict = {(r.doc_id, r.text): r["\x01p"] for r in quality.classify(d, model, keep=("doc_id", "text"), names=("\x01s", "\x01p")).collect()}
    assert bag(out["quality"]) == collections.Counter({k: n for k, n in bag(d).items() if verdict[k]})
    classes = near_duplicate_classes(out["quality"]).collect()
    assert sum(bag(out["minhash"]).values()) == sum(r.kept for r in classes) and not bag(out["minhash"]) - bag(out["quality"])
    assert bag(out["decontamination"]) == collections.Counter({k: n for k, n in bag(out["minhash"]).items() if item not in (k[1] or "")})
    taken = sum(r.taken for r in mixing.mix_counts(out["decontamination"]).collect())
    assert sum(len((t or "").split()) * n for (_, t), n in bag(out["mixing"]).items()) == taken
    t = tokenizers.Tokenizer.from_file(vocabulary_path())
    want = collections.Counter((k, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for (k, x), n in bag(out["mixing"]).items() for _ in range(n))
    assert collections.Counter((r.doc_id, r.n_tokens) for r in out["tokens"].collect()) == want
    assert 1000 not in {k for k, _ in bag(out["decontamination"])} and 10 in {k for k, _ in bag(out["decontamination"])}
    empty = d.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


def test_toxicity_fit_by_brute_force(spark, docs):
    """Logits by plain sums over words and prefixes, and the loss at its minimum: its gradient by differences is flat."""
    from quarterdeck.llm import toxicity as X

    rng = np.random.default_rng(8)
    rows = [sorted(set(rng.integers(0, 6, rng.integers(1, 4)).tolist())) for _ in range(80)]
    y = np.array([float(0 in r or rng.random() < 0.2) for r in rows])
    swaps = [([4], [5]), ([5], [4]), ([1], [2])]
    w, b = X.fit(rows, y, 6, swaps, ridge=0.5, penalty=2.0, steps=4000, rate=0.01)

    def loss(w, b):
        z = np.array([b + sum(w[c] for c in r) for r in rows])
        change = [sum(w[c] for c in lost) - sum(w[c] for c in gained) for lost, gained in swaps]
        return np.mean(np.log1p(np.exp(z)) - y * z) + 0.25 * float(w @ w) / len(y) + 2.0 * np.mean(np.square(change))

    for k in range(7):
        step = np.eye(7)[k] * 1e-4
        slope = (loss(w + step[:6], b + step[6]) - loss(w - step[:6], b - step[6])) / 2e-4
        assert abs(slope) < 5e-3
    model = X.ToxicityModel({b"scum": 2.0, b"wort*": 0.5, b"worth*": 0.25}, -1.0)
    assert [round(model.logit(t), 6) for t in (b"", b"SCUM! scum", b"worthless scum", b"worth")] == [-1.0, 1.0, 1.75, -0.5]


def test_additive_model_by_brute_force(spark, docs):
    """A document's logit is the intercept and its bins' entries, each looked up one by one."""
    from quarterdeck.llm import quality as Q

    rows, labels = labelled(160)
    d = docs(rows)
    model = Q.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = {}
    for key, text in rows:
        f = Q.features(text.encode())
        bins = [int(np.searchsorted(model.edges[j], np.float32(f[j]), side="right")) for j in range(len(f))]
        total = model.intercept + sum(model.tables[j][bins[j]] for j in range(len(f)))
        total += sum(model.pair_tables[p][bins[i] * Q.PAIR_BINS // Q.BINS][bins[j] * Q.PAIR_BINS // Q.BINS] for p, (i, j) in enumerate(model.pairs))
        want[key] = 1 / (1 + math.exp(-total))
    got = {r.doc_id: r.score for r in Q.classify(d, model).collect()}
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)
