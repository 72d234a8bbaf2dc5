"""Brute-force tests of SimHash, periodic runs and collocations."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from quarterdeck.llm import collocations as col
from quarterdeck.llm import periodic_runs as runs
from quarterdeck.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---- op11


def brute_fingerprint(text):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return 0
    width = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    label = {f: f for f in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if bin(a ^ b).count("1") <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprints_and_components(spark, docs):
    r = random.Random(3)
    base = [[r.choice("alpha beta gamma delta Straße ÉTÉ x1 y2 z3".split()) for _ in range(r.randint(1, 60))] for _ in range(12)]
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (5, "One"), (6, "a b"), (7, "w " * 70_000), (None, "alpha beta gamma"), (9, "alpha beta gamma"), (9, "alpha beta gamma")]
    for k, words in enumerate(base):
        for j in range(6):
            edited = list(words)
            for _ in range(j // 2):
                edited[r.randrange(len(edited))] = r.choice("alpha beta new".split())
            rows.append((100 + 10 * k + j, " ".join(edited)))
    got = simhash.near_components(docs(rows)).collect()
    values = {(r[0], r[1]): brute_fingerprint(r[1]) for r in rows}
    label = brute_components(sorted(set(values.values())))
    least = {}
    for (d, _), f in values.items():
        least[label[f]] = min([x for x in (least.get(label[f]), d) if x is not None], default=None)
    want = Counter((d, f"{values[d, t]:016x}", least[label[values[d, t]]]) for d, t in rows)
    assert Counter((g.doc_id, g.fingerprint, g.component_id) for g in got) == want
    distinct = set(values.values())
    assert all(g.n_links == sum(0 < bin(int(g.fingerprint, 16) ^ f).count("1") <= 2 for f in distinct) for g in got)
    assert simhash.near_components(docs(rows).limit(0)).count() == 0


def test_links_of_dense_fingerprints(spark):
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for f in list(values)[:8]:  # dense neighbourhoods, a chain included
        for _ in range(40):
            f ^= 1 << r.randrange(64)
            values.add(f)
    signed = sorted(int(np.uint64(v).astype(np.int64)) for v in values)
    found = simhash.near_fingerprints(spark.createDataFrame([(v,) for v in signed], "f long")).collect()
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2}
    assert len(found) == len(want) and {(f.a, f.b) for f in found} == want
    one = simhash.near_fingerprints(spark.createDataFrame([(v,) for v in signed], "f long"), distance=1).collect()
    assert {(f.a, f.b) for f in one} == {p for p in want if bin((p[0] ^ p[1]) & ((1 << 64) - 1)).count("1") == 1}
    with pytest.raises(ValueError):
        simhash.near_fingerprints(spark.createDataFrame([(1,)], "f long"), distance=3)


# ---- op12


def brute_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_digest(words):
    found = brute_runs(words)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (len(found), *shown, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def periodic_words(r):
    kind = r.random()
    if kind < 0.4:
        out = []
        for _ in range(r.randint(1, 6)):
            unit = [r.choice("abcde"[: r.randint(1, 5)]) for _ in range(r.randint(1, 30))]
            out += (unit * 9)[: r.randint(1, 8 * len(unit))]
        return out
    if kind < 0.7:
        q = r.randint(2, 60)
        return ((["a"] * (q - 1) + ["b"]) * r.randint(3, 9))[r.randint(0, q - 1) :]
    return [r.choice("ab") for _ in range(r.randint(0, 150))]


@pytest.mark.parametrize("tile", [runs.TILE, 40])
def test_runs_of_tiles(spark, docs, tile):
    r = random.Random(11)
    texts = [None, "", " \t", "x", "é é é é é é", "a " * 6, "a b " * 4, "a  b\nA\tb a b"] + [" ".join(periodic_words(r)) for _ in range(120)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(8, texts[8]), (None, texts[9])]
    got = runs.run_digests(docs(rows), tile=tile).collect()
    want = Counter((d, *brute_digest(WORD.findall(t or ""))) for d, t in rows)
    assert Counter((g.doc_id, g.n_runs, g.start, g.length, g.period, g.exponent_milli, g.runs_sha256, g.collapsed_sha256) for g in got) == want
    assert runs.run_digests(docs(rows).limit(0), tile=tile).count() == 0


def test_runs_of_a_very_long_text(spark, docs):
    r = random.Random(2)
    unit = [str(r.randrange(500)) for _ in range(30_000)]
    words = [str(r.randrange(10**6)) for _ in range(5000)] + unit * 5 + ["z"] * 40_000
    found = runs.periodic_runs(docs([(1, " ".join(words))]))[1].collect()
    got = {(f.start, f.length, f.period) for f in found}
    assert (5000, 150_000, 30_000) in got and (155_000, 40_000, 1) in got


def test_op12_shapes_documents_as_the_contract_says(spark, tmp_path):
    from quarterdeck.llm.queries import op12_periodic_runs

    r = random.Random(4)
    rows = [(k, " ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 90)))) for k in range(150)]
    spark.createDataFrame([(*row, "en", "s", 1) for row in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {g.doc_id: tuple(g)[1:8] for g in op12_periodic_runs(spark, str(tmp_path)).collect()}
    for doc_id, text in rows:
        words, h = WORD.findall(text), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert got[doc_id] == brute_digest(words), doc_id


# ---- op13


def brute_collocations(rows, least=10, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    kept = []
    for (lang, w), a in cand.items():
        longer = [b for (x, v), b in cand.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        kept.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out, rank = set(), Counter()
    for lang, score, a, phrase, left, right in sorted(kept):
        rank[lang] += 1
        if rank[lang] <= top:
            out.add((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.mark.parametrize("options", [{}, {"groups": 3, "budget": 400}, {"groups": 1, "budget": 100}])
def test_collocations(spark, docs, options):
    r = random.Random(8)
    vocabulary = ["the"] * 12 + "The of and new york city Éa ünder x y z a-b \x01odd 😀".split()
    rows = [(1, None, "en"), (2, "", None), (3, " .,\t!", "de"), (4, "the " * 3000, "en"), (5, "a b c\x0bd e", None), (5, "a b c\x0bd e", None)]
    for k in range(240):
        words = [r.choice(vocabulary) + r.choice(["", "", "", "", ".", ",", "\n", "\t", ";"]) for _ in range(r.randint(0, 60))]
        rows.append((k + 10, " ".join(words) + " new york city" * r.randint(0, 2), r.choice(["en", "en", "de", None])))
    got = col.collocations(docs(rows), **options).collect()
    assert [*got[0].asDict()] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(g) for g in got} == brute_collocations(rows) and len(got) == len({tuple(g) for g in got})
    assert {tuple(g) for g in col.collocations(docs(rows), top=3, **options).collect()} == brute_collocations(rows, top=3)
    assert col.collocations(docs(rows).limit(0), **options).count() == 0


def test_collocation_score_beyond_64_bits(spark, monkeypatch):
    words = spark.createDataFrame([("en", "a", 4 * 10**13), ("en", "b", 5 * 10**13)], "lang string, phrase string, n long")
    phrases = spark.createDataFrame([("en", "a b", 3 * 10**13)], "lang string, phrase string, n long")
    monkeypatch.setattr(col, "phrase_counts", lambda *a, **k: (words, phrases))
    row = col.collocations(words).head()
    assert (row.score, row.a, row.n) == (10**6 * 9 * 10**26 // (20 * 10**26), 3 * 10**13, 9 * 10**13)


def test_connected_chain(spark):
    from quarterdeck.llm.graph import connected

    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op13_oracle(spark):
    import os

    duckdb = pytest.importorskip("duckdb")
    from quarterdeck.llm.queries import ORACLES, op13_collocations

    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    duck = duckdb.connect()
    duck.sql(f"create view documents as from '{data}/documents.parquet'")
    assert {tuple(r) for r in op13_collocations(spark, data).collect()} == set(duck.sql(ORACLES["op13_collocations"]).fetchall())


def test_context_tree_holds_only_what_training_saw():
    """Its tables grow with the cells, not with 256 bytes a state; unseen bytes and contexts still score as the whole table says."""
    import pickle

    import numpy as np

    from quarterdeck.llm.lm_scoring import END, build_tree, grams, stream

    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(2, 9, 60)]
    text = b" ".join(words[k] for k in rng.integers(0, 60, 4000))
    x, starts = stream(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 3)
    g, n = grams(x, starts, np.array([len(text)]), 3)
    level = np.arange(4).repeat(len(g))
    code, n = np.tile(g.astype(np.int64), 4), np.tile(n, 4)
    keys = (level << 48) | ((code >> 8) & ((1 << 8 * level) - 1))
    known = np.unique(keys)
    tree = build_tree(known, keys, code & 255, n, 3)
    assert len(pickle.dumps(tree, 5)) < 600 * len(known)  # 2,048 bytes a state when each had a row of all bytes
    table, state = tree.log10.reshape(len(known), 256), 0
    assert np.allclose((10.0**table).sum(axis=1), 1, atol=1e-4)
    other = stream(np.frombuffer("Zażółć, 0 ".encode() + text[:300] + b"\x00~" * 4, np.uint8), np.array([0, 20, 20, 300]), 3)[0]
    got = tree.lines(other[3:])
    past = [END] * 3
    for value, byte in zip(got.tolist(), other[3:].tolist()):
        context = [(d << 48) | int.from_bytes(bytes(past[3 - d :])) for d in range(4)]
        state = max(int(i) for k in context if (i := np.searchsorted(known, k)) < len(known) and known[i] == k)
        assert abs(value - table[state, byte]) < 1e-5
        past = [*past[1:], byte]


def _whole(texts, depth):
    """build_tree with every context that the texts have."""
    import numpy as np

    from quarterdeck.llm.lm_scoring import build_tree, grams, stream

    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    x, starts = stream(data, offsets, depth)
    g, n = grams(x, starts, np.diff(offsets), depth)
    level = np.arange(depth + 1).repeat(len(g))
    code, n = np.tile(g.astype(np.int64), depth + 1), np.tile(n, depth + 1)
    keys = (level << 48) | ((code >> 8) & ((1 << 8 * level) - 1))
    return build_tree(np.unique(keys), keys, code & 255, n, depth)


def test_context_forest_is_the_whole_tree(monkeypatch):
    """Roots mixed apart, from several lots, give what one tree of every context gives."""
    import numpy as np
    import pyarrow as pa

    from quarterdeck.llm import context_forest as C

    monkeypatch.setattr(C, "ROW_CODES", 7)
    monkeypatch.setattr(C, "ROOT_CODES", 100)
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(2, 9, 60)]
    train = [b" ".join(words[k] for k in rng.integers(0, 60, 100)) for _ in range(4)] + [b"", b"aaaa" * 1500]
    held = ["Zażółć, 0 ".encode() + train[0][:100] + b"\x00~" * 4, b"", b"zzz q"]
    for depth in (6, 3, 2, 1, 0):
        sent, lots = [], [(train[:3] + held[:1], [True] * 3 + [False]), (train[3:], [True] * 3), (held[1:], [False] * 2)]
        for lot, (texts, learnt) in enumerate(lots):
            offsets = np.cumsum([0, *map(len, texts)])
            code = C.codes(np.frombuffer(b"".join(texts), np.uint8), offsets, depth)
            lots[lot] = texts, code, np.cumsum(np.diff(offsets) + 1)
            known, n = C.distinct(code, np.repeat(learnt, np.diff(offsets) + 1))
            sent += [(root, lot, part, C.packed_codes(known[a:b], n[a:b])) for part, (root, a, b) in enumerate(C.rows_of(known, depth))]
        sent.sort(key=lambda x: x[0])
        batches = lambda: [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*sent[k : k + 9])], names=["root", "lot", "part", "codes"]) for k in range(0, len(sent), 9)]
        top = None
        if depth:
            up = [C.Levels(code, n, depth).above() for _, code, n, _ in C.roots(batches(), depth)]
            assert depth < 2 or len(up) > 1
            key, (a, b, weighted) = np.concatenate([x[0] for x in up]), np.concatenate([x[1] for x in up], axis=1)
            top = C.top_levels(key, a, b, weighted, depth)
        back = {}
        for rows, code, n, place in C.roots(batches(), depth):
            value, at = C.Levels(code, n, depth).log10(top).astype(np.float32)[place], 0
            for _, lot, part, size in rows:
                back[lot, part] = value[at : at + size]
                at += size
        tree = _whole(train, depth)
        for lot, (texts, code, ends) in enumerate(lots):
            values = np.concatenate([v for (k, _), v in sorted(back.items()) if k == lot])
            want = tree.texts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
            assert np.allclose(C.sums(code, values, ends), want, rtol=2e-5, atol=1e-3)


def test_scores_use_every_context_of_training(spark):
    """Contexts of one or two positions in 2**16 had no nodes of their own."""
    import zlib

    import numpy as np

    from quarterdeck.llm.lm_scoring import score

    rng = np.random.default_rng(7)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(3, 9, 6000)]
    texts = {k: b" ".join(words[i] for i in rng.integers(0, 6000, 300)) for k in range(120)}  # a word stands some five times
    held = {k for k in texts if zlib.crc32(str(k).encode()) % 7 == 2}
    rows = spark.createDataFrame([(k, t.decode()) for k, t in texts.items()], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["score"] for r in score(rows).collect()}
    tree = _whole([t for k, t in texts.items() if k not in held], 6)
    want = {k: float(tree.texts(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]) for k, t in texts.items()}
    assert all(abs(got[k] - want[k]) < 1e-3 * abs(want[k]) for k in texts)
