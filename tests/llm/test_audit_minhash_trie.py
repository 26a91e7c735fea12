"""Operators 11 to 13 against brute force, on odd rows: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightline.llm import conversation_trie, hyper_minhash, rounds, source_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
DOCS = "doc_id long, text string, lang string, source string, n long, docs long, term string, block string, item string, key string, registers string, label string"


def odd_docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "t", "b", "i", "k", "r", "l") for r in rows], DOCS)


# --- source audit


def said_by_brute_force(rows, min_docs):
    n, df = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = TERM.findall((text or "").encode().translate(LOWER))
        n[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    f, out = lambda p, q: (p - q) ** 2 // (p + q), []
    for lang in {k[0] for k in n}:
        keep = [w for w, k in df[lang].items() if k >= min_docs]
        sources = [s for of, s in n if of == lang]

        def shares(c, keep=keep):
            total = sum(c[w] for w in keep) + 2 * len(keep)
            return {w: 1 + 10**9 * (c[w] + 2) // total for w in keep}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in keep), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][w], q[w]), w) for w in keep if n[lang, s][w] and p[s][w] > q[w])[:10]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def audit_rows():
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdeéßZ", k=r.randint(1, 7))) for _ in range(60)]
    rows = []
    for i in range(150):
        lang, source = r.choice(["en", "en", "de", None]), r.choice(["a", "a", "é", "z", "", None])
        rows.append((i, " \x00,7".join(r.choices(vocabulary[: 20 + i % 40], k=r.choice((0, 1, 5, 40)))), lang, source))
    rows += [(200, None, "xx", "a"), (201, "", "xx", "b"), (202, "12 !", "xx", "c"), (203, None, None, None), (None, "Word word WORD", "yy", "alone"), rows[3], rows[3]]
    return [*rows, (204, "ab " * 5000, "en", "a")]


@pytest.mark.parametrize(("block", "chunk"), [(1 << 17, 1 << 22), (7, 50)])
def test_audit_equals_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(source_audit, "BLOCK_ROWS", block)
    monkeypatch.setattr(source_audit, "CHUNK_BYTES", chunk)
    rows = audit_rows()
    got = source_audit.audit(odd_docs(spark, rows)).collect()
    assert sorted(map(tuple, got)) == said_by_brute_force(rows, source_audit.MIN_DOCS)
    assert {r.lang for r in got if r.value == 0 and r["part"] == "pair"} >= {"xx"} and not [r for r in got if r.lang == "yy"]


def test_audit_of_no_rows(spark):
    assert source_audit.audit(odd_docs(spark, [])).collect() == []


def test_slices_of_one_digest_are_taken_apart_by_bytes():
    texts = [b"aa bb aa", b"", b"cc", b"dbb"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    starts, ends = source_audit.boundaries(data, offsets)
    words = [bytes(data[s:e]) for s, e in zip(starts, ends, strict=True)]
    assert words == [b"aa", b"bb", b"aa", b"cc", b"dbb"]
    for digest in (lambda b: 1, len, lambda b: b[0]):
        group, first = source_audit.grouped(data, starts, ends, digest)
        assert [words[first[g]] for g in group] == words and len(set(group.tolist())) == 4


def test_shares_are_exact():
    count, total = np.array([2, 10**12 + 2, 3], np.int64), np.array([2, 3 * 10**12 + 7, 10**15], np.int64)
    assert source_audit.share(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total, strict=True)]


# --- HyperMinHash


def components_by_brute_force(rows):
    low, sets = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), []
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate(low))
        sets.append((doc_id, {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            if None not in (a, b) and x and 100 * len(x & y) >= 80 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(sets):
        if a is not None:
            least[find(i)] = min(a, least.get(find(i), a))
    return sorted(((a, len(x), least[find(i)] if a is not None else None, a is not None and least[find(i)] == a) for i, (a, x) in enumerate(sets)), key=repr)


def near_rows():
    r = random.Random(9)
    words = ["".join(r.choices("abcdeé", k=4)) for _ in range(400)]
    rows, base = [], r.choices(words, k=80)
    for i in range(40):  # near copies, a chain of drifting ones, copies
        text = list(base)
        for _ in range(i % 4):
            text[r.randrange(80)] = "new"
        rows.append((i, " ".join(text).upper() if i % 5 == 0 else " ".join(text)))
    drift = r.choices(words, k=60)
    for i in range(40, 70):
        drift = [*drift[2:], *r.choices(words, k=2)]
        rows.append((i, "\n".join(drift)))
    shared = r.choices(words, k=40)
    rows += [(i, " ".join([*shared, *r.choices(words, k=r.choice((5, 12, 40)))])) for i in range(70, 100)]
    return [*rows, (100, None), (101, ""), (102, " \t"), (103, "one"), (104, "One"), (105, "a b c"), (106, "a b c d e"), (107, "la " * 4000), rows[3], rows[3], (None, rows[0][1]), (None, None)]


@pytest.mark.parametrize("growth", [4, 64])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, growth):
    monkeypatch.setattr(rounds, "GROWTH", growth)
    rows = near_rows()
    got = hyper_minhash.near_duplicates(odd_docs(spark, [(*r, "en", "s") for r in rows])).collect()
    assert sorted(map(tuple, got), key=repr) == components_by_brute_force(rows)


def test_near_duplicates_of_no_rows(spark):
    assert hyper_minhash.near_duplicates(odd_docs(spark, [])).collect() == []


def test_estimates_are_near_and_chance_is_taken_off():
    r = np.random.RandomState(3)
    for n, m, both in ((1000, 1000, 900), (40, 36, 36), (800, 800, 0), (5, 4, 4)):
        a, b, sizes = [], [], (np.full(60, n), np.full(60, m))
        for _ in range(60):
            x = r.randint(0, 2**63, n + m - both).astype(np.uint64)
            a.append(hyper_minhash.registers(x[:n])), b.append(hyper_minhash.registers(x[n - both :]))
        said = hyper_minhash.estimated(np.array(a), np.array(b), *sizes)
        assert abs(said.mean() - both / (n + m - both)) < 0.02
    # With a short mantissa chance would show: unrelated sets of a million elements have as many equal registers as chance() says.
    assert hyper_minhash.chance(np.array([10**6]), np.array([10**6]))[0] == pytest.approx(0.000176, rel=0.02)


def test_sketches_rule_out_no_pair_that_links(spark):
    r = np.random.RandomState(5)
    rows, links = [], []
    for _ in range(80):
        n, both = r.randint(5, 400), r.rand()
        x = r.randint(0, 2**63, 2 * n).astype(np.uint64) * np.uint64(2)
        shared = int(n * both)
        a, b = np.unique(x[:n]), np.unique(np.concatenate([x[:shared], x[n : 2 * n - shared]]))
        rows.append((len(a), hyper_minhash.sketch(a).tolist(), len(b), hyper_minhash.sketch(b).tolist()))
        links.append(100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)))
    df = spark.createDataFrame(rows, "n int, p array<long>, m int, q array<long>")
    side = lambda n, c, to: F.struct(F.col(n).alias("n"), *(F.get(c, F.lit(k)).alias(s) for k, s in enumerate(hyper_minhash.SKETCH))).alias(to)
    said = [x.v for x in df.select(side("n", "p", "l"), side("m", "q", "r")).select(hyper_minhash._alike("l", "r").alias("v")).collect()]
    assert all(v for v, link in zip(said, links, strict=True) if link) and any(links) and said.count(False) > 40


def test_leading_zeros():
    x = np.array([0, 1, 2, 3, 1 << 63, (1 << 64) - 1, 1 << 32, (1 << 32) - 1], np.uint64)
    assert hyper_minhash.leading_zeros(x).tolist() == [64 - int(v).bit_length() for v in x]


# --- conversation trie


def trie_by_brute_force(rows, lent):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    path = {}
    for c in own:
        h, family = lent(c), c - (c % 5 if c >= 0 else -(-c % 5))
        path[c] = tuple(own.get(family, [])[:h] + own[c][h:])
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, p in path.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(m) if path[c] == p).encode()).hexdigest() for p, m in members.items()}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends[p]) for p, m in members.items()), key=repr)


def talk_rows():
    r, rows = random.Random(2), []
    openings = [[("user", f"hello {i}"), ("assistant", "é" * i), ("user", "")] for i in range(3)]
    for c in range(-8, 120):
        talk = [*r.choice(openings)[: r.randint(0, 3)], *(("user", r.choice("xyz")) for _ in range(r.randint(0, 12)))]
        rows += [(c, t, role, text) for t, (role, text) in enumerate(talk)]
    rows += [(c, t, "user", "same") for c in range(200, 400) for t in range(3)]  # a conversation with very many copies
    rows += [(500, t, "user", f"{t}") for t in range(300)] + [(501, t, "user", f"{t}") for t in range(299)]  # long ones
    rows += [(600, None, "user", "null first"), (600, 1, None, None), (600, 1, "a", "tie"), (600, 1, "a", "tie"), (600, 1, "a", "another tie"), (None, 1, "user", "nobody's"), (613, 1, "user", "one")]
    r.shuffle(rows)
    return rows


def talks(spark, rows):
    return spark.createDataFrame([(*x, "f", 1, 2, "k", 3) for x in rows], "conv_id long, turn long, role string, text string, family string, n int, low int, key string, place int")


@pytest.mark.parametrize(("run", "ranges", "lent"), [(4 << 20, 1000, "lent_turns"), (300, 5, "lent_turns"), (300, 5, "no_turns")])
def test_trie_equals_brute_force(spark, monkeypatch, run, ranges, lent):
    monkeypatch.setattr(conversation_trie, "RUN_BYTES", run)
    monkeypatch.setattr(conversation_trie, "RANGE_ROWS", ranges)
    rows, lent = talk_rows(), getattr(conversation_trie, lent)
    got = conversation_trie.trie(conversation_trie.paths(talks(spark, rows), lent)).collect()
    assert sorted(map(tuple, got), key=repr) == trie_by_brute_force(rows, lent)


def test_trie_of_no_rows_and_of_one(spark):
    build = lambda rows: conversation_trie.trie(conversation_trie.paths(talks(spark, rows), conversation_trie.lent_turns)).collect()
    assert build([]) == [] and build([(None, 1, "a", "b")]) == []
    lonely = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)  # its only turn is replaced by one that isn't there
    assert [tuple(r)[:7] for r in build([(lonely, 1, "a", "b")])] == [(lonely, 0, None, 1, 0, 1, 0)]


def test_merge_gives_order_and_shared_turns():
    r = random.Random(4)
    item = lambda k: bytes([k]) * conversation_trie.ITEM
    paths = sorted({b"".join(item(r.randrange(3)) for _ in range(r.randrange(9))) for _ in range(200)})
    for k in (1, 2, 3, 7, 16):
        dealt = [[] for _ in range(k)]
        for p in paths:
            dealt[r.randrange(k)].append(p)
        runs = [(d, [0, *(conversation_trie.shared_turns(a, b) for a, b in zip(d, d[1:], strict=False))][: len(d)]) for d in dealt if d]
        out = [(runs[i][0][at], lcp) for i, at, lcp in conversation_trie.merged(runs)]
        assert [p for p, _ in out] == paths
        assert [n for _, n in out] == [0, *(conversation_trie.shared_turns(a, b) for a, b in zip(paths, paths[1:], strict=False))]
