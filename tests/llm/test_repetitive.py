"""Texts of short periods: rulers, padding, one word over and over."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from brightline.llm import substring, suffixes

N = suffixes.RUN_BYTES


def texts():
    r = random.Random(4)
    prose = lambda n: "".join(r.choices("abcdefgh ", k=n))
    shared = prose(260)
    return ["=" * 900, "ab" * 400 + prose(50), prose(300) + "-" * 250 + prose(120) + "-" * 250, "=" * 199, "=" * 200, "=" * 201, prose(40) + shared + "=" * 500, shared, ("x" * 210 + "y") * 4, "la " * 300, ("word " * 25 + "\n") * 6, prose(700)]


def by_brute_force(rows):
    data = {i: t.encode() for i, t in rows}
    seen = Counter(d[k : k + N] for d in data.values() for k in range(len(d) - N + 1))
    out = {}
    for i, d in data.items():
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - N + 1):
            if seen[d[k : k + N]] > 1:
                gone[k : k + N] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out[i] = (len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_bytes_of_repetitive_texts_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = suffixes.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == by_brute_force(rows)


@pytest.mark.parametrize("piece", [64, 300, 1 << 20])
def test_pieces_and_stretches_tell_every_string(monkeypatch, piece):
    for text in (t.encode() for t in texts()):
        whole = suffixes.gram_hashes_of(np.frombuffer(text, np.uint8), suffixes.GRAM_BYTES)
        of = suffixes.anchor_of_runs(whole, N, suffixes.GRAM_BYTES)
        anchors = whole[np.unique(of)]
        monkeypatch.setattr(suffixes, "PIECE_BYTES", piece)
        _, _, at, hashes = suffixes.look(text)
        assert set(hashes.tolist()) == set(anchors.tolist()) and (whole[at] == hashes).all()
        assert all(c == min(2, d) for c, d in zip(*[[Counter(x.tolist())[h] for h in set(anchors.tolist())] for x in (hashes, anchors)], strict=True))
        recurs, told = anchors[::2], Counter()
        for a, part in suffixes.pieces(text):
            for anchor, start, end, n, reach in zip(*(x.tolist() for x in suffixes.stretches(part, recurs)), strict=True):
                step = reach // (n - 1) if n > 1 else 0
                assert step <= N and (n == 1 or reach == step * (n - 1))
                for k in range(n):
                    assert text[a + start + k * step : a + end + k * step] == text[a + start : a + end]
                    told.update(range(a + start + k * step, a + end + k * step - N + 1))
        wanted = set(recurs.tolist())
        assert told == Counter(i for i, p in enumerate(of.tolist()) if whole[p] in wanted)


def test_words_of_repetitive_texts_equal_brute_force(spark):
    rows = list(enumerate([*texts(), "la " * 5000, "a b " * 900]))
    seen, want = set(), {}
    for i, t in rows:
        words, gone = t.split(), np.zeros(len(t.split()) + 1, bool)
        for k in range(len(words) - 19):
            run = tuple(words[k : k + 20])
            if run in seen:
                gone[k : k + 20] = True
            seen.add(run)
        want[i] = (len(words), int(gone.sum()), hashlib.sha256(" ".join(w for w, g in zip(words, gone, strict=False) if not g).encode()).hexdigest())
    got = substring.dedup_phrases(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
