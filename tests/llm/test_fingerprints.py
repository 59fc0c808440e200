"""Phrases, fingerprints and their likeness against plain loops."""

import numpy as np
import pytest

from loamgraph.llm.fingerprints import edited_fingerprints, fingerprint, likeness, parse
from loamgraph.runtime import ship, table


def plain_phrases(text):
    seen, at = [], 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in seen:
            n += 1
        if at + n > len(text):
            break  # an open phrase, known already
        seen.append(text[at : at + n])
        at += n
    return seen


@pytest.mark.parametrize("text", ["", "a", "aaaaaaa", "abababababa", "the cat the cat sat", "😀é😀é😀é", "abc" * 50])
def test_phrases(text):
    phrases = {}
    parse(text, phrases)
    assert list(phrases) == plain_phrases(text)


def test_likeness_is_the_jaccard_index_of_small_phrase_sets():
    a, b = "the quick brown fox jumps over the lazy dog", "the quick brown fox sleeps under the lazy dog"
    x, y = set(plain_phrases(a)), set(plain_phrases(b))
    assert likeness(fingerprint(a), fingerprint(b)) == pytest.approx(len(x & y) / len(x | y))
    assert likeness(fingerprint(a), fingerprint(a)) == 1 and likeness(fingerprint(""), fingerprint(a)) == 0 and likeness(fingerprint(""), fingerprint(None)) == 1


def test_rows_against_plain_fingerprints(spark, sf):
    ship(spark)
    docs = table(spark, sf, "documents").where("length(text) < 3000")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in edited_fingerprints(docs).collect()}
    as_hex = lambda h: "".join(f"{int(v):08x}" for v in h)
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        own, edited, other = fingerprint(t), fingerprint(t[: len(t) - half] + nxt[:half]), fingerprint(nxt)
        r = got[i]
        assert r["fingerprint"] == as_hex(own) and r["edited_fingerprint"] == as_hex(edited)
        assert r["near_edited"] == pytest.approx(likeness(own, edited)) and r["near_next"] == pytest.approx(likeness(own, other))
        assert (np.diff(own.astype(np.int64)) > 0).all()
