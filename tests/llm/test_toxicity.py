"""The string kernel, its landmarks and the words that it tolerates."""

import numpy as np
import pyarrow as pa
import pytest

from loamgraph.llm.batches import text_slices
from loamgraph.llm.toxicity import DECAY, ORDER, choose_landmarks, fit, inverse_root, landmark_kernel, subsequence_kernel


def plain_kernel(a: bytes, b: bytes) -> float:
    """All common subsequences of ORDER bytes, by recursion over their places."""
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(a)), ORDER):
        for j in combinations(range(len(b)), ORDER):
            if all(a[x] == b[y] for x, y in zip(i, j)):
                total += DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


@pytest.mark.parametrize("word, mark", [(b"idiot", b"idiot"), (b"idxiot", b"idiot"), (b"banana", b"anan"), (b"abcd", b"wxyz"), (b"abc", b"abcd")])
def test_kernel_against_all_subsequences(word, mark):
    got = subsequence_kernel(np.frombuffer(word, np.uint8)[None], mark)[0]
    assert got == pytest.approx(plain_kernel(word, mark), rel=1e-5)


def test_landmark_kernel_is_a_kernel():
    k = landmark_kernel([b"idiot", b"idiots", b"stupid", b"trash", b"tras"])
    assert np.allclose(k, k.T) and np.allclose(np.diag(k), 1)
    assert np.linalg.eigvalsh(k).min() > -1e-6
    assert np.isfinite(inverse_root(k)).all()


def scores(model, texts):
    return np.concatenate([model.documents(offs, data) for _, _, offs, data in text_slices(pa.array(texts, pa.large_string()))])


def test_gaps_inserted_and_spaced_letters_are_caught_and_clean_words_left_alone():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeionrstl"), 5)) for _ in range(400)]
    prose = lambda: [str(w) for w in rng.choice(words, 30)]
    sample = []
    for i in range(300):
        ws = prose()
        if i % 5 == 0:
            ws[int(rng.integers(30))] = "blockhead" if i % 2 else "dumpling"
        sample.append((" ".join(ws), int(i % 5 == 0)))
    model = fit(sample)
    assert {m.decode() for m in model.landmarks} & {"blockhead", "dumpling"}
    for w in ("blockhead", "blo-ckhead", "bloxckhead", "b l o c k h e a d", "BLOCKHEAD!!", "you-blockhead-you"):
        ws = prose()
        ws[7] = w
        assert scores(model, [" ".join(ws)])[0] >= 0.3, w
    assert (scores(model, [" ".join(prose()) for _ in range(200)]) < 0.3).mean() >= 0.99
    assert (scores(model, ["", "   ", "?!"]) < 0.3).all()


def test_a_longer_landmark_before_its_part_that_clean_documents_hold():
    toxic = [f"w{i} disgusting v{i}" for i in range(20)]
    clean = [f"x{i} ousting y{i} gusting" for i in range(4)] + [f"plain text {i}" for i in range(200)]
    marks = choose_landmarks(toxic + clean, np.array([1] * len(toxic) + [0] * len(clean)))
    assert b"usti" not in marks and any(b"disgust" in m for m in marks)
