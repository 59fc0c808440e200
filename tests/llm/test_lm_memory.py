"""What the language model's tasks hold while they read a batch of texts."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from loamgraph.llm import lm_scoring
from loamgraph.runtime import ship, table


@pytest.fixture(scope="module")
def tasks(spark, sf):
    """The functions that count, learn and score, by name, as lm_scores hands them on."""
    ship(spark)
    docs, found = table(spark, sf, "documents").where("doc_id < 40"), {}
    kind, patch = type(docs), pytest.MonkeyPatch()
    real = kind.mapInArrow
    with patch.context() as p:
        p.setattr(kind, "mapInArrow", lambda self, f, *a: (found.setdefault(f.__name__, f), real(self, f, *a))[1])
        lm_scoring.lm_scores(docs, settings=lm_scoring.Settings(words=60, endings=6, classes=6, hidden=6, first_docs=10, first_epochs=1))
    patch.setattr(lm_scoring, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    yield found
    patch.undo()


def rows_of(texts):
    return pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), pa.array([False] * len(texts))], names=["doc_id", "text", "held_out"])


@pytest.mark.parametrize("task", ["_counted", "learn", "score"])
def test_a_task_holds_few_bytes_for_each_byte_of_text(tasks, task):
    words = np.array([f"{'abcdefgh'[i % 8] * (i % 7)}{i}" for i in range(5000)])
    rng = np.random.default_rng(4)
    texts = [" ".join(words[rng.integers(0, 5000, 1000)]) for _ in range(2000)]
    size = sum(map(len, texts))
    assert 0.8 < size / lm_scoring.GROUP_BYTES < 1  # all in one group
    list(tasks[task](iter([rows_of(texts[:200])])))  # tables that stay
    batch = rows_of(texts)
    tracemalloc.start()
    try:
        list(tasks[task](iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 4 * size
    finally:
        tracemalloc.stop()


def test_a_text_scored_in_pieces_has_the_score_of_the_whole(tasks, monkeypatch):
    text = "The cat  sat on\tthe Mat, unseen-word " * 300
    (whole,) = tasks["score"](iter([rows_of([text])]))
    monkeypatch.setattr(lm_scoring, "SLICE_BYTES", 1000)
    (pieces,) = tasks["score"](iter([rows_of([text])]))
    (a,), (b,) = whole.to_pylist(), pieces.to_pylist()
    for k in ("base", "score"):
        assert a.pop(k) == pytest.approx(b.pop(k), rel=1e-12)
    assert a == b and a["n_tokens"] == 300 * 7 + 1 and len(a["rare"]) + a["known"] == 300 * 7


@pytest.mark.parametrize("task", ["learn", "score"])
def test_rows_in_many_batches_are_grouped_as_in_one(tasks, task):
    texts = [f"the cat {i} sat on the mat {'again ' * (i % 50)}" for i in range(300)]
    rows = rows_of(texts)
    (whole,) = tasks[task](iter([rows]))
    (parts,) = tasks[task](iter([rows[i : i + 7] for i in range(0, 300, 7)]))
    assert parts.equals(whole)


def test_no_task_is_handed_a_large_batch(spark, monkeypatch):
    ship(spark)
    most = 2 * lm_scoring.BATCH_BYTES
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat(concat('word', id % 50, ' '), 700) as text")
    kind = type(docs)
    real, seen = kind.mapInArrow, []

    def bounded(self, f, *a):
        seen.append(f.__name__)

        def looked(batches):
            for b in batches:
                assert b.nbytes < most, b.nbytes
                yield b

        return real(self, lambda batches: f(looked(batches)), *a)

    monkeypatch.setattr(kind, "mapInArrow", bounded)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    out = lm_scoring.lm_scores(docs, settings=lm_scoring.Settings(words=60, endings=6, classes=6, hidden=6, first_docs=10, first_epochs=1))
    assert out.count() == 3000 and seen == ["_counted", "learn", "score"]
    assert spark.conf.get(key) == before
