"""The random field: exact decoding, and personal data of every kind."""

import itertools

import numpy as np
import pytest

from tidemark.llm import pii


@pytest.fixture(scope="module")
def field():
    return pii.default_field()


def score_of(field, scores, labels):
    path = [0, *labels, 0]
    return sum(field.moves[a, b] for a, b in itertools.pairwise(path)) + sum(scores[i, x] for i, x in enumerate(labels))


def test_viterbi_is_the_best_of_all_paths(field):
    r = np.random.default_rng(8)
    for n in (1, 2, 3, 4):
        scores = r.normal(0, 3, (n, len(pii.LABELS)))
        best = max(itertools.product(range(len(pii.LABELS)), repeat=n), key=lambda p: score_of(field, scores, p))
        padded = np.zeros((2, 5, len(pii.LABELS)))
        padded[0, :n] = scores
        assert tuple(field.viterbi(padded, np.array([n, 0]))[0, :n]) == best


def test_cutting_at_sure_words_is_exact(field):
    texts = ["", "  ", "one", "ring +1 (555) 123-4567 now", "card 4111 1111 1111 1111.", "x" * 5000 + " a@b.co", "é Ü 日本 ab12 *** 10.0.0.1", "password=abc123def456 or so", "call 555-123-4567, please: me@x.org", "A1 b2 c3 d4 12:30 $5 v1.2.3"]
    types = pii.Types(field, limit=5)
    for text, spans in zip(texts, pii.field_spans(texts, types), strict=True):
        words = text.split()
        if not words:
            assert spans == []
            continue
        scores = field.scores(words)
        assert np.allclose(scores, pii.Types(field).scores(words))
        labels = field.viterbi(scores[None], np.array([len(words)]))[0]
        assert spans == pii._merged(text, [(i, int(x)) for i, x in enumerate(labels) if x])


def test_every_kind_is_found(field):
    kinds = lambda t: {pii.KINDS[k] for _, k, _ in [*pii.base_spans(t), *pii.field_spans([t], pii.Types(field))[0]]}
    assert "card" in kinds("my card is 4111 1111 1111 1111 ok") and "phone" in kinds("ring +44 20 7946 0958 today") and "ip" in kinds("at 10.1.2.3 it was") and "email" in kinds("mail a.b@c.org now")
    assert "secret" in kinds("use password=0a1b2c3d4e5f6071 then") and kinds("nothing to see in these words at all") == set()


@pytest.mark.parametrize(
    "text, spans",
    [
        ("4111111111111111", [(0, 2, 16)]), ("4111111111111112", []), ("41111111111", []), ("1.2.3.4.5", [(0, 1, 7)]), ("256.1.1.1", []), ("+1234567", []), ("+123456789", [(0, 3, 10)]),
        ("a@b", []), ("a@b.c@d.e", [(0, 0, 5)]), ("x@y..z", []), ("@b.co", []), ("+1 (2) 3.4-5678901", [(0, 3, 18)]),
    ],
)
def test_patterns(text, spans):
    assert pii.base_spans(text) == spans


def test_the_shape_of_a_long_word_has_its_end():
    assert pii.shape("a" * 100 + "7") == "xd" and pii.shape("a" * 100) == "x"


def test_workers_keep_no_words_after_a_task(spark):
    texts = [(i, " ".join(f"w{i}-{k}@x" for k in range(50))) for i in range(200)]
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert pii.find(table).count() == 200

    def held(batches):
        import pyarrow as pa

        from tidemark.llm import pii

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [pii.word_features.cache_info().currsize]}, schema=pa.schema([("n", pa.int64())]))

    assert {r.n for r in spark.range(0, 400, 1, 4).mapInArrow(held, "n long").collect()} == {0}


def test_few_words_features_are_held_and_all_are_scored():
    words = [f"w{i}@x" for i in range(30_000)]
    types = pii.Types(pii.default_field())
    pii.word_features.cache_clear()
    scores = types.scores(words)
    assert len(scores) == 30_000 and 0 < pii.word_features.cache_info().currsize <= 20_000
    assert np.array_equal(types.scores(words[:50]), pii.Types(pii.default_field()).scores(words[:50]))
    pii.word_features.cache_clear()
