"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import license_scan, media, minhash, mixing, packing, pii, suffix_dedup, token_files, topk, toxicity
from tidemark.llm.tokens import default_path

SCHEMA = "doc_id long, text string, source string, copy int, row int, key string, label string, spans string, unit long, id long, row_hash string, frequent int, `first` boolean"
VERY_LONG = "lorem ipsum 12 a@b.co idiot " * 30_000


@pytest.fixture(scope="module")
def docs(spark):
    long_ = "many words stand here and " * 40
    rows = [(1, None, None), (2, "", "a"), (None, "x", "a"), (3, long_, "b"), (3, long_, "b"), (4, "MIT License a@b.cd", "a")]
    return spark.createDataFrame([(*r, 1, 1, "k", "l", "s", 5, 6, "h", 7, True) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def model():
    toxic = ["you are an idiot today", "such trash here", "what an idiot", "trash again", "idiot", "the trash was out", "idiot one", "more trash"]
    return toxicity.fit(toxic, ["a fine day in may", "the words are kind", "many good words stand here", "nothing odd in this"] * 30)


RUNS = {
    "dedup": lambda d, m: suffix_dedup.remove_repeats(d, length=200),
    "near": lambda d, m: minhash.near_duplicates(d),
    "tokens": lambda d, m: token_files.token_files(d, tokenizer=default_path("word_bpe_49k.json")),
    "packing": lambda d, m: packing.pack(d, tokenizer=default_path("byte_bpe_50k.json")),
    "media": lambda d, m: media.media_columns(d),
    "licences": lambda d, m: license_scan.scan(d),
    "pii": lambda d, m: pii.digest(pii.find(d)),
    "toxicity": lambda d, m: toxicity.score(d, m),
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_has_a_result(docs, model, name):
    out = [r.asDict() for r in RUNS[name](docs, model).collect()]
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "2", "3", "3", "4", "None"]
    assert RUNS[name](docs.limit(0), model).count() == 0
    by_id = {r["doc_id"]: r for r in out}
    if name == "dedup":
        assert by_id[3]["n_removed"] == by_id[3]["n_bytes"] and by_id[1]["n_bytes"] == 0
    if name == "near":
        assert by_id[2]["n_shingles"] == 0 and by_id[2]["kept"] and by_id[3]["component_id"] == 3
    if name == "licences":
        assert by_id[4]["base_labels"] == "mit" and by_id[1]["labels"] == ""
    if name == "pii":
        assert by_id[4]["n_email"] == 1 and by_id[1]["spans"] == ""
    if name == "toxicity":
        assert by_id[1]["score"] == by_id[2]["score"] < 0.5 and by_id[None]["predicted"] == 0


@pytest.mark.parametrize("name", [n for n in RUNS if n != "near"])
def test_a_very_long_text_is_taken_whole(spark, model, name):
    table = spark.createDataFrame([(1, VERY_LONG), (2, "short")], "doc_id long, text string")
    out = [r.asDict() for r in RUNS[name](table, model).collect()]
    own = [r for r in out if r["doc_id"] == 1]
    if name == "dedup":
        assert own[0]["n_removed"] == own[0]["n_bytes"] == len(VERY_LONG)
    elif name == "tokens":
        assert own[0]["n_tokens"] > 200_000
    elif name == "packing":
        assert len(own) > 100 and {r["length"] for r in own if r["piece"]} == {2048}
    elif name == "media":
        assert own[0]["n_bytes"] == len(VERY_LONG)
    elif name == "licences":
        assert own[0]["n_words"] == 7 * 30_000
    elif name == "pii":
        assert own[0]["n_email"] == 30_000
    elif name == "toxicity":
        assert own[0]["predicted"] == 1


def test_near_duplicates_of_a_very_long_text(spark):
    words = [f"w{i}" for i in range(120_000)]
    table = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-500])), (3, " ".join(words[60_000:]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table, shingle=4).collect()}
    assert got == {1: (119_997, 1), 2: (119_497, 1), 3: (59_997, 3)}


def test_training_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [0, 0]
    odd = spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score(docs, toxicity.train(docs, odd)).collect()] == [0, 0]
    assert toxicity.train(docs.limit(0), none).marks.marks == ["-"]


def test_mixing(docs):
    out = mixing.mix(docs, weights={"b": 1.0}).collect()
    assert {r.source for r in out} <= {"b"} and mixing.mix(docs.limit(0)).count() == 0
    plain = mixing.mix(docs.drop("copy")).collect()
    by_id = {}
    for r in plain:
        by_id.setdefault((r.doc_id, r.text), []).append(r.copy)
    [n] = {r.repetitions for r in plain if r.doc_id == 3} or {0}
    assert sorted(by_id.get((3, "many words stand here and " * 40), [])) == sorted([*range(1, n + 1)] * 2)
    rates = {r.source: r.rate for r in mixing.source_rates(docs).collect()}
    assert rates[None] == 1.0 and rates["a"] > 1 > rates["b"]
    order = [r.mix_order for r in plain]
    assert all(0 <= x < 1 for x in order)


def brute(rows, queries, k):
    out = []
    for q, u in queries:
        best = sorted((-sum(a * b for a, b in zip(u, v, strict=True)), i) for i, v in rows if i != q and len(v) == len(u))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard, block", [(1 << 14, 1 << 14), (40, 7)])
def test_top_k(spark, shard, block):
    r = np.random.default_rng(6)
    good = [(i, r.integers(-2, 3, 6).tolist()) for i in range(150)] + [(200 + i, [1, 1, 1, 0, 0, 0]) for i in range(60)]
    rows = [(i, [x / 64 for x in v], "s", 0) for i, v in good]
    bad = [(501, None), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [math.nan] * 6), (504, [math.inf] + [0.0] * 5), (None, [1.0] * 6)]
    table = spark.createDataFrame(rows + [(i, v, "s", 0) for i, v in bad], "vec_id long, embedding array<double>, shard string, rank int")
    got = topk.top_k(table, query_filter="vec_id % 20 = 0", k=5, shard_rows=shard, block_rows=block)
    assert sorted(map(tuple, got.collect())) == brute(good, [(i, v) for i, v in good if i % 20 == 0], 5)
    assert topk.top_k(table.limit(0), query_filter="vec_id % 20 = 0").count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (20, [])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(few, query_filter="vec_id % 20 = 0", scale=1).collect()] == [(0, 1, 1, 11)]


def test_a_tree_opens_few_leaves_of_clustered_rows():
    r = np.random.default_rng(9)
    centres = r.normal(0, 60, (64, 24))
    rows = np.floor(np.concatenate([c + r.normal(0, 3, (128, 24)) for c in centres]))
    tree = topk.Tree(rows, np.arange(len(rows)))
    seen = []
    tree.runs = [SeenRun(x, seen) for x in tree.runs]
    queries = rows[::128]
    who, ids, scores = tree.search(queries, np.arange(0, len(rows), 128), np.full(64, -np.inf), 10)
    want = np.sort(np.where(np.arange(len(rows))[None] == np.arange(0, len(rows), 128)[:, None], -np.inf, queries @ rows.T), 1)[:, :-11:-1]
    assert all(sorted(scores[who == q], reverse=True) == want[q].tolist() for q in range(64))
    assert len(seen) < 0.5 * 64 * len(tree.runs)


class SeenRun(np.ndarray):
    def __new__(cls, run, seen):
        out = np.asarray(run).view(cls)
        out.seen = seen
        return out

    def __array_finalize__(self, obj):
        self.seen = getattr(obj, "seen", None)

    def __getitem__(self, key):
        return np.asarray(self)[key]

    def __array_function__(self, f, types, args, kwargs):
        return f(*[np.asarray(a) if isinstance(a, SeenRun) else a for a in args], **kwargs)


# --- stages -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and labels, and the documents with nulls, repeats and columns of other names."""
    place = str(tmp_path_factory.mktemp("corpus"))
    base = "these are many quite harmless words that stand here in a row and go on for some time "
    rows = [(1, base * 3, "en", "a", 1), (1, base * 3, "en", "a", 1), (2, base * 3 + "end", "en", "b", 2), (None, base * 3, None, None, None), (None, None, None, None, None), (5, None, "en", "a", 0), (6, "", "en", "a", 0), (6, "", "en", "a", 0), (7, "what an idiot this is", "en", "b", 9), (8, "write to a.b@c.org now", None, "b", 9), (9, "lone", "en", None, 4)]
    rows += [(100 + i, f"you idiot number {i}", "en", "b", 3) for i in range(30)] + [(200 + i, f"a kind word {i} of {i * 7} and {i * 13} more", "en", "a", 3) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(100 + i, 1) for i in range(30)] + [(200 + i, 0) for i in range(60)] + [(None, 1), (1, None)], "doc_id long, toxic int").write.parquet(f"{place}/labels.parquet")
    clash = table.select("*", *[F.lit(1).alias(c) for c in ("row_hash", "kept_id", "many", "score", "copy", "spans", "redacted", "unit")])
    return SimpleNamespace(place=place, table=table, clash=clash)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_empty_tables(spark, corpus, name, stage):
    out = stage(spark, corpus.clash.limit(0), corpus.place)
    assert out.count() == 0
    if name != "packing":
        assert out.columns == corpus.table.columns and [f.dataType for f in out.schema] == [f.dataType for f in corpus.table.schema]


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_toxic_documents_go(spark, corpus):
    kept = texts(corpus_pipeline.drop_toxic(spark, corpus.clash, corpus.place))
    assert {i for i, _ in kept if i and (i == 7 or 100 <= i < 130)} == set()
    assert len(kept) == corpus.table.count() - 31 and (None, None) in kept and kept.count((6, "")) == 2


def test_one_of_each_group_stays(spark, corpus):
    small = corpus.clash.filter("doc_id is null or doc_id < 10")
    kept = texts(corpus_pipeline.drop_near_duplicates(spark, small, corpus.place))
    assert sorted(str(i) for i, _ in kept) == ["1", "5", "6", "6", "7", "8", "9", "None"] and (None, None) in kept
    twins = spark.createDataFrame([(None, "a b c d e f g h"), (None, "A b  c d e f g h"), (4, "q r s t u v w x"), (4, "q r s t u v w X")], "doc_id long, text string").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))])
    assert sorted(str(i) for i, _ in texts(corpus_pipeline.drop_near_duplicates(spark, twins, corpus.place))) == ["4", "None"]


def test_personal_data_is_replaced(spark, corpus):
    out = {r.doc_id: r for r in corpus_pipeline.redact_pii(spark, corpus.clash.filter("doc_id in (5, 8)"), corpus.place).collect()}
    assert out[8].text == "write to [EMAIL] now" and out[8].n_chars == len("write to [EMAIL] now") and (out[5].text, out[5].n_chars) == ("", 0)


def test_mixing_stage_repeats_whole_rows(spark, corpus):
    rates = {r.source: r.rate for r in mixing.source_rates(corpus.table).collect()}
    got = corpus_pipeline.mix_sources(spark, corpus.clash, corpus.place).groupBy("source").count().collect()
    sizes = {r.source: r["count"] for r in corpus.table.groupBy("source").count().collect()}
    for r in got:
        assert abs(r["count"] - rates[r.source] * sizes[r.source]) <= 6 * math.sqrt(rates[r.source] * sizes[r.source]) + 1


def test_run_packs_what_the_stages_keep(spark, corpus):
    from tokenizers import Tokenizer

    kept, stages = corpus.table, corpus_pipeline.STAGES[:-1]
    for _, stage in stages:
        kept = spark.createDataFrame(stage(spark, kept, corpus.place).collect(), corpus.table.schema)
    library = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, corpus.place).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, len(library.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in kept.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in out) == want
    alone = {}
    for r in out:
        alone.setdefault((r.sequence_id), []).append((r.offset, r.length))
    for placed in alone.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
