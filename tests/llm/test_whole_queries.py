"""Whole queries against brute force over all documents of a small table."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest

from tidemark.llm import license_scan, packing, queries, toxicity
from tidemark.llm.tokens import default_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(default_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in queries.queries()[name](spark, SF).collect()}


def test_op1_removes_what_a_repeated_string_covers(spark, docs):
    length, raw = 200, {i: t.encode() for i, t in docs.items()}
    seen = Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
    got = rows(spark, "op1_prefix_free_parsing")
    for i, b in raw.items():
        gone, end = bytearray(len(b)), 0
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[max(k, end) : k + length] = b"\1" * (k + length - max(k, end))
                end = k + length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_op3_reads_back_what_was_stored(spark, docs):
    got = rows(spark, "op3_media_columns")
    features = {}
    for i, t in docs.items():
        b = t.encode()
        payload = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert features.setdefault(t, (r.feature, r.media_sha256, r.media_bytes)) == (r.feature, r.media_sha256, r.media_bytes)


def test_op6_numbers_every_id(spark, docs, library):
    got, at = rows(spark, "op6_token_files"), 0
    for i in sorted(docs):
        ids = library["word_bpe_49k.json"].encode(docs[i], add_special_tokens=False).ids + [2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_op6_encodes_texts_together_and_keeps_no_rare_words(spark, library):
    from tidemark.llm import token_files

    rare = [a + b + c for a in "bcdfgh" for b in "xqzjkvw" for c in "bcdfghjk"]
    texts = {i: f"x often xq{w}v, often" for i, w in enumerate(rare)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in token_files.token_files(table, tokenizer=default_path("word_bpe_49k.json")).collect()}
    for i, t in texts.items():
        ids = library["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids + [2]
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))

    def held(batches):
        import pyarrow as pa

        from tidemark.llm import tokens

        enc = tokens.encoder(path)
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(w.rstrip(",")[2:-1] in known for w in enc)]}, schema=pa.schema([("n", pa.int64())]))

    path, known = default_path("word_bpe_49k.json"), set(rare)
    assert {r.n for r in spark.range(0, 400, 1, 4).mapInArrow(held, "n long").collect()} == {0}


LUHN = {str(d): [d, sum(map(int, str(2 * d)))] for d in range(10)}


def luhn(digits):
    return sum(LUHN[c][i % 2] for i, c in enumerate(reversed(digits))) % 10 == 0


def base_by_regex(text):
    out = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_op8_has_the_base_spans(spark, docs):
    got, names = rows(spark, "op8_random_field_pii"), ("email", "ip", "card", "phone")
    for i, t in docs.items():
        base = base_by_regex(t)
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
        r, n = got[i], Counter(k for _, k, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (n[0], n[1], n[2], n[3], hashlib.sha256(text.encode()).hexdigest())
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_op9_finds_every_phrase(spark, docs):
    got = rows(spark, "op9_diagonal_voting")
    for i, t in docs.items():
        low = t.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.encode().split()
            at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert 0 <= r.score <= 1


def check_packing(pieces, texts, encode, capacity):
    """pieces: doc_id, piece, start, length, crc, sequence, offset. Whole, in place, gapless, and few sequences."""
    total, by_doc, by_sequence = 0, {}, {}
    for p in pieces:
        by_doc.setdefault(p[0], []).append(p)
        by_sequence.setdefault(p[5], []).append(p)
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids = [*encode(t), 0]
        total += len(ids)
        at = 0
        own = sorted(by_doc[i], key=lambda p: p[1])
        assert [p[1] for p in own] == list(range(len(own))) and all(p[3] == capacity for p in own[1:]) and (len(own) == 1) == (len(ids) <= capacity)
        for p in own:
            assert p[2] == at and p[4] == zlib.crc32(struct.pack(f"<{p[3]}I", *ids[at : at + p[3]]))
            at += p[3]
        assert at == len(ids)
    for placed in by_sequence.values():
        at = 0
        for p in sorted(placed, key=lambda p: p[6]):
            assert p[6] == at
            at += p[3]
        assert at <= capacity
    assert len(by_sequence) <= 1.05 * -(-total // capacity) + 1


def test_op10_packs_everything(spark, docs, library):
    got = queries.queries()["op10_best_fit_packing"](spark, SF).collect()
    check_packing([tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")) for r in got], docs, lambda t: library["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids, 2048)


def test_op10_packs_unit_by_unit(spark, docs, library):
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{SF}/documents.parquet")
    for tasks in (64, 3):
        out = packing.pack(table, tokenizer=default_path("byte_bpe_50k.json"), capacity=300, unit_docs=50, most_tasks=tasks)
        got = out.select("doc_id", "piece", "start", "length", F.crc32("ids"), "sequence_id", "offset").collect()
        assert len({s[5] >> 40 for s in got}) >= 4
        check_packing([tuple(r) for r in got], docs, lambda t: library["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids, 300)


def test_packing_in_small_slices_is_whole(spark, docs, library, monkeypatch):
    import corpus_pipeline
    from pyspark.sql import functions as F

    table, asked, pack = spark.read.parquet(f"{SF}/documents.parquet"), [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda docs, **given: asked.append(given) or pack(docs, **{**given, "slice_bytes": 5_000}))
    out = corpus_pipeline.pack_sequences(spark, table, SF).select("doc_id", "piece", "start", "length", F.crc32("ids"), "sequence_id", "offset")
    check_packing([tuple(r) for r in out.collect()], docs, lambda t: library["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids, 2048)
    assert asked[0]["slice_bytes"] <= 2 << 20


def test_op2_follows_the_contract(spark, docs):
    got = rows(spark, "op2_string_kernel_toxicity")
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


@pytest.fixture(scope="module")
def trained():
    """A model of the labelled texts of sf0.1, and those held out."""
    import duckdb

    d = "/root/testdata/sf0.1"
    found = duckdb.sql(f"SELECT doc_id, toxic, coalesce(text, '') FROM '{d}/labels.parquet' JOIN '{d}/documents.parquet' USING (doc_id) WHERE toxic IS NOT NULL ORDER BY doc_id").fetchall()
    held = [(y, t) for i, y, t in found if zlib.crc32(str(i).encode()) % 5 == 0]
    seen = [(y, t) for i, y, t in found if zlib.crc32(str(i).encode()) % 5]
    return toxicity.fit([t for y, t in seen if y == 1][:2500], [t for y, t in seen if y == 0][:2500]), held


INSULTS = ["idiot", "trash", "pathetic", "worthless", "loser", "disgusting", "moron", "clown"]


def hidden_forms(word):
    r = random.Random(word)
    return [word, word.upper(), word + "s", ".".join(word), "-".join(word), "*".join(word), " ".join(word), word[:2] + "**" + word[2:], *(word[:k] + r.choice("qxzk") + word[k:] for k in range(1, len(word))), word[:2] + word[1] + word[2:]]


def test_insults_are_found_plain_and_hidden(trained):
    model, _ = trained
    clean = next(t for y, t in trained[1] if y == 0 and len(t) > 500 and model.probability(toxicity.Scorer(model).margins([t]))[0] < 0.5)
    for word in INSULTS:
        forms = hidden_forms(word)
        p = model.probability(toxicity.Scorer(model).margins([f"{clean} {f}. {clean}" for f in forms]))
        assert (p >= 0.5).all(), [f for f, x in zip(forms, p, strict=True) if x < 0.5]


def test_held_out_clean_texts_are_left_alone(trained):
    model, held = trained
    p = model.probability(toxicity.Scorer(model).margins([t for _, t in held]))
    clean = [x for x, (y, _) in zip(p, held, strict=True) if y == 0]
    toxic = [x for x, (y, _) in zip(p, held, strict=True) if y == 1]
    assert sum(x >= 0.5 for x in clean) <= 0.02 * len(clean) and sum(x >= 0.5 for x in toxic) >= 0.7 * len(toxic)


def test_the_kernel_is_the_textbook_one():
    def weighed(s, t, n, decay):
        """Lodhi and others' recursion, by definition: sum over common subsequences of decay^(spans)."""
        from functools import lru_cache

        @lru_cache(None)
        def inner(i, a, b):
            if i == 0:
                return 1.0
            if min(a, b) < i:
                return 0.0
            return decay * inner(i, a - 1, b) + sum(inner(i - 1, a - 1, j) * decay ** (b - j + 1) for j in range(b) if t[j] == s[a - 1])

        return sum(decay**2 * inner(n - 1, a - 1, j) for a in range(1, len(s) + 1) for j in range(len(t)) if t[j] == s[a - 1])

    r, decay = random.Random(4), toxicity.DECAY
    pairs = [("idiot", "idxiot"), ("abcabc", "cab"), ("aaaa", "aaa"), ("été", "été")] + [("".join(r.choice("abcd") for _ in range(r.randint(1, 9))), "".join(r.choice("abcd") for _ in range(r.randint(1, 9)))) for _ in range(60)]
    for s, t in pairs:
        a, b = "^" + s, "^" + t
        want = sum(weighed(a, b, n, decay) / decay ** (2 * n) for n in toxicity.ORDERS)
        norm = want / toxicity._own(len(a)) / toxicity._own(len(b))
        got = float(toxicity.Landmarks([t]).kernels([s])[0, 0])
        assert abs(got - min(norm, 1) ** toxicity.POWER) < 1e-4, (s, t)
