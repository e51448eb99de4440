"""Parts of the operators that need no cluster, against brute force."""

import io
import random
import re
import tarfile

import numpy as np
import pytest

from tidemark.llm import common, media, minhash, packing, pii, suffix_dedup, token_files, topk, toxicity, words
from tidemark.llm.tokens import Encoder, default_path


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunked_encoding_is_exact(name):
    e, r = Encoder(default_path(name), limit=50), random.Random(1)
    odd = ["", " ", "a  b", "a\tb", "\n\nx\n", "don't it's", "<|endoftext|> a <|startoftext|>b", "日本 ４5 ß İx", "word*** %%%\nNext"]
    odd += ["".join(r.choice("aB .,\n'-é1<|\t²") for _ in range(r.randint(1, 30))) for _ in range(500)]
    assert all(e.ids(t).tolist() == e.full(t) for t in odd)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_texts_are_encoded_together_as_each_alone(name):
    e, r = Encoder(default_path(name), limit=50), random.Random(3)
    odd = ["", " ", "a", "a  b", "a\tb", "\n\nx\n", "\nx", "x \ny", "x\n y", "end ", "end\n", "One two, two.\nTwo two... (two) two", "don't it's 日本 語 İx", "é, è. ñ! ÀB\nÇ", "a <|endoftext|> b<", "x" * 5000]
    odd += ["".join(r.choice("aBé  .,\n'-1<|") for _ in range(r.randint(1, 40))) for _ in range(500)]
    odd += [" ".join(r.choice(["the", "The", "a,", "b.", "\nc", "日", "x1", "é!"]) for _ in range(60)) for _ in range(50)]
    for k in range(0, len(odd), 97):
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode_all(odd[k : k + 97])] == [e.full(t) for t in odd[k : k + 97]]
    assert len(e) <= 50 and len(e.old) <= 50
    assert e.encode_all([]) == []


def test_words_are_encoded_once_for_texts_together_and_rare_ones_not_kept(monkeypatch):
    e, asked = Encoder(default_path("byte_bpe_50k.json")), []
    plain = e.plain
    monkeypatch.setattr(e, "plain", lambda word: asked.append(word) or plain(word))
    rare = [f"rare{a}{b}" for a in "abcdefghij" for b in "abcdefghij"]
    texts = [f"x common {w}, common" for w in rare]
    e.encode_all(texts)
    assert sorted(asked) == sorted([*rare, "common"])
    assert set(e) == {"common"} and not e.old
    e.encode_all(texts)
    assert asked.count("common") == 1


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_token_file_round_trip(planes, dtype):
    r, out = np.random.default_rng(3), io.BytesIO()
    docs = [(None, r.integers(0, 60000, 5)), (3, r.integers(0, 60000, 0)), (4, r.integers(0, 60000, 700)), (4, r.integers(0, 60000, 1))]
    w = token_files.Writer(out, np.dtype(dtype), block=64, planes=planes)
    for i, ids in docs:
        w.add(i, ids.astype(dtype))
    w.close()
    got = list(token_files.Reader(out).documents())
    assert [g[0] for g in got] == [None, 3, 4, 4] and [g[1] for g in got] == [0, 5, 5, 705]
    assert all(np.array_equal(g[2], d[1]) for g, d in zip(got, docs, strict=True))


def test_packing_is_whole_and_within_capacity():
    lengths = np.random.default_rng(2).integers(1, 101, 400)
    bins, offsets = packing.match_and_fit(lengths, 100)
    for b in np.unique(bins):
        inside = np.flatnonzero(bins == b)
        order = inside[np.argsort(offsets[inside])]
        assert offsets[order].tolist() == np.concatenate([[0], np.cumsum(lengths[order])[:-1]]).tolist()
        assert lengths[order].sum() <= 100 and (lengths[order] > 33).sum() <= 2
    assert len(np.unique(bins)) <= 1.06 * lengths.sum() / 100 + 20
    assert packing.cut(5, 2) == [1, 2, 2] and packing.cut(4, 2) == [2, 2]


def test_repeated_windows():
    r = random.Random(5)
    texts = ["".join(r.choice("ab") for _ in range(r.choice([0, 63, 64, 200, 500]))).encode() for _ in range(40)] + [b"x" * 300, b"y" * 64, texts_part := b"long shared passage " * 8, b"z" + texts_part]
    length, seen = 64, {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    text, lo, hi, at, key = suffix_dedup.triggers(texts, length)
    covered = {(int(t), i) for t, a, b in zip(text, lo, hi, strict=True) for i in range(a, b + 1)}
    assert covered == {(t, i) for t in range(len(texts)) for i in range(len(texts[t]) - length + 1)}
    times, first = {}, {}
    for t, a, b, x, k in zip(text.tolist(), lo.tolist(), hi.tolist(), at.tolist(), key.tolist(), strict=True):
        p = (k, texts[t][a : b + length])
        times[p] = times.get(p, 0) + 1
        first[p] = (x - a, b - a + 1)
    names = sorted(times)
    runs = suffix_dedup.repeated_windows([p for _, p in names], np.array([first[p][0] for p in names]), np.array([first[p][1] for p in names]), np.array([times[p] for p in names]), length)
    for p, found in zip(names, runs, strict=True):
        inside = {i for a, b in found for i in range(a, b + 1)}
        assert inside == {i for i in range(first[p][1]) if seen[p[1][i : i + length]] > 1}


def test_words_and_sets():
    texts = [b"A b  c\td E", b"", b" \n", b"a", "é x".encode()]
    w = words.Words(texts, words.WHITE)
    assert w.counts.tolist() == [5, 0, 0, 1, 2]
    sets = dict(minhash._sets(texts, 4))
    assert {k: len(v) for k, v in sets.items()} == {0: 2, 3: 1, 4: 1}
    same = dict(minhash._sets([b"a B c d e"], 4))[0]
    assert np.array_equal(same, sets[0])


def test_patterns():
    brute = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choice("a@.b-1 2+") for _ in range(r.randint(0, 40)))
        got = pii.base_spans(t)
        assert [(a, b) for a, k, b in got if k == 0] == [m.span() for m in re.finditer(brute[0], t)]
        assert [(a, b) for a, k, b in got if k == 1] == [m.span() for m in re.finditer(brute[1], t) if all(int(p) <= 255 for p in m.group().split("."))]
    assert pii.redact("x a@b.c 1", [(2, 0, 7)]) == "x [EMAIL] 1"


def test_png_and_tar():
    for t in (b"", b"x", b"y" * 192, bytes(range(256)) * 3):
        p = media.padded(t)
        assert len(p) % 192 == 0 and p.startswith(t) and media.from_png(media.to_png(p)) == p
        assert media.png_header(media.to_png(p)[: media.HEADER]) == (64, len(p) // 192, 8)
    info = tarfile.TarInfo("a" * 64 + ".png")
    assert len(info.tobuf(tarfile.PAX_FORMAT)) == 512


def test_tree_is_exact():
    r = np.random.default_rng(8)
    rows, ids = r.integers(-60, 60, (900, 6)).astype(float), np.arange(900)
    tree = topk.Tree(rows, ids, leaf=16)
    for i in range(0, 900, 50):
        scores = rows @ rows[i]
        want = sorted(((-int(s), int(j)) for j, s in enumerate(scores) if j != i))[:20]
        who, found, got_scores = tree.search(rows[i : i + 1].astype(float), np.array([i]), np.array([-np.inf]), 20)
        got = [(-int(s), int(j)) for j, s in zip(found, got_scores, strict=True)]
        assert got == want


def test_kernel_tolerates_gaps():
    k = toxicity.Landmarks(["idiot"]).kernels(["idiot", "idxiot", "garden", ""])[:, 0]
    assert k[0] > 0.9 > k[1] > 0.05 > k[2] and k[3] == 0


@pytest.mark.parametrize("refuses", [False, True])
def test_a_second_attempt_leaves_one_whole_file(tmp_path, monkeypatch, refuses):
    from pyarrow import fs

    class Store(fs.LocalFileSystem):
        """A file system whose rename may refuse an existing file, as some do."""

        def move(self, a, b):
            if refuses and fs.LocalFileSystem().get_file_info(b).type == fs.FileType.File:
                raise OSError("exists")
            fs.LocalFileSystem().move(a, b)

    monkeypatch.setattr(common, "open_fs", lambda uri: (Store(), uri))
    for _ in range(2):
        common.publish(str(tmp_path / "a" / "file"), lambda out: out.write(b"whole"))
    assert [p.read_bytes() for p in (tmp_path / "a").iterdir()] == [b"whole"]

    def broken(out):
        out.write(b"half")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        common.publish(str(tmp_path / "a" / "other"), broken)
    assert not (tmp_path / "a" / "other").exists()


def test_folders_belong_to_their_owner(tmp_path, monkeypatch):
    gone = []
    monkeypatch.setattr(common, "_delete", lambda spark, path: gone.append(path))
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(common.Workspace, "made", [])
    with common.owned("mine"):
        mine = common.Workspace(None, "a")
    other = common.Workspace(None, "b")
    common.Workspace.release("mine")
    assert gone == [mine.path] and [x[2] for x in common.Workspace.made] == [other.path]
