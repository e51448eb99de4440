"""Near-duplicates as a whole, against all pairs of full sets."""

import random

import numpy as np

from tidemark.llm import minhash


def test_components_equal_brute_force(spark):
    r = random.Random(11)
    base = [[r.choice("abcdefghijklmnop") + str(r.randint(0, 30)) for _ in range(r.choice([9, 40, 120]))] for _ in range(12)]
    texts = []
    for _ in range(150):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = "new" + str(r.randint(0, 9))
        texts.append(" ".join(words))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    parent = list(range(len(texts)))
    for _ in texts:
        before = list(parent)
        for i, a in enumerate(sets):
            for j in range(i):
                if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    parent[i] = parent[j] = min(parent[i], parent[j])
        if parent == before:
            break
    out = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=4, percent=80).collect()
    assert {x.doc_id: x.component_id for x in out} == dict(enumerate(parent))
    assert all(x.n_shingles == len(sets[x.doc_id]) and x.kept == (x.doc_id == x.component_id) for x in out)


def test_groups_do_not_change_bands():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 1 << 63, n, np.uint64)) for n in (5, 40000, 7, 9, 33000, 6)]
    together = minhash.band_hashes(sets, 16, 8)
    assert np.array_equal(together, np.concatenate([minhash.band_hashes([s], 16, 8) for s in sets]))
    assert list(minhash._groups([3, 3, 9, 1], most_items=6, most_sets=2)) == [(0, 2), (2, 3), (3, 4)]


def test_no_link_of_a_whole_table_is_lost(spark):
    """All pairs of sf0.01 that share a shingle, on full sets: components, sizes and kept documents are the same."""
    import re
    from collections import Counter

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    sets, holders = {}, {}
    for r in table.select("doc_id", "text").collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().translate(lower))
        sets[r.doc_id] = {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()
        for s in sets[r.doc_id]:
            holders.setdefault(s, []).append(r.doc_id)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = 0
    for i, own in sets.items():
        for j, shared in Counter(j for s in own for j in holders[s] if j < i).items():
            if 100 * shared >= 80 * len(own | sets[j]):
                links += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: r for r in minhash.near_duplicates(table, shingle=4, percent=80).collect()}
    assert links > 50 and {i: root(i) for i in sets} == {i: r.component_id for i, r in got.items()}
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == root(i)) for i, r in got.items())


def test_rows_of_one_id_are_told_apart(spark):
    one, two = "a b c d e f g h", "q r s t u v w x"
    rows = [(1, one), (1, two), (2, one + " i"), (3, two), (None, one), (None, "p"), (4, None)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), by_row=True).collect()
    kept = sorted(((r.doc_id, r.n_shingles) for r in out if r.first), key=str)
    # five-word shingles: 4 of document 2 are among its 5, which is a similarity of 0.8
    assert kept == sorted([(1, 4), (1, 4), (None, 1), (4, 0)], key=str)
