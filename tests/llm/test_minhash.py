"""Near duplicates by circulant MinHash against brute force, on random texts with every odd case."""

import re

import numpy as np
import pytest

DDL = "doc_id long, text string, bands string, n string, class_id string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, size, percent):
    """{(id, text): (n, component)} by comparison of all pairs."""
    sets = []
    for doc_id, text in rows:
        w = words(text)
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if rows[a][0] == rows[b][0] or 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[k]:
            least[root(k)] = min(least.get(root(k), doc_id), doc_id)
    return sorted(((doc_id, len(sets[k]), least.get(root(k), doc_id) if doc_id is not None else None) for k, (doc_id, _) in enumerate(rows)), key=str)


def changed(w, rng, share):
    out = list(w)
    for k in rng.choice(len(w), max(1, int(len(w) * share)), replace=False):
        out[k] = f"new{rng.integers(1000)}"
    return out


def random_rows(seed):
    """Groups of copies at many distances, some with a chain of changes, and odd texts."""
    rng = np.random.default_rng(seed)
    rows, key = [], 0
    for _ in range(12):
        base = [f"w{rng.integers(60)}" for _ in range(int(rng.integers(3, 150)))]
        now = base
        for _ in range(int(rng.integers(1, 8))):
            now = changed(now, rng, rng.uniform(0, 0.06)) if rng.random() < 0.7 else base
            rows.append((key, " ".join(now)))
            key += int(rng.integers(1, 4))
    rows += [(key + 1, None), (key + 2, ""), (key + 3, " \n\t"), (key + 4, "one"), (key + 5, "ONE"), (key + 6, "one two"), (None, rows[0][1]), (0, rows[5][1]), (key + 7, "long " * 3 + " ".join(f"x{k % 700}" for k in range(30_000)))]
    rows += rows[:2]
    order = rng.permutation(len(rows))
    return [rows[k] for k in order]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(("size", "percent"), [(2, 80), (5, 80), (1, 90)])
def test_against_all_pairs(spark, seed, size, percent):
    from penumbra.llm.minhash import near_duplicates

    rows = random_rows(seed)
    out = near_duplicates(spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], DDL), size=size, percent=percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == plain(rows, size, percent)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in out)


def test_an_empty_table(spark):
    from penumbra.llm.minhash import near_duplicates

    out = near_duplicates(spark.createDataFrame([], DDL))
    assert out.columns == ["doc_id", "n_shingles", "class_id", "component_id", "kept"] and out.count() == 0


def test_a_group_cut_into_slices_is_found_whole(spark, monkeypatch):
    """Copies so unlike that no hub links them all, in bands of many slices."""
    from penumbra.llm import minhash

    monkeypatch.setattr(minhash, "SLICE", 4)
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(changed(base, rng, 0.045))) for k in range(60)]
    out = minhash.near_duplicates(spark.createDataFrame([(*r, "", "", "") for r in rows], DDL), size=2).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == plain(rows, 2, 80)


def test_both_steps_are_permutations_and_turns_share_their_order():
    from penumbra.llm.minhash import permuted, scattered, signatures

    some = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65_537)
    for make in (lambda x: permuted(x.copy()), scattered):
        assert len(np.unique(make(some))) == len(some)
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 5, 40_000, 70_000, 3)]
    got = signatures(sets, 12)
    for d, s in enumerate(sets):
        elements = scattered((s >> np.uint64(32)).astype(np.uint32))
        assert [int(permuted(elements - np.uint32(k)).min()) for k in range(12)] == got[:, d].tolist()


def test_coordinates_agree_as_often_as_the_similarity():
    from penumbra.llm.minhash import signatures

    rng = np.random.default_rng(1)
    agreed = []
    for _ in range(40):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (160, 20, 20))
        pair = signatures([np.concatenate([common, a]), np.concatenate([common, b])], 140)
        agreed.append((pair[:, 0] == pair[:, 1]).mean())
    assert abs(np.mean(agreed) - 0.8) < 0.02
