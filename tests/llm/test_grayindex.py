import numpy as np
import pytest

from graphmill.llm import grayindex


def planted(rng, rows, bits, near, changes, cluster=0):
    """Random codes; ``near`` of them with a copy of a few changed bits, and a cluster around one code."""
    codes = rng.integers(0, 1 << bits, rows, dtype=np.uint64)

    def changed(n):
        out = np.zeros(n, np.uint64)
        for _ in range(changes):
            out |= np.uint64(1) << rng.integers(0, bits, n).astype(np.uint64)
        return out

    codes[near : 2 * near] = codes[:near] ^ changed(near)
    if cluster:
        codes[-cluster:] = codes[-1] ^ changed(cluster)
    return codes


def components(n, pairs):
    labels = grayindex.Labels(n)
    labels.link(*pairs)
    return labels.of.tolist()


def by_brute_force(group, codes, most, more):
    x, y = np.triu_indices(len(codes), 1)
    close = (group[x] == group[y]) & (np.bitwise_count(codes[x] ^ codes[y]) <= most)
    if more:
        close &= np.bitwise_count(more[0][x] ^ more[0][y]).sum(axis=1, dtype=np.int64) <= more[1]
    return components(len(codes), (x[close], y[close]))


@pytest.mark.parametrize(("most", "bits", "cluster"), [(8, 57, 0), (8, 57, 900), (3, 48, 300), (0, 20, 0), (8, 9, 0)])
@pytest.mark.parametrize("further", [False, True])
def test_large_groups_are_linked_as_by_brute_force(most, bits, cluster, further):
    rng = np.random.default_rng(most + cluster)
    codes = planted(rng, 2400, bits, 200, min(most, 7), cluster)
    codes[::7] = codes[0]  # equal codes too
    group = np.repeat([3, 1, 2], [2000, 390, 10])
    more = (rng.integers(0, 4, (2400, 2), dtype=np.uint64), 2) if further else None
    order, x, y = grayindex.links(group, codes, most, more)
    got = components(2400, (order[x], order[y]))
    assert got == by_brute_force(group, codes, most, more)


def test_large_buckets_are_linked(monkeypatch):
    rng = np.random.default_rng(1)
    codes = planted(rng, 3000, 57, 200, 3, 1500)
    monkeypatch.setattr(grayindex, "DENSE", 64)
    for many in (1 << 9, 1 << 30):
        order, x, y = grayindex.links(np.zeros(3000, np.int64), codes, 8, None, many)
        assert components(3000, (order[x], order[y])) == by_brute_force(np.zeros(3000), codes, 8, None)


def test_compared_pairs_of_a_large_group_are_few(monkeypatch):
    rows = 8000
    codes = planted(np.random.default_rng(2), rows, 57, 100, 5)
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: compared.append(x.size) or count(x))
    order, x, y = grayindex.links(np.zeros(rows, np.int64), codes, 8)
    assert len(x) >= 100 and sum(compared) < rows * rows / 2 / 16
