"""Helpers of the tests in this folder."""


def run_everywhere(query, spark, folder):
    """A query over a whole small table: it has rows and stable columns."""
    df = query(spark, folder)
    assert df.count() > 0
    return df


def components(nodes, pairs):
    """Union-find by brute force: node -> smallest of its component."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
