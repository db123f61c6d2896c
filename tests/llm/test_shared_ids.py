"""Near-duplicate groups where rows of one doc_id have different texts: links of all its texts count."""

import random

from parchmint.llm import near_dedup


def _rows():
    """Documents with two texts of unlike length each: near copies of either, exact copies, and both under other ids."""
    rng = random.Random(11)
    voc = ["w%d" % i for i in range(3000)]
    near = lambda words: [*words[:-1], rng.choice(voc)]
    rows, i = [], 1
    for case in range(24):
        a, b = ([rng.choice(voc) for _ in range(n)] for n in (rng.randint(30, 60), rng.randint(80, 150)))
        ids = list(range(i, i + 4))
        rng.shuffle(ids)
        i += 4
        rows += [(ids[0], a), (ids[0], b)]
        rows += [(ids[1], near(a) if case % 3 else a), (ids[2], near(b) if case % 4 else b)]
        if case % 2:
            rows.append((ids[3], near(near(b))))
    return [(d, " ".join(w)) for d, w in rows]


def test_links_of_every_text_of_a_doc_id(spark):
    rows = _rows()
    sets = [(d, near_dedup.shingle_set(t, 5)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (d, x) in enumerate(sets):
        for e, y in sets[n + 1 :]:
            if 100 * len(x & y) >= 80 * len(x | y) and root(d) != root(e):
                parent[max(root(d), root(e))] = min(root(d), root(e))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((d, root(d)) for d, _ in rows)
