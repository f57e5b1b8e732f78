"""The inverted multi-index over many cells: ranks, recall and exact counts of what is found."""

import numpy as np

from ledgermatch.llm import vectors


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_ranks_are_places_in_the_traversal():
    rng = np.random.default_rng(1)
    x = unit(rng.standard_normal((400, 12)))
    index = vectors.MultiIndex(x, 7, 0.9, 0.9)
    some, of = x[:60], x[100:160]
    ranks = index._rank(some, of)
    index.visits = 49
    own = [c[0] for c in index.cells(of)]
    assert [c.index(o) for c, o in zip(index.cells(some), own, strict=True)] == ranks.tolist()


def test_recall_over_many_cells(spark, monkeypatch):
    """6,000 vectors in 144 cells, half of them with made neighbours at 0.9 to 0.97."""
    monkeypatch.setattr(vectors, "CELL", 42)
    rng = np.random.default_rng(2)
    base = unit(rng.standard_normal((3000, 32)))
    noise = rng.standard_normal(base.shape)
    noise = unit(noise - (noise * base).sum(1)[:, None] * base)
    cosine = rng.uniform(0.902, 0.97, len(base))[:, None]
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * noise]).astype(np.float32)
    seen = []
    build = vectors.MultiIndex.__init__
    monkeypatch.setattr(vectors.MultiIndex, "__init__", lambda self, *a: (build(self, *a), seen.append(self))[0])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r for r in vectors.near_duplicates(frame.repartition(4)).collect()}
    cells = len(seen[0].words[0]) * len(seen[0].words[1])
    assert cells == 144 and seen[0].visits < cells / 2
    y = unit(x.astype(np.float64))
    link = (y @ y.T >= 0.9) & ~np.eye(len(y), dtype=bool)
    links = np.array([got[k].n_links for k in range(len(x))])
    assert (links <= link.sum(1)).all() and links.sum() >= 0.99 * link.sum() and link.sum() >= 6000
    # Two ends of a link that is found count it both, and are in one component.
    assert links.sum() % 2 == 0
    paired = [k for k in range(3000) if got[k].n_links == got[k + 3000].n_links == 1 and link[k].sum() == 1]
    assert len(paired) > 2500 and all(got[k].component_id == got[k + 3000].component_id == k for k in paired)
