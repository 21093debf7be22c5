"""Fusion over a graph against a plain loop over nodes and edges."""
import math
import random

import numpy as np

from plumbline.operators import fusion

EDGES = ((0, 1), (1, 0), (0, 2), (2, 1))


def loop(m, p, here, quality, concept, pairs):
    """(probability, abstained, reliability, shares of edges by round) of one step."""
    n = len(p)
    logit = [math.log(min(max(p[k], 1e-6), 1 - 1e-6) / (1 - min(max(p[k], 1e-6), 1 - 1e-6))) if here[k] else 0.0 for k in range(n)]
    q = [quality[k] if here[k] else [0.0] * len(quality[k]) for k in range(n)]
    safe = [p[k] if here[k] else 0.5 for k in range(n)]
    h = [np.maximum(m.encoder.weight @ np.concatenate([[logit[k]], q[k], m.modality[k], [float(here[k])]]) + m.encoder.bias, 0) for k in range(n)]
    shares = []
    for layer in m.layers:
        share, new = [0.0] * len(m.edges), []
        for k in range(n):
            mine = [e for e, (s, t) in enumerate(m.edges) if t == k and here[s]]
            score = {}
            for e in mine:
                s, t = m.edges[e]
                x = np.concatenate([h[s], h[t], pairs[e], [here[s], here[t], abs(safe[s] - safe[t]), safe[s] * safe[t]]])
                score[e] = float((layer.score.weight @ np.maximum(layer.hidden.weight @ x + layer.hidden.bias, 0) + layer.score.bias)[0])
            top = max(score.values(), default=0.0)
            total = sum(math.exp(v - top) for v in score.values())
            added = h[k].copy()
            for e in mine:
                share[e] = math.exp(score[e] - top) / total
                added = added + share[e] * (layer.message @ h[m.edges[e][0]])
            new.append((added - added.mean()) / math.sqrt(added.var() + 1e-5) * layer.gain + layer.shift)
        h, _ = new, shares.append(share)
    trust = []
    for k, (hidden, out) in enumerate(m.reliability):
        x = np.maximum(hidden.weight @ np.concatenate([q[k], concept]) + hidden.bias, 0)
        trust.append(float(1 / (1 + np.exp(-(out.weight @ x + out.bias)[0]))) if here[k] else 0.0)
    if not any(here) or max(trust) < m.threshold:
        return 0.5, True, trust, shares
    pooled = sum(t / sum(trust) * s for t, s in zip(trust, h, strict=True))
    return float(1 / (1 + np.exp(-(m.head.weight @ pooled + m.head.bias)[0]))), False, trust, shares


def test_graph_fusion_equals_the_loop(spark):
    m = fusion.seeded_fusion(3, 2, 2, 1, EDGES, hidden=6, threshold=0.55)
    rng = random.Random(5)
    cell = lambda: rng.choice([rng.random(), rng.random(), rng.random(), 0.0, 1.0])
    rows = [(i, [cell() for _ in range(3)], [rng.random() < 0.7 for _ in range(3)], [[rng.gauss(0, 2), rng.gauss(0, 2)] for _ in range(3)], [rng.gauss(0, 1), 0.5], [[rng.random()] for _ in EDGES], "old") for i in range(120)]
    rows += [(500, None, None, None, None, None, "old"), (501, [None, 0.3, 0.4], [True, True, None], [[1.0, None], [0.1, 0.2], [0.0, 0.0]], None, None, "old"), (502, [0.1, 0.2], [True] * 3, [[0.0, 0.0]] * 3, [0.0, 0.0], [[0.0]] * 4, "old")]
    schema = "i int, p array<double>, available array<boolean>, quality array<array<double>>, concept array<double>, pairs array<array<double>>, abstained string"
    got = {r.i: r for r in fusion.graph_fused(spark.createDataFrame(rows, schema).repartition(3), m).collect()}
    seen = set()
    for i, p, here, quality, concept, pairs, _ in rows[:120]:
        want = loop(m, p, here, quality, concept, pairs)
        seen.add(want[1])
        assert got[i].abstained == want[1] and math.isclose(got[i].probability, want[0], abs_tol=1e-9)
        assert np.allclose(got[i].reliability, want[2]) and np.allclose(got[i].edge_weights, want[3])
    assert seen == {True, False}
    assert (got[500].probability, got[500].abstained, got[502].abstained) == (0.5, True, True)
    only = loop(m, [0.5, 0.3, 0.5], [False, True, False], [[0.0, 0.0], [0.1, 0.2], [0.0, 0.0]], [0.0, 0.0], [[0.0]] * 4)
    assert math.isclose(got[501].probability, only[0], abs_tol=1e-9) and got[501].reliability[0] == got[501].reliability[2] == 0
    assert fusion.graph_fused(spark.createDataFrame([], schema), m).collect() == []
