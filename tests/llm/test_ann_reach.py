"""Pruning and replication have an effect: few vectors scored where there are clusters, boundary vectors in several lists, and recall kept."""

import numpy as np
import pytest

from tidemark.llm import ann

REPLICAS = (3, 1.2, 0.3)  # the production values of search


def clustered(n, k, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, dim))
    x = centres[rng.integers(k, size=n)] + 0.6 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * rng.choice([0.1, 1.0], size=(n, 1))  # short vectors too


def measured(v, replicas, rows=48, k=20):
    norm = float(np.linalg.norm(v, axis=1).max())
    c = ann.balanced_kmeans(ann._lifted(v, norm, False), len(v) // rows)
    edges = ann.centroid_graph(c)
    probe = ann.calibrate(v, norm, c, edges, k, 0.94, 0.75, *replicas)
    at = np.arange(0, len(v), 40)
    share, replication = ann.share_scored(v, v[at], norm, c, edges, probe, *replicas)
    score = v[at] @ v.T
    score[np.arange(len(at)), at] = -np.inf
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    row, own = ann.lists_of(ann._lifted(v, norm, False), c, edges, 24, replicas[1], replicas[0], replicas[2])
    member = np.zeros((len(v), len(c)), bool)
    member[row, own] = True
    pr, pl = ann.probes(ann._lifted(v[at], norm, True), c, edges, *probe)
    probed = np.zeros((len(at), len(c)), bool)
    probed[pr, pl] = True
    found = (member[top] & probed[:, None, :]).any(2).mean(1)
    return share, replication, found


def test_clusters_are_pruned_and_boundaries_replicated():
    v = clustered(4000, 60)
    share, replication, found = measured(v, REPLICAS)
    assert share <= 0.25 and 1.05 < replication <= 3 and found.mean() >= 0.9
    alone_share, alone, _ = measured(v, (1, 1.0, 0.3))
    assert alone == 1.0


def test_like_dimensions_are_the_hard_case():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(4000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    share, replication, found = measured(v, REPLICAS)
    assert share <= 0.75 and replication > 1.2 and found.mean() >= 0.9


def test_a_query_that_probes_most_lists_opens_no_wide_beam(monkeypatch):
    rng = np.random.default_rng(3)
    c, q = (rng.normal(size=(n, 64)).astype(np.float32) for n in (1500, 300))
    edges, beams, search = ann.centroid_graph(c), [], ann.graph_search
    monkeypatch.setattr(ann, "graph_search", lambda x, c, edges, beam: beams.append(beam) or search(x, c, edges, beam))
    row, own = ann.probes(q, c, edges, 1.2, 0.0)
    d = np.sqrt(((q[:, None] - c) ** 2).sum(2))
    within = d <= 1.2 * d.min(1, keepdims=True)
    assert max(beams) <= 64
    assert len(row) >= 0.99 * within.sum() and (d[row, own] <= 1.21 * d.min(1)[row]).all()


def test_cells_hold_neighbouring_lists_and_a_long_list_has_several():
    rng = np.random.default_rng(4)
    c = (10 * rng.normal(size=(8, 16))[np.arange(400) % 8] + 0.1 * rng.normal(size=(400, 16))).astype(np.float32)
    sizes = np.full(400, 50)
    sizes[7] = 5000
    first, parts, cells = ann.packed(c, sizes, 1000)
    assert parts[7] == 5 and parts.sum() == 404
    held = np.bincount(first, sizes / parts, cells)
    assert held.max() <= 1000 and cells <= 40
    assert not (set(range(first[7], first[7] + 5)) & set(np.delete(first, 7)))
