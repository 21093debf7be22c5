"""Fusion of a step's nodes with frozen weights: states passed along edges twice, pooled by reliability.

A row is a step: arrays of its nodes' probabilities, availability and quality, its concept's embedding,
and features of the pairs that edges join. Rows need nothing of each other, so batches of them go through
numpy where they are read; nodes and edges are few and the same for all steps.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

EPSILON = 1e-6


@dataclass(frozen=True)
class Dense:
    """A linear map."""

    weight: np.ndarray
    bias: np.ndarray | float = 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight.T + self.bias


@dataclass(frozen=True)
class EdgeLayer:
    """One round: an edge's score of (source, target, edge features), shares over a target's valid edges, messages added and normalised."""

    hidden: Dense
    score: Dense
    message: np.ndarray
    gain: np.ndarray
    shift: np.ndarray

    def __call__(self, states: np.ndarray, source: np.ndarray, target: np.ndarray, features: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joined = np.concatenate([states[:, source], states[:, target], features], axis=2)
        scores = np.where(valid, self.score(np.maximum(self.hidden(joined), 0.0))[:, :, 0], -np.inf)
        into = np.eye(states.shape[1], dtype=bool)[target]  # (edge, node)
        top = np.where(into[None], scores[:, :, None], -np.inf).max(1, initial=-np.inf)
        raised = np.exp(scores - np.where(np.isfinite(top), top, 0.0)[:, target])
        share = raised / np.maximum(raised @ into, EPSILON)[:, target]
        messages = (states[:, source] @ self.message.T) * share[:, :, None]
        total = states + np.einsum("bed,en->bnd", messages, into.astype(float))
        mean, var = total.mean(2, keepdims=True), total.var(2, keepdims=True)
        return (total - mean) / np.sqrt(var + 1e-5) * self.gain + self.shift, share


@dataclass(frozen=True)
class GraphFusion:
    """Frozen weights of a fusion: node encoder, two edge layers, an estimator of reliability a node, and the output head."""

    modality: np.ndarray
    encoder: Dense
    layers: tuple[EdgeLayer, EdgeLayer]
    reliability: tuple[tuple[Dense, Dense], ...]
    head: Dense
    edges: tuple[tuple[int, int], ...]
    threshold: float = 0.0

    def __call__(self, p: np.ndarray, available: np.ndarray, quality: np.ndarray, concept: np.ndarray, pairs: np.ndarray) -> dict[str, np.ndarray]:
        """Per step: probability, whether it abstains, reliabilities and weights of nodes, shares of edges in both rounds."""
        p, quality = np.where(available, p, 0.5), np.where(available[:, :, None], quality, 0.0)
        clipped = np.clip(p, EPSILON, 1 - EPSILON)
        logit = np.log(clipped / (1 - clipped)) * available
        here = available.astype(float)
        inputs = [logit[:, :, None], quality, np.broadcast_to(self.modality, (len(p), *self.modality.shape)), here[:, :, None]]
        states = np.maximum(self.encoder(np.concatenate(inputs, axis=2)), 0.0)
        source, target = (np.array([e[k] for e in self.edges], int) for k in (0, 1))
        if (source == target).any():
            raise ValueError("an edge joins two nodes")
        features = np.concatenate([pairs, *(x[:, :, None] for x in (here[:, source], here[:, target], np.abs(p[:, source] - p[:, target]), p[:, source] * p[:, target]))], axis=2)
        shares = []
        for layer in self.layers:
            states, share = layer(states, source, target, features, available[:, source])
            shares.append(share)
        trust = np.stack([1 / (1 + np.exp(-out(np.maximum(hidden(np.concatenate([quality[:, k], concept], axis=1)), 0.0))[:, 0])) for k, (hidden, out) in enumerate(self.reliability)], axis=1) * here
        mass = trust.sum(1)
        weights = trust / np.maximum(mass, EPSILON)[:, None]
        abstained = ~available.any(1) | (mass <= EPSILON) | (trust.max(1) < self.threshold)
        pooled = np.einsum("bn,bnd->bd", weights, states)
        probability = np.where(abstained, 0.5, 1 / (1 + np.exp(-self.head(pooled)[:, 0])))
        return {"probability": probability, "abstained": abstained, "reliability": trust, "weights": weights, "edge_weights": np.stack(shares, axis=1)}


def seeded_fusion(nodes: int, quality: int, concept: int, pairs: int, edges: tuple[tuple[int, int], ...], hidden: int = 16, embedding: int = 4, threshold: float = 0.0, seed: int = 13007) -> GraphFusion:
    """Weights drawn from a seed, of the shapes that a trained fusion has."""
    rng = np.random.default_rng(seed)
    dense = lambda out, into: Dense(rng.normal(0, 1 / np.sqrt(into), (out, into)), rng.normal(0, 0.1, out))
    layer = lambda: EdgeLayer(dense(hidden, 2 * hidden + pairs + 4), dense(1, hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, hidden)), np.ones(hidden), np.zeros(hidden))
    return GraphFusion(
        rng.normal(0, 0.02, (nodes, embedding)), dense(hidden, 1 + quality + embedding + 1), (layer(), layer()), tuple((dense(hidden, quality + concept), dense(1, hidden)) for _ in range(nodes)), dense(1, hidden), edges, threshold
    )


def _stacked(column: pa.Array, *shape: int) -> np.ndarray:
    """An array column, nested or not, as one array of doubles; missing items are NaN, missing or short rows all NaN."""
    width = int(np.prod(shape))
    out = np.full((len(column), width), np.nan)
    for i, row in enumerate(column.to_pylist()):
        flat = [x for part in row or [] for x in (part if isinstance(part, list) else [part])]
        if len(flat) == width:
            out[i] = [np.nan if x is None else float(x) for x in flat]
    return out.reshape(-1, *shape)


def graph_fused(df: DataFrame, fusion: GraphFusion, p: str = "p", available: str = "available", quality: str = "quality", concept: str = "concept", pairs: str = "pairs") -> DataFrame:
    """`df` with probability, abstained, reliability, weights and edge_weights (an array a round) of each step.

    A node is there if it is said to be, and its probability and quality are numbers; others are masked:
    they send no message and have no weight. Steps without a node, or without one that is reliable
    enough, have 0.5 and abstain. Missing pair features and embeddings count as 0. Columns of those
    names are replaced. An empty table gives no rows.
    """
    nodes, edges = len(fusion.modality), len(fusion.edges)
    width = fusion.encoder.weight.shape[1] - 2 - fusion.modality.shape[1]
    context = fusion.reliability[0][0].weight.shape[1] - width
    extra = fusion.layers[0].hidden.weight.shape[1] - 2 * fusion.encoder.weight.shape[0] - 4
    made = {"probability": "double", "abstained": "boolean", "reliability": "array<double>", "weights": "array<double>", "edge_weights": "array<array<double>>"}
    given = df.drop(*made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            take = lambda name, *shape: _stacked(batch.column(batch.schema.get_field_index(name)), *shape)  # noqa: B023,E731
            value, q = take(p, nodes), take(quality, nodes, width)
            here = (take(available, nodes) == 1) & np.isfinite(value) & np.isfinite(q).all(2)
            out = fusion(np.where(here, value, 0.5), here, np.nan_to_num(q), np.nan_to_num(take(concept, context)), np.nan_to_num(take(pairs, edges, extra)))
            columns = [pa.array(out["probability"]), pa.array(out["abstained"]), *(pa.array(out[c].tolist(), t) for c, t in (("reliability", pa.list_(pa.float64())), ("weights", pa.list_(pa.float64())), ("edge_weights", pa.list_(pa.list_(pa.float64())))))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *made])

    return given.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in given.dtypes), *(f"{c} {t}" for c, t in made.items())]))
