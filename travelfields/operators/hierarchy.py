"""Contracted tiles: what a tile of a street network needs so that many least-cost fields cross it by a few vector operations a node.

Nodes of a tile are taken out one after the other, those with the fewest links first and those at its border last; whenever a node goes, the ways
through it stay as shortcuts between its neighbours. A field then needs two sweeps: from each node to those that went later, and back. Whatever the labels at the start
(a source, or the tile's border), all nodes end with their least cost over paths inside the tile. The border's own part of the order, which holds the
least costs from border to border, is all that a search between tiles needs.

Costs are multiples of config.COST_UNIT, of which doubles sum billions without rounding, so a shortcut costs what its edges cost one by one."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd

#: Links of a node from which on the nodes that are left are contracted as a matrix.
DENSE_LINKS = 24
_KINDS = {"up_at": np.int32, "up_to": np.int32, "up_w": np.float64, "down_at": np.int32, "down_from": np.int32, "down_w": np.float64}


def contract(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, border: np.ndarray) -> dict:
    """order (nodes as they go), and by place in it the links to later nodes: up_* from a node, down_* to it. border: which nodes go last."""
    out: list[dict] = [{} for _ in range(n)]
    into: list[dict] = [{} for _ in range(n)]
    for a, b, c in zip(src.tolist(), dst.tolist(), w.tolist()):
        if a != b and c < out[a].get(b, np.inf):
            out[a][b] = into[b][a] = c
    links = lambda v: len(out[v]) + len(into[v])
    last = border.tolist()
    heap = [(last[v], links(v), v) for v in range(n)]
    heapq.heapify(heap)
    order, gone, ups, downs = [], [False] * n, [], []
    while heap:
        late, size, v = heapq.heappop(heap)
        if gone[v]:
            continue
        if size != links(v):
            heapq.heappush(heap, (late, links(v), v))
            continue
        if size > DENSE_LINKS:
            break
        gone[v] = True
        order.append(v)
        ups.append(list(out[v].items()))
        downs.append(list(into[v].items()))
        for a, wa in downs[-1]:
            row = out[a]
            del row[v]
            for b, wb in ups[-1]:
                if a != b and wa + wb < row.get(b, np.inf):
                    row[b] = into[b][a] = wa + wb
        for b, _ in ups[-1]:
            del into[b][v]
    rest = sorted((v for v in range(n) if not gone[v]), key=lambda v: (last[v], links(v), v))
    if rest:
        at = {v: k for k, v in enumerate(rest)}
        cost = np.full((len(rest), len(rest)), np.inf)
        for v in rest:
            for b, c in out[v].items():
                cost[at[v], at[b]] = c
        for k, v in enumerate(rest):
            order.append(v)
            a, b = np.flatnonzero(np.isfinite(cost[k + 1 :, k])) + k + 1, np.flatnonzero(np.isfinite(cost[k, k + 1 :])) + k + 1
            ups.append([(rest[j], cost[k, j]) for j in b])
            downs.append([(rest[i], cost[i, k]) for i in a])
            if len(a) and len(b):
                cost[np.ix_(a, b)] = np.minimum(cost[np.ix_(a, b)], cost[a, k][:, None] + cost[k, b][None, :])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    flat = lambda lists: (np.cumsum([0, *map(len, lists)]), place[[j for x in lists for j, _ in x]] if any(lists) else [], [c for x in lists for _, c in x])
    found = dict(zip(_KINDS, (*flat(ups), *flat(downs))))
    return {"order": np.array(order, np.int64), **{k: np.asarray(found[k], t) for k, t in _KINDS.items()}}


def part(h: dict, first: int) -> dict:
    """The contraction from place `first` on, places counted from there."""
    out = {"order": h["order"][first:]}
    for way, to in (("up", "to"), ("down", "from")):
        at = h[f"{way}_at"]
        begin = at[first]
        out[f"{way}_at"], out[f"{way}_{to}"], out[f"{way}_w"] = at[first:] - begin, h[f"{way}_{to}"][begin:] - first, h[f"{way}_w"][begin:]
    return out


def sweep(h: dict, cost: np.ndarray) -> None:
    """Settle cost (places, fields) in place: from its labels to all places."""
    live = np.isfinite(cost).any(1)
    at, to, w = h["up_at"], h["up_to"], h["up_w"][:, None]
    for k in np.arange(len(cost)):
        i, j = at[k], at[k + 1]
        if live[k] and j > i:
            t = to[i:j]
            cost[t] = np.minimum(cost[t], cost[k] + w[i:j])
            live[t] = True
    at, of, w = h["down_at"], h["down_from"], h["down_w"][:, None]
    for k in range(len(cost) - 1, -1, -1):
        i, j = at[k], at[k + 1]
        if j > i:
            np.minimum(cost[k], (cost[of[i:j]] + w[i:j]).min(0), out=cost[k])


_ARRAYS = {"order": np.int64, **_KINDS}
CROSS = {"cross_at": np.int32, "cross_to": np.int64, "cross_tile": np.int64, "cross_w": np.float64}
#: A contracted tile as a row; tiles across the border go by their number in `tiles`.
ROW = "weight_id string, tile string, whole boolean, n_border int, tiles array<string>, " + ", ".join(f"{k} binary" for k in (*_ARRAYS, *CROSS))


def contract_tile(edges: pd.DataFrame) -> pd.DataFrame:
    """Two rows for the edges (weight_id, tile, src, dst, w, inner, to_tile) and entries (src = dst, inner null: a node at which edges of other tiles end) of one tile: the
    whole contraction, and its border's part with the edges that leave."""
    entry = edges["inner"].isna()
    inner = (edges["inner"] == True).to_numpy()  # noqa: E712
    names = np.unique(np.concatenate([edges["src"].to_numpy(np.int64), edges["dst"].to_numpy(np.int64)[inner]]))
    crossing = ~inner & ~entry.to_numpy()
    border = np.zeros(len(names), bool)
    border[np.searchsorted(names, edges["src"].to_numpy(np.int64)[crossing | entry.to_numpy()])] = True
    src, dst = (np.searchsorted(names, edges[c].to_numpy(np.int64)[inner]) for c in ("src", "dst"))
    h = contract(len(names), src, dst, edges["w"].to_numpy(float)[inner], border)
    n_border = int(border.sum())
    first = len(names) - n_border
    place = np.empty(len(names), np.int64)
    place[h["order"]] = np.arange(len(names))
    out = edges[crossing]
    at = place[np.searchsorted(names, out["src"].to_numpy(np.int64))] - first
    by = np.argsort(at, kind="stable")
    tiles, number = np.unique(out["to_tile"].to_numpy(str), return_inverse=True)
    cross = {"cross_at": np.searchsorted(at[by], np.arange(n_border + 1)), "cross_to": out["dst"].to_numpy(np.int64)[by], "cross_tile": number[by] if len(out) else [], "cross_w": out["w"].to_numpy(float)[by]}
    rows = []
    for whole in (True, False):
        now = h if whole else part(h, first)
        row = {"weight_id": edges["weight_id"].iloc[0], "tile": edges["tile"].iloc[0], "whole": whole, "n_border": n_border, "tiles": tiles.tolist()}
        row |= {k: np.asarray(now[k] if k != "order" else names[now[k]], t).tobytes() for k, t in _ARRAYS.items()}
        rows.append(row | {k: np.asarray(cross[k], t).tobytes() for k, t in CROSS.items()})
    return pd.DataFrame(rows)


def opened(tile: dict) -> dict:
    """read_row of a tile, once for all that use it."""
    if "opened" not in tile:
        tile["opened"] = read_row(tile)
    return tile["opened"]


def read_row(row: pd.Series) -> dict:
    return {k: np.frombuffer(row[k], t) for k, t in (_ARRAYS | CROSS).items()} | {"tiles": list(row["tiles"]), "n_border": row["n_border"]}


def start(h: dict, labels: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost, fields, which labels are places of h) with the least of the labels (arrays field, node, cost) at each place."""
    field, node, given = (np.asarray(labels[c]) for c in ("field", "node", "cost"))
    fields, f = np.unique(field, return_inverse=True)
    by = np.argsort(h["order"], kind="stable")
    at = np.searchsorted(h["order"], node, sorter=by)
    at = by[np.minimum(at, len(by) - 1)]
    known = h["order"][at] == node
    cost = np.full((len(h["order"]), len(fields)), np.inf)
    np.minimum.at(cost.ravel(), at[known] * len(fields) + f[known], given[known])
    return cost, fields, known
