"""Blocks between two genomes found with the hits of the whole pair in one place, against which the table operations are tested."""

from __future__ import annotations

import numpy as np
import pandas as pd
from synblock.operators import spatial
from synblock.operators.chain import chains
from synblock.operators.synteny import Settings


def _dense(v):
    return pd.Series(v).rank(method="dense").to_numpy()


def _rerank(df: pd.DataFrame, by: list[str] | None = None) -> pd.DataFrame:
    if by is None:
        return df.assign(o1=_dense(df["ord1"].to_numpy()), o2=_dense(df["ord2"].to_numpy()))
    g = df.groupby(by, sort=False)
    return df.assign(o1=g["ord1"].rank(method="dense"), o2=g["ord2"].rank(method="dense"))


def _per(df: pd.DataFrame, by: list[str], f) -> np.ndarray:
    """A whole number per row from ``f`` of each group, 0 as "none", made unique over groups."""
    out, base = np.zeros(len(df), np.int64), 0
    for rows in df.groupby(by, sort=True).indices.values():
        k = np.asarray(f(df.iloc[rows]))
        out[rows] = np.where(k > 0, k + base, 0)
        base += int(k.max(initial=0))
    return out


def _near(df: pd.DataFrame, anchors: pd.DataFrame, radius: float, by: tuple[str, ...] = ("chr1", "chr2")) -> tuple[np.ndarray, np.ndarray]:
    """For each row, whether an anchor of its group is within ``radius`` and which is the nearest (-1: none)."""
    hit, nearest = np.zeros(len(df), bool), np.full(len(df), -1, np.int64)
    theirs = anchors.groupby(list(by), sort=True).indices
    for key, rows in df.groupby(list(by), sort=True).indices.items():
        if key not in theirs:
            continue
        a = theirs[key]
        x, y, ax, ay = (d["o1" if i == 0 else "o2"].to_numpy(float)[r] for d, r in ((df, rows), (anchors, a)) for i in (0, 1))
        p, q = spatial.neighbour_lists(x, y, radius, ax, ay)
        if not len(p):
            continue
        d2 = (x[p] - ax[q]) ** 2 + (y[p] - ay[q]) ** 2
        order = np.lexsort((q, d2, p))
        first = np.r_[True, p[order][1:] != p[order][:-1]]
        at = order[first]
        hit[rows[p[at]]], nearest[rows[p[at]]] = True, a[q[at]]
    return hit, nearest


def _in_boxes(df: pd.DataFrame, anchors: pd.DataFrame, label: str) -> np.ndarray:
    """The least label whose anchors' bounding box holds a row, 0 if none does."""
    out = np.zeros(len(df), np.int64)
    if not len(anchors):
        return out
    boxes = anchors.groupby(["chr1", "chr2", label], sort=True).agg(a=("o1", "min"), b=("o1", "max"), c=("o2", "min"), d=("o2", "max")).reset_index().sort_values(label)
    rows_of = df.groupby(["chr1", "chr2"], sort=True).indices
    x, y = df["o1"].to_numpy(float), df["o2"].to_numpy(float)
    for r in boxes.itertuples():
        rows = rows_of.get((r.chr1, r.chr2))
        if rows is not None:
            held = (x[rows] >= r.a) & (x[rows] <= r.b) & (y[rows] >= r.c) & (y[rows] <= r.d) & (out[rows] == 0)
            out[rows[held]] = getattr(r, label)
    return out


def _runs(v: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)


def find_blocks(hits: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """``isAnchor``, ``isSyntenic``, ``blk`` and ``reg`` (0: none) for the hits of one pair of genomes."""
    hits = hits.sort_values(["ord1", "ord2", "ofID1", "ofID2"]).reset_index(drop=True)
    out = hits.assign(isAnchor=False, isSyntenic=False, blk=np.int64(0), reg=np.int64(0))
    able = ~hits["noAnchor"].astype(bool) & hits["isArrayRep1"].astype(bool) & hits["isArrayRep2"].astype(bool)
    if s.same_chromosomes:
        able &= hits["chr1"] == hits["chr2"]
    cull = _rerank(hits[able].assign(_row=np.flatnonzero(able)))
    # seeds: the best of each gene, in long chains
    seed = cull[cull["sameOG"].astype(bool)] if s.only_og else cull
    if len(seed) < s.block_size:
        return out
    tens = -(seed["bitScore"] / 10).round()
    keep = (tens.groupby(seed["ofID1"]).rank(method="dense") <= s.top1) & (tens.groupby(seed["ofID2"]).rank(method="dense") <= s.top2)
    seed = _rerank(seed[keep])
    pair = ["chr1", "chr2"]
    seed = seed[_per(seed, pair, lambda g: chains(g["o1"].to_numpy(), g["o2"].to_numpy(), s.seed_gaps, s.seed_size)) > 0]
    if len(seed) < s.block_size:
        return out
    seed = _rerank(seed)
    seed = seed.assign(blk=_per(seed, pair, lambda g: spatial.dbscan_kernel(g["o1"].to_numpy(), g["o2"].to_numpy(), s.radius, s.block_size)))
    seed = seed[seed["blk"] > 0]
    # what lies around the seeds, on the ranks of all hits of their chromosome pairs
    used = cull.merge(seed[pair].drop_duplicates(), on=pair).sort_values("_row")
    used = _rerank(used)
    seed = used.merge(seed[["_row", "blk"]], on="_row")
    hit, nearest = _near(used, seed, s.radius)
    used, nearest = used[hit].reset_index(drop=True), nearest[hit]
    used["blk"] = _in_boxes(used, seed, "blk")
    outside = (used["blk"] == 0) & used["sameOG"].astype(bool)
    used.loc[outside, "blk"] = seed["blk"].to_numpy()[nearest[outside.to_numpy()]]
    used = used[used["blk"] > 0]
    if len(used) < s.block_size:
        return out
    # anchors in each region: reciprocal best or same group, chained, then clustered by a shrinking radius
    best = lambda a: used.sort_values([a, "blk", "bitScore", "_row"], ascending=[True, True, False, True]).groupby(["blk", a], sort=False)["_row"].transform("first")
    recip = (best("ofID1").reindex(used.index) == used["_row"]) & (best("ofID2").reindex(used.index) == used["_row"])
    used = used[recip | used["sameOG"].astype(bool)]
    og = used["sameOG"].astype(bool)
    has = lambda a: og.groupby([used["blk"], used[a]]).transform("any")
    used = _rerank(used[og | ~(has("ofID1") | has("ofID2"))], ["blk"])
    core = used[_per(used, ["blk"], lambda g: chains(g["o1"].to_numpy(), g["o2"].to_numpy(), s.n_gaps, s.block_size)) > 0]
    hit, _ = _near(used, core, s.block_radius, ("chr1", "chr2", "blk"))
    used = used[hit]
    by = ["chr1", "chr2", "blk"]
    for eps in range(s.block_radius, s.block_size - 1, -1):
        if not len(used):
            return out
        used = _rerank(used, ["blk"])
        k = _per(used, by, lambda g, eps=eps: spatial.dbscan_kernel(g["o1"].to_numpy(), g["o2"].to_numpy(), eps, s.block_size))
        used = used.assign(_k=k)[k > 0]
        if s.only_og and len(used):
            used = used[used["sameOG"].astype(bool).groupby(used["_k"]).transform("any")]
    if not len(used):
        return out
    # runs along both axes keep interleaved blocks apart
    used = used.sort_values(["ord1", "ord2", "_row"])
    r1 = _runs(used["_k"].to_numpy())
    used = used.assign(_r1=r1).sort_values(["ord2", "ord1", "_row"])
    used = used.assign(_r2=_runs(used["_k"].to_numpy())).sort_values(["ord1", "ord2", "_row"])
    used["_part"] = used.groupby(["_k", "_r1", "_r2"], sort=False).ngroup()
    if s.only_og:
        used = used[used["sameOG"].astype(bool).groupby(used["_part"]).transform("any")]
    used = _rerank(used)
    new = np.zeros(len(used), bool)
    part = used["_part"].to_numpy()
    o1, o2 = used["o1"].to_numpy(), used["o2"].to_numpy()
    sub = np.zeros(len(used), np.int64)
    for rows in pd.Series(part).groupby(part).indices.values():
        for o in (o1, o2):
            at = rows[np.argsort(o[rows], kind="stable")]
            new[:] = False
            new[at[1:]] = np.diff(o[at]) > s.block_radius
            sub[at] = sub[at] * (len(at) + 1) + np.cumsum(new[at])
    used["blk"] = pd.Series(list(zip(part.tolist(), sub.tolist(), strict=True))).factorize()[0] + 1  # in order of appearance
    # regions: clusters of anchors, joined where they share a block; noise keeps its block's region
    k = _per(used, pair, lambda g: spatial.dbscan_kernel(g["o1"].to_numpy(), g["o2"].to_numpy(), s.block_radius, s.block_size))
    nb = int(used["blk"].max())
    root = spatial.union_find(nb + 1 + int(k.max(initial=0)) + 1, used["blk"].to_numpy()[k > 0], nb + k[k > 0])
    used["reg"] = pd.factorize(root[used["blk"].to_numpy()])[0] + 1
    # all hits near an anchor, on their own ranks
    every = out.assign(o1=out["ord1"].astype(float), o2=out["ord2"].astype(float), _row=np.arange(len(out)))[able.to_numpy()].reset_index(drop=True)
    anchors = every.drop(columns=["blk", "reg"]).merge(used[["_row", "blk", "reg"]], on="_row")
    hit, _ = _near(every, anchors, s.block_radius)
    close = every[hit].reset_index(drop=True)
    close["blk"], close["reg"] = _in_boxes(close, anchors, "blk"), _in_boxes(close, anchors, "reg")
    _, nearest = _near(every, anchors, s.radius)
    add = every[(nearest >= 0) & every["sameOG"].astype(bool).to_numpy()].assign(_n=nearest[(nearest >= 0) & every["sameOG"].astype(bool).to_numpy()])
    add = add[~add["_row"].isin(close.loc[(close["blk"] > 0) | (close["reg"] > 0), "_row"])]
    for rows, blk, reg in ((close["_row"], close["blk"], close["reg"]), (add["_row"], anchors["blk"].to_numpy()[add["_n"]], anchors["reg"].to_numpy()[add["_n"]])):
        out.loc[rows.to_numpy(), "blk"], out.loc[rows.to_numpy(), "reg"] = np.asarray(blk), np.asarray(reg)
    out.loc[used["_row"].to_numpy(), "isAnchor"] = True
    out.loc[used["_row"].to_numpy(), ["blk", "reg"]] = used[["blk", "reg"]].to_numpy()
    out["isSyntenic"] = (out["blk"] > 0) | (out["reg"] > 0)
    return out


def find_self(hits: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """A genome against itself: every gene is its own anchor, a chromosome its own block."""
    out = hits.sort_values(["ord1", "ord2", "ofID1", "ofID2"]).reset_index(drop=True).assign(isAnchor=False, isSyntenic=False, blk=np.int64(0), reg=np.int64(0))
    own = (out["ofID1"] == out["ofID2"]).to_numpy()
    same = (out["chr1"] == out["chr2"]).to_numpy()
    e = out.assign(o1=out["ord1"].astype(float), o2=out["ord2"].astype(float))
    hit, _ = _near(e, e[own], s.radius)
    span = e.groupby("chr1")["ord1"].transform("max") - e.groupby("chr1")["ord1"].transform("min")
    within = same & (hit | (span <= s.radius).to_numpy())
    chromosome = out["chr1"].factorize()[0] + 1
    out["isAnchor"], out["isSyntenic"] = own, within
    out["blk"] = out["reg"] = np.where(within, chromosome, 0)
    return out


def masked(df: pd.DataFrame, first: pd.DataFrame, radius: float, s: Settings) -> pd.DataFrame:
    e = first.assign(o1=first["ord1"].astype(float), o2=first["ord2"].astype(float))
    hit, _ = _near(e, e[e["isAnchor"]], radius)
    again = find_blocks(df.sort_values(["ord1", "ord2", "ofID1", "ofID2"]).reset_index(drop=True)[~hit], s)
    low, low_r = int(first["blk"].max()), int(first["reg"].max())
    again.loc[again["blk"] > 0, "blk"] += low
    again.loc[again["reg"] > 0, "reg"] += low_r
    return pd.concat([first[hit], again], ignore_index=True)


def slow_synteny(hits: pd.DataFrame, base: Settings, ploidy: dict[str, int], secondary: Settings | None) -> pd.DataFrame:
    out = []
    for (g1, g2), df in hits.groupby(["genome1", "genome2"]):
        p1, p2 = ploidy.get(g1, 1), ploidy.get(g2, 1)
        if g1 == g2:
            found = find_self(df, base)
            if p1 > 1:
                found = masked(df, found, 2 * base.buffer, Settings(**{**base.__dict__, "top1": p1 - 1, "top2": p1 - 1}))
        else:
            found = find_blocks(df, Settings(**{**base.__dict__, "top1": p2, "top2": p1}))
            if secondary is not None:
                found = masked(df, found, base.buffer, secondary)
        for c, sep, name in (("blk", ": ", "blkID"), ("reg", ": ", "regID")):
            found[name] = [f"{g1}_vs_{g2}{sep}{k}" if k else None for k in found[c]]
        out.append(found)
    return pd.concat(out, ignore_index=True)
