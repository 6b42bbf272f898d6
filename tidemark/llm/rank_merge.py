"""Pair merging by rank over batches of ragged symbol sequences, for byte-pair vocabularies.

All sequences of a batch lie end to end in one numpy array. In every step each sequence that still can merges its own
lowest-ranked pair at all its places, from the left, up to the first place after which a new pair doesn't rank behind
it; all sequences do so at the same time. That is the order in which the tokenizer libraries merge, so the result is
theirs, and a sequence of any length takes about as many steps as it has different ranks.
"""

from __future__ import annotations

import numpy as np

NEVER = np.int32(2**31 - 1)


class Merges:
    """Pairs of symbols with their rank and the symbol that they make."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray, symbols: int):
        key = left.astype(np.int64) * symbols + right
        order = np.argsort(key, kind="stable")
        self.symbols, self.key, self.rank, self.made = symbols, key[order], rank[order].astype(np.int32), made[order].astype(np.int32)
        # A pair is calm if every pair with the symbol that it makes ranks behind it.
        first = np.full(max(symbols, int(made.max(initial=0)) + 1), NEVER)
        np.minimum.at(first, left, rank.astype(np.int32))
        np.minimum.at(first, right, rank.astype(np.int32))
        self.calm = first[self.made] > self.rank

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in rank and made, or -1."""
        key = left.astype(np.int64) * self.symbols + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1).astype(np.int32)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged symbols of all sequences, end to end, and their lengths. Empty sequences stay empty."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(lengths)
        active = np.flatnonzero(lengths > 0)
        sym, size = symbols.astype(np.int32), lengths[active].astype(np.int64)
        if len(sym):
            place = np.full(len(sym), -1, np.int32)
            place[:-1] = self.find(sym[:-1], sym[1:])
            place[np.cumsum(size) - 1] = -1
            rank = np.where(place >= 0, self.rank[place], NEVER)
        while len(active):
            stop = np.cumsum(size)
            start = stop - size
            best = np.minimum.reduceat(rank, start)
            done = best == NEVER
            if done.any():
                for k, a, b in zip(active[done].tolist(), start[done].tolist(), stop[done].tolist(), strict=True):
                    out[k] = sym[a:b]
                keep = np.repeat(~done, size)
                sym, place, rank, active, size, best = sym[keep], place[keep], rank[keep], active[~done], size[~done], best[~done]
                if not len(active):
                    break
                stop = np.cumsum(size)
                start = stop - size
            hits = np.flatnonzero(rank == np.repeat(best, size))
            owner = np.searchsorted(stop, hits, "right")
            # Of places that follow each other every second one merges, since they overlap.
            run = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(hits) != 1]), np.arange(len(hits)), 0))
            chosen = (np.arange(len(hits)) - run) % 2 == 0
            at, owner = self.in_order(sym, place, best, start, stop, hits[chosen], owner[chosen])
            sym[at] = self.made[place[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            last = at + 2 >= stop[owner]
            after = np.where(last, -1, self.find(sym[at], sym[np.minimum(at + 2, len(sym) - 1)]))
            first = (at == start[owner]) | ~keep[at - 1]  # none before, or one that merged and knows its new neighbour
            before = np.where(first, -1, self.find(sym[np.maximum(at - 1, 0)], sym[at]))
            place[at], rank[at] = after, np.where(after >= 0, self.rank[after], NEVER)
            prior = at[~first] - 1
            place[prior], rank[prior] = before[~first], np.where(before[~first] >= 0, self.rank[before[~first]], NEVER)
            sym, place, rank, size = sym[keep], place[keep], rank[keep], size - np.bincount(owner, minlength=len(size))
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.array([len(x) for x in out], np.int64)

    def in_order(self, sym: np.ndarray, place: np.ndarray, best: np.ndarray, start: np.ndarray, stop: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of each sequence up to the first after whose merge a new pair doesn't rank behind the merged one."""
        risky = np.flatnonzero(~self.calm[place[at]])
        if not len(risky):
            return at, owner
        made, merged = self.made[place[at]], np.zeros(len(sym), np.int32)
        merged[at] = made + 1
        here, own, new = at[risky], owner[risky], made[risky]
        low = np.zeros(len(risky), bool)
        joined = (here >= start[own] + 2) & (merged[here - 2] > 0)
        left = np.where(joined, merged[here - 2] - 1, sym[here - 1])
        for pair, inside in ((self.find(left, new), here > start[own]), (self.find(new, sym[np.minimum(here + 2, len(sym) - 1)]), here + 2 < stop[own])):
            low |= inside & (pair >= 0) & (self.rank[pair] <= best[own])
        end = np.full(len(best), len(at))
        np.minimum.at(end, own[low], risky[low])
        keep = np.arange(len(at)) <= end[owner]
        return at[keep], owner[keep]
