"""The k best (score, id) of many rankings at once, kept by a task while it passes over slabs."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).min


class Best:
    """Per ranking the k highest scores, ties to smaller ids; integer scores, so equal means equal."""

    def __init__(self, rankings: int, k: int):
        self.k = k
        self.scores = np.full((rankings, k), NONE)
        self.ids = np.zeros((rankings, k), np.int64)

    def kth(self) -> np.ndarray:
        """The weakest kept score per ranking; NONE while a place is free."""
        return self.scores[:, -1]

    def offer(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Offer every ranking in ``which`` the candidates ``ids`` with its row of ``scores``, where ``allowed``."""
        s = np.where(allowed & (scores >= self.kth()[which][:, None]), scores, NONE)
        if s.shape[1] > self.k:  # only what can be among the k best of this offer, ties included
            s[s < np.partition(s, -self.k, axis=1)[:, -self.k, None]] = NONE
        r, c = np.nonzero(s > NONE)
        if not len(r):
            return
        touched = np.unique(r)
        old, place = np.nonzero(self.scores[which[touched]] > NONE)
        ranking = np.concatenate([which[r], which[touched[old]]])
        score = np.concatenate([s[r, c], self.scores[which[touched[old]], place]])
        name = np.concatenate([ids[c], self.ids[which[touched[old]], place]])
        order = np.lexsort((name, -score, ranking))
        ranking, score, name = ranking[order], score[order], name[order]
        at = np.arange(len(ranking)) - np.searchsorted(ranking, ranking)
        keep = at < self.k
        self.scores[ranking[keep], at[keep]] = score[keep]
        self.ids[ranking[keep], at[keep]] = name[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ranking, score, id) of everything kept."""
        r, c = np.nonzero(self.scores > NONE)
        return r, self.scores[r, c], self.ids[r, c]
