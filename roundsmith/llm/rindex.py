"""A run-length index: run-compressed Burrows-Wheeler transform with sampled run ends.

Built over many short segments, each ending in a separator that sorts by segment. Kept are the runs of
the transform, the suffix at the first and last place of each run, and for each 50-byte class the least
owner of a segment that holds it. Matching statistics of many queries are streamed in step, from right
to left: a pointer follows the runs by LF; where the next byte differs, it moves to the nearest run of
that byte before or after, whichever suffix (a run-end sample) shares the longer prefix.
"""

from __future__ import annotations

import numpy as np


#: Symbols whose nine bits each fit one integer: the width of the first ranks.
FIRST = 7


def rolling(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Index of each byte of the spans, one span after another."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + at


class RunLengthIndex:
    def __init__(self, data: np.ndarray, lengths: np.ndarray, owners: np.ndarray, span: int = 50):
        """data: the bytes of all segments, joined; owners: one number for each segment."""
        if span < FIRST:
            raise ValueError(f"span must be at least {FIRST}")
        self.span = span
        n_seg = len(lengths)
        n = len(data) + n_seg
        text = np.zeros(n + 2 * span, np.int16)
        first = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        text[rolling(first, lengths)] = data.astype(np.int16) + 1
        self.text, self.n = text, n
        rank, at_span = self._ranks(n, int(lengths.max(initial=0)))
        sa = np.argsort(rank, kind="stable")
        bwt = text[sa - 1]
        bwt[sa == 0] = 0
        heads = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        tails = np.append(heads[1:], n) - 1
        char = bwt[heads].astype(np.int64)
        #: Runs in order of (byte, place): key, head, tail, samples, and occurrences of the byte before it.
        order = np.lexsort((heads, char))
        self.run_key = char[order] * (n + 1) + heads[order]
        self.run_head, self.run_tail, self.run_char = heads[order], tails[order], char[order]
        self.head_sa, self.tail_sa = sa[heads[order]], sa[tails[order]]
        size = self.run_tail - self.run_head + 1
        self.run_before = np.cumsum(size) - size  # C[byte] + rank: the order by byte makes them one sum
        self.n_runs, self.sa0 = len(heads), int(sa[0])
        # least owner of each class of equal spans
        own = np.repeat(owners, lengths + 1)
        inside = at_span >= 0
        self.least = np.full(n + 1, np.iinfo(np.int64).max)
        if inside.any():
            cls = at_span[inside]
            least = np.full(int(cls.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, cls, own[inside])
            self.least[:n][inside] = least[cls]

    def _ranks(self, n: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of all suffixes, cut at their separators and then in order of segment; and the class of
        the span that starts at each place, -1 if it is not within a segment."""
        text = self.text
        sep = np.flatnonzero(text[:n] == 0)
        left = sep[np.searchsorted(sep, np.arange(n))] - np.arange(n)  # bytes up to the separator
        # the first symbols make the first ranks
        key, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(FIRST):
            symbol = text[k : n + k]
            key = key << 9 | np.where(alive, symbol, 0)
            alive &= symbol != 0
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        del key, alive
        width, at_span = FIRST, np.full(n, -1)
        while True:
            if width <= self.span < 2 * width:
                off = self.span - width
                at = np.flatnonzero(left >= self.span)
                at_span[at] = np.unique(rank[at] * (n + 2) + rank[at + off], return_inverse=True)[1]
            if width >= longest + 1:
                return rank, at_span
            nxt = np.zeros(n, np.int64)
            more = left >= width
            nxt[more] = rank[np.flatnonzero(more) + width]
            _, rank = np.unique(rank * (n + 2) + nxt, return_inverse=True)
            rank = rank.astype(np.int64) + 1
            width *= 2

    def _shared(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes p and q, up to the span."""
        steps = np.arange(self.span)
        a, b = self.text[p[:, None] + steps], self.text[q[:, None] + steps]
        differ = (a != b) | (a == 0)
        return np.where(differ.any(axis=1), differ.argmax(axis=1), self.span)

    def matching(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Yields, from the last place of the queries to the first, (queries, places, matched lengths up
        to the span, text places): the matching statistics of all queries, streamed in step."""
        k = len(starts)
        rank_at, place, length = np.zeros(k, np.int64), np.full(k, self.sa0), np.zeros(k, np.int64)
        order = np.argsort(-lengths, kind="stable")
        sorted_len = -lengths[order]
        for back in range(int(lengths.max(initial=0))):
            live = order[: np.searchsorted(sorted_len, -back, "left")]
            at = starts[live] + lengths[live] - 1 - back
            c = data[at].astype(np.int64) + 1
            q, p, ln = rank_at[live], place[live], length[live]
            run = np.searchsorted(self.run_key, c * (self.n + 1) + q, "right") - 1
            before = (run >= 0) & (self.run_char[run] == c)
            hit = before & (self.run_tail[run] >= q)
            nxt = np.minimum(run + 1, self.n_runs - 1)
            after = (run + 1 < self.n_runs) & (self.run_char[nxt] == c)
            new_q = np.where(hit, self.run_before[run] + q - self.run_head[run], 0)
            new_p = np.where(hit, p - 1, self.sa0)
            new_len = np.where(hit, np.minimum(ln + 1, self.span), 0)
            miss = np.flatnonzero(~hit & (before | after))
            if len(miss):
                up, down = np.full(len(miss), -1), np.full(len(miss), -1)
                b, a = before[miss], after[miss]
                r, s = run[miss], nxt[miss]
                up[b] = self._shared(p[miss][b], self.tail_sa[r[b]])
                down[a] = self._shared(p[miss][a], self.head_sa[s[a]])
                take_up = up >= down
                new_q[miss] = np.where(take_up, self.run_before[r] + self.run_tail[r] - self.run_head[r], self.run_before[s])
                new_p[miss] = np.where(take_up, self.tail_sa[r], self.head_sa[s]) - 1
                new_len[miss] = np.minimum(np.minimum(ln[miss], np.maximum(up, down)) + 1, self.span)
            rank_at[live], place[live], length[live] = new_q, new_p, new_len
            yield live, lengths[live] - 1 - back, new_len, new_p
