"""The best documents of a block for many queries, from weights held as arrays: exact, by bounds on what is left to add."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A term that one document of so many of a block holds is kept as a row over all of them.
DENSE = 32
#: Terms whose bounds together are at most this share of a query's are looked up for the documents left only.
LAST = 0.1
#: Documents of which only the greatest score is looked at first.
GROUP = 64
#: Queries taken at a time.
CHUNK = 512
#: Room for rounding: what scores may differ by in single precision (a share of the bound, a term) and in the result's digits.
ROUNDING, SLACK = 2.5e-7, 1e-5


class Queries:
    """Terms of queries as arrays: those of query q lie in ``start[q]`` to ``start[q + 1]`` of ``term`` and ``times``.

    ``top`` has the best ``k`` scores that blocks gave so far, of the kept documents and of all; 0 where there are fewer.
    """

    def __init__(self, start: np.ndarray, term: np.ndarray, times: np.ndarray, k: int) -> None:
        self.start, self.term, self.times, self.k = start.astype(np.int64), term.astype(np.int64), times.astype(np.float64), k
        self.query = np.repeat(np.arange(len(start) - 1), np.diff(self.start))
        self.top = np.zeros((2, len(start) - 1, k), np.float32)

    def raise_top(self, which: int, query: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The k-th best score of each pair's query, these pairs counted."""
        order = np.lexsort((-score, query))
        q, s = query[order], score[order]
        found, begin = np.unique(q, return_index=True)
        at = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        few = at < self.k
        both = np.zeros((len(found), 2 * self.k), np.float32)
        both[:, : self.k] = self.top[which, found]
        both[np.searchsorted(found, q[few]), self.k + at[few]] = s[few]
        both.sort(axis=1)
        self.top[which, found] = both[:, self.k :]
        return self.top[which, query, 0]


class Block:
    """Documents ``0 … n - 1`` by the weights of their terms; the first ``kept`` of them take part in a second ranking of their own."""

    def __init__(self, n: int, kept: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int, k: int) -> None:
        self.kept = kept
        # Scores lie in two parts, each a table of groups by columns, filled up with documents without terms.
        sizes = [max(1, min(GROUP, m // (16 * k))) for m in (kept, n - kept)]
        self.shape = [(g, -(-m // g)) for g, m in zip(sizes, (kept, n - kept))]
        self.base, self.n = self.shape[0][0] * self.shape[0][1], sum(g * c for g, c in self.shape)
        key = term.astype(np.int64) * self.n + np.where(row < kept, row, row + (self.base - kept))
        order = np.argsort(key)
        self.key, self.weight = key[order], weight[order]
        self.row, self.light = self.key % max(1, self.n), self.weight.astype(np.float32)
        self.start = np.searchsorted(self.key, np.arange(terms + 1, dtype=np.int64) * self.n)
        held = np.diff(self.start)
        self.top = np.zeros(terms)
        if len(self.key):
            self.top[held > 0] = np.maximum.reduceat(self.weight, self.start[:-1][held > 0])
        common = np.flatnonzero((held > 0) & (held * DENSE >= n))
        self.dense_row = np.full(terms, -1, np.int64)
        self.dense_row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), np.float32)
        for i, t in enumerate(common.tolist()):
            at = slice(self.start[t], self.start[t + 1])
            self.dense[i, self.row[at]] = self.light[at]

    def best(self, q: Queries) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(query, row, score)``: among them are the ``k`` best of all documents and of the kept ones, but those that blocks before have beaten."""
        for low in range(0, len(q.start) - 1 if len(self.key) else 0, CHUNK):
            pairs = list(self._pairs(q, low, min(low + CHUNK, len(q.start) - 1)))
            if pairs:
                yield self._settled(q, pairs)

    def _pairs(self, q: Queries, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
        """The places that the best documents of the queries from ``low`` to ``high`` are among."""
        of = slice(q.start[low], q.start[high])
        bound = q.times[of] * self.top[q.term[of]]
        here = np.flatnonzero(bound > 0)
        here = here[np.lexsort((-bound[here], self.dense_row[q.term[of][here]] >= 0, q.query[of][here]))]
        query, term, bound, times = q.query[of][here] - low, q.term[of][here], bound[here], q.times[of][here].astype(np.float32)
        start = np.searchsorted(query, np.arange(high - low + 1))
        summed = np.concatenate([[0.0], np.cumsum(bound)])
        total = summed[start[1:]] - summed[start[:-1]]
        rest = summed[start[1:]][query] - summed[1:]  # what the terms behind this one can add
        dense = self.dense_row[term]
        n_first = np.bincount(query[(dense < 0) | (rest + bound > LAST * total[query])], minlength=high - low).tolist()
        steps = list(zip(dense.tolist(), times.tolist(), self.start[term].tolist(), self.start[term + 1].tolist()))
        slacks = (total * ROUNDING * (2 + np.diff(start)) + SLACK).tolist()
        starts, rest, floors = start.tolist(), rest.tolist(), q.top[:, low:high, 0].T.tolist()
        acc, flat, k = np.zeros(self.n, np.float32), self.dense.ravel(), q.k
        parts = [acc[: self.base].reshape(self.shape[0]), acc[self.base :].reshape(self.shape[1])]
        used = [p for p in parts if p.size]
        for i, ((floor, floor_all), slack) in enumerate(zip(floors, slacks)):
            a, b = starts[i], starts[i + 1]
            if a == b:
                continue
            mid = a + n_first[i]
            acc.fill(0)
            self._add(acc, steps[a:mid])
            tops = [p.max(axis=0) for p in used]
            known = floor
            if not floor and self.kept >= k and len(tops[0]) >= k:  # as many groups have a document that reaches this
                known = float(np.partition(tops[0], -k)[-k])
                some = self._reaching(parts[0], tops[0], known)
                if known and mid < b and len(some) * (b - mid) <= self.n:
                    score = acc[some] + times[mid:b] @ flat[dense[mid:b, None] * self.n + some]
                    known = float(np.partition(score, -k)[-k])
                known = max(0.0, known - slack)
            least = [known, max(known, floor_all)] if self.base else [max(known, floor_all)]
            left = rest[mid - 1] + slack if mid > a else rest[a] + bound[a] + slack
            found = [self._reaching(p, t, x - left) for p, t, x in zip(used, tops, least)]
            if sum(map(len, found)) * (b - mid) > self.n:  # nothing is told apart yet: the other terms for all documents
                self._add(acc, steps[mid:b])
                mid = b
                found = [self._reaching(p, p.max(axis=0), x - slack) for p, x in zip(used, least)]
            if self.base and len(found) > 1:
                found[1] = found[1] + self.base
            for x, f in zip(least, found):
                score = acc[f]
                if mid < b and len(f):
                    score += times[mid:b] @ flat[dense[mid:b, None] * self.n + f]
                f = f[(score > 0) & (score >= x - slack)]
                if len(f):
                    yield low + i, f

    def _add(self, acc: np.ndarray, steps: list[tuple[int, float, int, int]]) -> None:
        for dense, times, low, high in steps:
            if dense >= 0:
                acc += self.dense[dense] if times == 1 else self.dense[dense] * np.float32(times)
            else:
                acc[self.row[low:high]] += self.light[low:high] if times == 1 else self.light[low:high] * np.float32(times)

    @staticmethod
    def _reaching(part: np.ndarray, top: np.ndarray, least: float) -> np.ndarray:
        """Places in ``part`` of the scores of at least ``least``; ``top`` has the greatest of each column."""
        some = (top >= np.float32(least)).nonzero()[0]
        if len(some) * 4 > len(top):
            return (part.ravel() >= np.float32(least)).nonzero()[0]
        group, at = (part.take(some, axis=1) >= np.float32(least)).nonzero()
        return group * len(top) + some[at]

    def _exact(self, q: Queries, query: np.ndarray, place: np.ndarray) -> np.ndarray:
        n_terms = q.start[query + 1] - q.start[query]
        pair = np.repeat(np.arange(len(query)), n_terms)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n_terms) - n_terms, n_terms) + np.repeat(q.start[query], n_terms)
        key = q.term[at] * self.n + place[pair]
        order = np.argsort(key)  # looked up in order, which is faster
        key, pair, at = key[order], pair[order], at[order]
        found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[found] == key
        return np.bincount(pair[hit], q.times[at[hit]] * self.weight[found[hit]], len(query))

    def _settled(self, q: Queries, pairs: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs with scores in double precision, without those that are beaten.

        Of documents of one part that are equal in score, the first ``k`` are enough: ties go by document.
        """
        query, place = np.repeat([i for i, _ in pairs], [len(r) for _, r in pairs]), np.concatenate([r for _, r in pairs])
        score, other = self._exact(q, query, place), place >= self.base
        order = np.lexsort((place, score, other, query))
        query, place, score, other = query[order], place[order], score[order], other[order]
        new = np.concatenate([[True], (query[1:] != query[:-1]) | (other[1:] != other[:-1]) | (score[1:] != score[:-1])])
        few = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) < q.k
        query, place, score, other = query[few], place[few], score[few], other[few]
        least = q.raise_top(1, query, score)
        least[~other] = q.raise_top(0, query[~other], score[~other])
        good = score >= least * (1 - ROUNDING) - SLACK
        return query[good], np.where(other, place - (self.base - self.kept), place)[good], score[good]
