"""Running best matches: requests stay in a task's memory while candidates stream past them.

A search holds a block of requests and, for each, its best ``n`` candidates so far. ``meet`` takes the next candidates in any
order and batch size, so neither side is ever copied per block of the other within a task. Ranking is by score rounded to ``digits``,
then by id; ids may be numbers or strings.

Dense vectors are multiplied slice by slice. Where lists are full, products in single precision, whose error is bounded, show which pairs can enter
them, and only those are multiplied in doubles.

Sparse vectors are answered from an inverted index of the batch. Documents that share most of a request's heaviest terms set a first bound for its list.
A document loses for each term that it lacks: the term's share of the request's length, and the most that the term could add. It has one of the heaviest terms, and
is dropped as soon as it lost too much to reach the bound; only the others are multiplied.
Where that would be much of the index, terms are read in the order
of the most they can add, which is rare terms first, and a document that is not met yet is let in only while the terms left
could still lift it into the list. Past that point only met documents are looked up. The work follows the posting lists that are read, and the bound
grows as the stream goes on, so later batches are mostly skipped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SLICE_CELLS = 1 << 18  # keeps a slice of scores in the processor's cache
_EXACT_INTEGERS = 2.0**53
#: Candidates multiplied at once when lists are full.
_TILE_ITEMS = 2048
#: Scores in units of their last digit up to which a hundredth of a unit is well above the error of a product.
_MOST_ROUNDED = 1e12
#: Lengths of vectors whose products single precision holds, and its error per component and unit of length, doubled.
_MOST_SINGLE = 1e15
_SINGLE_ERROR = 2.0**-23
#: Documents that set the first bound of a sparse request, at most.
_FIRST = 256
#: A posting list of more than this share of the documents is also kept as a flag per document.
_LONG_LIST = 1 / 32
#: Left to rounding in bounds.
_SHORTER = 1 - 1e-9
#: So few documents are multiplied without a further look.
_FEW_LEFT = 32


def _flat(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def dense_rows(column, width: int) -> np.ndarray:
    """Rows of lists as a matrix."""
    flat = _flat(column)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), width)


def sparse_rows(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, terms, weights) of rows of structs of index and weight lists."""
    terms, weights = _flat(column).flatten()
    sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return offsets, terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64), weights.flatten().to_numpy(zero_copy_only=False)


class Search:
    """The part that dense and sparse vectors share: running lists, hidden pairs, ties."""

    def __init__(self, keys, n: int, digits: int, drop_self: bool, positive_only: bool):
        self.keys, self.n, self.scale = _flat(keys), n, 10.0**digits
        self.drop_self, self.positive_only = drop_self, positive_only
        self.hidden_rows, self.hidden_items = np.zeros(0, np.int64), None
        # the best so far, by request, rank and id; ``place`` points into ``pool``, the ids in use in ascending order
        self.pool, self.rows, self.place, self.score, self.order = None, *(np.zeros(0, t) for t in (np.int64, np.int64, float, float))
        self.least = np.full(len(self.keys), -np.inf)
        self.waiting: list[tuple] = []

    def offer(self, items, vectors) -> None:
        """``meet`` for pieces of any size: they wait until a chunk is full, or until the lists are asked for."""
        self.waiting.append((_flat(items), _flat(vectors)))
        if sum(len(x) for x, _ in self.waiting) >= self.chunk:
            self._meet_waiting()

    def _meet_waiting(self) -> None:
        pieces, self.waiting = self.waiting, []
        if pieces:
            self.meet(*(pa.concat_arrays(x) for x in zip(*pieces, strict=True)))

    def bound(self, scores) -> None:
        """Scores below which the lists are not asked for; null where there is none."""
        scores = pc.fill_null(_flat(scores), -np.inf).to_numpy(zero_copy_only=False)
        self.least = np.maximum(self.least, np.rint(scores * self.scale))

    def hide(self, keys, items) -> None:
        """Pairs that no list may contain."""
        rows = pc.fill_null(pc.index_in(_flat(keys), value_set=self.keys), -1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(rows >= 0)
        items = _flat(items).take(pa.array(known))
        self.hidden_items = items if self.hidden_items is None else pa.concat_arrays([self.hidden_items, items])
        self.hidden_rows = np.concatenate((self.hidden_rows, rows[known]))

    def _masked(self, items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(request, place in ``items``) of the pairs to leave out, by request."""
        rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if self.drop_self:
            own = pc.fill_null(pc.index_in(self.keys, value_set=items), -1).to_numpy(zero_copy_only=False)
            rows.append(np.flatnonzero(own >= 0))
            cols.append(own[own >= 0])
        if self.hidden_items is not None and len(self.hidden_items):
            at = pc.fill_null(pc.index_in(self.hidden_items, value_set=items), -1).to_numpy(zero_copy_only=False)
            rows.append(self.hidden_rows[at >= 0])
            cols.append(at[at >= 0])
        row, col = np.concatenate(rows), np.concatenate(cols).astype(np.int64)
        by_row = np.argsort(row, kind="stable")
        return row[by_row], col[by_row]

    def _merge(self, items: pa.Array, rows: np.ndarray, cols: np.ndarray, scores: np.ndarray) -> None:
        """Takes new pairs into the running lists; ``cols`` are places in ``items``."""
        order = np.rint(scores * self.scale)
        fits = order >= self.least[rows]
        if self.positive_only:
            fits &= order > 0
        if not fits.any():
            return
        rows, cols, scores, order = rows[fits], cols[fits], scores[fits], order[fits]
        used, cols = np.unique(cols, return_inverse=True)
        ids = items.take(pa.array(used))
        pool = ids if self.pool is None else pa.concat_arrays([self.pool, ids])
        by_id = pc.sort_indices(pool).to_numpy()
        rank = np.empty(len(by_id), np.int64)
        rank[by_id] = np.arange(len(by_id))
        old = 0 if self.pool is None else len(self.pool)
        rows = np.concatenate((self.rows, rows))
        place = np.concatenate((rank[self.place], rank[cols + old]))
        scores, order = np.concatenate((self.score, scores)), np.concatenate((self.order, order))
        sort = np.lexsort((place, -order, rows))
        rows, place, scores, order = rows[sort], place[sort], scores[sort], order[sort]
        first = np.searchsorted(rows, np.arange(len(self.keys) + 1))
        kept = np.arange(len(rows)) - first[rows] < self.n
        self.rows, place, self.score, self.order = rows[kept], place[kept], scores[kept], order[kept]
        used, self.place = np.unique(place, return_inverse=True)
        self.pool = pool.take(pa.array(by_id[used]))
        counts = np.bincount(self.rows, minlength=len(self.keys))
        full = np.flatnonzero(counts >= self.n)
        self.least[full] = self.order[np.cumsum(counts)[full] - 1]

    def best(self) -> pa.RecordBatch:
        """key, item, score, rank of every running list, best first."""
        self._meet_waiting()
        if self.pool is None:
            return None
        first = np.searchsorted(self.rows, np.arange(len(self.keys) + 1))
        rank = (np.arange(len(self.rows)) - first[self.rows] + 1).astype(np.int32)
        columns = [self.keys.take(pa.array(self.rows)), self.pool.take(pa.array(self.place)), pa.array(self.score), pa.array(rank)]
        return pa.RecordBatch.from_arrays(columns, ["key", "item", "score", "rank"])


class DenseSearch(Search):
    #: Candidates met together.
    chunk = 16_384

    def __init__(self, keys, vectors, width: int, n: int, **how):
        super().__init__(keys, n, **how)
        self.width, self.left = width, dense_rows(vectors, width)
        self.longest = np.sqrt((self.left**2).sum(axis=1).max(initial=0))
        self.single = self.left.astype(np.float32) if self.longest < _MOST_SINGLE else None

    def meet(self, items, vectors) -> None:
        items = _flat(items)
        if not len(items) or not len(self.keys):
            return
        by_id = pc.sort_indices(items)
        items, right = items.take(by_id), dense_rows(vectors, self.width)[by_id.to_numpy()].T
        hidden_row, hidden_col = self._masked(items)
        single = right.astype(np.float32) if self.single is not None and np.sqrt((right**2).sum(axis=0).max()) < _MOST_SINGLE else None
        # lists that are not full yet take a tile in full, and what they hold then is compared with twice as many candidates each time
        begin, end = 0, len(items) if np.isfinite(self.least).all() else min(len(items), _TILE_ITEMS)
        while begin < len(items):
            here = (hidden_col >= begin) & (hidden_col < end)
            some = None if single is None else single[:, begin:end]
            self._meet_part(items.slice(begin, end - begin), right[:, begin:end], some, hidden_row[here], hidden_col[here] - begin)
            begin, end = end, min(len(items), 2 * end)

    def _meet_part(self, items, right: np.ndarray, single: np.ndarray | None, hidden_row: np.ndarray, hidden_col: np.ndarray) -> None:
        longest = self._longest(right)
        # below this score nothing enters a full list; a hundredth of the last digit is left to rounding
        floor = (self.least - 0.51) / self.scale if longest * self.scale < _MOST_ROUNDED and np.isfinite(self.least).all() else None
        tile = len(items) if floor is None else _TILE_ITEMS
        step, found = max(1, _SLICE_CELLS // min(tile, len(items))), []
        for left in range(0, len(items), tile):
            here = (hidden_col >= left) & (hidden_col < left + tile)
            hidden_at, hidden_in, some = hidden_row[here], hidden_col[here] - left, right[:, left : left + tile]
            for start in range(0, len(self.left), step):
                low, high = np.searchsorted(hidden_at, [start, start + step])
                bound = None if floor is None else floor[start : start + step]
                asked, hidden = self.left[start : start + step], (hidden_at[low:high] - start, hidden_in[low:high])
                if bound is None or single is None:
                    rows, cols, scores = self._best_of(asked, some, *hidden, longest, bound)
                else:
                    rows, cols, scores = self._reaching(asked, some, self.single[start : start + step], single[:, left : left + tile], *hidden, longest, bound)
                found.append((rows + start, cols + left, scores))
        self._merge(items, *(np.concatenate(x) for x in zip(*found, strict=True)))

    def _reaching(self, left, right, left_single, right_single, hidden_row, hidden_col, longest: float, floor: np.ndarray):
        """(row, column, score) of the pairs that reach ``floor``; of a row with many, its best are ranked."""
        m, most = right.shape[1], 4 * min(self.n, right.shape[1])
        near = left_single @ right_single
        least = floor - ((self.width + 4) * _SINGLE_ERROR * longest + np.abs(floor) * _SINGLE_ERROR)
        near[hidden_row, hidden_col] = -np.inf
        at = np.flatnonzero((near >= least.astype(np.float32)[:, None]).ravel())
        rows, cols = at // m, at % m
        crowded = np.flatnonzero(np.bincount(rows, minlength=len(left)) > most)
        ranked = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(crowded):
            row_of = np.full(len(left), -1)
            row_of[crowded] = np.arange(len(crowded))
            here, few = row_of[hidden_row] >= 0, row_of[rows] < 0
            ranked = self._best_of(left[crowded], right, row_of[hidden_row[here]], hidden_col[here], longest)
            ranked, rows, cols = [crowded[ranked[0]], *ranked[1:]], rows[few], cols[few]
        scores = np.einsum("ij,ij->i", left[rows], right.T[cols])
        reach = scores >= floor[rows]
        return tuple(np.concatenate((own[reach], best)) for own, best in zip((rows, cols, scores), ranked, strict=True))

    def meet_groups(self, items, vectors, groups) -> None:
        """``meet``, but only the pairs of each (requests, places in ``items``) of ``groups``; merged once at the end."""
        items = _flat(items)
        if not len(items) or not len(self.keys):
            return
        by_id = pc.sort_indices(items).to_numpy()
        rank = np.empty(len(by_id), np.int64)
        rank[by_id] = np.arange(len(by_id))
        matrix, found = dense_rows(vectors, self.width), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        hidden_row, hidden_col = self._masked(items)
        for asked, places in groups:
            places = places[np.argsort(rank[places])]
            if not len(asked):
                continue
            inside = np.full(len(items), -1)
            inside[places] = np.arange(len(places))
            step = max(1, _SLICE_CELLS // len(places))
            for start in range(0, len(asked), step):
                some = asked[start : start + step]
                row_of = np.full(len(self.keys), -1)
                row_of[some] = np.arange(len(some))
                here = (row_of[hidden_row] >= 0) & (inside[hidden_col] >= 0)
                right = matrix[places].T
                rows, cols, scores = self._best_of(self.left[some], right, row_of[hidden_row[here]], inside[hidden_col[here]], self._longest(right))
                found.append((some[rows], places[cols], scores))
        self._merge(items, *(np.concatenate(x) for x in zip(*found, strict=True)))

    def _longest(self, right: np.ndarray) -> float:
        """No product with a column of ``right`` is larger."""
        return self.longest * np.sqrt((right**2).sum(axis=0).max())

    def _best_of(self, left: np.ndarray, right: np.ndarray, hidden_row: np.ndarray, hidden_col: np.ndarray, longest: float, floor: np.ndarray | None = None):
        """(row, column, score) of the best columns of each row, in no order; columns are in the order of their ids.

        Where every list is full and few scores reach ``floor``, those are all that may enter, and nothing is ranked here.
        """
        m, keep = right.shape[1], min(self.n, right.shape[1])
        scores = left @ right
        if floor is not None:
            reach = scores >= floor[:, None]
            reach[hidden_row, hidden_col] = False
            if np.count_nonzero(reach) <= 4 * keep * len(left):
                rows, cols = np.nonzero(reach)
                return rows, cols, scores[rows, cols]
        order = scores * self.scale
        np.rint(order, out=order)
        packed = (longest * self.scale + 1) * m < _EXACT_INTEGERS
        if packed:  # one exact number per cell: rounded score, then place in id order
            order *= m
            order -= np.arange(m, dtype=np.float64)
        order[hidden_row, hidden_col] = -np.inf
        if packed:
            cols = np.argpartition(order, m - keep, axis=1)[:, m - keep :]
        else:
            cols = np.argsort(-order, axis=1, kind="stable")[:, :keep]
        rows, cols = np.repeat(np.arange(len(scores)), keep), cols.ravel()
        shown = order[rows, cols] != -np.inf
        return rows[shown], cols[shown], scores[rows[shown], cols[shown]]


class Postings:
    """Inverted index of a batch of documents: per term the documents that have it, in order, and the largest weight."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        sizes = np.diff(offsets)
        docs = np.repeat(np.arange(len(sizes)), sizes)
        by_term = np.argsort(terms, kind="stable")
        self.docs, self.weights = docs[by_term], weights[by_term]
        self.terms, self.starts = np.unique(terms[by_term], return_index=True)
        self.ends = np.concatenate((self.starts[1:], [len(terms)]))
        self.most = np.maximum.reduceat(self.weights, self.starts) if len(self.starts) else np.zeros(0)
        self.size = len(sizes)
        # rows of the documents, with the places of their terms
        self.offsets, self.sizes, self.row_weights = offsets[:-1], sizes, weights
        self.row_terms = np.searchsorted(self.terms, terms)
        self.longest = math.sqrt(np.bincount(docs, weights**2, minlength=1).max())
        self.flags, self.scratch = {}, np.zeros(self.size, bool)

    def have(self, docs: np.ndarray, start: int, end: int) -> np.ndarray:
        """Whether documents have the term of these postings."""
        if end - start > self.size * _LONG_LIST:
            if start not in self.flags:
                self.flags[start] = np.zeros(self.size, bool)
                self.flags[start][self.docs[start:end]] = True
            return self.flags[start][docs]
        listed = self.docs[start:end]
        self.scratch[listed] = True
        found = self.scratch[docs]
        self.scratch[listed] = False
        return found

    def products(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Products of documents, which have terms, with a request's weights by place of term."""
        sizes = self.sizes[docs]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        at = np.arange(ends[-1]) + np.repeat(self.offsets[docs] - begins, sizes)
        return np.add.reduceat(asked[self.row_terms[at]] * self.row_weights[at], begins)


class SparseSearch(Search):
    """For rows of non-negative weights; only documents that share a term are listed."""

    chunk = 131_072

    def __init__(self, keys, vectors, width: int, n: int, **how):
        super().__init__(keys, n, **how)
        self.offsets, self.terms, self.weights = sparse_rows(vectors)
        #: Postings read and documents looked up, for tests of the pruning.
        self.work = 0

    def meet(self, items, vectors) -> None:
        items = _flat(items)
        if not len(items) or not len(self.keys):
            return
        by_id = pc.sort_indices(items)
        items, index = items.take(by_id), Postings(*sparse_rows(_flat(vectors).take(by_id)))
        if not len(index.terms):
            return
        hidden_row, hidden_col = self._masked(items)
        hidden_at = np.searchsorted(hidden_row, np.arange(len(self.keys) + 1))
        at = np.minimum(np.searchsorted(index.terms, self.terms), len(index.terms) - 1)
        known = index.terms[at] == self.terms
        most = np.where(known, self.weights * index.most[at], 0.0)
        start, end = index.starts[at].tolist(), index.ends[at].tolist()
        weight, sums, seen = self.weights.tolist(), np.zeros(index.size), np.zeros(index.size, np.int64)
        asked = np.zeros(len(index.terms))
        found = []
        reach = np.bincount(np.repeat(np.arange(len(self.keys)), np.diff(self.offsets)), most, minlength=len(self.keys))
        for r in np.flatnonzero(reach >= self.least / self.scale * _SHORTER - 1 / self.scale).tolist():
            own = np.arange(self.offsets[r], self.offsets[r + 1])
            own = own[most[own] > 0]
            if len(own):
                own = own[np.argsort(-most[own], kind="stable")]
                left = np.cumsum(most[own][::-1])[::-1].tolist()
                terms = [(start[t], end[t], weight[t], u, v) for t, u, v in zip(own.tolist(), left, most[own].tolist(), strict=True)]
                hidden = hidden_col[hidden_at[r] : hidden_at[r + 1]]
                asked[at[own]] = self.weights[own]
                heavy = sorted(terms, key=lambda t: -t[2])
                least = self._first_bound(r, heavy, index, asked, len(hidden))
                docs = self._reaching(least, heavy, index)
                if docs is None:
                    docs, scores = self._ask(least, terms, index, sums, seen, hidden)
                elif len(docs):
                    scores = index.products(docs, asked)
                    if len(hidden):
                        index.scratch[hidden] = True
                        scores[index.scratch[docs]] = 0.0
                        index.scratch[hidden] = False
                    docs, scores = self._few(docs, scores)
                asked[at[own]] = 0.0
                if not len(docs):
                    continue
                found.append((np.full(len(docs), r), docs, scores))
        if found:
            self._merge(items, *(np.concatenate(x) for x in zip(*found, strict=True)))

    def _first_bound(self, r, heavy, index, asked, hidden: int) -> float:
        """A score below which nothing enters the list of a request; one unit of the last digit, or two, are left to rounding."""
        unit, enough = 1 / self.scale, self.n + hidden  # hidden documents may be among the best
        least = self.least[r] * unit - unit
        if np.isfinite(least) or enough > _FIRST:
            return least
        docs = None
        for start, end, *_ in heavy:
            if docs is None:
                docs = index.docs[start:end] if end - start >= enough else None
            elif len(docs) > 2 * enough:
                some = docs[index.have(docs, start, end)]
                docs = some if len(some) >= enough else docs
        if docs is None:
            return least
        docs = docs[:_FIRST]
        self.work += len(docs)
        place = len(docs) - enough
        return max(least, float(np.partition(index.products(docs, asked), place)[place]) - 2 * unit)

    def _reaching(self, least: float, heavy, index):
        """Every document that can reach a score, or None if they are too many to multiply each.

        ``heavy`` are the terms by weight. A document has the first of them, or lacks it and has the second, and so on until those left are too little together.
        """
        if not least > 0:
            return None
        least *= _SHORTER
        length, most = sum(t[2] ** 2 for t in heavy), sum(t[4] for t in heavy)
        shortest, room, parts = (least / index.longest) ** 2, sum(t[1] - t[0] for t in heavy), []
        per_doc = len(index.row_terms) // index.size
        for k, first in enumerate(heavy):
            may_lose, may_miss = length - shortest, most - least
            if may_lose < 0 or may_miss < 0:
                break
            # terms that it cannot lack, by the length of their lists; then the others
            others = heavy[k + 1 :]
            needed = sorted([first, *(t for t in others if t[2] ** 2 > may_lose or t[4] > may_miss)], key=lambda t: t[1] - t[0])
            docs = index.docs[needed[0][0] : needed[0][1]]
            room -= len(docs)
            for start, end, *_ in needed[1:]:
                docs = docs[index.have(docs, start, end)]
            for start, end, *_ in heavy[:k]:
                docs = docs[~index.have(docs, start, end)]
            lost = missed = 0.0
            for start, end, weight, _, add in others:
                if len(docs) <= _FEW_LEFT:
                    break
                if weight**2 <= may_lose and add <= may_miss:
                    lacks = ~index.have(docs, start, end)
                    lost, missed = lost + lacks * weight**2, missed + lacks * add
                    stay = (lost <= may_lose) & (missed <= may_miss)
                    docs, lost, missed = docs[stay], lost[stay], missed[stay]
            room -= len(docs) * per_doc
            if room < 0:
                return None
            parts.append(docs)
            length -= first[2] ** 2
            most -= first[4]
        self.work += sum(map(len, parts))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _ask(self, least, terms, index, sums, seen, hidden):
        """(documents, scores) of one request: at least every document that its list may take.

        ``terms`` are (start and end of the postings, weight, most that this term and those after it can add, most that it can add alone).
        """
        unit = 1 / self.scale
        read, parts, met, known = 0, [], None, 0
        for start, end, weight, left, _ in terms:
            if left < least:
                break
            if end - start > known and known >= self.n:
                # a long list is next: see whether what is met already keeps new documents out
                met = self._distinct(parts, seen)
                parts, known = [met], len(met)
                # hidden documents may be among the best
                place = known - self.n - len(hidden)
                if place >= 0:
                    least = max(least, np.partition(sums[met], place)[place] - 2 * unit)
                    if left < least:
                        break
            docs = index.docs[start:end]
            sums[docs] += weight * index.weights[start:end]
            parts.append(docs)
            known += end - start
            read += 1
        met = self._distinct(parts, seen) if parts else np.zeros(0, np.int64)
        self.work += known
        docs = met
        for start, end, weight, left, _ in terms[read:]:
            # the terms that are left cannot bring a new document, only lift one that is met
            docs = docs[sums[docs] + left >= least]
            self.work += min(len(docs), end - start)
            if end - start > 16 * len(docs):
                listed = index.docs[start:end]
                place = np.minimum(np.searchsorted(listed, docs), len(listed) - 1)
                hit = listed[place] == docs
                sums[docs[hit]] += weight * index.weights[start:end][place[hit]]
            else:
                docs_here = index.docs[start:end]
                sums[docs_here] += weight * index.weights[start:end]
                parts.append(docs_here)
        sums[hidden] = 0.0
        scores = sums[docs]
        for part in (met, *parts):
            sums[part] = 0.0
        return self._few(docs, scores)

    def _few(self, docs, scores):
        """The best of many documents: of those that tie the first ids, as documents are in the order of their ids."""
        if len(docs) > 2 * self.n:
            order = np.rint(scores * self.scale)
            last = np.partition(order, len(order) - self.n)[len(order) - self.n]
            above, ties = np.flatnonzero(order > last), np.flatnonzero(order == last)
            ties = ties[np.argsort(docs[ties], kind="stable")[: self.n - len(above)]]
            fits = np.concatenate((above, ties))
            docs, scores = docs[fits], scores[fits]
        return docs, scores

    @staticmethod
    def _distinct(parts: list[np.ndarray], seen: np.ndarray) -> np.ndarray:
        if len(parts) == 1:
            return parts[0]
        every = np.concatenate(parts)
        places = np.arange(len(every))
        seen[every] = places
        return every[seen[every] == places]


def search_for(sparse: bool):
    return SparseSearch if sparse else DenseSearch
