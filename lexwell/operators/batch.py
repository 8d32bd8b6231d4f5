"""Batches of queries over a packed index: queries are dealt to tasks, and a task finds the whole page of each of its queries.

Nothing of a query but its page leaves the task, so neither matches nor candidates are written or shuffled. Ranks are those
of ``recall`` and ``rank``: BM25 of the any-term and the strict pass, substrings, tiers, pool, fuzzy blend, boost, page.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwell.functions.fuzzy import longest_common
from lexwell.functions.snippet import build_snippet
from lexwell.functions.text import TERM, fold, fold_terms
from lexwell.operators.packed import MORE, PackedIndex, fold_low, gap, read_file
from lexwell.operators.rank import BOOST, FUZZY_SHARE
from lexwell.operators.recall import B, DIGITS, K1, LEAST_IDF
from lexwell.plans.match import query_tokens
from lexwell.schema import QueryOptions
from lexwell.sources.shipping import ship

CACHED = 96 << 20  # bytes of lists a worker keeps decoded; beyond it starts anew
ROWS_OUT = 20_000
CLOSE = 1e-8  # sums that differ by less may be equal when rounded
_PAGE = "query_id bigint, position int, doc_id string, metadata string, score double, tier int, snippet string"
_PAGE_ARROW = pa.schema(
    [("query_id", pa.int64()), ("position", pa.int32()), ("doc_id", pa.string()), ("metadata", pa.string()), ("score", pa.float64()), ("tier", pa.int32()), ("snippet", pa.string())]
)
_opened: dict[str, "Reader"] = {}


class Lists:
    """One file of posting lists."""

    def __init__(self, table: pa.Table) -> None:
        self.terms = table.column("term").combine_chunks()
        self.terms = self.terms.chunk(0) if isinstance(self.terms, pa.ChunkedArray) else self.terms
        chunk, size = (table.column(c).chunk(0) for c in ("chunk", "size"))
        self.at = np.frombuffer(chunk.buffers()[1], np.int32)
        self.chunk, self.size = chunk.values.to_numpy(zero_copy_only=False), size.values.to_numpy(zero_copy_only=False)
        self.places, self.counts = (table.column(c).chunk(0).buffers() for c in ("places", "counts"))
        self.places_at, self.counts_at = np.frombuffer(self.places[1], np.int64), np.frombuffer(self.counts[1], np.int64)

    def decoded(self, i: int, bases: np.ndarray, chunk_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.at[i], self.at[i + 1])
        places = np.frombuffer(self.places[2], np.uint16, (self.places_at[i + 1] - self.places_at[i]) // 2, self.places_at[i])
        counts = np.frombuffer(self.counts[2], np.uint8, self.counts_at[i + 1] - self.counts_at[i], self.counts_at[i])
        return places + np.repeat(bases[np.searchsorted(chunk_ids, self.chunk[part])], self.size[part]), counts.astype(np.int32)


class Grams:
    """The terms of one file by their trigrams."""

    def __init__(self, lists: Lists, table: pa.Table) -> None:
        self.gram = table.column("gram").combine_chunks().to_numpy(zero_copy_only=False)
        listed = table.column("term").chunk(0) if table.num_rows else None
        self.at = np.frombuffer(listed.buffers()[1], np.int64) if listed is not None else np.zeros(1, np.int64)
        self.term = listed.values.to_numpy(zero_copy_only=False) if listed is not None else np.zeros(0, np.int32)
        self.lists = lists

    def containing(self, run: str) -> np.ndarray:
        """Numbers of terms with the rarest trigram of a run of three characters or more; of all terms for a shorter one."""
        if len(run) < 3:
            return np.arange(len(self.lists.terms))
        best = None
        for i in range(len(run) - 2):
            code = np.uint64((ord(run[i]) << 42) | (ord(run[i + 1]) << 21) | ord(run[i + 2]))
            k = int(np.searchsorted(self.gram, code))
            if k == len(self.gram) or self.gram[k] != code:
                return np.zeros(0, np.int64)
            if best is None or self.at[k + 1] - self.at[k] < self.at[best + 1] - self.at[best]:
                best = k
        return self.term[self.at[best] : self.at[best + 1]]


def occurrences(text: str, part: str) -> int:
    """How often, overlaps counted."""
    n, at = 0, text.find(part)
    while at >= 0:
        n, at = n + 1, text.find(part, at + 1)
    return n


class Reader:
    """A packed index, as a worker sees it. Documents are numbered in the order of the chunks."""

    def __init__(self, index: PackedIndex) -> None:
        self.index = index
        self.chunks = [read_file(index.folder, name) for _, name in index.chunks]
        self.chunk_ids = np.array([c for c, _ in index.chunks], np.int64)
        self.bases = np.concatenate([[0], np.cumsum([c.num_rows for c in self.chunks])]).astype(np.int32)

        def whole(name: str, kind) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *(c.column(name).to_numpy() for c in self.chunks)]).astype(kind)

        self.n = int(self.bases[-1])
        self.rowid, self.plain = whole("rowid", np.int64), whole("plain", bool)
        k = K1 * (1 - B + B * whole("dl", np.float64) / (index.avg_dl or 1.0))
        self.length = {"text": k, "part": K1 * (1 - B + B * whole("tri", np.float64) / (index.avg_tri or 1.0))}
        self.doc_id, self.metadata = (
            pa.chunked_array([x for c in self.chunks for x in c.column(name).chunks], pa.string()) for name in ("doc_id", "metadata")
        )
        self.doc_id = self.doc_id.combine_chunks()
        self.place = np.empty(self.n, np.int32)  # in the order of the ids
        self.place[pc.sort_indices(self.doc_id).to_numpy()] = np.arange(self.n, dtype=np.int32)
        if self.chunks and "n_words" in self.chunks[0].column_names:
            self.n_words, self.letters = whole("n_words", np.int64), whole("letters", np.int64)
        self._starts = self.bases.tolist()
        self._texts, self._content = ([c.column(name).chunk(0) for c in self.chunks] for name in ("text", "has_content"))
        self._odd = {
            name: {int(base) + i: c.column(name)[i].as_py() for base, c in zip(self.bases, self.chunks) for i in np.flatnonzero(c.column(name).is_valid().to_numpy()).tolist()}
            for name in ("low", "folded")
        }
        self.streams: dict[str, list[Lists]] = {}
        self.grams: dict[str, list[Grams]] = {}
        by_file = {}
        for stream, name in index.lists:
            if "#" not in stream:
                by_file[name] = Lists(read_file(index.folder, name))
                self.streams.setdefault(stream, []).append(by_file[name])
        for stream, name in index.lists:
            if "#" in stream:
                kind, _, of = stream.partition("#")
                self.grams.setdefault(kind, []).append(Grams(by_file[of], read_file(index.folder, name)))
        self._more = {s: {t: (f, i) for f, x in enumerate(lists) for i, t in enumerate(x.terms.to_pylist())} for s, lists in self.streams.items() if s.endswith(MORE)}
        self._found: dict[tuple[str, str], tuple[int, int] | None] = {}
        self._kept: dict = {}
        self._bytes = 0
        self.sums, self.marks = np.zeros(self.n), np.zeros(self.n, bool)

    # Texts

    def _of(self, columns: list[pa.Array], doc: int):
        c = bisect_right(self._starts, doc) - 1
        return columns[c][doc - self._starts[c]].as_py()

    def text(self, doc: int) -> str:
        return self._of(self._texts, doc)

    def low(self, doc: int) -> str:
        return self._odd["low"][doc] if doc in self._odd["low"] else self.text(doc).lower()

    def folded(self, doc: int) -> str:
        return self._odd["folded"][doc] if doc in self._odd["folded"] else fold_low(self.low(doc))

    def content(self, doc: int) -> str | None:
        return self.text(doc) if self._of(self._content, doc) else None

    def words(self, doc: int) -> str:
        """The distinct words in order."""
        return " ".join(sorted(set(self.text(doc).split())))

    # Lists

    def resolve(self, stream: str, terms: set[str]) -> None:
        """Looks many terms up at once."""
        new = [t for t in terms if (stream, t) not in self._found] if stream in self.streams else []
        if len(self._found) > 1_000_000:
            self._found.clear()
        self._found |= {(stream, t): None for t in new}
        for f, lists in enumerate(self.streams[stream] if new else ()):
            for t, i in zip(new, pc.index_in(pa.array(new, pa.string()), value_set=lists.terms).to_pylist()):
                if i is not None:
                    self._found[stream, t] = f, i

    def keep(self, key, value: tuple, size: int):
        if self._bytes + size > CACHED:
            self._kept.clear()
            self._bytes = 0
        self._kept[key] = value
        self._bytes += size + 200
        return value

    def _decoded(self, stream: str, lists: Lists, i: int) -> tuple[np.ndarray, np.ndarray]:
        docs, counts = lists.decoded(i, self.bases, self.chunk_ids)
        if stream + MORE in self._more:
            if (at := self._more[stream + MORE].get(lists.terms[i].as_py())) is not None:
                more = self._decoded(stream + MORE, self.streams[stream + MORE][at[0]], at[1])
                counts[np.searchsorted(docs, more[0])] += more[1] * 256
        return docs, counts

    def postings(self, stream: str, term: str) -> tuple[np.ndarray, np.ndarray]:
        """(documents in order, counts) of a term."""
        if stream not in self.streams:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        if (stream, term) not in self._found:
            self.resolve(stream, {term})
        at = self._found[stream, term]
        return self._decoded(stream, self.streams[stream][at[0]], at[1]) if at is not None else (np.zeros(0, np.int32), np.zeros(0, np.int32))

    def shares(self, docs: np.ndarray, counts: np.ndarray, length: str = "text") -> np.ndarray:
        df, n = len(docs), self.index.n_docs
        idf = np.log((n - df + 0.5) / (df + 0.5))
        return (LEAST_IDF if idf <= 0 else idf) * (counts * (K1 + 1) / (counts + self.length[length][docs]))

    def weighed(self, stream: str, term: str, prefix: bool, pool: int) -> tuple[np.ndarray, np.ndarray, float, float]:
        """(documents, shares, the highest share, the one at the end of the pool or 0) of a phrase."""
        key = stream, term, prefix, pool
        if (known := self._kept.get(key)) is not None:
            return known
        docs, counts = self.begun(term) if prefix else self.postings(stream, term)
        share = self.shares(docs, counts.astype(np.float64)) if len(docs) else np.zeros(0)
        last = float(np.partition(share, len(share) - pool)[len(share) - pool]) if len(share) >= pool > 0 else 0.0
        return self.keep(key, (docs, share, float(share.max()) if len(share) else 0.0, last), docs.nbytes + share.nbytes)

    def begun(self, prefix: str) -> tuple[np.ndarray, np.ndarray]:
        """The documents with terms that begin with one or two characters, their counts summed."""
        if not 1 <= len(prefix) <= 2:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        matched = [(lists, np.flatnonzero(pc.starts_with(lists.terms, prefix).to_numpy(zero_copy_only=False)), None) for lists in self.streams.get("base", ())]
        return self._together("base", matched)

    def _together(self, stream: str, matched) -> tuple[np.ndarray, np.ndarray]:
        """The documents of many terms, with the sum of their counts, each times a weight."""
        parts = [(self._decoded(stream, lists, int(i)), 1 if times is None else times[j]) for lists, numbers, times in matched for j, i in enumerate(numbers)]
        if len(parts) == 1:
            (docs, counts), times = parts[0]
            return docs, counts * times
        for (docs, counts), times in parts:
            self.marks[docs] = True
            self.sums[docs] += counts * times
        docs = np.flatnonzero(self.marks).astype(np.int32)
        sums = self.sums[docs]
        self.marks[docs], self.sums[docs] = False, 0.0
        return docs, sums

    # Parts of texts

    def run_docs(self, stream: str, run: str, left: bool, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(documents, occurrences) of a run that may go on to the left and to the right."""
        if not left and not right:
            return self.postings(stream, run)
        key = stream, run, left, right
        if (known := self._kept.get(key)) is not None:
            return known
        matched = []
        for grams in self.grams.get(stream, ()):
            numbers = grams.containing(run)
            terms = grams.lists.terms.take(pa.array(numbers)).to_pylist()
            if left and right:
                times = [occurrences(t, run) for t in terms]
            else:
                times = [int(t.endswith(run) if left else t.startswith(run)) for t in terms]
            there = [j for j, k in enumerate(times) if k]
            matched.append((grams.lists, numbers[there], [times[j] for j in there]))
        docs, counts = self._together(stream, matched)
        return self.keep(key, (docs, counts), docs.nbytes + counts.nbytes)

    def part_docs(self, stream: str, part: str, runs: list[str], within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, occurrences) of a part, in documents the stream covers; ``within``: only these are wanted."""
        if len(runs) == 1 and runs[0] == part:
            docs, counts = self.run_docs(stream, part, True, True)
            if within is not None:
                there = self.among(within, docs)
                return within[there], np.ones(there.sum())
            return docs, counts
        docs = within
        opened = [(r, i == 0 and part.startswith(r), i == len(runs) - 1 and part.endswith(r)) for i, r in enumerate(runs)]
        sure = [x for x in opened if len(x[0]) > 2 or not (x[1] or x[2])] or opened
        for run, left, right in sorted(set(sure), key=lambda x: (x[1] or x[2], -len(x[0]))):
            found = self.run_docs(stream, run, left, right)[0]
            docs = found if docs is None else docs[self.among(docs, found)]
            if not len(docs):
                return docs, np.zeros(0)
        if docs is None:
            docs = np.arange(self.n, dtype=np.int32)
        for (a, open_a, _), (b, _, open_b) in zip(opened, opened[1:]):
            if (open_a and len(a) < 2) or (open_b and len(b) < 2):
                continue
            docs = docs[self.among(docs, self.run_docs(stream + "|", gap(a, b), False, False)[0])]
        of = self.low if stream == "low" else self.folded
        counts = np.array([occurrences(of(d), part) for d in docs.tolist()], np.float64)
        return docs[counts > 0], counts[counts > 0]

    def among(self, docs: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Which of ``docs`` are in ``others``, which is in order."""
        if not len(others):
            return np.zeros(len(docs), bool)
        at = np.minimum(np.searchsorted(others, docs), len(others) - 1)
        return others[at] == docs


class Search:
    def __init__(self, reader: Reader, query: QueryOptions, enable_fuzzy: bool, ranker) -> None:
        self.r, self.query, self.enable_fuzzy, self.ranker = reader, query, enable_fuzzy, ranker
        self.pool = query.candidate_pool_size
        self._strict: tuple = (None, None)
        self._any: tuple = (None, None)
        self._part: tuple = (None, None)

    def _best(self, docs: np.ndarray, sums: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The first of these documents by (rounded) sum and rowid, and their ranks."""
        if len(docs) > most:
            least = np.partition(sums, len(sums) - most)[len(sums) - most] if most else np.inf
            near = sums >= least - CLOSE
            docs, sums = docs[near], sums[near]
        rank = -np.round(sums, DIGITS)
        first = np.lexsort((self.r.rowid[docs], rank))[:most]
        return docs[first], rank[first]

    def strict(self, phrases) -> tuple[np.ndarray, np.ndarray]:
        """Documents with all whole base terms."""
        key = tuple(p for p in phrases if p[0] == "base" and not p[2])
        if self._strict[0] != key:
            lists = [self.r.weighed(*p, self.pool) for p in key]
            docs = min((x[0] for x in lists), key=len)
            for x in lists:
                docs = docs[self.r.among(docs, x[0])]
            sums = np.zeros(len(docs))
            for x in lists if len(docs) else ():
                sums += x[1][np.searchsorted(x[0], docs)]
            self._strict = key, self._best(docs, sums, self.pool)
        return self._strict[1]

    def any_term(self, phrases) -> tuple[np.ndarray, np.ndarray]:
        """Documents with any phrase. Only those that reach the share at the end of the pool of one phrase can be in the pool."""
        key = tuple(phrases)
        if self._any[0] != key:
            lists = sorted((x for p in key if len((x := self.r.weighed(*p, self.pool))[0])), key=lambda x: x[2])
            if len(lists) == 1:
                self._any = key, self._best(lists[0][0], lists[0][1], self.pool)
                return self._any[1]
            least = max((x[3] for x in lists), default=0.0) - CLOSE
            sums, bound, found = self.r.sums, 0.0, []
            for docs, share, _, _ in lists:
                sums[docs] += share
            for docs, share, most, _ in lists:
                bound += most
                if bound >= least:  # what is in no later list cannot reach it by lists up to one below
                    found.append(docs[sums[docs] >= least])
            docs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)
            totals = sums[docs]
            for x in lists:
                sums[x[0]] = 0.0
            self._any = key, self._best(docs, totals, self.pool)
        return self._any[1]

    def part(self, part: str, runs: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """All documents with a part in their lower-cased text, in order, and the best of them."""
        if self._part[0] != part:
            docs, counts = self.r.part_docs("low", part, runs)
            best = self._best(docs, self.r.shares(docs, counts.astype(np.float64), "part"), self.pool) if len(docs) else (docs, np.zeros(0))
            self._part = part, (docs, best)
        return self._part[1]

    def page(self, q: dict) -> tuple[np.ndarray, ...]:
        """(documents, scores, tiers, positions) of a query's page."""
        phrases = [(p["stream"], p["term"], p["is_prefix"]) for p in q["phrases"]]
        limit, offset = max(q["result_limit"] or 0, 0), max(q["result_offset"] or 0, 0)
        none = np.zeros(0, np.int32), np.zeros(0)
        strict = self.strict(phrases) if q["required"] > 0 else none
        loose = none if q["required"] > 0 and len(strict[0]) >= limit else self.any_term(phrases)
        hits, parts = self.part(q["part"], q["part_runs"]) if q["part"] is not None else (None, none)
        docs = np.concatenate([strict[0], loose[0], parts[0]])
        tier = np.repeat(np.array([0, 1], np.int8), [len(strict[0]), len(loose[0]) + len(parts[0])])
        rank = np.concatenate([strict[1], loose[1], parts[1]])
        distinct, at = np.unique(docs, return_inverse=True)
        if len(distinct) < len(docs):
            low_tier, low_rank = np.ones(len(distinct), np.int8), np.full(len(distinct), np.inf)
            np.minimum.at(low_tier, at, tier)
            np.minimum.at(low_rank, at, rank)
            docs, tier, rank = distinct, low_tier, low_rank
        first = np.lexsort((self.r.rowid[docs], rank, tier))[: self.pool]
        docs, tier, rank = docs[first], tier[first], rank[first]
        if not len(docs):
            return docs, rank, tier, docs
        low, high = rank.min(), rank.max()
        norm = np.ones(len(docs)) if high == low else (high - rank) / (high - low)
        plain = FUZZY_SHARE * self.fuzzy(docs, q["query_text"]) + (1 - FUZZY_SHARE) * norm if self.enable_fuzzy else norm
        score = np.round(np.where(self.exact(docs, q, hits), np.minimum(1.0, plain + BOOST), plain), DIGITS)
        kept = score >= self.query.min_score
        docs, tier, score = docs[kept], tier[kept], score[kept]
        order = np.lexsort((self.r.place[docs], -score, tier))[offset : offset + limit]
        return docs[order], score[order], tier[order], np.arange(offset + 1, offset + 1 + len(order))

    def exact(self, docs: np.ndarray, q: dict, hits: np.ndarray | None) -> np.ndarray:
        """Which texts contain the query, both folded. Texts that contain it unfolded do."""
        folded, runs = q["folded"], q["folded_runs"]
        if not folded:
            return np.zeros(len(docs), bool)
        out = self.r.among(docs, hits) if hits is not None else np.zeros(len(docs), bool)
        plain = self.r.plain[docs]
        for stream, of in (("low", plain), ("fold", ~plain)):
            if stream == "low" and hits is not None and folded == q["part"]:
                continue  # what a folded text of the first kind contains is known
            rest = np.flatnonzero(of & ~out)
            if len(rest):
                order = rest[np.argsort(docs[rest])]
                found = self.r.part_docs(stream, folded, runs, docs[order])[0]
                out[order] = self.r.among(docs[order], found)
        return out

    def fuzzy(self, docs: np.ndarray, query: str) -> np.ndarray:
        """Token-set scores of the texts, as ``TokenSet`` gives them, by the lists of words."""
        r = self.r
        if self.ranker is not None:
            return np.array([float(self.ranker(query, r.text(d))) for d in docs.tolist()])
        asked = sorted(set(query.split()))
        common = np.array([r.among(docs, self._with(w)) for w in asked]).reshape(len(asked), len(docs))
        sizes = np.array([len(w) for w in asked], np.int64)
        n_common, shared = common.sum(0), sizes @ common
        rest_a = sizes.sum() - shared + len(asked) - n_common - 1
        rest_b = r.letters[docs] - shared + r.n_words[docs] - n_common - 1
        n = np.where(n_common > 0, shared + n_common - 1, 0)
        same = np.where(n_common > 0, n + 1, 0)
        n_a, n_b = same + rest_a, same + rest_b
        whole = (n_common == len(asked)) | (n_common == r.n_words[docs])
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(n_common > 0, np.maximum(np.rint(200 * n / (n + n_a)), np.rint(200 * n / (n + n_b))), 0)
            most = np.rint(200 * np.minimum(n_a, n_b) / (n_a + n_b))
        ratio = np.where(whole, 100, least)
        for i in np.flatnonzero(~whole & (most > least)).tolist():
            left = " ".join(w for w, c in zip(asked, common[:, i]) if not c)
            right = r.words(int(docs[i]))
            if n_common[i]:
                gone = {w for w, c in zip(asked, common[:, i]) if c}
                right = " ".join(w for w in right.split(" ") if w not in gone)
            ratio[i] = max(least[i], _rounded(left, right, int(same[i]), int(n_a[i] + n_b[i])))
        return ratio / 100

    def _with(self, word: str) -> np.ndarray:
        key = "raw", word
        if (known := self.r._kept.get(key)) is None:
            docs = self.r.postings("raw", word)[0]
            known = self.r.keep(key, (docs,), docs.nbytes)
        return known[0]


def _rounded(a: str, b: str, same: int, total: int) -> int:
    """round(200 * (same + longest common subsequence) / total), which is computed only if simple bounds leave it open."""
    n, at = 0, -1
    for c in a:
        if (k := b.find(c, at + 1)) >= 0:
            n, at = n + 1, k
    lower = round(200 * (same + n) / total)
    if n == len(a) or lower == round(200 * (same + sum(c in b for c in a)) / total):
        return lower
    return round(200 * (same + longest_common(a, b)) / total)


def _searching(index: PackedIndex, query: QueryOptions, ranker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if index.folder not in _opened:
            _opened.clear()
            _opened[index.folder] = Reader(index)
        reader = _opened[index.folder]
        search = Search(reader, query, query.enable_fuzzy, ranker)
        held: list[tuple] = []
        rows = 0
        for batch in batches:
            listed = batch.to_pylist()
            wanted: dict[str, set[str]] = {}
            for q in listed:
                for p in q["phrases"]:
                    if not p["is_prefix"]:
                        wanted.setdefault(p["stream"], set()).add(p["term"])
                wanted.setdefault("low", set()).update(q["part_runs"] or ())
                wanted.setdefault("fold", set()).update(q["folded_runs"] or ())
                for stream, runs in (("low|", q["part_runs"] or ()), ("low|", q["folded_runs"]), ("fold|", q["folded_runs"])):
                    wanted.setdefault(stream, set()).update(map(gap, runs, runs[1:]))
                if query.enable_fuzzy:
                    wanted.setdefault("raw", set()).update(q["query_text"].split())
            for stream, terms in wanted.items():
                reader.resolve(stream, terms)
            for q in listed:
                docs, score, tier, position = search.page(q)
                if not len(docs):
                    continue
                snippets: list[str | None] = [None] * len(docs)
                if q["include_snippet"]:
                    tokens = query_tokens(q["query_text"])
                    snippets = [build_snippet(c, tokens, query.snippet) if (c := reader.content(d)) is not None else None for d in docs.tolist()]
                held.append((np.full(len(docs), q["query_id"], np.int64), position, docs, score, tier, snippets))
                rows += len(docs)
                if rows >= ROWS_OUT:
                    yield _batch(reader, held)
                    held, rows = [], 0
        if held:
            yield _batch(reader, held)

    return run


def _batch(reader: Reader, held: list[tuple]) -> pa.RecordBatch:
    query_id, position, docs, score, tier = (np.concatenate([h[i] for h in held]) for i in range(5))
    at = pa.array(docs)
    metadata = reader.metadata.take(at).combine_chunks()
    metadata = pa.concat_arrays(metadata.chunks) if isinstance(metadata, pa.ChunkedArray) else metadata
    columns = [query_id, position.astype(np.int32), reader.doc_id.take(at), metadata, score, tier.astype(np.int32), pa.array([s for h in held for s in h[5]], pa.string())]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=_PAGE_ARROW)


def search_packed(index: PackedIndex, plans: DataFrame, query: QueryOptions, ranker=None) -> DataFrame:
    """(query_id, position, doc_id, metadata, score, tier, snippet) of every plan's page. Equal queries come to the same task, one after the other."""
    spark = plans.sparkSession
    ship(spark)
    folded, run, zero = fold(F.col("query_text")), F.lit(TERM), F.lit(0)
    phrases = F.transform("phrases", lambda p: F.struct(p["stream"].alias("stream"), fold_terms(p["term"]).alias("term"), p["is_prefix"].alias("is_prefix")))
    asked = plans.select(
        "query_id", "query_text", "result_limit", "result_offset", "include_snippet", "required", "part", phrases.alias("phrases"),
        F.regexp_extract_all("part", run, zero).alias("part_runs"), folded.alias("folded"), F.regexp_extract_all(folded, run, zero).alias("folded_runs"),
    )
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.repartition(tasks, "query_text").sortWithinPartitions("query_text", "required", "result_limit")
    return dealt.mapInArrow(_searching(index, query, ranker), _PAGE)
