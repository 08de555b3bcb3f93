"""Benchmark decontamination by a distributed positional inverted index.

The index holds the postings of every token of the training documents, so that
it is built once and any benchmark can be searched in it. It is dealt by
document: each stored row holds one document's postings, that is its distinct
terms (64-bit numbers of the words), how often each comes, and the positions of
each in ascending order. Posting lists of a shard are the rows of a batch laid
end to end, of which a search lays out only the terms it asks for. A window of
a test item is found by taking the list of its rarest term (the shortest list
over the whole corpus), moving it by the term's offset in the window, and
intersecting it with the moved lists of the next rarest terms. A phrase match
needs every term at its place; a proximity match needs the rarest few within
some words of their places.

Nothing is shuffled but the list lengths of the test terms. The test side is
taken in blocks of a bounded number of words, long items piece by piece, so
what is sent to executors is bounded however large the benchmark is; each
further block reads the index again, not the documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, frugal, parts
from tidemark.llm.shingles import word_numbers

WINDOW = 10
#: Words of a block of test items, and of a piece of a long item; they bound what an executor gets at once.
BLOCK_WORDS = 500_000
PIECE_WORDS = 20_000
#: A proximity match: so many rarest terms, each within so many words of its place.
NEAR_TERMS = 3
NEAR_WORDS = 5
#: Candidates that are checked at once.
_CHUNK = 2_000_000
#: Bytes of positions that a search lays out at once.
_LAID = 4 << 20

#: Bytes of words: digits, lower-case letters and everything outside ASCII; A-Z are lowered, the rest separates.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8; null has none."""
    return text.translate(_WORD_BYTES).split() if text else []


@dataclass
class TestTerms:
    """A block of test items: its vocabulary and its distinct windows."""

    vocabulary: np.ndarray  # the terms' 64-bit numbers, ascending
    items: np.ndarray  # the ids of its items
    windows: list[tuple[int, ...]]  # distinct windows, as places in the vocabulary
    owners: list[list[int]]  # for each window, the numbers of the items that have it

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]], window: int) -> "TestTerms":
        found: dict[tuple[int, ...], set[int]] = {}
        ids = sorted({i for i, _ in rows})
        number = {i: k for k, i in enumerate(ids)}
        words, first, count = word_numbers([t for _, t in rows], _WORD_BYTES)
        vocabulary, terms = np.unique(words, return_inverse=True)
        for (item, _), at, n in zip(rows, first.tolist(), count.tolist()):
            own = terms[at : at + n].tolist()
            for k in range(max(1, n - window + 1) if n else 0):
                found.setdefault(tuple(own[k : k + window]), set()).add(number[item])
        return cls(vocabulary, np.array(ids, dtype=np.int64), list(found), [sorted(x) for x in found.values()])


def _index(batches):
    """Texts to postings: distinct terms (u64), their counts and their positions (i4), little-endian, by term."""
    from pyspark import TaskContext

    uid = TaskContext.get().partitionId() << 40
    for batch in parts(batches, 1):
        n = batch.num_rows
        words, _, count = word_numbers(batch.column(1).to_pylist(), _WORD_BYTES)
        doc = np.repeat(np.arange(n), count)
        order = np.argsort(words, kind="stable")
        order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]  # a part has far fewer rows
        words, doc = words[order], doc[order]
        begins = np.cumsum(count) - count
        positions = (order - begins[doc]).astype("<i4")
        fresh = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])])) if len(words) else np.zeros(0, dtype=np.int64)
        per_doc = np.bincount(doc[fresh], minlength=n)
        counts = np.diff(np.concatenate([fresh, [len(words)]])).astype("<i4")
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(np.arange(uid, uid + n, dtype=np.int64)), pa.array(count.astype(np.int64)),
                _binary(words[fresh].astype("<u8"), per_doc), _binary(counts, per_doc), _binary(positions, count), *batch.columns[1:],
            ],
            names=["doc_id", "uid", "n_words", "terms", "counts", "positions", *batch.schema.names[1:]],
        )
        uid += n


def _binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Runs of ``values``, one for each row, as a binary column."""
    offsets = np.concatenate([[0], np.cumsum(lengths * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def build_index(docs: DataFrame, put, carry: bool = False) -> DataFrame:
    """Postings of every token of every document; one row per row of ``docs``, numbered by ``uid``.

    With ``carry`` the text comes along, and all columns of ``docs`` but a
    string ``text`` as a struct ``row``.
    """
    row = [F.struct(*(F.col(f"`{f.name}`") for f in docs.schema if f.name != "text" or f.dataType != T.StringType())).alias("row")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *row)
    kinds = T.StructType.fromDDL("doc_id long, uid long, n_words long, terms binary, counts binary, positions binary")
    for f in rows.schema.fields[1:]:
        kinds.add(f.name, f.dataType)
    found = rows.mapInArrow(frugal(_index), kinds)
    return put(found if carry else found.drop("text"))


def _joined(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _known(vocabulary: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the terms are in the vocabulary, and their places there."""
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    here = np.flatnonzero(vocabulary[at] == terms)
    return here, at[here]


def list_lengths(index: DataFrame, terms: TestTerms) -> np.ndarray:
    """The length of each test term's posting list over the corpus."""
    vocabulary, size = terms.vocabulary, len(terms.vocabulary)

    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in parts(batches, 0, _LAID) if size else ():
            here, at = _known(vocabulary, _joined(batch.column(0), "<u8"))
            total += np.bincount(at, weights=_joined(batch.column(1), "<i4")[here], minlength=size).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["term", "n"])

    out = np.zeros(size, dtype=np.int64)
    for r in index.select("terms", "counts").mapInArrow(frugal(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


@dataclass
class _Probe:
    """Windows of one length, their terms ordered from the rarest."""

    terms: np.ndarray  # windows x length
    offsets: np.ndarray
    number: np.ndarray  # of the window


def _probes(terms: TestTerms, lengths: np.ndarray) -> list[_Probe]:
    out = []
    for n in sorted({len(w) for w in terms.windows}):
        number = np.array([k for k, w in enumerate(terms.windows) if len(w) == n], dtype=np.int64)
        window = np.array([terms.windows[k] for k in number], dtype=np.int64)
        alive = (lengths[window] > 0).any(axis=1)
        window, number = window[alive], number[alive]
        order = np.argsort(lengths[window], axis=1, kind="stable")
        out.append(_Probe(np.take_along_axis(window, order, axis=1), order, number))
    return out


class _Lists:
    """The test terms' posting lists of a batch (n_words, terms, counts, positions): term by term, positions ascending over all its documents."""

    def __init__(self, batch: pa.RecordBatch, vocabulary: np.ndarray, gap: int):
        n_words = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(n_words + gap)])
        self.span = int(self.starts[-1]) + gap + 1
        entries, counts, positions = (_joined(batch.column(k), d) for k, d in ((1, "<u8"), (2, "<i4"), (3, "<i4")))
        doc = np.repeat(np.arange(batch.num_rows), np.fromiter((len(t) // 8 for t in batch.column(1).to_pylist()), dtype=np.int64, count=batch.num_rows))
        here, term = _known(vocabulary, entries) if len(vocabulary) else (np.zeros(0, dtype=np.int64),) * 2
        first, n = (np.cumsum(counts, dtype=np.int64) - counts)[here], counts[here].astype(np.int64)
        place = positions[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)] + np.repeat(self.starts[doc[here]], n)
        self.keys = np.sort(np.repeat(term, n) * self.span + place)

    def bounds(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.keys, term * self.span), np.searchsorted(self.keys, (term + 1) * self.span)

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the terms' lists have these places."""
        key = term * self.span + place
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key

    def has_near(self, term: np.ndarray, place: np.ndarray, within: int) -> np.ndarray:
        low = term * self.span + np.maximum(place - within, 0)
        at = np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)
        return (self.keys[at] >= low) & (self.keys[at] <= term * self.span + place + within)


def _searcher(vocabulary: np.ndarray, probes: list[_Probe], owners: list[list[int]], items: np.ndarray, gap: int):
    owner_of = np.array(list(chain.from_iterable(owners)), dtype=np.int64)
    owner_at = np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64)
    length_of = {int(k): p.terms.shape[1] for p in probes for k in p.number}

    def matches(lists: _Lists):
        """(window, start) of phrase matches and of proximity matches."""
        phrase, near = [], []
        for p in probes if len(lists.keys) else []:
            lo, hi = lists.bounds(p.terms[:, 0])
            live = np.flatnonzero(hi > lo)
            cut = np.searchsorted(np.cumsum(hi[live] - lo[live]), np.arange(_CHUNK, int((hi[live] - lo[live]).sum()) + _CHUNK, _CHUNK))
            for some in np.split(live, np.unique(np.minimum(cut + 1, len(live)))):
                n = hi[some] - lo[some]
                if not n.sum():
                    continue
                w = np.repeat(some, n)
                listed = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[some], n)
                start = lists.keys[listed] - p.terms[w, 0] * lists.span - p.offsets[w, 0]
                close_w, close_start = w, start
                for k in range(1, min(NEAR_TERMS, p.terms.shape[1])):
                    keep = lists.has_near(p.terms[close_w, k], close_start + p.offsets[close_w, k], NEAR_WORDS)
                    close_w, close_start = close_w[keep], close_start[keep]
                near.append((p.number[close_w], close_start + p.offsets[close_w, 0]))
                for k in range(1, p.terms.shape[1]):
                    if not len(w):
                        break
                    keep = lists.has(p.terms[w, k], start + p.offsets[w, k])
                    w, start = w[keep], start[keep]
                phrase.append((p.number[w], start))
        return [tuple(np.concatenate([x[i] for x in found]) if found else np.zeros(0, dtype=np.int64) for i in (0, 1)) for found in (phrase, near)]

    def per_doc_items(window, place, lists, n_docs):
        """The items of each document as a list column; the pairs, too."""
        n = owner_at[window + 1] - owner_at[window]
        doc = np.repeat(np.searchsorted(lists.starts, place, side="right") - 1, n)
        item = owner_of[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(owner_at[window], n)]
        pairs = np.unique(doc * max(len(items), 1) + item)
        doc, item = np.divmod(pairs, max(len(items), 1))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(items[item])), pairs

    def run(batches):
        for batch in parts(batches, 5, _LAID):
            lists = _Lists(pa.RecordBatch.from_arrays([batch.column(i) for i in (2, 3, 4, 5)], names=["n", "t", "c", "p"]), vocabulary, gap)
            (w, start), (near_w, near_at) = matches(lists)
            n_docs = batch.num_rows
            hit, _ = per_doc_items(w, start, lists, n_docs)
            near, _ = per_doc_items(near_w, near_at, lists, n_docs)
            end = start + np.fromiter((length_of[int(k)] for k in w), dtype=np.int64, count=len(w))
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
            if len(start):  # spans that touch become one
                reach = np.maximum.accumulate(end)
                fresh = np.concatenate([[True], start[1:] > reach[:-1]])
                start, end = start[fresh], reach[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(reach) - 1]])]
            doc = np.searchsorted(lists.starts, start, side="right") - 1
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))]).astype(np.int32)
            base = lists.starts[doc]
            spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], names=["start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), spans, hit, near], names=["doc_id", "uid", "n_words", "spans", "items", "near"])

    return run


_FOUND = "doc_id long, uid long, n_words long, spans array<struct<start: long, end: long>>, items array<long>, near array<long>"


def _covered(spans):
    """Words inside spans that are sorted by start and may overlap."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(s["end"] - F.greatest(a["reach"], s["start"]), F.lit(0))).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach")), lambda a: a["n"])


def _pieces(window: int):
    """Items in pieces of PIECE_WORDS words; neighbours share window - 1 words, so that no window is lost."""
    def run(batches):
        for batch in batches:
            owner, at, out = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                for a in range(0, max(1, len(words) - window + 1) if words else 0, PIECE_WORDS):
                    some = words[a : a + PIECE_WORDS + window - 1]
                    owner.append(k), at.append(len(some)), out.append(b" ".join(some))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(at, pa.int64()), pa.array(out, pa.binary())], names=["item_id", "n", "words"])

    return run


def search_index(index: DataFrame, items: DataFrame, put, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Matches of the test items in an index: doc_id, uid, n_words, n_hit, spans, items and near."""
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where("item_id is not null and text is not null")
    wanted = put(wanted.mapInArrow(frugal(_pieces(window)), "item_id long, n long, words binary").distinct())
    n_blocks = max(1, -(-(wanted.agg(F.sum("n")).first()[0] or 0) // block_words))
    found = None
    for block in range(n_blocks):
        some = wanted if n_blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n_blocks)) == block)
        terms = TestTerms.of([(r[0], bytes(r[1])) for r in some.select("item_id", "words").sort("item_id", "words").collect()], window)
        probes = _probes(terms, list_lengths(index, terms))
        run = _searcher(terms.vocabulary, probes, terms.owners, terms.items, window + NEAR_WORDS)
        one = index.select("doc_id", "uid", "n_words", "terms", "counts", "positions").mapInArrow(frugal(run), _FOUND)
        found = one if found is None else found.unionByName(one)
    if n_blocks > 1:
        merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
        found = found.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), merged("spans").alias("spans"), merged("items").alias("items"), merged("near").alias("near"))
    return found.select("doc_id", "uid", "n_words", _covered(F.col("spans")).alias("n_hit"), "spans", "items", "near")


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Matches of the test items in every document.

    ``docs`` has doc_id and text, ``items`` has item_id and text; other columns
    are ignored. Returns for each row of ``docs`` doc_id, n_words, n_hit (words
    inside phrase matches), spans (start and end word of matched stretches),
    items (ids with a phrase match, ascending) and near (ids with a proximity
    match, phrase matches included). Null and empty texts have no words and no
    matches. Items without words or without an id are ignored; rows that
    repeat an id count as one item with all their windows. An empty benchmark
    matches nothing; an empty corpus gives an empty table.
    """
    put = Scratch()
    out = put(search_index(build_index(docs, put), items, put, window, block_words).drop("uid"))
    put.end(out)
    return out


def keep(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of a test item, with all their columns.

    The matched rows' numbers are written and left out by an anti join, which
    Spark broadcasts only where their size allows. Rows are told apart by their
    place, so null and repeated ids are judged each by its own text.
    """
    put = Scratch()
    index = build_index(docs, put, carry=True)
    hit = put(search_index(index, items, put, window).where("n_hit > 0").select("uid"))
    rows = index.join(hit, "uid", "left_anti")
    carried = {f.name for f in index.schema["row"].dataType}
    out = put(rows.select(*(F.col("row").getField(c).alias(c) if c in carried else F.col("text").cast("string").alias(c) for c in docs.columns)))
    put.end(out)
    return out
