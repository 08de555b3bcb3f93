"""Packing of tokenised documents into sequences of a fixed capacity.

Documents become pieces; only documents over the capacity are cut. The
histogram of piece lengths, which has no more bins than the capacity, goes to
the driver. There a configuration linear program (a configuration is a set of
lengths that fits a sequence; each length's copies are to be covered) is solved
by multiplicative weights: a knapsack dynamic program prices configurations
against the lengths' weights, each round covers at most a share of any length,
and lengths covered ahead of the rest lose weight. The fractional solution is
rounded by one running sum, and what rounding leaves over is packed by best fit
decreasing on the histogram. The plan's size depends on the capacity alone.

Pieces find their places by rank: the n-th piece of a length takes the n-th
slot of that length. Ranks come from a running count within each input
partition and a sum over partitions, so that a length which a third of all
pieces share is never gathered anywhere.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import frugal, parts, written

CAPACITY = 4096
END = 1
#: Rounds of multiplicative weights, the lengths priced in one, and the share of a length's copies that one may cover.
ROUNDS = 300
PRICED = 256
SHARE = 0.5
#: How strongly being covered ahead of the others lowers a length's weight.
RATE = 0.3
#: Words whose ids a Python worker remembers, twice at most.
REMEMBERED = 400_000


# Tokens

def _ranges(kind: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


def _needs_tokenizer(text: str) -> bool:
    if "<|" not in text:
        try:
            text.encode("latin-1")
            return False
        except UnicodeEncodeError:
            pass
    return _RARE.search(text) is not None


#: Outside these characters, and at these marks, the tokenizer reads the whole text itself.
_RARE = re.compile("[^\x00-ɏ]|İ|<\\|(?:startoftext|endoftext)\\|>")
#: The vocabulary's own splitting rule, for characters below U+0250.
_SPLIT = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_ranges('L')}]+|[{_ranges('N')}]|[^\\t-\\r \\x85\\xa0{_ranges('L')}{_ranges('N')}]+")


class WordTokens:
    """Ids of the word vocabulary as little-endian bytes, remembering words.

    Splitting is exact for texts below U+0250, where each word's ids depend on
    the word alone; any other text goes to the tokenizer whole.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        # Words are lowered and split already: the same vocabulary without those steps learns them faster.
        bare = json.loads(definition)
        bytes_only = [p for p in bare["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel"]
        bare |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": bytes_only[0]}
        self.words = Tokenizer.from_str(json.dumps(bare))
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        for word, found in zip(words, self.words.encode_batch_fast(words, add_special_tokens=False)):
            self.new[word] = array("I", found.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        out: list = [None] * len(texts)
        whole, unknown, gaps = [], set(), []
        get = self.new.get
        for i, text in enumerate(texts):
            if _needs_tokenizer(text):
                whole.append(i)
                continue
            words = _SPLIT.findall(text.lower())
            found = out[i] = list(map(get, words))
            at = -1
            try:
                while True:
                    at = found.index(None, at + 1)
                    gaps.append((found, at, words[at]))
                    unknown.add(words[at])
            except ValueError:
                pass
        again = unknown & self.old.keys()
        for word in again:
            self.new[word] = self.old[word]
        self._learn(list(unknown - again))
        for found, at, word in gaps:
            found[at] = self.new[word]
        if whole:
            for i, found in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
                out[i] = [array("I", found.ids).tobytes()]
        return [b"".join(found) for found in out]


_workers_tokens: dict[int, WordTokens] = {}


def _tokens(definition: str) -> WordTokens:
    key = hash(definition)
    if key not in _workers_tokens:
        _workers_tokens[key] = WordTokens(definition)
    return _workers_tokens[key]


def _piecer(definition, capacity: int, end: int, with_ids: bool):
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.disable()  # the remembered words hold no cycles
        try:
            yield from cut(batches, TaskContext.get().partitionId(), Counter(), _tokens(definition.value))
        finally:
            gc.enable()

    def cut(batches, part, seen, tokens):
        for some in parts(batches, 1):
            owner, piece, start, length, crc, k, ids = [], [], [], [], [], [], []
            for row, found in enumerate(tokens.encode([t or "" for t in some.column(1).to_pylist()])):
                found += tail
                total = len(found) // 4
                for i, begin in enumerate(range(0, total, capacity)):
                    one = found[4 * begin : 4 * (begin + capacity)]
                    n = len(one) // 4
                    owner.append(row), piece.append(i), start.append(begin), length.append(n), crc.append(zlib.crc32(one)), k.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        ids.append(one)
            columns = [some.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc)), pa.array([part] * len(owner), pa.int32()), pa.array(k, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return run


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, written to the shared folder.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty
    text gives one piece with the end token alone. Rows with a null or repeated
    id each give their own pieces. ``part`` and ``k`` number the pieces of a
    length: by input partition, and within it. With ``with_ids`` the tokens
    come as little-endian unsigned 32-bit numbers in ``ids``.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()  # a vocabulary file: its size doesn't follow the data
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long" + ", ids binary" * with_ids
    return written(rows.mapInArrow(frugal(_piecer(docs.sparkSession.sparkContext.broadcast(definition), capacity, end, with_ids)), schema))[0]


# The plan, on the driver

def _price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each room, and the length that the best filling of that room takes first (0: none)."""
    best, first = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        n = upto[room]
        best[room] = best[room - 1]
        if n:
            got = best[room - lengths[:n]] + value[:n]
            i = int(got.argmax())
            if got[i] > best[room]:
                best[room], first[room] = got[i], lengths[i]
    return best, first


def _filling(first: np.ndarray, room: int) -> Counter:
    """The lengths of the best filling of a room."""
    found: Counter = Counter()
    while room > 0:
        n = int(first[room])
        if n:
            found[n] += 1
            room -= n
        else:
            room -= 1
    return found


def configuration_lp(histogram: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> dict[tuple, float]:
    """A fractional solution: sequences by configuration, a sorted tuple of (length, copies).

    No length is covered beyond its copies. ``histogram[n]`` counts pieces of n.
    """
    lengths = np.flatnonzero(histogram[: capacity + 1])
    demand, covered = histogram[: capacity + 1].astype(float), np.zeros(capacity + 1)
    solution: dict[tuple, float] = {}
    rng = np.random.default_rng(7)
    for _ in range(rounds if len(lengths) else 0):
        room = (demand - covered)[lengths] * lengths
        live = np.flatnonzero(room > 1e-9 * demand[lengths] * lengths)
        if not len(live):
            break
        done = covered[lengths] / demand[lengths]
        ahead = done - np.average(done, weights=demand[lengths] * lengths)
        # Columns are priced in part: lengths are drawn by the room they still want.
        some = np.sort(rng.choice(live, size=min(PRICED, len(live)), replace=False, p=room[live] / room[live].sum()))
        # A length's weight starts from its share of the room, less a little for each piece so that long pieces go first.
        value = lengths[some] / capacity * np.exp(-RATE * ahead[some]) - 1e-5
        _, first = _price(lengths[some], np.maximum(value, 1e-9), capacity)
        allowed = np.minimum(demand * SHARE, demand - covered)
        for seed in lengths[some][::-1]:
            seed = int(seed)
            if allowed[seed] <= 1e-9:
                continue
            found = _filling(first, capacity - seed)
            found[seed] += 1
            config = tuple(sorted(found.items()))
            step = min(allowed[n] / copies for n, copies in config)
            if step <= 1e-9:
                continue
            solution[config] = solution.get(config, 0.0) + step
            for n, copies in config:
                covered[n] += step * copies
                allowed[n] -= step * copies
    return solution


def rounded(solution: dict[tuple, float], histogram: np.ndarray) -> tuple[list[tuple[tuple, int]], np.ndarray]:
    """Whole sequences for each configuration, and the pieces that are left.

    Fullest configurations come first; a running sum of the fractions decides
    where a sequence is added, never beyond the pieces there are.
    """
    left, plan, carried = histogram.astype(np.int64).copy(), [], 0.0
    for config in sorted(solution, key=lambda c: (-sum(n * k for n, k in c), c)):
        carried += solution[config]
        n = min(int(carried), *(int(left[size]) // copies for size, copies in config))
        if n > 0:
            plan.append((config, n))
            for size, copies in config:
                left[size] -= n * copies
        carried -= int(carried)
    return plan, left


def best_fit(left: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """Best fit decreasing over a histogram; sequences filled alike are counted, not listed."""
    by_room: dict[int, Counter] = {}  # room left -> contents -> sequences
    rooms = np.zeros(capacity + 1, dtype=bool)
    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n > 0:
            fits = np.flatnonzero(rooms[size:])
            if len(fits):
                room = size + int(fits[0])
                content, count = next(iter(by_room[room].items()))
                del by_room[room][content]
                if not by_room[room]:
                    rooms[room] = False
            else:
                room, content, count = capacity, (), n // (capacity // size) or 1
            copies = min(room // size, n) if count == 1 else min(room // size, max(1, n // count))
            used = min(count, n // copies)
            if used < count and content:
                by_room.setdefault(room, Counter())[content] += count - used
                rooms[room] = True
            n -= used * copies
            rest = room - copies * size
            by_room.setdefault(rest, Counter())[content + ((size, copies),)] += used
            rooms[rest] = rest > 0
    out: Counter = Counter()
    for contents in by_room.values():
        for content, count in contents.items():
            whole: Counter = Counter()
            for size, copies in content:
                whole[size] += copies
            out[tuple(sorted(whole.items()))] += count
    return sorted(out.items())


def plan_of(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """Configurations and how many sequences have each; every piece has a place."""
    plan, left = rounded(configuration_lp(histogram, capacity), histogram)
    return plan + best_fit(left, capacity)


def slots(plan: list[tuple[tuple, int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """The plan as runs of ranks: for each length, where its pieces from a rank on are put."""
    rows, used, sequence = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for config, n in plan:
        offset = 0
        for size, copies in config:
            rows.append((size, used[size], copies, sequence, offset))
            used[size] += n * copies
            offset += size * copies
        sequence += n
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "rank", "copies", "sequence", "offset"), table.T))


def _placer(runs):
    def run(batches):
        r = runs.value
        span = np.int64(1) << 44
        key = r["length"] * span + r["rank"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy().astype(np.int64) for i in (batch.num_columns - 2, batch.num_columns - 1))
            at = np.searchsorted(key, length * span + rank, side="right") - 1
            within, copies = rank - r["rank"][at], r["copies"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(r["sequence"][at] + within // copies), pa.array(r["offset"][at] + within % copies * length)],
                names=[*batch.schema.names[:-2], "sequence_id", "offset"])

    return run


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece a sequence_id and an offset.

    ``found`` comes from ``pieces``; its columns but part and k stay. Ranks are
    unique within a length, so sequences have no gaps and no overlaps, and only
    the last rounding step of the plan leaves sequences short. An empty table
    stays empty.
    """
    counts = found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts, _ = written(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    runs = found.sparkSession.sparkContext.broadcast(slots(plan_of(histogram, capacity), capacity))
    names = [c for c in found.columns if c not in ("part", "k")]
    # The counts follow the number of input partitions, so they are never broadcast; a key's pieces are one partition's at most.
    ranked = found.join(counts.select("length", "part", "before").hint("merge"), ["length", "part"]).select(*names, F.col("length").alias("_length"), (F.col("before") + F.col("k")).alias("_rank"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name in names)
    return ranked.mapInArrow(_placer(runs), kinds + ", sequence_id long, offset long")
