"""Near-duplicate groups by min-max hashing.

Each permutation is evaluated once and gives two signature values, the least
and the greatest hash of the set. Bands of four values, from four different
permutations, make buckets. Texts with equal sets (by 128 bits of sums over the
sets) are one class from the start, so exact copies take part in no join.

Pairs of a bucket are never listed. Each bucket's classes are compared with the
bucket's pivot; components of the confirmed links then close all buckets whose
classes lie in one component. What is still open is compared in blocks of
bounded size: first on 64-byte sketches, which leave the classes that have a
possible partner in another component, then on full sets, which give the links.
Blocks of a bucket's largest component don't meet each other. Links are confirmed
on full sets throughout. Joins on buckets, pivots, components and digests deal
a hot key's rows to several parts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, frugal, join_dealt, parts
from tidemark.llm.components import components
from tidemark.llm.shingles import by_bytes, many_sets, mix, shingle_sets

#: A link needs 100 * common >= PERCENT * union.
PERCENT = 75
PERMUTATIONS = 64
#: Bands of four values: a pair at the threshold meets in none of them with probability (1 - 0.75^4)^32 = 5e-6.
BANDS = 32
#: Classes, and about so many shingles, of a block when open buckets are compared.
BLOCK = 400
BLOCK_SHINGLES = 250_000
#: Sketches of 128 four-bit values: a linked pair agrees on 98 in the mean, and on fewer than these with probability below 1e-9.
LEAST_AGREEING = 68

_rng = np.random.default_rng(75)
_A = _rng.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)
_C = _rng.integers(0, 1 << 64, 5, dtype=np.uint64) | np.uint64(1)
_D = _rng.integers(0, 1 << 64, 2, dtype=np.uint64)


def min_max(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest hash of each set (none empty) under each permutation: permutations x sets."""
    low = np.empty((PERMUTATIONS, len(at)), dtype=np.uint64)
    high = np.empty_like(low)
    for k in range(PERMUTATIONS):
        hashed = sets * _A[k] + _B[k]
        low[k] = np.minimum.reduceat(hashed, at)
        high[k] = np.maximum.reduceat(hashed, at)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bucket numbers: sets x bands."""
    b = np.arange(BANDS)
    k = PERMUTATIONS // BANDS
    keys = low[k * b] * _C[0] + low[k * b + 1] * _C[1] + high[(k * b + 2) % PERMUTATIONS] * _C[2] + high[(k * b + 3) % PERMUTATIONS] * _C[3]
    return mix(keys + (b.astype(np.uint64) * _C[4])[:, None]).T.view(np.int64)


def sketches(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Four bits of every signature value: sets x 64 bytes."""
    bits = ((np.concatenate([low, high]) >> np.uint64(33)) & np.uint64(15)).astype(np.uint8).T
    return np.ascontiguousarray(bits[:, ::2] << 4 | bits[:, 1::2])


def _sign(batches):
    from pyspark import TaskContext

    uid = TaskContext.get().partitionId() << 40
    for batch in parts(batches, 1):
        texts = batch.column(1).to_pylist()
        sets, bounds = shingle_sets(texts)
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        digest = np.zeros((2, len(n)), dtype=np.int64)
        bands, sketch = [None] * len(n), [None] * len(n)
        if len(some):
            at = bounds[some]
            low, high = min_max(sets, at)
            for k in (0, 1):
                digest[k, some] = mix(np.add.reduceat(mix(sets ^ _D[k]), at) + n[some].astype(np.uint64) * _C[k]).view(np.int64)
            for i, keys, marks in zip(some.tolist(), band_keys(low, high), sketches(low, high)):
                bands[i], sketch[i] = keys, marks.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(np.arange(uid, uid + len(n), dtype=np.int64)), pa.array(n), *(pa.array(d, mask=n == 0) for d in digest),
                pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), *batch.columns[1:],
            ],
            names=["doc_id", "uid", "n", "h1", "h2", "bands", "sketch", *batch.schema.names[1:]],
        )
        uid += len(n)


def signatures(docs: DataFrame, put, carry: bool = False) -> DataFrame:
    """Digest, band keys and sketch of every document, written to the shared folder with its text.

    ``uid`` numbers the rows. ``h1`` and ``h2`` are 128 bits of sums over the
    set, null for documents without words. With ``carry`` the columns of
    ``docs`` come as a struct ``row``, a string ``text`` left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *([F.struct(*_carried(docs)).alias("row")] if carry else []))
    kinds = T.StructType.fromDDL("doc_id long, uid long, n long, h1 long, h2 long, bands array<long>, sketch binary")
    for f in rows.schema.fields[1:]:
        kinds.add(f.name, f.dataType)
    return put(rows.mapInArrow(frugal(_sign), kinds))


def _carried(docs: DataFrame):
    return [F.col(f"`{f.name}`") for f in docs.schema if f.name != "text" or f.dataType != T.StringType()]


def _confirm_batches(batches):
    """Rows (a, b, text_a, text_b), mostly sorted by a: those whose sets link."""
    held, last = None, None
    for batch in parts(batches, 3):
        a, b, text_a, text_b = (batch.column(i).to_pylist() for i in range(4))
        for i, j in by_bytes(text_b):
            sets, bounds = shingle_sets(text_b[i:j])
            links = []
            for k in range(i, j):
                if last is None or a[k] != last:
                    held, last = shingle_sets([text_a[k]])[0], a[k]
                other = sets[bounds[k - i] : bounds[k - i + 1]]
                low, high = (held, other) if len(held) < len(other) else (other, held)
                if not len(low) or 100 * len(low) < PERCENT * len(high):
                    continue
                at = np.minimum(np.searchsorted(high, low), len(high) - 1)
                common = int(np.count_nonzero(high[at] == low))
                if 100 * common >= PERCENT * (len(low) + len(high) - common):
                    links.append((a[k], b[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _sketch_batches(batches):
    """Rows (a, b, sketch_a, sketch_b): pairs whose sketches allow a link."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
        same = np.count_nonzero((x >> 4) == (y >> 4), axis=1) + np.count_nonzero((x & 15) == (y & 15), axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(same >= LEAST_AGREEING))


def _both_sides(pairs: DataFrame, classes: DataFrame, columns: list[str], put) -> DataFrame:
    """The pairs (a, b) with columns of both classes as c_a and c_b. One class may be ``a`` of any number of pairs."""
    side = lambda c: classes.select(F.col("cls").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in columns))
    # Pairs and classes follow the data, so neither is broadcast, however few there are.
    counts = put(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    return join_dealt(pairs.join(side("b").hint("merge"), "b"), side("a"), ["a"], counts, "b")


def plausible(pairs: DataFrame, classes: DataFrame, put) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link; written."""
    rows = _both_sides(pairs, classes, ["n", "sketch"], put).where(_near_sizes("n_a", "n_b"))
    return put(rows.select("a", "b", "sketch_a", "sketch_b").mapInArrow(frugal(_sketch_batches), "a long, b long"))


def confirmed(pairs: DataFrame, texts: DataFrame, put) -> DataFrame:
    """The pairs (a, b) of classes whose full sets link; written."""
    rows = _both_sides(pairs, texts, ["text"], put).select("a", "b", "text_a", "text_b")
    return put(rows.mapInArrow(frugal(_confirm_batches), "a long, b long"))


def _near_sizes(a: str, b: str):
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def _partners(key, rows: pd.DataFrame):
    """For each class of the first block: (its row, the rows of the second that differ in component and whose sizes and sketches allow a link)."""
    marks = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(len(rows), -1)
    marks = np.concatenate([marks >> 4, marks & 15], axis=1)
    cls, root, n, block = (rows[c].to_numpy() for c in ("cls", "root", "n", "block"))
    left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
    for i in left:
        other = right[(root[right] != root[i]) & ((cls[right] > cls[i]) | (block[right] != block[i]))]
        other = other[(n[other] * 100 >= n[i] * PERCENT) & (n[i] * 100 >= n[other] * PERCENT)]
        other = other[np.count_nonzero(marks[other] == marks[i], axis=1) >= LEAST_AGREEING]
        if len(other):
            yield i, other


def _with_partners(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The classes of a bucket's two blocks that have a possible partner."""
    found = np.zeros(len(rows), dtype=bool)
    for i, other in _partners(key, rows):
        found[i] = True
        found[other] = True
    return rows.loc[found, ["bucket", "cls", "root", "n", "home"]]


def _linked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The links between a bucket's two blocks, on full sets."""
    sets, bounds = many_sets(list(rows["text"]))
    sizes, cls = np.diff(bounds), rows["cls"].to_numpy()
    names, place = np.unique(sets, return_inverse=True)
    held, a, b = np.zeros(len(names), dtype=bool), [], []
    for i, other in _partners(key, rows):
        held[place[bounds[i] : bounds[i + 1]]] = True
        common = np.array([np.count_nonzero(held[place[bounds[j] : bounds[j + 1]]]) for j in other])
        held[:] = False
        links = other[100 * common >= PERCENT * (sizes[other] + sizes[i] - common)]
        a += [cls[i]] * len(links)
        b += cls[links].tolist()
    return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def _dealt(rows: DataFrame, put) -> DataFrame:
    """Each bucket's classes dealt to blocks, once for each pair of blocks that must meet; a group has two blocks at most.

    Home blocks, which hold one component, need not meet each other, so the
    work is the classes away from home times all.
    """
    def blocks(which):
        return F.greatest(F.ceil(F.count(F.when(which, 1)) / BLOCK), F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")

    home = F.col("home")
    sizes = put(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), blocks(home).alias("homes"), blocks(~home).alias("aways")))
    rows = join_dealt(rows, sizes.where("aways > 0").drop("n"), ["bucket"], sizes, "cls")
    at = F.xxhash64("cls", "bucket")
    block = F.when(home, F.pmod(at, F.col("homes"))).otherwise(F.col("homes") + F.pmod(at, F.col("aways"))).cast("int")
    last = F.col("homes") + F.col("aways") - 1
    other = F.explode(F.sequence(F.when(home, F.col("homes")).otherwise(F.lit(0)), last))
    rows = rows.select("bucket", "cls", "root", "n", "home", block.alias("block"), other.alias("other"))
    return rows.select("bucket", "cls", "root", "n", "home", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _open_links(rows: DataFrame, texts: DataFrame, put) -> DataFrame:
    """The links between classes of open buckets (bucket, cls, root, n, home) that differ in component; written."""
    sketched = _dealt(rows, put).join(texts.select("cls", "sketch").hint("merge"), "cls")
    some = put(sketched.groupBy("bucket", "i", "j").applyInPandas(_with_partners, "bucket long, cls long, root long, n long, home boolean").distinct())
    whole = _dealt(some, put).join(texts.select("cls", "sketch", "text").hint("merge"), "cls")
    return put(whole.groupBy("bucket", "i", "j").applyInPandas(_linked, "a long, b long").distinct())


def _with_roots(rows: DataFrame, links: DataFrame, put) -> DataFrame:
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), put=put)
    return rows.join(roots.withColumnRenamed("node", "cls").hint("merge"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _still_open(members: DataFrame, links: DataFrame, put) -> DataFrame | None:
    """The classes of buckets that hold more than one component beside the pivot, which has met all; None if there are none.

    The component with most classes of a bucket is at home there.
    """
    rows = put(_with_roots(members.where("cls <> pivot").drop("pivot"), links, put))
    by_root = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    found = by_root.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_roots"), F.max_by("root", "n").alias("home")).where("n_roots > 1")
    found = put(found.drop("n_roots"))
    rows = put(join_dealt(rows, found.select("bucket", F.col("home").alias("_home")), ["bucket"], found.select("bucket", "n"), "cls").withColumn("home", F.col("root") == F.col("_home")).drop("_home"))
    return None if rows.isEmpty() else rows


def _judged(docs: DataFrame, put, carry: bool) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and for each of them uid, component_id and the uid of the row that stands for its component; both written."""
    signed = signatures(docs, put, carry)
    own = F.coalesce(F.min_by("uid", "doc_id"), F.min("uid")).alias("first")
    # Equal sets are one class, so copies meet nothing below; a class's number is a row of it.
    classes = put(signed.where("n > 0").groupBy("h1", "h2").agg(F.min("uid").alias("cls"), F.min("doc_id").alias("least"), own, F.count(F.lit(1)).alias("n")))
    held = put(signed.select(F.col("uid").alias("cls"), "n", "bands").join(classes.select("cls").hint("merge"), "cls"))
    banded = held.select("cls", "n", F.explode("bands").alias("bucket"))
    shared = put(banded.groupBy("bucket").agg(F.min("cls").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = put(join_dealt(banded, shared.drop("n"), ["bucket"], shared.select("bucket", "n"), "cls"))
    put.drop(held)
    wanted = members.select(F.col("cls").alias("uid")).distinct()
    texts = put(signed.select(F.col("uid"), "n", "sketch", "text").join(wanted.hint("merge"), "uid").withColumnRenamed("uid", "cls"))

    first = put(members.where("cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b")).distinct())
    tested = plausible(first, texts, put)
    links = confirmed(tested, texts, put)
    rest = _still_open(members, links, put)
    if rest is not None:
        links = links.unionByName(_open_links(rest, texts, put))

    roots = put(_with_roots(classes.withColumnRenamed("first", "_first"), links, put))
    own = F.coalesce(F.min_by("_first", "least"), F.min("_first")).alias("first")
    least = put(roots.groupBy("root").agg(F.min("least").alias("component_id"), own, F.count(F.lit(1)).alias("n")))
    named = join_dealt(roots.select("h1", "h2", "root", "n"), least.drop("n"), ["root"], least.select("root", "n"), "h1")
    named = put(named.select("h1", "h2", "component_id", "first", "n"))
    rows = join_dealt(signed.where("n > 0").select("doc_id", "uid", F.col("n").alias("n_shingles"), "h1", "h2"), named.drop("n"), ["h1", "h2"], named.select("h1", "h2", "n"), "uid")
    alone = signed.where("n = 0").select("doc_id", "uid", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("uid").alias("first"))
    judged = put(rows.select(*alone.columns).unionByName(alone))
    put.end(signed, judged)
    return signed, judged


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``docs`` has doc_id and text; other columns are ignored. component_id is
    the least doc_id that links reach, the document's own id included; kept
    marks rows that carry it. Documents without words, or with null text, link
    with nothing. Rows that share an id are judged each by its own text. A null
    id is never a group's least; a group of null ids alone has a null
    component_id, and its rows are kept. An empty table gives an empty one.
    """
    put = Scratch()
    signed, judged = _judged(docs, put, False)
    put.drop(signed)
    return judged.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: one row of each group.

    A group is a component of linked texts, whatever its rows' ids are. The row
    with the least doc_id stays (null ids come last), and one of them where
    several rows have that id. Rows without words link with nothing and all
    stay, repeated ones too. Rows are told apart by their place, not by their
    id, so that a row never goes because another one of its id does.
    """
    put = Scratch()
    signed, judged = _judged(docs, put, True)
    dropped = put(judged.where("uid <> first").select("uid"))
    put.drop(judged)
    rows = signed.join(dropped, "uid", "left_anti")
    carried = {f.name for f in signed.schema["row"].dataType}
    out = put(rows.select(*(F.col("row").getField(c).alias(c) if c in carried else F.col("text").cast("string").alias(c) for c in docs.columns)))
    put.end(out)
    return out
