"""Personal data: exact patterns, and terms that reveal what the patterns protect.

Emails, IP addresses, card and phone numbers are found by fixed patterns. Each
distinct value is a protected entity. All words of a text that holds an entity
are its candidate terms; smoothed corpus counts, all of distinct texts, then say
how strongly a term reveals the entity: the pointwise mutual information of term and entity as a share of the entity's own
information content, which is 1 where the term occurs with nothing else.
Terms over a disclosure threshold are generalised, and over a higher one
removed, in the documents that hold the entity.

Everything is DataFrame expressions. Positions are in code points, ends
exclusive. Quantifiers are possessive and runs are entered only at their start,
so that no text makes matching slower than linear or overflows the stack; places
and rewritten texts are made in stretches (arrays.py), terms looked up in buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import chunks, piece, running_max, running_sum
from tidemark.llm.common import Scratch, join_dealt, written

#: Kinds in the order of ties. Each pattern finds what the contract's pattern finds.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be worth a try.
_HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = [*PATTERNS, "term"]

#: Terms with fewer letters count only where they are written like names.
TERM_LETTERS = 4
#: Texts that the estimate of a link adds to those counted; half a text lets a single meeting count, and the more the rarer the entity is.
PSEUDO = 0.5
#: A term is generalised from this share of the entity's information on, if the entity is as likely as this given the term; removed from the higher share on.
GENERALISE = 0.9
LEAST_GIVEN_TERM = 0.5
REMOVE = 0.98

#: Terms of a text that one pattern looks for.
FEW_TERMS = 100

#: What replaces a span in the text; a generalised term by how it is written.
PLACEHOLDERS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "name": "<NAME>", "word": "<WORD>"}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def weighed(i):
        d = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d < 5, 2 * d).otherwise(2 * d - 9)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + weighed(i)) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(hit, "[.]"), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    n = F.length(_digits(hit))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(hit))).otherwise(False)
    return (n >= 9) & (n <= 15)


def _checked(kind: str):
    return lambda span: _valid(kind, span["hit"])


_NONE = "cast(array() as array<struct<start:int,kind:int,end:int,hit:string>>)"


def _placed(rows: DataFrame, text: str, hits: dict[str, str], patterns: dict[str, str | Column]) -> DataFrame:
    """Turn columns of matches into columns of spans: places are running sums of the stretches between and the matches."""
    for kind, name in hits.items():
        gaps = F.slice(F.split(F.col(text), patterns[kind], -1), F.lit(1), F.size(name))
        steps = F.zip_with(F.col(name), gaps, lambda h, g: F.length(h) + F.length(g))
        rows = rows.withColumn(f"{name}_steps", F.when(F.size(name) > 0, steps).otherwise(F.expr("cast(array() as array<int>)")))
    for kind, name in hits.items():
        number = F.lit(KINDS.index(kind))
        span = lambda h, e: F.struct((e - F.length(h)).alias("start"), number.alias("kind"), e.alias("end"), h.alias("hit"))  # noqa: E731, B023
        spans = F.zip_with(F.col(name), running_sum(f"{name}_steps"), span)
        rows = rows.withColumn(name, F.when(F.size(name) > 0, spans).otherwise(F.expr(_NONE)))
    return rows.drop(*(f"{name}_steps" for name in hits.values()))


def with_base_spans(rows: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """Add the pattern matches that pass their checks, sorted by start and then kind.

    A span is (start, kind as a number in KINDS, end, hit). Null text has none.
    """
    keep = rows.columns
    for kind, pattern in PATTERNS.items():
        hint = _HINTS[kind]
        worth = F.col(text).rlike("[0-9]") if hint is None else F.contains(F.col(text), F.lit(hint))
        hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        rows = rows.withColumn(f"_{kind}", F.when(worth, hits))
    rows = _placed(rows, text, {k: f"_{k}" for k in PATTERNS}, PATTERNS)
    found = F.array_sort(F.concat(*(F.filter(f"_{k}", _checked(k)) for k in PATTERNS)))
    return rows.select(*(F.col(f"`{c}`") for c in keep), found.alias(out))


def _rewritten(rows: DataFrame, text: str, spans: str, out: str, label: Callable[[Column], Column], again: Callable[[Column, Column], Column]) -> DataFrame:
    """Add the text with spans (by start) replaced: by ``label`` where a span begins outside all before it, else by ``again(span, reach)``."""
    rows = rows.withColumn("_ends", F.transform(spans, lambda s: s["end"])).withColumn("_chunks", chunks(F.col(text)))
    rows = rows.withColumn("_reach", F.concat(F.array(F.lit(0)), running_max("_ends")))

    def one(s, reach):
        return F.when(s["start"] >= reach, F.concat(piece("_chunks", reach, s["start"]), label(s))).otherwise(again(s, reach))

    parts = F.zip_with(F.col(spans), F.slice("_reach", F.lit(1), F.size(spans)), one)
    whole = F.concat(F.array_join(parts, ""), piece("_chunks", F.element_at("_reach", -1), F.length(text)))
    return rows.withColumn(out, F.when(F.size(spans) > 0, whole).otherwise(F.col(text))).drop("_ends", "_chunks", "_reach")


def _entity(span: Column) -> Column:
    """The value that a span protects, whatever its spelling."""
    kind = span["kind"]
    value = F.when(kind <= 1, F.lower(span["hit"])).otherwise(_digits(span["hit"]))
    return F.concat(kind.cast("string"), F.lit(":"), value)


def _terms(text: Column) -> Column:
    """The distinct terms of a text: runs of letters, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != ""))


def _names(text: Column) -> Column:
    """The short terms of a text that are written like names: with a capital, or in letters without case."""
    words = F.filter(F.split(text, r"[^\p{L}]+"), lambda w: (F.length(w) < TERM_LETTERS) & w.rlike(r"^[\p{Lu}\p{Lt}\p{Lo}]"))
    return F.array_distinct(F.transform(words, F.lower))


def _smoothed(joint: Column, n_term: Column, prior) -> Column:
    """The probability of an entity given a term, with PSEUDO texts that hold the entity as often as any text does."""
    return (joint + prior * PSEUDO) / (n_term + PSEUDO)


def revealing_terms(docs: DataFrame, put: Scratch, generalise: float = GENERALISE, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """Base spans of every document, and the terms to hide by document; both written by ``put``.

    The first table has doc_id, mark (a hash of the text) and base, a row for
    each row of ``docs``, with all its columns as a struct ``row`` if they are
    to be carried; the second doc_id, mark, text, base and terms, an array
    of (term, removed), for each distinct document that has any. Term and entity
    meet anywhere in a text. All counts are of distinct texts, so that copying
    changes no term's score.
    """
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *whole)
    based = with_base_spans(rows.withColumn("mark", F.xxhash64("text")))
    held = F.size("base") > 0
    entities = F.array_distinct(F.transform("base", _entity))
    found = put(based.select("doc_id", "mark", "base", F.when(held, F.col("text")).alias("text"), F.when(held, entities).alias("entities"), F.when(held, _terms(F.col("text"))).alias("terms"), F.when(held, _names(F.col("text"))).alias("names"), *(["row"] if carry else [])))
    holders = found.where(held)
    texts = put(holders.groupBy("mark").agg(*(F.any_value(c).alias(c) for c in ("entities", "terms", "names"))))
    # The texts of any entity that hold a term are among all that hold it: terms in too many others are out before they meet the entities.
    around = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    names = texts.select(F.explode("names").alias("term")).distinct().withColumn("name", F.lit(True))
    around = around.join(names, "term", "left").where((F.length("term") >= TERM_LETTERS) | F.col("name")).drop("name")
    distinct = rows.groupBy(F.xxhash64("text").alias("mark")).agg(F.any_value("text").alias("text"))
    counts = distinct.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    candidates = put(around.join(counts, "term").where(_smoothed(F.col("n"), F.col("n_term"), 1.0) >= LEAST_GIVEN_TERM).select("term", "n_term", "n"))
    # Entities of the same texts have the same counts, so they meet the terms as one group.
    of = texts.select("mark", F.explode("entities").alias("entity"))
    same = of.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("mark")).alias("a"), F.bit_xor(F.xxhash64("mark", F.lit(1))).alias("b"))
    same = put(same.select("entity", "n", F.xxhash64("n", "a", "b").alias("group")))
    groups = join_dealt(of, same.withColumnRenamed("n", "n_entity"), ["entity"], same, "mark").select("mark", "group", "n_entity").distinct()
    near = join_dealt(texts.select("mark", F.explode("terms").alias("term")), candidates.drop("n"), ["term"], candidates.select("term", "n"), "mark")
    pairs = put(near.join(groups.hint("merge"), "mark"))
    joint = put(pairs.groupBy("group", "term").agg(F.count(F.lit(1)).alias("n"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity")))
    n_docs = max(found.agg(F.count_distinct("mark")).first()[0], 1)
    prior = F.col("n_entity") / F.lit(n_docs)
    given = _smoothed(F.col("n"), F.col("n_term"), prior)
    information = -F.log2(prior)
    share = F.when(information > 0, (F.log2(given) + information) / information).otherwise(0.0)
    flagged = joint.where((share >= generalise) & (given >= LEAST_GIVEN_TERM)).select("group", "term", "n", (share >= REMOVE).alias("removed"))
    hidden = join_dealt(pairs, flagged.drop("n"), ["group", "term"], flagged.select("group", "term", "n"), "mark").groupBy("mark", "term").agg(F.max("removed").alias("removed"))
    hidden = put(hidden.groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("term", "removed"))).alias("terms")))
    hidden = holders.select("doc_id", "mark", "text", "base").dropDuplicates(["doc_id", "mark"]).join(hidden, "mark").select("doc_id", "mark", "text", "base", "terms")
    hidden = put(hidden)
    put.end(found, hidden)
    return found.select("doc_id", "mark", "base", *(["row"] if carry else [])), hidden


def _with_term_spans(rows: DataFrame, base: str, out: str) -> DataFrame:
    """Add spans of the terms to hide (column terms), outside the base spans; a span says whether it is removed.

    What the base spans cover is blanked. Few terms are looked for by one
    pattern; else all words are placed. What is placed is looked up among a
    bucket of the terms.
    """
    keep = rows.columns
    few = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("terms", lambda t: t["term"]), "|"), F.lit(r")(?!\p{L})"))
    rows = rows.withColumn("_pattern", F.when(F.size("terms") > FEW_TERMS, r"\p{L}+").otherwise(few))
    blank = lambda s, reach: F.repeat(F.lit("0"), F.greatest(s["end"] - F.greatest(s["start"], reach), F.lit(0)))
    rows = rows.withColumn("_some", F.coalesce(F.size("terms"), F.lit(0)) > 0).withColumn("_text", F.when(F.col("_some"), F.col("text")))
    rows = _rewritten(rows, "_text", base, "_text", lambda s: blank(s, F.lit(0)), blank)
    rows = rows.withColumn("_words", F.when(F.col("_some"), F.regexp_extract_all("_text", "_pattern", F.lit(0))))
    rows = _placed(rows, "_text", {"term": "_words"}, {"term": F.col("_pattern")})
    rows = rows.withColumn("_many", F.least(F.lit(256), F.greatest(F.lit(1), F.shiftright(F.size("terms"), 5))))
    bucket = lambda t: F.pmod(F.xxhash64(t), F.col("_many")).cast("int")
    rows = rows.withColumn("_dealt", F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["removed"].alias("removed"), bucket(t["term"]).alias("k"))))
    buckets = F.transform(F.sequence(F.lit(0), F.col("_many") - 1), lambda k: F.filter("_dealt", lambda t: t["k"] == k))
    # Expressions that are used once only would be put into the lambda that uses them, and made again for each value.
    rows = rows.withColumn("_terms", F.when(F.size("_dealt") > 0, buckets))
    rows = rows.withColumn("_words", F.transform("_words", lambda s: F.struct(*(s[c].alias(c) for c in ("start", "kind", "end", "hit")), F.lower(s["hit"]).alias("low"))))

    def looked_up(s):
        term = F.filter(F.get("_terms", bucket(s["low"])), lambda t: t["term"] == s["low"])
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["hit"].alias("hit"), F.get(term, 0)["removed"].alias("removed"))

    spans = F.filter(F.transform("_words", looked_up), lambda s: s["removed"].isNotNull())
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,hit:string,removed:boolean>>)")
    return rows.withColumn(out, F.when(F.col("_some") & (F.size("_terms") > 0), spans).otherwise(none)).select(*(F.col(f"`{c}`") for c in keep), out)


def find(docs: DataFrame) -> DataFrame:
    """Spans of personal data: doc_id, base and spans, arrays of (start, kind, end, hit) by start and kind.

    One row per row of ``docs``, which has doc_id and text; other columns are
    ignored. ``spans`` adds to ``base`` the terms that reveal an entity of the
    document. Null and empty texts have no spans. Rows with a null or repeated
    id are judged each by its own text. An empty table gives an empty one.
    """
    base, hidden = revealing_terms(docs, Scratch())
    more = F.transform("more", lambda s: F.struct(*(s[c].alias(c) for c in ("start", "kind", "end", "hit"))))
    again = written(_with_term_spans(hidden, "base", "more").select("doc_id", "mark", more.alias("more")))[0]
    out = _joined(base, again, "left")
    return out.select("doc_id", "base", F.when(F.size("more") > 0, F.array_sort(F.concat("base", "more"))).otherwise(F.col("base")).alias("spans"))


def _joined(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    other = other.withColumnsRenamed({"doc_id": "_doc_id", "mark": "_mark"})
    return rows.join(other, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("mark") == F.col("_mark")), how).drop("_doc_id", "_mark")


def describe(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts rewritten; all columns stay, and n_chars, if there, is counted anew.

    Entities become placeholders of their kind, generalised terms become their
    category (NAME where written with a capital, else WORD), removed terms go.
    Where spans overlap, the first's placeholder stands for the whole stretch. A
    null text stays null; texts without spans stay as they are.
    """
    put = Scratch()
    found, hidden = revealing_terms(docs, put, carry=True)
    names = docs.columns
    # Texts without an entity stay as they are, and meet no join.
    plain = found.where(F.size("base") == 0).select("row.*")
    held = found.where(F.size("base") > 0).withColumn("text", F.coalesce(F.col("row")["text"].cast("string"), F.lit("")))
    inner = _with_term_spans(_joined(held, hidden.select("doc_id", "mark", "terms"), "left"), "base", "more")
    same = F.transform("base", lambda s: F.struct(*(s[c].alias(c) for c in ("start", "kind", "end", "hit")), F.lit(False).alias("removed")))
    inner = inner.withColumn("spans", F.array_sort(F.concat(same, "more")))
    labels = F.array(*(F.lit(PLACEHOLDERS[k]) for k in PATTERNS))
    category = lambda s: F.when(s["hit"].rlike(r"^[\p{Lu}\p{Lt}]"), PLACEHOLDERS["name"]).otherwise(PLACEHOLDERS["word"])
    label = lambda s: F.when(s["removed"], "").when(s["kind"] == KINDS.index("term"), category(s)).otherwise(F.get(labels, s["kind"]))
    inner = _rewritten(inner, "text", "spans", "clean", label, lambda s, reach: F.lit(""))
    out = []
    for c in names:
        if c == "text":
            out.append(F.col("clean").alias("text"))
        elif c == "n_chars":
            out.append(F.length("clean").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            out.append(F.col("row").getField(c).alias(c))
    out = put(inner.select(*out).union(plain))
    put.end(out)
    return out
