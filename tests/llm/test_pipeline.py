"""The pipeline's rows against a version without Spark, and its guard."""

import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import brute_groups, brute_spans
from tidemark.llm import packing, pii, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages_are_brute_force(spark):
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    items = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    kept = {i: t for i, t in docs if all(not eval(r.fails.replace("=", "=="), dict(zip(quality_rules.MEASURES, quality_rules.measure(t)))) for r in quality_rules.RULES)}
    ids = sorted(kept)
    groups = brute_groups([kept[i] for i in ids])
    kept = {ids[k]: kept[ids[k]] for k, _, _, stays in groups if stays}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for w in map(split, items) if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    kept = {i: t for i, t in kept.items() if not any(tuple(w[k : k + n]) in windows for w in [split(t)] for n in sizes for k in range(len(w) - n + 1))}

    docs_df = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs_df.columns
        docs_df = stage(spark, docs_df, SF).cache()
        assert docs_df.columns == columns, name
    found = {r.doc_id: r.text for r in docs_df.collect()}
    assert set(found) == set(kept)
    for i, t in kept.items():
        if not brute_spans(t):
            assert found[i] == t
        else:
            assert found[i] != t and not any(t[a:b] in found[i] for a, _, b in brute_spans(t))

    rows = corpus_pipeline.run(spark, SF).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {}
    for i, t in found.items():
        tokens = np.array([*whole.encode(t, add_special_tokens=False).ids, packing.END], dtype="<u4")
        for k, at in enumerate(range(0, len(tokens), 4096)):
            expected[i, k] = (at, len(tokens[at : at + 4096]), zlib.crc32(tokens[at : at + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    assert len({r.sequence_id for r in rows}) == -(-sum(n for _, n, _ in expected.values()) // 4096)


def test_entry_works_without_the_subpackage(tmp_path):
    """A copy without the subpackage and the pipeline still imports; any other missing module is an error."""
    root = Path(corpus_pipeline.__file__).resolve().parent
    code = f"""
import shutil, sys
shutil.copytree({str(root)!r}, {str(tmp_path / 'copy')!r}, ignore=shutil.ignore_patterns('.git', 'llm', 'corpus_pipeline.py', '__pycache__', 'tests'))
sys.path.insert(0, {str(tmp_path / 'copy')!r})
import __spark_entry__ as e
names = e.queries()
assert names and not any(n.startswith('op') or n == 'pipeline' for n in names) and set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_registered_queries():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert len(corpus_pipeline.STAGES) == 5 and set(e.oracle_sql()) <= set(names)
    assert pii.KINDS[:4] == ["email", "ip", "card", "phone"]
