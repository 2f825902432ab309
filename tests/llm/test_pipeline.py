"""The stages on a small test table: what each one takes away, and the tokens at the end."""

from pathlib import Path

import pytest
from conftest import SMALL

pytest.importorskip("public_tokenizers")
pytestmark = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test tables")


def test_stages(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from tspanel.llm.queries import QUERIES, tokenizer_path
    from tspanel.llm.work import store

    docs, tables = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    columns = docs.columns
    for name, stage in p.STAGES:
        docs = store(stage(spark, docs, SMALL))
        tables.append(docs.collect())
        assert name == p.STAGES[-1][0] or docs.columns == columns
    ids = [[r.doc_id for r in t] for t in tables]
    kept = {r.doc_id for r in QUERIES["op8_quality_rules"](spark, SMALL).collect() if r.kept}
    assert set(ids[0]) == kept and len(ids[0]) == len(kept)
    assert set(ids[1]) <= kept and len(set(ids[1])) == len(ids[1]) < len(kept)
    leaks = {r.doc_id for r in QUERIES["op1_benchmark_decontamination"](spark, SMALL).collect()}
    assert set(ids[2]) == set(ids[1]) - leaks
    assert set(ids[3]) <= set(ids[2])
    words = [sum(len(r.text.split()) for r in t) for t in tables[2:4]]
    assert words[0] * 0.99 <= words[1] <= words[0]
    t = Tokenizer.from_file(tokenizer_path())
    want = sorted((r.doc_id, len(t.encode(r.text, add_special_tokens=False).ids) + 1) for r in tables[3])
    assert sorted((r.doc_id, r.n_tokens) for r in tables[4]) == want
