import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_mixing_quality_licences import slow_counts
from tests.llm.test_near_docs import groups
from tests.llm.test_tokens_packing import plain
from tributary.llm import line_dedup
from tributary.llm.common import durable, table

DIR = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def test_stages(spark):
    """Each stage against what its operator says of its input."""
    docs = before = table(spark, DIR, "documents")
    columns, seen = before.columns, []
    for name, stage in P.STAGES:
        after = durable(stage(spark, before, DIR))
        seen.append((name, before.collect(), after.collect()))
        before = after
        if name != P.STAGES[-1][0]:
            assert after.columns == columns
    _, raw, good = seen[0]
    counts = {r.doc_id: slow_counts(r.text or "") for r in raw}  # so few labels certify no cutoff
    assert {r.doc_id for r in good} == {d for d, (n, *_, repeated) in counts.items() if n >= 20 and 100 * repeated <= 30 * n} and 0 < len(good) < len(raw)
    _, _, cut = seen[1]
    gone = {r.doc_id: r.n_exact + r.n_near for r in line_dedup.line_report(spark.createDataFrame(good, docs.schema)).collect()}
    texts = {r.doc_id: r.text for r in good}
    assert all(texts[r.doc_id].count("\n") - r.text.count("\n") == gone[r.doc_id] for r in cut) and {r.doc_id for r in good if not gone[r.doc_id]} <= {r.doc_id for r in cut}
    _, _, one = seen[2]
    cut = sorted(cut, key=lambda r: r.doc_id)
    assert sorted(r.doc_id for r in one) == sorted({cut[i].doc_id for i in groups([r.text for r in cut])})
    _, _, mixed = seen[3]
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2 and {r.doc_id for r in mixed} <= {r.doc_id for r in one}
    _, _, pieces = seen[4]
    ids = plain("word_bpe_49k.json")
    assert Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == Counter((r.doc_id, len(ids(r.text or "")) + 1) for r in mixed)
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


@pytest.mark.parametrize("number", [0, 2])
def test_columns_of_any_name(spark, number):
    """A column that is called as one of an operator's own stays as it is."""
    docs = table(spark, DIR, "documents")
    names = ["_keep_id", "_keep_row", "_near_d", "_near_r", "_near_doc", "_near_row", "mine", "my_id", "my_hash", "row", "id", "hash", "of", "root", "name", "kept", "stratum", "rest"]
    wide = docs.select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names])
    stage = P.STAGES[number][1]
    got = stage(spark, wide, DIR)
    assert got.columns == wide.columns
    rows = got.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in stage(spark, docs, DIR).collect()} and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names)


def test_run(spark):
    got = P.run(spark, DIR)
    assert got.count() > 0 and "sequence_id" in got.columns
