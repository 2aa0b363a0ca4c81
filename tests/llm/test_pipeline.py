import corpus_pipeline
from pyspark.sql import functions as F

from txnlake.llm import pieces

from .data import MODEL, SF, docs
from .test_secret_scan import brute as secrets
from .test_simhash import brute_groups, brute_print


def test_run_against_brute_force(spark):
    """Every group of fingerprints at two or fewer bits keeps its first document."""
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()
            if any(c.isalpha() for c in r.text or "")]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    groups = brute_groups([brute_print(r.text) for r in rows], 2)
    firsts = {min(r.doc_id for r, h in zip(rows, groups) if h == g) for g in set(groups)}
    clean = {r.doc_id: r.text for r in rows if r.doc_id in firsts
             and not any(i in r.text for i in items)}
    assert set(got) <= set(clean) and len(got) >= 0.98 * len(clean)
    encoder = pieces.Encoder(pieces.Vocabulary(MODEL))
    for i, r in got.items():
        text = encoder.decode(r.ids)
        assert r.round_trip and not secrets(text)
        assert secrets(clean[i]) or text == clean[i] or "[SECRET]" in text


def test_stages_keep_columns_and_take_odd_tables(spark):
    df = docs(spark, [None, "", "12", "a b c", "a b c", "x"]).withColumn("__fp", F.lit(1))
    for table in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == table.columns
            out.count()


def test_registered():
    import __spark_entry__
    found = __spark_entry__.queries()
    assert "pipeline" in found
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in found) == 1
