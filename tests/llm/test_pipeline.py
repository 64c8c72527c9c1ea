"""The pipeline's stages take effect, in order, on all that the stage before kept."""

import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from arbora.llm import langid, packing, quality, simhash, substring
from arbora.plans import shared_dir, stash


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[-1] == "packing"
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stash(stage(spark, seen[-1], sf), "stage"))
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(d.columns == docs.columns for d in seen[:-1])
    good = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert ids[1] == good and ids[1] < ids[0]
    known = {r.doc_id for r in langid.identify(seen[1]).where("accepted").collect()}
    assert ids[2] == known
    groups = {r.doc_id: r.component_id for r in simhash.simhash_groups(seen[2]).collect()}
    assert ids[3] == set(groups.values()) and ids[4] == ids[3]
    digest = {r.doc_id: r for r in substring.substring_digest(seen[3]).collect()}
    for r in seen[4].collect():
        assert len(r.text.split()) <= digest[r.doc_id].n_words - digest[r.doc_id].n_removed and r.n_chars == len(r.text)
    tok = Tokenizer.from_file(packing.word_bpe_path())
    packed = seen[5].toPandas().sort_values(["doc_id", "start"])
    assert set(packed.doc_id) == ids[4]
    for r in seen[4].collect():
        own = np.frombuffer(b"".join(packed[packed.doc_id == r.doc_id].ids), "<u4").tolist()
        assert own == tok.encode(r.text, add_special_tokens=False).ids + [2]


def test_odd_rows_go_through_every_stage(spark, sf):
    """Null ids and texts, repeated rows, a very long text, empty tables, and extra columns with the operators' own names."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = docs.where("text is not null and length(text) > 600").orderBy("doc_id").first()
    long = " ".join(f"{w}{i % 7}" for i, w in enumerate(one.text.split() * 3000))
    odd = [(None, one.text, one.lang), (None, None, None), (10**9, None, "en"), (10**9 + 1, "", "en"), (10**9 + 2, long, one.lang), (10**9 + 3, "x " * 50, None), (one.doc_id, one.text, one.lang), (10**9 + 4, "12 34", None)]
    more = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in odd], "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ("row", "key", "key2", "at", "h", "rate", "label", "id", "hash", "fp", "ids", "start", "score", "held_out")
    table = docs.unionByName(more.select(*[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])).withColumns({c: F.lit(c) for c in clashing})
    seen = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stash(stage(spark, seen, sf), "stage")
        assert seen.columns == table.columns, name
        assert seen.where(" or ".join(f"{c} <> '{c}'" for c in clashing)).count() == 0
    rows = seen.collect()
    assert all(r.text is not None for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in rows}
    empty = table.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_run_leaves_only_its_result(spark, sf):
    base = Path(shared_dir(spark).removeprefix("file://")) / "arbora"
    before = set(base.iterdir()) if base.exists() else set()
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 100 and len(set(base.iterdir()) - before) == 1


def test_whole_run_is_registered(spark, sf):
    got = entry.queries()["pipeline"](spark, sf)
    assert got.count() > 100 and set(corpus_pipeline.packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).columns) < set(got.columns)


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(entry.oracle_sql()) <= set(names)


def test_a_named_run_goes_on_after_its_last_stage(spark, sf, monkeypatch):
    calls, broken = [], [True]

    def stage(k):
        def run(spark, docs, sf_dir):
            calls.append(k)
            if k == 2 and broken[0]:
                raise RuntimeError("lost")
            return docs.withColumn(f"stage_{k}", F.lit(k))

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), stage(k)) for k in range(4)])
    name = uuid.uuid4().hex
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, sf, name)
    broken[0] = False
    out = corpus_pipeline.run(spark, sf, name)
    assert calls == [0, 1, 2, 2, 3] and out.columns[-4:] == [f"stage_{k}" for k in range(4)]
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert out.count() == n and corpus_pipeline.run(spark, sf, name).count() == n and len(calls) == 5
    assert corpus_pipeline.run(spark, sf).count() == n and len(calls) == 9
