"""The corpus pipeline against a brute-force version of its stages, each on its own input."""

import os
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from groundswell.llm import mixing, packing, quality
from groundswell.llm.queries import vocabulary

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(name, input, output)] of every stage, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, found = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(folder / name))
        out = spark.read.parquet(str(folder / name))
        found.append((name, docs, out))
        docs = out
    return {name: (before, after) for name, before, after in found}


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_order_and_columns(spark, stages):
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").dtypes
    for name in list(stages)[:-1]:
        assert stages[name][1].dtypes == columns


def test_quality_keeps_what_the_classifier_accepts(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = quality.quality_scores(before, labels)
    good = {r["doc_id"] for r in scores.where("predicted = 1").collect()}
    assert {d for d, _ in texts(after)} == good and 0 < len(good) < before.count()
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    clean = [d for d in known if known[d] == 1]
    assert sum(d in good for d in clean) > 0.97 * len(clean)


def test_lines(stages):
    before, after = stages["line_dedup"]
    want = brute.line_report(texts(before))
    assert {d: brute.sha(t) for d, t in texts(after)} == {d: w[2] for d, w in want.items()}


def test_near_duplicates(stages):
    before, after = stages["near_dedup"]
    want = brute.near_duplicates(texts(before), 80)  # the general rule: no contract names another
    assert sorted(d for d, _ in texts(after)) == sorted(d for d, w in want.items() if w[2])


def test_mixing(stages):
    before, after = stages["mixing"]
    rates = {
        r["doc_id"]: r["rate"] for r in mixing.mixing_rates(before, at_least=1.0).collect()
    }
    copies = Counter(d for d, _ in texts(after))
    assert set(copies) == set(rates)
    assert all(int(rates[d] + 1e-6) <= n <= int(rates[d]) + 1 for d, n in copies.items())
    tokens = Counter()
    for r in after.select("lang", "text").collect():
        tokens[r["lang"]] += len(r["text"].split())
    for lang, weight in mixing.TARGETS.items():
        assert abs(tokens[lang] / sum(tokens.values()) - weight) < 0.08


def test_packing(stages):
    before, after = stages["packing"]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    sizes = Counter()
    for _, text in texts(before):
        ids = len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        sizes.update([packing.LENGTH] * (ids // packing.LENGTH))
        sizes.update([ids % packing.LENGTH] if ids % packing.LENGTH else [])
    rows = after.collect()
    assert Counter(r["length"] for r in rows) == sizes
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in places.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= packing.LENGTH
    assert len(places) <= 1.02 * sum(r["length"] for r in rows) / packing.LENGTH + 1


def test_run_is_the_stages_in_a_row(spark, stages):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.dtypes == stages["packing"][1].dtypes
    key = lambda df: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    assert key(out) == key(stages["packing"][1])


def test_stages_on_odd_documents(spark, docs, no_docs):
    """Nulls, empty and long texts, repeated rows and clashing columns go through all stages."""
    for rows in (docs.union(docs.limit(5)), no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SMALL)
            if name != "packing":
                assert out.schema == rows.schema
            out.collect()
            rows = rows if name == "packing" else out


def test_run_goes_on_where_it_ended_and_cleans_up(spark, tmp_path, monkeypatch):
    calls = []

    def stage(name, fails=False):
        def run(session, docs, folder):
            calls.append(name)
            if fails:
                raise RuntimeError("executor gone")
            return docs.withColumn("text", F.concat("text", F.lit(name)))

        return name, run

    work = str(tmp_path / "work")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b", fails=True)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SMALL, work)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c")])
    done = corpus_pipeline.run(spark, SMALL, work)
    assert calls == ["a", "b", "b", "c"]
    assert done.where("text like '%abc'").count() == done.count() == 200
    folder = corpus_pipeline.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, SMALL).count() == 200
    (new,) = [d for d in set(os.listdir(folder)) - before if d.startswith("corpus-")]
    assert os.listdir(os.path.join(folder, new)) == ["c"]
