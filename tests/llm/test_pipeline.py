"""The stages of the corpus pipeline on planted cases, and edge cases of single operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelrisk.llm import mixing, quality, substring, token_files, vectors
from panelrisk.llm.store import shared_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, copies long, mix_source string, rate double"
#: Names that the stages use for columns of their own; each is -7 in every row.
CLASHES = ["_id", "_th", "_one", "_kept", "_bad_id", "_bad_th", "_mix", "_copy", "_target", "id", "th", "kept", "n", "score", "uid", "starts", "odd.name"]
SCHEMA += "".join(f", `{c}` long" for c in CLASHES)
GOOD, BAD = [f"fine{k}" for k in range(400)], [f"junk{k}" for k in range(60)]


def corpus():
    rng = random.Random(5)
    prose = lambda: " ".join(rng.choice(GOOD) for _ in range(120))
    junk = lambda: " ".join(rng.choice(BAD) for _ in range(120))
    item = " ".join(rng.choice(GOOD) for _ in range(14))
    texts = {k: prose() if k % 3 else junk() for k in range(300)}
    near = texts[1].split()
    near[60] = "changed"
    texts |= {300: " ".join(near), 301: texts[2], 302: texts[4] + " " + item.upper(), 303: None, 304: "", 305: prose() + " w" * 3000}
    rows = [(k, t, "en", f"s{k % 4}" if k % 9 else None, 0, 7, 0.5, 9, "x", 2.0, *[-7] * len(CLASHES)) for k, t in texts.items()]
    return rows + [rows[5]] * 2, [(k, int(k % 3 > 0)) for k in range(0, 300, 2)], item


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, item = corpus()
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("b1", item), ("b2", None), (None, "nowhere")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_on_planted_cases(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = shared_path(spark, "test-stage")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
        assert docs.where(" OR ".join(f"`{c}` IS DISTINCT FROM -7" for c in CLASHES)).isEmpty(), name
        kept.append([r["doc_id"] for r in docs.collect()])
    good, one, clean, mixed = (set(x) for x in kept)
    assert {k for k in range(300) if k % 3} | {300, 301, 302, 305} <= good and not good & {k for k in range(300) if not k % 3}
    assert {1, 2} <= one and not one & {300, 301} and len(kept[1]) == len(one)
    assert clean == one - {302}
    assert mixed <= clean
    sample = docs.where("size = 7 AND copies = 9 AND mix_source = 'x'")
    assert sample.count() == len(kept[3])  # own columns of clashing names come through
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert tokens.count() == len(kept[3]) and corpus_pipeline.run(spark, folder).count() == len(kept[3])


def test_words_removed_keep_columns_of_clashing_names(spark):
    passage = " ".join(GOOD[:70])
    rows = [(1, f"a {passage} b", *[-7] * len(CLASHES)), (2, f"c {passage} d", *[-7] * len(CLASHES)), (3, f"a {passage} b", *[-7] * len(CLASHES)), (None, None, *[-7] * len(CLASHES))]
    docs = spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", `{c}` long" for c in CLASHES))
    out = substring.deduplicated(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} == {rows[0], (2, "c d", *[-7] * len(CLASHES)), (3, "", *[-7] * len(CLASHES)), rows[3]}


def test_pipeline_of_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mix_of_rows_without_id_meets_its_targets(spark):
    rng = random.Random(1)
    rows = [(None, " ".join(rng.choice(GOOD) for _ in range(20)), f"s{k % 2}") for k in range(2000)]
    d = mixing.mix_digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.1 * r["target"] for r in d)


def test_training_sample_has_one_row_for_each_id(spark):
    docs = spark.createDataFrame([(k % 50, f"text {k % 50} {k}") for k in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 50, k % 2) for k in range(200)], "doc_id long, quality int")
    rows = quality.training_sample(docs, labels, 30).collect()
    assert 0 < len(rows) <= 30 and len({r["key"] for r in rows}) == len(rows)


def test_quality_score_is_the_margin_of_scaled_indicators(spark):
    """Scores again from the model by their definition: indicators times log-count ratios, unit length, linear, logistic."""
    rows, labels, _ = corpus()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    w, a, b = quality.fitted(docs, marks)
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs, marks).collect()}
    import pyarrow as pa

    for d, t, *_ in rows:
        (_, _, flags), *_ = list(quality.flagged(pa.array([t or ""])))
        own = np.flatnonzero(flags[0])
        margin, norm = w[0][own].sum(), w[1][own].sum()
        want = 1 / (1 + np.exp(-np.clip(a * margin / np.sqrt(max(norm, 1e-12)) + b, -30, 30)))
        assert abs(got[d] - want) < 1e-3, d


def test_token_files_have_row_index_and_skip_by_id(spark, folder):
    import glob

    from pyarrow import orc

    path = shared_path(spark, "test-tokens")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"))
    token_files.write_token_files(docs, path, stripe_bytes=64 << 10, index_stride=1000)
    files = [orc.ORCFile(f) for f in glob.glob(path.removeprefix("file:") + "/*.orc")]
    assert files and all(f.row_index_stride == 1000 for f in files) and sum(f.nrows for f in files) == 20_000
    found = token_files.read_token_files(spark, path, [17, 19_999, 20_001])
    assert sorted(r["doc_id"] for r in found.collect()) == [17, 19_999]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().executedPlan().toString()
    # Bloom filters: a stripe that an id is not in is skipped although its range holds the id, which row indexes alone cannot do
    odd = shared_path(spark, "test-tokens")
    spread = spark.range(40_000).select((2 * F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    token_files.write_token_files(spread, odd, index_stride=1000)
    kinds = [stream_kinds(f) for f in glob.glob(odd.removeprefix("file:") + "/*.orc")]
    assert kinds and all(("doc_id", "BLOOM_FILTER_UTF8") in k and ("doc_id", "ROW_INDEX") in k and ("ids", "BLOOM_FILTER_UTF8") not in k for k in kinds)
    assert token_files.read_token_files(spark, odd, [3, 777]).count() == 0 and token_files.read_token_files(spark, odd, [4]).count() == 1


def stream_kinds(path: str) -> set[tuple[str, str]]:
    """Column and kind of every stream that the stripe footers of an ORC file name, as its own tool prints them."""
    from pyspark.sql import SparkSession

    jvm = SparkSession.active()._jvm
    conf = jvm.org.apache.hadoop.conf.Configuration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    names, found, rows = {1: "doc_id", 2: "block", 3: "block_start", 4: "n_tokens", 5: "ids", 6: "ids"}, set(), reader.rows()
    stripes = reader.getStripes()
    for k in range(stripes.size()):
        streams = rows.readStripeFooter(stripes.get(k)).getStreamsList()
        for i in range(streams.size()):
            found.add((names.get(streams.get(i).getColumn(), "root"), streams.get(i).getKind().toString()))
    return found


@pytest.mark.parametrize(("kind", "per_cell", "broadcast"), [("double", 200, vectors.BROADCAST_CELLS), ("float", 10, 0)])
def test_recall_of_planted_links(spark, monkeypatch, kind, per_cell, broadcast):
    """10,000 vectors of 64 components; 600 links at cosines of 0.90 to 0.92, a third of them off in one half only."""
    monkeypatch.setattr(vectors, "PER_CELL", per_cell)
    monkeypatch.setattr(vectors, "BROADCAST_CELLS", broadcast)
    rng = np.random.default_rng(7)
    v = rng.standard_normal((10_000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    for k in range(600):
        c, noise = rng.uniform(0.9005, 0.92), rng.standard_normal(64)
        if k % 3 == 0:
            noise[32:] = 0
        noise -= (noise @ v[k]) * v[k]
        v[9_000 + k] = c * v[k] + np.sqrt(1 - c * c) * noise / np.linalg.norm(noise)
    v = v.astype(np.float32 if kind == "float" else np.float64).astype(np.float64)
    v_unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = np.zeros(len(v), np.int64)
    for k in range(0, len(v), 1000):
        want[k : k + 1000] = ((v_unit[k : k + 1000] @ v_unit.T) >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in vectors.vector_classes(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], f"vec_id long, embedding array<{kind}>")).select("vec_id", "n_links").collect()}
    found = np.array([got[k] for k in range(len(v))])
    assert (found <= want).all() and want.sum() >= 1190 and found.sum() / want.sum() >= 0.9
    print("recall", found.sum() / want.sum())
