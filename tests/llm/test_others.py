"""Search, archives, classifiers, components and the pipeline."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from benchloom.llm import language, quality, toxicity, topk, warc
from benchloom.llm.components import components
from benchloom.llm.frames import held_out
from benchloom.llm.workers import importable

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def _workers(spark):
    importable(spark)


@pytest.mark.parametrize("sizes", [(1024, 8192), (3, 7)])
def test_top_k_against_brute_force(spark, sizes):
    draw = random.Random(5)
    rows = [(k, [draw.choice([-1.0, -0.3, 0.1, 0.7]) for _ in range(4)]) for k in range(60)]
    rows += [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [float("nan")] * 4), (63, [float("inf")] * 4), (40, rows[40][1]), (64, []), (80, [0.5, 0.5]), (100, [1e6] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(frame.where("vec_id % 20 = 0"), frame, k=5, query_block=sizes[0], shard_rows=sizes[1])
    good = [(k, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for k, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in good:
        if q % 20 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), k) for k, w in good if k != q and len(w) == len(v)))[:5]
            want |= {(q, i + 1, k, -s) for i, (s, k) in enumerate(scored)}
    assert {tuple(r) for r in got.collect()} == want
    assert topk.top_k(frame.limit(0), frame).count() == 0 and topk.top_k(frame, frame.limit(0)).count() == 0


def test_products_stay_exact():
    big = np.array([[2**40, 3]])
    assert topk._products(big, np.array([[5, 7]]))[0, 0] == 5 * 2**40 + 21
    assert topk._products(np.array([[2**31, 1]]), np.array([[2**31, -1]]))[0, 0] == 2**62 - 1
    with pytest.raises(OverflowError):
        topk._products(np.array([[2**40]]), np.array([[2**40]]))


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 3)
    big = "WARC/1.0\r\n\r\nß" * 20
    rows = [(3, "http://www.B.org/x#f", big), (1, "https://b.org/x", big), (2, "http://a.org", None), (4, "http://a.org/?q=1", ""), (5, None, "short"),
            (6, "http://b.org/x\r\nInjected: y", "short"), (7, "not a url [", big + "\r\n\r\n"), (8, "http://b.org/x", big), (8, "http://b.org/x", big), (None, "http://c.org/", "n" * 120)]
    got = warc.archive_history(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("history_seq").collect()
    assert [r.history_seq for r in got] == list(range(1, len(rows) + 1))
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest) for r in got) == sorted(
        (k or 0, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for k, _, h in rows)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds == {1: ("response", None), 3: ("revisit", 1), 8: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), None: ("response", None)}
    keys = [(r.url_key, r.capture_ts, r.page_id or 2**63) for r in got]
    assert keys == sorted(keys) and [r.capture_no for r in got if r.url_key == "org,b)/x"] == [1, 2, 3, 4]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_history(empty).count() == 0


def test_loser_tree():
    draw = random.Random(1)
    for n in range(8):
        runs = [sorted((draw.randrange(20),) for _ in range(draw.randrange(6))) for _ in range(n)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(labels[a] == labels[b] for a, b in links if a != b)
    assert len({labels[k] for k in range(1000, 1061)}) == 1
    import itertools
    parent = {k: k for k in labels}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.filterfalse(lambda x: x[0] == x[1], links):
        parent[root(a)] = root(b)
    assert len({root(k) for k in labels}) == len(set(labels.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels")}


def odd_rows(spark, docs):
    return docs.unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "", "", "", 0), (-3, "123 !!", "en", "s", 6), (None, "x", None, "s", 1)], docs.schema))


@pytest.mark.parametrize("most", [200_000, 0])
def test_archives_with_hot_payload_and_url(spark, monkeypatch, most):
    """A third of all pages have one payload and one url, a third are empty; lookups by broadcast and by slices agree."""
    monkeypatch.setattr(warc.skew, "BROADCAST_ROWS", most)
    error = "<html>" + "not found " * 20
    rows = [(k, "http://a.org/e", error) for k in range(100)] + [(200 + k, f"http://b.org/{k}", None) for k in range(100)]
    rows += [(400 + k, f"http://c.org/{k % 50}", f"<p>{k % 80} " + "x" * 120) for k in range(100)]
    got = warc.archive_history(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    first, seen = {}, {}
    for k, _, html in rows:
        if len(html or "") >= 100:
            first.setdefault(html, k)
    for k, url, html in rows:
        of = first.get(html)
        seen.setdefault(url, []).append(k)
        want = ("revisit", of) if of is not None and of != k else ("response", None)
        row = next(r for r in got if r.page_id == k)
        assert (row.record_type, row.refers_to, row.payload_bytes, row.capture_no) == (*want, len(html or ""), len(seen[url]))
    assert sorted(r.history_seq for r in got) == list(range(1, 301))


def test_language_frequencies_are_those_of_all_texts(spark, tables, monkeypatch):
    """Centroids take a sample; document frequencies take every training text, and every language is learnt."""
    monkeypatch.setattr(language, "TEXTS_PER_LANGUAGE", 15)
    docs = tables["documents"].select("doc_id", "text", "lang").union(spark.createDataFrame(
        [(-1 - i, f"zq xqj {i} qzx", f"rare{i}") for i in range(3)] + [(-9, "qqq same", "hot")] * 60, "doc_id long, text string, lang string"))
    model = language.fit(docs)
    known = [r.text for r in docs.collect() if r.lang is not None and any(c.isalpha() for c in r.text or "")]
    df = sum((language.trigrams(pa.array([t])) > 0)[0].astype(int) for t in known)
    assert np.allclose(model.idf, np.log((1 + len(known)) / (1 + df)) + 0.05, atol=1e-5)
    assert {"hot", "rare0", "rare1", "rare2"} <= set(model.languages)


def test_language_held_out_accuracy(spark, tables):
    docs = odd_rows(spark, tables["documents"])
    model = language.fit(docs.where(~held_out()))
    found = language.identify(docs, model, reject=False).where("doc_id >= 0")
    assert found.where(held_out()).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = {r.doc_id: r for r in language.identify(docs, model).where("doc_id < 0").collect()}
    assert all(odd[k].lang_pred == "und" and odd[k].score == 0 for k in (-1, -2, -3))
    assert language.fit(docs.limit(0)) is None
    assert language.identify(docs, None).where("lang_pred != 'und'").count() == 0
    with pytest.raises(ValueError):
        language.identify(docs.withColumn("Score", F.lit(1)), model)


def test_toxicity_finds_held_out_words(spark):
    draw = random.Random(3)
    rows, labels = [], []
    for k in range(1200):
        words = [draw.choice("abcdefgh") * draw.randint(1, 4) for _ in range(draw.randint(3, 60))]
        toxic = k % 8 == 0
        if toxic:
            words[draw.randrange(len(words))] = draw.choice(["grummel", "zonkel"]) + draw.choice(["", "ei", "ab"])
        rows.append((k, " ".join(words)))
        if k % 2 == 0:
            labels.append((k, int(toxic)))
    labels += [(5000, 1), (3, None)]
    docs = spark.createDataFrame(rows + [(-1, None), (-2, "")], "doc_id long, text string")
    model = toxicity.fit(docs.where(~held_out()), spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    right = [(scored[k] >= toxicity.THRESHOLD) == (k % 8 == 0) for k, _ in rows]
    assert sum(right) / len(right) > 0.98 and scored[-1] == scored[-2] < toxicity.THRESHOLD
    assert toxicity.drop_toxic(docs.withColumn("toxicity", F.lit("x")), model).columns == ["doc_id", "text", "toxicity"]
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert toxicity.score(docs, None).agg(F.max("score")).first()[0] == 0


def test_quality_of_texts_that_differ_in_words_alone(spark):
    """Words of one length without marks, and the same metadata: form tells nothing."""
    draw = random.Random(3)
    common = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    good, bad = (["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(40)] for _ in range(2))
    rows = [(k, " ".join(draw.choice((good, bad)[k % 2] if i % 4 == 0 else common) for i in range(60)), "s", "en", 419, 1 - k % 2) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, quality int")
    model = quality.fit(docs.where("doc_id < 600").drop("quality"), docs.select("doc_id", "quality"))
    held = quality.score(docs.where("doc_id >= 600"), model).agg(
        F.avg(((F.col("text_score") >= 0.5) == (F.col("quality") == 1)).cast("int")), F.avg(((F.col("score") >= 0.5) == (F.col("quality") == 1)).cast("int"))).first()
    assert min(held) > 0.9


def test_quality_held_out_accuracy(spark, tables):
    docs = odd_rows(spark, tables["documents"])
    model = quality.fit(docs.where(~held_out()), tables["labels"])
    scored = quality.score(docs, model)
    assert scored.count() == docs.count() and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    held = scored.join(tables["labels"], "doc_id").where(held_out())
    assert held.agg(F.avg(((F.col("score") >= 0.5) == (F.col("quality") == 1)).cast("int"))).first()[0] > 0.88
    assert quality.fit(docs, tables["labels"].limit(0)) is None


def test_co_training_uses_the_other_view():
    draw = np.random.default_rng(1)
    y = (np.arange(3000) % 2).astype(float)
    text = (y * 2 - 1)[:, None] * 1.5 + draw.normal(size=(3000, 3))
    page = (y * 2 - 1)[:, None] * 1.0 + draw.normal(size=(3000, 2))
    few = np.r_[0:24]
    model = quality.co_train(text[few], page[few], y[few], text[24:2000], page[24:2000])
    both = model.views(text[2000:], page[2000:])[2]
    assert ((both > 0.5) == (y[2000:] > 0.5)).mean() > 0.93


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "mixing":
            assert out.dtypes == docs.dtypes, name
        out = spark.createDataFrame(out.toArrow())
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100
    assert len(corpus_pipeline.STAGES) == 5


def test_a_repeated_query_is_one_query(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [0.1, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id) for r in topk.top_k(table.where("vec_id = 20"), table, k=2).collect()]
    assert sorted(got) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("cell", [(8, 4), (1, 2)])
def test_no_tile_is_broadcast_and_cells_give_what_tiles_give(spark, monkeypatch, cell):
    """Small compressed tables were joined by a broadcast of all copies of the query blocks, which the driver builds."""
    monkeypatch.setattr(topk, "CELL_BLOCKS", cell[0])
    monkeypatch.setattr(topk, "CELL_SHARDS", cell[1])
    draw = random.Random(8)
    rows = [(k % 190, [draw.choice([-2.0, 0.5, 0.1, 300.0 if k % 7 == 0 else 1.0]) for _ in range(3)]) for k in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.top_k(frame.where("vec_id % 10 = 0"), frame, k=4, query_block=5, shard_rows=20)
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan and "FlatMapCoGroupsInPandas" in plan
    good = [(k, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for k, v in rows]
    want = set()
    for q, v in good:
        if q % 10 == 0 and sum(k == q for k, _ in good) == 1:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), k) for k, w in good if k != q)[:4]
            want |= {(q, i + 1, k, -s) for i, (s, k) in enumerate(scored)}
    assert {tuple(r) for r in found.collect() if sum(k == r.query_id for k, _ in good) == 1} == want
