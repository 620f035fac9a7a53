"""Ids of any kind, columns with any name, vectors of any length, and the classifiers as they ship."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import embedding_dedup, mixing, ngram_join, toxicity
from spanforge.llm.stage import crc_fold

CLASH = "doc_id string, text string, source string, m_id long, m_nth long, m_copies long, m_key long, judged_id string, judged_key long, row string, row_id long, row_key long, nth int, kept_text_key long"


def clashing(spark):
    words = " ".join(f"w{k}" for k in range(40))
    rows = [("b", words, "s"), ("a", words, "s"), ("c", "other words entirely " * 3, None), (None, "", "t"), ("d", None, "t"), ("c", "other words entirely " * 3, None)]
    return spark.createDataFrame([(*r, 7, 7, 7, 7, "j", 7, "r", 7, 7, 7, 7) for r in rows], CLASH)


def test_near_copies_under_text_ids_and_clashing_names(spark):
    docs = clashing(spark)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(docs).collect()}
    assert got == {("a", 36, "a"), ("b", 36, "a"), ("c", 3, "c"), (None, 0, None), ("d", 0, "d")}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted(r["doc_id"] or "" for r in kept.collect()) == ["", "a", "c", "d"] and {r["m_nth"] for r in kept.collect()} == {7}


def test_mix_leaves_clashing_columns_alone(spark):
    docs = clashing(spark)
    mixed = mixing.mix(docs).collect()
    want = {r["doc_id"]: 0 for r in mixed}
    for r in mixing.copies_by_source(docs).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    got = {k: sum(r["doc_id"] == k for r in mixed) for k in want}
    assert got == want and all(tuple(r)[3:] == (7, 7, 7, 7, "j", 7, "r", 7, 7, 7, 7) for r in mixed)
    assert mixing.mix(docs).schema == docs.schema


def test_vectors_of_each_length_link_among_themselves(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.standard_normal(3)]) for k in range(30)] + [(100, [1.0, 1.0]), (101, [1.0, 1.0001]), (102, [1.0, -1.0]), (103, [5.0]), (104, [2.0]), (105, [-2.0]), (106, []), (107, None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    held = {k: np.array(v) for k, v in rows if v}
    for k, v in held.items():
        links = [j for j, w in held.items() if j != k and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95]
        assert got[k][0] == len(links)
    assert got[101] == (1, 100) and got[104] == (1, 103) and got[102] == (0, 102) and got[106] == (0, 106) and got[107] == (0, 107)


def test_toxicity_as_it_ships_on_labels_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels.filter("toxic in (0, 1)").select("doc_id", "toxic"), "doc_id").filter(crc_fold(F.col("doc_id"), 5) == 0)
    got = toxicity.score(held, toxicity.train(docs, labels), keep=("doc_id", "toxic")).toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"])
    hit = (got["score"] >= 0.5) & (got["toxic"] == 1)
    p = got["score"].clip(1e-12, 1 - 1e-12)
    assert hit.sum() >= 0.78 * (got["toxic"] == 1).sum() and ((got["score"] >= 0.5) & (got["toxic"] == 0)).sum() <= 0.01 * len(got)
    assert -np.where(got["toxic"] == 1, np.log(p), np.log(1 - p)).mean() < 0.09
    rank = got["score"].rank()
    positive = rank[got["toxic"] == 1]
    assert (positive.mean() - (len(positive) + 1) / 2) / (len(got) - len(positive)) == pytest.approx(0.99, abs=0.01)
