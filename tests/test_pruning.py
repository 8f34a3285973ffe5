"""Pruned search gives the rows of the full search, and joins few postings of a hot term."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordmill.operators.indexing import append_to_index, write_index
from wordmill.operators.pruning import pruned_scores, reached
from wordmill.operators.retrieval import Ranking, search

RNG = np.random.default_rng(4)
N = 900
# A hot term in more than a third of the documents, with few high counts; others from common to rare.
SHARE = np.array([0.45, 0.6, 0.2, 0.1, 0.05, 0.02, 0.01, 0.004])
TF = (RNG.random((N, 8)) < SHARE) * (1 + RNG.geometric(0.6, (N, 8)) + 6 * (RNG.random((N, 8)) < 0.03))
TERMS = [f"word{k}x" for k in range(8)]
QUERIES = [(0, "word0x"), (1, "word0x word1x"), (2, "word0x word5x"), (3, "word1x word2x word3x word4x"), (4, "word7x word0x word0x"),
           (5, "unknown"), (6, ""), (7, "word6x"), (8, " ".join(TERMS)), (9, "word2x word2x word5x unknown")]


@pytest.fixture(scope="module")
def frames(spark):
    texts = [(7 * k, f"t{k}", " ".join(np.repeat(TERMS, TF[k].astype(int))) + f" single{k}") for k in range(N)]
    docs = spark.createDataFrame(texts, "doc_id long, title string, text string")
    ranks = spark.createDataFrame([(7 * k, float(RNG.pareto(1.0))) for k in range(N) if k % 2], "id long, pagerank double")
    return docs, spark.createDataFrame(QUERIES, "query_id long, query string"), ranks


def results(df):
    return [(r.query_id, r.rank, r.doc_id, round(r.score, 9), r.title) for r in df.orderBy("query_id", "rank").collect()]


@pytest.fixture(scope="module")
def indexes(spark, frames, tmp_path_factory):
    docs, _, ranks = frames
    base = str(tmp_path_factory.mktemp("pruning"))
    yield_ = {"plain": write_index(docs, f"{base}/plain", min_df=3, block_size=16),
              "ranks": write_index(docs, f"{base}/ranks", min_df=3, pagerank=ranks, block_size=16)}
    write_index(docs.where("doc_id % 2 = 0"), f"{base}/parts", min_df=3, pagerank=ranks, block_size=16)
    yield_["parts"] = append_to_index(f"{base}/parts", docs.where("doc_id % 2 = 1"), f"{base}/parts", pagerank=ranks)
    return yield_


@pytest.mark.parametrize("kind,joined,ranking", [
    ("plain", True, Ranking(n=10)), ("ranks", False, Ranking(n=10)), ("parts", False, Ranking(n=25, length_norm=True)),
    ("plain", False, Ranking(n=2000))])
def test_same_rows_as_full_search(frames, indexes, kind, joined, ranking):
    _, queries, ranks = frames
    pr = ranks if joined else None
    full = results(search(queries, indexes[kind], pr, ranking))
    assert results(search(queries, indexes[kind], pr, ranking, prune=True)) == full and len(full) > 60


def test_few_postings_of_a_hot_term(frames, indexes):
    _, queries, _ = frames
    index, ranking = indexes["parts"], Ranking(n=10)
    left = {r.query_id: r.n for r in reached(queries, index, ranking=ranking).groupBy("query_id")
            .agg(F.count("*").alias("n")).collect()}
    df = {r.term: r.df for r in index.terms.collect()}
    assert df["word0x"] > N / 3 and left[0] < df["word0x"] / 2
    # The hot term's postings play no part where rarer terms fill the best ten.
    assert left[2] < df["word0x"] / 4 and left[4] < df["word0x"] / 2
    assert left[7] <= df["word6x"] and 5 not in left and 6 not in left


def test_refuses_what_the_bounds_do_not_cover(frames, indexes, spark):
    from wordmill.operators.indexing import build_index

    docs, queries, _ = frames
    with pytest.raises(ValueError):
        pruned_scores(queries, build_index(docs, min_df=3))
    with pytest.raises(ValueError):
        pruned_scores(queries, indexes["plain"], ranking=Ranking(w_bm25=-1.0))
