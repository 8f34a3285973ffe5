import json

from wordmill.operators.relevance import passage_qrels
from wordmill.sources.corpus import read_relevance_json

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. Then it sleeps."),
    (2, "A quick brown fox jumps over the lazy dog"),
    (3, "brown fox jumps"),
    (4, "xquick brown fox jumps over the lazy dogs"),
    (5, "Nothing here at all"),
    (6, "ΑΣ fox"),
    (7, None),
    (2, "A quick brown fox jumps over the lazy dog"),  # repeated id, same text
    (9, "one 😀 xy"),
    (8, "quick quick brown lazy"),
    (8, "fox jumps over the dog"),  # repeated id, anchors split over two rows
]
PASSAGES = [
    (100, "quick brown fox jumps over the lazy dog"),
    (101, "brown fox"),           # no interior token: scanned directly
    (102, "fox"),                 # single word
    (103, "over the lazy"),       # interior token is a stop word only
    (104, "not in any document at all"),
    (106, ""),                    # in every text
    (107, " "),
    (108, "😀 x"),
    (109, None),                  # as empty
    (105, "uick brown fox jumps over the lazy do"),  # cut words at both edges
]


def test_passage_qrels_matches_brute_force(spark):
    corpus = spark.createDataFrame(TEXTS, "doc_id long, text string")
    passages = spark.createDataFrame(PASSAGES, "query_id long, passage string")
    want = sorted({(q, d) for q, p in PASSAGES for d, t in TEXTS if (p or "") in (t or "")})
    for most in (1 << 20, 0):  # with sides broadcast, and with none
        found = passage_qrels(passages, corpus, max_broadcast_bytes=most)
        assert sorted(tuple(r) for r in found.collect()) == want


def test_relevance_json_whole_file(spark, scratch):
    path = f"{scratch}/q.json"
    with open(path, "w") as f:
        json.dump({"query one": ["5", "7"], "query two": ["68076992"]}, f)
    got = sorted(tuple(r) for r in read_relevance_json(spark, path).collect())
    assert got == [("query one", 5), ("query one", 7), ("query two", 68076992)]


def test_relevance_json_lines(spark, scratch):
    path = f"{scratch}/q.jsonl"
    with open(path, "w") as f:
        f.write(json.dumps({"q1": ["1", "2"]}) + "\n" + json.dumps({"q1": ["3"], "q2": []}) + "\n")
    got = sorted(tuple(r) for r in read_relevance_json(spark, path, whole_file=False).collect())
    assert got == [("q1", 1), ("q1", 2), ("q1", 3)]


def test_terms_of_passages_are_not_held_in_memory(spark, monkeypatch):
    """No write while judgements are found finds a persisted frame, and what is stored meanwhile is gone in the end."""
    import os

    from pyspark.sql import DataFrameWriter

    from wordmill.session import checkpoint_dir

    persisted = lambda: len(spark.sparkContext._jsc.getPersistentRDDs())
    held, before, written = [], persisted(), DataFrameWriter.parquet

    def watching(self, target, *a, **kw):
        out = written(self, target, *a, **kw)
        held.append(persisted())
        return out

    monkeypatch.setattr(DataFrameWriter, "parquet", watching)
    docs = spark.createDataFrame([(1, "one apple pear plum two"), (1, "an apple pear plum"), (2, "apple plum pear"), (3, None)],
                                 "doc_id long, text string")
    passages = spark.createDataFrame([(7, "apple pear plum"), (8, "apple plum"), (9, "nothing of this")],
                                     "query_id long, passage string")
    got = passage_qrels(passages, docs)
    assert sorted(tuple(r) for r in got.collect()) == [(7, 1), (8, 2)]
    assert held and max(held) <= before
    assert not [f for f in os.listdir(checkpoint_dir(spark).removeprefix("file:")) if f.startswith("wordmill-passage-terms-")]
