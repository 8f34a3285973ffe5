from pyspark.sql import functions as F

from wordmill.functions.text import STOP_WORDS, raw_tokens, term_bucket, tokenize, whitespace_word_count

CASES = [
    ("a" * 60, ["a" * 25, "a" * 25, "a" * 10]),
    ("don't stop-me @now #tag x-y-z a--b o'neil's it's ab abc",
     ["don't", "stop-me", "@now", "#tag", "x-y-z", "o'neil's", "it's", "abc"]),
    ("x²y ½½½ éclair ΑΣΙΑΣ İstanbul", ["x²y", "½½½", "éclair", "ασιας", "stanbul"]),
    ("foo_bar __ ___ #ab #a @1", ["foo_bar", "___", "#ab"]),
    ("-abc 'abc' abc'", ["abc", "abc", "abc"]),
    ("e-" * 30 + "e", ["-".join(["e"] * 25), "-".join(["e"] * 6)]),
]


def test_raw_token_goldens(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["toks"] for r in df.select("i", raw_tokens("t").alias("toks")).collect()}
    for i, (_, want) in enumerate(CASES):
        assert got[i] == want, CASES[i][0]


def test_stop_words_removed_after_matching(spark):
    df = spark.createDataFrame([("The cat and THE hat; it's history, thumb-war",), (None,)], "t string")
    got = [r[0] for r in df.select(tokenize("t")).collect()]
    assert got == [["cat", "hat", "thumb-war"], []]


def test_stop_list_size():
    assert len(STOP_WORDS) == 200
    assert "became" in STOP_WORDS and "don't" in STOP_WORDS


def test_whitespace_count_matches_python(spark):
    texts = ["a  b\tc\n", "", "  ", "x y z", "one\x1ctwo", "é ü"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(whitespace_word_count("t")).collect()]
    assert got == [len(t.split()) for t in texts]


def test_bucket_is_md5_prefix(spark):
    import hashlib

    got = spark.range(1).select(term_bucket(F.lit("abc"), 124)).first()[0]
    assert got == int(hashlib.md5(b"abc").hexdigest()[:10], 16) % 124 == 44


def test_java_pattern_equals_plain_pattern(spark):
    from wordmill.functions.text import TOKEN_PATTERN, TOKEN_PATTERN_JAVA

    texts = [t for t, _ in CASES] + ["it'-s a-'b x''y --abc-- a'b'c'd'e'f", "ab'", "abc'", "a-b-", "#1a @@bc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = [r[0] for r in df.select(F.regexp_extract_all(F.lower("t"), F.lit(TOKEN_PATTERN), 0)).collect()]
    fast = [r[0] for r in df.select(F.regexp_extract_all(F.lower("t"), F.lit(TOKEN_PATTERN_JAVA), 0)).collect()]
    assert plain == fast


def test_word_count_splits_where_python_does(spark):
    """At every code point, and, in tasks side by side, no slower than the tokenizer by much."""
    import time

    from wordmill.functions.text import raw_tokens, whitespace_word_count

    marks = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    texts = ["a" + m + "b" + m for m in marks] + ["", " ", None, "one 😀  two\u3000three\x1c"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    got = [r.n for r in rows.select("k", whitespace_word_count("t").alias("n")).orderBy("k").collect()]
    assert got == [len((t or "").split()) for t in texts]

    long = spark.range(0, 800, 1, 8).selectExpr("repeat('quelques mots d’un texte, несколько слов; ', 2000 + id % 2) t")

    def seconds(column):
        def once():
            began = time.perf_counter()
            long.select(column).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - began

        return min(once() for _ in range(3))

    from pyspark.sql import functions as F

    assert seconds(whitespace_word_count("t")) < 4 * seconds(F.size(raw_tokens("t")))
