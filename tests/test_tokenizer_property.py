import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wordmill.functions.text import raw_tokens

# The rule as Python states it: first char '#', '@' or a word char, then 2-24
# repeats of an optional apostrophe/hyphen and a word char.
PY_RULE = re.compile(r"""[\#\@\w](['\-]?\w){2,24}""", re.UNICODE)

ALPHABET = "abcXYZ019_ '-#@.,;\n\téèüßñçΩωж中²½"
texts = st.lists(st.text(alphabet=ALPHABET, max_size=80), min_size=1, max_size=60)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(texts)
def test_tokenizer_matches_python_rule(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    got = {r["i"]: r["toks"] for r in df.select("i", raw_tokens("t").alias("toks")).collect()}
    for i, t in enumerate(batch):
        want = [m.group() for m in PY_RULE.finditer(t.lower())]
        assert got[i] == want, repr(t)
