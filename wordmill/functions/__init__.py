from wordmill.functions.text import (  # noqa: F401
    STOP_WORDS,
    TOKEN_PATTERN,
    is_stop_word,
    raw_tokens,
    term_bucket,
    run_lengths,
    run_starts,
    title_of,
    tokenize,
    whitespace_word_count,
)
from wordmill.functions.scoring import (  # noqa: F401
    bm25_idf,
    harmonic_or_zero,
    pagerank_factor,
    round3,
    tfidf_idf,
)
