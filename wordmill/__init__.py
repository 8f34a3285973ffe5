"""wordmill: full-text retrieval and link analysis as Spark DataFrame operators."""

from wordmill.operators.indexing import (  # noqa: F401
    Index,
    append_to_index,
    build_index,
    doc_freq,
    drop_versions,
    merge_index,
    min_df_filter,
    posting_lists,
    posting_lookup,
    read_index,
    term_counts,
    term_stats,
    write_index,
)
from wordmill.operators.linkgraph import html_edges, html_vertices, link_edges, link_graph, link_vertices  # noqa: F401
from wordmill.operators.pagerank import pagerank  # noqa: F401
from wordmill.operators.retrieval import Ranking, candidate_scores, query_terms, search, top_n  # noqa: F401
