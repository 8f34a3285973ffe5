"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Built from shared CTE fragments; the tokenizer, stop list, bucket and link
rules are rendered from the same fixed values the Spark side uses.
"""

from __future__ import annotations

from wordmill.functions.scoring import OFF_TIES
from wordmill.functions.text import PY_WHITESPACE, STOP_WORDS, TOKEN_PATTERN
from wordmill.operators.indexing import MIN_DF, NUM_BUCKETS
from wordmill.operators.linkgraph import HREF_PATTERN, ID_HEX_DIGITS

ROUND = 6


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP_SQL = "[" + ", ".join(_q(w) for w in STOP_WORDS) + "]"
PAT_SQL = _q(TOKEN_PATTERN)
WS_CLASS = PY_WHITESPACE


def raw_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower(coalesce({expr}, '')), {PAT_SQL}, 0)"


def tokens(expr: str) -> str:
    return f"list_filter({raw_tokens(expr)}, lambda t: NOT list_contains({STOP_SQL}, t))"


def word_count(expr: str) -> str:
    return (f"len(list_filter(regexp_split_to_array(coalesce({expr}, ''), {_q(WS_CLASS)}), "
            f"lambda w: w <> ''))")


def round3(x: str) -> str:
    """Python's ``round(x, 3)``: half to even, but for the listed ties."""
    off = ", ".join(map(str, OFF_TIES))
    q = f"round(({x}) * 2000)"
    return (f"CASE WHEN {q} / 2000 = ({x}) AND CAST({q} AS BIGINT) IN ({off}) "
            f"THEN round_even({q} / 1000 - round_even({x}, 3), 3) ELSE round_even({x}, 3) END")


def bucket(expr: str, n: int = 124) -> str:
    return f"CAST((('0x' || substr(md5({expr}), 1, 10))::BIGINT % {n}) AS INTEGER)"


CORPUS = "corpus AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS text FROM documents)"
COUNTS = (f"doc_toks AS (SELECT doc_id, unnest({tokens('text')}) AS term FROM corpus), "
          "counts AS (SELECT term, doc_id, count(*) AS tf FROM doc_toks GROUP BY term, doc_id)")


def terms_cte(md: int) -> str:
    return (f"terms AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS term_total, {bucket('term')} AS bucket "
            f"FROM counts GROUP BY term HAVING count(*) > {md})")


def base(md: int) -> str:
    return f"WITH {CORPUS}, {COUNTS}, {terms_cte(md)}, nd AS (SELECT count(DISTINCT doc_id) AS n FROM corpus)"


QTOK = (f"qtk AS (SELECT item_id AS query_id, {tokens('text')} AS tk FROM benchmark), "
        "qpos AS (SELECT query_id, unnest(tk) AS term, unnest(range(len(tk))) AS pos FROM qtk), "
        "qtok AS (SELECT query_id, term, count(*) AS qtf, min(pos) AS first_pos FROM qpos GROUP BY query_id, term), "
        "qterms AS (SELECT q.query_id, q.term, q.qtf, q.first_pos, t.df, "
        "log10(nd.n / t.df) AS idf_tfidf, log10((nd.n - t.df + 0.5) / (t.df + 0.5)) AS idf_bm25 "
        "FROM qtok q JOIN terms t USING (term), nd)")

ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*:)"


def _resolve(url: str, href: str) -> str:
    directory = f"regexp_replace(regexp_replace({url}, '[?#].*$', ''), '[^/]*$', '')"
    return (f"CASE WHEN regexp_matches({href}, {_q('^[A-Za-z][A-Za-z0-9+.\\-]*:')}) THEN {href} "
            f"WHEN starts_with({href}, '//') THEN regexp_extract({url}, {_q(SCHEME)}, 1) || {href} "
            f"WHEN starts_with({href}, '/') THEN regexp_extract({url}, {_q(ORIGIN)}, 1) || {href} "
            f"ELSE {directory} || {href} END")


def url_id(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, {ID_HEX_DIGITS}))::BIGINT"


def _canonical(url: str) -> str:
    """No fragment; dot segments of the path taken out one after the other."""
    plain = f"split_part({url}, '#', 1)"
    origin = f"regexp_extract({plain}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')"
    path = f"split_part(substr({plain}, length({origin}) + 1), '?', 1)"
    parts = f"string_split(regexp_replace({path}, '(/[.][.]?)$', '\\1/'), '/')[2:]"
    kept = (f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({parts}, lambda s: [s])), lambda a, x: "
            "CASE x[1] WHEN '.' THEN a WHEN '..' THEN a[1:len(a) - 1] ELSE list_concat(a, x) END)")
    query = f"substr({plain}, length({origin}) + length({path}) + 1)"
    return (f"CASE WHEN {origin} = '' THEN {plain} WHEN contains({path}, '/.') "
            f"THEN {origin} || '/' || array_to_string({kept}, '/') || {query} ELSE {plain} END")


def _decoded(href: str) -> str:
    for name, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&amp;", "&")):
        href = f"replace({href}, '{name}', '{character}')"
    return href


LINKS = (f"hrefs AS (SELECT page_id AS src, url, unnest(regexp_extract_all(coalesce(html, ''), {_q(HREF_PATTERN)}, 1)) "
         "AS raw FROM pages), "
         f"parted AS (SELECT src, url, split_part({_decoded('raw')}, '#', 1) AS href FROM hrefs), "
         "resolved AS (SELECT src, CASE WHEN href = '' THEN url WHEN href LIKE '?%' THEN "
         f"regexp_extract(url, '^[^?#]*') || href ELSE {_resolve('url', 'href')} END AS u FROM parted), "
         f"links AS (SELECT src, {_canonical('u')} AS target_url FROM resolved), "
         f"known AS (SELECT {_canonical('url')} AS url, min(page_id) AS page_id FROM pages GROUP BY ALL), "
         "edges AS (SELECT DISTINCT l.src, coalesce(p.page_id, " + url_id("l.target_url") + ") AS dst "
         "FROM links l LEFT JOIN known p ON p.url = l.target_url), "
         "vertices AS (SELECT page_id AS id FROM pages UNION SELECT dst FROM edges)")

PARTS = ("li AS (SELECT l_orderkey, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey "
         "ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem), "
         "edges AS (SELECT DISTINCT src, dst FROM li WHERE dst IS NOT NULL), "
         "vertices AS (SELECT DISTINCT l_partkey AS id FROM lineitem)")


def pagerank_ctes(prefix: str, iterations: int = 6, reset: float = 0.15) -> str:
    """Rank CTEs over ``edges``/``vertices``; the final CTE is ``{prefix}`` with ``id, pagerank``."""
    parts = [f"{prefix}_w AS (SELECT e.src, e.dst, 1.0 / o.c AS w FROM edges e JOIN "
             f"(SELECT src, count(*) AS c FROM edges GROUP BY src) o USING (src))",
             f"{prefix}_r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM vertices)"]
    for i in range(1, iterations + 1):
        parts.append(
            f"{prefix}_r{i} AS (SELECT v.id, {reset} + {1 - reset} * coalesce(s.s, 0.0) AS rank FROM vertices v "
            f"LEFT JOIN (SELECT w.dst, sum(r.rank * w.w) AS s FROM {prefix}_w w JOIN {prefix}_r{i - 1} r "
            f"ON w.src = r.id GROUP BY w.dst) s ON v.id = s.dst)")
    last = f"{prefix}_r{iterations}"
    parts.append(f"{prefix} AS (SELECT id, rank * (SELECT count(*) FROM vertices) / (SELECT sum(rank) FROM {last}) "
                 f"AS pagerank FROM {last})")
    return ", ".join(parts)


def scores_ctes(with_rank: bool) -> str:
    """``scored(query_id, doc_id, first_pos, tfidf, bm25, pr, tfidf_boosted, score)``."""
    pr_join = "LEFT JOIN pr ON pr.id = a.doc_id" if with_rank else ""
    pr_val = "coalesce(pr.pagerank, 0.0)" if with_rank else "0.0"
    return (
        "hits AS (SELECT q.query_id, c.doc_id, q.first_pos, q.qtf * c.tf * q.idf_tfidf * q.idf_tfidf AS dot, "
        "q.qtf * (c.tf * q.idf_tfidf) * (c.tf * q.idf_tfidf) AS sq, "
        "q.qtf * (q.idf_bm25 * 2.5 * c.tf / (1.5 * 1.0 + c.tf)) AS bm "
        "FROM counts c JOIN qterms q USING (term)), "
        "agg AS (SELECT query_id, doc_id, sum(dot) AS dot, sum(sq) AS sq, sum(bm) AS bm25, "
        "min(first_pos) AS first_pos FROM hits GROUP BY query_id, doc_id), "
        "scored0 AS (SELECT a.query_id, a.doc_id, a.first_pos, "
        "CASE WHEN a.sq = 0 THEN 0.0 ELSE a.dot / sqrt(a.sq) END AS tfidf, a.bm25, "
        f"{pr_val} AS pr FROM agg a {pr_join}), "
        "scored AS (SELECT *, tfidf * (1 + 0.1 * log10(pr + 1)) AS tfidf_boosted, "
        "0.5 * (tfidf * (1 + 0.1 * log10(pr + 1))) + 0.5 * bm25 AS score FROM scored0)"
    )


def ranked_cte(n: int) -> str:
    return ("ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, "
            f"first_pos, doc_id) AS rank FROM scored QUALIFY rank <= {n})")


def search_with(md: int, n: int = 100) -> str:
    return (f"{base(md)}, {QTOK}, {LINKS}, {pagerank_ctes('pr')}, {scores_ctes(True)}, {ranked_cte(n)}, "
            "results AS (SELECT r.query_id, r.rank, r.doc_id, coalesce(t.title, '') AS title, "
            f"round(r.score, {ROUND}) AS score FROM ranked r LEFT JOIN "
            "(SELECT doc_id, min(title) AS title FROM corpus GROUP BY doc_id) t USING (doc_id))")


SPLIT = ("split AS (SELECT item_id AS query_id, CASE WHEN row_number() OVER (ORDER BY md5('42' || "
         "coalesce(text, '')), item_id) - 1 < CAST(floor(count(*) OVER () * 0.7) AS BIGINT) "
         "THEN 'train' ELSE 'validation' END AS split FROM benchmark)")

QRELS = (f"psg AS (SELECT item_id AS query_id, text AS passage FROM benchmark), "
         "qrels AS (SELECT DISTINCT p.query_id, c.doc_id FROM psg p JOIN corpus c "
         "ON contains(c.text, p.passage))")


def eval_with(md: int) -> str:
    return (f"{search_with(md)}, {QRELS}, "
            "judged AS (SELECT r.query_id, r.rank, r.doc_id, CASE WHEN q.doc_id IS NULL THEN 0 ELSE 1 END AS hit "
            "FROM results r LEFT JOIN qrels q USING (query_id, doc_id)), "
            "cnt AS (SELECT query_id, "
            "sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS n_5, sum(CASE WHEN rank <= 5 THEN hit ELSE 0 END) AS h_5, "
            "sum(CASE WHEN rank <= 30 THEN 1 ELSE 0 END) AS n_30, sum(CASE WHEN rank <= 30 THEN hit ELSE 0 END) AS h_30, "
            "count(*) AS n_returned FROM judged GROUP BY query_id), "
            "tsz AS (SELECT query_id, count(*) AS n_relevant FROM qrels GROUP BY query_id), "
            "m0 AS (SELECT b.item_id AS query_id, coalesce(t.n_relevant, 0) AS n_relevant, "
            "coalesce(c.n_returned, 0) AS n_returned, "
            f"CASE WHEN coalesce(c.n_5, 0) = 0 THEN 0.0 ELSE {round3('c.h_5 / c.n_5')} END AS p5, "
            f"CASE WHEN coalesce(c.n_30, 0) = 0 THEN 0.0 ELSE {round3('c.h_30 / c.n_30')} END AS p30, "
            "CASE WHEN coalesce(t.n_relevant, 0) = 0 THEN 1.0 "
            f"ELSE {round3('coalesce(c.h_30, 0) / t.n_relevant')} END AS r30 "
            "FROM benchmark b LEFT JOIN cnt c ON c.query_id = b.item_id LEFT JOIN tsz t ON t.query_id = b.item_id), "
            "m1 AS (SELECT *, CASE WHEN p30 = 0 OR r30 = 0 THEN 0.0 "
            f"ELSE {round3('2.0 / (1.0 / p30 + 1.0 / r30)')} END AS f1_30 FROM m0), "
            "m2 AS (SELECT *, CASE WHEN p5 = 0 OR f1_30 = 0 THEN 0.0 "
            f"ELSE {round3('2.0 / (1.0 / p5 + 1.0 / f1_30)')} END AS rq FROM m1), "
            "aph AS (SELECT query_id, rank, hit, sum(hit) OVER (PARTITION BY query_id ORDER BY rank "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hs FROM judged WHERE rank <= 40), "
            f"ap AS (SELECT query_id, {round3('avg(hs / rank)')} AS ap FROM aph WHERE hit = 1 GROUP BY query_id), "
            "ov AS (SELECT query_id, count(DISTINCT doc_id) AS ov FROM judged WHERE rank <= 40 AND hit = 1 "
            "GROUP BY query_id), "
            "report AS (SELECT m2.query_id, n_relevant, n_returned, p5 AS precision_at_5, f1_30 AS f1_at_30, "
            "rq AS results_quality, coalesce(ap.ap, 0.0) AS average_precision_at_40, "
            "CAST(coalesce(ov.ov, 0) AS BIGINT) AS overlap_at_40, r30 AS recall_at_30 FROM m2 "
            f"LEFT JOIN ap USING (query_id) LEFT JOIN ov USING (query_id)), {SPLIT}")


def oracle_sql(sf: str = "/root/testdata/sf0.01") -> dict[str, str]:
    md = MIN_DF
    b0 = f"WITH {CORPUS}, {COUNTS}"
    q = {}
    q["corpus_scan"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
    q["titles"] = f"WITH {CORPUS} SELECT doc_id, min(title) AS title FROM corpus GROUP BY doc_id"
    q["corpus_stats"] = (f"WITH {CORPUS} SELECT count(DISTINCT doc_id) AS n_docs, "
                         f"round(avg({word_count('text')}), {ROUND}) AS avg_dl FROM corpus")
    q["doc_lengths"] = f"WITH {CORPUS} SELECT doc_id, CAST({word_count('text')} AS BIGINT) AS doc_len FROM corpus"
    q["tokenize"] = (f"WITH {CORPUS} SELECT doc_id, CAST(len({raw_tokens('text')}) AS BIGINT) AS n_raw, "
                     f"CAST(len({tokens('text')}) AS BIGINT) AS n_kept, "
                     f"array_to_string({tokens('text')}, ' ') AS tokens FROM corpus")
    q["term_counts"] = f"{b0} SELECT term, doc_id, tf FROM counts"
    q["doc_freq"] = f"{b0} SELECT term, count(*) AS df FROM counts GROUP BY term"
    q["term_stats"] = f"{b0} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS term_total FROM counts GROUP BY term"
    q["min_df_filter"] = f"{base(md)} SELECT term, doc_id, tf FROM counts WHERE term IN (SELECT term FROM terms)"
    q["vocab_size"] = f"{base(md)} SELECT count(*) AS n_terms FROM terms"
    q["term_sample"] = f"{base(md)} SELECT term, df FROM terms ORDER BY term LIMIT 20"
    q["title_preview"] = (f"WITH {CORPUS} SELECT doc_id, min(title) AS title FROM corpus GROUP BY doc_id "
                          "ORDER BY doc_id LIMIT 2")
    q["posting_lists"] = (f"{base(md)} SELECT term, block, "
                          "count(*) AS n_postings, string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id) AS postings "
                          "FROM (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 65536 AS block "
                          "FROM counts) WHERE term IN (SELECT term FROM terms) GROUP BY term, block")
    q["term_buckets"] = f"{base(md)} SELECT bucket, count(*) AS n_terms, CAST(sum(df) AS BIGINT) AS n_postings FROM terms GROUP BY bucket"
    q["index_roundtrip"] = (f"{base(md)} SELECT c.term, c.doc_id, c.tf, t.bucket FROM counts c "
                            "JOIN terms t USING (term)")
    q["posting_lookup"] = (f"{base(md)}, top AS (SELECT term FROM terms ORDER BY df DESC, term LIMIT 1) "
                           "SELECT term, doc_id, tf FROM counts WHERE term = (SELECT term FROM top)")
    contents = (
        "SELECT c.term, c.doc_id, c.tf, t.df, t.term_total, d.title, (SELECT n FROM nd) AS n_docs, "
        f"CAST({NUM_BUCKETS} AS BIGINT) AS num_buckets FROM counts c JOIN terms t USING (term) "
        "JOIN (SELECT doc_id, min(title) AS title FROM corpus GROUP BY doc_id) d USING (doc_id)")
    q["index_append"] = q["stream_index"] = f"{base(0)} {contents}"
    q["index_append_cut"] = f"{base(md)} {contents}"
    q["qrels_explode"] = f"WITH {CORPUS}, {QRELS} SELECT query_id, doc_id FROM qrels"
    q["qrels_files"] = q["qrels_explode"]
    q["link_edges"] = f"WITH {LINKS} SELECT src, dst FROM edges"
    q["link_edges_files"] = q["link_edges"]
    q["link_vertices"] = f"WITH {LINKS} SELECT id FROM vertices"
    q["pagerank"] = f"WITH {PARTS}, {pagerank_ctes('pr')} SELECT id, round(pagerank, 9) AS pagerank FROM pr"
    q["pagerank_links"] = f"WITH {LINKS}, {pagerank_ctes('pr')} SELECT id, round(pagerank, 9) AS pagerank FROM pr"
    q["pagerank_preview"] = (f"WITH {LINKS}, {pagerank_ctes('pr')}, r AS (SELECT id, round(pagerank, 9) AS pagerank "
                             "FROM pr) SELECT id, pagerank, (SELECT count(*) FROM r) AS n_ranked FROM r "
                             "ORDER BY pagerank DESC, id LIMIT 5")
    q["query_terms"] = f"{base(md)}, {QTOK} SELECT query_id, term, qtf, first_pos, df FROM qterms"
    q["idf"] = (f"{base(md)}, {QTOK} SELECT query_id, term, df, round(idf_tfidf, 9) AS idf_tfidf, "
                "round(idf_bm25, 9) AS idf_bm25 FROM qterms")
    s0 = f"{base(md)}, {QTOK}, {scores_ctes(False)}"
    s1 = f"{base(md)}, {QTOK}, {LINKS}, {pagerank_ctes('pr')}, {scores_ctes(True)}"
    best = lambda by: (f"FROM scored QUALIFY row_number() OVER (PARTITION BY query_id "  # noqa: E731
                       f"ORDER BY round({by}, 9) DESC, first_pos, doc_id) <= 100")
    q["score_tfidf"] = f"{s0} SELECT query_id, doc_id, round(tfidf, {ROUND}) AS tfidf {best('tfidf')}"
    q["score_bm25"] = f"{s0} SELECT query_id, doc_id, round(bm25, {ROUND}) AS bm25 {best('bm25')}"
    q["pagerank_boost"] = (f"{s1} SELECT query_id, doc_id, round(pr, 9) AS pr, "
                           f"round(tfidf_boosted, {ROUND}) AS tfidf_boosted {best('tfidf_boosted')}")
    q["score_combined"] = f"{s1} SELECT query_id, doc_id, round(score, {ROUND}) AS score {best('score')}"
    q["top_n"] = (f"{s1}, {ranked_cte(10)} SELECT query_id, rank, doc_id, round(score, {ROUND}) AS score "
                  "FROM ranked")
    q["search"] = f"{search_with(md)} SELECT query_id, rank, doc_id, title, score FROM results"
    q["search_stored"] = q["search_stored_ranks"] = q["search_pruned"] = q["search"]
    q["pagerank_roundtrip"] = q["pagerank_links"]
    # Variants: the item text, only its stop words, and the empty string.
    sv = (f"{base(md)}, v AS (SELECT item_id, 'text' AS variant, {tokens('text')} AS tk FROM benchmark "
          f"UNION ALL SELECT item_id, 'stop_words', list_filter({raw_tokens('text')}, "
          f"lambda t: list_contains({STOP_SQL}, t)) FROM benchmark "
          "UNION ALL SELECT item_id, 'empty', CAST([] AS VARCHAR[]) FROM benchmark), "
          "vq AS (SELECT DISTINCT item_id, variant, unnest(tk) AS term FROM v), "
          "hitdocs AS (SELECT DISTINCT vq.item_id, vq.variant, c.doc_id FROM vq JOIN terms USING (term) "
          "JOIN counts c USING (term)), "
          "n AS (SELECT item_id, variant, least(count(*), 100) AS n_results FROM hitdocs GROUP BY item_id, variant) ")
    q["search_empty"] = (f"{sv} SELECT v.item_id, v.variant, CAST(coalesce(n.n_results, 0) AS BIGINT) AS n_results "
                         "FROM v LEFT JOIN n USING (item_id, variant)")
    e = eval_with(md)
    q["precision_at_k"] = f"{e} SELECT query_id, precision_at_5 FROM report"
    q["recall_at_k"] = f"{e} SELECT query_id, recall_at_30 FROM report"
    q["f1_at_k"] = f"{e} SELECT query_id, f1_at_30 FROM report"
    q["results_quality"] = f"{e} SELECT query_id, results_quality FROM report"
    q["average_precision"] = f"{e} SELECT query_id, average_precision_at_40 FROM report"
    q["overlap_at_40"] = f"{e} SELECT query_id, overlap_at_40 FROM report"
    q["query_report"] = (f"{e} SELECT query_id, n_relevant, n_returned, precision_at_5, f1_at_30, results_quality, "
                         "average_precision_at_40, overlap_at_40 FROM report")
    details = (
        "truth AS (SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY doc_id) AS ids FROM "
        "(SELECT * FROM qrels QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY doc_id) <= 10) "
        "GROUP BY query_id), "
        "tops AS (SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY rank) AS ids "
        "FROM results WHERE rank <= 10 GROUP BY query_id), "
        "both_ AS (SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY rank) AS ids FROM "
        "(SELECT * FROM judged WHERE rank <= 40 AND hit = 1 "
        "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10) GROUP BY query_id), "
        "details AS (SELECT b.item_id AS query_id, coalesce(truth.ids, '') AS truth_sample, "
        "coalesce(tops.ids, '') AS top_ids, coalesce(both_.ids, '') AS overlap_ids FROM benchmark b "
        "LEFT JOIN truth ON truth.query_id = b.item_id LEFT JOIN tops ON tops.query_id = b.item_id "
        "LEFT JOIN both_ ON both_.query_id = b.item_id)")
    q["report_details"] = f"{e}, {details} SELECT query_id, truth_sample, top_ids, overlap_ids FROM details"
    q["debug_query"] = (f"{e}, {details}, first AS (SELECT item_id AS query_id FROM benchmark "
                        "ORDER BY md5('42' || coalesce(text, '')), item_id LIMIT 1) "
                        "SELECT query_id, d.truth_sample, d.top_ids, d.overlap_ids, r.overlap_at_40, "
                        "r.precision_at_5, r.f1_at_30, r.results_quality "
                        "FROM first JOIN report r USING (query_id) JOIN details d USING (query_id)")
    q["train_val_split"] = f"WITH {SPLIT} SELECT query_id, split FROM split"
    q["mean_quality"] = (f"{e} SELECT split, count(*) AS n_queries, {round3('avg(results_quality)')} "
                         "AS mean_quality FROM report JOIN split USING (query_id) GROUP BY split")
    return q
