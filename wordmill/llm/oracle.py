"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from wordmill.llm import chat_format as chat
from wordmill.llm import decontaminate as decon
from wordmill.llm import mix_sources as mix
from wordmill.llm import quality_rules as qr

# Words and white space as in ``common``.
_WORDS = "list_filter(string_split_regex({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def quality_rules_sql(table: str = "documents", body: str = "") -> str:
    """Verdicts of the quality rules; ``body`` replaces the last SELECT."""
    final = body or """
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words,
       NOT base_failed AND 100 * coalesce(removed_words, 0) <= {removed} * n_words AS kept
FROM stats s LEFT JOIN removed r USING (doc_id)""".format(removed=qr.MAX_REMOVED_PCT)
    return f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t FROM {table}),
w AS (SELECT doc_id, {_WORDS.format('t')} AS w FROM docs),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM w, unnest(range(1, len(w) - 1)) AS r(i) WHERE len(w) >= 3),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
raw AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos
        FROM docs),
lines AS (SELECT doc_id, source, t, pos, line, len({_WORDS.format('line')}) AS n,
                 trim(regexp_replace(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g'), '[0-9]', '0', 'g')) AS norm
          FROM raw WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM docs GROUP BY source),
often AS (SELECT l.source, norm, min(doc_id) AS first_doc
          FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
          GROUP BY l.source, norm, h.n
          HAVING count(DISTINCT t) >= {qr.MIN_LINE_DOCS} AND 100 * count(DISTINCT t) >= least({qr.MIN_LINE_PCT} * h.n, 100 * {qr.MAX_LINE_DOCS})),
cut AS (SELECT l.doc_id, l.pos, l.n FROM lines l JOIN often o
        ON l.norm = o.norm AND l.source IS NOT DISTINCT FROM o.source WHERE l.doc_id <> o.first_doc),
removed AS (SELECT doc_id, sum(n) AS removed_words FROM cut GROUP BY doc_id),
stats AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
                 CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
                 len(w) < {qr.MIN_WORDS} OR 100 * coalesce(cov.n, 0) > {qr.MAX_REPEAT_PCT} * len(w) AS base_failed
          FROM docs d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id))
{final}
"""


def chat_format_sql() -> str:
    marks = len(chat.TURN) + len(chat.BODY) + len(chat.END)
    escaped = "length({0}) + length(regexp_replace({0}, '[^\\\\<]', '', 'g'))"
    return f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS x FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn, role, x)) AS turns_sha256,
       CAST(coalesce(sum(length(x)) FILTER (role = '{chat.LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn, role, x) FILTER (role = '{chat.LOSS_ROLE}'), '')) AS loss_sha256,
       CAST(sum({marks} + {escaped.format('role')} + {escaped.format('x')}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


def mix_sources_sql(table: str = "documents", body: str = "") -> str:
    names = ("source", "lang", "topic")
    # A target is the value's share times one level, or its most.  In order of most per share, the level is what the
    # values before leave, over the shares from the value on, for the first value that it does not take to its most.
    goals = ", ".join(f"""s_{m} AS (SELECT {m}, sum(tokens) AS s, {mix.MAX_RATE} * sum(tokens) AS most,
    power(sum(tokens), {mix.TEMPER}) AS r FROM cells GROUP BY {m}),
o_{m} AS (SELECT *, most / r AS ratio, ({mix.FRACTION} * (SELECT sum(tokens) FROM cells)
    - coalesce(sum(most) OVER (ORDER BY most / r, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(r) OVER (ORDER BY most / r, {m} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s_{m} WHERE r > 0),
t_{m} AS (SELECT {m}, least(r * coalesce((SELECT min_by(level, ratio) FROM o_{m} WHERE level <= ratio), 'infinity'::DOUBLE), most) AS t_{m}
    FROM o_{m} UNION ALL SELECT {m}, 0 FROM s_{m} WHERE NOT r > 0)""" for m in names)
    sweep = "f"
    for m in names:
        step = f"CASE WHEN t_{m} > a AND b > 0 THEN (t_{m} - a) / b ELSE t_{m} / (a + b) END"
        sweep = f"""(SELECT * EXCLUDE (a, b) REPLACE (u * CASE WHEN a + b > 0 AND t_{m} > 0 THEN
    least(greatest({step}, least({1 / mix.STEP}, t_{m} / (a + b))), greatest({mix.STEP}, t_{m} / (a + b))) ELSE 0 END AS u)
    FROM (SELECT *, sum(CASE WHEN u >= tokens THEN tokens ELSE 0 END) OVER (PARTITION BY {m}) AS a,
                 sum(CASE WHEN u >= tokens THEN 0 ELSE u END) OVER (PARTITION BY {m}) AS b FROM {sweep}))"""
    misses = ", ".join(f"CASE WHEN t_{m} > 0 THEN abs(sum(least(u, tokens)) OVER (PARTITION BY {m}) - t_{m}) / t_{m} ELSE 0 END"
                       for m in names)
    final = body or "SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability, u < p AS kept FROM mixed"
    return f"""
WITH RECURSIVE d AS (SELECT *, coalesce(text, '') AS t FROM {table}),
m AS (SELECT * EXCLUDE (t), CASE WHEN contains(t, '|') THEN 'table' WHEN regexp_matches(t, '[!#$%&*]{{2}}') THEN 'emphatic'
             WHEN regexp_matches(t, '[0-9]') THEN 'figures' ELSE 'prose' END AS topic,
             CAST(len({_WORDS.format('t')}) AS BIGINT) AS n_tokens,
             CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{mix.SEED}'), 1, 13) AS BIGINT)
                  AS DOUBLE) / {float(16 ** 13)!r} AS u FROM d),
cells AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM m GROUP BY ALL),
{goals},
f AS (SELECT cells.*, t_source, t_lang, t_topic, CAST(tokens AS DOUBLE) AS u, 0 AS k, CAST(1 AS DOUBLE) AS miss FROM cells
      JOIN t_source x ON x.source IS NOT DISTINCT FROM cells.source JOIN t_lang y ON y.lang IS NOT DISTINCT FROM cells.lang
      JOIN t_topic USING (topic)
      UNION ALL SELECT source, lang, topic, tokens, t_source, t_lang, t_topic, u, k + 1, max(miss) OVER ()
      FROM (SELECT * REPLACE (greatest({misses}) AS miss)
            FROM {sweep.replace('FROM f)', f'FROM f WHERE miss > {mix.TOLERANCE} AND k < {mix.MAX_SWEEPS})')})),
fit AS (SELECT *, least(u, tokens) AS weight FROM f WHERE k = (SELECT max(k) FROM f)),
mixed AS (SELECT m.*, CASE WHEN tokens > 0 THEN least(weight / tokens, 1) ELSE 1 END AS p FROM m JOIN fit c
          ON m.source IS NOT DISTINCT FROM c.source AND m.lang IS NOT DISTINCT FROM c.lang AND m.topic = c.topic)
{final}"""


def decontaminate_sql(table: str = "documents", body: str = "") -> str:
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    gram = lambda w: f"""SELECT DISTINCT id, array_to_string({w}[i:i + least(len({w}), 5) - 1], ' ') AS g, least(len({w}), 5) AS n
        FROM {w}s, unnest(range(1, greatest(len({w}) - 4, 1) + 1)) AS r(i) WHERE len({w}) > 0"""  # noqa: E731
    final = body or "SELECT doc_id, item_id, n_common, n_item FROM leaks"
    return f"""
WITH iws AS (SELECT item_id AS id, {_WORDS.format(lower.format("coalesce(text, '')"))} AS iw FROM benchmark),
dws AS (SELECT doc_id AS id, {_WORDS.format(lower.format("coalesce(text, '')"))} AS dw FROM {table}),
ig AS ({gram('iw')}), sizes AS (SELECT id, count(*) AS n_item FROM ig GROUP BY id),
dg AS ({gram('dw')}),
leaks AS (SELECT dg.id AS doc_id, ig.id AS item_id, count(*) AS n_common, n_item
          FROM dg JOIN ig USING (g, n) JOIN sizes ON sizes.id = ig.id GROUP BY dg.id, ig.id, n_item
          HAVING 100 * count(*) >= {decon.MIN_PCT} * n_item)
{final}"""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a short ASCII string, bit by bit."""
    shift = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: {shift})"
    codes = f"list_transform(string_split({text}, ''), lambda a: CAST(ascii(a) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {byte}), 4294967295)"


def merkle_manifest_sql() -> str:
    part = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
    head = " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, start: str) -> str:
        return f"""{name} AS ({start} UNION ALL
    SELECT g, lev + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 7) // 8)
    FROM {name} WHERE n > 1 GROUP BY g, lev, pos // 8)"""

    def flanks(tree: str, rows: str) -> str:
        # A node's place at a level is its leaf's over 8^level; a run's nodes share the place over 8.
        return f"""SELECT r.id, t.lev, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < r.pos // 8 ** t.lev), '') AS l,
           coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > r.pos // 8 ** t.lev), '') AS rt
    FROM {rows} r JOIN {tree} t ON t.g = r.g AND t.n > 1 AND t.pos // 8 = r.pos // CAST(8 ** (t.lev + 1) AS BIGINT)
    GROUP BY r.id, t.lev""".replace("r.pos // 8 ** t.lev", "r.pos // CAST(8 ** t.lev AS BIGINT)")

    return f"""
WITH RECURSIVE hashed AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, sha256({head} || {part.format('text')}) AS leaf,
    sha256({head} || CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {part.format(low)}
           ELSE {part.format('text')} END) AS seen FROM documents),
leaves AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                  count(*) OVER (PARTITION BY g) AS n FROM hashed),
{tree("t1", "SELECT g, 0 AS lev, pos, leaf AS node, n FROM leaves")},
subroots AS (SELECT g AS id, '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, node, count(*) OVER () AS n FROM t1 WHERE n = 1),
{tree("t2", "SELECT g, 0 AS lev, pos, node, n FROM subroots")},
p1 AS ({flanks("t1", "leaves")}),
p2 AS ({flanks("t2", "subroots")}),
way AS (SELECT id, lev, l, rt FROM p1 UNION ALL
        SELECT v.id, 1000 + lev, l, rt FROM leaves v JOIN p2 ON p2.id = v.g),
steps AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lev) AS k FROM way),
up AS (SELECT id, CAST(0 AS BIGINT) AS k, seen AS node FROM leaves UNION ALL
       SELECT u.id, s.k, sha256(s.l || u.node || s.rt) FROM up u JOIN steps s ON s.id = u.id AND s.k = u.k + 1),
folded AS (SELECT id, arg_max(node, k) AS root FROM up GROUP BY id),
proofs AS (SELECT id, string_agg(l || rt, '' ORDER BY k) AS p FROM steps GROUP BY id)
SELECT doc_id, leaf, s.node AS subroot, r.node AS root, sha256(coalesce(p, '')) AS proof_sha256,
       f.root AS folded_root, f.root = r.node AS verified
FROM leaves v JOIN subroots s ON s.id = v.g JOIN folded f ON f.id = v.id LEFT JOIN proofs ON proofs.id = v.id,
     (SELECT node FROM t2 WHERE n = 1) r"""


def oracle_sql() -> dict[str, str]:
    return {"op10_quality_rules": quality_rules_sql(), "op5_chat_format": chat_format_sql(),
            "op3_decontaminate": decontaminate_sql(), "op6_mix_sources": mix_sources_sql(),
            "op13_merkle_manifest": merkle_manifest_sql()}
