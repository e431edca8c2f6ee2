"""SQL building blocks for DuckDB. Each name in PARTS is a CTE; `select` adds the ones a query needs."""

from __future__ import annotations

import re

from catalog import base as b
from talkspan.functions.stopwords import DEFAULT_STOP_WORDS
from talkspan.params import DEFAULT_TOPICS

STOP = ", ".join(f"'{w}'" for w in DEFAULT_STOP_WORDS)
LABELS = b.label_names()


def words(text: str) -> str:
    letters = f"lower(regexp_replace({text}, '[^A-Za-z]+', ' ', 'g'))"
    return f"list_filter(string_split({letters}, ' '), lambda w: w <> '' AND w NOT IN ({STOP}))"


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def fixed(x: str, places: int = 6) -> str:
    unit = f"1e{places}::DOUBLE"
    return f"floor({x} * {unit} + 0.5) / {unit}"


def passes(p: str, t) -> str:
    return f"floor({p} * 1e9::DOUBLE + 0.5) >= floor(({t})::DOUBLE * 1e9::DOUBLE + 0.5)"


def dot(x: str, y: str) -> str:
    return f"list_dot_product({x}::DOUBLE[], {y}::DOUBLE[])"


def cosine(x: str, y: str) -> str:
    size = f"(sqrt({dot(x, x)}) * sqrt({dot(y, y)}))"
    return f"coalesce(CASE WHEN {size} > 0 THEN {dot(x, y)} / {size} END, 0.0)"


def softmax_rows(source: str, keys: str, score: str = "sim") -> str:
    return f"""SELECT *, w / sum(w) OVER (PARTITION BY {keys}) AS p FROM (
        SELECT *, exp({score} - max({score}) OVER (PARTITION BY {keys})) AS w FROM {source})"""


def softmax_list(sims: str) -> str:
    """Softmax of a list expression, as a list."""
    return f"""list_transform({sims}, lambda s: exp(s - list_max({sims})) /
        list_sum(list_transform({sims}, lambda z: exp(z - list_max({sims})))))"""


HOUR = "CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 3600) AS INTEGER)"

PARTS: dict[str, str] = {
    "messages": """SELECT e.event_id AS row_id, e.event_type AS chatroom, 'user_' || e.user_id AS sender,
        e.ts, d.text, '' AS prompt FROM events e
        JOIN documents d ON d.doc_id = (e.event_id * 7919) % (SELECT count(*) FROM documents)""",
    "worded": f"""SELECT m.*, {HOUR} AS hour_idx, {words('text')} AS words FROM messages m
        WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'""",
    "emb": """SELECT vec_id, label, list_transform(embedding,
        lambda x: CAST(floor(CAST(x AS DOUBLE) * 1e6 + 0.5) AS BIGINT)) AS vec FROM embeddings""",
    "label_topics": """SELECT label AS topic_idx, 'label_' || label AS name, list(s ORDER BY i) AS vec FROM (
        SELECT label, i, sum(v)::BIGINT AS s FROM (
            SELECT label, unnest(vec) AS v, generate_subscripts(vec, 1) AS i FROM emb) GROUP BY label, i)
        GROUP BY label""",
    "message_vecs": """SELECT e.event_id AS row_id, x.vec FROM events e
        JOIN emb x ON x.vec_id = (e.event_id * 7919) % (SELECT count(*) FROM embeddings)""",
    "hour_stats": """SELECT sender, hour_idx, count(*) AS n_msgs, sum(len(words))::BIGINT AS n_words,
        min(ts) AS first_ts, max(ts) AS last_ts FROM worded GROUP BY sender, hour_idx""",
    "hour_sums": """SELECT sender, hour_idx, list(s ORDER BY i) AS vec FROM (
        SELECT sender, hour_idx, i, sum(v)::BIGINT AS s FROM (
            SELECT w.sender, w.hour_idx, unnest(m.vec) AS v, generate_subscripts(m.vec, 1) AS i
            FROM worded w JOIN message_vecs m USING (row_id)) GROUP BY ALL) GROUP BY sender, hour_idx""",
    "hours": """SELECT s.*, v.vec, row_number() OVER (PARTITION BY s.sender ORDER BY s.hour_idx) AS ord
        FROM hour_stats s JOIN hour_sums v USING (sender, hour_idx) WHERE n_words > 0""",
    "hour_sims": f"""SELECT h.sender, h.ord, h.hour_idx, h.n_msgs, t.topic_idx,
        {cosine('h.vec', 't.vec')} AS sim FROM hours h CROSS JOIN label_topics t""",
    "hour_p": softmax_rows("hour_sims", "sender, ord"),
    "topic_rows": f"""SELECT list(list_transform(vec, lambda x: x / sqrt({dot('vec', 'vec')}))
        ORDER BY topic_idx) AS rows FROM label_topics""",
    "docs": f"SELECT doc_id, lang, text, {words('text')} AS words FROM documents",
    "doc_tokens": f"""SELECT doc_id, word, count(*) AS n FROM (
        SELECT doc_id, unnest({tokens('text')}) AS word FROM documents) GROUP BY ALL""",
    "doc_words": """SELECT doc_id, word, count(*) AS n FROM (
        SELECT doc_id, unnest(words) AS word FROM docs) GROUP BY ALL""",
    "doc_sizes": "SELECT doc_id, len(words) AS n_words FROM docs",
    "default_topics": "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{n}')" for i, n in enumerate(DEFAULT_TOPICS))
    + ") v(topic_idx, name)",
    "vocab": """SELECT word FROM doc_tokens UNION SELECT lower(name) FROM default_topics
        UNION SELECT word FROM doc_words""",
}


def hash_long(dim: int, source: str = "vocab") -> str:
    """Hashed words in long form `word, d, v`."""
    return f"""SELECT word, d, sum(v)::BIGINT AS v FROM (
        SELECT word, code % {dim} AS d, CASE WHEN (code // {dim}) % 2 = 0 THEN 1000000 ELSE -1000000 END AS v
        FROM (SELECT word, ('0x' || substr(md5(substr('#' || word || '#', i, 3)), 1, 8))::BIGINT AS code
            FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM {source}))) GROUP BY ALL"""


def as_lists(source: str, keys: str, dim: int) -> str:
    """Long vectors to lists, zeros filled in."""
    return f"""SELECT {keys}, list(coalesce(v, 0) ORDER BY d) AS vec FROM (
        SELECT k.*, g.d, x.v FROM (SELECT DISTINCT {keys} FROM {source}) k
        CROSS JOIN (SELECT unnest(range({dim})) AS d) g
        LEFT JOIN {source} x USING ({keys}, d)) GROUP BY {keys}"""


for _d, _s in ((b.HASH_DIM, ""), (b.OTHER_DIM, "2")):
    PARTS |= {
        f"wl{_s}": hash_long(_d),
        f"wv{_s}": as_lists(f"wl{_s}", "word", _d),
        f"dl{_s}": f"""SELECT doc_id, d, sum(n * v)::BIGINT AS v
            FROM doc_tokens JOIN wl{_s} USING (word) GROUP BY ALL""",
        f"dv{_s}": as_lists(f"dl{_s}", "doc_id", _d),
        f"bl{_s}": f"""SELECT doc_id, d, sum(n * v)::BIGINT AS v
            FROM doc_words JOIN wl{_s} USING (word) WHERE length(word) > 1 GROUP BY ALL""",
        f"bv{_s}": as_lists(f"bl{_s}", "doc_id", _d),
        f"tv{_s}": f"SELECT t.*, w.vec FROM default_topics t JOIN wv{_s} w ON w.word = lower(t.name)",
    }

PARTS |= {
    "candidates": f"""SELECT t.doc_id, t.word, coalesce(w.n, 0) AS freq,
        {fixed(cosine('x.vec', 'v.vec'), 4)} AS relevance
        FROM doc_tokens t JOIN wv x USING (word) JOIN dv v USING (doc_id)
        LEFT JOIN doc_words w ON w.doc_id = t.doc_id AND w.word = t.word
        WHERE t.word NOT IN ({STOP})""",
    "ranked": """SELECT c.*, row_number() OVER (PARTITION BY doc_id ORDER BY relevance DESC, word) AS rank,
        s.n_words FROM candidates c JOIN doc_sizes s USING (doc_id)""",
    "keywords": "SELECT * FROM ranked WHERE rank <= least(n_words, 20)",
    "lang_long": """SELECT lang, d, sum(v)::BIGINT AS v FROM dl JOIN documents USING (doc_id) GROUP BY ALL""",
    "lang_vecs": as_lists("lang_long", "lang", b.HASH_DIM),
    "lang_sims": f"""SELECT k.doc_id, k.lang AS truth, l.lang AS pred,
        {cosine('v.vec', 'l.vec')} AS sim
        FROM documents k LEFT JOIN dv v USING (doc_id) CROSS JOIN lang_vecs l""",
    "lang_pairs": """SELECT doc_id AS sample_id, truth, pred FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY floor(sim * 1e12 + 0.5) DESC, pred) AS r
        FROM lang_sims) WHERE r = 1""",
    "vec_sims": f"""SELECT e.vec_id, e.label, t.topic_idx, t.name, {cosine('e.vec', 't.vec')} AS sim
        FROM emb e CROSS JOIN label_topics t""",
    "label_pairs": """SELECT vec_id AS sample_id, 'label_' || label AS truth, name AS pred FROM (
        SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic_idx) AS r FROM vec_sims)
        WHERE r = 1""",
    "cells": "SELECT truth, pred, count(*) AS n FROM label_pairs GROUP BY ALL",
    "label_sums": """SELECT label, sum(t)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS tp
        FROM (SELECT truth AS label, n AS t, 0 AS p, CASE WHEN truth = pred THEN n ELSE 0 END AS h FROM cells
            UNION ALL SELECT pred, 0, n, 0 FROM cells) GROUP BY label""",
    "label_scores": """SELECT label, support,
        CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
        CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
        CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0.0 END AS f1
        FROM label_sums""",
}


def greedy(thresholds, gate: float = 0.0) -> dict[str, str]:
    """CTEs `own`, `walk`, `blocks`: the greedy rule, hour by hour, for several thresholds."""
    levels = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    gated = f" AND {passes('sim', gate)}" if gate > 0 else ""
    return {
        "levels": f"SELECT * FROM (VALUES {levels}) v(threshold)",
        "own": f"""SELECT l.threshold, h.sender, h.ord, h.topic_idx, h.p,
            ({passes('h.p', 'l.threshold')}{gated}) AS seed FROM hour_p h CROSS JOIN levels l""",
        "walk": f"""SELECT o.threshold, o.sender, o.topic_idx, o.ord,
                CASE WHEN seed THEN o.ord END AS start_ord, h.vec, o.p
            FROM own o JOIN hours h USING (sender, ord) WHERE o.ord = 1
            UNION ALL
            SELECT threshold, sender, topic_idx, ord,
                CASE WHEN NOT seed THEN NULL WHEN keeps THEN prev_start ELSE ord END,
                CASE WHEN keeps THEN joined ELSE vec END,
                CASE WHEN keeps THEN joined_p ELSE p END
            FROM (SELECT *, coalesce(seed AND prev_start IS NOT NULL AND {passes('joined_p', 'threshold')}, false) AS keeps
                FROM (SELECT *, {softmax_list('sims')}[topic_idx + 1] AS joined_p
                    FROM (SELECT *, list_transform(rows, lambda r: list_dot_product(r, joined::DOUBLE[])
                            / sqrt(list_dot_product(joined::DOUBLE[], joined::DOUBLE[]))) AS sims
                        FROM (SELECT w.threshold, w.sender, w.topic_idx, o.ord, o.seed, o.p, h.vec,
                                w.start_ord AS prev_start, t.rows,
                                list_transform(list_zip(w.vec, h.vec), lambda z: z[1] + z[2]) AS joined
                            FROM walk w
                            JOIN own o ON o.threshold = w.threshold AND o.sender = w.sender
                                AND o.topic_idx = w.topic_idx AND o.ord = w.ord + 1
                            JOIN hours h ON h.sender = w.sender AND h.ord = w.ord + 1
                            CROSS JOIN topic_rows t))))""",
        "blocks": """SELECT w.threshold, w.sender, w.topic_idx, w.start_ord, max(w.ord) AS end_ord,
                count(*) AS n_hours, sum(h.n_msgs)::BIGINT AS n_msgs,
                date_trunc('second', min(h.first_ts)) AS start_ts, date_trunc('second', max(h.last_ts)) AS end_ts,
                arg_max(w.p, w.ord) AS p, 'label_' || w.topic_idx AS topic,
                row_number() OVER (PARTITION BY w.threshold, w.sender, w.topic_idx ORDER BY w.start_ord) AS block_no
            FROM walk w JOIN hours h USING (sender, ord) WHERE w.start_ord IS NOT NULL
            GROUP BY w.threshold, w.sender, w.topic_idx, w.start_ord""",
    }


def select(query: str, extra: dict[str, str] | None = None) -> str:
    """Prepends the CTEs `query` refers to, directly or through others."""
    parts = PARTS | (extra or {})
    order: list[str] = []

    def visit(text: str, inside: str = "") -> None:
        for name in parts:
            if name != inside and name not in order and re.search(rf"\b{name}\b", text):
                body = parts[name]
                if re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                    visit(body, name)
                    if name not in order:
                        order.append(name)

    visit(query)
    if not order:
        return query
    heavy = {"hour_p", "walk", "hours", "worded", "candidates", "wv", "wv2", "dv", "dv2", "hour_sims", "own"}
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in heavy and n != 'walk' else ''}({parts[n]})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{query}"
