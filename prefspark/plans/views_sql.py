"""DuckDB definitions of the fixture views (twins of ``sources/fixtures.py``).

These are only used to build the oracle SQL: every oracle query is
``WITH <needed views> <query>`` over the driver's pre-registered tables.
DuckDB lists are 1-based, Spark arrays 0-based.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def _v(name, sql, deps=()):
    VIEWS[name] = sql
    DEPS[name] = list(deps)


_v("rewards_long", """
SELECT 'm' || CAST(k // 15 AS VARCHAR) AS model,
       CASE WHEN vec_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split,
       (['coherence','complexity','correctness','helpfulness','verbosity'])[((k // 3) % 5) + 1] AS attribute,
       vec_id AS prompt_id,
       CAST(k % 3 AS INTEGER) AS completion_idx,
       CASE WHEN vec_id % 50 = 7 AND (k // 3) % 5 = 2 AND k // 15 = 1 THEN 'NaN'::DOUBLE
            ELSE floor(CAST(embedding[k + 1] AS DOUBLE) * 40) / 4 END AS reward
FROM embeddings, range(60) t(k)""")

_v("annotation_ratings", """
SELECT l_orderkey AS prompt_id, CAST(l_linenumber % 2 AS INTEGER) AS completion_idx, u.attribute,
       CAST(u.rating AS DOUBLE) AS rating
FROM lineitem,
  (SELECT unnest([
     {'attribute': 'coherence',   'rating': round(l_tax * 100) % 5},
     {'attribute': 'complexity',  'rating': CAST(l_partkey % 5 AS DOUBLE)},
     {'attribute': 'correctness', 'rating': round(l_discount * 100) % 5},
     {'attribute': 'helpfulness', 'rating': CAST(l_quantity % 5 AS DOUBLE)},
     {'attribute': 'verbosity',   'rating': CAST(l_suppkey % 5 AS DOUBLE)}], recursive := true)) u""")

_v("rated_responses", """
SELECT DISTINCT l_orderkey AS prompt_id, 'prompt ' || CAST(l_orderkey AS VARCHAR) AS prompt,
       CAST(l_linenumber % 2 AS INTEGER) AS completion_idx,
       'response ' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber % 2 AS VARCHAR) AS response
FROM lineitem""")

_v("tldr_raw", """
SELECT d.doc_id AS id, d.source AS worker,
       CASE WHEN d.doc_id % 7 = 0 THEN 'validation' ELSE 'train' END AS split,
       CASE WHEN d.doc_id % 3 = 0 THEN d.source END AS site,
       d.lang AS subreddit, split_part(d.text, chr(10), 1) AS title,
       CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE d.text END AS post,
       d.text AS article,
       array_to_string((string_split(d.text, chr(10)))[1:(len(string_split(d.text, chr(10))) + 1) // 2], chr(10)) AS s0,
       array_to_string((string_split(d.text, chr(10)))[(len(string_split(d.text, chr(10))) + 1) // 2 + 1:], chr(10)) AS s1,
       CAST(coalesce(l.quality, d.doc_id % 2) AS INTEGER) AS choice
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")

_v("generations", """
SELECT conv_id AS prompt_id,
       string_agg(text, chr(10) ORDER BY turn, text) FILTER (WHERE role = 'user') AS prompt,
       arg_min(text, CASE WHEN role = 'system' THEN turn END) AS sys,
       coalesce(list({'turn': turn, 'text': text} ORDER BY turn) FILTER (WHERE role = 'assistant'), []) AS comps
FROM conversations GROUP BY conv_id""")

_v("rollouts", """
SELECT vec_id // 64 AS step, vec_id // 4 AS prompt_id, CAST(vec_id % 4 AS INTEGER) AS sample_idx,
       list_transform(embedding[1:(4 + vec_id % 13)], lambda x: abs(CAST(x AS DOUBLE)) * -10.0) AS model_logps,
       list_transform(embedding[17:(16 + 4 + vec_id % 13)], lambda x: abs(CAST(x AS DOUBLE)) * -10.0) AS ref_logps,
       list_transform(embedding[33:(32 + 4 + vec_id % 13)], lambda x: abs(CAST(x AS DOUBLE)) * -10.0) AS gen_logps,
       CAST(embedding[49] AS DOUBLE) * 10.0 AS score,
       1.0 / (1.0 + exp(-(CAST(embedding[50] AS DOUBLE) * 10.0))) AS prob,
       vec_id % 7 <> 0 AS has_eos
FROM embeddings""")

_v("judge_logprobs", """
SELECT pair_id, token, logprob, call_failed FROM (
  SELECT vec_id AS pair_id, t.token, abs(CAST(embedding[t.i] AS DOUBLE)) * -10.0 AS logprob,
         vec_id % 29 = 0 AS call_failed
  FROM embeddings, (VALUES ('A', 1), ('B', 2), ('C', 3)) t(token, i))
WHERE NOT ((token = 'A' AND pair_id % 17 = 0) OR (token = 'B' AND pair_id % 34 = 0))""")

_v("instruction_results", """
SELECT l_orderkey AS prompt_id, CAST(l_linenumber % 2 AS INTEGER) AS completion_idx,
       l_linenumber AS instruction_id, l_returnflag <> 'R' AS followed_strict,
       (l_returnflag <> 'R') OR l_linestatus = 'O' AS followed_loose
FROM lineitem""")

_v("correction_rewards", """
SELECT * FROM (
  SELECT r.model AS leader, f.m AS follower, attribute, prompt_id, completion_idx, reward
  FROM rewards_long r, (VALUES ('m0'), ('m1'), ('m2'), ('m3')) f(m) WHERE completion_idx = 0
  UNION ALL
  SELECT f.m AS leader, r.model AS follower, attribute, prompt_id, completion_idx, reward
  FROM rewards_long r, (VALUES ('m0'), ('m1'), ('m2'), ('m3')) f(m) WHERE completion_idx = 1)
WHERE NOT (leader = 'm3' AND follower = 'm0')""", ["rewards_long"])

_v("token_ids", """
SELECT vec_id AS seq_id,
       list_transform(embedding, lambda x: CAST(((floor(CAST(x AS DOUBLE) * 100) % 10) + 10) % 10 AS INTEGER)) AS ids,
       8 AS ctx
FROM embeddings""")

_v("logits", """
SELECT vec_id AS seq_id, CAST(p AS INTEGER) AS pos,
       list_transform(embedding[(p * 16 + 1):(p * 16 + 16)], lambda v: CAST(v AS DOUBLE) * 10.0) AS logits,
       CAST(vec_id % 16 AS INTEGER) AS target
FROM embeddings, range(4) t(p)""")

_v("scored_pairs", """
SELECT model, split, attribute, prompt_id,
       max(CASE WHEN completion_idx = 0 THEN reward END) AS chosen,
       max(CASE WHEN completion_idx = 1 THEN reward END) AS rejected,
       CAST(prompt_id % 3 AS DOUBLE) * 0.1 AS margin,
       CASE WHEN prompt_id % 4 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS loss_weight,
       CAST(prompt_id % 2 AS INTEGER) AS label
FROM rewards_long WHERE completion_idx <= 1
GROUP BY model, split, attribute, prompt_id""", ["rewards_long"])

_v("metric_log", """
SELECT CAST(ts AS TIMESTAMP) AS ts, user_id AS run, event_type AS metric, value FROM events""")


def build(final: str, views: tuple[str, ...] | list[str] = (), ctes: list[tuple[str, str]] = (),
          recursive: bool = False) -> str:
    """``WITH <views needed, dependencies first>, <extra ctes> <final>``."""
    order: list[str] = []

    def add(n):
        for d in DEPS[n]:
            add(d)
        if n not in order:
            order.append(n)

    for n in views:
        add(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order] + [f"{n} AS ({q})" for n, q in ctes]
    if not parts:
        return final
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + final
