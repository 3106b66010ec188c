"""Oracle SQL (DuckDB) for every registered query with a SQL twin.

Each entry is an independent plain-SQL formulation (self-joins, GROUPING SETS,
recursive CTEs) of the operator, run on the driver's tables. Column names and
types match the Spark result.
"""

from __future__ import annotations

from prefspark.plans.views_sql import build

ORACLE: dict[str, str] = {}

GE = "(NOT isnan({a}) AND NOT isnan({b}) AND {a} >= {b})"


def ge(a: str, b: str) -> str:
    return GE.format(a=a, b=b)


def _o(name: str, final: str, views=(), ctes=(), recursive=False):
    ORACLE[name] = build(final, views, list(ctes), recursive)


MODELS = ["m0", "m1", "m2", "m3"]
COMPLETIONS = 3
N_PLAYERS = len(MODELS) * COMPLETIONS
ATTRS = ["coherence", "complexity", "correctness", "helpfulness", "verbosity"]

# ------------------------------------------------------------------ E2 / E3 / C8
E2 = """SELECT model, split, attribute, count(*) AS n_rewards,
       CAST(sum(CAST(isnan(reward) AS BIGINT)) AS BIGINT) AS nan_count,
       avg(CASE WHEN NOT isnan(reward) THEN reward END) AS mean_reward,
       CASE WHEN sum(CAST(isnan(reward) AS BIGINT)) > 0 THEN 'NaN'::DOUBLE
            ELSE max(reward) - min(reward) END AS reward_range
FROM rewards_long GROUP BY model, split, attribute"""
_o("reward_summary", E2, ["rewards_long"])


def _pivot_sql():
    cols = []
    for s in ("train", "validation"):
        for a in ATTRS:
            cols.append(f"max(CASE WHEN split = '{s}' AND attribute = '{a}' THEN mean_reward END) AS {s}_{a}")
    inner = "SELECT model, " + ", ".join(cols) + " FROM e2 GROUP BY model"
    means = []
    for s in ("train", "validation"):
        vals = [f"(CASE WHEN NOT isnan({s}_{a}) THEN {s}_{a} END)" for a in ATTRS]
        total = "0.0::DOUBLE" + "".join(f" + coalesce({v}, 0.0::DOUBLE)" for v in vals)
        n = " + ".join(f"CAST({v} IS NOT NULL AS INTEGER)" for v in vals)
        means.append(f"CASE WHEN ({n}) > 0 THEN ({total}) / ({n}) END AS {s}_mean")
    return inner, "SELECT *, " + ", ".join(means) + " FROM w"


_inner, _final = _pivot_sql()
_o("reward_summary_pivot", _final, ["rewards_long"], [("e2", E2), ("w", _inner)])
_o("sort_by_score", """SELECT model, train_mean, validation_mean,
       CAST(row_number() OVER (ORDER BY train_mean DESC NULLS LAST, model) AS INTEGER) AS score_rank
FROM p""", ["rewards_long"], [("e2", E2), ("w", _inner), ("p", _final)])

# ------------------------------------------------------------------ E4
_PL = ", ".join(f"('{m}#{c}', '{m}', {c}, {k * COMPLETIONS + c})" for k, m in enumerate(MODELS)
                for c in range(COMPLETIONS))
_o("round_robin_tournament", """
SELECT split, ni AS player_i, nj AS player_j, w AS win_rate FROM pairs
UNION ALL SELECT split, nj, ni, 1.0::DOUBLE - w FROM pairs
UNION ALL SELECT DISTINCT split, name, name, 0.0::DOUBLE FROM x""", ["rewards_long"], [
    ("pl", f"SELECT * FROM (VALUES {_PL}) p(name, model, cidx, pidx)"),
    ("x", """SELECT r.split, r.attribute, r.prompt_id, p.pidx, p.name, r.reward
             FROM rewards_long r JOIN pl p ON r.model = p.model AND r.completion_idx = p.cidx"""),
    ("pairs", f"""SELECT a.split, a.name AS ni, b.name AS nj,
                  CAST(sum(CASE WHEN {ge('a.reward', 'b.reward')} THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS w
                  FROM x a JOIN x b ON a.split = b.split AND a.attribute = b.attribute
                   AND a.prompt_id = b.prompt_id AND a.pidx < b.pidx
                  GROUP BY a.split, a.name, b.name"""),
])

# ------------------------------------------------------------------ D11 / E5
_CELL_JOIN = ("o.split = b.split AND o.attribute = b.attribute AND o.prompt_id = b.prompt_id "
              "AND o.completion_idx = b.completion_idx")
# one grouped pass over the cells, no join of two expansions of the base table
_CELLS = """SELECT split, attribute, prompt_id, completion_idx, list({'m': model, 'r': reward}) AS l
FROM rewards_long GROUP BY split, attribute, prompt_id, completion_idx"""
_o("baseline_join", """
SELECT a.m AS model, split, attribute, prompt_id, completion_idx, a.r AS reward, base.r AS base_reward
FROM (SELECT *, unnest(l) AS a, unnest(list_filter(l, lambda x: x.m = 'm0')) AS one,
             list_filter(l, lambda x: x.m = 'm0')[1] AS base FROM cells)
WHERE a.m IN ('m1', 'm2', 'm3') AND base IS NOT NULL""", ["rewards_long"], [("cells", _CELLS)])

_e5_cols = []
for c, role in ((0, "leader"), (1, "follower")):
    for s in ("train", "validation"):
        _e5_cols.append(f"CAST(sum(win) FILTER (WHERE completion_idx = {c} AND split = '{s}') AS DOUBLE) / "
                        f"count(*) FILTER (WHERE completion_idx = {c} AND split = '{s}') AS {role}_{s}")
        _e5_cols.append(f"CAST(sum(tie) FILTER (WHERE completion_idx = {c} AND split = '{s}') AS DOUBLE) / "
                        f"count(*) FILTER (WHERE completion_idx = {c} AND split = '{s}') AS {role}_{s}_tie_rate")
_o("winrate_vs_baseline", "SELECT model, " + ", ".join(_e5_cols) + " FROM j GROUP BY model", ["rewards_long"], [
    ("j", f"""SELECT o.model, o.split, o.completion_idx,
              CASE WHEN {ge('o.reward', 'b.reward')} THEN 1 ELSE 0 END AS win,
              CASE WHEN NOT isnan(o.reward) AND NOT isnan(b.reward) AND o.reward = b.reward THEN 1 ELSE 0 END AS tie
              FROM rewards_long o JOIN rewards_long b ON {_CELL_JOIN} AND b.model = 'm0'
              WHERE o.model IN ('m1', 'm2', 'm3') AND o.completion_idx IN (0, 1)""")])

# ------------------------------------------------------------------ F1 / E6 / E7
F1 = """SELECT *, max(reward) OVER (PARTITION BY model, split, attribute, prompt_id ORDER BY completion_idx
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far FROM rewards_long"""
_o("running_best", F1, ["rewards_long"])
_o("best_of_n_curve", """SELECT model, split, attribute, completion_idx + 1 AS n, avg(best_so_far) AS mean_best
FROM f1 GROUP BY model, split, attribute, completion_idx + 1""", ["rewards_long"], [("f1", F1)])
_o("best_of_n_winrate", """
SELECT split, model, CASE WHEN GROUPING(attribute) = 1 THEN 'Average' ELSE attribute END AS attribute, n,
       CAST(sum(win) AS DOUBLE) / count(*) AS winrate
FROM j GROUP BY GROUPING SETS ((split, model, n, attribute), (split, model, n))""", ["rewards_long"], [
    ("f1", F1),
    ("j", f"""SELECT o.split, o.model, o.attribute, o.completion_idx + 1 AS n,
              CASE WHEN {ge('o.best_so_far', 'b.best_so_far')} THEN 1 ELSE 0 END AS win
              FROM f1 o JOIN f1 b ON {_CELL_JOIN} AND b.model = 'm0' WHERE o.model IN ('m1', 'm2', 'm3')""")])

# ------------------------------------------------------------------ E9 / A8
_e9 = ", ".join(f"coalesce(max(CASE WHEN r.leader = '{m}' THEN r.winrate END), 'NaN'::DOUBLE) AS {m}"
                for m in MODELS)
_o("correction_matrix", f"""SELECT f.m AS follower, {_e9}
FROM (VALUES ('m0'), ('m1'), ('m2'), ('m3')) f(m) LEFT JOIN rate r ON r.follower = f.m GROUP BY f.m""",
   ["correction_rewards"], [
       ("cell", """SELECT leader, follower, attribute, prompt_id,
                   max(CASE WHEN completion_idx = 0 THEN reward END) AS r0,
                   max(CASE WHEN completion_idx = 1 THEN reward END) AS r1
                   FROM correction_rewards GROUP BY leader, follower, attribute, prompt_id"""),
       ("rate", f"""SELECT leader, follower,
                    CAST(sum(CASE WHEN {ge('r1', 'r0')} THEN 1 ELSE 0 END) AS DOUBLE)
                      / count(CASE WHEN r0 IS NOT NULL AND r1 IS NOT NULL THEN 1 END) AS winrate
                    FROM cell GROUP BY leader, follower""")])
_o("pending_work", """SELECT l.m AS leader, f.m AS follower
FROM (VALUES ('m0'), ('m1'), ('m2'), ('m3')) l(m), (VALUES ('m0'), ('m1'), ('m2'), ('m3')) f(m)
WHERE NOT EXISTS (SELECT 1 FROM correction_rewards c WHERE c.leader = l.m AND c.follower = f.m)""",
   ["correction_rewards"])

# ------------------------------------------------------------------ D9 / D10 / D12
_o("align_prompts", """SELECT split, prompt_id,
       list_filter(['m0', 'm1', 'm2', 'm3'], lambda m: NOT list_contains(ms, m)) AS missing_in
FROM (SELECT split, prompt_id, list(DISTINCT model) AS ms FROM rewards_long GROUP BY split, prompt_id)
WHERE len(list_filter(['m0', 'm1', 'm2', 'm3'], lambda m: NOT list_contains(ms, m))) > 0""", ["rewards_long"])

PLAYERS_SQL = f"""SELECT split, attribute, prompt_id,
       CAST(CAST(substr(model, 2) AS INTEGER) * {COMPLETIONS} + completion_idx AS INTEGER) AS player, reward
FROM rewards_long WHERE completion_idx < {COMPLETIONS} AND model IN ('m0', 'm1', 'm2', 'm3')"""
_o("stack_players", PLAYERS_SQL, ["rewards_long"])
_o("model_pair_theta_join", f"""
SELECT split, attribute, prompt_id, completion_idx, a.m AS model_a, b.m AS model_b,
       a.r AS reward_a, b.r AS reward_b, {ge('a.r', 'b.r')} AS a_ge_b
FROM (SELECT * EXCLUDE l, unnest(l) AS b FROM (SELECT *, unnest(l) AS a FROM cells))
WHERE a.m < b.m""", ["rewards_long"], [("cells", _CELLS)])

# ------------------------------------------------------------------ graph chain
P = N_PLAYERS
_o("player_cross", f"""SELECT split, attribute, prompt_id,
       list_transform(range({P}), lambda i: list_transform(range({P}), lambda j: vec[i + 1] - vec[j + 1])) AS diff
FROM (SELECT split, attribute, prompt_id, list(reward ORDER BY player) AS vec FROM pl
      GROUP BY split, attribute, prompt_id)""", ["rewards_long"], [("pl", PLAYERS_SQL)])

_VEC = ("SELECT split, prompt_id, attribute, list(reward ORDER BY player) AS vec FROM pl "
        "GROUP BY split, prompt_id, attribute")
_RM = "SELECT split, prompt_id, list(vec ORDER BY attribute) AS R FROM v GROUP BY split, prompt_id"
_o("bt_probability_mean", f"""SELECT split, prompt_id,
  list_transform(range({P}), lambda i: list_transform(range({P}), lambda j:
    CASE WHEN len(list_filter(R, lambda v: isnan(v[i + 1] - v[j + 1]))) > 0 THEN 'NaN'::DOUBLE ELSE
    round(list_reduce(R, lambda acc, v: acc + 1.0::DOUBLE / (1.0::DOUBLE + exp(-(v[i + 1] - v[j + 1]))), 0.0::DOUBLE)
          / len(R), 6) END)) AS prob
FROM rm""", ["rewards_long"], [("pl", PLAYERS_SQL), ("v", _VEC), ("rm", _RM)])

_EDGES = f"""SELECT a.split, a.prompt_id, a.player AS i, b.player AS j,
       2 * sum(CASE WHEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-(a.reward - b.reward))) < 0.5 THEN 1 ELSE 0 END)
         > count(*) AS edge
FROM pl a JOIN pl b ON a.split = b.split AND a.prompt_id = b.prompt_id AND a.attribute = b.attribute
GROUP BY a.split, a.prompt_id, a.player, b.player"""
_GRAPH_CTES = [("pl", PLAYERS_SQL), ("e", _EDGES),
               ("nodes", "SELECT DISTINCT split, prompt_id, i FROM e"),
               ("prompts", "SELECT DISTINCT split, prompt_id FROM e"),
               ("ed", "SELECT split, prompt_id, i, j FROM e WHERE edge")]
_o("preference_graph", """SELECT split, prompt_id, list([mask] ORDER BY i) AS adjacency,
       CAST(sum(bit_count(mask)) AS INTEGER) AS n_edges
FROM (SELECT split, prompt_id, i, CAST(bit_or(CASE WHEN edge THEN (1::BIGINT << j) ELSE 0::BIGINT END) AS BIGINT) AS mask
      FROM e GROUP BY split, prompt_id, i)
GROUP BY split, prompt_id""", ["rewards_long"], _GRAPH_CTES)

_REACH = ("reach", """SELECT split, prompt_id, i AS src, j AS dst FROM ed
                      UNION SELECT r.split, r.prompt_id, r.src, ed.j FROM reach r
                      JOIN ed ON r.split = ed.split AND r.prompt_id = ed.prompt_id AND r.dst = ed.i""")
ACYCLIC = """SELECT p.split, p.prompt_id, NOT EXISTS (SELECT 1 FROM reach r WHERE r.split = p.split
              AND r.prompt_id = p.prompt_id AND r.src = r.dst) AS acyclic FROM prompts p"""
_o("acyclic_check", ACYCLIC, ["rewards_long"], _GRAPH_CTES + [_REACH], recursive=True)
_o("acyclic_check_edges", ACYCLIC, ["rewards_long"], _GRAPH_CTES + [_REACH], recursive=True)

INDEG = ("indeg", """SELECT n.split, n.prompt_id, n.i, count(ed.j) AS indeg FROM nodes n
                     LEFT JOIN ed ON ed.split = n.split AND ed.prompt_id = n.prompt_id AND ed.j = n.i
                     GROUP BY n.split, n.prompt_id, n.i""")
OUTDEG = ("outdeg", """SELECT n.split, n.prompt_id, n.i, count(ed.j) AS outdeg FROM nodes n
                       LEFT JOIN ed ON ed.split = n.split AND ed.prompt_id = n.prompt_id AND ed.i = n.i
                       GROUP BY n.split, n.prompt_id, n.i""")
CONDORCET = f"""SELECT p.split, p.prompt_id, CAST(min(d.i) AS INTEGER) AS condorcet_idx FROM prompts p
LEFT JOIN indeg d ON d.split = p.split AND d.prompt_id = p.prompt_id AND d.indeg = {P - 1}
GROUP BY p.split, p.prompt_id"""
_o("condorcet_winner", CONDORCET, ["rewards_long"], _GRAPH_CTES + [INDEG])
_o("condorcet_histogram", "SELECT split, condorcet_idx AS player, count(*) AS n_wins FROM c WHERE condorcet_idx IS NOT NULL GROUP BY 1, 2",
   ["rewards_long"], _GRAPH_CTES + [INDEG, ("c", CONDORCET)])
_o("sink_nodes", """SELECT p.split, p.prompt_id,
       coalesce(list(CAST(d.i AS INTEGER) ORDER BY d.i) FILTER (WHERE d.i IS NOT NULL), []::INTEGER[]) AS sinks
FROM prompts p LEFT JOIN (SELECT a.split, a.prompt_id, a.i FROM indeg a JOIN outdeg b
  ON a.split = b.split AND a.prompt_id = b.prompt_id AND a.i = b.i WHERE a.indeg > 0 AND b.outdeg = 0) d
  ON d.split = p.split AND d.prompt_id = p.prompt_id
GROUP BY p.split, p.prompt_id""", ["rewards_long"], _GRAPH_CTES + [INDEG, OUTDEG])
_o("cycle_stats", """SELECT a.split, count(*) AS n_prompts,
       CAST(sum(CASE WHEN NOT a.acyclic THEN 1 ELSE 0 END) AS BIGINT) AS n_cyclic,
       CAST(sum(CASE WHEN c.condorcet_idx IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_no_condorcet,
       CAST(sum(CASE WHEN NOT a.acyclic THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS cyclic_share,
       CAST(sum(CASE WHEN c.condorcet_idx IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS no_condorcet_share
FROM acy a JOIN cond c ON a.split = c.split AND a.prompt_id = c.prompt_id GROUP BY a.split""",
   ["rewards_long"], _GRAPH_CTES + [_REACH, INDEG, ("acy", ACYCLIC), ("cond", CONDORCET)], recursive=True)


# ------------------------------------------------------------------ label chain
def h(*parts: str, seed: str = "42") -> str:
    args = ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"('0x' || substr(md5(concat_ws('|', {args})), 1, 8))::BIGINT"


PAIRS = """SELECT prompt_id, max(CASE WHEN completion_idx = 0 THEN prompt END) AS prompt,
       max(CASE WHEN completion_idx = 0 THEN response END) AS response0,
       max(CASE WHEN completion_idx = 1 THEN response END) AS response1
FROM rated_responses GROUP BY prompt_id
HAVING count(*) = 2 AND count(DISTINCT prompt) = 1
   AND max(CASE WHEN completion_idx = 0 THEN response END) IS NOT NULL
   AND max(CASE WHEN completion_idx = 1 THEN response END) IS NOT NULL"""
_o("pair_consecutive", PAIRS, ["rated_responses"])

STATS = """SELECT prompt_id, completion_idx, attribute, count(rating) AS n,
       avg(rating) AS mean, stddev_pop(rating) AS std
FROM annotation_ratings GROUP BY prompt_id, completion_idx, attribute"""
SIDES = """SELECT prompt_id, attribute,
       max(CASE WHEN completion_idx = 0 THEN mean END) AS mean0, max(CASE WHEN completion_idx = 1 THEN mean END) AS mean1,
       max(CASE WHEN completion_idx = 0 THEN std END) AS std0, max(CASE WHEN completion_idx = 1 THEN std END) AS std1
FROM stats GROUP BY prompt_id, attribute
HAVING max(CASE WHEN completion_idx = 0 THEN mean END) IS NOT NULL AND max(CASE WHEN completion_idx = 1 THEN mean END) IS NOT NULL"""


def _labels_sql(compat: bool) -> str:
    tie = "(std0 - std1) <= 1e-8" if compat else "abs(std0 - std1) <= 1e-8"
    raw = (f"CASE WHEN abs(mean0 - mean1) <= 1e-8 THEN (CASE WHEN {tie} THEN CAST({h('prompt_id', 'attribute')} % 2 AS INTEGER)"
           " WHEN std0 - std1 > 0 THEN 0 ELSE 1 END) WHEN mean0 - mean1 > 0 THEN 1 ELSE 0 END")
    return (f"SELECT prompt_id, attribute, CAST(CASE WHEN attribute IN ('verbosity', 'complexity') THEN 1 - ({raw}) "
            f"ELSE ({raw}) END AS INTEGER) AS label FROM sides")


LABEL_CTES = [("stats", STATS), ("sides", SIDES)]
_o("disagreement_labels", _labels_sql(False), ["annotation_ratings"], LABEL_CTES)
_o("disagreement_labels_compat", _labels_sql(True), ["annotation_ratings"], LABEL_CTES)
_o("disagreement_labels_long", _labels_sql(False), ["annotation_ratings"], LABEL_CTES)
_o("pair_consecutive_errors", """SELECT prompt_id, count(*) AS n_rows, count(DISTINCT prompt) = 1 AS same_prompt
FROM rated_responses GROUP BY prompt_id
HAVING NOT (count(*) = 2 AND count(DISTINCT prompt) = 1
   AND count(CASE WHEN completion_idx = 0 THEN response END) > 0 AND count(CASE WHEN completion_idx = 1 THEN response END) > 0)""",
   ["rated_responses"])
_RATED = [(a, f"list_transform(embedding[{3 * i + 1}:{3 * i + 3}], lambda x: floor(abs(x::DOUBLE) * 8) % 5) AS {a}")
          for i, a in enumerate(ATTRS)]
RAW_PAIRS = f"""SELECT vec_id // 2 AS prompt_id, CAST(vec_id % 2 AS INTEGER) AS completion_idx, 'prompt ' || (vec_id // 2) AS prompt,
       'response ' || vec_id AS response, {', '.join(sql for _, sql in _RATED)}
FROM embeddings WHERE (vec_id // 2) % 17 <> 3 AND vec_id // 2 IN (SELECT vec_id // 2 FROM embeddings GROUP BY 1 HAVING count(*) = 2)"""
_o("pair_rows", RAW_PAIRS)
_o("disagreement_labels_arrays", _labels_sql(False), [], [("raw_pairs", RAW_PAIRS), ("annotation_ratings", " UNION ALL ".join(
    f"SELECT prompt_id, completion_idx, '{a}' AS attribute, unnest({a}) AS rating FROM raw_pairs" for a in ATTRS)), *LABEL_CTES])

_o("dense_ids", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS prompt_id FROM documents")
_o("seeded_shuffle", f"""SELECT doc_id, row_number() OVER (ORDER BY hh, doc_id) - 1 AS shuffle_rank
FROM (SELECT doc_id, {h('doc_id')} AS hh FROM documents)""")
SPLIT = f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY hh, prompt_id) - 1 < floor(0.8 * count(*) OVER ())
                 THEN 'train' ELSE 'validation' END AS split
FROM (SELECT *, {h('prompt_id')} AS hh FROM pairs)"""
_o("train_validation_split", "SELECT prompt_id, split FROM sp", ["rated_responses"], [("pairs", PAIRS), ("sp", SPLIT)])
CR = """SELECT p.*, CASE WHEN l.label = 1 THEN p.response0 ELSE p.response1 END AS chosen,
       CASE WHEN l.label = 1 THEN p.response1 ELSE p.response0 END AS rejected
FROM {src} p JOIN labels l ON p.prompt_id = l.prompt_id AND l.attribute = 'helpfulness'"""
_LCTES = LABEL_CTES + [("labels", _labels_sql(False))]
_o("chosen_rejected", "SELECT prompt_id, prompt, chosen, rejected FROM cr", ["rated_responses", "annotation_ratings"],
   [("pairs", PAIRS)] + _LCTES + [("cr", CR.format(src="pairs"))])


def umsg(x: str) -> str:
    return f"[{{'role': 'user', 'content': {x}}}]"


def amsg(x: str) -> str:
    return f"{{'role': 'assistant', 'content': {x}}}"


_o("chat_structure", f"""SELECT prompt_id, {umsg('prompt')} AS prompt,
       list_concat({umsg('prompt')}, [{amsg('chosen')}]) AS chosen,
       list_concat({umsg('prompt')}, [{amsg('rejected')}]) AS rejected FROM cr""",
   ["rated_responses", "annotation_ratings"], [("pairs", PAIRS)] + _LCTES + [("cr", CR.format(src="pairs"))])
_o("source_rated_pairs", f"""SELECT prompt_id, split,
       list_concat({umsg('prompt')}, [{amsg('chosen')}]) AS chosen,
       list_concat({umsg('prompt')}, [{amsg('rejected')}]) AS rejected FROM cr""",
   ["rated_responses", "annotation_ratings"],
   [("pairs", PAIRS), ("sp", SPLIT)] + _LCTES + [("cr", CR.format(src="sp"))])

# ------------------------------------------------------------------ TL;DR chain
NL2 = "chr(10) || chr(10)"
TOKEN = "'[^ \\t\\n\\r\\f\\x0B]+'"
TLDR_P = (f"CASE WHEN site IS NOT NULL THEN 'SITE: ' || site || {NL2} || 'ARTICLE: ' || article "
          f"WHEN subreddit IS NOT NULL THEN 'SUBREDDIT: r/' || subreddit || {NL2} || 'TITLE: ' || title || {NL2} "
          f"|| 'POST: ' || post END")


def ntok(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {TOKEN})) AS INTEGER)"


def trunc_ctes(src: str, max_tokens: int) -> list[tuple[str, str]]:
    return [
        ("tl", f"SELECT *, string_split({TLDR_P}, chr(10)) AS lines FROM {src}"),
        ("tc", f"SELECT *, list_transform(lines, lambda l: len(regexp_extract_all(l, {TOKEN}))) AS cnt FROM tl"),
        ("tk", f"""SELECT *, len(list_filter(list_transform(range(1, len(cnt) + 1), lambda i: list_sum(cnt[1:i])),
                                  lambda c: c <= {max_tokens})) AS k FROM tc"""),
        ("tp", f"SELECT *, array_to_string(lines[1:k], chr(10)) || {NL2} || 'TL;DR:' AS prompt FROM tk"),
    ]


_o("tldr_prompt", f"SELECT id, {TLDR_P} AS prompt FROM tldr_raw", ["tldr_raw"])
_o("truncate_lines", "SELECT id, prompt FROM tp", ["tldr_raw"], trunc_ctes("tldr_raw", 512))
_o("token_count", f"SELECT id, {ntok('article')} AS n_tokens FROM tldr_raw", ["tldr_raw"])
_o("filter_prompt_length", f"SELECT id, split FROM tldr_raw WHERE {ntok('article')} <= 512", ["tldr_raw"])
_o("prompt_length_stats", f"""SELECT count(*) AS n_rows,
       CAST(coalesce(sum(CASE WHEN {ntok('article')} > 512 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_removed,
       CAST(coalesce(sum(CASE WHEN {ntok('article')} > 512 THEN 1 ELSE 0 END), 0) AS DOUBLE) * 100.0::DOUBLE / count(*)
         AS removed_pct FROM tldr_raw""", ["tldr_raw"])
CHOICE = ("SELECT *, CASE WHEN choice = 0 THEN s0 ELSE s1 END AS chosen, "
          "CASE WHEN choice = 0 THEN s1 ELSE s0 END AS rejected FROM {src}")
_o("filter_pair_length", f"""SELECT id, chosen, rejected FROM ({CHOICE.format(src='tldr_raw')})
WHERE coalesce({ntok('chosen')}, 0) <= 64 AND coalesce({ntok('rejected')}, 0) <= 64""", ["tldr_raw"])
_o("filter_message_length", f"SELECT conv_id, turn FROM conversations WHERE coalesce({ntok('text')}, 0) <= 100")
EMPTY_POST = "(post IS NULL OR length(trim(post)) > 0 OR site IS NOT NULL)"
_o("filter_empty_post", f"SELECT id FROM tldr_raw WHERE {EMPTY_POST}", ["tldr_raw"])
_o("choice_pairs", f"SELECT id, chosen, rejected FROM ({CHOICE.format(src='tldr_raw')})", ["tldr_raw"])
WC = """SELECT worker, count(*) FILTER (WHERE split = 'train') AS t, count(*) FILTER (WHERE split = 'validation') AS v
FROM tldr_raw GROUP BY worker"""
SEMI = """SELECT * FROM tldr_raw WHERE split <> 'validation'
   OR worker IN (SELECT worker FROM wc WHERE t >= {min_n} AND v > 0 {only})"""
_o("worker_semi_join", "SELECT id, split, worker FROM kept", ["tldr_raw"], [("wc", WC), ("kept", SEMI.format(min_n=43, only=""))])
_o("worker_count_join", """SELECT worker, CASE WHEN t > 0 THEN t END AS train, CASE WHEN v > 0 THEN v END AS valid
FROM wc""", ["tldr_raw"], [("wc", WC)])
_o("worker_counts", "SELECT split, worker, count(*) AS n FROM tldr_raw GROUP BY split, worker", ["tldr_raw"])
LW = ("CASE WHEN split = 'train' THEN (CASE WHEN worker = 'src3' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) "
      "END AS loss_weight")
_o("loss_weight", f"SELECT id, split, {LW} FROM tldr_raw", ["tldr_raw"])
_o("source_annotated_summaries", f"""SELECT prompt_id, split, worker, prompt, chosen, rejected,
       row_number() OVER (ORDER BY {h('prompt_id')}, prompt_id) - 1 AS shuffle_rank, {LW}
FROM (SELECT id AS prompt_id, split, worker, {umsg('prompt')} AS prompt,
             list_concat({umsg('prompt')}, [{amsg('chosen')}]) AS chosen,
             list_concat({umsg('prompt')}, [{amsg('rejected')}]) AS rejected
      FROM ({CHOICE.format(src='tp')}) WHERE {EMPTY_POST} AND coalesce({ntok('chosen')}, 0) <= 64 AND coalesce({ntok('rejected')}, 0) <= 64)""",
   ["tldr_raw"], [("wc", WC), ("kept", SEMI.format(min_n=1, only="AND worker = 'src3'"))] + trunc_ctes("kept", 512))
_o("head_n", """SELECT id, split FROM (SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY id) AS rn
FROM tldr_raw) WHERE rn <= 50""", ["tldr_raw"])

# ------------------------------------------------------------------ generations / chat shaping
SYS = "'You are a helpful assistant.'"
FOLLOW = "'Improve the answer above.'"


def smsg(x: str) -> str:
    return f"{{'role': 'system', 'content': {x}}}"


def umsg1(x: str) -> str:
    return f"{{'role': 'user', 'content': {x}}}"


_o("chat_prompt_with_system", f"""SELECT prompt_id,
       [{smsg(SYS)}, {umsg1('prompt')}, {amsg('comps[1].text')}, {umsg1(FOLLOW)}] AS messages FROM generations""",
   ["generations"])
_o("follower_prompt", f"""SELECT prompt_id, [{umsg1('prompt')}, {amsg('comps[1].text')}, {umsg1(FOLLOW)}] AS messages
FROM generations WHERE len(comps) > 0""", ["generations"])
_o("correction_rounds", f"""SELECT prompt_id, 0 AS round, [{umsg1('prompt')}] AS messages FROM generations
UNION ALL
SELECT prompt_id, CAST(i + 1 AS INTEGER) AS round, [{umsg1('prompt')}, {amsg('comps[i + 1].text')}, {umsg1(FOLLOW)}]
FROM (SELECT prompt_id, prompt, comps, unnest(range(len(comps))) AS i FROM generations)""", ["generations"])
_T = "'<|user|>' || chr(10) || coalesce(prompt, '') || chr(10)"
_NEXT = f"{_T} || '<|assistant|>' || chr(10) || {{last}} || chr(10) || '<|user|>' || chr(10) || {FOLLOW} || chr(10)"
_o("correction_loop", f"""SELECT prompt_id, [[{amsg('c0')}], [{amsg('c1')}], [{amsg('c2')}]] AS completions FROM (
  SELECT *, 'answer ' || md5({_NEXT.format(last='c1')}) AS c2 FROM (
    SELECT *, 'answer ' || md5({_NEXT.format(last='c0')}) AS c1 FROM (SELECT *, 'answer ' || md5({_T}) AS c0 FROM generations)))""", ["generations"])
_o("correction_loop_given", f"""SELECT prompt_id, [c0, c1, c2] AS completions FROM (
  SELECT *, 'answer ' || md5(coalesce(prompt, '') || coalesce(c1, '') || {FOLLOW}) AS c2 FROM (
    SELECT *, 'answer ' || md5(coalesce(prompt, '') || coalesce(c0, '') || {FOLLOW}) AS c1 FROM (
      SELECT *, coalesce(comps[1].text, 'answer ' || md5(prompt)) AS c0 FROM generations)))""", ["generations"])
_o("render_chat", f"""SELECT prompt_id, '<|system|>' || chr(10) || {SYS} || chr(10) || '<|user|>' || chr(10) || prompt
       || chr(10) AS text FROM generations""", ["generations"])
JT = (f"'Which response answers the prompt better?' || {NL2} || 'Prompt: ' || prompt || {NL2} || "
      f"'Response A: ' || comps[1].text || {NL2} || 'Response B: ' || comps[2].text || {NL2} || 'Answer A or B.'")
_o("judge_prompt", f"SELECT prompt_id, [{smsg(SYS)}, {umsg1(JT)}] AS messages FROM generations WHERE len(comps) >= 2",
   ["generations"])
_o("first_completion", "SELECT prompt_id, comps[1].text AS leader_completion FROM generations", ["generations"])
_o("message_content", "SELECT prompt_id, CASE WHEN sys IS NOT NULL THEN sys ELSE prompt END AS content FROM generations",
   ["generations"])
_o("flatten_completions", """SELECT prompt_id, prompt, CAST(i AS INTEGER) AS completion_idx, comps[i + 1].text AS completion
FROM (SELECT prompt_id, prompt, comps, unnest(range(len(comps))) AS i FROM generations)""", ["generations"])
_o("unflatten_rewards", """SELECT model, split, attribute, prompt_id, count(*) AS n_completions,
       list(reward ORDER BY completion_idx) AS rewards FROM rewards_long GROUP BY model, split, attribute, prompt_id""",
   ["rewards_long"])
_o("group_return_sequences", """SELECT vec_id // 4 AS prompt_idx, list(CAST(label AS VARCHAR) ORDER BY vec_id) AS completions
FROM embeddings GROUP BY vec_id // 4""")
_o("repeat_rows", """SELECT step, prompt_id, sample_idx, score, CAST(r AS INTEGER) AS repeat_idx
FROM rollouts, range(2) t(r)""", ["rollouts"])
_o("last_wins_dedup", "SELECT source, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
_o("follower_reference_sequence", """SELECT seq_id AS pair_id,
       list_concat(ids[1:ctx], list_reverse(ids)[(ctx + 3):]) AS ids, ctx FROM token_ids""", ["token_ids"])
_o("export_eval_json", """SELECT prompt_id, prompt AS instruction, comps[i + 1].text AS output,
       'prefspark_completion_' || CAST(i AS VARCHAR) AS generator, 'prefspark' AS dataset, 'eval' AS datasplit,
       CAST(i AS INTEGER) AS completion_idx
FROM (SELECT prompt_id, prompt, comps, unnest(range(len(comps))) AS i FROM generations)""", ["generations"])

_o("export_eval_json_files", """SELECT prompt AS instruction, comps[i + 1].text AS output,
       'prefspark_completion_' || CAST(i AS VARCHAR) AS generator, 'prefspark' AS dataset, 'eval' AS datasplit,
       CAST(i AS INTEGER) AS completion_idx
FROM (SELECT prompt, comps, unnest(range(len(comps))) AS i FROM generations)""", ["generations"])


# ------------------------------------------------------------------ token arrays / rollouts
def asum(x: str) -> str:
    return f"list_reduce({x}, lambda a, v: a + v, 0.0::DOUBLE)"


def zipw(a: str, b: str, expr: str) -> str:
    """list of expr(x, y) over two equal-length lists (x from a, y from b)."""
    return f"list_transform(range(len({a})), lambda i: (lambda x, y: {expr})({a}[i + 1], {b}[i + 1]))"


def zipf(a: str, b: str, expr: str) -> str:
    """like zipw but with ``x``/``y`` substituted textually (DuckDB has no lambda application)."""
    return f"list_transform(range(len({a})), lambda i: {expr.replace('x', f'{a}[i + 1]').replace('y', f'{b}[i + 1]')})"


def r6(x: str) -> str:
    return f"round({x}, 6)"


ROLL_KEYS = "step, prompt_id, sample_idx"
COMP = "ids[(ctx + 1):]"
_o("truncate_at_stop", f"""SELECT seq_id, c AS completion, CAST(len(c) AS INTEGER) AS length FROM (
  SELECT seq_id, CASE WHEN list_position({COMP}, 0) IS NOT NULL THEN ({COMP})[1:list_position({COMP}, 0)]
                      ELSE {COMP} END AS c FROM token_ids)""", ["token_ids"])
_o("contains_eos", f"SELECT seq_id, list_contains({COMP}, 0) AS has_eos FROM token_ids", ["token_ids"])
_o("sequence_length", f"""SELECT seq_id, CAST(CASE WHEN list_position({COMP}, 9) IS NOT NULL THEN list_position({COMP}, 9) - 2
                  ELSE len({COMP}) - 1 END AS INTEGER) AS seq_len,
       CAST(ctx + coalesce(list_max(list_filter(range(len({COMP})), lambda i: ({COMP})[i + 1] <> 9)), -1) + 1 AS INTEGER)
         AS seq_len_last_non_pad FROM token_ids""", ["token_ids"])
LSE = "(list_max({l}) + ln(list_reduce(list_transform({l}, lambda v: exp(v - list_max({l}))), lambda a, v: a + v, 0.0::DOUBLE)))"
_o("selected_log_softmax", f"""SELECT seq_id, pos, {r6("s[target + 1] - " + LSE.format(l="s"))} AS logp
FROM (SELECT seq_id, pos, target, list_transform(logits, lambda v: v / 1.0::DOUBLE) AS s FROM logits)""", ["logits"])
_o("softmax_entropy", f"""SELECT seq_id, pos,
  {r6("lse - list_reduce(list_transform(logits, lambda v: exp(v - lse) * v), lambda a, v: a + v, 0.0::DOUBLE)")} AS entropy
FROM (SELECT seq_id, pos, logits, {LSE.format(l="logits")} AS lse FROM logits)""", ["logits"])
_o("masked_logprob_sum", f"SELECT {ROLL_KEYS}, {asum('model_logps')} AS logp_sum, -{asum('model_logps')} AS entropy FROM rollouts",
   ["rollouts"])
LOGR = "list_transform(range(len(model_logps)), lambda i: ref_logps[i + 1] - model_logps[i + 1])"
K3 = "list_transform(logr, lambda v: (exp(least(greatest(v, -40.0::DOUBLE), 40.0::DOUBLE)) - 1.0::DOUBLE) - least(greatest(v, -40.0::DOUBLE), 40.0::DOUBLE))"
_o("kl_estimate", f"""SELECT {ROLL_KEYS}, {r6(asum('list_transform(logr, lambda v: -v)'))} AS kl_k1,
       {r6(asum('list_transform(logr, lambda v: 0.5::DOUBLE * v * v)'))} AS kl_k2, {r6(asum(K3))} AS kl_k3
FROM (SELECT *, {LOGR} AS logr FROM rollouts)""", ["rollouts"])


def padj(src: str, prob: str = "prob") -> str:
    return f"""SELECT *, v - CASE WHEN count(*) OVER (PARTITION BY step) > 1
                 THEN (sum(v) OVER (PARTITION BY step) - v) / (count(*) OVER (PARTITION BY step) - 1)
                 ELSE 'NaN'::DOUBLE END AS p_adj
FROM (SELECT *, {prob} - 0.5::DOUBLE AS v FROM {src})"""


def ploss(src: str, tis: bool) -> str:
    tok = (f"list_transform(range(len(model_logps)), lambda i: (0.05::DOUBLE * kk[i + 1] - p_adj) * model_logps[i + 1]"
           + (" * least(exp(model_logps[i + 1] - gen_logps[i + 1]), 2.0::DOUBLE)" if tis else "") + ")")
    return f"""SELECT * EXCLUDE (score), {asum(tok)} AS seq_loss, p_adj * {asum('model_logps')} AS score, {asum('kk')} AS kl
FROM (SELECT *, {K3} AS kk FROM (SELECT *, {LOGR} AS logr FROM ({src})))"""


_o("policy_loss", f"SELECT {ROLL_KEYS}, {r6('seq_loss')} AS seq_loss, {r6('score')} AS score, {r6('kl')} AS kl FROM pl",
   ["rollouts"], [("pa", padj("rollouts")), ("pl", ploss("pa", True))])
NOEOS = "CAST(NOT has_eos AS DOUBLE)"
_o("eos_probability_penalty", f"""SELECT {ROLL_KEYS}, {r6(f'prob - 1.0::DOUBLE * {NOEOS}')} AS p_leader,
       {r6(f'(1.0::DOUBLE - prob) - 1.0::DOUBLE * {NOEOS}')} AS p_follower FROM rollouts""", ["rollouts"])
SPEN = f"score - 1.0::DOUBLE * {NOEOS}"
_o("missing_eos_penalty", f"SELECT {ROLL_KEYS}, {SPEN} AS score_pen FROM rollouts", ["rollouts"])
SEQKL = asum("list_transform(range(len(model_logps)), lambda i: model_logps[i + 1] - ref_logps[i + 1])")
KLR = f"""SELECT *, -0.05::DOUBLE * seq_kl AS non_score_reward, -0.05::DOUBLE * seq_kl + score_pen AS rlhf_reward
FROM (SELECT *, {SEQKL} AS seq_kl, {SPEN} AS score_pen FROM rollouts)"""
_o("kl_penalized_reward", f"""SELECT {ROLL_KEYS}, {r6('seq_kl')} AS seq_kl, {r6('non_score_reward')} AS non_score_reward,
       {r6('rlhf_reward')} AS rlhf_reward FROM k""", ["rollouts"], [("k", KLR)])


def adv(src: str, value: str) -> str:
    return f"""SELECT *, {value} - CASE WHEN count(*) OVER (PARTITION BY step, prompt_id) > 1
        THEN (sum({value}) OVER (PARTITION BY step, prompt_id) - {value}) / (count(*) OVER (PARTITION BY step, prompt_id) - 1)
        ELSE 'NaN'::DOUBLE END AS advantage FROM {src}"""


_o("rloo_advantage", f"SELECT {ROLL_KEYS}, {r6('advantage')} AS advantage FROM a", ["rollouts"],
   [("a", adv("rollouts", "score"))])
_o("batch_rloo_baseline", f"SELECT {ROLL_KEYS}, {r6('p_adj')} AS p_adj FROM pa", ["rollouts"], [("pa", padj("rollouts"))])


def norm(value: str, clip: float | None) -> str:
    z = f"({value} - avg({value}) OVER (PARTITION BY step)) / (stddev_samp({value}) OVER (PARTITION BY step) + 1e-8)"
    if clip is not None:
        z = f"least(greatest({z}, -{clip}::DOUBLE), {clip}::DOUBLE)"
    return z


_o("normalize_reward", f"SELECT {ROLL_KEYS}, {r6(norm('score', 3.0))} AS score_norm FROM rollouts", ["rollouts"])
_o("normalize_advantage", f"SELECT {ROLL_KEYS}, {r6(norm('advantage', None))} AS adv_norm FROM a", ["rollouts"],
   [("a", adv("rollouts", "score"))])
_o("alternating_update", f"""SELECT step, {r6('loss_leader')} AS loss_leader, {r6('loss_follower')} AS loss_follower,
       {r6("CASE WHEN (step + 1) % 3 = 0 THEN loss_leader ELSE 0.5::DOUBLE * loss_follower END")} AS total_loss
FROM (SELECT step, avg(CASE WHEN sample_idx % 2 = 0 THEN seq_loss END) AS loss_leader,
             avg(CASE WHEN sample_idx % 2 = 1 THEN seq_loss END) AS loss_follower FROM pl GROUP BY step)""",
   ["rollouts"], [("pa", padj("rollouts")), ("pl", ploss("pa", False))])
_o("alternating_update_separate", f"""SELECT step, {r6('loss_leader')} AS loss_leader, {r6('loss_follower')} AS loss_follower,
       {r6("(loss_leader + loss_follower) / 2")} AS total_loss
FROM (SELECT step, avg(CASE WHEN sample_idx % 2 = 0 THEN seq_loss END) AS loss_leader,
             avg(CASE WHEN sample_idx % 2 = 1 THEN seq_loss END) AS loss_follower FROM pl GROUP BY step)""",
   ["rollouts"], [("pa", padj("rollouts")), ("pl", ploss("pa", False))])


def clipped(src: str) -> str:
    return f"""SELECT *, greatest(-advantage * ratio, -advantage * least(greatest(ratio, 0.8::DOUBLE), 1.2::DOUBLE)) AS pg_loss,
       (-advantage * least(greatest(ratio, 0.8::DOUBLE), 1.2::DOUBLE)) > (-advantage * ratio) AS clipped,
       0.5::DOUBLE * d * d AS approxkl
FROM (SELECT *, exp(d) AS ratio FROM (SELECT *, {asum('model_logps')} - {asum('gen_logps')} AS d FROM {src}))"""


_o("clipped_policy_loss", f"""SELECT {ROLL_KEYS}, {r6('ratio')} AS ratio, {r6('pg_loss')} AS pg_loss,
       {r6('approxkl')} AS approxkl, clipped FROM c""", ["rollouts"],
   [("a", adv("rollouts", "score")), ("c", clipped("a"))])


def side(name: str, parity: int, prob: str) -> list[tuple[str, str]]:
    return [(f"{name}_in", f"SELECT * EXCLUDE (prob), prob AS prob_raw, {prob} AS prob, sample_idx // 2 AS pair "
                           f"FROM rollouts WHERE sample_idx % 2 = {parity}"),
            (f"{name}_pa", padj(f"{name}_in")), (name, ploss(f"{name}_pa", False))]


_m = [("l.score", "score_leader"), ("f.score", "score_follower"), ("l.kl", "kl_leader"), ("f.kl", "kl_follower"),
      ("l.seq_loss", "loss_leader"), ("f.seq_loss", "loss_follower"),
      (f"{asum('l.model_logps')}", "logps_leader"), (f"{asum('f.model_logps')}", "logps_follower"),
      ("l.prob_raw", "probabilities"), (f"-{asum('l.model_logps')}", "entropy_leader"),
      (f"-{asum('f.model_logps')}", "entropy_follower"),
      (f"{asum('l.model_logps')} - {asum('f.model_logps')}", "margins"),
      ("CAST(l.has_eos AS DOUBLE)", "leader_contain_eos"), ("CAST(f.has_eos AS DOUBLE)", "follower_contain_eos"),
      ("CAST(len(l.model_logps) AS DOUBLE)", "leader_completion_length"),
      ("CAST(len(f.model_logps) AS DOUBLE)", "follower_completion_length")]
_o("rollout_metrics", "SELECT l.step, " + ", ".join(f"{r6(f'avg({e})')} AS {n}" for e, n in _m)
   + " FROM ls l JOIN fs f ON l.step = f.step AND l.prompt_id = f.prompt_id AND l.pair = f.pair GROUP BY l.step",
   ["rollouts"],
   side("ls", 0, f"prob - 1.0::DOUBLE * {NOEOS}") + side("fs", 1, f"(1.0::DOUBLE - prob) - 1.0::DOUBLE * {NOEOS}"))
_TOKR = "list_transform(range(len(model_logps)), lambda i: exp(model_logps[i + 1] - gen_logps[i + 1]))"
_o("policy_metrics", f"""SELECT step, {r6('avg(seq_kl)')} AS kl, {r6(f"avg(-{asum('model_logps')})")} AS entropy,
       {r6('avg(non_score_reward)')} AS non_score_reward, {r6('avg(rlhf_reward)')} AS rlhf_reward,
       {r6('avg(score_pen)')} AS scores, {r6('avg(CAST(clipped AS DOUBLE))')} AS clipfrac,
       {r6('avg(approxkl)')} AS approxkl, {r6('avg(pg_loss)')} AS policy_loss,
       {r6('sum(tr) / sum(tn)')} AS ratio,
       {r6('CASE WHEN sum(tn) > 1 THEN (sum(tr2) - sum(tr) * sum(tr) / sum(tn)) / (sum(tn) - 1) END')} AS ratio_var,
       CAST(sum(CAST(has_eos AS BIGINT)) AS BIGINT) AS num_eos
FROM (SELECT *, {asum(_TOKR)} AS tr, {asum(f"list_transform({_TOKR}, lambda r: r * r)")} AS tr2,
             len(model_logps) AS tn FROM c)
GROUP BY step""", ["rollouts"], [("k", KLR), ("a", adv("k", "rlhf_reward")), ("c", clipped("a"))])

LOGSIG = "(least({d}, 0.0::DOUBLE) - ln(1.0::DOUBLE + exp(-abs({d}))))"
_D = "(chosen - rejected - margin)"
_o("bradley_terry_loss", f"""SELECT model, attribute,
       {r6(f"sum(loss_weight * -{LOGSIG.format(d=_D)}) / sum(loss_weight) + 0.01::DOUBLE * avg((chosen + rejected) * (chosen + rejected))")} AS bt_loss,
       count(*) AS n_pairs FROM scored_pairs GROUP BY model, attribute""", ["scored_pairs"])
_X = "(chosen - margin)"
_o("weighted_bce_loss", f"""SELECT model, attribute,
       {r6(f"sum(loss_weight * (greatest({_X}, 0.0::DOUBLE) - {_X} * CAST(label AS DOUBLE) + ln(1.0::DOUBLE + exp(-abs({_X}))))) / sum(loss_weight)")} AS bce_loss
FROM scored_pairs GROUP BY model, attribute""", ["scored_pairs"])
_o("preference_accuracy", f"""SELECT model, attribute,
       CAST(sum(CASE WHEN NOT isnan(chosen) AND NOT isnan(rejected) AND chosen > rejected THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS accuracy,
       {r6('avg(1.0::DOUBLE / (1.0::DOUBLE + exp(-(chosen - rejected))))')} AS mean_p_chosen
FROM scored_pairs GROUP BY model, attribute""", ["scored_pairs"])

# ------------------------------------------------------------------ judging
VOTES = f"""SELECT model, split, prompt_id, attribute, s0, s1, CAST({ge('s0', 's1')} AS INTEGER) AS vote FROM (
  SELECT model, split, prompt_id, attribute,
         max(CASE WHEN completion_idx = 0 THEN s END) AS s0, max(CASE WHEN completion_idx = 1 THEN s END) AS s1
  FROM (SELECT *, reward - 1.0::DOUBLE * CAST(NOT ((prompt_id + completion_idx) % 7 <> 0) AS DOUBLE) AS s
        FROM rewards_long WHERE completion_idx <= 1)
  GROUP BY model, split, prompt_id, attribute)"""
_o("multi_attribute_vote", """SELECT model, split, prompt_id, CAST(sum(vote) AS DOUBLE) / count(*) AS p,
       count(*) AS n_attributes FROM votes GROUP BY model, split, prompt_id""", ["rewards_long"], [("votes", VOTES)])
_ATTR_LIST = "['coherence', 'complexity', 'correctness', 'helpfulness', 'verbosity']"
_o("sampled_attribute_vote", f"""SELECT model, split, prompt_id, attribute, vote FROM votes
WHERE attribute = {_ATTR_LIST}[({h('model', 'split', 'prompt_id')} % 5) + 1]""", ["rewards_long"], [("votes", VOTES)])
JP = """SELECT pair_id, round(CASE WHEN failed = 1 THEN 0.5::DOUBLE ELSE pa / (pa + pb + 1e-6) END, 6) AS p,
       lp_a IS NULL AND lp_b IS NULL AND failed = 0 AS both_missing, failed = 1 AS call_failed
FROM (SELECT *, coalesce(exp(lp_a / 1.0::DOUBLE), 0.0::DOUBLE) AS pa, coalesce(exp(lp_b / 1.0::DOUBLE), 0.0::DOUBLE) AS pb
      FROM (SELECT pair_id, max(CASE WHEN token = 'A' THEN logprob END) AS lp_a,
                   max(CASE WHEN token = 'B' THEN logprob END) AS lp_b, max(CAST(call_failed AS INTEGER)) AS failed
            FROM judge_logprobs GROUP BY pair_id))"""
_o("judge_probability", JP, ["judge_logprobs"])
_o("position_debias", f"""SELECT pair_id, flip, CASE WHEN flip THEN 1.0::DOUBLE - p ELSE p END AS p
FROM (SELECT *, {h('pair_id')} % 2 = 1 AS flip FROM jp)""", ["judge_logprobs"], [("jp", JP)])
SCHED = "SELECT prompt_id AS step, model, completion_idx, attribute, reward FROM rewards_long"
_o("attribute_schedule", f"""SELECT step, model, completion_idx, reward AS scheduled_reward FROM sched
WHERE attribute = {_ATTR_LIST}[(step % 5) + 1]""", ["rewards_long"], [("sched", SCHED)])
_o("attribute_schedule_random", f"""SELECT step, model, completion_idx, reward AS scheduled_reward FROM sched
WHERE attribute = {_ATTR_LIST}[({h('step')} % 5) + 1]""", ["rewards_long"], [("sched", SCHED)])
_o("attribute_schedule_average", """SELECT step, model, completion_idx, avg(reward) AS scheduled_reward FROM sched
GROUP BY step, model, completion_idx""", ["rewards_long"], [("sched", SCHED)])


# ------------------------------------------------------------------ sources / sinks
_o("read_table", "SELECT doc_id, text, lang, source, n_chars FROM documents")
_o("write_splits", "SELECT id, worker, split FROM tldr_raw", ["tldr_raw"])
_o("read_splits", "SELECT id, worker, split FROM tldr_raw WHERE split = 'validation'", ["tldr_raw"])
_o("read_jsonl", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
_o("expand_attribute_paths", """SELECT attribute, model, count(*) AS n_rows, max(reward) AS best
FROM rewards_long GROUP BY attribute, model""", ["rewards_long"])
_o("split_row_counts", """SELECT split, count(*) AS n_rows, 'raw' AS stage FROM tldr_raw GROUP BY split
UNION ALL SELECT split, count(*), 'worker_filter' FROM kept GROUP BY split""", ["tldr_raw"],
   [("wc", WC), ("kept", SEMI.format(min_n=43, only=""))])
MIXTURE = f"SELECT id AS prompt_id, {umsg('article')} AS prompt FROM tldr_raw"
_o("source_preference_mixture", MIXTURE, ["tldr_raw"])
_o("source_preference_mixture_pairs", f"SELECT id AS prompt_id, chosen, rejected FROM ({CHOICE.format(src='tldr_raw')})", ["tldr_raw"])
IEVAL = f"""SELECT row_number() OVER (ORDER BY item_id) - 1 AS prompt_id, {umsg('text')} AS prompt,
       'validation' AS split FROM benchmark"""
_o("source_instruction_eval", IEVAL)
_o("source_constraint_eval", IEVAL)
IEVAL_COLUMNS = f"""SELECT row_number() OVER (ORDER BY item_id) - 1 AS prompt_id, {umsg('text')} AS prompt,
       CAST(length(text) AS INTEGER) AS n_chars, 'validation' AS split FROM benchmark"""
_o("source_instruction_eval_columns", IEVAL_COLUMNS)
_o("source_constraint_eval_columns", IEVAL_COLUMNS)
_o("normalize_source", f"""SELECT 'instruction_eval' AS source, CAST(prompt_id AS VARCHAR) AS prompt_id, prompt, split FROM ({IEVAL})
UNION ALL SELECT 'rated_pairs', CAST(prompt_id AS VARCHAR), {umsg('prompt')}, split FROM sp
UNION ALL SELECT 'preference_mixture', CAST(prompt_id AS VARCHAR), prompt, 'train' FROM ({MIXTURE})
UNION ALL SELECT 'constraint_eval', CAST(prompt_id AS VARCHAR), prompt, split FROM ({IEVAL})""", ["rated_responses", "tldr_raw"],
   [("pairs", PAIRS), ("sp", SPLIT)])


def feistel(x: str) -> str:
    """One pass of six alternating rounds on (x // b, x % b), as columns l and r of nested selects."""
    sql = f"SELECT *, {x} // b AS l, {x} % b AS r FROM {{src}}"
    for k in range(6):
        key = h("step", "epoch", str(k), "l" if k % 2 else "r")
        new = f"(r + {key}) % b AS r" if k % 2 else f"(l + {key}) % a AS l"
        sql = f"SELECT * REPLACE ({new}) FROM ({sql})"
    return f"SELECT * REPLACE (l * b + r AS x) FROM ({sql})"


_PERMUTED = """SELECT step, sample_idx, prompt_id * 4 + sample_idx - step * 64 AS position, CAST(e AS INTEGER) AS epoch,
       count(*) OVER (PARTITION BY step, e) AS n FROM rollouts, range(2) t(e)"""
_o("permuted_batches", """SELECT step, sample_idx, position, epoch, CAST(x AS INTEGER) AS perm_rank,
       CAST(floor(x / 16) AS BIGINT) AS mini_batch, CAST(floor((x % 16) / 4) AS BIGINT) AS micro_batch FROM walk WHERE x < n""", ["rollouts"], [
    ("start", f"""SELECT *, CAST(ceil(n / CAST(ceil(sqrt(n)) AS BIGINT)) AS BIGINT) AS b, CAST(ceil(sqrt(n)) AS BIGINT) AS a, position AS x FROM ({_PERMUTED})"""),
    ("walk", f"""SELECT step, sample_idx, position, epoch, n, a, b, x FROM ({feistel('x').format(src='start')})
UNION ALL SELECT step, sample_idx, position, epoch, n, a, b, x FROM ({feistel('x').format(src="(SELECT * FROM walk WHERE x >= n)")})""")], recursive=True)
_o("random_permutation_batches", f"""SELECT step, row_key, sample_idx, epoch, perm_rank,
       CAST(floor(perm_rank / 16) AS BIGINT) AS mini_batch, CAST(floor((perm_rank % 16) / 4) AS BIGINT) AS micro_batch
FROM (SELECT step, row_key, sample_idx, epoch,
             CAST(row_number() OVER (PARTITION BY step, epoch ORDER BY {h('step', 'epoch', 'row_key')}, row_key) - 1 AS INTEGER) AS perm_rank
      FROM (SELECT step, prompt_id * 4 + sample_idx AS row_key, sample_idx, CAST(e AS INTEGER) AS epoch FROM rollouts, range(2) t(e)))""",
   ["rollouts"])
_o("instruction_accuracy", """SELECT completion_idx,
       CAST(sum(CAST(ps AS BIGINT)) AS DOUBLE) / count(*) AS prompt_strict,
       CAST(sum(CAST(pl AS BIGINT)) AS DOUBLE) / count(*) AS prompt_loose,
       CAST(sum(is_) AS DOUBLE) / sum(n) AS instruction_strict, CAST(sum(il) AS DOUBLE) / sum(n) AS instruction_loose
FROM (SELECT completion_idx, prompt_id, bool_and(followed_strict) AS ps, bool_and(followed_loose) AS pl,
             sum(CAST(followed_strict AS BIGINT)) AS is_, sum(CAST(followed_loose AS BIGINT)) AS il, count(*) AS n
      FROM instruction_results GROUP BY completion_idx, prompt_id) GROUP BY completion_idx""", ["instruction_results"])
_o("score_with", f"""SELECT prompt_id, completion_idx, 'length' AS attribute, CAST(len(tc) AS DOUBLE) AS reward FROM tk
UNION ALL
SELECT prompt_id, completion_idx, 'lexical_overlap',
       CASE WHEN len(list_distinct(tc)) > 0 THEN len(list_distinct(list_intersect(tp, tc))) / len(list_distinct(tc))
            ELSE 0.0::DOUBLE END FROM tk""", ["generations"], [
    ("fl", """SELECT prompt_id, prompt, CAST(i AS INTEGER) AS completion_idx, comps[i + 1].text AS completion
              FROM (SELECT prompt_id, prompt, comps, unnest(range(len(comps))) AS i FROM generations)"""),
    ("tk", f"""SELECT prompt_id, completion_idx, regexp_extract_all(prompt, {TOKEN}) AS tp,
               regexp_extract_all(completion, {TOKEN}) AS tc FROM fl""")])
ROLLUP = """SELECT time_bucket(INTERVAL '1 day', ts) AS window_start,
       time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end,
       event_type AS metric, count(*) AS n, round(sum(value), 6) AS sum_value, round(avg(value), 6) AS mean_value
FROM events GROUP BY 1, 2, 3"""
_o("metric_rollup", ROLLUP)
_o("metric_rollup_stream", ROLLUP)
_o("metric_rollup_sliding", """SELECT d - INTERVAL (k) DAY AS window_start, d - INTERVAL (k) DAY + INTERVAL '2 days' AS window_end,
       event_type AS metric, count(*) AS n, round(sum(value), 6) AS sum_value, round(avg(value), 6) AS mean_value
FROM (SELECT *, time_bucket(INTERVAL '1 day', ts) AS d, unnest([0, 1]) AS k FROM events) GROUP BY 1, 2, 3""")
# windows whose end the watermark (last event less one day) has passed
_o("metric_rollup_append", f"""SELECT * FROM ({ROLLUP})
WHERE window_end <= (SELECT max(ts) - INTERVAL '1 day' FROM events)""")
_o("select_rename", "SELECT doc_id AS prompt_id, text AS prompt, source FROM documents")

_FL = ("fl", """SELECT prompt_id, prompt, CAST(i AS INTEGER) AS completion_idx, comps[i + 1].text AS completion
              FROM (SELECT prompt_id, prompt, comps, unnest(range(len(comps))) AS i FROM generations)""")
_o("score_with_udf", f"""SELECT prompt_id, completion_idx, 'length' AS attribute,
       CAST(len(regexp_extract_all(coalesce(completion, ''), {TOKEN})) AS DOUBLE) AS reward FROM fl
UNION ALL
SELECT prompt_id, completion_idx, 'prompt_ratio',
       length(coalesce(completion, '')) / (1.0::DOUBLE + length(coalesce(prompt, ''))) FROM fl""",
   ["generations"], [_FL])
_o("judge_with", f"""SELECT pair_id, flip, CASE WHEN flip THEN 1.0::DOUBLE - p_raw ELSE p_raw END AS p FROM (
  SELECT pair_id, flip, CASE WHEN length(coalesce(a, '')) > length(coalesce(b, '')) THEN 1.0::DOUBLE
                             WHEN length(coalesce(a, '')) = length(coalesce(b, '')) THEN 0.5::DOUBLE
                             ELSE 0.0::DOUBLE END AS p_raw
  FROM (SELECT pair_id, flip, CASE WHEN flip THEN r1 ELSE r0 END AS a, CASE WHEN flip THEN r0 ELSE r1 END AS b
        FROM (SELECT prompt_id AS pair_id, comps[1].text AS r0, comps[2].text AS r1,
                     {h('prompt_id')} % 2 = 1 AS flip FROM generations WHERE len(comps) >= 2)))""",
   ["generations"])
_UNSURE = f"""SELECT pair_id, flip, left(coalesce(a, ''), 1) = left(coalesce(b, ''), 1) AS failed,
       (length(coalesce(a, '')) + 1.0::DOUBLE) / (length(coalesce(a, '')) + length(coalesce(b, '')) + 2.0::DOUBLE) AS share
FROM (SELECT pair_id, flip, CASE WHEN flip THEN r1 ELSE r0 END AS a, CASE WHEN flip THEN r0 ELSE r1 END AS b
      FROM (SELECT prompt_id AS pair_id, comps[1].text AS r0, comps[2].text AS r1, {h('prompt_id')} % 2 = 1 AS flip
            FROM generations WHERE len(comps) >= 2))"""
_o("judge_with_failures", """SELECT pair_id, flip, round(CASE WHEN failed THEN 0.5::DOUBLE WHEN flip THEN 1.0::DOUBLE - share ELSE share END, 6) AS p,
       failed, CAST(CASE WHEN failed THEN 2 ELSE 1 END AS INTEGER) AS calls FROM u""", ["generations"], [("u", _UNSURE)])
_o("judge_failures", """SELECT flip, count(*) AS n_pairs, CAST(sum(CAST(failed AS INTEGER)) AS BIGINT) AS n_failed,
       CAST(sum(CASE WHEN failed THEN 2 ELSE 1 END) AS BIGINT) AS n_calls FROM u GROUP BY flip""", ["generations"], [("u", _UNSURE)])


def newton_ctes(steps: int, reg: float) -> list[tuple[str, str]]:
    """Weights (w0, w1) of each attribute after 0, 1, ... steps, by Cramer's rule on two features."""
    out = [("wt0", "SELECT DISTINCT attribute, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1 FROM dd")]
    for k in range(steps):
        out.append((f"sy{k}", f"""SELECT attribute, w0, w1, -sum((1 - p) * d0) / count(*) + {reg}::DOUBLE * w0 AS g0, -sum((1 - p) * d1) / count(*) + {reg}::DOUBLE * w1 AS g1,
       sum(p * (1 - p) * d0 * d0) / count(*) + {reg}::DOUBLE AS h00, sum(p * (1 - p) * d0 * d1) / count(*) AS h01, sum(p * (1 - p) * d1 * d1) / count(*) + {reg}::DOUBLE AS h11
FROM (SELECT dd.*, w0, w1, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(w0 * d0 + w1 * d1))) AS p FROM dd JOIN wt{k} USING (attribute)) GROUP BY attribute, w0, w1"""))
        out.append((f"wt{k + 1}", f"""SELECT attribute, w0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS w0,
       w1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS w1 FROM sy{k}"""))
    return out


_DIFF = """SELECT l.attribute, CASE WHEN l.label = 1 THEN c0 - c1 ELSE c1 - c0 END AS d0, CASE WHEN l.label = 1 THEN v0 - v1 ELSE v1 - v0 END AS d1
FROM labels l JOIN (SELECT prompt_id, max(CASE WHEN attribute = 'coherence' AND completion_idx = 0 THEN mean END) AS c0,
                           max(CASE WHEN attribute = 'coherence' AND completion_idx = 1 THEN mean END) AS c1,
                           max(CASE WHEN attribute = 'verbosity' AND completion_idx = 0 THEN mean END) AS v0,
                           max(CASE WHEN attribute = 'verbosity' AND completion_idx = 1 THEN mean END) AS v1
                    FROM stats GROUP BY prompt_id) USING (prompt_id) WHERE c0 IS NOT NULL AND c1 IS NOT NULL AND v0 IS NOT NULL AND v1 IS NOT NULL"""
_o("reward_newton_steps", """SELECT attribute, 'coherence' AS feature, round(w0, 6) AS weight FROM wt4
UNION ALL SELECT attribute, 'verbosity', round(w1, 6) FROM wt4""", ["annotation_ratings"], _LCTES + [("dd", _DIFF), *newton_ctes(4, 0.1)])

_o("tokenize_with", f"""SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_ids, ids AS input_ids FROM (SELECT doc_id,
  CAST(list_transform(regexp_extract_all(coalesce(text, ''), {TOKEN}),
                      lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 50000) AS INTEGER[]) AS ids FROM documents)""")
