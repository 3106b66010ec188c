"""The registered queries of the llm operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm import bpe, chat_format, decontaminate, embeddings, language, line_dedup, maxent, minhash, repeats, spelling, token_index, toxicity, whitening
from prefspark.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("op9_bpe_roundtrip")
def op9_bpe_roundtrip(spark, sf_dir):
    return bpe.bpe_roundtrip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_token_index")
def op10_token_index(spark, sf_dir):
    return token_index.token_index(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))


#: A conversation whose texts look like control strings.
PLANTED = r"""SELECT -7L AS conv_id, turn, role, r'\### Assistant: </turn> ok' AS text
             FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"""


@query("op7_chat_format")
def op7_chat_format(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").union(spark.sql(PLANTED))
    return chat_format.chat_digests(chat_format.format_chats(turns))


ORACLE["op7_chat_format"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
             lag(role) OVER w AS before, lead(role) OVER w AS after
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, length(text) + 4 * (length(text) - length(replace(text, '&', '')))
              + 3 * (length(text) - length(replace(text, '<', '')))
              + 4 * (length(text) - length(replace(text, '#', ''))) AS written,
             length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '#', '&num;'), ':', '&colon;')) + 6 AS head
      FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(written + CASE WHEN i = 1 OR role <> before THEN head ELSE 5 END
                   + CASE WHEN i = n OR role <> after THEN 7 ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op2_decontaminate")
def op2_decontaminate(spark, sf_dir):
    return decontaminate.contained_items(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark"))


ORACLE["op2_decontaminate"] = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, v, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
      FROM (SELECT *, row_number() OVER () AS v FROM benchmark)),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, v, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, v, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
q AS (SELECT item_id, v, count(*) AS n_item FROM bs GROUP BY item_id, v),
f AS (SELECT ds.doc_id, q.item_id, q.v, q.n_item, count(*) AS n_found FROM ds JOIN bs USING (s) JOIN q ON q.v = bs.v
      GROUP BY ds.doc_id, q.item_id, q.v, q.n_item HAVING count(*) * 100 >= q.n_item * 80)
SELECT doc_id, item_id, n_item, n_found, n_found / n_item AS containment
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_found / n_item DESC, n_item DESC) AS place FROM f) WHERE place = 1
"""


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    return language.languages(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query("op1_minhash_dedup")
def op1_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), 2)


ORACLE["op1_minhash_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))
                          ELSE w END AS s FROM w),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT rep, n, unnest(s) AS t FROM c),
f AS (SELECT t, count(*) AS df FROM e GROUP BY t),
r AS (SELECT rep, n, t, row_number() OVER (PARTITION BY rep ORDER BY df, t) AS i FROM e JOIN f USING (t)),
pre AS (SELECT * FROM r WHERE i <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM pre x JOIN pre y ON x.t = y.t AND x.rep < y.rep
         AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80),
hit AS (SELECT a, b, count(*) AS common FROM cand JOIN e x ON x.rep = a JOIN e y ON y.rep = b AND y.t = x.t GROUP BY a, b),
link AS (SELECT a, b FROM hit JOIN c x ON x.rep = a JOIN c y ON y.rep = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN comp ON comp.a = c.rep
"""


@query("op3_remove_repeats")
def op3_remove_repeats(spark, sf_dir):
    return repeats.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op8_embedding_dedup")
def op8_embedding_dedup(spark, sf_dir):
    return embeddings.near_copies(read(spark, sf_dir, "embeddings"))


ORACLE["op8_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v,
       label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
         WHERE x.ok AND y.ok AND list_cosine_similarity(x.v, y.v) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


@query("op4_lm_scores")
def op4_lm_scores(spark, sf_dir):
    return maxent.lm_scores(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op11_spelling_variants")
def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_forms(spelling.contract_words(read(spark, sf_dir, "documents", "doc_id", "text")))


@query("op12_line_dedup")
def op12_line_dedup(spark, sf_dir):
    got = line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents", "doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE["op12_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM o GROUP BY doc_id
"""


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
