"""Batch RAG plans: the corpus is the article chunks extracted from ``pages``
(with title and URL), the questions are the user messages of
``conversations`` and a question's history is the conversation before it.

"The last 20 messages" are rows, however ``turn`` skips: messages are numbered
within their conversation (ranks within runs of turns and running counts of the
runs, no window over a whole conversation), each question asks for the 20 places
before its own (bounded fan-out), and texts join only where they are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import chunk as C
from skein.operators import embed as E
from skein.operators import rag as G
from skein.operators import retrieval as R
from skein.operators import sessions as SS
from skein.operators.extract import extract_articles
from skein.plans import sqltext as S
from skein.plans.chunks import _ARTICLES_SQL
from skein.plans.embedding import _sparse_sql
from skein.plans.registry import load, pair_key, register, stored
from skein.session import write_shared

K = 5
K_SOURCES = 3
HISTORY_MESSAGES = 2 * SS.DEFAULT_MAX_TURNS
LAST_TURNS = 3
SIZE, STEP = C.DEFAULT_CHUNK_SIZE, C.DEFAULT_CHUNK_SIZE - C.DEFAULT_CHUNK_OVERLAP
EXTRACT_TIME = "2024-01-01 00:00:00"


def article_chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "pages", spread=True)
    arts = extract_articles(p, extracted_at=F.lit(EXTRACT_TIME))
    ch = C.chunk_fixed(arts.select("page_id", F.col("url").alias("article_id"), "title",
                                   "url", "text"))
    return ch.select(pair_key("page_id", "chunk_index").alias("chunk_id"),
                     "article_id", "title", "url", "chunk")


def user_questions(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations")
    return c.filter(F.col("role") == "user").select(
        pair_key("conv_id", "turn").alias("query_id"), "conv_id", "turn",
        F.col("text").alias("question"))


def article_index(spark: SparkSession, sf: str) -> DataFrame:
    """Article chunks with vectors: the stored index that every RAG step reads."""
    return stored(spark, sf, "article-index", ["pages"],
                  # extracted once, read twice
                  lambda s, d: E.embed_dedup(write_shared(article_chunk_table(s, d), "chunks"), "chunk"))


def rag_hits(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    index = article_index(spark, sf)
    q = user_questions(spark, sf)
    # read twice below, which would search twice
    hits = write_shared(R.search(q.select("query_id", F.col("question").alias("text")), index, k=k), "found")
    # citations read their hits twice: search once, keep the few rows
    return write_shared(R.with_chunks(hits, index.select("chunk_id", "title", "url", "chunk")), "hits")


def prompt_histories(spark: SparkSession, sf: str) -> DataFrame:
    """History lines of each question: its keys are fanned out to the turns
    before it, the texts join afterwards, each only where it is needed."""
    c = load(spark, sf, "conversations")
    # the places of all messages, without their texts: read twice below
    at = write_shared(SS.positions(c.select("conv_id", "turn", "role"), "conv_id", "turn"), "positions")
    before = F.explode(F.transform(F.sequence(F.lit(1), F.lit(HISTORY_MESSAGES)), lambda d: F.col("pos") - d))
    wanted = at.where(F.col("role") == "user").select(pair_key("conv_id", "turn").alias("query_id"), "conv_id",
                                                      before.alias("pos")).where("pos >= 0")
    found = wanted.join(at.select("conv_id", "pos", "turn"), ["conv_id", "pos"]).join(
        c, ["conv_id", "turn"])
    return G.prompt_history(found.select("query_id", F.col("turn").alias("seq"), "role",
                                         F.col("text").alias("content")))


# --- DuckDB --------------------------------------------------------------

_RAG_SQL = _ARTICLES_SQL + f""",
s2 AS (SELECT page_id, article_id, url, title, text,
              unnest(CASE WHEN length(text) <= {SIZE} THEN [0::BIGINT]
                          ELSE range(0, length(text), {STEP}) END) AS st FROM a),
ch AS (SELECT page_id || ':' || (st // {STEP}) AS chunk_id, article_id, title, url,
              substr(text, st + 1, {SIZE}) AS chunk FROM s2),
uq AS (SELECT conv_id || ':' || turn AS query_id, conv_id, turn, text AS question
       FROM conversations WHERE role = 'user'),
""" + _sparse_sql("ch", "chunk_id", "chunk", "cv") + "," + \
    _sparse_sql("uq", "query_id", "question", "qv") + """,
cn AS (SELECT ch.chunk_id, coalesce(sum(cv.w * cv.w), 0) AS nn FROM ch
       LEFT JOIN cv ON cv.chunk_id = ch.chunk_id GROUP BY ch.chunk_id),
qn AS (SELECT uq.query_id, coalesce(sum(qv.w * qv.w), 0) AS nn FROM uq
       LEFT JOIN qv ON qv.query_id = uq.query_id
       WHERE NOT {blank} GROUP BY uq.query_id),
dots AS (SELECT qv.query_id, cv.chunk_id, sum(qv.w * cv.w) AS dot
         FROM qv JOIN cv USING (bucket) GROUP BY ALL),
pairs AS (SELECT qn.query_id, cn.chunk_id,
                 greatest(qn.nn + cn.nn - 2 * coalesce(dots.dot, 0), 0) AS distance
          FROM qn CROSS JOIN cn
          LEFT JOIN dots ON dots.query_id = qn.query_id AND dots.chunk_id = cn.chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id
                                        ORDER BY round(distance, 9), chunk_id) AS rank FROM pairs),
hits AS (SELECT r.query_id, r.rank, r.chunk_id, r.distance, 1.0 / (1.0 + r.distance) AS similarity,
                ch.title, ch.url, ch.chunk
         FROM ranked r JOIN ch USING (chunk_id) WHERE r.rank <= {k})
""".replace("{blank}", S.blank("uq.question"))


def _rag_sql(k: int) -> str:
    return _RAG_SQL.replace("{k}", str(k))


_CTX_NUM = "string_agg('[' || rank || '] ' || title || chr(10) || chunk || chr(10), chr(10) ORDER BY rank)"
_CTX_SRC = ("string_agg('[Source ' || rank || ': ' || title || ']' || chr(10) || chunk || chr(10), "
            "chr(10) ORDER BY rank)")


@register("context_numbered", sql=_rag_sql(K) + f"""
SELECT uq.query_id, coalesce({_CTX_NUM}, '') AS context
FROM uq LEFT JOIN hits h ON h.query_id = uq.query_id GROUP BY uq.query_id""")
def q_context_numbered(spark, sf):
    return G.context_numbered(rag_hits(spark, sf), user_questions(spark, sf))


@register("context_sources", sql=_rag_sql(K_SOURCES) + f"""
SELECT uq.query_id, coalesce({_CTX_SRC}, '') AS context
FROM uq LEFT JOIN hits h ON h.query_id = uq.query_id GROUP BY uq.query_id""")
def q_context_sources(spark, sf):
    return G.context_sources(rag_hits(spark, sf, K_SOURCES), user_questions(spark, sf))


@register("search_with_sources", sql=_rag_sql(K_SOURCES) + """
SELECT query_id, rank AS source_no, title, url, round(similarity, 6) AS similarity FROM hits""")
def q_search_with_sources(spark, sf):
    out = G.search_with_sources(rag_hits(spark, sf, K_SOURCES), user_questions(spark, sf))
    x = out.select("query_id", F.posexplode("sources").alias("pos", "s"))
    return x.select("query_id", (F.col("pos") + 1).cast("bigint").alias("source_no"),
                    "s.title", "s.url", F.round("s.similarity", 6).alias("similarity"))


@register("history_last_n", sql=f"""
SELECT conv_id, turn, role FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {2 * LAST_TURNS}""")
def q_history_last_n(spark, sf):
    c = load(spark, sf, "conversations")
    h = SS.history_last_n(c, LAST_TURNS, session="conv_id", seq="turn")
    return h.select("conv_id", "turn", "role")


_CAP = "upper(left(role, 1)) || lower(substr(role, 2))"


@register("history_text", sql=f"""
WITH last AS (SELECT * FROM conversations
              QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {HISTORY_MESSAGES})
SELECT conv_id, string_agg({_CAP} || ': ' || text, chr(10) ORDER BY turn) AS history_text
FROM last GROUP BY conv_id""")
def q_history_text(spark, sf):
    c = load(spark, sf, "conversations")
    h = SS.history_last_n(c, SS.DEFAULT_MAX_TURNS, session="conv_id", seq="turn")
    return SS.history_text(h, session="conv_id", seq="turn", content="text")


@register("session_append", sql=f"""
WITH pairs AS (
  SELECT u.conv_id, u.turn AS turn_order, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
last AS (SELECT conv_id, max(turn) AS mx FROM conversations GROUP BY conv_id),
new AS (
  SELECT p.conv_id, coalesce(l.mx, -1) + 1 + 2 * p.turn_order AS seq, 'user' AS role, p.question AS content
  FROM pairs p LEFT JOIN last l USING (conv_id)
  UNION ALL
  SELECT p.conv_id, coalesce(l.mx, -1) + 2 + 2 * p.turn_order, 'assistant', p.answer
  FROM pairs p LEFT JOIN last l USING (conv_id)),
allm AS (SELECT conv_id, turn AS seq, role, text AS content FROM conversations UNION ALL
         SELECT * FROM new)
SELECT conv_id, seq, role, content FROM allm
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) <= {HISTORY_MESSAGES}""")
def q_session_append(spark, sf):
    c = load(spark, sf, "conversations")
    msgs = c.select("conv_id", F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    users = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    answers = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    turns = users.join(answers, ["conv_id", "turn"]).withColumnRenamed("turn", "turn_order")
    return SS.session_append(msgs, turns, session="conv_id", seq="seq")


@register("session_clear", sql="""
WITH last AS (SELECT conv_id, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn FROM conversations c
WHERE c.conv_id NOT IN (SELECT conv_id FROM last WHERE last_role = 'user')""")
def q_session_clear(spark, sf):
    c = load(spark, sf, "conversations")
    last = c.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"))
    cleared = last.filter(F.col("last_role") == "user").select("conv_id")
    return SS.session_clear(c, cleared, session="conv_id").select("conv_id", "turn")


_SYS = S.lit(G.SYSTEM_PROMPT)


@register("prompt_build", sql=_rag_sql(K) + f"""
, ctx AS (SELECT uq.query_id, coalesce({_CTX_NUM}, '') AS context
          FROM uq LEFT JOIN hits h ON h.query_id = uq.query_id GROUP BY uq.query_id),
cm AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
hist AS (SELECT uq.query_id,
                string_agg({_CAP.replace('role', 'm.role')} || ': ' || m.text || chr(10), '' ORDER BY m.turn)
                  AS history_lines
         FROM uq JOIN cm o ON o.conv_id = uq.conv_id AND o.turn = uq.turn
         JOIN cm m ON m.conv_id = uq.conv_id AND m.rn < o.rn AND m.rn >= o.rn - {HISTORY_MESSAGES}
         GROUP BY uq.query_id)
SELECT uq.query_id, uq.question,
       {_SYS}
       || CASE WHEN coalesce(hist.history_lines, '') <> ''
               THEN {S.lit(G.HISTORY_HEADER)} || hist.history_lines ELSE '' END
       || CASE WHEN coalesce(ctx.context, '') <> '' THEN {S.lit(G.CONTEXT_HEADER)} || ctx.context
               ELSE {S.lit(G.NO_CONTEXT)} END
       || {S.lit(chr(10) + chr(10) + 'QUESTION: ')} || uq.question || {S.lit(chr(10) + chr(10) + 'ANSWER:')}
         AS prompt
FROM uq LEFT JOIN ctx USING (query_id) LEFT JOIN hist USING (query_id)""")
def q_prompt_build(spark, sf):
    q = user_questions(spark, sf)
    ctx = G.context_numbered(rag_hits(spark, sf), q)
    return G.prompts(q, ctx, prompt_histories(spark, sf))


@register("citations", sql=_rag_sql(K) + """
, ans AS (SELECT uq.query_id, a.text AS answer FROM uq JOIN conversations a
          ON a.conv_id = uq.conv_id AND a.turn = uq.turn + 1 AND a.role = 'assistant'),
nums AS (SELECT DISTINCT query_id, TRY_CAST(unnest(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1)) AS BIGINT) AS n
         FROM ans),
hv AS (SELECT * FROM hits WHERE coalesce(url, '') <> ''),
cited AS (SELECT hv.query_id, hv.rank, hv.title, hv.url FROM nums JOIN hv
          ON hv.query_id = nums.query_id AND hv.rank = nums.n),
ex AS (SELECT query_id, url, min(rank) AS source_no, arg_min(title, rank) AS title FROM cited GROUP BY ALL),
fb AS (SELECT query_id, url, min(rank) AS source_no, arg_min(title, rank) AS title FROM hv
       WHERE query_id IN (SELECT query_id FROM ans) AND query_id NOT IN (SELECT query_id FROM ex)
       GROUP BY ALL)
SELECT query_id, source_no, title, url FROM ex UNION ALL SELECT query_id, source_no, title, url FROM fb""")
def q_citations(spark, sf):
    q = user_questions(spark, sf)
    c = load(spark, sf, "conversations").filter(F.col("role") == "assistant")
    ans = q.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"),
                          F.col("text").alias("answer")), ["conv_id", "turn"])
    return G.citations(ans.select("query_id", "answer"), rag_hits(spark, sf))


NO_ANSWER = "I don't have information about that in the provided context."
_FIRST, _SECOND = G.CONTEXT_HEADER + "[1] ", "\n\n[2] "


def extractive_answer(prompts: list) -> list:
    """Stand-in answer model for the plans: quotes the whole top-ranked
    context chunk of the prompt (its last context block; histories and
    questions come before and after it) and cites it as [1]."""
    out = []
    for p in prompts:
        context = p[:p.rfind("\n\nQUESTION: ")]
        at = context.rfind(_FIRST)
        if at < 0:
            out.append(NO_ANSWER)
            continue
        block = context[at + len(_FIRST):].split(_SECOND, 1)[0]
        out.append(block.partition("\n")[2].removesuffix("\n") + " [1]")
    return out


_ANSWERS_SQL = _rag_sql(K) + f"""
, made AS (SELECT uq.query_id, uq.conv_id, uq.question,
                  CASE WHEN {S.blank('uq.question')} THEN NULL
                       WHEN h.chunk_id IS NULL THEN {S.lit(NO_ANSWER)}
                       ELSE h.chunk || ' [1]' END AS answer,
                  CASE WHEN {S.blank('uq.question')} THEN 'Question cannot be empty' END AS error
           FROM uq LEFT JOIN hits h ON h.query_id = uq.query_id AND h.rank = 1)"""


@register("answer_generate", sql=_ANSWERS_SQL + " SELECT query_id, answer, error FROM made")
def q_answer_generate(spark, sf):
    q = user_questions(spark, sf)
    ctx = G.context_numbered(rag_hits(spark, sf), q)
    pr = G.prompts(q, ctx, prompt_histories(spark, sf))
    return G.answer_generate(pr, extractive_answer).select("query_id", "answer", "error")


# The batch asks every conversation's user messages again, after all that it holds.
_TURNS_SQL = _ANSWERS_SQL + f""",
n AS (SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY conv_id),
asked AS (SELECT made.*, uq.turn, n.n, n.last,
                 coalesce(sum(CASE WHEN made.error IS NULL THEN 1 ELSE 0 END) OVER (
                   PARTITION BY uq.conv_id ORDER BY uq.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                   AS before
          FROM made JOIN uq USING (query_id) JOIN n ON n.conv_id = uq.conv_id),
said AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, turn AS seq, role, text AS content
  FROM conversations
  UNION ALL
  SELECT conv_id, n + 2 * before + 1, last + 1 + 2 * turn, 'user', question FROM asked WHERE error IS NULL
  UNION ALL
  SELECT conv_id, n + 2 * before + 2, last + 2 + 2 * turn, 'assistant', answer FROM asked WHERE error IS NULL)"""


@register("rag_batch", sql=_TURNS_SQL + f"""
, nums AS (SELECT DISTINCT query_id,
                  TRY_CAST(unnest(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1)) AS BIGINT) AS n FROM made),
hv AS (SELECT * FROM hits WHERE coalesce(url, '') <> ''),
ex AS (SELECT hv.query_id, url, min(rank) AS source_no FROM nums
       JOIN hv ON hv.query_id = nums.query_id AND hv.rank = nums.n GROUP BY ALL),
fb AS (SELECT query_id, url, min(rank) AS source_no FROM hv
       WHERE query_id NOT IN (SELECT query_id FROM ex) GROUP BY ALL),
src AS (SELECT query_id, string_agg(source_no || ' ' || url, chr(10) ORDER BY source_no) AS sources
        FROM (SELECT * FROM ex UNION ALL SELECT * FROM fb) GROUP BY query_id),
ctx AS (SELECT uq.query_id, coalesce({_CTX_NUM}, '') AS context
        FROM uq LEFT JOIN hits h ON h.query_id = uq.query_id GROUP BY uq.query_id),
hist AS (SELECT a.query_id, string_agg({_CAP.replace('role', 's.role')} || ': ' || s.content || chr(10), ''
                                       ORDER BY s.pos) AS lines
         FROM asked a JOIN said s ON s.conv_id = a.conv_id AND s.pos <= a.n + 2 * a.before
              AND s.pos > a.n + 2 * a.before - {HISTORY_MESSAGES}
         GROUP BY a.query_id)
SELECT a.query_id, a.conv_id::VARCHAR AS session_id, a.question, a.answer, a.error, src.sources,
       md5({_SYS} || {S.lit(G.HISTORY_HEADER)} || hist.lines
           || CASE WHEN ctx.context <> '' THEN {S.lit(G.CONTEXT_HEADER)} || ctx.context ELSE {S.lit(G.NO_CONTEXT)} END
           || {S.lit(chr(10) + chr(10) + 'QUESTION: ')} || a.question || {S.lit(chr(10) + chr(10) + 'ANSWER:')})
         AS prompt_md5
FROM asked a LEFT JOIN src USING (query_id) LEFT JOIN hist USING (query_id) LEFT JOIN ctx USING (query_id)""")
def q_rag_batch(spark, sf):
    """questions -> retrieve -> context -> history -> prompt -> answer ->
    citations; one row per question, its sources as ``number url`` lines.  A
    session's later questions see the answers to its earlier ones."""
    answers, _ = _asked_again(spark, sf)
    lines = F.transform("sources", lambda s: F.concat_ws(" ", s["source_no"].cast("string"), s["url"]))
    return (answers.withColumn("sources", F.array_join(lines, "\n"))
            .withColumn("prompt_md5", F.md5(F.col("prompt").cast("binary"))).drop("prompt"))


@register("rag_turns", sql=_TURNS_SQL + f"""
SELECT conv_id::VARCHAR AS session_id, seq, role, content FROM said
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) <= {HISTORY_MESSAGES}""")
def q_rag_turns(spark, sf):
    """The session store after the batch: the last messages with the turns appended."""
    return _asked_again(spark, sf)[1].select("session_id", "seq", "role", "content")


def _asked_again(spark, sf):
    q = user_questions(spark, sf)
    questions = q.select("query_id", F.col("conv_id").cast("string").alias("session_id"),
                         "question", F.col("turn").alias("turn_order"))
    store = load(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role",
        F.col("text").alias("content"))
    return G.rag_batch(questions, article_index(spark, sf), extractive_answer, messages=store, k=K)
