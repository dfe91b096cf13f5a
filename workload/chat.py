"""Conversations, research and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasloom.functions.prompts import is_token_limit_error
from atlasloom.operators import chat as c, filters
from atlasloom.operators.chat import response_stages
from atlasloom.plans.chat import assemble_requests, classify_responses, render_rows

from . import query
from .corpus import CHUNKS
from .inputs import load, with_inputs
from .retrieval import CONTEXT, stored_chunks, text_hits

STRICT = """turns AS (
  SELECT u.conv_id, u.turn AS turn_no, u.content AS user_text, a.content AS assistant_text
  FROM messages u JOIN messages a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.turn % 2 = 0 AND u.role = 'user' AND a.role = 'assistant'),
tagged AS (SELECT conv_id, turn_no, '<turn>' || chr(10) || '<user>' || user_text || '</user>' || chr(10) || '<assistant>' || assistant_text
  || '</assistant>' || chr(10) || '</turn>' || chr(10) AS text FROM turns),
histories AS (SELECT conv_id, string_agg(text, '' ORDER BY turn_no) AS history FROM tagged GROUP BY conv_id)"""

TAGLESS = "regexp_replace(replace({0}, '[DEEP RESEARCH]', ''), '^\\s+|\\s+$', '', 'g')"
STATE = f"""folded AS (
  SELECT conv_id, bool_or(contains(content, '[DEEP RESEARCH]')) AS is_research, count(*) FILTER (WHERE role = 'assistant') + 1 AS n,
    arg_max(role, turn) AS last_role, arg_max(content, turn) AS raw,
    {TAGLESS.format("arg_min(content, turn) FILTER (WHERE role = 'user' AND NOT contains(lower(content), 'continue'))")} AS topic
  FROM messages GROUP BY conv_id),
cleaned AS (SELECT *, CASE WHEN contains(raw, '[DEEP RESEARCH]') THEN {TAGLESS.format('raw')} ELSE raw END AS last,
  CASE WHEN is_research THEN n ELSE 1 END AS i FROM folded),
state AS (SELECT conv_id, last_role, is_research, CAST(i AS INTEGER) AS iteration,
    CASE WHEN NOT is_research THEN 'answer' WHEN i = 1 THEN 'first' WHEN i >= 5 THEN 'final' ELSE 'intermediate' END AS phase,
    CASE WHEN is_research AND contains(lower(last), 'continue') AND contains(lower(last), 'research') AND topic <> '' THEN topic END AS original_topic,
    last, raw FROM cleaned)"""


@query(with_inputs("messages", also=STRICT) + "SELECT * FROM turns")
def pair_turns_strict(spark, sf):
    """E2"""
    return c.pair_turns(load(spark, sf, "messages"))


@query(
    with_inputs("messages")
    + """SELECT conv_id, turn AS turn_no, content AS user_text, next_content AS assistant_text FROM (
      SELECT *, lead(role) OVER w AS next_role, lead(content) OVER w AS next_content FROM messages
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'"""
)
def pair_turns_adjacent(spark, sf):
    """E2"""
    return c.pair_turns(load(spark, sf, "messages"), "adjacent")


@query(with_inputs("messages", also=STRICT) + "SELECT * FROM histories")
def history_text(spark, sf):
    """D4"""
    return c.fold_history(c.pair_turns(load(spark, sf, "messages")))


@query(
    with_inputs("messages", also=STATE)
    + "SELECT conv_id, last_role, is_research, iteration, phase, original_topic, coalesce(original_topic, last) AS query FROM state"
)
def research_state(spark, sf):
    """D5, D6, E10"""
    return c.conversation_state(load(spark, sf, "messages")).drop("too_large")


@query(with_inputs("messages", also=STATE) + "SELECT conv_id, iteration, phase FROM state")
def research_phase(spark, sf):
    """D5"""
    return c.research_phase(load(spark, sf, "messages"))


@query(with_inputs("messages", also=STATE) + "SELECT conv_id, is_research, last AS last_content FROM state")
def research_flag(spark, sf):
    """D6"""
    return c.detect_research(load(spark, sf, "messages"))


@query(with_inputs("messages", also=STATE) + "SELECT conv_id, original_topic, coalesce(original_topic, last) AS query FROM state")
def original_topic(spark, sf):
    """E10"""
    return c.original_topic(load(spark, sf, "messages"))


@query(
    with_inputs("messages")
    + """SELECT conv_id, last_role, last_content, CASE WHEN last_role <> 'user' THEN 'Error: Last message must be from the user' END AS error,
      length(last_content) // 4 > 8000 AS too_large
    FROM (SELECT conv_id, arg_max(role, turn) AS last_role, arg_max(repeat(content, CAST(conv_id % 400 AS BIGINT) + 1), turn) AS last_content
      FROM messages GROUP BY conv_id)"""
)
def request_validation(spark, sf):
    """Texts are repeated so that some are too large"""
    rows = load(spark, sf, "messages").withColumn(
        "content", F.repeat("content", (F.col("conv_id") % 400 + 1).cast("int"))
    )
    return filters.validate_requests(rows)


ANSWER = """a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS iteration FROM answers WHERE role = 'assistant'),
staged AS (SELECT *, CASE WHEN iteration = 1 AND contains(content, '## Research Plan') THEN 'plan'
    WHEN iteration BETWEEN 1 AND 4 AND contains(content, '## Research Update ' || iteration) THEN 'update'
    WHEN contains(content, '## Final Conclusion') THEN 'conclusion' END AS type,
  contains(content, '## Final Conclusion')
    OR (contains(content, '## Conclusion') OR contains(content, '## Summary')) AND NOT contains(content, 'I will now proceed to')
      AND NOT contains(content, 'Next Steps') AND NOT contains(content, 'next iteration')
    OR contains(content, 'This concludes our research') OR contains(content, 'In conclusion,')
    OR contains(content, 'Final') AND contains(content, 'Conclusion') AS complete FROM a)"""


@query(
    with_inputs("answers", also=ANSWER)
    + """SELECT conv_id, CAST(iteration AS INTEGER) AS iteration, type, CASE type WHEN 'plan' THEN 'Research Plan'
        WHEN 'update' THEN 'Research Update ' || iteration ELSE 'Final Conclusion' END AS title, content, turn AS seq
    FROM staged WHERE type IS NOT NULL"""
)
def research_stages(spark, sf):
    """H18, E7, J9"""
    return classify_responses(load(spark, sf, "answers"))[0]


@query(
    with_inputs("answers", also=ANSWER)
    + """SELECT conv_id, CAST(iteration AS INTEGER) AS iteration, type, CASE WHEN turn % 4 = 1 THEN content ELSE content || ' (revised)' END AS content, 2 * turn AS seq
    FROM staged WHERE type IS NOT NULL"""
)
def research_stage_updates(spark, sf):
    """A stage comes in while its text grows, then whole, then at times once more; the newest stays where the first was seen"""
    stages = response_stages(load(spark, sf, "answers")).filter("stage IS NOT NULL").select("conv_id", "seq", "stage.*")
    text = F.col("content")
    growing = stages.withColumn("content", F.substring(text, F.lit(1), (F.length(text) / 2).cast("int"))).withColumn("seq", 2 * F.col("seq"))
    whole = stages.withColumn("seq", 2 * F.col("seq") + 1)
    again = stages.filter("seq % 4 <> 1").withColumn("content", F.concat(text, F.lit(" (revised)"))).withColumn("seq", 2 * F.col("seq") + 2000)
    events = growing.unionByName(again).unionByName(whole).repartition(4)
    return c.upsert_stages(events).select("conv_id", "iteration", "type", "content", "seq")


@query(
    with_inputs("answers", also=ANSWER)
    + """SELECT conv_id, CAST(max(iteration) AS INTEGER) AS iterations, arg_max(complete OR iteration >= 5, iteration) AS complete,
      arg_max(iteration >= 5 AND NOT complete, iteration) AS forced FROM staged GROUP BY conv_id"""
)
def research_completion(spark, sf):
    """H17, H19, J9"""
    return classify_responses(load(spark, sf, "answers"))[1]


@query(
    with_inputs("requests", "files")
    + """SELECT r.conv_id, r.repo_id, r.file_path, coalesce('Contexts related to ' || r.file_path, 'q') AS rag_query, f.text AS file_content
    FROM requests r LEFT JOIN files f ON r.repo_id = f.repo_id AND r.file_path = f.file_path"""
)
def file_focus(spark, sf):
    """C10"""
    rows = load(spark, sf, "requests").withColumn("query", F.lit("q"))
    return c.focus_file(rows, load(spark, sf, "files")).select("conv_id", "repo_id", "file_path", "rag_query", "file_content")


@query(
    with_inputs("messages", also=STRICT + ",\n" + STATE)
    + """SELECT conv_id, '/no_think sys' || chr(10) || chr(10)
      || CASE WHEN history IS NOT NULL THEN '<conversation_history>' || chr(10) || history || '</conversation_history>' || chr(10) || chr(10) ELSE '' END
      || '<note>Answering without retrieval augmentation due to input size constraints.</note>' || chr(10) || chr(10)
      || '<query>' || chr(10) || coalesce(original_topic, last) || chr(10) || '</query>' || chr(10) || chr(10) || 'Assistant: '
      || CASE WHEN conv_id % 2 = 0 THEN ' /no_think' ELSE '' END AS prompt
    FROM state LEFT JOIN histories USING (conv_id)"""
)
def fallback_prompts(spark, sf):
    """For requests whose first attempt met a token limit"""
    messages = load(spark, sf, "messages")
    rows = c.conversation_state(messages).select("conv_id", "query").join(c.fold_history(c.pair_turns(messages)), "conv_id", "left")
    none = F.lit(None).cast("string")
    rows = rows.withColumns({
        "system": F.lit("sys"), "file_path": none, "file_content": none, "error": F.lit("hit the token limit"),
        "provider": F.when(F.col("conv_id") % 2 == 0, "ollama").otherwise("openai"),
    })
    return render_rows(rows.filter(is_token_limit_error(F.col("error"))), fallback=True).select("conv_id", "prompt")


CONTEXT_PART = """      || CASE WHEN context IS NOT NULL THEN '<START_OF_CONTEXT>' || chr(10) || context || chr(10) || '<END_OF_CONTEXT>' || chr(10) || chr(10)
        ELSE '<note>Answering without retrieval augmentation.</note>' || chr(10) || chr(10) END
"""
SMALLER_PART = """      || '<note>Answering without retrieval augmentation due to input size constraints.</note>' || chr(10) || chr(10)
"""
PROMPT = """SELECT conv_id, '/no_think Repository github ' || repo_url || ' (' || r.repo_id || '); language '
      || CASE language WHEN 'fr' THEN 'Français (French)' ELSE 'English' END || '; phase ' || phase || ', iteration ' || iteration || '.'
      || chr(10) || chr(10)
      || CASE WHEN history IS NOT NULL THEN '<conversation_history>' || chr(10) || history || '</conversation_history>' || chr(10) || chr(10) ELSE '' END
      || CASE WHEN coalesce(file_content, '') <> '' THEN '<currentFileContent path="' || file_path || '">' || chr(10) || file_content || chr(10)
        || '</currentFileContent>' || chr(10) || chr(10) ELSE '' END
{context}      || '<query>' || chr(10) || query || chr(10) || '</query>' || chr(10) || chr(10) || 'Assistant: '
      || CASE WHEN provider = 'ollama' THEN ' /no_think' ELSE '' END AS prompt
    FROM ready r LEFT JOIN histories h USING (conv_id) LEFT JOIN contexts x ON x.query_id = CAST(conv_id AS STRING)""".replace("{context}", CONTEXT_PART)
WINDOW = 48_000


def small_window(prompts):
    """A model whose window is `WINDOW` characters: longer prompts come back with its error."""
    error = F.when(F.length("prompt") > WINDOW, F.lit("400: this model's maximum context length is exceeded"))
    return prompts.select("conv_id", error.alias("error"))


@query(
    with_inputs(
        "long_messages", "requests", "files",
        also=CHUNKS + ",\n" + (STRICT + ",\n" + STATE).replace("messages", "long_messages") + """,
ready AS (SELECT r.*, s.phase, s.iteration, coalesce(s.original_topic, s.last) AS query, s.raw, f.text AS file_content
  FROM requests r JOIN state s USING (conv_id) LEFT JOIN files f ON r.repo_id = f.repo_id AND r.file_path = f.file_path
  WHERE s.last_role = 'user'),
asked AS (SELECT repo_id, CAST(conv_id AS STRING) AS query_id, coalesce('Contexts related to ' || file_path, query) AS text FROM ready
  WHERE length(raw) // 4 <= 8000),
"""
        + text_hits("asked") + ",\n" + CONTEXT + f""",
tried AS ({PROMPT}),
smaller AS ({PROMPT.replace(CONTEXT_PART, SMALLER_PART)})""",
    )
    + f"""SELECT t.conv_id, CASE WHEN length(t.prompt) > {WINDOW} THEN s.prompt ELSE t.prompt END AS prompt, length(t.prompt) > {WINDOW} AS retried
    FROM tried t JOIN smaller s USING (conv_id)"""
)
def assembled_prompts(spark, sf):
    """B8 to B10, C10, D3 to D6, E2, E10, J3; prompts beyond the model's window are tried again without context"""
    files = load(spark, sf, "files").select("repo_id", "doc_ord", "file_path", "text")
    return assemble_requests(load(spark, sf, "requests"), load(spark, sf, "long_messages"), stored_chunks(spark, sf), files, call=small_window)
