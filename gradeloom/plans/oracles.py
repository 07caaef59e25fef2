"""SQL that gives the same rows as each query, for checking against another engine.

Written from the meaning of the operators, not from their Spark plans: windows instead of bit masks,
per-row patterns instead of constant ones, recursion or bit arithmetic instead of Python.
"""

from gradeloom import fixed

_RUNS = ("strict", "broad", "status")


def _text(value: str) -> str:
    """A SQL string literal, with line breaks and other invisible characters spelled as codes."""
    parts, plain = [], ""
    for char in value:
        if char.isprintable() and char != "'":
            plain += char
        else:
            if plain:
                parts.append(f"'{plain}'")
            plain = ""
            parts.append(f"chr({ord(char)})")
    if plain or not parts:
        parts.append(f"'{plain}'")
    return "(" + " || ".join(parts) + ")"


_SHEET = """
lines AS (
  SELECT l_orderkey AS okey, l_linenumber AS line, max(l_partkey) AS pk,
    bool_or(l_returnflag = 'R') AS gold,
    bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS strict,
    bool_or(l_returnflag <> 'N') AS broad,
    bool_or(l_linestatus = 'F') AS status
  FROM lineitem GROUP BY 1, 2),
lettered AS (
  SELECT *, chr((96 + row_number() OVER (PARTITION BY okey ORDER BY line))::INTEGER) AS k FROM lines),
sheet AS (
  SELECT okey, sha256(okey::VARCHAR) AS id, count(*) AS n_options,
    coalesce(list(k ORDER BY k) FILTER (gold), ['a']) AS gold,
    coalesce(list(k ORDER BY k) FILTER (strict), ['a']) AS strict,
    coalesce(list(k ORDER BY k) FILTER (broad), ['a']) AS broad,
    coalesce(list(k ORDER BY k) FILTER (status), ['a']) AS status
  FROM lettered GROUP BY okey)"""

_PREDICTIONS = (
    _SHEET
    + ",\npred AS ("
    + " UNION ALL ".join(
        f"SELECT '{r}' AS run, okey, id, n_options, gold, {r} AS labels FROM sheet" for r in _RUNS
    )
    + ")"
)

_REPEATED = (
    _PREDICTIONS
    + """,
scored AS (
  SELECT * FROM pred UNION ALL
  SELECT 'strict+status', okey, id, n_options, gold, list_concat(strict, status) FROM sheet)"""
)

_MCQ = (
    _SHEET
    + """,
options AS (
  SELECT okey, list({'k': k, 'v': p_name} ORDER BY k) AS opts,
    list({'k': k, 'v': CASE WHEN status THEN p_name ELSE lower(p_type) || ' ' || p_name END} ORDER BY k) AS recalled
  FROM lettered JOIN part ON p_partkey = pk GROUP BY okey),
mcq AS (
  SELECT s.okey, s.id, 'Order ' || o_orderkey || ' ' || o_orderpriority || '?' AS question, opts, recalled,
    s.gold AS correct, s.n_options, o_orderpriority, o_orderstatus
  FROM sheet s JOIN options USING (okey) JOIN orders ON o_orderkey = s.okey)"""
)

_GENERATIONS = (
    _PREDICTIONS
    + """,
gen AS (
  SELECT run, id, n_options, p.gold AS gold, CASE
    WHEN o_orderpriority = '1-URGENT' THEN marked
    WHEN o_orderpriority = '2-HIGH' THEN substr(marked, 2)
    WHEN o_orderpriority = '3-MEDIUM' THEN 'Les réponses sont ' || array_to_string(labels, ', ') || '.'
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN upper(marked)
    WHEN o_orderstatus = 'F' THEN ''
    WHEN o_orderstatus = 'O' THEN 'Ceci est une question de QCM (e)' || chr(10) || marked
    ELSE ' ' || marked || chr(10) || ' ' || chr(9) || chr(10) || '(a) (b)' END AS generated
  FROM (SELECT *, array_to_string(list_transform(labels, lambda x: '(' || x || ')'), ' ') AS marked FROM pred) p
  JOIN orders ON o_orderkey = okey)"""
)

_TURNS = """
turns AS (
  SELECT a.conv_id, a.turn, a.role, a.text AS prompt, b.text AS reply
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


_LAST = "CASE WHEN substr(id, 1, 1) >= '8' THEN strict WHEN substr(id, 1, 1) >= '4' THEN status ELSE broad END"


def _options(entries: str, keys: str | None = None) -> str:
    kept = f"list_filter({entries}, lambda o: contains('{keys}', o.k))" if keys else entries
    return f"array_to_string(list_transform({kept}, lambda o: '(' || o.k || ') ' || o.v || '.'), chr(10))"


_BARE = f"question || chr(10) || {_options('opts')}"
_CUE = _text(fixed.ANSWER_CUE)
_OPEN = f"{_BARE} || {_CUE}"
_MARKED_GOLD = "array_to_string(list_transform(correct, lambda a: '(' || a || ')'), ' ')"
_GOLD = f"{_BARE} || {_CUE} || ' ' || {_MARKED_GOLD}"
_GOLD_FULL = (
    f"{_BARE} || {_CUE} || ' ' || array_to_string(list_transform(list_filter(opts, "
    "lambda o: list_contains(correct, o.k)), lambda o: '(' || o.k || ') ' || o.v), '; ') || '.' || chr(10)"
)


def _templated(body: str, template_id: str = "0") -> str:
    return f"replace({_text(fixed.TEMPLATES[template_id])}, '%s', {body})"


def _clean(text: str) -> str:
    cut = f"regexp_replace({text}, '{fixed.ECHOED_INSTRUCTION}', '', 'g')"
    return f"lower(trim({cut}, {_text(fixed.WHITE_SPACE)}))"


def _marked(cleaned: str, size: str) -> str:
    last = f"chr(96 + ({size})::INTEGER)"
    pattern = f"'^[a-' || {last} || ']\\)|\\([a-' || {last} || ']\\)'"
    return f"list_transform(regexp_extract_all({cleaned}, {pattern}), lambda m: trim(m, '()'))"


def _alone(cleaned: str, size: str) -> str:
    return (
        f"list_filter(string_split_regex({cleaned}, '[^\\p{{L}}\\p{{N}}_]+'), "
        f"lambda w: length(w) = 1 AND w >= 'a' AND w <= chr(96 + ({size})::INTEGER))"
    )


_PARAGRAPH = "string_split_regex({}, '\\n[ \\t]*\\n')[1]"


def _extract(source: str, keys: str, cleaned: str, size: str) -> str:
    """CTEs that end in ``extracted`` with ``labels`` and ``defaulted`` for one cleaned text."""
    return f"""
found AS (
  SELECT {keys}, {_marked('t', size)} AS marked, {_alone('t', size)} AS alone
  FROM (SELECT *, {cleaned} AS t FROM {source})),
extracted AS (
  SELECT {keys}, len(found) = 0 AS defaulted,
    CASE WHEN len(found) = 0 THEN ['a'] ELSE list_sort(list_distinct(found)) END AS labels
  FROM (SELECT {keys}, CASE WHEN len(marked) > 0 THEN marked ELSE alone END AS found FROM found))"""


def _joined(labels: str) -> str:
    return f"array_to_string({labels}, '|')"


def _overlap(a: str, b: str) -> str:
    return (
        f"(len(list_filter({a}, lambda x: list_contains({b}, x)))::DOUBLE "
        f"/ len(list_distinct(list_concat({a}, {b}))))"
    )


def _same_set(a: str, b: str) -> str:
    return f"(list_sort(list_distinct({a})) = list_sort(list_distinct({b})))"


def _same_list(a: str, b: str) -> str:
    return f"(list_sort({a}) = list_sort({b}))"


def _share(condition: str) -> str:
    return f"round(avg(CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6)"


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{select.strip()}"


_STUB = (
    "array_to_string(list_transform(list_filter(range(5), lambda i: substr(md5({0}), i::INTEGER + 1, 1) >= '8'), "
    "lambda i: '(' || chr(97 + i::INTEGER) || ')'), ' ')"
)

_SHOWN = f"SELECT id, question, {_options('opts')} AS options, {_joined('correct')} AS gold FROM mcq"

_LINES = (
    _PREDICTIONS
    + f""",
stored AS (
  SELECT run, CASE
    WHEN run = 'strict' THEN id || ';' || answer
    WHEN run = 'broad' THEN ' ' || id || '; ' || answer || ' '
    WHEN len(labels) = n_options THEN id
    WHEN answer = 'a' THEN ''
    ELSE id || ';' || answer || ';' || n_options END AS line
  FROM (SELECT *, {_joined('labels')} AS answer FROM pred))"""
)

_PAIRS = """
compared AS (
  SELECT id, unnest([
    {'run_a': 'broad', 'run_b': 'strict', 'same': broad = strict},
    {'run_a': 'broad', 'run_b': 'status', 'same': broad = status},
    {'run_a': 'status', 'run_b': 'strict', 'same': status = strict}]) AS c
  FROM sheet)"""

_REPORT = """
counted AS (
  SELECT run, len(labels)::VARCHAR AS p, len(gold)::VARCHAR AS r FROM pred
  UNION ALL SELECT 'labels', toxic::VARCHAR, quality::VARCHAR FROM labels),
classes AS (SELECT run, p AS label FROM counted UNION SELECT run, r FROM counted),
tallies AS (
  SELECT c.run, label, count(*) FILTER (p = label AND r = label) AS hits,
    count(*) FILTER (p = label) AS predicted, count(*) FILTER (r = label) AS support
  FROM classes c JOIN counted x ON x.run = c.run GROUP BY 1, 2),
report AS (
  SELECT run, label, support, coalesce(hits / nullif(predicted, 0)::DOUBLE, 0) AS precision,
    coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS recall,
    coalesce(2 * hits / nullif(predicted + support, 0)::DOUBLE, 0) AS f1
  FROM tallies)"""

_RECALL = (
    _MCQ
    + f""",
recall AS (
  SELECT id, o_orderpriority, {_options('opts')} AS saved_options,
    question || chr(10) || {_options('opts', fixed.SHOWN_KEYS)} AS shown,
    {_options('opts', fixed.HELD_OUT_KEYS)} AS reference, {_options('recalled', fixed.HELD_OUT_KEYS)} AS generated
  FROM mcq)"""
)

# Edit cost and kept characters in one number, 1000 * cost - kept, row by row over the reference.
_EDIT = (
    _RECALL
    + """,
pairs AS (SELECT DISTINCT reference AS a, generated AS b FROM recall WHERE length(reference) > 0),
numbered AS (SELECT row_number() OVER () AS pid, a, b FROM pairs),
cells(pid, i, j, v) AS (
  SELECT pid, 0, j::INTEGER, (1000 * j)::BIGINT FROM numbered, range(0, length(b) + 1) r(j)
  UNION ALL
  SELECT pid, i + 1, j, min(t - 1000 * j) OVER (PARTITION BY pid ORDER BY j) + 1000 * j
  FROM (
    SELECT pid, i, j, least(v + 1000, lag(v) OVER (PARTITION BY pid ORDER BY j)
      + CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN -1 ELSE 1000 END) AS t
    FROM cells JOIN numbered USING (pid) WHERE i < length(a))),
edits AS (
  SELECT a, b, 1 - round_even((1000 * ceil(v / 1000) - v) / length(a) * 100, 0) / 100 AS distance
  FROM cells JOIN numbered USING (pid) WHERE i = length(a) AND j = length(b)),
measured AS (
  SELECT recall.*, distance FROM recall LEFT JOIN edits ON reference = a AND generated = b)"""
)

# Common subsequence by bit arithmetic on wide integers: one mask per character of the generated text.
_RATIO = """
CASE WHEN length(reference) + length(generated) = 0 THEN 0.0::DOUBLE ELSE
  1 - 2.0 * (length(reference) - bit_count(list_reduce(
    list_transform(string_split(generated, ''), lambda c: list_sum(list_transform(range(length(reference)),
      lambda i: CASE WHEN substr(reference, i::INTEGER + 1, 1) = c THEN 1::HUGEINT << i::INTEGER ELSE 0::HUGEINT END))::HUGEINT),
    lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::HUGEINT << length(reference)::INTEGER) - 1),
    (1::HUGEINT << length(reference)::INTEGER) - 1))) / (length(reference) + length(generated)) END"""

_PROFILES = "(VALUES " + ", ".join(
    "({}, '{}', '{}', '{}', {}, {}, {})".format(
        place, name, wrapper, mode, str(paren).lower(), str(stop).lower(), "NULL" if size is None else size
    )
    for place, (name, wrapper, mode, paren, stop, size, _) in enumerate(fixed.RUNNER_PROFILES, 1)
) + ") profiles(place, profile, wrapper, mode, paren, stop, assumed)"

def _profiled() -> str:
    head = "' (a)' || chr(10) || '(b) [/INST] (c)' || chr(10) || chr(10) || '(d) # (e)' || chr(10)"
    tail = f"'<|assistant|>' || chr(10) || {_MARKED_GOLD} || chr(10) || 'fin'"
    before, after = fixed.PROMPTER_WRAP
    ctes = (
        _MCQ
        + f""",
prompted AS (
  SELECT id, correct, n_options, profile, wrapper, mode, stop, assumed,
    {_templated(f"({_OPEN} || CASE WHEN paren THEN ' (' ELSE '' END)")} AS prompt
  FROM mcq JOIN {_PROFILES}
    ON place = (substr(o_orderpriority, 1, 1)::INTEGER - 1) * 3 + instr('FOP', o_orderstatus)),
written AS (SELECT *, {head} || {tail} AS reply, {_MARKED_GOLD} AS marked_gold FROM prompted),
cut AS (
  SELECT id, profile, coalesce(assumed, n_options) AS size, stop,
    CASE wrapper WHEN 'plain' THEN prompt
      WHEN 'user' THEN CASE WHEN profile = 'api' AND substr(id, 1, 1) >= '8' THEN prompt ELSE 'user: ' || prompt END
      WHEN 'prompter' THEN '{before}' || prompt || '{after}'
      ELSE 'system: {fixed.SYSTEM_TEXT}' || chr(10) || 'user: ' || prompt END AS sent,
    CASE mode WHEN 'none' THEN prompt || reply WHEN 'echo' THEN reply WHEN 'echo_first_line' THEN ' (a)'
      WHEN 'echo_instruction' THEN split_part(reply, '[/INST]', 2)
      WHEN 'echo_comment' THEN split_part(reply, '#', 1) ELSE marked_gold END AS answer_text
  FROM written),"""
        + _extract(
            "cut",
            "id, profile, sent, answer_text",
            f"CASE WHEN stop THEN {_PARAGRAPH.format(_clean('answer_text'))} ELSE {_clean('answer_text')} END",
            "size",
        )
    )
    return _with(ctes, f"SELECT id, profile, sent, answer_text, {_joined('labels')} AS labels FROM extracted")


_ROUTED = """
named AS (
  SELECT c_custkey, c_name, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'openai/gpt-4'
    WHEN 'BUILDING' THEN 'openai/text-davinci-003' WHEN 'FURNITURE' THEN 'cohere/command-xlarge-beta'
    WHEN 'HOUSEHOLD' THEN 'ai21/' || c_name || '/large' ELSE 'local/' || c_name END AS model
  FROM customer),
parts AS (SELECT *, split_part(model, '/', 1) AS provider, substr(model, instr(model, '/') + 1) AS name FROM named),
routed AS (
  SELECT *, CASE WHEN provider = 'openai' AND name = 'gpt-4' THEN 'chat'
    WHEN provider IN ('openai', 'cohere', 'ai21') THEN 'completion' END AS kind
  FROM parts)"""

_TOKENS = "list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: length(w) > 0)"

_SCORES = (
    f"count(*) AS n, {_share(_same_set('labels', 'gold'))} AS exact_match, "
    f"round(avg({_overlap('gold', 'labels')}), 6) AS hamming_score"
)
_PER_OPTION = f"round(sum({_overlap('labels', 'gold')}) / sum(n_options), 6) AS hamming_per_option"

ORACLES = {
    "scan_mcq": _with(_MCQ, _SHOWN),
    "scan_mcq_array": _with(_MCQ, _SHOWN),
    "scan_predictions": _with(
        _LINES,
        "SELECT run, split_part(line, ';', 1) AS id, CASE WHEN contains(line, ';') THEN split_part(line, ';', 2) END "
        "AS answer FROM stored WHERE length(line) > 0",
    ),
    "scan_predictions_strict": _with(
        _LINES + ",\ntrimmed AS (SELECT run, line, string_split(trim(line), ';') AS f FROM stored)",
        "SELECT run, CASE WHEN len(f) = 2 THEN f[1] END AS id, CASE WHEN len(f) = 2 THEN f[2] END AS answer, "
        "CASE WHEN len(f) <> 2 THEN line END AS bad_line FROM trimmed",
    ),
    "scan_runs": _with(_PREDICTIONS, f"SELECT run, id, {_joined('labels')} AS answer FROM pred"),
    "run_settings": """
SELECT n_name AS run, 'model é ' || n_name AS backbone, count(c_custkey)::VARCHAR AS epochs,
  CASE WHEN n_regionkey > 2 THEN 'true' ELSE 'false' END AS is_int8, 'Q: %s' AS prompt
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_regionkey""".strip(),
    "format_predictions": _with(
        _PREDICTIONS,
        f"SELECT run, id || ';' || {_joined('labels')} AS line, id || ';' || {_joined('labels')} AS lower_line FROM pred",
    ),
    "label_count": _with(_PREDICTIONS, "SELECT run, id, len(labels) AS n_labels, id || ';' || len(labels) AS line FROM pred"),
    "linearize_bare": _with(_MCQ, f"SELECT id, {_BARE} AS text FROM mcq"),
    "linearize_open": _with(_MCQ, f"SELECT id, {_OPEN} AS text, {_OPEN} || ' (' AS text_parenthesis FROM mcq"),
    "linearize_gold": _with(_MCQ, f"SELECT id, {_GOLD} AS text FROM mcq"),
    "linearize_gold_full": _with(_MCQ, f"SELECT id, {_GOLD_FULL} AS text FROM mcq"),
    "render_prompt": _with(
        _MCQ, f"SELECT id, {_templated(_OPEN)} AS prompt_fr, {_templated(_OPEN, 'en/0')} AS prompt_en FROM mcq"
    ),
    "render_from_table": _with(
        _MCQ,
        f"SELECT id, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus || ': ' || {_OPEN} || chr(10) || o_orderstatus END "
        "AS prompt FROM mcq",
    ),
    "few_shot_prompt": _with(
        _MCQ
        + f""",
shots AS (SELECT id, {_GOLD_FULL} AS txt FROM mcq WHERE o_orderstatus = 'P' ORDER BY id LIMIT 3),
block AS (SELECT string_agg(txt, chr(10) || chr(10) ORDER BY id) AS txt FROM shots)""",
        f"SELECT id, {_templated(f"(coalesce((SELECT txt FROM block) || chr(10) || chr(10), '') || {_OPEN} || ' (')")} "
        "AS prompt FROM mcq WHERE o_orderstatus <> 'P'",
    ),
    "few_shot_whole_pool": _with(
        _MCQ
        + f""",
shots AS (SELECT id, {_GOLD} AS txt FROM mcq ORDER BY id LIMIT 5),
block AS (SELECT string_agg(txt, chr(10) || chr(10) ORDER BY id) AS txt FROM shots)""",
        f"SELECT id, {_templated(f"(coalesce((SELECT txt FROM block) || chr(10) || chr(10), '') || {_OPEN})", 'en/0')} "
        "AS prompt FROM mcq WHERE id NOT IN (SELECT id FROM shots)",
    ),
    "chat_messages": _with(
        _MCQ + f",\nprompted AS (SELECT id, {_templated(_OPEN)} AS prompt FROM mcq)",
        f"SELECT id, 'user: ' || prompt AS user_chat, 'system: {fixed.SYSTEM_TEXT}' || chr(10) || 'user: ' || prompt "
        f"AS system_chat, '{fixed.PROMPTER_WRAP[0]}' || prompt || '{fixed.PROMPTER_WRAP[1]}' AS prompter_text FROM prompted",
    ),
    "meld_prompt": _with(
        _RECALL, f"SELECT id, {_text(fixed.MEMORIZATION_CUE)} || shown AS prompt, reference FROM recall"
    ),
    "explode_fields": _with(
        _MCQ
        + """,
cells AS (
  SELECT id, unnest(list_prepend({'path': 'question', 'text': question},
    list_transform(opts, lambda o: {'path': 'answers/' || o.k, 'text': o.v}))) AS c,
    generate_subscripts(list_prepend({'path': 'question', 'text': question},
    list_transform(opts, lambda o: {'path': 'answers/' || o.k, 'text': o.v})), 1) - 1 AS pos
  FROM mcq)""",
        "SELECT id, pos, c.path AS path, c.text AS text FROM cells",
    ),
    "gather_fields": _with(
        _MCQ,
        "SELECT id, upper(question) AS question, array_to_string(list_transform(opts, "
        "lambda o: '(' || o.k || ') ' || upper(o.v) || '.'), chr(10)) AS options, "
        f"{_joined('correct')} AS gold FROM mcq",
    ),
    "sft_text": _with(
        _MCQ, f"SELECT id, {_templated(f'({_GOLD_FULL})')} AS text, {_templated(f'({_GOLD})')} AS text_letters FROM mcq"
    ),
    "strip_echo": _with(_TURNS, "SELECT conv_id, turn, reply AS text FROM turns"),
    "after_marker": _with(
        _TURNS
        + """,
echoed AS (
  SELECT *, substr(CASE WHEN role = 'system' THEN prompt || reply
    ELSE '[INST] ' || prompt || ' [/INST] ' || reply END, length(prompt) + 1) AS x FROM turns)""",
        "SELECT conv_id, turn, CASE WHEN contains(x, '[/INST]') THEN string_split(x, '[/INST]')[2] END AS text FROM echoed",
    ),
    "chat_second_line": _with(
        _TURNS,
        "SELECT conv_id, turn, string_split(string_split(CASE WHEN role = 'system' THEN '<|assistant|>' || reply "
        "ELSE '<|user|>' || chr(10) || prompt || chr(10) || '<|assistant|>' || chr(10) || reply END, "
        "'<|assistant|>')[-1], chr(10))[2] AS text FROM turns",
    ),
    "before_marker": "SELECT doc_id, string_split(text, '#')[1] AS text FROM documents",
    "first_line": "SELECT doc_id, string_split(text, chr(10))[1] AS text FROM documents",
    "extract_first_paragraph": _with(
        _GENERATIONS, f"SELECT run, id, {_PARAGRAPH.format(_clean('generated'))} AS text FROM gen"
    ),
    "extract_parenthesized": _with(
        _GENERATIONS, f"SELECT run, id, {_joined(_marked(_clean('generated'), 'n_options'))} AS found FROM gen"
    ),
    "extract_fallback": _with(
        f"found AS (SELECT doc_id, {_alone(_clean('text'), '5')} AS found FROM documents)",
        f"SELECT doc_id, {_joined('list_sort(list_distinct(found))')} AS letters, len(found) AS n_found FROM found",
    ),
    "extract_answer": _with(
        _GENERATIONS
        + ",\n"
        + _extract("gen", "run, id, n_options, gold, generated", _clean("generated"), "n_options").strip()
        + ",\n"
        + _extract(
            "gen", "run, id, n_options", _PARAGRAPH.format(_clean("generated")), "n_options"
        )
        .strip()
        .replace("found AS (\n", "found2 AS (\n", 1)
        .replace("extracted AS", "extracted2 AS")
        .replace("FROM found)", "FROM found2)"),
        f"SELECT run, id, {_joined('a.labels')} AS labels, {_joined('b.labels')} AS stopped, b.defaulted AS defaulted "
        "FROM extracted a JOIN extracted2 b USING (run, id)",
    ),
    "extract_answer_documents": _with(
        _extract("documents", "doc_id", _clean("text"), "5"),
        f"SELECT doc_id, {_joined('labels')} AS labels, defaulted FROM extracted",
    ),
    "generate_rows": _with(
        _MCQ + f",\nprompted AS (SELECT id, {_templated(_OPEN)} AS prompt FROM mcq)",
        f"SELECT id, {_STUB.format('prompt')} AS generated FROM prompted",
    ),
    "generate_batches": _with(
        _MCQ
        + f""",
prompted AS (SELECT id, {_templated(f"({_OPEN} || ' (')")} AS prompt FROM mcq),
answered AS (SELECT id, {_STUB.format('prompt')} AS generated FROM prompted),"""
        + _extract("answered", "id", _clean("generated"), "5"),
        f"SELECT id, {_joined('labels')} AS labels, defaulted FROM extracted",
    ),
    "rewrite_fields": _with(
        _MCQ,
        "SELECT id, upper(question) AS question, array_to_string(list_transform(opts, "
        "lambda o: '(' || o.k || ') ' || upper(o.v) || '.'), chr(10)) AS options, "
        f"{_joined('correct')} AS gold FROM mcq",
    ),
    "generate_with_retry": _with(
        _MCQ
        + f""",
prompted AS (SELECT id, {_templated(_OPEN)} AS prompt FROM mcq),
failing AS (SELECT *, ('0x' || substr(md5(prompt), 1, 1))::INTEGER // 4 AS n FROM prompted)""",
        f"SELECT id, CASE WHEN n < 3 THEN {_STUB.format('prompt')} END AS generated, "
        "least(n + 1, 3)::BIGINT AS attempts, CASE WHEN n >= 3 THEN 'Throttled: try again' END AS error FROM failing",
    ),
    "generate_with_settings": _with(
        _MCQ,
        f"SELECT id, CASE WHEN o_orderpriority = '5-LOW' THEN md5({_templated(_OPEN)}) "
        f"ELSE substr(md5({_templated(_OPEN)}), 1, substr(o_orderpriority, 1, 1)::INTEGER) END AS generated FROM mcq",
    ),
    "generate_at_rate": _with(
        _MCQ,
        f"SELECT id, md5({_templated(_OPEN)}) AS generated, count(*) OVER () AS n_slots, count(*) OVER () AS n_calls FROM mcq",
    ),
    "stream_last_lines": _with(_SHEET, f"SELECT 'mine' AS run, id, {_joined(_LAST)} AS answer FROM sheet"),
    "stream_leaderboard": _with(
        _SHEET + f", pred AS (SELECT 'mine' AS run, gold, {_LAST} AS labels FROM sheet)",
        f"SELECT run, {_SCORES} FROM pred GROUP BY run",
    ),
    "pending_questions": _with(
        _SHEET,
        f"SELECT id, {_joined('gold')} AS gold FROM sheet "
        "WHERE okey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    ),
    "stream_predictions": _with(
        _MCQ
        + f""",
prompted AS (SELECT id, {_templated(f"({_OPEN} || ' (')")} AS prompt FROM mcq),
answered AS (SELECT id, {_STUB.format('prompt')} AS generated FROM prompted),"""
        + _extract("answered", "id", _clean("generated"), "5"),
        f"SELECT id, {_joined('labels')} AS answer FROM extracted",
    ),
    "route_models": _with(_ROUTED, "SELECT c_custkey, model, provider, name, kind FROM routed"),
    "generate_routed": _with(
        _ROUTED,
        f"SELECT c_custkey, kind, CASE kind WHEN 'chat' THEN {_STUB.format('c_name')} WHEN 'completion' THEN md5(c_name) "
        "END AS generated FROM routed",
    ),
    "runner_profiles": _profiled(),
    "join_predictions": _with(
        _PREDICTIONS, f"SELECT run, id, {_joined('labels')} AS labels, {_joined('gold')} AS gold FROM pred"
    ),
    "pairwise_runs": _with(_SHEET + "," + _PAIRS, "SELECT c.run_a AS run_a, c.run_b AS run_b, id, c.same AS same FROM compared"),
    "check_ids": _with(
        _SHEET
        + """,
predicted AS (
  SELECT 'lines' AS run, id FROM sheet
  UNION SELECT 'orders', sha256(o_orderkey::VARCHAR) FROM orders
  UNION SELECT 'filled', sha256(l_orderkey::VARCHAR) FROM lineitem WHERE l_linestatus = 'F'),
runs AS (SELECT DISTINCT run FROM predicted)""",
        """
SELECT *, n_predicted = n_references AND missing = 0 AS complete, missing = 0 AND unexpected = 0 AS same_ids
FROM (SELECT run, (SELECT count(*) FROM predicted p WHERE p.run = runs.run) AS n_predicted,
  (SELECT count(*) FROM sheet) AS n_references,
  (SELECT count(*) FROM sheet s WHERE NOT EXISTS (SELECT 1 FROM predicted p WHERE p.run = runs.run AND p.id = s.id)) AS missing,
  (SELECT count(*) FROM predicted p WHERE p.run = runs.run AND p.id NOT IN (SELECT id FROM sheet)) AS unexpected
  FROM runs)""",
    ),
    "dedup_last": """
SELECT run, id, answer FROM (
  SELECT l_returnflag AS run, sha256(l_orderkey::VARCHAR) AS id, chr(96 + l_linenumber) AS answer,
    row_number() OVER (PARTITION BY l_returnflag, l_orderkey
      ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS place
  FROM lineitem)
WHERE place = 1""".strip(),
    "exact_match": _with(
        _REPEATED,
        f"SELECT run, count(*) AS n, {_share(_same_set('labels', 'gold'))} AS exact_match FROM scored GROUP BY run",
    ),
    "exact_match_list": _with(
        _REPEATED,
        f"SELECT run, count(*) AS n, {_share(_same_list('labels', 'gold'))} AS exact_match FROM scored GROUP BY run",
    ),
    "hamming_row": _with(
        _REPEATED,
        f"SELECT run, id, {_same_set('labels', 'gold')} AS exact, round({_overlap('labels', 'gold')}, 6) AS overlap, "
        f"round({_overlap('gold', 'labels')}, 6) AS overlap_refs_first FROM scored",
    ),
    "scores_in_file_order": _with(
        _SHEET,
        f"SELECT row_number() OVER (ORDER BY id) - 1 AS position, id, {_same_set('strict', 'gold')} AS exact, "
        f"round({_overlap('strict', 'gold')}, 6) AS overlap FROM sheet",
    ),
    "hamming_score": _with(
        _REPEATED, f"SELECT run, round(avg({_overlap('gold', 'labels')}), 6) AS hamming_score FROM scored GROUP BY run"
    ),
    "hamming_per_option": _with(_REPEATED, f"SELECT run, {_PER_OPTION} FROM scored GROUP BY run"),
    "score_generations": _with(
        _GENERATIONS + "," + _extract("gen", "run, id, n_options, gold", _clean("generated"), "n_options"),
        f"SELECT run, {_SCORES}, {_PER_OPTION}, count(*) FILTER (defaulted) AS n_defaulted FROM extracted GROUP BY run",
    ),
    "score_answered_run": _with(
        _MCQ
        + f""",
prompted AS (SELECT 'stub' AS run, id, n_options, correct AS gold, {_templated(_OPEN)} AS prompt FROM mcq),
answered AS (SELECT run, id, n_options, gold, {_STUB.format('prompt')} AS generated FROM prompted),"""
        + _extract("answered", "run, id, n_options, gold", _clean("generated"), "n_options"),
        f"SELECT run, {_SCORES}, {_PER_OPTION}, count(*) FILTER (defaulted) AS n_defaulted FROM extracted GROUP BY run",
    ),
    "score_throttled_run": _with(
        _MCQ
        + f""",
prompted AS (SELECT 'hosted' AS run, id, n_options, correct AS gold, 'Q: ' || {_OPEN} AS prompt FROM mcq),
answered AS (SELECT run, id, n_options, gold, {_STUB.format('prompt')} AS generated FROM prompted),"""
        + _extract("answered", "run, id, n_options, gold", _clean("generated"), "n_options"),
        f"SELECT run, {_SCORES}, {_PER_OPTION}, count(*) FILTER (defaulted) AS n_defaulted FROM extracted GROUP BY run",
    ),
    "agreement": _with(
        _SHEET + "," + _PAIRS,
        "SELECT c.run_a AS run_a, c.run_b AS run_b, count(*) AS n, 0::BIGINT AS only_a, 0::BIGINT AS only_b, "
        f"{_share('c.same')} AS agreement FROM compared GROUP BY ALL",
    ),
    "agreement_many": """
WITH given AS (
  SELECT l_returnflag || l_linestatus || '/' || (l_linenumber % 3) AS run, l_partkey AS id, max(l_linenumber) AS n
  FROM lineitem GROUP BY 1, 2),
runs AS (SELECT f || '/' || i AS run FROM (VALUES ('AF'), ('NF'), ('NO'), ('RF')) a(f), range(3) b(i)),
pairs AS (SELECT a.run AS run_a, b.run AS run_b FROM runs a JOIN runs b ON a.run < b.run),
sides AS (
  SELECT run_a, run_b, id, max(run = run_a) AS in_a, max(run = run_b) AS in_b,
    max(n) FILTER (run = run_a AND n <= 6) AS a, max(n) FILTER (run = run_b AND n <= 6) AS b
  FROM pairs JOIN given ON run = run_a OR run = run_b GROUP BY ALL)
SELECT run_a, run_b, count(*) FILTER (in_a AND in_b) AS n, count(*) FILTER (in_a AND NOT in_b) AS only_a,
  count(*) FILTER (in_b AND NOT in_a) AS only_b,
  round(avg(CASE WHEN NOT (in_a AND in_b) THEN NULL WHEN a = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS agreement
FROM sides GROUP BY 1, 2""".strip(),
    "classification_report": _with(
        _PREDICTIONS + "," + _REPORT,
        "SELECT run, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support "
        "FROM report",
    ),
    "classification_report_named": _with(
        _PREDICTIONS + "," + _REPORT,
        """
SELECT runs.run AS run, named.label AS label, round(coalesce(precision, 0), 6) AS precision,
  round(coalesce(recall, 0), 6) AS recall, round(coalesce(f1, 0), 6) AS f1, coalesce(support, 0)::BIGINT AS support
FROM (SELECT DISTINCT run FROM counted) runs CROSS JOIN (VALUES ('1'), ('2'), ('3'), ('4'), ('5')) named(label)
LEFT JOIN report ON report.run = runs.run AND report.label = named.label""",
    ),
    "report_averages": _with(
        _PREDICTIONS + "," + _REPORT,
        """
SELECT run, 'macro avg' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
  round(avg(f1), 6) AS f1, sum(support)::BIGINT AS support
FROM report GROUP BY run
UNION ALL
SELECT run, 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT
FROM report GROUP BY run""",
    ),
    "accuracy_macro_f1": _with(
        _PREDICTIONS + "," + _REPORT,
        """
SELECT run, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(accuracy * 100, 6) AS accuracy_pct,
  round(macro_f1 * 100, 6) AS macro_f1_pct
FROM (SELECT run, avg(CASE WHEN p = r THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM counted GROUP BY run)
JOIN (SELECT run, avg(f1) AS macro_f1 FROM report GROUP BY run) USING (run)""",
    ),
    "label_histogram": _with(
        _PREDICTIONS, "SELECT run, len(labels) AS n_labels, count(*) AS n FROM pred GROUP BY ALL"
    ),
    "leaderboard": _with(_PREDICTIONS, f"SELECT run, {_SCORES} FROM pred GROUP BY run"),
    "meld_distance_edit": _with(
        _EDIT, "SELECT id, reference, generated, round(distance, 6) AS distance FROM measured", recursive=True
    ),
    "meld_distance_ratio": _with(
        _RECALL, f"SELECT id, reference, generated, round({_RATIO}, 6) AS distance FROM recall"
    ),
    "meld_summary": _with(
        _EDIT,
        "SELECT o_orderpriority, count(distance) AS n, round(avg(CASE WHEN distance <= 0.05 THEN 1.0::DOUBLE "
        "WHEN distance > 0.05 THEN 0.0::DOUBLE END), 6) AS meld_rate, round(avg(distance), 6) AS avg_distance "
        "FROM measured GROUP BY 1",
        recursive=True,
    ),
    "meld_rate": _with(
        _EDIT,
        "SELECT o_orderpriority, count(distance) AS n, round(avg(CASE WHEN distance <= 0.05 THEN 1.0::DOUBLE "
        "WHEN distance > 0.05 THEN 0.0::DOUBLE END), 6) AS meld_rate FROM measured GROUP BY 1",
        recursive=True,
    ),
    "meld_results": _with(
        _EDIT,
        "SELECT id, saved_options, shown AS prompt, reference, generated, round(distance, 6) AS distance FROM measured",
        recursive=True,
    ),
    "meld_recompute": _with(_RECALL, f"SELECT id, round({_RATIO}, 6) AS distance FROM recall"),
    "shuffle_rows": """
WITH copies AS (SELECT text, row_number() OVER (PARTITION BY text) - 1 AS c FROM documents)
SELECT text, row_number() OVER (ORDER BY md5(text || ':42:' || c), text) AS position FROM copies""".strip(),
    "shuffle_by_key": """
SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) AS position FROM documents""".strip(),
    "with_splits": """
SELECT o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'validation' ELSE 'test' END
  AS split
FROM orders""".strip(),
    "truncate_tokens": _with(
        f"cut AS (SELECT doc_id, {_TOKENS} AS w FROM documents)",
        "SELECT doc_id, array_to_string(list_concat(w[1:256], list_transform(range(greatest(256 - len(w), 0)), "
        "lambda i: '<pad>')), ' ') AS tokens, least(len(w), 256) AS n_tokens, len(w) > 256 AS truncated FROM cut",
    ),
    "completion_span": _with(
        _MCQ + f",\nsft AS (SELECT id, {_templated(f'({_GOLD_FULL})')} AS text FROM mcq)",
        f"SELECT id, substr(text, 1, strpos(text, '{fixed.COMPLETION_MARKER}') + {len(fixed.COMPLETION_MARKER) - 1}) "
        f"AS prompt_part, string_split(text, '{fixed.COMPLETION_MARKER}')[2] AS completion_part, "
        f"strpos(text, '{fixed.COMPLETION_MARKER}') + {len(fixed.COMPLETION_MARKER) - 1} AS completion_start FROM sft",
    ),
    "length_grouped": f"""
WITH sized AS (SELECT doc_id, len({_TOKENS}) AS length FROM documents),
size AS (SELECT 24 * greatest(1, least(50, count(*) // 96)) AS n FROM sized),
shuffled AS (SELECT *, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) - 1 AS pos FROM sized),
sorted AS (
  SELECT doc_id, length, n, pos // n * n + row_number() OVER (PARTITION BY pos // n ORDER BY length DESC, pos) - 1 AS place
  FROM shuffled, size),
head AS (SELECT place AS h FROM sorted WHERE place % n = 0 ORDER BY length DESC, place LIMIT 1),
swapped AS (SELECT doc_id, CASE place WHEN 0 THEN h WHEN h THEN 0 ELSE place END AS place FROM sorted, head)
SELECT doc_id, place::BIGINT AS place, (place // 24)::BIGINT AS batch FROM swapped""".strip(),
    "length_batches": f"""
WITH sized AS (SELECT doc_id, len({_TOKENS}) // 16 AS length_bucket FROM documents)
SELECT doc_id, length_bucket,
  (row_number() OVER (PARTITION BY length_bucket ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) // 24 AS batch
FROM sized""".strip(),
}
