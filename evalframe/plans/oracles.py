"""DuckDB SQL for the registered queries, over the same parquet tables."""

from __future__ import annotations

from ..problems.spec import FAMILIES as FAMILIES_
from ..sources.star import FAMILIES
from . import fixtures, talks
from .queries import POOL
from .transcripts import NAMES, SHAPES

_Z = "CAST(1.96 AS DOUBLE)"
_MARKER = r"regexp_extract_all({0}, '(?im)^\s*answer\s*[:=]\s*(.+?)\s*$', 1)[-1]"
_CONF = r"'(?im)^\s*confidence\s*[:=]\s*([0-9]{1,3})'"


def _marker(text: str) -> str:
    return _MARKER.format(text)


def _confidence(text: str) -> str:
    value = f"CAST(regexp_extract_all({text}, {_CONF}, 1)[-1] AS BIGINT)"
    return f"CASE WHEN {value} > 100 THEN 100 ELSE {value} END"


def _word(choice: str, text: str) -> str:
    return rf"regexp_matches(lower({text}), '\b{choice.lower()}\b')"


def _first_choice(choices: tuple[str, ...], text: str) -> str:
    return "CASE " + " ".join(f"WHEN {_word(c, text)} THEN '{c}'" for c in choices) + " END"


def _last_choice(choices: tuple[str, ...], text: str) -> str:
    places = ", ".join(rf"CASE WHEN {_word(c, text)} THEN {{'at': length(regexp_extract(lower({text}), '(?s)^(.*)\b{c.lower()}\b', 1)), 'o': {-i}, 'c': '{c}'}} END" for i, c in enumerate(choices))
    return f"list_max(list_filter([{places}], lambda x: x IS NOT NULL)).c"


def _ints(text: str, at: int) -> str:
    found = f"regexp_extract_all(replace({text}, ',', ''), '-?[0-9]+')[{at}]"
    return f"CASE WHEN regexp_matches({found}, '^-?0+$') THEN '0' ELSE regexp_replace({found}, '^(-?)0+', '\\1') END"


def _names(text: str) -> str:
    tokens = rf"list_transform(regexp_split_to_array({text}, '[,;]|\band\b|\bor\b'), lambda t: lower(trim(regexp_replace(t, '^\s+|\s+$', '', 'g'), '''\".')))"
    kept = f"list_filter({tokens}, lambda t: t <> '')"
    return f"CASE WHEN list_has_any({kept}, ['none', 'no', 'nothing', 'n/a']) THEN [] ELSE {kept} END"


STAR = f"""
WITH items AS (
  SELECT o_orderkey AS item_id, [{", ".join(f"'{f}'" for f in FAMILIES)}][(o_orderkey // 4) % 5 + 1] AS family, (o_orderkey // 20) % 6 + 1 AS difficulty,
    CASE o_orderkey % 4 WHEN 0 THEN 'base' WHEN 1 THEN 'distractor' ELSE 'surface' END AS probe, o_orderkey // 4 AS grp,
    CASE o_orderstatus WHEN 'P' THEN 'UNDETERMINED' ELSE o_orderstatus END AS gold FROM orders),
lines AS (
  SELECT *, 'r' || CAST(l_suppkey % 2 AS VARCHAR) AS run_id, l_orderkey AS item_id, (l_linenumber - 1) % 3 AS sample_idx,
    row_number() OVER (PARTITION BY l_suppkey % 2, l_orderkey, (l_linenumber - 1) % 3
      ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC, l_linenumber DESC) AS rn
  FROM lineitem QUALIFY rn = 1),
said AS (
  SELECT *, round(l_discount * 100) = 10 AS is_err, round(l_tax * 100) AS tax, l_partkey % 4 AS shape,
    CASE WHEN round(l_discount * 100) = 10 OR round(l_tax * 100) = 0 THEN NULL WHEN l_returnflag = 'N' THEN 'UNDETERMINED' ELSE l_linestatus END AS parsed,
    CASE WHEN round(l_tax * 100) = 1 THEN NULL ELSE CAST(round(l_quantity * 2) AS BIGINT) END AS confidence FROM lines),
responses AS (
  SELECT run_id, item_id, sample_idx, parsed, confidence, CAST(floor(l_extendedprice) AS BIGINT) AS latency_ms,
    CASE WHEN is_err THEN '__ERROR__' ELSE coalesce(CASE shape WHEN 0 THEN 'ANSWER: ' || parsed WHEN 1 THEN 'so it must be ' || parsed || '.'
      WHEN 2 THEN 'It is not F.' || chr(10) || 'answer = ' || parsed || ' ' || chr(10) || 'as said' ELSE 'ANSWER: ' || parsed || chr(10) || 'Though O comes close.' END, 'no idea')
      || coalesce(chr(10) || 'CONFIDENCE: ' || CAST(confidence AS VARCHAR), '') END AS raw,
    CASE WHEN is_err THEN NULL ELSE coalesce(parsed = gold, false) END AS correct,
    CASE WHEN NOT is_err AND tax <> 2 THEN l_partkey % 500 END AS prompt_tokens, CASE WHEN NOT is_err AND tax <> 2 THEN l_suppkey % 900 + 100 END AS completion_tokens,
    CASE WHEN is_err THEN NULL WHEN parsed IS NULL THEN 'none' WHEN shape = 1 THEN 'fallback' ELSE 'marker' END AS parse_source,
    CASE WHEN NOT is_err AND tax <> 3 THEN l_linestatus = 'O' END AS intermediate_correct
  FROM said JOIN items USING (item_id)),
telemetry AS (
  SELECT run_id, item_id, sample_idx, (l_suppkey % 900 + 100) // 3 AS reasoning_tokens FROM lines WHERE l_linenumber % 2 = 1),
f AS (
  SELECT s.*, family, difficulty, probe, grp, gold, s0_correct IS NOT NULL AS answered FROM (
    SELECT run_id, item_id, count(*) AS n, CAST(max(sample_idx) + 1 AS BIGINT) AS k, count(*) FILTER (raw = '__ERROR__') AS failed, count(correct) AS graded, count(*) FILTER (correct) AS n_right,
      any_value(correct) FILTER (sample_idx = 0) AS s0_correct, any_value(parsed) FILTER (sample_idx = 0) AS s0_parsed, any_value(confidence) FILTER (sample_idx = 0) AS s0_conf,
      any_value(raw) FILTER (sample_idx = 0) AS s0_raw, any_value(intermediate_correct) FILTER (sample_idx = 0) AS s0_inter
    FROM responses GROUP BY run_id, item_id) s JOIN items USING (item_id)),
b AS (SELECT *, CAST(s0_correct AS INTEGER) AS ok FROM f WHERE probe = 'base' AND answered),
vote AS (SELECT run_id, item_id, parsed, count(*) AS c, min(sample_idx) AS first FROM responses WHERE parsed IS NOT NULL GROUP BY ALL),
votes AS (
  SELECT run_id, item_id, arg_max(parsed, {{'c': c, 'f': -first}}) AS winner, CAST(sum(c) AS BIGINT) AS n_votes, count(*) AS n_options,
    abs(log2(sum(c)) - sum(c * log2(c)) / sum(c)) AS entropy FROM vote GROUP BY run_id, item_id),
voted AS (SELECT v.*, lower(winner) = lower(gold) AS winner_right FROM votes v JOIN items USING (item_id) WHERE probe = 'base'),
runs AS (SELECT 'r' || CAST(l_suppkey % 2 AS VARCHAR) AS run_id, 'model-a' AS model, 'v' || CAST(l_suppkey % 2 + 1 AS VARCHAR) AS dataset_tag, min(l_shipdate) AS created_at FROM lineitem GROUP BY l_suppkey % 2)"""

_STEPS = f"""
WITH given AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS item_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
sized AS (SELECT item_id, len(lines) AS k, CAST(length(lines[1]) AS BIGINT) AS first, CAST(length(lines[-1]) AS BIGINT) AS n, len(list_filter(lines, lambda x: length(x) % {talks.BROKEN} = 0)) = 0 AS ok FROM given),
told AS (SELECT *, CAST(n + (n % {talks.WRONG} = 0)::INT AS VARCHAR) AS answer FROM sized)
SELECT item_id, CAST(0 AS BIGINT) AS sample_idx, CASE WHEN ok THEN 'It has ' || n || ' characters.' || chr(10) || 'ANSWER: ' || answer || chr(10) || 'CONFIDENCE: ' || n % 101 ELSE '__ERROR__' END AS raw,
  CASE WHEN ok THEN answer END AS parsed, CASE WHEN ok THEN n % {talks.WRONG} <> 0 END AS correct, CASE WHEN ok THEN least(n % 101, 100) END AS confidence, CASE WHEN ok THEN CAST(2 * k AS BIGINT) END AS prompt_tokens,
  CASE WHEN ok THEN n % 100 END AS completion_tokens, CASE WHEN ok THEN 'marker' END AS source, CASE WHEN ok AND k > 1 THEN first % {talks.WRONG} <> 0 END AS intermediate_correct,
  CASE WHEN ok AND k > 1 THEN CAST(first + (first % {talks.WRONG} = 0)::INT AS VARCHAR) END AS intermediate_parsed
FROM told"""

_FOLD = """SELECT doc_id, sha256(replace(coalesce(text, ''), chr(10), '')) AS text_sha256, n_chars AS prompt_tokens, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS completion_tokens,
          CAST(CASE WHEN doc_id % 3 = 0 THEN 7 ELSE 0 END AS BIGINT) AS thinking_tokens, 0.125::DOUBLE AS ttft, CASE WHEN doc_id % 3 = 0 THEN 0.25::DOUBLE END AS first_reasoning, 1.0::DOUBLE AS answer_wall FROM documents"""

_CHOICES = ("O", "F", "UNDETERMINED")
_STRICT = f"coalesce(lower({_first_choice(_CHOICES, 'marker')}) = lower(gold), false)"
_PAIRS = """, p AS (
  SELECT run_id, grp, max(family) FILTER (probe = 'base') AS family, any_value(s0_correct) FILTER (probe = 'base') AS base, any_value(s0_correct) FILTER (probe = 'distractor') AS other
  FROM f WHERE probe IN ('base', 'distractor') GROUP BY run_id, grp)"""
_SURFACE = """, s AS (
  SELECT b.run_id, b.grp, b.family, count(*) FILTER (v.s0_parsed IS DISTINCT FROM b.s0_parsed) > 0 AS flipped, count(*) FILTER (v.answered) AS total, count(*) FILTER (v.s0_correct) AS "right"
  FROM f b JOIN f v ON b.run_id = v.run_id AND b.grp = v.grp AND b.probe = 'base' AND v.probe = 'surface' WHERE b.s0_parsed IS NOT NULL GROUP BY b.run_id, b.grp, b.family)"""
_BINS = """, bins AS (
  SELECT run_id, least(9, s0_conf // 10) AS b, count(*) AS n, avg(s0_conf) / 100 AS mean_confidence, avg(ok) AS accuracy FROM b WHERE s0_conf IS NOT NULL GROUP BY ALL)"""
_ECE = ", ece AS (SELECT run_id, sum(n * abs(accuracy - mean_confidence)) / sum(n) AS ece, CAST(sum(n) AS BIGINT) AS n FROM bins GROUP BY run_id)"
_CHANCE = """, g AS (SELECT run_id, family, gold, count(*) AS n, sum(ok) AS k FROM b GROUP BY ALL),
rated AS (
  SELECT run_id, family, CAST(sum(n) AS BIGINT) AS n, sum(k) / sum(n) AS accuracy, CASE WHEN family IN ('arithmetic', 'dynamic_pivot') THEN 0.0::DOUBLE ELSE max(n) / sum(n) END AS chance FROM g GROUP BY run_id, family),
above AS (SELECT *, CASE WHEN chance > 0 AND chance < 1 THEN (accuracy - chance) / (1 - chance) ELSE accuracy END AS above_chance FROM rated)"""
_PASSK = """, pk AS (
  SELECT run_id, max(k) AS k, coalesce(avg(CAST(s0_correct AS INTEGER)) FILTER (probe = 'base' AND graded > 0 AND answered), 0) AS p1,
    coalesce(avg(CAST(n_right > 0 AS INTEGER)) FILTER (probe = 'base' AND graded > 0), 0) AS oracle FROM f GROUP BY run_id),
mj AS (SELECT v.run_id, avg(CAST(winner_right AS INTEGER)) AS maj FROM voted v JOIN f USING (run_id, item_id) WHERE graded > 0 GROUP BY v.run_id)"""
_WILSON = f"""
  k / n AS mean, greatest(0, (k / n + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4.0::DOUBLE * n * n))) / (1 + {_Z} * {_Z} / n)) AS lo,
  least(1, (k / n + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4.0::DOUBLE * n * n))) / (1 + {_Z} * {_Z} / n)) AS hi"""
_DEGRADATION = f""", cells AS (SELECT run_id, family, difficulty, count(*) AS n, CAST(sum(ok) AS DOUBLE) AS k, stddev_pop(ok) AS std FROM b GROUP BY ALL),
curve AS (SELECT run_id, family, difficulty, n, {_WILSON}, std FROM cells)"""
_STRICTLY = f""", m AS (SELECT *, {_marker("s0_raw")} AS marker FROM f),
sr AS (SELECT run_id, answered, s0_correct, CASE WHEN answered AND probe = 'base' THEN {_STRICT} END AS strict FROM m),
st AS (SELECT run_id, coalesce(avg(CAST(strict AS INTEGER)), 0) AS strict_accuracy, count(*) FILTER (s0_correct AND NOT strict) / nullif(count(*) FILTER (answered), 0) AS fallback_reliance FROM sr GROUP BY run_id)"""
_ILL = """, ill AS (
  SELECT run_id, count(*) FILTER (ill AND answered AND coalesce(s0_parsed, '') <> '' AND NOT sent) / nullif(count(*) FILTER (ill), 0) AS confabulation_rate,
    count(*) FILTER (NOT ill AND sent) / nullif(count(*) FILTER (NOT ill), 0) AS false_undetermined_rate, count(*) FILTER (ill) AS n_ill_posed, count(*) FILTER (NOT ill) AS n_well_posed
  FROM (SELECT *, gold IN ('UNDETERMINED', 'NO_SOLUTION') AS ill, coalesce(s0_parsed IN ('UNDETERMINED', 'NO_SOLUTION'), false) AS sent FROM f WHERE probe = 'base') GROUP BY run_id)"""
_COVER = ", cover AS (SELECT run_id, count(*) AS n_items, max(k) AS samples_per_item, count(*) FILTER (answered) AS answered, count(*) FILTER (NOT answered) AS errored, count(*) FILTER (answered) / count(*) AS coverage FROM f GROUP BY run_id)"
_OVERALL = ", overall AS (SELECT run_id, coalesce(avg(CAST(s0_correct AS INTEGER)) FILTER (probe = 'base' AND answered), 0) AS accuracy, count(*) FILTER (probe = 'base' AND answered) AS n FROM f GROUP BY run_id)"
_INV = "count(*) AS groups, count(*) FILTER (flipped) / count(*) AS answer_flip_rate, count(*) FILTER (NOT flipped) / count(*) AS consistent_rate, sum(\"right\") / nullif(sum(total), 0) AS surface_accuracy"
_OUTCOME = """, o0 AS (
  SELECT run_id, item_id, count(*) AS n, count(*) FILTER (correct) AS r, count(*) FILTER (raw = '__ERROR__') AS failed, arg_min(coalesce(parsed, '~'), sample_idx) AS p, arg_min(coalesce(parse_source, '~'), sample_idx) AS src
  FROM responses GROUP BY ALL),
o1 AS (SELECT o0.*, family, difficulty, probe, gold, CASE WHEN failed > 0 THEN 'errored' WHEN r * 2 > n THEN 'solved' ELSE 'wrong' END AS outcome FROM o0 LEFT JOIN items USING (item_id)),
o AS (
  SELECT run_id, item_id, family, difficulty, probe, gold, outcome,
    CASE outcome WHEN 'errored' THEN 'model call failed — no answer was recorded (transport/HTTP/parse error)'
      WHEN 'solved' THEN CASE WHEN src = 'fallback' THEN 'correct, but the ANSWER: marker was missing — rescued by fallback parse' WHEN n > 1 AND r < n THEN 'correct by majority (' || r || '/' || n || ' samples agreed)' ELSE 'correct' END
      ELSE CASE WHEN src = 'none' OR p = '~' THEN 'no parseable answer — the response had no ANSWER: line and no usable fallback'
        WHEN src = 'fallback' THEN 'wrong answer (got ''' || p || ''', expected ''' || gold || '''); format off — taken from fallback parse'
        WHEN n > 1 AND r > 0 THEN 'wrong by majority (got ''' || p || ''', expected ''' || gold || '''; only ' || r || '/' || n || ' correct)'
        ELSE 'wrong answer (got ''' || p || ''', expected ''' || gold || ''')' END END AS reason FROM o1)"""
_COUNTS = "count(*) FILTER (outcome = 'solved') AS solved, count(*) FILTER (outcome = 'wrong') AS wrong, count(*) FILTER (outcome = 'errored') AS errored, count(*) AS total, coalesce(count(*) FILTER (outcome = 'solved') / nullif(count(*) FILTER (outcome <> 'errored'), 0), 0) AS accuracy"
_REASON = """, rr AS (SELECT run_id, item_id, sample_idx, reasoning_tokens, correct, difficulty FROM telemetry JOIN responses USING (run_id, item_id, sample_idx) JOIN items USING (item_id))"""


def _answers() -> str:
    kinds = ", ".join(f"'{k}'" for k in SHAPES)
    shapes = ", ".join("[" + ", ".join(fixtures.sql_value(s).replace("\n", "' || chr(10) || '") for s in own) + "]" for own in SHAPES.values())
    names = fixtures.sql_value(list(NAMES))
    text = "shape"
    for mark, value in (("a", "l_partkey"), ("b", "l_suppkey"), ("c", "CAST(round(l_quantity * 3) AS INTEGER)"), ("x", "x"), ("y", "y")):
        text = f"replace({text}, '{{{mark}}}', CAST({value} AS VARCHAR))"
    return f"""
WITH a0 AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_partkey % 4 AS k, [{kinds}][l_partkey % 4 + 1] AS kind, [{shapes}][l_partkey % 4 + 1][l_suppkey % 5 + 1] AS shape,
    {names}[l_orderkey % 3 + 1] AS x, {names}[(l_orderkey + l_linenumber) % 3 + 1] AS y FROM lineitem),
a AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, kind, {text} AS text, CASE k WHEN 1 THEN x WHEN 2 THEN y || ', ' || x ELSE CAST(l_partkey AS VARCHAR) END AS gold FROM a0),
t AS (SELECT *, {_marker("text")} AS marker, regexp_replace(text, {_CONF}, '', 'g') AS prose, {_confidence('text')} AS confidence FROM a),
g AS (
  SELECT *, CASE WHEN marker IS NULL THEN NULL WHEN kind IN ('int', 'justified_choice') THEN {_ints("marker", 1)} WHEN kind = 'choice' THEN {_first_choice(NAMES, "marker")} ELSE array_to_string(list_sort({_names("marker")}), ',') END AS strict_parsed,
    CASE kind WHEN 'int' THEN {_ints("prose", -1)} WHEN 'set' THEN nullif(array_to_string(list_sort({_names("prose")}), ','), '') WHEN 'choice' THEN {_last_choice(NAMES, "text")} END AS loose FROM t),
h AS (SELECT *, coalesce(strict_parsed, loose) AS parsed, CASE WHEN strict_parsed IS NOT NULL THEN 'marker' WHEN loose IS NOT NULL THEN 'fallback' ELSE 'none' END AS source,
  CASE WHEN strict_parsed IS NOT NULL THEN 'marker' ELSE 'none' END AS strict_source FROM g)"""


def _grade() -> str:
    as_set = lambda x: f"list_sort(list_distinct({_names(x)}))"
    return f"""{_answers()}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, kind, parsed, source,
  CASE WHEN kind = 'set' THEN {as_set("coalesce(parsed, '')")} = {as_set("gold")} ELSE coalesce(lower(parsed) = lower(gold), false) END AS correct, confidence, strict_parsed, strict_source FROM h"""


def _entropy() -> str:
    return """
WITH v AS (SELECT vec_id, embedding AS e, i FROM embeddings, range(1, len(embedding) + 1) r(i)),
p AS (SELECT vec_id, i, -abs(e[i]) * 4 AS own, list_transform(e[i:i + 2], lambda x: exp(CAST(-abs(x) * 4 AS DOUBLE))) AS q FROM v),
h AS (SELECT vec_id, own, -list_sum(list_transform(q, lambda x: x / list_sum(q) * log2(x / list_sum(q)))) AS h FROM p),
s AS (SELECT vec_id, avg(h) AS m, stddev_pop(h) AS sd FROM h GROUP BY vec_id)
SELECT vec_id, round(any_value(m), 9) AS token_entropy_mean, round(max(h), 9) AS token_entropy_max, count(*) FILTER (sd > 0 AND h > m + 2 * sd) AS friction_transitions,
  count(*) FILTER (own < -2) AS logprob_divergence_spikes, count(*) AS n_tokens_scored FROM h JOIN s USING (vec_id) GROUP BY vec_id
UNION ALL SELECT vec_id, NULL, NULL, NULL, NULL, NULL FROM embeddings WHERE coalesce(len(embedding), 0) = 0"""


#: Every response with its item's dimensions.
_EXPORT = """, x AS (SELECT item_id, run_id, CAST(sample_idx AS BIGINT) AS sample_idx, raw, parsed, correct, confidence, coalesce(family, '(unknown)') AS family, difficulty, probe, gold
  FROM responses LEFT JOIN items USING (item_id))"""


def _messages() -> str:
    from ..operators import messages as m

    q = fixtures.sql_value
    how_int = q(m.FORMAT + m.CONFIDENCE)
    how_choice = q(m.FORMAT + m.OPTIONS + "yes, no." + m.CONFIDENCE)
    return f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, doc_id % 2 = 1 AS odd FROM documents),
m AS (SELECT doc_id, CASE WHEN odd AND text IS NOT NULL THEN 2 * len(lines) ELSE 2 END AS n_messages,
  'system|' || {q(m.SYSTEM)} || chr(10) || CASE WHEN odd AND text IS NOT NULL THEN 'user|' || array_to_string(lines, chr(10) || 'assistant|' || {q(m.READY)} || chr(10) || 'user|') || chr(10) || chr(10) || {how_int}
    ELSE 'user|' || concat_ws(chr(10) || chr(10), text, CASE WHEN odd THEN {how_int} ELSE {how_choice} END) END AS s FROM d)
SELECT doc_id, CAST(n_messages AS BIGINT) AS n_messages, sha256(s) AS messages_sha256 FROM m"""


def _sequential(query: str) -> str:
    """SQL of the two queries on messages of several turns."""
    from ..operators import messages as m

    q = fixtures.sql_value
    how, end = q(m.FORMAT), "chr(10)"
    d = f"WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), {end}) AS turns FROM documents)"
    if query == "by_role":
        chat = f"'user|' || array_to_string(turns, {end} || 'assistant|' || {q(m.READY)} || {end} || 'user|') || {end} || {end} || {how}"
        return f"{d} SELECT doc_id, {q(m.SYSTEM)} AS system, CAST(2 * len(turns) - 1 AS BIGINT) AS n_chat, sha256({chat}) AS chat_sha256 FROM d"
    asked = f"list_transform(turns, lambda x, i: 'user|' || x || {end} || {end} || {how} || CASE WHEN i < len(turns) THEN {end} || 'assistant|' || CAST(length(x) AS VARCHAR) ELSE '' END)"
    return f"{d} SELECT doc_id, CAST(2 * len(turns) AS BIGINT) AS n_messages, sha256('system|' || {q(m.SYSTEM)} || {end} || array_to_string({asked}, {end})) AS messages_sha256 FROM d"


def _tidy() -> str:
    def long(source: str, family: str = "NULL", difficulty: str = "NULL", **metrics: str) -> str:
        return " UNION ALL ".join(f"SELECT run_id, '{name}' AS metric, {family} AS family, {difficulty} AS difficulty, round({column}, 4) AS value FROM {source}" for name, column in metrics.items())

    pieces = [
        long("overall", overall_accuracy="accuracy"), long("st", overall_accuracy_strict="strict_accuracy", fallback_reliance="fallback_reliance"),
        long("above", "family", family_accuracy="accuracy", acc_above_chance="above_chance"), long("curve", "family", "difficulty", acc_mean="mean", acc_ci_lo="lo", acc_ci_hi="hi"),
        long("(SELECT run_id, family, avg(CAST(base AS INTEGER)) - avg(CAST(other AS INTEGER)) AS d FROM p WHERE base IS NOT NULL AND other IS NOT NULL GROUP BY ALL)", "family", distractor_drop="d"),
        long(f"(SELECT run_id, {_INV} FROM s GROUP BY ALL)", answer_flip_rate="answer_flip_rate"), long(f"(SELECT run_id, family, {_INV} FROM s GROUP BY ALL)", "family", answer_flip_rate="answer_flip_rate"),
        long("cover", coverage="CASE WHEN errored > 0 THEN coverage END"), long("ece", ece="ece"), long("pk", **{"pass@k_oracle": "CASE WHEN k > 1 THEN oracle END"}), long("ill", confabulation_rate="confabulation_rate"),
    ]
    return f"{STAR}{_OVERALL}{_STRICTLY}{_CHANCE}{_DEGRADATION}{_PAIRS}{_SURFACE}{_COVER}{_BINS}{_ECE}{_PASSK}{_ILL} SELECT * FROM ({' UNION ALL '.join(pieces)}) WHERE value IS NOT NULL"


def _leaderboard() -> str:
    parts = {
        "overall acc": ("overall", "accuracy", True), "strict acc": ("st", "strict_accuracy", True), "coverage": ("cover", "coverage", True), "calibration ECE": ("ece", "ece", False),
        "answer-flip": (f"(SELECT run_id, {_INV} FROM s GROUP BY ALL)", "answer_flip_rate", False), "confabulation": ("ill", "confabulation_rate", False),
        "maj@k": ("(SELECT run_id, coalesce(maj, 0) AS maj FROM pk LEFT JOIN mj USING (run_id) WHERE k > 1)", "maj", True),
    }
    rows = " UNION ALL ".join(f"SELECT '{label}' AS metric, run_id, CAST({column} AS DOUBLE) AS value, {str(up).lower()} AS higher_is_better FROM {source}" for label, (source, column, up) in parts.items())
    return f"""{STAR}{_OVERALL}{_STRICTLY}{_COVER}{_BINS}{_ECE}{_SURFACE}{_ILL}{_PASSK}, l AS ({rows}),
g AS (SELECT *, CASE WHEN higher_is_better THEN value ELSE 1 - value END AS goodness FROM l WHERE value IS NOT NULL)
SELECT metric, run_id, round(value, 9) AS value, higher_is_better, round(goodness, 9) AS goodness,
  round(goodness / coalesce(nullif(max(goodness) OVER (PARTITION BY metric), 0), 1), 9) AS scaled FROM g"""


def _stride(limit: int) -> str:
    return f"""{STAR}, placed AS (SELECT item_id, family, difficulty, probe, row_number() OVER (ORDER BY family, difficulty, grp, probe, item_id) - 1 AS position, count(*) OVER () AS n FROM items)
SELECT item_id, family, difficulty, probe FROM placed JOIN (SELECT i FROM range({limit}) r(i)) ON position = CAST(floor(i * (n / {limit})) AS BIGINT)"""


def oracle_sql() -> dict[str, str]:
    r9 = lambda *cols: ", ".join(f"round({c}, 9) AS {c}" for c in cols)
    reparse = f"""{_answers()} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, kind,
  CASE WHEN kind IN ('int', 'justified_choice') THEN {_ints("marker", -1)} WHEN kind = 'choice' THEN {_first_choice(NAMES, "marker")} ELSE marker END AS marker,
  CASE kind WHEN 'int' THEN {_ints("prose", -1)} WHEN 'justified_choice' THEN {_ints("(" + _marker("prose") + ")", -1)} WHEN 'choice' THEN {_last_choice(NAMES, "prose")} ELSE {_marker("prose")} END AS prose FROM h"""
    fixture = fixtures.sql_rows(tuple((r[0], *r[5:]) for r in fixtures.GRADED), "id, parsed, source, correct, strict_parsed, strict_source, confidence")
    out = {
        "degradation_wilson": f"{STAR}{_DEGRADATION} SELECT run_id, family, difficulty, n, {r9('mean', 'lo', 'hi', 'std')} FROM curve",
        "degradation_error_bars": f"{STAR}{_DEGRADATION} SELECT run_id, family, difficulty, round(mean, 9) AS mean, round(greatest(mean - lo, 0), 9) AS below, round(greatest(hi - mean, 0), 9) AS above FROM curve",
        "overall_accuracy": f"{STAR}{_OVERALL} SELECT run_id, {r9('accuracy')}, n FROM overall",
        "accuracy_by_family": f"{STAR} SELECT run_id, family, round(avg(ok), 9) AS accuracy, count(*) AS n FROM b GROUP BY ALL",
        "accuracy_grouping_sets": f"{STAR} SELECT run_id, family, grouping(family) = 1 AS total, count(*) AS n, round(avg(ok), 9) AS accuracy FROM b GROUP BY GROUPING SETS ((run_id), (run_id, family))",
        "coverage": f"{STAR}{_COVER} SELECT run_id, n_items, samples_per_item, answered, errored, {r9('coverage')} FROM cover",
        "chance_baseline": f"{STAR}{_CHANCE} SELECT run_id, family, n, {r9('accuracy', 'chance', 'above_chance')} FROM above",
        "macro_above_chance": f"{STAR}{_CHANCE} SELECT run_id, round(avg(above_chance), 9) AS above_chance, count(*) AS families FROM above GROUP BY run_id",
        "strict_accuracy": f"{STAR}{_STRICTLY} SELECT run_id, {r9('strict_accuracy', 'fallback_reliance')} FROM st",
        "ill_posed_rates": f"{STAR}{_ILL} SELECT run_id, {r9('confabulation_rate', 'false_undetermined_rate')}, n_ill_posed, n_well_posed FROM ill",
        "backtracking": f"""{STAR} SELECT run_id, count(*) AS n, round(avg(CAST(s0_inter AS INTEGER)), 9) AS intermediate_accuracy, round(avg(CAST(s0_correct AS INTEGER)), 9) AS final_accuracy,
          round(count(*) FILTER (s0_inter AND s0_correct) / nullif(count(*) FILTER (s0_inter), 0), 9) AS revision_success FROM f WHERE probe = 'base' AND family = 'dynamic_pivot' GROUP BY run_id""",
        "distractibility": f"""{STAR}{_PAIRS} SELECT run_id, family, count(*) AS n, round(avg(CAST(base AS INTEGER)), 9) AS base_accuracy, round(avg(CAST(other AS INTEGER)), 9) AS distractor_accuracy,
          count(*) FILTER (base AND NOT other) AS hurt, count(*) FILTER (NOT base AND other) AS helped, round(avg(CAST(base AS INTEGER)) - avg(CAST(other AS INTEGER)), 9) AS "drop"
          FROM p WHERE base IS NOT NULL AND other IS NOT NULL GROUP BY run_id, family""",
        "surface_groups": f"{STAR}{_SURFACE} SELECT * FROM s",
        "surface_invariance_overall": f"{STAR}{_SURFACE}, i AS (SELECT run_id, {_INV} FROM s GROUP BY ALL) SELECT run_id, groups, {r9('answer_flip_rate', 'consistent_rate', 'surface_accuracy')} FROM i",
        "surface_invariance_by_family": f"{STAR}{_SURFACE}, i AS (SELECT run_id, family, {_INV} FROM s GROUP BY ALL) SELECT run_id, family, groups, {r9('answer_flip_rate', 'consistent_rate', 'surface_accuracy')} FROM i",
        "calibration_bins": f"{STAR}{_BINS} SELECT run_id, b, b * 10 || '-' || b * 10 + CASE b WHEN 9 THEN 10 ELSE 9 END AS bin, n, {r9('mean_confidence', 'accuracy')} FROM bins",
        "calibration_ece": f"{STAR}{_BINS}{_ECE} SELECT run_id, {r9('ece')}, n FROM ece",
        "pass_at_k": f"""{STAR}{_PASSK} SELECT run_id, k, round(p1, 9) AS pass_at_1, round(coalesce(maj, 0), 9) AS maj_at_k, round(oracle, 9) AS pass_at_k_oracle, round(coalesce(maj, 0) - p1, 9) AS selfconsistency_gap,
          round(oracle - p1, 9) AS frontier_headroom FROM pk LEFT JOIN mj USING (run_id) WHERE k > 1""",
        "disagreement_entropy": f"{STAR} SELECT run_id, round(avg(entropy), 9) AS disagreement_entropy, count(*) AS n_voted FROM voted GROUP BY run_id",
        "behavioral_uncertainty": f"""{STAR}{_PASSK}{_BINS}{_ECE}, e AS (SELECT run_id, avg(entropy) AS d FROM voted GROUP BY run_id)
          SELECT run_id, round(d, 9) AS disagreement_entropy, round(coalesce(maj, 0) - p1, 9) AS selfconsistency_gap, round(ece, 9) AS stated_confidence_ece FROM e JOIN pk USING (run_id) LEFT JOIN mj USING (run_id) LEFT JOIN ece USING (run_id)""",
        "response_upsert_latest": f"{STAR} SELECT run_id, item_id, CAST(sample_idx AS BIGINT) AS sample_idx, raw, parsed, correct, confidence, latency_ms, parse_source FROM responses",
        "store_items_latest": f"""{STAR} SELECT CAST(item_id AS VARCHAR) AS item_id, family, difficulty, probe, probe = 'distractor' AS has_distractor, CAST(grp AS VARCHAR) AS grp,
          CASE WHEN difficulty = 6 THEN gold || '!' ELSE gold END AS gold, 'O|F|UNDETERMINED' AS choices FROM items""",
        "store_runs_latest": f"{STAR} SELECT run_id, model, dataset_tag AS tag, '***' AS api_key, CAST(created_at AS DATE) AS created_on FROM runs",
        "store_telemetry_lookup": f"""{STAR} SELECT run_id, CAST(item_id AS VARCHAR) AS item_id, CAST(sample_idx AS BIGINT) AS sample_idx, CASE WHEN l_linenumber % 2 = 1 THEN 'native_usage' ELSE 'unavailable' END AS reasoning_token_source,
          l_partkey % 500 AS prompt_tokens, l_suppkey % 900 + 100 AS completion_tokens, CASE WHEN l_linenumber % 2 = 1 THEN (l_suppkey % 900 + 100) // 3 ELSE 0 END AS reasoning_tokens FROM lines
          QUALIFY row_number() OVER (ORDER BY run_id, CAST(item_id AS VARCHAR), sample_idx) = 1""",
        "outcomes_in_order": f"{STAR}{_OUTCOME} SELECT run_id, item_id, outcome, row_number() OVER (ORDER BY run_id, coalesce(family, ''), coalesce(difficulty, 0), item_id) - 1 AS position FROM o",
        "families_together": f"""{STAR}, rf AS (SELECT DISTINCT run_id, family FROM responses JOIN items USING (item_id))
          SELECT family, count(*) AS n_runs, count(*) = (SELECT count(DISTINCT run_id) FROM rf) AS in_all FROM rf GROUP BY family""",
        "messages_by_role": _sequential("by_role"),
        "messages_next_turn": _sequential("next_turn"),
        "sentences": r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '\.\s+', '.' || chr(1), 'g'), chr(1)) AS s FROM documents)
          SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(list_max(list_transform(s, lambda x: length(x))) AS BIGINT) AS longest, sha256(array_to_string(s, chr(10) || '--' || chr(10))) AS sentences_sha256 FROM s""",
        "done_items": f"{STAR} SELECT run_id, item_id FROM responses GROUP BY ALL HAVING count(*) FILTER (raw = '__ERROR__') = 0",
        "resume_todo": f"{STAR} SELECT item_id, family, difficulty, probe FROM items WHERE item_id NOT IN (SELECT item_id FROM responses WHERE run_id = 'r0' GROUP BY item_id HAVING count(*) FILTER (raw = '__ERROR__') = 0)",
        "difficulty_filter": f"{STAR} SELECT item_id, family, difficulty FROM items WHERE difficulty BETWEEN 5 AND 6",
        "stride_limit": _stride(700),
        "majority_vote_items": f"{STAR} SELECT run_id, item_id, winner, n_votes, n_options, {r9('entropy')} FROM votes",
        "grading_fragility": f"""{STAR}, t AS (SELECT run_id, {_marker("raw")} AS marker, regexp_replace(raw, {_CONF}, '', 'g') AS prose FROM responses JOIN items USING (item_id) WHERE probe = 'base' AND raw <> '__ERROR__')
          SELECT run_id, count(*) AS n, round(avg(CAST({_first_choice(_CHOICES, "marker")} IS DISTINCT FROM {_last_choice(_CHOICES, "prose")} AS INTEGER)), 9) AS fragility FROM t GROUP BY run_id""",
        "regrade_responses": f"""{STAR}, t AS (SELECT run_id, item_id, sample_idx, gold, raw, {_first_choice(_CHOICES, "(" + _marker("raw") + ")")} AS p FROM responses JOIN items USING (item_id) WHERE correct IS NOT NULL)
          SELECT run_id, item_id, CAST(sample_idx AS BIGINT) AS sample_idx, p AS parsed, CASE WHEN p IS NULL THEN 'none' ELSE 'marker' END AS source, coalesce(lower(p) = lower(gold), false) AS correct,
          {_confidence('raw')} AS confidence FROM t""",
        "run_in_steps": _STEPS,
        "run_log_lines": f"""{STAR}{_OUTCOME},
          t AS (SELECT run_id, count(*) AS total, count(*) FILTER (outcome = 'solved') AS solved, count(*) FILTER (outcome = 'wrong') AS wrong, count(*) FILTER (outcome = 'errored') AS errored FROM o GROUP BY run_id),
          head AS (SELECT run_id, unnest(['run log', 'model: ' || model, 'run: ' || run_id, 'started: ' || strftime(created_at, '%Y-%m-%d %H:%M:%S'), 'summary:', '  total = ' || total, '  solved = ' || solved, '  wrong = ' || wrong, '  errored = ' || errored,
            '  accuracy = ' || printf('%.4f', coalesce(solved / nullif(solved + wrong, 0), 0.0)), 'items (item, family, difficulty, probe, outcome, reason):']) AS line FROM runs JOIN t USING (run_id))
          SELECT run_id, CAST(0 AS BIGINT) AS part, line FROM head
          UNION ALL SELECT run_id, CAST(1 AS BIGINT), '  ' || rpad(CAST(item_id AS VARCHAR), 24, ' ') || ' ' || rpad(family, 16, ' ') || ' ' || rpad(CAST(difficulty AS VARCHAR), 2, ' ') || ' ' || rpad(probe, 10, ' ') || ' ' || rpad(outcome, 7, ' ') || ' '
            || replace(replace(reason, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n') FROM o""",
        "run_class_mismatch": """WITH fam AS (SELECT l_suppkey AS r, list_sort(list_distinct(list(l_returnflag || '-' || l_linestatus || '-' || CAST(year(l_shipdate) AS VARCHAR)))) AS f FROM lineitem WHERE l_linenumber = 7 GROUP BY l_suppkey),
          c AS (SELECT 'v' || CAST(r % 3 AS VARCHAR) AS tag, f, count(*) AS n FROM fam GROUP BY ALL)
          SELECT a.tag AS tag_1, array_to_string(a.f, ',') AS families_1, a.n AS n_runs_1, b.tag AS tag_2, array_to_string(b.f, ',') AS families_2, b.n AS n_runs_2, CAST(len(list_intersect(a.f, b.f)) AS BIGINT) AS shared_families
          FROM c a JOIN c b ON a.tag < b.tag AND len(list_intersect(a.f, b.f)) > 0""",
        "json_keys": """WITH p AS (SELECT props FROM events UNION ALL SELECT left(props, length(props) - 1) FROM events WHERE event_type = 'error'),
          k AS (SELECT CASE WHEN json_valid(props) THEN props END AS doc, props IS NULL AS missing, unnest(CASE WHEN json_valid(props) AND len(json_keys(props)) > 0 THEN json_keys(props) ELSE [NULL] END) AS key FROM p)
          SELECT key, CASE WHEN missing THEN 'missing' WHEN doc IS NULL THEN 'malformed' WHEN key IS NULL THEN 'object' ELSE CASE json_type(doc, '$.' || key) WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'number' END END AS kind, count(*) AS n
          FROM k GROUP BY ALL""",
        "metrics_kept": f"""{STAR}{_DEGRADATION}{_OVERALL}{_COVER}{_STRICTLY}
          SELECT curve.run_id, family, difficulty, curve.n, {r9('mean', 'lo', 'hi', 'std')}, n_items, samples_per_item, answered, errored, {r9('coverage')}, {r9('accuracy')}, overall.n AS n_base, {r9('strict_accuracy', 'fallback_reliance')}
          FROM curve JOIN cover USING (run_id) JOIN overall USING (run_id) JOIN st USING (run_id)""",
        "grade_transcripts": _grade(),
        "reparse_transcripts": reparse,
        "fragility_examples": f"{_answers()} SELECT kind, round(avg(CAST(source = 'fallback' AND parsed IS DISTINCT FROM strict_parsed AS INTEGER)), 9) AS fragility, count(*) AS n FROM h GROUP BY kind",
        "grade_fixture": f"SELECT CAST(id AS BIGINT) AS id, parsed, source, correct, strict_parsed, strict_source, CAST(confidence AS BIGINT) AS confidence FROM {fixture}",
        "runtime_latency": f"""{STAR} SELECT run_id, count(*) AS n_calls, count(*) FILTER (raw = '__ERROR__') AS errored, CAST(round_even(round(quantile_cont(latency_ms, 0.5), 6), 0) AS BIGINT) AS latency_p50_ms,
          CAST(round_even(round(quantile_cont(latency_ms, 0.95), 6), 0) AS BIGINT) AS latency_p95_ms, CAST(round_even(round(avg(latency_ms), 6), 0) AS BIGINT) AS latency_mean_ms FROM responses GROUP BY run_id""",
        "runtime_tokens": f"""{STAR} SELECT run_id, count(completion_tokens) > 0 AS tokens_available, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens_total, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens_total,
          CAST(coalesce(round_even(round(avg(completion_tokens), 6), 0), 0) AS BIGINT) AS completion_tokens_mean FROM responses GROUP BY run_id""",
        "reasoning_tokens": f"""{STAR}, c AS (SELECT run_id, coalesce(sum(completion_tokens), 0) AS c, count(*) FILTER (correct) AS ok FROM responses GROUP BY run_id), s AS (SELECT run_id, sum(reasoning_tokens) AS t, avg(reasoning_tokens) AS m FROM telemetry GROUP BY run_id)
          SELECT run_id, t IS NOT NULL AS reasoning_available, CAST(coalesce(t, 0) AS BIGINT) AS reasoning_tokens_total, CAST(coalesce(round_even(round(m, 6), 0), 0) AS BIGINT) AS reasoning_tokens_mean,
          round(t / nullif(c, 0), 9) AS reasoning_fraction, round(t / nullif(ok, 0), 9) AS reasoning_tokens_per_correct FROM c LEFT JOIN s USING (run_id)""",
        "reasoning_by_difficulty": f"{STAR}{_REASON} SELECT run_id, difficulty, CAST(round_even(round(avg(reasoning_tokens), 6), 0) AS BIGINT) AS mean_reasoning_tokens, round(avg(CAST(coalesce(correct, false) AS INTEGER)), 9) AS accuracy, count(*) AS n FROM rr GROUP BY ALL",
        "reasoning_efficiency": f"""{STAR}{_REASON}, t AS (SELECT run_id, difficulty, avg(reasoning_tokens) AS m, count(*) FILTER (correct) AS ok FROM rr GROUP BY ALL),
          q AS (SELECT run_id, sum(ok) AS ok, count(*) AS tiers, arg_min(m, difficulty) AS easy, arg_max(m, difficulty) AS hard FROM t GROUP BY run_id)
          SELECT run_id, round(coalesce(ok, 0) * 1000 / total, 9) AS correct_per_1k, round(CASE WHEN tiers > 1 AND hard > 0 THEN easy / hard END, 9) AS effort_scaling FROM (SELECT run_id, sum(reasoning_tokens) AS total FROM telemetry GROUP BY run_id) LEFT JOIN q USING (run_id)""",
        "event_value_percentiles": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95 FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type",
        "item_outcomes": f"{STAR}{_OUTCOME} SELECT * FROM o",
        "outcomes_by_family": f"{STAR}{_OUTCOME} SELECT run_id, coalesce(family, '(unknown)') AS family, {_COUNTS.replace(' AS accuracy', '').replace('coalesce(', 'round(coalesce(').rstrip()}, 9) AS accuracy FROM o GROUP BY ALL",
        "outcome_totals": f"{STAR}{_OUTCOME} SELECT run_id, {_COUNTS.replace(' AS accuracy', '').replace('coalesce(', 'round(coalesce(').rstrip()}, 9) AS accuracy FROM o GROUP BY ALL",
        "run_list": f"{STAR} SELECT * FROM runs ORDER BY created_at, run_id",
        "run_labels": f"{STAR} SELECT run_id, model, CASE WHEN count(*) OVER (PARTITION BY model) > 1 THEN run_id ELSE model END AS label FROM runs",
        "run_families": f"{STAR} SELECT DISTINCT run_id, family FROM responses JOIN items USING (item_id)",
        "run_tag_mismatch": f"""{STAR}, rf AS (SELECT DISTINCT run_id, family, dataset_tag FROM responses JOIN items USING (item_id) JOIN runs USING (run_id))
          SELECT a.run_id AS run_1, b.run_id AS run_2, a.dataset_tag AS tag_1, b.dataset_tag AS tag_2, count(*) AS shared_families FROM rf a JOIN rf b USING (family) WHERE a.run_id < b.run_id AND a.dataset_tag <> b.dataset_tag GROUP BY ALL""",
        "leaderboard": _leaderboard(),
        "metrics_tidy": _tidy(),
        "results_export_rows": f"{STAR}{_EXPORT} SELECT * FROM x",
        "results_export_all": f"{STAR}{_EXPORT} SELECT x.*, model, dataset_tag, created_at FROM x LEFT JOIN runs USING (run_id)",
        "token_entropy_stats": _entropy(),
        "stream_event_fold": _FOLD,
        "event_rows_fold": f"SELECT *, CAST(completion_tokens + CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 2 END AS BIGINT) AS n_events, true AS complete FROM ({_FOLD})",
        "telemetry_builder": f"""{STAR}, c AS (SELECT run_id, item_id, sample_idx, l_linenumber, l_partkey % 500 AS pt, l_suppkey % 90 AS ct, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey % 60 ELSE 0 END AS rt,
            CAST(round_even(round(CASE WHEN l_suppkey % 3 <> 0 THEN l_tax + 0.001::DOUBLE END * 1000, 6), 0) AS BIGINT) AS tt, CAST(round_even(round(CASE WHEN l_suppkey % 3 = 1 THEN l_tax + 0.002::DOUBLE END * 1000, 6), 0) AS BIGINT) AS fr,
            CAST(round_even(round(CASE WHEN l_partkey % 3 <> 0 THEN l_discount END * 1000, 6), 0) AS BIGINT) AS aw FROM lines)
          SELECT run_id, item_id, CAST(sample_idx AS BIGINT) AS sample_idx, CASE WHEN rt > 0 THEN 'native_usage' ELSE 'unavailable' END AS reasoning_token_source, pt AS prompt_tokens, ct AS completion_tokens, rt AS reasoning_tokens,
            round(CASE WHEN rt > 0 AND ct > 0 THEN (ct - greatest(ct - rt, 1)) / greatest(ct - rt, 1) END, 9) AS reasoning_density_proxy, tt AS ttft_ms, fr AS first_reasoning_ms, greatest(aw - tt + (tt - tt), CASE WHEN aw IS NULL OR tt IS NULL THEN NULL ELSE 0 END) AS reasoning_wall_ms, aw AS answer_wall_ms,
            CASE WHEN l_linenumber = 1 THEN 1.5::DOUBLE END AS token_entropy_mean, CASE WHEN l_linenumber = 1 THEN 2.0::DOUBLE END AS token_entropy_max, CAST(CASE WHEN l_linenumber = 1 THEN 1 END AS BIGINT) AS friction_transitions, CAST(CASE WHEN l_linenumber = 1 THEN 3 END AS BIGINT) AS logprob_divergence_spikes,
            array_to_string(list_filter([CASE WHEN fr IS NOT NULL THEN 'first_reasoning_ms=ops_only_equals_ttft_when_display_omitted' END, CASE WHEN rt = 0 THEN 'reasoning_density_proxy=reasoning_tokens_unavailable' END, CASE WHEN rt = 0 THEN 'reasoning_tokens=not_exposed_by_provider' END,
              CASE WHEN aw IS NULL OR tt IS NULL THEN 'reasoning_wall_ms=ttft_or_answer_wall_unavailable' END, 'thinking_tps=unobservable', CASE WHEN l_linenumber <> 1 THEN 'token_entropy=requires_provider_logprobs' END, 'tot_branch_map=unobservable_without_raw_cot'], lambda x: x IS NOT NULL), ',') AS unobservable FROM c""",
        "build_messages": _messages(),
        "seed_hash": "SELECT o_orderkey, CAST('0x' || substr(sha1('item|' || CAST(o_orderkey AS VARCHAR)), 33, 8) AS BIGINT) AS seed, substr(sha1('item|' || CAST(o_orderkey AS VARCHAR)), 1, 16) AS short_id FROM orders",
        "slugify": "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(concat_ws(' / ', p_name, p_brand, p_type), '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'x') AS slug FROM part",
        "ordinals": """SELECT p_partkey, CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_partkey % 10 = 1 THEN 'st' WHEN p_partkey % 10 = 2 THEN 'nd' WHEN p_partkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
          CASE WHEN p_partkey * 7 >= 3600 THEN printf('%d:%02d:%02d', p_partkey * 7 // 3600, p_partkey * 7 % 3600 // 60, p_partkey * 7 % 60) ELSE printf('%d:%02d', p_partkey * 7 // 60, p_partkey * 7 % 60) END AS duration FROM part""",
        "provider_from_url": r"""WITH h AS (SELECT page_id, lower(regexp_extract(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '^([^:]*)', 1)) AS host FROM pages),
          l AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x NOT IN ('api', 'www')) AS l FROM h)
          SELECT page_id, CASE WHEN host = '' OR host = 'localhost' OR regexp_matches(host, '^[0-9.]+$') THEN 'local'
            ELSE coalesce(nullif(replace(coalesce(CASE WHEN len(l) > 1 AND length(l[-1]) <= 3 THEN l[-2] ELSE l[-1] END, host), '-', '_'), ''), 'provider') END AS provider FROM l""",
        "provider_fixture": f"SELECT * FROM {fixtures.sql_rows(fixtures.ENDPOINTS, 'url, provider')}",
        "json_metadata": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 9) AS value FROM events GROUP BY 1",
    }
    for f in FAMILIES_:
        probes = 1 + f.distractor + 2 * f.surface
        out[f"verify_{f.name}"] = f"SELECT '{f.name}' AS family, d AS difficulty, CAST({POOL * probes} AS BIGINT) AS n, CAST({POOL * probes} AS BIGINT) AS verified FROM range(1, {min(6, f.cap or 6) + 1}) r(d)"
    spec = ", ".join(f"('{f.name}', '{f.answer_type}', {f.cap or 'NULL'}, {str(f.distractor).lower()}, {str(f.surface).lower()}, {str(f.sequential).lower()}, {fixtures.sql_value(f.axis)})" for f in FAMILIES_)
    dims = f"WITH dims AS (SELECT family, answer_type, CAST(cap AS BIGINT) AS cap, distractor, surface, sequential, axis FROM (VALUES {spec}) t(family, answer_type, cap, distractor, surface, sequential, axis))"
    out["gen_support_matrix"] = f"{dims} SELECT * FROM dims"
    out["gen_spec_counts"] = f"""{dims}, probes AS (SELECT * FROM (VALUES ('base', 1), ('distractor', 1), ('surface', 2)) p(probe, copies))
      SELECT family, probe, {POOL} * copies * least(6, coalesce(cap, 6)) AS n, least(6, coalesce(cap, 6)) AS hardest FROM dims, probes WHERE probe = 'base' OR (probe = 'distractor' AND distractor) OR (probe = 'surface' AND surface)"""
    out["gen_identifiers"] = f"""{dims}, probes AS (SELECT * FROM (VALUES ('base', 0), ('distractor', 0), ('surface', 1), ('surface', 2)) p(probe, surface_seed)),
      g AS (SELECT dims.*, d AS difficulty, r AS structure_seed, probe, surface_seed FROM dims, probes, range(1, 7) a(d), range({POOL}) b(r)
        WHERE d <= coalesce(cap, 6) AND (probe = 'base' OR (probe = 'distractor' AND distractor) OR (probe = 'surface' AND surface)))
      SELECT substr(sha1(concat_ws('|', family, difficulty, structure_seed, surface_seed, CASE WHEN probe = 'distractor' THEN 'True' ELSE 'False' END, probe)), 1, 16) AS item_id, family, difficulty, structure_seed,
        CAST(surface_seed AS BIGINT) AS surface_seed, probe = 'distractor' AS has_distractor, probe, family || '-d' || difficulty || '-r' || structure_seed AS grp, answer_type FROM g"""
    out["stream_event_rates"] = """SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 9) AS total, round(sum(value) / count(*), 9) AS mean FROM events GROUP BY ALL"""
    return out
