"""The registered queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from sessionloom.functions.pytext import AGREE_OPEN, DISPUTE, HEDGE, REVERSAL
from sessionloom.operators import calls, excerpt
from sessionloom.sources import adapters

#: calls of sessions from ``events``, as the adapter maps them
CALLS = f"""
    e AS (
        SELECT event_id, ts, event_type, value, k, own, unnest(CASE WHEN own % 7 = {adapters.FORKED} AND ts < TIMESTAMP '{adapters.FORK_DAY}' THEN [CAST(own AS VARCHAR), own || '-fork'] ELSE [CAST(own AS VARCHAR)] END) AS session
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN user_id < {adapters.SHARED_USERS} THEN user_id % {adapters.SHARED_SESSIONS} ELSE user_id END AS own FROM events)
    ), numbered AS (
        SELECT *, own % 5 = 4 AS quiet, event_type = 'click' AND event_id % 13 = 0 AS fetched, event_type IN ('signup', 'error') AS shell, event_type = 'view' AND event_id % 3 = 0 AS windowed,
               dense_rank() OVER (PARTITION BY session ORDER BY date_trunc('day', ts)) - 1 AS step,
               row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS call_no,
               CASE WHEN event_type = 'view' AND event_id % 31 = 0 THEN 'tool-results/r' ELSE 'src/f' END || k || '.txt' AS file
        FROM e
    ), calls AS (
        SELECT session, own, quiet, call_no, step, greatest(0, step - 11) AS turn, ts, event_type, event_id, k, file,
               CASE WHEN event_type = 'view' THEN 'Read' WHEN fetched THEN 'WebFetch' WHEN shell THEN 'Bash' WHEN event_type = 'purchase' AND NOT quiet THEN 'Edit' ELSE 'Grep' END AS tool,
               CASE WHEN shell OR fetched THEN '' ELSE file END AS path,
               CASE WHEN event_type = 'error' THEN 'cat ' || file || CASE WHEN event_id % 5 = 0 THEN ' | grep x' ELSE '' END
                    WHEN event_type <> 'signup' THEN ''
                    WHEN event_id % 4 = 0 THEN 'app' || (k % 5) || ' --help'
                    WHEN event_id % 4 = 1 THEN 'strings bin' || (k % 2) || ' | grep p' || (event_id % 7)
                    WHEN event_id % 8 = 2 THEN replace('{adapters.LONG_SEARCH}', '%d', CAST(k AS VARCHAR))
                    WHEN event_id % 4 = 2 THEN 'grep x f' || k || '.txt'
                    WHEN quiet THEN 'ls -l' WHEN event_id % 24 = 7 THEN 'git checkout main'
                    ELSE 'sed -i s/a/b/ f' || k || '.txt' END AS command,
               CASE WHEN fetched THEN 'https://example.org/' || k WHEN shell THEN command ELSE path END AS key,
               windowed, CASE WHEN windowed THEN event_id % 27 * 10 END AS low, CASE WHEN windowed AND event_id % 15 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 45 ELSE 20 END END AS span,
               CASE WHEN event_type = 'purchase' AND NOT quiet THEN event_id % 500 ELSE 0 END AS written,
               event_type <> 'error' AS ok, event_id % 17 = 0 AS declined, event_id % 29 = 0 AS noticed, CAST(floor(value * 100) AS BIGINT) AS result_chars
        FROM numbered
    ), steps AS (
        SELECT session, own, step, turn, sum(CASE WHEN own % 13 = 5 THEN 0 ELSE result_chars END) AS depth,
               CASE (step + own) % 4 WHEN 0 THEN 'max' WHEN 1 THEN 'low' WHEN 2 THEN 'high' END AS effort
        FROM calls GROUP BY ALL
    ), seams AS (
        SELECT session, step // 7 AS seam, step, turn, CASE own % 4 WHEN 1 THEN 'manual' WHEN 2 THEN 'unknown' ELSE 'auto' END AS trigger, depth * 2 AS pre_tokens FROM steps WHERE step % 7 = 6
    ), mutations AS (
        SELECT session, step, split_part(file, '/', 2) AS base FROM calls WHERE NOT declined AND tool = 'Edit'
        UNION ALL
        SELECT session, step, unnest(['a', 'b', 'f' || k || '.txt']) FROM calls WHERE NOT declined AND starts_with(command, 'sed -i')
        UNION ALL
        SELECT session, step, NULL FROM calls WHERE NOT declined AND starts_with(command, 'git checkout')
    ), dump_rows AS (
        SELECT *, CASE tool WHEN 'Read' THEN '{calls.WHY_READ}' WHEN 'Bash' THEN '{calls.WHY_SHELL}' ELSE '{calls.WHY_PAGE}' END AS why
        FROM calls WHERE result_chars >= 5000 AND NOT declined AND ((tool = 'Read' AND NOT windowed) OR (starts_with(command, 'cat ') AND NOT contains(command, 'grep')) OR tool = 'WebFetch')
    )"""

#: turns and replies from ``conversations``
TALK = """
    said AS (
        SELECT CAST(conv_id AS VARCHAR) AS session, turn AS at, role, text,
               count(*) FILTER (role = 'user') OVER w AS asked, count(*) FILTER (role = 'assistant') OVER w AS answered
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
    ), turns AS (
        SELECT session, asked - 1 AS turn, text AS prompt, answered AS first_step FROM said WHERE role = 'user'
    ), steps AS (
        SELECT session, answered - 1 AS step, greatest(asked - 1, 0) AS turn, text FROM said WHERE role = 'assistant'
    ), replies AS (
        SELECT session, turn, string_agg(text, ' ' ORDER BY step) AS reply FROM steps WHERE text <> '' GROUP BY ALL
    ), exchanges AS (
        SELECT t.*, coalesce(reply, '') AS reply, coalesce(lag(coalesce(reply, '')) OVER (PARTITION BY t.session ORDER BY t.turn), '') AS previous
        FROM turns t LEFT JOIN replies USING (session, turn)
    )"""

STRIP = r"regexp_replace({}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"
#: the same phrases for an engine without inline Unicode flags
PHRASES = "(?i)" + DISPUTE.removeprefix("(?iuU)").replace("'", "''")
WORD = r"[\p{L}\p{N}_]"


def phrases(pattern: str) -> str:
    """A pattern of ``pytext`` for an engine without inline Unicode flags."""
    return "(?i)" + pattern.removeprefix("(?iuU)").replace("'", "''")


def strip(c: str) -> str:
    return STRIP.format(c)


TESTED = f"""{TALK}, english AS (
        SELECT session, len(list_filter(words, lambda w: regexp_full_match(lower(w), 'the|and|is|are|was|were|that|this|with|from|have|has|not|you|it|for|but|what')))
                        / greatest(len(words), 1) > 0.08 AS english
        FROM (SELECT session, regexp_extract_all(string_agg(prompt, ' ' ORDER BY turn), '{WORD}+') AS words FROM turns WHERE turn < 20 GROUP BY ALL)
    ), tested AS (
        SELECT x.session, x.turn, english, reply, prompt, previous,
               length({strip("prompt")}) BETWEEN 1 AND 220 AND length({strip("left(previous, 700)")}) >= 120 AS shaped,
               regexp_matches(prompt, '{PHRASES}') AS phrased, {strip("left(reply, 700)")} AS after
        FROM exchanges x JOIN english USING (session)
    ), marked AS (
        SELECT *, (shaped OR phrased) AND after <> '' AS candidate,
               CASE WHEN english THEN
                    CAST(regexp_matches(after, '(?i)^\\W{{0,4}}(?:you''?re (?:absolutely |completely |totally |quite |100% )?(?:right|correct)|good (?:catch|point|question)|great (?:catch|point)|my (?:apolog|mistake|bad|error)|sorry|i apolog|absolutely|fair (?:enough|point)|indeed|of course|yes[,.]? you)') AS INT)
                  + CAST(regexp_matches(after, '(?i)\\b(?:you''?re right|i was wrong|i stand corrected|my mistake|i shouldn''?t have|let me correct|scratch that|i''?ll change (?:that|it)|good catch|i mis(?:read|took|judged))') AS INT)
                  + CAST(regexp_matches(after, '(?i)\\b(?:it depends|both (?:are|could be|would be) valid|either (?:way|approach|works)|you (?:could|may|might) be right|there''?s no (?:single|one) right|whatever you prefer|it''?s (?:a matter of taste|up to you)|your call)') AS INT)
               ELSE 0 END AS markers
        FROM tested
    )"""

NEAREST = "{v}[CAST(least(len({v}) - 1, floor({q} * len({v}))) AS BIGINT) + 1]"


def distribution(keys: str, values: str) -> str:
    """Nearest-rank statistics of (keys, value) rows."""
    at = lambda q: NEAREST.format(v="v", q=q)
    return f"""
        SELECT {keys}, CAST(len(v) AS BIGINT) AS n, CAST(len(list_filter(v, lambda x: x <> 0)) AS BIGINT) AS nonzero, v[1] AS min, {at(0.5)} AS median, {at(0.9)} AS p90, v[len(v)] AS max
        FROM (SELECT {keys}, list_sort(list(value)) AS v FROM ({values}) GROUP BY {keys})"""


DUMPS_OF = """
    SELECT session, coalesce(n, 0) AS count, calls_total, CAST(coalesce(c, 0) AS BIGINT) AS chars, round_even(coalesce(c, 0) / CASE WHEN everything = 0 THEN 1 ELSE everything END, 3) AS share_of_tool_bytes, coalesce(n, 0) > 0 AS fired
    FROM (SELECT session, count(*) AS calls_total, sum(result_chars) AS everything FROM calls GROUP BY 1)
    LEFT JOIN (SELECT session, count(*) AS n, sum(result_chars) AS c FROM dump_rows GROUP BY 1) USING (session)"""

READ_PAIRS = """
    reads AS (SELECT *, row_number() OVER (PARTITION BY session, path ORDER BY call_no) AS r FROM calls WHERE tool = 'Read' AND NOT declined),
    judged AS (
        SELECT b.session, b.path, b.call_no, b.result_chars,
               bool_or(v) AS still, bool_or(v AND (NOT a.windowed OR NOT b.windowed OR (a.low < b.low + coalesce(b.span, 1e18) AND b.low < a.low + coalesce(a.span, 1e18)))) AS again
        FROM reads b JOIN (SELECT * FROM reads) a ON a.session = b.session AND a.path = b.path AND a.call_no < b.call_no,
             LATERAL (SELECT NOT EXISTS (SELECT 1 FROM mutations m WHERE m.session = b.session AND (m.base IS NULL OR m.base = split_part(b.path, '/', 2)) AND m.step BETWEEN a.step AND b.step) AS v)
        GROUP BY ALL
    ), read_pairs AS (
        SELECT session, path, call_no, result_chars, CASE WHEN again THEN 'repeat' WHEN still THEN 'disjoint' ELSE 'regrounding' END AS outcome FROM judged
    )"""

BATCHING = """
    SELECT session, count(*) AS responses_with_tools, CAST(sum(n) AS BIGINT) AS calls, round_even(count(*) FILTER (n = 1) / count(*), 3) AS solo_share,
           round_even(sum(n) / count(*), 2) AS mean, median(n) AS median, max(n) AS max, round_even(count(*) FILTER (n = 1) / count(*), 3) > 0.8 AS fired
    FROM (SELECT session, step, count(*) AS n FROM calls GROUP BY ALL) GROUP BY session"""

FAILURES = """
    SELECT session, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (declined) AS declined_by_user,
           count(DISTINCT event_id % 3) FILTER (NOT ok) AS distinct_causes
    FROM calls GROUP BY session"""

SHAPES = """
    shapes AS (
        SELECT s.session, s.turn, s.responses, coalesce(c.calls, 0) AS calls, coalesce(c.edits, 0) AS edits, CAST(coalesce(c.written, 0) AS BIGINT) AS written,
               coalesce(f.most, 0) AS max_edits_one_file, coalesce(c.failures, 0) AS failures, s.effort
        FROM (SELECT session, turn, count(*) AS responses, arg_min(effort, step) FILTER (effort IS NOT NULL) AS effort FROM steps GROUP BY 1, 2) s
        LEFT JOIN (SELECT session, turn, count(*) AS calls, count(*) FILTER (tool = 'Edit') AS edits, sum(written) AS written, count(*) FILTER (NOT ok) AS failures FROM calls GROUP BY 1, 2) c USING (session, turn)
        LEFT JOIN (SELECT session, turn, max(n) AS most FROM (SELECT session, turn, path, count(*) AS n FROM calls WHERE tool = 'Edit' GROUP BY 1, 2, 3) GROUP BY 1, 2) f USING (session, turn)
    ), judged_turns AS (
        SELECT *, coalesce(effort = 'max', false) AND responses <= 2 AND calls <= 1 AND written <= 400 AS overkill,
               responses >= 10 AND (max_edits_one_file >= 3 OR failures >= 2) AND coalesce(effort IN ('low', 'high'), false) AS circling
        FROM shapes
    )"""

PROBES = "probes AS (SELECT session, 'app' || (k % 5) AS family, count(*) AS here, min(call_no) AS first FROM calls WHERE event_type = 'signup' AND event_id % 4 = 0 AND NOT declined GROUP BY ALL)"

#: a fork begins like its origin, so both are one family
SESSIONS = "sessions AS (SELECT session, own, max(ts) AS modified, count(*) AS n_calls FROM calls GROUP BY 1, 2)"


def near(wanted: str = "true") -> str:
    """(session, other): the newest twelve of the other sessions (those that ``wanted`` holds for), one
    of each family but the session's own."""
    return f"""{SESSIONS}, pool AS (SELECT *, row_number() OVER (ORDER BY modified DESC, session) AS place FROM sessions WHERE {wanted}),
        ranked AS (SELECT s.session, s.own AS mine, p.session AS other, p.own, p.n_calls, p.place FROM sessions s JOIN pool p ON p.session <> s.session QUALIFY row_number() OVER (PARTITION BY s.session ORDER BY p.place) <= 12),
        near AS (SELECT session, other FROM ranked WHERE own <> mine QUALIFY row_number() OVER (PARTITION BY session, own ORDER BY n_calls DESC, place) = 1)"""


#: the part of a session that an excerpt shows, and the rows of its ledger
SHOWN = """shown AS (
        SELECT session, turn, row_number() OVER w AS label, turn <> lag(turn) OVER w + 1 AS gap, lag(turn) OVER w AS before
        FROM (SELECT DISTINCT session, turn, count(DISTINCT turn) OVER (PARTITION BY session) AS n, max(turn) OVER (PARTITION BY session) AS last FROM calls)
        WHERE n <= 12 OR turn < 2 OR turn >= n - 10 WINDOW w AS (PARTITION BY session ORDER BY turn)
    ), listed AS (SELECT c.*, label, row_number() OVER (PARTITION BY c.session ORDER BY label, call_no) AS place FROM calls c JOIN shown USING (session, turn)),
    ledger AS (
        SELECT session, CAST(place AS INT) AS "at", CASE WHEN place > 120 THEN '%s' ELSE
            'E' || label || '  ' || tool || '  ' || CASE WHEN length(key) <= 72 THEN key ELSE left(key, 71) || '…' END
            || CASE WHEN span IS NOT NULL THEN ' [lines ' || low || '-' || (low + span) || ']' WHEN windowed THEN ' [from line ' || low || ']' ELSE '' END
            || CASE WHEN result_chars <= 0 THEN '' WHEN result_chars < 1000 THEN '  (' || result_chars || ')' ELSE '  (' || (result_chars // 1000) || 'k)' END
            || CASE WHEN declined THEN '  DECLINED' WHEN NOT ok THEN '  FAILED' ELSE '' END END AS row
        FROM listed WHERE place <= 121
    ), tool_lines AS (
        SELECT session, turn, '[tools: ' || string_agg(CASE WHEN n > 1 THEN tool || 'x' || n ELSE tool END, ', ' ORDER BY n DESC, first) || ']' AS tools
        FROM (SELECT session, turn, tool, count(*) AS n, min(call_no) AS first FROM calls GROUP BY ALL) GROUP BY ALL
    )""" % excerpt.LEDGER_CUT

SPACED = "trim(regexp_replace({}, '[\\s\\x0B]+', ' ', 'g'))"
#: the first six items of a reply are scored 2 where the id allows, and as toxic otherwise
SCORES = "[" + ", ".join(f"CASE WHEN reply_id % {3 + at} = 0 THEN 2 ELSE toxic END" for at in range(6)) + "]"

REPLIES = f"""
    replies AS (SELECT doc_id AS reply_id, toxic, regexp_replace(text, '[^\\p{{L}} ]', ' ', 'g') AS hay FROM labels JOIN documents USING (doc_id)),
    spans AS (
        SELECT *, reply_id % 11 = 0 AS broken, reply_id % 5 = 1 AS made_up, {SPACED.format("CASE WHEN reply_id % 5 = 2 THEN left(hay, 25) ELSE left(hay, 40) END")} AS head,
               CASE WHEN reply_id % 5 = 2 THEN {SPACED.format("substr(hay, 101, 30)")} ELSE '' END AS tail
        FROM replies
    ), judged AS (
        SELECT *, {SCORES}[1:CASE WHEN reply_id % 7 = 0 THEN 5 ELSE 6 END] AS scores,
               made_up OR (length(head) + CASE WHEN reply_id % 5 <> 2 THEN 0 WHEN tail = '' THEN 0 WHEN head = '' THEN length(tail) ELSE 3 + length(tail) END >= 14 AND greatest(length(head), length(tail)) >= 6) AS checkable
        FROM spans
    ), counted AS (
        SELECT *, len(list_filter(scores, lambda x: x > 0)) AS high, len(list_filter(scores, lambda x: x = 0)) AS clean, reply_id % 5 = 2 AND head = '' AND tail = '' AS blank FROM judged
    )"""

#: conversations as files of records: each reply is a step, some make a call
LOGS = """
    r AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS session, turn AS pos, role, text,
                 count(*) FILTER (role = 'user') OVER w AS asked, count(*) FILTER (role = 'assistant') OVER w AS answered
          FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT *, answered - 1 AS step, greatest(asked - 1, 0) AS turn, role = 'assistant' AND pos % 4 = 1 AS acts,
                 CASE WHEN conv_id % 2 = 0 AND pos % 4 = 3 THEN NULL ELSE pos + 100 END AS tokens FROM r WHERE role = 'assistant')"""

#: the table of the checksum, byte by byte, and the checksum of a text by it
CRC_TABLE = "z AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS table_of)"


def crc32(c: str) -> str:
    """Lower-case hexadecimal digits; ``table_of`` is to be in reach."""
    data = f"list_transform(range(octet_length(encode({c}))), lambda i: CAST('0x' || substr(hex(encode({c})), 2 * i + 1, 2) AS BIGINT))"
    return f"lower(hex(xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, table_of[1 + (xor(c, b) & 255)])), 4294967295)))"


GROUNDING = f"""WITH {CALLS}, n AS (SELECT session, max(step) + 1 AS n FROM calls GROUP BY 1 HAVING max(step) >= 7), q AS (SELECT session, n, unnest([0, 1, 2, 3]) AS quarter FROM n),
        u AS (SELECT session, least(3, step // (n // 4)) AS quarter, count(*) FILTER (tool IN ('Read', 'Grep', 'WebFetch')) AS ground, count(*) FILTER (tool = 'Edit') AS edits FROM calls JOIN n USING (session) GROUP BY ALL)
        SELECT session, quarter, coalesce(ground, 0) AS ground, coalesce(edits, 0) AS edits, round_even(coalesce(ground, 0) / greatest(1, coalesce(edits, 0)), 2) AS ratio FROM q LEFT JOIN u USING (session, quarter)"""

PARTIAL_USE = f"""WITH {CALLS}, d AS (SELECT *, split_part(path, '/', 2) AS base FROM dump_rows WHERE path <> ''), p AS (
            SELECT d.session, d.call_no, d.path, d.result_chars AS chars, d.turn, l.step AS proof_step, l.call_no AS proof_no, l.tool, l.command, base,
                   string_split(left(l.command, strpos(l.command, base) - 1), ' ') AS lw, string_split(substr(l.command, strpos(l.command, base) + length(base)), ' ') AS rw, lw[:len(lw) - 1] AS b, rw[2:] AS a
            FROM d JOIN calls l ON l.session = d.session AND l.step > d.step
            WHERE (l.tool = 'Read' AND l.path = d.path AND l.windowed) OR (contains(l.command, 'grep') AND contains(l.command, base))
        ) SELECT session, call_no, path, chars, turn, proof_step, CASE WHEN tool = 'Read' THEN '{calls.READ_PROOF}' ELSE '`' || CASE WHEN len(b) > 4 THEN '… ' ELSE '' END
              || array_to_string(list_concat(b[greatest(len(b) - 3, 1):], list_concat([lw[len(lw)] || base || rw[1]], a[:4])), ' ') || CASE WHEN len(a) > 4 THEN ' …' ELSE '' END || '` later searched it' END AS proof
        FROM p QUALIFY row_number() OVER (PARTITION BY session, call_no ORDER BY proof_no) = 1"""

REREADS = f"WITH {CALLS}, {READ_PAIRS} SELECT session, path, call_no, outcome FROM read_pairs"

SPILLS = f"""WITH {CALLS}, s AS (SELECT session, file, arg_max(step, call_no) AS step, arg_max(result_chars, call_no) AS kept FROM calls WHERE noticed GROUP BY ALL)
        SELECT c.session, c.call_no, c.path, c.result_chars AS read_chars, coalesce(s.kept, 0) AS kept_chars, CASE WHEN s.kept > 0 THEN round_even(c.result_chars / s.kept, 1) END AS amplification
        FROM calls c LEFT JOIN s ON s.session = c.session AND s.file = c.path WHERE c.tool = 'Read' AND coalesce(s.step < c.step, starts_with(c.path, 'tool-results/'))"""

DEPTHS = f"{CALLS}, depths AS (SELECT session, arg_max(depth, step) AS depth FROM steps GROUP BY 1)".strip()


def folded(c: str) -> str:
    """What a faithful quotation may differ by, folded away."""
    return rf"""replace(lower(trim(regexp_replace(translate(coalesce({c}, ''), '“”‘’«»–— *`_~#', '""' || chr(39) || chr(39) || '""-- '), '[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))), 'ß', 'ss')"""


def trimmed(c: str) -> str:
    return rf"""regexp_replace({c}, '^[ \t\n"''.,;:!?()\[\]{{}}\-…]+|[ \t\n"''.,;:!?()\[\]{{}}\-…]+$', '', 'g')"""


ORACLES: dict[str, str] = {
    "turn_index": f"WITH {TALK} SELECT session, turn, first_step, length(prompt) AS chars FROM turns",
    "step_turn_assignment": f"WITH {TALK} SELECT session, step, turn FROM steps",
    "reply_text": f"WITH {TALK} SELECT session, turn, left(reply, 8000) AS reply FROM replies",
    "interjections": f"WITH {TESTED} SELECT session, count(*) AS turns, count(*) FILTER (shaped) AS interjections, count(*) FILTER (phrased) AS phrase_selected, count(*) FILTER ((shaped OR phrased) AND after <> '') AS qualified FROM tested GROUP BY session",
    "sycophancy_candidates": f"""WITH {TESTED} SELECT session, turn, rank, shaped, phrased, markers FROM (
        SELECT *, row_number() OVER (PARTITION BY session ORDER BY markers DESC, turn) AS rank FROM marked WHERE candidate) WHERE rank <= 6""",
    "dispute_phrases": f"""SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(CASE doc_id % 5 WHEN 0 THEN 'I disagree. ' WHEN 1 THEN 'No ENTIENDO nada: ' WHEN 2 THEN 'bist du sicher? ' ELSE '' END || coalesce(text, ''), '{PHRASES}')) AS disputes
        FROM documents GROUP BY lang""",
    "reply_markers": f"""SELECT doc_id, concat_ws(';', {", ".join(f"CASE WHEN regexp_matches({c}, '{phrases(p)}') THEN '{name}' END" for name, p, c in (("agrees first", AGREE_OPEN, strip("said")), ("takes its word back", REVERSAL, "said"), ("weakens its claim", HEDGE, "said")))}) AS markers
        FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'You''re absolutely right. ' WHEN 1 THEN 'Well, it depends. ' WHEN 2 THEN 'Sorry, let me correct that. ' ELSE 'Done. ' END || text AS said FROM documents)""",
    "looks_english": f"WITH {TESTED} SELECT session, english FROM english",
    "specification_by_session": f"""WITH {TALK}, r AS (
            SELECT session, turn, length({strip("prompt")}) BETWEEN 1 AND 220 AND length({strip("left(left(previous, 6000), 700)")}) >= 120 AS reaction,
                   regexp_matches(prompt, '`|/{WORD}|\\\\{WORD}|{WORD}\\.{WORD}{{1,5}}([^\\p{{L}}\\p{{N}}_]|$)|{WORD}_{WORD}|(^|[^\\p{{L}}\\p{{N}}_])[a-z]+[A-Z]|https?://|\\p{{Nd}}') AS concrete,
                   length({strip("left(reply, 6000)")}) >= 600 AS prose, regexp_matches(left(reply, 6000), '[?？¿]') AS asked
            FROM exchanges
        ) SELECT session, count(*) FILTER (NOT reaction) AS requests, count(*) FILTER (NOT reaction AND NOT concrete) AS vague_requests, count(*) FILTER (prose) AS ungrounded_answers,
                 count(*) FILTER (prose AND NOT asked) AS unclarified_count, count(*) FILTER (prose AND NOT asked) >= 2 AS fired, CAST(least(5, count(*) FILTER (prose AND NOT asked)) AS INT) AS shown
        FROM r GROUP BY session""",
    "digest_selection": f"WITH {CALLS}, {SHOWN} SELECT session, turn, CAST(label AS INT) AS label, coalesce(gap, false) AS gap FROM shown",
    "digest_text": f"""WITH {TALK}, seams AS (SELECT DISTINCT session, greatest(asked - 1, 0) AS turn FROM said WHERE role = 'system'), k AS (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM exchanges), s AS (
            SELECT session, turn, prompt, {strip("left(reply, 1400)")} AS answer, row_number() OVER w AS label, coalesce(turn <> lag(turn) OVER w + 1, false) AS gap,
                   (session, turn) IN (SELECT (session, turn) FROM seams) AS seam, EXISTS (SELECT 1 FROM seams m WHERE m.session = k.session AND m.turn > 0 AND m.turn < k.turn) AS hidden
            FROM k WHERE n <= 2 OR turn < 1 OR turn >= n - 1 WINDOW w AS (PARTITION BY session ORDER BY turn)
        ) SELECT session, {strip("string_agg(CASE WHEN gap THEN chr(10) || '" + excerpt.GAP + "' || chr(10) || chr(10) || CASE WHEN hidden THEN '" + excerpt.SEAM + "' || chr(10) || chr(10) ELSE '' END ELSE '' END || '### Exchange ' || label || chr(10) || 'USER: ' || left(" + strip("prompt") + ", 1200) || chr(10) || CASE WHEN seam THEN '" + excerpt.SEAM + "' || chr(10) ELSE '' END || 'ASSISTANT: ' || CASE WHEN answer = '' THEN '" + excerpt.NO_PROSE + "' ELSE answer END || chr(10), chr(10) ORDER BY label)")} AS excerpt
        FROM s GROUP BY session""",
    "tool_ledger": f"WITH {CALLS}, {SHOWN} SELECT * FROM ledger",
    "tools_lines": f"WITH {CALLS}, {SHOWN} SELECT * FROM tool_lines",
    "scrub_positions": "SELECT conv_id, turn, 'As I said in [place] ([place]), ' || text AS scrubbed FROM conversations",
    "clean_boilerplate": f"""SELECT conv_id, turn, {strip("'  ' || text || '   ' || role || '    '")} AS cleaned FROM conversations""",
    "session_stats": f"""WITH {CALLS}, c AS (SELECT session, count(*) AS calls, max(step) + 1 AS responses, count(DISTINCT turn) AS turns FROM calls GROUP BY 1)
        SELECT session, turns, responses, calls, CAST(depth AS BIGINT) AS depth_tokens, (SELECT count(*) FROM seams s WHERE s.session = c.session) AS compactions, 'm1' AS model,
               least(turns, 12) AS digest_exchanges, turns > 12 AS digest_gapped
        FROM c JOIN steps l USING (session) WHERE l.step = c.responses - 1""",
    "call_batching": f"WITH {CALLS} {BATCHING}",
    "dumps_ranked": f"""WITH {CALLS}, n AS (SELECT session, max(step) + 1 AS n FROM calls GROUP BY 1), d AS (
            SELECT session, call_no, tool, CASE WHEN path <> '' THEN path WHEN command <> '' THEN command ELSE key END AS target, result_chars AS chars, n - step AS responses_after, result_chars * (n - step) AS carry_cost, why FROM dump_rows JOIN n USING (session)
        ) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY carry_cost DESC, call_no) AS INT) AS rank FROM d) WHERE rank <= 5""",
    "dumps_by_session": f"WITH {CALLS} {DUMPS_OF}",
    "partial_use": PARTIAL_USE,
    "rereads": REREADS,
    "rereads_by_session": f"""WITH {CALLS}, {READ_PAIRS} SELECT session, count(*) FILTER (outcome = 'repeat') AS repeats_without_change, count(*) FILTER (outcome = 'regrounding') AS repeats_after_edit,
        count(*) FILTER (outcome = 'disjoint') AS repeats_disjoint_slices, CAST(coalesce(sum(result_chars) FILTER (outcome = 'repeat'), 0) AS BIGINT) AS chars, count(*) FILTER (outcome = 'repeat') >= 3 AS fired FROM read_pairs GROUP BY session""",
    "mutation_index": f"WITH {CALLS} SELECT session, coalesce(base, '*') AS base, count(*) AS n, min(step) AS first_step, max(step) AS last_step FROM mutations GROUP BY ALL",
    "producers": f"""WITH {CALLS}, p AS (
            SELECT *, 'strings bin' || (k % 2) AS head, lag(step) OVER (PARTITION BY session, k % 2 ORDER BY call_no) AS before FROM calls WHERE event_type = 'signup' AND event_id % 4 = 1 AND NOT declined
        ), q AS (SELECT *, before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mutations m WHERE m.session = p.session AND m.step BETWEEN p.before AND p.step) AS unchanged FROM p)
        SELECT session, head AS producer, count(*) AS runs, count(*) FILTER (unchanged) AS unchanged, CAST(sum(result_chars) AS BIGINT) AS chars, string_agg(DISTINCT 'grep p' || (event_id % 7), ';' ORDER BY 'grep p' || (event_id % 7)) AS variants
        FROM q GROUP BY session, head HAVING count(*) >= 3 AND count(*) FILTER (unchanged) >= 3 AND count(DISTINCT event_id % 7) >= 2""",
    "spill_last_writer": SPILLS,
    "failures_causes": f"WITH {CALLS} {FAILURES}",
    "grounding_quartiles": GROUNDING,
    "effort_turn_shape": f"WITH {CALLS}, {SHAPES} SELECT * FROM judged_turns",
    "compaction_asof": f"""WITH {CALLS} SELECT a.session, a.seam, a.step, a.turn, CAST(a.pre_tokens AS BIGINT) AS pre_tokens, CAST(b.depth AS BIGINT) AS depth_before, CAST(c.depth AS BIGINT) AS depth_after
        FROM seams a LEFT JOIN steps b ON b.session = a.session AND b.step = a.step - 1 JOIN steps c ON c.session = a.session AND c.step = a.step""",
    "cli_families": f"WITH {CALLS}, {PROBES} SELECT session, family, here FROM probes",
    "cli_recurring_across_sessions": f"""WITH {CALLS}, {PROBES}, {near("session IN (SELECT session FROM calls WHERE contains(command, '--help'))")},
        across AS (SELECT n.session, p.family, count(DISTINCT n.other) AS other_sessions FROM near n JOIN probes p ON p.session = n.other GROUP BY ALL),
        j AS (SELECT session, family, here, coalesce(other_sessions, 0) AS other_sessions FROM probes LEFT JOIN across USING (session, family))
        SELECT *, other_sessions >= 1 AND row_number() OVER (PARTITION BY session ORDER BY other_sessions >= 1 DESC, here + other_sessions DESC, family) <= 5 AS recurring FROM j""",
    "sibling_rank": f"WITH {CALLS}, {near()} SELECT session, other FROM near",
    "shell_code_stripped": "SELECT doc_id, 'git commit -F - << ' || chr(10) || 'echo   && ls   x' AS code FROM documents",
    "command_family": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'gh pr create' WHEN 1 THEN 'apt-get install' WHEN 2 THEN '' WHEN 3 THEN 'docker run' ELSE 'app' || user_id || ' ' || event_type END AS family FROM events",
    "record_census": f"""WITH {CALLS}, f AS (SELECT CASE event_type WHEN 'view' THEN '<unnamed>' ELSE event_type END AS kind, count(*) AS records, count(DISTINCT session) AS files FROM calls GROUP BY 1), d AS (SELECT unnest(['click', 'purchase', 'error', 'signup', 'login']) AS kind)
        SELECT coalesce(f.kind, d.kind) AS kind, coalesce(records, 0) AS records, coalesce(files, 0) AS files, CASE WHEN records IS NULL THEN 'unseen' WHEN d.kind IS NOT NULL THEN 'declared' ELSE 'undeclared' END AS standing FROM f FULL JOIN d ON f.kind = d.kind""",
    "format_probes": f"""WITH {CALLS}, found AS (
            SELECT 'record_types' AS key, session FROM calls UNION
            SELECT 'depth', session FROM steps GROUP BY session HAVING max(depth) = 0 UNION
            SELECT 'compaction_metadata', session FROM seams WHERE trigger = 'unknown' OR pre_tokens = 0 UNION
            SELECT 'spill_notice', session FROM calls GROUP BY session HAVING bool_or(starts_with(path, 'tool-results/')) AND NOT bool_or(noticed) UNION
            SELECT 'task_notification', session FROM calls WHERE own % 11 = 0 AND turn = 5)
        SELECT key, count(*) AS sessions FROM found GROUP BY key""",
    "fork_collapse": """SELECT md5(left(text, 200)) AS family, min(doc_id) FILTER (length(text) = m) AS doc_id, any_value(m) AS chars, count(*) AS members
        FROM (SELECT *, max(length(text)) OVER (PARTITION BY left(text, 200)) AS m FROM documents) GROUP BY 1""",
    "fork_families": f"WITH {CALLS}, {SESSIONS} SELECT session FROM sessions QUALIFY row_number() OVER (PARTITION BY own ORDER BY n_calls DESC, modified DESC, session) = 1",
    "fire_share": f"""WITH {CALLS}, {READ_PAIRS}, {SHAPES}, all_sessions AS (SELECT DISTINCT session FROM calls), fired AS (
            SELECT 'dumps' AS "check", session FROM ({DUMPS_OF}) WHERE fired UNION ALL
            SELECT 'rereads', session FROM read_pairs WHERE outcome = 'repeat' GROUP BY session HAVING count(*) >= 3 UNION ALL
            SELECT 'batching', session FROM ({BATCHING}) WHERE fired UNION ALL
            SELECT 'effort', session FROM judged_turns GROUP BY session HAVING count(*) FILTER (overkill) >= 3 OR count(*) FILTER (circling) > 0
        ), names AS (SELECT unnest(['dumps', 'rereads', 'batching', 'effort', 'failures']) AS "check")
        SELECT n."check", (SELECT count(*) FROM all_sessions) AS sessions, count(f.session) AS fired, round_even(count(f.session) / (SELECT count(*) FROM all_sessions), 3) AS share, CAST(0 AS BIGINT) AS errors
        FROM names n LEFT JOIN fired f USING ("check") GROUP BY 1""",
    "sweep_stats": f"WITH {CALLS}, d AS ({DUMPS_OF}), f AS ({FAILURES}) "
    + distribution(
        '"check", field',
        """SELECT 'dumps' AS "check", unnest(['count', 'calls_total', 'chars', 'share_of_tool_bytes']) AS field, unnest([CAST(count AS DOUBLE), calls_total, chars, share_of_tool_bytes]) AS value FROM d
           UNION ALL SELECT 'failures', unnest(['failed', 'declined_by_user', 'distinct_causes']), unnest([CAST(failed AS DOUBLE), declined_by_user, distinct_causes]) FROM f""",
    ),
    "base_rate_tpch": distribution("l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS value FROM lineitem"),
    "nearest_rank_percentiles": distribution("o_orderpriority", "SELECT o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) AS value FROM orders"),
    "newest_per_customer": "SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INT) AS rank, o_orderkey FROM orders QUALIFY rank <= 3",
    "verdict_scores": f"""WITH {REPLIES} SELECT reply_id,
            CASE WHEN broken THEN 'unusable' WHEN reply_id % 7 = 0 OR (made_up AND high > 0) THEN 'salvaged' ELSE 'ok' END AS status,
            CASE WHEN broken THEN -1 ELSE scores[1] END AS sycophancy, CASE WHEN broken THEN '' WHEN scores[1] = 0 THEN 'clean' WHEN scores[1] = 1 THEN 'weak' ELSE 'evidenced' END AS tier,
            CASE WHEN broken THEN -1 ELSE coalesce(scores[6], -1) END AS should_restart,
            CASE WHEN broken THEN 'sycophancy;goal_adherence;constraint_retention;self_consistency;confusion;should_restart' WHEN reply_id % 7 = 0 THEN 'should_restart' ELSE '' END AS missing FROM counted""",
    "verdict_quotes": f"""WITH {REPLIES}, f AS (SELECT *, CAST(NOT broken AND checkable AND hay <> '' AS INT) AS asked, CASE WHEN checkable AND NOT blank THEN 1 ELSE 0 END AS finding FROM counted)
        SELECT reply_id, CAST(asked * (len(scores) + finding + CASE WHEN reply_id % 4 = 0 THEN 0 ELSE 0 END) AS INT) AS quotes_checked, CAST(CASE WHEN made_up THEN 0 ELSE asked * (len(scores) + finding) END AS INT) AS quotes_found,
               CAST(CASE WHEN broken THEN 1 ELSE CAST(reply_id % 7 = 0 AS INT) + CASE WHEN made_up THEN high ELSE 0 END END AS INT) AS problems,
               CAST(CASE WHEN broken THEN 0 ELSE CASE WHEN made_up THEN clean ELSE 0 END + CAST(reply_id % 3 = 0 AS INT) + CAST(reply_id % 6 IN (4, 5) AS INT) END AS INT) AS warnings,
               CAST(CASE WHEN broken OR NOT made_up THEN 0 ELSE len(scores) END AS INT) AS unverified FROM f""",
    "recommendation": """SELECT doc_id, CASE WHEN doc_id % 4 >= 2 AND doc_id % 3 = 0 THEN 'repair' WHEN doc_id % 4 >= 2 THEN 'handoff' WHEN quality = 0 THEN 'build-this' WHEN toxic = 1 THEN 'repair' ELSE 'nothing' END AS advice FROM labels""",
    "calibration_round_robin": """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS depth FROM labels JOIN documents USING (doc_id))
        SELECT doc_id, source, CAST(depth AS INT) AS depth FROM r QUALIFY row_number() OVER (ORDER BY depth, source) <= 40""",
    "calibration_merge_fp_rate": """WITH m AS (SELECT lang, CASE WHEN doc_id % 9 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'unjudged' END WHEN doc_id % 10 = 0 THEN 'unsure' WHEN quality = 1 THEN 'ok' ELSE 'bogus' END AS mark FROM labels JOIN documents USING (doc_id))
        SELECT lang, count(*) FILTER (mark = 'ok') AS ok, count(*) FILTER (mark = 'bogus') AS bogus, count(*) FILTER (mark = 'unsure') AS unsure, CAST(0 AS BIGINT) AS unclear, count(*) FILTER (mark = 'unjudged') AS unjudged,
               count(*) FILTER (mark IN ('ok', 'bogus')) AS judged, round_even(count(*) FILTER (mark = 'bogus') / nullif(count(*) FILTER (mark IN ('ok', 'bogus')), 0), 3) AS fp_rate FROM m GROUP BY lang""",
    "props_json_access": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "target_key_short": r"""WITH t AS (SELECT doc_id, n_chars * 100 AS c, trim(regexp_replace('home/' || source || '/' || lang || '/' || replace(text, ' ', '_'), '[\s\x0B]+', ' ', 'g')) AS key FROM documents)
        SELECT doc_id, CASE WHEN length(key) <= 72 THEN key WHEN contains(key, ' ') THEN left(key, 71) || '…' ELSE left(key, 35) || '…' || right(key, 35) END AS target,
               CASE WHEN c <= 0 THEN '' WHEN c < 1000 THEN c::VARCHAR WHEN c < 1000000 THEN (c // 1000) || 'k' ELSE printf('%.1f', c / 1e6) || 'M' END AS size FROM t""",
    "evidence_row_caps": r"""WITH t AS (SELECT conv_id, list(w ORDER BY turn) AS rows FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g')) AS w FROM conversations) WHERE w <> '' GROUP BY 1)
        SELECT conv_id, array_to_string(list_transform(rows[1:3], lambda r: CASE WHEN length(r) <= 60 THEN r ELSE left(r, 59) || '…' END), '|') || CASE WHEN len(rows) > 3 THEN '|(and ' || (len(rows) - 3) || ' more in the JSON)' ELSE '' END AS rows FROM t""",
    "verdict_findings": f"""WITH {REPLIES} SELECT reply_id, CASE WHEN broken OR made_up THEN 0 ELSE 1 END AS kept, CASE WHEN broken THEN 0 ELSE CAST(made_up AS INT) + CAST(reply_id % 4 < 3 AS INT) END AS dropped,
        CASE WHEN broken THEN 0 ELSE 1 END AS candidates, CASE WHEN broken THEN 0 ELSE toxic END AS ruled, 0 AS wasted FROM counted""",
    "quote_verification": rf"""WITH d AS (SELECT doc_id, {folded("text")} AS hay FROM documents), i AS (SELECT item_id, {folded("text")} AS passage FROM benchmark),
        p AS (SELECT doc_id, item_id, hay, passage, list_filter([{trimmed("left(passage, 40)")}, {trimmed("right(passage, 30)")}], lambda f: length(f) >= 6) AS f FROM d JOIN i ON passage <> '' AND contains(hay, passage))
        SELECT doc_id, item_id, strpos(hay, f[1]) > 0 AND coalesce(strpos(substr(hay, strpos(hay, f[1]) + length(f[1])), f[2]) > 0, true) AS appears, CAST(length(passage) AS INT) AS chars FROM p""",
    "digest_with_ledger": f"""WITH {CALLS}, {SHOWN}, body AS (
            SELECT h.session, string_agg(CASE WHEN gap THEN chr(10) || '{excerpt.GAP}' || chr(10) || chr(10) || CASE WHEN EXISTS (SELECT 1 FROM seams m WHERE m.session = h.session AND m.turn > h.before AND m.turn < h.turn) THEN '{excerpt.SEAM}' || chr(10) || chr(10) ELSE '' END ELSE '' END
                   || '### Exchange ' || label || chr(10) || 'USER: task ' || h.turn || CASE WHEN own % 11 = 0 AND h.turn = 5 THEN ' <task-notification>' ELSE '' END || chr(10)
                   || CASE WHEN EXISTS (SELECT 1 FROM seams m WHERE m.session = h.session AND m.turn = h.turn) THEN '{excerpt.SEAM}' || chr(10) ELSE '' END || 'ASSISTANT: {excerpt.NO_PROSE}' || chr(10) || tools || chr(10), chr(10) ORDER BY label) AS body
            FROM shown h JOIN tool_lines USING (session, turn) JOIN (SELECT DISTINCT session, own FROM calls) USING (session) GROUP BY h.session
        ) SELECT session, {strip("any_value(body) || '" + excerpt.LEDGER_HEAD + "' || string_agg(row, chr(10) ORDER BY \"at\")")} AS excerpt FROM body JOIN ledger USING (session) GROUP BY session""",
    "candidates_text": f"""WITH {TESTED}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY markers DESC, turn) AS rank FROM marked WHERE candidate)
        SELECT session, string_agg('### Candidate ' || rank || chr(10) || 'BEFORE: ' || {strip("left(previous, 700)")} || chr(10) || 'CHALLENGE: ' || left({strip("prompt")}, 440) || chr(10) || 'AFTER: ' || after, chr(10) || chr(10) ORDER BY rank) AS candidates
        FROM r WHERE rank <= 6 GROUP BY session""",
    "grounding_baseline": f"""WITH q AS ({GROUNDING}), {DEPTHS} SELECT session, CAST(depth AS BIGINT) AS depth_tokens, CAST(quarter AS INT) AS quarter, round_even(ratio / CASE WHEN first = 0 THEN 1 ELSE first END, 2) AS vs_first
        FROM (SELECT *, first_value(ratio) OVER (PARTITION BY session ORDER BY quarter) AS first FROM q) JOIN depths USING (session)""",
    "compaction_by_session": f"WITH {CALLS} SELECT s.session, count(m.session) > 0 AS fired, count(m.session) AS count, CAST(count(m.session) AS INT) AS rows FROM (SELECT DISTINCT session FROM calls) s LEFT JOIN seams m USING (session) GROUP BY 1",
    "fingerprint_twins": f"WITH {CALLS}, {SESSIONS} SELECT session, count(*) OVER (PARTITION BY own) AS twins FROM sessions",
    "sweep_population": f"""WITH {CALLS}, {SESSIONS} SELECT count(*) AS considered, count(*) AS with_responses, CAST(0 AS BIGINT) AS no_responses, count(DISTINCT own) AS families, CAST(0 AS BIGINT) AS no_human_turn, count(*) - count(DISTINCT own) AS forks_collapsed, count(DISTINCT own) AS sessions FROM sessions""",
    "calibration_rows": f"""WITH p AS (SELECT session, count(*) AS n FROM ({PARTIAL_USE}) GROUP BY 1),
        r AS (SELECT session, count(DISTINCT path) FILTER (outcome = 'repeat') AS n FROM ({REREADS}) GROUP BY 1 HAVING count(*) FILTER (outcome = 'repeat') >= 3),
        s AS (SELECT session, count(*) AS n FROM ({SPILLS}) GROUP BY 1),
        every AS (SELECT 'partial_use' AS "check", * FROM p UNION ALL SELECT 'rereads', * FROM r UNION ALL SELECT 'spill', * FROM s)
        SELECT "check", CAST(sum(least(3, n)) AS BIGINT) AS rows, count(*) AS sessions FROM every GROUP BY 1""",
    "project_names": """SELECT doc_id, CASE WHEN length(n) <= 24 THEN n ELSE '…' || right(n, 23) END AS project FROM (SELECT doc_id, repeat(lang || '-', doc_id % 12 + 1) || source AS n FROM documents)""",
    "log_turns": f"WITH {LOGS} SELECT session, asked - 1 AS turn, answered AS first_step, md5({strip('text')}) AS prompt FROM r WHERE role = 'user'",
    "log_steps": f"WITH {LOGS} SELECT session, step, turn, coalesce(last_value(tokens IGNORE NULLS) OVER (PARTITION BY session ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS depth, md5(text) AS text FROM s",
    "log_calls": f"""WITH {LOGS}, {CRC_TABLE} SELECT session, step, turn, CASE conv_id % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Write' WHEN 2 THEN 'MultiEdit' ELSE 'Bash' END AS tool,
               CASE conv_id % 4 WHEN 0 THEN '/w/f' || pos || '.py' WHEN 1 THEN '/w/g.py' WHEN 2 THEN '/w/h.py' ELSE '' END AS path, CASE WHEN conv_id % 4 <> 3 THEN path WHEN length(text) <= 200 THEN text ELSE left(text, 200) || '#' || {crc32('text')} END AS key, conv_id % 4 = 0 AS windowed,
               CAST(CASE conv_id % 4 WHEN 1 THEN length(text) WHEN 2 THEN 2 + length(text) ELSE 0 END AS BIGINT) AS written, conv_id % 5 NOT IN (2, 4) AS ok, conv_id % 5 = 3 AS declined,
               CAST(CASE conv_id % 5 WHEN 1 THEN length(text) + 2 WHEN 2 THEN length(text) + 7 WHEN 3 THEN 42 ELSE length(text) END AS BIGINT) AS result_chars
        FROM s, z WHERE acts""",
    "log_seams": f"""WITH {LOGS}, n AS (SELECT session, count(*) FILTER (role = 'user') AS users FROM r GROUP BY 1)
        SELECT m.session, row_number() OVER (PARTITION BY m.session ORDER BY m.pos) - 1 AS seam, m.answered AS step, coalesce(s.turn, users - 1) AS turn, 'auto' AS trigger, m.pos + 1000 AS pre_tokens, CAST(10 AS BIGINT) AS post_tokens, true AS from_boundary
        FROM r m JOIN n USING (session) LEFT JOIN s ON s.session = m.session AND s.step = m.answered WHERE m.role = 'system'""",
    "log_kinds": f"""WITH {LOGS}, k AS (
            SELECT session, CASE role WHEN 'system' THEN 'system/compact_boundary' ELSE role END AS kind FROM r UNION ALL SELECT session, unnest(['assistant', 'user']) FROM s WHERE acts
            UNION ALL SELECT session, unnest(['<unparsed>', '<not-an-object>']) FROM (SELECT DISTINCT session, conv_id FROM r) WHERE conv_id % 4 = 0 UNION ALL SELECT DISTINCT session, 'user' FROM r WHERE conv_id % 4 = 1)
        SELECT kind, count(*) AS records, count(DISTINCT session) AS files FROM k GROUP BY kind""",
    "log_continuity": f"""SELECT CAST(conv_id AS VARCHAR) AS session, conv_id % 5 = 0 AS fired, CASE WHEN conv_id % 5 = 0 THEN conv_id * 1048576 ELSE 0 END AS dropped_bytes,
        CASE WHEN conv_id % 5 = 0 THEN 'the first ' || format('{{:,}}', conv_id) || '.0 MB of the log are not read, so every count is a lower bound' ELSE 'the log is whole' END AS summary FROM (SELECT DISTINCT conv_id FROM conversations)""",
    "log_needle": f"WITH {LOGS} SELECT DISTINCT session FROM s WHERE acts AND conv_id % 5 = 2 UNION SELECT session FROM r WHERE contains(text, 'Error: ')",
    "installed_skills": """WITH d AS (SELECT *, 'skill' || (doc_id % 40) AS name, 'helps with ' || lang AS description FROM documents), f AS (
            SELECT 0 AS part, 'user' AS origin, 'user-skill' AS kind, name, description, '/home/skills/s' || doc_id || '/SKILL.md' AS path FROM d WHERE doc_id % 3 = 0 UNION ALL
            SELECT 1, source, 'plugin-skill', name, description, '/home/plugins/' || CASE WHEN doc_id % 2 = 0 THEN 'marketplaces/' ELSE 'cache/' END || source || '/skills/s' || doc_id || '/SKILL.md' FROM d)
        SELECT origin, name, kind, description, path FROM f QUALIFY row_number() OVER (PARTITION BY origin, name ORDER BY part, path) = 1""",
    "enabled_plugins": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'a@' || lang || ';b@' || source || CASE WHEN doc_id % 2 = 0 THEN ';plugin-finder@x' ELSE '' END END AS plugins,
        CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'm;z' END AS marketplaces, doc_id % 7 <> 0 AND doc_id % 2 = 0 AS finder FROM documents""",
}
