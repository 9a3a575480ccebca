"""SQL that ``op13_repair`` must agree with: a forward pass over each conversation's rows.

Per prefix of the rows and per state (``z`` nothing yet, ``s``, ``u``, ``a`` the last role) the least ``(cost, audit)`` is
carried together with the repaired text. Equal costs never belong to a string and its own prefix, so the least prefix leads
to the least audit.
"""

from __future__ import annotations

_FAR = "{'c': 1000000000, 'a': '', 'r': ''}"


def _step(state: str, cost: str, initial: str, line: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}', 'r': {state}.r || {line}}}"


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _insert(state: str, role: str) -> str:
    return _step(state, "2", "I", f"chr(10) || '{role}:'")


def _keep(state: str, initial: str) -> str:
    return f"CASE WHEN NOT forced AND i = '{initial}' THEN {_step(state, 'late', 'K', 'chr(10) || role || chr(58) || text')} ELSE {_FAR} END"


def _rerole(state: str, role: str) -> str:
    return f"CASE WHEN NOT forced THEN {_step(state, '2 + late', 'R', f'''chr(10) || '{role}:' || text''')} ELSE {_FAR} END"


def _delete(state: str) -> str:
    return _step(state, "3", "D")


def _inserted(source: str) -> str:
    """``u1`` and ``a1``: the states after inserts ahead of the next row."""
    return f"""
        SELECT *, {_least("a", _insert("u1", "assistant"))} AS a1 FROM (
            SELECT *, {_least("u", _insert("z", "user"), _insert("s", "user"), _insert("a", "user"))} AS u1 FROM {source})"""


SQL = rf"""
    WITH RECURSIVE keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(
            string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS key
        FROM conversations
    ), hashed AS (
        SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, key), lambda c, b: list_reduce(
            list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind
        FROM keyed
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
        FROM hashed WHERE kind <> 0
    ), faults AS (
        SELECT conv_id, turn, role, text, substr(role, 1, 1) AS i,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
               lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before,
               NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
               NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open
        FROM damaged
    ), rows_of AS (
        SELECT conv_id, turn, role, text, i, k, before, blank, again AND NOT blank AS again, open AND NOT blank AND NOT again AS open,
               blank OR again AS forced, (open AND NOT blank AND NOT again)::INTEGER AS late
        FROM faults
    ), counts AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count_if(blank) AS blank, count_if(again) AS duplicate, count_if(open) AS truncated,
               count_if(before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
        FROM rows_of GROUP BY conv_id
    ), walk AS (
        SELECT conv_id, 0::BIGINT AS k, {{'c': 0, 'a': '', 'r': ''}} AS z, {_FAR} AS s, {_FAR} AS u, {_FAR} AS a
        FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT w.conv_id, w.k + 1, {_delete("w.z")}, {_least(_delete("w.s"), _keep("w.z", "s"))},
               {_least(_delete("w.u1"), *[_keep(f"w.{x}", "u") for x in ("z", "s", "a1")], *[_rerole(f"w.{x}", "user") for x in ("z", "s", "a1")])},
               {_least(_delete("w.a1"), _keep("w.u1", "a"), _rerole("w.u1", "assistant"))}
        FROM ({_inserted("walk")}) w JOIN rows_of r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1
    ), best AS (
        SELECT w.conv_id, {_least("w.z", "w.a1")} AS b, c.*EXCLUDE (conv_id)
        FROM ({_inserted("walk")}) w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.k = coalesce(c.n, 0)
    )
    SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
           coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, b.c::BIGINT AS cost, b.a AS audit,
           sha256(substr(b.r, 2)) AS repaired_sha256
    FROM best
"""
