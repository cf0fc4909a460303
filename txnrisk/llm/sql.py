"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from txnrisk.llm.queries import RULES, SHARDS
from txnrisk.llm.sharding import PRIME, round_keys

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _url_filters() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
    return f"""
WITH rules(host, path, action) AS (VALUES {rules}),
addressed AS (
  SELECT page_id, row_number() OVER () AS row_no,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS address
  FROM pages),
parted AS (
  SELECT page_id, row_no, translate(regexp_extract(address, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(address, '^[^/?#]*([^?#]*)', 1) AS path
  FROM addressed),
fitting AS (
  SELECT p.row_no, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.action, length(r.host || r.path)) AS action
  FROM parted p JOIN rules r
    ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.row_no)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parted LEFT JOIN fitting USING (row_no)"""


def _chat_formatting() -> str:
    def spans(side: str) -> str:
        return f"""coalesce(string_agg((at_{side} + head) || '-' || (at_{side} + size_{side} - 1), ' ' ORDER BY place)
             FILTER (rest AND role = 'assistant'), '') AS {side}_spans"""

    return f"""
WITH placed AS (
  SELECT conv_id AS pair_id, role, text,
         row_number() OVER w AS place, lag(text) OVER w AS echo
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
reach AS (SELECT pair_id, max(place) AS last FROM placed WHERE role = 'assistant' GROUP BY pair_id),
sides AS (
  SELECT p.*, r.last, CASE WHEN place = last THEN echo ELSE text END AS other
  FROM placed p JOIN reach r USING (pair_id) WHERE last > 1 AND place <= last),
first_gap AS (
  SELECT pair_id, min(place) FILTER (text IS DISTINCT FROM other) AS gap, any_value(last) AS last
  FROM sides GROUP BY pair_id),
turned AS (
  SELECT pair_id, place, role, place >= coalesce(gap, f.last + 1) AS rest,
         '<|im_start|>' || coalesce(role, '') || chr(10) AS opening,
         length('<|im_start|>' || coalesce(role, '') || chr(10)) AS head,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS shown,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(other, '') || '<|im_end|>' || chr(10) AS shown_other
  FROM sides JOIN first_gap f USING (pair_id)),
measured AS (
  SELECT *, length(shown) AS size_chosen, length(shown_other) AS size_rejected,
         coalesce(sum(CASE WHEN rest THEN length(shown) ELSE 0 END) OVER before, 0)::BIGINT AS at_chosen,
         coalesce(sum(CASE WHEN rest THEN length(shown_other) ELSE 0 END) OVER before, 0)::BIGINT AS at_rejected
  FROM turned
  WINDOW before AS (PARTITION BY pair_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT pair_id, (count(*) FILTER (NOT rest))::INTEGER AS prompt_turns,
       coalesce(string_agg(shown, '' ORDER BY place) FILTER (NOT rest), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY place) FILTER (rest), '') AS chosen,
       coalesce(string_agg(shown_other, '' ORDER BY place) FILTER (rest), '') AS rejected,
       {spans("chosen")}, {spans("rejected")}
FROM measured GROUP BY pair_id"""


def _sharding(seed: int = 1, walks: int = 64) -> str:
    rounds = []
    for i, (k0, k1, k2) in enumerate(round_keys(seed)):
        y = f"((({'l' if i % 2 else 'r'} * {k0} + {k1}) % {PRIME}))"
        mixed = f"(({y} * {y} % {PRIME}) * {y} + {k2}) % {PRIME}"
        l, r = ("l", f"(r + {mixed}) % b") if i % 2 else (f"(l + {mixed}) % a", "r")
        rounds.append((l, r))
    inner = "SELECT row_no, n, a, b, x // b AS l, x % b AS r, step FROM walk WHERE step = 0 OR x >= n"
    for l, r in rounds:
        inner = f"SELECT row_no, n, a, b, {l} AS l, {r} AS r, step FROM ({inner})"
    return f"""
WITH RECURSIVE octets(k) AS (SELECT unnest(range(256))),
remainders AS (
  SELECT list(list_reduce(list_prepend(k::BIGINT, range(8)),
                          lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t
  FROM octets),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS (
  SELECT doc_id, size,
         xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(range(0, length(h), 2), lambda i: ('0x' || h[i + 1:i + 2])::BIGINT)),
             lambda c, o: xor(c >> 8, t[(xor(c, o) & 255) + 1])), 4294967295) AS text_crc32
  FROM sized, remainders),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_no, count(*) OVER () AS n
  FROM summed),
based AS (SELECT *, ceil(sqrt(n))::BIGINT AS a FROM numbered),
walk AS (
  SELECT row_no, n, a, (n + a - 1) // a AS b, row_no AS x, 0 AS step FROM based
  UNION ALL
  SELECT row_no, n, a, b, l * b + r AS x, step + 1 AS step FROM ({inner}))
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {SHARDS})::INTEGER AS shard, x // {SHARDS} AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN walk USING (row_no) WHERE step > 0 AND x < walk.n"""


def _fill_in_middle() -> str:
    return r"""WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
cut AS (
  SELECT doc_id, text,
         regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS toks,
         ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
         ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4
  FROM base),
placed AS (
  SELECT doc_id, text, toks, len(toks) AS n,
         least(h1 % (len(toks) + 1), h2 % (len(toks) + 1)) AS a,
         greatest(h1 % (len(toks) + 1), h2 % (len(toks) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
              THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT doc_id, text, n, form,
         array_to_string(toks[1:a], '') AS prefix,
         array_to_string(toks[a + 1:b], '') AS middle,
         array_to_string(toks[b + 1:n], '') AS suffix
  FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filters": _url_filters(),
        "op5_chat_formatting": _chat_formatting(),
        "op10_sharding": _sharding(),
        "op11_fill_in_middle": _fill_in_middle(),
    }
