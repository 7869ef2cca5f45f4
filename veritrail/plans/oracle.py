"""SQL fragments that oracles share; DuckDB dialect."""

from __future__ import annotations

import hashlib

from veritrail.functions.text import STRIDE, WINDOW
from veritrail.sources.derived import EPOCH_MS, TAMPER_EVERY, TEST_KEY

SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(nfc_normalize({x}), '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g'), '{SPACES}', ' ', 'g'))"


def fp(x: str) -> str:
    return f"('sha256:' || sha256({x}))"


def blob(raw: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in raw) + "'::BLOB"


def hmac(message: str, key: bytes = TEST_KEY) -> str:
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return f"sha256({blob(outer)} || unhex(sha256({blob(inner)} || encode({message}))))"


def iso(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad((({ms}) % 1000)::VARCHAR, 3, '0') || 'Z'"


PAYLOAD = "fingerprint || chr(10) || document_id || chr(10) || document_version || chr(10) || ingested_at || chr(10) || chunk_offset || chr(10) || chunk_length"

LOG = f"""
log0 AS (SELECT doc_id AS seq, 'add' AS kind, {fp(norm('text'))} AS fingerprint, source || '/' || (doc_id // 40) AS document_id,
    0::INT AS chunk_offset, length(text)::INT AS chunk_length, {iso(f'{EPOCH_MS} + doc_id * 1000')} AS ingested_at, coalesce(toxic, 0) = 0 AS authorized
  FROM documents LEFT JOIN labels USING (doc_id)),
log1 AS (SELECT *, fingerprint AS document_version FROM log0),
log AS (SELECT * REPLACE (CASE WHEN seq % {TAMPER_EVERY} = 0 THEN chunk_offset + 1 ELSE chunk_offset END AS chunk_offset), {hmac(PAYLOAD)} AS signature FROM log1)"""

#: The log with an add for each sliding window besides that of the whole text.
WINDOW_LOG = LOG.replace(
    "log AS (SELECT",
    f"""win0 AS (SELECT doc_id, t, unnest(CASE WHEN length(t) = 0 THEN [] WHEN length(t) <= {WINDOW} THEN [0] ELSE range(0, length(t) - {WINDOW} + 1, {STRIDE}) END) AS o FROM (SELECT doc_id, {norm('text')} AS t FROM documents)),
win AS (SELECT doc_id, o, length(t[(o + 1) : (o + {WINDOW})]) AS n, {fp(f't[(o + 1) : (o + {WINDOW})]')} AS part FROM win0),
log2 AS (SELECT * FROM log1 UNION ALL BY NAME SELECT l.* REPLACE (part AS fingerprint, o::INT AS chunk_offset, n::INT AS chunk_length) FROM win JOIN log1 l ON l.seq = win.doc_id WHERE part <> l.fingerprint),
log AS (SELECT""",
).replace("AS signature FROM log1)", "AS signature FROM log2)")

INDEX = (
    LOG
    + """,
stored AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY fingerprint, document_id, document_version ORDER BY seq) = 1),
state AS (SELECT document_id, arg_max(authorized, seq) AS authorized, arg_max(document_version, seq) AS current_version FROM log GROUP BY document_id),
idx AS (SELECT s.* EXCLUDE (authorized), state.authorized, state.current_version,
    EXISTS (SELECT 1 FROM log e WHERE e.document_id = s.document_id AND e.document_version <> s.document_version AND e.seq > s.seq) AS superseded
  FROM stored s JOIN state ON s.document_id = state.document_id)"""
)

BEST = INDEX + ",\nbest AS (SELECT * FROM idx QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY superseded, ingested_at DESC, document_id, document_version) = 1)"

WINDOW_BEST = BEST.replace(LOG, WINDOW_LOG).replace("ORDER BY seq) = 1", "ORDER BY seq, chunk_offset) = 1")

RETRIEVED = f"""
retrieved AS (SELECT *, {fp(norm('text'))} AS fingerprint FROM (
  SELECT 'documents-' || (doc_id // 8) AS request_id, (doc_id % 8)::INT AS chunk_index, 'documents' AS origin, doc_id AS n, lang AS residency, text FROM documents
  UNION ALL SELECT 'benchmark-' || (item_id // 8), (item_id % 8)::INT, 'benchmark', item_id, NULL, text FROM benchmark
  UNION ALL SELECT 'conversations-' || ((conv_id * 100 + turn) // 8), ((conv_id * 100 + turn) % 8)::INT, 'conversations', conv_id * 100 + turn, NULL, text FROM conversations))"""

VERIFIED = (
    BEST
    + ","
    + RETRIEVED
    + f""",
verified AS (SELECT r.request_id, r.chunk_index, r.origin, r.n, r.residency, r.fingerprint, b.document_id, b.document_version, b.ingested_at,
    CASE WHEN b.document_id IS NULL THEN 'UNVERIFIED' WHEN {hmac(PAYLOAD.replace('fingerprint', 'b.fingerprint'))} <> b.signature THEN 'TAMPERED'
      WHEN NOT b.authorized THEN 'UNAUTHORIZED' WHEN b.superseded THEN 'STALE' ELSE 'VERIFIED' END AS outcome
  FROM retrieved r LEFT JOIN best b ON r.fingerprint = b.fingerprint)"""
)

CALLS = f"""
calls AS (SELECT event_id, user_id, ts, {iso("(epoch_us(ts) // 1000)")} AS issued_at, 'prx_' || sha256('event-' || event_id)[1:32] AS receipt_id, 'user-' || user_id AS caller, event_type,
    CASE event_type WHEN 'view' THEN 'retrieval' WHEN 'click' THEN 'tool_call' WHEN 'purchase' THEN 'memory_write' WHEN 'signup' THEN 'model_inference' WHEN 'error' THEN 'memory_read' END AS step_kind,
    json_extract_string(props, '$.k')::INT AS k, floor(value)::BIGINT AS amount FROM events)"""

STEPS = (
    CALLS
    + """,
s1 AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY caller ORDER BY ts, receipt_id)) > 1800 * 1000000)::INT, 1) AS isnew FROM calls),
s2 AS (SELECT *, caller || '/' || (sum(isnew) OVER (PARTITION BY caller ORDER BY ts, receipt_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session_id FROM s1),
steps AS (SELECT *, 'trj_' || sha256(session_id)[1:32] AS trajectory_id, (row_number() OVER w - 1)::INT AS step_index, lag(receipt_id) OVER w AS parent FROM s2 WINDOW w AS (PARTITION BY session_id ORDER BY ts, receipt_id))"""
)
