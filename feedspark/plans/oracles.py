"""Independent DuckDB statements of the expected result of every query.

They state the result from the residue rules over the raw tables (and plain
SQL set logic), not by re-running the Spark operators, so a match is evidence.
"""

from __future__ import annotations

_CH = "'ch' || (day(ts) % 3)"

# Events with their channel, key-epoch ordinal and damage kind (first match wins).
_EV = f"""
ev AS (
  SELECT event_id AS seq, ts, props, {_CH} AS channel,
         strftime(ts, '%Y%m%d') AS feed_date,
         CAST(dense_rank() OVER (PARTITION BY {_CH} ORDER BY CAST(ts AS DATE)) - 1 AS INTEGER) AS ord,
         CASE WHEN event_id % 17 = 3 THEN 'dropped'
              WHEN event_id % 13 = 0 THEN 'wrong_secret'
              WHEN event_id % 11 = 0 THEN 'previous_key'
              WHEN event_id % 29 = 0 THEN 'oversize'
              WHEN event_id % 31 = 0 THEN 'empty'
              WHEN event_id % 37 = 0 THEN 'extra' END AS damage
  FROM events)"""


def _cipher(ord_: str) -> str:
    return f"rpad('k' || ({ord_}) || CASE WHEN ({ord_}) % 10 = 5 THEN '_' ELSE '' END || 'cipher', 10, '0')"


def _secret(ord_: str) -> str:
    return f"(CASE WHEN ({ord_}) % 10 = 7 THEN 'short' ELSE 'secret' END || lpad(CAST(({ord_}) AS VARCHAR), 4, '0'))"


_KEYS = f"""
k AS (
  SELECT *, {_cipher('ord')} AS cipher, {_secret('ord')} AS secret,
         CASE WHEN ord > 0 THEN {_cipher('ord - 1')} END AS prev_cipher,
         CASE WHEN ord > 0 THEN {_secret('ord - 1')} END AS prev_secret
  FROM ev)"""

_SENT = """CASE WHEN damage = 'oversize' THEN props || repeat('.', 5000)
         WHEN damage = 'empty' THEN ''
         WHEN damage = 'extra' THEN props || '^x^y' ELSE props END"""

_STATUS = """
st AS (
  SELECT *, CASE WHEN damage = 'wrong_secret' THEN 'bad_secret'
                 WHEN damage = 'previous_key' AND ord > 0 THEN
                      CASE WHEN (ord - 1) % 10 = 7 THEN 'bad_secret' ELSE 'passed_previous' END
                 WHEN ord % 10 = 7 THEN 'bad_secret'
                 WHEN damage = 'empty' THEN 'incomplete'
                 ELSE 'passed_current' END AS status
  FROM ev WHERE damage IS DISTINCT FROM 'dropped')"""

# Complete packets that reach the receiver.
_PASSED = _STATUS + """,
pr AS (SELECT channel, feed_date, seq, CASE WHEN damage = 'oversize' THEN props || repeat('.', 5000) ELSE props END AS message,
              ts AS arrival_ts, CASE WHEN damage = 'extra' THEN 2 ELSE 0 END AS extra_fields
       FROM st WHERE status IN ('passed_current', 'passed_previous'))"""

_MISSING = """
b AS (SELECT channel, feed_date, min(seq) AS lo, max(seq) AS hi FROM pr GROUP BY 1, 2),
cand AS (SELECT channel, feed_date, unnest(range(lo, hi + 1)) AS seq FROM b),
miss AS (SELECT c.channel, c.feed_date, CAST(c.seq AS BIGINT) AS seq FROM cand c
         WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.channel = c.channel AND pr.feed_date = c.feed_date
                                             AND pr.seq = c.seq))"""

_ARCHIVE = f"""
arch AS (SELECT {_CH} AS channel, strftime(ts, '%Y%m%d') AS feed_date, event_id AS seq, props AS message
         FROM events WHERE event_id % 5 <> 0)"""

_REQUESTS = """
pos AS (SELECT *, CAST((row_number() OVER (PARTITION BY channel, feed_date ORDER BY seq) - 1) // 10 AS BIGINT) AS batch_no FROM miss),
asg AS (SELECT *, min(seq) OVER w AS lo, max(seq) OVER w AS hi, CAST(count(*) OVER w AS INTEGER) AS n FROM pos
        WINDOW w AS (PARTITION BY channel, feed_date, batch_no))"""

# The first round: a request from lo fails at lo % 7 = 6.
_BATCHES = _REQUESTS + "," + _ARCHIVE + """,
rec AS (SELECT a.channel, a.feed_date, a.seq, r.message FROM asg a
        JOIN arch r ON r.channel = a.channel AND r.feed_date = a.feed_date AND r.seq = a.seq
        WHERE a.lo % 7 <> 6)"""

# Later rounds: a request fails again at lo % 49 = 48; what answered requests lacked is asked for anew.
_ROUNDS = _REQUESTS + """,
one AS (SELECT *, CASE WHEN lo % 7 <> 6 THEN 1 WHEN lo % 49 <> 48 THEN 2 ELSE 3 END AS tries FROM asg),
pos2 AS (SELECT channel, feed_date, seq, (row_number() OVER (PARTITION BY channel, feed_date ORDER BY seq) - 1) // 10 AS b
         FROM one WHERE tries = 1 AND seq % 5 = 0),
asg2 AS (SELECT channel, feed_date, seq, min(seq) OVER w AS lo, max(seq) OVER w AS hi, CAST(count(*) OVER w AS INTEGER) AS n FROM pos2
         WINDOW w AS (PARTITION BY channel, feed_date, b)),
two AS (SELECT *, CASE WHEN lo % 7 <> 6 THEN 1 WHEN lo % 49 <> 48 THEN 2 ELSE 3 END AS tries FROM asg2)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _lenient_cases() -> str:
    return """
src AS (SELECT event_id, props, to_base64(encode(props)) AS b64 FROM events),
cases AS (
  SELECT event_id, props,
    CASE event_id % 4 WHEN 0 THEN b64
                      WHEN 1 THEN rtrim(b64, '=')
                      WHEN 2 THEN b64 || chr(10) || 'junk'
                      ELSE left(rtrim(b64, '='), 4 * (length(rtrim(b64, '=')) // 4) + 1) END AS encoded,
    CASE WHEN event_id % 4 = 3 THEN left(props, 3 * (length(rtrim(b64, '=')) // 4)) ELSE props END AS expected
  FROM src)"""


_XOR = """
SELECT channel, ts AS arrival_ts,
       to_base64(encode(array_to_string(list_transform(range(length(plain)),
         lambda i: chr(xor(ascii(plain[i + 1]), ascii(xkey[(i % length(xkey)) + 1])))), ''))) AS wire
FROM p"""

_SPARSE = """
, sp AS (SELECT channel, feed_date, seq * 1000003 AS seq FROM pr
         UNION ALL SELECT channel, feed_date, max(seq) * 1000003 + 1000000000000000 FROM pr GROUP BY 1, 2),
nx AS (SELECT *, lead(seq) OVER (PARTITION BY channel, feed_date ORDER BY seq) AS nxt FROM sp)
"""

_LIVE = """
d AS (SELECT channel, feed_date, min(arrival_ts) AS first_arrival, count(*) AS packets FROM pr GROUP BY 1, 2),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY channel ORDER BY first_arrival DESC, feed_date DESC) AS INTEGER) AS arrival_rank
       FROM d),
live AS (SELECT *, arrival_rank <= 2 AS tracked FROM rk)"""

# The last document of each language, without its closing frame.
_TAIL = """
WITH d AS (SELECT doc_id, lang, hex(encode(text)) AS b, greatest(CAST(ceil(octet_length(encode(text)) / 1024.0) AS BIGINT), 1) AS nf
           FROM documents),
l AS (SELECT lang AS channel, count(*) - 1 AS complete_msgs, arg_max(nf, doc_id) AS nf, arg_max(b, doc_id) AS b,
             CAST(sum(nf) AS BIGINT) AS total FROM d GROUP BY lang)"""

_DAYS = """
d AS (SELECT DISTINCT channel, ord, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM ev)"""


# A feed with one number per date that is 1e15 too high, and an archive that knows some numbers on the way.
_JUMP = """
num AS (SELECT channel, feed_date, seq FROM pr UNION SELECT channel, feed_date, max(seq) + 1000000000000000 FROM pr GROUP BY channel, feed_date),
known AS (SELECT channel, feed_date, seq, message FROM arch
          UNION ALL SELECT channel, feed_date, seq + 100000000000000, message FROM arch WHERE seq % 3 = 0),
lost AS (SELECT channel, feed_date, seq + 1 AS lo, nxt - 1 AS hi FROM (
         SELECT *, lead(seq) OVER (PARTITION BY channel, feed_date ORDER BY seq) AS nxt FROM num) WHERE nxt - seq > 1)"""

ORACLES: dict[str, str] = {
    "wire_encode": _with(_EV, _KEYS, """
p AS (SELECT channel, ts, secret || '^' || feed_date || '^' || CAST(seq AS VARCHAR) || '^' || props AS plain, cipher AS xkey FROM k)""") + _XOR,
    "wire_damaged": _with(_EV, _KEYS, f"""
p AS (
  SELECT channel, ts,
    CASE WHEN damage = 'wrong_secret' THEN 'nosecret00'
         WHEN damage = 'previous_key' AND ord > 0 THEN prev_secret ELSE secret END
      || '^' || feed_date || '^' || CAST(seq AS VARCHAR) || '^' || {_SENT} AS plain,
    CASE WHEN damage = 'previous_key' AND ord > 0 THEN prev_cipher ELSE cipher END AS xkey
  FROM k WHERE damage IS DISTINCT FROM 'dropped')""") + _XOR,
    "b64_lenient": _with(_lenient_cases()) + """
SELECT event_id, encoded, expected AS decoded FROM cases""",
    "string_ops": """
SELECT event_id,
       props AS trimmed,
       CAST(length(props) - length(replace(props, ':', '')) AS INTEGER) AS colons,
       CAST(event_id AS BIGINT) AS atoi_value,
       CAST(0 AS BIGINT) AS atoi_bad,
       split_part(props, ':', 1) AS first_token,
       CAST(event_id AS VARCHAR) || '^' || event_type AS joined
FROM events""",
    "key_valid": """
SELECT event_id, event_type || '-' || CAST(user_id AS VARCHAR) AS key_text, true AS key_ok,
       props AS payload, false AS payload_ok
FROM events""",
    "xor_roundtrip": _with(_EV, _KEYS) + """
SELECT seq AS event_id, secret || '^' || feed_date || '^' || CAST(seq AS VARCHAR) || '^' || props AS text FROM k""",
    "decode_packets": _with(_EV, _STATUS) + f"""
SELECT channel, ts AS arrival_ts, CASE WHEN status = 'incomplete' THEN 'passed_current' ELSE status END AS status,
       CASE WHEN status IN ('passed_current', 'passed_previous', 'incomplete')
            THEN feed_date || '^' || CAST(seq AS VARCHAR) || '^' || {_SENT} END AS body
FROM st""",
    "parse_fields": _with(_EV, _PASSED) + """
SELECT channel, feed_date, seq, message, arrival_ts, CAST(extra_fields AS INTEGER) AS extra_fields FROM pr""",
    "gate_status": _with(_EV, _STATUS) + """
SELECT channel, status, count(*) AS packets, count(*) FILTER (damage = 'oversize') AS oversize FROM st GROUP BY channel, status""",
    "key_epochs": _with(_EV, _DAYS) + f"""
SELECT channel, ord AS epoch, day AS effective_from, {_cipher('ord')} AS cipher, {_secret('ord')} AS secret,
       CASE WHEN ord % 10 = 3 THEN 30 ELSE 86400 END AS refresh_s,
       CASE WHEN ord > 0 THEN {_cipher('ord - 1')} END AS prev_cipher,
       CASE WHEN ord > 0 THEN {_secret('ord - 1')} END AS prev_secret
FROM d""",
    "asof_keys": _with(_EV, _DAYS) + f"""
SELECT e.channel, e.seq, e.ts AS arrival_ts, d.ord AS epoch, {_cipher('d.ord')} AS cipher
FROM ev e ASOF JOIN d ON e.channel = d.channel AND e.ts >= d.day""",
    "asof_bad_clock": _with(_EV, _DAYS) + f"""
, last AS (SELECT channel, max(ord) AS ord FROM d GROUP BY channel)
SELECT e.channel, e.seq, CASE WHEN e.seq % 1000 = 7 THEN l.ord ELSE coalesce(d.ord, -1) END AS epoch,
       CASE WHEN e.seq % 1000 = 7 THEN {_cipher('l.ord')} WHEN d.ord IS NULL THEN 'early' ELSE {_cipher('d.ord')} END AS cipher
FROM ev e JOIN last l ON l.channel = e.channel ASOF LEFT JOIN d ON e.channel = d.channel AND e.ts >= d.day""",
    "asof_ties": _with(_EV, _DAYS) + f"""
SELECT e.channel, e.seq, 2 * d.ord + 1 AS epoch, {_cipher('d.ord')} AS cipher
FROM ev e ASOF JOIN d ON e.channel = d.channel AND e.ts >= d.day""",
    "loss_gaps": _with(_EV, _PASSED, _MISSING) + """
SELECT channel, feed_date, seq FROM miss""",
    "loss_ranges": _with(_EV, _PASSED, _MISSING) + """
, runs AS (SELECT *, seq - row_number() OVER (PARTITION BY channel, feed_date ORDER BY seq) AS grp FROM miss)
SELECT channel, feed_date, min(seq) AS lo, max(seq) AS hi, CAST(count(*) AS DECIMAL(20, 0)) AS n FROM runs
GROUP BY channel, feed_date, grp""",
    "loss_ranges_sparse": _with(_EV, _PASSED) + _SPARSE + """
SELECT channel, feed_date, seq + 1 AS lo, nxt - 1 AS hi, CAST(nxt - seq - 1 AS DECIMAL(20, 0)) AS n FROM nx WHERE nxt - seq > 1""",
    "request_counts_sparse": _with(_EV, _PASSED) + _SPARSE + """
SELECT channel, feed_date, CAST(sum(nxt - seq - 1) AS DECIMAL(20, 0)) AS lost,
       CAST((sum(nxt - seq - 1) + 9) // 10 AS DECIMAL(20, 0)) AS requests FROM nx WHERE nxt - seq > 1 GROUP BY 1, 2""",
    "sparse_ids": _with(_EV) + """
SELECT row_number() OVER (ORDER BY channel, feed_date, seq) AS id, channel, seq * 1000003 AS seq FROM ev""",
    "loss_gaps_lineitem": """
WITH pr AS (SELECT 'lineitem' AS channel, CAST(l_orderkey AS VARCHAR) AS feed_date, CAST(l_linenumber AS BIGINT) AS seq
            FROM lineitem),""" + _MISSING.strip() + """
SELECT channel, feed_date, seq FROM miss""",
    "loss_summary": """
SELECT 'lineitem' AS channel, CAST(l_orderkey AS VARCHAR) AS feed_date,
       count(*) AS received, count(DISTINCT l_linenumber) AS distinct_numbers,
       count(*) - count(DISTINCT l_linenumber) AS duplicates,
       CAST(min(l_linenumber) AS BIGINT) AS first_seq, CAST(max(l_linenumber) AS BIGINT) AS last_seq,
       CAST(max(l_linenumber) - min(l_linenumber) + 1 - count(DISTINCT l_linenumber) AS DECIMAL(20, 0)) AS lost
FROM lineitem GROUP BY l_orderkey""",
    "feed_loss_summary": _with(_EV, _PASSED) + """
SELECT channel, feed_date, count(*) AS received, count(DISTINCT seq) AS distinct_numbers,
       count(*) - count(DISTINCT seq) AS duplicates, min(seq) AS first_seq, max(seq) AS last_seq,
       CAST(max(seq) - min(seq) + 1 - count(DISTINCT seq) AS DECIMAL(20, 0)) AS lost
FROM pr GROUP BY channel, feed_date""",
    "live_dates": _with(_EV, _PASSED, _LIVE) + """
SELECT * FROM live""",
    "date_status": _with(_EV, _PASSED) + """
, x AS (SELECT channel, feed_date, seq, CASE WHEN seq % 5 = 2 THEN arrival_ts + INTERVAL 3 DAY ELSE arrival_ts END AS arrival_ts FROM pr),
f AS (SELECT channel, feed_date, min(row(arrival_ts, seq)) AS first FROM x GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY first) AS rk FROM f),
s AS (SELECT x.*, own.rk, own.first = row(x.arrival_ts, x.seq) AS opens,
             (SELECT max(o.rk) FROM r o WHERE o.channel = x.channel AND o.first <= row(x.arrival_ts, x.seq)) AS seen
      FROM x JOIN r own ON own.channel = x.channel AND own.feed_date = x.feed_date)
SELECT channel, feed_date, seq, arrival_ts, CAST(seen AS INTEGER) AS dates_seen,
       CASE WHEN opens THEN 'new' WHEN rk = seen AND seen > 1 THEN 'next' WHEN rk >= seen - 1 THEN 'current' ELSE 'late' END AS date_status
FROM s""",
    "live_dates_gaps": _with(_EV, _PASSED, _MISSING.strip(), _LIVE) + """
SELECT channel, feed_date, seq FROM miss JOIN live USING (channel, feed_date) WHERE tracked""",
    "recovery_requests": _with(_EV, _PASSED, _MISSING.strip(), _REQUESTS, """
r AS (SELECT channel, feed_date, batch_no, CAST(count(*) AS INTEGER) AS n, to_base64(encode(feed_date)) AS date_b64,
             to_base64(encode(string_agg(CAST(seq AS VARCHAR), '^' ORDER BY seq))) AS missed_b64
      FROM asg GROUP BY channel, feed_date, batch_no)""") + """
SELECT *, 'date=' || date_b64 || '&missed=' || missed_b64 AS post_body FROM r""",
    "backfill_join": _with(_EV, _PASSED, _MISSING.strip(), _ARCHIVE) + """
SELECT m.channel, m.feed_date, m.seq, a.message FROM miss m
LEFT JOIN arch a ON a.channel = m.channel AND a.feed_date = m.feed_date AND a.seq = m.seq""",
    "backfill_ranges": _with(_EV, _PASSED, _ARCHIVE, _JUMP) + """
SELECT a.channel, a.feed_date, a.seq, a.message FROM known a JOIN lost l
ON l.channel = a.channel AND l.feed_date = a.feed_date AND a.seq BETWEEN l.lo AND l.hi""",
    "still_missing_ranges": _with(_EV, _PASSED, _ARCHIVE, _JUMP) + """
, points AS (SELECT channel, feed_date, seq FROM num UNION SELECT a.channel, a.feed_date, a.seq FROM known a JOIN lost l
             ON l.channel = a.channel AND l.feed_date = a.feed_date AND a.seq BETWEEN l.lo AND l.hi),
nx AS (SELECT *, lead(seq) OVER (PARTITION BY channel, feed_date ORDER BY seq) AS nxt FROM points)
SELECT channel, feed_date, seq + 1 AS lo, nxt - 1 AS hi, CAST(nxt - seq - 1 AS DECIMAL(20, 0)) AS n FROM nx WHERE nxt - seq > 1""",
    "still_missing": _with(_EV, _PASSED, _MISSING.strip(), _BATCHES) + """
SELECT channel, feed_date, seq FROM miss m
WHERE NOT EXISTS (SELECT 1 FROM rec r WHERE r.channel = m.channel AND r.feed_date = m.feed_date AND r.seq = m.seq)""",
    "recovery_pending": _with(_EV, _PASSED, _MISSING.strip(), _ROUNDS) + """
SELECT DISTINCT channel, feed_date, lo, hi, n, CAST(2 AS INTEGER) AS attempts FROM one WHERE tries = 3
UNION ALL SELECT DISTINCT channel, feed_date, lo, hi, n, CAST(1 AS INTEGER) AS attempts FROM two WHERE tries > 1""",
    "recovery_rounds": _with(_EV, _PASSED, _MISSING.strip(), _ROUNDS) + """
, got AS (SELECT channel, feed_date, seq, tries AS attempts, tries AS round FROM one WHERE seq % 5 <> 0 OR (tries > 1 AND seq % 10 = 0)
          UNION ALL SELECT channel, feed_date, seq, tries, tries + 1 FROM two WHERE tries < 3 AND seq % 10 = 0)
SELECT g.channel, g.feed_date, g.seq, e.props AS message, CAST(g.attempts AS INTEGER) AS attempts, CAST(g.round AS INTEGER) AS round
FROM got g JOIN ev e ON e.seq = g.seq AND e.channel = g.channel AND e.feed_date = g.feed_date""",
    "recovery_parse": """
WITH body AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS b FROM conversations GROUP BY conv_id),
lines AS (SELECT conv_id, string_split(b, chr(10)) AS arr FROM body)
SELECT conv_id, CAST(i - 1 AS INTEGER) AS line_no, arr[i] AS message
FROM lines, range(1, len(arr) + 1) t(i)
WHERE NOT (i = len(arr) AND arr[i] = '')""",
    "feed_union": _with(_EV, _PASSED, _MISSING.strip(), _BATCHES) + """
SELECT channel, feed_date, seq, message, 'live' AS source FROM pr
UNION ALL SELECT channel, feed_date, seq, message, 'recovered' AS source FROM rec""",
    "feed_upper": _with(_EV, _PASSED, _MISSING.strip(), _BATCHES) + """
SELECT channel, feed_date, seq, upper(message) AS message FROM pr
UNION ALL SELECT channel, feed_date, seq, upper(message) AS message FROM rec""",
    "frame_split": """
WITH d AS (SELECT doc_id, lang, hex(encode(text)) AS b, octet_length(encode(text)) AS nb FROM documents),
f AS (SELECT doc_id, lang, b, greatest(CAST(ceil(nb / 1024.0) AS BIGINT), 1) AS nf FROM d),
o AS (SELECT *, coalesce(sum(nf) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_pos FROM f)
SELECT lang AS channel, CAST(first_pos + i AS BIGINT) AS pos,
       substr(b, CAST(i * 2048 + 1 AS BIGINT), 2048) AS mtext_hex,
       CASE WHEN i = nf - 1 THEN 1 ELSE 0 END AS full_msg
FROM o, range(0, nf) t(i)""",
    "frame_join": """
SELECT lang AS channel, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS BIGINT) AS msg_id,
       md5(text) AS md5, CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes
FROM documents""",
    "frame_split_small": """
SELECT lang AS channel, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS BIGINT) AS msg_id, md5(text) AS md5,
       greatest(CAST(ceil(octet_length(encode(text)) / 512.0) AS BIGINT), 1) AS n_frames
FROM documents""",
    "frame_pending": _TAIL + """
SELECT channel, complete_msgs, nf - 1 AS pending_frames, 1024 * (nf - 1) AS pending_bytes FROM l""",
    "stream_frames": """
WITH d AS (SELECT lang AS channel, doc_id, md5(text) AS md5, octet_length(encode(text)) AS nb FROM documents),
f AS (SELECT *, greatest(CAST(ceil(nb / 1024.0) AS BIGINT), 1) AS n_frames FROM d),
m AS (SELECT *, row_number() OVER w - 1 AS msg_id, lead(doc_id) OVER w AS nxt,
             CAST(coalesce(sum(n_frames) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_pos
      FROM f WINDOW w AS (PARTITION BY channel ORDER BY doc_id))
SELECT channel, CAST(msg_id AS BIGINT) AS msg_id, first_pos, n_frames, md5, CAST(nb AS INTEGER) AS n_bytes FROM m WHERE nxt IS NOT NULL""",
    "stream_frames_held": _TAIL + """
SELECT channel, CAST(total - nf + i AS BIGINT) AS pos, substr(b, CAST(i * 2048 + 1 AS BIGINT), 2048) AS mtext_hex
FROM l, range(0, nf - 1) t(i)""",
    "frame_tail": _TAIL + """
SELECT channel, CAST(total - nf + i AS BIGINT) AS pos, substr(b, CAST(i * 2048 + 1 AS BIGINT), 2048) AS mtext_hex
FROM l, range(0, nf - 1) t(i)""",
    "quarantine": _with(_EV, _STATUS) + f"""
SELECT ts AS arrival_ts, channel, status AS reason,
       CAST(4 * ((length(CASE WHEN damage = 'wrong_secret' THEN 'nosecret00'
                              WHEN damage = 'previous_key' AND ord > 0 THEN {_secret('ord - 1')} ELSE {_secret('ord')} END)
            + 1 + 8 + 1 + length(CAST(seq AS VARCHAR)) + 1 + length({_SENT}) + 2) // 3) AS INTEGER) AS wire_len
FROM st WHERE status NOT IN ('passed_current', 'passed_previous')""",
    "checksum_valid": """
WITH t AS (SELECT doc_id, '^000000^' || CAST(doc_id AS VARCHAR) || '^0^' || text AS tail FROM documents),
h AS (SELECT doc_id, hex(encode(tail)) AS hx FROM t)
SELECT doc_id,
       CAST(list_sum(list_transform(range(0, length(hx) // 2), lambda i: CAST(('0x' || substr(hx, 2 * i + 1, 2)) AS INTEGER))) AS BIGINT) AS checksum,
       doc_id % 7 <> 0 AS valid
FROM h""",
}

ORACLES["stream_gaps"] = ORACLES["loss_gaps"]
ORACLES["stream_gate"] = ORACLES["stream_rotation"] = ORACLES["parse_fields"]
ORACLES["stream_quarantine"] = ORACLES["quarantine"]
ORACLES["stream_evicted"] = _with(_EV, _PASSED, """
l AS (SELECT channel, feed_date, max(arrival_ts) AS latest FROM pr GROUP BY 1, 2)""") + """
SELECT channel, feed_date FROM l WHERE latest < (SELECT max(latest) FROM l) - INTERVAL 10 DAY"""

_FEED = _with(_EV, _PASSED, _MISSING.strip(), _BATCHES) + """
, f AS (SELECT channel, feed_date, seq, message, 'live' AS source FROM pr
        UNION ALL SELECT channel, feed_date, seq, message, 'recovered' AS source FROM rec),
o AS (SELECT *, row_number() OVER (ORDER BY channel, feed_date, seq) AS id FROM f)
"""
ORACLES["feed_ordered"] = _FEED + """
SELECT id - 1 AS position, channel, feed_date, seq, message, source FROM o"""
ORACLES["sink_rows"] = ORACLES["sink_preflight"] = _FEED + """
SELECT id, channel, feed_date, seq, message, source FROM o"""
ORACLES["sink_rows_twice"] = _FEED + """
SELECT row_number() OVER (ORDER BY seq % 2, channel, feed_date, seq) AS id, channel, feed_date, seq, message, source FROM f"""
ORACLES["consumer_resume"] = _FEED + """
SELECT row_number() OVER (ORDER BY seq % 3, channel, feed_date, seq) AS id, channel, feed_date, seq, message, source, seq % 3 AS got_by FROM f"""
ORACLES["stream_deliver"] = _FEED + """
SELECT channel, feed_date, seq, message, source, true AS dense FROM f"""
ORACLES["sink_reject"] = _FEED + """
SELECT id, CASE WHEN seq % 29 = 0 THEN 'no ' ELSE '' END || CAST(seq AS VARCHAR) AS seq,
       CASE WHEN seq % 23 = 0 AND seq % 29 = 0 THEN 'message is null; seq is not bigint'
            WHEN seq % 23 = 0 THEN 'message is null' WHEN seq % 29 = 0 THEN 'seq is not bigint' ELSE '' END AS reason FROM o"""
ORACLES["audit_lines"] = _with(_EV, _PASSED) + """
, g AS (SELECT channel, status, max(ts) AS ts, count(*) AS n FROM st
        WHERE status NOT IN ('passed_current', 'passed_previous') GROUP BY channel, status),
s AS (SELECT channel, feed_date, max(arrival_ts) AS ts, count(DISTINCT seq) AS dn,
             max(seq) - min(seq) + 1 - count(DISTINCT seq) AS lost FROM pr GROUP BY 1, 2),
r AS (SELECT ts, 'ERROR' AS level, 'channel ' || channel || ': ' || n || ' packets ' || status AS text FROM g
      UNION ALL
      SELECT ts, CASE WHEN lost > 0 THEN 'WARN' ELSE 'INFO' END AS level,
             'channel ' || channel || ' date ' || feed_date || ': ' || dn || ' received, ' || lost || ' lost' AS text FROM s)
SELECT ts, level, text, level || ': ' || strftime(ts, '%d/%m/%y->%I:%M:%S') || ' ' || text AS line FROM r"""

ORACLES["stream_key_epochs"] = ORACLES["key_epochs"]
ORACLES["stream_recovery"] = _with(_EV, _PASSED, _MISSING.strip(), _ARCHIVE) + """
SELECT m.channel, m.feed_date, m.seq, a.message, 'recovered' AS source FROM miss m
JOIN arch a ON a.channel = m.channel AND a.feed_date = m.feed_date AND a.seq = m.seq"""
ORACLES["feed_frames"] = _FEED + """
, hx AS (SELECT *, hex(encode(message)) AS h, greatest(CAST(ceil(octet_length(encode(message)) / 1024.0) AS BIGINT), 1) AS nf FROM f),
p AS (SELECT *, coalesce(sum(nf) OVER (PARTITION BY channel ORDER BY feed_date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_pos FROM hx)
SELECT channel, CAST(first_pos + i AS BIGINT) AS pos, substr(h, CAST(i * 2048 + 1 AS BIGINT), 2048) AS mtext_hex,
       CASE WHEN i = nf - 1 THEN 1 ELSE 0 END AS full_msg FROM p, range(0, nf) t(i)"""
ORACLES["key_health"] = _with(_EV, _DAYS) + f"""
SELECT channel, ord AS epoch, octet_length(encode({_secret('ord')})) = 10 AS secret_usable,
       regexp_full_match({_cipher('ord')}, '[A-Za-z0-9-]*') AS cipher_charset_ok,
       day + to_seconds(CASE WHEN ord % 10 = 3 THEN 30 ELSE 86400 END) AS next_refresh_due
FROM d"""
ORACLES["sink_reject_twice"] = ORACLES["sink_reject"]
ORACLES["stream_counters"] = ORACLES["gate_status"]
ORACLES["stream_recovery_rounds"] = ORACLES["recovery_rounds"]
