"""The same queries as plain SQL, written independently of the Spark plans."""

from __future__ import annotations

HOUR = 3_600_000


def _h60(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def _power(x: str) -> str:
    return f"(list_sum(list_transform({x}, lambda v: v * v)) / len({x}))"


def _peak(x: str) -> str:
    return f"list_max(list_transform({x}, lambda v: abs(v)))"


def _checksum(x: str) -> str:
    return f"list_sum(list_transform({x}, lambda v, i: v * i))"


def _fit(x: str) -> str:
    return f"CASE WHEN {_peak(x)} > 32767 THEN list_transform({x}, lambda v: v * (32767.0 / {_peak(x)})) ELSE {x} END"


def _roll(x: str, k: str, n: int) -> str:
    return f"list_concat({x}[{n} - {k} + 1:{n}], {x}[1:{n} - {k}])"


def _mixed(signal: str, noise: str, snr: str) -> str:
    scale = f"sqrt({_power(signal)} / ({_power(noise)} * pow(10.0::DOUBLE, {snr} / 10.0::DOUBLE)))"
    return f"list_transform({signal}, lambda u, i: u + {scale} * {noise}[i])"


EV = """
ev AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS start_ms,
         CASE WHEN event_type = 'purchase' THEN 'bell' ELSE 'background' END AS label,
         CASE WHEN event_type IN ('error', 'signup') THEN event_type END AS noise_pool
  FROM events)"""
NUM = EV + """,
num AS (SELECT *, value / 490.02::DOUBLE AS score,
               row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS seq FROM ev)"""
IV = EV + """,
iv AS (SELECT *, lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS end_ms FROM ev)"""
WIN = IV + f""",
win AS (SELECT event_id, user_id, label, noise_pool,
               unnest(range(start_ms, end_ms - {6 * HOUR}, {HOUR})) AS chunk_start
        FROM iv WHERE end_ms IS NOT NULL)"""
DRAWN = """
CASE WHEN want_real > have_real THEN have_real
     WHEN want_ext > have_ext THEN least(n_target - have_ext, have_real) ELSE want_real END AS n_real,
CASE WHEN want_real > have_real THEN least(n_target - have_real, have_ext)
     WHEN want_ext > have_ext THEN have_ext ELSE want_ext END AS n_external"""
BAL = WIN + f""",
digest AS (SELECT *, md5('42:' || event_id || ':' || chunk_start) AS h,
                  CASE WHEN label <> 'background' THEN 'positive' WHEN noise_pool IS NULL THEN 'real' ELSE 'external' END AS stratum
           FROM win),
have AS (SELECT count(*) FILTER (stratum = 'positive') AS n_target, count(*) FILTER (stratum = 'real') AS have_real,
                count(*) FILTER (stratum = 'external') AS have_ext FROM digest),
want AS (SELECT *, round_even(n_target * 0.5::DOUBLE, 0)::BIGINT AS want_ext,
                n_target - round_even(n_target * 0.5::DOUBLE, 0)::BIGINT AS want_real FROM have),
quota AS (SELECT {DRAWN} FROM want),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) AS rn FROM digest),
bal AS (SELECT event_id, label, noise_pool, chunk_start FROM ranked, quota
        WHERE stratum = 'positive' OR (stratum = 'real' AND rn <= n_real) OR (stratum = 'external' AND rn <= n_external))"""
SPLIT = EV + """,
per AS (SELECT user_id, label, count(*) AS n FROM ev GROUP BY ALL),
grp AS (SELECT user_id, sum(n)::BIGINT AS n, arg_max(label, (n, label)) AS cls FROM per GROUP BY user_id),
deal AS (SELECT user_id, ((row_number() OVER (ORDER BY cls, length(bin(n)), md5('42:' || user_id)) - 1) % 5)::INTEGER AS fold FROM grp),
split AS (SELECT event_id, user_id, fold, fold = 0 AS is_test FROM ev JOIN deal USING (user_id))"""


def _signals(gain: str) -> str:
    return f"""
sig AS (SELECT vec_id, label, 'vec_' || vec_id AS path, 'label_' || label AS noise_pool,
               list_transform(embedding, lambda v: v::DOUBLE * {gain}::DOUBLE) AS x FROM embeddings)"""


NOISE = """
listed AS (SELECT noise_pool, path, x, unnest(range(0, 64 - 32, 8)) AS start_sample FROM sig WHERE label > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY noise_pool
                     ORDER BY substr(md5('offset:' || path || '@0'), 1, 3), path || '@0', start_sample) - 1 AS ordinal FROM listed),
sizes AS (SELECT noise_pool, count(*) AS size FROM listed GROUP BY noise_pool)"""


def _draw(key: str) -> str:
    return f"""'label_' || (1 + {_h60(f"'42:pool:' || {key}")} % 9)"""


def _ordinal(key: str) -> str:
    return f"""{_h60(f"'42:window:' || {key}")} % size"""


def _frames(gain: str, n_fft: int, hop: int) -> str:
    """power(vec_id, k, t): squared DFT of centred Hann frames, by plain sums."""
    half = n_fft // 2
    return f"""
smp AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(list_transform(embedding, lambda v: v::DOUBLE * {gain}::DOUBLE)) AS x FROM embeddings),
tap AS (SELECT j.range AS j, k.range AS k,
               (0.5 - 0.5 * cos(2 * pi() * j.range / {n_fft})) * cos(2 * pi() * j.range * k.range / {n_fft}) AS re,
               (0.5 - 0.5 * cos(2 * pi() * j.range / {n_fft})) * sin(2 * pi() * j.range * k.range / {n_fft}) AS im
        FROM range(0, {n_fft}) j, range(0, {half + 1}) k),
fr AS (SELECT vec_id, t.range AS t, smp.i + {half} - t.range * {hop} AS j, x FROM smp, range(0, {64 // hop + 1}) t
       WHERE smp.i + {half} - t.range * {hop} BETWEEN 0 AND {n_fft - 1}),
power AS (SELECT vec_id, k, t, pow(sum(x * re), 2) + pow(sum(x * im), 2) AS p FROM fr JOIN tap USING (j) GROUP BY vec_id, k, t)"""


def _mfcc(n_mfcc: int, hop: int, n_mels: int = 8, n_fft: int = 32) -> str:
    return _frames("20000", n_fft, hop) + f""",
edge AS (SELECT i.range AS i, i.range * (15 + ln(8.0::DOUBLE) / (ln(6.4::DOUBLE) / 27)) / {n_mels + 1} AS m FROM range(0, {n_mels + 2}) i),
hz AS (SELECT i, CASE WHEN m < 15 THEN m * 200.0::DOUBLE / 3 ELSE 1000 * exp(ln(6.4::DOUBLE) / 27 * (m - 15)) END AS f FROM edge),
mel AS (SELECT a.i AS b, k.range AS k,
               greatest(0, least((k.range * 8000.0::DOUBLE / {n_fft // 2} - a.f) / (b.f - a.f), (c.f - k.range * 8000.0::DOUBLE / {n_fft // 2}) / (c.f - b.f)))
                 * 2 / (c.f - a.f) AS w
        FROM hz a JOIN hz b ON b.i = a.i + 1 JOIN hz c ON c.i = a.i + 2, range(0, {n_fft // 2 + 1}) k),
db AS (SELECT vec_id, b, t, 10 * log10(greatest(sum(p * w), 1e-10::DOUBLE)) AS v FROM power JOIN mel USING (k) GROUP BY vec_id, b, t),
clipped AS (SELECT vec_id, b, t, greatest(v, max(v) OVER (PARTITION BY vec_id) - 80) AS v FROM db),
mfcc AS (SELECT vec_id, c.range AS row_no, t AS frame_no,
                sum(v * cos(pi() * c.range * (2 * b + 1) / {2 * n_mels})) * sqrt(2.0::DOUBLE / {n_mels}) * CASE WHEN c.range = 0 THEN sqrt(0.5::DOUBLE) ELSE 1 END AS v
         FROM clipped, range(0, {n_mfcc}) c GROUP BY vec_id, c.range, t)"""


_SEG = "list_filter(string_split(path, '/'), lambda s: s <> '' AND s <> '.')"

ORACLE: dict[str, str] = {
    "balanced_windows": f"WITH {BAL} SELECT label, noise_pool, count(*) AS n_windows, sum(chunk_start)::BIGINT AS sum_start FROM bal GROUP BY label, noise_pool",
    "normalize_uri": f"""
WITH pg AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)([^?#]*)', 2) AS path,
                   string_split(regexp_extract(url, '^https?://([^/?#]*)', 1), '.') AS host FROM pages),
seg AS (SELECT *, {_SEG} AS s FROM pg),
named AS (SELECT *, array_to_string(s, '/') AS whole, array_to_string(s[2:], '/') AS rest,
                 CASE WHEN len(s) > 0 THEN 's3://media' || path END AS raw FROM seg),
shaped AS (
  SELECT page_id, 'plain' AS shape, CASE WHEN len(host) > 2 AND host[2] LIKE 's3%' THEN NULL WHEN rest <> '' THEN 's3://' || s[1] || '/' || rest END AS uri, s[-1] AS last FROM named
  UNION ALL SELECT page_id, 'presigned', CASE WHEN whole <> '' THEN 's3://media/' || whole END, s[-1] FROM named
  UNION ALL SELECT page_id, 'virtual', CASE WHEN whole <> '' THEN 's3://media/' || whole END, s[-1] FROM named
  UNION ALL SELECT page_id, 's3', raw, s[-1] FROM named
  UNION ALL SELECT page_id, 'resolver', raw, s[-1] FROM named
  UNION ALL SELECT page_id, 'encoded', CASE WHEN NOT contains(base64(encode('s3://media' || path)), '+') THEN raw END, s[-1] FROM named
  UNION ALL SELECT page_id, 'foreign', NULL, NULL FROM named)
SELECT page_id, shape, uri, CASE WHEN uri IS NOT NULL THEN last END AS file_name,
       CASE WHEN uri IS NOT NULL THEN regexp_extract(uri, '^s3://([^/]+)/', 1) END AS bucket,
       CASE WHEN uri IS NOT NULL THEN regexp_extract(uri, '^s3://[^/]+/+(.*)$', 1) END AS key FROM shaped""",
    "explode_annotations": f"""
WITH {EV}, item AS (SELECT *, unnest(range(0, event_id % 3 + 1)) AS interval_no FROM ev WHERE event_type NOT IN ('view', 'signup')),
lab AS (SELECT *, unnest(CASE WHEN event_id % 2 = 0 THEN [0, 1] ELSE [0] END) AS label_no FROM item),
rows AS (
  SELECT event_id, user_id, interval_no * 2 + 0.25::DOUBLE AS s, interval_no * 2 + 0.25::DOUBLE + value AS e,
         CASE WHEN label_no = 0 THEN event_type ELSE 'extra' END AS l, interval_no, label_no FROM lab
  UNION ALL SELECT event_id, user_id, 0.0, NULL, 'background', 0, 0 FROM ev WHERE event_type = 'view')
SELECT event_id::VARCHAR AS annotation_id, user_id::VARCHAR AS file_id, s AS start, e AS "end", l AS label,
       'ev_' || event_id || '.wav' AS audio_file_name, 's3://rec/user_' || user_id || '/ev_' || event_id || '.wav' AS remote_audio_path,
       interval_no::INTEGER AS interval_no, label_no::INTEGER AS label_no FROM rows""",
    "default_annotation": """
SELECT doc_id, source, 0.0::DOUBLE AS start, 7.0::DOUBLE AS "end", 0 AS channel, 'background' AS label
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "fill_and_group": f"""
WITH {EV}, dur AS (SELECT user_id, max(start_ms) / 1000.0::DOUBLE AS d FROM ev GROUP BY user_id)
SELECT event_id::VARCHAR AS annotation_id, event_type, CASE WHEN event_type = 'error' THEN 'ext' END AS noise_pool,
       CASE WHEN event_type = 'signup' THEN 'src_' || event_id ELSE 'rec_' || user_id END AS split_group, d AS audio_file_duration,
       trunc(start_ms / 1000.0::DOUBLE * 1000)::BIGINT AS start_ms,
       trunc(CASE WHEN event_id % 2 = 0 THEN start_ms / 1000.0::DOUBLE + value ELSE d END * 1000)::BIGINT AS end_ms
FROM ev JOIN dur USING (user_id)""",
    "slide_windows": f"WITH {WIN} SELECT event_id, label, noise_pool, chunk_start, chunk_start + {6 * HOUR} AS chunk_end FROM win",
    "count_per_label": f"WITH {WIN} SELECT label, count(*) AS n FROM win WHERE label IS NOT NULL GROUP BY label ORDER BY label",
    "label_distribution": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type",
    "positive_total": f"WITH {WIN} SELECT count(*) AS n_positive FROM win WHERE label <> 'background'",
    "quality_metrics": f"""
WITH {WIN}, r AS (SELECT CASE WHEN noise_pool = 'signup' THEN NULL ELSE user_id END AS file_id,
                         CASE WHEN noise_pool = 'error' THEN NULL ELSE label END AS label FROM win),
c AS (SELECT label, count(*) AS n FROM r WHERE label IS NOT NULL GROUP BY label)
SELECT count(*) AS total_samples, count(DISTINCT file_id) + max(CASE WHEN file_id IS NULL THEN 1 ELSE 0 END) AS total_files,
       count(DISTINCT label) + max(CASE WHEN label IS NULL THEN 1 ELSE 0 END) AS total_labels,
       round((SELECT max(n)::DOUBLE / min(n) FROM c), 9) AS imbalance_ratio FROM r""",
    "sync_plan": """
WITH want AS (SELECT 'order_' || l_orderkey AS n, min('s3://raw/' || l_suppkey || '/' || l_orderkey) AS p FROM lineitem GROUP BY 1),
have AS (SELECT DISTINCT 'order_' || (o_orderkey * 2) AS n FROM orders)
SELECT coalesce(want.n, have.n) AS audio_file_name, p AS remote_audio_path,
       CASE WHEN have.n IS NULL THEN 'fetch' WHEN want.n IS NULL THEN 'prune' ELSE 'keep' END AS action
FROM want FULL OUTER JOIN have ON want.n = have.n""",
    "name_difference": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "distinct_first": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) = 1""",
    "exclude_values": "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'signup')",
    "resolve_first": """
WITH names AS (SELECT DISTINCT l_partkey AS k FROM lineitem),
src AS (SELECT s_suppkey AS k, 'recordings' AS source, 0 AS pr FROM supplier UNION ALL SELECT c_custkey, 'augmented', 1 FROM customer
        UNION ALL SELECT p_partkey, 'pools', 2 FROM part)
SELECT 'f' || k || '.wav' AS name, source || '/f' || k || '.wav' AS path, source FROM names JOIN src USING (k)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY pr) = 1""",
    "sample_n": "SELECT event_id, user_id, value FROM events QUALIFY row_number() OVER (ORDER BY md5('42:' || event_id)) <= 500",
    "split_draw": f"""
WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') * 3 AS n_target, count(*) FILTER (event_type = 'click') AS have_real,
                  count(*) FILTER (event_type IN ('error', 'signup')) AS have_ext FROM events GROUP BY user_id),
want AS (SELECT *, round_even(n_target * ((user_id % 5) / 4.0::DOUBLE), 0)::BIGINT AS want_ext FROM c),
both_sides AS (SELECT *, n_target - want_ext AS want_real FROM want)
SELECT user_id, n_target, have_real, have_ext AS have_external, {DRAWN} FROM both_sides""",
    "balance": f"WITH {BAL} SELECT event_id, label, noise_pool, chunk_start FROM bal",
    "background_shortfall": f"""
WITH {WIN}, c AS (SELECT count(*) FILTER (label <> 'background') * 5 AS n_target, count(*) FILTER (label = 'background') AS n_background FROM win)
SELECT n_target, n_background, greatest(n_target - n_background, 0) AS n_missing FROM c""",
    "shuffle_rank": "SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey)) AS shuffle_rank FROM orders",
    "group_split": f"WITH {SPLIT} SELECT event_id, user_id, fold, is_test FROM split",
    "leakage_check": f"WITH {SPLIT} SELECT user_id FROM split GROUP BY user_id HAVING count(DISTINCT is_test) > 1",
    "split_shape": f"""
WITH {SPLIT} SELECT count(*) AS n_chunks, 2 AS n_features, round(avg(is_test::INTEGER), 4) AS realized_test_fraction FROM split""",
    "sample_power": f"""
WITH {_signals('1')} SELECT vec_id, round({_power('x')}, 6) AS power, round(sqrt({_power('x')}), 6) AS rms, round({_peak('x')}, 6) AS peak,
  round(list_sum(list_transform(x, lambda v, i: CASE WHEN i > 1 AND (v < 0) <> (x[i - 1] < 0) THEN 1.0::DOUBLE ELSE 0 END)) / 64, 6) AS zcr FROM sig""",
    "circular_shift": f"""
WITH {_signals('1')}, k AS (SELECT *, {_h60("'42:shift:' || vec_id")} % 64 AS shift FROM sig)
SELECT vec_id, shift, round({_checksum('(' + _roll('x', 'shift', 64) + ')')}, 6) AS checksum FROM k""",
    "mix_at_snr": f"""
WITH {_signals('20000')},
v AS (SELECT a.vec_id, a.x AS s, b.x AS n, snr_db, pair_no FROM sig a JOIN sig b ON b.vec_id = CASE WHEN a.vec_id = (SELECT max(vec_id) FROM embeddings) THEN (SELECT min(vec_id) FROM embeddings) ELSE a.vec_id + 1 END,
      (SELECT unnest([-5, 0, 5, 10, 15]) AS snr_db), (SELECT unnest([0, 1]) AS pair_no)),
k AS (SELECT *, {_h60("'42:' || vec_id || ':' || snr_db || ':' || pair_no")} % 64 AS shift FROM v),
r AS (SELECT vec_id, snr_db, pair_no, s, {_roll('n', 'shift', 64)} AS n FROM k),
m AS (SELECT vec_id, snr_db, pair_no, {_mixed('s', 'n', 'snr_db')} AS y FROM r),
f AS (SELECT vec_id, snr_db, pair_no, {_fit('y')} AS y FROM m)
SELECT vec_id, snr_db, pair_no, round({_peak('y')}, 3) AS peak, round({_checksum('y')}, 2) AS checksum FROM f""",
    "gain_jitter": f"""
WITH {_signals('20000')}, g AS (SELECT *, -6.0::DOUBLE + 12.0::DOUBLE * ({_h60("'42:gain:' || vec_id")}::DOUBLE / 1152921504606846976) AS gain_db FROM sig),
y AS (SELECT vec_id, gain_db, list_transform(x, lambda v: v * pow(10.0::DOUBLE, gain_db / 20.0::DOUBLE)) AS y FROM g),
f AS (SELECT vec_id, gain_db, {_fit('y')} AS y FROM y)
SELECT vec_id, round(gain_db, 6) AS gain_db, round({_peak('y')}, 3) AS peak, round({_checksum('y')}, 2) AS checksum FROM f""",
    "index_windows": """
WITH w AS (SELECT vec_id, unnest(range(vec_id % 5, CASE WHEN vec_id % 4 = 0 THEN 90 ELSE 64 - vec_id % 3 END - 32, 4)) AS s FROM embeddings)
SELECT vec_id, s AS chunk_start, s AS start_sample, 32::BIGINT AS length FROM w WHERE s + 32 <= 64""",
    "index_pool": """
SELECT vec_id, 'label_' || label AS noise_pool, unnest(range(0, 64 - 32, 8)) AS start_sample, 32::BIGINT AS length FROM embeddings""",
    "extract_windows": f"""
WITH {_signals('1')},
w AS (SELECT vec_id, x, unnest(range(vec_id % 5, CASE WHEN vec_id % 4 = 0 THEN 90 ELSE 64 - vec_id % 3 END - 32, 4)) AS s FROM sig),
c AS (SELECT vec_id, s, x[s + 1:s + 32] AS y FROM w WHERE s + 32 <= 64)
SELECT vec_id, s AS start_sample, len(y)::INTEGER AS n, round({_checksum('y')}, 6) AS checksum FROM c""",
    "pool_rows": """
SELECT 'noise_label_' || label || '_vec_' || vec_id AS annotation_id, 'noise_label_' || label || '_vec_' || vec_id AS file_id, 0.0::DOUBLE AS start,
       NULL::DOUBLE AS "end", 'background' AS label, 'vec_' || vec_id AS audio_file_name, '' AS remote_audio_path, 'label_' || label AS noise_pool FROM embeddings""",
    "draw_noise": f"""
WITH {_signals('20000')}, {NOISE}, req AS (SELECT vec_id, {_draw('vec_id')} AS noise_pool FROM sig),
o AS (SELECT vec_id, noise_pool, {_ordinal('vec_id')} AS ordinal FROM req JOIN sizes USING (noise_pool))
SELECT vec_id, noise_pool, path, start_sample FROM o JOIN placed USING (noise_pool, ordinal)""",
    "augment": f"""
WITH {_signals('20000')}, {NOISE},
v AS (SELECT path AS split_group, x[o + 1:o + 32] AS s, snr_db, 'aug_snr' || snr_db || '_' || vec_id || '_' || o || '_' || pair_no AS id
      FROM sig, (SELECT unnest(range(0, 32, 8)) AS o), (SELECT unnest([-5, 0, 5, 10, 15]) AS snr_db), (SELECT unnest([0, 1]) AS pair_no) WHERE label = 0),
d AS (SELECT *, {_draw('id')} AS noise_pool, {_h60("'42:shift:' || id")} % 32 AS shift,
             -6.0::DOUBLE + 12.0::DOUBLE * ({_h60("'42:gain:' || id")}::DOUBLE / 1152921504606846976) AS gain FROM v),
o AS (SELECT *, {_ordinal('id')} AS ordinal FROM d JOIN sizes USING (noise_pool)),
w AS (SELECT o.*, p.x[p.start_sample + 1:p.start_sample + 32] AS raw FROM o JOIN placed p USING (noise_pool, ordinal)),
r AS (SELECT *, {_roll('raw', 'shift', 32)} AS n FROM w),
m AS (SELECT *, {_mixed('s', 'n', 'snr_db')} AS a FROM r),
f AS (SELECT *, {_fit('a')} AS b FROM m),
g AS (SELECT *, list_transform(b, lambda v: v * pow(10.0::DOUBLE, gain / 20.0::DOUBLE)) AS e FROM f),
z AS (SELECT *, {_fit('e')} AS y FROM g)
SELECT id AS annotation_id, 0.0::DOUBLE AS start, 0.033::DOUBLE AS "end", 'bell' AS label, id || '.wav' AS audio_file_name, snr_db, noise_pool, split_group,
       round({_peak('y')}, 2) AS peak, round({_checksum('y')}, 1) AS checksum FROM z""",
    "pcm_roundtrip": f"""
WITH {_signals('200000')}, y AS (SELECT vec_id, list_transform(x, lambda v: trunc(greatest(least(v, 32767.0::DOUBLE), -32768.0::DOUBLE))::BIGINT) AS y FROM sig)
SELECT vec_id, list_sum(y)::BIGINT AS total, list_min(y)::INTEGER AS low, list_max(y)::INTEGER AS high, len(y)::INTEGER AS n FROM y""",
    "wav_headers": """
SELECT 'vec_' || vec_id AS path, 16000 AS rate, 1 AS channels, len(embedding)::BIGINT AS frames, len(embedding) / 16000.0::DOUBLE AS duration_s FROM embeddings""",
    "decode_audio": f"""
WITH {_signals('20000')}, y AS (SELECT path, list_transform(x, lambda v: trunc(greatest(least(v, 32767.0::DOUBLE), -32768.0::DOUBLE))) AS y FROM sig)
SELECT path, 16000 AS rate, len(y)::BIGINT AS frames, {_checksum('y')} AS checksum FROM y""",
    "resample": """
WITH i0 AS (SELECT n.range AS n, (SELECT sum(pow(pow(2.5::DOUBLE * sqrt(1 - pow(n.range / 30.0::DOUBLE, 2)), q.range) / gamma(q.range + 1.0::DOUBLE), 2)) FROM range(0, 30) q) AS w
            FROM range(-30, 31) n),
raw AS (SELECT n, w * CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE sin(pi() * n / 3) / (pi() * n / 3) END AS h FROM i0),
tap AS (SELECT n, 2 * h / sum(h) OVER () AS h FROM raw),
smp AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
y AS (SELECT vec_id, m.range AS m, sum(x * h) AS y FROM smp, range(0, 43) m, tap WHERE tap.n = m.range * 3 - smp.i * 2 GROUP BY vec_id, m.range)
SELECT vec_id, 16000 AS rate, 43::BIGINT AS frames, round(sum(y * (m + 1)), 5) AS checksum FROM y GROUP BY vec_id""",
    "room_response": f"""
WITH {_signals('20000')},
y AS (SELECT vec_id, list_transform(x, lambda v, i: v + CASE WHEN i > 1 THEN 0.5::DOUBLE * x[i - 1] ELSE 0 END
        + CASE WHEN i > 2 THEN 0.25::DOUBLE * x[i - 2] ELSE 0 END + CASE WHEN i > 3 THEN 0.125::DOUBLE * x[i - 3] ELSE 0 END) AS y FROM sig),
f AS (SELECT vec_id, {_fit('y')} AS y FROM y)
SELECT vec_id, round({_peak('y')}, 2) AS peak, round({_checksum('y')}, 1) AS checksum FROM f""",
    "power_spectrum": f"""
WITH {_frames('1', 32, 8)} SELECT vec_id, k::INTEGER AS row_no, t::INTEGER AS frame_no, round(p, 6) AS power FROM power""",
    "mfcc": f"WITH {_mfcc(5, 8)} SELECT vec_id, row_no::INTEGER AS row_no, frame_no::INTEGER AS frame_no, round(v, 5) AS value FROM mfcc",
    "mfcc_deltas": f"""
WITH {_mfcc(2, 4)},
around AS (SELECT a.vec_id, a.row_no, a.frame_no, b.v, b.frame_no - least(greatest(a.frame_no, 4), 12) AS o
           FROM mfcc a JOIN mfcc b ON a.vec_id = b.vec_id AND a.row_no = b.row_no AND b.frame_no BETWEEN least(greatest(a.frame_no, 4), 12) - 4 AND least(greatest(a.frame_no, 4), 12) + 4),
d AS (SELECT vec_id, row_no, frame_no, sum(o * v) / 60 AS d1, 2 * sum((o * o - 20.0::DOUBLE / 3) * v) / sum(pow(o * o - 20.0::DOUBLE / 3, 2)) AS d2
      FROM around GROUP BY ALL),
u AS (SELECT vec_id, row_no, frame_no, v FROM mfcc UNION ALL SELECT vec_id, row_no + 2, frame_no, d1 FROM d
      UNION ALL SELECT vec_id, row_no + 4, frame_no, d2 FROM d)
SELECT vec_id, row_no::INTEGER AS row_no, frame_no::INTEGER AS frame_no, round(v, 5) AS value FROM u""",
    "spectral_features": f"""
WITH {_frames('20000', 32, 8)},
mag AS (SELECT vec_id, t, k, sqrt(p) AS a, k * 500.0::DOUBLE AS f FROM power),
cen AS (SELECT vec_id, t, sum(a) AS total, sum(a * f) / sum(a) AS c FROM mag GROUP BY vec_id, t),
bw AS (SELECT vec_id, t, sqrt(sum(a / total * pow(f - c, 2))) AS b FROM mag JOIN cen USING (vec_id, t) GROUP BY vec_id, t),
cum AS (SELECT vec_id, t, f, sum(a) OVER (PARTITION BY vec_id, t ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM mag),
ro AS (SELECT vec_id, t, min(f) AS r FROM cum JOIN cen USING (vec_id, t) WHERE upto >= 0.85::DOUBLE * total GROUP BY vec_id, t),
u AS (SELECT vec_id, 0 AS row_no, t, c AS v FROM cen UNION ALL SELECT vec_id, 1, t, b FROM bw UNION ALL SELECT vec_id, 2, t, r FROM ro)
SELECT vec_id, row_no, t::INTEGER AS frame_no, round(v, 4) AS value FROM u""",
    "attach_features": f"""
WITH {_frames('1', 32, 2)}, w AS (SELECT unnest([0, 8, 16, 24]) AS chunk_start)
SELECT vec_id, chunk_start::BIGINT AS chunk_start, count(*)::INTEGER AS n_features,
       round(sum(p * (k * 16 + (t - chunk_start // 2) + 1)), 3) AS checksum
FROM power, w WHERE t >= chunk_start // 2 AND t < chunk_start // 2 + 16 GROUP BY vec_id, chunk_start""",
    "energetic_window": f"""
WITH {NUM}, sq AS (SELECT *, (value * value)::DECIMAL(28, 6) AS square FROM num),
e AS (SELECT user_id, seq, CASE WHEN count(*) OVER w = 8 THEN sum(square) OVER w END AS energy,
             count(*) OVER (PARTITION BY user_id) AS len, sum(square) OVER (PARTITION BY user_id) AS total
      FROM sq WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
best AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY energy DESC NULLS LAST, seq) = 1)
SELECT user_id, CASE WHEN len <= 8 THEN 0 ELSE seq - 1 END AS start, CASE WHEN len <= 8 THEN len ELSE seq + 7 END AS stop,
       round((CASE WHEN len <= 8 THEN total ELSE energy END)::DOUBLE, 4) AS energy FROM best""",
}


def _aligned(users: str) -> str:
    return NUM + f""",
tpl AS (SELECT user_id AS template, list(value ORDER BY seq) AS t FROM num WHERE user_id IN ({users}) AND seq <= 8 GROUP BY user_id),
al AS (SELECT user_id, seq, list(value) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS y FROM num),
sc AS (SELECT user_id, template, CASE WHEN len(y) < 8 THEN 0 ELSE
         abs(list_sum(list_transform(y, lambda v, i: v * t[i])))
         / sqrt(list_sum(list_transform(y, lambda v: v * v)) * list_sum(list_transform(t, lambda v: v * v))) END AS s, len(y) AS n FROM al, tpl)"""


CAND = NUM + ", cand AS (SELECT * FROM num WHERE score >= 0.2::DOUBLE)"
ACCEPTED = CAND + f""",
acc AS (SELECT user_id, min(start_ms) AS t FROM cand GROUP BY user_id
        UNION ALL
        SELECT c.user_id, min(c.start_ms) AS t FROM acc a JOIN cand c ON c.user_id = a.user_id AND c.start_ms >= a.t + {240 * HOUR} GROUP BY c.user_id),
det AS (SELECT min(event_id) AS event_id, c.user_id, c.start_ms, min(seq) AS seq FROM acc a JOIN cand c ON c.user_id = a.user_id AND c.start_ms = a.t GROUP BY c.user_id, c.start_ms)"""
CLIPS = ACCEPTED + """,
clip AS (SELECT d.user_id, d.seq AS trigger_seq, n.seq, n.event_id, n.value FROM det d JOIN num n ON n.user_id = d.user_id AND n.seq BETWEEN d.seq - 5 AND d.seq + 12)"""
REPORT = """
c AS (SELECT unnest([0, 1]) AS class),
s AS (SELECT class, count(*) FILTER (quality = class) AS support, count(*) FILTER (toxic = class) AS p,
             count(*) FILTER (quality = class AND toxic = class) AS h FROM labels, c GROUP BY class),
pr AS (SELECT class, CASE WHEN p = 0 THEN 0 ELSE h::DOUBLE / p END AS precision, CASE WHEN support = 0 THEN 0 ELSE h::DOUBLE / support END AS recall, support FROM s),
rep AS (SELECT class, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, support FROM pr)"""

ORACLE |= {
    "ncc_score": f"WITH {_aligned('0')} SELECT user_id, round(max(s), 9) AS score FROM sc GROUP BY user_id",
    "multi_template": f"""
WITH {_aligned('0, 1, 2')}, b AS (SELECT user_id, template, max(round(s, 9)) AS score FROM sc WHERE n = 8 GROUP BY user_id, template)
SELECT user_id, score, template::INTEGER AS template FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, template) = 1""",
    "energy_score": f"""
WITH {NUM} SELECT event_id, count(*) OVER w::INTEGER AS n_context, round(sqrt(avg(value * value) OVER w), 6) AS score FROM num
WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""".replace("count(*) OVER w::INTEGER", "(count(*) OVER w)::INTEGER"),
    "cooldown_detections": f"WITH RECURSIVE {ACCEPTED} SELECT event_id, user_id, start_ms FROM det",
    "clip_context": f"WITH RECURSIVE {CLIPS} SELECT user_id, trigger_seq, seq, event_id FROM clip",
    "clip_assembly": f"""
WITH RECURSIVE {CLIPS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, trigger_seq ORDER BY seq) AS i FROM clip)
SELECT user_id, trigger_seq, count(*) FILTER (seq <= trigger_seq) AS n_pre, count(*) FILTER (seq > trigger_seq) AS n_post,
       round(sum(value * i), 4) AS checksum FROM o GROUP BY user_id, trigger_seq""",
    "throttle_warmup": f"""
WITH {EV}, s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM ev),
p AS (SELECT event_id, user_id, session, row_number() OVER (PARTITION BY user_id, session ORDER BY start_ms, event_id) AS position FROM s)
SELECT * FROM p WHERE position > 3 AND (position - 3) % 2 = 0""".replace("ROWS UNBOUNDED PRECEDING)::BIGINT", "ROWS UNBOUNDED PRECEDING)").replace("event_id, user_id, session, row", "event_id, user_id, session::BIGINT AS session, row"),
    "k_of_n_vote": f"""
WITH {NUM}, v AS (SELECT user_id || '@' || (start_ms // {24 * HOUR}) AS clip, count(*) FILTER (score > 0.1::DOUBLE) AS n_positive, count(*) AS n_chunks FROM num GROUP BY 1)
SELECT clip, n_positive, n_chunks, n_positive >= 2 AS detected FROM v""",
    "stale_devices": f"""
WITH {EV}, l AS (SELECT user_id, max(start_ms) AS last_seen FROM ev GROUP BY user_id), a AS (SELECT *, (SELECT max(start_ms) FROM ev) - last_seen AS age_ms FROM l)
SELECT user_id, last_seen, age_ms FROM a WHERE age_ms > {12 * HOUR}""",
    "uncertain_rows": f"WITH {NUM} SELECT event_id, round(score, 9) AS score FROM num WHERE score > 0.4::DOUBLE AND score < 0.6::DOUBLE",
    "class_report": f"WITH {REPORT} SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM rep",
    "weighted_report": f"""
WITH {REPORT} SELECT round(sum(precision * support) / sum(support), 9) AS precision, round(sum(recall * support) / sum(support), 9) AS recall,
       round(sum(f1 * support) / sum(support), 9) AS f1, sum(support)::BIGINT AS support FROM rep""",
    "confusion_matrix": "SELECT quality, count(*) FILTER (toxic = 0) AS pred_0, count(*) FILTER (toxic = 1) AS pred_1 FROM labels GROUP BY quality",
    "fingerprint": """
WITH h AS (SELECT md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) AS h FROM orders)
SELECT count(*) AS n_rows, sum(CAST('0x' || substr(h, 1, 8) AS BIGINT))::BIGINT AS digest_0, sum(CAST('0x' || substr(h, 9, 8) AS BIGINT))::BIGINT AS digest_1,
       sum(CAST('0x' || substr(h, 17, 8) AS BIGINT))::BIGINT AS digest_2, sum(CAST('0x' || substr(h, 25, 8) AS BIGINT))::BIGINT AS digest_3 FROM h""",
}

_STAMPED = "st AS (SELECT *, epoch_us(ts) AS us FROM events)"


def _windows(size: int, slide: int) -> str:
    return f"""
WITH {_STAMPED}, w AS (SELECT event_type, (us // 1000 // {slide} - o.range) * {slide} AS s, us FROM st, range(0, {size // slide}) o),
g AS (SELECT event_type, s AS window_start, s + {size} AS window_end, count(*) AS n FROM w GROUP BY event_type, s)
SELECT * FROM g"""


ORACLE |= {
    "stream_triggers": "SELECT event_id, user_id FROM events WHERE event_type = 'error'",
    "stream_cooldown": ORACLE["cooldown_detections"],
    "stream_throttle": ORACLE["throttle_warmup"],
    "stream_tumbling": _windows(6 * HOUR, 6 * HOUR),
    "stream_sliding": _windows(24 * HOUR, 6 * HOUR),
    "stream_sessions": f"""
WITH {_STAMPED}, b AS (SELECT *, CASE WHEN us - lag(us) OVER w >= {12 * HOUR * 1000} THEN 1 ELSE 0 END AS fresh FROM st WINDOW w AS (PARTITION BY user_id ORDER BY us)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS no FROM b),
g AS (SELECT user_id, min(us) AS s, max(us) + {12 * HOUR * 1000} AS e, count(*) AS n FROM n GROUP BY user_id, no)
SELECT user_id, s // 1000 AS session_start, e // 1000 AS session_end, n FROM g""",
    "stream_dedup": "SELECT event_id, user_id FROM events",
    "stream_rechunk": f"""
WITH {_STAMPED}, r AS (SELECT user_id, us // 1000 // {24 * HOUR} * {24 * HOUR} AS ts, value, row_number() OVER (PARTITION BY user_id, us // 1000 // {24 * HOUR} ORDER BY us, value) AS i FROM st)
SELECT user_id, ts, count(*)::INTEGER AS n, round(sum(value * i), 4) AS checksum FROM r GROUP BY user_id, ts""",
    "stream_clip_join": f"""
WITH {_STAMPED} SELECT a.user_id, a.event_id AS trigger_id, b.event_id FROM st a JOIN st b ON a.user_id = b.user_id
  AND b.us BETWEEN a.us - {12 * HOUR * 1000} AND a.us + {24 * HOUR * 1000} WHERE a.event_type = 'purchase' AND a.value >= 100""",
    "stream_silent": f"""
WITH beats AS (SELECT user_id::BIGINT AS user_id, epoch_us(ts) // 1000 AS t FROM events WHERE user_id IS NOT NULL),
gaps AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS gap FROM beats)
SELECT user_id, t AS last_seen, t + {60 * HOUR} AS silent_at FROM gaps WHERE gap IS NULL OR gap > {60 * HOUR}""",
    "stream_last_seen": "SELECT user_id, epoch_us(max(ts)) // 1000 AS last_seen FROM events GROUP BY user_id",
}

ORACLE |= {
    "training_rows": """
WITH e AS (SELECT vec_id, vec_id % 50 AS recording, label < 5 AS cls, embedding FROM embeddings),
per AS (SELECT recording, cls, count(*) AS n FROM e GROUP BY ALL),
grp AS (SELECT recording, sum(n)::BIGINT AS n, arg_max(cls, (n, cls)) AS cls FROM per GROUP BY recording),
deal AS (SELECT recording, (row_number() OVER (ORDER BY cls, length(bin(n)), md5('42:' || recording)) - 1) % 5 AS fold FROM grp)
SELECT vec_id, fold = 0 AS is_test, CASE WHEN cls THEN 'background' ELSE 'bell' END AS label, CASE WHEN cls THEN 0 ELSE 1 END AS target,
       len(embedding)::INTEGER AS n_features, round(list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * i)), 5) AS checksum
FROM (SELECT e.vec_id, e.recording, e.cls, e.embedding FROM e) JOIN (SELECT recording, fold FROM deal) USING (recording)""",
}

# The detector row by row: one recursion step per chunk number, all users at once.
ORACLE["stream_detect"] = f"""
WITH RECURSIVE {EV},
cum AS (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id
          ORDER BY start_ms, (event_type = 'error') DESC, event_id ROWS UNBOUNDED PRECEDING) AS errors FROM ev),
ch AS (SELECT user_id, event_id AS seq, start_ms AS ms, value / 490.02::DOUBLE AS score,
              row_number() OVER w AS n, errors > coalesce(lag(errors) OVER w, 0) AS fired, min(event_id) OVER (PARTITION BY user_id) AS first_seq
       FROM cum WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, event_id)),
run AS (
  SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS blind, NULL::BIGINT AS accepted, false AS pending, NULL::VARCHAR AS source FROM (SELECT DISTINCT user_id FROM ch)
  UNION ALL
  SELECT user_id, n, CASE WHEN source IS NULL THEN blind ELSE seq + 400 END, CASE WHEN source = 'given' THEN ms ELSE accepted END,
         pending AND source IS DISTINCT FROM 'manual', source
  FROM (SELECT ch.user_id, ch.n, ch.seq, ch.ms, run.blind, run.accepted, run.pending OR ch.fired AS pending,
               CASE WHEN ch.seq <= run.blind THEN NULL WHEN run.pending OR ch.fired THEN 'manual'
                    WHEN ch.score >= 0.1::DOUBLE AND (run.accepted IS NULL OR ch.ms - run.accepted >= {24 * HOUR}) THEN 'given' END AS source
        FROM run JOIN ch ON ch.user_id = run.user_id AND ch.n = run.n + 1) step)
SELECT user_id AS device_id, seq, ms AS ts_ms, CASE WHEN source = 'given' THEN score END AS score, source,
       greatest(first_seq, seq - 199) AS clip_from, seq + 400 AS clip_to
FROM run JOIN ch USING (user_id, n) WHERE source IS NOT NULL"""

# Arrivals within the delay stand in order; an error comes after all others, too late if its user had a later event.
_REORDERED = f"""
WITH {EV}, l AS (SELECT user_id, max((start_ms, event_id)) AS last FROM ev WHERE event_type <> 'error' GROUP BY user_id),
m AS (SELECT ev.*, coalesce(event_type = 'error' AND (start_ms, event_id) < last, false) AS late FROM ev LEFT JOIN l USING (user_id)),
o AS (SELECT event_id, user_id, CASE WHEN NOT late THEN row_number() OVER (PARTITION BY user_id, late ORDER BY start_ms, event_id) END AS position, late FROM m)"""
# Chunks of sound made from vectors, with the chunk before them.
_SOUND = """
n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS seq FROM embeddings),
e AS (SELECT vec_id, 'dev_' || label AS device_id, seq,
             list_transform(embedding, lambda v: trunc(v::DOUBLE * 20000 * (0.4::DOUBLE + (seq % 5)::DOUBLE * 0.12::DOUBLE))) AS s FROM n),
w AS (SELECT device_id, seq, seq * 500 AS ms, list_concat(coalesce(lag(s) OVER (PARTITION BY device_id ORDER BY seq), []), s) AS y FROM e)"""

ORACLE |= {
    "stream_reorder": f"{_REORDERED} SELECT * FROM o",
    "stream_late": f"{_REORDERED} SELECT user_id, count(position) AS n_released, count(*) FILTER (late) AS n_late FROM o GROUP BY user_id",
    "stream_reorder_cooldown": ORACLE["cooldown_detections"],
    "stream_template": f"""
WITH RECURSIVE {_SOUND}, t AS (SELECT list_transform(embedding, lambda v: trunc(v::DOUBLE * 20000)) AS t FROM embeddings ORDER BY vec_id LIMIT 1),
a AS (SELECT device_id, seq, ms, t, unnest(list_transform(range(1, len(y) - len(t) + 2), lambda i: y[i:i + len(t) - 1])) AS x FROM w, t),
c AS (SELECT device_id, seq, ms FROM a GROUP BY ALL
      HAVING max(abs(list_inner_product(x, t)) / sqrt(list_inner_product(x, x) * list_inner_product(t, t))) >= 0.36::DOUBLE),
acc AS (SELECT device_id, min(ms) AS ms FROM c GROUP BY device_id
        UNION ALL SELECT c.device_id, min(c.ms) FROM acc JOIN c ON c.device_id = acc.device_id AND c.ms >= acc.ms + 2000 GROUP BY c.device_id)
SELECT device_id, seq, ms AS ts_ms, 'ncc' AS source FROM acc JOIN c USING (device_id, ms)""",
    "stream_energy": f"""
WITH RECURSIVE {_SOUND},
sc AS (SELECT device_id, seq, ms, sqrt(list_inner_product(y, y) / len(y)) / 32768 AS score FROM w),
run AS (
  SELECT device_id, 0::BIGINT AS seq, NULL::BIGINT AS blind, NULL::BIGINT AS accepted, false AS hit FROM (SELECT DISTINCT device_id FROM sc)
  UNION ALL
  SELECT device_id, seq, CASE WHEN hit THEN seq + 4 ELSE blind END, CASE WHEN hit THEN ms ELSE accepted END, hit
  FROM (SELECT sc.device_id, sc.seq, sc.ms, run.blind, run.accepted,
               coalesce(sc.seq > run.blind, true) AND sc.score >= 0.052::DOUBLE AND coalesce(sc.ms - run.accepted >= 1500, true) AS hit
        FROM run JOIN sc ON sc.device_id = run.device_id AND sc.seq = run.seq + 1) step)
SELECT device_id, seq, ms AS ts_ms, round(score, 9) AS score, 'energy' AS source, greatest(1, seq - 2) AS clip_from, seq + 4 AS clip_to
FROM run JOIN sc USING (device_id, seq) WHERE hit""",
}

# Whole samples of a vector, toward zero; vectors of a label behind each other are one recording.
_WHOLE = "i AS (SELECT vec_id, label, list_transform(embedding, lambda v: trunc(v::DOUBLE * 20000)) AS s FROM embeddings)"
ORACLE |= {
    "mfcc_tiled": ORACLE["mfcc"],
    "pcm_ncc": f"""
WITH {_WHOLE}, y AS (SELECT label, flatten(list(s ORDER BY vec_id)) AS y FROM i GROUP BY label), t AS (SELECT s AS t FROM i ORDER BY vec_id LIMIT 1),
a AS (SELECT label, t, unnest(list_transform(range(1, len(y) - len(t) + 2), lambda k: y[k:k + len(t) - 1])) AS x FROM y, t),
m AS (SELECT label, max(CASE WHEN list_inner_product(x, x) > 0 THEN abs(list_inner_product(x, t)) / sqrt(list_inner_product(x, x) * list_inner_product(t, t)) ELSE 0 END) AS score
      FROM a GROUP BY label)
SELECT label, width, round(score, 6) AS score FROM m, (SELECT unnest([17, 64, 1000]) AS width)""",
    "template_trim": """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda v: trunc(v::DOUBLE * 8)) AS x FROM embeddings), w AS (SELECT unnest([32, 64]) AS n),
e AS (SELECT vec_id, n, x, unnest(range(0, greatest(1, len(x) - n + 1))) AS start FROM s, w),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY vec_id, n ORDER BY list_inner_product(x[start + 1:start + n], x[start + 1:start + n]) DESC, start) = 1),
f AS (SELECT vec_id, n, start, x[start + 1:start + n] AS y, len(x) <= n AS whole FROM b)
SELECT vec_id, n, start::BIGINT AS start, (start + len(y))::BIGINT AS stop, len(y)::INTEGER AS n_samples,
       round(list_sum(list_transform(y, lambda v, k: v * k * CASE WHEN whole THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, (k - 1) / 2.0::DOUBLE, (n - k) / 2.0::DOUBLE) END)), 6) AS checksum FROM f""",
}

# Of a model SQL tells which rows it must have seen on which side, and what must hold of them.
_SIDES = f"WITH side AS ({ORACLE['training_rows']})"
ORACLE |= {
    "model_flow": f"{_SIDES} SELECT vec_id, is_test, label, target, true AS in_range, true AS agrees, true AS reloaded FROM side",
    "error_curve": f"""{_SIDES}, n AS (SELECT CASE WHEN is_test THEN 'val' ELSE 'train' END AS side, count(*) AS n FROM side GROUP BY 1)
SELECT side, round::INTEGER AS round, n, true AS in_range, true AS last_is_prediction FROM n, (SELECT unnest(range(1, 26)) AS round)""",
}

ORACLE |= {
    "file_roundtrip": f"""
WITH {_WHOLE} SELECT vec_id, 16000 AS rate, 1 AS channels, len(s)::BIGINT AS frames, {_checksum('s')} AS checksum FROM i""",
    "archive_roundtrip": f"WITH {_WHOLE} SELECT label, vec_id, 16000 AS rate, len(s)::BIGINT AS frames, {_checksum('s')} AS checksum FROM i",
}

ORACLE |= {
    "filter_label": f"""
WITH {EV} SELECT event_id, CASE WHEN label <> 'background' THEN 'positive' WHEN event_type IN ('error', 'signup') THEN 'external' ELSE 'real' END AS side FROM ev""",
    "annotations_roundtrip": f"""
WITH {EV} SELECT event_id::VARCHAR AS annotation_id, user_id::VARCHAR AS file_id, start_ms / 1000.0::DOUBLE AS start, CASE WHEN value < 50 THEN value END AS "end", label,
       'user ' || user_id || ', "' || event_type || '".wav' AS audio_file_name, 's3://media/' || event_type || '?a=1,2' AS remote_audio_path FROM ev""",
    "features_roundtrip": f"""
SELECT vec_id, 'label_' || label AS label, round({_checksum('list_transform(embedding, lambda v: v::DOUBLE)')}, 5) AS checksum FROM embeddings WHERE label IN (1, 3)""",
}
