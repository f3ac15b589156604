"""DuckDB SQL for the queries of queries.py, over the same tables."""

from __future__ import annotations

from ..functions import constants as K
from .adapter import SQL as BASE
from .queries import SHIFT

_IN = lambda values: ", ".join(map(str, values))
_LISTED = f"asn IN ({_IN(K.BULLETPROOF + K.TOR + K.VPN_PROXY + K.PRIVACY)})"
_RISKY_COUNTRIES = ", ".join(f"'{c}'" for c in K.HIGH_RISK_COUNTRIES)
_CATEGORY = f"""CASE WHEN asn IN ({_IN(K.BULLETPROOF)}) THEN 0 WHEN asn IN ({_IN(K.TOR)}) THEN 1 WHEN asn IN ({_IN(K.VPN_PROXY)}) THEN 2
  WHEN asn IN ({_IN(K.PRIVACY)}) THEN 3 WHEN upper(country) IN ({_RISKY_COUNTRIES}) THEN 4 WHEN asn IS NOT NULL THEN 5 ELSE 6 END"""
_NETWORKS = "(VALUES " + ", ".join(f"({k}, '{c}', {w}::DOUBLE, {t}::DOUBLE, '{n}')" for k, (c, w, t, n) in enumerate(K.NETWORKS)) + ") AS net(k, category, weight, threat, label)"
_LEVEL = lambda c: f"CASE WHEN {c} >= 0.75 THEN 'CRITICAL' WHEN {c} >= 0.50 THEN 'HIGH' WHEN {c} >= 0.30 THEN 'MEDIUM' ELSE 'LOW' END"

#: Arrays of a transaction, as the transaction table has them.
ROWS = """, sided AS (
  SELECT row_idx, coalesce(list(wallet ORDER BY pos) FILTER (side = 'input'), []) AS in_a, coalesce(list(wallet ORDER BY pos) FILTER (side = 'output'), []) AS out_a,
    coalesce(list(amount ORDER BY pos) FILTER (side = 'input'), []) AS in_m, coalesce(list(amount ORDER BY pos) FILTER (side = 'output'), []) AS out_m FROM legs GROUP BY row_idx
), rows_ AS (
  SELECT tx.*, coalesce(in_a, []) AS in_a, coalesce(out_a, []) AS out_a, coalesce(in_m, []) AS in_m, coalesce(out_m, []) AS out_m,
    '203.0.' || (row_idx % 256) || '.' || ((row_idx // 256) % 300) AS dst_ip FROM tx LEFT JOIN sided USING (row_idx)
)"""

FLOW = """, flow AS (
  SELECT wallet, coalesce(sum(amount::DECIMAL(20, 8)) FILTER (side = 'output'), 0)::DOUBLE AS total_btc_in, coalesce(sum(amount::DECIMAL(20, 8)) FILTER (side = 'input'), 0)::DOUBLE AS total_btc_out,
    avg(amount) AS avg_tx_amount, CASE WHEN count(*) > 1 THEN stddev_pop(amount) ELSE 0 END AS std_tx_amount FROM legs GROUP BY wallet
)"""
PAIRS = """, pairs AS (
  SELECT i.wallet AS source, o.wallet AS target, txid FROM (SELECT DISTINCT txid, wallet FROM legs WHERE side = 'input') i JOIN (SELECT DISTINCT txid, wallet FROM legs WHERE side = 'output') o USING (txid)
), degree AS (
  SELECT wallet, coalesce(i.n, 0)::BIGINT AS in_degree, coalesce(o.n, 0)::BIGINT AS out_degree FROM (SELECT DISTINCT wallet FROM legs) w
  LEFT JOIN (SELECT target AS wallet, count(DISTINCT source) AS n FROM pairs GROUP BY 1) i USING (wallet) LEFT JOIN (SELECT source AS wallet, count(DISTINCT target) AS n FROM pairs GROUP BY 1) o USING (wallet)
), fans AS (
  SELECT *, CASE WHEN in_degree + out_degree > 0 THEN in_degree / (in_degree + out_degree) ELSE 0 END::DOUBLE AS fan_in_ratio,
    CASE WHEN in_degree + out_degree > 0 THEN out_degree / (in_degree + out_degree) ELSE 0 END::DOUBLE AS fan_out_ratio FROM degree
)"""
#: Components by spreading the smallest wallet over co-spending links.
LINKS = """, cio_links AS (
  SELECT DISTINCT l.wallet AS a, m.low AS b FROM legs l JOIN (SELECT row_idx, min(wallet) AS low FROM legs WHERE side = 'input' GROUP BY 1) m USING (row_idx) WHERE side = 'input'
)"""
COMPONENTS = LINKS + """, both_ways AS (SELECT a, b FROM cio_links UNION SELECT b, a FROM cio_links
), reach AS (
  SELECT DISTINCT wallet, wallet AS r FROM legs UNION SELECT reach.wallet, b FROM reach JOIN both_ways ON a = r
), comp AS (
  SELECT wallet, min(r) AS root FROM reach GROUP BY wallet
), sized AS (
  SELECT wallet, root, count(*) OVER (PARTITION BY root) AS size FROM comp
)"""
BURSTS = """, gaps AS (
  SELECT *, sec - lag(sec) OVER (PARTITION BY src_ip ORDER BY sec, row_idx) AS gap FROM tx
), burst AS (
  SELECT src_ip, count(gap) AS n_gaps, coalesce(avg(gap), 0)::DOUBLE AS timing_tightness_mean, coalesce(stddev_pop(gap), 0)::DOUBLE AS timing_tightness_std,
    coalesce(min(gap), 0)::BIGINT AS timing_tightness_min, count(*) FILTER (gap <= 60) AS burst_count FROM gaps GROUP BY src_ip
)"""
IPS = COMPONENTS + BURSTS + f""", behind AS (
  SELECT src_ip, count(DISTINCT wallet) AS ip_wallet_diversity, count(DISTINCT root) AS ip_cluster_diversity FROM legs JOIN tx USING (row_idx) JOIN comp USING (wallet) WHERE side = 'input' GROUP BY 1
), hour_n AS (
  SELECT src_ip, (sec // 3600) % 24 AS hour, count(*) AS n FROM tx GROUP BY ALL
), hours AS (
  SELECT src_ip, count(*) AS active_hours_count, 0 - sum(p * log2(p)) AS active_hours_entropy FROM (SELECT *, n / sum(n) OVER (PARTITION BY src_ip) AS p FROM hour_n) GROUP BY 1
), ip_base AS (
  SELECT src_ip, count(*) AS ip_tx_count, coalesce(arg_max(country, row_idx), 'Unknown') AS ip_country, coalesce(arg_max(asn, row_idx) FILTER (asn IS NOT NULL), 0)::BIGINT AS asn,
    count(DISTINCT src_port) AS port_diversity, max((src_port <> 8333)::INTEGER) AS uses_non_standard_port FROM tx GROUP BY 1
), ips AS (
  SELECT src_ip, ip_tx_count, ip_country, asn AS ip_asn, port_diversity, uses_non_standard_port, coalesce(ip_wallet_diversity, 0) AS ip_wallet_diversity, coalesce(ip_cluster_diversity, 0) AS ip_cluster_diversity,
    timing_tightness_mean, timing_tightness_std, timing_tightness_min, burst_count, active_hours_count, active_hours_entropy,
    ({_LISTED})::INTEGER AS is_high_risk_asn, CASE WHEN {_LISTED} THEN 1.0 WHEN ip_country IN ({_RISKY_COUNTRIES}) THEN 0.5 ELSE 0.0 END::DOUBLE AS geo_risk_score
  FROM ip_base LEFT JOIN behind USING (src_ip) LEFT JOIN burst USING (src_ip) LEFT JOIN hours USING (src_ip)
)"""


def rounded(columns: str, digits: int = 6) -> str:
    """A select list in which names that end in ':d' are rounded, and those that end in ':w' to eight digits."""
    cut = {":d": digits, ":w": 8}
    return ", ".join(f"round({c[:-2]}, {cut[c[-2:]]}) AS {c[:-2]}" if c[-2:] in cut else c for c in columns.split())


def temporal(events: str, key: str) -> str:
    return f""", ev AS (SELECT DISTINCT {key}, id, sec FROM {events}
), moments AS (SELECT *, (sec // 3600) % 24 AS hour, (sec // 86400 + 3) % 7 AS dow, sec - lag(sec) OVER (PARTITION BY {key} ORDER BY sec, id) AS gap FROM ev
), hn AS (SELECT {key}, hour, count(*) AS n, min(sec) AS first FROM moments GROUP BY ALL
), he AS (SELECT {key}, 0 - sum(p * log2(p)) AS hour_entropy, arg_max(hour, (n, -first)) AS peak_hour FROM (SELECT *, n / sum(n) OVER (PARTITION BY {key}) AS p FROM hn) GROUP BY 1
), dn AS (SELECT {key}, dow, count(*) AS n, min(sec) AS first FROM moments GROUP BY ALL
), de AS (SELECT {key}, 0 - sum(p * log2(p)) AS day_of_week_entropy, arg_max(dow, (n, -first)) AS peak_day FROM (SELECT *, n / sum(n) OVER (PARTITION BY {key}) AS p FROM dn) GROUP BY 1
), per AS (
  SELECT {key}, count(*) AS n, count(gap) AS g, avg((dow >= 5)::INTEGER) AS weekend_tx_ratio, avg((hour <= 5)::INTEGER) AS night_tx_ratio, count(DISTINCT sec // 86400) AS active_days,
    (max(sec) - min(sec)) / 3600 AS hours, coalesce(avg(gap), 0)::DOUBLE AS mean_inter_tx_seconds, coalesce(min(gap), 0)::BIGINT AS min_inter_tx_seconds, coalesce(max(gap), 0)::BIGINT AS max_inter_tx_seconds, coalesce(stddev_pop(gap), 0) AS sd
  FROM moments GROUP BY 1
)
SELECT {key}, {rounded("weekend_tx_ratio:d night_tx_ratio:d active_days mean_inter_tx_seconds:d min_inter_tx_seconds max_inter_tx_seconds hour_entropy:d peak_hour day_of_week_entropy:d peak_day")},
  round(CASE WHEN hours > 0 THEN n / hours ELSE n END, 6) AS tx_velocity_per_hour, round(CASE WHEN hours > 0 THEN n / (hours / 24) ELSE n END, 6) AS tx_velocity_per_day,
  round(max_inter_tx_seconds / 3600, 6) AS longest_gap_hours, round(CASE WHEN mean_inter_tx_seconds > 0 THEN sd / mean_inter_tx_seconds ELSE 0 END, 6) AS burstiness,
  round(CASE WHEN g = 0 THEN 0 WHEN mean_inter_tx_seconds = 0 THEN 1 ELSE greatest(0, least(1, 1 - sd / mean_inter_tx_seconds)) END, 6)::DOUBLE AS activity_regularity,
  (hour_entropy > 0.9 * log2(24))::INTEGER AS is_likely_automated
FROM per JOIN he USING ({key}) JOIN de USING ({key})"""


def coinjoin(ins: int, outs: int, tolerance: float) -> str:
    return BASE + ROWS + f""", cand AS (
  SELECT row_idx, txid, len(in_a) AS num_inputs, len(out_m) AS num_outputs, [x FOR x IN out_m IF x > 0] AS a FROM rows_ WHERE len(in_a) >= {ins} AND len(out_m) >= {outs}
), each AS (
  SELECT *, unnest(a) AS c, unnest(range(len(a))) AS i FROM cand WHERE len(a) >= {outs}
), near AS (
  SELECT *, len([x FOR x IN a IF abs(x - c) <= c * {tolerance}::DOUBLE]) AS n FROM each
)
SELECT row_idx, txid, num_inputs::INTEGER AS num_inputs, num_outputs::INTEGER AS num_outputs, round(round(c, 8), 8) AS dominant_output_amount, round(n / num_outputs, 4) AS pct_outputs_matching, n / num_outputs >= 0.60 AS is_coinjoin
FROM near QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY n DESC, i) = 1"""


def mixer(minutes: int, sources: int, destinations: int) -> str:
    return BASE + PAIRS + f""", t AS (SELECT DISTINCT txid, sec FROM legs
), ev AS (
  SELECT target AS wallet, sec, source AS src, NULL::VARCHAR AS dst FROM pairs JOIN t USING (txid) WHERE source <> target
  UNION ALL SELECT source, sec, NULL, target FROM pairs JOIN t USING (txid) WHERE source <> target
), act AS (
  SELECT * FROM ev WHERE wallet IN (SELECT wallet FROM ev GROUP BY wallet HAVING count(DISTINCT src) >= {sources} AND count(DISTINCT dst) >= {destinations})
), win AS (
  SELECT a.wallet, a.sec, count(DISTINCT b.src) AS s, count(DISTINCT b.dst) AS d FROM (SELECT DISTINCT wallet, sec FROM act) a JOIN act b ON b.wallet = a.wallet AND b.sec BETWEEN a.sec AND a.sec + {60 * minutes} GROUP BY ALL
)
SELECT wallet, sec AS window_start, s::INTEGER AS distinct_sources, d::INTEGER AS distinct_destinations, s >= {sources} AND d >= {destinations} AS is_mixer_pattern FROM win
QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY (s >= {sources} AND d >= {destinations}) DESC, CASE WHEN s >= {sources} AND d >= {destinations} THEN -sec ELSE s + d END DESC, sec) = 1"""


STEPS = """, outs AS (
  SELECT row_idx, txid, sec, count(*) AS n, sum(amount) AS total, arg_max(wallet, (amount, -pos)) AS carrier, max(amount) AS big FROM legs WHERE side = 'output' GROUP BY ALL
), steps AS (
  SELECT row_idx, txid, sec, carrier, round(big, 8) AS carried, round(total - big, 8) AS peeled FROM outs WHERE n >= 2 AND total > 0 AND (total - big) / total <= 0.15
)"""
#: Every simple path of peel steps, each start's longest, and of these, the longest first, those that meet none chosen before.
CHAINS = STEPS + """, hops AS (
  SELECT DISTINCT wallet AS src, carrier AS dst, s.row_idx, {'late': s.sec IS NULL, 'sec': s.sec, 'row_idx': s.row_idx} AS place
  FROM steps s JOIN legs ON legs.row_idx = s.row_idx AND side = 'input' WHERE wallet <> carrier
), paths AS (
  SELECT src AS start, dst AS last, [src, dst] AS wallets, [row_idx] AS rows, [place] AS ord FROM hops
  UNION ALL SELECT start, hops.dst, list_append(wallets, hops.dst), list_append(rows, hops.row_idx), list_append(ord, hops.place) FROM paths JOIN hops ON src = last WHERE NOT list_contains(wallets, hops.dst)
), ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY len(rows) DESC, start) AS k FROM (
    SELECT * FROM paths WHERE len(rows) >= 3 QUALIFY row_number() OVER (PARTITION BY start ORDER BY len(rows) DESC, ord) = 1
  )
), picks AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS used, []::VARCHAR[] AS seen, false AS good
  UNION ALL SELECT r.k, CASE WHEN ok THEN list_concat(used, r.rows) ELSE used END, CASE WHEN ok THEN list_concat(seen, r.wallets) ELSE seen END, ok
  FROM picks p JOIN (SELECT k, start, wallets, rows FROM ranked) r ON r.k = p.k + 1, LATERAL (SELECT NOT list_has_any(used, r.rows) AND NOT list_contains(seen, r.start) AS ok)
), chain AS MATERIALIZED (
  SELECT ranked.* FROM ranked JOIN picks USING (k) WHERE good
), carry AS (
  SELECT start, unnest(rows) AS row_idx, unnest(range(len(rows))) AS i FROM chain
), money AS (
  SELECT start, arg_min(carried + peeled, i) AS starting_amount, arg_max(carried, i) AS ending_amount, sum(peeled) AS total_peeled, list(txid ORDER BY i) AS txids FROM carry JOIN steps USING (row_idx) GROUP BY start
)"""
SEEDS = """, seed AS (
  SELECT wallet, 1.0::DOUBLE - 0.05::DOUBLE * (row_number() OVER (ORDER BY max(amount) DESC, wallet) - 1) AS risk FROM legs WHERE side = 'output' GROUP BY wallet ORDER BY max(amount) DESC, wallet LIMIT 8
)"""


def _hop(k: int) -> str:
    before = " UNION ALL ".join(f"SELECT s, w FROM h{j}" for j in range(1, k)) or "SELECT '' AS s, '' AS w"
    return f""", p{k} AS (
  SELECT f.s, f.w, o.next, o.pos, f.ord, i.tx_ord, i.txid, f.taint, f.path, o.amount, sum(o.amount) OVER (PARTITION BY f.s, f.w, i.txid) AS total
  FROM h{k - 1} f JOIN ins i ON i.wallet = f.w JOIN pay o ON o.txid = i.txid AND o.next <> f.w
), q{k} AS (
  SELECT *, round(taint * 0.65::DOUBLE * CASE WHEN amount > 0 AND total > 0 THEN amount / total ELSE 1.0 END, 4) AS passed FROM p{k}
), r{k} AS (
  SELECT *, row_number() OVER (PARTITION BY s, next ORDER BY ord, tx_ord, txid, pos) AS rn FROM q{k} WHERE passed >= 0.01
), h{k} AS (
  SELECT s, next AS w, {k} AS hop, passed AS taint, path || ' -> ' || txid[1:8] || '... -> ' || next AS path, row_number() OVER (PARTITION BY s ORDER BY ord, tx_ord, txid, pos) AS ord
  FROM r{k} WHERE rn = 1 AND (s, next) NOT IN ({before})
)"""


TAINT = BASE + SEEDS + """, ins AS (
  SELECT wallet, txid, min(row_idx) AS tx_ord FROM legs WHERE side = 'input' GROUP BY ALL
), pay AS (
  SELECT txid, wallet AS next, amount, pos FROM legs WHERE side = 'output'
), h0 AS (
  SELECT wallet AS s, wallet AS w, 0 AS hop, risk AS taint, wallet AS path, 0::BIGINT AS ord FROM seed
)""" + "".join(map(_hop, range(1, 5))) + ", arrivals AS (" + " UNION ALL ".join(f"SELECT s, w, hop, taint, path FROM h{k}" for k in range(5)) + ")"

CORRELATION = BURSTS + f""", seen AS (
  SELECT wallet, src_ip, count(*) AS n, arg_min(row_idx, (row_idx, pos)) AS r, min(pos) FILTER (true) AS p0 FROM legs JOIN tx USING (row_idx) WHERE side = 'input' GROUP BY wallet, src_ip
), top AS (
  SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY n DESC, r) = 1
), joined AS (
  SELECT top.wallet, top.src_ip, top.n, tx.asn, tx.country, burst_count, CASE WHEN n_gaps > 0 THEN timing_tightness_min ELSE -1 END::DOUBLE AS min_gap, net.* FROM top JOIN tx ON tx.row_idx = top.r JOIN burst ON burst.src_ip = top.src_ip
  JOIN {_NETWORKS} ON net.k = {_CATEGORY}
), corr AS (
  SELECT *, round(least(1.0, greatest(0.05, (1 - exp(-0.4 * n)) * weight * CASE WHEN burst_count > 0 THEN 1.15 ELSE 1.0 END)), 4) AS score FROM joined
)"""
ALERTS = PAIRS + """, alert AS (
  SELECT wallet, round(least(1.0, (in_degree + 2 * out_degree) / 40), 4)::DOUBLE AS composite_risk_score FROM degree
)"""
TRUTH = """, truth AS (
  SELECT DISTINCT wallet, wallet[2:]::BIGINT % 7 = 0 AS bad, CASE WHEN wallet[2:]::BIGINT % 2 = 0 THEN 'ransomware_peelchain' ELSE 'coinjoin_mixing' END AS pattern_type FROM legs
)"""
MODEL = ["total_btc_in", "total_btc_out", "net_flow", "avg_tx_amount", "std_tx_amount", "in_degree", "out_degree", "fan_in_ratio", "fan_out_ratio"]
SCALED = FLOW + PAIRS + """, feat AS (
  SELECT wallet, total_btc_in, total_btc_out, total_btc_in - total_btc_out AS net_flow, avg_tx_amount, std_tx_amount, in_degree::DOUBLE AS in_degree, out_degree::DOUBLE AS out_degree, fan_in_ratio, fan_out_ratio FROM flow JOIN fans USING (wallet)
), q AS (
  SELECT """ + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS r_{c}" for c in MODEL) + """ FROM feat
), scaled AS (
  SELECT wallet, """ + ", ".join(f"({c} - m_{c}) / r_{c} AS {c}" for c in MODEL) + """ FROM feat, q
)"""
ENTITIES = COMPONENTS + """, ip_pairs AS (
  SELECT DISTINCT src_ip, wallet FROM legs JOIN tx USING (row_idx) WHERE side = 'input'
), star AS (
  SELECT src_ip, centre, wallet FROM ip_pairs JOIN (SELECT src_ip, min(wallet) AS centre FROM ip_pairs GROUP BY 1 HAVING count(*) BETWEEN 2 AND 10) c USING (src_ip) WHERE wallet <> centre
), all_links AS (
  SELECT a, b FROM both_ways UNION SELECT wallet, centre FROM star UNION SELECT centre, wallet FROM star
), reach2 AS (
  SELECT DISTINCT wallet, wallet AS r FROM legs UNION SELECT reach2.wallet, b FROM reach2 JOIN all_links ON a = r
), ent AS (
  SELECT wallet, root, count(*) OVER (PARTITION BY root) AS size FROM (SELECT wallet, min(r) AS root FROM reach2 GROUP BY 1)
), ent_id AS (SELECT root, row_number() OVER (ORDER BY size DESC, root) - 1 AS cluster_id FROM (SELECT DISTINCT root, size FROM ent)
), cio_id AS (SELECT root, row_number() OVER (ORDER BY size DESC, root) - 1 AS cio_cluster_id FROM (SELECT DISTINCT root, size FROM sized)
), entity AS (
  SELECT ent.wallet, cluster_id, printf('ENT_%05d', cluster_id) AS entity_cluster_id, cio_cluster_id, ent.size AS cluster_size,
    CASE WHEN sized.size > 1 THEN 'common_input_ownership' WHEN ent.size = 1 THEN 'singleton' ELSE 'exclusive_ip_linkage' END AS clustering_method,
    CASE WHEN sized.size > 1 OR (ent.size > 1 AND ent.wallet IN (SELECT centre FROM star)) THEN 1.0 WHEN ent.size = 1 THEN 0.5 ELSE 0.85 END::DOUBLE AS confidence_score,
    coalesce((SELECT min(src_ip) FROM ip_pairs p WHERE p.wallet = ent.wallet), 'Unknown') AS primary_ip, ent.size > 1 AS is_multi_wallet_entity
  FROM ent JOIN sized USING (wallet) JOIN ent_id ON ent_id.root = ent.root JOIN cio_id ON cio_id.root = sized.root
)"""
FLAGS = ROWS + r""", f AS (
  SELECT row_idx, txid, fee, NOT regexp_matches(txid, '^[0-9a-fA-F]{64}$') AS invalid_txid, len([x FOR x IN in_m IF x < 0]) + len([x FOR x IN out_m IF x < 0]) > 0 OR coalesce(fee, 0) < 0 AS negative_amount,
    len(in_a) <> len(in_m) OR len(out_a) <> len(out_m) AS length_mismatch,
    NOT (len([x FOR x IN string_split(src_ip, '.') IF x::INTEGER <= 255]) = 4 AND len([x FOR x IN string_split(dst_ip, '.') IF x::INTEGER <= 255]) = 4) AS invalid_ip,
    count(*) OVER (PARTITION BY txid) > 1 AS duplicate_txid, fee IS NULL AS null_field FROM rows_
)"""
_ANY = "invalid_txid OR negative_amount OR length_mismatch OR invalid_ip OR duplicate_txid OR null_field"
_STD = "coalesce(sqrt(list_sum([(x - list_avg(out_m)) ** 2 FOR x IN out_m]) / len(out_m)), 0)"

CHANGE = """, outs_r AS (
  SELECT *, amount IN (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0) OR round(amount, 2) = amount AS rnd FROM legs WHERE side = 'output'
), outs_s AS (
  SELECT *, (row_idx = first_value(row_idx) OVER (PARTITION BY wallet ORDER BY sec, row_idx))::INTEGER * 2 + (bool_or(rnd) OVER w AND NOT bool_and(rnd) OVER w AND NOT rnd)::INTEGER AS score, count(*) OVER w AS n FROM outs_r WINDOW w AS (PARTITION BY row_idx)
), change AS (
  SELECT row_idx, txid, wallet, score FROM (SELECT *, row_number() OVER o AS rn, lead(score) OVER o AS second FROM outs_s WHERE n >= 2 WINDOW o AS (PARTITION BY row_idx ORDER BY score DESC, pos)) WHERE rn = 1 AND score >= 2 AND score > second
)"""

ORACLES = {
    "wallet_flow": BASE + FLOW + "SELECT wallet, " + rounded("total_btc_in:w total_btc_out:w avg_tx_amount:d std_tx_amount:d") + ", round(total_btc_in - total_btc_out, 8) AS net_flow FROM flow",
    "wallet_degrees": BASE + PAIRS + "SELECT " + rounded("wallet in_degree out_degree fan_in_ratio:d fan_out_ratio:d") + " FROM fans",
    "wallet_features": BASE + FLOW + PAIRS + COMPONENTS + """, place AS (
  SELECT wallet, count(DISTINCT src_ip) AS distinct_ip_count, count(DISTINCT country) AS distinct_country_count, count(DISTINCT asn) AS distinct_asn_count FROM (SELECT DISTINCT wallet, txid FROM legs) l JOIN tx USING (txid) GROUP BY 1
), uses AS (
  SELECT wallet, count(DISTINCT txid) FILTER (side = 'output') + count(DISTINCT txid) FILTER (side = 'input') AS tx_count, (max(sec) - min(sec)) / 3600 AS life FROM legs GROUP BY 1
)
SELECT wallet, round(total_btc_in, 8) AS total_btc_in, round(total_btc_out, 8) AS total_btc_out, round(total_btc_in - total_btc_out, 8) AS net_flow, round(avg_tx_amount, 6) AS avg_tx_amount, round(std_tx_amount, 6) AS std_tx_amount,
  in_degree, out_degree, round(fan_in_ratio, 6) AS fan_in_ratio, round(fan_out_ratio, 6) AS fan_out_ratio, tx_count, round(life, 6) AS address_lifespan_hours, distinct_ip_count, distinct_country_count, distinct_asn_count, size AS cluster_size,
  0 AS is_in_peel_chain, 0 AS peel_chain_depth, tx_count AS reuse_count
FROM flow JOIN fans USING (wallet) JOIN sized USING (wallet) JOIN uses USING (wallet) JOIN place USING (wallet)""",
    "tx_features": BASE + ROWS + COMPONENTS + CHANGE + f""", reuse AS (
  SELECT row_idx, max(n) AS m FROM (SELECT row_idx, count(*) OVER (PARTITION BY wallet) AS n FROM legs WHERE side = 'input') GROUP BY 1
), by_ip AS (
  SELECT src_ip, count(DISTINCT root) AS d FROM legs JOIN tx USING (row_idx) JOIN comp USING (wallet) WHERE side = 'input' GROUP BY 1
)
SELECT row_idx, txid, src_ip, len(in_a)::INTEGER AS num_inputs, len(out_a)::INTEGER AS num_outputs, round(coalesce(list_sum(in_m), 0), 8) AS total_input_value, round(coalesce(list_sum(out_m), 0), 8) AS total_output_value,
  round(coalesce(fee, 0), 8) AS fee, round(CASE WHEN list_sum(in_m) > 0 THEN coalesce(fee, 0) / list_sum(in_m) ELSE 0 END, 6) AS fee_ratio,
  round(coalesce(list_avg(in_m), 0), 6) AS avg_input_amount, round(coalesce(list_avg(out_m), 0), 6) AS avg_output_amount, round(coalesce(list_max(out_m), 0), 8) AS max_output_amount, round(coalesce(list_min(out_m), 0), 8) AS min_output_amount,
  round({_STD}, 6) AS output_amount_std, round(coalesce(list_max(out_m) - list_min(out_m), 0), 8) AS output_amount_range, round(CASE WHEN len(out_a) > 0 THEN len(in_a) / len(out_a) ELSE 0 END, 6) AS input_output_ratio,
  (script_type LIKE '%P2PKH%')::INTEGER AS is_script_p2pkh, (script_type LIKE '%P2SH%')::INTEGER AS is_script_p2sh, (script_type LIKE '%P2WPKH%')::INTEGER AS is_script_p2wpkh, (script_type LIKE '%MULTISIG%')::INTEGER AS is_script_multisig,
  coalesce({_LISTED}, false)::INTEGER AS broadcast_ip_is_high_risk_asn, ((sec // 3600) % 24)::INTEGER AS broadcast_hour, ((sec // 86400 + 3) % 7)::INTEGER AS broadcast_day_of_week,
  (abs(coalesce(list_sum(out_m), 0) - round(coalesce(list_sum(out_m), 0), 2)) < 1e-8)::INTEGER AS is_round_total, coalesce(m, 0) AS input_address_reuse_max, (txid IN (SELECT txid FROM change))::INTEGER AS has_change_output, coalesce(d, 0) AS broadcasting_ip_wallet_diversity
FROM rows_ LEFT JOIN reuse USING (row_idx) LEFT JOIN by_ip USING (src_ip)""",
    "ip_features": BASE + IPS + "SELECT " + rounded("src_ip ip_tx_count ip_country ip_asn port_diversity uses_non_standard_port ip_wallet_diversity ip_cluster_diversity timing_tightness_mean:d timing_tightness_std:d timing_tightness_min burst_count active_hours_count active_hours_entropy:d is_high_risk_asn geo_risk_score:d") + " FROM ips",
    "ip_bursts": BASE + BURSTS + "SELECT " + rounded("src_ip n_gaps timing_tightness_mean:d timing_tightness_std:d timing_tightness_min burst_count") + " FROM burst",
    "wallet_network_features": BASE + IPS + """SELECT wallet, count(*) AS wallet_distinct_ips, count(DISTINCT ip_country) AS wallet_ip_country_diversity, count(DISTINCT ip_asn) AS wallet_ip_asn_diversity, max(ip_cluster_diversity) AS wallet_max_ip_cluster_diversity,
  max(is_high_risk_asn) AS wallet_has_high_risk_ip, round(avg(timing_tightness_mean), 6) AS wallet_avg_timing_tightness, min(timing_tightness_min) AS wallet_min_burst_interval
FROM (SELECT DISTINCT wallet, src_ip FROM legs JOIN tx USING (row_idx) WHERE side = 'input') JOIN ips USING (src_ip) GROUP BY 1""",
    "events_user_bursts": """WITH g AS (SELECT user_id, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT, event_id) AS gap FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events) e)
SELECT user_id, count(gap) AS n_gaps, round(coalesce(avg(gap), 0), 6)::DOUBLE AS timing_tightness_mean, round(coalesce(stddev_pop(gap), 0), 6)::DOUBLE AS timing_tightness_std, coalesce(min(gap), 0)::BIGINT AS timing_tightness_min, count(*) FILTER (gap <= 60) AS burst_count FROM g GROUP BY 1""",
    "events_temporal": "WITH src AS (SELECT user_id, event_id AS id, epoch(date_trunc('second', ts))::BIGINT AS sec FROM events)" + temporal("src", "user_id"),
    "temporal_features": BASE + ", src AS (SELECT wallet, txid AS id, sec FROM legs)" + temporal("src", "wallet"),
    "dq_flags": BASE + FLAGS + "SELECT row_idx, invalid_txid, negative_amount, length_mismatch, invalid_ip, duplicate_txid, null_field FROM f",
    "dq_summary": BASE + FLAGS + f"SELECT count(*) AS total_rows, {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in _ANY.split(' OR '))}, count(*) FILTER (NOT ({_ANY})) AS clean_rows FROM f",
    "dq_null_counts": BASE + "SELECT * FROM (SELECT 'fee' AS column_name, count(*) FILTER (fee IS NULL) AS n_null FROM tx UNION ALL SELECT 'src_ip_asn', count(*) FILTER (asn IS NULL) FROM tx UNION ALL SELECT 'src_ip_country', count(*) FILTER (country IS NULL) FROM tx) WHERE n_null > 0",
    "dup_txids": BASE + "SELECT txid[1:3] AS txid, count(*) AS n FROM tx GROUP BY 1 HAVING count(*) > 1",
    "clean_subset": BASE + FLAGS + f"SELECT row_idx, txid, fee FROM f WHERE NOT ({_ANY})",
    "graph_summary": BASE + """, n AS (SELECT count(DISTINCT txid) AS transaction_nodes, count(DISTINCT src_ip) AS ip_nodes, count(*) AS broadcast_edges FROM tx
), m AS (SELECT count(DISTINCT wallet) AS wallet_nodes, count(*) FILTER (side = 'input') AS input_edges, count(*) FILTER (side = 'output') AS output_edges FROM legs
), i AS (SELECT DISTINCT row_idx, wallet FROM legs WHERE side = 'input'), c AS (SELECT 2 * count(*) AS ownership_edges FROM (SELECT DISTINCT a.wallet, b.wallet AS w2 FROM i a JOIN i b ON a.row_idx = b.row_idx AND a.wallet < b.wallet))
SELECT *, transaction_nodes + ip_nodes + wallet_nodes AS total_nodes, broadcast_edges + input_edges + output_edges + ownership_edges AS total_edges FROM n, m, c""",
    "graph_nodes": BASE + "SELECT node_type, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT DISTINCT wallet AS id, 'wallet' AS node_type FROM legs UNION ALL SELECT DISTINCT txid, 'transaction' FROM tx UNION ALL SELECT DISTINCT src_ip, 'ip' FROM tx) GROUP BY 1",
    "cio_edges": BASE + ", i AS (SELECT DISTINCT row_idx, txid, wallet FROM legs WHERE side = 'input') SELECT a.wallet AS w1, b.wallet AS w2, count(*) AS co_occurrence_count, arg_min(a.txid, a.row_idx) AS first_txid FROM i a JOIN i b ON a.row_idx = b.row_idx AND a.wallet < b.wallet GROUP BY ALL",
    "wallet_clusters": BASE + COMPONENTS + """, seen AS (SELECT root, size, min((row_idx, pos)) AS s FROM sized JOIN legs USING (wallet) GROUP BY ALL), ids AS (SELECT root, row_number() OVER (ORDER BY size DESC, s) - 1 AS cluster_id FROM seen)
SELECT wallet, cluster_id, size FROM sized JOIN ids USING (root)""",
    "change_addresses": BASE + CHANGE + "SELECT * FROM change",
    "related_wallets": BASE + PAIRS + " SELECT source AS wallet, string_agg(target, ',' ORDER BY target) AS related FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS rn FROM (SELECT DISTINCT source, target FROM pairs WHERE source <> target)) WHERE rn <= 10 GROUP BY 1",
    "wallet_txids": BASE + "SELECT wallet, string_agg(txid, ',' ORDER BY rn) AS txids FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY row_idx, side, pos) AS rn FROM legs) WHERE rn <= 10 GROUP BY 1",
    "khop_neighbors": BASE + """, e AS (SELECT wallet AS a, txid AS b FROM legs UNION SELECT txid, src_ip FROM tx), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), k1 AS (SELECT DISTINCT b AS id FROM u WHERE a = 'w7' AND b <> 'w7'), k2 AS (SELECT DISTINCT b AS id FROM u JOIN k1 ON u.a = k1.id WHERE b <> 'w7' AND b NOT IN (SELECT id FROM k1))
SELECT * FROM (SELECT 'w7' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM k1 UNION ALL SELECT id, 2 FROM k2) ORDER BY hop, id LIMIT 45""",
    "coinjoin": coinjoin(1, 2, 0.05),
    "coinjoin_wide": coinjoin(2, 3, 0.25),
    "coinjoin_default": coinjoin(5, 5, 0.05),
    "mixer_hubs": mixer(24 * 60, 2, 2),
    "mixer_hubs_default": mixer(60, 4, 4),
    "peel_steps": BASE + STEPS + "SELECT row_idx, txid, sec, carrier, round(carried, 8) AS carried, round(peeled, 8) AS peeled FROM steps",
    "peel_chains": BASE + CHAINS + """SELECT start, array_to_string(wallets, ',') AS wallets, len(rows)::BIGINT AS chain_length, round(starting_amount, 8) AS starting_amount, round(ending_amount, 8) AS ending_amount, round(total_peeled, 8) AS total_peeled
FROM chain JOIN money USING (start)""",
    "peel_feeders": BASE + CHAINS + """, paid AS (
  SELECT DISTINCT start, legs.txid FROM money JOIN legs ON wallet = start AND side = 'output' WHERE NOT list_contains(txids, legs.txid)
), fed AS (
  SELECT paid.start, count(DISTINCT paid.txid) AS t, count(DISTINCT wallet) FILTER (wallet <> paid.start) AS w FROM paid LEFT JOIN legs ON legs.txid = paid.txid AND side = 'input' GROUP BY 1
)
SELECT start, coalesce(t, 0) AS n_feeder_txids, coalesce(w, 0) AS n_feeder_wallets, CASE WHEN coalesce(w, 0) >= 3 THEN start END AS collector_wallet FROM chain LEFT JOIN fed USING (start)""",
    "entity_clusters": BASE + ENTITIES + "SELECT * FROM entity",
    "ip_star_links": BASE + ENTITIES + "SELECT * FROM star",
    "cluster_explanations": BASE + ENTITIES + """SELECT wallet, CASE clustering_method WHEN 'common_input_ownership' THEN 'Co-spends with others of ' || entity_cluster_id || ' (' || cluster_size || ' addresses): inputs of one transaction share an owner.'
  WHEN 'exclusive_ip_linkage' THEN 'Shares address ' || primary_ip || ' with others of ' || entity_cluster_id || ' (' || cluster_size || ' addresses).' ELSE 'Stands alone as ' || entity_cluster_id || '.' END AS explanation FROM entity""",
    "asn_category": BASE + f"SELECT category, weight, threat, count(*) AS n, min(row_idx) AS first_row FROM tx JOIN {_NETWORKS} ON net.k = {_CATEGORY} GROUP BY ALL",
    "geo_enrich": BASE + """, p AS (SELECT src_ip, split_part(src_ip, '.', 3)::BIGINT AS c FROM tx)
SELECT CASE WHEN c % 2 = 0 THEN 'ZZ' ELSE ['US', 'DE', 'RU', 'FR', 'CN', 'BR', 'IN', 'GB', 'IR', 'JP'][(c // 16) % 10 + 1] END AS src_ip_country, CASE WHEN c % 2 = 0 THEN 65000 + c ELSE 64500 + c // 16 END AS src_ip_asn, count(*) AS n, count(DISTINCT src_ip) AS n_ips FROM p GROUP BY ALL""",
    "network_correlation": BASE + CORRELATION + """SELECT wallet, src_ip AS primary_ip, asn AS primary_asn, country AS primary_country, category AS asn_category, threat AS asn_threat_score, n AS observation_count, burst_count, min_gap, score AS correlation_score,
  CASE WHEN score >= 0.80 THEN 'VERY_HIGH' WHEN score >= 0.60 THEN 'HIGH' WHEN score >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_label,
  'Observed via ' || src_ip || ': ' || concat_ws('; ', CASE WHEN threat > 0 THEN label || ' (ASN ' || coalesce(asn::VARCHAR, 'N/A') || ')' END, CASE WHEN burst_count > 0 THEN burst_count || ' rapid broadcast burst(s)' END, CASE WHEN threat = 0 AND burst_count = 0 THEN 'Standard broadcast via ' || src_ip END) AS explanation FROM corr""",
    "taint_hops": TAINT + "SELECT s AS seed, w AS wallet, hop, round(taint, 6) AS taint, path FROM arrivals",
    "taint_scores": TAINT + """, best AS (SELECT * FROM arrivals QUALIFY row_number() OVER (PARTITION BY w ORDER BY taint DESC, hop, s) = 1)
SELECT wallet, round(coalesce(taint, 0), 6) AS taint_score, coalesce(hop, -1) AS taint_hops, coalesce(s, 'None') AS taint_source, coalesce(path, '') AS taint_path, taint IS NOT NULL AS is_tainted FROM (SELECT DISTINCT wallet FROM legs) LEFT JOIN best ON w = wallet""",
    "risk_levels": BASE + ALERTS + f"SELECT *, {_LEVEL('composite_risk_score')} AS risk_level FROM alert",
    "recalibrated_scores": BASE + ALERTS + f""", v AS (SELECT wallet AS entity_id, composite_risk_score AS raw_score, CASE WHEN wallet[2:]::BIGINT % 100 = 0 THEN 'FALSE_POSITIVE' WHEN wallet[2:]::BIGINT % 50 = 0 THEN 'CONFIRMED' ELSE 'PENDING' END AS status FROM alert
), w AS (SELECT *, round(CASE status WHEN 'CONFIRMED' THEN least(1.0, raw_score * 1.2::DOUBLE) WHEN 'FALSE_POSITIVE' THEN round(raw_score * 0.1::DOUBLE, 4) ELSE raw_score END, 4) AS composite_risk_score FROM v)
SELECT entity_id, composite_risk_score, raw_score, {_LEVEL('composite_risk_score')} AS risk_level, status FROM w""",
    "feedback_latest": BASE + "SELECT wallet AS entity_id, 'wallet' AS entity_type, CASE WHEN wallet[2:]::BIGINT % 100 = 0 THEN 'FALSE_POSITIVE' ELSE 'CONFIRMED' END AS status, '' AS notes, 'a1' AS analyst_id, CASE WHEN wallet[2:]::BIGINT % 100 = 0 THEN '2024-02-02' ELSE '2024-02-01' END AS updated_at FROM (SELECT DISTINCT wallet FROM legs) WHERE wallet[2:]::BIGINT % 50 = 0",
    "gt_evaluation": BASE + ALERTS + TRUTH + """, c AS (SELECT count(*) FILTER (composite_risk_score >= 0.3 AND bad) AS tp, count(*) FILTER (composite_risk_score >= 0.3 AND NOT bad) AS fp, count(*) FILTER (composite_risk_score < 0.3 AND bad) AS fn FROM alert JOIN truth USING (wallet))
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) ELSE 0 END::DOUBLE AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) ELSE 0 END::DOUBLE AS recall, CASE WHEN tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 4) ELSE 0 END::DOUBLE AS f1 FROM c""",
    "gt_missed": BASE + ALERTS + TRUTH + "SELECT wallet, composite_risk_score AS score FROM truth JOIN alert USING (wallet) WHERE bad AND composite_risk_score < 0.3 ORDER BY score DESC, wallet LIMIT 10",
    "gt_pattern_recall": BASE + ALERTS + TRUTH + "SELECT pattern_type, count(*) AS n, count(*) FILTER (composite_risk_score >= 0.3) AS found, round(count(*) FILTER (composite_risk_score >= 0.3) / count(*), 4) AS recall FROM truth JOIN alert USING (wallet) WHERE bad GROUP BY 1",
    "robust_scaled": BASE + SCALED + "SELECT wallet, " + ", ".join(f"round({c}, 6) AS {c}" for c in MODEL) + " FROM scaled",
    "variance_importance": BASE + SCALED + ", v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c}) AS v FROM feat" for c in MODEL) + ") SELECT feature, round(v / sum(v) OVER (), 6) AS importance FROM v",
    "zscore_explain": BASE + SCALED + ", z AS (" + " UNION ALL ".join(f"SELECT wallet, '{c}' AS feature, round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_samp({c}) OVER () <= 1e-6 THEN 1 ELSE stddev_samp({c}) OVER () END, 3) AS contribution FROM feat" for c in MODEL)
    + "), k AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY abs(contribution) DESC, feature)::INTEGER AS rank FROM z WHERE abs(contribution) > 0.1) SELECT * FROM k WHERE rank <= 5",
    "deviant_features": BASE + SCALED + ", z AS (" + " UNION ALL ".join(f"SELECT wallet, '{c}' AS name, round(abs({c}), 6) AS z FROM scaled" for c in MODEL) + "), k AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY z DESC, name) AS rn FROM z) SELECT wallet, string_agg(name, ',' ORDER BY rn) AS features FROM k WHERE rn <= 3 GROUP BY 1",
    "score_histogram": BASE + ALERTS + "SELECT least(floor(composite_risk_score * 40), 39)::BIGINT AS bin, count(*) AS n FROM alert GROUP BY 1",
    "tier_counts": BASE + ALERTS + f"SELECT {_LEVEL('composite_risk_score')} AS risk_level, count(*) AS n FROM alert GROUP BY 1",
    "top_leads": BASE + ALERTS + f"SELECT wallet, composite_risk_score, {_LEVEL('composite_risk_score')} AS risk_level FROM alert ORDER BY composite_risk_score DESC, wallet LIMIT 10",
    "ip_leaderboard": BASE + ALERTS + CORRELATION + "SELECT src_ip AS primary_ip, count(*) AS n_alerts, max(composite_risk_score) AS max_risk, arg_min(asn, wallet) AS primary_asn, arg_min(category, wallet) AS asn_category FROM corr JOIN alert USING (wallet) GROUP BY 1 ORDER BY n_alerts DESC, max_risk DESC, src_ip LIMIT 15",
}


def _settled(sql: str) -> str:
    """sql with every round(x, 6) shifted as queries.rounded() shifts it, and no negative zero."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        end, depth = at + 6, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + 6 : end - 1]
        if inner.endswith(", 6"):
            new = f"(round(({inner[:-3]}) + {SHIFT}, 6) + 0.0)"
            sql = sql[:at] + new + sql[end:]
            at += 2
        at += 6
    return sql


ORACLES = {name: _settled(sql) for name, sql in ORACLES.items()}
