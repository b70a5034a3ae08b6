"""Registered queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.functions import canonical, hashing
from veritide.operators import audit, behaviour, calibration, federated, gbdt, identity, metrics, monitoring, policy, provenance, reuse, rings, risk
from veritide.operators.graph import written
from veritide.plans.bindings import HASHED, SCORES, SIGNALS, event_claims, hashed_claims, read, scores, signals
from veritide.session import ship_package
from veritide.sources import corpus

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return add


_KEY = b"shared key"


def _hmac(message: str) -> str:
    """SQL of the hexadecimal keyed digest of a text or blob."""
    inner, outer = ("".join(f"\\x{k ^ pad:02X}" for k in _KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    return f"sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || ({message})::BLOB)))"


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


_HISTORY = """SELECT {key} AS {key}, CAST(row_number() OVER w - 1 AS BIGINT) AS n_prior_claims,
  count(*) OVER (PARTITION BY {who} ORDER BY us RANGE BETWEEN 2678399999999 PRECEDING AND CURRENT ROW) - (tied - nth + 1) AS n_prior_claims_30d,
  count(*) OVER (PARTITION BY {who} ORDER BY us RANGE BETWEEN 7862399999999 PRECEDING AND CURRENT ROW) - (tied - nth + 1) AS n_prior_claims_90d,
  coalesce((us - min(us) OVER p) // 86400000000, 0) AS days_since_first_claim,
  coalesce((us - max(us) OVER p) // 86400000000, 0) AS days_since_last_claim,
  round(coalesce(avg(value) OVER p, 0) + 0.0000001, 6) AS mean_prior_value, round(coalesce(max(value) OVER p, 0), 4) AS max_prior_value,
  round(CASE WHEN coalesce(avg(value) OVER p, 0) = 0 THEN 1 ELSE value / avg(value) OVER p END, 6) AS value_vs_prior_mean,
  row_number() OVER w = 1 AS is_first_claim, CAST(coalesce(sum(fresh) OVER p, 0) AS BIGINT) AS n_kinds
FROM (SELECT *, row_number() OVER (PARTITION BY {who}, us ORDER BY {key}) AS nth, count(*) OVER (PARTITION BY {who}, us) AS tied,
  CASE WHEN row_number() OVER (PARTITION BY {who}, kind ORDER BY us, {key}) = 1 THEN 1 ELSE 0 END AS fresh
  FROM (SELECT {key}, {who}, {value} AS value, {kind} AS kind, epoch_us({ts}) AS us FROM {table}))
WINDOW w AS (PARTITION BY {who} ORDER BY us, {key}), p AS (PARTITION BY {who} ORDER BY us, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def _history(df: DataFrame, who: str, key: str, value: str, kind: str, ts: str) -> DataFrame:
    out = behaviour.behaviour_features(df, who, ts, key, value, distinct={"n_kinds": kind})
    cols = ["n_prior_claims", "n_prior_claims_30d", "n_prior_claims_90d", "days_since_first_claim", "days_since_last_claim"]
    return out.select(key, *cols, F.round(F.col("mean_prior_value") + 1e-7, 6).alias("mean_prior_value"), F.round("max_prior_value", 4).alias("max_prior_value"), r6("value_vs_prior_mean"), "is_first_claim", "n_kinds")


@query(_HISTORY.format(key="event_id", who="user_id", value="value", kind="event_type", ts="ts", table="events"))
def behaviour_history(spark, sf_dir):
    return _history(event_claims(spark, sf_dir), "user_id", "event_id", "value", "event_type", "ts")


@query(_HISTORY.format(key="o_orderkey", who="o_custkey", value="o_totalprice", kind="o_orderpriority", ts="o_orderdate", table="orders"))
def behaviour_history_ties(spark, sf_dir):
    return _history(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")


@query(f"WITH {SIGNALS} SELECT id, phone_key, email_key, pin_key, address_key FROM keys")
def canonical_keys(spark, sf_dir):
    c = canonical
    return signals(spark, sf_dir).select("id", c.phone_key(F.col("phone_raw")).alias("phone_key"), c.email_key(F.col("email_raw")).alias("email_key"), c.pin_key(F.col("pin_raw")).alias("pin_key"), c.address_key(F.col("address_raw"), False).alias("address_key"))


@query("""SELECT event_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE sha256('agent ' || CAST(user_id AS VARCHAR) || '|1080x' || CAST(user_id % 5 AS VARCHAR) || '||arial,verdana') END AS device FROM events""")
def device_keys(spark, sf_dir):
    u = F.col("user_id")
    none = u % 10 == 0
    blank = lambda c: F.when(~none, c)
    key = canonical.device_key(blank(F.concat(F.lit(" Agent "), u.cast("string"))), blank(F.concat(F.lit("1080x"), (u % 5).cast("string"))), F.lit(None).cast("string"), F.when(~none, F.array(F.lit("Verdana"), F.lit("Arial"))))
    return read(spark, sf_dir, "events").select("event_id", key.alias("device"))


@query(f"WITH {SIGNALS} SELECT id, CAST(k % 40 AS VARCHAR) AS numbers FROM keys")
def address_numbers(spark, sf_dir):
    return signals(spark, sf_dir).select("id", F.array_join(canonical.numeric_tokens(canonical.address_key(F.col("address_raw"), False)), ",").alias("numbers"))


def _keyed(spark, sf_dir):
    c = canonical
    return signals(spark, sf_dir).select("id", c.phone_key(F.col("phone_raw")).alias("phone"), c.email_key(F.col("email_raw")).alias("email"), c.address_key(F.col("address_raw"), False).alias("address"), c.pin_key(F.col("pin_raw")).alias("pin"))


@query(f"""WITH RECURSIVE {SIGNALS}, e AS (SELECT a.id AS a, b.id AS b FROM keys a JOIN keys b ON a.phone_key = b.phone_key UNION SELECT a.id, b.id FROM keys a JOIN keys b ON a.email_key = b.email_key),
 walk(id, node) AS (SELECT id, id FROM keys UNION SELECT w.id, e.b FROM walk w JOIN e ON w.node = e.a)
 SELECT id, 'entity_' || CAST(min(node) AS VARCHAR) AS entity FROM walk GROUP BY id""")
def contact_components(spark, sf_dir):
    """Links by phone and e-mail only."""
    return identity.resolve_identities(_keyed(spark, sf_dir), addresses=False)


_BARE = "CASE WHEN id % 10 = 0 THEN regexp_replace(address_key, '[0-9]+ ', '') ELSE address_key END"


def _alike(address: str) -> str:
    """SQL of p (id, pin, t) and alike (pin, x, y): different addresses of a pin at token-set similarity 85, by a table of common subsequences of what they do not share."""
    return f"""p AS (SELECT id, pin_key AS pin, {address} AS t FROM keys WHERE pin_key IS NOT NULL), ad AS (SELECT DISTINCT pin, t FROM p),
 tok AS (SELECT pin, t, list_sort(list_distinct(string_split(t, ' '))) AS ws FROM ad), num AS (SELECT *, list_filter(ws, lambda w: regexp_matches(w, '^[0-9]+$')) AS ns FROM tok),
 pr AS (SELECT a.pin, a.t AS x, b.t AS y, array_to_string(list_filter(a.ws, lambda w: list_contains(b.ws, w)), ' ') AS c, array_to_string(list_filter(a.ws, lambda w: NOT list_contains(b.ws, w)), ' ') AS ra, array_to_string(list_filter(b.ws, lambda w: NOT list_contains(a.ws, w)), ' ') AS rb
  FROM num a JOIN num b ON a.pin = b.pin AND a.t < b.t WHERE len(a.ns) = 0 OR len(b.ns) = 0 OR list_has_any(a.ns, b.ns)),
 dp(ra, rb, i, j, old, new) AS (SELECT DISTINCT ra, rb, 1, 1, [0 FOR k IN range(len(rb) + 1)], [0] FROM pr WHERE ra <> '' AND rb <> '' UNION ALL
  SELECT ra, rb, CASE WHEN j = len(rb) THEN i + 1 ELSE i END, CASE WHEN j = len(rb) THEN 1 ELSE j + 1 END, CASE WHEN j = len(rb) THEN list_append(new, v) ELSE old END, CASE WHEN j = len(rb) THEN [0] ELSE list_append(new, v) END
  FROM (SELECT *, CASE WHEN ra[i] = rb[j] THEN old[j] + 1 ELSE greatest(old[j + 1], new[j]) END AS v FROM dp WHERE i <= len(ra))),
 lc AS (SELECT ra, rb, old[len(rb) + 1] AS l FROM dp WHERE i = len(ra) + 1 AND j = 1), sh AS (SELECT pr.*, coalesce(l, 0) AS l, CASE WHEN c <> '' THEN len(c) + 1 ELSE 0 END AS g FROM pr LEFT JOIN lc USING (ra, rb)),
 alike AS (SELECT pin, x, y FROM sh WHERE CASE WHEN c <> '' AND (ra = '' OR rb = '') THEN 100 ELSE greatest(200.0 * (g + l) / (2 * g + len(ra) + len(rb)), CASE WHEN c <> '' THEN 200.0 * len(c) / (len(c) + g + least(len(ra), len(rb))) ELSE 0 END) END >= 85)"""


_PAIRS = """ SELECT least(i.id, j.id) AS a, greatest(i.id, j.id) AS b FROM alike JOIN p i ON i.pin = alike.pin AND i.t = x JOIN p j ON j.pin = alike.pin AND j.t = y
 UNION ALL SELECT i.id, j.id FROM p i JOIN p j ON i.pin = j.pin AND i.t = j.t AND i.id < j.id"""


@query(f"""WITH RECURSIVE {SIGNALS}, {_alike("address_key")}, hd AS (SELECT pin, t, min(id) AS h FROM p GROUP BY pin, t),
 st AS (SELECT min(id) OVER (PARTITION BY phone_key) AS a, id AS b FROM keys WHERE phone_key IS NOT NULL UNION SELECT min(id) OVER (PARTITION BY email_key), id FROM keys UNION SELECT h, id FROM p JOIN hd USING (pin, t)
  UNION SELECT i.h, j.h FROM alike JOIN hd i ON i.pin = alike.pin AND i.t = x JOIN hd j ON j.pin = alike.pin AND j.t = y),
 e AS (SELECT a, b FROM st WHERE a <> b UNION SELECT b, a FROM st WHERE a <> b), walk(id, node) AS (SELECT id, id FROM keys UNION SELECT w.id, e.b FROM walk w JOIN e ON w.node = e.a)
 SELECT id, 'entity_' || CAST(min(node) AS VARCHAR) AS entity FROM walk GROUP BY id""")
def identity_components(spark, sf_dir):
    """All three kinds of links: phone, e-mail and similar addresses."""
    return identity.resolve_identities(_keyed(spark, sf_dir))


@query(f"WITH RECURSIVE {SIGNALS}, {_alike('address_key')}{_PAIRS}")
def blocked_address_pairs(spark, sf_dir):
    """Pairs of one pin whose numbers agree and whose addresses are alike at the production similarity."""
    return identity.address_pairs(_keyed(spark, sf_dir))


@query(f"WITH RECURSIVE {SIGNALS}, {_alike(_BARE)}{_PAIRS}")
def open_address_pairs(spark, sf_dir):
    """As ``blocked_address_pairs``, where every tenth address has no number and meets its whole pin."""
    bare = F.when(F.col("id") % 10 == 0, F.regexp_replace("address", "[0-9]+ ", "")).otherwise(F.col("address"))
    return identity.address_pairs(_keyed(spark, sf_dir).withColumn("address", bare))


@query(f"""WITH {SIGNALS} SELECT a.id AS a, b.id AS b FROM keys a JOIN keys b ON a.pin_key = b.pin_key AND a.address_key = b.address_key AND a.id < b.id""")
def equal_address_pairs(spark, sf_dir):
    """At similarity 100, which only equal token sets reach here."""
    return identity.address_pairs(_keyed(spark, sf_dir), 100.0)


@query("SELECT c_custkey AS id, 'phlaita ' || CAST(c_custkey % 40 AS VARCHAR) || ' naii roda ' || lower(c_mktsegment) AS address_key FROM customer")
def romanised_addresses(spark, sf_dir):
    """Addresses in another script, digits included, with full-width letters."""
    n = F.translate((F.col("c_custkey") % 40).cast("string"), "0123456789", "०१२३४५६७८९")
    raw = F.concat_ws(" ", F.lit("फ्लैट"), n, F.lit("नई रोड, ｔｈｅ"), F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), canonical.address_key(raw).alias("address_key"))


@query(f"""WITH {HASHED}, x AS (SELECT a.id AS q, b.id AS c, list_sum([CAST(a.bits[i + 1] <> b.bits[i + 1] AS INT) FOR i IN range(64)]) AS hamming,
  list_bool_or([a.bits[4 * i + 1:4 * i + 4] = b.bits[4 * i + 1:4 * i + 4] FOR i IN range(16)]) AS met FROM h a JOIN h b ON b.id < a.id)
 SELECT q, c, CAST(hamming AS INT) AS hamming FROM x WHERE met""")
def band_candidates(spark, sf_dir):
    return reuse.band_candidates(hashed_claims(spark, sf_dir))


_PAIR = f"""{HASHED}, d AS (SELECT a.id AS q, b.id AS c, list_sum([CAST(a.bits[i + 1] <> b.bits[i + 1] AS INT) FOR i IN range(64)]) AS hamming,
 list_sum([CAST(a.embedding[i + 1] AS DOUBLE) * b.embedding[i + 1] FOR i IN range(64)]) AS sim FROM h a JOIN h b ON b.id < a.id)"""


@query(f"WITH {_PAIR} SELECT q, c, CAST(hamming AS INT) AS hamming FROM d WHERE hamming <= 18")
def near_hash_pairs(spark, sf_dir):
    return reuse.near_hash_pairs(hashed_claims(spark, sf_dir), 18)


@query(f"WITH {_PAIR} SELECT q, c, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS n FROM d) WHERE n <= 20")
def vector_top20(spark, sf_dir):
    return reuse.similar_vectors(hashed_claims(spark, sf_dir)).select("q", "c", r6("similarity"))


@query(f"""WITH {_PAIR}, t AS (SELECT q, c, sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS n FROM d) WHERE n <= 20),
 hp AS (SELECT q, c, hamming FROM d WHERE hamming <= 20), m AS (SELECT q, c, hamming, NULL AS sim FROM hp WHERE hamming <= 18 UNION ALL SELECT q, c, 64, sim FROM t WHERE sim >= 0.35 AND NOT EXISTS (SELECT 1 FROM hp WHERE hp.q = t.q AND hp.c = t.c AND hp.hamming <= 18)),
 f AS (SELECT m.q, count(*) AS n, count(DISTINCT CASE WHEN b.claimant <> a.claimant THEN b.claimant END) AS cl, count(DISTINCT b.merchant) AS me, min(hamming) AS mh, max(coalesce(sim, 0)) AS mc, min(b.id) AS first
  FROM m JOIN h a ON a.id = m.q JOIN h b ON b.id = m.c GROUP BY m.q)
 SELECT h.id, coalesce(n, 0) AS n_matches, coalesce(cl, 0) AS n_distinct_claimants, coalesce(me, 0) AS n_distinct_merchants, CAST(coalesce(mh, 64) AS INT) AS min_hamming, round(coalesce(mc, 0), 6) AS max_clip,
  coalesce((h.id - first) * 3600 // 86400, 0) AS days_since_first_seen, coalesce(n, 0) > 0 AS matched_prior_claim,
  CAST(coalesce((SELECT min(hamming) FROM hp WHERE hp.q = h.id), 64) AS INT) AS best_hamming, round(greatest(0, coalesce((SELECT max(sim) FROM t WHERE t.q = h.id), 0)), 6) AS best_clip,
  coalesce((SELECT count(*) FROM (SELECT q, c FROM hp UNION SELECT q, c FROM t) u WHERE u.q = h.id), 0) AS n_candidates_examined
 FROM h LEFT JOIN f ON f.q = h.id""")
def reuse_features(spark, sf_dir):
    claims = hashed_claims(spark, sf_dir)
    hashes, vectors = written(reuse.near_hash_pairs(claims, 20), "hashes"), written(reuse.similar_vectors(claims), "similar")
    out = reuse.reuse_features(claims, hashes, vectors, 18, 0.35)
    return out.withColumns({c: F.round(c, 6) for c in ("max_clip", "best_clip")})


@query(f"""WITH {_PAIR}, v AS (SELECT 'honest' AS variant, q FROM d WHERE hamming <= 18 UNION SELECT 'leaky', q FROM d WHERE hamming <= 18 UNION SELECT 'leaky', c FROM d WHERE hamming <= 18)
 SELECT variant, round(avg(CAST(hit AS DOUBLE)), 6) AS match_rate, round(coalesce(avg(CASE WHEN label = 0 THEN CAST(hit AS DOUBLE) END), 0), 6) AS honest_match_rate FROM
 (SELECT n.variant, h.id, h.label, CAST(v.q IS NOT NULL AS INT) AS hit FROM h CROSS JOIN (VALUES ('honest'), ('leaky')) n(variant) LEFT JOIN v ON v.q = h.id AND v.variant = n.variant) GROUP BY variant""")
def temporal_leak_control(spark, sf_dir):
    return reuse.leak_control(hashed_claims(spark, sf_dir), 18).select("variant", r6("match_rate"), r6("honest_match_rate"))


@query()
def ring_features(spark, sf_dir):
    claims = hashed_claims(spark, sf_dir)
    return rings.ring_features(claims.select("id", "claimant", "merchant", "ts"), reuse.near_hash_pairs(claims, 18).select("q", "c"))


@query(f"""WITH RECURSIVE {_PAIR}, e AS (SELECT q AS a, c AS b FROM d WHERE hamming <= 18 UNION SELECT c, q FROM d WHERE hamming <= 18),
 walk(id, node) AS (SELECT id, id FROM h UNION SELECT w.id, e.b FROM walk w JOIN e ON w.node = e.a), g AS (SELECT id, min(node) AS component FROM walk GROUP BY id)
 SELECT component, count(*) AS size, count(DISTINCT claimant) AS claimants, count(DISTINCT merchant) AS merchants, round((max(id) - min(id)) / 24.0, 6) AS span_days FROM g JOIN h USING (id) GROUP BY component HAVING count(DISTINCT claimant) >= 2""")
def ring_clusters(spark, sf_dir):
    claims = hashed_claims(spark, sf_dir)
    return rings.ring_clusters(claims, reuse.near_hash_pairs(claims, 18)).withColumn("span_days", F.round("span_days", 6))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'UNKNOWN' WHEN event_id % 5 = 1 THEN 'INVALID' WHEN event_id % 5 = 2 THEN 'VALID_AI_GENERATED' WHEN event_id % 5 = 3 THEN 'VALID_EDITED' ELSE 'VALID_CAMERA' END AS status,
 CAST(event_id % 5 > 0 AS DOUBLE) AS has_manifest, CAST(event_id % 5 > 1 AS DOUBLE) AS manifest_valid, CAST(event_id % 5 = 2 AS DOUBLE) AS declares_ai_generation,
 CAST(event_id % 5 >= 3 AS DOUBLE) AS declares_camera_capture, CAST(event_id % 5 = 3 AS DOUBLE) AS declares_editing, CAST(CASE WHEN event_id % 5 = 2 THEN 1 WHEN event_id % 5 = 3 THEN 2 WHEN event_id % 5 = 4 THEN 1 ELSE 0 END AS DOUBLE) AS n_assertions FROM events""")
def provenance_status(spark, sf_dir):
    k = F.col("event_id") % 5
    made = lambda *a: F.lit('{"active_manifest":"m","manifests":{"m":{"assertions":[' + ",".join(f'{{"label":"{x}"}}' for x in a) + "]}}}")
    manifest = F.when(k == 1, "{not json").when(k == 2, made("digitalSourceType/trainedAlgorithmicMedia")).when(k == 3, made("c2pa.captured", "c2pa.edited")).when(k == 4, made("c2pa.captured"))
    return read(spark, sf_dir, "events").withColumn("m", manifest).select("event_id", provenance.provenance(F.col("m")).alias("s")).select("event_id", "s.*")


@query("""SELECT event_id, round(least(1, greatest(0, 0.5 + CASE WHEN event_id % 3 = 0 THEN 0.25 + least(0.15, 0.05 * (event_id % 5)) ELSE 0 END + CASE WHEN event_id % 6 = 0 THEN 0.15 ELSE 0 END
 + CASE WHEN event_id % 11 = 0 THEN 0.4 WHEN event_id % 7 = 0 THEN -0.1 ELSE 0 END + least(0.2, 2 * ((event_id % 13) / 100.0)) + CASE WHEN event_id % 4 > 0 THEN CASE WHEN value > 100 THEN 0.1 ELSE 0 END + CASE WHEN event_id % 4 >= 3 THEN 0.1 ELSE 0 END ELSE 0 END)), 6) AS score FROM events""")
def interim_scores(spark, sf_dir):
    k = F.col("event_id")
    f = {"matched": (k % 3 == 0), "sharing": k % 5, "in_ring": (k % 6 == 0), "ai_declared": (k % 11 == 0), "camera_declared": (k % 7 == 0), "thumbnail": F.when(k % 13 == 0, F.lit(float("nan"))).otherwise((k % 13) / 100.0), "n_prior": k % 4, "value_ratio": F.when(F.col("value") > 100, 4.0).otherwise(1.0), "n_prior_30d": k % 4}
    f = {n: c.cast("double") for n, c in f.items()}
    return read(spark, sf_dir, "events").select("event_id", F.round(reuse.interim_score(f), 6).alias("score"))


@query(f"WITH {SCORES} SELECT round(avg(pow(p - y, 2)), 6) AS brier, count(*) AS n FROM s")
def brier(spark, sf_dir):
    return scores(spark, sf_dir).agg(F.round(metrics.brier_score("p", "y"), 6).alias("brier"), F.count("*").alias("n"))


_BINS = f"WITH {SCORES}, b AS (SELECT *, ntile(10) OVER (ORDER BY p, id) AS bin FROM s), c AS (SELECT bin, avg(p) AS mp, avg(y) AS ro, count(*) AS n FROM b GROUP BY bin)"


@query(_BINS + " SELECT CAST(bin AS INT) AS bin, round(mp, 6) AS mean_predicted, round(ro, 6) AS observed_rate, n FROM c")
def reliability_curve(spark, sf_dir):
    return metrics.calibration_bins(scores(spark, sf_dir), "p", "y", "id").select("bin", r6("mean_predicted"), r6("observed_rate"), "n")


@query(_BINS + " SELECT round(sum(abs(mp - ro) * n) / sum(n), 6) AS ece, round(max(abs(mp - ro)), 6) AS mce, CAST(sum(n) AS BIGINT) AS n FROM c")
def calibration_error(spark, sf_dir):
    return metrics.calibration_error(scores(spark, sf_dir), "p", "y", "id").select(r6("ece"), r6("mce"), "n")


@query(f"""WITH {SCORES}, b AS (SELECT *, ntile(10) OVER (PARTITION BY grp ORDER BY p, id) AS bin FROM s), c AS (SELECT grp, bin, avg(p) AS mp, avg(y) AS ro, count(*) AS n FROM b GROUP BY grp, bin)
 SELECT grp, round(sum(abs(mp - ro) * n) / sum(n), 6) AS ece, round(max(abs(mp - ro)), 6) AS mce, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY grp HAVING sum(n) >= 30 ORDER BY 2 DESC, 1 LIMIT 5""")
def worst_groups(spark, sf_dir):
    return metrics.calibration_error(scores(spark, sf_dir), "p", "y", "id", group="grp", least=30).select("grp", r6("ece"), r6("mce"), "n").orderBy(F.desc("ece"), "grp").limit(5)


@query(f"""WITH {SCORES}, q AS (SELECT round(p, 2) AS p, y FROM s), g AS (SELECT p, sum(y) AS tp, count(*) AS c FROM q GROUP BY p), w AS (SELECT tp, sum(tp) OVER (ORDER BY p DESC) AS ct, sum(c) OVER (ORDER BY p DESC) AS cc, sum(tp) OVER () AS pos FROM g)
 SELECT round(sum(tp * (ct / cc) / pos), 6) AS pr_auc, round(coalesce(max(CASE WHEN ct / pos >= 0.9 THEN ct / cc END), 0), 6) AS precision_at_recall, round(coalesce(max(CASE WHEN ct / cc >= 0.95 THEN ct / pos END), 0), 6) AS recall_at_precision FROM w""")
def ranking_metrics(spark, sf_dir):
    rows = scores(spark, sf_dir).withColumn("p", F.round("p", 2))
    return metrics.ranking_metrics(rows, "p", "y").select(r6("pr_auc"), r6("precision_at_recall"), r6("recall_at_precision"))


@query()
def exact_ranking_metrics(spark, sf_dir):
    """As ``ranking_metrics``, on the scores as they are."""
    return metrics.ranking_metrics(scores(spark, sf_dir), "p", "y").select(r6("pr_auc"), r6("precision_at_recall"), r6("recall_at_precision"))


@query("""WITH x AS (SELECT 'value' AS feature, value AS x, CAST(event_id % 2 AS INT) AS side FROM events UNION ALL SELECT 'user', CAST(user_id AS DOUBLE), CAST(event_id % 2 AS INT) FROM events),
 e AS (SELECT feature, list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS ed FROM x WHERE side = 0 GROUP BY feature), i AS (SELECT feature, list_sort(ed)[2:len(ed) - 1] AS inn FROM e),
 b AS (SELECT x.feature, side, len(list_filter(inn, lambda v: v <= x.x)) AS bin FROM x JOIN i ON i.feature = x.feature), n AS (SELECT feature, bin, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS c FROM b GROUP BY feature, bin),
 p AS (SELECT feature, greatest(r / sum(r) OVER (PARTITION BY feature), 0.000001) AS rp, greatest(c / sum(c) OVER (PARTITION BY feature), 0.000001) AS cp FROM n), psi AS (SELECT feature, sum((cp - rp) * ln(cp / rp)) AS psi FROM p GROUP BY feature),
 d AS (SELECT feature, x, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS c FROM x GROUP BY feature, x), u AS (SELECT feature, abs(sum(r) OVER (PARTITION BY feature ORDER BY x) / sum(r) OVER (PARTITION BY feature) - sum(c) OVER (PARTITION BY feature ORDER BY x) / sum(c) OVER (PARTITION BY feature)) AS gap FROM d),
 k AS (SELECT feature, max(gap) AS ks FROM u GROUP BY feature)
 SELECT psi.feature, round(psi, 6) AS psi, round(ks, 6) AS ks, CASE WHEN psi >= 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS severity FROM psi JOIN k ON k.feature = psi.feature""")
def drift_report(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("value"), F.col("user_id").cast("double").alias("user"), (F.col("event_id") % 2).alias("side"))
    return metrics.drift_report(e.where("side = 0"), e.where("side = 1"), ["value", "user"]).select("feature", r6("psi"), r6("ks"), "severity")


@query(f"""WITH {SCORES}, g AS (SELECT round(50 + i, 0) / 100 AS threshold FROM range(50) r(i)) SELECT round(threshold, 4) AS threshold, count(*) FILTER (p >= threshold) AS n_denied, count(*) FILTER (p >= threshold AND y = 0) AS n_legit_denied, count(*) AS n_total FROM g CROSS JOIN s GROUP BY threshold""")
def threshold_counts(spark, sf_dir):
    return risk.threshold_counts(scores(spark, sf_dir), "p", "y", [round(i / 100, 4) for i in range(50, 100)])


_MESSY = "CASE WHEN (id * 31) % 100 < 3 THEN 1 - y ELSE y END"


@query(f"""WITH {SCORES}, z AS (SELECT p, {_MESSY} AS y FROM s), g AS (SELECT (50 + i) / 100.0::DOUBLE AS threshold FROM range(50) r(i)),
 c AS (SELECT threshold, count(*) FILTER (p >= threshold) AS nd, count(*) FILTER (p >= threshold AND y = 0) AS nl, count(*) AS nt FROM g CROSS JOIN z GROUP BY threshold),
 r AS (SELECT *, nl / nd AS rate FROM c WHERE nd >= 64), hb AS (SELECT threshold, nd, nl, nt, rate, CASE WHEN rate >= 0.1 THEN 1 ELSE least(1, exp(-nd * (greatest(rate, 1e-12) * ln(greatest(rate, 1e-12) / 0.1) + (1 - greatest(rate, 1e-12)) * ln((1 - greatest(rate, 1e-12)) / 0.9))),
   exp(1) * (SELECT sum(exp(lgamma(nd + 1) - lgamma(k + 1) - lgamma(nd - k + 1) + k * ln(0.1) + (nd - k) * ln(0.9))) FROM range(20000) q(k) WHERE k <= ceil(nd * rate))) END AS pv FROM r),
 w AS (SELECT *, coalesce(sum(CAST(pv > 0.1 AS INT)) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM hb)
 SELECT threshold, nd AS n_denied, nl AS n_legit_denied, round(rate, 6) AS rate, round(pv, 6) AS p_value, pv <= 0.1 AS certified FROM w WHERE failed = 0""")
def certified_thresholds(spark, sf_dir):
    rows = scores(spark, sf_dir).withColumn("y", F.expr(_MESSY))
    out = risk.certify_thresholds(rows, "p", "y", 0.10, 0.10).where("not skipped")
    return out.select("threshold", "n_denied", "n_legit_denied", r6("rate"), r6("p_value"), "certified")


_HB = """CASE WHEN rate >= alpha THEN 1 ELSE least(1, exp(-nd * (greatest(rate, 1e-12) * ln(greatest(rate, 1e-12) / alpha) + (1 - greatest(rate, 1e-12)) * ln((1 - greatest(rate, 1e-12)) / (1 - alpha)))),
   exp(1) * (SELECT sum(exp(lgamma(nd + 1) - lgamma(k + 1) - lgamma(nd - k + 1) + k * ln(alpha) + (nd - k) * ln(1 - alpha))) FROM range(20000) q(k) WHERE k <= ceil(nd * rate))) END"""


@query(f"""WITH {SCORES}, z AS (SELECT p, {_MESSY} AS y FROM s), g AS (SELECT (50 + i) / 100.0::DOUBLE AS threshold FROM range(50) r(i)),
 c AS (SELECT threshold, count(*) FILTER (p >= threshold) AS nd, count(*) FILTER (p >= threshold AND y = 0) AS nl FROM g CROSS JOIN z GROUP BY threshold),
 l AS (SELECT * FROM (VALUES (0, 0.03::DOUBLE, 0.1::DOUBLE, 222), (1, 0.05::DOUBLE, 0.1::DOUBLE, 131), (2, 0.1::DOUBLE, 0.1::DOUBLE, 64), (3, 0.1::DOUBLE, 0.2::DOUBLE, {risk.min_n_for_rate(0.1, 0.2, 0.03)})) v(rung, alpha, delta, least)),
 r AS (SELECT *, nd < least AS skipped, nl / greatest(nd, 1) AS rate FROM c CROSS JOIN l), t AS (SELECT *, CASE WHEN NOT skipped THEN {_HB} END AS pv FROM r),
 w AS (SELECT *, coalesce(pv <= delta, false) AS ok, coalesce(sum(CASE WHEN NOT skipped AND pv > delta THEN 1 ELSE 0 END) OVER (PARTITION BY rung ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM t),
 x AS (SELECT * FROM w WHERE failed = 0)
 SELECT rung, alpha, delta, threshold, nd AS n_denied, nl AS n_legit_denied, skipped, round(pv, 6) AS p_value, ok AS certified FROM x WHERE rung <= coalesce((SELECT min(rung) FROM x WHERE ok), 9)""")
def ladder_walk(spark, sf_dir):
    rows = scores(spark, sf_dir).withColumn("y", F.expr(_MESSY))
    return risk.walk_ladder(rows, "p", "y").select("rung", "alpha", "delta", "threshold", "n_denied", "n_legit_denied", "skipped", r6("p_value"), "certified")


@query("""SELECT * FROM (VALUES (0.03::DOUBLE, 0.0::DOUBLE, 76), (0.03::DOUBLE, 0.3::DOUBLE, 222), (0.03::DOUBLE, 0.5::DOUBLE, 489), (0.05::DOUBLE, 0.0::DOUBLE, 45), (0.05::DOUBLE, 0.3::DOUBLE, 131), (0.05::DOUBLE, 0.5::DOUBLE, 288),
 (0.1::DOUBLE, 0.0::DOUBLE, 30), (0.1::DOUBLE, 0.3::DOUBLE, 64), (0.1::DOUBLE, 0.5::DOUBLE, 134)) t(alpha, fraction, min_denied)""")
def power_curve(spark, sf_dir):
    return risk.power_curve(spark, [0.03, 0.05, 0.10], [0.0, 0.3, 0.5])


@query(f"""WITH {SCORES} SELECT sha256(string_agg(CAST(id AS VARCHAR) || chr(9) || CAST(y AS VARCHAR) || chr(9) || 'sha' || CAST(id % 97 AS VARCHAR), chr(10) ORDER BY CAST(id AS VARCHAR) || chr(9) || CAST(y AS VARCHAR) || chr(9) || 'sha' || CAST(id % 97 AS VARCHAR)) || chr(10)) AS content_sha256, count(*) AS n_claims, CAST(sum(y) AS BIGINT) AS n_fraud FROM s WHERE ts >= TIMESTAMP '1997-01-01'""")
def calibration_seal(spark, sf_dir):
    rows = scores(spark, sf_dir).where("ts >= timestamp_ntz '1997-01-01'").withColumn("sha", F.concat(F.lit("sha"), (F.col("id") % 97).cast("string")))
    return risk.calibration_seal(rows, "id", "y", "sha")


@query(f"""WITH {SCORES} SELECT id, round(p * (v + 180), 4) AS approve, round((1 - p) * (v + 250 + 0.35 * 3000), 4) AS deny, CASE WHEN p * (v + 180) <= (1 - p) * (v + 1300) AND p * (v + 180) <= 40 THEN 'APPROVE' WHEN (1 - p) * (v + 1300) <= 40 THEN 'DENY' ELSE 'REVIEW' END AS action FROM s""")
def expected_costs(spark, sf_dir):
    costs, p, v = policy.Costs(), F.col("p"), F.col("v")
    c = costs.expected(p, v)
    return scores(spark, sf_dir).select("id", F.round(c["APPROVE"], 4).alias("approve"), F.round(c["DENY"], 4).alias("deny"), costs.optimal_action(p, v).alias("action"))


@query(f"""WITH {SCORES}, a AS (SELECT *, CASE WHEN p >= 0.8 THEN 'DENY' WHEN p <= 0.1 THEN 'APPROVE' ELSE 'REVIEW' END AS act FROM s) SELECT round(avg(CAST(act = 'APPROVE' AS INT)), 6) AS approve_rate, round(avg(CAST(act = 'REVIEW' AS INT)), 6) AS review_rate, round(avg(CAST(act = 'DENY' AS INT)), 6) AS deny_rate,
 round(sum(CASE WHEN act = 'APPROVE' AND y = 1 THEN v + 180 WHEN act = 'DENY' AND y = 0 THEN v + 1300 WHEN act = 'REVIEW' THEN 40 ELSE 0 END) / count(*) * 1000, 2) AS cost_per_1000 FROM a""")
def policy_summary(spark, sf_dir):
    return policy.policy_summary(scores(spark, sf_dir), "p", "y", "v", 0.1, 0.8).select(r6("approve_rate"), r6("review_rate"), r6("deny_rate"), F.round("cost_per_1000", 2).alias("cost_per_1000"))


@query(f"""WITH {SCORES}, a AS (SELECT -1.0::DOUBLE AS ta UNION ALL SELECT i / 100.0::DOUBLE FROM range(51) r(i)), d AS (SELECT (50 + i) / 100.0::DOUBLE AS td FROM range(0, 50, 10) r(i)),
 c AS (SELECT ta, td, sum(CASE WHEN p >= td THEN CASE WHEN y = 0 THEN v + 1300 ELSE 0 END WHEN p <= ta THEN CASE WHEN y = 1 THEN v + 180 ELSE 0 END ELSE 40 END) / count(*) * 1000 AS cost FROM a CROSS JOIN d CROSS JOIN s WHERE ta < td GROUP BY ta, td)
 SELECT ta AS t_approve, td AS t_deny, round(cost, 2) AS cost_per_1000, true AS certified FROM c ORDER BY cost, td DESC, ta LIMIT 1""")
def selected_policy(spark, sf_dir):
    certified = [round(0.9 - i / 10, 4) for i in range(5)]
    return policy.select_policy(scores(spark, sf_dir), "p", "y", "v", certified).withColumn("cost_per_1000", F.round("cost_per_1000", 2))


@query(f"""WITH {SCORES}, a AS (SELECT *, CASE WHEN p >= 0.5 THEN 'DENY' WHEN p <= 0.1 THEN 'APPROVE' ELSE 'REVIEW' END AS action, CAST('0x' || substr(sha256('1337:' || CAST(id AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM s), e AS (SELECT *, action = 'DENY' AND u < 0.05 AS ex FROM a)
 SELECT count(*) FILTER (ex) AS n_explored, CAST(sum(CASE WHEN ex AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_fraud, round(coalesce(sum(CASE WHEN ex AND y = 1 THEN v + 180 END), 0), 2) AS cost, round(coalesce(sum(CASE WHEN ex AND y = 0 THEN v + 1300 END), 0), 2) AS saved,
 round(avg(CAST(action = 'DENY' AS INT)), 6) AS deny_share, round(count(*) FILTER (ex) / count(*) FILTER (action = 'DENY'), 6) AS observed_share FROM e""")
def exploration(spark, sf_dir):
    log = policy.explore(scores(spark, sf_dir).withColumn("action", policy.decide(F.col("p"), 0.1, 0.5)), "action", "id", 0.05)
    a = policy.exploration_cost(log, "y", "v").withColumns({"cost": F.round("cost", 2), "saved": F.round("saved", 2)})
    return a.join(policy.censoring_report(log).select(r6("deny_share"), r6("observed_share")), F.lit(True))


_Q = {"APPROVE": "-(p * (v + 180))", "REVIEW": "-40.0", "DENY": "-((1 - p) * (v + 1300))"}


@query(f"""WITH {SCORES}, a AS (SELECT *, CASE WHEN p >= 0.5 THEN CASE WHEN id % 20 = 0 THEN 'APPROVE' ELSE 'DENY' END WHEN p <= 0.1 THEN 'APPROVE' ELSE 'REVIEW' END AS act, CASE WHEN p >= 0.5 THEN CASE WHEN id % 20 = 0 THEN 0.05::DOUBLE ELSE 0.95::DOUBLE END ELSE 1::DOUBLE END AS prop,
  CASE WHEN p >= 0.9 THEN 'DENY' WHEN p <= 0.2 THEN 'APPROVE' ELSE 'REVIEW' END AS tgt FROM s),
 b AS (SELECT *, CASE WHEN act = 'APPROVE' THEN -y * (v + 180) WHEN act = 'DENY' THEN -(1 - y) * (v + 1300) ELSE -40 END AS r, CASE act WHEN 'APPROVE' THEN {_Q['APPROVE']} WHEN 'DENY' THEN {_Q['DENY']} ELSE -40 END AS ql, CASE tgt WHEN 'APPROVE' THEN {_Q['APPROVE']} WHEN 'DENY' THEN {_Q['DENY']} ELSE -40 END AS direct, CASE WHEN act = tgt THEN 1 / prop ELSE 0 END AS w FROM a),
 c AS (SELECT *, least(w, 10) AS wc FROM b) SELECT round(avg(direct + wc * (r - ql)), 2) AS dr_value, round(avg(direct), 2) AS direct_term, round(avg(wc * (r - ql)), 2) AS correction_term, count(*) AS n, round(avg(CAST(w > 10 AS INT)), 6) AS clipped_fraction, round(pow(sum(wc), 2) / sum(wc * wc), 4) AS effective_sample_size,
 round(stddev_samp(direct + wc * (r - ql)) / sqrt(count(*)), 2) AS standard_error, round(avg(CAST(act = tgt AS INT)), 6) AS mean_target_prob, round(avg(CAST(act <> tgt AS INT)), 6) AS off_support, round(max(w), 6) AS max_weight, round(avg(w), 6) AS mean_weight FROM c""")
def doubly_robust(spark, sf_dir):
    p, v, k = F.col("p"), F.col("v"), F.col("id") % 20 == 0
    q = policy.reward_model(p, v)
    act = F.when(p >= 0.5, F.when(k, "APPROVE").otherwise("DENY")).when(p <= 0.1, "APPROVE").otherwise("REVIEW")
    rows = scores(spark, sf_dir).withColumns({"act": act, "prop": F.when(p >= 0.5, F.when(k, 0.05).otherwise(0.95)).otherwise(1.0), "tgt": policy.decide(p, 0.2, 0.9), **{f"q_{a}": c for a, c in q.items()}})
    rows = rows.withColumns({**{f"t_{a}": (F.col("tgt") == a).cast("double") for a in q}, "r": -policy.Costs().realised(F.col("act"), F.col("y"), v)})
    out = policy.doubly_robust(rows, "r", "act", "prop", {a: f"q_{a}" for a in q}, {a: f"t_{a}" for a in q})
    digits = {"dr_value": 2, "direct_term": 2, "correction_term": 2, "standard_error": 2, "effective_sample_size": 4}
    return out.select(*[F.round(c, digits.get(c, 6)).alias(c) if c != "n" else F.col(c) for c in out.columns])


@query("""WITH m AS (SELECT o_orderdate <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 120 DAY AS ok FROM orders) SELECT count(*) AS n_total, count(*) FILTER (ok) AS n_mature, count(*) FILTER (NOT ok) AS n_censored, round(avg(CAST(ok AS INT)), 6) AS mature_rate FROM m""")
def maturity(spark, sf_dir):
    out = policy.maturity_report(read(spark, sf_dir, "orders"), "o_orderdate")
    return out.withColumn("mature_rate", F.round("mature_rate", 6))


_SPLIT = "CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'calibration' ELSE 'test' END"


def _splits(spark, sf_dir):
    d = F.col("o_orderdate")
    split = F.when(d < F.to_timestamp_ntz(F.lit("1995-01-01 00:00:00")), "train").when(d < F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00")), "calibration").otherwise("test")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), d.alias("ts"), split.alias("split"), F.col("o_custkey").alias("entity"), (F.col("o_orderkey") % 5000).alias("grp"))


@query(f"SELECT o_custkey AS entity, array_to_string(list_sort(list_distinct(list({_SPLIT}))), ',') AS splits, count(*) AS members FROM orders GROUP BY 1 HAVING count(DISTINCT {_SPLIT}) > 1")
def split_leakage(spark, sf_dir):
    return identity.leakage_violations(_splits(spark, sf_dir)).withColumn("splits", F.array_join("splits", ","))


@query(f"SELECT o_orderkey % 5000 AS grp, count(DISTINCT {_SPLIT}) AS n_splits FROM orders GROUP BY 1 HAVING count(DISTINCT {_SPLIT}) > 1")
def group_violations(spark, sf_dir):
    return identity.group_violations(_splits(spark, sf_dir), "grp")


@query("""WITH s AS (SELECT o_orderdate AS ts, CASE WHEN o_custkey % 50 = 0 AND o_orderdate >= TIMESTAMP '1995-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'calibration' ELSE 'test' END AS split FROM orders),
 m AS (SELECT split, min(ts) AS oldest, max(ts) AS newest, CASE split WHEN 'train' THEN 1 WHEN 'calibration' THEN 2 ELSE 3 END AS place FROM s GROUP BY split), l AS (SELECT split, oldest, lag(split) OVER (ORDER BY place) AS previous, lag(newest) OVER (ORDER BY place) AS before FROM m)
 SELECT previous, split, CAST(before AS VARCHAR) AS previous_newest, CAST(oldest AS VARCHAR) AS oldest FROM l WHERE before >= oldest""")
def temporal_violations(spark, sf_dir):
    """Customers that were put to the first split whatever their time break its end, and no other."""
    rows = _splits(spark, sf_dir).withColumn("split", F.when((F.col("entity") % 50 == 0) & (F.col("split") != "train"), "train").otherwise(F.col("split")))
    return identity.temporal_violations(rows, ["train", "calibration", "test"]).select("previous", "split", F.date_format("previous_newest", "yyyy-MM-dd HH:mm:ss").alias("previous_newest"), F.date_format("oldest", "yyyy-MM-dd HH:mm:ss").alias("oldest"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderdate AS ts, {_SPLIT} AS split, o_custkey AS c FROM orders), f AS (SELECT *, min(id) OVER (PARTITION BY c) AS component, first_value(split) OVER (PARTITION BY c ORDER BY ts, id) AS kept FROM o)
 SELECT id, component, kept AS kept_split, split <> kept AS dropped FROM f""")
def reconciled_splits(spark, sf_dir):
    rows = _splits(spark, sf_dir)
    first = rows.groupBy("entity").agg(F.min("id").alias("a"))
    edges = rows.join(first, "entity").select("a", F.col("id").alias("b"))
    return identity.reconcile_splits(rows, edges).select("id", "component", "kept_split", "dropped")


@query(f"""WITH {HASHED}, b AS (SELECT id % 500 AS cluster, arg_min(claimant, id) AS first_group, count(DISTINCT claimant) AS groups, count(DISTINCT merchant) AS merchants, max(id) AS last FROM h GROUP BY 1),
 r AS (SELECT h.id, groups, first_group = claimant AS own, last, CASE WHEN first_group = claimant THEN 'first_seen' WHEN groups < 2 OR merchants < 2 THEN 'not_independent' ELSE '' END AS reason FROM h JOIN b ON b.cluster = h.id % 500)
 SELECT id, true AS in_index, own AS is_first_seen, groups AS independent_groups, reason = '' AS actionable, CASE WHEN reason = '' THEN round(pow(0.5, ((1767225600 - 1735689600 - last * 3600) // 86400) / 180.0), 6) ELSE 0 END AS decayed_weight, reason AS suppression_reason FROM r""")
def federated_answers(spark, sf_dir):
    """Every 500th claim shows the same evidence: here the hash is that of the claim's class."""
    posts = hashed_claims(spark, sf_dir).select("id", F.xxhash64(F.col("id") % 500).alias("phash"), F.col("claimant").alias("identity_group"), "merchant", "ts")
    as_of = F.lit(1767225600000000)
    return federated.query_index(posts, federated.cluster_evidence(posts, _KEY), federated.published_bands(posts, _KEY), _KEY, as_of).withColumn("decayed_weight", F.round("decayed_weight", 6))


@query("SELECT event_id, round(pow(0.5, (date_diff('day', ts::DATE, DATE '2024-12-31')) / 180.0), 6) AS weight FROM events")
def decayed_weights(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(federated.half_life_weight(F.datediff(F.lit("2024-12-31").cast("date"), F.col("ts").cast("date"))), 6).alias("weight"))


@query("""WITH RECURSIVE e AS (SELECT event_id AS id, event_id % 7 AS merchant, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_id % 7 ORDER BY ts, event_id) AS n FROM events),
 w(merchant, n, id, accepted, taken) AS (SELECT merchant, n, id, true, [us] FROM e WHERE n = 1 UNION ALL
  SELECT merchant, n, id, len(held) < 20, CASE WHEN len(held) < 20 THEN list_append(held, us) ELSE held END FROM (SELECT e.merchant, e.n, e.id, e.us, list_filter(w.taken, lambda x: x > e.us - 86400000000) AS held FROM w JOIN e ON e.merchant = w.merchant AND e.n = w.n + 1))
 SELECT id, merchant, accepted FROM w""")
def rate_limits(spark, sf_dir):
    return federated.rate_limited(event_claims(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("merchant"), "ts"), 20).select("id", "merchant", "accepted")


@query(f"""WITH RECURSIVE e AS (SELECT event_id % 7 AS log, event_id AS seq, event_type AS payload, row_number() OVER (PARTITION BY event_id % 7 ORDER BY event_id) AS n FROM events),
 w(log, n, seq, payload, prev, entry_hash) AS (SELECT log, n, seq, payload, repeat('0', 64), {_hmac("'{\"payload\":\"' || payload || '\",\"prev\":\"' || repeat('0', 64) || '\"}'")} FROM e WHERE n = 1 UNION ALL
  SELECT e.log, e.n, e.seq, e.payload, w.entry_hash, {_hmac("'{\"payload\":\"' || e.payload || '\",\"prev\":\"' || w.entry_hash || '\"}'")} FROM w JOIN e ON e.log = w.log AND e.n = w.n + 1)
 SELECT log, seq, payload, prev, entry_hash FROM w""")
def audit_chain(spark, sf_dir):
    rows = event_claims(spark, sf_dir).select(F.col("merchant").alias("log"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    return federated.hash_chain(rows, _KEY)


@query(f"""WITH {SCORES}, u AS (SELECT id, CAST('0x' || substr(sha256('7:' || CAST(id AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE - 0.5 AS u FROM s) SELECT id, round(greatest(0, 5 - sign(u) * ln(1 - 2 * abs(u) + 1e-15)), 6) AS n FROM u""")
def private_counts(spark, sf_dir):
    return scores(spark, sf_dir).select("id", F.round(federated.private_count(F.lit(5.0), 1.0, 7, F.col("id")), 6).alias("n"))


@query(f"""WITH RECURSIVE {SCORES}, l AS (SELECT year(ts) * 12 + month(ts) AS batch, CASE WHEN p >= 0.3 THEN least(floor((p - 0.3) / 0.02 + 1e-9), 1000) ELSE -1 END AS level, y FROM s),
 b AS (SELECT batch, row_number() OVER (ORDER BY batch) AS k FROM (SELECT DISTINCT batch FROM l)), c AS (SELECT k, b.batch, raised, count(*) FILTER (level >= raised) AS n, count(*) FILTER (level >= raised AND y = 0) AS bad FROM b JOIN l ON l.batch = b.batch CROSS JOIN range(40) r(raised) GROUP BY ALL),
 f AS (SELECT *, least(1.0, round(0.3 + 0.02 * raised, 10)) AS t, n >= 30 AND bad / n > 0.2 AS breached FROM c),
 w AS (SELECT * FROM f WHERE k = 1 AND raised = 0 UNION ALL SELECT f.* FROM w JOIN f ON f.k = w.k + 1 AND f.raised = w.raised + CASE WHEN w.breached AND w.t < 1 THEN 1 ELSE 0 END)
 SELECT CAST(batch AS BIGINT) AS batch, n AS n_denied, bad AS n_legit_denied, CASE WHEN n >= 30 THEN round(bad / n, 6) END AS realised_fdr, round(t, 6) AS t_deny, breached, CASE WHEN n < 30 THEN 'no action' WHEN breached THEN 'raise threshold' ELSE 'ok' END AS action FROM w""")
def guarantee_watchdog(spark, sf_dir):
    rows = scores(spark, sf_dir).withColumn("month", F.year("ts") * 12 + F.month("ts"))
    out = monitoring.watchdog(rows, "month", "p", "y", 0.3, 0.2)
    return out.withColumns({"realised_fdr": F.when(~F.isnan("realised_fdr"), F.round("realised_fdr", 6)), "t_deny": F.round("t_deny", 6)})


@query()
def reason_codes(spark, sf_dir):
    k = F.col("event_id")
    shap = F.create_map(F.lit("reuse_matched_prior_claim"), (k % 7) / 10.0, F.lit("behaviour_order_value_vs_prior_mean"), (k % 5) / 10.0, F.lit("ring_distinct_claimants"), -((k % 3) / 10.0), F.lit("behaviour_n_prior_claims_30d"), (k % 11) / 200.0)
    values = F.create_map(F.lit("reuse_min_hamming"), (k % 9).cast("double"), F.lit("behaviour_order_value_vs_prior_mean"), F.col("value") / 10, F.lit("behaviour_n_prior_claims_30d"), (k % 4).cast("double"))
    return read(spark, sf_dir, "events").select("event_id", F.to_json(audit.reason_codes(shap, values)).alias("reasons"))


_P4 = "CASE WHEN r = 0 THEN '0.0' WHEN r < 0.001 THEN CAST(CAST(round(r * 10000) AS INT) AS VARCHAR) || '.0E-4' ELSE CAST(r AS VARCHAR) END"


@query(f"""WITH {SCORES}, r AS (SELECT *, round_even(p, 4) AS r FROM s), j AS (SELECT id, '{{"action":"' || CASE WHEN p >= 0.9 THEN 'DENY' WHEN p <= 0.1 THEN 'APPROVE' ELSE 'REVIEW' END || '","claim_id":"' || CAST(id AS VARCHAR) || '","p_hat":' || {_P4} || '}}' AS payload FROM r)
 SELECT id, payload, {_hmac("payload")} AS signature FROM j""")
def signed_records(spark, sf_dir):
    payload = audit.canonical_json(claim_id=F.col("id").cast("string"), action=policy.decide(F.col("p"), 0.1, 0.9), p_hat=F.bround("p", 4))
    return scores(spark, sf_dir).select("id", payload.alias("payload"), audit.signature(payload, _KEY).alias("signature"))


@query()
def calibrated_scores(spark, sf_dir):
    rows = scores(spark, sf_dir).select("id", "p", "y", "grp")
    return calibration.calibrate(rows, calibration.fit_cells(rows, "p", "y", "grp"), "p", "grp").select("id", F.round("calibrated", 6).alias("calibrated"))


@query("""WITH r AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS nth FROM part), q AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM r WHERE nth = 1) SELECT p_partkey, p_brand FROM q WHERE n <= 3""")
def pooled_quota(spark, sf_dir):
    """A quota for each family over deduplicated sources."""
    pool = read(spark, sf_dir, "part").withColumn("key", F.concat_ws("|", "p_brand", "p_type"))
    return corpus.pooled(pool, [r[0] for r in pool.select("p_brand").distinct().collect()], 3, family="p_brand", key="key", order="p_partkey").select("p_partkey", "p_brand")


@query("""SELECT l_returnflag AS split, l_linestatus AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS prevalence FROM lineitem GROUP BY 1, 2""")
def class_counts(spark, sf_dir):
    return metrics.class_counts(read(spark, sf_dir, "lineitem").withColumnsRenamed({"l_returnflag": "split", "l_linestatus": "class"})).withColumn("prevalence", F.round("prevalence", 6))


@query(f"""WITH {SCORES} SELECT id, round((CAST(v > 300000 AS INT) + CAST(p > 0.7 AS INT) + CAST(id % 5 = 0 AS INT) + CAST(cust % 3 = 0 AS INT)) / 4.0, 6) AS score FROM s""")
def rules_baseline(spark, sf_dir):
    hits = [F.col("v") > 300000, F.col("p") > 0.7, F.col("id") % 5 == 0, F.col("cust") % 3 == 0]
    return scores(spark, sf_dir).select("id", F.round(gbdt.rules_score(hits), 6).alias("score"))


@query(f"WITH {HASHED} SELECT id, array_to_string([CASE WHEN bits[64 - i] THEN 1 ELSE -1 END FOR i IN range(64)], ',') AS signs FROM h")
def hash_vectors(spark, sf_dir):
    return hashed_claims(spark, sf_dir).select("id", F.array_join(hashing.sign_vector(F.col("phash")), ",").alias("signs"))


@query(f"""WITH {HASHED}, v AS (SELECT id, [list_sum([CASE WHEN bits[4 * i + j + 1] THEN 1 << j ELSE 0 END FOR j IN range(4)]) FOR i IN range(16)] AS v FROM h)
 SELECT id, substr(sha256({" || ".join(f"unhex(substr({_hmac(f"'{i}:' || CAST(CAST(v[{i + 1}] AS BIGINT) AS VARCHAR)")}, 1, 32))" for i in range(16))}), 1, 24) AS cluster FROM v""")
def keyed_clusters(spark, sf_dir):
    return hashed_claims(spark, sf_dir).select("id", hashing.cluster_key(F.col("phash"), _KEY).alias("cluster"))


@query(f"""WITH {SCORES}, z AS (SELECT *, id % 4 AS condition FROM s) SELECT condition, CAST(count(*) FILTER (p >= 0.35) AS BIGINT) AS n_denied, CAST(count(*) FILTER (p >= 0.35 AND y = 0) AS BIGINT) AS n_legit_denied, round(coalesce(count(*) FILTER (p >= 0.35 AND y = 0) / nullif(count(*) FILTER (p >= 0.35), 0), 0), 6) AS realised_fdr,
 coalesce(count(*) FILTER (p >= 0.35 AND y = 0) / nullif(count(*) FILTER (p >= 0.35), 0), 0) <= 0.1 AS holds FROM z GROUP BY condition""")
def frozen_certificates(spark, sf_dir):
    rows = scores(spark, sf_dir).withColumn("condition", F.col("id") % 4)
    return risk.frozen_certificate(rows, "p", "y", 0.35, 0.1, "condition").withColumn("realised_fdr", F.round("realised_fdr", 6))


@query(f"""WITH {SCORES}, z AS (SELECT p, CASE WHEN id % 4 = 3 AND (id * 31) % 100 < 30 THEN 0 ELSE y END AS y, id % 4 AS condition FROM s), fz AS (SELECT condition, CAST(count(*) FILTER (p >= 0.35) AS BIGINT) AS n_denied, CAST(count(*) FILTER (p >= 0.35 AND y = 0) AS BIGINT) AS n_legit_denied FROM z GROUP BY condition),
 c AS (SELECT condition, (50 + i) / 100.0::DOUBLE AS threshold, count(*) FILTER (p >= (50 + i) / 100.0::DOUBLE) AS nd, count(*) FILTER (p >= (50 + i) / 100.0::DOUBLE AND y = 0) AS nl FROM z CROSS JOIN range(50) r(i) GROUP BY ALL),
 t AS (SELECT condition, nd, nl / nd AS rate, 0.1::DOUBLE AS alpha FROM c WHERE nd >= 64 QUALIFY row_number() OVER (PARTITION BY condition ORDER BY threshold DESC) = 1), a AS (SELECT condition, {_HB} <= 0.1 AS ok FROM t),
 f AS (SELECT fz.*, coalesce(n_legit_denied / nullif(n_denied, 0), 0) AS fdr, coalesce(ok, false) AS ok FROM fz LEFT JOIN a USING (condition))
 SELECT condition, n_denied, n_legit_denied, round(fdr, 6) AS realised_fdr, fdr <= 0.1 AS holds, ok AS recertified, fdr > 0.1 AND ok AS recoverable FROM f""")
def shift_matrix(spark, sf_dir):
    """Four conditions; in the last one three of ten labels have turned."""
    rows = scores(spark, sf_dir).withColumn("condition", F.col("id") % 4)
    rows = rows.withColumn("y", F.when((F.col("condition") == 3) & ((F.col("id") * 31) % 100 < 30), 0).otherwise(F.col("y")))
    return risk.shift_matrix(rows, "p", "y", "condition", 0.35, 0.1, 0.1).withColumn("realised_fdr", F.round("realised_fdr", 6))


@query("SELECT event_id, list_sum([CAST((event_id * 2654435761) >> i & 1 AS INT) FOR i IN range(63)]) AS ones, CASE WHEN value >= 90 THEN 'DENY' WHEN value <= 10 THEN 'APPROVE' ELSE 'REVIEW' END AS action FROM events")
def sql_functions(spark, sf_dir):
    from veritide.functions.register import register_functions

    register_functions(spark)
    return read(spark, sf_dir, "events").selectExpr("event_id", "hamming64(event_id * 2654435761, 0L) AS ones", "policy_decide(value, 10, 90) AS action")


@query()
def bootstrap_interval(spark, sf_dir):
    from veritide.operators import bootstrap

    out = bootstrap.bootstrap_ranking(scores(spark, sf_dir), "p", "y", "id", 2000, digits=None)
    return out.select(*[F.round(c, 6).alias(c) for c in ("estimate", "low", "high")], "resamples")


@query()
def simulated_ledger(spark, sf_dir):
    from veritide.operators import simulate

    return simulate.simulate_ledger(spark, 2000).groupBy("split", "fraud_class").count()


@query(f"""WITH {HASHED}, t AS (SELECT least(1, greatest(0, 0.5 + CASE WHEN id % 11 = 0 THEN 0.4 WHEN id % 7 = 0 THEN -0.1 ELSE 0 END + CASE WHEN id % 4 > 0 THEN CASE WHEN id % 22 = 0 THEN 0.1 ELSE 0 END + CASE WHEN id % 5 >= 3 THEN 0.1 ELSE 0 END ELSE 0 END)) AS score FROM h)
 SELECT CAST(CASE WHEN score < 0.02 OR score > 0.98 THEN 1 ELSE 3 END AS INT) AS exit_stage, count(*) AS n FROM t GROUP BY 1""")
def cascade_stages(spark, sf_dir):
    from veritide.plans import cascade

    claims = hashed_claims(spark, sf_dir)
    k = F.col("id")
    early = claims.select("id", (k % 11 == 0).cast("double").alias("declares_ai_generation"), (k % 7 == 0).cast("double").alias("declares_camera_capture"), (k % 4).cast("double").alias("n_prior_claims"), F.when(k % 22 == 0, 9.0).otherwise(1.0).alias("value_vs_prior_mean"), (k % 5).cast("double").alias("n_prior_claims_30d"))
    return cascade.stage_distribution(cascade.run_cascade(claims, early, None, cascade.CascadeConfig(radius=18, similar=0.35)))


@query()
def boosted_scores(spark, sf_dir):
    from veritide.operators import gbdt

    rows = scores(spark, sf_dir).select("id", "y", F.col("v").alias("value"), ((F.col("id") * 7919) % 10007 / 10007.0 + F.col("y")).alias("signal"))
    model = gbdt.fit_gbdt(rows, ["value", "signal"], "y", monotone={"signal": 1})
    return model.predict(rows).select("id", F.round("p", 6).alias("p"))


@query(f"""WITH {SCORES}, a AS (SELECT -1.0::DOUBLE AS ta, 0 AS ka UNION ALL SELECT i / 100.0::DOUBLE, i + 1 FROM range(51) r(i)), d AS (SELECT (50 + i) / 100.0::DOUBLE AS td FROM range(0, 50, 10) r(i)),
 c AS (SELECT ta, td, ka, sum(CASE WHEN p >= td THEN CASE WHEN y = 0 THEN v + 1300 ELSE 0 END WHEN p <= ta THEN CASE WHEN y = 1 THEN v + 180 ELSE 0 END ELSE 40 END) / count(*) * 1000 AS cost FROM a CROSS JOIN d CROSS JOIN s WHERE ta < td GROUP BY ta, td, ka)
 SELECT ta AS t_approve, td AS t_deny, round(cost, 2) AS cost_per_1000, CAST(row_number() OVER (ORDER BY round(cost, 6), td DESC, ka) AS INT) AS place FROM c QUALIFY place <= 20""")
def policy_candidates(spark, sf_dir):
    certified = [round(0.9 - i / 10, 4) for i in range(5)]
    return policy.policy_candidates(scores(spark, sf_dir), "p", "y", "v", certified).withColumn("cost_per_1000", F.round("cost_per_1000", 2))


@query("""SELECT * FROM (VALUES (0, 0.03::DOUBLE, 0.1::DOUBLE, 222, 2775::BIGINT, 13875::BIGINT, true)) t(rung, alpha, delta, min_denied, test_claims, all_claims, chosen)""")
def primary_target(spark, sf_dir):
    """The first rung of the ladder that a corpus of 35,000 claims is large enough for."""
    return risk.corpus_sizes(spark, practical=35_000).select("rung", "alpha", "delta", "min_denied", "test_claims", "all_claims", "chosen")


_RUNGS = ORACLE_SQL["ladder_walk"][: ORACLE_SQL["ladder_walk"].rindex(" SELECT rung")].replace("(SELECT p, " + _MESSY, "(SELECT id, ts, p, " + _MESSY).replace("FROM s), g AS", "FROM s WHERE ts >= TIMESTAMP '1995-01-01'), g AS")


@query(f"""{_RUNGS}, won AS (SELECT coalesce((SELECT min(rung) FROM x WHERE ok), 9) AS won)
 SELECT rung, alpha, delta, count(*) FILTER (NOT skipped) AS n_tested, count(*) FILTER (ok) AS n_certified, min(threshold) FILTER (ok) AS least_conservative, count(*) FILTER (ok) > 0 AS certified,
 (SELECT sha256(string_agg(l, chr(10) ORDER BY l) || chr(10)) FROM (SELECT CAST(id AS VARCHAR) || chr(9) || CAST(y AS VARCHAR) || chr(9) || 'sha' || CAST(id % 97 AS VARCHAR) AS l FROM z)) AS content_sha256
 FROM x, won WHERE rung <= won GROUP BY rung, alpha, delta""")
def certification_job(spark, sf_dir):
    """The whole job on the orders from 1995 on: seal, ladder, certificate."""
    from veritide.plans import jobs

    rows = scores(spark, sf_dir).where("ts >= timestamp_ntz '1995-01-01'").withColumns({"y": F.expr(_MESSY), "sha": F.concat(F.lit("sha"), (F.col("id") % 97).cast("string"))})
    found = jobs.certify(rows, "dev", p="p", y="y", claim="id", sha="sha")
    out = [(r["rung"], r["alpha"], r["delta"], r["n_tested"], r["n_certified"], r["least_conservative"], r["certified"], found["calibration_seal"]["content_sha256"]) for r in found["attempts"]]
    return spark.createDataFrame(out, "rung int, alpha double, delta double, n_tested long, n_certified long, least_conservative double, certified boolean, content_sha256 string")


@query(f"""WITH {SCORES}, k AS (SELECT *, id % 4 + 0.0 AS a FROM s) SELECT round(avg(CAST(a > 2 AS INT) + CAST(p > 0.5 AS INT) + CAST(v > 300000 AS INT)) / 4.0, 6) AS mean_score, count(*) AS n FROM k""")
def rules_engine_scores(spark, sf_dir):
    """The mean score of the hand-made rules, one of whose features is missing."""
    from veritide.operators import baselines

    rows = scores(spark, sf_dir).select((F.col("id") % 4).cast("double").alias("behaviour_n_prior_claims"), F.when(F.col("p") > 0.5, 2.0).otherwise(F.lit(float("nan"))).alias("behaviour_n_prior_claims_30d"), F.when(F.col("v") > 300000, 4.0).alias("behaviour_order_value_vs_prior_mean"), F.lit(float("nan")).alias("reuse_matched_prior_claim"))
    return rows.agg(F.round(F.avg(baselines.rules_engine()), 6).alias("mean_score"), F.count("*").alias("n"))


@query()
def linear_probe(spark, sf_dir):
    """A logistic regression on two features, by Newton steps; the tests hold it against the optimum's gradient."""
    from veritide.operators import baselines

    rows = scores(spark, sf_dir).select(F.col("y").alias("label"), (F.col("v") / 100000).alias("reuse_value"), (F.col("id") % 5).cast("double").alias("reuse_part"), F.col("p").alias("reuse_score"))
    probe = baselines.fit_probe(rows, "reuse_")
    return spark.createDataFrame([*zip(probe.columns, [round(w, 6) for w in probe.weights], strict=True), ("intercept", round(probe.intercept, 6))], "feature string, weight double")


@query()
def fused_scores(spark, sf_dir):
    """Cross-fit, calibrator, refit and calibrated scores of a small fusion model."""
    from veritide.operators import fusion

    rows = scores(spark, sf_dir).select(F.col("id").alias("claim_id"), F.col("y").alias("label"), F.col("grp").alias("group"), F.col("v").alias("value"), ((F.col("id") * 7919) % 10007 / 10007.0 + F.col("y")).alias("signal"))
    model = fusion.fit_fusion(rows, ["value", "signal"], config=fusion.FusionConfig(trees=6, folds=2, depth=3, rate=0.3), monotone={"signal": 1})
    return model.predict(rows).select("claim_id", F.round("p", 6).alias("p"), F.round("calibrated", 6).alias("calibrated"))


_FAMILY = "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END"


def _families(spark, sf_dir):
    rows = _splits(spark, sf_dir).join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority"), "id")
    rows = rows.withColumn("family", F.when(F.col("id") % 3 != 0, F.col("o_orderpriority")))
    allowed = spark.createDataFrame([(s, f) for s in ("train", "calibration", "test") for f in ("1-URGENT", "2-HIGH", "3-MEDIUM", *(("5-LOW",) if s == "test" else ()))], "split string, family string")
    return rows, allowed


_ALLOWED = "(f IN ('1-URGENT', '2-HIGH', '3-MEDIUM') OR (f = '5-LOW' AND split = 'test'))"


@query(f"SELECT DISTINCT split, f AS family FROM (SELECT {_SPLIT} AS split, {_FAMILY} AS f FROM orders) WHERE f IS NOT NULL AND NOT {_ALLOWED}")
def held_out_families(spark, sf_dir):
    """Families that stand in a split that they were held out of."""
    rows, allowed = _families(spark, sf_dir)
    return identity.holdout_violations(rows, "family", allowed)


@query(f"""WITH r AS (SELECT o_custkey AS entity, o_orderkey % 5000 AS grp, {_SPLIT} AS split, {_FAMILY} AS f FROM orders) SELECT 'holdout' AS "check", count(*) AS violations, count(*) = 0 AS passed FROM (SELECT DISTINCT split, f FROM r WHERE f IS NOT NULL AND NOT {_ALLOWED})
 UNION ALL SELECT 'temporal', 0, true UNION ALL SELECT 'entity', count(*), count(*) = 0 FROM (SELECT entity FROM r GROUP BY entity HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'group', count(*), count(*) = 0 FROM (SELECT grp FROM r GROUP BY grp HAVING count(DISTINCT split) > 1)""")
def split_report(spark, sf_dir):
    rows, allowed = _families(spark, sf_dir)
    return identity.verify_splits(rows, ["train", "calibration", "test"], allowed, group="grp", family="family")


@query(f"""WITH o AS (SELECT o_orderkey AS id, {_SPLIT} AS split, o_orderdate AS ts, o_custkey AS c FROM orders), f AS (SELECT *, first_value(split) OVER (PARTITION BY c ORDER BY ts, id) AS kept FROM o) SELECT id, split FROM f WHERE split = kept""")
def kept_claims(spark, sf_dir):
    """What is left of the splits when reconciliation has dropped its claims."""
    rows = _splits(spark, sf_dir)
    first = rows.groupBy("entity").agg(F.min("id").alias("a"))
    merged = identity.reconcile_splits(rows, rows.join(first, "entity").select("a", F.col("id").alias("b")))
    return identity.without_dropped(rows, merged).select("id", "split")


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'entity_' || CAST(o_custkey AS VARCHAR) END AS identity FROM orders""")
def claim_identities(spark, sf_dir):
    """The resolved identity of a claim, or its raw claimant where nothing was resolved."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("claimant"))
    known = rows.where("claimant % 4 <> 0").select("id", F.concat(F.lit("entity_"), F.col("claimant").cast("string")).alias("entity"))
    return identity.register_identities(rows, known).select("id", "identity")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 120 DAY")
def matured_claims(spark, sf_dir):
    return policy.matured_rows(read(spark, sf_dir, "orders"), "o_orderdate")[0].select(F.col("o_orderkey").alias("id"))


@query("SELECT user_id AS cluster, max(epoch_us(ts)) AS last_us FROM events GROUP BY user_id HAVING pow(0.5, ((epoch_us(TIMESTAMP '2026-06-01') - max(epoch_us(ts))) // 86400000000) / 180.0) >= 0.01")
def unexpired_clusters(spark, sf_dir):
    """Clusters whose evidence has not decayed below the least weight."""
    evidence = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cluster")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_us"))
    return federated.prune(evidence, F.lit(1780272000000000))


@query("SELECT count(*) AS n, CAST(count(*) FILTER (event_id % 5 = 0) AS BIGINT) AS n_broken FROM events")
def verified_records(spark, sf_dir):
    """Signed evidence records, one of five of which was changed afterwards."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("claim_id"), policy.decide(F.col("value"), 10.0, 90.0).alias("action"), (F.col("value") / 200).alias("p"), F.array(F.lit("A")).alias("reasons"))
    records = audit.evidence_records(rows, _KEY)
    return audit.verify_records(records.withColumn("payload", F.when(F.col("claim_id") % 5 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))), _KEY)


@query("SELECT event_id % 7 AS log, true AS valid, count(*) AS length FROM events GROUP BY 1")
def verified_chains(spark, sf_dir):
    rows = event_claims(spark, sf_dir).select(F.col("merchant").alias("log"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    return federated.verify_chain(federated.hash_chain(rows, _KEY), _KEY)


@query("SELECT p_partkey FROM part WHERE p_type NOT LIKE '%STEEL%'")
def source_controlled_rows(spark, sf_dir):
    from veritide.operators import ablations

    return read(spark, sf_dir, "part").where(ablations.source_controlled("p_type", "STEEL")).select("p_partkey")


@query(f"WITH {HASHED} SELECT a.id AS q, b.id AS c, CAST((SELECT count(*) FROM range(3) r(i) WHERE ((a.id // 400) >> i) & 1 <> ((b.id // 400) >> i) & 1) AS INT) AS hamming FROM h a JOIN h b ON b.id < a.id AND a.id % 400 = b.id % 400 AND (SELECT count(*) FROM range(3) r(i) WHERE ((a.id // 400) >> i) & 1 <> ((b.id // 400) >> i) & 1) <= 2")
def close_hash_pairs(spark, sf_dir):
    """The production radius of 2, on hashes that are copies of 400 with up to three bits turned."""
    turned = F.floor(F.col("id") / 400).bitwiseAND(F.lit(7))
    return reuse.near_hash_pairs(hashed_claims(spark, sf_dir).withColumn("phash", F.xxhash64(F.col("id") % 400).bitwiseXOR(turned)), 2)
