"""Plain-SQL statements of every registered query, for the DuckDB oracle.

``FIXTURE_SQL`` projects the provided tables onto the typed inputs exactly
as ``dosewise.sources.fixtures`` does with DataFrames; the rollups here use
the reference's literal disjunctive join, so an oracle match also checks
the engine's explode + equi-join rewrite.
"""

from __future__ import annotations

FIXTURE_SQL: list[tuple[str, str]] = [
    ("fx_partd_raw", """
SELECT o.o_custkey AS npi, c.c_mktsegment AS specialty, p.p_name AS brnd_name, p.p_type AS gnrc_name,
       CAST(l.l_quantity AS BIGINT) AS tot_clms, CAST(l.l_linenumber AS BIGINT) AS tot_benes,
       CAST(l.l_extendedprice AS DECIMAL(18,2)) AS tot_drug_cst,
       CAST(EXTRACT(YEAR FROM o.o_orderdate) AS INT) AS yr
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON l.l_partkey = p.p_partkey"""),
    ("fx_events_k", """
SELECT event_id, ts, user_id, event_type, value,
       CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k
FROM events"""),
    ("fx_payments_raw", """
SELECT e.user_id * 12 AS npi,
       CASE e.event_type WHEN 'error' THEN 'Covered Recipient Teaching Hospital'
                         WHEN 'signup' THEN 'Covered Recipient Non-Physician Practitioner'
                         ELSE 'Covered Recipient Physician' END AS recipient_type,
       '' AS specialty,
       CAST(e.value AS DECIMAL(18,2)) AS amount, e.event_type AS nature, s.s_name AS manufacturer,
       p1.p_name AS drug1, CASE WHEN e.k % 3 = 0 THEN p2.p_name ELSE '' END AS drug2,
       '' AS drug3, '' AS drug4, '' AS drug5,
       CAST(EXTRACT(YEAR FROM e.ts) AS INT) AS program_year, CAST(e.ts AS DATE) AS payment_date
FROM fx_events_k e
JOIN supplier s ON s.s_suppkey = e.k % 10
JOIN part p1 ON p1.p_partkey = e.k
JOIN part p2 ON p2.p_partkey = e.k + 100"""),
    ("fx_drug_map", """
SELECT * FROM (VALUES
  ('Small','SMALL','','brand'), ('Hot','HOT','','brand'), ('Red','RED','','brand'), ('Blue','BLUE','','brand'),
  ('Large','LARGE','','brand'), ('Old','OLD','','brand'), ('Cold','COLD','','brand'),
  ('Economy','','ECONOMY','generic')) AS t(drug_key, brnd_name, gnrc_name, match_on)"""),
    ("fx_rx", """
SELECT m.drug_key, p.npi, min(p.specialty) AS specialty, CAST(sum(p.tot_clms) AS BIGINT) AS clms,
       CAST(sum(p.tot_drug_cst) AS DECIMAL(18,2)) AS drug_cst, CAST(sum(p.tot_benes) AS BIGINT) AS benes
FROM fx_partd_raw p JOIN fx_drug_map m
  ON (m.match_on = 'brand' AND split_part(upper(trim(p.brnd_name)), ' ', 1) = m.brnd_name)
  OR (m.match_on = 'generic' AND upper(trim(p.gnrc_name)) = m.gnrc_name)
WHERE p.npi <> 0 GROUP BY m.drug_key, p.npi"""),
    ("fx_pay", """
SELECT m.drug_key, p.npi, CAST(sum(p.amount) AS DECIMAL(18,2)) AS pay_amount, count(*) AS pay_count
FROM fx_payments_raw p JOIN fx_drug_map m
  ON m.brnd_name <> '' AND (split_part(upper(trim(p.drug1)), ' ', 1) = m.brnd_name
                         OR split_part(upper(trim(p.drug2)), ' ', 1) = m.brnd_name)
WHERE p.npi <> 0 AND (lower(p.recipient_type) LIKE '%physician%' OR lower(p.recipient_type) LIKE '%practitioner%')
GROUP BY m.drug_key, p.npi"""),
    ("fx_identities", """
SELECT c.c_custkey AS npi, p.p_name AS name, c.c_mktsegment AS specialty, n.n_name AS city, r.r_name AS state
FROM customer c JOIN part p ON p.p_partkey = c.c_custkey % 200
JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey"""),
    ("fx_review_changes", """
SELECT user_id AS review_id, 'Small' AS drug_key, user_id * 12 AS npi, CAST(value AS DECIMAL(18,2)) AS pay_amount,
       CASE event_type WHEN 'error' THEN 'escalated' WHEN 'purchase' THEN 'cleared'
                       WHEN 'signup' THEN 'flagged' ELSE 'reviewing' END AS status,
       ts AS updated_at, event_id
FROM events"""),
    # Per-entity layer (read models): first-match key, brand-row payments.
    ("fx_claims", """
SELECT p.npi, coalesce(b.drug_key, g.drug_key) AS drug_key, min(p.specialty) AS specialty,
       CAST(sum(p.tot_clms) AS BIGINT) AS claims, CAST(sum(p.tot_drug_cst) AS DECIMAL(18,2)) AS cost,
       CAST(sum(p.tot_benes) AS BIGINT) AS benes
FROM fx_partd_raw p
LEFT JOIN (SELECT drug_key, upper(brnd_name) AS k FROM fx_drug_map WHERE match_on = 'brand' AND brnd_name <> '') b
  ON split_part(upper(trim(p.brnd_name)), ' ', 1) = b.k
LEFT JOIN (SELECT drug_key, upper(gnrc_name) AS k FROM fx_drug_map WHERE match_on = 'generic' AND gnrc_name <> '') g
  ON upper(trim(p.gnrc_name)) = g.k
WHERE p.npi <> 0 AND coalesce(b.drug_key, g.drug_key) IS NOT NULL
GROUP BY p.npi, coalesce(b.drug_key, g.drug_key)"""),
    ("fx_pay_rows", """
SELECT p.*, m.drug_key
FROM fx_payments_raw p JOIN fx_drug_map m
  ON m.brnd_name <> '' AND m.match_on = 'brand'
 AND (split_part(upper(trim(p.drug1)), ' ', 1) = m.brnd_name OR split_part(upper(trim(p.drug2)), ' ', 1) = m.brnd_name
   OR split_part(upper(trim(p.drug3)), ' ', 1) = m.brnd_name OR split_part(upper(trim(p.drug4)), ' ', 1) = m.brnd_name
   OR split_part(upper(trim(p.drug5)), ' ', 1) = m.brnd_name)
WHERE p.npi <> 0 AND (lower(p.recipient_type) LIKE '%physician%' OR lower(p.recipient_type) LIKE '%practitioner%')"""),
    ("fx_pays", """
SELECT npi, drug_key, CAST(sum(amount) AS DECIMAL(18,2)) AS pay_amount, count(*) AS pay_count
FROM fx_pay_rows GROUP BY npi, drug_key"""),
    ("fx_mfr", """
SELECT npi, drug_key, trim(manufacturer) AS manufacturer, CAST(sum(amount) AS DECIMAL(18,2)) AS amount,
       count(*) AS n
FROM fx_pay_rows GROUP BY npi, drug_key, trim(manufacturer)"""),
    ("fx_spec", "SELECT npi, min(specialty) AS specialty FROM fx_claims GROUP BY npi"),
    ("fx_base", """
SELECT c.npi, c.drug_key, s.specialty, c.claims, c.cost, c.benes,
       coalesce(p.pay_amount, CAST(0 AS DECIMAL(18,2))) AS pay_amount,
       coalesce(p.pay_count, 0) AS pay_count,
       coalesce(p.pay_amount, 0) > 0 AS paid
FROM fx_claims c JOIN fx_spec s USING (npi) LEFT JOIN fx_pays p USING (npi, drug_key)"""),
    ("fx_bench", """
SELECT specialty, drug_key, count_if(paid) AS n_paid, count_if(NOT paid) AS n_unpaid,
       sum(CASE WHEN paid THEN claims END) AS s_paid, sum(CASE WHEN NOT paid THEN claims END) AS s_unpaid
FROM fx_base GROUP BY specialty, drug_key"""),
    ("fx_dd", """
SELECT b.npi, b.drug_key, b.specialty, b.claims, b.cost, b.benes, b.pay_amount, b.pay_count,
       round(coalesce(CASE WHEN k.n_unpaid > 0 THEN CAST(k.s_unpaid AS DOUBLE) / k.n_unpaid END, 0.0), 1) AS peer_unpaid_avg,
       CASE WHEN coalesce(CASE WHEN k.n_unpaid > 0 THEN CAST(k.s_unpaid AS DOUBLE) / k.n_unpaid END, 0.0) <> 0
            THEN round((b.claims - CAST(k.s_unpaid AS DOUBLE) / k.n_unpaid) / (CAST(k.s_unpaid AS DOUBLE) / k.n_unpaid) * 100, 1) + 0.0
       END AS pct_vs_unpaid
FROM fx_base b LEFT JOIN fx_bench k USING (specialty, drug_key)"""),
    ("fx_rx_tot", "SELECT npi, CAST(sum(claims) AS BIGINT) AS total_claims FROM fx_claims GROUP BY npi"),
    ("fx_pay_tot", "SELECT npi, CAST(sum(pay_amount) AS DECIMAL(18,2)) AS total_pay FROM fx_pays GROUP BY npi"),
    ("fx_doctors", """
SELECT ids.npi,
       coalesce(nullif(trim(ids.name), ''), 'NPI ' || CAST(ids.npi AS VARCHAR)) AS name,
       coalesce(ids.specialty, '') AS specialty, coalesce(ids.city, '') AS city, coalesce(ids.state, '') AS state,
       coalesce(pt.total_pay, CAST(0 AS DECIMAL(18,2))) AS total_pay,
       coalesce(rt.total_claims, CAST(0 AS BIGINT)) AS total_claims
FROM (SELECT r.npi, i.name, s.specialty, i.city, i.state
      FROM fx_rx_tot r JOIN fx_spec s USING (npi) LEFT JOIN fx_identities i USING (npi)
      UNION ALL
      SELECT p.npi, NULL, '', '', '' FROM fx_pay_tot p WHERE p.npi NOT IN (SELECT npi FROM fx_rx_tot)) ids
LEFT JOIN fx_rx_tot rt USING (npi) LEFT JOIN fx_pay_tot pt USING (npi)"""),
]


def with_fixtures(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with every fixture CTE (plus ``extra`` ones, in order)."""
    ctes = FIXTURE_SQL + list(extra or [])
    head = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in ctes)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
