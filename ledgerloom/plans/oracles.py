"""SQL counterparts of the registered queries, for checking results with another engine."""

from __future__ import annotations

LEDGER = """ledger AS (
  SELECT o_custkey AS session_id, o_orderkey AS txn_id, CAST(o_orderdate AS DATE) AS date,
         p_name || ' ' || p_brand AS vendor, o_totalprice AS amount,
         p_type AS category, p_type AS description
  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part))"""

NATION_LEDGER = """ledger AS (
  SELECT CAST(c_nationkey AS BIGINT) AS session_id, o_orderkey AS txn_id, CAST(o_orderdate AS DATE) AS date,
         p_name || ' ' || p_brand AS vendor, o_totalprice AS amount,
         p_type AS category, p_type AS description
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part))"""

STATEMENT = """statement AS (
  SELECT session_id, txn_id,
    CASE WHEN txn_id % 5 = 2 THEN CAST(date + INTERVAL 2 DAY AS DATE) ELSE date END AS date,
    CASE WHEN txn_id % 7 = 3 THEN 'Card payment' WHEN txn_id % 3 = 0 THEN split_part(vendor, ' ', 1)
         ELSE vendor END AS vendor,
    CASE WHEN txn_id % 5 = 1 THEN CAST(round(CAST(amount AS DECIMAL(18,2)) * 1.015, 2) AS DOUBLE) WHEN txn_id % 5 = 4 THEN CAST(round(CAST(amount AS DECIMAL(18,2)) * 1.5, 2) AS DOUBLE)
         ELSE amount END AS amount,
    CASE WHEN txn_id % 7 <> 3 THEN description END AS description
  FROM ledger)"""

DIRTY = """dirty AS (
  SELECT txn_id,
    CASE WHEN txn_id % 11 = 3 THEN 'not a date' WHEN txn_id % 11 = 5 THEN strftime(date, '%m/%d/%Y')
         ELSE strftime(date, '%Y-%m-%d') END AS date,
    CASE WHEN txn_id % 17 = 4 THEN '' WHEN txn_id % 17 = 6 THEN 'N/A' ELSE vendor END AS vendor,
    CASE WHEN txn_id % 7 = 1 THEN 'abc' WHEN txn_id % 7 = 2 THEN '1,000' WHEN txn_id % 13 = 3 THEN 'nan'
         WHEN txn_id % 13 = 5 THEN '' ELSE CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) END AS amount,
    category
  FROM ledger),
typed AS (
  SELECT txn_id, coalesce(TRY_CAST(date AS DATE), CAST(try_strptime(date, '%m/%d/%Y') AS DATE)) AS date,
    CASE WHEN vendor NOT IN ('', 'N/A') THEN vendor END AS vendor,
    CASE WHEN amount <> 'nan' THEN TRY_CAST(amount AS DOUBLE) END AS amount, category
  FROM dirty)"""



def _rd(x: str, places: int) -> str:
    """Round a double half up by its decimal digits."""
    return f"CAST(round(CAST({x} AS DECIMAL(28,8)), {places}) AS DOUBLE)"


MONTH = "strftime(date, '%Y-%m')"
TOTAL = "CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE)"
TOTAL2 = "CAST(round(sum(CAST(amount AS DECIMAL(18,4))), 2) AS DOUBLE)"
MEAN = f"{TOTAL} / count(amount)"

SCORES = """scores AS (
  SELECT s.session_id, s.txn_id AS stmt, l.txn_id AS led,
    CAST(CASE WHEN abs(s.amount - l.amount) <= 1e-2 THEN 0.4
         WHEN abs(s.amount - l.amount) <= greatest(1e-2, abs(l.amount) * 2e-2) THEN 0.35
         WHEN abs(s.amount - l.amount) <= abs(l.amount) * 5e-2 THEN 0.2 ELSE 0 END AS DOUBLE) AS a,
    CAST(CASE WHEN s.date = l.date THEN 0.25 WHEN s.date IS NOT NULL AND l.date IS NOT NULL THEN 0.15
         ELSE 0 END AS DOUBLE) AS d,
    CAST(CASE WHEN upper(s.vendor) = upper(l.vendor) THEN 0.25
         WHEN contains(upper(s.vendor), upper(l.vendor)) OR contains(upper(l.vendor), upper(s.vendor)) THEN 0.2
         WHEN len(list_intersect(string_split(upper(s.vendor), ' '), string_split(upper(l.vendor), ' '))) > 0 THEN 0.1
         ELSE 0 END AS DOUBLE) AS v,
    CAST(CASE WHEN upper(s.description) = upper(l.description) THEN 0.1
         WHEN contains(upper(s.description), upper(l.description)) OR contains(upper(l.description), upper(s.description)) THEN 0.05
         ELSE 0 END AS DOUBLE) AS e
  FROM statement s JOIN ledger l ON s.session_id = l.session_id{extra}),
scored AS (SELECT *, a + d + v + e AS score FROM scores)"""

# One step per statement row and session: the first wish that is not taken yet.
SERIAL = """wishes AS (
  SELECT session_id, stmt, list(led ORDER BY score DESC, led) AS leds,
         row_number() OVER (PARTITION BY session_id ORDER BY stmt) AS rn
  FROM scored WHERE score > 3e-1 GROUP BY session_id, stmt),
steps AS (
  SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS used,
         CAST(NULL AS BIGINT) AS stmt, CAST(NULL AS BIGINT) AS led FROM wishes
  UNION ALL
  SELECT session_id, rn, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, stmt, pick
  FROM (SELECT p.session_id, w.rn, p.used, w.stmt,
               list_filter(w.leds, lambda x: NOT list_contains(p.used, x))[1] AS pick
        FROM steps p JOIN wishes w ON w.session_id = p.session_id AND w.rn = p.rn + 1)),
matches AS (
  SELECT m.session_id, m.stmt, m.led, a, d, v, e, score, round(score, 3) AS confidence_score,
    CASE WHEN score >= 85e-2 THEN 'high' WHEN score >= 65e-2 THEN 'medium' ELSE 'low' END AS match_type,
    CASE WHEN round(score, 3) >= 85e-2 THEN 'high' WHEN round(score, 3) >= 65e-2 THEN 'medium' ELSE 'low' END AS tier
  FROM steps m JOIN scored s ON s.session_id = m.session_id AND s.stmt = m.stmt AND s.led = m.led
  WHERE m.led IS NOT NULL)"""


def _ledger(sql: str) -> str:
    return f"WITH {LEDGER}{sql}" if sql.startswith(",") else f"WITH {LEDGER} {sql}"


def _dirty(sql: str) -> str:
    return f"WITH {LEDGER}, {DIRTY} {sql}"


def _matching(sql: str, base: str = LEDGER, more: str = "") -> str:
    return f"WITH RECURSIVE {base}, {STATEMENT}, {SCORES.format(extra='')}, {SERIAL}{more} {sql}"


SPARSE = f"""{LEDGER.replace("ledger AS", "full_ledger AS")},
{STATEMENT.replace("statement AS", "full_statement AS").replace("FROM ledger", "FROM full_ledger")},
ledger AS (
  SELECT * REPLACE (CASE WHEN txn_id % 6 <> 1 THEN date END AS date, CASE WHEN txn_id % 8 <> 3 THEN vendor END AS vendor,
                    CASE WHEN txn_id % 4 <> 2 THEN description END AS description)
  FROM full_ledger WHERE session_id % 5 <> 1),
statement AS (
  SELECT * REPLACE (2 * txn_id + 11 AS txn_id, CASE WHEN txn_id % 9 <> 4 THEN date END AS date,
                    CASE WHEN txn_id % 10 <> 7 THEN amount END AS amount)
  FROM full_statement WHERE session_id % 5 <> 3)"""


def _sparse(sql: str) -> str:
    return f"WITH RECURSIVE {SPARSE}, {SCORES.format(extra='')}, {SERIAL} {sql}"


def _near(sql: str, days: int) -> str:
    extra = f" AND abs(date_diff('day', l.date, s.date)) <= {days}"
    return f"WITH {LEDGER}, {STATEMENT}, {SCORES.format(extra=extra)} {sql}"


MONTH_TOTALS = f"SELECT date_trunc('month', date) AS m, {TOTAL} AS total_amount FROM ledger GROUP BY 1"

LARGE = """p AS (SELECT strftime(date, '%Y-%m') AS month, quantile_cont(amount, 0.95) AS p95 FROM ledger GROUP BY 1),
large AS (SELECT p.month, l.*, p95 FROM ledger l JOIN p ON strftime(l.date, '%Y-%m') = p.month WHERE amount > p95)"""


def _amount_text(x: str) -> str:
    return rf"regexp_replace(regexp_replace(CAST(CAST({x} AS DECIMAL(28,4)) AS VARCHAR), '0+$', ''), '\.$', '.0')"


def _money(x: str) -> str:
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(28,4)), 2) AS DECIMAL(28,2)) AS VARCHAR)"


def _thousands(x: str) -> str:
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


NAMES = """names AS (SELECT txn_id, ' the ' || vendor || CASE txn_id % 4 WHEN 0 THEN '  llc' WHEN 1 THEN ' & co'
  WHEN 2 THEN ' and the sons inc' ELSE '''s at&t' END AS name FROM ledger)"""

_WORDS = "list_filter(string_split_regex(trim(upper(name)), '\\s+'), lambda w: NOT list_contains([{stop}], w))"
_MATCH_STOP = "'INC','LLC','LTD','CORP','CO','&','AND','THE'"
_VENDOR_STOP = "'INC','LLC','LTD','CORP','CO','&','AND'"

RESPONSES = """responses AS (
  SELECT session_id, 'scan-' || txn_id || '.png' AS filename,
    CASE txn_id % 7
      WHEN 0 THEN 'Here: [{"date":"' || day || '","amount":"' || amt || '","vendor":"' || vendor || ' LLC","description":"' || description || '","type":" Credit "}] ok'
      WHEN 1 THEN '[{"amount":true,"vendor":null},"x",5]'
      WHEN 2 THEN '[{"amount":"bad","vendor":"q"},{"vendor":"z"},{"amount":1e2,"vendor":7}]'
      WHEN 3 THEN 'no transactions found'
      WHEN 4 THEN '] ['
      WHEN 5 THEN '[{"a":1},]'
      ELSE 'Result: [{"date":"' || day || '","amount":' || amt || ',"vendor":"' || vendor || ' & co","description":" ' || description || ' "},{"date":"' || day || '","amount":' || amt || ',"vendor":"' || vendor || '","description":null}] end'
    END AS response
  FROM (SELECT *, strftime(date, '%Y-%m-%d') AS day, CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) AS amt FROM ledger)),
arrays AS (
  SELECT *, CASE WHEN strpos(response, '[') > 0 AND strpos(reverse(response), ']') > 0
                  AND length(response) - strpos(reverse(response), ']') + 1 >= strpos(response, '[')
    THEN substr(response, strpos(response, '['), length(response) - strpos(reverse(response), ']') + 2 - strpos(response, '[')) END AS txt
  FROM responses),
valid AS (SELECT * FROM arrays WHERE txt IS NOT NULL AND json_valid(txt)),
elements AS (
  SELECT session_id, filename, CAST(i AS INTEGER) AS position, json_extract(txt, '$[' || i || ']') AS value
  FROM (SELECT *, unnest(range(CAST(json_array_length(txt) AS BIGINT))) AS i FROM valid)),
fields AS (
  SELECT *, CASE json_type(value, '$.amount') WHEN 'BOOLEAN' THEN CAST(CAST(json_extract_string(value, '$.amount') AS BOOLEAN) AS DOUBLE)
            ELSE TRY_CAST(json_extract_string(value, '$.amount') AS DOUBLE) END AS amount
  FROM elements WHERE json_type(value) = 'OBJECT')"""

INDEX_TEXT = f"'Date: ' || date || ' Amount: $' || {_amount_text('amount')} || ' Description: ' || description || ' Category: ' || category"

def _embedded(texts: str, name: str, keep: str) -> str:
    """CTEs that hash the words of ``texts`` into unit vectors ``v`` of a table ``name``."""
    return f"""{name}_counts AS (
  SELECT {keep}, list_transform(range(0, 64), lambda i: CAST(len(list_filter(places, lambda x: x = i)) AS DOUBLE)) AS c
  FROM (SELECT *, list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''),
                                 lambda w: CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 64) AS places FROM {texts})),
{name} AS (
  SELECT {keep}, list_transform(c, lambda x: CAST(CAST(x / size AS FLOAT) AS DOUBLE)) AS v
  FROM (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS size FROM {name}_counts))"""


VECTORS = f"""texts AS (SELECT txn_id AS doc_id, amount, {INDEX_TEXT} AS text FROM ledger),
{_embedded("texts", "vectors", "doc_id, amount, text")}"""

SIMILAR = f"""{VECTORS}, q AS (SELECT arg_min(v, doc_id) AS qv FROM vectors),
near AS (
  SELECT doc_id, text, amount, round(list_cosine_similarity(v, qv), 9) AS similarity
  FROM vectors, q
  ORDER BY similarity DESC, doc_id DESC LIMIT 5),
hits AS (SELECT * FROM near WHERE similarity > 1e-1)"""

RECOMMEND = """CASE tier WHEN 'high' THEN 'Auto-approve: High confidence match'
  WHEN 'medium' THEN 'Review recommended: Medium confidence match'
  ELSE 'Manual review required: Low confidence match' END"""

MATCHES_OUT = f"""SELECT session_id, stmt AS statement_txn_id, led AS ledger_txn_id, a AS amount_score, d AS date_score,
  v AS vendor_score, e AS description_score, confidence_score, match_type, tier, {RECOMMEND} AS recommendation FROM matches"""

UNMATCHED = """unmatched AS (
  SELECT session_id, txn_id, 'Image (Unmatched)' AS source, date, vendor, amount, description FROM statement
  WHERE (session_id, txn_id) NOT IN (SELECT (session_id, stmt) FROM matches)
  UNION ALL
  SELECT session_id, txn_id, 'CSV (Unmatched)', date, vendor, amount, description FROM ledger
  WHERE (session_id, txn_id) NOT IN (SELECT (session_id, led) FROM matches))"""

SUMMARY = f"""summary AS (
  SELECT session_id, img AS total_image_transactions, csv AS total_csv_transactions,
    coalesce(hits, 0) AS total_matches, {_rd('coalesce(hits, 0) * 1e2 / img', 1)} AS match_rate,
    coalesce(h, 0) AS high_confidence_matches, coalesce(m, 0) AS medium_confidence_matches,
    coalesce(lo, 0) AS low_confidence_matches, img - coalesce(hits, 0) AS unmatched_image_transactions,
    csv - coalesce(hits, 0) AS unmatched_csv_transactions,
    CAST(round(img_amount, 2) AS DOUBLE) AS total_image_amount,
    CAST(round(coalesce(hit_amount, 0), 2) AS DOUBLE) AS total_matched_amount,
    {_rd('CAST(coalesce(hit_amount, 0) AS DOUBLE) * 1e2 / CAST(img_amount AS DOUBLE)', 1)} AS reconciliation_percentage
  FROM (SELECT session_id, count(*) AS csv FROM ledger GROUP BY 1)
  JOIN (SELECT session_id, count(*) AS img, sum(CAST(amount AS DECIMAL(18,4))) AS img_amount FROM statement GROUP BY 1) USING (session_id)
  LEFT JOIN (SELECT x.session_id, count(*) AS hits, count(*) FILTER (tier = 'high') AS h,
      count(*) FILTER (tier = 'medium') AS m, count(*) FILTER (tier = 'low') AS lo,
      sum(CAST(s.amount AS DECIMAL(18,4))) AS hit_amount
    FROM matches x JOIN statement s ON s.session_id = x.session_id AND s.txn_id = x.stmt GROUP BY 1) USING (session_id))"""

METRICS = """SELECT session_id, CAST(u.position AS INTEGER) AS position, u.metric, u.value FROM (
  SELECT session_id, unnest([
    {'position': 0, 'metric': 'CSV Transactions', 'value': CAST(total_csv_transactions AS VARCHAR)},
    {'position': 1, 'metric': 'Image Transactions', 'value': CAST(total_image_transactions AS VARCHAR)},
    {'position': 2, 'metric': 'Total Matches', 'value': total_matches || ' (' || match_rate || '%)'},
    {'position': 3, 'metric': 'High Confidence Matches', 'value': CAST(high_confidence_matches AS VARCHAR)},
    {'position': 4, 'metric': 'Medium Confidence Matches', 'value': CAST(medium_confidence_matches AS VARCHAR)},
    {'position': 5, 'metric': 'Low Confidence Matches', 'value': CAST(low_confidence_matches AS VARCHAR)},
    {'position': 6, 'metric': 'Match Rate', 'value': match_rate || '%'},
    {'position': 7, 'metric': 'Reconciliation %', 'value': reconciliation_percentage || '%'}]) AS u FROM summary)"""

_LA, _SA = _amount_text("l.amount"), _amount_text("s.amount")
_LV, _SV = "upper(l.vendor)", "upper(s.vendor)"
REASONS = f"""concat_ws(', ',
  CASE WHEN a = 0.4 THEN 'Exact amount match: $' || {_LA} WHEN a = 0.35 THEN 'Close amount match: $' || {_LA} || ' ≈ $' || {_SA}
       WHEN a = 0.2 THEN 'Approximate amount match: $' || {_LA} || ' ≈ $' || {_SA} END,
  CASE WHEN d = 0.25 THEN 'Exact date match: ' || l.date WHEN d = 0.15 THEN 'Similar dates: ' || l.date || ' ≈ ' || s.date END,
  CASE WHEN v = 0.25 THEN 'Exact vendor match: ' || {_LV} WHEN v = 0.2 THEN 'Partial vendor match: ' || {_LV} || ' ≈ ' || {_SV}
       WHEN v = 0.1 THEN 'Vendor keyword match: ' || {_LV} || ' ≈ ' || {_SV} END,
  CASE WHEN e = 0.1 THEN 'Description match: ' || upper(l.description) WHEN e = 0.05 THEN 'Partial description match' END)"""
DISCREPANCIES = f"""concat_ws(', ',
  CASE WHEN a = 0 THEN 'Amount difference: $' || {_LA} || ' vs $' || {_SA} END,
  CASE WHEN v = 0 THEN 'Vendor difference: ' || {_LV} || ' vs ' || {_SV} END)"""
DISPLAY = f"""SELECT m.session_id, m.stmt AS statement_txn_id, tier, format('{{:.1f}}%', confidence_score * 1e2) AS confidence,
  CAST(l.date AS VARCHAR) AS csv_date, l.vendor AS csv_vendor, '$' || {_money('l.amount')} AS csv_amount,
  CAST(s.date AS VARCHAR) AS image_date, s.vendor AS image_vendor, '$' || {_money('s.amount')} AS image_amount,
  {REASONS} AS match_reasons, {DISCREPANCIES} AS discrepancies
FROM matches m JOIN ledger l ON l.session_id = m.session_id AND l.txn_id = m.led
JOIN statement s ON s.session_id = m.session_id AND s.txn_id = m.stmt"""

ROWS_PER_PAGE = 1000


def monthly_doc(rows_per_page: int = ROWS_PER_PAGE) -> str:
    return f"""WITH {LEDGER}, {LARGE}, base AS (SELECT *, {MONTH} AS month FROM ledger),
head AS (SELECT month, {TOTAL} AS t, count(*) AS n, {MEAN} AS mean, count(DISTINCT vendor) AS u, min(date) AS lo, max(date) AS hi FROM base GROUP BY 1),
ct AS (SELECT month, category AS k, {TOTAL} AS t FROM base GROUP BY 1, 2),
vt AS (SELECT month, vendor AS k, {TOTAL} AS t, count(*) AS n FROM base GROUP BY 1, 2),
vr AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY t DESC, k) AS r, row_number() OVER (PARTITION BY month ORDER BY n DESC, k) AS f FROM vt),
dt AS (SELECT month, day(date) AS k, {TOTAL} AS t FROM base GROUP BY 1, 2),
c AS (SELECT month, string_agg('  "' || k || '": ' || {_amount_text('t')}, E',\\n' ORDER BY k) AS x, arg_max(k, (t, -ascii(k))) AS top FROM ct GROUP BY 1),
v AS (SELECT month, string_agg('  "' || k || '": ' || {_amount_text('t')}, E',\\n' ORDER BY r) AS x FROM vr WHERE r <= 10 GROUP BY 1),
f AS (SELECT month, string_agg('  "' || k || '": ' || n, E',\\n' ORDER BY f) AS x FROM vr WHERE f <= 5 GROUP BY 1),
d AS (SELECT month, string_agg(k || ': ' || {_amount_text('t')}, ', ' ORDER BY k) AS x FROM dt GROUP BY 1),
g AS (SELECT month, page, string_agg(date || ' ' || vendor || ' ' || {_amount_text('amount')} || ' ' || category, E'\\n' ORDER BY txn_id) AS x
  FROM (SELECT *, (row_number() OVER (PARTITION BY month ORDER BY txn_id) - 1) // {rows_per_page} AS page FROM large) GROUP BY 1, 2)
SELECT 'month-' || head.month || CASE WHEN page > 0 THEN '-' || page ELSE '' END AS doc_id, 'monthly_summary' AS document_type,
  CASE WHEN page > 0 THEN E'\\nFINANCIAL SUMMARY FOR ' || head.month || E'\\n\\nLARGE TRANSACTIONS (95th percentile), continued:\\n' || g.x || E'\\n' ELSE
  E'\\nFINANCIAL SUMMARY FOR ' || head.month || E'\\n\\nOVERVIEW:\\n- Total Spending: $' || {_thousands('t')}
  || E'\\n- Transaction Count: ' || n || E'\\n- Average Transaction: $' || {_money('mean')}
  || E'\\n- Unique Vendors: ' || u || E'\\n- Date Range: ' || lo || ' to ' || hi
  || E'\\n\\nCATEGORY BREAKDOWN:\\n{{\\n' || c.x || E'\\n}}\\n\\nTOP VENDORS BY SPENDING:\\n{{\\n' || v.x
  || E'\\n}}\\n\\nFREQUENT VENDORS (by transaction count):\\n{{\\n' || f.x
  || E'\\n}}\\n\\nLARGE TRANSACTIONS (95th percentile):\\n' || coalesce(g.x, '')
  || E'\\n\\nDAILY SPENDING PATTERN:\\n{{' || d.x || E'}}\\n' END AS text,
  head.month AS period, CAST(left(head.month, 4) AS INTEGER) AS year, CAST(right(head.month, 2) AS INTEGER) AS month, c.top AS top_category
FROM head JOIN c USING (month) JOIN v USING (month) JOIN f USING (month) JOIN d USING (month) LEFT JOIN g USING (month)"""

ORACLES: dict[str, str] = {
    "analyze_ledger": _dirty(f""", usable AS (SELECT * FROM typed WHERE date IS NOT NULL AND amount IS NOT NULL)
        SELECT 'ledger' AS section, 'all' AS name, count(*) AS transaction_count, {TOTAL2} AS total_amount FROM usable
        UNION ALL SELECT * FROM (SELECT 'vendor', vendor, count(*) AS n, {TOTAL2} FROM usable WHERE vendor IS NOT NULL GROUP BY vendor ORDER BY n DESC, vendor LIMIT 5)
        UNION ALL SELECT 'category', category, count(amount), {TOTAL2} FROM usable WHERE category IS NOT NULL GROUP BY category"""),
    "analyze_categories": _dirty(f"SELECT category, {TOTAL2} AS total_amount, count(amount) AS transaction_count FROM typed WHERE amount IS NOT NULL AND category IS NOT NULL GROUP BY 1"),
    "analyze_category": _dirty(f"SELECT 'eco' AS category, coalesce({TOTAL}, 0) AS total_amount, count(amount) AS transaction_count FROM typed WHERE amount IS NOT NULL AND regexp_matches(category, 'eco', 'i')"),
    "analyze_vendors": _dirty(f"SELECT vendor, {TOTAL2} AS total_amount, count(amount) AS transaction_count, {_rd(MEAN, 2)} AS average_amount FROM typed WHERE amount IS NOT NULL AND vendor IS NOT NULL GROUP BY 1"),
    "analyze_vendor": _dirty(f"SELECT 'GIZMO' AS vendor, {TOTAL} AS total_amount, count(*) AS transaction_count, {_rd(MEAN, 4)} AS average_amount FROM typed WHERE amount IS NOT NULL AND regexp_matches(vendor, 'GIZMO', 'i')"),
    "clean_ledger": _dirty("SELECT txn_id, date, vendor, amount, category FROM typed WHERE date IS NOT NULL AND vendor IS NOT NULL AND amount IS NOT NULL"),
    "reject_count": _dirty("""SELECT count(*) AS rows_read, count(*) FILTER (ok) AS rows_kept, count(*) FILTER (NOT ok) AS rows_removed,
        count(date) AS valid_dates FROM (SELECT *, date IS NOT NULL AND vendor IS NOT NULL AND amount IS NOT NULL AS ok FROM typed)"""),
    "standardised": _ledger("SELECT txn_id, vendor, 'Uncategorized' AS category, vendor AS description FROM ledger"),
    "prepared_for_matching": _dirty("""SELECT txn_id, 'csv' AS source, TRY_CAST(date AS DATE) AS date,
        CASE WHEN amount = 'nan' THEN 0e0 ELSE coalesce(TRY_CAST(amount AS DOUBLE), 0e0) END AS amount, upper(vendor) AS vendor FROM dirty"""),
    "ledger_summary": _ledger(f"SELECT count(*) AS transaction_count, {TOTAL} AS total_amount, {_rd(MEAN, 4)} AS average_amount, min(date) AS first_date, max(date) AS last_date FROM ledger"),
    "session_summary": _ledger(f"SELECT session_id, count(*) AS transaction_count, {TOTAL} AS total_amount, {_rd(MEAN, 4)} AS average_amount, min(date) AS first_date, max(date) AS last_date FROM ledger GROUP BY 1"),
    "summary_text": _ledger(f""", h AS (SELECT count(*) AS n, {TOTAL} AS t, {MEAN} AS mean, min(date) AS lo, max(date) AS hi FROM ledger),
      v AS (SELECT vendor, count(*) AS n, {TOTAL} AS t FROM ledger GROUP BY 1 ORDER BY n DESC, vendor LIMIT 3),
      c AS (SELECT category, {TOTAL} AS t FROM ledger GROUP BY 1 ORDER BY t DESC, category LIMIT 3)
      SELECT E'\\n**\U0001F4CA Ledger Analysis:**\\n\\n**Summary:**\\n• Total Transactions: ' || format('{{:,}}', n) || E'\\n• Total Amount: $' || {_thousands('t')}
        || E'\\n• Average Transaction: $' || {_money('mean')} || E'\\n• Date Range: ' || lo || ' to ' || hi || E'\\n\\n**Top Vendors:**\\n'
        || (SELECT string_agg('• ' || vendor || ': ' || n || ' transactions ($' || {_thousands('t')} || E')\\n', '' ORDER BY n DESC, vendor) FROM v)
        || E'\\n\\n**Top Categories:**\\n' || (SELECT string_agg('• ' || category || ': $' || {_thousands('t')} || E'\\n', '' ORDER BY t DESC, category) FROM c) AS report FROM h"""),
    "top_vendors": _ledger(f"SELECT vendor, count(*) AS transaction_count, {TOTAL} AS total_amount FROM ledger GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "top_categories": _ledger(f"SELECT category, {TOTAL} AS total_amount FROM ledger GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
    "category_breakdown": _ledger(f"SELECT category, {TOTAL} AS total_amount FROM ledger WHERE category IS NOT NULL GROUP BY 1"),
    "spending_by_category": _ledger(f"SELECT category, {TOTAL2} AS total_amount, count(amount) AS transaction_count FROM ledger GROUP BY 1"),
    "category_detail": _ledger("SELECT date, vendor, amount, description FROM ledger WHERE regexp_matches(category, 'eco', 'i')"),
    "category_total": _ledger(f"SELECT 'eco' AS category, {TOTAL} AS total_amount, count(*) AS transaction_count FROM ledger WHERE regexp_matches(category, 'eco', 'i')"),
    "vendor_stats": _ledger(f"SELECT vendor, {TOTAL2} AS total_amount, count(amount) AS transaction_count, {_rd(MEAN, 2)} AS average_amount FROM ledger GROUP BY 1"),
    "vendor_detail": _ledger("SELECT date, amount, category, description FROM ledger WHERE regexp_matches(vendor, 'GIZMO', 'i')"),
    "vendor_total": _ledger(f"SELECT 'GIZMO' AS vendor, {TOTAL} AS total_amount, count(*) AS transaction_count, {_rd(MEAN, 4)} AS average_amount FROM ledger WHERE regexp_matches(vendor, 'GIZMO', 'i')"),
    "monthly_stats": _ledger(f"SELECT {MONTH} AS month, {TOTAL} AS total_amount, count(*) AS transaction_count, {_rd(MEAN, 4)} AS average_amount, count(DISTINCT vendor) AS unique_vendors, min(date) AS first_date, max(date) AS last_date FROM ledger GROUP BY 1"),
    "month_category": _ledger(f"SELECT {MONTH} AS month, category, {TOTAL} AS total_amount FROM ledger GROUP BY 1, 2"),
    "month_top_category": _ledger(f"SELECT month, category AS top_category FROM (SELECT {MONTH} AS month, category, row_number() OVER (PARTITION BY {MONTH} ORDER BY sum(CAST(amount AS DECIMAL(18,4))) DESC, category) AS r FROM ledger GROUP BY 1, 2) WHERE r = 1"),
    "month_top_vendors": _ledger(f"SELECT month, vendor, total_amount, CAST(r AS INTEGER) AS rank FROM (SELECT {MONTH} AS month, vendor, {TOTAL} AS total_amount, row_number() OVER (PARTITION BY {MONTH} ORDER BY {TOTAL} DESC, vendor) AS r FROM ledger GROUP BY 1, 2) WHERE r <= 10"),
    "month_frequent_vendors": _ledger(f"SELECT month, vendor, n AS transaction_count, CAST(r AS INTEGER) AS rank FROM (SELECT {MONTH} AS month, vendor, count(*) AS n, row_number() OVER (PARTITION BY {MONTH} ORDER BY count(*) DESC, vendor) AS r FROM ledger GROUP BY 1, 2) WHERE r <= 5"),
    "month_p95": _ledger(f", {LARGE} SELECT month, {_rd('p95', 4)} AS p95 FROM p"),
    "month_large_txns": _ledger(f", {LARGE} SELECT month, txn_id, date, vendor, amount, {_rd('p95', 4)} AS p95 FROM large"),
    "month_daily": _ledger(f"SELECT {MONTH} AS month, CAST(day(date) AS INTEGER) AS day, {TOTAL} AS total_amount FROM ledger GROUP BY 1, 2"),
    "anomaly_mom": _ledger(f""", t AS ({MONTH_TOTALS}), w AS (SELECT *, CASE WHEN lag(m) OVER (ORDER BY m) + INTERVAL 1 MONTH = m THEN lag(total_amount) OVER (ORDER BY m) END AS p FROM t)
        SELECT strftime(m, '%Y-%m') AS month, {_rd('total_amount', 6)} AS total_amount, {_rd('p', 6)} AS previous_amount, {_rd('(total_amount - p) / abs(p)', 6)} AS change,
        coalesce(abs((total_amount - p) / abs(p)) > 2e-1, false) AS is_anomaly FROM w"""),
    "anomaly_new_vendor": _ledger(f""", {LARGE}, b AS (SELECT *, {MONTH} AS month FROM ledger),
        f AS (SELECT vendor, min(month) AS month FROM b GROUP BY 1)
        SELECT vendor, month, {TOTAL} AS total_amount, count(*) AS transaction_count, max(amount) > any_value(p95) AS large
        FROM b JOIN f USING (vendor, month) JOIN p USING (month) WHERE month > (SELECT min(month) FROM b) GROUP BY 1, 2"""),
    "anomaly_category": _ledger(f""", t AS (SELECT {MONTH} AS month, category, {TOTAL} AS total_amount FROM ledger GROUP BY 1, 2),
        w AS (SELECT *, count(*) OVER x AS n, avg(total_amount) OVER x AS mean, stddev_samp(total_amount) OVER x AS sd FROM t
              WINDOW x AS (PARTITION BY category ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        z AS (SELECT *, CASE WHEN n >= 3 AND sd <> 0 THEN (total_amount - mean) / sd END AS score FROM w)
        SELECT month, category, {_rd('total_amount', 4)} AS total_amount, n AS prior_months, {_rd('mean', 4)} AS prior_mean, {_rd('score', 4)} AS z_score,
        coalesce(abs(score) > 2, false) AS is_anomaly FROM z"""),
    "anomaly_amount": _ledger(f""", q AS (SELECT category, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM ledger GROUP BY 1)
        SELECT txn_id, category, amount, {_rd('q3 + 5e-1 * (q3 - q1)', 4)} AS fence FROM ledger JOIN q USING (category) WHERE amount > q3 + 5e-1 * (q3 - q1)"""),
    "anomaly_frequency": _ledger(f""", t AS (SELECT vendor, {MONTH} AS month, count(*) AS n FROM ledger GROUP BY 1, 2)
        SELECT vendor, month, n AS transaction_count, {_rd('avg(n) OVER x', 4)} AS prior_mean,
        count(*) OVER x = 3 AND coalesce(n > 2 * avg(n) OVER x, false) AS is_anomaly FROM t
        WINDOW x AS (PARTITION BY vendor ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"""),
    "anomaly_seasonal": _ledger(f""", t AS (SELECT *, CAST(total_amount AS DECIMAL(28,4)) AS td FROM ({MONTH_TOTALS})),
        w AS (SELECT *, CAST(sum(td) OVER x - td AS DOUBLE) / nullif(count(*) OVER x - 1, 0) AS o FROM t WINDOW x AS (PARTITION BY month(m)))
        SELECT strftime(m, '%Y-%m') AS month, {_rd('total_amount', 4)} AS total_amount, CAST(month(m) AS INTEGER) AS calendar_month,
        {_rd('o', 4)} AS other_years_mean, coalesce(total_amount > 11e-1 * o, false) AS is_anomaly FROM w"""),
    "clean_text": _ledger(f", {NAMES} SELECT txn_id, array_to_string({_WORDS.format(stop=_MATCH_STOP)}, ' ') AS cleaned FROM names"),
    "standard_vendor": _ledger(f""", {NAMES}, k AS (SELECT txn_id, array_to_string({_WORDS.format(stop=_VENDOR_STOP)}, ' ') AS n FROM names),
        parts AS (SELECT txn_id, regexp_extract_all(lower(n), '[a-z]+|[^a-z]+') AS p FROM k)
        SELECT txn_id, array_to_string(list_transform(p, lambda w: upper(w[1]) || substr(w, 2)), '') AS vendor FROM parts"""),
    "parse_responses": _ledger(f""", {RESPONSES} SELECT session_id, filename, position, TRY_CAST(json_extract_string(value, '$.date') AS DATE) AS date, amount,
        json_extract_string(value, '$.vendor') AS vendor, json_extract_string(value, '$.description') AS description,
        json_extract_string(value, '$.type') AS type, 'image_extraction' AS source
        FROM fields WHERE amount IS NOT NULL AND list_contains(json_keys(value), 'amount') AND list_contains(json_keys(value), 'vendor')"""),
    "parse_responses_strict": _ledger(f""", {RESPONSES}, k AS (SELECT *, array_to_string({_WORDS.format(stop=_VENDOR_STOP)}, ' ') AS n
          FROM (SELECT *, json_extract_string(value, '$.vendor') AS name FROM fields)),
        parts AS (SELECT *, regexp_extract_all(lower(n), '[a-z]+|[^a-z]+') AS p FROM k)
        SELECT session_id, filename, position, TRY_CAST(json_extract_string(value, '$.date') AS DATE) AS date, amount,
        array_to_string(list_transform(p, lambda w: upper(w[1]) || substr(w, 2)), '') AS vendor,
        trim(json_extract_string(value, '$.description')) AS description,
        coalesce(lower(trim(json_extract_string(value, '$.type'))), 'debit') AS type, 'image_extraction' AS source
        FROM parts WHERE amount IS NOT NULL AND name IS NOT NULL AND json_extract_string(value, '$.date') IS NOT NULL
          AND json_extract_string(value, '$.description') IS NOT NULL"""),
    "extraction_envelope": _ledger(f""", {RESPONSES}, n AS (SELECT filename, count(*) AS c FROM fields
          WHERE amount IS NOT NULL AND list_contains(json_keys(value), 'amount') AND list_contains(json_keys(value), 'vendor') GROUP BY 1)
        SELECT session_id, filename, 'success' AS status, coalesce(c, 0) AS total_transactions, substr(trim(response), 1, 500) AS raw_response
        FROM responses LEFT JOIN n USING (filename)"""),
    "score_pairs": _near("SELECT session_id, stmt, led, a, d, v, e, score FROM scored", 3),
    "score_components_graded": f"""WITH {LEDGER}, {STATEMENT}, x AS (
        SELECT s.session_id, s.txn_id AS stmt, l.txn_id AS led, abs(l.amount - s.amount) AS diff,
          greatest(1e-2, (abs(l.amount) + abs(s.amount)) / 2 * 2e-2) AS scale, abs(date_diff('day', l.date, s.date)) AS days,
          string_split(upper(l.vendor), ' ') AS lv, string_split(upper(s.vendor), ' ') AS sv,
          upper(l.description) = upper(s.description) AS same
        FROM statement s JOIN ledger l ON s.session_id = l.session_id AND abs(date_diff('day', l.date, s.date)) <= 6)
        SELECT session_id, stmt, led,
          CAST(CASE WHEN diff <= 1e-2 THEN 1.0 WHEN diff <= scale THEN 0.9 WHEN diff <= scale * 3 THEN 0.7 WHEN diff <= scale * 5 THEN 0.5 ELSE 0 END AS DOUBLE) AS amount_score,
          round(CASE WHEN days = 0 THEN 1e0 WHEN days <= 3 THEN 1e0 - days / 3e0 * 3e-1 ELSE 5e-1 END, 6) AS date_score,
          round(len(list_distinct(list_intersect(lv, sv))) / CAST(len(list_distinct(list_concat(lv, sv))) AS DOUBLE), 6) AS vendor_words,
          CAST(CASE WHEN same THEN 1 ELSE 0 END AS DOUBLE) AS description_words FROM x""",
    "best_match": f"WITH {LEDGER}, {STATEMENT}, {SCORES.format(extra='')} SELECT session_id, stmt, led, score FROM (SELECT *, row_number() OVER (PARTITION BY session_id, stmt ORDER BY score DESC, led) AS r FROM scored WHERE score > 3e-1) WHERE r = 1",
    "reconcile_matches": _matching(MATCHES_OUT),
    "reconcile_large_sessions": _matching(MATCHES_OUT, NATION_LEDGER),
    "reconcile_unmatched": _matching(f"SELECT session_id, txn_id, source, CAST(date AS VARCHAR) AS date, vendor, '$' || {_money('amount')} AS amount, description FROM unmatched", more=f", {UNMATCHED}"),
    "reconcile_summary": _matching("SELECT * FROM summary", more=f", {SUMMARY}"),
    "reconcile_metric_rows": _matching(METRICS, more=f", {SUMMARY}"),
    "reconcile_display": _matching(DISPLAY),
    "reconcilable_sessions": f"WITH {LEDGER}, {STATEMENT} SELECT DISTINCT session_id FROM ledger WHERE session_id IN (SELECT session_id FROM statement)",
    "index_texts": _ledger(f"SELECT txn_id, {INDEX_TEXT} AS text FROM ledger"),
    "txn_documents": _ledger(f"""SELECT 'txn-' || txn_id AS doc_id, 'transaction' AS document_type,
        E'\\nTRANSACTION RECORD\\n\\nDate: ' || date || E' 00:00:00\\nVendor: ' || vendor || E'\\nAmount: $' || {_money('amount')}
        || E'\\nCategory: ' || category || E'\\nDescription: ' || description || E'\\n\\nContext:\\n- Day of week: ' || dayname(date)
        || E'\\n- Month: ' || monthname(date) || ' ' || year(date) || E'\\n' AS text, category, date || ' 00:00:00' AS date, amount FROM ledger"""),
    "monthly_documents": monthly_doc(),
    "index_stats": _ledger(f", {LARGE}, n AS (SELECT p.month, greatest(1, ceil(count(large.txn_id) / {ROWS_PER_PAGE})) AS pages FROM p LEFT JOIN large USING (month) GROUP BY 1) SELECT 'Index ready' AS status, count(*) + CAST((SELECT sum(pages) FROM n) AS BIGINT) AS document_count, count(*) AS data_rows, CAST(min(date) AS VARCHAR) AS start, CAST(max(date) AS VARCHAR) AS end FROM ledger"),
    "similar_transactions": _ledger(f", {SIMILAR} SELECT doc_id, text, amount, round(similarity, 6) AS similarity FROM hits"),
    "retrieval_context": _ledger(f", {SIMILAR} SELECT (SELECT string_agg(text, E'\\n' ORDER BY similarity DESC, doc_id DESC) FROM (SELECT * FROM hits ORDER BY similarity DESC, doc_id DESC LIMIT 3)) AS context, count(*) AS matching_transactions, coalesce(CAST(sum(CAST(amount AS DECIMAL(28,4))) AS DOUBLE), 0e0) AS total_amount FROM hits"),
    "similar_to_labels": _ledger(f""", {VECTORS},
        m AS (SELECT label, i, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2),
        q AS (SELECT label, list(x ORDER BY i) AS qv FROM m GROUP BY 1),
        s AS (SELECT q.label, doc_id, round(list_cosine_similarity(v, qv), 9) AS similarity FROM vectors, q),
        r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, doc_id DESC) AS k FROM s)
        SELECT CAST(label AS VARCHAR) AS query_id, CAST(k AS INTEGER) AS rank, doc_id, round(similarity, 6) AS similarity FROM r WHERE k <= 5 AND similarity > 1e-1"""),
    "hashed_embeddings": _ledger(f", {VECTORS} SELECT doc_id AS txn_id, list_transform(v, lambda x: round(x, 6)) AS embedding FROM vectors"),
    "session_catalog": _ledger("SELECT session_id, count(*) AS transaction_count, max(date) AS created_at FROM ledger GROUP BY 1"),
    "session_count": _ledger("SELECT count(DISTINCT session_id) AS session_count FROM ledger"),
    "records": _ledger("SELECT CAST(to_json({'session_id': session_id, 'txn_id': txn_id, 'date': CAST(date AS VARCHAR), 'vendor': vendor, 'amount': amount, 'category': category, 'description': description}) AS VARCHAR) AS record FROM ledger"),
}

_FLAGGED = {"month_over_month": "anomaly_mom", "category_deviation": "anomaly_category", "vendor_frequency": "anomaly_frequency"}
ORACLES["anomalies"] = " UNION ALL ".join(
    [f"SELECT '{rule}' AS rule, count(*) AS findings FROM ({ORACLES[key]}) WHERE is_anomaly HAVING count(*) > 0" for rule, key in _FLAGGED.items()]
    + [
        f"SELECT 'new_vendor', count(*) FROM ({ORACLES['anomaly_new_vendor']}) HAVING count(*) > 0",
        f"SELECT 'amount_outlier', count(*) FROM ({ORACLES['anomaly_amount'].replace('5e-1', '15e-1')}) HAVING count(*) > 0",
        f"SELECT 'seasonal_spike', count(*) FROM ({ORACLES['anomaly_seasonal'].replace('11e-1', '2')}) WHERE is_anomaly HAVING count(*) > 0",
    ]
)

ORACLES["csv_rows"] = _ledger(
    "SELECT txn_id, CAST(date AS VARCHAR) AS date, vendor, CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) AS amount, category FROM ledger"
)
ORACLES["ledger_documents"] = (
    f"SELECT doc_id, document_type, text FROM ({monthly_doc()}) UNION ALL SELECT doc_id, document_type, text FROM ({ORACLES['txn_documents']})"
)
ORACLES["extract_responses"] = _ledger("SELECT session_id, CAST(txn_id AS VARCHAR) AS filename, vendor, amount FROM ledger")
ORACLES["index_search"] = ORACLES["similar_transactions"]
ORACLES["index_search_batch"] = ORACLES["similar_to_labels"]
ORACLES["document_index"] = (
    f"SELECT doc_id, document_type, sha256(text) AS digest, CAST(0 AS INTEGER) AS embedded_again FROM ({ORACLES['ledger_documents']})"
)
ORACLES["document_query"] = f"""
WITH docs AS ({ORACLES["ledger_documents"]}),
asked AS (SELECT DISTINCT p_type AS query_id, 'Transaction record of category: ' || p_type AS text FROM part),
{_embedded("docs", "d", "doc_id")}, {_embedded("asked", "q", "query_id")},
s AS (SELECT q.query_id, d.doc_id, round(list_cosine_similarity(d.v, q.v), 9) AS similarity FROM d, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id DESC) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, doc_id, round(similarity, 6) AS similarity FROM r WHERE k <= 5 AND similarity > 1e-1
"""
ORACLES["reconcile_sparse"] = _sparse(MATCHES_OUT)
ORACLES["reconcile_sparse_unmatched"] = _sparse("""
  SELECT session_id, txn_id, 'Image (Unmatched)' AS source, date, vendor, amount, description FROM statement s
  WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.session_id = s.session_id AND m.stmt = s.txn_id)
  UNION ALL
  SELECT session_id, txn_id, 'CSV (Unmatched)', date, vendor, amount, description FROM ledger l
  WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.session_id = l.session_id AND m.led = l.txn_id)""")
ORACLES["sparse_sessions"] = f"WITH {SPARSE} SELECT DISTINCT session_id FROM ledger WHERE session_id IN (SELECT session_id FROM statement)"
ORACLES["vendor_from_description"] = _ledger("SELECT txn_id, description AS vendor, category, description FROM ledger")


def _list_of(texts: str) -> str:
    """The list form of a ``concat_ws`` of texts."""
    return "list_filter([" + texts.removeprefix("concat_ws(', ',")[:-1] + "], lambda x: x IS NOT NULL)"


def _record(row: str) -> str:
    columns = ("session_id", "txn_id", "date", "vendor", "amount") + (("category",) if row == "l" else ()) + ("description",)
    return "{" + ", ".join(f"'{c}': {row}.{c}" for c in columns) + "}"


def _statement_text(row: str, columns: str) -> str:
    return "CAST(to_json({" + ", ".join(f"'{c}': {row}.{c}" for c in columns.split()) + "}) AS VARCHAR)"


def nested_doc(records_per_part: int) -> str:
    measures = """total_image_transactions total_csv_transactions total_matches match_rate high_confidence_matches
      medium_confidence_matches low_confidence_matches unmatched_image_transactions unmatched_csv_transactions
      total_image_amount total_matched_amount reconciliation_percentage"""
    return _matching(
        f"""SELECT session_id, CAST(0 AS INTEGER) AS list, CAST(0 AS BIGINT) AS part,
          '{{"status":"success","summary":' || {_statement_text("summary", measures)} AS body FROM summary
        UNION ALL
        SELECT session_id, k.list, coalesce(part, 0), CASE WHEN coalesce(part, 0) = 0 THEN k.opening ELSE ',' END || coalesce(body, '')
        FROM summary CROSS JOIN lists k LEFT JOIN parts USING (session_id, list)
        UNION ALL SELECT session_id, 6, 0, ']}}}}' FROM summary""",
        more=f""", {SUMMARY}, records AS (
          SELECT m.session_id, CASE tier WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS list, m.stmt AS key,
            CAST(to_json({{'statement_txn_id': m.stmt, 'ledger_txn_id': m.led, 'amount_score': a, 'date_score': d, 'vendor_score': v,
              'description_score': e, 'confidence_score': confidence_score, 'match_type': match_type, 'tier': tier,
              'match_reasons': {_list_of(REASONS)}, 'discrepancies': {_list_of(DISCREPANCIES)}, 'recommendation': {RECOMMEND},
              'ledger_transaction': {_record("l")}, 'statement_transaction': {_record("s")}}}) AS VARCHAR) AS body
          FROM matches m JOIN ledger l ON l.session_id = m.session_id AND l.txn_id = m.led
          JOIN statement s ON s.session_id = m.session_id AND s.txn_id = m.stmt
          UNION ALL
          SELECT session_id, 4, txn_id, {_statement_text("s", "txn_id date vendor amount description")} FROM statement s
          WHERE (session_id, txn_id) NOT IN (SELECT (session_id, stmt) FROM matches)
          UNION ALL
          SELECT session_id, 5, txn_id, {_statement_text("l", "txn_id date vendor amount category description")} FROM ledger l
          WHERE (session_id, txn_id) NOT IN (SELECT (session_id, led) FROM matches)),
        parts AS (
          SELECT session_id, list, part, string_agg(body, ',' ORDER BY key) AS body
          FROM (SELECT *, (row_number() OVER (PARTITION BY session_id, list ORDER BY key) - 1) // {records_per_part} AS part FROM records)
          GROUP BY 1, 2, 3),
        lists AS (SELECT * FROM (VALUES (1, ',"matches":{{"high_confidence":['), (2, '],"medium_confidence":['), (3, '],"low_confidence":['),
          (4, ']}},"unmatched":{{"image_transactions":['), (5, '],"csv_transactions":[')) t(list, opening))""",
    )


ORACLES["reconcile_nested"] = nested_doc(4)
