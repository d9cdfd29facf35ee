"""SQL for DuckDB that computes each registered query in another way."""

from __future__ import annotations

from marquee.operators.postings import STOP_WORDS
from marquee_checks.queries import (
    BALANCE_DATE,
    END,
    MARK,
    PERIODS,
    REWARDS_AMOUNT,
    REWARDS_DATE,
    REWARDS_PURCHASES,
    SEARCH,
    START,
    YEAR,
)

MODEL = """
lead_line AS (
  SELECT * FROM lineitem QUALIFY row_number() OVER (
    PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_linestatus, l_shipdate) = 1),
rental AS (
  SELECT o_orderkey AS rental_id, o_orderdate AS rental_date, l_orderkey AS inventory_id,
         o_custkey AS customer_id, CASE WHEN l_linestatus <> 'O' THEN l_shipdate END AS return_date,
         l_suppkey AS staff_id
  FROM orders LEFT JOIN lead_line ON l_orderkey = o_orderkey),
copies AS (
  SELECT l_orderkey AS inventory_id, l_partkey AS film_id, s_nationkey AS store_id
  FROM lead_line LEFT JOIN supplier ON s_suppkey = l_suppkey),
payment AS (
  SELECT l_orderkey AS rental_id, o_custkey AS customer_id,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_shipdate AS payment_date
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey),
film AS (
  SELECT p_partkey AS film_id, p_name || ' #' || p_partkey AS title, p_brand AS description,
         p_type AS category, p_size AS rental_duration, CAST(p_retailprice AS DECIMAL(18,2)) AS rate
  FROM part),
person AS (
  SELECT s_suppkey AS id, split_part(s_name, '#', 1) AS first_name, split_part(s_name, '#', 2) AS last_name,
         split_part(s_name, '#', 1) || ' ' || split_part(s_name, '#', 2) AS name, s_nationkey AS nation
  FROM supplier),
renter AS (
  SELECT c_custkey AS id, split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
         split_part(c_name, '#', 1) || ' ' || split_part(c_name, '#', 2) AS name, c_nationkey AS nation,
         c_acctbal >= 0 AS active
  FROM customer),
playing AS (
  SELECT DISTINCT l_partkey AS film_id, l_suppkey AS actor_id, name AS actor_name
  FROM lineitem LEFT JOIN person ON id = l_suppkey),
place AS (
  SELECT n_nationkey AS nation, n_name AS city, r_name AS country
  FROM nation JOIN region ON r_regionkey = n_regionkey)
"""

EVENT_MODEL = """
rental AS (
  SELECT event_id AS rental_id, ts AS rental_date, event_type AS inventory_id, user_id AS customer_id
  FROM events WHERE {keep}),
copies AS (SELECT DISTINCT event_type AS inventory_id, event_type AS film_id FROM events),
payment AS (SELECT event_id AS rental_id, CAST(value AS DECIMAL(18,2)) AS amount FROM events),
film AS (SELECT DISTINCT event_type AS film_id, event_type AS title FROM events),
playing AS (SELECT '' AS film_id, 0 AS actor_id, '' AS actor_name WHERE false)
"""


def ratio(num: str, den: str, scale: int) -> str:
    """Whole-number ratio rounded half away from zero, as a double."""
    n, d = f"CAST({num} AS HUGEINT)", f"nullif(CAST({den} AS HUGEINT), 0)"
    units = f"(abs({n}) * {2 * 10**scale} + abs({d})) // (2 * abs({d}))"
    return f"CAST(sign({n}) * sign({d}) * ({units}) AS DOUBLE) / {10**scale}"


def model(query: str) -> str:
    return f"WITH {MODEL}, {query}" if not query.lstrip().upper().startswith("SELECT") else f"WITH {MODEL} {query}"


def lifecycle(
    p: str, rental: str = "rental", days: int = 30, single: bool = True, gaps: bool = False,
    actor: str = "actor_name", by_id: bool = False,
) -> str:
    """CTEs ``{p}_...`` ending in ``{p}_table``, the lifecycle of the rows in ``rental``."""
    one_time = "" if not single else "AND a.rental_id <> b.rental_id"
    count = "(num_distinct - 1)" if gaps else "num_of_rentals"
    micros = 86400000000
    if by_id:
        at_ends = "WHERE r.rental_date IN (s.first_rent_date, s.last_rent_date)"
        up, down = "rental_id", "rental_id DESC"
    else:
        at_ends, up, down = "", "rental_date, rental_id", "rental_date DESC, rental_id DESC"
    return f"""
{p}_paid AS (
  SELECT r.rental_id, r.customer_id, r.rental_date, coalesce(y.amount, 0) AS amount
  FROM {rental} r LEFT JOIN payment y ON y.rental_id = r.rental_id),
{p}_span AS (
  SELECT customer_id, min(rental_date) AS first_rent_date, max(rental_date) AS last_rent_date,
         min(rental_date) + INTERVAL {days} DAY AS thirty_days_date, sum(amount) AS total,
         count(*) AS num_of_rentals, count(DISTINCT rental_id) AS num_distinct
  FROM {p}_paid GROUP BY customer_id),
{p}_early AS (
  SELECT customer_id, sum(amount) AS early FROM {p}_paid JOIN {p}_span USING (customer_id)
  WHERE rental_date < thirty_days_date GROUP BY customer_id),
{p}_tier AS (
  SELECT customer_id, early, CAST(ntile(10) OVER (ORDER BY early DESC, customer_id) AS INTEGER) AS value_tier
  FROM {p}_early),
{p}_line AS (
  SELECT r.customer_id, r.rental_id, r.rental_date, f.title,
         row_number() OVER (PARTITION BY r.customer_id ORDER BY {up}) AS up,
         row_number() OVER (PARTITION BY r.customer_id ORDER BY {down}) AS down
  FROM {rental} r JOIN {p}_span s ON s.customer_id = r.customer_id
  LEFT JOIN copies c ON c.inventory_id = r.inventory_id LEFT JOIN film f ON f.film_id = c.film_id {at_ends}),
{p}_pair AS (
  SELECT a.customer_id, CASE WHEN (a.rental_date, a.rental_id) <= (b.rental_date, b.rental_id) THEN a ELSE b END AS x,
         CASE WHEN (a.rental_date, a.rental_id) <= (b.rental_date, b.rental_id) THEN b ELSE a END AS y
  FROM {p}_line a JOIN {p}_line b ON a.customer_id = b.customer_id
  WHERE a.up = 1 AND b.down = 1 {one_time}),
{p}_film AS (
  SELECT customer_id, x.rental_date AS first_rental_date, x.title AS first_film,
         y.rental_date AS last_rental_date, y.title AS latest_film
  FROM {p}_pair WHERE y.title IS NOT NULL),
{p}_seen AS (
  SELECT r.customer_id, w.actor_name, row_number() OVER (
           PARTITION BY r.customer_id ORDER BY count(*) DESC, w.actor_name NULLS LAST, {actor} NULLS LAST) AS pos
  FROM {rental} r LEFT JOIN copies c ON c.inventory_id = r.inventory_id
  LEFT JOIN playing w ON w.film_id = c.film_id GROUP BY r.customer_id, w.actor_name, {actor}),
{p}_fav AS (
  SELECT customer_id, max(actor_name) FILTER (pos = 1) AS fav_actor_one,
         max(actor_name) FILTER (pos = 2) AS fav_actor_two, max(actor_name) FILTER (pos = 3) AS fav_actor_three
  FROM {p}_seen GROUP BY customer_id),
{p}_rate AS (
  SELECT *, (epoch_us(last_rental_date) - epoch_us(thirty_days_date)) / {micros}.0 AS days_after,
         CAST(early AS DOUBLE) / {days} AS per_day
  FROM {p}_span LEFT JOIN {p}_tier USING (customer_id) LEFT JOIN {p}_film USING (customer_id)),
{p}_table AS (
  SELECT customer_id, first_rent_date, thirty_days_date, CAST(early AS DOUBLE) AS thirty_days_revenue,
         value_tier, first_film, latest_film, last_rental_date,
         {ratio("epoch_us(last_rental_date) - epoch_us(first_rental_date)", f"{count} * {micros}", 2)}
           AS avg_time_days_between_rental,
         CAST(total AS DOUBLE) AS total_revenue, fav_actor_one, fav_actor_two, fav_actor_three,
         CASE WHEN early = 0 THEN round(CAST(total AS DOUBLE) / nullif(days_after, 0) * 100, 2)
              ELSE round((CAST(total - early AS DOUBLE) / nullif(days_after, 0) - per_day) / per_day * 100, 2)
         END AS revenue_growth_rate
  FROM {p}_rate LEFT JOIN {p}_fav USING (customer_id))"""


def life(select: str, **options) -> str:
    return model(f"{lifecycle('c', **options)} {select}")


def event_life(keep: str = "true") -> str:
    return f"WITH {EVENT_MODEL.format(keep=keep)}, {lifecycle('c', days=7)} SELECT * FROM c_table"


INCREMENT = f"""
known AS (SELECT * FROM rental WHERE rental_date <= TIMESTAMP '{MARK}'),
fresh AS (SELECT * FROM rental WHERE rental_date > TIMESTAMP '{MARK}'),
staged AS (SELECT * FROM rental WHERE customer_id IN (SELECT customer_id FROM fresh))"""

MERGED = f"""{INCREMENT}, {lifecycle('o', 'known')}, {lifecycle('n', 'staged')},
merged AS (
  SELECT * FROM n_table UNION ALL
  SELECT * FROM o_table WHERE customer_id NOT IN (SELECT customer_id FROM n_table))"""

WATCHED = """
watched AS (
  SELECT customer_id, title, category, count(*) AS n
  FROM rental LEFT JOIN copies USING (inventory_id) LEFT JOIN film USING (film_id) GROUP BY ALL),
in_category AS (
  SELECT customer_id, category, CAST(sum(n) AS BIGINT) AS num_rental FROM watched GROUP BY ALL),
favourite AS (
  SELECT customer_id, category, num_rental FROM in_category
  QUALIFY num_rental = max(num_rental) OVER (PARTITION BY customer_id)),
unseen AS (
  SELECT customer_id, f.category, f.title, f.film_id, f.rate, f.rental_duration
  FROM favourite v JOIN film f ON f.category = v.category
  WHERE NOT EXISTS (SELECT 1 FROM watched w WHERE w.customer_id = v.customer_id
                    AND w.title = f.title AND w.category IS NOT NULL)),
advised AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY rate DESC, rental_duration, film_id) AS pos
  FROM unseen)"""

RECOMMENDED = f"""{WATCHED}
SELECT customer_id, name AS customer_name, category, title, film_id
FROM advised JOIN renter ON id = customer_id WHERE pos <= 10"""

LISTED_FILMS = """SELECT f.film_id AS fid, title, description, category, CAST(rate AS DOUBLE) AS price,
  rental_duration AS length, description AS rating, string_agg({name}, ', ' ORDER BY {name}) AS actors
FROM film f JOIN playing w ON w.film_id = f.film_id JOIN person ON person.id = w.actor_id GROUP BY ALL"""

SOLD = """FROM payment y JOIN rental r ON r.rental_id = y.rental_id
JOIN copies c ON c.inventory_id = r.inventory_id"""

STOCK = """stock AS (
  SELECT inventory_id, film_id, store_id, NOT EXISTS (
    SELECT 1 FROM rental r WHERE r.inventory_id = c.inventory_id AND return_date IS NULL) AS in_stock
  FROM copies c)"""

_LATE = "(epoch_us(return_date) - epoch_us(rental_date) - rental_duration * 86400000000)"


def _top_titles(columns: str) -> str:
    return model(f"""SELECT {columns}, num_of_rental FROM (
  SELECT category AS category_name, {columns.removeprefix('category_name, ')}, count(*) AS num_of_rental
  FROM rental LEFT JOIN copies USING (inventory_id) LEFT JOIN film USING (film_id)
  WHERE rental_date >= TIMESTAMP '{START}' AND rental_date < TIMESTAMP '{END}' + INTERVAL 1 DAY
  GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY category_name ORDER BY num_of_rental DESC, title NULLS LAST) <= 10""")


def _mid_value(weight: str) -> str:
    return model(f"""
joined AS (
  SELECT r.rental_id, r.customer_id, r.rental_date, r.inventory_id, coalesce(amount, 0) AS amount
  FROM rental r LEFT JOIN payment y ON y.rental_id = r.rental_id WHERE year(rental_date) = {YEAR}),
ranked AS (
  SELECT customer_id, ntile(10) OVER (ORDER BY sum(amount), customer_id) AS tile FROM joined GROUP BY customer_id)
SELECT strftime(rental_date, '%Y-%m') AS month, store_id, {ratio('sum(amount) * 100', f'100 * {weight}', 6)} AS amount
FROM joined LEFT JOIN copies USING (inventory_id)
WHERE customer_id IN (SELECT customer_id FROM ranked WHERE tile BETWEEN 2 AND 9) GROUP BY 1, 2""")


def _balance(extra: str = "") -> str:
    return model(f"""
charged AS (
  SELECT customer_id, sum(rate) AS fees,
         sum(CASE WHEN {_LATE} > 0 THEN {_LATE} // 86400000000 ELSE 0 END) AS late,
         sum(CASE WHEN {_LATE} > 2 * rental_duration * 86400000000 THEN rate ELSE 0 END) AS kept
  FROM rental JOIN copies USING (inventory_id) JOIN film USING (film_id)
  WHERE rental_date <= TIMESTAMP '{BALANCE_DATE}' GROUP BY 1),
paid AS (
  SELECT customer_id, sum(amount) AS paid FROM payment
  WHERE payment_date <= TIMESTAMP '{BALANCE_DATE}' GROUP BY 1)
SELECT id AS customer_id,
  CAST(coalesce(fees, 0) + coalesce(late, 0) {extra} - coalesce(paid, 0) AS DOUBLE) AS balance
FROM renter LEFT JOIN charged c ON c.customer_id = id LEFT JOIN paid p ON p.customer_id = id""")


def _address_list(people: str, street: str, notes: str) -> str:
    return model(f"""SELECT id, name, {street} AS address, lpad(CAST(nation AS VARCHAR), 5, '0') AS "zip code",
  CAST(nation + 10 AS VARCHAR) || '-' || id AS phone, city, country, {notes} nation AS sid
FROM {people} JOIN place USING (nation)""")


NEWEST = """SELECT o_orderdate AS latest_date, o_orderkey AS latest_id FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1"""

_STOP = ", ".join(f"'{word}'" for word in STOP_WORDS)
POSTINGS = rf"""postings AS (
  SELECT term, doc_id, count(*) AS tf
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM documents)
  WHERE term NOT IN ({_STOP}) GROUP BY ALL)"""
def _cut(at: int) -> str:
    """Where part ``at`` of the events' time begins."""
    low, high = "epoch_us(min(ts))", "epoch_us(max(ts))"
    return f"(SELECT make_timestamp({low} + ({high} - {low}) * {at} // {PERIODS}) FROM events)"


_TERMS = ", ".join(f"'{word}'" for word in SEARCH)

ORACLE: dict[str, str] = {
    "top_titles_by_category": _top_titles("category_name, title"),
    "top_titles_by_category_film": _top_titles("category_name, title, film_id"),
    "mid_value_store_month": _mid_value("count(*)"),
    "mid_value_store_month_customer": _mid_value("count(DISTINCT customer_id)"),
    "item_recommendations": model(RECOMMENDED),
    "customer_lifecycle": life("SELECT * FROM c_table"),
    "customer_lifecycle_other_rules": life(
        "SELECT * FROM c_table", single=False, gaps=True, actor="w.actor_id"
    ),
    "customer_lifecycle_events": event_life(),
    "customer_lifecycle_incremental": model(f"{INCREMENT}, {lifecycle('n', 'staged')} SELECT * FROM n_table"),
    "lifecycle_upsert": model(f"{MERGED} SELECT * FROM merged"),
    "lifecycle_upsert_all_tiers": model(
        f"""{MERGED} SELECT * REPLACE (CAST(ntile(10) OVER (
        ORDER BY thirty_days_revenue DESC, customer_id) AS INTEGER) AS value_tier) FROM merged"""
    ),
    "lifecycle_publish": model(f"{MERGED} SELECT * FROM merged"),
    "rental_history": model(f"""{WATCHED}
SELECT w.customer_id, name AS customer_name, title, w.category, num_rental
FROM watched w JOIN in_category i ON i.customer_id = w.customer_id AND i.category IS NOT DISTINCT FROM w.category
LEFT JOIN renter ON id = w.customer_id"""),
    "favourite_category": model(f"{WATCHED} SELECT * FROM favourite"),
    "movie_list": model(
        "SELECT film_id, category, title, CAST(rate AS DOUBLE) AS rental_rate, rental_duration FROM film"
    ),
    "unseen_titles_of": model(f"""{WATCHED}
SELECT customer_id, category, title, film_id FROM unseen
WHERE customer_id IN (SELECT id FROM renter WHERE NOT active)"""),
    "best_unseen_titles": model(f"""{WATCHED}
SELECT customer_id, category, title, film_id, CAST(rate AS DOUBLE) AS rental_rate, rental_duration FROM unseen
QUALIFY row_number() OVER (PARTITION BY customer_id, category ORDER BY rate DESC, rental_duration, film_id) <= 10"""),
    "unseen_titles": model(f"{WATCHED} SELECT customer_id, category, title, film_id FROM unseen"),
    "unseen_title_counts": model(
        f"{WATCHED} SELECT customer_id, category, count(*) AS num_unseen FROM unseen GROUP BY ALL"
    ),
    "movie_recommend": model(f"""{WATCHED}
SELECT customer_id, category, title, film_id, CAST(rate AS DOUBLE) AS rental_rate, rental_duration,
  CAST(pos AS INTEGER) AS place FROM advised WHERE pos <= 10"""),
    "lc_total_revenue": life(
        "SELECT customer_id, CAST(total AS DOUBLE) AS total_revenue, num_of_rentals FROM c_span"
    ),
    "lc_fav_three_actors": life("SELECT * FROM c_fav"),
    "lc_first_latest_film": life("SELECT * FROM c_film"),
    "lc_first_latest_film_by_id": life("SELECT * FROM c_film", by_id=True),
    "lc_thirty_days_date": life("SELECT customer_id, first_rent_date, thirty_days_date FROM c_span"),
    "lc_thirty_days_revenue": life(
        "SELECT customer_id, CAST(early AS DOUBLE) AS thirty_days_revenue, value_tier FROM c_tier"
    ),
    "lc_avg_rental_time": life("SELECT customer_id, avg_time_days_between_rental FROM c_table"),
    "lc_revenue_growth_rate": life("SELECT customer_id, revenue_growth_rate FROM c_table"),
    "hwm_save": NEWEST,
    "hwm_read": NEWEST,
    "staging_new_rows": f"""SELECT o_orderkey AS rental_id, o_orderdate AS rental_date, o_custkey AS customer_id
FROM orders WHERE o_orderdate > TIMESTAMP '{MARK}'""",
    "staging_new_rows_tie_safe": f"""SELECT o_orderkey AS rental_id, o_orderdate AS rental_date,
  o_custkey AS customer_id
FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '{MARK}', 7500)""",
    "staging_with_history": model(f"{INCREMENT} SELECT rental_id, rental_date, customer_id FROM staged"),
    "staging_uniqueness": model(f"""{INCREMENT}
SELECT rental_date, inventory_id, customer_id, count(*) AS num_rows
FROM (SELECT * FROM staged UNION ALL SELECT * FROM fresh) WHERE inventory_id IS NOT NULL
GROUP BY ALL HAVING count(*) > 1"""),
    "lifecycle_stream": event_life(),
    "lifecycle_stream_late": event_life(),
    "lifecycle_stream_drop_late": event_life(
        f"NOT (ts >= {_cut(1)} AND ts < {_cut(2)})"
    ),
    "lifecycle_stream_stateful": event_life(),
    "lifecycle_stream_payments": event_life(),
    "lifecycle_stream_payments_first": event_life(),
    "actor_titles": model("SELECT actor_id, category, title FROM playing JOIN film USING (film_id)"),
    "film_actors": model("SELECT film_id, actor_name FROM playing WHERE actor_id IN (SELECT id FROM person)"),
    "actor_info": model("""
entries AS (
  SELECT actor_id, category || ': ' || string_agg(title, ', ' ORDER BY title) AS entry
  FROM playing JOIN film USING (film_id) GROUP BY actor_id, category)
SELECT id AS actor_id, first_name, last_name, string_agg(entry, ', ' ORDER BY entry) AS film_info
FROM person LEFT JOIN entries ON actor_id = id GROUP BY ALL"""),
    "customer_list": _address_list(
        "(SELECT * FROM renter JOIN customer ON c_custkey = id)",
        "c_mktsegment",
        "CASE WHEN active THEN 'active' ELSE '' END AS notes,",
    ),
    "staff_list": _address_list("person", "first_name || '#' || last_name", ""),
    "film_list": model(LISTED_FILMS.format(name="actor_name")),
    "nicer_film_list": model(
        LISTED_FILMS.format(
            name="upper(first_name[1]) || lower(first_name[2:]) || upper(last_name[1]) || lower(last_name[2:])"
        )
    ),
    "sales_by_category": model(
        f"SELECT category, CAST(sum(amount) AS DOUBLE) AS total_sales {SOLD} JOIN film USING (film_id) GROUP BY 1"
    ),
    "sales_by_store": model(f"""
manager AS (SELECT nation, arg_min(name, id) AS manager FROM person GROUP BY nation)
SELECT city || ',' || country AS store, manager, CAST(sum(amount) AS DOUBLE) AS total_sales
{SOLD} JOIN place ON place.nation = c.store_id JOIN manager ON manager.nation = c.store_id
GROUP BY c.store_id, city, country, manager"""),
    "inventory_in_stock": model(f"{STOCK} SELECT * FROM stock"),
    "film_in_stock": model(f"{STOCK} SELECT film_id, store_id, inventory_id FROM stock WHERE in_stock"),
    "film_not_in_stock": model(f"{STOCK} SELECT film_id, store_id, inventory_id FROM stock WHERE NOT in_stock"),
    "stock_counts": model(f"""{STOCK}
SELECT film_id, store_id, count(*) FILTER (in_stock) AS num_in_stock, count(*) FILTER (NOT in_stock) AS num_out
FROM stock GROUP BY ALL"""),
    "inventory_held_by": model("""SELECT inventory_id, customer_id FROM rental
WHERE return_date IS NULL AND inventory_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY inventory_id ORDER BY rental_date DESC, rental_id DESC) = 1"""),
    "customer_balance": _balance(),
    "customer_balances": model(f"""
asked AS (SELECT DISTINCT customer_id, CAST(last_day(rental_date) AS TIMESTAMP) AS as_of FROM rental),
charged AS (
  SELECT customer_id, rental_date, rate + CASE WHEN {_LATE} > 0 THEN {_LATE} // 86400000000 ELSE 0 END
         + CASE WHEN {_LATE} > 2 * rental_duration * 86400000000 THEN rate ELSE 0 END AS owed
  FROM rental JOIN copies USING (inventory_id) JOIN film USING (film_id)),
fees AS (
  SELECT a.customer_id, as_of, sum(owed) AS owed FROM asked a JOIN charged c
  ON c.customer_id = a.customer_id AND rental_date <= as_of GROUP BY ALL),
paid AS (
  SELECT a.customer_id, as_of, sum(amount) AS paid FROM asked a JOIN payment p
  ON p.customer_id = a.customer_id AND payment_date <= as_of GROUP BY ALL)
SELECT customer_id, as_of, CAST(coalesce(owed, 0) - coalesce(paid, 0) AS DOUBLE) AS balance
FROM asked LEFT JOIN fees USING (customer_id, as_of) LEFT JOIN paid USING (customer_id, as_of)"""),
    "customer_balance_replacement": _balance("+ coalesce(kept, 0)"),
    "rewards_report": model(f"""SELECT id AS customer_id, nation AS store_id, first_name, last_name,
  id * 2 AS address_id, active AS activebool FROM renter WHERE id IN (
  SELECT customer_id FROM payment
  WHERE date_trunc('month', payment_date) = date_trunc('month', DATE '{REWARDS_DATE}' - INTERVAL 3 MONTH)
  GROUP BY 1 HAVING sum(amount) > {REWARDS_AMOUNT} AND count(*) > {REWARDS_PURCHASES})"""),
    "last_day": "SELECT o_orderkey AS rental_id, last_day(o_orderdate) AS month_end FROM orders",
    "group_concat": """SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS event_types
FROM events GROUP BY user_id""",
    "stamp_last_update": model("""SELECT film_id, title,
  CAST(CASE WHEN length(title) > 14 THEN rate + 1 ELSE rate END AS DOUBLE) AS rental_rate,
  CASE WHEN length(title) > 14 THEN TIMESTAMP '2006-03-01' ELSE TIMESTAMP '2006-02-15' END AS last_update
FROM film"""),
    "read_copy_text": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "write_table": model(RECOMMENDED),
    "append_table": "SELECT o_orderkey, o_orderstatus FROM orders",
    "delete_using": """SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
    "check_primary_key": """SELECT l_orderkey, l_linenumber, count(*) AS num_rows FROM lineitem
GROUP BY ALL HAVING count(*) > 1""",
    "check_unique": """SELECT o_custkey AS customer_id, o_orderdate AS rental_date, count(*) AS num_rows
FROM orders GROUP BY ALL HAVING count(*) > 1""",
    "check_foreign_key": """SELECT o_custkey AS customer_id, count(*) AS num_rows FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY 1""",
    "check_not_null": """SELECT unnest(['inventory_id', 'staff_id']) AS column_name, count(*) AS num_nulls
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "check_precision": """SELECT l_orderkey AS rental_id, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS amount,
  l_shipdate AS payment_date FROM lineitem WHERE l_extendedprice >= 100000""",
    "assign_ids": """SELECT 999 + row_number() OVER (ORDER BY user_id, ts, event_id) AS id, user_id, ts, event_id
FROM events""",
    "fill_defaults": model("""SELECT rental_id, coalesce(inventory_id, -1) AS inventory_id,
  coalesce(return_date, TIMESTAMP '2002-01-01') AS return_date FROM rental"""),
    "table_defaults": model("""SELECT film_id,
  CASE WHEN film_id % 3 <> 0 THEN rental_duration ELSE 3 END AS rental_duration,
  CAST(CASE WHEN film_id % 4 <> 0 THEN rate ELSE 4.99 END AS DOUBLE) AS rental_rate,
  CAST(CASE WHEN film_id % 5 <> 0 THEN rate ELSE 19.99 END AS DOUBLE) AS replacement_cost,
  CASE WHEN film_id % 7 <> 0 THEN description ELSE 'G' END AS rating,
  CASE WHEN film_id % 2 <> 0 THEN TIMESTAMP '2006-02-15' ELSE TIMESTAMP '2007-01-01' END AS last_update FROM film"""),
    "read_copy_text_typed": """SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderstatus = 'F' AS done,
  CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS TIMESTAMP) AS at,
  CAST(CAST(o_orderkey % 1000 AS DECIMAL(9,2)) / 100 AS DOUBLE) AS fee, o_orderstatus AS status,
  hex(encode(o_orderpriority)) AS raw, o_orderpriority || '|NULL|a "b", \\c' || o_orderstatus AS notes,
  o_orderstatus || '|' || o_orderpriority || chr(39) || 's' AS words,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || chr(9) || 'x\\y' || chr(10) || 'z' END AS remark FROM orders""",
    "load_and_check_shop": """WITH k AS (SELECT r_regionkey AS id FROM region WHERE r_regionkey <> 1)
SELECT * FROM (VALUES ('country', 'primary key', 'country_id', 0::BIGINT),
  ('country', 'not null', 'country_id, country, last_update', 0), ('country', 'length', 'country', 0),
  ('city', 'primary key', 'city_id', 0),
  ('city', 'foreign key', 'country_id', (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT id FROM k))),
  ('city', 'not null', 'city_id, city, country_id, last_update',
   (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0)), ('city', 'length', 'city', 0))
  AS t(table_name, rule, columns, violations)""",
    "distributed_ntile": """SELECT o_orderkey,
  CAST(ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS tile FROM orders""",
    "distributed_row_number": """SELECT event_type, value, event_id,
  row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS row_number FROM events""",
    "film_index": model(rf"""SELECT term, film_id, count(*) AS tf FROM (
  SELECT film_id, unnest(regexp_extract_all(lower(title || ' ' || description), '[\p{{L}}\p{{N}}]+')) AS term FROM film)
WHERE term NOT IN ({_STOP}) GROUP BY ALL"""),
    "token_index": f"WITH {POSTINGS} SELECT * FROM postings",
    "match_all_terms": f"""WITH {POSTINGS} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS tf FROM postings
WHERE term IN ({_TERMS}) GROUP BY doc_id HAVING count(DISTINCT term) = {len(SEARCH)}""",
}

_FILM_ROW = """SELECT p_partkey AS film_id, p_name || ' #' || p_partkey AS title, p_brand AS description,
  p_size AS rental_duration, p_retailprice AS rental_rate, p_size AS length,
  p_retailprice AS replacement_cost, p_brand AS rating FROM part WHERE"""
ORACLE["check_range"] = f"{_FILM_ROW} p_size < 3 OR p_size > 40"
ORACLE["check_allowed"] = f"{_FILM_ROW} p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')"
ORACLE["check_length"] = f"{_FILM_ROW} length(p_name || ' #' || p_partkey) > 16 OR length(p_brand) > 7"

# The same results, kept current by changes.
ORACLE |= {f"{name}_kept": ORACLE[name] for name in ("sales_by_category", "sales_by_store", "stamp_last_update", "token_index", "match_all_terms")}
ORACLE["snapshot_changes"] = model("SELECT film_id, 'different' AS change FROM film WHERE length(title) > 14")
