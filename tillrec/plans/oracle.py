"""ANSI SQL (DuckDB dialect) twins of the registered queries.

These are brute-force restatements used only to check the Spark jobs; they
read the same driver tables through the same adapter rules.
"""

from __future__ import annotations

# --- adapter and cleaning ---------------------------------------------------
RAW = """raw AS (
  SELECT l.l_orderkey * 100 + l.l_linenumber AS id, l.l_shipdate AS date, o.o_custkey AS client_id,
         CAST(CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_extendedprice ELSE l.l_extendedprice END
                   AS DECIMAL(18,2)) AS DOUBLE) AS amount,
         l.l_partkey AS merchant_id, p.p_brand AS merchant_city, p.p_type AS merchant_state,
         CAST(s.s_nationkey AS INTEGER) AS mcc
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN part p ON l.l_partkey = p.p_partkey
       JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""

LAB = """lab AS (
  SELECT CAST(l_orderkey * 100 + l_linenumber AS VARCHAR) AS id,
         max(CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END) AS label
  FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY 1)"""

CODES = """codes AS (SELECT CAST(n_nationkey AS VARCHAR) AS mcc, n_name AS mcc_description FROM nation)"""


def _bucket(a: str) -> str:
    return (
        f"CASE WHEN abs({a}) IS NULL OR abs({a}) <= 0 THEN NULL WHEN abs({a}) <= 10 THEN 'Very Low' "
        f"WHEN abs({a}) <= 50 THEN 'Low' WHEN abs({a}) <= 100 THEN 'Medium' WHEN abs({a}) <= 500 THEN 'High' "
        f"ELSE 'Very High' END"
    )


def _parts(d: str) -> str:
    return (
        f"CAST(year({d}) AS INTEGER) AS year, CAST(month({d}) AS INTEGER) AS month, "
        f"CAST(day({d}) AS INTEGER) AS day, CAST(hour({d}) AS INTEGER) AS hour, "
        f"CAST(isodow({d}) - 1 AS INTEGER) AS day_of_week"
    )


TX = f"""tx AS (
  SELECT r.id, CAST(r.date AS TIMESTAMP) AS date, r.client_id, r.amount, r.merchant_id, r.merchant_city,
         r.merchant_state, r.mcc, CAST(coalesce(b.label = 'Yes', false) AS INTEGER) AS is_fraud,
         c.mcc_description, {_parts('r.date')}, {_bucket('r.amount')} AS amount_category
  FROM raw r LEFT JOIN lab b ON CAST(r.id AS VARCHAR) = b.id LEFT JOIN codes c ON CAST(r.mcc AS VARCHAR) = c.mcc)"""

EV = f"""ev AS (
  SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS date, user_id AS client_id,
         CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS amount,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS merchant_id,
         CAST(NULL AS VARCHAR) AS merchant_city, CAST(NULL AS VARCHAR) AS merchant_state, CAST(NULL AS INTEGER) AS mcc,
         0 AS is_fraud, event_type AS mcc_description, {_parts('ts')}, {_bucket('value')} AS amount_category
  FROM events)"""

MONEY_SUM = "CAST(sum(CAST({x} AS DECIMAL(28,10))) AS DOUBLE)"


def msum(x: str) -> str:
    return MONEY_SUM.format(x=x)


IX = f"""ix AS (
  SELECT client_id, merchant_id, count(amount) AS transaction_count, {msum('amount')} AS total_amount
  FROM tx WHERE client_id IS NOT NULL AND merchant_id IS NOT NULL GROUP BY client_id, merchant_id)"""

BASE_TX = [RAW, LAB, CODES, TX]
BASE_IX = BASE_TX + [IX]


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def hash_key(salt: str, *cols: str) -> str:
    """Twin of ``hash_key`` in the scalar functions: first 8 hex digits of md5."""
    args = ", ".join([f"'{salt}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"CAST(('0x' || substr(md5(concat_ws(':', {args})), 1, 8)) AS BIGINT)"


# --- similarity and recommenders ------------------------------------------------

def cosine_ctes(name: str, src: str, key: str, other: str, value: str = "transaction_count") -> list[str]:
    """(a, b, sim) pairs a < b of ``key`` sharing an ``other``."""
    return [
        f"""{name}_w AS (
  SELECT s.{key} AS k, s.{other} AS x, CAST(s.{value} AS DOUBLE) AS v, n.nrm
  FROM {src} s JOIN (SELECT {key}, sqrt(sum(CAST({value} AS DOUBLE) * {value})) AS nrm FROM {src}
                     WHERE {key} IS NOT NULL AND {other} IS NOT NULL AND {value} <> 0 GROUP BY {key}) n
       ON s.{key} = n.{key}
  WHERE s.{key} IS NOT NULL AND s.{other} IS NOT NULL AND s.{value} <> 0)""",
        f"""{name} AS (
  SELECT a.k AS a, b.k AS b, sum(a.v * b.v) / (a.nrm * b.nrm) AS sim
  FROM {name}_w a JOIN {name}_w b ON a.x = b.x AND a.k < b.k
  GROUP BY a.k, b.k, a.nrm, b.nrm)""",
    ]


def nearest_cte(name: str, pairs: str, n: int) -> str:
    return f"""{name} AS (
  SELECT id, neighbor, sim, rank FROM (
    SELECT id, neighbor, sim,
           row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, neighbor ASC) AS rank
    FROM (SELECT a AS id, b AS neighbor, sim FROM {pairs} UNION ALL SELECT b, a, sim FROM {pairs})) q
  WHERE rank <= {n})"""


def user_based_ctes(name: str, ix: str, n_neighbors: int = 10) -> list[str]:
    """Scored candidates (client_id, merchant_id, score) of E5 on table ``ix``."""
    return cosine_ctes(f"{name}_us", ix, "client_id", "merchant_id") + [
        nearest_cte(f"{name}_nb", f"{name}_us", n_neighbors),
        f"""{name} AS (
  SELECT c.client_id, c.merchant_id, round(c.num / c.den, 9) AS score FROM (
    SELECT nb.id AS client_id, t.merchant_id, sum(nb.sim * CAST(t.transaction_count AS DOUBLE)) AS num,
           sum(nb.sim) AS den
    FROM {name}_nb nb JOIN {ix} t ON t.client_id = nb.neighbor
    GROUP BY nb.id, t.merchant_id HAVING sum(nb.sim) > 0) c
  WHERE NOT EXISTS (SELECT 1 FROM {ix} v WHERE v.client_id = c.client_id AND v.merchant_id = c.merchant_id))""",
    ]


def item_based_ctes(name: str, ix: str) -> list[str]:
    """Scored candidates of E6 on table ``ix``."""
    return cosine_ctes(f"{name}_is", ix, "merchant_id", "client_id") + [
        f"""{name} AS (
  SELECT c.client_id, c.merchant_id, round(c.num / c.den, 9) AS score FROM (
    SELECT t.client_id, m.merchant_id, sum(m.sim * CAST(t.transaction_count AS DOUBLE)) AS num, sum(m.sim) AS den
    FROM {ix} t JOIN (SELECT a AS v, b AS merchant_id, sim FROM {name}_is
                      UNION ALL SELECT b, a, sim FROM {name}_is) m ON m.v = t.merchant_id
    GROUP BY t.client_id, m.merchant_id HAVING sum(m.sim) > 0) c
  WHERE NOT EXISTS (SELECT 1 FROM {ix} v WHERE v.client_id = c.client_id AND v.merchant_id = c.merchant_id))""",
    ]


def popular_ctes(name: str, ix: str, users: str | None = None) -> list[str]:
    """Scored candidates of E7: every unvisited item with its popularity
    (brute force: all users × all items)."""
    users = users or f"(SELECT DISTINCT client_id FROM {ix})"
    return [
        f"""{name}_pop AS (SELECT merchant_id, sum(transaction_count) AS popularity FROM {ix} GROUP BY merchant_id)""",
        f"""{name} AS (
  SELECT u.client_id, p.merchant_id, CAST(p.popularity AS DOUBLE) AS score
  FROM {users} u CROSS JOIN {name}_pop p
  WHERE NOT EXISTS (SELECT 1 FROM {ix} v WHERE v.client_id = u.client_id AND v.merchant_id = p.merchant_id))""",
    ]


def top_n(scored: str, n: int) -> str:
    return f"""SELECT client_id, CAST(rank AS INTEGER) AS rank, merchant_id, round(score, 6) AS score FROM (
  SELECT client_id, merchant_id, score,
         row_number() OVER (PARTITION BY client_id ORDER BY score DESC, merchant_id ASC) AS rank
  FROM {scored}) q WHERE rank <= {n}"""


# --- evaluation ---------------------------------------------------------------

def holdout_ctes(divisor: int = 3, min_items: int = 3, salt: str = "holdout") -> list[str]:
    """split / train / rel / eu (evaluated users with their holdout size)."""
    return [
        f"""split AS (
  SELECT client_id, merchant_id, transaction_count, n_items,
         (n_items >= {min_items} AND hr <= greatest(1, floor(n_items / {divisor}))) AS is_holdout
  FROM (SELECT *, count(*) OVER (PARTITION BY client_id) AS n_items,
               row_number() OVER (PARTITION BY client_id ORDER BY {hash_key(salt, 'client_id', 'merchant_id')}, merchant_id) AS hr
        FROM ix) q)""",
        "train AS (SELECT client_id, merchant_id, transaction_count FROM split WHERE NOT is_holdout)",
        "rel AS (SELECT client_id, merchant_id FROM split WHERE is_holdout)",
        "eu AS (SELECT client_id, count(*) AS n_relevant FROM rel GROUP BY client_id)",
    ]


def cf_recs_ctes(models=("popularity", "user_based", "item_based"), n: int = 20) -> list[str]:
    ctes: list[str] = []
    sel = []
    if "popularity" in models:
        ctes += popular_ctes("pp", "train", users="eu")
        sel.append(("popularity", "pp"))
    if "user_based" in models:
        ctes += user_based_ctes("ub", "train")
        sel.append(("user_based", "ub"))
    if "item_based" in models:
        ctes += item_based_ctes("ib", "train")
        sel.append(("item_based", "ib"))
    union = "\n  UNION ALL ".join(
        f"SELECT '{m}' AS model, client_id, rank, merchant_id FROM ({top_n(c, n)}) t{j} "
        f"WHERE client_id IN (SELECT client_id FROM eu)"
        for j, (m, c) in enumerate(sel)
    )
    return ctes + [f"recs AS (\n  {union})"]


def ranking_ctes(ks=(5, 10, 20)) -> list[str]:
    klist = ", ".join(str(k) for k in ks)
    return [
        "models AS (SELECT DISTINCT model FROM recs)",
        f"ks AS (SELECT unnest([{klist}]) AS k)",
        """pu AS (
  SELECT m.model, e.client_id, e.n_relevant, ks.k,
         count(CASE WHEN r.rank <= ks.k AND rl.merchant_id IS NOT NULL THEN 1 END) AS hits,
         count(CASE WHEN r.rank <= ks.k THEN 1 END) AS nrec
  FROM models m CROSS JOIN eu e CROSS JOIN ks
  LEFT JOIN recs r ON r.model = m.model AND r.client_id = e.client_id
  LEFT JOIN rel rl ON rl.client_id = r.client_id AND rl.merchant_id = r.merchant_id
  GROUP BY m.model, e.client_id, e.n_relevant, ks.k)""",
        """mm AS (
  SELECT model, k, count(*) AS n_users,
         avg(CASE WHEN nrec > 0 THEN hits / nrec ELSE 0.0 END) AS p,
         avg(CASE WHEN n_relevant > 0 THEN hits / n_relevant ELSE 0.0 END) AS r
  FROM pu GROUP BY model, k)""",
        """ranking AS (
  SELECT model, CAST(k AS INTEGER) AS k, n_users, round(p, 6) AS precision, round(r, 6) AS recall,
         round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM mm)""",
        """cov AS (
  SELECT model, round(count(DISTINCT CASE WHEN rank <= 10 THEN merchant_id END)
                      / (SELECT count(DISTINCT merchant_id) FROM ix), 6) AS coverage
  FROM recs GROUP BY model)""",
        """metrics AS (
  SELECT model, 'precision' AS metric, k, precision AS value FROM ranking
  UNION ALL SELECT model, 'recall', k, recall FROM ranking
  UNION ALL SELECT model, 'f1', k, f1 FROM ranking
  UNION ALL SELECT model, 'coverage', CAST(NULL AS INTEGER), coverage FROM cov)""",
    ]
