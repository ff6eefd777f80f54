"""Driver tables re-read as form data.

Every view is SQL that runs unchanged in Spark and in DuckDB; ``{name}`` marks a driver table.
All rows of the tables are used, and what varies (states, units, corrections) is derived from
their values.
"""

VIEWS = {
    # Entity-attribute-value answers: one per event.
    "b_answers": """
        SELECT CAST(event_id AS VARCHAR(20)) AS response_id,
               concat('site-', substr('abcd', CAST(user_id % 4 AS INT) + 1, 1)) AS establishment_id,
               concat('u', CAST(user_id AS VARCHAR(20))) AS patient_id,
               event_type AS item_path,
               CASE event_id % 11 WHEN 0 THEN 'Non' WHEN 1 THEN 'inconnu' WHEN 2 THEN ' N/A '
                    WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'LOW'
                    ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR(30)) END AS raw_value,
               CASE event_id % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'kg' ELSE NULL END AS unit,
               CASE event_id % 13 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'VOIDED' WHEN 2 THEN 'DELETED'
                    ELSE 'SIGNED' END AS lifecycle_status,
               event_id % 17 <> 0 AS enabled,
               ts AS authored_at, props
        FROM {events}
    """,
    # Answers of order forms: header items and one repeated group per line.
    "b_order_answers": """
        SELECT CAST(l_orderkey AS VARCHAR(20)) AS response_id, concat('LINE/', k.item) AS item_path,
               concat('LINE:', CAST(line_no AS VARCHAR(10))) AS group_instance,
               CASE k.item WHEN 'QTY' THEN CAST(CAST(qty AS DECIMAL(18,2)) AS VARCHAR(30))
                           WHEN 'PRICE' THEN CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR(30))
                           WHEN 'DISC' THEN CAST(CAST(disc AS DECIMAL(18,2)) AS VARCHAR(30))
                           ELSE flag END AS raw_value
        FROM (SELECT l_orderkey, l_linenumber AS line_no, min(l_quantity) AS qty,
                     min(l_extendedprice) AS price, min(l_discount) AS disc,
                     min(l_returnflag) AS flag
              FROM {lineitem} GROUP BY l_orderkey, l_linenumber) x
        CROSS JOIN (VALUES ('QTY'), ('PRICE'), ('DISC'), ('FLAG')) AS k(item)
        WHERE NOT (k.item = 'DISC' AND disc = 0)
        UNION ALL
        SELECT CAST(o_orderkey AS VARCHAR(20)), k.item, CAST(NULL AS VARCHAR(20)),
               CASE k.item WHEN 'STATUS' THEN o_orderstatus WHEN 'PRIORITY' THEN o_orderpriority
                    ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(30)) END
        FROM {orders} CROSS JOIN (VALUES ('STATUS'), ('PRIORITY'), ('TOTAL')) AS k(item)
        WHERE NOT (k.item = 'TOTAL' AND o_orderstatus = 'P')
    """,
    # Conversation turns: occurrences of a role inside a conversation.
    "b_turns": """
        SELECT conv_id AS response_id, role AS item_path, turn AS pos, text AS raw_value
        FROM {conversations}
    """,
    # Correction chains inside runs of eight orders, with missing, self, shared and mutual targets.
    "b_chain": """
        SELECT o_orderkey AS event_id, CAST(floor(o_orderkey / 8) AS BIGINT) AS patient_id,
               o_orderdate AS authored_at,
               CASE WHEN o_orderkey % 8 = 0 AND o_orderkey % 152 <> 0 THEN 'SIGNED'
                    WHEN o_orderstatus = 'P' THEN 'VOIDED'
                    WHEN o_orderstatus = 'O' OR o_orderkey % 152 = 0 THEN 'CORRECTED'
                    ELSE 'SIGNED' END AS lifecycle_status,
               CASE WHEN o_orderkey % 152 = 0 THEN o_orderkey + 1
                    WHEN o_orderkey % 8 = 0 OR o_orderstatus NOT IN ('P','O') THEN NULL
                    WHEN o_orderkey % 97 = 0 THEN o_orderkey
                    WHEN o_orderkey % 89 = 0 THEN -o_orderkey
                    WHEN o_orderkey % 83 = 0 THEN o_orderkey - 8
                    WHEN o_orderkey % 8 > 1 AND o_orderkey % 7 = 0 THEN o_orderkey - 2
                    ELSE o_orderkey - 1 END AS supersedes_event_id,
               o_totalprice AS amount
        FROM {orders}
    """,
    # Form items per family and version: one group per product type, its parts below it.
    "b_forms": """
        SELECT concat('form-', p_brand) AS form_id, p_brand AS form_family,
               CAST(p_size % 3 AS VARCHAR(5)) AS version,
               concat(p_type, '/I', CAST(p_partkey AS VARCHAR(20))) AS path, p_type AS parent_path,
               concat('I', CAST(p_partkey AS VARCHAR(20))) AS item_id,
               concat(' ', p_name, '  item ') AS label,
               CASE p_partkey % 4 WHEN 0 THEN 'decimal' WHEN 1 THEN 'coding' WHEN 2 THEN 'string'
                    ELSE 'boolean' END AS data_type,
               p_partkey AS item_order, p_partkey % 3 <> 0 AS order_semantic,
               p_partkey % 5 = 0 AS required, false AS repeats,
               CASE WHEN p_partkey % 4 = 0 THEN 'kg' ELSE NULL END AS unit, p_type AS option_code
        FROM {part}
        UNION ALL
        SELECT DISTINCT concat('form-', p_brand), p_brand, CAST(p_size % 3 AS VARCHAR(5)), p_type,
               CAST(NULL AS VARCHAR(50)), p_type, p_type, 'group',
               CAST(length(p_type) AS BIGINT), length(p_type) % 2 = 1, false,
               length(p_type) % 2 = 0, CAST(NULL AS VARCHAR(5)), CAST(NULL AS VARCHAR(50))
        FROM {part}
    """,
    # Coverage counts, with an unknown denominator for some sites.
    "b_coverage": """
        SELECT concat('nation-', n.n_name) AS establishment_id, o.o_orderpriority AS concept_key,
               CAST(date_trunc('month', o.o_orderdate) AS DATE) AS period_start,
               CASE WHEN n.n_nationkey % 5 = 0 THEN NULL
                    ELSE CAST(count(*) + n.n_nationkey % 4 AS BIGINT) END AS eligible_count,
               CAST(count(*) AS BIGINT) AS recorded_count,
               CAST(sum(CASE WHEN o.o_orderstatus <> 'P' THEN 1 ELSE 0 END) AS BIGINT) AS usable_count,
               CAST(sum(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS positive_count
        FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
        JOIN {nation} n ON n.n_nationkey = c.c_nationkey
        GROUP BY n.n_name, n.n_nationkey, o.o_orderpriority, date_trunc('month', o.o_orderdate)
    """,
    # Narrative documents that open with an assertion.
    "b_narrative": """
        SELECT doc_id, source, lang,
               concat(CASE doc_id % 6 WHEN 0 THEN 'Allergie à la pénicilline avec urticaire. '
                           WHEN 1 THEN 'Aucune  allergie connue. '
                           WHEN 2 THEN 'Allergie possible à l''amoxicilline, à confirmer. '
                           WHEN 3 THEN 'ALLERGIE au latex. ' WHEN 4 THEN 'Hypersensibilité: éruption. '
                           ELSE '' END, text) AS text,
               CASE WHEN doc_id % 4 = 0 THEN 'OCR_RULES' ELSE 'NATIVE_TEXT' END AS method,
               CASE WHEN doc_id % 4 = 0 THEN CAST(60 + doc_id % 40 AS DOUBLE) / 100 END AS confidence
        FROM {documents}
    """,
    # Acyclic evidence graph.
    "b_edges": """
        SELECT concat('raw:', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(10))) AS source,
               concat('canonical:', CAST(l_orderkey AS VARCHAR(20))) AS target FROM {lineitem}
        UNION SELECT concat('canonical:', CAST(o_orderkey AS VARCHAR(20))),
               concat('mapping:', CAST(o_custkey AS VARCHAR(20))) FROM {orders}
        UNION SELECT concat('mapping:', CAST(c_custkey AS VARCHAR(20))),
               concat('omop:', CAST(c_nationkey AS VARCHAR(20))) FROM {customer}
        UNION SELECT concat('omop:', CAST(n_nationkey AS VARCHAR(20))),
               concat('catalog:', CAST(n_regionkey AS VARCHAR(20))) FROM {nation}
    """,
}

# Spark spellings of views whose portable SQL pairs rows with a constant list.
SPARK_VIEWS = {
    "b_order_answers": """
        SELECT CAST(l_orderkey AS STRING) AS response_id, concat('LINE/', item) AS item_path,
               concat('LINE:', CAST(line_no AS STRING)) AS group_instance,
               CASE item WHEN 'QTY' THEN CAST(CAST(qty AS DECIMAL(18,2)) AS STRING)
                         WHEN 'PRICE' THEN CAST(CAST(price AS DECIMAL(18,2)) AS STRING)
                         WHEN 'DISC' THEN CAST(CAST(disc AS DECIMAL(18,2)) AS STRING)
                         ELSE flag END AS raw_value
        FROM (SELECT l_orderkey, l_linenumber AS line_no, min(l_quantity) AS qty,
                     min(l_extendedprice) AS price, min(l_discount) AS disc,
                     min(l_returnflag) AS flag
              FROM {lineitem} GROUP BY l_orderkey, l_linenumber) x
        LATERAL VIEW explode(array('QTY', 'PRICE', 'DISC', 'FLAG')) k AS item
        WHERE NOT (item = 'DISC' AND disc = 0)
        UNION ALL
        SELECT CAST(o_orderkey AS STRING), item, CAST(NULL AS STRING),
               CASE item WHEN 'STATUS' THEN o_orderstatus WHEN 'PRIORITY' THEN o_orderpriority
                    ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END
        FROM {orders} LATERAL VIEW explode(array('STATUS', 'PRIORITY', 'TOTAL')) k AS item
        WHERE NOT (item = 'TOTAL' AND o_orderstatus = 'P')
    """,
}
