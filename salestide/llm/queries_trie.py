"""Query of the conversation trie and the SQL that states the same result."""

from pyspark.sql import functions as F

from salestide.llm import trie
from salestide.llm.common import table
from salestide.session import durable


def op11_conversation_trie(spark, folder):
    turns = durable(trie.placed(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")))
    lengths, rebuilt = trie.regrafted(turns)
    nodes = trie.trie(durable(lengths), rebuilt)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


QUERIES = {"op11_conversation_trie": op11_conversation_trie}

ORACLES = {
    "op11_conversation_trie": """
WITH crc AS (
    -- CRC-32 (reflected, polynomial 0xEDB88320) of the decimal digits, bit by bit
    SELECT DISTINCT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) AS crc
    FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, crc % 9 AS h FROM crc
), taken AS (
    SELECT h.conv_id, p.pos AS pos, p.role, p.text FROM heads h JOIN placed p ON p.conv_id = h.base AND p.pos <= h.h
), counts AS (
    SELECT conv_id, count(*) AS n FROM taken GROUP BY conv_id
), rebuilt AS (
    SELECT * FROM taken
    UNION ALL
    SELECT p.conv_id, coalesce(c.n, 0) + p.pos - h.h, p.role, p.text
    FROM placed p JOIN heads h ON h.conv_id = p.conv_id LEFT JOIN counts c ON c.conv_id = p.conv_id WHERE p.pos > h.h
), paths AS (
    SELECT conv_id, pos AS depth, strlen(text) AS bytes,
        array_to_string(list(sha256(role) || sha256(text)) OVER (PARTITION BY conv_id ORDER BY pos), '') AS path FROM rebuilt
    UNION ALL
    SELECT conv_id, 0, 0, '' FROM heads
), lengths AS (
    SELECT conv_id, max(depth) AS len FROM paths GROUP BY conv_id
), nodes AS (
    SELECT p.depth, p.path, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(p.bytes) AS bytes,
        coalesce(string_agg(CASE WHEN l.len = p.depth THEN p.conv_id END::VARCHAR, ',' ORDER BY p.conv_id), '') AS ends
    FROM paths p JOIN lengths l ON l.conv_id = p.conv_id GROUP BY p.depth, p.path
), linked AS (
    SELECT n.*, u.conv_id AS parent_conv_id, n.path AS own_path FROM nodes n LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.path = left(n.path, (128 * (n.depth - 1))::INT)
), children AS (
    SELECT depth - 1 AS depth, left(path, (128 * (depth - 1))::INT) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
    SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON c.depth = l.depth AND c.path = l.path
), inside AS (
    -- the nodes above a node are the first parts of its smallest member's path
    SELECT p.depth, p.path, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved
    FROM full_nodes f JOIN paths p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.depth, p.path
)
SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
    i.n_leaves::BIGINT AS n_leaves, i.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN inside i ON i.depth = f.depth AND i.path = f.path
""",
}
