"""What op1, op5, op6 and op7 must return, in SQL over the same tables. Written out apart from the operators: nothing is
taken from them but the names of op6's tree."""

from __future__ import annotations

OP1 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(0, greatest(len(w) - 49, 0))) AS pos FROM words
), windows AS (
  SELECT doc_id, pos, md5(array_to_string(list_slice(w, pos + 1, pos + 50), ' ')) AS h FROM places
), firsts AS (
  SELECT h, min(doc_id) AS first FROM windows GROUP BY h
), hits AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS word FROM windows JOIN firsts USING (h) WHERE first < doc_id
), removed AS (
  SELECT doc_id, list(word) AS gone FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(list_filter(list_transform(w, lambda x, i : {'x': x, 'i': i}),
    lambda s : NOT coalesce(list_contains(gone, s.i - 1), false)), lambda s : s.x), ' ')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = rf"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_places AS (
  SELECT item, w, least(len(w), 13) AS k, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS pos FROM item_words WHERE len(w) > 0
), phrases AS (
  SELECT DISTINCT item, k, md5(array_to_string(list_slice(w, pos + 1, pos + k), ' ')) AS h FROM item_places
), places AS (
  SELECT doc_id, w, k, unnest(range(0, greatest(len(w) - k + 1, 0))) AS pos FROM doc_words, (SELECT DISTINCT k FROM phrases)
), found AS (
  SELECT doc_id, pos, k, item FROM (SELECT doc_id, pos, k, md5(array_to_string(list_slice(w, pos + 1, pos + k), ' ')) AS h FROM places) JOIN phrases USING (k, h)
), hits AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS word FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7 = rf"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, pos + 1, pos + 5), ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS pos FROM doc_words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reached.doc_id, b FROM reached JOIN links ON other = a
)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


def _crc_table() -> str:
    """The remainders of all bytes for the reversed polynomial 0xEDB88320."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return f"CAST([{', '.join(map(str, out))}] AS BIGINT[])"


def _nodes() -> str:
    """(tree, parent, name, weight, shard) of two regions of two racks of four shards, and of the same with a 17th shard in
    a region of its own."""
    rows = []
    for tree in (16, 17):
        leaves = [(f"region{i // 8}", f"rack{i // 4}", i) for i in range(16)] + [("added16", "rack", 16)] * (tree == 17)
        weight: dict[tuple[str, str], int] = {}
        for region, rack, i in leaves:
            for parent, name in (("", region), (region, f"{region}/{rack}"), (f"{region}/{rack}", f"{region}/{rack}/{i}")):
                weight[parent, name] = weight.get((parent, name), 0) + 1
        rows += [f"({tree}, '{p}', '{n}', {w}, {n.rpartition('/')[2] if n.count('/') == 2 else 'NULL'})" for (p, n), w in weight.items()]
    return ", ".join(rows)


def _hash(value: str) -> str:
    return f"CAST('0x' || substr(md5({value}), 1, 13) AS BIGINT)"


_STEP = f"arg_min(name, -ln(({_hash("k || '/' || name")} + 1) / 4503599627370496.0::DOUBLE) / weight)"

OP6 = f"""
WITH crc_table AS (SELECT {_crc_table()} AS remainders
), nodes(tree, parent, name, weight, shard) AS (VALUES {_nodes()}
), rows AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p : CAST('0x' || p AS BIGINT))),
      lambda a, b : xor(remainders[xor(a & 255, b) + 1], a >> 8)), 4294967295) AS BIGINT) AS text_crc32
  FROM documents, crc_table
), regions AS (SELECT tree, r, k, {_STEP} AS here FROM rows, nodes WHERE parent = '' GROUP BY tree, r, k
), racks AS (SELECT regions.tree, r, k, {_STEP} AS here FROM regions JOIN nodes ON nodes.tree = regions.tree AND parent = here GROUP BY regions.tree, r, k
), leaves AS (SELECT racks.tree, r, {_STEP} AS here FROM racks JOIN nodes ON nodes.tree = racks.tree AND parent = here GROUP BY racks.tree, r, k
), placed AS (SELECT leaves.tree, r, CAST(shard AS INT) AS shard FROM leaves JOIN nodes ON nodes.tree = leaves.tree AND name = here
)
SELECT doc_id, size, text_crc32, 'key' AS law, a.shard AS shard,
  row_number() OVER (PARTITION BY a.shard ORDER BY {_hash("k || '/' || size || '/' || text_crc32 || '/slot'")}, doc_id, size, text_crc32) - 1 AS slot, b.shard AS grown_shard
FROM rows JOIN placed a ON a.r = rows.r AND a.tree = 16 JOIN placed b ON b.r = rows.r AND b.tree = 17
"""
