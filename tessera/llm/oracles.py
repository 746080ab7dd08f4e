"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from tessera.llm import urls

#: Components of links (a, b) over nodes: each node's smallest reachable one.
_REACH = """reach AS (SELECT id, id AS root FROM nodes UNION SELECT links.a, reach.root FROM reach JOIN links ON links.b = reach.id),
 comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""


def vectors(least: float = 0.9) -> str:
    return f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 links AS (SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.id != y.id WHERE list_cosine_similarity(x.v, y.v) >= {least}), {_REACH}
 SELECT comp.id AS vec_id, CAST((SELECT count(*) FROM links WHERE a = comp.id) AS BIGINT) AS n_links, root AS component_id, comp.id = root AS kept FROM comp"""


def near_documents(num: int = 85, den: int = 100, width: int = 5) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE words AS (SELECT doc_id AS id, regexp_extract_all({lower}, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
 nodes AS (SELECT id FROM words),
 grams AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) END) AS g FROM words),
 sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
 common AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.id != y.id GROUP BY 1, 2),
 links AS (SELECT a, b FROM common JOIN sizes s ON s.id = a JOIN sizes t ON t.id = b WHERE {den} * c >= {num} * (s.n + t.n - c)), {_REACH}
 SELECT comp.id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, root AS component_id, comp.id = root AS kept FROM comp LEFT JOIN sizes ON sizes.id = comp.id"""


def url_filter() -> str:
    w = urls.fit([(urls.plain_grams(u), y) for u, y in urls.LABELLED])
    rules = "\n  ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '/{p}') THEN '{kind} {text}'"
        for kind, text in sorted(urls.RULES, key=lambda r: -len(r[1]))
        for h, _, p in [text.partition("/")]
    )
    code = " + ".join(f"{37 ** (urls.NGRAM - 1 - k)}::BIGINT * unicode(t[i + {k}])" for k in range(urls.NGRAM))
    return f"""WITH parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
 coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
 ruled AS (SELECT *, CASE {rules} END AS r, ' ' || host || path || ' ' AS t FROM parts),
 scored AS (SELECT *, {w[-1]!r} + coalesce(list_avg(list_transform(range(1, len(t) - {urls.NGRAM - 2}), lambda i: ({w[:-1]!r}::DOUBLE[])[1 + ({code}) % {urls.BUCKETS}])), 0) AS s FROM ruled)
 SELECT page_id, host, path, split_part(r, ' ', 2) AS rule, CASE WHEN r IS NOT NULL THEN split_part(r, ' ', 1) WHEN s >= 0 THEN 'block' ELSE 'allow' END AS verdict FROM scored"""


def archives() -> str:
    digit = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || sha[5 * (k // 4) + 1:5 * (k // 4) + 5])::INT >> CAST(5 * (3 - k % 4) AS INT)) & 31)]"
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, h, sha1(h) AS sha, max(page_id) OVER (PARTITION BY h) AS last FROM p)
 SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda k: {digit}), '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != last THEN last END AS refers_to FROM q"""


def all_sql() -> dict[str, str]:
    return {"op2_vectors": vectors(), "op5_minhash": near_documents(), "op9_url_filter": url_filter(), "op10_warc": archives()}
