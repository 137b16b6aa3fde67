"""DuckDB SQL of corpus queries whose results SQL can express."""

from __future__ import annotations

#: Levels that the SQL of the manifest unrolls: 16 ** 7 rows in a source, 16 ** 4 sources.
DEPTH, TOP_DEPTH = 7, 4


def _value(column: str, text: str | None = None) -> str:
    shown = text or f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({shown}) || ':' || {shown} END"


def _tree(name: str, base: str, depth: int) -> list[str]:
    """Tables ``{name}0`` to ``{name}{depth}`` (tree, idx, n, hash) and ``{name}r0`` ... with the digests of each run."""
    out = [f"{name}0 AS ({base})"]
    for k in range(depth):
        out.append(f"{name}r{k} AS (SELECT tree, idx >> 4 AS run, any_value(n) AS n, list(hash ORDER BY idx) AS hashes FROM {name}{k} GROUP BY ALL)")
        out.append(f"{name}{k + 1} AS (SELECT tree, run AS idx, (n + 15) >> 4 AS n, CASE WHEN n = 1 THEN hashes[1] ELSE sha256(array_to_string(hashes, '')) END AS hash FROM {name}r{k})")
    return out


def _paths(name: str, base: str, tree: str, place: str, nodes: str, depth: int) -> list[str]:
    """Tables ``{name}0`` ... that follow the paths of ``base``: they add to its siblings and fold its digest, level by level."""
    out = [f"{name}0 AS ({base})"]
    for k in range(depth):
        at = f"({place} >> {4 * k})"
        before, after = f"array_to_string(hashes[1:{at} % 16], '')", f"array_to_string(hashes[{at} % 16 + 2:], '')"
        before = f"(CASE WHEN {at} % 16 = 0 THEN '' ELSE {before} END)"
        out.append(f"{name}{k + 1} AS (SELECT p.* REPLACE (CASE WHEN r.n = 1 THEN siblings ELSE siblings || {before} || {after} END AS siblings, CASE WHEN r.n = 1 THEN folded ELSE sha256({before} || folded || {after}) END AS folded) FROM {name}{k} p JOIN {nodes}r{k} r ON r.tree IS NOT DISTINCT FROM {tree} AND r.run = {at} >> 4)")
    return out


def merkle() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(_value(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"
    leaves = f"SELECT doc_id, source, sha256({head} || {_value('text')}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {_value('text', lower)}) ELSE sha256({head} || {_value('text')}) END AS checked FROM documents"
    steps = [f"leaves AS ({leaves})", "placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM leaves)"]
    steps += _tree("t", "SELECT source AS tree, place AS idx, n, leaf AS hash FROM placed", DEPTH)
    steps.append(f"subroots AS (SELECT tree AS source, hash AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS source_place, count(*) OVER () AS n FROM t{DEPTH})")
    steps += _tree("s", "SELECT 0 AS tree, source_place AS idx, n, subroot AS hash FROM subroots", TOP_DEPTH)
    steps += _paths("p", "SELECT placed.*, '' AS siblings, checked AS folded FROM placed", "p.source", "p.place", "t", DEPTH)
    steps += _paths("q", f"SELECT p.doc_id, p.leaf, p.siblings, p.folded, u.subroot, u.source_place FROM p{DEPTH} p JOIN subroots u ON u.source IS NOT DISTINCT FROM p.source", "0", "p.source_place", "s", TOP_DEPTH)
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, root.hash AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root.hash AS verified FROM q{TOP_DEPTH}, s{TOP_DEPTH} AS root"


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    finite = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, CAST(len(embedding) // {parts} AS BIGINT) AS w FROM embeddings WHERE {finite})",
        f"cut_up AS (SELECT rid, CAST(p AS BIGINT) AS p, v[p * w + 1 : (p + 1) * w] AS x FROM kept, range({parts}) AS t(p))",
        f"c0 AS (SELECT p, rid - 1 AS e, x AS c FROM cut_up WHERE rid <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS (SELECT rid, p, any_value(x) AS x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS best FROM cut_up JOIN c{k} USING (p) GROUP BY rid, p)")
        if k < rounds:
            steps.append(f"s{k} AS (SELECT p, e, spot, sum(y) AS s, count(*) AS n FROM (SELECT p, best.e AS e, unnest(x) AS y, generate_subscripts(x, 1) AS spot FROM a{k}) GROUP BY ALL)")
            steps.append(f"m{k} AS (SELECT p, e, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY spot) AS c FROM s{k} GROUP BY p, e)")
            steps.append(f"c{k + 1} AS (SELECT p, e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e))")
    steps.append(f"books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})")
    steps.append(f"coded AS (SELECT rid, string_agg(lower(lpad(to_hex(best.e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), books"
