"""ANSI SQL with the same results as the registered queries (DuckDB dialect)."""

from __future__ import annotations

from ..functions import draws

K = 4
SEED = 11
PEEL = 70
SWEEPS = 20
LEVELS = 30
ROUNDS = 40


def chain(*parts: str) -> str:
    """CTE definitions joined into one WITH clause."""
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts)


def draw(*key: str) -> str:
    text = " || ':' || ".join([f"'{SEED}'", *key])
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE)"


def remix(bits: str, counter: int) -> str:
    """Columns h1 to h6 and u: the draw of a 52-bit key and a counter, by four Feistel rounds on its halves."""
    out = [f"({bits} >> {draws.HALF}) AS h1", f"({bits} & {2 ** draws.HALF - 1}) AS h2"]
    for i, (by, step) in enumerate(draws.ROUNDS):
        out.append(f"((h{i + 2} * {by}::BIGINT + {counter * step + i}::BIGINT) % {draws.PRIME}) AS x{i}")
        out.append(f"xor(h{i + 1}, ((x{i} * x{i}) % {draws.PRIME}) >> 5) AS h{i + 3}")
    return ", ".join([*out, f"((h5 * {2 ** draws.HALF} + h6)::DOUBLE / 4503599627370496.0::DOUBLE) AS u"])


def ks(item: str, sep: str = ", ") -> str:
    return sep.join(item.format(k=k) for k in range(K))


WORDS = r"regexp_extract_all({text}, '[^ \t\n\f\r]+')"

# --- text ---------------------------------------------------------------------

TOK = f"""
doc_words AS MATERIALIZED (SELECT doc_id, source, {WORDS.format(text='text')} AS w FROM documents),
tok AS MATERIALIZED (
  SELECT doc_id, source, unnest(w) AS word, CAST(generate_subscripts(w, 1) - 1 AS INT) AS pos FROM doc_words)
"""
VOC = """
voc AS MATERIALIZED (
  SELECT word, n, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT word, count(*) AS n FROM tok GROUP BY word))
"""
NEW = f"""
new_words AS MATERIALIZED (SELECT item_id AS doc_id, {WORDS.format(text='text')} AS w FROM benchmark),
new_tok AS MATERIALIZED (
  SELECT doc_id, unnest(w) AS word, CAST(generate_subscripts(w, 1) - 1 AS INT) AS pos FROM new_words)
"""
DF = "dfreq AS MATERIALIZED (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, word FROM tok) GROUP BY word)"

SQL: dict[str, str] = {}

SQL["word_count"] = chain(TOK) + " SELECT word, count(*) AS n FROM tok GROUP BY word"
SQL["doc_frequency"] = chain(TOK, DF) + " SELECT word, df FROM dfreq"
SQL["token_total"] = chain(TOK) + " SELECT count(*) AS n_tokens FROM tok"
SQL["vocabulary"] = chain(TOK, VOC) + " SELECT word_id, word, n FROM voc"
SQL["doc_term_matrix"] = chain(TOK, VOC) + """
SELECT doc_id, word_id, count(*) AS n FROM tok JOIN voc USING (word) GROUP BY doc_id, word_id"""
SQL["document_sample"] = f"SELECT doc_id, source FROM documents WHERE {draw('doc_id')} < 0.3"
SQL["corpus_text"] = rf"""
WITH lines AS (SELECT role || chr(9) || conv_id || chr(9) || text AS value FROM conversations),
f AS (SELECT string_split(regexp_replace(value, '\t+$', ''), chr(9)) AS f FROM lines)
SELECT f[1] AS user_id, f[2] AS doc_id, count(*) AS lines,
  CAST(sum(len(list_where(string_split(f[3], ' '), list_transform(string_split(f[3], ' '), lambda x: x <> '')))) AS BIGINT) AS words
FROM f WHERE len(f) = 3 GROUP BY 1, 2"""
SQL["document_corpus_text"] = """
SELECT item_id AS doc_id, CAST(len(list_filter(string_split(replace(text, '"', ''), ' '), lambda x: x <> '')) AS BIGINT) AS words
FROM benchmark WHERE text NOT LIKE '%' || chr(9) || '%'"""
SQL["wide_corpus_text"] = r"""
WITH f AS (SELECT doc_id, regexp_replace(text, '[\t\n\f\r]', ' ', 'g') AS t FROM documents)
SELECT doc_id, CAST(len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS BIGINT) AS words FROM f WHERE t <> ''"""
SQL["arity_filter"] = """
WITH f AS (SELECT string_split(p_partkey || ' ' || p_size || ' ' || p_name || ' ' || p_type, ' ') AS f FROM part)
SELECT CAST(f[1] AS BIGINT) AS id, CAST(f[2] AS INT) AS size, f[4] AS word, f[5] AS type FROM f WHERE len(f) = 5"""
SQL["matrix_text_roundtrip"] = """
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS length,
  round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) AS total FROM embeddings"""
SQL["labelled_points_text"] = """
SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, count(*) AS n,
  round(sum(l_quantity), 2) AS f0, round(sum(l_extendedprice), 2) AS f1,
  round(sum(l_discount), 2) AS f2, round(sum(l_tax), 2) AS f3
FROM lineitem GROUP BY 1"""
SQL["count_vectors_text"] = """
SELECT p_partkey AS id, round(p_size + p_retailprice + p_partkey, 6) AS total FROM part"""

# --- graph ----------------------------------------------------------------------

EDGES = """
e AS MATERIALIZED (
  SELECT src, dst, CAST(sum(q) AS BIGINT) AS attr FROM (
    SELECT o_custkey AS src, o_orderkey AS dst, 1 AS q FROM orders
    UNION ALL SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) FROM lineitem)
  WHERE src <> dst GROUP BY src, dst),
ends AS MATERIALIZED (
  SELECT src AS id, dst AS other, 1 AS outgoing FROM e UNION ALL SELECT dst, src, 0 FROM e),
v AS MATERIALIZED (SELECT DISTINCT id FROM ends),
deg AS MATERIALIZED (SELECT id, count(*) AS degree FROM ends GROUP BY id)
"""
PROPS = """
pv AS MATERIALIZED (
  SELECT v.id, coalesce(p.a, 0) AS a, coalesce(p.b, 0) AS b, coalesce(p.c, 0) AS c
  FROM v LEFT JOIN (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS a, CAST(floor(p_retailprice) AS BIGINT) AS b,
    length(p_name) AS c FROM part) p USING (id)),
tri AS MATERIALIZED (
  SELECT e.src, e.dst, e.attr, s.a AS src_a, s.b AS src_b, s.c AS src_c, d.a AS dst_a, d.b AS dst_b, d.c AS dst_c
  FROM e JOIN pv s ON s.id = e.src JOIN pv d ON d.id = e.dst)
"""
G, GP = chain(EDGES), chain(EDGES, PROPS)

SQL["canonical_edges_text"] = G + """
SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*) AS n FROM e GROUP BY 1, 2"""
SQL["degrees"] = G + """
SELECT id, CAST(sum(1 - outgoing) AS BIGINT) AS in_degree, CAST(sum(outgoing) AS BIGINT) AS out_degree,
  count(*) AS degree FROM ends GROUP BY id"""
SQL["max_degree"] = G + " SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 1"
SQL["min_degree"] = G + " SELECT id, degree FROM deg ORDER BY degree, id LIMIT 1"
SQL["vertex_properties"] = GP + " SELECT id, a, b, c FROM pv"
SQL["vertex_filter"] = GP + " SELECT id, a FROM pv WHERE a > 30"
SQL["edge_filter"] = G + " SELECT src, dst, attr FROM e WHERE attr > 25"
SQL["subgraph"] = GP + " SELECT src, dst, attr FROM tri WHERE src_a >= 10 AND dst_a >= 10"
SQL["triplets"] = GP + " SELECT src, dst, attr, src_a, dst_a FROM tri WHERE src_a > dst_a"
SQL["map_triplets"] = GP + " SELECT src, dst, abs(src_a - dst_a) * attr AS attr FROM tri"
SQL["reverse_edges"] = G + " SELECT dst AS src, src AS dst, attr FROM e"
SQL["equal_in_out"] = G + """
SELECT id, CAST(sum(1 - outgoing) AS BIGINT) AS in_degree, CAST(sum(outgoing) AS BIGINT) AS out_degree
FROM ends GROUP BY id HAVING sum(outgoing) = sum(1 - outgoing)"""
SQL["oldest_follower"] = GP + """
, best AS (SELECT dst, src, src_a, row_number() OVER (PARTITION BY dst ORDER BY src_a DESC, src) AS r FROM tri)
SELECT pv.id, best.src AS follower, best.src_a AS follower_age FROM pv LEFT JOIN best ON best.dst = pv.id AND best.r = 1"""
SQL["message_sums"] = GP + """
SELECT dst AS id, CAST(sum(src_a * attr) AS BIGINT) AS weighted, min(src) AS first_src FROM tri GROUP BY dst"""
SQL["overlap_score"] = GP + """
SELECT pv.id, CAST(coalesce(s.score, 0) AS BIGINT) AS score FROM pv LEFT JOIN (
  SELECT dst AS id, sum(least(src_a, dst_a) + least(src_b, dst_b) + least(src_c, dst_c)) AS score FROM tri GROUP BY dst) s
USING (id)"""


def bfs(levels: int) -> str:
    out = ["l0 AS MATERIALIZED (SELECT min(src) AS id, 0 AS level, 0 AS parents FROM e)",
           "s0 AS MATERIALIZED (SELECT id FROM l0)"]
    for i in range(1, levels + 1):
        out.append(f"""l{i} AS MATERIALIZED (
          SELECT dst AS id, {i} AS level, count(*) AS parents FROM l{i - 1} JOIN e ON e.src = l{i - 1}.id
          WHERE NOT EXISTS (SELECT 1 FROM s{i - 1} WHERE s{i - 1}.id = e.dst) GROUP BY dst)""")
        out.append(f"s{i} AS MATERIALIZED (SELECT id FROM s{i - 1} UNION ALL SELECT id FROM l{i})")
    union = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(levels + 1))
    out.append(f"reached AS MATERIALIZED (SELECT id, CAST(level AS BIGINT) AS level, CAST(parents AS BIGINT) AS parents FROM ({union}))")
    return ",\n".join(out)


SQL["bfs_hops"] = chain(EDGES, bfs(LEVELS)) + " SELECT id, level AS hops FROM reached"
SQL["bfs_levels_parents"] = chain(EDGES, bfs(LEVELS)) + " SELECT id, level, parents FROM reached"
SQL["frontier_candidates"] = chain(EDGES, bfs(2)) + """
SELECT id, parents FROM reached WHERE level = 2 AND parents < (
  SELECT max(d) FROM (SELECT x.id, count(*) AS d FROM ends x
    WHERE x.id IN (SELECT id FROM reached WHERE level <= 1) AND x.other IN (SELECT id FROM reached WHERE level <= 1)
    GROUP BY x.id))"""


def sssp(rounds: int) -> str:
    out = ["b0 AS MATERIALIZED (SELECT min(src) AS id, 0::DOUBLE AS distance FROM e)"]
    for i in range(1, rounds + 1):
        out.append(f"""b{i} AS MATERIALIZED (SELECT id, min(distance) AS distance FROM (
          SELECT * FROM b{i - 1} UNION ALL
          SELECT e.dst, b{i - 1}.distance + e.attr FROM b{i - 1} JOIN e ON e.src = b{i - 1}.id) GROUP BY id)""")
    return ",\n".join(out)


SQL["sssp"] = chain(EDGES, sssp(ROUNDS)) + f" SELECT id, distance FROM b{ROUNDS}"


def brandes(levels: int) -> str:
    out = ["f0 AS MATERIALIZED (SELECT min(src) AS id, 1::DOUBLE AS sigma FROM e)",
           "s0 AS MATERIALIZED (SELECT id FROM f0)"]
    for i in range(1, levels + 1):
        p = i - 1
        out.append(f"""f{i} AS MATERIALIZED (SELECT e.dst AS id, sum(f{p}.sigma) AS sigma FROM f{p} JOIN e ON e.src = f{p}.id
          WHERE NOT EXISTS (SELECT 1 FROM s{p} WHERE s{p}.id = e.dst) GROUP BY e.dst)""")
        out.append(f"s{i} AS MATERIALIZED (SELECT id FROM s{p} UNION ALL SELECT id FROM f{i})")
    out.append(f"c{levels} AS MATERIALIZED (SELECT id, sigma, 1::DOUBLE AS credit FROM f{levels})")
    for i in range(levels - 1, -1, -1):
        n = i + 1
        out.append(f"""x{i} AS MATERIALIZED (SELECT e.src, e.dst, f{i}.sigma / c{n}.sigma * c{n}.credit AS credit
          FROM f{i} JOIN e ON e.src = f{i}.id JOIN c{n} ON c{n}.id = e.dst)""")
        out.append(f"""c{i} AS MATERIALIZED (SELECT f{i}.id, f{i}.sigma, 1 + coalesce(g.credit, 0) AS credit FROM f{i}
          LEFT JOIN (SELECT src, sum(credit) AS credit FROM x{i} GROUP BY src) g ON g.src = f{i}.id)""")
    return ",\n".join(out)


SQL["betweenness"] = chain(EDGES, brandes(LEVELS)) + "\n" + " UNION ALL ".join(
    f"SELECT id, CAST({i} AS BIGINT) AS level, round(sigma, 6) AS sigma, round(credit, 6) AS credit FROM c{i}"
    for i in range(1, LEVELS + 1)
)
SQL["edge_betweenness"] = chain(EDGES, brandes(LEVELS)) + "\n" + " UNION ALL ".join(
    f"SELECT src, dst, round(credit, 6) AS credit FROM x{i}" for i in range(LEVELS)
)



def sampled_brandes(levels: int) -> str:
    out = [f"f0 AS MATERIALIZED (SELECT id AS root, id, 1::DOUBLE AS sigma FROM v WHERE {draw('id')} < 0.002)",
           "s0 AS MATERIALIZED (SELECT root, id FROM f0)"]
    for i in range(1, levels + 1):
        p = i - 1
        out.append(f"""f{i} AS MATERIALIZED (SELECT root, e.dst AS id, sum(sigma) AS sigma FROM f{p} JOIN e ON e.src = f{p}.id
          WHERE NOT EXISTS (SELECT 1 FROM s{p} WHERE s{p}.root = f{p}.root AND s{p}.id = e.dst) GROUP BY root, e.dst)""")
        out.append(f"s{i} AS MATERIALIZED (SELECT * FROM s{p} UNION ALL SELECT root, id FROM f{i})")
    out.append(f"c{levels} AS MATERIALIZED (SELECT root, id, sigma, 1::DOUBLE AS credit FROM f{levels})")
    for i in range(levels - 1, -1, -1):
        n = i + 1
        out.append(f"""x{i} AS MATERIALIZED (SELECT f{i}.root, e.src, e.dst, f{i}.sigma / c{n}.sigma * c{n}.credit AS credit
          FROM f{i} JOIN e ON e.src = f{i}.id JOIN c{n} ON c{n}.id = e.dst AND c{n}.root = f{i}.root)""")
        out.append(f"""c{i} AS MATERIALIZED (SELECT f{i}.root, f{i}.id, f{i}.sigma, 1 + coalesce(g.credit, 0) AS credit FROM f{i}
          LEFT JOIN (SELECT root, src, sum(credit) AS credit FROM x{i} GROUP BY root, src) g ON g.root = f{i}.root AND g.src = f{i}.id)""")
    return ",\n".join(out)


SQL["sampled_betweenness"] = chain(EDGES, sampled_brandes(LEVELS)) + "\nSELECT id, count(*) AS roots, round(sum(credit), 6) AS credit FROM (" + (
    " UNION ALL ".join(f"SELECT id, credit FROM c{i}" for i in range(1, LEVELS + 1))
) + ") GROUP BY id"
SQL["sampled_edge_betweenness"] = chain(EDGES, sampled_brandes(LEVELS)) + "\nSELECT src, dst, round(sum(credit), 6) AS credit FROM (" + (
    " UNION ALL ".join(f"SELECT src, dst, credit FROM x{i}" for i in range(LEVELS))
) + ") GROUP BY src, dst"


def ranks(rounds: int) -> str:
    out = ["fans AS MATERIALIZED (SELECT src AS id, count(*) AS fan FROM e GROUP BY src)",
           "g0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE - 0.85::DOUBLE AS gain FROM v)"]
    for i in range(1, rounds + 1):
        out.append(f"""g{i} AS MATERIALIZED (SELECT e.dst AS id, 0.85::DOUBLE * sum(g.gain / fan) AS gain
          FROM g{i - 1} g JOIN fans USING (id) JOIN e ON e.src = g.id WHERE g.gain > 0.001::DOUBLE GROUP BY e.dst)""")
    return ",\n".join(out)


SQL["vertex_ranks"] = chain(EDGES, ranks(ROUNDS)) + "\nSELECT id, round(sum(gain), 6) AS rank FROM (" + (
    " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(ROUNDS + 1))
) + ") GROUP BY id"

# --- communities ------------------------------------------------------------------


def alpha(i: int) -> str:
    return f"CASE WHEN {i} < 50 THEN 1 + {i} // 7 WHEN {i} < 80 THEN 2 + {i} // 7 WHEN {i} < 100 THEN 3 + {i} // 6 ELSE 4 + {i} // 5 END"


def peel(iterations: int) -> str:
    out = ["a0 AS MATERIALIZED (SELECT id, coalesce(degree, 0) AS degree FROM v LEFT JOIN deg USING (id))"]
    for i in range(1, iterations + 1):
        p = i - 1
        out.append(f"m{i} AS MATERIALIZED (SELECT min(degree) AS smallest FROM a{p} WHERE degree > 0)")
        out.append(f"""k{i} AS MATERIALIZED (SELECT id FROM a{p}, m{i} WHERE degree > greatest({alpha(i)}, coalesce(smallest, 0)))""")
        out.append(f"""a{i} AS MATERIALIZED (SELECT k{i}.id, coalesce(d.degree, 0) AS degree FROM k{i} LEFT JOIN (
          SELECT x.id, count(*) AS degree FROM ends x WHERE x.id IN (SELECT id FROM k{i}) AND x.other IN (SELECT id FROM k{i})
          GROUP BY x.id) d USING (id))""")
    union = " UNION ALL ".join(f"SELECT id, degree, {i} AS iter FROM a{i}" for i in range(iterations + 1))
    steps = " UNION ALL ".join(
        f"SELECT {i} AS iter, {alpha(i)} AS alpha, coalesce(smallest, 0) AS min_degree FROM m{i} WHERE EXISTS (SELECT 1 FROM a{i - 1})"
        for i in range(1, iterations + 1))
    out.append(f"snap AS MATERIALIZED ({union})")
    out.append(f"steps AS MATERIALIZED ({steps})")
    out.append("last AS MATERIALIZED (SELECT id, max(iter) AS last_iter, arg_max(degree, iter) AS degree FROM snap GROUP BY id)")
    return ",\n".join(out)


USERS = """
users AS MATERIALIZED (SELECT id, min(label) AS label FROM (
  SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'N' ELSE 'P' END AS label FROM customer
  UNION ALL SELECT event_id * 2, CASE WHEN event_type = 'error' THEN 'N' ELSE 'P' END FROM events) GROUP BY id)
"""
LOCATED = """
located AS MATERIALIZED (SELECT users.id, CAST(last_iter AS BIGINT) AS iter, label FROM users JOIN last USING (id)),
cidx AS MATERIALIZED (SELECT iter, count(*) AS users FROM located GROUP BY iter)
"""
LEVELED = """
lev AS MATERIALIZED (SELECT e.src, e.dst, least(s.last_iter, d.last_iter) AS lo, greatest(s.last_iter, d.last_iter) AS hi
  FROM e JOIN last s ON s.id = e.src JOIN last d ON d.id = e.dst)
"""
METRICS = f"""
whole AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM lev WHERE lo >= 1),
met AS MATERIALIZED (
  SELECT s.iter, s.m, x.edges, x.edges::DOUBLE / nullif(s.m::DOUBLE * (s.m - 1), 0) AS fd, s.dm, s.total::DOUBLE / s.m AS fa, 2 * x.cut AS cs,
    x.edges / whole.n - 0.25::DOUBLE * pow((2 * x.edges + x.cut) / whole.n, 2) AS q,
    x.cut / nullif(least(2.0::DOUBLE * x.edges + x.cut, 2.0::DOUBLE * x.rest + x.cut), 0) AS phi
  FROM (SELECT iter, count(*) AS m, sum(degree) AS total, min(CASE WHEN degree > 0 THEN degree END) AS dm FROM snap WHERE iter > 1 GROUP BY iter) s
  JOIN (SELECT i.iter, count(*) FILTER (WHERE lo >= i.iter) AS edges, count(*) FILTER (WHERE hi < i.iter) AS rest,
      count(*) FILTER (WHERE lo < i.iter AND hi >= i.iter) AS cut
    FROM lev, (SELECT unnest(range(2, {PEEL + 1})) AS iter) i WHERE lo >= 1 GROUP BY i.iter) x USING (iter), whole)
"""
PEELED = chain(EDGES, peel(PEEL), USERS, LOCATED)

SQL["core_peel"] = PEELED + " SELECT id, CAST(last_iter AS BIGINT) AS last_iter, degree FROM last"
SQL["peel_stats"] = PEELED + """
, size AS (SELECT iter, count(*) AS vertices, CAST(sum(degree) / 2 AS BIGINT) AS edges FROM snap GROUP BY iter),
listed AS (SELECT iter, count(*) AS n FROM snap WHERE id IN (SELECT id FROM users) GROUP BY iter)
SELECT CAST(steps.iter AS BIGINT) AS iter, CAST(alpha AS BIGINT) AS alpha, min_degree, coalesce(vertices, 0) AS vertices,
  coalesce(edges, 0) AS edges, coalesce(now.n, 0) AS users_kept, coalesce(bef.n, 0) - coalesce(now.n, 0) AS users_removed
FROM steps LEFT JOIN size USING (iter) LEFT JOIN listed now ON now.iter = steps.iter LEFT JOIN listed bef ON bef.iter = steps.iter - 1"""
SQL["user_last_iter"] = PEELED + " SELECT id, iter, label FROM located"
SQL["community_index"] = PEELED + " SELECT iter, users FROM cidx"
SQL["not_in_graph"] = PEELED + " SELECT id, label FROM users WHERE id NOT IN (SELECT id FROM last)"
SQL["users_in_removed"] = PEELED + f"""
SELECT users.id, CAST(last_iter + 1 AS BIGINT) AS iter, degree, label FROM users JOIN last USING (id) WHERE last_iter < {PEEL}"""
SQL["new_users"] = PEELED + " SELECT id, iter FROM located WHERE id NOT IN (SELECT c_custkey FROM customer)"
SQL["community_metrics"] = PEELED + "," + LEVELED + "," + METRICS + """
SELECT CAST(iter AS BIGINT) AS iter, m, edges, dm, cs, round(fd, 6) AS fd, round(fa, 6) AS fa, round(q, 6) AS q, round(phi, 6) AS phi FROM met"""
SQL["community_weighted_avg"] = PEELED + "," + LEVELED + "," + METRICS + """
SELECT CAST(sum(users) AS BIGINT) AS users, """ + ", ".join(
    f"round(sum({c} * users) / sum(users), 6) AS avg_{c}" for c in ("m", "fd", "dm", "fa", "q", "phi")
) + " FROM met JOIN cidx USING (iter) WHERE iter >= 10"
SQL["user_attributes"] = PEELED + """
, bounds AS (SELECT iter, min(CASE WHEN degree > 0 THEN degree END) AS lo, max(degree) AS hi, count(*) AS community_size FROM snap GROUP BY iter),
votes AS (SELECT iter, sum(CASE WHEN label = 'N' THEN -1 ELSE 1 END)::DOUBLE / count(*) AS agreement FROM located GROUP BY iter)
SELECT located.id, located.iter, round((last.degree - lo)::DOUBLE / nullif(hi - lo, 0), 6) AS relative_degree, community_size,
  round(agreement, 6) AS agreement
FROM located JOIN last USING (id) JOIN bounds ON bounds.iter = located.iter JOIN votes ON votes.iter = located.iter"""


def closeness(rounds: int) -> str:
    out = ["""b0 AS MATERIALIZED (SELECT n_nationkey AS source, CAST(n_nationkey AS BIGINT) AS id, last_iter AS community, 0 AS d
      FROM nation JOIN last ON last.id = n_nationkey WHERE last_iter > 0)"""]
    for i in range(1, rounds + 1):
        p = f"b{i - 1}"
        out.append(f"""b{i} AS MATERIALIZED (SELECT source, id, community, min(d) AS d FROM (
          SELECT * FROM {p} UNION ALL SELECT {p}.source, lev.dst, {p}.community, {p}.d + 1 FROM {p} JOIN lev ON lev.src = {p}.id
          AND lev.lo >= {p}.community AND {p}.d = {i - 1}) GROUP BY source, id, community)""")
    return ",\n".join(out)


SQL["harmonic_closeness"] = PEELED + "," + LEVELED + "," + closeness(20) + """
SELECT CAST(source AS BIGINT) AS id, CAST(community AS BIGINT) AS community,
  round(sum(CASE WHEN d > 0 THEN 1.0::DOUBLE / d ELSE 0 END), 6) AS closeness FROM b20 GROUP BY 1, 2"""


def greedy(weight: str, rounds: int) -> str:
    """Rounds of removing all current minima until the target has the smallest score; nothing changes from then on."""
    out = [f"""weighted AS MATERIALIZED (SELECT src AS id, dst AS other, {weight} AS w FROM tri UNION ALL SELECT dst, src, {weight} FROM tri)""",
           "target AS MATERIALIZED (SELECT min(src) AS id FROM e)",
           "r0 AS MATERIALIZED (SELECT v.id, CAST(coalesce(sum(w), 0) AS BIGINT) AS score FROM v LEFT JOIN weighted USING (id) GROUP BY v.id)"]
    for i in range(1, rounds + 1):
        p = i - 1
        out.append(f"m{i} AS MATERIALIZED (SELECT min(score) AS lo, max(score) FILTER (WHERE r{p}.id = target.id) AS own FROM r{p}, target)")
        out.append(f"k{i} AS MATERIALIZED (SELECT r{p}.id FROM r{p}, m{i} WHERE own <= lo OR score > lo)")
        out.append(f"""r{i} AS MATERIALIZED (SELECT k{i}.id, CAST(coalesce(x.score, 0) AS BIGINT) AS score FROM k{i} LEFT JOIN (
          SELECT weighted.id, sum(w) AS score FROM weighted SEMI JOIN k{i} a ON a.id = weighted.id SEMI JOIN k{i} b ON b.id = weighted.other
          GROUP BY weighted.id) x USING (id))""")
    return ",\n".join(out)


SQL["greedy_degree_community"] = chain(EDGES, PROPS, greedy("1", 40)) + " SELECT id, score FROM r40"
SQL["greedy_overlap_community"] = chain(EDGES, PROPS, greedy("least(src_a, dst_a) + least(src_b, dst_b) + least(src_c, dst_c)", 200)) + (
    " SELECT id, score FROM r200"
)
SQL["set_metrics"] = GP + """
, c AS (SELECT count(*)::DOUBLE AS whole, (count(*) FILTER (WHERE src_a >= 10 AND dst_a >= 10))::DOUBLE AS edges,
  (count(*) FILTER (WHERE (src_a >= 10) <> (dst_a >= 10)))::DOUBLE AS cut, (SELECT count(*) FROM pv WHERE a >= 10)::DOUBLE AS m FROM tri)
SELECT CAST(m AS BIGINT) AS m, CAST(edges AS BIGINT) AS edges, CAST(2 * cut AS BIGINT) AS cs, round(edges / (m * (m - 1)), 6) AS fd,
  round(edges / whole - 0.25::DOUBLE * pow((2 * edges + cut) / whole, 2), 6) AS q,
  round(cut / least({volume}, 2 * (whole - edges - cut) + cut), 6) AS phi FROM c"""
SQL["set_metrics_whole"] = SQL["set_metrics"].replace("{volume}", "2 * whole + cut")
SQL["set_metrics"] = SQL["set_metrics"].replace("{volume}", "2 * edges + cut")

# --- topic model -------------------------------------------------------------------


def counts(of: str, key: str, name: str) -> str:
    columns = ks("CAST(sum(CASE WHEN z = {k} THEN 1 ELSE 0 END) AS BIGINT) AS n{k}")
    group = f" GROUP BY {key}" if key else ""
    return f"{name} AS MATERIALIZED (SELECT {key + ', ' if key else ''}{columns} FROM {of}{group})"


def pick(weights: str) -> str:
    """Topic from columns w0.., u: first running sum that reaches u times the total."""
    running = ["w0"]
    for k in range(1, K):
        running.append(f"({running[-1]} + w{k})")
    cases = " ".join(f"WHEN {running[k]} >= u * {running[-1]} THEN {k}" for k in range(K - 1))
    return f"CASE {cases} ELSE {K - 1} END"


A, B_ = "0.45::DOUBLE", "0.01::DOUBLE"
INIT = f"""
z0 AS MATERIALIZED (SELECT doc_id, pos, word_id, CAST(floor({draw('doc_id', 'pos', "'0'")} * {K}) AS INT) AS z FROM tok JOIN voc USING (word))
"""
SWEEP = f"""
{counts('z0', 'word_id', 'nw0')}, {counts('z0', 'doc_id', 'nd0')}, {counts('z0', '', 'nt0')},
size AS MATERIALIZED (SELECT count(*)::DOUBLE * {B_} AS vb FROM voc),
ws AS (SELECT z0.doc_id, z0.pos, z0.word_id, {draw('z0.doc_id', 'z0.pos', "'1'")} AS u,
  {ks('''(nd0.n{k} - CASE WHEN z = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.45::DOUBLE)
   * (nw0.n{k} - CASE WHEN z = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.01::DOUBLE)
   / (nt0.n{k} - CASE WHEN z = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + size.vb) AS w{k}''')}
  FROM z0 JOIN nd0 USING (doc_id) JOIN nw0 ON nw0.word_id = z0.word_id, nt0, size),
z1 AS MATERIALIZED (SELECT doc_id, pos, word_id, {pick('')} AS z FROM ws),
{counts('z1', 'word_id', 'nw')}, {counts('z1', 'doc_id', 'nd')}, {counts('z1', '', 'nt')},
theta AS MATERIALIZED (SELECT doc_id, {ks('n{k} / (' + ' + '.join(f'n{j}' for j in range(K)) + ')::DOUBLE AS t{k}')} FROM nd),
phi AS MATERIALIZED (SELECT word_id, {ks('nw.n{k} / nt.n{k}::DOUBLE AS p{k}')} FROM nw, nt)
"""
MODEL = chain(TOK, VOC, INIT, SWEEP)


def sweeps(n: int) -> str:
    """Training sweeps 1 to n: ``z{i}`` drawn against the counts of ``z{i - 1}``."""
    own = "CASE WHEN z = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    out = [f"size AS MATERIALIZED (SELECT count(*)::DOUBLE * {B_} AS vb FROM voc)"]
    for i in range(1, n + 1):
        p = i - 1
        weight = (f"(d{p}.n{{k}} - {own} + {A}) * (w{p}.n{{k}} - {own} + {B_}) / (t{p}.n{{k}} - {own} + size.vb) AS w{{k}}")
        out += [
            counts(f"z{p}", "word_id", f"w{p}"), counts(f"z{p}", "doc_id", f"d{p}"), counts(f"z{p}", "", f"t{p}"),
            f"""q{i} AS (SELECT z{p}.doc_id, z{p}.pos, z{p}.word_id, {draw(f'z{p}.doc_id', f'z{p}.pos', f"'{i}'")} AS u, {ks(weight)}
              FROM z{p} JOIN d{p} USING (doc_id) JOIN w{p} ON w{p}.word_id = z{p}.word_id, t{p}, size)""",
            f"z{i} AS MATERIALIZED (SELECT doc_id, pos, word_id, {pick('')} AS z FROM q{i})",
        ]
    return ",\n".join([*out, counts(f"z{n}", "word_id", "trained")])


def fold_ins(n: int) -> str:
    """Sweeps 1 to n over the new texts with the word shares fixed."""
    own = "CASE WHEN z = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    out = [f"""y0 AS MATERIALIZED (SELECT doc_id, pos, word_id, CAST(floor({draw('doc_id', 'pos', "'0'")} * {K}) AS INT) AS z,
      CAST({draw('doc_id', 'pos')} * 4503599627370496.0::DOUBLE AS BIGINT) AS bits FROM new_tok JOIN voc USING (word))"""]
    for i in range(1, n + 1):
        p = i - 1
        weight = f"phi.p{{k}} * (g{p}.n{{k}} - {own} + {A}) / ({' + '.join(f'g{p}.n{j}' for j in range(K))} - 1 + 1.8::DOUBLE) AS w{{k}}"
        out += [
            counts(f"y{p}", "doc_id", f"g{p}"),
            f"""x{i} AS (SELECT y{p}.doc_id, y{p}.pos, y{p}.word_id, bits, {remix('bits', i)}, {ks(weight)}
              FROM y{p} JOIN g{p} USING (doc_id) JOIN phi ON phi.word_id = y{p}.word_id)""",
            f"y{i} AS MATERIALIZED (SELECT doc_id, pos, word_id, bits, {pick('')} AS z FROM x{i})",
        ]
    return ",\n".join([*out, counts(f"y{n}", "doc_id", "folded")])



def long(table: str, key: str, column: str, name: str, where: str = "") -> str:
    """K columns as rows with a topic number."""
    return " UNION ALL ".join(
        f"SELECT {key}, {k} AS topic, {column.format(k=k)} AS {name} FROM {table} {where.format(k=k)}" for k in range(K)
    )


SQL["lda_init_counts"] = chain(TOK, VOC, INIT, counts("z0", "word_id", "nw0")) + "\n" + long("nw0", "word_id", "n{k}", "n", "WHERE n{k} > 0")
SQL["lda_one_sweep"] = MODEL + "\n" + long("nw", "word_id", "n{k}", "n", "WHERE n{k} > 0")
SQL["lda_doc_topics"] = MODEL + "\n" + long("nd", "doc_id", "n{k}", "n")
SQL["lda_topic_totals"] = MODEL + "\n" + " UNION ALL ".join(f"SELECT {k} AS topic, n{k} AS n FROM nt" for k in range(K))
SQL["lda_theta"] = MODEL + "\n" + long("theta", "doc_id", "round(t{k}, 6)", "theta")
SQL["lda_phi"] = MODEL + "\n" + long("phi", "word_id", "round(p{k}, 9)", "p", "WHERE p{k} > 0")
TOP = f"""
top AS MATERIALIZED (SELECT * FROM (SELECT topic, word_id, n, p, row_number() OVER (PARTITION BY topic ORDER BY n DESC, word_id) AS rank FROM (
  {" UNION ALL ".join(f"SELECT {k} AS topic, word_id, nw.n{k} AS n, nw.n{k} / nt.n{k}::DOUBLE AS p FROM nw, nt" for k in range(K))})) WHERE rank <= 10)
"""
SQL["lda_top_words"] = MODEL + "," + TOP + " SELECT topic, rank, word, top.n, round(p, 9) AS p FROM top JOIN voc USING (word_id)"
SQL["lda_topic_report"] = MODEL + "," + TOP + """
SELECT topic, string_agg('n(' || word || ')=' || top.n, ' ' ORDER BY rank) AS words FROM top JOIN voc USING (word_id) GROUP BY topic"""
SQL["lda_fit"] = chain(TOK, VOC, INIT, sweeps(SWEEPS)) + "\n" + long("trained", "word_id", "n{k}", "n", "WHERE n{k} > 0")
SQL["lda_alias_totals"] = chain(TOK) + """
SELECT 'word' AS kind, word AS item, count(*) AS n FROM tok GROUP BY word
UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), count(*) FROM tok GROUP BY doc_id"""
for _name, _sweeps in (("lda_fold_in_step", 1), ("lda_fold_in", 50)):
    SQL[_name] = MODEL + "," + NEW + ",\n" + fold_ins(_sweeps) + "\n" + long(
        "folded", "doc_id", "round((n{k} + 0.45::DOUBLE) / (n0 + n1 + n2 + n3 + 1.8::DOUBLE), 6)", "theta")
SQL["new_text_tokens"] = chain(TOK, VOC, NEW) + f"""
SELECT doc_id, pos, coalesce(word_id, CAST(floor({draw('doc_id', 'pos', "'-1'")} * (SELECT count(*) FROM voc)) AS BIGINT)) AS word_id
FROM new_tok LEFT JOIN voc USING (word)"""


def em(steps: int, k: int = 3) -> str:
    each = lambda item: ", ".join(item.format(k=i) for i in range(k))
    more, below = f"({50.0 / k}::DOUBLE)", "(0.1::DOUBLE)"
    total = " + ".join(f"w{i}" for i in range(k))
    out = ["terms AS MATERIALIZED (SELECT doc_id, word_id, count(*) AS n FROM tok JOIN voc USING (word) GROUP BY doc_id, word_id)"]
    for step in range(steps + 1):
        p = step - 1
        if step:
            weights = each(f"(nw{p}.n{{k}} + {below}) * (nd{p}.n{{k}} + {more}) / (nt{p}.n{{k}} + (SELECT count(*) FROM voc) * {below}) AS w{{k}}")
            source = f"terms JOIN nw{p} USING (word_id) JOIN nd{p} USING (doc_id), nt{p}"
        else:
            weights, source = ", ".join(f"{draw('word_id', repr(str(i)))} AS w{i}" for i in range(k)), "terms"
        out.append(f"""em{step} AS MATERIALIZED (SELECT doc_id, word_id, {each(f'n * w{{k}} / ({total}) AS g{{k}}')}
          FROM (SELECT doc_id, word_id, n, {weights} FROM {source}))""")
        sums = each("sum(g{k}) AS n{k}")
        out.append(f"nw{step} AS MATERIALIZED (SELECT word_id, {sums} FROM em{step} GROUP BY word_id)")
        out.append(f"nd{step} AS MATERIALIZED (SELECT doc_id, {sums} FROM em{step} GROUP BY doc_id)")
        out.append(f"nt{step} AS MATERIALIZED (SELECT {sums} FROM em{step})")
    return ",\n".join(out)


def em_new(steps: int, k: int = 3) -> str:
    each = lambda item: ", ".join(item.format(k=i) for i in range(k))
    more, total = f"({50.0 / k}::DOUBLE)", " + ".join(f"w{i}" for i in range(k))
    out = ["new_terms AS MATERIALIZED (SELECT doc_id, word_id, count(*) AS n FROM new_tok JOIN voc USING (word) GROUP BY doc_id, word_id)",
           f"d0 AS MATERIALIZED (SELECT doc_id, {each(f'sum(n) / {k}::DOUBLE AS n{{k}}')} FROM new_terms GROUP BY doc_id)"]
    for step in range(1, steps + 1):
        weights = each(
            f"(nw2.n{{k}} + 0.1::DOUBLE) / (nt2.n{{k}} + (SELECT count(*) FROM voc) * 0.1::DOUBLE) * (d{step - 1}.n{{k}} + {more}) AS w{{k}}"
        )
        out.append(f"""d{step} AS MATERIALIZED (SELECT doc_id, {each(f'sum(n * w{{k}} / ({total})) AS n{{k}}')} FROM (
          SELECT doc_id, n, {weights} FROM new_terms JOIN nw2 USING (word_id) JOIN d{step - 1} USING (doc_id), nt2) GROUP BY doc_id)""")
    return ",\n".join(out)


def em_shares(table: str, k: int = 3) -> str:
    size = " + ".join(f"n{i}" for i in range(k))
    return " UNION ALL ".join(
        f"SELECT doc_id, CAST({i} AS INT) AS topic, round((n{i} + {50.0 / k}::DOUBLE) / ({size} + 50.0::DOUBLE), 6) AS theta FROM {table}" for i in range(k)
    )


EM = chain(TOK, VOC, em(2))
SQL["em_word_topics"] = EM + " " + " UNION ALL ".join(f"SELECT word_id, CAST({i} AS INT) AS topic, round(n{i}, 5) AS n FROM nw2" for i in range(3))
SQL["em_doc_topics"] = EM + " " + em_shares("nd2")
SQL["em_topic_sums"] = EM + " " + " UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS topic, count(*) AS terms, round(sum(nw2.n{i} / nt2.n{i}), 6) AS weight FROM nw2, nt2 WHERE nw2.n{i} > 0" for i in range(3)
)
SQL["em_new_texts"] = chain(TOK, VOC, em(2), NEW, em_new(3)) + " " + em_shares("d3")

# --- relevance -----------------------------------------------------------------------

TOTAL = "(" + " + ".join(f"nt.n{k}" for k in range(K)) + ")"
LIFT = f"""
pw AS MATERIALIZED (SELECT word_id, word, n / (SELECT sum(n) FROM voc)::DOUBLE AS p FROM voc),
lift AS MATERIALIZED (SELECT word_id, word, {ks('phi.p{k} / (nt.n{k} / ' + TOTAL + '::DOUBLE) / pw.p AS l{k}')} FROM phi JOIN pw USING (word_id), nt),
post AS MATERIALIZED (SELECT word_id, word, {ks('phi.p{k} * (nt.n{k} / ' + TOTAL + '::DOUBLE) / pw.p AS l{k}')} FROM phi JOIN pw USING (word_id), nt),
scores AS MATERIALIZED (SELECT word_id, word, {ks('l{k}', ' + ')} AS score FROM lift),
qset AS MATERIALIZED (SELECT word_id, word FROM scores ORDER BY score DESC, word LIMIT 20)
"""
SQL["topic_prior"] = MODEL + "\n" + " UNION ALL ".join(
    f"SELECT {k} AS topic, n{k} AS n, round(n{k} / {TOTAL}::DOUBLE, 6) AS p FROM nt" for k in range(K))
SQL["word_probability"] = chain(TOK, VOC, NEW) + """
, nv AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT DISTINCT word FROM new_tok))
SELECT nv.word_id, word, round(coalesce(n / (SELECT sum(n) FROM voc)::DOUBLE, 0), 9) AS p FROM nv LEFT JOIN voc USING (word)"""
SQL["word_topic_posterior"] = MODEL + "," + LIFT + " SELECT * FROM (" + long("post", "word_id", "round(l{k}, 6)", "p") + ") WHERE p > 0"
SQL["word_lift_rank"] = MODEL + "," + LIFT + " SELECT word_id, word, round(score, 6) AS score FROM scores"
SQL["query_words"] = MODEL + "," + LIFT + " SELECT word_id, word FROM qset"
NORM = "sqrt(" + " + ".join(f"{{t}}.p{k} * {{t}}.p{k}" for k in range(K)) + ")"
SQL["word_similarity"] = MODEL + f""",
seed AS MATERIALIZED (SELECT word_id FROM voc ORDER BY n DESC, word LIMIT 5),
sim AS (SELECT s.word_id AS seed_id, w.word_id, round(({" + ".join(f"s.p{k} * w.p{k}" for k in range(K))}) / ({NORM.format(t='w')} * {NORM.format(t='s')}), 12) AS similarity
  FROM phi w, phi s WHERE s.word_id IN (SELECT word_id FROM seed) AND s.word_id <> w.word_id)
SELECT seed_id, word_id, round(similarity, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY similarity DESC, word_id) AS r FROM sim WHERE similarity > 0) WHERE r <= 10"""
QUERY = f"""
{DF},
mix AS MATERIALIZED (SELECT qset.word_id, {ks('0.4::DOUBLE * (0.3::DOUBLE * (nw.n{k} / voc.n::DOUBLE) + 0.7::DOUBLE * (dfreq.df / (SELECT count(*) FROM documents)::DOUBLE)) + 0.6::DOUBLE * phi.p{k} AS x{k}')}
  FROM qset JOIN voc USING (word_id) JOIN nw ON nw.word_id = qset.word_id JOIN phi ON phi.word_id = qset.word_id JOIN dfreq ON dfreq.word = qset.word),
ql AS MATERIALIZED (SELECT {ks('sum(x{k}) AS q{k}')}, {ks('sum(ln(x{k})) AS g{k}')} FROM mix)
"""
RELEVANCE = f"""
urel AS MATERIALIZED (SELECT source AS user_id, count(*) AS docs, {ks('sum(t{k} * q{k}) AS s{k}')}
  FROM theta JOIN documents USING (doc_id), ql GROUP BY source),
scaled AS MATERIALIZED (SELECT user_id, {ks('(s{k} / docs * 10000) % 10000 AS x{k}')}, {ks('(s{k} / docs * 10000) % 10000', ' + ')} AS score FROM urel)
"""
USER_TABLE = """
people AS (SELECT source AS user_id, count(*) AS items, max(n_chars) AS longest FROM documents GROUP BY source
  UNION ALL SELECT role, count(*), max(length(text)) FROM conversations GROUP BY role)
"""
REL = MODEL + "," + LIFT + "," + QUERY + "," + RELEVANCE
SQL["query_topic_likelihood"] = MODEL + "," + LIFT + "," + QUERY + " UNION ALL ".join(
    f"SELECT {k} AS topic, round(q{k}, 9) AS likelihood FROM ql" for k in range(K))
SQL["query_topic_loglikelihood"] = MODEL + "," + LIFT + "," + QUERY + " UNION ALL ".join(
    f"SELECT {k} AS topic, round(g{k}, 6) AS likelihood FROM ql" for k in range(K))
SQL["user_relevance"] = REL + " UNION ALL ".join(
    f"SELECT user_id, docs, {k} AS topic, round(s{k} / docs, 9) AS relevance, round({ks('s{k}', ' + ')}, 9) AS total FROM urel" for k in range(K))
SQL["user_relevance_scaled"] = REL + " UNION ALL ".join(
    f"SELECT user_id, {k} AS topic, round(x{k}, 6) AS scaled, round(score, 6) AS score FROM scaled" for k in range(K))
SQL["users_with_relevance"] = REL + "," + USER_TABLE + """
SELECT user_id, items, longest, round(coalesce(score, 0), 6) AS score FROM people LEFT JOIN scaled USING (user_id)"""
SQL["users_nonzero"] = REL + "," + USER_TABLE + """
SELECT user_id, items, longest, round(score, 6) AS score FROM people JOIN scaled USING (user_id) WHERE round(score, 6) <> 0"""

# --- likelihood --------------------------------------------------------------------------

PAIRS = f"""
pairs AS MATERIALIZED (SELECT doc_id, word_id, count(*) AS n FROM tok JOIN voc USING (word) GROUP BY doc_id, word_id),
lik AS MATERIALIZED (SELECT doc_id, word_id, n, {ks('t{k} * p{k}', ' + ')} AS p FROM pairs JOIN theta USING (doc_id) JOIN phi USING (word_id))
"""
LIK = MODEL + "," + PAIRS
SQL["token_index"] = chain(TOK, VOC, NEW) + """
SELECT doc_id, coalesce(word_id, -1) AS word_id, count(*) AS n FROM new_tok LEFT JOIN voc USING (word) GROUP BY 1, 2"""
SQL["token_likelihood"] = LIK + " SELECT doc_id, word_id, n, round(p, 9) AS p FROM lik"
SQL["document_likelihood"] = LIK + " SELECT doc_id, round(sum(n * p), 6) AS mass, CAST(sum(n) AS BIGINT) AS n FROM lik GROUP BY doc_id"
SQL["mean_likelihood"] = LIK + " SELECT round(abs(sum(n * p) / (SELECT count(*) FROM documents)), 6) AS mean_likelihood FROM lik WHERE p <> 0"
SQL["perplexity"] = LIK + " SELECT CAST(sum(n) AS BIGINT) AS n_tokens, round(exp(-sum(n * ln(p)) / sum(n)), 4) AS perplexity FROM lik WHERE p > 0"
SQL["sparse_theta"] = MODEL + " SELECT doc_id, topic, round(p, 6) AS p FROM (" + long("theta", "doc_id", "t{k}", "p") + ") WHERE p > 0.2"
LINKS = f"""
sth AS ({long("theta", "doc_id", "t{k}", "p", "WHERE t{k} > 0")}),
sph AS ({long("phi", "word_id", "p{k}", "p", "WHERE p{k} > 0")}),
links AS MATERIALIZED (SELECT word_id, topic, p, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT word_id, topic, round(CAST(p AS DECIMAL(18, 12)), 2)::DOUBLE AS p, n FROM pairs JOIN sth USING (doc_id)) WHERE p >= 0.2 GROUP BY 1, 2, 3),
mass AS MATERIALIZED (SELECT links.word_id, sum(links.n * links.p * coalesce(sph.p, 0)) AS mass FROM links LEFT JOIN sph USING (word_id, topic) GROUP BY links.word_id)
"""
LINKED = LIK + "," + LINKS
SQL["topic_links"] = LINKED + " SELECT word_id, topic, p, n FROM links"
SQL["word_mass"] = LINKED + " SELECT word_id, round(mass, 6) AS mass FROM mass"
SQL["staged_likelihood"] = LINKED + " SELECT round(sum(mass), 6) AS mass FROM mass"

# --- learning ------------------------------------------------------------------------------

FEATURES = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
POINTS = f"""
mo AS MATERIALIZED (SELECT {", ".join(f"avg({c}) AS m_{f}, stddev_pop({c}) AS s_{f}" for f, c in FEATURES.items())} FROM lineitem),
pts AS MATERIALIZED (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
  {", ".join(f"({c} - m_{f}) / s_{f} AS {f}" for f, c in FEATURES.items())} FROM lineitem, mo)
"""


def weighted(table: str) -> str:
    return "(" + " + ".join(f"{table}.{f} * pts.{f}" for f in FEATURES) + ")"


def descent(name: str, penalty: str | None = None, reg: float = 0.01, iterations: int = 100) -> str:
    """Unrolled descent; once a move is short enough, the weights stay."""
    out = [f"{name}0 AS (SELECT " + ", ".join(f"0::DOUBLE AS {f}" for f in FEATURES) + ", false AS done)"]
    for i in range(1, iterations + 1):
        p, rate = f"{name}{i - 1}", f"(1.0::DOUBLE / sqrt({i}))"
        shrink = f" * (1 - {rate} * {reg}::DOUBLE)" if penalty == "l2" else ""
        moved = {f: f"{p}.{f}{shrink} - {rate} * g.{f}" for f in FEATURES}
        if penalty == "l1":
            moved = {f: f"sign({m}) * greatest(0, abs({m}) - {rate} * {reg}::DOUBLE)" for f, m in moved.items()}
        grads = ", ".join(f"avg(({weighted(p)} - pts.label) * pts.{f}) AS {f}" for f in FEATURES)
        step = "sqrt(" + " + ".join(f"pow({f} - o_{f}, 2)" for f in FEATURES) + ")"
        size = "sqrt(" + " + ".join(f"pow({f}, 2)" for f in FEATURES) + ")"
        out.append(f"{name}{i} AS MATERIALIZED (SELECT " + ", ".join(FEATURES)
                   + f", was OR ({i} > 1 AND {step} < 0.001::DOUBLE * greatest({size}, 1.0::DOUBLE)) AS done FROM (SELECT "
                   + ", ".join(f"CASE WHEN {p}.done THEN {p}.{f} ELSE {m} END AS {f}, {p}.{f} AS o_{f}" for f, m in moved.items())
                   + f", {p}.done AS was FROM {p}, (SELECT {grads} FROM pts, {p} WHERE NOT {p}.done) g))")
    return ",\n".join(out)


def weight_rows(table: str, places: int = 6) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, round({f}, {places}) AS weight FROM {table}" for f in FEATURES)


SQL["linreg_gd"] = chain(POINTS, descent("w")) + "\n" + weight_rows("w100")
SQL["ridge_gd"] = chain(POINTS, descent("w", "l2")) + "\n" + weight_rows("w100")
SQL["lasso_gd"] = chain(POINTS, descent("w", "l1", 0.0005)) + "\n" + weight_rows("w100")


def logistic(iterations: int) -> str:
    out = ["w0 AS (SELECT " + ", ".join(f"0::DOUBLE AS {f}" for f in FEATURES) + ")"]
    for i in range(1, iterations + 1):
        p = f"w{i - 1}"
        factor = f"(1.0::DOUBLE / (1.0::DOUBLE + exp(least(-(2 * label - 1) * {weighted(p)}, 700))) - 1.0::DOUBLE) * (2 * label - 1)"
        grads = ", ".join(f"sum(x * {f}) AS {f}" for f in FEATURES)
        out.append(f"w{i} AS MATERIALIZED (SELECT " + ", ".join(f"{p}.{f} - g.{f} AS {f}" for f in FEATURES)
                   + f" FROM {p}, (SELECT {grads} FROM (SELECT {factor} AS x, pts.* FROM pts, {p})) g)")
    return ",\n".join(out)


SQL["logreg_gd"] = chain(POINTS, logistic(5)) + "\n" + weight_rows("w5", 3)
SCORED = chain(POINTS, descent("w"), f"scored AS MATERIALIZED (SELECT label, {weighted('w100')} AS score FROM pts, w100)")
SQL["predictions"] = SCORED + " SELECT label, score > 0 AS above, count(*) AS n, round(sum(score), 6) AS total FROM scored GROUP BY 1, 2"
SQL["auc"] = SCORED + """
, g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score),
c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score) - neg AS below FROM g)
SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM c"""
CONFUSION = "cm AS (SELECT label, CASE WHEN score > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction, count(*) AS n FROM scored GROUP BY 1, 2)"
SQL["confusion"] = SCORED + "," + CONFUSION + " SELECT label, prediction, n FROM cm"
SQL["class_metrics"] = SCORED + "," + CONFUSION + """
, k AS (SELECT label AS class FROM cm UNION SELECT prediction FROM cm),
s AS (SELECT class, coalesce((SELECT sum(n) FROM cm WHERE label = class), 0)::DOUBLE AS a, coalesce((SELECT sum(n) FROM cm WHERE prediction = class), 0)::DOUBLE AS c,
  coalesce((SELECT sum(n) FROM cm WHERE prediction = class AND label = class), 0)::DOUBLE AS h FROM k)
SELECT class, round(CASE WHEN c > 0 THEN h / c ELSE 0 END, 6) AS precision, round(CASE WHEN a > 0 THEN h / a ELSE 0 END, 6) AS recall,
  round(CASE WHEN a + c > 0 THEN 2 * h / (a + c) ELSE 0 END, 6) AS f,
  round((SELECT sum(n) FROM cm WHERE label = prediction)::DOUBLE / (SELECT sum(n) FROM cm), 6) AS accuracy FROM s"""
SQL["mse"] = chain(POINTS, descent("w"), descent("r", "l2"), descent("l", "l1", 0.0005)) + "\n" + " UNION ALL ".join(
    f"SELECT '{name}' AS model, round(avg(pow(label - {weighted(t)}, 2)), 6) AS mse FROM pts, {t}"
    for name, t in (("linear", "w100"), ("ridge", "r100"), ("lasso", "l100"))
)

# --- files and models --------------------------------------------------------------------

SQL["delimited_file_roundtrip"] = """
SELECT p_partkey AS id, CAST(p_size AS INT) AS size, CAST(p_retailprice AS DOUBLE) AS price FROM part"""
SQL["folder_scan"] = SQL["delimited_file_roundtrip"]
SQL["single_file_report"] = "SELECT source, count(*) AS n FROM documents GROUP BY source"
SQL["snapshot_roundtrip"] = G + " SELECT src, dst, attr FROM e"
SQL["update_where_matched"] = GP + """
SELECT id, CAST(CASE WHEN id IN (SELECT c_custkey FROM customer) THEN 0 ELSE a END AS BIGINT) AS a FROM pv"""
SQL["map_vertices"] = GP + " SELECT id, CAST(a + b + c AS BIGINT) AS total FROM pv"
SQL["map_edges"] = G + " SELECT src, dst, attr * 2 + 1 AS attr FROM e"
SQL["model_save_load"] = SQL["lda_one_sweep"]
SQL["model_text"] = SQL["lda_one_sweep"]
for _name, _same in (("theta", "lda_theta"), ("phi", "lda_phi"), ("nmk", "lda_doc_topics"), ("nk", "lda_topic_totals")):
    SQL[f"model_text_{_name}"] = SQL[_same]
SQL["model_text_words"] = chain(TOK, VOC) + " SELECT word_id, word FROM voc"
SQL["lda_resume"] = chain(TOK, VOC, INIT, sweeps(2)) + "\n" + long("trained", "word_id", "n{k}", "n", "WHERE n{k} > 0")
SQL["weights_save_load"] = SQL["linreg_gd"]
SQL["mllib_lda_topics"] = "SELECT unnest(range(3)) AS topic, CAST(10 AS BIGINT) AS ranks, CAST(10 AS BIGINT) AS words, true AS positive"
SQL["mllib_lda_sums"] = chain(TOK, VOC) + """
SELECT unnest(range(3)) AS topic, (SELECT count(*) FROM voc) AS terms, 1.0::DOUBLE AS weight"""
SQL["mllib_lda_theta"] = chain(TOK) + """
SELECT doc_id, CAST(3 AS BIGINT) AS topics, 1.0::DOUBLE AS total FROM (SELECT DISTINCT doc_id FROM tok)"""
SQL["edge_line_kinds"] = """
SELECT CASE o_custkey % 7 WHEN 0 THEN 'short' WHEN 1 THEN 'comment' ELSE 'edge' END AS kind, count(*) AS n FROM orders GROUP BY 1"""
