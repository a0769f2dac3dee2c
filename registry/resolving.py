"""Near-duplicates and comparison of linked systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import query, table, union_sql, view, with_views
from stratalens.operators import compare as C
from stratalens.operators import duplicates as D
from stratalens.operators.profile import profile
from stratalens.staging import stage

ROLES = {"email": "email_address", "phone": "mobile_phone", "first_name": "first_name", "last_name": "last_name", "dob": "birth_date"}

# The comparable forms, blocks, pairs and scores of people_dup.
_NORM = """, n AS (SELECT person_id AS rid, lower(trim(email_address)) AS n_email, right(regexp_replace(mobile_phone, '[^0-9]', '', 'g'), 8) AS n_phone,
        trim(regexp_replace(lower(strip_accents(first_name)), '[^a-z ]', '', 'g')) AS n_first_name,
        trim(regexp_replace(lower(strip_accents(last_name)), '[^a-z ]', '', 'g')) AS n_last_name,
        CAST(CAST(coalesce(try_strptime(birth_date, '%Y-%m-%d'), try_strptime(birth_date, '%d/%m/%Y')) AS DATE) AS VARCHAR) AS n_dob FROM people_dup)"""
_BLOCKS = """, b AS (SELECT rid, 0 AS b, n_email AS k FROM n UNION ALL SELECT rid, 1, n_phone FROM n UNION ALL SELECT rid, 2, n_first_name || '|' || n_last_name FROM n
        UNION ALL SELECT rid, 3, n_dob || '|' || left(n_last_name, 3) FROM n),
    sized AS (SELECT *, count(*) OVER (PARTITION BY b, k) AS size FROM b WHERE k IS NOT NULL),
    pairs AS (SELECT DISTINCT x.rid AS ra, y.rid AS rb FROM sized x JOIN sized y ON x.b = y.b AND x.k = y.k AND x.rid < y.rid)"""


def _both(expr: str, role: str) -> str:
    return f"CASE WHEN x.n_{role} IS NULL OR y.n_{role} IS NULL THEN NULL ELSE {expr.format(a=f'x.n_{role}', b=f'y.n_{role}')} END"


_EXACT, _NEAR = "CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 0.0 END", "jaro_winkler_similarity({a}, {b})"
_ROLE_SCORES = {r: _both(_NEAR if "name" in r else _EXACT, r) for r in ROLES}
_SCORES = f""", raw AS (SELECT ra, rb, {', '.join(f'{s} AS s_{r}' for r, s in _ROLE_SCORES.items())} FROM pairs JOIN n x ON x.rid = ra JOIN n y ON y.rid = rb),
    scored AS (SELECT ra, rb, ({' + '.join(f'coalesce(s_{r} * {D.WEIGHTS[r]}, 0)' for r in ROLES)})
                 / ({' + '.join(f'CASE WHEN s_{r} IS NULL THEN 0 ELSE {D.WEIGHTS[r]}::DOUBLE END' for r in ROLES)}) AS score,
                 {' + '.join(f'CASE WHEN s_{r} IS NULL THEN 0 ELSE 1 END' for r in ROLES)} AS compared FROM raw),
    dup AS (SELECT * FROM scored WHERE compared >= 2 AND score >= 0.9)"""
_BASE = with_views("people_dup").rstrip() + _NORM
# every duplicate of people_dup is a copy of one person, so the smallest partner names the cluster
_CLUSTERS = """, e AS (SELECT ra AS a, rb AS b FROM dup UNION SELECT rb, ra FROM dup UNION SELECT ra, ra FROM dup UNION SELECT rb, rb FROM dup),
    clusters AS (SELECT a AS rid, min(b) AS cluster FROM e GROUP BY 1)"""


def _records(spark, sf):
    return stage(D.normalised(view(spark, sf, "people_dup"), "person_id", ROLES), "normalised")


def _scored(spark, sf):
    return stage(D.score_duplicates(_records(spark, sf), ROLES), "pairs")


@query("duplicate_roles", with_views("people_dup") + union_sql([
    f"SELECT '{r}' AS role, '{c}' AS column_name FROM people_dup HAVING count(DISTINCT {c}) > 1" for r, c in ROLES.items()]))
def duplicate_roles(spark, sf):
    return D.duplicate_roles(profile({"people_dup": view(spark, sf, "people_dup")})).select("role", "column_name")


@query("normalise_role", _BASE + " SELECT * FROM n")
def normalise_role(spark, sf):
    return D.normalised(view(spark, sf, "people_dup"), "person_id", ROLES)


@query("blocking_pairs", _BASE + _BLOCKS + " SELECT ra, rb FROM pairs")
def blocking_pairs(spark, sf):
    return D.blocking_pairs(_records(spark, sf), ROLES)


@query("score_duplicates", _BASE + _BLOCKS + _SCORES + " SELECT ra, rb, round(score, 6) AS score, compared FROM dup")
def score_duplicates(spark, sf):
    return _scored(spark, sf).withColumn("score", F.round("score", 6))


@query("duplicate_clusters", _BASE + _BLOCKS + _SCORES + _CLUSTERS + " SELECT rid, cluster FROM clusters")
def duplicate_clusters(spark, sf):
    return D.duplicate_clusters(_scored(spark, sf))


@query("find_duplicates", _BASE + _BLOCKS + _SCORES + _CLUSTERS + """
    SELECT (SELECT count(*) FROM dup) AS pairs, (SELECT count(*) FROM people_dup) AS rows, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows_in_groups,
           max(n) AS largest_group FROM (SELECT cluster, count(*) AS n FROM clusters GROUP BY 1)""")
def find_duplicates(spark, sf):
    return D.find_duplicates(view(spark, sf, "people_dup"), "person_id", ROLES)["summary"]


@query("find_duplicates_large", """
    SELECT count(*) AS rows, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs, count(*) FILTER (WHERE n > 1) AS groups,
           CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in_groups, max(n) AS largest_group, (SELECT count(*) FROM lineitem) AS lines
    FROM (SELECT l_partkey, l_suppkey % 3 AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)""".replace("count(*) AS rows,", "CAST(sum(n) AS BIGINT) AS rows,"))
def find_duplicates_large(spark, sf):
    """Blocks of hundreds of rows: all lines of a supplier share a phone; those of one part and supplier are the same record."""
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS _line", "l_partkey", "l_suppkey % 3 AS s")
    people = lines.selectExpr("l_partkey", "s", "concat('part', l_partkey, '@s', s, '.org') AS mail", "concat('+1 555 000 000', s) AS phone")
    found = D.find_duplicates(people, None, {"email": "mail", "phone": "phone"})["summary"]
    return found.withColumn("lines", F.lit(lines.count()))


_LETTERS = "translate(substr(md5(CAST({k} AS {text})), {start}, {n}), '0123456789', 'ghijklmnop')"


def _one_phone(text: str) -> str:
    """Every customer with a made-up name, each second one nearly that of the one before, and all with one phone."""
    half = "(c_custkey // 2)" if text == "VARCHAR" else "(c_custkey div 2)"
    first = _LETTERS.format(k=half, text=text, start=1, n=7) + " || CASE WHEN c_custkey % 2 = 1 THEN 'e' ELSE '' END"
    return f"c_custkey, {first} AS first_name, {_LETTERS.format(k=half, text=text, start=9, n=9)} AS last_name, '+1 555 000 1234' AS phone"


@query("find_duplicates_one_phone", f"""
    WITH n AS (SELECT {_one_phone('VARCHAR')} FROM customer),
    s AS (SELECT x.c_custkey AS ra, y.c_custkey AS rb, (2.0::DOUBLE + jaro_winkler_similarity(x.first_name, y.first_name) + 1.5::DOUBLE * jaro_winkler_similarity(x.last_name, y.last_name)) / 4.5 AS score
      FROM n x JOIN n y ON x.c_custkey < y.c_custkey)
    SELECT ra, rb, round(score, 6) AS score, 3 AS compared FROM s WHERE score >= 0.9""")
def find_duplicates_one_phone(spark, sf):
    """All records are one block: near names are found without scoring all its pairs."""
    table(spark, sf, "customer").createOrReplaceTempView("one_phone_customer")
    people = spark.sql(f"SELECT {_one_phone('STRING')} FROM one_phone_customer")
    return D.find_duplicates(people, "c_custkey", {"phone": "phone", "first_name": "first_name", "last_name": "last_name"})["pairs"].withColumn("score", F.round("score", 6))


@query("duplicate_examples")
def duplicate_examples(spark, sf):
    """The most similar pairs side by side."""
    return D.find_duplicates(view(spark, sf, "people_dup"), "person_id", ROLES)["examples"]


# ---------------------------------------------------------------- comparison
_PAIRS = [("FamilyName", "last_name"), ("GivenName", "first_name"), ("EmailAddr", "email_address"), ("BirthDate", "date_of_birth"),
          ("CountryOfResidence", "nationality_code")]
_EMPTY = "('N/A', 'N.A.', '#N/A', 'NULL', '(NULL)', 'NONE', 'NIL', '-', '--', '---', '?', '.', 'UNKNOWN', 'UNK', 'TBD', 'TBA', 'MISSING')"


def _form(c: str) -> str:
    v = f"trim(CAST({c} AS VARCHAR))"
    if c in ("BirthDate", "date_of_birth"):
        form = f"CAST(CAST(coalesce(try_strptime({v}, '%Y-%m-%d'), try_strptime({v}, '%d/%m/%Y')) AS DATE) AS VARCHAR)"
    else:
        form = f"lower(regexp_replace({v}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN {c} IS NULL OR {v} = '' OR upper({v}) IN {_EMPTY} THEN NULL ELSE {form} END"


def _pair_sql(a: str, b: str) -> str:
    return f"""
        SELECT '{a}' AS left_column, '{b}' AS right_column, rows, equal_raw, equal_normalised, differ, only_left, only_right, neither,
               round(100.0 * equal_normalised / (equal_normalised + differ), 1) AS agree_pct,
               round(100.0 * (equal_normalised + differ + only_left) / rows, 1) AS left_filled_pct,
               round(100.0 * (equal_normalised + differ + only_right) / rows, 1) AS right_filled_pct
        FROM (SELECT count(*) AS rows, count(*) FILTER (WHERE CAST(rx AS VARCHAR) = CAST(ry AS VARCHAR)) AS equal_raw,
                     count(*) FILTER (WHERE x = y) AS equal_normalised, count(*) FILTER (WHERE x <> y) AS differ,
                     count(*) FILTER (WHERE x IS NOT NULL AND y IS NULL) AS only_left, count(*) FILTER (WHERE x IS NULL AND y IS NOT NULL) AS only_right,
                     count(*) FILTER (WHERE x IS NULL AND y IS NULL) AS neither
              FROM (SELECT {a} AS rx, {b} AS ry, {_form(a)} AS x, {_form(b)} AS y FROM crm_people c JOIN pms_people p ON c.guest_code = p.guest_code))"""


_DATES = ({"BirthDate"}, {"date_of_birth"})


def _sides(spark, sf):
    return view(spark, sf, "crm_people"), "guest_code", view(spark, sf, "pms_people"), "guest_code"


@query("attribute_agreement", with_views("crm_people", "pms_people") + union_sql([
    f"""SELECT '{a}' AS left_column, '{b}' AS right_column, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS both_filled,
        count(*) FILTER (WHERE x = y) AS agree FROM (SELECT {_form(a)} AS x, {_form(b)} AS y FROM crm_people c JOIN pms_people p ON c.guest_code = p.guest_code)"""
    for a in [p[0] for p in _PAIRS] for b in [p[1] for p in _PAIRS]]))
def attribute_agreement(spark, sf):
    return C.attribute_agreement(*_sides(spark, sf), *_DATES)


@query("pair_attributes", union_sql([f"SELECT '{a}' AS left_column, '{b}' AS right_column FROM customer HAVING count(*) > 0" for a, b in _PAIRS]))
def pair_attributes(spark, sf):
    agreement = stage(C.attribute_agreement(*_sides(spark, sf), *_DATES), "agreement")
    pairs = C.pair_attributes(*_sides(spark, sf), agreement)
    return spark.createDataFrame([(a, b) for a, b, _, _ in pairs], "left_column string, right_column string")


def _wide(side: str, n: int = 60) -> list[str]:
    mark = {"l": "x", "r": "X"}[side]
    return [f"CASE WHEN person_id % {i + 2} = 0 THEN NULL ELSE '{mark}{i}' || CAST(person_id % {5 * (i + 1)} AS STRING) END AS {side}{i}" for i in range(n)]


@query("attribute_agreement_wide", with_views("people").rstrip() + f""", l AS (SELECT person_id, {', '.join(_wide('l'))} FROM people), r AS (SELECT person_id, {', '.join(_wide('r'))} FROM people)
    """ + union_sql([f"""SELECT 'l{i}' AS left_column, 'r{i}' AS right_column, count(*) FILTER (WHERE l{i} IS NOT NULL AND r{i} IS NOT NULL) AS both_filled,
        count(*) FILTER (WHERE lower(l{i}) = lower(r{i})) AS agree FROM l JOIN r USING (person_id)""" for i in range(60)]))
def attribute_agreement_wide(spark, sf):
    """Sixty columns a side: each agrees with its partner on all rows that fill it."""
    people = view(spark, sf, "people")
    left, right = (people.selectExpr("person_id", *_wide(side)) for side in "lr")
    found = C.attribute_agreement(left, "person_id", right, "person_id")
    return found.where("substring(left_column, 2) = substring(right_column, 2)")


@query("compare_attributes", with_views("crm_people", "pms_people") + union_sql([_pair_sql(a, b) for a, b in _PAIRS]))
def compare_attributes(spark, sf):
    return C.compare_attributes(*_sides(spark, sf), _PAIRS, *_DATES)


@query("comparison_counts", with_views("crm_people", "pms_people") + """
    SELECT (SELECT count(*) FROM crm_people) AS left_rows, (SELECT count(*) FROM pms_people) AS right_rows, count(*) AS joined_rows,
           count(DISTINCT c.guest_code) AS joined_keys FROM crm_people c JOIN pms_people p ON c.guest_code = p.guest_code""")
def comparison_counts(spark, sf):
    return C.comparison_counts(*_sides(spark, sf))


@query("compare_tables")
def compare_tables(spark, sf):
    """Columns paired by agreement and name, compared, unpaired columns listed."""
    return C.compare_tables(*_sides(spark, sf), *_DATES)


@query("attribute_differences", with_views("crm_people", "pms_people") + f"""
    SELECT c.guest_code AS key, EmailAddr AS left_value, email_address AS right_value FROM crm_people c JOIN pms_people p ON c.guest_code = p.guest_code
    WHERE ({_form('EmailAddr')}) IS DISTINCT FROM ({_form('email_address')})""")
def attribute_differences(spark, sf):
    return C.attribute_differences(*_sides(spark, sf), "EmailAddr", "email_address")
