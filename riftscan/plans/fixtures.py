"""Views derived from the driver's tables, and diff texts and sources rendered from them.

The statements run unchanged in Spark and in DuckDB. No dollar-brace sequence
may be written in them (Spark substitutes it), so they use chr(36).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CODE_LINES = """SELECT concat('src/f', CAST(o_custkey AS STRING), '.js') AS file, CAST(o_orderkey AS INT) AS line,
 CASE o_orderkey % 16
  WHEN 0 THEN concat('const q = "SELECT * FROM orders WHERE id = " + v', CAST(o_custkey AS STRING), ';')
  WHEN 1 THEN concat('db.query(`SELECT ', chr(36), '{v', CAST(o_custkey AS STRING), '}`);')
  WHEN 2 THEN concat('db.execute(stmt', CAST(o_custkey AS STRING), ')')
  WHEN 3 THEN concat('exec(`rm ', chr(36), '{p', CAST(o_custkey AS STRING), '}`);')
  WHEN 4 THEN 'spawn("c", a, { shell: true });'
  WHEN 5 THEN concat('os.system(cmd', CAST(o_custkey AS STRING), ')')
  WHEN 6 THEN concat('eval(code', CAST(o_custkey AS STRING), ');')
  WHEN 7 THEN concat('new Function(body', CAST(o_custkey AS STRING), ')')
  WHEN 8 THEN concat('el.innerHTML = v', CAST(o_custkey AS STRING), ';')
  WHEN 9 THEN 'res.send(req.body)'
  WHEN 10 THEN 'x = pickle.loads(buf)'
  WHEN 11 THEN CASE WHEN o_custkey % 2 = 0 THEN 'yaml.load(f)' ELSE 'yaml.load(f, Loader=SafeLoader)' END
  WHEN 12 THEN '// eval(ignored)'
  WHEN 13 THEN concat('const awsKey = "AKIA', upper(substr(md5(CAST(o_orderkey AS STRING)), 1, 16)), '";')
  WHEN 14 THEN concat('const apiKey = "', md5(CAST(o_orderkey AS STRING)), '"; eval(k', CAST(o_custkey AS STRING), ');')
  ELSE concat('return a', CAST(o_custkey AS STRING), ';') END AS content FROM orders"""

BRANCH_RANGES = """SELECT DISTINCT concat('src/p', CAST(l_partkey AS STRING), '.js') AS file, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END AS branch,
 CAST(l_orderkey % 200 + 1 AS INT) AS start_line, CAST(l_quantity AS INT) % 8 AS line_count,
 CAST(l_orderkey % 200 + 1 + greatest(CAST(l_quantity AS INT) % 8 - 1, 0) AS INT) AS end_line,
 CASE WHEN CAST(l_quantity AS INT) % 8 = 0 THEN 'removed' WHEN l_returnflag = 'N' THEN 'added' ELSE 'modified' END AS change_type FROM lineitem"""

SIGNATURES = """SELECT r.ref AS ref, concat('src/p', CAST(p_partkey % 50 AS STRING), '.js') AS file, concat('fn', CAST(p_partkey AS STRING)) AS name,
 CASE WHEN r.ref = 'A' AND p_partkey % 7 = 0 THEN 'a,b,c' WHEN r.ref = 'B' AND p_partkey % 11 = 0 THEN 'b,a' ELSE 'a,b' END AS params
 FROM part CROSS JOIN (SELECT 'base' AS ref UNION ALL SELECT 'A' UNION ALL SELECT 'B') r WHERE NOT (r.ref = 'A' AND p_partkey % 13 = 0) AND NOT (r.ref = 'base' AND p_partkey % 17 = 0)"""

CALL_SITES = """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS ref, concat('src/p', CAST(o_custkey % 50 AS STRING), '.js') AS caller_file,
 concat('fn', CAST(o_orderkey % 200 AS STRING)) AS called_function, CAST(o_orderkey AS INT) AS line FROM orders"""

DEVICE_EVENTS = """SELECT user_id AS device_id, event_id, ts, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS success FROM events"""

COMMIT_EDGES = """SELECT CAST(p_partkey AS INT) AS child, CAST(floor(p_partkey / 2) AS INT) AS parent FROM part WHERE p_partkey > 1 UNION ALL SELECT CAST(p_partkey AS INT), CAST(p_partkey - 3 AS INT) FROM part WHERE p_partkey > 4 AND p_partkey % 5 = 0"""

# Files of both branches, with a status, and the paths in conflict.
FILES = """SELECT path, old_path, CASE WHEN k % 9 = 0 THEN 'deleted' WHEN k % 4 = 0 THEN 'added' ELSE 'modified' END AS status, k % 31 = 0 AS is_binary, side FROM (
 SELECT concat('src/p', CAST(p_partkey AS STRING), '.js') AS path, CAST(NULL AS STRING) AS old_path, CAST(p_partkey AS INT) AS k, s.side AS side FROM part CROSS JOIN (SELECT 'A' AS side UNION ALL SELECT 'B') s WHERE NOT (s.side = 'A' AND p_partkey % 6 = 0) AND NOT (s.side = 'B' AND p_partkey % 10 = 0)) x"""

CONFLICTS = """SELECT concat('src/p', CAST(p_partkey AS STRING), '.js') AS file FROM part WHERE p_partkey % 25 = 0"""

# One hunk for each code line: added, modified, removed with context, or purely deleted lines.
HUNKS = """SELECT file, line, CASE line % 4
  WHEN 0 THEN concat('@@ -', CAST(line AS STRING), ',0 +', CAST(line AS STRING), ' @@', chr(10), '+', content)
  WHEN 1 THEN concat('@@ -', CAST(line AS STRING), ',2 +', CAST(line AS STRING), ',2 @@ fn', chr(10), ' kept', chr(10), '-old', chr(10), '+', content)
  WHEN 2 THEN concat('@@ -', CAST(line AS STRING), ',2 +', CAST(line AS STRING), ',1 @@', chr(10), ' kept', chr(10), '-', content)
  ELSE concat('@@ -', CAST(line AS STRING), ' +', CAST(line - 1 AS STRING), ',0 @@', chr(10), '-', content) END AS hunk FROM code_lines"""

STATUS_LINES = """SELECT CAST(p_partkey % 20 AS STRING) AS diff_id, CAST(p_partkey AS INT) AS pos, CASE p_partkey % 7 WHEN 0 THEN concat('A', chr(9), p_name) WHEN 1 THEN concat('m', chr(9), p_name) WHEN 2 THEN concat('D', chr(9), p_name)
 WHEN 3 THEN concat('R90', chr(9), 'old/', p_name, chr(9), 'new/', p_name) WHEN 4 THEN concat('C75', chr(9), p_name) WHEN 5 THEN 'X' ELSE concat('T', chr(9), p_name) END AS text FROM part"""

MERGE_LINES = """SELECT CAST(p_partkey % 20 AS STRING) AS diff_id, CAST(p_partkey AS INT) AS pos, CASE p_partkey % 6 WHEN 0 THEN concat(md5(p_name), '01234567') WHEN 1 THEN concat('  src/', CAST(p_partkey % 60 AS STRING), '.js ', chr(13)) WHEN 2 THEN concat('fatal: ', p_name)
 WHEN 3 THEN '' WHEN 4 THEN concat('Auto-merging ', CAST(p_partkey % 60 AS STRING)) ELSE concat('x failed with exit code ', p_name) END AS text FROM part"""

# Values in each provider's format and next to them those that are none; every kind's values follow from the key.
SECRET_LINES = """SELECT CASE WHEN k % 28 IN (7, 20, 21) THEN concat('app', CAST(k % 9 AS STRING), '/.env') ELSE concat('src/s', CAST(k % 40 AS STRING), '.js') END AS file, k AS line, h, g, CAST(k % 28 AS INT) AS kind,
 CASE k % 28
  WHEN 0 THEN concat('const id = "AKIA', upper(substr(h, 1, 16)), '";')
  WHEN 1 THEN concat('aws_secret_access_key = "', h, substr(g, 1, 8), '"')
  WHEN 2 THEN '-----BEGIN RSA PRIVATE KEY-----'
  WHEN 3 THEN concat('token = "ghp_', h, substr(g, 1, 6), '"')
  WHEN 4 THEN concat('url = "postgres://admin:', substr(h, 1, 12), '@db.local:5432/x"')
  WHEN 5 THEN concat('slack("xoxb-', substr(h, 1, 12), '-', substr(g, 1, 20), '")')
  WHEN 6 THEN concat('jwt eyJ', h, '.', g, '.', h)
  WHEN 7 THEN concat('DB_PASSWORD=', h)
  WHEN 8 THEN concat('password: "', h, '"')
  WHEN 9 THEN concat('call("', h, upper(g), '")')
  WHEN 10 THEN 'api_key = "your-api-key-goes-here"; secret = "CHANGE_ME_CHANGE_ME"'
  WHEN 11 THEN concat('token = process.env.T_', upper(h))
  WHEN 12 THEN concat('token = process.env["', upper(h), '"]')
  WHEN 13 THEN 'secret = "aaaaaaaaaaaaaaaaaaaa"'
  WHEN 14 THEN concat('password = "', substr(h, 1, 10), '"')
  WHEN 15 THEN concat('url = "postgres://u:', chr(36), '{DB_PASS}@db.local/x"')
  WHEN 16 THEN concat('key = "sk-', h, upper(g), '"')
  WHEN 17 THEN concat('a("AKIA', upper(substr(h, 1, 16)), '"); token = "', h, '"')
  WHEN 18 THEN concat('k = "-----BEGIN PRIVATE KEY-----', chr(92), 'n', h, '/', g, '"')
  WHEN 19 THEN concat('url = "postgres://admin:p@', h, '@', g, '@db.local:5432/x"')
  WHEN 20 THEN concat('DB_PASSWORD="', h, ' ', g, ' # ', h, '"')
  WHEN 21 THEN concat('export API_TOKEN=', h, '#', g, ' ', h)
  WHEN 22 THEN concat('a("AKIA', upper(substr(h, 1, 16)), '"); token = "', h, '!', g, ' it''s @ ', chr(92), '"', h, '";')
  WHEN 23 THEN concat('aws_secret_access_key = ', h, substr(g, 1, 8))
  WHEN 24 THEN concat('const apiKey = `', h, '`;')
  WHEN 25 THEN concat('url = "mysql://root:', h, ' ''', g, ''' #@', g, '@db.local/x"')
  WHEN 26 THEN concat('a("AKIA', upper(substr(h, 1, 16)), '", { "password": ''', substr(h, 1, 8), ' "', g, '" ', h, ''' })')
  ELSE concat('b("redis://localhost:6379/", "me@', h, '.org"); pwd = ', g) END AS content
 FROM (SELECT CAST(o_orderkey AS INT) AS k, md5(CAST(o_orderkey AS STRING)) AS h, md5(concat('g', CAST(o_orderkey AS STRING))) AS g FROM orders) x"""

# Calls of what the look-ahead rules watch, with literals and with values.
LITERAL_LINES = """SELECT concat('src/l', CAST(o_custkey % 40 AS STRING), '.js') AS file, CAST(o_orderkey AS INT) AS line, CAST(o_orderkey % 16 AS INT) AS kind,
 CASE o_orderkey % 16
  WHEN 0 THEN 'eval("1 + 1")'
  WHEN 1 THEN 'eval(''x'')'
  WHEN 2 THEN 'eval(`x`)'
  WHEN 3 THEN concat('eval(code', CAST(o_custkey AS STRING), ')')
  WHEN 4 THEN concat('eval("a" + code', CAST(o_custkey AS STRING), ')')
  WHEN 5 THEN concat('evaluate(code', CAST(o_custkey AS STRING), ')')
  WHEN 6 THEN concat('EVAL(code', CAST(o_custkey AS STRING), ')')
  WHEN 7 THEN 'new Function("return 1")'
  WHEN 8 THEN concat('new Function(body', CAST(o_custkey AS STRING), ')')
  WHEN 9 THEN concat('new Function("a", "return " + b', CAST(o_custkey AS STRING), ')')
  WHEN 10 THEN 'el.innerHTML = "<b>x</b>";'
  WHEN 11 THEN 'el.innerHTML = '''''
  WHEN 12 THEN concat('el.innerHTML = v', CAST(o_custkey AS STRING), ';')
  WHEN 13 THEN concat('el.innerHTML = DOMPurify.sanitize(v', CAST(o_custkey AS STRING), ');')
  WHEN 14 THEN concat('el.innerHTML = "<b>" + v', CAST(o_custkey AS STRING), ';')
  ELSE concat('db.query(`SELECT a FROM t WHERE id = ', chr(36), '1`, [v', CAST(o_custkey AS STRING), '])') END AS content FROM orders"""

VIEWS = {
    "secret_lines": SECRET_LINES,
    "literal_lines": LITERAL_LINES,
    "code_lines": CODE_LINES,
    "branch_ranges": BRANCH_RANGES,
    "signatures": SIGNATURES,
    "call_sites": CALL_SITES,
    "device_events": DEVICE_EVENTS,
    "commit_edges": COMMIT_EDGES,
    "branch_files": FILES,
    "conflicts": CONFLICTS,
    "hunks": HUNKS,
    "status_lines": STATUS_LINES,
    "merge_lines": MERGE_LINES,
}
NEEDS = {"hunks": ("code_lines",)}
TABLES = ("orders", "lineitem", "part", "events", "documents", "region", "nation", "customer", "supplier")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame, with no temporary view left behind."""
    code = re.split(r"('(?:[^']|'')*')", VIEWS[name])  # statement parts and, in between, literals
    used = set(re.findall(r"\b(?:FROM|JOIN) (\w+)", " ".join(code[::2])))
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in used}
    frames |= {n: view(spark, sf_dir, n) for n in NEEDS.get(name, ())}
    for k, part in enumerate(code):
        part = part.replace("{", "{{").replace("}", "}}")
        for t in frames if k % 2 == 0 else ():  # names become parameters of the statement
            part = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", part)
        code[k] = part
    return spark.sql("".join(code), **frames)


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """A DuckDB statement over derived views."""
    order: list[str] = []
    for n in names:
        order += [m for m in (*NEEDS.get(n, ()), n) if m not in order]
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + ("," if body.lstrip().startswith(",") else "") + "\n" + body.lstrip().removeprefix(",")
