"""Extraction, rule scans, log triage and name resolution over files that stand for the rows of ``orders``.

Every order gives a script, a template and a log, every part a Fortran source; their texts are one SQL expression for Spark
and for the SQL that the results are compared with, so that these tables grow with the given ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import extract as X
from lodestone.operators import joins as J
from lodestone.operators import predicates as P
from lodestone.operators import rules as V
from lodestone.plans.stages import dealt, table

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _text(*lines: str) -> str:
    """SQL for lines joined by line feeds; null lines are left out."""
    return "concat_ws(chr(10), " + ", ".join(lines) + ")"


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


K, C = _s("o_orderkey"), _s("o_custkey")
#: Scripts of orders: path and content.
SCRIPT_PATH = f"CASE WHEN o_orderkey % 3 = 0 THEN 'jobs/' || CASE WHEN o_orderkey % 2 = 0 THEN 'J' ELSE 'run' END || 'GFS_' || {K} WHEN o_orderkey % 3 = 1 THEN 'scripts/' || CASE WHEN o_orderkey % 2 = 0 THEN 'ex' ELSE 'go' END || 'gfs_' || {K} || '.sh' ELSE 'ush/tool_' || {K} || '.sh' END"
SCRIPT = _text(
    "CASE o_orderkey % 5 WHEN 0 THEN '#!/bin/bash' WHEN 1 THEN '# a note' WHEN 2 THEN '#!/usr/bin/perl' ELSE '#! /usr/bin/env bash' END",
    "CASE WHEN o_orderkey % 5 = 1 THEN '#!/bin/sh' END",
    "CASE WHEN o_orderkey % 4 <> 0 THEN 'set -x' END",
    f"'source $USHgfs/lib_' || {_s('o_custkey % 7')} || '.sh'",
    "CASE WHEN o_orderkey % 6 = 0 THEN '# source no.sh' END",
    f"'export RUN=\"' || o_orderpriority || '\"'",
    f"'export PDY=${{PDY:-' || {K} || '}}'",
    f"'LOCAL_' || {_s('o_custkey % 11')} || '=$DATA/x'",
    f"'$USHgfs/run_' || {_s('o_orderkey % 13')} || '.sh arg'",
    f"'cp $COMIN_' || o_orderstatus || '/in $COMOUT/Out' || {C} || '.txt'",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'export err=$?' END",
    f"'$EXECgfs/prog' || {_s('o_custkey % 9')} || '.x'",
    f"'python3 $USHgfs/tool_' || {_s('o_orderkey % 17')} || '.py'",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'err_chk' END",
    "CASE WHEN o_orderkey % 7 = 0 THEN 'exit 2' END",
    "CASE WHEN o_orderkey % 7 = 1 THEN 'echo \"error in run\"' ELSE 'echo \"end of run\"' END",
    "CASE WHEN o_orderkey % 8 = 0 THEN 'module load prod_util' END",
    "CASE WHEN o_orderkey % 9 = 0 THEN 'SENDCOM=${SENDCOM:-YES}' WHEN o_orderkey % 9 = 1 THEN 'if [ $SENDCOM = YES ]; then' END",
    f"'helper_' || {_s('o_orderkey % 5')} || '() {{'",
    "'}'",
)
#: Templates of orders.
TEMPLATE = _text(
    f"'name: {{{{ pslot | upper }}}} {{{{ app_' || {_s('o_custkey % 5')} || ' }}}}'",
    "CASE WHEN o_orderkey % 2 = 0 THEN '{% if do_' || lower(o_orderstatus) || ' %}' END",
    f"'{{% for m in members_' || {_s('o_orderkey % 4')} || ' %}}'",
    "'export HOMEgfs=/x'",
    f"'import pkg_' || {_s('o_custkey % 6')}",
    "'from os.path import join'",
    "'cmake $' || '{CMAKE_DIR}'",  # Spark replaces names in braces after a dollar sign
)
#: Build files of orders.
BUILD = _text(
    f"'add_executable(prog' || {_s('o_custkey % 9')} || ' a.f90 b_' || {_s('o_orderkey % 3')} || '.f90)'",
    f"'# target_link_libraries(no x)'",
    f"'target_link_libraries(prog' || {_s('o_custkey % 9')} || ' PRIVATE lib' || lower(o_orderstatus) || ')'",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'find_package(NetCDF REQUIRED)' ELSE 'find_package(Zlib)' END",
)
#: Logs of orders.
LOG = _text(
    "'export A_B=1'",
    "'Currently Loaded Modules:'",
    "'  1) prod'",
    "''",
    f"'step ' || {K} || ' begins'",
    "CASE o_orderkey % 7 WHEN 0 THEN 'slurmstepd: out of memory' WHEN 1 THEN 'job timed out' WHEN 2 THEN 'Segmentation fault' WHEN 3 THEN 'cat: No such file or directory' WHEN 4 THEN 'No space left on device' WHEN 5 THEN 'Permission denied' END",
    f"CASE WHEN o_orderkey % 3 = 0 THEN repeat('x', 9000) || chr(10) || 'after it' END",
    f"'exited with code ' || {_s('o_custkey % 3')}",
)
#: Fortran sources of parts.
FORTRAN = _text(
    f"'module part_' || {_s('p_partkey')}",
    f"'  use netcdf_' || {_s('p_size % 5')}",
    f"'  use, intrinsic :: iso_c_binding'",
    f"'contains'",
    f"'subroutine Run_' || {_s('p_partkey')} || '(a, &'",
    "'    & b) ! a note'",
    f"'  call init_' || {_s('p_size % 7')} || '(a)'",
    f"'  if (a > 0) call done(a)'",
    f"'end subroutine'",
    f"'end module'",
)


def files(spark, d, content=SCRIPT, path=SCRIPT_PATH, source="orders"):
    return table(spark, d, source).select(F.expr(path).alias("path"), F.expr(content).alias("content"))


def files_sql(content=SCRIPT, path=SCRIPT_PATH, source="orders") -> str:
    return f"f AS (SELECT {path} AS path, {content} AS content FROM {source})"


LINES = "l AS (SELECT path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n, unnest(string_split(content, chr(10))) AS line FROM f)"
ORDER_PATH, PART_PATH = f"'t/' || {K} || '.j2'", f"'src/' || {_s('p_partkey')} || '.f90'"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _every(kind: str, pattern: str, rows: str = "l", value: str = "CAST(NULL AS VARCHAR)") -> str:
    """SQL for every match of a pattern's first group in lines."""
    return f"SELECT path, '{kind}' AS kind, name, {value} AS value, n FROM (SELECT path, n, line, unnest(regexp_extract_all(line, {_q(pattern)}, 1)) AS name FROM {rows}) u WHERE name <> ''"


BUILTIN = ", ".join(map(_q, X.BUILTIN))
CODE = "c AS (SELECT * FROM l WHERE NOT regexp_matches(line, '^\\s*#'))"


@query("x01_shell_facts", f"""WITH {files_sql()}, {LINES}, {CODE}, a AS (
    {_every('source', r'^\s*(?:source|\.)\s+([^\s;#]+)', 'c')} UNION ALL {_every('invoke', r'(\$\{?\w+\}?/[\w./-]+\.(?:sh|py|ksh))', 'c')}
    UNION ALL {_every('export', r'^\s*export\s+(\w+)=', 'c', "left(regexp_extract(line, '^\\s*export\\s+\\w+=(.*)$', 1), 200)")}
    UNION ALL {_every('function', r'^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{?')}
    UNION ALL SELECT * FROM ({_every('env', r'\$\{?([A-Z][A-Z0-9_]+)')}) e WHERE name NOT IN ({BUILTIN}))
    SELECT path, kind, name, min_by(value, n) AS value, min(n) AS n FROM a GROUP BY 1, 2, 3""")
def x01(spark, d):
    return X.shell_facts(files(spark, d))


@query("x02_env_edges", f"""WITH {files_sql()}, {LINES}, {CODE}, a AS (SELECT path, name, kind, 1 AS p FROM ({_every('EXPORTS', r'^\s*export\s+(\w{2,})', 'c')}) x
    UNION ALL SELECT path, name, kind, 2 FROM ({_every('SETS', r'^\s*([A-Za-z_]\w+)=', 'c')}) x UNION ALL SELECT path, name, kind, 3 FROM ({_every('DEPENDS_ON_ENV', r'\$\{?([A-Za-z_]\w+)', 'c')}) x)
    SELECT path, name, min_by(kind, p) AS rel FROM a WHERE name NOT IN ({BUILTIN}) GROUP BY 1, 2""")
def x02(spark, d):
    return X.env_edges(files(spark, d))


@query("x03_fortran_facts", f"""WITH p AS (SELECT {PART_PATH} AS path, p_partkey AS k, p_size AS s FROM part), m AS (SELECT path, 'part_' || k AS m, 'run_' || k AS r, s FROM p)
    SELECT path, 'module' AS kind, m AS name, CAST(NULL AS VARCHAR) AS parent, 1 AS n FROM m UNION ALL SELECT path, 'use', 'netcdf_' || (s % 5), m, 2 FROM m UNION ALL SELECT path, 'use', 'iso_c_binding', m, 3 FROM m
    UNION ALL SELECT path, 'subroutine', r, m, 5 FROM m UNION ALL SELECT path, 'call', 'init_' || (s % 7), r, 7 FROM m UNION ALL SELECT path, 'call', 'done', r, 8 FROM m""")
def x03(spark, d):
    return X.fortran_facts(files(spark, d, FORTRAN, PART_PATH, "part"))


@query("x05_config_vars", f"""WITH {files_sql()}, {LINES}, v AS (SELECT path, n, regexp_matches(line, '^\\s*export\\s+(\\w+)="?\\$\\{{\\w+:-([^}}]*)\\}}"?') AS is_default, line,
      coalesce(nullif(regexp_extract(line, '^\\s*export\\s+(\\w+)=', 1), ''), nullif(regexp_extract(line, '^\\s*(\\w+)=', 1), '')) AS name FROM l),
    w AS (SELECT *, CASE WHEN is_default THEN regexp_extract(line, ':-([^}}]*)\\}}', 1) ELSE regexp_extract(line, '^\\s*(?:export\\s+)?\\w+=(.*)$', 1) END AS raw, row_number() OVER (PARTITION BY path, name ORDER BY n) AS k FROM v WHERE name IS NOT NULL)
    SELECT path, n, name, regexp_replace(raw, '^["'']|["'']$', '', 'g') AS value, is_default FROM w WHERE k = 1""")
def x05(spark, d):
    return X.config_vars(files(spark, d))


@query("x08_job_script_facts", f"""WITH {files_sql()}, {LINES}, {CODE}, a AS ({_every('input', r'\$\{?(COMIN\w*)', 'c')} UNION ALL {_every('output', r'\$\{?(COMOUT\w*)', 'c')} UNION ALL {_every('call', r'(\$\{?\w+\}?/[\w./-]+\.(?:sh|py))', 'c')}
    UNION ALL {_every('source', r'^\s*(?:source|\.)\s+([^\s;#]+)', 'c')} UNION ALL {_every('module', r'^\s*module\s+load\s+(\S+)', 'c')}) SELECT path, kind, name, min(n) AS n FROM a GROUP BY 1, 2, 3""")
def x08(spark, d):
    return X.job_script_facts(files(spark, d))


@query("x09_template_facts", f"""WITH o AS (SELECT {ORDER_PATH} AS path, * FROM orders) SELECT path, 'variable' AS kind, 'pslot' AS name FROM o UNION ALL SELECT path, 'variable', 'app_' || (o_custkey % 5) FROM o UNION ALL SELECT path, 'filter', 'upper' FROM o
    UNION ALL SELECT path, 'condition', 'do_' || lower(o_orderstatus) FROM o WHERE o_orderkey % 2 = 0 UNION ALL SELECT path, 'loop', 'members_' || (o_orderkey % 4) FROM o UNION ALL SELECT path, 'export', 'HOMEgfs' FROM o""")
def x09(spark, d):
    return X.template_facts(files(spark, d, TEMPLATE, ORDER_PATH))


@query("x10_build_edges", f"""WITH o AS (SELECT {ORDER_PATH} AS path, 'prog' || (o_custkey % 9) AS p, * FROM orders) SELECT path, 'source' AS kind, p AS name, 'a.f90' AS target FROM o UNION ALL SELECT path, 'source', p, 'b_' || (o_orderkey % 3) || '.f90' FROM o
    UNION ALL SELECT path, 'link', p, 'lib' || lower(o_orderstatus) FROM o UNION ALL SELECT path, 'package', CASE WHEN o_orderkey % 2 = 0 THEN 'netcdf' ELSE 'zlib' END, CASE WHEN o_orderkey % 2 = 0 THEN 'required' ELSE 'optional' END FROM o""")
def x10(spark, d):
    return X.build_edges(files(spark, d, BUILD, ORDER_PATH))


VERSION_PATH = f"CASE o_orderkey % 3 WHEN 0 THEN 'versions/build.hera' WHEN 1 THEN 'versions/spack.ver' ELSE 'versions/x' END || '/' || {K} || CASE o_orderkey % 3 WHEN 0 THEN '/run.wcoss' WHEN 1 THEN '/spack_' || {K} ELSE '/other' END"
VERSIONS = _text(f"'export netcdf_ver=4.' || {_s('o_custkey % 10')}", f"'export other_ver=1'", f"'export Zlib_ver=\"1.2-' || {_s('o_orderkey % 5')} || '\"'")


@query("x11_version_edges", f"""WITH o AS (SELECT {VERSION_PATH} AS path, CASE o_orderkey % 3 WHEN 0 THEN 'wcoss' WHEN 1 THEN 'spack' ELSE 'default' END AS platform, * FROM orders)
    SELECT path, platform, 'netcdf' AS library, '4.' || (o_custkey % 10) AS version FROM o UNION ALL SELECT path, platform, 'zlib', '1.2-' || (o_orderkey % 5) FROM o""")
def x11(spark, d):
    return X.version_edges(files(spark, d, VERSIONS, VERSION_PATH), ["netcdf", "zlib"])


COMMIT = f"CASE WHEN o_orderkey % 10 = 3 THEN 'broken|line' ELSE md5({K}) || '|Name ' || {C} || '|Some.' || {C} || '@Example.org|' || CASE WHEN o_orderkey % 10 = 4 THEN 'soon' ELSE {_s('o_orderkey * 100')} END || '|fix ' || o_orderstatus || ' | more' END"


@query("x12_commit_rows", """SELECT md5(CAST(o_orderkey AS VARCHAR)) AS hash, 'Name ' || o_custkey AS name, 'some.' || o_custkey || '@example.org' AS email, CASE WHEN o_orderkey % 10 <> 4 THEN o_orderkey * 100 END AS ts, 'fix ' || o_orderstatus || ' | more' AS message FROM orders WHERE o_orderkey % 10 <> 3""")
def x12(spark, d):
    return X.commit_rows(table(spark, d, "orders").select(F.expr(COMMIT).alias("line"))).withColumn("ts", F.unix_timestamp("ts"))


COMPONENTS = _text(f"'[submodule \"sorc/m' || {C} || '\"]'", f"'  path = sorc/m' || {C}", f"'  url = https://example.org/' || o_orderstatus", "CASE WHEN o_orderkey % 2 = 0 THEN '[submodule \"two\"]' END", "CASE WHEN o_orderkey % 2 = 0 THEN ' path = second' END")


@query("x13_component_edges", f"""WITH o AS (SELECT {ORDER_PATH} AS path, * FROM orders) SELECT path, 'sorc/m' || o_custkey AS component, 'sorc/m' || o_custkey AS sub_path, 'https://example.org/' || o_orderstatus AS url FROM o
    UNION ALL SELECT path, 'two', 'second', NULL FROM o WHERE o_orderkey % 2 = 0""")
def x13(spark, d):
    return X.component_edges(files(spark, d, COMPONENTS, ORDER_PATH))


@query("x14_execute_refs", f"SELECT DISTINCT {SCRIPT_PATH} AS path, 'prog' || (o_custkey % 9) AS ref FROM orders")
def x14(spark, d):
    return X.execute_refs(files(spark, d))


@query("x15_invoke_edges", f"WITH m AS (SELECT DISTINCT 'lib/Tool_' || p_size || '.py' AS module, p_size AS s FROM part) SELECT {SCRIPT_PATH} AS path, module FROM orders JOIN m ON o_orderkey % 17 = s")
def x15(spark, d):
    modules = table(spark, d, "part").select(F.concat(F.lit("lib/Tool_"), "p_size", F.lit(".py")).alias("path")).distinct()
    return X.invoke_edges(files(spark, d), modules)


@query("x16_doc_mentions", f"""WITH {files_sql()}, m AS (SELECT path AS id, unnest(list_distinct(regexp_extract_all(content, '([\\w/.-]+\\.(?:py|sh|f90|F90|js|xml|yaml))\\b', 1))) AS mention, 'file' AS kind FROM f
    UNION ALL SELECT path, unnest(list_distinct(regexp_extract_all(content, '\\b(\\w+)\\(\\)', 1))), 'function' FROM f UNION ALL SELECT path, unnest(list_distinct(regexp_extract_all(content, '\\b(J[A-Z][A-Z0-9_]{{3,}})\\b', 1))), 'job' FROM f UNION ALL SELECT path, unnest(list_distinct(regexp_extract_all(content, '(?:scripts|ush|jobs)/([A-Za-z_]\\w*)', 1))), 'script' FROM f)
    SELECT id, mention, kind, CAST(0.8 AS DOUBLE) AS confidence FROM m""")
def x16(spark, d):
    return X.doc_mentions(files(spark, d).select(F.col("path").alias("id"), F.col("content").alias("text")))


@query("x16_doc_links", f"""WITH m AS (SELECT DISTINCT 'lib/tool_' || p_size || '.py' AS module, p_size AS s FROM part), r AS (SELECT DISTINCT 'ush/run_' || p_size || '.sh' AS module, p_size AS s FROM part)
    SELECT DISTINCT {SCRIPT_PATH} AS src, module AS dst, 'DOC_DESCRIBES' AS rel, CAST(0.8 AS DOUBLE) AS confidence FROM orders JOIN m ON o_orderkey % 17 = s UNION SELECT {SCRIPT_PATH}, module, 'DOC_DESCRIBES', 0.8 FROM orders JOIN r ON o_orderkey % 13 = s""")
def x16_links(spark, d):
    p = table(spark, d, "part").select(F.explode(F.array(F.concat(F.lit("lib/tool_"), "p_size", F.lit(".py")), F.concat(F.lit("ush/run_"), "p_size", F.lit(".sh")))).alias("path")).distinct()
    nodes = p.select(F.col("path").alias("node_id"), F.lit("File").alias("label"), F.col("path").alias("name"), "path")
    return X.doc_links(files(spark, d).select(F.col("path").alias("id"), F.col("content").alias("text")), nodes)


@query("x17_library_uses", f"SELECT {PART_PATH} AS path, 'netcdf' AS library FROM part WHERE p_size % 5 IN (1, 2) UNION ALL SELECT {PART_PATH}, 'iso' FROM part")
def x17(spark, d):
    return X.library_uses(X.fortran_facts(files(spark, d, FORTRAN, PART_PATH, "part")), {"netcdf": "^netcdf_[12]$", "iso": "^iso"})


@query("x20_extraction_stats", "SELECT lang AS language, count(DISTINCT doc_id) FILTER (n_chars % 3 <> 0) AS parsed, count(DISTINCT doc_id) FILTER (n_chars % 3 = 0) AS failed FROM documents GROUP BY 1")
def x20(spark, d):
    x = table(spark, d, "documents")
    return X.extraction_stats(x.select(F.col("lang").alias("language"), F.col("doc_id").alias("path"), F.when(F.col("n_chars") % 3 == 0, "bad").alias("error")))


@query("x21_dependency_tokens", f"WITH t AS (SELECT {ORDER_PATH} AS path, ['pkg_' || (o_custkey % 6), 'os.path', 'CMAKE_DIR'] AS tokens FROM orders) SELECT path, array_to_string(tokens, ',') AS tokens FROM t")
def x21(spark, d):
    return X.dependency_tokens(files(spark, d, TEMPLATE, ORDER_PATH)).withColumn("tokens", F.array_join("tokens", ","))


# -- rule scans


def _rules(*rules: tuple[str, str, str]) -> str:
    return f"WITH {files_sql()} " + " UNION ALL ".join(f"SELECT path, '{c}' AS category, {m} AS message FROM f WHERE {t}" for c, t, m in rules)


L1, L2, L3 = ("split_part(content, chr(10), %d)" % i for i in (1, 2, 3))
BASE = "split_part(path, '/', 2)"


@query("v01_error_handling", _rules(
    ("shebang_position", f"NOT starts_with({L1}, '#!') AND (starts_with({L2}, '#!') OR starts_with({L3}, '#!'))", "'shebang is not on the first line'"),
    ("missing_set_x", "o_set AND NOT contains(content, 'err_chk')".replace("o_set", "NOT contains(content, 'set -x')"), "'no set -x and no error utility'"),
    ("error_prefix", "contains(content, 'echo \"error in run\"')", "'echo \"error in run\"'"),
))
def v01(spark, d):
    return V.scan_error_handling(files(spark, d))


@query("v02_naming", _rules(
    ("job_prefix", f"starts_with(path, 'jobs/') AND NOT starts_with({BASE}, 'J')", f"'job name does not begin with J: ' || {BASE}"),
    ("script_prefix", f"starts_with(path, 'scripts/') AND NOT starts_with({BASE}, 'ex')", f"'script name does not begin with ex: ' || {BASE}"),
    ("upper_case_output", "regexp_extract(content, '>\\s*\"?\\$\\{?COMOUT\\w*\\}?/([\\w.]*[A-Z][\\w.]*)', 1) <> ''", "''"),
))
def v02(spark, d):
    return V.scan_naming(files(spark, d))


@query("v03_shebang", _rules(
    ("misplaced_shebang", f"NOT starts_with({L1}, '#!')", "'shebang is not on the first line'"),
    ("non_standard_shebang", f"{L1} = '#!/usr/bin/perl'", L1),
    ("missing_timing", f"starts_with({BASE}, 'J')", "'no timing export'"),
))
def v03(spark, d):
    return V.scan_shebang(files(spark, d))


@query("v04_utilities", _rules(
    ("explicit_exit", "contains(content, 'exit 2') AND NOT contains(content, 'err_chk')", "'exit without error utility'"),
    ("missing_debug", "NOT contains(content, 'set -x')", "'no debug logging'"),
    ("missing_status", "NOT contains(content, 'end of run')", "'no status message'"),
    ("sendcom_default", "contains(content, '$SENDCOM')", "'SENDCOM has no default'"),
))
def v04(spark, d):
    return V.scan_utilities(files(spark, d))


@query("v05_file_type", f"SELECT path, CASE WHEN regexp_matches({BASE}, '^J[A-Z]') THEN 'job' WHEN regexp_matches({BASE}, '^ex\\w+\\.(sh|py)$') THEN 'exscript' WHEN {BASE} LIKE '%.sh' THEN 'shell' ELSE 'other' END AS kind FROM (SELECT {SCRIPT_PATH} AS path FROM orders) f")
def v05(spark, d):
    return files(spark, d).select("path", V.file_type(F.col("path")).alias("kind"))


@query("v06_shell_counts", f"""WITH {files_sql()}, {LINES}, x AS (SELECT *, lead(line) OVER (PARTITION BY path ORDER BY n) AS nxt FROM l) SELECT path, CAST(sum(len(regexp_extract_all(line, '\\$\\{{?\\w+'))) AS BIGINT) AS variables, CAST(sum(len(regexp_extract_all(line, '"\\$\\{{?\\w+\\}}?'))) AS BIGINT) AS quoted,
    count(*) FILTER (starts_with(line, 'cp ') AND NOT coalesce(contains(nxt, '$?'), false)) AS unchecked FROM x GROUP BY 1""")
def v06(spark, d):
    return V.shell_counts(files(spark, d))


@query("v07_snippets", f"""WITH {files_sql()}, {LINES}, h AS (SELECT path, n AS hit FROM l WHERE regexp_matches(line, '\\bexit\\s+\\d+') OR regexp_matches(line, '"error')), x AS (SELECT h.path, hit, l.n, line FROM h JOIN l ON h.path = l.path AND l.n BETWEEN hit - 3 AND hit + 3)
    SELECT path, hit AS n, string_agg(line, chr(10) ORDER BY n) AS snippet FROM x GROUP BY path, hit""")
def v07(spark, d):
    return V.snippets(files(spark, d), [r"\bexit\s+\d+", '"error'])


@query("v08_shebang_block", f"WITH {files_sql()} SELECT path, CASE WHEN starts_with({L1}, '#!') THEN {L1} END AS shebang, CAST(coalesce(list_position(string_split(content, chr(10)), 'set -x'), 0) AS INT) AS set_x_line FROM f")
def v08(spark, d):
    return V.shebang_block(files(spark, d))


LOGS_SQL = f"g AS (SELECT o_orderkey AS id, {LOG} AS text FROM orders)"


def logs(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(LOG).alias("text"))


@query("v09_denoise", f"WITH {LOGS_SQL}, l AS (SELECT id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, unnest(string_split(text, chr(10))) AS line FROM g) SELECT id, n, line FROM l WHERE n > 3")
def v09(spark, d):
    return V.denoise_logs(logs(spark, d))


@query("v10_log_signal", f"""WITH {LOGS_SQL}, s AS (SELECT id, text, strlen(text) AS n, CASE WHEN strlen(text) > 8192 THEN right(text, 8192) ELSE text END AS signal FROM g)
    SELECT id, md5(signal) AS digest, CAST(n - strlen(signal) AS INT) AS omitted_bytes, CAST(regexp_extract(text, 'exited with code (\\d)', 1) AS INT) AS exit_code FROM s""")
def v10(spark, d):
    return V.log_signal(logs(spark, d)).select("id", F.md5("signal").alias("digest"), F.col("omitted_bytes").cast("int").alias("omitted_bytes"), "exit_code")


@query("v11_classify_log", "SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'out_of_memory' WHEN 1 THEN 'timeout' WHEN 2 THEN 'segfault' WHEN 3 THEN 'missing_file' WHEN 4 THEN 'disk_full' WHEN 5 THEN 'permission' ELSE 'unknown' END AS failure FROM orders")
def v11(spark, d):
    return V.classify_log(logs(spark, d))


ITEMS = _text(f"'- first ' || {K}", "'plain'", f"'2. second ' || o_orderstatus", "'Ensure that it runs'", "'  * third'")


@query("v12_checklist_report", "WITH o AS (SELECT o_orderpriority AS category, o_orderkey AS id, o_orderstatus AS s FROM orders) SELECT category, id, 'first ' || id AS item FROM o UNION ALL SELECT category, id, 'second ' || s FROM o UNION ALL SELECT category, id, 'Ensure that it runs' FROM o")
def v12(spark, d):
    x = table(spark, d, "orders")
    return V.checklist_report(x.select(F.col("o_orderpriority").alias("query_id"), F.col("o_orderkey").alias("id")), x.select(F.col("o_orderkey").alias("id"), F.expr(ITEMS).alias("text")), 3)


# -- names and paths


@query("p07_normalise_entity", f"SELECT path, regexp_replace({BASE}, '\\.(py|sh)$', '') AS name FROM (SELECT {SCRIPT_PATH} AS path FROM orders) f")
def p07(spark, d):
    return files(spark, d).select("path", P.normalise_entity(F.element_at(F.split("path", "/"), -1)).alias("name"))


@query("p10_classify_script", f"SELECT path, CASE split_part(path, '/', 1) WHEN 'jobs' THEN 'job' WHEN 'ush' THEN 'utility' ELSE 'script' END AS kind FROM (SELECT {SCRIPT_PATH} AS path FROM orders) f")
def p10(spark, d):
    return files(spark, d).select("path", P.classify_script(F.concat(F.lit("/r/"), "path")).alias("kind"))


CASE = "CASE o_orderkey % 3 WHEN 0 THEN 'S2S' WHEN 1 THEN 'ATM' ELSE 'wave' END || CASE WHEN o_orderkey % 2 = 0 THEN '_cycled' ELSE '_forecast' END || '_C' || CASE o_orderkey % 5 WHEN 0 THEN '48' WHEN 1 THEN '384' ELSE '768' END || '_' || CAST(o_orderkey % 48 AS STRING) || 'h'"


@query("p12_code_test_case", f"""SELECT o_orderkey AS id, {CASE} AS name, CASE o_orderkey % 3 WHEN 0 THEN 'coupled' WHEN 1 THEN 'atmosphere' ELSE 'other' END AS mode, CASE o_orderkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS resolution,
    CAST(o_orderkey % 48 AS INT) AS hours, CASE WHEN o_orderkey % 2 = 0 THEN 'cycled' ELSE 'forecast' END AS kind FROM orders""")
def p12(spark, d):
    return P.code_test_case(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(CASE).alias("name")))


@query("p17_filter_paths", f"""WITH f AS (SELECT o_custkey AS event, {SCRIPT_PATH} AS p FROM orders), g AS (SELECT event, p LIKE 'ush/%' AS redacted, CASE WHEN p LIKE 'ush/%' THEN '[redacted]' ELSE p END AS path FROM f WHERE NOT p LIKE 'jobs/J%'),
    r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY path) AS k FROM g) SELECT event, path, redacted FROM r WHERE k <= 4""")
def p17(spark, d):
    return P.filter_paths(table(spark, d, "orders").select(F.col("o_custkey").alias("event"), F.expr(SCRIPT_PATH).alias("path")), ["jobs/J*"], ["ush/*"], 4)


@query("f05_event_fingerprint", """SELECT event_id, left(sha256('{"files":["a","' || event_type || '"],"status":"done","session":"' || user_id || '"}'), 16) AS v FROM events""")
def f05(spark, d):
    return table(spark, d, "events").select("event_id", T.event_fingerprint(F.array("event_type", F.lit("a")), F.lit("done"), F.col("user_id").cast("string")).alias("v"))


@query("f11_iso_timestamp", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) END AS v FROM events")
def f11(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise("")))
    return table(spark, d, "events").select("event_id", F.unix_timestamp(T.iso_timestamp(text)).alias("v"))


@query("f13_keyword_coverage", "WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[\\t\\n\\v\\f\\r ]+'), lambda x: x <> '')) AS t FROM documents) SELECT doc_id, round(len(list_intersect(['the', 'der', 'la', 'und'], t)) / 4, 6) AS v FROM w WHERE t IS NOT NULL")
def f13(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(T.keyword_coverage(F.lit("The der LA und der"), F.col("text")), 6).alias("v"))


@query("f16_sanitised", "SELECT event_id, event_type AS kind, coalesce(CAST(CASE WHEN user_id % 3 <> 0 THEN user_id END AS VARCHAR), '') AS u FROM events")
def f16(spark, d):
    m = T.sanitised(F.create_map(F.lit("kind"), F.col("event_type"), F.lit("u"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).cast("string")))
    return table(spark, d, "events").select("event_id", m.alias("m")).select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["u"].alias("u"))


@query("f17_repo_relative", f"SELECT o_orderkey AS id, {SCRIPT_PATH} AS v FROM orders")
def f17(spark, d):
    root = F.when(F.col("o_orderkey") % 3 == 0, "/home/me/repo/").when(F.col("o_orderkey") % 3 == 1, "./").otherwise("")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.repo_relative(F.concat(root, F.expr(SCRIPT_PATH)), ["/home/me/repo"]).alias("v"))


@query("f18_shebang", f"SELECT {SCRIPT_PATH} AS path, CASE o_orderkey % 5 WHEN 2 THEN 'perl' WHEN 1 THEN NULL ELSE 'bash' END AS v FROM orders")
def f18(spark, d):
    return files(spark, d).select("path", T.shebang(F.col("content")).alias("v"))


@query("f19_checklist_items", "SELECT o_orderkey AS id, 'first ' || o_orderkey || '|second ' || o_orderstatus || '|Ensure that it runs|third' AS v FROM orders")
def f19(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(T.checklist_items(F.expr(ITEMS)), "|").alias("v"))


@query("f20_language_of_labels", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'fortran' WHEN 2 THEN 'job' ELSE 'unknown' END AS v FROM orders")
def f20(spark, d):
    labels = F.expr("CASE o_orderkey % 4 WHEN 0 THEN array('ShellScript', 'PythonFile') WHEN 1 THEN array('FortranModule') WHEN 2 THEN array('Thing', 'JobScript') ELSE array('x') END")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.language_of_labels(labels).alias("v"))


# -- name resolution


@query("j05_link_by_basename", f"WITH t AS (SELECT o_orderkey AS task, CASE WHEN o_orderkey % 4 = 0 THEN 'none.sh' ELSE {BASE} END AS b FROM (SELECT *, {SCRIPT_PATH} AS path FROM orders) o), s AS (SELECT path AS script, {BASE} AS b FROM (SELECT {SCRIPT_PATH} AS path FROM orders) f) SELECT DISTINCT task, script FROM t JOIN s ON t.b = s.b UNION ALL SELECT task, NULL FROM t WHERE b = 'none.sh'")
def j05(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("task"), F.expr(SCRIPT_PATH).alias("path"))
    tasks = x.select("task", F.concat(F.lit("&HOME;/"), F.when(F.col("task") % 4 == 0, "x/none.sh").otherwise(F.col("path"))).alias("command"))
    linked, rest = J.link_by_basename(tasks, x.select("path"))
    return linked.union(rest.select("task", F.lit(None).cast("string")))


#: Four parts of an order's path for each supplier: its middle, its end, a run of two letters, and a part of no path.
MENTION = "CASE s_suppkey % 4 WHEN 0 THEN substr(path, 3, 9) WHEN 1 THEN substr(path, 6, 40) WHEN 2 THEN substr(path, 8, 2) ELSE 'no/' || path END"


@query("j06_link_mentions", f"""WITH p AS (SELECT DISTINCT {SCRIPT_PATH} AS path FROM orders), m AS (SELECT s_suppkey AS doc, {MENTION} AS mention FROM supplier JOIN (SELECT o_orderkey, {SCRIPT_PATH} AS path FROM orders) o ON o_orderkey = s_suppkey)
    SELECT DISTINCT doc, path FROM m, p WHERE contains(path, mention)""")
def j06(spark, d):
    paths = table(spark, d, "orders").select("o_orderkey", F.expr(SCRIPT_PATH).alias("path"))
    m = table(spark, d, "supplier").join(paths, F.expr("o_orderkey = s_suppkey")).select(F.col("s_suppkey").alias("doc"), F.expr(MENTION).alias("mention"))
    return J.link_mentions(m, paths)


@query("j07_resolve_executable", """WITH s AS (SELECT DISTINCT p_size AS s FROM part) SELECT 'gfs_' || s AS ref, CASE s % 4 WHEN 0 THEN 'gfs_' || s WHEN 1 THEN 'gfs_' || s || '_main' WHEN 2 THEN 'gfs_' || s || '_x_y' ELSE 'gfs' END AS program, CAST(CASE s % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS INT) AS rule FROM s""")
def j07(spark, d):
    s = table(spark, d, "part").select(F.col("p_size").alias("s")).distinct()
    name = F.expr("CASE s % 4 WHEN 0 THEN concat('gfs_', s) WHEN 1 THEN concat('gfs_', s, '_main') WHEN 2 THEN concat('gfs_', s, '_x_y') ELSE 'gfs' END")
    return J.resolve_executable(s.select(F.concat(F.lit("gfs_"), "s").alias("ref")), s.select(name.alias("program")))


@query("j08_resolve_configs", "SELECT 'exp' || o_custkey || '/config.' || (o_orderkey % 20) AS config, 'base/config.' || (o_orderkey % 20) AS base FROM orders WHERE o_orderkey % 20 < 10 AND o_orderkey % 7 <> 0")
def j08(spark, d):
    x = table(spark, d, "orders")
    short = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "config.resources.").otherwise("config."), (F.col("o_orderkey") % 20).cast("string"))
    base = spark.range(10).select(F.concat(F.lit("config."), "id").alias("short")).select(F.concat(F.lit("base/"), "short").alias("config"), "short")
    return J.resolve_configs(x.select(F.concat(F.lit("exp"), "o_custkey", F.lit("/"), short).alias("config"), short.alias("short")), base)


@query("j16_link_chunks", "SELECT 'c' || o_orderkey AS chunk_id, 'file' || o_custkey AS node_id FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'c' || o_orderkey, 'sym' || o_custkey FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey < 60")
def j16(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey").union(table(spark, d, "orders").select("o_custkey")).distinct()
    path = lambda k: F.concat(F.lit("p/"), k)
    nodes = c.select(F.concat(F.lit("file"), "c_custkey").alias("node_id"), path("c_custkey").alias("path"), F.lit(None).cast("string").alias("name"))
    nodes = nodes.union(c.where("c_custkey < 60").select(F.concat(F.lit("sym"), "c_custkey"), path("c_custkey"), F.lit("run")))
    name = F.when(F.col("o_orderkey") % 3 == 0, None).when(F.col("o_orderkey") % 3 == 1, "run").otherwise("other")
    return J.link_chunks(nodes, o.select(F.concat(F.lit("c"), "o_orderkey").alias("chunk_id"), path("o_custkey").alias("path"), name.cast("string").alias("name")))


#: Scripts that call others directly, below a variable's folder, and not at all.
DIRECT = _text(
    f"'  sh tools/run_' || {_s('o_orderkey % 13')} || '.sh -v; ./go.sh'",
    f"'cd /x && bash jobs/x_' || {_s('o_custkey % 7')} || '.sh # note'",
    "'# sh no.sh'",
    f"'sh $USHgfs/var_' || {_s('o_orderkey % 5')} || '.sh'",
    "'mash x.sh | sh y.ksh'",
)


@query("x01_direct_invocations", f"""WITH o AS (SELECT *, {SCRIPT_PATH} AS path FROM orders) SELECT path, 'tools/run_' || (o_orderkey % 13) || '.sh' AS name, 1 AS n FROM o UNION ALL SELECT path, 'go.sh', 1 FROM o
    UNION ALL SELECT path, 'jobs/x_' || (o_custkey % 7) || '.sh', 2 FROM o UNION ALL SELECT path, '$USHgfs/var_' || (o_orderkey % 5) || '.sh', 4 FROM o""")
def x01_direct(spark, d):
    return X.shell_facts(files(spark, d, DIRECT)).where("kind = 'invoke'").select("path", "name", "n")


#: Workflow documents of orders: metatasks in each other, entities, and dependencies under operators; some are not well formed.
OPERATOR = "CASE o_orderkey % 3 WHEN 0 THEN 'and' WHEN 1 THEN 'or' ELSE 'nand' END"
WORKFLOW = _text(
    f"'<?xml version=\"1.0\"?><!DOCTYPE workflow [<!ENTITY RUN \"run_' || {_s('o_orderkey % 13')} || '.sh\">]>'",
    f"'<workflow><!-- <task name=\"no\"/> --><metatask name=\"out_' || {C} || '\"><var name=\"a\">' || trim(repeat('x ', CAST(o_custkey % 4 + 1 AS INT))) || '</var>'",
    "'<metatask name=\"in\"><var name=\"b\">' || trim(repeat('y ', CAST(o_orderkey % 3 + 1 AS INT))) || '</var><var name=\"c\">1 2</var>'",
    f"'<task name=\"t_' || {K} || '\"><command>&RUN; ' || o_orderstatus || '</command><dependency><' || {OPERATOR} || '>'",
    f"'<taskdep task=\"prep_' || {C} || '\" cycle_offset=\"-06:00:00\"/><not><datadep><cyclestr>f_' || {K} || '</cyclestr>.nc</datadep></not>'",
    f"'</' || CASE WHEN o_orderkey % 11 = 0 THEN 'no' ELSE {OPERATOR} END || '></dependency></task></metatask></metatask>'",
    f"'<task name=\"end\"><command> done </command><dependency><metataskdep metatask=\"out_' || {C} || '\"/></dependency></task></workflow>'",
)
WORKFLOW_COLUMNS = "{} AS kind, {} AS name, {} AS target, {} AS operator, {} AS cycle_offset, CAST({} AS INTEGER) AS members, {} AS error"


def _workflow_row(*values: str) -> str:
    return "SELECT path, " + WORKFLOW_COLUMNS.format(*values)


@query("x07_workflow_edges", f"""WITH o AS (SELECT *, {ORDER_PATH} AS path, {OPERATOR} AS op FROM orders), f AS (SELECT * FROM o WHERE o_orderkey % 11 <> 0)
    {_workflow_row("'metatask'", f"'out_' || {C}", "NULL", "NULL", "NULL", "o_custkey % 4 + 1", "NULL")} FROM f
    UNION ALL {_workflow_row("'metatask'", "'in'", "NULL", "NULL", "NULL", "(o_orderkey % 3 + 1) * 2", "NULL")} FROM f
    UNION ALL {_workflow_row("'task'", f"'t_' || {K}", "'run_' || (o_orderkey % 13) || '.sh ' || o_orderstatus", "NULL", "NULL", "(o_custkey % 4 + 1) * (o_orderkey % 3 + 1) * 2", "NULL")} FROM f
    UNION ALL {_workflow_row("'taskdep'", f"'t_' || {K}", f"'prep_' || {C}", "op", "'-06:00:00'", "NULL", "NULL")} FROM f
    UNION ALL {_workflow_row("'datadep'", f"'t_' || {K}", f"'f_' || {K} || '.nc'", "'not'", "NULL", "NULL", "NULL")} FROM f
    UNION ALL {_workflow_row("'task'", "'end'", "'done'", "NULL", "NULL", "1", "NULL")} FROM f
    UNION ALL {_workflow_row("'metataskdep'", "'end'", f"'out_' || {C}", "'and'", "NULL", "NULL", "NULL")} FROM f
    UNION ALL {_workflow_row("NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "'malformed at tag 22'")} FROM o WHERE o_orderkey % 11 = 0""")
def x07(spark, d):
    o = dealt(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    return X.workflow_edges(o.select(F.expr(ORDER_PATH).alias("path"), F.expr(WORKFLOW).alias("content")))


#: Python sources of parts: strings that look like code, open lines, nested definitions; some are no Python.
PYTHON = _text(
    "'import os, pkg_' || CAST(p_size % 5 AS STRING) || ' as q'",
    f"'class Part_' || {_s('p_partkey')} || '(Base, metaclass=M):  # class No:'",
    "'    \"\"\"Of size ' || CAST(p_size AS STRING) || chr(10) || '    def no(): go(1)' || chr(10) || '    \"\"\"'",
    "CASE WHEN p_size % 2 = 0 THEN '    @cached(size=3)' END",
    f"'    def run_' || {_s('p_size % 7')} || '(self, a: dict[str, int] = make(1),' || chr(10) || '  b=(1, 2), *rest) -> str:'",
    "'        def inner(): return q.load(\"go(2)\")'",
    f"'        self.x(); a.b.c(); raise BadError(print(step_' || {_s('p_size % 3')} || '(a)))'",
    "CASE WHEN p_partkey % 10 = 0 THEN 'def (:' END",
    "'async def main(): await go(3)'",
)


@query("x04_python_facts", f"""WITH o AS (SELECT *, 'py/' || p_partkey || '.py' AS path, CAST(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS more FROM part), f AS (SELECT * FROM o WHERE p_partkey % 10 <> 0)
    SELECT path, 'import' AS kind, 'os' AS name, NULL AS parent, 1 AS n, NULL AS detail, NULL AS error FROM f UNION ALL SELECT path, 'import', 'pkg_' || (p_size % 5), NULL, 1, NULL, NULL FROM f
    UNION ALL SELECT path, 'class', 'Part_' || p_partkey, NULL, 2, NULL, NULL FROM f UNION ALL SELECT path, 'inherits', 'Base', 'Part_' || p_partkey, 2, NULL, NULL FROM f
    UNION ALL SELECT path, 'docstring', 'Part_' || p_partkey, 'Part_' || p_partkey, 3, 'Of size ' || p_size || chr(10) || '    def no(): go(1)', NULL FROM f
    UNION ALL SELECT path, 'decorator', 'cached', 'run_' || (p_size % 7), 6, NULL, NULL FROM f WHERE more = 1
    UNION ALL SELECT path, 'method', 'run_' || (p_size % 7), 'Part_' || p_partkey, 6 + more, 'self,a,b', NULL FROM f UNION ALL SELECT path, 'returns', 'run_' || (p_size % 7), 'run_' || (p_size % 7), 6 + more, 'str', NULL FROM f
    UNION ALL SELECT path, 'call', 'make', 'run_' || (p_size % 7), 6 + more, NULL, NULL FROM f UNION ALL SELECT path, 'function', 'inner', 'run_' || (p_size % 7), 8 + more, '', NULL FROM f
    UNION ALL SELECT path, 'call', 'load', 'inner', 8 + more, NULL, NULL FROM f UNION ALL SELECT path, 'call', 'step_' || (p_size % 3), 'run_' || (p_size % 7), 9 + more, NULL, NULL FROM f
    UNION ALL SELECT path, 'function', 'main', NULL, 10 + more, '', NULL FROM f UNION ALL SELECT path, 'async', 'main', 'main', 10 + more, NULL, NULL FROM f UNION ALL SELECT path, 'call', 'go', 'main', 10 + more, NULL, NULL FROM f
    UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, 'line ' || (10 + more) || ': not Python' FROM o WHERE p_partkey % 10 = 0""")
def x04(spark, d):
    return X.python_facts(files(spark, d, PYTHON, f"'py/' || {_s('p_partkey')} || '.py'", "part"))
