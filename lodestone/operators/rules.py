"""Rule scans of scripts and triage of logs. ``files`` has ``path, content``; every rule runs on all files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import checklist_items
from lodestone.operators.extract import file_lines


def _issues(files: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """``path, category, message`` of the rules (category, test, message) that hold."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(c).alias("category"), m.alias("message"))) for c, test, m in rules)))
    return files.select("path", F.inline(found))


def _lines() -> Column:
    return F.split("content", "\n")


def scan_error_handling(files: DataFrame) -> DataFrame:
    """Shebang not on line 1 (within 3), no ``set -x`` without error utilities, errors without FATAL ERROR."""
    first = F.slice(_lines(), 1, 3)
    late = F.exists(F.slice(first, 2, 2), lambda x: x.startswith("#!")) & ~F.get(first, 0).startswith("#!")
    util = F.col("content").rlike(r"\berr_(?:chk|exit)\b")
    bad = F.filter(_lines(), lambda x: x.rlike(r"(?i)echo.*\berror\b") & ~x.contains("FATAL ERROR:"))
    return _issues(files, [
        ("shebang_position", late, F.lit("shebang is not on the first line")),
        ("missing_set_x", ~F.col("content").rlike(r"(?m)^\s*set\s+-\w*x") & ~util, F.lit("no set -x and no error utility")),
        ("error_prefix", F.size(bad) > 0, F.trim(F.get(bad, 0))),
    ])


def scan_naming(files: DataFrame) -> DataFrame:
    """Jobs begin with J, scripts with ex; output file names have no upper case."""
    base = F.element_at(F.split("path", "/"), -1)
    up = F.regexp_extract("content", r">\s*\"?\$\{?COMOUT\w*\}?/([\w.]*[A-Z][\w.]*)", 1)
    return _issues(files, [
        ("job_prefix", F.col("path").contains("jobs/") & ~base.startswith("J"), F.concat(F.lit("job name does not begin with J: "), base)),
        ("script_prefix", F.col("path").contains("scripts/") & ~base.startswith("ex"), F.concat(F.lit("script name does not begin with ex: "), base)),
        ("upper_case_output", up != "", up),
    ])


def scan_shebang(files: DataFrame) -> DataFrame:
    """Missing, misplaced (within 5 lines) and non-standard shebangs; jobs without a timing export."""
    first = F.slice(_lines(), 1, 5)
    at = F.exists(first, lambda x: x.startswith("#!"))
    top = F.get(first, 0)
    standard = top.rlike(r"^#!\s*(?:/bin/(?:ba|k)?sh|/usr/bin/env\s+\w+)")
    return _issues(files, [
        ("missing_shebang", ~at, F.lit("no shebang in the first five lines")),
        ("misplaced_shebang", at & ~top.startswith("#!"), F.lit("shebang is not on the first line")),
        ("non_standard_shebang", top.startswith("#!") & ~standard, top),
        ("missing_timing", F.element_at(F.split("path", "/"), -1).startswith("J") & ~F.col("content").contains("export PS4"), F.lit("no timing export")),
    ])


def scan_utilities(files: DataFrame) -> DataFrame:
    """Exits without error utility, no debug logging, no status message, no SENDCOM default."""
    c = F.col("content")
    return _issues(files, [
        ("explicit_exit", c.rlike(r"(?m)^\s*exit\s+[1-9]") & ~c.rlike(r"\berr_(?:chk|exit)\b"), F.lit("exit without error utility")),
        ("missing_debug", ~c.rlike(r"set\s+-\w*x"), F.lit("no debug logging")),
        ("missing_status", ~c.rlike(r"(?i)\becho\b.*\b(?:begin|end|start|finish)"), F.lit("no status message")),
        ("sendcom_default", c.contains("SENDCOM") & ~c.rlike(r"SENDCOM=\$\{SENDCOM:-"), F.lit("SENDCOM has no default")),
    ])


def file_type(path: Column) -> Column:
    """Kind of file by its name, the first that fits."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.when(base.rlike(r"^J[A-Z]"), "job").when(base.rlike(r"^ex\w+\.(?:sh|py)$"), "exscript").when(base.endswith(".sh"), "shell").when(base.endswith(".py"), "python").when(base.rlike(r"(?i)\.f(90)?$"), "fortran").otherwise("other")


def shell_counts(files: DataFrame) -> DataFrame:
    """``path, variables, quoted, unchecked``: uses of variables, quoted ones, and file operations whose
    next line does not look at the status."""
    w = Window.partitionBy("path").orderBy("n")
    x = file_lines(files).withColumn("next", F.lead("line").over(w))
    op = F.col("line").rlike(r"^\s*(?:cp|mv|ln|rm|mkdir)\b") & ~F.col("line").rlike(r"\|\||&&")
    checked = F.coalesce(F.col("next").rlike(r"\$\?|\berr="), F.lit(False))
    return x.groupBy("path").agg(F.sum(F.regexp_count("line", F.lit(r"\$\{?\w+"))).alias("variables"), F.sum(F.regexp_count("line", F.lit(r"\"\$\{?\w+\}?"))).alias("quoted"), F.count_if(op & ~checked).alias("unchecked"))


def snippets(files: DataFrame, patterns: list[str], around: int = 3) -> DataFrame:
    """``path, n, snippet``: each line that a pattern matches with the lines around it."""
    test = lambda line: reduce(lambda a, p: a | line.rlike(p), patterns, F.lit(False))
    first = lambda i: F.greatest(i + (1 - around), F.lit(1))
    near = lambda i: F.array_join(F.slice("lines", first(i), i + (2 + around) - first(i)), "\n")
    found = F.transform("lines", lambda line, i: F.when(test(line), F.struct((i + 1).alias("n"), near(i).alias("snippet"))))
    # all lines of a file are in its row, so nothing is shuffled
    return files.select("path", _lines().alias("lines")).select("path", F.inline_outer(F.array_compact(found))).where("n is not null")


def shebang_block(files: DataFrame) -> DataFrame:
    """``path, shebang, set_x_line``: facts of the first 20 lines; 0 where there is none."""
    head = F.slice(_lines(), 1, 20)
    at = F.array_position(F.transform(head, lambda x: x.rlike(r"^\s*set\s+-\w*x")), True)
    return files.select("path", F.when(F.get(head, 0).startswith("#!"), F.get(head, 0)).alias("shebang"), at.alias("set_x_line"))


#: First lines of tables of loaded modules, and lines that set a variable.
MODULES, SETTING = r"(?i)^\s*currently loaded modules", r"^\s*(?:export\s+)?[A-Z_][A-Z0-9_]*="


def denoise(log_lines: DataFrame) -> DataFrame:
    """Lines (``id, n, line``) without environment settings and tables of loaded modules."""
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    begin, end = F.col("line").rlike(MODULES), F.trim("line") == ""
    opened = F.max(F.when(begin, F.col("n"))).over(w)
    closed = F.max(F.when(end, F.col("n"))).over(w)
    inside = opened.isNotNull() & (closed.isNull() | (closed < opened))
    return log_lines.withColumn("t", inside).where(~F.col("t") & ~F.col("line").rlike(SETTING)).drop("t")


def denoise_logs(logs: DataFrame) -> DataFrame:
    """``denoise`` of whole logs (``id, text``): ``id, n, line``, each log within its row.

    A walk over the lines notes where tables of modules begin and end; the lines between tables are then unfolded.
    """

    def step(state: Column, line: Column) -> Column:
        inside = F.when(line.rlike(MODULES), True).when(F.trim(line) == "", False).otherwise(state["inside"])
        cuts = F.when(inside != state["inside"], F.concat(state["cuts"], F.array(state["n"] + 1))).otherwise(state["cuts"])
        return F.struct(inside.alias("inside"), (state["n"] + 1).alias("n"), cuts.alias("cuts"))

    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n"), F.array(F.lit(1)).alias("cuts"))
    x = logs.select("id", F.split("text", "\n").alias("lines")).select("id", "lines", F.aggregate("lines", start, step).alias("walk"))
    x = x.select("id", "lines", F.when(F.col("walk.inside"), F.col("walk.cuts")).otherwise(F.concat("walk.cuts", F.array(F.col("walk.n") + 1))).alias("cuts"))
    parts = F.transform(F.sequence(F.lit(0), (F.size("cuts") / 2).cast("int") - 1), lambda i: F.struct(F.get("cuts", i * 2).alias("n"), F.slice("lines", F.get("cuts", i * 2), F.get("cuts", i * 2 + 1) - F.get("cuts", i * 2)).alias("lines")))
    x = x.select("id", F.explode_outer(parts).alias("part")).select("id", "part.n", F.posexplode_outer("part.lines").alias("i", "line"))
    return x.select("id", (F.col("n") + F.col("i")).alias("n"), "line").where(F.col("line").isNotNull() & ~F.col("line").rlike(SETTING))


def _signal(size: int, align: int) -> Column:
    """The last bytes of ``text`` from a line's begin."""
    n = F.octet_length("text")
    cut = F.decode(F.when(n > size, F.expr(f"substring(encode(text, 'UTF-8'), -{size}, {size})")).otherwise(F.encode("text", "UTF-8")), "UTF-8")
    at = F.instr(cut, "\n")
    return F.when((n > size) & at.between(1, align), F.substr(cut, at + 1)).otherwise(cut)


def log_signal(logs: DataFrame, size: int = 8192, align: int = 500) -> DataFrame:
    """``id, signal, omitted_bytes, exit_code``: the last bytes from a line's begin, and the exit code that
    the last 50 lines name."""
    tail = F.array_join(F.slice(F.split("text", "\n"), F.greatest(F.size(F.split("text", "\n")) - 49, F.lit(1)), F.lit(50)), "\n")
    code = None
    for p in (r"(?i)exit(?:ed)?(?: with)?(?: code| status)?[: =]+(\d+)", r"(?i)return code[: =]+(\d+)", r"(?i)\brc\s*=\s*(\d+)"):
        one = F.regexp_extract(tail, p, 1).try_cast("int")
        code = one if code is None else F.coalesce(code, one)
    out = logs.select("id", _signal(size, align).alias("signal"), F.octet_length("text").alias("n"), code.alias("exit_code"))
    return out.select("id", "signal", (F.col("n") - F.octet_length("signal")).alias("omitted_bytes"), "exit_code")


#: Failure classes in the order in which they are tried.
TAXONOMY = [
    ("out_of_memory", r"(?i)out of memory|oom-?kill|cannot allocate memory"), ("timeout", r"(?i)time ?limit|timed out|walltime"),
    ("segfault", r"(?i)segmentation fault|sigsegv"), ("missing_file", r"(?i)no such file or directory|file not found"),
    ("permission", r"(?i)permission denied"), ("network", r"(?i)connection (?:refused|reset)|could not resolve"),
    ("compile", r"(?i)compilation (?:failed|error)|undefined reference"), ("test_failure", r"(?i)tests? failed|assertion ?error"),
    ("disk_full", r"(?i)no space left on device|disk quota"),
]


#: Lower-case texts for each class, one of which stands in whatever its pattern matches.
TELLS = {
    "out_of_memory": ["out of memory", "oom-kill", "oomkill", "cannot allocate memory"], "timeout": ["time limit", "timelimit", "timed out", "walltime"],
    "segfault": ["segmentation fault", "sigsegv"], "missing_file": ["no such file or directory", "file not found"],
    "permission": ["permission denied"], "network": ["connection refused", "connection reset", "could not resolve"],
    "compile": ["compilation failed", "compilation error", "undefined reference"], "test_failure": ["test failed", "tests failed", "assertion error", "assertionerror"],
    "disk_full": ["no space left on device", "disk quota"],
}


def classify_log(logs: DataFrame) -> DataFrame:
    """``id, failure``: the first class that the signal matches, else the whole log, else unknown.

    A pattern runs only where one of its class's texts stands, since a search for these takes a small part of its time.
    """

    def first(c: Column, low: Column, may: Column) -> Column:
        out = None
        for i, (name, p) in enumerate(TAXONOMY):
            test = F.get(may, i) & reduce(lambda a, b: a | b, (low.contains(t) for t in TELLS[name])) & c.rlike(p)
            out = F.when(test, name) if out is None else out.when(test, name)
        return out

    own = logs.select("id", "text", F.lower("text").alias("low"), _signal(8192, 500).alias("signal"))
    tells = [reduce(lambda a, b: a | b, (F.col("low").contains(t) for t in TELLS[name])) for name, _ in TAXONOMY]
    own = own.select("id", "text", "low", "signal", F.lower("signal").alias("low_signal"), F.array(*tells).alias("may"))
    by_signal, by_text = first(F.col("signal"), F.col("low_signal"), F.col("may")), first(F.col("text"), F.col("low"), F.col("may"))
    return own.select("id", F.coalesce(by_signal, by_text, F.lit("unknown")).alias("failure"))


def checklist_report(hits: DataFrame, chunks: DataFrame, most: int = 8) -> DataFrame:
    """``category, id, item``: checklist items of each category's best chunks (``query_id, id``)."""
    return hits.select(F.col("query_id").alias("category"), "id").join(chunks, "id").select("category", "id", F.explode(checklist_items(F.col("text"), most)).alias("item"))
