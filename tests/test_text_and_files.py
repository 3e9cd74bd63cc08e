"""Corpus, extraction, rule, log, file and evaluation operators on small fixtures."""

import ast
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import udf as H
from lodestone.operators import aggregates as A
from lodestone.operators import corpus as D
from lodestone.operators import evaluate as E
from lodestone.operators import extract as X
from lodestone.operators import predicates as P
from lodestone.operators import quality as Q
from lodestone.operators import ranking as W
from lodestone.operators import rules as V
from lodestone.operators import search as R
from lodestone.operators import sets as U
from lodestone.sources import files as S


def files(spark, **named):
    return spark.createDataFrame([(k.replace("__", "/"), v) for k, v in named.items()], "path string, content string")


def one(spark, expr, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expr.alias("v")).first().v


def test_markdown_sections(spark, rows):
    text = "intro\n# A\none\n### B\n```\n# not a heading\n```\n## C\ntwo"
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    got = rows(D.chunk_markdown(docs, 0))
    assert D.chunk_markdown(docs).count() == 0 and [r[1] for r in rows(D.chunk_markdown(docs, 10))] == [2]  # short sections are left out
    assert [(r[1], r[2]) for r in got] == [(0, ""), (1, "A"), (2, "A > B"), (3, "A > C")]
    assert "# not a heading" in got[2][3]


def test_rst_sections_directives_and_code(spark, rows):
    docs = spark.createDataFrame([(1, "Title\n=====\nbody\n\nNext\n----\nmore")], "id int, text string")
    assert [r[2] for r in rows(D.chunk_rst(docs))] == ["Title", "Next"]
    d = spark.createDataFrame([(1, ".. note:: hello\n   :name: x\n   body\n.. other::\n   z")], "id int, text string")
    assert rows(D.directives(d)) == [(1, "note", "hello", {"name": "x"}, "body"), (1, "other", "", {}, "z")]
    c = spark.createDataFrame([(1, "a\n```py\nx = 1\n```\n```\ny\n```")], "id int, text string")
    assert rows(D.code_blocks(c)) == [(1, 0, "py", "x = 1\n"), (1, 1, None, "y\n")]


def test_packing():
    assert D.pack([800, 800, 800], [False] * 3, 1500, 3000) == [0, 1, 2]
    assert D.pack([800, 800, 1500], [True] * 3, 1500, 3000) == [0, 0, 1]
    assert D.merge_small([100, 500, 600, 150], 200) == [0, 0, 1, 2]


def test_pack_chunks_and_udtf(spark, rows):
    e = spark.createDataFrame([("d", 1, "x" * 300, True), ("d", 2, "y" * 100, True), ("d", 0, "z" * 50, True)], "id string, n int, text string, splittable boolean")
    got = rows(D.pack_chunks(e, 350, 400, 60))
    assert "".join(r[2] for r in got).replace("\n", "") == "z" * 50 + "x" * 300 + "y" * 100
    H.register(spark)
    assert rows(spark.sql("SELECT * FROM pack_chunks(array('aa', 'bb', 'cc'), 4, 5)")) == [(0, "aa\nbb"), (1, "cc")]


def test_recursive_and_sentence_chunks(spark, rows):
    docs = spark.createDataFrame([("a", "one two. " * 100), ("b", None), ("c", "x" * 50)], "id string, text string")
    got = rows(D.chunk_recursive(docs, 200, 20))
    assert max(len(r[2]) for r in got) <= 200 and {r[0] for r in got} == {"a", "c"}
    assert max(len(r[2]) for r in rows(D.chunk_sentences(docs, 60))) <= 60
    assert D.split_text("abcdef", 2) == ["ab", "cd", "ef"]


def test_html_parts(spark, rows):
    page = "<html><nav><p>menu</p></nav><h1>T &amp; U</h1><p>one<b>two</b></p><pre>x\ny</pre><ul><li>i</li></ul><script>no</script></html>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")
    assert rows(D.chunk_html(df)) == [(1, 0, "heading", 1, "T & U"), (1, 1, "text", None, "onetwo"), (1, 2, "code", None, "x\ny"), (1, 3, "list", None, "i")]


def test_shell_facts(spark, rows):
    f = files(spark, a="#!/bin/bash\n# source no.sh\nsource lib.sh\nexport RUN=\"x y\"\n$USHgfs/run.sh\nfoo() {\n echo $DATA ${RUN}\n}\nLOCAL=1")
    got = {(k, n): v for _, k, n, v, _ in rows(X.shell_facts(f))}
    assert got[("export", "RUN")] == '"x y"' and ("source", "lib.sh") in got and ("function", "foo") in got
    direct = files(spark, a="sh x/a.sh; ./b.sh\n  bash c.sh\n# sh d.sh\nsh $E/f.sh\nmash g.sh\ncd y && ./h.sh -v")
    assert {n for _, k, n, *_ in rows(X.shell_facts(direct)) if k == "invoke"} == {"x/a.sh", "b.sh", "c.sh", "$E/f.sh", "h.sh"}
    assert ("invoke", "$USHgfs/run.sh") in got and ("env", "DATA") in got and ("source", "no.sh") not in got
    e = {n: r for _, n, r in rows(X.env_edges(f))}
    assert e["RUN"] == "EXPORTS" and e["LOCAL"] == "SETS" and e["DATA"] == "DEPENDS_ON_ENV"


def test_config_vars_first_definition_wins(spark, rows):
    f = files(spark, c='export A="${A:-5}"\nexport B=2\nA=9\nC=3')
    assert [(r[2], r[3], r[4]) for r in rows(X.config_vars(f).select("path", "n", "name", "value", "is_default"))] == [("A", "5", True), ("B", "2", False), ("C", "3", False)]


def test_fortran_facts(spark, rows):
    f = files(spark, m="module grid\n use kinds, only: r8\ncontains\n subroutine init(a, &\n   & b)\n  call setup(a)\n end subroutine init\nend module grid\n! call no()")
    assert {(k, n, p) for _, k, n, p, _ in rows(X.fortran_facts(f))} == {("module", "grid", None), ("use", "kinds", "grid"), ("subroutine", "init", "grid"), ("call", "setup", "init")}


def test_python_facts_and_errors(spark, rows):
    f = files(spark, ok="import os\nclass A(B):\n    def m(self, x):\n        os.path.join(x)\n        self.n()\n        go(x)\n        go(x)\n", bad="def (:")
    got = X.python_facts(f)
    facts = {(k, n, p) for _, k, n, p, *_ in rows(got) if k}
    assert {("import", "os", None), ("class", "A", None), ("inherits", "B", "A"), ("method", "m", "A"), ("call", "go", "m")} == facts
    assert [r.path for r in got.where("error is not null").collect()] == ["bad"]
    assert rows(X.call_counts(got).select("caller", "callee", "call_count")) == [("m", "go", 2)]
    stats = X.extraction_stats(got.withColumn("language", F.lit("py")))
    assert rows(stats) == [("py", 1, 1)]


def test_workflow_nesting_and_odd_documents(spark, rows):
    xml = (
        "<?xml version='1.0'?><!-- <task name='no'> --><!DOCTYPE w [<!ENTITY A \"&B;/x\"><!ENTITY B \"/top\">]><workflow><metatask name='out'><var name='a'>1 2</var><var name='b'> x\ty z </var>"
        "<metatask name='in'><var name='c'>p q</var><task name='t'><command><cyclestr>&A;/run @Y</cyclestr> &gt; log</command>"
        "<dependency><or><taskdep task='p' cycle_offset='-06:00:00'/><and><datadep><cyclestr>@Y.nc</cyclestr></datadep><metataskdep metatask='m'/></and><taskdep task='q'/></or></dependency></task></metatask></metatask>"
        "<task name='last'><command>a</command><dependency><taskdep task='t'></taskdep></dependency></task><taskdep task='outside'/><metatask name='none'><var name='v'></var><task name='z'/></metatask></workflow>"
    )
    odd = {"cross": "<a><b></a></b>", "none": None, "blank": "", "text": "no markup", "two": "<a/><b/>", "open": "<a><b></b>", "more": "<a/></b>", "left": "x<a/>", "less": "<a>1 < 2</a>"}
    got = rows(X.workflow_edges(files(spark, w=xml, **odd)))
    assert {r[0]: r[-1] is not None for r in got if r[0] != "w"} == dict.fromkeys(odd, True)
    assert {r[1:7] for r in got if r[0] == "w"} == {
        ("metatask", "out", None, None, None, 6), ("metatask", "in", None, None, None, 2), ("task", "t", "/top/x/run @Y > log", None, None, 12), ("taskdep", "t", "p", "or", "-06:00:00", None),
        ("datadep", "t", "@Y.nc", "and", None, None), ("metataskdep", "t", "m", "and", None, None), ("taskdep", "t", "q", "or", None, None), ("task", "last", "a", None, None, 1),
        ("taskdep", "last", "t", "and", None, None), ("metatask", "none", None, None, None, 0), ("task", "z", "", None, None, 0),
    }
    assert X.workflow_edges(files(spark, w=xml).limit(0)).count() == 0


def test_html_odd_pages(spark, rows):
    pages = [
        "<p>a<p>b &#233;&#x1F600;&#0;&bogus; &amp;lt;</p>c<pre class='x'>1 < 2\n <b>y</b></pre>",
        "<nav><p>x</p><nav><p>y</p></nav><p>z</p></nav><script>var t='<p>no</p>';</script><H2>Big</H2><header><p>q",
        "<table><tr><th>h</th><td> v </td><td></td></tr></table><!-- <p>no</p> --><pretty>no</pretty><p>",
        "<p>" + "long " * 200_000 + "</p>" + "<li>i</li>" * 2_000,
        "",
    ]
    got = rows(D.chunk_html(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")))
    assert [r[1:] for r in got if r[0] == 0] == [(0, "text", None, "a"), (1, "text", None, "b \u00e9\U0001f600&#0;&bogus; &lt;"), (2, "code", None, "1 < 2\n y")]
    assert [r[1:] for r in got if r[0] == 1] == [(0, "heading", 2, "Big")]
    assert [r[1:] for r in got if r[0] == 2] == [(0, "table", None, "h"), (1, "table", None, "v")]
    assert len([r for r in got if r[0] == 3]) == 2_001 and not [r for r in got if r[0] == 4]


def _syntax_facts(source):
    """Definitions, bases, imports, decorators, types and docstrings by the interpreter's own parser."""
    out = []

    def visit(node, owner, in_class):
        for x in ast.iter_child_nodes(node):
            inner, cls = owner, in_class
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner, cls = x.name, isinstance(x, ast.ClassDef)
                out.extend(("decorator", ast.unparse(d.func if isinstance(d, ast.Call) else d), x.name) for d in x.decorator_list)
                out.extend([("docstring", x.name, x.name)] if ast.get_docstring(x) is not None else [])
                if cls:
                    out.append(("class", x.name, owner))
                    out.extend(("inherits", ast.unparse(b).split("[")[0], x.name) for b in x.bases)
                else:
                    out.append(("method" if in_class else "function", x.name, owner, ",".join(y.arg for y in x.args.posonlyargs + x.args.args)))
                    out.extend([("async", x.name, x.name)] if isinstance(x, ast.AsyncFunctionDef) else [])
                    out.extend([("returns", x.name, x.name)] if x.returns else [])
            elif isinstance(x, ast.Import):
                out.extend(("import", y.name, owner) for y in x.names)
            elif isinstance(x, ast.ImportFrom):
                out.append(("import", x.module or "", owner))
            visit(x, inner, cls)

    visit(ast.parse(source), None, False)
    return sorted(out, key=repr)


def test_python_facts_match_the_interpreter_on_this_library(spark):
    """Every source file of this library, the tests but those for deletable folders, and some that are awkward."""
    root = Path(__file__).parents[1]
    own = {str(p): p.read_text() for p in [*(root / "lodestone" / "operators").glob("*.py"), *(root / "lodestone" / "sources").glob("*.py"), *(root / "tests").glob("*.py")]}
    own["odd"] = (
        "class A(B[int], metaclass=M):\n    \"\"\"Doc\n    def no(): \\\"\"\" pass\n    \"\"\"\n    @prop.setter\n    @deco(1, x=\"(\")\n    async def m(self, a: dict[str, int] = f(1, 2), /, b=\"#)\", *args, k=1, **kw) -> 'X':\n        'doc'\n"
        "        if a:\n            def inner(\n  q,  # note (\n): return q\n        from . import z\n    def n(self): pass\n\nx = 1; import no\nfrom .a.b import (c,\n  d)\nif x:\n\timport os.path as p, sys\n\n\tdef late(): pass\ndef end(*, k): \\\n  pass\n"
    ).replace("; import no", "")
    got = X.python_facts(spark.createDataFrame(list(own.items()), "path string, content string")).where("kind <> 'call' or kind is null").collect()
    assert not [r for r in got if r.error]
    for path, source in own.items():
        mine = sorted([(r.kind, r.name, r.parent, r.detail) if r.kind in ("function", "method") else (r.kind, r.name, r.parent) for r in got if r.path == path], key=repr)
        assert mine == _syntax_facts(source), path


def test_python_facts_odd_files(spark, rows):
    f = files(spark, none=None, blank="", open="f(1", string="x = 'a\n", close="a)", definition="class 1:\n  pass", fine="# def no():\ns = 'go()'\nif (a): go(b)(c)\nx.y.z(1); o.run(); raise OwnError(1)\n")
    got = rows(X.python_facts(f))
    assert {r[0] for r in got if r[-1]} == {"open", "string", "close", "definition"}
    assert sorted(r[1:5] for r in got if not r[-1]) == [("call", "go", None, 3), ("call", "run", None, 4)]
    assert X.python_facts(f.limit(0)).count() == 0


def test_workflow(spark, rows):
    xml = '<?xml version="1.0"?><!DOCTYPE workflow [<!ENTITY CMD "run.sh">]><workflow><metatask name="mt"><var name="v">a b c</var><task name="t_#v#"><command>&CMD; x</command><dependency><and><taskdep task="prep"/><not><datadep>f.nc</datadep></not></and></dependency></task></metatask></workflow>'
    got = rows(X.workflow_edges(files(spark, w=xml, bad="<a")))
    assert ("w", "metatask", "mt", None, None, None, 3, None) in got and ("w", "task", "t_#v#", "run.sh x", None, None, 3, None) in got
    assert ("w", "taskdep", "t_#v#", "prep", "and", None, None, None) in got and ("w", "datadep", "t_#v#", "f.nc", "not", None, None, None) in got
    assert sum(r[-1] is not None for r in got) == 1


def test_other_extractors(spark, rows):
    assert rows(X.job_script_facts(files(spark, j="module load hdf5\ncp $COMIN/x $COMOUT/y\n$USH/go.sh")).select("kind", "name")) == [("call", "$USH/go.sh"), ("input", "COMIN"), ("module", "hdf5"), ("output", "COMOUT")]
    t = rows(X.template_facts(files(spark, t="{{ a | lower | default('x') }}\n{% for i in items %}\n{% if b %}")).select("kind", "name"))
    assert t == [("condition", "b"), ("filter", "default"), ("filter", "lower"), ("loop", "items"), ("variable", "a")]
    b = rows(X.build_edges(files(spark, c="add_executable(app a.f90 b.f90)\ntarget_link_libraries(app PUBLIC nc)\nfind_package(NetCDF REQUIRED)")).select("kind", "name", "target"))
    assert b == [("link", "app", "nc"), ("package", "netcdf", "required"), ("source", "app", "a.f90"), ("source", "app", "b.f90")]
    v = files(spark, **{"build.hera": "export hdf5_ver=1.10\nexport my_ver=2"})
    assert rows(X.version_edges(v, ["HDF5"])) == [("build.hera", "hera", "hdf5", "1.10")]
    log = spark.createDataFrame([("h|N|E@x|0|a|b",), ("short|x",)], "line string")
    assert [(r[0], r[2], r[4]) for r in rows(X.commit_rows(log))] == [("h", "e@x", "a|b")]
    g = files(spark, g='[submodule "m"]\n path = sorc/m\n url = u')
    assert rows(X.component_edges(g)) == [("g", "m", "sorc/m", "u")]
    x = files(spark, s="$EXECgfs/Model.x\npgm=post\n./tool.x")
    assert [r[1] for r in rows(X.execute_refs(x))] == ["model", "post", "tool"]
    assert rows(X.invoke_edges(files(spark, s="python Run_It.py"), files(spark, **{"u__run_it.py": ""}))) == [("s", "u/run_it.py")]
    d = rows(X.doc_mentions(spark.createDataFrame([(1, "see ush/a.sh and go() in JGFS_RUN")], "id int, text string")).select("mention", "kind"))
    assert d == [("JGFS_RUN", "job"), ("a", "script"), ("go", "function"), ("ush/a.sh", "file")]
    nodes = spark.createDataFrame([("f1", "File", None, "x/a.sh"), ("f2", "File", None, "jobs/JGFS_RUN"), ("f3", "File", None, "x/b.sh"), ("g", "Function", "go", None), ("n", "File", None, None)], "node_id string, label string, name string, path string")
    links = X.doc_links(spark.createDataFrame([(1, "see ush/a.sh and go() in JGFS_RUN"), (2, None)], "id int, text string"), nodes)
    assert rows(links) == [(1, n, "DOC_DESCRIBES", 0.8) for n in ("f1", "f2", "g")]
    assert rows(X.dependency_tokens(files(spark, p="import a.b\nfrom c import d\n${E}\nimport a.b"))) == [("p", ["a.b", "c", "E"])]
    u = spark.createDataFrame([("f", "use", "netcdf_mod")], "path string, kind string, name string")
    assert rows(X.library_uses(u, {"netcdf": "^netcdf"})) == [("f", "netcdf")]


def test_rules(spark, rows):
    f = files(spark, jobs__run="\n#!/bin/ksh\necho error here\nexit 1\ncp a b\necho $X \"$Y\"", jobs__JOK="#!/bin/bash\nset -x\nexport PS4=1\necho begin\nerr_chk")
    assert {(p, c) for p, c, _ in rows(V.scan_error_handling(f))} == {("jobs/run", "shebang_position"), ("jobs/run", "missing_set_x"), ("jobs/run", "error_prefix")}
    assert rows(V.scan_naming(f).select("category")) == [("job_prefix",)]
    assert {c for _, c, _ in rows(V.scan_shebang(f))} == {"misplaced_shebang"}
    assert {(p, c) for p, c, _ in rows(V.scan_utilities(f))} == {("jobs/run", "explicit_exit"), ("jobs/run", "missing_debug"), ("jobs/run", "missing_status")}
    assert [tuple(r)[1:] for r in V.shell_counts(f).where("path = 'jobs/run'").collect()] == [(2, 1, 1)]
    assert V.snippets(f, ["exit 1"], 1).first().snippet == "echo error here\nexit 1\ncp a b"
    assert rows(V.shebang_block(f)) == [("jobs/JOK", "#!/bin/bash", 2), ("jobs/run", None, 0)]
    s = A.scan_summary(V.scan_utilities(f)).where("category = 'explicit_exit'").first()
    assert (s.issues, s.files) == (1, ["jobs/run"])
    assert one(spark, V.file_type(F.col("p")), p="x/JRUN") == "job"


def test_logs(spark, rows):
    big = "x" * 9000 + "\n" + "line\n" * 100 + "srun: exited with code 137\nOut of memory"
    logs = spark.createDataFrame([(1, big), (2, "all fine"), (3, "DUE TO TIME LIMIT rc=9"), (4, "Segmentation fault")], "id int, text string")
    sig = {r.id: r for r in V.log_signal(logs).collect()}
    assert sig[1].exit_code == 137 and sig[1].omitted_bytes + len(sig[1].signal.encode()) == len(big) and sig[2].omitted_bytes == 0 and sig[3].exit_code == 9
    assert rows(V.classify_log(logs)) == [(1, "out_of_memory"), (2, "unknown"), (3, "timeout"), (4, "segfault")]
    n = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "Currently Loaded Modules", "1) m", "", "PATH=/x", "b"])], "id int, n int, line string")
    assert [r[2] for r in rows(V.denoise(n))] == ["a", "", "b"]


def test_scalars(spark):
    assert one(spark, T.duration_minutes(F.col("d")), d="1h 22m") == 82 and one(spark, T.duration_minutes(F.col("d")), d="soon") is None
    assert one(spark, T.iso_timestamp(F.col("d")), d="2024-01-01T00:00:00Z") is not None and one(spark, T.iso_timestamp(F.col("d")), d="bad") is None
    assert one(spark, T.shebang(F.col("d")), d="#!/usr/bin/env python\nx") == "python"
    assert one(spark, T.checklist_items(F.col("d")), d="- a\n1. b\ntext\nMust c") == ["a", "b", "Must c"]
    assert one(spark, T.repo_relative(F.col("d"), ["/home/me/repo/"]), d="/home/me/repo/src/x") == "src/x"
    assert one(spark, T.language_of_labels(F.array(F.lit("ShellScript"), F.lit("PythonFile")))) == "python"
    assert len(one(spark, T.event_fingerprint(F.array(F.lit("b"), F.lit("a")), F.lit("s"), F.lit("x")))) == 16
    assert one(spark, T.sanitised(F.create_map(F.lit("a"), F.lit(1)))) == {"a": "1"}
    assert one(spark, D.quality_d(F.lit(True), F.lit(True), F.lit(False), F.lit(300))) == pytest.approx(0.9)
    assert one(spark, D.quality_e(F.lit(300), F.lit(True), F.lit(True), F.lit(1), F.lit(True), F.lit(1.0), F.lit(1.0))) == pytest.approx(1.0)


def test_predicates(spark, rows):
    df = spark.createDataFrame([(1, "a/b.py"), (1, "x/.env"), (1, "x/c.tmp"), (1, "z/d.py")], "event int, path string")
    got = P.filter_paths(df, ["*.tmp"], [".env"], 2)
    assert rows(got) == [(1, "[redacted]", True), (1, "a/b.py", False)]
    assert one(spark, P.normalise_entity(F.col("d")), d="run.sh") == "run" and one(spark, P.classify_script(F.col("d")), d="r/ush/x") == "utility"
    t = P.code_test_case(spark.createDataFrame([("C768_atm_cycled_24h",)], "name string")).first()
    assert (t["mode"], t.resolution, t.hours, t.kind) == ("atmosphere", "high", 24, "cycled")
    n = spark.createDataFrame([("Abc",), ("xab",)], "name string")
    assert rows(P.suggest(n, "ab")) == [("Abc",), ("xab",)]


def test_sets_ranks_and_evaluation(spark, rows):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "rank int, id string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "rank int, id string")
    assert rows(U.compare_results(a, b, "ordered")) == [(2, "y", "z")]
    x = spark.createDataFrame([("k", 10.0), ("m", 10.0)], "key string, value double")
    y = spark.createDataFrame([("k", 10.9), ("m", 12.0)], "key string, value double")
    assert [r[0] for r in rows(U.compare_results(x, y, "numeric"))] == ["m"]
    rank = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q1", "c", 3), ("q2", "z", 1)], "query_id string, id string, rank int")
    rel = spark.createDataFrame([("q1", "a"), ("q1", "c"), ("q2", "n")], "query_id string, id string")
    got = {r.query_id: r for r in E.metrics(rank, rel, 5).collect()}
    assert (got["q1"].precision, got["q1"].recall, got["q1"].rr) == (0.4, 1.0, 1.0) and got["q2"].rr == 0.0
    assert got["q1"].ndcg == pytest.approx((1 + 0.5) / (1 + 1 / 1.5849625), abs=1e-5)
    assert one(spark, E.composite_score(*(F.lit(1.0) for _ in range(5)))) == pytest.approx(1.0)
    n = spark.createDataFrame([("e1", "e2", "CALLS", 0.5), ("e1", "zz", "USES", 0.9)], "anchor string, name string, rel string, score double")
    c = spark.createDataFrame([(1, "e1", "E2", "CALLS"), (2, "e1", "none", "CALLS")], "chain_id int, entity1 string, entity2 string, expected_relationship string")
    assert rows(E.chain_evaluation(c, n)) == [(1, True, 2, True), (2, False, None, False)]
    e = spark.createDataFrame([("e1", "E2", "CALLS"), ("e1", "zz", "USES")], "src string, dst string, rel string")
    w = spark.createDataFrame([("CALLS", 0.5), ("USES", 0.6)], "rel string, weight double")
    best = E.weight_search(e, c.where("chain_id = 1"), w).orderBy("mean_rank", F.desc("delta")).first()
    assert best.mean_rank == 1.0
    f = spark.createDataFrame([("p", "k", "a")], "path string, kind string, name string")
    assert rows(E.agreement(f, f.withColumn("name", F.lit("b")))) == [("p", "k", "a", "spurious"), ("p", "k", "b", "missing")]
    u = spark.createDataFrame([("a", None), ("b", 0.9), ("c", 0.1)], "url string, priority double")
    assert [r.url for r in W.by_priority(u).collect()] == ["b", "a", "c"]


def test_retrieval_composition(spark, rows):
    hits = spark.createDataFrame([("q", 1, 2, 0.5), ("q", 2, 1, 0.9)], "query_id string, id int, level int, score double")
    kids = spark.createDataFrame([(1, 5)], "community int, child int")
    s = spark.createDataFrame([(1, 2, 7)], "a int, b int, strength int")
    g = R.global_search(hits, kids, s, 2).orderBy("rank").collect()
    assert [r.id for r in g] == [1, 2] and g[0].children == [5]
    near = spark.createDataFrame([("q", "n", "R", 0.5, 16)], "anchor string, name string, rel string, score double, used int")
    ctx = R.context(near, spark.createDataFrame([("q", 1, 1)], "query_id string, id int, rank int")).first()
    assert ctx.tokens == 16 and len(ctx.documents) == 1
    nodes = spark.createDataFrame([("n1", "Forecast model")], "node_id string, name string")
    t = spark.createDataFrame([("q", "forecast")], "query_id string, text string")
    assert rows(R.explain(t, hits, nodes)) == [("q", "graph", "n1"), ("q", "text", "1"), ("q", "text", "2")]
    at = R.attribute(spark.createDataFrame([(None, "p")], "source string, path string")).first().attribution
    assert (at.source, at.path) == ("unknown", "p")
    c = spark.createDataFrame([(1, "t", "forecast model", "s", None), (2, "t", "forecast", "s", 0.1)], "id int, title string, text string, source string, quality double")
    assert [r.id for r in R.search_source(t, c, "s", 5).collect()] == [1]


def test_guided_context_has_extra_keys_and_counters(spark, rows):
    anchors = spark.createDataFrame([("run",), ("lone",), ("run",)], "anchor string")
    keys = spark.createDataFrame([("run", 3, "c"), ("run", 1, " b "), ("run", 2, "run"), ("run", 4, "b"), ("run", 5, " "), ("run", 6, None), ("other", 1, "x")], "anchor string, n int, key string")
    assert rows(R.probe_texts(anchors, keys)) == [("lone", "lone"), ("run", "run b c")]
    near = spark.createDataFrame([("run", "n1", "CALLS", 0.5, 40), ("run", "n2", "USES", 0.9, 90)], "anchor string, name string, rel string, score double, used int")
    hits = spark.createDataFrame([("run", i, i) for i in range(1, 9)], "query_id string, id int, rank int")
    got = {r.anchor: r for r in R.context(near, hits, anchors).collect()}
    assert [n.name for n in got["run"].neighbours] == ["n2", "n1"] and [d.id for d in got["run"].documents] == [1, 2, 3, 4, 5]
    assert (got["run"].tokens, got["run"].graph_count, got["run"].semantic_count) == (90, 2, 5)
    assert (got["lone"].tokens, got["lone"].graph_count, got["lone"].semantic_count, got["lone"].documents) == (0, 0, 0, None)


def test_stored_index(spark, tmp_path, monkeypatch):
    import numpy as np

    from lodestone.operators import vector_index as V

    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=(300, 8)), np.tile(rng.normal(size=8), (300, 1)), np.zeros((2, 8))])
    odd = [(900, None), (901, []), (902, [float("nan")] * 8), (903, [None] * 8)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + odd, "id int, vector array<double>")
    q = df.where("id < 20 or id in (310, 601, 902)").withColumnRenamed("id", "query_id")
    want = {(r.query_id, r.id): r.score for r in R.knn(q, df, 5).collect()}
    for rows in (4096, 50):  # half of all rows are one vector, whose cell is then dealt over several groups
        monkeypatch.setattr(V, "ROWS", rows)
        path = V.stored(df, str(tmp_path / f"index{rows}"))
        got = {(r.query_id, r.id): r.score for r in V.search(q, path, 5).collect()}
        assert len(want.keys() & got.keys()) / len(want) >= 0.9 and all(got[k] == s for k, s in want.items() if k in got)
        assert spark.read.parquet(f"{path}/vectors").select("id").distinct().count() == 602  # every usable vector
    whole = V.search(q, path, 5, probes=10**6)
    assert {(r.query_id, r.id) for r in whole.collect()} == want.keys()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "index50").rglob("*.parquet")}
    V.stored(df, path)
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "index50").rglob("*.parquet")}
    V.build(df.limit(0), str(tmp_path / "none"))
    assert V.search(q, str(tmp_path / "none"), 5).count() == 0


def test_stored_index_recall_on_the_embeddings(spark):
    """At least 0.9 of the true neighbours of every query, with folders pruned and no limit on cells."""
    from lodestone.queries import search as Q

    d = "/root/testdata/sf0.1"
    want = {(r.query_id, r.id) for r in Q.QUERIES["r02_knn"](spark, d).collect()}
    got = {(r.query_id, r.id) for r in Q.QUERIES["r03_ann"](spark, d).collect()}
    assert len({q for q, _ in want}) == 200 and len(want & got) / len(want) >= 0.9


def test_bounded_search_matches_all_scores(spark, rows):
    """Stop words of every document, ties, and queries of stop words alone."""
    import random

    from lodestone.operators import postings as PO

    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(["the", "of"] * rng.randrange(1, 5) + rng.choices(words, [1 / (1 + k) for k in range(60)], k=rng.randrange(30)))) for i in range(400)] + [(900, None), (901, "")], "id int, text string")
    asked = [(i, " ".join(["the", "of", "of", *rng.sample(words, 8)])) for i in range(12)] + [(20, "the of"), (21, "the"), (22, "nowhere"), (23, None), (24, ""), (25, "w3")]
    q = spark.createDataFrame(asked, "query_id int, text string")
    for k in (1, 5, 1000):
        want = R.top(R.bm25_scores(q, docs), k).select("query_id", "id", "score", "rank")
        assert rows(R.bm25(q, docs, k).select("query_id", "id", "score", "rank")) == rows(want)
    terms, parts = R.bm25_postings(q, docs)
    for unread in (0.0, 0.4, 0.9):
        got = PO.top_scores(terms, parts, 5, unread).select("query_id", "id", "score", "rank")
        assert rows(got) == rows(R.top(R.bm25_scores(q, docs), 5).select("query_id", "id", "score", "rank"))
    assert R.bm25(q.limit(0), docs, 5).count() == R.bm25(q, docs.limit(0), 5).count() == 0


def test_a_word_of_every_document_makes_no_candidates(spark, monkeypatch):
    from lodestone.operators import postings as PO

    docs = spark.range(2000).selectExpr("id", "concat('the ', if(id % 100 = 0, 'rare', 'x'), ' and the ', id % 7) as text")
    q = spark.range(30).selectExpr("id as query_id", "'the rare and' as text")
    sizes, write = {}, PO.materialise
    monkeypatch.setattr(PO, "materialise", lambda df, name="stage": sizes.setdefault(name, write(df, name)))
    assert R.bm25(q, docs, 5).count() == 150
    assert sizes["sums"].count() == 30 * 20  # not 30 x 2000


def test_packing_folds_match_python(spark):
    import random

    rng = random.Random(4)
    own = {f"d{i}": [("x" * rng.choice([0, 1, 30, 90, 200, 350, 900]), rng.random() < 0.6) for _ in range(rng.randrange(1, 25))] for i in range(40)}
    e = spark.createDataFrame([(d, n, t, c) for d, x in own.items() for n, (t, c) in enumerate(x)], "id string, n int, text string, splittable boolean")
    want = []
    for d, x in own.items():
        number = D.pack([len(t) for t, _ in x], [c for _, c in x], 400, 700)
        chunks = ["\n".join(t for (t, _), k in zip(x, number) if k == c) for c in range(number[-1] + 1)]
        to = D.merge_small([len(c) for c in chunks], 150)
        want += [(d, k, "\n".join(c for c, j in zip(chunks, to) if j == k)) for k in range(to[-1] + 1)]
    got = D.pack_chunks(e, 400, 700, 150)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_samples_are_limited_before_the_shuffle(spark):
    from lodestone.operators import ranking as W

    df = spark.range(5000).selectExpr("id", "if(id % 50 = 0, 'small', 'large') as c")
    got = W.sample_metadata(df, "c", 40, 2)
    assert sorted((r.c, r["count"]) for r in got.groupBy("c").count().collect()) == [("large", 20), ("small", 20)]
    assert got._jdf.queryExecution().toString().count("WindowGroupLimit") >= 2  # before and behind the exchange


def test_quality_reports(spark, rows):
    m = spark.createDataFrame([("a", 5.0), ("b", 50.0)], "metric string, value double")
    assert rows(Q.range_drift(m, spark.createDataFrame([("a", 0.0, 10.0), ("b", 0.0, 10.0)], "metric string, low double, high double"))) == [("b", 50.0, 0.0, 10.0)]
    assert one(spark, Q.health(F.lit(5), F.lit(0))) == "degraded"
    f = spark.createDataFrame([("t", "b", "full", "p", None), ("t", "b", "full", "q", "bad")], "tenant string, branch string, mode string, path string, error string")
    assert rows(Q.run_report(f)) == [("t", "b", "full", 2, 1, 1)]
    s = spark.createDataFrame([("a", "c1", True, 10, None), ("b", "c2", True, 1, "2024-01-01 00:00:00"), ("c", "c3", False, 9, None)], "name string, collection string, enabled boolean, doc_count long, last_ingested string").withColumn("last_ingested", F.to_timestamp("last_ingested"))
    got = rows(Q.gap_report(s, spark.createDataFrame([("c1", 10), ("c2", 1)], "collection string, n long"), "2024-03-01 00:00:00").select("collection", "status"))
    assert got == [("c1", "missing"), ("c2", "stale")]
    x = spark.createDataFrame([("r", "py", 0), ("r", "sh", 1), ("r", "py", 2), ("r", "sh", 3)], "repo string, language string, seq int")
    assert rows(A.primary_language(x)) == [("r", "py")]
    y = spark.createDataFrame([("web", "a", "c", True, 2), ("git", "a", "c", False, 3)], "source_type string, scope string, collection_target string, enabled boolean, doc_count long")
    assert len(A.source_summary(y).collect()) == 4


def test_file_sources(spark, rows, tmp_path):
    (tmp_path / "t/.git").mkdir(parents=True)
    (tmp_path / "t/.git/x.sh").write_text("no")
    (tmp_path / "t/a.sh").write_text("echo é")
    assert [r.content for r in S.read_tree(spark, str(tmp_path / "t"), "*.sh").collect()] == ["echo é"]
    (tmp_path / "log.jsonl").write_text('{"a": 1, "ts": "1"}\nbroken\n{"a": 2, "ts": "2"}\n')
    assert [r.a for r in S.read_jsonl(spark, str(tmp_path / "log.jsonl"), "a int, ts string", "ts", 1).collect()] == [2]
    (tmp_path / "g.csv").write_text('~id,~from,~to,~label,line,w,tags,empty\n1,,,File:a.py,5,0.5,"[""x""]",\n2,1,3,,x,,,\n')
    got = {(r.id, r.key): (r.kind, r.label, r.name) for r in S.read_graph_csv(spark, str(tmp_path / "g.csv")).collect()}
    assert got == {("1", "line"): ("int", "File", "a.py"), ("1", "w"): ("float", "File", "a.py"), ("1", "tags"): ("json", "File", "a.py"), ("2", "line"): ("string", "Node", None)}
    nodes = spark.createDataFrame([("1", "A", ["x"])], "node_id string, label string, tags array<string>")
    S.write_graph_csv(nodes, spark.createDataFrame([("1", "2", "R")], "src string, dst string, rel string"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/edges")).first()["~from"] == "1"
    S.write_jsonl(nodes, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    src = [{"name": "a", "source_type": "web", "collection_target": "c", "embedding_profile": "p", "scope": "all", "type_fields": {"url": "u"}}, {"name": "a", "source_type": "git", "collection_target": "zz", "embedding_profile": "p", "scope": "none", "enabled": False, "type_fields": {}}]
    (tmp_path / "m.json").write_text(json.dumps({"sources": src}, indent=1))
    m = S.read_manifest(spark, str(tmp_path / "m.json"))
    assert S.select_sources(m).count() == 1 and S.select_sources(m, "git", False).count() == 1
    bad = {r[1] for r in rows(S.manifest_violations(m, ["p"], ["c"], {"git": ["repo"]}, ["all"]))}
    assert bad == {"duplicate_name", "unknown_collection", "missing_repo", "illegal_scope"}


def test_embed_udf(spark):
    df = spark.createDataFrame([("ab",), (None,)], "text string")
    got = H.embed(df, lambda: lambda xs: [[float(len(x))] for x in xs]).collect()
    assert [r.vector for r in got] == [[2.0], [0.0]]
    assert H.parse(files(spark, a="x"), lambda p, c: [(p, c)], "path string, name string", ["path", "name"]).first().name == "x"


def test_provenance_and_functions(spark, rows):
    df = D.with_provenance(spark.createDataFrame([(1,)], "id int"), "s", "c", False, "p", 8).first()
    assert (df.prov_source, df.prov_dimension) == ("s", 8)
    lines = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("p", 3, "c")], "path string, n int, line string")
    fn = spark.createDataFrame([("p", "f", 1, 2)], "path string, name string, first int, last int")
    assert D.chunk_functions(lines, fn).first().text == "# p f\na\nb"
    hits = spark.createDataFrame([("cat", 1)], "query_id string, id int")
    chunks = spark.createDataFrame([(1, "- one\n- two")], "id int, text string")
    assert rows(V.checklist_report(hits, chunks)) == [("cat", 1, "one"), ("cat", 1, "two")]


def test_experiments_and_multi_search(spark, rows):
    f = files(spark, base__config_a="A=1", exp1__config_a="B=2\nC=3")
    got = rows(X.experiment_edges(f, 1))
    assert got == [("base/config_a", "A", "SETS_ENV"), ("base/config_a", "base", "PART_OF"), ("exp1/config_a", "B", "SETS_ENV"), ("exp1/config_a", "base/config_a", "RESOLVES_FROM"), ("exp1/config_a", "exp1", "PART_OF")]
    a = spark.createDataFrame([("q", 1, "same", 0.5)], "query_id string, id int, content string, score double")
    b = spark.createDataFrame([("q", 2, "same", 0.9), ("q", 3, None, 0.1)], "query_id string, id int, content string, score double")
    assert sorted((r.id, r.collection) for r in R.multi_search({"a": a, "b": b}, 5).collect()) == [(2, "b"), (3, "b")]


def test_nearest_ids_across_gaps(spark):
    from lodestone.operators import search as R

    ids = [-5000, -3, 0, 1, 2, 40, 45, 1000, 1001, 2**40, 2**40 + 9]
    v = spark.createDataFrame([(i,) for i in ids], "id long")
    for k in (1, 3, 20):
        got = sorted((r.query_id, r["rank"], r.id) for r in R.nearest_ids(v.withColumnRenamed("id", "query_id"), v, k).collect())
        want = [(q, n + 1, i) for q in ids for n, i in enumerate(sorted(ids, key=lambda i: (abs(i - q), i))[:k])]
        assert got == sorted(want)
    assert R.nearest_ids(v.limit(0).withColumnRenamed("id", "query_id"), v.limit(0), 3).count() == 0


def test_hybrid_texts_against_brute_force(spark):
    import math
    from collections import Counter

    from lodestone.operators import search as R
    from lodestone.queries.search import hybrid_texts

    texts = [f"w{i} w{i % 3} w{i % 5} common" for i in range(25)]
    asked = {7: "w1 w4 common", 9: "w24", 11: "nothing here"}
    q = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    x = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in hybrid_texts(q, x, 30, 30).collect()}
    rows = {r.id: r.vector for r in R.hash_embed(spark.createDataFrame([(f"q{k}", t) for k, t in asked.items()] + [(f"d{k}", t) for k, t in enumerate(texts)], "id string, text string")).collect()}
    docs = [t.split() for t in texts]
    df, mean = Counter(w for d in docs for w in set(d)), sum(map(len, docs)) / len(docs)
    for k, t in asked.items():
        want = {}
        for i, d in enumerate(docs):
            bm = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * d.count(w) * 2.2 / (d.count(w) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w in set(t.split()) if w in d)
            a, b = rows[f"q{k}"], rows[f"d{i}"]
            norm = math.sqrt(sum(u * u for u in a) * sum(u * u for u in b))
            want[i] = 2 * bm + (sum(u * v for u, v in zip(a, b, strict=True)) / norm if norm else 0)
        mine = {i: s for (kk, _), (i, s) in got.items() if kk == k}
        assert set(mine) == set(want) and all(abs(mine[i] - want[i]) < 1e-4 for i in want)


def test_snippets_take_patterns_as_they_are(spark, rows):
    f = files(spark, a="one\nset x\nrc=12 it's \"q\"\nfour\nfoobar\nfoo bar")
    assert [(r[1], r[2].split("\n")[0]) for r in rows(V.snippets(f, [r"\d+", r"it's \"q\""], 1))] == [(3, "set x")]
    assert [r[1] for r in rows(V.snippets(f, [r"\bfoo\b"], 0))] == [6]
    assert rows(V.snippets(f, [], 0)) == []


def test_relationship_weights_and_own_ones(spark):
    from lodestone.operators.traversal import neighborhood
    from lodestone.sources.star_graph import REL_WEIGHTS

    e = spark.createDataFrame([("a", "b", "EXECUTES"), ("a", "c", "SOURCES"), ("a", "d", "OTHER")], "src string, dst string, rel string")
    anchors = spark.createDataFrame([("a",)], "anchor string")
    got = {r.name: r.score for r in neighborhood(e, anchors, 1).collect()}
    assert len(REL_WEIGHTS) == 27 and got == {"b": 0.5, "c": 0.475, "d": 0.15}
    assert {r.name: r.score for r in neighborhood(e, anchors, 1, weights={"OTHER": 1.0}).collect()} == {"b": 0.15, "c": 0.15, "d": 0.5}


def test_logs_of_one_id_stay_apart(spark):
    logs = spark.createDataFrame([(1, "timed out"), (1, "oom-kill")], "id int, text string")
    assert sorted(r.failure for r in V.classify_log(logs).collect()) == ["out_of_memory", "timeout"]


def test_small_counts_bytes(spark):
    from lodestone.plans.stages import small

    df = spark.createDataFrame([(1, "x" * 1000, [1, 2])], "a int, b string, c array<int>")
    assert small(df) and not small(df, size=1000) and not small(df, rows=0)


def test_knn_odd_vectors(spark, rows):
    v = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "b", [0.0, 0.0]), (4, "b", [-1.0, 0.0]), (5, "a", None), (6, "a", [None, 1.0]), (7, "a", [1.0, 0.0, 0.0]), (8, "a", []), (9, "a", [float("nan"), 1.0])],
        "id int, kind string, vector array<double>",
    )
    q = spark.createDataFrame([("x", [2.0, 0.0]), ("y", None), ("z", [0.0, 0.0, 3.0])], "query_id string, vector array<double>")
    assert rows(R.knn(q, v, 3).select("query_id", "id", "score", "rank")) == [("x", 1, 1.0, 1), ("x", 2, 1.0, 2), ("x", 3, 0.0, 3), ("z", 7, 0.0, 1)]
    assert rows(R.knn(q, v, 1, by="kind").select("query_id", "id", "kind", "rank")) == [("x", 1, "a", 1), ("x", 3, "b", 1), ("z", 7, "a", 1)]
    assert R.knn(q, v.limit(0), 3).count() == 0 and R.knn(q.limit(0), v, 3).count() == 0


def test_knn_over_many_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(R, "BLOCK", 16)
    x = np.random.default_rng(1).normal(size=(120, 5))
    df = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "id int, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(u @ u.T, 6)
    want = {(i, int(j), n + 1) for i in range(40) for n, j in enumerate(sorted(range(120), key=lambda j: (-score[i, j], j))[:4])}
    got = R.knn(df.where("id < 40").withColumnRenamed("id", "query_id"), df, 4)
    assert {(r.query_id, r.id, r.rank) for r in got.collect()} == want


def test_percentiles_with_ties_and_nulls(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    data = [("a", float(v)) for v in rng.integers(0, 9, 101)] + [("b", 3.0), (None, 1.0), (None, 2.0), ("a", None)]
    got = {r.k: r for r in E.latency_percentiles(spark.createDataFrame(data, "k string, v double"), "k", "v", 0.9).collect()}
    assert set(got) == {"a", "b", None}
    a = sorted(v for k, v in data if k == "a" and v is not None)
    assert (got["a"].nearest, got["a"].floor_index) == (a[90], a[90]) and abs(got["a"].linear - np.quantile(a, 0.9)) < 1e-6
    assert (got["b"].nearest, got["b"].floor_index, got["b"].linear) == (3.0, 3.0, 3.0) and abs(got[None].linear - 1.9) < 1e-6


def test_keyword_ranks(spark, rows):
    x = spark.createDataFrame([("q", 1, "none", ["Alpha", "beta"]), ("q", 2, "ALPHA", ["Alpha", "beta"]), ("q", 9, None, ["Alpha", "beta"]), ("e", 1, "x", [])], "query_id string, rank int, text string, expected array<string>")
    assert rows(E.keyword_metrics(x, 5)) == [("e", 0.0, 0.0, 0.0, 0.0), ("q", 0.5, 0.5, 0.5, 0.5)]


def test_topics_of_any_length(spark, rows):
    n = spark.createDataFrame([(1, "aab"), (2, "b"), (3, None), (4, "Forecast model")], "node_id int, name string")
    t = spark.createDataFrame([("1", "B"), ("2", "ab"), ("3", "cast m"), ("4", ""), ("5", None)], "query_id string, text string")
    hits = spark.createDataFrame([], "query_id string, id string")
    assert rows(R.explain(t, hits, n).select("query_id", "id")) == [("1", "1"), ("1", "2"), ("2", "1"), ("3", "4")]
