import datetime
import json
import subprocess
import textwrap

from pyspark.sql import functions as F

from graphloom import config
from graphloom.extract import base, braces, config_yaml, markdown, python
from graphloom.facade import Workspace
from graphloom.functions import text as X
from graphloom.operators import chunking
from graphloom.sources import files, logs, store
from graphloom.streaming import events as S

PY = '''"""Module doc."""
import os
from a.b import c
from . import d

X = 1


class Foo(Base, m.Other):
    """Foo doc."""

    @deco
    def run(self, a: int, *args, b=2, **kw) -> str:
        return self.helper(os.path.join("x"))


async def main(x):
    Foo().run(1)
    helper(main(2))
'''


def names(c, kind):
    return [r["name"] for r in c.rows if r["row"] == "entity" and r["kind"] == kind]


def targets(c, kind):
    return [r["target_id"] for r in c.rows if r["row"] == "relationship" and r["kind"] == kind]


def test_python():
    c = python.extract("p/mod.py", PY)
    assert names(c, "class") == ["Foo"] and names(c, "method") == ["run"] and names(c, "function") == ["main"]
    run = next(r for r in c.rows if r.get("name") == "run")
    assert run["id"] == "p/mod.py::Foo.run" and run["signature"] == "def run(self, a: int, *args, **kw) -> str" and run["source_code"].lstrip().startswith("def run")
    assert next(r for r in c.rows if r.get("name") == "main")["signature"] == "async def main(x)"
    assert targets(c, "imports") == ["external::os", "external::a.b"] and targets(c, "inherits") == ["ref::Base", "ref::m.Other"]
    assert sorted(targets(c, "calls")) == ["ref::Foo", "ref::helper", "ref::main", "ref::os.path.join", "ref::run", "ref::self.helper"]
    assert python.extract("x.py", "def (").rows[0]["row"] == "error"


def test_markdown_and_yaml():
    c = markdown.extract("d/a.md", "# Top\n\nAbout it.\n\n### Deep\n## Next One\n```\n# fenced\n```\n")
    assert names(c, "section") == ["Top", "Deep", "Next One", "fenced"]
    assert {r["name"]: (r["line_start"], r["line_end"]) for r in c.rows if r.get("kind") == "section"} == {"Top": (1, 7), "Deep": (5, 5), "Next One": (6, 7), "fenced": (8, 9)}
    assert [r["source_id"] for r in c.rows if r["row"] == "relationship"] == ["d/a.md::a", "d/a.md::top", "d/a.md::top", "d/a.md::a"]
    assert c.rows[0]["docstring"] == "About it."
    y = config_yaml.extract("c.yml", "a:\n  b: 1\n  c: [1, 2]\nd: null\ne: " + "x" * 120)
    got = {r["qualified_name"]: (r["line_start"], r["metadata"]) for r in y.rows if r.get("kind") == "config_key"}
    assert got["a.b"] == (2, {"value_type": "int", "value_preview": "1"}) and got["a"][1]["value_preview"] == "{...}" and got["a.c"][1]["value_preview"] == "[2 items]"
    assert got["d"][1] == {"value_type": "NoneType", "value_preview": "None"} and len(got["e"][1]["value_preview"]) == 100
    assert config_yaml.extract("c.yml", "a: [").rows[0]["row"] == "error"


def test_javascript_and_java():
    js = """import { x } from 'lib';
    // class No {}
    class Dog extends Animal { constructor(n) { super(n); this.set(n); } bark() { if (a) { console.log("f()"); } } }
    function make() { return new Dog(go(1)); }
    const f = (a) => { make(); };
    """
    c = braces.javascript("a.js", js)
    assert names(c, "class") == ["Dog"] and names(c, "method") == ["constructor", "bark"] and names(c, "function") == ["make", "f"]
    assert targets(c, "imports") == ["external::lib"] and targets(c, "inherits") == ["ref::Animal"]
    assert targets(c, "calls") == ["ref::this.set", "ref::console.log", "ref::Dog", "ref::go", "ref::make"]
    assert not [r for r in c.rows if r["row"] == "error"]
    c = braces.javascript("b.js", "const r = (x) => x.replace(/[{(\"']/g, go(a / b / 2));\nfunction f() { h(/}/) }\nclass A { m() { n(); }")
    assert names(c, "function") == ["f", "r"] and "ref::go" in targets(c, "calls") and names(c, "class") == ["A"]
    assert [r["error"] for r in c.rows if r["row"] == "error"] == ["b.js: braces do not match"]
    ja = """package p; import java.util.List;
    public class Cat extends Pet implements Runs {
      private int n = 1;
      public Cat(int n) { this.n = n; }
      @Override public void run() throws E { helper(); List<String> x = new ArrayList<>(); for (;;) { x.add("q"); } }
      static int helper() { return 1; }
    }
    interface Runs { void run(); }
    """
    c = braces.java("Cat.java", ja)
    assert names(c, "class") == ["Cat", "Runs"] and names(c, "method") == ["Cat", "run", "helper", "run"]
    assert targets(c, "imports") == ["external::java.util.List"] and targets(c, "inherits") == ["ref::Pet"]
    assert targets(c, "calls") == ["ref::helper", "ref::ArrayList", "ref::x.add"]


def tree(root):
    for name, text in {"mod.py": PY, "pkg/other.py": "def helper(x):\n    return x\n", "skip/no.py": "x = 1", "keep.txt": "no", "README.MD": "# R\n", "venv/v.py": "", "bad.py": "def (", "gen_a.py": "a=1", "gen_b.py": "b=1"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def test_scan_rules(spark, tmp_path):
    got = files.scan(spark, tree(tmp_path), "skip/\ngen_*.py\n!gen_b.py\n# note")
    assert sorted(r.relative_path for r in got.collect()) == ["README.MD", "bad.py", "gen_b.py", "mod.py", "pkg/other.py"]
    try:
        files.scan(spark, str(tmp_path / "none"))
        raise AssertionError
    except ValueError:
        pass


def test_workspace(spark, tmp_path):
    root = tree(tmp_path / "src")
    w = Workspace.analyze(spark, root, "skip/\ngen_*\n")
    helper = f"{root}/pkg/other.py::helper"
    assert {r.id for r in w.callers(helper).collect()} == {f"{root}/mod.py::main"}
    assert w.errors.count() == 1
    assert {r.id for r in w.trace_calls(helper, "callers", 2).collect()} >= {f"{root}/mod.py::main"}
    assert {r.stat: r.n for r in w.stats().collect()}["entities_class"] == 1
    w.save(str(tmp_path / "out"))
    v = Workspace.load(spark, str(tmp_path / "out"))
    assert v.search("FOO", 5).count() == 2
    hits = v.hits("where is the helper function", 5).collect()
    assert any(h.entity_id == helper for h in hits)
    answer = v.query("Where is helper defined").first()
    assert answer.task == "locate" and "helper" in answer.text and answer.answer_from in ("local", "model")
    assert v.query("x", 0).first().mode == "none"
    other = Workspace.load(spark, str(tmp_path / "out"), config.Settings(embedding=config.Embedding(dimension=7)))
    fallback = other.query("Where is helper defined").first()
    assert other.chunks is None and fallback.mode == "lexical" and "helper" in fallback.text
    header = [r.content for r in v.chunks.filter("type = 'module_header'").collect()]
    assert any('"""Module doc."""' in h for h in header)
    assert v.context(helper, "explain").first().included
    assert answer.selected[0].tokens > 0 and [x["rank"] for x in answer.evidence] == list(range(1, len(answer.evidence) + 1))
    assert answer.evidence[0].source == "retrieved" and fallback.evidence[0].source == "lexical" and fallback.evidence[0].entity_id == helper
    assert all(x.source == "retrieved" for x in v.query("Where is helper defined", depth=0).first().evidence)
    assert v.errors.count() == 1


def test_plug_ins(spark, tmp_path):
    w = Workspace.analyze(spark, tree(tmp_path / "src"))
    words = X.counted_with(lambda t: t.split(" "), " ".join)
    w.counter = words
    found = spark.createDataFrame([("a b c", 2), ("", 1), (None, 1)], "t string, n int").select(words.count(F.col("t")).alias("c"), words.truncate(F.col("t"), F.col("n")).alias("s")).collect()
    assert [(r.c, r.s) for r in found] == [(3, "a b"), (0, ""), (0, "")]
    made = w.context(f"{w.entities.filter("name = 'helper'").first().id}", "explain").first()
    assert made.tokens > 0 and made.text.startswith("# ")

    w.scorer = lambda hits, asked, chunks, limit: hits.select("qid", "id", F.lit(7.0).alias("score"), "rank")
    assert {r.score for r in w.hits("helper function", 3, depth=0).collect()} == {7.0}
    w.scorer = lambda hits, asked, chunks, limit: 1 / 0
    assert {r.score for r in w.hits("helper function", 3, depth=0).collect()} != {7.0}


def test_tools_and_reload(spark, tmp_path):
    root = tree(tmp_path / "src")
    Workspace.analyze(spark, root).save(str(tmp_path / "out"))
    w = Workspace.load(spark, str(tmp_path / "out"))
    helper = f"{root}/pkg/other.py::helper"
    call = lambda name, **given: json.loads(w.tool(name, given))
    assert helper in [r["id"] for r in call("search_codebase", query="helper")]
    assert "helper" in call("get_entity_context", entity_id=helper)["text"]
    assert "error" in call("get_entity_context", entity_id="no such entity at all")
    assert [r["id"] for r in call("trace_calls", entity_id=helper, direction="callers")] == [f"{root}/mod.py::main"]
    assert call("retrieve_context_for_query", query="Where is helper defined", expand_deps=False)["mode"] == "semantic"
    assert call("nothing") == {"error": "Unknown tool: nothing"} and "query" in call("search_codebase")["error"]
    (tmp_path / "src" / "later.py").write_text("def later_on():\n    return 1\n")
    Workspace.analyze(spark, root).save(str(tmp_path / "out"))
    assert w.reload().search("later", 5).count() == 2


def test_own_ignore_file_and_extensions_in_any_case(spark, tmp_path, monkeypatch):
    root = tree(tmp_path)
    (tmp_path / ".gitignore").write_text("skip/\ngen_*\n")
    (tmp_path / "pkg" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "pkg" / "__init__.py").write_text("x = 1\n")
    (tmp_path / "pkg" / "deep" / "er" / "x.ts").write_text("")
    (tmp_path / ".ci").mkdir()
    (tmp_path / ".ci" / "run.yml").write_text("a: 1\n")
    (tmp_path / "pkg" / "back").symlink_to(tmp_path)
    want = [".ci/run.yml", "README.MD", "bad.py", "mod.py", "pkg/__init__.py", "pkg/deep/er/x.ts", "pkg/other.py"]
    monkeypatch.setattr(files, "FOLDERS", 2)  # the rest is walked in tasks
    assert sorted(r.relative_path for r in files.listing(spark, root).collect()) == want
    assert sorted(r.relative_path for r in files.listing(spark, f"file://{root}").collect()) == want
    got = {r.relative_path: bytes(r.content) for r in files.scan(spark, root).collect()}
    assert sorted(got) == want and got[".ci/run.yml"] == b"a: 1\n" and got["pkg/deep/er/x.ts"] == b""
    gone = files.listing(spark, root).filter("relative_path = 'mod.py'").withColumn("path", F.lit(f"{root}/gone.py"))
    assert files.with_content(gone).first().content is None
    assert [r.error for r in files.extracted(files.with_content(gone)).collect()] == [f"{root}/gone.py: cannot be read"]
    monkeypatch.setattr(files, "FOLDERS", 256)
    for x in ("pkg/__init__.py", "pkg/deep/er/x.ts", ".ci/run.yml"):
        (tmp_path / x).unlink()
    assert sorted(r.relative_path for r in files.scan(spark, root).collect()) == ["README.MD", "bad.py", "mod.py", "pkg/other.py"]


def test_sources_that_are_missing_or_broken_make_error_rows(spark, tmp_path):
    root = tree(tmp_path / "src")
    (tmp_path / "bad.xml").write_text("<coverage><class")
    (tmp_path / "good.xml").write_text('<coverage line-rate="1"><class filename="a&amp;b.py" line-rate="1"/></coverage>')
    w = Workspace.analyze(spark, root, history=str(tmp_path / "none.txt"), coverage=str(tmp_path / "bad.xml"))
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in w.errors.collect()}
    assert errors["none.txt"] == "no exported git log there" and "bad.xml" in errors and w.entities.filter("kind = 'coverage_report'").isEmpty()
    e, r = logs.cobertura(spark, str(tmp_path / "*.xml"), "/r")
    assert e.first().metadata["timestamp"].isdigit() and r.filter("kind = 'covers'").first().target_id == "/r/a&b.py::a&b"
    assert logs.cobertura_errors(spark, str(tmp_path / "none.xml")).count() == 1


def test_usage_log(spark, tmp_path):
    path = str(tmp_path / "usage")
    assert logs.recorded(spark, path).count() == 0
    now = datetime.datetime(2024, 3, 5, 12, tzinfo=datetime.UTC)
    for hours in (80, 30, 13, 1):
        logs.record_usage(spark.createDataFrame([("m", now - datetime.timedelta(hours=hours))], "model string, ts timestamp"), path)
    assert logs.recorded(spark, path).count() == 4
    assert logs.forget_usage(spark, path, now) == 1  # that of 30 hours ago shares its day with what still counts
    assert logs.recorded(spark, path).count() == 3 and logs.forget_usage(spark, path, now) == 0


def test_module_header(spark):
    rows = [('\n# c\n"""a\nb"""\nimport x', '# c\n"""a\nb"""'), ("x = 1\n\nimport y", "x = 1"), ("'''one'''\ny", "'''one'''"), ("import z", "")]
    df = spark.createDataFrame(rows, "t string, want string").select(chunking.module_header(F.col("t")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_git_log_and_coverage(spark, tmp_path):
    repo = tmp_path / "g"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=a@x", "-C", str(repo), *a], check=True, capture_output=True, text=True).stdout
    run("init", "-q")
    for k in (1, 2):
        (repo / "m.py").write_text("x\n" * k)
        run("add", ".")
        run("commit", "-qm", f"feat: step {k}")
    (tmp_path / "log.txt").write_text(run("log", "--numstat", f"--format={logs.GIT_FORMAT}"))
    log = logs.git_log(spark, str(tmp_path / "log.txt"))
    e, r = logs.history_graph(log, "/root/x")
    assert {x.kind: x["count"] for x in e.groupBy("kind").count().collect()} == {"author": 1, "commit": 2}
    assert {x.kind: x["count"] for x in r.groupBy("kind").count().collect()} == {"authored": 2, "modified": 2, "changed_by": 2}
    m = r.filter("kind = 'modified'").first()
    assert m.target_id == "/root/x/m.py::m" and m.metadata["insertions"] == "1"
    (tmp_path / "cov.xml").write_text('<coverage line-rate="0.5" timestamp="9"><packages><package><classes><class filename="src/a.py" line-rate="1.0" lines-covered="3" lines-valid="4"/><class name="nofile"/></classes></package></packages></coverage>')
    e, r = logs.cobertura(spark, str(tmp_path / "cov.xml"), "/r")
    x = e.first()
    assert x.id == "coverage::cov.xml" and x.metadata == {"timestamp": "9", "line-rate": "0.5", "branch-rate": "0"}
    assert {(y.kind, y.source_id, y.target_id) for y in r.collect()} == {("covers", "coverage::cov.xml", "/r/src/a.py::a"), ("executed_by", "/r/src/a.py::a", "coverage::cov.xml")}
    assert r.filter("kind = 'covers'").first().metadata["hits"] == "3/4"


def test_json_store_usage_and_truth(spark, tmp_path):
    loc = '{"file_path": "f", "line_start": 1, "line_end": 2, "column_start": 0, "column_end": 0}'
    (tmp_path / "s.json").write_text(f'{{"version": "1.0", "entities": {{"a": {{"id": "a", "kind": "function", "name": "A", "qualified_name": "m.A", "location": {loc}, "metadata": {{}}}}}}, "relationships": [{{"source_id": "a", "target_id": "b", "kind": "calls", "metadata": {{}}}}]}}')
    e, r = store.load_json(spark, str(tmp_path / "s.json"))
    assert e.first().line == 1 and r.first().kind == "calls"
    store.export_json(e, r, str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).count() == 2
    store.export_json(e, r, str(tmp_path / "y"), logs.error_rows(spark, ("f", "broken")))
    e2, r2, errors = store.load_lines(spark, str(tmp_path / "y"))
    assert e2.select("id", "kind", "line").collect() == e.select("id", "kind", "line").collect() and r2.first().target_id == "b"
    assert errors.first().error == "broken" and r2.first().ord.seq == 0
    (tmp_path / "u.json").write_text('{"m": [1700000000.5, 1700000001.0]}')
    assert logs.usage(spark, str(tmp_path / "u.json")).count() == 2
    (tmp_path / "bad.json").write_text("{nope")
    assert logs.usage(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "t.json").write_text('[{"query": "q", "expected_ids": ["a", "b"]}, {"query": "r", "expected_ids": []}]')
    assert logs.ground_truth(spark, str(tmp_path / "t.json")).count() == 3


def test_stream_replaces_all_rows_of_a_key(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    table = S.KeyedTable(spark, str(tmp_path / "t"), ["file"])
    versions = []

    def upsert(batch, k):
        table.replace(batch, k)
        versions.append(k)

    for text in ('{"file":"a","n":1}\n{"file":"a","n":2}\n{"file":"b","n":3}', '{"file":"a","n":9}'):
        (source / f"{len(versions)}.json").write_text(text)
        S.drain(spark.readStream.schema("file string, n int").json(str(source)), upsert, str(tmp_path / "c"), "append")
    assert sorted((r.file, r.n) for r in table.read(max(versions)).collect()) == [("a", 9), ("b", 3)]


def test_settings(tmp_path):
    from graphloom import config

    assert config.load(None).threshold == 0.8
    (tmp_path / "m.yaml").write_text(textwrap.dedent("models:\n  - name: x\n    rpm: 3\n"))
    assert config.load(str(tmp_path / "m.yaml")).models[0].rpm == 3
    more = config.parse("embedding_models: [{name: e, tokens_free_tier_limit: 5}]\nreranking_models: [{name: r, provider: p}]\nchunking: {max_chars: 50, overlap: 5}")
    assert more.embedding_models[0].tokens == 5 and more.reranking_models[0].provider == "p" and more.chunking.max_chars == 50 and more.models == []
    (tmp_path / "bad.yaml").write_text("a: [")
    assert config.load(str(tmp_path / "bad.yaml")).models == []


def test_changed_files_are_indexed_again(spark, tmp_path):
    from graphloom.streaming.watch import FileIndexer

    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("def one():\n    return 1\n")
    (root / "bad.py").write_text("def (")
    (root / "z.py").write_text("def last():\n    return 2\n")
    index = FileIndexer(spark, str(root), str(tmp_path / "index"))
    assert index.chunks() is None and index.sync() == 3 and index.sync() == 0
    shown = lambda: {r["content"] for r in index.chunks().filter("type = 'code'").collect()}
    assert any("def one" in c for c in shown()) and any("def last" in c for c in shown())
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in index.listing().collect()}
    assert errors["a.py"] is None and errors["z.py"] is None and "syntax error" in errors["bad.py"]
    (root / "a.py").write_text("def two_of_them():\n    return 1\n")
    (root / "z.py").write_text("def (")
    (root / "new.md").write_text("# Title\n\ntext\n")
    assert index.sync() == 3
    assert any("two_of_them" in c for c in shown()) and not any("def one" in c or "def last" in c for c in shown())
    (root / "z.py").write_text("def again():\n    return 2\n")
    stream = index.watch(str(tmp_path / "ticks"), "1 second")
    try:
        for _ in range(60):
            if any("def again" in c for c in shown()):
                break
            stream.awaitTermination(1)
    finally:
        stream.stop()
    assert any("def again" in c for c in shown()) and stream.exception() is None
