import json
import os
import re

import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.functions.template import filled, sql_of
from tessera.plans import site
from tessera.sources import files, pages, sinks


def test_template(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 'a<b> & "c" ''d''', array(named_struct('n', 1, 'x', 0.5D), named_struct('n', 2, 'x', null)), 65.9D), (2, null, array(), null) AS t(id, s, xs, t)""")
    out = lambda text: [r[0] for r in df.orderBy("id").select(filled(text).alias("o")).collect()]
    assert out("{{ s }}|{{ s | raw }}|{{ s | json }}") == ["a&lt;b&gt; &amp; &quot;c&quot; &#x27;d&#x27;|a<b> & \"c\" 'd'|\"a\\u003cb> & \\\"c\\\" 'd'\"", "||null"]
    assert out("{% for x in xs %}[{{ x.n }}{% if x.x IS NULL %}-{% elif x.x > 0.4 %}{{ x.x | number }}{% else %}?{% endif %}]{% endfor %}.") == ["[10.5][2-].", "."]
    assert out("{{ t | clock }} {{ t | number }} {{ 2.0 | number }} {{ xs | json }}") == ['1:05 65.9 2.0 [{"n":1,"x":0.5},{"n":2}]', "0:00  2.0 []"]
    assert out("a\n  {% if id = 1 %}\n  b\\n'c'\n  {% endif %}\nd {% if id = 1 %}e{% endif %}\n") == ["a\n  b\\n'c'\nd e\n", "a\nd \n"]
    assert out("{% for x in xs %}{% for y in xs %}{{ x.n }}{{ y.n }} {% endfor %}{% endfor %}{{ id || 'x' }}") == ["11 12 21 22 1x", "2x"]
    for bad in ("{% if id %}", "{% endfor %}", "{% for x xs %}{% endfor %}", "{% what %}", "{% if a %}{% endfor %}"):
        with pytest.raises(ValueError):
            sql_of(bad)


HEAD = "page_id string, title string, full_text string, audio_file string, duration double, citation string"


def rendered(spark, words):
    df = words({"p": [("a<", 0, 0), ("b", 0.5, 1.23456)], "q": [("c", 0, 1), ("d", 2, 3.0)]}).withColumn("line_break_after", F.col("word_idx") == 1).withColumn("is_title", F.col("word_idx") == 0)
    head = spark.createDataFrame([("p", "T<", "t\nx", "livro4.mp3", 65.0, "<em>C</em>"), ("q", None, "t\n" + "x" * 90, "other.wav", 2.0, None)], HEAD)
    return df, head


def test_pages(spark, words):
    df, head = rendered(spark, words)
    metrics = spark.createDataFrame([("p", 0.91234, 12.345, 3, 4)], "page_id string, average_confidence double, timing_precision_ms double, gaps_preserved long, gaps_filled long")
    context = sinks.page_context(df, head, metrics, project="P")
    got = {r.page_id: r.html for r in sinks.html_pages(context).collect()}
    p, q = got["p"], got["q"]
    assert "<title>T&lt; - P</title>" in p and "--accent: #61a165; --page: rgb(224, 249, 188)" in p and sinks.SCRIPT in p and '<p class="citation"><em>C</em></p>' in p and 'class="word no-sync">a&lt; </span></h2>' in p and "b </span><br></div>" in p
    assert "91.2 % sure, 12.0 ms, 3 gaps kept" in p and "metrics" not in q and "--accent: #" not in q.split("</style>")[1] and "d </span><br><br></div>" in q and 'type="audio/wav"' in q and "Leitura Guiada" in q and "citation" not in q
    data = re.search(r"window.PAGE = \{ words: (.*), duration: (.*), title: (.*), audioFile: (.*) \};", p)
    assert json.loads(data[1])[1] == {"word": "b", "start": 0.5, "end": 1.235, "confidence": 1.0, "line_break_after": True} and json.loads(data[3]) == "T<" and data[2] == "65.0"
    own = spark.createDataFrame([("q", "plain", "Other"), ("p", "nosuch", None)], "page_id string, template string, title string")
    other = {r.page_id: r.html for r in sinks.html_pages(context, overrides=own).collect()}
    assert other["q"].startswith("<title>Other</title>\n<h2>") and other["p"] == p


def test_documents(spark, words):
    df, head = rendered(spark, words)
    issues = spark.createDataFrame([("p", 1, "too_long", "warning", "m"), ("p", 0, "overlap", "error", "n"), ("p", 1, "overlap", "error", "o")], "page_id string, word_idx int, type string, severity string, message string")
    got = {r.page_id: json.loads(r.json) for r in sinks.documents(df, head.select("page_id", "title", F.lit(1.23456).alias("duration")), issues=issues).collect()}
    assert got["q"]["title"] is None and got["q"]["metrics"] is None and got["q"]["low_confidence_words"] == [] and got["q"]["duration"] == 1.235 and "timestamp_issues" not in got["q"] and list(got["q"]) == ["title", "duration", "word_count", "words", "metrics", "low_confidence_words"]
    found = got["p"]["timestamp_issues"]
    assert found.pop("issues")[0] == {"word_index": 0, "type": "overlap", "message": "n", "severity": "error", "suggested_correction": None}
    assert found == {"words_checked": 2, "total_issues": 3, "errors": 2, "warnings": 1, "issues_by_type": {"overlap": 2, "too_long": 1}}


ROWS = "page_id string, name string, content binary"


def tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(folder) for f in fs}


def test_files_are_whole(spark, tmp_path):
    at = str(tmp_path)
    old = [(f"p{k}", n, b"old") for k in range(6) for n in ("a", "b/c", "gone")] + [(None, "root.css", b"r")]
    files.write_files(spark.createDataFrame([(p, n, bytearray(c)) for p, n, c in old], ROWS), at)
    assert tree(at) == {os.path.join(p or "", n): c for p, n, c in old}
    # a task that dies in the middle of a page, and again when it is tried once more
    rows = files.together(spark.createDataFrame([(f"p{k}", n, bytearray(b"new")) for k in range(6) for n in ("a", "b/c", "d")], ROWS), 2)
    broken = rows.withColumn("content", F.when((F.col("page_id") == "p3") & (F.col("name") == "d"), F.raise_error(F.lit("dead")).cast("binary")).otherwise(F.col("content")))
    files.register(spark)
    with pytest.raises(Exception, match="dead"):
        broken.write.format("page_files").mode("append").save(at)
    left = {f: c for f, c in tree(at).items() if not f.startswith("_")}  # a task may still be at work
    for k in range(6):
        own = {f: c for f, c in left.items() if f.startswith(f"p{k}/")}
        assert own in ({f"p{k}/{n}": b"old" for n in ("a", "b/c", "gone")}, {f"p{k}/{n}": b"new" for n in ("a", "b/c", "d")})
    assert left["p3/gone"] == b"old"
    killed, late = tmp_path / "_staging" / "killed", tmp_path / "_staging" / "late"
    for folder in (killed, late):
        folder.mkdir(parents=True)
        (folder / "a").write_bytes(b"part")
    os.utime(killed, (1, 1))
    files.write_files(rows, at)
    assert not killed.exists() and late.exists()
    (late / "a").unlink()
    assert tree(at) == {f"p{k}/{n}": b"new" for k in range(6) for n in ("a", "b/c", "d")} | {"root.css": b"r"}
    for bad in (("..", "a"), ("p", "../a"), ("p", ""), ("_x", "a"), ("a/b", "c"), ("p", "/a")):
        with pytest.raises(Exception, match="no name"):
            files.write_files(spark.createDataFrame([(*bad, bytearray(b""))], ROWS), at)


def page(folder, name, text, citation=None, inner=False):
    own = folder / name / "content" if inner else folder / name
    own.mkdir(parents=True, exist_ok=True)
    (own / "text.txt").write_text(text, encoding="utf-8")
    (own / "audio.mp3").write_bytes(name.encode())
    words = [{"word": w.lower(), "start": i * 0.5 + 0.1, "end": i * 0.5 + 0.5} for i, w in enumerate(text.split())]
    (own / "response.json").write_text(json.dumps({"duration": len(words) * 0.5 + 0.2, "text": text, "words": words}))
    if citation:
        (own / "referencia.txt").write_text(citation, encoding="utf-8")


def test_build_is_incremental(spark, tmp_path, capsys):
    content, out = tmp_path / "content", str(tmp_path / "site")
    for k in range(5):
        page(content, f"livro{k}-x", f"Título {k}\nUm verso curto\nOutro verso", "SILVA, Ana. A casa. São Paulo: Lua, 2001." if k == 1 else None, inner=k == 2)
    (content / "no-audio").mkdir()
    (content / "no-audio" / "text.txt").write_text("x")
    assert main(["build", str(content), out, "--partitions", "2"], spark) == 0
    assert "6 pages built" in capsys.readouterr().out
    first = tree(out)
    made = {f.split("/")[0] for f in first if not f.startswith("_")}
    assert made == {f"livro{k}-x" for k in range(5)} and first["livro2-x/audio.mp3"] == b"livro2-x" and b"A casa" in first["livro1-x/index.html"] and b"citation" not in first["livro0-x/index.html"].split(b"<header>")[1]
    stored = json.loads(first["livro3-x/index.json"])
    assert stored["word_count"] == 7 and stored["title"] == "Título 3" and [w["word"] for w in stored["words"]][:2] == ["Título", "3"] and stored["metrics"]["word_accuracy"] > 0.5
    assert site.build(spark, str(content), out) == 0
    page(content, "livro3-x", "Título 3\nUm verso novo", None)
    os.utime(content / "livro0-x" / "text.txt", (1, 1))
    before = {f: os.stat(os.path.join(out, f)).st_mtime_ns for f in first if not f.startswith("_")}
    assert main(["build", str(content), out], spark) == 0 and "1 pages built" in capsys.readouterr().out
    now = tree(out)
    assert {f for f in before if os.stat(os.path.join(out, f)).st_mtime_ns != before[f]} == {f"livro3-x/{n}" for n in ("index.html", "index.json", "audio.mp3")} and b"novo" in now["livro3-x/index.html"]
    assert site.index_of(spark, out).count() == 5 and pages.results(spark, f"{out}/*/index.json").count() == 5
    for command in (["index", out], ["worst", out], ["due", str(content), out, "--by", "stamp"], ["pages", str(content)]):
        assert main(command, spark) == 0
    assert "livro4-x" in capsys.readouterr().out
